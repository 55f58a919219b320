"""Queries over files, sinks and the smaller column functions. Files are written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions import alleles as A
from seqweave.operators import calls as C
from seqweave.operators import intervals as I
from seqweave.operators.staging import new_folder
from seqweave.sources import reference, tables, vcf

from .sequence_queries import _BARE, _ITV, _MERGED, _NAMES, _intervals, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "files")


@query("SELECT p_partkey AS k, CASE p_size % 3 WHEN 1 THEN p_brand WHEN 2 THEN p_brand || ',' || p_type END AS plain, CASE p_size % 3 WHEN 1 THEN p_brand WHEN 2 THEN CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE p_brand || ',' || p_type END END AS own FROM part")
def annotation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None, one or two values, as text and as the value of one alternative."""
    rows = table(spark, sf_dir, "part").withColumn("v", F.expr("CASE p_size % 3 WHEN 1 THEN array(p_brand) WHEN 2 THEN array(p_brand, p_type) ELSE CAST(array() AS ARRAY<STRING>) END"))
    return rows.select(F.col("p_partkey").alias("k"), A.plain_value(F.col("v")).alias("plain"), A.allele_value(F.col("v"), F.col("p_size") % 4).alias("own"))


@query("SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 7 ELSE 0 END ELSE 0 END AS n, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS number FROM part")
def count_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count by its place in a list, with places missing and texts that are none; and texts as numbers."""
    rows = table(spark, sf_dir, "part").withColumns({"v": F.expr("array(CAST(p_size AS STRING), CASE WHEN p_size % 2 = 0 THEN '7' ELSE 'x' END)"), "number": F.expr("CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS STRING) ELSE 'none' END")})
    return rows.select(F.col("p_partkey").alias("k"), A.count_value(F.col("v"), F.col("p_size") % 3).alias("n"), *tables.numbers(rows, ["number"]))


@query("""SELECT p_partkey AS k, coalesce(m AND h AND greatest(r, a) >= 4, false) AS targeted, CASE WHEN coalesce(m AND h AND greatest(r, a) >= 4, false) THEN 'HP' ELSE 'NON_HP' END AS stratum,
  CASE WHEN s AND g THEN 'AOHC_SYNTHETIC+GIAB_HG002' WHEN s THEN 'AOHC_SYNTHETIC' WHEN g THEN 'GIAB_HG002' ELSE '' END AS sources FROM (SELECT p_partkey, p_size % 2 = 0 AS m, CASE WHEN p_size % 5 > 0 THEN p_size % 3 > 0 END AS h, p_size % 6 AS r, p_size % 7 AS a, p_partkey % 2 = 0 AS s, p_partkey % 3 = 0 AS g FROM part)""")
def target_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size % 2 = 0 AS m", "CASE WHEN p_size % 5 > 0 THEN p_size % 3 > 0 END AS h", "p_size % 6 AS r", "p_size % 7 AS a", "p_partkey % 2 = 0 AS s", "p_partkey % 3 = 0 AS g")
    targeted = A.targeted_homopolymer(F.col("m"), F.col("h"), F.col("r"), F.col("a"))
    return rows.select("k", targeted.alias("targeted"), A.stratum(targeted).alias("stratum"), A.truth_sources(F.col("s"), F.col("g")).alias("sources"))


@query("""SELECT p_partkey AS k, c AS chrom, CAST(p_size AS INT) AS pos, upper(p_type) AS ref, upper(p_brand) AS alt, c || ':' || p_size || ':' || upper(p_type) || ':' || upper(p_brand) AS locus_id
  FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'MT' WHEN 1 THEN 'X' ELSE CAST(p_partkey % 22 AS VARCHAR) END AS c FROM part)""")
def variant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'chrM' WHEN 1 THEN ' Chrx' WHEN 2 THEN concat('CHR', p_partkey % 22) ELSE concat(p_partkey % 22, ' ') END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *A.variant_key(name, F.col("p_size"), F.lower("p_type"), F.lower("p_brand")))


@query(f"SELECT canonical, arg_min(name, c_custkey) AS name FROM (SELECT c_custkey, {_NAMES} AS name, CASE WHEN upper({_BARE}) IN ('M', 'MT') THEN 'MT' WHEN upper({_BARE}) IN ('X', 'Y') THEN upper({_BARE}) ELSE {_BARE} END AS canonical FROM customer) GROUP BY canonical")
def contig_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the names that mean one contig."""
    return tables.resolved(table(spark, sf_dir, "customer").selectExpr("c_custkey AS ord", f"{_NAMES} AS name"))


@query(f'WITH {_ITV}, {_MERGED} SELECT contig, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end" FROM m')
def interval_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged intervals written under a file's contig names and read back."""
    path = _folder(spark)
    tables.write_intervals(I.merged(_intervals(spark, sf_dir)), path, [f"chr{k}" for k in range(5)])
    return tables.load_intervals(spark, path)


@query("SELECT p_partkey AS k, CASE WHEN p_size % 3 > 0 THEN p_name END AS name, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS price FROM part")
def table_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with nulls written as tab-separated text, where they are NA, and read back."""
    path = _folder(spark)
    tables.write_frame(table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "CASE WHEN p_size % 3 > 0 THEN p_name END AS name", "CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE double('NaN') END AS price"), path)
    return spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").schema("k long, name string, price double").csv(f"{path}.tsv")


@query("""SELECT 'S' || n_nationkey AS sample, 'R' || n_regionkey AS run, CASE WHEN n_nationkey % 2 = 0 THEN '/abs/' || n_name ELSE 'x/' || n_name END AS bam, CASE n_nationkey % 3 WHEN 0 THEN 'AOHC' ELSE 'HG002' END AS truth_profile FROM nation""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written and loaded: paths against its folder (shown as x), profiles by their aliases."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "nation").selectExpr("concat('S', n_nationkey) AS sample", "concat('R', n_regionkey) AS run", "CASE WHEN n_nationkey % 2 = 0 THEN concat('/abs/', n_name) ELSE n_name END AS bam", "'c.vcf' AS vcf", "CASE n_nationkey % 3 WHEN 0 THEN ' aohc' WHEN 1 THEN 'na24385' ELSE 'Giab' END AS truth_profile")
    rows.write.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(f"{path}/m.tsv")
    out = tables.load_manifest(spark, f"{path}/m.tsv")
    return out.select("sample", "run", F.replace("bam", F.lit(path), F.lit("x")).alias("bam"), "truth_profile")


@query("SELECT 'chr' || n_nationkey AS name FROM nation")
def header_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs of a call file's header."""
    path = _folder(spark)
    table(spark, sf_dir, "nation").selectExpr("inline(array(struct(concat('##contig=<ID=chr', n_nationkey, ',length=9>') AS value), struct('##x' AS value), struct(concat('chr1', chr(9), n_name) AS value)))").write.text(path)
    return spark.createDataFrame([(n,) for n in vcf.read_contigs(spark, path)], "name string")  # a header's contigs


@query("SELECT 'c' || s_suppkey AS contig, CAST(k AS BIGINT) AS chunk, substr(upper(md5(CAST(s_suppkey AS VARCHAR))), k * 10 + 1, 10) AS seq FROM supplier, (SELECT unnest(range(0, 4)) AS k)")
def reference_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a reference file with wrapped lines and marks in their headers, cut into chunks of ten bases."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "supplier").selectExpr("concat('>c', s_suppkey, ' a>b >c\\n', substr(md5(CAST(s_suppkey AS STRING)), 1, 20), '\\n', substr(md5(CAST(s_suppkey AS STRING)), 21, 12)) AS value")
    rows.write.text(path)
    return reference.read_genome(spark, path, 10)


_ALLELES = "SELECT CAST(p_partkey % 5 AS VARCHAR) AS chrom, CAST(p_partkey % 300 AS INT) AS pos, 'A' AS ref, 'AC' AS alt FROM part"


@query(f"""WITH p AS ({_ALLELES}), s AS (SELECT DISTINCT * FROM p WHERE pos % 2 = 0), g AS (SELECT DISTINCT * FROM p WHERE pos % 3 = 0), a AS (SELECT DISTINCT * FROM p)
SELECT a.*, CASE WHEN s.pos IS NOT NULL OR g.pos IS NOT NULL THEN 1 END AS label, CASE WHEN s.pos IS NOT NULL OR g.pos IS NOT NULL THEN 'TP' ELSE 'UNKNOWN' END AS label_name FROM a LEFT JOIN s USING (chrom, pos, ref, alt) LEFT JOIN g USING (chrom, pos, ref, alt)""")
def truth_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct alleles labelled from the union of two truth sets, without confident intervals."""
    rows = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey % 5 AS STRING) AS chrom", "CAST(p_partkey % 300 AS INT) AS pos", "'A' AS ref", "'AC' AS alt").distinct()
    none = spark.createDataFrame([], "contig string, start long, end long")
    return C.labelled(rows, rows.where("pos % 2 = 0"), rows.where("pos % 3 = 0"), none).select("chrom", "pos", "ref", "alt", "label", "label_name")
