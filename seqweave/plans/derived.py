"""Relations derived from the shared tables by expressions that Spark and DuckDB evaluate alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqweave.operators.staging import spread

#: Bases from a hash; rich in A, so that runs occur.
def dna(x: str) -> str:
    return f"translate(md5(CAST({x} AS STRING)), '0123456789abcdef', 'AAAAAACCCCGGGTTT')"


#: Call rows: run and locus, truth, the caller's own call, a score and a stratum.
CALLS = {
    "run": "l_linenumber",
    "locus_id": "l_partkey",
    "ord": "l_orderkey * 10 + l_linenumber",
    "label": "CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END",
    "is_truth": "l_partkey % 5 = 0",
    "original_called": "l_returnflag = 'R'",
    "probability": "CAST((l_orderkey * 7919 + l_linenumber * 104729) % 10007 AS DOUBLE) / 10007",
    "evaluation_stratum": "CASE WHEN l_partkey % 3 = 0 THEN 'HP' ELSE 'NON_HP' END",
    "truth_source": "CASE WHEN l_linestatus = 'O' THEN 'AOHC_SYNTHETIC' ELSE 'GIAB_HG002' END",
    "truth_profile": "CASE WHEN l_shipdate < DATE '1995-06-17' THEN 'HG002' ELSE 'AOHC' END",
    "final_called": "l_returnflag = 'R' OR CAST((l_orderkey * 7919 + l_linenumber * 104729) % 10007 AS DOUBLE) / 10007 >= 0.9",
}
#: Intervals, and points that fall around them.
INTERVALS = {"contig": "CAST(l_suppkey % 5 AS STRING)", "start": "l_partkey * 40", "end": "l_partkey * 40 + CAST(floor(l_quantity) AS BIGINT)"}
#: Reads: an alignment of 32 bases with one of four shapes, flags and a quality.
READS = {
    "read_id": "(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey) * 100 + CAST(floor(l_quantity) AS BIGINT)",
    "run": "CAST(l_linenumber AS STRING)",
    "contig": "CAST(l_suppkey % 5 AS STRING)",
    "flag": "CASE WHEN l_orderkey % 11 = 0 THEN 1024 WHEN l_orderkey % 13 = 0 THEN 256 ELSE 0 END + CASE WHEN l_partkey % 2 = 0 THEN 16 ELSE 0 END",
    "mapq": "CAST(floor(l_discount * 600) AS INT)",
    "ref_start": "CAST(l_partkey AS INT)",
    "shape": "CAST(l_orderkey % 4 AS INT)",
    "seq": dna("(l_orderkey * 10 + l_linenumber) * 100000 + l_partkey"),
}
#: Reference: chunks of 32 bases of eight contigs.
GENOME = {"contig": "CAST(o_custkey % 8 AS STRING)", "ord": "o_orderkey", "seq": dna("o_orderkey")}
CHUNK = 32


def picked(columns: dict[str, str], names: list[str] | None = None) -> list[str]:
    return [f"{v} AS `{k}`" for k, v in columns.items() if names is None or k in names]


def selected(columns: dict[str, str], table: str, names: list[str] | None = None) -> str:
    """The same as SQL for DuckDB."""
    return "SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in columns.items() if names is None or k in names) + f" FROM {table}"


def relation(spark: SparkSession, sf_dir: str, columns: dict[str, str], table: str, names: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by: columns of the table, by which its rows are dealt out where few tasks would read most of them."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return (spread(rows, *by) if by else rows).selectExpr(*picked(columns, names))
