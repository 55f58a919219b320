"""The jobs as queries: each runs twice into one new folder of the shared place, and returns what is there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seqweave.operators.staging import shared_root

from . import callset_release, homopolymer_targets


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def job1_callset_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, config = _folder(spark, "job1"), callset_release.config_of()
    for _ in range(2):
        tables = callset_release.release(spark, f"{sf_dir}/lineitem.parquet", output, config)
    return callset_release.together(*tables)


def job2_homopolymer_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, config = _folder(spark, "job2"), homopolymer_targets.config_of()
    for _ in range(2):
        homopolymer_targets.update(spark, f"{sf_dir}/documents.parque[t]", output, config)  # a pattern, as it may be a file
    return homopolymer_targets.output_of(spark, output)


def _job1_sql() -> str:
    config = callset_release.config_of()
    columns = ", ".join(f"{v} AS {k}" for k, v in config["columns"].items())
    best = "row_number() OVER (PARTITION BY run, locus_id ORDER BY CASE WHEN probability = 0 THEN -1 ELSE coalesce(probability, -1) END DESC, ord) = 1"
    return f"""
WITH c AS (SELECT {columns} FROM lineitem), best AS (SELECT * FROM c QUALIFY {best}),
known AS (SELECT * FROM c WHERE control AND label IS NOT NULL QUALIFY {best}),
steps AS (SELECT run, s, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM (SELECT run, probability AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM known WHERE NOT original_called GROUP BY run, probability) WINDOW w AS (PARTITION BY run ORDER BY s DESC)),
limits AS (SELECT run, coalesce(first(s ORDER BY cp DESC, cn, s DESC) FILTER (cn <= {config["false_positives"]}), max(s) + greatest(abs(max(s)) * 1.1102230246251568e-16, 5e-324)) AS threshold FROM steps GROUP BY run),
calls AS (SELECT run, locus_id, ord, probability, label, original_called, stratum, control, CASE WHEN run IN (SELECT run FROM known) THEN coalesce(threshold, 'infinity') END AS threshold FROM best LEFT JOIN limits USING (run)),
done AS (SELECT *, NOT original_called AND coalesce(probability >= threshold, false) AS rescued FROM calls),
final AS (SELECT *, original_called OR rescued AS final_called FROM done),
long AS (SELECT run, stratum, label, 'ORIGINAL' AS system, original_called AS called FROM final WHERE label IS NOT NULL UNION ALL SELECT run, stratum, label, 'ADDON', final_called FROM final WHERE label IS NOT NULL),
metrics AS (SELECT run, system, coalesce(stratum, 'ALL') AS stratum, count(*) FILTER (called AND label = 1) AS "TP", count(*) FILTER (called AND label = 0) AS "FP", count(*) FILTER (label = 1 AND NOT called) AS "FN",
  count(*) FILTER (called AND label = 1) / nullif(count(*) FILTER (label = 1), 0) AS sensitivity, count(*) FILTER (called AND label = 1) / nullif(count(*) FILTER (called), 0) AS precision FROM long GROUP BY GROUPING SETS ((run, system, stratum), (run, system)))
SELECT *, 'calls' AS part FROM final UNION ALL BY NAME SELECT *, 'metrics' AS part FROM metrics"""


def _job2_sql() -> str:
    c = homopolymer_targets.config_of()
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, CAST({c["id"]} AS VARCHAR) AS contig, CAST({c["group"]} AS VARCHAR) AS grp, string_split(translate({c["sequence"]}, 'acgt', 'ACGT'), '') AS s FROM documents WHERE {c["sequence"]} <> ''),
l AS (SELECT row, contig, grp, unnest(s) AS b, unnest(range(len(s))) AS i FROM d),
e AS (SELECT *, i - row_number() OVER (PARTITION BY row, b ORDER BY i) AS island FROM l WHERE b IN ('A', 'C', 'G', 'T')),
g AS (SELECT row, i // {c["piece"]} AS k, count(*) FILTER (b IN ('G', 'C')) / count(*) AS gc FROM e GROUP BY ALL),
r AS (SELECT row, contig, grp, b AS base, min(i) AS start0, max(i) + 1 AS end0, count(*) AS length FROM e GROUP BY row, contig, grp, b, island HAVING count(*) >= {c["min_run"]}),
t AS (SELECT contig, grp, base, start0, end0, length, gc FROM r JOIN g ON g.row = r.row AND g.k = r.start0 // {c["piece"]})
SELECT *, 'targets' AS part FROM t UNION ALL BY NAME SELECT grp, base, length, count(*) AS runs, CAST(sum(length) AS BIGINT) AS bases, 'counts' AS part FROM t GROUP BY grp, base, length"""


QUERIES = {"job1_callset_release": job1_callset_release, "job2_homopolymer_targets": job2_homopolymer_targets}
ORACLES = {"job1_callset_release": _job1_sql(), "job2_homopolymer_targets": _job2_sql()}
