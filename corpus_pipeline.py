"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, decontamination and packing, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.llm import decontamination, line_dedup, packing, quality_rules, simhash
from seqweave.llm.common import documents, shared_dir, stored, table

#: Near-duplicates: fingerprints of five-word shingles within seven bits, and a common key of twelve bands of five least
#: hashes, nominate (0.99 of the pairs at the least similarity); a Jaccard similarity of 0.8 decides.
SHINGLE, RADIUS, PARTS, SIMILARITY, BANDS, LEAST = 5, 7, 9, 0.8, 12, 5


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with columns c0, c1, ..., so that no name clashes with an operator's own; and those of doc_id and text."""
    names = docs.columns
    return docs.toDF(*(f"c{k}" for k in range(len(names)))), f"c{names.index('doc_id')}", f"c{names.index('text')}"


def _named(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(f"c{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the suffix-array verdict."""
    rows, _, text = _numbered(docs)
    return _named(quality_rules.judged(rows, rows.columns, text).where("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them hold; those left without a word go."""
    rows, _, text = _numbered(docs)
    out = line_dedup.deduplicated(rows, text=text)
    out = out.where(F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        chars = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(chars, F.length(text).cast(docs.schema["n_chars"].dataType))
    return _named(out, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but for those as similar as SIMILARITY to the one of the smallest id of their group, which stays; rows
    that share an id stay or go together."""
    rows, doc_id, text = _numbered(docs)
    copies = simhash.verified_copies(rows, doc_id, text, SHINGLE, RADIUS, PARTS, SIMILARITY, BANDS, LEAST)
    return _named(rows.join(copies, doc_id, "left_anti"), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    rows, _, text = _numbered(docs)
    keyed = rows.select("*", *line_dedup.two_hashes(F.coalesce(text, F.lit("")), "__t"))
    found = decontamination.leaks(keyed, table(spark, sf_dir, "benchmark"), ["__t1", "__t2"], text).select("__t1", "__t2").distinct()
    return _named(keyed.join(stored(found, f"{shared_dir(spark)}/leaks"), ["__t1", "__t2"], "left_anti"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their places in training sequences."""
    return packing.digest(packing.packed(docs.select("doc_id", "text"), ["doc_id"]))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near), ("decontamination", decontaminated), ("packing", pack)]

#: SQL has no XXH64, no tokenizer and no packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"{path}/{k}-{name}")
    return docs
