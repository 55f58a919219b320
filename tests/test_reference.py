"""The FASTA reader against a plain one, over splits, and in linear time."""

import random
import time

import pytest

from seqweave.sources.reference import read_genome


def plain(texts, size):
    out = {}
    for text in texts:
        name = None
        for line in text.split("\n"):
            if line.startswith(">"):
                name = (line[1:].split() or [""])[0]
                out[name] = ""
            elif name is not None:
                out[name] += "".join(line.split()).upper()
    return sorted((c, k // size, s[k : k + size]) for c, s in out.items() for k in range(0, max(len(s), 1), size))


def fasta(rng, contigs, width, longest):
    lines = ["left out"]
    for k in range(contigs):
        seq = "".join(rng.choices("ACGTNacgt", k=rng.choice([0, 1, longest // 7, longest])))
        lines += [f">c{k} some > words", *(seq[i : i + width] for i in range(0, len(seq), width)), *[""] * rng.choice([0, 0, 2])]
    return "\n".join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize(("split", "size", "width"), [(300, 7, 10), (900, 64, 61), (1 << 27, 4096, 60), (1500, 64, 100_000)])
def test_chunks_as_plain_over_splits(spark, tmp_path, split, size, width):
    rng = random.Random(split)
    texts = [fasta(rng, 12, width, 400), fasta(rng, 1, width, 3000).replace("c0", "other"), ""]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.fa").write_text(t)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = sorted(map(tuple, read_genome(spark, f"{tmp_path}/*.fa", size).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == plain(texts, size)


def test_line_ends_and_compression(spark, tmp_path):
    import gzip

    (tmp_path / "a.fa").write_bytes(b">x y\r\nAC GT\r\n\r\nac\r\n>\r\nT\r\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nGATTACA\n")
    got = {(r["contig"], r["chunk"]): r["seq"] for r in read_genome(spark, str(tmp_path), 4).collect()}
    assert got == {("x", 0): "ACGT", ("x", 1): "AC", ("", 0): "T", ("z", 0): "GATT", ("z", 1): "ACA"}


def test_time_is_linear(spark, tmp_path):
    """Twice the contig takes at most 2.2 times as long, and 60 Mb are a matter of seconds."""
    line = ("ACGTTGCANN" * 6 + "\n") * 10_000
    seconds = []
    for k, mb in enumerate((2, 30, 60)):
        path = tmp_path / f"{k}.fa"
        with path.open("w") as f:
            f.write(">one\n")
            for _ in range(mb * 10 // 6):
                f.write(line)
        began = time.perf_counter()
        rows = read_genome(spark, str(path)).selectExpr("count(*) AS n", "sum(length(seq)) AS bases").first()
        seconds.append(time.perf_counter() - began)
        assert rows["bases"] == mb * 10 // 6 * 600_000 and rows["n"] == -(-rows["bases"] // 4096)
    assert seconds[2] < 2.2 * seconds[1] + 1 and seconds[2] < 30
