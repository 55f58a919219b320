"""The BAM reader over splits, against the records that were written."""

import random
import struct

import pytest

from seqweave.sources import alignments
from test_end_to_end import blocks

CONTIGS = ["chr1", "chr2", "chrM"]


def written(rng, n):
    """Records of several shapes, and the same as rows."""
    out, rows = [], []
    for k in range(n):
        size = rng.choice([0, 1, 7, 60, 400])
        seq, ref, pos = "".join(rng.choices("ACGTN", k=size)), rng.choice([-1, 0, 1, 2]), rng.randint(0, 5000)
        cigar = [(0, size // 2), (1, 1), (2, 3), (4, size - size // 2 - 1)] if size > 7 else [(0, size)] if size else []
        packed = bytes((alignments.BASES.index(a) << 4) | alignments.BASES.index(b) for a, b in zip(seq[::2], (seq + "=")[1::2], strict=False))
        zm = [rng.randint(-300, 300) for _ in range(rng.choice([0, 3, 200]))]
        tags = b"RGZg1\0" + b"XXBC" + struct.pack("<i", 9) + (alignments.MAGIC if k in (3, 500) else b"none") + b"\0\1BC\x02" + b"ZFc" + bytes([5]) + b"XAAq" + b"ZMBs" + struct.pack("<i", len(zm)) + struct.pack(f"<{len(zm)}h", *zm) + b"ZPBf" + struct.pack("<i2f", 2, 0.5, 0.25) if k % 5 else b""
        name = f"read:{k}:" + "x" * rng.randint(0, 30)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, k % 61, 0, len(cigar), k % 4096, size, -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", m << 4 | op) for op, m in cigar) + packed + b"\xff" * size + tags
        out.append(struct.pack("<i", len(body)) + body)
        end = pos + sum(m for op, m in cigar if op in (0, 2, 3, 7, 8))
        rows.append(("R", name, k % 4096, CONTIGS[ref] if ref >= 0 else None, pos, end, k % 61, cigar, seq or None, *(("g1", 5, zm, [0.5, 0.25]) if k % 5 else (None,) * 4)))
    return b"".join(out), rows


def file(path, records, size, level):
    text = b"@HD\tVN:1.6\n@RG\tID:g1\tFO:TACG\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(CONTIGS)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", 10_000) for c in CONTIGS)
    path.write_bytes(blocks(head + records, size, level))


def rows_of(df):
    return [(r["run"], *(r[c] for c in ("qname", "flag", "contig", "ref_start", "ref_end", "mapq")), [tuple(c) for c in r["cigar"]], *(r[c] for c in ("seq", "rg", "zf", "zm", "zp"))) for r in df.orderBy("read_id").collect()]


@pytest.fixture
def split_size(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(("split", "size", "level"), [(1 << 27, 60_000, 6), (40_000, 3000, 0), (30_000, 700, 6), (25_000, 60_000, 6)])
def test_records_over_splits(spark, tmp_path, split_size, split, size, level):
    """Records lie over blocks and splits, and hold what blocks begin with."""
    records, rows = written(random.Random(size), 900)
    file(tmp_path / "x.bam", records, size, level)
    split_size(split)
    got = alignments.read_bam(spark, f"{tmp_path}/x.bam", "R")
    assert rows_of(got) == rows and got.select("read_id").distinct().count() == len(rows)
    ids = [r[0] for r in got.select("read_id").orderBy("read_id").collect()]
    split_size(1 << 27)
    assert [r[0] for r in alignments.read_bam(spark, f"{tmp_path}/x.bam", "R").select("read_id").orderBy("read_id").collect()] == ids
    assert ids[0] >> 16 == 0 and alignments.flow_orders(spark, f"{tmp_path}/x.bam", "R").first()["fo"] == "TACG"


def test_regions_and_several_files(spark, tmp_path):
    records, rows = written(random.Random(1), 300)
    file(tmp_path / "x.bam", records, 5000, 6)
    file(tmp_path / "none.bam", b"", 5000, 6)
    got = rows_of(alignments.read_bam(spark, f"{tmp_path}/x.bam", "R", [("chr1", 100, 900), ("chrM", 0, 50), ("absent", 0, 9)]))
    inside = lambda r: any(r[3] == c and r[4] < b and max(r[5], r[4] + 1) > a for c, a, b in [("chr1", 100, 900), ("chrM", 0, 50)])
    assert got == [r for r in rows if inside(r)] and got
    assert alignments.read_bam(spark, f"{tmp_path}/none.bam,{tmp_path}/x.bam", "R").count() == len(rows)


def test_damaged_files_are_errors(spark, tmp_path, split_size):
    records, _ = written(random.Random(2), 300)
    file(tmp_path / "x.bam", records[:-10], 3000, 6)
    split_size(20_000)
    with pytest.raises(Exception, match="cut off|follow"):
        alignments.read_bam(spark, f"{tmp_path}/x.bam", "R").count()
    (tmp_path / "no.bam").write_bytes(blocks(b"something else"))
    with pytest.raises(ValueError):
        alignments.read_header(spark, f"{tmp_path}/no.bam")
