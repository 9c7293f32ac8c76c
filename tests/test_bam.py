"""The BAM source against the text reader, over splits that cut records and blocks."""

import json
import random

import pytest

from porelake.sources import bam
from porelake.sources.text import read_sam

REFS = [("chr1", 100_000), ("chr2", 5000), ("é", 7)]
COLUMNS = [c.split()[0] for c in bam.SCHEMA.split(", ")]


def records(n):
    rnd = random.Random(1)
    out = []
    for k in range(n):
        size = rnd.choice([0, 1, 5, 40, 400, 3000])
        rname = rnd.choice(["chr1", "chr2", "*", "é"])
        tags = rnd.choice(["", "NM:i:5", "NM:i:300\tXX:Z:hello w\tBB:B:s,1,-2,3\tAA:A:x\tFF:f:1.5", "NM:i:-5\tZZ:i:4000000000\tHH:H:1AE3\tBF:B:f,0.5,2"])
        qual = "*" if not size or k % 3 == 0 else "".join(chr(34 + rnd.randrange(60)) for _ in range(size))
        seq = "".join(rnd.choice("ACGTN=") for _ in range(size)) or "*"
        out.append((f"r{k}", rnd.choice([0, 4, 16]), rname, rnd.randrange(5000), rnd.randrange(256), rnd.choice(["*", f"{max(1, size)}M", "3S4M1I2D"]), "*" if rname == "*" else rnd.choice(["*", "="]), rnd.randrange(100), rnd.randrange(-99, 99), seq, qual, tags))
    out[5] = (*out[5][:5], "1M1I" * 40_000, *out[5][6:])  # more operations than the fixed field counts
    return out


@pytest.fixture(scope="module")
def sam(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sam") / "x.sam")
    with open(path, "w") as f:
        f.write("@HD\tVN:1.6\n")
        f.writelines("\t".join(map(str, r)).rstrip("\t") + "\n" for r in records(1500))
    return read_sam(spark, path)


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("block", [300, 65_280])
@pytest.mark.parametrize("split", [0, 5000, 1 << 20])
def test_rows_equal_the_text_reader(spark, sam, tmp_path, block, split):
    bam.write_bam(sam.repartition(3), f"file://{tmp_path}/out", REFS, block_bytes=block)
    assert rows(bam.read_bam(spark, f"file://{tmp_path}/out", split)) == rows(sam)


def one_file(path, found, block, refs=REFS):
    w = bam.BamWriter({"path": "", "references": json.dumps(refs), "blockBytes": str(block)}, False)
    data = w.head + b"".join(bam._record(dict(zip(COLUMNS, r)), {"*": -1} | {n: k for k, (n, _) in enumerate(refs)}) for r in found)
    with open(path, "wb") as f:
        f.writelines(bam.block_of(data[at : at + block]) for at in range(0, len(data), block))
        f.write(bam.END_BLOCK)


def test_each_record_belongs_to_one_split(tmp_path):
    """Splits down to a few blocks, and records that span many of both; with and without a look back."""
    path, found = str(tmp_path / "x.bam"), records(300)
    one_file(path, found, 500)
    for split, back in ((0, 0), (900, 0), (7000, 0), (7000, 3000), (7000, 1 << 20)):
        reader = bam.BamReader({"path": path, "splitBytes": str(split), "lookBack": str(back)})
        got = [tuple(r.values()) for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
        assert got == found


def test_bytes_that_look_like_records(tmp_path):
    """Tags that hold records, right to their end, do not mislead a split that looks back beyond them."""
    fake = bam._record(dict(zip(COLUMNS, records(10)[0])), {"*": -1, "chr1": 0, "chr2": 1, "é": 2}) * 3
    found = [(*r[:11], "XB:B:C," + ",".join(map(str, fake))) for r in records(120)]
    path = str(tmp_path / "x.bam")
    one_file(path, found, 700)
    reader = bam.BamReader({"path": path, "splitBytes": "6000", "lookBack": "60000"})
    assert len(reader.partitions()) > 10
    assert [tuple(r.values()) for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()] == found


def test_damage_is_an_error(tmp_path):
    path = str(tmp_path / "x.bam")
    one_file(path, records(200), 4000)
    data = bytearray(open(path, "rb").read())
    for name, bad in (("cut", data[: len(data) // 2]), ("flipped", data[:5000] + bytes([data[5000] ^ 1]) + data[5001:]), ("text", b"@HD\tVN:1.6\n" * 10)):
        (tmp_path / name).write_bytes(bad)
        reader = bam.BamReader({"path": str(tmp_path / name), "splitBytes": "0"})
        with pytest.raises((ValueError, Exception), match="damaged|truncated|not a BAM|distance|invalid|within"):
            [b for s in reader.partitions() for b in reader.read(s)]


def test_empty_tables_and_missing_files(spark, sam, tmp_path):
    bam.write_bam(sam.where("flag = 99"), f"file://{tmp_path}/none", REFS)
    assert bam.read_bam(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="missing.bam"):
        bam.read_bam(spark, f"file://{tmp_path}/missing.bam").count()
