"""Text formats, mapped-read tables and streams."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelake.operators import alignment, squiggle
from porelake.sources import reads, text
from porelake.streaming.rolling import rolling


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fasta"
    p.write_text(">a first\nACGT\nAC\n>b\nACNN\n>empty\n>a\nTTTT\n")
    assert {r.read_id: r.seq for r in text.read_fasta(spark, str(p)).collect()} == {"a": "TTTT", "b": "ACNN"}
    assert [r.read_id for r in text.read_fasta(spark, str(p), filter_ambiguous=True).collect()] == ["a"]
    reads.write_fasta(text.read_fasta(spark, str(p)), str(tmp_path / "out"))
    assert text.read_fasta(spark, str(tmp_path / "out")).count() == 2


def test_fasta_marks_inside_lines(spark, tmp_path):
    p = tmp_path / "x.fasta"
    p.write_text(">r1 a->b\nAC\nGT\r\n>r2 >>\nTT\n")
    assert {r.read_id: r.seq for r in text.read_fasta(spark, str(p)).collect()} == {"r1": "ACGT", "r2": "TT"}


def test_long_headers_and_tags(spark, tmp_path):
    p, q = tmp_path / "x.fastq", tmp_path / "x.sam"
    p.write_text("@" + "r" * 1_200_000 + " k\nA\n+\n5\n")
    assert len(text.read_fastq(spark, str(p)).first().read_id) == 1_200_000
    q.write_text("\t".join(["q", "0", "g", "1", "60", "1M", "*", "0", "0", "A", "!", *(f"X{k}:i:{k}" for k in range(1500)), "NM:i:7"]) + "\n")
    assert text.read_sam(spark, str(q)).first().tags.endswith("X1499:i:1499\tNM:i:7")


def test_sam_filters_by_id_and_reference(spark):
    sam = spark.createDataFrame([(q, 0, r, 1, "10M", "NM:i:1") for q, r in (("a", "g"), ("b", "g"), ("a", "h"))], "qname string, flag int, rname string, pos int, cigar string, tags string")
    ids, refs = spark.createDataFrame([("a",)], "qname string"), spark.createDataFrame([("g",)], "rname string")
    assert [(r.qname, r.rname) for r in alignment.of_sam(sam, read_ids=ids, references=refs).collect()] == [("a", "g")]
    assert alignment.of_sam(sam).count() == 3


def test_empty_and_damaged_tables_of_reads(spark, tmp_path):
    good = spark.createDataFrame([("a", [1, 2], [0, 1], [0])], "read_id string, dacs array<smallint>, ref_to_signal array<int>, reference array<smallint>")
    assert [tuple(r) for r in reads.check_mapped(good.where("read_id = 'z'")).collect()] == [(None, "No reads in file")]
    assert reads.check_mapped(good).count() == 0
    path = str(tmp_path / "mapped")
    reads.write_mapped(good, spark.createDataFrame([("ACGT",)], "alphabet string"), path)
    (tmp_path / "mapped" / "reads" / "part-bad.parquet").write_bytes(b"PAR1 not a table")
    assert [r.read_id for r in reads.read_mapped(spark, path, skip_bad=True).collect()] == ["a"]
    with pytest.raises(Exception):
        reads.read_mapped(spark, path).collect()


def test_fastq_gz(spark, tmp_path):
    p = tmp_path / "x.fastq.gz"
    with gzip.open(p, "wt") as f:
        f.write("@r1 k=v\nACG\n+\n+++\n@r2\nA\n+\n5\n")
    got = {r.read_id: (r.length, round(r.mean_q, 6)) for r in text.read_fastq(spark, str(p)).collect()}
    assert got == {"r1": (3, 10.0), "r2": (1, 20.0)}


def test_sam_to_metrics(spark, tmp_path):
    p = tmp_path / "x.sam"
    line = lambda q, flag, cigar, nm: "\t".join([q, str(flag), "g", "1", "60", cigar, "*", "0", "0", "ACGT", "!!!!", f"NM:i:{nm}"])
    p.write_text("@HD\tVN:1.6\n" + line("a", 0, "100S2971M58I86D", 214) + "\n" + line("b", 4, "*", 0) + "\n" + line("c", 16, "10M90S", 0) + "\n")
    got = alignment.of_sam(text.read_sam(spark, str(p))).collect()
    assert [r.qname for r in got] == ["a"]  # b is not mapped, c is covered by too little
    assert got[0].accuracy == pytest.approx(0.931300, abs=1e-6)


def test_tsv_and_lists(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text("UUID\ttrim_start\tshift\na\t1\t2.5\n")
    assert text.read_tsv(spark, str(p), ("UUID", "shift")).first().shift == 2.5
    with pytest.raises(KeyError):
        text.read_tsv(spark, str(p), ("scale",))
    with pytest.raises(ValueError):
        text.read_strand_list(spark, str(p))
    assert text.line_blocks(spark, str(p), 1).count() == 1
    q = tmp_path / "many.txt"
    q.write_text("head\n" + "".join(f"{k}\n" for k in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = text.line_blocks(spark, str(q), 100).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(int(r.value) == r.n and r.block == r.n // 100 for r in rows) and len(rows) == 20000


def test_alignment_summaries(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.samacc"
    a.write_text("read_id\talignment_strand_start\talignment_strand_end\talignment_accuracy\nx\t5\t25\t0.9\ny\t-1\t-1\t-1\n")
    b.write_text("query reference_start reference_end insertion deletion coverage accuracy\nx 0 30 2 4 0.8 0.7\n")
    assert [(r.read_id, r.accuracy, r.aligned_length) for r in text.read_alignment_summary(spark, str(a)).orderBy("read_id").collect()] == [("x", 0.9, 20), ("y", None, 0)]
    assert [(r.read_id, r.aligned_length) for r in text.read_alignment_summary(spark, str(b)).collect()] == [("x", 28)]


def test_mapped_reads_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2, 3], [0, 3], [1]), ("b", [1], [0, 5], [1])], "read_id string, dacs array<smallint>, ref_to_signal array<int>, reference array<smallint>")
    alphabet = spark.createDataFrame([(0, "A")], "code int, base string")
    path = str(tmp_path / "m")
    reads.write_mapped(df, alphabet, path)
    assert reads.read_mapped(spark, path).count() == 2
    assert reads.read_mapped(spark, path, spark.createDataFrame([("b",), ("z",)], "read_id string")).count() == 1
    assert [r.read_id for r in reads.check_mapped(reads.read_mapped(spark, path)).collect()] == ["b"]


def test_online_mean_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(k, float(t * (k + 1)), t) for k in range(3) for t in range(25)], "key long, value double, order long")
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    q = rolling(stream, "mean", window=5).writeStream.format("memory").queryName("rolled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.key, r.n): r.statistic for r in spark.table("rolled").collect()}
    assert len(got) == 75 and got[1, 25] == pytest.approx(sum(2 * t for t in range(20, 25)) / 5)
    for kind in ("quantile", "mad", "smooth"):
        assert rolling(stream, kind, window=5).isStreaming
    assert df.select(F.count("*")).first()[0] == 75


def test_strand_lists_of_exact_size(spark, tmp_path):
    """Every list but the last holds the size, over several ranges, and names stay in order over the lists."""
    names = [f"read_{k:05d}.fast5" for k in range(1003)] + ["read_00007.fast5"] * 30
    df = spark.createDataFrame([(n,) for n in names[::-1]], "filename string").repartition(7)
    reads.write_strand_lists(df, str(tmp_path / "lists"), 100)
    found = {}
    for f in (tmp_path / "lists").glob("file=*"):
        (part,) = f.glob("part-*")
        head, *rest = part.read_text().splitlines()
        assert head == "filename"
        found[int(f.name.removeprefix("file="))] = rest
    assert [len(found[k]) for k in range(11)] == [100] * 10 + [33]
    assert [n for k in range(11) for n in found[k]] == sorted(names)
    assert reads.listed(df.where("filename = 'none'"), 100).count() == 0


def test_differing_keys_and_required_columns(spark):
    rows = [(f"r{k}", 1.0, 2.0 if k % 3 else None) for k in range(10)]
    df = spark.createDataFrame(rows, "read_id string, shift double, `mapping.score` double")
    found = reads.differing_keys(df, most=2).collect()
    assert [(r["keys"], r.n, r.examples) for r in found] == [(["mapping.score", "shift"], 6, ["r1", "r2"]), (["shift"], 4, ["r0", "r3"])]
    assert all("different keys" in r.warning for r in found)
    (one,) = reads.differing_keys(df.where("read_id IN ('r1', 'r2')")).collect()
    assert one.n == 2 and one.warning is None
    assert reads.missing_columns(df, ("read_id", "scale")) == ["scale"]
    with pytest.raises(KeyError, match="dacs"):
        reads.require_columns(df)


def test_upgrade_of_reads_with_their_alphabet(spark, tmp_path):
    old = spark.createDataFrame([("b", [1, 2], [0, 2], [0], "ACGT", "ACGT", ""), ("a", [1], [0, 1], [0], "ACGT", "ACGT", "")], "read_id string, dacs array<smallint>, ref_to_signal array<int>, reference array<smallint>, alphabet string, collapse_alphabet string, mod_long_names string")
    new, alphabet = reads.upgrade(old)
    assert alphabet.collect() == [("ACGT", "ACGT", "")] and "alphabet" not in new.columns
    reads.write_mapped(new, alphabet, str(tmp_path / "m"))
    assert sorted(r.read_id for r in reads.read_mapped(spark, str(tmp_path / "m")).collect()) == ["a", "b"]


def test_tables_that_are_written(spark, tmp_path):
    """Parameters, calls in either direction, measures, reports and JSON lines, read back."""
    params = spark.createDataFrame([("a", 1, 2.5), ("b", 0, -1.0)], "UUID string, trim_start int, shift double")
    reads.write_tsv(params, str(tmp_path / "params"))
    assert sorted(map(tuple, text.read_tsv(spark, str(tmp_path / "params"), ("UUID",)).collect())) == [("a", 1, 2.5), ("b", 0, -1.0)]
    calls = spark.createDataFrame([("a", "ACGT", "!+5?"), ("b", "", "")], "read_id string, seq string, qual string")
    for backwards, want in ((False, ("a", "ACGT", "!+5?")), (True, ("a", "TGCA", "?5+!"))):
        reads.write_fastq(calls, str(tmp_path / f"fq{backwards}"), backwards)
        assert [(r.read_id, r.seq, r.qual) for r in text.read_fastq(spark, str(tmp_path / f"fq{backwards}")).collect()] == [want]
    acc = spark.createDataFrame([("x", 0, 30, 2, 4, 0.8, 0.7)], "query string, reference_start int, reference_end int, insertion int, deletion int, coverage double, accuracy double")
    reads.write_samacc(acc, str(tmp_path / "x.samacc"))
    assert [(r.read_id, r.aligned_length) for r in text.read_alignment_summary(spark, str(tmp_path / "x.samacc")).collect()] == [("x", 28)]
    assert [json.loads(r.value) for r in reads.to_json_lines(params.where("UUID = 'a'")).collect()] == [{"UUID": "a", "trim_start": 1, "shift": 2.5}]


def test_summary_report(spark, tmp_path):
    rows = [(f"q{k % 4}", a, 2e5) for k, a in enumerate((0.8, 0.91, 0.95, 0.95, 0.99))]
    df = spark.createDataFrame(rows, "query string, accuracy double, information double")
    found = alignment.summary(df, read="query")
    mode = alignment.kernel_mode(df, F.col("accuracy")).first().mode
    reads.write_summary(alignment.summary_text(found, mode, "x"), str(tmp_path / "x.summary"))
    (part,) = (tmp_path / "x.summary").glob("part-*")
    lines = part.read_text().splitlines()
    assert lines[1] == "Number of mapped reads: 4" and lines[2] == "Mean accuracy: 0.92000" and lines[3] == f"Mode accuracy: {mode:.5f}"
    assert lines[6].split() == [f"{v:.5f}" for v in np.percentile([r[1] for r in rows], (5, 25, 50, 75, 95))]
    assert lines[7:10] == ["Proportion with accuracy >90%: 0.80000", "Number with accuracy >90%: 4", "CIscore (Mbits): 1.00000"]
    none = alignment.summary_text(alignment.summary(df.where("accuracy > 2"), read="query"), None, "x").orderBy("line").collect()
    assert [r.value for r in none][1] == "No sequences mapped"


def test_kernel_mode_is_the_maximum(spark):
    rng = np.random.default_rng(8)
    v = np.clip(np.concatenate([rng.normal(0.9, 0.03, 300), rng.normal(0.6, 0.02, 120)]), 0, 1)
    h = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(0.85, 0.95, 100_001)
    want = grid[np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(1).argmax()]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert alignment.kernel_mode(df, F.col("v")).first().mode == pytest.approx(want, abs=1.5e-6)
    assert alignment.kernel_mode(df.limit(1), F.col("v")).first().mode == pytest.approx(v[0])
    assert alignment.kernel_mode(df.where("v > 3"), F.col("v")).first().mode is None


def test_path_tables(spark, tmp_path):
    """Eight columns a sample, a header a read; samples off the reference keep empty columns."""
    refs = spark.createDataFrame([("a", "ACN"), ("b", "G"), ("e", "")], "read_id string, seq string")
    ids = spark.createDataFrame([("a",), ("b",), ("e",), ("z",)], "read_id string")
    met = squiggle.matched(ids, refs)
    assert {r.read_id: r.error for r in met.collect()} == {"a": None, "b": None, "e": "reference is empty", "z": "reference not found"}
    rng = np.random.default_rng(1)
    kernel, bias = rng.normal(size=(3, 3, 3)), rng.normal(size=3)
    found = squiggle.levels(met.where("error IS NULL"), kernel, bias)
    at = {**{b: np.array(c) for b, c in squiggle.CORNERS.items()}, "N": np.zeros(3)}
    for r in found.collect():
        seq = {"a": "ACN", "b": "G"}[r.read_id]
        want = bias + sum(kernel[:, :, k] @ at[seq[r.pos + k - 1]] for k in range(3) if 0 <= r.pos + k - 1 < len(seq))
        assert np.allclose((r.current, r.logsd, r.rate), want) and r.base == seq[r.pos]
    path = spark.createDataFrame([("a", 0, 0.5, -1), ("a", 1, 0.25, 0), ("a", 2, 1.5, 2), ("b", 0, -0.5, 0)], "read_id string, i long, signal double, pos long")
    table = squiggle.path_table(path, found)
    scores = spark.createDataFrame([("a", -3.5), ("b", 2.0)], "read_id string, score double")
    reads.write_path_tables(squiggle.table_lines(table, scores), str(tmp_path / "t"))
    lines = [line.split("\t") for p in sorted((tmp_path / "t").glob("part-*")) for line in p.read_text().splitlines()]
    assert [x[0] for x in lines] == ["#a -3.5", "a", "a", "a", "#b 2.0", "b"] and {len(x) for x in lines} == {1, 8}
    assert lines[1][:5] == ["a", "0", "0.5", "-1", ""] and lines[2][4] == "A" and lines[3][4] == "N"


def test_rows_of_a_regression_that_do_not_count(spark):
    rows = [(float(k), 2.0 * k + 1) for k in range(30)] + [(5.0, 400.0), (None, 1.0), (1.0, None), (float("nan"), 1.0), (2.0, float("inf"))]
    slope, level = alignment.huber_fit(spark.createDataFrame(rows, "x double, y double"), "x", "y")
    assert slope == pytest.approx(2, abs=0.02) and level == pytest.approx(1, abs=0.3)
