"""Operator 4: SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint takes the majority of each bit over the XXH64 hashes of its word shingles.
Fingerprints that differ in at most ``radius`` bits are linked, and linked ones form classes.

Candidates come from the pigeonhole rule: of ``radius + 1`` blocks of bits one must be equal, so a
fingerprint is filed under each block's value. A bucket of more than ``most`` fingerprints is filed
anew, each time under the blocks of the bits that do not yet agree; since fingerprints are distinct,
this ends, and no bucket is ever cut short. Buckets are then compared bit-sliced: bit planes lie
vertically (bit p of 64 fingerprints in one word), one sweep over the planes updates the distances of
64 x 64 pairs per word with carry-save counters, and a block is abandoned once all its pairs exceed
the radius. Only the edges of a spanning forest leave a task, never all pairs.

Equal fingerprints are one row before anything is compared, so exact copies cost nothing.

Defined results: texts without words, nulls among them, have fingerprint zero and are linked like
any other. Repeated rows stay rows and share a class. A null doc_id is kept but never names a class
unless all ids of the class are null. Very long texts: the hashes of their shingles are held, 8 bytes
each, and bits are counted in chunks. An empty table gives no rows. Further columns are ignored, and
kept by ``one_per_class``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porelake.llm._graph import components
from porelake.llm._shared import id_and_text, materialize, table

BITS = 64
ROWS_A_TASK = 1 << 20  # filed fingerprints; more of them make more tasks


def shingle_hashes(text: str, words_in: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of the text, repeats included; ASCII letters in lower case."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - words_in + 1)
    starts, ends = [0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends)]


def majority(hashes: list[int], chunk: int = 20_000) -> int:
    """Bit p is 1 if it is set in over half of the hashes."""
    if not hashes:
        return 0
    h = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(h[i : i + chunk], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), chunk))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_in: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [majority(shingle_hashes(t.as_py() or "", words_in, seed)) for t in b.column("text")]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def bit_blocks(mask: int, parts: int) -> list[int]:
    """Masks of ``parts`` nearly equal runs of the bits in ``mask``."""
    bits = [p for p in range(BITS) if mask >> p & 1]
    return [sum(1 << p for p in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within_radius(fps: np.ndarray, radius: int, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) at most ``radius`` bits apart; tiles of ``tile`` queries over all planes."""
    found = list(near_pairs(fps.reshape(-1, 1), radius, tile=tile))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def near_pairs(fps: np.ndarray, radius: int, queries: int | None = None, tile: int | None = None, cells: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of rows of words at most ``radius`` bits apart, those of some queries at a time:
    tiles of queries over all bit planes, about ``cells`` words of counters in each. i is below ``queries``."""
    n, width = fps.shape
    words = -(-n // BITS)
    bits = np.zeros((words * BITS, 8 * width), np.uint8)
    bits[:n] = np.ascontiguousarray(fps).view(np.uint8).reshape(n, 8 * width)
    planes = np.packbits(np.ascontiguousarray(np.unpackbits(bits, axis=1, bitorder="little").T), axis=1, bitorder="little").view(np.uint64)
    valid = np.packbits(np.arange(words * BITS) < n, bitorder="little").view(np.uint64)
    counters, tile = max(1, int(radius).bit_length()), tile or max(BITS, cells // max(1, words))
    n_planes = BITS * width
    for q in range(0, n if queries is None else min(n, queries), tile):
        ask = fps[q : q + tile]
        w0 = q // BITS  # pairs with earlier words were seen from the other side
        live = np.arange(len(ask))
        sums = [np.zeros((len(ask), words - w0), np.uint64) for _ in range(counters)]
        over = np.broadcast_to(~valid[w0:], (len(ask), words - w0)).copy()
        for p in range(n_planes):
            flip = -((ask[live, p // BITS] >> np.uint64(p % BITS)) & np.uint64(1))  # all ones where the query's bit is set
            carry = planes[p, w0:][None, :] ^ flip[:, None]
            for s in sums:  # carry-save addition of one bit to every pair's distance
                carry_out = s & carry
                s ^= carry
                carry = carry_out
            over |= carry
            if p == n_planes - 1 or p % 8 == 7 and p >= radius:
                over |= _above(sums, radius)
                open_ = (over != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
                if not open_.all():  # abandon the queries whose pairs all exceed the radius
                    live, over, sums = live[open_], over[open_], [s[open_] for s in sums]
                if not len(live):
                    break
        if len(live):
            near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(near)
            i, j = q + live[i], w0 * BITS + j
            keep = (i < j) & (i < (n if queries is None else queries))
            yield i[keep], j[keep]


def near_in_groups(fps: np.ndarray, sizes: np.ndarray, asks: np.ndarray, radius: int, cells: int = 1 << 14, most_words: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of rows of one group at most ``radius`` bits apart, many small groups in one
    sweep. Groups follow each other; in each the first ``asks`` rows are compared with all behind them.
    A cell is a row and the planes of 64 others; it is abandoned once all its pairs exceed the radius.
    A sweep takes ``most_words`` words of a plane, or one group; each group begins a word."""
    ends, row_ends, at = np.cumsum(-(-sizes // BITS)), np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_words, "right")))
        row = int(row_ends[at - 1]) if at else 0
        for i, j in _sweep(fps[row : row_ends[end - 1]], sizes[at:end], asks[at:end], radius, cells):
            yield row + i, row + j
        at = end


def _sweep(fps: np.ndarray, sizes: np.ndarray, asks: np.ndarray, radius: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    width, words = fps.shape[1], -(-sizes // BITS)
    row_at, word_at = np.cumsum(sizes) - sizes, np.cumsum(words) - words
    group = np.repeat(np.arange(len(sizes)), sizes)
    place = word_at[group] * BITS + np.arange(len(fps)) - row_at[group]  # each group starts a word
    bits = np.zeros((int(words.sum()) * BITS, 8 * width), np.uint8)
    bits[place] = np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), 8 * width)
    planes = np.packbits(np.ascontiguousarray(np.unpackbits(bits, axis=1, bitorder="little").T), axis=1, bitorder="little").view(np.uint64)
    row_of = np.full(len(bits), -1)
    row_of[place] = np.arange(len(fps))
    unused = np.packbits(row_of < 0, bitorder="little").view(np.uint64)
    queries = np.flatnonzero(np.arange(len(fps)) - row_at[group] < asks[group])
    first = place[queries] // BITS  # pairs with earlier words are seen from the other side
    many = word_at[group[queries]] + words[group[queries]] - first
    ends = np.cumsum(many)
    at = 0
    while at < len(queries):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + cells, "right")))
        n = many[at:end]
        q = np.repeat(queries[at:end], n)
        w = np.repeat(first[at:end] - (np.cumsum(n) - n), n) + np.arange(len(q))
        at = end
        over = unused[w]
        sums = [np.zeros(len(q), np.uint64) for _ in range(max(3, int(radius).bit_length()))]
        for p in range(0, BITS * width, 8):
            ask, x = fps[q, p // BITS], []
            for k in range(p, p + 8):  # the planes, turned over where the query's bit is set
                x.append(planes[k][w] ^ ((ask << np.uint64(BITS - 1 - k % BITS)).view(np.int64) >> 63).view(np.uint64))
            fours = []
            for k in (0, 4):
                sums[0], two = _add(sums[0], x[k], x[k + 1])
                sums[0], more = _add(sums[0], x[k + 2], x[k + 3])
                sums[1], four = _add(sums[1], two, more)
                fours.append(four)
            sums[2], carry = _add(sums[2], *fours)
            for s in sums[3:]:
                carry_out = s & carry
                s ^= carry
                carry = carry_out
            over |= carry
            if p + 8 == BITS * width or p % 16 == 8 and p >= 1.3 * radius:
                over |= _above(sums, radius)
                open_ = np.flatnonzero(over != np.uint64(0xFFFFFFFFFFFFFFFF))
                if len(open_) < len(q):
                    q, w, over, sums = q[open_], w[open_], over[open_], [s[open_] for s in sums]
                if not len(q):
                    break
        if len(q):
            cell, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = q[cell], row_of[w[cell] * BITS + bit]
            yield i[i < j], j[i < j]


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition of three words of bits: sums and carries."""
    half = a ^ b
    return half ^ c, a & b | half & c


def _above(sums: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the bit-sliced sums exceed the radius: compare from the highest bit down."""
    above = np.zeros_like(sums[0])
    equal = ~above
    for k in reversed(range(len(sums))):
        if radius >> k & 1:
            equal = equal & sums[k]
        else:
            above |= equal & sums[k]
            equal = equal & ~sums[k]
    return above


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Root (smallest index) of each of n nodes, for links i - j."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        i, j, low, high = i[open_], j[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _buckets(fps: DataFrame, radius: int, most: int) -> DataFrame:
    """(fp, bucket): every pair within the radius shares a bucket; none holds over ``most`` rows
    unless all its fingerprints agree but for a few bits."""
    parts = radius + 1
    start = [(m, ((1 << 64) - 1) ^ m) for m in bit_blocks((1 << 64) - 1, parts)]  # (bits that agree, bits that need not)
    level, done = [(fps, start)], []
    while level:
        deeper = []
        for rows, filed in level:
            keyed = rows.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), F.lit(signed(m)), F.col("fp").bitwiseAND(F.lit(signed(m)))).alias("bucket")) for n, (m, _) in enumerate(filed)])).alias("x")).select("fp", "x.n", "x.bucket")
            keyed = materialize(keyed, "simhash-filed")
            sizes = materialize(keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "simhash-sizes")
            done.append(keyed.join(sizes.where(F.col("size") <= most), "bucket").select("fp", "bucket"))
            large = sizes.where(F.col("size") > most)
            if large.isEmpty():
                continue
            crowded = materialize(keyed.join(large, "bucket").select("fp", "n"), "simhash-crowded")
            for n, (agree, rest) in enumerate(filed):
                bits = bin(rest).count("1")
                again = crowded.where(F.col("n") == n).select("fp")
                if bits <= 12:  # at most 2 ** 12 fingerprints can be left
                    done.append(again.select("fp", F.xxhash64(F.lit(n), F.lit(signed(agree)), F.col("fp").bitwiseAND(F.lit(signed(agree)))).alias("bucket")))
                else:
                    deeper.append((again, [(agree | m, rest ^ m) for m in bit_blocks(rest, parts)]))
        level = deeper
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def links(fps: DataFrame, radius: int = 2, most: int = 2048) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of distinct fingerprints within the radius."""
    spark = fps.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            x = np.unique(rows["fp"].to_numpy())
            i, j = within_radius(x.view(np.uint64), radius)
            root = forest(len(x), i, j)
            moved = np.flatnonzero(root != np.arange(len(x)))
            if len(moved):
                yield pa.record_batch({"a": pa.array(x[moved]), "b": pa.array(x[root[moved]])})

        for b in batches:  # sorted by bucket: compare whole buckets, small ones together
            held.append(b)
            size += b.num_rows
            if size >= 2 * most:
                rows = pa.Table.from_batches(held)
                last = rows["bucket"][-1].as_py()
                cut = int(np.searchsorted(rows["bucket"].to_numpy() == last, True))
                if cut:
                    for at in _cuts(rows["bucket"].to_numpy()[:cut], most):
                        yield from compare(rows.slice(*at))
                held = rows.slice(cut).to_batches()
                size = rows.num_rows - cut
        if size:
            rows = pa.Table.from_batches(held)
            for at in _cuts(rows["bucket"].to_numpy(), most):
                yield from compare(rows.slice(*at))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = materialize(_buckets(fps, radius, most), "simhash-buckets")
    n = max(n, -(-buckets.count() // ROWS_A_TASK))
    return buckets.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def _cuts(bucket: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of whole buckets, of about ``most`` rows."""
    ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
    at = 0
    while at < len(bucket):
        end = ends[max(np.searchsorted(ends, at + most, "right") - 1, np.searchsorted(ends, at, "right"))]
        yield at, int(end - at)
        at = int(end)


def classes(docs: DataFrame, radius: int = 2, words_in: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): the class of each document is its smallest doc_id."""
    rows = materialize(fingerprints(docs, words_in, seed), "simhash-fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius))
    named = materialize(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    ids = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-classes")
    of_fp = materialize(named.join(ids, "root").select("fp", "component_id"), "simhash-classes-of")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def one_per_class(docs: DataFrame, words_in: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, all columns, with one row of each class of near-duplicates, for a similarity of
    shingle sets instead of a radius. See ``shingle_dedup``, which completes the comparison of
    fingerprints: a radius that holds all pairs at 0.8 is too wide for pigeonhole blocks."""
    from porelake.llm import shingle_dedup

    return shingle_dedup.one_per_class(docs, words_in, similarity)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
