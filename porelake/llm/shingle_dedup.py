"""Near-duplicates by SimHash and the Jaccard similarity of word shingles: operator 4 as the corpus
pipeline uses it (``simhash_dedup.one_per_class``).

Two documents are linked if their sets of ``words_in``-word shingles have a similarity of at least
``similarity``; linked ones form classes. The steps are those of operator 4. Fingerprints of 512 bits
are filed under blocks of their bits, buckets are compared bit-sliced with carry-save counters, and
cells of pairs beyond the radius are abandoned. The exact similarity decides about pairs that are near.

At 0.8 two fingerprints differ in up to 19 of 100 bits, so blocks of which one must be equal by the
pigeonhole rule would be 4 bits wide and select nothing. So more and wider blocks are used than that
rule needs: ``blocks_for`` gives their width, which grows with the logarithm of the number of sets, so
that a block's buckets stay small, and so many blocks that a pair that agrees in AGREES of its bits
shares none with probability MISSED. TOGETHER blocks form a family, with all but OWN_BITS bits of each in
common, and a fingerprint travels once for a family: its buckets are found where the family meets. Families
with a crowded bucket are filed bucket by bucket. A bit of the fingerprints of a pair at 0.8 differs with probability
0.15 to 0.17 (0.19 for sets of 4 and 5 shingles). Buckets are compared by the first SCREEN words, whose
radius, 60 of 192 bits, is four standard deviations away or more; the whole fingerprints of pairs that
are near there have to be within 126 of 512 bits, or 150 where a set has under 24 shingles.

No bucket is cut short. In a crowded one all documents are first compared with its first, which then
leaves it; a crowded bucket whose documents form one class is settled. That is repeated while very many
pairs are left, and what is left is cut into tiles by documents, of which each two meet. A bucket gives
its near pairs as rows, or, where they are more than its rows, a forest with the same components, one for
all such buckets that are compared at once.

The components of near pairs are the groups in which sets travel, so each text does so once, if its
group is small; a large one is cut into tiles by shingles, and each two of them meet. There the whole
fingerprints are compared bit-sliced, and the sets of those within the radius; only links that connect
classes leave a task. All pairs of a group are compared by the same rule.

Equal sets are one row before anything is compared, so exact copies cost nothing.

Defined results: texts without words, nulls among them, have the empty set, and form one class. Of
each class one row stays: the smallest doc_id, then set and text in a hash's order. A null doc_id
stays only if all ids of its class are null. Very long texts are hashed in chunks of shingles. An
empty table gives no rows. All columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from porelake.llm._blocks import scramble
from porelake.llm._graph import components
from porelake.llm._shared import map_batches, materialize, plain_names, slices
from porelake.llm.simhash_dedup import forest, near_in_groups, near_pairs, shingle_hashes

OWN = [StructField("_near_row", LongType()), StructField("_near_set", BinaryType()), StructField("_near_n", IntegerType()), StructField("_near_fp", ArrayType(LongType()))]
WORDS = 8  # 64-bit words of a fingerprint
RADIUS, NARROW, MANY = 150, 126, 24  # of 64 * WORDS bits; the narrow one for two sets of that many shingles
SCREEN, SCREEN_RADIUS = 3, 60  # words of a fingerprint that travel with a filed row, and the radius of their bits
AGREES, MISSED = 0.84, 7e-5
OWN_BITS, TOGETHER = 7, 6  # bits a block has for itself, and blocks of a family: they share their other bits
MOST = 2048  # rows of a bucket that is not crowded
TILE_ROWS = 4096  # rows of a tile of a crowded bucket
SWEEP = 1 << 16  # filed rows that a task compares at once, if no group has more
EDGES = 1 << 20  # near pairs that a task holds before it makes a forest of them
SLICE = 1000  # rows that a task hashes and hands on at once
TILE = 1 << 19  # shingles of a tile of a bucket
PAIRS_A_TASK = 4096  # pairs of texts that a task compares
PAIRS_A_ROW = 1  # a bucket of more near pairs than this times its rows gives a forest; first documents go on while more are left


def shingle_set(text: str | None, words_in: int) -> np.ndarray:
    """The hashes of the distinct shingles, sorted."""
    return np.unique(np.array(shingle_hashes(text or "", words_in), np.uint64))


def fingerprint(hashes: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """WORDS words of 64 bits; a bit is 1 if it is set in over half of the set's hashes."""
    if not len(hashes):
        return np.zeros(WORDS, np.int64)
    marks = scramble(np.arange(1, WORDS + 1, dtype=np.uint64))
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), chunk):
        bits = np.unpackbits(scramble(hashes[at : at + chunk, None] ^ marks).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def bits_of(bits: int) -> tuple[int, int]:
    """Of a block's bits: those it shares with the other blocks of its family, and its own."""
    return max(0, bits - OWN_BITS), min(bits, OWN_BITS)


def blocks_for(n: int) -> tuple[int, int]:
    """(blocks, bits of a block) for n sets: a bucket of a block gets 128 to 256 of them, or fewer."""
    bits = max(11, n.bit_length() - 8)
    shared, own = bits_of(bits)
    meet = AGREES**shared * (1 - (1 - AGREES**own) ** TOGETHER)  # in a bucket of a family
    return TOGETHER * math.ceil(math.log(MISSED) / math.log(1 - meet)), bits


def block_parts(fps: np.ndarray, blocks: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint and family: the shared bits, and the own bits of each of its blocks. Families
    follow each other in permutations of the bits; blocks of one have no bit but the shared ones in common."""
    rng, width, (shared, own) = np.random.default_rng(42), 64 * WORDS, bits_of(bits)
    families, span = -(-blocks // TOGETHER), shared + TOGETHER * own
    places = np.concatenate([rng.permutation(width)[: width // span * span] for _ in range(-(-families // (width // span)))])[: families * span]
    ones = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")[:, places].reshape(len(fps), families, span)
    rest = ones[:, :, shared:].reshape(len(fps), families, TOGETHER, own)
    return ones[:, :, :shared] @ (1 << np.arange(shared, dtype=np.int64)), rest @ (1 << np.arange(own, dtype=np.int64))


def block_keys(fps: np.ndarray, blocks: int, bits: int) -> np.ndarray:
    """The buckets of each fingerprint: number and bits of each block, the shared bits lowest."""
    first, rest = block_parts(fps, blocks, bits)
    return (first[:, :, None] | rest << bits_of(bits)[0]).reshape(len(fps), -1)[:, :blocks] + (np.arange(blocks) << bits)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The buckets of one set's fingerprint, for so many blocks of so many bits."""
    return block_keys(fingerprint(hashes).reshape(1, WORDS), bands, rows)[0]


def signed_rows(docs: DataFrame, words_in: int) -> DataFrame:
    """The documents with a number of the row, a digest of the set, its size and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in (part for whole in batches for part in slices(whole, SLICE)):
            sets = [shingle_set(t.as_py(), words_in) for t in b.column("text")]
            own = [
                pa.array(np.arange(at, at + b.num_rows)),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([fingerprint(s) for s in sets], pa.list_(pa.int64())),
            ]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, *(f.name for f in OWN)])

    return map_batches(docs, run, StructType([*docs.schema.fields, *OWN]))


def filed(sets: DataFrame, blocks: int, bits: int) -> DataFrame:
    """(id, n, bucket, fp0...): a row for each block of a set's fingerprint. sets: (id, n, fp)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)):
                fps = b.column("fp").flatten().to_numpy().reshape(-1, WORDS)
                again = np.repeat(np.arange(len(fps)), blocks)
                head = {f"fp{k}": fps[again, k] for k in range(SCREEN)}
                yield pa.record_batch({"id": b.column("id").to_numpy()[again], "n": b.column("n").to_numpy()[again], "bucket": block_keys(fps, blocks, bits).ravel(), **head})

    return map_batches(sets.where("n > 0").select("id", "n", "fp"), run, "id long, n int, bucket long, " + ", ".join(f"fp{k} long" for k in range(SCREEN)))


def families_of(sets: DataFrame, blocks: int, bits: int) -> DataFrame:
    """(id, n, family, own, fp0...): a row for each family of blocks, its number and shared bits, and the
    blocks' own bits. ``bucket_in`` gives the buckets of such a row, as ``filed`` has them. sets: (id, n, fp)"""
    shared, own = bits_of(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)):
                fps = b.column("fp").flatten().to_numpy().reshape(-1, WORDS)
                first, rest = block_parts(fps, blocks, bits)
                again = np.repeat(np.arange(len(fps)), first.shape[1])
                keys = {"family": ((np.arange(first.shape[1]) << shared) + first).ravel(), "own": (rest << own * np.arange(TOGETHER)).sum(axis=2).ravel()}
                yield pa.record_batch({"id": b.column("id").to_numpy()[again], "n": b.column("n").to_numpy()[again], **keys, **{f"fp{k}": fps[again, k] for k in range(SCREEN)}})

    return map_batches(sets.where("n > 0").select("id", "n", "fp"), run, "id long, n int, family long, own long, " + ", ".join(f"fp{k} long" for k in range(SCREEN)))


def bucket_in(family, own_bits, j: int, bits: int):
    """The bucket of a family's block j, of arrays as of columns."""
    (shared, own), by = bits_of(bits), lambda x, k: F.call_function("shiftright", x, F.lit(k)) if isinstance(x, Column) else x >> k
    low = lambda x, k: x % (1 << k)
    return (by(family, shared) * TOGETHER + j) * (1 << bits) + low(by(own_bits, own * j), own) * (1 << shared) + low(family, shared)


def family_in(bucket: Column, bits: int) -> Column:
    """The family of a bucket."""
    shared = bits_of(bits)[0]
    return F.floor(F.call_function("shiftright", bucket, F.lit(bits)) / TOGETHER) * (1 << shared) + bucket % (1 << shared)


def among(rows: DataFrame, ids: DataFrame, name: str = "id", most_bits: int = 1 << 26) -> Callable[[bool], DataFrame]:
    """``among(rows, ids)(True)``: the rows whose id is among the ids, and a few more; (False): those whose
    id is not, without a few. A table of the ids' bits (at most ``most_bits``, 8 MB: of more ids fewer are
    told apart, none is missed) is a value of the filter, so rows with texts stay where they are."""
    spark, bits, n = rows.sparkSession, 1 << 12, ids.count()
    while bits < min(most_bits, 64 * n):
        bits *= 2
    place = F.xxhash64(F.col(name).cast("long")).bitwiseAND(F.lit(bits - 1))
    at = lambda c: F.call_function("shiftright", c, F.lit(6))
    bit = lambda c: c.bitwiseAND(F.lit(63)).cast("int")
    words = ids.select(place.alias("p")).groupBy(at(F.col("p")).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("p")))).alias("w"))
    whole = spark.range(bits // 64).join(words, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")))).alias("t"))
    table = materialize(whole.select(F.transform("t", lambda r: r["w"]).alias("t")), "ids-bits")
    hit = F.getbit(F.get(table.scalar(), at(place).cast("int")), bit(place)) == 1
    return lambda wanted: rows.where(hit if wanted else ~hit)


def similar(pairs: DataFrame, texts: DataFrame, words_in: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts' sets reach the similarity. texts: (id, text)"""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = materialize(among(texts, ids)(True), "shingles-candidates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        size = 0

        def set_of(row: int, text: pa.Scalar) -> np.ndarray:
            nonlocal known, size
            if row not in known:
                if size > 1 << 20:
                    known, size = {}, 0
                known[row] = shingle_set(text.as_py(), words_in)
                size += len(known[row])
            return known[row]

        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (x, y, tx, ty) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("text_a"), b.column("text_b"))):
                s, t = set_of(x, tx), set_of(y, ty)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep[k] = both >= similarity * (len(s) + len(t) - both) - 1e-9
            yield pa.record_batch({"a": b.column("a"), "b": b.column("b")}).filter(pa.array(keep))

    # dealt by b: a first document of very many pairs is spread, and AQE splits its join
    tasks = max(1, -(-pairs.count() // PAIRS_A_TASK))
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").repartition(tasks, "b")
    rows = rows.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return materialize(map_batches(rows.select("a", "b", "text_a", "text_b"), run, "a long, b long"), "shingles-links")


def within_radius(pairs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fingerprints are within the radius. fingerprints: (id, n, fp)"""
    differing = reduce(lambda x, y: x + y, [F.bit_count(F.col("fp_a")[k].bitwiseXOR(F.col("fp_b")[k])) for k in range(WORDS)])
    at = [fingerprints.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("fp").alias(f"fp_{c}")) for c in "ab"]
    radius = F.when(F.least("n_a", "n_b") >= MANY, NARROW).otherwise(RADIUS)
    return pairs.join(at[0], "a").join(at[1], "b").where(differing <= radius).select("a", "b")


def connecting(ids: np.ndarray, classes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], fingerprints: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (smaller id, larger id) that join all classes which similar sets of different classes
    connect; none that earlier ones imply. With two sides, only sets of different sides are compared.
    Pairs come from a bit-sliced comparison of the fingerprints; the sets of those near are compared."""
    label, many = np.unique(classes, return_inverse=True, return_counts=True)[1:]
    order = np.lexsort((label, many[label]))  # the largest class last: its sets are not compared with each other
    ids, sides, label, sets, fingerprints = ids[order], sides[order], label[order], [sets[k] for k in order], fingerprints[order]
    sizes = np.array([len(s) for s in sets])
    links, two = [], sides.min() < sides.max()
    for i, j in near_pairs(fingerprints, RADIUS, queries=int((label != label[-1]).sum())):
        fits = (label[i] != label[j]) & (np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9)
        if two:
            fits &= sides[i] != sides[j]
        i, j = i[fits], j[fits]
        narrow = np.minimum(sizes[i], sizes[j]) >= MANY
        fits = ~narrow
        fits[narrow] = np.bitwise_count(fingerprints[i[narrow]] ^ fingerprints[j[narrow]]).sum(axis=1) <= NARROW
        for x, y in zip(i[fits].tolist(), j[fits].tolist()):
            if label[x] != label[y]:  # links found before may have joined them
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both >= similarity * (sizes[x] + sizes[y] - both) - 1e-9:
                    links.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
                    label[label == label[y]] = label[x]
    return links


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of rows that follow each other and have equal keys, one at a time."""
    at, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        values = np.stack([b.column(k).to_numpy() for k in keys])
        starts = np.flatnonzero(np.r_[True, (values[:, 1:] != values[:, :-1]).any(axis=0)]).tolist()
        for start, end in zip(starts, [*starts[1:], b.num_rows]):
            key = values[:, start].tolist()
            if key != at and parts:
                yield pa.Table.from_batches(parts)
                parts = []
            at = key
            parts.append(b.slice(start, end - start))
    if parts:
        yield pa.Table.from_batches(parts)


def links_in_tiles(open_: DataFrame, fingerprints: DataFrame, texts: DataFrame, words_in: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect the classes of each bucket as its similar sets do. A bucket is cut
    into tiles of some TILE shingles; each two of its tiles meet in a group, where fingerprints are
    compared bit-sliced, and sets where they are near; only connecting links leave. open_: (bucket, id,
    n, class); fingerprints: (id, n, fp); texts: (id, text)"""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, SLICE)):
            yield pa.record_batch({"id": b.column("id"), "hashes": pa.array([shingle_set(t.as_py(), words_in).tobytes() for t in b.column("text")], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ("bucket", "x", "y")):
            sets = [np.frombuffer(h, np.uint64) for h in t.column("hashes").to_pylist()]
            fps = t.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
            found = connecting(*(t.column(c).to_numpy() for c in ("id", "class", "tile")), sets, fps, similarity)
            yield pa.record_batch({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    sets = materialize(map_batches(among(texts, open_.select("id").distinct())(True).select("id", "text"), hashed, "id long, hashes binary"), "shingles-hashes")
    tiles = open_.groupBy("bucket").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"))
    dealt = open_.join(tiles, "bucket").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("bucket", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "id", "class")
    sorted_ = dealt.join(sets, "id").join(fingerprints.select("id", "fp"), "id").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return map_batches(sorted_, run, "a long, b long")


def heads_near(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the first of a bucket and each row near it. rows: (id, n, class, fp0...), and the same of the
    first one as head, head_n, head_class, head_fp0..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, first, group = np.unique(b.column("head").to_numpy(), return_index=True, return_inverse=True)
            order = np.argsort(group, kind="stable")
            fps, head_fps = (np.stack([b.column(f"{c}fp{k}").to_numpy() for k in range(SCREEN)], axis=1) for c in ("", "head_"))
            sizes = np.bincount(group, minlength=len(heads))
            starts = np.cumsum(sizes) - sizes
            whole = np.insert(fps[order], starts, head_fps[first], axis=0)  # each group begins with its head
            at = np.insert(order, starts, -1)
            found = [at[j] for _, j in near_in_groups(whole.view(np.uint64), sizes + 1, np.ones(len(heads), np.int64), SCREEN_RADIUS)]
            near = b.take(pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
            yield pa.record_batch({"a": near.column("head"), "b": near.column("id")})

    sizes_fit = F.least("n", "head_n") >= similarity * F.greatest("n", "head_n") - 1e-9
    return map_batches(rows.where(sizes_fit & (F.col("class") != F.col("head_class"))), run, "a long, b long")


def near_in(t: pa.Table, similarity: float) -> pa.RecordBatch:
    """(a, b, few) of the groups (bucket, x, y) that follow each other: see ``near_of_groups``. The forest of
    all groups that have many pairs is one, of smallest ids, so that other tasks' forests have the same edges."""
    same = np.logical_and.reduce([t.column(c).to_numpy()[1:] == t.column(c).to_numpy()[:-1] for c in ("bucket", "x", "y")])
    t = t.filter(pa.array(np.r_[False, same] | np.r_[same, False]))  # a row alone has no pair
    bucket, x, y, tile, ids, n, classes = (t.column(c).to_numpy() for c in ("bucket", "x", "y", "tile", "id", "n", "class"))
    fps = np.stack([t.column(f"fp{k}").to_numpy() for k in range(SCREEN)], axis=1).view(np.uint64)
    group = np.cumsum(np.r_[np.zeros(min(1, len(ids)), bool), (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    sizes = np.bincount(group)
    asks = sizes.copy()
    if (classes != ids).any():  # rows of a group's largest class come last: they are not compared with each other
        order = np.lexsort((classes, group))
        new = np.r_[True, np.diff(group[order]) + np.abs(np.diff(classes[order])) != 0]
        many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        order = order[np.lexsort((classes[order], many, group[order]))]
        last = order[np.cumsum(sizes) - 1]
        bucket, x, y, tile, ids, n, classes, fps = bucket[order], x[order], y[order], tile[order], ids[order], n[order], classes[order], fps[order]
        asks -= np.bincount(group, classes == np.repeat(t.column("class").to_numpy()[last], sizes)).astype(np.int64)
    names, own = np.unique(ids, return_inverse=True)
    pairs, many, left = [], [], PAIRS_A_ROW * sizes

    def tree() -> tuple[np.ndarray, np.ndarray]:
        root = forest(len(names), *map(np.concatenate, zip(*many)))
        moved = np.flatnonzero(root != np.arange(len(names)))
        return root[moved], moved

    for i, j in near_in_groups(fps, sizes, asks, SCREEN_RADIUS):
        fits = (classes[i] != classes[j]) & ((x[i] == y[i]) | (tile[i] != tile[j])) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
        i, j = i[fits], j[fits]
        left = left - np.bincount(group[i], minlength=len(sizes))
        few = left[group[i]] >= 0
        pairs.append((i[few], j[few]))
        many.append((own[i[~few]], own[j[~few]]))
        if sum(len(i) for i, _ in many) > EDGES:
            many = [tree()]
    nothing = np.zeros(0, np.int64)
    i, j = map(np.concatenate, zip((nothing, nothing), *pairs))
    few = left[group[i]] >= 0
    many.append((own[i[~few]], own[j[~few]]))
    found = np.sort(np.stack([own[i[few]], own[j[few]]], axis=1), axis=1)
    found = np.unique(found[:, 0] * len(names) + found[:, 1])  # blocks of a family find the same pairs
    parts = [divmod(found, max(1, len(names))), tree()]
    i, j = map(np.concatenate, zip(*parts))
    return pa.record_batch({"a": names[i], "b": names[j], "few": np.arange(len(i)) < len(found)})


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[pa.Table]:
    """Batches that are sorted by keys as tables of whole groups, of about so many rows."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            same = np.logical_and.reduce([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in keys])
            cut = int(same.argmax())
            if cut:
                yield t.slice(0, cut)
            held, size = t.slice(cut).to_batches(), t.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


def near_of_groups(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b, few): of each group (bucket, x, y) the near pairs of different classes; where they are more than
    PAIRS_A_ROW times its rows, not few, a forest with their components. Where x < y only pairs of
    different tiles count. rows: (bucket, x, y, tile, id, n, class, fp0...)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ("bucket", "x", "y"), SWEEP):
            yield near_in(t, similarity)

    sorted_ = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return map_batches(sorted_, run, "a long, b long, few boolean")


def near_of_families(rows: DataFrame, bits: int, similarity: float) -> DataFrame:
    """The same of the buckets of families: all of a family meet in one task, so a fingerprint travels once
    for its blocks. rows: as ``families_of`` gives them"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ("family",), SWEEP // TOGETHER):
            family, own = t.column("family").to_numpy(), t.column("own").to_numpy()
            bucket = np.concatenate([bucket_in(family, own, j, bits) for j in range(TOGETHER)])
            order = np.argsort(bucket, kind="stable")
            again, zeros = order % len(family), np.zeros(len(order), np.int32)
            cols = {c: t.column(c).to_numpy()[again] for c in ("id", "n", *(f"fp{k}" for k in range(SCREEN)))}
            yield near_in(pa.table({"bucket": bucket[order], "x": zeros, "y": zeros, "tile": zeros, "class": cols["id"], **cols}), similarity)

    return map_batches(rows.repartition("family").sortWithinPartitions("family"), run, "a long, b long, few boolean")


def roots_of(keyed: DataFrame, fingerprints: DataFrame, texts: DataFrame, words_in: int, similarity: float, rounds: int = 3, families: DataFrame | None = None, bits: int = 0) -> DataFrame:
    """(id, root) of the ids that have links. keyed: (id, n, bucket), and fp0... as ``filed`` gives them;
    fingerprints: (id, n, fp); texts: (id, text); families: the same buckets as ``families_of`` gives them,
    for all families that have no crowded one"""
    head = [f"fp{k}" for k in range(SCREEN)]
    if head[0] not in keyed.columns:
        keyed = keyed.join(fingerprints.select("id", *[F.col("fp")[k].alias(c) for k, c in enumerate(head)]), "id")
    links, tried, roots = None, None, None

    def compare(pairs: DataFrame) -> DataFrame:
        nonlocal links, tried
        near = within_radius(pairs.distinct(), fingerprints)
        near = materialize(near if tried is None else near.join(tried, ["a", "b"], "left_anti"), "shingles-pairs")
        found = similar(near, texts, words_in, similarity)
        links, tried = (found, near) if links is None else (links.unionByName(found), tried.unionByName(near))
        return components(links).select(F.col("node").alias("id"), "root")

    buckets = keyed
    if families is not None:
        buckets = families.select(F.explode(F.array(*[bucket_in(F.col("family"), F.col("own"), j, bits) for j in range(TOGETHER)])).alias("bucket"))
    crowded = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > MOST), "shingles-crowded")
    rows = keyed.withColumn("class", F.col("id")).withColumns({c: F.lit(0) for c in ("x", "y", "tile")})
    alone = crowded.isEmpty()
    if families is not None and not alone:
        mixed = materialize(crowded.select(family_in(F.col("bucket"), bits).alias("family")).distinct(), "shingles-families")
        families = families.join(mixed, "family", "left_anti")
        rows = rows.join(mixed, family_in(F.col("bucket"), bits) == F.col("family"), "left_semi")
    if not alone:
        open_ = materialize(keyed.join(crowded.select("bucket"), "bucket").withColumn("class", F.col("id")), "shingles-filed")
        filed_rows = open_.count()
        for _ in range(rounds):
            first = [F.min_by(c, "id").alias(f"head_{c}") for c in ("n", "class", *head)]
            heads = materialize(open_.groupBy("bucket").agg(F.min("id").alias("head"), *first), "shingles-heads")
            rest = open_.join(heads, "bucket").where("id <> head")
            roots = compare(materialize(heads_near(rest, similarity), "shingles-near"))
            rest = rest.select("bucket", "id", "n", *head).join(roots, "id", "left").select("bucket", "id", "n", *head, F.coalesce("root", "id").alias("class"))
            rest = materialize(rest, "shingles-rest")
            mixed = rest.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most")
            open_ = materialize(rest.join(mixed.select("bucket"), "bucket", "left_semi"), "shingles-open")
            each = open_.groupBy("bucket", "class").agg(F.count("*").cast("double").alias("m")).groupBy("bucket").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("pairs"))
            if (each.agg(F.sum("pairs") / 2).first()[0] or 0) <= PAIRS_A_ROW * filed_rows:
                break
        tiles = open_.groupBy("bucket").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("tiles"))
        dealt = open_.join(tiles, "bucket").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.withColumns({"x": F.least("tile", "other"), "y": F.greatest("tile", "other")}).select(rows.columns)
        rows = rows.join(crowded.select("bucket"), "bucket", "left_anti").unionByName(dealt)
    near = None if families is not None and alone else near_of_groups(rows, similarity)
    if families is not None:
        apart = near_of_families(families, bits, similarity)
        near = apart if near is None else near.unionByName(apart)
    near = materialize(near, "shingles-near")
    few = within_radius(near.where("few").select("a", "b").distinct(), fingerprints)
    groups_of = components(few.unionByName(near.where("NOT few").select("a", "b")))
    open_ = groups_of.select(F.col("root").alias("bucket"), F.col("node").alias("id")).join(fingerprints.select("id", "n"), "id")
    open_ = open_.withColumn("class", F.col("id")) if roots is None else open_.join(roots, "id", "left").withColumn("class", F.coalesce("root", "id")).drop("root")
    found = links_in_tiles(materialize(open_, "shingles-open"), fingerprints, texts, words_in, similarity)
    found = materialize(found, "shingles-tiles")
    return components(found if links is None else links.unionByName(found)).select(F.col("node").alias("id"), "root")


def one_per_class(docs: DataFrame, words_in: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of near-duplicates, all columns. Only the rows that go are joined to the
    documents; Spark broadcasts them if they are few, and their number is known by then."""
    row, digest = F.col("_near_row"), F.col("_near_set")
    docs, back = plain_names(docs, ("doc_id", "text"))
    every = materialize(signed_rows(docs, words_in), "shingles-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), digest.alias("set"), F.xxhash64("text").alias("text"), row.alias("row"))
    own = F.struct(F.col("_near_n").alias("n"), F.col("_near_fp").alias("fp"))
    sets = materialize(every.groupBy(digest.alias("digest")).agg(F.min(row).alias("id"), F.min(rank).alias("best"), F.min_by(own, row).alias("own")), "shingles-sets")
    reps = sets.select("id", "own.n", "own.fp")
    blocks, bits = blocks_for(reps.count())
    keyed, families = filed(reps, blocks, bits), families_of(reps, blocks, bits)
    roots = roots_of(keyed, reps, every.select(row.alias("id"), "text"), words_in, similarity, families=families, bits=bits)
    classes = sets.join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("best").alias("best"))
    kept = classes.select(F.col("best.row").alias("kept"))
    gone = materialize(every.select("_near_row").join(kept, row == F.col("kept"), "left_anti"), "shingles-gone")
    found = among(every.select(*docs.columns, "_near_row"), gone, "_near_row")
    return found(False).unionByName(found(True).join(gone, "_near_row", "left_anti")).select(docs.columns).transform(back)
