"""Operator 6: dedup of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Sorting every suffix of a corpus is out of reach, and most suffixes start nothing that repeats. So

1. every window of ``window`` bytes is stood for by its anchor, the part of ``part`` bytes with the
   smallest hash, which equal windows share. Anchors that occur in one document only are dropped;
2. the contexts of the anchors left, the bytes under the windows they stand for, meet by anchor.
   Contexts of equal bytes repeat whole in all documents but the smallest that holds one;
3. contexts of an anchor that differ, at the ends of repeats, are cut into shards: each shard gets its
   Burrows-Wheeler transform, the transforms are merged by iterative interleave refinement, and the
   intervals of rows whose common prefix is a whole window give the smallest document of each
   repeated window.

The transforms see what step 2 leaves: about a third of the different contexts and under a tenth of
the bytes that go. Transforms of all contexts would cost more than the check's limit (README).

An anchor that has very many different contexts in some block (the end of a passage that a third of
all documents hold) is not compared by contexts anywhere: its windows are sent one by one, each to
the bucket of its own hash, so only equal windows meet, once a block.

Anchors and contexts travel packed between blocks (see _blocks); texts are shuffled once, compressed.

Defined results: a null text is empty; matches never cross documents; rows that repeat a doc_id never
remove bytes from each other; a null doc_id counts as larger than any other. Documents under
``window`` bytes stay whole. A very long text is a block by itself, hashed in parts. An empty table
gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from porelake.llm import _blocks as B
from porelake.llm._bwt import repeated_intervals
from porelake.llm._shared import table

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
SYMBOLS = B.scramble(np.arange(1, 257, dtype=np.uint64))
PARTS = 1 << 18  # bytes that are hashed at a time
CONTEXT = np.dtype([("anchor", np.uint64), ("id", np.int64), ("size", np.int32)])
RANGE = np.dtype([("place", np.int32), ("lo", np.int32), ("hi", np.int32)])


def _chunks(raw: np.ndarray, lens: np.ndarray, overlap: int) -> Iterator[tuple[int, B.Windows]]:
    """(offset, windows) of parts of a block's bytes, about PARTS each: runs of documents, or pieces
    of a long one that overlap so far that no window is lost."""
    ends = np.cumsum(lens)
    d = 0
    while d < len(lens):
        start = ends[d] - lens[d]
        stop = max(d + 1, int(np.searchsorted(ends, start + PARTS, "right")))
        if lens[d] > PARTS:
            for at in range(int(start), int(ends[d]) - overlap, PARTS):
                piece = raw[at : min(at + PARTS + overlap, int(ends[d]))]
                yield at, B.Windows(SYMBOLS[piece], np.array([len(piece)]))
        else:
            yield int(start), B.Windows(SYMBOLS[raw[start : ends[stop - 1]]], lens[d:stop])
        d = stop


def _least(w: B.Windows, window: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all parts, smallest hash of each window by its start; 0 where none fits)."""
    if w.n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = w.hashes(part)
    return h, np.where(w.fit(window)[: w.n - window + 1], B.sliding(np.minimum, h, window - part + 1), np.uint64(0))


def _runs(w: B.Windows, window: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, hash) of neighbouring windows with the same smallest hash."""
    _, least = _least(w, window, part)
    if not len(least):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    new = np.concatenate([[True], least[1:] != least[:-1]])
    new |= _marks(len(least), w.starts)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    real = least[first] > 0
    return first[real], last[real], least[first][real]


def _anchors(w: B.Windows, part: int, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs with the place of their anchor, the first part of that hash in each window. Runs that
    have several such places (in texts that repeat themselves) are cut between them."""
    h = w.hashes(part)

    def place(start: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = start.copy()
        open_ = np.flatnonzero(h[at] != value)
        while len(open_):
            at[open_] += 1
            open_ = open_[h[at[open_]] != value[open_]]
        return at

    at = place(first, value)
    long = np.flatnonzero(last > at)
    if len(long):
        n = last[long] - first[long] + 1
        each = np.repeat(first[long] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner = np.repeat(long, n)
        spot = place(each, value[owner])
        new = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (owner[1:] != owner[:-1])]))
        end = np.append(new[1:], len(each)) - 1
        keep = np.ones(len(first), bool)
        keep[long] = False
        first, last, value, at = (np.concatenate([x[keep], y]) for x, y in ((first, each[new]), (last, each[end]), (value, value[owner[new]]), (at, spot[new])))
    return first, last, value, at


def _marks(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at[at < n]] = True
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Block:
    """The bytes of a block's documents, laid end to end."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.lens = ids, np.fromiter(map(len, texts), np.int64, len(texts))
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(self.lens)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")


def _anchor_values(block: int, ids: np.ndarray, texts: list[bytes], told: B.Told, buckets: int, window: int, part: int, hot: int) -> pa.Table:
    b = Block(ids, texts)
    found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]]
    for at, w in _chunks(b.raw, b.lens, window - 1):
        first, last, h = _runs(w, window, part)
        for col, x in zip(found, (h, b.owner(first + at), w.ranges(first, last + window))):
            col.append(x)
    h, owner, around = map(np.concatenate, found)
    return B.send_values(block, h, owner, buckets, around, hot)


class Contexts:
    """The anchors of a block that other documents share, with their contexts; equal contexts of an
    anchor are one group, and its smallest document stands for it."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], shared: B.Filter, buckets: int, window: int, part: int):
        b = self.block = Block(ids, texts)
        cols: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64)]
        for at, w in _chunks(b.raw, b.lens, window - 1):
            runs = _runs(w, window, part)
            keep, flags = shared.find(runs[2])
            lo, last, h, _ = _anchors(w, part, *(x[keep & (flags & B.HOT == 0)] for x in runs))
            crowded = keep & (flags & B.HOT > 0)
            one = _ranges(runs[0][crowded], (runs[1] - runs[0] + 1)[crowded])  # every window for itself
            for col, x in zip(cols, (np.concatenate([h, w.hashes(window, one)]), np.concatenate([w.ranges(lo, last + window), w.hashes(window, one, 1)]), np.concatenate([lo, one]) + at, np.concatenate([last, one]) + window + at)):
                col.append(x)
        h, c, lo, hi = map(np.concatenate, cols)
        d = b.owner(lo)
        order = np.lexsort((ids[d], c, h))
        self.d, self.lo, self.hi = d[order], lo[order], hi[order]
        first = self._equal_bytes(h[order], c[order]) if len(h) else np.zeros(0, np.int64)
        self.group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        self.first, self.least = first, ids[self.d[first]]
        self.records = np.empty(len(first), CONTEXT)
        self.records["anchor"], self.records["id"], self.records["size"] = h[order][first], self.least, (self.hi - self.lo)[first]
        self.dealt = B.Dealt((self.records["anchor"] % np.uint64(buckets)).astype(np.int64), buckets)

    def _equal_bytes(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where groups begin: neighbours with equal hashes whose bytes are equal too."""
        new = np.ones(len(h), bool)
        size = self.hi - self.lo
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (size[1:] != size[:-1])
        step = 1 << 16
        for at in range(1, len(h), step):
            pair = at + np.flatnonzero(~new[at : at + step])
            n = size[pair]
            differ = self.block.raw[_ranges(self.lo[pair], n)] != self.block.raw[_ranges(self.lo[pair - 1], n)]
            if differ.any():
                new[pair[np.unique(np.repeat(np.arange(len(pair)), n)[differ])]] = True
        return np.flatnonzero(new)

    def sent(self, block: int) -> pa.Table:
        size = (self.hi - self.lo)[self.first]
        return self.dealt.sent(block, self.records, lambda order: self.block.raw[_ranges(self.lo[self.first][order], size[order])], size)

    def gone(self, told: B.Told) -> np.ndarray:
        """Marks the bytes that a smaller document holds too."""
        size = self.hi - self.lo
        from_, to = np.zeros(len(self.first), np.int64), np.zeros(len(self.first), np.int64)
        bucket, found = told.get_records("ranges", RANGE)
        at = self.dealt.find(bucket, found["place"])
        from_[at], to[at] = found["lo"], found["hi"]
        later = self.block.ids[self.d] > self.least[self.group]  # a smaller document of this block holds all of it
        lo = self.lo + np.where(later, 0, from_[self.group])
        hi = self.lo + np.where(later, size, to[self.group])
        depth = np.zeros(len(self.block.raw) + 1, np.int32)
        np.add.at(depth, lo, 1)
        np.subtract.at(depth, hi, 1)
        return np.cumsum(depth[:-1]) > 0


def _compare(records: np.ndarray, rows: np.ndarray, data: pa.ChunkedArray, window: int, most: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of the contexts that smaller documents hold: whole contexts of equal bytes, and parts
    of different ones by merging their shards' transforms, ``most`` bytes of anchors at a time."""
    whole, ends = B._joined(data), np.cumsum(records["size"].astype(np.int64))
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(bytes(whole[a:b]), len(number)) for a, b in zip((ends - records["size"]).tolist(), ends.tolist())), np.int64, len(records))
    strings, n = list(number), len(number)
    least, anchor = np.full(n, B.LAST), np.zeros(n, np.uint64)
    np.minimum.at(least, which, records["id"])
    anchor[which] = records["anchor"]
    from_, to = np.full(n, 1 << 30), np.zeros(n, np.int64)
    order = np.argsort(anchor, kind="stable")
    heads = B.changes(anchor[order]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, n))
    several = order[np.repeat(sizes > 1, sizes)]  # contexts of anchors that have more than one
    ends_of = np.cumsum([len(strings[k]) for k in several])
    borders = np.append(B.changes(anchor[several])[1:], len(several)) if len(several) else []
    at = 0
    while at < len(several):
        before = ends_of[at - 1] if at else 0
        later = borders[borders > at]
        end = int(later[max(0, np.searchsorted(ends_of[later - 1], before + most, "right") - 1)])  # whole anchors, one at least
        some = several[at:end]
        string, offset, interval = repeated_intervals([strings[k] for k in some], window)
        if len(string):
            string = some[string]
            smallest = np.full(int(interval.max()) + 1, B.LAST)
            np.minimum.at(smallest, interval, least[string])
            hit = smallest[interval] < least[string]
            np.minimum.at(from_, string[hit], offset[hit])
            np.maximum.at(to, string[hit], offset[hit] + window)
        at = end
    lo, hi = from_[which], to[which]
    covered = records["id"] > least[which]
    lo, hi = np.where(covered, 0, lo), np.where(covered, records["size"], hi)
    found = np.flatnonzero(hi > 0)
    told = np.empty(len(found), RANGE)
    told["place"], told["lo"], told["hi"] = B.places(rows)[found], lo[found], hi[found]
    return found, told


def remove_repeats(docs: DataFrame, window: int = 50, part: int = 26, hot: int = 64, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept); kept is null unless asked for."""
    blocks, sizes = B.pack_blocks(docs, "suffixes")
    few, many = sizes.buckets(0.4), sizes.buckets()
    anchors = partial(_anchor_values, buckets=few, window=window, part=part, hot=hot)
    shared = B.answer(B.send(blocks, None, anchors), few, B.VALUE, B.shared_values, "anchors")

    def contexts(ids, texts, told) -> Contexts:
        return Contexts(ids, texts, B.Filter(told, "anchors", few), many, window, part)

    sent = B.send(blocks, shared, lambda block, ids, texts, told: contexts(ids, texts, told).sent(block))
    ranges = B.answer(sent, many, CONTEXT, partial(_compare, window=window), "ranges")

    def output(block: int, payload: bytes, told: B.Told) -> pa.Table:
        ids, texts = B.unpack(payload)
        gone = contexts(ids, texts, told).gone(told) if told else np.zeros(sum(map(len, texts)), bool)
        rows, kept_bytes, at = [], [], 0
        for text in texts:
            cut = gone[at : at + len(text)]
            at += len(text)
            removed = int(cut.sum())
            spans = int((np.diff(cut.astype(np.int8), prepend=0) == 1).sum()) if removed else 0
            out = np.frombuffer(text, np.uint8)[~cut].tobytes() if removed else text
            rows.append((len(text), removed, spans, hashlib.sha256(out).hexdigest()))
            kept_bytes.append(out if keep_text else None)
        totals, removed, spans, digests = zip(*rows) if rows else ((),) * 4
        long = pa.int64()
        return pa.table({"doc_id": pa.array(ids, long, mask=ids == B.LAST), "n_bytes": pa.array(totals, long), "n_removed": pa.array(removed, long), "n_spans": pa.array(spans, long), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept_bytes, pa.binary())})

    return B.with_answers(blocks, shared.unionByName(ranges), output, SCHEMA)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


# Bytes as pairs of hex digits, in pieces of 1,000 bytes and the 49 after them; windows that start at
# most 50 bytes apart are one span.
ORACLE_SQL = """
WITH h AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents
), pieces AS (
  SELECT doc_id, s, substr(h, 2000 * s + 1, 2098) AS part FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 1999) // 2000)) AS s FROM h)
), windows AS (
  SELECT doc_id, 1000 * s + k AS i, md5(substr(part, 2 * k + 1, 100)) AS w FROM pieces, range(1000) r(k) WHERE length(part) >= 2 * k + 100
), least AS (
  SELECT w, min(doc_id) AS m FROM windows GROUP BY w
), hits AS (
  SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS opens FROM windows JOIN least USING (w) WHERE m < doc_id
), spans AS (
  SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hits) GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans
), cut AS (
  SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head, max(hi) AS last, sum(hi - lo) AS removed, count(*) AS n
  FROM gaps JOIN h USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
"""
