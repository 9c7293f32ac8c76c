"""Operator 10: substring dedup of word windows by level-wise doubling.

A window of ``window`` words can only repeat if the shorter windows inside it repeat. Lengths double
from ``shortest`` up to the window's own (13, 25, 50). At each length a window is stood for by the one of
its parts of that length with the smallest hash, which equal windows share; only windows whose part
occurs in two documents are extended to the next length, until none survive or the full length is
reached. There the survivors' hashes (128 bits, from two independent hashes of each word) find the smallest doc_id that holds each window, and
words under a window that a smaller document also holds go. Another first length gives the same
result; each length is one more pass over the texts.

Hashes travel packed between blocks of documents (see _blocks); texts are shuffled once, compressed.

Defined results: words are runs of anything but the six ASCII white-space characters; a null text
has none. Rows that repeat a doc_id never remove words from each other. A null doc_id counts as
larger than any other. Documents under ``window`` words stay whole. A very long text is a block by
itself and costs some 100 bytes a word. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from porelake.llm import _blocks as B
from porelake.llm._shared import table

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\v\f\r")] = True
LONG = 512  # bytes; longer words are hashed one by one
SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def word_hashes(texts: list[bytes], which: int = 0, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words of each text). Words are taken in eights of bytes, each mixed
    into a state that is scrambled before the next; ``which`` gives another hash of the same words,
    that shares nothing with the first but the scrambling."""
    data = b" ".join(texts)
    raw = np.frombuffer(data, np.uint8)
    space = SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    lo, hi = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    padded = data + b"\0" * 8
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place on
    sizes = hi - lo
    out = B.scramble(sizes.astype(np.uint64) ^ np.uint64(SEEDS[which]))
    many = np.flatnonzero(sizes > LONG)
    for part in range(0, len(lo), step):
        at = np.arange(part, min(len(lo), part + step))
        at = at[sizes[at] <= LONG]
        done = 0
        while len(at):
            left = np.minimum(sizes[at] - done, 8).astype(np.uint64)
            word = eights[lo[at] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - left) * np.uint64(8)))
            out[at] = B.scramble((out[at] ^ word) * np.uint64(SEEDS[which]))
            done += 8
            at = at[sizes[at] > done]
    for k in many.tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[lo[k] : hi[k]], SEEDS[which])
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return out, np.diff(np.searchsorted(lo, text_ends), prepend=0)


def _windows(texts: list[bytes], which: int = 0) -> B.Windows:
    return B.Windows(*word_hashes(texts, which))


def lengths(window: int, shortest: int = 13) -> list[int]:
    """Lengths that at most double, up to the window's."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


FULL = np.dtype([("h1", np.uint64), ("h2", np.uint64), ("id", np.int64)])
PLACE = np.dtype(np.int32)


def _survivors(w: B.Windows, window: int, length: int | None, told: B.Told, buckets: int) -> np.ndarray:
    """Starts of the windows whose part of ``length`` is among the repeated ones."""
    if length is None:
        return np.flatnonzero(w.fit(window))
    starts, least = w.minimizers(length, window)
    if not len(starts):
        return starts
    runs = B.changes(least)
    ok, _ = B.Filter(told, str(length), buckets).find(least[runs])
    return starts[np.repeat(ok, np.diff(np.append(runs, len(least))))]


class Full:
    """The survivors' distinct windows in a block. Their 128 bits come from two hashes of each word."""

    def __init__(self, w: B.Windows, texts: list[bytes], ids: np.ndarray, starts: np.ndarray, window: int, buckets: int):
        h1, h2 = w.hashes(window, starts), _windows(texts, 1).hashes(window, starts, 1)
        self.order = np.lexsort((h2, h1))
        h1, h2, self.doc = h1[self.order], h2[self.order], ids[w.owner(starts)][self.order]
        first = B.changes(h1, h2)
        self.group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h1))))
        self.records = np.empty(len(first), FULL)
        self.records["h1"], self.records["h2"], self.records["id"] = h1[first], h2[first], np.minimum.reduceat(self.doc, first)
        self.dealt = B.Dealt((h1[first] % np.uint64(buckets)).astype(np.int64), buckets)


def _smallest(records: np.ndarray, rows: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
    """The windows that a smaller document of another block holds, by their places."""
    if not len(records):
        return np.zeros(0, np.int64), np.zeros(0, PLACE)
    order = np.lexsort((records["h2"], records["h1"]))
    first = B.changes(records["h1"][order], records["h2"][order])
    least = np.empty(len(records), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(records["id"][order], first), np.diff(np.append(first, len(records))))
    which = np.flatnonzero(least < records["id"])
    return which, B.places(rows)[which].astype(PLACE)


def remove_repeats(docs: DataFrame, window: int = 50, keep_text: bool = True, shortest: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): kept words joined by single spaces;
    kept_text is null unless asked for."""
    blocks, sizes = B.pack_blocks(docs, "windows")
    few, many = sizes.buckets(0.25), sizes.buckets()
    *short, full = lengths(window, shortest)
    answers, last = None, None
    for length in short:

        def candidates(block, ids, texts, told, length=length, last=last) -> pa.Table:
            w = _windows(texts)
            starts, least = w.minimizers(length, full)
            if last is not None and len(starts):
                alive = np.isin(starts, _survivors(w, full, last, told, few), assume_unique=True)
                starts, least = starts[alive], least[alive]
            if not len(starts):
                return B.nothing_sent()
            doc = w.owner(starts)
            runs = B.changes(least, doc)
            return B.send_values(block, least[runs], doc[runs], few)

        answers = B.answer(B.send(blocks, answers, candidates), few, B.VALUE, B.shared_values, str(length))
        last = length

    def survivors(block, ids, texts, told) -> pa.Table:
        w = _windows(texts)
        starts = _survivors(w, full, last, told, few)
        if not len(starts):
            return B.nothing_sent()
        found = Full(w, texts, ids, starts, full, many)
        return found.dealt.sent(block, found.records)

    found = B.answer(B.send(blocks, answers, survivors), many, FULL, _smallest, "full")

    def output(block: int, payload: bytes, told: B.Told) -> pa.Table:
        ids, texts = B.unpack(payload)
        w = _windows(texts)
        gone = np.zeros(w.n + 1, np.int64)
        starts = _survivors(w, full, last, told, few) if told or last is None else np.zeros(0, np.int64)
        if len(starts):
            f = Full(w, texts, ids, starts, full, many)
            elsewhere = np.zeros(len(f.records), bool)
            elsewhere[f.dealt.find(*told.get_records("full", PLACE))] = True
            hit = starts[f.order[elsewhere[f.group] | (f.doc > f.records["id"][f.group])]]
            np.add.at(gone, hit, 1)
            np.subtract.at(gone, hit + full, 1)
        gone = np.cumsum(gone[:-1]) > 0
        rows, kept_words = [], []
        for d, (at, size) in enumerate(zip(w.starts.tolist(), w.lens.tolist())):
            cut = gone[at : at + size]
            removed = int(cut.sum())
            words = texts[d].split()
            kept = b" ".join(compress(words, (~cut).tolist()) if removed else words)
            rows.append((size, removed, hashlib.sha256(kept).hexdigest()))
            kept_words.append(kept.decode("utf-8", "replace") if keep_text else None)
        real = pa.array(ids, pa.int64(), mask=ids == B.LAST)
        totals, removed, digests = zip(*rows) if rows else ((), (), ())
        return pa.table({"doc_id": real, "n_words": pa.array(totals, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(kept_words, pa.string())})

    return B.with_answers(blocks, found if answers is None else answers.unionByName(found), output, SCHEMA)


def op10_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept_text")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), least AS (
  SELECT h, min(doc_id) AS m FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN least USING (h), range(50) r(k) WHERE m < doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS words, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
