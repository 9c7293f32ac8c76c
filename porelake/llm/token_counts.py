"""Operator 9: token counts by rank-synchronous merging over ragged numpy arrays.

Pre-tokens that are not yet known are held as one flat symbol array with offsets. In each round
every sequence finds its lowest-rank adjacent pair, and all sequences apply theirs at once; a
sequence is done when no pair of its symbols merges. The symbols that survive are its tokens.

The vocabulary is a sentencepiece BPE model with byte fallback: any split of a piece into two known
symbols is a merge whose rank is the place of the piece in the score order; characters outside the
vocabulary count one token a UTF-8 byte. A space turns into U+2581 and one is put before the text,
so no piece has that mark after another character, and pre-tokens can be cut before each run of it.

A pre-token over ``LONG`` characters (a run without spaces) is first cut wherever two neighbouring
characters are neighbours in no piece, since nothing merges there; so such runs do not take a round
for every rank of the vocabulary.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by
one; an empty table gives no rows; further columns are ignored. Very long texts form groups of their
own. Memory: the pre-tokens of one group of texts, and at most two generations of ``cache_size``
counts of pre-tokens up to ``LONG`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from porelake.llm._shared import id_and_text, slices, table

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
MARK = "▁"
NONE = np.int32(2**31 - 1)
LONG = 64


class PairTable:
    """Open hash table (left symbol, right symbol) -> rank, merged symbol, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank, self.merged = np.full(size, NONE, np.int32), np.full(size, -1, np.int32)
        left, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):  # each probe: who comes first takes a free slot, the others move one on
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            slots, first = np.unique(at[free], return_index=True)
            won = left[free[first]]
            self.keys[slots], self.rank[slots], self.merged[slots] = keys[won], rank[won], merged[won]
            lost = np.ones(len(left), bool)
            lost[free[first]] = False
            left, at = left[lost], (at[lost] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        at = self._slot(keys)
        there = self.keys[at]
        found = np.where(there == keys, at, -1)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (there != -1)]
        return found


class PieceCounter:
    """Counts the tokens of texts for one sentencepiece BPE model."""

    def __init__(self, path: str, cache_size: int = 200_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " 　 A\tx  "
        if sp.decode(sp.encode(probe)) != probe or sp.encode("  ", out_type=str) != [MARK * 3]:
            raise ValueError("a model with identity normalization and a dummy prefix is needed")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        piece = {sp.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in piece):
            raise ValueError("pieces with a space after another character are not handled")
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        place, last = {}, None
        for i in order:  # equal scores share a rank: the leftmost merge wins then
            if last is None or sp.get_score(i) != sp.get_score(last):
                place[i] = len(place)
            else:
                place[i] = place[last]
            last = i
        # symbols: the pieces, characters that only occur inside pieces, then one per UTF-8 length for the rest
        inner = sorted({c for p in piece for c in p} - piece.keys())
        symbol = piece | {c: n + k for k, c in enumerate(inner)}
        self.base = n + len(inner)
        self.weight = np.array([1] * n + [len(c.encode()) for c in inner] + [1, 2, 3, 4], np.int64)
        self.of_char = np.empty(0x110000, np.int32)
        for lo, hi, k in ((0, 0x80, 0), (0x80, 0x800, 1), (0x800, 0x10000, 2), (0x10000, 0x110000, 3)):
            self.of_char[lo:hi] = self.base + k
        for c, s in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        self.stride = self.base + 4
        rows = [(symbol[p[:k]] * self.stride + symbol[p[k:]], place[i], i) for p, i in piece.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        keys, rank, merged = (np.array(x, t) for x, t in zip(zip(*rows), (np.int64, np.int32, np.int32)))
        self.pairs = PairTable(keys, rank, merged)
        pairs = {(ord(a), ord(b)) for p in piece for a, b in zip(p, p[1:])}
        self.neighbours = np.array(sorted(a << 21 | b for a, b in pairs), np.int64)
        self.cache: dict[str, int] = {}
        self.old: dict[str, int] = {}  # the generation before: what is still in use comes back from it
        self.cache_size = cache_size
        self.runs = regex.compile(" *[^ ]+| +")

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.pairs.find(left.astype(np.int64) * self.stride + right)
        return np.where(at < 0, NONE, self.pairs.rank[at]), self.pairs.merged[at]

    def count_ragged(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, spaces already turned into marks."""
        out = np.zeros(len(words), np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        who = np.flatnonzero(lens)
        lens = lens[who]
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        if not len(sym):
            return out
        starts = np.cumsum(lens) - lens
        rank, into = np.full(len(sym), NONE, np.int32), np.full(len(sym), -1, np.int32)
        rank[:-1], into[:-1] = self._ranks(sym[:-1], sym[1:])
        rank[starts[1:] - 1] = NONE
        while len(who):
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NONE
            if done.any():
                out[who[done]] = np.add.reduceat(self.weight[sym], starts)[done]
                stay = np.repeat(~done, lens)
                sym, rank, into = sym[stay], rank[stay], into[stay]
                who, lens, lowest = who[~done], lens[~done], lowest[~done]
                if not len(who):
                    break
            hit = rank == np.repeat(lowest, lens)
            at = np.flatnonzero(hit)
            # pairs that overlap the one before: of a row of such pairs every second one, from the left
            row = np.ones(len(at), bool)
            row[1:] = np.diff(at) > 1
            first = at[np.maximum.accumulate(np.where(row, np.arange(len(at)), 0))]
            at = at[(at - first) % 2 == 0]
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            owner = np.repeat(np.arange(len(who)), lens)
            lens = lens - np.bincount(owner[at], minlength=len(who))
            ends = at + 1  # a merged pair takes over what stands after its right symbol
            rank[at] = rank[ends]
            sym, rank, into = sym[keep], rank[keep], into[keep]
            at = at - np.arange(len(at))
            starts = np.cumsum(lens) - lens
            is_end = np.zeros(len(sym), bool)
            is_end[starts + lens - 1] = True
            begins = np.zeros(len(sym), bool)
            begins[starts] = True
            fresh = np.unique(np.concatenate([at[~is_end[at]], at[~begins[at]] - 1]))
            rank[at[is_end[at]]] = NONE
            if len(fresh):
                rank[fresh], into[fresh] = self._ranks(sym[fresh], sym[fresh + 1])
        return out

    def _split(self, text: str) -> list[str]:
        """Pre-tokens, each without its first space."""
        words = text.replace(MARK, " ").split(" ")
        if "" in words:
            words = [w[1:] for w in self.runs.findall(" " + " ".join(words))]
        return words

    def count_long(self, word: str) -> int:
        """Tokens of one long word, spaces already turned into marks."""
        c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        keys = c[:-1] << 21 | c[1:]
        at = np.minimum(np.searchsorted(self.neighbours, keys), len(self.neighbours) - 1)
        cuts = [0, *(np.flatnonzero(self.neighbours[at] != keys) + 1).tolist(), len(word)]
        return int(self.count_ragged([word[a:b] for a, b in zip(cuts, cuts[1:])]).sum())

    def count(self, texts: list[str]) -> list[int]:
        split = [self._split(t) if t else [] for t in texts]
        long = [0] * len(texts)
        for k, words in enumerate(split):
            if len(texts[k]) > LONG and max(map(len, words)) > LONG:
                long[k] = sum(self.count_long(MARK + w.replace(" ", MARK)) for w in words if len(w) > LONG)
                split[k] = [w for w in words if len(w) <= LONG]
        seen = set(chain.from_iterable(split))
        if len(self.cache) + len(seen) > self.cache_size:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        new = [w for w in seen if w not in cache]
        if old:
            cache.update((w, old[w]) for w in new if w in old)
            new = [w for w in new if w not in cache]
        if new:
            cache.update(zip(new, self.count_ragged([MARK + w.replace(" ", MARK) for w in new]).tolist()))
        return [n + sum(map(cache.__getitem__, words)) for n, words in zip(long, split)]


@lru_cache(maxsize=1)
def counter(path: str) -> PieceCounter:
    """One counter per Python worker."""
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, group: int = 2000) -> DataFrame:
    """One pass over the documents, no shuffle. ``group`` texts are merged together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for whole in batches:
            for b in slices(whole, group):
                texts = [t or "" for t in b.column("text").to_pylist()]
                tokens = pa.array(count(texts), pa.int64())
                sizes = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
                yield pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": sizes, "n_tokens": tokens, "over_limit": pa.array([n.as_py() > limit for n in tokens], pa.bool_())})

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
