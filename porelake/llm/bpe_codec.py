"""Operator 7: byte-level BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token the last token of its BPE encoding is unique. The dynamic program
walks the prefixes once: an automaton over the vocabulary lists the tokens that end at a position
(the suffix matches), and a pair-compatibility test says whether such a token may follow the last
token of the prefix before it. Following the stored last tokens back from the end gives the ids.

Defined results: a null text counts as empty; an empty text has no ids, and decodes to ''. The
string of a special token inside a text becomes its id, as the tokenizers library does by default.
Repeated rows are encoded one by one and stay as they are; an empty table gives no rows; further
columns are ignored. Very long texts and pre-tokens cost time and memory in proportion to their
length. What a worker keeps between texts is bounded: two generations of ``cache_size`` entries a
cache, none of them longer than 64 characters.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from string import punctuation

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porelake.llm._shared import Recent, id_and_text, map_batches, quoted, table

DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
DECODE_SCHEMA = "doc_id long, text string"

# Fixed value: the split pattern that byte-level pre-tokenizers of this family use.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LATIN = "\u0250"  # below it Python's letters and the pattern's are the same, whatever their versions of Unicode


def byte_alphabet() -> dict[str, int]:
    """Printable character -> byte: visible Latin-1 characters stand for themselves, the other bytes
    take the code points from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteBpe:
    """Exact BPE encoder and decoder for one vocabulary file (tokenizers JSON, byte level)."""

    def __init__(self, path: str, cache_size: int = 100_000):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = model["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * size
        for s, i in vocab.items():
            if s not in self.specials:
                self.bytes_of[i] = raw(s)
        for s, i in self.specials.items():
            self.bytes_of[i] = s.encode()
        self.decimal = [str(i) for i in range(size)]
        # rank: the step at which a token is made; -1 for single bytes
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, t = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault((a, b), r)
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, a, b
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            if s not in self.specials and (len(s) == 1 or self.rank[i] >= 0):
                self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.automaton.make_automaton()
        self.fits = Recent(self._fits, cache_size)
        self.pretokens = Recent(self._encode_pretoken, cache_size // 2)
        self.chunks = Recent(self._encode_chunk, cache_size)
        self.split = regex.compile(SPLIT)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Does BPE leave a|b unmerged at their border? Undo the merges of both sides, latest first;
        the two symbols that then meet at the border must not have a merge due before the one undone."""
        a, b = pair
        rank, due = self.rank, len(self.pairs) + 1
        while True:
            if self.pairs.get((a, b), due) < due:
                return False
            if rank[a] > rank[b]:
                due, a = rank[a], self.right[a]  # a tie: the merge on the left comes first
            elif rank[b] >= 0:
                due, b = rank[b] + 1, self.left[b]
            else:
                return True

    def _encode_pretoken(self, piece: str) -> tuple[int, ...]:
        data = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        last, size, done = [-1] * len(data), [0] * len(data), -1
        fits = self.fits
        for at, (token, n) in self.automaton.iter(data):  # the longest token that ends here first
            if at != done and (at + 1 == n or fits[last[at - n], token]):
                last[at], size[at], done = token, n, at
        ids, at = [], len(data) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return tuple(ids)

    def _encode_chunk(self, chunk: str) -> tuple[int, ...] | None:
        """Ids of ' ' + chunk; None unless pre-tokens surely begin and end with the chunk. Latin letters are
        one pre-token, ASCII punctuation behind them is another: neither needs the pattern."""
        if chunk.isalpha():
            if chunk.isascii() or max(chunk) < LATIN:
                return self._encode_pretoken(" " + chunk)
        elif (word := chunk.rstrip(punctuation)).isalpha() and len(word) < len(chunk):
            return self.chunks[word] + self.pretokens[chunk[len(word) :]]
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        return tuple(chain.from_iterable(map(self.pretokens.__getitem__, self.split.findall(" " + chunk))))

    def _encode_plain(self, text: str) -> list[int]:
        head, *rest = text.split(" ")
        if head and not head[-1].isspace():
            try:
                start = chain.from_iterable(map(self.pretokens.__getitem__, self.split.findall(head)))
                return [*start, *chain.from_iterable(map(self.chunks.__getitem__, rest))]
            except TypeError:  # a chunk that has white space at its border: split the text as a whole
                pass
        return list(chain.from_iterable(map(self.pretokens.__getitem__, self.split.findall(text))))

    def encode(self, text: str) -> list[int]:
        if self.special_split is None or not any(s in text for s in self.specials):
            return self._encode_plain(text) if text else []
        ids: list[int] = []
        for part in self.special_split.split(text):
            if part:
                ids += [self.specials[part]] if part in self.specials else self._encode_plain(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def codec(path: str) -> ByteBpe:
    """One codec per Python worker."""
    return ByteBpe(path)


def encode_columns(docs: DataFrame, tokenizer_path: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and ids: one pass over the documents, no shuffle."""
    chosen = docs.select(*keep, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids = [np.array(bpe.encode(t.as_py() or ""), np.int32) for t in b.column("text")]
                yield pa.record_batch([*(b.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    fields = ", ".join(f"{quoted(c)} {chosen.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(chosen, run, f"{fields}, ids array<int>")


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids) of each document."""
    return encode_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer_path, ("doc_id",))


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array([bpe.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())})

    return map_batches(encoded.select("doc_id", "ids"), run, DECODE_SCHEMA)


def round_trip_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode, then decode the ids, and give the digests of both; ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        sha = hashlib.sha256
        for b in batches:
            counts, left, back = [], [], []
            for scalar in b.column("text"):
                ids = bpe.encode(scalar.as_py() or "")
                counts.append(len(ids))
                left.append(sha(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(sha(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(left, pa.string()), "decoded_sha256": pa.array(back, pa.string())})

    return map_batches(id_and_text(docs), run, DIGEST_SCHEMA)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
