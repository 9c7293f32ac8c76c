"""Documents packed into blocks, and exchanges of packed numpy arrays between blocks.

A block is some megabytes of documents, compressed, in one row. Blocks are written once as a table
bucketed by block id, so later passes read them next to what is addressed to them and shuffle only
that. In an exchange every block sends one packed row to each of a number of buckets, chosen from the
hash of what it sends; a bucket's task sees what all blocks sent and answers each of them. What
repeats within a block is sent once, so a passage that a third of all documents share is one entry a
block.

Sizes follow the text: blocks grow from 4 to 64 MB, tasks from 16 MB to 1 GB of text and buckets up to
256 MB, so that at 100 TB a row between a block and a bucket still holds hundreds of bytes and a value
that all documents share is 1.6 million entries in its bucket. Rows hold plain fixed-width records;
they are cut and joined as whole buffers, without a step of Python for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porelake.llm._shared import id_and_text, materialize, scratch_dir

SENT = "bucket int, block long, records binary, bytes binary"
ANSWER = "block long, tag string, bucket int, records binary"
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: no document comes after it
MB = 1 << 20


class Sizes(NamedTuple):
    """Of a corpus of ``text`` bytes."""

    text: int

    @property
    def block(self) -> int:
        return min(64 * MB, max(4 * MB, self.text >> 14))

    @property
    def tasks(self) -> int:
        return max(1, -(-self.text // min(1024 * MB, max(16 * MB, self.text >> 12))))

    def buckets(self, share: float = 1.0) -> int:
        """For an exchange of that share of the text."""
        sent = int(self.text * share)
        return max(1, -(-sent // min(256 * MB, max(4 * MB, sent >> 12))))


def pack_blocks(docs: DataFrame, tag: str) -> tuple[DataFrame, Sizes]:
    """(block, payload) as a bucketed table that is in no catalog, and the sizes."""
    docs = id_and_text(docs)
    sizes = Sizes(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    most = sizes.block

    def packed(held: list[pa.RecordBatch], number: Iterator[int]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for b in held:
                w.write_batch(b)
        return pa.record_batch({"block": pa.array([next(number)], pa.int64()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task that runs again gives its blocks the same numbers, so none is lost or doubled between its runs
        number = count(TaskContext.get().partitionId() << 32)
        held, size = [], 0
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                before = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, before + most - size, "right")))
                held.append(b.slice(at, end - at))
                size += int(ends[end - 1] - before)
                at = end
                if size >= most or at < b.num_rows:
                    yield packed(held, number)
                    held, size = [], 0
        if held:
            yield packed(held, number)

    spark = docs.sparkSession
    name = f"porelake_{tag}_{uuid.uuid4().hex}"
    blocks = docs.mapInArrow(run, "block long, payload binary").repartition(sizes.tasks, "block")  # one file a bucket
    blocks.write.bucketBy(sizes.tasks, "block").sortBy("block").option("path", f"{scratch_dir(spark)}/porelake/{name}").format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are the scratch folder's
    return table, sizes


def unpack(payload: bytes) -> tuple[np.ndarray, list[bytes]]:
    """doc_ids and texts as UTF-8 of a block; null texts are empty, null ids LAST."""
    t = pa.ipc.open_stream(payload).read_all()
    ids = pc.fill_null(t["doc_id"], LAST).to_numpy().astype(np.int64)
    return ids, [x or b"" for x in t["text"].cast(pa.binary()).to_pylist()]


# records in rows --------------------------------------------------------------------------------


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each part of the data (in bytes), which ends at ``ends``."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _records(column: pa.ChunkedArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of a binary column, and how many each row holds."""
    lens = pc.binary_length(column).to_numpy().astype(np.int64)
    return np.frombuffer(_joined(column), dtype), lens // dtype.itemsize


def _joined(column: pa.ChunkedArray) -> bytes:
    parts = []
    for c in column.chunks:
        offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        parts.append(memoryview(c.buffers()[2])[offsets[0] : offsets[-1]] if len(c) and c.buffers()[2] is not None else b"")
    return parts[0] if len(parts) == 1 else b"".join(parts)


class Dealt:
    """Records in the order of their buckets, as they are sent; an answer names a record by its
    bucket and its place in it."""

    def __init__(self, bucket: np.ndarray, buckets: int):
        self.order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
        ordered = bucket[self.order]
        self.first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        self.bucket = ordered[self.first]

    def sent(self, block: int, records: np.ndarray, data: Callable[[np.ndarray], np.ndarray] | None = None, lens: np.ndarray | None = None) -> pa.Table:
        """Rows of the records; ``data(order)`` gives further bytes, ``lens`` of them for each record."""
        ends = np.append(self.first[1:], len(self.order)) if len(self.first) else self.first
        records = np.ascontiguousarray(records[self.order])
        n = len(self.first)
        more = _binaries(data(self.order), np.cumsum(lens[self.order])[ends - 1]) if data is not None and n else pa.nulls(n, pa.binary())
        return pa.table({"bucket": pa.array(self.bucket, pa.int32()), "block": pa.array(np.full(n, block, np.int64)), "records": _binaries(records.view(np.uint8), ends * records.itemsize), "bytes": more})

    def find(self, bucket: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The records (by their place before they were dealt) that answers name."""
        return self.order[self.first[np.searchsorted(self.bucket, bucket)] + place]


def nothing_sent() -> pa.Table:
    return pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "records": pa.array([], pa.binary()), "bytes": pa.array([], pa.binary())})


# passes -----------------------------------------------------------------------------------------


class Told(dict):
    """tag -> the answers to a block, as rows; each exchange has one kind of record."""

    def get_records(self, tag: str, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of each record, records)"""
        if tag not in self:
            return np.zeros(0, np.int64), np.zeros(0, dtype)
        records, n = _records(self[tag]["records"], dtype)
        return np.repeat(self[tag]["bucket"].to_numpy().astype(np.int64), n), records


def send(blocks: DataFrame, answers: DataFrame | None, work: Callable) -> DataFrame:
    """The rows that ``work(block, doc_ids, texts, told)`` gives for each block; where there are
    answers, for the blocks that got some. They go straight into the shuffle of their one reader,
    whose result is written; rows that are lost with an executor are made again from their blocks."""
    if answers is None:

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, payload in zip(b.column("block").to_pylist(), b.column("payload")):
                    yield from work(block, *unpack(payload.as_py()), Told()).to_batches()

        return blocks.select("block", "payload").mapInArrow(scan, SENT)
    return with_answers(blocks, answers, lambda block, payload, told: work(block, *unpack(payload), told) if told else None, SENT)


def with_answers(blocks: DataFrame, answers: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(block, payload, told)`` for each block; None gives no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tags = right["tag"]
        told = Told({t: right.filter(pc.equal(tags, t)) for t in pc.unique(tags).to_pylist()})
        made = [work(block, payload, told) for block, payload in zip(left["block"].to_pylist(), left["payload"].to_pylist())]
        made = [m for m in made if m is not None]
        return pa.concat_tables(made) if made else empty

    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def answer(sent: DataFrame, buckets: int, dtype: np.dtype, work: Callable, tag: str) -> DataFrame:
    """``work(records, rows, bytes)`` gives (which records are told something, what): ``rows`` numbers
    the block of each record. There is a task for each bucket's worth of text, not a fixed number."""

    def run(group: pa.Table) -> pa.Table:
        records, n = _records(group["records"], dtype)
        which, told = work(records, np.repeat(np.arange(len(n)), n), group["bytes"])
        per_row = np.bincount(np.repeat(np.arange(len(n)), n)[which], minlength=len(n))
        rows = np.flatnonzero(per_row)
        told = np.ascontiguousarray(told)
        values = _binaries(told.view(np.uint8), np.cumsum(per_row[rows]) * told.itemsize)
        return pa.table({"block": group["block"].take(pa.array(rows)), "tag": pa.array([tag] * len(rows), pa.string()), "bucket": pa.array(np.full(len(rows), group["bucket"][0].as_py()), pa.int32()), "records": values})

    return materialize(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, ANSWER), f"answer-{tag}")


def places(rows: np.ndarray) -> np.ndarray:
    """The place of each record in its row; ``rows`` ascends."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows)


# windows over symbol sequences ------------------------------------------------------------------

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(16, int(n).bit_length())
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = tuple(both)
    return _POWERS[base]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Windows:
    """Hashes of windows over the sequences of a block, laid end to end."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, symbols: np.ndarray, lens: np.ndarray):
        self.n = len(symbols)
        self.lens = lens
        self.starts = np.cumsum(lens) - lens
        self.symbols = symbols
        self.sums: dict[int, np.ndarray] = {}

    def _sums(self, which: int) -> np.ndarray:
        if which not in self.sums:
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self.symbols * _powers(self.BASES[which], self.n + 1)[0][: self.n], dtype=np.uint64, out=s[1:])
            self.sums[which] = s
        return self.sums[which]

    def hashes(self, length: int, at: np.ndarray | None = None, which: int = 0) -> np.ndarray:
        """Of the windows that start at ``at`` (default: everywhere they fit into all symbols)."""
        s, inverse = self._sums(which), _powers(self.BASES[which], self.n + 1)[1]
        if at is None:
            m = max(0, self.n - length + 1)
            return scramble((s[length : length + m] - s[:m]) * inverse[:m])
        return scramble((s[at + length] - s[at]) * inverse[at])

    def ranges(self, lo: np.ndarray, hi: np.ndarray, which: int = 1) -> np.ndarray:
        """Hashes of ranges of any length."""
        s, inverse = self._sums(which), _powers(self.BASES[which], self.n + 1)[1]
        return scramble((s[hi] - s[lo]) * inverse[lo]) ^ scramble((hi - lo).astype(np.uint64))

    def fit(self, length: int) -> np.ndarray:
        """Marks the starts of windows that lie in one sequence."""
        ok = np.zeros(self.n, bool)
        room = np.maximum(0, self.lens - length + 1)
        ok[np.arange(room.sum()) + np.repeat(self.starts - (np.cumsum(room) - room), room)] = True
        return ok

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts + self.lens, at, "right")

    def minimizers(self, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the windows that fit, smallest hash of a part of ``length`` in each)."""
        starts = np.flatnonzero(self.fit(window))
        if not len(starts):
            return starts, np.zeros(0, np.uint64)
        return starts, sliding(np.minimum, self.hashes(length), window - length + 1)[starts]


def sliding(f: np.ufunc, x: np.ndarray, k: int) -> np.ndarray:
    """f over each k neighbours; doubling spans."""
    n, span = len(x) - k + 1, 1
    while span * 2 <= k:
        x = f(x[: len(x) - span], x[span:])
        span *= 2
    return f(x[:n], x[k - span : k - span + n])


def changes(*arrays: np.ndarray) -> np.ndarray:
    """Where neighbours differ in some array; the first place always."""
    new = np.ones(len(arrays[0]), bool)
    new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in arrays])
    return np.flatnonzero(new)


# filter: which values do two documents share ----------------------------------------------------

VALUE = np.dtype([("key", np.uint32), ("flags", np.uint8)])
SEVERAL, HOT = 1, 2  # two documents of the block have it; it has very many surroundings in the block


def filter_key(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values % np.uint64(buckets)) << np.uint64(32)) | (values >> np.uint64(32))


def send_values(block: int, values: np.ndarray, doc: np.ndarray, buckets: int, around: np.ndarray | None = None, hot: int = 64) -> pa.Table:
    """Each value once; 32 bits of a value are enough, as what two values may wrongly share is only
    looked at more closely later. ``around``: hashes of the surroundings; a value with over ``hot``
    different ones is marked."""
    keys = filter_key(values, buckets)
    if not len(keys):
        return nothing_sent()
    order = np.argsort(keys)
    keys, doc = keys[order], doc[order]
    first = changes(keys)
    flags = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)).astype(np.uint8) * SEVERAL
    if around is not None:
        ends = np.append(first[1:], len(keys))
        for k in np.flatnonzero(ends - first > hot):
            flags[k] |= HOT * (len(np.unique(around[order[first[k] : ends[k]]])) > hot)
    records = np.empty(len(first), VALUE)
    records["key"], records["flags"] = keys[first].astype(np.uint32), flags
    return Dealt((keys[first] >> np.uint64(32)).astype(np.int64), buckets).sent(block, records)


def shared_values(records: np.ndarray, rows: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
    """The values that two documents have, told to each block with what is known of them anywhere."""
    if not len(records):
        return np.zeros(0, np.int64), records
    order = np.argsort(records["key"], kind="stable")
    keys, flags = records["key"][order], records["flags"][order]
    first = changes(keys)
    n = np.diff(np.append(first, len(keys)))
    merged = np.bitwise_or.reduceat(flags, first)
    shared = np.zeros(len(records), bool)
    shared[order] = np.repeat((n > 1) | (merged & SEVERAL > 0), n)
    told = records.copy()
    told["flags"][order] = np.repeat(merged, n)
    which = np.flatnonzero(shared)
    return which, told[which]


class Filter:
    """All answers of a filter to a block."""

    def __init__(self, told: Told, tag: str, buckets: int):
        bucket, records = told.get_records(tag, VALUE)
        keys = bucket.astype(np.uint64) << np.uint64(32) | records["key"].astype(np.uint64)
        order = np.argsort(keys)
        self.buckets, self.keys, self.flags = buckets, keys[order], records["flags"][order]
        self.some_bits = np.zeros(1 << 20, bool)
        self.some_bits[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which values are told, their flags); a table of some of the bits sorts out most others."""
        out, flags = np.zeros(len(values), bool), np.zeros(len(values), np.uint8)
        if not len(self.keys) or not len(values):
            return out, flags
        maybe = np.flatnonzero(self.some_bits[(values >> np.uint64(32) & np.uint64(0xFFFFF)).astype(np.int64)])
        keys = filter_key(values[maybe], self.buckets)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out[maybe] = self.keys[at] == keys
        flags[maybe] = self.flags[at]
        return out, flags
