"""BAM files as a Spark data source: the records of ``read_sam`` from compressed binary files.

A file is cut into splits of ``splitBytes``. A split owns the records that begin in its blocks, and reads
to the end of the last one. Records may straddle blocks and splits, and a split in the midst of a long
record owns none. To find its first record a split looks from ``lookBack`` bytes before its start on: for
a block (by the signature of a BGZF block and of the block after it), then for a place in the data from
which CHAIN_RECORDS records of sound fields follow each other, or as many as CHAIN_BYTES bytes or the
file's end allow (``_first_record``), and from there it steps over records to its start. Bytes that look
like records can only mislead it inside of a record that reaches from before the look back into the
split; within ``lookBack`` of a file's start it begins at the first record. ``splitBytes`` 0 reads each
file as one split.

Files are opened with Arrow's file systems (local paths, file, hdfs, s3, gs). Damaged blocks (by
their checksum) and truncated files are errors. Headers hold the references, so a writer takes them
as an option; every task writes a file of its own.
"""

from __future__ import annotations

import binascii
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from porelake.storage import ship_package

SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags string"
# Fixed values of the format: operations of a CIGAR, codes of bases, kinds of numbers in tags.
OPERATIONS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
HEAD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])
CHAIN_RECORDS, CHAIN_BYTES = 16, 1 << 18
_HEX_TO_BASE = bytes.maketrans(b"0123456789abcdef", BASES.encode())
_TO_PHRED = bytes((q + 33) & 255 for q in range(256))


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system, name


class _Blocks:
    """Blocks of a BGZF file from one of their starts on."""

    def __init__(self, path: str, step: int = 4 << 20):
        system, name = _open(path)
        self.path, self.file, self.step = path, system.open_input_file(name), step
        self.size = self.file.size()

    def bytes(self, at: int, n: int) -> bytes:
        return self.file.read_at(min(n, max(0, self.size - at)), at)

    @staticmethod
    def length(head: bytes) -> int | None:
        """Bytes of the block that begins here; None if none does."""
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            return None
        at, end = 12, 12 + int.from_bytes(head[10:12], "little")
        while at + 4 <= min(end, len(head)):
            n = int.from_bytes(head[at + 2 : at + 4], "little")
            if head[at : at + 2] == b"BC" and n == 2:
                return int.from_bytes(head[at + 4 : at + 6], "little") + 1
            at += 4 + n
        return None

    def first(self, at: int) -> int:
        """Where the first block at or after a place of the file begins; a block is followed by another or the end."""
        near = self.bytes(at, 1 << 18)
        for m in re.finditer(b"\x1f\x8b\x08\x04", near):
            size = self.length(near[m.start() : m.start() + 1024])
            after = at + m.start() + (size or 0)
            if size and (after == self.size or self.length(self.bytes(after, 1024))):
                return at + m.start()
        return self.size

    def read(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(where a block begins, its data), to the end of the file."""
        held, start = b"", at
        while at < self.size:
            if at + 65_536 > start + len(held) and start + len(held) < self.size:
                held, start = self.bytes(at, self.step), at
            block = held[at - start : at - start + 65_536]
            size = self.length(block)
            if size is None or at + size > self.size:
                raise ValueError(f"{self.path} is damaged or truncated at byte {at}")
            body = block[12 + int.from_bytes(block[10:12], "little") : size - 8]
            data = zlib.decompress(body, -15)
            crc, n = struct.unpack("<II", block[size - 8 : size])
            if len(data) != n or zlib.crc32(data) != crc:
                raise ValueError(f"{self.path} has a damaged block at byte {at}")
            yield at, data
            at += size


class _Stream:
    """Data of blocks as one buffer that grows on demand; knows from which block each byte comes."""

    def __init__(self, blocks: _Blocks, at: int):
        self.source, self.data, self.dropped = blocks.read(at), bytearray(), 0
        self.starts: list[tuple[int, int]] = []  # (place in all data, place in the file) of blocks
        self.ended = False

    def upto(self, n: int) -> bool:
        """Whether there are data up to a place."""
        while self.dropped + len(self.data) < n and not self.ended:
            found = next(self.source, None)
            if found is None:
                self.ended = True
            elif found[1]:
                self.starts.append((self.dropped + len(self.data), found[0]))
                self.data += found[1]
        return self.dropped + len(self.data) >= n

    def get(self, at: int, n: int) -> bytes:
        return bytes(self.data[at - self.dropped : at - self.dropped + n])

    def block(self, at: int) -> int | None:
        """Where the block of a place begins in the file; None beyond the data."""
        if not self.upto(at + 1):
            return None
        while len(self.starts) > 1 and self.starts[1][0] <= at:
            self.starts.pop(0)
        return self.starts[0][1]

    def drop(self, at: int, least: int = 1 << 20) -> None:
        """Forget the data before a place, once they are many."""
        if at - self.dropped > least:
            self.upto(at)
            del self.data[: at - self.dropped]
            self.dropped = at


def _header(stream: _Stream) -> tuple[str, list[tuple[str, int]], int]:
    """(text, references with their lengths, where records begin)"""
    at = 12
    if not stream.upto(8) or stream.get(0, 4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    n = int.from_bytes(stream.get(4, 4), "little")
    stream.upto(at + n)
    text = stream.get(8, n).split(b"\0")[0].decode()
    at = 8 + n
    stream.upto(at + 4)
    count = int.from_bytes(stream.get(at, 4), "little")
    at += 4
    refs = []
    for _ in range(count):
        stream.upto(at + 4)
        n = int.from_bytes(stream.get(at, 4), "little")
        stream.upto(at + 8 + n)
        refs.append((stream.get(at + 4, n - 1).decode(), int.from_bytes(stream.get(at + 4 + n, 4), "little")))
        at += 8 + n
    return text, refs, at


def _sound(data: np.ndarray, n_refs: int) -> np.ndarray:
    """Places of the data where the fields of a record are possible."""
    m = len(data) - HEAD.itemsize
    if m <= 0:
        return np.zeros(0, np.int64)
    wide = data.astype(np.int64)
    number = lambda k: wide[k : k + m] | wide[k + 1 : k + 1 + m] << 8 | wide[k + 2 : k + 2 + m] << 16 | (wide[k + 3 : k + 3 + m] ^ 128) - 128 << 24
    size, l_name, l_seq = number(0), wide[12 : 12 + m], number(20)
    n_ops = wide[16 : 16 + m] | wide[17 : 17 + m] << 8
    ok = (l_name > 1) & (l_seq >= 0) & (size >= 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq)
    for k in (4, 24):
        ref = number(k)
        ok &= (ref >= -1) & (ref < n_refs) & (number(k + 4) >= -1)
    at = np.flatnonzero(ok)
    end = at + 35 + l_name[at]
    inside = end < len(data)
    return at[~inside | (data[np.minimum(end, len(data) - 1)] == 0)]


def _first_record(stream: _Stream, n_refs: int, end: int) -> int | None:
    """The first place of a stream from which records follow each other, if it lies in a block before ``end``."""
    looked, window = 0, 1 << 17
    while True:
        if stream.block(looked) is None or stream.block(looked) >= end:
            return None
        stream.upto(looked + window)
        near = np.frombuffer(stream.get(looked, window), np.uint8)
        for at in (looked + _sound(near, n_refs)).tolist():
            if stream.block(at) >= end:
                return None
            if _follow(stream, at, n_refs):
                return at
        if len(near) < window:
            return None
        looked += len(near) - HEAD.itemsize


def _follow(stream: _Stream, at: int, n_refs: int) -> bool:
    """Whether records follow each other from here on."""
    begin, n = at, 0
    while n < CHAIN_RECORDS and at - begin < CHAIN_BYTES:
        if not stream.upto(at + HEAD.itemsize):
            return n > 0 and not stream.upto(at + 1)  # the end of the file, just where a record ends
        near = np.frombuffer(stream.get(at, HEAD.itemsize + 256), np.uint8)
        if not len(near) > HEAD.itemsize or _sound(near[: HEAD.itemsize + int(near[12])], n_refs)[:1].tolist() != [0]:
            return False
        name = near[36 : 35 + near[12]]
        if ((name < 33) | (name > 126)).any():
            return False
        at += 4 + int.from_bytes(stream.get(at, 4), "little")
        n += 1
        if not stream.upto(at):
            return False
    return True


def _tags(data: bytes) -> tuple[str, tuple | None]:
    """Tags as text, and the operations of a long CIGAR if a tag holds them."""
    out, long_ops, at = [], None, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            out.append(f"{name}:{kind}:{data[at:end].decode()}")
            at = end + 1
        elif kind == "A":
            out.append(f"{name}:A:{chr(data[at])}")
            at += 1
        elif kind == "B":
            of, n = chr(data[at]), int.from_bytes(data[at + 1 : at + 5], "little")
            values = struct.unpack_from(f"<{n}{NUMBERS[of]}", data, at + 5)
            at += 5 + n * struct.calcsize(NUMBERS[of])
            if name == "CG" and of == "I":
                long_ops = values
            else:
                out.append(f"{name}:B:{','.join([of, *(f'{v:g}' if of == 'f' else str(v) for v in values)])}")
        else:
            (value,) = struct.unpack_from("<" + NUMBERS[kind], data, at)
            out.append(f"{name}:{'f' if kind == 'f' else 'i'}:{f'{value:g}' if kind == 'f' else value}")
            at += struct.calcsize(NUMBERS[kind])
    return "\t".join(out), long_ops


def _cigar(ops) -> str:
    return "".join(f"{op >> 4}{OPERATIONS[op & 15]}" for op in ops) or "*"


def _rows(records: list[bytes], refs: list[str]) -> pa.RecordBatch:
    """Records, without their sizes, as rows of SCHEMA; fixed fields are read as columns."""
    heads = np.frombuffer(b"".join(r[:32] for r in records), np.dtype(HEAD.descr[1:]))
    names = np.array([*refs, "*"], object)  # -1 is the last one
    rname, rnext = names[heads["ref"]], names[heads["next_ref"]]
    rnext[(heads["next_ref"] == heads["ref"]) & (heads["ref"] >= 0)] = "="
    columns: dict[str, list] = {c: [] for c in ("qname", "cigar", "seq", "qual", "tags")}
    for r, l_name, n_ops, l_seq in zip(records, heads["l_name"].tolist(), heads["n_ops"].tolist(), heads["l_seq"].tolist()):
        at = 32 + l_name
        ops = struct.unpack_from(f"<{n_ops}I", r, at)
        at += 4 * n_ops
        packed, quals = r[at : at + (l_seq + 1) // 2], r[at + (l_seq + 1) // 2 : at + (l_seq + 1) // 2 + l_seq]
        tags, long_ops = _tags(r[at + (l_seq + 1) // 2 + l_seq :])
        columns["qname"].append(r[32 : 31 + l_name].decode())
        columns["cigar"].append(_cigar(ops if long_ops is None else long_ops))
        columns["seq"].append(binascii.hexlify(packed).translate(_HEX_TO_BASE)[:l_seq].decode() or "*")
        columns["qual"].append("*" if not l_seq or quals[0] == 255 else quals.translate(_TO_PHRED).decode())
        columns["tags"].append(tags)
    fixed = {"flag": heads["flag"], "rname": rname, "pos": heads["pos"] + 1, "mapq": heads["mapq"], "rnext": rnext, "pnext": heads["next_pos"] + 1, "tlen": heads["tlen"]}
    order = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.record_batch({c: pa.array(columns[c], pa.string()) if c in columns else pa.array(fixed[c], pa.string() if fixed[c].dtype == object else pa.int32()) for c in order})


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split, self.back = int(options.get("splitBytes", 64 << 20)), int(options.get("lookBack", 1 << 20))

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        out = []
        for path in self.paths:
            system, name = _open(path)
            info = system.get_file_info(name)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [info] if info.is_file else sorted((f for f in system.get_file_info(fs.FileSelector(name)) if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path)
            prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
            for f in found:
                step = self.split or max(1, f.size)
                out += [Split(prefix + f.path, at, min(f.size, at + step)) for at in range(0, f.size, step)]
        return out or [Split("", 0, 0)]

    @staticmethod
    def _size(stream: _Stream, at: int, split: Split) -> int:
        """Bytes of the record at a place, which are there."""
        if not stream.upto(at + 4) or not stream.upto(at + 4 + (n := int.from_bytes(stream.get(at, 4), "little"))):
            raise ValueError(f"{split.path} ends within a record")
        return n

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.end == 0:
            return
        blocks = _Blocks(split.path)
        stream = _Stream(blocks, 0)
        _, refs, at = _header(stream)
        names = [name for name, _ in refs]
        if split.start > self.back:
            stream = _Stream(blocks, blocks.first(split.start - self.back))
            at = _first_record(stream, len(refs), split.end)
            if at is None:
                return
        while (block := stream.block(at)) is not None and block < split.start:
            at += 4 + self._size(stream, at, split)
            stream.drop(at)
        records, size = [], 0
        while (block := stream.block(at)) is not None and block < split.end:
            n = self._size(stream, at, split)
            records.append(stream.get(at + 4, n))
            size += n
            at += 4 + n
            if len(records) == 8192 or size > 4 << 20:
                yield _rows(records, names)
                records, size = [], 0
            stream.drop(at)
        if records:
            yield _rows(records, names)


def _number_tag(name: bytes, value: str) -> bytes:
    v = int(value)
    kind = next(k for k, lo, hi in (("c", -128, 127), ("C", 0, 255), ("s", -(2**15), 2**15 - 1), ("S", 0, 2**16 - 1), ("i", -(2**31), 2**31 - 1), ("I", 0, 2**32 - 1)) if lo <= v <= hi)
    return name + kind.encode() + struct.pack("<" + NUMBERS[kind], v)


def _tag(text: str) -> bytes:
    name, kind, value = text.split(":", 2)
    if kind == "i":
        return _number_tag(name.encode(), value)
    if kind == "f":
        return name.encode() + b"f" + struct.pack("<f", float(value))
    if kind == "B":
        of, *values = value.split(",")
        return name.encode() + b"B" + of.encode() + struct.pack(f"<I{len(values)}{NUMBERS[of]}", len(values), *(float(v) if of == "f" else int(v) for v in values))
    return name.encode() + kind.encode() + value.encode() + (b"" if kind == "A" else b"\0")


def _bin(begin: int, end: int) -> int:
    """The smallest bin of the format's index that holds [begin, end)."""
    for level, shift in ((5, 14), (4, 17), (3, 20), (2, 23), (1, 26)):
        if begin >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (begin >> shift)
    return 0


def _record(row: dict, refs: dict[str, int]) -> bytes:
    ops = [(int(n) << 4) | OPERATIONS.index(op) for n, op in re.findall(rf"(\d+)([{OPERATIONS}])", row["cigar"])]
    seq = "" if row["seq"] == "*" else row["seq"]
    packed = bytes.fromhex("".join(f"{BASES.index(b) if b in BASES else 15:x}" for b in seq.upper()) + "0" * (len(seq) % 2))
    qual = b"\xff" * len(seq) if row["qual"] == "*" else bytes(ord(q) - 33 for q in row["qual"])
    if len(qual) != len(seq):
        raise ValueError(f"{row['qname']}: sequence and qualities differ in length")
    tags = b"".join(_tag(t) for t in row["tags"].split("\t") if t)
    pos, spans = row["pos"] - 1, sum(op >> 4 for op in ops if OPERATIONS[op & 15] in "MDN=X")
    if len(ops) > 65_535:  # longer ones stand in a tag
        tags += b"CGBI" + struct.pack(f"<I{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | OPERATIONS.index("S"), spans << 4 | OPERATIONS.index("N")]
    name = row["qname"].encode() + b"\0"
    of = lambda r: refs[row["rname"] if r == "=" else r]
    head = struct.pack("<iiBBHHHiiii", of(row["rname"]), pos, len(name), row["mapq"], _bin(max(0, pos), max(0, pos) + max(1, spans)), len(ops), row["flag"], len(seq), of(row["rnext"]), row["pnext"] - 1, row["tlen"])
    body = head + name + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def block_of(data: bytes) -> bytes:
    """Up to 65,280 bytes as one block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class Written(WriterCommitMessage):
    path: str


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.block, self.overwrite = options["path"], int(options.get("blockBytes", 65_280)), overwrite
        self.refs = [tuple(r) for r in json.loads(options.get("references", "[]"))]
        lines = [options.get("header", "@HD\tVN:1.6\tSO:unknown"), *(f"@SQ\tSN:{n}\tLN:{size}" for n, size in self.refs)]
        text = "".join(line + "\n" for line in lines).encode()
        self.head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.refs))
        self.head += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in self.refs)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        # an attempt's own name, hidden until it is committed
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.bam"
        codes = {"*": -1} | {n: k for k, (n, _) in enumerate(self.refs)}
        with system.open_output_stream(f"{folder}/_{name}") as out:
            held = bytearray(self.head)
            for batch in batches:
                for row in batch.to_pylist():
                    held += _record(row, codes)
                    while len(held) >= self.block:
                        out.write(block_of(bytes(held[: self.block])))
                        del held[: self.block]
            if held:
                out.write(block_of(bytes(held)))
            out.write(END_BLOCK)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = _open(self.path)
        written = {m.path for m in messages if m is not None}
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith("part-") and self.overwrite:
                system.delete_file(f.path)
            elif f.base_name.startswith("_part-") and f.base_name[1:] not in written:  # of attempts that failed
                system.delete_file(f.path)
        for name in written:
            system.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{folder}/_{m.path}")


class BamSource(DataSource):
    """``spark.read.format("bam")`` after ``spark.dataSource.register(BamSource)``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options, overwrite)


def read_bam(spark: SparkSession, path: str | list[str], split_bytes: int = 64 << 20) -> DataFrame:
    """The columns of ``read_sam``; a path is a file or a folder of them."""
    ship_package(spark)
    spark.dataSource.register(BamSource)
    paths = [path] if isinstance(path, str) else path
    return spark.read.format("bam").option("paths", json.dumps(paths)).option("splitBytes", split_bytes).load()


def write_bam(df: DataFrame, path: str, references: list[tuple[str, int]], block_bytes: int = 65_280) -> None:
    """Rows of ``read_sam``'s columns as a folder of BAM files; ``references`` are (name, length)."""
    ship_package(df.sparkSession)
    df.sparkSession.dataSource.register(BamSource)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    df.select(*columns).write.format("bam").mode("append").option("references", json.dumps(references)).option("blockBytes", block_bytes).save(path)
