"""SFF (Standard Flowgram Format) files, by the public layout: big-endian, sections padded to 8 bytes."""

from __future__ import annotations

import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_MAGIC = 0x2E736666
_COMMON = struct.Struct(">IIQIIHHHB")
_READ = struct.Struct(">HHIHHHH")
SCHEMA = "file string, read_id long, name string, sequence string, quality string, raw binary"


def _padded(n: int) -> int:
    return (n + 7) // 8 * 8


def parse_header(data: bytes) -> dict:
    """Fields of the common header."""
    magic, version, index_offset, index_length, n, header, key, flows, code = _COMMON.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not an SFF file")
    return {"n_reads": n, "header_length": header, "key_length": key, "flows": flows, "index": (index_offset, index_length)}


def parse_reads(data: bytes, trim: bool = True):
    """(name, bases, quality, raw bytes) of each read; with ``trim`` clipped on both sides."""
    head = parse_header(data)
    at, (skip, skip_length) = head["header_length"], head["index"]
    for _ in range(head["n_reads"]):
        if skip and at == skip:
            at += _padded(skip_length)
        begin = at
        header, name_length, n, ql, qr, al, ar = _READ.unpack_from(data, at)
        name = data[at + _READ.size : at + _READ.size + name_length].decode()
        body = at + header
        bases_at = body + 2 * head["flows"] + n
        bases = data[bases_at : bases_at + n].decode()
        scores = data[bases_at + n : bases_at + 2 * n]
        at = body + _padded(2 * head["flows"] + 3 * n)
        left, right = 0, n
        if trim:
            left = max(1, ql, al) - 1
            right = min(qr or n, ar or n)
        quality = "".join(chr(33 + q) for q in scores[left:right])
        yield name, bases[left:right], quality, data[begin:at]


def read_sff(spark: SparkSession, path: str, trim: bool = True) -> DataFrame:
    """Reads of SFF files, from any store Spark reads; a file is parsed by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, i, *r) for i, r in enumerate(parse_reads(content, trim))]
                for s in range(0, len(rows), 5000):
                    cols = list(zip(*rows[s : s + 5000], strict=True))
                    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                        names=["file", "read_id", "name", "sequence", "quality", "raw"],
                    )

    return files.mapInArrow(run, SCHEMA)


def common_header(spark: SparkSession, path: str) -> bytes:
    """Raw common header of an SFF file."""
    content = spark.read.format("binaryFile").load(path).select(F.expr("substring(content, 1, 65536)")).first()[0]
    return bytes(content[: parse_header(bytes(content))["header_length"]])


def with_count(header: bytes, n: int) -> bytes:
    """A common header for ``n`` reads and without an index."""
    out = bytearray(header)
    struct.pack_into(">QII", out, 8, 0, 0, n)
    return bytes(out)


def record(name: str, bases: str, scores: bytes, flows: int, left: int = 0, right: int = 0) -> bytes:
    """Raw bytes of a read with empty flow values; ``left`` and ``right`` are its 1-based quality clips, 0 for none."""
    head = _READ.pack(_padded(_READ.size + len(name)), len(name), len(bases), left, right, 0, 0) + name.encode()
    body = bytes(2 * flows + len(bases)) + bases.encode() + scores
    return head.ljust(_padded(len(head)), b"\0") + body.ljust(_padded(len(body)), b"\0")


def header(flows: bytes = b"TACG", key: bytes = b"TCAG") -> bytes:
    """A common header for no reads and no index."""
    size = _padded(_COMMON.size + len(flows) + len(key))
    return (_COMMON.pack(_MAGIC, 1, 0, 0, 0, size, len(key), len(flows), 1) + flows + key).ljust(size, b"\0")


#: Bytes of records held before a file is written.
FILE_BYTES = 64_000_000


class _Commit(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class _Writer(DataSourceArrowWriter):
    """Writes files under a folder of its own; the driver's commit moves those of the attempts that count."""

    def __init__(self, path: str, header: bytes, overwrite: bool):
        self.path, self.header, self.overwrite = path, header, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _store(self):
        from pyarrow import fs

        path = self.path if "://" in self.path else re.sub("^file:/+", "/", self.path)
        store, top = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return store, top.rstrip("/")

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context, (store, top) = TaskContext.get(), self._store()
        part, attempt = context.partitionId(), context.taskAttemptId()
        held: dict[str, list[bytes]] = {}
        size, files = 0, []

        def flush():
            for name, records in held.items():
                place = f"bucket={name}/part-{part:05d}-{len(files):05d}.sff"
                staged = f"{top}/{self.staging}/{attempt}/{place}"
                store.create_dir(staged.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(staged) as out:
                    out.write(with_count(self.header, len(records)))
                    for raw in records:
                        out.write(raw)
                files.append((staged, f"{top}/{place}"))
            held.clear()

        for batch in iterator:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(name, []).append(raw)
                size += len(raw)
                if size >= FILE_BYTES:
                    flush()
                    size = 0
        flush()
        return _Commit(files)

    def commit(self, messages) -> None:
        store, top = self._store()
        if self.overwrite:
            from pyarrow import fs

            for old in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if old.base_name.startswith("bucket="):
                    store.delete_dir(old.path)
        run = uuid.uuid4().hex[:8]
        for message in messages:
            for staged, final in message.files if message else ():
                store.create_dir(final.rsplit("/", 1)[0], recursive=True)
                store.move(staged, final.removesuffix(".sff") + f"-{run}.sff")
        self.abort(messages)

    def abort(self, messages) -> None:
        store, top = self._store()
        store.delete_dir_contents(f"{top}/{self.staging}", missing_dir_ok=True)
        from pyarrow import fs

        if store.get_file_info(f"{top}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{top}/{self.staging}")


class SffDataSource(DataSource):
    """``format("sff")`` for writing (bucket, raw) to a path of any store that pyarrow knows and the driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "sff"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], bytes.fromhex(self.options["header"]), overwrite)


def write_sff(records: DataFrame, path: str, header: bytes, mode: str = "append") -> None:
    """Write (bucket, raw) rows to SFF files in a folder per bucket, each with its own count.

    Files hold at most about FILE_BYTES of records, so a task's memory is
    bounded; a retried or speculative task's files never reach the folder.
    """
    records.sparkSession.dataSource.register(SffDataSource)
    records.select("bucket", "raw").write.format("sff").option("header", header.hex()).mode(mode).save(path)
