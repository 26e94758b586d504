"""Files that Spark's own sources can't read or write as whole: digests of files
of any size, one JSON object whose entries come from all tasks, and a file for
each row.

The first two are Python data sources. They open paths through Arrow's file systems (local
and shared folders, HDFS, S3, GCS), chunk by chunk, so memory doesn't depend on a
file's size.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CHUNK, TOGETHER = 1 << 20, 1 << 27
_SPACE = re.compile(r"[ \t\n\r]*")


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of ``path``, the path there, and what stands before it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside, path[: len(path.rstrip("/")) - len(inside.rstrip("/"))]


def readable(path: str) -> bool:
    """Whether Arrow knows the file system of ``path`` (some only Spark does)."""
    try:
        opened(path)
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False
    return True


def below(path: str) -> list[fs.FileInfo]:
    """The file ``path``, or the files below it but hidden ones, by name."""
    system, at, _ = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [info]
    hidden = lambda p: any(x.startswith((".", "_")) for x in p[len(at) :].split("/"))
    return sorted((x for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.is_file and not hidden(x.path)), key=lambda x: x.path)


# ---- digests ----------------------------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: list[str]


class Digests(DataSource):
    """file, bytes, chunks, sha256 of every file below ``path`` but hidden ones.
    Files are dealt to tasks of about ``together`` bytes, or one file; each is
    read in chunks of ``chunk`` bytes."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "file string, bytes long, chunks long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _DigestReader(self.options["path"], int(self.options.get("chunk", CHUNK)), int(self.options.get("together", TOGETHER)))


class _DigestReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, together: int) -> None:
        self.path, self.chunk, self.together = path, chunk, together

    def partitions(self) -> list[InputPartition]:
        out, size = [], 0
        for x in below(self.path):
            if not out or size + x.size > self.together:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(x.path)
            size += x.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _, before = opened(self.path)
        for path in partition.paths:
            digest, size, chunks = hashlib.sha256(), 0, 0
            with system.open_input_stream(path) as stream:
                while block := stream.read(self.chunk):
                    digest.update(block)
                    size += len(block)
                    chunks += 1
            yield before + path, size, chunks, digest.hexdigest()


def digests(spark: SparkSession, path: str, chunk: int = CHUNK, together: int = TOGETHER) -> DataFrame:
    """file, bytes, chunks, sha256 of every file below ``path``, however large; an
    empty one has no chunks. A missing path is an error, an empty folder has no rows."""
    spark.dataSource.register(Digests)
    return spark.read.format("file_digests").options(chunk=chunk, together=together).load(path)


# ---- entries of JSON objects ----------------------------------------------------------------------------------------------


class Entries(DataSource):
    """key, value (JSON text) of every entry of the JSON objects in the files below
    ``path``, a task for each file, which holds one entry at a time."""

    @classmethod
    def name(cls) -> str:
        return "json_entries"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _EntryReader(self.options["path"], int(self.options.get("chunk", CHUNK)))


class _EntryReader(DataSourceReader):
    def __init__(self, path: str, chunk: int) -> None:
        self.path, self.chunk = path, chunk

    def partitions(self) -> list[InputPartition]:
        return [Files([x.path]) for x in below(self.path)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _, _ = opened(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                yield from entries_of(stream, self.chunk)


def entries_of(stream, chunk: int) -> Iterator[tuple[str, str]]:
    """(key, JSON text of the value) of the object in ``stream``. Text is read until
    the next key or value is whole; what is read at once doubles while it isn't."""
    decode, incoming = json.JSONDecoder().raw_decode, codecs.getincrementaldecoder("utf-8-sig")()
    text, at, ended = "", 0, False

    def more(size: int) -> None:
        nonlocal text, at, ended
        block = stream.read(size)
        ended = not block
        text, at = text[at:] + incoming.decode(block, ended), 0

    def mark() -> str:
        nonlocal at
        while True:
            at = _SPACE.match(text, at).end()
            if at < len(text):
                at += 1
                return text[at - 1]
            if ended:
                raise ValueError("the object ends too early")
            more(chunk)

    def whole() -> tuple[object, str]:
        nonlocal at
        if mark() in "]},:":
            raise ValueError("a key or value is missing")
        at -= 1
        size = chunk
        while True:
            try:
                found, end = decode(text, at)
            except json.JSONDecodeError:
                if ended:
                    raise
                end = len(text)
            if end < len(text) or ended:  # a number at the end may go on
                begin, at = at, end
                return found, text[begin:end]
            size *= 2
            more(size)

    if mark() != "{":
        raise ValueError("not a JSON object")
    if mark() == "}":
        return
    at -= 1
    while True:
        key, _ = whole()
        if not isinstance(key, str) or mark() != ":":
            raise ValueError("not a JSON object")
        yield key, whole()[1]
        after = mark()
        if after == "}":
            return
        if after != ",":
            raise ValueError("not a JSON object")


def entries(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """key, value (JSON text as it stands there) of the objects in the files below
    ``path``, however they are laid out and however large. A key that comes twice
    gives two rows; what isn't an object raises."""
    spark.dataSource.register(Entries)
    return spark.read.format("json_entries").option("chunk", chunk).load(path)


# ---- one JSON object --------------------------------------------------------------------------------------------------


@dataclass
class Part(WriterCommitMessage):
    number: int
    file: str
    rows: int
    first: str | None
    last: str | None


class JsonObject(DataSource):
    """Writes rows (key, value: JSON text) as the entries of one object, a line
    each, in one file. Each task streams its sorted rows to a part of its own;
    the commit joins the parts of the tasks that succeeded, chunk by chunk, and
    renames the result, so that the file appears whole or not at all."""

    @classmethod
    def name(cls) -> str:
        return "json_object"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ObjectWriter(self.options["path"], overwrite)


class _ObjectWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        system, at, _ = opened(path)
        if not overwrite and system.get_file_info(at).type != fs.FileType.NotFound:
            raise FileExistsError(path)
        self.path = path
        self.parts = posixpath.join(posixpath.dirname(at), f".{posixpath.basename(at)}-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        system, _, _ = opened(self.path)
        system.create_dir(self.parts, recursive=True)
        part = Part(context.partitionId(), f"{self.parts}/{context.partitionId():06d}-{context.taskAttemptId()}", 0, None, None)
        with system.open_output_stream(part.file) as out:
            for batch in iterator:
                lines = []
                for key, value in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    if key is None or part.last is not None and key <= part.last:
                        raise ValueError(f"an object's keys are sorted and differ: {key!r} after {part.last!r}")
                    lines.append((",\n" if part.rows else "") + json.dumps(key, ensure_ascii=False) + ":" + ("null" if value is None else value))
                    part.first, part.last, part.rows = key if part.first is None else part.first, key, part.rows + 1
                out.write("".join(lines).encode())
        return part

    def commit(self, messages: list[Part | None]) -> None:
        system, at, _ = opened(self.path)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.number)
        for a, b in zip(parts, parts[1:], strict=False):
            if a.last >= b.first:
                raise ValueError(f"an object's keys are sorted and differ: {b.first!r} after {a.last!r}")
        system.create_dir(self.parts, recursive=True)
        whole = f"{self.parts}/whole"
        with system.open_output_stream(whole) as out:
            out.write(b"{\n")
            for i, part in enumerate(parts):
                out.write(b",\n" if i else b"")
                with system.open_input_stream(part.file) as stream:
                    while block := stream.read(CHUNK):
                        out.write(block)
            out.write(b"\n}\n" if parts else b"}\n")
        system.move(whole, at)
        system.delete_dir(self.parts)

    def abort(self, messages: list[Part | None]) -> None:
        system, _, _ = opened(self.path)
        if system.get_file_info(self.parts).type != fs.FileType.NotFound:
            system.delete_dir(self.parts)


def json_object(rows: DataFrame, path: str, key: str, value: str, overwrite: bool = False) -> None:
    """``rows`` as one JSON object in one file: ``key`` (cast to text; neither null
    nor repeated) and ``value`` (JSON text; null is JSON's null), by key. No task
    holds more than a batch of rows, and a file that is there is an error unless
    ``overwrite`` replaces it. No rows give an empty object."""
    rows.sparkSession.dataSource.register(JsonObject)
    entries = rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    entries.repartitionByRange("key").sortWithinPartitions("key").write.format("json_object").mode("overwrite" if overwrite else "append").save(path)


def object_entries(spark: SparkSession, path: str) -> DataFrame:
    """key, value (JSON text; of a text the text itself) of an object that
    ``json_object`` wrote, read line by line: no task holds the file."""
    lines = spark.read.text(path).where("value not in ('{', '}')").select(F.concat(F.lit("{"), F.regexp_replace("value", ",$", ""), F.lit("}")).alias("line"))
    return lines.select(F.explode(F.from_json("line", "map<string,string>")).alias("key", "value"))


# ---- a file for each row ------------------------------------------------------------------------------------------------


#: How many files a folder gets, each folder being one task's.
FILES_A_FOLDER = 2000


def file_each(rows: DataFrame, path: str, name: str, text: str, suffix: str = ".txt", together: int = FILES_A_FOLDER) -> None:
    """A file below ``path``, a new folder, for each of ``rows``: ``name`` is its
    stem (a number follows where a task meets it again), ``text`` all it holds.
    Files are dealt to folders part=0, part=1, ... of about ``together``, and each
    folder is one task's, so tasks grow in number, not in size, and nothing is left
    for the driver to rename. A file is written under a hidden name and renamed, so
    that an attempt that fails leaves none behind that is cut short."""
    if not readable(path):  # only Spark knows the file system: its writer, whose commit is the driver's
        rows.select(F.col(text).alias("value"), F.pmod(F.hash(name), F.lit(50)).alias("part")).repartition("part").write.option("maxRecordsPerFile", 1).option("lineSep", "").partitionBy("part").text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, at, _ = opened(path)
        folder, times = f"{at}/part={context.partitionId()}", {}
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for stem, body in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = times[stem] = times.get(stem, -1) + 1
                hidden = f"{folder}/.{context.taskAttemptId()}"
                with system.open_output_stream(hidden) as out:
                    out.write((body or "").encode())
                system.move(hidden, f"{folder}/{stem}{f'-{n}' if n else ''}{suffix}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    named = rows.select(F.col(name).cast("string").alias("name"), F.col(text).alias("text"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // together))
    named.repartition(tasks, "name", F.xxhash64("text")).mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one number
