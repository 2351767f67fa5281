"""Files from archives, folders and JSON requests."""

from __future__ import annotations

import io
import json
import os
import struct
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.operators.selection import (
    ANALYZED_EXTENSIONS,
    IGNORED_FOLDER,
    IGNORED_PARTS,
    INVALID_ENCODING,
    MISSING_REQUIRED_FIELD,
    NO_NAME,
    OTHER_EXTENSION,
    TOO_LARGE,
    wanted,
)
from codegauge.workspace import shared_folder

# The usual limit of an archive, names for missing fields.
MAX_ARCHIVE_BYTES = 25 * 1024 * 1024
UNKNOWN_PATH = "unknown"

ENTRY_SCHEMA = (
    "archive string, entry_index int, path string, content string, size_bytes bigint, error string"
)
_FLUSH_BYTES = 16 * 1024 * 1024
SPLIT_BYTES, SLICE_ENTRIES, MOST_TASKS = 32 * 1024 * 1024, 5000, 100_000
# Files are dealt to tasks as if each had so many bytes more, folders and tables of contents by number.
FILE_COST, FOLDERS_OF_TASK = 64 * 1024, 1000
SEEKABLE = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")  # file systems that can be opened from a task
# Fixed value: the header before each entry's bytes; its last two fields are the sizes of name and extra.
LOCAL_HEADER = struct.Struct("<4sHHHHHLLLHH")


def read_archives(
    spark: SparkSession, folder: str, max_archive_bytes: int | None = None, split_bytes: int = SPLIT_BYTES, **options
) -> DataFrame:
    """Entries of all zip archives below a folder.

    Archives are listed, then the table of contents at the end of each is read by seeking, and
    its wanted entries are cut into slices of about ``split_bytes`` packed bytes. Slices are
    dealt to the tasks, which seek to their entries, so an archive may be of any size and one
    large archive is read by many tasks. Where the file system cannot be opened for seeking
    from Python, whole archives are read as single values instead.

    With a limit, an archive over it is not opened: it comes out as one row with its
    size and ``error``.
    """
    root = folder_in_tasks(spark, folder)
    if root is None:
        found = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.zip")
            .option("recursiveFileLookup", "true")
            .load(folder)
        )
    else:
        archives = listed_files(spark, root).where(F.col("path").endswith(".zip"))
        found = archives.select(F.concat(F.lit(f"{root}/"), "path").alias("path"), "length")
    small = found if max_archive_bytes is None else found.where(F.col("length") <= max_archive_bytes)
    if root is None:
        entries = archive_entries(small.select(F.col("path").alias("archive"), "content"), **options)
    else:
        n, total = small.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        dealt = small.select(F.col("path").alias("archive")).repartition(tasks_for(spark, n, FOLDERS_OF_TASK), "archive")
        slices = archive_slices(dealt, split_bytes, **options)
        tasks = min(max(1, -(-total // split_bytes)), MOST_TASKS)
        entries = slice_entries(slices.repartition(tasks, "archive", "slice"))
    if max_archive_bytes is None:
        return entries
    none = F.lit(None)
    refused = found.where(F.col("length") > max_archive_bytes).select(
        F.col("path").alias("archive"), none.cast("int").alias("entry_index"), none.cast("string").alias("path"),
        none.cast("string").alias("content"), F.col("length").alias("size_bytes"), F.lit(TOO_LARGE).alias("error"),
    )
    return entries.unionByName(refused)


def folder_in_tasks(spark: SparkSession, folder: str) -> str | None:
    """The qualified name of a folder that tasks can list and open themselves, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getUri().getScheme() not in SEEKABLE or not system.exists(path) or not system.getFileStatus(path).isDirectory():
        return None
    return system.makeQualified(path).toString().rstrip("/")


def tasks_for(spark: SparkSession, things: int, each: int) -> int:
    """Tasks of about ``each`` things, but all cores where there is enough for them."""
    return max(1, min(things, MOST_TASKS, max(spark.sparkContext.defaultParallelism, -(-things // each))))


def passed_over(name: str, folder: bool) -> bool:
    """Names that Spark's file sources do not read."""
    if folder and name.startswith(("_common_metadata", "_metadata")):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def children(place: str) -> Iterator[tuple[str, int, bool]]:
    """(name, length, whether it is a folder) of what lies in a folder, named as Spark names it."""
    import pyarrow.fs as fs

    if place.startswith("file:"):
        with os.scandir(local_path(place)) as found:
            for entry in found:
                try:
                    folder = entry.is_dir()
                    yield entry.name, 0 if folder else entry.stat().st_size, folder
                except FileNotFoundError:  # it went since, or is a link to nothing
                    continue
        return
    system, base = fs.FileSystem.from_uri(quote(place.replace("s3a://", "s3://"), safe=":/"))
    for info in system.get_file_info(fs.FileSelector(base)):
        folder = info.type == fs.FileType.Directory
        yield info.base_name, 0 if folder else info.size, folder


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file below a folder that ``folder_in_tasks`` named, paths from there on.

    Folders are listed by the tasks, level by level, and what they hold is written, so neither
    the driver nor a task holds the whole list. A folder is listed by one task. Names that
    Spark's file sources pass over, and files of no length, are left out.
    """
    import pyarrow as pa

    names, schema = ["path", "length", "folder"], "path string, length bigint, folder boolean"

    def run(batches):
        for batch in batches:
            for above in batch.column(0).to_pylist():
                held = []
                for name, length, folder in children(f"{root}/{above}" if above else root):
                    if not passed_over(name, folder) and (folder or length):
                        held.append((f"{above}/{name}" if above else name, length, folder))
                    if len(held) == SLICE_ENTRIES:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)

    at, depth = shared_folder(spark, "listing"), 0
    level = spark.createDataFrame([("",)], "path string")
    while True:
        level.mapInArrow(run, schema).write.parquet(f"{at}/depth={depth}")
        folders = spark.read.schema(schema).parquet(f"{at}/depth={depth}").where("folder").select("path")
        n, depth = folders.count(), depth + 1
        if not n:
            break
        level = folders.repartition(tasks_for(spark, n, FOLDERS_OF_TASK), "path")
    found = spark.read.schema(schema).parquet(*(f"{at}/depth={k}" for k in range(depth)))
    return found.where(~F.col("folder")).select("path", "length")


def local_path(place: str) -> str:
    return "/" + place.removeprefix("file:").lstrip("/")


class Sought(io.RawIOBase):
    """A file of any pyarrow file system with Python's rules for seeking."""

    def __init__(self, file) -> None:
        self.file, self.size, self.at = file, file.size(), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.at, self.size)[whence]
        if at < 0:
            raise OSError("before the start of the file")
        self.at = at
        return at

    def readinto(self, buffer) -> int:
        data = self.file.read_at(max(0, min(len(buffer), self.size - self.at)), self.at)
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def opened(place: str, buffer: int = 1 << 20) -> io.BufferedReader | Sought:
    """A file that can be sought, by the path Spark names it with; with no buffer, to read it at once."""
    import pyarrow.fs as fs

    if place.startswith("file:"):
        file = fs.LocalFileSystem().open_input_file(local_path(place))
    else:
        system, inner = fs.FileSystem.from_uri(quote(place.replace("s3a://", "s3://"), safe=":/"))
        file = system.open_input_file(inner)
    return io.BufferedReader(Sought(file), buffer) if buffer else Sought(file)


def judge(extensions: Sequence[str], ignored: Sequence[str], max_bytes: int | None):
    """The reason why an entry is not wanted, or None, from its path and size."""
    allowed, skipped = set(extensions), set(ignored)

    def reason(path: str, size: int) -> str | None:
        parts = path.lower().split("/")
        stem, dot, ext = parts[-1].rpartition(".")
        if not path.strip():
            return NO_NAME
        if not skipped.isdisjoint(parts):
            return IGNORED_FOLDER
        if dot + ext not in allowed:
            return OTHER_EXTENSION
        return TOO_LARGE if max_bytes is not None and size > max_bytes else None

    return reason


def listed(infos: Sequence[zipfile.ZipInfo], reason, rejects: bool) -> Iterator[tuple[int, str, str | None, zipfile.ZipInfo]]:
    """(entry_index, path below the root folder, reject reason, entry) of what an archive has to give."""
    root = infos[0].filename.split("/")[0] + "/" if infos else ""
    for i, info in enumerate(infos):
        if info.filename.endswith("/"):
            continue
        path = info.filename.removeprefix(root)
        why = reason(path, info.file_size)
        if not why or rejects or why == TOO_LARGE:
            yield i, path, why, info


def archive_slices(
    archives: DataFrame,
    split_bytes: int = SPLIT_BYTES,
    max_bytes: int | None = None,
    extensions: tuple[str, ...] = ANALYZED_EXTENSIONS,
    ignored: tuple[str, ...] = IGNORED_PARTS,
    rejects: bool = False,
) -> DataFrame:
    """(archive, slice, entries, error): where the entries of each archive lie, in slices.

    Only the table of contents is read. ``entries`` is a JSON list of what ``slice_entries``
    needs; an archive whose contents cannot be read is one row with ``error``.
    """
    reason = judge(extensions, ignored, max_bytes)

    def cut(name: str) -> Iterator[tuple]:
        held, size, number = [], 0, 0
        try:
            with opened(name) as file, zipfile.ZipFile(file) as archive:
                infos = archive.infolist()
        except Exception as e:  # noqa: BLE001 - any broken archive is reported, not fatal
            yield name, 0, "[]", f"{type(e).__name__}: {e}"
            return
        for i, path, why, info in listed(infos, reason, rejects):
            fields = (info.header_offset, info.compress_type, info.CRC, info.compress_size, info.file_size, info.flag_bits)
            held.append((i, path, why, info.orig_filename, *fields))
            size += 0 if why else info.compress_size
            if size >= split_bytes or len(held) >= SLICE_ENTRIES:
                yield name, number, json.dumps(held), None
                held, size, number = [], 0, number + 1
        if held:
            yield name, number, json.dumps(held), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["archive"]:
                for row in cut(name):
                    yield pd.DataFrame([row], columns=["archive", "slice", "entries", "error"])

    return archives.select("archive").mapInPandas(run, "archive string, slice int, entries string, error string")


def unpacked(file, name: str, offset: int, method: int, crc: int, packed: int, size: int, flags: int) -> bytes:
    """One entry's bytes, decompressed and checked, read from where its header lies."""
    if flags & 0x1:
        raise RuntimeError(f"File {name!r} is encrypted, password required for extraction")
    file.seek(offset)
    header = file.read(LOCAL_HEADER.size)
    if len(header) < LOCAL_HEADER.size or header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("Bad magic number for file header")
    *_, name_size, extra_size = LOCAL_HEADER.unpack(header)
    file.seek(offset + LOCAL_HEADER.size + name_size + extra_size)
    info = zipfile.ZipInfo(name)
    info.compress_type, info.CRC, info.compress_size, info.file_size, info.flag_bits = method, crc, packed, size, flags
    with zipfile.ZipExtFile(file, "r", info) as stream:
        return stream.read()


def slice_entries(slices: DataFrame) -> DataFrame:
    """The entries of slices as rows, each slice read by seeking in its archive."""
    columns = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]

    def entries(name: str, listed: str, error: str | None) -> Iterator[tuple]:
        if error:
            yield name, None, None, None, None, error
            return
        file = None
        for i, path, why, inner, *place in json.loads(listed):
            size = place[4]
            if why:
                yield name, i, path, None, size, why
                continue
            try:
                file = file or opened(name)
                text = unpacked(file, inner, *place).decode("utf-8-sig", errors="replace")
                yield name, i, path, text, size, None
            except Exception as e:  # noqa: BLE001 - an entry that cannot be unpacked is a row
                yield name, i, path, None, size, f"{type(e).__name__}: {e}"
        if file:
            file.close()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for name, listed, error in zip(batch["archive"], batch["entries"], batch["error"], strict=True):
                for row in entries(name, listed, error):
                    rows.append(row)
                    size += row[4] or 0
                    if size >= _FLUSH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return slices.mapInPandas(run, ENTRY_SCHEMA)


def archive_entries(
    archives: DataFrame,
    max_bytes: int | None = None,
    extensions: tuple[str, ...] = ANALYZED_EXTENSIONS,
    ignored: tuple[str, ...] = IGNORED_PARTS,
    rejects: bool = False,
) -> DataFrame:
    """(archive, content) rows to one row per wanted entry.

    Unwanted names are left out before anything is unpacked; with ``rejects`` they come
    out as rows with the reason as ``error``, as an entry over a given size always does.
    The root folder (first part of the first entry) is taken off the paths. An entry that
    cannot be unpacked becomes a row with ``error`` and no content; so does an archive.
    """
    reason = judge(extensions, ignored, max_bytes)

    def entries(name: str, payload: bytes) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(payload))
        except Exception as e:  # noqa: BLE001 - any broken archive is reported, not fatal
            yield name, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for i, path, why, info in listed(archive.infolist(), reason, rejects):
            if why:
                yield name, i, path, None, info.file_size, why
                continue
            try:
                text = archive.read(info).decode("utf-8-sig", errors="replace")
                yield name, i, path, text, info.file_size, None
            except Exception as e:  # noqa: BLE001
                yield name, i, path, None, info.file_size, f"{type(e).__name__}: {e}"

    columns = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for name, payload in zip(batch["archive"], batch["content"], strict=True):
                for row in entries(name, payload):
                    rows.append(row)
                    size += row[4] or 0
                    if size >= _FLUSH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return archives.select("archive", "content").mapInPandas(unpack, ENTRY_SCHEMA)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text: a byte order mark goes, bad bytes become the replacement character."""
    marked = F.substring(content, 1, 3) == F.lit(b"\xef\xbb\xbf")
    plain = F.when(marked, F.substring(content, F.lit(4), F.length(content))).otherwise(content)
    return F.make_valid_utf8(plain.cast("string"))


def read_files(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Loose files below a folder as rows, with the same text an archive of them gives.

    Paths start below the folder. Unwanted names and sizes are not read at all; files of no
    length are passed over. Files are listed and read by the tasks, dealt by number and size;
    where the file system cannot be opened from Python, Spark's file source does both.
    """
    root = folder_in_tasks(spark, folder)
    path, size = F.col("path"), F.col("length")
    if root is not None:
        kept = listed_files(spark, root).where(wanted(path, size, **options))
        n, total = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        kept = kept.repartition(tasks_for(spark, n, max(1, n * SPLIT_BYTES // (total + n * FILE_COST))) if n else 1, "path")
        return read_listed(kept, root).select(path, decoded(F.col("content")).alias("content"), size.alias("size_bytes"))
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    kept = source.where(wanted(path, size, **options))
    return kept.select(path.alias("path"), decoded(F.col("content")).alias("content"), size.alias("size_bytes"))


def read_listed(files: DataFrame, root: str) -> DataFrame:
    """(path, length) rows of files below ``root`` with their bytes as ``content``."""
    import pyarrow as pa

    names = ["path", "length", "content"]

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and held + length > _FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                    rows, held = [], 0
                with opened(f"{root}/{path}", 0) as file:
                    rows.append((path, length, file.read()))
                held += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return files.select("path", "length").mapInArrow(run, "path string, length bigint, content binary")


def parse_batches(requests: DataFrame) -> DataFrame:
    """(batch_id, body) rows to one row per file; a batch without files keeps one empty row."""
    schema = "files array<struct<path:string,content:string>>"
    files = F.from_json("body", schema)["files"]
    rows = requests.select("batch_id", F.posexplode_outer(files).alias("entry_index", "file"))
    present = F.col("entry_index").isNotNull()
    return rows.select(
        "batch_id",
        "entry_index",
        F.when(present, F.coalesce("file.path", F.lit(UNKNOWN_PATH))).alias("path"),
        F.when(present, F.coalesce("file.content", F.lit(""))).alias("content"),
    )


def parse_snippets(requests: DataFrame) -> DataFrame:
    """(request_id, body) rows to one file row each, with an error code where rejected.

    Code that is missing, empty or "0" counts as not given.
    """
    fields = F.from_json("body", "code string, file_path string")
    parsed = requests.select("request_id", fields.alias("f")).select(
        "request_id",
        F.coalesce("f.file_path", F.lit(UNKNOWN_PATH)).alias("path"),
        F.col("f.code").alias("content"),
    )
    given = F.coalesce(~F.col("content").isin("", "0"), F.lit(False))
    error = F.when(~given, MISSING_REQUIRED_FIELD).when(
        ~F.is_valid_utf8("content"), INVALID_ENCODING
    )
    return parsed.withColumn("error_code", error)


def with_size(files: DataFrame) -> DataFrame:
    return files.withColumn("size_bytes", F.octet_length("content").cast("long"))
