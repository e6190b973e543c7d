"""Files read and written by byte ranges in tasks, through the file systems that PyArrow knows."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from depgraph.session import Rounds


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a location: a local path, or a URI such as file:, hdfs: or s3:."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))


def open_range(uri: str, start: int, length: int) -> bytes:
    """``length`` bytes from ``start`` on; fewer where the file ends before."""
    files, path = place(uri)
    with files.open_input_file(path) as source:
        return source.read_at(length, start)


def byte_blocks(files: DataFrame, block_bytes: int, blocks_per_task: int = 16) -> DataFrame:
    """(file, block, data) of (file, bytes): each file in blocks of equal size, cut anywhere, the last one shorter.

    Tasks seek and read their own blocks, so one file is spread over many tasks and no file is a single value.
    """
    spark = files.sparkSession
    last = F.floor((F.col("bytes") - 1) / block_bytes).cast("bigint")
    ranges = files.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    total = files.agg(F.sum(F.ceil(F.col("bytes") / block_bytes))).first()[0] or 0
    tasks = max(1, min(int(total), max(spark.sparkContext.defaultParallelism, int(total) // blocks_per_task)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["block"] * block_bytes
                data = open_range(row["file"], start, min(block_bytes, row["bytes"] - start))
                if len(data) != min(block_bytes, row["bytes"] - start):
                    raise OSError(f"{row['file']} is shorter than {row['bytes']} bytes")
                yield pa.record_batch([
                    pa.array([row["file"]], pa.string()), pa.array([row["block"]], pa.int64()), pa.array([data], pa.binary()),
                ], ["file", "block", "data"])

    return ranges.repartition(tasks, "file", "block").mapInArrow(read, "file string, block bigint, data binary")


def _below(uri: str, top: str, path: str) -> str:
    """The location of ``path``, found below ``top`` on the file system of ``uri``, as that URI would name it."""
    return re.sub("^file:/+", "/", uri.rstrip("/")) + path[len(top.rstrip("/")):]


def list_tree(spark: SparkSession, root: str, skip_part: str) -> DataFrame:
    """(path, bytes) of all files below ``root``, whatever their names; folders called ``skip_part`` are not entered.

    Each round lists the folders that the round before found, in tasks, so the driver handles no file and
    no folder; there are as many rounds as the tree is deep.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                files, top = place(folder)
                found = [i for i in files.get_file_info(fs.FileSelector(top)) if i.type != fs.FileType.NotFound]
                found = [i for i in found if i.type == fs.FileType.File or i.base_name != skip_part]
                yield pa.record_batch([
                    pa.array([_below(folder, top, i.path) for i in found], pa.string()),
                    pa.array([i.size if i.type == fs.FileType.File else None for i in found], pa.int64()),
                ], ["path", "bytes"])

    rounds = Rounds(spark, "folders")
    folders, open_folders = spark.createDataFrame([(root,)], "path string"), 1
    while open_folders:
        tasks = max(1, min(open_folders, 4 * spark.sparkContext.defaultParallelism))
        listed = folders.repartition(tasks).mapInArrow(entries, "path string, bytes bigint")
        table, counts = rounds.add(listed, folders=F.count_if(F.col("bytes").isNull()))
        folders, open_folders = table.filter("bytes IS NULL").select("path"), counts["folders"]
    return rounds.all().filter("bytes IS NOT NULL")


def whole_texts(files: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """(path, text) of files (path, bytes); bytes that are no UTF-8 are replaced.  The files are dealt to tasks by
    the hash of their path, about a hundred megabytes or a thousand files to each."""
    spark = files.sparkSession
    size = files.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(1, min(size[0], max(spark.sparkContext.defaultParallelism, size[0] // 1000, (size[1] or 0) // (100 << 20))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([p for p, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], ["path", "text"])

        rows, held = [], 0
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist()):
                rows.append((path, open_range(path, 0, length).decode("utf-8", "replace")))
                held += length
                if held >= batch_bytes:
                    yield batch_of(rows)
                    rows, held = [], 0
        yield batch_of(rows)

    return files.select("path", "bytes").repartition(tasks, "path").mapInArrow(read, "path string, text string")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the files of a folder; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


# ---- one file from ordered rows --------------------------------------------------------------------

_COPY_BYTES = 8 << 20


@dataclass
class _Stretch(WriterCommitMessage):
    task: int
    name: str


class _OneFileWriter(DataSourceArrowWriter):
    """Takes (text), ordered over all tasks; see :func:`write_one_file`."""

    def __init__(self, path: str):
        self.path, self.parts = path, f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Stretch:
        files, folder = place(self.parts)
        files.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.part"
        with files.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                for text in batch.column("text").to_pylist():
                    out.write(text.encode())
        return _Stretch(TaskContext.get().partitionId(), name)

    def commit(self, messages: list[_Stretch | None]) -> None:
        files, folder = place(self.parts)
        _, target = place(self.path)
        digest = hashlib.sha256()
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/whole") as out:
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.task):
                with files.open_input_stream(f"{folder}/{part.name}") as piece:
                    while copied := piece.read(_COPY_BYTES):
                        out.write(copied)
                        digest.update(copied)
        with files.open_output_stream(f"{folder}/digest") as out:
            out.write(digest.hexdigest().encode())
        files.move(f"{folder}/whole", target)
        files.move(f"{folder}/digest", f"{target}.sha256")
        files.delete_dir(folder)

    def abort(self, messages: list[_Stretch | None]) -> None:
        files, folder = place(self.parts)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class OneFileSource(DataSource):
    """Format ``one_file``, for writing only: option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "one_file"

    def schema(self) -> str:
        return "text string"

    def writer(self, schema, overwrite: bool) -> _OneFileWriter:
        return _OneFileWriter(self.options["path"])


def write_one_file(lines: DataFrame, order: list[str], path: str) -> str:
    """Writes the column ``text`` of all rows, in order and with nothing in between, to one file.

    Tasks write a range of the order each; the commit appends the ranges piece by piece to a file that takes its
    name at the end.  Next to it, in ``<path>.sha256``, stands the digest of its bytes, which is returned.  Rows
    whose order is unique give the same bytes however they are partitioned.
    """
    lines.sparkSession.dataSource.register(OneFileSource)
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("text")
    ranged.write.format("one_file").mode("append").save(path)
    return stored_digest(path)


def stored_digest(path: str) -> str:
    files, target = place(f"{path}.sha256")
    with files.open_input_stream(target) as source:
        return source.read().decode()
