"""The block pack: all modules' blocks in one file that is read by byte ranges.

Layout: eight bytes with the length of the header (little-endian), the header as compact JSON, then the blocks of
all modules one after the other, in the order of module names.  The header says at which byte behind it each
block starts (``o``) and how long it is (``l``).

Tasks write their stretch of the blocks as parts; the commit knows all lengths, writes the header and appends the
parts, piece by piece, to a new file that takes the pack's name at the end.  Parts of failed attempts are
not named by any commit message and are deleted with the folder.  The reader fetches the header once and hands
out byte ranges, a filter on the module leaves only the ranges of that module.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)

from depgraph.operators.blocks import SCHEMA_VERSION, Blocks
from depgraph.sources.byte_files import open_range, place

FORMAT = "block_pack"
_PREFIX = struct.Struct("<Q")
#: Bytes that a read task fetches at least before another is made, and the longest piece of a block in one row.
RANGE_BYTES, CHUNK_BYTES = 16 << 20, 32 << 20
_COPY_BYTES = 8 << 20


def block_lines(blocks: Blocks) -> DataFrame:
    """(module, part, a, b, text): the blocks as the pieces of their JSON, which follow each other in this order.

    A row is one declaration, one edge or a bracket, so a block of any size is never one value.
    """
    named = F.to_json(F.struct("name", "k", "x", "y", "s"))
    modules = blocks.decls.select("module").distinct()
    quoted = F.to_json(F.array("module"))  # a name as JSON, between the brackets of a list
    opening = F.concat(
        F.lit(f'{{"schemaVersion":{SCHEMA_VERSION},"module":'), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(',"decls":[')
    )
    first = blocks.edges.groupBy("module").agg(F.min(F.struct("src_idx", "dst_idx")).alias("first"))

    def bracket(part: int, text: Column) -> DataFrame:
        none = F.lit(0).cast("bigint")
        return modules.select("module", F.lit(part).alias("part"), none.alias("a"), none.alias("b"), text.alias("text"))

    decls = blocks.decls.select(
        "module", F.lit(1).alias("part"), F.col("idx").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"),
        F.concat(F.when(F.col("idx") > 0, ",").otherwise(""), named).alias("text"),
    )
    is_first = F.col("first") == F.struct("src_idx", "dst_idx")
    edges = blocks.edges.join(first, "module").select(
        "module", F.lit(3).alias("part"), F.col("src_idx").cast("bigint").alias("a"), F.col("dst_idx").cast("bigint").alias("b"),
        F.concat(F.when(is_first, "").otherwise(","), F.lit("["), "src_idx", F.lit(","), "dst_idx", F.lit("]")).alias("text"),
    )
    rows = bracket(0, opening).unionByName(decls).unionByName(bracket(2, F.lit('],"e":['))).unionByName(edges).unionByName(bracket(4, F.lit("]}")))
    order = ["module", "part", "a", "b"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


# ---- writer --------------------------------------------------------------------------------------

@dataclass
class _Part(WriterCommitMessage):
    """A part's file, the place of its first row, and the bytes of each of its modules in order."""

    name: str
    first: tuple
    lengths: list[tuple[str, int]]


class _PackWriter(DataSourceArrowWriter):
    """Takes (module, part, a, b, text), ordered over all tasks."""

    def __init__(self, options: dict[str, str]):
        self.path, self.meta = options["path"], json.loads(options.get("meta", "{}"))
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part | None:
        files, folder = place(self.parts)
        files.create_dir(folder, recursive=True)
        name, first, lengths = f"{uuid.uuid4().hex}.part", None, []
        with files.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                rows = batch.to_pydict()
                for module, text, *order in zip(rows["module"], rows["text"], rows["part"], rows["a"], rows["b"]):
                    first = first or (module, *order)
                    raw = text.encode()
                    out.write(raw)
                    if not lengths or lengths[-1][0] != module:
                        lengths.append((module, 0))
                    lengths[-1] = (module, lengths[-1][1] + len(raw))
        return _Part(name, first or (), lengths)

    def commit(self, messages: list[_Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.lengths), key=lambda m: (m.first[0].encode(), *m.first[1:]))
        ranges: dict[str, dict[str, int]] = {}
        offset = 0
        for part in parts:
            for module, length in part.lengths:
                own = ranges.setdefault(module, {"o": offset, "l": 0})
                own["l"] += length
                offset += length
        header = {"schemaVersion": SCHEMA_VERSION, "meta": self.meta, "modules": ranges}
        raw = json.dumps(header, separators=(",", ":")).encode()
        files, target = place(self.path)
        _, folder = place(self.parts)
        files.create_dir(folder, recursive=True)
        whole = f"{folder}/whole"
        with files.open_output_stream(whole) as out:
            out.write(_PREFIX.pack(len(raw)) + raw)
            for part in parts:
                with files.open_input_stream(f"{folder}/{part.name}") as piece:
                    while copied := piece.read(_COPY_BYTES):
                        out.write(copied)
        files.move(whole, target)
        files.delete_dir(folder)

    def abort(self, messages: list[_Part | None]) -> None:
        files, folder = place(self.parts)
        if files.get_file_info(folder).type.name == "Directory":
            files.delete_dir(folder)


# ---- reader --------------------------------------------------------------------------------------

@dataclass
class _Ranges(InputPartition):
    """(module, first byte, bytes) of some blocks."""

    ranges: list[tuple[str, int, int]]


class _PackReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.wanted = options["path"], None

    def pushFilters(self, filters: list[Filter]):
        """Takes equality of the module, and lists of modules; leaves the rest to Spark."""
        for f in filters:
            names = {EqualTo: lambda: {f.value}, In: lambda: set(f.value)}.get(type(f))
            if names is None or f.attribute != ("module",):
                yield f
            else:
                self.wanted = names() if self.wanted is None else self.wanted & names()

    def header(self) -> tuple[dict, int]:
        """The header, and the byte behind it."""
        (length,) = _PREFIX.unpack(open_range(self.path, 0, _PREFIX.size))
        return json.loads(open_range(self.path, _PREFIX.size, length)), _PREFIX.size + length

    def partitions(self) -> list[_Ranges]:
        header, base = self.header()
        if header["schemaVersion"] != SCHEMA_VERSION:
            raise ValueError(f"pack of schema version {header['schemaVersion']}")
        out, held = [[]], 0
        for module, r in header["modules"].items():
            if self.wanted is None or module in self.wanted:
                if held >= RANGE_BYTES:
                    out.append([])
                    held = 0
                out[-1].append((module, base + r["o"], r["l"]))
                held += r["l"]
        return [_Ranges(ranges) for ranges in out]

    def read(self, partition: _Ranges) -> Iterator[tuple[str, int, bytes]]:
        for module, start, length in partition.ranges:
            for chunk, at in enumerate(range(0, length, CHUNK_BYTES)):
                yield module, chunk, open_range(self.path, start + at, min(CHUNK_BYTES, length - at))


class PackSource(DataSource):
    """Format ``block_pack``: option ``path``; ``meta`` (JSON) when writing."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "module string, chunk bigint, data binary"

    def reader(self, schema) -> _PackReader:
        return _PackReader(self.options)

    def writer(self, schema, overwrite: bool) -> _PackWriter:
        return _PackWriter(self.options)


def write_pack(blocks: Blocks, path: str, version: str, now: str, scope: str, stats: dict[str, int]) -> None:
    """Writes the pack of all blocks; the same blocks, version and time give the same bytes."""
    lines = block_lines(blocks)
    lines.sparkSession.dataSource.register(PackSource)
    meta = {"version": version, "generatedAt": now, "scope": scope, "stats": stats}
    lines.write.format(FORMAT).mode("append").option("meta", json.dumps(meta)).save(path)


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """(module, chunk, data): the blocks' bytes, in one row for each block unless it is very long."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackSource)
    return spark.read.format(FORMAT).load(path)
