"""Readers and writers of the file formats: raw sources, JSON-lines feeds, topics."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depgraph import schemas
from depgraph.operators.ranking import dense_index
from depgraph.session import materialize, materialize_with
from depgraph.sources.byte_files import list_tree, whole_texts

MAX_BAD_LINES = 100
_BAD = CORRUPT = "_bad"
_PLACE = ("_file", "_block", "_row")
# A feed number is the rank of the file block shifted by this many bits, plus the row in the scan task.
_ROW_BITS = 33

# The built-in topic table (id, label, band y, color) in priority order.
DEFAULT_TOPICS = (
    ("Tactic", "Tactic", 40.0, "#404080"),
    ("InformationTheory", "InformationTheory", 132.0, "#8000ff"),
    ("Combinatorics", "Combinatorics", 130.0, "#800000"),
    ("GroupTheory", "GroupTheory", 120.0, "#ff2040"),
    ("FieldTheory", "FieldTheory", 125.0, "#ffff80"),
    ("RingTheory", "RingTheory", 115.0, "#ff8000"),
    ("RepresentationTheory", "RepresentationTheory", 107.0, "#ff0000"),
    ("Algebra", "Algebra", 100.0, "#ffff00"),
    ("Init", "Init", 90.0, "#008040"),
    ("NumberTheory", "NumberTheory", 90.0, "#800000"),
    ("LinearAlgebra", "LinearAlgebra", 82.0, "#00ff00"),
    ("Order", "Order", 85.0, "#804000"),
    ("Logic", "Logic", 75.0, "#0080ff"),
    ("SetTheory", "SetTheory", 80.0, "#ff8080"),
    ("Data", "Data", 80.0, "#404040"),
    ("AlgebraicGeometry", "AlgebraicGeometry", 80.0, "#6040ff"),
    ("Computability", "Computability", 75.0, "#bfff00"),
    ("ModelTheory", "ModelTheory", 72.0, "#6040ff"),
    ("Geometry", "Geometry", 70.0, "#ff80ff"),
    ("CategoryTheory", "CategoryTheory", 62.0, "#80a0ff"),
    ("Analysis", "Analysis", 57.0, "#00ffff"),
    ("AlgebraicTopology", "AlgebraicTopology", 48.0, "#6040ff"),
    ("Condensed", "Condensed", 48.0, "#ff0000"),
    ("Topology", "Topology", 40.0, "#ff00ff"),
    ("MeasureTheory", "MeasureTheory", 30.0, "#8000ff"),
    ("Dynamics", "Dynamics", 25.0, "#008040"),
    ("Probability", "Probability", 20.0, "#0000ff"),
    ("_default", "Other", 140.0, "#202020"),
)
DEFAULT_TOPIC = DEFAULT_TOPICS[-1]


class TooManyBadLines(RuntimeError):
    """The module feed holds too many undecodable lines to be trusted."""


def scan_sources(
    spark: SparkSession, root: str, suffix: str = ".src", skip_part: str = ".lake"
) -> DataFrame:
    """Every file under ``root`` whose name ends in ``suffix`` as one row (path, text).

    Files below a directory called ``skip_part`` are left out; all other names are read, also those that start with
    ``_`` or ``.``.  Folders are listed and files are read in tasks, through the file systems that PyArrow knows.
    """
    return whole_texts(list_tree(spark, root, skip_part).filter(F.col("path").endswith(suffix)))


def _defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fill missing arrays with empty arrays and missing flags with false."""
    columns = []
    for field in schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            column = F.coalesce(column, F.array().cast(field.dataType))
        elif isinstance(field.dataType, T.BooleanType):
            column = F.coalesce(column, F.lit(False))
        columns.append(column.alias(field.name))
    return df.select(*columns)


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])


def place_columns() -> list[Column]:
    """Where a scanned row stands: its file, the block of the file, and (scan order only) the row."""
    return [
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ]


def _scan_json(spark: SparkSession, path, schema: T.StructType, mode: str) -> DataFrame:
    reader = spark.read.schema(with_corrupt(schema) if mode == "PERMISSIVE" else schema).option("mode", mode)
    if mode == "PERMISSIVE":
        reader = reader.option("columnNameOfCorruptRecord", _BAD)
    return reader.option("lineSep", "\n").json(path).select("*", *place_columns())


def _lacks(required: Sequence[str]) -> Column:
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    return missing


def _lacks_in_items(array: str, required: Sequence[str]) -> Column:
    def incomplete(item: Column) -> Column:
        missing = item.isNull()
        for name in required:
            missing = missing | item[name].isNull()
        return missing

    return F.coalesce(F.exists(array, incomplete), F.lit(False))


def _bad_module() -> Column:
    bad = _lacks(schemas.MODULE_REQUIRED)
    for array, required in schemas.MODULE_ITEMS_REQUIRED.items():
        bad = bad | _lacks_in_items(array, required)
    return bad


def bad_record() -> Column:
    """True where a declaration record, or an item of its lists, lacks a required field."""
    bad = _lacks(schemas.EXTRACT_REQUIRED)
    for array, required in schemas.EXTRACT_ITEMS_REQUIRED.items():
        bad = bad | _lacks_in_items(array, required)
    return bad


def block_ranks(places: DataFrame) -> DataFrame:
    """Rank of every (_file, _block) by the path of the file, then the block in the file.

    The few rows are written, so that Catalyst sees their size and does not deal the records out by block.
    """
    return materialize(dense_index(places.select(*_PLACE[:2]).distinct(), _PLACE[:2], "_rank"), "block_ranks")


def numbered(table: DataFrame, blocks: DataFrame) -> DataFrame:
    """Gives every row its feed number, ``seq``, by the ranks of blocks, unless the record brings its own."""
    row = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    number = F.shiftleft("_rank", _ROW_BITS) + row
    own = F.col("seq") if "seq" in table.columns else F.lit(None).cast("bigint")
    return table.join(blocks, list(_PLACE[:2])).withColumn("seq", F.coalesce(own, number)).drop(*_PLACE, "_rank")


def in_feed_order(table: DataFrame) -> DataFrame:
    """Numbers the rows of a stored scan.

    Numbers follow the path of the file, then the block in the file, then the row; how Spark packed
    the blocks into tasks has no influence on the order.
    """
    return numbered(table, block_ranks(table))


def _split_bad(scanned: DataFrame, schema: T.StructType, is_bad: Column) -> tuple[DataFrame, int]:
    """Good rows and the number of bad ones; the text is decoded once and kept as Parquet."""
    flagged = scanned.withColumn("_is_bad", F.col(_BAD).isNotNull() | is_bad)
    table, counts = materialize_with(flagged, "feed", bad=F.count_if("_is_bad"))
    good = in_feed_order(table.filter("NOT _is_bad").drop("_is_bad", _BAD))
    return _defaults(good, schema), counts["bad"]


def read_modules(spark: SparkSession, path, max_bad: int = MAX_BAD_LINES) -> tuple[DataFrame, int]:
    """Module feed, numbered in feed order, and its count of bad lines; ``max_bad`` of them are an error."""
    scanned = _scan_json(spark, path, schemas.MODULE_FEED, "PERMISSIVE")
    good, bad = _split_bad(scanned, schemas.MODULE_FEED, _bad_module())
    if bad >= max_bad:
        raise TooManyBadLines(f"module feed: {bad} bad lines, aborting")
    return good, bad


def read_modules_strict(spark: SparkSession, path) -> DataFrame:
    """Module feed in which the first bad line is fatal."""
    scanned = _scan_json(spark, path, schemas.MODULE_FEED, "FAILFAST")
    checked = F.when(
        _bad_module(), F.raise_error(F.lit("module record lacks a required field")).cast("string")
    ).otherwise(F.col("module"))
    return _defaults(in_feed_order(materialize(scanned.withColumn("module", checked), "feed")), schemas.MODULE_FEED)


def read_extract(spark: SparkSession, path) -> tuple[DataFrame, int]:
    """Declaration feed, numbered in feed order, and its count of skipped lines."""
    scanned = _scan_json(spark, path, schemas.EXTRACT_FEED, "PERMISSIVE")
    return _split_bad(scanned, schemas.EXTRACT_FEED, bad_record())


def read_extract_loose(spark: SparkSession, path) -> DataFrame:
    """Declaration feed with bad bytes replaced and undecodable lines dropped silently."""
    lines = spark.read.text(path, lineSep="\n").select("value", *place_columns())
    decoded = F.from_json(F.make_valid_utf8("value"), schemas.EXTRACT_FEED)
    records = lines.select(decoded.alias("r"), *_PLACE).select("r.*", *_PLACE).filter("name IS NOT NULL")
    return _defaults(in_feed_order(materialize(records, "feed")), schemas.EXTRACT_FEED)


def topic_dim(spark: SparkSession, rows=None) -> DataFrame:
    """Ordered topic dimension; the built-in table without rows, and always a default row."""
    rows = list(rows) if rows else list(DEFAULT_TOPICS)
    if not any(row[0] == DEFAULT_TOPIC[0] for row in rows):
        rows.append(DEFAULT_TOPIC)
    data = [(priority, *row) for priority, row in enumerate(rows)]
    return spark.createDataFrame(data, schemas.TOPIC)


def read_topics(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """The topic dimension of a TOML file with one ``[[topic]]`` table (id, label, y, color) a row, in priority order.

    A file that is missing, is no TOML or has a topic without one of the four values, or with more, gives the built-in
    table; the second value says why, and is null where the file was taken.  A default row is added if the file has none.
    """
    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
        found = tomllib.loads(rows[0]["value"] if rows else "")["topic"]
        names = {"id", "label", "y", "color"}
        if not found or any(set(t) != names for t in found):
            raise ValueError(f"each topic needs {', '.join(sorted(names))} and nothing else")
        return topic_dim(spark, [(str(t["id"]), str(t["label"]), float(t["y"]), str(t["color"])) for t in found]), None
    except (AnalysisException, ValueError, TypeError, KeyError, AttributeError) as reason:
        return topic_dim(spark), f"{type(reason).__name__}: {reason}".splitlines()[0]


def topic_table(topics: DataFrame) -> DataFrame:
    """A stored topic table (priority, id, label, y, color) as a dimension: a default row is added if it has none."""
    spark = topics.sparkSession
    default = spark.createDataFrame([DEFAULT_TOPIC], "id string, label string, y double, color string")
    added = default.join(topics.select("id"), "id", "left_anti").join(topics.agg(F.max("priority").alias("p")))
    known = topics.select(*(F.col(f.name).cast(f.dataType) for f in schemas.TOPIC))
    return known.unionByName(added.select((F.coalesce("p", F.lit(-1)) + 1).cast("bigint").alias("priority"), "id", "label", "y", "color"))


def write_modules_jsonl(modules: DataFrame, path: str) -> int:
    """Write one JSON object per module; returns the number written."""
    written = Observation()
    counted = modules.observe(written, F.count(F.lit(1)).alias("modules"))
    counted.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return written.get["modules"]
