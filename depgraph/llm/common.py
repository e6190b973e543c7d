"""Expressions and settings the corpus operators share."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace that parts words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows an Arrow batch holds at most, so that a batch of long texts stays small.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Session options the operators with Python tasks count on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: ASCII characters other than digits and letters become blanks.
_BLANKED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def ascii_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased: runs of characters other than ASCII ones that are no digit or letter."""
    return text.encode().lower().translate(_BLANKED).split() if text else []


class Numbers(dict):
    """Numbers things in the order they are first looked up."""

    def __missing__(self, thing) -> int:
        number = self[thing] = len(self)
        return number


def text_tables(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The rows of a task in order, as tables of about ``limit`` bytes of text, whole rows each."""
    waiting, held = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for row, size in enumerate(sizes):
            held += int(size)
            if held >= limit:
                waiting.append(batch.slice(start, row + 1 - start))
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, held, start = [], 0, row + 1
        if start < batch.num_rows:
            waiting.append(batch.slice(start))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()
