"""Importance resampling of documents towards a target distribution.

A regular-expression split of the ``tokenizers`` package, which needs no training, cuts the ASCII-lowered
text into words with their offsets.  Windows over neighbouring offset pairs are the features: runs of 1 to
``max_words`` words, joined by one blank.  The CRC-32 of a feature picks its bucket.  Two histograms, of all
documents and of all target texts, give every bucket a gain, the logarithm of the ratio of its smoothed
shares in thousandths.  A document weighs the mean gain of its features; a Gumbel draw from its number is
added, and the documents of the highest scores are the sample, drawn without replacement in proportion to
the exponential of their weights.

Texts are tokenised once.  What later steps read is a table of bucket counts for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Regex, pre_tokenizers

from depgraph.llm.common import prepare, text_tables, unused
from depgraph.operators.ranking import dense_index
from depgraph.session import materialize

#: What parts words: every ASCII character but digits and letters (A-Z are lowered before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_WORDS, BUCKETS = 1, 10_000
#: Documents of fewer words are never drawn; percentage of the others that is; prefix of the hashed number.
LEAST_WORDS, PERCENT, SEED = 20, 10, "2024"
TABLE_BYTES = 4 << 20
#: Characters that are tokenised at a time, so that the offsets of a very long text stay few.
PIECE_CHARS = 1 << 18
#: Buckets of known words that a task remembers.
KNOWN_WORDS = 1 << 18


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end behind a separator, of about PIECE_CHARS characters."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        end = start + PIECE_CHARS
        while end < len(text) and (text[end - 1] >= "\x80" or text[end - 1].isalnum()):
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


class Buckets:
    """Buckets of the features of texts; remembers those of words already met."""

    def __init__(self, max_words: int = MAX_WORDS, buckets: int = BUCKETS):
        self.max_words, self.buckets = max_words, buckets
        self.split = pre_tokenizers.Split(Regex(SEPARATORS), "removed")
        self.known: dict[str, int] = {}

    def _of(self, feature: str) -> int:
        found = self.known.get(feature)
        if found is None:
            found = crc32(feature.encode()) % self.buckets
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            self.known[feature] = found
        return found

    def __call__(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words; buckets in ascending order and how many features fell into each."""
        words, total, held = 0, np.zeros(0, dtype=np.int64), []
        lowered = text.encode().lower().decode() if text else ""
        for piece in _pieces(lowered):
            offsets = [pair for _, pair in self.split.pre_tokenize_str(piece)]
            found = [self._of(piece[a:b]) for a, b in offsets]
            if self.max_words > 1:
                # the last words of the piece before stand in front, for windows that begin there
                row = held + [piece[a:b] for a, b in offsets]
                for n in range(2, self.max_words + 1):
                    first = max(0, len(held) - n + 1)
                    found += [self._of(" ".join(row[i:i + n])) for i in range(first, len(row) - n + 1)]
                held = row[len(row) - self.max_words + 1:] if len(row) >= self.max_words else row
            words += len(offsets)
            total = _add(total, np.array(found, dtype=np.int64))
        where = np.flatnonzero(total)
        return words, where, total[where]


def _add(total: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    more = np.bincount(buckets, minlength=len(total))
    more[:len(total)] += total
    return more


def bucket_table(
    docs: DataFrame, carry: list[str], text: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS
) -> DataFrame:
    """The ``carry`` columns, _words, _features, _buckets (int32) and _times (int64) of every row, as bytes.

    Null and empty texts have no words and no features.
    """
    prepare(docs.sparkSession)
    whole = unused("text", carry)
    schema = StructType([docs.schema[c] for c in carry]).add("_words", "long").add("_features", "long")
    schema = schema.add("_buckets", "binary").add("_times", "binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(max_words, buckets)
        for part in text_tables(batches, whole, TABLE_BYTES):
            found = [of(t) for t in part.column(whole).to_pylist()]
            columns = {
                "_words": pa.array([w for w, _, _ in found], pa.int64()),
                "_features": pa.array([int(t.sum()) for _, _, t in found], pa.int64()),
                "_buckets": pa.array([b.astype(np.int32).tobytes() for _, b, _ in found], pa.binary()),
                "_times": pa.array([t.astype(np.int64).tobytes() for _, _, t in found], pa.binary()),
            }
            part = part.drop([whole])
            for name, column in columns.items():
                part = part.append_column(name, column)
            yield from part.to_batches(max_chunksize=1000)

    rows = docs.select(*carry, F.col(text).alias(whole)).mapInArrow(count, schema)
    return materialize(rows, "bucket-table")


def histogram(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all rows: each task adds up its own, then the sums meet by bucket."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for where, times in zip(batch.column("_buckets").to_pylist(), batch.column("_times").to_pylist()):
                total[np.frombuffer(where, dtype=np.int32)] += np.frombuffer(times, dtype=np.int64)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    sums = table.select("_buckets", "_times").mapInArrow(partial, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in sums.collect():  # one row a bucket at most
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over its share in the corpus, rounded down;
    one feature more in every bucket keeps shares above 0."""
    own, other = (h.astype(np.float64) + 1 for h in (corpus, target))
    size = float(len(corpus))
    ratio = other * (float(corpus.sum()) + size) / (own * (float(target.sum()) + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(number: Column, seed: str = SEED) -> Column:
    """Thousandths of a standard Gumbel draw that a document's number decides (null: as an empty text)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(number.cast("string"), F.lit("")))
    high = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((high + 0.5) / F.lit(4294967296.0)))).cast("long")


def _packed(columns: list[str]) -> Column:
    return F.struct(*columns) if columns else F.lit(None).cast("boolean")


def resample(
    docs: DataFrame, target: DataFrame, carry: list[str] | None = None, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, max_words: int = MAX_WORDS, buckets: int = BUCKETS, seed: str = SEED,
    doc_id: str = "doc_id", text: str = "text", name: str = "importance",
) -> DataFrame:
    """The ``carry`` columns (all, if none are named) of every document and a struct ``name``: n_words, n_features,
    weight, score and rank (1, 2, 3 ... in order of the draw; null if not drawn).

    Of the documents of at least ``least_words`` words the part ``percent`` with the highest scores is drawn, rounded
    down; equal scores go to the smaller number, rows without a number come last.  Null and empty texts have no
    features and the weight 0.  Repeated rows are documents of their own.  Empty targets or documents count as empty
    histograms.  A column called ``name`` is replaced; other columns are carried as they are.
    """
    spark = prepare(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c != name]
    keyed = docs.select(F.col(doc_id).alias("_number"), F.col(text).alias("_text"), _packed(carry).alias("_row"))
    table = bucket_table(keyed, ["_number", "_row"], "_text", max_words, buckets)
    wanted = bucket_table(target.select(F.col(text).alias("_text")), [], "_text", max_words, buckets)
    gain = spark.sparkContext.broadcast(gains(histogram(table, buckets), histogram(wanted, buckets)))
    schema = StructType([table.schema[c] for c in ("_number", "_row", "_words", "_features")]).add("_weight", "long")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for where, times, n in zip(*(batch.column(c).to_pylist() for c in ("_buckets", "_times", "_features"))):
                own = gain.value[np.frombuffer(where, dtype=np.int32)] @ np.frombuffer(times, dtype=np.int64)
                weights.append(int(own) // n if n else 0)
            part = pa.Table.from_batches([batch]).drop(["_buckets", "_times"])
            yield from part.append_column("_weight", pa.array(weights, pa.int64())).to_batches()

    score = F.col("_weight") + gumbel(F.col("_number"), seed)
    scored = table.mapInArrow(weigh, schema).withColumns({"_score": score, "_short": F.col("_words") < least_words})
    scored = materialize(scored, "importance")
    drawn = scored.filter("NOT _short").count() * percent // 100
    ordered = dense_index(
        scored.withColumns({"_least": -F.col("_score"), "_nameless": F.col("_number").isNull()}),
        ["_short", "_least", "_nameless", "_number", "_features", "_weight"], "_place",
    )
    rank = F.when(~F.col("_short") & (F.col("_place") < drawn), F.col("_place") + 1)
    return ordered.select(*(F.col("_row")[c].alias(c) for c in carry), F.struct(
        F.col("_words").alias("n_words"), F.col("_features").alias("n_features"), F.col("_weight").alias("weight"),
        F.col("_score").alias("score"), rank.alias("rank"),
    ).alias(name))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns and the struct ``importance``, in no order."""
    return resample(docs, target, **options).filter(F.col(options.get("name", "importance"))["rank"].isNotNull())
