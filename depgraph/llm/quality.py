"""Document quality as an ordinal grade: cumulative-link regression on hashed words.

One weight vector, shared by all grades, gives a document's score; ordered thresholds cut the score
line, P(grade >= k) = sigmoid(score - threshold_k).  Features are the logarithms of word counts in
hashed slots, and a few figures of the text's shape (capitals, signs, repetition, word length) in
slots of their own.  The model is fitted on a bounded sample of the labelled rows; every document
is scored whole, in the tasks that read it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from depgraph.llm.common import prepare, text_tables, unused

#: Labelled rows the model is fitted on at most: the first by the hash of their document number.
SAMPLE_ROWS = 8_000
SLOTS = 1 << 20
#: Slots seen in fewer sampled documents get no weight.
MIN_DOCUMENTS = 3
#: Standard errors by which a slot's documents must differ in mean grade from all to get a weight.
LEAST_SHIFT = 3.0
STEPS = 250
PENALTY = 2e-5
TABLE_BYTES = 4 << 20

_SHAPES = 64
_EDGES = {
    "capitals": [0.01, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7],
    "signs": [0.005, 0.01, 0.02, 0.04, 0.06, 0.1, 0.2],
    "digits": [0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6],
    "variety": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7],
    "commonest": [0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8],
    "word_length": [1.5, 2.5, 3.5, 4.5, 6.0, 8.0, 12.0],
    "words": [1, 5, 10, 20, 50, 200, 1000],
}
_UPPER, _LETTER, _DIGIT = (
    bytes(range(0x41, 0x5B)), bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)),
    bytes(range(0x30, 0x3A)),
)
_SPACE = b" \t\n\v\f\r"


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text.  Null and empty texts have shape slots alone."""
    raw = (text or "").encode()
    counts = Counter(raw.lower().split())
    words, size = counts.total(), max(1, len(raw))
    upper, letters, digits, spaces = (len(raw) - len(raw.translate(None, s)) for s in (_UPPER, _LETTER, _DIGIT, _SPACE))
    figures = {
        "capitals": upper / max(1, letters), "signs": (len(raw) - letters - digits - spaces) / size, "digits": digits / size,
        "variety": len(counts) / max(1, words), "commonest": max(counts.values(), default=0) / max(1, words),
        "word_length": (len(raw) - spaces) / max(1, words), "words": words,
    }
    shape = [8 * i + int(np.searchsorted(_EDGES[k], v, side="right")) for i, (k, v) in enumerate(figures.items())]
    slots = np.fromiter(map(crc32, counts), dtype=np.uint32, count=len(counts)).astype(np.int64) % SLOTS + _SHAPES
    values = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    return np.concatenate([np.array(shape, dtype=np.int64), slots]), np.concatenate([np.ones(len(shape)), values])


@dataclass
class Grader:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    #: Whether rows of the highest grade and of a lower one were fitted; without both nothing is to be rejected.
    separates: bool = True

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1, one row for each score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -60, 60)))

    def score(self, text: str | None) -> float:
        slots, values = features(text)
        return float(self.weights[slots] @ values)


@dataclass
class Likelihood:
    """The penalised negative log-likelihood of the cumulative logit, of entries (slot, value) of rows (owner).

    Parameters are the weights and the gaps: the first threshold, and the logarithms of the steps to the next ones,
    which keep thresholds in order.  Rare grades weigh more, by the square root of what would balance them.
    """

    slots: np.ndarray
    values: np.ndarray
    owner: np.ndarray
    grades: np.ndarray
    levels: int
    penalty: float = PENALTY

    def __post_init__(self):
        counts = np.bincount(self.grades, minlength=self.levels) + 1.0
        self.balance = np.sqrt(counts.sum() / self.levels / counts[self.grades])
        self.lower, self.upper = np.maximum(self.grades - 1, 0), np.minimum(self.grades, self.levels - 2)

    def _chances(self, w: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(grade or more), P(more than the grade) and P(the grade) of each row."""
        t = thresholds_of(gaps)
        s = np.bincount(self.owner, weights=w[self.slots] * self.values, minlength=len(self.grades))
        tail = 1 / (1 + np.exp(-np.clip(s[:, None] - t, -60, 60)))
        each = np.arange(len(s))
        at_least = np.where(self.grades > 0, tail[each, self.lower], 1.0)
        beyond = np.where(self.grades < self.levels - 1, tail[each, self.upper], 0.0)
        return at_least, beyond, np.maximum(at_least - beyond, 1e-12)

    def value(self, w: np.ndarray, gaps: np.ndarray) -> float:
        return float(-(self.balance * np.log(self._chances(w, gaps)[2])).sum() / len(self.grades) + self.penalty / 2 * (w @ w))

    def gradient(self, w: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the weights and of the gaps."""
        grades, levels, rows = self.grades, self.levels, len(self.grades)
        at_least, beyond, p = self._chances(w, gaps)
        d_low, d_up = at_least * (1 - at_least) / p * self.balance, beyond * (1 - beyond) / p * self.balance
        d_s = -(d_low - d_up) / rows
        g_w = np.bincount(self.slots, weights=d_s[self.owner] * self.values, minlength=len(w)) + self.penalty * w
        g_t = (np.bincount(self.lower[grades > 0], weights=d_low[grades > 0], minlength=levels - 1)
               - np.bincount(self.upper[grades < levels - 1], weights=d_up[grades < levels - 1], minlength=levels - 1)) / rows
        return g_w, g_t[::-1].cumsum()[::-1] * np.concatenate([[1.0], np.exp(gaps[1:])])


def thresholds_of(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, one_sided: bool = True, steps: int = STEPS
) -> Grader:
    """Maximum likelihood of the cumulative logit with an L2 penalty, by Adam on all rows at once.

    With ``one_sided`` words can only lower a score, so a short text without any remarkable word is not held to be
    bad; without it weights have either sign.

    Without rows, or with one grade only, the thresholds say how often each grade was met (plus one).
    Unless the highest grade and a lower one were met, the grader does not separate.
    """
    separates = bool((grades == levels - 1).any() and (grades < levels - 1).any())
    counts = np.bincount(grades, minlength=levels) + 1.0
    above = counts[::-1].cumsum()[::-1][1:] / counts.sum()
    thresholds = -np.log(above / (1 - above))
    weights = np.zeros(SLOTS + _SHAPES)
    if not rows:
        return Grader(weights, thresholds, separates)
    sizes = [len(s) for s, _ in rows]
    slots, values = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    used, slots = np.unique(slots, return_inverse=True)
    # slots whose documents' mean grade is no further from that of all than chance would have it say nothing
    seen = np.bincount(slots)
    mean, spread = grades.mean(), max(grades.std(), 1e-9)
    shift = np.bincount(slots, weights=(grades - mean)[owner]) / np.sqrt(seen) / spread
    kept = ((seen >= MIN_DOCUMENTS) & (np.abs(shift) >= LEAST_SHIFT))[slots]
    slots, values, owner = slots[kept], values[kept], owner[kept]
    likelihood = Likelihood(slots, values, owner, grades, levels)
    w = np.zeros(len(used))
    gaps = np.concatenate([thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-3))])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(gaps), np.zeros_like(gaps)]
    words = used >= _SHAPES
    for step in range(1, steps + 1):
        g_w, g_g = likelihood.gradient(w, gaps)
        for x, g, m, v in ((w, g_w, *state[:2]), (gaps, g_g, *state[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        if one_sided:
            w[words] = np.minimum(w[words], 0)
    weights[used] = w
    return Grader(weights, thresholds_of(gaps), separates)


def _tables_to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_tables(batches, "text", TABLE_BYTES):
        found = [features(t) for t in part.column("text").to_pylist()]
        yield from pa.table({
            "grade": part.column("grade"),
            "slots": pa.array([s.astype(np.int32).tobytes() for s, _ in found], pa.binary()),
            "values": pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()),
        }).to_batches()


def train(
    docs: DataFrame, ratings: DataFrame, levels: int, sample_rows: int = SAMPLE_ROWS, one_sided: bool = True
) -> Grader:
    """Fits on at most ``sample_rows`` ratings (doc_id, grade from 0 to levels - 1); ``one_sided`` as in :func:`fit`.

    Ratings without a number or with a null grade or one out of range are ignored; of several ratings of
    a document the lowest counts; ratings without a document are left out before the sample is taken.
    A document of several rows is one row of the sample, with its first text in binary order.
    """
    spark = prepare(docs.sparkSession)
    usable = ratings.filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, levels - 1))
    picked = (
        usable.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
        .join(docs.select("doc_id").distinct(), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    sample = (
        docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")
    )
    found = sample.mapInArrow(_tables_to_rows, "grade int, slots binary, values binary").collect()
    found.sort(key=lambda r: (r.grade, bytes(r.slots)))
    rows = [(np.frombuffer(r.slots, dtype=np.int32).astype(np.int64), np.frombuffer(r["values"], dtype=np.float32)) for r in found]
    return fit(rows, np.array([r.grade for r in found], dtype=np.int64), levels, one_sided)


def grade(
    docs: DataFrame, model: Grader, carry: list[str] | None = None, text: str = "text", name: str = "quality"
) -> DataFrame:
    """The ``carry`` columns of every document and a struct ``name``: expected_grade, and tails, where
    tails[k - 1] is P(grade >= k).  Null and empty texts are graded by their shape; a column called
    ``name`` is replaced.
    """
    spark = prepare(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c != name]
    whole = unused("text", [*carry, name])
    shared = spark.sparkContext.broadcast(Grader(model.weights.astype(np.float32), model.thresholds))
    schema = StructType([docs.schema[c] for c in carry]).add(
        name, StructType.fromDDL("expected_grade double, tails array<double>")
    )
    arrow = pa.struct([("expected_grade", pa.float64()), ("tails", pa.list_(pa.float64()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in text_tables(batches, whole, TABLE_BYTES):
            scores = np.array([own.score(t) for t in part.column(whole).to_pylist()])
            tails = own.tails(scores)
            rows = [{"expected_grade": float(t.sum()), "tails": t.tolist()} for t in tails]
            yield from part.drop([whole]).append_column(name, pa.array(rows, arrow)).to_batches(max_chunksize=1000)

    return docs.select(*carry, F.col(text).alias(whole)).mapInArrow(score, schema)


def good(model: Grader, tails: Column, least: float) -> Column:
    """Whether the highest grade has at least the probability ``least``; true of all if the model does not separate."""
    return tails[len(model.thresholds) - 1] >= least if model.separates else F.lit(True)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of the label table: 0 toxic, 1 low quality, 2 neither.  Null labels count as neither toxic nor low."""
    toxic, low = F.coalesce(F.col("toxic"), F.lit(0)) != 0, F.coalesce(F.col("quality"), F.lit(1)) == 0
    return labels.select("doc_id", F.when(toxic, 0).when(low, 1).otherwise(2).alias("grade"))
