"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters say yes or no to a text.  Lexicon voters look for words, pattern voters for beginnings of words, for many
different ones of them at once, and for shouting, sign runs and the like.  Words and beginnings are mined from a bounded
sample of labelled rows.  The label model is generative: a hidden class explains the votes, and besides each
voter's accuracy it estimates which voters hang together beyond that (a tree of dependencies between voters in
each class), so that ten voters who look at one word do not count as ten witnesses.  It is fitted by expectation
maximisation on the votes of all documents; given labels are one more, noisy voter that is silent on most rows.
A linear classifier on words and beginnings learns the model's posterior labels and scores whole texts.

Words are runs of letters and digits of the lower-cased text, as UTF-8 bytes; beginnings are cut in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from depgraph.llm.common import ascii_words, prepare, text_tables, unused
from depgraph.session import materialize

#: Labelled rows that voters and classifier are made from at most: the first by the hash of their number.
SAMPLE_ROWS = 12_000
#: Bytes of the beginnings of words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Different toxic texts of the sample that a word or beginning must stand in; how many of them are looked at.
LEAST_TEXTS, MOST_CANDIDATES = 4, 30_000
#: How much more often a voter's words stand in toxic texts than in others.
LIFT = 20.0
#: Lists that mined words and beginnings are dealt to, each a voter.
LEXICONS, PATTERNS = 8, 8
ROUNDS, TREE_ROUNDS = 14, (4, 9)
#: Information (nats) that two voters must share within the classes to be tied to one another.
LEAST_TIE = 2e-4
#: Standard errors, steps and L1 penalty of the classifier.
LEAST_SHIFT, STEPS, SPARSITY = 3.0, 800, 3e-5
TABLE_BYTES = 4 << 20
_UNIT = float(1 << 20)


def lowered_words(text: str | None) -> list[bytes]:
    return ascii_words(text.lower()) if text else []


def _beginnings(words: set[bytes]) -> set[bytes]:
    return {w[:n] for n in BEGINNINGS for w in words if len(w) >= n}


def _keys(words: set[bytes]) -> set[bytes]:
    """Beginnings, and whole words, which end with a blank."""
    return _beginnings(words) | {w + b" " for w in words}


def _sketch(words: list[bytes]) -> int:
    """Least checksum of the runs of three words: near copies mostly share it, other texts seldom do."""
    return min((crc32(b" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))), default=0)


# ---- voters ----------------------------------------------------------------------------------

_SHAPES = ("shouting", "signs", "sign_runs", "repeats", "digits")


def _shape_votes(text: str, words: list[bytes], distinct: int) -> int:
    """Votes of the patterns that no mined word is part of, in the order of _SHAPES."""
    raw = text.encode()
    letters, size = sum(map(len, words)), max(1, len(raw))
    capitals, signs = (len(raw) - len(raw.translate(None, kind)) for kind in (_CAPITALS, _SIGNS))
    digits = sum(w.isdigit() for w in words)
    votes = (
        capitals > 0.3 * letters, signs > 0.15 * size,
        "!!" in text or "??" in text or "##" in text, len(words) > 3 * max(1, distinct), digits > 0.1 * max(1, len(words)),
    )
    return sum(bool(v) << i for i, v in enumerate(votes))


_CAPITALS = bytes(range(0x41, 0x5B))
_SIGNS = bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])


@dataclass
class Voters:
    """Words and beginnings of the lexicon and pattern voters, as masks of votes."""

    words: dict[bytes, int]
    beginnings: dict[bytes, int]

    @property
    def names(self) -> list[str]:
        return [
            *(f"lexicon_{i}" for i in range(LEXICONS)), *(f"pattern_{i}" for i in range(PATTERNS)),
            "many_words", "many_beginnings", *_SHAPES,
        ]

    @classmethod
    def deal(cls, keys: list[bytes]) -> Voters:
        """Deals keys, best first, round the lists."""
        words = [k[:-1] for k in keys if k.endswith(b" ")]
        beginnings = [k for k in keys if not k.endswith(b" ")]
        return cls(
            {w: 1 << (i % LEXICONS) for i, w in enumerate(words)},
            {b: 1 << (LEXICONS + i % PATTERNS) for i, b in enumerate(beginnings)},
        )

    def votes(self, text: str | None) -> int:
        """Bits of all voters who say yes; none does to a null or empty text."""
        if not text:
            return 0
        listed = lowered_words(text)
        words = set(listed)
        found = words & self.words.keys()
        begun = _beginnings(words) & self.beginnings.keys()
        bits = 0
        for w in found:
            bits |= self.words[w]
        for b in begun:
            bits |= self.beginnings[b]
        starts = sum(any(w[:n] in begun for n in BEGINNINGS) for w in words) if begun else 0
        base = LEXICONS + PATTERNS
        bits |= (len(found) > 1) << base | (starts > 1) << (base + 1)
        return bits | _shape_votes(text, listed, len(words)) << (base + 2)


# ---- label model -----------------------------------------------------------------------------

@dataclass
class LabelModel:
    """P(class), P(given label = 1 | class), and P(vote = 1 | vote of the parent voter, class).

    ``parents[j]`` is the voter that voter j is tied to, or -1; ``rates[j, a, c]`` holds for the parent's vote a.
    """

    share: np.ndarray
    given: np.ndarray
    parents: np.ndarray
    rates: np.ndarray

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        """P(class 1) of rows of votes (0 or 1); ``given``: label 0 or 1, -1 without one."""
        before = np.where(self.parents >= 0, votes[:, self.parents], 0)
        each = np.arange(len(self.parents))
        score = np.tile(np.log(self.share), (len(votes), 1))
        for c in (0, 1):
            rate = self.rates[each[None, :], before, c]
            score[:, c] += np.log(np.where(votes == 1, rate, 1 - rate)).sum(axis=1)
            told = np.where(given == 1, self.given[c], 1 - self.given[c])
            score[:, c] += np.where(given >= 0, np.log(told), 0.0)
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700)))

    def accuracies(self, sums: Sums) -> list[tuple[float, float]]:
        """For each voter the part of class 1 it says yes to, and of class 0 it says no to."""
        return [(sums.ones[1, j] / sums.total[1], 1 - sums.ones[0, j] / sums.total[0]) for j in range(len(self.parents))]


@dataclass
class Sums:
    """Expected numbers of rows by class: all, with a vote, with two votes, with a given label 0 or 1."""

    total: np.ndarray
    ones: np.ndarray
    pairs: np.ndarray
    told: np.ndarray

    @classmethod
    def of(cls, votes: np.ndarray, given: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> Sums:
        by_class = np.stack([n * (1 - toxic), n * toxic])
        return cls(
            by_class.sum(axis=1), by_class @ votes, np.stack([votes.T @ (w[:, None] * votes) for w in by_class]),
            np.stack([[w[given == told].sum() for told in (0, 1)] for w in by_class]),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.total, self.ones, self.pairs, self.told)])

    @classmethod
    def unflat(cls, flat: np.ndarray, voters: int) -> Sums:
        cuts = np.cumsum([2, 2 * voters, 2 * voters * voters])
        total, ones, pairs, told = np.split(flat, cuts)
        return cls(total, ones.reshape(2, -1), pairs.reshape(2, voters, voters), told.reshape(2, 2))


def ties(sums: Sums) -> np.ndarray:
    """Information in nats that each two voters share within the classes."""
    all_rows = sums.total.sum() + 1e-9
    out = np.zeros(sums.pairs.shape[1:])
    for c in (0, 1):
        total = sums.total[c] + 1e-9
        one = sums.ones[c] / total
        both = sums.pairs[c] / total
        cells = (
            (both, one[:, None] * one[None, :]), (one[:, None] - both, one[:, None] * (1 - one)[None, :]),
            (one[None, :] - both, (1 - one)[:, None] * one[None, :]),
            (1 - one[:, None] - one[None, :] + both, (1 - one)[:, None] * (1 - one)[None, :]),
        )
        for joint, apart in cells:
            joint = np.maximum(joint, 0)
            out += total / all_rows * np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(apart, 1e-12)), 0)
    np.fill_diagonal(out, 0)
    return out


def dependency_tree(sums: Sums, least: float = LEAST_TIE) -> np.ndarray:
    """Parent of each voter in the forest of the strongest ties."""
    strength = ties(sums)
    parents = np.full(len(strength), -1)
    left = set(range(len(strength)))
    reach = {}
    while left:
        j = max(left, key=lambda v: (reach.get(v, (0.0, -1))[0], -v))
        value, parent = reach.get(j, (0.0, -1))
        if value >= least:
            parents[j] = parent
        left.remove(j)
        for k in left:
            if strength[j, k] > reach.get(k, (0.0, -1))[0]:
                reach[k] = (strength[j, k], j)
    return parents


def maximise(sums: Sums, parents: np.ndarray) -> LabelModel:
    """The rates that explain the expected numbers best, with half a row more in every cell; given labels start
    as right in nineteen of twenty rows, with the weight of a hundred rows."""
    each = np.arange(len(parents))
    rates = np.empty((len(parents), 2, 2))
    for c in (0, 1):
        with_parent = sums.pairs[c][each, parents] * (parents >= 0)
        parent_ones = sums.ones[c][parents] * (parents >= 0)
        rates[:, 1, c] = (with_parent + 0.5) / (parent_ones + 1)
        rates[:, 0, c] = (sums.ones[c] - with_parent + 0.5) / (sums.total[c] - parent_ones + 1)
    share = (sums.total + 1) / (sums.total.sum() + 2)
    given = (sums.told[:, 1] + np.array([5.0, 95.0])) / (sums.told.sum(axis=1) + 100)
    return LabelModel(share, given, parents, np.clip(rates, 1e-6, 1 - 1e-6))


def first_guess(votes: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Given labels where there are any, else how many mined lists say yes."""
    lists = votes[:, :LEXICONS + PATTERNS].sum(axis=1)
    guess = np.where(lists > 1, 0.9, np.where(lists == 1, 0.3, 0.02))
    return np.where(given == 1, 0.98, np.where(given == 0, 0.02, guess))


def _matrix(bits: np.ndarray, voters: int) -> np.ndarray:
    return (bits[:, None] >> np.arange(voters)) & 1


def fit_label_model(patterns: DataFrame, voters: int, rounds: int = ROUNDS) -> tuple[LabelModel, Sums]:
    """Expectation maximisation over rows (bits, given, n): votes, given label (-1: none) and how many rows have them.

    The tasks add up expected numbers; sums over voters and pairs of voters are all that comes to the driver.
    """
    spark = patterns.sparkSession
    model, sums = None, None
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, flat = shared.value, 0.0
            for batch in batches:
                bits, given, n = (batch.column(c).to_numpy() for c in ("bits", "given", "n"))
                votes = _matrix(bits, voters)
                toxic = first_guess(votes, given) if known is None else known.posterior(votes, given)
                flat = flat + Sums.of(votes, given, n.astype(float), toxic).flat()
            units = np.rint(np.atleast_1d(flat) * _UNIT).astype(np.int64)
            at = np.flatnonzero(units)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(units[at], pa.int64())], ["at", "units"])

        added = patterns.mapInArrow(expect, "at long, units long").groupBy("at").agg(F.sum("units").alias("units"))
        flat = np.zeros(2 + 2 * voters + 2 * voters * voters + 4)
        for row in added.collect():
            flat[row["at"]] = row.units / _UNIT
        shared.unpersist()
        sums = Sums.unflat(flat, voters)
        if turn == 0 or turn in TREE_ROUNDS:
            parents = dependency_tree(sums)
        model = maximise(sums, parents)
    return model, sums


# ---- classifier ------------------------------------------------------------------------------

@dataclass
class Classifier:
    """P(toxic) = sigmoid(intercept + the weights of a text's words and beginnings, each once)."""

    intercept: float
    words: dict[bytes, float]
    beginnings: dict[bytes, float]

    def score(self, text: str | None) -> float:
        words = set(lowered_words(text))
        total = self.intercept
        total += sum(sorted(self.words[w] for w in words & self.words.keys()))
        if self.beginnings:
            total += sum(sorted(self.beginnings[b] for b in _beginnings(words) & self.beginnings.keys()))
        return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))


def fit_classifier(
    keys: list[bytes], rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray,
    steps: int = STEPS, sparsity: float = SPARSITY,
) -> Classifier:
    """Logistic regression with an L1 penalty on soft labels, by accelerated proximal steps.

    ``rows``: numbers of the keys each text has.  Keys whose texts' mean label is no further from that of all
    than chance would have it take no part.
    """
    sizes = np.array([len(r) for r in rows])
    key = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    weight = weight / weight.sum()
    n = 1 / np.square(weight).sum()  # rows that the weighted ones are worth
    mean = weight @ toxic
    seen = np.bincount(key, weights=weight[owner], minlength=len(keys))
    shift = np.bincount(key, weights=(weight * (toxic - mean))[owner], minlength=len(keys))
    far = np.abs(shift) * np.sqrt(n) >= LEAST_SHIFT * np.sqrt(np.maximum(seen, 1e-12) * max(mean * (1 - mean), 1e-9))
    used = np.flatnonzero(far & (seen * n >= LEAST_TEXTS))
    place = np.full(len(keys), -1)
    place[used] = np.arange(len(used))
    kept = place[key] >= 0
    key, owner = place[key[kept]], owner[kept]
    # the greatest eigenvalue of the weighted products bounds the curvature
    v, top = np.full(len(used) + 1, 1.0), 1.0
    for _ in range(20):
        product = v[-1] + np.bincount(owner, weights=v[key], minlength=len(rows))
        v = np.append(np.bincount(key, weights=(weight * product)[owner], minlength=len(used)), weight @ product)
        top = max(float(np.linalg.norm(v)), 1e-9)
        v = v / top
    step = 4 / (1.05 * top)
    w = np.append(np.zeros(len(used)), np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    ahead, speed = w.copy(), 1.0
    for _ in range(steps):
        s = ahead[-1] + np.bincount(owner, weights=ahead[key], minlength=len(rows))
        off = weight * (1 / (1 + np.exp(-np.clip(s, -60, 60))) - toxic)
        new = ahead - step * np.append(np.bincount(key, weights=off[owner], minlength=len(used)), off.sum())
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * sparsity, 0)
        following = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = new + (speed - 1) / following * (new - w)
        w, speed = new, following
    weights = {keys[k]: float(x) for k, x in zip(used, w[:-1]) if x}
    return Classifier(
        float(w[-1]), {k[:-1]: x for k, x in weights.items() if k.endswith(b" ")},
        {k: x for k, x in weights.items() if not k.endswith(b" ")},
    )


# ---- training --------------------------------------------------------------------------------

@dataclass
class Detector:
    voters: Voters
    label_model: LabelModel | None
    accuracies: list[tuple[float, float]]
    classifier: Classifier | None


def is_held_out(number: Column) -> Column:
    """Whether the checksum of the number, as text, leaves 1 when divided by 3; rows without a number are not."""
    return F.coalesce(F.crc32(number.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    picked = (
        labels.join(docs.select("doc_id").distinct(), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return materialize(texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")), "toxic-sample")


def _candidates(sample: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray, tuple[int, int]]:
    """Words and beginnings of toxic sample texts; in how many toxic and other texts they stand; all such texts."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_tables(batches, "text", TABLE_BYTES):
            for text in part.column("text").to_pylist():
                words = lowered_words(text)
                keys = list(_keys(set(words)))
                yield pa.record_batch([pa.array(keys, pa.binary()), pa.array([_sketch(words)] * len(keys), pa.int64())], ["key", "sketch"])

    sizes = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    found = (
        sample.filter("toxic = 1").select("text").mapInArrow(explode, "key binary, sketch long")
        .groupBy("key").agg(F.count_distinct("sketch").alias("n")).filter(F.col("n") >= LEAST_TEXTS)
        .orderBy(F.desc("n"), "key").limit(MOST_CANDIDATES).collect()
    )
    keys = [bytes(r["key"]) for r in found]
    place = sample.sparkSession.sparkContext.broadcast({k: i for i, k in enumerate(keys)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = place.value, np.zeros(len(keys), dtype=np.int64)
        for part in text_tables(batches, "text", TABLE_BYTES):
            for text in part.column("text").to_pylist():
                for k in _keys(set(lowered_words(text))) & own.keys():
                    total[own[k]] += 1
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["at", "n"])

    others = np.zeros(len(keys), dtype=np.int64)
    counted = sample.filter("toxic = 0").select("text").mapInArrow(count, "at long, n long")
    for row in counted.groupBy("at").agg(F.sum("n").alias("n")).collect():
        others[row["at"]] = row.n
    return keys, np.array([r.n for r in found], dtype=np.int64), others, (sizes[0], sizes[1])


def vote(docs: DataFrame, voters: Voters, carry: list[str], text: str = "text") -> DataFrame:
    """The ``carry`` columns and ``bits``, the voters who say yes, of every document; a column called so is replaced."""
    carry = [c for c in carry if c != "bits"]
    whole = unused("text", [*carry, "bits"])
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    schema = StructType([docs.schema[c] for c in carry]).add("bits", "long")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_tables(batches, whole, TABLE_BYTES):
            bits = [shared.value.votes(t) for t in part.column(whole).to_pylist()]
            yield from part.drop([whole]).append_column("bits", pa.array(bits, pa.int64())).to_batches(max_chunksize=1000)

    return docs.select(*carry, F.col(text).alias(whole)).mapInArrow(ask, schema)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Detector:
    """Voters, label model and classifier from documents (doc_id, text) and labels (doc_id, toxic).

    Labels without a number or a value are ignored; of several labels of a document the highest counts; any value
    but 0 is toxic.  Callers leave out of ``labels`` what is to be held out.  Unless both kinds of labelled texts exist and some
    word or beginning tells them apart, there is no classifier, and every text scores 0.
    """
    spark = prepare(docs.sparkSession)
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("toxic") != 0).cast("int")).alias("toxic")
    )
    usable = materialize(usable, "toxic-labels")
    sample = _sample(docs, usable, sample_rows)
    keys, toxic_texts, other_texts, sizes = _candidates(sample)
    lift = ((toxic_texts + 0.5) / (sizes[0] + 1)) / ((other_texts + 0.5) / (sizes[1] + 1))
    chosen = sorted(np.flatnonzero(lift >= LIFT), key=lambda i: (-int(toxic_texts[i]), keys[i]))
    voters = Voters.deal([keys[i] for i in chosen])
    if not chosen or not sizes[1]:
        return Detector(voters, None, [], None)
    count = len(voters.names)
    votes = vote(docs, voters, ["doc_id"]).groupBy("doc_id", "bits").agg(F.count("*").alias("n"))
    told = votes.join(usable, "doc_id", "left").select(
        "bits", F.coalesce("toxic", F.lit(-1)).cast("long").alias("given"), "n"
    )
    patterns = materialize(told.groupBy("bits", "given").agg(F.sum("n").alias("n")), "toxic-votes")
    model, sums = fit_label_model(patterns, count)
    place = spark.sparkContext.broadcast({k: i for i, k in enumerate(keys)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = place.value
        for part in text_tables(batches, "text", TABLE_BYTES):
            listed = [lowered_words(t) for t in part.column("text").to_pylist()]
            hits = [sorted(own[k] for k in _keys(set(words)) & own.keys()) for words in listed]
            yield from pa.table({
                "toxic": part.column("toxic"),
                "bits": pa.array([voters.votes(t) for t in part.column("text").to_pylist()], pa.int64()),
                "sketch": pa.array([_sketch(words) for words in listed], pa.int64()),
                "hits": pa.array([np.array(h, dtype=np.int32).tobytes() for h in hits], pa.binary()),
            }).to_batches()

    read_rows = sample.select("toxic", "text").mapInArrow(read, "toxic int, bits long, sketch long, hits binary").collect()
    read_rows.sort(key=lambda r: (r.sketch, r.bits, bytes(r.hits), r.toxic))
    posterior = model.posterior(_matrix(np.array([r.bits for r in read_rows]), count), np.array([r.toxic for r in read_rows]))
    _, group, members = np.unique([r.sketch for r in read_rows], return_inverse=True, return_counts=True)
    hits = [np.frombuffer(r.hits, dtype=np.int32) for r in read_rows]
    classifier = fit_classifier(keys, hits, posterior, 1.0 / members[group])
    return Detector(voters, model, model.accuracies(sums), classifier)


def score(docs: DataFrame, detector: Detector, carry: list[str] | None = None, text: str = "text", name: str = "toxicity") -> DataFrame:
    """The ``carry`` columns (all, if none are named) of every document and the double ``name`` from 0 to 1.

    Null and empty texts score as texts without any remarkable word.  A column called ``name`` is replaced.
    """
    spark = prepare(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c != name]
    if detector.classifier is None:
        return docs.select(*carry, F.lit(0.0).alias(name))
    whole = unused("text", [*carry, name])
    shared = spark.sparkContext.broadcast(detector.classifier)
    schema = StructType([docs.schema[c] for c in carry]).add(name, "double")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_tables(batches, whole, TABLE_BYTES):
            scores = [round(shared.value.score(t), 6) for t in part.column(whole).to_pylist()]
            yield from part.drop([whole]).append_column(name, pa.array(scores, pa.float64())).to_batches(max_chunksize=1000)

    return docs.select(*carry, F.col(text).alias(whole)).mapInArrow(rate, schema)
