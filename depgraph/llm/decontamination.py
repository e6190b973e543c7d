"""Benchmark decontamination with word-level suffix arrays of the training texts.

Every task cuts its documents into shards of bounded size and builds a suffix array of each: the
shard's words as numbers, its suffixes sorted by their first words with prefix doubling.  All test
suffixes are binary-searched in it at once; the found ranges of the array are the verbatim matches
and their places.  Matches of consecutive suffixes of an item on one diagonal join to the longest
match.  Words that no test item uses share one number, and no suffix that starts with one is kept,
since nothing can match there.

The test set is stored in blocks of bounded size, which tasks load and search one after the other.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from depgraph.llm.common import prepare, text_tables, unused
from depgraph.session import new_path
from depgraph.sources.byte_files import open_range, place

#: Words of a test window; an item with fewer words is one window.
WINDOW = 10
#: Bytes of text in a shard, words of a block of test items, and matches expanded at a time.
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 200_000
CHUNK = 1 << 20

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_TO_WORDS = bytes(
    b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)

REPORT = (
    "n_words long, n_hit long, items array<string>, "
    "matches array<struct<item_id: string, word: long, item_word: long, words: long>>"
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, letters and characters beyond ASCII."""
    return text.encode().translate(_TO_WORDS).split() if text else []


class Tests:
    """A block of test items as numbered words and windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple, int] = {}
        item, offset, which = [], [], []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for j in range(max(1, len(ids) - window + 1) if ids else 0):
                key = tuple(ids[j:j + window])
                item.append(number[name])
                offset.append(j)
                which.append(windows.setdefault(key, len(windows)))
        self.lengths = np.array([len(w) for w in windows], dtype=np.int64)
        self.words = np.zeros((len(windows), window), dtype=np.int64)
        for w, i in windows.items():
            self.words[i, :len(w)] = w
        order = np.argsort(which, kind="stable")
        self.item, self.offset = np.array(item, dtype=np.int64)[order], np.array(offset, dtype=np.int64)[order]
        self.first = np.searchsorted(np.array(which, dtype=np.int64)[order], np.arange(len(windows) + 1))


def blocks_of(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> Iterator[Tests]:
    """Test items in blocks of bounded size, one block at a time on the driver."""
    held, words = [], 0
    for row in items.select(F.col(item_id).cast("string"), text).toLocalIterator():
        held.append((row[0] if row[0] is not None else "null", words_of(row[1])))
        words += len(held[-1][1])
        if words >= BLOCK_WORDS:
            yield Tests(held, window)
            held, words = [], 0
    if words:
        yield Tests(held, window)


@lru_cache(maxsize=1)
def _loaded(path: str, size: int) -> Tests:
    return pickle.loads(open_range(path, 0, size))


@dataclass(frozen=True)
class StoredTests:
    """A block of test items in a file of the shared folder.  Tasks load the blocks one after the other and hold one at
    a time, so neither their number nor the benchmark's size weighs on the memory of a task or the driver."""

    path: str
    size: int

    @classmethod
    def of(cls, spark: SparkSession, tests: Tests) -> StoredTests:
        path, raw = new_path(spark, "test-items"), pickle.dumps(tests)
        files, target = place(path)
        files.create_dir(target.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(target) as out:
            out.write(raw)
        return cls(path, len(raw))

    @property
    def value(self) -> Tests:
        return _loaded(self.path, self.size)


class SuffixArray:
    """Suffixes of a numbered text (0: a word that matches nothing), sorted by ``depth`` words or more."""

    def __init__(self, ids: np.ndarray, depth: int, vocabulary: int):
        self.bits = max(1, int(vocabulary).bit_length())
        self.per = max(1, 62 // self.bits)
        self.keys = -(-depth // self.per)
        padded = np.concatenate([ids, np.zeros(self.per * (self.keys + 1) + 1, dtype=np.int64)])
        n = len(ids)
        self.packed = np.zeros(n + self.per * self.keys + 1, dtype=np.int64)
        size = len(self.packed)
        for k in range(self.per):
            self.packed <<= self.bits
            self.packed |= padded[k:k + size]
        places = np.flatnonzero(ids)
        key, sorted_to = self.packed[places], self.per
        order = np.argsort(key, kind="stable")
        rank = np.zeros(size, dtype=np.int64)
        while True:
            ordered = key[order]
            new = np.empty(len(order), dtype=np.int64)
            if len(order):
                new[0] = 1
                new[1:] = ordered[1:] != ordered[:-1]
            dense = np.cumsum(new)
            if sorted_to >= depth or not len(order) or dense[-1] == len(order):
                break
            rank[places[order]] = dense
            key = (rank[places] << 31) | rank[np.minimum(places + sorted_to, size - 1)]
            order = np.argsort(key, kind="stable")
            sorted_to *= 2
        self.places = places[order]

    def _pack(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros((self.keys, len(words)), dtype=np.int64)
        for k in range(self.keys * self.per):
            out[k // self.per] <<= self.bits
            if k < words.shape[1]:
                out[k // self.per] |= words[:, k]
        return out

    def _bound(self, wanted: np.ndarray, masks: np.ndarray, right: bool) -> np.ndarray:
        """First place in the array whose suffix, masked, is not below (right: is above) the wanted words."""
        low = np.zeros(wanted.shape[1], dtype=np.int64)
        high = np.full(wanted.shape[1], len(self.places), dtype=np.int64)
        for _ in range(len(self.places).bit_length()):
            middle = (low + high) >> 1
            at = self.places[np.minimum(middle, len(self.places) - 1)]
            below = np.full(len(low), right)
            for k in range(self.keys - 1, -1, -1):
                have = self.packed[at + k * self.per] & masks[k]
                below = np.where(have == wanted[k], below, have < wanted[k])
            move = low < high
            low = np.where(move & below, middle + 1, low)
            high = np.where(move & ~below, middle, high)
        return low

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of the array whose suffixes begin with each row's first ``length`` words."""
        if not len(self.places):
            return np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        full = np.where(np.arange(words.shape[1]) < lengths[:, None], (1 << self.bits) - 1, 0)
        wanted, masks = self._pack(words), self._pack(full)
        return self._bound(wanted, masks, False), self._bound(wanted, masks, True)


def _search(words: list[list[bytes]], tests: Tests, window: int):
    """Hit places, (document, item) pairs and longest matches of one shard of documents."""
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate([[0], np.cumsum(counts + 1)])  # a mark that matches nothing ends each document
    total = int(starts[-1])
    lookup, marked = tests.vocabulary.get, chain.from_iterable(chain(w, (b"",)) for w in words)
    ids = np.fromiter(map(lookup, marked, repeat(0)), dtype=np.int64, count=total)
    array = SuffixArray(ids, window, len(tests.vocabulary) + 1)
    low, high = array.search(tests.words, tests.lengths)
    found = np.flatnonzero(high > low)
    edge = np.zeros(total + 1, dtype=np.int64)
    pairs, runs = [], []
    for part in np.array_split(found, max(1, -(-int((high - low)[found].sum()) // CHUNK))) if len(found) else []:
        times = (high - low)[part]
        window_of = np.repeat(part, times)
        inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        place = array.places[low[window_of] + inside]
        np.add.at(edge, place, 1)
        np.add.at(edge, place + tests.lengths[window_of], -1)
        uses = (tests.first[1:] - tests.first[:-1])[window_of]
        which = np.repeat(tests.first[window_of], uses) + np.arange(int(uses.sum())) - np.repeat(np.cumsum(uses) - uses, uses)
        place, length = np.repeat(place, uses), np.repeat(tests.lengths[window_of], uses)
        item, offset = tests.item[which], tests.offset[which]
        document = np.searchsorted(starts, place, side="right") - 1
        pairs.append(np.unique(document * len(tests.names) + item))
        runs.append(np.stack([item, place - offset, place, length]))
    hit = np.cumsum(edge[:-1]) > 0
    n_hit = np.add.reduceat(hit, starts[:-1]) if total else np.zeros(0, dtype=np.int64)
    pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
    return counts, n_hit, pair, _join_runs(np.concatenate(runs, axis=1) if runs else np.zeros((4, 0), dtype=np.int64)), starts


def _join_runs(runs: np.ndarray) -> np.ndarray:
    """Longest matches (item, diagonal, place, words): windows of an item that follow each other."""
    runs = np.unique(runs, axis=1)
    item, diagonal, place, length = runs
    fresh = np.ones(len(item), dtype=bool)
    fresh[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(fresh)
    last = np.append(head, len(item))[1:] - 1
    return np.stack([item[head], diagonal[head], place[head], place[last] + length[last] - place[head]])


def _report(words: list[list[bytes]], blocks: list[StoredTests], window: int) -> list[dict]:
    hits: list[dict] = [{"n_words": len(w), "n_hit": 0, "items": [], "matches": []} for w in words]
    spans: list[list] = [[] for _ in words]
    for block in blocks:
        tests = block.value
        _, n_hit, pairs, matches, starts = _search(words, tests, window)
        for pair in pairs.tolist():
            hits[pair // len(tests.names)]["items"].append(tests.names[pair % len(tests.names)])
        owner = np.searchsorted(starts, matches[2], side="right") - 1
        for item, diagonal, place, length, doc in zip(*matches.tolist(), owner.tolist()):
            word = place - int(starts[doc])
            spans[doc].append((word, word + length))
            hits[doc]["matches"].append(
                {"item_id": tests.names[item], "word": word, "item_word": place - diagonal, "words": length}
            )
        if len(blocks) == 1:  # the common case needs no merging
            for row, n in zip(hits, n_hit.tolist()):
                row["n_hit"] = n
    if len(blocks) > 1:
        for row, own in zip(hits, spans):
            end = 0
            for a, b in sorted(own):
                row["n_hit"] += max(0, b - max(a, end))
                end = max(end, b)
    for row in hits:
        row["items"] = sorted(set(row["items"]))
    return hits


def annotate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", carry: list[str] | None = None,
    name: str = "contamination",
) -> DataFrame:
    """The ``carry`` columns of every document and a struct ``name``: n_words, n_hit (words in matches),
    items (sorted as strings) and matches (item_id, word, item_word, words).  A column called ``name`` is
    replaced.

    Texts of any length are searched whole.  Null and empty texts have no words and no matches; items
    without words match nothing; an item whose id is null is named 'null'.  Repeated items count once
    for each id; repeated documents are reported each.  Empty tables give an empty or a clean report.
    """
    spark = prepare(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c != name]
    whole = unused("text", [*carry, name])
    blocks = [StoredTests.of(spark, block) for block in blocks_of(items, window)]
    report = StructType.fromDDL(REPORT)
    schema = StructType([docs.schema[c] for c in carry]).add(name, report)
    arrow = to_arrow_schema(StructType().add(name, report)).field(0).type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in text_tables(batches, whole, SHARD_BYTES):
            words = [words_of(t) for t in shard.column(whole).to_pylist()]
            rows = pa.array(_report(words, blocks, window), type=arrow)
            yield from shard.drop([whole]).append_column(name, rows).to_batches(max_chunksize=1000)

    return docs.select(*carry, F.col(text).alias(whole)).mapInArrow(scan, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents without any match, with the columns they came with."""
    report = unused("contamination", docs.columns)
    clean = annotate(docs, items, window, text, name=report).filter(F.col(report)["n_hit"] == 0)
    return clean.select(*docs.columns)
