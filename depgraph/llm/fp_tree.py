"""Ranked lexical search over document trees in the manner of an FP-tree.

The terms of the items are a small vocabulary.  Every document is cut down to these terms and their counts;
vectors of a shard are ordered by how many documents have a term, most frequent first, so that documents share
the paths of a trie.  A node of the trie is a range of documents that begin alike; it knows, for every term, the
greatest count in its subtree, and the least length figure m.  As a term adds more the more often it stands and the
smaller m is, both bound what any document below can score.  For an item the tree is walked depth first, children
of higher bounds before others; subtrees that cannot reach the item's best so far are left out.  Subtrees of few
documents are scored whole.

Documents of equal vector and length are one profile, which is scored once.  All scores are whole numbers.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depgraph.llm.common import Numbers, ascii_words, prepare, text_tables
from depgraph.operators.ranking import running_total
from depgraph.session import materialize

TOP = 50
#: Bytes of text and documents of a shard; profiles of a subtree that is scored whole.
SHARD_BYTES, SHARD_DOCS = 32 << 20, 1 << 14
LEAF = 64
#: Terms of all items that are searched for in one pass; a longer single item is a pass of its own.
PASS_TERMS = 20_000
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ARRAYS = {
    "numbers": np.int64, "nameless": np.bool_, "copies": np.int64, "lengths": np.int64, "edges": np.int64,
    "terms": np.int32, "times": np.int64,
}


def saturation(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(1000000000 * times) div (1000 * times + 20 * m)."""
    return (1_000_000_000 * times) // (1000 * times + 20 * m)


def length_figure(lengths: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m of documents of so many terms: 100 - 50 + (50 * n * N) div L."""
    return 50 + (50 * lengths * documents) // max(words, 1)


def term_weights(counts: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 * ln((2 * N + 2) / (2 * df + 1))) in doubles."""
    return np.floor(1000 * np.log((2.0 * documents + 2.0) / (2.0 * counts + 1.0))).astype(np.int64)


# ---- items -----------------------------------------------------------------------------------

def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, pass: the distinct terms of every item, dealt to passes of bounded size."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({_TERM})"))))
    rows = materialize(items.select("item_id", found.alias("term")).distinct(), "item-terms")
    sizes = rows.groupBy("item_id").agg(F.count("*").alias("size")).withColumn("nameless", F.col("item_id").isNull())
    placed = running_total(sizes, ["nameless", "item_id"], "before", F.col("size"))
    placed = placed.select(F.col("item_id").alias("_own"), F.floor(F.col("before") / PASS_TERMS).alias("pass"))
    return materialize(rows.join(placed, F.col("item_id").eqNullSafe(F.col("_own"))).drop("_own"), "item-passes")


# ---- vectors ---------------------------------------------------------------------------------

def restricted_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Shards of documents cut down to the terms of ``vocabulary``, as profiles of equal vector and length.

    n_docs and n_words count all documents with terms and all their terms, of the vocabulary or not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, number = zstandard.ZstdCompressor(level=1).compress, shared.value
        for part in text_tables(batches, "text", SHARD_BYTES):
            for start in range(0, part.num_rows, SHARD_DOCS):
                piece = part.slice(start, SHARD_DOCS)
                profile, members, docs_with, words = Numbers(), [], 0, 0
                for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    counts = Counter(ascii_words(text))
                    length = counts.total()
                    words += length
                    docs_with += length > 0
                    own = sorted((number[w], counts[w]) for w in counts.keys() & number.keys())
                    if own:
                        pairs = np.array(own, dtype=np.int64)
                        members.append((profile[(length, pairs.tobytes())], doc is None, doc or 0))
                members.sort()
                vectors = [np.frombuffer(raw, dtype=np.int64).reshape(-1, 2) for _, raw in profile]
                flat = np.concatenate([*vectors, np.zeros((0, 2), dtype=np.int64)])
                arrays = {
                    "numbers": [d for _, _, d in members], "nameless": [b for _, b, _ in members],
                    "copies": np.bincount([p for p, _, _ in members], minlength=len(vectors)) if members else [],
                    "lengths": [n for n, _ in profile], "edges": np.cumsum([0, *map(len, vectors)]),
                    "terms": flat[:, 0], "times": flat[:, 1],
                }
                packed = {k: squeeze(np.asarray(arrays[k]).astype(kind).tobytes()) for k, kind in _ARRAYS.items()}
                yield pa.RecordBatch.from_pylist([{**packed, "n_docs": docs_with, "n_words": words}], schema)

    schema = pa.schema([*((k, pa.binary()) for k in _ARRAYS), ("n_docs", pa.int64()), ("n_words", pa.int64())])
    ddl = ", ".join([*(f"{k} binary" for k in _ARRAYS), "n_docs long", "n_words long"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(cut, ddl), "restricted-vectors")


def _unpack(batch: pa.RecordBatch, names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    open_up = zstandard.ZstdDecompressor().decompress
    for row in batch.select(names).to_pylist():
        yield {k: np.frombuffer(open_up(row[k]), dtype=_ARRAYS[k]) for k in names}


def _document_counts(index: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""
    names = ["copies", "edges", "terms"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for own in _unpack(batch, names):
                total += np.bincount(own["terms"], weights=np.repeat(own["copies"], np.diff(own["edges"])), minlength=size).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["term", "n"])

    sums = index.select(*names).mapInArrow(partial, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(size, dtype=np.int64)
    for row in sums.collect():  # one row for each term of the pass at most
        out[row.term] = row.n
    return out


# ---- tree ------------------------------------------------------------------------------------

@dataclass
class Node:
    """Profiles ``first`` to ``last`` of the shard's order, which share their ``depth`` first terms."""

    first: int
    last: int
    depth: int
    children: list[int] = field(default_factory=list)


class Tree:
    """The trie of one shard: profiles in path order, nodes with subtree maxima of counts and minima of m."""

    def __init__(self, own: dict[str, np.ndarray], rank: np.ndarray, documents: int, words: int, leaf: int = LEAF):
        sizes = np.diff(own["edges"])
        profile = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((rank[own["terms"]], profile))  # inside each profile, most frequent terms first
        path = rank[own["terms"]][order].astype(">u4")
        keys = [path[a:b].tobytes() for a, b in zip(own["edges"], own["edges"][1:])]
        by_path = np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)
        place = _ranges(own["edges"][by_path], sizes[by_path])
        self.rank = path[place].astype(np.int64)
        self.times = own["times"][order][place]
        self.edges = np.concatenate([[0], np.cumsum(sizes[by_path])])
        self.m = length_figure(own["lengths"][by_path], documents, words)
        starts = np.concatenate([[0], np.cumsum(own["copies"])])
        self.doc_first, self.doc_last = starts[by_path], starts[by_path + 1]
        self.numbers, self.nameless = own["numbers"], own["nameless"]
        self.leaf = leaf
        self.nodes: list[Node] = []
        if len(by_path):
            self._grow()

    def _term(self, profiles: np.ndarray, depth: int) -> np.ndarray:
        """Rank of the term at ``depth`` of each profile, -1 where it ends before."""
        at = self.edges[profiles] + depth
        inside = at < self.edges[profiles + 1]
        return np.where(inside, self.rank[np.minimum(at, len(self.rank) - 1)], -1)

    def _shared(self, first: int, last: int) -> int:
        """Terms that all profiles of a range begin with: in path order, those its two ends share."""
        a, b = (self.rank[self.edges[p]:self.edges[p + 1]] for p in (first, last - 1))
        n = min(len(a), len(b))
        differs = np.flatnonzero(a[:n] != b[:n])
        return int(differs[0]) if len(differs) else n

    def _grow(self) -> None:
        self.nodes.append(Node(0, len(self.m), 0))
        todo = [0]
        while todo:
            node = self.nodes[todo.pop()]
            if node.last - node.first <= self.leaf:
                continue
            node.depth = self._shared(node.first, node.last)
            term = self._term(np.arange(node.first, node.last), node.depth)
            cuts = np.concatenate([[0], np.flatnonzero(term[1:] != term[:-1]) + 1, [len(term)]]) + node.first
            if len(cuts) == 2:  # one path, which only counts and lengths tell apart
                cuts = np.append(np.arange(node.first, node.last, self.leaf), node.last)
            begin = cuts[0]
            for i in range(1, len(cuts)):  # small neighbours go together
                following = cuts[i + 1] - begin if i + 1 < len(cuts) else self.leaf + 1
                if following > self.leaf:
                    self.nodes.append(Node(int(begin), int(cuts[i]), node.depth))
                    node.children.append(len(self.nodes) - 1)
                    todo.append(len(self.nodes) - 1)
                    begin = cuts[i]

    def weigh(self, weights: np.ndarray) -> None:
        """What each posting adds to a score, and the bound of every (node, term), from the weights by rank."""
        self.adds = weights[self.rank] * saturation(self.times, np.repeat(self.m, np.diff(self.edges)))
        most = np.zeros((len(self.nodes), len(weights)), dtype=np.int64)
        least_m = np.zeros(len(self.nodes), dtype=np.int64)
        for i in range(len(self.nodes) - 1, -1, -1):  # children stand behind their parents
            node = self.nodes[i]
            if node.children:
                most[i] = most[node.children].max(axis=0)
                least_m[i] = least_m[node.children].min()
            else:
                a, b = self.edges[node.first], self.edges[node.last]
                np.maximum.at(most[i], self.rank[a:b], self.times[a:b])
                least_m[i] = self.m[node.first:node.last].min()
        self.bounds = weights * saturation(most, least_m[:, None])

    def search(self, wanted: np.ndarray, best: Best) -> int:
        """Walks the tree for an item (ranks of its terms), gathers in ``best``; number of profiles scored."""
        if not self.nodes:
            return 0
        bound = self.bounds[:, wanted].sum(axis=1)
        chosen = np.zeros(self.bounds.shape[1], dtype=bool)
        chosen[wanted] = True
        scored, stack = 0, [0]
        while stack:
            i = stack.pop()
            if bound[i] < best.least:
                continue
            node = self.nodes[i]
            if node.children:
                stack += sorted(node.children, key=bound.__getitem__)
                continue
            scored += node.last - node.first
            a, b = self.edges[node.first], self.edges[node.last]
            own = np.where(chosen[self.rank[a:b]], self.adds[a:b], 0)
            scores = np.add.reduceat(own, self.edges[node.first:node.last] - a)
            for p in np.flatnonzero(scores >= best.least):
                copies = slice(self.doc_first[node.first + p], min(self.doc_last[node.first + p], self.doc_first[node.first + p] + best.top))
                best.add(int(scores[p]), self.nameless[copies], self.numbers[copies])
        return scored


class Best:
    """The best documents of an item so far: score, then named before nameless, then the smaller number."""

    def __init__(self, top: int):
        self.top, self.heap = top, []
        self.least = 1

    def add(self, score: int, nameless: np.ndarray, numbers: np.ndarray) -> None:
        for none, number in zip(nameless.tolist(), numbers.tolist()):
            entry = (score, -int(none), -number)
            if len(self.heap) < self.top:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)
            else:
                break
        if len(self.heap) == self.top:
            self.least = self.heap[0][0]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each range, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


# ---- search ----------------------------------------------------------------------------------

def _search_pass(docs: DataFrame, terms: list, top: int, kind: str) -> DataFrame:
    """The answers for the items of one pass, given by their (item_id, term) rows; ``kind`` is the type of item_id."""
    spark = docs.sparkSession
    vocabulary, of_item = Numbers(), {}
    for row in terms:
        of_item.setdefault(row.item_id, []).append(vocabulary[row.term.encode()])
    index = restricted_vectors(docs, dict(vocabulary))
    total = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    documents, words = total[0] or 0, total[1] or 0
    counts = _document_counts(index, len(vocabulary))
    by_count = np.lexsort((np.arange(len(counts)), -counts))
    rank = np.empty(len(counts), dtype=np.int64)
    rank[by_count] = np.arange(len(counts))
    weights = term_weights(counts, documents)[by_count]
    wanted = [rank[np.array(own)] for own in of_item.values()]
    shared = spark.sparkContext.broadcast((rank, weights, wanted))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, weights, wanted = shared.value
        best = [Best(top) for _ in wanted]
        for batch in batches:
            for own in _unpack(batch, list(_ARRAYS)):
                tree = Tree(own, rank, documents, words)
                if tree.nodes:
                    tree.weigh(weights)
                    for item, gathered in zip(wanted, best):
                        tree.search(item, gathered)
        for i, gathered in enumerate(best):
            found = gathered.heap
            yield pa.record_batch([
                pa.array([i] * len(found), pa.int64()),
                pa.array([None if none else -number for _, none, number in found], pa.int64()),
                pa.array([score for score, _, _ in found], pa.int64()),
            ], ["item", "doc_id", "score"])

    found = index.select(*_ARRAYS).mapInArrow(search, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    named = spark.createDataFrame(list(enumerate(of_item)), f"item long, item_id {kind}")
    return materialize(ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"), "ranked")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (1 is best), doc_id and score of the ``top`` best documents (doc_id, text) of each item
    (item_id, text), of scores above 0; equal scores rank by doc_id, rows without one last.

    Rows of one item_id, null included, are one item with the terms of all of them.  Null texts and texts without
    terms are never found and find nothing.  Repeated documents are answers of their own.  Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    kind = items.schema["item_id"].dataType.simpleString()
    terms = item_terms(items)
    passes = (terms.agg(F.max("pass")).first()[0] or 0) + 1
    found = None
    for number in range(passes):
        own = terms.filter(F.col("pass") == number).orderBy(F.col("item_id").isNull(), "item_id", "term").collect()
        if own:
            part = _search_pass(docs, own, top, kind)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return found
