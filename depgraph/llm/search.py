"""Exact BM25 top-k search on an inverted index in shards, with block-max dynamic pruning.

Every task builds shards of the index from its documents: postings by term, cut into blocks of
consecutive documents.  Query terms get their document counts from all shards, so every shard scores
with the same global statistics.  For a query, a shard adds up the block maxima of the query's terms,
an upper bound for every block of documents.  Only blocks whose bound reaches the threshold are scored:
the k-th best score that the task has seen in any shard or, as long as it has none, what the terms added
first give in k blocks.  Queries with no more other terms than blocks score the blocks with the highest
bounds for it, which for longer ones costs more than it spares.  The best k of the shards are merged by query.

Terms that a good part of a shard's documents have would never be skipped for long queries.  They are
kept as rows of a matrix too and added for many queries in one product, where enough of these have the
term.  Terms with fewer documents than there are blocks are added at once, since a list of their maxima
would be no shorter than their postings.  A block's bound then holds the greatest such sum in the block,
which is tighter than the sum of the terms' maxima.  Queries that share frequent terms are answered
together, so that a product needs few rows.  Products are of single precision and rounded up; documents
that may be among the best are added up anew from the rows, whose numbers are exact.

Contributions are whole numbers (millionths), so scores do not depend on the order of additions.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from depgraph.llm.common import Numbers, prepare, text_tables
from depgraph.session import materialize

K1, B = 1.2, 0.75
UNIT = 1e6
SHARD_BYTES = 16 << 20
SHARD_DOCS = 1 << 13
#: Part of a shard's documents from which a term is kept as a row.
FREQUENT = 1 / 32
#: A row joins a product if its postings, over all queries of the product, are more than this part of its places.
PRODUCT = 1 / 256
#: Whole numbers below this, and no others, are all exact in single precision.
EXACT = float(1 << 24)
#: Documents of a block; blocks scored before a threshold is known; terms and queries of a block of queries.
BLOCK_DOCS = 128
LEAD_BLOCKS = 2
QUERY_TERMS = 2_000_000
BLOCK_QUERIES = 1 << 14


def _pack(**arrays: np.ndarray) -> dict[str, bytes]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return {k: squeeze(v.tobytes()) for k, v in arrays.items()}


def _unpack(row: dict, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    open_up = zstandard.ZstdDecompressor().decompress
    return {k: np.frombuffer(open_up(row[k]), dtype=kind) for k, kind in kinds.items()}


_INDEX = {"doc_ids": np.int64, "lengths": np.int64, "terms": np.uint64, "edges": np.int64, "docs": np.uint16, "times": np.uint32}


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def build_index(docs: DataFrame) -> DataFrame:
    """Shards of the index: doc_ids, lengths, terms (sorted codes), edges, docs and times (postings by term).

    Null and empty texts are documents without postings; rows without a doc_id cannot be named and are not
    indexed; a repeated row is a document of its own.
    """
    prepare(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_tables(batches, "text", SHARD_BYTES):
            for a in range(0, part.num_rows, SHARD_DOCS):
                piece = part.slice(a, SHARD_DOCS)
                number, owner, which, times, lengths = Numbers(), [], [], [], []
                for i, text in enumerate(piece.column("text").to_pylist()):
                    counts = Counter(_words(text))
                    lengths.append(counts.total())
                    owner.append(np.full(len(counts), i, dtype=np.uint16))
                    which.append(np.fromiter(map(number.__getitem__, counts), dtype=np.int64, count=len(counts)))
                    times.append(np.fromiter(counts.values(), dtype=np.uint32, count=len(counts)))
                code = np.fromiter(map(xxhash.xxh3_64_intdigest, number), dtype=np.uint64, count=len(number))
                by_code = np.argsort(code)
                rank = np.empty(len(code), dtype=np.int64)
                rank[by_code] = np.arange(len(code))
                term = rank[np.concatenate(which)]
                order = np.argsort(term, kind="stable")
                packed = _pack(
                    doc_ids=np.array(piece.column("doc_id").to_pylist(), dtype=np.int64), lengths=np.array(lengths, dtype=np.int64),
                    terms=code[by_code], edges=np.searchsorted(term[order], np.arange(len(code) + 1)).astype(np.int64),
                    docs=np.concatenate(owner)[order], times=np.concatenate(times)[order],
                )
                yield pa.RecordBatch.from_pylist([{**packed, "n": piece.num_rows, "words": sum(lengths)}], schema)

    schema = pa.schema([*((k, pa.binary()) for k in _INDEX), ("n", pa.int64()), ("words", pa.int64())])
    ddl = ", ".join([*(f"{k} binary" for k in _INDEX), "n long", "words long"])
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(build, ddl), "search-index")


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, edges, term codes) of bounded size: the distinct terms of each query, in code order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_tables(batches, "text", SHARD_BYTES):
            codes = [
                np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, set(_words(t))), dtype=np.uint64)).tobytes()
                for t in part.column("text").to_pylist()
            ]
            yield from pa.table([part.column("query_id"), pa.array(codes, pa.binary())], ["query_id", "codes"]).to_batches()

    ids, codes, held = [], [], 0
    encoded = queries.select("query_id", "text").mapInArrow(encode, "query_id long, codes binary")
    for row in materialize(encoded, "queries").filter("octet_length(codes) > 0").orderBy("query_id").toLocalIterator():
        ids.append(row.query_id)
        codes.append(np.frombuffer(row.codes, dtype=np.uint64))
        held += len(codes[-1])
        if held >= QUERY_TERMS or len(ids) >= BLOCK_QUERIES:
            yield np.array(ids), np.cumsum([0, *map(len, codes)]), np.concatenate(codes)
            ids, codes, held = [], [], 0
    if held:
        yield np.array(ids), np.cumsum([0, *map(len, codes)]), np.concatenate(codes)


def _match(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``wanted`` whose code the sorted ``terms`` have, and where."""
    at = np.minimum(np.searchsorted(terms, wanted), max(0, len(terms) - 1))
    have = np.flatnonzero(terms[at] == wanted) if len(terms) else np.zeros(0, dtype=np.int64)
    return have, at[have]


def _document_counts(index: DataFrame, wanted, size: int) -> np.ndarray:
    """In how many documents each wanted term occurs: partial sums of each task, added up slice by slice."""
    width = 1 << 16

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                own = _unpack(row, {"terms": np.uint64, "edges": np.int64})
                have, at = _match(own["terms"], wanted.value)
                total[have] += own["edges"][at + 1] - own["edges"][at]
        parts = range(0, size, width)
        yield pa.record_batch(
            [pa.array(list(parts), pa.int64()), pa.array([total[a:a + width].tobytes() for a in parts], pa.binary())], ["part", "counts"]
        )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.int64) for c in rows["counts"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "counts": [total.tobytes()]})

    sums = index.select("terms", "edges").mapInArrow(partial, "part long, counts binary").groupBy("part").applyInPandas(add, "part long, counts binary")
    out = np.zeros(size, dtype=np.int64)
    for row in sums.collect():
        part = np.frombuffer(row.counts, dtype=np.int64)
        out[row.part:row.part + len(part)] = part
    return out


def contributions(idf: np.ndarray, times: np.ndarray, lengths: np.ndarray, mean: float) -> np.ndarray:
    """Millionths that a term adds to a document's score, rounded to whole numbers."""
    return np.rint(idf * (times * (K1 + 1)) / (times + K1 * (1 - B + B * lengths / mean)) * UNIT)


class _Shard:
    """The wanted terms of one shard: postings with block maxima, and rows for the frequent ones."""

    def __init__(self, row: dict, wanted: np.ndarray, idf: np.ndarray, mean: float):
        own = _unpack(row, _INDEX)
        self.doc_ids = own["doc_ids"]
        self.size = len(self.doc_ids)
        have, at = _match(own["terms"], wanted)
        first, count = own["edges"][at], own["edges"][at + 1] - own["edges"][at]
        picked = _spread(first, count)
        self.docs = own["docs"][picked]
        self.scores = contributions(  # below 2 ** 31: a term adds less than 2.2 times its idf, which is below 45
            np.repeat(idf[have], count), own["times"][picked].astype(np.float64), own["lengths"].astype(np.float64)[self.docs], mean,
        ).astype(np.int32)
        term = np.repeat(np.arange(len(have)), count)
        self.count, self.first = count, np.cumsum(count) - count
        self.place = np.full(len(wanted), -1, dtype=np.int64)
        self.place[have] = np.arange(len(have))

        frequent = np.flatnonzero((count >= max(2, self.size * FREQUENT)) & (idf[have] * (K1 + 1) * UNIT < EXACT))
        self.row_of = np.full(len(have), -1, dtype=np.int64)
        self.row_of[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), self.size), dtype=np.float32)
        at = _spread(self.first[frequent], count[frequent])
        self.rows[self.row_of[term[at]], self.docs[at]] = self.scores[at]
        self.row_count = count[frequent]

        self.blocks = np.arange(0, self.size, BLOCK_DOCS)
        key = term * (len(self.blocks) + 1) + self.docs // BLOCK_DOCS
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        self.entry_block = key[start] % (len(self.blocks) + 1)
        self.entry_start, self.entry_size = start, np.diff(np.append(start, len(key)))
        bounded = count >= len(self.blocks)
        self.bound_of = np.where(bounded, np.cumsum(bounded) - 1, -1)
        self.most = np.zeros((int(bounded.sum()), len(self.blocks)))
        self.entry_at = np.full(self.most.shape, -1, dtype=np.int64)
        if len(start):
            listed = np.flatnonzero(bounded[term[start]])
            where = self.bound_of[term[start[listed]]], self.entry_block[listed]
            self.most[where] = np.maximum.reduceat(self.scores, start)[listed]
            self.entry_at[where] = listed

    def top(self, queries: list[np.ndarray], k: int, floors: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """doc_ids and scores of the best k documents for each query, a list of numbers of wanted terms.

        With ``floors``, documents below the score given for a query may be left out.
        """
        own = [self.place[terms] for terms in queries]
        own = [places[places >= 0] for places in own]
        row = [self.row_of[places] for places in own]
        chosen = np.zeros((len(queries), len(self.rows)), dtype=np.float32)
        for i, rows in enumerate(row):
            chosen[i, rows[rows >= 0]] = 1
        used = chosen.sum(axis=0) * self.row_count > PRODUCT * len(queries) * self.size
        sums = chosen[:, used] @ self.rows[used]
        used = np.append(used, False)  # the last for terms without a row
        added = [used[rows] for rows in row]
        # n numbers above 0, added in single precision, are off by a part of n / 2 ** 24 or little more
        slack = 1 + 2 * (np.count_nonzero(used) + 4) / EXACT
        least = np.zeros(len(queries)) if floors is None else floors
        return [
            self._best(s, rows[a], places[~a], floor, slack, k) for s, rows, places, a, floor in zip(sums, row, own, added, least)
        ]

    def _best(self, sums: np.ndarray, rows: np.ndarray, own: np.ndarray, least: float, slack: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        known = least > 0
        bound_of = self.bound_of[own]
        lists = self._add_lists(own[bound_of < 0])
        frequent = sums * slack
        most = frequent + lists  # no less than the score of these terms
        own, bound_of = own[bound_of >= 0], bound_of[bound_of >= 0]
        if len(own):
            reached = np.maximum.reduceat(most, self.blocks)
            bound = reached + self.most[bound_of].sum(axis=0)
            if least <= 0:
                least = self._kth(reached, slack, k)  # by one document of each of k blocks
            if least <= 0 or not known and len(own) <= len(self.blocks):
                lead = np.sort(np.argsort(-bound, kind="stable")[:LEAD_BLOCKS])
                docs = _spread(lead * BLOCK_DOCS, np.minimum(BLOCK_DOCS, self.size - lead * BLOCK_DOCS))
                least = max(least, self._kth((most + self._add(self._entries(bound_of, lead)))[docs], slack, k))
            more = np.flatnonzero(bound >= max(least, 1.0))
            if 2 * len(more) > len(bound):
                lists = lists + self._add_lists(own)
            elif len(more):
                lists = lists + self._add(self._entries(bound_of, more))
            most = frequent + lists
        # in a block left out, no sum reaches the threshold
        found = np.flatnonzero(most >= max(least, 1.0))
        if not len(found):
            return self.doc_ids[found], found
        if len(found) > k:
            found = found[most[found] >= self._kth(most[found], slack, k)]
        score = self.rows[np.ix_(rows, found)].sum(axis=0, dtype=np.float64) + lists[found]  # whole numbers below 2 ** 53: exact
        kept = score >= max(least, 1.0)
        found, score = found[kept], score[kept]
        order = np.lexsort((self.doc_ids[found], -score))[:k]
        return self.doc_ids[found[order]], score[order].astype(np.int64)

    @staticmethod
    def _kth(most: np.ndarray, slack: float, k: int) -> float:
        """A score that k documents reach."""
        return np.partition(most, -k)[-k] / slack ** 2 if len(most) >= k else 0.0

    def _entries(self, bound_of: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Numbers of the parts of the terms' postings that lie in the blocks."""
        entries = self.entry_at[np.ix_(bound_of, blocks)].ravel()
        return entries[entries >= 0]

    def _add(self, entries: np.ndarray) -> np.ndarray:
        return self._sums(self.entry_start[entries], self.entry_size[entries])

    def _add_lists(self, own: np.ndarray) -> np.ndarray:
        return self._sums(self.first[own], self.count[own])

    def _sums(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = _spread(first, size)
        return np.bincount(self.docs[at], weights=self.scores[at], minlength=self.size)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each range, one after the other."""
    total = int(size.sum())
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)


#: Queries that are answered in one product and whose partial answers are merged together; terms they are grouped by.
MERGE_QUERIES = 128
GROUP_TERMS = 256


def _neighbours(marks: np.ndarray) -> np.ndarray:
    """An order in which rows with the same marks stand close: halves along the direction of most variation, again and again."""
    if len(marks) <= MERGE_QUERIES or not marks.size:
        return np.arange(len(marks))
    apart = marks - marks.mean(axis=0)
    axis = apart[np.argmax(np.square(apart).sum(axis=1))]
    for _ in range(8):
        axis = apart.T @ (apart @ axis)
        axis = axis / max(float(np.linalg.norm(axis)), 1e-30)
    order = np.argsort(apart @ axis, kind="stable")
    half = -(-len(order) // (2 * MERGE_QUERIES)) * MERGE_QUERIES
    return np.concatenate([part[_neighbours(marks[part])] for part in (order[:half], order[half:])])


def _grouped(edges: np.ndarray, which: np.ndarray, counts: np.ndarray, documents: int) -> np.ndarray:
    """The order in which queries are answered: those that share frequent terms together."""
    rank = np.full(len(counts), -1, dtype=np.int64)
    frequent = np.flatnonzero((counts >= max(2, documents * FREQUENT)) & (2 * counts <= documents))
    frequent = frequent[np.argsort(-counts[frequent], kind="stable")][:GROUP_TERMS]
    rank[frequent] = np.arange(len(frequent))
    marks = np.zeros((len(edges) - 1, len(frequent)), dtype=np.float32)
    query, mark = np.repeat(np.arange(len(marks)), np.diff(edges)), rank[which]
    marks[query[mark >= 0], mark[mark >= 0]] = 1
    return _neighbours(marks)


def _raised(floors: np.ndarray, best: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Adds new scores to the best ones of each query; the least of them is its floor."""
    for i, (_, scores) in enumerate(found):
        if len(scores) and scores[0] > floors[i]:
            best[i] = np.partition(np.append(best[i], scores), len(scores))[len(scores):]
            floors[i] = best[i].min()


def _search_block(index: DataFrame, block: tuple, documents: int, mean: float, k: int) -> DataFrame:
    spark = index.sparkSession
    ids, edges, codes = block
    names, which = np.unique(codes, return_inverse=True)
    wanted = spark.sparkContext.broadcast(names)
    counts = _document_counts(index, wanted, len(names))
    idf = np.log(1 + (documents - counts + 0.5) / (counts + 0.5))
    order = _grouped(edges, which, counts, documents)
    size = np.diff(edges)[order]
    which, edges, ids = which[_spread(edges[order], size)], np.cumsum([0, *size]), ids[order]
    shared = spark.sparkContext.broadcast((ids, edges, which, idf))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, edges, which, idf = shared.value
        floors, best = np.zeros(len(ids)), np.zeros((len(ids), k))
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Shard(row, wanted.value, idf, mean)
                for a in range(0, len(ids), MERGE_QUERIES):
                    own = range(a, min(a + MERGE_QUERIES, len(ids)))
                    found = shard.top([which[edges[q]:edges[q + 1]] for q in own], k, floors[own.start:own.stop])
                    _raised(floors[own.start:own.stop], best[own.start:own.stop], found)
                    sizes = np.array([len(d) for d, _ in found], dtype=np.int64)
                    yield pa.record_batch([
                        pa.array([a], pa.int64()), pa.array([sizes.tobytes()], pa.binary()),
                        pa.array([np.concatenate([d for d, _ in found]).tobytes()], pa.binary()),
                        pa.array([np.concatenate([s for _, s in found]).tobytes()], pa.binary()),
                    ], ["part", "sizes", "docs", "scores"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["part"].iloc[0])
        sizes = [np.frombuffer(x, dtype=np.int64) for x in rows["sizes"]]
        query = np.concatenate([np.repeat(np.arange(len(s)), s) for s in sizes])
        doc = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["docs"]])
        score = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["scores"]])
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        kept = rank <= k
        return pd.DataFrame({"query_id": shared.value[0][first + query[kept]], "rank": rank[kept], "doc_id": doc[kept], "score": score[kept]})

    partial = index.mapInArrow(search, "part long, sizes binary, docs binary, scores binary")
    schema = StructType([StructField(c, LongType()) for c in ("query_id", "rank", "doc_id", "score")])
    return partial.groupBy("part").applyInPandas(merge, schema)


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id and score (millionths) of the k best documents of every query.

    ``queries``: query_id, text; every distinct word of the whole text counts once.  Words are runs of
    characters other than ASCII whitespace, A-Z lower-cased.  Equal scores rank by doc_id.  Documents that
    share no word with a query are not answers; queries without words have none.  Null query ids are left
    out.  Repeated documents are answers of their own; of repeated query ids each is answered.
    """
    spark = prepare(docs.sparkSession)
    index = build_index(docs)
    sums = index.agg(F.sum("n"), F.sum("words")).first()
    documents, words = sums[0] or 0, sums[1] or 0
    usable = queries.filter(F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "text")
    found = None
    for block in _query_blocks(usable):
        part = _search_block(index, block, documents, max(words, 1) / max(documents, 1), k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank long, doc_id long, score long")
    return found
