"""Exact Jaccard self-join of documents on word shingles, with set-relation skipping.

1. Documents with equal shingle sets form a class; classes are joined, copies only counted.
2. Each task hands its shingles to hash buckets.  A bucket counts in how many classes a shingle
   occurs and answers for those in two or more; shingles of one class alone can join nothing.
3. Shingles are ordered by that count (rare first).  A set can only link to sets that share one of
   its first ones; these prefixes form index lists.
4. Index lists are sorted by set size and cut into blocks by position: a posting behind its set's
   indexing prefix only looks at smaller sets, and lists break where sizes are too far apart.  What
   remains is tied together by one edge for each posting; connected postings form a family.
5. Inside a family each pivot set is intersected with all others through the family's index.  The
   answers of a set similar to the pivot are derived from the pivot's: only the lists of the
   shingles in which the two differ are read.  Families beyond a bounded size are compared in blocks.
6. Links give each member a root and a count; components of the links give the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from depgraph.llm.common import prepare, text_tables
from depgraph.llm.components import components
from depgraph.operators.ranking import dense_index, running_total
from depgraph.session import materialize

SHINGLE_WORDS = 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
TABLE_BYTES = 8 << 20
#: Shingles a hash bucket holds, and a block of a family, on average.
BUCKET_SHINGLES = 3_000_000
BLOCK_SHINGLES = 400_000
_VOCABULARY = 500_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _WordCodes(dict):
    """64-bit codes of words, remembered up to a bounded number."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(self) < _VOCABULARY:
            self[word] = code
        return code


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, codes: _WordCodes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit codes of the distinct shingles; a text of fewer words is one shingle, none gives none."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    code = np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(code))
    with np.errstate(over="ignore"):
        out = np.full(len(code) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = _mix(out * _M1 + code[k:len(code) - width + 1 + k])
    return np.unique(out)


def _signature(codes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(codes.tobytes())


def set_sizes(docs: DataFrame, width: int = SHINGLE_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, signature of the shingle set (null: empty) and n_shingles of every document."""
    schema = StructType([StructField("doc_id", docs.schema[doc_id].dataType)])
    schema = schema.add("signature", "binary").add("n_shingles", LongType())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _WordCodes()
        for part in text_tables(batches, "text", TABLE_BYTES):
            sets = [shingle_set(t, codes, width) for t in part.column("text").to_pylist()]
            signatures = pa.array([_signature(s) if len(s) else None for s in sets], pa.binary())
            sizes = pa.array(list(map(len, sets)), pa.int64())
            yield from pa.table({"doc_id": part.column("doc_id"), "signature": signatures, "n_shingles": sizes}).to_batches()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, schema)


_PACKED = [("owner", "S16"), ("size", np.int64), ("count", np.int64)]


def _pack(kind: np.ndarray, owner: np.ndarray, heads: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[dict]:
    """Rows (kind, heads, columns ...) of entries in ``kind`` order; within a kind, entries of an owner stand together."""
    edges = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(kind) else np.zeros(0, dtype=np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(kind))):
        own = owner[a:b]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        head = heads[own[first]].copy()
        head["count"] = np.diff(np.append(first, b - a))
        yield {"kind": int(kind[a]), "heads": head.tobytes(), **{k: v[a:b].tobytes() for k, v in columns.items()}}


def _requests(docs: DataFrame, buckets: int, width: int, text: str) -> DataFrame:
    """kind (bucket), heads, codes: the shingles of the documents of a task, dealt to hash buckets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _WordCodes()
        for part in text_tables(batches, "text", TABLE_BYTES):
            sets = {}
            for t in part.column("text").to_pylist():
                own = shingle_set(t, codes, width)
                if len(own):
                    sets.setdefault(_signature(own), own)
            if not sets:
                continue
            heads = np.array([(s, len(x), 0) for s, x in sets.items()], dtype=_PACKED)
            owner = np.repeat(np.arange(len(sets)), heads["size"])
            code = np.concatenate(list(sets.values()))
            kind = ((code >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            order = np.argsort(kind, kind="stable")
            for row in _pack(kind[order], owner[order], heads, {"codes": code[order]}):
                yield pa.RecordBatch.from_pylist([row], pa.schema([("kind", pa.int64()), ("heads", pa.binary()), ("codes", pa.binary())]))

    return docs.select(F.col(text).alias("text")).mapInArrow(scan, "kind long, heads binary, codes binary")


def _padded(names: np.ndarray) -> np.ndarray:
    """Signatures as 16 raw bytes each; numpy drops zero bytes at the end of an S16."""
    return names.astype("S16").view("V16")


def _count(rows: pd.DataFrame, replies: int) -> pd.DataFrame:
    """Of a bucket: the shingles that two classes or more have, with that number, dealt by class."""
    heads = np.concatenate([np.frombuffer(h, dtype=_PACKED) for h in rows["heads"]])
    code = np.concatenate([np.frombuffer(c, dtype=np.uint64) for c in rows["codes"]])
    _, first = np.unique(_padded(heads["owner"]), return_index=True)
    fresh = np.zeros(len(heads), dtype=bool)
    fresh[first] = True
    code = code[np.repeat(fresh, heads["count"])]
    heads = heads[fresh]
    owner = np.repeat(np.arange(len(heads)), heads["count"])
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    times = np.diff(np.append(start, len(code)))
    classes = np.repeat(times, times)
    shared = classes > 1
    code, owner, classes = code[shared], owner[shared], classes[shared]
    lead = np.frombuffer(_padded(heads["owner"]).tobytes(), dtype=">u8").reshape(-1, 2)[:, 0]
    kind = ((lead >> np.uint64(40)) * np.uint64(replies) >> np.uint64(24)).astype(np.int64)[owner]
    order = np.lexsort((owner, kind))
    columns = {"codes": code[order], "classes": classes[order]}
    return pd.DataFrame(
        list(_pack(kind[order], owner[order], heads, columns)), columns=["kind", "heads", "codes", "classes"]
    )


_CANDIDATES = "signature binary, n_shingles long, own long, prefix array<long>, codes binary"


def _prefixes(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Classes whose first shingles, rare first, hold one that other classes have too."""
    heads = np.concatenate([np.frombuffer(h, dtype=_PACKED) for h in rows["heads"]])
    code = np.concatenate([np.frombuffer(c, dtype=np.uint64) for c in rows["codes"]])
    classes = np.concatenate([np.frombuffer(c, dtype=np.int64) for c in rows["classes"]])
    names, first, which = np.unique(_padded(heads["owner"]), return_index=True, return_inverse=True)
    owner = np.repeat(which, heads["count"])
    order = np.lexsort((code, classes, owner))
    code, owner = code[order], owner[order]
    edge = np.searchsorted(owner, np.arange(len(names) + 1))
    sizes = heads["size"][first]
    out = []
    for i, size in enumerate(sizes.tolist()):
        own = size - int(edge[i + 1] - edge[i])
        take = size - -(-percent * size // 100) + 1 - own
        if take > 0:
            mine = code[edge[i]:edge[i + 1]]
            out.append((names[i].tobytes(), size, own, mine[:take].view(np.int64).tolist(), mine.tobytes()))
    return pd.DataFrame(out, columns=["signature", "n_shingles", "own", "prefix", "codes"])


def _families(candidates: DataFrame, percent: int) -> DataFrame:
    """node, root: candidate classes tied together by the blocks of the index lists."""
    size, place = F.col("n_shingles"), F.col("own") + F.col("at")
    indexing = size - F.ceil(size * (2 * percent) / F.lit(100 + percent)).cast("long") + 1
    postings = (
        candidates.select("id", "n_shingles", "own", F.posexplode("prefix").alias("at", "code"))
        .select("code", "n_shingles", (place >= indexing).cast("int").alias("deep"), "id")
    )
    order = ["code", "n_shingles", "deep", "id"]
    cells = materialize(postings.repartitionByRange(*order).withColumn("cell", F.spark_partition_id()), "postings")
    index = F.when(F.col("deep") == 0, F.struct("n_shingles", "id"))
    inside = Window.partitionBy("cell", "code").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("code").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cells.groupBy("cell", "code").agg(F.max(index).alias("newest"))
        .withColumn("carried", F.last("newest", ignorenulls=True).over(across)).drop("newest")
    )
    tied = cells.withColumn("before", F.last(index, ignorenulls=True).over(inside)).join(carried, ["cell", "code"])
    nearest = F.coalesce("before", "carried")
    return components(
        tied.select("id", size, nearest.alias("near"))
        .filter(F.col("near").isNotNull() & (F.col("near.n_shingles") * 100 >= size * percent))
        .select(F.col("id").alias("u"), F.col("near.id").alias("v"))
    )


class _Index:
    """Inverted index of sets; sets stand in the order of their size."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array(list(map(len, sets)), dtype=np.int64)
        self.count = len(sets)
        code = np.concatenate(sets)
        names, which = np.unique(code, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(which, kind="stable")
        self.owners = owner[order]
        self.edge = np.searchsorted(which[order], np.arange(len(names) + 1))
        cut = np.cumsum(sizes)[:-1]
        self.sets = [np.sort(x) for x in np.split(which, cut)]

    def overlaps(self, shingles: np.ndarray) -> np.ndarray:
        """For each set, how many of the shingles it has."""
        a, times = self.edge[shingles], self.edge[shingles + 1] - self.edge[shingles]
        at = np.repeat(a - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        return np.bincount(self.owners[at], minlength=self.count)


def linked_pairs(sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(set, the sets it links to) of every set; ``sizes`` counts shingles no other set has, too."""
    index = _Index(sets)
    own = np.array(list(map(len, index.sets)), dtype=np.int64)
    waiting = np.ones(len(sets), dtype=bool)
    for pivot in range(len(sets)):
        if not waiting[pivot]:
            continue
        base = index.overlaps(index.sets[pivot])
        differ = own[pivot] + own - 2 * base
        for follower in np.flatnonzero(waiting & (differ < own)):
            mine, theirs = index.sets[follower], index.sets[pivot]
            if differ[follower]:
                gone, come = np.setdiff1d(theirs, mine, True), np.setdiff1d(mine, theirs, True)
                found = base - index.overlaps(gone) + index.overlaps(come)
            else:
                found = base
            union = sizes[follower] + sizes - found
            linked = 100 * found >= percent * union
            linked[follower] = False
            waiting[follower] = False
            yield int(follower), np.flatnonzero(linked)
        if waiting[pivot]:  # a set without shared shingles
            waiting[pivot] = False
            yield pivot, np.zeros(0, dtype=np.int64)


def _verify(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of the families (or pairs of blocks) of a unit: root and links of each member."""
    out = []
    for _, unit in rows.groupby(["family", "low", "high"], sort=True):
        unit = unit.sort_values(["n_shingles", "id"])
        ids, copies, block = (unit[c].to_numpy() for c in ("id", "copies", "block"))
        sets = [np.frombuffer(c, dtype=np.uint64) for c in unit["codes"]]
        low, high = unit["low"].iloc[0], unit["high"].iloc[0]
        root = np.arange(len(ids))
        links = np.zeros(len(ids), dtype=np.int64)

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, near in linked_pairs(sets, unit["n_shingles"].to_numpy(), percent):
            if low != high:
                near = near[block[near] != block[i]]
            links[i] += copies[near].sum()
            mine = top(i)
            for j in np.unique(root[near]).tolist():
                other = top(j)
                root[max(mine, other)] = min(mine, other)
                mine = min(mine, other)
        out.append(pd.DataFrame({"id": ids, "root": ids[[top(i) for i in range(len(ids))]], "links": links}))
    return pd.concat(out)


def _links(members: DataFrame, percent: int) -> DataFrame:
    """id, root, links of the candidate classes of all families (id, family, n_shingles, copies, codes)."""
    sized = members.withColumn("weight", (F.octet_length("codes") / 8 + 1).cast("long"))
    placed = running_total(sized, ["n_shingles", "id"], "before", F.col("weight"), ["family"])
    placed = placed.withColumn("block", (F.col("before") / BLOCK_SHINGLES).cast("int"))
    placed = materialize(placed, "family-members")
    blocks = placed.groupBy("family").agg(F.max("block").alias("last"), F.sum("weight").alias("all"))
    total = blocks.agg(F.sum("all")).first()[0] or 0
    bundles = max(1, math.ceil(total / BLOCK_SHINGLES))
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    units = (
        placed.join(blocks.select("family", "last"), "family").withColumn("other", other)
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    )
    # a pair of two blocks takes both; a family of one block shares its task with others
    small = F.concat_ws(":", F.pmod(F.xxhash64("family"), F.lit(bundles)).cast("string"))
    large = F.concat_ws(":", F.col("family").cast("string"), F.col("low").cast("string"), F.col("high").cast("string"))
    return (
        units.withColumn("unit", F.when(F.col("last") == 0, small).otherwise(large))
        .select("unit", "family", "low", "high", "block", "id", "n_shingles", "copies", "codes")
        .groupBy("unit").applyInPandas(lambda rows: _verify(rows, percent), "id long, root long, links long")
    )


def similar_documents(
    docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), copies (documents with the
    same set, itself included) and n_links (documents it links to) of every document.

    Words are runs of characters other than ASCII whitespace, A-Z lower-cased; texts are used whole.
    Null and empty texts have no shingles and link to nothing, so they are their own component.
    Repeated rows are copies.  Other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    sizes = materialize(set_sizes(docs, width, text, doc_id), "set-sizes")
    classes = (
        sizes.filter(F.col("signature").isNotNull()).groupBy("signature")
        .agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    )
    classes = materialize(classes, "set-classes")
    total = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_SHINGLES))
    replies = max(1, buckets // 2)
    reply = "kind long, heads binary, codes binary, classes binary"
    counted = _requests(docs, buckets, width, text).groupBy("kind").applyInPandas(lambda rows: _count(rows, replies), reply)
    found = materialize(counted.groupBy("kind").applyInPandas(lambda rows: _prefixes(rows, percent), _CANDIDATES), "candidates")
    candidates = materialize(dense_index(found, ["signature"], "id"), "numbered-candidates")
    families = _families(candidates, percent)
    roots = families.select("root").distinct()
    tied = families.unionByName(roots.select(F.col("root").alias("node"), "root"))
    members = (
        candidates.select("id", "signature", "n_shingles", "codes")
        .join(tied.select(F.col("node").alias("id"), F.col("root").alias("family")), "id")
        .join(classes.select("signature", "copies"), "signature")
        .drop("signature")
    )
    links = materialize(_links(members, percent), "links")
    joined = components(links.select(F.col("id").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    home = (
        candidates.select("id", "signature")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
        .join(counts, "id", "left")
        .select("signature", F.coalesce("root", "id").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    home = materialize(home.join(classes, "signature"), "homes")
    least = home.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    answers = classes.join(
        home.join(least, "component").select("signature", "component_id", "links"), "signature", "left"
    ).select(
        "signature", "copies", F.coalesce("component_id", "first_doc").alias("component_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return sizes.join(answers, "signature", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
