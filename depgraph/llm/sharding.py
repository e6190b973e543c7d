"""Vector bin packing of documents into shards, balanced in bytes, words and rows at once.

Equal texts form a group.  Each group goes to the shard whose residual capacity has the highest
dot product with the group's demand, among the shards that have room for it in every dimension; all
dimensions weigh alike, as parts of their totals.  Where no shard has room in all, those with room in
bytes are left, and where none has that, the one with the most: so a shard is overfull in bytes by one
group at most.  Groups that are large against a shard come first, in one global order; their number is
bounded by the number of shards over ``LARGE``.  The rest is dealt to cells by hash; each cell repeats the
same rule with its share of what the large groups left, so the cells can run side by side and their
results add up.

A group stays whole while some shard has room for it; only a large group that fits nowhere is divided, into
one piece for each shard at most.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depgraph.llm.common import prepare, word_count
from depgraph.operators.ranking import position_in_group
from depgraph.session import materialize

#: A group is large from this part of a shard's capacity on: 3 * shards / LARGE groups at most.
LARGE = 1 / 500
#: Groups that a cell of small groups holds on average.
CELL_GROUPS = 20_000
_DEMAND = ["bytes", "words", "rows"]


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def slim(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row_key: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, row key, group key and demand of every document."""
    body = F.col(text)
    return docs.select(
        F.col(doc_id).alias("doc_id"), *row_key,
        F.coalesce(F.unhex(F.sha2(body, 256)), F.lit(b"")).alias("key"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        byte_size(body).alias("bytes"), word_count(body).alias("words"),
    )


#: Part of a total that rounding may make of nothing.
_NOTHING = 1e-12


def _best(residual: np.ndarray, item: np.ndarray) -> int:
    """The shard for one group: see the rule above.  Ties go to the lowest shard."""
    room = residual + _NOTHING >= item
    fits = room.all(axis=1)
    if not fits.any():
        fits = room[:, 0]
        if not fits.any():
            return int(np.argmax(residual[:, 0]))
    return int(np.argmax(np.where(fits, residual @ item, -np.inf)))


def _fill(demand: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each demand, in the order given; ``residual`` (shards x 3) is used up."""
    out = np.empty(len(demand), dtype=np.int32)
    for i, item in enumerate(demand):
        best = out[i] = _best(residual, item)
        residual[best] -= item
    return out


def _divide(copies: int, one: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """How many of the copies each shard takes: in proportion to those it has room for, and the few that rounding
    leaves to the shards of the most bytes left.  Evenly where no shard has room for any."""
    room = np.maximum((residual[:, one > 0] / one[one > 0]).min(axis=1, initial=float(copies)), 0)
    if room.sum() <= 0:
        room = np.ones(len(residual))
    taken = np.floor(copies * room / room.sum()).astype(np.int64)
    order = np.argsort(-(residual[:, 0] - taken * one[0]), kind="stable")
    taken[order[:copies - taken.sum()]] += 1
    return taken


def _place_large(large: list, totals: np.ndarray, shards: int) -> tuple[list, np.ndarray]:
    """Pieces (key, first copy, copies, shard) of the large groups, at most one a shard for each; the capacity left."""
    scale = np.maximum(totals, 1.0)
    residual = np.tile(totals / scale / shards, (shards, 1))
    pieces = []
    for row in large:
        item = np.array([row.bytes, row.words, row.rows], dtype=float) / scale
        if row.rows == 1 or (residual + _NOTHING >= item).all(axis=1).any():
            best = _best(residual, item)
            residual[best] -= item
            pieces.append((bytearray(row.key), 0, row.rows, best))
            continue
        one, first = item / row.rows, 0
        for k, copies in enumerate(_divide(row.rows, one, residual)):
            if copies:
                residual[k] -= one * copies
                pieces.append((bytearray(row.key), first, int(copies), k))
                first += int(copies)
    return pieces, residual


def shard_documents(
    docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", row_key: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, row key, bytes, words, text_crc32, key, shard and slot (gapless from 0) of every document.

    Null texts form one group of size 1 each, and have no checksum.  Repeated rows are copies like
    any others.  Ties go to the lowest shard.  Other columns are ignored; an empty table gives an
    empty result.  ``row_key``: columns that are carried along and order rows of one number and text.
    """
    spark = prepare(docs.sparkSession)
    order = ["doc_id", "text_crc32", "bytes", *row_key]
    rows = materialize(slim(docs, text, doc_id, row_key), "shard-rows")
    groups = materialize(
        rows.groupBy("key").agg(
            F.sum("bytes").alias("bytes"), F.sum("words").alias("words"), F.count("*").alias("rows")
        ),
        "shard-groups",
    )
    total = groups.agg(*(F.sum(c).alias(c) for c in _DEMAND), F.count("*").alias("groups")).first()
    totals = np.array([total[c] or 0 for c in _DEMAND], dtype=float)
    floor = totals * LARGE / shards
    is_large = F.greatest(*(F.col(c) >= F.lit(float(floor[i])) for i, c in enumerate(_DEMAND)))
    large = groups.filter(is_large).orderBy(F.desc("bytes"), F.desc("words"), "key").collect()
    pieces, residual = _place_large(large, totals, shards)
    share = np.maximum(residual, 0) + 1e-15
    share = share / share.sum(axis=0)
    cells = max(1, math.ceil((total["groups"] - len(large)) / CELL_GROUPS))

    def pack(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["bytes", "words", "key"], ascending=[False, False, True])
        demand = cell[_DEMAND].to_numpy(dtype=float)
        whole = np.maximum(demand.sum(axis=0), 1.0)
        return pd.DataFrame({"key": cell["key"], "shard": _fill(demand / whole, share * (demand.sum(axis=0) / whole))})

    small = (
        groups.filter(~is_large)
        .withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
        .groupBy("cell").applyInPandas(pack, "key binary, shard int")
        .select("key", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("copies"), "shard")
    )
    pieces_of = Counter(bytes(p[0]) for p in pieces)
    divided = {key for key, n in pieces_of.items() if n > 1}
    whole = [(k, 0, None, s) for k, _, _, s in pieces if bytes(k) not in divided]
    schema = "key binary, first long, copies long, shard int"
    homes = materialize(small.unionByName(spark.createDataFrame(whole, schema)), "shard-homes")
    placed = rows.join(homes.select("key", "shard"), "key")
    if divided:
        parts = spark.createDataFrame([p for p in pieces if bytes(p[0]) in divided], schema)
        ranked = position_in_group(
            rows.join(F.broadcast(parts.select("key").distinct()), "key", "left_semi"),
            ["key"], order, "copy",
        )
        inside = (F.col("copy") >= F.col("first")) & (F.col("copy") < F.col("first") + F.col("copies"))
        split = ranked.join(F.broadcast(parts), "key").filter(inside).select(*rows.columns, "shard")
        placed = placed.unionByName(split)
    return position_in_group(placed, ["shard"], order, "slot")
