"""Mixing sources to target weights, in DataFrame operations only.

The words of each source, in document order, are packed into blocks of fixed length.  Every slot
of an output shard draws its source, which makes the source counts of a shard multinomial.  The
n-th slot of a source takes block ``permutation(n mod blocks)`` of epoch ``n div blocks``; the
permutation is a swap-or-not shuffle, which needs no table and works for any number of blocks.
Blocks are then joined by index.  Draws beyond a source's quota are handed, unit by unit, to the
sources whose draws stayed below theirs.  A source's last slots take only the beginning of their blocks,
so that its words meet the target, rounded to whole words, however small the source is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depgraph.llm.common import prepare, word_count
from depgraph.operators.ranking import dense_index, running_total
from depgraph.session import materialize

#: Words of a block, blocks of an output shard, and how often a source may be repeated.
BLOCK_WORDS = 64
SHARD_BLOCKS = 1024
MAX_EPOCHS = 3
ROUNDS = 12


@dataclass
class Mix:
    """documents: doc_id, row key, src, size, first (its first word in the source); sources: one row for each;
    spans: pieces of documents in blocks; slots: shard, src, epoch, block, words (those it takes, from the block's
    start) and full (whether these are all); row_key: names of its columns."""

    documents: DataFrame
    sources: DataFrame
    spans: DataFrame
    slots: DataFrame
    row_key: tuple[str, ...] = ()


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds src (place by code point, null last), weight and target to (source, source_size).

    Weights run 1, 2, 3 and again.  Targets share all words by weight, but none exceeds
    ``max_epochs`` times its source; the excess goes to the others by weight.  With sources in the
    order of source_size / weight, exactly a head of that order is capped, so prefix sums decide.
    """
    keyed = sizes.withColumns({
        "is_null": F.col("source").isNull().cast("int"), "name": F.coalesce("source", F.lit("")),
    })
    numbered = (
        dense_index(keyed, ["is_null", "name"], "src")
        .withColumn("weight", F.col("src") % 3 + 1)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    numbered = materialize(numbered, "mix-sources")
    caps = running_total(numbered, ["ratio", "src"], "caps_before", F.col("cap"))
    before = running_total(caps, ["ratio", "src"], "weight_before", F.col("weight"))
    total, weight = sizes.agg(F.sum("source_size")).first()[0] or 0, numbered.agg(F.sum("weight")).first()[0] or 0
    wide = "decimal(38,0)"
    capped = (
        F.col("cap").cast(wide) * (F.lit(weight) - F.col("weight_before")).cast("decimal(18,0)")
        <= F.col("weight").cast(wide) * (F.lit(total) - F.col("caps_before")).cast("decimal(18,0)")
    )
    marked = materialize(before.withColumn("capped", capped), "mix-capped")
    used = marked.filter("capped").agg(F.sum("cap"), F.sum("weight")).first()
    free, rest = total - (used[0] or 0), weight - (used[1] or 0)
    level = F.col("weight").cast("double") * F.lit(float(free)) / F.lit(float(max(rest, 1)))
    return marked.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level)).select(
        "source", "is_null", "name", "src", "weight", "source_size", "target"
    )


def _shuffled(position: Column, size: Column, seed: int, *key: Column, back: bool = False) -> Column:
    """Swap-or-not: a pseudorandom permutation of 0 .. size - 1 for each key.  A round undoes itself, so the rounds
    in reverse order lead ``back``."""

    def swap(at: Column, turn: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), *key, turn), size) - at, size)
        coin = F.xxhash64(F.lit(seed + 1), *key, turn, F.greatest(at, partner)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, partner).otherwise(at)

    turns = (ROUNDS, 1) if back else (1, ROUNDS)
    return F.aggregate(F.sequence(*map(F.lit, turns)), position, swap)


def _quotas(targets: DataFrame, block_words: int, max_epochs: int, seed: int) -> DataFrame:
    """Of each source: its blocks, the words of its last block, the words it gives, the slots that hold them, the last
    epoch and the place of the last block in it, and where its slots start on the line of all.

    Whole epochs give the whole source.  The slots of the epoch that is cut short are as many as are needed even
    if the last block is among them.
    """
    size = F.greatest("source_size", F.lit(1))
    sized = targets.withColumns({
        "blocks": F.ceil(F.col("source_size") / block_words).cast("long"),
        "gives": F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs),
    })
    sized = sized.withColumns({
        "last_words": F.col("source_size") - (F.col("blocks") - 1) * block_words,
        "last_epoch": (F.col("gives") / size).cast("long"), "rest": F.col("gives") % size,
    })
    needed = F.ceil((F.col("rest") + block_words - F.col("last_words")) / block_words).cast("long")
    cut = F.when(F.col("rest") > 0, F.least(needed, F.col("blocks"))).otherwise(0)
    sized = sized.withColumn("quota", F.col("last_epoch") * F.col("blocks") + cut).withColumn(
        "last_place",
        _shuffled(F.col("blocks") - 1, F.greatest("blocks", F.lit(1)), seed + 2, F.col("src"), F.col("last_epoch"), back=True),
    )
    return materialize(running_total(sized, ["src"], "line", F.col("quota")), "mix-quotas")


#: Slots that a task draws places for.
TASK_SLOTS = 1 << 14


def _draw(quotas: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """shard, src, n: the slots of all shards, each source's slots numbered through."""
    spark = quotas.sparkSession
    sums = quotas.agg(F.sum("quota"), F.count("*")).first()
    slots, sources = sums[0] or 0, sums[1]
    width = max(1, slots // (4 * sources + 1024))
    grid = quotas.filter("quota > 0").select(
        "src", "line", "quota",
        F.explode(F.sequence((F.col("line") / width).cast("long"), ((F.col("line") + F.col("quota") - 1) / width).cast("long"))).alias("cell"),
    )
    drawn = (
        spark.range(slots)
        .select((F.col("id") / shard_blocks).cast("long").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(slots, 1))).alias("at"))
        .withColumn("cell", (F.col("at") / width).cast("long"))
    )
    inside = (F.col("at") >= F.col("line")) & (F.col("at") < F.col("line") + F.col("quota"))
    counts = drawn.join(grid, "cell").filter(inside).groupBy("shard", "src").agg(F.count("*").alias("draws"))
    numbered = materialize(running_total(counts, ["shard"], "before", F.col("draws"), ["src"]), "mix-counts")
    drawn_of = numbered.groupBy("src").agg(F.sum("draws").alias("drawn"))
    state = quotas.join(drawn_of, "src", "left").select(
        "src", "quota", F.coalesce("drawn", F.lit(0)).alias("drawn"),
        F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)).alias("over"),
        F.greatest(F.col("quota") - F.coalesce("drawn", F.lit(0)), F.lit(0)).alias("under"),
    )
    state = running_total(state, ["src"], "over_line", F.coalesce("over", F.lit(0)))
    state = materialize(running_total(state, ["src"], "under_line", F.col("under")), "mix-state")
    # the counts are few rows, the slots are many: spread them before they unfold
    units = numbered.repartition(max(1, slots // TASK_SLOTS), "shard", "src").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1)))
    units = units.join(state, "src").select("shard", "src", "quota", "over_line", (F.col("before") + F.col("i")).alias("n"))
    fine = units.filter("n < quota").select("shard", "src", "n")
    spare = units.filter("n >= quota").select("shard", (F.col("over_line") + F.col("n") - F.col("quota")).alias("unit"))
    lacking = state.filter("under > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)))
    lacking = lacking.select("src", (F.col("drawn") + F.col("i")).alias("n"), (F.col("under_line") + F.col("i")).alias("unit"))
    return fine.unionByName(spare.join(lacking, "unit").select("shard", "src", "n"))


def mix_sources(
    docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS,
    max_epochs: int = MAX_EPOCHS, seed: int = 17, row_key: tuple[str, ...] = (),
) -> Mix:
    """Plan of the mix over all documents (doc_id, text, source; other columns are ignored).

    Null texts and texts without words have size 0 and give no words.  Null sources form one source,
    the last.  Repeated rows count as documents of their own.  An empty table gives empty tables.
    The same rows give the same mix in every run.  ``row_key``: columns that are carried along and order rows
    of one number and size.
    """
    prepare(docs.sparkSession)
    sized = materialize(
        docs.select(
            "doc_id", *row_key, F.col("source").isNull().cast("int").alias("is_null"),
            F.coalesce("source", F.lit("")).alias("name"), "source", word_count(F.col("text")).alias("size"),
        ),
        "mix-sizes",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, max_epochs), "mix-targets")
    placed = sized.join(targets.select("is_null", "name", "src"), ["is_null", "name"])
    placed = running_total(placed.select("doc_id", *row_key, "src", "size"), ["doc_id", "size", *row_key], "first", F.col("size"), ["src"])
    placed = materialize(placed, "mix-documents")
    quotas = _quotas(targets, block_words, max_epochs, seed)
    last = ((F.col("first") + F.col("size") - 1) / block_words).cast("long")
    spans = (
        placed.filter("size > 0")
        .withColumn("block", F.explode(F.sequence((F.col("first") / block_words).cast("long"), last)))
        .withColumn("start", F.greatest(F.col("first"), F.col("block") * block_words))
        .withColumn("words", F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block_words) - F.col("start"))
        .withColumn("offset", F.col("start") - F.col("first"))
        .withColumn("inside", F.col("start") - F.col("block") * block_words)
    )
    drawn = _draw(quotas, shard_blocks, seed).join(
        quotas.select("src", "blocks", "source_size", "last_words", "gives", "last_epoch", "last_place"), "src"
    )
    epoch, place = F.expr("n div blocks"), F.col("n") % F.col("blocks")
    before = epoch * F.col("source_size") + place * block_words - F.when(
        (epoch == F.col("last_epoch")) & (F.col("last_place") < place), block_words - F.col("last_words")
    ).otherwise(0)
    block = _shuffled(place, F.col("blocks"), seed + 2, F.col("src"), epoch)
    placed_slots = drawn.withColumns({"epoch": epoch, "block": block, "before": before})
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("last_words")).otherwise(block_words)
    left = F.greatest(F.col("gives") - F.col("before"), F.lit(0))
    cut = (F.col("epoch") == F.col("last_epoch")) & (left < length)
    slots = placed_slots.select(
        "shard", "src", "epoch", "block", F.when(cut, left).otherwise(length).cast("long").alias("words"), (~cut).alias("full")
    )
    return Mix(placed, targets, spans, slots, row_key)


def taken_words(mix: Mix) -> DataFrame:
    """doc_id, row key, size, source_size, target, src, first and taken (words the mix takes) of every document."""
    # a block is cut short at most once, in the last epoch
    times = mix.slots.groupBy("src", "block").agg(
        F.count_if("full").alias("times"), F.max(F.when(~F.col("full"), F.col("words"))).alias("part")
    )
    begun = F.greatest(F.least(F.col("part") - F.col("inside"), F.col("words")), F.lit(0))
    used = (
        mix.spans.join(times, ["src", "block"], "left")
        .groupBy("doc_id", *mix.row_key, "src", "first", "size")
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0)) + F.coalesce(F.when(F.col("part").isNotNull(), begun), F.lit(0))).alias("taken"))
    )
    empty = mix.documents.filter("size = 0").select("doc_id", *mix.row_key, "src", "first", "size", F.lit(0).cast("long").alias("taken"))
    return used.unionByName(empty).join(mix.sources.select("src", "source_size", "target"), "src")


def mixed_blocks(mix: Mix, docs: DataFrame) -> DataFrame:
    """shard, slot, src, epoch, block, words, full and the words that the slot takes, parted by single blanks.

    Needs unique document numbers.  A shard's slots are in hash order.
    """
    from pyspark.sql import Window

    words = docs.select("doc_id", F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")).alias("all_words"))
    parts = mix.spans.join(words, "doc_id").select(
        "src", "block", "start", F.slice("all_words", (F.col("offset") + 1).cast("int"), F.col("words").cast("int")).alias("part")
    )
    texts = parts.groupBy("src", "block").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"])).alias("all_words")
    )
    order = Window.partitionBy("shard").orderBy(F.xxhash64("shard", "src", "epoch", "block"), "src", "epoch", "block")
    slots = mix.slots.withColumn("slot", F.row_number().over(order) - 1)
    text = F.array_join(F.slice("all_words", F.lit(1), F.col("words").cast("int")), " ").alias("text")
    return slots.join(texts, ["src", "block"]).select(*slots.columns, text)
