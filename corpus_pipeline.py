"""From raw documents to mixed, sharded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes every result as
Parquet into the shared folder and reads it again as the next stage's documents.  All stages but the
last return the columns of ``documents``.  Tables other than documents are read below ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph.llm import decontamination, mixing, quality, sharding, shingle_join
from depgraph.llm.common import table
from depgraph.operators.ranking import running_total
from depgraph.session import materialize

#: Near duplicates: words of a shingle, and the similarity in percent from which documents are one group.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Least probability of the highest grade that a document needs to stay.
GOOD = 0.5
SHARDS = 8
#: Units in which the mix counts parts of a document.
REST = 1 << 30


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade (neither toxic nor of low quality) is at least GOOD.

    The grader is fitted on the labelled ones among the documents.  Null and empty texts are graded by shape.
    Without labelled documents of the highest grade and of a lower one nothing is rejected.
    """
    model = quality.train(docs, quality.ratings_of(table(spark, sf_dir, "labels")), 3)
    graded = quality.grade(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, carry=["row"], name="grade")
    return graded.filter(quality.good(model, F.col("grade.tails"), GOOD)).select("row.*")


def keep_first_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest number, then text hash; rows without a
    number come last.  Rows of equal number and text stay once.

    Documents without words are no one's duplicates.
    """
    own = F.struct(F.col("doc_id").isNull().alias("unnumbered"), F.col("doc_id").alias("number"), F.xxhash64("text").alias("mark"))
    groups = shingle_join.similar_documents(docs.select(own.alias("row"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT, doc_id="row")
    groups = materialize(groups.select(F.col("doc_id").alias("row"), "component_id"), "similar")
    first = groups.filter(F.col("row").eqNullSafe(F.col("component_id"))).groupBy("row").count()
    first = materialize(first.select(F.col("row.number").alias("_kept"), F.col("row.mark").alias("_mark"), "count"), "firsts")
    same = docs["doc_id"].eqNullSafe(first["_kept"]) & (F.xxhash64(docs["text"]) == first["_mark"])
    kept = docs.join(first, same, "left_semi")
    repeated = first.filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _numbered_rows(docs: DataFrame) -> DataFrame:
    """row (all columns of a document) and number, which tells rows apart even if they are equal."""
    return materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")), "numbered-rows")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, as the mix of their sources takes their words.

    A row of which the mix takes t of s words appears t / s times: the whole part as it is, the rest by the
    running sum of the rests in its source, in order of size, which says where it passes a whole number.  So a
    source's words stay near its target, by about its longest document.  Rows without words appear once.
    """
    rows = _numbered_rows(docs)
    keyed = rows.select("row.doc_id", "row.text", "row.source", F.xxhash64(F.lit(29), "row.doc_id", "row.text").alias("mark"), "number")
    taken = mixing.taken_words(mixing.mix_sources(keyed, row_key=("mark", "number")))
    shares = taken.select(
        "number", "mark", "src", "size", F.expr("taken div greatest(size, 1)").alias("whole"),
        F.expr(f"(taken % greatest(size, 1)) * {REST} div greatest(size, 1)").alias("rest"),
    )
    placed = running_total(shares, ["size", "mark", "number"], "before", F.col("rest"), ["src"])
    copies = F.expr(f"whole + (before + rest + {REST // 2}) div {REST} - (before + {REST // 2}) div {REST}")
    counted = placed.select("number", F.when(F.col("size") == 0, 1).otherwise(copies).cast("int").alias("copies"))
    joined = rows.join(counted.filter("copies > 0"), "number")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents, and shard and slot (gapless from 0 in each shard), which replace
    columns of these names."""
    rows = _numbered_rows(docs)
    placed = sharding.shard_documents(rows.select("number", "row.doc_id", "row.text"), SHARDS, row_key=("number",))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return rows.join(placed.select("number", "shard", "slot"), "number").select(*kept, "shard", "slot")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_first_of_similar),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_to_targets),
    ("sharding", assign_shards),
]

#: The grader's weights come from an optimiser, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
