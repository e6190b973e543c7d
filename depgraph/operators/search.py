"""Name and text search over modules and declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depgraph.functions import checks
from depgraph.functions import columns as C
from depgraph.operators.reads import attributed


def search_rows(modules: DataFrame) -> DataFrame:
    """(name, lastSegment, title, docFirstLine) of modules with name, title and docstring."""
    return modules.select(
        "name", C.last_segment(F.col("name")).alias("lastSegment"), "title",
        C.first_line(F.col("docstring")).alias("docFirstLine"),
    )


def _lower(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def module_score(query: str) -> Column:
    """Score of one search row for a lower-case query text."""
    name, last, title, doc = map(_lower, ("name", "lastSegment", "title", "docFirstLine"))
    return (
        F.when(last.startswith(query), 90)
        .when(name.startswith(query), 70)
        .when(title.startswith(query), 50)
        .when(name.contains(query), 40)
        .when(title.contains(query), 25)
        .when(doc.contains(query), 10)
        .otherwise(0)
        .cast("bigint")
    )


def module_search(modules: DataFrame, text: str, limit: int = 10) -> DataFrame:
    query = text.strip().lower()
    scored = search_rows(modules).withColumn("score", module_score(query) if query else F.lit(0))
    hits = scored.filter("score > 0").orderBy(F.desc("score"), "lastSegment", "name")
    return hits.limit(limit).select("name", "lastSegment", "score")


def name_index(nodes: DataFrame) -> DataFrame:
    """(token, name, kind, module): the words of the names of attributed declarations, once each."""
    words = F.array_distinct(C.words(F.lower(F.concat_ws(" ", "name", "shortName"))))
    return attributed(nodes).select(F.explode(words).alias("token"), "name", "kind", "module")


def _prefix_range(term: str) -> Column:
    """Tokens that start with ``term``, as a range a stored index can be pruned by."""
    above = term[:-1] + chr(ord(term[-1]) + 1)
    return (F.col("token") >= term) & (F.col("token") < above)


def search_index(index: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Declarations with a name token starting with any query token; of the first ``limit`` if given.

    The score is the number of query tokens that some token of the name starts with.  Only the ranges
    of the query's tokens are read from ``index`` (see :func:`name_index`).
    """
    terms = sorted({term.lower() for term in C.query_terms(checks.query_text(text))})
    wanted, score = F.lit(False), F.lit(0)
    for term in terms:
        wanted = wanted | _prefix_range(term)
        score = score + F.max(_prefix_range(term).cast("int"))
    scored = index.filter(wanted).groupBy("name", "kind", "module").agg(score.cast("bigint").alias("score"))
    hits = scored.orderBy(F.desc("score"), "name")
    return hits if limit is None else hits.limit(limit)


def decl_search(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """The first declarations that match; for a stored index use :func:`search_index`."""
    return search_index(name_index(nodes), text, checks.clamp(limit, checks.SEARCH_LIMIT))


def mixed_search(modules: DataFrame, decls: DataFrame) -> DataFrame:
    """Module hits first, then declaration hits; the two are not ranked against each other."""
    first = modules.select(
        F.lit(0).alias("section"), F.lit("module").alias("type"), "name",
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("module"), "score",
    )
    second = decls.select(
        F.lit(1).alias("section"), F.lit("decl").alias("type"), "name", "kind", "module", "score"
    )
    return first.unionByName(second)


def text_index(nodes: DataFrame) -> DataFrame:
    """(token, name, hits): words of docstring, short name, signature and source text."""
    text = F.concat_ws(" ", "docstring", "shortName", "typeSignature", "sourceText")
    tokens = nodes.select("name", F.explode(C.words(F.lower(text))).alias("token"))
    return tokens.groupBy("token", "name").agg(F.count(F.lit(1)).alias("hits"))

