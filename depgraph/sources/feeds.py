"""The two input feeds as flat tables.

A feed is read as nested JSON records and flattened once; every operator works
on the flat tables, so no record is ever re-assembled to answer a query.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depgraph.functions import columns as C


@dataclass(frozen=True)
class Feeds:
    """Flat tables of the module feed and the declaration feed.

    modules       seq, module, path, docstring, title, isDeprecated
    namespaces    namespace                      (declared and of declarations)
    imports       module, name, isPublic, isDeprecated, pos
    declarations  seq, module + the declaration columns
                  (seq and pos: any type whose order is the order of the feed)
    extract       seq, name, typeSignature, module, instantiates, instancePriority,
                  hasDeprecatedBy, replacement, message, since, additiveVersion,
                  nExtends, nConstructors
    deps          seq, src, module, dst, inType, inValue
    extends, fields, constructors   seq, src, module, dst, position
    """

    modules: DataFrame
    namespaces: DataFrame
    imports: DataFrame
    declarations: DataFrame
    extract: DataFrame
    deps: DataFrame
    extends: DataFrame
    fields: DataFrame
    constructors: DataFrame

    def map(self, change) -> Feeds:
        """The same feeds with ``change(name, table)`` applied to every table."""
        return Feeds(**{f.name: change(f.name, getattr(self, f.name)) for f in fields(self)})


def _feed_number(modules: DataFrame) -> Column:
    """The record's number; rows made by hand without one are put in an order of their own."""
    drawn = F.xxhash64("module", "path")
    return F.coalesce(F.col("seq"), drawn) if "seq" in modules.columns else drawn


def _order() -> Column:
    """Place in the feed: the record, then the item in its list."""
    return F.struct("feed", F.col("pos").cast("bigint").alias("pos"))


def explode_declarations(modules: DataFrame) -> DataFrame:
    """module.declarations[] -> one row per declaration with its owning module and its place in the feed."""
    feed = _feed_number(modules).alias("feed")
    items = modules.select("module", feed, F.posexplode("declarations").alias("pos", "d"))
    return items.select("module", _order().alias("seq"), "d.*")


def explode_imports(modules: DataFrame) -> DataFrame:
    feed = _feed_number(modules).alias("feed")
    items = modules.select("module", feed, F.posexplode("imports").alias("pos", "i"))
    return items.select("module", "i.name", "i.isPublic", "i.isDeprecated", _order().alias("pos"))


def explode_namespaces(modules: DataFrame) -> DataFrame:
    """Namespaces listed by modules together with those of their declarations."""
    own = F.coalesce(F.transform("declarations", lambda d: d["namespace"]), F.array())
    listed = F.coalesce("namespaces", F.array().cast("array<string>"))
    return modules.select(
        F.explode(F.array_distinct(F.concat(listed, own))).alias("namespace")
    ).distinct()


def _items(extract: DataFrame, array: str) -> DataFrame:
    return extract.select(
        "seq", F.col("name").alias("src"), "module", F.explode(array).alias("item")
    )


def explode_deps(extract: DataFrame) -> DataFrame:
    return _items(extract, "deps").select(
        "seq", "src", "module", F.col("item.name").alias("dst"),
        F.coalesce("item.inType", F.lit(False)).alias("inType"),
        F.coalesce("item.inValue", F.lit(False)).alias("inValue"),
    )


def explode_extends(extract: DataFrame) -> DataFrame:
    return _items(extract, "extends").select(
        "seq", "src", "module", F.col("item.parent").alias("dst"), "item.position"
    )


def explode_members(extract: DataFrame, array: str) -> DataFrame:
    """fields[] or constructors[] -> one row per member."""
    return _items(extract, array).select(
        "seq", "src", "module", F.col("item.name").alias("dst"), "item.position"
    )


def _size(array: str) -> Column:
    return F.size(F.coalesce(F.col(array), F.array())).cast("bigint")


def extract_scalars(extract: DataFrame) -> DataFrame:
    """The scalar columns of the declaration feed, with array sizes in place of arrays."""
    return extract.select(
        "seq", "name", C.truncate_signature(F.col("typeSignature")).alias("typeSignature"),
        "module", "instantiates", "instancePriority",
        F.col("deprecatedBy").isNotNull().alias("hasDeprecatedBy"),
        F.col("deprecatedBy.replacement").alias("replacement"),
        F.col("deprecatedBy.message").alias("message"), F.col("deprecatedBy.since").alias("since"),
        "additiveVersion", _size("extends").alias("nExtends"),
        _size("constructors").alias("nConstructors"),
    )


def flatten(modules: DataFrame, extract: DataFrame) -> Feeds:
    """Flat tables of two nested feeds."""
    return Feeds(
        modules=modules.select(
            _feed_number(modules).alias("seq"), "module", "path", "docstring", "title", "tags", "authors",
            "isDeprecated",
        ),
        namespaces=explode_namespaces(modules),
        imports=explode_imports(modules),
        declarations=explode_declarations(modules),
        extract=extract_scalars(extract),
        deps=explode_deps(extract),
        extends=explode_extends(extract),
        fields=explode_members(extract, "fields"),
        constructors=explode_members(extract, "constructors"),
    )
