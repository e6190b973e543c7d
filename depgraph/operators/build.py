"""Property-graph build: node tables and edge tables from the flat feeds."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.functions import columns as C
from depgraph.sources.feeds import Feeds

TYPE_KINDS = ("structure", "class", "inductive")

_PROPS = (
    "shortName", "kind", "namespace", "docstring", "sourceFile", "startLine", "endLine",
    "sourceText", "attrs", "isProtected", "isDeprecated", "deprecatedSince",
)


@dataclass(frozen=True)
class Graph:
    """Three node tables and one table per edge kind."""

    modules: DataFrame
    namespaces: DataFrame
    declarations: DataFrame
    depends_on: DataFrame
    imports: DataFrame
    in_namespace: DataFrame
    subnamespace_of: DataFrame
    defined_in: DataFrame
    extends: DataFrame
    instantiates: DataFrame
    deprecated_by: DataFrame
    has_additive_version: DataFrame
    has_field: DataFrame
    has_constructor: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


# ---- node properties ------------------------------------------------------------------

def decl_props(declarations: DataFrame) -> DataFrame:
    """Parsed declarations as flat node properties; anonymous ones have no node."""
    attrs = F.col("attrs") if "attrs" in declarations.columns else F.array_compact(F.array("attr"))
    return declarations.filter(F.col("name") != "").select(
        "seq", "module", "name", "shortName", "kind", "namespace", "docstring", "sourceFile",
        "startLine", "endLine", "sourceText", attrs.alias("attrs"), "isProtected",
        F.lit(False).alias("isExternal"), "isDeprecated",
        F.date_format("deprecatedSince", "yyyy-MM-dd").alias("deprecatedSince"),
    )


def parsed_nodes(declarations: DataFrame) -> DataFrame:
    """One row per parsed name; a repeated name keeps its last record."""
    props = decl_props(declarations)
    order = F.struct("seq", "module", "startLine")
    last = F.max_by(F.struct(*_PROPS), order).alias("p")
    return props.groupBy("name").agg(last).select("name", "p.*")


def module_nodes(feeds: Feeds) -> DataFrame:
    """Modules of the feed plus a bare row for every import target without a record."""
    columns = [c for c in feeds.modules.columns if c not in ("seq", "module")]
    known = feeds.modules.groupBy("module").agg(F.max_by(F.struct(*columns), "seq").alias("p"))
    bare = feeds.imports.select(F.col("name").alias("module"))
    named = known.select("module").unionByName(bare).distinct()
    return named.join(known, "module", "left").select(F.col("module").alias("name"), "p.*")


# ---- namespaces -----------------------------------------------------------------------

def namespace_tree(namespaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every prefix of every namespace with its depth, and child -> parent edges."""
    parts = F.filter(F.split("namespace", r"\."), lambda part: part != "")
    prefix = F.transform(
        F.sequence(F.lit(1), F.size("parts")),
        lambda depth: F.struct(
            F.array_join(F.slice("parts", F.lit(1), depth), ".").alias("name"),
            depth.cast("bigint").alias("depth"),
            F.when(depth > 1, F.array_join(F.slice("parts", F.lit(1), depth - 1), ".")).alias("parent"),
        ),
    )
    split = namespaces.select("namespace").distinct().select(parts.alias("parts"))
    rows = split.filter(F.size("parts") > 0).select(F.explode(prefix).alias("n"))
    nodes = rows.select("n.*").distinct()
    edges = nodes.filter("parent IS NOT NULL").select(
        F.col("name").alias("child"), "parent"
    )
    return nodes.select("name", "depth"), edges


# ---- edges straight from the records ----------------------------------------------------

def dependency_rows(deps: DataFrame) -> DataFrame:
    """Distinct (src, dst, context) in the order of src and dst.

    Repeats are rare, so rows are dealt out first and made distinct where they arrive; a hub is split over ranges.
    """
    context = C.dep_context(F.col("inType"), F.col("inValue"))
    rows = deps.select("src", "dst", context.alias("context"))
    return rows.repartitionByRange("src", "dst").distinct().sortWithinPartitions("src", "dst")


def extends_rows(extends: DataFrame) -> DataFrame:
    return extends.select("src", "dst", "position").distinct()


def instantiates_rows(extract: DataFrame) -> DataFrame:
    return extract.filter("instantiates <> ''").select(
        F.col("name").alias("src"), F.col("instantiates").alias("dst"),
        F.col("instancePriority").alias("priority"),
    ).distinct()


def deprecated_by_rows(extract: DataFrame) -> DataFrame:
    """Records whose replacement is null are kept elsewhere but give no edge."""
    return extract.filter("hasDeprecatedBy AND replacement IS NOT NULL").select(
        F.col("name").alias("src"), F.col("replacement").alias("dst"), "message", "since"
    ).distinct()


def additive_rows(extract: DataFrame) -> DataFrame:
    return extract.filter("additiveVersion <> ''").select(
        F.col("name").alias("src"), F.col("additiveVersion").alias("dst")
    ).distinct()


def type_names(declarations: DataFrame) -> DataFrame:
    """Names of parsed declarations whose fields and constructors are in scope."""
    named = declarations.filter(F.col("kind").isin(*TYPE_KINDS) & (F.col("name") != ""))
    return named.select("name").distinct()


def member_rows(members: DataFrame, types: DataFrame) -> DataFrame:
    """Members of in-scope types only."""
    in_scope = members.join(types.select(F.col("name").alias("src")), "src", "leftsemi")
    return in_scope.select("src", "dst", "position").distinct()


def dependency_names(deps: DataFrame) -> DataFrame:
    return deps.select(F.col("dst").alias("name")).distinct()


def relation_targets(feeds: Feeds) -> DataFrame:
    """Endpoint names of extends, instantiates, deprecated-by and additive-version."""
    scalars = feeds.extract.select(
        F.explode(F.array("instantiates", "replacement", "additiveVersion")).alias("name")
    ).filter("name <> ''")
    return scalars.unionByName(feeds.extends.select(F.col("dst").alias("name"))).distinct()


# ---- joins that complete the node table -------------------------------------------------

def edge_endpoints(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges whose two ends both exist as nodes."""
    return edges.join(
        names.select(F.col("name").alias("src")), "src", "leftsemi"
    ).join(names.select(F.col("name").alias("dst")), "dst", "leftsemi").select(*edges.columns)


def placeholder_nodes(targets: DataFrame, known: DataFrame) -> DataFrame:
    """Referenced names without a node become external placeholders."""
    missing = targets.join(known.select("name"), "name", "leftanti").distinct()
    return missing.select("name", F.lit(True).alias("isExternal"))


def attributed_records(extract: DataFrame) -> DataFrame:
    """One row per name of the records that carry a module: last module and signature."""
    kind = C.infer_kind(F.col("instantiates"), F.col("nConstructors"), F.col("nExtends"))
    return extract.filter("module <> ''").groupBy("name").agg(
        F.max_by("module", "seq").alias("module"),
        F.max_by("typeSignature", "seq").alias("typeSignature"),
        F.min_by(kind, "seq").alias("inferredKind"),
    )


def attribute_modules(parsed: DataFrame, extract: DataFrame) -> DataFrame:
    """Upsert module, signature and fallback kind onto the parsed declarations."""
    records = attributed_records(extract)
    joined = parsed.join(records, "name", "full_outer")
    return joined.withColumn("kind", F.coalesce("kind", "inferredKind")).withColumn(
        "isExternal", F.col("shortName").isNull()
    ).drop("inferredKind")


def legacy_signature(nodes: DataFrame, extract: DataFrame) -> DataFrame:
    """Records without a module only update the signature of nodes that exist."""
    legacy = extract.filter("module IS NULL OR module = ''").groupBy("name").agg(
        F.max_by("typeSignature", "seq").alias("legacySignature")
    )
    return nodes.join(legacy, "name", "left").withColumn(
        "typeSignature", F.coalesce("legacySignature", "typeSignature")
    ).drop("legacySignature")


def promoted_members(feeds: Feeds, types: DataFrame) -> DataFrame:
    """Fields and constructors of in-scope types as nodes; a name that is both is a constructor."""
    marked = member_rows(feeds.fields, types).select(
        F.col("dst").alias("name"), F.lit(0).alias("rank")
    ).unionByName(
        member_rows(feeds.constructors, types).select(
            F.col("dst").alias("name"), F.lit(1).alias("rank")
        )
    )
    names = marked.groupBy("name").agg(F.max("rank").alias("rank"))
    signatures = feeds.extract.groupBy("name").agg(
        F.max_by("typeSignature", "seq").alias("typeSignature")
    )
    return names.join(signatures, "name", "left").select(
        "name", F.when(F.col("rank") == 1, "constructor").otherwise("field").alias("kind"),
        F.lit(False).alias("isExternal"),
        F.coalesce("typeSignature", F.lit("")).alias("typeSignature"),
    )


def declaration_nodes(feeds: Feeds) -> DataFrame:
    """The whole declaration node table from one grouped pass over all mentions of a name.

    Parsed rows, records, references and members are stacked under one schema and
    resolved by precedence with a single exchange on the name.  References are made
    distinct first, so a hub that a third of all edges point at is one row here.
    """
    types = type_names(feeds.declarations)
    parsed = decl_props(feeds.declarations).select(
        "name", F.struct(*_PROPS).alias("parsed"), F.struct("seq", "module", "startLine").alias("place")
    )
    members = member_rows(feeds.fields, types).select(F.col("dst").alias("name"), F.lit(0).alias("member"))
    makers = member_rows(feeds.constructors, types).select(
        F.col("dst").alias("name"), F.lit(1).alias("member")
    )
    kind = C.infer_kind(F.col("instantiates"), F.col("nConstructors"), F.col("nExtends"))
    records = feeds.extract.select(
        "name", "seq", "typeSignature", (F.coalesce("module", F.lit("")) != "").alias("attributed"),
        "module", kind.alias("inferredKind"),
    )
    depended = dependency_names(feeds.deps).withColumn("depended", F.lit(True))
    related = relation_targets(feeds).withColumn("related", F.lit(True))
    mentions = parsed
    for part in (members.unionByName(makers).distinct(), records, depended, related):
        mentions = mentions.unionByName(part, allowMissingColumns=True)

    attributed = F.col("attributed")
    per_name = mentions.groupBy("name").agg(
        F.max_by("parsed", "place").alias("parsed"),
        F.max("member").alias("member"),
        F.bool_or(F.coalesce("depended", F.lit(False))).alias("depended"),
        F.bool_or(F.coalesce("related", F.lit(False))).alias("related"),
        F.bool_or(F.coalesce("attributed", F.lit(False))).alias("attributed"),
        F.max_by("module", F.when(attributed, F.col("seq"))).alias("module"),
        F.max_by("typeSignature", F.when(attributed, F.col("seq"))).alias("ownSignature"),
        F.min_by("inferredKind", F.when(attributed, F.col("seq"))).alias("inferredKind"),
        F.max_by("typeSignature", F.when(~attributed, F.col("seq"))).alias("oldSignature"),
        F.max_by("typeSignature", "seq").alias("anySignature"),
    )
    is_parsed, is_member = F.col("parsed").isNotNull(), F.col("member").isNotNull()
    reached = is_parsed | F.col("depended") | F.col("attributed")
    signature = F.when(is_member, F.coalesce("anySignature", F.lit(""))).when(
        reached, F.coalesce("oldSignature", "ownSignature")
    )
    resolved_kind = (
        F.when(F.col("member") == 1, F.lit("constructor"))
        .when(F.col("member") == 0, F.lit("field"))
        .otherwise(F.coalesce("parsed.kind", "inferredKind"))
    )
    rest = [F.col(f"parsed.{name}").alias(name) for name in _PROPS if name != "kind"]
    return per_name.filter(reached | F.col("related") | is_member).select(
        "name", resolved_kind.alias("kind"), *rest,
        (~(is_parsed | is_member)).alias("isExternal"), "module",
        signature.alias("typeSignature"),
        F.when(F.col("member") == 1, F.lit("Constructor"))
        .when(F.col("member") == 0, F.lit("Field"))
        .otherwise(C.kind_label(F.col("parsed.kind"))).alias("label"),
    )


# ---- edges between nodes ------------------------------------------------------------------

def defined_in(declarations: DataFrame, modules: DataFrame) -> DataFrame:
    pairs = declarations.filter("name <> ''").select("name", "module").distinct()
    return pairs.join(modules.select(F.col("name").alias("module")), "module", "leftsemi").select(
        "name", "module"
    )


def in_namespace(declarations: DataFrame, namespaces: DataFrame) -> DataFrame:
    pairs = declarations.filter("name <> '' AND namespace <> ''").select("name", "namespace").distinct()
    named = namespaces.select(F.col("name").alias("namespace"))
    return pairs.join(named, "namespace", "leftsemi").select("name", "namespace")


def import_edges(imports: DataFrame) -> DataFrame:
    """One edge per (importer, target); a repeated import keeps the flags of its last mention."""
    flags = F.max_by(F.struct("isPublic", "isDeprecated"), "pos").alias("flags")
    merged = imports.groupBy(F.col("module").alias("src"), F.col("name").alias("dst")).agg(flags)
    return merged.select("src", "dst", "flags.*")


def depends_on(feeds: Feeds, nodes: DataFrame) -> DataFrame:
    """Dependency edges between nodes.

    Every target is a node, and so is every source that carries a module; only the
    sources of old records need the check, so the large edge table is not shuffled
    against the node table.
    """
    attributed = feeds.deps.filter("module <> ''")
    legacy = feeds.deps.filter("module IS NULL OR module = ''").join(
        nodes.select(F.col("name").alias("src")), "src", "leftsemi"
    )
    return dependency_rows(attributed.unionByName(legacy.select(*attributed.columns)))


def build_graph(feeds: Feeds, keep=lambda tables: tables) -> Graph:
    """All node and edge tables; ``keep`` may store a dict of tables and return the stored ones."""
    namespaces, tree = namespace_tree(feeds.namespaces)
    nodes = keep({
        "declarations": declaration_nodes(feeds), "modules": module_nodes(feeds), "namespaces": namespaces,
    })
    declarations = nodes["declarations"]
    types = type_names(feeds.declarations)
    edges = keep({
        "depends_on": depends_on(feeds, declarations),
        "imports": import_edges(feeds.imports),
        "in_namespace": in_namespace(feeds.declarations, nodes["namespaces"]),
        "subnamespace_of": tree,
        "defined_in": defined_in(feeds.declarations, nodes["modules"]),
        "extends": edge_endpoints(extends_rows(feeds.extends), declarations),
        "instantiates": edge_endpoints(instantiates_rows(feeds.extract), declarations),
        "deprecated_by": edge_endpoints(deprecated_by_rows(feeds.extract), declarations),
        "has_additive_version": edge_endpoints(additive_rows(feeds.extract), declarations),
        "has_field": member_rows(feeds.fields, types),
        "has_constructor": member_rows(feeds.constructors, types),
    })
    return Graph(**nodes, **edges)
