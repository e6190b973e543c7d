"""A dependency graph derived from the ``part`` and ``lineitem`` tables.

The driver's tables hold no dependency graph, so both the Spark queries and the
DuckDB oracles start from the SQL texts below.  Every row of both tables takes
part.  Parts become declarations, blocks of ten part keys become modules.  Each
order line makes its part depend on a smaller part key, and the part's module
import a module of about a quarter, half or three quarters of its number.  So the
module graph has no cycle, every module has at most six such imports, paths grow
with the logarithm of the number of modules, and low numbers are hubs that a large
share of all edges point at.

The texts use only integer arithmetic and functions both engines share;
``{div}`` is the integer division of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph.session import discard, file_system, materialize, new_path

ROOT = "Root"
BUCKET = 10
EXTERNAL = "(external)"

# Rows of the topic dimension used with the derived graph, in priority order.
TOPICS = (
    ("Alpha", "Alpha", 10.0, "#400000"),
    ("Beta", "Beta", 20.0, "#004000"),
    ("Gamma", "Gamma", 30.0, "#000040"),
    ("Delta", "Delta", 40.0, "#404000"),
    ("Eps", "Eps", 50.0, "#004040"),
    ("_default", "Other", 140.0, "#202020"),
)


def _topic(bucket: str) -> str:
    return (
        f"CASE ({bucket}) % 6 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' WHEN 2 THEN 'Gamma' "
        "WHEN 3 THEN 'Delta' WHEN 4 THEN 'Eps' ELSE 'Misc' END"
    )


def module_name(bucket: str) -> str:
    """SQL expression for the module name of a bucket number."""
    number = f"printf('%05d', {bucket})"
    return (
        f"(CASE WHEN ({bucket}) % 50 = 49 THEN 'Archive.M' || {number} "
        f"ELSE 'Root.' || {_topic(bucket)} || '.M' || {number} END)"
    )


def declaration_name(key: str) -> str:
    """SQL expression for the declaration name of a part key."""
    return f"({module_name(f'({key}) {{div}} 10')} || '.d' || CAST({key} AS STRING))"


# A declaration of every fourth part is missing from the source parse.
PARSED = "pk % 4 <> 0"
HAS_MEMBERS = "p_type IN ('SMALL', 'STANDARD') AND p_size % 7 = 0"

_BASE = f"""
SELECT p_partkey AS pk, p_partkey {{div}} 10 AS b, p_partkey % 10 AS o, p_name, p_brand, p_type,
       CAST(p_size AS BIGINT) AS p_size, {module_name('p_partkey {div} 10')} AS module,
       {declaration_name('p_partkey')} AS name
FROM {{part}}"""

_MODULES = f"""
SELECT b AS seq, {module_name('b')} AS module,
       replace({module_name('b')}, '.', '/') || '.src' AS path,
       CASE WHEN b % 3 <> 0 THEN '# Module ' || CAST(b AS STRING) || '\n\nParts of block '
            || CAST(b AS STRING) || '\n\n## Tags\n\n' || lower({_topic('b')}) || ', parts' END
         AS docstring,
       CASE WHEN b % 3 <> 0 THEN 'Module ' || CAST(b AS STRING) END AS title,
       CASE WHEN b % 3 <> 0 THEN lower({_topic('b')}) END AS tag_a,
       CASE WHEN b % 3 <> 0 THEN 'parts' END AS tag_b,
       'Author ' || CAST(b % 7 AS STRING) AS author_a,
       'Author ' || CAST(b % 5 + 7 AS STRING) AS author_b,
       b % 17 = 0 AS isDeprecated
FROM (SELECT DISTINCT b FROM {{base}}) AS blocks"""

_DECLARATIONS = f"""
SELECT pk AS seq, module, name, 'd' || CAST(pk AS STRING) AS shortName,
       CASE p_type WHEN 'ECONOMY' THEN 'theorem' WHEN 'LARGE' THEN 'lemma' WHEN 'MEDIUM' THEN 'def'
            WHEN 'PROMO' THEN 'instance' WHEN 'SMALL' THEN 'class' ELSE 'structure' END AS kind,
       module AS namespace, replace(module, '.', '/') || '.src' AS sourceFile,
       1 + 3 * o AS startLine, 4 + 3 * o AS endLine,
       'part ' || p_name || ' of ' || p_brand AS sourceText, p_name AS docstring,
       CASE WHEN pk % 3 = 0 THEN 'simp' END AS attr, pk % 9 = 0 AS isProtected,
       pk % 23 = 0 AS isDeprecated,
       CASE WHEN pk % 23 = 0 THEN DATE '2024-01-01' + CAST(pk % 300 AS INT) END AS deprecatedSince
FROM {{base}} WHERE {PARSED}"""

# Record numbers: 4k main record, 4k+1 repeated record, 4k+2 record of a field.
_EXTRACT = f"""
SELECT 4 * pk AS seq, name, p_brand || ' -> ' || p_type || ' ' || CAST(p_size AS STRING)
         AS typeSignature,
       CASE WHEN pk % 31 <> 0 THEN module END AS module,
       CASE WHEN p_type = 'PROMO' THEN {declaration_name('p_size')} END AS instantiates,
       CASE WHEN p_type = 'PROMO' THEN p_size END AS instancePriority,
       pk % 23 = 0 AS hasDeprecatedBy,
       CASE WHEN pk % 46 = 0 THEN {declaration_name('pk + 1')} END AS replacement,
       CASE WHEN pk % 46 = 0 THEN 'use d' || CAST(pk + 1 AS STRING) END AS message,
       CASE WHEN pk % 46 = 0 THEN '2024-0' || CAST(1 + pk % 9 AS STRING) || '-01' END AS since,
       CASE WHEN pk % 37 = 0 THEN {declaration_name('pk {div} 2')} END AS additiveVersion,
       CASE WHEN p_size % 5 = 0 AND pk >= p_size THEN 1 ELSE 0 END
         + CASE WHEN p_size % 10 = 0 THEN 1 ELSE 0 END AS nExtends,
       CASE WHEN {HAS_MEMBERS} THEN 1 ELSE 0 END AS nConstructors
FROM {{base}}
UNION ALL
SELECT 4 * pk + 1, name, 'repeat of ' || p_name, module, NULL, NULL, FALSE, NULL, NULL, NULL, NULL,
       0, 0
FROM {{base}} WHERE pk % 19 = 0
UNION ALL
SELECT 4 * pk + 2, name || '.f1', 'field of ' || p_name, module, NULL, NULL, FALSE, NULL, NULL, NULL,
       NULL, 0, 0
FROM {{base}} WHERE {HAS_MEMBERS}"""

_KEY = "greatest(l_partkey, 1)"
_LINE_TARGET = f"((l_orderkey % {_KEY}) * (l_orderkey % {_KEY})) {{div}} {_KEY}"
_LINE_IMPORT = "greatest(((l_partkey {div} 10) * (1 + l_orderkey % 3)) {div} 4 - l_linenumber % 2, 0)"
_LINE_MODULE = (
    f"CASE WHEN l_partkey % 31 <> 0 THEN {module_name('l_partkey {div} 10')} END"
)

_DEPS = f"""
SELECT 4 * l_partkey AS seq, {declaration_name('l_partkey')} AS src,
       {_LINE_MODULE} AS module,
       {declaration_name('target')} AS dst, inType, inValue
FROM (SELECT l_partkey, {_LINE_TARGET} AS target, bool_or(l_returnflag = 'R') AS inType,
             bool_or(l_returnflag <> 'R') AS inValue
      FROM {{lineitem}} GROUP BY 1, 2) AS lines
UNION ALL
SELECT 4 * l_partkey, {declaration_name('l_partkey')}, {_LINE_MODULE},
       'Ext.s' || CAST(l_suppkey AS STRING), FALSE, TRUE
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {{lineitem}}
      WHERE l_linenumber = 1 AND l_quantity >= 45) AS external_lines
UNION ALL
SELECT 4 * pk, name, CASE WHEN pk % 31 <> 0 THEN module END, {declaration_name('pk - 1')},
       TRUE, FALSE
FROM {{base}} WHERE o >= 1
UNION ALL
SELECT 4 * pk, name, CASE WHEN pk % 31 <> 0 THEN module END,
       {declaration_name('pk - 2 - p_size % 5')}, FALSE, FALSE
FROM {{base}} WHERE o >= 2 + p_size % 5
UNION ALL
SELECT 4 * pk, name, CASE WHEN pk % 31 <> 0 THEN module END, name, FALSE, TRUE
FROM {{base}} WHERE p_size % 16 = 0
UNION ALL
SELECT 4 * pk, name, CASE WHEN pk % 31 <> 0 THEN module END, {declaration_name('pk + 1')},
       FALSE, TRUE
FROM {{base}} WHERE o = 0 AND b % 7 = 0
UNION ALL
SELECT 4 * pk + 1, name, module, {declaration_name('pk - 3')}, TRUE, TRUE
FROM {{base}} WHERE pk % 19 = 0 AND o >= 3"""

_IMPORTS = f"""
SELECT {module_name('sb')} AS module, {module_name('db')} AS name, (sb + db) % 2 = 0 AS isPublic,
       sb % 13 = 0 AS isDeprecated, db AS pos
FROM (SELECT DISTINCT l_partkey {{div}} 10 AS sb, {_LINE_IMPORT} AS db FROM {{lineitem}}) AS pairs
WHERE sb > db
UNION ALL
SELECT module, 'Ext.Core', FALSE, FALSE, CAST(-1 AS BIGINT) FROM {{modules}} WHERE seq % 5 = 0
UNION ALL
SELECT module, module, FALSE, FALSE, CAST(-2 AS BIGINT) FROM {{modules}} WHERE seq % 11 = 0
UNION ALL
SELECT module, 'Ext.Größe.Ω1', TRUE, FALSE, CAST(-3 AS BIGINT) FROM {{modules}} WHERE seq % 6 = 1"""

_EXTENDS = f"""
SELECT 4 * pk AS seq, name AS src, CASE WHEN pk % 31 <> 0 THEN module END AS module,
       {declaration_name('pk - p_size')} AS dst, CAST(0 AS BIGINT) AS position
FROM {{base}} WHERE p_size % 5 = 0 AND pk >= p_size
UNION ALL
SELECT 4 * pk, name, CASE WHEN pk % 31 <> 0 THEN module END, {declaration_name('pk {div} 2')}, 1
FROM {{base}} WHERE p_size % 10 = 0
UNION ALL
SELECT 4 * pk, name, CASE WHEN pk % 31 <> 0 THEN module END, 'Ext.Base', 2
FROM {{base}} WHERE p_size = 50"""

_FIELDS = f"""
SELECT 4 * pk AS seq, name AS src, CASE WHEN pk % 31 <> 0 THEN module END AS module,
       {declaration_name('pk - p_size')} || '.f0' AS dst, CAST(0 AS BIGINT) AS position
FROM {{base}} WHERE {HAS_MEMBERS} AND pk >= p_size
UNION ALL
SELECT 4 * pk, name, CASE WHEN pk % 31 <> 0 THEN module END, name || '.f1', 1
FROM {{base}} WHERE {HAS_MEMBERS}"""

_CONSTRUCTORS = f"""
SELECT 4 * pk AS seq, name AS src, CASE WHEN pk % 31 <> 0 THEN module END AS module,
       name || '.mk' AS dst, CAST(0 AS BIGINT) AS position
FROM {{base}} WHERE {HAS_MEMBERS}"""

TABLES = {
    "base": _BASE,
    "modules": _MODULES,
    "declarations": _DECLARATIONS,
    "extract": _EXTRACT,
    "deps": _DEPS,
    "imports": _IMPORTS,
    "extends": _EXTENDS,
    "fields": _FIELDS,
    "constructors": _CONSTRUCTORS,
}


def spark_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived tables as DataFrames over the Parquet files in ``sf_dir``."""
    known = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("part", "lineitem")}
    built: dict[str, DataFrame] = {}
    for name, text in TABLES.items():
        inputs = {key: df for key, df in {**known, **built}.items() if f"{{{key}}}" in text}
        built[name] = spark.sql(text.replace("{div}", "div"), **inputs)
    return built


# ---- nested feeds and raw sources rendered from the flat tables ------------------------------

# Items of one rendered record: targets are grouped by ranges of this many keys, so no
# record grows with the number of edges of its declaration.
_ITEMS = 512


def module_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """The modules table with its tags and authors as arrays."""
    pair = "array_compact(array({0}_a, {0}_b))"
    return tables["modules"].selectExpr(
        "seq", "module", "path", "docstring", "title", pair.format("tag") + " AS tags",
        pair.format("author") + " AS authors", "isDeprecated",
    )


def declaration_rows(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["declarations"].selectExpr(
        "* EXCEPT (attr)", "array_compact(array(attr)) AS attrs", "false AS isExternal"
    )


def extract_feed(tables: dict[str, DataFrame]) -> DataFrame:
    """Nested declaration records.

    A declaration with many dependencies is spread over several records of the same
    name and number; all arrays of one record are bounded.
    """
    number = F.regexp_extract("dst", r"(\d+)(?:\.\w+)?$", 1).cast("bigint")
    deps = tables["deps"].withColumn("part", F.floor(number / _ITEMS)).groupBy("seq", "part").agg(
        F.collect_list(F.struct(F.col("dst").alias("name"), "inType", "inValue")).alias("deps")
    )

    def nested(table: str, item) -> DataFrame:
        return tables[table].groupBy("seq").agg(F.collect_list(item).alias(table))

    member = F.struct(F.col("dst").alias("name"), "position")
    parent = F.struct(F.col("dst").alias("parent"), "position")
    replaced = F.when(F.col("hasDeprecatedBy"), F.struct("replacement", "message", "since"))
    scalars = tables["extract"].withColumn("deprecatedBy", replaced)
    whole = scalars.join(nested("extends", parent), "seq", "left").join(
        nested("fields", member), "seq", "left"
    ).join(nested("constructors", member), "seq", "left")
    return whole.join(deps, "seq", "left").select(
        "seq", "name", "typeSignature", "deps", "extends", "instantiates", "instancePriority",
        "deprecatedBy", "additiveVersion", "fields", "constructors", "module",
    )


def module_feed(tables: dict[str, DataFrame]) -> DataFrame:
    """Nested module records: a module's imports, and its block of declarations."""
    item = [c for c in declaration_rows(tables).columns if c not in ("seq", "module")]
    declarations = declaration_rows(tables).groupBy("module").agg(
        F.array_sort(F.collect_list(F.struct("seq", *item))).alias("d")
    ).select("module", F.transform("d", lambda d: d.dropFields("seq")).alias("declarations"))
    imports = tables["imports"].groupBy("module").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "isPublic", "isDeprecated"))).alias("i")
    ).select("module", F.transform("i", lambda i: i.dropFields("pos")).alias("imports"))
    every = module_rows(tables).join(declarations, "module", "left").join(imports, "module", "left")
    return every.withColumn("namespaces", F.array("module"))


def repeated_modules(tables: dict[str, DataFrame]) -> DataFrame:
    """Later module records that declare some of the names once more, first in their list and of another kind."""
    item = ("name", "shortName", "kind", "namespace", "sourceFile", "startLine", "endLine", "sourceText", "docstring")
    again = tables["declarations"].filter("seq % 90 = 1").selectExpr(
        "concat('Again.M', seq) AS module", "concat('Again/M', seq, '.src') AS path",
        "named_struct('name', name, 'shortName', shortName, 'kind', 'def', 'namespace', namespace, 'sourceFile', "
        "sourceFile, 'startLine', 1L, 'endLine', 2L, 'sourceText', 'again', 'docstring', 'again') AS d",
    )
    return again.select("module", "path", F.array(F.struct(*(f"d.{name}" for name in item))).alias("declarations"))


# Records in one written feed file, about.
FILE_RECORDS = 30_000


def written_in_order(
    feed: DataFrame, key: str, folder: str, later: DataFrame | None = None, compression: str = "none",
) -> str:
    """Writes a feed without its numbers as JSON files of unlike size, in the order of ``key``.

    Returns a pattern for all files; their paths, and the times they are written, follow the order.  Three files or
    more a folder: a task sorts about as many records whatever the size of the feed.
    """
    path = new_path(feed.sparkSession, "nested")
    feed = materialize(feed, path=path)
    last = feed.agg(F.max(key)).first()[0] or 0
    cuts = [-1, last // 40, last // 4, last // 3, last]
    for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = feed.filter(F.col(key).between(low + 1, high))
        tasks = max(3, part.count() // FILE_RECORDS)
        part.repartitionByRange(tasks, key).sortWithinPartitions(key).drop("seq").write.json(f"{folder}/{number:03d}", compression=compression)
    discard(feed.sparkSession, path)
    if later is not None:
        later.write.json(f"{folder}/900", compression=compression)
    return f"{folder}/*"


def arrive_in_reverse(spark: SparkSession, pattern: str) -> int:
    """Sets the times of written files so that those of later paths are older; returns the number of files."""
    location, system = file_system(spark, pattern)
    found = [status.getPath() for folder in system.globStatus(location) for status in system.listStatus(folder.getPath())]
    for age, path in enumerate(sorted(found, key=lambda p: p.toString())):
        system.setTimes(path, 1_700_000_000_000 - 1000 * age, -1)
    return len(found)


def raw_sources(tables: dict[str, DataFrame], root: str = "/src") -> DataFrame:
    """(path, text): one source file per module, rendered from the flat tables."""
    text = F.concat_ws(
        " ", F.when(F.col("isPublic"), F.lit("public")), F.lit("import"), F.col("name")
    )
    imports = tables["imports"].groupBy("module").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("pos", text.alias("line")))), lambda i: i["line"]
        ), "\n").alias("imports")
    )
    inline = F.when((F.col("attr") == "simp") & (F.col("seq") % 2 == 1), F.lit("@[simp]"))
    own_line = F.when((F.col("attr") == "simp") & (F.col("seq") % 2 == 0), F.lit("@[simp]"))
    name = F.when(F.col("seq") % 29 != 0, F.col("shortName"))
    shown = F.concat_ws(
        "\n",
        F.concat(F.lit("/-- "), F.col("docstring"), F.lit(" -/")),
        F.coalesce(own_line, F.concat(F.lit("-- theorem "), F.col("shortName"))),
        F.concat_ws(" ", inline, F.when(F.col("isProtected"), F.lit("protected")), F.col("kind"), name,
                    F.lit(":"), F.col("docstring")),
        F.concat(F.lit("  exact "), F.col("seq").cast("string")),
    )
    bodies = tables["declarations"].groupBy("module").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("seq", shown.alias("lines")))), lambda d: d["lines"]
        ), "\n").alias("body")
    )
    header = F.concat_ws(
        "\n", F.lit("/-\nCopyright (c) 2024"),
        F.concat(F.lit("Authors: "), F.col("author_a"), F.lit(", "), F.col("author_b")),
        F.lit("-/\nmodule"),
    )
    full = F.concat_ws(
        "\n", header, "imports", F.concat(F.lit("/-!\n"), F.col("docstring"), F.lit("\n-/")),
        F.when(F.col("isDeprecated"), F.lit('deprecated_module "old"')),
        F.concat(F.lit("namespace "), F.col("module")), "body",
        F.concat(F.lit("end "), F.col("module")),
    )
    modules = tables["modules"].join(bodies, "module", "left")
    files = modules.join(imports, "module", "left")
    return files.select(F.concat(F.lit(f"{root}/"), "path").alias("path"), full.alias("text"))
