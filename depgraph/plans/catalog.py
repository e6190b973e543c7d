"""Registry of the runnable queries, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph import schemas
from depgraph.functions import checks
from depgraph.functions import columns as C
from depgraph.operators import blocks as B
from depgraph.operators import build
from depgraph.operators import map_layout as M
from depgraph.operators import module_graph as G
from depgraph.operators import parsing as P
from depgraph.operators import reads as R
from depgraph.operators import search as S
from depgraph.operators import structure as X
from depgraph.operators import traversal as V
from depgraph.operators.ranking import dense_index
from depgraph.plans import fixture
from depgraph.plans.oracle_ctes import with_ctes
from depgraph.plans.workspace import Workspace, workspace
from depgraph.session import new_path
from depgraph.sources import feeds as E
from depgraph.sources import document, files, pack, store
from depgraph.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SOURCE_ROOT = "/src"


def query(key: str, oracle: str | None = None):
    """Register a function of a workspace as the query ``key``."""
    def register(run: Callable[[Workspace], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: run(workspace(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = with_ctes(oracle)
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(w: Workspace) -> DataFrame:
    return _table(w.spark, w.sf_dir, "documents")


def _hubs(w: Workspace) -> DataFrame:
    """The three modules with the most importers in the reduced graph."""
    counted = w.map.edges.groupBy(F.col("dep").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "name").limit(3).select("name")


def _no_null_ints(df: DataFrame) -> DataFrame:
    """Unknown numbers as -1, so a comparison does not depend on how a client shows null integers."""
    return df.fillna(-1, [name for name, kind in df.dtypes if kind == "bigint"])


def _relations(w: Workspace) -> DataFrame:
    return X.all_relations(w.map.edges, w.map.structure)


# ---- sources and sinks ---------------------------------------------------------------------

@query("S1_scan_sources", """SELECT 'a + b%20' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' Größe' ELSE '+' END AS label,
    'nation ' || CAST(s_nationkey AS VARCHAR) || chr(10) || 'é' || chr(10) AS text FROM supplier WHERE s_suppkey % 5 <> 3""")
def _(w):
    """Text files with blanks, plus and percent signs in their paths; those in a build folder are left out."""
    folder = new_path(w.spark, "tree")
    key = F.col("s_suppkey")
    sources = _table(w.spark, w.sf_dir, "supplier").select(
        F.concat(F.lit("a + b%20"), "s_name", F.when(key % 2 == 0, " Größe").otherwise("+")).alias("label"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"), F.lit("\né")).alias("text"),
        (key % 5 == 3).alias("skip"),
    )
    # a file a label: dealt to all cores, since the few input files would be written by as few tasks
    sources = sources.repartition(4 * w.spark.sparkContext.defaultParallelism, "label")
    sources.filter("NOT skip").drop("skip").write.partitionBy("label").text(f"{folder}/src")
    sources.filter("skip").drop("skip").write.partitionBy("label").text(f"{folder}/src/.lake/more")
    found = files.scan_sources(w.spark, f"{folder}/src", ".txt")
    label = F.url_decode(F.replace(F.regexp_extract("path", "/label=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    return found.select(label.alias("label"), "text")


@query("S2_read_modules", """SELECT m.module, m.path, m.title, m.isDeprecated,
    coalesce(d.n, 0) AS declarations, coalesce(i.n, 0) AS imports FROM modules m
    LEFT JOIN (SELECT module, count(*) AS n FROM declarations GROUP BY module) d ON d.module = m.module
    LEFT JOIN (SELECT module, count(*) AS n FROM imports GROUP BY module) i ON i.module = m.module""")
def _(w):
    path = new_path(w.spark, "feed")
    files.write_modules_jsonl(fixture.module_feed(w.tables).drop("seq"), path)
    modules, _bad = files.read_modules(w.spark, path)
    sizes = modules.groupBy("module", "path").agg(
        F.max("title").alias("title"), F.bool_or("isDeprecated").alias("isDeprecated"),
        F.sum(F.size("declarations")).alias("declarations"), F.sum(F.size("imports")).alias("imports"),
    )
    return sizes


@query("S3_read_modules_strict", "SELECT module, path FROM modules")
def _(w):
    path = new_path(w.spark, "feed")
    files.write_modules_jsonl(fixture.module_feed(w.tables).drop("seq"), path)
    return files.read_modules_strict(w.spark, path).select("module", "path").distinct()


def _extract_json(w: Workspace) -> str:
    """The declaration feed as compressed files; each is read by one task, so their records are bounded."""
    path = new_path(w.spark, "extract")
    fixture.extract_feed(w.tables).write.option("maxRecordsPerFile", fixture.FILE_RECORDS).json(path, compression="gzip")
    return path


@query("S4_read_extract", "SELECT seq, name, typeSignature, module, instantiates FROM extract")
def _(w):
    records, _bad = files.read_extract(w.spark, _extract_json(w))
    return records.select("seq", "name", "typeSignature", "module", "instantiates").distinct()


@query("S5_read_extract_loose", "SELECT seq, src, dst, inType, inValue FROM deps")
def _(w):
    records = files.read_extract_loose(w.spark, _extract_json(w))
    return E.explode_deps(records).select("seq", "src", "dst", "inType", "inValue")


@query("S6_topic_dim", """SELECT CAST(r_regionkey AS BIGINT) AS priority, r_name AS id, 'Topic ' || r_name AS label,
    10.0::DOUBLE * r_regionkey AS y, '#00000' || CAST(r_regionkey AS VARCHAR) AS color FROM region
    UNION ALL SELECT max(r_regionkey) + 1, '_default', 'Other', 140.0::DOUBLE, '#202020' FROM region""")
def _(w):
    key = F.col("r_regionkey")
    return files.topic_table(_table(w.spark, w.sf_dir, "region").select(
        key.cast("bigint").alias("priority"), F.col("r_name").alias("id"),
        F.concat(F.lit("Topic "), "r_name").alias("label"), (key * F.lit(10.0)).alias("y"),
        F.concat(F.lit("#00000"), key.cast("string")).alias("color"),
    ))


@query("S7_write_modules_jsonl", """SELECT m.module, '/src/' || m.path AS path, m.title, coalesce(d.n, 0) AS declarations,
    coalesce(i.n, 0) AS imports, (SELECT count(*) FROM modules) AS written
    FROM modules m LEFT JOIN file_imports i ON i.module = m.module LEFT JOIN (SELECT module, count(*) AS n
    FROM file_spans WHERE NOT nameless OR kind = 'instance' GROUP BY module) d ON d.module = m.module""")
def _(w):
    """The lines written for parsed sources, read again, with the number the writer reports."""
    path = new_path(w.spark, "structure")
    count = files.write_modules_jsonl(P.assemble_modules(w.sources, SOURCE_ROOT), path)
    lines = w.spark.read.schema(schemas.MODULE_FEED).json(path)
    return lines.select(
        "module", "path", "title", F.size("declarations").cast("bigint").alias("declarations"),
        F.size("imports").cast("bigint").alias("imports"), F.lit(count).cast("bigint").alias("written"),
    )


_STORED_TABLES = {
    "modules": "SELECT name AS a, '' AS b FROM gmodules", "namespaces": "SELECT name, '' FROM namespaces",
    "declarations": "SELECT name, coalesce(label, '') || '|' || coalesce(typeSignature, '') FROM nodes",
    "depends_on": "SELECT src, dst || '|' || context FROM depends",
    "imports": "SELECT DISTINCT module, name FROM imports",
    "in_namespace": "SELECT DISTINCT name, namespace FROM declarations WHERE namespace <> ''",
    "subnamespace_of": "SELECT name, parent FROM namespaces WHERE parent IS NOT NULL",
    "defined_in": "SELECT DISTINCT name, module FROM declarations",
    "extends": "SELECT DISTINCT src, dst FROM extends WHERE src IN (SELECT name FROM nodes)",
    "instantiates": "SELECT DISTINCT name, instantiates FROM extract WHERE instantiates <> ''",
    "deprecated_by": "SELECT DISTINCT name, replacement FROM extract WHERE hasDeprecatedBy AND replacement IS NOT NULL",
    "has_additive_version": "SELECT DISTINCT name, additiveVersion FROM extract WHERE additiveVersion <> ''",
    "has_field": "SELECT DISTINCT src, dst FROM field_rows", "has_constructor": "SELECT DISTINCT src, dst FROM constructor_rows",
}


@query("S8_write_graph", " UNION ALL ".join(
    f"SELECT '{name}' AS part, t.* FROM ({text}) AS t(a, b)" for name, text in _STORED_TABLES.items()
))
def _(w):
    """Key content of all stored tables of a graph."""
    rows = None
    for name, table in store.read_graph(w.spark, w.stored_graph).tables().items():
        none = F.lit("")
        second = {
            "modules": none, "namespaces": none, "depends_on": F.concat_ws("|", "dst", "context"),
            "declarations": F.concat(F.coalesce("label", none), F.lit("|"), F.coalesce("typeSignature", none)),
        }.get(name, F.col(table.columns[1] if len(table.columns) > 1 else "name"))
        part = table.select(F.lit(name).alias("part"), F.col(table.columns[0]).alias("a"), second.alias("b"))
        # dealt out by name or source, the order they are stored in, and made distinct where they arrive
        part = part.repartition("a").distinct()
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("S14_drop_graph", """SELECT 'before' AS moment, TRUE AS stored, count(*) AS modules FROM gmodules
    UNION ALL SELECT 'after', FALSE, 0""")
def _(w):
    """A stored graph, then the same place after it was dropped."""
    base = new_path(w.spark, "dropped")
    store.write_graph(w.graph, base)
    modules = store.read_graph(w.spark, base).modules.count()
    before = store.current_pointer(w.spark, base, "graph") is not None
    store.drop_graph(w.spark, base)
    after = store.current_pointer(w.spark, base, "graph") is not None
    return w.spark.createDataFrame(
        [("before", before, modules), ("after", after, 0)], "moment string, stored boolean, modules bigint"
    )


@query("S9_write_map", """SELECT topo, name, topic, round(x, 6) AS x, declCount, docstring FROM mmap""")
def _(w):
    doc = store.read_map(w.spark, w.stored_map)
    return doc.nodes.select("topo", "name", "topic", F.round("x", 6).alias("x"), "declCount", "docstring")


@query("S10_store_layout", """SELECT 'node' AS part, '' AS rel, name AS a, '' AS b FROM mmap
    UNION ALL SELECT 'viz', '', dep, importer FROM mmap_edges
    UNION ALL SELECT 'struct', rel, src, dst FROM mstructure""")
def _(w):
    rows = store.store_rows(w.map)
    none = F.lit("")
    return (
        rows["nodes"].select(F.lit("node").alias("part"), none.alias("rel"), F.col("name").alias("a"), none.alias("b"))
        .unionByName(rows["viz"].select(F.lit("viz").alias("part"), none.alias("rel"), "a", "b"))
        .unionByName(rows["struct"].select(F.lit("struct").alias("part"), "rel", "a", "b"))
    )


@query("S11_read_map", """SELECT 'import' AS rel, a.topo AS a, b.topo AS b FROM mmap_edges e
    JOIN mmap a ON a.name = e.dep JOIN mmap b ON b.name = e.importer
    UNION ALL SELECT rel, a.topo, b.topo FROM mstructure s
    JOIN mmap a ON a.name = s.src JOIN mmap b ON b.name = s.dst""")
def _(w):
    doc = store.read_map(w.spark, w.stored_map)
    edges = store.document_edges(doc).select(
        F.lit("import").alias("rel"), F.col("dep_topo").alias("a"), F.col("importer_topo").alias("b")
    )
    return edges.unionByName(store.document_structure(doc).select(
        "rel", F.col("src_topo").alias("a"), F.col("dst_topo").alias("b")
    ))


@query("S12_block_index", "SELECT module, CAST(part AS INTEGER) AS part, i, j, payload, l, o FROM bindex")
def _(w):
    return B.block_index(B.block_pieces(w.blocks)).select("module", "part", "i", "j", "payload", "l", "o")


@query("S13_read_block", """SELECT CAST(part AS INTEGER) AS part, i, j, payload FROM bindex
    WHERE module = 'Root.Beta.M00001'""")
def _(w):
    path = new_path(w.spark, "blocks")
    store.write_blocks(B.block_pieces(w.blocks), path)
    return store.read_block(w.spark, path, "Root.Beta.M00001").select("part", "i", "j", "payload")


_BLOCK_JSON = "decls array<struct<name string, k string, x double, y double, s double>>, e array<array<bigint>>"


@query("S20_pack_declarations", "SELECT module, idx, name, k, x, y, s FROM bplaced")
def _(w):
    """All blocks, written to one pack file and read back by byte ranges."""
    read = pack.read_pack(w.spark, w.stored_pack).select("module", F.from_json(F.decode("data", "UTF-8"), _BLOCK_JSON).alias("block"))
    return read.select("module", F.posexplode("block.decls").alias("at", "d")).select(
        "module", F.col("at").cast("bigint").alias("idx"), "d.name", "d.k", "d.x", "d.y", "d.s"
    )


@query("S21_pack_module", "SELECT module, src_idx, dst_idx FROM bedges WHERE module = 'Root.Beta.M00001'")
def _(w):
    """The edges of one module, for which its own bytes of the pack are read."""
    own = pack.read_pack(w.spark, w.stored_pack).filter(F.col("module") == "Root.Beta.M00001")
    pairs = own.select("module", F.explode(F.from_json(F.decode("data", "UTF-8"), _BLOCK_JSON)["e"]).alias("e"))
    return pairs.select("module", F.col("e")[0].alias("src_idx"), F.col("e")[1].alias("dst_idx"))


_DOCUMENT = """topics array<struct<id string>>, edges array<array<bigint>>, nodes array<struct<name string, topic string, x double,
    y double, declCount bigint, closureSize bigint, docstring string>>"""


@query("S22_map_document", "SELECT topo, name, topic, round(x, 6) AS x, y, declCount, closureSize, docstring FROM mmap")
def _(w):
    """The nodes of the map document, which is written as one file and read back."""
    path = new_path(w.spark, "document")
    document.write_document(w.map, path, "derived", "2024-01-01T00:00:00+00:00", fixture.ROOT)
    read = w.spark.read.text(path, wholetext=True).select(F.from_json("value", _DOCUMENT).alias("d"))
    nodes = read.select(F.posexplode("d.nodes").alias("at", "n")).select(F.col("at").cast("bigint").alias("topo"), "n.*")
    return nodes.withColumn("x", F.round("x", 6))


@query("S15_check_unique_keys", """SELECT label, name, count(*) AS copies FROM (
    SELECT 'Declaration' AS label, name FROM nodes UNION ALL SELECT 'Module', name FROM gmodules
    UNION ALL SELECT 'Namespace', name FROM namespaces) GROUP BY label, name HAVING count(*) > 1""")
def _(w):
    return R.duplicate_keys(w.graph)


@query("S16_sql_views", """SELECT n.kind, d.context, count(*) AS edges FROM depends d
    JOIN nodes n ON n.name = d.src GROUP BY n.kind, d.context""")
def _(w):
    R.create_views(w.graph, "kg_")
    return w.spark.sql("""SELECT n.kind, d.context, count(*) AS edges FROM kg_depends_on d
        JOIN kg_declarations n ON n.name = d.src GROUP BY n.kind, d.context""")


def _unnumbered(w: Workspace) -> tuple[str, str]:
    """Both feeds as compressed JSON files without numbers, some names declared again in later records."""
    modules = fixture.written_in_order(
        fixture.module_feed(w.tables), "seq", new_path(w.spark, "modules"), fixture.repeated_modules(w.tables), "gzip"
    )
    records = new_path(w.spark, "records")
    return modules, fixture.written_in_order(fixture.extract_feed(w.tables), "seq", records, compression="gzip")


_AGAIN = "n.name IN (SELECT name FROM declarations WHERE seq % 90 = 1)"
_FEED_NODES = f"""SELECT n.name, CASE WHEN {_AGAIN} THEN 'def' ELSE n.kind END AS kind, n.isExternal, n.module,
    n.typeSignature, CASE WHEN {_AGAIN} THEN 'Definition' ELSE n.label END AS label,
    CASE WHEN {_AGAIN} THEN 'again' ELSE n.docstring END AS docstring FROM nodes n"""


def _feed_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("name", "kind", "isExternal", "module", "typeSignature", "label", "docstring")


@query("S18_feed_order_nodes", _FEED_NODES)
def _(w):
    """The node table from written files: the last record of the feed wins, whatever order Spark reads them in."""
    modules, records = _unnumbered(w)
    read, _bad = files.read_modules(w.spark, modules)
    extract, _skipped = files.read_extract(w.spark, records)
    return _feed_nodes(build.declaration_nodes(E.flatten(read, extract)))


@query("S19_feed_order_edges", """SELECT 'depends' AS edge, src, dst, context AS flag FROM depends
    UNION ALL SELECT 'import', module, name, CASE WHEN arg_max(isPublic, pos) THEN 'public' ELSE '' END
    FROM imports GROUP BY module, name""")
def _(w):
    modules, records = _unnumbered(w)
    read, _bad = files.read_modules(w.spark, modules)
    feeds = E.flatten(read, files.read_extract_loose(w.spark, records))
    depends = build.depends_on(feeds, build.declaration_nodes(feeds).select("name"))
    imports = build.import_edges(feeds.imports)
    return depends.select(F.lit("depends").alias("edge"), "src", "dst", F.col("context").alias("flag")).unionByName(
        imports.select(
            F.lit("import").alias("edge"), "src", "dst", F.when(F.col("isPublic"), "public").otherwise("").alias("flag")
        )
    )


@query("S17_verify_store", "SELECT count(*) AS stored, count(*) AS expected, TRUE AS matches FROM mnodes")
def _(w):
    return store.verify_store(store.read_map(w.spark, w.stored_map).nodes, w.module_graph.modules)


# ---- source parsing ----------------------------------------------------------------------------

@query("T1_parse_module_meta", """SELECT module, '/src/' || path AS path, docstring, title,
    coalesce(tag_a || '|' || tag_b, '') AS tags, author_a || '|' || author_b AS authors, isDeprecated
    FROM modules""")
def _(w):
    meta = P.module_meta(w.sources, SOURCE_ROOT)
    return meta.withColumn("tags", F.array_join("tags", "|")).withColumn(
        "authors", F.array_join("authors", "|")
    )


@query("T2_parse_imports", "SELECT path, name, isPublic FROM file_paths")
def _(w):
    return P.header_imports(w.sources, SOURCE_ROOT).select("path", "name", "isPublic")


@query("T3_parse_declarations", """SELECT path, module,
    CASE WHEN nameless THEN '' ELSE name END AS name, CASE WHEN nameless THEN '' ELSE shortName END AS shortName,
    kind, namespace, start_line AS startLine, end_line AS endLine, docstring, coalesce(attr, '') AS attrs,
    isProtected FROM file_spans WHERE NOT nameless OR kind = 'instance'""")
def _(w):
    return P.parse_declarations(w.sources, SOURCE_ROOT).select(
        "path", "module", "name", "shortName", "kind", "namespace", "startLine", "endLine", "docstring",
        F.array_join("attrs", "|").alias("attrs"), "isProtected",
    )


@query("T4_decl_warnings", """SELECT path, path || ':' || CAST(start_line AS VARCHAR) || ': cannot parse '
    || kind || ' name' AS warning FROM file_spans WHERE nameless AND kind <> 'instance'""")
def _(w):
    return P.declaration_warnings(w.sources)


@query("T5_module_name", "SELECT '/src/' || path AS path, module FROM modules")
def _(w):
    return w.sources.select("path", P.module_name(F.col("path"), SOURCE_ROOT).alias("module"))


@query("T6_namespaces_seen", """SELECT module, namespace, min(start_line) AS firstLine FROM file_spans
    WHERE NOT nameless OR kind = 'instance' GROUP BY module, namespace""")
def _(w):
    return P.namespaces_seen(P.parse_declarations(w.sources, SOURCE_ROOT))


@query("T7_assemble_module", """SELECT '/src/' || m.path AS path, m.module, m.title,
    CASE WHEN d.n > 0 THEN m.module ELSE '' END AS namespaces, coalesce(d.n, 0) AS declarations,
    coalesce(i.n, 0) AS imports
    FROM modules m LEFT JOIN file_imports i ON i.module = m.module LEFT JOIN (SELECT module, count(*) AS n
    FROM file_spans WHERE NOT nameless OR kind = 'instance' GROUP BY module) d ON d.module = m.module""")
def _(w):
    records = P.assemble_modules(w.sources, SOURCE_ROOT)
    return records.select(
        "path", "module", "title", F.array_join("namespaces", "|").alias("namespaces"),
        F.size("declarations").cast("bigint").alias("declarations"),
        F.size("imports").cast("bigint").alias("imports"),
    )


# ---- projections, filters, scalars ---------------------------------------------------------------

@query("P1_filter_root_modules", "SELECT module, path FROM modules WHERE module LIKE 'Root.%'")
def _(w):
    return G.filter_root_modules(w.feeds.modules, fixture.ROOT).select("module", "path")


@query("P2_decl_props", """SELECT name, shortName, kind, namespace, docstring, sourceFile, startLine, endLine,
    sourceText, coalesce(attr, '') AS attrs, isProtected, FALSE AS isExternal, isDeprecated,
    strftime(deprecatedSince, '%Y-%m-%d') AS deprecatedSince FROM declarations""")
def _(w):
    props = build.decl_props(w.feeds.declarations)
    return props.withColumn("attrs", F.array_join("attrs", "|")).drop("seq", "module")


@query("P3_kind_label", """SELECT name, CASE kind WHEN 'theorem' THEN 'Theorem' WHEN 'lemma' THEN 'Lemma'
    WHEN 'def' THEN 'Definition' WHEN 'instance' THEN 'Instance' WHEN 'class' THEN 'Class'
    WHEN 'structure' THEN 'Structure' END AS label FROM declarations""")
def _(w):
    return w.feeds.declarations.select("name", C.kind_label(F.col("kind")).alias("label"))


@query("P4_dep_context", """SELECT CASE WHEN inType AND inValue THEN 'both' WHEN inType THEN 'type'
    ELSE 'value' END AS context, count(*) AS deps FROM deps GROUP BY 1""")
def _(w):
    context = C.dep_context(F.col("inType"), F.col("inValue")).alias("context")
    return w.feeds.deps.groupBy(context).agg(F.count(F.lit(1)).alias("deps"))


@query("P5_infer_kind", "SELECT seq, name, kind FROM kind_of")
def _(w):
    kind = C.infer_kind(F.col("instantiates"), F.col("nConstructors"), F.col("nExtends"))
    return w.feeds.extract.select("seq", "name", kind.alias("kind"))


@query("P6_truncate_signature", """SELECT doc_id, CASE WHEN length(text) > 10000 THEN text[1:10000]
    || '...<truncated>' ELSE text END AS signature, length(text) > 10000 AS truncated FROM documents""")
def _(w):
    text = F.col("text")
    return _documents(w).select(
        "doc_id", C.truncate_signature(text).alias("signature"), C.is_overlong(text).alias("truncated")
    )


@query("P7_truncate_doc", "SELECT doc_id, text[1:1000] AS docstring FROM documents")
def _(w):
    return _documents(w).select("doc_id", C.truncate_doc(F.col("text")).alias("docstring"))


@query("P8_source_url", """SELECT name, CASE WHEN module IS NOT NULL AND startLine IS NOT NULL THEN
    'https://example.org/library/blob/main/' || replace(module, '.', '/') || '.src#L' || CAST(startLine AS VARCHAR)
    END AS url FROM nodes""")
def _(w):
    return w.graph.declarations.select("name", C.source_url(F.col("module"), F.col("startLine")).alias("url"))


@query("P9_query_terms", r"""SELECT doc_id, array_to_string(
    [x || '*' FOR x IN regexp_split_to_array(text, '[^\p{L}\p{N}_]+') IF x <> ''], ' ') AS terms FROM documents""")
def _(w):
    return _documents(w).select("doc_id", C.prefix_terms(F.col("text")).alias("terms"))


@query("P10_short_label", """SELECT name, array_to_string(string_split(name, '.')[-2:], '.') AS module_label,
    string_split(name, '.')[-1] AS decl_label FROM nodes""")
def _(w):
    name = F.col("name")
    return w.graph.declarations.select(
        "name", C.module_label(name).alias("module_label"), C.last_segment(name).alias("decl_label")
    )


@query("P11_doc_first_line", """SELECT module AS name, string_split(module, '.')[-1] AS lastSegment, title,
    CASE WHEN docstring <> '' THEN string_split(docstring, chr(10))[1] END AS docFirstLine FROM modules""")
def _(w):
    return S.search_rows(w.feeds.modules.withColumnRenamed("module", "name"))


@query("P12_select_fields", """SELECT name, kind, module, typeSignature, docstring,
    coalesce(startLine, -1) AS "startLine" FROM nodes""")
def _(w):
    return _no_null_ints(w.graph.declarations.select(*checks.fields(None)))


@query("P13_attributed_only", "SELECT name, module FROM nodes WHERE module IS NOT NULL")
def _(w):
    return R.attributed(w.graph.declarations).select("name", "module")


@query("P14_topic_assign", "SELECT name, topic, band, color FROM mtopics")
def _(w):
    assigned = M.assign_topics(w.module_graph.nodes, w.topics, fixture.ROOT)
    return assigned.select("name", "topic", "band", "color")


@query("P15_radius", "SELECT id, round(r, 6) AS r FROM mradii")
def _(w):
    return M.radii(w.scores).select("id", F.round("r", 6).alias("r"))


@query("P16_node_size", """SELECT module, idx, round(1.5::DOUBLE + least(3.0::DOUBLE, sqrt(degree)), 2) AS s
    FROM bdegree""")
def _(w):
    return B.degrees(w.blocks.edges).select("module", "idx", C.node_size(F.col("degree")).alias("s"))


@query("P17_zigzag", """SELECT p_partkey AS slot, CASE WHEN p_partkey % 2 = 1 THEN (p_partkey + 1) // 2
    ELSE -((p_partkey + 1) // 2) END AS zig FROM part""")
def _(w):
    slot = F.col("p_partkey")
    return _table(w.spark, w.sf_dir, "part").select(slot.alias("slot"), C.zigzag(slot).cast("bigint").alias("zig"))


@query("P19_relation_filter", "SELECT rel, dep, importer FROM relations WHERE rel IN ('extends', 'fields')")
def _(w):
    return X.relation_filter(_relations(w), checks.relations_from_mask(5))


# ---- generators --------------------------------------------------------------------------------------

def _module_feed(w: Workspace) -> DataFrame:
    return fixture.module_feed(w.tables)


def _extract_feed(w: Workspace) -> DataFrame:
    return fixture.extract_feed(w.tables)


@query("E1_explode_declarations", "SELECT module, name, kind, startLine, docstring FROM declarations")
def _(w):
    return E.explode_declarations(_module_feed(w)).select("module", "name", "kind", "startLine", "docstring")


@query("E2_explode_imports", "SELECT module, name, isPublic, isDeprecated FROM imports")
def _(w):
    return E.explode_imports(_module_feed(w)).select("module", "name", "isPublic", "isDeprecated")


@query("E3_explode_deps", """SELECT DISTINCT src, dst, CASE WHEN inType AND inValue THEN 'both'
    WHEN inType THEN 'type' ELSE 'value' END AS context FROM deps""")
def _(w):
    return build.dependency_rows(E.explode_deps(_extract_feed(w)))


@query("E4_explode_extends", "SELECT DISTINCT src, dst, position FROM extends")
def _(w):
    return build.extends_rows(E.explode_extends(_extract_feed(w)))


@query("E5_instantiates_edges", """SELECT DISTINCT name AS src, instantiates AS dst, instancePriority AS priority
    FROM extract WHERE instantiates <> ''""")
def _(w):
    return build.instantiates_rows(E.extract_scalars(_extract_feed(w)))


@query("E6_deprecated_by_edges", """SELECT DISTINCT name AS src, replacement AS dst, message, since FROM extract
    WHERE hasDeprecatedBy AND replacement IS NOT NULL""")
def _(w):
    return build.deprecated_by_rows(E.extract_scalars(_extract_feed(w)))


@query("E7_additive_edges", """SELECT DISTINCT name AS src, additiveVersion AS dst FROM extract
    WHERE additiveVersion <> ''""")
def _(w):
    return build.additive_rows(E.extract_scalars(_extract_feed(w)))


@query("E8_explode_fields", "SELECT src, dst, position FROM field_rows")
def _(w):
    members = E.explode_members(_extract_feed(w), "fields")
    return build.member_rows(members, build.type_names(w.feeds.declarations))


@query("E9_explode_constructors", "SELECT src, dst, position FROM constructor_rows")
def _(w):
    members = E.explode_members(_extract_feed(w), "constructors")
    return build.member_rows(members, build.type_names(w.feeds.declarations))


@query("E10_namespace_tree", "SELECT name, depth, coalesce(parent, '') AS parent FROM namespaces")
def _(w):
    nodes, edges = build.namespace_tree(w.feeds.namespaces)
    parents = edges.select(F.col("child").alias("name"), "parent")
    return nodes.join(parents, "name", "left").select("name", "depth", F.coalesce("parent", F.lit("")).alias("parent"))


@query("E11_relation_targets", "SELECT name FROM rel_targets")
def _(w):
    return build.relation_targets(w.feeds)


# ---- joins ---------------------------------------------------------------------------------------------

@query("J1_edge_endpoints", """SELECT DISTINCT src, dst, position FROM extends
    WHERE src IN (SELECT name FROM declarations) AND dst IN (SELECT name FROM declarations)""")
def _(w):
    return build.edge_endpoints(build.extends_rows(w.feeds.extends), w.feeds.declarations.select("name"))


@query("J2_placeholder_nodes", """SELECT name, TRUE AS isExternal FROM (SELECT name FROM dep_targets
    UNION SELECT name FROM rel_targets) WHERE name NOT IN (SELECT name FROM declarations)""")
def _(w):
    targets = build.dependency_names(w.feeds.deps).unionByName(build.relation_targets(w.feeds))
    return build.placeholder_nodes(targets, w.feeds.declarations)


@query("J3_attribute_modules", """SELECT coalesce(d.name, a.name) AS name, coalesce(d.kind, a.kind) AS kind,
    a.module, a.typeSignature, d.name IS NULL AS isExternal
    FROM declarations d FULL OUTER JOIN attributed a ON a.name = d.name""")
def _(w):
    nodes = build.attribute_modules(build.parsed_nodes(w.feeds.declarations), w.feeds.extract)
    return nodes.select("name", "kind", "module", "typeSignature", "isExternal")


@query("J4_legacy_signature", """SELECT coalesce(d.name, a.name) AS name,
    coalesce(l.typeSignature, a.typeSignature) AS typeSignature
    FROM declarations d FULL OUTER JOIN attributed a ON a.name = d.name
    LEFT JOIN legacy l ON l.name = coalesce(d.name, a.name)""")
def _(w):
    nodes = build.attribute_modules(build.parsed_nodes(w.feeds.declarations), w.feeds.extract)
    return build.legacy_signature(nodes, w.feeds.extract).select("name", "typeSignature")


@query("J5_defined_in", "SELECT DISTINCT name, module FROM declarations")
def _(w):
    return build.defined_in(w.feeds.declarations, build.module_nodes(w.feeds))


@query("J6_in_namespace", "SELECT DISTINCT name, namespace FROM declarations WHERE namespace <> ''")
def _(w):
    return build.in_namespace(w.feeds.declarations, build.namespace_tree(w.feeds.namespaces)[0])


@query("J7_import_edges", """SELECT module AS src, name AS dst, arg_max(isPublic, pos) AS isPublic,
    arg_max(isDeprecated, pos) AS isDeprecated FROM imports GROUP BY module, name""")
def _(w):
    return build.import_edges(w.feeds.imports)


@query("J8_resolve_imports", """SELECT importer, coalesce(dep, -1) AS dep, count(*) AS mentions
    FROM mresolved GROUP BY importer, dep""")
def _(w):
    resolved = _no_null_ints(G.resolve_imports(w.feeds.imports, w.module_graph.nodes))
    return resolved.groupBy("importer", "dep").agg(F.count(F.lit(1)).alias("mentions"))


@query("J9_promote_members", "SELECT name, kind, FALSE AS isExternal, typeSignature FROM promoted")
def _(w):
    return build.promoted_members(w.feeds, build.type_names(w.feeds.declarations))


@query("J10_structure_edges", "SELECT rel, src, dst FROM mstructure")
def _(w):
    return X.structure_edges(w.feeds, w.module_graph.nodes)


@query("J11_kind_lookup", "SELECT module, name, seq, k, inferred FROM bkinds")
def _(w):
    records = B.first_records(B.alive_records(w.feeds.extract, w.module_graph.nodes))
    return B.kind_lookup(records, w.feeds.declarations)


@query("J12_intra_edges", "SELECT module, src_idx, dst_idx FROM bedges")
def _(w):
    homes = X.module_of_name(B.alive_records(w.feeds.extract, w.module_graph.nodes))
    return B.intra_edges(w.feeds.deps, w.blocks.decls.join(
        B.first_records(B.alive_records(w.feeds.extract, w.module_graph.nodes)).select("module", "name", "seq"),
        ["module", "name"],
    ), homes)


@query("J13_alive_filter", "SELECT seq, name, module FROM brecords")
def _(w):
    return B.alive_records(w.feeds.extract, w.module_graph.nodes).select("seq", "name", "module")


_CROSS = """SELECT p.{near} AS self, s.kind AS selfKind, p.{far} AS other, o.kind AS otherKind,
    coalesce(o.module, '(external)') AS otherModule, p.src AS "from", CASE WHEN p.src = s.name THEN s.kind ELSE o.kind END
    AS fromKind, p.dst AS "to", CASE WHEN p.dst = s.name THEN s.kind ELSE o.kind END AS toKind
    FROM pairs p JOIN nodes s ON s.name = p.{near}
    JOIN nodes o ON o.name = p.{far} WHERE p.{near} IN (SELECT name FROM {asked})
    AND (o.module IS NULL OR s.module IS NULL OR o.module <> s.module)"""
_CROSS_IN = _CROSS.format(near="dst", far="src", asked="busiest")
_CROSS_OUT = _CROSS.format(near="src", far="dst", asked="busiest_out")


@query("J14_deps_cross_in", _CROSS_IN)
def _(w):
    return R.deps_cross(w.graph, R.busiest(w.graph, 10), "in")


@query("J14_deps_cross_out", _CROSS_OUT)
def _(w):
    return R.deps_cross(w.graph, R.busiest(w.graph, 10, "out"), "out")


_FIRST = f"""SELECT self, other, place, total > 200 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY self
    ORDER BY otherModule, other) AS place, count(*) OVER (PARTITION BY self) AS total FROM ({_CROSS_IN})) WHERE place <= 200"""


@query("J14_deps_cross_first", _FIRST)
def _(w):
    """The first rows of each name, as a page shows them, marked where they were cut."""
    rows = R.deps_cross(w.graph, R.busiest(w.graph, 10), "in", 200)
    return rows.select("self", "other", F.col("place").cast("bigint").alias("place"), "cut")


@query("P18_limits", """SELECT p_partkey, greatest(1, least(7 * p_partkey - 3 * p_size, 1000)) AS deps,
    greatest(1, least(7 * p_partkey - 3 * p_size, 2000)) AS strip,
    greatest(1, least(7 * p_partkey - 3 * p_size, 100)) AS search FROM part""")
def _(w):
    asked = 7 * F.col("p_partkey") - 3 * F.col("p_size")
    return _table(w.spark, w.sf_dir, "part").select("p_partkey", *(
        checks.clamped(asked, upper).cast("bigint").alias(name) for name, upper in
        (("deps", checks.DEPS_LIMIT), ("strip", checks.STRIP_LIMIT), ("search", checks.SEARCH_LIMIT))
    ))


_STRIP = """SELECT DISTINCT p.src, a.kind AS srcKind, p.dst, b.kind AS dstKind FROM pairs p
    JOIN nodes a ON a.name = p.src JOIN nodes b ON b.name = p.dst WHERE a.module = 'Root.Beta.M00001'
    AND b.module = 'Root.Alpha.M00000'"""


@query("J15_dep_strip", _STRIP)
def _(w):
    return store.lookup_strip(w.spark, w.stored_graph, "Root.Beta.M00001", "Root.Alpha.M00000")


@query("J15_module_strips", """SELECT a.module AS srcModule, b.module AS dstModule, count(*) AS edges,
    count(DISTINCT p.src) AS sources FROM pairs p JOIN nodes a ON a.name = p.src JOIN nodes b ON b.name = p.dst
    WHERE a.module <> b.module GROUP BY a.module, b.module""")
def _(w):
    return R.module_strips(store.stored_module_edges(w.spark, w.stored_graph))


@query("J16_batch_lookup", """SELECT i.pos AS place, n.name, n.kind, n.module, n.typeSignature, n.docstring,
    coalesce(n.startLine, -1) AS "startLine" FROM (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pos, dst AS name FROM (SELECT DISTINCT src, dst FROM extends)) i
    JOIN nodes n ON n.name = i.name""")
def _(w):
    asked = dense_index(w.feeds.extends.select("src", "dst").distinct(), ["src", "dst"], "place")
    return _no_null_ints(R.batch_lookup(w.graph, asked.select("place", F.col("dst").alias("name"))))


@query("J17_decl_detail", """SELECT name, shortName, kind, module, typeSignature, docstring, sourceFile,
    coalesce(startLine, -1) AS "startLine", coalesce(endLine, -1) AS "endLine", sourceText, CASE WHEN shortName IS NOT NULL THEN coalesce(attr, '') END AS attrs, isDeprecated,
    isExternal, CASE WHEN module IS NOT NULL AND startLine IS NOT NULL THEN
    'https://example.org/library/blob/main/' || replace(module, '.', '/') || '.src#L' || CAST(startLine AS VARCHAR)
    END AS sourceUrl FROM nodes""")
def _(w):
    rows = R.detail_rows(w.graph.declarations).withColumn("attrs", F.array_join("attrs", "|"))
    return _no_null_ints(rows)


@query("J18_induced_edges", """SELECT origin, rel, dep, importer FROM relations r JOIN selected a ON a.node = r.dep
    WHERE EXISTS (SELECT 1 FROM selected b WHERE b.origin = a.origin AND b.node = r.importer)""")
def _(w):
    return V.induced_edges(_relations(w), V.selection(_relations(w), _hubs(w)))


@query("J19_hydrate_pairs", """SELECT 'import' AS rel, a.topo AS a, b.topo AS b, a.name AS a_name, b.name AS b_name
    FROM mmap_edges e JOIN mmap a ON a.name = e.dep JOIN mmap b ON b.name = e.importer
    UNION ALL SELECT s.rel, a.topo, b.topo, a.name, b.name FROM mstructure s
    JOIN mmap a ON a.name = s.src JOIN mmap b ON b.name = s.dst""")
def _(w):
    return store.hydrate_pairs(w.map)


# ---- aggregations ------------------------------------------------------------------------------------------

_STATS = """SELECT (SELECT count(*) FROM mnodes) AS modules, (SELECT count(*) FROM medges) AS edgesDirect,
    (SELECT count(*) FROM mreduced) AS edgesReduced,
    (SELECT count(*) FROM mresolved WHERE dep IS NULL) AS skippedExternalImports,
    CAST(0 AS BIGINT) AS skippedBadLines,
    (SELECT count(*) FROM mtopics WHERE topic = '_default') AS unmatchedTopicModules,
    (SELECT count(*) FROM mstructure WHERE rel = 'extends') AS extendsEdges,
    (SELECT count(*) FROM mstructure WHERE rel = 'instantiates') AS instantiatesEdges,
    (SELECT count(*) FROM mstructure WHERE rel = 'fields') AS fieldsEdges"""


@query("A1_map_stats", _STATS)
def _(w):
    return w.map.stats


@query("A2_unmatched_prefixes", """SELECT CASE WHEN len(string_split(name, '.')) > 2 THEN string_split(name, '.')[2]
    ELSE '(root)' END AS prefix, count(*) AS modules FROM mtopics WHERE topic = '_default' GROUP BY 1""")
def _(w):
    return M.unmatched_prefixes(M.assign_topics(w.module_graph.nodes, w.topics, fixture.ROOT))


@query("A3_decl_count", """SELECT module, count(*) AS "declCount" FROM declarations GROUP BY module""")
def _(w):
    return M.decl_counts(w.feeds.declarations)


@query("A4_closure_size", "SELECT id, closureSize FROM msizes")
def _(w):
    return G.closure_sizes(w.module_graph.nodes, w.closure)


@query("A5_degree", "SELECT module, idx, outDegree, degree FROM bdegree")
def _(w):
    return B.degrees(w.blocks.edges)


@query("A6_deps_grouped", f"""SELECT self, otherModule, "from", fromKind, "to", toKind,
    count(*) OVER (PARTITION BY self, otherModule) AS edges, count(*) OVER (PARTITION BY self) AS total FROM ({_CROSS_IN})""")
def _(w):
    return R.deps_grouped(R.deps_cross(w.graph, R.busiest(w.graph, 10), "in"))


@query("A7_strip_grouped", f"""SELECT src, srcKind, dst, dstKind, count(*) OVER (PARTITION BY src) AS edges,
    count(*) OVER () AS total FROM ({_STRIP})""")
def _(w):
    return R.strip_grouped(R.strip_edges(w.graph, "Root.Beta.M00001", "Root.Alpha.M00000"))


@query("A8_health_counts", """SELECT (SELECT count(*) FROM nodes WHERE module IS NOT NULL) AS decls,
    (SELECT count(*) FROM gmodules) AS modules, CAST(1 AS BIGINT) AS "kgVersion", TRUE AS "layoutPresent" """)
def _(w):
    version = store.kg_version(w.spark, w.stored_map)
    return R.health_counts(w.graph, version, version is not None)


@query("A9_topic_anchor", """SELECT t.id, t.label, round(avg(m.x), 6) AS x, t.y FROM topics t
    JOIN mmap m ON m.topic = t.id GROUP BY t.id, t.label, t.y""")
def _(w):
    return M.topic_anchors(w.map.nodes, w.map.topics).withColumn("x", F.round("x", 6))


@query("A10_block_stats", """SELECT (SELECT count(DISTINCT module) FROM bdecls) AS modules,
    (SELECT count(*) FROM bdecls) AS decls, (SELECT count(*) FROM bedges) AS edges,
    (SELECT count(*) FROM bdecls WHERE inferred) AS "kindsInferred",
    (SELECT coalesce(sum(repeats), 0)::BIGINT FROM brepeats) AS "duplicateNames" """)
def _(w):
    repeats = B.duplicate_declarations(B.alive_records(w.feeds.extract, w.module_graph.nodes))
    return B.block_stats(w.blocks, repeats)


@query("A11_duplicate_decls", "SELECT module, name, repeats FROM brepeats")
def _(w):
    return B.duplicate_declarations(B.alive_records(w.feeds.extract, w.module_graph.nodes))


_HOPS = """hop AS (SELECT name AS origin, name AS node, 0 AS hops FROM busiest
    UNION SELECT h.origin, p.src, h.hops + 1 FROM hop h JOIN pairs p ON p.dst = h.node WHERE h.hops < 4)"""


def _reach(w: Workspace) -> DataFrame:
    edges = w.graph.depends_on.select("src", "dst")
    return V.k_hop(edges, R.busiest(w.graph, 10), 4, backwards=True)


_K_HOP = "SELECT DISTINCT origin, node FROM hop WHERE hops > 0"


def _with_hops(sql: str) -> str:
    """``sql`` over the recursive table of dependents within four hops."""
    return with_ctes("SELECT * FROM busiest, pairs").rsplit(" SELECT * FROM busiest, pairs", 1)[0] + (
        f", {_HOPS} {sql}"
    )


@query("A12_distinct_reach")
def _(w):
    return V.distinct_reach(_reach(w))


# ---- windows -----------------------------------------------------------------------------------------------------

@query("W1_first_wins", "SELECT module, name, seq FROM bfirst")
def _(w):
    records = B.first_records(B.alive_records(w.feeds.extract, w.module_graph.nodes))
    return records.select("module", "name", "seq")


@query("W2_block_index_no", "SELECT module, name, idx FROM bdecls")
def _(w):
    return w.blocks.decls.select("module", "name", "idx")


@query("W2_live_index_no", """SELECT module, name, row_number() OVER (PARTITION BY module ORDER BY name) - 1 AS idx
    FROM nodes WHERE module IS NOT NULL""")
def _(w):
    nodes = R.attributed(w.graph.declarations).select("module", "name")
    return B.index_declarations(nodes, ["name"])


@query("W3_end_line", "SELECT path, start_line AS startLine, end_line AS endLine FROM file_spans")
def _(w):
    return P.scanned(w.sources).select("path", "startLine", "endLine")


@query("W4_column_slot", 'SELECT module, idx, "column", slot FROM bslots')
def _(w):
    return B.column_slots(w.blocks.decls.select("module", "idx", F.col("x").cast("bigint").alias("column")))


@query("W5_zero_spread", "SELECT id, x FROM mx WHERE closureSize = 0")
def _(w):
    xs = M.node_x(G.closure_sizes(w.module_graph.nodes, w.closure), w.levels)
    return xs.filter("closureSize = 0").select("id", "x")


@query("W6_block_offset", "SELECT module, min(o) AS o, sum(l)::BIGINT AS l FROM bindex GROUP BY module")
def _(w):
    return B.module_index(B.block_index(B.block_pieces(w.blocks)))


@query("W7_name_index", "SELECT id, name FROM mnodes")
def _(w):
    return G.name_index(w.feeds.modules, fixture.ROOT)


@query("W8_swimlane_y", "SELECT name, y FROM mmap")
def _(w):
    return w.map.nodes.select("name", "y")


@query("W9_neighbour_y", """SELECT name, aim + (place + lift - floor(aim)) AS y FROM (
    SELECT name, aim, place, max(floor(aim) - place) OVER (PARTITION BY lane ORDER BY place ROWS UNBOUNDED PRECEDING) AS lift
    FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY aim, topo) - 1 AS place FROM (
    SELECT m.name, m.topo, CAST(trunc(x.x) AS BIGINT) AS lane, (p.band + coalesce(s.total, 0)) / (1 + coalesce(s.n, 0)) AS aim
    FROM mnodes i JOIN mmap m ON m.name = i.name JOIN mx x ON x.id = i.id JOIN mtopics p ON p.id = i.id
    LEFT JOIN (SELECT e.importer, sum(d.y) AS total, count(*) AS n FROM medges e JOIN mnodes a ON a.id = e.dep
    JOIN mmap d ON d.name = a.name JOIN mnodes b ON b.id = e.importer JOIN mmap o ON o.name = b.name
    WHERE o.topic = d.topic GROUP BY e.importer) s ON s.importer = i.id)))""")
def _(w):
    doc = M.module_map(
        w.feeds, w.topics, fixture.ROOT, graph=w.module_graph, levels=w.levels, words=w.closure, scores=w.scores,
        near_dependencies=True, order=w.order,
    )
    return doc.nodes.select("name", "y")


# ---- sorts, limits, top-k ---------------------------------------------------------------------------------------------

@query("K1_edge_salience", "SELECT dep, importer, round(score, 6) AS score FROM salience")
def _(w):
    ranked = M.edge_salience(_relations(w), w.map.nodes).orderBy(F.desc("score"), "dep", "importer")
    return ranked.withColumn("score", F.round("score", 6))


@query("K2_density_topk", """SELECT dep, importer, place FROM (SELECT dep, importer,
    row_number() OVER (ORDER BY round(score, 9) DESC, dep, importer) - 1 AS place FROM salience)
    WHERE place < floor(0.25 * (SELECT count(*) FROM salience) + 0.5)""")
def _(w):
    salience = M.edge_salience(_relations(w), w.map.nodes).withColumn("score", F.round("score", 9))
    return M.densest_edges(salience, 0.25).select("dep", "importer", "place")


@query("K3_doc_edge_order", """SELECT row_number() OVER (ORDER BY e.importer, e.dep) - 1 AS place, a.topo AS dep_topo,
    b.topo AS importer_topo FROM mmap_edges e JOIN mmap a ON a.name = e.dep JOIN mmap b ON b.name = e.importer""")
def _(w):
    indexed = M.edges_by_index(w.map.edges, w.map.nodes)
    return dense_index(indexed, ["importer", "dep"], "place").select("place", "dep_topo", "importer_topo")


@query("K4_topo_sorted_nodes", "SELECT topo, name FROM mmap ORDER BY topo")
def _(w):
    return store.document_nodes(w.map).select("topo", "name")


_SEARCH = """SELECT name, kind, module, score FROM (SELECT name, kind, module, ({score})::BIGINT AS score
    FROM (SELECT *, [x FOR x IN regexp_split_to_array(lower(concat_ws(' ', name, shortName)),
    '[^\\p{{L}}\\p{{N}}_]+') IF x <> ''] AS tokens FROM nodes WHERE module IS NOT NULL)) WHERE score > 0
    ORDER BY score DESC, name LIMIT {limit}"""


def _search_oracle(terms: list[str], limit: int) -> str:
    score = " + ".join(
        f"CAST(len([x FOR x IN tokens IF starts_with(x, '{term}')]) > 0 AS INTEGER)" for term in terms
    )
    return _SEARCH.format(score=score, limit=limit)


@query("K5_limited_search", _search_oracle(["d19", "gamma"], 25))
def _(w):
    return S.search_index(w.stored_names, "Gamma d19", 25)


# ---- set operations -------------------------------------------------------------------------------------------------------

@query("U1_union_distinct_nodes", """SELECT name, kind, shortName, namespace, docstring,
    coalesce(startLine, -1) AS "startLine", coalesce(endLine, -1) AS "endLine", isProtected, isDeprecated, deprecatedSince, isExternal, module, typeSignature, label FROM nodes""")
def _(w):
    return _no_null_ints(w.graph.declarations.select(
        "name", "kind", "shortName", "namespace", "docstring", "startLine", "endLine", "isProtected",
        "isDeprecated", "deprecatedSince", "isExternal", "module", "typeSignature", "label",
    ))


@query("U2_distinct_pairs", "SELECT src, dst, context FROM depends")
def _(w):
    return w.graph.depends_on


@query("U3_dep_name_set", "SELECT name FROM dep_targets")
def _(w):
    return build.dependency_names(w.feeds.deps)


@query("U4_multi_relation_union", "SELECT rel, dep, importer FROM relations")
def _(w):
    return _relations(w)


_MODULE_HITS = """SELECT name, string_split(name, '.')[-1] AS "lastSegment", score FROM (SELECT name, CASE
    WHEN starts_with(lower(string_split(name, '.')[-1]), '{q}') THEN 90 WHEN starts_with(lower(name), '{q}') THEN 70
    WHEN starts_with(lower(coalesce(title, '')), '{q}') THEN 50 WHEN contains(lower(name), '{q}') THEN 40
    WHEN contains(lower(coalesce(title, '')), '{q}') THEN 25
    WHEN contains(lower(coalesce(string_split(docstring, chr(10))[1], '')), '{q}') THEN 10 ELSE 0 END::BIGINT AS score
    FROM mmap) WHERE score > 0 ORDER BY score DESC, string_split(name, '.')[-1], name LIMIT 10"""


@query("U5_mixed_hits", "SELECT 0 AS section, 'module' AS type, name, NULL AS kind, NULL AS module, score FROM ("
       + _MODULE_HITS.format(q="m0001") + ") UNION ALL SELECT 1, 'decl', name, kind, module, score FROM ("
       + _search_oracle(["m0001"], 20) + ")")
def _(w):
    return S.mixed_search(
        S.module_search(w.map.nodes, "M0001"), S.search_index(w.stored_names, "M0001", 20)
    )


# ---- graph operators ----------------------------------------------------------------------------------------------------------

@query("G1_module_graph", """SELECT d.name AS dep, i.name AS importer FROM medges e JOIN mnodes d ON d.id = e.dep
    JOIN mnodes i ON i.id = e.importer""")
def _(w):
    return M.named_edges(w.module_graph.edges, w.module_graph.nodes)


@query("G2_topo_levels", "SELECT id, level FROM mlevels")
def _(w):
    return w.levels.select("id", "level")


@query("G3_topo_order", "SELECT id, level, topo FROM mtopo")
def _(w):
    return G.topological_order(w.levels)


@query("G4_closure", "SELECT node, dep FROM mclosure")
def _(w):
    return G.closure_pairs(w.closure, w.order)


@query("G5_transitive_reduction", "SELECT importer, dep FROM mreduced")
def _(w):
    return G.transitive_reduction(w.module_graph.edges, w.closure, w.order)


@query("G6_pagerank", "SELECT id, round(score, 9) AS score FROM mscores")
def _(w):
    return w.scores.select("id", F.round("score", 9).alias("score"))


@query("G7_node_x", "SELECT id, closureSize, round(x, 6) AS x FROM mx")
def _(w):
    xs = M.node_x(G.closure_sizes(w.module_graph.nodes, w.closure), w.levels)
    return xs.withColumn("x", F.round("x", 6))


@query("G8_k_hop")
def _(w):
    return _reach(w)


ORACLES["G8_k_hop"] = _with_hops(_K_HOP)
ORACLES["A12_distinct_reach"] = _with_hops(
    "SELECT origin, count(DISTINCT node) AS reached FROM hop WHERE hops > 0 GROUP BY origin"
)


@query("G9_neighbors", "SELECT origin, side, node FROM near")
def _(w):
    return V.neighbors(_relations(w), _hubs(w))


@query("G10_node_closure", "SELECT origin, side, node FROM far")
def _(w):
    return V.node_closure(_relations(w), _hubs(w))


@query("G11_selection_set", "SELECT origin, node, role FROM selected")
def _(w):
    return V.selection(_relations(w), _hubs(w))


@query("G12_highlight_tiers", """SELECT m.name, m.topic, CASE WHEN s.role IN ('focus', 'neighbor') THEN 'full'
    WHEN s.role = 'closure' THEN 'closure' WHEN m.topic = 'Gamma' THEN 'topic' ELSE 'faded' END AS tier
    FROM mmap m LEFT JOIN (SELECT * FROM selected WHERE origin = (SELECT min(name) FROM hubs)) s ON s.node = m.name""")
def _(w):
    chosen = _hubs(w).agg(F.min("name").alias("name"))
    return V.highlight_tiers(w.map.nodes, V.selection(_relations(w), chosen), "Gamma")


@query("G13_depth_columns", 'SELECT module, idx, "column" FROM bcolumns')
def _(w):
    return B.depth_columns(w.blocks.decls, w.blocks.edges)


@query("G14_module_block", "SELECT module, idx, name, k, x, y, s FROM bplaced")
def _(w):
    return w.blocks.decls.select("module", "idx", "name", "k", "x", "y", "s")


_LIVE = """live AS (SELECT module, name, kind, row_number() OVER (PARTITION BY module ORDER BY name) - 1 AS idx FROM nodes
    WHERE module IN (SELECT name FROM mnodes)),
    live_edges AS (SELECT DISTINCT a.module, a.idx AS src_idx, b.idx AS dst_idx FROM pairs p JOIN live a ON a.name = p.src
    JOIN live b ON b.name = p.dst AND b.module = a.module WHERE p.src <> p.dst),
    live_degree AS (SELECT module, idx, count(*) AS degree FROM (SELECT module, src_idx AS idx FROM live_edges
    UNION ALL SELECT module, dst_idx FROM live_edges) GROUP BY module, idx),
    live_reach AS (SELECT module, src_idx AS a, dst_idx AS b FROM live_edges UNION SELECT r.module, r.a, e.dst_idx
    FROM live_reach r JOIN live_edges e ON e.module = r.module AND e.src_idx = r.b),
    live_stuck AS (SELECT DISTINCT r.module, r.a AS idx FROM live_reach r JOIN live_reach c ON c.module = r.module
    AND c.a = c.b AND (c.a = r.b OR c.a = r.a)),
    live_paths AS (SELECT module, idx, CAST(0 AS BIGINT) AS depth FROM live d WHERE NOT EXISTS
    (SELECT 1 FROM live_edges e WHERE e.module = d.module AND e.src_idx = d.idx)
    UNION SELECT e.module, e.src_idx, p.depth + 1 FROM live_paths p JOIN live_edges e
    ON e.module = p.module AND e.dst_idx = p.idx
    WHERE NOT EXISTS (SELECT 1 FROM live_stuck s WHERE s.module = e.module AND s.idx = e.src_idx)),
    live_depth AS (SELECT module, idx, max(depth) AS depth FROM live_paths GROUP BY module, idx),
    live_columns AS (SELECT module, idx, depth AS x FROM live_depth UNION ALL SELECT s.module, s.idx,
    coalesce(m.deepest, 0) + 1 FROM live_stuck s LEFT JOIN (SELECT module, max(depth) AS deepest FROM live_depth
    GROUP BY module) m ON m.module = s.module),
    live_slots AS (SELECT *, row_number() OVER (PARTITION BY module, x ORDER BY idx) - 1 AS slot FROM live_columns)"""
_LIVE_NODES = """SELECT d.module, d.idx, d.name, d.kind AS k, s.x::DOUBLE AS x, 1.5::DOUBLE * CASE WHEN s.slot % 2 = 1
    THEN (s.slot + 1) // 2 ELSE -((s.slot + 1) // 2) END AS y, round(1.5::DOUBLE + least(3.0::DOUBLE,
    sqrt(coalesce(g.degree, 0))), 2) AS s FROM live d JOIN live_slots s ON s.module = d.module AND s.idx = d.idx
    LEFT JOIN live_degree g ON g.module = d.module AND g.idx = d.idx"""


def _with_live(sql: str) -> str:
    """``sql`` over the recursive tables of the live blocks."""
    known = "SELECT * FROM nodes, pairs, mnodes"
    return with_ctes(known).rsplit(f" {known}", 1)[0] + f", {_LIVE} {sql}"


@query("G14_live_block")
def _(w):
    return B.live_blocks(w.graph, w.module_graph.nodes).edges


@query("G14_live_nodes")
def _(w):
    return B.live_blocks(w.graph, w.module_graph.nodes).decls.select("module", "idx", "name", "k", "x", "y", "s")


ORACLES["G14_live_block"] = _with_live("SELECT module, src_idx, dst_idx FROM live_edges")
ORACLES["G14_live_nodes"] = _with_live(_LIVE_NODES)


@query("G15_module_map", """SELECT topo, name, topic, round(x, 6) AS x, y, round(r, 6) AS r, color,
    declCount, closureSize, isDeprecated, title, docstring FROM mmap""")
def _(w):
    return w.map.nodes.withColumn("x", F.round("x", 6)).withColumn("r", F.round("r", 6))


@query("G16_cycle_members", "SELECT module, idx FROM bstuck")
def _(w):
    key = F.struct("module", "idx")
    arcs = w.blocks.edges.select(
        F.struct("module", F.col("src_idx").alias("idx")).alias("importer"),
        F.struct("module", F.col("dst_idx").alias("idx")).alias("dep"),
    )
    return G.cycle_members(w.blocks.decls.select(key.alias("id")), arcs).select("id.*")


# ---- search ---------------------------------------------------------------------------------------------------------------------

@query("Q1_module_search", _MODULE_HITS.format(q="m0001"))
def _(w):
    return S.module_search(w.map.nodes, " M0001 ")


@query("Q2_decl_search", _search_oracle(["d1", "m0001"], 20))
def _(w):
    return S.search_index(w.stored_names, "m0001 D1", 20)


@query("Q3_mixed_search", "SELECT 0 AS section, 'module' AS type, name, NULL AS kind, NULL AS module, score FROM ("
       + _MODULE_HITS.format(q="gamma") + ") UNION ALL SELECT 1, 'decl', name, kind, module, score FROM ("
       + _search_oracle(["gamma"], 20) + ")")
def _(w):
    return S.mixed_search(
        S.module_search(w.map.nodes, "gamma"), S.search_index(w.stored_names, "gamma", 20)
    )


@query("Q4_text_index", r"""SELECT token, name, count(*) AS hits FROM (SELECT name, unnest([x FOR x IN
    regexp_split_to_array(lower(concat_ws(' ', docstring, shortName, typeSignature, sourceText)),
    '[^\p{L}\p{N}_]+') IF x <> '']) AS token FROM nodes) GROUP BY token, name""")
def _(w):
    base = new_path(w.spark, "tokens")
    store.write_index(S.text_index(w.graph.declarations), base, "text")
    return store.read_index(w.spark, base, "text")


# ---- streaming ------------------------------------------------------------------------------------------------------------------

@query("ST1_incremental_load", _FEED_NODES)
def _(w):
    """The same end state as a batch load, from a stream over files that carry no numbers and come last ones first."""
    modules, records = _unnumbered(w)
    arriving = fixture.arrive_in_reverse(w.spark, records)
    read, _bad = files.read_modules(w.spark, modules)
    base, checkpoint = new_path(w.spark, "landed"), new_path(w.spark, "progress")
    # as many batches for a large feed as for a small one
    incremental.land(w.spark, records, base, checkpoint, files_per_batch=max(2, arriving // 12)).awaitTermination()
    modules_only = E.flatten(read, w.spark.createDataFrame([], schemas.EXTRACT_FEED))
    return _feed_nodes(build.declaration_nodes(incremental.landed(w.spark, base, modules_only)))
