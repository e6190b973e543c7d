from __future__ import annotations

import glob
import json

import pytest
from pyspark.sql import functions as F

from depgraph import schemas
from depgraph.operators import build, map_layout as M
from depgraph.plans import fixture
from depgraph.sources import feeds as E
from depgraph.sources import byte_files, files, store
from depgraph.streaming import incremental
from tests.conftest import declaration, module, record, rows


def _write(path, lines):
    path.write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines) + "\n")
    return str(path)


def test_scan_skips_build_folders(spark, tmp_path):
    for name in ("A.src", "Sub/B c.src", ".lake/C.src", "Sub/.lake/D.src", "note.txt"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("line\nline")
    found = rows(files.scan_sources(spark, str(tmp_path)))
    assert [(path.removeprefix(str(tmp_path)), text) for path, text in found] == [
        ("/A.src", "line\nline"), ("/Sub/B c.src", "line\nline"),
    ]


def test_scan_reads_every_name(spark, tmp_path):
    odd = ("A+B.src", "a%20b c.src", "Größe.src", "_C.src", ".hidden.src", "_sub/D.src", ".sub/deep/er/E.src", ".src")
    for name in (*odd, ".lake/_x.src", "x/.lake/y/z.src", "_notes.txt", "empty/none.txt"):
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True, parents=True)
        target.write_bytes(b"x \xff" if name == "_C.src" else name.encode())
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        found = dict(rows(files.scan_sources(spark, root)))
        assert {path.removeprefix(f"{tmp_path}/"): text for path, text in found.items()} == {
            **{name: name for name in odd}, "_C.src": "x \ufffd",
        }


def test_scan_of_many_folders_runs_in_rounds_of_its_depth(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"a{i % 7}" / f"b{i % 5}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"a{i % 7}" / f"b{i % 5}" / f"{i}.src").write_text("t" * i)
    listed = byte_files.list_tree(spark, str(tmp_path), ".lake")
    assert {(p.rsplit("/", 1)[1], n) for p, n in rows(listed)} == {(f"{i}.src", i) for i in range(60)}
    assert byte_files.whole_texts(listed, batch_bytes=100).filter("length(text) = 59").count() == 1
    assert files.scan_sources(spark, str(tmp_path / "a0"), suffix=".none").count() == 0


def test_items_without_required_fields_spoil_their_record(spark, tmp_path):
    base = {"name": "a", "typeSignature": "t"}
    wrong = [{"deps": [{"inType": True}]}, {"extends": [{"parent": "p"}]}, {"fields": [{"position": 1}]}, {"constructors": [{"name": "c"}]}, {"deps": [None]}]
    path = _write(tmp_path / "extract.jsonl", [base, *({**base, **w} for w in wrong)])
    records, bad = files.read_extract(spark, path)
    assert (records.count(), bad) == (1, 5)
    path = _write(tmp_path / "modules.jsonl", [{"module": "A", "path": "a", "imports": [{"isPublic": True}]}, {"module": "B", "path": "b"}])
    modules, bad = files.read_modules(spark, path)
    assert (rows(modules, "module"), bad) == ([("B",)], 1)
    with pytest.raises(files.TooManyBadLines):
        files.read_modules(spark, path, max_bad=1)


def test_feed_order_is_path_order_whatever_the_file_sizes(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    _write(folder / "a.json", [{"module": "A", "path": "a", "declarations": [declaration("y"), declaration("x", "theorem")]}])
    _write(folder / "b.json", [{"module": "B", "path": "b", "declarations": [declaration("x", "def")], "docstring": "long " * 20_000}])
    modules, _ = files.read_modules(spark, str(folder))
    assert [r["module"] for r in modules.orderBy("seq").collect()] == ["A", "B"]
    empty, _ = files.read_extract(spark, _write(tmp_path / "none.jsonl", []))
    nodes = build.declaration_nodes(E.flatten(modules, empty))
    assert dict(rows(nodes, "name", "kind")) == {"x": "def", "y": "def"}
    assert files.read_modules_strict(spark, str(folder)).orderBy("seq").first()["module"] == "A"


def test_bad_module_lines_are_counted_and_too_many_abort(spark, tmp_path):
    good = {"module": "Root.A", "path": "a"}
    lacking = {"module": "Root.B", "path": "b", "declarations": [{"name": "x"}]}
    path = _write(tmp_path / "few.jsonl", [good, "", "{broken", {"path": "only"}, lacking])
    modules, bad = files.read_modules(spark, path)
    assert (rows(modules, "module"), bad) == ([("Root.A",)], 3)
    assert modules.first()["imports"] == [] and modules.first()["isDeprecated"] is False
    many = _write(tmp_path / "many.jsonl", [good] + ["{broken"] * 100)
    with pytest.raises(files.TooManyBadLines):
        files.read_modules(spark, many)
    with pytest.raises(Exception):
        files.read_modules_strict(spark, path).collect()


def test_extract_lines(spark, tmp_path):
    long = {"name": "x", "typeSignature": "s" * 10_001, "module": "Root.A"}
    path = _write(tmp_path / "extract.jsonl", [{"name": "a", "typeSignature": "t"}, "nonsense", {"name": "b"}, long])
    records, bad = files.read_extract(spark, path)
    assert (rows(records, "name"), bad) == ([("a",), ("x",)], 2)
    cut = E.extract_scalars(records).filter("name = 'x'").first()["typeSignature"]
    assert cut == "s" * 10_000 + "...<truncated>"
    assert records.orderBy("seq").first()["name"] == "a"
    assert rows(files.read_extract_loose(spark, path), "name") == [("a",), ("b",), ("x",)]


def test_loose_reader_replaces_bad_bytes(spark, tmp_path):
    path = tmp_path / "bytes.jsonl"
    path.write_bytes(b'{"name": "a\xff", "typeSignature": "t"}\nnot json\n\n{"name": "b\x0cc"}\n')
    assert [r["name"] for r in files.read_extract_loose(spark, str(path)).collect()] == ["a\ufffd"]


def test_stored_topics_get_a_default_row(spark):
    known = spark.createDataFrame([(0, "A", "a", 1.0, "c")], "priority long, id string, label string, y double, color string")
    assert rows(files.topic_table(known), "priority", "id") == [(0, "A"), (1, "_default")]
    assert files.topic_table(files.topic_table(known)).count() == 2


def test_stream_over_unnumbered_files_counts_what_it_rejects(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    _write(source / "0.json", [{"name": "a", "typeSignature": "old", "module": "Root.A"}, "{broken", {"name": "b"}])
    _write(source / "1.json", [{"name": "a", "typeSignature": "new", "module": "Root.B", "instantiates": "C"}, {"name": "c", "typeSignature": "t", "deps": [{}]}])
    base = str(tmp_path / "landed")
    incremental.land(spark, str(source), base, str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    records = spark.read.parquet(f"{base}/extract")
    assert records.orderBy(F.desc("seq")).first()["module"] == "Root.B" and records.count() == 2
    assert incremental.rejected(spark, base) == 3


_ARRIVALS = [
    [{"name": "a", "typeSignature": "old", "module": "Root.A", "deps": [{"name": "x"}]}, {"name": "p", "typeSignature": "p0"}],
    [{"name": "a", "typeSignature": "mid", "module": "Root.A", "deps": [{"name": "x", "inType": True}, {"name": "y"}]},
     {"name": "q", "typeSignature": "q1", "module": "Root.Q", "instantiates": "C", "instancePriority": 3}, "{broken"],
    [{"name": "a", "typeSignature": "new", "module": "Root.B", "constructors": [{"name": "a.mk", "position": 0}]},
     {"name": "q", "typeSignature": "q2", "module": "Root.Q", "deprecatedBy": {"replacement": "r", "since": "s"}}],
    [{"name": "a", "typeSignature": "legacy"}, {"name": "S", "typeSignature": "t", "module": "Root.A",
      "fields": [{"name": "S.x", "position": 0}], "extends": [{"parent": "P", "position": 0}]}],
]


@pytest.mark.parametrize("arrival", ["in order", "reversed", "at once", "one by one"])
def test_any_arrival_gives_the_state_of_a_batch_load(spark, tmp_path, make_feeds, arrival):
    """Files with equal, rising and falling times, together and apart."""
    import os

    source = tmp_path / "in"
    source.mkdir()
    for number, lines in enumerate(_ARRIVALS):
        path = _write(source / f"{number}.json", lines)
        place = {"in order": number, "reversed": 9 - number}.get(arrival, 5)
        os.utime(path, (1_700_000_000 + place, 1_700_000_000 + place))
    modules = make_feeds([module("Root.A", declarations=[declaration("S", "structure"), declaration("b")])])
    base = str(tmp_path / "landed")
    batches = {"at once": 100, "one by one": 1}.get(arrival, 2)
    incremental.land(spark, str(source), base, str(tmp_path / "cp"), files_per_batch=batches).awaitTermination()
    assert incremental.rejected(spark, base) == 1
    streamed = build.build_graph(incremental.landed(spark, base, modules))
    records, bad = files.read_extract(spark, str(source))
    kept = {name: getattr(modules, name) for name in ("modules", "namespaces", "imports", "declarations")}
    whole = E.flatten(spark.createDataFrame([], schemas.MODULE_FEED), records).map(lambda name, table: kept.get(name, table))
    batch = build.build_graph(whole)
    assert bad == 1
    for name in ("declarations", "depends_on", "instantiates", "deprecated_by", "has_field"):
        table = getattr(batch, name)
        assert rows(getattr(streamed, name), *table.columns) == rows(table), name
    newest = streamed.declarations.filter("name = 'a'").first()
    assert (newest["module"], newest["typeSignature"]) == ("Root.B", "legacy")


def test_first_records_survive_the_merge(spark, tmp_path, make_feeds):
    """Blocks take the first record of a name and its dependencies, whichever file came last."""
    import os

    from depgraph.operators import blocks as B

    source = tmp_path / "in"
    source.mkdir()
    chunks = [
        [{"name": "a", "typeSignature": "1", "module": "Root.A", "deps": [{"name": "b"}]}, {"name": "b", "typeSignature": "1", "module": "Root.A"}],
        [{"name": "a", "typeSignature": "2", "module": "Root.A", "instantiates": "I", "deps": [{"name": "c"}]},
         {"name": "c", "typeSignature": "2", "module": "Root.A"}],
    ]
    for number, lines in enumerate(chunks):
        path = _write(source / f"{number}.json", lines)
        os.utime(path, (1_700_000_009 - number, 1_700_000_009 - number))
    modules = make_feeds([module("Root.A")])
    base = str(tmp_path / "landed")
    incremental.land(spark, str(source), base, str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    alive = spark.createDataFrame([("Root.A",)], "name string")
    placed = B.module_blocks(incremental.landed(spark, base, modules), alive)
    names = {r["idx"]: (r["name"], r["k"]) for r in placed.decls.collect()}
    assert names == {0: ("a", "def"), 1: ("b", "def"), 2: ("c", "def")}
    assert rows(placed.edges, "src_idx", "dst_idx") == [(0, 1)]


def test_a_batch_rewrites_only_the_ranges_it_touches(spark, tmp_path, make_feeds):
    source, base, checkpoint = tmp_path / "in", str(tmp_path / "landed"), str(tmp_path / "cp")
    source.mkdir()

    def land(number, names):
        _write(source / f"{number}.json", [{"name": n, "typeSignature": f"{n}{number}", "module": "Root.A"} for n in names])
        incremental.land(spark, str(source), base, checkpoint, ranges=16, keep_superseded=True).awaitTermination()
        return incremental.holders(spark, base)

    first = land(0, [f"n{i}" for i in range(60)])
    assert len(first) == 16 and set(first.values()) == {0}
    second = land(1, ["n3"])
    changed = [place for place in second if second[place] != 0]
    assert len(changed) == 1 and second[changed[0]] == 1
    state = incremental.landed(spark, base, make_feeds([module("Root.A")])).extract
    assert state.count() == 61  # the first and the last record of n3
    assert state.filter("name = 'n3'").orderBy(F.desc("seq")).first()["typeSignature"] == "n31"
    assert incremental.forget_superseded(spark, base) == 1
    assert state.sparkSession.read.parquet(f"{base}/extract").count() == 61
    assert incremental.forget_superseded(spark, base) == 0


def test_merging_records_does_not_depend_on_the_grouping(spark):
    """Merge of merges equals one merge, in any order; repeats of old records add nothing."""
    import random
    from functools import reduce

    draw = random.Random(2)
    fields = incremental._schemas(spark)["extract"]
    every = [
        ((draw.choice([None, None, draw.randrange(9)]), f"f{draw.randrange(3)}", 0, i), f"n{i % 4}", f"s{i}", draw.choice([None, "A", "B"]),
         draw.choice([None, "C"]), None, False, None, None, None, None, draw.randrange(2), 0)
        for i in range(60)
    ]
    whole = rows(incremental.merge_records(spark.createDataFrame(every, fields)))
    assert len(whole) < 60
    for seed in range(3):
        random.Random(seed).shuffle(every)
        parts = [spark.createDataFrame(every[a:a + 20], fields) for a in range(0, 60, 20)]
        merged = reduce(lambda a, b: incremental.merge_records(a.unionByName(b)), [*parts, parts[0]])
        assert rows(merged) == whole


def test_topics_always_have_a_default(spark):
    assert files.topic_dim(spark).count() == 28
    assert rows(files.topic_dim(spark, [("A", "a", 1.0, "c")]), "priority", "id") == [(0, "A"), (1, "_default")]


@pytest.mark.parametrize("text, taken", [
    ('[[topic]]\nid = "A"\nlabel = "a é"\ny = 2\ncolor = "c"\n[[topic]]\nid = "B"\nlabel = "b"\ny = 1.5\ncolor = "d"', 2),
    ('[[topic]]\nid = "_default"\nlabel = "o"\ny = 2.0\ncolor = "c"', 1),
    ("not toml [", None), ("", None), ("[[topic]]\nid = 'A'", None), ("topic = 3", None), ("topic = []", None),
    ("[[topic]]\nid = 'A'\nlabel = 'a'\ny = 'high'\ncolor = 'c'", None), (None, None),
])
def test_topic_file_or_the_built_in_table(spark, tmp_path, text, taken):
    if text is not None:
        (tmp_path / "topics.toml").write_text(text)
    topics, reason = files.read_topics(spark, str(tmp_path / "topics.toml"))
    found = rows(topics, "priority", "id", "y")
    if taken is None:
        assert reason and len(found) == 28
    elif taken == 1:
        assert reason is None and found == [(0, "_default", 2.0)]
    else:
        assert reason is None and found == [(0, "A", 2.0), (1, "B", 1.5), (2, "_default", 140.0)]


def test_modules_round_trip(spark, tmp_path, make_feeds):
    from depgraph import schemas

    frame = spark.createDataFrame([module("Root.A", ["Root.B"], [declaration("a")])], schemas.MODULE_FEED)
    assert files.write_modules_jsonl(frame, str(tmp_path / "out")) == 1
    back, bad = files.read_modules(spark, str(tmp_path / "out"))
    assert bad == 0 and back.drop("seq").first().asDict(True) == frame.drop("seq").first().asDict(True)


@pytest.fixture
def map_doc(spark, make_feeds):
    # names whose order differs from the topological order
    modules = [
        module("Root.Alpha.Zleaf"), module("Root.Alpha.Mid", ["Root.Alpha.Zleaf"]),
        module("Root.Alpha.Adeep", ["Root.Alpha.Mid"]), module("Root.Beta.Shallow", ["Root.Alpha.Zleaf"]),
    ]
    records = [record("p", 1, module="Root.Alpha.Zleaf"), record("c", 2, module="Root.Beta.Shallow",
               extends=[{"parent": "p", "position": 0}])]
    return M.module_map(make_feeds(modules, records), files.topic_dim(spark, fixture.TOPICS), "Root")


def test_map_is_stored_versioned_and_read_in_document_order(spark, tmp_path, map_doc):
    base = str(tmp_path / "kg")
    assert store.read_map(spark, base) is None
    assert store.write_map(map_doc, base, now="t0", seed=40) == 40
    assert store.write_map(map_doc, base, now="t1") == 41
    assert store.kg_version(spark, base) == 41
    doc = store.read_map(spark, base)
    names = [r["name"] for r in store.document_nodes(doc).collect()]
    assert names == ["Root.Alpha.Zleaf", "Root.Alpha.Mid", "Root.Beta.Shallow", "Root.Alpha.Adeep"]
    assert [tuple(r) for r in store.document_edges(doc).collect()] == [(1, 3), (0, 1), (0, 2)]
    assert [tuple(r) for r in store.document_structure(doc).collect()] == [("extends", 2, 0)]
    assert store.verify_store(doc.nodes, 4).first()["matches"]
    assert rows(store.hydrate_pairs(doc), "rel", "a_name")[0] == ("extends", "Root.Beta.Shallow")
    store.drop_graph(spark, base)
    assert store.read_map(spark, base) is None


def test_graph_round_trip(spark, tmp_path, make_feeds):
    graph = build.build_graph(make_feeds([module("Root.A", ["B"], [declaration("a")])], [record("a", 1, ["b"])]))
    store.write_graph(graph, str(tmp_path / "g"))
    back = store.read_graph(spark, str(tmp_path / "g"))
    for name, table in graph.tables().items():
        assert rows(getattr(back, name), *table.columns) == rows(table)
    assert rows(store.lookup_deps(spark, str(tmp_path / "g"), "b"), "other") == [("a",)]
    assert rows(store.lookup_deps(spark, str(tmp_path / "g"), "a", "out"), "other") == [("b",)]


def test_stream_ends_in_the_state_of_a_batch_load(spark, tmp_path, make_feeds):
    records = [record("t", i, [f"d{i % 3}"], typeSignature=f"s{i}") for i in range(6)]
    records += [record("S", 7, fields=[{"name": "S.x", "position": 0}]), record("S.x", 8, typeSignature="late")]
    feeds = make_feeds([module("Root.A", declarations=[declaration("S", "structure")])], records)
    source = tmp_path / "in"
    source.mkdir()
    for number, chunk in enumerate((records[:3], records[3:7], records[7:])):
        _write(source / f"{number}.json", chunk)
    base = str(tmp_path / "landed")
    incremental.land(spark, str(source), base, str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    streamed = build.build_graph(incremental.landed(spark, base, feeds))
    batch = build.build_graph(feeds)
    assert rows(streamed.declarations) == rows(batch.declarations)
    assert rows(streamed.depends_on) == rows(batch.depends_on)
    assert streamed.declarations.filter(F.col("name") == "S.x").first()["typeSignature"] == "late"


def test_source_files_are_written_by_many_tasks(spark, tmp_path):
    """One input file of suppliers gives a file each, by more tasks than one, and each is read again."""
    from depgraph.plans.catalog import QUERIES
    from depgraph.session import shared_dir

    table = spark.range(40).selectExpr("id AS s_suppkey", "concat('S#', id) AS s_name", "CAST(id % 25 AS INT) AS s_nationkey")
    table.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    before = set(glob.glob(f"{shared_dir(spark)}/**/part-*.txt", recursive=True))
    found = rows(QUERIES["S1_scan_sources"](spark, str(tmp_path)))
    written = set(glob.glob(f"{shared_dir(spark)}/**/part-*.txt", recursive=True)) - before
    assert len({path.rsplit("/", 1)[-1].split("-")[1] for path in written}) > 1
    assert len(found) == 32 and ("a + b%20S#4 Größe", "nation 4\né\n") in found


def test_feed_files_hold_bounded_records(spark, tmp_path, monkeypatch):
    """A larger feed is written in more files, which still follow the order of the numbers."""
    monkeypatch.setattr(fixture, "FILE_RECORDS", 5)
    feed = spark.range(120).selectExpr("id AS seq", "concat('n', id) AS name")
    later = spark.range(8).selectExpr("concat('later', id) AS name").repartition(4)
    fixture.written_in_order(feed, "seq", f"{tmp_path}/feed", later)
    paths = sorted(glob.glob(f"{tmp_path}/feed/0*/part-*.json"))
    lines = [[json.loads(line)["name"] for line in open(path)] for path in paths]
    assert max(map(len, lines)) <= 12 and [n for part in lines for n in part] == [f"n{i}" for i in range(120)]
    assert len(glob.glob(f"{tmp_path}/feed/900/part-*.json")) > 1


def test_block_ranks_are_a_stored_table(spark, tmp_path):
    """Catalyst sees how small the ranks are, so numbering does not shuffle the records by their few blocks."""
    for i in range(3):
        _write(tmp_path / f"{i}.json", [{"name": f"n{i}"}])
    placed = spark.read.schema("name string").json(str(tmp_path)).select("name", *files.place_columns())
    plan = files.numbered(placed, files.block_ranks(placed))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_shuffle_files_go_with_the_query_that_wrote_them(spark, tmp_path):
    """What a stored table shuffled is no longer on disk once the table is; reading it again works."""
    import time

    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {path for d in dirs for path in glob.glob(f"{d}/*/shuffle_*")}

    before, counted = shuffled(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    counted.write.parquet(f"{tmp_path}/kept")
    end = time.time() + 20
    while (left := shuffled() - before) and time.time() < end:
        time.sleep(0.1)
    assert not left
    assert rows(counted) == rows(counted) == rows(spark.read.parquet(f"{tmp_path}/kept"))


def test_the_extract_feed_is_written_in_compressed_files_of_bounded_records(spark, monkeypatch):
    import gzip

    from depgraph.plans import catalog

    class Plain:
        tables = None

    Plain.spark = spark
    feed = spark.range(23).selectExpr("id AS seq", "concat('n', id) AS name", "'t' AS typeSignature", "'Root.A' AS module").coalesce(1)
    monkeypatch.setattr(fixture, "FILE_RECORDS", 5)
    monkeypatch.setattr(fixture, "extract_feed", lambda _: feed)
    folder = catalog._extract_json(Plain)
    paths = glob.glob(f"{folder.removeprefix('file:')}/part-*.json.gz")
    assert sorted(len(gzip.open(path).readlines()) for path in paths) == [3, 5, 5, 5, 5]
    assert not glob.glob(f"{folder.removeprefix('file:')}/part-*.json")
    records, bad = files.read_extract(spark, folder)
    assert bad == 0 and rows(records, "seq", "name") == rows(feed, "seq", "name")


def test_ordered_feed_files_are_compressed_and_the_nested_copy_is_dropped(spark, tmp_path):
    from depgraph.session import shared_dir

    def nested():
        return set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/**/nested-*", recursive=True))

    before = nested()
    feed = spark.range(120).selectExpr("id AS seq", "concat('n', id) AS name", "'t' AS typeSignature")
    later = spark.createDataFrame([("late", "t")], "name string, typeSignature string")
    pattern = fixture.written_in_order(feed, "seq", f"{tmp_path}/feed", later, "gzip")
    assert nested() == before
    assert len(glob.glob(f"{tmp_path}/feed/*/part-*.json.gz")) == len(glob.glob(f"{tmp_path}/feed/*/part-*")) > 12
    records, bad = files.read_extract(spark, pattern)
    assert bad == 0
    assert [r["name"] for r in records.orderBy("seq").collect()] == [*(f"n{i}" for i in range(120)), "late"]


def test_items_are_dealt_out_once_in_a_merge(spark):
    """Repeated items come together, nulls too, and each range lies in few tasks."""
    place = "seq struct<own: bigint, _file: string, _block: bigint, _row: bigint>"
    every = [((None, f"f{i % 3}", 0, i), f"s{i % 20}", None if i % 7 == 0 else "A", f"t{i % 5}" if i % 11 else None, True, i % 2 == 0) for i in range(200)]
    items = spark.createDataFrame(every, f"{place}, src string, module string, dst string, inType boolean, inValue boolean")
    merged = incremental._merged("deps", items, 4)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert rows(merged, *items.columns) == rows(incremental.merge_items(items))
    assert merged.filter(F.col("range") != incremental._in_range("src", 4)).count() == 0
