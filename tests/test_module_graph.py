from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from depgraph.operators import map_layout as M
from depgraph.operators import module_graph as G
from depgraph.plans import fixture
from depgraph.sources.files import topic_dim
from tests.conftest import module, rows


@pytest.fixture
def graph_of(spark):
    def build(names, edges):
        nodes = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
        place = {n: i for i, n in enumerate(names)}
        pairs = [(place[a], place[b]) for a, b in edges]
        return G.ModuleGraph(nodes, spark.createDataFrame(pairs, "importer long, dep long"), len(names), 0)

    return build


def test_filter_drops_umbrella_foreign_and_repeated(make_feeds):
    feeds = make_feeds([
        module("Root"), module("Other.X"), module("Root.A"),
        module("Root.B", ["Root.A", "Root.A", "Ext", "Root.B"]),
    ])
    graph = G.module_graph(feeds.modules, feeds.imports, "Root")
    assert (graph.modules, graph.external_imports) == (2, 1)
    assert rows(graph.edges) == [(1, 0)]


def test_empty_filter_is_an_error(make_feeds):
    feeds = make_feeds([module("Other.X")])
    with pytest.raises(G.EmptyGraph):
        G.module_graph(feeds.modules, feeds.imports, "Root")


def test_cycle_names_its_members(graph_of):
    with pytest.raises(G.ImportCycle) as error:
        G.topological_levels(graph_of("XYZ", [("X", "Y"), ("Y", "X")]))
    assert error.value.sample == ["X", "Y"]


def test_chain_closure_and_diamond_reduction(graph_of):
    chain = graph_of("ABCD", [("D", "A"), ("D", "B"), ("D", "C"), ("C", "B"), ("B", "A")])
    words = G.closure(chain.edges, G.topological_levels(chain))
    assert rows(G.closure_sizes(chain.nodes, words)) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    diamond = graph_of("ABCD", [("D", "A"), ("D", "B"), ("D", "C"), ("C", "A"), ("B", "A")])
    words = G.closure(diamond.edges, G.topological_levels(diamond))
    assert rows(G.transitive_reduction(diamond.edges, words)) == [(1, 0), (2, 0), (3, 1), (3, 2)]


def _reference(n, deps):
    """Order, closure, reduction and rank of a small graph by plain loops."""
    users = [[i for i in range(n) if d in deps[i]] for d in range(n)]
    missing = [len(d) for d in deps]
    order, head = [i for i in range(n) if not deps[i]], 0
    while head < len(order):
        for user in users[order[head]]:
            missing[user] -= 1
            if missing[user] == 0:
                order.append(user)
        head += 1
    below = [set() for _ in range(n)]
    for node in order:
        for d in deps[node]:
            below[node] |= {d} | below[d]
    kept = {(i, d) for i in range(n) for d in deps[i] if not any(d in below[e] for e in deps[i])}
    rank = [1 / n] * n
    for _ in range(30):
        loose = sum(r for r, d in zip(rank, deps) if not d)
        new = [0.15 / n + 0.85 * loose / n] * n
        for i in range(n):
            for d in deps[i]:
                new[d] += 0.85 * rank[i] / len(deps[i])
        change = sum(abs(a - b) for a, b in zip(new, rank))
        rank = new
        if change < 1e-6:
            break
    return order, below, kept, rank


def test_random_graph_against_plain_loops(spark):
    draw = random.Random(5)
    n = 200  # four words, the last one not full
    names = list(range(n))
    place = names[:]
    draw.shuffle(place)
    deps = [set() for _ in range(n)]
    for a in range(1, n):
        for b in draw.sample(range(a), min(a, draw.choice([0, 1, 1, 2, 3]))):
            deps[place[a]].add(place[b])
    for a in range(1, 24):  # a long chain makes the order keys wrap
        deps[place[a]].add(place[a - 1])
    order, below, kept, rank = _reference(n, deps)
    nodes = spark.createDataFrame([(i, f"m{i:03d}") for i in names], "id long, name string")
    edges = spark.createDataFrame([(a, b) for a in names for b in deps[a]], "importer long, dep long")
    graph = G.ModuleGraph(nodes, edges, n, 0)
    levels = G.topological_levels(graph)
    topo = {r["topo"]: r["id"] for r in G.topological_order(levels).collect()}
    assert [topo[i] for i in range(n)] == order
    words = G.closure(edges, levels)
    assert {(r["node"], r["dep"]) for r in G.closure_pairs(words).collect()} == {(i, d) for i in names for d in below[i]}
    assert {tuple(r) for r in G.transitive_reduction(edges, words).collect()} == kept
    assert dict(rows(G.closure_sizes(nodes, words))) == {i: len(below[i]) for i in names}
    scores = {r["id"]: r["score"] for r in G.pagerank(nodes, edges, n).collect()}
    assert max(abs(scores[i] - rank[i]) for i in names) < 1e-12


def _graph_with_chains(seed):
    """Names are shuffled; stretches without branches hang between nodes of several dependencies."""
    draw = random.Random(seed)
    deps = [set() for _ in range(6)]
    while len(deps) < 150:
        if draw.random() < 0.35:
            last = draw.randrange(len(deps))
            for _ in range(draw.randrange(2, 14)):
                deps.append({last})
                last = len(deps) - 1
        else:
            deps.append(set(draw.sample(range(len(deps)), draw.randrange(1, 4))))
    place = list(range(len(deps)))
    draw.shuffle(place)
    out = [set() for _ in deps]
    for i, own in enumerate(deps):
        out[place[i]] = {place[d] for d in own}
    return out


@pytest.mark.parametrize("seed, after, key_levels", [(1, 2, 16), (2, 2, 4), (3, 4, 6)])
def test_contracted_chains_keep_levels_and_order(spark, monkeypatch, seed, after, key_levels):
    monkeypatch.setattr(G, "_CONTRACT_AFTER", after)
    monkeypatch.setattr(G, "_KEY_LEVELS", key_levels)
    deps = _graph_with_chains(seed)
    n = len(deps)
    contracted = []
    contract = G._contract
    monkeypatch.setattr(G, "_contract", lambda *a: contracted.append(contract(*a)) or contracted[-1])
    nodes = spark.createDataFrame([(i, f"m{i:03d}") for i in range(n)], "id long, name string")
    edges = spark.createDataFrame([(a, b) for a in range(n) for b in deps[a]], "importer long, dep long")
    levels = G.topological_levels(G.ModuleGraph(nodes, edges, n, 0))
    assert any(c is not None for c in contracted)
    topo = {r["topo"]: r["id"] for r in G.topological_order(levels).collect()}
    assert [topo[i] for i in range(n)] == _reference(n, deps)[0]


def test_a_chain_of_ten_thousand_takes_few_jobs(spark, monkeypatch):
    from depgraph import session

    written = []
    monkeypatch.setattr(session, "materialize", lambda *a, f=session.materialize, **k: written.append(a[1:2]) or f(*a, **k))
    monkeypatch.setattr(G, "materialize", session.materialize)
    n = 10_000
    nodes = spark.range(n + 2).select("id", F.format_string("m%05d", "id").alias("name"))
    chain = spark.range(1, n).select(F.col("id").alias("importer"), (F.col("id") - 1).alias("dep"))
    side = spark.createDataFrame([(n, n - 1), (n, n + 1)], "importer long, dep long")  # a user of the end and of a leaf
    levels = G.topological_levels(G.ModuleGraph(nodes, chain.unionByName(side), n + 2, 0))
    assert len(written) < 30
    placed = {r["id"]: r["topo"] for r in G.topological_order(levels).collect()}
    assert placed == {0: 0, n + 1: 1, **{i: i + 1 for i in range(1, n)}, n: n + 1}


def test_cycles_behind_and_before_chains_are_stuck(spark, monkeypatch):
    monkeypatch.setattr(G, "_CONTRACT_AFTER", 2)
    edges = [(i, i - 1) for i in range(1, 30)]  # a chain
    edges += [(40, 45), *((i, i - 1) for i in range(41, 46))]  # a circle of single nodes
    edges += [(50, 45), *((i, i - 1) for i in range(51, 70))]  # a chain behind the circle
    edges += [(80, 29), (80, 69)]  # behind both
    ids = sorted({i for e in edges for i in e})
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    levels, stuck = G.peel(nodes, spark.createDataFrame(edges, "importer long, dep long"))
    assert {r["id"]: r["level"] for r in levels.collect()} == {i: i for i in range(30)}
    assert {r["id"] for r in stuck.collect()} == {*range(40, 46), *range(50, 70), 80}


def test_words_in_topological_order_hold_neighbours_together(spark):
    """Modules 2..129 import module 0 or 1 by turns, and the last two all those of one kind: side by side they take fewer words."""
    pairs = [(i, i % 2) for i in range(2, 130)] + [(130 + i % 2, i) for i in range(2, 130)]
    nodes = spark.createDataFrame([(i, f"m{i:03d}") for i in range(132)], "id bigint, name string")
    edges = spark.createDataFrame(pairs, "importer bigint, dep bigint")
    levels = G.topological_levels(G.ModuleGraph(nodes, edges, 132, 0))
    order = G.topological_order(levels)
    words, plain = G.closure(edges, levels, order), G.closure(edges, levels)
    assert words.filter("node >= 130").count() == 5
    assert plain.filter("node >= 130").count() == 6
    every = {*pairs, (130, 0), (131, 1)}
    assert {tuple(r) for r in G.closure_pairs(words, order).collect()} == every
    assert {tuple(r) for r in G.transitive_reduction(edges, words, order).collect()} == set(pairs)


def test_words_hold_sixty_four_dependencies(spark):
    """One module that imports 130 leaves, and one that imports it: ids at both ends of words, the sign bit among them."""
    nodes = spark.createDataFrame([(i, f"m{i:03d}") for i in range(132)], "id long, name string")
    edges = spark.createDataFrame([(130, d) for d in range(130)] + [(131, 130), (131, 63), (131, 128)], "importer long, dep long")
    levels = G.topological_levels(G.ModuleGraph(nodes, edges, 132, 0))
    words = G.closure(edges, levels)
    assert rows(words, "node", "word") == sorted(((n, w) for n in (130, 131) for w in range(3)), key=lambda r: tuple(map(str, r)))
    assert {tuple(r) for r in G.closure_pairs(words).collect()} == {(n, d) for n in (130, 131) for d in range(n)}
    assert {tuple(r) for r in G.transitive_reduction(edges, words).collect()} == {(130, d) for d in range(130)} | {(131, 130)}


def test_rank_of_a_cyclic_graph_sums_to_one(spark):
    nodes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, name string")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "importer long, dep long")
    deps = [{1}, {0}, {0}]
    scores = {r["id"]: r["score"] for r in G.pagerank(nodes, edges, 3).collect()}
    assert abs(sum(scores.values()) - 1) < 1e-9
    rank = _reference(3, deps)[3]
    assert max(abs(scores[i] - rank[i]) for i in range(3)) < 1e-12


def test_zero_spread_radii_and_topics(spark, make_feeds):
    feeds = make_feeds([module(f"Root.{'Alpha' if i < 6 else 'Zeta'}.M{i:02d}") for i in range(12)])
    doc = M.module_map(feeds, topic_dim(spark, fixture.TOPICS), "Root", bad_lines=2)
    nodes = doc.nodes.orderBy("topo").collect()
    assert [r["x"] for r in nodes] == [0.0, -1.0, -2.0, -3.0, -4.0, -5.0, -6.0, -7.0, -8.0, -9.0, 0.0, -1.0]
    assert {r["r"] for r in nodes} == {0.2}
    assert {r["topic"] for r in nodes} == {"Alpha", "_default"}
    stats = doc.stats.first()
    assert (stats["modules"], stats["edgesDirect"], stats["skippedBadLines"], stats["unmatchedTopicModules"]) == (12, 0, 2, 6)
    assert rows(M.unmatched_prefixes(doc.nodes)) == [("Zeta", 6)]


def test_modules_settle_near_their_dependencies(spark):
    """Column 3 holds five modules: means of band and dependencies, then upwards to free slots."""
    placed = spark.createDataFrame([
        (0, 0, 0.0, "A", 10.0, 10.0), (1, 1, -1.0, "A", 10.0, 15.0), (2, 2, -2.0, "B", 50.0, 50.0),
        (3, 3, 3.2, "A", 10.0, 10.0), (4, 4, 3.9, "A", 10.0, 11.0), (5, 5, 3.5, "A", 10.0, 9.0), (6, 6, 3.0, "B", 50.0, 50.0), (7, 7, 3.1, "A", 10.0, 12.0),
    ], "id long, topo long, x double, topic string, band double, y double")
    edges = spark.createDataFrame([(3, 1), (4, 0), (4, 2), (5, 1), (5, 0), (6, 0), (7, 1)], "importer long, dep long")
    found = {r["id"]: r["y"] for r in M.neighbour_y(placed, edges).collect()}
    assert found[0] == found[1] == 10.0 and found[2] == 50.0  # each alone in its column
    # aims: 3 and 7 at (10 + 15) / 2, 4 at 10 (its other dependency is of another topic), 5 at 35 / 3, 6 at its band
    assert found[4] == 10.0 and found[5] == pytest.approx(35 / 3) and found[3] == 12.5 and found[7] == 13.5 and found[6] == 50.0


def test_settled_slots_are_unique_in_a_column(spark):
    draw = random.Random(8)
    data = [(i, i, float(draw.randrange(4)), draw.choice("AB"), 10.0, 10.0 + draw.randrange(-3, 4)) for i in range(300)]
    placed = spark.createDataFrame(data, "id long, topo long, x double, topic string, band double, y double")
    edges = spark.createDataFrame([(i, draw.randrange(i)) for i in range(1, 300) for _ in range(2)], "importer long, dep long").distinct()
    found = M.neighbour_y(placed, edges).collect()
    slots = {(int(r["x"]), int(r["y"] // 1)) for r in found}
    assert len(slots) == len(found) == 300


def test_radius_formula(spark):
    scores = spark.createDataFrame([(0, 0.0), (1, 0.25), (2, 1.0)], "id long, score double")
    assert [round(r["r"], 9) for r in M.radii(scores).orderBy("id").collect()] == [0.2, 1.7, 3.2]


def test_topic_priority_beats_specificity(spark):
    nodes = spark.createDataFrame([(0, "Root.A.B.C"), (1, "Root.A"), (2, "Root.AB.C")], "id long, name string")
    topics = topic_dim(spark, [("A", "a", 1.0, "x"), ("A.B", "b", 2.0, "y")])
    assert rows(M.assign_topics(nodes, topics, "Root"), "name", "topic") == [
        ("Root.A", "_default"), ("Root.A.B.C", "A"), ("Root.AB.C", "_default"),
    ]


def test_salience_order_and_density(spark):
    nodes = spark.createDataFrame([("X", 3.0), ("Y", 2.0), ("Z", 2.0)], "name string, r double")
    edges = spark.createDataFrame(
        [("import", "Y", "Z"), ("import", "X", "Z"), ("import", "X", "Y"), ("extends", "X", "Y")],
        "rel string, dep string, importer string",
    )
    salience = M.edge_salience(edges, nodes)
    ranked = salience.orderBy(F.desc("score"), "dep", "importer").collect()
    assert [(r["dep"], r["importer"]) for r in ranked] == [("X", "Y"), ("X", "Z"), ("Y", "Z")]
    assert rows(M.densest_edges(salience, 0.5), "dep", "importer") == [("X", "Y"), ("X", "Z")]
    assert M.densest_edges(salience, 0.0).count() == 0
