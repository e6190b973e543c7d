"""Iterative algorithms on the module graph.

All loops work on bigint ids, write one table per round and bring only counters
to the driver.  Edges are rows (importer, dep): the importer depends on dep.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.functions import columns as C
from depgraph.operators.ranking import dense_index
from depgraph.session import Rounds, materialize, materialize_with

# A node's order key grows by one id per level; it is replaced by a rank this often.
_KEY_LEVELS = 48
# Rounds expressed in one job before its rows are written.  Inside a job a round's
# shuffle is read by the later rounds, so a round is still computed once.
_ROUNDS_PER_WRITE = 4
_LEVELS_PER_WRITE = 6
_ROUNDS_PER_CHECK = 10


class EmptyGraph(RuntimeError):
    """No module survived the root filter."""


class ImportCycle(RuntimeError):
    """The import graph has a cycle; ``sample`` names at most ten of its members."""

    def __init__(self, sample: list[str]):
        super().__init__("the modules import each other in a circle: " + ", ".join(sample))
        self.sample = sample


@dataclass(frozen=True)
class ModuleGraph:
    nodes: DataFrame  # id, name
    edges: DataFrame  # importer, dep (ids, distinct, no self edge)
    modules: int
    external_imports: int


# ---- building -----------------------------------------------------------------------------

def filter_root_modules(modules: DataFrame, root: str) -> DataFrame:
    return modules.filter(C.under_root(F.col("module"), root))


def name_index(modules: DataFrame, root: str) -> DataFrame:
    """Dense id = ascending name rank of the modules below the root."""
    names = filter_root_modules(modules, root).select(F.col("module").alias("name")).distinct()
    return dense_index(names, ["name"], "id").select("id", "name")


def resolve_imports(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """Imports of known modules with both ids; ``dep`` is null for an external target."""
    importers = nodes.select(F.col("id").alias("importer"), F.col("name").alias("module"))
    targets = nodes.select(F.col("id").alias("dep"), "name")
    known = imports.select("module", "name").join(importers, "module")
    return known.join(targets, "name", "left").select("importer", "dep")


def module_graph(modules: DataFrame, imports: DataFrame, root: str) -> ModuleGraph:
    nodes, counts = materialize_with(name_index(modules, root), "nodes", n=F.count(F.lit(1)))
    if not counts["n"]:
        raise EmptyGraph(f"the feed has no module below {root}")
    resolved, external = materialize_with(
        resolve_imports(imports, nodes), "resolved", n=F.count_if(F.col("dep").isNull())
    )
    edges = resolved.filter("dep IS NOT NULL AND dep <> importer").distinct()
    return ModuleGraph(nodes, materialize(edges, "edges"), counts["n"], external["n"])


# ---- levels and order -----------------------------------------------------------------------

def peel(
    nodes: DataFrame, edges: DataFrame, keep_order: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Place nodes level by level, dependencies first.

    Returns (id, level[, key]) of the placed nodes and (id) of the nodes that lie on
    or behind a cycle.  A round turns the edges of the newly placed nodes into one
    message per importer and adds them to the counts of missing dependencies of the
    nodes still pending, in one join and one grouped pass over a single table.  Several
    rounds are one job; a job hands on what is pending and the nodes it placed last.  The edges
    are cut down to those of pending nodes each time half of these are placed, so an edge is read a few
    times and not once a level.

    Deep graphs are mostly chains.  After the first levels, and again after twice as many, chains of pending
    nodes with one dependency and one importer are contracted: when the first node of a chain is placed,
    the message of its last node is under way until the level that one would have, and levels
    in between that hold nothing else are skipped.

    ``key`` orders the nodes of one level as a first-in-first-out peel in id order
    would pop them: by the last-popped dependency, which always lies on the level
    before, then by id.  Nobody but the next node of a chain follows its inner nodes, so these share the key of the first.
    """
    spark = nodes.sparkSession
    kind = nodes.schema["id"].dataType.simpleString()
    needed = edges.groupBy(F.col("importer").alias("id")).agg(F.count(F.lit(1)).alias("missing"))
    counted = nodes.select("id").join(needed, "id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    ready = F.col("missing") == 0
    key = F.when(ready, F.array("id")) if keep_order else F.lit(None)
    state = counted.select(
        "id", F.lit(None).cast(kind).alias("rep"), "missing", F.when(ready, F.lit(0)).cast("bigint").alias("level"),
        key.cast("array<bigint>").alias("key"), F.lit(None).cast("bigint").alias("arrive"),
    )
    step = _STEP.replace("<id>", kind).replace("<key>", "array_append(best, id)" if keep_order else "own")
    if not keep_order:  # without arrays to compare, rows are grouped by hash and not by sorting
        for name in ("own", "best"):
            step = step.replace(f"max({name})", "CAST(NULL AS ARRAY<BIGINT>)")
    edges = edges.select("importer", "dep", F.lit(0).cast("bigint").alias("steps"))
    rounds = Rounds(spark, "peel")
    inner: list[DataFrame] = []
    shared_keys: list[DataFrame] = []
    first, level, unranked, at_cut, contract_at = 0, 0, 0, None, _CONTRACT_AFTER
    while True:
        top = first + _LEVELS_PER_WRITE - 1
        for level in range(level, top):
            state = spark.sql(step, state=state, edges=edges, level=level)
        table, counts = rounds.add(
            state.filter(F.col("level").isNull() | (F.col("level") >= first)),
            newest=F.count_if(F.col("level") == top), next=F.min("arrive"),
            pending=F.count_if(F.col("level").isNull() & F.col("rep").isNull()),
        )
        newest = table.filter(F.col("level") == top)
        pending = table.filter("level IS NULL AND rep IS NULL")
        under_way = table.filter("rep IS NOT NULL")
        if not counts["pending"] or not counts["newest"] and counts["next"] is None:
            break
        unranked += _LEVELS_PER_WRITE
        if keep_order and unranked + _LEVELS_PER_WRITE > _KEY_LEVELS:
            newest, under_way, unranked = *_short_keys(newest, under_way), 0
            shared_keys.append(under_way.select("rep", F.lit(top + 1).cast("bigint").alias("since"), "key"))
        if at_cut is None or 2 * counts["pending"] <= at_cut:
            at_cut = counts["pending"]
            edges = materialize(edges.join(pending.select(F.col("id").alias("importer")), "importer", "leftsemi"), "open_edges")
        if len(rounds) * _LEVELS_PER_WRITE >= contract_at:
            contract_at *= 2
            found = _contract(pending, edges)
            if found is not None:
                followers, edges = found
                inner.append(followers)
                pending = pending.join(followers.select("id"), "id", "leftanti").select(*pending.columns)
        state = newest.unionByName(pending).unionByName(under_way)
        level = top if counts["newest"] else counts["next"]
        first = level + 1
    columns = ["id", "level", "key"] if keep_order else ["id", "level"]
    levels = rounds.all().filter("level IS NOT NULL").select(*columns)
    stuck = pending.select("id")
    if inner:
        followers = inner[0]
        for more in inner[1:]:
            followers = followers.unionByName(more)
        levels = materialize(levels, "outer_levels")
        own = followers.join(levels.withColumnRenamed("id", "rep"), "rep")
        own = own.withColumn("level", F.col("level") + F.col("step")).drop("step")
        for keys in shared_keys:
            later = own.join(keys.select("rep", "since", F.col("key").alias("later")), "rep", "left")
            own = later.withColumn("key", F.when(F.col("level") >= F.col("since"), F.col("later")).otherwise(F.col("key"))).drop("since", "later")
        stuck = stuck.unionByName(followers.join(levels.select(F.col("id").alias("rep")), "rep", "leftanti").select("id"))
        levels = levels.unionByName(own.select(*columns))
    levels = materialize(levels, "levels")
    stuck = materialize(stuck, "stuck")
    rounds.drop()
    return levels, stuck


# Levels after which chains are contracted for the first time; then after twice as many each time.
_CONTRACT_AFTER = 24

# One level.  Rows of the state are pending nodes (no level), placed ones, and messages of chains under way (rep is
# the chain's first node, arrive the level of its last).  A placed node on this level stands beside each of its edges;
# it is spelled out as itself, whose repeats the grouping removes, and the message of the edge.
_STEP = """
SELECT id, rep, missing, arrive,
  CASE WHEN level IS NULL AND rep IS NULL AND missing = 0 THEN {level} + 1L ELSE level END AS level,
  CASE WHEN level IS NULL AND rep IS NULL AND missing = 0 THEN <key> ELSE own END AS key
FROM (
  SELECT id, rep, sum(missing) AS missing, max(level) AS level, max(own) AS own, max(best) AS best, max(arrive) AS arrive
  FROM (
    SELECT inline(CASE
      WHEN s.rep IS NOT NULL AND s.arrive = {level} THEN array(
        struct(s.id AS id, CAST(NULL AS <id>) AS rep, -1L AS missing, CAST(NULL AS BIGINT) AS level,
               CAST(NULL AS ARRAY<BIGINT>) AS own, s.key AS best, CAST(NULL AS BIGINT) AS arrive))
      WHEN e.importer IS NULL THEN array(
        struct(s.id AS id, s.rep AS rep, s.missing AS missing, s.level AS level, s.key AS own,
               CAST(NULL AS ARRAY<BIGINT>) AS best, s.arrive AS arrive))
      WHEN e.steps = 0 THEN array(
        struct(s.id AS id, s.rep AS rep, s.missing AS missing, s.level AS level, s.key AS own,
               CAST(NULL AS ARRAY<BIGINT>) AS best, s.arrive AS arrive),
        struct(e.importer AS id, CAST(NULL AS <id>) AS rep, -1L AS missing, CAST(NULL AS BIGINT) AS level,
               CAST(NULL AS ARRAY<BIGINT>) AS own, s.key AS best, CAST(NULL AS BIGINT) AS arrive))
      ELSE array(
        struct(s.id AS id, s.rep AS rep, s.missing AS missing, s.level AS level, s.key AS own,
               CAST(NULL AS ARRAY<BIGINT>) AS best, s.arrive AS arrive),
        struct(e.importer AS id, s.id AS rep, 0L AS missing, CAST(NULL AS BIGINT) AS level,
               s.key AS own, CAST(NULL AS ARRAY<BIGINT>) AS best, {level} + e.steps AS arrive))
      END)
    FROM {state} AS s LEFT JOIN {edges} AS e ON e.dep = s.id AND s.level = {level} AND s.rep IS NULL)
  GROUP BY id, rep)"""


def _contract(pending: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Chains among pending nodes: (id, rep, step) of all their nodes but the first, and the edges with each
    chain as one of so many ``steps`` from its first to its last node.

    None where there is no chain.  A node follows its dependency if both have that one missing dependency and one
    importer.  Pointers to the first node double their reach in every round; circles of such nodes are left alone.
    """
    plain = edges.filter("steps = 0")
    ends = plain.join(pending.select(F.col("id").alias("dep")), "dep", "leftsemi")
    users = plain.groupBy(F.col("dep").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("importer").alias("user"))
    single = pending.filter("missing = 1").select("id").join(users.filter("n = 1").select("id", "user"), "id")
    single = materialize(single.join(ends.select(F.col("importer").alias("id"), "dep"), "id", "left"), "singles")
    firsts = single.select(F.col("id").alias("dep"), F.lit(1).cast("bigint").alias("step"))
    pointers, counts = materialize_with(
        single.join(firsts, "dep", "left").select(
            "id", F.when(F.col("step") == 1, F.col("dep")).otherwise(F.col("id")).alias("rep"), F.coalesce("step", F.lit(0)).alias("step")
        ),
        "pointers", all=F.count(F.lit(1)), followers=F.count_if(F.col("step") == 1),
    )
    if not counts["followers"]:
        return None
    reach = 1
    while reach < counts["all"]:
        for _ in range(_DOUBLINGS):
            further = pointers.select(F.col("id").alias("rep"), F.col("rep").alias("next"), F.col("step").alias("more"))
            pointers = pointers.join(further, "rep").select(
                "id", F.col("next").alias("rep"), (F.col("step") + F.col("more")).alias("step"), (F.col("more") > 0).alias("open")
            )
            reach *= 2
        pointers, left = materialize_with(pointers, "pointers", open=F.count_if("open"))
        if not left["open"]:
            break
    heads = pointers.filter("step = 0").select(F.col("id").alias("rep"))
    followers = materialize(pointers.filter("step > 0").join(heads, "rep", "leftsemi").select("id", "rep", "step"), "followers")
    last = followers.groupBy("rep").agg(F.max("step").alias("steps"), F.max_by("id", "step").alias("last"))
    chains = last.join(single.select(F.col("id").alias("last"), "user"), "last").select(
        F.col("user").alias("importer"), F.col("rep").alias("dep"), "steps"
    )
    inside = followers.select("id").unionByName(followers.select(F.col("rep").alias("id"))).distinct()
    kept = edges.join(followers.select(F.col("id").alias("importer")), "importer", "leftanti").join(
        inside.select(F.col("id").alias("dep")), "dep", "leftanti"
    )
    return followers, materialize(kept.select("importer", "dep", "steps").unionByName(chains), "open_edges")


# Doublings of the chains' pointers in one job.
_DOUBLINGS = 2


def _short_keys(placed: DataFrame, under_way: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the order keys of one level, and of messages that pass it, by their ranks among all of them."""
    ranked = dense_index(placed.unionByName(under_way), ["key"], "rank")
    ranked = materialize(ranked.withColumn("key", F.array("rank")).select(*placed.columns), "ranks")
    return ranked.filter("rep IS NULL"), ranked.filter("rep IS NOT NULL")


def topological_levels(graph: ModuleGraph) -> DataFrame:
    """(id, level, key) of all modules; an import cycle is an error."""
    levels, stuck = peel(graph.nodes, graph.edges, keep_order=True)
    sample = [
        row["name"]
        for row in stuck.join(graph.nodes, "id").select("name").orderBy("name").limit(10).collect()
    ]
    if sample:
        raise ImportCycle(sample)
    return levels


def topological_order(levels: DataFrame) -> DataFrame:
    """(id, level, topo): the dependencies-first position of every module."""
    return dense_index(levels, ["level", "key"], "topo").select("id", "level", "topo")


def cycle_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes a dependencies-first peel never places."""
    return peel(nodes, edges)[1]


# ---- closure and reduction --------------------------------------------------------------------

# A set of modules is kept as rows (word, bits): the modules of places 64 * word .. 64 * word + 63 that are in it.
# A place is the id, or the position in an order that has modules of like dependencies side by side, so that sets
# take fewer words.
WORD_BITS = 64
_BIT = f"shiftleft(1L, CAST(place % {WORD_BITS} AS INT))"

# One level of the closure.  A row on this level stands beside each edge to an importer; it is spelled out as itself,
# whose repeats bit_or removes, and as what the importer gets from it.
_HAND_UP = """
SELECT node, word, at, bit_or(bits) AS bits, bit_or(via) AS via FROM (
  SELECT inline(CASE WHEN e.importer IS NULL THEN array(struct(s.node AS node, s.word AS word, s.at AS at, s.bits AS bits, s.via AS via))
    ELSE array(struct(s.node AS node, s.word AS word, s.at AS at, s.bits AS bits, s.via AS via),
               struct(e.importer AS node, s.word AS word, e.ilevel AS at, s.bits AS bits, s.bits AS via)) END)
  FROM {state} AS s LEFT JOIN {leveled} AS e ON e.dep = s.node AND s.at = {level})
GROUP BY node, word, at"""


def _places(order: DataFrame) -> DataFrame:
    return order.select(F.col("id").alias("dep"), F.col("topo").alias("place"))


def closure(edges: DataFrame, levels: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """What every node depends on, as words: (node, word, bits, via).

    With ``order`` (id, topo) the words count in its positions, otherwise in ids; what reads the words
    must be given the same.  Importers of the same modules are neighbours in the topological order, and mostly
    in the sets of others together, so a set takes fewer words of positions than of ids by name.

    ``bits`` are all direct and indirect dependencies, ``via`` those that a direct dependency depends on.  Levels are
    handled bottom-up.  When a level is reached the words of its nodes are complete, and each node hands them to
    its importers once: an edge moves as many rows as its dependency has words, up to 64 dependencies in
    each.  A job handles several levels; it reads the rows of these levels alone, which Parquet statistics find, since
    rows are sorted by the level they wait for.
    """
    spark = edges.sparkSession
    at = levels.select("id", "level")
    placed = edges.withColumn("place", F.col("dep")) if order is None else edges.join(_places(order), "dep")
    leveled = materialize(
        placed.join(at.select(F.col("id").alias("importer"), F.col("level").alias("ilevel")), "importer")
        .join(at.select(F.col("id").alias("dep"), F.col("level").alias("dlevel")), "dep")
        .sortWithinPartitions("dlevel"),
        "leveled",
    )
    direct, found = materialize_with(
        leveled.groupBy(F.col("importer").alias("node"), F.expr(f"place div {WORD_BITS}").alias("word"), F.col("ilevel").alias("at"))
        .agg(F.expr(f"bit_or({_BIT})").alias("bits"), F.max("dlevel").alias("below")).sortWithinPartitions("at"),
        "direct", top=F.max("below"),
    )
    direct = direct.select("node", "word", "at", "bits", F.lit(0).cast("bigint").alias("via"))
    rounds = Rounds(spark, "handed")
    for first in range(1, (found["top"] or 0) + 1, _LEVELS_PER_WRITE):
        last = min(first + _LEVELS_PER_WRITE - 1, found["top"])
        state = direct.filter(F.col("at").between(first, last))
        if len(rounds):
            state = state.unionByName(rounds.all().filter(F.col("at").between(first, last)))
        for level in range(first, last + 1):
            state = spark.sql(_HAND_UP, state=state, leveled=leveled, level=level)
        rounds.add(state.sortWithinPartitions("at"))
    words = direct if not len(rounds) else direct.unionByName(rounds.all())
    merged = words.groupBy("node", "word").agg(F.expr("bit_or(bits)").alias("bits"), F.expr("bit_or(via)").alias("via"))
    finished = materialize(merged, "closure")
    rounds.drop()
    return finished


def closure_pairs(words: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(node, dep): the words spelled out, a row for each pair."""
    if order is not None:
        members = order.groupBy(F.expr(f"topo div {WORD_BITS}").alias("word")).agg(
            F.array_sort(F.collect_list(F.struct("topo", "id")))["id"].alias("ids")
        )
        known = words.select("node", "word", "bits").join(materialize(members, "members"), "word")
        spelled = known.select("node", "bits", F.posexplode("ids").alias("bit", "dep"))
        return spelled.filter("shiftrightunsigned(bits, bit) & 1L = 1").select("node", "dep")
    bit = F.explode(F.sequence(F.lit(0), F.lit(WORD_BITS - 1))).alias("bit")
    spelled = words.select("node", "word", "bits", bit).filter("shiftrightunsigned(bits, bit) & 1L = 1")
    return spelled.select("node", (F.col("word") * WORD_BITS + F.col("bit")).alias("dep"))


def closure_sizes(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """(id, closureSize): the bits of each node's words."""
    counted = words.groupBy(F.col("node").alias("id")).agg(F.sum(F.bit_count("bits")).alias("closureSize"))
    return nodes.select("id").join(counted, "id", "left").select(
        "id", F.coalesce("closureSize", F.lit(0)).alias("closureSize")
    )


def transitive_reduction(edges: DataFrame, words: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Edges not implied by another direct dependency: each edge probes one bit of the word that its target is in."""
    placed = edges.withColumn("place", F.col("dep")) if order is None else edges.join(_places(order), "dep")
    probed = placed.withColumn("word", F.expr(f"place div {WORD_BITS}")).join(
        words.select(F.col("node").alias("importer"), "word", "via"), ["importer", "word"]
    )
    return probed.filter(f"via & {_BIT} = 0").select("importer", "dep")


# ---- rank -------------------------------------------------------------------------------------

def pagerank(
    nodes: DataFrame, edges: DataFrame, n: int,
    alpha: float = 0.85, max_iter: int = 30, tol: float = 1e-6,
) -> DataFrame:
    """(id, score): each importer splits its rank evenly over the modules it imports.

    The iteration is linear: the uniform parts (teleport and dangling mass) only scale
    the start vector.  So the rounds propagate a plain start vector through the edges,
    with no global sum in between, and its support shrinks round by round until it is
    empty on an acyclic graph.  The scores of every round are then weighted sums of the
    propagated vectors, from which the first round below the tolerance is taken.
    """
    degree = edges.groupBy("importer").agg(F.count(F.lit(1)).alias("degree"))
    weighted = materialize(
        edges.join(degree, "importer").select("importer", "dep", (F.lit(alpha) / F.col("degree")).alias("w")),
        "weighted",
    )
    current = nodes.select("id", F.lit(1.0 / n).alias("v"))
    rounds = Rounds(nodes.sparkSession, "rank")
    done = 0
    while done < max_iter:
        steps: list[DataFrame] = []
        for step in range(done + 1, min(done + _ROUNDS_PER_WRITE, max_iter) + 1):
            current = current.select(F.col("id").alias("importer"), "v").join(weighted, "importer").groupBy(
                F.col("dep").alias("id")
            ).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
            steps.append(current.withColumn("step", F.lit(step)))
        done += len(steps)
        rows = steps[0]
        for part in steps[1:]:
            rows = rows.unionByName(part)
        table, counts = rounds.add(rows, last=F.count_if(F.col("step") == done))
        if not counts["last"]:
            break
        current = table.filter(F.col("step") == done).select("id", "v")

    vector = [f"v{step}" for step in range(done + 1)]
    start = nodes.select("id", F.lit(1.0 / n).alias("v"), F.lit(0).alias("step"))
    long = start.unionByName(rounds.all())
    wide = long.groupBy("id").agg(*[
        F.coalesce(F.sum(F.when(F.col("step") == step, F.col("v"))), F.lit(0.0)).alias(name)
        for step, name in enumerate(vector)
    ])
    importing = degree.select(F.col("importer").alias("id"), F.lit(False).alias("dangling"))
    wide = materialize(
        wide.join(importing, "id", "left").withColumn("dangling", F.coalesce("dangling", F.lit(True))),
        "vectors",
    )
    rounds.drop()
    sums = wide.filter("dangling").agg(*[F.sum(name).alias(name) for name in vector]).first()
    loose = [sums[name] or 0.0 for name in vector]
    weights = _round_weights(loose, n, alpha, max_iter)
    last = _first_settled(wide, vector, weights, tol)
    return wide.select("id", F.expr(_weighted(vector, weights[last])).alias("score"))


def _first_settled(
    wide: DataFrame, vector: Sequence[str], weights: Sequence[Sequence[float]], tol: float
) -> int:
    """The first round whose total change is below ``tol``, else the last round."""
    rounds = len(weights) - 1
    for first in range(1, rounds + 1, _ROUNDS_PER_CHECK):
        block = range(first, min(first + _ROUNDS_PER_CHECK, rounds + 1))
        moves = [[b - a for a, b in zip(weights[step - 1], weights[step])] for step in block]
        row = wide.agg(*[
            F.expr(f"sum(abs({_weighted(vector, move)}))").alias(f"d{step}")
            for step, move in zip(block, moves)
        ]).first()
        for step, change in zip(block, row):
            if change < tol:
                return step
    return rounds


def _round_weights(loose: Sequence[float], n: int, alpha: float, rounds: int) -> list[list[float]]:
    """Weights of the propagated vectors in the scores after 0..rounds rounds."""
    uniform: list[float] = []  # the uniform part added by each round, relative to the start
    weights = []
    for done in range(rounds + 1):
        row = [0.0] * len(loose)
        for step in range(len(loose)):
            if step < done:
                row[step] = uniform[done - 1 - step]
            elif step == done:
                row[step] = 1.0
        weights.append(row)
        dangling = sum(w * mass for w, mass in zip(row, loose))
        uniform.append((1.0 - alpha) + alpha * dangling)
    return weights


def _weighted(vector: Sequence[str], weights: Sequence[float]) -> str:
    """SQL text of the weighted sum of the vector columns."""
    terms = [f"{name} * {weight!r}D" for name, weight in zip(vector, weights) if weight]
    return " + ".join(terms) or "0D"
