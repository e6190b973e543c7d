"""Recovers the turns and roles of chat transcripts with a hidden Markov model.

States are role x (first line of a turn, later line).  Each line shows what its speaker marker names,
whether it is blank, its length and its last sign.  Transition and emission counts come from labelled
transcripts; Viterbi finds the likeliest states; turns are then written in one canonical form.

A conversation of any length is decoded in pieces.  Lines are range-partitioned in transcript order.
A piece of a conversation acts on path scores as a matrix in max-plus algebra; the few matrices of a
conversation that spans partitions are multiplied in order, which fixes the state before and at the
end of each piece, and every piece is then decoded on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depgraph.llm.common import lower_ascii, prepare
from depgraph.llm.scan import earlier_value
from depgraph.operators.ranking import running_total
from depgraph.session import materialize

ROLES = ("system", "user", "assistant")
#: Names that speaker markers use for each role.
NAMES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "prompt"),
    "assistant": ("assistant", "ai", "bot", "model", "gpt", "agent", "answer", "a", "response"),
}
#: A marker: up to 24 characters of name in a wrapper or before a colon, at the start of a line.
MARKER = r"^\s*(?:<\|([A-Za-z][\w .-]{0,23})\|>|\[([A-Za-z][\w .-]{0,23})\]:?|#{1,4} ?([A-Za-z][\w .-]{0,23}):?$|\**([A-Za-z][\w.-]{0,23})\**:(?:\s|$))\s*"
_OTHER = len(ROLES) + 1
#: Values each feature can take.
FEATURES = {"marker": len(ROLES) + 2, "blank": 2, "length": 5, "ending": 3}
_STATES = 2 * len(ROLES)


@dataclass
class Model:
    """Logarithms: start (states), move (states x states), emit (states x values) for each feature."""

    start: np.ndarray
    move: np.ndarray
    emit: dict[str, np.ndarray]

    def scores(self, lines: pd.DataFrame) -> np.ndarray:
        return sum(self.emit[name][:, lines[name].to_numpy()].T for name in FEATURES)


def line_features(line: Column) -> dict[str, Column]:
    """Small integers that describe a line."""
    found = F.concat_ws("", *(F.regexp_extract(line, MARKER, i) for i in range(1, 5)))
    name = F.trim(lower_ascii(found))
    marker = F.when(name == "", 0)
    for i, role in enumerate(ROLES, 1):
        marker = marker.when(name.isin(*NAMES[role]), i)
    size = F.length(line)
    return {
        "marker": marker.otherwise(_OTHER),
        "blank": (F.trim(line) == "").cast("int"),
        "length": F.when(size < 20, 0).when(size < 80, 1).when(size < 200, 2).when(size < 600, 3).otherwise(4),
        "ending": F.when(line.rlike(r"\?\s*$"), 1).when(line.rlike(r":\s*$"), 2).otherwise(0),
    }


def transcript_lines(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv, turn, at (place in the turn), line and its features, for every line of a table of messages.

    Null conversation numbers form one conversation ('' as conv); null texts are one empty line; messages
    with a null turn come first.  A column ``role``, if there is one, is kept as it is.
    """
    role = [F.col("role")] if "role" in conversations.columns else [F.lit(None).cast("string").alias("role")]
    lines = conversations.select(
        F.coalesce(F.col(conv_id).cast("string"), F.lit("")).alias("conv"), F.col(turn).alias("turn"), *role,
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "line"),
    )
    return lines.withColumns({k: v.cast("int") for k, v in line_features(F.col("line")).items()})


def fit(lines: DataFrame) -> Model:
    """Counts of the labelled lines (conv, turn, at, role and features), each plus one half.

    Lines whose role is null or unknown count for nothing.  Without labels all states are alike.
    """
    number = F.lit(None).cast("int")
    for i, role in enumerate(ROLES):
        number = F.when(F.col("role") == role, i).otherwise(number)
    known = lines.withColumn("state", 2 * number + (F.col("at") > 0).cast("int"))
    turns = known.groupBy("conv", "turn", "role").agg(F.max("state").alias("state"))
    turns = earlier_value(turns, ["conv"], ["turn", "role"], F.col("state"), "before").filter("state IS NOT NULL")
    first = (F.col("state") / 2).cast("int") * 2
    starts = turns.filter("before IS NULL").groupBy(first.alias("a")).count().withColumn("b", F.lit(-1))
    between = turns.filter("before IS NOT NULL").groupBy(F.col("before").alias("a"), first.alias("b")).count()
    later = known.filter("state % 2 = 1")
    inside = later.groupBy((F.col("state") - (F.col("at") == 1).cast("int")).alias("a"), F.col("state").alias("b")).count()
    start, move = np.full(_STATES, 0.5), np.full((_STATES, _STATES), 0.5)
    for frame in (starts, between, inside):
        for row in frame.select("a", "b", "count").collect():  # states x states rows at most
            if row.b < 0:
                start[row.a] += row["count"]
            else:
                move[row.a, row.b] += row["count"]
    for i in range(len(ROLES)):  # a turn cannot go on in another role
        move[:, 2 * i + 1][[s for s in range(_STATES) if s // 2 != i]] = 0
        start[2 * i + 1] = 0
    emit = {}
    for name, values in FEATURES.items():
        table = np.full((_STATES, values), 0.5)
        for row in known.filter("state IS NOT NULL").groupBy("state", name).count().collect():
            table[row.state, row[name]] += row["count"]
        emit[name] = np.log(table / table.sum(axis=1, keepdims=True))
    with np.errstate(divide="ignore"):
        return Model(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), emit)


def piece_matrix(model: Model, scores: np.ndarray, first: bool) -> np.ndarray:
    """Best score of a path over the lines, from the state before (row) to the last state (column)."""
    best = np.tile(model.start, (_STATES, 1)) if first else model.move.copy()
    best = best + scores[0]
    for line in scores[1:]:
        best = (best[:, :, None] + model.move[None]).max(axis=1) + line
    return best


def decode(model: Model, scores: np.ndarray, before: int = -1, last: int = -1) -> np.ndarray:
    """Viterbi path over the lines, after the state ``before`` (-1: start) and ending in ``last`` (-1: any)."""
    best = (model.start if before < 0 else model.move[before]) + scores[0]
    back = np.zeros(scores.shape, dtype=np.int64)
    for i in range(1, len(scores)):
        step = best[:, None] + model.move
        back[i] = step.argmax(axis=0)
        best = step[back[i], np.arange(_STATES)] + scores[i]
    path = np.empty(len(scores), dtype=np.int64)
    path[-1] = best.argmax() if last < 0 else last
    for i in range(len(scores) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _borders(pieces: pd.DataFrame) -> pd.DataFrame:
    """State before and last state of every piece of one conversation."""
    pieces = pieces.sort_values("cell")
    matrices = [np.frombuffer(m, dtype=np.float64).reshape(_STATES, _STATES) for m in pieces["matrix"]]
    reached = [matrices[0][0]]
    for m in matrices[1:]:
        reached.append((reached[-1][:, None] + m).max(axis=0))
    last = [int(reached[-1].argmax())]
    for i in range(len(matrices) - 1, 0, -1):
        last.append(int((reached[i - 1] + matrices[i][:, last[-1]]).argmax()))
    last.reverse()
    return pd.DataFrame({"conv": pieces["conv"], "cell": pieces["cell"], "before": [-1, *last[:-1]], "last": last})


def recover_roles(lines: DataFrame, model: Model) -> DataFrame:
    """Every line with the recovered ``state``, ``found_role`` and ``message`` (turn, counted from 0).

    Of lines with equal conv, turn and at, the order is by their text.  An empty table gives an empty result.
    """
    spark = prepare(lines.sparkSession)
    order = ["conv", "turn", "at", "line"]
    shared = spark.sparkContext.broadcast(model)
    columns = ["cell", *order, "role", *FEATURES]
    cells = materialize(
        lines.repartitionByRange(*order).withColumn("cell", F.spark_partition_id()).select(*columns), "chat-cells"
    )
    spread = cells.groupBy("conv", "cell").count().groupBy("conv").agg(
        F.min("cell").alias("first_cell"), F.count("*").alias("cells")
    ).filter("cells > 1")
    spread = materialize(spread, "chat-spread")

    def matrices(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values(["turn", "at", "line"], na_position="first")
        head = piece.iloc[0]
        made = piece_matrix(shared.value, shared.value.scores(piece), head["cell"] == head["first_cell"])
        return pd.DataFrame({"conv": [head["conv"]], "cell": [head["cell"]], "matrix": [made.tobytes()]})

    pieces = (
        cells.join(spread.select("conv", "first_cell"), "conv")
        .groupBy("conv", "cell").applyInPandas(matrices, "conv string, cell int, matrix binary")
    )
    borders = pieces.groupBy("conv").applyInPandas(_borders, "conv string, cell int, before int, last int")
    borders = materialize(borders, "chat-borders")

    def states(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["conv", "turn", "at", "line"], na_position="first", kind="stable")
        scores = shared.value.scores(cell)
        conv = cell["conv"].to_numpy()
        edge = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        before, last = cell["before"].to_numpy(), cell["last"].to_numpy()
        paths = [
            decode(shared.value, scores[a:b], int(before[a]), int(last[a]))
            for a, b in zip(edge, np.append(edge[1:], len(conv)))
        ]
        return cell[kept].assign(state=np.concatenate(paths))

    kept = ["conv", "turn", "at", "line", "role", "marker"]
    joined = cells.join(borders, ["conv", "cell"], "left").withColumns(
        {"before": F.coalesce("before", F.lit(-1)), "last": F.coalesce("last", F.lit(-1))}
    )
    turn_type = cells.schema["turn"].dataType.simpleString()
    decoded = joined.groupBy("cell").applyInPandas(
        states, f"conv string, turn {turn_type}, at int, line string, role string, marker int, state int"
    )
    decoded = materialize(decoded, "chat-states")
    starts = (F.col("state") % 2 == 0).cast("long")
    numbered = running_total(decoded, order[1:], "message", starts, ["conv"])
    names = F.array(*map(F.lit, ROLES))
    return numbered.withColumns({
        "message": F.col("message") + starts - 1,
        "found_role": F.get(names, (F.col("state") / 2).cast("int")),
    })


def canonical(lines: DataFrame) -> DataFrame:
    """Adds ``piece``: a line of the canonical transcript.  The pieces of a conversation, in order, parted by
    line feeds, are ``<|role|>``, the turn's lines without its marker, and ``<|end|>`` before the next turn."""
    head = F.col("state") % 2 == 0
    body = F.when(head & (F.col("marker") > 0), F.regexp_replace("line", MARKER, "")).otherwise(F.col("line"))
    opening = F.concat(
        F.when(F.col("message") > 0, F.lit("<|end|>\n")).otherwise(""), F.lit("<|"), F.col("found_role"), F.lit("|>\n")
    )
    return lines.withColumn("piece", F.concat(F.when(head, opening).otherwise(""), body))


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """Messages as a raw export would show them: a speaker marker before the text, in one of several styles
    for each conversation, some of which name no role; one message in eight has none.  ``role`` stays as label.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit(1)), F.lit(8)) == 0
    role = F.col("role")
    speaker = F.when(role == "assistant", "Robin").when(role == "user", "Sam").otherwise("Host")
    marker = (
        F.when(style == 0, F.concat(F.initcap(role), F.lit(": ")))
        .when(style == 1, F.concat(F.lit("<|"), role, F.lit("|> ")))
        .when(style == 2, F.concat(F.lit("### "), F.initcap(role), F.lit(":\n")))
        .when(style == 3, F.concat(F.when(role == "assistant", "A").when(role == "user", "Q").otherwise("Context"), F.lit(": ")))
        .otherwise(F.concat(speaker, F.lit(": ")))
    )
    shown = F.when(bare | role.isNull(), F.col("text")).otherwise(F.concat(marker, F.coalesce("text", F.lit(""))))
    return conversations.withColumn("text", shown)
