"""Scalar column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kind of declaration -> node label.
KIND_LABELS = {
    "theorem": "Theorem",
    "lemma": "Lemma",
    "def": "Definition",
    "instance": "Instance",
    "class": "Class",
    "structure": "Structure",
    "inductive": "Inductive",
    "axiom": "Axiom",
    "abbrev": "Abbreviation",
    "notation": "Notation",
}

# Signatures beyond this many characters are cut and marked.
MAX_SIGNATURE = 10_000
TRUNCATION_MARK = "...<truncated>"
MAX_DOCSTRING = 1_000

SOURCE_BASE = "https://example.org/library/blob/main/"
SOURCE_SUFFIX = ".src"
WORD_SPLIT = r"[^\p{L}\p{N}_]+"


def under_root(name: Column, root: str) -> Column:
    """Modules below ``root.``; the umbrella module ``root`` itself does not qualify."""
    return name.startswith(f"{root}.")


def kind_label(kind: Column) -> Column:
    pairs = [F.lit(item) for pair in KIND_LABELS.items() for item in pair]
    return F.create_map(*pairs)[kind]


def dep_context(in_type: Column, in_value: Column) -> Column:
    return (
        F.when(in_type & in_value, F.lit("both"))
        .when(in_type, F.lit("type"))
        .otherwise(F.lit("value"))
    )


def infer_kind(instantiates: Column, n_constructors: Column, n_extends: Column) -> Column:
    """Kind read off the shape of a record, for declarations the source parse cannot see."""
    return (
        F.when(instantiates.isNotNull(), F.lit("instance"))
        .when(n_constructors > 0, F.lit("inductive"))
        .when(n_extends > 0, F.lit("class"))
        .otherwise(F.lit("def"))
    )


def is_overlong(signature: Column, limit: int = MAX_SIGNATURE) -> Column:
    return F.length(signature) > limit


def truncate_signature(signature: Column, limit: int = MAX_SIGNATURE) -> Column:
    cut = F.concat(F.substring(signature, 1, limit), F.lit(TRUNCATION_MARK))
    return F.when(is_overlong(signature, limit), cut).otherwise(signature)


def truncate_doc(doc: Column, limit: int = MAX_DOCSTRING) -> Column:
    return F.substring(doc, 1, limit)


def source_url(
    module: Column, line: Column, base: str = SOURCE_BASE, suffix: str = SOURCE_SUFFIX
) -> Column:
    known = module.isNotNull() & (module != "") & line.isNotNull() & (line != 0)
    link = F.concat(
        F.lit(base), F.translate(module, ".", "/"), F.lit(f"{suffix}#L"), line.cast("string")
    )
    return F.when(known, link)


def words(text: Column) -> Column:
    """Non-empty word tokens of ``text``."""
    return F.filter(F.split(text, WORD_SPLIT), lambda token: token != "")


def query_terms(text: str) -> list[str]:
    """Word tokens of a query string, each meant as a prefix."""
    return [token for token in re.split(r"\W+", text) if token]


def prefix_terms(text: Column) -> Column:
    """The words of a search text, each with a star behind it, parted by blanks."""
    return F.array_join(F.transform(words(text), lambda token: F.concat(token, F.lit("*"))), " ")


def module_label(name: Column) -> Column:
    return F.substring_index(name, ".", -2)


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def first_line(doc: Column) -> Column:
    """First line of a non-empty docstring; null for a missing or empty one."""
    return F.when(doc != "", F.substring_index(doc, "\n", 1))


def owner_prefix(name: Column) -> Column:
    """Everything before the final dot; null when there is no dot."""
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", ""))


def radius(score: Column, low: Column, high: Column) -> Column:
    """Area-aware radius: the smallest score gets 0.2, the largest 3.2."""
    spread = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return F.lit(0.2) + F.lit(3.0) * F.sqrt((score - low) / spread)


def node_size(degree: Column) -> Column:
    return F.round(F.lit(1.5) + F.least(F.lit(3.0), F.sqrt(degree.cast("double"))), 2)


def zigzag(slot: Column) -> Column:
    """0, +1, -1, +2, -2, ... for slots 0, 1, 2, 3, 4, ..."""
    step = F.floor((slot + 1) / 2)
    return F.when(slot % 2 == 1, step).otherwise(-step)


def spread_x(rank: Column) -> Column:
    """x of nodes without dependencies: 0, -1, ..., -9 and around again."""
    return (-(rank % 10)).cast("double")


def closure_x(size: Column) -> Column:
    return F.pow(size.cast("double"), F.lit(0.72))
