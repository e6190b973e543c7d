"""Argument checks applied before a query plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the request arguments, and the fields a request may choose.
MAX_QUERY_CHARS = 256
MAX_BATCH_NAMES = 500
SEARCH_LIMIT, DEPS_LIMIT, STRIP_LIMIT = 100, 1_000, 2_000

ALLOWED_FIELDS = (
    "name", "kind", "module", "typeSignature", "docstring", "startLine", "endLine",
    "sourceText", "sourceUrl",
)
DEFAULT_FIELDS = ("name", "kind", "module", "typeSignature", "docstring", "startLine")


class QueryError(ValueError):
    """A query argument is outside its allowed range."""


class UnknownName(LookupError):
    """The named module or declaration is not in the graph."""


def clamp(limit: int, upper: int) -> int:
    return max(1, min(limit, upper))


def clamped(limit: Column, upper: int) -> Column:
    """As :func:`clamp`, for a column of limits; a missing one is the upper bound."""
    return F.greatest(F.lit(1), F.least(limit, F.lit(upper)))


def query_text(text: str) -> str:
    text = text.strip()
    if len(text) > MAX_QUERY_CHARS:
        raise QueryError(f"a search text holds at most {MAX_QUERY_CHARS} characters, not {len(text)}")
    return text


def direction(value: str) -> str:
    if value not in ("in", "out"):
        raise QueryError(f"{value!r} is no direction: 'in' lists dependents, 'out' dependencies")
    return value


def distinct_pair(a: str, b: str) -> tuple[str, str]:
    if a == b:
        raise QueryError(f"a strip runs between two modules, {a} is given twice")
    return a, b


def batch_names(names: Sequence[str]) -> list[str]:
    if not 1 <= len(names) <= MAX_BATCH_NAMES:
        raise QueryError(f"between 1 and {MAX_BATCH_NAMES} names are allowed")
    return list(names)


def fields(chosen: Sequence[str] | None) -> list[str]:
    wanted = list(chosen or DEFAULT_FIELDS)
    unknown = [field for field in wanted if field not in ALLOWED_FIELDS]
    if unknown:
        raise QueryError("no such column: " + ", ".join(unknown))
    return wanted


def relations_from_mask(mask: int) -> list[str]:
    """Bitmask 1 = extends, 2 = instantiates, 4 = fields."""
    if not 0 <= mask <= 7:
        raise QueryError("relation mask must lie in 0..7")
    return [rel for bit, rel in enumerate(("extends", "instantiates", "fields")) if mask >> bit & 1]
