"""Small column helpers shared by the row-local text functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    A column referenced inside a lambda would otherwise be recomputed for each
    array element; as a lambda variable it is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind_sql(value: Column, body: str) -> Column:
    """``bind`` with the body as SQL text over ``x``.  Long expressions are
    parsed in one go instead of being built call by call."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"x -> {body}")), F.lit(0))


def let(name: str, value: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` standing for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def quoted(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _constant(value, schema: str) -> Column:
    """Literal of a nested type; the optimizer folds it into a constant."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def strings(values: Iterable[str]) -> Column:
    """Literal ``array<string>``."""
    return _constant(list(values), "array<string>")


def string_map(values: dict[str, str]) -> Column:
    """Literal ``map<string, string>``."""
    return _constant(values, "map<string,string>")


def rows(values: Iterable[dict], schema: str) -> Column:
    """Literal ``array<struct<...>>``."""
    return _constant(list(values), f"array<struct<{schema}>>")


def empty_strings() -> Column:
    return F.array().cast("array<string>")
