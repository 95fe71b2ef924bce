"""Record filters as boolean columns with two-valued logic.

Every filter is true or false, never null: a missing value fails a positive
filter and passes a negative one.  A filter that stands alone in ``where``
keeps its bare form, which the Parquet scan can push down; under NOT and OR the
null-safe form is used.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Filter:
    """``build(df)`` gives the bare predicate; ``when_null`` is its value where that is null."""

    build: Callable[[DataFrame], Column]
    when_null: bool = False

    def safe(self, df: DataFrame) -> Column:
        return F.coalesce(self.build(df), F.lit(self.when_null))

    def top(self, df: DataFrame) -> Column:
        return self.safe(df) if self.when_null else self.build(df)


def _kind(df: DataFrame, key: str) -> T.DataType | None:
    return df.schema[key].dataType if key in df.columns else None


def _same_type(kind: T.DataType | None, value: Any) -> bool:
    """Equality compares like with like: text with text, truth values with truth values, numbers with numbers."""
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return False


def _equal(df: DataFrame, key: str, value: Any) -> Column:
    # A null in a column is a missing key, which equals nothing, so nothing equals None.
    return F.col(key) == F.lit(value) if _same_type(_kind(df, key), value) else F.lit(False)


def equal(key: str, value: Any) -> Filter:
    return Filter(lambda df: _equal(df, key, value))


def not_equal(key: str, value: Any) -> Filter:
    return Filter(lambda df: ~F.coalesce(_equal(df, key, value), F.lit(False)), True)


def any_of(key: str, *values: Any) -> Filter:
    def build(df: DataFrame) -> Column:
        usable = [v for v in values if _same_type(_kind(df, key), v)]
        return F.col(key).isin(usable) if usable else F.lit(False)

    return Filter(build)


def none_of(key: str, *values: Any) -> Filter:
    return Filter(lambda df: ~any_of(key, *values).safe(df), True)


def _text(key: str, make: Callable[[Column], Column]) -> Filter:
    return Filter(lambda df: make(F.col(key)) if isinstance(_kind(df, key), T.StringType) else F.lit(False))


def glob_regex(pattern: str) -> str | None:
    """An anchored regular expression for a path glob; None if the pattern is malformed."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out.append(re.escape(pattern[i]))
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            out.append("[" + body.replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)\\A" + "".join(out) + "\\z"


def glob(key: str, pattern: str) -> Filter:
    regex = glob_regex(pattern)
    return _text(key, (lambda c: c.rlike(regex)) if regex else (lambda c: F.lit(False)))


def prefix(key: str, value: str) -> Filter:
    return _text(key, lambda c: c.startswith(value))


def suffix(key: str, value: str) -> Filter:
    return _text(key, lambda c: c.endswith(value))


def contains(key: str, value: str) -> Filter:
    return _text(key, lambda c: c.contains(value))


def exists(key: str) -> Filter:
    return Filter(lambda df: F.col(key).isNotNull() if key in df.columns else F.lit(False))


def exists_in(json_key: str, path: str) -> Filter:
    """Whether a JSON column has ``path``; a JSON null is there."""
    return Filter(lambda df: F.try_variant_get(F.try_parse_json(F.col(json_key)), path, "variant").isNotNull())


def all_of(*filters: Filter) -> Filter:
    return Filter(lambda df: reduce(and_, (f.safe(df) for f in filters), F.lit(True)))


def some_of(*filters: Filter) -> Filter:
    return Filter(lambda df: reduce(or_, (f.safe(df) for f in filters), F.lit(False)))


def negate(f: Filter) -> Filter:
    return Filter(lambda df: ~f.safe(df))


def _number(key: str, make: Callable[[Column], Column]) -> Filter:
    return Filter(lambda df: make(F.col(key).cast("double")) if isinstance(_kind(df, key), T.NumericType) else F.lit(False))


def gt(key: str, x: float) -> Filter:
    return _number(key, lambda c: c > x)


def gte(key: str, x: float) -> Filter:
    return _number(key, lambda c: c >= x)


def lt(key: str, x: float) -> Filter:
    return _number(key, lambda c: c < x)


def lte(key: str, x: float) -> Filter:
    return _number(key, lambda c: c <= x)


def between(key: str, low: float, high: float) -> Filter:
    return _number(key, lambda c: c.between(low, high))


def moment(t: datetime) -> Column:
    """A time without a zone: compared with times of a table as written, whatever the session's zone."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def after(column: str, t: datetime) -> Filter:
    """Strictly later; with ``created_at``, ``updated_at`` or ``last_accessed_at``; never accessed is false."""
    return Filter(lambda df: F.col(column) > moment(t))


def before(column: str, t: datetime) -> Filter:
    return Filter(lambda df: F.col(column) < moment(t))


def accessed_before(t: datetime) -> Filter:
    """Never accessed is true."""
    return Filter(lambda df: F.col("last_accessed_at") < moment(t), True)


def older_than(age: timedelta, now: datetime) -> Filter:
    return before("created_at", now - age)


def newer_than(age: timedelta, now: datetime) -> Filter:
    return after("created_at", now - age)


def not_expired(now: datetime) -> Filter:
    return Filter(lambda df: F.col("expires_at").isNull() | (F.col("expires_at") >= moment(now)))


def expired_before(t: datetime) -> Filter:
    return before("expires_at", t)


def has_ttl() -> Filter:
    return exists("expires_at")


def never_accessed() -> Filter:
    return Filter(lambda df: F.col("last_accessed_at").isNull())


def has_any_tag(key: str, *tags: str) -> Filter:
    return Filter(lambda df: F.arrays_overlap(F.col(key), F.array(*map(F.lit, tags))) if tags else F.lit(False))


def custom(make: Callable[[DataFrame], Column]) -> Filter:
    """Any boolean expression, a Python or pandas UDF's among them."""
    return Filter(make)


def parse_json(items: list[dict]) -> list[Filter]:
    """Filters from ``{key, op, value}`` objects; an unknown operation or an unfit value is ignored."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    text = lambda v: isinstance(v, str)
    table = {
        "eq": (equal, lambda v: True), "neq": (not_equal, lambda v: True), "gt": (gt, number), "gte": (gte, number), "lt": (lt, number),
        "lte": (lte, number), "glob": (glob, text), "prefix": (prefix, text), "suffix": (suffix, text), "contains": (contains, text),
    }
    out = []
    for item in items:
        op, value = item.get("op"), item.get("value")
        if op == "exists":
            out.append(exists(item["key"]))
        elif op in table and table[op][1](value):
            out.append(table[op][0](item["key"], value))
    return out


def parse_text(term: str) -> Filter:
    """A filter from ``key=value``: a glob if it has * or ?, else an integer, a number, or text."""
    key, sep, value = term.partition("=")
    if not sep:
        raise ValueError(f"not key=value: {term}")
    if "*" in value or "?" in value:
        return glob(key, value)
    for kind in (int, float):
        try:
            return equal(key, kind(value))
        except ValueError:
            continue
    return equal(key, value)


def matching(df: DataFrame, *filters: Filter) -> DataFrame:
    """Rows that pass all filters; no filters pass all rows."""
    for f in filters:
        df = df.where(f.top(df))
    return df
