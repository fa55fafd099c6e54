"""The metadata filter language: strings or dicts are parsed to a tree, and the tree compiled to a Spark column.

Twelve operators: ``f=v`` / ``f:v``, ``!=``, ``>``, ``>=``, ``<``, ``<=``, ``f in [a,b]``, ``f not_in [a,b]``,
contains ``~``, starts with ``^``, ends with ``$``, exists ``f?``; stars in ``f:*v*`` mean contains, starts or ends.
``a,b`` and ``a AND b`` are conjunctions (commas divide only where no AND occurs), ``a OR b`` binds weaker.

Semantics are two-valued: a missing field fails every operator but ``!=`` and ``not_in``, which it passes. Equality
is strict about kinds (the string "100" is not the number 100); numbers compare as doubles. An ordering between
different kinds compares as equal, so >= and <= hold and > and < don't. JSON null exists and equals null.

Two bindings: ``Typed`` for tables whose metadata are columns (predicates stay simple, so they reach the Parquet
scan), and ``Json`` for a JSON string column, which is parsed to VARIANT and gated on the kind of the value.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "notin", "contains", "startswith", "endswith", "exists")


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


Tree = Condition | All | Either


class FilterError(ValueError):
    """Nothing of the filter can be understood, or with strict parsing some part of it."""


def parse_literal(text: str) -> Any:
    """Integer, finite number, boolean or string."""
    if re.fullmatch(r"[+-]?\d+", text) and -(2**63) <= int(text) < 2**63:
        return int(text)
    try:
        number = float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else math.nan
    except ValueError:
        number = math.nan
    if math.isfinite(number):
        return number
    return {"true": True, "false": False}.get(text, text)


def _in_list(text: str, word: str, op: str) -> Condition | None:
    field, _, rest = text.partition(f" {word} [")
    if not rest or not rest.rstrip().endswith("]"):
        return None
    inner = rest.rstrip()[:-1]
    return Condition(field.strip(), op, [parse_literal(v.strip()) for v in inner.split(",")])


def _starred(field: str, value: str) -> Condition:
    if len(value) > 2 and value.startswith("*") and value.endswith("*"):
        return Condition(field, "contains", value[1:-1])
    if value.startswith("*"):
        return Condition(field, "endswith", value[1:])
    if value.endswith("*"):
        return Condition(field, "startswith", value[:-1])
    return Condition(field, "eq", parse_literal(value))


def parse_condition(text: str) -> Condition | None:
    text = text.strip()
    if text.endswith("?"):
        return Condition(text[:-1], "exists")
    if " in [" in text:
        return _in_list(text, "in", "in")
    if " not_in [" in text:
        return _in_list(text, "not_in", "notin")
    for sign, op in (("~", "contains"), ("^", "startswith"), ("$", "endswith")):
        if sign in text and not (sign == "^" and ">=" in text):
            field, _, value = text.partition(sign)
            return Condition(field, op, value)
    for sign, op in (("!=", "ne"), (">=", "gte"), ("<=", "lte"), (">", "gt"), ("<", "lt"), ("=", "eq")):
        if sign in text:
            field, _, value = text.partition(sign)
            return Condition(field, op, parse_literal(value))
    if ":" in text:
        return _starred(*text.split(":", 1))
    return None


def _split_commas(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "[") - (ch == "]")
        if ch == "," and depth <= 0:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def parse(text: str, strict: bool = True) -> Tree:
    """The tree of a filter string. Without ``strict``, parts that cannot be understood are left out."""
    if not text.strip():
        raise FilterError("empty filter")

    def several(parts: list[str], one: Callable[[str], Tree | None], kind: type) -> Tree | None:
        trees = [one(p) for p in parts]
        if strict and None in trees:
            raise FilterError(f"cannot understand {parts[trees.index(None)]!r}")
        kept = tuple(t for t in trees if t is not None)
        return kept[0] if len(kept) == 1 else kind(kept) if kept else None

    def conjunction(part: str) -> Tree | None:
        return several(part.split(" AND ") if " AND " in part else _split_commas(part), parse_condition, All)

    tree = several(text.split(" OR "), conjunction, Either)
    if tree is None:
        raise FilterError(f"cannot understand {text!r}")
    return tree


def from_dict(data: dict) -> Tree:
    """The tree of the JSON form: {field, op, value}, {and: [...]} or {or: [...]}."""
    if "and" in data:
        return All(tuple(from_dict(x) for x in data["and"]))
    if "or" in data:
        return Either(tuple(from_dict(x) for x in data["or"]))
    if data.get("op") not in OPERATORS or "field" not in data:
        raise FilterError(f"cannot understand {json.dumps(data)}")
    return Condition(data["field"], data["op"], data.get("value"))


def _kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return {int: "number", float: "number", str: "string"}.get(type(value), "other")


class Typed:
    """Fields are columns of known type; a null is a missing field. Dots descend structs."""

    def __init__(self, df: DataFrame, fields: dict[str, str] | None = None):
        names = fields or {f.name: f.name for f in df.schema.fields}
        self.fields = {}
        for name, column in names.items():
            self._add(name, column, df.select(column).schema[0].dataType)

    def _add(self, name: str, path: str, kind: Any) -> None:
        if kind.typeName() == "struct":
            for f in kind.fields:
                self._add(f"{name}.{f.name}", f"{path}.{f.name}", f.dataType)
            return
        t = kind.typeName()
        self.fields[name] = path, "string" if t in ("string", "varchar", "char") else "bool" if t == "boolean" else "number" if t in ("byte", "short", "integer", "long", "float", "double", "decimal") else "other"

    def leaf(self, c: Condition) -> Column:
        if c.field not in self.fields:
            return F.lit(c.op in ("ne", "notin"))
        path, kind = self.fields[c.field]
        col = F.col(path)
        no = F.lit(False)

        def equal(v: Any) -> Column:
            if kind != _kind(v) or kind == "other":
                return no
            return col == F.lit(v)

        if c.op == "exists":
            return col.isNotNull()
        if c.op == "eq":
            return equal(c.value)
        if c.op == "ne":
            return col.isNull() | ~equal(c.value)
        if c.op in ("in", "notin"):
            values = c.value if isinstance(c.value, list) else []
            same = [v for v in values if kind == _kind(v) and kind != "other"]
            hit = col.isin(same) if same else no
            return hit if c.op == "in" else col.isNull() | ~hit
        if c.op in ("contains", "startswith", "endswith"):
            return getattr(col, c.op)(c.value) if kind == "string" and isinstance(c.value, str) else no
        if kind == _kind(c.value) and kind in ("number", "string"):
            return {"gt": col > F.lit(c.value), "gte": col >= F.lit(c.value), "lt": col < F.lit(c.value), "lte": col <= F.lit(c.value)}[c.op]
        return col.isNotNull() if c.op in ("gte", "lte") else no


class Json:
    """Fields are paths in a JSON string column. Broken JSON has no fields."""

    def __init__(self, column: str | Column):
        self.variant = F.try_parse_json(F.col(column) if isinstance(column, str) else column)

    def leaf(self, c: Condition) -> Column:
        keys = "".join(f"['{k}']" if '"' in k else f'["{k}"]' for k in c.field.split("."))
        value = F.try_variant_get(self.variant, "$" + keys, "variant")
        kind = F.schema_of_variant(value)
        missing = kind.isNull()
        number = F.coalesce(kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.lit(False))
        string = F.coalesce(kind == "STRING", F.lit(False))
        as_number = F.when(number, F.try_variant_get(value, "$", "double"))
        as_string = F.when(string, F.try_variant_get(value, "$", "string"))
        no = F.lit(False)

        def equal(v: Any) -> Column:
            k = _kind(v)
            if k == "number":
                return F.coalesce(F.abs(as_number - F.lit(float(v))) < EPSILON, no)
            if k == "string":
                return F.coalesce(as_string == F.lit(v), no)
            if k == "bool":
                return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(v)), no)
            return F.coalesce(kind == "VOID", no) if k == "null" else no

        if c.op == "exists":
            return ~missing
        if c.op == "eq":
            return equal(c.value)
        if c.op == "ne":
            return missing | ~equal(c.value)
        if c.op in ("in", "notin"):
            hits = reduce(lambda a, b: a | b, [equal(v) for v in c.value], no) if isinstance(c.value, list) else no
            return ~missing & hits if c.op == "in" else missing | ~hits
        if c.op in ("contains", "startswith", "endswith"):
            return F.coalesce(getattr(as_string, c.op)(c.value), no) if isinstance(c.value, str) else no
        k = _kind(c.value)
        own = as_number if k == "number" else as_string if k == "string" else F.lit(None).cast("string")
        than = F.lit(float(c.value)) if k == "number" else F.lit(c.value if k == "string" else "")
        sign = F.when(own.isNull(), 0).when(own < than, -1).when(own > than, 1).otherwise(0)
        return ~missing & {"gt": sign > 0, "gte": sign >= 0, "lt": sign < 0, "lte": sign <= 0}[c.op]


def compile_filter(tree: Tree | str | dict, binding: Typed | Json) -> Column:
    """A boolean column for ``where``; null counts as false there."""
    if isinstance(tree, str):
        tree = parse(tree)
    if isinstance(tree, dict):
        tree = from_dict(tree)
    if isinstance(tree, Condition):
        return binding.leaf(tree)
    parts = [compile_filter(t, binding) for t in tree.parts]
    if isinstance(tree, All):
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    return reduce(lambda a, b: a | b, parts, F.lit(False))
