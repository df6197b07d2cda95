"""Document filters, compiled to columns over a VARIANT record.

Comparisons are typed: a number never equals or exceeds a text, as in a typed store. Fields that are
columns of their own are compared as such, so their predicates reach the scan.
`$eq $lt $lte $in $nin $and $or $nor $not $all $size $elemMatch $regex $type $mod`, dotted paths and
null matching an absent field are not seen in use where the language is defined; they follow the
common convention. An unknown operator is an error, never an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A filter that cannot be compiled."""



Test = Callable[[Column], Column]


def _path(field: str) -> str:
    parts = field.split(".")
    if not all(parts):
        raise FilterError(f"bad field name {field!r}")
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)


def value_at(data: Column, field: str) -> Column:
    return F.try_variant_get(data, _path(field), "variant")


def class_of(v: Column) -> Column:
    """number, string, boolean, null, array or object; SQL null for an absent value."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.is_variant_null(v), "null")
        .when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(kind.startswith("STRING"), "string")
        .when(kind.startswith("BOOLEAN"), "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("other")
    )


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _scalar(v: Column, op: str, x: Any) -> Column:
    """One value against one literal of the same class."""
    if isinstance(x, bool):
        kind, typed = "boolean", F.try_variant_get(v, "$", "boolean")
    elif isinstance(x, (int, float)):
        kind, typed = "number", F.try_variant_get(v, "$", "double")
        x = float(x)
    elif isinstance(x, str):
        kind, typed = "string", F.try_variant_get(v, "$", "string")
    elif x is None:
        return F.is_variant_null(v) if op in ("==", ">=", "<=") else F.lit(False)
    else:
        if op != "==":
            raise FilterError(f"cannot order by {x!r}")
        return _sure(F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(x, ensure_ascii=False)))))
    ops = {"==": typed == x, ">": typed > x, ">=": typed >= x, "<": typed < x, "<=": typed <= x}
    return _sure((class_of(v) == kind) & ops[op])


def _any(v: Column, test: Test) -> Column:
    """The value passes, or one of its elements does."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return test(v) | _sure((class_of(v) == "array") & F.exists(items, test))


def _equal(v: Column, x: Any) -> Column:
    if x is None:
        return v.isNull() | _any(v, lambda e: _sure(F.is_variant_null(e)))
    return _any(v, lambda e: _scalar(e, "==", x))


def _compare(sign: str, x: Any) -> Test:
    return lambda e: _scalar(e, sign, x)


def _matches(pattern: str) -> Test:
    return lambda e: _sure((class_of(e) == "string") & F.try_variant_get(e, "$", "string").rlike(pattern))


def _leaves(x: list) -> Test:
    return lambda e: _sure((class_of(e) == "number") & (F.try_variant_get(e, "$", "double") % x[0] == x[1]))


def _element(x: dict) -> Test:
    return (lambda e: _field(e, x)) if any(k.startswith("$") for k in x) else (lambda e: compile_filter(x, e, {}))


def _field(v: Column, condition: Any) -> Column:
    if not (isinstance(condition, dict) and any(k.startswith("$") for k in condition)):
        return _sure(_equal(v, condition))
    tests = []
    for op, x in condition.items():
        if op in ("$gt", "$gte", "$lt", "$lte"):
            sign = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}[op]
            tests.append(_any(v, _compare(sign, x)))
        elif op == "$eq":
            tests.append(_equal(v, x))
        elif op == "$ne":
            tests.append(~_sure(_equal(v, x)))
        elif op in ("$in", "$nin"):
            hit = reduce(lambda a, b: a | b, [_sure(_equal(v, y)) for y in x], F.lit(False))
            tests.append(hit if op == "$in" else ~hit)
        elif op == "$exists":
            tests.append(v.isNotNull() if x else v.isNull())
        elif op == "$not":
            tests.append(~_field(v, x))
        elif op == "$all":
            tests.append(reduce(lambda a, b: a & b, [_sure(_equal(v, y)) for y in x], F.lit(bool(x))))
        elif op == "$size":
            tests.append((class_of(v) == "array") & (F.size(F.try_variant_get(v, "$", "array<variant>")) == int(x)))
        elif op == "$elemMatch":
            items = F.try_variant_get(v, "$", "array<variant>")
            inner = _element(x)
            tests.append((class_of(v) == "array") & F.exists(items, inner))
        elif op == "$regex":
            tests.append(_any(v, _matches(x)))
        elif op == "$type":
            tests.append(class_of(v) == {"bool": "boolean", "int": "number", "long": "number", "double": "number"}.get(x, x))
        elif op == "$mod":
            tests.append(_any(v, _leaves(x)))
        else:
            raise FilterError(f"unknown operator {op}")
    return reduce(lambda a, b: a & b, [_sure(t) for t in tests])


def _column(c: Column, kind: str, condition: Any) -> Column | None:
    """A condition on a plain column, or None where the record has to be asked."""
    plain = {"string": str, "bigint": (int, float), "int": (int, float), "double": (int, float), "boolean": bool}.get(kind)
    fits = lambda x: plain is not None and isinstance(x, plain) and not (isinstance(x, bool) and kind != "boolean")
    if kind == "array<string>":
        return _sure(F.array_contains(c, condition)) if isinstance(condition, str) else None
    if fits(condition):
        return _sure(c == condition)
    if isinstance(condition, dict) and condition and set(condition) <= {"$gt", "$gte", "$lt", "$lte", "$eq", "$exists", "$in"}:
        tests = []
        for op, x in condition.items():
            if op == "$exists":
                tests.append(c.isNotNull() if x else c.isNull())
            elif op == "$in" and all(map(fits, x)):
                tests.append(c.isin(list(x)))
            elif op != "$in" and fits(x):
                tests.append({"$gt": c > x, "$gte": c >= x, "$lt": c < x, "$lte": c <= x, "$eq": c == x}[op])
            else:
                return None
        return reduce(lambda a, b: a & b, [_sure(t) for t in tests])
    return None


def compile_filter(query: dict | None, data: Column, columns: dict[str, tuple[Column, str]]) -> Column:
    """A boolean column, never null. columns: fields that are columns, with their types."""
    if query is None:
        return F.lit(True)
    if not isinstance(query, dict):
        raise FilterError("a filter is a mapping")
    tests = []
    for key, condition in query.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(condition, list) or not condition:
                raise FilterError(f"{key} takes a list")
            inner = [compile_filter(q, data, columns) for q in condition]
            joined = reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), inner)
            tests.append(~joined if key == "$nor" else joined)
        elif key.startswith("$"):
            raise FilterError(f"unknown operator {key}")
        else:
            found = _column(*columns[key], condition) if key in columns else None
            tests.append(found if found is not None else _field(value_at(data, key), condition))
    return reduce(lambda a, b: a & b, tests, F.lit(True))
