"""Built-ins of the document language as column functions, with its indices (from 0) and its edge cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bound(i: Column | int, n: Column) -> Column:
    i = i if isinstance(i, Column) else F.lit(i)
    return F.when(i < 0, F.greatest(n + i, F.lit(0))).otherwise(F.least(i, n))


def char_at(s: Column, i: int) -> Column:
    return F.substring(s, i + 1, 1) if i >= 0 else F.lit("")


def at(s: Column, i: int) -> Column:
    return F.nullif(F.substring(s, i + 1 if i >= 0 else i, 1), F.lit(""))


def code_point_at(s: Column, i: int) -> Column:
    c = F.substring(s, i + 1, 1)
    return F.when(c != "", F.ascii(c))


def index_of(s: Column, part: str) -> Column:
    return F.instr(s, part) - 1


def last_index_of(s: Column, part: str) -> Column:
    back = F.instr(F.reverse(s), part[::-1])
    return F.when(back == 0, -1).otherwise(F.length(s) - back - len(part) + 1)


def slice_(s: Column, start: int, end: int | None = None) -> Column:
    """Negative places count from the end; nothing if they cross."""
    n = F.length(s)
    a, b = _bound(start, n), n if end is None else _bound(end, n)
    return F.substring(s, a + 1, F.greatest(b - a, F.lit(0)))


def substring(s: Column, start: int, end: int | None = None) -> Column:
    """Negative places are 0; crossed ones are swapped."""
    n = F.length(s)
    a, b = F.least(F.lit(max(start, 0)), n), n if end is None else F.least(F.lit(max(end, 0)), n)
    return F.substring(s, F.least(a, b) + 1, F.greatest(a, b) - F.least(a, b))


def to_upper_case(s: Column) -> Column:
    """ASCII letters only."""
    return F.translate(s, LOWER, UPPER)


def to_lower_case(s: Column) -> Column:
    """ASCII letters only."""
    return F.translate(s, UPPER, LOWER)


def pad_start(s: Column, n: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, fill))


def pad_end(s: Column, n: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, fill))


def replace_first(s: Column, part: str, by: str) -> Column:
    i = F.instr(s, part)
    return F.when(i == 0, s).otherwise(F.concat(F.substring(s, F.lit(1), i - 1), F.lit(by), F.substring(s, i + len(part), F.length(s))))


def replace_all(s: Column, part: str, by: str) -> Column:
    return F.replace(s, F.lit(part), F.lit(by))


def split(s: Column, part: str) -> Column:
    return F.split(s, "".join("\\" + c if not c.isalnum() else c for c in part))


def parse_int(s: Column) -> Column:
    """The integer a text begins with, after white space; null if it begins with none."""
    return F.try_to_number(F.nullif(F.regexp_extract(s, r"^\s*([+-]?\d{1,18})", 1), F.lit("")), F.lit("S999999999999999999")).cast("long")


def parse_float(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).cast("double")


def to_fixed(x: Column, n: int) -> Column:
    return F.format_string(f"%.{n}f", x.cast("double"))


def is_integer(x: Column) -> Column:
    return F.coalesce(x == F.floor(x), F.lit(False))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def trunc(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def round_(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5)


def number_text(x: Column) -> Column:
    """A number as the language prints it: no fraction on whole numbers, null for what is not finite."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(is_finite(x), F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))).otherwise("null")


def find(array: Column, test) -> Column:
    return F.get(F.filter(array, test), F.lit(0))


def find_index(array: Column, test) -> Column:
    marked = F.transform(array, lambda x, i: F.when(test(x), i))
    return F.coalesce(F.get(F.filter(marked, lambda i: i.isNotNull()), F.lit(0)), F.lit(-1))


def includes(array: Column, value) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def array_index_of(array: Column, value) -> Column:
    return F.coalesce(F.array_position(array, value), F.lit(0)) - 1


def array_slice(array: Column, start: int, end: int | None = None) -> Column:
    n = F.size(array)
    a, b = _bound(start, n), n if end is None else _bound(end, n)
    return F.slice(array, a + 1, F.greatest(b - a, F.lit(0)))


def reduce(array: Column, start: Column, step) -> Column:
    return F.aggregate(array, start, step)
