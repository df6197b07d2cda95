"""Values and built-ins of the document language. Members are looked up in the tables below and in
plain mappings, never on Python objects, so a program reaches nothing that is not listed here."""

from __future__ import annotations

import json
import math
import random
import re
import time
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta
from functools import cmp_to_key
from typing import Any

try:
    import regex as engine
except ModuleNotFoundError:
    engine = re

#: Items of an array and characters of a text at most; seconds that one search may take.
ITEMS, LETTERS, SEARCH_S = 10_000_000, 100_000_000, 1.0


class ScriptError(ValueError):
    """A program that cannot be read, or that failed."""


class Undefined:
    def __repr__(self):
        return "undefined"

    def __bool__(self):
        return False

    def __reduce__(self):
        return "UNDEFINED"


UNDEFINED = Undefined()


class Thrown(Exception):
    """A value that the program threw."""

    def __init__(self, value):
        self.value = value


class Function:
    """Something that can be called; `make` is what `new` calls, `members` are its statics."""

    __slots__ = ("call", "make", "members")

    def __init__(self, call: Callable, make: Callable | None = None, members: dict | None = None):
        self.call, self.make, self.members = call, make, members or {}

    def __call__(self, *args):
        return self.call(*args)


class Date:
    def __init__(self, ms: float):
        self.ms = ms


class RegExp:
    def __init__(self, source: str, flags: str = ""):
        if set(flags) - set("dgimsuy"):
            raise Thrown(error("SyntaxError", "unknown flags"))
        self.source, self.flags, self.last = source, flags, 0
        python = re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", source)
        python = re.sub(r"\\k<(\w+)>", r"(?P=\1)", python).replace("\\/", "/")
        python = re.sub(r"\\u\{?([0-9a-fA-F]{4,6})\}?", lambda m: re.escape(chr(int(m[1], 16))), python)
        python = re.sub(r"(?<!\\)\$(?=$|\))", r"\\Z" if "m" not in flags else "$", python)
        python = re.sub(r"(?<!\\)\\d", "[0-9]", python)
        mode = (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0) | (re.S if "s" in flags else 0)
        try:
            self.pattern = engine.compile(python, mode)
        except engine.error as e:
            raise Thrown(error("SyntaxError", f"invalid regular expression: {e}")) from None

    def at(self, text: str, start: int = 0, whole: bool = False):
        limit = {"timeout": SEARCH_S} if engine is not re else {}
        try:
            return (self.pattern.match if whole or "y" in self.flags else self.pattern.search)(text, start, **limit)
        except TimeoutError:
            raise ScriptError("a regular expression takes too long") from None

    def every(self, text: str) -> Iterable:
        at = 0
        while at <= len(text) and (m := self.at(text, at)):
            yield m
            at = m.end() + (m.end() == m.start())


def error(kind: str, message: str) -> dict:
    return {"name": kind, "message": message}


def fail(kind: str, message: str):
    raise Thrown(error(kind, message))


# --- conversions


def truthy(x) -> bool:
    if isinstance(x, (list, dict, Function, Date, RegExp, Bag)):
        return True
    return bool(x) and x == x  # noqa: PLR0124 - not a number is false


def number_of(text: str):
    low = text.strip().lower()
    if re.fullmatch(r"0[xob][0-9a-f]+", low):
        return int(low, 0)
    if re.fullmatch(r"[+-]?\d+", low):
        return norm(int(low))
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", low):
        return float(low)
    return {"": 0, "infinity": math.inf, "+infinity": math.inf, "-infinity": -math.inf}.get(low, math.nan) if text.strip() in ("", "Infinity", "+Infinity", "-Infinity") else math.nan


def number(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, (int, float)):
        return x
    if x is None:
        return 0
    if isinstance(x, str):
        return number_of(x)
    if isinstance(x, Date):
        return x.ms
    if isinstance(x, list):
        return number_of(text(x))
    return math.nan


def norm(x):
    """Whole numbers past 2^53 are as exact as a double is."""
    return float(x) if isinstance(x, int) and not isinstance(x, bool) and abs(x) > 2**53 else x


def int32(x) -> int:
    x = number(x)
    if x != x or x in (math.inf, -math.inf):
        return 0
    x = int(x) & 0xFFFFFFFF
    return x - (1 << 32) if x >> 31 else x


def whole(x, default: int = 0) -> int:
    if x is UNDEFINED:
        return default
    x = number(x)
    return 0 if x != x else int(max(min(x, 2**53), -(2**53)))


def number_text(x) -> str:
    if isinstance(x, int):
        return str(x)
    if x != x:
        return "NaN"
    if x in (math.inf, -math.inf):
        return "Infinity" if x > 0 else "-Infinity"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, power = repr(abs(x)).partition("e")
    sign = "-" if x < 0 else ""
    if power:
        e = int(power)
        if -7 < e < 0:
            return sign + "0." + "0" * (-e - 1) + digits.replace(".", "")
        return f"{sign}{digits.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + digits


def text(x) -> str:
    if isinstance(x, str):
        return x
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return number_text(x)
    if x is None:
        return "null"
    if x is UNDEFINED:
        return "undefined"
    if isinstance(x, list):
        return ",".join("" if v is None or v is UNDEFINED else text(v) for v in x)
    if isinstance(x, Date):
        return date_text(x, "%a %b %d %Y %H:%M:%S GMT+0000 (Coordinated Universal Time)")
    if isinstance(x, RegExp):
        return f"/{x.source}/{x.flags}"
    if isinstance(x, dict) and {"name", "message"} == x.keys():
        return f"{text(x['name'])}: {text(x['message'])}"
    return "function" if isinstance(x, Function) else "[object Object]"


def shown(x) -> str:
    """A value in a document's content: nothing for null and undefined."""
    return "" if x is None or x is UNDEFINED else text(x)


def typeof(x) -> str:
    if x is UNDEFINED:
        return "undefined"
    return "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "function" if isinstance(x, Function) else "object"


def same(a, b) -> bool:
    """Strict equality."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) or isinstance(a, str) and isinstance(b, str):
        return a == b
    return a is b


def alike(a, b) -> bool:
    """Equality after conversion."""
    if a is None or a is UNDEFINED or b is None or b is UNDEFINED:
        return (a is None or a is UNDEFINED) and (b is None or b is UNDEFINED)
    if typeof(a) == typeof(b):
        return same(a, b)
    if isinstance(a, (list, dict, Date)) != isinstance(b, (list, dict, Date)):
        a, b = (text(a), b) if isinstance(a, (list, dict, Date)) else (a, text(b))
        if isinstance(a, str) and isinstance(b, str):
            return a == b
    return number(a) == number(b)


def operate(op: str, a, b):
    if op == "+":
        if isinstance(a, (str, list, dict, Date, Function)) or isinstance(b, (str, list, dict, Date, Function)):
            out = text(a) + text(b)
            if len(out) > LETTERS:
                raise ScriptError("a text is too long")
            return out
        return norm(number(a) + number(b))
    if op == "===":
        return same(a, b)
    if op == "!==":
        return not same(a, b)
    if op == "==":
        return alike(a, b)
    if op == "!=":
        return not alike(a, b)
    if op in ("<", ">", "<=", ">="):
        if not (isinstance(a, str) and isinstance(b, str)):
            a, b = number(a), number(b)
        return a < b if op == "<" else a > b if op == ">" else a <= b if op == "<=" else a >= b
    if op == "in":
        return text(a) in b if isinstance(b, dict) else isinstance(b, list) and 0 <= whole(a) < len(b)
    if op == "instanceof":
        kinds = {"Array": list, "Date": Date, "RegExp": RegExp, "Map": Map, "Set": Set, "Object": (dict, list, Date, RegExp, Bag)}
        return any(b is GLOBALS[k] and isinstance(a, t) for k, t in kinds.items())
    x, y = number(a), number(b)
    if op == "-":
        return norm(x - y)
    if op == "*":
        return norm(x * y)
    if op == "/":
        if y == 0:
            return math.nan if x == 0 or x != x else math.copysign(math.inf, x) * math.copysign(1, y)
        return x // y if isinstance(x, int) and isinstance(y, int) and x % y == 0 else x / y
    if op == "%":
        if y == 0 or x != x or y != y or abs(x) == math.inf:
            return math.nan
        return int(math.fmod(x, y)) if isinstance(x, int) and isinstance(y, int) else math.fmod(x, y)
    if op == "**":
        return power(x, y)
    bits = {"|": lambda: int32(x) | int32(y), "&": lambda: int32(x) & int32(y), "^": lambda: int32(x) ^ int32(y), "<<": lambda: int32(int32(x) << (int32(y) & 31)), ">>": lambda: int32(x) >> (int32(y) & 31), ">>>": lambda: (int32(x) & 0xFFFFFFFF) >> (int32(y) & 31)}
    return bits[op]()


def power(x, y):
    try:
        out = float(x) ** float(y)
    except (OverflowError, ZeroDivisionError):
        return math.inf
    if isinstance(out, complex):
        return math.nan
    return int(out) if isinstance(x, int) and isinstance(y, int) and y >= 0 and abs(out) <= 2**53 else out


# --- keyed collections


def _key(x):
    return (typeof(x), x) if isinstance(x, (str, int, float, bool)) and x == x else ("nan",) if isinstance(x, float) else ("id", id(x))


class Bag:
    """Keys in the order they came; a key is told apart as by strict equality."""

    def __init__(self):
        self.items: dict = {}

    def has(self, k) -> bool:
        return _key(k) in self.items

    def put(self, k, v):
        old = self.items.get(_key(k))
        self.items[_key(k)] = (old[0] if old else k, v)
        return self

    def drop(self, k) -> bool:
        return self.items.pop(_key(k), None) is not None


class Map(Bag):
    pass


class Set(Bag):
    pass


def iterate(x) -> Iterable:
    if isinstance(x, (list, str)):
        return x
    if isinstance(x, Set):
        return [k for k, _ in x.items.values()]
    if isinstance(x, Map):
        return [[k, v] for k, v in x.items.values()]
    return fail("TypeError", f"{text(x)} is not iterable")


# --- members


def member(x, key):
    if isinstance(x, dict):
        found = x.get(key if isinstance(key, str) else text(key), UNDEFINED)
        return found if found is not UNDEFINED else OBJECT.get(key, UNDEFINED) and method(x, key) if isinstance(key, str) else UNDEFINED
    if isinstance(x, (list, str)):
        if isinstance(key, (int, float)) and not isinstance(key, bool):
            return x[int(key)] if key == key and key == int(key) and 0 <= key < len(x) else UNDEFINED
        if key == "length":
            return len(x)
        if isinstance(key, str) and key.isdigit():
            return member(x, int(key))
        return method(x, key)
    if x is None or x is UNDEFINED:
        return fail("TypeError", f"cannot read {text(key)} of {text(x)}")
    if isinstance(x, Bag) and key == "size":
        return len(x.items)
    if isinstance(x, RegExp) and key in ("source", "flags", "lastIndex", "global"):
        return {"source": x.source, "flags": x.flags, "lastIndex": x.last, "global": "g" in x.flags}[key]
    if isinstance(x, Function):
        return x.members.get(key, UNDEFINED)
    return method(x, key)


def method(x, key):
    """What a call of x[key] calls."""
    if isinstance(x, dict) and key in x:
        return x[key]
    if x is None or x is UNDEFINED:
        return fail("TypeError", f"cannot read {text(key)} of {text(x)}")
    if isinstance(x, Function):
        return x.members.get(key, UNDEFINED)
    table = TEXT if isinstance(x, str) else NUMBER if isinstance(x, (int, float)) else ARRAY if isinstance(x, list) else MAP if isinstance(x, Map) else SET if isinstance(x, Set) else DATE if isinstance(x, Date) else REGEXP if isinstance(x, RegExp) else OBJECT
    found = table.get(key) if isinstance(key, str) else None
    if found is None:
        return member(x, key) if isinstance(x, (list, str)) and not isinstance(key, str) else UNDEFINED
    return Function(lambda *args: found(x, *args))


def assign(x, key, value):
    if isinstance(x, dict):
        x[text(key)] = value
    elif isinstance(x, list):
        n = whole(key)
        if key == "length":
            n = whole(value)
            if n > ITEMS:
                fail("RangeError", "invalid array length")
            x[:] = x[:n] + [UNDEFINED] * (n - len(x))
        elif n > ITEMS:
            fail("RangeError", "invalid array length")
        elif 0 <= n < len(x):
            x[n] = value
        else:
            x.extend([UNDEFINED] * (n - len(x)))
            x.append(value)
    elif isinstance(x, RegExp) and key == "lastIndex":
        x.last = whole(value)
    else:
        fail("TypeError", f"cannot set {text(key)} of {text(x)}")


def delete(x, key) -> bool:
    if isinstance(x, dict):
        x.pop(text(key), None)
    return True


def construct(f, args: list):
    if not isinstance(f, Function):
        fail("TypeError", "this is no constructor")
    return (f.make or f.call)(*args)


def arg(args: tuple, i: int, default: Any = UNDEFINED):
    return args[i] if len(args) > i else default


def bounds(n: int, args: tuple) -> tuple[int, int]:
    """slice's ends: negative ones count from the end."""
    a, b = whole(arg(args, 0)), whole(arg(args, 1), n)
    return (max(n + a, 0) if a < 0 else min(a, n)), (max(n + b, 0) if b < 0 else min(b, n))


# --- texts

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\r\v\f\xa0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def match_value(m) -> list | None:
    if not m:
        return None
    return [UNDEFINED if g is None else g for g in (m[0], *m.groups())]


def match_record(m, whole_text: str):
    if not m:
        return None
    names = {k: UNDEFINED if v is None else v for k, v in m.groupdict().items()}
    out = {str(i): v for i, v in enumerate(match_value(m))} | {"index": m.start(), "input": whole_text, "length": len(m.groups()) + 1, "groups": names or UNDEFINED}
    out["indices"] = [[*m.span(i)] for i in range(len(m.groups()) + 1)]
    return out


def expanded(by: str, m, s: str) -> str:
    def one(x):
        k = x[1]
        if k == "$":
            return "$"
        if k == "&":
            return m[0]
        if k in "`'":
            return s[: m.start()] if k == "`" else s[m.end() :]
        if k[0] == "<":
            return m.groupdict().get(k[1:-1]) or ""
        return (m[int(k)] or "") if int(k) <= len(m.groups()) else x[0]

    return re.sub(r"\$(\$|&|`|'|<\w+>|[1-9]\d?)", one, by)


def replaced(s: str, what, by, every: bool) -> str:
    out, at = [], 0
    if isinstance(what, RegExp):
        found = list(what.every(s)) if "g" in what.flags or every else [m for m in [what.at(s)] if m]
    else:
        found = list(engine.finditer(re.escape(text(what)), s))
        found = found if every else found[:1]
    for m in found:
        out.append(s[at : m.start()])
        out.append(text(by(*match_value(m), m.start(), s)) if isinstance(by, Function) else expanded(text(by), m, s))
        at = m.end()
    return "".join([*out, s[at:]])


def split(s: str, by=UNDEFINED, *_) -> list:
    if by is UNDEFINED:
        return [s]
    if isinstance(by, RegExp):
        out, at = [], 0
        for m in by.every(s):
            if m.end() == m.start() and (m.start() == 0 or m.start() == len(s)):
                continue
            out += [s[at : m.start()], *match_value(m)[1:]]
            at = m.end()
        return [*out, s[at:]]
    by = text(by)
    return s.split(by) if by else list(s)


def matched(s: str, what=UNDEFINED, *_):
    r = what if isinstance(what, RegExp) else RegExp("" if what is UNDEFINED else text(what))
    if "g" in r.flags:
        return [m[0] for m in r.every(s)] or None
    return match_record(r.at(s), s)


def pad(s: str, n, by, left: bool) -> str:
    n, by = whole(n), " " if by is UNDEFINED else text(by)
    if n > LETTERS:
        raise ScriptError("a text is too long")
    fill = (by * ((n - len(s)) // len(by) + 1))[: n - len(s)] if n > len(s) and by else ""
    return fill + s if left else s + fill


def substring(s: str, *args) -> str:
    a, b = (max(0, min(len(s), x)) for x in (whole(arg(args, 0)), whole(arg(args, 1), len(s))))
    return s[min(a, b) : max(a, b)]


def substr(s: str, *args) -> str:
    a = whole(arg(args, 0))
    a = max(len(s) + a, 0) if a < 0 else a
    return s[a : a + max(0, whole(arg(args, 1), len(s)))]


def repeat(s: str, n=0) -> str:
    n = whole(n)
    if n < 0 or n * len(s) > LETTERS:
        fail("RangeError", "invalid count")
    return s * n


def char(s: str, i) -> str:
    return s[whole(i)] if 0 <= whole(i) < len(s) else ""


TEXT: dict[str, Callable] = {
    "charAt": lambda s, i=0, *_: char(s, i),
    "charCodeAt": lambda s, i=0, *_: ord(char(s, i)) if char(s, i) else math.nan,
    "codePointAt": lambda s, i=0, *_: ord(char(s, i)) if char(s, i) else UNDEFINED,
    "at": lambda s, i=0, *_: s[whole(i)] if -len(s) <= whole(i) < len(s) else UNDEFINED,
    "indexOf": lambda s, x="undefined", a=0, *_: s.find(text(x), max(whole(a), 0)),
    "lastIndexOf": lambda s, x="undefined", a=UNDEFINED, *_: s.rfind(text(x), 0, len(s) if a is UNDEFINED else max(whole(a), 0) + len(text(x))),
    "includes": lambda s, x="undefined", a=0, *_: s.find(text(x), max(whole(a), 0)) >= 0,
    "startsWith": lambda s, x="undefined", a=0, *_: s.startswith(text(x), max(whole(a), 0)),
    "endsWith": lambda s, x="undefined", a=UNDEFINED, *_: s[: whole(a, len(s))].endswith(text(x)),
    "slice": lambda s, *args: s[slice(*bounds(len(s), args))],
    "substring": substring,
    "substr": substr,
    "toUpperCase": lambda s, *_: s.translate(str.maketrans(_LOW, _UP)),
    "toLowerCase": lambda s, *_: s.translate(str.maketrans(_UP, _LOW)),
    "trim": lambda s, *_: s.strip(_SPACE),
    "trimStart": lambda s, *_: s.lstrip(_SPACE),
    "trimEnd": lambda s, *_: s.rstrip(_SPACE),
    "repeat": lambda s, n=0, *_: repeat(s, n),
    "padStart": lambda s, n=0, by=UNDEFINED, *_: pad(s, n, by, True),
    "padEnd": lambda s, n=0, by=UNDEFINED, *_: pad(s, n, by, False),
    "replace": lambda s, what="undefined", by="undefined", *_: replaced(s, what, by, False),
    "replaceAll": lambda s, what="undefined", by="undefined", *_: replaced(s, what, by, True),
    "split": split,
    "concat": lambda s, *xs: s + "".join(map(text, xs)),
    "match": matched,
    "matchAll": lambda s, r=UNDEFINED, *_: [match_record(m, s) for m in (r if isinstance(r, RegExp) else RegExp(text(r), "g")).every(s)],
    "search": lambda s, r=UNDEFINED, *_: m.start() if (m := (r if isinstance(r, RegExp) else RegExp(text(r))).at(s)) else -1,
    "toString": lambda s, *_: s,
    "valueOf": lambda s, *_: s,
}

# --- numbers


def to_fixed(x, n=0, *_) -> str:
    if x != x or abs(x) >= 1e21:
        return number_text(x)
    from decimal import ROUND_HALF_UP, Decimal

    exact = Decimal(x).quantize(Decimal(1).scaleb(-whole(n)), rounding=ROUND_HALF_UP)
    return f"{exact:f}"


def in_base(x, base=10, *_) -> str:
    base = whole(base, 10)
    if base == 10 or x != x or abs(x) == math.inf:
        return number_text(x)
    if not 2 <= base <= 36:
        fail("RangeError", "the base must be 2 to 36")
    digits, n, out = "0123456789abcdefghijklmnopqrstuvwxyz", abs(int(x)), ""
    part = abs(x) - n
    while n:
        out, n = digits[n % base] + out, n // base
    out = ("-" if x < 0 else "") + (out or "0")
    if part:
        out += "."
        for _i in range(52):
            part *= base
            out += digits[int(part)]
            part -= int(part)
            if not part:
                break
    return out


def parse_int(x=UNDEFINED, base=UNDEFINED, *_):
    s, base = text(x).strip(_SPACE), whole(base)
    sign = -1 if s[:1] == "-" else 1
    s = s[1:] if s[:1] in "+-" else s
    if base in (0, 16) and s[:2].lower() == "0x":
        s, base = s[2:], 16
    base = base or 10
    if not 2 <= base <= 36:
        return math.nan
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    found = re.match(f"[{digits}]*", s, re.I)[0]
    return norm(sign * int(found, base)) if found else math.nan


def parse_float(x=UNDEFINED, *_):
    m = re.match(r"[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", text(x).strip(_SPACE))
    return number_of(m[0]) if m else math.nan


def is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def is_finite(x) -> bool:
    return is_number(x) and x == x and abs(x) != math.inf


NUMBER: dict[str, Callable] = {"toFixed": to_fixed, "toString": in_base, "valueOf": lambda x, *_: x}

# --- arrays


def truthy_call(f, *args) -> bool:
    return truthy(f(*args))


def flat(xs: list, depth=1, *_) -> list:
    out: list = []
    for x in xs:
        out.extend(flat(x, number(depth) - 1) if isinstance(x, list) and number(depth) >= 1 else [x])
    return out


def array_sort(xs: list, f=UNDEFINED, *_) -> list:
    def order(a, b):
        if a is UNDEFINED or b is UNDEFINED:
            return (a is UNDEFINED) - (b is UNDEFINED)
        if isinstance(f, Function):
            x = number(f(a, b))
            return (x > 0) - (x < 0)
        a, b = text(a), text(b)
        return (a > b) - (a < b)

    xs.sort(key=cmp_to_key(order))
    return xs


def array_reduce(xs: list, f, *start):
    items = list(enumerate(xs))
    if start:
        out = start[0]
    elif items:
        out = items.pop(0)[1]
    else:
        return fail("TypeError", "reduce of an empty array without a start")
    for i, x in items:
        out = f(out, x, i, xs)
    return out


def array_push(xs: list, *args):
    if len(xs) + len(args) > ITEMS:
        fail("RangeError", "invalid array length")
    xs.extend(args)
    return len(xs)


def array_unshift(xs: list, *args):
    xs[:0] = args
    return len(xs)


def splice(xs: list, *args) -> list:
    a = bounds(len(xs), args[:1])[0]
    n = max(0, min(len(xs) - a, whole(arg(args, 1), len(xs))))
    gone, xs[a : a + n] = xs[a : a + n], args[2:]
    return gone


def filled(xs: list, value=UNDEFINED, *args) -> list:
    a, b = bounds(len(xs), args)
    xs[a:b] = [value] * max(0, b - a)
    return xs


def seek(xs: list, x, found) -> int:
    return next((i for i in found if same(xs[i], x)), -1)


ARRAY: dict[str, Callable] = {
    "push": array_push,
    "pop": lambda xs, *_: xs.pop() if xs else UNDEFINED,
    "shift": lambda xs, *_: xs.pop(0) if xs else UNDEFINED,
    "unshift": array_unshift,
    "splice": splice,
    "at": lambda xs, i=0, *_: xs[whole(i)] if -len(xs) <= whole(i) < len(xs) else UNDEFINED,
    "indexOf": lambda xs, x=UNDEFINED, *_: seek(xs, x, range(len(xs))),
    "lastIndexOf": lambda xs, x=UNDEFINED, *_: seek(xs, x, range(len(xs) - 1, -1, -1)),
    "includes": lambda xs, x=UNDEFINED, *_: any(same(x, y) or x != x and y != y for y in xs),
    "slice": lambda xs, *args: xs[slice(*bounds(len(xs), args))],
    "join": lambda xs, by=UNDEFINED, *_: ("," if by is UNDEFINED else text(by)).join(shown(x) for x in xs),
    "reverse": lambda xs, *_: xs.reverse() or xs,
    "fill": filled,
    "concat": lambda xs, *more: [*xs, *(y for m in more for y in (m if isinstance(m, list) else [m]))],
    "map": lambda xs, f, *_: [f(x, i, xs) for i, x in enumerate(xs)],
    "filter": lambda xs, f, *_: [x for i, x in enumerate(xs) if truthy_call(f, x, i, xs)],
    "forEach": lambda xs, f, *_: ([f(x, i, xs) for i, x in enumerate(xs)], UNDEFINED)[1],
    "some": lambda xs, f, *_: any(truthy_call(f, x, i, xs) for i, x in enumerate(xs)),
    "every": lambda xs, f, *_: all(truthy_call(f, x, i, xs) for i, x in enumerate(xs)),
    "find": lambda xs, f, *_: next((x for i, x in enumerate(xs) if truthy_call(f, x, i, xs)), UNDEFINED),
    "findIndex": lambda xs, f, *_: next((i for i, x in enumerate(xs) if truthy_call(f, x, i, xs)), -1),
    "reduce": array_reduce,
    "sort": array_sort,
    "flat": flat,
    "toString": lambda xs, *_: text(xs),
}

# --- objects, maps, sets


def bag(kind, items=UNDEFINED, *_):
    out = kind()
    for x in iterate(items) if items is not UNDEFINED and items is not None else ():
        out.put(x[0], arg(tuple(x), 1)) if kind is Map else out.put(x, x)
    return out


OBJECT: dict[str, Callable] = {"hasOwnProperty": lambda x, k=UNDEFINED, *_: isinstance(x, dict) and text(k) in x, "toString": lambda x, *_: text(x), "valueOf": lambda x, *_: x}
_BAG: dict[str, Callable] = {"has": lambda b, k=UNDEFINED, *_: b.has(k), "delete": lambda b, k=UNDEFINED, *_: b.drop(k), "clear": lambda b, *_: (b.items.clear(), UNDEFINED)[1], "forEach": lambda b, f, *_: ([f(v, k, b) for k, v in list(b.items.values())], UNDEFINED)[1], "values": lambda b, *_: [v for _k, v in b.items.values()], "keys": lambda b, *_: [k for k, _v in b.items.values()], "entries": lambda b, *_: [[k, v] for k, v in b.items.values()]}
MAP = _BAG | {"set": lambda b, k=UNDEFINED, v=UNDEFINED, *_: b.put(k, v), "get": lambda b, k=UNDEFINED, *_: b.items.get(_key(k), (None, UNDEFINED))[1]}
SET = _BAG | {"add": lambda b, k=UNDEFINED, *_: b.put(k, k)}


def entries_of(x) -> list:
    return [[k, v] for k, v in x.items()] if isinstance(x, dict) else [[str(i), v] for i, v in enumerate(x)] if isinstance(x, (list, str)) else []


def merged(x, *more):
    for m in more:
        x.update({k: v for k, v in entries_of(m)})
    return x


# --- JSON


def plain(x):
    """A value as JSON has it; UNDEFINED for what JSON leaves out."""
    if isinstance(x, Date):
        return iso(x)
    if isinstance(x, dict):
        return {k: p for k, v in x.items() if (p := plain(v)) is not UNDEFINED}
    if isinstance(x, list):
        return [None if (p := plain(v)) is UNDEFINED else p for v in x]
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float)):
        if x != x or abs(x) == math.inf:
            return None
        return int(x) if x == int(x) and abs(x) < 1e21 else x
    return {} if isinstance(x, (Bag, RegExp)) else UNDEFINED


def stringify(x=UNDEFINED, pick=None, indent=UNDEFINED, *_):
    if isinstance(pick, Function):
        def walk(holder, key, v):
            v = pick(key, v)
            return {k: walk(v, k, y) for k, y in v.items()} if isinstance(v, dict) else [walk(v, str(i), y) for i, y in enumerate(v)] if isinstance(v, list) else v

        x = walk({"": x}, "", x)
    elif isinstance(pick, list):
        def chosen(v):
            return {text(k): chosen(v[text(k)]) for k in pick if text(k) in v} if isinstance(v, dict) else [chosen(y) for y in v] if isinstance(v, list) else v

        x = chosen(x)
    p = plain(x)
    if p is UNDEFINED:
        return UNDEFINED
    space = " " * min(10, whole(indent)) if is_number(indent) else text(indent)[:10] if isinstance(indent, str) else ""
    if space:
        return json.dumps(p, ensure_ascii=False, indent=space)
    return json.dumps(p, ensure_ascii=False, separators=(",", ":"))


def parse_json(s=UNDEFINED, *_):
    def no(x):
        raise ValueError(x)

    try:
        return json.loads(text(s), parse_constant=no)
    except (ValueError, RecursionError) as e:
        return fail("SyntaxError", f"not JSON: {e}")


# --- dates (UTC alone)

_EPOCH = datetime(1970, 1, 1)


def moment(d: Date) -> datetime | None:
    try:
        return _EPOCH + timedelta(milliseconds=math.floor(d.ms)) if d.ms == d.ms else None
    except OverflowError:
        return None


def ms_of(year, month=0, day=1, hour=0, minute=0, second=0, ms=0) -> float:
    """Parts may overflow; they carry over."""
    parts = [number(p) for p in (year, month, day, hour, minute, second, ms)]
    if any(p != p or abs(p) > 1e9 for p in parts):
        return math.nan
    y, mo, d, h, mi, s, z = map(int, parts)
    y, mo = y + mo // 12, mo % 12
    if not 1 <= y <= 9999:
        return math.nan
    days = (datetime(y, mo + 1, 1) - _EPOCH).days + d - 1
    return ((days * 24 + h) * 60 + mi) * 60_000 + s * 1000 + z


def parse_date(s=UNDEFINED, *_):
    m = re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,3})\d*)?)?(Z|[+-]\d\d:?\d\d)?)?)?)?", text(s).strip())
    if not m or m[2] and not 1 <= int(m[2]) <= 12 or m[3] and not 1 <= int(m[3]) <= 31 or m[4] and int(m[4]) > 24:
        return math.nan
    ms = ms_of(int(m[1]), int(m[2] or 1) - 1, int(m[3] or 1), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0), int((m[7] or "0").ljust(3, "0")))
    if m[8] and m[8] != "Z":
        ms -= (1 if m[8][0] == "+" else -1) * (int(m[8][1:3]) * 60 + int(m[8][-2:])) * 60_000
    return ms


def make_date(*args):
    if not args:
        return Date(math.floor(time.time() * 1000))
    if len(args) > 1:
        return Date(ms_of(*args[:7]))
    x = args[0]
    return Date(x.ms if isinstance(x, Date) else parse_date(x) if isinstance(x, str) else number(x))


def date_text(d: Date, form: str) -> str:
    t = moment(d)
    return t.strftime(form) if t else "Invalid Date"


def iso(d: Date):
    t = moment(d)
    return f"{t:%Y-%m-%dT%H:%M:%S}.{t.microsecond // 1000:03d}Z" if t else None


def to_iso(d: Date, *_):
    return iso(d) or fail("RangeError", "invalid date")


_PARTS = {"FullYear": lambda t: t.year, "Month": lambda t: t.month - 1, "Date": lambda t: t.day, "Hours": lambda t: t.hour, "Minutes": lambda t: t.minute, "Seconds": lambda t: t.second, "Milliseconds": lambda t: t.microsecond // 1000}


def _getter(part: Callable) -> Callable:
    return lambda d, *_: part(t) if (t := moment(d)) else math.nan


def _setter(i: int) -> Callable:
    def put(d: Date, *args):
        t = moment(d)
        if t:
            parts = [p(t) for p in _PARTS.values()]
            parts[i : i + len(args)] = args[: len(parts) - i]
            d.ms = ms_of(*parts)
        return d.ms

    return put


DATE: dict[str, Callable] = {
    "getTime": lambda d, *_: d.ms,
    "valueOf": lambda d, *_: d.ms,
    "setTime": lambda d, ms=math.nan, *_: (setattr(d, "ms", number(ms)), d.ms)[1],
    "getTimezoneOffset": lambda d, *_: 0 if d.ms == d.ms else math.nan,
    "toISOString": to_iso,
    "toJSON": lambda d, *_: iso(d),
    "toString": lambda d, *_: text(d),
    "toDateString": lambda d, *_: date_text(d, "%a %b %d %Y"),
    "toTimeString": lambda d, *_: date_text(d, "%H:%M:%S GMT+0000 (Coordinated Universal Time)"),
    "toUTCString": lambda d, *_: date_text(d, "%a, %d %b %Y %H:%M:%S GMT"),
    "toGMTString": lambda d, *_: date_text(d, "%a, %d %b %Y %H:%M:%S GMT"),
}
for _zone in ("", "UTC"):
    DATE[f"get{_zone}Day"] = _getter(lambda t: t.isoweekday() % 7)
    for _i, (_name, _part) in enumerate(_PARTS.items()):
        DATE[f"get{_zone}{_name}"], DATE[f"set{_zone}{_name}"] = _getter(_part), _setter(_i)

# --- regular expressions


def regexp_exec(r: RegExp, s="undefined", *_):
    s, keeps = text(s), bool(set(r.flags) & {"g", "y"})
    m = r.at(s, r.last if keeps else 0) if not keeps or r.last <= len(s) else None
    if keeps:
        r.last = m.end() if m else 0
    return match_record(m, s)


REGEXP: dict[str, Callable] = {"exec": regexp_exec, "test": lambda r, s="undefined", *_: regexp_exec(r, s) is not None, "toString": lambda r, *_: text(r)}

# --- names that every program has


def _safe(f: Callable) -> Function:
    def call(x=UNDEFINED, *_):
        try:
            return f(number(x))
        except (ValueError, OverflowError):
            return math.nan

    return Function(call)


def _log(x):
    return math.log(x) if x > 0 else -math.inf if x == 0 else math.nan


def _exp(x):
    return math.exp(x) if x < 709.8 else math.inf


def _rounded(f: Callable) -> Callable:
    return lambda x: f(x) if x == x and abs(x) != math.inf else x


def _extreme(f: Callable, none: float) -> Function:
    def call(*xs):
        values = [number(x) for x in xs]
        return math.nan if any(v != v for v in values) else f(values, default=none)

    return Function(call)


MATH = {
    "PI": math.pi, "E": math.e, "LN2": math.log(2), "LN10": math.log(10), "LOG2E": 1 / math.log(2), "LOG10E": 1 / math.log(10), "SQRT2": math.sqrt(2), "SQRT1_2": math.sqrt(0.5),
    "abs": _safe(abs), "floor": _safe(_rounded(math.floor)), "ceil": _safe(_rounded(math.ceil)), "trunc": _safe(_rounded(math.trunc)), "round": _safe(_rounded(lambda x: math.floor(x + 0.5) if abs(x) < 2**52 else x)),
    "sign": _safe(lambda x: x if x != x or x == 0 else 1 if x > 0 else -1), "sqrt": _safe(math.sqrt), "cbrt": _safe(math.cbrt), "exp": _safe(_exp), "log": _safe(_log),
    "sin": _safe(math.sin), "cos": _safe(math.cos), "tan": _safe(math.tan), "asin": _safe(math.asin), "acos": _safe(math.acos), "atan": _safe(math.atan),
    "atan2": Function(lambda y=math.nan, x=math.nan, *_: math.atan2(number(y), number(x))), "pow": Function(lambda x=math.nan, y=math.nan, *_: power(number(x), number(y))),
    "min": _extreme(min, math.inf), "max": _extreme(max, -math.inf), "hypot": Function(lambda *xs: math.hypot(*map(number, xs))), "random": Function(lambda *_: random.random()),
}


def _object(x=UNDEFINED, *_):
    return {} if x is None or x is UNDEFINED else x


def _array(*args):
    if len(args) == 1 and is_number(args[0]):
        if not 0 <= args[0] <= ITEMS or args[0] != int(args[0]):
            fail("RangeError", "invalid array length")
        return [UNDEFINED] * int(args[0])
    return list(args)


def _from(x=UNDEFINED, f=UNDEFINED, *_):
    items = list(iterate(x))
    return [f(v, i) for i, v in enumerate(items)] if isinstance(f, Function) else items


def _error(kind: str) -> Function:
    return Function(lambda message="", *_: error(kind, "" if message is UNDEFINED else text(message)))


def _statics(**members) -> dict:
    return {k: Function(v) if callable(v) and not isinstance(v, Function) else v for k, v in members.items()}


GLOBALS: dict[str, Any] = {
    "Math": MATH,
    "JSON": _statics(stringify=stringify, parse=parse_json),
    "Object": Function(_object, members=_statics(keys=lambda x=UNDEFINED, *_: [k for k, _v in entries_of(x)], values=lambda x=UNDEFINED, *_: [v for _k, v in entries_of(x)], entries=lambda x=UNDEFINED, *_: entries_of(x), assign=merged, freeze=lambda x=UNDEFINED, *_: x, fromEntries=lambda x=UNDEFINED, *_: {text(e[0]): e[1] for e in iterate(x)}, hasOwn=lambda x=UNDEFINED, k=UNDEFINED, *_: isinstance(x, dict) and text(k) in x)),
    "Array": Function(_array, members=_statics(isArray=lambda x=UNDEFINED, *_: isinstance(x, list), of=lambda *xs: list(xs), **{"from": _from})),
    "String": Function(lambda x="", *_: text(x), members=_statics(fromCharCode=lambda *xs: "".join(chr(whole(x) & 0xFFFF) for x in xs), fromCodePoint=lambda *xs: "".join(chr(whole(x)) if 0 <= whole(x) < 0x110000 else fail("RangeError", "no such character") for x in xs))),
    "Number": Function(lambda x=0, *_: number(x), members=_statics(isInteger=lambda x=UNDEFINED, *_: is_finite(x) and x == int(x), isSafeInteger=lambda x=UNDEFINED, *_: is_finite(x) and x == int(x) and abs(x) < 2**53, isFinite=lambda x=UNDEFINED, *_: is_finite(x), isNaN=lambda x=UNDEFINED, *_: is_number(x) and x != x, parseInt=parse_int, parseFloat=parse_float, MAX_SAFE_INTEGER=2**53 - 1, MIN_SAFE_INTEGER=1 - 2**53, MAX_VALUE=1.7976931348623157e308, MIN_VALUE=5e-324, EPSILON=2.0**-52, POSITIVE_INFINITY=math.inf, NEGATIVE_INFINITY=-math.inf, NaN=math.nan)),
    "Boolean": Function(lambda x=False, *_: truthy(x)),
    "Date": Function(lambda *a: text(make_date()), make=make_date, members=_statics(now=lambda *_: math.floor(time.time() * 1000), UTC=lambda *a: ms_of(*a[:7]), parse=parse_date)),
    "Map": Function(lambda *a: bag(Map, *a)),
    "Set": Function(lambda *a: bag(Set, *a)),
    "RegExp": Function(lambda p="", f="", *_: RegExp(p.source if isinstance(p, RegExp) else text(p), text(f))),
    "parseInt": Function(parse_int), "parseFloat": Function(parse_float), "isNaN": Function(lambda x=UNDEFINED, *_: number(x) != number(x)), "isFinite": Function(lambda x=UNDEFINED, *_: is_finite(number(x))),
    "NaN": math.nan, "Infinity": math.inf,
    **{k: _error(k) for k in ("Error", "TypeError", "RangeError", "SyntaxError")},
}
