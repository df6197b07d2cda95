"""Templates: text with `{{ expression }}` interpolations and `% for`/`% if` lines, compiled to columns.

Expressions have a grammar of their own - names, members, literals, operators, `??`, `?:` and a few
methods - over the structs `req` (the caller's data) and `res` (the document's own). It is read token
by token and written anew as SQL, so nothing else can be reached. Bodies with other code are programs
(`plans.page`).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .script import ScriptError, tokens

TOKEN = re.compile(r"\{\{(.*?)\}\}", re.S)
FOR = re.compile(r"^\s*%\s*for\s*\(?\s*(?:const\s+|let\s+)?(\w+)\s+(?:of|in)\s+(.+?)\)?\s*\{?\s*$")
IF = re.compile(r"^\s*%\s*if\b\s*(.+?)\s*\{?\s*$")
ELSE = re.compile(r"^\s*%\s*\}?\s*else\s*\{?\s*$")
END = re.compile(r"^\s*%\s*(?:\}|end)\s*$")
#: Renders may call renders this deep.
MAX_DEPTH = 16


class TemplateError(ValueError):
    """A template that cannot be compiled."""


#: Operators by level, and what SQL calls them.
LEVELS = {"??": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "===": 4, "!==": 4, "<": 5, ">": 5, "<=": 5, ">=": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7}
SQL = {"||": "or", "&&": "and", "==": "<=>", "===": "<=>"}
#: Methods that have a column form.
METHODS = {"toUpperCase": "upper({})", "toLowerCase": "lower({})", "trim": "trim({})", "includes": "contains({}, {})", "startsWith": "startswith({}, {})", "endsWith": "endswith({}, {})", "join": "array_join({}, {})"}


class Expression:
    """An expression as SQL; `names` are what it may begin with."""

    def __init__(self, text: str, names: frozenset[str]):
        try:
            self.toks = [t for t in tokens(text) if t[0] != "line"] + [("end", "", 0)]
        except ScriptError as e:
            raise TemplateError(f"{text.strip()}: {e}") from None
        self.text, self.at, self.names = text.strip(), 0, names

    def sql(self) -> str:
        found = self.choice()
        if self.toks[self.at][0] != "end":
            self.fail()
        return found

    def fail(self):
        raise TemplateError(f"{self.text}: unexpected {self.toks[self.at][1]!r}")

    def eat(self, value: str) -> bool:
        if self.toks[self.at][0] == "op" and self.toks[self.at][1] == value:
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.eat(value):
            self.fail()

    def choice(self) -> str:
        test = self.binary(0)
        if not self.eat("?"):
            return test
        yes = self.choice()
        self.need(":")
        return f"if({test}, {yes}, {self.choice()})"

    def binary(self, least: int) -> str:
        left = self.unary()
        while self.toks[self.at][0] == "op" and LEVELS.get(self.toks[self.at][1], 0) > least:
            op = self.toks[self.at][1]
            self.at += 1
            right = self.binary(LEVELS[op])
            if op == "??":
                left = f"coalesce({left}, {right})"
            elif op in ("!=", "!=="):
                left = f"(not ({left} <=> {right}))"
            elif op == "+" and ("'" in (left[:1], right[:1]) or left.startswith("concat(")):
                left = f"concat({left}, {right})"
            else:
                left = f"({left} {SQL.get(op, op)} {right})"
        return left

    def unary(self) -> str:
        if self.eat("!"):
            return f"(not {self.unary()})"
        if self.eat("-"):
            return f"(- {self.unary()})"
        found = self.primary()
        while True:
            if self.eat(".") or self.eat("?."):
                kind, name, _ = self.toks[self.at]
                if kind != "name":
                    self.fail()
                self.at += 1
                if self.eat("("):
                    if name not in METHODS:
                        raise TemplateError(f"{self.text}: {name} is not known here")
                    args = []
                    while not self.eat(")"):
                        args.append(self.choice())
                        if not self.eat(","):
                            self.need(")")
                            break
                    if METHODS[name].count("{}") != len(args) + 1:
                        raise TemplateError(f"{self.text}: {name} takes another number of values")
                    found = METHODS[name].format(found, *args)
                elif name == "length":
                    found = f"size({found})"
                else:
                    found = f"{found}.`{name}`"
            elif self.eat("["):
                inner = self.choice()
                self.need("]")
                found = f"get({found}, cast({inner} as int))"
            else:
                return found

    def primary(self) -> str:
        kind, value, _ = self.toks[self.at]
        self.at += 1
        if kind == "num":
            return repr(value)
        if kind == "str":
            return _literal(value)
        if kind == "name" and value in ("null", "undefined", "true", "false"):
            return "null" if value == "undefined" else value
        if kind == "name" and value in self.names:
            return f"`{value}`"
        if kind == "op" and value == "(":
            found = self.choice()
            self.need(")")
            return f"({found})"
        self.at -= 1
        raise TemplateError(f"{self.text}: {value!r} is not known here")


def _value(expression: str, names: frozenset[str]) -> str:
    """An interpolation as text; null is empty text."""
    # options of ?? may be of different types: each is made text
    parts = split_options(expression)
    return f"coalesce({', '.join(f'cast({Expression(p, names).sql()} as string)' for p in parts)}, '')"


def split_options(expression: str) -> list[str]:
    """The operands of the `??` that stand outside of brackets, unless a `?:` does too."""
    try:
        toks = tokens(expression)
    except ScriptError as e:
        raise TemplateError(f"{expression.strip()}: {e}") from None
    depth, cuts = 0, []
    for kind, value, at in toks:
        if kind == "op":
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(value, 0)
            if not depth and value == "?":
                return [expression]
            if not depth and value == "??":
                cuts.append(at)
    ends = [*cuts, len(expression)]
    starts = [0, *(c + 2 for c in cuts)]
    return [expression[a:b] for a, b in zip(starts, ends)]


def _line(text: str, names: frozenset[str]) -> str:
    """A line of text as a SQL expression."""
    parts, at = [], 0
    for m in TOKEN.finditer(text):
        if m.start() > at:
            parts.append(_literal(text[at : m.start()]))
        parts.append(_value(m[1], names))
        at = m.end()
    if at < len(text) or not parts:
        parts.append(_literal(text[at:]))
    return f"concat({', '.join(parts)})"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _block(lines: list[str], at: int, stop: bool, names: frozenset[str]) -> tuple[str, int, str]:
    """SQL for an array of lines up to the block's end; where it ended and how."""
    parts = []
    while at < len(lines):
        line = lines[at]
        if END.match(line) or ELSE.match(line):
            if not stop:
                raise TemplateError(f"line {at + 1}: nothing to end")
            return _joined(parts), at, "else" if ELSE.match(line) else "end"
        if m := FOR.match(line):
            body, at, how = _block(lines, at + 1, True, names | {m[1]})
            if how != "end":
                raise TemplateError(f"line {at + 1}: else without if")
            parts.append(f"flatten(transform(coalesce({Expression(m[2], names).sql()}, array()), `{m[1]}` -> {body}))")
        elif m := IF.match(line):
            yes, at, how = _block(lines, at + 1, True, names)
            no = "cast(array() as array<string>)"
            if how == "else":
                no, at, how = _block(lines, at + 1, True, names)
            parts.append(f"if({Expression(m[1], names).sql()}, {yes}, {no})")
        elif line.lstrip().startswith("%"):
            raise TemplateError(f"line {at + 1}: only for, if, else and end are known")
        else:
            parts.append(f"array({_line(line, names)})")
        at += 1
    if stop:
        raise TemplateError("a block has no end")
    return _joined(parts), at, "end"


def _joined(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})" if parts else "cast(array() as array<string>)"


def template_sql(text: str) -> str:
    return f"array_join({_block(text.split(chr(10)), 0, False, frozenset({"req", "res"}))[0]}, '\\n')"


def render(text: str) -> Column:
    """The template as a column over `req` and `res`."""
    return F.expr(template_sql(text))


def render_rows(rows: DataFrame, text: str, req: list[str], res: dict[str, str] | None = None, name: str = "output") -> DataFrame:
    """rows with the template's text for each: `req` holds the named columns, `res` fixed SQL values."""
    own = F.struct(*[F.expr(v).alias(k) for k, v in (res or {"_": "null"}).items()])
    return rows.withColumns({"req": F.struct(*req), "res": own}).withColumn(name, render(text)).drop("req", "res")


def render_each(docs: DataFrame, template_index: int, req: Column) -> DataFrame:
    """(doc_index, output): the document `template_index` rendered once for every other document, in
    document order. `req` is the struct made of each of them; the template is read once."""
    found = docs.where(F.col("doc_index") == template_index).select("content").first()
    if found is None:
        raise TemplateError(f"no document {template_index}")
    others = docs.where(F.col("doc_index") != template_index)
    return others.select("doc_index", req.alias("req"), F.struct(F.lit(None).alias("_")).alias("res")).select("doc_index", render(found[0]).alias("output")).orderBy("doc_index")


def compose(levels: dict[str, tuple[str, list[str]]], rows: DataFrame, req: list[str], name: str = "output") -> DataFrame:
    """rows with nested templates rendered, leaves first. levels: template -> (text, templates it
    shows); an inner template's output is `req.<its name>`. Cycles and nests deeper than MAX_DEPTH
    are errors, found before anything runs."""
    order, state = [], {}

    def visit(t: str, depth: int) -> None:
        if depth > MAX_DEPTH or state.get(t) == "open":
            raise TemplateError(f"cyclic or too deep render of {t}")
        if state.get(t) == "done":
            return
        state[t] = "open"
        for inner in levels[t][1]:
            visit(inner, depth + 1)
        state[t] = "done"
        order.append(t)

    for t in levels:
        visit(t, 1)
    seen = list(req)
    for t in order:
        rows = render_rows(rows, levels[t][0], seen, name=t)
        seen.append(t)
    return rows.withColumnRenamed(order[-1], name).drop(*[t for t in order[:-1]])
