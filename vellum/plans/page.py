"""Documents as programs: pages that query their set, show one another, write outputs and send messages.

A page runs on the driver, where its queries are Spark jobs over the set; what a query gives to code is
bounded, and more is an error, never a cut. Rows are rendered by the same programs on the executors, in
Arrow batches (`render_programs`, `evaluate_rows`), without queries. A rendered document is a tree that
is parked under a token; where the token lands in a page's own markup its tree is put (`splice`).
"""

from __future__ import annotations

import itertools
import json
import posixpath
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import library as lib
from ..functions.library import UNDEFINED, Function, ScriptError
from ..operators.docset import DocSet
from . import markup
from .script import FUEL, Parser, Program, Run, Scope

#: Records that one query may give to code, and renders inside one another.
ROWS, MAX_DEPTH = 100_000, 16
TOKEN = re.compile("\ue000(\\d+)\ue001")
#: Elements that are phrasing; all others are blocks, which a sentence cannot hold.
PHRASING = set("a abbr b bdi bdo br cite code data dfn del em i img input ins kbd mark q rp rt ruby s samp small span strong sub sup time u var wbr".split())


@lru_cache(maxsize=1024)
def program(body: str) -> Program:
    return Program(body)


def tokenized(text: str) -> list[str]:
    """The words of a search index, as `functions.text.tokenize` has them."""
    from ..functions.text import STOPWORDS

    words = re.split("[^a-z0-9]+", text.lower())
    return list(dict.fromkeys(w for w in words if len(w) > 1 and w not in STOPWORDS))


def rfc822(day: str) -> str:
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", day)
    return lib.date_text(lib.Date(lib.ms_of(int(m[1]), int(m[2]) - 1, int(m[3]))), "%a, %d %b %Y %H:%M:%S GMT") if m and 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31 else "Invalid Date"


def table_text(rows, align=UNDEFINED) -> str:
    """A table's markup: the first row is the header; align: left, center, right or their first letters."""
    cells = [["" if c is None or c is UNDEFINED else lib.text(c).replace("|", "\\|").replace("\n", " ") for c in r] for r in rows]
    if not cells:
        return ""
    names = list(align) if isinstance(align, (list, str)) else []
    rule = [{"l": ":--", "c": ":-:", "r": "--:"}.get(lib.text(names[i])[:1].lower() if i < len(names) and names[i] else "", "---") for i in range(len(cells[0]))]
    return "\n".join("| " + " | ".join(r) + " |" for r in [cells[0], rule, *cells[1:]])


# --- trees: {"row": node row, "children": [...]}


def nested(rows: list[list]) -> dict:
    """The tree of a document's node rows."""
    made = [{"row": r, "children": []} for r in rows]
    for n in made[1:]:
        made[n["row"][1]]["children"].append(n)
    return made[0]


def flattened(tree: dict) -> list[list]:
    """Node rows of a tree, in preorder, numbered anew."""
    out = markup.Tree()
    stack = [(tree, -1, 0)]
    while stack:
        node, parent, depth = stack.pop()
        kind, tag, props, value, line = node["row"][4:9]
        at = out.add(parent, depth, kind, tag, props, value, line)
        stack.extend((c, at, depth + 1) for c in reversed(node["children"]))
    return out.rows


def _text(value: str) -> dict:
    return {"row": [0, 0, 0, 0, "text", None, {}, value, 0], "children": []}


def phrasing(nodes: list[dict]) -> list[dict]:
    """Nodes as they stand in a sentence: blocks give way to what they hold."""
    out = []
    for n in nodes:
        out.extend([n] if n["row"][4] == "text" or n["row"][5] in PHRASING else phrasing(n["children"]))
    return out


def splice(tree: dict, held: dict[int, dict]) -> dict:
    """The tree with the trees of tokens in their places: a paragraph of tokens alone gives way to
    them, elsewhere they stand as phrasing. Tokens that nothing is parked under say nothing."""

    def kids(node: dict) -> list[dict]:
        out = []
        for c in node["children"]:
            if c["row"][4] == "text":
                for i, part in enumerate(TOKEN.split(c["row"][7] or "")):
                    if i % 2:
                        found = held.get(int(part))
                        inner = kids(found) if found else []
                        out.extend(phrasing(inner))
                    elif part:
                        out.append(_text(part))
                continue
            alone = [t["row"][7] or "" for t in c["children"]] if c["row"][5] == "p" and all(t["row"][4] == "text" for t in c["children"]) else None
            if alone and (joined := "".join(alone).strip()) and TOKEN.search(joined) and not TOKEN.sub("", joined).strip():
                for i in TOKEN.findall(joined):
                    out.extend(kids(held[int(i)]) if int(i) in held else [])
                continue
            out.append({"row": c["row"], "children": kids(c)})
        return out

    return {"row": tree["row"], "children": kids(tree)}


def fill_tokens(text: str, held: dict[int, dict]) -> str:
    """A text with its tokens as HTML."""
    return TOKEN.sub(lambda m: html_of(held[int(m[1])], held) if int(m[1]) in held else "", text)


def html_of(tree: dict, held: dict[int, dict] | None = None) -> str:
    names = [n for n, _ in markup.NODE_FIELDS]
    rows = flattened(splice(tree, held or {}))
    return markup.write_html([dict(zip(names, r)) | {"props": list(r[6].items())} for r in rows])


class Pages:
    """The pages of a set. natives: functions that code knows as `$.<name>`; hooks are called with what
    the code asks, emits and publishes; load gives the text of a module by its path."""

    def __init__(self, docs: DocSet, natives: dict[str, Callable] | None = None, on_query: Callable | None = None, on_emit: Callable | None = None, on_publish: Callable | None = None, load: Callable[[str], str] | None = None, packages: dict[str, Pages] | None = None):
        for name in natives or {}:
            if not re.fullmatch(r"[A-Za-z_$][\w$]*", name):
                raise ValueError(f"{name!r} is no name for a function")
        # a page asks its set again and again: it is kept on the executors, and worked out anew where one is lost
        self.docs = DocSet(docs.docs.persist(), docs.on_query)
        self.docs.hot = docs.hot
        self.natives, self.load, self.packages = natives or {}, load, packages or {}
        self.on_query, self.on_emit, self.on_publish = on_query, on_emit, on_publish
        self.outputs: dict[str, str] = {}
        self.messages: list[dict] = []
        self.held: dict[int, dict] = {}
        self.modules: dict[str, dict] = {}
        self._ids = itertools.count(1)
        self._bodies: dict[int, tuple[dict, str]] = {}

    # --- queries

    def records(self, query: dict | None, limit: int | None = None) -> list[dict]:
        """What a filter finds, in document order, each record with _id; over ROWS is an error."""
        if self.on_query:
            self.on_query(query)
        found = self.docs.find(query)
        rows = found.select("doc_index", "data_json", "content").limit(limit or ROWS + 1).collect()
        if len(rows) > ROWS:
            raise ScriptError(f"a query gave over {ROWS} records to code")
        out = []
        for r in rows:
            record = json.loads(r.data_json) | {"_id": r.doc_index}
            self._bodies[r.doc_index] = (record, r.content or "")
            out.append(dict(record))
        return out

    def document(self, target) -> tuple[dict, str]:
        """(record, body) of a document's number, of a record that was found, or of a filter's first match."""
        if lib.is_number(target):
            index = int(target)
        elif isinstance(target, dict) and lib.is_number(target.get("_id")):
            index = int(target["_id"])
        elif isinstance(target, dict):
            first = self.records(lib.plain(target), 1)
            if not first:
                raise ScriptError(f"nothing is found to render by {lib.stringify(target)}")
            index = first[0]["_id"]
        else:
            raise ScriptError("a document is named by its number, a record or a filter")
        if index not in self._bodies:
            row = self.docs.data(index).select("data_json", "content").first()
            if row is None:
                raise ScriptError(f"no document {index}")
            self._bodies[index] = (json.loads(row.data_json) | {"_id": index}, row.content or "")
        return self._bodies[index]

    # --- renders

    def text(self, target, req=None, depth: int = 1) -> str:
        """What a document's code writes, byte for byte; tokens stand for what it shows."""
        if depth > MAX_DEPTH:
            raise ScriptError("documents show one another too deep")
        record, body = self.document(target)
        names = {"req": req if req is not None and req is not UNDEFINED else {}, "res": {"data": record}, "$": self.api(depth, record), "import": Function(self.module)}
        return program(body).run(names, FUEL)

    def tree(self, target, req=None, depth: int = 1) -> dict:
        return nested(markup.parse(self.text(target, req, depth)))

    def html(self, target=0, req=None) -> str:
        """A document as HTML, with all that it shows."""
        return html_of(self.tree(target, req), self.held)

    def render_each(self, target) -> list[str]:
        """The texts of a template for every other document of the set, in document order."""
        own = self.document(target)[0]["_id"]
        return [fill_tokens(self.text(own, r), self.held) for r in self.records(None) if r["_id"] != own]

    def park(self, tree: dict) -> str:
        i = next(self._ids)
        self.held[i] = tree
        return f"\ue000{i}\ue001"

    def release(self) -> None:
        """Lets go of parked trees, of records that were read, and of the kept set."""
        self.held.clear()
        self._bodies.clear()
        self.docs.docs.unpersist()

    def built(self, x) -> dict:
        """The tree of a hand-built node of code: {type, tagName, properties, children, value}."""
        if not isinstance(x, dict) or x.get("type") not in ("root", "element", "text", "comment"):
            raise ScriptError("a node is a mapping with a type")
        children = [self.built(c) for c in x.get("children") or []]
        props = {k: "" if v is True else lib.text(v) for k, v in (x.get("properties") or {}).items() if v is not False and v is not None}
        tag = x.get("tagName") if x["type"] == "element" else None
        return {"row": [0, 0, 0, 0, x["type"], tag, props, lib.text(x["value"]) if "value" in x else None, 0], "children": children}

    # --- outputs and messages

    def emit(self, path, content=UNDEFINED) -> None:
        path = posixpath.normpath(lib.text(path).lstrip("/"))
        if path.startswith(".."):
            raise ScriptError(f"output path leaves the folder: {path}")
        self.outputs[path] = fill_tokens(content if isinstance(content, str) else lib.stringify(content), self.held)
        if self.on_emit:
            self.on_emit(path)

    def publish(self, name, data=UNDEFINED, record: dict | None = None) -> None:
        message = {"name": lib.text(name), "data": {} if data is UNDEFINED else lib.plain(data), "from_index": (record or {}).get("_id"), "from_name": (record or {}).get("name")}
        self.messages.append(message)
        if self.on_publish:
            self.on_publish(message)

    def module(self, path) -> dict:
        """The exports of a module, read once; only `.js` and `.mjs` below the set's own folder."""
        full = posixpath.normpath(lib.text(path))
        if full in self.packages:
            return self.packages[full].handle()
        if self.load is None or full.startswith(("..", "/")) or not full.endswith((".js", ".mjs")):
            raise ScriptError(f"{full} cannot be imported")
        if full not in self.modules:
            source = self.load(full)
            names = re.findall(r"(?m)^[ \t]*export[ \t]+(?:async[ \t]+)?(?:function|const|let)[ \t]+([A-Za-z_$][\w$]*)", source)
            scope = Scope(None, Run(FUEL))
            scope.names.update(lib.GLOBALS)
            inner = Scope(scope, scope.run)
            Parser(re.sub(r"(?m)^([ \t]*)export[ \t]+", r"\1", source)).program()(inner)
            self.modules[full] = {n: inner.names[n] for n in names}
        return self.modules[full]

    def handle(self) -> dict:
        """What another set knows this one by."""
        api = self.api(1, None)
        return {k: api[k] for k in ("find", "findOne", "render", "text")}

    def api(self, depth: int, record: dict | None) -> dict[str, Any]:
        def query(q=UNDEFINED):
            return None if q is UNDEFINED or q is None else lib.plain(q)

        def native(f):
            def call(*args):
                values = [lib.plain(a) for a in args]
                return f(*[None if v is UNDEFINED else v for v in values], record and record["_id"], record)

            return call

        def show(target, req=UNDEFINED, *_):
            return self.park(self.tree(target, None if req is UNDEFINED else req, depth + 1))

        found: dict[str, Callable] = {
            "find": lambda q=UNDEFINED, *_: self.records(query(q)),
            "findOne": lambda q=UNDEFINED, *_: (self.records(query(q), 1) or [None])[0],
            "withTag": lambda tag="", *_: self.records({"tags": lib.text(tag).lower()}),
            "data": lambda i=0, *_: dict(self.document(i)[0]),
            "count": lambda *_: self.docs.count(),
            "render": show,
            "text": lambda target, req=UNDEFINED, *_: self.text(target, None if req is UNDEFINED else req, depth + 1),
            "renderEach": lambda target, *_: self.render_each(target),
            "parse": lambda s="", *_: self.park(nested(markup.parse(lib.text(s)))),
            "markdown": lambda s="", *_: self.park(nested(_markdown(lib.text(s)))),
            "node": lambda x=UNDEFINED, *_: self.park(self.built(x)),
            "html": lambda x="", *_: fill_tokens(x, self.held) if isinstance(x, str) else html_of(self.built(x), self.held),
            "table": lambda rows=UNDEFINED, align=UNDEFINED, *_: table_text(rows, align),
            "toText": lambda x="", *_: plain_text(x, self.held),
            "tokenize": lambda s="", *_: tokenized(lib.text(s)),
            "rfc822": lambda d="", *_: rfc822(lib.text(d)),
            "slug": lambda s="", *_: markup.slug(lib.text(s)),
            "emit": lambda path="", content="", *_: self.emit(path, content),
            "publish": lambda name="", data=UNDEFINED, *_: self.publish(name, data, record),
        }
        return {k: Function(f) for k, f in (found | {n: native(f) for n, f in self.natives.items()}).items()}


def plain_text(x, held: dict[int, dict]) -> str:
    def below(node: dict) -> str:
        return (node["row"][7] or "") if node["row"][4] == "text" else "".join(map(below, node["children"]))

    return TOKEN.sub(lambda m: below(splice(held[int(m[1])], held)) if int(m[1]) in held else "", lib.text(x))


def _markdown(text: str) -> list[list]:
    from .markdown import parse

    return parse(text)


# --- rows


def _pure() -> dict[str, Any]:
    """What `$` is for rows: functions without a set."""
    return {"tokenize": Function(lambda s="", *_: tokenized(lib.text(s))), "rfc822": Function(lambda d="", *_: rfc822(lib.text(d))), "slug": Function(lambda s="", *_: markup.slug(lib.text(s))), "table": Function(lambda rows=UNDEFINED, align=UNDEFINED, *_: table_text(rows, align))}


def _programs(body: str | None, fuel: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, req, res in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                names = {"req": json.loads(req) if req else {}, "res": {"data": json.loads(res) if res else {}}, "$": _pure()}
                out.append(program(body if body is not None else text or "").run(names, fuel))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "output"])

    return run


def render_programs(rows: DataFrame, key: str, body: str | None = None, body_col: str = "content", req_col: str | None = None, res_col: str | None = None, fuel: int = FUEL) -> DataFrame:
    """(key, output): a program for each row, `body` for all or each row's own; req and res are columns
    of JSON text. A row whose program fails fails the query."""
    none = F.lit(None).cast("string")
    shaped = rows.select(F.col(key).alias("key"), F.col(body_col) if body is None else none.alias("_body"), F.col(req_col) if req_col else none.alias("_req"), F.col(res_col) if res_col else none.alias("_res"))
    return shaped.mapInArrow(_programs(body, fuel), f"key {dict(rows.dtypes)[key]}, output string").withColumnRenamed("key", key)


def _evaluator(exprs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = Scope(None, Run(FUEL))
        scope.names.update(lib.GLOBALS)
        nodes = [Parser(e).whole() for e in exprs]
        for batch in batches:
            columns: list[list] = [[] for _ in exprs]
            for record in batch.column(1).to_pylist():
                run_ = Run(FUEL)
                inner = Scope(scope, run_)
                inner.names.update(json.loads(record))
                for i, n in enumerate(nodes):
                    x = n(inner)
                    columns[i].append(None if x is UNDEFINED or x is None else x if isinstance(x, str) else lib.stringify(x) if isinstance(x, (list, dict)) else lib.text(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["key", *(f"e{i}" for i in range(len(exprs)))])

    return run


def evaluate_rows(rows: DataFrame, key: str, names: list[str], exprs: dict[str, str]) -> DataFrame:
    """(key, one text column for each of exprs): expressions of the language over the named columns of
    each row; null and undefined are null, arrays and objects JSON."""
    shaped = rows.select(F.col(key).alias("key"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("record"))
    fields = ", ".join(f"e{i} string" for i in range(len(exprs)))
    out = shaped.mapInArrow(_evaluator(list(exprs.values())), f"key {dict(rows.dtypes)[key]}, {fields}")
    return out.select(F.col("key").alias(key), *[F.col(f"e{i}").alias(n) for i, n in enumerate(exprs)])
