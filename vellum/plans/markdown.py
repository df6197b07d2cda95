"""Markdown - CommonMark's blocks and spans, tables, tasks, strikes, bare links, notes of the alert kind,
raw HTML as real elements - to the same node rows as the markup language, heading ids by the same rule."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from . import markup
from .markup import VOID, Tree, cells, delimiter

ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*([^`\n]*)$")
QUOTE = re.compile(r"^ {0,3}> ?")
ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|$)")
TASK = re.compile(r"^\[([ xX])\][ \t]+")
DEFINITION = re.compile(r"^ {0,3}\[((?:\\.|[^\]\\])+)\]:[ \t]*<?([^\s>]+)>?(?:[ \t]+(?:\"([^\"]*)\"|'([^']*)'|\(([^)]*)\)))?[ \t]*$")
HTML_BLOCK = re.compile(r"^ {0,3}<(?:!--|/?[A-Za-z][\w-]*(?:[\s/>]|$))")
ALERT = re.compile(r"^\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\][ \t]*$", re.I)
RAW_TAG = re.compile(r"<!--[\s\S]*?-->|</?[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>")
AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
BARE = re.compile(r"(?:https?://|www\.)[^\s<]*[^\s<?!.,:*_~'\")]")
LINK = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:\\.|[^\s()\\]|\((?:\\.|[^\s()\\])*\))*))(?:\s+(?:\"((?:\\.|[^\"\\])*)\"|'((?:\\.|[^'\\])*)'))?\s*\)")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tab(line: str) -> str:
    """Leading tabs as spaces to columns of four."""
    out = ""
    for i, c in enumerate(line):
        if c == "\t":
            out += " " * (4 - len(out) % 4)
        elif c == " ":
            out += c
        else:
            return out + line[i:]
    return out


def indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


class Builder:
    def __init__(self, text: str):
        self.tree = Tree()
        self.root = self.tree.add(-1, 0, "root")
        self.refs: dict[str, tuple[str, str | None]] = {}
        lines = [(n, tab(x)) for n, x in enumerate((text or "").replace("\r\n", "\n").split("\n"), 1)]
        self.blocks(self.root, 1, self.definitions(lines))

    def definitions(self, lines):
        """Lines without link definitions, which are kept aside."""
        kept, fence = [], None
        for n, line in lines:
            f = FENCE.match(line)
            if fence:
                fence = None if f and f[2].startswith(fence) and not f[3].strip() else fence
            elif f:
                fence = f[2]
            elif (m := DEFINITION.match(line)) and (not kept or not kept[-1][1].strip() or DEFINITION.match(line)):
                self.refs.setdefault(" ".join(m[1].lower().split()), (m[2], m[3] or m[4] or m[5]))
                continue
            kept.append((n, line))
        return kept

    def element(self, parent, depth, tag, props=None, line=0, value=None):
        return self.tree.add(parent, depth, "element", tag, props, value, line)

    # --- blocks

    def starts(self, line: str) -> bool:
        """Whether a line ends a paragraph before it."""
        m = ITEM.match(line)
        return bool(ATX.match(line) or RULE.match(line) or FENCE.match(line) or QUOTE.match(line) or HTML_BLOCK.match(line) or m and m[4] and (not m[2][0].isdigit() or m[2][:-1] == "1"))

    def blocks(self, parent, depth, lines, tight: bool = False):
        at = 0
        while at < len(lines):
            n, line = lines[at]
            if not line.strip():
                at += 1
            elif indent(line) >= 4:
                end = at
                while end < len(lines) and (not lines[end][1].strip() or indent(lines[end][1]) >= 4):
                    end += 1
                while not lines[end - 1][1].strip():
                    end -= 1
                self.code(parent, depth, "".join(x[4:] + "\n" for _, x in lines[at:end]), "", n)
                at = end
            elif m := ATX.match(line):
                self.heading(parent, depth, len(m[1]), m[2] or "", n)
                at += 1
            elif RULE.match(line):
                self.element(parent, depth, "hr", line=n)
                at += 1
            elif m := FENCE.match(line):
                end = next((i for i in range(at + 1, len(lines)) if (f := FENCE.match(lines[i][1])) and f[2].startswith(m[2]) and not f[3].strip()), len(lines))
                body = "".join(x[min(indent(x), len(m[1])) :] + "\n" for _, x in lines[at + 1 : end])
                self.code(parent, depth, body, (m[3].split() or [""])[0], n)
                at = end + 1
            elif QUOTE.match(line):
                at = self.quote(parent, depth, lines, at)
            elif ITEM.match(line):
                at = self.items(parent, depth, lines, at)
            elif HTML_BLOCK.match(line):
                end = at
                while end < len(lines) and lines[end][1].strip():
                    end += 1
                raw_html(self.tree, parent, depth, "\n".join(x for _, x in lines[at:end]), n)
                at = end
            elif (end := self.table(parent, depth, lines, at)) > at:
                at = end
            else:
                end = at + 1
                while end < len(lines) and lines[end][1].strip() and not SETEXT.match(lines[end][1]) and not self.starts(lines[end][1]):
                    end += 1
                text = "\n".join(x.lstrip() for _, x in lines[at:end]).rstrip()
                if end < len(lines) and (m := SETEXT.match(lines[end][1])):
                    self.heading(parent, depth, 1 if m[1][0] == "=" else 2, text, n)
                    end += 1
                elif tight:
                    self.spans(parent, depth, text, n)
                else:
                    self.spans(self.element(parent, depth, "p", line=n), depth + 1, text, n)
                at = end

    def heading(self, parent, depth, level, text, n):
        node = self.element(parent, depth, f"h{level}", {}, n)
        first = len(self.tree.rows)
        self.spans(node, depth + 1, text.strip(), n)
        plain = "".join(r[7] or "" for r in self.tree.rows[first:] if r[4] == "text")
        if name := self.tree.heading_id(plain):
            self.tree.rows[node][6] = {"id": name}

    def code(self, parent, depth, body, lang, n):
        pre = self.element(parent, depth, "pre", line=n)
        code = self.element(pre, depth + 1, "code", {"class": f"language-{lang}"} if lang else {}, n)
        self.tree.add(code, depth + 2, "text", value=body, line=n)

    def quote(self, parent, depth, lines, at):
        end, inner, lazy = at, [], False
        while end < len(lines):
            n, x = lines[end]
            if m := QUOTE.match(x):
                inner.append((n, x[m.end() :]))
                lazy = bool(inner[-1][1].strip()) and not self.starts(inner[-1][1])
            elif lazy and x.strip() and not self.starts(x):
                inner.append((n, x))
            else:
                break
            end += 1
        if (m := ALERT.match(inner[0][1])) and len(inner) > 1:
            kind = m[1].lower()
            node = self.element(parent, depth, "div", {"class": f"markdown-alert markdown-alert-{kind}"}, lines[at][0])
            title = self.element(node, depth + 1, "p", {"class": "markdown-alert-title"}, lines[at][0])
            self.tree.add(title, depth + 2, "text", value=kind.capitalize(), line=lines[at][0])
            inner = inner[1:]
        else:
            node = self.element(parent, depth, "blockquote", line=lines[at][0])
        self.blocks(node, depth + 1, inner)
        return end

    def items(self, parent, depth, lines, at):
        first = ITEM.match(lines[at][1])
        kind, found, loose, end = first[2][-1] if first[2][0].isdigit() else first[2], [], False, at
        while end < len(lines) and (m := ITEM.match(lines[end][1])) and not RULE.match(lines[end][1]) and (m[2][-1] if m[2][0].isdigit() else m[2]) == kind:
            space = len(m[3] or " ")
            inside = len(m[1]) + len(m[2]) + (space if space <= 4 else 1)
            inner = [(lines[end][0], (" " * (space - 1) if space > 4 else "") + (m[4] or ""))]
            end += 1
            while end < len(lines):
                n, x = lines[end]
                if not x.strip():
                    more = next((i for i in range(end, len(lines)) if lines[i][1].strip()), len(lines))
                    if more == len(lines) or indent(lines[more][1]) < inside:
                        break
                    inner.append((n, ""))
                elif indent(x) >= inside:
                    inner.append((n, x[inside:]))
                elif inner[-1][1].strip() and not self.starts(x) and not ITEM.match(x):
                    inner.append((n, x.lstrip()))
                else:
                    break
                end += 1
            after = next((i for i in range(end, len(lines)) if lines[i][1].strip()), len(lines))
            more = after < len(lines) and after > end and (x := ITEM.match(lines[after][1])) and (x[2][-1] if x[2][0].isdigit() else x[2]) == kind
            loose |= bool(more) or self.gapped(inner)
            found.append(inner)
            if more:
                end = after
        ordered = first[2][0].isdigit()
        tasks = any(TASK.match(i[0][1]) for i in found)
        props = ({"start": str(int(first[2][:-1]))} if ordered and first[2][:-1].lstrip("0") != "1" else {}) | ({"class": "contains-task-list"} if tasks else {})
        node = self.element(parent, depth, "ol" if ordered else "ul", props, lines[at][0])
        for inner in found:
            task, n = TASK.match(inner[0][1]), inner[0][0]
            li = self.element(node, depth + 1, "li", {"class": "task-list-item"} if task else {}, n)
            to, deep = li, depth + 2
            if task:
                inner[0] = (n, inner[0][1][task.end() :])
                box = {"type": "checkbox", **({"checked": ""} if task[1] in "xX" else {}), "disabled": ""}
                if loose:
                    p = self.element(li, depth + 2, "p", line=n)
                    self.element(p, depth + 3, "input", box, n)
                    self.spans(p, depth + 3, " " + inner[0][1], n)
                    inner = inner[1:]
                else:
                    self.element(li, depth + 2, "input", box, n)
                    self.tree.add(li, depth + 2, "text", value=" ", line=n)
            self.blocks(to, deep, inner, not loose)
        return end

    @staticmethod
    def gapped(inner) -> bool:
        """Whether a blank line stands between an item's own blocks."""
        return any(not x.strip() and 0 < i < len(inner) - 1 and indent(inner[i + 1][1]) < 2 and not ITEM.match(inner[i + 1][1]) for i, (_, x) in enumerate(inner))

    def table(self, parent, depth, lines, at):
        if at + 1 >= len(lines) or "|" not in lines[at][1] or not (align := delimiter(lines[at + 1][1])) or len(align) != len(cells(lines[at][1])):
            return at
        end = at + 2
        while end < len(lines) and lines[end][1].strip() and not self.starts(lines[end][1]):
            end += 1
        node = self.element(parent, depth, "table", line=lines[at][0])
        for group, tag, part in (("thead", "th", lines[at : at + 1]), ("tbody", "td", lines[at + 2 : end])):
            if part:
                g = self.element(node, depth + 1, group, line=part[0][0])
                for n, x in part:
                    tr, row = self.element(g, depth + 2, "tr", line=n), cells(x)
                    for i, how in enumerate(align):
                        cell = self.element(tr, depth + 3, tag, {"align": how} if how else {}, n)
                        self.spans(cell, depth + 4, row[i] if i < len(row) else "", n)
        return end

    # --- spans: a list of texts, nodes and runs of marks, then marks are paired

    def spans(self, parent, depth, text, n):
        self.put(parent, depth, self.paired(self.pieces(text)), n)

    def put(self, parent, depth, nodes, n):
        text = ""
        for x in [*nodes, None]:
            if isinstance(x, str):
                text += x
                continue
            if text:
                self.tree.add(parent, depth, "text", value=text, line=n)
                text = ""
            if x is not None:
                tag, props, inner = x
                if tag == "raw":
                    raw_html(self.tree, parent, depth, props, n)
                else:
                    self.put(self.element(parent, depth, tag, props, n), depth + 1, inner, n)

    def pieces(self, text: str) -> list:
        out, at = [], 0
        while at < len(text):
            c = text[at]
            if c == "\\" and at + 1 < len(text):
                if text[at + 1] == "\n":
                    out += [("br", {}, []), "\n"]
                else:
                    out.append(text[at + 1] if text[at + 1] in PUNCTUATION else text[at : at + 2])
                at += 2
            elif c == "\n":
                spaces = 0
                while out and out[-1] == " ":
                    out.pop()
                    spaces += 1
                out += [("br", {}, []), "\n"] if spaces > 1 else ["\n"]
                at += 1
            elif c == "`":
                run = re.match("`+", text[at:])[0]
                m = re.compile(rf"(?<!`){run}(?!`)").search(text, at + len(run))
                if m:
                    body = text[at + len(run) : m.start()].replace("\n", " ")
                    body = body[1:-1] if body[:1] == body[-1:] == " " and body.strip() else body
                    out.append(("code", {}, [body]))
                    at = m.end()
                else:
                    out.append(run)
                    at += len(run)
            elif c in "*_~":
                run = re.match(re.escape(c) + "+", text[at:])[0]
                before, after = text[at - 1] if at else " ", text[at + len(run)] if at + len(run) < len(text) else " "
                left = not after.isspace() and (after not in PUNCTUATION or before.isspace() or before in PUNCTUATION)
                right = not before.isspace() and (before not in PUNCTUATION or after.isspace() or after in PUNCTUATION)
                opens = left and (c != "_" or not right or before in PUNCTUATION)
                closes = right and (c != "_" or not left or after in PUNCTUATION)
                if c == "~" and len(run) > 2:
                    opens = closes = False
                out.append([c, len(run), opens, closes])
                at += len(run)
            elif c == "<" and (m := AUTO.match(text, at)):
                out.append(("a", {"href": m[1] if ":" in m[1] else f"mailto:{m[1]}"}, [m[1]]))
                at = m.end()
            elif c == "<" and (m := RAW_TAG.match(text, at)):
                close = re.compile(rf"</{re.escape(m[0][1:].split()[0].strip('/>'))}\s*>", re.I).search(text, m.end()) if m[0][1].isalpha() and not m[0].endswith("/>") else None
                out.append(("raw", text[at : close.end()] if close else m[0], []))
                at = close.end() if close else m.end()
            elif c == "&" and (m := re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]\w*);").match(text, at)):
                out.append(html.unescape(m[0]))
                at = m.end()
            elif (c == "[" or text.startswith("![", at)) and (found := self.link(text, at)):
                out.append(found[0])
                at = found[1]
            elif c in "hw" and (not at or not text[at - 1].isalnum()) and (m := BARE.match(text, at)):
                out.append(("a", {"href": m[0] if m[0][0] == "h" else f"http://{m[0]}"}, [m[0]]))
                at = m.end()
            else:
                out.append(c)
                at += 1
        return out

    def link(self, text: str, at: int):
        image = text[at] == "!"
        start = at + 1 + image
        depth, end = 1, start
        while end < len(text) and depth:
            if text[end] == "\\":
                end += 1
            depth += {"[": 1, "]": -1}.get(text[end : end + 1], 0)
            end += 1
        if depth:
            return None
        label = text[start : end - 1]
        if m := LINK.match(text, end):
            url, title, to = m[1] if m[1] is not None else m[2], m[3] if m[3] is not None else m[4], m.end()
        else:
            m = re.compile(r"\[([^\]]*)\]").match(text, end)
            ref = self.refs.get(" ".join((m[1] if m and m[1] else label).lower().split()))
            if ref is None:
                return None
            (url, title), to = ref, m.end() if m else end
        url = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", html.unescape(url))
        extra = {"title": title} if title else {}
        inner = self.paired(self.pieces(label))
        if image:
            flat = lambda xs: "".join(x if isinstance(x, str) else x[1].get("alt", flat(x[2])) if isinstance(x[1], dict) else "" for x in xs)
            return ("img", {"src": url, "alt": flat(inner)} | extra, []), to
        return ("a", {"href": url} | extra, inner), to

    @staticmethod
    def paired(pieces: list) -> list:
        """Marks as elements: each closing run looks back for the nearest run that can open."""
        out: list = []
        for p in pieces:
            if not isinstance(p, list):
                out.append(p)
                continue
            mark, left, opens, closes = p
            while closes and left:
                k = next((i for i in range(len(out) - 1, -1, -1) if isinstance(out[i], list) and out[i][0] == mark and out[i][2] and out[i][1] and not (mark == "~" and out[i][1] != left) and not (mark != "~" and (out[i][3] or opens) and (out[i][1] + left) % 3 == 0 and not (out[i][1] % 3 == 0 and left % 3 == 0))), None)
                if k is None:
                    break
                n = left if mark == "~" else 2 if left >= 2 and out[k][1] >= 2 else 1
                inner = [x if not isinstance(x, list) else x[0] * x[1] for x in out[k + 1 :]]
                out[k][1] -= n
                left -= n
                del out[k + 1 :]
                out.append(("del" if mark == "~" else "strong" if n == 2 else "em", {}, inner))
                if not out[k][1]:
                    del out[k]
            if left:
                out.append([mark, left, opens, closes])
        return [x if not isinstance(x, list) else x[0] * x[1] for x in out]


def raw_html(tree: Tree, parent: int, depth: int, text: str, line: int) -> None:
    """Raw HTML as nodes; what is left open ends with the piece."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open = [(parent, depth, None)]

        def handle_starttag(self, tag, attrs):
            at, d, _ = self.open[-1]
            node = tree.add(at, d, "element", tag, {k: v or "" for k, v in attrs}, None, line)
            if tag not in VOID:
                self.open.append((node, d + 1, tag))

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.open.pop()

        def handle_endtag(self, tag):
            if any(t == tag for _, _, t in self.open):
                while self.open[-1][2] != tag:
                    self.open.pop()
                self.open.pop()

        def handle_data(self, data):
            tree.add(self.open[-1][0], self.open[-1][1], "text", value=data, line=line)

        def handle_comment(self, data):
            tree.add(self.open[-1][0], self.open[-1][1], "comment", value=data, line=line)

    reader = Reader()
    reader.feed(text)
    reader.close()


def parse(text: str) -> list[list]:
    """Node rows of a text, a null one empty."""
    return Builder(text).tree.rows


def nodes(docs: DataFrame, key: str = "doc_index", text: str = "body") -> DataFrame:
    """The node table of Markdown texts."""
    return markup.nodes(docs, key, text, parse)
