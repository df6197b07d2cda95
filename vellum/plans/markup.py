"""The markup language: text to a node table, and node tables to HTML, text, headings, links, tasks.

A document's nodes are rows (schema.NODE_SCHEMA) in preorder; a subtree is a range of node_id. Blocks
are told by lines and indentation, which needs a parser: it runs over Arrow batches. What comes after
it - headings, contents, tasks, sanitising - is queries over the table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import EMOJI, EMOTICONS

#: Markers and the elements they stand for; the last is literal.
MARKERS = {"!!": "strong", "**": "strong", "//": "em", "__": "u", "~~": "del", "??": "mark", "^^": "sup", ",,": "sub", "``": "code"}
VOID = {"area", "br", "hr", "img", "col", "wbr", "input", "link", "meta", "source"}
#: Elements, attributes and schemes that sanitising lets through, and elements that go with all they hold.
TAGS = """address article aside blockquote br details div figcaption figure footer header hgroup hr main nav p pre section summary wbr
h1 h2 h3 h4 h5 h6 dd dl dt li ol ul caption col colgroup table tbody td tfoot th thead tr a abbr b bdi bdo cite code data dfn del em
i ins kbd mark q rp rt ruby s samp small span strong sub sup time u var img picture""".split()
STRIP = "applet base body canvas embed frame frameset head html iframe link math meta noscript object portal script style svg template title".split()
ATTRIBUTES = {
    "*": "class dir hidden id lang role style title translate",
    "a": "href name rel target",
    "blockquote": "cite",
    "col": "align span width",
    "colgroup": "align span width",
    "data": "value",
    "del": "cite datetime",
    "details": "open",
    "img": "alt decoding height loading src width",
    "ins": "cite datetime",
    "li": "value",
    "ol": "reversed start type",
    "q": "cite",
    "table": "align summary",
    "tbody": "align",
    "td": "align colspan headers rowspan valign",
    "tfoot": "align",
    "th": "abbr align colspan headers rowspan scope valign",
    "thead": "align",
    "time": "datetime",
    "tr": "align",
}
SCHEMES = {"href": ["ftp", "http", "https", "irc", "ircs", "mailto", "sms", "tel", "xmpp"], "src": ["http", "https"], "cite": ["http", "https"]}
#: Nested blocks.
MAX_DEPTH = 256

HEADING = re.compile(r"^(={1,})[ \t]+(.*?)[ \t]*=*$")
UNDERLINE = re.compile(r"^(?:(=+)|-{4,})[ \t]*$")
RULE = re.compile(r"^(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE = re.compile(r"^(`{3,}|~{3,})[ \t]*([^`\s]*)[^`]*$")
ITEM = re.compile(r"^([-*+]|\d+[.)])[ \t]+(.*)$")
TASK = re.compile(r"^\[([ x])\][ \t]+(.*)$")
OPENER = re.compile(r"^<[ \t]*(?:([A-Za-z][\w-]*)|$|(?=>))")
ATTRIBUTE = re.compile(r"""[ \t]*([\w:@.-]+)(?:=("[^"]*"|'[^']*'|[^\s>"']+))?""")
NOTE = re.compile(r"^\[\[[ \t]*\^([^\]|]+?)[ \t]*\]\]:[ \t]*(.*)$")
URL = re.compile(r"(?:https?|ftp)://[^\s<>\"']*[^\s<>\"'.,;:!?)\]]|mailto:[^\s<>]+")
REFERENCE = re.compile(r"([#@])([^\W\d](?:[\w-]*\w)?)")
WIKI = re.compile(r"\[\[((?:(?!\]\]).)+)\]\]", re.S)
#: Elements whose content is text as it stands.
RAW = {"pre", "script", "style", "textarea", "title"}


def slug(text: str) -> str:
    return re.sub(r"[^\w\-/.#]+", "", re.sub(r"\s+", "-", text.strip().lower()))


class Tree:
    """Nodes of one document, in preorder."""

    def __init__(self):
        self.rows: list[list] = []
        self.children: dict[int, int] = {}
        self.ids: set[str] = set()
        self.notes: dict[str, str] = {}
        self.cited: dict[str, int] = {}

    def add(self, parent: int, depth: int, kind: str, tag: str | None = None, props: dict | None = None, value: str | None = None, line: int = 0) -> int:
        if depth > MAX_DEPTH:
            raise ValueError(f"blocks are nested deeper than {MAX_DEPTH}")
        n = len(self.rows)
        place = self.children.get(parent, 0)
        self.children[parent] = place + 1
        self.rows.append([n, parent, depth, place, kind, tag, props or {}, value, line])
        return n

    def heading_id(self, text: str) -> str | None:
        base = slug(text)
        found, k = base, 0
        while found and found in self.ids:
            k += 1
            found = f"{base}-{k}"
        self.ids.add(found)
        return found or None


#: Arrows, longest first, and the characters that they are drawn with.
ARROWS = {"<-->": "↔", "<==>": "⇔", "-->": "→", "<--": "←", "==>": "⇒", "<==": "⇐"}
DRAWN = set("".join(ARROWS))
SHORTCODE = re.compile(r":([a-zA-Z0-9_+-]+):")


def typed(text: str, at: int) -> tuple[str, int] | None:
    """(character, length) of the arrow, dash, dots or emoji that begin at a place of running text."""
    c, before = text[at], text[at - 1] if at else ""
    if c in DRAWN and before not in DRAWN:
        for arrow, char in ARROWS.items():
            if text.startswith(arrow, at):
                return None if text[at + len(arrow) : at + len(arrow) + 1] in DRAWN else (char, len(arrow))
    if text.startswith("--", at) and before != "-" and text[at + 2 : at + 3] != "-":
        return "—", 2
    if text.startswith("...", at) and before != "." and text[at + 3 : at + 4] != ".":
        return "…", 3
    if c == ":" and (m := SHORTCODE.match(text, at)) and m[1].lower() in EMOJI:
        return EMOJI[m[1].lower()], m.end() - at
    if c in ":;<" and not before.isalnum():
        for size in (3, 2):
            if (found := EMOTICONS.get(text[at : at + size])) and not text[at + size : at + size + 1].isalnum():
                return found, size
    return None


def inline(tree: Tree, parent: int, depth: int, text: str, line: int) -> None:
    """Markers, links, references and plain text of a run of text."""
    plain, at = [], 0

    def flush() -> None:
        if plain:
            tree.add(parent, depth, "text", value="".join(plain), line=line)
            plain.clear()

    while at < len(text):
        two = text[at : at + 2]
        if text[at] == "\\" and at + 1 < len(text):
            plain.append(text[at + 1])
            at += 2
            continue
        if two in MARKERS and (end := text.find(two, at + 2)) > at + 2 and (two == "``" or not text[at + 2].isspace() and not text[end - 1].isspace()) and not (two == "//" and text[at - 1 : at] == ":"):
            flush()
            node = tree.add(parent, depth, "element", MARKERS[two], line=line)
            inner = text[at + 2 : end]
            if two == "``":
                tree.add(node, depth + 1, "text", value=inner, line=line)
            else:
                inline(tree, node, depth + 1, inner, line)
            at = end + 2
            continue
        found = None
        if two == "[[" and (m := WIKI.match(text, at)):
            label, _, url = (p.strip() for p in m[1].partition("|"))
            if label.startswith("^") and label[1:].strip() in tree.notes:
                flush()
                cite(tree, parent, depth, label[1:].strip(), line)
                at = m.end()
                continue
            found = label and not label.startswith("^") and ({"href": url or slug(label)}, label)
        elif text[at] in "hfm" and (at == 0 or not text[at - 1].isalnum()) and (m := URL.match(text, at)):
            found = ({"href": m[0]}, m[0])
        elif text[at] in "#@" and (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")) and (m := REFERENCE.match(text, at)):
            found = ({"href": ("/tags/" if m[1] == "#" else "/users/") + m[2].lower(), "class": "tag" if m[1] == "#" else "mention"}, m[0])
        if found:
            flush()
            node = tree.add(parent, depth, "element", "a", found[0], line=line)
            tree.add(node, depth + 1, "text", value=found[1], line=line)
            at = m.end()
            continue
        if text[at] in "-=<.:;" and (mark := typed(text, at)):
            plain.append(mark[0])
            at += mark[1]
            continue
        plain.append(text[at])
        at += 1
    flush()


def cite(tree: Tree, parent: int, depth: int, note: str, line: int) -> None:
    """A numbered link to a note, by the order in which notes are first referred to."""
    tree.cited[note] = tree.cited.get(note, 0) + 1
    k, again = list(tree.cited).index(note) + 1, tree.cited[note]
    name = f"user-content-fnref-{k}" + (f"-{again}" if again > 1 else "")
    sup = tree.add(parent, depth, "element", "sup", line=line)
    a = tree.add(sup, depth + 1, "element", "a", {"href": f"#user-content-fn-{k}", "id": name, "data-footnote-ref": "", "aria-describedby": "footnote-label"}, line=line)
    tree.add(a, depth + 2, "text", value=str(k), line=line)


def columns(line: str) -> int:
    """The indentation of a line; a tab is four columns."""
    return sum(4 if c == "\t" else 1 for c in line[: len(line) - len(line.lstrip(" \t"))])


def cut(line: str, n: int) -> str:
    """line without its first n columns of indentation."""
    while n > 0 and line[:1] in (" ", "\t"):
        n -= 4 if line[0] == "\t" else 1
        line = line[1:]
    return line


def deeper(lines: list[tuple[int, str]], at: int, base: int) -> int:
    """The end of the run from `at` whose lines are indented by `base` or more, blank lines inside it included."""
    end = at
    for i in range(at, len(lines)):
        if lines[i][1].strip():
            if columns(lines[i][1]) < base:
                break
            end = i + 1
    return end


def begins_block(line: str) -> bool:
    return bool(HEADING.match(line) or RULE.match(line) or FENCE.match(line) or ITEM.match(line) or OPENER.match(line) or line.startswith("# ") or NOTE.match(line))


def heading(tree: Tree, parent: int, depth: int, level: int, text: str, line: int) -> None:
    name = tree.heading_id(re.sub(r"!!|\*\*|//|__|~~|\?\?|\^\^|,,|``", "", text))
    node = tree.add(parent, depth, "element", f"h{min(level, 6)}", {"id": name} if name else {}, line=line)
    inline(tree, node, depth + 1, text, line)


def blocks(tree: Tree, parent: int, depth: int, lines: list[tuple[int, str]]) -> None:
    """The blocks of lines whose own level is column 0."""
    at = 0
    while at < len(lines):
        n, line = lines[at]
        if not line.strip() or line.startswith("# ") or line.strip() == "#":
            at += 1
        elif columns(line) >= 2:
            end = deeper(lines, at, 2)
            node = tree.add(parent, depth, "element", "div", line=n)
            blocks(tree, node, depth + 1, [(k, cut(x, 2)) for k, x in lines[at:end]])
            at = end
        elif m := HEADING.match(line := line.strip()):
            heading(tree, parent, depth, len(m[1]), m[2], n)
            at += 1
        elif RULE.match(line):
            tree.add(parent, depth, "element", "hr", line=n)
            at += 1
        elif m := FENCE.match(line):
            indent = columns(lines[at][1])
            end = next((i for i in range(at + 1, len(lines)) if re.match(rf"^\s*{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[i][1])), len(lines))
            pre = tree.add(parent, depth, "element", "pre", line=n)
            code = tree.add(pre, depth + 1, "element", "code", {"class": f"language-{m[2]}"} if m[2] else {}, line=n)
            tree.add(code, depth + 2, "text", value="".join(cut(x, indent) + "\n" for _, x in lines[at + 1 : end]), line=n + 1)
            at = end + 1
        elif OPENER.match(line) or line.lower().startswith("<!doctype"):
            at = element(tree, parent, depth, lines, at)
        elif ITEM.match(line):
            at = items(tree, parent, depth, lines, at)
        elif (end := table(tree, parent, depth, lines, at)) > at:
            at = end
        else:
            end = at + 1
            while end < len(lines) and (x := lines[end][1]).strip() and columns(x) < 2 and not UNDERLINE.match(x) and not begins_block(x):
                end += 1
            text = " ".join(x.strip() for _, x in lines[at:end])
            if end < len(lines) and (u := UNDERLINE.match(lines[end][1])):
                heading(tree, parent, depth, 1 if u[1] else 2, text, n)
                end += 1
            else:
                node = tree.add(parent, depth, "element", "p", line=n)
                inline(tree, node, depth + 1, text, n)
            at = end


def element(tree: Tree, parent: int, depth: int, lines: list[tuple[int, str]], at: int) -> int:
    n, line = lines[at]
    line = line.strip()
    end = deeper(lines, at + 1, columns(lines[at][1]) + 2)
    if line.lower().startswith("<!doctype"):
        tree.add(parent, depth, "doctype", line=n)
        return at + 1
    m = OPENER.match(line)
    tag, rest, props = (m[1] or "div").lower(), line[m.end() :], {}
    while rest.strip() and not rest.lstrip().startswith(">") and (a := ATTRIBUTE.match(rest)) and a.end():
        props[a[1]] = a[2].strip("\"'") if a[2] else ""
        rest = rest[a.end() :]
    text = rest.strip().removeprefix(">").strip()
    node = tree.add(parent, depth, "element", tag, props, line=n)
    inner = [(k, cut(x, 2)) for k, x in lines[at + 1 : end]]
    if tag in VOID:
        return end
    if tag in RAW:
        tree.add(node, depth + 1, "text", value="\n".join([*([text] if text else []), *(x for _, x in inner)]), line=n)
        return end
    if text:
        inline(tree, node, depth + 1, text, n)
    blocks(tree, node, depth + 1, inner)
    return end


def items(tree: Tree, parent: int, depth: int, lines: list[tuple[int, str]], at: int) -> int:
    """The end of the list that begins at a line. Lines that are no items go on an item's text; a blank
    line between items makes the whole list loose: each item's text is a paragraph."""
    found, loose, blank, end = [], False, False, at
    for i in range(at, len(lines)):
        n, line = lines[i]
        bare = line.strip()
        if not bare:
            blank = True
            continue
        if HEADING.match(bare) or RULE.match(bare):
            break
        if m := ITEM.match(bare):
            loose |= blank
            found.append({"indent": columns(line), "ordered": m[1][0].isdigit(), "start": m[1][:-1], "text": [m[2]], "line": n, "source": line})
        elif blank:
            break
        else:
            found[-1]["text"].append(bare)
        blank, end = False, i + 1
    roots: list[dict] = []
    open_lists: list[dict] = []
    for item in found:
        while open_lists and item["indent"] < open_lists[-1]["indent"]:
            open_lists.pop()
        if open_lists and item["indent"] == open_lists[-1]["indent"] and item["ordered"] != open_lists[-1]["ordered"]:
            open_lists.pop()
        if not open_lists or item["indent"] > open_lists[-1]["indent"]:
            made = {"indent": item["indent"], "ordered": item["ordered"], "items": []}
            (open_lists[-1]["items"][-1]["lists"] if open_lists else roots).append(made)
            open_lists.append(made)
        open_lists[-1]["items"].append(item | {"lists": []})
    for made in roots:
        one_list(tree, parent, depth, made, loose)
    return end


def one_list(tree: Tree, parent: int, depth: int, made: dict, loose: bool) -> None:
    entries = made["items"]
    tasks = any(TASK.match(e["text"][0]) for e in entries)
    start = int(entries[0]["start"]) if made["ordered"] else 1
    props = ({"class": "contains-task-list"} if tasks else {}) | ({"start": str(start)} if start != 1 else {})
    node = tree.add(parent, depth, "element", "ol" if made["ordered"] else "ul", props, line=entries[0]["line"])
    for e in entries:
        n, text = e["line"], " ".join(e["text"])
        task = TASK.match(text)
        li = tree.add(node, depth + 1, "element", "li", {"class": "task-list-item"} if task else {}, f"{task[1]}:{e['source'].index('[') + 2}" if task else None, line=n)
        to, deep = (tree.add(li, depth + 2, "element", "p", line=n), depth + 3) if loose else (li, depth + 2)
        if task:
            tree.add(to, deep, "element", "input", {"type": "checkbox", **({"checked": ""} if task[1] == "x" else {}), "disabled": ""}, line=n)
            text = " " + task[2] if task[2] else ""
        inline(tree, to, deep, text, n)
        for inner in e["lists"]:
            one_list(tree, li, depth + 2, inner, loose)


def cells(line: str) -> list[str]:
    line = re.sub(r"(?<!\\)\|$", "", line.strip().removeprefix("|"))
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def delimiter(line: str) -> list[str | None] | None:
    row = cells(line)
    if "|" not in line or not all(re.fullmatch(r":?-+:?", c) for c in row):
        return None
    return [{(True, True): "center", (False, True): "right", (True, False): "left"}.get((c[0] == ":", c[-1] == ":")) for c in row]


def table(tree: Tree, parent: int, depth: int, lines: list[tuple[int, str]], at: int) -> int:
    """The end of the table that begins at a line, or the line itself if none does."""
    head, caption = at, None
    if lines[at][1].lstrip().startswith("|") and at + 2 < len(lines) and len(cells(lines[at][1])) == 1 and not delimiter(lines[at + 1][1]) and delimiter(lines[at + 2][1]):
        head, caption = at + 1, cells(lines[at][1])[0]
    if head + 1 >= len(lines) or "|" not in lines[head][1] or not (align := delimiter(lines[head + 1][1])) or len(align) != len(cells(lines[head][1])):
        return at
    end = head + 2
    while end < len(lines) and (x := lines[end][1]).strip() and columns(x) < 2 and not (HEADING.match(x) or RULE.match(x) or OPENER.match(x)):
        end += 1
    node = tree.add(parent, depth, "element", "table", line=lines[at][0])
    if caption is not None:
        inline(tree, tree.add(node, depth + 1, "element", "caption", line=lines[at][0]), depth + 2, caption, lines[at][0])
    for group, tag, part in (("thead", "th", lines[head : head + 1]), ("tbody", "td", lines[head + 2 : end])):
        if part:
            g = tree.add(node, depth + 1, "element", group, line=part[0][0])
            for n, x in part:
                tr = tree.add(g, depth + 2, "element", "tr", line=n)
                row = cells(x)
                for i, how in enumerate(align):
                    cell = tree.add(tr, depth + 3, "element", tag, {"style": f"text-align: {how}"} if how else {}, line=n)
                    inline(tree, cell, depth + 4, row[i] if i < len(row) else "", n)
    return end


def take_notes(tree: Tree, lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Lines without the definitions of notes, which go to the tree; lines under a definition join it."""
    kept, note = [], None
    fence = None
    for n, line in lines:
        mark = FENCE.match(line.strip())
        if fence or mark:
            fence = None if fence and mark and mark[1][0] == fence else fence or mark[1][0]
            kept.append((n, line))
            note = None
        elif m := NOTE.match(line):
            note = m[1].strip()
            tree.notes.setdefault(note, m[2])
        elif note is not None and line.strip():
            tree.notes[note] += " " + line.strip()
        else:
            note = None
            kept.append((n, line))
    return kept


def foot(tree: Tree, root: int) -> None:
    """The section of notes; notes that only notes refer to follow them."""
    section = tree.add(root, 1, "element", "section", {"data-footnotes": "", "class": "footnotes"})
    h = tree.add(section, 2, "element", "h2", {"class": "sr-only", "id": "footnote-label"})
    tree.add(h, 3, "text", value="Footnotes")
    ol, k = tree.add(section, 2, "element", "ol"), 0
    while k < len(tree.cited):
        note = list(tree.cited)[k]
        k += 1
        li = tree.add(ol, 3, "element", "li", {"id": f"user-content-fn-{k}"})
        p = tree.add(li, 4, "element", "p")
        inline(tree, p, 5, tree.notes[note], 0)
        for again in range(1, tree.cited[note] + 1):
            tree.add(p, 5, "text", value=" ")
            back = tree.add(p, 5, "element", "a", {"href": f"#user-content-fnref-{k}" + (f"-{again}" if again > 1 else ""), "data-footnote-backref": "", "aria-label": "Back to content", "class": "data-footnote-backref"})
            tree.add(back, 6, "text", value="↩")
            if again > 1:
                tree.add(tree.add(back, 6, "element", "sup"), 7, "text", value=str(again))


def parse(text: str) -> list[list]:
    tree = Tree()
    root = tree.add(-1, 0, "root")
    blocks(tree, root, 1, take_notes(tree, list(enumerate((text or "").split("\n"), 1))))
    if tree.cited:
        foot(tree, root)
    return tree.rows


def parse_stream(text: str, wrapper: str | None = "article") -> list[list]:
    """All documents of a stream (parted by `---` lines) in one tree, each in a wrapper or bare. Their
    headings share one run of ids; notes past the first document are numbered with its place before."""
    whole = Tree()
    root = whole.add(-1, 0, "root")
    parts, first = [], 1
    for part in re.split(r"(?m)^---[ \t]*$\n?", text or ""):
        if part.strip():
            parts.append((first, part))
        first += part.count("\n") + (0 if part.endswith("\n") or not part else 1)
    for k, (first, part) in enumerate(parts or [(1, "")]):
        tree = Tree()
        tree.ids = whole.ids
        inner = tree.add(-1, 0, "root")
        matter = re.match(r"\s*?(?:^|(?<=\n))[ \t]*\+\+\+[ \t]*\n(?:[\s\S]*?\n)??\+\+\+[ \t]*(?:\n|$)", part)
        body, skipped = (part[matter.end() :], part[: matter.end()].count("\n")) if matter else (part, 0)
        blocks(tree, inner, 1, take_notes(tree, list(enumerate(body.split("\n"), first + skipped))))
        if tree.cited:
            foot(tree, inner)
        at = whole.add(root, 1, "element", wrapper, line=first) if wrapper else root
        moved = {inner: at}
        deeper_by = 1 if wrapper else 0
        for n, parent, depth, _, kind, tag, props, value, line in tree.rows[1:]:
            if k and (kind == "element"):
                props = {a: re.sub(r"user-content-(fn|fnref)-", rf"user-content-\1-{k}-", v) for a, v in props.items()}
            moved[n] = whole.add(moved[parent], depth + deeper_by, kind, tag, props, value, line)
    return whole.rows


def h(selector: str, props: dict | None = None, *children) -> dict:
    """A hand-built node: `tag.class#id`, attributes, and children (texts, nodes or lists of them;
    None and False are left out)."""
    tag = re.match(r"[\w-]*", selector)[0] or "div"
    classes, names = re.findall(r"\.([\w-]+)", selector), re.findall(r"#([\w-]+)", selector)
    found = ({"class": " ".join(classes)} if classes else {}) | ({"id": names[0]} if names else {}) | {k: str(v) for k, v in (props or {}).items()}
    flat: list = []
    stack = list(reversed(children))
    while stack:
        c = stack.pop()
        if isinstance(c, (list, tuple)):
            stack.extend(reversed(c))
        elif c is not None and c is not False:
            flat.append(c if isinstance(c, dict) else str(c))
    return {"tag": tag, "props": found, "children": flat}


def node_rows(node: dict) -> list[list]:
    """The rows of a hand-built tree, below a root."""
    tree = Tree()

    def put(x, parent: int, depth: int) -> None:
        if isinstance(x, str):
            tree.add(parent, depth, "text", value=x)
        else:
            at = tree.add(parent, depth, "element", x["tag"], x["props"])
            for c in x["children"]:
                put(c, at, depth + 1)

    put(node, tree.add(-1, 0, "root"), 1)
    return tree.rows


def process(table: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """HTML after transforms of the node table, each a function of one table to another."""
    for step in steps:
        table = step(table)
    return to_html(table)


NODE_FIELDS = [("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("ord", pa.int32()), ("type", pa.string()), ("tag", pa.string()), ("props", pa.map_(pa.string(), pa.string())), ("value", pa.string()), ("line", pa.int32())]


def _nodes(parser: Callable[[str], list[list]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = parser(text)
                columns = [pa.array([r[i] if i != 6 else list(r[i].items()) for r in rows], kind) for i, (_, kind) in enumerate(NODE_FIELDS)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.int64()), *columns], ["doc_index", *(n for n, _ in NODE_FIELDS)])

    return run


def nodes(docs: DataFrame, key: str = "doc_index", text: str = "content", parser: Callable[[str], list[list]] = parse) -> DataFrame:
    """The node table of documents: doc_index and NODE_SCHEMA. parser: this language's, or that of its
    streams (`parse_stream`) or of Markdown."""
    from ..schema import NODE_SCHEMA

    return docs.select(F.col(key).cast("long").alias("doc_index"), text).mapInArrow(_nodes(parser), f"doc_index long, {NODE_SCHEMA}")


def _stops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            stop, open_nodes = {}, []
            for r in rows:
                while open_nodes and open_nodes[-1][1] >= r["depth"]:
                    stop[open_nodes.pop()[0]] = r["node_id"]
                open_nodes.append((r["node_id"], r["depth"]))
            ids = [r["node_id"] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([doc] * len(ids), pa.int64()), pa.array(ids, pa.int32()), pa.array([stop.get(i, 2**31 - 1) for i in ids], pa.int32())], ["_doc", "_node", "stop"])


def spans(table: DataFrame) -> DataFrame:
    """table with stop: the node after the last of its subtree. One pass over each document's depths."""
    packed = table.groupBy("doc_index").agg(F.array_sort(F.collect_list(F.struct("node_id", "depth"))).alias("nodes"))
    stops = packed.mapInArrow(_stops, "_doc long, _node int, stop int")
    return table.join(stops, (F.col("doc_index") == F.col("_doc")) & (F.col("node_id") == F.col("_node"))).drop("_doc", "_node")


def text_of(table: DataFrame) -> DataFrame:
    """(doc_index, text): all text of each document, in order."""
    packed = F.array_sort(F.collect_list(F.when(F.col("type") == "text", F.struct("node_id", "value"))))
    return table.groupBy("doc_index").agg(F.array_join(F.transform(packed, lambda x: x["value"]), "").alias("text"))


def headings(table: DataFrame) -> DataFrame:
    """(doc_index, node_id, depth, text, slug) of headings, in order. A heading is one line, so its
    text is what stands on that line after it: one window over each document's nodes."""
    w = W.partitionBy("doc_index").orderBy("node_id").rowsBetween(W.unboundedPreceding, 0)
    head = F.when(F.col("tag").rlike("^h[1-6]$"), F.struct("node_id", "line", F.substring("tag", 2, 1).cast("int").alias("depth"), F.col("props")["id"].alias("slug")))
    seen = table.select("doc_index", "node_id", "type", "value", "line", F.last(head, ignorenulls=True).over(w).alias("h"))
    own = seen.where((F.col("line") == F.col("h.line")) & (F.col("type").isin("text") | (F.col("node_id") == F.col("h.node_id"))))
    parts = F.array_sort(F.collect_list(F.when(F.col("type") == "text", F.struct("node_id", "value"))))
    packed = own.groupBy("doc_index", "h").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("text"))
    return packed.select("doc_index", "h.node_id", "h.depth", "text", "h.slug").orderBy("doc_index", "node_id")


def links(table: DataFrame) -> DataFrame:
    """(doc_index, node_id, href) of links."""
    return table.where("tag = 'a'").select("doc_index", "node_id", F.col("props")["href"].alias("href"))


def tasks(table: DataFrame) -> DataFrame:
    """(doc_index, line, column, done) of task items: where their mark stands and what it is."""
    found = table.where((F.col("tag") == "li") & F.col("value").isNotNull())
    return found.select("doc_index", "line", F.substring_index("value", ":", -1).cast("int").alias("column"), F.startswith(F.col("value"), F.lit("x")).alias("done"))


def visit(table: DataFrame, test: str) -> DataFrame:
    """Nodes of a type or an element name, in preorder."""
    return table.where((F.col("type") == test) | (F.col("tag") == test)).orderBy("doc_index", "node_id")


def sanitize(table: DataFrame) -> DataFrame:
    """The table without what is not on the lists: dangerous elements go with their subtrees, unknown
    ones become `div`, attributes are checked by the element as it was written, addresses by scheme."""
    from ..functions.text import allowed_protocol

    gone = spans(table).where(F.lower("tag").isin(STRIP)).select(F.col("doc_index").alias("d"), F.col("node_id").alias("a"), F.col("stop").alias("z"))
    kept = table.join(gone, (F.col("doc_index") == F.col("d")) & (F.col("node_id") >= F.col("a")) & (F.col("node_id") < F.col("z")), "left_anti")
    tag = F.lower("tag")
    allowed = F.create_map(*[x for k, names in ATTRIBUTES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in names.split()]))])
    own = F.concat(F.try_element_at(allowed, F.lit("*")), F.coalesce(F.try_element_at(allowed, F.coalesce(tag, F.lit(""))), F.array().cast("array<string>")))
    named = F.transform_keys("props", lambda k, v: F.lower(k))
    known = kept.withColumns({"_own": own, "props": F.when(F.size("props") > 0, named), "tag": F.when(tag.isin(TAGS) | F.col("tag").isNull(), F.col("tag")).otherwise("div")})
    ok = lambda k, v: (F.array_contains("_own", k) | k.rlike(r"^(aria-[a-z-]+|data-[\w-]+)$")) & F.when(k == "href", allowed_protocol(v, SCHEMES["href"])).when(k.isin("src", "cite"), allowed_protocol(v, SCHEMES["src"])).otherwise(True)
    return known.withColumn("props", F.coalesce(F.map_filter("props", ok), F.create_map().cast("map<string,string>"))).drop("_own")


def write_html(rows: list[dict]) -> str:
    """HTML of one document's nodes in preorder; a fragment is its children."""
    out: list[str] = []
    open_tags: list[tuple[int, str]] = []
    for r in rows:
        while open_tags and open_tags[-1][0] >= r["depth"]:
            out.append(open_tags.pop()[1])
        if r["type"] == "text":
            out.append(html.escape(r["value"] or "", quote=False))
        elif r["type"] == "comment":
            out.append(f"<!--{r['value']}-->")
        elif r["type"] == "doctype":
            out.append("<!doctype html>")
        elif r["type"] == "element":
            attrs = "".join(f' {k}="{html.escape(v)}"' if v else f" {k}" for k, v in (r["props"] or []))
            out.append(f"<{r['tag']}{attrs}>")
            if r["tag"] not in VOID:
                open_tags.append((r["depth"], f"</{r['tag']}>"))
        elif r["type"] == "fragment":
            open_tags.append((r["depth"], ""))
    out += [end for _, end in reversed(open_tags)]
    return "".join(out)


def _html(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([write_html(rows) for rows in batch.column(1).to_pylist()], pa.string())], ["doc_index", "html"])


def to_html(table: DataFrame) -> DataFrame:
    """(doc_index, html): each document's nodes, packed by key, written in Arrow batches."""
    packed = table.groupBy("doc_index").agg(F.array_sort(F.collect_list(F.struct("node_id", "depth", "type", "tag", F.map_entries("props").alias("props"), "value"))).alias("nodes"))
    shaped = packed.select("doc_index", F.transform("nodes", lambda n: F.struct(n["node_id"].alias("node_id"), n["depth"].alias("depth"), n["type"].alias("type"), n["tag"].alias("tag"), F.map_from_entries(n["props"]).alias("props"), n["value"].alias("value"))).alias("nodes"))
    return shaped.mapInArrow(_html, "doc_index long, html string")


def toc(found: DataFrame) -> DataFrame:
    """(doc_index, toc): headings with ids as an indented list, the least depth at the edge."""
    low = F.array_min(F.transform("hs", lambda h: h["depth"]))
    lines = F.transform("hs", lambda h: F.concat(F.repeat(F.lit("  "), h["depth"] - low), F.lit("- [["), h["text"], F.lit("|#"), h["slug"], F.lit("]]")))
    packed = found.where("slug is not null").groupBy("doc_index").agg(F.array_sort(F.collect_list(F.struct("node_id", "depth", "text", "slug"))).alias("hs"))
    return packed.select("doc_index", F.array_join(lines, "\n").alias("toc"))
