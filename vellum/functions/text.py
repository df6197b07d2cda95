"""Scalar functions of the engine, all column expressions: they run inside whole-stage plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that an index leaves out.
STOPWORDS = """a an and are as at be but by for if in into is it no not of on or such that the their then there these they
this to was will with""".split()


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once a row even if lambdas in body read it repeatedly."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenize(text: Column) -> Column:
    """Distinct index words in order of first appearance: ASCII letters and digits, longer than one, no stopwords."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def slugify(text: Column) -> Column:
    """Lower case, each run of other characters than ASCII letters and digits one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def heading_slug(text: Column) -> Column:
    """An anchor or a page name: trimmed, lower case, white space one hyphen, letters, digits and - / . _ # kept."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-"), r"[^\p{L}\p{N}\-/._#]+", "")


def normalize_date(value: Column) -> Column:
    """YYYY-MM-DD of a text that begins with such a date or with YYYY-MM (the first); else null."""
    found = lambda i: F.regexp_extract(F.trim(value), r"^(\d{4})-(\d{2})(?:-(\d{2}))?", i)
    day = F.when(found(3) == "", "01").otherwise(found(3))
    return F.when(found(1) != "", F.concat_ws("-", found(1), found(2), day))


def rfc822(date: Column) -> Column:
    """`Sat, 18 Jul 2026 00:00:00 GMT` of YYYY-MM-DD. Days past a month's end roll over; no date: `Invalid Date`."""
    part = lambda i: F.regexp_extract(date, r"^(\d{4})-(\d{2})-(\d{2})$", i)
    y, m, d = (F.try_to_number(part(i), F.lit("9999")).cast("int") for i in (1, 2, 3))
    first = F.when((m >= 1) & (m <= 12), F.make_date(y, m, F.lit(1)))
    rolled = F.when((d >= 1) & (d <= 31), F.date_add(first, d - 1))
    return F.when(date.isNotNull(), F.coalesce(F.date_format(rolled, "EEE, dd MMM yyyy '00:00:00 GMT'"), F.lit("Invalid Date")))


def message_name(declared: Column, path: Column) -> Column:
    """The declared name if it is not empty, else the path without extension and with dots for slashes, else null."""
    derived = F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit("."))
    return F.coalesce(F.nullif(declared, F.lit("")), F.when(path != "", derived))


def name_problem(name: Column) -> Column:
    """Why a message name is not allowed; null if it is."""
    return (
        F.when(name.isNull() | (name == ""), "must be a non-empty string")
        .when(~name.rlike(r"^[A-Za-z0-9_.-]{1,128}\z"), "may only contain letters, digits, _ . - and have 1 to 128 characters")
        .when(name.startswith(".") | name.endswith("."), "must not start or end with a dot")
        .when(name.contains(".."), "must not contain two dots in a row")
    )


def url_to_out_file(url: Column) -> Column:
    path = F.regexp_replace(url, "^/+|/+$", "")
    return F.when(path == "", "index.html").otherwise(F.concat(path, F.lit("/index.html")))


def link_kind(href: Column) -> Column:
    """fragment, internet or page."""
    return F.when(href.startswith("#"), "fragment").when(href.startswith("//") | href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), "internet").otherwise("page")


def normalize_link(href: Column) -> Column:
    return F.regexp_replace(F.lower(href), r"\s+", "-")


def find_links(text: Column) -> Column:
    """array of bare URLs: with a scheme or `//`, and mail addresses; trailing marks belong to the sentence."""
    return F.regexp_extract_all(text, F.lit(r"(?i)(?:https?://|ftp://|mailto:|(?<![\w:/])//)[^\s<>\"'|]*[^\s<>\"'|.,;:!?)\]]|(?<![\w.+\-@/])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[a-z]{2,}"), F.lit(0))


def allowed_protocol(url: Column, protocols: list[str]) -> Column:
    """Whether a URL is relative or has one of the schemes, after the characters browsers skip are gone."""
    bare = F.regexp_replace(url, r"[\x00-\x20\x7f]", "")
    scheme = F.regexp_extract(bare, r"^([^:/?#]*):", 1)
    has = bare.rlike(r"^[^:/?#]*:")
    return ~has | F.lower(scheme).isin(protocols)


def hash_string(text: Column) -> Column:
    """A stable fingerprint."""
    return F.xxhash64(text)


def extract_imports(text: Column) -> Column:
    """array of (name, spec) of `% import name from "spec"` lines."""
    lines = F.regexp_extract_all(text, F.lit(r"""(?m)^[ \t]*%[ \t]*import[ \t]+([A-Za-z_$][\w$]*)[ \t]+from[ \t]+["']([^"']+)["'][ \t]*;?[ \t]*$"""), F.lit(0))
    part = lambda line, i: F.regexp_extract(line, r"""import[ \t]+([A-Za-z_$][\w$]*)[ \t]+from[ \t]+["']([^"']+)""", i)
    return F.transform(lines, lambda line: F.struct(part(line, 1).alias("name"), part(line, 2).alias("spec")))


def body_tags(body: Column) -> Column:
    """Hashtags of a raw body, lower case, in order of first appearance: # after white space, then a
    letter. Code lines and blocks, fences, inline code and interpolations hold none."""
    bare = F.regexp_replace(body, r"(?m)^[ \t]*%%[ \t]*\n(?:(?![ \t]*%%[ \t]*$).*(?:\n|\z))*(?:[ \t]*%%[ \t]*$)?", "")
    bare = F.regexp_replace(bare, r"(?m)^[ \t]*%.*$", "")
    bare = F.regexp_replace(bare, r"(?m)^\s*(?:```|~~~).*\n(?:(?!\s*(?:```|~~~)).*(?:\n|\z))*(?:\s*(?:```|~~~).*$)?", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)\{\{.*?\}\}", " "), r"`[^`\n]*`", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?mU)(?<=^|\s)#(\p{L}[\p{L}\p{N}_-]*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.lower(t)))


def inline_references(text: Column, sigil: str) -> Column:
    """Names after a sigil (# or @) in running text: begin with a letter or _, no word character before."""
    found = F.regexp_extract_all(text, F.lit(rf"(?U)(?<![\p{{L}}\p{{N}}_]){sigil}([\p{{L}}_](?:[\p{{L}}\p{{N}}_-]*[\p{{L}}\p{{N}}_])?)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.lower(t)))


def wiki_links(text: Column) -> Column:
    """array of (label, url) of `[[ label | url ]]`; without a url the label's slug."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[((?:(?!\]\])[\s\S])+)\]\]"), F.lit(1))

    def one(inside: Column) -> Column:
        label = F.trim(F.regexp_extract(inside, r"^((?:\\.|[^|\\])*)", 1))
        url = F.trim(F.regexp_extract(inside, r"^(?:\\.|[^|\\])*\|([\s\S]*)$", 1))
        return F.struct(F.replace(label, F.lit("\\|"), F.lit("|")).alias("label"), F.when(url == "", heading_slug(label)).otherwise(url).alias("url"))

    return F.filter(F.transform(found, one), lambda x: x["label"] != "")


def typography(text: Column) -> Column:
    """Ellipsis, em dash and arrows as single characters; an arrow stands against none of the
    characters that arrows are drawn with."""
    for mark, char in (("<-->", "↔"), ("<==>", "⇔"), ("-->", "→"), ("<--", "←"), ("==>", "⇒"), ("<==", "⇐")):
        text = F.regexp_replace(text, rf"(?<![-=<>]){mark}(?![-=<>])", char)
    return F.regexp_replace(F.regexp_replace(text, r"(?<!-)--(?!-)", "—"), r"(?<!\.)\.\.\.(?!\.)", "…")


#: Shortcodes and emoticons.
EMOJI = {"smile": "😄", "grin": "😁", "joy": "😂", "heart": "❤️", "thumbsup": "👍", "+1": "👍", "thumbsdown": "👎", "-1": "👎", "tada": "🎉", "rocket": "🚀", "fire": "🔥", "star": "⭐", "warning": "⚠️", "bulb": "💡", "eyes": "👀", "wave": "👋", "ok_hand": "👌", "bug": "🐛", "sparkles": "✨", "white_check_mark": "✅", "x": "❌"}
EMOTICONS = {":)": "🙂", ":-)": "🙂", ":(": "🙁", ":-(": "🙁", ";)": "😉", ";-)": "😉", ":D": "😀", ":-D": "😀", ":P": "😛", "<3": "❤️"}


def emoji(text: Column, table: dict[str, str] | None = None) -> Column:
    """`:name:` shortcodes and free-standing emoticons as characters; unknown names stay."""
    for name, char in (table or EMOJI).items():
        text = F.replace(text, F.lit(f":{name}:"), F.lit(char))
    for mark, char in EMOTICONS.items():
        escaped = "".join("\\" + c if not c.isalnum() and c != "<" else c for c in mark)
        text = F.regexp_replace(text, rf"(?<=^|\s){escaped}(?=$|\s)", char)
    return text


def resize_target(path: Column, ext: Column, width: Column, height: Column, to_width: int | None = None, to_height: int | None = None) -> Column:
    """(path, url, width, height) of an image brought to a size; the missing side keeps the aspect, at least 1."""
    if to_width is None and to_height is None:
        raise ValueError("resize: pass at least one of width, height")
    half_up = lambda x: F.greatest(F.lit(1), F.floor(x + 0.5).cast("int"))
    w = half_up(F.lit(float(to_width))) if to_width is not None else half_up(F.lit(float(to_height)) / height * width)
    h = half_up(F.lit(float(to_height))) if to_height is not None else half_up(F.lit(float(to_width)) / width * height)
    stem = F.regexp_replace(F.substring(path, F.lit(1), F.length(path) - F.length(ext)), "^static/", "")
    out = F.concat(stem, F.lit("-"), w.cast("string"), F.lit("x"), h.cast("string"), ext)
    return F.struct(out.alias("path"), F.concat(F.lit("/"), out).alias("url"), w.alias("width"), h.alias("height"))


def table_markup(rows: Column) -> Column:
    """A table's markup of an array of arrays of cells: the first row is the header, null cells are empty."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(rows, F.lit(0)))))
    return F.when(F.size(rows) > 0, F.concat_ws("\n", line(F.get(rows, F.lit(0))), rule, F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)))


def context_value(text: Column) -> Column:
    """A value given as text: JSON if it is JSON, else the text itself; as JSON text."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', 1))
