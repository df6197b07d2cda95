"""`python -m vellum find DIR [FILTER]`: the documents of a directory that match, one JSON record a line.
`python -m vellum build DIR OUT [-d NAME=VALUE]...`: runs the directory's entry (`main.mdy`, else its first
document) and writes what it emits, and its own page as `index.html` if it wrote any text.
`python -m vellum html DIR OUT`: every document, its code run, as HTML files below OUT.
`python -m vellum dead FILE [NAME] [FROM] [MAX]`: dead letters of a table of delivered messages."""

from __future__ import annotations

import json
import os
import sys
from urllib.parse import urlparse


def context(words: list[str]) -> dict:
    """`-d name=value` options as data: a value that is JSON is read as such, any other is a text."""
    found = {}
    for name, _, value in (w.partition("=") for flag, w in zip(words, words[1:]) if flag == "-d"):
        try:
            found[name] = json.loads(value)
        except ValueError:
            found[name] = value
    return found


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("find", "build", "html", "dead") or args[0] in ("build", "html") and len(args) < 3:
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .functions.text import url_to_out_file
    from .operators.docset import DocSet
    from .plans import site
    from .plans.page import Pages
    from .sources.files import walk_raw
    from .streaming import bus

    spark = SparkSession.builder.appName("vellum").getOrCreate()
    if args[0] == "dead":
        letters = bus.dead_letters(spark.read.parquet(args[1]), *args[2:3], start=int((args[3:4] or ["1"])[0]), top=int((args[4:5] or ["100"])[0]))
        for row in letters.toJSON().toLocalIterator():
            print(row)
        return 0
    docs = DocSet(walk_raw(spark, args[1]))
    if args[0] == "find":
        for row in docs.find(json.loads(args[2]) if len(args) > 2 else None).select("data_json").toLocalIterator():
            print(row.data_json)
        return 0

    def module(path: str) -> str:
        with open(os.path.join(urlparse(args[1]).path, path), encoding="utf-8") as f:
            return f.read()

    req, pages = context(args[3:]), Pages(docs, load=module)
    if args[0] == "build":
        entry = docs.find_one({"path": "main.mdy"}).select("doc_index").first() or docs.find_one({"ext": ".mdy"}).select("doc_index").first()
        if entry is None:
            print("no document to begin with", file=sys.stderr)
            return 1
        html = pages.html(entry.doc_index, req)
        outputs = ({"index.html": html} if html.strip() else {}) | pages.outputs
        rows = spark.createDataFrame(sorted(outputs.items()) or [], "path string, content string")
        print(site.write_outputs(rows, args[2]))
        for m in pages.messages:
            print(json.dumps(m, ensure_ascii=False))
        return 0
    found = docs.find({"ext": ".mdy"}).select("doc_index", "path")
    made = [(r.path, pages.html(r.doc_index, req)) for r in found.toLocalIterator()]
    rows = spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "seq long, path string, html string")
    outputs = site.emit(rows, url_to_out_file(F.regexp_replace("path", r"\.mdy$", "")), F.col("html"), F.col("seq"))
    print(site.write_outputs(outputs, args[2]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
