"""Behaviour of the engine that tables do not show: grammar, precedence, errors, order."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.functions import guest as G
from vellum.functions import text as T
from vellum.operators import relational as R
from vellum.operators.docset import DocSet
from vellum.operators.filters import FilterError
from vellum.plans import markup, site, template
from vellum.sources import files, ingest, yaml12
from vellum.sources.ingest import split_documents, take_data_fences
from vellum.streaming import bus


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def names(df, field="name"):
    return [json.loads(r.data_json).get(field) for r in df.collect()]


@pytest.fixture(scope="module")
def people(spark):
    text = "\n---\n".join(f"+++\n{m}\n+++\n{b}" for m, b in [
        ("name: Ada\nage: 36\nkind: person", "likes #Maths"),
        ("name: Bo\nage: '41'\nkind: person", ""),
        ("name: Cy\nage: 41\nkind: person\ntags: [Maths, Tea]", "and #tea"),
        ("name: Uruk\nkind: place\npath: places/uruk.mdy", "x"),
        ("template: card\nage: null", "{{ req.name }} is {{ req.age ?? 'ageless' }}"),
    ])
    return DocSet.from_texts(spark, [text])


def test_filters(people):
    found = lambda q: names(people.find(q))
    assert found({"kind": "person"}) == ["Ada", "Bo", "Cy"]
    assert found({"age": {"$gt": 36}}) == ["Cy"] and found({"age": {"$gte": 36, "$lt": 41}}) == ["Ada"]
    assert found({"age": "41"}) == ["Bo"] and found({"age": 41.0}) == ["Cy"]
    assert found({"age": {"$exists": False}}) == ["Uruk"] and found({"age": None}) == ["Uruk", None]
    assert found({"kind": {"$ne": "person"}}) == ["Uruk", None]
    assert found({}) == found(None) == ["Ada", "Bo", "Cy", "Uruk", None]
    assert names(people.with_tag("MATHS")) == ["Ada", "Cy"] == found({"tags": "maths"})
    assert found({"path": "places/uruk.mdy"}) == ["Uruk"] and found({"_id": 2}) == ["Cy"]
    assert names(people.find_one({"age": {"$exists": True}})) == ["Ada"] and names(people.find_one({"kind": "ship"})) == []
    assert names(people.data(1)) == ["Bo"] and names(people.data(9)) == [] and people.count() == 5
    for bad in ({"age": {"$near": 1}}, {"$where": "1"}, {"$or": []}, "age"):
        with pytest.raises(FilterError):
            people.find(bad)
    asked = []
    DocSet(people.docs, asked.append).find({"kind": "place"})
    assert asked == [{"kind": "place"}]


def test_order_does_not_depend_on_partitions(people):
    scattered = DocSet(people.docs.repartition(7))
    assert names(scattered.find({"age": {"$exists": True}})) == names(people.find({"age": {"$exists": True}}))
    assert [r.doc_index for r in people.union(scattered).find().collect()] == list(range(10))


def test_render_each(people):
    docs = people.docs.where("doc_index in (0, 3, 4)")
    field = lambda n: F.get_json_object("data_json", f"$.{n}")
    out = template.render_each(docs, 4, F.struct(field("name").alias("name"), field("age").alias("age"))).collect()
    assert [r.output for r in out] == ["Ada is 36", "Uruk is ageless"]
    with pytest.raises(template.TemplateError):
        template.render_each(docs, 99, F.struct(field("name").alias("name")))


def test_templates(spark):
    rows = spark.createDataFrame([(1, [("a", 2), ("b", 3)]), (2, None)], "k int, items array<struct<n string, q int>>")
    text = "it's {{ req.k }}\\\n% for i of req.items\n* {{ i.n }}{{ i.q * 2 }}\n% if i.q > 2\nbig\n% end\n% end"
    assert [r.output for r in template.render_rows(rows, text, ["k", "items"]).collect()] == ["it's 1\\\n* a4\n* b6\nbig", "it's 2\\"]
    for bad in ("% for x of req.items", "% end", "% while 1"):
        with pytest.raises(template.TemplateError):
            template.template_sql(bad)
    with pytest.raises(template.TemplateError):
        template.compose({"a": ("x", ["b"]), "b": ("y", ["a"])}, rows, ["k"])


@pytest.mark.parametrize(
    ("source", "chunks"),
    [("a\n---\nb", ["a", "b"]), ("", [""]), (None, [""]), ("---\n---", [""]), ("a\n--- \n\n---\n b\n", ["a", " b"]), ("a --- b\n----\n-- -", ["a --- b\n----\n-- -"]), ("x\n\n---\n\ny", ["x\n", "\ny"])],
)
def test_split(spark, source, chunks):
    got = split_documents(spark.createDataFrame([(1, source)], "k int, text string"), keys=["k"]).orderBy("chunk_no")
    assert [r.chunk.rstrip("\n") for r in got.collect()] == [c.rstrip("\n") for c in chunks]


def test_data_fences():
    body, data = take_data_fences("a\n```data\nx: 1\n```\nb\n````js\n```data\ny: 2\n```\n````\n``` data extra\n```\n~~~data\nx: 3")
    assert data == [{"x": 1}, {"x": 3}] and body == "a\nb\n````js\n```data\ny: 2\n```\n````\n``` data extra\n```"
    with pytest.raises(ValueError):
        take_data_fences("```data\n- a list\n```")


def test_source_errors_name_the_document(spark):
    with pytest.raises(Exception, match="document 1: front matter must be a mapping"):
        DocSet.from_texts(spark, ["fine", "+++\n- a\n+++\n"]).find().collect()
    with pytest.raises(ValueError):
        DocSet.from_texts(spark, [{"text": "x", "meta": ["no"]}])


def test_meta_wins_and_order_of_merges(spark):
    s = DocSet.from_texts(spark, [{"text": "+++\na: 1\nb: 1\npath: forged\n+++\n```data\nb: 2\ntags: X\n```\n#y", "meta": {"path": "real.mdy"}}, "only #z"])
    first, second = (json.loads(r.data_json) for r in s.find().collect())
    assert first == {"a": 1, "b": 2, "path": "real.mdy", "tags": ["x", "y"]} and second == {"tags": ["z"]}


def test_yaml():
    text = "a: Yes\nb: on\nc: 2026-07-18\nd: 017\ne: 0o17\nf: 12:30:00\ng: 1e3\nh: .nan\ni: ~\nj: 4.0\nk: 0x1F\nl: [1, x]\ntrue: 1"
    assert json.loads(yaml12.to_json(text)) == {"a": "Yes", "b": "on", "c": "2026-07-18", "d": 17, "e": 15, "f": "12:30:00", "g": 1000, "h": None, "i": None, "j": 4, "k": 31, "l": [1, "x"], "true": 1}


def test_scalars(spark):
    assert one(spark, T.rfc822(F.lit("2024-02-31"))) == "Sat, 02 Mar 2024 00:00:00 GMT" and one(spark, T.rfc822(F.lit("soon"))) == "Invalid Date"
    assert one(spark, T.slugify(F.lit("--Hé llo, World!--"))) == "h-llo-world"
    assert one(spark, T.heading_slug(F.lit(" Été en  Été/x_1! "))) == "été-en-été/x_1"
    assert one(spark, T.tokenize(F.lit("The cat's ÉTÉ a1 a1 no"))) == ["cat", "a1"]
    assert one(spark, T.allowed_protocol(F.lit("java\tscript:x"), ["http"])) is False and one(spark, T.allowed_protocol(F.lit("/a:b"), [])) is True
    assert one(spark, T.find_links(F.lit("see https://a.b/c?d=1. or me@x.org, README.md"))) == ["https://a.b/c?d=1", "me@x.org"]
    assert [tuple(x) for x in one(spark, T.wiki_links(F.lit("[[ A B ]] [[x\\|y | /u ]] [[ ]]")))] == [("A B", "a-b"), ("x|y", "/u")]
    assert one(spark, T.inline_references(F.lit("#a_b- @no x#y (#Çd) #4"), "#")) == ["a_b", "çd"]
    assert one(spark, T.typography(F.lit("a... b --> c <-- d ==> e -- f -> ---> <=="))) == "a… b → c ← d ⇒ e — f -> ---> ⇐"
    assert one(spark, T.emoji(F.lit(":rocket: :) x:)"))) == "🚀 🙂 x:)"
    assert [tuple(x) for x in one(spark, T.extract_imports(F.lit('% import a from "./a"\ntext\n%import b from \'pkg\';')))] == [("a", "./a"), ("b", "pkg")]
    assert [one(spark, T.context_value(F.lit(x))) for x in ('{"a":1}', "1", "a b", 'q"')] == ['{"a":1}', "1", '"a b"', '"q\\""']
    image = T.resize_target(F.lit("static/i/p.png"), F.lit(".png"), F.lit(400), F.lit(300), to_width=100)
    assert tuple(one(spark, image)) == ("i/p-100x75.png", "/i/p-100x75.png", 100, 75)
    assert one(spark, T.table_markup(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1|2"), F.lit(None))))) == "| a | b |\n| --- | --- |\n| 1\\|2 |  |"


def test_guest(spark):
    s = F.lit("héllo héllo")
    checks = [
        (G.char_at(s, 1), 'é'),
        (G.at(s, -1), 'o'),
        (G.index_of(s, 'l'), 2),
        (G.last_index_of(s, 'hé'), 6),
        (G.last_index_of(s, 'z'), -1),
        (G.slice_(s, -5, -1), 'héll'),
        (G.slice_(s, 3, 1), ''),
        (G.substring(s, 3, 1), 'él'),
        (G.to_upper_case(s), 'HéLLO HéLLO'),
        (G.pad_start(F.lit('abc'), 2), 'abc'),
        (G.pad_end(F.lit('a'), 3, '-'), 'a--'),
        (G.replace_first(s, 'l', 'L'), 'héLlo héllo'),
        (G.parse_int(F.lit(' -12px')), -12),
        (G.parse_int(F.lit('x')), None),
        (G.parse_float(F.lit('1.5e2x')), 150.0),
        (G.number_text(F.lit(4.0)), '4'),
        (G.number_text(F.lit(float('nan'))), 'null'),
        (G.trunc(F.lit(-1.7)), -1.0),
        (G.round_(F.lit(-2.5)), -2),
        (G.is_integer(F.lit(2.0)), True),
        (G.find_index(F.array(F.lit(5), F.lit(7)), lambda x: x > 5), 1),
        (G.find(F.array(F.lit(5), F.lit(7)), lambda x: x > 9), None),
        (G.array_index_of(F.array(F.lit('a')), 'b'), -1),
        (G.array_slice(F.array(F.lit(1), F.lit(2), F.lit(3)), -2), [2, 3]),
        (G.reduce(F.array(F.lit(1), F.lit(2)), F.lit(0), lambda a, x: a + x), 3),
        (G.code_point_at(s, 1), 233),
        (G.split(F.lit('a.b'), '.'), ['a', 'b']),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(checks)]).first()
    assert list(row) == [v for _, v in checks]


def test_heading_ids_skip_taken_names(spark):
    rows = spark.createDataFrame([("d", i, s) for i, s in enumerate(["a", "a-1", "a", "a", "", "b"])], "doc string, pos int, slug string")
    assert [r.id for r in R.heading_ids(rows, "doc", "pos", "slug").orderBy("pos").collect()] == ["a", "a-1", "a-2", "a-3", None, "b"]


def looped_heading_ids(slugs):
    used, number, ids = set(), {}, []
    for s in slugs:
        n = number.get(s, 0)
        while (name := f"{s}-{n}" if n else s) in used:
            n += 1
        number[s] = n
        used.add(name if s else None)
        ids.append(name if s else None)
    return ids


@pytest.mark.parametrize("one_range", [True, False])
def test_heading_ids_are_those_of_a_loop_over_each_document(spark, monkeypatch, one_range):
    if not one_range:
        monkeypatch.setattr(ingest, "RANGE", 50)
    rng, names, rows = random.Random(3), ["a", "a-1", "a-2", "a-3", "a-1-1", "a-1-2", "a-1-1-1", "a-2-1", "a-01", "a-0", "-1", "b-7", "b", "", "c", "a-999999999999999999999"], []
    for d in [None, *map(str, range(30))]:
        few = rng.sample(names, rng.randrange(1, len(names)))
        rows += [(d, i, rng.choice(few)) for i in range(rng.randrange(1, 40))]
    want = {}
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        want |= dict(zip([r[:2] for r in own], looped_heading_ids([r[2] for r in own])))
    got = R.heading_ids(spark.createDataFrame(rng.sample(rows, len(rows)), "doc string, pos int, slug string"), "doc", "pos", "slug").collect()
    assert len(got) == len(rows) and {(r.doc, r.pos): r.id for r in got} == want


def test_heading_ids_of_one_long_document(spark):
    slug = F.when(F.col("id") % 1000 == 7, F.concat(F.lit("a-"), F.col("id").cast("string"))).otherwise("a")
    got = R.heading_ids(spark.range(60_000).select(F.lit("d").alias("doc"), F.col("id").alias("pos"), slug.alias("slug")), "doc", "pos", "slug")
    rows = sorted((r.pos, r.slug, r.id) for r in got.collect())
    assert [r[2] for r in rows] == looped_heading_ids([r[1] for r in rows])


def html_of(text):
    names = [n for n, _ in markup.NODE_FIELDS]
    return markup.write_html([dict(zip(names, r)) | {"props": list(r[6].items())} for r in markup.parse(text)])


@pytest.mark.parametrize(
    ("text", "html"),
    [
        ("= A !!b!!\n\none\ntwo `` x //y// ``", '<h1 id="a-b">A <strong>b</strong></h1><p>one two <code> x //y// </code></p>'),
        ("Title\n-----\n= Title\n========= x", '<h2 id="title">Title</h2><h1 id="title-1">Title</h1><h6 id="x">x</h6>'),
        ("<table class='a b' hidden\n  <tr\n    <td>first\n\n    <td id=x>!!2!!\nafter", '<table class="a b" hidden><tr><td>first</td><td id="x"><strong>2</strong></td></tr></table><p>after</p>'),
        ("Plain.\n\n  In.\n    Twice.", "<p>Plain.</p><div><p>In.</p><div><p>Twice.</p></div></div>"),
        ("< pre\n  ____\n    !!a!!\n<hr\n<!doctype html>", "<pre>____\n  !!a!!</pre><hr><!doctype html>"),
        ("- one\n- two\n  3. in\n- - x", '<ul><li>one</li><li>two<ol start="3"><li>in</li></ol></li><li>- x</li></ul>'),
        ("- [x] t\n- [X] u", '<ul class="contains-task-list"><li class="task-list-item"><input type="checkbox" checked disabled> t</li><li>[X] u</li></ul>'),
        ("| Cap\n| a | b |\n| :-: | --- |\n| p \\| q |\n| 1 | 2 | 3 |", '<table><caption>Cap</caption><thead><tr><th style="text-align: center">a</th><th>b</th></tr></thead><tbody><tr><td style="text-align: center">p | q</td><td></td></tr><tr><td style="text-align: center">1</td><td>2</td></tr></tbody></table>'),
        ("| no table |", "<p>| no table |</p>"),
        ("_ _ _\n***\n---", "<hr><hr><hr>"),
        ("a < b & c\n# comment\nd", "<p>a &lt; b &amp; c</p><p>d</p>"),
        ("~~~js\n<b>\n= x\n~~~", '<pre><code class="language-js">&lt;b&gt;\n= x\n</code></pre>'),
        ("see [[ ^2 ]] [[ ^9 ]]\n\n[[ ^1 ]]: unused\n[[ ^2 ]]: Note\nmore", '<p>see <sup><a href="#user-content-fn-1" id="user-content-fnref-1" data-footnote-ref aria-describedby="footnote-label">1</a></sup> [[ ^9 ]]</p><section data-footnotes class="footnotes"><h2 class="sr-only" id="footnote-label">Footnotes</h2><ol><li id="user-content-fn-1"><p>Note more <a href="#user-content-fnref-1" data-footnote-backref aria-label="Back to content" class="data-footnote-backref">↩</a></p></li></ol></section>'),
        ("", ""),
    ],
)
def test_markup(text, html):
    assert html_of(text) == html


def test_node_tables(spark):
    docs = spark.createDataFrame([(0, "= A\n\n- [x] t\n- [ ] u\n- v"), (1, ""), (2, None)], "doc_index long, content string")
    nodes = markup.nodes(docs).cache()
    assert {r.doc_index: r.html == "" for r in markup.to_html(nodes).collect()} == {0: False, 1: True, 2: True}
    assert sorted((r.line, r.column, r.done) for r in markup.tasks(nodes).collect()) == [(3, 4, True), (4, 4, False)]
    assert markup.visit(nodes, "li").count() == 3
    assert markup.process(nodes, lambda t: t.where("depth < 2")).where("doc_index = 0").first().html == '<h1 id="a"></h1><ul class="contains-task-list"></ul>'
    built = markup.node_rows(markup.h("p.x.y#z", {"title": 1}, "a", None, [markup.h("b", None, "c"), False]))
    assert [(r[2], r[5] or r[7]) for r in built] == [(0, None), (1, "p"), (2, "a"), (2, "b"), (3, "c")] and built[1][6] == {"class": "x y", "id": "z", "title": "1"}


def test_sanitize(spark):
    rows = [(0, 0, -1, 0, 0, "root", None, None, None, 0), (0, 1, 0, 1, 0, "element", "script", None, None, 1), (0, 2, 1, 2, 0, "text", None, None, "alert()", 1), (0, 3, 0, 1, 1, "element", "a", {"href": "javascript:x", "onclick": "y", "data-k": "1"}, None, 2), (0, 4, 3, 2, 0, "text", None, None, "hi", 2), (0, 5, 0, 1, 2, "element", "blink", None, None, 3), (0, 6, 5, 2, 0, "text", None, None, "keep", 3)]
    from vellum.schema import NODE_SCHEMA

    clean = markup.sanitize(spark.createDataFrame(rows, f"doc_index long, {NODE_SCHEMA}"))
    assert markup.to_html(clean).first().html == '<a data-k="1">hi</a><div>keep</div>'


def png(w, h):
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_directories(spark, tmp_path):
    for path, content in {
        "b.mdy": b"+++\nk: 1\n+++\nx #t\n---\nsecond", "a/note.md": b"+++\nnot: data\n+++\n#md", "city.yaml": b"---\nname: Uruk\npath: forged\ntags: Foo\n", "bad.yml": b"- list", "i.png": png(40, 30), "bad.gif": b"??", "x.txt": b"t",
        ".hidden/x.mdy": b"no", "node_modules/m.mdy": b"no", "dist/o.mdy": b"no", "empty.mdy": b"",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    inventory = files.walk_files(spark, str(tmp_path)).collect()
    assert [r.path for r in inventory] == ["a/note.md", "b.mdy", "bad.gif", "bad.yml", "city.yaml", "empty.mdy", "i.png", "x.txt"]
    assert [r.path for r in files.walk_vault(spark, str(tmp_path)).collect()] == ["b.mdy", "empty.mdy"]
    s = DocSet(files.walk_raw(spark, str(tmp_path)))
    got = [json.loads(r.data_json) for r in s.find().collect()]
    by = {}
    for g in got:
        by.setdefault(g["path"], []).append(g)
    assert [g["path"] for g in got] == ["a/note.md", "b.mdy", "b.mdy", "bad.gif", "bad.yml", "city.yaml", "empty.mdy", "i.png", "x.txt"]
    assert by["a/note.md"][0]["body"].startswith("+++") and by["a/note.md"][0]["tags"] == ["md"]
    assert by["city.yaml"][0]["name"] == "Uruk" and by["city.yaml"][0]["tags"] in ("Foo", ["foo"])
    assert (by["i.png"][0]["width"], by["i.png"][0]["height"]) == (40, 30) and "width" not in by["bad.gif"][0]
    assert by["b.mdy"][0]["k"] == 1 and names(s.find({"ext": ".png"})) == ["i"]


def test_imports(spark):
    from vellum.plans.imports import ImportCycle, Site, import_order

    graph = {"r": ["a", "b"], "a": ["c"], "b": ["c"], "c": []}
    assert import_order("r", graph.__getitem__) == ["c", "a", "b", "r"]
    with pytest.raises(ImportCycle, match="a -> b -> a"):
        import_order("r", {"r": ["a"], "a": ["b"], "b": ["a"]}.__getitem__)
    texts = {"/s": '% import lib from "./lib"\n% import x from "pkg"', "/s/lib": "+++\nk: 1\n+++", "/p": "+++\nk: 2\n+++"}
    site_ = Site("/s", lambda d: DocSet.from_texts(spark, [texts[d]]), {"pkg": "/p"})
    assert site_.order == ["/s/lib", "/p", "/s"] and names(site_.handle("x").find({"k": 2}), "k") == [2] and names(site_["/s/lib"].find(), "k") == [1]


def test_image_sizes():
    assert files.image_size(b"GIF89a" + struct.pack("<HH", 7, 9)) == (7, 9)
    assert files.image_size(b"\xff\xd8\xff\xe0\0\4xx\xff\xc0\0\x11\x08" + struct.pack(">HH", 5, 6) + b"\0" * 9) == (6, 5)
    assert files.image_size(b"RIFF....WEBPVP8X" + b"\0" * 8 + (9).to_bytes(3, "little") + (4).to_bytes(3, "little")) == (10, 5)
    assert files.image_size(b'<svg viewBox="0 0 30 20">') == (30, 20) and files.image_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 3, -4)) == (3, 4)
    assert files.image_size(b"") is None and files.image_size(b"\x89PNG\r\n\x1a\n") is None


def test_outputs(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.html", "old", 1), ("a/x.html", "new", 2), ("y.txt", "é", 3)], "path string, content string, seq int")
    out = site.emit(rows, F.col("path"), F.col("content"), F.col("seq"))
    assert site.write_outputs(out, str(tmp_path)) == 2
    assert (tmp_path / "a/x.html").read_text() == "new" and (tmp_path / "y.txt").read_bytes() == "é".encode()
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["x.html", "y.txt"]
    with pytest.raises(Exception, match="leaves the folder"):
        site.write_outputs(spark.createDataFrame([("../z", "x")], "path string, content string"), str(tmp_path / "in"))


def test_bus(spark):
    book = bus.address_book(spark.createDataFrame([("a", "a.mdy", ".mdy"), ("b", "b.mdy", ".mdy"), ("b", "c.md", ".md"), ("i", "i.png", ".png"), ("a.dead", "d.mdy", ".mdy")], "message_name string, path string, ext string"))
    with pytest.raises(Exception, match="several pages"):
        bus.publish(spark.createDataFrame([("b", 1)], "name string, seq long"), book).collect()
    log = spark.createDataFrame([("a", 1, 1, True), ("a", 2, 1, False), ("a", 3, 5, True), ("x.dead", 4, 1, False), ("i", 5, 5, False)], "name string, index long, attempts int, fails boolean")
    log = log.withColumn("data_json", F.lit("7"))
    got = bus.deliver(log, book, F.col("fails"))
    assert [r.status for r in got.orderBy("index").collect()] == ["failed", "done", "dead", "done", "dead"]
    letters = bus.dead_letters(got)
    assert {(r.name, r["index"], r.from_index) for r in letters.collect()} == {("a.dead", 1, 3), ("i.dead", 1, 5)}
    assert json.loads(one(spark, bus.envelope(F.lit("[1]"), F.lit("a"), F.lit(3), F.lit(None).cast("int")))) == {"value": [1], "msg": {"name": "a", "index": 3, "attempts": 1}}
    assert json.loads(one(spark, bus.envelope(F.lit(" {} "), F.lit("a"), F.lit(3), F.lit(2)))) == {"msg": {"name": "a", "index": 3, "attempts": 2}}
    assert [one(spark, bus.due_ms(F.lit(a))) for a in (1, 2, 3, 12)] == [0, 1000, 3000, 1000 * (2**9 - 1) + 300000 * 2]


def test_retries_conserve_messages(spark, tmp_path):
    book = bus.address_book(spark.createDataFrame([("a", "a.mdy", ".mdy")], "message_name string, path string, ext string"))
    log = spark.createDataFrame([("a", i, 1, i % 8) for i in range(1, 60)], "name string, index long, attempts int, fail_times int")

    def write(df, i):
        df.write.parquet(f"{tmp_path}/{i}")
        return spark.read.parquet(f"{tmp_path}/{i}")

    done = bus.deliver_until_done(log, book, lambda d: d["fail_times"] >= d["attempts"], write).collect()
    assert sorted(r["index"] for r in done) == list(range(1, 60))
    assert all((r.status, r.attempts) == (("done", r.fail_times + 1) if r.fail_times < 5 else ("dead", 5)) for r in done)


def test_fresh(spark):
    m = spark.createDataFrame([(i, "a", d) for i, d in enumerate("12213")], "seq long, name string, data_json string")
    sent = spark.range(1).select(F.lit("a").alias("name"), F.xxhash64(F.lit("1")).alias("last_hash"))
    assert [r.seq for r in bus.fresh(m, sent).orderBy("seq").collect()] == [1, 3, 4]


def test_numbering_of_repeated_and_sparse_sources(spark, monkeypatch):
    from vellum.sources import ingest

    rows = [(0, "a\n---\nb"), (0, "c"), (0, "c"), (1, "d"), (10**15, "e\n---\nf\n---\ng"), (10**16, "h"), (None, "first")]
    def numbers(key, value):  # noqa: E306
        docs = spark.createDataFrame([(value(i), t, None) for i, t in rows], f"{key}, text string, meta_json string").repartition(3)
        return [(r.doc_index, r.content) for r in ingest.parse_documents(docs, [key.split()[0]]).orderBy("doc_index").collect()]

    whole = numbers("source_id long", lambda i: i)
    assert [i for i, _ in whole] == list(range(10)) and whole[0][1] == "first" and sorted(c for _, c in whole[1:5]) == ["a", "b", "c", "c"] and [c for _, c in whole[5:]] == list("defgh")
    monkeypatch.setattr(ingest, "RANGE", 2)
    assert numbers("source_id long", lambda i: i) == whole
    assert numbers("path string", lambda i: None if i is None else f"a/very/long/common/folder/{i:020d}") == whole
