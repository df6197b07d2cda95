"""Registered queries of the document language: code, pages, markup, Markdown, directories and the
policies of the message log, each over whole tables and with its SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators.docset import DocSet
from .plans import markdown, markup, page, site
from .plans.imports import Site
from .queries import as_docs, delivered, lit_lines, messages, part_docs, query, shared_folder, table
from .sources import files
from .sources.ingest import parse_documents
from .streaming import bus


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- built-ins of the language, over columns of rows -------------------------------------------------


@query("""SELECT c_custkey, CAST(ascii(c_name) AS VARCHAR) AS code, c_name[-1:] AS last, substr(c_name, 4, 5) AS part, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, lpad(CAST(c_nationkey AS VARCHAR), 4, '*') AS padded,
repeat('ab', CAST(c_nationkey % 3 AS INT)) AS again, trim('  ' || c_mktsegment || '  ') AS bare, chr(CAST(65 + c_nationkey AS INT)) AS letter, CAST(strpos(c_name, '00') - 1 AS VARCHAR) AS place, replace(c_name, '0', '-') AS dashed FROM customer""")
def guest_string(spark, sf_dir):
    return page.evaluate_rows(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"], {
        "code": "c_name.charCodeAt(0)", "last": "c_name.at(-1)", "part": "c_name.substr(3, 5)", "up": "c_mktsegment.toUpperCase()", "low": "c_mktsegment.toLowerCase()", "padded": "String(c_nationkey).padStart(4, '*')",
        "again": "'ab'.repeat(c_nationkey % 3)", "bare": "`  ${c_mktsegment}  `.trim()", "letter": "String.fromCodePoint(65 + c_nationkey)", "place": "c_name.indexOf('00')", "dashed": "c_name.replaceAll('0', '-')",
    })


@query("""SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) AS digits, regexp_replace(c_name, '0+', '<\\0>') AS marked, CAST(len(regexp_extract_all(c_name, '0')) AS VARCHAR) AS zeros, CASE WHEN regexp_matches(c_mktsegment, '^(BUILD|AUTO)') THEN 'true' ELSE 'false' END AS hit,
array_to_string(regexp_split_to_array(c_name, '[#0]+'), '|') AS cut, CAST(strpos(c_name, '#') - 1 AS VARCHAR) AS place FROM customer""")
def guest_regex(spark, sf_dir):
    return page.evaluate_rows(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"], {
        "digits": r"/(?<n>\d+)$/.exec(c_name).groups.n", "marked": "c_name.replace(/0+/, '<$&>')", "zeros": "(c_name.match(/0/g) ?? []).length", "hit": "/^(build|auto)/i.test(c_mktsegment)", "cut": "c_name.split(/[#0]+/).join('|')", "place": "c_name.search(/#/)",
    })


@query("""SELECT c_custkey, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS down, CAST(CAST(ceil(c_acctbal) AS BIGINT) AS VARCHAR) AS up, CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) AS cut, CAST(CAST(sign(c_acctbal) AS BIGINT) AS VARCHAR) AS sign, CAST(greatest(c_nationkey, 7) AS VARCHAR) AS most, CAST(c_nationkey * c_nationkey AS VARCHAR) AS square,
CAST(CAST(c_nationkey % 4 AS INT) AS VARCHAR) AS rest, printf('%.2f', abs(c_acctbal)) AS size, CAST(CAST(sqrt(c_nationkey * c_nationkey) AS INT) AS VARCHAR) AS root, CASE WHEN c_nationkey = 0 THEN 'Infinity' ELSE 'finite' END AS inverse, printf('%x', c_custkey) AS hex FROM customer""")
def guest_math(spark, sf_dir):
    return page.evaluate_rows(table(spark, sf_dir, "customer"), "c_custkey", ["c_custkey", "c_acctbal", "c_nationkey"], {
        "down": "Math.floor(c_acctbal)", "up": "Math.ceil(c_acctbal)", "cut": "Math.trunc(c_acctbal)", "sign": "Math.sign(c_acctbal)", "most": "Math.max(c_nationkey, 7)", "square": "c_nationkey ** 2", "rest": "c_nationkey % 4", "size": "Math.abs(c_acctbal).toFixed(2)",
        "root": "Math.round(Math.hypot(c_nationkey, 0))", "inverse": "Number.isFinite(1 / c_nationkey) ? 'finite' : String(1 / c_nationkey)", "hex": "c_custkey.toString(16)",
    })


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, '{"id":' || event_id || ',"type":"' || event_type || '","list":[' || user_id || ',null]}' AS whole, CASE WHEN json_extract_string(props, '$.none') IS NULL THEN 'absent' END AS gap FROM events""")
def guest_json(spark, sf_dir):
    """Records written as JSON text, and read from it."""
    return page.evaluate_rows(table(spark, sf_dir, "events"), "event_id", ["event_id", "event_type", "user_id", "props"], {"k": "JSON.parse(props).k", "whole": "JSON.stringify({id: event_id, type: event_type, list: [user_id, undefined], gone: undefined})", "gap": "JSON.parse(props).none ?? 'absent'"})


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(month(o_orderdate) - 1 AS VARCHAR) AS month, CAST(dayofweek(o_orderdate) AS VARCHAR) AS weekday, strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS later,
strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS utc, CAST(epoch_ms(date_trunc('day', o_orderdate)) AS VARCHAR) AS midnight FROM orders""")
def guest_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"))
    return page.evaluate_rows(o, "o_orderkey", ["t"], {
        "iso": "new Date(t).toISOString()", "year": "new Date(t).getFullYear()", "month": "new Date(t).getMonth()", "weekday": "new Date(t).getUTCDay()", "later": "((d) => { d.setDate(d.getDate() + 40); return d.toISOString().slice(0, 10) })(new Date(t))",
        "utc": "new Date(Date.parse(t)).toUTCString()", "midnight": "Date.UTC(+t.slice(0, 4), t.slice(5, 7) - 1, +t.slice(8, 10))",
    })


@query("""WITH g AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k, list(o_orderstatus ORDER BY o_orderkey) AS s FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_transform(k, lambda x: x * 2), '-') AS doubled, array_to_string(list_reverse(k), ',') AS back, CAST(list_sum(k) AS VARCHAR) AS total, CAST(len(list_filter(s, lambda x: x = 'F')) AS VARCHAR) AS done, coalesce(CAST(list_filter(k, lambda x: x % 2 = 0)[1] AS VARCHAR), 'none') AS even,
CASE WHEN list_contains(s, 'P') THEN 'true' ELSE 'false' END AS some, array_to_string(list_slice(k, -2, -1), ',') AS last, array_to_string(list_sort(list_distinct(s)), '') AS kinds FROM g""")
def guest_array(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))).alias("xs"))
    return page.evaluate_rows(g, "o_custkey", ["xs"], {
        "doubled": "xs.map(({k}) => k * 2).join('-')", "back": "[...xs.map((x) => x.k)].reverse().join()", "total": "xs.reduce((a, x) => a + x.k, 0)", "done": "xs.filter((x) => x.s === 'F').length", "even": "xs.find((x) => x.k % 2 === 0)?.k ?? 'none'",
        "some": "xs.some((x) => x.s === 'P')", "last": "xs.slice(-2).map((x) => x.k).join()", "kinds": "[...new Set(xs.map((x) => x.s))].sort().join('')",
    })


@query("""WITH g AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(s || '=' || n, ',' ORDER BY s) AS counts, CAST(sum(n) AS VARCHAR) AS total, CAST(count(*) AS VARCHAR) AS kinds, CASE WHEN bool_or(s = 'P') THEN 'true' ELSE 'false' END AS has FROM g GROUP BY 1""")
def guest_object(spark, sf_dir):
    """Counts by status in an object and in a map."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("xs"))
    count = "xs.reduce((o, s) => Object.assign(o, {[s]: (o[s] ?? 0) + 1}), {})"
    return page.evaluate_rows(g, "o_custkey", ["xs"], {
        "counts": f"Object.entries({count}).sort().map(([k, v]) => `${{k}}=${{v}}`).join()", "total": f"Object.values({count}).reduce((a, b) => a + b)",
        "kinds": "((m) => { for (const s of xs) m.set(s, (m.get(s) ?? 0) + 1); return m.size })(new Map())", "has": f"Object.hasOwn({count}, 'P')",
    })


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_nationkey % 3 = 0 THEN 'third' ELSE 'other' END AS kind, CAST(list_sum(generate_series(0, CAST(c_nationkey AS BIGINT))) AS VARCHAR) AS sum,
CAST([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765, 10946, 17711, 28657, 46368][CAST(c_nationkey AS INT) + 1] AS VARCHAR) AS fib, CASE WHEN c_nationkey > 20 THEN 'caught too many' ELSE 'fine' END AS tried FROM customer""")
def guest_control(spark, sf_dir):
    """Branches, loops, a recurrence, a switch and errors, as programs of each row."""
    run = "((f) => f())"
    return page.evaluate_rows(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"], {
        "kind": f"{run}(() => {{ switch (true) {{ case c_acctbal < 0: return 'debt'; case c_nationkey % 3 === 0: return 'third'; default: return 'other' }} }})",
        "sum": f"{run}(() => {{ let s = 0; for (let i = 0; i <= c_nationkey; i++) {{ if (i < 0) continue; s += i }} return s }})",
        "fib": f"{run}(() => {{ let [a, b] = [0, 1], i = c_nationkey; while (i-- > 0) {{ [a, b] = [b, a + b] }} return a }})",
        "tried": f"{run}(() => {{ try {{ if (c_nationkey > 20) throw new Error('too many'); return 'fine' }} catch (e) {{ return `caught ${{e.message}}` }} finally {{ }} }})",
    })


# --- programs and pages ------------------------------------------------------------------------------

ROSTER = """= Orders of {{ req.name }}

%% const worth = (x) => {
  return x.total > 100000
}
% let n = 0
% for (const o of req.orders) {
%   if (!worth(o)) continue
%   n += 1
- {{ n }}. {{ o.key }}: {{ o.total.toFixed(2) }}
% }
% if (n === 0) {
none
% } else if (n > 2) {
many: {{ n }}
% }"""


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_totalprice > 100000),
l AS (SELECT o_custkey, string_agg('- ' || i || '. ' || o_orderkey || ': ' || printf('%.2f', o_totalprice) || chr(10), '' ORDER BY i) AS lines, count(*) AS n FROM o GROUP BY 1)
SELECT c_custkey, '= Orders of ' || c_name || chr(10) || chr(10) || coalesce(left(lines, length(lines) - 1), 'none') || CASE WHEN n > 2 THEN chr(10) || 'many: ' || n ELSE '' END AS output FROM customer LEFT JOIN l ON c_custkey = l.o_custkey""")
def code_roster(spark, sf_dir):
    """A document's program run for each customer, on the executors."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total")))).alias("orders"))
    rows = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    none = F.array().cast("array<struct<key:bigint,total:double>>")
    return page.render_programs(rows.select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.coalesce("orders", none).alias("orders"))).alias("req")), "c_custkey", ROSTER, req_col="req")


def nation_set(spark, sf_dir) -> DocSet:
    """An index page (document 0), a card (1), and a document for each nation, with its region's name."""
    index = "+++\npath: index.mdy\n+++\n= Regions\n\n% const card = $.findOne({ template: 'card' })\n% for (const r of $.find({ kind: 'region' })) {\n== {{ r.name }}\n\n% for (const n of $.find({ region: r.name })) {\n{{ $.render(card, n) }}\n\n% }\nIn short {{ $.text({ template: 'short' }, r) }} is {{ $.render({ template: 'card' }, r) }} too.\n% $.emit(`regions/${r.name}.json`, $.find({ region: r.name }).map((n) => n.name))\n% $.publish('region.' + r.name, { nations: $.find({ region: r.name }).length })\n% }"
    card = "+++\ntemplate: card\n+++\n!!{{ req.name }}!! {{ req.region ?? 'world' }}"
    short = "+++\ntemplate: short\n+++\n{{ req.name.slice(0, 2) }}"
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    pages = spark.createDataFrame([(-3, index), (-2, card), (-1, short)], "source_id long, text string")
    regions = r.select(F.col("r_regionkey").cast("long").alias("source_id"), lit_lines("+++\nkind: region\nname: '", F.col("r_name"), "'\n+++\n").alias("text"))
    nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("n_nationkey") + 100).cast("long").alias("source_id"), lit_lines("+++\nkind: nation\nname: '", F.col("n_name"), "'\nregion: '", F.col("r_name"), "'\n+++\n").alias("text"))
    whole = pages.union(regions).union(nations).withColumn("meta_json", F.lit(None).cast("string"))
    return DocSet(parse_documents(whole, ["source_id"]))


@query("""WITH n AS (SELECT n_regionkey, string_agg('<p><strong>' || n_name || '</strong> ' || r_name || '</p>', '' ORDER BY n_nationkey) AS cards FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT '<h1 id="regions">Regions</h1>' || string_agg('<h2 id="' || replace(lower(r_name), ' ', '-') || '">' || r_name || '</h2>' || coalesce(cards, '') || '<p>In short ' || left(r_name, 2) || ' is <strong>' || r_name || '</strong> world too.</p>', '' ORDER BY r_regionkey) AS html FROM region LEFT JOIN n ON n_regionkey = r_regionkey""")
def page_html(spark, sf_dir):
    """A page that finds, loops, and shows other documents in block and in running text."""
    return spark.createDataFrame([(page.Pages(nation_set(spark, sf_dir)).html(0),)], "html string")


@query("SELECT 'regions/' || r_name || '.json' AS path, '[' || coalesce(string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey), '') || ']' AS content FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def page_outputs(spark, sf_dir):
    """What a page emits, JSON of its rows among it."""
    pages = page.Pages(nation_set(spark, sf_dir))
    pages.text(0)
    return spark.createDataFrame(sorted(pages.outputs.items()), "path string, content string")


@query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS seq, 'region.' || r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations, 0 AS from_index FROM region")
def page_messages(spark, sf_dir):
    """What a page publishes, in the order of its calls."""
    pages = page.Pages(nation_set(spark, sf_dir))
    pages.text(0)
    rows = [(i, m["name"], m["data"]["nations"], m["from_index"]) for i, m in enumerate(pages.messages)]
    return spark.createDataFrame(rows, "seq long, name string, nations long, from_index int")


@query("SELECT 'find' AS hook, 2 + 5 * (SELECT count(*) FROM region) AS n UNION ALL SELECT 'emit', (SELECT count(*) FROM region) UNION ALL SELECT 'publish', (SELECT count(*) FROM region) UNION ALL SELECT 'native', 42")
def page_hooks(spark, sf_dir):
    """Hooks are called for each query, output and message; natives and modules are known to code."""
    seen: list[tuple[str, int]] = []
    pages = page.Pages(nation_set(spark, sf_dir), {"double": lambda x, *_: 2 * x}, lambda q: seen.append(("find", 1)), lambda p: seen.append(("emit", 1)), lambda m: seen.append(("publish", 1)), lambda p: "export const base = 20\nexport function plus(x) { return base + x }")
    pages.text(0)
    counts = {h: sum(n for k, n in seen if k == h) for h in ("find", "emit", "publish")}
    scope = {"$": pages.api(1, None), "import": page.Function(pages.module)}
    native = page.program("% const m = await import('./lib.js')\n{{ $.double(m.plus(1)) }}").run(scope)
    return spark.createDataFrame([*counts.items(), ("native", int(native))], "hook string, n long")


@query("SELECT n_nationkey, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def cross_package_join(spark, sf_dir):
    """Two packages: documents of the importing one joined with the imported one's, by its handle."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    main = as_docs(n, "n_nationkey", key=F.col("n_nationkey"), name=F.col("n_name"), region=F.col("n_regionkey"))
    main.docs = main.docs.withColumn("content", F.when(F.col("doc_index") == 0, "% import geo from './geo'").otherwise(""))
    geo = as_docs(r, "r_regionkey", id=F.col("r_regionkey"), title=F.col("r_name"))
    geo.docs = geo.docs.withColumn("content", F.lit(""))
    whole = Site("/site", {"/site": main, "/site/geo": geo}.__getitem__)
    other = whole.handle("geo")
    named = other.find().select(other.field("id", "int").alias("id"), other.field("title").alias("region"))
    ours = whole["/site"].find()
    rows = ours.select(main.field("key", "int").alias("n_nationkey"), main.field("name").alias("name"), main.field("region", "int").alias("rid"))
    return rows.join(named, F.col("rid") == F.col("id")).select("n_nationkey", "name", "region")


@query("SELECT p_partkey AS doc_index, p_name AS name FROM part WHERE p_partkey % 7 = 3 AND p_size > 20")
def path_lookup(spark, sf_dir):
    """A set written sorted by path, with columns of its own: filters on them are plain predicates."""
    p = table(spark, sf_dir, "part")
    s = as_docs(p, "p_partkey", path=lit_lines("parts/", (F.col("p_partkey") % 7).cast("string")), name=F.col("p_name"), size=F.col("p_size"))
    found = s.indexed(f"{shared_folder(spark)}/vellum-set-{uuid.uuid4().hex}", {"path": "string", "size": "int"})
    return found.find({"path": "parts/3", "size": {"$gt": 20}}).select("doc_index", found.field("name").alias("name"))


@query("SELECT p_partkey AS doc_index FROM part WHERE p_partkey < 50 AND p_partkey <> 7")
def find_by_id(spark, sf_dir):
    return part_docs(spark, sf_dir).find({"_id": {"$lt": 50}, "$nor": [{"_id": 7}]}).select("doc_index")


@query("SELECT n_regionkey AS g, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place, n_name AS name FROM nation")
def flatten_groups(spark, sf_dir):
    """Groups that hold items, as one row an item."""
    n = table(spark, sf_dir, "nation")
    groups = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("items"))
    flat = groups.select(F.col("n_regionkey").alias("g"), F.posexplode("items").alias("place", "item"))
    return flat.select("g", F.col("place").cast("long").alias("place"), F.col("item.n_name").alias("name"))


# --- markup over varied texts --------------------------------------------------------------------------

#: Texts and their HTML; @N stands for a row's name.
MARKUP = [
    ("= @N\n\n***\n\nOne --> two -- three... :rocket: :)", '<h1 id="@I">@N</h1><hr><p>One → two — three… 🚀 🙂</p>'),
    ("< section class=\"x\"\n  == @N\n  < div\n    in\n\nout", '<section class="x"><h2 id="@I">@N</h2><div><p>in</p></div></section><p>out</p>'),
    ("- one\n- two @N\n  3. three\n\n- four", "<ul><li><p>one</p></li><li><p>two @N</p><ol start=\"3\"><li><p>three</p></li></ol></li><li><p>four</p></li></ul>"),
    ("# a comment\n@N //i// __u__ ~~d~~ ??m?? ^^p^^ ,,b,,", "<p>@N <em>i</em> <u>u</u> <del>d</del> <mark>m</mark> <sup>p</sup> <sub>b</sub></p>"),
    ("see [[ ^n ]]\n\n[[ ^n ]]: note @N", '<p>see <sup><a href="#user-content-fn-1" id="user-content-fnref-1" data-footnote-ref aria-describedby="footnote-label">1</a></sup></p><section data-footnotes class="footnotes"><h2 class="sr-only" id="footnote-label">Footnotes</h2><ol><li id="user-content-fn-1"><p>note @N <a href="#user-content-fnref-1" data-footnote-backref aria-label="Back to content" class="data-footnote-backref">↩</a></p></li></ol></section>'),
    ("x <--> y <== z ---> w -> v https://a.example/b. (@N)", '<p>x ↔ y ⇐ z ---&gt; w -&gt; v <a href="https://a.example/b">https://a.example/b</a>. (@N)</p>'),
]
#: Markdown and its HTML.
MARKDOWN = [
    ("# @N\n\nSome *em* and **strong** ~~gone~~ `a*b`", '<h1 id="@I">@N</h1><p>Some <em>em</em> and <strong>strong</strong> <del>gone</del> <code>a*b</code></p>'),
    ("@N\n===\n\n> quote\n> more\n\n---", '<h1 id="@I">@N</h1><blockquote><p>quote\nmore</p></blockquote><hr>'),
    ("- a\n- b @N\n  1. c\n- [x] d", '<ul class="contains-task-list"><li>a</li><li>b @N<ol><li>c</li></ol></li><li class="task-list-item"><input type="checkbox" checked disabled> d</li></ul>'),
    ("| h | r |\n|---|--:|\n| @N | 2 |", '<table><thead><tr><th>h</th><th align="right">r</th></tr></thead><tbody><tr><td>@N</td><td align="right">2</td></tr></tbody></table>'),
    ("```js\nlet x = '@N'\n```\n\n    indented", "<pre><code class=\"language-js\">let x = '@N'\n</code></pre><pre><code>indented\n</code></pre>"),
    ("[@N](/u \"t\") ![i](/p.png) <https://a.b> [r]\n\n[r]: /ref", '<p><a href="/u" title="t">@N</a> <img src="/p.png" alt="i"> <a href="https://a.b">https://a.b</a> <a href="/ref">r</a></p>'),
    ("> [!NOTE]\n> be <b>kind</b> @N", '<div class="markdown-alert markdown-alert-note"><p class="markdown-alert-title">Note</p><p>be <b>kind</b> @N</p></div>'),
]
#: Elements as written, and what sanitising leaves of them.
UNSAFE = [
    ("< blink width=\"1\" id=\"a\"\n  @N", '<div id="a"><p>@N</p></div>'),
    ("< p width=\"3\" title=\"t\" onclick=\"x\"\n  @N", '<p title="t"><p>@N</p></p>'),
    ("< script\n  alert('@N')", ""),
    ("< a href=\"java\tscript:x\" rel=\"n\" data-k=\"1\"\n  @N", '<a rel="n" data-k="1"><p>@N</p></a>'),
    ("< img src=\"https://a.example/@I.png\" width=\"5\" href=\"x\"", '<img src="https://a.example/@I.png" width="5">'),
]

def varied(cases: list[tuple[str, str]]) -> str:
    """SQL of the HTML of each supplier's text: the case of its key's rest."""
    rows = ", ".join(f"({i}, {quoted(h)})" for i, (_, h) in enumerate(cases))
    return f"SELECT s_suppkey AS doc_index, replace(replace(h, '@N', s_name), '@I', replace(lower(s_name), ' ', '-')) AS html FROM supplier JOIN (VALUES {rows}) v(i, h) ON s_suppkey % {len(cases)} = i"


def texts_of(spark, sf_dir, cases: list[tuple[str, str]]) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    text = F.get(F.array(*[F.lit(t) for t, _ in cases]), (F.col("s_suppkey") % len(cases)).cast("int"))
    for mark, value in (("@N", F.col("s_name")), ("@I", F.replace(F.lower("s_name"), F.lit(" "), F.lit("-")))):
        text = F.replace(text, F.lit(mark), value)
    return s.select(F.col("s_suppkey").alias("doc_index"), text.alias("content"))


@query(varied(MARKUP))
def markup_varied(spark, sf_dir):
    return markup.to_html(markup.nodes(texts_of(spark, sf_dir, MARKUP)))


@query(varied(MARKDOWN))
def markdown_html(spark, sf_dir):
    return markup.to_html(markdown.nodes(texts_of(spark, sf_dir, MARKDOWN), text="content"))


@query(varied(UNSAFE))
def markup_sanitized(spark, sf_dir):
    return markup.to_html(markup.sanitize(markup.nodes(texts_of(spark, sf_dir, UNSAFE))))


@query("SELECT s_suppkey AS doc_index, 1 AS heads, 2 AS texts, '<div><h4>' || s_name || '</h4></div>' AS html FROM supplier")
def markup_transform(spark, sf_dir):
    """A tree visited, and written after a step that changes it."""
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_index"), lit_lines("= ", F.col("s_name"), "\n\n  text").alias("content"))
    nodes = markup.nodes(docs)
    heads = markup.visit(nodes, "h1").groupBy("doc_index").agg(F.count("*").cast("int").alias("heads"))
    texts = markup.visit(nodes, "text").groupBy("doc_index").agg(F.count("*").cast("int").alias("texts"))
    fewer = lambda t: t.where("tag is null or tag <> 'p'").where("value is null or value <> 'text'")
    lower = lambda t: t.withColumns({"tag": F.when(F.col("tag") == "h1", "h4").otherwise(F.col("tag")), "props": F.create_map().cast("map<string,string>")})
    wrapped = lambda t: t.where("tag is null or tag <> 'div'").withColumns({"tag": F.when(F.col("type") == "root", "div").otherwise(F.col("tag")), "type": F.when(F.col("type") == "root", "element").otherwise(F.col("type"))})
    return heads.join(texts, "doc_index").join(markup.process(nodes, fewer, lower, wrapped), "doc_index")


@query("SELECT s_suppkey AS doc_index, '<article><h1 id=\"a\">A</h1></article><article><p>' || s_name || '</p><h1 id=\"a-1\">A</h1></article>' AS html FROM supplier")
def markup_stream(spark, sf_dir):
    """A stream of documents as articles of one page; headings share one run of ids."""
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_index"), lit_lines("+++\nx: 1\n+++\n= A\n---\n", F.col("s_name"), "\n\n= A").alias("content"))
    return markup.to_html(markup.nodes(docs, parser=markup.parse_stream))


@query(f"""SELECT s_suppkey AS k, '| n | k |' || chr(10) || '| :-- | --: |' || chr(10) || '| ' || s_name || ' | ' || s_suppkey || ' |' AS grid, '<p class="x">' || s_name || '<b>!</b></p>' AS node FROM supplier""")
def code_nodes(spark, sf_dir):
    """Tables and trees that code builds by hand."""
    s = table(spark, sf_dir, "supplier")
    grids = page.render_programs(s.select("s_suppkey", F.to_json(F.struct("s_name", "s_suppkey")).alias("req")), "s_suppkey", "{{ $.table([['n', 'k'], [req.s_name, req.s_suppkey]], ['left', 'r']) }}", req_col="req")
    rows = s.select("s_suppkey", "s_name").mapInPandas(built, "k int, node string")
    return grids.select(F.col("s_suppkey").cast("int").alias("j"), F.col("output").alias("grid")).join(rows, F.col("j") == F.col("k")).select(F.col("k").cast("long").alias("k"), "grid", "node")


def built(frames):
    names = [n for n, _ in markup.NODE_FIELDS]
    for f in frames:
        nodes = [markup.node_rows(markup.h("p.x", None, n, markup.h("b", None, "!"))) for n in f["s_name"]]
        f = f.assign(k=f["s_suppkey"], node=[markup.write_html([dict(zip(names, r)) | {"props": list(r[6].items())} for r in rows]) for rows in nodes])
        yield f[["k", "node"]]


@query("SELECT s_suppkey AS k, unnest(['https://a.example/' || s_suppkey, 'me@b.example']) AS link FROM supplier")
def find_links(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), F.explode(T.find_links(lit_lines("see https://a.example/", F.col("s_suppkey").cast("string"), ", or (me@b.example). not http:// this"))).alias("link"))


@query("SELECT s_suppkey AS k, 'lib' || s_suppkey AS name, './lib' || s_suppkey AS spec FROM supplier")
def import_lines(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    return s.select(F.col("s_suppkey").alias("k"), F.explode(T.extract_imports(lit_lines("% import lib", k, " from \"./lib", k, "\"\ntext\n% importx y"))).alias("i")).select("k", "i.name", "i.spec")


@query("SELECT p_partkey AS k, 'a/p-50x' || greatest(1, CAST(floor(50.0 / p_size * 3 + 0.5) AS INT)) || '.png' AS path, 50 AS width, greatest(1, CAST(floor(50.0 / p_size * 3 + 0.5) AS INT)) AS height FROM part WHERE p_size > 0")
def image_sizes(spark, sf_dir):
    """Sizes and paths of images brought to a width."""
    p = table(spark, sf_dir, "part").where("p_size > 0")
    size = T.resize_target(F.lit("static/a/p.png"), F.lit(".png"), F.col("p_size").cast("double"), F.lit(3.0), to_width=50)
    return p.select(F.col("p_partkey").alias("k"), size.alias("r")).select("k", "r.path", "r.width", "r.height")


@query("SELECT c_mktsegment AS text, count(DISTINCT c_mktsegment) AS hashes, count(*) AS n FROM customer GROUP BY 1")
def hash_strings(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("text")).agg(F.count_distinct(T.hash_string(F.col("c_mktsegment"))).alias("hashes"), F.count("*").alias("n"))


@query("""SELECT 'n' || s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS v FROM supplier UNION ALL SELECT 't' || s_suppkey, '"' || s_name || '"' FROM supplier""")
def context_values(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    both = s.select(F.concat(F.lit("n"), k).alias("k"), k.alias("t")).union(s.select(F.concat(F.lit("t"), k), F.col("s_name")))
    return both.select("k", T.context_value(F.col("t")).alias("v"))


# --- directories -----------------------------------------------------------------------------------------


def directory(spark, sf_dir) -> str:
    """A folder with four files for each supplier: a document, a Markdown text, a record and an image."""
    folder = f"{shared_folder(spark)}/vellum-files-{uuid.uuid4().hex}"
    s = table(spark, sf_dir, "supplier")
    k, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    kinds = {"docs/%.mdy": lit_lines("+++\ntitle: '", name, "'\n+++\nabout #", F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))), "notes/%.md": lit_lines("# ", name, "\n\n#note"), "data/%.yaml": lit_lines("name: '", name, "'\nkey: ", k), "img/%.svg": lit_lines('<svg width="', k, '" height="7"></svg>'), "node_modules/%.mdy": F.lit("left out")}
    parts = [s.select(F.replace(F.lit(path), F.lit("%"), k).alias("path"), text.alias("content")) for path, text in kinds.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    site.write_outputs(whole, folder)
    return folder


@query("SELECT f || s_suppkey || e AS path, CAST(s_suppkey AS VARCHAR) AS name, e AS ext FROM supplier, (VALUES ('docs/', '.mdy'), ('notes/', '.md'), ('data/', '.yaml'), ('img/', '.svg')) v(f, e)")
def walk_inventory(spark, sf_dir):
    return files.walk_files(spark, directory(spark, sf_dir)).select("path", "name", "ext")


@query("SELECT 'docs/' || s_suppkey || '.mdy' AS path, '+++' || chr(10) || 'title: ''' || s_name || '''' || chr(10) || '+++' || chr(10) || 'about #n' || s_nationkey AS text FROM supplier")
def walk_documents(spark, sf_dir):
    return files.walk_vault(spark, directory(spark, sf_dir)).select("path", "text")


@query("""SELECT 'docs/' || s_suppkey || '.mdy' AS path, s_name AS title, CAST(s_suppkey AS VARCHAR) AS name, 'n' || s_nationkey AS tag, NULL::INT AS key, NULL::INT AS width, NULL::INT AS height, NULL::VARCHAR AS body FROM supplier
UNION ALL SELECT 'notes/' || s_suppkey || '.md', NULL, CAST(s_suppkey AS VARCHAR), 'note', NULL, NULL, NULL, '# ' || s_name || chr(10) || chr(10) || '#note' FROM supplier
UNION ALL SELECT 'data/' || s_suppkey || '.yaml', NULL, s_name, NULL, s_suppkey, NULL, NULL, NULL FROM supplier
UNION ALL SELECT 'img/' || s_suppkey || '.svg', NULL, CAST(s_suppkey AS VARCHAR), NULL, NULL, s_suppkey, 7, NULL FROM supplier""")
def walk_sources(spark, sf_dir):
    """A whole directory as documents, each format by its own rules."""
    s = DocSet(files.walk_raw(spark, directory(spark, sf_dir)))
    return s.find().select("path", s.field("title").alias("title"), s.field("name").alias("name"), F.get("tags", F.lit(0)).alias("tag"), s.field("key", "int").alias("key"), s.field("width", "int").alias("width"), s.field("height", "int").alias("height"), s.field("body").alias("body"))


@query("SELECT 'docs/' || s_suppkey || '.mdy' AS path FROM supplier")
def watch_changes(spark, sf_dir):
    """A directory as a stream: its files as changes, handed to one build."""
    folder, out = directory(spark, sf_dir), f"{shared_folder(spark)}/vellum-watch-{uuid.uuid4().hex}"
    changed = bus.watch(spark, f"{folder}/docs", "*.mdy")
    bus.rebuild(changed, lambda df, i: df.select(F.regexp_extract("path", r"(docs/[^/]+)$", 1).alias("path")).write.mode("append").parquet(f"{out}/changes"), f"{out}/state")
    return spark.read.parquet(f"{out}/changes")


# --- the message log's policies ----------------------------------------------------------------------------


@query("SELECT event_type AS name, i AS index, 30500 AS until_ms FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) WHERE i BETWEEN 9 AND 24 AND event_type <> 'view' OR event_type = 'view' AND i <= 16")
def take_leases(spark, sf_dir):
    """A worker's claim: the first of each name that are neither settled nor held; a lease that ran out is free."""
    log = bus.log_index(messages(spark, sf_dir)).select("name", "index")
    first = log.where("index <= 8")
    done = first.where("name <> 'view'").withColumns({"group": F.lit("g"), "until_ms": F.lit(900), "state": F.when(F.col("index") % 2 == 0, "done").otherwise("held")})
    gone = first.where("name = 'view'").withColumns({"group": F.lit("g"), "until_ms": F.lit(400), "state": F.lit("held")})
    return bus.lease(log, done.unionByName(gone), 500, "g").select("name", "index", F.col("until_ms").cast("int").alias("until_ms"))


@query("SELECT event_type AS name, CAST(CASE WHEN min(event_id) % 2 = 0 THEN 5 ELSE 3 END AS INT) AS attempts, CAST(100 * (min(event_id) % 3 + 1) AS INT) AS backoff_ms, CAST(300000 AS INT) AS cap_ms FROM events GROUP BY 1")
def policy_once(spark, sf_dir):
    """The policy that was asked first for a name holds."""
    e = table(spark, sf_dir, "events")
    asked = e.select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 1, 3).alias("attempts"), ((F.col("event_id") % 3 + 1) * 100).cast("int").alias("backoff_ms"), F.lit(None).cast("int").alias("cap_ms"))
    return bus.first_policies(asked)


@query("SELECT event_id AS seq, event_id AS index, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN 'x' END AS h, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS INT) AS attempts FROM events")
def parse_deliveries(spark, sf_dir):
    """Delivered batches read: payloads with headers and without."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    payload = F.when(k % 2 == 0, F.concat(F.lit('[{"h":"x"},'), "props", F.lit("]"))).otherwise(F.col("props"))
    entry = F.concat(F.lit('[{"index":'), k.cast("string"), F.when(k % 2 == 0, ',"type":16').otherwise(""), F.when(k % 3 == 0, ',"attempts":2').otherwise(""), F.lit(',"payload":'), payload, F.lit("}]"))
    x = e.select(k.alias("seq"), F.explode(bus.parse_delivery(entry)).alias("x"))
    return x.select("seq", "x.index", F.get_json_object("x.value", "$.k").alias("k"), F.get_json_object("x.headers", "$.h").alias("h"), "x.attempts")


@query("WITH l AS (SELECT event_id AS seq, event_type AS name, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 16 AS batch FROM events), b AS (SELECT name, batch, min(seq) AS s FROM l GROUP BY 1, 2) SELECT l.seq, CASE WHEN b.s >= 500 THEN 'new' ELSE 'old' END AS site FROM l JOIN b ON l.name = b.name AND l.batch = b.batch")
def site_swap(spark, sf_dir):
    """A batch ends on the site that it began with."""
    log = bus.batches(bus.log_index(messages(spark, sf_dir)))
    return bus.on_site(log, spark.createDataFrame([(-1, "old"), (500, "new")], "seq long, site string")).select("seq", "site")


@query("""SELECT name || '.dead' AS name, i AS index, seq AS from_seq FROM (SELECT event_id AS seq, event_type AS name, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events WHERE user_id % 6 + 1 >= 5 AND NOT (event_type IN ('click', 'error') AND user_id % 3 > 0)) WHERE name = 'view' AND i >= 3 ORDER BY i LIMIT 5""")
def dead_letters_from(spark, sf_dir):
    """Dead letters of a name from an index on, so many of them."""
    d = delivered(spark, sf_dir)
    letters = bus.dead_letters(d, "view", start=3, top=5)
    return letters.join(d.select(F.col("name").alias("_n"), F.col("index").alias("_i"), F.col("seq").alias("from_seq")), (F.col("from_name") == F.col("_n")) & (F.col("from_index") == F.col("_i"))).select("name", "index", "from_seq")


@query("SELECT 'error' AS kind, 1 AS n UNION ALL SELECT 'publish', 1 UNION ALL SELECT 'cycle', 1")
def errors_are_not_empty(spark, sf_dir):
    """An unknown operator, a message without a page, and a document that shows itself fail; none is an empty answer."""
    from .functions.library import ScriptError
    from .operators.filters import FilterError

    found = []
    try:
        part_docs(spark, sf_dir).find({"size": {"$near": 1}})
    except FilterError:
        found.append(("error", 1))
    try:
        bus.publish(messages(spark, sf_dir).where("name = 'purchase'").limit(1), bus.address_book(spark.createDataFrame([], "message_name string, path string, ext string"))).collect()
    except Exception as e:
        found.append(("publish", int("no page has this name" in str(e))))
    own = DocSet(spark.createDataFrame([(0, json.dumps({}), "{{ $.render(0) }}")], "doc_index long, data_json string, content string"))
    try:
        page.Pages(own).html(0)
    except ScriptError:
        found.append(("cycle", 1))
    return spark.createDataFrame(found, "kind string, n int")
