"""Registered queries of the document engine: each runs library operators over whole tables, and
ORACLE_SQL says the same in SQL where SQL can. Synthetic documents are written from the tables' rows
and read back, so SQL can start from the columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import guest as G
from .functions import text as T
from .operators import relational as R
from .operators.docset import DocSet
from .plans import markup, site, template
from .sources.ingest import front_matter, parse_documents, split_documents
from .streaming import bus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local run without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="vellum-")
    return base.rstrip("/")


def lit_lines(*parts) -> F.Column:
    """Parts (columns or texts) in one text."""
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


# --- documents written from rows ------------------------------------------------------------------


def customer_docs(spark: SparkSession, sf_dir: str) -> DocSet:
    """One document a customer: front matter and a body with a hashtag."""
    c = table(spark, sf_dir, "customer")
    text = lit_lines("+++\nname: ", F.col("c_name"), "\nsegment: ", F.col("c_mktsegment"), "\nbalance: ", F.col("c_acctbal").cast("string"), "\nkey: ", F.col("c_custkey").cast("string"), "\n+++\nnote about #", F.col("c_mktsegment"))
    return DocSet(parse_documents(c.select(F.col("c_custkey").alias("source_id"), text.alias("text"), F.lit(None).cast("string").alias("meta_json")), ["source_id"]))


def as_docs(rows: DataFrame, index: str, **fields) -> DocSet:
    """A set of ready records: fields become the record, null ones are absent."""
    record = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return DocSet(rows.select(F.col(index).cast("long").alias("doc_index"), record.alias("data_json")))


def event_docs(spark: SparkSession, sf_dir: str) -> DocSet:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return as_docs(e, "event_id", type=F.col("event_type"), user=F.col("user_id"), value=F.col("value"), k=k, code=F.when(F.col("event_type") == "error", k), big=F.col("value") > 50, at=F.struct(k.alias("k")))


def part_docs(spark: SparkSession, sf_dir: str) -> DocSet:
    p = table(spark, sf_dir, "part")
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    record = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), words.alias("tags")))
    return DocSet(p.select(F.col("p_partkey").alias("doc_index"), record.alias("data_json"), words.alias("tags")))


@query("SELECT lower(c_mktsegment) AS tag, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
def tag_census(spark, sf_dir):
    return R.tag_index(customer_docs(spark, sf_dir).where({"balance": {"$gt": 5000}}), "tags")


@query("SELECT rn - 1 AS doc_index, c_name AS name, c_acctbal AS balance, 'note about #' || c_mktsegment AS content FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) WHERE c_mktsegment = 'BUILDING'")
def front_matter_find(spark, sf_dir):
    s = customer_docs(spark, sf_dir)
    return s.find({"segment": "BUILDING"}).select("doc_index", s.field("name").alias("name"), s.field("balance", "double").alias("balance"), "content")


# --- filters ----------------------------------------------------------------------------------------


def found(s: DocSet, q: dict) -> DataFrame:
    return s.find(q).select("doc_index")


@query("SELECT event_id AS doc_index FROM events WHERE event_type = 'purchase'")
def find_eq(spark, sf_dir):
    return found(event_docs(spark, sf_dir), {"type": "purchase"})


@query("SELECT event_id AS doc_index FROM events WHERE value > 50")
def find_gt(spark, sf_dir):
    return found(event_docs(spark, sf_dir), {"value": {"$gt": 50}})


@query("SELECT event_id AS doc_index FROM events WHERE event_type = 'click' AND user_id >= 40")
def find_gte_and(spark, sf_dir):
    return found(event_docs(spark, sf_dir), {"type": "click", "user": {"$gte": 40}})


@query("SELECT event_id AS doc_index FROM events WHERE NOT (event_type = 'error' AND coalesce(CAST(json_extract_string(props, '$.k') AS INT) = 3, false))")
def find_ne_keeps_absent(spark, sf_dir):
    return found(event_docs(spark, sf_dir), {"code": {"$ne": 3}})


@query("SELECT event_id AS doc_index FROM events WHERE event_type = 'error' AND json_extract_string(props, '$.k') IS NOT NULL")
def find_exists(spark, sf_dir):
    return found(event_docs(spark, sf_dir), {"code": {"$exists": True}})


@query("SELECT event_id AS doc_index FROM events WHERE NOT (event_type = 'error' AND json_extract_string(props, '$.k') IS NOT NULL)")
def find_null_matches_absent(spark, sf_dir):
    return found(event_docs(spark, sf_dir), {"code": None})


@query("SELECT event_id AS doc_index FROM events WHERE value > 50")
def find_bool(spark, sf_dir):
    return found(event_docs(spark, sf_dir), {"big": True})


@query("SELECT event_id AS doc_index FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 2 AND 4")
def find_dotted_path(spark, sf_dir):
    return found(event_docs(spark, sf_dir), {"at.k": {"$gte": 2, "$lte": 4}})


@query("SELECT event_id AS doc_index FROM events WHERE event_id % 2 = 1 AND user_id > 10")
def type_bracket(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mixed = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    s = DocSet(e.select(F.col("event_id").alias("doc_index"), F.concat(F.lit('{"mixed": '), mixed, F.lit("}")).alias("data_json")))
    return found(s, {"mixed": {"$gt": 10}})


@query("SELECT p_partkey AS doc_index FROM part WHERE list_contains(string_split(lower(p_name || ' ' || p_type), ' '), 'widget')")
def with_tag(spark, sf_dir):
    return part_docs(spark, sf_dir).with_tag("WIDGET").select("doc_index")


@query("SELECT p_partkey AS doc_index FROM part WHERE list_contains(string_split(lower(p_name || ' ' || p_type), ' '), 'small')")
def find_array_contains(spark, sf_dir):
    s = part_docs(spark, sf_dir)
    return found(DocSet(s.docs.drop("tags")), {"tags": "small"})


@query("SELECT p_partkey AS doc_index FROM part WHERE (p_brand IN ('Brand#12', 'Brand#23') OR p_size < 5) AND NOT (p_size = 3)")
def find_in_or_not(spark, sf_dir):
    return found(part_docs(spark, sf_dir), {"$or": [{"brand": {"$in": ["Brand#12", "Brand#23"]}}, {"size": {"$lt": 5}}], "size": {"$not": {"$eq": 3}}})


@query("SELECT p_partkey AS doc_index FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3]') AND p_brand NOT IN ('Brand#11') AND p_size % 4 = 1")
def find_regex_nin_mod(spark, sf_dir):
    return found(part_docs(spark, sf_dir), {"brand": {"$regex": "^Brand#[1-3]", "$nin": ["Brand#11"]}, "size": {"$mod": [4, 1]}})


@query("SELECT p_partkey AS doc_index FROM part WHERE len(string_split(lower(p_name || ' ' || p_type), ' ')) = 3 AND list_contains(string_split(lower(p_name || ' ' || p_type), ' '), 'widget') AND len(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: regexp_matches(x, '^s'))) > 0")
def find_size_all_elem(spark, sf_dir):
    s = DocSet(part_docs(spark, sf_dir).docs.drop("tags"))
    return found(s, {"tags": {"$size": 3, "$all": ["widget"], "$elemMatch": {"$regex": "^s"}}})


@query("SELECT p_partkey AS doc_index FROM part WHERE NOT (p_size > 10 OR p_brand = 'Brand#13')")
def find_nor_type(spark, sf_dir):
    return found(part_docs(spark, sf_dir), {"$nor": [{"size": {"$gt": 10}}, {"brand": "Brand#13"}], "name": {"$type": "string"}, "size": {"$type": "number"}})


@query("SELECT min(o_orderkey) AS doc_index FROM orders WHERE o_orderstatus = 'F'")
def find_one_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return as_docs(o, "o_orderkey", status=F.col("o_orderstatus")).find_one({"status": "F"}).select("doc_index")


@query("SELECT 7 AS doc_index, o_orderstatus AS status FROM orders WHERE o_orderkey = 7")
def data_at(spark, sf_dir):
    s = as_docs(table(spark, sf_dir, "orders"), "o_orderkey", status=F.col("o_orderstatus"))
    return s.data(7).select(F.col("doc_index").cast("int").alias("doc_index"), s.field("status").alias("status"))


@query("SELECT count(*) AS n FROM orders")
def doc_count(spark, sf_dir):
    return as_docs(table(spark, sf_dir, "orders"), "o_orderkey", status=F.col("o_orderstatus")).find().agg(F.count("*").alias("n"))


# --- ingest -----------------------------------------------------------------------------------------


@query("SELECT s_suppkey AS k, 0 AS chunk_no, 'first ' || s_name AS chunk FROM supplier UNION ALL SELECT s_suppkey, 1, 'second' || chr(10) || chr(10) || CAST(s_nationkey AS VARCHAR) FROM supplier UNION ALL SELECT -s_suppkey, 0, '' FROM supplier")
def split_sources(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    text = lit_lines("first ", F.col("s_name"), "\n--- \n \t\n---\nsecond\n\n", F.col("s_nationkey").cast("string"), "\n---\n")
    both = s.select(F.col("s_suppkey").alias("k"), text.alias("text")).union(s.select(-F.col("s_suppkey"), F.lit("---\n\n---")))
    return split_documents(both, keys=["k"])


@query("SELECT s_suppkey AS k, 'name: ' || s_name AS matter, 'body' AS body FROM supplier UNION ALL SELECT -s_suppkey, NULL, '+++' || chr(10) || s_name FROM supplier UNION ALL SELECT s_suppkey + 1000000, '', 'x' FROM supplier")
def front_matter_split(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_suppkey").alias("k"), lit_lines("\n+++ \nname: ", F.col("s_name"), "\n+++\nbody").alias("t"))
    rows = rows.union(s.select(-F.col("s_suppkey"), lit_lines("+++\n", F.col("s_name")))).union(s.select(F.col("s_suppkey") + 1000000, F.lit("+++\n+++\nx")))
    cut = rows.select("k", front_matter(F.col("t")).alias("f"))
    return cut.select("k", "f.matter", "f.body")


@query("SELECT p_partkey AS doc_index, p_name AS name, p_size + 1 AS size, 'two' AS kind, 'before' || chr(10) || 'after' AS content FROM part")
def data_fence_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = lit_lines("+++\nsize: 0\nkind: one\n+++\nbefore\n```data\nname: '", F.col("p_name"), "'\nsize: ", F.col("p_size").cast("string"), "\n```\nafter\n~~~data\nkind: two\nsize: ", (F.col("p_size") + 1).cast("string"), "\n~~~")
    s = DocSet(parse_documents(p.select(F.col("p_partkey").alias("source_id"), text.alias("text"), F.lit(None).cast("string").alias("meta_json")), ["source_id"]))
    return s.docs.select("doc_index", s.field("name").alias("name"), s.field("size", "int").alias("size"), s.field("kind").alias("kind"), "content")


@query("SELECT s_suppkey AS k, lower(t) AS tag FROM supplier, unnest(['Alpha', 'n' || CAST(s_nationkey AS VARCHAR), 'été-x']) u(t)")
def extract_tags(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    text = lit_lines("#Alpha and #n", F.col("s_nationkey").cast("string"), " #42 page#top \\#no `#code` {{ #expr }}\n% #line\n```\n#fenced\n```\n(#bracket) #alpha\n#Été-x")
    return s.select(F.col("s_suppkey").alias("k"), F.explode(T.body_tags(text)).alias("tag"))


@query("SELECT s_suppkey AS doc_index, 'dir/' || s_name || '.mdy' AS path, 'meta' AS kind, 'dir.' || s_name AS message_name, 'a,b,c' AS tags FROM supplier")
def meta_precedence(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = F.col("s_name")
    meta = F.to_json(F.struct(lit_lines("dir/", name, ".mdy").alias("path"), F.lit("meta").alias("kind")))
    text = F.lit("+++\npath: forged\nkind: own\ntags: [A, B]\n_id: 9\n+++\n#b #c")
    s = DocSet(parse_documents(s.select(F.col("s_suppkey").alias("source_id"), text.alias("text"), meta.alias("meta_json")), ["source_id"]))
    return s.docs.select("doc_index", "path", s.field("kind").alias("kind"), "message_name", F.array_join("tags", ",").alias("tags"))


@query("""SELECT s_suppkey AS doc_index, 'Yes' AS yes, 17 AS dec, 15 AS oct, 1000.0::DOUBLE AS exp, '2026-07-18' AS day, '12:30:00' AS clock, true AS t, NULL::VARCHAR AS inf FROM supplier""")
def yaml_core_types(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    text = F.lit("+++\nyes: Yes\ndec: 017\noct: 0o17\nexp: 1e3\nday: 2026-07-18\nclock: 12:30:00\nt: true\ninf: .inf\n+++\n")
    s = DocSet(parse_documents(s.select(F.col("s_suppkey").alias("source_id"), text.alias("text"), F.lit(None).cast("string").alias("meta_json")), ["source_id"]))
    return s.docs.select("doc_index", s.field("yes").alias("yes"), s.field("dec", "int").alias("dec"), s.field("oct", "int").alias("oct"), s.field("exp", "double").alias("exp"), s.field("day").alias("day"), s.field("clock").alias("clock"), s.field("t", "boolean").alias("t"), s.field("inf").alias("inf"))


# --- scalar functions -------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM documents) WHERE length(word) > 1 AND word NOT IN ({STOP})")
def tokenize_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("word"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower('  ' || p_name || ' & ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugify_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slugify(lit_lines("  ", F.col("p_name"), " & ", F.col("p_type"), "!")).alias("slug"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(trim(title)), '\s+', '-', 'g'), '[^\p{L}\p{N}\-/._#]+', '', 'g') AS slug FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages)")
def heading_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.heading_slug(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("slug"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y 00:00:00 GMT') AS pub_date FROM orders")
def rfc822_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.rfc822(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("pub_date"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') END AS day FROM orders")
def normalize_dates(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", " yyyy-MM-dd'T'HH:mm")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_date(text).alias("day"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'own.' || n_name WHEN n_nationkey % 3 = 1 THEN 'geo.' || CAST(n_regionkey AS VARCHAR) || '.' || n_name END AS name FROM nation")
def message_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 3
    declared = F.when(k == 0, lit_lines("own.", F.col("n_name"))).when(k == 1, "")
    path = F.when(k == 0, "ignored.mdy").when(k == 1, lit_lines("geo/", F.col("n_regionkey").cast("string"), "/", F.col("n_name"), ".mdy")).otherwise("")
    return n.select("n_nationkey", T.message_name(declared, path).alias("name"))


@query("""SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'must not start or end with a dot' WHEN 2 THEN 'must not contain two dots in a row'
WHEN 3 THEN 'must be a non-empty string' ELSE 'may only contain letters, digits, _ . - and have 1 to 128 characters' END AS problem FROM nation""")
def name_problems(spark, sf_dir):
    k = F.col("n_nationkey") % 6
    name = F.when(k == 0, "a.b_c-9").when(k == 1, ".a").when(k == 2, "a..b").when(k == 3, "").when(k == 4, "a b").otherwise(F.repeat(F.lit("x"), 129))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.name_problem(name).alias("problem"))


@query("SELECT page_id, CASE WHEN p = '' THEN 'index.html' ELSE p || '/index.html' END AS out_file FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '^/+|/+$', '', 'g') AS p FROM pages)")
def out_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_to_out_file(F.regexp_replace("url", "^https?://[^/]*", "")).alias("out_file"))


@query("SELECT page_id, href, CASE WHEN href LIKE '#%' THEN 'fragment' WHEN href LIKE '//%' OR regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'internet' ELSE 'page' END AS kind, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY ALL")
def page_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href", T.link_kind(F.col("href")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"SELECT page_id, regexp_replace(lower(url), '\s+', '-', 'g') AS link, split_part(url, ':', 1) IN ('https') OR NOT regexp_matches(url, '^[^:/?#]*:') AS allowed FROM pages")
def link_rules(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_link(F.col("url")).alias("link"), T.allowed_protocol(F.concat(F.lit(" "), F.substring("url", 1, 2), F.lit("\t"), F.expr("substring(url, 3)")), ["https"]).alias("allowed"))


@query("SELECT page_id, count(*) AS headings, min(t) AS first FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS t FROM pages) GROUP BY 1")
def page_headings(spark, sf_dir):
    titles = F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(titles).alias("t")).groupBy("page_id").agg(F.count("*").alias("headings"), F.min("t").alias("first"))


@query("""SELECT c_custkey, strpos(c_name, '#') - 1 AS at, substr(c_name, 1, 8) AS head, right(c_name, 3) AS tail, upper(c_mktsegment) AS up, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS padded,
replace(c_name, '0', 'o') AS replaced, printf('%.2f', c_acctbal) AS fixed, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS rounded, CAST(trunc(c_acctbal) AS DOUBLE) AS cut, len(string_split(c_name, '#')) AS pieces, CAST(substr(c_name, 10) AS BIGINT) AS number FROM customer""")
def guest_builtins(spark, sf_dir):
    c, name = table(spark, sf_dir, "customer"), F.col("c_name")
    return c.select(
        "c_custkey", G.index_of(name, "#").cast("long").alias("at"), G.slice_(name, 0, 8).alias("head"), G.slice_(name, -3).alias("tail"), G.to_upper_case(F.col("c_mktsegment")).alias("up"), G.pad_start(F.col("c_nationkey").cast("string"), 5, "0").alias("padded"),
        G.replace_all(name, "0", "o").alias("replaced"), G.to_fixed(F.col("c_acctbal"), 2).alias("fixed"), G.round_(F.col("c_acctbal")).alias("rounded"), G.trunc(F.col("c_acctbal")).alias("cut"), F.size(G.split(name, "#")).cast("long").alias("pieces"), G.parse_int(G.slice_(name, 9)).alias("number"),
    )


# --- joins, groups, windows ---------------------------------------------------------------------------


@query("SELECT o_orderkey, 'Order ' || CAST(o_orderkey AS VARCHAR) || ' (' || o_orderstatus || ')' || chr(10) || CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END || chr(10) || 'by: nobody' AS output FROM orders")
def render_each_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(None).cast("string").alias("by"))
    text = "Order {{ req.o_orderkey }} ({{ req.o_orderstatus }})\n% if req.o_totalprice > 100000 {\nlarge\n% } else {\nsmall\n% }\nby: {{ req.by ?? res.by }}"
    return template.render_rows(o, text, ["o_orderkey", "o_orderstatus", "o_totalprice", "by"], {"by": "'nobody'"}).select("o_orderkey", "output")


@query("SELECT l_orderkey, round(sum(l_quantity * l_extendedprice), 2) AS total, count(*) AS items FROM lineitem GROUP BY 1")
def invoice_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("total"), F.count("*").alias("items"))


@query("SELECT o_orderkey, '[' || string_agg('- ' || CAST(l_linenumber AS VARCHAR) || ' x ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), chr(10) ORDER BY l_linenumber, l_quantity) || ']' AS output FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def invoice_text(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("q")))).alias("items"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    out = template.render_rows(rows, "% for i of req.items {\n- {{ i.n }} x {{ i.q }}\n% }", ["items"])
    return out.select("o_orderkey", F.concat(F.lit("["), "output", F.lit("]")).alias("output"))


@query("SELECT c_custkey, '<b>' || c_name || '</b>' AS card, '<p><b>' || c_name || '</b> ' || c_mktsegment || '</p>' AS output FROM customer")
def compose_templates(spark, sf_dir):
    levels = {"page": ("<p>{{ req.card }} {{ req.c_mktsegment }}</p>", ["card"]), "card": ("<b>{{ req.c_name }}</b>", [])}
    c = table(spark, sf_dir, "customer")
    rows = template.compose(levels, c.select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"])
    card = template.render_rows(c.select("c_custkey", "c_name"), levels["card"][0], ["c_name"], name="card").select("c_custkey", "card")
    return rows.select("c_custkey", "output").join(card, "c_custkey")


@query("SELECT o_orderkey, c_name AS layout FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_layout(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("layout"))
    twice = c.withColumn("n", F.lit(1)).union(c.select("o_custkey", F.lit("later"), F.lit(2)))
    return R.lookup_first(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), twice, "o_custkey", ["n"]).select("o_orderkey", "layout")


CLASSES = "SELECT p_partkey, list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) AS ts FROM part"
PAIRS = f"""WITH c AS (SELECT ts, min(p_partkey) AS class, count(*) AS members FROM ({CLASSES}) GROUP BY ts),
p AS (SELECT a.class, b.class AS other, len(list_intersect(a.ts, b.ts)) AS shared, b.members FROM c a JOIN c b ON list_has_any(a.ts, b.ts))"""


@query(f"{PAIRS} SELECT d.p_partkey, c.class, CAST(l.links AS BIGINT) AS links FROM ({CLASSES}) d JOIN c ON d.ts = c.ts JOIN (SELECT class, sum(members) - 1 AS links FROM p GROUP BY 1) l ON c.class = l.class")
def related_docs(spark, sf_dir):
    return R.related(part_docs(spark, sf_dir).docs.withColumnRenamed("doc_index", "p_partkey"), "p_partkey", "tags")


@query(f"{PAIRS} SELECT class, other, CAST(shared AS BIGINT) AS shared, members FROM p")
def related_classes(spark, sf_dir):
    return R.related_classes(part_docs(spark, sf_dir).docs, "doc_index", "tags")


@query("SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_default(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("SELECT t AS tag, count(*) AS n FROM (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) AS t FROM part) GROUP BY 1")
def tag_index(spark, sf_dir):
    return R.tag_index(part_docs(spark, sf_dir).docs, "tags")


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS items FROM orders GROUP BY 1")
def group_list(spark, sf_dir):
    return R.list_per(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"])


@query("SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 5000) AS leads, bool_or(c_acctbal < 0) AS some, bool_and(c_acctbal > -990) AS every FROM customer GROUP BY 1")
def lead_count(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 5000).alias("leads"), F.bool_or(F.col("c_acctbal") < 0).alias("some"), F.bool_and(F.col("c_acctbal") > -990).alias("every"))


@query("SELECT o_orderkey, sum(1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM orders")
def running_total(spark, sf_dir):
    return R.running(table(spark, sf_dir, "orders").withColumn("one", F.lit(1)), ["o_custkey"], ["o_orderdate", "o_orderkey"], "one").select("o_orderkey", "running")


@query("SELECT p_partkey, lag(p_partkey) OVER w AS prev, lead(p_partkey) OVER w AS next FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_name, p_partkey)")
def prev_next(spark, sf_dir):
    return R.neighbours(table(spark, sf_dir, "part"), "p_brand", ["p_name", "p_partkey"], "p_partkey").select("p_partkey", "prev", "next")


@query("SELECT p_partkey, CAST(ceil(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) / 10.0) AS INT) AS page, CAST(ceil(count(*) OVER (PARTITION BY p_brand) / 10.0) AS INT) AS pages, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS position FROM part")
def paginate(spark, sf_dir):
    p = R.paginate(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], 10)
    return R.positions(p, ["p_brand"], ["p_partkey"]).select("p_partkey", "page", "pages", "position")


@query("SELECT p_brand || '/' || CAST(p_size AS VARCHAR) AS doc, p_partkey AS pos, lower(p_type) AS slug, lower(p_type) || CASE WHEN rn > 1 THEN '-' || CAST(rn - 1 AS VARCHAR) ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size, p_type ORDER BY p_partkey) AS rn FROM part)")
def heading_ids(spark, sf_dir):
    doc = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))
    p = table(spark, sf_dir, "part").select(doc.alias("doc"), F.col("p_partkey").alias("pos"), T.heading_slug(F.col("p_type")).alias("slug"))
    return R.heading_ids(p, "doc", "pos", "slug")


@query("SELECT s_nationkey AS k, min_by(s_name, s_suppkey) AS first FROM supplier GROUP BY 1")
def first_per_key(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("first"), "s_suppkey")
    return R.first_per(s, ["k"], ["s_suppkey"]).select("k", "first")


# --- outputs ------------------------------------------------------------------------------------------


@query("""SELECT '/o/' || CAST(o_orderkey AS VARCHAR) AS url, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%a, %d %b %Y 00:00:00 GMT') AS pub_date,
'<item><title>' || o_orderpriority || ' &amp; more</title><link>/o/' || CAST(o_orderkey AS VARCHAR) || '</link><pubDate>' || strftime(o_orderdate, '%a, %d %b %Y 00:00:00 GMT') || '</pubDate></item>' AS item
FROM orders ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, '/o/' || CAST(o_orderkey AS VARCHAR) LIMIT 20""")
def feed_top20(spark, sf_dir):
    posts = table(spark, sf_dir, "orders").select(lit_lines("/o/", F.col("o_orderkey").cast("string")).alias("url"), lit_lines(F.col("o_orderpriority"), " & more").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return site.feed_items(posts).select("url", "date", "pub_date", "item")


@query("SELECT DISTINCT 'https://site.example/t/' || lower(c_mktsegment) || '/' AS loc, 't/' || lower(c_mktsegment) || '/index.html' AS out_file FROM customer")
def sitemap(spark, sf_dir):
    return site.sitemap(table(spark, sf_dir, "customer").select(lit_lines("/t/", F.lower("c_mktsegment"), "/").alias("url")), "https://site.example/")


@query(f"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({STOP}))) AS ws, 'Title ' || CAST(doc_id AS VARCHAR) AS title FROM documents),
s AS (SELECT doc_id, len(list_filter(ws, lambda x: x IN ('title', '17', 'from', 'which'))) + CASE WHEN contains(lower(title), 'title 17 from which') THEN 1 ELSE 0 END AS score FROM w)
SELECT doc_id, CAST(score AS INT) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 8""")
def search_topk(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", lit_lines("Title ", F.col("doc_id").cast("string")).alias("title"), "text")
    return R.search_texts(d, "Title 17 from which", key="doc_id").select("doc_id", "score")


ASKED = "title ing oned and which edre"


@query(f"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({STOP}))) AS ws FROM documents),
s AS (SELECT doc_id, CAST(len(list_filter(ws, lambda x: x IN ('title', 'ing', 'oned', 'which', 'edre'))) AS INT) AS score FROM w)
SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def search_inverted(spark, sf_dir):
    """An inverted index, written sorted by word; the search reads the asked words' rows alone."""
    path = f"{shared_folder(spark)}/vellum-postings-{uuid.uuid4().hex}"
    R.inverted_index(table(spark, sf_dir, "documents"), "doc_id").repartitionByRange("word").sortWithinPartitions("word").write.parquet(path)
    return R.search_postings(spark.read.parquet(path), ASKED, "doc_id", 20)


@query(f"""SELECT page_id, count(DISTINCT w) AS words FROM (SELECT page_id, unnest(regexp_split_to_array(lower(url || ' ' || regexp_replace(html, '<[^>]*>', ' ', 'g')), '[^a-z0-9]+')) AS w FROM pages) WHERE length(w) > 1 AND w NOT IN ({STOP}) GROUP BY 1""")
def search_index(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url"), F.col("url").alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    words = site.search_index(p.select(F.col("page_id").cast("string").alias("url"), "title", "text"))
    return words.select(F.col("url").cast("long").alias("page_id"), F.size("words").cast("long").alias("words"))


@query("SELECT s_nationkey AS path, max_by(s_name, s_suppkey) AS content FROM supplier GROUP BY 1")
def emit_last_wins(spark, sf_dir):
    return site.emit(table(spark, sf_dir, "supplier"), F.col("s_nationkey"), F.col("s_name"), F.col("s_suppkey"))


@query("SELECT n_nationkey AS path, CASE WHEN n_regionkey = 1 THEN 'root' WHEN n_nationkey % 2 = 0 THEN 'static' ELSE n_name END AS content FROM nation")
def static_overlay(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "path")
    return site.with_static(n.select("path", F.col("n_name").alias("content")), n.where("path % 2 = 0").select("path", F.lit("static").alias("content")), n.where("n_regionkey = 1").select("path", F.lit("root").alias("content")))


@query("SELECT p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'create' WHEN p_partkey % 5 = 1 THEN 'delete' ELSE 'modify' END AS change FROM part WHERE p_partkey % 5 < 2 OR p_partkey % 7 = 0")
def snapshot_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "path")
    after = p.where("path % 5 <> 1").withColumn("p_size", F.when(F.col("path") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return R.snapshot_diff(p.where("path % 5 <> 0"), after, "path", "p_size")


@query("SELECT row_number() OVER (ORDER BY s, k) - 1 AS doc_index, name FROM (SELECT 0 AS s, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation)")
def union_sets(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    sets = [as_docs(r, "r_regionkey", name=F.col("r_name")), as_docs(n, "n_nationkey", name=F.col("n_name"))]
    whole = sets[0].union(sets[1])
    return whole.find().select("doc_index", whole.field("name").alias("name"))


# --- messages -----------------------------------------------------------------------------------------


def messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.col("props").alias("data_json"), "user_id")


def pages_of(spark, sf_dir) -> DataFrame:
    """click has one page, view two, all others none."""
    rows = spark.createDataFrame([("click", "a.mdy", ".mdy"), ("view", "b.mdy", ".mdy"), ("view", "c.md", ".md"), ("signup", "d.png", ".png"), ("error", "e.mdy", ".mdy")], "message_name string, path string, ext string")
    return bus.address_book(rows)


@query("SELECT event_id AS seq FROM events WHERE event_type IN ('click', 'error')")
def publish_resolved(spark, sf_dir):
    m = messages(spark, sf_dir)
    sound = bus.resolve(m, pages_of(spark, sf_dir)).where("problem is null").drop("problem")
    return bus.publish(sound, pages_of(spark, sf_dir)).select("seq")


@query("SELECT event_type AS name, CASE WHEN event_type = 'view' THEN 'several pages have this name' ELSE 'no page has this name' END AS problem, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'error') GROUP BY 1, 2")
def publish_problems(spark, sf_dir):
    return bus.resolve(messages(spark, sf_dir), pages_of(spark, sf_dir)).where("problem is not null").groupBy("name", "problem").agg(F.count("*").alias("n"))


@query("SELECT event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id) + CASE WHEN event_type = 'click' THEN 100 ELSE 0 END AS index FROM events")
def log_index(spark, sf_dir):
    return bus.log_index(messages(spark, sf_dir), spark.createDataFrame([("click", 100)], "name string, last long")).select("seq", "index")


@query("SELECT event_id AS seq, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 16 AS batch FROM events")
def take_batches(spark, sf_dir):
    return bus.batches(bus.log_index(messages(spark, sf_dir))).select("seq", "batch")


@query("SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type AS name, CAST(1 AS INT) AS attempts FROM events")
def envelopes(spark, sf_dir):
    m = bus.log_index(messages(spark, sf_dir)).withColumn("attempts", F.lit(None).cast("int"))
    e = m.select("seq", bus.envelope(F.col("data_json"), F.col("name"), F.col("index"), F.col("attempts")).alias("e"))
    return e.select("seq", F.get_json_object("e", "$.k").cast("int").alias("k"), F.get_json_object("e", "$.msg.name").alias("name"), F.get_json_object("e", "$.msg.attempts").cast("int").alias("attempts"))


DELIVERED = """SELECT event_id AS seq, event_type AS name, user_id % 6 + 1 AS attempts, CASE WHEN event_type = 'click' AND user_id % 3 > 0 THEN 'done' WHEN event_type = 'error' AND user_id % 3 > 0 THEN 'done' WHEN user_id % 6 + 1 >= 5 THEN 'dead' ELSE 'failed' END AS status FROM events"""


def delivered(spark, sf_dir) -> DataFrame:
    log = bus.log_index(messages(spark, sf_dir)).withColumn("attempts", (F.col("user_id") % 6 + 1).cast("int"))
    return bus.deliver(log, pages_of(spark, sf_dir), F.col("user_id") % 3 == 0)


@query(f"SELECT seq, status FROM ({DELIVERED})")
def deliver_status(spark, sf_dir):
    return delivered(spark, sf_dir).select("seq", "status")


@query(f"SELECT name || '.dead' AS name, count(*) AS n, max(i) AS last FROM (SELECT name, row_number() OVER (PARTITION BY name ORDER BY seq) AS i FROM ({DELIVERED}) WHERE status = 'dead') GROUP BY 1")
def dead_letters(spark, sf_dir):
    return bus.dead_letters(delivered(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"), F.max("index").alias("last"))


@query(f"SELECT name, 1000 + row_number() OVER (PARTITION BY name ORDER BY seq) AS index, 1 AS attempts FROM ({DELIVERED}) WHERE status = 'dead'")
def requeue_dead(spark, sf_dir):
    last = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct().withColumn("last", F.lit(1000).cast("long"))
    return bus.requeue(bus.dead_letters(delivered(spark, sf_dir)), last).select("name", "index", "attempts")


@query("SELECT event_id AS seq, a AS attempt, CAST(list_sum(list_transform(generate_series(1, a - 1), lambda i: least(1000 * power(2, i - 1), 300000))) AS BIGINT) AS due_ms FROM events, generate_series(2, 12) g(a) UNION ALL SELECT event_id, 1, 0 FROM events")
def retry_schedule(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("attempt"))
    return e.select("seq", F.col("attempt").cast("long").alias("attempt"), bus.due_ms(F.col("attempt")).alias("due_ms"))


@query("SELECT event_id AS seq FROM (SELECT event_id, props, lag(props, 1, props) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events) WHERE props IS DISTINCT FROM b")
def fresh_messages(spark, sf_dir):
    first = messages(spark, sf_dir).groupBy("name").agg(F.min_by("data_json", "seq").alias("d"))
    return bus.fresh(messages(spark, sf_dir), first.select("name", F.xxhash64("d").alias("last_hash"))).select("seq")


@query(f"SELECT 2 * seq AS seq FROM ({DELIVERED}) WHERE status = 'done'")
def onward_publish(spark, sf_dir):
    d = delivered(spark, sf_dir)
    children = d.select((F.col("seq") * 2).alias("seq"), F.col("name").alias("parent_name"), F.col("index").alias("parent_index"))
    return bus.onward(children, d).select("seq")


@query()
def drain_stream(spark, sf_dir):
    """The events as a stream of messages, drained once; rows as the batch policy gives them."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet")
    events = source.parquet(f"{sf_dir}/events*")
    m = events.select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), (F.col("user_id") % 7).cast("int").alias("fail_times"))
    folder = f"{shared_folder(spark)}/vellum-drain-{uuid.uuid4().hex}"
    bus.run_drain(m, f"{folder}/out", f"{folder}/state")
    return spark.read.schema("name string, index long, seq long, attempts int, status string").parquet(f"{folder}/out")


# --- markup -------------------------------------------------------------------------------------------


def markup_docs(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    text = lit_lines("= Intro\n\nHello !!", F.col("s_name"), "!! see [[ Other Page | /p/", F.col("s_suppkey").cast("string"), " ]] and #tag.\n\n== Part ", F.col("s_nationkey").cast("string"), "\n\n- [ ] open\n- [x] done\n  more\n\n== Intro\n\n```js\n= no heading\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n")
    return s.select(F.col("s_suppkey").alias("doc_index"), text.alias("content"))


@query("SELECT s_suppkey AS doc_index, d AS depth, t AS text, g AS slug FROM (SELECT s_suppkey, unnest([{'d': 1, 't': 'Intro', 'g': 'intro'}, {'d': 2, 't': 'Part ' || CAST(s_nationkey AS VARCHAR), 'g': 'part-' || CAST(s_nationkey AS VARCHAR)}, {'d': 2, 't': 'Intro', 'g': 'intro-1'}], recursive := true) FROM supplier)")
def markup_headings(spark, sf_dir):
    return markup.headings(markup.nodes(markup_docs(spark, sf_dir))).select("doc_index", "depth", "text", "slug")


@query("SELECT s_suppkey AS doc_index, '- [[Intro|#intro]]' || chr(10) || '  - [[Part ' || CAST(s_nationkey AS VARCHAR) || '|#part-' || CAST(s_nationkey AS VARCHAR) || ']]' || chr(10) || '  - [[Intro|#intro-1]]' AS toc FROM supplier")
def markup_toc(spark, sf_dir):
    return markup.toc(markup.headings(markup.nodes(markup_docs(spark, sf_dir))))


@query("SELECT s_suppkey AS doc_index, h AS href FROM supplier, unnest(['/p/' || CAST(s_suppkey AS VARCHAR), '/tags/tag']) u(h)")
def markup_links(spark, sf_dir):
    return markup.links(markup.nodes(markup_docs(spark, sf_dir))).select("doc_index", "href")


@query("SELECT s_suppkey AS doc_index, l AS line, 4 AS \"column\", l = 8 AS done FROM supplier, unnest([7, 8]) u(l)")
def markup_tasks(spark, sf_dir):
    return markup.tasks(markup.nodes(markup_docs(spark, sf_dir)))


@query("""SELECT s_suppkey AS doc_index, '<h1 id="intro">Intro</h1><p>Hello <strong>' || s_name || '</strong> see <a href="/p/' || CAST(s_suppkey AS VARCHAR) || '">Other Page</a> and <a class="tag" href="/tags/tag">#tag</a>.</p><h2 id="part-' || CAST(s_nationkey AS VARCHAR) || '">Part ' || CAST(s_nationkey AS VARCHAR) || '</h2><ul class="contains-task-list"><li class="task-list-item"><input disabled type="checkbox"> open</li><li class="task-list-item"><input checked disabled type="checkbox"> done more</li></ul><h2 id="intro-1">Intro</h2><pre><code class="language-js">= no heading' || chr(10) || '</code></pre><table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>' AS html FROM supplier""")
def markup_html(spark, sf_dir):
    t = markup.nodes(markup_docs(spark, sf_dir))
    return markup.to_html(t.withColumn("props", F.map_from_entries(F.array_sort(F.map_entries("props")))))


@query("SELECT s_suppkey AS doc_index, 'IntroHello ' || s_name || ' see Other Page and #tag.Part ' || CAST(s_nationkey AS VARCHAR) || ' open done moreIntro= no heading' || chr(10) || 'ab12' AS text FROM supplier")
def markup_text(spark, sf_dir):
    return markup.text_of(markup.nodes(markup_docs(spark, sf_dir)))


from . import language_queries  # noqa: E402, F401 - registers the queries of pages, code, markup and directories
