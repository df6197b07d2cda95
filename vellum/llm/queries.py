"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, toxicity
from .bpe import encode_documents
from .decontamination import contamination
from .exact_dedup import exact_dedup
from .licenses import COMMENT, RUN, TEMPLATES, license_scan
from .sharding import shard_documents
from .simhash import near_duplicates
from .token_counts import context_limits, length_histogram
from .token_files import read_token_files, write_token_files


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return sharded.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_limits(length_histogram(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return bpe_digests(encoded)


def bpe_digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_token_files(manifest)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host: their source) and pages in one table; doc_id is null for pages, page_id for documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    texts = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"), F.col("source").alias("host"))
    web = pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", language.html_text(F.col("html")).alias("text"), language.declared_language(F.col("html")).alias("declared"), language.host_of(F.col("url")).alias("host"))
    return language.identify(texts.union(web), language.train(docs), ["doc_id", "page_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_bpe": op6_bpe,
    "op7_token_files": op7_token_files,
    "op8_decontamination": op8_decontamination,
    "op9_licenses": op9_licenses,
    "op10_language": op10_language,
}

def license_sql() -> str:
    """The licence scan in SQL: every passage's bigrams against every template's."""
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in sorted(TEMPLATES.items()))
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    pairs = "CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"
    return f"""
        WITH t(license, body) AS (VALUES {rows}),
        tw AS (SELECT license, {pairs} AS b FROM (SELECT license, string_split({norm.format('body')}, ' ') AS w FROM t)),
        tb AS (SELECT license, len(b) AS size, unnest(b) AS bigram FROM tw),
        o AS (SELECT doc_id, text, regexp_split_to_array(regexp_replace(text, '{COMMENT}', '', 'g'), '\\n(?:[ \\t\\r]*\\n)+') AS ps FROM documents WHERE text IS NOT NULL),
        x AS (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), flatten(list_transform(range(1, len(ps) + 1), lambda i: list_transform(range(1, least({RUN}, len(ps) - i + 1) + 1), lambda k: array_to_string(list_slice(ps, i, i + k - 1), chr(10))))), [text])) AS passage FROM o),
        p AS (SELECT *, row_number() OVER () AS num FROM (SELECT DISTINCT doc_id, {norm.format('passage')} AS n FROM x) WHERE n <> ''),
        pw AS (SELECT doc_id, num, {pairs} AS b FROM (SELECT doc_id, num, string_split(n, ' ') AS w FROM p)),
        pb AS (SELECT doc_id, num, len(b) AS n, unnest(b) AS bigram FROM pw),
        s AS (SELECT doc_id, license, round(2 * count(*) / (n + size), 6) AS dice FROM pb JOIN tb USING (bigram) GROUP BY doc_id, num, license, n, size),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license) AS k FROM s WHERE dice >= 0.8),
        g AS (SELECT doc_id, count(DISTINCT license) AS licenses FROM r GROUP BY doc_id)
        SELECT d.doc_id, r.license, r.dice, CAST(coalesce(g.licenses, 0) AS INT) AS licenses
        FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r.k = 1 LEFT JOIN g ON d.doc_id = g.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op9_licenses": license_sql(),
}
