"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the text's likelihood under byte-trigram models, the
language that markup declares, the suffix of the address, and a prior of the host. The models are
fitted on a bounded sample of labelled texts; how far declarations and suffixes can be trusted, and
the host priors, are counted over all rows by grouped aggregation. A host's prior is smoothed by its
registered domain's, that by its suffix's, that by all rows', each without the row that is judged;
what is absent says nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import lookup, materialize

#: Labelled texts that the trigram models are fitted on, and hash buckets of a model.
TRAIN_TEXTS, BUCKETS = 8_192, 1 << 15
#: Trigrams of a text that count as independent at most: a text repeats itself, so its evidence is
#: the mean of all its trigrams times this many.
INDEPENDENT = 60
#: Pseudo-counts that a level of the priors gives to the level above it, and of the other tables.
SMOOTHING, PSEUDO = 5.0, 1.0
#: Languages of a model at most.
LANGUAGES = 512
#: Labels under which the registries of countries register names.
SECOND_LEVEL = "ac co com edu go gob gov gv ne net or org".split()
#: Bytes of a text whose trigrams are counted at once.
BLOCK = 1 << 20


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the byte trigrams of a lower-cased text, block by block."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(raw) - 2, BLOCK):
        b = raw[at : at + BLOCK + 2].astype(np.uint32)
        yield ((b[:-2] * 0x9E3779B1 ^ b[1:-1] * 0x85EBCA6B ^ b[2:] * 0xC2B2AE35) >> 13) % BUCKETS


def _counts(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for h in trigrams(text or ""):
                    total[languages.index(lang)] += np.bincount(h, minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    return run


class TextModel:
    """languages, and log likelihoods of trigram buckets, one row per bucket."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.table = np.ascontiguousarray(np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)).T, np.float32)

    def evidence(self, text: str | None) -> list[float]:
        """Log likelihoods of the text relative to their largest; all 0 without a trigram."""
        total, n = np.zeros(len(self.languages)), 0
        for h in trigrams(text or "") if (text or "").strip() else ():
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        total *= min(n, INDEPENDENT) / max(n, 1)
        return (total - total.max()).tolist()


def train(texts: DataFrame, max_texts: int = TRAIN_TEXTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Fits trigram models on at most max_texts labelled texts, in the order of a hash of their ids,
    leaving out ids with crc32(id) mod 5 = 0. Languages are those that the sample declares; more than
    LANGUAGES are an error, for a model of each is held in memory. Null labels are left out. Without a label there is no language and no evidence."""
    known = texts.select(F.col(id_col).cast("long").alias("id"), F.lower(F.trim(F.col(lang_col))).alias("lang")).where("id is not null and lang <> ''")
    chosen = known.where(F.crc32(F.col("id").cast("string")) % 5 != 0).groupBy("id").agg(F.max("lang").alias("lang")).orderBy(F.xxhash64("id"), "id").limit(max_texts)
    chosen = materialize(chosen, "labels")  # at most max_texts rows
    languages = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"{len(languages)} languages are declared, {LANGUAGES} can be told apart")
    if not languages:
        return TextModel(["und"], np.zeros((1, BUCKETS)))
    body = texts.select(F.col(id_col).cast("long").alias("tid"), F.col(text_col).cast("string").alias("text"))
    sample = body.join(F.broadcast(chosen), F.col("tid") == F.col("id")).select("lang", "text")
    sums = sample.mapInArrow(_counts(languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), BUCKETS))
    for r in sums.toLocalIterator():  # at most LANGUAGES x BUCKETS numbers
        counts[r["lang"], r["bucket"]] = r["n"]
    return TextModel(languages, counts)


def _likelihoods(model: TextModel, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([model.evidence(t) for t in batch.column(at).to_pylist()], pa.list_(pa.float64()))
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, values], [*(n for i, n in enumerate(batch.schema.names) if i != at), "ll"])

    return run


def html_text(html: Column) -> Column:
    """Visible text of markup: scripts, styles, comments and tags become spaces, common entities characters."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return bare


def declared_language(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute, lower case; null if there is none."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", 1))
    return F.nullif(found, F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels, three under a country's own second level (`example.co.uk`); addresses of one label stand for themselves."""
    under = F.substring_index(F.substring_index(host, ".", -2), ".", 1).isin(SECOND_LEVEL) & host.rlike(r"\.[a-z]{2}$")
    return F.when(under, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def identify(rows: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """keys, lang, confidence, text_lang: the language of the largest posterior (the first in the
    order of names among equals), its posterior, and that of the text alone (null without evidence).

    rows: the key columns, text, declared, host (all strings; null: absent). Null and empty texts are
    judged by the rest of the evidence; a row without any gets the prior of all rows. Repeated rows
    count each; an empty table gives an empty result.
    """
    n, names = len(model.languages), F.array(*[F.lit(x) for x in model.languages])
    kept = rows.select(*keys, "text", F.lower(F.col("declared")).alias("declared"), F.lower(F.col("host")).alias("host"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes if c != "text") + ", ll array<double>"
    at = kept.columns.index("text")
    seen = materialize(kept.mapInArrow(_likelihoods(model, at), schema), "evidence")
    # the text's own posterior, the sign of which language a row counts for in the tables below
    powers = F.transform("ll", lambda x: F.exp(x))
    share = F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))
    informed = F.array_min("ll") < 0
    cols = [f"m{i}" for i in range(n)]
    nothing = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.lit(0.0))
    # hosts without a text that says something are known too, by their domain and suffix
    parts = seen.select("declared", "host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), F.when(informed, share).otherwise(nothing).alias("share"))
    hosts = materialize(parts.groupBy("host", "domain", "suffix").agg(*[F.sum(F.get("share", F.lit(i))).alias(c) for i, c in enumerate(cols)], F.count("*").alias("rows")), "hosts")
    whole = hosts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols]).first()
    every = F.array(*[F.lit(float(whole[c])) for c in cols])

    def vector(prefix: str = "") -> Column:
        return F.array(*[F.coalesce(F.col(f"{prefix}{c}"), F.lit(0.0)) for c in cols])

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)

    def level(name: str) -> DataFrame:
        found = hosts.where(F.col(name).isNotNull()).groupBy(name).agg(*[F.sum(c).alias(c) for c in cols])
        return found.select(F.col(name).alias(f"{name}_key"), vector().alias(f"{name}_counts"))

    table = hosts.where("host is not null")
    for name in ("domain", "suffix"):
        table = table.join(level(name), F.col(name) == F.col(f"{name}_key"), "left")
    table = table.select("host", "rows", vector().alias("host_counts"), "domain_counts", "suffix_counts")
    # P(declared | language): a declaration that texts contradict is trusted less
    said = materialize(parts.where("declared is not null").groupBy("declared").agg(*[F.sum(F.get("share", F.lit(i))).alias(c) for i, c in enumerate(cols)], F.count("*").alias("times")), "declared")
    sums = said.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols], F.count("*").alias("tags")).first()
    heard = F.array(*[F.log((F.col(c) + PSEUDO) / F.lit(float(sums[c]) + PSEUDO * (sums["tags"] + 1))) for c in cols])
    told = said.select("declared", "times", F.transform(heard, lambda x: x - F.array_max(heard)).alias("told"))
    rated = seen.withColumn("own", F.when(informed, share).otherwise(nothing))
    rated = lookup(rated, materialize(told, "told"), ["declared"], ["told"], "times", "ll")
    found = lookup(rated, materialize(table, "priors"), ["host"], ["host_counts", "domain_counts", "suffix_counts"], "rows", "ll")

    def others(counts: Column) -> Column:
        """Counts without the row's own: its text is weighed by its likelihood alone."""
        return F.zip_with(F.coalesce(counts, F.col("own")), "own", lambda c, x: F.greatest(c - x, F.lit(0.0)))

    def smoothed(counts: Column, above: Column) -> Column:
        return F.transform(F.arrays_zip(counts.alias("c"), above.alias("p")), lambda x: (x["c"] + SMOOTHING * x["p"]) / (total(counts) + SMOOTHING))

    prior = F.transform(others(every), lambda c: (c + PSEUDO) / (total(others(every)) + PSEUDO * n))
    for name in ("suffix", "domain", "host"):
        found = found.withColumn("_prior", prior).withColumn("_counts", others(F.col(f"{name}_counts")))
        prior = smoothed(F.col("_counts"), F.col("_prior"))
    log_prior = F.transform(prior, lambda p: F.log(p))
    post = F.zip_with(F.zip_with("ll", F.coalesce("told", nothing), lambda a, b: a + b), log_prior, lambda a, b: a + b)
    best = F.array_max("post")
    return found.withColumn("post", post).select(
        *keys,
        F.get(names, F.array_position("post", best).cast("int") - 1).alias("lang"),
        F.round(1 / F.aggregate(F.transform("post", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, b: a + b), 6).alias("confidence"),
        F.when(F.array_min("ll") < 0, F.get(names, F.array_position("ll", F.array_max("ll")).cast("int") - 1)).alias("text_lang"),
    )
