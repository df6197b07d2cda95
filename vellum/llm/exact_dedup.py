"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep one id.

The hash and the text are grouping keys together: rows are found by hash and told apart by their
bytes, so two texts with one hash fall into two groups. Copies collapse before the shuffle (one row
for each text and map task), each distinct text is shuffled once, and no group is ever gathered.
Rows then look up their group by hash and SHA-256; heavy groups are served by broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ids_and_texts, lookup, materialize


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text equals an empty one. The largest doc_id of a
    group stays. Null ids never win over an id; a group with null ids only has keep_id null and all
    its rows kept. Rows that repeat an id and a text are counted each and share one verdict. An
    empty table gives an empty result.
    """
    base = ids_and_texts(docs, id_col, text_col).withColumn("h", hash128(F.col("text")))
    groups = base.groupBy("h", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    copies = groups.where("group_size > 1").select("h", F.unhex(F.sha2("text", 256)).alias("s"), "keep_id", "group_size")
    copies = materialize(copies, "copies")
    thin = base.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("s"))
    found = lookup(thin, copies, ["h", "s"], ["keep_id", "group_size"], "group_size", "doc_id")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128: Callable[[Column], Column] = md5_128) -> DataFrame:
    """docs with one row for each text: that of the largest id, with all its columns. Of rows with
    equal text and id (or of null ids only) one stays, chosen by a hash of the other columns."""
    text, others = docs[text_col], [c for c in docs.columns if c != text_col]
    plain = [c for c, kind in docs.dtypes if c not in (text_col, id_col) and not kind.startswith(("map", "variant")) and "map<" not in kind]
    order = F.struct(F.coalesce(docs[id_col].cast("long"), F.lit(-(2**63))), F.xxhash64(*[docs[c] for c in plain]) if plain else F.lit(0))
    packed = docs.select(F.coalesce(text, F.lit("")).alias("t"), F.struct(text.isNull().alias("no_text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(others)]).alias("row"), order.alias("o"))
    kept = packed.groupBy(hash128(F.col("t")).alias("h"), "t").agg(F.max_by("row", "o").alias("row"))
    back = {c: F.col(f"row.c{i}") for i, c in enumerate(others)} | {text_col: F.when(~F.col("row.no_text"), F.col("t"))}
    return kept.select(*[back[c].alias(c) for c in docs.columns])
