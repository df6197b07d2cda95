"""Shared building blocks of the corpus operators: shared scratch tables, a lookup join that
no hot key can bend out of shape, row removal by id, and connected components.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup table that are sent to every task: the heaviest keys. A key outside the
#: heaviest HOT_KEYS holds less than 1/HOT_KEYS of all rows.
HOT_KEYS = 1000
#: Ids that may be broadcast for an anti-join; beyond it the join is by shuffle.
BROADCAST_IDS = 500_000


#: Folders that this process has made, for `release`.
_made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path under the shared checkpoint folder. Where none is set a local run gets one
    of its own; a cluster has to name one, for its machines share no temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get()
    _made.append(f"{base.rstrip('/')}/vellum-{label}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Deletes the tables written so far; results that still read them must have been used."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: lineage ends there, and a lost
    executor costs no more than the tasks it was running. `release` deletes such tables."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once a row, even if a lambda in body reads it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty; whatever else the table has is left behind, so
    no column name of the input can clash with one of an operator."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], values: Sequence[str], weight: str, spread: str) -> DataFrame:
    """rows left-joined to table (unique in `on`, cheap to read again) without a hot partition.

    The HOT_KEYS heaviest keys by `weight` are broadcast (their number is fixed). Rows they serve
    then travel under their `spread` value with a flag that nothing in the table has, so that what
    is dealt out by key holds no key with more than 1/HOT_KEYS of the rows.
    """
    keys = list(on)
    hot = table.orderBy(F.desc(weight), *keys).limit(HOT_KEYS)
    hot = hot.select(*[F.col(k).alias(f"_hk{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_hot"))
    joined = rows.join(F.broadcast(hot), _all_equal(rows, hot, keys, "_hk"), "left").drop(*[f"_hk{i}" for i in range(len(keys))])
    served = F.col("_hot").isNotNull()
    joined = joined.withColumns({"_dealt": F.when(served, F.coalesce(F.xxhash64(F.col(spread)), F.lit(0))).otherwise(F.lit(-1)), **{f"_rk{i}": F.when(~served, F.col(k)) for i, k in enumerate(keys)}})
    cold = table.select(*[F.col(k).alias(f"_ck{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_cold"), F.lit(-1).cast("long").alias("_open"))
    match = F.col("_dealt") == F.col("_open")
    for i in range(len(keys)):
        match = match & (F.col(f"_rk{i}") == F.col(f"_ck{i}"))
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.join(cold, match, "left").select(*rows.columns, *[found[v].alias(v) for v in values])


def _all_equal(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & (left[k] == right[f"{prefix}{i}"])
    return match


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs minus the rows whose id is in ids (one column). ids is broadcast only if its counted
    rows are at most BROADCAST_IDS, else both sides are dealt by id. Rows without an id stay."""
    gone = ids.select(F.col(ids.columns[0]).cast("long").alias("_gone_id")).distinct()
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs[id_col].cast("long") == F.col("_gone_id"), "left_anti")


def with_found(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id of every row of docs with found's columns (found: doc_id, unique and not null, and
    more), null where found has no such id. The broadcast has the bound of `without_ids`."""
    found = materialize(found.withColumnRenamed("doc_id", "_found_id"), "found")
    small = found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(F.broadcast(found) if small else found, F.col("doc_id") == F.col("_found_id"), "left").drop("_found_id")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: of one ordered type); root is the smallest node reachable.

    Star contraction: in each round every node ties itself and its neighbours to the smallest of
    them. A round is one grouped minimum and one skew-proof lookup, on edges only, written to the
    shared folder; it ends when a round changes nothing.
    """
    ordered = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    now, before = materialize(ordered, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if mark == before or mark[0] == 0:
            roots = now.select("lo").distinct()
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots.select("lo", "lo"))
        before = mark
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        least = materialize(least, "least")
        tied = lookup(both, least, ["u"], ["m"], "degree", "v").select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
        now = materialize(tied.where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "edges")


def smallest_ids(classes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, component_id, n) of classes (key, least [smallest id or null], n): component_id is the
    smallest id of a class's component; found: (node, root) over keys, for the classes that have links."""
    linked = materialize(classes.join(found, classes[key] == found["node"]).select(key, "least", "root"), "linked")
    whole = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("w"))
    named = lookup(linked, materialize(whole, "whole"), ["root"], ["component_id"], "w", key).select(F.col(key).alias("_k"), "component_id", F.lit(True).alias("_tied"))
    out = classes.join(named, F.col(key) == F.col("_k"), "left")
    return materialize(out.select(key, F.when(F.col("_tied"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), "n"), "tied")
