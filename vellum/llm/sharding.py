"""Sharding: a two-pass external shuffle.

Pass one counts the rows of each bucket (a seeded hash of id, text and copy number) and turns the
counts into each bucket's first place by prefix sums. Pass two scatters whole records into those
memory-sized buckets, one partition each, puts a bucket into the order of its hashes, shuffles it in
memory (Spark's `shuffle` is a Fisher-Yates seeded by seed and partition) and writes it. A record's
place in the shuffled order decides shard and slot, so shards differ by one row at most, and the same
seed gives the same shards however the input was partitioned and whatever was retried.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import lookup, materialize, scratch

#: Bytes of text that one bucket holds on average, and buckets (partitions of one shuffle) at most.
BUCKET_BYTES, BUCKETS = 16 << 20, 131_072
#: Copies that one row of the table of repeated rows stands for.
RUN = 4096


def _copies(docs: DataFrame, text: Column, id_col: str) -> DataFrame:
    """docs with _id, hashes _h (of all columns) and _c (of the text), and _copy: the row's number
    among the rows that equal it in all columns. Equal rows are counted (partial counts before the
    shuffle) and dealt out again from their count, in runs, so a third of all rows may be one row."""
    hashed = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    marked = docs.withColumns({"_id": F.col(id_col).cast("long"), "_h": F.xxhash64(*hashed), "_c": F.crc32(text)})
    again = materialize(marked.groupBy("_id", "_h", "_c").agg(F.count("*").alias("_n")).where("_n > 1"), "repeated")
    if again.isEmpty():
        return marked.withColumn("_copy", F.lit(0).cast("long"))
    # null ids are named by a flag, for lookups join by equality
    named = again.select(F.coalesce("_id", F.lit(0)).alias("_i"), F.col("_id").isNull().alias("_none"), "_h", "_c", "_n")
    rows = marked.withColumns({"_i": F.coalesce("_id", F.lit(0)), "_none": F.col("_id").isNull()})
    rows = lookup(rows, named, ["_i", "_none", "_h", "_c"], ["_n"], "_n", "_h").drop("_i", "_none")
    alone = rows.where("_n is null").drop("_n").withColumn("_copy", F.lit(0).cast("long"))
    whole = rows.where("_n is not null").drop("_n")
    grouped = whole.groupBy(*whole.columns).agg(F.count("*").alias("_n"))
    runs = grouped.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))))
    last = F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1
    return alone.unionByName(runs.repartition("_h", "_run").withColumn("_copy", F.explode(F.sequence(F.col("_run") * RUN, last))).drop("_n", "_run"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 20240501, bucket_bytes: int = BUCKET_BYTES, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as Parquet at `path` (default: the shared folder) in shuffled order and returns
    the table read back: docs' columns, size, law, shard, slot, grown_shard.

    The law is `rows`: shard counts are at most one apart and slots gapless from 0, whatever the
    sizes; grown_shard is null. size is the text's UTF-8 bytes plus 1 (null text: 1). Equal texts
    have no say: copies are spread like any other rows. Rows with a null id scatter by their text;
    repeated rows each get a place of their own, also if they are a third of the table. Input columns
    named like an added one (in any case) give way to it. With fewer rows than shards some shards are
    empty; an empty table gives an empty one.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark, added = docs.sparkSession, {"size", "law", "shard", "slot", "grown_shard"}
    carried = [c for c in docs.columns if c.lower() not in added]
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    rows, volume = docs.agg(F.count("*"), F.sum(size)).first()
    path = path or scratch(spark, "shards")
    buckets = min(BUCKETS, max(1, ceil((volume or 0) / bucket_bytes)))
    marked = _copies(docs.select(*carried), text, id_col)
    key = F.xxhash64(F.lit(seed), "_id", "_h", "_c", "_copy")
    bucket = F.pmod(key, F.lit(buckets)).cast("int").alias("_bucket")
    counts = marked.groupBy(bucket).agg(F.count("*").alias("n"))
    first = counts.select("_bucket", (F.sum("n").over(W.orderBy("_bucket")) - F.col("n")).alias("first"))
    record = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)], size.alias("size"))
    dealt = marked.select(bucket, F.struct(key.alias("k"), F.col("_id").alias("i"), F.col("_copy").alias("n")).alias("o"), record.alias("row")).repartitionById(buckets, "_bucket")
    packed = dealt.groupBy("_bucket").agg(F.collect_list(F.struct("o", "row")).alias("rows"))
    ordered = F.array_sort("rows", lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    placed = packed.join(F.broadcast(first), "_bucket").select("first", F.posexplode(F.shuffle(ordered, seed)).alias("pos", "x"))
    n = max(1, rows)
    shard = f"((first + pos) * {shards} div {n})"
    start = F.expr(f"({shard} * {n} + {shards - 1}) div {shards}")
    out = placed.select(*[F.col(f"x.row.c{i}").alias(c) for i, c in enumerate(carried)], F.col("x.row.size").alias("size"), F.lit("rows").alias("law"), F.expr(f"cast({shard} as int)").alias("shard"), (F.col("first") + F.col("pos") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)
