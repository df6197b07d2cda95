"""Messages between documents: addresses, an ordered log, delivery with retries, dead letters.

The policy is plain columns over a log, so a batch query states it exactly; `drain` runs the same
policy as a stream with keyed state, where messages of a name are taken in the order of their `seq`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_problem
from ..operators.relational import beside, prefix_sum

#: Attempts before a message is dead, first pause and longest pause in ms, messages per take, rounds of a drain.
MAX_ATTEMPTS, BACKOFF_MS, CAP_MS, TAKE, ROUNDS = 5, 1000, 300_000, 16, 32
#: Fixed value: how long a claimed message stays with its worker.
LEASE_MS = 30_000
#: Names that may be broadcast.
BOOK = 100_000


def address_book(docs: DataFrame) -> DataFrame:
    """(name, paths): the pages each message name stands for."""
    pages = docs.where(F.coalesce("ext", F.lit("")).isin("", ".mdy", ".md") & F.col("message_name").isNotNull())
    return pages.groupBy(F.col("message_name").alias("name")).agg(F.count("*").alias("pages"), F.min("path").alias("path"))


def resolve(messages: DataFrame, book: DataFrame) -> DataFrame:
    """messages with problem: null if the name is allowed and stands for one page."""
    bad = name_problem(F.col("name"))
    found = messages.join(book.select(F.col("name").alias("_n"), "pages"), F.col("name") == F.col("_n"), "left").drop("_n")
    return found.withColumn("problem", F.when(bad.isNotNull(), bad).when(F.col("pages").isNull(), "no page has this name").when(F.col("pages") > 1, "several pages have this name")).drop("pages")


def publish(messages: DataFrame, book: DataFrame) -> DataFrame:
    """The messages, all of them or - if one cannot be sent - an error."""
    checked = resolve(messages, book)
    return checked.where(F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("publish "), F.coalesce("name", F.lit("null")), F.lit(": "), F.col("problem"))).cast("boolean"))).drop("problem")


def log_index(messages: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """messages with index: their place in their name's log, after the (name, last) already there. Names
    are few, so a name's messages are numbered in two levels."""
    placed = prefix_sum(messages, ["name"], ["seq"], F.lit(1), "index").withColumn("index", F.col("index").cast("long"))
    if after is None:
        return placed
    seen = F.broadcast(after.select(F.col("name").alias("_n"), "last")) if after.limit(BOOK + 1).count() <= BOOK else after.select(F.col("name").alias("_n"), "last")
    return placed.join(seen, F.col("name") == F.col("_n"), "left").withColumn("index", F.col("index") + F.coalesce("last", F.lit(0))).drop("_n", "last")


def batches(log: DataFrame, take: int = TAKE) -> DataFrame:
    """log with batch: which take of its name a message comes with, from 0."""
    return log.withColumn("batch", F.floor((F.col("index") - 1) / take).cast("long"))


def envelope(data_json: Column, name: Column, index: Column, attempts: Column) -> Column:
    """The request a page sees, as JSON text: the message's fields and msg; other values as {value}."""
    is_object = F.coalesce(data_json.rlike(r"^\s*\{"), F.lit(False))
    msg = F.to_json(F.struct(name.alias("name"), index.alias("index"), F.coalesce(attempts, F.lit(1)).alias("attempts")))
    inner = F.trim(F.regexp_replace(F.regexp_replace(data_json, r"^\s*\{", ""), r"\}\s*$", ""))
    plain = F.concat(F.lit('"value":'), F.coalesce(data_json, F.lit("null")))
    head = F.when(is_object, inner).otherwise(plain)
    return F.concat(F.lit("{"), F.when(head != "", F.concat(head, F.lit(","))).otherwise(""), F.lit('"msg":'), msg, F.lit("}"))


def pause_ms(attempt: Column, backoff: int = BACKOFF_MS, cap: int = CAP_MS) -> Column:
    """The pause after a failed attempt (from 1): doubling, capped."""
    return F.least(F.lit(backoff) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(40))), F.lit(cap)).cast("long")


def due_ms(attempt: Column, backoff: int = BACKOFF_MS, cap: int = CAP_MS) -> Column:
    """When an attempt (from 1) is due, after the first."""
    steps = F.when(attempt > 1, F.sequence(F.lit(1), attempt - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda t, a: t + pause_ms(a, backoff, cap))


def deliver(log: DataFrame, book: DataFrame, fails: Column, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """log with status after one delivery: done, failed (to be taken again) or dead.

    fails: whether a message's page throws. A message without exactly one page fails; on a `.dead`
    name it is done, for dead letters never return. A failure stops no other message; the last
    attempt's failure makes a message dead.
    """
    found = log.join(book.select(F.col("name").alias("_n"), "pages"), F.col("name") == F.col("_n"), "left").drop("_n")
    alone = F.coalesce(F.col("pages") == 1, F.lit(False))
    lost = ~alone | F.coalesce(fails, F.lit(False))
    dead_name = F.col("name").endswith(".dead")
    status = F.when(~alone & dead_name, "done").when(lost & (F.col("attempts") >= attempts), "dead").when(lost, "failed").otherwise("done")
    return found.withColumn("status", status).drop("pages")


def dead_letters(delivered: DataFrame, name: str | None = None, start: int = 1, top: int | None = None) -> DataFrame:
    """Dead messages as entries of `<name>.dead`, numbered anew, with where they came from; of one name
    (with or without `.dead`) from an index on, at most `top`, if asked."""
    dead = delivered.where("status = 'dead'")
    placed = prefix_sum(dead, ["name"], ["index"], F.lit(1), "_place")
    found = placed.select(F.concat("name", F.lit(".dead")).alias("name"), F.col("_place").cast("long").alias("index"), "data_json", F.col("name").alias("from_name"), F.col("index").alias("from_index"), "attempts")
    if name is not None:
        found = found.where(F.col("name") == name.removesuffix(".dead") + ".dead")
    found = found.where(F.col("index") >= start) if start > 1 else found
    return found if top is None else found.orderBy("name", "index").limit(top)


def requeue(dead: DataFrame, last: DataFrame) -> DataFrame:
    """Copies of dead letters at the end of the log they came from; the letters stay."""
    back = dead.select(F.col("from_name").alias("name"), "data_json", F.col("index").alias("seq"))
    return log_index(back, last).select("name", "index", "data_json", F.lit(1).alias("attempts"))


def onward(children: DataFrame, delivered: DataFrame) -> DataFrame:
    """Messages published by pages, of deliveries that are done: what a throwing page sent is lost with it."""
    done = delivered.where("status = 'done'").select(F.col("name").alias("_n"), F.col("index").alias("_i"))
    return children.join(done, (F.col("parent_name") == F.col("_n")) & (F.col("parent_index") == F.col("_i")), "left_semi")


def fresh(messages: DataFrame, sent: DataFrame) -> DataFrame:
    """Messages whose data differs from the last sent under their name; sent: (name, last_hash). Of
    messages of one name each is held against the one before it."""
    marked = beside(messages.withColumn("_h", F.xxhash64("data_json")), ["name"], ["seq"], F.col("_h"), "_b", -1)
    known = sent.select(F.col("name").alias("_n"), "last_hash")
    joined = marked.join(known, F.col("name") == F.col("_n"), "left")
    return joined.where(~F.col("_h").eqNullSafe(F.coalesce("_b", "last_hash"))).select(*messages.columns)


def lease(log: DataFrame, leases: DataFrame, now_ms: int, group: str, take: int = TAKE, lease_ms: int = LEASE_MS) -> DataFrame:
    """What a group's worker may claim now: of each name the first `take` messages that nobody of the
    group has settled or holds, as leases (name, index, group, until_ms, state 'held'). leases holds
    the group's earlier ones, state held or done; a lease that ran out is free again."""
    held = leases.where((F.col("group") == group) & ((F.col("state") == "done") | (F.col("until_ms") > now_ms)))
    taken = held.select(F.col("name").alias("_n"), F.col("index").alias("_i")).distinct()
    free = log.join(taken, (F.col("name") == F.col("_n")) & (F.col("index") == F.col("_i")), "left_anti")
    first = prefix_sum(free, ["name"], ["index"], F.lit(1), "_place").where(F.col("_place") <= take)
    return first.drop("_place").withColumns({"group": F.lit(group), "until_ms": F.lit(now_ms + lease_ms), "state": F.lit("held")})


def first_policies(requests: DataFrame) -> DataFrame:
    """(name, attempts, backoff_ms, cap_ms) of requests(name, seq, and those): what was asked first for
    a name holds for it, later requests change nothing; what was not asked is the default."""
    first = requests.groupBy("name").agg(F.min_by(F.struct("attempts", "backoff_ms", "cap_ms"), "seq").alias("p"))
    defaults = (("attempts", MAX_ATTEMPTS), ("backoff_ms", BACKOFF_MS), ("cap_ms", CAP_MS))
    return first.select("name", *[F.coalesce(F.col(f"p.{n}"), F.lit(d)).cast("int").alias(n) for n, d in defaults])


def parse_delivery(batch_json: Column) -> Column:
    """array of (index, value, headers, attempts) of a batch's JSON text: an entry's payload is its
    value, or [headers, value] where its type is 16; attempts default to 1."""
    entries = F.from_json(batch_json, "array<struct<index: bigint, type: int, payload: string, attempts: int>>")
    headed = lambda e: F.coalesce(e["type"] == 16, F.lit(False))
    part = lambda e, i: F.get_json_object(e["payload"], f"$[{i}]")
    return F.transform(entries, lambda e: F.struct(e["index"].alias("index"), F.when(headed(e), part(e, 1)).otherwise(e["payload"]).alias("value"), F.when(headed(e), part(e, 0)).alias("headers"), F.coalesce(e["attempts"], F.lit(1)).alias("attempts")))


def on_site(log: DataFrame, swaps: DataFrame) -> DataFrame:
    """log with site: the site (seq, site) that stood when a message's batch was taken; a batch ends on
    the site it began with. log has `batch` (`batches`); sites stand from their seq on."""
    began = log.groupBy("name", "batch").agg(F.min("seq").alias("_began"))
    stood = began.join(F.broadcast(swaps.select(F.col("seq").alias("_s"), "site")), F.col("_s") <= F.col("_began"), "left").groupBy("name", "batch").agg(F.max_by("site", "_s").alias("site"))
    return log.join(stood, ["name", "batch"], "left")


def deliver_until_done(log: DataFrame, book: DataFrame, fails: Callable[[DataFrame], Column], write: Callable[[DataFrame, int], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Delivers until nothing is failed, at most `rounds` times; `write` stores a round's rows and
    gives them back, so a round reads a table and not all rounds before it."""
    left, done = log, None
    for i in range(rounds):
        now = write(deliver(left, book, fails(left)), i)
        settled = now.where("status <> 'failed'")
        done = settled if done is None else done.unionByName(settled)
        left = now.where("status = 'failed'").withColumn("attempts", F.col("attempts") + 1).drop("status")
        if left.isEmpty():
            break
    return done


def _attempts(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Numbers a name's messages of a micro-batch in the order of seq and delivers each until it is done
    or dead. Two numbers a message are held: an ordered log is one task's work, cut by micro-batches."""
    (last,) = state.get if state.exists else (0,)
    parts = [(f["seq"].to_numpy(), f["fail_times"].to_numpy()) for f in frames]
    seq, fails = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(seq, kind="stable")
    state.update((int(last) + len(order),))
    for at in range(0, len(order), 10_000):
        rows = order[at : at + 10_000]
        tried = np.minimum(fails[rows] + 1, MAX_ATTEMPTS)
        status = np.where(fails[rows] >= MAX_ATTEMPTS, "dead", "done")
        yield pd.DataFrame({"name": key[0], "index": last + at + 1 + np.arange(len(rows)), "seq": seq[rows], "attempts": tried.astype("int32"), "status": status})


def drain(messages: DataFrame) -> DataFrame:
    """A stream of messages(name, seq, fail_times) as (name, index, seq, attempts, status). State is
    one number a name. fail_times says how often a message's page throws before it does not."""
    return messages.select("name", "seq", "fail_times").groupBy("name").applyInPandasWithState(_attempts, "name string, index long, seq long, attempts int, status string", "last long", "append", "NoTimeout")


def run_drain(messages: DataFrame, out: str, checkpoint: str) -> None:
    """Drains what a stream holds now into a Parquet table at `out`; called again, it goes on from there."""
    drain(messages).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def watch(spark, root: str, glob: str = "*"):
    """A directory's files as a stream of (path, size, mtime, content): new and changed ones as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def rebuild(files, build: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Calls build(changes, batch) for what has changed since the last call; changes that come while a
    build runs wait for the next one, together."""
    files.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
