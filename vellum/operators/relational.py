"""What documents do with the rows a query gave them - joins, groups, neighbours, pages - as plans.

Orders are total (ties fall back to a key given by the caller), so results do not depend on how rows
were partitioned. What runs along an order does so in two levels, inside ranges of it and then over
the ranges, so a key that holds most rows is no single task's work.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.ingest import range_of


def _ranged(df: DataFrame, order: str) -> DataFrame | None:
    """df with the range of its order column, or None where one range holds all."""
    place = range_of(df, order)
    return None if place is None else df.withColumn("_range", place)


def _beside(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df left-joined to other (keys, _range and more), nulls equal."""
    named = other.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[c for c in other.columns if c not in (*keys, "_range")])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_range") == F.col("_r"))
    return df.join(named, match, "left").drop("_r", *[f"_k_{k}" for k in keys])


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, own: bool = True) -> DataFrame:
    """df with the sum of value over the rows before each in its key, and its own if asked."""
    frame = (W.unboundedPreceding, 0 if own else -1)
    ranged = _ranged(df, order[0])
    if ranged is None:
        return df.withColumn(name, F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)), F.lit(0)))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = _beside(ranged, sums.select(*keys, "_range", before.alias("_before")), keys)
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*frame)), F.lit(0))
    return placed.withColumn(name, F.col("_before") + inside).drop("_range", "_before")


def beside(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, step: int) -> DataFrame:
    """df with the value of the row before (step -1) or after (1) in the key, null at its end."""
    ranged = _ranged(df, order[0])
    near = F.lag if step < 0 else F.lead
    if ranged is None:
        return df.withColumn(name, near(value).over(W.partitionBy(*keys).orderBy(*order)))
    key = F.struct(*order)
    edge = F.max_by(F.struct(value.alias("v")), key) if step < 0 else F.min_by(F.struct(value.alias("v")), key)
    ends = ranged.groupBy(*keys, "_range").agg(edge.alias("_edge"))
    ends = ends.select(*keys, "_range", near("_edge").over(W.partitionBy(*keys).orderBy("_range")).alias("_far"))
    inside = near(F.struct(value.alias("v"))).over(W.partitionBy(*keys, "_range").orderBy(*order))
    return _beside(ranged, ends, keys).withColumn(name, F.coalesce(inside, F.col("_far"))["v"]).drop("_range", "_far")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key, by one grouped minimum."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def lookup_first(left: DataFrame, right: DataFrame, key: str, order: Sequence[str | Column], how: str = "left") -> DataFrame:
    """Each left row with the first right row of its key."""
    return left.join(first_per(right, [key], order), key, how)


def tag_classes(df: DataFrame, key: str, tags: str) -> DataFrame:
    """(key, class, tags): documents with the same tags are a class, named by its smallest key."""
    each = df.select(F.col(key), F.array_sort(F.array_distinct(tags)).alias("tags"))
    named = each.groupBy("tags").agg(F.min(key).alias("class"))
    return each.join(named, "tags").select(key, "class", "tags")


def related_classes(df: DataFrame, key: str, tags: str) -> DataFrame:
    """(class, other, shared, members): classes that share tags, how many, and how many documents the
    other has; the class itself with all its tags. Documents meet as classes, so a tag that most of them
    have gives the pairs of its classes, not of its documents."""
    classes = tag_classes(df, key, tags).groupBy("class").agg(F.any_value("tags").alias("tags"), F.count("*").alias("members"))
    each = classes.select("class", F.explode("tags").alias("tag"), "members")
    other = each.select(F.col("class").alias("other"), "tag", "members")
    return each.drop("members").join(other, "tag").groupBy("class", "other").agg(F.count("*").alias("shared"), F.any_value("members").alias("members"))


def related(df: DataFrame, key: str, tags: str) -> DataFrame:
    """(key, class, links): of each document its class and how many other documents share a tag with
    it; which those are is told by `related_classes` and the classes' members."""
    links = related_classes(df, key, tags).groupBy("class").agg((F.sum("members") - 1).alias("links"))
    return tag_classes(df, key, tags).join(links, "class", "left").select(key, "class", F.coalesce("links", F.lit(0)).alias("links"))


def tag_index(df: DataFrame, tags: str) -> DataFrame:
    """(tag, n): documents per tag."""
    return df.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy("tag")


def list_per(df: DataFrame, keys: Sequence[str], item: str, order: Sequence[str], sep: str = ",") -> DataFrame:
    """(keys, items): a group's items joined in order. A group has to fit in one text, as it does in a page."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(item).cast("string").alias("_item"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x["_item"]), sep).alias("items"))


def neighbours(df: DataFrame, section: str, order: Sequence[str], item: str) -> DataFrame:
    """df with prev and next: the item before and after in its section."""
    return beside(beside(df, [section], order, F.col(item), "prev", -1), [section], order, F.col(item), "next", 1)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "running") -> DataFrame:
    return prefix_sum(df, keys, order, F.col(value), name)


def paginate(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """df with page and pages, both from 1, within each key."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_all")).withColumn("_range", F.lit(0))
    placed = prefix_sum(df, keys, order, F.lit(1), "_place")
    whole = _beside(placed.withColumn("_range", F.lit(0)), sizes, keys)
    return whole.withColumns({"page": F.ceil(F.col("_place") / size).cast("int"), "pages": F.ceil(F.col("_all") / size).cast("int")}).drop("_place", "_all", "_range")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with position, from 0."""
    return prefix_sum(df, keys, order, F.lit(1), "position", False).withColumn("position", F.col("position").cast("int"))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the largest order of each key."""
    return first_per(df, [key], [-F.col(order)])


def overlay(layers: Sequence[DataFrame], key: str) -> DataFrame:
    """Layers of one schema, later ones over earlier ones."""
    whole = None
    for i, layer in enumerate(layers):
        part = layer.withColumn("_layer", F.lit(i))
        whole = part if whole is None else whole.unionByName(part)
    return last_wins(whole, key, "_layer").drop("_layer")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, version: str) -> DataFrame:
    """(key, change): create, modify or delete, for what two inventories differ in."""
    b, a = before.select(F.col(key).alias("bk"), F.col(version).alias("bv")), after.select(F.col(key).alias("ak"), F.col(version).alias("av"))
    change = F.when(F.col("bk").isNull(), "create").when(F.col("ak").isNull(), "delete").when(~F.col("bv").eqNullSafe(F.col("av")), "modify")
    return b.join(a, F.col("bk") == F.col("ak"), "full_outer").select(F.coalesce("ak", "bk").alias(key), change.alias("change")).where("change is not null")


#: A slug that another, its parent, makes when it is numbered.
_NUMBERED = r"(?s)^(.+)-([1-9][0-9]{0,17})$"


def _given_away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, family, parent, n, rank), a family's together, parents before their children, by rank: the first use of
    the slug parent-n comes after `rank` uses of its parent. Out come (doc, slug, rank): from this use of the slug on its
    number is one more, for the name was taken. Holds the names of a family that were taken before their own first use."""
    place = parent = None
    taken, claimed, ahead, found = set(), [], 0, []

    def advance(uses: float) -> None:
        nonlocal ahead
        while claimed and claimed[0] - ahead < uses:
            found.append((place[0], parent, heapq.heappop(claimed) - ahead))
            ahead += 1

    for batch in batches:
        for doc, family, slug, n, rank in zip(*(c.to_pylist() for c in batch.columns)):
            if (doc, family) != place or slug != parent:
                advance(math.inf)
                if (doc, family) != place:
                    place, taken = (doc, family), set()
                parent, ahead = slug, int(slug in taken)
            advance(rank)
            if n < rank + ahead:
                taken.add(f"{slug}-{n}")
                found.append((doc, f"{slug}-{n}", 0))
            else:
                heapq.heappush(claimed, n)
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((batch.schema.field(0).type, pa.string(), pa.int64()))], ["doc", "slug", "rank"])
        found = []
    advance(math.inf)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((batch.schema.field(0).type, pa.string(), pa.int64()))], ["doc", "slug", "rank"])


def heading_ids(headings: DataFrame, doc: str, pos: str, slug: str) -> DataFrame:
    """headings with id: the slug, numbered from the second use on, past ids already taken; null for
    an empty slug. Only a slug and the same with a number behind it can want one id, so uses are
    counted per slug by prefix sums, and just the first uses of slugs such as a-1 in documents that
    have an a are read in order."""
    named = headings.withColumn("_mine", F.col(slug))
    firsts = headings.where(F.col(slug).rlike(_NUMBERED)).groupBy(doc, slug).agg(F.min(pos).alias("_first"))
    part = lambda i: F.regexp_extract(slug, _NUMBERED, i)
    firsts = firsts.select(F.col(doc).alias(doc), F.col("_first").alias(pos), part(1).alias("_parent"), part(2).cast("long").alias("_n"), F.col(slug).alias("_mine"))
    known = headings.select(F.col(doc).alias("_d"), F.col(slug).alias("_s")).distinct()
    firsts = firsts.join(known, firsts[doc].eqNullSafe(F.col("_d")) & (F.col("_parent") == F.col("_s")), "left_semi").withColumnRenamed("_parent", slug)
    clash = not firsts.isEmpty()
    if clash:
        named = named.unionByName(firsts, allowMissingColumns=True)
        ranked = prefix_sum(named, [doc, slug], [pos, "_mine"], F.when(F.col("_n").isNull(), 1).otherwise(0), "_rank", False)
        family = F.regexp_extract(slug, r"(?s)^(.+?)(-[1-9][0-9]{0,17})*$", 1)
        asked = ranked.where("_n is not null").select(F.col(doc).alias("doc"), family.alias("family"), F.col(slug).alias("parent"), F.col("_n").alias("n"), F.col("_rank").cast("long").alias("rank"))
        asked = asked.repartition("doc", "family").sortWithinPartitions("doc", "family", F.length("parent"), "parent", "rank")
        steps = asked.mapInArrow(_given_away, f"doc {dict(headings.dtypes)[doc]}, slug string, rank long")
        steps = steps.select(F.col("doc").alias(doc), F.col("slug").alias(slug), F.col("rank").alias("_rank"), F.lit(1).alias("_step"))
        uses = ranked.where("_n is null").drop("_n").withColumns({"_rank": F.col("_rank").cast("long"), "_step": F.lit(0)})
        both = uses.withColumn("_use", F.lit(1)).unionByName(steps.withColumn("_use", F.lit(0)), allowMissingColumns=True)
        numbered = prefix_sum(both, [doc, slug], ["_rank", "_use"], F.col("_step"), "_skipped").where("_use = 1")
        number = F.col("_rank") + F.col("_skipped")
    else:
        numbered, number = prefix_sum(named, [doc, slug], [pos], F.lit(1), "_rank", False), F.col("_rank")
    name = F.when(number == 0, F.col(slug)).otherwise(F.concat(slug, F.lit("-"), number.cast("string")))
    return numbered.select(*[F.col(c) for c in headings.columns], F.when(F.col(slug) != "", name).alias("id"))


def search(index: DataFrame, query: str, words: str = "words", title: str = "title", key: str = "url", top: int = 8) -> DataFrame:
    """The `top` rows by shared words, one more for a title that holds the query; only scores over 0."""
    from ..functions.text import tokenize

    asked = tokenize(F.lit(query))
    score = F.size(F.array_intersect(words, asked)) + F.contains(F.lower(title), F.lit(query.lower().strip())).cast("int")
    return index.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), key).limit(top)


def search_texts(docs: DataFrame, query: str, text: str = "text", title: str = "title", key: str = "url", top: int = 8) -> DataFrame:
    """`search` over texts that have no index: asked words are looked for where no letter or digit is
    beside them, which is when they are words of an index."""
    from ..functions.text import tokenize

    asked = docs.sparkSession.range(1).select(tokenize(F.lit(query))).first()[0]
    low = F.lower(text)
    found = [low.rlike(f"(?<![a-z0-9]){w}(?![a-z0-9])").cast("int") for w in asked]
    score = reduce(lambda a, b: a + b, found, F.contains(F.lower(title), F.lit(query.lower().strip())).cast("int"))
    return docs.withColumn("score", F.coalesce(score, F.lit(0))).where("score > 0").orderBy(F.desc("score"), key).limit(top)


def inverted_index(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(word, key): a row for each word of each document, to be written sorted by word."""
    from ..functions.text import tokenize

    return docs.select(F.explode(tokenize(F.col(text))).alias("word"), F.col(key))


def search_postings(postings: DataFrame, query: str, key: str, top: int = 8) -> DataFrame:
    """(key, score): the `top` documents by shared words; only the asked words' rows are read."""
    from ..functions.text import tokenize

    asked = postings.sparkSession.range(1).select(tokenize(F.lit(query))).first()[0]
    hits = postings.where(F.col("word").isin(asked)).groupBy(key).agg(F.count("*").cast("int").alias("score"))
    return hits.orderBy(F.desc("score"), key).limit(top)
