"""From source texts to the documents table.

Splitting, front matter and hashtags are column expressions. YAML alone needs Python: it runs in one
Arrow-batched stage over the few rows that have any, told apart beforehand by a pattern.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import body_tags, message_name
from . import yaml12

#: A front-matter fence on the first line that is not blank, its YAML, its closing fence and the rest.
MATTER = r"^\s*?(?:^|(?<=\n))[ \t]*\+\+\+[ \t]*\n(?:([\s\S]*?)\n)??\+\+\+[ \t]*(?:\n([\s\S]*))?$"
#: A line that may open a data fence: the cheap test before a parse.
MAYBE_DATA = r"(?m)^ {0,3}(?:`{3,}|~{3,})[ \t]*data[ \t]*$"


def chunks_of(text: Column) -> Column:
    """The chunks of a source: cut at bare `---` lines, blank ones left out; one empty chunk if none is left."""
    # the separator takes the line end before it and the one after it along
    cut = F.split(F.coalesce(text, F.lit("")), r"(?:(?<=\n)|^)---[ \t]*(?:\n|$)|\n---[ \t]*(?:\n|$)")
    chunks = F.filter(cut, lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")) != "")
    return F.when(F.size(chunks) == 0, F.array(F.lit(""))).otherwise(F.transform(chunks, lambda c: F.regexp_replace(c, r"\n$", "")))


def split_documents(sources: DataFrame, text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """keys, chunk_no, chunk: each source cut at bare `---` lines, blank chunks left out; a source with
    nothing left is one empty document. Lines' own ends are kept, those at a cut are not."""
    keys = [c for c in sources.columns if c != text_col] if keys is None else keys
    return sources.select(*keys, F.posexplode(chunks_of(F.col(text_col))).alias("chunk_no", "chunk"))


def front_matter(chunk: Column) -> Column:
    """(matter, body): the YAML between two `+++` lines that begin a chunk, null without a pair, and the rest."""
    fenced = chunk.rlike(MATTER)
    return F.struct(F.when(fenced, F.regexp_extract(chunk, MATTER, 1)).alias("matter"), F.when(fenced, F.regexp_extract(chunk, MATTER, 2)).otherwise(chunk).alias("body"))


FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*(.*?)[ \t]*$")


def take_data_fences(body: str) -> tuple[str, list[dict]]:
    """The body without its `data` fences, and their mappings in order. A fence ends at a line of at
    least as many of its marks, or with the body; other fences hide what is in them."""
    kept, data, held, inside = [], [], [], None
    for line in body.split("\n"):
        found = FENCE.match(line)
        if inside is None:
            if found and not (found[1][0] == "`" and "`" in found[2]):
                inside = (found[1][0], len(found[1]), found[2] == "data")
                if inside[2]:
                    held = []
                    continue
            kept.append(line)
        elif found and found[1][0] == inside[0] and len(found[1]) >= inside[1] and not found[2]:
            if inside[2]:
                data.append(yaml12.mapping("\n".join(held), "a data block"))
            else:
                kept.append(line)
            inside = None
        elif inside[2]:
            held.append(line)
        else:
            kept.append(line)
    if inside and inside[2]:
        data.append(yaml12.mapping("\n".join(held), "a data block"))
    return "\n".join(kept), data


def declared_tags(value) -> list[str]:
    if value is None:
        return []
    if isinstance(value, str):
        value = [value]
    if not isinstance(value, list) or not all(isinstance(v, (str, int, float)) for v in value):
        raise ValueError("tags must be a list or a string")
    return [str(v).lstrip("#").lower() for v in value]


def merge(matter: dict, fences: list[dict], inline: list[str], meta: dict) -> dict:
    """Front matter, then fences in order, then tags (declared before inline), then the source's meta; later wins."""
    data = dict(matter)
    for f in fences:
        data |= f
    data.pop("_id", None)
    declared = declared_tags(data.get("tags"))
    if declared or inline or "tags" in data:
        data["tags"] = list(dict.fromkeys([*declared, *inline]))
    return data | meta


def _with_yaml(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, matter, body, tags, meta = (batch.column(i).to_pylist() for i in range(5))
        out = []
        for i, m, b, t, x in zip(doc, matter, body, tags, meta):
            try:
                content, fences = take_data_fences(b) if re.search(MAYBE_DATA, b) else (b, [])
                data = merge(yaml12.mapping(m, "front matter") if m else {}, fences, t, json.loads(x) if x else {})
            except Exception as e:
                raise ValueError(f"document {i}: {e}") from e
            out.append((json.dumps(data, ensure_ascii=False), content))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["k", "data_json", "content"])


#: Sources in one range on average, ranges at most, and keys of the sample that they are cut by.
RANGE, RANGES, SAMPLE = 100_000, 4096, 40_000


def range_of(rows: DataFrame, key: str) -> Column | None:
    """The number of the range that a row's key falls into, nulls first; None if one range holds all. Bounds are quantiles of the
    SAMPLE keys with the smallest hashes, whatever their type: at most RANGES numbers or texts."""
    count = rows.count()
    ranges = min(RANGES, count // RANGE + 1)
    if ranges < 2:
        return None
    sample = rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key)).limit(SAMPLE)
    values = [r[0] for r in sample.orderBy(key).collect()]
    bounds = sorted({values[len(values) * i // ranges] for i in range(1, ranges)}) if values else []
    if not bounds:
        return None
    known, steps = F.array(*[F.lit(b) for b in bounds]).cast(f"array<{dict(rows.dtypes)[key]}>"), len(bounds).bit_length()

    def narrow(lo: Column, k: Column) -> Column:
        mid = lo + F.call_function("shiftright", F.lit(1 << steps), k)
        return F.when((mid <= len(bounds)) & (F.get(known, mid - 1) <= F.col(key)), mid).otherwise(lo)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), narrow)


def parse_documents(sources: DataFrame, order_by: list[str], set_id: str = "") -> DataFrame:
    """The documents table of sources(text, meta_json [JSON mapping or null], and the order columns).

    doc_index numbers documents by the order columns and their place in the source, from 0; sources
    that are equal in those are told apart by their text and meta, and equal rows are numbered each.
    It is a prefix sum in two levels - inside ranges of the first order column, cut by quantiles, then
    over the ranges' totals - so no task sees all sources unless they share one key. A document that
    cannot be read fails the query, named by its number.
    """
    src = F.col("source_id").cast("long") if "source_id" in sources.columns else F.xxhash64(*order_by)
    rows = sources.select(src.alias("_src"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)], "text", "meta_json")
    order = [f"_o{i}" for i in range(len(order_by))]
    place = range_of(rows, "_o0")
    rows = rows.withColumns({"_chunks": chunks_of(F.col("text")), "_range": F.lit(0) if place is None else place}).withColumn("_size", F.size("_chunks"))
    before = (W.unboundedPreceding, -1)
    totals = rows.groupBy("_range").agg(F.sum("_size").alias("total"))  # one row a range
    totals = totals.select(F.col("_range").alias("_r"), F.coalesce(F.sum("total").over(W.orderBy("_range").rowsBetween(*before)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_size").over(W.partitionBy("_range").orderBy(*order, F.xxhash64("text", "meta_json")).rowsBetween(*before)), F.lit(0))
    placed = rows.withColumn("_inside", inside).drop("text").join(F.broadcast(totals), F.col("_range") == F.col("_r"))
    chunks = placed.select("_src", "meta_json", (F.col("_base") + F.col("_inside")).alias("_first"), F.posexplode("_chunks").alias("chunk_no", "chunk"))
    return with_data(chunks.select((F.col("_first") + F.col("chunk_no")).alias("doc_index"), F.col("_src").alias("source_id"), "chunk_no", "chunk", "meta_json"), set_id)


def with_data(chunks: DataFrame, set_id: str = "") -> DataFrame:
    """chunks(doc_index, source_id, chunk_no, chunk, meta_json) as documents. Rows without YAML and
    meta never leave the JVM."""
    cut = chunks.withColumn("fm", front_matter(F.col("chunk"))).withColumn("tags0", body_tags(F.col("fm.body")))
    needs = F.coalesce(F.trim("fm.matter") != "", F.lit(False)) | F.col("fm.body").rlike(MAYBE_DATA) | F.col("meta_json").isNotNull()
    schema = "k struct<doc_index:long,source_id:long,chunk_no:int>, data_json string, content string"
    key = F.struct("doc_index", "source_id", "chunk_no").alias("k")
    read = cut.where(needs).select(key, "fm.matter", "fm.body", "tags0", "meta_json")
    numbered = read.select(F.col("k.doc_index").alias("n"), "matter", "body", "tags0", "meta_json", "k")
    parsed = numbered.mapInArrow(_numbered, schema)
    plain = cut.where(~needs).select(key, F.when(F.size("tags0") > 0, F.to_json(F.struct(F.col("tags0").alias("tags")))).otherwise("{}").alias("data_json"), F.col("fm.body").alias("content"))
    docs = parsed.unionByName(plain)
    field = lambda name: F.get_json_object("data_json", f"$.{name}")
    path = field("path")
    return docs.select(
        "k.doc_index", F.lit(set_id).alias("set_id"), "k.source_id", "k.chunk_no",
        F.when(F.coalesce(field("ext"), F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(".md"), "md").otherwise("mdy").alias("format"),
        path.alias("path"), field("name").alias("name"), field("ext").alias("ext"), field("size").cast("long").alias("size"), field("mtime").cast("timestamp").alias("mtime"),
        F.coalesce(F.from_json(field("tags"), "array<string>"), F.array().cast("array<string>")).alias("tags"),
        "data_json", "content", message_name(field("messageName"), path).alias("message_name"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for out in _with_yaml(iter([batch.select([0, 1, 2, 3, 4])])):
            yield pa.RecordBatch.from_arrays([batch.column(5), out.column(1), out.column(2)], ["k", "data_json", "content"])
