"""A document set: an ordered table of documents, queried by filters over their data."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.ingest import parse_documents
from .filters import compile_filter

#: Fields with a column of their own; `_id` is a document's number in the set.
HOT = {"path": "string", "name": "string", "ext": "string", "size": "bigint", "tags": "array<string>"}


class DocSet:
    """docs: a documents table (sources.ingest). Every answer is in document order."""

    def __init__(self, docs: DataFrame, on_query: Callable[[dict | None], None] | None = None):
        self.docs, self.on_query, self.hot = docs, on_query, HOT

    @classmethod
    def from_texts(cls, spark: SparkSession, texts: Sequence[str | dict], **options) -> DocSet:
        """Documents of texts, or of {text, meta} mappings, concatenated to one set."""
        rows = []
        for i, t in enumerate(texts):
            t = {"text": t} if isinstance(t, str) else t
            meta = t.get("meta")
            if meta is not None and not isinstance(meta, dict):
                raise ValueError("meta must be a mapping")
            rows.append((i, t["text"], json.dumps(meta) if meta else None))
        sources = spark.createDataFrame(rows, "source_id long, text string, meta_json string")
        return cls(parse_documents(sources, ["source_id"]), **options)

    def where(self, query: dict | None) -> DataFrame:
        """The matching documents, without an order."""
        columns = {c: (F.col(c), kind) for c, kind in self.hot.items() if c in self.docs.columns} | {"_id": (F.col("doc_index"), "bigint")}
        return self.docs.where(compile_filter(query, F.parse_json("data_json"), columns))

    def indexed(self, folder: str, fields: dict[str, str], order: str = "path") -> DocSet:
        """The set as a table with a column for each of fields (name: type), written once, sorted by one
        of them: filters on those are plain predicates, which the scan skips files and row groups by."""
        made = self.docs.withColumns({f: self.field(f, kind) for f, kind in fields.items() if f not in self.docs.columns})
        made.repartitionByRange(order).sortWithinPartitions(order).write.parquet(folder)
        found = DocSet(self.docs.sparkSession.read.parquet(folder), self.on_query)
        found.hot = HOT | fields
        return found

    def find(self, query: dict | None = None) -> DataFrame:
        """All matches in document order: doc_index, data_json and the documents' other columns."""
        if self.on_query:
            self.on_query(query)
        return self.where(query).orderBy("doc_index")

    def find_one(self, query: dict | None = None) -> DataFrame:
        """The first match in document order, or no row."""
        return self.find(query).limit(1)

    def with_tag(self, tag: str) -> DataFrame:
        return self.find({"tags": tag.lower()})

    def data(self, index: int) -> DataFrame:
        """The record of the document with this number, or no row."""
        return self.docs.where(F.col("doc_index") == index)

    def count(self) -> int:
        return self.docs.count()

    def field(self, name: str, kind: str = "string") -> Column:
        """A field of the record as a column; a value of another type is null."""
        return F.try_variant_get(F.parse_json("data_json"), f"$.{name}", kind)

    def union(self, *others: DocSet) -> DocSet:
        """One set after another, numbered anew."""
        parts = [s.docs.withColumn("_set", F.lit(i)) for i, s in enumerate((self, *others))]
        sizes = reduce(DataFrame.union, [p.groupBy("_set").agg((F.max("doc_index") + 1).alias("n")) for p in parts])
        first = sizes.select(F.col("_set").alias("_s"), F.coalesce(F.sum("n").over(W.orderBy("_set").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
        whole = reduce(DataFrame.unionByName, parts)
        return DocSet(whole.join(F.broadcast(first), F.col("_set") == F.col("_s")).withColumn("doc_index", F.col("doc_index") + F.col("first")).drop("_set", "_s", "first"), self.on_query)
