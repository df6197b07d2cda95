"""Token counts: an exact length histogram.

Documents are counted by encoded length (partial counts before the shuffle); what is left has one
row per distinct length. Suffix sums over it answer, for every context limit at which an answer
changes, totals, ranks and truncated totals. The sums run in blocks of lengths, so no task holds
the histogram whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize
from .bpe import token_lengths

#: Lengths in one block of the suffix sums.
BLOCK = 4096


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, documents); null and empty texts have length 0; an empty table has no rows."""
    return token_lengths(docs, tokenizer, text_col).groupBy("n_tokens").agg(F.count("*").alias("documents"))


def context_limits(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each n_tokens of the histogram, taken as the context limit L: documents (of that length),
    documents_at_least, tokens_at_least (both over lengths >= L), documents_total, tokens_total,
    truncated_total (tokens left when each document is cut at L), share_whole (documents that fit,
    in parts of 1) - the rank of L, from which any quantile is read (`quantile`)."""
    h = materialize(histogram.withColumns({"b": F.floor(F.col("n_tokens") / block), "tokens": F.col("n_tokens") * F.col("documents")}), "lengths")
    blocks = h.groupBy("b").agg(F.sum("documents").alias("bd"), F.sum("tokens").alias("bt"))
    later, inside = W.orderBy(F.desc("b")), W.partitionBy("b").orderBy(F.desc("n_tokens"))
    blocks = blocks.select("b", (F.sum("bd").over(later) - F.col("bd")).alias("ld"), (F.sum("bt").over(later) - F.col("bt")).alias("lt"))
    totals = h.agg(F.sum("documents").alias("documents_total"), F.sum("tokens").alias("tokens_total"))
    out = h.withColumns({"sd": F.sum("documents").over(inside), "st": F.sum("tokens").over(inside)}).join(blocks, "b").crossJoin(F.broadcast(totals))
    at_least, tokens = F.col("sd") + F.col("ld"), F.col("st") + F.col("lt")
    below = F.col("tokens_total") - tokens
    return out.select("n_tokens", "documents", at_least.alias("documents_at_least"), tokens.alias("tokens_at_least"), "documents_total", "tokens_total", (below + F.col("n_tokens") * at_least).alias("truncated_total"), ((F.col("documents_total") - at_least + F.col("documents")) / F.col("documents_total")).alias("share_whole"))


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share q of documents does not exceed (one row; none over no documents)."""
    return limits.where(F.col("share_whole") >= q).agg(F.min("n_tokens").alias("n_tokens")).where("n_tokens is not null")


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut at `limit` tokens, which need not be a length that occurs."""
    above = limits.where(F.col("n_tokens") > limit).agg(F.coalesce(F.max("documents_at_least"), F.lit(0)).alias("d"), F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("t"))
    total = limits.agg(F.coalesce(F.max("tokens_total"), F.lit(0)).alias("all"))
    return above.crossJoin(total).select((F.col("all") - F.col("t") + F.col("d") * limit).alias("tokens"))
