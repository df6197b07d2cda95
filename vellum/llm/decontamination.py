"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose values were exchanged keeps
its template. Windows of a document's template are hash-joined with the windows of the benchmark's;
an item counts as found when enough of its windows occur, and, where its template has placeholders,
when its values map to the document's values consistently. Templates are made only of texts that hold
an item's anchor word: so many windows have one that no text without one can hold enough of them. All
of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_IDS, let, materialize, with_found, without_ids

#: Words in a window, and the share of an item's windows that a document must hold.
WINDOW, COVERAGE = 5, 0.8
#: Words of a window that must be no placeholders; emptier windows match everywhere and say nothing.
LITERALS = 2
#: Share of placeholder occurrences that must agree with one value for value mapping.
CONSISTENCY = 0.8
#: Words by which positions may shift inside one alignment of an item with a document.
SHIFT = 2
#: Benchmark windows that may be broadcast; beyond it the join is by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Anchor words that may be part of a plan; with more, every text is read in full.
ANCHORS = 100_000
NUMBER, NAME, UNIT = "\u0002n", "\u0002p", "\u0002u"

#: Words that are units when a number comes before them.
UNITS = """mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces pound pounds ton tons
ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
kmh mph percent pct dollar dollars cent cents euro euros usd eur gbp degree degrees celsius fahrenheit k c f w kw kwh v volt volts hz khz mhz ghz b kb mb gb tb""".split()


#: Fixed value: a run of sentence ends, a word with inner apostrophes, or a number with inner marks.
SYMBOLS = r"[.!?:\n]+|\p{L}[\p{L}\p{M}]*+(?:['’]\p{L}[\p{L}\p{M}]*+)*+|\p{N}++(?:[.,:/]\p{N}++)*+"


def _typed(text: Column, number: Callable, name: Callable, unit: Callable, first: Callable, word: Callable) -> Column:
    """The text's words in order, each given by the function of its kind."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SYMBOLS), F.lit(0))
    units = F.array(*[F.lit(u) for u in sorted(set(UNITS))])

    def all_of(symbols: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            low, before = F.lower(w), F.get(symbols, i - 1)
            counted = (F.length(w) <= 10) & F.coalesce(before.rlike(r"^\p{N}"), F.lit(False)) & F.array_contains(units, low)
            capital = (w != low) & (F.length(w) > 1) & w.rlike(r"^\p{Lu}\P{Lu}*$")
            named = capital & ~F.coalesce(before.rlike(r"^[.!?:\n]"), F.lit(True))
            return F.when(w.rlike(r"^[.!?:\n]"), F.lit(None)).when(w.rlike(r"^\p{N}"), number(w)).when(counted, unit(low)).when(named, name(low)).when(capital, first(low)).otherwise(word(low))

        return F.filter(F.transform(symbols, one), lambda x: x.isNotNull())

    return let(found, all_of)


def canonical(text: Column) -> Column:
    """array of (word, slot, alt): template words, and for placeholders the value that stood there.

    A capitalised word that begins no sentence is a name. One that begins a sentence may be either:
    its word is the plain word and its alt a name; all other words have themselves as alt. Words in
    capitals are plain words.
    """

    def entry(word: Column, slot: Column, alt: Column) -> Column:
        return F.struct(word.alias("word"), slot.alias("slot"), alt.alias("alt"))

    def placeholder(kind: str) -> Callable:
        return lambda w: entry(F.lit(kind), w, F.lit(kind))

    none = F.lit(None).cast("string")
    return _typed(text, placeholder(NUMBER), placeholder(NAME), placeholder(UNIT), lambda w: entry(w, none, F.lit(NAME)), lambda w: entry(w, none, w))


def template(text: Column) -> Column:
    """array of (word, alt): the template words alone, under both readings."""

    def entry(word: Column, alt: Column) -> Column:
        return F.struct(word.alias("word"), alt.alias("alt"))

    def placeholder(kind: str) -> Callable:
        return lambda w: entry(F.lit(kind), F.lit(kind))

    return _typed(text, placeholder(NUMBER), placeholder(NAME), placeholder(UNIT), lambda w: entry(w, F.lit(NAME)), lambda w: entry(w, w))


def window_hashes(text: Column, window: int) -> Column:
    """array of the distinct hashes of a text's windows under both readings."""
    return let(template(text), lambda t: F.array_distinct(F.concat(hashed_windows(t["word"], window), hashed_windows(t["alt"], window))))


def hashed_windows(words: Column, window: int = WINDOW) -> Column:
    """array of 64-bit hashes of the windows, in order; fewer words than a window: none."""

    def all_of(words: Column) -> Column:
        starts = F.when(F.size(words) >= window, F.sequence(F.lit(1), F.size(words) - window + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))

    return let(words, all_of)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, at, h, total, slotted, words): each item's windows under each reading that leaves at
    least LITERALS plain words. total counts the windows that have such a reading. Items with a null
    id, or without such a window, cannot be found."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), canonical(F.col(text_col).cast("string")).alias("c")).where("item_id is not null")
    hashes = F.arrays_zip(hashed_windows(F.col("c")["word"], window).alias("h"), hashed_windows(F.col("c")["alt"], window).alias("alt"))
    spread = items.select("item_id", "c", F.posexplode(hashes).alias("at", "z"))
    spread = spread.select("item_id", "at", "z", F.slice("c", F.col("at") + 1, window).alias("words"))
    plain = F.size(F.filter("words", lambda x: x["slot"].isNull()))
    sure = F.size(F.filter("words", lambda x: x["slot"].isNull() & (x["alt"] == x["word"])))
    least = min(LITERALS, window)
    readings = F.array_distinct(F.concat(F.when(plain >= least, F.array("z.h")).otherwise(F.array().cast("array<long>")), F.when(sure >= least, F.array("z.alt")).otherwise(F.array().cast("array<long>"))))
    rows = spread.select("item_id", "at", "words", (sure < window).alias("slotted"), F.explode(readings).alias("h"))
    total = rows.groupBy("item_id").agg(F.count_distinct("at").alias("total"))
    return rows.join(total, "item_id")


def anchors(marks: DataFrame, coverage: float) -> list[str] | None:
    """Words such that a text with none of them cannot hold `coverage` of any item's windows: of each
    item its longest plain words, until more windows have one than may be missing. None if an item has
    too few such words, or if there are more than ANCHORS."""
    plain = F.filter("words", lambda x: x["slot"].isNull() & (x["alt"] == x["word"]) & x["word"].rlike(r"^\p{L}+$") & ~x["word"].rlike("[σς]"))
    rank = F.struct((-F.length("w")).alias("n"), F.col("w"))
    each = marks.select("item_id", "at", "total", F.explode_outer(F.transform(plain, lambda x: x["word"])).alias("w")).distinct()
    best = each.groupBy("item_id", "at").agg(F.min(F.when(F.col("w").isNotNull(), rank)).alias("r"), F.max("total").alias("total"))
    spare = F.floor(F.max("total") * (1 - coverage) + 1e-9).cast("int")
    need = best.groupBy("item_id").agg(F.get(F.array_sort(F.collect_list("r")), spare).alias("most"))
    need = materialize(need, "anchors")
    if not need.where("most is null").isEmpty():
        return None
    found = each.where("w is not null").join(need, "item_id").where(rank <= F.col("most")).select("w").distinct()
    words = [r["w"] for r in found.limit(ANCHORS + 1).collect()]
    return words if len(words) <= ANCHORS else None


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage): the items found in each document.

    Null texts and texts of fewer words than a window hold nothing; rows with a null id are not
    reported; rows that repeat an id are judged together; an empty side gives an empty result.
    """
    marks = materialize(benchmark_windows(benchmark, window, item_col, item_text_col), "windows")
    places = marks.select("h", "item_id", "at", "total")
    places = F.broadcast(places) if marks.count() <= BROADCAST_WINDOWS else places
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    words = anchors(marks, coverage)
    if words is not None:
        # a plain word of a template is a whole run of letters of the text in lower case
        able = texts.where(F.exists(F.split(F.lower("text"), r"\P{L}+"), lambda w: w.isin(words))) if words else texts.limit(0)
    else:
        able = texts
    rows = able.select("doc_id", F.explode(window_hashes(F.col("text"), window)).alias("h"))
    found = rows.join(places, "h").groupBy("doc_id", "item_id").agg((F.count_distinct("at") / F.max("total")).alias("coverage"))
    found = materialize(found.where(F.col("coverage") >= coverage), "found")
    if marks.where("slotted").isEmpty():
        return found
    return found.join(_inconsistent(texts, found, marks, window, coverage), ["doc_id", "item_id"], "left_anti")


def _inconsistent(texts: DataFrame, found: DataFrame, marks: DataFrame, window: int, coverage: float) -> DataFrame:
    """(doc_id, item_id) of found pairs whose placeholder values contradict one another: for each of
    an item's values, the document's most frequent counterpart is the mapping; too few agree with it.

    Pairs are judged over all places where windows meet, and again over each alignment (document
    position less item position, give or take SHIFT) that holds enough of the item by itself: one
    consistent place is enough, whatever else the text repeats. An item whose windows stand in the
    document with their own values is never rejected."""
    pairs = found.join(marks.where("slotted").select("item_id").distinct(), "item_id").select("doc_id", "item_id")
    ids = pairs.select("doc_id").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    held = texts.join(F.broadcast(ids) if few else ids, "doc_id").select("doc_id", F.xxhash64("text").alias("part"), canonical(F.col("text")).alias("c"))
    hashes = F.arrays_zip(hashed_windows(F.col("c")["word"], window).alias("h"), hashed_windows(F.col("c")["alt"], window).alias("alt"))
    held = held.select("doc_id", "part", "c", F.posexplode(hashes).alias("pos", "z"))
    held = held.select("doc_id", "part", "pos", F.explode(F.array_distinct(F.array("z.h", "z.alt"))).alias("h"), F.slice("c", F.col("pos") + 1, window).alias("theirs"))
    ours = marks.select("item_id", "h", "at", "total", "slotted", F.col("words").alias("ours"))
    met = held.join(F.broadcast(ours) if marks.count() <= BROADCAST_WINDOWS else ours, "h").join(pairs, ["doc_id", "item_id"], "left_semi").drop("h")
    # windows may meet under both readings
    met = materialize(met.dropDuplicates(["doc_id", "item_id", "part", "pos", "at"]), "met")

    def value(x: Column) -> Column:
        return F.coalesce(x["slot"], x["word"])

    # words that begin a sentence in both texts have a say only where they were exchanged
    exchanged = F.col("z.ours.slot").isNotNull() | (F.col("z.ours.alt") != F.col("z.ours.word")) & (value(F.col("z.ours")) != value(F.col("z.theirs")))

    def agreement(rows: DataFrame, *keys: str) -> DataFrame:
        slots = rows.where("slotted").select(*keys, F.explode(F.arrays_zip("ours", "theirs")).alias("z")).where(exchanged)
        votes = slots.groupBy(*keys, F.col("z.ours.alt").alias("kind"), value(F.col("z.ours")).alias("value"), value(F.col("z.theirs")).alias("other")).agg(F.count("*").alias("n"))
        each = votes.groupBy(*keys, "kind", "value").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
        return each.groupBy(*keys).agg((F.sum("most") / F.sum("n")).alias("agree"))

    enough = F.count_distinct("at") / F.max("total") >= coverage
    bad = materialize(agreement(met, "doc_id", "item_id").where(F.col("agree") < CONSISTENCY).select("doc_id", "item_id"), "contradicted")
    met = met.join(bad, ["doc_id", "item_id"], "left_semi")
    verbatim = met.where(F.transform("ours", value) == F.transform("theirs", value)).groupBy("doc_id", "item_id").agg(enough.alias("enough")).where("enough").select("doc_id", "item_id")
    off = F.col("pos") - F.col("at")
    place = ["doc_id", "item_id", "part", "off"]
    near = met.withColumn("off", F.explode(F.sequence(off - SHIFT, off + SHIFT)))
    whole = near.groupBy(*place).agg(enough.alias("enough")).where("enough").select(*place)
    agreed = agreement(near.join(whole, place, "left_semi"), *place).where(F.col("agree") >= CONSISTENCY).select("doc_id", "item_id")
    return bad.join(verbatim.union(agreed).distinct(), ["doc_id", "item_id"], "left_anti")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, contaminated, item_id (of the largest coverage, then the
    smallest id; null if none), coverage (0.0 if none), items (how many were found)."""
    id_col = options.get("id_col", "doc_id")
    best = F.min_by(F.struct("item_id", "coverage"), F.struct(-F.col("coverage"), F.col("item_id")))
    found = leaks(docs, benchmark, **options).groupBy("doc_id").agg(best.alias("best"), F.count("*").alias("items"))
    out = with_found(docs, found, id_col)
    hit = F.col("items").isNotNull()
    return out.select("doc_id", hit.alias("contaminated"), F.col("best.item_id").alias("item_id"), F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("items", F.lit(0)).alias("items"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows in whose text an item was found, all columns as they are."""
    found = materialize(leaks(docs, benchmark, **options).select("doc_id").distinct(), "leaks")
    return without_ids(docs, found, options.get("id_col", "doc_id"))
