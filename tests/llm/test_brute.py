"""Operators without SQL against plain Python versions, and the registered queries as they are."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import language, queries, toxicity
from vellum.llm.decontamination import leaks
from vellum.llm.sharding import shard_documents

SMALL = "/root/testdata/sf0.001"


def test_sharding_is_the_same_however_rows_come(spark):
    rows = [(i, f"t{i % 50}") for i in range(2000)] + [(7, "same")] * 1500 + [(None, "n")] * 500 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [Counter((r.shard, r.slot, r.doc_id, r.text) for r in shard_documents(df.repartition(n), bucket_bytes=1500).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and sum(runs[0].values()) == len(rows)
    assert Counter((i, t) for _, _, i, t in runs[0].elements()) == Counter(rows)
    hot = Counter(s for s, _, i, t in runs[0].elements() if (i, t) == (7, "same"))
    assert len(hot) == 16 and max(hot.values()) < 2 * min(hot.values())
    other = Counter((r.shard, r.slot, r.doc_id, r.text) for r in shard_documents(df, seed=1, bucket_bytes=1500).collect())
    assert other != runs[0]


def test_op2_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op2_sharding(spark, SMALL).collect()
    assert Counter(r.doc_id for r in got) == Counter(docs.keys())
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def slow_clause(words, stems):
    kinds = toxicity.WORDS

    def kind(w):
        if any(w.startswith(s) for s in stems):
            return "i"
        for k in kinds:
            if w in kinds[k].split():
                return {toxicity.THREAT: "k", toxicity.TARGET: "t", toxicity.NEGATION: "n", toxicity.REPORT: "r"}[k]
        return "k" if toxicity.is_threat(w) else "o"

    symbols, total = [kind(w) for w in words], 0.0
    for i, s in enumerate(symbols):
        if s not in "ik":
            continue
        x = 1.0
        if s == "i":
            x = max(v for p, v in stems.items() if words[i].startswith(p))
            x *= 1.5 if "t" in symbols[max(0, i - 4) : i] else 1
            x *= 1.5 if "t" in symbols[i + 1 : i + 5] else 1
        else:
            x = toxicity.THREAT_WEIGHT * ("t" in symbols)
        x *= 0.3 if "n" in symbols[max(0, i - 2) : i] else 1
        x *= 0.5 if "r" in symbols[:i] else 1
        x *= 0.5 if "r" in symbols[i + 1 :] else 1
        total += x
    return total


def test_grammar_equals_brute_force():
    stems = {"fool": 3.0, "idio": 4.0}
    scorer, rnd = toxicity.Scorer(toxicity.Model(stems)), random.Random(2)
    words = "fool foolish idiot you they not never said quote kill killing stabbed shoots beats the cat ran home".split()
    for _ in range(2000):
        clauses = [[rnd.choice(words) for _ in range(rnd.randint(0, 9))] for _ in range(rnd.randint(1, 4))]
        text = "".join(" ".join(c) + rnd.choice([". ", "! ", "\n"]) for c in clauses)
        assert scorer.raw(text) == pytest.approx(sum(slow_clause(c, stems) for c in clauses)), text
    assert toxicity.is_threat("stabbing") and toxicity.is_threat("killed") and not toxicity.is_threat("skill") and not toxicity.is_threat("beatles")
    long = "the cat ran home " * 60_000 + "fool"
    assert scorer.raw(long) == 3.0 and scorer.raw(("fool " * 20_000).strip()) == 60_000.0


def test_op3_query(spark):
    got = queries.op3_toxicity(spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1


def test_toxic_stage_on_odd_tables(spark):
    model = toxicity.Model({"fool": 6.0}, -4.0, 3.0)
    rows = [(1, None, "a", 1.0), (2, "", "b", None), (None, "fool you fool", None, 2.0), (3, "fool you fool", "c", 3.0), (3, "fine", "d", 4.0), (4, "fine " * 50_000, "e", 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, raw double")
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and Counter(r.score for r in kept.collect()) == Counter(["a", "b", "d", "e"])
    assert toxicity.drop_toxic(df.limit(0), model).count() == 0


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 3)))
    items = [(k, " ".join(word() for _ in range(rnd.randint(6, 30)))) for k in range(12)]
    texts = []
    for i in range(150):
        words = [word() for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 2)):
            passage = rnd.choice(items)[1].split()
            a, b = rnd.randint(0, 4), rnd.randint(0, 6)
            at = rnd.randint(0, len(words))
            words[at:at] = passage[a : len(passage) - b]
        texts.append((i % 140, " ".join(words)))  # some ids stand twice
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    held = defaultdict(set)
    for i, t in texts:
        held[i] |= grams(t)
    want = {}
    for i, g in held.items():
        for k, t in items:
            starts = [tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)]
            share = sum(x in g for x in starts) / len(starts)
            if share >= 0.8:
                want[i, k] = round(share, 9)
    found = leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): round(r.coverage, 9) for r in found.collect()} == want and len(want) > 20


def test_repeated_ids_add_up_to_no_more_than_their_windows(spark):
    item = "which of the following words describes a long river that flows north to the sea at night"
    half = " ".join(item.split()[:10])
    docs = spark.createDataFrame([(1, half), (1, half), (2, half), (3, item)], "doc_id long, text string")
    assert {r.doc_id for r in leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == {3}


def slow_identify(rows, model):
    """Posteriors by plain sums, each row left out of its own priors."""
    n = len(model.languages)
    ev = [model.evidence(t) for _, t, _, _ in rows]
    informed = [min(e) < 0 for e in ev]
    own = [np.exp(e) / np.exp(e).sum() if i else np.zeros(n) for e, i in zip(ev, informed)]

    def domain(h):
        p = h.split(".")
        return ".".join(p[-3:] if len(p) > 2 and p[-2] in language.SECOND_LEVEL and re.search(r"\.[a-z]{2}$", h) else p[-2:])

    sums = {}
    for (k, t, d, h), o in zip(rows, own):
        names = [("all", "")] + ([("declared", d)] if d else [])
        if h:
            names += [("host", h), ("domain", domain(h))] + ([("suffix", h.rsplit(".", 1)[-1])] if "." in h else [])
        for name in names:
            sums[name] = sums.get(name, np.zeros(n)) + o
    tags = [k[1] for k in sums if k[0] == "declared"]
    totals = sum((sums["declared", d] for d in tags), np.zeros(n))
    out = {}
    for (k, t, d, h), e, o in zip(rows, ev, own):
        prior = np.maximum(sums["all", ""] - o, 0) + language.PSEUDO
        prior = prior / prior.sum()
        for name, key in (("suffix", h.rsplit(".", 1)[-1] if h and "." in h else None), ("domain", domain(h) if h else None), ("host", h)):
            c = np.maximum(sums[name, key] - o, 0) if key else np.zeros(n)
            prior = (c + language.SMOOTHING * prior) / (c.sum() + language.SMOOTHING)
        post = np.array(e) + np.log(prior)
        if d:
            heard = np.log((sums["declared", d] + language.PSEUDO) / (totals + language.PSEUDO * (len(tags) + 1)))
            post += heard - heard.max()
        p = np.exp(post - post.max())
        out[k] = (model.languages[int(p.argmax())], 1 / p.sum())
    return out


def test_language_equals_brute_force(spark):
    rnd = random.Random(4)
    vocab = {"aa": ["kala", "mala", "tala"], "bb": ["wrzf", "grzt", "prsz"], "cc": ["kalz", "mrza", "tazt"]}
    text = lambda lang, n: " ".join(rnd.choice(vocab[lang]) + rnd.choice("xyz") for _ in range(n))
    labelled = [(i, text("abc"[i % 3] * 2, 12), "abc"[i % 3] * 2) for i in range(200)]
    model = language.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    rows = []
    for k in range(300):
        lang = rnd.choice(list(vocab))
        t = rnd.choice([text(lang, rnd.randint(1, 4)), "", None]) if k % 3 else text(lang, 8)
        rows.append((k, t, rnd.choice([None, lang, "zz"]), rnd.choice([None, f"w{rnd.randint(0, 9)}.{lang}.co.uk", f"x.{lang}{rnd.randint(0, 30)}.{lang}", "alone"])))
    rows += [(900, None, None, "new.host.bb"), (901, "", None, "new.aa.co.uk")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "k long, text string, declared string, host string, ll string, own int, rows string")
    got = {r.k: r for r in language.identify(df, model, ["k"]).collect()}
    want = slow_identify(rows, model)
    assert {k: r.lang for k, r in got.items()} == {k: w[0] for k, w in want.items()}
    assert all(got[k].confidence == pytest.approx(want[k][1], abs=2e-6) for k in want)
    assert got[900].lang == "bb"  # a host without a text: its suffix is all that is known
    long = spark.createDataFrame([(1, text("aa", 3) + " " + text("bb", 60_000), None, None)], "k long, text string, declared string, host string")
    assert language.identify(long, model, ["k"]).first().text_lang == "bb"


@pytest.mark.parametrize("name", ["op4_simhash", "op5_token_counts", "op6_bpe", "op7_token_files", "op8_decontamination", "op10_language"])
def test_queries_give_a_row_for_each_document(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    if name == "op5_token_counts":
        assert out.agg(F.sum("documents")).first()[0] == docs.count()
    else:
        ids = Counter(r.doc_id for r in out.select("doc_id").collect() if r.doc_id is not None)
        assert ids == Counter(r.doc_id for r in docs.select("doc_id").collect())


def test_logistic_score_is_monotone():
    model = toxicity.Model({"fool": 2.0}, -3.0, 2.0)
    scores = [toxicity.Scorer(model).score("fool " * k) for k in range(6)]
    assert scores == sorted(scores) and math.isclose(scores[0], 1 / (1 + math.exp(3)))
