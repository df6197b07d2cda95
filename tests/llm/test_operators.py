"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns whose names clash with the operators' own."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import language, toxicity
from vellum.llm._common import components, lookup
from vellum.llm.bpe import ByteBpe, encode_documents, sufficient_lookahead
from vellum.llm.decontamination import contamination, drop_leaks
from vellum.llm.exact_dedup import drop_exact_copies, exact_dedup
from vellum.llm.licenses import license_scan
from vellum.llm.queries import tokenizer_path
from vellum.llm.sharding import shard_documents
from vellum.llm.simhash import drop_near_copies, fingerprint, hamming_links, masks, near_duplicates
from vellum.llm.token_counts import context_limits, length_histogram, quantile, truncated_total
from vellum.llm.token_files import part_of, read_token_files, write_token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, fp long, shard int, Size int, hit string, at int, root long"
EXTRA = (None, "x", 1, 2, 3, "y", 4, 5)
LONG = " ".join(f"word{i % 977} of, the" for i in range(30_000))
TEXTS = [
    (1, "a quick brown fox jumps over the lazy dog tonight"),
    (2, "a quick brown fox jumps over the lazy dog tonight"),
    (3, ""),
    (4, None),
    (5, "   \n\t "),
    (6, LONG),
    (7, LONG + " end"),
    (8, "A QUICK brown fox jumps  over the lazy\ndog tonight"),
    (8, "A QUICK brown fox jumps  over the lazy\ndog tonight"),
    (None, "nobody's text"),
    (None, None),
    (9, "déjà vu 😀 <|endoftext|> naïve façade"),
    (10, "x" * 5000),
    (11, "one"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "src0", *EXTRA) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_exact_dedup(docs, none):
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in TEXTS:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(exact_dedup(docs)) == sorted(want, key=str)
    # every hash collides: bytes alone tell texts apart
    assert rows(exact_dedup(docs, hash128=lambda t: F.unhex(F.lit("00")))) == sorted(want, key=str)
    assert rows(exact_dedup(none)) == []
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted(groups)
    assert {r.doc_id for r in kept.collect()} == {2, 4, 5, 6, 7, 8, 9, 10, 11, None}
    assert rows(drop_exact_copies(none)) == []


def test_sharding(docs, none, spark, tmp_path):
    got = shard_documents(docs, shards=4, bucket_bytes=200_000)
    assert set(docs.columns) - {"Size", "shard"} <= set(got.columns)
    all_rows = got.collect()
    assert Counter((r.doc_id, r.text) for r in all_rows) == Counter(TEXTS)
    by = {}
    for r in all_rows:
        assert r["size"] == len((r.text or "").encode()) + 1 and r.law == "rows" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == [0, 1, 2, 3]
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert rows(shard_documents(none)) == []
    many = shard_documents(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")), shards=16, bucket_bytes=1000)
    order = [r.doc_id for r in many.orderBy("shard", "slot").collect()]
    assert sorted(order) == list(range(5000)) and order != sorted(order)
    neighbours = sum(abs(a - b) == 1 for a, b in zip(order, order[1:]))
    assert neighbours < 50
    assert set(Counter(r.shard for r in many.collect()).values()) <= {312, 313}


def slow_fingerprint(text, words=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius):
    """fps: list of (id, fp). Smallest id reachable for each row."""
    distinct = sorted({f for _, f in fps})
    group = {f: f for f in distinct}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                group[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for _, f in fps]


def test_simhash(docs, none):
    for _, t in TEXTS[:6] + TEXTS[8:]:
        assert fingerprint(t) == slow_fingerprint(t)
    fps = [(i, slow_fingerprint(t)) for i, t in TEXTS]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(fps, slow_components(fps, 3))]
    assert rows(near_duplicates(docs)) == sorted(want, key=str)
    assert rows(near_duplicates(none)) == []
    kept = drop_near_copies(docs).collect()
    assert {r.doc_id for r in kept} == {c for _, _, c in want} and sum(r.doc_id is None for r in kept) == 2
    assert rows(drop_near_copies(none)) == []


@pytest.mark.parametrize("radius", [2, 3, 4])
def test_masks_cover(radius):
    rnd, all_masks = random.Random(radius), masks(2**64 - 1, radius)
    for _ in range(3000):
        d = sum(1 << b for b in rnd.sample(range(64), radius))
        assert any(not d & m for m in all_masks)


@pytest.mark.parametrize("bucket", [40, 256])
def test_links_tie_what_brute_force_ties(spark, bucket):
    rnd = random.Random(5)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for base in list(values)[:12]:  # a cluster of chains and a dense ball
        for _ in range(25):
            base ^= 1 << rnd.randrange(64)
            values.add(base)
    centre = rnd.getrandbits(64)
    values |= {centre ^ sum(1 << b for b in range(9) if m >> b & 1) for m in range(512)}
    fps = [(i, f) for i, f in enumerate(sorted(values))]
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in fps], "fp long, rep long")
    root = {r.node: r.root for r in components(hamming_links(df, 3, bucket)).collect()}
    assert [root.get(i, i) for i, _ in fps] == slow_components(fps, 3)


def test_components_and_lookup(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 300), (5, 5)] + [(400, x) for x in range(401, 460)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 101)) and got[300] == 200 and got[459] == 400
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    table = spark.createDataFrame([(k, k * 10, 5) for k in range(1500)], "k long, v long, w long")
    found = lookup(spark.createDataFrame([(k % 1600, k) for k in range(4000)] + [(None, 1)], "k long, i long"), table, ["k"], ["v"], "w", "i")
    assert Counter((r.k, r.i, r.v) for r in found.collect()) == Counter([(k % 1600, k, k % 1600 * 10 if k % 1600 < 1500 else None) for k in range(4000)] + [(None, 1, None)])


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_bpe_equals_library(docs, none, library):
    path = tokenizer_path("byte_bpe_50k.json")
    want = []
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, tuple(r.ids), r.decoded) for r in encode_documents(docs, path).collect()]
    assert Counter(got) == Counter(want)
    assert rows(encode_documents(none, path)) == []


def test_bpe_stream_is_stable(library):
    bpe = ByteBpe(tokenizer_path("byte_bpe_50k.json"), window=0)
    rnd = random.Random(3)
    for text in ("a" * 9000, "".join(rnd.choice("abcdeinost") for _ in range(12_000)), "=-" * 4000, "日本語" * 2000):
        raw = text.encode()
        parts = [raw[i : i + 97] for i in range(0, len(raw), 97)]
        assert list(bpe.stream(parts)) == bpe.merged(raw)
        assert list(bpe.encode(text)) == library.encode(text, add_special_tokens=False).ids
    parts = ["a", "b", " ", "  ", "\n", "\t", " ", "\x1c", "é", "'s", "1", "!!", "<|endoftext|>", "<|end", "　", "😀", "the "]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert list(bpe.encode(text)) == library.encode(text, add_special_tokens=False).ids, text
        assert bpe.decode(bpe.encode(text).tolist()) == text
    assert bpe.decode([bpe.first[0xE6]]) == "�"


def test_lookahead_of_a_chain():
    # merges ab, then bX(ab..): a right end that waits for one more byte can move two tokens back
    assert sufficient_lookahead([(0, 1, 2)], {0: 1, 1: 1, 2: 2}) == 1
    assert sufficient_lookahead([(1, 2, 3), (0, 1, 4)], {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}) == 2


def test_token_counts(docs, none, library, spark):
    path = tokenizer_path("byte_bpe_50k.json")
    lengths = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in TEXTS)
    limits = context_limits(length_histogram(docs, path), block=7).cache()
    for r in limits.collect():
        L = r.n_tokens
        at_least = [x for x in lengths if x >= L]
        assert (r.documents, r.documents_at_least, r.tokens_at_least) == (lengths.count(L), len(at_least), sum(at_least))
        assert (r.documents_total, r.tokens_total) == (len(lengths), sum(lengths))
        assert r.truncated_total == sum(min(x, L) for x in lengths)
        assert r.share_whole == pytest.approx(sum(x <= L for x in lengths) / len(lengths))
    for q in (0.1, 0.5, 0.9, 1.0):
        assert quantile(limits, q).first()[0] == min(x for x in lengths if sum(y <= x for y in lengths) >= q * len(lengths))
    for limit in (0, 3, 11, 1000, 10**9):
        assert truncated_total(limits, limit).first()[0] == sum(min(x, limit) for x in lengths)
    assert rows(context_limits(length_histogram(none, path))) == []


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ordered = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, start = [], 0
    for i, text in ordered:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for size in (1 << 25, 100_000):
        for dtype in ("<u2", "<u4"):
            assert rows(read_token_files(write_token_files(docs, path, 1, part_bytes=size, dtype=dtype))) == sorted(want, key=str)
    assert rows(read_token_files(write_token_files(none, path, 1))) == []


def test_part_of(spark):
    bounds = [3, 5, 8, 13, 21]
    got = spark.range(30).select("id", part_of(F.col("id"), bounds).alias("p")).collect()
    assert all(r.p == sum(b <= r.id for b in bounds) for r in got)


def toxic_corpus(n=1200):
    rnd = random.Random(11)
    syllables = ["ba", "do", "ke", "li", "mu", "na", "po", "ri", "sa", "te"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(8, 60))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["zorgling", "wretch", "gombastic"]) + rnd.choice(["", "s", "ly"]))
        out.append((i, " ".join(words) + ".", int(toxic)))
    copied = " ".join(word() for _ in range(40))  # a toxic text that was copied: its plain words must not become stems
    out += [(n + i, copied + " wretch wretch zorgling.", 1) for i in range(150)]
    return out, copied


def test_toxicity(spark, docs, none):
    corpus, copied = toxic_corpus()
    texts = spark.createDataFrame([(i, t) for i, t, _ in corpus] + [(90_000, copied)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in corpus] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(texts, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(texts, model).collect()}
    held = [(i, x) for i, _, x in corpus if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held) and len(held) > 100
    assert sum(got[i].predicted == x for i, x in held) >= 0.99 * len(held)
    assert got[90_000].predicted == 0
    edge = toxicity.score_documents(docs, model).collect()
    assert len(edge) == len(TEXTS) and all(0 <= r.score <= 1 for r in edge)
    assert rows(toxicity.score_documents(none, model)) == []
    kept = toxicity.drop_toxic(texts, model)
    assert kept.columns == texts.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    empty = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score_documents(docs, empty).collect()} == {0}


def test_toxicity_grammar():
    scorer = toxicity.Scorer(toxicity.Model({"fool": 3.0, "idiot$": 4.0}))
    plain = scorer.raw("a fool came.")
    assert plain == 3.0 and scorer.raw("the foolish man") == 3.0 and scorer.raw("idiots, tomfool") == 0.0
    assert scorer.raw("you fool") > plain > scorer.raw("no fool") and plain > scorer.raw("he said a fool came")
    assert scorer.raw("he said it. a fool came.") == plain
    assert scorer.raw("I will kill you") > 0 == scorer.raw("kill the lights")


def test_decontamination(spark, docs, none):
    items = [
        (1, "Tom saw that Anna had 12 apples and 30 pears, so Anna gave Tom 12 apples in 5 minutes of time."),
        (2, "which of the following words describes a long river that flows north"),
        (3, "too short"),
        (4, None),
        (None, "which of the following words describes"),
    ]
    marks = spark.createDataFrame(items, "item_id long, text string")
    texts = [
        (1, f"Before. {items[0][1]} After that."),
        (2, "Tom saw that Maria had 7 apples and 99 pears, so Maria gave Tom 7 apples in 8 hours of time."),
        (3, "Tom saw that Maria had 7 apples and 99 pears, so Peter gave Olga 8 apples in 8 hours of time."),
        (4, "x y z. Which of the following words describes a long river that flows north? More."),
        (5, "which of the following words is long"),
        (6, None),
        (7, ""),
        (8, ". " * 20_000 + "1 2 3 " * 5000),
        (None, items[1][1]),
        (9, items[1][1]),
        (9, items[1][1]),
        (10, f"{items[1][1]} {items[0][1]}"),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", *EXTRA) for i, t in texts], SCHEMA)
    got = contamination(df, marks)
    assert sorted((r.doc_id, r.item_id, r["items"]) for r in got.collect() if r.contaminated) == [(1, 1, 1), (2, 1, 1), (4, 2, 1), (9, 2, 1), (9, 2, 1), (10, 1, 2)]
    assert got.count() == len(texts)
    kept = drop_leaks(df, marks)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter([3, 5, 6, 7, 8, None])
    assert contamination(docs, marks).where("contaminated").count() == 0
    assert rows(contamination(none, marks)) == []
    assert contamination(df, marks.limit(0)).where("contaminated").count() == 0


def slow_dice(a, b):
    def pairs(t):
        w = re.sub("[^a-z0-9]+", " ", t.lower()).split()
        return set(w if len(w) == 1 else [f"{x} {y}" for x, y in zip(w, w[1:])])

    x, y = pairs(a), pairs(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def test_licenses(spark, docs, none):
    from vellum.llm.licenses import TEMPLATES

    rnd, texts = random.Random(4), []
    for i in range(60):
        name = rnd.choice(sorted(TEMPLATES))
        words = TEMPLATES[name].split()
        for _ in range(rnd.randint(0, max(1, len(words) // 8))):
            words[rnd.randrange(len(words))] = "other"
        body = " ".join(words)
        texts.append((i, rnd.choice(["intro line\n", ""]) + (body if i % 3 else body.replace(" ", "\n")) + rnd.choice(["", "\nlast line", "\n\nmore text"])))
    df = spark.createDataFrame([(i, t, "en", "s", *EXTRA) for i, t in texts], SCHEMA)
    for r in license_scan(df).collect():
        text = dict(texts)[r.doc_id]
        parts = {*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text}
        scores = {n: round(max(slow_dice(p, t) for p in parts), 6) for n, t in TEMPLATES.items()}
        over = {n: s for n, s in scores.items() if s >= 0.8}
        assert r.licenses == len(over) and r.dice == max(over.values(), default=None)
        assert r.license == min((n for n in over if over[n] == r.dice), default=None)
    assert license_scan(docs).where("license is not null").count() == 0 and license_scan(docs).count() == len(TEXTS)
    assert rows(license_scan(none)) == []


def test_language(spark, docs, none):
    rnd = random.Random(9)
    vocab = {"aa": ["kala", "mala", "tala", "vala"], "bb": ["wrzf", "grzt", "prsz", "trzw"]}
    text = lambda lang: " ".join(rnd.choice(vocab[lang]) + rnd.choice("xyz") for _ in range(20))
    texts = [(i, text("ab"[i % 2] * 2), "ab"[i % 2] * 2) for i in range(300)]
    model = language.train(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb"]
    web = [(i, t, lang, f"www.{lang}.example.{'org' if lang == 'aa' else 'net'}") for i, t, lang in texts]
    web += [(1001, "", None, "www.bb.example.net"), (1002, None, "aa", None), (1003, "", None, "new.host.org"), (1004, None, None, None), (1005, text("aa"), "bb", "www.bb.example.net")]
    got = {r.k: r for r in language.identify(spark.createDataFrame(web, "k long, text string, declared string, host string"), model, ["k"]).collect()}
    assert all(got[i].lang == lang and got[i].text_lang == lang for i, _, lang in texts)
    assert got[1001].lang == "bb" and got[1002].lang == "aa" and got[1004].text_lang is None and got[1005].text_lang == "aa"
    assert all(0 < r.confidence <= 1 for r in got.values())
    assert len(got) == len(web)
    empty = language.identify(none.select(F.col("doc_id").alias("k"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host")), model, ["k"])
    assert rows(empty) == []
    page = spark.createDataFrame([("<!doctype html><HTML class=a lang='de-AT'><script>var x='<b>';</script><p>Gr&amp;n", "https://u@www.Example.co.uk:80/a?b#c"), ("<p>none", "x"), (None, None)], "html string, url string")
    out = page.select(language.html_text(F.col("html")).alias("t"), language.declared_language(F.col("html")).alias("d"), language.host_of(F.col("url")).alias("h")).collect()
    assert out[0].t.split() == ["Gr&n"] and (out[0].d, out[0].h) == ("de", "www.example.co.uk") and (out[1].d, out[1].h) == (None, None) and out[2].t is None
