"""The pipeline's stages on a small corpus, each against what brute force keeps of its input."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_near_text import brute  # noqa: E402
from test_operators import toxic_corpus  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    corpus, _ = toxic_corpus(700)
    item = "which of the following seven words describes a long river that flows north to the sea"
    texts = [(i, t, "en", "s", len(t)) for i, t, _ in corpus]
    texts += [(5000 + i, f"opening words {i}. {item}. closing words {i * i}.", "en", "s", 1) for i in range(10)]
    texts += [(6000 + i, "the same text again and again in all of these ten rows", "en", "s", 1) for i in range(10)]
    base = " ".join(f"w{i}" for i in range(400))
    texts += [(7000 + i, base.replace(f"w{40 * i} ", "changed "), "en", "s", 1) for i in range(6)]
    texts += [(8000, None, None, None, None), (8001, "", "en", "s", 0)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert len(after) == docs.count() and after.items() <= before.items()
        if name == "toxicity":
            wrong = [i for i in before if (i in after) == bool(labels.get(i, 0))]
            assert len(wrong) <= 5
        elif name == "exact_dedup":
            best = {}
            for i, t in before.items():
                best[t or ""] = max(i, best.get(t or "", i))
            assert set(after) == set(best.values())
        elif name == "near_dedup":
            # five-word shingles of similarity 0.8 or more, as stages on word shingles have it
            want, _ = brute(list(before.items()))
            assert set(after) == set(want.values())
        else:
            words = lambda t: re.findall(r"\w+", (t or "").lower())
            grams = lambda t: set(zip(*[words(t)[k:] for k in range(5)]))
            item = grams(spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text)
            assert set(after) == {i for i, t in before.items() if len(grams(t) & item) < 0.8 * len(item)}
        before = after
    encoded = stages["bpe"](spark, docs, sf_dir)
    assert {r.doc_id for r in encoded.collect()} == set(before)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, encoded.collect()))
