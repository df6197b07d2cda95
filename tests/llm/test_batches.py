"""Encoders that work on whole batches, against the library; token files of odd ids."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import bpe, token_files
from vellum.llm.queries import tokenizer_path

PIECES = ["a", "b", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "é", "é", "'s", "1", "!!", ".", "<|endoftext|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|end", "　", "😀", "The ", "Å", "word", "ﬁ", "İ", "Σ", "ς", "ß", "ẞ", "Ǆ", "ŉ", "ſ", "ÉÑ"]


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def parts(ids, many):
    return [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])]


def test_byte_batches_equal_the_library():
    ours, theirs = bpe.ByteBpe(tokenizer_path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for seed in range(20):
        batch = [*texts(500, seed), "x " * 200_000, ""]
        want = [e.ids for e in theirs.encode_batch(batch, add_special_tokens=False)]
        ids, many = ours.encode_all(pa.array(batch, pa.string()))
        assert parts(ids, many) == want
        assert ours.count_all(pa.array(batch, pa.string())).tolist() == list(map(len, want))
        assert [ours.decode(w) for w in want] == batch
    assert [len(x) for x in ours.encode_all(pa.array([], pa.string()))] == [0, 0]
    assert ours.encode_all(pa.array(["", ""]))[1].tolist() == [0, 0]


def test_word_batches_equal_the_library(monkeypatch):
    ours, theirs = token_files.WordEncoder(tokenizer_path("word_bpe_49k.json")), library("word_bpe_49k.json")
    for seed in range(20):
        batch = [*texts(500, seed), ""]
        want = [[*e.ids, 7] for e in theirs.encode_batch(batch, add_special_tokens=False)]
        assert parts(*ours.encode_all(pa.array(batch, pa.string()), 7)) == want
    assert parts(*ours.encode_all(pa.array(["", ""]), 7)) == [[7], [7]]
    monkeypatch.setattr(token_files, "OUT_BYTES", 100)
    long = " ".join(texts(300, 99))
    assert parts(*ours.encode_all(pa.array([long]), 7)) == [[*theirs.encode(long, add_special_tokens=False).ids, 7]]


def test_ranges_are_even(spark):
    rows = [(i, 10) for i in range(1000)] + [(10**18 + i, 10) for i in range(1000)] + [(-(2**63), 10), (2**63 - 1, 10), (None, 10)] + [(5, 4000)]
    sizes = spark.createDataFrame(rows, "doc_id long, n long")
    bounds = token_files.equal_ranges(sizes, 12)
    assert bounds == sorted(set(bounds)) and len(bounds) <= 24
    held = {}
    for i, n in rows:
        k = 0 if i is None else sum(b <= i for b in bounds)
        held[k] = held.get(k, 0) + n
    full = 24040 / 12
    assert all(n <= full + 10 for k, n in held.items() if k != sum(b <= 5 for b in bounds))
    assert token_files.equal_ranges(sizes.limit(0), 12) == []


@pytest.mark.parametrize("size", [1, 300, 1 << 25])
def test_files_of_odd_ids(spark, size):
    ids = [None, None, -(2**63), -1, 0, 3, 3, 3, 2**62 + 5, 2**62 + 6, 2**63 - 1]
    rows = [(i, f"text number {k} " * (k % 4)) for k, i in enumerate(ids)]
    theirs = library("word_bpe_49k.json")
    coded = [(i, [*theirs.encode(t, add_special_tokens=False).ids, 1]) for i, t in rows]
    coded.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), np.array(x[1], "<u2").tobytes()))
    want, start = [], 0
    for i, x in coded:
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = token_files.write_token_files(df, tokenizer_path("word_bpe_49k.json"), 1, part_bytes=size)
    assert [r.part for r in manifest.orderBy("part").collect()] == list(range(manifest.count()))
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    assert token_files.read_token_files(manifest).agg(F.sum("n_tokens")).first()[0] == start


def test_merging_together_equals_merging_alone():
    ours, rnd = bpe.ByteBpe(tokenizer_path("byte_bpe_50k.json")), random.Random(6)
    raws = [b""] + ["".join(rnd.choice(" aeinorstthéß日xyz0123,.") for _ in range(rnd.randint(1, 40))).encode()[: bpe.SHORT] for _ in range(4000)]
    got = ours.merged_all(raws)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ours.merged(r) for r in raws]
    table = ours.pairs(np.array([*list(ours.merge)[:500], -5, 7], np.int64))
    assert table[:500].tolist() == list(ours.merge.values())[:500] and table[500] == bpe.NO_MERGE
