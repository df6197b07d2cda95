"""Covering hashing: finite masks for every radius and bucket size, and ids of all kinds."""

import random

import pytest
from test_operators import rows, slow_components, slow_fingerprint

from vellum.llm._common import components
from vellum.llm.near_text import near_texts
from vellum.llm.simhash import drop_near_copies, hamming_links, masks, near_duplicates


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("radius", [2, 3, 4, 5])
def test_masks_pin_a_bit_and_cover(radius):
    rnd = random.Random(radius)
    for free in (radius + 1, radius + 2, 7, 9, 2 ** (radius + 1) - 2, 40, 64):
        if free <= radius:
            continue
        bits = rnd.sample(range(64), min(free, 64))
        found = masks(sum(1 << b for b in bits), radius)
        assert all(found) and len(found) == 2 ** (radius + 1) - 1
        for _ in range(200):
            d = sum(1 << b for b in rnd.sample(bits, radius))
            assert any(not d & m for m in found)


@pytest.mark.parametrize("radius, bucket", [(2, 1), (3, 8), (3, 64), (4, 8), (5, 256)])
def test_links_end_and_tie_what_brute_force_ties(spark, radius, bucket):
    rnd = random.Random(radius)
    values = {rnd.getrandbits(64) for _ in range(40)}
    centre = rnd.getrandbits(64)
    values |= {centre ^ sum(1 << b for b in range(8) if m >> b & 1) for m in range(256)}
    for base in list(values)[:8]:
        for _ in range(8):
            base ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, radius)))
            values.add(base)
    fps = list(enumerate(sorted(values)))
    df = spark.createDataFrame([(signed(f), i) for i, f in fps], "fp long, rep long")
    root = {r.node: r.root for r in components(hamming_links(df, radius, bucket)).collect()}
    assert [root.get(i, i) for i, _ in fps] == slow_components(fps, radius)


def test_ids_of_all_kinds(spark):
    texts = [(2**62 + 5, "one two three four"), (2**62 + 6, "one two three four"), (-(2**63), "a b c d e"), (2**63 - 1, "a b c d e"), (None, "lone words here now"), (None, "lone words here now"), (7, "x y z"), (7, "p q r"), (None, "x y z"), (3, None), (None, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    fps = [(i, slow_fingerprint(t)) for i, t in texts]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(fps, slow_components(fps, 3))]
    assert rows(near_duplicates(df)) == sorted(want, key=str)
    assert {r.doc_id for r in drop_near_copies(df).collect()} == {2**62 + 5, -(2**63), None, 7, 3}
    got = {r.doc_id: r.component_id for r in near_texts(df).collect()}
    assert got[2**62 + 6] == 2**62 + 5 and got[2**63 - 1] == -(2**63) and got[3] == 3 and got[None] in (None, 3, 7)
