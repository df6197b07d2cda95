"""Licences of several paragraphs, in comments, among other text; anchors that lose nothing."""

import random

import pytest
from test_operators import slow_dice

from vellum.llm.licenses import COMMON, TEMPLATES, anchors, license_scan

MIT = TEMPLATES["MIT"].replace("subject to the following conditions: ", "subject to the following conditions:\n\n").replace("of the Software. THE", "of the Software.\n\nTHE")
PROSE = " ".join(f"plain{i} words{i} about" for i in range(60))


def test_passages(spark):
    comment = "\n".join(f" * {line}".rstrip() for line in MIT.split("\n"))
    rows = [(1, f"{PROSE}\n\n{MIT}\n\n{PROSE}"), (2, f"/*\n{comment}\n */\nint main() {{ return 0; }}\n\n{PROSE}"), (3, PROSE), (4, f"{PROSE}\n\n# {TEMPLATES['Zlib']}\n\n{PROSE}"), (5, TEMPLATES["BSD-3-Clause"]), (6, None), (7, f"{PROSE} license {PROSE}")]
    got = {r.doc_id: (r.license, r.licenses) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == got[2][0] == "MIT" and got[4][0] == "Zlib" and got[5][0] == "BSD-3-Clause"
    assert got[3] == got[6] == got[7] == (None, 0)


@pytest.mark.parametrize("dice", [0.5, 0.8, 0.95])
def test_what_is_within_reach_has_an_anchor(dice):
    rnd, words = random.Random(3), set(anchors(TEMPLATES, dice))
    near = 0
    for _ in range(3000):
        body = TEMPLATES[rnd.choice(sorted(TEMPLATES))].lower().replace("-", " ").split()
        gone = rnd.random() * 0.4
        text = " ".join(rnd.choice(["zzz", "qqq"]) if rnd.random() < gone or any(a in w for a in words) and rnd.random() < 0.5 else w for w in body)
        if any(slow_dice(text, t) >= dice for t in TEMPLATES.values()):
            near += 1
            import re

            assert words & set(re.sub("[^a-z0-9]+", " ", text).split())
    assert near > 20
    assert len(words & set(COMMON)) <= 6 or dice < 0.8
