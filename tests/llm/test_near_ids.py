"""Near duplicates among rows without ids of their own."""

import random
from collections import Counter

import numpy as np

from lacewing.llm import near_dedup

WORDS = [["%s%d" % (c, k) for k in range(120)] for c in "abcdefgh"]
A, B, C, D, E, G, H, _ = (" ".join(w) for w in WORDS)
NEAR_A, NEAR_B, NEAR_H = (t + " tail" for t in (A, B, H))
ROWS = [
    (5, A), (None, NEAR_A),  # one group
    (None, B), (None, NEAR_B),  # one group without ids
    (None, C), (None, C), (None, C),  # copies without ids
    (None, D), (7, E), (7, G), (7, G),  # one id, two texts, one of them twice
    (9, H), (9, NEAR_H), (None, ""), (None, None), (None, ""),
]


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def test_groups(spark):
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(frame(spark)).collect())
    want = Counter({(5, 5, True): 1, (None, 5, False): 1, (7, 7, True): 2, (7, 7, False): 1, (9, 9, True): 1, (9, 9, False): 1})
    # of B, C and D and of the empty ones
    assert got == want + Counter({(None, None, True): 3 + 3, (None, None, False): 1 + 2})


def test_one_row_of_each_group(spark):
    got = Counter(map(tuple, near_dedup.drop_near(frame(spark)).collect()))
    assert got[None, B] + got[None, NEAR_B] == got[9, H] + got[9, NEAR_H] == 1
    sole = {k: n for k, n in got.items() if k[1] not in (B, NEAR_B, H, NEAR_H)}
    assert sole == {(5, A): 1, (None, C): 1, (None, D): 1, (7, E): 1, (7, G): 1, (None, ""): 2, (None, None): 1}


def test_pairs_come_out_under_one_key(spark):
    """Signatures that differ in up to 60 of 96 places, each of a component of its own; those within 40 meet once."""
    rng = random.Random(4)
    base = [rng.randrange(1 << 16) for _ in range(96)]
    sigs = []
    for k in range(40):
        sigs.append(list(base))
        for place in rng.sample(range(96), k if k < 30 else 0):
            sigs[-1][place] ^= 1 << rng.randrange(16)
    raw = lambda s: np.array(s, "<u2").tobytes()
    classes = spark.createDataFrame([(k, bytearray(raw(s)), 10, 10, [0] * 8) for k, s in enumerate(sigs)], "cid long, sig binary, n long, s long, odd array<long>")
    links = near_dedup.Links(classes, 5, 80, 96)
    sizes = near_dedup.arrow_map(classes, near_dedup._lanes(96), "cid long, s long, n long, odd array<long>, lanes array<long>")
    got = Counter(map(tuple, links.across(links.keys().selectExpr("key", "cid", "v", "cid AS c"), sizes).collect()))
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    want = Counter((a, b) for b in range(40) for a in range(b) if apart(sigs[a], sigs[b]) <= links.far)
    assert got == want and 100 < len(want) < 40 * 39 // 2
