"""Distances of many strings at once, and the searches that compare all with them."""

import random

import pytest

from lacewing.operators import distances
from lacewing.operators import matching as m
from lacewing.operators.index import NameIndex, Settings

from .oracle import distance, pairs, score


def names_of(rng, longest, n=30):
    out = ["".join(rng.choice("abcçŞ😀 x") for _ in range(rng.randint(0, longest))) for _ in range(n)]
    return out + [a[:5] + "q" + a[6:] for a in out[: n // 2]] + ["", "a"]


@pytest.mark.parametrize("longest", [12, 70, 150])
def test_near_is_plain_distance(longest, monkeypatch):
    monkeypatch.setattr(distances, "WIDE", 16)
    some = names_of(random.Random(longest), longest)
    for t in (0, 0.2, 0.6, 1):
        got = [x for i, j, d in distances.near(some, some[::-1], t) for x in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)]
        want = {(i, j, d) for i, a in enumerate(some) for j, b in enumerate(some[::-1]) if (d := distance(a, b)) <= t * max(len(a), len(b)) + 1e-9}
        assert len(got) == len(want) and set(got) == want
    assert not list(distances.near([], some, 1)) and not list(distances.near(some, [], 1))


def test_index_compares_all_at_once(spark, tmp_path, monkeypatch):
    """where all are compared, no pair of rows goes through a loop join; strings on both sides of LONG."""
    monkeypatch.setattr(m, "GROUP", 7)
    monkeypatch.setattr(m, "LONG", 40)
    some = [" ".join(a.lower().split()) for a in names_of(random.Random(4), 60)]
    frame = lambda names: spark.createDataFrame(list(enumerate(names)), "id long, name string")
    index = NameIndex.build(frame(some), str(tmp_path / "index"), Settings(0.6))
    hits = index.hits(frame(some[::-1]))
    assert "MapInArrow" in hits._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in hits.collect()]
    want = {(i, j, score(a, b)) for i, a in enumerate(some[::-1]) for j, b in enumerate(some) if score(a, b) <= 0.6}
    assert len(got) == len(want) and set(got) == want
    short = index.hits(frame([a for a in some if len(a) <= 40]))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in x and "levenshtein" in x for x in short.splitlines()) == 1  # the index's long names alone


def test_wide_search_compares_all_at_once(spark, monkeypatch):
    """as above, for the pairs of one table; neighbours in the order stand in several groups."""
    monkeypatch.setattr(m, "GROUP", 7)
    some = names_of(random.Random(5), 90, 40)
    rows = spark.createDataFrame(list(enumerate(some + some[:9])), "id long, name string")
    for long in (512, 30):
        monkeypatch.setattr(m, "LONG", long)
        df = m.find_duplicates(rows, 0.6)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and ("levenshtein" in plan) == (long == 30)
        got, want = [tuple(r) for r in df.collect()], pairs(some + some[:9], 0.6)
        assert len(got) == len(want) and set(got) == want


def test_wide_pairs_are_not_joined(spark, monkeypatch):
    """F1 of round 3: no join takes the pairs, which it would shuffle where ids are too large to broadcast. A string with more
    rows than a block, ids that stand twice and strings on both sides of LONG."""
    for name, value in (("GROUP", 7), ("BLOCK", 3), ("TOLD", 20)):
        monkeypatch.setattr(m, name, value, raising=False)
    some = names_of(random.Random(9), 90, 25)
    some += some[:9] + some[3:4] * 8 + [""] * 4 + [max(some, key=len)] * 4
    rows = [(i if i % 11 else 5, a) for i, a in enumerate(some)]
    clean = [" ".join(a.lower().split()) for a in some]
    want = sorted((*sorted((x, y)), d) for i, (x, _) in enumerate(rows) for j, (y, _) in enumerate(rows[:i]) if (d := score(clean[i], clean[j])) <= 0.6 and (d or x != y))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for long in (512, 30):
            monkeypatch.setattr(m, "LONG", long)
            df = m.find_duplicates(spark.createDataFrame(rows, "id long, name string"), 0.6)
            above = df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
            assert long == 30 or "Join" not in above
            assert sorted(map(tuple, df.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counts_leave_few_patterns(monkeypatch):
    """below a narrow threshold, most patterns are ruled out by their character counts, and no pair is lost."""
    monkeypatch.setattr(distances, "TOGETHER", 2)
    monkeypatch.setattr(distances, "WIDE", 8)
    monkeypatch.setattr(distances, "HELD", 32)
    rng, taken, take = random.Random(8), [], distances.Patterns.take
    monkeypatch.setattr(distances.Patterns, "take", lambda self, some: taken.append(len(some)) or take(self, some))
    some = ["".join(rng.choice(letters) * rng.randint(1, 7) for _ in range(10)) for letters in ("abc", "defg", "hi", "jkç", "lmno", "😀p") for _ in range(12)]
    some += [a[:4] + "z" + a[4 + k % 2 :] for k, a in enumerate(some[::3])]
    got = [x for i, j, d in distances.near(some, some, 0.1) for x in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)]
    want = {(i, j, d) for i, a in enumerate(some) for j, b in enumerate(some) if (d := distance(a, b)) <= 0.1 * max(len(a), len(b)) + 1e-9}
    assert len(got) == len(want) and set(got) == want
    assert sum(taken) < len(some) * -(-len(some) // 2) / 2


def test_stats_makes_no_pairs(spark, monkeypatch):
    """meetings are counted as the pairs of rows that share a segment, and are not made."""
    monkeypatch.setattr(m, "GROUP", 9)
    rng = random.Random(6)
    some = ["".join(rng.choice("aab") for _ in range(rng.randint(0, 14))) for _ in range(50)] + ["", "", "çŞ😀abcabc", "çŞ😀abcabd"]
    some += some[:8]
    rows = [(7 * i % 101, a) for i, a in enumerate(some)]
    frame = spark.createDataFrame(rows, "id long, name string")
    made, empties = m.candidates, some.count("")
    want = []
    for t in (0.1, 0.3):
        norm = frame.selectExpr("id", "name AS norm")
        want.append((m.find_duplicates(frame, t).count(), made(norm, t, ["id"], "id").select("s_id", "r_id").distinct().count() + empties * (empties - 1) // 2))
    monkeypatch.setattr(m, "LONG", 11)  # pairs with a longer one are made
    assert [(r.found, r.verified) for r in (m.stats(frame, t).first() for t in (0.1, 0.3))] == want
    monkeypatch.setattr(m, "LONG", 512)
    monkeypatch.setattr(m, "candidates", lambda *_: 1 / 0)
    assert [(r.found, r.verified) for r in (m.stats(frame, t).first() for t in (0.1, 0.3))] == want


def test_names_that_meet_often_are_compared_at_once(spark, monkeypatch):
    """auto, with more than FEW strings that begin alike."""
    monkeypatch.setattr(m, "FEW", 5)
    some = [f"https://m.{h}.example.org/en/{i}{i % 7}" for i in range(12) for h in ("thth", "thre", "tion")]
    df = m.find_duplicates(spark.createDataFrame(list(enumerate(some)), "id long, name string"), 0.2)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "levenshtein" not in plan
    got, want = [tuple(r) for r in df.collect()], pairs(some, 0.2)
    assert len(got) == len(want) and set(got) == want


def test_patterns_of_a_cell_go_together(monkeypatch):
    seen, columns = [], distances.Columns
    monkeypatch.setattr(distances, "Columns", lambda p, room: (seen.append(p.n), columns(p, room))[1])
    text, patterns = "https://example.com/77", [f"http://example.org/{k}" for k in range(2500)]
    found = {j: d for _, b, e in distances.near([text], patterns, 0.6) for j, d in zip(b.tolist(), e.tolist(), strict=True)}
    assert seen == [2500]
    assert found == {j: d for j, p in enumerate(patterns) if (d := distance(text, p)) <= 0.6 * max(len(text), len(p))}
