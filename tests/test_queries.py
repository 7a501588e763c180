"""Registered queries over whole tables, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lacewing.functions import text as tx
from lacewing.operators import matching as m
from lacewing.queries import queries
from lacewing.sources import synthetic

from .oracle import pairs, score

TAILS = (" Ltd.", " LIMITED", "  Sanayi ve Tic. A.S.", " 2", "")


@pytest.fixture(scope="module")
def part(spark, tmp_path_factory):
    """Parts with repeated names, of ids on both sides of 300."""
    at = str(tmp_path_factory.mktemp("part"))
    ids = [*range(0, 1001, 50), 298, 299, 301, 302, 303, 1003, 1004]
    rows = [(i, ("small blue ring", "large green bolt", "tiny red washer of steel")[i % 3]) for i in ids]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{at}/part.parquet")
    clean = lambda n: " ".join(n.lower().split())
    return at, {i: clean(n) for i, n in rows}, {i: clean(n + TAILS[i % 5]) for i, n in rows}


@pytest.mark.parametrize(("name", "t"), [("link_brute", 0.2), ("link_indexed", 0.2), ("link_auto", 0.3)])
def test_link_whole(spark, part, name, t):
    at, plain, tailed = part
    got = [tuple(r) for r in queries()[name](spark, at).collect()]
    want = {(i, j, score(a, b)) for i, a in plain.items() for j, b in tailed.items() if score(a, b) <= t}
    assert len(got) == len(want) and set(got) == want and max(j for _, j, _ in want) > 300


@pytest.mark.parametrize(("name", "t"), [("index_query_many", 0.2), ("index_query_wide", 0.6)])
def test_index_whole(spark, part, name, t):
    at, _, tailed = part
    got = [tuple(r) for r in queries()[name](spark, at).collect()]
    stored = [tailed[i] for i in sorted(tailed)]
    want = {(i, k, score(a, b)) for i, a in tailed.items() if i % 100 == 0 for k, b in enumerate(stored) if score(a, b) <= t}
    assert len(got) == len(want) and set(got) == want and {i for i, _, _ in want} == set(range(0, 1001, 100))


def test_sql_gives_the_same_rows(spark):
    """Each query's SQL over the same tables."""
    import duckdb

    from lacewing.oracles import oracle_sql

    at, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("pages", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    tidy = lambda rows, columns: sorted((tuple(round(v, 9) if isinstance(v, float) else v for _, v in sorted(zip(columns, r, strict=True))) for r in rows), key=repr)
    named = queries()
    assert named.keys() - oracle_sql().keys() == {"osa_distance", "synthetic_names", "synthetic_pairs", "messy_copies"}  # below
    for name, sql in oracle_sql().items():
        df, out = named[name](spark, at), con.execute(sql)
        columns = [c[0] for c in out.description]
        assert sorted(columns) == sorted(df.columns), name
        assert tidy(map(tuple, df.collect()), df.columns) == tidy(out.fetchall(), columns), name


def plain_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_osa(spark):
    rng = random.Random(1)
    words = ["", "a", "ca", "abc", "ab", "ba", "şirketi", "sirkteı"] + ["".join(rng.choice("abç") for _ in range(rng.randint(0, 6))) for _ in range(12)]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    assert all(r.d == plain_osa(r.a, r.b) for r in df.select("a", "b", tx.osa_distance(F.col("a"), F.col("b")).alias("d")).collect())


def test_synthetic(spark):
    rows = [tuple(r) for r in synthetic.names(spark, 400).collect()]
    assert rows == [tuple(r) for r in synthetic.names(spark, 400).collect()] and len(rows) == 400
    clean = {e: n for i, n, e in rows if i == e}
    copies = [(i, n, e) for i, n, e in rows if i != e]
    assert 80 < len(copies) < 200 and all(e < i for i, _, e in copies) and sum(n == clean.get(e) for _, n, e in copies) < 20
    assert {tuple(r) for r in m.find_duplicates(spark.createDataFrame([r[:2] for r in rows], "id long, name string"), 0.2).collect()} == pairs([n for _, n, _ in rows], 0.2)
    again = synthetic.variant(spark.createDataFrame(rows[:20], "id long, name string, entity long"), 3).collect()
    assert len(again) == 80 and all(r.name == rows[r.entity][1] for r in again if r.copy == 0)
