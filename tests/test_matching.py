import random

import pytest
from pyspark.sql import functions as F

from lacewing.functions import text as tx
from lacewing.functions.options import Normal
from lacewing.operators import matching as m
from lacewing.operators.index import NameIndex, Settings
from lacewing.plans.budget import max_edits

from .oracle import pairs, score


def frame(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "id long, name string")


def found(df):
    return {tuple(r) for r in df.collect()}


FIVE = ["Acme Ltd", "ACME  ltd", "Acme Ltd.", "Globex", "Ltd Acme"]


@pytest.mark.parametrize("method", ["auto", "indexed", "brute"])
def test_goldens(spark, method):
    assert found(m.find_duplicates(frame(spark, FIVE), 0.2, method=method)) == {(0, 1, 0.0), (0, 2, 1 / 9), (1, 2, 1 / 9)}
    assert found(m.find_duplicates(frame(spark, ["", "  "]), 0.2, method=method)) == {(0, 1, 0.0)}
    assert found(m.link(frame(spark, [""]), frame(spark, ["", ""]), 0.0, method=method)) == {(0, 0, 0.0), (0, 1, 0.0)}
    assert found(m.link(frame(spark, ["Acme Ltd", "Globex"]), frame(spark, ["GLOBEX", "Initech", "acme ltd."]), 0.2, method=method)) == {(0, 2, 1 / 9), (1, 0, 0.0)}
    assert found(m.find_duplicates(frame(spark, []), 0.2, method=method)) == set()


def test_clusters_and_options(spark):
    assert found(m.groups(m.cluster(frame(spark, FIVE), 0.2, token_sort=True)).select(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))) == {("0,1,2,4",)}
    assert found(m.find_duplicates(frame(spark, ["Acme Ltd", "Acme Limited"]), 0.0, strip_suffixes=True)) == {(0, 1, 0.0)}
    precise = {"numbers_must_match": True, "word_threshold": 0.34}
    assert found(m.find_duplicates(frame(spark, ["Neo Portföy Birinci", "Neo Portföy İkinci", "Pera 2", "Pera 3"]), 0.2, turkish=True, **precise)) == set()
    assert found(m.find_duplicates(frame(spark, ["Başaranlar İnşaat Malzemeleri", "BSAARANLAR INSAAT MALZEMELERI"]), 0.2, turkish=True, strip_suffixes=True, **precise)) == {(0, 1, 2 / 29)}
    assert found(m.cluster(frame(spark, ["abcdefghij", "abcdefghix", "abcdefghxx", "zzzz"]), 0.1)) == {(0, 0), (0, 1), (0, 2)}


def test_same_as_plain_matcher(spark, tmp_path):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcABCçÇşŞ ") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    names += [n[:3] + "x" + n[4:] for n in names[:30]]
    for t in (0.0, 0.1, 0.25, 1 / 3, 0.49, 0.6, 1.0):
        want = pairs(names, t)
        for method in ("indexed", "brute"):
            assert found(m.find_duplicates(frame(spark, names), t, method=method)) == want, (t, method)
    index = NameIndex.build(frame(spark, names[:50]), str(tmp_path / "index"), Settings(0.25))
    assert index.add(frame(spark, names[50:])) == 50
    linked = found(m.link(frame(spark, names), frame(spark, names), 0.25))
    assert found(NameIndex.open(spark, index.path).hits(frame(spark, names))) == linked
    assert len(index) == len(names) and len(found(index.names())) == len(names)


def test_errors(spark):
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(ValueError):
            m.find_duplicates(frame(spark, FIVE), bad)
        with pytest.raises(ValueError):
            Settings(bad)
    with pytest.raises(ValueError):
        m.find_duplicates(frame(spark, FIVE), method="fast")
    with pytest.raises(Exception, match="null"):
        m.find_duplicates(spark.createDataFrame([(0, None)], "id long, name string")).collect()


def test_text(spark):
    cases = {"san.tic.a.s.": "san|tic|as", "a.b.c": "abc", "..": "", "tic.ltd.": "tic|ltd"}
    rows = spark.createDataFrame([(k,) for k in cases], "w string").select("w", F.array_join(tx.suffix_pieces(F.col("w")), "|"))
    assert dict(map(tuple, rows.collect())) == cases
    names = {"Limited": "limited", "ABC Tekstil San. ve Tic. A.Ş.": "abc tekstil", "Acme, Inc.": "acme,", "": ""}
    rows = spark.createDataFrame([(k,) for k in names], "n string").select("n", tx.normalize(F.col("n"), Normal(strip_suffixes=True, turkish=True)))
    assert dict(map(tuple, rows.collect())) == names
    for n in range(80):
        for t in (0, 0.05, 0.2, 1 / 3, 0.5, 1):
            k = max_edits(n, t)
            assert not n or (k / n <= t and (k == n or (k + 1) / n > t))


def test_cli(spark, tmp_path):
    from lacewing.cli import main

    (tmp_path / "a.csv").write_text("id,name\n1,Acme Ltd\n2,ACME  ltd\n3,Globex\n4,Acme Ltd.\n", encoding="utf-8-sig")
    assert main([str(tmp_path / "a.csv"), "--column", "name", "-o", str(tmp_path / "o.csv")], spark) == 0
    assert (tmp_path / "o.csv").read_text().splitlines() == ["row_a,row_b,name_a,name_b,score", "1,2,Acme Ltd,ACME  ltd,0.0000", "1,4,Acme Ltd,Acme Ltd.,0.1111", "2,4,ACME  ltd,Acme Ltd.,0.1111"]
    assert main([str(tmp_path / "a.csv"), "--column", "name", "--groups", "-o", str(tmp_path / "g.csv")], spark) == 0
    assert (tmp_path / "g.csv").read_text().splitlines() == ["group,row,name", "1,1,Acme Ltd", "1,2,ACME  ltd", "1,4,Acme Ltd."]


def test_stats(spark):
    row = m.stats(frame(spark, FIVE), 0.2).first()
    assert (row.found, row.all_pairs) == (3, 10) and 3 <= row.verified <= 10


def test_cli_link_version_stdout(spark, tmp_path, capsys):
    from lacewing.cli import main

    (tmp_path / "l.csv").write_text('name\nAcme Ltd\nGlobex\n"Çelik, ""A""\nŞti"\n', encoding="utf-8")
    (tmp_path / "r.csv").write_text('customer\nGLOBEX\nInitech\nacme ltd.\n"çelik, ""a"" şti"\n', encoding="utf-8")
    assert main([str(tmp_path / "l.csv"), "--column", "name", "--link", str(tmp_path / "r.csv"), "--link-column", "customer"], spark) == 0
    said = capsys.readouterr()
    assert said.out.splitlines() == ["row,other_row,name,other_name,score", "1,3,Acme Ltd,acme ltd.,0.1111", "2,1,Globex,GLOBEX,0.0000", '3,4,"Çelik, ""A""', 'Şti","çelik, ""a"" şti",0.0000']
    assert said.err.startswith("3 names, 3 matches against 4 rows, ")
    with pytest.raises(SystemExit) as done:
        main(["--version"], spark)
    assert done.value.code == 0 and "lacewing" in capsys.readouterr().out


@pytest.mark.parametrize("t", [0.2, 0.6])
def test_query_rows_are_those_of_query_many(spark, tmp_path, t):
    """Repeated rows, null and empty names included; a query without hits has a row of nulls."""
    index = NameIndex.build(frame(spark, ["ring", "rings", "ring", "", "wheel"]), str(tmp_path / "index"), Settings(t))
    asked = spark.createDataFrame([(1, "ring"), (2, "rinks"), (2, "rinks"), (3, None), (4, ""), (5, "zzzzzzzzzz")], "id long, name string")
    many = index.query_many(asked).select("query_id", F.explode_outer("hits").alias("h")).select("query_id", "h.id", "h.score")
    key = lambda r: (r.query_id, -1 if r.id is None else r.id)
    got = sorted(map(tuple, sorted(index.query_rows(asked).collect(), key=key)), key=str)
    assert got == sorted(map(tuple, many.collect()), key=str) and (5, None, None) in got and (3, None, None) in got


def test_query_many_keeps_all_queries(spark, tmp_path):
    index = NameIndex.build(frame(spark, FIVE), str(tmp_path / "index"), Settings(0.2))
    asked = spark.createDataFrame([(7, "acme ltd"), (8, "nothing like it"), (9, "acme ltd"), (10, "")], "id long, name string")
    got = {r.query_id: [(h.id, h.score) for h in r.hits] for r in index.query_many(asked).collect()}
    assert got == {7: [(0, 0.0), (1, 0.0), (2, 1 / 9)], 8: [], 9: [(0, 0.0), (1, 0.0), (2, 1 / 9)], 10: []}
    text = index.export_json()
    again = NameIndex.import_json(spark, text, str(tmp_path / "again"))
    assert again.export_json() == text and found(again.names()) == set(enumerate(FIVE))


def test_stream_replay_adds_once(spark, tmp_path):
    from lacewing.streaming.lookup import match_then_add

    index, seen = NameIndex.build(frame(spark, FIVE), str(tmp_path / "index"), Settings(0.2)), []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "name": "globex"}\n')
    stream = spark.readStream.schema("id long, name string").json(str(tmp_path / "in"))
    for k in range(2):  # the second run starts from a checkpoint folder of its own, so it replays batch 0
        match_then_add(stream, index, lambda hits, n: seen.append(found(hits)), str(tmp_path / f"checkpoint{k}")).processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        index = NameIndex.open(spark, index.path)
    assert seen == [{(1, 3, 0.0)}] * 2 and len(index) == 6


def test_sketch_bounds_the_distance(spark):
    from .oracle import distance

    rng = random.Random(9)
    words = ["", "aaaaaaaaaa", "aaaaaaa"] + ["".join(rng.choice("abcçŞ 0zy") for _ in range(rng.randint(0, 20))) for _ in range(30)]
    rows = {r.w: [r[k] for k in tx.SKETCH] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", *tx.sketch(F.col("w"))).collect()}
    count = lambda w: [sum(ord(c) % 30 == k for c in w) for k in range(30)]
    for a in words:
        for b in words:
            differ = sum(bin(x ^ y).count("1") for x, y in zip(rows[a], rows[b], strict=True))
            assert differ == sum(abs(min(6, x) - min(6, y)) for x, y in zip(count(a), count(b), strict=True)) <= 2 * distance(a, b)


def test_rows_of_a_string_go_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 2)
    names = FIVE * 3 + [""] * 5
    got = [tuple(r) for r in m.find_duplicates(frame(spark, names), 0.2).collect()]
    want = pairs(names, 0.2)
    assert len(got) == len(want) and set(got) == want
    both = {(i, j, s) for a, b, s in want for i, j in ((a, b), (b, a))} | {(i, i, 0.0) for i in range(len(names))}
    linked = [tuple(r) for r in m.link(frame(spark, names), frame(spark, names), 0.2).collect()]
    assert len(linked) == len(both) and set(linked) == both
    index = NameIndex.build(frame(spark, names), str(tmp_path / "index"), Settings(0.2))
    segments = spark.read.parquet(f"{index.path}/segments/*")
    assert segments.select("id").distinct().count() == 4  # one row of each of acme ltd, acme ltd., globex and ltd acme
    assert found(index.hits(frame(spark, names))) == both


def test_sketches_come_before_distances(spark):
    strings = spark.createDataFrame([(k, n) for k, n in enumerate(FIVE)], "cid long, norm string")
    ok = F.levenshtein("s_norm", "r_norm") >= F.lit(0)  # a rule
    plan = m.brute_pairs(strings, 0.2, ok)._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert 0 < join.index("bit_count") < join.index("levenshtein")


def test_equal_rows_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 2)
    sizes = m.find_duplicates(frame(spark, ["acme"] * 40), 0.1).rdd.glom().map(len).collect()
    assert sum(sizes) == 40 * 39 // 2 and sum(n > 0 for n in sizes) > 3


def test_rows_of_few_strings_are_made_by_many_tasks(spark):
    """many rows of few strings, small blocks over all cores."""
    names = spark.range(1000).selectExpr("id", "concat('name ', id % 20) AS name").coalesce(1)
    one = names.select("id", F.lit("name").alias("norm"))
    assert m.blocks(one, m.numbered_strings(one)).agg(F.max(F.size("ids"))).first()[0] < 500
    found = m.link(names, names, 0.2, method="indexed")
    assert found.where("score > 0").select(F.spark_partition_id().alias("task")).distinct().count() > 2
    strings = [f"name {k}" for k in range(20)]
    near = sum(score(a, b) <= 0.2 for a in strings for b in strings)
    assert found.count() == 2500 * near == found.distinct().count()
