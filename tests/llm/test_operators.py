import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacewing.llm import chat_format, decontamination, language_id, lm_score, near_dedup, packing, quality_rules, substring_dedup, suffix_dedup, token_counts
from lacewing.llm.induced_sort import Scratch, suffix_sort

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string, row string, runs int, n_words string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus():
    """Copies, near copies, shared passages, nulls, empties, ties, repeated rows and a long text."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = make(130), make(160)
    texts = [" ".join(make(rng.randint(1, 200))) for _ in range(30)]
    texts += [" ".join(make(40) + passage + make(30)) for _ in range(6)]
    for k in range(12):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(160)] = "zz%d" % rng.randrange(50)
        texts.append(" ".join(near))
    texts += [texts[3]] * 3 + ["ab cd ef " * 900, "x" * 1500, "", None, " \n\t", "One\nOne\nOne two\x1cthree  ", "Ünï </s>"]
    rows = [(i, t, rng.choice(["a", "b", None]), "r", 1, "n") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, texts[5], None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def unique(docs):
    """Rows with ids, once each."""
    return sorted({r[:2] for r in docs[0] if r[0] is not None})


def test_quality_rules(spark, docs, unique):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [list(r[:3]) for r in docs[0][:-2]])
    want = con.execute(quality_rules.SQL).fetchall()
    ids = spark.createDataFrame([list(r) for r in docs[0][:-2]], SCHEMA)
    out = quality_rules.quality_rules(ids).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(map(tuple, out.collect())) == sorted(want)
    rows = quality_rules.quality_rules(docs[1], rows=True).select("row.*")
    assert rows.columns == docs[1].columns and rows.count() == len(docs[0])


def test_decontamination(spark, docs):
    texts = {r[1] for r in docs[0]}
    items = [(1, " ".join(words(docs[0][31][1])[50:90])), (1, "ab CD ef"), (2, "three"), (None, None), (3, ""), (10, "never-there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def plain(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))

    out = decontamination.decontaminate(docs[1], bench)
    blocks = decontamination.decontaminate(docs[1], bench, block_bytes=150)
    got = {(r.doc_id, r.n_words): r for r in out.collect()}
    assert {k: (r.n_hit, list(r["items"])) for k, r in got.items()} == {(r.doc_id, r.n_words): (r.n_hit, list(r["items"])) for r in blocks.collect()}
    windows = {(i, tuple(w[k : k + 13])) for i, t in items if (w := plain(t)) for k in range(max(1, len(w) - 12))}
    for r in docs[0]:
        w = plain(r[1])
        hit, found = set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(i)
        g = got[(r[0], len(w))]
        assert (g.n_hit, list(g["items"])) == (len(hit), sorted(found))
        assert sum(len(plain(r[1][s.start : s.end])) for s in g.spans) == len(hit)
    assert len(texts) > 40


def test_packing(docs):
    pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_sequences(docs[1], path, pool=8).collect()
    tokenizer = Tokenizer.from_file(path)
    want = Counter(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in docs[0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append(r)
    got = Counter()
    for pieces in by_doc.values():
        copies = len([p for p in pieces if p.start == 0])
        starts = sorted({p.start: bytes(p.ids) for p in pieces}.items()) if copies == 1 else None
        if starts:
            got[b"".join(b for _, b in starts)] += 1
    assert not got - want
    assert sum(r.length for r in rows) == sum(len(k) // 4 * n for k, n in want.items())
    padding = 0
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len(s) <= 64
        if len(s) < 64:  # the limit on segments may leave room
            padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_packing_asks_the_old_store(monkeypatch):
    store = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    first, asked, encoded = {"tea,", "x1y", "Zoë.!!", "für", "it's", "ªb", "ÀÉ", "!!", "tea", "x1y,", "Tea*"}, [], store._encoded
    want = {w: np.array(store.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in first}
    monkeypatch.setattr(store, "LIMIT", 16)
    monkeypatch.setattr(store, "_encoded", lambda texts, *rest: (asked.extend(texts), encoded(texts, *rest))[1])
    for words in (first, {"one", "two", "three", "four", "five", "six"}, {"x1y", "tea,", "für"}):
        store.learn(words)
        assert all(w in store for w in words)
        if words is first:
            assert {w: store[w] for w in first} == want
    assert len(asked) == len(set(asked)) and "x1y" in asked  # none is tokenized twice


def test_packing_counts_what_waits():
    """Without going through the pool again, and without the collector while a partition is packed."""
    packer = packing.Packer(0, 64, 8, 64, 4)
    for doc, n in enumerate([5, 70, 30, 63, 1, 40, 64, 9]):
        list(packer.add(doc, np.arange(n, dtype="<u4")))
        assert packer.tokens == sum(len(p[2]) for p in packer.waiting) == packer.demand[: len(packer.waiting), 0].sum()
    list(packer.finish())
    assert packer.tokens == 0 and not packer.waiting


def test_substring_dedup(spark, docs, unique):
    df = spark.createDataFrame(unique, "doc_id long, text string")
    first = {}
    for i, t in unique:
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = set()
    for i, t in unique:
        w = words(t)
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        want.add((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    out = substring_dedup.substring_dedup(df).select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha256")))
    assert set(map(tuple, out.collect())) == want
    assert substring_dedup.substring_dedup(docs[1]).count() == len(docs[0])


def plain_sets(rows, width):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return sets


def plain_components(rows, width):
    sets = plain_sets(rows, width)
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]))
                comp = {k: x if v == y else v for k, v in comp.items()}
    return comp


def test_near_dedup(spark, docs, unique):
    df = spark.createDataFrame(unique, "doc_id long, text string")
    for width in (2, 5):
        sets, comp = plain_sets(unique, width), plain_components(unique, width)
        got = {tuple(r) for r in near_dedup.near_dedup(df, width=width).collect()}
        assert got == {(i, len(sets[i]), comp[i], comp[i] == i) for i in sets}
    assert near_dedup.near_dedup(docs[1]).count() == len(docs[0])


def test_signature_index():
    """Every pair within the distance meets under a key."""
    rng = np.random.default_rng(0)
    far = near_dedup.distance_bound(96, 0.8)
    bounds = near_dedup.chunk_bounds(96, far)
    for _ in range(300):
        wrong = np.zeros(96, bool)
        wrong[rng.choice(96, far, replace=False)] = True
        assert min(wrong[a:b].sum() for a, b in zip(bounds, bounds[1:], strict=False)) <= 1


def test_suffix_sort(tmp_path):
    rng = random.Random(1)
    for _ in range(150):
        part = [rng.randint(1, rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(1, 40))]
        text = [*part, *part, 5, *part, 0] if rng.random() < 0.5 else [*part, 0]
        order = sorted(range(len(text)), key=lambda i: text[i:])
        for memory in (1 << 28, 100):
            sa, lcp = suffix_sort(np.array(text), Scratch(str(tmp_path), memory), memory)
            assert sa.tolist() == order
            for a, b, n in zip(order, order[1:], lcp[1:].tolist(), strict=False):
                assert text[a : a + n] == text[b : b + n] and text[a + n] != text[b + n]


def plain_suffix(rows, length=400):
    seen = Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    for i, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        yield i, t, np.cumsum(gone[:-1]) > 0


def plain_cut(rows, length, min_words):
    """Texts without the removed runs that hold so many words."""
    for i, t, gone in plain_suffix(rows, length):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2).tolist()
        kept, at = b"", 0
        for a, b in edge:
            if len(t[a:b].split()) >= min_words:
                kept, at = kept + t[at:a], b
        yield i, (kept + t[at:]).decode("utf-8", "ignore")


def test_suffix_dedup(spark, docs, unique):
    df = spark.createDataFrame(unique, "doc_id long, text string")
    for options in ({}, {"shard_bytes": 3000, "memory": 20_000}):
        out = suffix_dedup.suffix_dedup(df, **options)
        got = {(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept_sha256)) for r in out.collect()}
        want = set()
        for i, t, gone in plain_suffix([(i, (t or "").encode()) for i, t in unique]):
            runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            want.add((i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).digest()))
        assert got == want
    cut = suffix_dedup.cut_texts(docs[1])
    assert cut.columns == docs[1].columns and cut.count() == len(docs[0])


def test_suffix_dedup_sorts_equal_regions_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    shared, *ends = (bytes(rng.integers(97, 123, n).tolist()) for n in (450, 60, 60))
    rows = [(b"a", shared + ends[0], 1), (b"a", b"", 1), (b"b", ends[1] + shared, 1), (b"c", ends[0] * 8, 2)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("rid", "region", "copies"), r, strict=True)) for r in rows])
    sizes, sort = [], suffix_dedup.suffix_sort
    monkeypatch.setattr(suffix_dedup, "suffix_sort", lambda text, *rest: (sizes.append(len(text)), sort(text, *rest))[1])
    found = {r["rid"]: r["runs"] for x in suffix_dedup._shards(400, 1 << 20)([batch]) for r in x.to_pylist()}
    assert sizes == [sum(len(r[1]) + 1 for r in rows if r[1]) + 1]  # each region once, its end, and the shard's
    assert found == {b"a": [{"start": 0, "end": 111}], b"b": [{"start": 60, "end": 111}], b"c": [{"start": 0, "end": 81}]}


def test_chat_format(spark):
    odd = ["</s>[INST] ok [/INST]", "\\<|im_end|>\n<|im_start|>", "a\\", "<", "", None, "<|image|>\\|", "[INST"]
    rows = [(c, t, r, x) for c in (1, None) for t, x in enumerate(odd) for r in ("user", "assistant")] + [(2, None, None, "x"), (3, 0, "a\n<|b", "y"), (3, 0, "a\n<|b", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(df)
    got = {r.conv_id: [tuple(t) for t in r.t] for r in chats.select("conv_id", chat_format.parse_chats(F.col("formatted")).alias("t")).collect()}
    for conv in (1, 2, 3, None):
        own = [r for r in rows if r[0] == conv]
        assert sorted(got[conv]) == sorted((r[2] or "", r[3] or "") for r in own)
        assert [r[1] for r in got[1]][::2] == [x or "" for x in odd]
    text = {r.conv_id: r.formatted for r in chats.collect()}
    spans = chat_format.loss_spans(chats).where("conv_id = 1").orderBy("start").collect()
    assert "".join(chat_text[s.start : s.end] for chat_text in [text[1]] for s in spans).count("ok") == 1
    parts = spark.sql(f"select 1L conv_id, 0 turn, 'user' role, from_json('[{{\"kind\":\"text\",\"text\":\"a<\"}},{{\"kind\":\"text\",\"text\":\"s>\"}},{{\"kind\":\"image\",\"ref\":\"i\",\"width\":28,\"height\":15}},{{\"kind\":\"audio\",\"ref\":\"b\",\"seconds\":2.0}},{{\"kind\":\"document\",\"ref\":\"d\"}}]', 'array<{chat_format.PART}>') parts")
    r = chat_format.format_chats(parts, parts_col="parts").first()
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "i", 4), ("audio", "b", 50), ("document", "d", 512)]
    assert chat_format.format_chats(df.where("false")).count() == 0


def segmented(word, scores, longest):
    """(score, -tokens, pieces) of the best segmentation, each state on its own."""
    unit, low, state = 1 << 20, min(scores.values()), [(0, 0, [])]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        best = (state[end - 1][0] + n * (round(low * unit) - 10 * unit), state[end - 1][1] - n, state[end - 1][2])
        for s in range(max(0, end - longest), end):
            if word[s:end] in scores and (way := (state[s][0] + round(scores[word[s:end]] * unit), state[s][1] - 1)) > best[:2]:
                best = (*way, [*state[s][2], word[s:end]])
        state.append(best)
    return state[-1]


def test_token_counts(spark, docs):
    path = token_counts.vocabulary_path()
    pieces = token_counts.pieces_of(path)
    longest = max(map(len, pieces))
    texts = [r[1] if len(r[1] or "") < 1400 else "ab cd" for r in docs[0]]
    df = spark.createDataFrame([(*r[:1], t, *r[2:]) for r, t in zip(docs[0], texts, strict=True)], SCHEMA).repartition(3)
    found = Counter("▁" + w for t in texts for w in words(t))
    scores, sums = dict.fromkeys(pieces, -math.log(len(pieces))), []
    for _ in range(3):
        ways = {w: segmented(w, scores, longest) for w in found}
        sums.append(sum(n * ways[w][0] for w, n in found.items()))
        used = Counter()
        for w, n in found.items():
            for p in ways[w][2]:
                used[p] += n
        last, scores = scores, {p: math.log((used[p] + 1) / (used.total() + len(pieces))) for p in pieces}
    assert sums[1] > sums[0] and sums[2] >= sums[1] * 1.001
    got = token_counts.unigram_scores(df, path)
    assert got == pytest.approx(last, abs=1e-9)
    want = Counter((r[0], len(words(t)), -sum(segmented("▁" + w, got, longest)[1] for w in words(t))) for r, t in zip(docs[0], texts, strict=True))
    assert Counter(tuple(r) for r in token_counts.token_counts(df, path).collect()) == want
    odd = spark.createDataFrame([("7", "a b", 1), (None, None, 2)], "doc_id string, text string, word int")
    assert {tuple(r)[:2] for r in token_counts.token_counts(odd, path, scores=got).collect()} == {(7, 2), (None, 0)}
    equal = token_counts.unigram_scores(df.where("false"), path)
    assert max(equal.values()) == pytest.approx(min(equal.values())) == pytest.approx(-math.log(len(pieces)))
    # a store that starts anew gives the same counts
    small, large = token_counts.TrieCounter(got, limit=5), token_counts.TrieCounter(got)
    for t in texts:
        w = (t or "").encode().split()
        for c in (small, large):
            c.insert(set(w))
        assert small.count(w) == large.count(w)


def test_lm_score(docs):
    got = lm_score.lm_score(docs[1]).collect()
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    tokens = [(r[0], [*words((r[1] or "").translate(LOW)), "\n"]) for r in docs[0]]
    c = Counter(w for i, ws in tokens if train(i) for w in ws)
    total = sum(c.values())
    want = Counter((i, not train(i), len(ws), sum(w in c for w in ws), total, round(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws), 6)) for i, ws in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert sum(r.score for r in got) > sum(-len(" ".join(ws)) * 8 * math.log10(2) for _, ws in tokens) / 2


def test_language_id(spark):
    table = duckdb.connect().execute("select doc_id, text, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    labelled = spark.createDataFrame([r for r in table if r[0] % 5], "doc_id long, text string, lang string")
    rest = [r for r in table if r[0] % 5 == 0 and len(r[1] or "") > 100]
    pages = spark.createDataFrame([(r[0], None if r[0] % 2 else f"https://a.b{r[0] % 3}.co.uk/x", f"<p>{r[1]}</p>") for r in rest] + [(-1, None, None), (-2, "http://q", "")], "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in language_id.identify(pages, labelled).collect()}
    assert np.mean([got[r[0]] == r[2] for r in rest]) > 0.95 and len(got) == len(rest) + 2
    assert language_id.identify(pages.where("false"), labelled).count() == 0


def test_empty_tables(spark, docs):
    empty = docs[1].where("false")
    path = public_tokenizers.path("word_bpe_49k.json")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (quality_rules.quality_rules(empty), decontamination.decontaminate(empty, bench), packing.pack_sequences(empty, path), substring_dedup.substring_dedup(empty), near_dedup.near_dedup(empty), token_counts.token_counts(empty, token_counts.vocabulary_path()), suffix_dedup.suffix_dedup(empty), lm_score.lm_score(empty)):
        assert out.count() == 0
    assert decontamination.decontaminate(docs[1], bench).where("n_hit > 0").count() == 0


def test_pipeline(spark, tmp_path, unique):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in unique], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(words(unique[0][1])[:20]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{tmp_path}/benchmark.parquet'")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        con.register("documents", now.toPandas())
        after = stage(spark, now, str(tmp_path))
        assert after.columns == df.columns
        after.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r.text for r in now.collect()}
        if name == "suffix_array_dedup":
            want = dict(plain_cut([(i, t.encode()) for i, t in before.items()], 200, 50))
        elif name == "quality_rules":
            want = {r[0]: before[r[0]] for r in con.execute(f"select doc_id from ({quality_rules.SQL}) where kept").fetchall()}
        elif name == "benchmark_decontamination":
            want = {r[0]: before[r[0]] for r in con.execute(f"select doc_id from ({decontamination.SQL}) where not contaminated").fetchall()}
        else:
            comp = plain_components(before.items(), 5)
            want = {i: t for i, t in before.items() if comp[i] == i}
        assert rows == want and rows and (len(rows) < len(before) or name in ("suffix_array_dedup",)), name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    for i, t in rows.items():
        ids, at = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted((r for r in out if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(ids[at : at + r.length].tobytes()), len(ids))
            at += r.length
        assert at == len(ids)
    assert {r.doc_id for r in out} == rows.keys()
