"""Operators that SQL cannot express, against plain versions of their methods."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lacewing.llm import language_id, lm_score, packing

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_packing_by_loss(spark):
    """Prompts bear no loss; the limit on loss-bearing tokens ends sequences before the limit on tokens does."""
    rng = random.Random(2)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = []
    for i in range(60):
        prompt, said = " ".join(["why"] * rng.randint(0, 40)), " ".join(["so"] * rng.randint(1, 30))
        rows.append((i, f"{prompt} {said}".strip(), len(prompt)))
    rows += [(60, "so " * 300, None), (61, None, 5), (62, "why " * 300 + "so", 1199), (63, "abcso", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, asked long").repartition(2)
    out = packing.pack_sequences(df, path, tokens=64, loss=24, pool=8, prompt_col="asked").collect()
    store, by_doc, by_sequence = packing.WordTokens(path), defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text, asked in rows:
        ids = next(iter(store.of_all([text], 1)))
        prompt = sum(1 for w in (text or "").split() if w == "why") if i != 63 else len(ids) - 1
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == ids.tobytes()
        for p in pieces:
            assert p.loss_tokens == sum(k >= prompt for k in range(p.start, p.start + p.length)), (i, asked)
    assert all(sum(r.length for r in s) <= 64 and sum(r.loss_tokens for r in s) <= 24 for s in by_sequence.values())
    assert any(sum(r.loss_tokens for r in s) == 24 and sum(r.length for r in s) < 64 for s in by_sequence.values())


def plain_coder(items, skip, weight, left_out=False):
    """Counts by (context, node) as texts, and the probability of each item under them, with a mixer of given weights."""
    counts = defaultdict(lambda: [0.0, 0.0])

    def steps(i):
        item = items[i]
        for at in range(skip[i], len(item)):
            for d in range(8):
                node = (1 << d) | (item[at] >> (8 - d))
                yield [(k, item[max(0, at - k) : at], node) for k in lm_score.ORDERS], item[at] >> (7 - d) & 1

    for i in range(len(items)):
        for contexts, bit in steps(i):
            for c in contexts:
                counts[c][bit] += weight[i]
    out = []
    for i in range(len(items)):
        total = 0.0
        for contexts, bit in steps(i):
            n = [[max(0, counts[c][b] - (left_out and b == bit)) for b in (0, 1)] for c in contexts]
            t = 0.25 * sum(math.log((n1 + 0.05) / (n0 + 0.05)) for n0, n1 in n) + 0.25 * 0.3
            p = min(1 - 1e-6, max(1e-6, 1 / (1 + math.exp(-t))))
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


class Held:
    def __init__(self, value):
        self.value = value


def test_coder_against_plain():
    rng = random.Random(4)
    items = [bytes(rng.choice(b"abcd\xc3") for _ in range(rng.randint(2, 9))) for _ in range(40)]
    skip, weight = np.ones(len(items), np.int64), np.array([rng.randint(1, 5) for _ in items], float)
    bits, tables = lm_score.Coded(items, skip), np.zeros((2, lm_score.STARTS[-1]), np.float32)
    for b in (0, 1):
        for slots in bits.slots:
            np.add.at(tables[b], slots[bits.bit == b], weight[bits.of][bits.bit == b])
    model = lm_score.Model(Held(tables), Held(lm_score.Mixer()))
    assert np.allclose(model.cost(items, skip), plain_coder(items, skip, weight), atol=1e-3)
    x, gate = lm_score.inputs(bits, tables, True)
    p = lm_score.Mixer().probability(x, gate)
    got = np.bincount(bits.of, np.log10(np.where(bits.bit == 1, p, 1 - p)), len(items))
    assert np.allclose(got, plain_coder(items, skip, weight, True), atol=1e-3)
    long = [bytes(rng.choice(b"abcd") for _ in range(3 * lm_score.PIECE + 7))]  # in pieces, and at once
    whole = lm_score.Coded(long, np.ones(1, np.int64))
    p = lm_score.Mixer().probability(*model.inputs(whole))
    assert np.allclose(model.cost(long, np.ones(1, np.int64)), np.log10(np.where(whole.bit == 1, p, 1 - p)).sum(), rtol=1e-4)


def test_probabilities_add_up():
    """Whatever the model, the bytes after a context have probabilities that add up to one."""
    rng = np.random.default_rng(1)
    tables = rng.integers(0, 9, (2, lm_score.STARTS[-1])).astype(np.float32)
    model = lm_score.Model(Held(tables), Held(lm_score.Mixer()))
    cost = model.cost([b"ab" + bytes((k,)) for k in range(256)], np.full(256, 2))
    assert abs((10.0**cost).sum() - 1) < 1e-4


def test_score_reads_in_order(spark):
    """Score is that of a plain walk over the tokens, and changes with their order; held-out texts gain on the base."""
    rng = random.Random(6)
    kinds = [["the", "of", "and"], ["der", "und", "die"], ["le", "et", "les"]]
    vocabulary = [["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)] for _ in kinds]
    text = lambda k: " ".join(w for _ in range(60) for w in (rng.choice(kinds[k]), rng.choice(vocabulary[k])))
    rows = [(i, text(i % 3)) for i in range(400)]
    mixed_up = " ".join(w for pair in zip(*(text(k).split() for k in range(3)), strict=True) for w in pair)
    rows += [(1000, mixed_up), (1001, None)]
    got = {r.doc_id: r for r in lm_score.lm_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = [got[i] for i, _ in rows[:400] if got[i].held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    per_token = sum(r.score for r in held) / sum(r.n_tokens for r in held)
    assert got[1000].score / got[1000].n_tokens < per_token  # words of three kinds in turn cost more than those of one
    for i, t in rows:
        r = got[i]
        assert r.n_bytes == sum(len(w) + 1 for w in (t or "").split()) + 1
        assert math.isclose(r.bits_per_byte, -r.score / math.log10(2) / r.n_bytes)


def test_numbers_of_known_words():
    """The words of a class have numbers in a row over all buckets, told in as many bytes as the class takes."""
    rng = np.random.default_rng(3)
    cls = {b: rng.choice([1, 33, 34], 400, p=[0.01, 0.29, 0.7]) for b in (0, 2, 5)}
    numbers = lm_score.Numbers({b: np.bincount(c, minlength=256) for b, c in cls.items()})
    items, skip = [], []
    for b, c in cls.items():
        own, cut = numbers.items(np.full(len(c), 4), c, numbers.of(b, c))
        items += own
        skip += cut.tolist()
    assert set(skip) == {2} and len(set(items)) == len(items) == 1200
    for k in (1, 33, 34):
        own = sorted(int.from_bytes(i[2:], "big") for i in items if i[1] == k)
        n = sum(int((c == k).sum()) for c in cls.values())
        assert own == list(range(n)) and {len(i) for i in items if i[1] == k} == {3 if n <= 256 else 4}


def test_known_words_are_mixed(spark):
    """Of two known words of one class, equally often seen, the one that texts of a kind hold costs less in that kind."""
    rng = random.Random(8)
    kinds = [["the", "of", "and"], ["der", "und", "die"]]
    vocabulary = [["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)] for _ in kinds]
    text = lambda k: " ".join(w for _ in range(60) for w in (rng.choice(kinds[k]), rng.choice(vocabulary[k])))
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2][:400]
    rows = [[i, text(n % 2)] for n, i in enumerate(ids)]
    for n in range(32):  # both stand 16 times, and mostly after "the"
        rows[n][1] += " der both" if n < 16 and n % 2 else " the both" if n < 16 else " the one"
    rows[32][1] += " the both"
    rows[1][1] = rows[1][1].removesuffix(" der both")
    apart = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows += [[i, " ".join(["der", w] * 4)] for i, w in zip(apart, ("both", "one"), strict=True)]
    got = {r.doc_id: r for r in lm_score.lm_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    both, one = (got[i] for i in apart)
    assert both.held_out and both.n_known == both.n_tokens == one.n_known and both.base_score == one.base_score
    assert both.score > one.score + 0.5


def test_kinds_follow_neighbours():
    """Frequent words that follow each other are of one kind."""
    links = np.full((9, 9), 1.0)
    for k in range(3):
        links[3 * k : 3 * k + 3, 3 * k : 3 * k + 3] = 50
    assert lm_score.grouped(links, 3).tolist() == [1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_language_against_plain(spark):
    """Every step of the fusion in plain Python."""
    rng = random.Random(8)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n))
    labelled = [(say(x, 60), lang) for lang, x in (("aa", "abcd"), ("bb", "cdef"), ("cc", "efgh")) for _ in range(5)] + [(None, "aa"), ("abc", None)]
    pages = [(i, rng.choice([None, "", f"http://h{i % 3}.x.org/p", f"https://www.y.co.uk:80/{i}", f"HTTP://z{i % 2}.example.cc"]), rng.choice([None, "", f"<html lang=bb><p>{say('abcdef', 5)}</p>", f'<html lang="xx">{say("efgh", 2)}', f"<b>{say('abcd', 30)}</b><script>efgh</script>"])) for i in range(60)]
    pages += [pages[3], (None, None, None)]  # a repeated row and a null id
    got = language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(labelled, "text string, lang string")).collect()
    langs, model = ["aa", "bb", "cc"], {}
    for lang in langs:
        n = Counter(int(b) for t, x in labelled if x == lang and t for b in language_id.trigrams(t.encode()))
        total = sum(n.values()) + 0.5 * language_id.BUCKETS
        model[lang] = lambda b, n=n, total=total: math.log((n[b] + 0.5) / total)
    facts = []
    for page, url, markup in pages:
        at = [int(b) for b in language_id.trigrams(language_id.visible_text(markup).encode())]
        said = [sum(model[x](b) for b in at) / len(at) * min(len(at), 40.0) if at else 0.0 for x in langs]
        vote = said.index(max(said)) if min(said) != max(said) else None
        host = url.lower().split("//")[1].split("/")[0].split(":")[0] if url and "//" in url else None
        domain = host and ".".join(host.split(".")[-(3 if host.endswith(".co.uk") else 2) :])
        declared = next((x for x in ("bb", "xx") if markup and "lang=" in markup and x in markup.split(">")[0]), None)
        facts.append((page, host, domain, host and host.split(".")[-1], declared, said, vote))
    votes = defaultdict(lambda: [0, 0, 0])
    for _, host, domain, suffix, _, _, vote in facts:
        for key in (("all",), ("h", host), ("d", domain), ("s", suffix)):
            if vote is not None and (len(key) == 1 or key[1] is not None):
                votes[key][vote] += 1
    overall = [(v + 1) / (sum(votes[("all",)]) + 3) for v in votes[("all",)]]

    def shares(kind, key, vote, above):
        own = [0, 0, 0] if key is None else [v - (vote == k) for k, v in enumerate(votes[(kind, key)])]
        return [(v + 5 * a) / (sum(own) + 5) for v, a in zip(own, above, strict=True)]

    want = Counter()
    for page, host, domain, suffix, declared, said, vote in facts:
        by_host = shares("h", host, vote, shares("d", domain, vote, overall))
        by_suffix = shares("s", suffix, vote, overall)
        right = [0.0 if declared not in langs else math.log(0.9) if x == declared else math.log(0.05) for x in langs]
        score = [s - max(said) + r + math.log(h) + math.log(u) - math.log(o) for s, r, h, u, o in zip(said, right, by_host, by_suffix, overall, strict=True)]
        p = 1 / sum(math.exp(s - max(score)) for s in score)
        want[(page, host, declared, None if vote is None else langs[vote], langs[score.index(max(score))], round(p, 3))] += 1
    assert Counter((r.page_id, r.host, r.declared, r.text_lang, r.lang, round(r.probability, 3)) for r in got) == want
