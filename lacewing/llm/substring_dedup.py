"""Substring deduplication over words, with difference-cover anchors.

A match of `window` words between any two positions holds a pair of aligned positions that both lie in a difference cover
modulo `period`, with window - period + 1 words of the match still to come. So only positions in the cover are hashed and
dealt out: six of 31. An anchor whose hash stands in two different texts is extended: the windows around it are hashed as a
whole (128 bits), and a window goes where its words also start in a document with a smaller id.

Texts of the same words are one class, which its smallest doc_id stands for: longer ids are removed whole, if they have a
window at all. Null or empty text: no words. A null doc_id counts as the largest. Rows of equal doc_id remove nothing from
each other. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_or_null, mixed, rolled, settle, texts, unpack, word_hashes, words_of

BASE, BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
CHUNK = 400_000  # words hashed at once


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set whose differences take every value modulo period."""
    for size in count(1):
        for rest in combinations(range(1, period), size - 1):
            if len({(a - b) % period for a in (0, *rest) for b in (0, *rest)}) == period:
                return (0, *rest)
    raise AssertionError


def chunks(rows, width):
    """Lists of rows whose last elements, arrays, are width long together."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1])
        if n >= width:
            yield held
            held, n = [], 0
    if held:
        yield held


def _facts(batch):
    raw = batch["text"].cast(pa.binary())
    for at in range(0, len(raw), 500):
        words = [words_of(t) for t in raw[at : at + 500].to_pylist()]
        joined = [b" ".join(w) for w in words]
        shas = [hashlib.sha256(t).digest() for t in joined]
        yield {"did": batch["did"][at : at + 500], "tkey": batch["tkey"][at : at + 500], "n_words": list(map(len, words)), "sha": shas, "wkey": [int.from_bytes(s[:8], "little", signed=True) for s in shas], "z": [pa.compress(t, codec="zstd", asbytes=True) for t in joined], "size": list(map(len, joined))}


def _hashed(batch, window):
    """(wkey, row, hashes of the words) of texts that hold a window."""
    for i, (wkey, z, size) in enumerate(zip(batch["wkey"].to_pylist(), batch["z"], batch["size"].to_pylist(), strict=True)):
        words = words_of(unpack(z.as_py(), size))
        if len(words) >= window:
            yield wkey, i, word_hashes(words)


def _places(part):
    n = np.array([len(h) for *_, h in part])
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, pos, np.repeat(n, n) - pos


def _anchors(period, window):
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    k = window - period + 1

    def run(batch):
        for part in chunks(_hashed(batch, window), CHUNK):
            row, pos, rest = _places(part)
            take = cover[pos % period] & (rest >= k)
            h = mixed(rolled(np.concatenate([h for *_, h in part]), k, BASE), 1)[take]
            yield {"h": h.view("<i8"), "wkey": np.array([w for w, *_ in part], "<i8")[row[take]]}

    return run


def _windows(period, window):
    """The windows of a text that hold an anchor seen in another text: it is extended by what the window may lack."""
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    k = window - period + 1

    def run(batch):
        for part in chunks(_hashed(batch, window), CHUNK):
            row, pos, rest = _places(part)
            words = np.concatenate([h for *_, h in part])
            h = mixed(rolled(words, k, BASE), 1).view("<i8")
            seen = np.zeros(len(words), bool)
            at = 0
            for _, i, own in part:
                seen[at : at + len(own)] = np.isin(h[at : at + len(own)], batch["hashes"][i].values.to_numpy())
                at += len(own)
            seen &= cover[pos % period] & (rest >= k)
            near = np.zeros(len(words) + 1, np.int64)
            marks = np.flatnonzero(seen)
            np.add.at(near, marks - np.minimum(pos[marks], period - 1), 1)
            np.add.at(near, marks + 1, -1)
            take = (np.cumsum(near[:-1]) > 0) & (rest >= window)
            yield {"lo": mixed(rolled(words, window, BASE)[take], 2).view("<i8"), "hi": mixed(rolled(words, window, BASE2)[take], 3).view("<i8"), "did": np.array([batch["did"][i].as_py() for _, i, _ in part], "<i8")[row[take]], "wkey": np.array([w for w, *_ in part], "<i8")[row[take]], "start": pos[take]}

    return run


def _remove(window):
    def run(batch):
        for i, z in enumerate(batch["z"]):
            words = words_of(unpack(z.as_py(), batch["size"][i].as_py()))
            gone = np.zeros(len(words) + 1, np.int64)
            starts = np.unique(batch["starts"][i].values.to_numpy())
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)
            gone = np.cumsum(gone[:-1]) > 0
            kept = hashlib.sha256(b" ".join([w for w, x in zip(words, gone, strict=True) if not x])).digest()
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
            yield {"wkey": [batch["wkey"][i].as_py()], "cut": [int(gone.sum())], "kept": [kept], "runs": [[{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]]}

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, period: int = 31) -> DataFrame:
    """For each document: doc_id, n_words, n_removed, kept_sha256 (binary digest of the kept words joined by spaces) and
    removed, its maximal runs of removed words as (start, end)."""
    facts = settle(arrow_map(texts(docs, id_col, text_col), _facts, "did long, tkey long, n_words long, sha binary, wkey long, z binary, size long"))
    first = settle(facts.groupBy("sha").agg(F.min("did").alias("first")))

    def anchors():
        return arrow_map(facts.select("wkey", "z", "size"), _anchors(period, window), "h long, wkey long")

    shared = settle(anchors().groupBy("h").agg(F.min("wkey").alias("a"), F.max("wkey").alias("b")).where("a <> b").select("h"))
    flagged = settle(anchors().join(shared, "h", "left_semi").groupBy("wkey").agg(F.collect_set("h").alias("hashes")))
    reps = facts.select("did", "sha", "wkey").join(first, "sha").where("did = first").select("wkey", "did").distinct()
    own = facts.join(flagged.join(reps, "wkey").select("wkey", "hashes", F.col("did").alias("first")), "wkey").where("did = first")
    own = settle(own.select("wkey", "did", "z", "size", "hashes").dropDuplicates(["wkey", "did"]))

    def windows():
        return arrow_map(own, _windows(period, window), "lo long, hi long, did long, wkey long, start int")

    twice = settle(windows().groupBy("lo", "hi").agg(F.min("did").alias("least"), F.max("did").alias("most")).where("least <> most").select("lo", "hi", "least"))
    starts = windows().join(twice, ["lo", "hi"]).where("did > least").groupBy("wkey").agg(F.collect_list("start").alias("starts"))
    cut = settle(arrow_map(own.select("wkey", "z", "size").join(starts, "wkey"), _remove(window), "wkey long, cut long, kept binary, runs array<struct<start:int,end:int>>"))
    out = facts.select("did", "n_words", "sha", "wkey").join(first, "sha").join(cut, "wkey", "left")
    copy = (F.col("did") > F.col("first")) & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return out.select(
        id_or_null("did").alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").digest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>"))).alias("removed"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d)),
m AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT doc_id, i FROM w JOIN m USING (win) WHERE doc_id > least),
r AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM s)),
p AS (SELECT doc_id, j, word FROM (SELECT doc_id, unnest(range(1, len(words) + 1)) AS j, unnest(words) AS word FROM d WHERE doc_id IN (SELECT doc_id FROM r))),
k AS (SELECT p.doc_id, count(r.j) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p.j) FILTER (WHERE r.j IS NULL), '')) AS kept FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.j = r.j GROUP BY p.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept, sha256(array_to_string(words, ' '))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
