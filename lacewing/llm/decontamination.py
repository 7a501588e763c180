"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all benchmark texts; each document
is scanned once, and hits are mapped back to offsets in the original text.

Null or empty text, in either table: no words, no hits. A benchmark row with a null id marks words, but is no listed item.
Equal ids on several rows are one item. Repeated documents give repeated rows; null doc_ids are carried. Empty tables give
no rows or no hits. Other columns are not read. The automaton is broadcast in blocks of at most block_bytes of windows; a
larger benchmark is scanned block after block, each pass adding its spans.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_map, settle

#: Words of the original text, before A-Z are lowered.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A-Z to lower case; what parts words to a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RUNS = "array<struct<a:int,b:int>>"
_built: dict[str, object] = {}


def normal_words(raw: bytes | None) -> list[bytes]:
    return [] if raw is None else raw.translate(NORMAL).split()


def windows_of(raw: bytes | None, size: int) -> set[bytes]:
    words = normal_words(raw)
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def automaton(patterns: list[tuple[bytes, tuple[int, ...]]]):
    """Windows stand between spaces, so they match whole words only; bytes stand as latin-1 characters."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for window, items in patterns:
        text = f" {window.decode('latin-1')} "
        found.add_word(text, (len(text), window.count(b" ") + 1, items))
    found.make_automaton()
    return found


def scan(raw: bytes | None, auto) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Words of the text; runs of hit words (first, last + 1); items hit."""
    words = normal_words(raw)
    if not words or not len(auto):
        return len(words), [], set()
    text = f" {b' '.join(words).decode('latin-1')} "
    runs, items, gaps = [], set(), None
    for end, (length, n, ids) in auto.iter(text):
        if gaps is None:
            gaps = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        first = int(np.searchsorted(gaps, end - length + 1))
        if runs and first <= runs[-1][1] and first >= runs[-1][0]:
            runs[-1][1] = max(runs[-1][1], first + n)
        else:
            runs.append([first, first + n])
        items.update(ids)
    return len(words), merged(runs), items


def merged(runs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, share: int = 20, block_bytes: int = 64 << 20, rows: bool = False) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, items (sorted ids), spans of the hit words as (start, end) in characters of
    the original text, and contaminated: n_hit > 0 and share * n_hit >= n_words. rows: carry the document's own row along as
    the struct `row`."""
    spark = docs.sparkSession
    cut = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").cast("binary").alias("raw"))
    windows = settle(arrow_map(cut, lambda b: _windows(b, size), "item long, win binary").groupBy("win").agg(F.collect_set("item").alias("items")))
    total = windows.agg(F.sum(F.length("win") + 8 * F.size("items"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kept = [F.struct("*").alias("row")] if rows else []
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(RUNS).alias("runs"), F.array().cast("array<long>").alias("found"), *kept)
    for k in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == k) if blocks > 1 else windows
        patterns = spark.sparkContext.broadcast([(bytes(w), tuple(i)) for w, i in own.toLocalIterator()])
        out = arrow_map(out, _Scanner(patterns), out.schema)
    held = [f for f in out.schema.fields if f.name in ("doc_id", "n_words", "row")]
    out = arrow_map(out, _spans, StructType([*held, *StructType.fromDDL("n_hit long, items array<long>, spans array<struct<start:int,end:int>>").fields]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _windows(batch, size):
    pairs = [(i, w) for i, raw in zip(batch["item"].to_pylist(), batch["raw"].to_pylist(), strict=True) for w in windows_of(raw, size)]
    return {"item": [i for i, _ in pairs], "win": [w for _, w in pairs]}


class _Scanner:
    def __init__(self, patterns):
        self.patterns, self.name = patterns, uuid.uuid4().hex

    def __call__(self, batch):
        import pyarrow as pa

        key = self.name
        if key not in _built:  # a worker keeps one automaton
            _built.clear()
            _built[key] = automaton(self.patterns.value)
        n, runs, found = [], [], []
        for raw, old, had in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["runs"].to_pylist(), batch["found"].to_pylist(), strict=True):
            words, hit, items = scan(raw, _built[key])
            n.append(words)
            runs.append([{"a": a, "b": b} for a, b in (merged([*((x["a"], x["b"]) for x in old), *hit]) if old else hit)])
            found.append(sorted({*(had or []), *items}))
        return {k: batch[k] for k in batch.schema.names} | {"n_words": n, "runs": runs, "found": found}


def _spans(batch):
    out = defaultdict(list)
    for text, runs in zip(batch["text"].to_pylist() if any(len(r) for r in batch["runs"].to_pylist()) else [None] * len(batch), batch["runs"].to_pylist(), strict=True):
        at = [(m.start(), m.end()) for m in WORDS.finditer(text)] if runs else []
        out["n_hit"].append(sum(x["b"] - x["a"] for x in runs))
        out["spans"].append([{"start": at[x["a"]][0], "end": at[x["b"] - 1][1]} for x in runs])
    return {k: batch[k] for k in batch.schema.names} | {"n_hit": out["n_hit"], "items": batch["found"], "spans": out["spans"]}


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(words[i : i + 12], ' ') AS win, least(13, len(words)) AS n FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM bw WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT DISTINCT d.doc_id, d.i, d.n, w.item_id FROM (SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM dw, sizes)) d JOIN win w ON d.win = w.win AND d.n = w.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
