"""Suffix-array deduplication of repeated byte strings, by external induced sorting of shards.

Each string of `length` bytes is dealt by its anchor: the least hash of the shorter windows inside it. Equal strings have
equal anchors, so they meet; strings in a row with one anchor are one region of text. Regions whose anchor stands once
cannot repeat and are left out. The others are dealt to shards by anchor, and each shard is suffix-sorted with common-prefix
values by induced sorting (induced_sort), on disk where it passes the memory allowed. A string is repeated where a neighbour
in the suffix array shares `length` bytes with it.

Equal texts are one class and equal regions one region, which is sorted once: the copies tell that all its strings repeat,
the suffix array which strings it shares with other regions. So no group of copies is gathered. Scratch files belong to the task that writes them and end with
it; nothing else reads them.

Null and empty texts: no bytes. Null doc_ids are carried. Repeated rows are copies, so each removes the other. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, arrow_map, arrow_schema, discard, id_or_null, lean_map, mixed, passing, rolled, settle, texts, unpack, words_of
from .induced_sort import Scratch, suffix_sort

BASE, GRAM = 0x9E3779B97F4A7C15, 32
CHUNK = 1 << 18
PIECE = 1 << 22  # longer texts are hashed in overlapping pieces
PLACE = np.uint64((1 << 24) - 1)  # the bits of a hash that its place takes
_SYMBOLS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE), 7)


def _facts(batch):
    raw = batch["text"].cast(pa.binary())
    for at in range(0, len(raw), 500):
        part = [t or b"" for t in raw[at : at + 500].to_pylist()]
        shas = [hashlib.sha256(t).digest() for t in part]
        yield {"did": batch["did"][at : at + 500], "tkey": batch["tkey"][at : at + 500], "sha": shas, "z": [pa.compress(t, codec="zstd", asbytes=True) for t in part], "size": list(map(len, part))}


def regions(data: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, start, end, anchor) of the regions of these texts, each of at least length bytes: maximal runs of starts
    whose strings have their least hash (the leftmost of equals) at the same place; end is that of the last string."""
    cuts = [(i, a) for i, t in enumerate(data) for a in range(0, max(1, len(t) - length + 1), PIECE)]
    text_of, offset = (np.array(c) for c in zip(*cuts, strict=True))
    pieces = [data[i][a : a + PIECE + length - 1] for i, a in cuts]
    out: list[list[np.ndarray]] = [[], [], [], []]
    for lo, hi in _spread([len(p) for p in pieces], CHUNK):
        row, a, b, h = _regions_of(pieces[lo:hi], length)
        for k, v in enumerate((text_of[lo:hi][row], a + offset[lo:hi][row], b + offset[lo:hi][row], h)):
            out[k].append(v)
    return tuple(np.concatenate(v) for v in out)


def _spread(sizes: list[int], most: int):
    """(lo, hi) of stretches whose sizes add up to `most` or little more."""
    lo, n = 0, 0
    for k, x in enumerate(sizes):
        n += x
        if n >= most or k == len(sizes) - 1:
            yield lo, k + 1
            lo, n = k + 1, 0


def _regions_of(data: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    gram = min(GRAM, length)
    n = np.array(list(map(len, data)))
    x = _SYMBOLS[np.frombuffer(b"".join(data), np.uint8)]
    h = mixed(rolled(x, gram, BASE), 11)
    place = np.arange(len(x), dtype=np.uint64)
    width, least, done = length - gram + 1, (h & ~PLACE) | place, 1
    other = np.empty_like(least)
    while done < width:  # least of `done` hashes on; windows that cross texts are not used
        step = min(done, width - done)
        np.minimum(least[:-step], least[step:], out=other[:-step])
        other[-step:] = least[-step:]
        least, other, done = other, least, done + step
    least &= PLACE
    first = np.cumsum(n) - n
    usable = np.zeros(len(x) + 1, np.int8)
    full = n >= length
    usable[first[full]] += 1
    usable[(first + n - length + 1)[full]] -= 1
    usable = np.cumsum(usable[:-1], dtype=np.int8) > 0
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[1:] |= usable[1:] != usable[:-1]
    new[first[n > 0]] = True
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(x)]])
    take = usable[starts]
    starts, ends = starts[take], ends[take]
    row = np.searchsorted(first, starts, side="right") - 1
    return row, starts - first[row], ends - first[row] + length - 1, h[least[starts].astype(np.int64)]


def _texts(batch, length):
    """Lists of (row, text) of about CHUNK bytes, of texts that hold a string."""
    held, n = [], 0
    for i, (z, size) in enumerate(zip(batch["z"], batch["size"].to_pylist(), strict=True)):
        if size >= length:
            held.append((i, unpack(z.as_py(), size)))
            n += size
            if n >= CHUNK:
                yield held
                held, n = [], 0
    if held:
        yield held


def _anchors(length):
    def run(batch):
        key = batch["wkey"].to_numpy()
        for part in _texts(batch, length):
            row, _, _, h = regions([t for _, t in part], length)
            yield {"h": h.view("<i8"), "wkey": key[np.array([i for i, _ in part])[row]]}

    return run


def _regions(length):
    def run(batch):
        sent: dict[bytes, int] = {}
        for part in _texts(batch, length):
            row, a, b, h = regions([t for _, t in part], length)
            h = h.view("<i8")
            wanted = np.zeros(len(h), bool)
            for k, (i, _) in enumerate(part):
                mine = slice(*np.searchsorted(row, [k, k + 1]))
                wanted[mine] = np.isin(h[mine], batch["hashes"][i].values.to_numpy())
            out: dict[str, list] = {k: [] for k in ("h", "rid", "wkey", "at", "region", "copies")}
            for k in np.flatnonzero(wanted).tolist():
                i, text = part[row[k]]
                body = text[a[k] : b[k]]
                rid = hashlib.blake2b(body, digest_size=16).digest()
                copies = batch["copies"][i].as_py()
                had = sent.get(rid, 0)
                if len(sent) < 200_000:
                    sent[rid] = had + copies
                sends = body if not had else b"" if had < 2 else None  # a second row only tells of the copy
                for name, v in (("h", h[k]), ("rid", rid), ("wkey", batch["wkey"][i].as_py()), ("at", int(a[k])), ("region", sends), ("copies", copies)):
                    out[name].append(v)
            yield out

    return run


def _shards(length, memory):
    """Suffix-sorts the regions of each partition; gives the repeated starts of each region as runs."""
    schema = arrow_schema("rid binary, runs array<struct<start:int,end:int>>")

    def run(batches):
        with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
            parts, ids, sizes, seen, total = open(f"{folder}/text", "w+b"), {}, [], {}, 0  # noqa: SIM115
            with parts:
                for batch in batches:
                    for rid, body, copies in zip(batch["rid"].to_pylist(), batch["region"].to_pylist(), batch["copies"].to_pylist(), strict=True):
                        seen[rid] = seen.get(rid, 0) + copies
                        if body and rid not in ids:
                            ids[rid] = True
                            parts.write(body)
                            sizes.append(len(body))
                            total += len(body)
                parts.flush()
                if not ids:
                    return
                scratch = Scratch(folder, memory)
                size = np.array(sizes)
                first = np.cumsum(size + 1) - size - 1
                text = scratch.array(total + len(ids) + 1, np.uint16)  # 0 ends the shard, 1 a region, others are bytes
                raw, at = np.memmap(f"{folder}/text", np.uint8, "r"), 0
                for a, k in zip(first.tolist(), sizes, strict=True):
                    text[a : a + k] = raw[at : at + k]
                    text[a : a + k] += 2
                    text[a + k] = 1
                    at += k
                sa, lcp = suffix_sort(text, scratch, memory)
                twice = np.zeros(len(text), bool)
                for lo in range(0, len(sa), 1 << 22):
                    hit = lo + np.flatnonzero(lcp[lo : lo + (1 << 22)] >= length)
                    twice[sa[hit]] = True
                    twice[sa[hit - 1]] = True
                out = {"rid": [], "runs": []}
                for rid, a, k in zip(ids, first.tolist(), sizes, strict=True):
                    own = twice[a : a + k - length + 1]
                    if seen[rid] > 1:
                        own[:] = True
                    if own.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).reshape(-1, 2)
                        out["rid"].append(rid)
                        out["runs"].append([{"start": int(x), "end": int(y)} for x, y in edge])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def _remove(length):
    def run(batch):
        for i, z in enumerate(batch["z"]):
            data = np.frombuffer(unpack(z.as_py(), batch["size"][i].as_py()), np.uint8)
            gone = np.zeros(len(data) + 1, np.int32)
            parts = batch["parts"][i].values
            runs = parts.field("runs")
            at = np.repeat(parts.field("at").to_numpy(), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            np.add.at(gone, at + flat.field("start").to_numpy(), 1)
            np.add.at(gone, at + flat.field("end").to_numpy() - 1 + length, -1)
            gone = np.cumsum(gone[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
            yield {"wkey": [batch["wkey"][i].as_py()], "cut": [int(gone.sum())], "kept": [hashlib.sha256(data[~gone].tobytes()).digest()], "spans": [[{"start": int(a), "end": int(b)} for a, b in edge]]}

    return run


SPANS = "array<struct<start:int,end:int>>"


def suffix_spans(docs: DataFrame, id_col: str, text_col: str, length: int, shard_bytes: int, memory: int) -> DataFrame:
    """did, tkey, n_bytes, n_removed, kept_sha256 and spans of each document."""
    with passing() as kept:
        facts = settle(arrow_map(texts(docs, id_col, text_col), _facts, "did long, tkey long, sha binary, z binary, size long").withColumn("wkey", F.xxhash64("sha")))
        listed = kept(facts.select("did", "tkey", "sha", "wkey", F.col("size").alias("n_bytes")))
        classes = settle(facts.where(F.col("size") >= length).groupBy("wkey").agg(F.count("*").alias("copies"), F.min(F.struct("did", "tkey")).alias("rep")).select("wkey", F.least("copies", F.lit(2)).cast("int").alias("copies"), "rep.did", "rep.tkey"))
        anchors = settle(arrow_map(facts.select("wkey", "z", "size"), _anchors(length), "h long, wkey long"))
        shared = settle(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
        flagged = settle(anchors.join(shared, "h", "left_semi").groupBy("wkey").agg(F.collect_set("h").alias("hashes")).join(classes, "wkey"))
        discard(anchors)
        own = settle(facts.select("did", "tkey", "wkey", "z", "size").join(flagged, ["did", "tkey", "wkey"]).dropDuplicates(["did", "tkey", "wkey"]).select("wkey", "copies", "z", "size", "hashes"))
        discard(facts)
        found = settle(arrow_map(own, _regions(length), "h long, rid binary, wkey long, at int, region binary, copies int"))
        total = found.agg(F.sum(F.length("region"))).first()[0] or 0
        deal = found.where("region is not null").select("h", "rid", "region", "copies").repartition(max(1, -(-total // shard_bytes)), "h")
        runs = settle(lean_map(deal.select("rid", "region", "copies"), _shards(length, memory), "rid binary, runs " + SPANS))
        parts = found.select("rid", "wkey", "at").join(runs, "rid").groupBy("wkey").agg(F.collect_list(F.struct("at", "runs")).alias("parts"))
        cut = kept(arrow_map(own.select("wkey", "z", "size").join(parts, "wkey"), _remove(length), f"wkey long, cut long, kept binary, spans {SPANS}"))
    out = listed.join(cut, "wkey", "left")
    return out.select("did", "tkey", "n_bytes", F.coalesce("cut", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, shard_bytes: int = 2 << 20, memory: int = 256 << 20) -> DataFrame:
    """For each document: doc_id, n_bytes, n_removed, kept_sha256 (binary digest of the remaining bytes) and spans, the
    maximal runs of removed bytes as (start, end) in its UTF-8 text."""
    out = suffix_spans(docs, id_col, text_col, length, shard_bytes, memory)
    return out.select(id_or_null("did").alias("doc_id"), "n_bytes", "n_removed", "kept_sha256", "spans")


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, min_words: int = 0, shard_bytes: int = 2 << 20, memory: int = 256 << 20) -> DataFrame:
    """docs with the maximal repeated runs of bytes taken out of text_col, of those that hold at least min_words words;
    characters that lose some of their bytes go whole. Columns of docs may have any names."""
    spans = suffix_spans(docs, id_col, text_col, length, shard_bytes, memory).where("n_removed > 0")
    gone = spans.select(F.struct("did", "tkey").alias("key"), "spans").dropDuplicates(["key"])
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.withColumn("key", F.struct(F.coalesce(F.col(f"row.`{id_col}`").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(f"row.`{text_col}`").alias("tkey")))
    text = F.col(f"row.`{text_col}`")
    cut = F.when(F.col("spans").isNull(), text).otherwise(_cut(min_words)(text, F.col("spans"))).alias(text_col)
    return rows.join(gone, "key", "left").select(*[cut if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def _cut(min_words: int):
    def one(t, runs):
        if t is None or runs is None:
            return t
        raw, at, out = t.encode(), 0, []
        for r in runs:
            if len(words_of(raw[r["start"] : r["end"]])) >= min_words:
                out.append(raw[at : r["start"]])
                at = r["end"]
        return b"".join([*out, raw[at:]]).decode("utf-8", "ignore")

    def batch(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([one(t, r) for t, r in zip(text, spans, strict=True)])

    return F.pandas_udf(batch, "string")
