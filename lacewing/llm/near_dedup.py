"""MinHash near-duplicates by a multi-index Hamming join.

A text's set of shingles gives a signature of `hashes` minima of 16 bits each. Signatures are split in so many chunks that,
of any pair that differs in at most `far` places, some chunk differs in one place at most (pigeonhole); each chunk's allowed
errors are enumerated by leaving out one place at a time. So every pair within the distance meets under a key. Pairs that
meet are confirmed on their full sets; components of the confirmed links are the groups.

far is the 1 - 1e-6 quantile of the distance of two sets at the similarity asked for, so a link is missed by chance about
once in a million. In a key's group, members are held against its least member first; only where that leaves more than one
component under a key, members of different components meet too, unless they hold too few shingles that stand in more than
one component: what two sets share does. Such a meeting makes a pair only where the parities of the sets' shingles, counted
by PARITY hash classes, differ in no more places than the sets themselves may: each place in which they differ holds a
shingle of one set alone, so no link is lost. It comes out under one of the keys that it shares, where the signatures are
within the distance. So no group of copies is expanded into all its pairs.

Equal sets are one class, whatever their doc_ids; the row smallest by doc_id, then by hash of its text, stands for a class
or group. Null or empty text: an empty set, linked with nothing. A null doc_id counts as the largest, and rows that share
a doc_id, or have none, are documents of their own. Repeated rows are copies. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacewing.plans.graph import components

from .common import LOWER, arrow_map, discard, id_or_last, id_or_null, mixed, passing, rolled, settle, texts, unpack, word_hashes, words_of

BASE = 0x9E3779B97F4A7C15
CHUNK = 60_000  # shingles hashed at once: they stay in the cache
PARITY = 512  # hash classes of shingles whose parities a class carries
LEAD = 1 << 16  # marks the value left out at the first place of a chunk
CHUNK_AT = 17  # the bits of v from here on are the number of its chunk
LANES = 4  # places of a signature in a 64-bit number
CLASS = "did long, tkey long, sid binary, n long, sig binary, z binary, size long, odd array<long>"


def distance_bound(hashes: int, similarity: float, miss: float = 1e-6) -> int:
    """The least d with P(more than d of `hashes` minima differ) <= miss, for two sets of this similarity."""
    tail, d = 1.0, -1
    while tail > miss:
        d += 1
        tail -= math.comb(hashes, d) * (1 - similarity) ** d * similarity ** (hashes - d)
    return d


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """64-bit hashes of the shingles in order, repeats included; fewer words than width are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h, k = word_hashes(words), min(width, len(words))
    return mixed(rolled(h, k, BASE)[: len(h) - k + 1], k)


def multipliers(hashes: int) -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.blake2b(b"minhash%d" % k, digest_size=8).digest(), "little") | 1) for k in range(hashes)]


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """A row of 16-bit minima for each set; sets are not empty."""
    x, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out, buf = np.empty((len(sets), hashes), np.uint16), np.empty_like(x)
    for k, a in enumerate(multipliers(hashes)):
        np.multiply(x, a, out=buf)
        out[:, k] = mixed(np.minimum.reduceat(buf, starts), k) >> np.uint64(48)
    return out


def parities(s: np.ndarray) -> list[int]:
    """Whether each hash class holds an odd number of a set's shingles, 64 classes to a number."""
    return np.packbits(np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1).view("<i8").tolist()


def _facts(width, hashes):
    def run(batch):
        raw = batch["text"].cast(pa.binary())
        at = 0
        while at < len(raw):
            sets, blobs, n = [], [], 0
            while at + len(sets) < len(raw) and n < CHUNK and len(sets) < 500:
                joined = (raw[at + len(sets)].as_py() or b"").translate(LOWER)
                words = words_of(joined)
                blobs.append(b" ".join(words))
                sets.append(np.unique(shingles(words, width)))
                n += len(sets[-1])
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full, hashes)) if full else iter(())
            yield {"did": batch["did"][at : at + len(sets)], "tkey": batch["tkey"][at : at + len(sets)], "n": list(map(len, sets)), "sid": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], "sig": [next(sig).tobytes() if len(s) else None for s in sets], "z": [pa.compress(b, codec="zstd", asbytes=True) for b in blobs], "size": list(map(len, blobs)), "odd": list(map(parities, sets))}
            at += len(sets)

    return run


def chunk_bounds(hashes: int, far: int) -> list[int]:
    """Bounds of the fewest chunks of which one differs in at most one place when at most `far` places differ."""
    n = min(hashes, far // 2 + 1)
    return [hashes * k // n for k in range(n + 1)]


def _keys(hashes, far):
    bounds = chunk_bounds(hashes, far)

    def run(batch):
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            sig = np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint16).reshape(-1, hashes).astype(np.uint64)
            keys, left_out = [], []
            for c, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                for out in range(a, b):
                    h = np.full(len(sig), c * hashes + out + 1, np.uint64)
                    for k in range(a, b):
                        if k != out:
                            h = mixed(h * np.uint64(BASE) + sig[:, k], 5)
                    keys.append(h)
                    left_out.append(sig[:, out].astype(np.int32) + (LEAD if out == a else 0) + (c << CHUNK_AT))
            yield {"key": np.stack(keys, 1).reshape(-1).view("<i8"), "cid": np.repeat(part["cid"].to_numpy(), len(keys)), "v": np.stack(left_out, 1).reshape(-1)}

    return run


def _lanes(hashes):
    """Signatures as numbers of LANES places each."""

    def run(batch):
        sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), "<u2").reshape(-1, hashes)
        lanes = np.pad(sig, ((0, 0), (0, -hashes % LANES))).view("<i8")
        yield {"cid": batch["cid"], "s": batch["s"], "n": batch["n"], "odd": batch["odd"], "lanes": list(lanes)}

    return run


def meets_first(hashes: int, far: int) -> str:
    """SQL: two signatures, in la and lb, differ in at most `far` places, and the chunk of the key under which they meet, told
    by va, is the first that differs in one place at most. So a pair within the distance comes out under one key."""
    masks = ("00FF00FF00FF00FF", "000F000F000F000F", "0003000300030003", "0001000100010001")
    differ = "zip_with(la, lb, (x, y) -> x ^ y)"
    for by, mask in zip((8, 4, 2, 1), masks, strict=True):  # a place that differs becomes its lowest bit
        differ = f"transform({differ}, x -> (x | shiftrightunsigned(x, {by})) & {int(mask, 16)}L)"

    def places(a: int, b: int) -> str:
        bits = [(w, sum(1 << 16 * (k % LANES) for k in range(a, b) if k // LANES == w)) for w in range(a // LANES, (b - 1) // LANES + 1)]
        return " + ".join(f"bit_count(get(d, {w}) & {m}L)" for w, m in bits)

    bounds = chunk_bounds(hashes, far)
    first = " ".join(f"WHEN {places(a, b)} <= 1 THEN {c}" for c, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)))
    return f"exists(array({differ}), d -> {places(0, hashes)} <= {far} AND CASE {first} END = shiftright(va, {CHUNK_AT}))"


def _close(hashes, far):
    def run(batch):
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, hashes) for c in ("sig_a", "sig_b"))
            near = pa.array((a != b).sum(1) <= far)
            yield {"a": batch["a"].filter(near), "b": batch["b"].filter(near)}

    return run


def _confirm(width, percent):
    def run(batch):
        keep = []
        for za, na, zb, nb in zip(batch["z_a"], batch["size_a"].to_pylist(), batch["z_b"], batch["size_b"].to_pylist(), strict=True):
            x, y = (np.unique(shingles(words_of(unpack(z.as_py(), n)), width)) for z, n in ((za, na), (zb, nb)))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield {"a": batch["a"].filter(keep), "b": batch["b"].filter(keep)}

    return run


class Links:
    """Confirmed links between classes."""

    def __init__(self, classes: DataFrame, width: int, percent: int, hashes: int):
        self.classes, self.width, self.percent, self.hashes = classes, width, percent, hashes
        self.far = distance_bound(hashes, percent / 100)

    def keys(self) -> DataFrame:
        """key, cid and v: the value that the key leaves out. A pair that has it in common also meets under the chunk's first key."""
        return arrow_map(self.classes.select("cid", "sig"), _keys(self.hashes, self.far), "key long, cid long, v int")

    def close(self, pairs: DataFrame) -> DataFrame:
        """Of (a, b), those within the signature distance."""
        sig = self.classes.select("cid", "sig")
        both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
        return arrow_map(both, _close(self.hashes, self.far), "a long, b long")

    def across(self, open_: DataFrame, sizes: DataFrame) -> DataFrame:
        """(a, b), once each, within the signature distance, of different components under a key; open_: key, cid, v, c;
        sizes: cid, s (shingles that stand in more than one component), n, odd, lanes."""
        percent = self.percent
        left = open_.join(sizes, "cid").select("key", F.col("v").alias("va"), F.col("cid").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("odd").alias("oa"), F.col("lanes").alias("la"))
        right = left.toDF("key", "vb", "b", "cb", "nb", "sb", "ob", "lb")
        enough = F.expr(f"{100 + percent} * least(sa, sb) >= {percent} * (na + nb)")
        apart = " + ".join(f"bit_count(get(oa, {k}) ^ get(ob, {k}))" for k in range(PARITY // 64))
        alike = F.expr(f"{100 + percent} * ({apart}) <= {100 - percent} * (na + nb)")
        once = F.expr(f"va <> vb OR (va & {LEAD}) <> 0")  # a pair equal in the whole chunk counts under its first key alone
        near = F.expr(meets_first(self.hashes, self.far))
        return left.join(right, "key").where((F.col("ca") < F.col("cb")) & once & enough & alike & near).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        full = self.classes.select("cid", "z", "size")
        both = pairs.join(full.toDF("a", "z_a", "size_a"), "a").join(full.toDF("b", "z_b", "size_b"), "b")
        return arrow_map(both, _confirm(self.width, self.percent), "a long, b long")


def _labelled(df: DataFrame, comp: DataFrame | None, column: str, label: str) -> DataFrame:
    if comp is None:
        return df.withColumn(label, F.col(column))
    return df.join(comp.toDF(column, "_c"), column, "left").withColumn(label, F.coalesce("_c", column)).drop("_c")


def _members(width):
    """A row for each shingle of each text."""

    def run(batch):
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            sets = [np.unique(shingles(words_of(unpack(z.as_py(), n)), width)) for z, n in zip(part["z"], part["size"].to_pylist(), strict=True)]
            size = list(map(len, sets))
            yield {"g": np.concatenate(sets).view("<i8"), "cid": np.repeat(part["cid"].to_numpy(), size), "c": np.repeat(part["c"].to_numpy(), size)}

    return run


def class_links(classes: DataFrame, width: int, percent: int, hashes: int) -> DataFrame:
    """(node, component) of linked classes; classes: cid, n, sig, z, size, odd."""
    links, full = Links(classes, width, percent, hashes), classes.select("cid", "z", "size")
    stars = links.keys().groupBy("key").agg(F.min("cid").alias("b"), F.max("cid").alias("most")).where("b <> most").select("key", "b")
    members = settle(links.keys().join(settle(stars), "key"))  # key, cid, v, b: the least member under the key
    pairs = settle(links.close(members.where("cid <> b").select(F.col("cid").alias("a"), "b").distinct()))
    # each member is held against one partner first; most groups are joined by that
    found = settle(links.confirmed(pairs.groupBy("a").agg(F.min("b").alias("b"))))
    comp = settle(components(found, "a", "b"))
    rest = _labelled(_labelled(pairs, comp, "a", "ca"), comp, "b", "cb").where("ca <> cb").select("a", "b")
    found = settle(found.union(links.confirmed(settle(rest))))
    comp = settle(components(found, "a", "b"))
    # keys under which more than one component is left
    labelled = settle(_labelled(members.select("key", "cid", "v"), comp, "cid", "c"))
    mixed_keys = labelled.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("key")
    open_ = settle(labelled.join(mixed_keys, "key"))
    # a link between components holds only shingles that stand in more than one of them; with so few, no link is possible
    docs = settle(open_.select("cid", "c").distinct().join(full, "cid"))
    shingle_rows = lambda: arrow_map(docs, _members(width), "g long, cid long, c long")
    common = settle(shingle_rows().groupBy("g").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("g"))
    shared = shingle_rows().join(common, "g", "left_semi").groupBy("cid").agg(F.count("*").alias("s"))
    sizes = shared.join(classes.select("cid", "n", "odd", "sig"), "cid").where(F.expr(f"100 * s >= {percent} * n"))
    sizes = settle(arrow_map(sizes, _lanes(hashes), "cid long, s long, n long, odd array<long>, lanes array<long>"))
    more = settle(links.confirmed(settle(links.across(open_, sizes))))
    return components(found.union(more), "a", "b")


def near_groups(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, hashes: int) -> DataFrame:
    """did, tkey, n_shingles, group (its smallest doc_id) and kept of each document; again: whether a row not kept equals
    the one kept in its place."""
    with passing() as kept:
        facts = settle(arrow_map(texts(docs, id_col, text_col), _facts(width, hashes), CLASS))
        listed = kept(facts.select("did", "tkey", "n", "sid", F.monotonically_increasing_id().alias("row")))
        # the least row stands for a class; cid is a number for it, which holds as the table is written
        first = listed.where("n > 0").groupBy("sid").agg(F.min(F.struct("did", "tkey", "row")).alias("first"))
        first = kept(first.withColumn("cid", F.monotonically_increasing_id()))
        one = facts.join(first, "sid").where("did = first.did AND tkey = first.tkey")
        classes = settle(one.select("cid", "n", "sig", "z", "size", "odd").dropDuplicates(["cid"]))
        discard(facts)
        comp = kept(class_links(classes, width, percent, hashes))
    members = first.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("sid", "first", "component")
    best = members.where("component is not null").groupBy("component").agg(F.min("first").alias("best"))
    stands = members.join(best, "component", "left").select("sid", F.coalesce("best", "first").alias("best"))
    out = listed.join(stands, "sid", "left")
    again = F.expr("did = best.did AND tkey = best.tkey AND row <> best.row")
    return out.select("did", "tkey", F.col("n").alias("n_shingles"), F.coalesce("best.did", "did").alias("group"), F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"), F.coalesce(again, F.lit(False)).alias("again"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, hashes: int = 96) -> DataFrame:
    """For each document: doc_id, n_shingles (size of its set), component_id (the smallest doc_id of its group) and kept
    (true for one row of each group, which has that doc_id). Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; sets are
    linked whose intersection is at least percent of their union."""
    out = near_groups(docs, id_col, text_col, width, percent, hashes)
    return out.select(id_or_null("did").alias("doc_id"), "n_shingles", id_or_null("group").alias("component_id"), "kept")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, hashes: int = 96) -> DataFrame:
    """docs with one row of each group, of its smallest doc_id."""
    lost = near_groups(docs, id_col, text_col, width, percent, hashes).where("not kept")
    lost = settle(lost.select(F.struct("did", "tkey").alias("key"), "again").distinct())
    rows = docs.select(F.struct("*").alias("row"))  # so that columns of docs may have any names
    left = rows.withColumn("key", F.struct(id_or_last(f"row.`{id_col}`").alias("did"), F.xxhash64(f"row.`{text_col}`").alias("tkey"))).join(lost.where("not again"), "key", "left_anti")
    again = lost.where("again")
    if again.take(1):  # rows equal to the one kept
        left = left.join(again, "key", "left_anti").union(left.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return left.select("row.*")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS g FROM (SELECT doc_id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS g FROM d WHERE len(words) > 1
  UNION ALL SELECT doc_id, words[1] FROM d WHERE len(words) = 1)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS MATERIALIZED (SELECT g, count(*) AS df FROM s GROUP BY g),
o AS MATERIALIZED (SELECT s.doc_id, s.g, row_number() OVER (PARTITION BY s.doc_id ORDER BY df, s.g) AS k, n FROM s JOIN f USING (g) JOIN n USING (doc_id)),
p AS MATERIALIZED (SELECT doc_id, g FROM o WHERE k <= n - ceil(0.8 * n) + 1),
c AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id),
i AS (SELECT c.a, c.b, count(*) AS shared FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
m AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
