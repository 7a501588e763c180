"""Exact fuzzy matching: pairs, links, clusters and search statistics.

Names become distinct normalized strings first. Equal strings meet in an equi-join. Different ones meet, under thresholds
below a half, by segments: of the shorter string cut in k + 1 parts one stands unchanged in the longer, at a place that k
edits allow, so an equi-join on (length, k, segment, characters) finds every pair; the bounded edit distance confirms. From
a half on, every pair is compared. All results are the same for every method.

Pairs of strings are pairs of numbers; the rows that hold a string stand in blocks of at most BLOCK, so the pairs of rows
are made where they are returned and never shuffled. Where all strings of a table are compared without rules, the ids go along
with the strings, so pairs of strings are not shuffled either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacewing.functions.options import Normal, Rules, check_method, check_share
from lacewing.functions.text import SKETCH, accepted, may_match, normalize, sketch
from lacewing.plans.budget import max_edits, segment_length, segment_places, segment_start
from lacewing.plans.graph import components
from lacewing.plans.numbering import numbered_rows
from lacewing.plans.tables import settle

from .distances import code_points, near

BRUTE_FROM = 0.5
FEW = 5_000
BLOCK = 256  # rows of one string that go together: Spark holds all that two blocks make before it goes on
MANY = 16  # rows of a string, from which blocks are dealt
GROUP, LONG = 8192, 512  # strings in a side of a cell; longer strings are compared in rows
TOLD = 1 << 17  # pairs that leave a cell together
TRIED, OFTEN = 1000, 0.05  # strings that are tried, and how often two must meet for comparing all to cost less


def normalized(names: DataFrame, options: Normal, id_col: str = "id", name_col: str = "name", null_as_empty: bool = False) -> DataFrame:
    """(id, norm). Null names raise, unless they are to count as empty."""
    name = F.col(name_col).cast("string")
    name = F.coalesce(name, F.lit("")) if null_as_empty else F.when(name.isNull(), F.raise_error(F.lit("a name is null"))).otherwise(name)
    return names.select(F.col(id_col).cast("long").alias("id"), normalize(name, options).alias("norm"))


def lengths_of(strings: DataFrame) -> list[int]:
    """Distinct lengths: bounded by the longest name, whatever the number of rows."""
    return sorted(r[0] for r in strings.select(F.length("norm")).distinct().collect())


def numbered_strings(rows: DataFrame) -> DataFrame:
    """(cid, norm, rows): a number for each distinct string; the table is written, so the numbers hold."""
    return settle(rows.groupBy("norm").agg(F.count("*").alias("rows")).withColumn("cid", F.monotonically_increasing_id()))


def blocks(rows: DataFrame, strings: DataFrame) -> DataFrame:
    """(cid, block, ids): the ids of each string's rows, repeats included."""
    held = rows.withColumn("row", F.monotonically_increasing_id()).join(strings, "norm")
    place = F.pmod(F.xxhash64("row"), F.ceil(F.col("rows") / BLOCK))
    return settle(held.groupBy("cid", place.alias("block")).agg(F.collect_list("id").alias("ids")))


def dealt(few: DataFrame) -> DataFrame:
    """Rows from which many are made, over all cores: a few small rows would stay in one task."""
    return few.repartition(4 * few.sparkSession.sparkContext.defaultParallelism)


def many_rows(strings: DataFrame) -> bool:
    """Whether a string stands for so many rows that blocks go over all cores before their rows are made."""
    return (strings.agg(F.avg("rows")).first()[0] or 0) >= MANY


def spread(pairs: DataFrame, left: DataFrame, right: DataFrame, many: bool = False) -> DataFrame:
    """(x, y, score) of all rows of the pairs (s, r, score) of strings. many: few pairs of blocks make many rows, so they are
    dealt; their ids are a small part of what is made."""
    met = pairs.join(left.select(F.col("cid").alias("s"), F.col("ids").alias("xs")), "s").join(right.select(F.col("cid").alias("r"), F.col("ids").alias("ys")), "r")
    if many:
        met = dealt(met.select("xs", "ys", "score"))
    return met.select(F.explode("xs").alias("x"), "ys", "score").select("x", F.explode("ys").alias("y"), "score")


def measured(strings: DataFrame, threshold: float) -> DataFrame:
    """(cid, norm, l, e, sketch): e is the largest number of edits of which the share of l is at most the threshold."""
    length, t = F.length("norm"), F.lit(float(threshold))
    e = (t * length).cast("int")
    share = lambda k: k / F.greatest(length, F.lit(1))
    e = F.when(share(e) > t, e - 1).when((e < length) & (share(e + 1) <= t), e + 1).otherwise(e)
    return settle(strings.select("cid", "norm", length.alias("l"), e.alias("e"), *sketch(F.col("norm"))))


def compared(left: DataFrame, right: DataFrame, ok: Column, half: bool = False) -> DataFrame:
    """(s, r, score) of measured strings within the threshold, by comparing all; half: s below r. ok: the pair rules, on s_norm
    and r_norm. One condition on both ends, so Spark loops. It stands in the join, as a filter behind it would be moved in
    front of its parts: lengths and sketches come first, then the distance, then the rules."""
    a, b = (t.toDF(end, *[f"{end}_{k}" for k in ("norm", "l", "e", *SKETCH)]) for t, end in ((left, "s"), (right, "r")))
    most, distance = F.greatest("s_e", "r_e"), F.expr("levenshtein(s_norm, r_norm, greatest(s_e, r_e))")
    near = (F.abs(F.col("s_l") - F.col("r_l")) <= most) & may_match("s_", "r_", most) & (distance >= 0) & ok
    cores = left.sparkSession.sparkContext.defaultParallelism
    met = a.repartition(4 * cores).join(b, (F.col("s") < F.col("r")) & near if half else near)
    return met.select("s", "r", (distance / F.greatest("s_l", "r_l", F.lit(1))).alias("score"))


def rule(rules: Rules) -> Column | None:
    """The pair rules on s_norm and r_norm; None where there are none."""
    return accepted(F.col("s_norm"), F.col("r_norm"), rules) if rules.numbers_must_match or rules.word_threshold is not None else None


def grouped(strings: DataFrame, cells: int) -> tuple[DataFrame, int]:
    """(g, pos, cid, norm): the strings in order, in groups of neighbours, and how many groups: at least `cells` of them
    where there are so many strings."""
    own = numbered_rows(strings.select("cid", "norm").orderBy("norm"), column="pos")
    n = own.count()
    most = min(max(cells, -(-n // GROUP)), max(1, n))
    return own.select(F.floor(F.col("pos") * most / max(1, n)).cast("int").alias("g"), "pos", "cid", "norm"), most


def near_in_cell(texts: list[tuple], patterns: list[tuple], threshold: float, half: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, pattern, score) of a cell by their places, TOLD and a few more at a time. half: a text goes with the patterns
    behind it in the order."""
    (at, _, norm), (to, _, other) = (zip(*rows, strict=True) for rows in (texts, patterns))
    at, to, size, sizes = (np.array(x, np.int64) for x in (at, to, [*map(len, norm)], [*map(len, other)]))
    held, n = [], 0

    def told() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, d = (np.concatenate(x) for x in zip(*held, strict=True))
        return i, j, d / np.maximum(1, np.maximum(size[i], sizes[j]))

    for i, j, d in near(norm, other, threshold):
        if half and at[-1] >= to[0]:
            behind = at[i] < to[j]
            i, j, d = i[behind], j[behind], d[behind]
        held.append((i, j, d))
        n += len(i)
        if n >= TOLD:
            yield told()
            held, n = [], 0
    if n:
        yield told()


def cell_pairs(threshold: float, half: bool):
    """The pairs (s, r, score) of cells that come one after the other, the texts of each in front of its patterns. half: of one
    table, and s is the smaller number."""

    def of(texts: list[tuple], patterns: list[tuple]) -> Iterator[pa.RecordBatch]:
        s, r = (np.array([row[1] for row in rows], np.int64) for rows in (texts, patterns))
        for i, j, score in near_in_cell(texts, patterns, threshold, half):
            x, y = s[i], r[j]
            if half:
                x, y = np.minimum(x, y), np.maximum(x, y)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(score)], ["s", "r", "score"])

    return by_cell(of)


class Ids:
    """The ids of the rows of some strings, in a row, and where those of each begin."""

    def __init__(self, lists: list[list[int]]):
        self.n = np.array([*map(len, lists)], np.int64)
        self.start, self.flat = np.cumsum(self.n) - self.n, np.array([*chain.from_iterable(lists)], np.int64)
        self.first, self.several = self.flat[self.start], self.n > 1


def of_rows(x: Ids, y: Ids, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, score) of all rows of pairs of strings; those of strings with several rows about TOLD at a time."""
    several = x.several[i] | y.several[j]
    if not several.any():
        yield x.first[i], y.first[j], score
        return
    one = ~several
    yield x.first[i[one]], y.first[j[one]], score[one]
    i, j, score = i[several], j[several], score[several]
    n, width = x.n[i] * y.n[j], y.n[j]
    for k in np.split(np.arange(len(n)), np.flatnonzero(np.diff((np.cumsum(n) - 1) // TOLD)) + 1):
        of = np.repeat(k, n[k])
        place = np.arange(len(of)) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
        yield x.flat[x.start[i[of]] + place // width[of]], y.flat[y.start[j[of]] + place % width[of]], score[of]


def cell_rows(threshold: float):
    """All pairs of rows (id_a, id_b, score) of cells of one table. Strings come with the ids of their rows; one that has many
    rows stands several times."""

    def of(texts: list[tuple], patterns: list[tuple]) -> Iterator[pa.RecordBatch]:
        xs, ys = (Ids([row[1] for row in rows]) for rows in (texts, patterns))

        def told(x: np.ndarray, y: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(score)], ["id_a", "id_b", "score"])

        if texts[-1][0] >= patterns[0][0]:  # a group with itself: each one's own rows by twos
            several = np.flatnonzero(xs.n > 1)
            for x, y, score in of_rows(xs, xs, several, several, np.zeros(len(several))):
                once = x < y
                yield told(x[once], y[once], score[once])
        for found in near_in_cell(texts, patterns, threshold, True):
            for x, y, score in of_rows(xs, ys, *found):
                if not score.all():  # equal strings: an id that stands twice makes no pair with itself
                    other = (score > 0) | (x != y)
                    x, y, score = x[other], y[other], score[other]
                yield told(x, y, score)

    return by_cell(of)


def by_cell(of: Callable[[list[tuple], list[tuple]], Iterator[pa.RecordBatch]]) -> Callable:
    """What `of` gives for the texts and the patterns of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])
        for batch in batches:
            for cell, side, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != now:
                    if all(sides):
                        yield from of(*sides)
                    now, sides = cell, ([], [])
                sides[side].append(row)
        if all(sides):
            yield from of(*sides)

    return run


def in_cells(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """(cell, side, pos, cid, norm): groups of neighbours in the order meet in cells, each of one task. right None: of left
    with itself, each group with those from it on."""
    cores = left.sparkSession.sparkContext.defaultParallelism
    side = max(1, int((4 * cores) ** 0.5))
    a, m = grouped(left, side if right is not None else int(1.5 * side))
    b, n = (a, m) if right is None else grouped(right, side)
    columns = ["pos", "cid", "norm"]
    others = F.sequence("g", F.lit(m - 1)) if right is None else F.sequence(F.lit(0), F.lit(n - 1))
    texts = a.select("*", F.explode(others).alias("h")).select((F.col("g") * n + F.col("h")).alias("cell"), F.lit(0).alias("side"), *columns)
    others = F.sequence(F.lit(0), F.col("g")) if right is None else F.sequence(F.lit(0), F.lit(m - 1))
    patterns = b.select("*", F.explode(others).alias("h")).select((F.col("h") * n + F.col("g")).alias("cell"), F.lit(1).alias("side"), *columns)
    return texts.unionByName(patterns).repartitionByRange(m * (m + 1) // 2 if right is None else m * n, "cell").sortWithinPartitions("cell", "side", "pos")


def usual(strings: DataFrame) -> DataFrame:
    return strings.where(F.length("norm") <= LONG)


def long(strings: DataFrame) -> DataFrame:
    return strings.where(F.length("norm") > LONG)


def all_near(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """(s, r, score) of strings (cid, norm) within the threshold, by comparing all; right None: of left with itself, s below r.
    The distances of a cell are computed together. Strings of more than LONG characters are few as names go, and compared in
    rows."""
    cells = in_cells(usual(left), None if right is None else usual(right))
    met = cells.mapInArrow(cell_pairs(threshold, right is None), "s long, r long, score double")
    for t in (left, right):
        if t is None or not long(t).limit(1).count():
            continue
        if right is None:
            met = met.union(long_pairs(left, threshold))
        elif t is left:
            met = met.union(compared(measured(long(left), threshold), measured(right, threshold), F.lit(True)))
        else:
            met = met.union(compared(measured(usual(left), threshold), measured(long(right), threshold), F.lit(True)))
    return met


def long_pairs(strings: DataFrame, threshold: float) -> DataFrame:
    """(s, r, score) of strings of more than LONG characters with all strings, s below r."""
    met = compared(measured(long(strings), threshold), measured(strings, threshold), (F.col("r_l") <= LONG) | (F.col("s") < F.col("r")))
    return met.select(F.least("s", "r").alias("s"), F.greatest("s", "r").alias("r"), "score")


def near_rows(held: DataFrame, strings: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b, score) of all rows within the threshold, by comparing all strings. The ids (blocks) go along with the
    strings: pairs are about as many as the square of the strings, so joining ids to them would shuffle and sort them all."""
    every = held.join(strings.select("cid", "norm"), "cid").select(F.struct("cid", "block", "ids").alias("cid"), "norm")
    cells = in_cells(usual(every).select(F.col("cid.ids").alias("cid"), "norm"), None)
    out = cells.mapInArrow(cell_rows(threshold), "id_a long, id_b long, score double")
    if not long(strings).limit(1).count():
        return out
    own = long(every).select(F.col("cid").alias("s"), F.col("cid").alias("r"), F.lit(0.0).alias("score"), F.lit(True).alias("own"))
    met = long_pairs(every, threshold).withColumn("own", F.lit(False)).union(own)
    rows = met.select(F.explode("s.ids").alias("x"), F.col("r.ids").alias("ys"), "score", "own").select("x", F.explode("ys").alias("y"), "score", "own")
    rows = rows.where("CASE WHEN own THEN x < y ELSE score > 0 OR x <> y END")
    return out.union(rows.select(F.least("x", "y"), F.greatest("x", "y"), "score"))


def brute_pairs(strings: DataFrame, threshold: float, ok: Column | None) -> DataFrame:
    """(s, r, score) of different strings, s below r. ok: the pair rules, if there are any."""
    if ok is None:
        return all_near(strings, None, threshold)
    own = measured(strings, threshold)
    return compared(own, own, ok, half=True)


def candidates(strings: DataFrame, threshold: float, keys: list[str], order: str | None = None) -> DataFrame:
    """Pairs of rows that share a segment: keys as s_* of the shorter and r_* of the longer, with s, r and k, once
    for each segment. Of equally long ones, s is the smaller one by the key `order`, or by the string."""
    spark = strings.sparkSession
    lengths = [n for n in lengths_of(strings) if n]
    budget = {n: max_edits(n, threshold) for n in lengths}
    wanted = sorted({(small, big, k) for big in lengths for small in lengths if small <= big and big - (k := budget[big]) <= small and small > k})
    table = "small int, big int, k int"
    probe = spark.createDataFrame(wanted, table)
    build = spark.createDataFrame(sorted({(s, k) for s, _, k in wanted}), "small int, k int")
    rows = strings.withColumn("len", F.length("norm"))
    seg, k, small, big = (F.col(c) for c in ("seg", "k", "small", "big"))
    built = rows.join(build, rows["len"] == build["small"]).select("*", F.explode(F.sequence(F.lit(0), k)).alias("seg"))
    built = built.select("small", "k", "seg", F.substring(F.col("norm"), segment_start(small, k, seg) + 1, segment_length(small, k, seg)).alias("chunk"), F.col("norm").alias("s"), *[F.col(c).alias(f"s_{c}") for c in keys])
    probed = rows.join(probe, rows["len"] == probe["big"]).select("*", F.explode(F.sequence(F.lit(0), k)).alias("seg"))
    start, size, gap = segment_start(small, k, seg), segment_length(small, k, seg), big - small
    lo, hi = F.greatest(start - seg, start + gap - (k - seg), F.lit(0)), F.least(start + seg, start + gap + (k - seg), big - size)
    probed = probed.withColumns({"lo": lo, "hi": hi, "size": size}).where("lo <= hi").withColumn("pos", F.explode(F.sequence("lo", "hi")))
    probed = probed.select("small", "big", "k", "seg", F.substring(F.col("norm"), F.col("pos") + 1, F.col("size")).alias("chunk"), F.col("norm").alias("r"), *[F.col(c).alias(f"r_{c}") for c in keys])
    ordered = (F.col("small") < F.col("big")) | (F.col(f"s_{order}") < F.col(f"r_{order}") if order else F.col("s") < F.col("r"))
    met = built.join(probed, ["small", "k", "seg", "chunk"]).where(ordered)
    return met.select("k", "s", "r", *[f"{side}_{c}" for side in "sr" for c in keys])


def indexed_pairs(strings: DataFrame, threshold: float, ok: Column | None) -> DataFrame:
    """As brute_pairs."""
    names = strings.select("cid", "norm")
    found = candidates(settle(names.select("cid", "norm", *sketch(F.col("norm")))), threshold, ["cid", *SKETCH], "cid")
    # most that meet are too far apart: their sketches tell, before the pairs are shuffled to make each stand once
    near = found.where(may_match("s_", "r_", F.col("k"))).select(F.col("s_cid").alias("s"), F.col("r_cid").alias("r"), "k").distinct()
    both = near.join(names.toDF("s", "s_norm"), "s").join(names.toDF("r", "r_norm"), "r")
    met = both.withColumn("d", F.expr("levenshtein(s_norm, r_norm, k)")).where("d >= 0").where(F.lit(True) if ok is None else ok)
    return met.select("s", "r", (F.col("d") / F.greatest(F.length("s_norm"), F.length("r_norm"))).alias("score"))


def use_brute(strings: DataFrame, threshold: float, method: str) -> bool:
    """auto: all pairs from a half on, and where few strings take many edits each, so that segments would be short."""
    if threshold >= BRUTE_FROM or method == "brute":
        return True
    if method == "indexed":
        return False
    counts = strings.groupBy(F.length("norm").alias("n")).count().orderBy("n").collect()  # one row for each length
    total, seen = sum(r["count"] for r in counts), 0
    for r in counts:
        seen += r["count"]
        if seen > total // 2:
            return total < 2 or (max_edits(r["n"], threshold) >= 16 and total <= 20_000)
    return True


def meet_often(strings: DataFrame, threshold: float) -> bool:
    """Whether segments tell little apart, as in addresses that begin alike: told by some strings, and only ever by which way
    the pairs of all strings are found."""
    some = settle(strings.orderBy(F.xxhash64("norm")).limit(TRIED).select("cid", "norm"))
    n = some.count()
    return candidates(some, threshold, ["cid"], "cid").count() > OFTEN * n * (n - 1) / 2


def compare_all(strings: DataFrame, threshold: float, method: str) -> bool:
    """Up to FEW strings, and where most segments are common, comparing all costs less than the segments do; the result is
    the same."""
    return use_brute(strings, threshold, method) or (method == "auto" and (strings.limit(FEW + 1).count() <= FEW or meet_often(strings, threshold)))


def string_pairs(strings: DataFrame, threshold: float, method: str, ok: Column | None) -> DataFrame:
    return (brute_pairs if compare_all(strings, threshold, method) else indexed_pairs)(strings, threshold, ok)


def find_duplicates(names: DataFrame, threshold: float = 0.2, *, token_sort: bool = False, strip_suffixes: bool = False, turkish: bool = False, numbers_must_match: bool = False, word_threshold: float | None = None, method: str = "auto", id_col: str = "id", name_col: str = "name", null_as_empty: bool = False) -> DataFrame:
    """(id_a, id_b, score) of all pairs within the threshold, id_a below id_b."""
    rules = Rules(numbers_must_match, word_threshold, turkish)
    check_share("threshold", threshold)
    check_method(method)
    rows = normalized(names, Normal(token_sort, strip_suffixes, turkish), id_col, name_col, null_as_empty)
    rows = settle(rows)
    strings = numbered_strings(rows)
    held, ok, many = blocks(rows, strings), rule(rules), many_rows(strings)
    every = compare_all(strings, threshold, method)
    if every and ok is None and not many:
        return near_rows(held, strings, threshold)
    pairs = (brute_pairs if every else indexed_pairs)(strings, threshold, ok)
    different = spread(pairs, held, held, many)
    # rows of one string: the blocks of a string by twos, and each block's own rows by twos
    repeated = held.join(strings.where("rows > 1").select("cid"), "cid", "left_semi")
    twos = dealt(repeated.toDF("cid", "i", "xs").join(repeated.toDF("cid", "j", "ys"), "cid").where("i <= j"))
    equal = twos.select("i", "j", F.explode("xs").alias("x"), "ys").select("i", "j", "x", F.explode("ys").alias("y")).where("x < y OR (i < j AND x <> y)")
    out = different.unionByName(equal.select("x", "y", F.lit(0.0).alias("score")))
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "score")


def link(left: DataFrame, right: DataFrame, threshold: float = 0.2, *, token_sort: bool = False, strip_suffixes: bool = False, turkish: bool = False, numbers_must_match: bool = False, word_threshold: float | None = None, method: str = "auto", id_col: str = "id", name_col: str = "name", null_as_empty: bool = False) -> DataFrame:
    """(id_left, id_right, score) of all pairs across the two tables within the threshold."""
    check_share("threshold", threshold)
    check_method(method)
    rules = Rules(numbers_must_match, word_threshold, turkish)
    options = Normal(token_sort, strip_suffixes, turkish)
    a, b = (settle(normalized(t, options, id_col, name_col, null_as_empty)) for t in (left, right))
    strings = numbered_strings(a.select("norm").union(b.select("norm")))
    pairs = string_pairs(strings, threshold, method, rule(rules))
    pairs = settle(pairs) if (many := many_rows(strings)) else pairs
    both = pairs.union(pairs.select("r", "s", "score")).union(strings.select("cid", "cid", F.lit(0.0)) if many else dealt(strings.select("cid", "cid", F.lit(0.0))))
    return spread(both, blocks(a, strings), blocks(b, strings), many).toDF("id_left", "id_right", "score")


def cluster(names: DataFrame, threshold: float = 0.2, **options) -> DataFrame:
    """(group_id, id): connected groups of at least two; group_id is the smallest id of the group."""
    pairs = find_duplicates(names, threshold, **options)
    return components(pairs.select("id_a", "id_b"), "id_a", "id_b").select(F.col("component").alias("group_id"), F.col("node").alias("id"))


def groups(clusters: DataFrame) -> DataFrame:
    """(group_id, ids) with sorted members."""
    return clusters.groupBy("group_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def numbered(clusters: DataFrame) -> DataFrame:
    """Groups numbered from 1 in order of their first member."""
    firsts = clusters.select("group_id").distinct()
    order = firsts.withColumn("group", F.dense_rank().over(Window.orderBy("group_id")))
    return clusters.join(order, "group_id").select("group", "id")


def stats(names: DataFrame, threshold: float = 0.2, *, token_sort: bool = False, strip_suffixes: bool = False, turkish: bool = False, numbers_must_match: bool = False, word_threshold: float | None = None, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """One row: found (after rules), verified (pairs that the index compares, before rules), all_pairs."""
    check_share("threshold", threshold)
    rules = Rules(numbers_must_match, word_threshold, turkish)
    rows = settle(normalized(names, Normal(token_sort, strip_suffixes, turkish), id_col, name_col))
    found, n = pairs_of_rows(rows, threshold, rules), rows.count()
    if threshold >= BRUTE_FROM or n < 2:
        verified = n * (n - 1) // 2
    else:
        empties = rows.where("norm = ''").count()
        verified = meetings(rows, threshold) + empties * (empties - 1) // 2
    return names.sparkSession.createDataFrame([(found, verified, n * (n - 1) // 2)], "found long, verified long, all_pairs long")


def pairs_of_rows(rows: DataFrame, threshold: float, rules: Rules) -> int:
    """How many pairs find_duplicates gives, without making them."""
    strings = numbered_strings(rows)
    pairs = string_pairs(strings, threshold, "auto", rule(rules))
    times = strings.where("rows > 1")
    for end in "sr":  # most strings have one row
        pairs = pairs.join(times.select(F.col("cid").alias(end), F.col("rows").alias(f"n_{end}")), end, "left")
    different = pairs.agg(F.sum(F.coalesce("n_s", F.lit(1)) * F.coalesce("n_r", F.lit(1)))).first()[0] or 0
    twos = lambda n: n * (n - 1) / 2
    equal = rows.groupBy("norm", "id").count().groupBy("norm").agg((twos(F.sum("count")) - F.sum(twos(F.col("count")))).cast("long").alias("n"))
    return different + (equal.agg(F.sum("n")).first()[0] or 0)


def meetings(rows: DataFrame, threshold: float) -> int:
    """How many pairs of rows share a segment (candidates), each once. They are told cell by cell and only counted. Where an id
    stands twice, or a name has more than LONG characters, its pairs are made and counted as different ones."""
    made = lambda some: candidates(some, threshold, ["id"], "id")
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        return made(rows).select("s_id", "r_id").distinct().count()
    usual = rows.where(F.length("norm").between(1, LONG)).withColumnRenamed("id", "cid")
    n = in_cells(usual, None).mapInArrow(by_cell(cell_meetings(threshold)), "n long").agg(F.sum("n")).first()[0] or 0
    if rows.where(F.length("norm") > LONG).limit(1).count():
        near_long = rows.where(F.length("norm") >= int(LONG * (1 - threshold)) - 1)
        n += made(near_long).where(F.length("r") > LONG).select("s_id", "r_id").distinct().count()
    return n


def cell_meetings(threshold: float):
    """The number of pairs of a cell that share a segment."""

    def by_length(rows: list[tuple]) -> dict[int, tuple]:
        """Of each length the places, the numbers and the characters of its strings."""
        out: dict[int, list] = {}
        for row in rows:
            out.setdefault(len(row[2]), []).append(row)
        return {n: (np.array([r[0] for r in some]), np.array([r[1] for r in some]), code_points([r[2] for r in some])[0].reshape(-1, n)) for n, some in out.items()}

    def met(small: np.ndarray, big: np.ndarray, k: int) -> np.ndarray:
        """Whether a segment of each of the small strings stands in each of the big ones where k edits allow it."""
        out = np.zeros((len(small), len(big)), bool)
        for start, size, lo, hi in segment_places(small.shape[1], big.shape[1], k):
            if lo > hi:
                continue
            parts = [small[:, start : start + size], *(big[:, p : p + size] for p in range(lo, hi + 1))]
            raw = np.ascontiguousarray(np.concatenate(parts)).view(f"V{4 * size}").ravel()
            code = np.unique(raw, return_inverse=True)[1].astype(np.int32)
            own, rest = code[: len(small)], code[len(small) :].reshape(-1, len(big))
            for at in range(0, len(small), 256):
                for there in rest:
                    out[at : at + 256] |= own[at : at + 256, None] == there
        return out

    def of(texts: list[tuple], patterns: list[tuple]) -> Iterator[pa.RecordBatch]:
        n = 0
        right = by_length(patterns)
        for a, (at, cid, x) in by_length(texts).items():
            for b, (to, other, y) in right.items():
                k = max_edits(max(a, b), threshold)
                if min(a, b) < max(a, b) - k or min(a, b) <= k:
                    continue
                share = met(x, y, k) if a <= b else met(y, x, k).T
                if a == b:  # the smaller id's segments
                    share = np.where(cid[:, None] < other, share, met(y, x, k).T)
                if texts[-1][0] >= patterns[0][0]:
                    share = share & (at[:, None] < to)
                n += int(share.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return of


def pair_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, precision, recall and f1 of (id_a, id_b) pairs; 0 where there is nothing to divide by."""
    tp = found.join(truth, ["id_a", "id_b"], "left_semi").count()
    n, m = found.count(), truth.count()
    p, r = (tp / n if n else 0.0), (tp / m if m else 0.0)
    return found.sparkSession.createDataFrame([(tp, p, r, 2 * p * r / (p + r) if p + r else 0.0)], "tp long, precision double, recall double, f1 double")


def truth_pairs(labelled: DataFrame, entity_col: str = "entity", id_col: str = "id") -> DataFrame:
    a = labelled.select(F.col(entity_col).alias("e"), F.col(id_col).alias("id_a"))
    b = labelled.select(F.col(entity_col).alias("e"), F.col(id_col).alias("id_b"))
    return a.join(b, "e").where("id_a < id_b").select("id_a", "id_b")
