"""Host-level quality rules, in DataFrame functions only.

Each document is measured once. Failures of the soft rules are counted by host; each host's rate is shrunk towards a beta
prior that is fitted to all hosts by moments; the verdict on a host is joined back to its documents.

Null text: no words, so the base rule fails. Empty text: the same. A null host is a host of its own, whose verdict is never
to reject. Repeated rows count as often as they stand. Null ids are carried. An empty table gives an empty result. Other
columns are not read, so their names cannot clash. A document costs time n log n in its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

SPACE = r"[\x20\x09-\x0D]+"


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words inside windows of so many words that stand twice or more in the array, first included."""
    starts = F.when(F.size(words) >= window, F.sequence(F.lit(0), F.size(words) - window)).otherwise(F.array().cast("array<int>"))
    hashed = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(window)]).alias("h"), i.alias("i"))))
    return hashed


def covered(hashed: Column, window: int = 3) -> Column:
    """From the sorted (hash, start) pairs: how many positions the windows with a hash seen twice cover."""
    same = lambda i, k: F.get(hashed, i + k)["h"].eqNullSafe(F.get(hashed, i)["h"])
    twice = F.filter(hashed, lambda x, i: ((i > 0) & same(i, -1)) | same(i, 1))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(starts, zero, lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(window), s - acc["last"])).alias("n")))["n"]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the rules' measures of each document, from its whole text, and its row as a struct."""
    ws = " \t\n\x0b\x0c\r"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"), F.struct("*").alias("row"))
    bare = F.btrim(F.col("text"), F.lit(ws))
    df = df.select("doc_id", "host", "row", "text", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)).alias("words"), F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(ws)) != "").alias("lines"))
    df = df.select("doc_id", "host", "row", "text", F.size("words").cast("long").alias("n_words"), "lines", repeated_words(F.col("words")).alias("windows"))
    return df.select(
        "doc_id", "host", "row", "n_words",
        (F.length("text") - F.length(F.regexp_replace("text", r"[^\x20\x09-\x0D]", ""))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("windows")).alias("n_repeat_words"),
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rate_limit: float = 0.3, prior_limit: float = 1000.0, rows: bool = False) -> DataFrame:
    """One row for each document: its measures, base_failed, soft_failed, host_rejected and kept.

    Soft rules: symbols over a tenth of the characters in words; over half the lines repeated; words of under 2 or over 15
    characters on average. A host whose shrunk rate of soft failures is over rate_limit is rejected: of its documents those
    go that fail a soft rule themselves. prior_limit bounds the weight of the prior, in documents. rows: carry the document's
    own row along as the struct `row`, so that no join brings it back.
    """
    facts = measure(docs, id_col, text_col, host_col)
    facts = facts if rows else facts.drop("row")
    n, soft = F.col("n_words"), (10 * F.col("n_symbols") > F.col("word_chars")) | (2 * F.col("n_dup_lines") > F.col("n_lines")) | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))
    facts = settle(facts.withColumns({"base_failed": (n < 50) | (100 * F.col("n_repeat_words") > 50 * n), "soft_failed": soft & (n > 0)}))
    hosts = settle(facts.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("soft_failed").cast("long")).alias("failed")))
    rate = F.col("failed") / F.col("docs")
    mean, var = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    weight = beta_weight(mean, var, prior_limit)
    shrunk = (F.col("failed") + F.lit((mean or 0.0) * weight)) / (F.col("docs") + F.lit(weight))
    verdicts = hosts.select("host", (shrunk > rate_limit).alias("rejected"))
    out = facts.join(verdicts, "host", "left").withColumn("host_rejected", F.coalesce("rejected", F.lit(False))).drop("rejected")
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_rejected") & F.col("soft_failed")))


def beta_weight(mean: float | None, var: float | None, most: float) -> float:
    """alpha + beta of the beta distribution with this mean and variance, between 1 and most."""
    if mean is None or not var:
        return most
    return min(most, max(1.0, mean * (1 - mean) / var - 1))


SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT *, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams FROM w),
u AS (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM g),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM u) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
f AS (SELECT doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM g LEFT JOIN c USING (doc_id)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words > 0 AND (10 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS soft_failed FROM f),
h AS (SELECT host, count(*)::DOUBLE AS docs, sum(soft_failed::INT)::DOUBLE AS failed FROM s WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT avg(failed / docs) AS mean, var_pop(failed / docs) AS var FROM h),
p AS (SELECT mean, CASE WHEN var > 0 THEN least(1000.0, greatest(1.0, mean * (1 - mean) / var - 1)) ELSE 1000.0 END AS weight FROM m),
v AS (SELECT host, (failed + mean * weight) / (docs + weight) > 0.3 AS rejected FROM h, p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(rejected, FALSE) AND soft_failed) AS kept
FROM s LEFT JOIN v USING (host)
"""
