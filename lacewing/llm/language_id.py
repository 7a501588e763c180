"""Language identification by Bayesian evidence fusion.

For each page the log probabilities of each language add up from: the text, under hashed byte-trigram models; the language
its markup declares; the suffix of its address; and a prior of its host. Host priors are smoothed hierarchically: a host's
counts towards its domain's shares, those towards the shares of all pages; counts are of the languages that the texts alone
say, by grouped aggregation, and a page's own vote is taken out of them before it is judged.

Null or empty markup: no text, so the other evidence decides. Null addresses have no suffix and the prior of all pages.
Rows without a language do not train. Null ids are carried. Repeated rows count as often as they stand. An empty table
gives no rows; without training rows the language is null. Other columns are not read. Only the trigram models (languages
times 65,536) and the languages' counts are shipped; page counts by host, domain and suffix are joined.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, lean_map, settle

BUCKETS = 1 << 16
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))
_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_MULTIPLE_SUFFIX = r"(?:co|com|org|net|ac|gov)\.[a-z]{2}"  # second-level suffixes of countries


def visible_text(markup: str | None) -> str:
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", markup or "")))


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of the letters, runs of other ASCII characters being one space."""
    raw = np.frombuffer(b" " + b" ".join(text.translate(LOWER).split()) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    t = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return ((t * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each bucket in each, from all labelled rows."""
    schema = arrow_schema("lang string, bucket int, n long")

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS, np.int64)
                np.add.at(total[lang], trigrams(text.as_py() or b""), 1)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], schema=schema)

    rows_in = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counted = lean_map(rows_in, run, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    n = np.full((len(langs), BUCKETS), 0.5)
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        n[k, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(n / n.sum(axis=1, keepdims=True)) if langs else n


def text_evidence(text: bytes, model: np.ndarray, most: float) -> np.ndarray:
    """Log likelihoods; neighbouring trigrams are not independent, so at most `most` count in full."""
    at = trigrams(text)
    return model[:, at].mean(axis=1) * min(len(at), most) if len(at) else np.zeros(len(model))


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def domain_of(host: Column) -> Column:
    found = F.regexp_extract(host, rf"([^.]+\.(?:{_MULTIPLE_SUFFIX}|[^.]+))$", 1)
    return F.when(found != "", found).otherwise(host)


def suffix_of(host: Column) -> Column:
    found = F.regexp_extract(host, r"\.([^.]+)$", 1)
    return F.when(found != "", found)


def identify(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", markup_col: str = "html", text_col: str = "text", lang_col: str = "lang", most: float = 40.0, declared_right: float = 0.9, weight: float = 5.0) -> DataFrame:
    """For each page: its id as page_id, host, declared, text_lang (what the text alone says), lang and probability.

    most: trigrams that count in full; declared_right: how often a declared language is right; weight: votes that a level
    of the hierarchy above is worth.
    """
    spark = pages.sparkSession
    langs, model = train(labelled, text_col, lang_col)
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(markup_col).cast("string").alias("markup"))
    if not langs:
        return out.select("page_id", host_of(F.col("url")).alias("host"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    shipped = spark.sparkContext.broadcast(model.astype(np.float32))

    def read(batch):
        said = [text_evidence(visible_text(m).encode(), shipped.value, most) for m in batch["markup"].to_pylist()]
        return {"page_id": batch["page_id"], "url": batch["url"], "declared": batch["declared"], "said": [s.tolist() for s in said]}

    kind = dict(out.dtypes)["page_id"]
    declared = F.lower(F.regexp_extract("markup", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    told = arrow_map(out.withColumn("declared", F.when(declared != "", declared)), read, f"page_id {kind}, url string, declared string, said array<double>")
    host = host_of(F.col("url"))
    told = told.withColumns({"host": host, "domain": domain_of(host), "suffix": suffix_of(host), "best": F.array_max("said")})
    vote = F.when(F.array_min("said") == F.col("best"), F.lit(None)).otherwise(F.array_position("said", F.col("best")) - 1).cast("int")
    told = settle(told.withColumn("vote", vote))
    n = len(langs)

    def votes(key: str) -> DataFrame:
        counts = [F.count_if(F.col("vote") == k).cast("double") for k in range(n)]
        return settle(told.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*counts).alias(f"{key}_votes")))

    all_votes = told.agg(*[F.count_if(F.col("vote") == k) for k in range(n)]).first()
    overall = [(v + 1) / (sum(all_votes) + n) for v in all_votes]
    joined = told
    for key in ("host", "domain", "suffix"):
        joined = joined.join(votes(key), key, "left")

    def smoothed(key: str, above: Column) -> Column:
        """Shares of the languages under the key, without the page's own vote."""
        had = F.coalesce(F.col(f"{key}_votes"), F.array(*[F.lit(0.0)] * n))
        own = F.transform(had, lambda v, k: v - F.when(F.col(key).isNotNull() & F.col("vote").eqNullSafe(k), 1.0).otherwise(0.0))
        total = F.aggregate(own, F.lit(0.0), lambda a, v: a + v)
        return F.transform(own, lambda v, k: (v + weight * F.get(above, k)) / (total + weight))

    everywhere = F.array(*[F.lit(float(p)) for p in overall])
    names = F.array(*[F.lit(x) for x in langs])
    known = F.coalesce(F.array_contains(names, F.col("declared")), F.lit(False))
    right = F.transform(names, lambda x, k: F.when(~known, 0.0).when(x == F.col("declared"), float(np.log(declared_right))).otherwise(float(np.log((1 - declared_right) / max(1, n - 1)))))
    joined = joined.withColumns({"by_domain": smoothed("domain", everywhere), "by_suffix": smoothed("suffix", everywhere), "by_declared": right})
    joined = joined.withColumn("by_host", smoothed("host", F.col("by_domain")))
    # the suffix speaks as a likelihood: its shares against those of all pages
    score = F.transform("said", lambda s, k: s - F.col("best") + F.get("by_declared", k) + F.log(F.get("by_host", k)) + F.log(F.get("by_suffix", k)) - F.log(F.get(everywhere, k)))
    joined = joined.withColumn("score", score).withColumn("top", F.array_max("score"))
    mass = F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top")))
    return joined.select("page_id", "host", "declared", F.get(names, F.col("vote")).alias("text_lang"), F.get(names, F.array_position("score", F.col("top")).cast("int") - 1).alias("lang"), (1 / mass).alias("probability"))
