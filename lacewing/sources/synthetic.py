"""Made-up company names with messy copies, from hashes of their ids: the same rows on every run, made where they are used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BRANDS = "Amber Birch Cedar Coral Dawn Eagle Falcon Glacier Harbor Iris Jasper Kestrel Lagoon Maple Nimbus Onyx Pine Quartz River Sable Topaz Umber Violet Willow Çınar Güneş Işık Şahin".split()
TRADES = "Bakery Cargo Dairy Ceramics Fabrics Glass Hardware Insurance Leather Marine Optics Paper Robotics Shipping Timber Travel Gıda İplik Mobilya Yapı".split()
TAILS = ["Ltd", "Ltd.", "Inc.", "LLC", "GmbH", "A.Ş.", "Ltd. Şti.", "Corp", "Works", ""]
COPIES = 0.35  # the share of rows that are messy copies of an earlier company


def _draw(seed: int, salt: int, of: Column, n: int | Column) -> Column:
    """A number from 0 to n - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), of), n if isinstance(n, Column) else F.lit(n))


def _pick(words: list[str], seed: int, salt: int, of: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (_draw(seed, salt, of, len(words)) + 1).cast("int"))


def company(entity: Column, seed: int = 7) -> Column:
    """One or two brands, one or two trades, and mostly a legal tail."""
    maybe = lambda words, salt, percent: F.when(_draw(seed, salt + 1, entity, 100) < percent, _pick(words, seed, salt, entity))
    return F.rtrim(F.concat_ws(" ", _pick(BRANDS, seed, 1, entity), maybe(BRANDS, 2, 50), _pick(TRADES, seed, 4, entity), maybe(TRADES, 5, 30), _pick(TAILS, seed, 7, entity)))


def messy(name: Column, of: Column, seed: int = 7) -> Column:
    """A copy as it stands in a careless list: a typo, capitals, spaces, without its last word, or with its words turned."""
    at = (_draw(seed, 11, of, F.length(name)) + 1).cast("int")
    head, here, tail = F.substring(name, F.lit(1), at - 1), F.substring(name, at, F.lit(1)), F.substring(name, at + 1, F.length(name))
    nxt, rest = F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 2, F.length(name))
    typos = [F.concat(head, tail), F.concat(head, nxt, here, rest), F.concat(head, here, here, tail), F.concat(head, _pick(list("aeiounrst"), seed, 12, of), tail)]
    words = F.split(name, " ")
    others = [F.upper(name), F.concat(F.lit("  "), F.regexp_replace(name, " ", "  "), F.lit(" ")), F.when(F.size(words) > 2, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(name), F.array_join(F.reverse(words), " ")]
    kinds = [*typos, *(x for x in others for _ in range(3))]
    kind = _draw(seed, 13, of, len(kinds))
    return reduce(lambda out, k: F.when(kind == k, kinds[k]).otherwise(out), range(1, len(kinds)), kinds[0])


def names(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """(id, name, entity): entity is the id whose company a row names, its own but for messy copies."""
    i = F.col("id")
    copy = (i > 0) & (_draw(seed, 21, i, 1000) < int(1000 * COPIES))
    rows = spark.range(n).withColumn("entity", F.when(copy, _draw(seed, 22, i, F.greatest(i, F.lit(1)))).otherwise(i))
    clean = company(F.col("entity"), seed)
    return rows.select("id", F.when(copy, messy(clean, i, seed)).otherwise(clean).alias("name"), "entity")


def variant(rows: DataFrame, copies: int, seed: int = 7, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """(entity, copy, name): each name and so many messy copies of it; entity is its id."""
    each = rows.select(F.col(id_col).cast("long").alias("entity"), F.col(name_col).alias("name"), F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("copy"))
    return each.select("entity", "copy", F.when(F.col("copy") == 0, F.col("name")).otherwise(messy(F.col("name"), F.struct("entity", "copy"), seed)).alias("name"))
