"""A persistent, incremental index of names: names and segments as Parquet, settings beside them. One writer at a time; new
rows are written first and the settings last, and rows that the settings do not count are not read."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.functions.options import Normal, Rules, check_share
from lacewing.functions.text import normalize
from lacewing.plans.budget import max_edits, segment_length, segment_start, stored_budgets
from lacewing.plans.numbering import numbered_rows
from lacewing.plans.tables import settle

from .matching import BRUTE_FROM, OFTEN, all_near, blocks, compared, lengths_of, measured, numbered_strings, rule, spread

FORMAT, VERSION = "lacewing-index", 1
TRIED = 100  # strings that are looked up first, to tell whether segments tell little apart


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.2
    token_sort: bool = False
    strip_suffixes: bool = False
    turkish: bool = False
    numbers_must_match: bool = False
    word_threshold: float | None = None

    def __post_init__(self):
        check_share("threshold", self.threshold)
        self.rules  # noqa: B018

    @property
    def normal(self) -> Normal:
        return Normal(self.token_sort, self.strip_suffixes, self.turkish)

    @property
    def rules(self) -> Rules:
        return Rules(self.numbers_must_match, self.word_threshold, self.turkish)


class NameIndex:
    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.path, self.settings, self.size = spark, path.rstrip("/"), settings, 0
        self._batches: list[str] = []
        self._firsts: list[int] = []  # the first id of each batch

    @classmethod
    def build(cls, names: DataFrame, path: str, settings: Settings = Settings(), id_col: str = "id", name_col: str = "name") -> NameIndex:
        """Names get the ids 0, 1, ... in order of id_col."""
        found = cls(names.sparkSession, path, settings)
        found.add(names, id_col, name_col)
        return found

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> NameIndex:
        """The index as its last complete write left it; each write leaves settings of its own, so none is ever replaced."""
        written = [json.loads(r[0]) for r in spark.read.text(f"{path.rstrip('/')}/meta/*").toLocalIterator()]
        raw = max(written, key=lambda x: len(x.get("batches", ())), default={})
        if raw.get("format") != FORMAT or raw.get("version") != VERSION:
            raise ValueError(f"{path} is not a {FORMAT} v{VERSION} index")
        out = cls(spark, path, Settings(**raw["settings"]))
        out.size, out._batches, out._firsts = raw["size"], raw["batches"], raw["firsts"]
        return out

    def before(self, batch: str) -> NameIndex:
        """The index without that batch and later ones; all of it where it holds no such batch."""
        out = NameIndex(self.spark, self.path, self.settings)
        n = self._batches.index(batch) if batch in self._batches else len(self._batches)
        out._batches, out._firsts, out.size = self._batches[:n], self._firsts[:n], ([*self._firsts, self.size])[n]
        return out

    def __len__(self) -> int:
        return self.size

    def add(self, names: DataFrame, id_col: str = "id", name_col: str = "name", batch: str | None = None) -> int:
        """The first of the new, consecutive ids. Names already there are not indexed again; of equal ones in a batch, the
        segments hold the first. A batch that has a name is added
        once, however often it is handed over."""
        if batch in self._batches:
            return self._firsts[self._batches.index(batch)]
        first, batch = self.size, batch or uuid.uuid4().hex
        ordered = names.select(F.col(id_col).alias("o"), F.col(name_col).cast("string").alias("name")).orderBy("o", "name")
        rows = numbered_rows(ordered.select("name"), first)
        rows.withColumn("norm", normalize(F.col("name"), self.settings.normal)).write.mode("overwrite").parquet(f"{self.path}/names/{batch}")
        added = self.spark.read.parquet(f"{self.path}/names/{batch}")
        count = added.count()
        if self.settings.threshold < BRUTE_FROM and count:
            self._segments(added.groupBy("norm").agg(F.min("id").alias("id"))).write.mode("overwrite").parquet(f"{self.path}/segments/{batch}")
        self.size += count
        self._batches.append(batch)
        self._firsts.append(first)
        meta = {"format": FORMAT, "version": VERSION, "size": self.size, "batches": self._batches, "firsts": self._firsts, "settings": asdict(self.settings)}
        self.spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta/{len(self._batches)}")
        return first

    def _segments(self, rows: DataFrame) -> DataFrame:
        table = [(n, k) for n in lengths_of(rows) for k in stored_budgets(n, self.settings.threshold)]
        build = self.spark.createDataFrame(table, "len int, k int")
        cut = rows.withColumn("len", F.length("norm")).join(build, "len").select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("seg"))
        length, k, seg = F.col("len"), F.col("k"), F.col("seg")
        return cut.select("len", "k", "seg", F.substring(F.col("norm"), segment_start(length, k, seg) + 1, segment_length(length, k, seg)).alias("chunk"), "id")

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{table}/{b}" for b in self._batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths and self.size else self.spark.createDataFrame([], schema)

    def names(self) -> DataFrame:
        """(id, name), raw, in order of id."""
        return self._read("names", "id long, name string, norm string").select("id", "name").orderBy("id")

    def query(self, name: str) -> DataFrame:
        """(id, score) of the stored names that match, in order of id."""
        one = self.spark.createDataFrame([(0, name)], "id long, name string")
        return self.hits(one).select("id", "score").orderBy("id")

    def query_many(self, names: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
        """(query_id, hits): for each row the sorted array of (id, score), empty where nothing matches."""
        asked = self._asked(names, id_col, name_col)
        strings, found = self._found(asked)
        # once for each different name, however many rows ask for it
        found = found.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("h"))
        told = strings.join(found, strings["cid"] == found["s"]).select("norm", "h")
        return asked.join(told, "norm", "left").select(F.col("id").alias("query_id"), F.coalesce("h", F.array().cast("array<struct<id:bigint,score:double>>")).alias("hits"))

    def query_rows(self, names: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
        """(query_id, id, score): a row for each hit of query_many, and one with nulls for a row without hits. The rows of a
        name and those that it finds go in blocks, so hits are made where they are returned."""
        asked = settle(self._asked(names, id_col, name_col))
        strings, pairs, held = self._pairs(asked)
        pairs = settle(pairs)
        found = strings.join(pairs, strings["cid"] == pairs["s"], "left_semi").select("norm")
        none = asked.join(found, "norm", "left_anti").select(F.col("id").alias("query_id"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score"))
        rows = blocks(asked.where("norm IS NOT NULL"), strings)
        return spread(pairs, rows, held.withColumnRenamed("r", "cid"), True).toDF("query_id", "id", "score").unionByName(none)

    def hits(self, names: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
        """(query_id, id, score)."""
        asked = self._asked(names, id_col, name_col).distinct()
        strings, found = self._found(asked)
        rows = asked.join(strings, "norm").select(F.col("id").alias("query_id"), F.col("cid").alias("s"))
        return found.join(rows, "s").select("query_id", "id", "score")

    def _asked(self, names: DataFrame, id_col: str, name_col: str) -> DataFrame:
        return names.select(F.col(id_col).cast("long").alias("id"), normalize(F.col(name_col).cast("string"), self.settings.normal).alias("norm"))

    def _found(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The different names asked for, by number, and (s, id, score) of what each finds."""
        strings, pairs, held = self._pairs(asked)
        return strings, pairs.join(held, "r").select("s", F.explode("ids").alias("id"), "score")

    def _pairs(self, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The different names asked for, by number, the pairs (s, r, score) of one and a stored name within the threshold, and
        (r, ids), the ids of each stored name. Equal stored names are compared once."""
        t, rules = self.settings.threshold, self.settings.rules
        stored = self._read("names", "id long, name string, norm string").select("id", "norm")
        strings = numbered_strings(asked.where("norm IS NOT NULL"))
        ok = rule(rules)
        if t >= BRUTE_FROM or self._meets_often(strings):
            rows = stored.where("norm IS NOT NULL")
            held = numbered_strings(rows)
            pairs = all_near(strings, held, t) if ok is None else compared(measured(strings, t), measured(held, t), ok)
            return strings, pairs, blocks(rows, held).select(F.col("cid").alias("r"), "ids")
        met = self._meet(strings).unionByName(strings.where("norm = ''").select(F.col("cid").alias("s")).join(stored.where("norm = ''").select("id"))).distinct()
        met = met.join(stored.withColumnRenamed("norm", "r_norm"), "id").join(strings.select(F.col("cid").alias("s"), F.col("norm").alias("s_norm")), "s").select("s", "s_norm", "r_norm").distinct()
        longest = F.greatest(F.length("s_norm"), F.length("r_norm"))
        score = F.when(longest == 0, F.lit(0.0)).otherwise(F.expr(f"levenshtein(s_norm, r_norm, cast({t!r} * greatest(length(s_norm), length(r_norm)) as int) + 1)") / longest)
        pairs = met.withColumn("score", score).where((F.col("score") >= 0) & (F.col("score") <= F.lit(t))).where(F.lit(True) if ok is None else ok).select("s", F.col("r_norm").alias("r"), "score")
        return strings, pairs, stored.select(F.col("norm").alias("r"), F.array("id").alias("ids"))

    def _meets_often(self, strings: DataFrame) -> bool:
        """Whether the segments of many names are common, so that comparing all costs less; the result is the same."""
        if strings.limit(TRIED + 1).count() <= TRIED:
            return False
        return self._meet(settle(strings.orderBy(F.xxhash64("norm")).limit(TRIED))).count() > OFTEN * TRIED * self.size

    def _meet(self, asked: DataFrame) -> DataFrame:
        """(s, id) that share a segment, s the number of a name asked for, once for each segment; either side may be the
        longer, so places go k to both sides."""
        t = self.settings.threshold
        table = []
        for n in lengths_of(asked):
            k_n, m = max_edits(n, t), max(1, n - max_edits(n, t))
            while n and m - max_edits(m, t) <= n:
                table.append((n, m, k_n if m <= n else max_edits(m, t)))
                m += 1
        probe = self.spark.createDataFrame(table, "n int, len int, k int")
        seg, k, length = F.col("seg"), F.col("k"), F.col("len")
        rows = asked.withColumn("n", F.length("norm")).join(probe, "n").select("*", F.explode(F.sequence(F.lit(0), k)).alias("seg"))
        start, size = segment_start(length, k, seg), segment_length(length, k, seg)
        rows = rows.withColumns({"lo": F.greatest(start - k, F.lit(0)), "hi": F.least(start + k, F.col("n") - size), "size": size}).where("lo <= hi").withColumn("pos", F.explode(F.sequence("lo", "hi")))
        rows = rows.select(F.col("cid").alias("s"), "len", "k", "seg", F.substring(F.col("norm"), F.col("pos") + 1, F.col("size")).alias("chunk")).distinct()
        return rows.join(self._read("segments", "len int, k int, seg int, chunk string, id long"), ["len", "k", "seg", "chunk"]).select("s", "id")

    def export_json(self) -> str:
        """Settings and names as the interchange JSON; for indexes that fit the driver."""
        return json.dumps({"format": FORMAT, "version": VERSION, **asdict(self.settings), "names": [r["name"] for r in self.names().toLocalIterator()]}, ensure_ascii=False)

    @classmethod
    def import_json(cls, spark: SparkSession, text: str, path: str) -> NameIndex:
        raw = json.loads(text)
        if raw.get("format") != FORMAT or raw.get("version") != VERSION:
            raise ValueError(f"not a {FORMAT} v{VERSION} file")
        keys = Settings.__dataclass_fields__
        names = spark.createDataFrame(list(enumerate(raw["names"])), "id long, name string")
        return cls.build(names, path, Settings(**{k: raw[k] for k in keys if k in raw}))

    def __repr__(self) -> str:
        return f"NameIndex(names={self.size:,}, {', '.join(f'{k}={v!r}' for k, v in asdict(self.settings).items())})"
