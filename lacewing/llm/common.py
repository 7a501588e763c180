"""What the operators share: written tables that cut lineage, packed texts, word hashes."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lacewing.plans.tables import discard, passing, settle, shared_dir

#: A null doc_id counts as the largest id of all; it is given back as null.
NO_ID = (1 << 63) - 1
#: Rows in a batch for Python workers: a few MB of ordinary texts.
ROWS, BATCH_ROWS = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def id_or_last(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_or_null(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != NO_ID, column)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, tkey, text): the columns that the operators read, whatever else docs has. did has NO_ID for null; (did, tkey)
    names a row, rows equal in both being the same."""
    return docs.select(id_or_last(id_col).alias("did"), F.xxhash64(F.col(text_col)).alias("tkey"), F.col(text_col).cast("string").alias("text"))


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict] | list[dict] | dict], schema: str | StructType) -> DataFrame:
    """mapInArrow for functions that give dicts of columns for a batch."""
    to = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = f(batch)
            for x in [out] if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_arrays([as_arrow(x[k.name], k.type) for k in to], schema=to)

    return lean_map(df, run, schema)


def lean_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of at most ROWS rows (a lower setting of the session stays), whose worker gives its free
    memory back at the end of a task: workers live on, and what they hold would add up over the operators of a session."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_ROWS, "10000")) <= ROWS:
        conf.set(BATCH_ROWS, str(ROWS))

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_schema(kind: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(kind) if isinstance(kind, str) else kind)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, kind)


def pack(docs: DataFrame) -> DataFrame:
    """(did, tkey, z, size): texts as zstd frames, a third of their size in a shuffle; null for a null text."""

    def run(batch):
        raw = batch["text"].cast(pa.binary()).to_pylist()
        z = [None if t is None else pa.compress(t, codec="zstd", asbytes=True) for t in raw]
        return {"did": batch["did"], "tkey": batch["tkey"], "z": z, "size": [len(t or b"") for t in raw]}

    return arrow_map(docs, run, "did long, tkey long, z binary, size long")


def unpack(z: bytes | None, size: int) -> bytes:
    return b"" if z is None or not size else pa.decompress(z, decompressed_size=size, codec="zstd", asbytes=True)


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(raw: bytes | None) -> list[bytes]:
    """bytes.split without argument parts at just these six characters."""
    return [] if raw is None else raw.split()


class WordHashes(dict):
    """64-bit hash of each word as 8 bytes; starts anew at LIMIT words, so its memory is bounded."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> bytes:
        import hashlib

        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = hashlib.blake2b(word, digest_size=8).digest()
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u8")


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return _hashes.of(words)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of each 64-bit hash."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def rolled(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of the k symbols from each position on, built by doubling; the last k-1 entries are no
    full windows."""
    out, done, cur, length, b = None, 0, h, 1, base % 2**64
    while True:
        if k & 1:
            if out is None:
                out, done = cur.copy(), length
            else:
                out = out * np.uint64(b)
                if done < len(cur):
                    out[:-done] += cur[done:]
                done += length
        k >>= 1
        if not k:
            return out
        nxt = cur * np.uint64(b)
        if length < len(cur):
            nxt[:-length] += cur[length:]
        cur, length, b = nxt, length * 2, b * b % 2**64
