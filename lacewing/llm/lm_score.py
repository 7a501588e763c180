"""Language-model scoring by online logistic context mixing.

A text is coded token after token. Each token has a class of eight bits: the kind of text in which its word mostly stands
(its home) and how often it stands in training, on a logarithmic scale; unknown words share a class of their own, and so does
the end of a text. The bits of a class are coded in the contexts of the classes before it, so the model reads across words
and a text in another order costs another sum. A known word then is told by its number in its class, byte by byte and bit by
bit, in the contexts of the bytes of the number before, of the class and of the kind of text that went before; an unknown
one is spelled, likewise, in the contexts of the bytes before and of that kind. What the model learns of a training token it
learns without that token: its class is that of one occurrence less, so words seen once count as unknown there, and teach
the spelling; in its number, one occurrence is left out of the counts.

All three levels use one coder. For each bit, four predictors look up how often a 0 and a 1 followed the last one to four bytes,
in hashed tables; a mixer weights their log odds with a set of weights chosen by a gate (the longest context that is known,
and how often it was seen), learnt online over all training items, in each partition, and averaged; a last table refines
the mixed odds adaptively. Every case is predicted without itself while the mixer learns.

Kinds of text come from the corpus: the most frequent words are grouped by which of them follow each other, and the kind at
a token is that of the last frequent word before it in its text.

Documents are read in blocks. A block's distinct (word, kind) pairs go to buckets of words by hash, which add up counts and
answer each block in its own order; so no word is bound to a prefix or a document, and nothing that grows is broadcast: only
three tables of at most sum(SLOTS) slots, and how many words of each class a bucket has. Colliding contexts share a slot, as in any hashed context model.

Null and empty texts: only the end token. A null doc_id counts as an empty one. Repeated rows count as often as they stand.
Very long words are spelled in pieces. With no training documents, counts are 0 and all bits cost a half. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, lean_map, mixed, passing, settle, words_of

ORDERS = (1, 2, 3, 4)
SLOTS = (1 << 17, 1 << 20, 1 << 21, 1 << 21)
STARTS = np.cumsum([0, *SLOTS])
INPUTS = len(ORDERS) + 1  # the contexts and a constant
SEEN = 6  # steps of how often a context was seen
GATES = (len(ORDERS) + 1) * SEEN
STEPS = 33  # of the refinement, over log odds of -8 to 8
PART, ADDERS = 1 << 15, 32  # counts in a row, and tasks that add rows up
MOST_RUNS = 1024  # of counting or fitting at once: each sends tables of a fixed size
PIECE = 1 << 12  # bytes of a word that are spelled at once
WIDTH = 1 << 16  # bytes coded at once
END = b"\n"
KINDS, FREQUENT = 6, 32  # kinds of text beside none, and the frequent words that tell them
NEW, LAST = 7 << 5, 7 << 5 | 1  # the classes of words that are spelled and of the end
COUNTS = pa.schema([("part", pa.int32()), ("counts", pa.binary())])


def packed(**fields) -> bytes:
    raw = pickle.dumps(fields, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def opened(data: bytes) -> dict:
    return pickle.loads(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))  # noqa: S301  our own table


class Shipped:
    """An array for all workers, compressed on the way: Spark writes what is broadcast to a file on every machine."""

    def __init__(self, spark, array: np.ndarray):
        self.data = spark.sparkContext.broadcast(packed(array=array))

    @property
    def value(self) -> np.ndarray:
        return opened(self.data.value)["array"]


class Coded:
    """The bits of items: of item i, the bytes from skip[i] on are coded, those before are context alone."""

    def __init__(self, items: list[bytes], skip: np.ndarray):
        size = np.array(list(map(len, items)), np.int64)
        data = np.frombuffer(b"".join(items), np.uint8).astype(np.uint64)
        n = len(data)
        pos = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        take = pos >= np.repeat(skip, size)
        past, history = np.zeros(n, np.uint64), []
        for k in ORDERS:
            old = np.zeros(n, np.uint64)
            old[k:] = data[:-k] + np.uint64(1)
            past = past | (np.where(pos >= k, old, 0).astype(np.uint64) << np.uint64(9 * (k - 1)))
            history.append(past[take])
        data = data[take]
        bits = np.arange(8, dtype=np.uint64)
        self.bit = ((data[:, None] >> (np.uint64(7) - bits)) & np.uint64(1)).astype(np.uint8).reshape(-1)
        node = ((np.uint64(1) << bits) | (data[:, None] >> (np.uint64(8) - bits))).astype(np.uint64)
        spread = node * np.uint64(0xD6E8FEB86659FD93)
        self.slots = []
        for k, h in enumerate(history):
            slot = ((h << np.uint64(8))[:, None] | node) if k == 0 else mixed(h, k)[:, None] + spread
            self.slots.append(((slot & np.uint64(SLOTS[k] - 1)).astype(np.int64) + STARTS[k]).reshape(-1))
        self.of = np.repeat(np.repeat(np.arange(len(items)), size)[take], 8)


def inputs(bits: Coded, tables: np.ndarray, without: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of a 1 from each context, and the gate, for each bit; without: one case of the item left out."""
    n = len(bits.bit)
    x, gate = np.full((n, INPUTS), 0.3, np.float32), np.zeros(n, np.int64)
    for k in range(len(ORDERS)):
        n0, n1 = (np.maximum(0, tables[b][bits.slots[k]] - (bits.bit == b) * np.float32(without)) for b in (0, 1))
        # a context seen often is sure of itself; one never seen says nothing
        x[:, k] = np.log((n1 + np.float32(0.05)) / (n0 + np.float32(0.05)))
        total = n0 + n1
        seen = np.minimum(SEEN - 1, np.log2(total + 1)).astype(np.int64)
        gate = np.where(total > 0, (k + 1) * SEEN + seen, gate)
    return x, gate


def squash(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -16, 16)))


class Mixer:
    def __init__(self, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.weights = np.full((GATES, INPUTS), 0.25, np.float32) if weights is None else weights
        self.refine = refine

    def odds(self, x, gate):
        return np.einsum("ij,ij->i", x, self.weights[gate])

    def _place(self, t):
        return np.clip(np.rint((np.clip(t, -8, 8) + 8) * (STEPS - 1) / 16), 0, STEPS - 1).astype(np.int64)

    def probability(self, x, gate) -> np.ndarray:
        """Of a 1."""
        t = self.odds(x, gate)
        p = squash(t)
        if self.refine is not None:
            p = (p + self.refine[gate, self._place(t)]) / 2
        return np.clip(p, 1e-6, 1 - 1e-6)

    def learn(self, x, gate, bit, weight, rate: float) -> np.ndarray:
        """One online step for a batch: each gate's weights move against its mean error. Gives what the refinement counts,
        from the odds before the step."""
        t = self.odds(x, gate)
        err = (bit - squash(t)) * weight
        seen = np.bincount(gate, weight, GATES) + 1e-9
        sure = np.minimum(1.0, np.bincount(gate, minlength=GATES) / 32)
        for k in range(INPUTS):
            self.weights[:, k] += rate * sure * np.bincount(gate, err * x[:, k], GATES) / seen
        at = gate * STEPS + self._place(t)
        return np.stack([np.bincount(at, weight, GATES * STEPS), np.bincount(at, bit * weight, GATES * STEPS)])


class Model:
    """The tables and the mixer of one level. A worker turns the counts into log odds and steps once."""

    def __init__(self, tables, mixer):
        self.tables, self.mixer, self.odds = tables, mixer, None

    def __getstate__(self):
        return self.tables, self.mixer

    def __setstate__(self, state):
        self.__init__(*state)

    def inputs(self, bits: Coded) -> tuple[np.ndarray, np.ndarray]:
        """As inputs(bits, tables, False)."""
        if self.odds is None:
            n0, n1 = self.tables.value
            self.odds = np.log((n1 + np.float32(0.05)) / (n0 + np.float32(0.05)))
            self.steps = np.where(n0 + n1 > 0, np.minimum(SEEN - 1, np.log2(n0 + n1 + 1)).astype(np.int8) + 1, 0).astype(np.int8)
        x, gate = np.full((len(bits.bit), INPUTS), 0.3, np.float32), np.zeros(len(bits.bit), np.int64)
        for k in range(len(ORDERS)):
            x[:, k] = self.odds[bits.slots[k]]
            step = self.steps[bits.slots[k]]
            gate = np.where(step > 0, (k + 1) * SEEN - 1 + step, gate)
        return x, gate

    def cost(self, items: list[bytes], skip: np.ndarray) -> np.ndarray:
        """log10 of the probability of each item's coded bytes."""
        out = np.zeros(len(items))
        for at, part, cut, whose in _pieces(items, skip):
            bits = Coded(part, cut)
            p = self.mixer.value.probability(*self.inputs(bits))
            own = np.bincount(bits.of, np.log10(np.where(bits.bit == 1, p, 1 - p)), len(part))
            np.add.at(out, at + whose, own)
        return out


def _pieces(items, skip):
    """(first, parts, skips, item of each part from first on), of about WIDTH bytes; long items are cut, each piece behind
    the bytes that are its context."""
    first, part, cut, whose, held = 0, [], [], [], 0
    for i, (item, s) in enumerate(zip(items, skip.tolist() if hasattr(skip, "tolist") else skip, strict=True)):
        for a in range(s, max(s + 1, len(item)), PIECE):
            lo = max(0, a - ORDERS[-1])
            part.append(item[lo : a + PIECE])
            cut.append(a - lo)
            whose.append(i - first)
            held += len(part[-1])
            if held >= WIDTH:
                yield first, part, np.array(cut), np.array(whose)
                first, part, cut, whose, held = i, [], [], [], 0
    if part:
        yield first, part, np.array(cut), np.array(whose)


def _tables(items_of):
    """Each partition's counts by slot, in rows of PART slots that have any."""

    def run(batches):
        total = None
        for batch in batches:
            for items, skip, weight in items_of(batch):
                for at, part, cut, whose in _pieces(items, skip):
                    total = np.zeros((2, STARTS[-1]), np.float32) if total is None else total
                    bits = Coded(part, cut)
                    w = weight[at + whose][bits.of].astype(np.float32)
                    for b in (0, 1):
                        chosen = bits.bit == b
                        for slots in bits.slots:
                            np.add.at(total[b], slots[chosen], w[chosen])
        if total is not None:
            cut = total.reshape(2, -1, PART).transpose(1, 0, 2)
            for k in np.flatnonzero(cut.any(axis=(1, 2))).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([cut[k].tobytes()], pa.binary())], schema=COUNTS)

    return run


def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch["part"].to_pylist(), batch["counts"], strict=True):
            own = np.frombuffer(raw.as_buffer(), np.float32)
            sums[k] = sums[k] + own if k in sums else own
    for k, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], schema=COUNTS)


def _fit(items_of, tables, step: int = 1 << 15):
    schema = pa.schema([("seen", pa.float64()), ("weights", pa.binary()), ("hits", pa.binary())])

    def run(batches):
        mixer, hits, seen, turn, counts = Mixer(), np.zeros((2, GATES * STEPS)), 0.0, 0, None
        for batch in batches:
            for items, skip, weight in items_of(batch):
                for at, part, cut, whose in _pieces(items, skip):
                    bits = Coded(part, cut)
                    counts = tables.value if counts is None else counts
                    x, gate = inputs(bits, counts, True)
                    w = weight[at + whose][bits.of].astype(np.float64)
                    for lo in range(0, len(gate), step):
                        s = slice(lo, lo + step)
                        hits += mixer.learn(x[s], gate[s], bits.bit[s], w[s], 0.2 / (1 + turn / 50))
                        turn += 1
                    seen += w.sum()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([mixer.weights.tobytes()], pa.binary()), pa.array([hits.tobytes()], pa.binary())], schema=schema)

    return run


def model_of(rows: DataFrame, items_of) -> Model:
    """Tables over all items, then the mixer: its weights are means over the partitions' online runs, by the bits seen;
    the refinement is how often a 1 came."""
    spark = rows.sparkSession
    own = settle(lean_map(lean_map(rows, _tables(items_of), "part int, counts binary").repartition(ADDERS, "part"), _add_up, "part int, counts binary"))
    tables = np.zeros((STARTS[-1] // PART, 2, PART), np.float32)
    for k, raw in own.toLocalIterator():
        tables[k] = np.frombuffer(bytes(raw), np.float32).reshape(2, PART)
    shipped = Shipped(spark, np.ascontiguousarray(tables.transpose(1, 0, 2)).reshape(2, -1))
    runs = settle(lean_map(rows, _fit(items_of, shipped), "seen double, weights binary, hits binary")).toLocalIterator()
    total, weights, hits = 0.0, np.zeros((GATES, INPUTS)), np.zeros((2, GATES * STEPS))
    for r in runs:
        total += r.seen
        weights += np.frombuffer(bytes(r.weights), np.float32).reshape(GATES, INPUTS) * r.seen
        hits += np.frombuffer(bytes(r.hits), np.float64).reshape(2, -1)
    mixer = Mixer()
    if total:
        n, ones = hits.reshape(2, GATES, STEPS)
        mixer = Mixer((weights / total).astype(np.float32), (ones + 20 * squash(np.linspace(-8, 8, STEPS))) / (n + 20))
    return Model(shipped, spark.sparkContext.broadcast(mixer))


class Places(dict):
    """Each word's place in order of arrival."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def _blocks(block_bytes: int, block_words: int):
    """A row for each block of documents: its words, its tokens as places among them, and its documents. Before it a row
    for each of its frequent words."""
    schema = pa.schema([("block", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("data", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        places, tokens, docs, n = Places({END: 0}), [], [], 0

        def out():
            words, ids, held = list(places), np.concatenate(tokens), np.array([d[2] for d in docs])
            size = np.array([d[3] for d in docs])
            count = np.bincount(ids[np.repeat(~held, size)], minlength=len(words))
            often = np.flatnonzero(count * 2000 >= max(1, count.sum()))
            rows = [(block, words[i], int(count[i]), None) for i in often.tolist() if i] + [(block, None, None, packed(words=words, ids=ids, size=size, held=held, doc=[d[0] for d in docs], n_bytes=[d[1] for d in docs]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, text, held in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()), batch["held"].to_pylist(), strict=True):
                own = words_of((text.as_py() or b"").translate(LOWER))
                ids = np.fromiter(map(places.__getitem__, own), np.int32, len(own))
                size = len(b" ".join(own)) + 2 if own else 1  # a byte after each word, and the end
                tokens.append(np.append(ids, np.int32(0)))
                docs.append((doc, size, held, len(own) + 1))
                n += size
                if n >= block_bytes or len(places) >= block_words:
                    yield from out()
                    block, places, tokens, docs, n = block + 1, Places({END: 0}), [], [], 0
        if docs:
            yield from out()

    return run


def _kind_of_words(found: dict, kinds: dict[bytes, int]) -> np.ndarray:
    get = kinds.get
    return np.array([get(w, 0) for w in found["words"]], np.int64)


def states(found: dict, kinds: dict[bytes, int]) -> np.ndarray:
    """The kind of text at each token: that of the last frequent word before it in its document, else 0."""
    own = _kind_of_words(found, kinds)[found["ids"]]
    n = len(own)
    start = np.repeat(np.cumsum(found["size"]) - found["size"], found["size"])
    last = np.maximum.accumulate(np.where(own > 0, np.arange(n), -1))
    before = np.concatenate([[-1], last[:-1]])
    return np.where(before >= start, own[np.maximum(before, 0)], 0).astype(np.int64)


def _follow(frequent: list[bytes]):
    """How often each frequent word is the next frequent one after another, in the training documents of each block."""
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
    place = {w: i + 1 for i, w in enumerate(frequent)}

    def run(batches):
        total = np.zeros((len(frequent) + 1) ** 2, np.int64)
        for batch in batches:
            for raw in batch["data"].to_pylist():
                found = opened(raw)
                own, before = _kind_of_words(found, place)[found["ids"]], states(found, place)
                use = (own > 0) & (before > 0) & np.repeat(~found["held"], found["size"])
                total += np.bincount(before[use] * (len(frequent) + 1) + own[use], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // (len(frequent) + 1), pa.int32()), pa.array(at % (len(frequent) + 1), pa.int32()), pa.array(total[at])], schema=schema)

    return run


def grouped(links: np.ndarray, kinds: int) -> np.ndarray:
    """The group, from 1, of each frequent word: of all pairs of groups, the one whose union loses the least of the mutual
    information of neighbours becomes one, until so many are left (Brown clustering)."""
    group, joint = np.arange(len(links)), (links + links.T) / max(1.0, 2 * links.sum())

    def information(p):
        mass = p.sum(axis=1)
        expected = np.outer(mass, mass)
        some = p > 0
        return float((p[some] * np.log(p[some] / expected[some])).sum())

    def merged(p, a, b):
        p = p.copy()
        p[a] += p[b]
        p[:, a] += p[:, b]
        return np.delete(np.delete(p, b, 0), b, 1)

    while len(joint) > kinds:
        a, b = max(((a, b) for b in range(len(joint)) for a in range(b)), key=lambda ab: information(merged(joint, *ab)))
        joint = merged(joint, a, b)
        group = np.where(group == b, a, group - (group > b))
    return group + 1


def pairs_of(found: dict, kinds: dict[bytes, int], buckets: int):
    """The block's distinct (word, kind) pairs, by bucket, with their training counts and the pair of each token."""
    key = found["ids"].astype(np.int64) * (KINDS + 1) + states(found, kinds)
    distinct, pair = np.unique(key, return_inverse=True)
    n = np.bincount(pair[np.repeat(~found["held"], found["size"])], minlength=len(distinct))
    word, kind = distinct // (KINDS + 1), distinct % (KINDS + 1)
    bucket = np.array([zlib.crc32(w) % buckets for w in found["words"]])[word]
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return word, kind, n, pair, order, edges


def _asked(kinds, buckets):
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])

    def run(batches):
        for batch in batches:
            for block, raw in zip(batch["block"].to_pylist(), batch["data"].to_pylist(), strict=True):
                found = opened(raw)
                word, kind, n, _, order, edges = pairs_of(found, kinds, buckets)
                words, rows = found["words"], []
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    at = order[edges[b] : edges[b + 1]]
                    rows.append((block, b, packed(words=[words[i] for i in word[at].tolist()], kind=kind[at].astype(np.uint8), n=n[at].astype(np.int32))))
                    if len(rows) >= 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _by(batches, column):
    """(key, batch rows) of neighbouring rows with one key."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[column] != key and rows:
                yield key, rows
                rows = []
            key = row[column]
            rows.append(row)
    if rows:
        yield key, rows


def _lexicon(batches):
    """The words of each bucket with their training counts by kind."""
    schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64()), ("words", pa.binary())])
    place = Places()
    count, bucket = np.zeros((1 << 12, KINDS + 1), np.int64), None

    def out():
        n = count[: len(place)]
        total, cls, less = n.sum(axis=1), class_of(n, list(place)), class_of(n, list(place), 1)
        known = np.bincount(cls, minlength=256).astype(np.int64).tobytes()
        word, kind = np.nonzero(n)
        by = (word.astype(np.int32), kind.astype(np.uint8), n[word, kind])
        data = packed(words=list(place), n=total, cls=cls, less=less, kind=n.argmax(axis=1).astype(np.uint8), by=by)
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([data], pa.binary()), pa.array([int(total.sum())]), pa.array([int((total > 0).sum())]), pa.array([known], pa.binary())], schema=schema)

    for batch in batches:
        for b, raw in zip(batch["bucket"].to_pylist(), batch["data"].to_pylist(), strict=True):
            if b != bucket and place:
                yield out()
                place = Places()
                count[:] = 0
            bucket, found = b, opened(raw)
            at = np.fromiter(map(place.__getitem__, found["words"]), np.int64, len(found["words"]))
            if len(place) > len(count):
                count = np.concatenate([count, np.zeros((len(place), KINDS + 1), np.int64)])
            np.add.at(count, (at, found["kind"].astype(np.int64)), found["n"])
    if place:
        yield out()


def class_of(n: np.ndarray, words: list[bytes], less: int = 0) -> np.ndarray:
    """The class of each word from its training counts by kind, or from so many occurrences less."""
    total = n.sum(axis=1) - less
    often = np.clip(np.log2(np.maximum(total, 1)).astype(np.int64) + 1, 1, 31)
    cls = np.where(total > 0, n.argmax(axis=1) << 5 | often, NEW)
    cls[[i for i, w in enumerate(words) if w == END]] = LAST
    return cls.astype(np.int64)


def spelled(word: bytes, kind: int) -> bytes:
    return bytes((kind,)) + word + b" "


def _singles(batch):
    """Training words seen once, as items of the spelling level."""
    for raw in batch["data"].to_pylist():
        found = opened(raw)
        at = np.flatnonzero((found["n"] == 1) & (found["less"] == NEW))
        at = at[np.argsort(mixed(np.arange(len(at), dtype=np.uint64) + np.uint64(1), 3))]
        if len(at):
            yield [spelled(found["words"][i], int(found["kind"][i])) for i in at.tolist()], np.ones(len(at), np.int64), np.ones(len(at))


class Numbers:
    """The known words of a class have numbers in a row over all buckets, of as many bytes as the class takes."""

    def __init__(self, words: dict[int, np.ndarray]):
        """words: of each bucket how many words each class has."""
        order = sorted(words)
        table = np.array([words[b] for b in order], np.int64).reshape(-1, 256)
        self.first = dict(zip(order, np.cumsum(table, axis=0) - table, strict=True))
        most = table.sum(axis=0) - 1
        self.width = 1 + (most >= 1 << 8).astype(np.int64) + (most >= 1 << 16) + (most >= 1 << 24) + (most >= 1 << 32)

    def of(self, bucket: int, cls: np.ndarray) -> np.ndarray:
        """The number of each word of a bucket, by their classes in order."""
        order = np.argsort(cls, kind="stable")
        size = np.bincount(cls, minlength=256)
        rank = np.empty(len(cls), np.int64)
        rank[order] = np.arange(len(cls)) - np.repeat(np.cumsum(size) - size, size)
        return self.first[bucket][cls] + rank

    def items(self, kind: np.ndarray, cls: np.ndarray, number: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Kind, class and number as items of the coder, of which the number is coded."""
        width = self.width[cls]
        rows = np.empty((len(cls), 10), np.uint8)
        rows[:, 0], rows[:, 1] = kind, cls
        rows[:, 2:] = (number << 8 * (8 - width)).astype(">u8").view(np.uint8).reshape(-1, 8)  # its bytes first
        raw = rows.tobytes()
        return [raw[a : a + n] for a, n in zip(range(0, len(raw), 10), (2 + width).tolist(), strict=True)], np.full(len(cls), 2)


def is_known(cls: np.ndarray) -> np.ndarray:
    return (cls != NEW) & (cls != LAST)


def _known(numbers):
    """The known words of training, with the kinds in which they stand, as items of the level of numbers."""

    def of(batch):
        for bucket, raw in zip(batch["bucket"].to_pylist(), batch["data"].to_pylist(), strict=True):
            found = opened(raw)
            cls, (word, kind, n) = found["cls"], found["by"]
            number = numbers.value.of(bucket, cls)
            at = np.flatnonzero(is_known(cls[word]))
            at = at[np.argsort(mixed(np.arange(len(at), dtype=np.uint64) + np.uint64(1), 3))]
            for lo in range(0, len(at), WIDTH):
                some = at[lo : lo + WIDTH]
                own = word[some]
                yield *numbers.value.items(kind[some], cls[own], number[own]), n[some].astype(np.float64)

    return of


def _answers(letters: Model, ranks: Model, numbers):
    """For each block's request: the class of each pair's word, its training count, and the cost of the word in its class."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])

    def run(batches):
        place: dict[bytes, int] = {}
        n = cls = less = bucket = number = told = None
        for batch in batches:
            for block, b, raw in zip(batch["block"].to_pylist(), batch["bucket"].to_pylist(), batch["data"].to_pylist(), strict=True):
                found = opened(raw)
                if block is None:
                    bucket, place = b, {w: i for i, w in enumerate(found["words"])}
                    n, cls, less, number = found["n"], found["cls"], found["less"], numbers.value.of(b, found["cls"])
                    told = np.full((len(n), KINDS + 1), np.nan, np.float32)  # costs are the same for all blocks
                    continue
                assert b == bucket
                at, kind = np.fromiter(map(place.__getitem__, found["words"]), np.int64, len(found["words"])), found["kind"].astype(np.int64)
                own, c = cls[at], n[at]
                ask = np.flatnonzero(is_known(own) & np.isnan(told[at, kind]))
                if len(ask):
                    told[at[ask], kind[ask]] = ranks.cost(*numbers.value.items(kind[ask], own[ask], number[at[ask]]))
                rest = np.where(is_known(own), told[at, kind], 0.0)
                new = np.flatnonzero(own == NEW)
                if len(new):
                    items = [spelled(found["words"][i], int(found["kind"][i])) for i in new.tolist()]
                    rest[new] = letters.cost(items, np.ones(len(new), np.int64))
                data = packed(cls=own.astype(np.uint8), less=less[at].astype(np.uint8), n=c, rest=rest.astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([b], pa.int32()), pa.array([data], pa.binary())], schema=schema)

    return run


def _assembled(kinds, buckets: int, denominator: float):
    """Blocks with the classes of their tokens, and of each document all but the cost of its classes."""
    schema = pa.schema([("data", pa.binary())])

    def run(batches):
        for _, rows in _by(batches, "block"):
            found = opened(next(r["data"] for r in rows if r["bucket"] is None))
            word, kind, _, pair, order, edges = pairs_of(found, kinds, buckets)
            cls, less, c, rest = np.zeros(len(word), np.uint8), np.zeros(len(word), np.uint8), np.zeros(len(word), np.int64), np.zeros(len(word))
            for r in rows:
                if (b := r["bucket"]) is not None:
                    told, at = opened(r["data"]), order[edges[b] : edges[b + 1]]
                    cls[at], less[at], c[at], rest[at] = told["cls"], told["less"], told["n"], told["rest"]
            first = np.cumsum(found["size"]) - found["size"]
            add = lambda v: np.add.reduceat(v[pair], first)  # noqa: E731, B023
            data = packed(cls=cls[pair], less=less[pair], size=found["size"], held=found["held"], doc=found["doc"], n_bytes=found["n_bytes"], known=add((c > 0).astype(np.int64)), base=add(np.log10((c + 1) / denominator)), rest=add(rest))
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], schema=schema)

    return run


def class_keys(found: dict, classes: str = "cls") -> np.ndarray:
    """For each token its class and, above it, those of the two tokens before it and the home of the third."""
    own = found[classes].astype(np.int64)
    n = len(own)
    pos = np.arange(n) - np.repeat(np.cumsum(found["size"]) - found["size"], found["size"])
    back = lambda k: np.where(pos >= k, np.concatenate([np.zeros(min(k, n), np.int64), own[: max(0, n - k)]]), 0)
    return (back(3) >> 5) << 24 | back(2) << 16 | back(1) << 8 | own


def _class_counts(batches):
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for raw in batch["data"].to_pylist():
            found = opened(raw)
            key, n = np.unique(class_keys(found, "less")[np.repeat(~found["held"], found["size"])], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], schema=schema)


def class_items(keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    raw = keys.astype(">u4").tobytes()
    return [raw[i : i + 4] for i in range(0, len(raw), 4)], np.full(len(keys), 3)


def _class_batch(batch):
    keys = batch["key"].to_numpy()
    if len(keys):
        yield *class_items(keys), batch["n"].to_numpy().astype(np.float64)


def _scored(classes: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])

    def run(batches):
        for batch in batches:
            for raw in batch["data"].to_pylist():
                found = opened(raw)
                keys, of = np.unique(class_keys(found), return_inverse=True)
                cost = classes.cost(*class_items(keys))
                score = np.add.reduceat(cost[of], np.cumsum(found["size"]) - found["size"]) + found["rest"]
                columns = (found["doc"], found["held"], found["size"], found["known"], found["base"], score, found["n_bytes"])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, block_bytes: int = 12 << 20, block_words: int = 300_000, most_buckets: int = 8192) -> DataFrame:
    """For each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities),
    n_bytes of its tokens and what parts them, and bits_per_byte of the score."""
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (fold == held_fold).alias("held"))
    with passing() as kept:
        read = settle(lean_map(source, _blocks(block_bytes, block_words), "block long, word binary, n long, data binary"))
        blocks = read.where("word is null").select("block", "data")
        top = read.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
        frequent = [bytes(r["word"]) for r in top]
        links = np.zeros((len(frequent), len(frequent)))
        for a, b, n in lean_map(blocks.select("data"), _follow(frequent), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n")).toLocalIterator():
            links[a - 1, b - 1] = n
        kinds = dict(zip(frequent, grouped(links, KINDS).tolist(), strict=True)) if frequent else {}
        buckets = min(most_buckets, max(1, blocks.rdd.getNumPartitions(), docs.rdd.getNumPartitions()))
        asked = settle(lean_map(blocks, _asked(kinds, buckets), "block long, bucket int, data binary"))
        deal = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").select("bucket", "data")
        lexicon = settle(lean_map(deal, _lexicon, "bucket int, data binary, total long, distinct long, words binary"))
        total, distinct = lexicon.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
        numbers = docs.sparkSession.sparkContext.broadcast(Numbers({b: np.frombuffer(bytes(raw), np.int64) for b, raw in lexicon.select("bucket", "words").toLocalIterator()}))
        words = lexicon.select("bucket", "data").repartition(min(buckets, MOST_RUNS))
        letters, ranks = model_of(words, _singles), model_of(words, _known(numbers))
        both = lexicon.select(F.lit(None).cast("long").alias("block"), "bucket", "data").unionByName(asked)
        told = lean_map(both.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("block")), _answers(letters, ranks, numbers), "block long, bucket int, data binary")
        joined = told.unionByName(blocks.withColumn("bucket", F.lit(None).cast("int"))).repartition(buckets, "block").sortWithinPartitions("block")
        whole = kept(lean_map(joined, _assembled(kinds, buckets, total + 1.0 * (distinct + 1)), "data binary"))
        counts = settle(lean_map(whole, _class_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
        classes = model_of(counts.repartition(min(buckets, MOST_RUNS)), _class_batch)
    out = lean_map(whole, _scored(classes), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))
