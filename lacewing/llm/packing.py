"""Packing token sequences: vector bin packing by the dot-product heuristic.

Each example demands a vector (tokens, segments, loss-bearing tokens); each sequence offers the limits of all three. An open
sequence takes, of a bounded pool of waiting pieces, the one that fits and whose demand has the largest dot product with
what is left; where none fits, the best waiting piece is cut to fill the sequence. Full lengths of long examples go out at
once. Rows are packed where they are read, without a shuffle; what is left at the end of a partition goes to sequences whose
lengths are powers of two, so it needs no padding.

Null text: an empty document, of the end token alone. Repeated rows are packed as often as they stand. Null ids are carried.
An empty table gives no rows. Other columns are not read. Memory: the pool, and the ids of one batch's texts.
"""

from __future__ import annotations

import contextlib
import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, lean_map

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
STRETCH = 100_000  # words whose tokens are learnt at once
_tokens: dict[str, WordTokens] = {}


class WordTokens(dict):
    """The ids of each white-space word, as little-endian 32-bit bytes. Only for tokenizers that drop white space and never
    join across it, so that a text's ids are its words' ids in a row; and, for the quick way of plain words, that lower case
    and part letters from punctuation. When there are LIMIT words they become the old store, which is asked before a word is
    tokenized again."""

    LIMIT = 500_000

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = self.of_runs = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.plain = bool(self.last.any())
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        if all(steps[k] == v for k, v in _LOWER_AND_SPLIT.items()):  # of small letters and blanks, only the blanks mean a thing
            self.of_runs = Tokenizer.from_file(path)
            self.of_runs.normalizer = normalizers.Sequence([])
            self.of_runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            with contextlib.suppress(AttributeError):
                self.of_runs.model._resize_cache(0)  # no run comes twice
        self.signs: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, texts: list[str], runs: bool = False) -> list[bytes]:
        encode = (self.of_runs if runs else self.tokenizer).encode_batch_fast
        return [np.array(e.ids, "<u4").tobytes() for k in range(0, len(texts), 5000) for e in encode(texts[k : k + 5000], add_special_tokens=False)]

    def _learn_letters(self, runs: list[str]) -> None:
        """Runs of small letters, many in one text: each ends where a pre-token ends."""
        groups = [runs[k : k + 100] for k in range(0, len(runs), 100)]
        for group, raw in zip(groups, self._encoded([" ".join(g) for g in groups], True), strict=True):
            ends = np.flatnonzero(self.last[np.frombuffer(raw, "<u4")]) + 1
            if len(ends) != len(group):
                self.update(zip(group, self._encoded(group), strict=True))
                continue
            ends = (4 * ends).tolist()
            self.update(zip(group, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def learn(self, words: set[str]) -> None:
        """Of words that are not here."""
        if len(self) + len(words) > self.LIMIT:
            self.old = dict(self)
            self.clear()
        old = self.old
        had = [w for w in words if w in old]
        self.update(zip(had, map(old.__getitem__, had), strict=True))
        fresh = words.difference(had) if had else words
        if not fresh:
            return
        if not self.plain:
            self.update(zip(fresh, self._encoded(list(fresh)), strict=True))
            return
        runs = {w for w in fresh if w.isascii() and w.isalpha() and w.islower()}  # most words
        rows = list(fresh.difference(runs))
        parts = _SMALL.findall("\n".join(rows)) if rows else []
        runs.update(run for run, sign in parts if run and not sign)
        signed = [(w, *part) for w, part in zip(rows, parts, strict=True) if part[1]]
        other = []
        for w in [w for w, (run, _) in zip(rows, parts, strict=True) if not run]:
            if m := _PLAIN.fullmatch(w):
                signed.append((w, m[1].lower(), m[2]))
            else:
                other.append(w)
        for run in {run for _, run, _ in signed}.difference(runs):
            if run in old:
                self[run] = old[run]
            elif run not in self:
                runs.add(run)
        self._learn_letters(list(runs))
        signs = list({sign for _, _, sign in signed}.difference(self.signs, [""]))
        self.signs.update(zip(signs, self._encoded(signs), strict=True))
        self.update([(w, self[run] + self.signs[sign] if sign else self[run]) for w, run, sign in signed])
        self.update(zip(other, self._encoded(other), strict=True))

    def of_all(self, texts: list[str | None], end: int) -> Iterator[np.ndarray]:
        """The ids of each text, with the end token."""
        last, held, fresh, n, get = np.uint32(end).tobytes(), [], set(), 0, self.get
        for k, text in enumerate(texts):
            words = _words(text, self.plain)
            ids = [*map(get, words), last]
            places = [i for i, x in enumerate(ids) if x is None] if None in ids else []
            missing = [words[i] for i in places]
            fresh.update(missing)
            held.append((ids, places, missing))
            n += len(words)
            if n >= STRETCH or k == len(texts) - 1:
                if fresh:
                    self.learn(fresh)
                for ids, places, missing in held:
                    for i, w in zip(places, missing, strict=True):
                        ids[i] = self[w]
                    yield np.frombuffer(b"".join(ids), "<u4")
                held, fresh, n = [], set(), 0

    def size_of_prompt(self, text: str, characters: int) -> int:
        """How many ids the words have that begin within so many characters."""
        head = text[:characters]
        if characters < len(text) and head[-1:].strip() and text[characters].strip():
            head = _words(text, False)  # the word that the prompt ends in, whole
            head = " ".join(head[: len(_words(text[:characters], False))])
        return sum(len(x) for x in self.of_all([head], 0)) - 1


def _words(text: str | None, plain: bool) -> list[str]:
    """str.split parts at the white space of Unicode, as the tokenizer does, and at four control characters that it keeps."""
    if not text:
        return []
    if plain and "<|" not in text:
        with contextlib.suppress(UnicodeEncodeError):
            text.encode("latin-1")  # for these characters, to lower case first changes nothing else
            text = text.lower()
    return _SPACE.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


#: White_Space of Unicode, fixed values.
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: What is done to a text before its words are cut, where it is known: runs of letters stand alone, small letters stay.
_LOWER_AND_SPLIT = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Letters whose lower case is one letter, then signs.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#%&*()]{0,8})")
_SMALL = re.compile("^(?:([a-zß-öø-ÿ]+)([.,;:!?#%&*()]{0,8})|.*)$", re.M)  # a word a line; the rest empty


class Packer:
    """Sequences of one partition. A piece's ids from its loss_from on bear loss, those before (the prompt) do not."""

    def __init__(self, first: int, tokens: int, segments: int, loss: int, pool: int):
        self.limits, self.pool, self.next = np.array([tokens, segments, loss], float), pool, first
        self.waiting: list[tuple] = []  # (doc, start, ids, doc_tokens, loss_from in the document)
        self.demand = np.zeros((pool + tokens + 1, 3))
        self.tokens = 0  # that wait

    def add(self, doc, ids: np.ndarray, loss_from: int = 0) -> Iterator[tuple]:
        at, n = 0, len(ids)
        tokens, loss = int(self.limits[0]), int(self.limits[2])
        while n - at >= (full := min(tokens, max(0, loss_from - at) + loss)):  # fills a sequence by itself
            yield self._piece((doc, at, ids[at : at + full], n, loss_from), self._open(), 0)
            at += full
        if at < n:
            self._wait((doc, at, ids[at:], n, loss_from))
            if len(self.waiting) >= self.pool and self.tokens >= min(tokens, loss):  # less than a sequence waits for more
                yield from self._fill()

    def _open(self) -> int:
        self.next += 1
        return self.next - 1

    @staticmethod
    def _needs(piece: tuple) -> tuple[int, int, int]:
        """Tokens, segments and loss-bearing tokens."""
        _, at, ids, _, loss_from = piece
        return len(ids), 1, min(len(ids), max(0, at + len(ids) - loss_from))

    def _wait(self, piece: tuple) -> None:
        self.demand[len(self.waiting)] = self._needs(piece)
        self.waiting.append(piece)
        self.tokens += len(piece[2])

    def _take(self, i: int) -> tuple:
        piece, last = self.waiting[i], len(self.waiting) - 1
        self.waiting[i], self.demand[i] = self.waiting[last], self.demand[last]
        self.waiting.pop()
        self.tokens -= len(piece[2])
        return piece

    def _piece(self, piece: tuple, sequence: int, offset: int) -> tuple:
        doc, at, ids, n, _ = piece
        return doc, at, len(ids), ids.tobytes(), n, self._needs(piece)[2], sequence, offset

    def _best(self, left: np.ndarray) -> int | None:
        """The waiting piece that fits with the largest dot product of demand and room, both as shares of the limits."""
        d = self.demand[: len(self.waiting)]
        fits = (d[:, 0] <= left[0]) & (d[:, 1] <= left[1]) & (d[:, 2] <= left[2])
        score = np.where(fits, d @ (left / self.limits**2), -1.0)
        i = int(score.argmax())
        return i if score[i] >= 0 else None

    def _cut(self, left: np.ndarray) -> tuple | None:
        """As much as fits of the piece of which most fits, of equals the largest; the rest waits on."""
        d = self.demand[: len(self.waiting)]
        fits = np.minimum(left[0], d[:, 0] - d[:, 2] + left[2])
        i = int(np.lexsort((-d[:, 0], -fits))[0])
        room = int(fits[i])
        if room < 1:
            return None
        doc, at, ids, n, loss_from = self._take(i)
        self._wait((doc, at + room, ids[room:], n, loss_from))
        return doc, at, ids[:room], n, loss_from

    def _fill(self) -> Iterator[tuple]:
        """One sequence from the pool."""
        sequence, left, offset = self._open(), self.limits.copy(), 0
        while self.waiting and left[0] >= 1 and left[1] >= 1:
            i = self._best(left)
            piece = self._take(i) if i is not None else self._cut(left)
            if piece is None:
                return
            yield self._piece(piece, sequence, offset)
            offset += len(piece[2])
            left -= self._needs(piece)

    def finish(self) -> Iterator[tuple]:
        full = int(min(self.limits[0], self.limits[2]))
        while self.tokens >= full and len(self.waiting) > 1:
            yield from self._fill()
        while self.waiting:
            total = min(self.tokens, full)
            size = total if total == full else 1 << (total.bit_length() - 1)
            sequence, offset = self._open(), 0
            room = int(self.limits[1])
            while offset < size and room:
                doc, at, ids, n, loss_from = self._take(0)
                if offset + len(ids) > size:
                    cut = size - offset
                    self._wait((doc, at + cut, ids[cut:], n, loss_from))
                    ids = ids[:cut]
                yield self._piece((doc, at, ids, n, loss_from), sequence, offset)
                offset += len(ids)
                room -= 1


def pack_sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, tokens: int = 2048, segments: int = 64, loss: int = 2048, pool: int = 256, prompt_col: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start and length in its document's ids, ids (little-endian 32 bits), doc_tokens (with
    the end token), loss_tokens, sequence_id, and offset in the sequence. prompt_col: how many characters at the start of a
    text are its prompt, whose tokens bear no loss (null or no column: none; a word that begins in the prompt belongs to it).
    No sequence holds more than so many tokens, segments or loss-bearing tokens."""

    schema = arrow_schema(PIECE)

    def packed(batches):
        from pyspark import TaskContext

        if tokenizer not in _tokens:
            _tokens[tokenizer] = WordTokens(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, tokens, segments, loss, pool)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
        rows, held = [], 0
        for batch in batches:
            texts, store = batch["text"].to_pylist(), _tokens[tokenizer]
            prompts = [0 if not k or not t else store.size_of_prompt(t, k) for t, k in zip(texts, batch["prompt"].to_pylist(), strict=True)]
            for doc, prompt, ids in zip(batch["doc_id"].to_pylist(), prompts, store.of_all(texts, end), strict=True):
                for x in packer.add(doc, ids, prompt):
                    rows.append(x)
                    held += x[2]
                if held >= 1 << 21:
                    yield batch_of(rows)
                    rows, held = [], 0
        rows += packer.finish()
        if rows:
            yield batch_of(rows)

    def run(batches):
        gc.disable()  # nothing here refers to itself, and the collector would go through all words again and again
        try:
            yield from packed(batches)
        finally:
            gc.enable()

    return lean_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(prompt_col) if prompt_col else F.lit(None)).cast("long").alias("prompt")), run, PIECE)


def crc32_of(pieces: DataFrame) -> DataFrame:
    """The pieces with the unsigned CRC-32 of their ids' bytes in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
