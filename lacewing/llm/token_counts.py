"""Token counts under a unigram vocabulary: distinct pre-tokens share the forward scores of their common prefixes.

The best segmentation of a pre-token is found by dynamic programming over its characters; the state after a prefix depends
on the prefix alone. Distinct pre-tokens are inserted in a trie, whose nodes hold that state; it is walked depth first, in
sorted order, so only the states on the way to the current node are held. A terminal node's count is stored by pre-token,
and a document adds up the counts of its pre-tokens.

The pieces are those of a public vocabulary, which has no unigram scores of its own; the scores are fitted on all texts by
rounds of expectation and maximisation over best segmentations: all pieces begin alike, each distinct pre-token counts its
best segmentation's pieces as often as it stands, and a piece's next probability is its share of the counts plus one.

Null and empty texts have 0 pre-tokens and 0 tokens. Scores count in units of 2^-20. Ties go to fewer tokens, then to the longer last piece. Characters
outside the vocabulary cost a token for each UTF-8 byte. Very long texts are split whole; what is held is their words.
Repeated rows give repeated rows and count as often; null ids are carried; an empty table gives no rows, and equal scores;
other columns are not read. The stores of words and of counts start anew at a fixed number of pre-tokens, so a task's memory
is bounded by those and by a group of texts (or one text); only the scores, one for each piece, go to the driver and to the tasks.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, discard, lean_map, passing, settle, words_of

MARK = "▁"  # stands before a pre-token
STORE = 500_000  # distinct pre-tokens that a task holds at once
GROUP = 16 << 20  # bytes of text whose pre-tokens are inserted together, so that more prefixes are shared


def pieces_of(path: str) -> list[str]:
    """The pieces of the vocabulary file that stand for text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]


class Ends(dict):
    """Up to three last characters: the sizes of four or more that a piece may have which ends in them, and (size, worth) of
    the pieces that they are or end in, all descending. Starts anew at LIMIT."""

    LIMIT = 200_000

    def __init__(self, worth: dict[str, int]):
        super().__init__()
        self.worth = worth
        self.longer: dict[str, list[int]] = {}
        for end, size in sorted({(p[-3:], len(p)) for p in worth if len(p) > 3}, reverse=True):
            self.longer.setdefault(end, []).append(size)

    def __missing__(self, end: str) -> tuple[list[int], list[tuple[int, int]]]:
        if len(self) >= self.LIMIT:
            self.clear()
        short = [(k, self.worth[end[-k:]]) for k in (3, 2, 1) if len(end) >= k and end[-k:] in self.worth]
        found = self[end] = (self.longer.get(end, []), short)
        return found


class Forward:
    """Best states of the prefixes on the way to a node of the trie. Words that come in sorted order share the states of
    their common prefixes. A state is one integer, the score in units of 1 / SCALE times TOKENS, less the number of tokens:
    the greater is the better, and sums are exact."""

    SCALE, TOKENS, NONE = 1 << 20, 1 << 32, -(1 << 200)

    def __init__(self, scores: dict[str, float]):
        self.worth = {p: round(s * self.SCALE) * self.TOKENS - 1 for p, s in scores.items()}
        self.ends = Ends(self.worth)
        self.byte = (round(min(scores.values(), default=0.0) * self.SCALE) - 10 * self.SCALE) * self.TOKENS - 1
        self.path, self.states, self.begins = "", [0], [0]  # begins: the last piece's start, or -1 for bytes

    def to(self, word: str) -> int:
        """The state at the node of the word."""
        worth, ends, path, states, begins = self.worth.get, self.ends, self.path, self.states, self.begins
        k, most = 0, min(len(path), len(word))
        while k < most and path[k] == word[k]:
            k += 1
        del states[k + 1 :], begins[k + 1 :]
        for end in range(k + 1, len(word) + 1):
            best = self.NONE
            longer, short = ends[word[end - 3 if end > 3 else 0 : end]]
            for size in longer:
                if size <= end and (of := worth(word[end - size : end])) is not None and (there := states[end - size] + of) > best:
                    best, begin = there, end - size
            for size, of in short:
                if (there := states[end - size] + of) > best:
                    best, begin = there, end - size
            if not short or size > 1:  # bytes are worse than a piece for this character alone
                there = states[end - 1] + len(word[end - 1].encode()) * self.byte
                if there > best:
                    best, begin = there, -1
            states.append(best)
            begins.append(begin)
        self.path = word
        return states[-1]

    def tokens(self, word: str) -> int:
        return -self.to(word) % self.TOKENS

    def pieces(self, word: str) -> list[str]:
        """The pieces of its best segmentation, without bytes."""
        self.to(word)
        out, end = [], len(word)
        while end:
            start = self.begins[end]
            if start >= 0:
                out.append(word[start:end])
            end = start if start >= 0 else end - 1
        return out


class TrieCounter(dict):
    """Pre-token (UTF-8 bytes): tokens of its best segmentation."""

    def __init__(self, scores: dict[str, float], limit: int = STORE):
        super().__init__()
        self.limit, self.forward = limit, Forward(scores)

    def insert(self, words: set[bytes]) -> None:
        """Counts for those not counted yet."""
        fresh = words - self.keys()
        if len(self) + len(fresh) > self.limit:
            self.clear()
            fresh = words
        tokens = self.forward.tokens
        for word in sorted(fresh):
            self[word] = tokens(MARK + word.decode())

    def count(self, words: list[bytes]) -> int:
        return sum(map(self.__getitem__, words))


def _distinct(limit: int):
    schema = arrow_schema("word binary, n long")

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], schema=schema)

    def run(batches):
        found = Counter()
        for batch in batches:
            for t in batch["text"].cast(pa.binary()):
                found.update(words_of(t.as_py()))
                if len(found) >= limit:
                    yield out(found)
                    found.clear()
        if found:
            yield out(found)

    return run


def _uses(vocabulary: str, values: np.ndarray):
    schema = arrow_schema("piece string, n long")

    def run(batches):
        forward, used = Forward(dict(zip(pieces_of(vocabulary), values.tolist(), strict=True))), Counter()
        for batch in batches:
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
                for piece in forward.pieces(MARK + word.decode()):
                    used[piece] += n
        if used:
            yield pa.RecordBatch.from_arrays([pa.array(used.keys(), pa.string()), pa.array(used.values(), pa.int64())], schema=schema)

    return run


def unigram_scores(docs: DataFrame, vocabulary: str, text_col: str = "text", rounds: int = 2) -> dict[str, float]:
    """Piece: log probability, fitted on all texts. Distinct pre-tokens are dealt by range, so that those with a common
    prefix meet; the counts of pieces, as many as the vocabulary has, come to the driver."""
    pieces = pieces_of(vocabulary)
    scores = dict.fromkeys(pieces, -math.log(len(pieces))) if pieces else {}
    with passing():
        found = settle(lean_map(docs.select(F.col(text_col).cast("string").alias("text")), _distinct(STORE), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
        words = settle(found.repartitionByRange("word").sortWithinPartitions("word"))
        discard(found)
        for _ in range(rounds):
            used = lean_map(words, _uses(vocabulary, np.array(list(scores.values()))), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
            counts = {r["piece"]: r["n"] for r in used.collect()}
            total = math.log(sum(counts.values()) + len(pieces))
            scores = {p: math.log(counts.get(p, 0) + 1) - total for p in pieces}
    return scores


_counters: dict[tuple[str, bytes], TrieCounter] = {}


def _counter(vocabulary: str, values: np.ndarray) -> TrieCounter:
    """The worker's store of counts under these scores."""
    key = (vocabulary, values.tobytes())
    if key not in _counters:
        _counters.clear()
        _counters[key] = TrieCounter(dict(zip(pieces_of(vocabulary), values.tolist(), strict=True)))
    return _counters[key]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", scores: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each whole text; pre-tokens are its words [^\\x20\\x09-\\x0D]+. scores: the log
    probability of each piece of the vocabulary, fitted on the texts themselves if not given."""
    scores = unigram_scores(docs, vocabulary, text_col) if scores is None else scores
    values = np.array([scores[p] for p in pieces_of(vocabulary)])

    schema = arrow_schema("doc_id long, n_pretokens long, n_tokens long")

    def counted(held):
        counter = _counter(vocabulary, values)
        counter.insert(set().union(*(words_of(t.as_py()) for _, raw in held for t in raw)))
        for ids, raw in held:
            cut = [words_of(t.as_py()) for t in raw]
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(len, cut), pa.int64()), pa.array(map(counter.count, cut), pa.int64())], schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch["doc_id"], batch["text"].cast(pa.binary())))
            size += held[-1][1].nbytes
            if size >= GROUP:
                yield from counted(held)
                held, size = [], 0
        yield from counted(held)

    return lean_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_pretokens long, n_tokens long")


def vocabulary_path() -> str:
    """The vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
