"""Token counts by a unigram model, with forward scores shared in a trie.

A pre-token is a word between ASCII white space with the word mark in front. It is cut into the vocabulary's pieces so that the
sum of their scores is largest (of equal sums, the fewer pieces). The best score of a prefix does not depend on what
follows, so distinct pre-tokens go into a trie, and each node gets its forward score and count once, from its
ancestors; the count at a word's last node is the word's. A text's count is the sum over its words.

Scores follow from the order of the vocabulary, by Zipf's law: the piece of rank ``r`` has ``-ln(r + 2)``. A
character that is no piece falls back to its bytes, each a token scored as twice the vocabulary's size.

A worker keeps the counts of ``MAX_WORDS`` words by hash, then starts anew. The words of a slice that it does not know go, in order,
into a trie whose depths are arrays: all nodes of a depth are scored at once. Words of ``LONG_WORD`` characters or more walk a
trie of single nodes, kept up to ``max_nodes``, each from where it leaves the one before. Results depend on none of these bounds.
Documents are not shuffled.

Defined cases: a null or empty text has no words and no tokens; repeated rows are counted each; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.catalog import documents, query
from tracelake.llm.wordbytes import Words, mix, slices

MARK = "▁"
MAX_NODES = 1_000_000
MAX_WORDS = 2_000_000
#: Words of so many characters or more go through a trie of single nodes; shorter ones through one whose depths are arrays.
LONG_WORD = 40
MAX_LEVEL_WORDS = 20_000
_BASE = 0x9E3779B97F4A7C15
_CODES = 0x110000


def piece_scores(model_path: str) -> dict[str, float]:
    """Pieces of the vocabulary (without control, unknown and byte pieces), scored by their order."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return {p: -math.log(r + 2) for r, p in enumerate(pieces)}


class Trie:
    """Nodes of prefixes, each with its best score and the number of pieces that reach it."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.ending: dict[str, int] = {}  # length of the longest piece that ends with a character
        for piece in scores:
            self.ending[piece[-1]] = max(self.ending.get(piece[-1], 0), len(piece))
        self.per_byte = -math.log(2 * max(len(scores), 1))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0.0], [0]
        self.text, self.path = "", [0]

    def count_word(self, word: str) -> int:
        """Pieces of the word with its mark: the count at its last node. The walk goes on where the word leaves the last one."""
        text, path = MARK + word, self.path
        same = len(commonprefix((self.text, text)))
        del path[same + 1 :]
        child, node, size = self.child, path[-1], len(text)
        while same < size:
            key = node * _CODES + ord(text[same])
            same += 1
            found = child.get(key)
            node = child[key] = self._grow(text, same, path) if found is None else found
            path.append(node)
        self.text = text
        return self.count[node]

    def _grow(self, text: str, i: int, path: list[int]) -> int:
        """A node for the first ``i`` characters: its forward score from those of its ancestors."""
        scores = self.scores
        last = text[i - 1]
        best, fewest = -math.inf, 0
        if last not in scores:
            n = len(last.encode())
            best, fewest = self.score[path[-1]] + n * self.per_byte, self.count[path[-1]] + n
        for start in range(max(0, i - self.ending.get(last, 0)), i):
            piece = text[start:i]
            if piece in scores:
                score, count = self.score[path[start]] + scores[piece], self.count[path[start]] + 1
                if score > best or (score == best and count < fewest):
                    best, fewest = score, count
        self.score.append(best)
        self.count.append(fewest)
        return len(self.score) - 1


class Levels:
    """The trie of many words at once: all nodes of a depth get their scores and counts together, from the depths before."""

    def __init__(self, scores: dict[str, float]):
        self.per_byte = -math.log(2 * max(len(scores), 1))
        codes, starts = _codes(list(scores))
        hashes = _Runs(codes).of(starts[:-1], starts[1:])
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.fromiter(scores.values(), float, len(scores))[order]
        self.longest = int(np.diff(starts).max(initial=0))
        #: length of the longest piece that ends with a character
        self.ending = np.zeros(_CODES, np.uint8)
        np.maximum.at(self.ending, codes[starts[1:] - 1], np.minimum(np.diff(starts), 255).astype(np.uint8))

    def _piece(self, hashes: np.ndarray) -> np.ndarray:
        """Score of each run of characters, minus infinity where it is no piece."""
        if not len(self.hashes):
            return np.full(len(hashes), -np.inf)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.scores[at], -np.inf)

    def count(self, words: list[str]) -> np.ndarray:
        """Pieces of each word with its mark; the words are in order."""
        codes, starts = _codes([MARK + w for w in words])
        runs, size = _Runs(codes), np.diff(starts)
        depth = int(size.max(initial=0))
        score, count = np.zeros((depth + 1, len(words))), np.zeros((depth + 1, len(words)), np.int64)
        alive = np.arange(len(words))
        node = np.zeros(len(words), np.int64)
        for i in range(1, depth + 1):
            keep = size[alive] >= i
            alive, node = alive[keep], node[keep]
            char = codes[starts[alive] + i - 1]
            new = np.ones(len(alive), bool)
            new[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
            node = np.cumsum(new) - 1
            word, last = alive[new], char[new]
            end = starts[word] + i
            best, fewest = np.full(len(word), -np.inf), np.zeros(len(word), np.int64)
            reach = self.ending[last]
            for n in range(1, min(i, self.longest) + 1):
                own = np.flatnonzero(reach >= n)
                if not len(own):
                    break
                piece = self._piece(runs.of(end[own] - n, end[own]))
                hit = piece > -np.inf
                own, value = own[hit], piece[hit] + score[i - n, word[own[hit]]]
                pieces = count[i - n, word[own]] + 1
                better = (value > best[own]) | ((value == best[own]) & (pieces < fewest[own]))
                best[own[better]], fewest[own[better]] = value[better], pieces[better]
            lone = np.flatnonzero(self._piece(runs.of(end - 1, end)) == -np.inf)  # no piece of its own: its bytes
            n_bytes = 1 + (last[lone] > 0x7F) + (last[lone] > 0x7FF) + (last[lone] > 0xFFFF)
            value, pieces = score[i - 1, word[lone]] + n_bytes * self.per_byte, count[i - 1, word[lone]] + n_bytes
            better = (value > best[lone]) | ((value == best[lone]) & (pieces < fewest[lone]))
            best[lone[better]], fewest[lone[better]] = value[better], pieces[better]
            score[i, alive], count[i, alive] = best[node], fewest[node]
        return count[size, np.arange(len(words))]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each starts (one more at the end)."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64), np.cumsum([0, *map(len, texts)])


class _Runs:
    """64-bit hashes of runs of characters, by differences of one running polynomial."""

    def __init__(self, codes: np.ndarray):
        self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(codes), pow(_BASE, -1, 1 << 64), np.uint64)]))
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(codes), _BASE, np.uint64)]))
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.inverse[start]


class Counts:
    """Pieces of words by hash: terminal counts are kept over slices, so that only new words go into a trie."""

    def __init__(self, model_path: str):
        scores = piece_scores(model_path)
        self.levels, self.trie = Levels(scores), Trie(scores)
        self.known, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, words: Words, max_nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each distinct word of a slice, and which of them each word is."""
        distinct, first, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > MAX_WORDS:
            self.known, self.count = self.known[:0], self.count[:0]
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        which = first[new]
        raw = words.data.tobytes() if len(which) else b""
        texts = [raw[a:b].decode() for a, b in zip(words.start[which].tolist(), words.end[which].tolist(), strict=True)]
        order = sorted(range(len(texts)), key=texts.__getitem__)
        pieces = np.zeros(len(texts), np.int64)
        short = [k for k in order if len(texts[k]) < LONG_WORD]
        for lo in range(0, len(short), MAX_LEVEL_WORDS):
            some = short[lo : lo + MAX_LEVEL_WORDS]
            pieces[some] = self.levels.count([texts[k] for k in some])
        for k in order:
            if len(texts[k]) >= LONG_WORD:
                pieces[k] = self.trie.count_word(texts[k])
                if len(self.trie.score) > max_nodes:
                    self.trie.clear()
        self.known, self.count = np.insert(self.known, at[new], distinct[new]), np.insert(self.count, at[new], pieces)
        return self.count[np.searchsorted(self.known, distinct)], number


_counts: dict[str, Counts] = {}


def _kept(model_path: str) -> Counts:
    if model_path not in _counts:
        _counts[model_path] = Counts(model_path)
    return _counts[model_path]


def count(docs: DataFrame, model_path: str, max_nodes: int = MAX_NODES) -> DataFrame:
    """doc_id, n_words and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _kept(model_path)
        for batch in batches:
            for row, end, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                pieces, number = kept.of(words, max_nodes)
                total = np.bincount(words.row, pieces[number], end - row).astype(np.int64)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(row, end - row), pa.array(np.diff(words.row_start).astype(np.int64)), pa.array(total)],
                    ["doc_id", "n_words", "n_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
