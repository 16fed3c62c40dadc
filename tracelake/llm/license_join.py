"""License scans: an exact set-similarity join of text blocks with license templates, and fixed phrases.

Words are runs of letters and digits, ASCII lower-cased; a block is a line. A block matches a template when it holds
at least ``THRESHOLD`` of the template's distinct words. Words are ordered by how many documents of the whole
table hold them, rarest first (one pass counts the words that templates use). A template of ``m`` words that needs ``o`` of
them must then share one of its ``m - o + 1`` rarest with any block that matches (prefix filter); a block needs
``o`` words at least (length filter); and when the first shared word of the order is the ``i``-th, no more than ``m - i``
can follow, so it must come early enough (positional filter). What passes is counted exactly. Of two matches of a
block whose templates differ only by further words of the one (as the Lesser GPL has one word more than the GPL), the larger stays unless
the smaller is matched better. Phrases are found word for word, at every place.

Templates are a short list given by the caller and go to the tasks with their index, at most ``MAX_WORDS``
distinct words in all; a longer list is refused, to be scanned in parts. Documents are not shuffled.

Defined cases: a null or empty text has no words, no labels and score 0; templates without words match nothing;
repeated rows are reported each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.catalog import documents, query
from tracelake.llm.wordbytes import LOWER, NOT_ALNUM, Words, flat, slices

THRESHOLD = 0.8
MAX_WORDS = 100_000
# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening statements of common licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def _hashes(texts: list[str]) -> list[np.ndarray]:
    data, offsets = flat(pa.array(texts, pa.large_string()))
    words = Words(LOWER[data], offsets, NOT_ALNUM)
    hashes = words.hashes()
    return [hashes[a:b] for a, b in zip(words.row_start[:-1], words.row_start[1:], strict=True)]


class Scanner:
    """Phrases and templates; ``frequency`` orders the templates' words, rarest first."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], threshold: float, frequency: dict[int, int] | None = None):
        self.phrases = list(zip(_hashes(list(phrases)), phrases.values(), strict=True))
        sets = [np.unique(h) for h in _hashes(list(templates.values()))]
        self.labels = [name for name, s in zip(templates, sets, strict=True) if len(s)]
        sets = [s for s in sets if len(s)]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]))
        if len(self.vocabulary) > MAX_WORDS:
            raise ValueError(f"templates of more than {MAX_WORDS} distinct words: scan them in parts")
        seen = np.array([(frequency or {}).get(int(v), 0) for v in self.vocabulary.view(np.int64)], np.int64)
        rank = np.empty(len(seen), np.int64)
        rank[np.lexsort((self.vocabulary, seen))] = np.arange(len(seen))
        self.size = np.array([len(s) for s in sets], np.int64)
        self.need = np.array([math.ceil(threshold * len(s) - 1e-9) for s in sets], np.int64)
        self.place = np.full((len(sets), len(seen)), -1, np.int64)  # place of each word in its template's order
        prefix: list[list[int]] = [[] for _ in seen]
        for t, s in enumerate(sets):
            own = np.searchsorted(self.vocabulary, s)
            own = own[np.argsort(rank[own])]
            self.place[t, own] = np.arange(len(own))
            for word in own[: len(own) - self.need[t] + 1]:
                prefix[word].append(t)
        words = [frozenset(s.tolist()) for s in sets]
        self.within = [{t for t, w in enumerate(words) if w < own} for own in words]  # templates all of whose words another has, and more
        self.bounds = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int64)
        self.prefix = np.array([t for p in prefix for t in p], np.int64)

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that some template has, and their numbers."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == hashes)
        return hit, at[hit]

    def places(self, hashes: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, str]]:
        """First words of each phrase's places."""
        out = []
        for wanted, label in self.phrases:
            n = len(wanted)
            if not n or len(hashes) < n:
                continue
            at = np.flatnonzero(hashes[: len(hashes) - n + 1] == wanted[0])
            for k in range(1, n):
                at = at[hashes[at + k] == wanted[k]]
            out.append((at[row[at] == row[at + n - 1]], label))
        return out

    def matches(self, hashes: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block, template and similarity of every match; ``block`` is the block of each word, ascending."""
        at, word = self.known(hashes)
        pair = np.unique(block[at] * (len(self.vocabulary) + 1) + word)
        owner, word = pair // (len(self.vocabulary) + 1), pair % (len(self.vocabulary) + 1)
        n = self.bounds[word + 1] - self.bounds[word]
        source = np.repeat(np.arange(len(pair)), n)
        template = self.prefix[self.bounds[word][source] + np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)]
        candidate = owner[source]
        words_in = np.searchsorted(block, candidate, side="right") - np.searchsorted(block, candidate)
        early = self.size[template] - self.place[template, word[source]] >= self.need[template]
        keep = (words_in >= self.need[template]) & early
        both = np.unique(np.stack([candidate[keep], template[keep]], axis=1), axis=0)
        candidate, template = both[:, 0], both[:, 1]
        low, high = np.searchsorted(owner, candidate), np.searchsorted(owner, candidate, side="right")
        each = np.repeat(np.arange(len(candidate)), high - low)
        token = word[low[each] + np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
        overlap = np.bincount(each, self.place[template[each], token] >= 0, len(candidate)).astype(np.int64)
        good = overlap >= self.need[template]
        candidate, template, share = candidate[good], template[good], overlap[good] / self.size[template[good]]
        told = self._told_apart(candidate, template, share)
        return candidate[told], template[told], share[told]

    def _told_apart(self, block: np.ndarray, template: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Of two templates that match a block, one with all words of the other and more, the larger stays unless the smaller is matched better."""
        keep = np.ones(len(block), bool)
        begin = np.flatnonzero(np.diff(block, prepend=-1))
        for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(block))[: len(begin)].tolist(), strict=True):
            for a in range(lo, hi):
                for b in range(lo, hi):
                    if template[b] in self.within[template[a]]:
                        keep[b if share[a] >= share[b] else a] = False
        return keep


def frequencies(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> dict[int, int]:
    """Number of documents that hold each word of the templates (as signed hash), over all of ``docs``."""
    scanner = Scanner(phrases, templates, THRESHOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(scanner.vocabulary), np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                words = Words(LOWER[data], offsets, NOT_ALNUM)
                at, word = scanner.known(words.hashes())
                pair = np.unique(words.row[at] * len(total) + word)
                total += np.bincount(pair % max(len(total), 1), minlength=len(total))
        yield pa.record_batch([pa.array(scanner.vocabulary.view(np.int64)), pa.array(total)], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counted.collect()}  # the templates' words, at most MAX_WORDS


def scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best similarity; 1 for a
    phrase) and ``blocks``: line (from 0), template and similarity of each match."""
    scanner = Scanner(phrases, templates, threshold, frequencies(docs, phrases, templates))
    block_type = "array<struct<line: int, template: string, similarity: double>>"
    kind = pa.list_(pa.struct([("line", pa.int32()), ("template", pa.string()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column("text")):
                n = end - row
                words = Words(LOWER[data], offsets, NOT_ALNUM)
                hashes = words.hashes()
                count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                found: list[set[str]] = [set() for _ in range(n)]
                for at, label in scanner.places(hashes, words.row):
                    own, place = words.row[at], at - words.row_start[words.row[at]]
                    np.add.at(count, own, 1)
                    np.minimum.at(first, own, place)
                    np.maximum.at(last, own, place)
                    for r in np.unique(own).tolist():
                        found[r].add(label)
                line = np.cumsum(data == 10)
                of_word = line[words.start] + words.row if len(words) else np.zeros(0, np.int64)  # a row begins a block, too
                block, template, similarity = scanner.matches(hashes, of_word)
                score = (count > 0).astype(np.float64)
                more = [set(s) for s in found]
                blocks: list[list[dict]] = [[] for _ in range(n)]
                word_at = np.searchsorted(of_word, block)
                for b, w, t, s in zip(block.tolist(), word_at.tolist(), template.tolist(), similarity.tolist(), strict=True):
                    r = int(words.row[w])
                    before = int(line[offsets[r] - 1]) if offsets[r] else 0
                    more[r].add(scanner.labels[t])
                    score[r] = max(score[r], s)
                    blocks[r].append({"line": b - r - before, "template": scanner.labels[t], "similarity": s})
                none = count == 0
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(row, n), pa.array(np.diff(words.row_start).astype(np.int64)), pa.array(count),
                        pa.array(first, mask=none), pa.array(last.astype(np.int64), mask=none),
                        pa.array([",".join(sorted(s)) for s in found]), pa.array([",".join(sorted(s)) for s in more]), pa.array(score),
                        pa.array(blocks, kind),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        f"blocks {block_type}",
    )


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in table.items())


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


# Every place of a phrase, and every line against every template.
_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, {_words('t')} AS w FROM d),
ph AS (SELECT {_words('phrase')} AS p, label FROM (VALUES {_values(PHRASES)}) v(phrase, label)),
tp AS (SELECT label, list_distinct({_words('statement')}) AS s FROM (VALUES {_values(TEMPLATES)}) v(label, statement)),
spot AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) q, ph WHERE w[i] = p[1] AND w[i : i + len(p) - 1] = p),
ln AS (SELECT row_number() OVER () AS k, doc_id, list_distinct({_words('l')}) AS b FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
every AS MATERIALIZED (SELECT k, doc_id, label, s, len(list_intersect(b, s)) / len(s)::DOUBLE AS share FROM ln, tp WHERE len(list_intersect(b, s)) >= ceil({THRESHOLD} * len(s) - 1e-9)),
hit AS (SELECT doc_id, label, share FROM every h WHERE NOT EXISTS (SELECT 1 FROM every o WHERE o.k = h.k AND (
  (len(o.s) > len(h.s) AND list_has_all(o.s, h.s) AND o.share >= h.share) OR (len(o.s) < len(h.s) AND list_has_all(h.s, o.s) AND o.share > h.share)))),
base AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM spot GROUP BY doc_id),
lab AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT doc_id, label FROM spot UNION ALL SELECT doc_id, label FROM hit) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word, coalesce(base.l, '') AS base_labels,
  coalesce(lab.l, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN lab ON lab.doc_id = w.doc_id LEFT JOIN best ON best.doc_id = w.doc_id
"""


@query("op10_license_join", _SQL)
def op10_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("blocks")
