"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a short list of words and a threshold: the share of its distinct words that a
block must hold.  Blocks are windows of words that overlap by half; their length goes with
the template's (``stride`` is the next power of two, a block has two strides), so any
stretch as long as the template lies in one block whole.

The join is the prefix join.  Words of all templates are ordered by the number of documents
that hold them, rarest first, counted over the whole table.  A template of n words that
needs m of them shares with every block it matches one of its n - m + 1 rarest words.  Only
blocks around places of such words are candidates, and a candidate is dropped if it is
too short or if the words from the first shared one on, in the block or the template, can
no longer make m.  What is left is counted exactly, so no block that meets the threshold is
lost.  Templates are the small side: their index goes to every task (``MOST_WORDS`` bounds
it) and each text is read once, without moving it.

Base phrases are templates too, with threshold 1; a phrase's candidate blocks are then
searched for the places where its words stand one after another, each place counted in the
block in whose first half it begins.

Edge cases: a null or empty text has no words, places or labels and score 0.  Texts of any
length are read in stretches; only places of template words are kept of them.  Repeated
rows and identifiers give equal rows each; templates or phrases of one label count once.
An empty table gives an empty result.  Other input columns are dropped unless named in
``keep``; those that clash with a result are refused.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicforms.llm.bpe import _types
from civicforms.llm.common import read, text_slices


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    threshold: float = 0.8


#: Labels of phrases whose words stand consecutively.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Statements that must be there with all their words, and longer notices of which four fifths must.
STATEMENTS = {
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "under the mit license": "mit",
    "under the apache license version 2 0": "apache-2.0",
    "under the gnu general public license version 3": "gpl-3.0",
    "under the gnu general public license version 2": "gpl-2.0",
    "under the gnu lesser general public license": "lgpl",
    "under the mozilla public license": "mpl",
    "under the bsd license": "bsd",
    "dedicated to the public domain": "public-domain",
}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation": "gpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
TEMPLATES = [Template(label, tuple(text.split()), 1.0) for text, label in STATEMENTS.items()] + [Template(label, tuple(text.split())) for text, label in NOTICES.items()]
#: Words of all templates together; the index that every task holds is a few times as many numbers.
MOST_WORDS = 200_000
#: Lower-cases A-Z and makes every other ASCII sign but digits and small letters a blank.
_BARE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _stretches(text: str, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    bare, start = text.encode().translate(_BARE), 0
    while start < len(bare):
        end = bare.find(b" ", start + size)
        end = len(bare) if end < 0 else end
        yield bare[start:end].split()
        start = end


def places(text: str, wanted: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words of a text, and the places and numbers of the wanted ones."""
    n, at, which = 0, [], []
    for words in _stretches(text):
        numbers = [(k, x) for k, x in enumerate(map(wanted.get, words), n) if x is not None]
        if numbers:
            pair = np.array(numbers, np.int64)
            at.append(pair[:, 0])
            which.append(pair[:, 1])
        n += len(words)
    none = np.zeros(0, np.int64)
    return n, np.concatenate([none, *at]), np.concatenate([none, *which])


class Matcher:
    """Templates indexed by the rarest of their words."""

    def __init__(self, templates: list[Template], frequency: dict[str, int]) -> None:
        self.templates = templates
        ranked = sorted({w for t in templates for w in t.words}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w.encode(): k for k, w in enumerate(ranked)}
        self.words = [np.array(sorted({self.rank[w.encode()] for w in t.words}), np.int64) for t in templates]
        self.need = [least_shared(t) for t in templates]
        self.stride = [stride(t) for t in templates]
        self.probes: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            for place, w in enumerate(words[: len(words) - self.need[k] + 1].tolist()):
                self.probes.setdefault(w, []).append((k, place))
        self.is_probe = np.isin(np.arange(len(ranked)), list(self.probes))

    def blocks(self, n_words: int, at: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, block, shared words) of each block that meets a template's threshold, given the places of template words."""
        first: dict[tuple[int, int], int] = {}
        probing = self.is_probe[which]
        for p, w in zip(at[probing].tolist(), which[probing].tolist(), strict=True):
            for k, place in self.probes[w]:
                block = p // self.stride[k]
                for b in (block - 1, block) if block else (block,):
                    first[k, b] = min(first.get((k, b), place), place)
        for (k, b), place in first.items():
            s, need, template = self.stride[k], self.need[k], self.words[k]
            if min(n_words - b * s, 2 * s) < need:
                continue
            low, high = np.searchsorted(at, (b * s, b * s + 2 * s))
            held = np.unique(which[low:high])
            if min(len(template) - place, len(held) - int(np.searchsorted(held, template[place]))) < need:
                continue
            shared = int(np.isin(held, template, assume_unique=True).sum())
            if shared >= need:
                yield k, b, shared

    def starts(self, k: int, b: int, at: np.ndarray, which: np.ndarray) -> list[int]:
        """Where the words of a template stand one after another, beginning in the first half of a block."""
        s, words = self.stride[k], np.array([self.rank[w.encode()] for w in self.templates[k].words])
        low, high = np.searchsorted(at, (b * s, b * s + 2 * s))
        seen = np.full(2 * s + len(words), -1)
        seen[at[low:high] - b * s] = which[low:high]
        return [b * s + p for p in range(s) if (seen[p : p + len(words)] == words).all()]


def stride(template: Template) -> int:
    return max(1, 1 << (len(template.words) - 1).bit_length())


def least_shared(template: Template) -> int:
    """How many distinct words of the template a block must hold."""
    n = len(set(template.words))
    return max(1, int(np.ceil(np.round(template.threshold * n, 9))))


def word_frequencies(docs: DataFrame, templates: list[Template], text_col: str = "text") -> dict[str, int]:
    """In how many documents each word of the templates occurs; as many rows as such words."""
    numbered = {w: k for k, w in enumerate(sorted({w for t in templates for w in t.words}))}
    wanted = {w.encode(): k for w, k in numbered.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(wanted), np.int64)
        for _, texts in text_slices(batches, text_col):
            for text in texts:
                held = set().union(*map(wanted.keys().__and__, _stretches(text)))
                seen[[wanted[w] for w in held]] += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], names=["word", "n"])

    counts = docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by_number = {r["word"]: r["n"] for r in counts}
    return {w: by_number.get(k, 0) for w, k in numbered.items()}


FOUND = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def scan(docs: DataFrame, templates: list[Template] | None = None, phrases: dict[str, str] | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns, words, places of phrases, labels of phrases and of all, and the greatest share of a template that a block holds."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    if taken := FOUND.keys() & set(keep):
        raise ValueError(f"columns to keep are called as results: {sorted(taken)}")
    if sum(len(t.words) for t in templates) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words together")
    exact = [Template(label, tuple(text.split()), 1.0) for text, label in phrases.items()]
    every = exact + [t for t in templates if t.words]
    spread = docs.sparkSession.sparkContext.broadcast(Matcher(every, word_frequencies(docs, every, text_col)))

    def one(matcher: Matcher, text: str) -> tuple:
        n, at, which = places(text, matcher.rank)
        starts: list[int] = []
        base, labels, best = set(), set(), 0.0
        for k, b, shared in matcher.blocks(n, at, which):
            label = matcher.templates[k].label
            if k < len(exact):
                found = matcher.starts(k, b, at, which)
                if not found:
                    continue
                starts += found
                base.add(label)
            labels.add(label)
            best = max(best, shared / len(matcher.words[k]))
        return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = spread.value
        for part, texts in text_slices(batches, text_col):
            columns = zip(*(one(matcher, t) for t in texts), strict=True)
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, FOUND.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *arrays], names=[*keep, *FOUND])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, _types(docs, keep, ", ".join(f"{c} {kinds[k]}" for c, k in FOUND.items())))


def label_counts(found: DataFrame) -> DataFrame:
    """How many documents carry each label; from the rows of ``scan``."""
    return found.select(F.explode(F.split("labels", ",")).alias("label")).where("label <> ''").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Every word of every block against every template, counted without any filter."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    exact = [Template(label, tuple(text.split()), 1.0) for text, label in PHRASES.items()]
    rows = ",\n  ".join(f"({k}, '{t.label}', {listed(t.words)}, {stride(t)}, {least_shared(t)}, {len(set(t.words))}, {str(k < len(exact)).lower()})" for k, t in enumerate(exact + TEMPLATES))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), m(k, label, words, stride, need, n, is_phrase) AS (VALUES
  {rows}
), w AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
tw AS (SELECT DISTINCT k, stride, unnest(words) AS word FROM m),
h AS (SELECT rid, k, word, pos // stride AS b, pos FROM w JOIN tw USING (word)),
held AS (
  SELECT rid, k, b, count(DISTINCT word) AS shared FROM (SELECT rid, k, b, word FROM h UNION ALL SELECT rid, k, b - 1, word FROM h WHERE b > 0) GROUP BY ALL
), found AS (SELECT rid, label, shared / n AS share FROM held JOIN m USING (k) WHERE NOT is_phrase AND shared >= need),
p AS (
  SELECT h.rid, m.label, h.pos AS start FROM h JOIN m ON m.k = h.k AND m.is_phrase AND h.word = m.words[1] JOIN d USING (rid)
  WHERE d.words[h.pos + 1 : h.pos + len(m.words)] = m.words
), b AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY rid),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT * FROM found UNION ALL SELECT rid, label, 1.0 FROM p) GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)
"""


ORACLE = _oracle()
