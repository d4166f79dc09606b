"""Licence scan with a positional rare-token index.

Templates (short phrases, licence notices) are indexed by word: postings of
(template, position).  Document frequencies of the templates' words are counted
over the whole corpus and give every word its inverse document frequency
(IDF).  For a file, each template is looked up by those of its words that are
rarest by IDF; an occurrence at p of a word at position q of the template
votes for start p - q, and the votes of several rare words are intersected by
that relative position.  For exact phrases every word's postings are
intersected, so a start that survives is a place where the phrase stands.  For
notices, ``RARE_WORDS`` words vote, starts are kept that enough of them agree
on within ``DRIFT`` words, the template's mandatory key phrases must stand in
the window, and the share of the template's words found there is the score.

Two passes over the texts, each where they lie: one counts document
frequencies (partial counts per task, summed by word), one scans.  Texts are not
shuffled; the driver holds one count per template word.

Defined cases: a null text is empty: no words, no places, empty labels, score
0; repeated rows and null ids are returned as they come; an empty table gives no rows;
other columns are passed over.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import documents, text_of

#: Phrases whose places are counted, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices by label, each with its mandatory key phrases.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction",
     ("permission is hereby granted", "without restriction")),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license", ("apache license",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation",
     ("gnu general public license", "free software")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", ("redistribution and use", "source and binary forms")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", ("for any purpose", "hereby granted")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license",
     ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license",
     ("creative commons attribution sharealike",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software", "public domain")),
)

RARE_WORDS = 4
DRIFT = 3
LEAST_SCORE = 0.7

#: A-Z to a-z; every ASCII byte that is no digit or letter to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
              for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[list[bytes]] = field(default_factory=list)  # empty: an exact phrase


def templates(phrases: Iterable = PHRASES, notices: Iterable = NOTICES) -> list[Template]:
    return ([Template(label, words_of(text)) for text, label in phrases]
            + [Template(label, words_of(text), [words_of(k) for k in keys]) for label, text, keys in notices])


def _starts(places: dict[bytes, list[int]], phrase: list[bytes], order: list[int]) -> list[int]:
    """Starts where all of ``phrase`` stands: postings by relative position,
    intersected from the rarest word on."""
    starts: set[int] | None = None
    for q in order:
        at = {p - q for p in places.get(phrase[q], ())}
        starts = at if starts is None else starts & at
        if not starts:
            return []
    return sorted(x for x in starts if x >= 0)


class RareTokenIndex:
    """The templates' postings, with words ordered by falling IDF."""

    def __init__(self, of: list[Template], frequency: dict[bytes, int], n_docs: int):
        self.templates = of
        self.idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) for w in vocabulary(of)}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(of):
            for q, w in enumerate(template.words):
                self.postings[w].append((t, q))
        self.order = {}
        for phrase in [t.words for t in of] + [k for t in of for k in t.keys]:
            self.order[tuple(phrase)] = sorted(range(len(phrase)), key=lambda q: (-self.idf[phrase[q]], q))

    def _rare(self, places: dict[bytes, list[int]]) -> dict[int, list[tuple[bytes, int]]]:
        """By template, the file's ``RARE_WORDS`` highest-IDF words that it has."""
        found = defaultdict(list)
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            for t, q in self.postings[w]:
                if len(found[t]) < RARE_WORDS:
                    found[t].append((w, q))
        return found

    def scan(self, text: str):
        """(words, base places, first, last, base labels, labels, score)."""
        words = words_of(text)
        places: dict[bytes, list[int]] = defaultdict(list)
        known = self.postings
        for i, w in enumerate(words):
            if w in known:
                places[w].append(i)
        base: list[int] = []
        base_labels, labels, best = set(), set(), 0.0
        for t, votes in self._rare(places).items():
            template = self.templates[t]
            if not template.keys:
                starts = _starts(places, template.words, self.order[tuple(template.words)])
                if starts:
                    base += starts
                    base_labels.add(template.label)
                    best = 1.0
            else:
                score = self._notice(places, template, votes)
                if score >= LEAST_SCORE:
                    labels.add(template.label)
                    best = max(best, score)
        labels |= base_labels
        return (len(words), len(base), min(base, default=None), max(base, default=None),
                ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(best, 6))

    def _notice(self, places, template: Template, votes: list[tuple[bytes, int]]) -> float:
        """The best share of the template's words near one start that enough of
        its rare words agree on and that has its key phrases."""
        need = max(1, math.ceil(len(votes) / 2))
        if len(votes) < min(2, len(template.words)):
            return 0.0
        keys = [(_starts(places, k, self.order[tuple(k)]), len(k)) for k in template.keys]
        if not all(at for at, _ in keys):
            return 0.0
        agreed = Counter(p - q for w, q in votes for p in places[w])
        size, score = len(template.words), 0.0
        offsets = sorted(agreed)
        for start in offsets:
            near = offsets[bisect_left(offsets, start - DRIFT):bisect_right(offsets, start + DRIFT)]
            if sum(agreed[x] for x in near) < need:
                continue
            lo, hi = start - DRIFT, start + size + DRIFT
            if all(bisect_right(at, hi - n) > bisect_left(at, lo) for at, n in keys):
                hits = sum(1 for q, w in enumerate(template.words)
                           if bisect_right(places.get(w, ()), start + q + DRIFT)
                           > bisect_left(places.get(w, ()), start + q - DRIFT))
                score = max(score, hits / size)
        return score


def vocabulary(of: list[Template]) -> set[bytes]:
    return {w for t in of for phrase in [t.words, *t.keys] for w in phrase}


def document_frequencies(docs: DataFrame, of: list[Template], text_col: str = "text") -> tuple[dict, int]:
    """Documents that hold each template word, and the number of documents."""
    known = frozenset(vocabulary(of))

    def run(batches):
        seen, n = Counter(), 0
        for b in batches:
            for t in b.column(0):
                seen.update(known.intersection(words_of(t.as_py())))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())],
                                         names=["word", "n"])
    rows = (docs.select(text_of(text_col).alias("text")).mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())  # a row per template word
    counts = {None if r.word is None else bytes(r.word): r.n for r in rows}
    return counts, counts.get(None, 0)


def scan_licenses(docs: DataFrame, of: list[Template] | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score`` of every document."""
    of = of or templates()
    index = RareTokenIndex(of, *document_frequencies(docs, of, text_col))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        for b in batches:
            rows = [index.scan(t.as_py()) for t in b.column(1)]
            found = [pa.array(c, t) for c, t in zip(zip(*rows), types[1:])] if rows else [
                pa.array([], t) for t in types[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *found], names=names)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                "base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
