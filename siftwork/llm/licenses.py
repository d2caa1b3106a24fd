"""License scans with a positional index of rare words.

Templates are license notices, each with phrases that must stand in a match. Their words form a
small vocabulary with postings (template, position). One pass over all documents counts in how many
each vocabulary word occurs. A label needs an alignment (place in the document less place in the
template) at which a share of ``LEAST_SHARE`` of the template's words stand where it has them, with
all its key phrases inside the aligned stretch. A template of n words that needs k of them misses
n - k at most, so its n - k + 1 places of highest inverse document frequency hold one that stands in
every such alignment: a second pass looks up those, for each template its own, and scores every
alignment that they give in the documents that hold the template's phrases. No alignment is lost.

Phrases that name a license (``BASE``) are found everywhere, independently of the templates.

Defined results: a null or empty text has no words, no labels and score 0; the score is the greatest
share of any match; repeated rows get equal results; only the vocabulary's counts, bounded by
the number of template words, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.bytescan import Texts, Words, pieces
from siftwork.llm.common import table

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

LEAST_SHARE = 0.6


class Template(NamedTuple):
    label: str
    text: str
    phrases: tuple[str, ...]


#: Notices of common licenses, clause by clause, and the phrases that a match must hold.
TEMPLATES = (
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses")),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("agreed to in writing", "governing permissions and limitations")),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ("person or organization", "accompanying documentation")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code", "binary form must reproduce")),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products", "prior written permission")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "general public license")),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("in the hope that it will be useful", "general public license")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    Template("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ("author disclaims all warranties", "with regard to this software")),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("free of charge", "without restriction")),
    Template("mit", "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("sublicense and or sell copies", "whom the software is furnished")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("copy of the mpl", "mozilla org mpl")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy", "commercial or non commercial")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors", "held liable for any damages")),
)

#: Bytes between words: all ASCII but digits and letters. Bytes of other characters belong to words.
_GAP = np.ones(256, bool)
_GAP[0x30:0x3A] = _GAP[0x41:0x5B] = _GAP[0x61:0x7B] = _GAP[0x80:] = False


class Index:
    """Vocabulary by hash, templates and phrases as lists of word numbers in it, and the words that each template needs."""

    def __init__(self, templates: tuple[Template, ...], base: tuple[tuple[str, str], ...]):
        self.templates = templates
        hashed = lambda text: Texts(pa.array([text]), lower=True).words(_GAP).hashes()
        words = [hashed(t.text) for t in templates]
        phrases = [[h for h in map(hashed, t.phrases) if len(h)] for t in templates]
        base_phrases = [(hashed(p), label) for p, label in base]
        self.vocabulary = np.unique(np.concatenate([*words, *(p for of in phrases for p in of), *(p for p, _ in base_phrases)]))
        number = lambda h: np.searchsorted(self.vocabulary, h)
        self.words = [number(w) for w in words]
        self.phrases = [[tuple(number(p).tolist()) for p in of] for of in phrases]
        self.base_phrases = [(tuple(number(p).tolist()), label) for p, label in base_phrases]
        self.need = [next(k for k in range(len(w) + 1) if k >= len(w) or k / len(w) >= LEAST_SHARE) for w in words]

    def rare_places(self, rarity: np.ndarray) -> list[np.ndarray]:
        """For each template, its rarest places: one more than a match may miss."""
        return [np.argsort(-rarity[w], kind="stable")[: len(w) - k + 1] for w, k in zip(self.words, self.need, strict=True)]

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words that are in the vocabulary, their numbers there)."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        found = np.flatnonzero(self.vocabulary[at] == hashes)
        return found, at[found]


def _counts(index: Index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Texts(part.column("text"), lower=True).words(_GAP)
                at, known = index.hits(words.hashes())
                pair = np.unique(np.searchsorted(words.first, at, "right") * len(index.vocabulary) + known)
                total += np.bincount(pair % len(index.vocabulary), minlength=len(total))
                docs += part.num_rows
        yield pa.record_batch({"word": np.append(np.arange(len(total)), -1), "n": np.append(total, docs)})

    return scan


def document_frequencies(docs: DataFrame, index: Index, text: str = "text") -> np.ndarray:
    """Inverse document frequency of each vocabulary word over all documents."""
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_counts(index), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    return np.array([math.log((1 + n.get(-1, 0)) / (1 + n.get(i, 0))) for i in range(len(index.vocabulary))])


class Places:
    """Where the vocabulary's words stand in the documents of a batch, whose words are numbered end to end."""

    def __init__(self, index: Index, words: Words):
        at, known = index.hits(words.hashes())
        self.first, self.n = words.first, words.texts.n
        self.known = np.full(int(words.first[-1]) + 1, -1)  # the last is no word's
        self.known[at] = known
        by_word = np.argsort(known, kind="stable")
        self.at, self.ends = at[by_word], np.cumsum(np.bincount(known, minlength=len(index.vocabulary)))

    def of(self, word: int) -> np.ndarray:
        return self.at[self.ends[word - 1] if word else 0 : self.ends[word]]

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def phrase(self, words: tuple[int, ...]) -> np.ndarray:
        """Ascending starts of a phrase within documents."""
        starts = self.of(words[0])
        starts = starts[starts + len(words) <= self.first[-1]]
        for i, word in enumerate(words[1:], 1):
            starts = starts[self.known[starts + i] == word]
        return starts[self.owner(starts) == self.owner(starts + len(words) - 1)]


def _matches(places: Places, words: np.ndarray, need: int, rare: np.ndarray, phrases: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(documents, shares) of all matches of a template; ``phrases``: length and starts of each."""
    holds = np.ones(places.n, bool)
    for _, starts in phrases:
        holds &= np.bincount(places.owner(starts), minlength=places.n) > 0
    keys, width = [], int(places.first[-1]) + len(words)
    for i in rare.tolist() if holds.any() else ():
        at = places.of(words[i])
        owner = places.owner(at)
        keys.append((owner * width + at - i + len(words))[holds[owner]])
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    # a start before its text's first word is at most len(words) - 1 before it
    owner, start = key // width, key % width - len(words)
    lo, hi = places.first[owner], places.first[owner + 1]
    got = np.zeros(len(key), np.int64)
    for i, word in enumerate(words.tolist()):
        at = start + i
        got += (at >= lo) & (at < hi) & (places.known[np.clip(at, 0, len(places.known) - 1)] == word)
    lo, hi, found = np.maximum(start, lo), np.minimum(start + len(words), hi), got >= need
    for size, starts in phrases if len(key) else ():
        nearest = np.searchsorted(starts, lo)
        found &= (nearest < len(starts)) & (starts[np.minimum(nearest, len(starts) - 1)] + size <= hi)
    return owner[found], got[found] / max(len(words), 1)


def _scan(index: Index, rarity: np.ndarray):
    rare = index.rare_places(rarity)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words: Words = Texts(part.column("text"), lower=True).words(_GAP)
                places = Places(index, words)
                starts = {p: places.phrase(p) for p in {*(p for of in index.phrases for p in of), *(p for p, _ in index.base_phrases)}}
                n, score = np.zeros(places.n, np.int64), np.zeros(places.n)
                first, last = np.full(places.n, len(places.known)), np.full(places.n, -1)
                base: list[set[str]] = [set() for _ in range(places.n)]
                for phrase, label in index.base_phrases:
                    owner = places.owner(starts[phrase])
                    within = starts[phrase] - places.first[owner]
                    np.add.at(n, owner, 1)
                    np.minimum.at(first, owner, within)
                    np.maximum.at(last, owner, within)
                    score[owner] = 1.0
                    for t in np.unique(owner).tolist():
                        base[t].add(label)
                labels = [set(b) for b in base]
                for t, template in enumerate(index.templates):
                    owner, share = _matches(places, index.words[t], index.need[t], rare[t], [(len(p), starts[p]) for p in index.phrases[t]])
                    np.maximum.at(score, owner, share)
                    for d in np.unique(owner).tolist():
                        labels[d].add(template.label)
                joined = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
                place = lambda at: pa.array(at, pa.int64(), mask=n == 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.count, pa.int64()), pa.array(n), place(first), place(last), joined(base), joined(labels), pa.array(score)], names=_COLUMNS)

    return scan


_COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each document."""
    index = Index(templates, base)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rarity = document_frequencies(rows, index)
    return rows.mapInArrow(_scan(index, rarity), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
