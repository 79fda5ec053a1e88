"""License scan: an exact set-similarity join of notice templates with all windows of words."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from leadloom.llm.batches import add_columns, column, ship, slices, text_bytes
from leadloom.llm.decontaminate import words

#: (label, phrase): places where the words of a phrase stand consecutively.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: (label, notice): well-known short notices; fixed values.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)

BLOCK = StructType([StructField("label", StringType()), StructField("template", LongType()), StructField("first_word", LongType()),
                    StructField("n_words", LongType()), StructField("containment", DoubleType())])
FIELDS = [StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()),
          StructField("last_word", LongType()), StructField("base_labels", ArrayType(StringType())),
          StructField("labels", ArrayType(StringType())), StructField("score", DoubleType()), StructField("blocks", ArrayType(BLOCK))]


def shape(notice: str, percent: int, slack: int) -> tuple[list[bytes], int, int]:
    """Distinct words of a notice, how many of them a block must hold, and the words of a block."""
    found = words(notice.encode())
    distinct = list(dict.fromkeys(found))
    return distinct, -(-percent * len(distinct) // 100), -(-len(found) * (100 + slack) // 100)


class Template:
    """A notice as the ranks of its words, the rarest first, and the bounds of a matching block."""

    def __init__(self, label: str, notice: str, percent: int, slack: int, vocabulary: dict[bytes, int], order: list[int]):
        distinct, self.need, self.width = shape(notice, percent, slack)
        self.label, self.size = label, len(distinct)
        ids = sorted((vocabulary[w] for w in distinct), key=lambda i: order[i])
        self.rank = np.zeros(len(vocabulary) + 1, np.int32)  # 0: no word of the notice
        self.rank[ids] = np.arange(1, self.size + 1)
        self.prefix = self.size - self.need + 1  # a block without any of these rarest words holds too few


def flat_ids(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of all texts, 0 for other words and after each text; where each text starts."""
    get, counts, ids = vocabulary.get, [], []
    for text in texts:
        found = words(text)
        counts.append(len(found) + 1)
        ids.extend([get(w, 0) for w in found])
        ids.append(0)
    return np.array(ids, np.int32), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of the half-open intervals that overlap; ``begin`` and ``end`` both rise."""
    first = np.flatnonzero(np.concatenate([[True], begin[1:] >= end[:-1]]))
    return begin[first], end[np.append(first[1:], len(end)) - 1]


def matches(ids: np.ndarray, starts: np.ndarray, t: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and words held of all maximal blocks: unions of overlapping windows that hold at least ``t.need`` words.

    Prefix filter: only around the template's rarest words can a window hold
    enough.  Length filter: a stretch of fewer words than needed cannot.
    Positional filter: with the rarest word at rank r, at most the words from
    rank r on can follow, and no more than the stretch has.
    """
    rank = t.rank[ids]
    seeds = np.flatnonzero((rank > 0) & (rank <= t.prefix))
    none = np.empty(0, np.int64)
    if not len(seeds):
        return none, none, none
    text = np.searchsorted(starts, seeds, "right") - 1
    low, high = merged(np.maximum(starts[text], seeds - t.width + 1), np.minimum(starts[text + 1] - 1, seeds + t.width))
    long = high - low >= t.need
    low, high = low[long], high[long]
    place = np.flatnonzero(rank)
    a, b = np.searchsorted(place, low), np.searchsorted(place, high)
    held = b - a >= t.need
    a, b = a[held], b[held]
    if not len(a):
        return none, none, none
    least = np.minimum.reduceat(np.append(rank[place], t.size + 1), np.stack([a, b], 1).ravel())[::2]
    able = t.size - least + 1 >= t.need
    a, b = a[able], b[able]
    if not len(a):
        return none, none, none
    inside = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(int((b - a).sum()))
    place, stretch = place[inside], np.repeat(np.arange(len(a)), b - a)
    ranks = rank[place]
    # a word counts for the windows that start after its last occurrence, at most a window's width before it
    order = np.lexsort((place, ranks, stretch))
    again = np.concatenate([[False], (ranks[order][1:] == ranks[order][:-1]) & (stretch[order][1:] == stretch[order][:-1])])
    before = np.full(len(place), -1, np.int64)
    before[order[again]] = place[order[np.flatnonzero(again) - 1]]
    first = np.searchsorted(place, np.maximum(before + 1, place - t.width + 1))
    first = np.maximum(first, np.searchsorted(stretch, stretch))
    change = np.zeros(len(place) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, np.arange(1, len(place) + 1), -1)
    overlap = np.cumsum(change[:-1])
    hit = np.flatnonzero(overlap >= t.need)
    if not len(hit):
        return none, none, none
    begin = place[hit]
    end = np.minimum(begin + t.width, starts[np.searchsorted(starts, begin, "right")] - 1)
    low, high = merged(begin, end)
    return low, high, np.maximum.reduceat(overlap[hit], np.searchsorted(begin, low))


def phrase_places(ids: np.ndarray, phrase: list[int]) -> np.ndarray:
    n = len(ids) - len(phrase) + 1
    if n < 1 or not phrase:
        return np.empty(0, np.int64)
    at = np.flatnonzero(ids[:n] == phrase[0])
    for k, word in enumerate(phrase[1:], 1):
        at = at[ids[at + k] == word]
    return at


def frequencies(docs: DataFrame, text: str, vocabulary: dict[bytes, int]) -> list[int]:
    """Occurrences in all texts of every word of the vocabulary, by id; that many numbers and no more reach the driver."""
    n = len(vocabulary) + 1

    def run(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                total += np.bincount(flat_ids(text_bytes(part.column(0)), vocabulary)[0], minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["word", "n"])

    counts = [0] * n
    found = ship(docs).select(column(text).cast("string").alias("t")).mapInArrow(run, "word long, n long")
    for word, many in found.groupBy("word").agg(F.sum("n").alias("n")).collect():
        counts[word] = many
    return counts


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
         percent: int = 90, slack: int = 25, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: all) of every document plus n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    Words are runs of letters, digits and non-ASCII characters after lower-casing
    A-Z.  ``n_base`` counts the places where the words of a phrase stand
    consecutively, ``first_word`` and ``last_word`` are the least and greatest of
    them (null without any), ``base_labels`` the phrases' labels.

    A window of a template has its words plus ``slack`` per cent; it matches when
    it holds at least ``percent`` per cent of the template's distinct words,
    in any order.  ``blocks`` are the unions of overlapping matching windows
    (label, template, first_word, n_words, containment of the best window), all of
    them.  ``labels`` are the base labels and those of the blocks; both lists are
    sorted and distinct.  ``score`` is the greatest containment, 1 with a phrase,
    0 without anything.

    Method: a first pass counts the templates' words in all documents; the
    templates' words in that order, the rarest first, give the prefix, length and
    positional filters (``matches``) by which the second pass finds the windows
    exactly.  Phrases and templates are parameters, so what tasks get is of their
    size.  Nothing is shuffled but the counts.

    Null and empty texts have no words: 0, null and empty values.  A very long
    text is worked on as a whole; memory grows with its length.  Repeated rows
    are scanned each.  An empty table gives an empty result.  Of columns whose
    names clash with added ones, the added one wins.
    """
    named = [words(p.encode()) for _, p in phrases]
    vocabulary: dict[bytes, int] = {}
    for found in [*named, *[words(n.encode()) for _, n in templates]]:
        for w in found:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    seen = frequencies(docs, text, vocabulary)
    rarest = sorted(range(len(seen)), key=lambda i: (seen[i], i))
    order = [0] * len(seen)
    for place, i in enumerate(rarest):
        order[i] = place

    def make():
        searched = [(k, Template(label, notice, percent, slack, vocabulary, order)) for k, (label, notice) in enumerate(templates)]
        searched = [(k, t) for k, t in searched if t.size]
        exact = [(label, [vocabulary[w] for w in found]) for (label, _), found in zip(phrases, named, strict=True)]

        def work(texts):
            ids, starts = flat_ids(text_bytes(texts), vocabulary)
            n = len(texts)
            places: list[list[int]] = [[] for _ in range(n)]
            base: list[set[str]] = [set() for _ in range(n)]
            blocks: list[list[dict]] = [[] for _ in range(n)]
            for label, phrase in exact:
                for at in phrase_places(ids, phrase).tolist():
                    doc = int(np.searchsorted(starts, at, "right")) - 1
                    places[doc].append(at - int(starts[doc]))
                    base[doc].add(label)
            for k, t in searched:
                for low, high, held in zip(*matches(ids, starts, t), strict=True):
                    doc = int(np.searchsorted(starts, low, "right")) - 1
                    blocks[doc].append({"label": t.label, "template": k, "first_word": int(low - starts[doc]),
                                        "n_words": int(high - low), "containment": int(held) / t.size})
            return [np.diff(starts) - 1, [len(p) for p in places], [min(p, default=None) for p in places],
                    [max(p, default=None) for p in places], [sorted(b) for b in base],
                    [sorted(b | {x["label"] for x in f}) for b, f in zip(base, blocks, strict=True)],
                    [1.0 if b else max((x["containment"] for x in f), default=0.0) for b, f in zip(base, blocks, strict=True)],
                    [sorted(f, key=lambda x: (x["first_word"], x["template"])) for f in blocks]]

        return work

    return add_columns(docs, text, make, FIELDS, list(docs.columns if carry is None else carry))
