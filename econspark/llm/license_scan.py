"""License notices by an exact set-similarity join of text blocks with templates.

Blocks are windows of words: one starts every STRIDE words and reaches far enough that any run of words as long as the longest
template lies in one block as a whole. A block meets a template when it holds at least ``threshold`` of the template's distinct words.

Template words are ordered by their document frequency in all documents, rarest first. With an overlap of ``o`` words needed
out of ``t``, any block that meets the template holds one of its first ``t - o + 1`` words (prefix filter), and the first such word
must leave enough later words on both sides (positional filter); a block with fewer than ``o`` template words cannot meet
it (length filter). What passes is verified by counting. Labels with ``exact`` templates are given only where the words
stand consecutively, which is checked inside the blocks that the join finds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import append_struct, need, send_by_value
from ._words import spans

send_by_value(__name__)

STRIDE, THRESHOLD = 32, 0.8
#: Everything but a-z, digits and non-ASCII separates words; A-Z are lower-cased.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False

    @property
    def words(self) -> list[bytes]:
        return self.text.encode().translate(_WORD).split()


#: Fixed phrases and their labels.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
#: Opening sentences of well-known notices.
NOTICES = (
    Template("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2-notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    Template("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("mpl-2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-nc-notice", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    Template("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form or by any means"),
)
FOUND = "n_words long, matches array<struct<label: string, exact: boolean, start: long, end: long, score: double>>"


def word_frequencies(docs: DataFrame, words: Sequence[bytes], text: str = "text") -> dict[bytes, int]:
    """Documents that hold each of ``words``: one row per word and task is shuffled, one per word returned."""
    known = {w: i for i, w in enumerate(words)}

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                held: set = set()
                for piece in spans((value.as_py() or b"").translate(_WORD)):
                    held.update(known.keys() & set(piece.split()))
                for w in held:
                    total[known[w]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["w", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(count, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in rows}
    return {w: counts.get(i, 0) for w, i in known.items()}


class Index:
    """Templates as sorted ranks of their words, filed under the ranks of their prefixes."""

    def __init__(self, templates: Sequence[Template], frequency: dict[bytes, int], threshold: float, stride: int) -> None:
        order = sorted(frequency, key=lambda w: (frequency[w], w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates, self.stride = templates, stride
        self.phrases = [np.array([self.rank[w] for w in t.words]) for t in templates]
        self.sets = [sorted(set(p.tolist())) for p in self.phrases]
        self.least = [len(s) if t.exact else max(1, math.ceil(threshold * len(s) - 1e-9)) for t, s in zip(templates, self.sets, strict=True)]
        self.width = stride + max(map(len, self.phrases)) - 1
        self.filed: dict[int, list[tuple[int, int]]] = {}
        for k, (s, least) in enumerate(zip(self.sets, self.least, strict=True)):
            for at, r in enumerate(s[: len(s) - least + 1]):
                self.filed.setdefault(r, []).append((k, at))
        self.in_prefix = np.zeros(len(order) + 1, bool)  # the last entry is for words of no template
        self.in_prefix[list(self.filed)] = True

    def ranks(self, data: bytes) -> np.ndarray:
        get, none = self.rank.get, len(self.rank)
        found = []
        for piece in spans(data.translate(_WORD)):
            words = piece.split()
            found.append(np.fromiter((get(w, none) for w in words), np.int32, len(words)))
        return np.concatenate(found)

    def scan(self, ranks: np.ndarray) -> list[tuple[str, bool, int, int, float]]:
        """(label, exact, first word, end word, share of the template's words): phrases where they stand, others by block."""
        hits = np.flatnonzero(self.in_prefix[ranks])
        if not len(hits):
            return []
        last = max(0, (len(ranks) - 1) // self.stride)
        lap = -(-self.width // self.stride)
        blocks = np.unique(np.clip(hits[:, None] // self.stride - np.arange(lap), 0, last))
        found: list[tuple[str, bool, int, int, float]] = []
        for b in blocks.tolist():
            start = b * self.stride
            block = ranks[start : start + self.width]
            held = np.unique(block[block < len(self.rank)]).tolist()
            for k in self._candidates(held):
                t, s = self.templates[k], self.sets[k]
                share = len(set(held).intersection(s)) / len(s)
                if share * len(s) < self.least[k] - 1e-9:
                    continue
                if t.exact:
                    found += [(t.label, True, p, p + len(self.phrases[k]), 1.0) for p in self._places(ranks, k, start)]
                else:
                    found.append((t.label, False, start, start + len(block), share))
        return sorted(found, key=lambda m: (m[2], m[0], m[3]))

    def _candidates(self, held: list[int]) -> list[int]:
        seen: set[int] = set()
        for j, r in enumerate(held):
            for k, i in self.filed.get(r, ()):
                if k not in seen and len(held) >= self.least[k] and 1 + min(len(self.sets[k]) - i - 1, len(held) - j - 1) >= self.least[k]:
                    seen.add(k)
        return sorted(seen)

    def _places(self, ranks: np.ndarray, k: int, start: int) -> list[int]:
        phrase = self.phrases[k]
        part = ranks[start : start + self.stride + len(phrase) - 1]
        n = len(part) - len(phrase) + 1
        if n < 1:
            return []
        here = np.ones(n, bool)
        for i, r in enumerate(phrase):
            here &= part[i : i + n] == r
        return (start + np.flatnonzero(here)).tolist()


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, threshold: float = THRESHOLD, stride: int = STRIDE, text: str = "text", into: str = "licenses") -> DataFrame:
    """``docs`` with a struct: ``n_words`` and ``matches`` (label, exact, start word, end word, score), ordered by start.

    Words are runs of a-z, digits and non-ASCII characters after lower-casing A-Z. Null and empty texts have no words and no
    matches. Two passes: word frequencies (a job when called), then the scan; nothing but counts of template words is
    shuffled. Repeated rows are scanned alike; a column named ``into`` is replaced.
    """
    need(docs, text)
    if any(not t.words for t in templates):
        raise ValueError("a template needs a word")
    vocabulary = sorted({w for t in templates for w in t.words})
    index = Index(templates, word_frequencies(docs, vocabulary, text), threshold, stride)

    def judge() -> Callable:
        def one(data: bytes | None) -> tuple:
            ranks = index.ranks(data or b"")
            names = ("label", "exact", "start", "end", "score")
            return len(ranks), [dict(zip(names, m, strict=True)) for m in index.scan(ranks)]

        return one

    return append_struct(docs, into, FOUND, judge, text)
