"""License scans: templates found in texts by MinHash bands over overlapping windows.

A template of n word shingles is looked for in windows that overlap by so much that any n shingles lie
whole inside one (window >= n + step - 1). A window that holds the wanted share of a template's shingles
resembles it at least to a computable degree, and the number of bands is chosen from that degree so
that such a window shares a band with the template with at least the wanted probability. Every
candidate is verified by exact containment of its word shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.tokens import hash_words

SHINGLE = 3  # words; the shortest notices have five
CONTAINED = 0.8  # share of a template's shingles
MISSED = 1e-3  # probability that a window holding that share has no band in common with it
ROWS = 2  # minima per band
PIECE = 1 << 19  # bytes of text worked on at once

_fold = np.zeros(256, np.uint8)
for _b in range(256):
    if _b > 127 or chr(_b).isalnum():
        _fold[_b] = ord(chr(_b).lower()) if _b < 128 else _b


class Template(NamedTuple):
    license: str
    text: str


@dataclass
class Wanted:
    """A template's shingles, and the window (in shingles) and step in which it is looked for."""

    license: str
    shingles: frozenset[bytes]
    window: int
    step: int
    likeness: float

    @classmethod
    def of(cls, template: Template) -> Wanted:
        words = words_of(template.text.encode())
        if len(words) < SHINGLE:
            raise ValueError(f"{template.license}: a template needs {SHINGLE} words")
        shingles = frozenset(shingles_of(words))
        n = len(words) - SHINGLE + 1
        step = 1 << max(1, int(math.log2(max(2, n / 3))))  # about a third of the template, a power of two
        window = -(-(n + step - 1) // step) * step
        least = math.ceil(CONTAINED * len(shingles))
        return cls(template.license, shingles, window, step, least / (window + len(shingles) - least))


def words_of(raw: bytes) -> list[bytes]:
    folded = _fold[np.frombuffer(raw, np.uint8)]
    folded[folded == 0] = 32
    return folded.tobytes().split()


def shingles_of(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)]


def bands_for(likeness: float, missed: float = MISSED) -> int:
    """Bands of ROWS minima with which sets of that Jaccard likeness share a band but for `missed` of cases."""
    return math.ceil(math.log(missed) / math.log(1 - likeness**ROWS)) if likeness < 1 else 1


def _shingle_hashes(words: np.ndarray) -> np.ndarray:
    """32 bits per shingle; equal hashes of unequal shingles only make candidates that are not verified."""
    out = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        out = (out ^ words[k : len(words) - SHINGLE + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32)


def _band_key(minima: Sequence[np.ndarray]) -> np.ndarray:
    key = minima[0]
    for m in minima[1:]:
        key = key * np.uint32(0x85EBCA6B) + m
    return key * np.uint32(0x9E3779B1)


class Scanner:
    """The bands of all templates, by window and step."""

    def __init__(self, templates: Sequence[Template], seed: int = 5):
        self.wanted = [Wanted.of(t) for t in templates]
        self.members: dict[tuple[int, int], list[int]] = {}
        for k, w in enumerate(self.wanted):
            self.members.setdefault((w.step, w.window), []).append(k)
        self.bands = {size: max(bands_for(self.wanted[k].likeness) for k in own) for size, own in self.members.items()}
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 2**31, (max(self.bands.values(), default=0), ROWS), np.uint32) * np.uint32(2) + np.uint32(1)
        # Of each size and band: the templates' keys, and a flag for each leading half of a key.
        self.keys: dict[tuple[int, int, int], np.ndarray] = {}
        self.flags: dict[tuple[int, int, int], np.ndarray] = {}
        for size, own in self.members.items():
            hashed = [_shingle_hashes(hash_words(_fold[np.frombuffer(templates[k].text.encode(), np.uint8)])[2]) for k in own]
            for band in range(self.bands[size]):
                keys = np.array([_band_key([(h * f).min(keepdims=True) for f in self.factors[band]])[0] for h in hashed], np.uint32)
                flags = np.zeros(1 << 16, bool)
                flags[keys >> np.uint32(16)] = True
                self.keys[*size, band], self.flags[*size, band] = keys, flags

    def candidates(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first word, past the last) of windows that share a band with a template."""
        shingles = _shingle_hashes(words)
        found: set[tuple[int, int, int]] = set()
        if not len(shingles) or not self.members:
            return []
        # Filled up so that windows of every size may reach past the end.
        longest = max(window for _, window in self.members)
        most = max(step for step, _ in self.members)
        filled = np.full(-(-(len(shingles) + 2 * longest) // most) * most, 0xFFFFFFFF, np.uint32)
        for band, factors in enumerate(self.factors):
            minima: dict[tuple[int, int], list[np.ndarray]] = {}
            for f in factors:
                filled[: len(shingles)] = shingles * f
                runs, step = filled, 1
                for size in sorted(self.members):  # by step: longer runs are made of shorter ones
                    if self.bands[size] <= band:
                        continue
                    while step < size[0]:
                        runs, step = np.minimum(runs[::2], runs[1::2]), step * 2
                    minima.setdefault(size, []).append(_window_minima(runs, size[1] // step, -(-len(shingles) // step)))
            for size, rows in minima.items():
                keys = _band_key(rows)
                for at in np.flatnonzero(self.flags[*size, band][keys >> np.uint32(16)]):
                    for k in np.flatnonzero(self.keys[*size, band] == keys[at]):
                        first = int(at) * size[0]
                        found.add((self.members[size][k], first, first + size[1] + SHINGLE - 1))
        return sorted(found)


def _window_minima(runs: np.ndarray, width: int, count: int) -> np.ndarray:
    """Minima of `width` neighbouring runs, by doubling."""
    have, span = runs, 1
    while span * 2 <= width:
        have, span = np.minimum(have[:-span], have[span:]), span * 2
    return np.minimum(have[:count], have[width - span : width - span + count])


def scan_texts(scanner: Scanner, texts: Sequence[str | None]) -> Iterator[tuple[int, str, int, int, float]]:
    """(text, license, start, end, containment) of each match, in characters; overlapping matches are one."""
    longest = max((w.window + SHINGLE for w in scanner.wanted), default=0)
    spans: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    raws = [(t or "").encode() for t in texts]

    def work(group: list[tuple[int, int, bytes]]) -> None:
        """group: text, offset of the piece in its text, piece."""
        joined = b"\0".join(raw for *_, raw in group)
        bounds = np.cumsum([0, *(len(raw) + 1 for *_, raw in group)])
        starts, ends, words = hash_words(_fold[np.frombuffer(joined, np.uint8)])
        owner = np.searchsorted(bounds, starts, side="right") - 1
        for k, first, past in scanner.candidates(words):
            past = min(past, len(words))
            for piece in range(owner[first], owner[past - 1] + 1):  # a window may reach over pieces: each is verified alone
                a, b = max(first, np.searchsorted(owner, piece)), min(past, np.searchsorted(owner, piece, side="right"))
                own = shingles_of([words_of(joined[starts[i] : ends[i]])[0] for i in range(a, b)])
                held = [n for n, s in enumerate(own) if s in scanner.wanted[k].shingles]
                share = len({own[n] for n in held}) / len(scanner.wanted[k].shingles)
                if share >= CONTAINED:
                    text, offset, _ = group[piece]
                    base = offset - int(bounds[piece])
                    spans.setdefault((text, k), []).append((base + int(starts[a + held[0]]), base + int(ends[a + held[-1] + SHINGLE - 1]), share))

    group, held = [], 0
    for text, raw in enumerate(raws):
        for offset, piece in _cut(raw, longest):
            group.append((text, offset, piece))
            held += len(piece)
            if held >= PIECE:
                work(group)
                group, held = [], 0
    if group:
        work(group)
    for (text, k), found in sorted(spans.items()):
        merged: list[list] = []
        for start, end, share in sorted(found):
            if merged and start < merged[-1][1]:
                merged[-1][1:] = [max(end, merged[-1][1]), max(share, merged[-1][2])]
            else:
                merged.append([start, end, share])
        for start, end, share in merged:
            before = len(raws[text][:start].decode("utf-8", "ignore"))
            yield text, scanner.wanted[k].license, before, before + len(raws[text][start:end].decode("utf-8", "ignore")), share


def _cut(raw: bytes, overlap: int) -> Iterator[tuple[int, bytes]]:
    """Pieces of a text that end between words; each begins with the last `overlap` words of the one before."""
    at = 0
    while len(raw) - at > PIECE:
        folded = _fold[np.frombuffer(raw, np.uint8, count=min(len(raw) - at, 4 * PIECE), offset=at)]
        gaps = np.flatnonzero(folded[PIECE:] == 0)
        if not len(gaps):
            break
        end = PIECE + int(gaps[0])
        yield at, raw[at : at + end]
        first = np.flatnonzero((folded[1:end] != 0) & (folded[: end - 1] == 0))
        at += int(first[-overlap]) + 1 if len(first) > overlap else end
    yield at, raw[at:]


def find_licenses(docs: DataFrame, templates: Sequence[Template], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, start, end (character positions) and containment: a row per match in each whole text.

    Null and empty texts have none. Repeated rows give repeated matches; a null doc_id is kept. Words are
    runs of ASCII letters and digits and of other alphabets' bytes, without case. Nothing is shuffled.
    """
    given = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = list(scan_texts(scanner, part.column(1).to_pylist()))
                rows = pa.array([f[0] for f in found], pa.int64())
                columns = [pa.array([f[k] for f in found], t) for k, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), *columns], ["doc_id", "license", "start", "end", "containment"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(scan, f"doc_id {kind}, license string, start long, end long, containment double")


#: Wordings of public licenses and of the notices that refer to them.
TEMPLATES = [
    Template("MIT", "Released under the MIT License."),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template(
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    Template(
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at",
    ),
    Template(
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    Template(
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
]


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), TEMPLATES)


QUERIES = {"op9_licenses": op9_licenses}
SQL: dict[str, str] = {}
