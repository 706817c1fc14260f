"""License scans (operator 3).

Two results per text, over its lower-cased words:

* base labels: every place where the words of a phrase stand consecutively;
* template labels: an exact set-similarity join of text blocks with license
  templates.  The tokens of all templates are ordered by their frequency in
  the whole corpus, rarest first.  A block that contains at least the share
  ``threshold`` of a template's tokens must hold one of the template's first
  ``size - need + 1`` tokens (prefix filter), at least ``need`` words (length
  filter) and, behind the first token they share, enough tokens on both sides
  (positional filter); what passes is counted exactly.

A block of a template is a stretch of twice its words, every template length
(so any stretch as long as the template lies inside one block).

The templates are a fixed list, so their index is a few kilobytes.

Defined cases: null and empty texts have no words, labels or places and score
0; equal rows give equal results; ties among templates give all labels; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import text as tx

# fixed values: base phrases and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# fixed values: opening notices of common licenses
TEMPLATES = {
    "all-rights-reserved": "all rights reserved",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except "
        "in compliance with the license you may obtain a copy of the license at"),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met"),
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of "
        "the gnu general public license as published by the free software foundation"),
    "mit": "released under the mit license",
    "mit-notice": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files to deal in the software without restriction"),
}

SCHEMA = ("id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double")


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return tx.words(raw, np.array([0, len(raw)]), tx.WORD_CHARS).hashes()


def _vocabulary(templates: dict[str, str]) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(t) for t in templates.values()]))


def _lookup(vocab: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the vocabulary, or -1."""
    low = np.zeros(1 << 16, bool)
    low[(vocab >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(low[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocab, h[maybe]), len(vocab) - 1)
    out = np.full(len(h), -1)
    out[maybe] = np.where(vocab[at] == h[maybe], at, -1)
    return out


def token_counts(docs: DataFrame, templates: dict[str, str] = TEMPLATES,
                 text_col: str = "text") -> np.ndarray:
    """Occurrences of every template token in all documents, by its place in
    the vocabulary (as many rows reach the driver as the templates have tokens)."""
    vocab = _vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocab) + 1, np.int64)
        for batch in batches:
            for _, _, raw, off in tx.text_chunks(batch, "t"):
                n += np.bincount(_lookup(vocab, tx.words(raw, off, tx.WORD_CHARS).hashes()) + 1,
                                 minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocab))), pa.array(n[1:])],
                                         names=["token", "n"])

    rows = (docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "token long, n long")
            .groupBy("token").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(len(vocab), np.int64)
    for r in rows:
        out[r.token] = r.n
    return out


def _phrase_places(h: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[:n] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[(h[at + j] == phrase[j]) & (row[at + j] == row[at])]
    return at


def _contained(row: np.ndarray, pos: np.ndarray, count: np.ndarray, rank: np.ndarray, size: int,
               width: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Best containment of one template in the blocks of each row that has a
    block meeting the threshold; ``rank`` is the token's place in the
    template's rarest-first order (-1: not in the template)."""
    need = int(np.ceil(threshold * size - 1e-9))
    mine = rank >= 0
    row, pos, rank = row[mine], pos[mine], rank[mine]
    n_blocks = int(count.max(initial=0)) // width + 2
    block = row * n_blocks + pos // width
    # a word lies in the block that starts at or before it and in the one before
    block = np.concatenate([block, (block - 1)[pos >= width]])
    rank = np.concatenate([rank, rank[pos >= width]])
    block = np.unique(block * size + rank)
    block, rank = block // size, block % size
    if len(block) == 0:
        return block, np.zeros(0)
    head = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    shared = np.diff(np.append(head, len(block)))
    first = rank[head]
    start = (block[head] % n_blocks) * width
    words_in = np.minimum(count[block[head] // n_blocks] - start, 2 * width)
    prefix = first < size - need + 1
    length = words_in >= need
    positional = np.minimum(size - first, shared) >= need
    ok = prefix & length & positional
    ok[ok] = shared[ok] >= threshold * size - 1e-9
    r = block[head][ok] // n_blocks
    best = np.zeros(len(count))
    np.maximum.at(best, r, shared[ok] / size)
    r = np.unique(r)
    return r, best[r]


def scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] = TEMPLATES,
         phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_words, n_base, first_word, last_word,
    base_labels, labels, score``.  ``labels`` holds the base labels and the
    labels of all templates that a block contains to the threshold; ``score``
    is 1 with a base phrase, else the best containment found (0 without)."""
    counts = token_counts(docs, templates, text_col)
    vocab = _vocabulary(templates)
    plans = []
    for label, t in sorted(templates.items()):
        h = _hashes(t)
        tokens = _lookup(vocab, np.unique(h))
        order = tokens[np.lexsort((tokens, counts[tokens]))]
        rank = np.full(len(vocab) + 1, -1)
        rank[order] = np.arange(len(order))
        plans.append((label, rank, len(order), len(h)))
    base = [(label, _hashes(p)) for p, label in sorted(phrases.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_base, first, last, base_labels, labels, score = [], [], [], [], [], [], []
            for lo, hi, raw, off in tx.text_chunks(batch, "t"):
                n = hi - lo
                w = tx.words(raw, off, tx.WORD_CHARS)
                h = w.hashes()
                found: list[set[str]] = [set() for _ in range(n)]
                best = np.zeros(n)
                place = [_phrase_places(h, w.row, p) for _, p in base]
                for (label, _), at in zip(base, place, strict=True):
                    for r in np.unique(w.row[at]).tolist():
                        found[r].add(label)
                at = np.sort(np.concatenate(place)) if len(h) else np.zeros(0, np.int64)
                base_labels += [",".join(sorted(f)) for f in found]
                hits = np.bincount(w.row[at], minlength=n)
                n_base.append(hits)
                end = np.cumsum(hits)
                pos = (at - w.first[w.row[at]]).tolist()
                first += [pos[e - k] if k else None for e, k in zip(end, hits, strict=True)]
                last += [pos[e - 1] if k else None for e, k in zip(end, hits, strict=True)]
                best[hits > 0] = 1.0
                token = _lookup(vocab, h)
                some = np.flatnonzero(token >= 0)
                where = w.position[some]
                for label, rank, size, width in plans:
                    rows, share = _contained(w.row[some], where, w.count, rank[token[some]], size,
                                             width, threshold)
                    best[rows] = np.maximum(best[rows], share)
                    for r in rows.tolist():
                        found[r].add(label)
                labels += [",".join(sorted(f)) for f in found]
                n_words.append(w.count)
                score.append(best)
            if n_words:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(n_words).astype(np.int64)),
                     pa.array(np.concatenate(n_base).astype(np.int64)), pa.array(first, pa.int64()),
                     pa.array(last, pa.int64()), pa.array(base_labels, pa.string()),
                     pa.array(labels, pa.string()), pa.array(np.concatenate(score))],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("t")).mapInArrow(run, SCHEMA)
