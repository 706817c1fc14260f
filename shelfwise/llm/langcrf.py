"""Word-level language identification by a linear-chain CRF (operator 8).

Every word has affix, byte n-gram and lexicon features, the n-grams over all of
its bytes; in scripts without spaces each character is a word, and other
non-ASCII runs of more than ``PIECE`` bytes are cut into words at character
boundaries, so that a change of language inside a run is seen.  The transitions
between word languages are learned too, so that code-switched text is labelled
word by word with forward-backward marginals.  A document's language is the
one with the largest mean marginal over all its words, its score that mean.

Training: a bounded sample, ``docs_per_lang`` documents of each language
(smallest hash of the id) and at most ``segments`` stretches of
``segment_words`` words spread over each text; pairs of stretches, of one
language or two, are joined so that switches are seen.  The fit runs on that
sample in the driver; prediction runs over all words of all texts.

Forward-backward is exact for texts of any length: texts are cut into runs of
``RUN`` words, each run becomes one transfer matrix, the matrices are scanned
per text, and the marginals are computed run by run from both boundaries.

Defined cases: null text and text without a letter is ``und`` with score 0;
without any labelled row every text is ``und``; ties go to the smaller
language; repeated rows and ids are ordinary rows; null ids are not learned
from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import text as tx

UNKNOWN = "und"
BUCKETS = 1 << 16
RUN = 32
PIECE = 64                 # bytes of a non-ASCII word at most
_BLOCK = 1 << 16           # n-gram places at a time
_GRAM = (2, 3)
_AFFIX = (1, 2, 3, 4)
#: scripts without spaces: Thai to Myanmar, Khmer, Tai, Balinese, East Asian, Javanese, full width
_UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
             (0x2E80, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFE30, 0xFE4F),
             (0xFF00, 0xFFEF))
_ASCII_LETTER = tx.byte_set((0x41, 0x5A), (0x61, 0x7A))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def _place(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return buf[np.minimum(at, len(buf) - 1)]


def _cut(w: tx.Words, at: np.ndarray) -> tx.Words:
    """The words cut before the bytes ``at``, where those are inside words."""
    new = np.zeros(len(w.buf) + 1, bool)
    new[at] = True
    new = new[:-1] & tx.WORD_CHARS[w.buf]
    new[w.start] = True
    start = np.flatnonzero(new)
    word = np.searchsorted(w.start, start, "right") - 1
    end = np.minimum(w.end[word], np.append(start[1:], len(w.buf)))
    row = w.row[word]
    count = np.bincount(row, minlength=len(w.count))
    return tx.Words(w.buf, start, end, row, (np.cumsum(count) - count).astype(np.int64), count)


def units(raw: np.ndarray, off: np.ndarray) -> tx.Words:
    """The words to label: runs of ``WORD_CHARS``, cut into characters in
    scripts without spaces and into pieces where other non-ASCII runs are long."""
    w = tx.words(raw, off, tx.WORD_CHARS)
    buf = w.buf
    wide = np.concatenate(([0], np.cumsum(buf >= 0x80)))
    if not wide[-1]:
        return w
    lead = np.flatnonzero(buf >= 0xE0)
    code = (((buf[lead] & 0x0F).astype(np.int64) << 12) | ((_place(buf, lead + 1) & 0x3F).astype(np.int64) << 6)
            | (_place(buf, lead + 2) & 0x3F))
    four = buf[lead] >= 0xF0
    alone = np.where(four, (buf[lead] == 0xF0) & (_place(buf, lead + 1) >= 0xA0), False)
    for lo, hi in _UNSPACED:
        alone |= ~four & (code >= lo) & (code <= hi)
    if alone.any():
        w = _cut(w, np.concatenate((lead[alone], np.minimum(lead + 3 + four, len(buf))[alone])))
    n = w.end - w.start
    long = np.flatnonzero((n > PIECE) & (wide[w.end] > wide[w.start]))
    if len(long):
        more = (n[long] - 1) // PIECE
        k = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        at = np.repeat(w.start[long], more) + k * PIECE
        for _ in range(3):
            at -= (buf[at] & 0xC0) == 0x80
        w = _cut(w, at)
    return w


def word_features(w: tx.Words, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature buckets of the words ``which``, as blocks of pairs (number of the
    word in ``which``, bucket) in the order of the words."""
    start, end = w.start[which], w.end[which]
    n = end - start

    def bucket(h: np.ndarray, kind: int) -> np.ndarray:
        return (tx.mix(h * tx.U(64) + tx.U(kind)) >> tx.U(48)).astype(np.int64) % BUCKETS

    # n-grams start at the blank before the word and end at the blank after it
    head = np.concatenate(([0], np.cumsum(n + 1)))
    for lo in range(0, int(head[-1]), _BLOCK):
        at = np.arange(lo, min(lo + _BLOCK, int(head[-1])))
        word = np.searchsorted(head, at, "right") - 1
        i = at - head[word]
        h = np.zeros(len(at), tx.U)
        for j in range(max(_GRAM)):
            inside = (i + j >= 1) & (i + j <= n[word])
            h = h * tx.U(257) + np.where(inside, _place(w.buf, start[word] + np.maximum(i + j - 1, 0)), 32)
            if j + 1 in _GRAM:
                ok = i + j <= n[word] + 1
                yield word[ok], bucket(h[ok], j + 1)
    pre = np.zeros(len(which), tx.U)
    suf = np.zeros(len(which), tx.U)
    for k in range(1, max(_AFFIX) + 1):
        pre = pre * tx.U(257) + _place(w.buf, start + k - 1)
        suf = suf * tx.U(257) + w.buf[np.maximum(end - k, 0)]
        if k in _AFFIX:
            ok = np.flatnonzero(n >= k)
            yield ok, bucket(pre[ok], 8 + k)
            yield ok, bucket(suf[ok], 16 + k)


def _sums(word: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows ``x`` for each word; ``word`` is sorted."""
    at = np.flatnonzero(np.diff(word, prepend=-1))
    return word[at], np.add.reduceat(x, at, axis=0) if len(at) else x


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray          # (BUCKETS + 1, L), the last row zero
    lexicon: np.ndarray          # sorted word hashes
    lex_weights: np.ndarray      # (len(lexicon) + 1, L), the last row zero
    start: np.ndarray
    trans: np.ndarray

    def lex_place(self, h: np.ndarray) -> np.ndarray:
        if len(self.lexicon) == 0:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == h, at, len(self.lexicon))

    def emissions(self, w: tx.Words, h: np.ndarray) -> np.ndarray:
        """Scores ``(words, L)``, computed once per distinct word."""
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        out = self.lex_weights[self.lex_place(distinct)].astype(np.float64)
        for k in range(0, len(first), 8192):
            for word, f in word_features(w, first[k:k + 8192]):
                word, x = _sums(word, self.weights[f].astype(np.float64))
                out[k + word] += x
        return out[back]


def _runs(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut rows of words into runs: row, first word (in the row) and length."""
    n = -(-count // RUN)
    row = np.repeat(np.arange(len(count)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, k, np.minimum(RUN, count[row] - k * RUN)


def marginals(e: np.ndarray, first: np.ndarray, count: np.ndarray, start: np.ndarray,
              trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward marginals ``(words, L)`` of every word; rows are
    ``count`` words from ``first``.  Scores are log weights.  Also returns each
    word's backward weight with its own score (up to a factor), from which the
    marginals of neighbouring pairs follow."""
    n_lab = e.shape[1]
    x = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -60.0))
    t = np.exp(trans - trans.max())
    row, k, length = _runs(count)
    at = first[row] + k * RUN
    step = np.minimum(at[:, None] + np.arange(RUN)[None, :], len(x) - 1)
    real = np.arange(RUN)[None, :] < length[:, None]
    n_run = len(row)

    def norm(a: np.ndarray) -> np.ndarray:
        return a / a.reshape(n_run, -1).sum(axis=1).reshape((-1,) + (1,) * (a.ndim - 1))

    # the first word of a text enters with the start weights, not a transition
    enter = np.repeat(t[None], n_run, axis=0)
    enter[k == 0] = np.exp(start - start.max())[None, None, :]
    mats = np.empty((n_run, n_lab, n_lab))
    for i in range(RUN):
        y = x[step[:, i]][:, None, :]
        if i == 0:
            mats = norm(enter * y)
        else:
            new = norm((mats.reshape(-1, n_lab) @ t).reshape(mats.shape) * y)
            mats = np.where(real[:, i, None, None], new, mats)
    # scan the runs of each text: state before each run and weight after it
    n_of = -(-count // RUN)
    head = np.cumsum(n_of) - n_of
    before = np.full((n_run, n_lab), 1.0 / n_lab)
    after = np.full((n_run, n_lab), 1.0 / n_lab)
    for j in range(1, int(n_of.max(initial=0))):
        r = head[n_of > j] + j
        s = np.einsum("ri,rij->rj", before[r - 1], mats[r - 1])
        before[r] = s / s.sum(axis=1, keepdims=True)
        r = (head + n_of - 1)[n_of > j] - j
        s = np.einsum("rij,rj->ri", mats[r + 1], after[r + 1])
        after[r] = s / s.sum(axis=1, keepdims=True)
    alpha = np.empty((RUN, n_run, n_lab))
    a = before
    for i in range(RUN):
        y = x[step[:, i]]
        new = norm((np.einsum("ri,rij->rj", a, enter) if i == 0 else a @ t) * y)
        a = np.where(real[:, i, None], new, a)
        alpha[i] = a
    out = np.empty_like(x)
    down = np.empty_like(x)
    b = after
    for i in range(RUN - 1, -1, -1):
        ok = real[:, i]
        g = alpha[i][ok] * b[ok]
        out[step[ok, i]] = g / g.sum(axis=1, keepdims=True)
        y = x[step[:, i]] * b
        down[step[ok, i]] = y[ok]
        b = np.where(ok[:, None], norm(y @ t.T), b)
    return out, down


def _sample(docs: DataFrame, docs_per_lang: int, segments: int, segment_words: int) -> DataFrame:
    """``(lang, id, seg)``: stretches of the labelled sample."""
    pool = docs.filter("lang is not null and t is not null").filter(
        F.crc32(F.col("id").cast("string")) % 5 != 0)
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = (pool.select("id", "lang").withColumn("n", F.row_number().over(rank))
           .filter(F.col("n") <= docs_per_lang).select("id", "lang").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            out = []
            for lo, hi, raw, off in tx.text_chunks(batch, "t"):
                w = units(raw, off)
                for r in range(hi - lo):
                    n = int(w.count[r])
                    k = min(segments, n // segment_words)
                    if k == 0 and n:
                        k = 1
                    for j in range(k):
                        a = int(w.first[r]) + (n - segment_words) * j // max(k - 1, 1) * (n > segment_words)
                        b = min(a + segment_words, int(w.first[r]) + n) - 1
                        out.append((lo + r, bytes(w.buf[w.start[a]:w.end[b]])))
            pick = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick),
                 pa.array([x[1] for x in out], pa.binary())], names=["id", "lang", "seg"])

    return (pool.join(F.broadcast(ids), ["id", "lang"], "left_semi").select("id", "lang", "t")
            .mapInArrow(run, "id long, lang string, seg binary").distinct())


def fit(docs: DataFrame, docs_per_lang: int = 60, segments: int = 8, segment_words: int = 20,
        epochs: int = 6, min_lexicon: int = 3, rate: float = 0.3, seed: int = 11) -> Model | None:
    """Fit on the bounded sample; None when nothing is labelled."""
    rows = sorted((r.lang, r.id, bytes(r.seg)) for r in
                  _sample(docs, docs_per_lang, segments, segment_words).toLocalIterator())
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    # sequences of two stretches, half of them of two languages where there are two
    order = rng.permutation(len(rows))
    mate = rng.permutation(len(rows))
    raw, off, seqs = bytearray(), [0], []
    for a, b in zip(order, mate, strict=True):
        seqs.append((langs.index(rows[a][0]), langs.index(rows[b][0])))
        raw += rows[a][2] + b"\n" + rows[b][2]
        off.append(len(raw))
    first_len = np.array([len(rows[a][2]) for a in order])
    off = np.array(off)
    w = units(np.frombuffer(bytes(raw), np.uint8), off)
    seqs = np.array(seqs)
    label = np.where(w.start - off[:-1][w.row] < first_len[w.row], seqs[w.row, 0], seqs[w.row, 1])
    h = w.hashes()
    distinct, at, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    n_lab = len(langs)
    m = Model(langs, np.zeros((BUCKETS + 1, n_lab)), distinct[n >= min_lexicon],
              np.zeros((int((n >= min_lexicon).sum()) + 1, n_lab)), np.zeros(n_lab),
              np.zeros((n_lab, n_lab)))
    pairs = list(word_features(w, at))
    word = np.concatenate([x for x, _ in pairs]) if pairs else np.zeros(0, np.int64)
    feats = np.concatenate([x for _, x in pairs])[np.argsort(word, kind="stable")] if pairs else word
    n_feats = np.bincount(word, minlength=len(distinct))
    head = np.cumsum(n_feats) - n_feats
    lex = m.lex_place(distinct)
    squares = [np.full_like(p, 1e-8) for p in (m.weights, m.lex_weights, m.start, m.trans)]
    batch = 128
    for _ in range(epochs):
        for lo in range(0, len(seqs), batch):
            lo_w, hi_w = int(w.first[lo]), int((w.first + w.count)[min(lo + batch, len(seqs)) - 1])
            if lo_w == hi_w:
                continue
            words_, which = np.unique(back[lo_w:hi_w], return_inverse=True)
            of = np.repeat(np.arange(len(words_)), n_feats[words_])
            f = feats[np.arange(len(of)) + (head[words_] - np.cumsum(n_feats[words_]) + n_feats[words_])[of]]
            e = (_sums(of, m.weights[f])[1] + m.lex_weights[lex[words_]])[which]
            first, count = w.first[lo:lo + batch] - lo_w, w.count[lo:lo + batch]
            p, down = marginals(e, first, count, m.start, m.trans)
            y = np.eye(n_lab)[label[lo_w:hi_w]]
            g = y - p
            grads = [np.zeros_like(m.weights), np.zeros_like(m.lex_weights)]
            of_word = np.zeros((len(words_), n_lab))
            np.add.at(of_word, which, g)
            np.add.at(grads[0], f, of_word[of])
            np.add.at(grads[1], lex[words_], of_word)
            heads = first[count > 0]
            grads.append(g[heads].sum(axis=0))
            # transitions: observed against expected pairs of neighbours
            inner = np.ones(hi_w - lo_w, bool)
            inner[heads] = False
            b = np.flatnonzero(inner)
            pair = np.exp(m.trans)[None] * down[b][:, None, :]
            pair *= (p[b - 1] / pair.sum(axis=2))[:, :, None]
            grads.append(y[b - 1].T @ y[b] - pair.sum(axis=0))
            params = (m.weights, m.lex_weights, m.start, m.trans)
            for q, gr, sq in zip(params, grads, squares, strict=True):
                gr = gr / batch - 1e-5 * q
                sq += gr * gr
                q += rate * gr / np.sqrt(sq)
            m.weights[-1] = 0
            m.lex_weights[-1] = 0
    m.weights = m.weights.astype(np.float32)
    m.lex_weights = m.lex_weights.astype(np.float32)
    return m


def _has_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    n = np.concatenate(([0], np.cumsum(_ASCII_LETTER[raw])))
    out = n[off[1:]] > n[off[:-1]]
    for r in np.flatnonzero(~out & (np.diff(off) > 0)).tolist():
        t = raw[off[r]:off[r + 1]]
        if (t >= 0x80).any():
            out[r] = any(c.isalpha() for c in t.tobytes().decode("utf-8", "ignore"))
    return out


def _label(batch: pa.RecordBatch, m: Model | None
           ) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, number of words and certainty (mean over the words of
    each word's largest marginal) of every text ``t`` of a batch."""
    pred, score, n_words, sure = [], [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for lo, hi, raw, off in tx.text_chunks(batch, "t"):
        n = hi - lo
        p, s, c = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
        w = units(raw, off)
        if m is not None and len(w.start):
            g, _ = marginals(m.emissions(w, w.hashes()), w.first, w.count, m.start, m.trans)
            some = np.flatnonzero(w.count > 0)
            mean = np.add.reduceat(g, w.first[some], axis=0) / w.count[some, None]
            best = mean.argmax(axis=1)
            ok = _has_letter(raw, off)[some]
            p[some[ok]] = np.array(m.langs, object)[best[ok]]
            s[some[ok]] = np.clip(mean[np.arange(len(some)), best], 0, 1)[ok]
            c[some] = np.add.reduceat(g.max(axis=1), w.first[some]) / w.count[some]
        pred += p.tolist()
        score.append(s)
        n_words.append(w.count)
        sure.append(c)
    return pred, np.concatenate(score), np.concatenate(n_words).astype(np.int64), np.concatenate(sure)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(id, th, n_words, lang_pred, score)`` per document row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"),
                    F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            pred, score, n_words, _ = _label(batch, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words), pa.array(pred, pa.string()),
                 pa.array(score)], names=["id", "th", "n_words", "lang_pred", "score"])

    return d.mapInArrow(run, "id long, th long, n_words long, lang_pred string, score double")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """The training columns of a documents table."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"),
                       F.col(lang_col).cast("string").alias("lang"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", **kw) -> DataFrame:
    """Fit on the labelled rows of the table and predict all of its texts."""
    return predict(docs, fit(labelled(docs, id_col, text_col, lang_col), **kw), id_col, text_col)


def drop_unidentified(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id",
                      text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents with a language whose words are labelled with a certainty
    (mean largest marginal) of ``min_score`` or more, however many languages
    they switch between; every row is judged where it is read, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled(docs, id_col, text_col, lang_col)))

    @F.arrow_udf("boolean")
    def identified(t: pa.Array) -> pa.Array:
        pred, _, _, sure = _label(pa.RecordBatch.from_arrays([t], names=["t"]), shared.value)
        tx.release()
        return pa.array((np.array(pred, object) != UNKNOWN) & (sure >= min_score), pa.bool_())

    return docs.filter(identified(F.col(text_col).cast("string")))
