"""Language ID of mixed-language texts, long words and scripts without spaces."""

import random

from llm_fixtures import docs_of  # noqa: F401
from shelfwise.llm import langcrf

ALPHABET = {"xx": "abcdefg", "yy": "hijklmn", "zz": "opqrstu"}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choices(ALPHABET[lang], k=5)) for _ in range(n))


def test_clean_mixed_documents_stay(docs_of):
    rng = random.Random(3)
    rows = [(i, text_of(rng, lang, 60), lang) for i, lang in enumerate(list(ALPHABET) * 15)]
    mixed = [(100, " ".join(text_of(rng, x, 30) for x in ("xx", "yy", "zz")), None),
             (101, " ".join(text_of(rng, x, n) for x, n in (("xx", 49), ("zz", 2), ("yy", 49))), None),
             (102, " ".join(text_of(rng, x, 20) for x in ("xx", "yy", "zz") * 3), None)]
    docs = docs_of(rows + mixed + [(200, None), (201, "12 34")])
    scores = {r.id: r.score for r in langcrf.identify(docs).collect()}
    assert all(scores[i] < 0.5 for i, *_ in mixed)
    kept = {r.doc_id for r in langcrf.drop_unidentified(docs).collect()}
    assert kept == {i for i, *_ in rows + mixed}


def test_scripts_without_spaces_are_labelled_inside(docs_of):
    """A text without ASCII spaces that changes language in its middle."""
    rng = random.Random(5)
    kana, hanzi, thai = ([chr(a + i) for i in range(40)] for a in (0x3042, 0x4E00, 0x0E01))
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    rows = [(i, some(chars, 80) + "。" + some(chars, 40), lang)
            for i, (lang, chars) in enumerate([("ja", kana), ("zh", hanzi), ("th", thai)] * 15)]
    switch = [(100, some(kana, 30) + some(hanzi, 60) + some(kana, 10), None),
              (101, some(thai, 50) + "english" + some(thai, 50), None)]
    found = {r.id: r for r in langcrf.identify(docs_of(rows + switch)).collect()}
    assert found[100].lang_pred == "zh" and 0.55 <= found[100].score <= 0.65
    assert found[100].n_words == 100 and found[101].n_words == 101 and found[101].lang_pred == "th"
    assert all(found[i].lang_pred == lang for i, _, lang in rows)


def test_the_middle_of_long_words_counts(docs_of):
    """Words that differ in their middle alone, none of them seen twice."""
    rng = random.Random(7)

    def text(middle):
        return " ".join("приставка" + "".join(rng.choices(middle, k=8)) + "окончание" for _ in range(25))

    rows = [(i, text(m), lang) for i, (lang, m) in enumerate([("xx", "бвгджз"), ("yy", "лмнпрс")] * 15)]
    more = [(100 + i, text(m), None) for i, m in enumerate(["бвгджз", "лмнпрс"] * 5)]
    found = {r.id: r.lang_pred for r in langcrf.identify(docs_of(rows + more)).collect()}
    assert [found[i] for i, *_ in more] == ["xx", "yy"] * 5


def test_units_keep_all_bytes():
    import numpy as np

    texts = ["ab 日本語、続くenglish中文ok " + "щ" * 70, "", "x" * 200 + " 𠀀𠀁", "é " + "ж" * 33 + "q" * 200]
    raw = [t.encode() for t in texts]
    w = langcrf.units(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = [bytes(w.buf[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert "".join(got) == "".join(texts).replace(" ", "")
    assert got[:5] == ["ab", "日", "本", "語", "、"] and "english" in got and "x" * 200 in got
    assert w.count[1] == 0 and w.count.sum() == len(got)
    assert max(len(g.encode()) for g in got if not g.isascii()) <= langcrf.PIECE
    assert list(w.row) == sorted(w.row) and list(w.first[[0, 2, 3]]) == [0, w.count[0], w.count[:3].sum()]
