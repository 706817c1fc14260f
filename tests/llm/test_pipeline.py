"""The corpus pipeline stage by stage against brute force, with planted copies,
passages, benchmark items and clean documents."""

import random
import zlib

import corpus_pipeline as cp
import pytest
from llm_fixtures import DOCS, docs_of  # noqa: F401
from shelfwise.llm import mixing
from test_simhash import components, fingerprint
from test_suffix import brute as repeats
from test_text_ops import best_windows

SYLLABLES = {"en": "the ing er ough ly tion", "de": "sch ung ein ich keit bar", "fr": "eau que ment ois elle ais"}


def prose(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    langs = list(SYLLABLES)
    clean = [(i, prose(rng, langs[i % 3], rng.randint(60, 160)), langs[i % 3], f"s{i % 4}") for i in range(120)]
    # two documents share item 0, so the suffix stage cuts it; the other five reach the decontamination
    items = [(i, prose(rng, "en", 40)) for i in range(6)]
    passage = prose(rng, "de", 60)
    rows = list(clean)
    rows += [(200 + i, None if i % 2 else " 12 .. 34 ", None, "s0") for i in range(6)]              # no letter
    rows += [(300 + i, clean[i][1], *clean[i][2:]) for i in range(20)]                              # exact copies
    rows += [(400 + i, clean[30 + i][1] + " x", *clean[30 + i][2:]) for i in range(10)]             # near copies
    rows += [(500 + i, f"{prose(rng, 'de', 50)} {passage} {prose(rng, 'de', 50)}", "de", "s1") for i in range(8)]
    rows += [(600 + i, f"{prose(rng, 'en', 50)} {items[i % 6][1]} {prose(rng, 'en', 50)}", "en", "s2") for i in range(7)]
    rows += [(700, f"{prose(rng, 'en', 40)} {prose(rng, 'fr', 40)}", None, None)]                   # two languages
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_every_stage_against_brute_force(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        assert out.columns == columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, [(r.doc_id, r.text) for r in docs.collect()])

    before, after = seen["language_id"]
    assert sorted(after) == sorted(r for r in before if not 200 <= r[0] < 300)

    before, after = seen["simhash_near_dedup"]
    comp = components([(i, fingerprint(t)) for i, t in before], 4)
    assert sorted(after) == sorted(r for r in before if comp[r[0]] == r[0])
    assert not any(300 <= i < 400 for i, _ in after)

    before, after = seen["suffix_array_dedup"]
    cut = {i: (n, sha) for i, _, n, _, sha in repeats(before)}
    kept = dict(after)
    assert set(kept) == {i for i, t in before if cut[i][0] < len((t or "").encode())}
    import hashlib
    for i, t in kept.items():
        assert hashlib.sha256(t.encode()).hexdigest() == cut[i][1]
    assert any(cut[500 + i][0] > 200 for i in range(8)) and all(kept[i] == t for i, t in before if not cut[i][0])

    before, after = seen["benchmark_decontamination"]
    hit = {d for d, _ in best_windows(before, items)}
    assert sorted(after) == sorted(r for r in before if r[0] not in hit) and len(hit) >= 5

    before, after = seen["source_mixing"]
    counts = {r.id: r.copies for r in mixing.plan(spark.read.parquet(f"{folder}/benchmark_decontamination")).collect()}
    assert sorted(after) == sorted(r for r in before for _ in range(counts[r[0]]))

    # clean documents that share nothing pass every filter
    calm = {i for i, _ in after} | {i for i in counts if counts[i] == 0}
    assert calm >= {r[0] for r in rows if 50 <= r[0] < 120}


def test_run_gives_the_stages_result(spark, corpus):
    folder, _, _ = corpus
    got = sorted((r.doc_id, r.text) for r in cp.run(spark, folder).collect())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
    assert got == sorted((r.doc_id, r.text) for r in docs.collect())
    assert zlib.crc32(str(got).encode()) == zlib.crc32(str(sorted(
        (r.doc_id, r.text) for r in cp.run(spark, folder).collect())).encode())
