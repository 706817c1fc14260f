"""Ranked lexical search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import docs_of, table  # noqa: F401
from shelfwise.llm import lexsearch as ls


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=10):
    """Sorted (item_id, rank, doc_id, score) from (id, text) rows."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found, wanted = [], Counter(terms(text))
        for (i, c), n in zip(counts, sizes, strict=True):
            score = 0
            for t, times in wanted.items():
                if t in c:
                    m = 25 + 75 * n * n_docs // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def found(docs, items, **kw):
    return sorted((tuple(r) for r in ls.search(docs, items, **kw).collect()), key=str)


def test_all_of_a_table(table):
    docs, items = table("documents", "0.001"), table("benchmark", "0.001")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, [(r.item_id, r.text) for r in items.collect()])
    assert found(docs, items) == want and len(want) > 50


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(3)
    text = lambda n, k: " ".join(f"W{rng.randrange(k)}" for _ in range(n))
    docs = [(1, None), (2, ""), (3, "... --"), (4, "Über straße ÜBER"), (5, "one"), (6, "w1 " * 5000),
            (7, "x" * 200_000), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (8, "w1 w2 w3"), (8, "w1 w2 w3")]
    docs += [(20 + i, text(rng.randint(1, 60), 80)) for i in range(300)]
    docs += [(400 + i, "tie tie w9") for i in range(30)]
    items = [(1, "w1 w2 w2 w3"), (2, None), (3, "nowhere to be found"), (4, "Tie"), (5, "straße über"),
             (6, ""), (7, text(200, 80)), (7, "one one"), (8, "X" * 200_000), (9, "- , ."), (None, "w5 w6")]
    return docs, items + [(100 + i, text(rng.randint(1, 12), 80)) for i in range(60)]


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_edge_cases(spark, docs_of, awkward, k):
    docs, items = awkward
    assert found(docs_of(docs), items_of(spark, items), k=k) == brute(docs, items, k)


def test_one_partition_and_many(spark, docs_of, awkward):
    docs, items = awkward
    want = brute(docs, items)
    for n in (1, 13):
        assert found(docs_of(docs).repartition(n), items_of(spark, items)) == want


def test_empty_tables(spark, docs_of, awkward):
    docs, items = awkward
    assert found(docs_of([]), items_of(spark, items)) == []
    assert found(docs_of(docs), items_of(spark, [])) == []
    assert found(docs_of(docs[:3]), items_of(spark, items)) == []


def test_blocks_and_clashing_columns(spark, docs_of, awkward, monkeypatch):
    docs, items = awkward
    monkeypatch.setattr(ls, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(ls, "TREE_ITEMS", 10)
    odd = docs_of(docs).selectExpr("*", "1 as id", "'x' as t", "2 as item", "3 as score", "4 as rank")
    assert found(odd, items_of(spark, items).selectExpr("*", "5 as doc_id", "6 as i")) == brute(docs, items)


def group(rng, n, vocab):
    rows = [Counter(rng.choices(range(vocab), k=rng.randint(1, 12))) for _ in range(n)]
    r = np.repeat(np.arange(n), [len(c) for c in rows])
    t = np.array([x for c in rows for x in c])
    v = np.array([rng.randrange(1, 6) * 100 for _ in t])
    return r, t, v


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 90), st.integers(1, 120), st.sampled_from([3, 40, 400]),
       st.sampled_from([1, 4, 50]))
def test_trees_prune_exactly(seed, n_items, n_docs, size, k):
    """Groups one after the other give each item's best documents, ties by id."""
    rng = random.Random(seed)
    vocab = ls.Vocabulary(sorted(b"t%d" % i for i in range(size)))
    counts = [Counter(b"t%d" % rng.randrange(size) for _ in range(rng.randint(1, 8))) for _ in range(n_items)]
    weight = np.array([rng.randrange(4) for _ in range(size)])
    tree = ls.ItemTree(list(range(n_items)), counts, vocab, weight, k)
    dense = np.zeros((n_items, size), np.int64)
    for i, c in enumerate(counts):
        for t, n in c.items():
            dense[i, vocab.place[t]] = n * weight[vocab.place[t]]
    want = [[] for _ in counts]
    for g in range(3):
        r, t, v = group(rng, n_docs, size)
        ids = np.array(rng.sample(range(10_000), n_docs)) + 10_000 * (2 - g)
        tree.search(ids, np.zeros(n_docs, bool), r, t, v)
        m = np.zeros((n_docs, size), np.int64)
        m[r, t] = v
        for i, row in enumerate((dense @ m.T).tolist()):
            want[i] += [(-s, int(d)) for s, d in zip(row, ids, strict=True) if s > 0]
    assert sorted(tree.results()) == sorted((i, d, -s) for i, w in enumerate(want) for s, d in sorted(w)[:k])


def test_pairs_are_pruned():
    """Items and documents of separate topics: most leaf pairs are never scored."""
    rng = random.Random(1)
    vocab = ls.Vocabulary(sorted(b"t%d" % i for i in range(1000)))
    counts = [Counter(b"t%d" % (100 * (i % 10) + rng.randrange(100)) for _ in range(10)) for i in range(200)]
    tree = ls.ItemTree(list(range(200)), counts, vocab, np.ones(1000, np.int64), 5)
    for _ in range(3):
        topic = np.arange(600) % 10
        r = np.repeat(np.arange(600), 30)
        t = np.array([vocab.place[b"t%d" % (100 * topic[x] + rng.randrange(100))] for x in r])
        key = np.unique(r * 1000 + t)
        tree.search(np.arange(600), np.zeros(600, bool), key // 1000, key % 1000, np.full(len(key), 7))
    assert tree.scored < 0.35 * tree.pairs


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    """With a useless hash the bytes decide."""
    monkeypatch.setattr(ls.tx.Words, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    vocab = ls.Vocabulary([b"aa", b"ab", b"b", b"ccc"])
    raw = np.frombuffer(b"ab ccc zz b aa abc ab", np.uint8)
    w = ls._words(raw, np.array([0, len(raw)]))
    at, term = vocab.find(w)
    names = {i: t for t, i in vocab.place.items()}
    assert sorted((int(a), names[int(t)]) for a, t in zip(at, term, strict=True)) == [
        (0, b"ab"), (1, b"ccc"), (3, b"b"), (4, b"aa"), (6, b"ab")]


def test_large_sums_are_exact():
    """Weights above what doubles hold exactly are summed as integers."""
    vocab = ls.Vocabulary([b"a", b"b"])
    tree = ls.ItemTree([0], [Counter({b"a": 10 ** 7 + 1, b"b": 3})], vocab, np.array([30_001, 29_999]), 1)
    assert tree.vec.dtype == np.int64
    p = vocab.place
    tree.search(np.array([5]), np.array([False]), np.array([0, 0]), np.array([p[b"a"], p[b"b"]]),
                np.array([999_983, 7]))
    w = {p[b"a"]: (10 ** 7 + 1, 999_983), p[b"b"]: (3, 7)}
    assert list(tree.results()) == [(0, 5, sum(n * x * [30_001, 29_999][i] for i, (n, x) in w.items()))]
