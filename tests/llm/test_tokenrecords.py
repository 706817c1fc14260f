"""Token records: checksums, exact encoding, round trips, damaged files."""

import glob
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import docs_of, table  # noqa: F401
from shelfwise.llm import tokenrecords as tr
from shelfwise.llm.crc32c import crc32c, masked
from shelfwise.llm.queries import QUERIES
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = tr.Encoder(PATH)


def slow_crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def whole(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_crc32c():
    assert slow_crc(b"123456789") == 0xE3069283
    rng = random.Random(0)
    data = bytes(rng.randrange(256) for _ in range(6000))
    spans = [(2 * a, 2 * a + 2 * n) for a, n in [(0, 2), (1, 3), (5, 127), (9, 128), (9, 129), (40, 257), (0, 3000)]]
    a = np.array(spans) // 2
    got = crc32c(np.frombuffer(data, np.uint16), a[:, 0], a[:, 1] - a[:, 0])
    assert got.tolist() == [slow_crc(data[x:y]) for x, y in spans]
    c = int(got[0])
    assert int(masked(got)[0]) == (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def encode(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))).astype(np.int64)
    ids, count = ENCODER.ids(raw, off)
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \t\n\r 　 ab'sé中!.,1́😀|<>"), max_size=30), min_size=1,
                max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    assert encode(texts) == [whole(t) for t in texts]


def test_special_strings():
    texts = ["a\n<|endoftext|>\nb", "a \n<|endoftext|>\n\nb.\nC\n\n D", "it's 'sx ''s 12'll 's", "a <|endoftext|> b", " <|endoftext|>", "<|endoftext|><|endoftext|>x", "we're it's  I'll", ""]
    assert encode(texts) == [whole(t) for t in texts]
    assert 50256 not in tr.Encoder(PATH, specials_are_text=True).ids(
        np.frombuffer(b"<|endoftext|>", np.uint8), np.array([0, 13]))[0]


def want(rows):
    """The query's rows; equal ids in the order of their texts' ids."""
    out, at = [], 0
    for i, ids in sorted(((i, whole(t) + [2]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((i, at, len(ids), zlib.crc32(b"".join(struct.pack("<I", x) for x in ids))))
        at += len(ids)
    return out


def test_documents(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    got = sorted(tuple(r) for r in QUERIES["op11_token_records"](spark, "/root/testdata/sf0.001").collect())
    assert got == want(rows)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/records"


AWKWARD = [(5, None), (-3, ""), (None, "no id"), (7, "x" * 300_000), (9, "  tabs\tand\n lines "), (2, "a b c"),
           (100, "中文 текст é"), (101, "<|endoftext|>")]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 40, "block_bytes": 10}])
def test_edge_cases(spark, docs_of, folder, sizes):
    tr.write(docs_of(AWKWARD), folder, PATH, end_id=2, **sizes)
    got = sorted((tuple(r) for r in tr.digest(spark, folder).collect()), key=lambda r: r[1])
    assert got == want(AWKWARD)
    back = {r.id: r.ids for r in tr.read(spark, folder).collect()}
    assert back == {i: whole(t) + [2] for i, t in AWKWARD}
    mixed = [r.id for r in tr.read_shuffled(spark, folder, seed=3).collect()]
    assert sorted(mixed, key=str) == sorted(back, key=str) and mixed != [r[0] for r in got]
    again = tr.read_shuffled(spark, folder, seed=3).collect()
    assert [r.id for r in again] == mixed and {r.id: r.ids for r in again} == back
    assert [r.id for r in tr.read_shuffled(spark, folder, seed=4).collect()] != mixed


def test_repeated_rows_and_ids(spark, docs_of, folder):
    rows = [(1, "same words here")] * 500 + [(None, "same")] * 50 + [(1, "other")]
    tr.write(docs_of(rows), folder, PATH, end_id=2)
    got = sorted((tuple(r) for r in tr.digest(spark, folder).collect()), key=lambda r: r[1])
    assert len(got) == 551 and [r[0] for r in got] == [None] * 50 + [1] * 501
    assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])[:-1])).tolist()


def test_empty_table_and_clashing_columns(spark, docs_of, folder):
    tr.write(docs_of([]), folder, PATH)
    assert tr.digest(spark, folder).collect() == [] and tr.read_shuffled(spark, folder).collect() == []
    odd = spark.createDataFrame([(4, "a b", 1, "x")], "doc_id long, text string, row int, ids string")
    tr.write(odd, folder + "2", PATH)
    assert [tuple(r) for r in tr.read(spark, folder + "2").collect()] == [(4, 0, whole("a b"))]


def test_files_follow_the_frame(spark, docs_of, folder):
    """Read with nothing but the documented layout, by lengths alone and by index."""
    tr.write(docs_of(AWKWARD), folder, PATH, end_id=2)
    found = {}
    for path in sorted(glob.glob(folder[7:] + "/*.rec")):
        data = open(path, "rb").read()
        index = np.fromfile(path + ".idx", np.uint64).tolist()
        at, seen = 0, []
        while at < len(data):
            seen.append(at)
            n, c = struct.unpack_from("<QI", data, at)
            assert c == int(masked(np.array([slow_crc(data[at:at + 8])], np.uint32))[0])
            body = data[at + 12:at + 12 + n]
            if n < 4000:
                crc = struct.unpack_from("<I", data, at + 12 + n)[0]
                assert crc == int(masked(np.array([slow_crc(body)], np.uint32))[0])
            doc, flags, count = struct.unpack_from("<qII", body)
            found[None if flags & 1 else doc] = np.frombuffer(body[16:], "<u2").tolist()
            assert not flags & 2 and len(body) == 16 + 2 * count
            at += 16 + n
        assert seen == index
    assert found == {i: whole(t) + [2] for i, t in AWKWARD}


def test_damage_is_found():
    ids, count = np.array([5, 70_000, 7], np.uint32), np.array([2, 0, 1])
    words, first = tr.frame(np.array([1, 0, 3]), np.array([False, True, False]), ids, count, True)
    data = words.tobytes()
    end = np.append(first[1:], len(words)) * 2
    doc, back, n = tr.unframe(data, first * 2, end)
    assert (doc, back.tolist(), n.tolist()) == ([1, None, 3], ids.tolist(), count.tolist())
    for k in range(len(data)):
        bad = bytearray(data)
        bad[k] ^= 4
        with pytest.raises(tr.CorruptRecord):
            tr.unframe(bytes(bad), first * 2, end)
    with pytest.raises(tr.CorruptRecord):
        tr.unframe(data[:-4], first * 2, end)


def test_files_of_lost_tasks_are_not_read(spark, docs_of, folder):
    tr.write(docs_of([(1, "kept")]), folder, PATH)
    shard = tr._Shard(folder, 0)
    shard.append(*tr.frame(np.array([9]), np.array([False]), np.array([4], np.uint32), np.array([1]), False))
    shard.close()
    assert [r.id for r in tr.read(spark, folder).collect()] == [1]
