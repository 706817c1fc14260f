"""Chat formatting, WARC archives and URL rules against plain Python."""

import base64
import hashlib
import re

from pyspark.sql import functions as F
from llm_fixtures import table  # noqa: F401
from shelfwise.llm import chat, urlrules, warc

NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>", "~0~1~2 <|~| [[INST]", "", None,
         "a < b [x] <s><|end|>", "é\n\n~", "[/INST][INST]</s>" * 50, "x" * 50000]


def chats_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, body int")
    return chat.format_chats(df.withColumn("parts", chat.text_part("text")))


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "system", None, "as\nsistant~", "assistant"]
    rows = [(k % 3, k, roles[k % 6], t, "x", k) for k, t in enumerate(NASTY * 2)]
    rows += [rows[0], (None, None, "user", "null ids", "x", 0), (7, None, "assistant", "first", "x", 0),
             (7, 0, "assistant", "tie b", "x", 0), (7, 0, "assistant", "tie a", "x", 0)]
    chats = chats_of(spark, rows)
    got = {r.conv_id: r for r in chat.digest(chats).collect()}
    spans = {r.conv: r for r in chats.collect()}
    assert set(got) == {0, 1, 2, 7, None}
    for c, r in got.items():
        own = sorted(((-1 if t is None else t, role or "", text or "") for cc, t, role, text, *_ in rows if cc == c))
        all_ = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256(all_.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(spans[c].formatted)
        undo = lambda t: t.replace("~2", "[").replace("~1", "<").replace("~0", "~")
        assert "".join(undo(spans[c].formatted[s.start:s.start + s.chars])
                       for s in spans[c].loss_spans) == loss
        marks = re.findall(r"<\|[a-z]+\|>|</?s>|\[/?INST\]", spans[c].formatted)
        assert marks == ["<|turn|>", "<|end|>"] * len(own)
    assert chats_of(spark, rows[:0]).count() == 0


def test_chat_parts(spark):
    df = spark.sql(f"""select 1L as conv_id, 0L as turn, 'user' as role, from_json(
        '[{{"type":"text","text":"see <s> "}},{{"type":"image","uri":"a.png","width":57,"height":28}},
          {{"type":"audio","uri":"b.wav","seconds":2.0}},{{"type":"document","uri":"c.pdf","pages":3}},
          {{"type":"text"}},{{"type":"image"}}]', 'array<{chat.PART}>') as parts
        union all select 1L, 1L, 'assistant', null""")
    r = chat.format_chats(df).first()
    assert r.formatted == ("<|turn|>user\nsee ~1s> <|image|><|audio|><|document|><|image|><|end|>"
                           "<|turn|>assistant\n<|end|>")
    assert [tuple(a) for a in r.attachments] == [
        (0, "image", "a.png", 3), (0, "audio", "b.wav", 25), (0, "document", "c.pdf", 768), (0, "image", None, 1)]


def test_warc_round_trip(spark, tmp_path):
    record = ("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\n"
              "Content-Length: 3\r\n\r\nabc\r\n\r\n")
    html = {1: "same", 2: "same", 3: None, 4: "", 5: record, 6: "x" + record * 3, 7: "WARC/1.0\r\n",
            8: "é\r\n\r\n" * 2000, 9: "same", 10: record[:-2], 11: record.replace("3", "99999")}
    rows = [(i, f"http://h/{i}\r\nX: y", h, 5, "clash") for i, h in html.items()] + [(9, None, "same", 5, "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int, id string")
    for per_file in (2, 256):
        got = sorted(tuple(r) for r in warc.round_trip(pages.repartition(2), records_per_file=per_file).fillna(
            -1, ["refers_to"]).collect())
        want = []
        for i, _, h, *_ in rows:
            b = (h or "").encode()
            same = max(j for j, x in html.items() if (x or "") == (h or ""))
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                         "response" if i == same else "revisit", -1 if i == same else same))
        assert got == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0
    short = warc.round_trip(pages, min_bytes=5).filter("payload_bytes < 5").select("record_type").distinct()
    assert [r[0] for r in short.collect()] == ["response"]
    folder = str(tmp_path / "w")
    warc.write(pages, folder)
    full = {(r.page_id, r.record_type): bytes(r.payload) for r in warc.read(spark, folder, True).collect()}
    assert full[6, "response"] == html[6].encode() and full[1, "revisit"] == b""


def rule_of(url):
    m = re.match(r"(?s)(?:(?!://).)*://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in urlrules.BASE_RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else (None, None)


def test_base_rules(spark, table):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x", "http://example.net/en", "x://net", "x://net/",
            "x://botnet/", "http://example.com/de/?q=://z", "http://EXAMPLE.com/de", "ftp://ÉX.org/fr/#a",
            "http://a.org?x=/fr/", "a://b://c.net/", "http://h.net/\nen", "http://u" + "v" * 9000 + ".org/fr/"]
    df = spark.createDataFrame([(i, u, "z", 1) for i, u in enumerate(urls)] + [(3, urls[3], "z", 1)],
                               "page_id long, url string, host string, rule int")
    for pages in (df, table("pages", "0.01").select("page_id", "url"), df.filter("page_id < 3"), df.limit(0)):
        given = {r.page_id: r.url for r in pages.collect()}
        got = urlrules.judge(pages).collect()
        assert len(got) == pages.count()
        for r in got:
            host, path, (rule, verdict) = rule_of(given[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_mined_rules(spark):
    """Combinations go with verdicts: x+y blocks, x or y alone does not."""
    rows = ([(["x", "y", "n"], "block")] * 10 + [(["x", "n"], "allow")] * 10 + [(["y", "n"], "allow")] * 10
            + [(["z"], "block")] * 2)
    rules = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.9).collect()
    found = {(tuple(r.antecedent), r.verdict): round(r.confidence, 6) for r in rules}
    assert found == {(("x", "y"), "block"): 1.0}


def test_mined_verdicts_apply(spark):
    urls = ([f"http://spam.a.net/p{i}?utm=1" for i in range(40)] + [f"http://ok.example.net/en/{i}" for i in range(40)]
            + ["http://spam.a.edu/q?utm=2", "http://ok.b.edu/q", "http://new.edu/zz"])
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in urlrules.judge(df).filter(F.col("page_id") >= 80).collect()}
    assert [got[i].verdict for i in (80, 81, 82)] == ["block", "allow", "allow"]
    assert got[80].rule is None and got[80].method_rule
