import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrabrook.llm import chat, mixing, mpeg_audio, url_filter

TEXTS = ["", None, "a", "x" * 576, "ÿé" * 700, "same", "same", "\ufeff\u00ff" * 3, "word " * 60_000]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_audio_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string, key string")
    rows = {r["doc_id"]: r for r in mpeg_audio.media_digest(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert "bad_crc=0;junk=0" in r["feature"]
    assert rows[5]["media_sha256"] == rows[6]["media_sha256"]
    assert mpeg_audio.media_digest(docs.limit(0)).count() == 0


def test_audio_resync_and_crc():
    one = mpeg_audio.write_mpeg(pa.array([b"hello" * 500], pa.large_binary()))[0].as_py()
    clean = mpeg_audio.parse_mpeg(one)
    assert clean["duration_ns"] == len(clean["offsets"]) * 36_000_000 and clean["listed"] == len(clean["offsets"]) == 5
    hurt = mpeg_audio.parse_mpeg(b"\xff\xfb junk" + one)
    assert hurt["payload"] == clean["payload"] and hurt["junk"] > 0
    assert [b - a for a, b in zip(clean["offsets"], hurt["offsets"])] == [len(b"\xff\xfb junk")] * 5
    spoiled = bytearray(one)
    spoiled[clean["offsets"][2] + 4] ^= 1
    assert mpeg_audio.parse_mpeg(bytes(spoiled))["bad"] == 1
    assert mpeg_audio.parse_mpeg(b"")["offsets"] == [] and mpeg_audio.parse_mpeg(b"no audio")["junk"] == 8


def test_audio_with_tag_in_the_text_or_behind(spark):
    texts = ["x" * 505 + "TAG" + "y" * k for k in (0, 1, 68)] + ["z" * 576 + "x" * 505 + "TAG" + "y" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in mpeg_audio.media_digest(docs).collect()}
    for i, t in enumerate(texts):
        payload = t.encode() + b"\xff" * (-len(t) % 576)
        assert (rows[i]["payload_bytes"], rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == (len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert "bad_crc=0;junk=0" in rows[i]["feature"]
    one = mpeg_audio.write_mpeg(pa.array([b"hello" * 500], pa.large_binary()))[0].as_py()
    clean, tag = mpeg_audio.parse_mpeg(one), b"TAG" + b"\xff" * 125
    tagged, cut = mpeg_audio.parse_mpeg(one + tag), mpeg_audio.parse_mpeg(one[:-100] + tag)
    assert (tagged["payload"], tagged["offsets"], tagged["junk"]) == (clean["payload"], clean["offsets"], 0)
    assert (cut["offsets"], cut["junk"]) == (clean["offsets"][:-1], 548)
    assert mpeg_audio.parse_mpeg(b"no audio" + tag)["junk"] == 8


def test_audio_tags_tables_and_layers():
    one = mpeg_audio.write_mpeg(pa.array([b"hello" * 500], pa.large_binary()))[0].as_py()
    got = mpeg_audio.parse_mpeg(one + b"TAG" + b"A title".ljust(30, b"\0") + b"Someone".ljust(30, b" ") + bytes(30) + b"1997" + bytes(31))
    assert got["tags"] == {"TSSE": "terrabrook silent", "title": "A title", "artist": "Someone", "year": "1997"} and got["junk"] == 0
    assert (got["listed"], got["listed_bytes"], len(got["seek"]), got["seek"][0]) == (5, 6 * 648, 100, 0)
    v2 = b"ID3\x02\0\0\0\0\0\x0c" + b"TT2\0\0\x06\x01\xff\xfeh\0i"[:12]
    assert mpeg_audio.parse_tag(v2)[1]["TT2"].startswith("h")
    v3 = b"TIT2\0\0\0\x05\0\0\0abcd" + b"COMM\0\0\0\x02\0\0xy" + b"TPE1\0\0\0\x03\0\0\x03\xc3\xa9" + bytes(9)
    assert mpeg_audio.parse_tag(b"ID3\x03\0\0\0\0\0" + bytes([len(v3)]) + v3) == (10 + len(v3), {"TIT2": "abcd", "TPE1": "é"})
    assert mpeg_audio.parse_tag(b"ID3\x04\0\0\x7f\x7f\x7f\x7fT")[1] == {}
    # MPEG-1 layer III at 128 kbit/s and 44.1 kHz, the first frame with a VBRI table; then one at 48 kHz
    head, other = bytes([0xFF, 0xFB, 0x90, 0xC0]), bytes([0xFF, 0xFB, 0x94, 0xC0])
    vbri = b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (7).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (10).to_bytes(2, "big") + (20).to_bytes(2, "big")
    frames = (head + bytes(32) + vbri).ljust(417, b"\0") + head.ljust(417, b"\0") * 3 + other.ljust(384, b"\0") * 2
    got = mpeg_audio.parse_mpeg(frames)
    assert (got["listed"], got["listed_bytes"], got["seek"]) == (7, 5000, [30, 60])
    assert got["offsets"] == [417, 834, 1251, 1668, 2052] and got["duration_ns"] == (3 * 1152 * 10**9 * 48000 + 2 * 1152 * 10**9 * 44100) // (44100 * 48000)
    # layer I, joint stereo with a bound of 8: 8 x 2 + 24 allocations of 4 bits
    start = bytes([0xFF, 0xFE, 0x10, 0x50])
    allocation = bytes(range(20))
    crc = mpeg_audio.crc16(start[2:] + allocation)
    size = mpeg_audio.parse_header(start, 0)[0]
    good, bad = ((start + c.to_bytes(2, "big") + allocation).ljust(size, b"\x55") for c in (crc, crc ^ 1))
    got = mpeg_audio.parse_mpeg(good + bad + good)
    assert (got["checked"], got["bad"], len(got["offsets"])) == (3, 1, 3)


def test_chat_against_rows(spark):
    control = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b<[\\"), (1, 0, "user", "<<\\\\[["), (1, 2, "assistant", None), (2, 0, None, ""), (None, 0, "user", "é<s>"), (3, 0, "system", control), (3, 0, "assistant", control), (3, 0, "assistant", control), (4, None, "assistant", "n"), (4, 0, "user", "m")]
    rows += [(9, i, ("user", "assistant")[i % 2], "long \\<é " * 3000) for i in range(150)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.chat_digest(chat.format_chats(df)).collect()}
    want = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] or -9, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[r[0]].append((r[2] or "", r[3] or ""))
    assert set(got) == set(want)
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns).encode())
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), sha(loss.encode()))
    assert chat.chat_digest(chat.format_chats(df.limit(0))).count() == 0


def test_chat_escape_is_reversible():
    for n in range(5):
        for s in itertools.product(b"<[\\a", repeat=n):
            raw = bytes(s)
            at = np.array([0, n // 2, n], np.int64)
            ea, ed = chat.escape(at, np.frombuffer(raw, np.uint8))
            for c in (b"<s>", b"</s>", b"[INST]"):
                assert c not in ed.tobytes()
            ua, ud = chat.unescape(ea, ed)
            assert ud.tobytes() == raw and list(ua) == list(at)


def test_fit_lengths_is_exact_where_a_subset_is():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = sorted({int(x) for x in rng.integers(0, 40, rng.integers(1, 6))})
        counts = [int(x) for x in rng.integers(1, 4, len(lengths))]
        sums = {0}
        for L, c in zip(lengths, counts):
            sums = {s + L * k for s in sums for k in range(c + 1)}
        budget = int(rng.integers(0, max(sums) + 3))
        take = mixing.fit_lengths(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        got = int(np.dot(take, lengths))
        assert got <= budget and (not lengths[0] or got >= budget - 40)
    assert int(np.dot(mixing.fit_lengths(range(1, 3000), [40] * 2999, 77_777_777), range(1, 3000))) == 77_777_777


def test_mix(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 90))), [None, "b", "a", "ü", "c"][int(rng.integers(0, 5))], "x") for i in range(900)] + [(1000, None, "b", "x"), (1001, "\u00a0 x\x0by", None, "x"), (1001, "\u00a0 x\x0by", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += words(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(size.values())
    while True:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s], rest = 2.0 * size[s], rest - 2 * size[s]
        free -= over
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()), key=str)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.apply_mix(docs).columns == docs.columns


def test_mix_keeps_rows_without_or_with_a_shared_identifier(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " + "w " * (i % 11), ["a", None, "b"][i % 7 % 3], str(i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    plan = Counter()
    for r in mixing.mix_sources(docs).collect():
        plan[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter()
    for r in mixing.apply_mix(docs).collect():
        assert (r["doc_id"], r["text"], r["source"], r["lang"]) == rows[int(r["lang"])]
        got[r["doc_id"], r["source"], len(r["text"].split())] += 1
    assert got == +plan and sum(n for (d, _, _), n in got.items() if d is None) > 50
    assert max(Counter(r["lang"] for r in mixing.apply_mix(docs).collect()).values()) <= 2


@pytest.mark.parametrize("words", [1 << 17, 0])
def test_urls(spark, monkeypatch, words):
    """With the filter as an array, and dealt by its blocks."""
    monkeypatch.setattr(url_filter, "FILTER_WORDS", words)
    urls = ["http://www.Example.com/en/a?b", "https://x.example.com/en/", "http://net/es/x#y", "notnet://anet/es/", "ftp://a.b.net/fr/", None, "", "no scheme", "http://bad.org/x.html?q", "http://www.bad.org/x/", "http://good.org/x", "http://", "a://b://c/d", "http://bad.org/x.html?q"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
    listed = spark.createDataFrame([("https://m.bad.org/x",), (None,), ("https://m.bad.org/x",)], "url string")
    rows = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules, listed).collect()}
    assert len(rows) == len(urls)
    got = [(rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) for i in range(len(urls))]
    assert got == [("www.example.com", "/en/a", "www.example.com/en/", "allow"), ("x.example.com", "/en/", "example.com/en/", "block"), ("net", "/es/x", "net/es/", "block"), ("anet", "/es/", None, "allow"), ("a.b.net", "/fr/", "net/fr/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("bad.org", "/x.html", None, "block"), ("www.bad.org", "/x/", None, "block"), ("good.org", "/x", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("bad.org", "/x.html", None, "block")]
    assert url_filter.judge_urls(pages, rules, listed.limit(0)).where("rule is null and verdict = 'block'").count() == 0
    long = spark.createDataFrame([(1, "http://x.org/" + "a/" * 500_000), (2, "http://" + "b" * 500_000 + ".org/y"), (3, "http://x.org/" + "a/" * 499_999)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(long, rules, long.where("page_id < 3").select("url")).collect()} == {1: "block", 2: "block", 3: "allow"}
    many = spark.range(20_000).select(F.concat(F.lit("http://h.org/"), "id").alias("url"))
    asked = spark.range(40_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.h.org/"), "id", F.lit("/")).alias("url"))
    assert {r["verdict"]: r["n"] for r in url_filter.judge_urls(asked, rules, many).groupBy("verdict", F.expr("page_id < 20000")).agg(F.count("*").alias("n")).collect()} == {"block": 20_000, "allow": 20_000}
    assert url_filter.judge_urls(pages.limit(0), rules, listed).count() == 0
