"""Sharding, mixing, media, language, quality, vectors and shared passages on small fixtures."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.llm import langid, media_gif, mixing, quality, queries, sharding, substring_dedup, vector_dedup
from fathom.llm.common import utf8
from fathom.llm.components import components

MASK = (1 << 64) - 1


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & MASK
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    rng = random.Random(0)
    keys = [rng.getrandbits(64) for _ in range(2000)]
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(np.array(keys, np.uint64), n).tolist() == [plain_jump(k, n) for k in keys]


def test_sharded(docs):
    rows = [(i, "é" * (i % 7)) for i in range(500)] + [(3, "éé"), (3, "ééé"), (None, None), (None, "")]
    got = sharding.sharded(docs(rows)).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key" and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 5} == {(8 + 10, zlib.crc32(("é" * 5).encode()))}
    assert {r["size"] for r in got if r["doc_id"] is None} == {8}
    assert sharding.sharded(docs([])).count() == 0
    with pytest.raises(ValueError, match="shards"):
        sharding.sharded(docs([]), 0)


def test_sharded_hot_and_clashing(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 0.001)  # many more cells than rows
    rows = [(7, f"t{i}") for i in range(300)] + [(None, f"u{i}") for i in range(300)] + [(8, "same")] * 300
    d = docs(rows).withColumns({c: F.lit("clash") for c in ("grown_shard", "place", "cell", "slot", "size")})
    slots = defaultdict(list)
    for r in sharding.sharded(d).collect():
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == 900 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    placed = sharding.with_shards(d.select("doc_id", "shard", "text"), 24)
    assert placed.columns == ["doc_id", "text", "shard", "grown_shard", "place"] and placed.select("shard").distinct().count() <= 3


def test_mixing(docs):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else "rare") for i in range(900)] + [(1, "t1", "en", "hot"), (2000, "x", "en", None), (None, "y", "en", "rare"), (2001, None, "en", "other")]
    got = mixing.mixed_sources(docs(rows), {"hot": 0.2, "rare": 0.8}).collect()
    n = Counter(r[3] for r in rows)
    rate = {s: w * len(rows) / n[s] for s, w in (("hot", 0.2), ("rare", 0.8))}

    def copies(key, lam):
        u = int(hashlib.md5(f"17:{'null' if key is None else key}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-lam)
        total = p
        while u >= total:
            k += 1
            p *= lam / k
            total += p
        return k

    want = Counter()
    for r in rows:
        want[r[0]] += copies(r[0], rate.get(r[3], 1.0))
    assert Counter(r["doc_id"] for r in got) == +want
    assert set(docs(rows).columns) < set(got[0].asDict())
    assert mixing.mixed_sources(docs([]), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError, match="weights"):
        mixing.mixed_sources(docs([]), {})


def test_mixing_stays_in_dataframe_functions_and_keeps_columns(docs):
    d = docs([(1, "t", "en", "hot"), (1, "t", "en", "hot")]).withColumns({"mix_rate": F.lit("clash"), "mix_key": F.lit("clash")})
    out = mixing.mixed_sources(d, {"hot": 1.0}, other=2.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert out.columns == [*d.columns, "mix___rate", "mix___copy", "mix___key"] and all(r["mix_rate"] == "clash" for r in out.collect())


def test_mixing_of_rare_sources(docs):
    """Sources far below their share reach it: rates of 100, in one part, and 1500, in parts."""
    rows = [(i, "t", "en", "common") for i in range(2990)] + [(3000 + i, "t", "en", "few") for i in range(9)] + [(4000, "t", "en", "one")]
    got = mixing.mixed_sources(docs(rows), {"few": 0.3, "one": 0.5}).collect()
    n, rate = Counter(r["source"] for r in got), {r["source"]: r["mix_rate"] for r in got}
    assert rate["few"] == pytest.approx(100) and rate["one"] == pytest.approx(1500)
    for source, mean in (("few", 900), ("one", 1500)):
        assert abs(n[source] - mean) < 5 * mean**0.5
    assert sorted(r["mix_copy"] for r in got if r["source"] == "one") == list(range(1, n["one"] + 1))
    many = mixing.mixed_sources(docs([(1, "t", "en", "x")]), {"y": 1.0}, other=5000.0).collect()
    assert sorted(r["mix_copy"] for r in many) == list(range(1, len(many) + 1)) and abs(len(many) - 5000) < 5 * 5000**0.5


def old_lzw(codes, bits):
    """Code numbers packed as a plain encoder would (widths grow with the table)."""
    out, at, n, size = 0, 0, 0, bits + 1
    free = (1 << bits) + 2
    for c in codes:
        out |= c << at
        at += size
        if c == 1 << bits:
            size, free, n = bits + 1, (1 << bits) + 2, 0
            continue
        free += n > 0
        n += 1
        if free == 1 << size and size < 12:
            size += 1
    return out.to_bytes((at + 7) // 8, "little")


@pytest.mark.parametrize("size", [1, 96, 5000, 9216, 60_000])
def test_lzw_round_trip(size):
    rng = random.Random(size)
    for data in (bytes(rng.randrange(256) for _ in range(size)), b"ab" * (size // 2 + 1), bytes([7]) * size):
        assert media_gif.lzw_decode(media_gif.lzw_encode(data), 8, len(data)) == data


def test_lzw_small_codes():
    # two-bit pixels 1 1 1 1 1 1 0: clear, 1, then entries as they appear
    assert media_gif.lzw_decode(old_lzw([4, 1, 6, 7, 0, 5], 2), 2, 7) == bytes([1, 1, 1, 1, 1, 1, 0])
    with pytest.raises(ValueError, match="unknown"):
        media_gif.lzw_decode(old_lzw([4, 1, 7, 5], 2), 2, 9)
    with pytest.raises(ValueError, match="short"):
        media_gif.lzw_decode(old_lzw([4, 1, 5], 2), 2, 9)


def plain_lzw(pixels, full=None):
    """The codes of a plain encoder; a full table is cleared, or kept until the end if `full` says so."""
    codes, table, last = [256], {bytes([i]): i for i in range(256)}, b""
    free = 258
    for b in pixels:
        if last + bytes([b]) in table:
            last += bytes([b])
            continue
        codes.append(table[last])
        if free < 4096:
            table[last + bytes([b])] = free
            free += 1
        elif full != "kept":
            codes.append(256)
            table, free = {bytes([i]): i for i in range(256)}, 258
        last = bytes([b])
    return [*codes, table[last], 257]


def lzw_samples():
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoin shrdlu\u00e9", k=rng.randint(1, 7))) for _ in range(400)]
    text = " ".join(rng.choices(words, k=30_000)).encode()
    return [text[:9216], text, bytes(rng.randrange(256) for _ in range(20_000)), b"\xff" * 9216, bytes(9217), b"ab" * 50_000, b"\0", b"x" * 200_000 + text]


def test_lzw_streams_are_those_of_a_plain_encoder():
    for pixels in lzw_samples():
        stream = media_gif.lzw_encode(pixels)
        assert stream == old_lzw(plain_lzw(pixels), 8)
        for n in {len(pixels), len(pixels) // 2 + 1, 1}:
            assert media_gif.lzw_decode(stream, 8, n) == pixels[:n]
        assert media_gif.lzw_decode(old_lzw(plain_lzw(pixels, "kept"), 8), 8, len(pixels)) == pixels
        with pytest.raises(ValueError, match="short"):
            media_gif.lzw_decode(stream, 8, len(pixels) + 1)
    with pytest.raises(ValueError, match="unknown"):
        media_gif.lzw_decode(old_lzw([256, 1, 258, 400, 257], 8), 8, 9)
    with pytest.raises(TypeError):
        media_gif.lzw_encode([*b"abcabcabc", None])
    assert media_gif.lzw_encode(b"abcabcabc") == old_lzw(plain_lzw(b"abcabcabc"), 8)  # a broken call leaves no entries


def test_media_makes_few_calls_a_pixel():
    """Calls of built-in functions stand for CPU time: one an entry, none a pixel or a code read (2.7 a pixel before)."""
    payload = media_gif.padded(lzw_samples()[0].decode(errors="ignore"))[0]
    media_gif.encode(payload)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "c_call"

    sys.setprofile(count)
    try:
        media_gif.payload_of(media_gif.decode(media_gif.encode(payload)))
    finally:
        sys.setprofile(None)
    assert calls < 0.6 * len(payload), calls / len(payload)


def block(pixels, left, top, w, h, disposal, transparent=None, interlaced=False, palette=None):
    control = bytes([0x21, 0xF9, 4, disposal << 2 | (transparent is not None), 5, 0, transparent or 0, 0])
    flags = (0x40 if interlaced else 0) | (0x81 if palette else 0)
    head = b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (left, top, w, h)) + bytes([flags]) + bytes(palette or [])
    stream = old_lzw([4, *pixels, 5], 2) if len(pixels) < 3 else old_lzw([x for p in pixels for x in (4, p)] + [5], 2)
    return control + head + b"\x02" + bytes([len(stream)]) + stream + b"\0"


def test_gif_rules():
    shared = [0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]
    local = [9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6]
    data = b"GIF89a" + (2).to_bytes(2, "little") * 2 + b"\x81\0\0" + bytes(shared) + b"\x21\xfe\x02hi\0"
    data += block([1, 1, 1, 1], 0, 0, 2, 2, 1) + block([2, 0], 0, 0, 2, 1, 3, transparent=0) + block([3], 1, 1, 1, 1, 2) + block([0, 1], 0, 0, 1, 2, 0, palette=local) + b"\x3b"
    gif = media_gif.decode(data)
    shown = [(c.copy(), d.copy()) for c, d in media_gif.composed(gif)]
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    assert shown[0][0].tolist() == [[red, red], [red, red]]
    assert shown[1][0].tolist() == [[green, red], [red, red]]  # transparent pixel keeps what is below
    assert shown[2][0].tolist() == [[red, red], [red, blue]]  # the frame before is undone
    assert shown[3][0].tolist() == [[[9] * 3, red], [[8] * 3, [0] * 3]] and not shown[3][1][1, 1]  # cleared to background
    assert [f.delay_cs for f in gif.frames] == [5] * 4
    rows = b"GIF87a" + (1).to_bytes(2, "little") + (4).to_bytes(2, "little") + b"\x81\0\0" + bytes(shared) + block([0, 1, 2, 3], 0, 0, 1, 4, 0, interlaced=True)[8:] + b"\x3b"
    assert media_gif.decode(rows).frames[0].indices.ravel().tolist() == [0, 2, 1, 3]
    for bad in (b"", b"PNG", data[:40], data[:-1]):
        with pytest.raises(ValueError):
            media_gif.decode(bad)


def test_media(spark, docs):
    texts = ["", None, "é" * 288, "x" * 100_000, "hello"]
    rows = {r["doc_id"]: r for r in media_gif.media_digests(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (rows[i]["n_bytes"], rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    files = media_gif.media(docs(list(enumerate(texts))))
    assert {r["doc_id"]: hashlib.sha256(r["media"]).hexdigest() for r in files.collect()} == {i: r["media_sha256"] for i, r in rows.items()}
    frames = media_gif.timed_frames(files).where("doc_id = 3").orderBy("frame").collect()
    assert [f["at_ms"] for f in frames] == [100 * i for i in range(len(frames))] and sum(sum(f["histogram"]) for f in frames) == rows[3]["payload_bytes"]
    assert media_gif.media_digests(docs([])).count() == 0


def plain_gif(data):
    """A second decoder, bit by bit, of files with one global palette: [(left, top, width, height, delay, [indices])], palette."""
    palette = [tuple(data[13 + 3 * i : 16 + 3 * i]) for i in range(2 << (data[10] & 7))]
    at, frames, delay = 13 + 3 * len(palette), [], 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            delay = data[at + 4] | data[at + 5] << 8 if data[at + 1] == 0xF9 else delay
            at, box = at + 2, None
        else:
            box = [data[at + k] | data[at + k + 1] << 8 for k in (1, 3, 5, 7)]
            least, at = data[at + 10], at + 11
        body = b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        if box is None:
            continue
        whole, bit, size, table, out, old = int.from_bytes(body, "little"), 0, least + 1, {}, [], None
        while True:
            code = whole >> bit & ((1 << size) - 1)
            bit += size
            if code == 1 << least:
                size, table, old = least + 1, {i: [i] for i in range(1 << least)}, None
                free = (1 << least) + 2
                continue
            if code == (1 << least) + 1:
                break
            entry = table[code] if code in table else old + old[:1]
            out += entry
            if old is not None and free < 4096:
                table[free] = old + entry[:1]
                free += 1
                size = min(12, size + (free == 1 << size))
            old = entry
        frames.append((*box, delay, out))
    return frames, palette


def test_files_by_a_second_decoder():
    rng = random.Random(14)
    for payload in (bytes(rng.randrange(256) for _ in range(576)), b"abcab" * 20_000 + bytes(288 * 2 - 100_000 % 576), b"\xff" * 576):
        payload += b"\xff" * (-len(payload) % 576)
        frames, palette = plain_gif(media_gif.encode(payload))
        assert b"".join(bytes(palette[i][0] for i in f[5]) for f in frames) == payload
        assert all(f[2] == 96 and f[4] == 10 and len(f[5]) == f[2] * f[3] for f in frames)


def test_broken_files_give_a_row_each(spark):
    good = media_gif.encode(b"\0" * 576)
    huge = b"GIF89a" + b"\xff" * 4 + good[10:]
    wide = good.replace(b"\0\x08", b"\0\xc8", 1)
    files = spark.createDataFrame([(1, good), (2, huge), (3, wide), (4, b"GIF89a"), (5, good[:400]), (6, None), (1, good), (None, good)], "doc_id long, media binary")
    got = media_gif.timed_frames(files).collect()
    assert sorted((r["doc_id"] or 0, r["error"] is not None) for r in got) == [(0, False), (1, False), (1, False), (2, True), (3, True), (4, True), (5, True)]


def test_colour_histogram():
    canvas = np.array([[[0, 0, 0], [255, 0, 0]], [[0, 255, 0], [0, 0, 255]]], np.uint8)
    all_, some = np.ones((2, 2), bool), np.array([[True, False], [False, True]])
    assert np.flatnonzero(media_gif.histogram(canvas, all_)).tolist() == [0, 3, 12, 48]
    assert np.flatnonzero(media_gif.histogram(canvas, some)).tolist() == [0, 3] and len(media_gif.histogram(canvas, some)) == 64


def test_automaton_phrases():
    rng = random.Random(5)
    text = "".join(rng.choices("abc", k=300))
    a = langid.Automaton(text)
    moves = dict(zip(a.keys.tolist(), a.to.tolist(), strict=True))

    def plain(s):
        n = 0
        while s:
            k = next((k for k in range(len(s), 0, -1) if s[:k] in text), 1)
            n, s = n + 1, s[k:]
        return n

    for _ in range(200):
        s = "".join(rng.choices("abcd", k=rng.randint(0, 30)))
        assert langid.phrases(moves, s) == plain(s)


def test_cross_parse_of_whole_texts(monkeypatch):
    """Phrases across words, of all languages at once, in lockstep and alone, are those of a plain parse."""
    rng = random.Random(6)
    samples = ["".join(rng.choices("ab c", k=400)), "".join(rng.choices("bcd ", k=300)), "zé "]
    made = [langid.Automaton(t) for t in samples]
    parser = langid.Parser([(a.keys, a.to) for a in made])

    def plain(s, text):
        n = 0
        while s:
            k = next((k for k in range(len(s), 0, -1) if s[:k] in text), 1)
            n, s = n + 1, s[k:]
        return n

    texts = ["".join(rng.choices("abcd zéx", k=rng.randint(1, 60))) for _ in range(60)] + ["ab c" * 100, "q", " "]
    want = [[plain(s, t) for t in samples] for s in texts]
    for few in (0, 24, 1000):
        monkeypatch.setattr(langid, "ALONE", few)
        assert parser.counts(texts).tolist() == want


def test_language_result_against_brute_force(spark, docs):
    """The whole result: whole rows learned, counts, costs, ties and scores."""
    rng = random.Random(12)
    words = {"aa": "the and of with that this from".split(), "bb": "der und die nicht auch eine das".split(), "cc": "le la et les des une dans".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(1, 30))) + rng.choice(["", " 12!", " Ωx"]), lang) for i in range(90) for lang in [["aa", "bb", "cc"][i % 3]]]
    rows += [(300, "THE and\tder", None), (301, "xyz", "aa"), (302, "the " * 3000, "bb"), (None, "une", "cc"), (5, rows[5][1], rows[5][2])]
    held = langid.remainder(F.col("doc_id"), 3) == 1
    d = docs(rows)
    learned = langid.learn(d, held)
    part = lambda i: zlib.crc32(str(i).encode()) % 3 if i is not None else 0
    for lang, n, _, _ in learned:
        mine = {t for i, t, x in rows if x == lang and part(i) != 1}
        assert n == sum(len(langid.letters_of(t)) for t in mine)
    whole = {lang: a for lang, _, *a in learned}
    moves = {lang: dict(zip(k.tolist(), t.tolist(), strict=True)) for lang, (k, t) in whole.items()}
    cost = {lang: math.log2(n) for lang, n, _, _ in learned}
    got = langid.predict(d, learned, held).collect()
    assert len(got) == len(rows)
    text_of = {i: t for i, t, _ in rows}
    for r in got:
        n = {lang: langid.phrases(m, langid.letters_of(text_of[r["doc_id"]])) * cost[lang] for lang, m in moves.items()}
        best = min(n, key=lambda x: (n[x], x))
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum((n[best] / v) ** 12 for v in n.values()))


def test_language(spark, docs):
    rng = random.Random(1)
    words = {"aa": "the and of with that this from".split(), "bb": "der und die nicht auch eine das".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=20)), lang) for i in range(120) for lang in [["aa", "bb"][i % 2]]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !? _", "aa"), (903, "the and", None)]
    d = docs(rows)
    held = langid.remainder(F.col("doc_id"), 3) == 1
    got = {r["doc_id"]: r for r in langid.predict(d, langid.learn(d, held), held).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and got[903]["lang_pred"] == "aa"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1 for i in got)
    empty = docs([])
    assert langid.predict(empty, langid.learn(empty, held), held).count() == 0


def test_quality(spark, docs):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choices("plain words make calm text here".split(), k=40))
    bad = lambda: rng.choice([" ".join(w + "$$$" for w in good().split()), good().upper() + "!!", "spam " * 40])
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)] + [(900, None), (901, ""), (902, "ok")]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(5000, None, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    d = docs(rows).withColumn("score", F.lit("clash"))
    model = quality.train(d, labels, quality.remainder(F.col("doc_id"), 5) == 0)
    got = {r["doc_id"]: r["score"] for r in quality.scored(d.select("doc_id", "text"), model).collect()}
    right = [(got[i] >= quality.CUT) == (i % 4 != 0) for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) / len(right) > 0.97 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    nothing = quality.train(docs([]), labels.limit(0), quality.remainder(F.col("doc_id"), 5) == 0)
    assert [r["score"] for r in quality.scored(docs([(1, "x")]), nothing).collect()] == [0.5]


def test_quality_scores_are_means():
    """A text's score is the softmax of the mean over its features, however it is blocked."""
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.3)
    texts = ["a bb ccc", "", "éé é", "x " * 50, "a\nb"]
    data, offsets = utf8(pa.array(texts))
    whole = model.scores(data, offsets)
    for i, t in enumerate(texts):
        d, o = utf8(pa.array([t]))
        ids = np.concatenate([at for _, at in quality.features(d, o)]) if t else np.zeros(0, int)
        want = 1 / (1 + math.exp(-((model.logit[ids].astype(float).mean() if len(ids) else 0) + 0.3)))
        assert whole[i] == pytest.approx(want)


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    head = {}

    def root(x):
        head.setdefault(x, x)
        while head[x] != x:
            x = head[x]
        return x

    for a, b in pairs:
        p, q = root(a), root(b)
        head[max(p, q)] = min(p, q)
    want = {x: root(x) for x in {v for p in pairs if p[0] != p[1] for v in p}}
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["comp"] for r in got.collect()} == want


def vectors(seed, n=300, dims=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for i in range(0, n // 3):
        x[i] = x[i % 20 + n // 3] + rng.normal(size=dims) * 0.12
    return x


def test_vectors(spark):
    x = vectors(1)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))] + [(900, rows_ := [float(v) for v in x[0]], 1), (901, None, 1), (902, [0.0] * 12, 1), (903, [float("nan")] + [1.0] * 11, 1), (904, [None] + [1.0] * 11, 1), (905, [2 * v for v in rows_], 1), (None, rows_, 1), (906, [], 1), (907, [float("inf")] + [1.0] * 11, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicate_vectors(d).collect()}
    ids = [*range(len(x)), 900, 905]
    y = np.array([x[i] if i < 900 else x[0] for i in ids])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.9) & ~np.eye(len(y), dtype=bool)
    for k, i in enumerate(ids):
        assert got[i]["n_links"] == near[k].sum()
    comp = np.array(ids)
    for _ in ids:
        comp = np.minimum(comp, np.where(near, comp, 10**6).min(1))
    assert [got[i]["component_id"] for i in ids] == comp.tolist()
    for i in (901, 902, 903, 904, 906, 907, None):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert vector_dedup.near_duplicate_vectors(d.limit(0)).count() == 0


def brute_passages(rows, length=substring_dedup.LENGTH):
    seen, words = defaultdict(set), {}
    for i, t in rows:
        w = (t or "").lower().split()
        words[i] = w
        for k in range(len(w) - length + 1):
            seen[tuple(w[k : k + length])].add(i)
    out = {}
    for i, w in words.items():
        cover = set()
        for k in range(len(w) - length + 1):
            if len(seen[tuple(w[k : k + length])]) > 1:
                cover |= set(range(k, k + length))
        if cover:
            out[i] = cover
    return out


def test_passages(docs):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 200)]
    rows = []
    for i in range(120):
        parts = [[word() for _ in range(rng.randrange(0, 60))]]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), [word() for _ in range(rng.randrange(1, 60))]]
        rows.append((i, " ".join(sum(parts, []))))
    rows += [(500, None), (501, ""), (502, "same " * 400), (503, "same " * 30), (504, rows[0][1].upper()), (505, "tick tock " * 100)]
    got = defaultdict(set)
    for r in substring_dedup.passages(docs(rows)).collect():
        span = set(range(r["start_word"], r["end_word"]))
        assert not span & got[r["doc_id"]]
        got[r["doc_id"]] |= span
    assert dict(got) == brute_passages(rows)
    assert substring_dedup.passages(docs([])).count() == 0


def test_passages_among_other_sharers(docs):
    """Documents that share a key with more words ahead or more behind do not hide the ones that share a passage."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    stock = [word() for _ in range(120)]
    rows = []
    for i in range(150):
        a = rng.randrange(0, 80)
        rows.append((i, " ".join([word() for _ in range(40)] + stock[a : a + rng.randrange(26, 75)] + [word() for _ in range(40)])))
    got = defaultdict(set)
    for r in substring_dedup.passages(docs(rows)).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert dict(got) == brute_passages(rows)


def test_passages_over_cut_keys(spark, docs):
    """Ranges that end inside a key's suffixes, and inside its copies, lose no passage."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    stock = [word() for _ in range(160)]
    rows = []
    for i in range(240):
        a = rng.randrange(0, 110)
        rows.append((i, " ".join([word() for _ in range(rng.randrange(40))] + stock[a : a + rng.randrange(26, 75)] + [word() for _ in range(rng.randrange(40))])))
    rows += [(1000 + i, " ".join(stock[:90])) for i in range(60)] + [(2000, " ".join(stock[10:60] * 30)), (2001, " ".join(stock[10:60] * 2))]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "61"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = substring_dedup.passages(docs(rows)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = defaultdict(set)
    for r in found:
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert dict(got) == brute_passages(rows)


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] or len({n.split("_")[0] for n in names}) == 10
    assert set(queries.oracle_sql()) <= set(names)


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    from fathom.llm import common

    texts = ["one two  three", "", "é" * 50 + " x", "word " * 300, "long" * 100]
    data, offsets = utf8(pa.array(texts))
    first, end, row = common.word_spans(data, offsets)
    whole = common.span_hashes(data[: offsets[-1]], first, end)
    for size in (1, 7, 64):
        monkeypatch.setattr(common, "BLOCK_BYTES", size)
        assert (common.span_hashes(data[: offsets[-1]], first, end) == whole).all()
    words = [t.split() for t in texts]
    assert [sum(row == i) for i in range(len(texts))] == list(map(len, words))
    same = {}
    for h, w in zip(whole.tolist(), sum(words, []), strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


def test_intermediate_tables_are_forgotten(spark):
    from fathom.llm import common

    common.forget(spark)
    kept = common.stored(spark.range(3).toDF("a"))
    assert kept.count() == 3 and common.forget(spark) == 1 and common.forget(spark) == 0
