"""Rows that share an id or have none, columns with clashing names, whole queries against
plain Python over all of the smallest tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kerfwork.llm import bpe, fingerprint, langid, latticelm, linededup, mixing, neardup, ogg, registry, simhash, tokenfile

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, own long, pos int, h1 long, n long, row string, key string, of string, copies long, size long, `__id` long, `__n` long, `__row` long, `__key` long, media string, lines string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.collect())


def _clashing(spark):
    rows = [(3, "same\nown3"), (3, "other\nsame"), (None, "same\nx y"), (None, "z same"), (None, None), (4, ""), (5, "same"), (5, "same")]
    rows += [(i, f"same\nline {i}") for i in range(10, 25)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[7] * 4, "r", "k", "o", *[9] * 6, "m", "l") for i, t in rows], CLASH), rows


def test_line_dedup_by_row(spark):
    frame, rows = _clashing(spark)
    got = linededup.drop_repeated_lines(frame, keep_first=False).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if x != "same")) for i, t in rows)
    assert all(r.n_chars == len(r.text or "") and r["__id"] == 9 and r.lines == "l" for r in got)
    first = linededup.drop_repeated_lines(frame).collect()
    assert sum((r.text or "").split("\n").count("same") for r in first) == 1 and len(first) == len(rows)


def test_every_operator_takes_clashing_columns(spark, tmp_path):
    frame, rows = _clashing(spark)
    n = len(rows)
    model = langid.fit(frame.select("text", "lang"))
    assert langid.predict(frame, model, "doc_id", "key").count() == n
    learn = frame.withColumn("held_out", F.lit(False)).withColumn("learn", F.col("doc_id").isNotNull())
    scored = latticelm.score(learn, P.path("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in scored) == Counter((i, len((t or "").split()) + 1) for i, t in rows)
    assert fingerprint.with_next(frame).count() == n
    assert mixing.mix(frame).columns == frame.columns
    assert {r.row for r in mixing.mix(frame).collect()} == {"r"}
    path = P.path("byte_bpe_50k.json")
    assert tokenfile.read(spark, str(tmp_path), tokenfile.write(frame, path, str(tmp_path))).count() == n
    assert bpe.encode_ids(frame, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ["doc_id", "key"]).count() == n
    assert ogg.with_media(frame, ["doc_id", "key"], "stored").count() == n
    assert simhash.near_duplicates(frame).count() == n
    for one in (simhash.keep_one, neardup.keep_one):
        kept = one(frame.drop("__row"))
        assert {(r.doc_id, r.text) for r in kept.collect()} <= set(rows) and kept.columns == frame.drop("__row").columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), SF).count() == 0, name
        assert stage(spark, frame, SF).count() >= 0, name


def test_mixing_many_sources(spark, monkeypatch):
    """More sources than are broadcast, one of them with most rows."""
    monkeypatch.setattr(mixing, "SMALL", 3)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 9), "big" if i % 3 else f"s{i % 40}") for i in range(3000)] + [(None, "a b", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    some = {(r.doc_id, r.size, r.target, r.copies) for r in mixing.plan(frame).collect()}
    monkeypatch.setattr(mixing, "SMALL", 20_000)
    assert some == {(r.doc_id, r.size, r.target, r.copies) for r in mixing.plan(frame).collect()} and len(some) == len(rows)


def _sketch(text, k=fingerprint.K, size=fingerprint.WORDS):
    words = text.lower().split() if text.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_fingerprint_query(spark, texts):
    got = {r.doc_id: r for r in registry.queries()["op4_fingerprint"](spark, SF).collect()}
    assert len(got) == len(texts)
    for k, (i, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = map(_sketch, (text, edited, following))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for value, x, y in ((r.near_edited, a, b), (r.near_next, a, c)):
            assert abs(value - like(x, y)) <= (1e-12 if len(x | y) <= fingerprint.K else 0.16)
        assert abs(r.shingles - len(a)) <= (1e-12 if len(a) < fingerprint.K else 0.4 * len(a))
        assert abs(r.edited_in_text - (len(a & b) / len(b) if b else 1.0)) <= (1e-12 if len(a | b) < fingerprint.K else 0.3)


def test_fingerprint_ring_with_null_ids(spark):
    frame = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r["__next"].text for r in fingerprint.with_next(frame).collect()} == {None: "a", 1: "b", 2: None, 3: "n"}


@pytest.mark.parametrize("chars", [50, 3000, 10**9])
@pytest.mark.parametrize("cuts", [4, 1 << 14])
def test_fingerprint_buckets_ascend(spark, docs, texts, monkeypatch, chars, cuts):
    monkeypatch.setattr(fingerprint, "CUTS", cuts)
    monkeypatch.setattr(fingerprint, "GROUP", 3)
    monkeypatch.setattr(fingerprint, "BUCKET_CHARS", chars)
    rows = sorted((r.doc_id, r["__bucket"]) for r in fingerprint.bucketed(docs.select("doc_id", "text"), chars)[0].collect())
    assert [b for _, b in rows] == sorted(b for _, b in rows)
    heads = spark.createDataFrame(sorted({b: (b, i) for i, b in reversed(rows)}.values()), "b long, low long")
    after = {r.b: r["__after"] for r in fingerprint.after_each(heads, "b", "low", 5).collect()}
    lows = sorted((r.b, r.low) for r in heads.collect())
    assert [after[b] for b, _ in lows] == [low for _, low in lows[1:]] + [lows[0][1]]


def test_simhash_bits_and_hot_buckets(spark, texts, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 8)
    monkeypatch.setattr("kerfwork.llm.common.HOT_ROWS", 5)
    monkeypatch.setattr(simhash, "hot_limit", lambda rows: 2)
    rows = {r.doc_id: r.fingerprint for r in registry.queries()["op10_simhash"](spark, SF).collect()}
    want = {}
    for i, text in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
        said = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in said]
        want[i] = f"{sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)):016x}"
    assert rows == want
    rng, values = random.Random(9), set()
    while len(values) < 400:
        x = 0x0123456789ABCDEF
        for _ in range(rng.randrange(8)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    found = {r.node: r.root for r in simhash.components(simhash.edges(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    near = {i: [j for j in range(400) if j != i and bin((signed[i] ^ signed[j]) & (1 << 64) - 1).count("1") <= 2] for i in range(400)}
    done = set()
    for i in range(400):
        if i in done:
            continue
        group, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - group
            group |= new
            todo += new
        done |= group
        assert {found.get(signed[j], signed[j]) for j in group} == {min(signed[j] for j in group)}


def test_lm_counts_and_base(spark, texts):
    rows = {r.doc_id: r for r in registry.queries()["op2_latticelm"](spark, SF).collect()}
    words = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split() for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    count = Counter(w for i, ws in words.items() if not held[i] for w in [*ws, None])
    total, distinct = sum(count.values()), len(count)
    for i, ws in words.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws) + 1, sum(count[w] > 0 for w in [*ws, None]), total)
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*ws, None]), rel=1e-9)
    sums = {h: [sum(getattr(rows[i], c) for i in words if held[i] == h) for c in ("base_score", "score", "spelled_score")] for h in (True, False)}
    print("held out, training: base, score, spelled", sums)


def test_lm_adds_up_to_one(spark):
    """Over all strings of two letters up to a length, the lattice nears mass 1."""
    v = latticelm.learned_pieces(latticelm.Vocabulary({"▁": -1.0, "▁a": -2.0, "a": -1.5, "ab": -2.5, "b": -1.2}, -9.0), np.array([3.0, 1, 2, 0, 4, 0.5]))
    assert np.exp(v.scores[:-1]).sum() + 256 * np.exp(v.byte_score) == pytest.approx(1)
    long = "ab" * 25_000
    whole = v.forward([long[:300]])[0]
    latticelm.LONG, kept = 37, latticelm.LONG
    assert v.forward([long[:300], "ab"])[0] == pytest.approx(whole)
    latticelm.LONG = kept


def test_ogg_query_and_columns(spark, texts):
    got = {r.doc_id: r for r in registry.queries()["op9_ogg"](spark, SF).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        raw = text.encode()
        want = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert r.media_sha256 == hashlib.sha256(ogg.write(want)).hexdigest() and "peak=" in r.feature
    good = ogg.write(b"x" * 9000)
    bad = bytes([*good[:200], good[200] ^ 1, *good[201:]])
    frame = spark.createDataFrame([(1, good), (2, bad), (3, None), (4, good[:50]), (5, b""), (1, good)], "id long, `a file` binary")
    rows = [(r.id, r.payload if r.payload is None else bytes(r.payload), r.error is None) for r in ogg.read_media(frame, ["id"], "a file").collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(1, b"x" * 9000, True), (2, None, False), (3, None, True), (4, None, False), (5, b"", True), (1, b"x" * 9000, True)]))


def test_token_file_query(spark, texts):
    from tokenizers import Tokenizer

    fresh, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in registry.queries()["op8_tokenfile"](spark, SF).collect()}
    for i, text in texts:
        ids = np.array([*fresh.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_language_query(spark, texts):
    got = {r.doc_id: r for r in registry.queries()["op1_langid"](spark, SF).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [i for i, _ in texts if got[i].held_out]
    assert held == [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(0 <= got[i].score <= 1 and (got[i].lang_pred == "und") == (not any(map(str.isalpha, t))) for i, t in texts)
    assert np.mean([got[i].lang_pred == lang[i] for i in held if lang[i]]) > 0.95
    model = langid.fit(spark.createDataFrame([("some text here", "en"), ("noch ein text", "de")], "text string, lang string"))
    odd = spark.createDataFrame([(1, "²"), (2, "½ 12"), (3, "²a")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in langid.predict(odd, model, "doc_id").collect()} == {1: True, 2: True, 3: False}
