"""Stages of the pipeline against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from kerfwork.llm import bpe, langid, mixing, neardup, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _groups(sets):
    head = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= 0.8 * union:
                a, b = head[i], head[j]
                head = [min(a, b) if h in (a, b) else h for h in head]
    return head


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(20, 300))]
        texts += [_edited(rng, base, rng.randrange(1 + len(base) // 30)) for _ in range(6)]
    texts += ["", None, " ", "one two", "One  two", "one three"]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    rows += [(1000 + r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = [_shingles(t) for _, t, *_ in rows]
    head = _groups(sets)
    assert 40 < len(set(head[:150])) < 140
    want = sorted(min(r[0] for r, g in zip(rows, head, strict=True) if g == h) for h in set(head))
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sorted(r.doc_id for r in got) == want
    assert neardup.linked([neardup.shingle_set(t) for _, t, *_ in rows if t and t.strip()]).tolist() == _groups([s for s in sets if s])


def test_near_dedup_keeps_rows_without_id(spark):
    rows = [(None, "a b c d e f g", "en", "a", 1), (None, "h i j k l m n", "en", "a", 1), (None, "h i j k l m n", "en", "b", 1), (3, "o p q r s t", "en", "a", 1), (3, "u v w x y z", "en", "a", 1)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sorted(r.text[0] for r in got) == ["a", "h", "o", "u"]
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


def test_encode_gives_ids(spark):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {1: "The cat\nsat  é \U0001f600", 2: None, 3: "ab " * 3000}
    got = corpus_pipeline.encode(spark, spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts.items()], SCHEMA), SF).collect()
    assert len(got) == 3
    for r in got:
        want = own.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_simhash_keep_one_is_by_row(spark):
    rows = [(None, "a b c d e f g", "en", "a", 1), (None, "h i j k l m n", "en", "a", 1), (None, "h i j k l m n", "en", "b", 1), (3, "o p q r s t", "en", "a", 1), (3, "u v w x y z", "en", "a", 1), (4, "U v w x y z", "en", "a", 1)]
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in got) == [("3", "o"), ("3", "u"), ("None", "a"), ("None", "h")]


def _language(spark, rows):
    """Rows of one main language, by the labeller of the same model."""
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").select("text", "lang"))
    k, found = len(model.labels), langid.Labeller(model).documents([r[1] for r in rows])
    return [(i, t, lang, s, n) for (i, t, _, s, n), (lang, x) in zip(rows, found, strict=True) if lang != "und" and x * k - 1 >= 0.25 * (k - 1) - 1e-9]


def _spans(rows, langs, per, n):
    """Texts of spans in several languages, with ids that are not learned from."""
    rng, out, ids = random.Random(5), [], [i for i in range(5000, 5900) if zlib.crc32(str(i).encode()) % 5 == 0]
    for i in range(n):
        parts = [rng.choice([t for _, t, lang, *_ in rows if lang == x and len(t.split()) > per]).split() for x in langs]
        out.append((ids[i], " ".join(" ".join(p[-per:]) for p in parts), "en", "a", 1))
    return out


def test_language_rejects_texts_without_main_language(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS).collect()]
    few = [r for r in rows if r[2] in ("en", "de", "fr")]
    few += _spans(few, ("en", "de", "fr"), 40, 10)
    got = [tuple(r) for r in corpus_pipeline.language(spark, spark.createDataFrame(few, SCHEMA), SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, _language(spark, few)))
    kept = {r[0] for r in got}
    assert sum(r[0] in kept for r in few if r[0] >= 5000) <= 3 and sum(r[0] not in kept for r in few if r[0] < 5000) <= 3


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS).collect()]
    rows += _spans(rows, ("en", "de", "fr", "es"), 30, 5) + [(6000, "12 34", "en", "a", 5), (6001, None, None, "a", None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = sorted(_language(spark, rows))
    keys = lambda text: [x.strip(" \t\n\x0b\x0c\r").lower() for x in text.split("\n")]
    seen, within = set(), Counter(k for _, t, *_ in kept for k in set(keys(t)))
    lines = []
    for i, t, lang, source, n in kept:
        out = []
        for line, key in zip(t.split("\n"), keys(t), strict=True):
            if not key or within[key] < 10 or key not in seen:
                out.append(line)
            seen.add(key)
        lines.append((i, "\n".join(out), lang, source, n))
    head = _groups([_shingles(t) for _, t, *_ in lines])
    first = [r for place, r in enumerate(lines) if head[place] == place]  # sorted by id
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, t, s) for i, t, _, s, _ in first])
    copies = {i: taken // size if size else 0 for i, size, _, _, taken in con.sql(mixing.SQL).fetchall()}
    text = {i: t for i, t, *_ in first}
    want = Counter({(i, hashlib.sha256(text[i].encode()).hexdigest()): n for i, n in copies.items() if n})
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == want
