"""Operators on tables of copies, long texts and rows that share an id."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerfwork.llm import langid, latticelm, tokenfile


def test_language_sample_of_copies_and_long_texts(spark):
    few = [(f"rare text {i}", "xx") for i in range(3) for _ in range(1000)]
    many = [(f"text number {i}", "en") for i in range(500)]
    docs = spark.createDataFrame(few + many + [("1 " * 50 + "lang " * 100, "yy"), ("12 34", "zz")], "text string, lang string")
    got = langid.sample_labelled(docs, 120, 40)
    assert {t for t, lang in got if lang == "xx"} == {t for t, _ in few}
    assert sum(lang == "en" for _, lang in got) == 120 == len({t for t, lang in got if lang == "en"})
    assert [t for t, lang in got if lang == "yy"] == ["lang " * 8] and "zz" not in {lang for _, lang in got}
    assert langid.fit(docs).labels == ["en", "xx", "yy"]


def test_lm_scores_each_row_alone(spark):
    texts = [(1, "the cat sat"), (1, "the cat sat"), (1, "a dog"), (None, "one"), (None, "two zebras ran"), (2, "the cat sat"), (3, None), (3, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", "text", F.lit(False).alias("held_out"), F.lit(True).alias("learn"))
    rows = latticelm.score(docs, P.path("piece_bpe_32k.model")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted((str(i), len((t or "").split()) + 1) for i, t in texts)
    same = [(r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in rows if r.n_tokens == 4 and r.doc_id]
    assert len(same) == 3 and len(set(same)) == 1


def test_token_files_equal_tokenizer_as_loaded(spark, tmp_path):
    path = P.path("byte_bpe_50k.json")
    fresh, rng = Tokenizer.from_file(path), random.Random(3)
    bits = ["<|endoftext|>", " ", "  ", "\n", "end", "next", "<|endof", "text|>", " a", "é", "\t"]
    texts = {0: "end <|endoftext|> next"} | {i: "".join(rng.choices(bits, k=rng.randrange(1, 30))) for i in range(1, 400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = tokenfile.read(spark, str(tmp_path), tokenfile.write(docs, path, str(tmp_path))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array([*fresh.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), texts[r.doc_id]
