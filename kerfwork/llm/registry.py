"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kerfwork.llm import bpe, fingerprint, langid, latticelm, linededup, mixing, ogg, simhash, tokenfile, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": langid.op1_langid,
        "op2_latticelm": latticelm.op2_latticelm,
        "op3_linededup": linededup.op3_linededup,
        "op4_fingerprint": fingerprint.op4_fingerprint,
        "op5_mixing": mixing.op5_mixing,
        "op6_urlfilter": urlfilter.op6_urlfilter,
        "op7_bpe": bpe.op7_bpe,
        "op8_tokenfile": tokenfile.op8_tokenfile,
        "op9_ogg": ogg.op9_ogg,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_linededup": linededup.SQL, "op5_mixing": mixing.SQL}
