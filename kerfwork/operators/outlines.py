"""Whole contours (a row each, with ``segments`` and ``closed``): simplifying, and
finding arcs again in rings of points. Rows are independent, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerfwork.functions import curves
from kerfwork.ship import ship
from kerfwork.sources.dxf import SEGMENT

NAMES = [n for n, _ in SEGMENT]
SEGMENTS = "array<struct<kind:string,sx:double,sy:double,ex:double,ey:double,cx:double,cy:double,radius:double,ccw:boolean>>"


def _each(rows: DataFrame, keep: list[str], inputs: list[str], work: Callable[..., tuple[list[tuple] | None, bool]]) -> DataFrame:
    """``keep``, segments and flag: ``work`` of each row's ``inputs``."""
    ship(rows.sparkSession)
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"segments {SEGMENTS}", "flag boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [work(*args) for args in zip(*[batch.column(len(keep) + i).to_pylist() for i in range(len(inputs))], strict=True)]
            segments = pa.array([None if s is None else [dict(zip(NAMES, x, strict=True)) for x in s] for s, _ in made], pa.list_(pa.struct(SEGMENT)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], segments, pa.array([f for _, f in made], pa.bool_())], [*keep, "segments", "flag"])

    return rows.select(*keep, *[F.col(c).alias(f"__{i}") for i, c in enumerate(inputs)]).mapInArrow(run, schema)


def simplified(contours: DataFrame, keep: list[str], tolerance: float = 0.01, degrees: float = 0.1, most_percent: float = 0.1, touched: str | None = None) -> DataFrame:
    """``keep``, segments and reverted (the area changed too much, so the contour is as
    it was). Only rows with ``touched`` true are worked on, if it is named. Null
    segments stay null."""

    def work(segments, closed, own=True):
        if segments is None:
            return None, False
        given = [tuple(s[n] for n in NAMES) for s in segments]
        return curves.simplify(given, bool(closed), tolerance, degrees, most_percent) if own else (given, False)

    return _each(contours, keep, ["segments", "closed", *([touched] if touched else [])], work).withColumnRenamed("flag", "reverted")


def with_arcs(rings: DataFrame, keep: list[str], tolerance: float = 0.02) -> DataFrame:
    """``keep`` and segments of closed rings given as ``points`` (an array of x, y
    structs without the closing one). Null points give null."""

    def work(points):
        if points is None:
            return None, False
        return curves.arcs_in_ring(np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2), tolerance), True

    return _each(rings, keep, ["points"], work).drop("flag")
