"""Drawings written and read in parts."""

from pyspark.sql import functions as F

from kerfwork.plans import catalogue
from kerfwork.sources import dxf

SF = "/root/testdata/sf0.001"
SEGMENT = "kind string, sx double, sy double, ex double, ey double, cx double, cy double, radius double, ccw boolean"
ROWS = f"d string, ord long, closed boolean, segments array<struct<{SEGMENT}>>"


def line(*ends):
    return ("line", *map(float, ends), None, None, None, None)


def drawings(spark):
    square = [line(0, 0, 9, 0), line(9, 0, 9, 9), line(9, 9, 0, 0)]
    arcs = [("a", i, False, [("arc", float(i), 0.0, float(i), 2.0, float(i), 1.0, 1.0, i % 2 == 0)]) for i in range(40, 0, -1)]
    return spark.createDataFrame([*arcs, ("a", 41, True, square), ("b", 1, True, square), ("b", 2, False, None), ("empty", 1, False, None), (None, 1, True, square)], ROWS)


def joined(parts):
    got = {}
    for r in parts.orderBy("part").collect():
        got.setdefault(r.d, []).append(r.value)
    return {d: None if v == [None] else "".join(v) for d, v in got.items()}


def test_parts_are_the_whole_text_and_read_alike(spark, monkeypatch):
    monkeypatch.setattr(dxf, "PART", 300)
    rows = drawings(spark)
    whole = dxf.documents_of(rows, "d")
    parts = dxf.parts_of(rows, "d")
    assert joined(parts) == {r.d: r.value for r in whole.collect()}
    assert max(len(r.value) for r in parts.where("part <> -1").collect()) < 700
    read = lambda found: sorted(map(repr, found.collect()))
    content = lambda texts, name: texts.select(F.col("d").alias("path"), *name)
    was = dxf.from_files(content(whole, [F.col("value").cast("binary").alias("content")]))
    assert read(dxf.from_parts(content(parts, ["part", "value"]))) == read(was)
    free = F.replace("value", F.lit("$INSUNITS\n70\n4\n"), F.lit("$INSUNITS\n70\n0\n"))
    noted = dxf.from_parts(content(parts, ["part", F.when(F.col("part") == dxf.HEAD, free).otherwise(F.col("value")).alias("value")]))
    assert read(noted) == read(dxf.from_files(content(whole, [free.cast("binary").alias("content")])))


def test_a_drawing_that_does_not_join_up_has_no_part(spark):
    rows = spark.createDataFrame([("x", 1, False, [line(0, 0, 1, 0)]), ("x", 2, False, [line(0, 0, 1, 0), line(5, 5, 6, 6)]), ("y", 1, False, [line(0, 0, 1, 0)])], ROWS)
    parts = dxf.parts_of(rows, "d")
    assert joined(parts) == {r.d: r.value for r in dxf.documents_of(rows, "d").collect()}
    assert [(r.d, r.part, r.error) for r in parts.where("error IS NOT NULL").collect()] == [("x", -1, "a contour is not contiguous")]


def test_rows_and_parts_follow_roles_as_texts_do(spark):
    rows = drawings(spark).where("d IN ('a', 'b')").withColumn("part", F.when(F.col("ord") % 5 > 0, F.col("ord") % 5)).withColumn("role", F.when(F.col("ord") % 2 == 0, "interior").otherwise("exterior"))
    assert joined(dxf.parts_of(rows, "d")) == {r.d: r.value for r in dxf.documents_of(rows, "d").collect()}


def test_queries_never_hold_a_drawing(spark, monkeypatch):
    def whole(*args):
        raise AssertionError("a whole drawing in one row")

    monkeypatch.setattr(dxf, "documents_of", whole)
    monkeypatch.setattr(dxf, "from_files", whole)
    for name in ("dxf_bulges", "scale_coords", "dxf_roundtrip"):
        assert catalogue.queries()[name](spark, SF).count()
