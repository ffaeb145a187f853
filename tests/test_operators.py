"""Cases with literal geometry."""

from kerfwork.operators import report, rings, segments

COLUMNS = "drawing_id long, seg_id long, sx double, sy double, ex double, ey double"


def seg(spark, *rows):
    return spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(rows)], COLUMNS)


def test_small_gap_is_snapped_into_one_chain(spark):
    moved = segments.snapped(seg(spark, (0, 0, 1, 0), (1.03, 0, 2, 0)))
    assert {(r.seg_id, r.contour_id) for r in segments.chain(moved).collect()} == {(0, 0), (1, 0)}


def test_reportable_gap(spark):
    assert [round(r.gap, 6) for r in segments.open_gaps(seg(spark, (0, 0, 1, 0), (1.5, 0, 2.5, 0))).collect()] == [0.5]
    assert segments.open_gaps(seg(spark, (0, 0, 1, 0), (10, 0, 11, 0))).count() == 0


def test_zero_length(spark):
    assert [r.seg_id for r in segments.zero_length(seg(spark, (5, 5, 5.03, 5))).collect()] == [0]


def test_reversed_duplicate(spark):
    assert [(r.n, r.keep) for r in segments.duplicate_groups(seg(spark, (0, 0, 5, 0), (5, 0, 0, 0))).collect()] == [(2, 0)]


def test_collinear_overlap(spark):
    assert [(r.lo, r.hi) for r in segments.collinear_merge(seg(spark, (0, 5, 6, 5), (4, 5, 10, 5))).collect()] == [(0.0, 10.0)]
    assert segments.collinear_merge(seg(spark, (0, 0, 2, 0), (2, 0, 7, 0))).count() == 0


def test_t_junction(spark):
    rows = segments.chain(seg(spark, (-1, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1))).collect()
    assert len(rows) == 3 and len({r.contour_id for r in rows}) == 2


def test_spacing_and_overlap(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 10.1, 0.0, 20.1, 10.0), (1, 3, 5.0, 5.0, 15.0, 15.0), (1, 4, 0.0, 0.0, 10.0, 10.0)], "drawing_id long, id long, x0 double, y0 double, x1 double, y1 double")
    found = {(r.a, r.b): r.kind for r in rings.spacing(boxes).collect()}
    assert found[1, 2] == "spacing" and found[1, 3] == "overlap" and found[1, 4] == "duplicate"


def test_nesting_20_10_2(spark):
    squares = spark.createDataFrame([(1, 0, 1, 10.0), (1, 0, 2, 5.0), (1, 0, 3, 1.0)], "drawing_id long, cell long, id long, half double")
    assert {r.id: r.hole_ids for r in rings.parts(squares).collect()} == {1: "2", 3: ""}


def test_every_code_has_a_severity():
    assert len(report.SEVERITY) == 32 and set(report.SEVERITY.values()) == {0, 1, 2}
