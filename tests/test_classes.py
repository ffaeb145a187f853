"""Copies of boxes and contours: pairs are sought among distinct ones only."""

import itertools
import random

import pytest

from kerfwork.operators import rings, spatial

BOXES = "drawing_id long, id long, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, rows):
    return spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(rows)], BOXES)


@pytest.fixture
def sought(monkeypatch):
    """How many boxes each search for pairs was given."""
    seen = []
    search = spatial.box_pairs_of_any_size

    def counted(rows, grow=0.0):
        seen.append(rows.count())
        return search(rows, grow)

    monkeypatch.setattr(rings, "box_pairs_of_any_size", counted)
    return seen


def test_copies_are_one_box_of_the_search(spark, sought):
    many = boxes(spark, [(0, 0, 4, 4), (2, 2, 6, 6), (50, 50, 51, 51)] * 3000)
    found = {r.id: r.root for r in rings.overlap_clusters(many).collect()}
    assert found == {i: i if i % 3 == 2 else 0 for i in range(9000)}
    assert sought == [3]


def test_every_pair_of_members_is_written_once(spark, sought, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 3)  # several blocks a class
    rng = random.Random(4)
    rows = [(x, y, x + w, y + w) for x, y, w in [(rng.randrange(6), rng.randrange(3), rng.choice((1, 2, 4))) for _ in range(70)]]
    covers = lambda p, q: p[0] <= q[0] and p[1] <= q[1] and p[2] >= q[2] and p[3] >= q[3]
    shared = lambda p, q: max(min(p[2], q[2]) - max(p[0], q[0]), 0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0)
    pairs = list(itertools.combinations(range(70), 2))
    over = {(i, j): shared(rows[i], rows[j]) for i, j in pairs if shared(rows[i], rows[j]) and not covers(rows[i], rows[j]) and not covers(rows[j], rows[i])}
    df = boxes(spark, rows)
    got = [(r.a, r.b, r.shared) for r in rings.overlap_pairs(df).collect()]
    assert sorted(got) == sorted((i, j, float(s)) for (i, j), s in over.items())
    held = [(r.outer, r.inner) for r in rings.contained(df).collect()]
    assert sorted(held) == sorted((p, q) for i, j in pairs for p, q in ((i, j), (j, i)) if covers(rows[p], rows[q]) and rows[p] != rows[q])
    kinds = [(r.a, r.b, r.kind) for r in rings.spacing(df).collect()]
    assert sorted(kinds) == sorted([(i, j, "duplicate") for i, j in pairs if rows[i] == rows[j]] + [(i, j, "overlap") for i, j in over])
    assert set(sought) == {len(set(rows))}


def contours(spark, rows):
    from kerfwork.operators.outlines import SEGMENTS

    def sides(x0, y0, x1, y1):
        ends = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        return [("line", *map(float, a + b), None, None, None, None) for a, b in zip(ends, ends[1:] + ends[:1], strict=True)]

    return spark.createDataFrame([(0, i, False, True, sides(*r)) for i, r in enumerate(rows)], f"drawing_id long, contour_id long, touched boolean, closed boolean, segments {SEGMENTS}")


def test_classes_of_contours_nest_weld_and_are_checked_as_all_pairs_are(spark, monkeypatch):
    from kerfwork.operators import outlined

    monkeypatch.setattr(spatial, "BLOCK", 3)
    judged = []
    search = outlined.box_pairs_of_any_size
    monkeypatch.setattr(outlined, "box_pairs_of_any_size", lambda rows, grow=0.0: judged.append(rows.count()) or search(rows, grow))
    kinds = [(0, 0, 20, 20), (2, 2, 6, 6), (3, 3, 5, 5), (4, 4, 8, 8), (40, 0, 42, 2), (42.1, 0, 44, 2)]
    rows = [kinds[i * 7 % len(kinds)] for i in range(30)] + [kinds[0]] * 5
    given = contours(spark, rows)
    shapes = spatial.cut(outlined.polygons_of(given))
    members, pairs = outlined.class_relations(shapes, 0.15)
    every = spatial.cut(outlined.relations(shapes, 0.15))
    assert judged == [6, 6]
    assert every.count() == every.select("a", "b").distinct().count() and every.where("a >= b").count() == 0
    assert every.where("kind = 'equal'").count() == sum(rows[i] == rows[j] for i, j in itertools.combinations(range(35), 2))
    rows_of = lambda df: sorted(map(tuple, df.collect()), key=str)
    tree = outlined.nested(shapes, pairs, members)
    assert rows_of(tree) == rows_of(outlined.nested(shapes, every))
    parts = shapes.selectExpr("drawing_id", "contour_id", "contour_id AS part", "IF(contour_id % 2 = 0, 'exterior', 'interior') AS role", "string(contour_id) AS handle")
    limits = (0.15, (90, 3000), 2.0)
    found = rows_of(outlined.findings(shapes, parts, pairs, *limits, members))
    assert found == rows_of(outlined.findings(shapes, parts, every, *limits))
    assert sum(r[1] == "PARTS_OVERLAP" for r in found) == every.where("kind = 'overlap'").count() == 50
    made, notes = outlined.weld(given)
    assert made.count() == 35 - 15 + 1 and [r.code for r in notes.collect()] == ["CONTOURS_WELDED"]
    assert outlined.weld(given, "all")[1].where("code = 'HOLES_LOST_IN_WELD_ALL'").count() == 15


def test_large_joins_are_never_broadcast(spark):
    """Even where both sides look small: their tables are built in the driver."""
    from kerfwork.operators import segments

    seg = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, 0.0), (0, 1, 1.0, 0.0, 1.0, 1.0)], "drawing_id long, seg_id long, sx double, sy double, ex double, ey double")
    for made in (segments.chain(seg), segments.snapped(seg)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
