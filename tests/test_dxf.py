"""Drawings as text, curves and simplifying, on literal geometry."""

import math

import numpy as np
import pytest

from kerfwork.functions import curves
from kerfwork.operators import outlines
from kerfwork.sources import dxf


def tags(*pairs):
    return "\n".join(f"{c}\n{v}" for c, v in pairs)


def drawing(entities, blocks="", unit=4):
    head = tags((0, "SECTION"), (2, "HEADER"), (9, "$INSUNITS"), (70, unit), (0, "ENDSEC"))
    inner = "\n".join([tags((0, "SECTION"), (2, "BLOCKS")), blocks, tags((0, "ENDSEC"))]) if blocks else ""
    return "\n".join(x for x in [head, inner, tags((0, "SECTION"), (2, "ENTITIES")), entities, tags((0, "ENDSEC"), (0, "EOF"))] if x)


LINE = tags((0, "LINE"), (5, "A"), (8, "L"), (10, 0), (20, 0), (11, 2), (21, 0))
CIRCLE = tags((0, "CIRCLE"), (5, "B"), (10, 1), (20, 0), (40, 1))


def test_units_and_dropped_entities():
    found = list(dxf.contours(drawing("\n".join([LINE, tags((0, "TEXT"), (1, "x")), tags((0, "POINT"), (10, 0), (20, 0))]), unit=1)))
    assert [f[0] for f in found] == [None, "TEXT_SKIPPED"]
    assert found[0][6][0][3] == pytest.approx(50.8)
    assert [f[0] for f in dxf.contours(drawing(LINE, unit=0))] == ["ASSUMED_UNIT", None]
    assert [f[0] for f in dxf.contours(drawing(LINE, unit=3))] == ["UNSUPPORTED_INSUNITS", None]


def test_a_bad_entity_costs_itself_only():
    bad = tags((0, "LINE"), (10, "x"), (20, 0), (11, 1), (21, 1))
    assert [f[0] for f in dxf.contours(drawing("\n".join([bad, LINE])))] == ["ENTITY_CONVERSION_FAILED", None]
    one = tags((0, "LWPOLYLINE"), (70, 0), (10, 1), (20, 1))
    assert [f[0] for f in dxf.contours(drawing(one))] == ["DEGENERATE_ENTITY_SKIPPED"]


def test_nested_blocks_are_placed_turned_and_mirrored():
    inner = "\n".join([tags((0, "BLOCK"), (2, "I"), (10, 1), (20, 0)), LINE, tags((0, "ENDBLK"))])
    outer = "\n".join([tags((0, "BLOCK"), (2, "O"), (10, 0), (20, 0)), tags((0, "INSERT"), (2, "i"), (10, 0), (20, 0), (50, 90)), tags((0, "ENDBLK"))])
    found = list(dxf.contours(drawing(tags((0, "INSERT"), (2, "O"), (10, 10), (20, 0), (41, -1)), "\n".join([inner, outer]))))
    assert np.allclose(found[0][6][0][1:5], (10, -1, 10, 1))
    ring = "\n".join([tags((0, "BLOCK"), (2, "C"), (10, 0), (20, 0)), CIRCLE, tags((0, "ENDBLK"))])
    (mirrored,) = dxf.contours(drawing(tags((0, "INSERT"), (2, "C"), (10, 0), (20, 0), (41, -2), (42, 2)), ring))
    assert mirrored[6][0][5:] == (-2, 0, 2, False)
    (oval,) = dxf.contours(drawing(tags((0, "INSERT"), (2, "C"), (10, 0), (20, 0), (41, 3)), ring))
    assert {s[0] for s in oval[6]} == {"line"} and curves.area(oval[6]) == pytest.approx(3 * math.pi, rel=0.02)
    self_ = "\n".join([tags((0, "BLOCK"), (2, "S"), (10, 0), (20, 0)), tags((0, "INSERT"), (2, "S"), (10, 0), (20, 0)), tags((0, "ENDBLK"))])
    assert [f[0] for f in dxf.contours(drawing(tags((0, "INSERT"), (2, "S"), (10, 0), (20, 0)), self_))] == ["ENTITY_CONVERSION_FAILED"]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.DXF").write_text(drawing("\n".join([LINE, CIRCLE])))
    (tmp_path / "b.dxf").write_text("no drawing")
    (tmp_path / "c.txt").write_text(drawing(LINE))
    got = dxf.read(spark, str(tmp_path))
    assert sorted((r.path[-5:], r.code or r.segments[0].kind) for r in got.collect()) == [("a.DXF", "arc"), ("a.DXF", "line"), ("b.dxf", "FILE_UNREADABLE")]
    texts = dxf.documents_of(got.where("code is null"), "path")
    text = texts.first()["value"]
    assert "CIRCLE" in text and [f[6] for f in dxf.contours(text)] == [f[6] for f in dxf.contours(drawing("\n".join([LINE, CIRCLE])))]
    dxf.write(texts.selectExpr("'a b=%.dxf' AS name", "value"), "name", str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").glob("[!.]*")] == ["a b=%.dxf"]
    assert [r.code for r in dxf.read(spark, str(tmp_path / "out")).collect()] == [None, None]
    assert text.count("LTYPE") == 2 and "TABLES" in text


def test_code_pages_and_splines_through_points():
    named = tags((0, "SECTION"), (2, "HEADER"), (9, "$DWGCODEPAGE"), (3, "ANSI_1252"), (0, "ENDSEC"))
    raw = (named + "\n" + drawing(tags((0, "LINE"), (8, "Größe"), (10, 0), (20, 0), (11, 2), (21, 0)))).encode("cp1252")
    assert [f[3] for f in dxf.contours(dxf.decoded(raw))] == ["Größe"]
    t = np.linspace(0, 1.5 * math.pi, 19)
    spots = [p for a in t for p in ((11, 4 * math.cos(a)), (21, 4 * math.sin(a)))]
    ((code, _, _, _, closed, flattened, segments),) = dxf.contours(drawing(tags((0, "SPLINE"), (70, 0), (71, 3), *spots)))
    assert (code, closed, flattened, [s[0] for s in segments]) == (None, False, True, ["arc"]) and segments[0][7] == pytest.approx(4, rel=1e-3)
    assert [f[0] for f in dxf.contours(drawing(tags((0, "SPLINE"), (70, 0), (71, 3), (11, 1), (21, 1))))] == ["ENTITY_CONVERSION_FAILED"]


def test_written_contours_must_join():
    with pytest.raises(ValueError):
        dxf.file_text([([curves.line((0, 0), (1, 0)), curves.line((2, 0), (3, 0))], False)])
    full = [curves.arc((1, 0), (1, 0), (0, 0), 1, True)]
    (back,) = dxf.contours(dxf.file_text([(full, True)]))
    assert curves.area(back[6]) == pytest.approx(math.pi)


def test_curves_stay_within_tolerance():
    points = curves.ellipse((0, 0), (10, 0), 0.3, 0, 2 * math.pi, 0.02)
    middle = (points[1:] + points[:-1]) / 2
    dense = np.column_stack([10 * np.cos(t := np.linspace(0, 2 * math.pi, 20000)), 3 * np.sin(t)])
    assert max(np.hypot(*(dense - m).T).min() for m in middle) <= 0.02
    # A rational quadratic spline of three quarters is exactly round.
    w = math.sqrt(0.5)
    quarter = curves.spline(2, [0, 0, 0, 1, 1, 1], [(1, 0), (1, 1), (0, 1)], [1, w, 1], 0.001)
    assert np.allclose(np.hypot(*quarter.T), 1)
    (only,), closed = curves.from_points(quarter, 0.01)
    assert only[0] == "arc" and only[8] and not closed and only[7] == pytest.approx(1)
    with pytest.raises(ValueError):
        curves.spline(3, [0, 1], [(0, 0)], [], 0.1)


def test_arcs_are_found_again():
    t = np.linspace(0, math.pi, 33)
    ring = np.vstack([np.column_stack([5 * np.cos(t), 5 * np.sin(t)]), [(-5, -4), (5, -4)]])
    found = curves.arcs_in_ring(ring)
    assert [s[0] for s in found] == ["arc", "line", "line", "line"] and found[0][7] == pytest.approx(5)
    assert all(math.dist(a[3:5], b[1:3]) < 1e-9 for a, b in zip(found, found[1:] + found[:1], strict=True))
    assert curves.arcs_in_ring(np.zeros((0, 2))) == []


def test_simplify(spark):
    wavy = np.array([(0, 0), (1, 0.001), (2, 0), (10, 0), (10, 10), (0, 10)], float)
    ring = [curves.line(a, b) for a, b in zip(wavy, np.roll(wavy, -1, axis=0), strict=True)]
    assert [len(x) if i == 0 else x for i, x in enumerate(curves.simplify(ring, True))] == [4, False]
    # A ring that would collapse is not thinned.
    assert curves.area(curves.simplify(ring, True, tolerance=20)[0]) == pytest.approx(100, rel=1e-3)
    bump = np.array([(0, 0), (5, -0.5), (10, 0), (10, 10), (0, 10)], float)
    ring = [curves.line(a, b) for a, b in zip(bump, np.roll(bump, -1, axis=0), strict=True)]
    assert curves.simplify(ring, True, tolerance=1) == (ring, True)
    mixed = [curves.line((0, 0), (1, 0)), curves.line((1, 0), (2, 0)), curves.arc((2, 0), (0, 0), (1, 0), 1, True)]
    assert [s[0] for s in curves.simplify(mixed, True)[0]] == ["line", "arc"]
    rows = spark.createDataFrame([(1, None, True, True), (2, [], False, True)], f"id long, segments {outlines.SEGMENTS}, closed boolean, t boolean")
    assert {r.id: r.segments for r in outlines.simplified(rows, ["id"], touched="t").collect()} == {1: None, 2: []}
