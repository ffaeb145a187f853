"""DXF drawings: files to contours and back.

Reading: every file is one row of Spark's ``binaryFile`` source, parsed where it is.
Text files hold pairs of lines, a group code and a value. Blocks are exploded through
nested inserts (also arrays of them), unsupported entities are dropped, with a
diagnostic for texts and solids, and coordinates are scaled to millimetres last. An
entity that can't be converted costs a diagnostic, not the file.

Rows of ``read``: path, ord (order in the file), code (null for a contour, else a
diagnostic), message, handle, layer, closed, flattened (made from a spline or an ellipse),
segments. A file that is no DXF text gives one row of code FILE_UNREADABLE; an empty
drawing gives none besides the unit's diagnostic.

Writing: ``documents_of`` makes one text a drawing (grouped by drawing, so one drawing
is held at a time), and ``write`` saves them as files. For drawings of any size
``parts_of`` makes the same text in parts, by many tasks for one drawing, and
``from_parts`` reads them part by part. Written are a header, tables of
the line type and the layer, and the entities. Files read back here; no CAD program has
been tried on them. Binary DXF is not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerfwork.functions import curves
from kerfwork.operators.report import DROPPED, KEPT, UNITS
from kerfwork.operators.spatial import cut, large
from kerfwork.ship import ship

SEGMENT = [("kind", pa.string()), *[(c, pa.float64()) for c in ("sx", "sy", "ex", "ey", "cx", "cy", "radius")], ("ccw", pa.bool_())]
ROW = pa.schema([("path", pa.string()), ("ord", pa.int64()), ("code", pa.string()), ("message", pa.string()), ("handle", pa.string()), ("layer", pa.string()), ("closed", pa.bool_()), ("flattened", pa.bool_()), ("segments", pa.list_(pa.struct(SEGMENT)))])
DDL = "path string, ord long, code string, message string, handle string, layer string, closed boolean, flattened boolean, segments array<struct<kind:string,sx:double,sy:double,ex:double,ey:double,cx:double,cy:double,radius:double,ccw:boolean>>"
DEEPEST = 32
#: Characters above which a part of a text ends, contours looked at together, and rows of
#: a side that is broadcast.
PART, TOGETHER, FEW = 1 << 17, 64, 20_000


class Entity:
    """A type name and its tags in order; children are vertices of a POLYLINE."""

    def __init__(self, kind: str):
        self.kind, self.tags, self.children = kind, [], []

    def first(self, code: int, default=None):
        return next((v for c, v in self.tags if c == code), default)

    def number(self, code: int, default: float | None = None) -> float:
        value = self.first(code, default)
        if value is None:
            raise ValueError(f"{self.kind} lacks group {code}")
        return float(value)

    def all(self, code: int) -> list[float]:
        return [float(v) for c, v in self.tags if c == code]

    def point(self, code: int = 10) -> tuple[float, float]:
        return self.number(code), self.number(code + 10)

    def flag(self, bit: int) -> bool:
        return bool(int(self.first(70, 0)) & bit)


def parse(text: str) -> tuple[int, list[Entity], dict[str, tuple[tuple[float, float], list[Entity]]]]:
    """(unit code, entities, blocks by name: base point and entities)."""
    lines = text.lstrip("\ufeff").rstrip().replace("\r\n", "\n").split("\n")
    tags = [(int(lines[i]), lines[i + 1].strip()) for i in range(0, len(lines) - 1, 2)]
    if not any(tag == (0, "SECTION") for tag in tags):
        raise ValueError("no section")
    unit, section, variable = 0, "", ""
    entities: list[Entity] = []
    blocks: dict[str, tuple[tuple[float, float], list[Entity]]] = {}
    block, into, current = None, entities, None

    def end_block() -> None:
        if block is not None:
            blocks[str(block.first(2, "")).upper()] = ((block.number(10, 0.0), block.number(20, 0.0)), into)

    for code, value in tags:
        if code == 0:
            current = None
            if value in ("SECTION", "ENDSEC"):
                section = ""
            elif section == "BLOCKS" and value == "BLOCK":
                block = current = Entity(value)
                into = []
            elif section == "BLOCKS" and value == "ENDBLK":
                end_block()
                block, into = None, entities
            elif section == "ENTITIES" or (section == "BLOCKS" and block is not None):
                current = Entity(value)
                if value == "VERTEX" and into and into[-1].kind == "POLYLINE":
                    into[-1].children.append(current)
                elif value not in ("SEQEND", "ATTRIB"):
                    into.append(current)
        elif current is not None:
            current.tags.append((code, value))
        elif code == 2 and not section:
            section = value
        elif section == "HEADER":
            if code == 9:
                variable = value
            elif code == 70 and variable == "$INSUNITS":
                unit = int(value)
    return unit, [e for e in entities if not int(e.first(67, 0))], blocks


def outline(e: Entity, tolerance: float, detect_circle: bool) -> tuple[list[tuple], bool, str | None]:
    """(segments, closed, diagnostic) of a kept entity in its own coordinates."""
    if e.kind == "LINE":
        return [curves.line(e.point(10), e.point(11))], False, None
    if e.kind in ("ARC", "CIRCLE"):
        center, radius = e.point(), e.number(40)
        if e.kind == "CIRCLE":
            return curves.circle((center[0] + radius, center[1]), center, radius), True, None
        begin, end = math.radians(e.number(50)), math.radians(e.number(51))
        return [curves.arc(curves.polar(center, radius, begin), curves.polar(center, radius, end), center, radius, True)], False, None
    if e.kind in ("LWPOLYLINE", "POLYLINE"):
        code = None
        if e.kind == "LWPOLYLINE":
            spots = []
            for c, v in e.tags:
                if c == 10:
                    spots.append([float(v), 0.0, 0.0])
                elif c in (20, 42) and spots:
                    spots[-1][1 if c == 20 else 2] = float(v)
        else:
            spots = [[*v.point(), float(v.first(42, 0))] for v in e.children]
            if any(abs(float(v.first(30, 0))) > 1e-9 for v in e.children):
                code = "3D_POLYLINE_PROJECTED"
        closed = e.flag(1)
        follow = spots[1:] + spots[:1] * closed
        made = [curves.bulged(a[:2], b[:2], a[2]) for a, b in zip(spots, follow)] if len(spots) > 1 else []  # noqa: B905
        return made, closed, code
    if e.kind == "ELLIPSE":
        points = curves.ellipse(e.point(10), e.point(11), e.number(40), e.number(41, 0.0), e.number(42, 2 * math.pi), tolerance)
    else:
        degree, control, through = int(e.first(71, 3)), np.column_stack([e.all(10), e.all(20)]), np.column_stack([e.all(11), e.all(21)])
        if len(control):
            points = curves.spline(degree, e.all(40), control, e.all(41), tolerance)
        else:
            points = curves.spline(*curves.interpolated(through, degree, e.flag(1)), [], tolerance)
    return *curves.from_points(points, tolerance, detect_circle), None


def moved(segments: list[tuple], matrix: np.ndarray, tolerance: float) -> list[tuple]:
    """Segments under an affine map (2, 3); arcs that it makes elliptic become lines."""
    def to(x, y):
        return tuple(matrix[:, :2] @ (x, y) + matrix[:, 2])

    u, v = matrix[:, 0], matrix[:, 1]
    scale = math.hypot(*u)
    round_ = abs(u @ v) <= 1e-9 * max(scale * scale, 1e-300) and abs(scale - math.hypot(*v)) <= 1e-9 * max(scale, 1)
    flipped = u[0] * v[1] - u[1] * v[0] < 0
    out = []
    for kind, sx, sy, ex, ey, cx, cy, radius, ccw in segments:
        a, b = to(sx, sy), to(ex, ey)
        if kind == "line":
            out.append(curves.line(a, b))
        elif round_:
            out.append(curves.arc(a, b, to(cx, cy), radius * scale, ccw != flipped))
        else:
            turn = curves.sweep((kind, sx, sy, ex, ey, cx, cy, radius, ccw)) or 2 * math.pi
            begin = math.atan2(sy - cy, sx - cx)
            marks = begin + np.linspace(0, turn if ccw else -turn, 9)
            points = curves.flatten(lambda t: np.column_stack([cx + radius * np.cos(t), cy + radius * np.sin(t)]) @ matrix[:, :2].T + matrix[:, 2], marks, tolerance)  # noqa: B023
            points[0], points[-1] = a, b
            out += [curves.line(p, q) for p, q in zip(points[:-1], points[1:], strict=True)]
    return out


def placements(e: Entity, base: tuple[float, float]) -> list[np.ndarray]:
    """The affine maps of an insert, one for each cell of its array."""
    angle = math.radians(e.number(50, 0.0))
    turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
    linear = turn @ np.diag([e.number(41, 1.0), e.number(42, 1.0)])
    cells = [(c * e.number(44, 0.0), r * e.number(45, 0.0)) for r in range(int(e.first(71, 1)) or 1) for c in range(int(e.first(70, 1)) or 1)]
    return [np.column_stack([linear, np.array(e.point()) + turn @ cell - linear @ base]) for cell in cells]


def contours(text: str, tolerance: float = 0.02, detect_circle: bool = True, assumed: float = 1.0, told: bool = True) -> Iterator[tuple]:
    """(code, message, handle, layer, closed, flattened, segments) of a file's text, in
    order; the diagnostic of its unit only if ``told``."""
    unit, entities, blocks = parse(text)
    scale = UNITS.get(unit, assumed if unit == 0 else 1.0)
    if told and unit not in UNITS:
        message = f"no unit is given; one unit is taken for {scale:g} mm" if unit == 0 else f"unit code {unit} is not supported; one unit is taken for 1 mm"
        yield "ASSUMED_UNIT" if unit == 0 else "UNSUPPORTED_INSUNITS", message, None, None, None, None, None

    def walk(items: list[Entity], matrix: np.ndarray | None, depth: int) -> Iterator[tuple]:
        for e in items:
            handle, layer = e.first(5), e.first(8, "0")
            note = lambda code, why="": (code, f"{e.kind} {handle or 'without handle'}{why}", handle, layer, None, None, None)  # noqa: B023, E731
            if e.kind == "POLYLINE" and (e.flag(16) or e.flag(64)):
                yield note("3D_ENTITY_SKIPPED")
            elif e.kind == "INSERT":
                try:
                    if depth == DEEPEST:
                        raise ValueError("blocks hold each other")
                    base, inside = blocks.get(str(e.first(2, "")).upper(), ((0.0, 0.0), []))
                    maps = placements(e, base)
                except ValueError as error:
                    yield note("ENTITY_CONVERSION_FAILED", f": {error}")
                    continue
                for own in maps:
                    whole = own if matrix is None else np.column_stack([matrix[:, :2] @ own[:, :2], matrix[:, :2] @ own[:, 2] + matrix[:, 2]])
                    yield from walk(inside, whole, depth + 1)
            elif e.kind in DROPPED:
                yield note(DROPPED[e.kind])
            elif e.kind in KEPT:
                try:
                    made, closed, code = outline(e, tolerance, detect_circle)
                    made = made if matrix is None else moved(made, matrix, tolerance)
                except (ValueError, TypeError, IndexError) as error:
                    yield note("ENTITY_CONVERSION_FAILED", f": {error}")
                    continue
                if code:
                    yield note(code)
                if not made:
                    yield note("DEGENERATE_ENTITY_SKIPPED")
                    continue
                scaled = [(s[0], *[None if x is None else x * scale for x in s[1:8]], s[8]) for s in made]
                yield None, None, handle, layer, closed, e.kind in ("SPLINE", "ELLIPSE"), scaled

    yield from walk(entities, None, 0)


def decoded(content: bytes) -> str:
    """A file's text: UTF-8 if it is, else by the code page its header names."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        found = re.search(rb"\$DWGCODEPAGE\s+3\s+ANSI_(\d+)", content[:65536])
        try:
            return content.decode(f"cp{found[1].decode()}" if found else "cp1252", "replace")
        except LookupError:
            return content.decode("utf-8", "replace")


def _record(path: str, found: list[tuple], part: int | None = None) -> pa.RecordBatch:
    """What ``contours`` found as rows; ``part`` is a column more if given."""
    *heads, lists = zip(*found, strict=True)
    ends = np.cumsum([len(x or ()) for x in lists])
    edges = [None if x is None else int(e) - len(x) for x, e in zip(lists, ends, strict=True)] + [int(ends[-1])]
    flat = list(zip(*[s for x in lists for s in x or ()], strict=True)) or [()] * len(SEGMENT)
    structs = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(flat, SEGMENT, strict=True)], fields=list(ROW.field("segments").type.value_type))
    columns = [pa.array(c, f.type) for c, f in zip([[path] * len(found), range(len(found)), *heads], ROW, strict=False)]
    arrays = [*columns, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), structs)]
    names = list(ROW.names)
    if part is not None:
        arrays, names = [pa.array([part] * len(found), pa.int64()), *arrays], ["part", *names]
    return pa.RecordBatch.from_arrays(arrays, names)


def _found(content: bytes, *options, told: bool = True) -> list[tuple]:
    try:
        return list(contours(decoded(content), *options, told=told))
    except (ValueError, IndexError) as error:
        return [("FILE_UNREADABLE", str(error), None, None, None, None, None)]


def from_files(files: DataFrame, tolerance: float = 0.02, detect_circle: bool = True, assumed: float = 1.0) -> DataFrame:
    """Contours and diagnostics of ``files`` (path, content); null content is unreadable."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = _found(content.as_py() or b"", tolerance, detect_circle, assumed)
                if found:
                    yield _record(path, found)

    return files.select("path", "content").mapInArrow(run, DDL)


def _met(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with those of ``few`` that agree in ``on``, nulls too. A side of so many
    parts or drawings that it can't be broadcast is joined by sorting."""
    few = few.withColumnsRenamed({c: f"__{c}" for c in on})
    few = F.broadcast(few) if few.count() <= FEW else large(few)
    same = [rows[c].eqNullSafe(few[f"__{c}"]) for c in on]
    return rows.join(few, same).drop(*[f"__{c}" for c in on])


def from_parts(parts: DataFrame, tolerance: float = 0.02, detect_circle: bool = True, assumed: float = 1.0) -> DataFrame:
    """``from_files`` for texts in parts (path, part, value) as ``parts_of`` makes them,
    so that no task holds a drawing. Each part is read under its drawing's head; where its
    rows stand in the drawing follows from how many the parts before it have."""
    ship(parts.sparkSession)
    heads = cut(parts.where(F.col("part") == HEAD).select("path", F.col("value").alias("head")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, part, value, head in zip(*batch.columns, strict=True):
                part = part.as_py()
                text = (head.as_py() or "") + ((value.as_py() or "") if part != HEAD else "")
                found = _found(text.encode(), tolerance, detect_circle, assumed, told=part == HEAD)
                if found:
                    yield _record(path.as_py(), found, part)

    rows = cut(_met(parts.select("path", "part", "value"), heads, ["path"]).mapInArrow(run, f"part long, {DDL}"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = cut(rows.groupBy("path", "part").agg(F.count("*").alias("n")).select("path", "part", before.alias("begin")))
    placed = _met(rows, begins, ["path", "part"]).withColumn("ord", F.col("ord") + F.col("begin"))
    return placed.select(*ROW.names)


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Every ``*.dxf`` of a folder (not of folders in it), whatever its case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][xX][fF]").load(folder)
    return from_files(files, **options)


def _tags(*pairs) -> list[str]:
    return [str(x) if not isinstance(x, float) else repr(x) for pair in pairs for x in pair]


def entity_text(segments: list[tuple], closed: bool, layer: str) -> list[str]:
    """Lines of a CIRCLE or an LWPOLYLINE with bulges. Raises for segments that don't
    join: vertices would be lost."""
    ring = zip(segments, [*segments[1:], segments[0]] if closed else segments[1:])  # noqa: B905
    if any(math.dist(a[3:5], b[1:3]) > curves.CLOSED for a, b in ring):
        raise ValueError("a contour is not contiguous")
    first = segments[0]
    if closed and len(segments) == 2 and all(s[0] == "arc" for s in segments) and segments[1][5:8] == first[5:8] and segments[1][8] == first[8]:
        return _tags((0, "CIRCLE"), (8, layer), (10, first[5]), (20, first[6]), (30, 0.0), (40, first[7]))
    spots = []
    for s in segments:
        if s[0] == "line":
            spots.append((s[1], s[2], 0.0))
            continue
        turn, sign = curves.sweep(s), 1 if s[8] else -1
        if math.dist(s[1:3], s[3:5]) < 1e-9 or turn > 2 * math.pi - 1e-6:
            # A (nearly) full turn has no bulge: two halves.
            spots += [(s[1], s[2], float(sign)), (2 * s[5] - s[1], 2 * s[6] - s[2], float(sign))]
        else:
            spots.append((s[1], s[2], sign * math.tan(turn / 4)))
    if not closed:
        spots.append((*segments[-1][3:5], 0.0))
    return _tags((0, "LWPOLYLINE"), (100, "AcDbEntity"), (8, layer), (100, "AcDbPolyline"), (90, len(spots)), (70, int(closed))) + [t for x, y, b in spots for t in ("10", repr(x), "20", repr(y), "42", repr(b))]


def corners(segments: list[tuple]) -> list[tuple]:
    """Points whose box is that of a contour."""
    out = []
    for s in segments:
        out += [s[1:3], s[3:5]]
        if s[0] == "arc":
            turn, begin = curves.sweep(s) or 2 * math.pi, math.atan2(s[2] - s[6], s[1] - s[5])
            out += [curves.polar(s[5:7], s[7], q * math.pi / 2) for q in range(4) if ((q * math.pi / 2 - begin) * (1 if s[8] else -1)) % (2 * math.pi) <= turn]
    return out


def head_text(low: tuple | None, high: tuple | None, layer: str = "CUT") -> str:
    """The text before the entities of a drawing with these extents (null: it is empty)."""
    head = [(9, "$ACADVER"), (1, "AC1015"), (9, "$INSUNITS"), (70, 4)]
    for name, corner in (("$EXTMIN", low), ("$EXTMAX", high)):
        if corner:
            x, y = map(float, corner)
            head += [(9, name), (10, x), (20, y), (30, 0.0)]
    tables = [(0, "SECTION"), (2, "TABLES")]
    for table, record, rest in (("LTYPE", "CONTINUOUS", [(3, "Solid line"), (72, 65), (73, 0), (40, 0.0)]), ("LAYER", layer, [(62, 7), (6, "CONTINUOUS")])):
        tables += [(0, "TABLE"), (2, table), (70, 1), (0, table), (100, "AcDbSymbolTableRecord"), (2, record), (70, 0), *rest, (0, "ENDTAB")]
    return "\n".join([*_tags((0, "SECTION"), (2, "HEADER"), *head, (0, "ENDSEC"), *tables, (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES")), ""])


TAIL_TEXT = "\n".join([*_tags((0, "ENDSEC"), (0, "EOF")), ""])
#: The parts of the text before the entities and of that behind them.
HEAD, TAIL = -1, (1 << 63) - 1


def file_text(drawing: list[tuple[list[tuple], bool]], layer: str = "CUT") -> str:
    body: list[str] = []
    spots: list[tuple] = []
    for segments, closed in drawing:
        if segments:
            body += entity_text(segments, closed, layer)
            spots += corners(segments)
    low, high = ([pick(c) for c in zip(*spots, strict=True)] if spots else None for pick in (min, max))
    return head_text(low, high, layer) + "\n".join([*body, ""]) * bool(body) + TAIL_TEXT


def documents_of(drawings: DataFrame, key: str, layer: str = "CUT") -> DataFrame:
    """(key, value, error): one DXF text for each drawing of ``drawings`` (key, ord,
    closed, segments, and role and part if there: then each outline is followed by its
    holes). Contours without segments are left out; findings (null segments) too. A
    drawing with a contour that doesn't join up has no text but an error."""
    ship(drawings.sparkSession)
    kind = drawings.schema[key].dataType.simpleString()
    names = [n for n, _ in SEGMENT]
    order = [c for c in ("part", "role") if c in drawings.columns]

    def one(table: pa.Table) -> pa.Table:
        rows = table.select(["ord", "closed", "segments", *order]).to_pylist()
        if order:
            rows.sort(key=lambda r: (r["part"] is None, r["part"] or 0, r["role"] or "", r["ord"]))  # exterior, then interior
        else:
            rows.sort(key=lambda r: r["ord"])
        parts = [([tuple(s[n] for n in names) for s in r["segments"]], bool(r["closed"])) for r in rows if r["segments"]]
        value = error = None
        try:
            value = file_text(parts, layer)
        except ValueError as wrong:
            error = str(wrong)
        return pa.table({key: table.column(key).slice(0, 1), "value": pa.array([value], pa.string()), "error": pa.array([error], pa.string())})

    return drawings.select(key, "ord", "closed", "segments", *order).groupBy(key).applyInArrow(one, f"`{key}` {kind}, value string, error string")


def _tuples(lists: pa.ListArray) -> Iterator[list[tuple]]:
    """The segments of each contour, none for null."""
    structs = lists.flatten()
    flat = list(zip(*[structs.field(n).to_pylist() for n, _ in SEGMENT], strict=True))
    at = 0
    for n in lists.value_lengths().to_pylist():
        yield flat[at : at + (n or 0)]
        at += n or 0


def parts_of(drawings: DataFrame, key: str, layer: str = "CUT") -> DataFrame:
    """(key, part, value, error): the text of each drawing as ``documents_of`` has it, in
    parts of some contours each, in the order of ``part``; ``HEAD`` is all before them.
    Contours are dealt by ranges of their order, so no task holds a drawing. A drawing
    with a contour that doesn't join up has a head without text, with the error."""
    spark = drawings.sparkSession
    ship(spark)
    kind = drawings.schema[key].dataType.simpleString()
    order = [F.col(key)]
    if {"part", "role"} <= set(drawings.columns):
        order += [F.col("part").isNull(), F.coalesce("part", F.lit(0)), F.coalesce("role", F.lit(""))]
    dealt = drawings.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order, "ord").sortWithinPartitions(*order, "ord")
    schema = f"`{key}` {kind}, part long, value string, error string, x0 double, y0 double, x1 double, y1 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        held = None  # an array of the key alone, whatever its type
        lines, size, box, error = [], 0, None, None

        def made() -> pa.RecordBatch:
            value = "\n".join([*lines, ""]) if lines else ""
            return pa.RecordBatch.from_arrays([held, pa.array([part], pa.int64()), pa.array([value], pa.string()), pa.array([error], pa.string()), *[pa.array([x], pa.float64()) for x in box or [None] * 4]], [key, "part", "value", "error", "x0", "y0", "x1", "y1"])

        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                keys, (known, closes) = batch.column(0), (c.to_pylist() for c in batch.columns[:2])
                for i, (closed, segments) in enumerate(zip(closes, _tuples(batch.column(2)), strict=True)):
                    if held is None or known[i] != now or size > PART:
                        if held is not None:
                            yield made()
                            part += 1
                        held, now = keys.slice(i, 1), known[i]
                        lines, size, box, error = [], 0, None, None
                    if not segments:
                        continue
                    try:
                        more = entity_text(segments, bool(closed), layer)
                    except ValueError as wrong:
                        error = error or str(wrong)
                        continue
                    lines += more
                    size += sum(map(len, more)) + len(more)
                    xs, ys = zip(*corners(segments), strict=True)
                    own = (min(xs), min(ys), max(xs), max(ys))
                    box = own if box is None else (min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3]))
        if held is not None:
            yield made()

    bodies = cut(dealt.select(key, "closed", "segments").mapInArrow(run, schema))
    drawn = bodies.groupBy(key).agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("part"))).alias("error"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)
            texts = [None if error else head_text((x0, y0), (x1, y1), layer) if x0 is not None else head_text(None, None, layer) for error, x0, y0, x1, y1 in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(1)], [key, "value", "error"])

    first = cut(drawn.mapInArrow(heads, f"`{key}` {kind}, value string, error string")).select(key, F.lit(HEAD).cast("long").alias("part"), "value", "error")
    last = first.where("error IS NULL").select(key, F.lit(TAIL).cast("long").alias("part"), F.lit(TAIL_TEXT).alias("value"), "error")
    bodies = bodies.select(key, "part", "value", "error")
    if first.where("error IS NOT NULL").limit(1).count():
        bodies = _met(bodies, first.where("error IS NULL").select(key), [key])
    return first.unionByName(bodies).unionByName(last)


def mounted(uri: str) -> str:
    """The path of a folder that is mounted on every machine."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{uri} must be a mounted folder")
    return parsed.path


def _renamed(spark: SparkSession, parts: str, name_of) -> None:
    """Moves the part files that Spark has committed under ``parts`` to the names that
    ``name_of`` gives for their folder, and drops the rest."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(parts)
    files = top.getFileSystem(conf)
    found = files.listFiles(top, True)
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().startswith("part-"):
            target = jvm.org.apache.hadoop.fs.Path(name_of(unquote(path.getParent().getName())))
            files.delete(target, False)
            if not files.rename(path, target):
                raise OSError(f"{target} could not be written")
    files.delete(top, True)


def write(texts: DataFrame, key: str, folder: str) -> None:
    """One file a drawing in ``folder``, named by ``key``. Spark's commit protocol writes
    them under other names first, so a lost task leaves none half written."""
    parts = f"{folder}/parts-{uuid.uuid4().hex}"
    texts.write.option("compression", "none").option("lineSep", "\n").partitionBy(key).text(parts)
    _renamed(texts.sparkSession, parts, lambda name: f"{folder}/{name.partition('=')[2]}")


def write_one(table: DataFrame, path: str) -> None:
    """``table`` as one CSV file with a header."""
    parts = f"{path}-{uuid.uuid4().hex}"
    table.coalesce(1).write.option("header", True).option("emptyValue", "").csv(parts)
    _renamed(table.sparkSession, parts, lambda _: path)
