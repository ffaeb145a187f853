"""Snap, dedupe and merge over segments (drawing_id, seg_id, sx, sy, ex, ey)."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerfwork.functions.geometry import dist, rounded, segment_key
from kerfwork.operators.spatial import components, large, near_pairs
from kerfwork.ship import ship

SNAP, GAP = 0.05, 2.0


def endpoints(seg: DataFrame) -> DataFrame:
    """(drawing_id, pt, x, y): pt = 2 * seg_id for the start, one more for the end."""
    ends = F.array(F.struct((F.col("seg_id") * 2).alias("pt"), F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct((F.col("seg_id") * 2 + 1).alias("pt"), F.col("ex").alias("x"), F.col("ey").alias("y")))
    return seg.select("drawing_id", F.inline(ends))


def snap_pairs(seg: DataFrame, tolerance: float = SNAP) -> DataFrame:
    return near_pairs(endpoints(seg), tolerance)


def snap_clusters(seg: DataFrame, tolerance: float = SNAP) -> DataFrame:
    """Transitive clusters of endpoints. Coinciding ends are one node of the search,
    so a junction of many ends is not written as pairs."""
    ends = endpoints(seg)
    spots = ends.groupBy("drawing_id", "x", "y").agg(F.min("pt").alias("pt"))
    found = components(spots, near_pairs(spots, tolerance))
    rooted = spots.join(large(found), ["drawing_id", "pt"]).select("drawing_id", "x", "y", "root")
    return ends.join(large(rooted), ["drawing_id", "x", "y"]).select("drawing_id", "pt", "x", "y", "root")


def snap_centroids(seg: DataFrame, tolerance: float = SNAP) -> DataFrame:
    """Mean of all ends of a cluster; ends that coincide count as often as they occur."""
    return snap_clusters(seg, tolerance).groupBy("drawing_id", "root").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("members"))


def snapped(seg: DataFrame, tolerance: float = SNAP) -> DataFrame:
    """Segments with their ends moved to the centroids, and the ends' clusters."""
    ends = snap_clusters(seg, tolerance)
    center = ends.groupBy("drawing_id", "root").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    moved = ends.join(large(center), ["drawing_id", "root"]).withColumn("seg_id", F.floor(F.col("pt") / 2)).withColumn("is_end", F.col("pt") % 2 == 1)
    pick = lambda c, end: F.max(F.when(F.col("is_end") == end, F.col(c)))
    return moved.groupBy("drawing_id", "seg_id").agg(
        pick("cx", False).alias("sx"), pick("cy", False).alias("sy"), pick("cx", True).alias("ex"), pick("cy", True).alias("ey"),
        pick("root", False).alias("s_node"), pick("root", True).alias("e_node"),
    )


def zero_length(seg: DataFrame, tolerance: float = SNAP) -> DataFrame:
    """Segments whose two ends fall in one cluster."""
    return snapped(seg, tolerance).where(F.col("s_node") == F.col("e_node")).select("drawing_id", "seg_id")


def junctions(seg: DataFrame) -> DataFrame:
    """Points where over two segments meet."""
    return endpoints(seg).groupBy("drawing_id", "x", "y").agg(F.count("*").alias("degree")).where("degree > 2")


def free_ends(seg: DataFrame) -> DataFrame:
    """Endpoints that no other segment shares."""
    return endpoints(seg).groupBy("drawing_id", "x", "y").agg(F.count("*").alias("n"), F.min("pt").alias("pt")).where("n = 1").select("drawing_id", "pt", "x", "y")


def open_gaps(seg: DataFrame, tolerance: float = SNAP, most: float = GAP) -> DataFrame:
    """Nearest reportable gap between free ends of two segments."""
    pairs = near_pairs(free_ends(seg), most).where(F.col("d") > tolerance)
    i, j = F.floor(F.col("a") / 2), F.floor(F.col("b") / 2)
    return pairs.select("drawing_id", i.alias("i"), j.alias("j"), "d").where("i <> j").groupBy("drawing_id", "i", "j").agg(F.min("d").alias("gap"))


def keyed(seg: DataFrame) -> DataFrame:
    return seg.withColumn("key", segment_key(*map(F.col, ("sx", "sy", "ex", "ey"))))


def duplicate_groups(seg: DataFrame) -> DataFrame:
    """Groups of segments that are equal in either direction, with the survivor."""
    per = keyed(seg).groupBy("drawing_id", "key").agg(F.count("*").alias("n"), F.min("seg_id").alias("keep")).where("n > 1")
    return per.select("drawing_id", F.col("key.p.x").alias("px"), F.col("key.p.y").alias("py"), F.col("key.q.x").alias("qx"), F.col("key.q.y").alias("qy"), "n", "keep")


def survivors(seg: DataFrame) -> DataFrame:
    """One segment for each key: the first in order."""
    return keyed(seg).groupBy("drawing_id", "key").agg(F.min_by(F.struct("seg_id", "sx", "sy", "ex", "ey"), "seg_id").alias("s")).select("drawing_id", "s.*")


def standalone_groups(seg: DataFrame, contour: str) -> DataFrame:
    """For each duplicate group, whether every contour it touches consists of its
    members only (then all but the first go; else it is a common edge)."""
    rows = keyed(seg)
    total = rows.groupBy("drawing_id", contour).agg(F.count("*").alias("in_contour"))
    inside = rows.groupBy("drawing_id", "key", contour).agg(F.count("*").alias("in_group"), F.min("seg_id").alias("first"))
    both = inside.join(total, ["drawing_id", contour])
    per = both.groupBy("drawing_id", "key").agg(F.sum("in_group").alias("n"), F.min("first").alias("keep"), F.min((F.col("in_group") == F.col("in_contour")).cast("int")).alias("all_standalone"))
    return per.where("n > 1").select("drawing_id", "keep", "n", (F.col("all_standalone") == 1).alias("standalone"))


def collinear_merge(seg: DataFrame) -> DataFrame:
    """Overlapping intervals on one supporting line merged: gaps and islands over the
    running maximum of ends. Touching is no overlap; the line's direction is
    canonical and its offset rounded; members of duplicate groups take no part."""
    alone = keyed(seg).withColumn("copies", F.count("*").over(W.partitionBy("drawing_id", "key"))).where("copies = 1")
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    size = F.hypot(dx, dy)
    ux, uy = dx / size, dy / size
    flip = F.when((ux < -1e-12) | ((F.abs(ux) <= 1e-12) & (uy < 0)), -1.0).otherwise(1.0)
    lines = alone.where(size > 0).withColumn("ux", rounded(ux * flip, 4)).withColumn("uy", rounded(uy * flip, 4))
    along = lambda x, y: F.col(x) * F.col("ux") + F.col(y) * F.col("uy")
    placed = lines.withColumn("off", rounded(F.col("sx") * -F.col("uy") + F.col("sy") * F.col("ux"), 4)).withColumn("lo", F.least(along("sx", "sy"), along("ex", "ey"))).withColumn("hi", F.greatest(along("sx", "sy"), along("ex", "ey")))
    line = W.partitionBy("drawing_id", "ux", "uy", "off").orderBy("lo", "hi", "seg_id")
    reach = F.max("hi").over(line.rowsBetween(W.unboundedPreceding, -1))
    begun = placed.withColumn("new", F.when(reach.isNull() | (F.col("lo") >= reach), 1).otherwise(0))
    island = begun.withColumn("island", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("drawing_id", "ux", "uy", "off", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("members"), F.min("seg_id").alias("keep")).where("members > 1").drop("island")


def contiguous(seg: DataFrame, contour: str, tolerance: float = 1e-6) -> DataFrame:
    """For each contour of ordered segments whether each one's end meets the next
    one's start, the last one's the first's."""
    ring = W.partitionBy("drawing_id", contour).orderBy("seg_id")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    gaps = seg.withColumn("gap", dist(F.col("ex"), F.col("ey"), after("sx"), after("sy")))
    return gaps.groupBy("drawing_id", contour).agg((F.max("gap") <= tolerance).alias("closed"), F.count("*").alias("segments"))


def chain(seg: DataFrame) -> DataFrame:
    """Contours by greedy forward walks: from each unused segment in order, the first
    unused candidate at the open end is taken, reversed if it attaches by its end.
    Walks never leave a connected component, so each is a group of its own; a
    component is one drawing's joined outline and is walked in one task."""
    ship(seg.sparkSession)
    spots = endpoints(seg)
    nodes = spots.groupBy("drawing_id", "x", "y").agg(F.min("pt").alias("pt"))
    ends = spots.withColumnRenamed("pt", "end_pt").join(large(nodes), ["drawing_id", "x", "y"])
    pairs = ends.withColumn("seg_id", F.floor(F.col("end_pt") / 2)).groupBy("drawing_id", "seg_id").agg(F.min("pt").alias("a"), F.max("pt").alias("b"), F.max(F.when(F.col("end_pt") % 2 == 0, F.col("pt"))).alias("s"), F.max(F.when(F.col("end_pt") % 2 == 1, F.col("pt"))).alias("e"))
    found = components(nodes, pairs.where("a <> b").select("drawing_id", "a", "b"))
    rooted = pairs.join(large(found.select("drawing_id", F.col("pt").alias("a"), "root")), ["drawing_id", "a"]).select("drawing_id", "root", "seg_id", "s", "e")

    dealt = rooted.repartition("drawing_id", "root").sortWithinPartitions("drawing_id", "root", "seg_id")
    return dealt.mapInPandas(_walk_groups, f"drawing_id {seg.schema['drawing_id'].dataType.simpleString()}, contour_id long, seg_id long, seg_ord long, reversed boolean, ambiguous boolean")


class _Node:
    """The segments that meet at a point, in order, and how many are not yet walked."""

    def __init__(self):
        self.segments: list[int] = []
        self.left = self.next = 0

    def add(self, k: int) -> None:
        self.segments.append(k)
        self.left += 1


def _walk(rows: list[list]) -> list[tuple]:
    """Chains of one component's segments [drawing, root, seg_id, start, end]. A step is
    ambiguous if several segments not yet walked meet where it begins."""
    nodes: dict[int, _Node] = {}
    for k, (_, _, _, start, end) in enumerate(rows):
        for node in {start, end}:
            nodes.setdefault(node, _Node()).add(k)
    walked, out = [False] * len(rows), []

    def take(k: int, contour: int, order: int, back: bool, ambiguous: bool) -> None:
        walked[k] = True
        drawing, _, seg_id, start, end = rows[k]
        for node in {start, end}:
            nodes[node].left -= 1
        out.append((drawing, contour, seg_id, order, back, ambiguous))

    for seed, (_, _, contour, start, end) in enumerate(rows):
        if walked[seed]:
            continue
        take(seed, contour, 0, False, False)
        order, here = 0, nodes[end]
        while end != start and here.left:
            while walked[here.segments[here.next]]:
                here.next += 1
            k = here.segments[here.next]
            back = rows[k][3] != end
            order += 1
            take(k, contour, order, back, here.left > 1)
            end = rows[k][3] if back else rows[k][4]
            here = nodes[end]
    return out


def _walk_groups(batches):
    """Rows sorted by component stream through; one component is held at a time."""
    import pandas as pd

    names = ["drawing_id", "contour_id", "seg_id", "seg_ord", "reversed", "ambiguous"]
    rows = (row for pdf in batches for row in pdf.to_numpy().tolist())
    held: list[tuple] = []
    for _, component in groupby(rows, key=lambda r: (r[0], r[1])):
        held += _walk(list(component))
        if len(held) > 20_000:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)
