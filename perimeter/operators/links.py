"""Linking detections that are close in space and time, and closing the links transitively.

Detections are binned into boxes of side r/sqrt(2) and duration h. Any two detections of a box
are within both limits, so a box is one vertex however many detections it holds, and the number
of links is bounded by the number of occupied boxes (37 neighbours each), not by pairs of
detections. Whether two neighbouring boxes really hold a linked pair is decided exactly by
comparing tight bounds, then the bounds of ever smaller cells, and only where those still
straddle a limit the distinct places inside one pair of smallest cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimeter.storage import materialize

_BIAS, _BITS = 1 << 19, 20
_LEVELS = ((4, 3), (2, 2), (0, 0))  # halvings left per level: (space, time) from box to leaf


def _pack(t: Column, y: Column, x: Column) -> Column:
    return (F.shiftleft(t.cast("long"), 2 * _BITS)
            .bitwiseOR(F.shiftleft((y + _BIAS).cast("long"), _BITS)).bitwiseOR((x + _BIAS).cast("long")))


def _unpack(box: str) -> tuple[Column, Column, Column]:
    mask = F.lit((1 << _BITS) - 1)
    b = F.col(box)
    return (F.shiftright(b, 2 * _BITS), F.shiftright(b, _BITS).bitwiseAND(mask) - _BIAS, b.bitwiseAND(mask) - _BIAS)


def with_box(points: DataFrame, radius_m: float, hours: int) -> DataFrame:
    """Adds `box`, the vertex a detection belongs to. Needs x, y (metres) and t_s (seconds)."""
    side, span = radius_m / math.sqrt(2), hours * 3600
    return points.withColumn("box", _pack(F.floor(F.col("t_s") / span), F.floor(F.col("y") / side),
                                          F.floor(F.col("x") / side)))


def _bounds(df: DataFrame, key: list[str], source: dict[str, str]) -> DataFrame:
    return df.groupBy(*key).agg(*[
        (F.min if n.endswith("0") else F.max)(source[n]).alias(n) for n in ("x0", "x1", "y0", "y1", "t0", "t1")])


def _verdict(pairs: DataFrame, radius_m: float, hours: int) -> DataFrame:
    """`sure` where some cross pair must be linked; pairs that cannot be linked are dropped.

    Bounds are tight, so each face of a box holds a detection: two detections on facing faces are
    exactly the face distance apart along that axis and at most the full spread along the others."""
    def spread(lo: str, hi: str) -> tuple[Column, Column, Column]:
        a0, a1, b0, b1 = (F.col(f"{s}.{n}") for s in ("a", "b") for n in (lo, hi))
        return (F.greatest(b1 - a0, a1 - b0), F.greatest(b0 - a1, a0 - b1, F.lit(0).cast("double")),
                F.least(F.abs(b0 - a1), F.abs(a0 - b1)))
    (xf, xn, xe), (yf, yn, ye), (tf, tn, te) = spread("x0", "x1"), spread("y0", "y1"), spread("t0", "t1")
    r2, span = float(radius_m) ** 2, float(hours * 3600)
    faces = (((xf * xf + yf * yf <= r2) & (te <= span))
             | ((tf <= span) & ((xe * xe + yf * yf <= r2) | (xf * xf + ye * ye <= r2))))
    return pairs.filter((xn * xn + yn * yn <= r2) & (tn <= span)).withColumn("sure", faces)


def _children(open_pairs: DataFrame, level: DataFrame, radius_m: float, hours: int) -> DataFrame:
    for side in ("a", "b"):
        child = level.select(F.col("parent").alias("_parent"),
                             F.struct("cell", "x0", "x1", "y0", "y1", "t0", "t1").alias("_child"))
        open_pairs = (open_pairs.join(child, F.col(f"{side}.cell") == F.col("_parent"))
                      .withColumn(side, F.col("_child")).drop("_parent", "_child"))
    return _verdict(open_pairs, radius_m, hours)


class BoxLinks:
    """Pairs of neighbouring boxes, decided by their bounds (`links`) or still `unsure`."""

    def __init__(self, points: DataFrame, radius_m: float, hours: int) -> None:
        self.radius_m, self.hours = radius_m, hours
        side, span = radius_m / math.sqrt(2), hours * 3600
        s_bits, t_bits = _LEVELS[0]
        leaf_x, leaf_y = F.floor(F.col("x") / (side / 2**s_bits)), F.floor(F.col("y") / (side / 2**s_bits))
        leaf_t = F.floor(F.col("t_s") / (span / 2**t_bits))
        fields = dict(x0="x", x1="x", y0="y", y1="y", t0="t_s", t1="t_s")
        self._same = {n: n for n in fields}
        self._leaves = materialize(_bounds(points.withColumn("lx", leaf_x).withColumn("ly", leaf_y).withColumn("lt", leaf_t),
                                           ["lx", "ly", "lt"], fields))
        self._places = (_bounds(points.withColumn("cell", F.struct(leaf_t.alias("t"), leaf_y.alias("y"), leaf_x.alias("x"))),
                                ["cell", "x", "y"], fields).drop("x", "y"))
        boxes = self._table(0)
        near = [(dt, dy, dx) for dt in (0, 1) for dy in range(-2, 3) for dx in range(-2, 3)
                if dt == 1 or (dy, dx) > (0, 0)]
        steps = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(y).alias("y"), F.lit(x).alias("x")) for t, y, x in near])
        row = F.struct("cell", "x0", "x1", "y0", "y1", "t0", "t1")
        probes = (boxes.select(row.alias("a"), F.explode(steps).alias("d"))
                  .withColumn("target", F.struct((F.col("a.cell.t") + F.col("d.t")).alias("t"),
                                                 (F.col("a.cell.y") + F.col("d.y")).alias("y"),
                                                 (F.col("a.cell.x") + F.col("d.x")).alias("x"))).drop("d"))
        pairs = probes.join(boxes.select(row.alias("b")), F.col("target") == F.col("b.cell")).drop("target")
        decided = materialize(_verdict(pairs.select("a", "b", _pack(*(F.col(f"a.cell.{c}") for c in "tyx")).alias("pa"),
                                                    _pack(*(F.col(f"b.cell.{c}") for c in "tyx")).alias("pb")),
                                       radius_m, hours))
        self.links = decided.filter("sure").select("pa", "pb")
        self.unsure = decided.filter(~F.col("sure")).drop("sure")

    def _cells(self, level: int) -> Column:
        s, t = _LEVELS[level]
        return F.struct(F.shiftright("lt", t).alias("t"), F.shiftright("ly", s).alias("y"),
                        F.shiftright("lx", s).alias("x"))

    def _table(self, level: int) -> DataFrame:
        if level == 0:
            return _bounds(self._leaves.withColumn("cell", self._cells(0)), ["cell"], self._same)
        return _bounds(self._leaves.withColumn("cell", self._cells(level)).withColumn("parent", self._cells(level - 1)),
                       ["cell", "parent"], self._same)

    def keep(self, pairs: DataFrame) -> None:
        """Leaves and places without those of boxes that are in none of the pairs."""
        ends = pairs.select(F.col("a.cell").alias("_box")).unionByName(pairs.select(F.col("b.cell").alias("_box"))).distinct()
        self._leaves = materialize(self._leaves.withColumn("_box", self._cells(0)).join(ends, "_box", "left_semi").drop("_box"))
        held = self._leaves.select(F.struct(F.col("lt").alias("t"), F.col("ly").alias("y"), F.col("lx").alias("x")).alias("cell"))
        self._places = materialize(self._places.join(held, "cell", "left_semi"))

    def settle(self, unsure: DataFrame) -> DataFrame:
        """The linked (pa, pb) among pairs of `unsure`, repeats included."""
        radius_m, hours = self.radius_m, self.hours
        links = []
        for level in range(1, len(_LEVELS)):
            decided = materialize(_children(unsure, self._table(level), radius_m, hours))
            found = decided.filter("sure").select("pa", "pb").distinct()
            links.append(found)
            unsure = decided.filter(~F.col("sure")).drop("sure").join(found, ["pa", "pb"], "left_anti")
        # A place keeps its first and last time. Between boxes one time step apart the last time of
        # the earlier and the first of the later decide; inside one step every time is in reach.
        last = unsure.join(self._places.select(F.col("cell").alias("_c"), F.struct("x0", "y0", "t0", "t1").alias("p")),
                           F.col("a.cell") == F.col("_c")).drop("_c")
        dx, dy = F.col("p.x0") - F.col("q.x0"), F.col("p.y0") - F.col("q.y0")
        exact = (last.join(self._places.select(F.col("cell").alias("_c"), F.struct("x0", "y0", "t0", "t1").alias("q")),
                           (F.col("b.cell") == F.col("_c")) & (dx * dx + dy * dy <= float(radius_m) ** 2)
                           & (F.col("q.t0") - F.col("p.t1") <= hours * 3600))
                 .select("pa", "pb"))
        out = exact
        for more in links:
            out = out.unionByName(more)
        return out


def link_boxes(points: DataFrame, radius_m: float = 2000.0, hours: int = 96) -> DataFrame:
    """Distinct links (a, b) between boxes that hold at least one linked pair of detections."""
    pairs = BoxLinks(points, radius_m, hours)
    out = pairs.links.unionByName(pairs.settle(pairs.unsure))
    return out.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()


def box_components(boxes: DataFrame, points: DataFrame, radius_m: float, hours: int) -> DataFrame:
    """(box, component) for every box, as `connected_components` has it for all of `link_boxes`.

    Most boxes of a fire are joined by links that are sure from the start. A pair that is not sure changes nothing unless
    its ends are still in different parts, so only such pairs are looked into."""
    pairs = BoxLinks(points, radius_m, hours)
    parts = materialize(connected_components(boxes, pairs.links.select(F.col("pa").alias("a"), F.col("pb").alias("b"))))
    end = {s: parts.select(F.col("box").alias(f"p{s}"), F.col("component").alias(f"c{s}")) for s in "ab"}
    apart = materialize(pairs.unsure.join(end["a"], "pa").join(end["b"], "pb").filter("ca <> cb"))
    pairs.keep(apart)
    found = (pairs.settle(apart.drop("ca", "cb")).distinct().join(end["a"], "pa").join(end["b"], "pb")
             .select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    whole = connected_components(parts.select(F.col("component").alias("box")).distinct(), found)
    return (parts.join(whole.select(F.col("box").alias("part"), F.col("component").alias("_end")), F.col("component") == F.col("part"))
            .select("box", F.col("_end").alias("component")))


def box_index(box: str) -> list[Column]:
    """The (time, row, column) numbers inside a packed box, for reports."""
    t, y, x = _unpack(box)
    return [t.alias(f"{box}_t"), y.alias(f"{box}_y"), x.alias(f"{box}_x")]


def _mix(c: Column) -> Column:
    """A bijection on 64-bit keys that scatters neighbouring boxes (xorshift), so that chains of
    boxes do not contract one link per round."""
    c = c.bitwiseXOR(F.shiftleft(c, 13))
    c = c.bitwiseXOR(F.shiftrightunsigned(c, 7))
    return c.bitwiseXOR(F.shiftleft(c, 17))


def connected_components(vertices: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex; `links` holds columns a, b.

    Contraction: each vertex points to its least neighbour, two pointer doublings follow those
    pointers four links far, and the links are rewritten between the images. The link table shrinks
    geometrically; each round is written to the checkpoint folder. The per-round maps are then
    composed from the smallest outwards, so no round touches the full vertex table."""
    maps: list[DataFrame] = []
    edges = materialize(links.select(_mix(F.col("a")).alias("a"), _mix(F.col("b")).alias("b")).filter("a <> b"))
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        for _ in range(2):
            nxt = hop.select(F.col("a").alias("p"), F.col("p").alias("_n"))
            hop = hop.join(nxt, "p").select("a", F.col("_n").alias("p"))
        hop = materialize(hop)
        maps.append(hop)
        to_a = hop.select("a", F.col("p").alias("na"))
        to_b = hop.select(F.col("a").alias("b"), F.col("p").alias("nb"))
        edges = materialize(edges.join(to_a, "a").join(to_b, "b").filter("na <> nb")
                            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
        if edges.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    final = maps[-1]
    for hop in reversed(maps[:-1]):
        tail = final.select(F.col("a").alias("p"), F.col("p").alias("_end"))
        final = hop.join(tail, "p", "left").select("a", F.coalesce("_end", "p").alias("p"))
    keyed = vertices.select("box", _mix(F.col("box")).alias("a"))
    return keyed.join(final, "a", "left").select("box", F.coalesce("p", "a").alias("component"))
