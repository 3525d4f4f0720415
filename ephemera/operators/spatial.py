"""Joins of shapes on place: an adaptive quadtree of cells turns overlap of boxes into an equi-join."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from .lineage import cut, large, spread, tasks

#: Shapes of a cell that is not split again, the deepest level, and what a split must save: pairs left, where it copies so many rows.
CAPACITY, DEEPEST, SAVED, COPIES = 64, 24, 0.75, 1.25
#: Cells of a level that go to every executor with their counts; below that level they are joined.
FEW_CELLS = 4**5
#: What is known of a shape besides its box: nothing, that it is a point, that it fills its box, or that it is one short line (whose vertices are kept).
OTHER, POINT, FULL, LINE = range(4)
#: Vertices of a line that go with it.
SHORT = 64
#: Of a tally: shapes for each cell of its finest grid, cells of a strip that are one block, shapes of a cell beyond which it is not
#: worth while, and vertices of a line whose segments are compared in generated code.
EACH, BLOCK, CROWDED, FEW = 4, 16, 4096, 4
_BOX = ("x0", "y0", "x1", "y1")


def _kind(geometry: Column) -> Column:
    pts, kind, n = geometry["pts"], geometry["gtype"], F.size(geometry["pts"])
    p = [F.get(pts, i) for i in range(5)]
    same = lambda axis, *sides: reduce(lambda u, v: u & v, [p[i][axis] == p[j][axis] for i, j in sides])
    across = lambda x, y: same(y, (0, 1), (2, 3)) & same(x, (1, 2), (3, 0))
    far = lambda axis: (F.abs(p[2][axis] - p[0][axis]) > 0) & (F.abs(p[2][axis] - p[0][axis]) < 1e300)
    one = geometry["starts"].isNull() | (F.size(geometry["starts"]) == 1)
    box = (n == 5) & same("x", (0, 4)) & same("y", (0, 4)) & far("x") & far("y") & (across("x", "y") | across("y", "x"))
    finite = F.forall(pts, lambda v: (F.abs(v["x"]) < 1e300) & (F.abs(v["y"]) < 1e300))
    line = (n > 1) & (n <= SHORT) & F.exists(pts, lambda v: (v["x"] != p[0]["x"]) | (v["y"] != p[0]["y"]))
    found = F.when((kind == "POINT") & (n == 1) & one & finite, POINT).when((kind == "POLYGON") & one & box & finite, FULL).when((kind == "LINESTRING") & one & line & finite, LINE)
    return F.coalesce(found, F.lit(OTHER))


def boxes(shapes: DataFrame, margin: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """id and the box around each shape, wider by a margin; shapes without a vertex have none. kind and line say what shape it is. Columns to keep follow."""
    side = lambda f, c, by: (f(F.transform(F.col("geom")["pts"], lambda p: p[c])) + by).alias
    found = [side(F.array_min, "x", -margin)("x0"), side(F.array_min, "y", -margin)("y0"), side(F.array_max, "x", margin)("x1"), side(F.array_max, "y", margin)("y1")]
    kind = _kind(F.col("geom"))
    return shapes.where(F.size(F.col("geom")["pts"]) > 0).select("id", *found, kind.alias("kind"), F.when(kind == LINE, F.col("geom")["pts"]).alias("line"), *[F.col(c).alias(f"keep_{c}") for c in keep])


class Grid:
    """A square around everything, halved with each level. Cells are numbered by column and row."""

    def __init__(self, x: float, y: float, size: float):
        self.x, self.y, self.size = x, y, size

    def column(self, x: Column, depth: int) -> Column:
        return F.floor((x - self.x) / (self.size / 2**depth)).cast("long")

    def row(self, y: Column, depth: int) -> Column:
        return F.floor((y - self.y) / (self.size / 2**depth)).cast("long")

    def covered(self, rows: DataFrame, depth: int, ix: Column, iy: Column) -> DataFrame:
        """A row for each cell of a level, among those between the bounds of ix and iy, that a row's box touches."""
        span = lambda low, high, bound: F.sequence(F.greatest(low, bound["low"]), F.least(high, bound["high"]))
        at = rows.withColumn("ix", F.explode(span(self.column(F.col("x0"), depth), self.column(F.col("x1"), depth), ix)))
        return at.withColumn("iy", F.explode(span(self.row(F.col("y0"), depth), self.row(F.col("y1"), depth), iy)))


def leaves(left: DataFrame, right: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, Grid] | None:
    """side, id, box, depth, ix, iy: the cells of the tree that each box touches; None if a side is empty.

    A cell that holds more than capacity boxes is split in four, unless that copies rows and leaves most pairs to be compared
    (boxes that cover it all would only be copied); a cell with boxes of one side alone goes. Cells of all levels together
    tile the square. More columns of the boxes stay with them.
    """
    own = [c for c in left.columns if c not in ("id", *_BOX)]
    both = cut(left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)), allowMissingColumns=True))
    span = F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    e = both.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), span, F.count("*"), F.min("side"), F.max("side")).first()
    if e[5] == 0 or e[6] == e[7]:
        return None
    size = max(e[2] - e[0], e[3] - e[1]) * (1 + 1e-9) or 1.0
    grid = Grid(e[0], e[1], size)
    # the first level: no box touches more than four of its cells, and it has no more cells than are needed
    depth = max(0, min(int(math.log2(size / e[4])) if e[4] else DEEPEST, int(math.log(max(e[5] / capacity, 1), 4))))
    whole = lambda d: F.struct(F.lit(0).cast("long").alias("low"), F.lit(2**d - 1).cast("long").alias("high"))
    rows, done = cut(grid.covered(both, depth, whole(depth), whole(depth))), []
    cell = ["ix", "iy"]
    while True:
        counts = rows.groupBy(*cell).agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r")).where("l > 0 AND r > 0").withColumn("n", F.col("l") + F.col("r")).withColumn("pairs", F.col("l").cast("double") * F.col("r"))
        held = rows.join(F.broadcast(counts) if 4**depth <= FEW_CELLS else counts, cell)
        crowded = F.col("n") > capacity if depth < DEEPEST else F.lit(False)
        done.append(held.where(~crowded).select("side", "id", *_BOX, *own, F.lit(depth).alias("depth"), *cell))
        halves = lambda c: F.struct((F.col(c) * 2).alias("low"), (F.col(c) * 2 + 1).alias("high"))
        parents = held.where(crowded).select("side", "id", *_BOX, *own, F.col("ix").alias("px"), F.col("iy").alias("py"), "n", "pairs")
        split = cut(grid.covered(parents, depth + 1, halves("px"), halves("py")))
        parts = split.groupBy("px", "py", *cell).agg(F.count_if(F.col("side") == 0).cast("double").alias("l"), F.count_if(F.col("side") == 1).alias("r"), F.first("n").alias("n"), F.first("pairs").alias("pairs"))
        grown = parts.groupBy("px", "py").agg(F.sum(F.col("l") + F.col("r")).alias("m"), F.first("n").alias("n"), F.sum(F.col("l") * F.col("r")).alias("left"), F.first("pairs").alias("pairs"))
        grown = grown.select("px", "py", ((F.col("m") > COPIES * F.col("n")) & (F.col("left") > SAVED * F.col("pairs"))).alias("copied"))
        judged = split.join(F.broadcast(grown) if 4**depth <= FEW_CELLS else grown, ["px", "py"])
        done.append(judged.where("copied").select("side", "id", *_BOX, *own, F.lit(depth).alias("depth"), F.col("px").alias("ix"), F.col("py").alias("iy")).dropDuplicates(["side", "id", *_BOX, "ix", "iy"]))
        rows, depth = judged.where("NOT copied").select("side", "id", *_BOX, *own, *cell), depth + 1
        if not rows.limit(1).count():
            break
        rows = cut(rows)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return cut(out), grid


def _met(left: DataFrame, right: DataFrame, capacity: int) -> Callable[..., DataFrame] | None:
    """A function that gives all pairs of boxes that meet, each once, with what is known of both as a_ and b_; it takes conditions for either side.

    edges gives in place of them those of which an edge of one is at most so far within the opposite edge of the other, perhaps several times.

    A pair counts in the one cell that holds the lower left corner of what its boxes share: there one of them begins across,
    and one upwards.
    """
    found = leaves(left, right, capacity)
    if found is None:
        return None
    cells, grid = found
    side = F.lit(grid.size) / F.pow(F.lit(2.0), F.col("depth"))
    begins = lambda c, by, at: (F.floor((F.col(c) - by) / side) == F.col(at))
    cells = cells.withColumns({"sx": begins("x0", grid.x, "ix"), "sy": begins("y0", grid.y, "iy")})
    n, cell = tasks(left.sparkSession), ["depth", "ix", "iy"]
    own = lambda k, name: cells.where(F.col("side") == k).select(*cell, F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cells.columns if c not in ("id", "side", *cell)])

    def pairs(a: Column | None = None, b: Column | None = None, edges: float | None = None) -> DataFrame:
        # the pairs of a cell are much work for few bytes: no two tasks are joined
        l, r = (df.repartition(n, *cell) for df in (own(0, "a") if a is None else own(0, "a").where(a), own(1, "b") if b is None else own(1, "b").where(b)))
        if edges:
            stripe = lambda c, by: F.floor(F.col(c) / (2 * edges)) + by
            struct = lambda way, e: F.struct(F.lit(way).alias("way"), e.cast("long").alias("edge"))
            opposite = [("x1", "x0", 1), ("y1", "y0", 1), ("x0", "x1", -1), ("y0", "y1", -1)]
            l = l.withColumn("e", F.explode(F.array(*[struct(i, stripe(f"a_{c}", 0)) for i, (c, _, _) in enumerate(opposite)]))).select("*", "e.*").drop("e")
            r = r.withColumn("e", F.explode(F.array(*[struct(i, stripe(f"b_{c}", by)) for i, (_, c, to) in enumerate(opposite) for by in (0, to)]))).select("*", "e.*").drop("e")
        met = l.join(r, [*cell, "way", "edge"] if edges else cell).where((F.col("a_sx") | F.col("b_sx")) & (F.col("a_sy") | F.col("b_sy")))
        return met.where((F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1")))

    pairs.far = max(abs(grid.x), abs(grid.y), abs(grid.x + grid.size), abs(grid.y + grid.size))
    return pairs


def _no_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(F.col("id").alias("a")).limit(0).join(right.select(F.col("id").alias("b")).limit(0), F.lit(False))


def near_boxes(left: DataFrame, right: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """a, b: ids of all pairs of boxes that meet, each pair once."""
    pairs = _met(left, right, capacity)
    return _no_pairs(left, right) if pairs is None else pairs().select("a", "b")


def _slack() -> Column:
    """How near to an edge rounding may decide."""
    return F.greatest(*[F.abs(f"{s}_{c}") for s in "ab" for c in _BOX]) * 1e-14 + 2e-9


def _inside(a: str, b: str, by: Column | float) -> Column:
    """Whether a's box lies in b's, so far from its edges at least."""
    at = lambda s, c: F.col(f"{s}_{c}")
    return (at(a, "x0") >= at(b, "x0") + by) & (at(a, "y0") >= at(b, "y0") + by) & (at(a, "x1") <= at(b, "x1") - by) & (at(a, "y1") <= at(b, "y1") - by)


def _segment_hits(px: Column, py: Column, qx: Column, qy: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a segment meets a full box. A corner's turn is u - v, and rounding keeps the order of differences, so that the least and greatest of either tell the signs."""
    beside = ((px > x1) & (qx > x1)) | ((px < x0) & (qx < x0)) | ((py > y1) & (qy > y1)) | ((py < y0) & (qy < y0))
    u, v = [(qx - px) * (y - py) for y in (y0, y1)], [(x - px) * (qy - py) for x in (x0, x1)]
    return ~beside & (F.least(*u) <= F.greatest(*v)) & (F.greatest(*u) >= F.least(*v))


def _crosses(line: str, box: str) -> Column:
    """Whether a segment of a line meets a full box: not beside it, and with its corners not all on one side."""
    pts = F.col(f"{line}_line")
    x0, y0, x1, y1 = (F.col(f"{box}_{c}") for c in _BOX)

    hits = lambda p, q: _segment_hits(p["x"], p["y"], q["x"], q["y"], x0, y0, x1, y1)
    return F.exists(F.arrays_zip(F.slice(pts, 1, F.size(pts) - 1).alias("p"), F.slice(pts, 2, F.size(pts) - 1).alias("q")), lambda s: hits(s["p"], s["q"]))


def _is(side: str, *kinds: int) -> Column:
    return F.col(f"{side}_kind").isin(*kinds)


def _open() -> Column:
    """Whether _meeting() is null."""
    return ~((_is("a", POINT, FULL) & _is("b", POINT, FULL)) | (_is("a", LINE) & _is("b", FULL)) | (_is("a", FULL) & _is("b", LINE)))


def _meeting() -> Column:
    """Whether shapes whose boxes meet do so too; null where only a look at them tells."""
    one = lambda line, box: F.when(_is(line, LINE) & _is(box, FULL), F.when(_inside(line, box, 0.0), True).otherwise(_crosses(line, box)))
    return F.when(_is("a", POINT, FULL) & _is("b", POINT, FULL), True).otherwise(F.coalesce(one("a", "b"), one("b", "a")))


def _holding() -> Column:
    """Whether the left one lies in the right one, by their boxes; null where only a look at them tells."""
    return F.when(_is("a", POINT, FULL, LINE) & _is("b", FULL), F.when(_inside("a", "b", _slack()), True).when(~_inside("a", "b", -_slack()), False))


def join_shapes(left: DataFrame, right: DataFrame, how: str = "intersects", distance: float = 0.0, capacity: int = CAPACITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """a, b: ids of left(id, geom) and right(id, geom) whose shapes meet, lie within, or are at most distance apart.

    how is intersects, within (the left one in the right one) or near. Ids tell a side's rows apart. Null geometries and
    those without a vertex match nothing, and an empty side gives no rows. Boxes decide which pairs are looked at, and settle
    those of points, upright rectangles and short lines; only others are compared shape by shape. keep names columns of the
    left side that follow a and b, which saves a join of the many pairs.
    """
    if how not in ("intersects", "within", "near"):
        raise ValueError(f"unknown join {how!r}")
    met = _met(boxes(left, distance if how == "near" else 0.0, keep), boxes(right), capacity)
    if met is None:
        return _no_pairs(left, right).join(left.select(F.col("id").alias("a"), *keep).limit(0), "a").select("a", "b", *keep)
    told = lambda pairs: pairs.select("a", "b", *[F.col(f"a_keep_{c}").alias(c) for c in keep])
    looked = lambda pairs: told(pairs).join(left.select(F.col("id").alias("a"), F.col("geom").alias("ga")), "a").join(right.select(F.col("id").alias("b"), F.col("geom").alias("gb")), "b")
    if how == "near":
        both = looked(met())
        return both.where(geo.pair_measures(F.col("ga"), F.col("gb"))["distance"] <= distance).select("a", "b", *keep)
    if how == "within":
        both = looked(met().where(_holding().isNull()))
        return told(met().where(_holding())).unionByName(both.where(geo.within(F.col("ga"), F.col("gb"))).select("a", "b", *keep))
    # of a point and a full shape boxes tell all, so that only pairs with another kind are met again
    rest = met(_is("a", OTHER, LINE)).unionByName(met(_is("a", POINT, FULL), _is("b", OTHER, LINE))).where(_open())
    both = looked(rest)
    return told(met().where(_meeting())).unionByName(both.where(geo.intersects(F.col("ga"), F.col("gb"))).select("a", "b", *keep))


def _sums(rows: DataFrame, depths: list[int]) -> DataFrame:
    """cls, ix, iy, n, total: of each class and cell of its grid, what the cells up to it in column and row hold together."""
    cells = rows.groupBy("cls", "ix", "iy").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    every = reduce(DataFrame.unionByName, [rows.sparkSession.range(4**k).select(F.lit(k).alias("k"), (F.col("id") % 2**k).alias("ix"), F.floor(F.col("id") / 2**k).cast("long").alias("iy")) for k in depths])
    grid = rows.select("cls").distinct().withColumn("k", F.col("cls.k")).join(every, "k").drop("k")
    out = spread(grid.join(cells, ["cls", "ix", "iy"], "left").select("cls", "ix", "iy", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total")), "cls", "iy")
    for along, across in (("ix", "iy"), ("iy", "ix")):
        w = Window.partitionBy("cls", across).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({c: F.sum(c).over(w) for c in ("n", "total")})
    return out


def _told(left: DataFrame, right: DataFrame, how: str) -> tuple[DataFrame, DataFrame | None] | None:
    """b, by, n, total of pairs that boxes settle, and a, b of those that only a look at them tells: see tally. None if a cell is crowded or a side is empty.

    Shapes of like extent are a class with a grid of its own, whose cells are no smaller, and stand in the cell of their lower left
    corner. Cells that surely lie in a full box count by four sums, whatever they hold; the strips along its edges pair by pair.
    """
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    left = left.withColumn("extent", extent)
    e = left.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), F.count("*")).first()
    far = right.agg(F.max(F.greatest(*[F.abs(c) for c in _BOX]))).first()[0]
    if not e[4] or far is None:
        return None
    size = max(e[2] - e[0], e[3] - e[1]) * (1 + 1e-9) or 1.0
    deepest = max(0, int(math.log(max(e[4] / EACH, 1), 4)))
    k = F.when(F.col("extent") > 0, F.greatest(F.lit(0), F.least(F.lit(deepest), F.floor(F.log2(F.lit(size) / F.col("extent")))))).otherwise(deepest).cast("int")
    own = [c for c in left.columns if c.startswith("keep_by_")]
    side = lambda depth: F.lit(size) / F.pow(F.lit(2.0), depth)
    at = lambda x, begin, depth: F.floor((x - begin) / side(depth)).cast("long")
    top = F.pow(F.lit(2.0), F.col("k")).cast("long") - 1
    within_grid = lambda c: F.greatest(F.lit(0).cast("long"), F.least(top, c))
    rows = left.withColumn("k", k).withColumns({"ix": within_grid(at(F.col("x0"), e[0], F.col("k"))), "iy": within_grid(at(F.col("y0"), e[1], F.col("k")))})
    rows = cut(rows.withColumn("cls", F.struct("k", *own)).withColumnRenamed("keep_value", "value"))
    found = rows.groupBy("k", "ix", "iy").count().groupBy("k").agg(F.max("count").alias("most")).join(rows.groupBy("k").agg(F.max("extent").alias("reach")), "k").collect()
    if max(r["most"] for r in found) > CROWDED:
        return None
    # rounding moves nothing as far as this
    eps = 1e-9 * size + 1e-12 * max(far, *(abs(x) for x in e[:4])) + 2e-9
    classes = F.array(*[F.struct(F.lit(r["k"]).alias("k"), F.lit(float(r["reach"])).alias("reach")) for r in found])
    own_boxes = right.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in (*_BOX, "kind")], F.explode(classes).alias("c")).select("b", *[f"b_{c}" for c in (*_BOX, "kind")], "c.*")
    for axis, begin in (("x", e[0]), ("y", e[1])):
        low, high = F.col(f"b_{axis}0"), F.col(f"b_{axis}1")
        own_boxes = own_boxes.withColumns({
            f"{axis}lo": F.greatest(F.lit(0).cast("long"), at(low - F.col("reach") - eps, begin, F.col("k"))), f"{axis}hi": F.least(top, at(high + eps, begin, F.col("k"))),
            f"{axis}a": F.ceil((low + eps - begin) / side(F.col("k"))).cast("long"), f"{axis}b": at(high - eps - F.col("reach"), begin, F.col("k")) - 1,
        })
        own_boxes = own_boxes.withColumns({f"{axis}a": F.greatest(F.col(f"{axis}a"), F.col(f"{axis}lo")), f"{axis}b": F.least(F.col(f"{axis}b"), F.col(f"{axis}hi"))})
    hollow = (F.col("xa") > F.col("xb")) | (F.col("ya") > F.col("yb"))
    # without cells inside, all its columns are strips
    own_boxes = own_boxes.where("xlo <= xhi AND ylo <= yhi").withColumn("hollow", hollow).withColumns({"xa": F.when(hollow, F.col("xhi") + 1).otherwise(F.col("xa")), "xb": F.when(hollow, F.col("xhi")).otherwise(F.col("xb"))})
    own_boxes = cut(spread(own_boxes, "b"))
    corner = lambda x, y, sign: F.struct(F.col(x[0]) + x[1], F.col(y[0]) + y[1], F.lit(sign)).cast("struct<ix:bigint,iy:bigint,sign:bigint>")
    hi_x, lo_x, hi_y, lo_y = ("xb", 0), ("xa", -1), ("yb", 0), ("ya", -1)
    corners = own_boxes.where("NOT hollow").select("b", "k", F.explode(F.array(corner(hi_x, hi_y, 1), corner(lo_x, hi_y, -1), corner(hi_x, lo_y, -1), corner(lo_x, lo_y, 1))).alias("c")).select("b", "k", "c.*").where("ix >= 0 AND iy >= 0")
    n = tasks(left.sparkSession)
    sums = _sums(rows, sorted(r["k"] for r in found)).withColumn("k", F.col("cls.k"))
    inside = corners.repartition(n, "k", "ix", "iy").join(large(sums), ["k", "ix", "iy"]).select("b", *[F.col(f"cls.{c}").alias(c) for c in own], (F.col("n") * F.col("sign")).alias("n"), (F.col("total") * F.col("sign")).alias("total"))
    span = lambda low, high, none: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")) if none else F.sequence(low, high)
    strips = lambda axis: F.concat(span(F.col(f"{axis}lo"), F.least(F.col(f"{axis}a") - 1, F.col(f"{axis}hi")), True), span(F.greatest(F.col(f"{axis}b") + 1, F.col(f"{axis}a")), F.col(f"{axis}hi"), True))
    blocks = lambda low, high: span(F.floor(F.col(low) / BLOCK).cast("long"), F.floor(F.col(high) / BLOCK).cast("long"), False)
    up = own_boxes.withColumn("u", F.explode(strips("x"))).withColumn("v", F.explode(blocks("ylo", "yhi"))).withColumn("way", F.lit(0))
    flat = own_boxes.where("NOT hollow").withColumn("u", F.explode(strips("y"))).withColumn("v", F.explode(blocks("xa", "xb"))).withColumn("way", F.lit(1))
    key = ["k", "way", "u", "v"]
    told = up.unionByName(flat).select("b", *[f"b_{c}" for c in (*_BOX, "kind")], "xa", "xb", *key)
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    strip = F.array(*[F.struct(F.lit(w).alias("way"), u.alias("u"), v.alias("v")) for w, u, v in ((0, F.col("ix"), block("iy")), (1, F.col("iy"), block("ix")))])
    # a short line's last vertex stands for those that it has not: a segment of no length hits a box if it lies in it
    few = [F.col("line")[F.least(F.size("line") - 1, F.lit(i))][c].alias(f"{c}{i}_") for i in range(FEW) for c in "xy"]
    strips_of = lambda those, *more: rows.where(those).select(F.col("id").alias("a"), "k", "ix", "value", *own, *[F.col(c).alias(f"a_{c}") for c in (*_BOX, "kind")], *more, F.explode(strip).alias("s")).select("*", "s.*").drop("s")
    told = large(told.repartition(n, *key))

    def met(each: DataFrame) -> DataFrame:
        out = each.repartition(n, *key).join(told, key).where((F.col("way") == 0) | F.col("ix").between(F.col("xa"), F.col("xb")))
        return out.where((F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1")))

    counted = lambda pairs: pairs.select("b", *own, F.lit(1).cast("long").alias("n"), F.col("value").alias("total"))
    summed = lambda parts: reduce(DataFrame.unionByName, parts).groupBy("b", *own).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
    if how == "within":
        pairs = met(strips_of(F.lit(True)))
        return summed([inside, counted(pairs.where(_holding()))]), pairs.where(_holding().isNull()).select("a", "b")
    box = [F.col(f"b_{c}") for c in _BOX]
    hit = reduce(lambda u, v: u | v, [_segment_hits(*[F.col(f"{c}{i}_") for i in (i, i + 1) for c in "xy"], *box) for i in range(FEW - 1)])
    many = (F.col("kind") == LINE) & (F.size("line") > FEW)
    found = [inside, counted(met(strips_of(~many, *few)).where((F.col("a_kind") != LINE) | _inside("a", "b", 0.0) | hit))]
    if rows.where(many).limit(1).count():
        found.append(counted(met(strips_of(many, F.col("line").alias("a_line"))).where(_inside("a", "b", 0.0) | _crosses("a", "b"))))
    return summed(found), None


def tally(left: DataFrame, right: DataFrame, how: str = "intersects", by: tuple[str, ...] = (), value: str = "id") -> DataFrame:
    """b, by, n, total: how many shapes of left(id, geom) meet each one of right(id, geom), or lie in it, and the sum of their value.

    The same as join_shapes with a grouping by b and by, but pairs of points, short lines or upright rectangles with an
    upright rectangle are only made along its edges. by are columns of few values of the left side, value is of whole numbers.
    """
    own = [f"by_{c}" for c in by]
    kept = left.withColumns({f"by_{c}": F.col(c) for c in by}).withColumn("value", F.col(value).cast("long"))
    l, r = cut(boxes(kept, keep=(*own, "value"))), cut(boxes(right))
    simple, full = F.col("kind") != OTHER, F.col("kind") == FULL
    told = _told(l.where(simple), r.where(full), how)
    grouped = lambda pairs: pairs.groupBy("b", *own).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    if told is None:
        out = grouped(join_shapes(kept, right, how, keep=(*own, "value")))
    else:
        sums, looked = told
        parts = [sums.select("b", *[F.col(f"keep_{c}").alias(c) for c in own], "n", "total")]
        kind = lambda df, those: df.where(those(_kind(F.col("geom"))))
        if l.where(~simple).limit(1).count():
            parts.append(grouped(join_shapes(kind(kept, lambda k: k == OTHER), right, how, keep=(*own, "value"))))
        if r.where(~full).limit(1).count():
            parts.append(grouped(join_shapes(kind(kept, lambda k: k != OTHER), kind(right, lambda k: k != FULL), how, keep=(*own, "value"))))
        if looked is not None:
            both = looked.join(kept.select(F.col("id").alias("a"), F.col("geom").alias("ga"), *own, "value"), "a").join(right.select(F.col("id").alias("b"), F.col("geom").alias("gb")), "b")
            parts.append(grouped(both.where(geo.within(F.col("ga"), F.col("gb"))).select("a", "b", *own, "value")))
        out = reduce(DataFrame.unionByName, parts)
        out = out.groupBy("b", *own).agg(F.sum("n").alias("n"), F.sum("total").alias("total")) if len(parts) > 1 else out
    return out.select("b", *[F.col(f"by_{c}").alias(c) for c in by], "n", "total")


def shared(left: DataFrame, right: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """a, b, part, p, inside: what two meeting shapes have in common (its highest dimension), a point on it, and whether that lies within both.

    What two upright rectangles have in common is one (box is true, and area the product of its sides, so that part need not be
    made); other pairs are laid over each other. gtype is that of the part.
    """
    met = _met(boxes(left), boxes(right), capacity)
    point = "struct<x:double,y:double>"
    if met is None:
        return _no_pairs(left, right).select("a", "b", F.lit(None).cast(geo.GEOMETRY).alias("part"), F.lit(None).cast(point).alias("p"), F.lit(True).alias("inside"), F.lit("").alias("gtype"), F.lit(0.0).alias("area"), F.lit(True).alias("box"))
    x0, y0, x1, y1 = (f(f"a_{c}", f"b_{c}") for f, c in zip((F.greatest, F.greatest, F.least, F.least), _BOX, strict=True))
    sides = F.least(x1 - x0, y1 - y0)
    # no pair's slack is more than this, which spares working it out for each; what is narrower has a thin box or opposite edges close together
    most = (met.far * 1e-9 + 2e-4) * (1 + 1e-6)
    thin = lambda s: F.least(F.col(f"{s}x1") - F.col(f"{s}x0"), F.col(f"{s}y1") - F.col(f"{s}y0")) <= most
    a_full, b_full = _is("a", FULL), _is("b", FULL)
    narrow = met(a_full & thin("a_"), b_full).unionByName(met(a_full, b_full & thin("b_"))).unionByName(met(a_full, b_full, edges=most).drop("way", "edge"))
    narrow = cut(narrow.where(sides <= most).dropDuplicates(["a", "b"]))
    wide = sides > _slack() * 1e5
    xy = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    mid = xy((x0 + x1) / 2, (y0 + y1) / 2)
    held = [F.col(f"{s}_{c}") < m if c.endswith("0") else F.col(f"{s}_{c}") > m for s in "ab" for c, m in zip(_BOX, ((x0 + x1) / 2, (y0 + y1) / 2) * 2, strict=True)]
    ring = F.array(xy(x0, y0), xy(x1, y0), xy(x1, y1), xy(x0, y1), xy(x0, y0))
    whole = [geo.shape("POLYGON", ring).cast(geo.GEOMETRY).alias("part"), mid.cast(point).alias("p"), reduce(lambda u, v: u & v, held).alias("inside"), F.lit("POLYGON").alias("gtype"), ((x1 - x0) * (y1 - y0)).alias("area"), F.lit(True).alias("box")]
    out = met(a_full, b_full).where(sides > most).select("a", "b", *whole).unionByName(narrow.where(wide).select("a", "b", *whole))
    rest = narrow.where(~wide).select("a", "b").unionByName(met(_is("a", OTHER, POINT, LINE)).select("a", "b")).unionByName(met(a_full, _is("b", OTHER, POINT, LINE)).select("a", "b"))
    both = rest.join(left.select(F.col("id").alias("a"), F.col("geom").alias("ga")), "a").join(right.select(F.col("id").alias("b"), F.col("geom").alias("gb")), "b")
    over = both.withColumn("part", geo.intersection(F.col("ga"), F.col("gb"))).where("part.gtype IS NOT NULL").withColumn("p", geo.point_on(F.col("part")))
    at = geo.point(F.col("p.x"), F.col("p.y"))
    inside = geo.within(F.col("m"), F.col("ga")) & geo.within(F.col("m"), F.col("gb"))
    return out.unionByName(over.withColumn("m", at).select("a", "b", "part", "p", inside.alias("inside"), F.col("part.gtype").alias("gtype"), F.lit(None).cast("double").alias("area"), F.lit(False).alias("box")))
