"""Density-based clusters of positions by cells, without all pairs of points.

The plane is cut into cells whose diagonal is the neighbourhood's radius, so all points of a cell are neighbours:

* a cell with enough points is all core, whatever is around it, and no pairs are made inside it;
* cells with fewer hold less than ``least`` points, so that comparing each of them with the points of the cells
  around makes pairs in proportion to the points;
* clusters are components of cells, not of points.  Two full cells are linked if some pair of their points is near:
  they are compared by squares, each with one of its points, and only squares that the radius may still pass between
  are cut finer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..sources.scratch import written

METRES_A_DEGREE = 111_194.9
#: squares along a cell's side, for each finer grid
CUTS = 8
#: below this an edge is rounding
FINEST = 15


class Grid:
    """Cells of bands of latitude: a band's cells are as wide as at its end nearest the equator, so no diagonal exceeds the radius.

    Exact between 89 degrees south and north; the 180th meridian is passed.
    """

    def __init__(self, eps_m: float):
        self.eps_m = eps_m
        self.step = eps_m / METRES_A_DEGREE / 2**0.5 * (1 - 1e-6)
        self.reach = eps_m / METRES_A_DEGREE * (1 + 1e-6)

    def band(self, lat: Column) -> Column:
        return F.floor(lat / self.step).cast("long")

    def width(self, band: Column) -> Column:
        """Degrees of longitude of a band's cells."""
        nearest = F.when(band >= 0, band).otherwise(-band - 1) * self.step
        return F.lit(self.step) / F.greatest(F.cos(F.radians(nearest)), F.lit(0.01))

    def cell(self, band: Column, lon: Column) -> Column:
        return F.floor((lon + 180) / self.width(band)).cast("long")

    def around(self, cells: DataFrame) -> DataFrame:
        """Rows with (y, x) of a cell, once for each cell (y2, x2) that its points' neighbours may lie in."""
        farthest = (F.greatest(F.abs(F.col("y")), F.abs(F.col("y") + 1)) + 2) * self.step
        reach = F.lit(self.reach) / F.greatest(F.cos(F.radians(farthest)), F.lit(0.01))
        rows = cells.withColumn("y2", F.explode(F.expr("sequence(y - 2, y + 2)")))
        own, other = self.width(F.col("y")), self.width(F.col("y2"))
        low, high = F.col("x") * own - reach, (F.col("x") + 1) * own + reach
        turn = F.ceil(F.lit(360.0) / other).cast("long")
        # past the 180th meridian the count goes on from the other side; the last cell there is cut short, so one more is looked at
        wide = F.sequence(F.floor(low / other).cast("long") - F.when(low < 0, 1).otherwise(0), F.floor(high / other).cast("long") + F.when(high > 360, 1).otherwise(0))
        return rows.withColumn("x2", F.explode(F.array_distinct(F.transform(wide, lambda x: F.pmod(x, turn)))))

    def square(self, value: Column, start: Column, width: Column, cuts: int) -> Column:
        return F.least(F.floor((value - start) / width * cuts), F.lit(cuts - 1)).cast("long")


def _near(a: str, b: str, eps_m: float) -> Column:
    return C.haversine_m(F.col(f"{a}lat"), F.col(f"{a}lon"), F.col(f"{b}lat"), F.col(f"{b}lon")) <= eps_m


def linked_cells(points: DataFrame, pairs: DataFrame, grid: Grid, key: str = "pid") -> DataFrame:
    """The ``pairs`` (key, y, x, y2, x2) of cells with points within the radius; points: key, y, x, lat, lon.

    Each round cuts the squares of open pairs eight times finer a side and keeps one point a square.  A pair of squares is
    near if their two points are; it is far if these are apart by more than the radius and both diagonals; else, with
    more than the two points, it stays open.  Cells that are near in any pair are done.
    """
    cell, found = [key, "y", "x", "y2", "x2"], None
    width = grid.width(F.col("y"))
    open_ = written(pairs.withColumns({c: F.lit(0).cast("long") for c in ("r", "c", "r2", "c2")}), "open-cells")
    for depth in range(1, FINEST + 1):
        fine, coarse = CUTS**depth, CUTS ** (depth - 1)
        row = lambda n: grid.square(F.col("lat"), F.col("y") * grid.step, F.lit(grid.step), n)
        column = lambda n: grid.square(F.col("lon") + 180, F.col("x") * width, width, n)
        squares = points.groupBy(key, "y", "x", row(coarse).alias("r"), column(coarse).alias("c"), row(fine).alias("fr"), column(fine).alias("fc")).agg(
            F.count("*").alias("n"), F.min(F.struct("lat", "lon")).alias("p")
        )
        other = squares.select(F.col(key), F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("fr").alias("fr2"), F.col("fc").alias("fc2"), F.col("n").alias("n2"), F.col("p").alias("p2"))
        met = open_.join(squares, [key, "y", "x", "r", "c"]).join(other, [key, "y2", "x2", "r2", "c2"])
        apart = C.haversine_m(F.col("p.lat"), F.col("p.lon"), F.col("p2.lat"), F.col("p2.lon"))
        slack = 2 * grid.eps_m / fine * (1 + 1e-3)
        met = met.withColumn("apart", apart).where((F.col("apart") <= grid.eps_m) | ((F.col("n") + F.col("n2") > 2) & (F.col("apart") <= grid.eps_m + slack)))
        met = written(met.select(*cell, F.col("fr").alias("r"), F.col("fc").alias("c"), F.col("fr2").alias("r2"), F.col("fc2").alias("c2"), (F.col("apart") <= grid.eps_m).alias("near")), "met-squares")
        near = met.where("near").select(*cell).distinct()
        found = near if found is None else found.unionByName(near)
        open_ = written(met.where("not near").drop("near").join(near, cell, "left_anti"), "open-cells")
        if open_.isEmpty():
            return found
    raise RuntimeError(f"cells are still open at squares of 1/{CUTS**FINEST} of their side")


def components(nodes: DataFrame, links: DataFrame, key: list[str], rounds: int) -> DataFrame:
    """``nodes`` (key, label: distinct a participant) with the least label that links (both ways) reach, as ``cluster``.

    A round tells each node the clusters of its neighbours, and its cluster's own node as well, so that a whole cluster joins
    the least one beside it and not only its rim; then the way that is left is halved.  Rounds grow with the logarithm of the
    nodes, whatever the order of the labels; each is written down.  Raises if that does not settle.  links: key, label, other
    (labels of both ends).
    """
    labels, before = nodes.withColumn("cluster", F.col("label")), None
    for _ in range(rounds):
        told = links.join(labels.select(*key, F.col("label").alias("other"), F.col("cluster").alias("heard")), [*key, "other"])
        told = told.groupBy(*key, "label").agg(F.min("heard").alias("heard")).join(labels, [*key, "label"]).where("heard < cluster")
        told = told.select(*key, F.explode(F.array("label", "cluster")).alias("label"), "heard")
        least = labels.select(*key, "label", F.col("cluster").alias("heard")).unionByName(told).groupBy(*key, "label").agg(F.min("heard").alias("cluster"))
        jump = least.join(least.select(*key, F.col("label").alias("cluster"), F.col("cluster").alias("further")), [*key, "cluster"])
        labels = written(jump.select(*key, "label", F.least("cluster", "further").alias("cluster")), "clusters")
        state = labels.agg(F.sum(F.col("cluster").cast("decimal(38,0)")), F.count("*")).first()
        if state == before:
            return labels
        before = state
    raise RuntimeError(f"clusters have not settled in {rounds} rounds")


def density_clusters(points: DataFrame, eps_m: float = 150.0, least: int = 4, rounds: int = 40) -> DataFrame:
    """(pid, a, cluster) of density-based clusters; points: pid, a (number), lat, lon, weight.

    A point with ``least`` points within ``eps_m`` (itself included, copies counted) is a core; cores near
    each other are one cluster, named after its least core; other points near a core join the least such
    cluster; the rest are noise and not returned.  Rows with a null are noise.  Positions of a participant are
    given once, with their number as weight.  An empty table gives an empty result.
    """
    grid = Grid(eps_m)
    rows = points.select("pid", "a", "lat", "lon", "weight").dropna().where(~F.isnan("lat") & ~F.isnan("lon"))
    # longitudes of one turn, so that 180 and -180 are one place
    rows = rows.withColumn("lon", F.when((F.col("lon") >= -180) & (F.col("lon") < 180), F.col("lon")).otherwise(F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180))
    rows = written(rows.withColumn("y", grid.band(F.col("lat"))).withColumn("x", grid.cell(F.col("y"), F.col("lon"))), "points")
    cells = written(rows.groupBy("pid", "y", "x").agg((F.sum("weight") >= least).alias("full"), F.min("a").alias("first")), "cells")
    full, thin = cells.where("full"), cells.where("not full")

    # thin cells: their points meet all points around, pairs of near ones stay
    place = ["pid", "y", "x"]
    seekers = grid.around(rows.join(thin.select(*place), place).select("pid", "y", "x", "a", "lat", "lon"))
    others = rows.select("pid", F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("a").alias("b"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), "weight")
    pairs = seekers.join(others, ["pid", "y2", "x2"]).where(_near("", "to_", eps_m)).select("pid", "y", "x", "a", "y2", "x2", "b", "weight")
    pairs = written(pairs, "thin-pairs")
    cores = written(pairs.groupBy("pid", "y", "x", "a").agg(F.sum("weight").alias("n")).where(F.col("n") >= least).select("pid", "y", "x", "a"), "thin-cores")

    # a cell with a core is a node, named after its least core
    nodes = full.select(*place, F.col("first").alias("label")).unionByName(cores.groupBy(*place).agg(F.min("a").alias("label")))
    nodes = written(nodes, "core-cells")
    far = nodes.select("pid", F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("label").alias("other"))
    ordered = (F.col("y") < F.col("y2")) | ((F.col("y") == F.col("y2")) & (F.col("x") < F.col("x2")))
    both = grid.around(full.select(*place)).where(ordered).join(full.select("pid", F.col("y").alias("y2"), F.col("x").alias("x2")), ["pid", "y2", "x2"])
    close = linked_cells(rows.select(*place, "lat", "lon"), both.select("pid", "y", "x", "y2", "x2"), grid)
    # cores of thin cells are near cores of thin cells, and near any point of full ones
    by_core = pairs.join(cores.select("pid", "a"), ["pid", "a"])
    to_thin = by_core.join(cores.select("pid", F.col("a").alias("b")), ["pid", "b"], "left_semi")
    to_full = by_core.join(full.select("pid", F.col("y").alias("y2"), F.col("x").alias("x2")), ["pid", "y2", "x2"], "left_semi")
    links = reduce(DataFrame.unionByName, (d.select("pid", "y", "x", "y2", "x2") for d in (close, to_thin, to_full))).distinct()
    links = links.join(nodes, place).join(far, ["pid", "y2", "x2"]).where("label <> other").select("pid", "label", "other")
    links = written(links.unionByName(links.select("pid", F.col("other").alias("label"), F.col("label").alias("other"))).distinct(), "cell-links")
    named = components(nodes.select("pid", "label"), links, ["pid"], rounds)
    of_cell = written(nodes.join(named, ["pid", "label"]).select(*place, "cluster"), "cell-clusters")

    inside = rows.join(full.select(*place), place, "left_semi").select("pid", "y", "x", "a").unionByName(cores).join(of_cell, place).select("pid", "a", "cluster")
    # other points of thin cells: the least cluster of a core near them
    border = pairs.join(cores.select("pid", "a"), ["pid", "a"], "left_anti")
    core_at = full.select("pid", F.col("y").alias("y2"), F.col("x").alias("x2"))
    near_full = border.join(core_at, ["pid", "y2", "x2"], "left_semi")
    near_thin = border.join(cores.select("pid", F.col("a").alias("b")), ["pid", "b"], "left_semi")
    there = of_cell.select("pid", F.col("y").alias("y2"), F.col("x").alias("x2"), "cluster")
    edge = near_full.select("pid", "a", "y2", "x2").unionByName(near_thin.select("pid", "a", "y2", "x2")).join(there, ["pid", "y2", "x2"]).groupBy("pid", "a").agg(F.min("cluster").alias("cluster"))
    return inside.unionByName(edge)
