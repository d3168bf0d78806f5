"""Cells of latitude and longitude that meet around longitude 180 and at the poles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankatlas.functions.scalars import MILES_PER_DEGREE, haversine_miles
from rankatlas.operators.lineage import checkpoint

#: From here to a pole one cell goes all around.
POLE, AROUND_POLE = 89.9, -(1 << 40)


def east(lng: Column) -> Column:
    """A longitude from -180 up to 180."""
    return F.pmod(lng + 180, F.lit(360.0)) - 180


def own_cells(lat: Column, lng: Column, side: float) -> Column:
    """The cells (y, x) of `side` degrees in which a place is found: its own, and near a pole the one around it."""
    polar = F.abs(lat) + 2 * side >= POLE
    columns = F.filter(F.array(F.floor(east(lng) / side), F.when(polar, F.lit(AROUND_POLE))), lambda x: x.isNotNull())
    return F.transform(columns, lambda x: F.struct(F.floor(lat / side).alias("y"), x.alias("x")))


def cells_around(lat: Column, lng: Column, side: float) -> Column:
    """The cells in which a place finds all others within `side` degrees of latitude: as many to the east and west as the meridians are closer."""
    polar = F.abs(lat) + 2 * side >= POLE
    wide = F.ceil(1.001 / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + side, F.lit(90.0)))), F.lit(0.001))).cast("long")
    reach, at = (wide + 2) * side, east(lng)
    ring = lambda x: F.sequence(F.floor(x / side) - wide, F.floor(x / side) + wide)
    none = F.array().cast("array<bigint>")
    rings = F.concat(ring(at), F.when(at + reach >= 180, ring(at - 360)).otherwise(none), F.when(at - reach < -180, ring(at + 360)).otherwise(none))
    columns = F.array_distinct(F.concat(F.when(F.abs(lat) < POLE, rings).otherwise(none), F.when(polar, F.array(F.lit(AROUND_POLE))).otherwise(none)))
    rows = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor(lat / side) + i)
    return F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: F.struct(y.alias("y"), x.alias("x")))))


#: Places met by an asked one in its first ring, on average; rings are added until there are no more, or this many.
MET, MOST_RINGS = 256, 12


def _rings(asked: DataFrame, places: DataFrame, miles: float, least: int) -> int:
    """How many rings, each a third of the next, leave an asked place no more than MET places in its own cell of the first one: sums of counts, without a pair."""
    sides = [miles / MILES_PER_DEGREE / 3**i for i in range(least - 1, MOST_RINGS)]
    in_cells = lambda lat, lng: F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(lat) / x).alias("y"), F.floor(east(F.col(lng)) / x).alias("x")) for i, x in enumerate(sides)))
    count = lambda df, lat, lng, name: df.select(F.explode(in_cells(lat, lng)).alias("c")).groupBy("c").agg(F.count("*").alias(name))
    met = count(asked, "lat", "lng", "a").join(count(places, "lat2", "lng2", "b"), "c").groupBy("c.i").agg((F.sum(F.col("a") * F.col("b")) / F.sum("a")).alias("met")).collect()
    crowded = [r.i for r in met if r.met > MET]
    return least + min(max(crowded, default=-1) + 1, len(sides) - 1)


def nearest(asked: DataFrame, places: DataFrame, miles: float, k: int, rings: int = 3) -> DataFrame:
    """The k places nearest to each of `asked` within some miles: id, other, miles and nth, ties to the smaller id.

    Both have id, lat and lng; an id is not its own neighbour. Cells begin at a ninth of the reach,
    or at a third of that and so on where places are dense, and are three times as wide for those
    that are not sure yet: who has k others no farther than a cell's side has looked far enough, so
    the dense middle of a town is never read by the mile.
    Copies at one place are cut to the k + 1 smallest ids before they meet anyone.
    """
    copies = Window.partitionBy("lat", "lng").orderBy("id")
    few = places.dropna(subset=["id", "lat", "lng"]).withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + 1).select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    few = checkpoint(few)  # read by every ring
    left, found = asked.dropna(subset=["id", "lat", "lng"]).select("id", "lat", "lng"), None
    rings = _rings(left, few, miles, rings)
    for ring in range(rings):
        reach = miles / 3 ** (rings - 1 - ring)
        side = reach / MILES_PER_DEGREE
        ours = left.withColumn("cell", F.explode(cells_around(F.col("lat"), F.col("lng"), side)))
        theirs = few.withColumn("cell", F.explode(own_cells(F.col("lat2"), F.col("lng2"), side)))
        met = ours.join(theirs, "cell").filter("id <> other").withColumn("miles", haversine_miles(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))).filter(F.col("miles") <= reach)
        # a place in two of the cells counts once
        once = met.groupBy("id", "other").agg(F.min("miles").alias("miles"))
        order = Window.partitionBy("id").orderBy(F.round("miles", 6), "other")
        near = once.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
        if ring < rings - 1:
            near = checkpoint(near)
            sure = near.filter(F.col("nth") == k).select("id")
            near, left = near.join(sure, "id", "left_semi"), left.join(sure, "id", "left_anti")
        found = near if found is None else found.unionByName(near)
    return found
