"""A square grid of cells on the ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SeriesSpec

# A box of latitude and longitude, the earth's mean radius, compass points, landmarks and the load that each should have beside its neighbours.
SOUTH, NORTH, WEST, EAST = 45.356261, 45.568161, 9.011533, 9.312688
RADIUS_M = 6371008.8
POINTS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]

LANDMARKS = [
    ("Linate airport", 45.4451, 9.2767, "max"),
    ("San Siro stadium", 45.4781, 9.1240, "max"),
    ("Milano Centrale", 45.4869, 9.2050, "max"),
    ("Duomo", 45.4642, 9.1900, None),
    ("Idroscalo lake", 45.4600, 9.2900, "min"),
    ("Parco Sud farmland", 45.3900, 9.1900, "min"),
    ("Sesto San Giovanni", 45.5300, 9.2400, "max"),
]


def centroid(row: Column, col: Column, side: int, north_first: bool = False) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre; rows count from the south unless north_first."""
    up = (row + 0.5) / side
    lat = NORTH - up * (NORTH - SOUTH) if north_first else SOUTH + up * (NORTH - SOUTH)
    return lat, WEST + (col + 0.5) / side * (EAST - WEST)


def cell_of(lat: Column, lon: Column, side: int, north_first: bool = False) -> tuple[Column, Column]:
    """Row and column that hold a point; null outside the box."""
    share = (NORTH - lat if north_first else lat - SOUTH) / (NORTH - SOUTH)
    row, col = F.floor(share * side), F.floor((lon - WEST) / (EAST - WEST) * side)
    inside = row.between(0, side - 1) & col.between(0, side - 1)
    return F.when(inside, row), F.when(inside, col)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in POINTS]), (F.floor(degrees / 22.5 + 0.5) % 16 + 1).cast("int"))


def neighbours(grid: DataFrame, k: int, spec: SeriesSpec) -> DataFrame:
    """Each cell with every cell of its clipped block: an equi-join on shifted places."""
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in range(-k, k + 1) for c in range(-k, k + 1)])
    at = grid.select("series_id", "row", "col", "total", F.explode(steps).alias("s")).withColumn("nrow", F.col("row") + F.col("s.dr")).withColumn("ncol", F.col("col") + F.col("s.dc"))
    there = grid.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("total").alias("ntotal"))
    return at.join(there, ["nrow", "ncol"]).select("series_id", "row", "col", "total", F.col("s.dr").alias("dr"), F.col("s.dc").alias("dc"), "ntotal")


def neighbourhood_ratio(grid: DataFrame, k: int, spec: SeriesSpec) -> DataFrame:
    return neighbours(grid, k, spec).groupBy("series_id", "row", "col", "total").agg(F.median("ntotal").alias("middle")).withColumn("ratio", F.try_divide("total", "middle"))


def row_bands(grid: DataFrame, band: int, spec: SeriesSpec) -> DataFrame:
    """(band, share, lat_from, lat_to): how much of all lies in bands of `band` rows, which must fit the grid."""
    if spec.side % band:
        raise ValueError(f"{spec.side} rows can't be cut into bands of {band}")
    total = F.sum("s").over(Window.partitionBy())  # a row a band
    b = grid.groupBy(F.floor(F.col("row") / band).alias("band")).agg(F.sum("total").alias("s"))
    lat = lambda k: SOUTH + k * band / spec.side * (NORTH - SOUTH)
    return b.select("band", F.try_divide(F.col("s"), total).alias("share"), lat(F.col("band")).alias("lat_from"), lat(F.col("band") + 1).alias("lat_to"))


def zoom_box(shown: DataFrame, pad: int, spec: SeriesSpec) -> DataFrame:
    """One row (row_from, row_to, col_from, col_to): a square about the shown cells, `pad` cells wider on each side and cut at the grid's edge."""
    ends = shown.agg(F.max("row").alias("r1"), F.min("row").alias("r0"), F.max("col").alias("c1"), F.min("col").alias("c0"))
    half = F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")) / 2 + pad
    low = lambda a, b: F.greatest(F.lit(0), F.floor((F.col(a) + F.col(b)) / 2 - half))
    high = lambda a, b: F.least(F.lit(spec.side - 1), F.ceil((F.col(a) + F.col(b)) / 2 + half))
    return F.broadcast(ends.select(low("r0", "r1").alias("row_from"), high("r0", "r1").alias("row_to"), low("c0", "c1").alias("col_from"), high("c0", "c1").alias("col_to")))


def best_neighbours(grid: DataFrame, search: int, k: int, spec: SeriesSpec, most: bool = True) -> DataFrame:
    """(series_id, row, col, dr, dc, best): the most extreme cell within `search`, by its ratio to its own block; of equal ones the first in scan order. Cells whose block has the median 0 don't count."""
    r = neighbourhood_ratio(grid, k, spec).filter("ratio is not null").select("series_id", "row", "col", F.round("ratio", 9).alias("total"))
    at = grid.select("series_id", "row", "col", F.lit(0.0).alias("total"))
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-search, search + 1) for b in range(-search, search + 1)])
    near = at.select("series_id", "row", "col", F.explode(steps).alias("s")).select("series_id", "row", "col", "s.*", (F.col("row") + F.col("s.dr")).alias("nrow"), (F.col("col") + F.col("s.dc")).alias("ncol"))
    met = near.join(r.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("total").alias("ratio")), ["nrow", "ncol"])
    rank = F.struct((F.col("ratio") if most else -F.col("ratio")).alias("x"), (-F.col("dr")).alias("r"), (-F.col("dc")).alias("c"))
    top = met.groupBy("series_id", "row", "col").agg(F.max_by(F.struct("dr", "dc", "ratio"), rank).alias("t"))
    return top.select("series_id", "row", "col", "t.dr", "t.dc", F.col("t.ratio").alias("best"))


def step_compass(row: Column, col: Column, dr: Column, dc: Column, side: int) -> Column:
    """Compass point of a step of a few cells; null for none."""
    point = compass(bearing(*centroid(row, col, side), *centroid(row + dr, col + dc, side)))
    return F.when((dr != 0) | (dc != 0), point)
