"""Point in polygon by even-odd counting, as column expressions over nested arrays ([lon, lat] rings, holes after the outer one).

Points find their features through a cover of grid cells. A feature's cells have the power of two of its size that
gives at most 17 cells a side; cells that no edge passes through are wholly inside or outside, so inside ones decide at
once, and only points in cells with edges run the ray test. Points meet cells in an equi-join, once for each cell size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import staging


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a ray from the point crosses the ring's edges an odd number of times; under three points nothing is inside."""
    following = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, following, lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > lat) != (e["y2"] > lat)
        at = F.try_divide((e["x2"] - e["x1"]) * (lat - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return F.coalesce(spans & (lon < at), F.lit(False))

    return (F.size(ring) >= 3) & (F.size(F.filter(edges, crosses)) % 2 == 1)


def in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    """Inside the outer ring and in no hole."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(lon, lat, F.try_element_at(rings, F.lit(1))) & ~F.exists(holes, lambda h: in_ring(lon, lat, h))


CELLS = 16


def _cells(low: Column, high: Column, side: Column) -> Column:
    """Numbers of the half-open cells that the closed interval touches; exact, since sides are powers of two."""
    return F.sequence(F.floor(low / side), F.floor(high / side))


def _edges(features: DataFrame) -> DataFrame:
    """One row per edge of each ring: fid, side, x1, y1, x2, y2; rings are closed here."""
    rings = features.select("fid", "side", F.explode(F.flatten("polygons")).alias("ring")).where("size(ring) > 0")
    following = F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", 1, 1))
    pairs = F.zip_with("ring", following, lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    return rings.select("fid", "side", F.explode(pairs).alias("e")).select("fid", "side", "e.*")


def cover(features: DataFrame) -> DataFrame:
    """fid, level, cx, cy, inner: the cells of each feature (fid, level, side, polygons, box) that hold any of its points.

    An edge is taken to touch all cells of its own bounding box, which can only make more cells run the ray test.
    """
    box = features.select("fid", "level", "side", F.explode(_cells(F.col("x0"), F.col("x1"), F.col("side"))).alias("cx"), "y0", "y1")
    box = box.select("fid", "level", "side", "cx", F.explode(_cells(F.col("y0"), F.col("y1"), F.col("side"))).alias("cy"))
    e = _edges(features)
    touched = e.select("fid", "side", F.explode(_cells(F.least("x1", "x2"), F.greatest("x1", "x2"), F.col("side"))).alias("cx"), "y1", "y2")
    touched = touched.select("fid", "cx", F.explode(_cells(F.least("y1", "y2"), F.greatest("y1", "y2"), F.col("side"))).alias("cy")).distinct()
    marked = box.join(touched.withColumn("edge", F.lit(True)), ["fid", "cx", "cy"], "left")
    free = marked.where("edge IS NULL").join(features.select("fid", "polygons"), "fid")
    middle = [(F.col(c) + 0.5) * F.col("side") for c in ("cx", "cy")]
    inside = free.where(F.exists("polygons", lambda rings: in_polygon(*middle, rings)))
    kept = lambda df, inner: df.select("fid", "level", "cx", "cy", F.lit(inner).alias("inner"))
    return kept(marked.where("edge"), False).unionByName(kept(inside, True))


def locate(points: DataFrame, features: DataFrame, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with `bucket`, the name of the first feature (priority, name, polygons) that holds the point; null if none does or a coordinate is null.

    A feature is an array of polygons (one for a plain polygon). Cell sizes in use are few: the sizes of features to the power of two.
    """
    flat = F.flatten(F.flatten("polygons"))
    corner = lambda i, f: f(F.transform(flat, lambda p: p[i]))
    boxed = features.withColumns({"x0": corner(0, F.array_min), "x1": corner(0, F.array_max), "y0": corner(1, F.array_min), "y1": corner(1, F.array_max)}).where("x0 IS NOT NULL")
    widest = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    boxed = boxed.withColumn("level", F.when(widest > 0, F.ceil(F.log2(widest / CELLS))).otherwise(0).cast("int")).withColumn("side", F.pow(F.lit(2.0), F.col("level")))
    kept = staging.staged(boxed.withColumn("fid", F.monotonically_increasing_id()), "features")
    levels = sorted(r[0] for r in kept.select("level").distinct().collect())  # as many as there are powers of two of sizes
    if not levels:
        return points.withColumn("bucket", F.lit(None).cast("string"))
    cells = cover(kept)
    at = points.select(key, lon, lat, F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.floor(F.col(lon) / 2.0**n).alias("cx"), F.floor(F.col(lat) / 2.0**n).alias("cy")) for n in levels))).alias("c"))
    near = at.select(key, lon, lat, "c.*").join(cells, ["level", "cx", "cy"]).select(key, lon, lat, "fid", "inner")
    x, y = F.col(lon), F.col(lat)
    tested = near.where("NOT inner").join(kept.select("fid", "polygons"), "fid").where(F.exists("polygons", lambda rings: in_polygon(x, y, rings)))
    hits = near.where("inner").select(key, "fid").unionByName(tested.select(key, "fid")).join(kept.select("fid", "priority", "name"), "fid")
    return points.join(hits.groupBy(key).agg(F.min_by("name", "priority").alias("bucket")), key, "left")
