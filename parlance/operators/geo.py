"""C11 (re-aimed) nearest place within a radius, as an exact bucketed equi-join.

Each place is replicated into every grid cell its radius can reach (latitude span = r, longitude span
= asin(sin r / cos φ), the exact spherical bounding box; everything near a pole gets all longitudes);
each point falls in one cell.  The equi-join on the cell yields only nearby candidates, the haversine
filter keeps those within the radius, and the nearest one wins (ties → smaller place id).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dphi / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(dl / 2) ** 2
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_sql(lat1, lon1, lat2, lon2) -> str:
    return (f"2 * {EARTH_RADIUS_KM} * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))")


def nearest_place(points: DataFrame, places: DataFrame, radius_km: float, cell_deg: float = 5.0) -> DataFrame:
    """``points``: (pid, lat, lon); ``places``: (place_id, lat, lon).  Returns (pid, place_id, distance_km)."""
    r = radius_km / EARTH_RADIUS_KM
    dlat = math.degrees(r)
    n_lon = int(math.ceil(360.0 / cell_deg))
    cos_phi = F.cos(F.radians(F.col("lat")))
    dlon = F.when(cos_phi > math.sin(r), F.degrees(F.asin(F.lit(math.sin(r)) / cos_phi))).otherwise(F.lit(180.0))
    lat_cells = F.sequence(F.floor((F.col("lat") - dlat + 90) / cell_deg).cast("int"),
                           F.floor((F.col("lat") + dlat + 90) / cell_deg).cast("int"))
    lon_cells = F.sequence(F.floor((F.col("lon") - dlon + 180) / cell_deg).cast("int"),
                           F.floor((F.col("lon") + dlon + 180) / cell_deg).cast("int"))
    spread = (places.select("place_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"),
                            F.explode(lat_cells).alias("clat"), lon_cells.alias("_lons"))
              .select("place_id", "plat", "plon", "clat", F.explode("_lons").alias("_clon"))
              .select("place_id", "plat", "plon", "clat", F.pmod("_clon", F.lit(n_lon)).alias("clon"))
              .dropDuplicates(["place_id", "clat", "clon"]))
    pts = points.select("pid", "lat", "lon", F.floor((F.col("lat") + 90) / cell_deg).cast("int").alias("clat"),
                        F.pmod(F.floor((F.col("lon") + 180) / cell_deg).cast("int"), F.lit(n_lon)).alias("clon"))
    cand = pts.join(spread, ["clat", "clon"]).withColumn(
        "distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")))
    near = cand.where(F.col("distance_km") <= radius_km)
    w = Window.partitionBy("pid").orderBy("distance_km", "place_id")
    return near.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("pid", "place_id", "distance_km")
