"""Places on the ground: geoid heights, sun windows, control points along outlines, survey catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.functions import geodesy, rings
from cadastre.operators.clouds import cloud_stats


def geoid_reduce(points: DataFrame, grid: DataFrame, step: float) -> DataFrame:
    """points(id, lon, lat, h) with ``n``, the geoid's height by bilinear interpolation of grid(gx, gy, n), and ``height`` = h - n.

    grid holds multiples of ``step`` degrees: lon = gx * step, lat = gy * step.
    A point whose cell lacks a corner has null.
    """
    cell = points.withColumns({"gx": F.floor(F.col("lon") / step), "gy": F.floor(F.col("lat") / step)})
    for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
        cell = cell.join(grid.select((F.col("gx") - i).alias("gx"), (F.col("gy") - j).alias("gy"), F.col("n").alias(f"n{i}{j}")), ["gx", "gy"], "left")
    u, v = F.col("lon") / step - F.col("gx"), F.col("lat") / step - F.col("gy")
    n = (1 - u) * (1 - v) * F.col("n00") + u * (1 - v) * F.col("n10") + (1 - u) * v * F.col("n01") + u * v * F.col("n11")
    return cell.withColumn("n", n).withColumn("height", F.col("h") - F.col("n")).drop("gx", "gy", "n00", "n10", "n01", "n11")


def sun_windows(sites: DataFrame, minutes: int, low: float, high: float, az_from: float = 0.0, az_to: float = 360.0) -> DataFrame:
    """(id, begins, ends, samples): unbroken runs of samples of sites(id, lon, lat, since, until) with the sun's altitude from low to high and its azimuth in the given arc, which may pass north."""
    # Sites are dealt by id before they become many rows, so samples are computed in all tasks and stay where their runs are counted.
    parts = max(int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")), sites.sparkSession.sparkContext.defaultParallelism)
    rows = sites.repartition(parts, "id").select("id", "lon", "lat", F.posexplode(F.sequence("since", "until", F.expr(f"interval {minutes} minutes"))).alias("k", "ts"))
    rows = geodesy.with_sun(rows)
    inside = F.col("azimuth").between(az_from, az_to) if az_from <= az_to else (F.col("azimuth") >= az_from) | (F.col("azimuth") <= az_to)
    good = rows.where(F.col("altitude").between(low, high) & inside)
    run = F.col("k") - F.row_number().over(Window.partitionBy("id").orderBy("k"))
    return good.withColumn("run", run).groupBy("id", "run").agg(F.min("ts").alias("begins"), F.max("ts").alias("ends"), F.count("*").alias("samples")).drop("run")


def aoi_edge_points(parcels: DataFrame, n: int | Column) -> DataFrame:
    """(id, k, x, y, role): n points (a number or a column) evenly along each ring of parcels(id, ring), from its first corner; the first four are corner points."""
    parcels = parcels.withColumn("n", n if isinstance(n, Column) else F.lit(n))
    n = F.col("n")
    edges = parcels.select("id", "n", F.posexplode(rings.edges(F.col("ring"))).alias("seq", "e"))
    edges = edges.select("id", "n", "seq", "e.a", "e.b", F.hypot(F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y")).alias("length"))
    by = Window.partitionBy("id")
    edges = edges.withColumns({"until": F.sum("length").over(by.orderBy("seq")), "whole": F.sum("length").over(by)})
    first = lambda at: F.when(at <= 0, F.lit(0)).otherwise(F.floor(at * n / F.col("whole")) + 1)  # noqa: E731  of the targets beyond a place
    own = edges.withColumns({"since": F.col("until") - F.col("length")}).withColumns({"lo": F.when(F.col("seq") == 0, F.lit(0)).otherwise(first(F.col("since"))), "hi": F.least(F.floor(F.col("until") * n / F.col("whole")), n - 1)})
    placed = own.where("lo <= hi").select("id", "n", "a", "b", "length", "since", "whole", F.explode(F.sequence("lo", "hi")).alias("k"))
    t = (F.col("k") * F.col("whole") / n - F.col("since")) / F.greatest("length", F.lit(1e-9))
    return placed.select("id", "k", (F.col("a.x") + t * (F.col("b.x") - F.col("a.x"))).alias("x"), (F.col("a.y") + t * (F.col("b.y") - F.col("a.y"))).alias("y"), F.when(F.col("k") < 4, "corner").otherwise("edge_mid").alias("role"))


def aoi_interior_points(parcels: DataFrame, n: int | Column) -> DataFrame:
    """(id, k, x, y): the first n points inside parcels(id, ring) of a grid over its box with about n points, row by row from the south west.

    The grid's columns and rows follow the box's sides; concave rings have fewer
    points than n, and so may thin ones. None for n of zero or less or a ring without an extent.
    """
    x0, y0, x1, y1 = rings.bounds(F.col("ring"))
    boxes = parcels.select("id", "ring", (n if isinstance(n, Column) else F.lit(n)).cast("int").alias("n"), x0.alias("x0"), y0.alias("y0"), (x1 - x0).alias("w"), (y1 - y0).alias("h")).where("n > 0 and w > 0 and h > 0")
    boxes = boxes.withColumn("nx", F.greatest(F.lit(1), F.bround(F.sqrt(F.col("n") * F.col("w") / F.col("h"))).cast("int")))
    boxes = boxes.withColumn("ny", F.greatest(F.lit(1), F.bround(F.col("n") / F.col("nx")).cast("int")))

    def row(j: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.col("nx")), lambda i: F.struct((F.col("x0") + F.col("w") * i / (F.col("nx") + 1)).alias("x"), (F.col("y0") + F.col("h") * j / (F.col("ny") + 1)).alias("y")))

    inside = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.col("ny")), row)), lambda p: rings.contains(F.col("ring"), p["x"], p["y"]))
    return boxes.select("id", F.posexplode(F.slice(inside, F.lit(1), F.col("n"))).alias("k", "p")).select("id", "k", "p.x", "p.y")


#: Square metres of an acre.
ACRE = 4046.8564224


def plan_control(parcels: DataFrame, rmse: float, most: int = 64) -> DataFrame:
    """(id, k, x, y, role): ground control for parcels(id, ring) in metres, ``rmse`` metres being the error allowed.

    A point for every 5 acres at an error of 0.05, in proportion at others, but
    for 2 acres at least and 80 at most; at least 4 points and no more than
    ``most``. Three in five, at least 4, lie on the ring, the others inside it,
    numbered after them.
    """
    acres = F.abs(rings.signed_area(rings.closed(F.col("ring")))) / ACRE
    count = F.least(F.lit(most), F.greatest(F.lit(4), F.ceil(acres / min(80.0, max(2.0, 100 * max(0.005, rmse))))))
    sized = parcels.select("id", rings.closed(F.col("ring")).alias("ring"), count.cast("int").alias("count"))
    sized = sized.withColumn("on_ring", F.greatest(F.lit(4), F.bround(F.col("count") * 0.6).cast("int")))
    inside = aoi_interior_points(sized, F.col("count") - F.col("on_ring")).join(sized.select("id", "on_ring"), "id")
    inside = inside.select("id", (F.col("k") + F.col("on_ring")).cast("long").alias("k"), "x", "y", F.lit("interior").alias("role"))
    return aoi_edge_points(sized, F.col("on_ring")).withColumn("k", F.col("k").cast("long")).unionByName(inside)


def shot_sequence(shots: DataFrame, prefix: str = "S") -> DataFrame:
    """shots(file, line_no, ..) with ``shot_id``: prefix and running number within the file, at least four digits."""
    number = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    return shots.withColumn("shot_id", F.concat(F.lit(prefix), F.when(number < 10_000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))))


def order_features(features: DataFrame) -> DataFrame:
    """features(file, code, number, points array) with ``place``: by their first point number, then code, within the file."""
    return features.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy(F.array_min("points"), "code", "number")))


def survey_rollup(projects: DataFrame, surveys: DataFrame, parcels: DataFrame) -> DataFrame:
    """(project, name, surveys, parcels, area): projects(project, name) with what surveys(survey, project) and parcels(parcel, survey, area) they hold; empty ones too."""
    own = surveys.join(parcels, "survey", "left").groupBy("project").agg(F.countDistinct("survey").alias("surveys"), F.count("parcel").alias("parcels"), F.sum("area").alias("area"))
    return projects.join(own, "project", "left").select("project", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("surveys", "parcels")], F.coalesce("area", F.lit(0.0)).alias("area"))


def register_clouds(points: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue rows (cloud, n, min_x .. max_z) of the clouds in points that catalogue(cloud) doesn't have yet."""
    own = cloud_stats(points).where("classification is null").drop("classification")
    return own.join(catalogue.select("cloud"), "cloud", "left_anti")


def curve_table_csv(curves: DataFrame) -> DataFrame:
    """(label, line): curves(label, radius, delta, arc, chord, tangent) as comma-separated text, lengths to four digits and the angle in degrees, minutes and seconds; ready for a text sink."""
    seconds = F.round(F.degrees("delta") * 3600, 2)
    whole = F.floor(seconds)
    dms = F.format_string("%d°%02d'%05.2f\"", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60.0)))
    text = F.concat_ws(",", "label", F.format_string("%.4f", "radius"), dms, *[F.format_string("%.4f", c) for c in ("arc", "chord", "tangent")])
    return curves.select("label", text.alias("line"))


def verify_inputs(manifests: DataFrame, attested: DataFrame) -> DataFrame:
    """(root, hash, problem): entries of manifests(root, hash) that attested(root, hash) lacks (added), or the other way round (missing)."""
    return manifests.exceptAll(attested).withColumn("problem", F.lit("added")).unionByName(attested.exceptAll(manifests).withColumn("problem", F.lit("missing")))


def scan_geojson(files: DataFrame) -> DataFrame:
    """(file, pos, name, epsg, ring): polygons of files(file, text), FeatureCollections or single Features; rings closed, counter-clockwise.

    Other geometries are skipped; without a crs member EPSG is 4326, without a name the feature is "Parcel i".
    """
    from cadastre.functions import rings

    feature = "struct<geometry: struct<type: string, coordinates: array<array<array<double>>>>, properties: map<string, string>>"
    whole = F.from_json("text", f"type string, crs struct<properties: struct<name: string>>, features array<{feature}>, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties map<string, string>")
    rows = files.select("file", whole.alias("w")).select("file", F.coalesce(F.regexp_extract("w.crs.properties.name", r"(\d+)$", 1).try_cast("int"), F.lit(4326)).alias("epsg"), F.posexplode(F.when(F.col("w.type") == "Feature", F.array(F.struct("w.geometry", "w.properties"))).otherwise(F.col("w.features"))).alias("pos", "f"))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rows = rows.where("f.geometry.type = 'Polygon'").select("file", "pos", F.coalesce(F.element_at("f.properties", F.lit("name")), F.concat(F.lit("Parcel "), F.col("pos") + 1)).alias("name"), "epsg", rings.closed(ring).alias("ring"))
    return rows.withColumn("ring", rings.oriented(F.col("ring")))
