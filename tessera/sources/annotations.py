"""Annotation files: polygons of GeoJSON feature collections, and which raster each file belongs to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.operators import spatial
from tessera.sources import json_parts

_FEATURE = "properties struct<classification: string>, geometry struct<type: string, coordinates: string>"
_FEATURES = f"features array<struct<{_FEATURE.replace(' struct<', ': struct<')}>>"
_POLYGON = "array<array<array<double>>>"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the files right in the folder; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(f"{folder.rstrip('/')}/*").select("path")


def pair_files(paths: DataFrame, raster: str = ".svs", annotation: str = ".geojson") -> tuple[DataFrame, DataFrame]:
    """(wsi_id, raster, annot) of each raster with an annotation of the same stem, and (wsi_id) of rasters without one.

    Endings match in any case. A file with `pred` anywhere in its name is no annotation."""
    name = F.element_at(F.split("path", "/"), -1)
    named = paths.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("wsi_id"))
    low = F.lower("name")
    rasters = named.filter(low.endswith(raster)).select("wsi_id", F.col("path").alias("raster"))
    annots = named.filter(low.endswith(annotation) & ~low.contains("pred")).select("wsi_id", F.col("path").alias("annot"))
    return rasters.join(annots, "wsi_id"), rasters.join(annots, "wsi_id", "left_anti").select("wsi_id")


def parse_features(collections: DataFrame, key: str, text: str, name: Callable[[Column], Column] = spatial.extract_label) -> DataFrame:
    """(key, feature, cls, rings, area), cls by that rule of names, of each Polygon or MultiPolygon in the GeoJSON texts. Text that is no feature
    collection, and features of another kind, give no rows. Rings of all parts stand in one list; area counts holes off."""
    parsed = collections.select(key, F.from_json(F.col(text), _FEATURES).alias("j"))
    return _polygons(parsed.select(key, F.posexplode("j.features").alias("feature", "f")), key, name)


def _polygons(flat: DataFrame, key: str, name: Callable[[Column], Column]) -> DataFrame:
    """parse_features of rows (key, feature, f), f a feature."""
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(raw, _POLYGON))).when(kind == "MultiPolygon", F.from_json(raw, f"array<{_POLYGON}>"))
    flat = flat.select(key, "feature", name(F.col("f.properties.classification")).alias("cls"), parts.alias("parts")).filter("parts IS NOT NULL AND parts[0] IS NOT NULL")

    def ring(points: Column) -> Column:
        return F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))

    flat = flat.withColumn("parts", F.transform("parts", lambda part: F.transform(part, ring)))
    area = F.aggregate("parts", F.lit(0.0), lambda a, part: a + spatial.area(part))
    return flat.select(key, "feature", "cls", F.flatten("parts").alias("rings"), area.alias("area"))


def read_geojson(spark: SparkSession, path: str, stretch: int = json_parts.STRETCH, name: Callable[[Column], Column] = spatial.extract_label) -> DataFrame:
    """parse_features of the files under path, keyed by file; a file of more bytes than a stretch is read by several tasks."""
    items = json_parts.list_items(spark, path, stretch)
    flat = items.select("file", F.col("item").cast("int").alias("feature"), F.from_json("json", _FEATURE).alias("f"))
    return _polygons(flat, "file", name)


def class_counts(spark: SparkSession, folder: str, out: str | None = None, patch: int = config.PATCH) -> tuple[DataFrame, DataFrame] | tuple[None, None]:
    """(global, per slide) counts of the annotation files right in the folder, or (None, None) if there are none: polygons
    and their area in patches, by class and by slide and class, and the classes' share of all patches in percent.

    Unlike pair_files, the ending has to be in small letters. With out, both are written there as CSV."""
    paths = list_files(spark, folder).filter(F.col("path").endswith(".geojson") & ~F.lower(F.element_at(F.split("path", "/"), -1)).contains("pred"))
    names = [r.path for r in paths.collect()]  # files
    if not names:
        return None, None
    each = read_geojson(spark, names, name=spatial.extract_label_for_counts).withColumn("slide", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", ""))
    each = each.select("slide", F.col("cls").alias("class"), (F.col("area") / patch**2).alias("patches"))
    per_slide = each.groupBy("slide", "class").agg(F.count("*").alias("polygons"), F.sum("patches").alias("patches"))
    whole = each.groupBy("class").agg(F.count("*").alias("polygons"), F.sum("patches").alias("patches"))
    whole = whole.withColumn("pct", 100 * F.col("patches") / F.sum("patches").over(Window.partitionBy()))  # a row for each class
    if out:
        for name, df in (("class_balance_global", whole), ("class_balance_per_slide", per_slide)):
            df.write.mode("overwrite").option("header", "true").csv(f"{out.rstrip('/')}/{name}")
    return whole, per_slide
