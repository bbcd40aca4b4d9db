"""GeoJSON features: reading one feature a line (or one collection a file), with diagnostics in place of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom.sources.collections import collection_objects

# Object types and the kinds of rows that they are.
KINDS = {
    "source": "source", "heat_network": "segment", "heat_chamber": "chamber", "oks_connection_point": "demand", "oks_future": "future", "restriction": "restriction", "oks_existing": "restriction",
}
#: How deep the coordinates of a geometry are nested.
DEPTHS = {"Point": 1, "LineString": 2, "MultiPoint": 2, "Polygon": 3, "MultiLineString": 3, "MultiPolygon": 4}


def _kind(object_type: Column) -> Column:
    out = F.when(object_type.isNotNull(), F.lit("unknown"))
    for name, kind in KINDS.items():
        out = F.when(object_type == name, F.lit(kind)).otherwise(out)
    return out


def number(text: Column) -> Column:
    """A number written with spaces, no-break spaces or a decimal comma; null where there is none."""
    return F.replace(F.translate(text, "  ", ""), F.lit(","), F.lit(".")).try_cast("double")


def parse_features(lines: DataFrame, text_col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """id (as text), id_is_number, kind, properties, geometry_type, rings, coordinates and problem of each feature text.

    rings holds the positions of each part of the geometry: one array for a point or line, one for each ring or line of the
    others; coordinates all their numbers in order. Integral numeric ids read like their text; a feature whose properties
    have no id takes its own. Texts that are no object have the problem FEATURE_PARSE; otherwise the first that holds of
    MISSING_ID, MISSING_OBJECT_TYPE, MISSING_GEOMETRY, COORD_ORDER (a longitude beyond 180 or a latitude beyond 90) and
    GEOMETRY_INVALID (a type that is unknown or nested otherwise, a line of one position, a ring that is open or has under four), or null.
    """
    got = lambda path: F.get_json_object(text_col, path)
    raw_id = F.coalesce(got("$.properties.id"), got("$.id"))
    quoted = F.coalesce(F.when(got("$.properties.id").isNotNull(), F.regexp_like(got("$.properties"), F.lit(r'"id"\s*:\s*"'))), F.regexp_like(F.regexp_replace(text_col, r'"properties"\s*:\s*\{[^{}]*\}', ""), F.lit(r'"id"\s*:\s*"')))
    code = F.translate(F.lower(F.trim(got("$.properties.object_type"))), "- ", "__")
    shape, nested = got("$.geometry.type"), F.lit(None).cast("array<array<array<double>>>")
    position = lambda kind: F.from_json(got("$.geometry.coordinates"), kind)
    for name, depth in DEPTHS.items():
        whole = position("array<" * depth + "double" + ">" * depth)
        rings = F.array(F.array(whole)) if depth == 1 else F.array(whole) if depth == 2 else whole if depth == 3 else F.flatten(whole)
        nested = F.when((shape == name) & whole.isNotNull(), rings).otherwise(nested)
    flat = F.transform(F.flatten("rings"), lambda p: F.slice(p, 1, 2))
    out = lines.select(
        *(keep or []), F.col(text_col), F.regexp_replace(raw_id, r"^(-?[0-9]+)\.0+$", "$1").alias("id"), (raw_id.isNotNull() & ~F.coalesce(quoted, F.lit(False))).alias("id_is_number"), _kind(code).alias("kind"),
        F.from_json(got("$.properties"), "map<string,string>").alias("properties"), shape.alias("geometry_type"), nested.alias("rings"),
    ).withColumn("coordinates", F.flatten(flat))
    pairs = F.transform(F.flatten("rings"), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    turned = F.exists(pairs, lambda p: (F.abs(p["x"]) > 180) | (F.abs(p["y"]) > 90))
    bad_part = lambda r: F.exists(r, lambda p: F.get(p, F.lit(1)).isNull())
    short_line = F.col("geometry_type").isin("LineString", "MultiLineString") & F.exists("rings", lambda r: F.size(r) < 2)
    open_ring = F.col("geometry_type").isin("Polygon", "MultiPolygon") & F.exists("rings", lambda r: (F.size(r) < 4) | (F.element_at(r, 1) != F.element_at(r, -1)))
    problem = (
        F.when(F.get_json_object(text_col, "$").isNull(), "FEATURE_PARSE").when(F.col("id").isNull() | (F.trim("id") == ""), "MISSING_ID").when(F.col("kind").isNull(), "MISSING_OBJECT_TYPE")
        .when(F.col("geometry_type").isNull(), "MISSING_GEOMETRY").when(turned, "COORD_ORDER")
        .when(F.col("rings").isNull() | (F.size("coordinates") == 0) | F.exists("rings", bad_part) | short_line | open_ring, "GEOMETRY_INVALID")
    )
    return out.withColumn("problem", problem).withColumn("kind", F.when(F.col("problem").isin("FEATURE_PARSE", "MISSING_ID", "MISSING_OBJECT_TYPE"), F.lit(None)).otherwise(F.col("kind"))).drop(text_col)


def checked_features(features: DataFrame) -> DataFrame:
    """Features with the problems of their kind, where their structure has none: a demand needs a flow above 0 and a point, a pipe a
    whole dn above 0 and a line, a chamber a point, a restriction its type."""
    of = lambda name: F.element_at("properties", name)
    flow, dn = number(of("flow_tph")), number(of("diameter"))
    kind, shape = F.col("kind"), F.col("geometry_type")
    named = F.coalesce(of("restriction_type"), F.when(F.translate(F.lower(F.trim(of("object_type"))), "- ", "__") == "oks_existing", "oks_existing"))
    found = (
        F.when(kind == "unknown", "UNKNOWN_OBJECT_TYPE").when((kind == "demand") & ~F.coalesce(flow > 0, F.lit(False)), "OKS_FLOW_REQUIRED").when((kind == "demand") & (shape != "Point"), "OKS_GEOMETRY")
        .when((kind == "segment") & ~F.coalesce((dn > 0) & (dn == F.floor(dn)), F.lit(False)), "NET_DIAMETER").when((kind == "segment") & ~shape.isin("LineString", "MultiLineString"), "NET_GEOMETRY")
        .when((kind == "chamber") & (shape != "Point"), "CHAMBER_GEOMETRY").when((kind == "restriction") & F.coalesce(F.trim(named) == "", F.lit(True)), "RESTRICTION_TYPE")
    )
    return features.withColumn("problem", F.coalesce("problem", found))


def read_features(spark: SparkSession, path: str, kinds: list[str] | None = None, collection: bool = False) -> DataFrame:
    """Features of the files at path; kinds keeps rows of these kinds and those with problems.

    Without `collection` the files hold a feature a line; with it each is a FeatureCollection, of any lines and any size.
    """
    if collection:
        lines = collection_objects(spark, path)
    else:
        lines = spark.read.text(path).filter(F.trim("value") != "")
    found = parse_features(lines)
    return found if kinds is None else found.filter(F.col("kind").isin(kinds) | F.col("problem").isNotNull())


def write_features(features: DataFrame, path: str, text_col: str = "feature") -> None:
    features.select(text_col).write.mode("overwrite").text(path)
