"""Services' raw JSON payloads as rows, read as VARIANT: shapes are told apart by run-time types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each service's list of results, and what it takes for success.
SERVICES = {"layout": ("regions", True), "paddle": ("details", True), "tesseract": ("boxes", False)}


def is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def box(raw: Column) -> Column:
    """[left, upper, right, lower] of four scalars or of a list of points, by the type of its first element; empty else.

    Points of fewer than two numbers are passed over. Numbers may be written as strings.
    """
    first = F.try_variant_get(raw, "$[0]", "variant")
    scalars = F.try_variant_get(raw, "$", "array<double>")
    points = F.filter(F.coalesce(F.try_variant_get(raw, "$", "array<array<double>>"), F.expr("cast(array() as array<array<double>>)")), lambda p: F.coalesce(F.size(p) >= 2, F.lit(False)))
    axis = lambda i: F.transform(points, lambda p: p[i])
    polygon = F.array(F.array_min(axis(0)), F.array_min(axis(1)), F.array_max(axis(0)), F.array_max(axis(1)))
    none = F.expr("cast(array() as array<double>)")
    return F.when(is_list(raw) & ~is_list(first), F.when((F.size(scalars) == 4) & ~F.exists(scalars, F.isnull), scalars)).when(is_list(raw), F.when(F.size(points) > 0, polygon)).otherwise(none)


def results(payloads: DataFrame, service: str, key: list[str]) -> DataFrame:
    """(key, payload) -> key, pos, value (VARIANT), error: a row for each result, or one with the payload's error.

    A payload that is no JSON object, says that it failed (or doesn't say that it succeeded,
    where the service must) or whose results are no list is an error; one without results gives no row.
    """
    name, must = SERVICES[service]
    v = F.try_parse_json(F.col("payload"))
    rows = payloads.select(*key, v.alias("_v"))
    said = F.try_variant_get(F.col("_v"), "$.success", "boolean")
    held = F.try_variant_get(F.col("_v"), f"$.{name}", "variant")
    empty = held.isNull() | F.is_variant_null(held)
    failed = ~F.coalesce(said, F.lit(False)) if must else F.lit(False)
    error = F.when(~is_object(F.col("_v")), "malformed").when(failed, "failed").when(~empty & ~is_list(held), "malformed")
    rows = rows.withColumns({"error": error, "_list": held})
    bad = rows.filter("error is not null").select(*key, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("variant").alias("value"), "error")
    good = rows.filter("error is null").select(*key, "_list")
    each = good.lateralJoin(good.sparkSession.tvf.variant_explode(F.col("_list").outer())).select(*key, "pos", "value", F.lit(None).cast("string").alias("error"))
    return bad.unionByName(each)


def regions(payloads: DataFrame, key: list[str]) -> DataFrame:
    """Layout payloads to key, pos, label, score, x0, y0, x1, y1 (pixels) and error, one row a region.

    A region's coordinates may be four scalars or a polygon, its score may stand under `prob`, and
    its label is `text` where it is missing or empty. A region without usable coordinates is an
    error row of its own.
    """
    rows = results(payloads, "layout", key)
    value = lambda path, kind: F.try_variant_get(F.col("value"), path, kind)
    some = lambda c, empty: F.nullif(c, F.lit(empty))
    label = F.coalesce(some(value("$.label", "string"), ""), some(value("$.type", "string"), ""), F.lit("text"))
    score = F.coalesce(some(value("$.score", "double"), 0.0), some(value("$.prob", "double"), 0.0), F.lit(0.0))
    rows = rows.withColumn("_b", box(value("$.coordinate", "variant")))
    own = F.when(~is_object(F.col("value")), "malformed").when(F.coalesce(F.size("_b"), F.lit(0)) != 4, "no coordinates")
    rows = rows.withColumn("error", F.coalesce("error", own))
    fine = F.col("error").isNull()
    return rows.select(*key, "pos", F.when(fine, label).alias("label"), F.when(fine, score).alias("score"), *[F.when(fine, F.get("_b", i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], "error")


def lines(payloads: DataFrame, service: str, key: list[str]) -> DataFrame:
    """Recognisers' payloads to key, pos, text, confidence, x0, y0, x1, y1 (pixels) and error, one row a text.

    `paddle` gives polygons of at least four points under `bbox` and a confidence; `tesseract`
    gives x, y, w, h and none. Texts that are missing or empty, and boxes without extent, are no rows.
    """
    rows = results(payloads, service, key)
    value = lambda path, kind: F.try_variant_get(F.col("value"), path, kind)
    text = F.coalesce(value("$.text", "string"), F.lit(""))
    if service == "paddle":
        polygon = value("$.bbox", "variant")
        found = F.when(F.size(F.try_variant_get(polygon, "$", "array<variant>")) >= 4, box(polygon))
    else:
        x, y, w, h = (value(f"$.{k}", "double") for k in "xywh")
        found = F.when((w > 0) & (h > 0), F.array(x, y, x + w, y + h))
    rows = rows.withColumns({"text": text, "_b": found, "confidence": F.coalesce(value("$.confidence", "double"), F.lit(0.0))})
    rows = rows.filter((F.col("error").isNotNull()) | ((F.col("text") != "") & (F.size("_b") == 4)))
    fine = F.col("error").isNull()
    return rows.select(*key, "pos", F.when(fine, F.col("text")).alias("text"), F.when(fine, F.col("confidence")).alias("confidence"), *[F.when(fine, F.get("_b", i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], "error")
