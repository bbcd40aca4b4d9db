"""Feature collections read in splits, however their lines fall: the objects of the features array, one a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipeloom.shared import staged


def _running(df: DataFrame, change: Column, out: str) -> DataFrame:
    """df with the sum of change over the fragments of its file before it: within a block of the file, and over the blocks before."""
    df = df.withColumn("_c", change)
    inner = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy("file", "block").agg(F.sum("_c").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = df.withColumn("_i", F.coalesce(F.sum("_c").over(inner), F.lit(0))).join(blocks.select("file", "block", before.alias("_b")), ["file", "block"])
    return summed.withColumn(out, F.col("_i") + F.col("_b")).drop("_c", "_i", "_b")


def collection_objects(spark: SparkSession, path: str) -> DataFrame:
    """(value): the JSON text of every object in the features arrays of the collections at path.

    Files are read by Spark's text source in fragments that end at closing braces, so any number of tasks share one file, of one line too. Running
    counts of quotes tell which braces stand in strings, running counts of the others how deep a fragment lies; a feature is what lies between
    two returns to the depth of the array. A task sorts the counts of one block of a file; a feature is put together in one
    row. Other members of a collection are left out, and so is what a broken file ends with; names of members before the features hold no braces, and
    no other member is an array of objects.
    """
    read = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    read = staged(read, "fragments")
    pieces = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    opens = lambda odd: F.aggregate(F.filter(pieces, lambda p, i: i % 2 == odd), F.lit(0), lambda n, p: n + F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))))
    counts = staged(read.select("file", "block", "id", (F.size(pieces) - 1).alias("quotes"), opens(0).alias("open0"), opens(1).alias("open1")), "counts")
    counts = _running(counts, F.col("quotes"), "q")
    within = F.col("q") % 2 == 1
    shut = F.when((F.col("q") + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    counts = counts.select("file", "block", "id", F.when(within, F.col("open1")).otherwise(F.col("open0")).alias("opened"), shut.alias("shut"))
    counts = _running(staged(counts, "braces"), F.col("opened") - F.col("shut"), "depth")
    ends = (F.col("shut") == 1) & (F.col("depth") + F.col("opened") == 2)
    over = (F.col("shut") == 1) & (F.col("depth") + F.col("opened") <= 2)  # a feature's end, or its collection's
    counts = staged(counts.select("file", "block", "id", "depth", ends.cast("int").alias("ends"), over.cast("int").alias("over")), "depths")
    counts = _running(counts, F.col("over"), "feature")
    whole = read.join(counts.select("file", "block", "id", "depth", "ends", "feature"), ["file", "block", "id"])
    parts = whole.groupBy("file", "feature").agg(F.sort_array(F.collect_list(F.struct("block", "id", "value", "depth"))).alias("f"), F.max("ends").alias("ends")).filter("ends = 1")
    text = F.concat(F.array_join(F.transform("f", lambda p: p["value"]), "}"), F.lit("}"))
    lead = F.when(F.element_at("f", 1)["depth"] == 0, F.regexp_extract(text, r"(?s)\A([^{]*\{[^{]*)", 1)).otherwise(F.regexp_extract(text, r"(?s)\A([^{]*)", 1))
    found = parts.select(text.alias("text"), lead.alias("lead")).filter(F.rtrim(F.regexp_replace("lead", r"\s+\z", "")).rlike(r"[\[,]\z"))
    return found.select(F.expr("substring(text, length(lead) + 1)").alias("value"))
