"""Trees of report files in JSON, one object a file, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_reports(spark: SparkSession, root: str, schema: str, name: str = "report.json") -> DataFrame:
    """Files called `name` anywhere below root: columns run (the folder that holds the file), path and modified_at, and those
    of schema. What a report lacks is null, and `is_broken` tells that it is no JSON; a broken one never fails the job. The
    schema is given, so that no pass over the files is needed to guess it."""
    reader = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True).option("pathGlobFilter", name)
    path = F.col("_metadata.file_path")
    rows = reader.json(root).withColumns({"run": F.element_at(F.split(path, "/"), -2), "path": path, "modified_at": F.col("_metadata.file_modification_time")})
    return rows.withColumn("is_broken", F.col("_broken").isNotNull()).drop("_broken")


def latest_reports(reports: DataFrame, key: str = "run") -> DataFrame:
    """Of each key the report changed last; of several at one time that of the last path."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("modified_at"), F.desc("path")))
    return reports.withColumn("_place", place).where("_place = 1").drop("_place")
