"""Binary files, all of a job or none.

A data source `assets` takes rows (name, content) and writes a file for each, in tasks. Files go to a staging folder beside
the target under their own names; the commit, once all tasks are done, moves the folder to the target in one step, and a job
that fails takes it away. A task that is tried again writes the same names with the same contents, so nothing is there twice.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillspark.operators.review import load

SCHEMA = "name string, content binary"


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class AssetWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        system, at = fs.FileSystem.from_uri(self.path)
        folder, _, name = at.rpartition("/")
        return system, at, f"{folder}/.{name}-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, staging = self._place()
        files = size = 0
        for batch in iterator:
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if not name or name.startswith(("/", ".")) or "/." in name or "//" in name or name.endswith("/"):
                    raise ValueError(f"no name for a file below a folder: {name!r}")
                final, part = f"{staging}/files/{name}", f"{staging}/parts/{uuid.uuid4().hex}"
                system.create_dir(final.rpartition("/")[0])
                system.create_dir(f"{staging}/parts")
                with system.open_output_stream(part) as out:
                    out.write(content or b"")
                system.move(part, final)  # in one step, so that of two attempts either's file is whole
                files, size = files + 1, size + len(content or b"")
        return Written(files, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at, staging = self._place()
        system.create_dir(f"{staging}/files")
        there = system.get_file_info(at).type != fs.FileType.NotFound
        if there and not self.overwrite:
            system.delete_dir(staging)
            raise FileExistsError(self.path)
        if there:
            system.move(at, f"{staging}/before")
        system.move(f"{staging}/files", at)
        system.delete_dir(staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _, staging = self._place()
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class AssetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assets"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> AssetWriter:
        return AssetWriter(self.options["path"], overwrite)


def asset_names(source: Column, content: Column) -> Column:
    """A stable name: the first letters of the content's SHA-256 and what is left of the source's own name."""
    own = F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.coalesce(source, F.lit("")), r"[/\\]"), -1), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+", "")
    return F.concat(F.substring(F.sha2(content, 256), 1, 2), F.lit("/"), F.substring(F.sha2(content, 256), 1, 16), F.when(own == "", "").otherwise(F.concat(F.lit("-"), own)))


def write_assets(rows: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Writes rows (source, content) below path, each content of a name once, and returns their names: source, name. Rows
    without content have no name. Names come from contents, so that the same assets have the same names in every export."""
    spark = rows.sparkSession
    spark.dataSource.register(AssetSource)
    named = rows.withColumn("name", F.when(F.col("content").isNotNull(), asset_names(F.col("source"), F.col("content"))))
    files = named.where("name is not null").select("name", "content").dropDuplicates(["name"])
    files.write.format("assets").option("path", path).mode("overwrite" if overwrite else "append").save()
    return named.select("source", "name")


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """name and content of all files below path, but for empty ones, which Spark's scans leave out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    place = path.rstrip("/").rpartition("/")[2]
    return rows.select(F.regexp_extract("path", rf"/{place}/(.*)$", 1).alias("name"), "content")


def export_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors share one; on a single machine, where none is set, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='exports-')}"
    return f"{found.rstrip('/')}/export-{uuid.uuid4().hex}"


def exported_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files named by their contents, and read back: how long each page's file is, and its MD5."""
    pages = load(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("source"), F.col("html").cast("binary").alias("content"))
    path = export_folder(spark)
    names = write_assets(pages.select("source", "content"), path)
    found = names.where("name is not null").join(read_assets(spark, path), "name", "left").withColumn("content", F.coalesce("content", F.lit("").cast("binary")))
    return found.select(F.regexp_extract("source", "([0-9]+)", 1).cast("long").alias("page_id"), F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("content_md5"))


QUERIES = {f.__name__: f for f in (exported_pages,)}
SQL = {"exported_pages": "SELECT page_id, octet_length(encode(html)) AS n_bytes, md5(html) AS content_md5 FROM pages WHERE html IS NOT NULL"}
