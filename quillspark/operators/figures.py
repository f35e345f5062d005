"""Boxes on pages: drawings that make up a figure, and the reading order of pages with columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.review import load

CORNERS = ("x0", "y0", "x1", "y1")
CLUSTERED = "doc_id long, page long, box long, cluster long"
#: Boxes compared with the others of their group at once.
STRIP = 512


def lies_apart(rows: DataFrame, by: list[str], low: str, high: str, gap: Column, name: str) -> DataFrame:
    """rows with the number of the stretch that each lies in: a sweep along one edge with the greatest end so far, where a
    stretch ends at a gap of more than gap."""
    order = Window.partitionBy(*by).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("swept", F.coalesce(F.col(low) - reach > gap, F.lit(True)))
    # rows with equal edges come in any order, but only the first of them can begin a stretch
    return rows.withColumn(name, F.count_if("swept").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("swept")


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, for links a-b among n."""
    least = np.arange(n)
    while (least[a] != least[b]).any():
        low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        np.minimum.at(least, high, low)
        while (least != (upper := least[least])).any():
            least = upper
    return least


def grown_together(corners: np.ndarray, gap_x: float, gap_y: float) -> np.ndarray:
    """The group of each box (by its first box's place): boxes not further apart than the gaps are one, which again is one
    with what is no further from its whole extent, until nothing more touches."""
    own, extent = np.arange(len(corners)), corners
    while True:
        links = [np.zeros((2, 0), np.int64)]
        for i in range(0, len(extent), STRIP):
            x0, y0, x1, y1 = (extent[i : i + STRIP, k, None] for k in range(4))
            near = (x0 - extent[:, 2] <= gap_x) & (extent[:, 0] - x1 <= gap_x) & (y0 - extent[:, 3] <= gap_y) & (extent[:, 1] - y1 <= gap_y)
            links.append(np.stack(np.nonzero(near)) + [[i], [0]])
        a, b = np.concatenate(links, axis=1)
        least = joined(len(extent), a, b)
        heads, which = np.unique(least, return_inverse=True)
        if len(heads) == len(extent):
            return own
        ends = [np.full(len(heads), np.inf), np.full(len(heads), np.inf), np.full(len(heads), -np.inf), np.full(len(heads), -np.inf)]
        for k, (end, pick) in enumerate(zip(ends, (np.minimum, np.minimum, np.maximum, np.maximum), strict=True)):
            pick.at(end, which, extent[:, k])
        own, extent = which[own], np.stack(ends, axis=1)


def figure_clusters(boxes: DataFrame, gap_x: float, gap_y: float) -> DataFrame:
    """doc_id, page, box and cluster (its least box): boxes (doc_id, page, box, x0, y0, x1, y1) no further apart than both
    gaps are one cluster, and clusters whose extents are no further apart as well, whatever the order of the boxes.

    Two sweeps cut a page into strips and these into stretches that nothing can join, as no extent reaches out of them; only
    what is left inside one is compared, in one task each. Boxes with a null corner are left out; repeated boxes, and those
    without an area, count like others.
    """
    rows = boxes.select("doc_id", "page", "box", *[F.col(c).cast("double").alias(c) for c in CORNERS]).where(" and ".join(f"{c} is not null" for c in CORNERS))
    rows = lies_apart(rows, ["doc_id", "page"], "y0", "y1", F.lit(float(gap_y)), "band")
    rows = lies_apart(rows, ["doc_id", "page", "band"], "x0", "x1", F.lit(float(gap_x)), "part")
    alone = F.count("*").over(Window.partitionBy("doc_id", "page", "band", "part")) == 1
    rows = rows.withColumn("alone", alone)

    def cluster(table: pa.Table) -> pa.Table:
        corners = np.stack([table[c].to_numpy() for c in CORNERS], axis=1)
        group, box = grown_together(corners, gap_x, gap_y), table["box"].to_numpy()
        least = np.full(group.max() + 1, box.max())
        np.minimum.at(least, group, box)
        return pa.table({"doc_id": table["doc_id"], "page": table["page"], "box": table["box"], "cluster": pa.array(least[group])})

    several = rows.where("not alone").select(F.col("doc_id").cast("long"), F.col("page").cast("long"), F.col("box").cast("long"), *CORNERS, "band", "part")
    found = several.groupBy("doc_id", "page", "band", "part").applyInArrow(cluster, CLUSTERED)
    return found.union(rows.where("alone").select("doc_id", "page", "box", F.col("box").alias("cluster")))


def figures_of(boxes: DataFrame, width: float, height: float, least_side: float = 18.0, least_share: float = 0.0025, figure_share: float = 0.018, reach: float = 0.08) -> DataFrame:
    """doc_id, page, figure, box_count, x0, y0, x1, y1 of the figures that drawings make up on pages of width and height.

    Drawings under least_side or least_share of the page, and rules along a page's side, are left out; what lies within reach
    (a share of the page, 24 at least) is one figure, if it has figure_share of the page, and a fifth of its width or an
    eighth of its height.
    """
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    page = width * height
    rule = ((wide >= 0.92 * width) & (high <= 0.035 * height)) | ((high >= 0.92 * height) & (wide <= 0.035 * width))
    drawn = boxes.where((wide >= least_side) & (high >= least_side) & (wide * high >= max(1800.0, least_share * page)) & ~rule)
    found = figure_clusters(drawn, max(24.0, reach * width), max(24.0, reach * height)).withColumnRenamed("cluster", "figure")
    sums = found.join(drawn, ["doc_id", "page", "box"]).groupBy("doc_id", "page", "figure").agg(F.count("*").alias("box_count"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return sums.where((wide * high >= max(12000.0, figure_share * page)) & ((wide >= 0.22 * width) | (high >= 0.12 * height)))


def column_order(rows: DataFrame, width: float, spanning: float = 0.62, gap: float = 0.0, least: int = 2) -> DataFrame:
    """rows (doc_id, page, idx, x0, y0, x1, y1) with band, part and place (from 1), the order of reading.

    Blocks over the share spanning of the page's width cut the page into bands, each block its own band. Inside a band a
    sweep over the sides of the blocks finds the columns, which nothing crosses; they count if two of them at least have
    `least` blocks, else the band is one column. A column is read to its end, by y0, x0 and idx.
    """
    page = ["doc_id", "page"]
    down = Window.partitionBy(*page).orderBy("y0", "x0", "idx")
    spans = F.col("x1") - F.col("x0") > spanning * width
    rows = rows.withColumn("spans", spans)
    # a band before each spanning block, and one for itself
    rows = rows.withColumn("band", 2 * F.count_if("spans").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.when(F.col("spans"), 1).otherwise(0))
    rows = lies_apart(rows, [*page, "band"], "x0", "x1", F.lit(float(gap)), "part")
    size = F.count("*").over(Window.partitionBy(*page, "band", "part"))
    rows = rows.withColumn("head", (F.row_number().over(Window.partitionBy(*page, "band", "part").orderBy("y0", "x0", "idx")) == 1) & (size >= least))
    full = F.count_if("head").over(Window.partitionBy(*page, "band"))
    rows = rows.withColumn("part", F.when(full >= 2, F.col("part")).otherwise(F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*page).orderBy("band", "part", "y0", "x0", "idx"))
    return rows.withColumn("place", place).drop("spans", "head")


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the first four numbers of a vector, 24 to a page of 1,200 by 1,600."""
    e = lambda i: F.floor(F.get("embedding", F.lit(i)).cast("double") * 2000)
    rows = load(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2400).cast("long").alias("doc_id"), F.floor(F.col("vec_id") / 24).cast("long").alias("page"), F.col("vec_id").alias("box"), (e(0) + 600).alias("x0"), (e(1) * 1.5 + 800).alias("y0"), (F.abs(e(2)) / 2 + 10).alias("w"), (F.abs(e(3)) / 2 + 10).alias("h"))
    return rows.select("doc_id", "page", "box", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))


def drawn_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures_of(drawings(spark, sf_dir), 1200.0, 1600.0, reach=0.03)


def column_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as blocks, 20 to a page: pages of two columns with spanning heads, of two alone, and of one column."""
    k, e = F.col("vec_id") % 20, lambda i: F.floor(F.abs(F.get("embedding", F.lit(i)).cast("double")) * 100)
    page = F.floor(F.col("vec_id") / 20).cast("long")
    head = (page % 3 == 0) & (k.isin(0, 11)) | (page % 3 == 2)
    right = (F.floor(e(0)) % 2 == 1) & ~head
    rows = load(spark, sf_dir, "embeddings").where("size(embedding) >= 3").select((page / 10).cast("long").alias("doc_id"), page.alias("page"), F.col("vec_id").alias("idx"), head.alias("head"), right.alias("right"), e(1).alias("indent"), (F.floor(k / 2) * 70 + e(2)).alias("y0"), k.alias("k"))
    x0 = F.when(F.col("head"), F.lit(40.0)).when(F.col("right"), 320.0 + F.col("indent")).otherwise(40.0 + F.col("indent"))
    x1 = F.when(F.col("head"), F.lit(560.0)).when(F.col("right"), 560.0).otherwise(300.0)
    found = column_order(rows.select("doc_id", "page", "idx", x0.alias("x0"), F.when(F.col("head"), F.col("k") * 35.0).otherwise(F.col("y0")).alias("y0"), x1.alias("x1"), F.lit(0.0).alias("y1")), 600.0)
    return found.select("page", "idx", F.col("band").cast("long").alias("band"), F.col("part").cast("long").alias("part"), F.col("place").cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (drawn_figures, column_reading)}
#: Figures are a fixed point of growing extents; tests hold them against a plain version.
SQL = {
    "column_reading": """WITH v AS (SELECT vec_id AS idx, vec_id // 20 AS page, vec_id % 20 AS k, [floor(abs(embedding[i]::DOUBLE) * 100) FOR i IN [1, 2, 3]] AS e FROM embeddings WHERE len(embedding) >= 3),
h AS (SELECT *, (page % 3 = 0 AND k IN (0, 11)) OR page % 3 = 2 AS head FROM v), r AS (SELECT *, NOT head AND e[1]::BIGINT % 2 = 1 AS "right" FROM h),
b AS (SELECT idx, page, CASE WHEN head THEN 40 WHEN "right" THEN 320 + e[2] ELSE 40 + e[2] END AS x0, CASE WHEN head OR "right" THEN 560 ELSE 300 END AS x1, CASE WHEN head THEN k * 35 ELSE k // 2 * 70 + e[3] END AS y0 FROM r),
s AS (SELECT *, x1 - x0 > 372 AS spans FROM b),
d AS (SELECT *, 2 * count(*) FILTER (spans) OVER (PARTITION BY page ORDER BY y0, x0, idx) - spans::INT AS band FROM s),
g AS (SELECT *, coalesce(x0 - max(x1) OVER (PARTITION BY page, band ORDER BY x0, x1, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0, true) AS fresh FROM d),
p AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY page, band ORDER BY x0, x1, idx) AS part FROM g),
n AS (SELECT *, count(*) OVER (PARTITION BY page, band, part) AS size FROM p),
f AS (SELECT *, (SELECT count(DISTINCT m.part) FROM n m WHERE m.page = n.page AND m.band = n.band AND m.size >= 2) >= 2 AS columns FROM n)
SELECT page, idx, band::BIGINT AS band, CASE WHEN columns THEN part ELSE 1 END AS part, row_number() OVER (PARTITION BY page ORDER BY band, CASE WHEN columns THEN part ELSE 1 END, y0, x0, idx) AS place FROM f""",
}
