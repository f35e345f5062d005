"""The structure of documents: merged blocks, sections, budgets, briefs, profiles, and items placed on pages by boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sources.web import SQL as WEB
from quillspark.sources.web import heading_levels

from .documents import BLOCKS, SENTENCES, blocks, sentences
from .review import load

#: Blocks up to SHORT characters merge, at most MOST of them, into groups of at most ROOM characters.
SHORT, MOST, ROOM = 420, 3, 900
#: A page's font size where nothing is known.
FONT = 12.0


def greedy_groups(rows: DataFrame, key: str, order: str, size: str, longest: int, short: int = SHORT, most: int = MOST, room: int = ROOM) -> DataFrame:
    """rows with first, the place (from 0, by order) of the first of the group that each is in, and place: neighbours of a
    key that are at most `short` form groups of at most `most` and of at most `room` in all, filled greedily from the first
    on; a longer one stands alone. longest: at least the greatest number of rows of a key.

    How far a group reaches that begins at a row is known from the `most` - 1 rows behind it. So a row is a map from how many
    rows lie between it and the next begin to the same for the row behind it, and what holds at each row is all maps before
    it upon 0. The maps are composed by doubling: each step takes the map from as many rows before as have been composed.
    Windows of one order do it all; a key of any size is never in one row.
    """
    w = Window.partitionBy(key).orderBy(order)
    n = F.col(size)
    behind = F.collect_list(size).over(w.rowsBetween(1, most - 1))
    step = lambda a, x: F.struct((a["goes_on"] & (x <= short) & (a["sum"] + x <= room)).alias("goes_on"), (a["sum"] + x).cast("long").alias("sum"), (a["span"] + F.when(a["goes_on"] & (x <= short) & (a["sum"] + x <= room), 1).otherwise(0)).alias("span"))
    span = F.aggregate("behind", F.struct((n <= short).alias("goes_on"), n.cast("long").alias("sum"), F.lit(1).alias("span")), step)["span"]
    found = rows.withColumns({"place": (F.row_number().over(w) - 1).cast("long"), "behind": behind})
    found = found.withColumn("maps", F.concat(F.array(span - 1), F.array([F.lit(k) for k in range(most - 1)])))
    done = 1
    while done < longest:
        before = F.lag("maps", done).over(w)
        found = found.withColumn("maps", F.coalesce(F.transform(before, lambda k: F.get("maps", k)), F.col("maps")))
        done *= 2
    begins = F.coalesce(F.get(F.lag("maps").over(w), F.lit(0)) == 0, F.lit(True))
    return found.withColumn("begins", begins).withColumn("first", F.last(F.when(F.col("begins"), F.col("place")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("behind", "maps", "begins")


def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of neighbouring short blocks, filled greedily."""
    docs = load(spark, sf_dir, "documents")
    longest = docs.agg(F.max(F.size(F.split("text", "\n")))).first()[0] or 0
    rows = blocks(spark, sf_dir).select("doc_id", "ordinal", F.length("block_text").alias("n"))
    found = greedy_groups(rows, "doc_id", "ordinal", "n", longest)
    return found.groupBy("doc_id", F.col("first").alias("first_block")).agg(F.count("*").alias("block_count"), F.sum("n").alias("n_chars"))


def is_heading() -> Column:
    return F.length("block_text") <= 60


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block with the last heading at or before it: a value carried forward over the others."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    return blocks(spark, sf_dir).select("doc_id", "ordinal", F.last(F.when(is_heading(), F.col("ordinal")), ignorenulls=True).over(order).alias("heading"))


def chapter_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and characters of each chapter, from a heading to before the next. Carrying the heading forward finds each
    block's range in one pass, where a join on the range would compare each block with all chapters of its document."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    rows = blocks(spark, sf_dir).select("doc_id", F.length("block_text").alias("n"), F.last(F.when(is_heading(), F.col("ordinal")), ignorenulls=True).over(order).alias("start"))
    return rows.where("start is not null").groupBy("doc_id", "start").agg(F.count("*").alias("block_count"), F.sum("n").alias("n_chars"))


def heading_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with the level before them, and whether they lie more than one below it."""
    before = F.lag("raw").over(Window.partitionBy("page_id").orderBy("ordinal"))
    return heading_levels(spark, sf_dir).select("page_id", "ordinal", "raw", before.alias("before")).withColumn("skipped", F.coalesce(F.col("raw") > F.col("before") + 1, F.lit(False)))


def budget_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of each document, and up to three more while 600 characters hold them all."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    rows = blocks(spark, sf_dir).select("doc_id", "ordinal", F.row_number().over(order).alias("place"), F.sum(F.length("block_text")).over(order).alias("used"))
    return rows.where("place = 1 or (place <= 4 and used <= 600)")


def brief_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sentences for a brief: the first, the longest of the second half, and the longest of the rest, far from both."""
    order = Window.partitionBy("doc_id").orderBy("ordinal", "n")
    rows = sentences(spark, sf_dir).select("doc_id", F.length("sentence").alias("score"), F.row_number().over(order).alias("place"), F.count("*").over(Window.partitionBy("doc_id")).alias("total"))
    two = F.max(F.when((F.col("place") > 1) & (2 * F.col("place") > F.col("total")), F.struct("score", (-F.col("place")).alias("p")))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("second", -two["p"])
    near = F.least(F.col("place") - 1, F.abs(F.col("place") - F.col("second")))
    third = F.max(F.when((F.col("place") > 1) & (F.col("place") != F.col("second")), F.struct("score", near.alias("near"), (-F.col("place")).alias("p"))))
    return rows.groupBy("doc_id").agg(F.min("place").alias("first"), F.first("second").alias("second"), third.alias("t")).select("doc_id", "first", "second", (-F.col("t.p")).alias("third"))


def orphan_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short turns go to the last turn before them that isn't short."""
    short = F.coalesce(F.length("text"), F.lit(0)) < 100
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", short.alias("short"), F.last(F.when(~short, F.col("turn")), ignorenulls=True).over(order).alias("attached_to"))
    return rows.where("short and attached_to is not null").drop("short")


def zipped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and target turns joined by position, where a conversation has equally many of both."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")))
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("balance", F.sum(F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", -1).otherwise(0)).over(whole)).where("balance = 0")
    found = rows.groupBy("conv_id", "place").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("source_turn"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("target_turn"))
    return found.where("source_turn is not null and target_turn is not null")


def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of dense blocks (32 characters or more) and the kind that it tells."""
    rows = blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("block_count"), F.count_if(F.length("block_text") >= 32).alias("dense_count"))
    kind = F.when(5 * F.col("dense_count") < F.col("block_count"), "scanned").when(10 * F.col("dense_count") < 9 * F.col("block_count"), "mixed").otherwise("text")
    return rows.withColumn("kind", kind)


def median_block_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median length of each document's blocks; the default where it has none."""
    found = blocks(spark, sf_dir).groupBy("doc_id").agg(F.median(F.length("block_text")).alias("m"))
    return load(spark, sf_dir, "documents").select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("m", F.lit(FONT)).alias("median_length"))


def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language with the most characters of each source."""
    sums = load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    return sums.groupBy("source").agg(F.min_by(F.struct("lang", "n_chars"), F.struct((-F.col("n_chars")).alias("n"), "lang")).alias("m")).select("source", "m.lang", "m.n_chars")


def dominant_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent quantity of each supplier, the smallest among equals."""
    counts = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("long").alias("offset")).count()
    return counts.groupBy("l_suppkey").agg(F.min_by(F.struct("offset", "count"), F.struct((-F.col("count")).alias("n"), "offset")).alias("m")).select("l_suppkey", "m.offset", F.col("m.count").alias("n"))


def concept_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring words of four small letters or more that stand in two documents or more."""
    words = F.split("block_text", " ")
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    rows = blocks(spark, sf_dir).select("doc_id", F.explode(pairs).alias("concept")).where(F.col("concept").rlike("^[a-z]{4,} [a-z]{4,}$"))
    return rows.groupBy("concept").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("document_count")).where("document_count >= 2")


def consensus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stand in every turn of a conversation of two turns or more."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("words"))
    turns = rows.groupBy("conv_id").agg(F.count("*").alias("turns")).where("turns > 1")
    each = rows.select("conv_id", F.explode("words").alias("token")).where("token != ''").groupBy("conv_id", "token").agg(F.count("*").alias("turns"))
    return each.join(turns, ["conv_id", "turns"]).select("conv_id", "token", "turns")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from the first four numbers of a vector, ten to a page; the first of a page is its figure."""
    e = lambda i: F.floor(F.get("embedding", F.lit(i)).cast("double") * 1000).cast("long")
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 10).cast("long").alias("page"), e(0).alias("x0"), e(1).alias("y0"), e(2).alias("w"), e(3).alias("h"))
    return rows.select("vec_id", "page", "x0", "y0", (F.col("x0") + F.abs("w")).alias("x1"), (F.col("y0") + F.abs("h")).alias("y1"))


_E = [f"floor(embedding[{i}]::DOUBLE * 1000)::BIGINT" for i in (1, 2, 3, 4)]
BOXES = f"boxes AS (SELECT vec_id, vec_id // 10 AS page, {_E[0]} AS x0, {_E[1]} AS y0, {_E[0]} + abs({_E[2]}) AS x1, {_E[1]} + abs({_E[3]}) AS y1 FROM embeddings)"


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("page").orderBy("y0", "x0", "vec_id")
    return boxes(spark, sf_dir).select("page", "vec_id", F.row_number().over(order).alias("place"))


def page_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of a page's boxes."""
    return boxes(spark, sf_dir).groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that overlap their page's figure, with the area that both cover."""
    rows = boxes(spark, sf_dir)
    figure = rows.where("vec_id % 10 = 0").select("page", *[F.col(c).alias(f"f_{c}") for c in ("vec_id", "x0", "y0", "x1", "y1")])
    wide, high = (F.least(f"{a}1", f"f_{a}1") - F.greatest(f"{a}0", f"f_{a}0") for a in "xy")
    found = rows.where("vec_id % 10 != 0").join(figure, "page").withColumn("wide", wide).withColumn("high", high).where("wide > 0 and high > 0")
    return found.select("vec_id", F.col("f_vec_id").alias("figure_id"), (F.col("wide") * F.col("high")).alias("area"))


def nearest_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each figure's caption: the box of its page whose top is nearest to the figure's bottom, and within 120."""
    rows = boxes(spark, sf_dir)
    figure = rows.where("vec_id % 10 = 0").select("page", F.col("vec_id").alias("figure_id"), F.col("y1").alias("bottom"))
    found = rows.where("vec_id % 10 != 0").join(figure, "page").select("figure_id", "vec_id", F.abs(F.col("y0") - F.col("bottom")).alias("distance")).where("distance <= 120")
    return found.groupBy("figure_id").agg(F.min(F.struct("distance", "vec_id")).alias("m")).select("figure_id", F.col("m.vec_id").alias("caption_id"), "m.distance")


QUERIES = {f.__name__: f for f in (merged_blocks, sections, chapter_evidence, heading_skips, budget_take, brief_sentences, orphan_tails, zipped_turns, document_profile, median_block_length, weighted_mode, dominant_offset, concept_bigrams, consensus_tokens, reading_order, page_extent, box_overlaps, nearest_captions)}
_PLACED = SENTENCES + ", placed AS (SELECT doc_id, length(sentence) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, n) AS place, count(*) OVER (PARTITION BY doc_id) AS total FROM sentences)"
_FIGURES = "JOIN boxes f ON f.page = b.page AND f.vec_id % 10 = 0 AND b.vec_id % 10 != 0"
SQL = {
    "merged_blocks": f"""WITH RECURSIVE {BLOCKS}, b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS place, length(block_text) AS n FROM blocks),
g AS (SELECT doc_id, place, n, place AS first, 1 AS c, n AS total FROM b WHERE place = 0 UNION ALL
SELECT doc_id, place, n, CASE WHEN fresh THEN place ELSE first END, CASE WHEN fresh THEN 1 ELSE c + 1 END, CASE WHEN fresh THEN n ELSE total + n END FROM (SELECT b.*, first, c, total, g.n > {SHORT} OR b.n > {SHORT} OR c = {MOST} OR total + b.n > {ROOM} AS fresh FROM g JOIN b ON b.doc_id = g.doc_id AND b.place = g.place + 1))
SELECT doc_id, first AS first_block, count(*) AS block_count, sum(n)::BIGINT AS n_chars FROM g GROUP BY ALL""",
    "sections": f"WITH {BLOCKS} SELECT doc_id, ordinal, max(CASE WHEN length(block_text) <= 60 THEN ordinal END) OVER (PARTITION BY doc_id ORDER BY ordinal) AS heading FROM blocks",
    "chapter_evidence": f"WITH {BLOCKS}, c AS (SELECT doc_id, ordinal AS start, lead(ordinal) OVER (PARTITION BY doc_id ORDER BY ordinal) AS stop FROM blocks WHERE length(block_text) <= 60) SELECT b.doc_id, start, count(*) AS block_count, sum(length(block_text))::BIGINT AS n_chars FROM blocks b JOIN c ON c.doc_id = b.doc_id AND ordinal >= start AND ordinal < coalesce(stop, 2147483647) GROUP BY ALL",
    "heading_skips": f"WITH h AS (SELECT page_id, ordinal, raw, lag(raw) OVER (PARTITION BY page_id ORDER BY ordinal) AS before FROM ({WEB['heading_levels']})) SELECT *, coalesce(raw > before + 1, false) AS skipped FROM h",
    "budget_take": f"WITH {BLOCKS}, t AS (SELECT doc_id, ordinal, row_number() OVER w AS place, (sum(length(block_text)) OVER w)::BIGINT AS used FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)) SELECT * FROM t WHERE place = 1 OR (place <= 4 AND used <= 600)",
    "brief_sentences": f"""WITH {_PLACED}, s AS (SELECT doc_id, arg_max(place, (score, -place)) AS second FROM placed WHERE place > 1 AND 2 * place > total GROUP BY doc_id),
t AS (SELECT p.doc_id, arg_max(place, (score, least(place - 1, abs(place - second)), -place)) AS third FROM placed p JOIN s ON p.doc_id = s.doc_id WHERE place > 1 AND place != second GROUP BY p.doc_id)
SELECT d.doc_id, 1 AS first, second, third FROM (SELECT DISTINCT doc_id FROM placed) d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "orphan_tails": "SELECT conv_id, turn, attached_to FROM (SELECT conv_id, turn, coalesce(length(text), 0) < 100 AS short, max(CASE WHEN coalesce(length(text), 0) >= 100 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS attached_to FROM conversations) WHERE short AND attached_to IS NOT NULL",
    "zipped_turns": "WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS place FROM conversations), e AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') = count(*) FILTER (role = 'assistant')) SELECT a.conv_id, a.place, a.turn AS source_turn, b.turn AS target_turn FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.place = b.place AND a.role = 'user' AND b.role = 'assistant' WHERE a.conv_id IN (SELECT conv_id FROM e)",
    "document_profile": f"WITH {BLOCKS}, p AS (SELECT doc_id, count(*) AS block_count, count(*) FILTER (length(block_text) >= 32) AS dense_count FROM blocks GROUP BY doc_id) SELECT *, CASE WHEN 5 * dense_count < block_count THEN 'scanned' WHEN 10 * dense_count < 9 * block_count THEN 'mixed' ELSE 'text' END AS kind FROM p",
    "median_block_length": f"WITH {BLOCKS} SELECT doc_id, coalesce((SELECT median(length(block_text)) FROM blocks b WHERE b.doc_id = d.doc_id), {FONT})::DOUBLE AS median_length FROM (SELECT DISTINCT doc_id FROM documents) d",
    "weighted_mode": "SELECT source, lang, n_chars FROM (SELECT source, lang, sum(coalesce(length(text), 0))::BIGINT AS n_chars FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, lang) = 1",
    "dominant_offset": 'SELECT l_suppkey, "offset", n FROM (SELECT l_suppkey, l_quantity::BIGINT AS "offset", count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, "offset") = 1',
    "concept_bigrams": f"WITH {BLOCKS}, w AS (SELECT doc_id, string_split(block_text, ' ') AS a FROM blocks), p AS (SELECT doc_id, unnest(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS concept FROM w) SELECT concept, count(*) AS mentions, count(DISTINCT doc_id) AS document_count FROM p WHERE regexp_full_match(concept, '[a-z]{{4,}} [a-z]{{4,}}') GROUP BY concept HAVING count(DISTINCT doc_id) >= 2",
    "consensus_tokens": "WITH r AS (SELECT conv_id, list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS words FROM conversations), t AS (SELECT conv_id, count(*) AS turns FROM r GROUP BY conv_id HAVING count(*) > 1), e AS (SELECT conv_id, token, count(*) AS turns FROM (SELECT conv_id, unnest(words) AS token FROM r) WHERE token != '' GROUP BY ALL) SELECT conv_id, token, turns FROM e JOIN t USING (conv_id, turns)",
    "reading_order": f"WITH {BOXES} SELECT page, vec_id, row_number() OVER (PARTITION BY page ORDER BY y0, x0, vec_id) AS place FROM boxes",
    "page_extent": f"WITH {BOXES} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page",
    "box_overlaps": f"WITH {BOXES}, o AS (SELECT b.vec_id, f.vec_id AS figure_id, least(b.x1, f.x1) - greatest(b.x0, f.x0) AS wide, least(b.y1, f.y1) - greatest(b.y0, f.y0) AS high FROM boxes b {_FIGURES}) SELECT vec_id, figure_id, wide * high AS area FROM o WHERE wide > 0 AND high > 0",
    "nearest_captions": f"WITH {BOXES} SELECT f.vec_id AS figure_id, b.vec_id AS caption_id, abs(b.y0 - f.y1) AS distance FROM boxes b {_FIGURES} WHERE abs(b.y0 - f.y1) <= 120 QUALIFY row_number() OVER (PARTITION BY f.vec_id ORDER BY abs(b.y0 - f.y1), b.vec_id) = 1",
}
