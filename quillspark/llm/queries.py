"""The queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digestindex, linededup, ngramjoin, ngramlm, packing, periodicruns, phrases, qualityrules, sharding, suffixdedup, tokenfiles, transducer, vectorsearch

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfiles.new_folder(spark)
    index = tokenfiles.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), folder)
    return tokenfiles.read_files(index, folder)


def op3_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.byte_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.scores(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = qualityrules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_components(table(spark, sf_dir, "documents"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectorsearch.neighbours(rows, rows.where("vec_id % 50 = 0"), 5)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digestindex.exact_copies(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodicruns.periodic_runs(periodicruns.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("longest", longest)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        "longest.length",
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_WORDS = r"[^\x20\x09-\x0D]"
#: The others need learned models, tokenizers, crc32 or approximate search, or (op5) are too slow in SQL on whole tables.
SQL = {
    "op7_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(range(len(a))) AS n, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
w AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS next FROM l),
g AS (SELECT doc_id, n FROM w WHERE regexp_matches(line, '{_WORDS}') AND regexp_matches(next, '{_WORDS}') QUALIFY row_number() OVER (PARTITION BY line, next ORDER BY doc_id, n) > 1),
d AS (FROM g UNION SELECT doc_id, n + 1 FROM g),
m AS (SELECT l.*, d.n IS NOT NULL AS gone FROM l LEFT JOIN d ON d.doc_id = l.doc_id AND d.n = l.n),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY n), false) AS begins FROM m)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_runs, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id""",
    "op9_ngram_join": f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM t),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id != b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM r LEFT JOIN z ON z.doc_id = a GROUP BY a""",
    "op11_phrases": r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, w[i:i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, 6) AS r(m) WHERE len(w) >= m)),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, g, f AS a, k, g[1:k] AS x, g[k + 1:len(g)] AS y FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1)),
s AS (SELECT c.lang, c.g, a, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM c JOIN f l ON l.lang = c.lang AND l.g = x JOIN f r ON r.lang = c.lang AND r.g = y JOIN n ON n.lang = c.lang QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, k) = 1),
o AS (SELECT lang, g[i:i + m - 1] AS g, max(f) AS longer FROM (SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS i FROM f, range(2, 5) AS r(m) WHERE len(g) > m) GROUP BY ALL)
SELECT s.lang, row_number() OVER w AS rank, array_to_string(s.g, ' ') AS phrase, a, l, r, n, score FROM s LEFT JOIN o ON o.lang = s.lang AND o.g = s.g WHERE longer IS NULL OR 100 * longer < 100 * a WINDOW w AS (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(array_to_string(s.g, ' '))) QUALIFY rank <= 2000""",
    "op12_digest_index": """WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256)""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
