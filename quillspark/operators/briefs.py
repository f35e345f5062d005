"""Operators over paragraphs, memories and terms: what a paragraph does, how it follows the one before, which memories still
hold, which terms are told by all examples, and where a locked term may vary.

Each operator takes DataFrames and parameters; the queries below make such tables of the given ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.documents import BLOCKS, blocks
from quillspark.operators.review import load

# They decide results.
INTENTS = {
    "definition": ("refers to", "is what some are beginning to call", "in technical terms", "is the deliberate design"),
    "analogy": ("recipe book", "personal chef", "chef", "pantry", "in other words", "likewise"),
    "transition": ("this is where", "for now", "chapter 2 explores", "by contrast", "however"),
    "evidence": ("weight of evidence", "evidence shows", "in essence", "research shows", "studies show"),
    "summary": ("in summary", "overall", "in short", "therefore"),
}
ROLES = {"definition": "concept definition", "analogy": "analogy", "transition": "transition", "evidence": "evidence-based reasoning", "summary": "summary", "exposition": "technical explanation"}
#: How a role follows the one before: (before, role, whether a bridge opens the text, words); None fits anything, NONE no role
#: before, SAME an equal one. The first that fits holds.
NONE, SAME = "none", "same"
RELATIONS = (
    (NONE, None, True, "opens with an explicit bridge and then moves into {role}"),
    (NONE, None, None, "opens a new local point as {role}"),
    (SAME, None, None, "continues the same {role}"),
    ("analogy", "concept definition", None, "moves from analogy into concept definition"),
    ("concept definition", "evidence-based reasoning", None, "moves from concept definition into evidence and implications"),
    ("technical explanation", "evidence-based reasoning", None, "moves from explanation into evidence and justification"),
    ("technical explanation", "transition", None, "shifts from explanation into a local transition"),
    ("transition", "concept definition", None, "uses a transition to enter a new concept definition"),
    (None, None, True, "uses an explicit bridge to move from {before} into {role}"),
    (None, None, None, "moves from {before} into {role}"),
)
#: Subjects that make a paragraph a definition if its brief is about them as well.
SUBJECTS = ("context engineering",)
PLAIN_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "via", "with")
LEADING = ("大", "小", "超", "微", "强", "弱", "多", "单")
TERM_WORD = r"([A-Za-z][A-Za-z0-9.+_-]*)"
JOINED_WORD = r"([A-Za-z](?:[A-Za-z0-9.+_-]*[.+-]))"
BEGUN, ENDED = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
PREFERRED = (("agentic ai", "智能体式(?:AI|人工智能)", "智能体AI"),)


def any_of(words: tuple[str, ...]) -> str:
    """A pattern for texts that hold one of the words."""
    return "|".join(rf"\Q{w}\E" for w in words)


def intent(text: Column, brief: Column | None = None, kinds: dict[str, tuple[str, ...]] = INTENTS, subjects: tuple[str, ...] = SUBJECTS, rest: str = "exposition") -> Column:
    """What a paragraph does: the first of kinds (markers by kind) of which it holds a marker, a definition where it has a
    subject in common with its brief, else rest. Empty for an empty text."""
    low = F.lower(T.single_spaced(text))
    told = [F.when(low.rlike(any_of(markers)), kind) for kind, markers in kinds.items()]
    shared = [] if brief is None else [F.when(F.contains(low, F.lit(s)) & F.contains(F.lower(brief), F.lit(s)), "definition") for s in subjects]
    return F.coalesce(F.when(low == "", ""), *told, *shared, F.lit(rest))


def role_of(intent: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), intent)


def relation(before: Column, role: Column, text: Column, rules: tuple = RELATIONS) -> Column:
    """How a paragraph follows the one before, in the words of the first rule that fits; null without a role."""
    bridge = T.starts_with_bridge(text)

    def fits(rule: tuple) -> Column:
        left = {NONE: before.isNull(), SAME: before == role, None: F.lit(True)}.get(rule[0], before == rule[0])
        return left & (F.lit(True) if rule[1] is None else role == rule[1]) & (F.lit(True) if rule[2] is None else bridge == rule[2])

    def said(words: str) -> Column:
        return F.replace(F.replace(F.lit(words), F.lit("{before}"), F.coalesce(before, F.lit(""))), F.lit("{role}"), role)

    return F.when(role.isNotNull(), F.coalesce(*[F.when(fits(r), said(r[3])) for r in rules]))


def discourse(rows: DataFrame) -> DataFrame:
    """Of each paragraph in rows (doc_id, idx, text) its role, the role before and the relation of both."""
    found = rows.withColumn("role", role_of(intent(F.col("text")))).withColumn("before", F.lag("role").over(Window.partitionBy("doc_id").orderBy("idx")))
    return found.select("doc_id", "idx", "role", "before", relation(F.col("before"), F.col("role"), F.col("text")).alias("relation"))


def kept_memories(memories: DataFrame, terms: DataFrame, drift: list[tuple[str, str]] = ()) -> DataFrame:
    """memories (doc_id, idx, source, target) without those that break a locked term of terms (doc_id, source_term,
    target_term), that is, hold its source but not its target, or whose two texts fit a pair of drift patterns. Rows without
    a text on either side can't drift; empty terms bind nothing."""
    held = memories
    for source, target in drift:
        held = held.where(~(F.coalesce(F.col("source").rlike(source), F.lit(False)) & F.coalesce(F.col("target").rlike(target), F.lit(False))))
    bound = terms.where("trim(source_term) != '' and trim(target_term) != ''").select(F.col("doc_id").alias("_doc"), F.lower(F.trim("source_term")).alias("_source"), F.trim("target_term").alias("_target"))
    broken = (F.col("doc_id") == F.col("_doc")) & F.contains(F.lower("source"), F.col("_source")) & ~F.contains(F.coalesce("target", F.lit("")), F.col("_target"))
    return held.join(bound, broken, "left_anti")


def rendering(source: Column, target: Column, rules: tuple = PREFERRED) -> Column:
    """A term's rendering, single-spaced, or the preferred one where a rule names source and rendering."""
    spaced = T.single_spaced(target)
    found = spaced
    for term, bad, good in rules:
        found = F.when((F.lower(T.single_spaced(source)) == term) & F.replace(spaced, F.lit(" "), F.lit("")).rlike(f"(?i)^{bad}$"), good).otherwise(found)
    return found


def has_modifier(text: Column, term: Column) -> Column:
    """Whether a name stands right before or behind the term in a text: a word with a capital, or with a sign inside."""
    safe = F.regexp_replace(term, r"([^0-9A-Za-z])", r"\\$1")
    found = lambda before, behind: F.regexp_extract_all(text, F.concat(F.lit(before + "(?i:"), safe, F.lit(")" + behind)), F.lit(1))
    words = F.concat(found(TERM_WORD + r"\s+", ENDED), found(JOINED_WORD, ENDED), found(BEGUN, r"\s+" + TERM_WORD))
    name = lambda w: ~F.lower(w).isin(*PLAIN_WORDS) & w.rlike("^[A-Z]|[.+_-]")
    return F.exists(words, name)


def renderings_of(term: Column) -> Column:
    """A locked rendering and what of it is enough: its last Chinese characters, and it without a modifier before it."""
    tail = F.regexp_extract(term, "([一-鿿]{2,})$", 1)
    bare = F.when(F.left(term, F.lit(1)).isin(*LEADING) & (F.length(term) > 2), F.substring(term, F.lit(2), F.length(term)))
    return F.array_distinct(F.array_compact(F.array(F.when(term != "", term), F.when(tail != "", tail), bare)))


def is_exempt(source: Column, target: Column, term: Column, expected: Column, reference_like: Column) -> Column:
    """Whether a target that lacks the expected rendering may do so: the term has a name beside it, and the chapter is one of
    references or the target holds enough of the rendering."""
    enough = F.exists(renderings_of(expected), lambda v: F.contains(target, v))
    return F.coalesce((F.trim(target) != "") & has_modifier(source, term) & (reference_like | enough), F.lit(False))


def agreed_tokens(rows: DataFrame, pattern: str, stop: tuple[str, ...] = (), least: int = 2, most: int = 16, examples: int = 5) -> DataFrame:
    """Of each term in rows (term, place, text) the token that all of its first `examples` texts by place hold, the longest
    one, then the first by letters; null if there is none. Tokens are what pattern finds, of least to most characters."""
    taken = rows.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("place"))).where(F.col("n") <= examples)
    # all that follows is grouped by term, so the rows are shuffled once, and at most `examples` of each term
    taken = taken.withColumn("example_count", F.count("*").over(Window.partitionBy("term")))
    viable = lambda x: F.length(x).between(least, most) & (~x.isin(*stop) if stop else F.lit(True))
    tokens = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), viable))
    held = taken.select("term", "example_count", F.explode_outer(tokens).alias("token")).groupBy("term", "example_count", "token").agg(F.count("*").alias("held"))
    agreed = F.col("token").isNotNull() & (F.col("held") == F.col("example_count"))
    best = F.min_by(F.when(agreed, F.col("token")), F.when(agreed, F.struct(-F.length("token"), "token")))
    return held.groupBy("term").agg(F.first("example_count").alias("example_count"), best.alias("token"))


def discourse_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents, with markers before them in turn, and how each follows the one before."""
    markers = F.array(*[F.lit(x) for x in MARKED])
    rows = blocks(spark, sf_dir).select("doc_id", F.col("ordinal").alias("idx"), F.concat(F.element_at(markers, F.col("ordinal") % len(MARKED) + 1), F.col("block_text")).alias("text"))
    return discourse(rows)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the next one as their target."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("text").alias("source"), F.lead("text").over(w).alias("target"))


def steady_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that keep the second word of their conversation and hold no bracket on either side."""
    word = F.regexp_extract("text", "^[A-Za-z]+ ([A-Za-z]+)", 1)
    terms = load(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("doc_id"), word.alias("source_term"), word.alias("target_term"))
    return kept_memories(turns(spark, sf_dir), terms, [(r"[()]", r"[()]"), ("^[A-D]", "^[A-D]")]).select(F.col("doc_id").alias("conv_id"), F.col("idx").alias("turn"))


def term_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renderings of terms under which segments go, and how many do."""
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("turn") % len(names) + 1).cast("int"))
    rows = load(spark, sf_dir, "conversations").select(pick(("Agentic  AI", "agent")).alias("source"), pick(("智能体式 AI", " 智能体  AI ", "智能体式人工智能")).alias("target"))
    return rows.groupBy("source", rendering(F.col("source"), F.col("target")).alias("target")).agg(F.count("*").alias("n"))


def exempt_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that hold the second word of the first turn, and whether they may render it in part."""
    rows = load(spark, sf_dir, "conversations").where("text is not null")
    first = rows.where("turn = 0").select("conv_id", F.regexp_extract("text", "^[A-Za-z]+ ([A-Za-z]+)", 1).alias("term")).where("term != ''")
    found = rows.join(first, "conv_id").where(F.contains(F.lower("text"), F.lower("term")))
    target = F.when(F.col("turn") % 2 == 0, "一个模型").otherwise("一个系统")
    return found.select("conv_id", "turn", has_modifier(F.col("text"), F.col("term")).alias("has_modifier"), is_exempt(F.col("text"), target, F.col("term"), F.lit("大模型"), F.col("conv_id") % 5 == 0).alias("exempt"))


def agreed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the longest word that its first three turns share."""
    rows = load(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("term"), F.col("turn").alias("place"), "text")
    found = agreed_tokens(rows, "([A-Za-z0-9-]{2,})", stop=PLAIN_WORDS, examples=3)
    return found.select(F.col("term").alias("conv_id"), "example_count", "token")


MARKED = ("", "In other words, ", "This refers to ", "Research shows that ", "However, ", "", "Such chef and pantry ", "Therefore ")
QUERIES = {f.__name__: f for f in (discourse_bridges, steady_memories, term_renderings, exempt_terms, agreed_words)}

_spaced = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_INTENT = "CASE WHEN low = '' THEN NULL " + " ".join("WHEN " + " OR ".join(f"contains(low, '{m}')" for m in ms) + f" THEN '{ROLES[k]}'" for k, ms in INTENTS.items()) + f" ELSE '{ROLES['exposition']}' END"
_TURNS = "t AS (SELECT conv_id, turn, text AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations)"
_WORD = "regexp_extract(text, '^[A-Za-z]+ ([A-Za-z]+)', 1)"
_NAME = f"lambda w: lower(w) NOT IN {PLAIN_WORDS} AND regexp_matches(w, '^[A-Z]|[.+_-]')"
SQL = {
    "discourse_bridges": f"""WITH {BLOCKS}, m AS (SELECT doc_id, ordinal, {list(MARKED)}[ordinal % {len(MARKED)} + 1] || block_text AS text FROM blocks), l AS (SELECT *, lower({_spaced('text')}) AS low FROM m), r AS (SELECT *, {_INTENT} AS role FROM l),
b AS (SELECT *, lag(role) OVER (PARTITION BY doc_id ORDER BY ordinal) AS before, regexp_matches(low, '^(?:{'|'.join(T.BRIDGES)})(?: |$)') AS bridge FROM r)
SELECT doc_id, ordinal AS idx, role, before, CASE WHEN role IS NULL THEN NULL WHEN before IS NULL AND bridge THEN 'opens with an explicit bridge and then moves into ' || role WHEN before IS NULL THEN 'opens a new local point as ' || role WHEN before = role THEN 'continues the same ' || role {' '.join(f"WHEN before = '{a}' AND role = '{b}' THEN '{w}'" for a, b, _, w in RELATIONS if b)}
WHEN bridge THEN 'uses an explicit bridge to move from ' || before || ' into ' || role ELSE 'moves from ' || before || ' into ' || role END AS relation FROM b""",
    "steady_memories": f"""WITH {_TURNS}, f AS (SELECT conv_id, {_WORD} AS term FROM conversations WHERE turn = 0)
SELECT t.conv_id, turn FROM t LEFT JOIN f ON f.conv_id = t.conv_id AND term != '' WHERE NOT coalesce(regexp_matches(source, '[()]') AND regexp_matches(target, '[()]'), false) AND NOT coalesce(regexp_matches(source, '^[A-D]') AND regexp_matches(target, '^[A-D]'), false) AND NOT coalesce(contains(lower(source), lower(term)) AND NOT contains(coalesce(target, ''), term), false)""",
    "term_renderings": "WITH r AS (SELECT ['Agentic  AI', 'agent'][turn % 2 + 1] AS source, turn % 3 AS k FROM conversations) SELECT source, CASE WHEN source = 'Agentic  AI' AND k != 1 THEN '智能体AI' ELSE ['智能体式 AI', '智能体 AI', '智能体式人工智能'][k + 1] END AS target, count(*) AS n FROM r GROUP BY ALL",
    "exempt_terms": f"""WITH f AS (SELECT conv_id, {_WORD} AS term FROM conversations WHERE turn = 0 AND {_WORD} != ''), h AS (SELECT c.*, list_concat(list_concat(regexp_extract_all(text, '{TERM_WORD}\\s+(?i:' || term || '){ENDED}', 1), regexp_extract_all(text, '{JOINED_WORD}(?i:' || term || '){ENDED}', 1)), regexp_extract_all(text, '{BEGUN}(?i:' || term || ')\\s+{TERM_WORD}', 1)) AS words FROM conversations c JOIN f USING (conv_id) WHERE contains(lower(text), lower(term))),
m AS (SELECT *, len(list_filter(words, {_NAME})) > 0 AS has_modifier FROM h) SELECT conv_id, turn, has_modifier, has_modifier AND (conv_id % 5 = 0 OR turn % 2 = 0) AS exempt FROM m""",
    "agreed_words": f"""WITH e AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3), n AS (SELECT conv_id, count(*) AS example_count FROM e GROUP BY conv_id), k AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9-]{{2,}}'))) AS token FROM e),
h AS (SELECT conv_id, token, count(*) AS held FROM k WHERE length(token) <= 16 AND token NOT IN {PLAIN_WORDS} GROUP BY ALL), b AS (SELECT conv_id, token FROM h JOIN n USING (conv_id) WHERE held = example_count QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(token) DESC, token) = 1)
SELECT n.conv_id, example_count, token FROM n LEFT JOIN b ON b.conv_id = n.conv_id""",
}
