"""Queries of mentions, labels and places in an editor, by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import anchors, candidates, chapters, coreference, editor, evidence, folding, labels, review, trees
from . import adapters as A
from .oracle import _KIND, _in, _norm
from .oracle import ORACLES as _EARLIER

Query = Callable[[SparkSession, str], DataFrame]

MENTIONED = ("he", "Her at all", "They", "Charlie", "Renee", "Edward Ash", "I", "my", "dad", "Mom,", "him too", "the door", "", "Alice Venn", "them still", "Teo", "his house", "at all")
NAMED = tuple(m for m in MENTIONED if m in ("Charlie", "Renee", "Edward Ash", "Alice Venn", "Teo"))
BLOCKS = ("## The Gate\nShe ran.", "Chapter 3: Dust\nHe left.\n\nChapter 4\nHe came.", "No heading here. ", "intro\n## Later  \nx\n## Again\ny", "", "  ## no heading\nz", "chapter 12\n")
LISTS = ('["Ash", " Teo ", ""]', "no list", '{"a": "b"}', "[]", '["b", 1]', "")
MESSAGES = ("Scene 2 contradicts an earlier fact: it was 'old', now 'Teo'.", "Mara Venn trusts Stonefield, now 'LIVES  in'.", "Isolde and Ash", "", "now 'stonefield hall'")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of an order's lines, a line each; every seventh is null."""
    x = A.drafts(spark, d).select("id", F.col("scene_id").alias("doc_id"), (F.col("id") % 1000).alias("r"), "pov")
    r = F.col("r")
    text = F.when(F.col("id") % 7 > 0, A._pick(MENTIONED, (F.col("doc_id") * 5 + r * r) % len(MENTIONED) + 1))
    return x.select("id", "doc_id", (r + F.col("doc_id") % 3 * (r % 2)).alias("sentence_index"), ((F.col("id") * 3) % 7 * 10 + r).alias("at"), text.alias("text"), "pov")


def _names(spark: SparkSession, d: str) -> DataFrame:
    x = _mentions(spark, d).where(F.col("text").isin(*NAMED))
    return x.select("doc_id", "sentence_index", "at", F.col("text").alias("surface"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("entity_id"))


CANDIDATES = (("Charlie", 0.9, True), ("renee", 0.7, False), ("Renee", 0.7, True), ("Isolde", 0.8, False), ("the door", 0.6, False), ("Teo", 0.95, True), ("teo", 0.5, False))
ROLES = (("dad", "Charlie"), ("Mom", "Renee"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    pool = F.array(*[F.struct(F.lit(s).alias("surface"), F.lit(c).alias("confidence"), F.lit(known).alias("known"), F.lit(i).alias("ord")) for i, (s, c, known) in enumerate(CANDIDATES)])
    x = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(pool).alias("c")).select("doc_id", "c.*")
    x = x.withColumn("entity_id", F.when(F.col("known"), F.col("doc_id") * 10 + F.col("ord")))
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(n).alias("name")) for r, n in ROLES])
    cast = o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("doc_id"), F.explode(roles).alias("r")).select("doc_id", "r.*")
    return coreference.resolved(_mentions(spark, d), _names(spark, d), x, cast)


def _spans(spark: SparkSession, d: str) -> DataFrame:
    x = A.drafts(spark, d)
    start = F.col("id") * 17 % 60
    source = A._pick(("rule", "tagger", "registry", "other"), F.col("id") * 3 % 4 + 1)
    return x.select("id", F.col("scene_id").alias("doc_id"), start.alias("start"), (start + F.col("id") % 9).alias("end"), F.col("subject").alias("surface"), source.alias("source"), "ord")


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    """Spans of which several name one place."""
    return coreference.one_a_span(_spans(spark, d).withColumns({"start": F.col("start") % 2, "end": F.lit(5), "surface": F.when(F.col("id") % 2 == 0, "Teo").otherwise(" teo")})).select("id", "source")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    label = F.when(F.col("event_id") % 5 > 0, F.col("event_type")).when(F.col("event_id") % 2 == 0, "")
    return coreference.runs(e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), label.alias("label")))


def _titled(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return review.titled(o.select(F.col("o_orderkey").alias("id"), A._pick(BLOCKS, F.col("o_orderkey") % len(BLOCKS) + 1).alias("text"))).drop("text")


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("id") % 7 > 0, A._pick(LISTS, F.col("id") % len(LISTS) + 1))
    return A.stories(spark, d).select("id", F.array_join(review.aliases(raw), ",").alias("aliases"))


def _guessed(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("plotline_fact", "world_rule", "event")
    x = A.surfaces(spark, d).withColumn("claim_type", F.explode(F.array(*[F.lit(k) for k in kinds])))
    return x.select("name", "claim_type", labels.guessed_type(F.col("name"), F.col("claim_type")).alias("entity_type")).distinct()


def _engine(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("id")
    x = A.stories(spark, d).select("id", F.when(c % 11 == 0, "timeout").alias("error"), A._pick(("openai", "hybrid", "rules"), c % 3 + 1).alias("source"), F.when(c % 5 > 0, c % 2 == 0).alias("tried"), F.when(c % 7 > 0, c % 4 == 0).alias("fell"))
    return x.select("id", labels.engine_label(F.col("error"), F.col("source"), F.col("tried"), F.col("fell")).alias("label"))


def _edge_labels(spark: SparkSession, d: str) -> DataFrame:
    x = A.drafts(spark, d).groupBy("scene_id").agg(F.sort_array(F.collect_set("predicate")).alias("ps"))
    return x.select("scene_id", labels.edge_label(F.col("ps"), F.lit("social")).alias("label"), labels.predicates_told(F.col("ps")).alias("predicates"))


def _stamps(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    told = F.when(F.col("event_id") % 9 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 2 == 0, "no time")
    return e.select("event_id", labels.stamp(told).alias("stamp"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return A.claims(spark, d).select("id", F.round(labels.node_size(F.col("confidence") * 120), 4).alias("size"), F.round(labels.edge_width(F.col("confidence") * 20), 4).alias("width"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    name = F.when(k % 10 > 0, F.concat("p_name", A._pick((".md", ".TXT", ".docx", ".pdf", "md"), k % 5 + 1)))
    kind = F.when(k % 3 > 0, A._pick(("text/csv", "application/msword", "image/png"), k % 7 % 3 + 1))
    return p.select("p_partkey", labels.is_manuscript(name, kind).alias("readable"))


def _suggestions(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.concat_ws(" ", "p_name", "p_name", "p_type", "p_name"), " ")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(labels.replacements(F.when(F.col("p_partkey") % 6 > 0, words)), " ").alias("shown"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    asked = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("story_id"), (F.col("o_orderkey") % 25).cast("string").alias("user"))
    return labels.answered(asked, A.stories(spark, d))


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return labels.first_events(e.select("event_id", (F.col("user_id") % 3).alias("scene_id"), F.col("event_type").alias("chunk"), F.col("event_id").alias("ord"))).select("event_id")


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    """Two words of each text, nearest to a place in it: every third a word in capitals, every fourth with wider white space."""
    i = F.col("doc_id")
    words = F.regexp_substr("text", F.lit(r"[a-zA-Z]+ [a-zA-Z]+"))
    quote = F.when(i % 4 == 0, F.replace(words, F.lit(" "), F.lit("  "))).when(i % 3 == 0, F.upper(F.substring_index(words, " ", 1))).otherwise(words)
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", anchors.nearest_quote(F.col("text"), quote, i * 31 % 997).alias("s"))
    return x.select("doc_id", "s.start", "s.length")


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("id")
    x = A.claims(spark, d).select(c.alias("issue_id"), "scene_id", F.when(c % 4 == 0, c).when(c % 4 == 1, c - 1000).alias("current_claim_id"), A._pick(MESSAGES, c % len(MESSAGES) + 1).alias("message"))
    return anchors.spoken_of(x, A.claims(spark, d))


def _strictly(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Once. "), F.when(F.col("id") % 3 == 0, F.upper("claim_text")).otherwise("She said so."))
    long = F.concat(F.col("claim_text"), F.repeat(F.lit(" and more"), F.lit(6)))
    return A.claims(spark, d).select("id", evidence.anchored_strictly(text, F.when(F.col("id") % 2 == 0, F.col("evidence_text")), F.when(F.col("id") % 5 > 0, F.col("claim_text")).otherwise(long)).alias("anchored"))


REJECTED = (("", "likes", "x"), ("Did not", "likes", "x"), ("Teo", "likes", ""), ("Teo", "father_of", ""), ("Teo", "likes", "Her hat"), ("Teo", "likes", "red  at all"), ("teo", "mother_of", " Teo"), ("Mara", "likes", "Teo"), ("doing", "likes", "all"))


def _rejected(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    parts = [A._pick(tuple(r[i] for r in REJECTED), k % len(REJECTED) + 1) for i in range(3)]
    how = lambda n: F.when(k % n == 0, "unresolved").otherwise("literal")
    return o.select(k.alias("id"), candidates.reject_reason(*parts, how(13), how(17)).alias("reason"))


def _narrators(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    status = F.when(F.col("id") % 3 == 0, "suggested").otherwise("approved")
    x = A.cast_claims(spark, d).withColumns({"scene_id": F.col("id"), "predicate": F.lit("Trusts"), "claim_type": F.lit("relationship_state"), "status": status})
    povs = x.select("scene_id", F.when(F.col("story_id") % 3 > 0, " isolde").alias("pov"))
    return folding.narrators_repointed(x, A.cast(spark, d), povs)


QUERIES: dict[str, Query] = {
    "joi_coreference": _resolved,
    "joi_outside_spans": lambda s, d: coreference.outside(_spans(s, d).where("ord % 2 = 0"), _spans(s, d).where("ord % 2 = 1")).select("id"),
    "win_one_a_span": _repeated,
    "win_label_runs": _runs,
    "win_chunk_sizes": lambda s, d: chapters.sizes(s.read.parquet(f"{d}/documents.parquet")),
    "src_scene_titles": _titled,
    "src_file_gate": _files,
    "jsn_aliases": _aliases,
    "ent_guessed_types": _guessed,
    "ent_narrators": lambda s, d: _narrators(s, d)[0].select("id", "subject_entity_id", "object_entity_id", "subject", "object", "status", "source_hash"),
    "ent_narrators_left": lambda s, d: _narrators(s, d)[1].select("id"),
    "str_engine_label": _engine,
    "str_edge_label": _edge_labels,
    "str_origin_breakdown": lambda s, d: labels.origin_breakdown(A.drafts(s, d)),
    "str_origin_label": lambda s, d: A.drafts(s, d).select("id", labels.origin_label(F.concat_ws("+", "generation_origin", F.when(F.col("id") % 2 == 0, "family"), F.when(F.col("id") % 5 == 0, "other"))).alias("label")),
    "dat_stamp": _stamps,
    "mth_sizes": _sizes,
    "srt_suggestions": _suggestions,
    "srt_events_shown": _events,
    "api_entities": lambda s, d: labels.entity_order(A.entities(s, d)),
    "api_story_answers": _answers,
    "agg_surfaces": lambda s, d: labels.surface_counts(A.told_names(s, d), "story_id"),
    "agg_extraction_totals": lambda s, d: labels.extraction_totals(A.drafts(s, d)),
    "evd_strictly": _strictly,
    "evd_nearest_quote": _nearest,
    "joi_issue_claim": _spoken,
    "flt_relation_reason": _rejected,
}

_q = A._quoted
_fill = "|".join(V.OBJECT_FILLERS)
_MENTION_SQL = f"""{A.DRAFT_SQL}, refs AS (SELECT id, scene_id AS doc_id, id % 1000 + scene_id % 3 * (id % 1000 % 2) AS sentence_index, (id * 3) % 7 * 10 + id % 1000 AS place,
  CASE WHEN id % 7 > 0 THEN ({_q(MENTIONED)})[(scene_id * 5 + (id % 1000) * (id % 1000)) % {len(MENTIONED)} + 1] END AS text, pov FROM drafts)"""
_UNTOLD = _KIND.replace(" WHEN lower(name) IN ('river', 'sea', 'forest') THEN 'character 0.55'", "")  # as no sentence is given
_gender = f"CASE WHEN split_part(lower(text), ' ', 1) IN {_in(coreference.FEMALE)} THEN 'female' WHEN split_part(lower(text), ' ', 1) IN {_in(coreference.MALE)} THEN 'male' ELSE 'unknown' END"
_spans_sql = f"{A.DRAFT_SQL}, sp AS (SELECT id, scene_id AS doc_id, id * 17 % 60 AS s, id * 17 % 60 + id % 9 AS e, ord, (['rule', 'tagger', 'registry', 'other'])[id * 3 % 4 + 1] AS source FROM drafts)"
_words = lambda x: f"lower(trim({x}))"
_pool = ", ".join(f"('{s}', {c}::DOUBLE, {known}, {i})" for i, (s, c, known) in enumerate(CANDIDATES))

ORACLES = {
    "joi_coreference": rf"""{_MENTION_SQL}, b AS (SELECT *, regexp_replace(regexp_replace(trim(coalesce(text, '')), '(?i)( ({_fill}))+$', ''), '(?i)^(({_fill}) )+(\S+ \S)', '\3') AS bare FROM refs),
m AS (SELECT *, split_part(lower(bare), ' ', 1) AS head FROM b),
n AS (SELECT doc_id, sentence_index, place, text AS surface, CASE WHEN id % 3 > 0 THEN id END AS entity_id, {_gender} AS gender FROM refs WHERE text IN {_in(NAMED)}),
w AS (SELECT *, CASE WHEN head IN ('he', 'him', 'his') THEN 'male' WHEN head IN ('she', 'her', 'hers') THEN 'female' WHEN head IN ('they', 'them', 'their', 'theirs') THEN 'plural' END AS want FROM m),
near AS (SELECT w.id, arg_max({{'s': n.surface, 'e': n.entity_id, 'g': n.gender}}, (n.sentence_index, n.place, n.surface)) AS a FROM w JOIN n ON n.doc_id = w.doc_id AND n.sentence_index BETWEEN w.sentence_index - 3 AND w.sentence_index
  AND (n.sentence_index < w.sentence_index OR n.place < w.place) AND (want = 'plural' OR n.gender IN (want, 'unknown')) GROUP BY 1),
pool(surface, confidence, known, ord) AS (VALUES {_pool}),
best AS (SELECT lower(surface) AS key, arg_max({{'s': surface, 'c': confidence, 'k': known, 'o': ord}}, (confidence, ord)) AS v FROM pool GROUP BY 1),
r AS (SELECT w.*, a, CASE WHEN o_custkey % 2 = 0 THEN CASE rtrim(head, '.,;:!?') WHEN 'dad' THEN 'Charlie' WHEN 'mom' THEN 'Renee' END END AS cast_name FROM w LEFT JOIN near ON near.id = w.id JOIN orders ON o_orderkey = doc_id),
k AS (SELECT *, CASE WHEN bare = '' THEN 'unresolved' WHEN head IN ('i', 'me', 'myself', 'my', 'mine') THEN CASE WHEN pov IS NULL THEN 'unresolved' ELSE 'pov' END
  WHEN want IS NOT NULL THEN CASE WHEN a IS NULL THEN 'unresolved' ELSE 'nearest_entity' END WHEN cast_name IS NOT NULL THEN 'cast' ELSE 'literal' END AS how FROM r),
l AS (SELECT k.*, v, CASE WHEN v.k THEN doc_id * 10 + v.o END AS known_id FROM k LEFT JOIN best ON key = lower(CASE how WHEN 'pov' THEN pov WHEN 'cast' THEN cast_name WHEN 'literal' THEN bare END))
SELECT id, doc_id, CASE how WHEN 'pov' THEN pov WHEN 'nearest_entity' THEN a.s WHEN 'cast' THEN cast_name WHEN 'literal' THEN coalesce(v.s, bare) END AS resolved, CASE WHEN how = 'nearest_entity' THEN a.e ELSE known_id END AS entity_id,
 CASE how WHEN 'unresolved' THEN 0::DOUBLE WHEN 'pov' THEN CASE WHEN head IN ('my', 'mine') THEN 0.9::DOUBLE ELSE 0.92::DOUBLE END WHEN 'cast' THEN 0.75::DOUBLE
  WHEN 'nearest_entity' THEN CASE WHEN want = 'plural' THEN 0.62::DOUBLE WHEN a.g = 'unknown' THEN 0.58::DOUBLE ELSE 0.72::DOUBLE END
  ELSE CASE WHEN known_id IS NOT NULL THEN v.c WHEN v IS NOT NULL THEN 0.85::DOUBLE WHEN bare[1] BETWEEN 'A' AND 'Z' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END END AS confidence,
 CASE WHEN how = 'literal' AND known_id IS NOT NULL THEN 'registry' ELSE how END AS method FROM l""",
    "joi_outside_spans": f"{_spans_sql} SELECT id FROM sp a WHERE ord % 2 = 0 AND NOT EXISTS (FROM sp b WHERE b.ord % 2 = 1 AND b.doc_id = a.doc_id AND b.s < a.e AND b.e > a.s)",
    "win_one_a_span": f"{_spans_sql} SELECT arg_min(id, (- list_position(['other', 'rule', 'tagger', 'registry'], source), ord)) AS id, arg_min(source, (- list_position(['other', 'rule', 'tagger', 'registry'], source), ord)) AS source FROM sp GROUP BY doc_id, s % 2",
    "win_label_runs": """WITH t AS (SELECT user_id AS doc_id, event_id AS pos, CASE WHEN event_id % 5 > 0 THEN event_type END AS label FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, label ORDER BY pos) AS g FROM t)
SELECT doc_id, label, min(pos) AS first, max(pos) AS last, count(*) AS n FROM g WHERE label IS NOT NULL GROUP BY doc_id, label, g""",
    "win_chunk_sizes": r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n_words FROM documents)
SELECT doc_id, n_words, CASE WHEN n_words <= 3000 THEN 1 ELSE len(list_filter(generate_series(0, n_words, 1300), lambda s: s = 0 OR s + 200 < n_words)) END AS n_chunks, n_words > 10000 AS long FROM n""",
    "src_scene_titles": rf"""WITH b AS (SELECT o_orderkey AS id, ({_q(BLOCKS)})[o_orderkey % {len(BLOCKS)} + 1] AS t FROM orders),
x AS (SELECT id, nullif(trim(regexp_extract(t, '(?m)^##\s+(.+?)(?:\n|$)', 1)), '') AS h, nullif(trim(regexp_extract(t, '(?im)^(Chapter\s+\d+[^\n]*)', 1)), '') AS c,
 trim(regexp_replace(regexp_replace(t, '(?m)^##\s+[^\n]*\n?', ''), '(?im)^Chapter\s+\d+[^\n]*\n?', ''), E' \n') AS body FROM b)
SELECT id, coalesce(h, c) AS title, body, CASE WHEN coalesce(h, c) IS NULL THEN body WHEN body = '' THEN coalesce(h, c) ELSE coalesce(h, c) || E'\n\n' || body END AS stored FROM x""",
    "src_file_gate": """WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN lower(p_name || (['.md', '.TXT', '.docx', '.pdf', 'md'])[p_partkey % 5 + 1]) ELSE '' END AS f,
 CASE WHEN p_partkey % 3 > 0 THEN (['text/csv', 'application/msword', 'image/png'])[p_partkey % 7 % 3 + 1] ELSE '' END AS k FROM part)
SELECT p_partkey, ends_with(f, '.md') OR ends_with(f, '.txt') OR ends_with(f, '.docx') OR k IN ('text/csv', 'application/msword') AS readable FROM f""",
    "jsn_aliases": f"{A.SQL} SELECT id, CASE WHEN id % 7 = 0 THEN '' ELSE (['Ash,Teo', '', '', '', 'b,1', ''])[id % {len(LISTS)} + 1] END AS aliases FROM stories",
    "ent_guessed_types": rf"""{A.SURFACE_SQL}, n AS (SELECT DISTINCT name, 'unknown' AS role FROM surfaces), k AS (SELECT name, split_part({_UNTOLD}, ' ', 1) AS k FROM n)
SELECT name, claim_type, CASE WHEN k = 'character' AND claim_type = 'world_rule' THEN CASE WHEN regexp_matches(lower(name), '\b(city|kingdom|land|hall|castle)\b') THEN 'place' ELSE 'object' END
 WHEN k = 'character' AND claim_type = 'plotline_fact' THEN 'group' ELSE k END AS entity_type FROM k, (VALUES ('plotline_fact'), ('world_rule'), ('event')) v(claim_type)""",
    "str_engine_label": """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'failed' WHEN c_custkey % 3 = 0 THEN 'AI + rules' WHEN c_custkey % 3 = 1 THEN 'AI + rules (partial fallback)'
 WHEN c_custkey % 5 > 0 AND c_custkey % 2 = 0 AND NOT (c_custkey % 7 > 0 AND c_custkey % 4 = 0) THEN 'AI' ELSE 'rules only (no AI key or LLM skipped)' END AS label FROM customer""",
    "str_edge_label": f"""{A.DRAFT_SQL}, g AS (SELECT scene_id, list_sort(list_distinct(list(replace(predicate, '_', ' ')))) AS ps FROM drafts GROUP BY 1)
SELECT scene_id, CASE WHEN len(ps) = 1 THEN upper(ps[1][1]) || ps[1][2:] ELSE 'Social' END AS label, array_to_string(ps, ', ') AS predicates FROM g""",
    "str_origin_breakdown": f"""{A.DRAFT_SQL}, n AS (SELECT scene_id, generation_origin AS o, count(*) AS n FROM drafts GROUP BY ALL)
SELECT scene_id, string_agg(n || ' ' || CASE o WHEN 'structural' THEN 'rules · pattern' WHEN 'llm' THEN 'ai (llm refine)' WHEN 'llm_recall' THEN 'ai · recall' ELSE 'fastus grounded' END, ' · ' ORDER BY n DESC, o) AS breakdown FROM n GROUP BY 1""",
    "str_origin_label": f"""{A.DRAFT_SQL} SELECT id, CASE generation_origin WHEN 'structural' THEN 'Rules · pattern' WHEN 'llm' THEN 'AI (LLM refine)' WHEN 'llm_recall' THEN 'AI · recall' ELSE 'FASTUS grounded' END
 || CASE WHEN id % 2 = 0 THEN ' + Rules · family' ELSE '' END || CASE WHEN id % 5 = 0 THEN ' + other' ELSE '' END AS label FROM drafts""",
    "dat_stamp": "SELECT event_id, CASE WHEN event_id % 9 > 0 THEN strftime(ts, '%b %-d, %I:%M %p') END AS stamp FROM events",
    "mth_sizes": f"{A.SQL} SELECT id, round(56 + least(48::DOUBLE, confidence::DOUBLE * 120 * 0.45::DOUBLE), 4) AS size, round(least(5::DOUBLE, 1.25::DOUBLE + confidence::DOUBLE * 20 * 0.22::DOUBLE), 4) AS width FROM claims",
    "srt_suggestions": "SELECT p_partkey, CASE WHEN p_partkey % 6 > 0 THEN array_to_string(string_split(p_name || ' ' || p_name || ' ' || p_type || ' ' || p_name, ' ')[1:5], ' ') ELSE '' END AS shown FROM part",
    "srt_events_shown": """WITH c AS (SELECT event_id, user_id % 3 AS s FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY event_id) <= 40)
SELECT event_id FROM c QUALIFY row_number() OVER (PARTITION BY s ORDER BY event_id) <= 120""",
    "api_entities": f"{A.SQL} SELECT story_id, id, canonical_name, row_number() OVER (PARTITION BY story_id ORDER BY canonical_name, id) AS place FROM entities",
    "api_story_answers": "SELECT o_orderkey AS request_id, CASE WHEN c_custkey IS NULL THEN 404::BIGINT ELSE 200::BIGINT END AS code, c_name AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey = o_orderkey % 25",
    "agg_surfaces": f"WITH n AS (SELECT o_custkey AS story_id, ({_q(A.CAST + A.MENTIONS + A.SURFACES)})[o_orderkey * 5 % {len(A.CAST + A.MENTIONS + A.SURFACES)} + 1] AS name FROM orders) SELECT story_id, count(DISTINCT nullif({_norm('name')}, '')) AS n_surfaces FROM n GROUP BY 1",
    "agg_extraction_totals": f"""{A.DRAFT_SQL} SELECT scene_id, count(*) AS n_drafts, count(*) FILTER (generation_origin = 'llm_recall') AS n_recalled, count(*) FILTER (generation_origin = 'llm') AS n_model,
 count(*) FILTER (generation_origin = 'structural') AS n_rules, count(*) FILTER (anchored) AS n_anchored FROM drafts GROUP BY 1""",
    "evd_strictly": f"""{A.SQL}, t AS (SELECT id, lower('Once. ' || CASE WHEN id % 3 = 0 THEN claim_text ELSE 'She said so.' END) AS t, lower(CASE WHEN id % 2 = 0 THEN evidence_text END) AS e,
 lower(CASE WHEN id % 5 > 0 THEN claim_text ELSE claim_text || repeat(' and more', 6) END) AS c FROM claims)
SELECT id, coalesce(contains(t, e), false) OR contains(t, c) OR (length(c) > 48 AND contains(t, trim(left(c, 48)))) AS anchored FROM t""",
    # A quote with wider white space stands nowhere as it is: its matches may differ in white space and don't overlap.
    "evd_nearest_quote": r"""WITH q AS (SELECT doc_id, text, doc_id * 31 % 997 AS p, regexp_extract(text, '[a-zA-Z]+ [a-zA-Z]+') AS w FROM documents),
r AS (SELECT *, lower(text) AS low, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 THEN lower(split_part(w, ' ', 1)) ELSE lower(w) END AS k FROM q WHERE w <> ''),
f AS (SELECT doc_id, p, length(k) AS n, list_filter(generate_series(1, length(low) - length(k) + 1), lambda i: substr(low, i, length(k)) = k) AS hits FROM r WHERE doc_id % 4 <> 0),
l AS (SELECT doc_id, p, regexp_split_to_array(low, replace(k, ' ', '\s+')) AS gaps, regexp_extract_all(low, replace(k, ' ', '\s+')) AS m FROM r WHERE doc_id % 4 = 0),
lj AS (SELECT *, unnest(generate_series(1, len(m))) AS j FROM l),
b AS (SELECT doc_id, n, p, unnest(hits) - 1 AS s FROM f UNION ALL
 SELECT doc_id, length(m[j]), p, (list_sum(list_transform(gaps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0))::BIGINT FROM lj),
g AS (SELECT doc_id, arg_min(s, (abs(s - p), s)) AS start, arg_min(n, (abs(s - p), s)) AS length FROM b GROUP BY 1)
SELECT d.doc_id, start, length FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "joi_issue_claim": f"""{A.SQL}, i AS (SELECT id AS issue_id, scene_id, CASE WHEN id % 4 = 0 THEN id WHEN id % 4 = 1 THEN id - 1000 END AS own, ({_q(MESSAGES)})[id % {len(MESSAGES)} + 1] AS m FROM claims),
a AS (SELECT *, {_norm("m")} AS said, {_norm("regexp_extract(m, 'now ''([^'']+)''', 1)")} AS now FROM i),
s AS (SELECT a.issue_id, c.id, c.id = coalesce(own, -1) AS is_own, c.status NOT IN ('rejected', 'deprecated') AS live, CASE WHEN now = '' THEN 0 ELSE
  CASE WHEN lower(predicate) = now THEN 90 WHEN contains(lower(predicate), now) OR contains(now, lower(predicate)) THEN 45 ELSE 0 END + CASE WHEN lower(object) = now THEN 90 WHEN contains(lower(object), now) OR contains(now, lower(object)) THEN 45 ELSE 0 END END
  + CASE WHEN contains(said, lower(subject)) THEN 20 ELSE 0 END + CASE WHEN contains(said, lower(object)) THEN 20 ELSE 0 END + 10 AS score FROM a JOIN claims c ON c.scene_id = a.scene_id)
SELECT issue_id, coalesce(max(id) FILTER (is_own), arg_min(id, (-score, id)) FILTER (live AND score >= 50)) AS claim_id FROM s GROUP BY 1""",
    "flt_relation_reason": f"""WITH x AS (SELECT o_orderkey AS id, {", ".join(f"trim(lower(({_q(tuple(r[i] for r in REJECTED))})[o_orderkey % {len(REJECTED)} + 1])) AS {n}" for i, n in enumerate("spo"))} FROM orders)
SELECT id, CASE WHEN s = '' THEN 'missing subject' WHEN s = 'did not' THEN 'auxiliary/fragment subject' WHEN id % 13 = 0 THEN 'unresolved pronoun subject' WHEN id % 17 = 0 THEN 'unresolved pronoun object'
 WHEN o = '' AND p = 'likes' THEN 'missing object' WHEN split_part(o, ' ', 1) = 'her' THEN 'unresolved pronoun object' WHEN o = 'red  at all' THEN 'junk object fragment' WHEN s = o AND p = 'mother_of' THEN 'self-referential family relation' END AS reason FROM x""",
}
_id = "story_id * 100 + 4"
_told_sql = f"""{A.CAST_SQL}, n AS (SELECT *, s % 100 IN (10, 15) AS ns, t % 100 IN (10, 15) AS nt, story_id % 3 > 0 AS told FROM cast_claims),
r AS (SELECT id, story_id, ns, nt, told, CASE WHEN ns AND told THEN {_id} ELSE s END AS s, CASE WHEN nt AND told THEN {_id} ELSE t END AS t FROM n)"""
ORACLES |= {
    "ent_narrators": f"""{_told_sql} SELECT id, s AS subject_entity_id, t AS object_entity_id, ({_q(A.CAST)})[s % 100] AS subject, ({_q(A.CAST)})[t % 100] AS object,
 CASE WHEN id % 3 <> 0 THEN 'approved' WHEN (ns OR nt) AND NOT told THEN 'needs_review' ELSE 'suggested' END AS status, CASE WHEN (ns OR nt) AND told THEN sha256(s || '|trusts|' || t || '|relationship_state')[1:32] END AS source_hash FROM r""",
    "ent_narrators_left": f"{_told_sql} SELECT id FROM cast0 WHERE canonical_name NOT IN ('Narrator', 'my') OR id IN (SELECT s FROM r) OR id IN (SELECT t FROM r)",
}


#: Kinds of marks in a text, topmost first; the events' kinds stand for them.
MARKS = ("error", "purchase", "signup", "click")
_LENGTH = 4000


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    e = A._table(spark, d, "events")
    spans = e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") * 37 % 5000 - 50).alias("start"), (F.col("event_id") % 60).alias("length"), F.col("event_type").alias("kind"))
    return editor.labelled_segments(spans, e.select(F.col("user_id").alias("doc_id"), F.lit(_LENGTH).alias("length")).distinct(), MARKS).withColumn("kinds", F.array_join("kinds", ","))


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    """Three places in each text, one of them maybe behind it."""
    t, k = A._table(spark, d, "documents"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return t.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), k.alias("k")).select("doc_id", ((F.col("doc_id") * 7919 + F.col("k") * 104729) % (F.col("n") + 10)).alias("offset"))


QUERIES |= {
    "ui_labelled_segments": _labelled,
    "joi_sentence_at": lambda s, d: chapters.sentence_at(A._table(s, d, "documents"), _offsets(s, d)),
}

#: Sentences for DuckDB. Marks that begin a text belong to none; behind them sentences tile it.
_SENTENCES = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS (SELECT doc_id, length(regexp_extract(text, '^[.!?]*')) AS head, regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)') AS p FROM t),
u AS (SELECT doc_id, head, unnest(p) AS s, unnest(generate_series(0, len(p) - 1)) AS i FROM p),
s AS (SELECT doc_id, i, s, head + coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM u)"""

ORACLES |= {
    "txt_sentences": _SENTENCES + r" SELECT doc_id, i AS sentence_index, a::BIGINT AS start, length(s) AS length FROM s WHERE regexp_matches(s, '\S')",
    "joi_sentence_at": _SENTENCES + r""", k AS (SELECT DISTINCT doc_id, (doc_id * 7919 + unnest([0, 1, 2]) * 104729) % (length(text) + 10) AS o FROM t)
SELECT k.doc_id, k.o AS "offset", CASE WHEN o < a + length(s) AND regexp_matches(s, '\S') THEN i ELSE 0 END AS sentence_index FROM k ASOF LEFT JOIN s ON s.doc_id = k.doc_id AND s.a <= k.o""",
    "ui_labelled_segments": f"""WITH m AS (SELECT user_id AS doc_id, greatest(event_id * 37 % 5000 - 50, 0) AS a, least(event_id * 37 % 5000 - 50 + event_id % 60, {_LENGTH}) AS b, event_type AS kind FROM events WHERE event_type IN {_in(MARKS)}),
k AS (SELECT * FROM m WHERE a < b), e AS (SELECT doc_id, a AS edge FROM k UNION SELECT doc_id, b FROM k UNION SELECT user_id, unnest([0, {_LENGTH}]) FROM events),
g AS (SELECT doc_id, edge AS start, lead(edge) OVER (PARTITION BY doc_id ORDER BY edge) AS stop FROM e),
c AS (SELECT g.doc_id, g.start, stop, array_to_string(list_filter({A._list(MARKS)}, lambda x: list_contains(coalesce(list(kind), []), x)), ',') AS kinds FROM g LEFT JOIN k ON k.doc_id = g.doc_id AND a < stop AND b > g.start WHERE stop IS NOT NULL GROUP BY ALL)
SELECT doc_id, start, stop AS "end", kinds, nullif(split_part(kinds, ',', 1), '') AS top FROM c""",
}


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of the texts' sentences with made-up heads: mostly a few places before, some behind, some their own, some nowhere."""
    docs = A._spread(A._table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    pieces = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^.!?]+(?:[.!?]+|$)"), F.lit(0))).alias("sentence_index", "s"))
    w = pieces.select("doc_id", "sentence_index", F.posexplode(F.regexp_extract_all("s", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("i", "text"))
    i = F.col("i")
    head = F.when(i == 0, -1).when(i % 11 == 5, i + 1).when(i % 13 == 7, i).otherwise(i - 1 - (i * 7 + F.col("doc_id")) % 3)
    dep = F.element_at(F.array(*[F.lit(x) for x in ("nsubj", "dobj", "prep", "det")]), (i % 4 + 1).cast("int"))
    return w.withColumns({"head": head.cast("int"), "dep": dep})


def _subtrees(spark: SparkSession, d: str) -> DataFrame:
    return trees.subtrees(_tokens(spark, d)).withColumn("indices", F.array_join("indices", ","))


QUERIES |= {"arr_subtrees": _subtrees, "arr_phrases": lambda s, d: trees.phrases(_tokens(s, d), ("dobj", "prep")).withColumn("indices", F.array_join("indices", ","))}

_TOKENS = r"""WITH RECURSIVE p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?]+(?:[.!?]+|$)') AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS s, unnest(generate_series(0, len(p) - 1))::INTEGER AS n FROM p), v AS (SELECT doc_id, n, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS w FROM u),
x AS (SELECT doc_id, n, unnest(w) AS word, unnest(generate_series(0, len(w) - 1))::INTEGER AS i, len(w) AS size FROM v),
t AS MATERIALIZED (SELECT *, CASE WHEN i = 0 THEN -1 WHEN i % 11 = 5 THEN i + 1 WHEN i % 13 = 7 THEN i ELSE i - 1 - (i * 7 + doc_id) % 3 END AS head, (['nsubj', 'dobj', 'prep', 'det'])[i % 4 + 1] AS dep FROM x)"""

ORACLES |= {
    "arr_subtrees": _TOKENS + """, way AS (SELECT doc_id, n, i, i AS at_, 0 AS d FROM t UNION SELECT way.doc_id, way.n, way.i, t.head, d + 1 FROM way JOIN t ON t.doc_id = way.doc_id AND t.n = way.n AND t.i = at_ WHERE d < 8 AND t.head >= 0 AND t.head < t.size),
r AS (SELECT DISTINCT doc_id, n, at_, i FROM way)
SELECT r.doc_id, r.n AS sentence_index, at_::INTEGER AS root, string_agg(r.i::VARCHAR, ',' ORDER BY r.i) AS indices, string_agg(word, ' ' ORDER BY r.i) AS text FROM r JOIN t ON t.doc_id = r.doc_id AND t.n = r.n AND t.i = r.i GROUP BY 1, 2, 3""",
    "arr_phrases": _TOKENS + """, r AS (SELECT doc_id, n, i AS root, i FROM t UNION SELECT doc_id, n, head, i FROM t WHERE dep IN ('dobj', 'prep') AND head >= 0 AND head < size)
SELECT doc_id, n AS sentence_index, root::INTEGER AS root, string_agg(i::VARCHAR, ',' ORDER BY i) AS indices FROM r GROUP BY 1, 2, 3""",
}


def _writing_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of writing, one an event, with a fingerprint."""
    e = A._table(spark, d, "events")
    mark = editor.fingerprint(F.col("event_type"), F.concat(F.lit("  Says "), F.col("props")), F.round("value", 0).cast("int").cast("string"))
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("issue_id"), mark.alias("fingerprint"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with few numbers, so that some have one number."""
    return A.scenes(spark, d).withColumn("scene_number", (F.col("id") % 5).cast("int"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("hard_contradiction", "soft_tension", "compatible", "duplicate")])
    i = A.stored_issues(spark, d)
    return i.withColumns({"judge_classification": F.when(F.col("id") % 9 > 0, F.element_at(kinds, (F.col("id") % 4 + 1).cast("int"))), "created_at": F.when(F.col("id") % 8 > 0, F.col("id") * 7919 % 1000)})


QUERIES |= {
    "ui_undismissed": lambda s, d: editor.undismissed(_writing_issues(s, d), _writing_issues(s, d).where("issue_id % 3 = 0")).select("doc_id", "issue_id", "fingerprint"),
    "api_taken_numbers": lambda s, d: review.taken_numbers(_numbered(s, d)),
    "evd_anchors": lambda s, d: evidence.anchors(A.claims(s, d).withColumn("evidence_text", F.when(F.col("id") % 6 == 0, "Zzz qqq.").otherwise(F.col("evidence_text"))).withColumns({c: F.when(F.col("id") % 6 == 0, "xyz").otherwise(F.col(c)) for c in ("claim_text", "object")}), _told_scenes(s, d)),
    "flt_shown": lambda s, d: review.shown(_judged(s, d)).select("id", "judge_classification"),
    "srt_issues_detected": lambda s, d: review.in_detection_order(_judged(s, d)),
    "win_first_drafts": lambda s, d: candidates.first_drafts(candidates.drafts(candidates.relations(A.tales(s, d), pov_col="pov"))).select("doc_id", "place", "start", "subject", "predicate", "target", "polarity"),
}


def _told_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes that tell their claims, one sentence each."""
    c = A.claims(spark, d).groupBy("scene_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "claim_text"))), lambda x: F.concat(x["claim_text"], F.lit("."))), " ").alias("text"))
    return c.select(F.col("scene_id").alias("id"), "text")


_JUDGED = f"""{A.SQL}{A.ISSUE_SQL}, j AS (SELECT *, CASE WHEN id % 9 > 0 THEN (['hard_contradiction', 'soft_tension', 'compatible', 'duplicate'])[id % 4 + 1] END AS judge_classification, CASE WHEN id % 8 > 0 THEN id * 7919 % 1000 END AS created_at FROM stored_issues)"""

ORACLES |= {
    "ui_undismissed": """WITH w AS (SELECT user_id AS doc_id, event_id AS issue_id, event_type || '|' || round(value, 0)::INTEGER || '|says ' || lower(props) AS fingerprint FROM events)
SELECT doc_id, issue_id, fingerprint FROM w ANTI JOIN (SELECT doc_id, fingerprint FROM w WHERE issue_id % 3 = 0) x USING (doc_id, fingerprint)""",
    "api_taken_numbers": f"{A.SQL} SELECT story_id, (id % 5)::INTEGER AS scene_number, count(*) AS n FROM scenes GROUP BY 1, 2 HAVING count(*) > 1",
    "evd_anchors": f"""{A.SQL}, t AS (SELECT scene_id, string_agg(claim_text || '.', ' ' ORDER BY id) AS text FROM claims GROUP BY 1),
q AS (SELECT c.id, c.scene_id, text, CASE WHEN c.id % 6 = 0 THEN NULL WHEN contains(text, evidence_text) THEN evidence_text ELSE claim_text END AS q FROM claims c JOIN t ON t.scene_id = c.scene_id)
SELECT id, scene_id, CASE WHEN q IS NULL THEN 0 ELSE instr(lower(text), lower(q)) - 1 END AS text_offset, coalesce(length(q), 0) AS anchor_length, CASE WHEN q IS NULL THEN 'Zzz qqq.' ELSE substr(text, instr(lower(text), lower(q)), length(q)) END AS anchor_text FROM q""",
    "flt_shown": f"{_JUDGED} SELECT id, judge_classification FROM j WHERE judge_classification IN ('hard_contradiction', 'soft_tension')",
    "srt_issues_detected": f"{_JUDGED} SELECT id, story_id, row_number() OVER (PARTITION BY story_id ORDER BY created_at NULLS FIRST, id) AS place FROM j",
    "win_first_drafts": f"""WITH RECURSIVE d AS ({_EARLIER["cnd_drafts"]}), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id, lower(subject), claim_type, lower(predicate), lower(target), polarity ORDER BY start, "end", subject, predicate, target) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", subject, predicate, target) - 1 AS place, start, subject, predicate, target, polarity FROM f""",
}
