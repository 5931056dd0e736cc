"""Queries of what a reviewer reads and decides, by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review, validate
from . import adapters as A
from .oracle import _issues, _norm

Query = Callable[[SparkSession, str], DataFrame]


def _texts(prepared: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = validate.pairs(prepared(spark, d, more=("evidence_text", "claim_text")))
        ids = found.withColumns({"current_claim_id": F.col("n.id"), "conflicting_claim_id": F.col("o.id")})
        return review.explained_pairs(ids, "current_claim_id", "conflicting_claim_id", "conflict_kind")

    return run


def _nested(spark: SparkSession, d: str) -> DataFrame:
    x = review.scene_with_claims(A.scenes(spark, d), A.claims(spark, d))
    told = F.array_join(F.transform("claims", lambda c: F.concat_ws(" ", c["id"].cast("string"), c["subject"], c["status"])), ", ")
    return x.select("id", "scene_number", told.alias("claims"))


def _removed(spark: SparkSession, d: str) -> DataFrame:
    """What is left when each tenth scene goes."""
    scenes = A.scenes(spark, d)
    left = review.without_scenes(scenes.where("id % 10 = 0").select(F.col("id").alias("scene_id")), scenes, A.claims(spark, d), A.stored_issues(spark, d))
    rows = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in zip(("scene", "claim", "issue"), left, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _changed(spark: SparkSession, d: str) -> DataFrame:
    stories = A.stories(spark, d).withColumn("description", F.concat(F.lit("About "), "title"))
    text = F.when(F.col("id") % 3 == 0, F.lit("  ")).when(F.col("id") % 3 == 1, F.concat(F.lit(" New "), F.col("title")))
    changes = stories.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.concat("title", F.lit(" II"))).alias("title"), text.alias("description"), (F.col("id") % 5 > 0).alias("has_description"))
    return review.updated_stories(stories, changes)


def _manual(spark: SparkSession, d: str) -> DataFrame:
    x = A.drafts(spark, d).withColumns({"object": F.when(F.col("id") % 9 > 0, F.col("target")).otherwise(" ")})
    return review.manual_rows(x).select("id", "subject", "object", "status", "source", "confidence", "claim_version")


def _inserted(spark: SparkSession, d: str) -> DataFrame:
    x = A.claims(spark, d).withColumn("review_status", F.when(F.col("id") % 4 == 0, F.lit("needs_review")).when(F.col("id") % 4 == 1, F.lit(" ")))
    return review.inserted_rows(x).select("id", "status", "is_major_plotline", "claim_version", "valid_from_scene", "confidence_history")


def _again(spark: SparkSession, d: str) -> DataFrame:
    """Histories of claims that are told a second time, some of them over what is no list."""
    first = review.history(F.col("confidence"), F.col("scene_id"), F.lit(1))
    before = F.when(F.col("id") % 3 == 0, "no list").when(F.col("id") % 3 == 1, first)
    return A.claims(spark, d).select("id", review.history(F.col("confidence") / 3, F.col("scene_id"), F.lit(2), before).alias("confidence_history"))


def _pruned(spark: SparkSession, d: str) -> DataFrame:
    claims = A.claims(spark, d).withColumn("source", F.when(F.col("id") % 3 == 0, "manual").otherwise("extracted"))
    stale, touched = claims.where("id % 2 = 0"), claims.where("id % 5 = 0")
    left = review.pruned(claims, A.stored_issues(spark, d), stale, touched)
    return left[0].select(F.lit("claim").alias("kind"), "id").unionByName(left[1].select(F.lit("issue").alias("kind"), "id"))


def _origins(spark: SparkSession, d: str) -> DataFrame:
    x = review.origin_counts(A.drafts(spark, d))
    return x.select("scene_id", F.array_join(F.transform(F.map_entries("generation_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


def _edits(spark: SparkSession, d: str) -> DataFrame:
    x = A.claims(spark, d).select("id", review.edit_span(F.col("claim_text"), F.when(F.col("id") % 3 == 0, F.col("evidence_text")).otherwise(F.replace("claim_text", F.lit("a"), F.lit("oo")))).alias("e"))
    return x.select("id", F.col("e.start").cast("long").alias("start"), F.col("e.before_end").cast("long").alias("before_end"), F.col("e.after_end").cast("long").alias("after_end"))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_-")), F.when(F.col("p_partkey") % 2 == 0, ".MD").otherwise(".docx"))
    return p.select("p_partkey", review.file_title(name).alias("title"))


def _refined(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return A.claims(spark, d).select("id", review.refined_predicate(c("predicate"), c("object"), c("evidence_text")).alias("predicate"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("character_goal", "relationship_change", "power_rule", "event", "other")
    return review.accepted_groups(A.claims(spark, d).withColumn("claim_type", F.when(F.col("id") % 6 < 5, A._pick(kinds, F.col("id") % 6 + 1))))


def queries(prepared: Callable[..., DataFrame]) -> dict[str, Query]:
    over = lambda f, *tables: lambda s, d: f(*(t(s, d) for t in tables))
    return {
        "api_issue_texts": _texts(prepared),
        "api_scene_claims": _nested,
        "api_issue_scenes": over(review.issue_scenes, A.stored_issues, A.claims, A.scenes),
        "api_stories": over(review.story_order, A.stories, A.scenes),
        "api_delete_scenes": _removed,
        "api_update_stories": _changed,
        "srt_issues": lambda s, d: review.in_text_order(review.issue_scenes(A.stored_issues(s, d), A.claims(s, d), A.scenes(s, d))),
        "agg_issue_buckets": over(review.issue_buckets, A.stored_issues),
        "agg_claim_groups": _groups,
        "agg_origin_counts": _origins,
        "snk_manual_rows": _manual,
        "snk_extracted_rows": _inserted,
        "jsn_history": _again,
        "mrg_pruned": _pruned,
        "str_edit_span": _edits,
        "str_refined_location": _refined,
        "src_file_title": _titles,
    }


_Q = lambda x: x.replace("'", "''")
_quote = lambda a: f"left(CASE WHEN trim(coalesce({a}.evidence_text, '')) <> '' THEN trim({a}.evidence_text) ELSE trim(coalesce({a}.claim_text, '')) END, 500)"
_fact = lambda a: f"CASE WHEN NOT {a}.polarity THEN 'NOT (' || {a}.subject || ' ' || {a}.predicate || ' ' || {a}.object || ')' ELSE {a}.subject || ' ' || {a}.predicate || ' ' || {a}.object END"
_history = "'[{\"version\":1,\"confidence\":' || (CASE WHEN confidence = 1 THEN '1.0' ELSE confidence::VARCHAR END) || ',\"scene_id\":' || scene_id || '}]'"
_HEAD = A.SQL + A.ISSUE_SQL

ORACLES = {
    "api_issue_texts": _issues(f"""SELECT i.current_claim_id, i.conflicting_claim_id, i.conflict_kind, {_quote("o")} AS conflicting_evidence_text, {_quote("n")} AS current_evidence_text,
 'Earlier: "' || {_quote("o")} || '" → Now: "' || {_quote("n")} || '"' AS evidence_comparison,
 CASE conflict_kind WHEN 'polarity_flip' THEN 'The same fact appears asserted and negated: ''' || ({_fact("o")}) || ''' conflicts with ''' || ({_fact("n")}) || '''.'
  WHEN 'exclusive_object' THEN 'Exclusive fact ''' || n.predicate || ''' cannot hold two values at once: was ''' || o.object || ''', now ''' || n.object || '''.'
  ELSE 'Opposite relationship stances on the same pair: earlier ''' || o.predicate || ''' vs now ''' || n.predicate || '''.' END AS explanation,
 CASE conflict_kind WHEN 'polarity_flip' THEN 'Decide which version is canon. If the negation is correct, deprecate or reject the earlier claim (''' || o.subject || ' ' || o.predicate || ' ' || o.object || ''') or add bridging prose that explains the reversal.'
  WHEN 'exclusive_object' THEN 'Pick one value as canon for ''' || n.predicate || ''' (''' || o.object || ''' vs ''' || n.object || '''), or add a scene that explains the change (move, breakup, revelation, etc.).'
  ELSE 'If this is intentional emotional progression, add a bridging beat between ''' || o.predicate || ''' and ''' || n.predicate || '''. Otherwise adjust one claim or mark the earlier stance as superseded.' END AS suggested_fix
 FROM issues i JOIN claims n ON n.id = i.current_claim_id JOIN claims o ON o.id = i.conflicting_claim_id"""),
    "api_scene_claims": f"{A.SQL} SELECT s.id, scene_number, coalesce(string_agg(c.id || ' ' || subject || ' ' || status, ', ' ORDER BY c.id), '') AS claims FROM scenes s LEFT JOIN claims c ON c.scene_id = s.id GROUP BY ALL",
    "api_issue_scenes": f"{_HEAD} SELECT i.*, s.scene_number, t.scene_number AS conflicting_scene_number FROM stored_issues i LEFT JOIN scenes s ON s.id = i.scene_id LEFT JOIN claims o ON o.id = i.conflicting_claim_id LEFT JOIN scenes t ON t.id = o.scene_id",
    "api_stories": f"{A.SQL} SELECT owner_user_id, st.id, (SELECT count(*) FROM scenes s WHERE s.story_id = st.id) AS scene_count, row_number() OVER (PARTITION BY owner_user_id ORDER BY st.id DESC) AS place FROM stories st",
    "api_delete_scenes": f"""{_HEAD}, gone AS (SELECT id FROM claims WHERE scene_id % 10 = 0) SELECT 'scene' AS kind, id FROM scenes WHERE id % 10 <> 0 UNION ALL SELECT 'claim', id FROM claims WHERE scene_id % 10 <> 0
 UNION ALL SELECT 'issue', id FROM stored_issues WHERE scene_id % 10 <> 0 AND current_claim_id NOT IN (FROM gone) AND conflicting_claim_id NOT IN (FROM gone)""",
    "api_update_stories": f"""{A.SQL} SELECT id, CASE WHEN id % 4 = 0 THEN title || ' II' ELSE title END AS title,
 CASE WHEN id % 2 = 0 AND id % 5 > 0 THEN CASE WHEN id % 3 = 1 THEN 'New ' || title END ELSE 'About ' || title END AS description FROM stories""",
    "srt_issues": f"{_HEAD} SELECT i.id, i.story_id, row_number() OVER (PARTITION BY i.story_id ORDER BY scene_number, coalesce(text_offset, 0), i.id) AS place FROM stored_issues i JOIN scenes s ON s.id = i.scene_id",
    "agg_issue_buckets": f"{_HEAD} SELECT story_id, count(*) FILTER (resolution_status IS NULL OR resolution_status NOT IN ('fixed', 'rejected')) AS open, count(*) FILTER (resolution_status IN ('fixed', 'rejected')) AS resolved FROM stored_issues GROUP BY 1",
    "agg_claim_groups": f"""{A.SQL} SELECT story_id, CASE id % 6 WHEN 1 THEN 'relationships' WHEN 2 THEN 'world' WHEN 3 THEN 'plot' ELSE 'characters' END AS claim_group, count(*) AS n FROM claims WHERE status IN ('approved', 'canonized') GROUP BY ALL""",
    "agg_origin_counts": f"{A.DRAFT_SQL} SELECT scene_id, string_agg(generation_origin || '=' || n, ',' ORDER BY generation_origin) AS counts FROM (SELECT scene_id, generation_origin, count(*) AS n FROM drafts GROUP BY ALL) GROUP BY 1",
    "snk_manual_rows": f"""{A.DRAFT_SQL} SELECT id, trim(subject) AS subject, trim(target) AS object, 'approved' AS status, 'manual' AS source, 1.0::DOUBLE AS confidence, 1 AS claim_version FROM drafts
 WHERE id % 9 > 0 AND {_norm("subject")} NOT IN ('narrator', 'i', 'me', 'myself', 'my', 'mine') AND {_norm("target")} NOT IN ('narrator', 'i', 'me', 'myself', 'my', 'mine')""",
    "snk_extracted_rows": f"""{A.SQL} SELECT id, CASE WHEN id % 4 = 0 THEN 'needs_review' WHEN confidence >= 0.9::DOUBLE THEN 'approved' WHEN confidence >= 0.65::DOUBLE THEN 'needs_review' ELSE 'suggested' END AS status,
 canon_level = 'core' AS is_major_plotline, 1 AS claim_version, scene_id AS valid_from_scene, {_history} AS confidence_history FROM claims""",
    "jsn_history": f"""{A.SQL} SELECT id, CASE WHEN id % 3 = 1 THEN left({_history}, -1) || ',' ELSE '[' END || '{{"version":2,"confidence":' || round(confidence / 3, 4)::VARCHAR || ',"scene_id":' || scene_id || '}}]' AS confidence_history FROM claims""",
    "mrg_pruned": f"""{_HEAD}, gone AS (SELECT id FROM claims WHERE id % 2 = 0 AND id % 3 <> 0 AND id % 5 <> 0) SELECT 'claim' AS kind, id FROM claims WHERE id NOT IN (FROM gone)
 UNION ALL SELECT 'issue', id FROM stored_issues WHERE current_claim_id NOT IN (FROM gone) AND conflicting_claim_id NOT IN (FROM gone)""",
    "str_edit_span": f"""{A.SQL}, p AS (SELECT id, claim_text AS a, CASE WHEN id % 3 = 0 THEN evidence_text ELSE replace(claim_text, 'a', 'oo') END AS b FROM claims),
q AS (SELECT *, len(list_filter(generate_series(1, least(length(a), length(b))), lambda i: left(a, i) = left(b, i))) AS s FROM p),
r AS (SELECT *, len(list_filter(generate_series(1, least(length(a), length(b)) - s), lambda i: right(a, i) = right(b, i))) AS e FROM q) SELECT id, s AS start, length(a) - e AS before_end, length(b) - e AS after_end FROM r""",
    "str_refined_location": f"{A.SQL} SELECT id, CASE WHEN predicate = 'lives in' THEN 'lives_in' ELSE predicate END AS predicate FROM claims",
    "src_file_title": "SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name, '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM part",
}
