"""Reads and order-free steps of the fact store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V


def story_scene_counts(stories: DataFrame, scenes: DataFrame) -> DataFrame:
    n = scenes.groupBy("story_id").agg(F.count("id").alias("scene_count"))
    return stories.join(n, F.col("id") == F.col("story_id"), "left").select("id", "title", F.coalesce("scene_count", F.lit(0)).cast("long").alias("scene_count"))


def scene_claim_counts(scenes: DataFrame, claims: DataFrame) -> DataFrame:
    n = claims.groupBy("scene_id").agg(F.count("id").alias("claim_count"))
    return scenes.join(n, F.col("id") == F.col("scene_id"), "left").select("id", "story_id", "scene_number", F.coalesce("claim_count", F.lit(0)).cast("long").alias("claim_count"))


def status_counts(claims: DataFrame) -> DataFrame:
    kinds = ("approved", "canonized", "suggested", "needs_review", "rejected", "deprecated")
    return claims.groupBy("story_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds])


def bucket_counts(claims: DataFrame) -> DataFrame:
    new, accepted = F.col("status").isin(*V.PREVIEW), F.col("status").isin(*V.PAST_CANON)
    return claims.groupBy("scene_id").agg(F.count_if(new).alias("new"), F.count_if(accepted).alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"))


def next_scene(stories: DataFrame, scenes: DataFrame) -> DataFrame:
    top = scenes.groupBy("story_id").agg(F.max("scene_number").alias("top"))
    return stories.join(top, F.col("id") == F.col("story_id"), "left").select("id", (F.coalesce("top", F.lit(0)) + 1).cast("long").alias("next_scene_number"))


def new_claims_order(claims: DataFrame) -> DataFrame:
    """Place of each new claim in its scene's review list: those that need review, then suggested, by falling confidence, then id."""
    w = Window.partitionBy("scene_id").orderBy(F.when(F.col("status") == "needs_review", 0).otherwise(1), F.desc("confidence"), "id")
    return claims.where(F.col("status").isin(*V.PREVIEW)).select("scene_id", "id", "status", "confidence", F.row_number().over(w).cast("long").alias("place"))


def hashed(claims: DataFrame) -> DataFrame:
    c = F.col
    by_id = T.entity_hash(c("subject_entity_id"), c("predicate"), c("object_entity_id"), c("claim_type"), c("polarity"))
    by_name = T.string_hash(c("subject"), F.coalesce(F.when(c("claim_type") != "", c("claim_type")), "predicate"), c("object"), c("polarity"))
    return claims.select("id", F.when(c("subject_entity_id").isNotNull(), by_id).otherwise(by_name).alias("source_hash"))


def without_replaceable(claims: DataFrame) -> DataFrame:
    return claims.where(~F.col("status").isin(*V.REPLACEABLE))


def transitions(claims: DataFrame) -> DataFrame:
    """Validity of open facts of changing kind: each is closed where the same scene tells the next object of its subject and predicate."""
    c = claims.where("subject_entity_id is not null and object_entity_id is not null").withColumn("key", T.predicate_merge_key(F.col("predicate"))).where(F.col("key").isin(*V.TRANSITIONS))
    w = Window.partitionBy("scene_id", "subject_entity_id", "key", "polarity").orderBy("id")
    later = F.lead("object_entity_id").over(w)
    return c.select("id", "scene_id", F.col("scene_id").alias("valid_from_scene"), F.when(later.isNotNull() & (later != F.col("object_entity_id")), F.col("scene_id")).alias("valid_until"))


def collapse_duplicates(claims: DataFrame) -> DataFrame:
    """Of equal claims of a scene (by hash) the best status stays, then the lowest id; rejected ones stay all."""
    keyed = claims.join(hashed(claims), "id")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in V.STATUS_RANK.items() for v in kv]), F.col("status")), F.lit(0))
    w = Window.partitionBy("scene_id", "source_hash", F.col("status") == "rejected").orderBy(rank.desc(), "id")
    return keyed.withColumn("r", F.row_number().over(w)).where("r = 1 or status = 'rejected'").select("id", "scene_id", "status", "source_hash")


def stale(claims: DataFrame, scenes: DataFrame) -> DataFrame:
    """Claims whose evidence no longer stands in their scene's text."""
    joined = claims.join(scenes.select(F.col("id").alias("scene_id"), "text"), "scene_id")
    proof = T.norm_evidence(F.coalesce(F.col("evidence_text"), F.col("claim_text")))
    return joined.where((proof == "") | ~T.norm(F.col("text")).contains(proof)).select("id", "scene_id")


def synopsis(stories: DataFrame, scenes: DataFrame) -> DataFrame:
    """The rule-based description: excerpts of the first and the last scene."""
    s = scenes.groupBy("story_id").agg(F.count("*").alias("n"), F.min_by("text", "scene_number").alias("first"), F.max_by("text", "scene_number").alias("last"))
    j = stories.join(s, F.col("id") == F.col("story_id"), "left")
    head = F.concat(F.lit("“"), F.col("title"))
    many = F.concat(head, F.lit("” follows "), F.col("n").cast("string"), F.lit(" scenes. It begins: "), T.excerpt(F.col("first"), 220), F.lit(" Later threads include: "), T.excerpt(F.col("last"), 180))
    none = F.concat(F.lit("A work in progress titled “"), F.col("title"), F.lit(".”"))
    return j.select("id", F.when(F.col("n").isNull(), none).when(F.col("n") == 1, F.concat(head, F.lit("” opens with: "), T.excerpt(F.col("first"), 300))).otherwise(F.trim(many)).alias("description"))


def markdown(stories: DataFrame, scenes: DataFrame, claims: DataFrame) -> DataFrame:
    """One Markdown text per story."""
    line = F.concat(F.lit("- "), F.concat_ws(" | ", "subject", "predicate", "object"), F.when(F.col("is_major_plotline"), " (major)").otherwise(""))
    told = claims.groupBy("scene_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    part = F.concat(F.lit("## Chapter "), F.col("scene_number").cast("string"), F.lit("\n\n"), F.col("text"), F.lit("\n\n"), F.coalesce(F.concat(F.lit("### Claims\n\n"), F.col("lines"), F.lit("\n\n")), F.lit("")), F.lit("---\n"))
    per = scenes.join(told, F.col("id") == F.col("scene_id"), "left").groupBy("story_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("scene_number", part.alias("p")))), lambda x: x["p"]), "\n").alias("body"))
    whole = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return stories.join(per, F.col("id") == F.col("story_id"), "left").select("id", F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n")).alias("markdown"))
