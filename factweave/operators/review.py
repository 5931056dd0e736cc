"""What a reviewer reads and decides: issue texts and orders, groups of claims, nested reads, and the row changes behind the commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .editor import resolution
from .entities import is_placeholder

#: The groups of accepted claims by type, in their order; others are of the first.
CLAIM_GROUPS = {
    "characters": ("character_trait", "character_goal", "character_state", "character_preference"),
    "relationships": ("relationship_state", "relationship_change"),
    "world": ("world_rule", "power_rule"),
    "plot": ("plotline_fact", "event", "timeline_fact"),
}
#: Characters of a quote.
QUOTE = 500


def quote(evidence: Column, claim: Column) -> Column:
    """The evidence, or where there is none the claim's text."""
    trimmed = lambda x: F.trim(F.coalesce(x, F.lit("")))
    return F.substring(F.when(trimmed(evidence) != "", trimmed(evidence)).otherwise(trimmed(claim)), 1, QUOTE)


def fact(subject: Column, predicate: Column, target: Column, polarity: Column) -> Column:
    said = F.trim(F.concat_ws(" ", subject, predicate, target))
    return F.when(polarity == F.lit(False), F.concat(F.lit("NOT ("), said, F.lit(")"))).otherwise(said)


def comparison(old: Column, new: Column) -> Column:
    """Two quotes side by side; null where both are empty."""
    earlier, now = F.concat(F.lit('Earlier: "'), old, F.lit('"')), F.concat(F.lit('Now: "'), new, F.lit('"'))
    return F.when((old != "") & (new != ""), F.concat(earlier, F.lit(" → "), now)).when(old != "", earlier).when(new != "", now)


#: What an explanation tells of a claim.
_EXPLAINED = ("subject", "predicate", "object", "polarity", "evidence_text", "claim_text")


def explained(issues: DataFrame, claims: DataFrame) -> DataFrame:
    """issues with both quotes, their comparison, an explanation and a suggested fix. Each issue's two claims are looked up by id."""
    end = lambda key, name: claims.select(F.col("id").alias(key), F.struct(*_EXPLAINED).alias(name))
    x = issues.join(end("current_claim_id", "n"), "current_claim_id").join(end("conflicting_claim_id", "o"), "conflicting_claim_id")
    return explained_pairs(x, *issues.columns)


def explained_pairs(pairs: DataFrame, *kept: str) -> DataFrame:
    """explained() of pairs that bring both claims as structs n and o, and a conflict_kind; kept columns come first."""
    c = F.col
    words = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    said = lambda who: fact(*[c(f"{who}.{f}") for f in _EXPLAINED[:4]])
    old, new = (quote(c(f"{who}.evidence_text"), c(f"{who}.claim_text")) for who in ("o", "n"))
    kind = c("conflict_kind")
    why = (
        F.when(kind == "polarity_flip", words("The same fact appears asserted and negated: '", said("o"), "' conflicts with '", said("n"), "'."))
        .when(kind == "exclusive_object", words("Exclusive fact '", c("n.predicate"), "' cannot hold two values at once: was '", c("o.object"), "', now '", c("n.object"), "'."))
        .when(kind == "predicate_opposition", words("Opposite relationship stances on the same pair: earlier '", c("o.predicate"), "' vs now '", c("n.predicate"), "'."))
    )
    fix = (
        F.when(kind == "polarity_flip", words("Decide which version is canon. If the negation is correct, deprecate or reject the earlier claim ('", F.concat_ws(" ", "o.subject", "o.predicate", "o.object"), "') or add bridging prose that explains the reversal."))
        .when(kind == "exclusive_object", words("Pick one value as canon for '", c("n.predicate"), "' ('", c("o.object"), "' vs '", c("n.object"), "'), or add a scene that explains the change (move, breakup, revelation, etc.)."))
        .when(kind == "predicate_opposition", words("If this is intentional emotional progression, add a bridging beat between '", c("o.predicate"), "' and '", c("n.predicate"), "'. Otherwise adjust one claim or mark the earlier stance as superseded."))
    )
    empty = lambda q: F.when(q != "", q)
    return pairs.select(*kept, empty(old).alias("conflicting_evidence_text"), empty(new).alias("current_evidence_text"), comparison(old, new).alias("evidence_comparison"), why.alias("explanation"), fix.alias("suggested_fix"))


def in_text_order(issues: DataFrame) -> DataFrame:
    """(id, story_id, place): each issue's place in its story by scene, offset and id; an unknown offset is 0."""
    w = Window.partitionBy("story_id").orderBy("scene_number", F.coalesce("text_offset", F.lit(0)), "id")
    return issues.select("id", "story_id", F.row_number().over(w).cast("long").alias("place"))


def in_detection_order(issues: DataFrame, created: str = "created_at") -> DataFrame:
    """(id, story_id, place): each issue's place in its story by the time it was found, nulls first, then id."""
    w = Window.partitionBy("story_id").orderBy(F.asc_nulls_first(created), "id")
    return issues.select("id", "story_id", F.row_number().over(w).cast("long").alias("place"))


#: What a writer is shown of what a judge may say.
SHOWN = ("hard_contradiction", "soft_tension")


def shown(issues: DataFrame) -> DataFrame:
    """Issues that are contradictions or tensions; other judgments, and none, stay unseen."""
    return issues.where(F.col("judge_classification").isin(*SHOWN))


def issue_buckets(issues: DataFrame) -> DataFrame:
    """(story_id, open, resolved): unknown states are open."""
    is_open = resolution(F.col("resolution_status")) == "open"
    return issues.groupBy("story_id").agg(F.count_if(is_open).alias("open"), F.count_if(~is_open).alias("resolved"))


def claim_group(claim_type: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, types in CLAIM_GROUPS.items():
        found = F.when(claim_type.isin(*types), name).otherwise(found)
    return F.coalesce(found, F.lit("characters"))


def accepted_groups(claims: DataFrame) -> DataFrame:
    """Accepted claims of each story by group."""
    accepted = claims.where(F.col("status").isin(*V.PAST_CANON))
    return accepted.groupBy("story_id", claim_group(F.col("claim_type")).alias("claim_group")).agg(F.count("*").alias("n"))


def story_order(stories: DataFrame, scenes: DataFrame, created: str = "id") -> DataFrame:
    """(owner_user_id, id, scene_count, place): each owner's stories, newest first; a story without scenes has 0."""
    n = scenes.groupBy("story_id").agg(F.count("*").alias("scene_count"))
    w = Window.partitionBy("owner_user_id").orderBy(F.desc(created), F.desc("id"))
    x = stories.withColumn("place", F.row_number().over(w).cast("long")).join(n, F.col("id") == F.col("story_id"), "left")
    return x.select("owner_user_id", "id", F.coalesce("scene_count", F.lit(0)).cast("long").alias("scene_count"), "place")


def scene_with_claims(scenes: DataFrame, claims: DataFrame) -> DataFrame:
    """A row per scene with its claims inside, by id; a scene without any has an empty list. A scene's claims are one chapter's."""
    told = claims.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("id", "subject", "predicate", "object", "status"))).alias("claims"))
    x = scenes.join(told, F.col("id") == F.col("scene_id"), "left")
    return x.select("id", "story_id", "scene_number", F.coalesce("claims", F.expr("cast(array() as array<struct<id:bigint,subject:string,predicate:string,object:string,status:string>>)")).alias("claims"))


def issue_scenes(issues: DataFrame, claims: DataFrame, scenes: DataFrame) -> DataFrame:
    """issues with the number of their scene and of the earlier claim's scene (null where that claim is gone)."""
    number = scenes.select(F.col("id").alias("scene_id"), "scene_number")
    earlier = claims.select(F.col("id").alias("conflicting_claim_id"), "scene_id").join(number, "scene_id").select("conflicting_claim_id", F.col("scene_number").alias("conflicting_scene_number"))
    return issues.join(number, "scene_id", "left").join(earlier, "conflicting_claim_id", "left").select(*issues.columns, "scene_number", "conflicting_scene_number")


def taken_numbers(scenes: DataFrame) -> DataFrame:
    """(story_id, scene_number, n) of numbers that more than one scene has: each after the first is a conflict."""
    return scenes.groupBy("story_id", "scene_number").agg(F.count("*").alias("n")).where("n > 1")


def updated_stories(stories: DataFrame, changes: DataFrame) -> DataFrame:
    """stories after partial updates (id, title, description, with a flag for a given description): null titles change nothing, blank descriptions become null."""
    blank = lambda x: F.when(F.trim(x) != "", F.trim(x))
    x = stories.alias("s").join(changes.alias("c"), "id", "left")
    description = F.when(F.coalesce("c.has_description", F.lit(False)), blank(F.col("c.description"))).otherwise(F.col("s.description"))
    return x.select("id", F.coalesce("c.title", "s.title").alias("title"), description.alias("description"))


def without_scenes(removed: DataFrame, scenes: DataFrame, claims: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """scenes, claims and issues without the removed scenes (scene_id), their claims, their issues, and issues of either such claim."""
    gone = removed.select("scene_id").distinct()
    gone_claims = claims.join(gone, "scene_id", "left_semi").select("id")
    left = issues.join(gone, "scene_id", "left_anti")
    for end in ("current_claim_id", "conflicting_claim_id"):
        left = left.join(gone_claims.withColumnRenamed("id", end), end, "left_anti")
    return scenes.join(gone.withColumnRenamed("scene_id", "id"), "id", "left_anti"), claims.join(gone, "scene_id", "left_anti"), left.select(*issues.columns)


def manual_rows(drafts: DataFrame) -> DataFrame:
    """Claims that a writer enters, as stored rows: approved, of source manual, sure. Those with a blank part or a placeholder's name are left out."""
    parts = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("subject", "predicate", "object")}
    x = drafts.withColumns(parts).where("subject <> '' and predicate <> '' and object <> ''").where(~is_placeholder(F.col("subject")) & ~is_placeholder(F.col("object")))
    return x.withColumns({"status": F.lit("approved"), "source": F.lit("manual"), "confidence": F.lit(1.0), "claim_version": F.lit(1)})


def resolved_status(confidence: Column, review_status: Column) -> Column:
    """A stated review status, else the confidence's."""
    return F.coalesce(F.when(F.trim(review_status) != "", F.trim(review_status)), T.status_for_confidence(confidence))


def history(confidence: Column, scene_id: Column, version: Column, before: Column | None = None) -> Column:
    """JSON of a claim's confidences, one entry more at the end; what is no list of entries starts anew."""
    kind = "array<struct<version:bigint,confidence:double,scene_id:bigint>>"
    entry = F.struct(version.cast("long").alias("version"), F.round(confidence.cast("double"), 4).alias("confidence"), scene_id.cast("long").alias("scene_id"))
    old = F.array().cast(kind) if before is None else F.coalesce(F.from_json(before, kind), F.array().cast(kind))
    return F.to_json(F.concat(old, F.array(entry)))


def inserted_rows(extracted: DataFrame) -> DataFrame:
    """Extracted claims as rows to store: version 1, valid from their scene, their history begun; plot lines and core facts are major."""
    c = F.col
    return extracted.withColumns(
        {
            "claim_text": F.trim("claim_text"),
            "evidence_text": F.trim("evidence_text"),
            "source": F.lit("extracted"),
            "claim_version": F.lit(1),
            "valid_from_scene": c("scene_id"),
            "valid_until_scene": F.lit(None).cast("long"),
            "is_major_plotline": F.coalesce((c("claim_type") == "plotline_fact") | (c("canon_level") == "core"), F.lit(False)),
            "status": resolved_status(c("confidence"), c("review_status")),
            "confidence_history": history(c("confidence"), c("scene_id"), F.lit(1)),
        }
    ).drop("review_status")


def pruned(claims: DataFrame, issues: DataFrame, stale: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """claims and issues after a save: stale claims (id) go unless a writer entered them or the save touched them (id), and issues of either of their claims with them."""
    gone = stale.select("id").join(touched.select("id"), "id", "left_anti").join(claims.where(F.coalesce("source", F.lit("")) == "manual").select("id"), "id", "left_anti").distinct()
    left = issues
    for end in ("current_claim_id", "conflicting_claim_id"):
        left = left.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return claims.join(gone, "id", "left_anti"), left.select(*issues.columns)


def refined_predicate(predicate: Column, target: Column, evidence: Column, stored: Column | None = None) -> Column:
    """Where someone lives: lives_at for a residence or room, lives_in for a city, region or unknown place; institutions and other predicates keep theirs."""
    key = F.translate(T.norm(predicate), " ", "_")
    located = T.is_location(predicate) | key.isin("in", "at", "lives", "resides", "located_in", "located_at", "lives_in", "lives_at")
    kind = T.place_granularity(target, evidence, F.lit(None).cast("string") if stored is None else stored)
    marked = T.let(F.lower(F.concat_ws(" ", target, evidence)), lambda t: T.found(t, V.RESIDENCE, V.RESIDENCE_WORDS))
    told = lambda k: F.when(k != "institution", F.when(k.isin("residence", "room"), "lives_at").when(k.isin("city", "region"), "lives_in").when(marked, "lives_at").otherwise("lives_in"))
    return F.when(located & (F.trim(F.coalesce(target, F.lit(""))) != ""), F.coalesce(T.let(kind, told), predicate)).otherwise(predicate)


def edit_span(before: Column, after: Column) -> Column:
    """struct<start, before_end, after_end> of the one edit between two texts: what lies between their common start and, behind it, their common end."""
    shorter = F.least(F.length(before), F.length(after))

    def common(limit: Column, same) -> Column:
        """The largest n up to limit with same(n), which holds up to some n: halved as often as a text's length allows."""
        step = lambda x, _: F.when(x["low"] >= x["high"], x).otherwise(F.when(same(F.floor((x["low"] + x["high"] + 1) / 2).cast("int")), F.struct(F.floor((x["low"] + x["high"] + 1) / 2).cast("int").alias("low"), x["high"].alias("high"))).otherwise(F.struct(x["low"].alias("low"), (F.floor((x["low"] + x["high"] + 1) / 2) - 1).cast("int").alias("high"))))
        return F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct(F.lit(0).alias("low"), limit.cast("int").alias("high")), step)["low"]

    start = common(shorter, lambda n: F.substring(before, F.lit(1), n) == F.substring(after, F.lit(1), n))

    def ends(s: Column) -> Column:
        tail = common(shorter - s, lambda n: F.substring(before, F.length(before) - n + 1, n) == F.substring(after, F.length(after) - n + 1, n))
        return F.get(F.transform(F.array(tail), lambda t: F.struct(s.alias("start"), (F.length(before) - t).alias("before_end"), (F.length(after) - t).alias("after_end"))), F.lit(0))

    return F.get(F.transform(F.array(start), ends), F.lit(0))


def file_title(name: Column) -> Column:
    base = F.trim(F.regexp_replace(name, r"(?i)\.(md|txt|markdown|docx)$", ""))
    return F.when(base == "", "Imported story").otherwise(F.trim(F.regexp_replace(F.regexp_replace(base, "[-_]+", " "), r"\s+", " ")))


def heading(block: Column) -> Column:
    """A scene's title: its first ## heading, else its Chapter line; null without either."""
    found = F.trim(F.regexp_extract(block, r"(?m)^##\s+(.+?)(?:\n|$)", 1))
    chapter = F.trim(F.regexp_extract(block, r"(?im)^(Chapter\s+\d+[^\n]*)", 1))
    return F.when(found != "", found).when(chapter != "", chapter)


def body(block: Column) -> Column:
    """A scene's text without its first ## heading and its first Chapter line."""
    first = lambda x, line: F.regexp_replace(x, rf"\A(?m:((?:(?s:.)*?))(?i:{line})[^\n]*\n?)", "$1")
    return _stripped(first(first(F.coalesce(block, F.lit("")), r"^##\s+"), r"^Chapter\s+\d+"))


def recombined(title: Column, text: Column) -> Column:
    """A title and a text as stored: an empty line between them, or the one that isn't blank."""
    parts = F.filter(F.array(_stripped(title), _stripped(text)), lambda x: x != "")
    return F.array_join(parts, "\n\n")


def _stripped(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+\z", "")


def titled(scenes: DataFrame) -> DataFrame:
    """scenes (text) with title, which is null without a heading, body, and both recombined."""
    x = scenes.withColumns({"title": heading(F.col("text")), "body": body(F.col("text"))})
    return x.withColumn("stored", recombined(F.col("title"), F.col("body")))


def aliases(raw: Column) -> Column:
    """A JSON list of names, trimmed and without blanks; what is no list is an empty one."""
    given = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>"))
    return F.filter(F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")


def origin_counts(claims: DataFrame, by: str = "scene_id") -> DataFrame:
    """Claims by origin, as a map."""
    n = claims.groupBy(by, "generation_origin").agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("generation_origin", "n")))).alias("generation_counts"))
