"""How rows are shown: labels, sizes, places in lists, and states of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import entities as E

#: What origins of claims are called.
ORIGINS = {
    "structural": "Rules · pattern",
    "family": "Rules · family",
    "llm": "AI (LLM refine)",
    "llm_recall": "AI · recall",
    "fastus": "FASTUS grounded",
    "heuristic": "Fallback",
    "manual": "Manual",
    "unknown": "Unknown",
}
#: File endings and kinds that hold a manuscript.
MANUSCRIPT = r"(?i)\.(?:txt|md|markdown|docx)$"
WORD_KINDS = ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword")
#: Replacements shown for an issue; events of a chunk and of a scene.
REPLACEMENTS, CHUNK_EVENTS, SCENE_EVENTS = 5, 40, 120


def origin_label(origin: Column) -> Column:
    """What an origin is called, joined ones part by part; unknown words stay, null and empty are Unknown."""
    named = lambda x: T.looked_up(x, ORIGINS, x)
    joined = F.array_join(F.transform(F.split(origin, r"\+"), lambda p: named(F.trim(p))), " + ")
    return F.when(F.coalesce(origin, F.lit("")) == "", ORIGINS["unknown"]).when(origin.contains("+"), joined).otherwise(named(origin))


def origin_breakdown(claims: DataFrame, by: str = "scene_id") -> DataFrame:
    """Counts of a scene's claims by origin as one line, most first, then by name."""
    n = claims.groupBy(by, "generation_origin").agg(F.count("*").alias("n"))
    sorted_ = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "generation_origin")))
    return n.groupBy(by).agg(F.array_join(F.transform(sorted_, lambda x: F.concat((-x["m"]).cast("string"), F.lit(" "), F.lower(origin_label(x["generation_origin"])))), " · ").alias("breakdown"))


def edge_label(predicates: Column, group: Column) -> Column:
    """One predicate in words, its first letter large; of several their group's name, as a title."""
    told = F.translate(F.get(predicates, F.lit(0)), "_", " ")
    titled = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    return F.when(F.size(predicates) == 1, titled(told)).otherwise(titled(group))


def predicates_told(predicates: Column) -> Column:
    return F.array_join(F.transform(predicates, lambda p: F.translate(p, "_", " ")), ", ")


def engine_label(error: Column, source: Column, attempted: Column, fallback: Column) -> Column:
    """Which engine extracted a scene's claims; the flags' nulls are false."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "failed")
        .when(source == "openai", "AI + rules")
        .when(source == "hybrid", "AI + rules (partial fallback)")
        .when(yes(attempted) & ~yes(fallback), "AI")
        .otherwise("rules only (no AI key or LLM skipped)")
    )


def stamp(told: Column) -> Column:
    """A time as month, day, hour and minute; null for what tells none."""
    return F.date_format(F.try_to_timestamp(told), "MMM d, hh:mm a")


def node_size(importance: Column) -> Column:
    return 56 + F.least(F.lit(48.0), F.coalesce(importance, F.lit(0.0)) * 0.45)


def edge_width(strength: Column) -> Column:
    return F.least(F.lit(5.0), 1.25 + strength * 0.22)


def guessed_type(name: Column, claim_type: Column) -> Column:
    """An entity's type from its name and the type of the claim that tells it."""
    kind = E.classify(name, F.lit(None).cast("string"), F.lit("unknown"))["entity_type"]
    person, rule = kind == "character", claim_type.isin("world_rule", "power_rule", "timeline_fact")
    built = name.rlike(r"(?i)\b(?:city|kingdom|land|hall|castle)\b")
    return F.when(person & rule & built, "place").when(person & rule, "object").when(person & (claim_type == "plotline_fact"), "group").otherwise(kind)


def is_manuscript(name: Column, kind: Column) -> Column:
    """Whether a file's ending or its kind is one that can be read as a manuscript; nulls tell nothing."""
    return F.coalesce(name.rlike(MANUSCRIPT), F.lit(False)) | F.coalesce(kind.startswith("text/") | kind.isin(*WORD_KINDS), F.lit(False))


def replacements(given: Column) -> Column:
    """The first REPLACEMENTS; null gives none."""
    return F.slice(F.coalesce(given, F.array().cast("array<string>")), 1, REPLACEMENTS)


def entity_order(entities: DataFrame) -> DataFrame:
    """(story_id, id, canonical_name, place): each story's entities by name, equal ones by id."""
    w = Window.partitionBy("story_id").orderBy("canonical_name", "id")
    return entities.select("story_id", "id", "canonical_name", F.row_number().over(w).cast("long").alias("place"))


def answered(requests: DataFrame, stories: DataFrame) -> DataFrame:
    """(request_id, code, title): 200 and the title where a request's story (story_id) is its user's (user), else 404."""
    owned = stories.select(F.col("id").alias("story_id"), F.col("owner_user_id").alias("user"), "title")
    x = requests.join(owned, ["story_id", "user"], "left")
    return x.select("request_id", F.when(F.col("title").isNotNull(), 200).otherwise(404).cast("long").alias("code"), "title")


def surface_counts(names: DataFrame, by: str) -> DataFrame:
    """Distinct names of each group, whatever their case and white space; blank ones don't count."""
    key = T.norm(F.col("name"))
    return names.groupBy(by).agg(F.countDistinct(F.when(key != "", key)).alias("n_surfaces"))


def extraction_totals(drafts: DataFrame, by: str = "scene_id") -> DataFrame:
    """Counts of a scene's drafts: all, those a model recalled or told, those of rules, those its text shows."""
    of = lambda *origins: F.count_if(F.coalesce(F.col("generation_origin").isin(*origins), F.lit(False)))
    return drafts.groupBy(by).agg(
        F.count("*").alias("n_drafts"),
        of("llm_recall").alias("n_recalled"),
        of("llm").alias("n_model"),
        of("structural", "family").alias("n_rules"),
        F.count_if(F.coalesce("anchored", F.lit(False))).alias("n_anchored"),
    )


def first_events(events: DataFrame) -> DataFrame:
    """Events of a scene as its log shows them: each chunk's first CHUNK_EVENTS by ord, of those the scene's first SCENE_EVENTS."""
    first = lambda df, n, *group: df.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("ord"))).where(F.col("r") <= n).drop("r")
    return first(first(events, CHUNK_EVENTS, "scene_id", "chunk"), SCENE_EVENTS, "scene_id")
