"""Who a mention means: the point of view, the nearest name before a pronoun, a role's name, a registered entity, or its own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .candidates import without_fillers

#: Pronouns by what they refer to.
PRONOUNS = {"male": ("he", "him", "his"), "female": ("she", "her", "hers"), "plural": ("they", "them", "their", "theirs")}
#: Given names that tell a gender.
FEMALE = ("bella", "isabella", "renée", "renee", "rosalie", "alice", "jessica", "angela", "victoria", "leah", "esme")
MALE = ("edward", "charlie", "jacob", "emmett", "jasper", "carlisle", "mike", "eric", "tyler", "james", "laurent", "phil", "billy")
#: Sentences that a pronoun looks back over.
BACK = 3


def head(surface: Column) -> Column:
    """The first word of a mention, lower case; empty for null and blank ones."""
    return F.substring_index(T.norm(surface), " ", 1)


def gender(surface: Column) -> Column:
    """male, female or unknown, by the first word of a name, else by its last."""
    words = F.split(T.norm(surface), " ")
    told = lambda w: F.when(w.isin(*FEMALE), "female").when(w.isin(*MALE), "male")
    return F.coalesce(told(F.get(words, F.lit(0))), told(F.element_at(words, -1)), F.lit("unknown"))


def _wanted(word: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, words in PRONOUNS.items():
        found = F.when(word.isin(*words), kind).otherwise(found)
    return found


def nearest(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """mentions with antecedent: struct<surface, entity_id, gender>, the last name before each that a pronoun of its kind may mean.

    mentions have doc_id, sentence_index, at and text; names have doc_id, sentence_index, at, surface and entity_id. Names that are
    pronouns or blank don't count, nor does one at the mention's own place; of names at one place the last by spelling is taken.
    What lies more than BACK sentences before is none, as for other mentions than pronouns. A null place in the text comes first.
    An as-of join in one sort: names and mentions of a text together in order, with the last fitting name of each kind carried
    along, so nothing is paired. A text is one window's partition, read in a stream.
    """
    c = F.col
    row = F.struct("sentence_index", "surface", "entity_id", gender(c("surface")).alias("gender"))
    told = names.where((head(c("surface")) != "") & ~head(c("surface")).isin(*V.NARRATING, *V.THIRD_PERSON))
    told = told.select("doc_id", "sentence_index", "at", F.lit(1).alias("kind"), c("surface").alias("spelling"), row.alias("name"))
    asked = mentions.select("doc_id", "sentence_index", "at", F.lit(0).alias("kind"), F.struct(*mentions.columns).alias("mention"))
    w = Window.partitionBy("doc_id").orderBy("sentence_index", "at", "kind", "spelling").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda fits: F.last(F.when(fits, c("name")), ignorenulls=True).over(w)
    x = asked.unionByName(told, allowMissingColumns=True)
    x = x.select("mention", *[last(f).alias(k) for k, f in (("male", c("name.gender") != "female"), ("female", c("name.gender") != "male"), ("plural", c("name").isNotNull()))])
    kind = _wanted(head(without_fillers(c("mention.text"))))
    found = F.when(kind == "male", c("male")).when(kind == "female", c("female")).when(kind == "plural", c("plural"))
    near = found["sentence_index"] >= c("mention.sentence_index") - BACK
    return x.where("mention is not null").select("mention.*", F.when(near, F.struct(found["surface"].alias("surface"), found["entity_id"].alias("entity_id"), found["gender"].alias("gender"))).alias("antecedent"))


def best_of_name(candidates: DataFrame) -> DataFrame:
    """(doc_id, key, surface, confidence, entity_id): of a text's candidates with one normal form the surest, of equal ones the last by ord."""
    x = candidates.select("doc_id", T.norm(F.col("surface")).alias("key"), F.struct("surface", "confidence", "entity_id").alias("c"), F.struct("confidence", "ord").alias("o"))
    return x.groupBy("doc_id", "key").agg(F.max_by("c", "o").alias("c")).select("doc_id", "key", "c.*")


def resolved(mentions: DataFrame, names: DataFrame, candidates: DataFrame, cast: DataFrame) -> DataFrame:
    """(id, doc_id, resolved, entity_id, confidence, method) of every mention (id, doc_id, sentence_index, at, text, pov).

    The narrator's pronouns are the point of view; other pronouns the nearest name; a word of cast (doc_id, role, name) that name; the
    rest a candidate (doc_id, surface, confidence, entity_id, ord) of equal normal form, else themselves. Fillers around a mention
    don't count. Null and blank mentions, and pronouns without an antecedent or point of view, are unresolved: null, confidence 0.
    """
    c = F.col
    roles = cast.groupBy("doc_id", F.lower("role").alias("role")).agg(F.min("name").alias("cast_name"))
    bare, pov = without_fillers(c("text")), F.trim(F.coalesce(c("pov"), F.lit("")))
    x = nearest(mentions.select("id", "doc_id", "sentence_index", "at", "text", "pov"), names)
    x = x.withColumns({"bare": bare, "pov": F.when(pov != "", pov), "head": head(bare)})
    x = x.withColumn("role", F.rtrim(c("head"), F.lit(".,;:!?"))).join(roles, ["doc_id", "role"], "left")
    narrating, third = c("head").isin(*V.NARRATING), c("head").isin(*V.THIRD_PERSON)
    step = F.when(c("head") == "", "unresolved").when(narrating, F.when(c("pov").isNull(), "unresolved").otherwise("pov"))
    step = step.when(third, F.when(c("antecedent").isNull(), "unresolved").otherwise("nearest_entity")).when(c("cast_name").isNotNull(), "cast").otherwise("literal")
    x = x.withColumn("method", step)
    looked_up = F.when(c("method") == "pov", c("pov")).when(c("method") == "cast", c("cast_name")).when(c("method") == "literal", c("bare"))
    best = best_of_name(candidates).select("doc_id", "key", "surface", c("confidence").alias("known"), "entity_id")
    x = x.withColumn("key", F.when(looked_up.isNotNull(), T.norm(looked_up))).join(best, ["doc_id", "key"], "left")
    method = F.when((c("method") == "literal") & c("entity_id").isNotNull(), "registry").otherwise(c("method"))
    fits = F.when(_wanted(c("head")) == "plural", 0.62).when(c("antecedent.gender") == "unknown", 0.58).otherwise(0.72)
    sure = (
        F.when(c("method") == "unresolved", 0.0)
        .when(c("method") == "pov", F.when(c("head").isin("my", "mine"), 0.9).otherwise(0.92))
        .when(c("method") == "nearest_entity", fits)
        .when(c("method") == "cast", 0.75)
        .when(c("entity_id").isNotNull(), c("known"))
        .when(c("surface").isNotNull(), 0.85)
        .when(c("bare").rlike("^[A-Z]"), 0.8)
        .otherwise(0.5)
    )
    who = F.when(c("method") == "pov", c("pov")).when(c("method") == "nearest_entity", c("antecedent.surface")).when(c("method") == "cast", c("cast_name")).when(c("method") == "literal", F.coalesce("surface", "bare"))
    entity = F.when(c("method") == "nearest_entity", c("antecedent.entity_id")).otherwise(c("entity_id"))
    return x.select("id", "doc_id", who.alias("resolved"), entity.alias("entity_id"), sure.alias("confidence"), method.alias("method"))


def outside(spans: DataFrame, covering: DataFrame) -> DataFrame:
    """spans (doc_id, start, end) that no covering span of their text overlaps; touching ends don't overlap, and an empty one overlaps where it lies inside.

    One sort a text: the furthest end of the covering spans that start before a span's end is carried along, so nothing is paired.
    """
    c = F.col
    cover = covering.select("doc_id", c("start").alias("place"), F.lit(1).alias("kind"), c("end").alias("reach"))
    asked = spans.select("doc_id", c("end").alias("place"), F.lit(0).alias("kind"), F.struct(*spans.columns).alias("span"))
    w = Window.partitionBy("doc_id").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = asked.unionByName(cover, allowMissingColumns=True).withColumn("furthest", F.max("reach").over(w))
    return x.where(c("span").isNotNull() & F.coalesce(c("furthest") <= c("span.start"), F.lit(True))).select("span.*")


#: What counts more where two sources name one span.
SOURCES = ("rule", "tagger", "registry")


def one_a_span(candidates: DataFrame) -> DataFrame:
    """Of candidates with one span and normal form, that of the best source, of equal ones the first by ord; sources not named in SOURCES come last."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")), F.lit(0))
    x = candidates.select("doc_id", "start", "end", T.norm(F.col("surface")).alias("key"), F.struct((-rank).alias("rank"), "ord").alias("o"), F.struct(*candidates.columns).alias("c"))
    return x.groupBy("doc_id", "start", "end", "key").agg(F.min_by("c", "o").alias("c")).select("c.*")


def runs(tokens: DataFrame) -> DataFrame:
    """(doc_id, label, first, last, n): stretches of tokens (doc_id, pos, label) that follow each other with one label; null and empty labels end a stretch."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    label = F.nullif("label", F.lit(""))
    x = tokens.withColumn("label", label).withColumn("new", (~F.col("label").eqNullSafe(F.lag("label").over(w))).cast("int"))
    x = x.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("label is not null")
    return x.groupBy("doc_id", "label", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).drop("run")
