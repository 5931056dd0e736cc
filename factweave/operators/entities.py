"""Entities: types from names, and names resolved to a story's entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..session import dealt

_any = "|".join


def proper(name: Column) -> Column:
    """Whether a name has the shape of a proper name."""
    n = F.trim(F.coalesce(name, F.lit("")))
    parts = F.split(n, r"\s+")
    shaped = n.rlike(r"^[A-Z][a-z]+(?:\s+(?:(?:van|de|von|al)\s+)?[A-Z][a-z]+)?$")
    upper = F.forall(parts, lambda p: p.rlike(r"^\p{Lu}"))
    single = ~F.lower(n).isin(*V.NEVER_NAMES) & (n != F.upper(n))
    return (n != "") & (shaped | (upper & ((F.size(parts) >= 2) | single)))


def classify(name: Column, sentence: Column, role: Column, places: tuple[str, ...] = V.KNOWN_PLACES) -> Column:
    """(entity_type, type_confidence) of a name; the first rule that holds. Empty names are concepts of 0.3."""
    as_ = lambda kind, sure: F.struct(F.lit(kind).alias("entity_type"), F.lit(sure).alias("type_confidence"))
    ends = lambda key, words: reduce(lambda a, b: a | b, [key.endswith(w) for w in words])

    def by_key(key: Column) -> Column:
        words = F.size(F.split(key, " "))
        kin = key.rlike(rf"^(?:my )?(?:{_any(V.PARENTS)})\b")
        return (
            F.when(key == "", as_("concept", 0.3))
            .when(key.isin(*places), as_("place", 0.9))
            .when(key.isin(*V.OBJECTS), as_("object", 0.88))
            .when(key.isin(*V.ANIMALS), as_("animal", 0.88))
            .when(key.isin(*V.CONCEPTS), as_("concept", 0.92))
            .when(ends(key, V.CONCEPTS), as_("concept", 0.85))
            .when(kin | key.rlike(rf"^(?:the )?(?:{_any(V.HUMAN_ROLES)})\b"), as_("character", 0.78))
            .when((words >= 2) & F.substring_index(key, " ", 1).isin("her", "his", "their", "the", "my"), as_("concept", 0.82))
            .when(ends(key, V.PLACE_ENDS) | T.found(key, rf"\b(?:{_any(V.PLACE_WORDS)})\b", V.PLACE_WORDS), as_("place", 0.8))
            .when(key.isin(*V.GROUP_WORDS) | (key.endswith("s") & F.rtrim(key, F.lit("s")).isin(*V.GROUP_WORDS)), as_("group", 0.72))
            .when(proper(name), as_("character", 0.85))
            .when((words == 1) & (role == "object") & key.rlike(r"\p{L}"), as_("concept", 0.7))
            .when(key.isin("river", "sea", "forest") & F.coalesce(sentence, F.lit("")).rlike(r"(?i)\b(?:spoke|whispered|said|remembered|watched|listened)\b"), as_("character", 0.55))
            .when(words == 1, as_("object", 0.55))
            .otherwise(as_("character", 0.45))
        )

    return T.let(T.norm(name), by_key)


def graph_eligible(kind: Column, confidence: Column) -> Column:
    return (kind == "character") & (confidence >= 0.55)


def refined_type(claim_type: Column, predicate: Column, subject_type: Column, object_type: Column) -> Column:
    """A claim's type by what its ends are; others keep their own."""
    own = F.trim(F.coalesce(claim_type, F.lit("")))
    relational = F.translate(F.lower(F.trim(predicate)), " ", "_").isin(*V.RELATIONAL) | own.isin("relationship_state", "relationship_change")
    target = (
        F.when(object_type == "character", "relationship_state")
        .when(object_type == "place", "place_preference")
        .when(object_type.isin("concept", "object", "animal"), "character_preference")
        .when(object_type == "group", "character_state")
    )
    return F.when(relational & (subject_type == "character"), F.coalesce(target, own)).otherwise(own)


def significant(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: ~w.contains("'") & ~w.isin(*V.NAME_STOPWORDS) & (F.length(w) >= 3))


def resolved(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(story_id, name, entity_id, how) for each distinct mention; null where none matches.

    A whole name or alias comes first. A single word else matches a given name, or its ending of four letters or more. A longer name
    else matches an entity that so far is only its given name. Of several the lowest id wins. Three equi-joins: endings are listed
    by entity, so no pair of names is compared. Names without letters, null and empty match nothing.
    """
    c = F.col
    m = mentions.select("story_id", "name", T.norm(c("name")).alias("key")).distinct()
    aliases = c("aliases") if "aliases" in entities.columns else F.array().cast("array<string>")
    surfaces = F.filter(F.transform(F.concat(F.array("canonical_name"), F.coalesce(aliases, F.array().cast("array<string>"))), T.norm), lambda k: k != "")
    e = entities.select("story_id", "id", T.norm(c("canonical_name")).alias("canon"), F.explode(surfaces).alias("surface"))
    given = F.get(significant(c("surface")), F.lit(0))
    endings = F.transform(F.sequence(F.lit(1), F.greatest(F.length("given") - 3, F.lit(1))), lambda i: F.substring(c("given"), i, F.length("given")))
    by_end = e.select("story_id", "id", given.alias("given")).where("given is not null").select("story_id", "id", F.explode(endings).alias("k"))
    short = e.select("story_id", "id", significant(c("canon")).alias("w")).where("size(w) = 1").select("story_id", "id", F.get("w", F.lit(0)).alias("k"))
    lowest = lambda df, key, name: df.groupBy("story_id", key).agg(F.min("id").alias(name)).withColumnRenamed(key, "k")
    one = F.size(F.split("key", " ")) == 1
    parts = significant(c("key"))
    m = m.withColumns({"k1": F.when(c("key") != "", c("key")), "k2": F.when(one, F.get(parts, F.lit(0))), "k3": F.when(~one & (F.size(parts) >= 2), F.get(parts, F.lit(0)))})
    for k, table in (("k1", lowest(e, "surface", "e1")), ("k2", lowest(by_end, "k", "e2")), ("k3", lowest(short, "k", "e3"))):
        m = m.join(dealt(table.withColumnRenamed("k", k)), ["story_id", k], "left")
    how = F.when(c("e1").isNotNull(), "name").when(c("e2").isNotNull(), "given_name").when(c("e3").isNotNull(), "upgrade")
    return m.select("story_id", "name", F.coalesce("e1", "e2", "e3").alias("entity_id"), how.alias("how"))


def merged_aliases(canonical: Column, aliases: Column) -> Column:
    """Aliases without blanks, the canonical name and, whatever their case, repeats; first spellings stay, in order."""
    own = T.norm(canonical)
    keep = lambda out, a: F.when((T.norm(a) == "") | (T.norm(a) == own) | F.exists(out, lambda o: T.norm(o) == T.norm(a)), out).otherwise(F.concat(out, F.array(F.trim(a))))
    return F.aggregate(F.coalesce(aliases, F.array().cast("array<string>")), F.array().cast("array<string>"), keep)


def is_placeholder(name: Column) -> Column:
    return T.norm(name).isin(*V.PLACEHOLDERS)
