"""Duplicate characters of a story: which folds into which, and the tables afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import dealt
from . import entities as E

_SEEN = "array<struct<id: bigint, given: string, single: boolean, winner: bigint>>"


def _same(a: Column, b: Column) -> Column:
    """Whether a, earlier in order, and b name one character: equal given names or a nickname that ends the other's, one being a single word."""
    ends = lambda short, full: (F.length(short) >= 4) & full.endswith(short)
    return (
        ((a["given"] == b["given"]) & (a["single"] | b["single"]))
        | (a["single"] & ends(a["given"], b["given"]))
        | (b["single"] & ends(b["given"], a["given"]))
    )


def folds(entities: DataFrame) -> DataFrame:
    """(story_id, id, winner_id) of each character that folds into a fuller one of its story; the others have no row.

    Taken greedily: more name words first, then longer names, then lower ids; each folds into the first one kept that names the same
    character. Equal names always fold. Placeholders, null and blank names and other types never do.

    Whether two fold depends on given names alone, so names with several words never fold into each other unless equal, and of each
    given name only its first full and its first single name can decide. Names that match share their last four letters: a task
    folds one story's distinct given names of one ending, not its characters.
    """
    c = F.col
    key = T.norm(c("canonical_name"))
    words = E.significant(key)
    e = entities.where((c("entity_type") == "character") & (key != "") & ~E.is_placeholder(c("canonical_name"))).select(
        "story_id",
        c("id").cast("long").alias("id"),
        F.get(words, F.lit(0)).alias("given"),
        (F.size(words) == 1).alias("single"),
        F.struct((-F.size(words)).alias("n"), (-F.length("canonical_name")).alias("length"), c("id").cast("long").alias("id")).alias("place"),
        F.when(F.size(words) == 1, F.concat(F.lit("1 "), F.get(words, F.lit(0)))).otherwise(F.concat(F.lit("n "), key)).alias("unit"),
    )
    firsts = e.groupBy("story_id", "unit").agg(F.min("place").alias("place"), F.first("given").alias("given"), F.first("single").alias("single"))
    heads = firsts.where("given is not null").groupBy("story_id", "given", "single").agg(F.min("place").alias("place"))
    listed = F.sort_array(F.collect_list(F.struct("place", "given", "single")))
    blocks = heads.groupBy("story_id", F.right("given", F.lit(4)).alias("ending")).agg(listed.alias("all"))

    def step(seen: Column, x: Column) -> Column:
        winner = F.get(F.filter(seen, lambda w: (w["winner"] == w["id"]) & _same(w, x)), F.lit(0))["id"]
        own = x["place"]["id"]
        return F.concat(seen, F.array(F.struct(own.alias("id"), x["given"].alias("given"), x["single"].alias("single"), F.coalesce(winner, own).alias("winner"))))

    decided = blocks.select("story_id", F.explode(F.aggregate("all", F.array().cast(_SEEN), step)).alias("d")).where("d.single")
    singles = decided.select("story_id", F.concat(F.lit("1 "), "d.given").alias("unit"), c("d.winner").alias("decided"))
    ends = firsts.select("story_id", "unit", c("place.id").alias("first")).join(dealt(singles), ["story_id", "unit"], "left")
    found = e.select("story_id", "unit", "id").join(dealt(ends.select("story_id", "unit", F.coalesce("decided", "first").alias("winner_id"))), ["story_id", "unit"])
    return found.where("winner_id <> id").select("story_id", "id", "winner_id")


def folded(entities: DataFrame, found: DataFrame) -> DataFrame:
    """The entities that stay. Winners gain the losers' names and aliases, and are in the graph if any of them was.

    Of repeated aliases the first spelling stays. Names are made distinct before they are gathered, so a list holds a character's
    different names, not its rows.
    """
    c, none = F.col, F.array().cast("array<string>")
    aliases = F.coalesce(c("aliases"), none) if "aliases" in entities.columns else none
    e = entities.withColumn("aliases", aliases)
    lost = e.alias("e").join(dealt(found).alias("f"), c("e.id") == c("f.id")).select("f.winner_id", c("e.canonical_name").alias("name"), c("e.id").alias("loser"), c("e.aliases").alias("aliases"), c("e.graph_eligible").alias("eligible"))
    size = F.size(E.significant(T.norm(c("name"))))
    told = lost.select("winner_id", (-size).alias("n"), (-F.length("name")).alias("length"), "loser", F.posexplode(F.concat("aliases", F.array("name"))).alias("at", "alias"))
    told = told.groupBy("winner_id", T.norm(c("alias")).alias("key")).agg(F.min(F.struct("n", "length", "loser", "at", "alias")).alias("x"))
    gained = told.groupBy("winner_id").agg(F.sort_array(F.collect_list("x"))["alias"].alias("gained"))
    eligible = lost.groupBy("winner_id").agg(F.max(F.coalesce("eligible", F.lit(False))).alias("any_eligible"))
    kept = e.join(dealt(found.select("id")), "id", "left_anti").join(dealt(gained.withColumnRenamed("winner_id", "id")), "id", "left").join(dealt(eligible.withColumnRenamed("winner_id", "id")), "id", "left")
    both = F.when(c("gained").isNull(), c("aliases")).otherwise(E.merged_aliases(c("canonical_name"), F.concat("aliases", F.coalesce("gained", none))))
    own = F.when(c("any_eligible"), True).otherwise(c("graph_eligible"))
    return kept.withColumns({"aliases": both, "graph_eligible": own}).drop("gained", "any_eligible")


def repointed(claims: DataFrame, entities: DataFrame, found: DataFrame) -> DataFrame:
    """The claims with winners for losers at both ends, by id and name; hashes and repeats are then taken anew by the store's operators."""
    c = F.col
    names = found.alias("f").join(dealt(entities).alias("e"), c("f.winner_id") == c("e.id")).select(c("f.id").alias("loser"), "winner_id", c("e.canonical_name").alias("winner_name"))
    for side, text in (("subject_entity_id", "subject"), ("object_entity_id", "object")):
        claims = claims.join(dealt(names), c(side) == c("loser"), "left")
        claims = claims.withColumns({side: F.coalesce("winner_id", side), text: F.coalesce("winner_name", text)}).drop("loser", "winner_id", "winner_name")
    return claims


def narrators_repointed(claims: DataFrame, entities: DataFrame, povs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """claims whose ends are a narrator's entity on their scene's point of view (scene_id, pov), with their new hashes; and the entities left.

    A narrator's entity is one with a placeholder's name; it goes once no claim has it. The point of view is the entity of that name
    or alias in the claim's story (registry.with_narrator makes it before). Where there is none, or a scene tells no point of view, a
    claim stays as it is, but for suggested ones, which need review. Ids of other claims, null ones among them, don't change.
    """
    c = F.col
    narrators = entities.where(E.is_placeholder(c("canonical_name"))).select(c("id").alias("narrator"))
    ends = ("subject", "object")
    x = claims
    for end in ends:
        x = x.join(dealt(narrators.withColumnRenamed("narrator", f"{end}_narrator")), c(f"{end}_entity_id") == c(f"{end}_narrator"), "left")
    hit = c("subject_narrator").isNotNull() | c("object_narrator").isNotNull()
    told = povs.groupBy("scene_id").agg(F.min("pov").alias("pov"))
    names = claims.select("story_id", "scene_id").distinct().join(dealt(told), "scene_id").select("story_id", c("pov").alias("name")).distinct()
    who = E.resolved(names, entities.where(~E.is_placeholder(c("canonical_name")))).where("entity_id is not null").select("story_id", c("name").alias("pov"), c("entity_id").alias("pov_id"))
    who = who.join(dealt(entities.select(c("id").alias("pov_id"), c("canonical_name").alias("pov_name"))), "pov_id")
    x = x.join(dealt(told), "scene_id", "left").join(dealt(who), ["story_id", "pov"], "left")
    moved, flagged = hit & c("pov_id").isNotNull(), hit & c("pov_id").isNull()
    new = {"status": F.when(flagged & (c("status") == "suggested"), "needs_review").otherwise(c("status"))}
    for end in ends:
        on = moved & c(f"{end}_narrator").isNotNull()
        new |= {f"{end}_entity_id": F.when(on, c("pov_id")).otherwise(c(f"{end}_entity_id")), end: F.when(on, c("pov_name")).otherwise(c(end))}
    x = x.withColumns(new | {"moved": moved})
    by_id = T.entity_hash(c("subject_entity_id"), c("predicate"), c("object_entity_id"), c("claim_type"), F.lit(True))
    hashed = F.when(c("subject_entity_id").isNull(), T.string_hash(c("subject"), c("claim_type"), c("object"), F.lit(True))).otherwise(by_id)
    kept = [k for k in claims.columns if k != "source_hash"]
    old = c("source_hash") if "source_hash" in claims.columns else F.lit(None).cast("string")
    x = x.select(*kept, F.when(c("moved"), hashed).otherwise(old).alias("source_hash"))
    used = x.select(F.explode(F.array("subject_entity_id", "object_entity_id")).alias("id")).where("id is not null")
    unused = narrators.join(dealt(used), c("narrator") == c("id"), "left_anti").withColumnRenamed("narrator", "id")
    return x, entities.join(dealt(unused), "id", "left_anti").select(*entities.columns)
