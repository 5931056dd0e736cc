"""Continuity: contradictions between a scene's claims and the accepted facts of earlier scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..session import dealt, saved


#: Claims of one part: what a task sorts stays small however many claims there are.
PART_ROWS = 100_000


def prepared(claims: DataFrame, scenes: DataFrame, entities: DataFrame, touched: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Claims with their scene's number, comparison keys and, for places, granularity; each computed once a claim, before any pair.

    They are written once and dealt out by story, in parts that grow in number with them: all that meets lies in one part then.
    touched: scenes (scene_id); claims in them are marked so. more: columns of claims that stay.
    """
    c = claims.join(scenes.select(F.col("id").alias("scene_id"), "scene_number"), "scene_id")
    if touched is not None:
        # In no more parts than the claims have, so that they stay where they lie, by scene.
        few = touched.select("scene_id").repartition(claims.sparkSession.sparkContext.defaultParallelism, "scene_id").distinct()
        c = c.join(dealt(few.withColumn("touched", F.lit(True))), "scene_id", "left")
    cp = T.continuity_predicate(F.col("predicate"), F.col("claim_type"), F.col("claim_text"), F.col("evidence_text"))
    told = F.coalesce(F.when(F.col("evidence_text") != "", F.col("evidence_text")), "claim_text", F.lit(""))
    c = c.withColumns({"cp": cp, "told": told, "subject_key": T.norm(F.col("subject")), "object_key": T.norm(F.col("object"))})
    c = c.withColumn("is_place", T.is_location(F.col("cp")))
    c = c.withColumns(
        {
            "stance": T.predicate_key(T.stance(F.col("cp"), F.col("polarity"))),
            # Only places are held against where they lie and what is told of them.
            "told": F.when(F.col("is_place"), F.col("told")),
            "sid": F.when(F.col("subject_entity_id") != 0, F.col("subject_entity_id")),
            "oid": F.when(F.col("object_entity_id") != 0, F.col("object_entity_id")),
        }
    )
    kept = [n for n in (*COLUMNS, *more) if n != "place"]
    keyed = saved(c.select(*kept, "object_entity_id", *(["touched"] if touched is not None else [])), "prepared")
    parts = max(claims.sparkSession.sparkContext.defaultParallelism, -(-keyed.count() // PART_ROWS))  # told by the files' footers
    return _placed(keyed, entities).repartition(parts, "story_id")


def _placed(keyed: DataFrame, entities: DataFrame) -> DataFrame:
    """Places with their granularity. Only they are held against the entities: all other claims pass by."""
    c = F.col
    e = entities.where("place_granularity is not null").select(c("id").alias("object_entity_id"), "place_granularity")
    asks = F.coalesce(c("is_place"), F.lit(False)) & c("object_entity_id").isNotNull()
    x = keyed.where(asks).join(dealt(e), "object_entity_id", "left").select(*keyed.columns, "place_granularity")
    x = x.unionByName(keyed.where(~asks).withColumn("place_granularity", F.lit(None).cast("string")))
    place = F.when(c("is_place"), T.place_granularity(c("object"), c("told"), c("place_granularity")))
    return x.withColumns({"place": place, "told": F.when(c("is_place"), T.norm(c("told")))}).drop("place_granularity", "object_entity_id")


#: What a pair is judged by, and what its issue tells.
_KEEP = ("id", "scene_number", "polarity", "is_major_plotline", "cp", "stance", "place", "is_place", "told", "subject_key", "object_key", "sid", "oid")
_TOLD = ("id", "scene_id", "scene_number", "subject", "predicate", "object", "polarity")
#: All that the rules read of prepared().
COLUMNS = tuple(dict.fromkeys(("story_id", *_KEEP, *_TOLD, "status", "valid_until_scene")))

KINDS = ("polarity_flip", "exclusive_object", "predicate_opposition")
#: Meetings: (kind, whether objects must be equal, whether predicates must be). Two of exclusive objects: of a new claim that is exclusive, and of one that isn't.
_MEETINGS = (("polarity_flip", True, True), ("exclusive_object", False, True), ("exclusive_object", False, True), ("predicate_opposition", True, False))
#: A subject or object is met by its id, if it has one, and by its name.
_BY = ("id", "name")


def _keys(kinds: tuple[str, ...], *joins: tuple[Column, Column]) -> Column:
    """The keys under which a claim is met, of the meetings that it joins as a new or an old one: which meeting, what subject and object are met by, and a hash of them."""
    ends = {"subject": {"id": F.col("sid"), "name": F.col("subject_key")}, "object": {"id": F.col("oid"), "name": F.col("object_key")}}
    has = lambda end, by: ends[end][by].isNotNull() if by == "id" else F.lit(True)
    keys = []
    for n, ((kind, objects, predicates), (new, old)) in enumerate(zip(_MEETINGS, joins, strict=True)):
        for i, s in enumerate(_BY):
            for k, o in enumerate(_BY if objects else _BY[:1]):
                parts = [ends["subject"][s], *([ends["object"][o]] if objects else []), *([F.col("cp")] if predicates else [])]
                holds = (new | old) & has("subject", s) & (has("object", o) if objects else F.lit(True))
                if kind in kinds:
                    keys.append(F.when(holds, F.struct(F.lit(4 * n + 2 * i + k).alias("by"), F.xxhash64(*parts).alias("hash"), new.alias("as_new"), old.alias("as_old"))))
    return F.array_compact(F.array(*keys))


def _meeting(claims: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(story_id, n, o, meeting): claims of one story that meet, n one of is_new and o one of is_old and of an earlier scene.

    Where both have an id, ids decide, else names. Claims are listed under both, and a pair counts only under the key that decides, so
    no pair comes twice. Claims that are dealt out by story are grouped where they lie (a join would deal out all they are listed under);
    a group holds those of one story and subject with one predicate or object. Hashes only find pairs, whose keys are then held against each other.
    """
    c, n, o = F.col, lambda x: F.col(f"n.{x}"), lambda x: F.col(f"o.{x}")
    strong = F.coalesce(T.predicate_key(c("cp")).isin(*V.EXCLUSIVE) | c("object_key").isin(*V.NOBODY), F.lit(False))
    x = claims.withColumns({"_strong": strong, "_opposable": F.coalesce(c("stance").isin(*_OPPOSABLE), F.lit(False))})
    new, old = c("is_new"), c("is_old")
    keys = _keys(kinds, (new, old), (new & c("_strong"), old), (new & ~c("_strong"), old & c("_strong")), (new & c("_opposable"), old & c("_opposable")))
    kept = [name for name in claims.columns if name not in ("story_id", "is_new", "is_old")]
    listed = x.select("story_id", F.struct(*kept).alias("claim"), F.explode(keys).alias("key")).select("story_id", "claim", "key.*")
    of = lambda role: F.collect_list(F.when(c(role), c("claim")))
    groups = listed.groupBy("story_id", "by", "hash").agg(of("as_new").alias("new"), of("as_old").alias("old")).where((F.size("new") > 0) & (F.size("old") > 0))
    met = groups.select("story_id", "by", F.explode("new").alias("n"), "old").select("story_id", "by", "n", F.explode("old").alias("o"))
    meeting = F.shiftright("by", 2)

    def equal(by_name: Column, i: str, name: str) -> Column:
        """Both ids are there and equal, or one is missing and the names are equal; only under the key that says so."""
        return F.when(n(i).isNotNull() & o(i).isNotNull(), ~by_name & (n(i) == o(i))).otherwise(by_name & (n(name) == o(name)))

    same = equal(c("by").bitwiseAND(2) > 0, "sid", "subject_key")
    same_object = meeting.isin(1, 2) | equal(c("by").bitwiseAND(1) > 0, "oid", "object_key")
    return met.where((o("scene_number") < n("scene_number")) & same & same_object).select("story_id", "n", "o", meeting.alias("meeting"))


def _opposed(a: Column, b: Column) -> Column:
    either = lambda xs, ys: a.isin(*xs) & b.isin(*ys) | b.isin(*xs) & a.isin(*ys)
    family = a.isin(*V.NEGATIVE) & b.isin(*V.NEGATIVE) | a.isin(*V.POSITIVE) & b.isin(*V.POSITIVE) | a.isin(*V.MILD) & b.isin(*V.MILD)
    named = F.concat_ws(">", a, b).isin(*[f"{x}>{y}" for x, y in V.OPPOSITES] + [f"{y}>{x}" for x, y in V.OPPOSITES])
    return (a != b) & ~family & (named | either(V.APPROACHING, V.AVOIDING) | either(V.POSITIVE, V.NEGATIVE))


#: Stances that can be opposed to another.
_OPPOSABLE = tuple(sorted({x for pair in V.OPPOSITES for x in pair} | {*V.APPROACHING, *V.AVOIDING, *V.POSITIVE, *V.NEGATIVE}))


def pairs(prep: DataFrame, scenes: DataFrame | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(story_id, n, o, severity, conflict_kind): pairs of claims that contradict each other, as structs of all columns of prep; a pair can raise two.

    Only claims meet that can raise an issue: for a flip, of one predicate and object; for an exclusive object, of one predicate, one
    of them exclusive; for a tension, of one object and stances that have an opposite. Of prepared claims with touched scenes
    only those in them are checked.
    """
    n, o = lambda c: F.col(f"n.{c}"), lambda c: F.col(f"o.{c}")
    same_object = F.when(n("oid").isNotNull() & o("oid").isNotNull(), n("oid") == o("oid")).otherwise(n("object_key") == o("object_key"))
    same = n("cp") == o("cp")
    flip = same & same_object & ~n("polarity").eqNullSafe(o("polarity"))
    other = n("object_key") != o("object_key")
    told = F.concat_ws(" ", n("told"), o("told"))
    mentioned = (n("object_key") != "") & told.contains(n("object_key")) | (o("object_key") != "") & told.contains(o("object_key"))
    placed = other & n("is_place") & o("is_place") & T.places_compatible(o("place"), n("place"), mentioned)
    only_one = T.predicate_key(n("cp")).isin(*V.EXCLUSIVE) | n("object_key").isin(*V.NOBODY) | o("object_key").isin(*V.NOBODY)
    placed = F.coalesce(placed, F.lit(False))
    judged = {
        "polarity_flip": flip,
        "exclusive_object": ~flip & ~placed & same & other & only_one,
        "predicate_opposition": ~flip & ~placed & same_object & _opposed(o("stance"), n("stance")),
    }
    major = F.coalesce(n("is_major_plotline"), F.lit(False)) | F.coalesce(o("is_major_plotline"), F.lit(False))
    checked = F.lit(True)
    if scenes is not None:
        prep = prep.join(scenes.select("scene_id").distinct().withColumn("touched", F.lit(True)), "scene_id", "left")
    if "touched" in prep.columns:
        checked = F.coalesce("touched", F.lit(False))
    roles = {"is_new": F.col("status").isin(*V.CURRENT_CHECK) & checked, "is_old": F.col("status").isin(*V.PAST_CANON) & F.col("valid_until_scene").isNull()}
    claims = prep.withColumns({n: F.coalesce(role, F.lit(False)) for n, role in roles.items()}).where("story_id is not null and (is_new or is_old)")
    claims = claims.drop("status", "valid_until_scene", "touched")
    met, kind, holds = _meeting(claims, kinds), F.lit(None).cast("string"), F.lit(False)
    for i, (name, *_) in enumerate(_MEETINGS):
        kind, holds = F.when(F.col("meeting") == i, name).otherwise(kind), F.when(F.col("meeting") == i, judged[name]).otherwise(holds)
    return met.where(holds).select("story_id", "n", "o", F.when(major, "high").otherwise("medium").alias("severity"), kind.alias("conflict_kind"))


def conflicts(prep: DataFrame, scenes: DataFrame | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(current_claim_id, conflicting_claim_id, severity, conflict_kind) of pairs()."""
    return pairs(prep, scenes, kinds).select(F.col("n.id").alias("current_claim_id"), F.col("o.id").alias("conflicting_claim_id"), "severity", "conflict_kind")


def issues(prep: DataFrame, scenes: DataFrame | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """A row for each issue of the given kinds, of the given scenes if any are given, as continuity tells it."""
    c = F.col
    found = pairs(prep, scenes, kinds)
    said = lambda who: F.concat_ws(" ", f"{who}.subject", f"{who}.predicate", f"{who}.object")
    told = {
        "polarity_flip": ("Scene ", c("n.scene_number"), " reverses an earlier fact: '", F.when(c("o.polarity"), said("o")).otherwise(said("n")), "' is now negated."),
        "exclusive_object": ("Scene ", c("n.scene_number"), " contradicts earlier fact: ", c("n.subject"), " ", c("n.predicate"), " was '", c("o.object"), "', now '", c("n.object"), "'."),
        "predicate_opposition": ("Scene ", c("n.scene_number"), " conflicts with an earlier claim about ", c("n.subject"), " and ", c("n.object"), ": earlier '", c("o.predicate"), "', now '", c("n.predicate"), "'."),
    }
    message = F.lit(None).cast("string")
    for kind, parts in told.items():
        message = F.when(c("conflict_kind") == kind, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])).otherwise(message)
    hard = c("conflict_kind") != "predicate_opposition"
    tail = F.when(c("severity") == "high", " This conflicts with a major plotline relationship/fact.").otherwise("")
    return found.select(
        "story_id", c("n.scene_id").alias("scene_id"), c("n.id").alias("current_claim_id"), c("o.id").alias("conflicting_claim_id"), "severity", "conflict_kind",
        F.when(hard, "hard_contradiction").otherwise("soft_tension").alias("judge_classification"), F.when(hard, 1.0).otherwise(0.75).alias("judge_confidence"), F.concat(message, tail).alias("message"),
    )
