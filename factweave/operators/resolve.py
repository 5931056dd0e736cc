"""Claims onto a story's register: entity ids, canonical names, refined predicates and types, and the hash they are known by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..session import saved
from . import registry
from .entities import classify, is_placeholder, refined_type
from .review import refined_predicate

#: Characters of a claim's sentence that stand in for a missing object.
OBJECT_CHARS = 255


def consecutive(df: DataFrame, name: str, start: int, *order: str) -> DataFrame:
    """df with a column of numbers start, start + 1, ... in the given order: a prefix sum in two passes.

    Rows are dealt out by ranges of the order and written once; then each range's count, a row for each, gives where its
    numbers begin. No row passes through the driver, and none but the counts through one task. Equal keys come in any order.
    """
    at = F.monotonically_increasing_id()  # the range's number above 33 bits, the place in it below
    ranged = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    begin = F.broadcast(counts.select("_part", before.alias("_begin")))
    return ranged.withColumn("_part", part).join(begin, "_part").withColumn(name, F.lit(start) + F.col("_begin") + place).drop("_at", "_part", "_begin")


def told_predicate(claims: DataFrame) -> Column:
    """The predicate as told, unless it is none or a type's name: then the one its sentence tells. Writers' own keep their letters."""
    c = F.col
    own = F.trim(F.coalesce("predicate", F.lit("")))
    known = F.lower(own)
    inferred = T.infer_predicate(c("claim_type"), c("claim_text"))
    extracted = F.when((own != "") & ~known.isin(*V.ENTITY_TYPES, *V.CLAIM_TYPES), known).otherwise(inferred)
    return F.when(c("entered"), F.when(known.isin(*V.CLAIM_TYPES), inferred).otherwise(own)).otherwise(extracted)


def resolved_claims(entities: DataFrame, claims: DataFrame, povs: DataFrame | None = None, next_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims, entities) after all claims are told, in the order of ord within each story.

    claims: rows with story_id, ord (a whole number, distinct within its story), subject, predicate, object, claim_type,
    claim_text, evidence_text, polarity, any other columns, and `entered` where a writer entered them. They come back with
    subject_entity_id, object_entity_id, the canonical names as they were right after the claim was told, predicate, claim_type,
    source_hash and `unresolved`: which end is nobody (blank, or a placeholder such as I); such claims get no ids and tell nothing.
    A blank object has no id; its claim's sentence stands in for it. povs (story_id, pov): narrators, told before
    all claims. entities: also those added, numbered from next_id (else after the largest id) by story, in the order of their telling.

    The register's task emits each mention's place; ids and claims are then joined by equal keys.
    """
    c = F.col
    blank = lambda x: T.norm(c(x)) == ""
    entered = F.coalesce("entered", F.lit(False)) if "entered" in claims.columns else F.lit(False)
    clean = claims.withColumns({x: F.trim(F.coalesce(x, F.lit(""))) for x in ("subject", "object")} | {"entered": entered, "polarity": F.coalesce("polarity", F.lit(True))})
    said = F.coalesce(F.when(~blank("claim_text"), F.trim("claim_text")), F.when(c("entered"), F.concat_ws(" ", "subject", "predicate", "object")), F.lit(""))
    proof = F.when(c("entered"), "").otherwise(F.trim(F.coalesce("evidence_text", F.lit(""))))
    kind = F.trim(F.coalesce(F.when(~blank("claim_type"), c("claim_type")), F.when(c("entered"), "relationship_state"), F.lit("")))
    nobody = F.when(blank("subject") | is_placeholder(c("subject")), "subject").when(~blank("object") & is_placeholder(c("object")), "object")
    clean = clean.withColumns({"claim_type": kind, "unresolved": nobody, "_said": said, "_proof": proof})
    # Both ends are typed once, for the register and for the claim's own type.
    base = saved(clean.withColumns({f"_{n}_type": classify(c(n), F.concat_ws(" ", "_said", "_proof"), F.lit(n)) for n in ("subject", "object")}), "claims-told")

    good = base.where("unresolved is null")
    end = lambda name, more: good.where(~blank(name)).select("story_id", (c("ord") * 2 + more).alias("ord"), c(name).alias("name"), c("_said").alias("sentence"), c("_proof").alias("evidence"), F.lit(name).alias("role"), c(f"_{name}_type").alias("typed"))
    mentions = end("subject", 0).unionByName(end("object", 1))
    if povs is not None:
        mentions = registry.with_narrator(mentions, povs.join(good.select("story_id").distinct(), "story_id", "left_semi"))
    told = saved(registry.told(entities, mentions), "register")

    rows = told.where("told_ord is null").drop("told_ord")
    if next_id is None:
        next_id = (entities.agg(F.max("id")).first()[0] or 0) + 1
    added = consecutive(rows.where("id is null").drop("id"), "id", next_id, "story_id", "place")
    after = rows.where("id is not null").unionByName(added.select(*rows.columns))
    after = saved(after, "entities")
    ids = told.where("told_ord is not null").select("story_id", "place", "told_ord", "canonical_name", "place_granularity").join(after.select("story_id", "place", "id"), ["story_id", "place"])
    of = lambda name, more: ids.where(F.pmod("told_ord", F.lit(2)) == more).select("story_id", F.floor(c("told_ord") / 2).cast("long").alias("ord"), F.struct("id", "canonical_name", "place_granularity").alias(name))
    x = base.join(of("_s", 0), ["story_id", "ord"], "left").join(of("_o", 1), ["story_id", "ord"], "left")

    kinds = {n: c(f"_{n}_type.entity_type") for n in ("subject", "object")}
    predicate = told_predicate(x)
    located = F.when(~c("entered") & c("_o").isNotNull(), refined_predicate(predicate, c("object"), c("_proof"), c("_o.place_granularity"))).otherwise(predicate)
    x = x.withColumn("predicate", F.when(c("unresolved").isNull(), located).otherwise(predicate))
    x = x.withColumn("claim_type", refined_type(c("claim_type"), c("predicate"), kinds["subject"], F.when(c("_o").isNotNull(), kinds["object"])))
    ids = {"subject_entity_id": c("_s.id"), "object_entity_id": c("_o.id")}
    own = F.when(c("_o.id") == c("_s.id"), c("_o.canonical_name")).otherwise(c("_s.canonical_name"))  # the object may have renamed the subject
    stand_in = F.when(c("entered") | (c("object") != ""), c("object")).otherwise(F.substring("_said", 1, OBJECT_CHARS))
    x = x.withColumns(ids | {"subject": F.coalesce(own, "subject"), "object": F.coalesce("_o.canonical_name", stand_in)})
    hashed = F.when(c("subject_entity_id").isNotNull(), T.entity_hash(c("subject_entity_id"), c("predicate"), c("object_entity_id"), c("claim_type"), c("polarity")))
    return x.withColumn("source_hash", hashed).drop("_s", "_o", "_said", "_proof", "_subject_type", "_object_type"), after
