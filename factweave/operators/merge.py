"""The ordered merge: extracted claims, in their order, into a scene's stored ones."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .review import history, resolved_status

#: Statuses of rows that a merge keeps and reinforces.
KEPT = ("approved", "canonized", "rejected")
_OUT = "scene_id long, id long, ord long, action string, status string, claim_version int, confidence double, source_hash string, valid_from_scene long, valid_until_scene long"
#: Also the ord of the extracted row whose fields a row took last, and the confidences it came with and was first reinforced with.
_FULL = _OUT + ", from_ord long, own_confidence double, first_confidence double"
#: What a stored row has besides.
STORED = ("story_id", "source", "is_major_plotline", "claim_version", "valid_from_scene", "confidence_history")
#: What a reinforced row takes over of the extracted one.
TAKEN = ("subject", "predicate", "object", "polarity", "subject_entity_id", "object_entity_id", "claim_type", "claim_text", "confidence", "canon_level", "evidence_text", "chunk_index", "generation_origin")


def keyed(claims: DataFrame) -> DataFrame:
    """Claims with the keys a merge compares: hash, evidence, pair and predicate. A stored hash counts; else rows without a subject's id are hashed by their words."""
    c = F.col
    polarity = F.coalesce("polarity", F.lit(True))
    by_id = T.entity_hash(c("subject_entity_id"), c("predicate"), c("object_entity_id"), c("claim_type"), polarity)
    named = {"subject", "object"} <= set(claims.columns)  # rows of ids alone have no words to go by
    by_words = T.string_hash(c("subject"), F.coalesce(F.when(F.trim("claim_type") != "", c("claim_type")), "predicate"), c("object"), polarity) if named else by_id
    return claims.withColumns(
        {
            "source_hash": F.coalesce(F.when(c("source_hash") != "", c("source_hash")) if "source_hash" in claims.columns else F.lit(None).cast("string"), F.when(c("subject_entity_id") != 0, by_id).otherwise(by_words)),
            "evidence_key": T.norm_evidence(c("evidence_text")),
            "merge_key": T.predicate_merge_key(c("predicate")),
            "polarity": polarity,
        }
    )


def with_canon(extracted: DataFrame, stored: DataFrame) -> DataFrame:
    """extracted and the open accepted fact of its story that it repeats (canon_id), by hash, else by pair; two equi-joins on
    tables of one row for each key, the lowest id of each."""
    canon = stored.where(F.col("status").isin(*V.PAST_CANON) & F.col("valid_until_scene").isNull())
    pair = ["subject_entity_id", "object_entity_id", "merge_key", "polarity"]
    by_hash = canon.groupBy("story_id", "source_hash").agg(F.min("id").alias("h"))
    by_pair = canon.where("subject_entity_id <> 0 and object_entity_id <> 0").groupBy("story_id", *pair).agg(F.min("id").alias("p"))
    x = extracted.join(by_hash, ["story_id", "source_hash"], "left").join(by_pair, ["story_id", *pair], "left")
    return x.withColumn("canon_id", F.coalesce("h", "p")).drop("h", "p")


def _rows(batches: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    for b in batches:
        yield from b.itertuples(index=False)


def _merge(rows: Iterable[tuple], scene: int) -> list[dict]:
    """One scene: the stored rows, then the extracted ones in order, each found, closed, suppressed or added."""
    by_hash, by_evidence, by_pair, open_now, facts, log = {}, {}, {}, {}, [], []
    whole = lambda v: None if pd.isna(v) or v == 0 else int(v)

    def index(fact: dict, evidence: str, first: bool) -> None:
        put = dict.setdefault if first else dict.__setitem__
        by_hash[fact["source_hash"]] = fact
        if evidence:
            put(by_evidence, evidence, fact)
        if fact["s"] and fact["o"]:
            put(by_pair, (fact["s"], fact["o"], fact["key"], fact["polarity"]), fact)
        opened(fact)

    def opened(fact: dict) -> None:
        if fact["s"] and fact["valid_until_scene"] is None:
            open_now[fact["s"], fact["key"], fact["polarity"]] = fact

    for r in rows:
        s, o, polarity = whole(r.subject_entity_id), whole(r.object_entity_id), bool(r.polarity)
        new = {
            "scene_id": scene, "id": r.id, "ord": r.ord, "action": "kept", "status": r.status, "claim_version": int(r.claim_version), "confidence": r.confidence,
            "source_hash": r.source_hash, "valid_from_scene": r.valid_from_scene, "valid_until_scene": whole(r.valid_until_scene), "s": s, "o": o, "key": r.merge_key, "polarity": polarity, "from_ord": None, "told": False, "own_confidence": r.confidence, "first_confidence": None,
        }
        if not r.extracted:
            index(new, r.evidence_key, first=True)
            facts.append(new)
            continue
        found = by_hash.get(r.source_hash)
        if found is None and r.evidence_key and (told := by_evidence.get(r.evidence_key)) and told["polarity"] == polarity:
            found = told
        if found is None and s and o:
            found = by_pair.get((s, o, r.merge_key, polarity))
        if found is not None:
            if by_hash.get(found["source_hash"]) is found:
                del by_hash[found["source_hash"]]
            if found["action"] == "kept" or found["action"] == "closed":
                found["claim_version"] += 1
            elif found["action"] == "inserted":
                found["claim_version"] += not found.get("bumped")
            found.update(from_ord=r.ord, told=True, first_confidence=found["first_confidence"] if found["told"] else r.confidence)
            found.update(action="reinforced" if found["action"] != "inserted" else "inserted", bumped=True, source_hash=r.source_hash, confidence=r.confidence, s=s, o=o, key=r.merge_key, polarity=polarity)
            index(found, r.evidence_key, first=False)
            continue
        prior = open_now.get((s, r.merge_key, polarity)) if s and o and r.merge_key in V.TRANSITIONS else None
        if prior is not None and prior["o"] != o and prior["valid_until_scene"] is None:
            prior["valid_until_scene"] = scene
            if prior["action"] == "kept":
                prior["action"] = "closed"
        if whole(r.canon_id):
            log.append(new | {"action": "suppressed"})
            continue
        new.update(action="inserted", valid_from_scene=scene, from_ord=r.ord)
        index(new, r.evidence_key, first=False)
        facts.append(new)
    return facts + log


def _stream(columns: str):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Scenes one after the other, as they come sorted; only one scene's facts are held, and some results."""
        names, held = [c.split()[0] for c in columns.split(", ")], []
        whole = {n: "Int64" for n in ("id", "ord", "valid_until_scene", "valid_from_scene", "from_ord") if n in names} | {n: "float64" for n in ("own_confidence", "first_confidence") if n in names}
        frame = lambda: pd.DataFrame(held, columns=names).astype(whole)
        for scene, rows in groupby(_rows(batches), key=lambda r: r.scene_id):
            held += [{n: f[n] for n in names} for f in _merge(rows, int(scene))]
            if len(held) >= 10_000:
                yield frame()
                held = []
        if held:
            yield frame()

    return build


def merged(stored: DataFrame, extracted: DataFrame) -> DataFrame:
    """What the merge makes of each row: kept, reinforced (one version more, however often it's told), closed (the same subject and
    predicate got another object), inserted, or suppressed (told and accepted elsewhere in the story).

    It takes claims with entity ids; ord orders a scene's extracted rows. Each row depends on all before it, so a scene's rows go
    through one task in order, as a stream that holds the scene's facts (one chapter's claims), never a partition. Rows to be replaced (suggested, needs_review, deprecated) must be gone from `stored`'s
    scene, and are left out here. Nulls: polarity is true, a missing object has no pair.
    """
    return _ordered(stored, extracted).mapInPandas(_stream(_OUT), _OUT)


def merged_rows(stored: DataFrame, extracted: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """The claims of each scene as whole rows after the merge, with `action` as merged() has it; suppressed ones are rows too, to be counted and dropped.

    stored: a story's rows with TAKEN and the columns of STORED; those of status suggested, needs_review or deprecated are
    left out. extracted: resolved rows with TAKEN, ord, and a story's id; canon: where accepted facts are looked for, else `stored`. A
    reinforced row takes the extracted fields and keeps its status; it gets one version and one entry of its history more, however often it is
    told (the entry has the confidence of the first telling). A new row begins at version 1 with its own entry, and has no id yet. Only keys and
    confidences go through the ordered stream; the rows' texts are joined to what it tells, by equal keys, once for each side.
    """
    c = F.col
    told = _ordered(stored, extracted, canon).mapInPandas(_stream(_FULL), _FULL)
    facts = told.select("scene_id", c("id").alias("row_id"), "action", c("status").alias("new_status"), c("claim_version").alias("added"), c("source_hash").alias("new_hash"), c("valid_until_scene").alias("until"), "from_ord", "own_confidence", "first_confidence", c("ord").alias("own_ord"))
    facts = facts.withColumn("from_ord", F.coalesce("from_ord", F.when(c("action") == "suppressed", c("own_ord"))))
    old = stored.select(c("id").alias("row_id"), F.struct(*[c(x) for x in (*TAKEN, *STORED)]).alias("old"))
    new = extracted.select("scene_id", c("ord").alias("from_ord"), c("story_id").alias("new_story"), F.struct(*[c(x) for x in TAKEN]).alias("new"))
    keys, is_new = F.coalesce("from_ord", F.lit(-1)), c("action").isin("inserted", "suppressed")
    x = facts.withColumns({"from_ord": keys, "row_id": F.when(~is_new, c("row_id")), "own_ord": F.when(is_new, c("own_ord"))})
    x = x.join(old, "row_id", "left").join(new, ["scene_id", "from_ord"], "left")
    version = F.when(is_new, c("added")).otherwise(F.coalesce("old.claim_version", F.lit(1)) + c("added") - 1)
    taken = c("new").isNotNull()
    begun = history(c("own_confidence"), c("scene_id"), F.lit(1))
    more = lambda before: F.when(c("first_confidence").isNull(), before).otherwise(history(c("first_confidence"), c("scene_id"), version, before))
    fields = {f: F.when(taken, c(f"new.{f}")).otherwise(c(f"old.{f}")) for f in TAKEN}
    major = F.coalesce((fields["claim_type"] == "plotline_fact") | (fields["canon_level"] == "core"), F.lit(False))
    return x.select(
        c("row_id").alias("id"), F.coalesce("old.story_id", "new_story").alias("story_id"), "scene_id", "action", *[v.alias(k) for k, v in fields.items()],
        c("new_status").alias("status"), F.when(is_new, F.lit("extracted")).otherwise(c("old.source")).alias("source"), F.when(taken, major).otherwise(c("old.is_major_plotline")).alias("is_major_plotline"),
        c("new_hash").alias("source_hash"), version.cast("int").alias("claim_version"), F.when(is_new, c("scene_id")).otherwise(c("old.valid_from_scene")).alias("valid_from_scene"), c("until").alias("valid_until_scene"),
        F.when(is_new, more(begun)).otherwise(more(c("old.confidence_history"))).alias("confidence_history"), F.when(is_new, c("own_ord")).alias("ord"),
    )


def _ordered(stored: DataFrame, extracted: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """Stored and extracted rows of a scene in one partition, in the order in which the merge takes them."""
    if "id" not in extracted.columns:
        extracted = extracted.withColumn("id", F.lit(None).cast("long"))
    s = keyed(stored)
    cols = ["scene_id", "id", "subject_entity_id", "object_entity_id", "polarity", "source_hash", "evidence_key", "merge_key", "status", "confidence"]
    old = s.where(F.col("status").isin(*KEPT)).select(*cols, F.col("id").alias("ord"), F.lit(False).alias("extracted"), F.lit(1).alias("claim_version"), F.lit(None).cast("long").alias("canon_id"), F.col("scene_id").alias("valid_from_scene"), "valid_until_scene")
    status = resolved_status(F.col("confidence"), F.col("review_status")) if "review_status" in extracted.columns else T.status_for_confidence(F.col("confidence"))
    new = with_canon(keyed(extracted), s if canon is None else keyed(canon)).withColumn("status", status).select(*cols, "ord", F.lit(True).alias("extracted"), F.lit(1).alias("claim_version"), "canon_id", F.col("scene_id").alias("valid_from_scene"), F.lit(None).cast("long").alias("valid_until_scene"))
    return old.unionByName(new).repartition("scene_id").sortWithinPartitions("scene_id", "extracted", "ord")
