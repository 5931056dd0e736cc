"""Old schemas' rows as rows of today: each step fills what it adds, from what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import resolve
from . import adapters as A
from .oracle import _KIND, _in

#: What a column is where nobody said.
DEFAULTS = {"confidence": 1.0, "canon_level": "active", "status": "approved", "source": "manual"}
ELIGIBLE_CONFIDENCE = 0.85


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def rich(claims: DataFrame) -> DataFrame:
    """Claims of three words get a type (their predicate), a text, and the defaults; evidence and chunk stay unknown."""
    text = F.concat_ws(" ", "subject", "predicate", "object")
    kinds = {"confidence": "double"}
    return claims.withColumns(
        {"claim_type": F.coalesce(_has(claims, "claim_type"), "predicate"), "claim_text": F.coalesce(_has(claims, "claim_text"), text), "evidence_text": _has(claims, "evidence_text"), "chunk_index": _has(claims, "chunk_index", "int")}
        | {n: F.coalesce(_has(claims, n, kinds.get(n, "string")), F.lit(v)) for n, v in DEFAULTS.items()}
    )


def versioned(claims: DataFrame) -> DataFrame:
    """Version 1, and the hash of a claim's words where there is none."""
    kind = F.coalesce(F.when(F.trim("claim_type") != "", F.col("claim_type")), "predicate")
    words = T.string_hash(F.col("subject"), kind, F.col("object"), F.lit(True))
    return claims.withColumns({"claim_version": F.coalesce(_has(claims, "claim_version", "int"), F.lit(1)), "source_hash": F.coalesce(_has(claims, "source_hash"), words)})


def with_entities(claims: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims, told in the order of their ids as writers' own, with their ends' ids, predicates and hashes; and the register they make. Names stay as written;
    claims with a blank or a placeholder's end keep what they have."""
    told = claims.select("id", "story_id", F.col("id").alias("ord"), "subject", "predicate", "object", "claim_type", "claim_text", F.lit(None).cast("string").alias("evidence_text"), F.lit(True).alias("polarity"), F.lit(True).alias("entered"), F.struct(*claims.columns).alias("_row"))
    resolved, after = resolve.resolved_claims(entities, told)
    found = {"_p": "predicate", "_s": "subject_entity_id", "_o": "object_entity_id", "_h": "source_hash"}
    x = resolved.select("_row.*", *[F.when(F.col("unresolved").isNull(), F.col(n)).alias(k) for k, n in found.items()])
    new = {"subject_entity_id": F.col("_s"), "object_entity_id": F.col("_o"), "predicate": F.coalesce("_p", "predicate"), "source_hash": F.coalesce("_h", "source_hash")}
    return x.withColumns(new).drop(*found), after


def eligible(entities: DataFrame) -> DataFrame:
    """Characters are in the graph, surely enough; others are where they were said to be."""
    person = F.coalesce(F.col("entity_type") == "character", F.lit(False))
    return entities.withColumns({"graph_eligible": person | F.coalesce(_has(entities, "graph_eligible", "boolean"), F.lit(False)), "type_confidence": F.when(person, ELIGIBLE_CONFIDENCE).otherwise(_has(entities, "type_confidence", "double"))})


def sourced(claims: DataFrame, now: Column) -> DataFrame:
    """Where claims came from and when: writers' own are manual; extracted ones of unknown origin were extracted when they were made."""
    origin = F.coalesce(_has(claims, "generation_origin"), F.lit("unknown"))
    x = claims.withColumns({"created_at": F.coalesce(_has(claims, "created_at", "timestamp"), now), "updated_at": F.coalesce(_has(claims, "updated_at", "timestamp"), now), "extracted_at": _has(claims, "extracted_at", "timestamp"), "_origin": origin})
    made = F.when((F.col("source") == "extracted") & F.col("extracted_at").isNull() & (F.col("_origin") == "unknown"), F.col("created_at")).otherwise(F.col("extracted_at"))
    return x.withColumns({"extracted_at": made, "generation_origin": F.when((F.col("source") == "manual") & (F.col("_origin") == "unknown"), "manual").otherwise(F.col("_origin"))}).drop("_origin")


def upgraded(claims: DataFrame, entities: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """All steps in their order, from claims of any earlier schema (id, story_id, scene_id, subject, predicate, object at least)."""
    told, register = with_entities(versioned(rich(claims)), entities)
    return sourced(told, now), eligible(register)


def _old(spark: SparkSession, d: str) -> DataFrame:
    """Claims as older schemas left them, here and there without a type, text, level, state or source."""
    i = F.col("id")
    gone = {"claim_type": 3, "claim_text": 4, "confidence": 5, "canon_level": 2, "status": 7}
    x = A.claims(spark, d).drop("subject_entity_id", "object_entity_id", "evidence_text", "polarity", "valid_until_scene", "is_major_plotline")
    return x.withColumns({n: F.when(i % k > 0, F.col(n)) for n, k in gone.items()} | {"source": F.when(i % 6 == 0, "extracted").when(i % 6 == 1, "manual"), "created_at": F.lit("2024-01-02 03:04:05")})


def _claims(spark: SparkSession, d: str) -> DataFrame:
    x, _ = upgraded(_old(spark, d), A.entities(spark, d), F.lit("2025-01-01 00:00:00").cast("timestamp"))
    cols = ["id", "predicate", "claim_type", "claim_text", "confidence", "canon_level", "status", "source", "claim_version", "subject_entity_id", "object_entity_id", "source_hash", "generation_origin"]
    return x.select(*cols, F.date_format("extracted_at", "yyyy-MM-dd HH:mm:ss").alias("extracted_at"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return eligible(A.entities(spark, d).drop("graph_eligible")).select("id", "graph_eligible", "type_confidence")


QUERIES = {"snk_upgraded_claims": _claims, "snk_upgraded_entities": _entities}

_NAMES = A._list(A.NAMES)
ORACLES = {
    "snk_upgraded_claims": rf"""{A.SQL}, kinds AS (SELECT name, role, split_part({_KIND}, ' ', 1) AS kind FROM (SELECT unnest({_NAMES}) AS name, 'subject' AS role UNION SELECT unnest({_NAMES}), 'object')),
x AS (SELECT c.id, c.story_id, subject, predicate, object, CASE WHEN c.id % 3 > 0 THEN claim_type ELSE predicate END AS claim_type, claim_text, CASE WHEN c.id % 5 > 0 THEN confidence ELSE 1.0 END::DOUBLE AS confidence,
  CASE WHEN c.id % 2 > 0 THEN canon_level ELSE 'active' END AS canon_level, CASE WHEN c.id % 7 > 0 THEN status ELSE 'approved' END AS status, CASE WHEN c.id % 6 = 0 THEN 'extracted' ELSE 'manual' END AS source,
  s.id AS sid, o.id AS oid, a.kind AS sk, b.kind AS ok FROM claims c JOIN entities s ON s.story_id = c.story_id AND s.canonical_name = subject JOIN entities o ON o.story_id = c.story_id AND o.canonical_name = object
  JOIN kinds a ON a.name = subject AND a.role = 'subject' JOIN kinds b ON b.name = object AND b.role = 'object'),
y AS (SELECT *, CASE WHEN (replace(predicate, ' ', '_') IN {_in(V.RELATIONAL)} OR claim_type = 'relationship_state') AND sk = 'character'
  THEN CASE ok WHEN 'character' THEN 'relationship_state' WHEN 'place' THEN 'place_preference' WHEN 'group' THEN 'character_state' ELSE 'character_preference' END ELSE claim_type END AS refined FROM x)
SELECT id, predicate, claim_type, claim_text, confidence, canon_level, status, source, 1::INTEGER AS claim_version, sid AS subject_entity_id, oid AS object_entity_id,
 substr(sha256(sid || '|' || predicate || '|' || oid || '|' || refined), 1, 32) AS source_hash, CASE WHEN source = 'manual' THEN 'manual' ELSE 'unknown' END AS generation_origin,
 CASE WHEN source = 'extracted' THEN '2024-01-02 03:04:05' END AS extracted_at FROM y""",
    "snk_upgraded_entities": f"{A.SQL} SELECT id, entity_type = 'character' AS graph_eligible, CASE WHEN entity_type = 'character' THEN 0.85::DOUBLE END AS type_confidence FROM entities",
}
