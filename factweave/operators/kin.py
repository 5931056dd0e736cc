"""Kin and social facts from prose told by a narrator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .extraction import narrator

# Names of roles, where the text tells them (pattern, name).
CAST = {
    "mom": (("Renée", "Renée"), ("(?iU)Renée|Renee", "Renee")),
    "dad": ((r"(?U)\bCharlie\b", "Charlie"),),
    "phil": ((r"(?U)\bPhil\b", "Phil"),),
    "billy": (("(?i)Billy Black", "Billy Black"),),
}
# Parents as (pattern, role, name where the text tells none, predicate of the parent, noun).
PARENTS = (
    (r"\bmy\s+(?:mother|mom|mum)\b()", "mom", "Mom", "mother_of", "mother"),
    (r"\bmy\s+(?:father|dad|pa)(?:\s*,\s*([A-Z][a-z]+))?", "dad", "Dad", "father_of", "father"),
)
# Fixed values: (pattern, subject, predicate, object, sentence, type, confidence, longest evidence). "I" is the narrator; %s the narrator
# or, without one, the subject.
FACTS = (
    (r"\b(?:she|Renée|Renee|my mother)\s+had\s+Phil\b", "mom", "partner_of", "phil", "%s is with Phil.", "relationship_state", 0.70, 200),
    (r"\b(?:already\s+)?bought\s+it\s+for\s+you\b", "Charlie", "bought_gift_for", "I", "Charlie bought a truck for %s.", "relationship_state", 0.75, 200),
    (r"\b(?:already\s+)?bought\s+it\s+for\s+you\b", "Charlie", "cares_for", "I", "Charlie wants %s to be happy in Forks.", "relationship_state", 0.68, 200),
    (r"\b(?:He|Charlie)\s+is\s+Police Chief Swan\b", "Charlie", "is", "Police Chief Swan", "%s is Police Chief Swan in Forks.", "character_trait", 0.85, 200),
    (r"\bawkward\b.{0,40}\bCharlie\b|\bCharlie\b.{0,40}\bawkward\b", "I", "awkward_with", "Charlie", "%s and Charlie have an awkward relationship.", "relationship_state", 0.65, 120),
    (r"\b(?:pleased|genuinely pleased)\b.{0,50}\b(?:coming to live with him|I was coming)\b", "Charlie", "cares_for", "I", "Charlie is pleased %s is coming to live with him.", "relationship_state", 0.70, 120),
    (r"\bexiled myself\b.{0,30}\bForks\b|\bto\s+Forks\s+that\s+I\s+now\s+exiled\b", "I", "moving_to", "Forks", "%s is moving to Forks.", "timeline_fact", 0.80, 200),
)
# Facts told once a text: (patterns that all occur, subject, predicate, object, sentence, type, confidence, evidence).
ONCE = (
    ((r"(?U)\bCharlie\b", "(?i)Billy Black"), "Charlie", "knows", "billy", "Charlie knows Billy Black.", "relationship_state", 0.72, "Billy Black"),
    ((r"(?iU)\bin\s+a\s+wheelchair\b",), "billy", "is", "in a wheelchair", "%s is in a wheelchair.", "character_state", 0.80, "in a wheelchair"),
    ((r"(?iU)\bcannot\s+drive\s+anymore\b",), "billy", "cannot", "drive", "%s cannot drive anymore.", "character_state", 0.78, "cannot drive anymore"),
)
DENIED = r"(?iU)\b(?:was|were|is|are|am)\s+(?:not|never)\b|\b(?:wasn't|weren't|isn't|aren't|ain't)\b"
#: Each match of a pattern above holds one of these, in lower case; parents are told by "my".
_HELD = {"Renée": ("ren",), "(?iU)Renée|Renee": ("ren",), r"(?U)\bCharlie\b": ("charlie",), r"(?U)\bPhil\b": ("phil",), "(?i)Billy Black": ("billy",)} | {
    pattern: words
    for (pattern, *_), words in zip(FACTS, (("had",), ("bought",), ("bought",), ("swan",), ("awkward",), ("pleased",), ("exiled",)), strict=True)
} | {r"(?iU)\bin\s+a\s+wheelchair\b": ("wheelchair",), r"(?iU)\bcannot\s+drive\s+anymore\b": ("drive",)}
_DEFAULT = {"mom": "Renée", "phil": "Phil", "billy": "Billy Black"}


def _role(text: Column, role: str) -> Column:
    found = F.lit(None).cast("string")
    for pattern, name in reversed(CAST[role]):
        found = F.when(_told(text, pattern), name).otherwise(found)
    return found


def _told(text: Column, pattern: str) -> Column:
    return T.may_hold(F.lower(text), _HELD[pattern]) & text.rlike(pattern)


_PAIR = "array<struct<subject: string, predicate: string, target: string, polarity: boolean, confidence: double, evidence: string, claim: string, claim_type: string>>"


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pov_col: str | None = None) -> DataFrame:
    """Facts by the rules above, in one pass over the texts; ord counts from 0 in each text, rule by rule.

    Null and empty texts have none. Without a point of view the rules of the narrator find nothing. A parent is denied where its
    sentence denies an identity.
    """
    pov = narrator(F.lit("I"), F.col(pov_col).cast("string") if pov_col else F.lit(None))
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.lower(text).alias("low"), pov.alias("pov"), *[_role(text, r).alias(r) for r in CAST])
    c, me = F.col, F.col("pov")
    end = lambda name: me if name == "I" else F.coalesce(c(name), F.lit(_DEFAULT[name])) if name in _DEFAULT else F.lit(name)

    def row(s: Column, predicate: str, t: Column, claim: Column, kind: str, sure: float, evidence: Column, polarity: Column) -> Column:
        return F.struct(s.alias("subject"), F.lit(predicate).alias("predicate"), t.alias("target"), polarity.alias("polarity"), F.lit(sure).alias("confidence"), evidence.alias("evidence"), claim.alias("claim"), F.lit(kind).alias("claim_type"))

    def parents(pattern: str, role: str, unnamed: str, predicate: str, noun: str) -> Column:
        def pair(m: Column, denied: Column) -> Column:
            named = F.when(F.trim(m["name"]) != "", F.trim(m["name"])).otherwise(F.coalesce(c(role), F.lit(unnamed)))
            told = lambda a, b, what: F.concat(a, F.when(denied, " is not the ").otherwise(" is the "), F.lit(f"{what} of "), b, F.lit("."))
            proof = F.substring(m["all"], 1, 200)
            return F.array(
                row(me, "daughter_of", named, told(me, named, "daughter"), "relationship_state", 0.78, proof, ~denied),
                row(named, predicate, me, told(named, me, noun), "relationship_state", 0.78, proof, ~denied),
            )

        def of_sentence(s: Column) -> Column:
            part = lambda g: F.regexp_extract_all(s, F.lit(f"(?iU){pattern}"), F.lit(g))
            return F.flatten(F.transform(F.arrays_zip(part(0).alias("all"), part(1).alias("name")), lambda m: T.let(s.rlike(DENIED), lambda denied: pair(m, denied))))

        # A sentence's match stands in the text too, between its end marks: most texts have none.
        some = T.may_hold(c("low"), ("my",)) & c("t").rlike(f"(?iU){pattern}")
        return F.when(some, F.flatten(F.transform(F.split("t", r"[.!?]+"), of_sentence))).otherwise(F.array().cast(_PAIR))

    def every(pattern: str, s: str, predicate: str, t: str, claim: str, kind: str, sure: float, longest: int) -> Column:
        shown = me if "I" in (s, t) else end(s)
        hit = lambda m: row(end(s), predicate, end(t), F.format_string(claim, shown), kind, sure, F.substring(m, 1, longest), F.lit(True))
        return F.when(T.may_hold(c("low"), _HELD[pattern]), F.transform(F.regexp_extract_all("t", F.lit(f"(?isU){pattern}"), F.lit(0)), hit)).otherwise(F.array().cast(_PAIR))

    def once(patterns: tuple[str, ...], s: str, predicate: str, t: str, claim: str, kind: str, sure: float, evidence: str) -> Column:
        holds = F.lit(True)
        for p in patterns:
            holds &= T.may_hold(c("low"), _HELD[p]) & c("t").rlike(p)
        found = F.array(row(end(s), predicate, end(t), F.format_string(claim, end(s)) if "%s" in claim else F.lit(claim), kind, sure, F.lit(evidence), F.lit(True)))
        return F.filter(found, lambda _: holds)

    rules = [*[parents(*p) for p in PARENTS], *[every(*f) for f in FACTS], *[once(*o) for o in ONCE]]
    told = F.filter(F.concat(*rules), lambda f: f["subject"].isNotNull() & f["target"].isNotNull())
    x = d.select("doc_id", F.posexplode(told).alias("ord", "f"))
    return x.select("doc_id", c("ord").cast("long").alias("ord"), "f.*", F.lit("active").alias("canon_level"), F.lit("family").alias("generation_origin"))
