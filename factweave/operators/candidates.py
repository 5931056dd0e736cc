"""Candidates from prose without a tagger: phrases, relations and the drafts of claims they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from . import kin
from .chapters import matches, sentence_array
from .entities import classify

_any = lambda words: "|".join(sorted(words, key=len, reverse=True))
_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"
_NOT = r"(?iU)\b(?:not|never)\b"

#: Patterns of phrases; the group is the head.
PHRASES = {
    "family_phrase": rf"(?iU)\bmy\s+({_any(V.KIN_TERMS)})\b",
    "possessive_phrase": r"(?iU)\b(?:my|his|her|their|our|your)\s+(\w+(?:\s+\w+)?)\b",
    "state_phrase": rf"(?iU)\b(?:was|were|is|are|am)\s+(?:not|never)?\s*({_any(V.FEELINGS)})(?:\s+(?:with|of|about)\s+[A-Za-z][\w'-]+(?:\s+[A-Za-z][\w'-]+)?)?",
    "verb_phrase": r"(?iU)\b(?:did|do|does|had|have|has|was|were|is|are|am|will|would|could|should|can)?\s*(?:not|never|no\s+longer)?\s*(?:really|still|even|just)?\s*"
    rf"({'|'.join(V.FELT_VERBS)}|know|knew)\s+\w+(?:\s+\w+)?",
    "place_phrase": rf"(?U)\b(?:in|at|from|to|near|around)\s+({_NAME})\b",
}
#: Patterns of relations: (pattern, group of the subject, of the predicate, of the object or 0 for the narrator, origin, confidence), in order.
RELATIONS = (
    (rf"(?iU)\b({_NAME})\s+was\s+(?:not|never)\s+my\s+({_any(V.KIN_TERMS)})\b", 1, 2, 0, "family_rule", 0.78),
    (rf"(?iU)\b({_NAME})\s+was\s+my\s+({_any(V.KIN_TERMS)})\b", 1, 2, 0, "family_rule", 0.78),
    (rf"(?iU)\b(?:I|({_NAME}))\s+(?:did|do|does|had|have|has|was|were|is|are|am)?\s*(?:not|never)?\s*({'|'.join(V.FELT_VERBS)})\s+(\w+(?:\s+\w+)?)", 1, 2, 3, "pattern", 0.88),
    (rf"(?iU)\b(?:I|({_NAME}))\s+was\s+(?:not|never)?\s*({'|'.join(V.FELT_FOR)})\s+(?:with|of|about)\s+([A-Za-z][\w'-]+(?:\s+[A-Za-z][\w'-]+)?)", 1, 2, 3, "state_rule", 0.70),
)


#: Each match of a relation holds one of these.
_HELD = (("my",), ("my",), ("trust", "love", "hate", "fear", "miss"), V.FELT_FOR)
#: A match of a relation, before ends and predicate are told.
_RELATION = "array<struct<rule: int, at: int, start: bigint, end: bigint, subject: string, verb: string, object: string, polarity: boolean, evidence: string, origin: string, confidence: double>>"


def _sentences(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """A row per sentence that isn't blank: its number, start, text as it stands (raw) and without white space around it (said)."""
    told = F.filter(sentence_array(F.coalesce(F.col(text_col), F.lit(""))), lambda s: s["sentence"].rlike(r"(?U)\S"))
    x = docs.select(F.col(id_col).alias("doc_id"), *more, F.posexplode(told).alias("sentence_index", "s"))
    rest = [c for c in x.columns if c != "s"]
    return x.select(*rest, F.col("s.start").alias("from"), F.col("s.sentence").alias("raw"), F.regexp_replace("s.sentence", r"(?U)^\s+|\s+$", "").alias("said"))


def _found(pattern: str, **groups: int) -> Column:
    """Matches in said as structs of at, all and the named groups."""
    found = matches(F.col("said"), pattern, *dict.fromkeys(groups.values()))
    return F.transform(found, lambda m: F.struct(m["start"].alias("at"), m["all"].alias("all"), *[m[f"g{g}"].alias(n) for n, g in groups.items()]))


def phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per phrase: (doc_id, sentence_index, start, end, phrase_type, phrase, head, modifier, negated).

    Offsets count a sentence's characters from its first that isn't white space, on the sentence's own start; phrases of states and
    verbs are the text at those offsets. A possessive over a term of kin is the family's alone. Null and empty texts have none.
    """
    first_word = lambda x: F.lower(F.substring_index(F.regexp_replace(x, r"(?U)\s+", " "), " ", 1))
    denied = F.col("said").rlike(kin.DENIED)

    def rows(kind: str) -> Column:
        def row(m: Column) -> Column:
            at_place = F.regexp_replace(F.substring(F.col("raw"), m["at"] + 1, F.length(m["all"])), r"(?U)^\s+|\s+$", "")
            shifted = kind in ("state_phrase", "verb_phrase")
            head = {"family_phrase": T.norm(m["head"]), "state_phrase": F.lower(m["head"]), "verb_phrase": F.lower(m["head"])}.get(kind, m["head"])
            modifier = {"family_phrase": F.lit("my"), "possessive_phrase": first_word(m["all"]), "place_phrase": first_word(m["all"])}.get(kind, F.lit(""))
            negated = at_place.rlike(_NOT) if shifted else F.lit(False) if kind == "place_phrase" else denied
            start = (F.col("from") + m["at"]).cast("long")
            return F.struct(start.alias("start"), (start + F.length(m["all"])).alias("end"), F.lit(kind).alias("phrase_type"), (at_place if shifted else m["all"]).alias("phrase"), head.alias("head"), modifier.alias("modifier"), negated.alias("negated"))

        found = _found(PHRASES[kind], head=1)
        if kind == "possessive_phrase":
            found = F.filter(found, lambda m: ~T.norm(m["head"]).isin(*V.KIN_TERMS))
        return F.transform(found, row)

    x = _sentences(docs, id_col, text_col)
    x = x.select("doc_id", F.col("sentence_index").cast("long").alias("sentence_index"), F.explode(F.concat(*[rows(k) for k in PHRASES])).alias("p"))
    return x.select("doc_id", "sentence_index", "p.*")


def without_fillers(raw: Column) -> Column:
    """A mention, white space collapsed, without fillers behind it, and before it while two words stay; null becomes empty."""
    fill = "|".join(V.OBJECT_FILLERS)
    x = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " "))
    return F.regexp_replace(F.regexp_replace(x, rf"(?i)(?: (?:{fill}))+$", ""), rf"(?i)^(?:(?:{fill}) )+(?=\S+ \S)", "")


def resolved(raw: Column, pov: Column, cast: dict[str, Column]) -> Column:
    """Who a mention is: fillers around it go, the narrator is the point of view, names of roles are those the text tells, others
    stay. Null where nobody is found: nothing left, the narrator without a point of view, another's pronoun (no tagger names an
    antecedent)."""

    def named(x: Column, head: Column) -> Column:
        who = F.when(x == "", None).when(head.isin(*V.NARRATING), F.when(pov != "", pov)).when(head.isin(*V.THIRD_PERSON), None)
        for role, name in cast.items():
            who = who.when((F.rtrim(head, F.lit(".,;:!?")) == role) & name.isNotNull(), name)
        return who.otherwise(x)

    return T.let(without_fillers(raw), lambda x: T.let(F.lower(F.substring_index(x, " ", 1)), lambda head: named(x, head)))


def reject_reason(subject: Column, predicate: Column, target: Column, subject_method: Column, object_method: Column) -> Column:
    """Why a relation is left out, null where it stays; the methods are those of coreference.resolved."""
    s, o = T.norm(subject), T.norm(target)
    kin = ("father_of", "mother_of", "parent_of")
    return (
        F.when(s == "", "missing subject")
        .when(s.rlike(rf"^(?:{'|'.join(V.AUXILIARY_STARTS)})\b"), "auxiliary/fragment subject")
        .when(subject_method == "unresolved", "unresolved pronoun subject")
        .when(object_method == "unresolved", "unresolved pronoun object")
        .when((o == "") & ~F.coalesce(predicate.isin(*kin), F.lit(False)), "missing object")
        .when(F.substring_index(o, " ", 1).isin("him", "her", "them", "me", "you", "it"), "unresolved pronoun object")
        .when(o.rlike(r" (?:all|either|anymore)$"), "junk object fragment")
        .when((s == o) & predicate.endswith("_of"), "self-referential family relation")
    )


def relations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pov_col: str | None = None) -> DataFrame:
    """A row per distinct relation of a text: (doc_id, sentence_index, start, end, subject, predicate, object, polarity, confidence,
    evidence, origin), the first of those equal but for case.

    Kin of the narrator needs a point of view. Relations with an end that isn't resolved, an auxiliary as subject, or a kin of their own
    are left out. Sentences are searched alone; only found relations are shuffled. Null and empty texts have none.
    """
    pov = F.trim(F.coalesce(F.col(pov_col).cast("string"), F.lit(""))) if pov_col else F.lit("")
    text = F.coalesce(F.col(text_col), F.lit(""))
    roles = [kin._role(text, r).alias(f"is_{r}") for r in kin.CAST]
    x = _sentences(docs, id_col, text_col, pov.alias("pov"), *roles).withColumn("low", F.lower("said"))
    cast = {r: F.col(f"is_{r}") for r in kin.CAST}

    def rows(n: int) -> Column:
        pattern, who, verb, what, origin, sure = RELATIONS[n]
        groups = {"who": who, "verb": verb} | ({"what": what} if what else {})

        def row(m: Column) -> Column:
            start = (F.col("from") + m["at"]).cast("long")
            polarity = F.lit(n != 0) if not what else ~m["all"].rlike(_NOT)
            subject = resolved(F.when(m["who"] == "", "I").otherwise(m["who"]), F.col("pov"), cast)
            target = resolved(m["what"], F.col("pov"), cast) if what else F.when(F.col("pov") != "", F.col("pov"))
            return F.struct(F.lit(n).alias("rule"), m["at"].alias("at"), start.alias("start"), (start + F.length(m["all"])).alias("end"), subject.alias("subject"), F.lower(m["verb"]).alias("verb"), target.alias("object"), polarity.alias("polarity"), F.substring(m["all"], 1, 500).alias("evidence"), F.lit(origin).alias("origin"), F.lit(sure).alias("confidence"))

        found = F.transform(_found(pattern, **groups), row)
        # Only sentences that hold a word of the rule are searched, and only those that match are cut apart.
        found = F.when(F.col("said").rlike(pattern), found).otherwise(F.array().cast(_RELATION))
        return F.when(T.may_hold(F.col("low"), _HELD[n]), found).otherwise(F.array().cast(_RELATION))

    c = F.col
    # Ends are resolved before rows are exploded, so that no later step works them out again.
    x = x.select("doc_id", "sentence_index", F.explode(F.concat(*[rows(n) for n in range(len(RELATIONS))])).alias("m"))
    kinship = c("m.origin") == "family_rule"
    of = F.concat(T.looked_up(c("m.verb"), V.KIN_SAME, F.translate(c("m.verb"), "-", "_")), F.lit("_of"))
    predicate = F.when(kinship, of).when(c("m.origin") == "pattern", T.looked_up(c("m.verb"), V.EMOTIONS)).otherwise(c("m.verb"))
    # Exploding one row makes its fields be worked out once, not at each use.
    ends = F.struct(predicate.alias("predicate"), T.norm(c("m.subject")).alias("_s"), T.norm(c("m.object")).alias("_o"))
    x = x.select("doc_id", c("sentence_index").cast("long").alias("sentence_index"), "m", F.explode(F.array(ends)).alias("e")).select("doc_id", "sentence_index", "m.*", "e.*")
    s, o = c("_s"), c("_o")
    junk = s.rlike(rf"^(?:{'|'.join(V.AUXILIARY_STARTS)})\b") | F.substring_index(o, " ", 1).isin("him", "her", "them", "me", "you", "it") | o.rlike(r" (?:all|either|anymore)$") | ((s == o) & c("predicate").endswith("_of"))
    x = x.where(c("subject").isNotNull() & c("object").isNotNull() & (s != "") & (o != "") & ~junk)
    order = F.struct("sentence_index", "rule", "at", "start", "end", "subject", "predicate", "object", "confidence", "evidence", "origin")
    first = x.drop("_s", "_o").groupBy("doc_id", F.lower("subject").alias("_s"), F.lower("predicate").alias("_p"), F.lower("object").alias("_o"), "polarity").agg(F.min(order).alias("r"))
    return first.select("doc_id", "r.sentence_index", "r.start", "r.end", "r.subject", "r.predicate", "r.object", "polarity", "r.confidence", "r.evidence", "r.origin")


def drafts(found: DataFrame) -> DataFrame:
    """Relations as drafts of claims: type by the kinds of both ends, a sentence, and the status their confidence gives."""
    c = F.col
    kind = lambda x: classify(x, F.concat_ws(" ", "evidence", x), F.lit("subject"))["entity_type"]
    # Exploding one row makes both kinds be worked out once, not at each use.
    kinds = F.explode(F.array(F.struct(F.translate("predicate", " ", "_").alias("p"), kind(c("subject")).alias("s"), kind(c("object")).alias("o")))).alias("k")
    x = found.select("*", kinds).select(found["*"], c("k.p").alias("_p"), c("k.s").alias("_s"), c("k.o").alias("_o"))
    p, beings = c("_p"), ("character", "animal", "group")
    of, felt = p.endswith("_of"), p.isin(*V.FEELINGS)
    claim_type = (
        F.when(of, "relationship_state")
        .when(c("evidence").rlike(V.TIME_MARKS), "timeline_fact")
        .when(felt, F.when(c("_o") == "place", "place_preference").otherwise("character_state"))
        .when(~c("_s").isin(*beings), "character_state")
        .when(c("_o").isin(*beings), "relationship_state")
        .when(c("_o") == "place", "place_preference")
        .otherwise("character_preference")
    )
    yes = c("polarity")
    kin_told = F.concat(F.when(yes, " is the ").otherwise(" is not the "), F.translate(F.regexp_replace(p, "_of$", ""), "_", "-"), F.lit(" of "))
    felt_told = F.concat(F.when(yes, " is ").otherwise(" is not "), p, F.lit(" with "))
    verb_told = F.concat(F.when(yes, F.concat(F.lit(" "), p)).otherwise(F.concat(F.lit(" does not "), F.regexp_replace(p, "(?<!s)s$", ""))), F.lit(" "))
    claim = F.concat("subject", F.when(of, kin_told).when(felt, felt_told).otherwise(verb_told), "object", F.lit("."))
    return x.select("doc_id", "start", "end", "subject", p.alias("predicate"), c("object").alias("target"), claim_type.alias("claim_type"), claim.alias("claim"), "polarity", "confidence", "evidence", T.status_for_confidence(c("confidence")).alias("status"), F.lit("fastus").alias("generation_origin"), F.lit("active").alias("canon_level"))


def first_drafts(found: DataFrame) -> DataFrame:
    """Of a text's drafts with equal subject, type, predicate, object (whatever their case) and polarity, the first; `place` counts what is left, by start."""
    key = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("subject", "claim_type", "predicate", "target")]
    order = ("start", "end", "subject", "predicate", "target")
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", *key, "polarity").orderBy(*order))).where("_r = 1").drop("_r")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).cast("long") - 1)
