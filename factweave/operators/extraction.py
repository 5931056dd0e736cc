"""Facts from prose by rules, and their filters and mergers before they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .chapters import matches

_any = "|".join
_OPEN = r'(?<!["\w])'
_NEG = rf"(?:(?:{_any(V.AUXILIARIES)})\s+)?(?:not|never|no\s+longer)\s+"
_OBJECT = rf"(?!you\b)(?:the\s+|a\s+|an\s+)?[\w'-]+(?:\s+(?!(?:{_any(V.CLAUSE_BREAKS)})\b)[\w'-]+){{0,7}}"
_STANCE = rf"\s+({_NEG})?({_any(V.EMOTIONS)})\s+({_OBJECT})"

#: name: (pattern, group of the subject or 0 for the narrator, of the negation, of the verb or the verb itself, of the object, confidence)
RULES = {
    "narrator_stance": (rf"{_OPEN}I{_STANCE}", 0, 1, 2, 3, 0.64),
    "narrator_parent": (rf"{_OPEN}I\s+love\s+you,?\s*(Mom|Mother|Mum)\b", 0, 0, "love", 1, 0.72),
    "distaste": (r"(?:(?:I|my)\s+)?distaste\s+for\s+(?:the\s+)?([A-Za-z][\w\s'-]{0,40}?)(?=[\s.,;!?]|$)", 0, 0, "detest", 1, 0.70),
    "named_stance": (rf"{_OPEN}([A-Z][\w'-]+(?:\s+[A-Z][\w'-]+)?){_STANCE}", 1, 2, 3, 4, 0.58),
    "half_brother": (rf"{_OPEN}(\w+(?:\s+\w+)?)\s+is\s+the\s+half-brother\s+of\s+(\w+(?:\s+\w+)?)", 1, 0, "half-brother", 2, 0.72),
}

#: Each match of a rule holds one of these.
_FELT = ("love", "detest", "hate", "miss", "trust", "fear", "care", "worr")
_HELD = {"narrator_stance": _FELT, "narrator_parent": ("love",), "distaste": ("distaste",), "named_stance": _FELT, "half_brother": ("half-brother",)}


def clean_phrase(x: Column) -> Column:
    """White space collapsed; end marks and function words at the end cut, though never the only word."""
    x = F.regexp_replace(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), r"[.,;:!?]+$", "")
    return F.regexp_replace(F.trim(x), rf"(?i)(?: (?:{_any(V.TAIL_WORDS)}))+$", "")


def narrator(raw: Column, pov: Column) -> Column:
    """A subject as a name: the narrator is the point of view, leading fillers go; null where no name is left."""
    pov = F.trim(F.coalesce(pov, F.lit("")))

    def told(words: Column) -> Column:
        bare = F.regexp_replace(F.array_join(words, " "), rf"(?i)^(?:(?:{_any(V.LEADING_FILLERS)})(?: |$))+", "")
        named = T.let(bare, lambda b: F.when(F.lower(b).isin(*V.FIRST_PERSON), F.when(pov != "", pov)).when(F.length(b) >= 2, b))
        return F.when((pov != "") & (F.size(words) <= 2) & (F.lower(F.element_at(words, -1)) == "i"), pov).otherwise(named)

    return T.let(F.split(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " ")), " "), told)


_HIT = "array<struct<rule: string, all: string, who: string, neg: string, verb: string, what: string, confidence: double>>"


def stances(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pov_col: str | None = None) -> DataFrame:
    """Claims of stance and feeling by RULES, in one pass over the texts; ord is their order in a text.

    Null and empty texts have none. Without a point of view, first-person rules find nothing. The named rule ignores case in names
    too, as callers expect, so that fragments come out which reject_reason() then drops.
    """
    pov = F.col(pov_col).cast("string") if pov_col else F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), pov.alias("pov"), text.alias("t"), F.lower(text).alias("low"))

    def hits(name: str) -> Column:
        pattern, who, neg, verb, what, confidence = RULES[name]
        groups = {p: g for p, g in (("who", who), ("neg", neg), ("verb", verb), ("what", what)) if g and not isinstance(g, str)}

        def hit(m: Column) -> Column:
            part = lambda p: m["all" if p == "all" else f"g{groups[p]}"]
            return F.struct(F.lit(name).alias("rule"), part("all").alias("all"), (part("who") if who else F.lit("I")).alias("who"), (part("neg") if neg else F.lit("")).alias("neg"), (F.lit(verb) if isinstance(verb, str) else part("verb")).alias("verb"), part("what").alias("what"), F.lit(confidence).alias("confidence"))

        # Only texts that hold a word of the rule are searched, and only those that match are cut apart.
        found = F.transform(matches(F.col("t"), f"(?iU){pattern}", *groups.values()), hit)
        found = F.when(F.col("t").rlike(f"(?iU){pattern}"), found).otherwise(F.array().cast(_HIT))
        return F.when(T.may_hold(F.col("low"), _HELD[name]), found).otherwise(F.array().cast(_HIT))

    x = d.select("doc_id", "pov", F.posexplode(F.concat(*[hits(n) for n in RULES])).alias("ord", "m"))
    kin, c = F.col("m.rule") == "half_brother", F.col
    raw = F.trim("m.who")
    who = F.when(kin, raw).otherwise(clean_phrase(F.when(c("m.rule").isin("named_stance"), raw).otherwise(narrator(c("m.who"), c("pov")))))
    what = F.when(kin, F.trim("m.what")).otherwise(clean_phrase(c("m.what")))
    verb = F.trim(F.lower("m.verb"))
    predicate = F.when(kin, "is_half_brother_of").otherwise(T.looked_up(verb, V.EMOTIONS))
    row = F.struct(who.alias("subject"), predicate.alias("predicate"), what.alias("target"), (c("m.neg") == "").alias("polarity"), c("m.confidence").alias("confidence"), F.substring("m.all", 1, 200).alias("evidence"), c("m.rule").alias("rule"))
    # Exploding one row makes its fields be worked out once, not at each use.
    x = x.select("doc_id", F.col("ord").cast("long").alias("ord"), F.explode(F.array(row)).alias("r")).select("doc_id", "ord", "r.*")
    low = F.lower("subject")
    junk = low.isin(*V.NOT_NAMES) | F.lower("target").isin(*V.NOT_NAMES) | low.contains(" way") | low.startswith("way ") | ((c("rule") == "named_stance") & (low.isin("way", "in a", "a way") | low.startswith("in ")))
    x = x.where((c("subject") != "") & (c("target") != "") & (c("rule").isin("half_brother") | ~junk))
    told = F.when(c("rule") == "half_brother", F.concat("subject", F.lit(" is the half-brother of "), "target", F.lit("."))).otherwise(F.concat("subject", F.when(c("polarity"), " ").otherwise(" not "), F.translate("predicate", "_", " "), F.lit(" "), "target", F.lit(".")))
    return x.withColumns({"claim": told, "claim_type": F.lit("relationship_state"), "canon_level": F.lit("soft"), "generation_origin": F.lit("structural")})


#: name: (pattern, type, predicate, level, sentence before the subject's end, after the object's, confidence)
_TWO = r"(\w+(?:\s+\w+)?)"
PLAIN_RULES = {
    "not_fully": (rf"{_TWO}\s+(?:still\s+)?did not fully trust\s+{_TWO}", "relationship_state", "distrusts", "active", " does not fully trust ", ".", 0.88),
    "never_hurt": (rf"{_TWO}\s+(?:knew|believed)\s+(?:that\s+)?{_TWO}\s+would never hurt", "character_state", "believes", "active", " believes ", " will not hurt her.", 0.85),
    "trusts": (rf"{_TWO}\s+trusts\s+{_TWO}", "relationship_state", "trusts", "active", " trusts ", ".", 0.90),
    "distrusts": (rf"{_TWO}\s+(?:does not trust|distrusts)\s+{_TWO}", "relationship_state", "distrusts", "active", " distrusts ", ".", 0.88),
    "deathless": (rf"{_TWO}\s+cannot be killed()", "world_rule", "cannot_be_killed", "core", " cannot be killed", ".", 0.92),
}

_PLAIN_HIT = "array<struct<subject: string, predicate: string, target: string, claim_type: string, canon_level: string, confidence: double, claim: string, evidence: string>>"


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fallback rules where no model is at hand, in one pass; ord is their order in a text. Null and empty texts have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))

    def hits(name: str) -> Column:
        pattern, kind, predicate, level, middle, end, confidence = PLAIN_RULES[name]

        def hit(m: Column) -> Column:
            who, what = F.trim(m["g1"]), F.trim(m["g2"])
            told = F.concat(who, F.lit(middle), what, F.lit(end))
            return F.struct(who.alias("subject"), F.lit(predicate).alias("predicate"), what.alias("target"), F.lit(kind).alias("claim_type"), F.lit(level).alias("canon_level"), F.lit(confidence).alias("confidence"), told.alias("claim"), F.substring(F.trim(m["all"]), 1, 200).alias("evidence"))

        found = F.transform(matches(F.col("t"), f"(?iU){pattern}", 1, 2), hit)
        return F.when(F.col("t").rlike(f"(?iU){pattern}"), found).otherwise(F.array().cast(_PLAIN_HIT))

    x = d.select("doc_id", F.posexplode(F.concat(*[hits(n) for n in PLAIN_RULES])).alias("ord", "m"))
    return x.select("doc_id", F.col("ord").cast("long").alias("ord"), "m.*", F.lit(True).alias("polarity"), F.lit("heuristic").alias("generation_origin"))


def reject_reason(subject: Column, predicate: Column, target: Column, evidence: Column, pov: Column) -> Column:
    """Why a claim is a fragment: the first reason that holds, else null."""
    s, t, e = T.norm(subject), T.norm(target), T.norm(evidence)
    p = F.translate(T.norm(predicate), " ", "_")
    starts = lambda words: rf"^(?:{_any(words)})\b"
    kin = p.isin(*V.KINSHIP)
    return (
        F.when(s == "", "empty subject")
        .when((s == "narrator") | (t == "narrator"), "placeholder narrator entity")
        .when(s.isin("i", "me", "myself", "my", "mine") & (F.trim(F.coalesce(pov, F.lit(""))) == ""), "unresolved first-person without POV character")
        .when(s.rlike(starts(V.JUNK_STARTS)), "junk subject start")
        .when(s.rlike(starts(V.AUXILIARY_STARTS)), "auxiliary/fragment subject (Stage 0)")
        .when(s.contains(" way") | s.startswith("way "), "junk 'way' subject")
        .when(s.isin(*V.PRONOUNS, "my mom", "the vigorous") & ~kin, "unresolved pronoun subject")
        .when(F.substring_index(t, " ", 1).isin(*V.PRONOUNS) & ~kin, "unresolved pronoun object (Stage 0 — no coref yet)")
        .when(t.isin(*V.JUNK_OBJECTS), "junk object fragment")
        .when(t.rlike(rf"^(?:{_any(V.GERUNDS)})\s+(?:{_any(V.GERUND_ENDS)})\s*$"), "incomplete gerund object")
        .when(p.isin(*V.WEAK_SPEECH), "weak speech predicate")
        .when(e.contains("said to me") | e.contains("said to you"), "speech-evidence fragment")
    )


def judged(drafts: DataFrame, pov: Column | None = None) -> DataFrame:
    """The drafts with a column reject_reason; those where it is null go on, the others are the reject log."""
    c = F.col
    return drafts.withColumn("reject_reason", reject_reason(c("subject"), c("predicate"), c("target"), c("evidence"), F.lit(None) if pov is None else pov))


def for_pov(drafts: DataFrame, pov: Column) -> DataFrame:
    """Narrator subjects as the point of view, in the claim's sentence too; without a point of view nothing changes, without a name a draft goes."""
    c, has = F.col, F.trim(F.coalesce(pov, F.lit(""))) != ""
    who = narrator(c("subject"), pov)
    first = F.lower(F.trim("subject")).isin(*V.FIRST_PERSON) | c("subject").rlike(r"\bI\b")
    swapped = lambda at, n: F.concat(F.substring(c("claim"), F.lit(1), at - 1), who, F.substring(c("claim"), at + n, F.length("claim")))
    i_at, s_at = F.regexp_instr(c("claim"), F.lit(r"\bI\b")), F.instr(c("claim"), c("subject"))
    told = F.when(first, F.when(i_at > 0, swapped(i_at, F.lit(1))).otherwise(c("claim"))).when((s_at > 0) & (F.length("subject") > 0), swapped(s_at, F.length("subject"))).otherwise(c("claim"))
    x = drafts.where(~has | who.isNotNull())
    return x.withColumns({"claim": F.when(has, told).otherwise(c("claim")), "subject": F.when(has, who).otherwise(c("subject"))})


def first_of_equal(drafts: DataFrame) -> DataFrame:
    """Of a scene's drafts with equal subject, type, predicate, object and first 120 characters, the first."""
    key = [F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("subject", "claim_type", "predicate", "target")] + [F.substring(F.lower(F.trim("claim")), 1, 120)]
    w = Window.partitionBy("scene_id", *key).orderBy("ord")
    return drafts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _rank(origin: Column) -> Column:
    ranks = F.create_map(*[F.lit(v) for kv in V.ORIGIN_RANK.items() for v in kv])
    return F.coalesce(F.try_element_at(ranks, F.trim(F.substring_index(origin, "+", 1))), F.lit(0))


def merged_sources(drafts: DataFrame) -> DataFrame:
    """One row for each fact of a scene (subject, predicate, object, type, polarity), folded in the order of ord.

    Confidence is the greater one, or of two anchored ones the mean and 0.05; evidence of the anchored one, else of the better
    origin; the longest sentence; all origins, best first; canon_level and importance, where there are such columns, of the first. A fact
    told once keeps its review_status. A group holds one scene's repeats of one fact.
    """
    c = F.col
    key = {"_s": T.norm(c("subject")), "_p": F.translate(T.norm(c("predicate")), " ", "_"), "_t": T.norm(c("target")), "_k": T.norm(c("claim_type")), "_n": c("polarity")}
    own = F.filter(F.transform(F.split(F.coalesce("generation_origin", F.lit("")), r"\+"), lambda p: F.trim(p)), lambda p: p != "")
    fields = F.struct("ord", "subject", "predicate", "target", "claim_type", "polarity", c("confidence").cast("double").alias("confidence"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("claim", F.lit("")).alias("claim"), F.coalesce("anchored", F.lit(False)).alias("anchored"), F.array_distinct(own).alias("origins"), (c("review_status") if "review_status" in drafts.columns else F.lit(None)).cast("string").alias("review_status"), *[n for n in ("canon_level", "importance") if n in drafts.columns])

    def both(a: Column, b: Column) -> Column:
        every = F.array_distinct(F.concat(a["origins"], b["origins"]))
        of_rank = lambda r: F.filter(every, lambda o: _rank(o) == r)
        origins = F.concat(*[of_rank(r) for r in (4, 3, 2, 1, 0)])
        sure = F.when(a["anchored"] & b["anchored"], F.least(F.lit(1.0), (a["confidence"] + b["confidence"]) / 2 + 0.05)).otherwise(F.greatest(a["confidence"], b["confidence"]))
        anchored, first = a["anchored"] | b["anchored"], lambda x: F.coalesce(F.get(x["origins"], F.lit(0)), F.lit(""))
        a_leads = F.when(a["anchored"] != b["anchored"], a["anchored"]).otherwise(_rank(first(a)) >= _rank(first(b)))
        lead, other = F.when(a_leads, a["evidence"]).otherwise(b["evidence"]), F.when(a_leads, b["evidence"]).otherwise(a["evidence"])
        proof = F.when((lead == "") & (a["anchored"] == b["anchored"]), other).otherwise(lead)
        longest = F.when(F.length(a["claim"]) >= F.length(b["claim"]), a["claim"]).otherwise(b["claim"])
        return a.withField("confidence", sure).withField("evidence", proof).withField("claim", longest).withField("anchored", anchored).withField("origins", origins).withField("review_status", F.when(anchored & (sure >= 0.90), "suggested").otherwise("needs_review"))

    g = drafts.withColumns(key).groupBy("scene_id", *key).agg(F.sort_array(F.collect_list(fields)).alias("all"))
    folded = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.element_at("all", 1), both)
    x = g.select("scene_id", F.size("all").cast("long").alias("n_sources"), folded.alias("f")).select("scene_id", "n_sources", "f.*")
    return x.withColumn("generation_origin", F.substring(F.array_join("origins", "+"), 1, 64)).drop("origins")


def family(predicate: Column) -> Column:
    p = F.translate(T.norm(predicate), " ", "_")
    return T.looked_up(p, {v: name for name, verbs in V.FAMILIES.items() for v in verbs})


def _telling(drafts: DataFrame, side: str) -> DataFrame:
    c = F.col
    words = F.filter(F.regexp_extract_all(T.norm(c("target")), F.lit("[a-z']+"), F.lit(0)), lambda w: F.length(w) > 2)
    return drafts.select(F.struct("scene_id", "id", T.norm(c("subject")).alias("s"), T.norm(c("evidence")).alias("e"), family(c("predicate")).alias("f"), T.norm(c("target")).alias("t"), words.alias("w")).alias(side))


def redundant(drafts: DataFrame, known: DataFrame) -> DataFrame:
    """Ids of drafts that tell what one of `known` tells in the same scene: the same subject, and evidence within evidence, or the
    same family of predicates and objects that share a word or contain each other. An equi-join on scene and subject."""
    within = lambda a, b: (a != "") & (b != "") & (a.contains(b) | b.contains(a))
    a, b = (lambda x: F.col(f"a.{x}")), (lambda x: F.col(f"b.{x}"))
    same = within(a("e"), b("e")) | ((a("f") == b("f")) & (a("f") != "") & (F.arrays_overlap(a("w"), b("w")) | within(a("t"), b("t"))))
    pairs = _telling(drafts, "a").join(_telling(known, "b"), (a("scene_id") == b("scene_id")) & (a("s") == b("s")) & same, "left_semi")
    return pairs.select(a("id").alias("id"))


def without_redundant_structural(drafts: DataFrame) -> DataFrame:
    """Drops rule-found feelings that a model's drafts tell too."""
    rules = drafts.where((F.col("generation_origin") == "structural") & family(F.col("predicate")).isin(*V.FAMILIES))
    return drafts.join(redundant(rules, drafts.where("generation_origin = 'llm'")), "id", "left_anti")


_LETTER = r"[\p{L}\p{N}_]"


def names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 24) -> DataFrame:
    """The first `limit` distinct capitalised names of each text, in their order; the limit is the feature."""
    pattern = rf"(?<!{_LETTER})[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?(?!{_LETTER})"
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), F.lit(0)))
    kept = F.filter(found, lambda n: ~F.lower(n).isin(*V.NOT_NAMES) & ~F.lower(n).rlike(rf"^(?:{_any(V.JUNK_STARTS)})\b"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.slice(kept, 1, limit).alias("names"))
    return d.select("doc_id", F.posexplode("names").alias("place", "name")).select("doc_id", F.col("place").cast("long").alias("place"), "name")


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words (with an inner apostrophe) and marks of each text, counted, with negations among them."""
    pattern = rf"{_LETTER}+(?:'{_LETTER}+)?|[^\p{{L}}\p{{N}}_\s]"
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), F.lit(0))
    d = docs.select(F.col(id_col).alias("doc_id"), found.alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.filter("t", lambda w: F.lower(w).isin(*V.NEGATIONS))).cast("long").alias("n_negations"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))
