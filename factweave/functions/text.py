"""Column functions: normal forms, keys, predicates, places."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

_SPACE = r"(?U)\s+"
#: What ASCII texts hold where _SPACE would change them.
_ODD_SPACE = ("  ", "\t", "\n", "\v", "\f", "\r")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def contains_any(x: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(w) for w in words])


def found(x: Column, pattern: str, words: Iterable[str]) -> Column:
    """x.rlike(pattern), where each match holds one of words: most texts hold none, and are told so at a fraction of a search's cost."""
    return contains_any(x, words) & x.rlike(pattern)


def may_hold(low: Column, words: Iterable[str]) -> Column:
    """Whether a text in lower case may match, whatever the case, a pattern each match of which holds one of words: those two letters are also an s and an i to it."""
    return contains_any(low, (*words, "ſ", "ı"))


def norm(x: Column) -> Column:
    """Trimmed, lower case, white space collapsed; null becomes empty."""
    low = F.lower(F.coalesce(x, F.lit("")))
    # White space other than single blanks is rare; only texts that may have some are searched for it.
    plain = (F.octet_length(low) == F.length(low)) & ~contains_any(low, _ODD_SPACE)
    return F.trim(F.when(plain, low).otherwise(F.regexp_replace(low, _SPACE, " ")))


def norm_evidence(x: Column) -> Column:
    return F.btrim(norm(x), F.lit("\"'“”‘’"))


def predicate_key(x: Column) -> Column:
    return F.translate(norm(x), "_", " ")


def looked_up(x: Column, table: dict[str, str], default: Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, x), x if default is None else default)


def predicate_merge_key(x: Column) -> Column:
    return looked_up(F.translate(norm(x), " ", "_"), V.PREDICATE_ALIASES)


def infer_predicate(claim_type: Column, sentence: Column) -> Column:
    """The first known verb in the sentence, else the claim type's default."""
    low = F.lower(F.coalesce(sentence, F.lit("")))
    kind = F.coalesce(claim_type, F.lit(""))
    found = reduce(lambda c, verb: c.when(low.contains(verb), "cannot_be_killed" if verb == "cannot be killed" else verb), V.INFERRED, F.when(F.lit(False), ""))
    return found.otherwise(looked_up(kind, V.TYPE_PREDICATE, F.translate(kind, "_", " ")))


def continuity_predicate(predicate: Column, claim_type: Column, claim_text: Column, evidence: Column) -> Column:
    """The predicate that continuity compares: inferred for type slugs, mild discomfort told from distrust."""
    text = norm(F.concat(F.coalesce(evidence, F.lit("")), F.lit(" "), F.coalesce(claim_text, F.lit(""))))
    mild = let(text, lambda t: t.contains("uncomfortable") & ~contains_any(t, V.EXPLICIT_DISTRUST))
    own = let(norm(predicate), lambda p: F.when(p.isin(*V.CLAIM_TYPES), norm(infer_predicate(claim_type, claim_text))).otherwise(p))
    return let(own, lambda p: F.when(p.isin("distrusts", "distrust") & mild, "is uncomfortable with").otherwise(p))


def stance(continuity: Column, polarity: Column) -> Column:
    return F.when(polarity == F.lit(False), looked_up(F.translate(continuity, "_", " "), V.NEGATED, continuity)).otherwise(continuity)


def is_location(predicate: Column) -> Column:
    key = predicate_key(predicate)
    return key.isin(*V.LOCATION_KEYS) | key.endswith(" in") | key.endswith(" at")


def place_granularity(surface: Column, evidence: Column, stored: Column, known: tuple[str, ...] = V.KNOWN_PLACES) -> Column:
    both = F.lower(F.trim(F.concat(F.coalesce(surface, F.lit("")), F.lit(" "), F.coalesce(evidence, F.lit("")))))

    def by_text(t: Column) -> Column:
        institution, residence = found(t, V.INSTITUTION, V.INSTITUTION_WORDS), found(t, V.RESIDENCE, V.RESIDENCE_WORDS)
        own = found(t, V.OWN_RESIDENCE, ("'s", "’s"))
        return F.when(institution, "institution").when(own | residence, F.when(t.rlike(V.ROOM), "room").otherwise("residence"))

    def by_name(key: Column) -> Column:
        words = F.split(key, " ")
        short = (F.size(words) <= 2) & (key != "") & ~found(key, V.RESIDENCE, V.RESIDENCE_WORDS)
        return (
            F.when(key.isin(*known), "city")
            .when(let(both, lambda t: found(t, V.REGION, V.REGION_WORDS)), "region")
            .when(short & F.arrays_overlap(words, F.array(*[F.lit(x) for x in known])), "city")
            .when(short & (F.size(words) == 1) & (F.length(key) >= 3), "city")
            .otherwise("unknown")
        )

    given = F.when(stored.isin("city", "region", "residence", "room", "institution"), stored)
    return F.coalesce(given, let(both, by_text), let(norm(surface), by_name))


def places_compatible(old_g: Column, new_g: Column, mentioned: Column) -> Column:
    """Whether two places can hold at once: one within the other, or told together."""
    rank = lambda g: F.try_element_at(F.create_map(*[F.lit(v) for kv in V.GRANULARITY_RANK.items() for v in kv]), g)
    nested = (rank(old_g) > 0) & (rank(new_g) > 0) & (rank(old_g) != rank(new_g))
    both = (old_g == "institution") & new_g.isin("institution", "residence") | (old_g == "residence") & (new_g == "institution")
    return ~((old_g == "unknown") & (new_g == "unknown")) & (nested | mentioned | both)


def status_for_confidence(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, "approved").when(confidence >= 0.65, "needs_review").otherwise("suggested")


def entity_hash(subject_id: Column, predicate: Column, object_id: Column, claim_type: Column, polarity: Column) -> Column:
    target = F.when(object_id.isNull() | (object_id == 0), "").otherwise(object_id.cast("string"))
    key = F.concat_ws("|", subject_id.cast("string"), norm(predicate), target, norm(claim_type), F.when(polarity == F.lit(False), "neg"))
    return F.substring(F.sha2(key, 256), 1, 32)


def string_hash(subject: Column, claim_type: Column, target: Column, polarity: Column) -> Column:
    key = F.concat_ws("|", norm(subject), norm(claim_type), norm(target), F.when(polarity == F.lit(False), "neg"))
    return F.substring(F.sha2(key, 256), 1, 32)


def predicate_group(predicate: Column) -> Column:
    return looked_up(predicate, {p: g for g, ps in V.GROUPS.items() for p in ps}, F.lit("social"))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def excerpt(text: Column, limit: int) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))
