"""Where an editor shows an issue: quotes nearest to a place, and the claim that an issue speaks of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .chapters import places

#: What a match counts, what enough is.
EQUAL, PARTLY, NAMED, SHOWN, ENOUGH = 90, 45, 20, 10, 50


def nearest_quote(text: Column, quote: Column, preferred: Column) -> Column:
    """struct<start, length> of the occurrence of a quote nearest to a preferred place, of two equally near the first; whatever the case.

    Only where it stands nowhere as it is, white space may differ. Null where it isn't found, is empty or null. The nearest one before
    a place is looked for from the text's end backwards, so no list of occurrences is made.
    """
    low, want, at = F.lower(F.coalesce(text, F.lit(""))), F.lower(quote), F.greatest(F.coalesce(preferred, F.lit(0)), F.lit(0)).cast("int")
    span = lambda start, n: F.struct(start.cast("long").alias("start"), n.cast("long").alias("length"))

    def exact(x: Column) -> Column:
        n, m, p = F.length(x["low"]), F.length(x["want"]), x["at"]
        behind = F.position(x["want"], x["low"], F.least(p, n) + 1) - 1
        back = F.position(F.reverse(x["want"]), F.reverse(x["low"]), F.greatest(n - p - m + 2, F.lit(1)))
        before = F.when(back > 0, n - back + 1 - m)
        after = F.when(behind >= 0, behind)
        start = F.when(after.isNull() | (before.isNotNull() & (p - before <= after - p)), before).otherwise(after)
        return F.when(start.isNotNull(), span(start, m))

    words = F.split(T.norm(quote), " ")
    pattern = F.concat(F.lit("(?i)"), F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), r"\s+"))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    spans = F.zip_with(places(text, pattern), F.transform(found, F.length), lambda s, n: F.struct(F.abs(s - at).alias("far"), s.alias("start"), n.alias("length")))
    loose = F.when(T.norm(quote) != "", T.let(F.array_min(spans), lambda s: F.when(s.isNotNull(), span(s["start"], s["length"]))))
    hit = T.let(F.struct(low.alias("low"), want.alias("want"), at.alias("at")), exact)
    return F.when(F.coalesce(quote, F.lit("")) != "", F.coalesce(hit, loose))


def now_value(message: Column) -> Column:
    """What a message says holds now, in normal form; empty where it says nothing."""
    return T.norm(F.regexp_extract(F.coalesce(message, F.lit("")), r"\bnow '([^']+)'", 1))


def spoken_of(issues: DataFrame, claims: DataFrame) -> DataFrame:
    """(issue_id, claim_id): the claim of its scene that each issue speaks of; null where no score is ENOUGH.

    issues have issue_id, scene_id, current_claim_id and message; claims may have a target beside their object. An issue's own claim comes first, if its scene has it. Of the others,
    rejected and deprecated ones apart, the best score counts, of equal ones the lowest id. Claims of a scene that score alike
    whatever the message are one row, and so are issues with one message, before they meet.
    """
    c = F.col
    own = claims.select("scene_id", c("id").alias("current_claim_id"), c("id").alias("own"))
    x = issues.join(own, ["scene_id", "current_claim_id"], "left").withColumn("said", T.norm(c("message"))).withColumn("now", now_value(c("message")))
    target = "target" if "target" in claims.columns else None
    parts = {"p": c("predicate"), "o": c("object"), "s": c("subject"), "t": F.lit("") if target is None else c(target)}
    live = claims.where(~F.coalesce(c("status").isin("rejected", "deprecated"), F.lit(False)))
    shown = F.trim(F.coalesce("evidence_text", F.lit(""))) != ""
    rows = live.groupBy("scene_id", *[T.norm(part).alias(k) for k, part in parts.items()], shown.alias("shown")).agg(F.min("id").alias("id"))
    asked = x.where("own is null").select("scene_id", "said", "now").distinct()
    meets = lambda k: (c(k) != "") & (c(k).contains(c("now")) | c("now").contains(c(k)))
    on_now = F.when(c("p") == c("now"), EQUAL).when(meets("p"), PARTLY).otherwise(0)
    on_now = on_now + F.when((c("o") == c("now")) | (c("t") == c("now")), EQUAL).when(meets("o") | meets("t"), PARTLY).otherwise(0)
    named = sum((F.when((c(k) != "") & c("said").contains(c(k)), NAMED).otherwise(0) for k in ("s", "o", "t")), F.lit(0))
    score = F.when(c("now") != "", on_now).otherwise(0) + named + F.when(c("shown"), SHOWN).otherwise(0)
    best = asked.join(rows, "scene_id").groupBy("scene_id", "said", "now").agg(F.min(F.struct((-score).alias("m"), "id")).alias("b")).where(c("b.m") <= -ENOUGH)
    x = x.join(best.select("scene_id", "said", "now", c("b.id").alias("best")), ["scene_id", "said", "now"], "left")
    return x.select("issue_id", F.coalesce("own", "best").alias("claim_id"))
