"""Model providers behind a cache: each distinct request is asked once, ever, and its answer kept by the request's digest.

A provider is any object with a `model` name and `ask(kind, payload) -> str`; it runs inside tasks, so it must be picklable and
bring its own credentials. Without one, drafts pass as they are. What providers answer is JSON; nothing of it is trusted: items
of a wrong type get defaults, unknown candidates are dropped, and all of that is counted.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..session import dealt, saved
from .commits import Commits, Taken

#: Versions of the two prompts, and how much of a text a model is shown.
REFINE_VERSION, RECALL_VERSION, TEXT_CHARS = "fastus-refine-v1", "fastus-recall-v1", 12_000
#: Of an answer without a usable one.
RECALL_CONFIDENCE, QUOTE_CHARS = 0.75, 500
ANSWERS = "key string, answer string"


class Denied(RuntimeError):
    """The provider refuses all requests (no right, no quota): the job ends."""


def _digest(*parts: tuple[str, Column]) -> Column:
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in parts])), 256)


def refine_requests(chunks: DataFrame, drafts: DataFrame, model: str) -> DataFrame:
    """(chunk, key, payload) of the chunks (chunk, pov, text) that have drafts (chunk, n, evidence, subject, predicate, target, polarity,
    claim_type, claim, confidence; n orders a chunk's, from 0): the candidates as JSON, c0, c1, ... A chunk's drafts make one request."""
    c = F.col
    item = F.struct(
        c("n"), F.concat(F.lit("c"), c("n").cast("string")).alias("candidate_id"), c("evidence"), c("subject"), c("predicate"), c("target").alias("object"), c("polarity"), c("claim_type"), c("claim"),
        F.round(c("confidence").cast("double"), 3).alias("confidence"), F.lit("Is this a valid story fact supported by the evidence?").alias("question"),
    )
    listed = drafts.groupBy("chunk").agg(F.sort_array(F.collect_list(item)).alias("x"))
    x = chunks.select("chunk", F.trim(F.coalesce("pov", F.lit(""))).alias("pov"), F.substring(F.coalesce("text", F.lit("")), 1, TEXT_CHARS).alias("text")).join(listed, "chunk")
    candidates = F.transform("x", lambda i: F.struct(*[i[f].alias(f) for f in ("candidate_id", "evidence", "subject", "predicate", "object", "polarity", "claim_type", "claim", "confidence", "question")]))
    payload = F.to_json(F.struct(candidates.alias("candidates"), c("pov"), c("text")))
    key = _digest(("version", F.lit(REFINE_VERSION)), ("model", F.lit(model)), ("pov", c("pov")), ("text", c("text")), ("candidates", candidates))
    return x.select("chunk", key.alias("key"), payload.alias("payload"))


def recall_requests(chunks: DataFrame, model: str, entities: DataFrame | None = None) -> DataFrame:
    """(chunk, key, payload) of the chunks (chunk, pov, text), with the names of known entities (chunk, name) if there are any."""
    c = F.col
    x = chunks.select("chunk", F.trim(F.coalesce("pov", F.lit(""))).alias("pov"), F.substring(F.coalesce("text", F.lit("")), 1, TEXT_CHARS).alias("text"))
    if entities is None:
        x = x.withColumn("entities", F.array().cast("array<string>"))
    else:
        names = entities.where(F.trim("name") != "").groupBy("chunk").agg(F.sort_array(F.collect_set(F.trim("name"))).alias("entities"))
        x = x.join(names, "chunk", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    key = _digest(("version", F.lit(RECALL_VERSION)), ("model", F.lit(model)), ("pov", c("pov")), ("text", c("text")), ("entities", c("entities")))
    return x.select("chunk", key.alias("key"), F.to_json(F.struct("entities", "pov", "text")).alias("payload"))


def _ask(provider, kind: str, attempts: int, pause: float):
    def build(batches: Iterator[pa.RecordBatch]):
        last = 0.0
        for batch in batches:
            answers, errors = [], []
            for payload in batch.column("payload").to_pylist():
                answer = error = None
                for attempt in range(attempts):
                    if (wait := last + pause - time.monotonic()) > 0:
                        time.sleep(wait)
                    last = time.monotonic()
                    try:
                        answer, error = provider.ask(kind, payload), None
                        break
                    except Denied:
                        raise
                    except Exception as e:  # whatever a provider raises is its answer's error
                        error = f"{type(e).__name__}: {e}"[:200]
                        time.sleep(min(8.0, pause * 2**attempt))
                answers.append(answer)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["key", "answer", "error"])

    return build


def answered(requests: DataFrame, kind: str, provider, cache: Commits, attempts: int = 3, per_second: float = 5.0, tasks: int = 4) -> DataFrame:
    """(key, answer, error, cached) for each distinct key of requests (key, payload).

    Only keys that the cache lacks are asked, each once, by `tasks` tasks that together ask no more than per_second times a second;
    a failed one is tried `attempts` times and then comes with its error, and isn't kept. The answers are written first and then enter the
    cache by one commit, so a job that dies in between asks again, and one that is run again after it doesn't.
    """
    kept = cache.read("answers", ANSWERS)
    wanted = requests.select("key", "payload").dropDuplicates(["key"])
    misses = wanted.join(kept, "key", "left_anti")
    pause = tasks / per_second
    new = saved(misses.repartition(tasks, "key").mapInArrow(_ask(provider, kind, attempts, pause), "key string, answer string, error string"), "answers")
    good = new.where("error is null and answer is not null")
    while good.limit(1).count():
        try:
            cache.commit(f"answers-{uuid.uuid4().hex}", {"answers": (good.select("key", "answer"), good.select("key"), "key")}, expected=len(cache.entries()))
            break
        except Taken:  # another job's answers came in between; both stay
            continue
    old = kept.join(wanted.select("key"), "key", "left_semi").select("key", "answer", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    return old.unionByName(new.withColumn("cached", F.lit(False)))


def _items(answer: Column, name: str, fields: tuple[str, ...]) -> Column:
    """The answer's list (under a name, or bare) as structs of the given fields, each a variant; null where it's no JSON, no list.

    Fields are taken out of a list at once: a search for each of an item's fields, by each use, cost many times the parsing. An item
    that is no object is null."""
    whole, kind = F.try_parse_json(answer), f"array<struct<{', '.join(f'{f}: variant' for f in fields)}>>"
    return F.coalesce(F.try_variant_get(whole, f"$.{name}", kind), F.try_variant_get(whole, "$", kind))


def _as(item: Column, field: str, kind: str) -> Column:
    return F.try_variant_get(item[field], "$", kind)


def _kind(item: Column, field: str) -> Column:
    return F.coalesce(F.schema_of_variant(item[field]), F.lit("VOID"))


def _words(item: Column, *fields: str) -> Column:
    """The first of the fields that is text and not blank, trimmed; else null."""
    return F.coalesce(*[F.when(_kind(item, f) == "STRING", F.nullif(F.trim(_as(item, f, "string")), F.lit(""))) for f in fields])


def _text(item: Column, *fields: str) -> Column:
    """The first of the fields that is text and not blank, trimmed; else empty."""
    return F.coalesce(_words(item, *fields), F.lit(""))


def _flag(item: Column, field: str) -> Column:
    """The field if it is a boolean; else null."""
    return F.when(_kind(item, field) == "BOOLEAN", _as(item, field, "boolean"))


def _yes(item: Column, field: str) -> Column:
    """Whether a value speaks for itself: true, a number but 0, text that isn't empty."""
    kind = _kind(item, field)
    number = F.coalesce(_as(item, field, "double") != 0, F.lit(False))
    return F.when(kind == "BOOLEAN", _as(item, field, "boolean")).when(kind == "STRING", _as(item, field, "string") != "").when(kind == "VOID", False).otherwise(number)


def _sure(told: Column, default: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(told, default.cast("double"))))


def claim_type(raw: Column) -> Column:
    """A known type; kinship is a relationship, anything else a state."""
    return F.when(raw == "family_relation", "relationship_state").when(raw.isin(*V.CLAIM_TYPES), raw).otherwise("character_state")


#: Fields of an item that are read.
_RECALLED = ("subject", "claim_type", "predicate", "object", "target", "claim", "polarity", "confidence", "evidence", "importance")
_REFINED = ("candidate_id", "valid", "subject", "claim_type", "predicate", "target", "object", "claim", "polarity", "confidence")
_CLAIM = ("subject", "claim_type", "predicate", "target", "claim", "polarity", "confidence", "canon_level", "evidence", "generation_origin")


def recalled(requests: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, counts) of what a model recalls: a claim for each item with a subject, a sentence and a quote (else the sentence is its quote).

    claims: chunk, place (in the answer), the claim's fields and importance. counts, a row a chunk: n_items, n_claims, whether it was cached,
    and `ok`: any claim. Items that are no objects, or lack a part, are counted only.
    """
    c = F.col
    x = requests.select("chunk", "key").join(answers, "key").withColumn("items", _items(c("answer"), "claims", _RECALLED))
    x = x.select("chunk", "cached", "error", F.when(c("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"), F.posexplode_outer("items").alias("place", "item"))
    item = c("item")
    told = x.select(
        "chunk", "cached", "n_items", "place", _text(item, "subject").alias("subject"), claim_type(_text(item, "claim_type")).alias("claim_type"), _text(item, "predicate").alias("predicate"),
        _text(item, "object", "target").alias("target"), _text(item, "claim").alias("claim"), F.coalesce(_flag(item, "polarity"), F.lit(True)).alias("polarity"), _sure(_as(item, "confidence", "double"), F.lit(RECALL_CONFIDENCE)).alias("confidence"),
        F.lit("active").alias("canon_level"), F.substring(_text(item, "evidence", "claim"), 1, QUOTE_CHARS).alias("evidence"), F.lit("llm_recall").alias("generation_origin"),
        F.lower(_text(item, "importance")).alias("importance"),
    ).withColumn("importance", F.when(c("importance").isin("low", "medium", "high"), c("importance")).otherwise("medium"))
    good = (c("subject") != "") & (c("claim") != "") & (c("evidence") != "")
    told = saved(told, "recalled")
    counts = told.groupBy("chunk").agg(F.max("n_items").alias("n_items"), F.count_if(good).alias("n_claims"), F.max("cached").alias("cached")).withColumn("ok", c("n_claims") > 0)
    return told.where(good).select("chunk", "place", *_CLAIM, "importance"), counts


def refined(requests: DataFrame, drafts: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, counts) of drafts as a model has refined them.

    Each item corrects the draft of its candidate_id: fields of a wrong type, blank or missing keep the draft's; the quote is the
    draft's. Items for unknown candidates are dropped; those that aren't valid, or are left without a subject or sentence, are rejected. A
    chunk of which nothing stays, or whose answer failed or is no JSON, keeps its drafts as they are (fallback). counts, a row a
    chunk: n_drafts, n_items, n_unknown, n_rejected, n_claims, cached, fallback.
    """
    c = F.col
    keyed = drafts.withColumn("candidate_id", F.concat(F.lit("c"), c("n").cast("string")))
    of_chunk = drafts.groupBy("chunk").agg(F.count("*").alias("n_drafts"))
    x = requests.select("chunk", "key").join(answers, "key").withColumn("items", _items(c("answer"), "refinements", _REFINED))
    x, item = x.select("chunk", "cached", F.posexplode_outer("items").alias("place", "item")), c("item")
    # What an item tells is read before it meets its draft, so that plain values are dealt out.
    x = x.select(
        "chunk", "cached", "place", _as(item, "candidate_id", "string").alias("candidate_id"), F.coalesce(_yes(item, "valid"), F.lit(False)).alias("valid"), _words(item, "subject").alias("subject"),
        _words(item, "claim_type").alias("claim_type"), _words(item, "predicate").alias("predicate"), _words(item, "target", "object").alias("target"), _words(item, "claim").alias("claim"),
        _flag(item, "polarity").alias("polarity"), _as(item, "confidence", "double").alias("confidence"),
    )
    d = keyed.select("chunk", "candidate_id", F.lit(True).alias("known"), F.struct(*[f for f in ("subject", "predicate", "target", "claim_type", "claim", "polarity", "confidence", "evidence")]).alias("d"))
    x = x.join(dealt(d), ["chunk", "candidate_id"], "left")
    own = lambda f: F.trim(F.coalesce(c(f"d.{f}"), F.lit("")))
    or_own = lambda f: F.coalesce(c(f), own(f)).alias(f)
    told = x.select(
        "chunk", "cached", "place", c("place").isNotNull().alias("told"), F.coalesce("known", F.lit(False)).alias("known"), "valid",
        or_own("subject"), or_own("claim_type"), or_own("predicate"), or_own("target"), or_own("claim"), F.coalesce("polarity", "d.polarity").alias("polarity"),
        _sure(c("confidence"), c("d.confidence")).alias("confidence"), F.lit("active").alias("canon_level"), F.substring(own("evidence"), 1, QUOTE_CHARS).alias("evidence"), F.lit("llm").alias("generation_origin"),
    ).withColumn("claim_type", claim_type(c("claim_type")))
    told = saved(told.withColumn("good", c("known") & c("valid") & (c("subject") != "") & (c("claim") != "")), "refined")
    counts = told.groupBy("chunk").agg(F.count_if("told").alias("n_items"), F.count_if(c("told") & ~c("known")).alias("n_unknown"), F.count_if(c("known") & ~c("good")).alias("n_rejected"), F.count_if("good").alias("n_claims"), F.max("cached").alias("cached"))
    counts = of_chunk.join(counts, "chunk", "left").select("chunk", "n_drafts", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_items", "n_unknown", "n_rejected", "n_claims")], F.coalesce("cached", F.lit(False)).alias("cached"))
    counts = saved(counts.withColumn("fallback", c("n_claims") == 0), "refined-counts")
    return told.where("good").select("chunk", "place", *_CLAIM).unionByName(passed(drafts.join(dealt(counts.where("fallback").select("chunk")), "chunk", "left_semi"))), counts


def passed(drafts: DataFrame) -> DataFrame:
    """Drafts as claims, where no model is at hand."""
    fixed = {"canon_level": F.lit("active"), "generation_origin": F.lit("llm")}
    return drafts.withColumns(fixed).select("chunk", F.col("n").cast("int").alias("place"), *_CLAIM)


def refine(chunks: DataFrame, drafts: DataFrame, provider, cache: Commits | None, **how) -> tuple[DataFrame, DataFrame]:
    """refined() by a provider; without one, or without drafts, what there is passes. how: as for answered()."""
    if provider is None:
        n = drafts.groupBy("chunk").agg(F.count("*").alias("n_drafts"))
        return passed(drafts), n.select("chunk", "n_drafts", *[F.lit(0).cast("long").alias(x) for x in ("n_items", "n_unknown", "n_rejected", "n_claims")], F.lit(False).alias("cached"), F.lit(False).alias("fallback"))
    requests = saved(refine_requests(chunks, drafts, provider.model), "requests")
    return refined(requests, drafts, answered(requests, "refine", provider, cache, **how))


def recall(chunks: DataFrame, provider, cache: Commits, entities: DataFrame | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """recalled() by a provider, of the chunks whose text isn't blank."""
    requests = saved(recall_requests(chunks.where(F.trim("text") != ""), provider.model, entities), "requests")
    return recalled(requests, answered(requests, "recall", provider, cache, **how))
