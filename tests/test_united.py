"""Claims located together, and all sources of extraction as one bag, against what is done claim by claim."""

import json
import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from factweave.operators import evidence
from factweave.plans import extract
from factweave.sources.commits import Commits

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this file

CLAIMS = "id long, text_id long, evidence string, claim string, target string, subject string"


def claims_of(rng, n, texts):
    words = "gate river stone evening Mara Teo lantern quiet harbour winter letter".split()
    out = []
    for i in range(n):
        t = rng.choice(texts)
        kind = rng.randrange(6)
        piece = t[1][rng.randrange(max(1, len(t[1]))) :][: rng.randrange(1, 60)] if t[1] else ""
        proof = [piece, piece.upper(), piece.replace(" ", "\n  "), " ".join(rng.sample(words, 5)), None, " ".join(rng.sample(words, 4)) + ". " + piece][kind]
        out.append((i, t[0], proof, " ".join(rng.sample(words, 4)), rng.choice([*words, None, "x"]), "Mara"))
    return out


def test_located_together(spark, monkeypatch):
    """Each claim as located() and anchored() have it alone, however many share a copy of the text."""
    rng = random.Random(4)
    words = "the gate by the river was quiet. Mara kept a lantern! Teo wrote a letter in winter? evening over the stone harbour".split()
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 80, 300])))) for i in range(6)] + [(6, None), (7, "  ")]
    rows = claims_of(rng, 400, [(i, t or "") for i, t in texts])
    claims, frame = spark.createDataFrame([*rows, (999, 77, "no text", "", "", "")], CLAIMS), spark.createDataFrame(texts, "text_id long, text string")
    alone = claims.join(frame, "text_id").select("id", "text_id", evidence.located(*[F.col(c) for c in ("text", "evidence", "claim", "target", "subject")]).alias("s"), evidence.anchored(F.col("text"), F.col("evidence"), F.col("claim")).alias("stands")).select("id", "text_id", "s.*", "stands")
    want = sorted((r.id, r.text_id, r.start, r.length, r.anchor, r.stands or (r.start >= 0 and r.length > 0 and r.anchor != "")) for r in alone.collect())
    for together in (256, 7):
        monkeypatch.setattr(evidence, "TOGETHER", together)
        assert sorted(map(tuple, evidence.located_together(claims, frame).collect())) == want
    assert len(want) == 400


def test_many_claims_of_one_text(spark):
    """A long text is shipped once for each 256 claims: ten times the claims take about ten times as long, not a text each."""
    rng = random.Random(5)
    text = " ".join(f"Line {i} tells of {rng.choice(['Mara', 'Teo', 'Orin'])} by the gate number {i}." for i in range(4000))
    frame, took = spark.createDataFrame([(1, text)], "text_id long, text string"), []
    for n in (300, 3000):
        rows = [(i, 1, f"by the gate number {i % 4000}.", "x", "y", "z") for i in range(n)]
        start = time.perf_counter()
        got = evidence.located_together(spark.createDataFrame(rows, CLAIMS).repartition(4), frame).agg(F.count_if("anchored"), F.count("*")).first()
        took.append(time.perf_counter() - start)
        assert tuple(got) == (n, n)
    assert took[1] < 15 * took[0] + 3


class Recaller:
    model = "fake"

    def ask(self, kind, payload):
        told = json.loads(payload)
        if "Mara" not in told["text"]:
            return json.dumps({"claims": []})
        return json.dumps({"claims": [
            {"subject": "Mara Venn", "predicate": "trusts", "object": "Teo Marr", "claim_type": "relationship_state", "claim": "Mara Venn trusts Teo Marr deeply.", "evidence": "Mara Venn trusts Teo Marr.", "confidence": 0.95, "importance": "high"},
            {"subject": "Ada Quill", "predicate": "lives in", "object": "Stonefield", "claim_type": "character_state", "claim": "Ada Quill lives in Stonefield.", "evidence": "nowhere to be found at all", "confidence": 0.9},
        ]})


@pytest.mark.parametrize("strict", [False, True])
def test_united(spark, tmp_path, strict):
    texts = [(1, "Mara Venn trusts Teo Marr. The evening was long and cold over the harbour.", None), (2, "", None), (3, None, "Isolde"), (4, "Orin Vale trusts Teo Marr.", "Isolde")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, pov string")
    claims, counts = extract.united(docs, Recaller(), Commits(spark, f"{tmp_path}/cache"), strict, per_second=1000)
    got = {(r.doc_id, r.subject, r.predicate, r.target): r for r in claims.collect()}
    told = got[1, "Mara Venn", "trusts", "Teo Marr"]
    assert told.anchored and told.n_sources >= 2 and "llm_recall" in told.generation_origin and told.claim == "Mara Venn trusts Teo Marr deeply." and told.evidence.startswith("Mara Venn trusts Teo Marr")
    assert ((1, "Ada Quill", "lives_in", "Stonefield") in got) != strict
    if not strict:
        lost = got[1, "Ada Quill", "lives_in", "Stonefield"]
        assert not lost.anchored and lost.review_status == "needs_review" and abs(lost.confidence - 0.75) < 1e-9 and lost.n_sources == 1
    assert (4, "Orin Vale", "trusts", "Teo Marr") in got and {k[0] for k in got} == {1, 4}
    told = {r.doc_id: r for r in counts.collect()}
    assert told[1].n_recalled == 2 and told[1].n_dropped == int(strict) and told[1].n_anchored == told[1].n_merged - 1 and 4 in told and 2 not in told
    bare, _ = extract.united(docs)
    assert {r.doc_id for r in bare.collect()} == {1, 4} and extract.united(docs.where("false"))[0].count() == 0
