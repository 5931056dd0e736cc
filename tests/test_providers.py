"""Providers and their cache: requests asked once, answers of any kind, and what is counted."""

import json
import sys

import pytest
from pyspark import cloudpickle

from factweave.sources import providers as P
from factweave.sources.commits import Commits

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this file

D = "chunk long, n int, evidence string, subject string, predicate string, target string, polarity boolean, claim_type string, claim string, confidence double"
C = "chunk long, pov string, text string"


class Fake:
    """Answers from a table of candidates' subjects; writes a line for each call to a folder that all see."""

    model = "fake-1"

    def __init__(self, folder, answers, busy=0):
        self.folder, self.answers, self.busy = str(folder), answers, busy

    def calls(self):
        from pathlib import Path

        return sum(1 for _ in Path(self.folder).glob("call-*"))

    def ask(self, kind, payload):
        import uuid
        from pathlib import Path

        Path(self.folder).mkdir(exist_ok=True)
        Path(f"{self.folder}/call-{uuid.uuid4().hex}").write_text(payload)
        if len(list(Path(self.folder).glob("call-*"))) <= self.busy:
            raise TimeoutError("later")
        told = json.loads(payload)
        answer = self.answers.get(told["text"][:1] if kind == "recall" else told["candidates"][0]["subject"], "{}")
        if answer == "denied":
            raise P.Denied("no quota")
        return answer


def draft(chunk, n, subject, **more):
    return tuple(({"chunk": chunk, "n": n, "evidence": "e.", "subject": subject, "predicate": "loves", "target": "Teo", "polarity": True, "claim_type": "relationship_state", "claim": f"{subject} loves Teo.", "confidence": 0.8} | more).values())


ANSWERS = {
    "Mara": json.dumps({"refinements": [
        {"candidate_id": "c0", "valid": True, "predicate": " hates ", "polarity": "no", "confidence": "0.95", "claim_type": "family_relation", "target": 7, "object": "Orin"},
        {"candidate_id": "c1", "valid": False},
        {"candidate_id": "c1", "valid": "yes", "polarity": False, "confidence": 9, "claim_type": "odd"},
        {"candidate_id": "c9", "valid": True},
        "nonsense", {"valid": True}, None,
    ]}),
    "Orin": json.dumps([{"candidate_id": "c0", "valid": 1, "confidence": None, "claim": "  "}]),
    "Teo": "no json at all",
    "Ash": json.dumps({"refinements": [{"candidate_id": "c0"}]}),
    "a": json.dumps({"claims": [{"subject": "S", "claim": "S is.", "importance": "HIGH", "polarity": False, "confidence": -3}, {"subject": "S", "claim": "T.", "evidence": "x" * 600, "target": "O", "polarity": 0, "confidence": "odd", "claim_type": "event"}, {"subject": "", "claim": "c"}, {"subject": "x"}, 5]}),
    "b": json.dumps({"claims": {"subject": "no list"}}),
}


def test_refine(spark, tmp_path):
    drafts = [draft(1, 0, "Mara"), draft(1, 1, "Ms M", confidence=0.5), draft(2, 0, "Orin"), draft(3, 0, "Teo"), draft(4, 0, "Ash"), draft(5, 0, "Mara"), draft(5, 1, "Ms M", confidence=0.5)]
    chunks = spark.createDataFrame([(i, None, "same" if i in (1, 5) else f"text {i}") for i in range(1, 7)], C)
    drafts = spark.createDataFrame(drafts, D)
    fake, cache = Fake(tmp_path / "calls", ANSWERS), Commits(spark, f"{tmp_path}/cache")
    claims, counts = P.refine(chunks, drafts, fake, cache, per_second=1000)
    got = sorted((r.chunk, r.place, r.subject, r.predicate, r.target, r.polarity, r.confidence, r.claim_type, r.claim) for r in claims.collect())
    mara = [(0, "Mara", "hates", "Orin", True, 0.95, "relationship_state", "Mara loves Teo."), (2, "Ms M", "loves", "Teo", False, 1.0, "character_state", "Ms M loves Teo.")]
    plain = lambda chunk, who: (chunk, 0, who, "loves", "Teo", True, 0.8, "relationship_state", f"{who} loves Teo.")
    assert got == sorted([(1, *m) for m in mara] + [(5, *m) for m in mara] + [plain(2, "Orin"), plain(3, "Teo"), plain(4, "Ash")])
    told = {r.chunk: (r.n_drafts, r.n_items, r.n_unknown, r.n_rejected, r.n_claims, r.cached, r.fallback) for r in counts.collect()}
    assert told[1] == told[5] == (2, 7, 4, 1, 2, False, False)
    assert told[2] == (1, 1, 0, 0, 1, False, False) and told[3] == (1, 0, 0, 0, 0, False, True) and told[4] == (1, 1, 0, 1, 0, False, True)
    assert fake.calls() == 4  # two chunks make one request
    again, counts = P.refine(chunks, drafts, fake, cache, per_second=1000)
    assert fake.calls() == 4 and sorted(map(str, again.collect())) == sorted(map(str, claims.collect())) and all(r.cached for r in counts.collect())
    other = spark.createDataFrame([(i, "Isolde", "same" if i in (1, 5) else f"text {i}") for i in range(1, 7)], C)
    P.refine(other, drafts, fake, cache, per_second=1000)
    assert fake.calls() == 8  # another narrator, other requests


def test_recall_and_failures(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "Mara", "a text"), (2, None, "b text"), (3, None, " "), (4, None, "unknown")], C)
    fake, cache = Fake(tmp_path / "calls", ANSWERS), Commits(spark, f"{tmp_path}/cache")
    claims, counts = P.recall(chunks, fake, cache, per_second=1000)
    got = sorted((r.place, r.subject, r.claim, r.target, r.polarity, r.confidence, r.claim_type, len(r.evidence), r.importance) for r in claims.collect())
    assert got == [(0, "S", "S is.", "", False, 0.0, "character_state", 5, "high"), (1, "S", "T.", "O", True, 0.75, "event", 500, "medium")]
    assert {r.chunk: (r.n_items, r.n_claims, r.ok) for r in counts.collect()} == {1: (5, 2, True), 2: (0, 0, False), 4: (0, 0, False)}
    # One that fails is tried again, comes with its error, and isn't kept.
    busy = Fake(tmp_path / "busy", ANSWERS, busy=2)
    fresh = Commits(spark, f"{tmp_path}/fresh")
    request = P.recall_requests(chunks.where("chunk = 1"), "m")
    first = P.answered(request, "recall", busy, fresh, attempts=2, per_second=1000, tasks=1).collect()
    assert [r.answer for r in first] == [None] and "TimeoutError" in first[0].error and busy.calls() == 2
    assert P.answered(request, "recall", busy, fresh, attempts=2, per_second=1000, tasks=1).collect()[0].answer == ANSWERS["a"]
    assert busy.calls() == 3 and P.answered(request, "recall", busy, fresh, per_second=1000).collect()[0].cached
    with pytest.raises(Exception, match="no quota"):
        P.answered(P.recall_requests(chunks.where("chunk = 2"), "m"), "recall", Fake(tmp_path / "no", {"b": "denied"}), fresh, per_second=1000)


def test_no_provider_and_keys(spark):
    drafts, chunks = spark.createDataFrame([draft(1, 0, "Mara")], D), spark.createDataFrame([(1, None, "t" * 13000), (2, None, "x")], C)
    claims, counts = P.refine(chunks, drafts, None, None)
    assert [(r.subject, r.generation_origin) for r in claims.collect()] == [("Mara", "llm")] and counts.first().n_drafts == 1
    key = lambda c, model="m", d=drafts: P.refine_requests(c, d, model).first().key
    same = spark.createDataFrame([(1, " ", "t" * 12000 + "other end")], C)
    assert key(chunks) == key(same) != key(chunks, "n") and key(chunks) != key(chunks, d=spark.createDataFrame([draft(1, 0, "Maro")], D))
    payload = json.loads(P.refine_requests(chunks, drafts, "m").first().payload)
    assert payload["candidates"][0]["candidate_id"] == "c0" and payload["candidates"][0]["object"] == "Teo" and len(payload["text"]) == 12000
    known = spark.createDataFrame([(2, "Teo"), (2, " Ash "), (2, "Teo"), (2, " ")], "chunk long, name string")
    assert [json.loads(r.payload)["entities"] for r in P.recall_requests(chunks, "m", known).orderBy("chunk").collect()] == [[], ["Ash", "Teo"]]
