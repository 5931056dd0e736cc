"""Saves of scenes, composed and committed as one job, against a plain replay; the commit of several tables; claims onto the register."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import merge, resolve
from factweave.plans import save as S
from factweave.sources.commits import Commits, Taken

NAMES = ("Mara Venn", "Orin Vale", "Isolde Crane", "Teo Marr")
VERBS = ("trusts", "loves", "knows", "lives_in")
FOUND = "story_id long, scene_id long, ord long, subject string, predicate string, object string, polarity boolean, claim_type string, claim_text string, confidence double, canon_level string, evidence_text string, chunk_index int, generation_origin string"


def sentence(c):
    return f"{c['subject']} {c['predicate']} {c['object']} {'yes' if c['polarity'] else 'no'}."


class Replay:
    """One save after another, on dictionaries."""

    def __init__(self):
        self.claims, self.entities, self.texts = {}, {}, {}
        self.next_claim = self.next_entity = 1

    def entity(self, story, name):
        if (story, name) not in self.entities:
            self.entities[story, name] = self.next_entity
            self.next_entity += 1
        return self.entities[story, name]

    @staticmethod
    def hashed(c):
        key = "|".join([str(c["s"]), c["predicate"], str(c["o"]), c["claim_type"], *([] if c["polarity"] else ["neg"])])
        return hashlib.sha256(key.encode()).hexdigest()[:32]

    def resolved(self, story, told):
        out = []
        for c in told:
            s, o = self.entity(story, c["subject"]), self.entity(story, c["object"])
            c = c | {"s": s, "o": o, "claim_type": "relationship_state"}
            out.append(c | {"hash": self.hashed(c), "pair": (s, o, c["predicate"], c["polarity"])})
        return out

    def save(self, scene, story, text, manual, found, run):
        """found and manual: told claims, in order; ids of claims are given at the end, as the job does."""
        manual, found = self.resolved(story, manual), self.resolved(story, found if run and text.strip() else [])
        mine = {i: c for i, c in self.claims.items() if c["scene"] == scene}
        if manual:
            mine = {i: c for i, c in mine.items() if c["source"] != "manual"}
        canon_before = [(i, c) for i, c in sorted(self.claims.items()) if c["story"] == story and c["scene"] != scene]
        for c in manual:
            mine[self.next_claim] = self.row(c, scene, story, "approved", "manual") | {"confidence": 1.0, "history": None}
            self.next_claim += 1
        canon = sorted([*canon_before, *mine.items()], key=lambda x: x[0])
        canon = [c for _, c in canon if c["status"] in ("approved", "canonized") and c["until"] is None]
        touched, new = set(), []
        if run and text.strip():
            mine = {i: c for i, c in mine.items() if c["status"] in ("approved", "canonized", "rejected")}
            rows = [dict(c, key=i) for i, c in sorted(mine.items())]
            by_hash, by_proof, by_pair, by_subject, bumped = {}, {}, {}, {}, set()

            def index(r, first=False):
                by_hash[r["hash"]] = r
                for table, k in ((by_proof, r["evidence"].lower()), (by_pair, r["pair"])):
                    if not (first and k in table):
                        table[k] = r
                if r["until"] is None:
                    by_subject[r["s"], r["predicate"], r["polarity"]] = r

            canon_hash, canon_pair = {c["hash"] for c in canon}, {c["pair"] for c in canon}
            for r in rows:
                index(r, True)
            for c in found:
                proof = by_proof.get(c["evidence"].lower())
                r = by_hash.get(c["hash"]) or (proof if proof and proof["polarity"] == c["polarity"] else None) or by_pair.get(c["pair"])
                if r:
                    if by_hash.get(r["hash"]) is r:
                        del by_hash[r["hash"]]
                    r |= {k: c[k] for k in ("subject", "predicate", "object", "polarity", "s", "o", "hash", "pair", "confidence", "evidence", "text")}
                    if r["key"] not in bumped:
                        bumped.add(r["key"])
                        r["version"] += 1
                        r["history"] = [*(r["history"] or []), [r["version"], c["confidence"], scene]]
                    index(r)
                    touched.add(r["key"])
                    continue
                prior = by_subject.get((c["s"], c["predicate"], c["polarity"]))
                if prior and prior["o"] != c["o"] and prior["until"] is None and c["predicate"] in ("trusts", "loves", "lives_in"):
                    prior["until"] = scene
                if c["hash"] in canon_hash or c["pair"] in canon_pair:
                    continue
                status = "approved" if c["confidence"] >= 0.9 else "needs_review" if c["confidence"] >= 0.65 else "suggested"
                r = self.row(c, scene, story, status, "extracted") | {"key": ("new", len(new)), "history": [[1, c["confidence"], scene]]}
                new.append(r)
                touched.add(r["key"])
                index(r)
            mine = {r["key"]: r for r in rows}
            for r in new:
                mine[self.next_claim] = r
                touched.add(self.next_claim)
                self.next_claim += 1
        if text.strip():
            mine = {i: c for i, c in mine.items() if i in touched or c["source"] == "manual" or c["evidence"].lower() in text.lower()}
        self.claims = {i: c for i, c in self.claims.items() if c["scene"] != scene} | mine

    @staticmethod
    def row(c, scene, story, status, source):
        return c | {"scene": scene, "story": story, "status": status, "source": source, "version": 1, "until": None, "history": None}

    def table(self):
        return sorted(
            (i, c["scene"], c["subject"], c["predicate"], c["object"], c["polarity"], c["s"], c["o"], c["confidence"], c["status"], c["source"], c["hash"], c["version"], c["until"], c["history"])
            for i, c in self.claims.items()
        )


def stored(tables):
    out = []
    for r in tables.read("claims", S.CLAIMS).collect():
        past = None if r.confidence_history is None else [[x["version"], x["confidence"], x["scene_id"]] for x in json.loads(r.confidence_history)]
        out.append((r.id, r.scene_id, r.subject, r.predicate, r.object, r.polarity, r.subject_entity_id, r.object_entity_id, r.confidence, r.status, r.source, r.source_hash, r.claim_version, r.valid_until_scene, past))
    return sorted(out)


def made(rng, n):
    out = []
    for _ in range(n):
        s, o = rng.sample(NAMES, 2)
        c = {"subject": s, "predicate": rng.choice(VERBS), "object": o, "polarity": rng.random() < 0.8, "confidence": rng.choice([0.5, 0.7, 0.95])}
        proof = sentence(c) if rng.random() < 0.8 else "She said so."
        out.append(c | {"text": sentence(c), "evidence": proof})
    return out


def row_of(c, story, scene, n):
    return (story, scene, n, c["subject"], c["predicate"], c["object"], c["polarity"], "relationship_state", c["text"], c["confidence"], "active", c["evidence"], 0, "structural")


def test_replay(spark, tmp_path):
    """Random saves of two stories' scenes, one job each: claims, ids, versions, histories and entities are those of the replay."""
    rng, tables, replay, numbers = random.Random(3), Commits(spark, f"{tmp_path}/store"), Replay(), {}
    for n in range(6):
        # One scene of each story, as scenes of one job don't see each other's new facts.
        chosen = [(story, story * 10 + rng.randrange(3)) for story in rng.sample((1, 2), rng.choice([1, 2]))]
        saves, manual, found, plain = [], [], [], []
        for story, scene in sorted(chosen):
            told, own, run = made(rng, rng.randrange(0, 7)), made(rng, rng.choice([0, 0, 1, 2])), rng.random() < 0.85
            text = " ".join([sentence(c) for c in told if rng.random() < 0.8] + ["She said so."] * (rng.random() < 0.7)) if rng.random() < 0.9 else "  "
            saves.append((scene, story, scene % 10, text, None, run))
            manual += [(story, scene, k, c["subject"], c["predicate"], c["object"], c["polarity"], None, c["text"], c["evidence"], None, None, False) for k, c in enumerate(own)]
            found += [row_of(c, story, scene, k) for k, c in enumerate(told)]
            plain.append((scene, story, text, own, told, run))
            numbers[scene] = text
        # Ids: entered claims of all scenes come before new extracted ones, as one job numbers them.
        replay_many(replay, plain)
        extract = lambda live, found=found: spark.createDataFrame(found, FOUND).join(live.select(F.col("id").alias("scene_id")), "scene_id", "left_semi")
        frame = spark.createDataFrame(saves, "id long, story_id long, scene_number int, text string, pov string, run_extraction boolean")
        counts = S.save(tables, f"save-{n}", frame, spark.createDataFrame(manual, S.MANUAL) if manual else None, extract)
        assert stored(tables) == replay.table(), n
        assert counts["claims"] == sum(c["scene"] in {s for _, s in chosen} for c in replay.claims.values())
    again = stored(tables)
    assert S.save(tables, "save-3", frame, None, extract) == {} and stored(tables) == again
    got = {(r.story_id, r.canonical_name): r.id for r in tables.read("entities", S.ENTITIES).collect()}
    assert got == replay.entities
    assert {r.id: r.text for r in tables.read("scenes", S.SCENES).collect()} == numbers
    before = {r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/store").select("path").collect()}
    issues = tables.read("issues", S.ISSUES).count()
    tables.compact(S.TABLES)
    assert stored(tables) == again and tables.read("issues", S.ISSUES).count() == issues and len(tables._live("claims")) == 1
    after = {r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/store").select("path").collect()}
    assert before <= after


def replay_many(replay, plain):
    """Scenes of one job, each seeing the stories as they were before it; ids of entered claims first."""
    base, entered, fresh = dict(replay.claims), replay.next_claim, {}
    total_entered = sum(len(own) for *_, own, _, _ in plain)
    later, first = entered + total_entered, entered
    for scene, story, text, own, told, run in plain:
        replay.claims, replay.next_claim = dict(base), 10_000_000
        replay.save(scene, story, text, own, told, run)
        mine = {i: c for i, c in replay.claims.items() if c["scene"] == scene}
        renamed = {}
        ids = {10_000_000 + k: first + k for k in range(len(own))}
        first += len(own)
        for i in sorted(mine):
            if i < 10_000_000:
                renamed[i] = mine[i]
            elif i in ids:
                renamed[ids[i]] = mine[i]
            else:
                renamed[later] = mine[i]
                later += 1
        # new claims that pruning took have no number of their own: none is, as all are touched
        fresh[scene] = renamed
    replay.claims = {i: c for i, c in base.items() if c["scene"] not in fresh} | {i: c for cs in fresh.values() for i, c in cs.items()}
    replay.next_claim = max([entered - 1, *replay.claims, *([first - 1] if total_entered else [])]) + 1


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def test_commits_whole_or_not(spark, tmp_path, monkeypatch):
    """A job that dies between two tables, or before its entry, leaves all as it was; run again, it is done once."""
    tables = Commits(spark, f"{tmp_path}/t")
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    one = {"a": (frame_of(spark, [(1, "x"), (2, "y")]), keys(1, 2), "id"), "b": (frame_of(spark, [(1, "p")]), keys(1), "id")}
    assert tables.read("a", "id long, text string").count() == 0
    assert tables.commit("first", one) and not tables.commit("first", one)
    two = {"a": (frame_of(spark, [(2, "z")]), keys(2, 3), "id"), "b": (frame_of(spark, [(1, "q")]), keys(1), "id")}
    now = lambda t: sorted(map(tuple, tables.read(t, "id long, text string").collect()))
    failing = frame_of(spark, [(1, "q")]).withColumn("text", F.expr("raise_error('lost')").cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables.commit("second", two | {"b": (failing, keys(1), "id")})
    assert now("a") == [(1, "x"), (2, "y")] and now("b") == [(1, "p")]
    monkeypatch.setattr(Commits, "_enter", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError, match="died"):
        tables.commit("second", two)
    monkeypatch.undo()
    assert now("a") == [(1, "x"), (2, "y")] and now("b") == [(1, "p")]
    assert tables.commit("second", two) and not tables.commit("second", two)
    assert now("a") == [(1, "x"), (2, "z")] and now("b") == [(1, "q")]
    assert tables.commit("third", {"a": (frame_of(spark, []), keys(1), "id")}) and now("a") == [(2, "z")]
    with pytest.raises(Taken):
        tables.commit("fourth", two, expected=2)
    monkeypatch.setattr(Commits, "entries", lambda self, real=Commits.entries: real(self)[:2])
    with pytest.raises(Taken):  # another took the number meanwhile
        tables.commit("fifth", two)


E_SCHEMA = "id long, story_id long, canonical_name string, entity_type string, place_granularity string, type_confidence double, graph_eligible boolean, aliases array<string>"
C_SCHEMA = "story_id long, scene_id long, ord long, subject string, predicate string, object string, claim_type string, claim_text string, evidence_text string, polarity boolean, entered boolean"


def test_resolved_claims(spark):
    """Names found and renamed, ids of new entities by story, nobody, missing objects, places and types."""
    e = [(7, 1, "Mara", "character", None, 0.6, True, []), (9, 2, "Mara", "character", None, 0.85, True, ["Em"])]
    c = [
        (1, 1, 1, "Mara", "Trusts", "Teo Marr", "relationship_state", "Mara trusts Teo Marr.", "", True, False),
        (1, 1, 2, "Mara Venn", "lives in", "Stonefield", "character_state", "Mara Venn lives in Stonefield.", "the house in Stonefield", None, False),
        (1, 1, 3, "I", "loves", "Teo", "relationship_state", "I love Teo.", "", True, False),
        (1, 1, 4, "Teo", "", "", "character_state", "Teo hated rain.", "", False, None),
        (1, 1, 5, "Teo", "Is Fond Of", "narrator", "x", "?", "", True, True),
        (2, 2, 1, "Em", "event", "Orin Vale", "event", "Em speaks with Orin Vale.", "", True, False),
        (2, 2, 2, " ", "loves", "Em", "", None, None, True, True),
        (3, 3, 1, "Isolde Crane", "Is Fond Of", "Isolde", None, None, None, True, True),
    ]
    claims, entities = resolve.resolved_claims(spark.createDataFrame(e, E_SCHEMA), spark.createDataFrame(c, C_SCHEMA))
    got = {(r.story_id, r.ord): r for r in claims.collect()}
    assert len(got) == len(c)
    named = {(r.story_id, r.canonical_name): r.id for r in entities.collect()}
    assert named == {(1, "Mara Venn"): 7, (1, "Teo Marr"): 10, (1, "Stonefield"): 11, (2, "Mara"): 9, (2, "Orin Vale"): 12, (3, "Isolde Crane"): 13}
    r = got[1, 1]
    assert (r.subject, r.predicate, r.object, r.subject_entity_id, r.object_entity_id, r.unresolved) == ("Mara", "trusts", "Teo Marr", 7, 10, None)
    assert r.source_hash == hashlib.sha256(b"7|trusts|10|relationship_state").hexdigest()[:32]
    r = got[1, 2]
    assert (r.subject, r.predicate, r.object) == ("Mara Venn", "lives_at", "Stonefield") and r.polarity is True
    assert got[1, 3].unresolved == "subject" and got[1, 3].subject_entity_id is None and got[1, 3].source_hash is None
    r = got[1, 4]
    assert (r.subject, r.predicate, r.object, r.object_entity_id) == ("Teo Marr", "hated", "Teo hated rain.", None)
    assert r.source_hash == hashlib.sha256(b"10|hated||character_state|neg").hexdigest()[:32]
    assert got[1, 5].unresolved == "object" and got[2, 2].unresolved == "subject"
    assert (got[2, 1].predicate, got[2, 1].subject, got[2, 1].subject_entity_id) == ("speaks with", "Mara", 9)
    r = got[3, 1]
    assert (r.subject, r.predicate, r.object, r.subject_entity_id, r.object_entity_id) == ("Isolde Crane", "Is Fond Of", "Isolde Crane", 13, 13)
    none, all_ = resolve.resolved_claims(spark.createDataFrame(e, E_SCHEMA), spark.createDataFrame([], C_SCHEMA))
    assert none.count() == 0 and all_.count() == 2


def test_consecutive(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(500)]
    got = resolve.consecutive(spark.createDataFrame(rows, "a long, b long").repartition(7), "n", 11, "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows) and [r.n for r in sorted(got, key=lambda r: r.n)] == list(range(11, 511))
    assert resolve.consecutive(spark.createDataFrame([], "a long"), "n", 1, "a").count() == 0


def test_write_commands(spark, tmp_path):
    """Editing a claim, setting an issue's state, removing a scene, and numbers that are taken."""
    tables = Commits(spark, f"{tmp_path}/store")
    scenes = lambda *rows: spark.createDataFrame(rows, "id long, story_id long, scene_number int, text string, pov string, run_extraction boolean")
    told = {11: ("Mara Venn", "loves", "Teo Marr", True), 12: ("Mara Venn", "loves", "Teo Marr", False), 21: ("Orin Vale", "loves", "Isolde Crane", True)}
    rows = [row_of({"subject": s, "predicate": p, "object": o, "polarity": q, "confidence": 0.95, "text": f"{s} {p} {o}", "evidence": f"{s} {p} {o}"}, k // 10, k, 0) for k, (s, p, o, q) in told.items()]
    extract = lambda live: spark.createDataFrame(rows, FOUND).join(live.select(F.col("id").alias("scene_id")), "scene_id", "left_semi")
    text = lambda k: " ".join(told[k][:3])
    assert S.save(tables, "a", scenes((11, 1, 1, text(11), None, True), (21, 2, 1, text(21), None, True)), None, extract)["inserted"] == 2
    assert S.save(tables, "b", scenes((12, 1, 2, text(12), None, None)), None, extract)["issues"] == 1
    issue = tables.read("issues", S.ISSUES).collect()
    assert [(r.scene_id, r.conflict_kind, r.resolution_status) for r in issue] == [(12, "polarity_flip", "open")]
    other = sorted(map(str, tables.read("claims", S.CLAIMS).where("story_id = 2").collect()))
    assert S.set_issue_states(tables, "c", spark.createDataFrame([(issue[0].id, "fixed"), (99, "open"), (issue[0].id, "odd")], "id long, status string"))
    assert [r.resolution_status for r in tables.read("issues", S.ISSUES).collect()] == ["fixed"]
    mine = tables.read("claims", S.CLAIMS).where("scene_id = 12").first()
    assert S.edit_claims(tables, "d", spark.createDataFrame([(mine.id, "approved", None, None, "Isolde Crane")], "id long, status string, claim_text string, subject string, object string"))
    now = tables.read("claims", S.CLAIMS).where(f"id = {mine.id}").first()
    assert now.object == "Isolde Crane" and now.object_entity_id != mine.object_entity_id and now.source_hash != mine.source_hash and now.claim_version == mine.claim_version
    assert tables.read("issues", S.ISSUES).count() == 0
    assert sorted(map(str, tables.read("claims", S.CLAIMS).where("story_id = 2").collect())) == other
    taken = S.taken_numbers(tables, scenes((13, 1, 2, "", None, True), (12, 1, 2, "", None, True), (14, 1, 5, "", None, True)).where("id <> 12"))
    assert [r.id for r in taken.collect()] == [13]
    assert S.remove_scenes(tables, "e", spark.createDataFrame([(11,)], "scene_id long"))
    assert sorted(r.scene_id for r in tables.read("claims", S.CLAIMS).collect()) == [12, 21] and sorted(r.id for r in tables.read("scenes", S.SCENES).collect()) == [12, 21]
    assert {r.story_id: r.total for r in S.counts(tables).collect()} == {1: 1, 2: 1}


def test_merged_rows_words(spark):
    """Rows without ids are told apart by their words' hash, and a stored hash counts."""
    cols = "id long, " + FOUND.replace("ord long, ", "") + ", subject_entity_id long, object_entity_id long, status string, source string, is_major_plotline boolean, claim_version int, valid_from_scene long, valid_until_scene long, confidence_history string"
    old = [(5, 1, 1, "Mara", "loves", "Teo", True, "relationship_state", "t", 0.8, "active", "e", 0, "structural", None, None, "approved", "extracted", False, 2, 1, None, None)]
    keyed = {r.id: r.source_hash for r in merge.keyed(spark.createDataFrame(old, cols)).collect()}
    assert keyed == {5: hashlib.sha256(b"mara|relationship_state|teo").hexdigest()[:32]}
    with_hash = spark.createDataFrame(old, cols).withColumn("source_hash", F.lit("kept"))
    assert merge.keyed(with_hash).first().source_hash == "kept"
