"""Putting an old store in order: the plan is the same shown and done, and stories without changes keep their files."""

from pyspark.sql import functions as F

from factweave.plans import backfill as B
from factweave.plans import save as S
from factweave.sources.commits import Commits


def test_backfill(spark, tmp_path):
    tables = Commits(spark, f"{tmp_path}/store")
    scenes = [(11, 1, 1, "text", "Isolde Crane"), (12, 1, 2, "text", None), (21, 2, 1, "text", None)]
    entities = [(1, 1, "Mara Venn"), (2, 1, "Mara"), (3, 1, "Narrator"), (4, 1, "Teo Marr"), (5, 2, "Orin Vale"), (6, 2, "Ash Bell")]
    entities = [(i, s, n, "character", None, 0.8, i == 2, []) for i, s, n in entities]

    def claim(i, scene, s, o, status="approved", polarity=True, source_hash="h"):
        named = {e[0]: e[2] for e in entities}
        row = dict.fromkeys(S.names(S.CLAIMS))
        row |= {"id": i, "story_id": scene // 10, "scene_id": scene, "subject": named[s], "object": named[o], "predicate": "loves", "polarity": polarity, "subject_entity_id": s, "object_entity_id": o, "claim_type": "relationship_state", "claim_text": "c", "confidence": 0.9, "status": status, "source": "extracted", "source_hash": f"{source_hash}{i}", "claim_version": 1}
        return tuple(row.values())

    claims = [
        claim(100, 11, 1, 4), claim(101, 11, 2, 4, "canonized"), claim(102, 11, 2, 4, "rejected"), claim(103, 11, 2, 4, polarity=False), claim(104, 11, 3, 4), claim(105, 12, 3, 4, "suggested"), claim(106, 12, 1, 4),
        claim(200, 21, 5, 6),
    ]
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "k long")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables.commit("old", {"scenes": (frame(scenes, S.SCENES), keys(11, 12, 21), "id"), "entities": (frame(entities, S.ENTITIES), keys(1, 2), "story_id"), "claims": (frame(claims, S.CLAIMS), keys(11, 12, 21), "scene_id")})
    # One claim of story 1 has the hash it would get anew, so that a repointed one repeats it.
    fixed = tables.read("claims", S.CLAIMS).withColumn("source_hash", F.when(F.col("id") == 100, B._hash()).otherwise(F.col("source_hash")))
    tables.commit("hashed", {"claims": (fixed.where("scene_id = 11"), keys(11), "scene_id")})
    shown = sorted(map(str, B.backfill(tables, "put").collect()))
    assert len(tables.entries()) == 2
    done = B.backfill(tables, "put", apply=True).collect()
    assert sorted(map(str, done)) == shown and {r.story_id for r in done} == {1}
    kinds = {}
    for r in done:
        kinds.setdefault(r.change, set()).add(r.id)
    assert kinds["fold"] == {2} and kinds["add_entity"] == {7} and kinds["widen"] == {1} and kinds["restate"] == {105}
    assert kinds["drop_claim"] == {100} and kinds["repoint"] == {101, 102, 103, 104} and "drop_entity" not in kinds  # 105 still has the narrator
    now = {r.id: r for r in tables.read("claims", S.CLAIMS).collect()}
    assert sorted(now) == [101, 102, 103, 104, 105, 106, 200] and now[101].subject == "Mara Venn" and now[101].subject_entity_id == 1
    assert now[101].source_hash == now[102].source_hash != now[103].source_hash and now[104].subject == "Isolde Crane" and now[105].status == "needs_review"
    assert now[106].source_hash == "h106" and now[200].source_hash == "h200"
    who = {r.id: r for r in tables.read("entities", S.ENTITIES).collect()}
    assert sorted(who) == [1, 3, 4, 5, 6, 7] and "Mara" in who[1].aliases and who[1].graph_eligible and who[7].canonical_name == "Isolde Crane"
    last = tables.entries()[-1]
    assert spark.read.parquet(f"{tmp_path}/store/{last['attempt']}/claims/rows").select("story_id").distinct().collect()[0][0] == 1
    assert B.backfill(tables, "again").where("change <> 'widen'").count() == 0
