"""Operators of the fact engine: results against DuckDB on the smallest tables, and planted cases."""

import duckdb
import pytest

from factweave.operators import chapters, graph, store, validate
from factweave.plans import answers, oracle, queries, readings, reviews, upgrades
from factweave.sources import manuscripts

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


ORACLES = oracle.ORACLES | reviews.ORACLES | readings.ORACLES | answers.ORACLES | upgrades.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(columns, rel.fetchall())


CLAIM = "id long, story_id long, scene_id long, subject string, predicate string, object string, polarity boolean, subject_entity_id long, object_entity_id long, is_major_plotline boolean, claim_type string, confidence double, canon_level string, status string, valid_until_scene long, claim_text string, evidence_text string"


def claim(i, scene, s, p, o, polarity=True, status="approved", closed=None, major=False, evidence="", sid=None, oid=None, kind="relationship_state"):
    return (i, 1, scene, s, p, o, polarity, sid, oid, major, kind, 0.9, "active", status, closed, None, evidence)


@pytest.mark.parametrize(
    "old, new, expected",
    [
        (("Asha", "trusts", "Rohan", {"major": True}), ("Asha", "trusts", "Nobody", {"major": True}), [("exclusive_object", "high")]),
        (("A", "likes", "B", {}), ("A", "likes", "C", {}), []),
        (("A", "lives in", "Xtown", {}), ("A", "lives in", "Ytown", {}), [("exclusive_object", "medium")]),
        (("A", "lives in", "Xtown", {}), ("A", "lives in", "the old house", {}), []),
        (("P", "father_of", "C", {}), ("P", "father_of", "C", {"polarity": False}), [("polarity_flip", "medium")]),
        (("A", "trusts", "B", {}), ("A", "distrusts", "B", {}), [("predicate_opposition", "medium")]),
        (("A", "distrusts", "B", {}), ("A", "trusts", "B", {"polarity": False}), []),
        (("A", "lives in", "Xtown", {"closed": 1}), ("A", "lives in", "Ytown", {}), []),
        (("A", "lives in", "Xtown", {"status": "suggested"}), ("A", "lives in", "Ytown", {}), []),
        (("A", "lives in", "Xtown", {}), ("A", "lives in", "Ytown", {"status": "rejected"}), []),
        (("A", "lives in", "Xtown", {}), ("A", "lives in", "Ytown", {"status": "needs_review"}), [("exclusive_object", "medium")]),
        (("A", "trusts", "B", {}), ("A", "distrusts", "B", {"evidence": "It made A uncomfortable."}), []),
        (("A", "distrusts", "B", {}), ("A", "fears", "B", {}), []),
    ],
)
def test_continuity_cases(spark, old, new, expected):
    claims = spark.createDataFrame([claim(1, 1, *old[:3], **old[3]), claim(2, 2, *new[:3], **new[3])], CLAIM)
    scenes = spark.createDataFrame([(1, 1, 1, "x"), (2, 1, 2, "y")], "id long, story_id long, scene_number int, text string")
    entities = spark.createDataFrame([], "id long, story_id long, canonical_name string, entity_type string, place_granularity string, graph_eligible boolean")
    found = validate.issues(validate.prepared(claims, scenes, entities)).collect()
    assert sorted((r.conflict_kind, r.severity) for r in found) == expected


def test_graph_cases(spark):
    entities = spark.createDataFrame([(i, 1, f"N{i}", "character" if i < 3 else "place", None, True) for i in (1, 2, 3)], "id long, story_id long, canonical_name string, entity_type string, place_granularity string, graph_eligible boolean")
    scenes = spark.createDataFrame([(1, 1, 1, "x")], "id long, story_id long, scene_number int, text string")
    made = [
        claim(1, 1, "N1", "loves", "N2", sid=1, oid=2),
        claim(2, 1, "N1", "desires", "N2", sid=1, oid=2),
        claim(3, 1, "N1", "knows", "N2", sid=1, oid=2, status="suggested"),
        claim(4, 1, "N1", "loves", "N3", sid=1, oid=3),
        claim(5, 1, "N2", "loves", "N1", sid=2, oid=1, polarity=False),
    ]
    claims = spark.createDataFrame(made, CLAIM)
    edge = graph.edges(claims, scenes, entities, preview=True).collect()
    assert [(e.source, e.target, e.label, e.sub_relationships, e.claim_count, e.status) for e in edge] == [(1, 2, "romantic", "desires,loves", 2, "active")]
    nodes = {n.entity_id: (n.mention_count, n.relationship_degree) for n in graph.nodes(claims, scenes, entities).collect()}
    assert nodes == {1: (4, 2), 2: (3, 2)}


def test_graph_ends_by_name(spark):
    """Claims without ids count by their names; unknown names, placeholders and places make no edge."""
    entities = spark.createDataFrame([(1, 1, "Mara Venn", "character", None, True), (2, 1, "Teo", "character", None, True), (3, 1, "Stonefield", "place", None, False), (4, 2, "Orin", "character", None, True)], "id long, story_id long, canonical_name string, entity_type string, place_granularity string, graph_eligible boolean")
    scenes = spark.createDataFrame([(1, 1, 1, "x")], "id long, story_id long, scene_number int, text string")
    made = [
        claim(1, 1, "Mara", "loves", " teo ", sid=None, oid=None),
        claim(2, 1, "Mara Venn", "trusts", "Teo", sid=1, oid=None),
        claim(3, 1, "Mara Venn", "trusts", "Stonefield", sid=None, oid=None),
        claim(4, 1, "Mara Venn", "trusts", "Orin"),
        claim(5, 1, "I", "trusts", "Teo", polarity=False),
        claim(6, 1, None, "trusts", ""),
        claim(7, 1, "Teo", "trusts", "Mara", status="suggested"),
        claim(8, 1, "Teo", "knows", "Mara Venn", status="needs_review"),
    ]
    claims = spark.createDataFrame(made, CLAIM)
    edge = graph.edges(claims, scenes, entities, preview=True).collect()
    assert sorted((e.source, e.target, e.sub_relationships, e.claim_count, e.status) for e in edge) == [(1, 2, "loves,trusts", 2, "active"), (2, 1, "trusts", 1, "preview")]
    nodes = {n.entity_id: (n.mention_count, n.relationship_degree) for n in graph.nodes(claims, scenes, entities).collect()}
    assert nodes == {1: (4, 2), 2: (3, 2)}
    assert [tuple(r) for r in graph.meta(claims, scenes, entities, preview=True).collect()] == [(1, 2, 1)]
    ends = graph.with_ends(claims, entities)
    assert ends.columns == claims.columns and ends.count() == len(made)
    assert graph.edges(claims, scenes, entities, by_name=False).count() == 0


def test_empty_tables(spark):
    claims = spark.createDataFrame([], CLAIM)
    scenes = spark.createDataFrame([], "id long, story_id long, scene_number int, text string")
    assert store.bucket_counts(claims).count() == store.stale(claims, scenes).count() == 0


def test_chunks(spark):
    words = [f"w{i}" for i in range(3500)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "  a b "), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_index, r.n_words, r.chunk) for r in chapters.chunks(docs).collect())
    assert [g[:3] for g in got] == [(1, 0, 1500), (1, 1, 1500), (1, 2, 900), (2, 0, 2), (3, 0, 0)]
    assert got[1][3].split() == words[1300:2800] and got[3][3] == "a b"


def test_sentences(spark):
    text = "One. Two!? Three"
    got = chapters.sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert [text[r.start : r.start + r.length] for r in got] == ["One.", " Two!?", " Three"]


@pytest.mark.parametrize("text, n", [("a\n---\nb", 2), ("## A\nx\n## B\ny", 2), ("Chapter 1\nx\nchapter 2\ny", 2), ("z" * 90 + "\n\n\n" + "y" * 90, 2), ("plain", 1), ("", 1)])
def test_scene_split(spark, text, n):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, text)], "id long, t string")
    assert manuscripts.scenes(docs, "id", F.col("t")).count() == n
