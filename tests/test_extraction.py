"""Extraction, drafts, entities, evidence, the ordered merge and the editor, on small original texts."""

import itertools

import pytest
from factweave.operators import editor, entities, evidence, extraction, merge
from pyspark.sql import functions as F

F_DRAFT = "id long, scene_id long, ord long, subject string, predicate string, target string, claim_type string, polarity boolean, confidence double, claim string, evidence string, anchored boolean, generation_origin string"
F_CLAIM = "id long, story_id long, scene_id long, ord long, subject_entity_id long, predicate string, object_entity_id long, claim_type string, polarity boolean, evidence_text string, status string, confidence double, valid_until_scene long"


def _draft(i, subject="Mara", predicate="trusts", target="Teo", confidence=0.6, claim="Mara trusts Teo.", evidence="Mara trusts Teo.", anchored=True, origin="structural", polarity=True):
    return (i, 1, i, subject, predicate, target, "relationship_state", polarity, confidence, claim, evidence, anchored, origin)


def test_stances(spark):
    texts = [
        (1, "Mara trusts Teo. Teo loved Stonefield.", None),
        (2, "I did not trust Teo at all.", "Mara Venn"),
        (3, "Mara did not trust Teo.", None),
        (4, "My distaste for Stonefield grew. I love you, Mom.", "Mara Venn"),
        (5, "Corin is the half-brother of Mara Venn.", None),
        (6, None, None),
        (7, "", "Mara Venn"),
        (8, "I loved Teo because he sang.", None),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string, pov string")
    found = extraction.judged(extraction.stances(docs, pov_col="pov").join(docs.select("doc_id", "pov"), "doc_id"), F.col("pov"))
    got = {(r.doc_id, r.subject, r.predicate, r.target, r.polarity) for r in found.where("reject_reason is null").collect()}
    assert {(1, "Mara", "trusts", "Teo", True), (1, "Teo", "loves", "Stonefield", True), (2, "Mara Venn", "trusts", "Teo", False)} <= got
    assert (3, "Mara did", "trusts", "Teo", False) in got
    assert {(4, "Mara Venn", "detests", "Stonefield", True), (4, "Mara Venn", "loves", "Mom", True), (5, "Corin", "is_half_brother_of", "Mara Venn", True)} <= got
    assert not {d for d, *_ in got} & {6, 7, 8}
    assert extraction.stances(docs.limit(0)).count() == 0


def test_plain_rules(spark):
    docs = spark.createDataFrame([(1, "Mara still did not fully trust Teo. The wyrm cannot be killed."), (2, None)], "doc_id long, text string")
    got = [(r.subject, r.predicate, r.target, r.claim) for r in extraction.plain(docs).orderBy("ord").collect()]
    assert got == [("Mara still", "distrusts", "Teo", "Mara still does not fully trust Teo."), ("The wyrm", "cannot_be_killed", "", "The wyrm cannot be killed.")]


def test_narrator_and_pov(spark):
    rows = [(1, "I", "I miss Teo.", "Mara"), (2, "I", "I miss Teo.", None), (3, "that Orin", "that Orin left.", "Mara"), (4, "the", "the left.", "Mara"), (5, None, None, "Mara")]
    d = spark.createDataFrame(rows, "id long, subject string, claim string, pov string")
    got = {r.id: (r.subject, r.claim) for r in extraction.for_pov(d, F.col("pov")).collect()}
    assert got == {1: ("Mara", "Mara miss Teo."), 2: ("I", "I miss Teo."), 3: ("Orin", "Orin left.")}


@pytest.mark.parametrize("anchored", list(itertools.product([True, False], repeat=3)))
def test_merged_sources_against_a_plain_fold(spark, anchored):
    origins, confidences = ("llm_recall", "fastus", "structural"), (0.8, 0.7, 0.95)
    rows = [_draft(i + 1, confidence=confidences[i], claim="x" * (i + 1), evidence=f"e{i}", anchored=anchored[i], origin=origins[i]) for i in range(3)]
    r = extraction.merged_sources(spark.createDataFrame(rows, F_DRAFT)).collect()
    rank = {"fastus": 4, "structural": 3, "llm_recall": 1}
    sure, proof, held, told = confidences[0], "e0", anchored[0], [origins[0]]
    for i in (1, 2):
        first = held if held != anchored[i] else max(map(rank.get, told)) >= rank[origins[i]]
        sure = min(1.0, (sure + confidences[i]) / 2 + 0.05) if held and anchored[i] else max(sure, confidences[i])
        proof, held, told = (proof if first else f"e{i}"), held or anchored[i], [*told, origins[i]]
    assert len(r) == 1 and r[0].n_sources == 3 and r[0].generation_origin == "fastus+structural+llm_recall" and r[0].claim == "xxx"
    assert (round(r[0].confidence, 9), r[0].evidence, r[0].anchored) == (round(sure, 9), proof, held)


def test_dedupe_and_redundancy(spark):
    rows = [_draft(1), _draft(2, polarity=False), _draft(3, target="Teo Marr", evidence="other", origin="llm"), _draft(4, subject="Orin", origin="llm"), _draft(5, target=None, evidence=None, origin="llm")]
    d = spark.createDataFrame(rows, F_DRAFT)
    assert sorted(r.id for r in extraction.first_of_equal(d).collect()) == [1, 3, 4, 5]
    assert sorted(r.id for r in extraction.redundant(d.where("generation_origin = 'llm'"), d.where("generation_origin = 'structural'")).collect()) == [3]
    assert sorted(r.id for r in extraction.without_redundant_structural(d).collect()) == [3, 4, 5]


def test_names_and_tokens(spark):
    docs = spark.createDataFrame([(1, "When Mara Venn met Teo, Mara Venn did not speak. It's Straße."), (2, None)], "doc_id long, text string")
    assert [r.name for r in extraction.names(docs).orderBy("place").collect()] == ["Venn", "Teo", "Mara Venn"]
    r = {x.doc_id: x for x in extraction.tokens(docs).collect()}
    assert (r[1].n_tokens, r[1].n_negations, r[2].n_tokens) == (15, 1, 0)


def test_entity_types(spark):
    names = {"Mara Venn": "character", "the beach": "concept", "my mom": "character", "Red Castle": "place", "soldiers": "group", "wolf": "animal", "": "concept", "parka": "object", "stonefield": "place"}
    d = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = {r.name: r.t.entity_type for r in d.select("name", entities.classify(F.col("name"), F.lit(""), F.lit("subject")).alias("t")).collect()}
    assert got == names | {None: "concept"}


def test_names_resolve(spark):
    e = spark.createDataFrame([(1, 7, "Isabella Venn", ["Izzy"]), (2, 7, "Carl Venn", None), (3, 7, "Orin", []), (4, 8, "Mara", None)], "id long, story_id long, canonical_name string, aliases array<string>")
    asked = {"Isabella": 1, "bella": 1, "izzy": 1, "Venn": None, "Orin Vale": 3, "Orin's mother": None, "Mara": None, "": None, None: None, "Carl  VENN": 2}
    m = spark.createDataFrame([(7, n) for n in asked], "story_id long, name string")
    assert {r.name: r.entity_id for r in entities.resolved(m, e).collect()} == asked
    a = spark.createDataFrame([("Mara", ["mara", " M ", "m", "", "Venn"])], "n string, a array<string>").select(entities.merged_aliases(F.col("n"), F.col("a")).alias("a")).first().a
    assert a == ["M", "Venn"]


def test_evidence_spans(spark):
    def locate(*row):
        df = spark.createDataFrame([row], "t string, e string, c string, o string, s string")
        return tuple(df.select(evidence.located(*[F.col(x) for x in "tecos"]).alias("x")).first().x)

    text = "The bell rang twice. Mara  handed the brass key to Teo before dawn. Nobody slept."
    assert locate(text, "Mara handed the brass key", None, None, None)[2] == "Mara  handed the brass key"
    assert locate(text, "Before dawn Mara gave Teo that brass key", "", "Teo", "Mara")[2].startswith("Mara  handed")
    assert locate(text, "Nobody slept. The bell rang twice.", None, None, None)[2] == "Nobody slept."
    assert locate(text, None, None, "dawn", None)[2].strip().startswith("Mara")
    assert locate(text, "Gone.", "", "", "Mara") == (-1, 0, "Gone.")
    assert locate(None, "x", None, None, None) == (-1, 0, "")
    start, length, anchor = locate("word " * 200, "word " * 90, None, None, None)
    assert start == 0 and length <= evidence.SPAN and anchor.strip().endswith("word")


def test_evidence_edges(spark):
    """Words at the limit of a span stay whole, white space and case differ, and marks of patterns are letters like others."""
    long = "Ash " + "x" * 300
    rows = [
        ("Teo  saw (the) \\\\E sea.\nIt was cold.", "teo saw (THE) \\\\E sea", (0, 22)),
        (long, long, (0, 4)),
        ("y" * 300, "y" * 300, (0, 240)),
        ("It ends so.\nBrass.", "Brass", (12, 6)),
        ("One. Two", "two", (4, 4)),
        ("a", " ", (-1, 0)),
    ]
    df = spark.createDataFrame([(i, t, q) for i, (t, q, _) in enumerate(rows)], "i long, t string, q string")
    nothing = F.lit(None).cast("string")
    got = {r.i: (r.x.start, r.x.length) for r in df.select("i", evidence.located(F.col("t"), F.col("q"), nothing, nothing, nothing).alias("x")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}
    strict = df.select("i", evidence.anchored_strictly(F.col("t"), F.col("q"), nothing).alias("x")).collect()
    assert {r.i: r.x for r in strict} == {0: False, 1: True, 2: True, 3: True, 4: True, 5: False}


def _claim(i, scene=1, s=11, p="trusts", o=12, polarity=True, told=None, status="approved", until=None, story=1):
    return (i, story, scene, i, s, p, o, "relationship_state", polarity, told or f"told {i}", status, 0.7, until)


@pytest.mark.parametrize(
    "stored, new, expected",
    [
        ([_claim(1)], [_claim(101, polarity=False)], {1: ("kept", 1), 101: ("inserted", 1)}),
        ([_claim(1)], [_claim(101), _claim(102)], {1: ("reinforced", 2)}),
        ([_claim(1)], [_claim(101, o=13)], {1: ("closed", 1), 101: ("inserted", 1)}),
        ([_claim(1, scene=2)], [_claim(101)], {1: ("kept", 1), 101: ("suppressed", 1)}),
        ([_claim(1, status="rejected")], [_claim(101)], {1: ("reinforced", 2)}),
        ([_claim(1, p="is")], [_claim(101, p="is", o=13)], {1: ("kept", 1), 101: ("inserted", 1)}),
        ([_claim(1, told="“Same words.”")], [_claim(101, o=13, told="same words.")], {1: ("reinforced", 2)}),
        ([], [_claim(101, o=None), _claim(102, o=None)], {101: ("inserted", 2)}),
        ([], [], {}),
    ],
)
def test_ordered_merge(spark, stored, new, expected):
    out = merge.merged(spark.createDataFrame(stored, F_CLAIM), spark.createDataFrame(new, F_CLAIM)).collect()
    assert {r.id: (r.action, r.claim_version) for r in out} == expected
    assert all((r.valid_until_scene == 1) == (r.action == "closed") for r in out)
    assert all(r.status == "rejected" for r in out if stored and r.id == 1 and stored[0][10] == "rejected")


def test_editor(spark):
    one = spark.range(1).select(editor.spliced(F.lit("abcdef"), F.lit(2), F.lit(2), F.lit("XYZ")).alias("a"), editor.spliced(F.lit("abc"), F.lit(9), F.lit(5), F.lit("!")).alias("b"), editor.confidence_label(F.lit(0.655)).alias("c"), editor.resolution(F.lit("odd")).alias("d")).first()
    assert (one.a, one.b, one.c, one.d) == ("abXYZef", "abc!", "○ 66%", "open")
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 10), (2, 3, 0)], "doc_id long, start long, length long")
    assert [(r.start, r.end, r.depth) for r in editor.segments(spans).orderBy("start").collect()] == [(0, 5, 1), (5, 10, 2), (10, 15, 1)]
