"""Mentions, quotes, labels and files: planted cases, nulls, empty tables, and brute force on random texts."""

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import anchors, candidates, chapters, coreference, editor, evidence, folding, labels, review
from factweave.sources import plain

MENTION = "id long, doc_id long, sentence_index long, at long, text string, pov string, extra string"
NAME = "doc_id long, sentence_index long, at long, surface string, entity_id long, text string"
CANDIDATE = "doc_id long, surface string, confidence double, entity_id long, ord long"


def one(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_coreference(spark):
    names = [
        (1, 0, 5, "Charlie", 11, "x"),
        (1, 1, 5, "Renee", 12, None),
        (1, 1, 5, "Alice", None, None),  # at one place with Renee: the last by spelling is taken
        (1, 1, 9, "Orin", 13, None),
        (1, 1, 20, "she", 99, None),
        (1, 1, 21, None, 98, None),
        (2, 0, 0, "Edward", 21, None),
    ]
    asked = [
        (1, 1, 1, 6, "her", None, ""),
        (2, 1, 1, 5, "she", None, ""),  # nothing at the pronoun's own place
        (3, 1, 1, 30, "Him at all", None, ""),
        (4, 1, 4, 0, "they", None, ""),
        (5, 1, 5, 0, "he", None, ""),  # too far back
        (6, 1, 3, 0, "I", "Isolde", ""),
        (7, 1, 3, 0, "my", " ", ""),
        (8, 1, 3, 0, "Dad,", None, ""),
        (9, 1, 3, 0, "RENEE", None, ""),
        (10, 1, 3, 0, "Stranger", None, ""),
        (11, 1, 3, 0, "a door", None, ""),
        (12, 1, 3, 0, None, None, ""),
        (13, 1, 3, 0, "  ", None, ""),
        (14, 3, 0, 9, "he", None, ""),
        (15, 1, 2, 0, "his", None, ""),
    ]
    known = [(1, "Renee", 0.7, 12, 1), (1, "renee", 0.7, 77, 0), (1, "Charlie", 0.9, None, 2)]
    cast = spark.createDataFrame([(1, "dad", "Charlie"), (1, "Dad", "Zed"), (2, "dad", "Edward")], "doc_id long, role string, name string")
    got = coreference.resolved(spark.createDataFrame(asked, MENTION), spark.createDataFrame(names, NAME), spark.createDataFrame(known, CANDIDATE), cast)
    assert {r.id: (r.resolved, r.entity_id, r.confidence, r.method) for r in got.collect()} == {
        1: ("Renee", 12, 0.72, "nearest_entity"),
        2: (None, None, 0.0, "unresolved"),
        3: ("Orin", 13, 0.58, "nearest_entity"),
        4: ("Orin", 13, 0.62, "nearest_entity"),
        5: (None, None, 0.0, "unresolved"),
        6: ("Isolde", None, 0.92, "pov"),
        7: (None, None, 0.0, "unresolved"),
        8: ("Charlie", None, 0.75, "cast"),
        9: ("Renee", 12, 0.7, "registry"),
        10: ("Stranger", None, 0.8, "literal"),
        11: ("a door", None, 0.5, "literal"),
        12: (None, None, 0.0, "unresolved"),
        13: (None, None, 0.0, "unresolved"),
        14: (None, None, 0.0, "unresolved"),
        15: ("Orin", 13, 0.58, "nearest_entity"),
    }
    none = coreference.resolved(spark.createDataFrame([], MENTION), spark.createDataFrame([], NAME), spark.createDataFrame([], CANDIDATE), cast)
    assert none.count() == 0


def test_spans_and_runs(spark):
    rng = random.Random(5)
    spans = [(i, rng.randrange(3), s, s + rng.randrange(6)) for i in range(200) for s in [rng.randrange(40)]]
    cover = [(d, s, s + rng.randrange(4)) for d in (0, 1) for s in rng.sample(range(40), 4)]
    got = coreference.outside(spark.createDataFrame(spans, "id long, doc_id long, start long, end long"), spark.createDataFrame(cover, "doc_id long, start long, end long"))
    want = {i for i, d, s, e in spans if not any(cd == d and cs < e and ce > s for cd, cs, ce in cover)}
    assert {r.id for r in got.collect()} == want
    tokens = [(1, i, x) for i, x in enumerate(["A", "A", None, "A", "B", "B", "", "B"])] + [(2, 0, "B")]
    found = coreference.runs(spark.createDataFrame(tokens, "doc_id long, pos long, label string")).collect()
    assert sorted((r.doc_id, r.first, r["last"], r.label, r.n) for r in found) == [(1, 0, 1, "A", 2), (1, 3, 3, "A", 1), (1, 4, 5, "B", 2), (1, 7, 7, "B", 1), (2, 0, 0, "B", 1)]
    rows = [(1, 0, 3, "Teo", "rule", 0), (1, 0, 3, "teo ", "registry", 1), (1, 0, 3, "TEO", "registry", 2), (1, 0, 3, "Ash", None, 3)]
    best = coreference.one_a_span(spark.createDataFrame(rows, "doc_id long, start long, end long, surface string, source string, ord long")).collect()
    assert sorted(r.ord for r in best) == [1, 3]


def test_nearest_quote(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("aAb ") for _ in range(rng.randrange(30))), "".join(rng.choice("aab") for _ in range(rng.randrange(1, 4))), rng.randrange(-2, 40)) for _ in range(400)]

    def nearest(text, quote, at):
        hits = [i for i in range(len(text)) if text.lower().startswith(quote.lower(), i)]
        return min(((abs(i - max(at, 0)), i, len(quote)) for i in hits), default=None)

    got = one(spark, "t string, q string, p long", rows, anchors.nearest_quote(F.col("t"), F.col("q"), F.col("p")))
    assert [g and (g.start, g.length) for g in got] == [w and w[1:] for w in (nearest(*r) for r in rows)]
    loose = [("x a\n b. A  B", "a b", 9), ("x a.*  b", "A.* b", 0), (None, "a", 0), ("a", None, 0), ("a", "", None), ("a", " ", 0), ("", "a", 3)]
    got = one(spark, "t string, q string, p long", loose, anchors.nearest_quote(F.col("t"), F.col("q"), F.col("p")))
    assert [g and (g.start, g.length) for g in got] == [(8, 4), (2, 6), None, None, None, None, None]


def test_issue_claims(spark):
    claims = [(1, 1, "trusts", "Teo", "Mara", "approved", "told"), (2, 1, "trusts", "Teo", "Mara", "approved", "told"), (3, 1, "lives in", "Stonefield", "Ash", "rejected", ""), (4, 1, "lives in", "Hall", None, "approved", None), (5, 2, "is", None, "X", None, " ")]
    issues = [(1, 1, 2, None), (2, 1, 9, "now 'teo'"), (3, 1, None, "now 'Stonefield'"), (4, 1, None, "Mara and Teo"), (5, 1, None, None), (6, 3, 1, "now 'x'"), (7, 1, None, "now 'the hall'"), (8, 2, 5, None)]
    c = spark.createDataFrame(claims, "id long, scene_id long, predicate string, object string, subject string, status string, evidence_text string")
    i = spark.createDataFrame(issues, "issue_id long, scene_id long, current_claim_id long, message string")
    got = {r.issue_id: r.claim_id for r in anchors.spoken_of(i, c).collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: 1, 5: None, 6: None, 7: 4, 8: 5}


def test_anchored_parts_keep_their_ends(spark):
    """A part of a quote is trimmed of white space alone, wherever it stands in it."""
    row = ("we saw 10 of 101 and left.", "Nothing so. We saw 10 of 101")
    assert one(spark, "t string, e string", [row], evidence.anchored(F.col("t"), F.col("e"), F.lit(None).cast("string"))) == [True]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    steps = [i * 7 % 5 for i in range(n)]
    assert one(spark, "x array<int>", [(steps,)], chapters.running(F.col("x"))) == [[sum(steps[:i]) for i in range(n)]]


def test_long_text_of_sentences(spark):
    text = "Ab c. " * 100_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = chapters.sentences(docs).agg(F.count("*").alias("n"), F.max("start").alias("last"), F.sum("length").alias("chars")).first()
    assert tuple(got) == (100_000, 599_994 - 1, 600_000 - 1)


def test_labels(spark):
    told = one(spark, "o string", [("llm",), ("llm+ fastus",), (None,), ("",), ("odd",), ("odd+manual",)], labels.origin_label(F.col("o")))
    assert told == ["AI (LLM refine)", "AI (LLM refine) + FASTUS grounded", "Unknown", "Unknown", "odd", "odd + Manual"]
    assert one(spark, "t string", [("2024-01-02 15:04:05",), ("nothing",), (None,), ("",)], labels.stamp(F.col("t"))) == ["Jan 2, 03:04 PM", None, None, None]
    assert one(spark, "a string", [('["a", " ", null, "b "]',), ("[",), (None,), ('{"a": 1}',)], F.array_join(review.aliases(F.col("a")), ",")) == ["a,b", "", "", ""]
    assert one(spark, "x array<string>", [(None,), (["a"] * 7,)], F.size(labels.replacements(F.col("x")))) == [0, 5]
    files = [("a.md", None), ("a.DOCX", None), ("a.pdf", "text/plain"), ("a.pdf", None), (None, None), ("md", "application/msword")]
    assert one(spark, "n string, k string", files, labels.is_manuscript(F.col("n"), F.col("k"))) == [True, True, True, False, False, True]
    assert one(spark, "s string, p string, o string", [(None, "x", "y"), ("was he", "x", "y"), ("A", None, ""), ("A", "parent_of", None), ("A", "is", "them all"), ("A", "is", "B")], candidates.reject_reason(*map(F.col, "spo"), F.lit("literal"), F.lit("literal"))) == [
        "missing subject", "auxiliary/fragment subject", "missing object", None, "unresolved pronoun object", None]


def test_headings(spark):
    scenes = spark.createDataFrame([(1, "## A \n## B\nx"), (2, None), (3, "x\nChapter 2 y")], "id long, text string")
    assert [(r.title, r.body, r.stored) for r in review.titled(scenes).orderBy("id").collect()] == [("A", "## B\nx", "A\n\n## B\nx"), (None, "", ""), ("Chapter 2 y", "x", "Chapter 2 y\n\nx")]


def test_narrators(spark):
    claims = spark.createDataFrame([(1, 1, 1, 5, 6, "I", "B", "is", "event", "suggested", "old"), (2, 1, 2, 6, 5, "B", "I", "is", "event", "suggested", "old"), (3, 1, 1, 6, None, "B", None, "is", "event", None, "old")], "id long, story_id long, scene_id long, subject_entity_id long, object_entity_id long, subject string, object string, predicate string, claim_type string, status string, source_hash string")
    entities = spark.createDataFrame([(5, 1, "Narrator"), (6, 1, "B"), (7, 1, "Isolde"), (8, 1, "me")], "id long, story_id long, canonical_name string")
    povs = spark.createDataFrame([(1, "isolde"), (2, "Nobody")], "scene_id long, pov string")
    after, left = folding.narrators_repointed(claims, entities, povs)
    assert sorted((r.id, r.subject_entity_id, r.object_entity_id, r.subject, r.status, r.source_hash == "old") for r in after.collect()) == [(1, 7, 6, "Isolde", "suggested", False), (2, 6, 5, "B", "needs_review", True), (3, 6, None, "B", None, True)]
    assert after.columns == claims.columns and sorted(r.id for r in left.collect()) == [5, 6, 7]


def test_single_node_stands_in_the_middle(spark):
    from factweave.operators import editor

    nodes = spark.createDataFrame([(1, 1, "a", 3.0), (2, 2, "b", 2.0), (2, 3, "c", 1.0)], "story_id long, entity_id long, label string, importance_score double")
    assert sorted((r.entity_id, r.x, r.y) for r in editor.circle(nodes).collect()) == [(1, 0.0, 0.0), (2, 0.0, -220.0), (3, 0.0, 220.0)]


def test_plain_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, text in (("The_old-gate.md", "## A\nx\r\n"), ("deep/a b+c%20.txt", "é"), ("empty.markdown", ""), ("other.pdf", "no")):
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "odd.txt").write_bytes(b"a\xff")
    got = sorted((r.title, r.text) for r in plain.read(spark, str(tmp_path)).collect())
    assert got == [("The old gate", "## A\nx\r\n"), ("a b+c%20", "é"), ("odd", "a\ufffd")]


def test_sentence_at(spark):
    """Offsets in, between, before and behind sentences; blanks, marks at the start, nulls and texts that aren't there."""
    texts = [(1, "...One. Two!  \n Three? "), (2, ""), (3, None), (4, "no mark"), (5, "a. " * 300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = [(i, o) for i, t in texts for o in range(-2, len(t or "") + 3)] + [(1, None), (9, 0)]
    got = {(r.doc_id, r.offset): r.sentence_index for r in chapters.sentence_at(docs, spark.createDataFrame(asked, "doc_id long, offset long")).collect()}
    import re

    want = {}
    for i, t in texts:
        pieces = [(m.start(), m.end(), k) for k, m in enumerate(re.finditer(r"[^.!?]+(?:[.!?]+|$)", t or "")) if m.group().strip()]
        for o in range(-2, len(t or "") + 3):
            want[i, o] = next((k for a, b, k in pieces if a <= o < b), 0)
    assert got == want


def test_labelled_segments(spark):
    """Pieces tile each text; kinds come topmost first; spans outside, of no length or of other kinds cut nothing."""
    import random

    rng, kinds = random.Random(2), ("claim", "grammar", "style")
    spans = [(d, rng.randrange(-5, 45), rng.randrange(-1, 12), rng.choice([*kinds, "other", None])) for d in range(4) for _ in range(15)] + [(9, 0, 5, "claim")]
    texts = [(0, 40), (1, 30), (2, 0), (3, 41), (4, 7)]
    got = editor.labelled_segments(spark.createDataFrame(spans, "doc_id long, start long, length long, kind string"), spark.createDataFrame(texts, "doc_id long, length long"), kinds).collect()
    for d, n in texts:
        mine = sorted((r.start, r.end, r.kinds, r.top) for r in got if r.doc_id == d)
        assert [x for a, b, *_ in mine for x in range(a, b)] == list(range(n))
        for a, b, ks, top in mine:
            for x in range(a, b):
                want = [k for k in kinds if any(s[0] == d and s[3] == k and s[1] <= x < s[1] + s[2] for s in spans)]
                assert ks == want and top == (want[0] if want else None)
    assert {r.doc_id for r in got} == {0, 1, 3, 4}
