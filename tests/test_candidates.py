"""Phrases, relations and drafts of planted texts, registers against a plain loop, and revalidation on a stream."""

import random

from pyspark.sql import functions as F

from factweave.functions import vocab as V
from factweave.operators import candidates, registry, validate
from factweave.plans import adapters, extract, queries
from factweave.streaming import edits

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, pov string"


def docs(spark, *texts, pov="Isolde"):
    return spark.createDataFrame([(i, t, pov) for i, t in enumerate(texts)], DOC)


def test_phrases(spark):
    got = candidates.phrases(docs(spark, "My mum wasn't here. She took her old house in Stonefield", None, "", "?!")).collect()
    assert sorted((r.start, r.phrase_type, r.phrase, r.head, r.modifier, r.negated, r.sentence_index) for r in got) == [
        (0, "family_phrase", "My mum", "mum", "my", True, 0),
        (0, "possessive_phrase", "My mum wasn", "mum wasn", "my", True, 0),
        (28, "possessive_phrase", "her old house", "old house", "her", False, 1),
        (42, "place_phrase", "in Stonefield", "Stonefield", "in", False, 1),
    ]


def told(df):
    return sorted((r.subject, r.predicate, r.object, r.polarity, r.confidence) for r in df.collect())


def test_relations(spark):
    text = "Orin was not my uncle. I loved dad at all. Charlie came. He hated Mara. I was jealous of Teo. i was jealous of teo."
    assert told(candidates.relations(docs(spark, text), pov_col="pov")) == [
        ("Isolde", "jealous", "Teo", True, 0.70),
        ("Isolde", "loves", "Charlie", True, 0.88),
        ("Orin", "uncle_of", "Isolde", False, 0.78),
    ]
    assert told(candidates.relations(docs(spark, text, pov=None), pov_col="pov")) == []
    assert told(candidates.relations(docs(spark, "Teo feared Mara too", None, ""))) == [("Teo", "fears", "Mara", True, 0.88)]
    assert candidates.relations(docs(spark)).count() == 0


def test_drafts(spark):
    texts = ("Teo was my pa.", "I did not miss Orin.", "I was afraid of Stonefield castle.", "Yesterday Ash hated Mara", "Ash loved justice", "Isolde was my mum.")
    found = candidates.drafts(candidates.relations(docs(spark, *texts), pov_col="pov"))
    assert sorted((r.doc_id, r.claim, r.claim_type, r.status) for r in found.collect()) == [
        (0, "Teo is the father of Isolde.", "relationship_state", "needs_review"),
        (1, "Isolde does not misse Orin.", "relationship_state", "needs_review"),
        (2, "Isolde is afraid with Stonefield castle.", "place_preference", "needs_review"),
        (3, "Yesterday Ash hates Mara.", "timeline_fact", "needs_review"),
        (4, "Ash loves justice.", "character_preference", "needs_review"),
    ]


NORM = lambda s: " ".join((s or "").lower().split())


def plain_find(rows, name):
    """Each stored name in turn."""
    words = lambda k: [w for w in k.split() if "'" not in w and len(w) >= 3 and w not in V.NAME_STOPWORDS]
    nick = lambda a, b: a == b or (len(a) >= 4 and len(b) > len(a) and b.endswith(a))
    names = lambda r: [NORM(n) for n in (r["canonical_name"], *r["aliases"]) if NORM(n)]
    key = NORM(name)
    for at, r in enumerate(rows):
        if key in names(r):
            return at
    mine = words(key)
    for at, r in enumerate(rows):
        if " " not in key:
            if mine and any(nick(mine[0], words(n)[0]) for n in names(r) if words(n)):
                return at
        elif len(mine) >= 2 and words(NORM(r["canonical_name"])) == mine[:1]:
            return at
    return None


def test_register_finds_as_a_plain_loop_does():
    rng = random.Random(4)
    pool = ["Mara", "Venn", "Tamara", "the Isolde", "Isolde", "solde", "old", "Dr. Ash", "Orin's", "of", "Vale"]
    for _ in range(300):
        register = registry.Register()
        for _ in range(25):
            name = " ".join(rng.choice(pool) for _ in range(rng.randint(1, 3)))
            assert register.find(name) == plain_find(register.rows, name)
            aliases = [rng.choice(pool)] if rng.random() < 0.2 else []
            register.tell({"canonical_name": name, "entity_type": "character", "place_granularity": None, "type_confidence": 0.8, "graph_eligible": True, "aliases": aliases})


def test_registered(spark):
    stored = spark.createDataFrame([(7, 1, "Isolde", "concept", None, False)], "id long, story_id long, canonical_name string, entity_type string, place_granularity string, graph_eligible boolean")
    told = [(1, 1, "Isolde Venn"), (1, 2, "solde"), (1, 3, "I"), (1, 4, None), (1, 5, "Red Castle"), (1, 6, "red  castle"), (2, 1, "Isolde"), (1, 7, "narrator"), (None, 8, "Teo")]
    mentions = spark.createDataFrame(told, "story_id long, ord long, name string")
    povs = spark.createDataFrame([(2, " Teo "), (1, None)], "story_id long, pov string")
    got = registry.registered(stored, registry.with_narrator(mentions, povs)).collect()
    assert sorted((r.story_id, r.place, r.id, r.canonical_name, r.entity_type, r.graph_eligible, r.aliases, r.n_mentions) for r in got) == [
        (1, 0, 7, "Isolde Venn", "character", True, ["Isolde", "solde"], 2),
        (1, 1, None, "red  castle", "place", False, [], 2),
        (2, 0, None, "Teo", "character", True, ["I", "me", "myself"], 1),
        (2, 1, None, "Isolde", "character", True, [], 1),
    ]
    assert registry.registered(stored.limit(0), mentions.limit(0)).count() == 0


def test_revalidating(spark, tmp_path):
    made = tmp_path / "edits"
    scenes = adapters.scenes(spark, SF).select(F.col("id").alias("scene_id"))
    prep = lambda: queries._prepared(spark, SF)
    every = validate.issues(prep()).select("scene_id", "current_claim_id", "conflicting_claim_id", "conflict_kind")
    touched = scenes.where("scene_id % 3 = 0")
    for part in (touched.where("scene_id % 2 = 0"), touched):
        part.coalesce(1).write.mode("append").parquet(str(made))
        source = spark.readStream.schema("scene_id long").parquet(str(made))
        edits.revalidating(source, prep, str(tmp_path / "out"), availableNow=True).awaitTermination()
    got = edits.issues_now(spark, str(tmp_path / "out")).select(*every.columns)
    want = every.join(touched, "scene_id", "left_semi")
    assert want.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_all_layers(spark):
    texts = (
        "Teo was my pa. I did not trust Orin.",  # the stance is told by a draft, which is then sure
        "Mara trusts Orin Vale",  # no draft: the fallback rules
        "My mother was late.",
        None,
        "",
        "I feared Mara. I feared Mara. She was my aunt.",
    )
    got = extract.extracted(docs(spark, *texts)).collect()
    assert sorted((r.doc_id, r.subject, r.predicate, r.target, r.polarity, round(r.confidence, 2), r.generation_origin) for r in got) == [
        (0, "Dad", "father_of", "Isolde", True, 0.78, "family"),  # the rules of kin name a pa that the text doesn't name
        (0, "Isolde", "daughter_of", "Dad", True, 0.78, "family"),
        (0, "Isolde", "trusts", "Orin", False, 0.9, "llm"),
        (0, "Teo", "father_of", "Isolde", True, 0.78, "llm"),
        (1, "Mara", "trusts", "Orin Vale", True, 0.9, "heuristic"),
        (2, "Isolde", "daughter_of", "Mom", True, 0.78, "family"),
        (2, "Mom", "mother_of", "Isolde", True, 0.78, "family"),
        (5, "Isolde", "fears", "Mara", True, 0.88, "llm"),
    ]
    assert extract.extracted(docs(spark)).count() == 0


def test_claims_of_a_long_text(spark):
    """A claim in the overlap of two chunks comes once, the first chunk's."""
    words = ["w"] * 3600
    words[1350:1354] = ["I", "feared", "Mara", "."]
    got = extract.extracted(docs(spark, " ".join(words))).collect()
    assert [(r.chunk_index, r.subject, r.predicate, r.target) for r in got] == [(0, "Isolde", "fears", "Mara")]
