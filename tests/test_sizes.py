"""Plans and work that must not grow faster than the input."""

import pytest

import __spark_entry__ as entry
from factweave.plans import adapters as A

TINY = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ent_folds", "ent_folded", "ent_repointed", "ent_narrators", "ent_narrators_left", "ent_refined_claim_type", "ent_resolved_names", "gra_edges_named", "gra_edges_preview_named", "gra_nodes_named", "gra_nodes_preview_named", "gra_meta_named", "gra_supporting_named", "ui_circle_named"])
def test_tables_of_stories_never_pass_through_the_driver(spark, name):
    """Entities are exploded rows, which Spark takes for one each: at 60 times 0.1 it broadcast millions of them."""
    sent = [line for line in _plan(entry.queries()[name](spark, TINY)).splitlines() if "BroadcastHashJoin" in line or "NestedLoop" in line]
    assert all("l_orderkey" in line for line in sent)  # the adapter's orders, which are read as a file of known size


def test_texts_made_of_few_bytes_are_dealt_over_all_cores(spark):
    """A small file is one task, and its texts were read by it alone."""
    assert A.tales(spark, TINY).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name, rules", [("cnd_relations", 4), ("ext_structural", 5), ("ext_plain", 5)])
def test_only_texts_with_a_match_are_searched_for_its_groups(spark, name, rules):
    """A rule without a match cost a search for each of its groups; now one, which must be tried before them."""
    found = next(line for line in _plan(entry.queries()[name](spark, TINY)).splitlines() if "Generate" in line and "regexp_extract_all" in line)
    assert found.count("CASE WHEN RLIKE") + found.count("CASE WHEN said") + found.count("CASE WHEN t#") >= rules


def test_names_and_places_are_brought_to_normal_form_once(spark):
    """Each rule of a type or place took the name's normal form anew: up to 20 searches of one name."""
    from pyspark.sql import functions as F

    from factweave.functions import text as T
    from factweave.operators import entities as E

    x = spark.createDataFrame([("a", "b")], "name string, said string")
    searches = lambda c: _plan(x.select(c.alias("r"))).count("regexp_replace")
    assert searches(E.classify(F.col("name"), F.col("said"), F.col("said"))["entity_type"]) <= 2  # in the plan's tree and its details
    assert searches(T.place_granularity(F.col("name"), F.col("said"), F.lit(None).cast("string"))) <= 2


def test_normal_forms_of_odd_white_space(spark):
    from pyspark.sql import functions as F

    from factweave.functions import text as T

    odd = ["", " ", "a b", " A  b ", "a\tb", " a b", "a  b\n", "a\x0bb", "\x1ca", "a\r\n", "İx", None]
    x = spark.createDataFrame([(t,) for t in odd], "t string").select(T.norm(F.col("t")).alias("new"), F.trim(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), r"(?U)\s+", " ")).alias("plain"))
    assert all(r.new == r.plain for r in x.collect())


def test_a_told_name_that_changes_nothing_is_not_listed_anew():
    """Each mention listed all names of its entity again."""
    from factweave.operators import registry

    register, listed = registry.Register(), []
    know = register._know
    register._know = lambda at, name: (listed.append(name), know(at, name))
    m = {"canonical_name": "Mara Venn", "entity_type": "character", "place_granularity": None, "type_confidence": 0.9, "graph_eligible": True, "aliases": []}
    for name in ("Mara Venn", "Mara", "Mara", "Mara Venn"):
        register.tell(m | {"canonical_name": name})
    assert listed == ["Mara Venn", "Mara Venn", "Mara"] and register.rows[0]["n_mentions"] == 4


def test_whole_rows_of_a_merge_deal_their_claims_out_once(spark):
    """The lines were dealt out anew for each of six reads, and two joins fetched nothing but confidences: it failed by disk at 60 times 0.1."""
    plan = _plan(entry.queries()["mrg_whole_rows"](spark, TINY))
    assert "l_orderkey" not in plan and "told_ord" not in plan


def test_phrases_deal_out_places_alone(spark):
    """Each token's word and label went through the shuffle, though only places come back."""
    dealt = [line for line in _plan(entry.queries()["arr_phrases"](spark, TINY)).splitlines() if "collect_list" in line]
    assert dealt and not any("text, text#" in line or "dep, dep#" in line for line in dealt)


def test_subtrees_are_grouped_once_from_texts_dealt_over_all_cores(spark):
    """Each token was a row for each place above it, with its word, and these rows were sorted anew: nine times the tokens."""
    df = entry.queries()["arr_subtrees"](spark, TINY)
    plan = _plan(df).split("== Initial Plan ==")[-1]
    assert "root" not in "".join(line for line in plan.splitlines() if "Aggregate" in line or "Generate" in line)
    assert plan.count("Exchange") == 1 and df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_fields_of_answers_are_taken_out_once(spark):
    """Each use of a field searched its item anew, some thirty times an item, and payloads that nobody is sent were written."""
    from pyspark.sql import functions as F

    from factweave.sources import providers as P

    x = spark.createDataFrame([('{"claims": []}',)], "answer string").select(F.explode(P._items(F.col("answer"), "claims", P._REFINED)).alias("item"))
    plan = _plan(x.select(P._words(F.col("item"), "target", "object").alias("t"), P._yes(F.col("item"), "valid").alias("v")))
    assert "$.valid" not in plan and "$.target" not in plan
    told = entry.queries()["jsn_refined"](spark, TINY)
    assert "BroadcastHashJoin" not in _plan(told) and "payload" not in _plan(told)


def test_parts_of_lines_grow_in_number_and_lines_are_dealt_out_once(spark, monkeypatch):
    """The number of parts was fixed, so a task's memory grew with the table; orders were broadcast, and lines dealt out twice."""
    monkeypatch.setattr(A, "PART_ROWS", 100)
    lines, orders = (A._table(spark, TINY, n).count() for n in ("lineitem", "orders"))
    df = entry.queries()["api_scene_claims"](spark, TINY)
    plan = _plan(df).split("== Initial Plan ==")[-1]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "BroadcastExchange" not in plan and len(dealt) == 4
    assert all(f", {-(-orders // 100)})" in line for line in dealt if "o_custkey" in line)
    assert all(f", {-(-lines // 100)})" in line for line in dealt if "o_custkey" not in line)


def test_spans_do_not_ask_whether_claims_stand(spark):
    """Each claim was held against its scene a second time for a flag that nobody reads."""
    assert "stands" not in _plan(entry.queries()["evd_spans"](spark, TINY))


@pytest.mark.parametrize("name", ["val_issues_all", "stm_touched_issues", "api_issue_texts"])
def test_claims_are_dealt_out_once_for_all_that_meets(spark, name):
    """Claims were dealt out anew for each kind of issue, up to four times each, and twice more for what an issue tells: it failed by disk."""
    plan = _plan(entry.queries()[name](spark, TINY)).split("== Initial Plan ==")[-1]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sorted(line.split("hashpartitioning(")[1].split("#")[0] for line in dealt) == ["object_entity_id", "object_entity_id", "story_id"]
    assert "BroadcastExchange" not in plan and "l_orderkey" not in plan


def test_pairs_that_hashes_alone_bring_together_are_none(spark, monkeypatch):
    """Hashes find pairs, keys decide: with one hash for all, the same pairs are found."""
    from pyspark.sql import functions as F

    from factweave.operators import validate

    found = lambda: sorted((r.current_claim_id, r.conflicting_claim_id, r.conflict_kind, r.message) for r in entry.queries()["val_issues_all"](spark, TINY).collect())
    want = found()
    monkeypatch.setattr(validate.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    assert len(want) > 100 and found() == want


def test_matches_of_one_search_are_those_of_a_search_for_each_group(spark):
    """Each group, place and gap of a rule's matches was a search of its own."""
    import random

    from pyspark.sql import functions as F

    from factweave.operators import candidates, chapters, extraction

    rng, words = random.Random(9), "Mara Teo I was my mother not loved trusts ſee the Charlie’s afraid of distaste for . ! \n $1 \\ 𝒳 half-brother is".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 6, 40, 600]))) for _ in range(120)]
    x = spark.createDataFrame([(t,) for t in [*texts, "Mara \x01 loved Teo. I loved \x02 Teo Mara", ""]], "t string")
    rules = [(f"(?iU){p}", [g for g in (w, n, v, o) if g and not isinstance(g, str)]) for p, w, n, v, o, _ in extraction.RULES.values()]
    rules += [(p, sorted({w, v, o} - {0})) for p, w, v, o, *_ in candidates.RELATIONS] + [(r"[^.!?]+(?:[.!?]+|$)", [])]
    for pattern, groups in rules:
        part = lambda g: F.regexp_extract_all("t", F.lit(pattern), F.lit(g))  # noqa: B023, E731
        plain = F.arrays_zip(chapters.places(F.col("t"), pattern).alias("start"), part(0).alias("all"), *[part(g).alias(f"g{g}") for g in groups])
        for r in x.select(chapters.matches(F.col("t"), pattern, *groups).alias("new"), plain.alias("plain")).collect():
            assert [tuple(m) for m in r.new] == [tuple(m) for m in r.plain]


@pytest.mark.parametrize("name", ["ext_structural", "cnd_relations"])
def test_fields_of_found_claims_are_worked_out_once(spark, name):
    """Ends of claims were cleaned anew at each use, some ten times in the filters alone."""
    plan = _plan(entry.queries()[name](spark, TINY)).split("== Initial Plan ==")[-1]
    assert not any("regexp_replace" in line for line in plan.splitlines() if "Filter" in line)


def test_located_claims_bring_their_columns_along(spark):
    """Claims were joined by id to where they stand, so all were dealt out twice more."""
    from factweave.operators import evidence

    claims = spark.createDataFrame([(1, 1, "e", "c", "t", "s", 0.9, "x")], "id long, text_id long, evidence string, claim string, target string, subject string, confidence double, other string")
    told = evidence.grounded(claims, spark.createDataFrame([(1, "e c")], "text_id long, text string"))
    plan = _plan(told).split("== Initial Plan ==")[-1]
    assert sum("Join" in line for line in plan.splitlines()) == 2 and told.first().other == "x"


def test_upgraded_claims_are_read_once(spark):
    """Rows were read and dealt out anew to be joined to what they were resolved to, and each end was typed twice."""
    assert "l_orderkey" not in _plan(entry.queries()["snk_upgraded_claims"](spark, TINY))
