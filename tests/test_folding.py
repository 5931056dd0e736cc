"""Folding of duplicate characters against a plain greedy loop, facts of kin, and Word files."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from factweave.functions import vocab as V
from factweave.operators import folding, kin
from factweave.sources import word

CAST = "id long, story_id long, canonical_name string, entity_type string, aliases array<string>, graph_eligible boolean"


def greedy(rows):
    """A plain loop over the characters in order, each compared with all those kept."""
    norm = lambda s: " ".join((s or "").lower().split())
    words = lambda s: [w for w in norm(s).split() if "'" not in w and len(w) >= 3 and w not in V.NAME_STOPWORDS]
    nick = lambda a, b: a == b or (len(a) >= 4 and b.endswith(a))

    def same(a, b):
        if norm(a) == norm(b):
            return True
        x, y = words(a), words(b)
        if not x or not y:
            return False
        return (x[0] == y[0] and 1 in (len(x), len(y))) or (len(x) == 1 and nick(x[0], y[0])) or (len(y) == 1 and nick(y[0], x[0]))

    out, kept = set(), {}
    rows = [r for r in rows if r[3] == "character" and norm(r[2]) and norm(r[2]) not in V.PLACEHOLDERS]
    for r in sorted(rows, key=lambda r: (-len(words(r[2])), -len(r[2]), r[0])):
        winners = kept.setdefault(r[1], [])
        found = next((w for w in winners if same(w[2], r[2])), None)
        if found is None:
            winners.append(r)
        else:
            out.add((r[1], r[0], found[0]))
    return out


def test_folds_like_a_plain_loop(spark):
    r = random.Random(7)
    names = ["isabella", "Bella", "ella", "sabella", "arabella", "Isabella Swan", "Bella  Swan", "the bella", "the old bella", "Ann", "ann lee", "Ann's", "Jo", "", None, "I", "my", "Mr Lee", "Lee", "Élise", "lise", "Annabella Lee", "the ella"]
    rows = [(i, r.randrange(40), r.choice(names), r.choice(["character"] * 5 + ["place"]), None, None) for i in range(700)]
    got = {tuple(x) for x in folding.folds(spark.createDataFrame(rows, CAST)).collect()}
    assert got == greedy(rows) and len(got) > 100


def test_folded_tables(spark):
    rows = [(1, 1, "Bella", "character", ["B"], True), (2, 1, "Isabella Swan", "character", ["Bells"], False), (3, 1, "isabella  swan", "character", ["bells", ""], None), (4, 1, "Forks", "place", None, None), (5, 2, "Bella", "character", None, False)]
    e = spark.createDataFrame(rows, CAST)
    found = folding.folds(e)
    kept = {x.id: (x.aliases, x.graph_eligible) for x in folding.folded(e, found).collect()}
    assert kept == {3: (["bells", "B", "Bella"], True), 4: ([], None), 5: ([], False)}
    claims = spark.createDataFrame([(1, 1, None, "Bella", "x", "note"), (2, 4, 2, "Forks", "Isabella Swan", "note"), (3, None, None, None, None, None)], "id long, subject_entity_id long, object_entity_id long, subject string, object string, winner string")
    out = {x.id: tuple(x)[1:] for x in folding.repointed(claims, e, found).select("id", "subject_entity_id", "object_entity_id", "subject", "object", "winner").collect()}
    assert out == {1: (3, None, "isabella  swan", "x", "note"), 2: (4, 3, "Forks", "isabella  swan", "note"), 3: (None,) * 5}
    assert folding.folds(e.limit(0)).count() == 0 and folding.folded(e.limit(0), found.limit(0)).count() == 0


def test_kin(spark):
    rows = [(1, "He was not my father. My dad, Phil came!", "Bea"), (2, "My mother spoke. Renée had Phil.", None), (3, None, "Bea"), (4, "", "Bea"), (5, "Charlie knew Billy Black. My mom", " Bea ")]
    out = kin.facts(spark.createDataFrame(rows, "doc_id long, text string, pov string"), pov_col="pov")
    got = {(x.doc_id, x.ord, x.subject, x.predicate, x.target, x.polarity) for x in out.collect()}
    assert got == {
        (1, 0, "Bea", "daughter_of", "Dad", False), (1, 1, "Dad", "father_of", "Bea", False), (1, 2, "Bea", "daughter_of", "Phil", True), (1, 3, "Phil", "father_of", "Bea", True),
        (2, 0, "Renée", "partner_of", "Phil", True),
        (5, 0, "Bea", "daughter_of", "Mom", True), (5, 1, "Mom", "mother_of", "Bea", True), (5, 2, "Charlie", "knows", "Billy Black", True),
    }
    assert kin.facts(spark.createDataFrame([(1, "x")], "doc_id long, text string")).where(F.lit(True)).count() == 0


def test_word_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda text, props="": f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"
    head, item = '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>', "<w:pPr><w:numPr/></w:pPr>"
    body = para("One", head) + para("It began &amp; ended.") + para("a", item) + para("b", item)

    def save(name, xml):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("word/document.xml", xml)
        (tmp_path / name).write_bytes(data.getvalue())

    save("good.docx", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    save("empty.DOCX", f"<w:document {w}><w:body/></w:document>")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error) for r in word.read(spark, str(tmp_path)).collect()}
    assert got == {"good.docx": ("## One\n\nIt began & ended.\n\na\nb", None), "empty.DOCX": (None, word.UNREADABLE), "broken.docx": (None, word.UNREADABLE)}
