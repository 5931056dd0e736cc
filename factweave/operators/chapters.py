"""Chapters to chunks, sentences and tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

WORDS, OVERLAP, SINGLE, LONG = 1500, 200, 3000, 10000


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *kept: str) -> DataFrame:
    """Texts of up to SINGLE words whole, longer ones as windows of WORDS words that share OVERLAP; kept columns stay."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != "")
    d = docs.select(F.col(id_col).alias("doc_id"), F.trim(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), words.alias("w"), *kept)
    n, step = F.size("w"), WORDS - OVERLAP
    starts = F.filter(F.sequence(F.lit(0), n, F.lit(step)), lambda s: (s == 0) | (s + OVERLAP < n))
    whole = F.array(F.lit(0))
    x = d.select("doc_id", *kept, "text", "w", n.alias("n"), F.posexplode(F.when(n <= SINGLE, whole).otherwise(starts)).alias("chunk_index", "s"))
    part = F.when(F.col("n") <= SINGLE, F.col("text")).otherwise(F.array_join(F.slice("w", F.col("s") + 1, WORDS), " "))
    return x.select("doc_id", *kept, F.col("chunk_index").cast("long").alias("chunk_index"), F.when(F.col("n") <= SINGLE, F.col("n")).otherwise(F.least(F.lit(WORDS), F.col("n") - F.col("s"))).cast("long").alias("n_words"), part.alias("chunk"))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(steps: Column, piece: int = 256) -> Column:
    """The sum before each of an array's numbers.

    Slices of piece numbers are summed alone and then moved by what the slices before hold: a fold copies the array it grows, and
    so none grows beyond a slice, or the number of slices.
    """
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    grown = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)), F.lit(piece)), lambda i: F.aggregate(F.slice(steps, i + 1, piece), none, grown))

    def moved(sums: Column) -> Column:
        bases = F.aggregate(F.transform(sums, lambda s: s["at"]), none, grown)["out"]
        return F.flatten(F.zip_with(sums, bases, lambda s, b: F.transform(s["out"], lambda at: at + b)))

    return _let(slices, moved)


def places(text: Column, pattern: str | Column) -> Column:
    """Where the matches of a pattern start, counted in characters from 0; in time that grows with the text's length alone, nearly."""
    given = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, gaps = F.regexp_extract_all(text, given, F.lit(0)), F.split(text, given, -1)
    both = F.arrays_zip(F.transform(found, F.length).alias("m"), F.slice(F.transform(gaps, F.length), 1, F.size(found)).alias("g"))

    def starts(z: Column) -> Column:
        return F.zip_with(running(F.transform(z, lambda x: x["g"] + x["m"])), z, lambda at, x: at + x["g"])

    return _let(both, starts)


#: Marks put around matches; texts that hold them are searched once for each group instead.
_OPENS, _ENDS = "\x01", "\x02"


def matches(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct<start, all, g1, ...>> of a pattern's matches: where they start, counted in characters from 0, their text and that of the groups asked for.

    The text is searched once: each match is replaced by itself and its groups between marks, and these are cut apart.
    """
    names = [f"g{g}" for g in groups]
    marked = F.regexp_replace(text, pattern, f"{_OPENS}$0{_ENDS}" + "".join(f"${g}{_ENDS}" for g in groups))

    def cut(pieces: Column) -> Column:
        found = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.split(p, _ENDS, -1))
        return _let(found, lambda f: placed(F.length(F.get(pieces, F.lit(0))), f))

    def placed(first: Column, found: Column) -> Column:
        steps = F.transform(found, lambda f: F.length(F.get(f, F.lit(0))) + F.length(F.get(f, F.lit(len(groups) + 1))))
        told = lambda at, f: F.struct(at.alias("start"), *[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(("all", *names))])
        alone = F.transform(found, lambda f: told(first, f))  # mostly there is one match, and nothing to sum
        return F.when(F.size(found) <= 1, alone).otherwise(F.zip_with(running(steps), found, lambda at, f: told(at + first, f)))

    part = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    searched = F.arrays_zip(places(text, pattern).alias("start"), part(0).alias("all"), *[part(g).alias(n) for g, n in zip(groups, names, strict=True)])
    return F.when(text.contains(_OPENS) | text.contains(_ENDS), searched).otherwise(_let(F.split(marked, _OPENS, -1), cut))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_chunks, long): words of each text, the chunks they make, and whether they are over LONG; null texts have none and are one chunk."""
    n = T.word_count(F.col(text_col))
    windows = F.when(n <= SINGLE, 1).otherwise(F.ceil((n - OVERLAP) / (WORDS - OVERLAP)))
    return docs.select(F.col(id_col).alias("doc_id"), n.alias("n_words"), windows.cast("long").alias("n_chunks"), (n > LONG).alias("long"))


def sentence_array(text: Column) -> Column:
    """array<struct<start, sentence>>: pieces between end marks, blank ones among them."""
    pattern = r"[^.!?]+(?:[.!?]+|$)"
    return F.transform(matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["all"].alias("sentence")))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per sentence with its place and offsets; pieces between end marks, blank ones left out."""
    x = docs.select(F.col(id_col).alias("doc_id"), sentence_array(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    y = x.select("doc_id", F.posexplode("s").alias("i", "s")).where(F.trim(F.regexp_replace("s.sentence", r"\s+", " ")) != "")
    return y.select("doc_id", F.col("i").cast("long").alias("sentence_index"), F.col("s.start").cast("long").alias("start"), F.length("s.sentence").cast("long").alias("length"))


def searched(starts: Column, x: Column) -> Column:
    """The place, from 0, of the last of rising starts that isn't above x; -1 if all are. The array is halved, not scanned."""
    none = F.struct(F.lit(-1).alias("low"), (F.size(starts) - 1).alias("high"))

    def halved(a: Column, _: Column) -> Column:
        mid = F.floor((a["low"] + a["high"] + 1) / 2).cast("int")
        above = F.get(starts, mid) > x
        return F.when(a["low"] >= a["high"], a).otherwise(F.struct(F.when(above, a["low"]).otherwise(mid).alias("low"), F.when(above, mid - 1).otherwise(a["high"]).alias("high")))

    return F.when(F.size(starts) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(32)), none, halved)["low"]).otherwise(-1)


def sentence_at(docs: DataFrame, offsets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, offset, sentence_index) of offsets (doc_id, offset): the sentence, as sentences() counts them, that the character stands in; 0 where none is.

    A text is split once for all its offsets, and each is then found by halving its sentences' starts. Offsets of texts that aren't
    there are left out, as are nulls; those before a text or behind it stand in none.
    """
    c = F.col
    asked = offsets.where("offset is not null").groupBy("doc_id").agg(F.collect_set("offset").alias("offsets"))
    x = docs.select(c(id_col).alias("doc_id"), F.coalesce(c(text_col), F.lit("")).alias("text")).join(asked, "doc_id")

    def found(t: Column, at: Column) -> Column:
        i = searched(t["starts"], at)
        s = F.get(t["sentences"], i)
        inside = (i >= 0) & (at < F.get(t["starts"], i) + F.length(s)) & (F.trim(F.regexp_replace(s, r"\s+", " ")) != "")
        return F.struct(at.alias("offset"), F.coalesce(F.when(inside, i), F.lit(0)).cast("long").alias("sentence_index"))

    split = _let(sentence_array(c("text")), lambda a: F.struct(a["start"].alias("starts"), a["sentence"].alias("sentences")))
    every = _let(split, lambda t: F.transform("offsets", lambda at: found(t, at)))
    return x.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*")
