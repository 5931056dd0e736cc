"""A story's register of entities: names, in the order they are told, found or added."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .entities import classify, graph_eligible, is_placeholder

_OUT = "story_id long, place long, id long, canonical_name string, entity_type string, place_granularity string, type_confidence double, graph_eligible boolean, aliases array<string>, n_mentions long"


#: Names whose forms are kept in a task, at most: a story tells the same ones again and again.
_NAMES_KEPT = 1 << 16


@lru_cache(_NAMES_KEPT)
def _norm(name: str) -> str:
    return " ".join((name or "").lower().split())


@lru_cache(_NAMES_KEPT)
def _parts(key: str) -> tuple[str, ...]:
    return tuple(w for w in key.split() if "'" not in w and w not in V.NAME_STOPWORDS and len(w) >= 3)


@lru_cache(_NAMES_KEPT)
def _endings(first: str) -> tuple[str, ...]:
    """A given name and its endings of four letters or more."""
    return (first, *(first[i:] for i in range(1, len(first) - 3)))


class Register:
    """One story's entities, and where each key of theirs was first seen; a look-up costs the same however many there are."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.whole: dict[str, int] = {}
        self.given: dict[str, int] = {}
        self.bare: dict[str, list[int]] = {}

    def _know(self, at: int, name: str) -> None:
        key = _norm(name)
        if not key:
            return
        self.whole[key] = min(at, self.whole.get(key, at))
        if parts := _parts(key):
            for end in _endings(parts[0]):
                self.given[end] = min(at, self.given.get(end, at))

    def _bare_of(self, at: int) -> str | None:
        parts = _parts(_norm(self.rows[at]["canonical_name"]))
        return parts[0] if len(parts) == 1 else None

    def _index(self, at: int) -> None:
        row = self.rows[at]
        for name in (row["canonical_name"], *row["aliases"]):
            self._know(at, name)
        bare = self._bare_of(at)
        if bare and at not in self.bare.setdefault(bare, []):
            insort(self.bare[bare], at)

    def find(self, name: str) -> int | None:
        key = _norm(name)
        if key in self.whole:
            return self.whole[key]
        parts = _parts(key)
        if " " not in key:
            return self.given.get(parts[0]) if parts else None
        if len(parts) >= 2:
            return next((at for at in self.bare.get(parts[0], ()) if self._bare_of(at) == parts[0]), None)
        return None

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self._index(len(self.rows) - 1)

    def _rename(self, row: dict, aliases: list[str]) -> None:
        seen, row["aliases"] = {"", _norm(row["canonical_name"])}, []
        for a in aliases:
            if (key := _norm(a)) not in seen:
                seen.add(key)
                row["aliases"].append(a.strip())

    def tell(self, m: dict) -> int:
        """A mention: found and merged, or added. Returns its entity's place."""
        at, name = self.find(m["canonical_name"]), m["canonical_name"]
        if at is None:
            self.rows.append(m | {"aliases": [], "n_mentions": 1})
            self._rename(self.rows[-1], m["aliases"])
            self._index(len(self.rows) - 1)
            return len(self.rows) - 1
        row, kind = self.rows[at], m["entity_type"]
        row["n_mentions"] += 1
        row["type_confidence"] = max(row["type_confidence"] or 0.0, m["type_confidence"])
        if kind == "character":
            row["entity_type"], row["graph_eligible"] = kind, m["graph_eligible"]
        old, before = row["canonical_name"], row["aliases"]
        if len(name) > len(old):
            row["canonical_name"] = name
            self._rename(row, [*row["aliases"], old, *m["aliases"]])
        elif _norm(name) != _norm(old):
            self._rename(row, [*row["aliases"], name, *m["aliases"]])
        elif m["aliases"]:
            self._rename(row, [*row["aliases"], *m["aliases"]])
        told = m["place_granularity"]
        if kind == "place" and told and (not row["place_granularity"] or (row["place_granularity"] == "unknown" and told in ("city", "residence", "institution"))):
            row["place_granularity"] = told
        if row["canonical_name"] != old or row["aliases"] != before:  # else all its keys are known
            self._index(at)
        return at


_ARROW = pa.schema([("story_id", pa.int64()), ("place", pa.int64()), ("id", pa.int64()), ("canonical_name", pa.string()), ("entity_type", pa.string()), ("place_granularity", pa.string()), ("type_confidence", pa.float64()), ("graph_eligible", pa.bool_()), ("aliases", pa.list_(pa.string())), ("n_mentions", pa.int64())])
#: What a mention became: told_ord is null in the rows of entities.
_TOLD = _OUT + ", told_ord long"


def _story(story: int, rows: Iterable[tuple], mentions: bool) -> Iterator[tuple]:
    """The story's entities after all rows and, with `mentions`, before them each mention's: as it was when that was told."""
    register = Register()
    for told, ord_, id_, *fields, sure, eligible, aliases in rows:
        row = dict(zip(("canonical_name", "entity_type", "place_granularity"), fields, strict=True), type_confidence=None if sure is None or sure != sure else sure, graph_eligible=eligible)
        row |= {"id": id_, "aliases": [] if aliases is None else [a for a in aliases if a is not None], "n_mentions": 0}
        if not told:
            register.add(row)
            continue
        at = register.tell(row)
        if mentions:
            yield (*_values(story, at, register.rows[at], []), ord_)
    for at, row in enumerate(register.rows):
        yield (*_values(story, at, row, row["aliases"]), None) if mentions else _values(story, at, row, row["aliases"])


def _values(story: int, at: int, row: dict, aliases: list[str]) -> tuple:
    return story, at, row["id"], row["canonical_name"], row["entity_type"], row["place_granularity"], row["type_confidence"], row["graph_eligible"], aliases, row["n_mentions"]


def _stream(mentions: bool):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stories one after the other, as they come sorted; held are one story's entities, and some results."""
        held: list[tuple] = []
        schema = _ARROW.append(pa.field("told_ord", pa.int64())) if mentions else _ARROW
        frame = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for story, of_story in groupby(rows, key=itemgetter(0)):
            for row in _story(story, (r[1:] for r in of_story), mentions):
                held.append(row)
                if len(held) >= 10_000:
                    yield frame()
                    held = []
        if held:
            yield frame()

    return build


def registered(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each story's entities after its mentions (story_id, ord, name; also entity_type, sentence, evidence, role, aliases, and typed, what classify
    says of them, where there are such columns), told in the order of ord, ties by name; place counts from 0, stored ones first by id, new ones have no id yet.

    A mention is an entity's whole name or alias, a single word that is a given name or its ending, or a longer name of an entity that
    so far is its given name only; else it is added. A longer name becomes the canonical one and the old an alias; the surer type
    counts; only characters change a type. Null, blank and placeholder names (I, narrator) are nobody. Each mention depends on those
    before it, so a story's go through one task as a sorted stream that holds its entities alone, at the cost of a few look-ups each;
    types are found before, in parallel.
    """
    return _ordered(entities, mentions).mapInArrow(_stream(False), _OUT)


def told(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """registered(), and a row for each mention (told_ord is its ord) with its entity's place, name and granularity right after it was told."""
    return _ordered(entities, mentions).mapInArrow(_stream(True), _TOLD)


def _ordered(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Stored entities and mentions, of a story in one partition and in order, with their types."""
    c = F.col
    has = lambda name, kind="string": c(name).cast(kind) if name in mentions.columns else F.lit(None).cast(kind)
    name, said, proof = F.trim("name"), F.coalesce(has("sentence"), F.lit("")), F.coalesce(has("evidence"), F.lit(""))
    m = mentions.where(c("story_id").isNotNull() & (T.norm(c("name")) != "") & ~is_placeholder(c("name")))
    m = m.select("story_id", "ord", name.alias("canonical_name"), said.alias("_said"), proof.alias("_proof"), has("role").alias("_role"), has("entity_type").alias("_kind"), *(["typed"] if "typed" in mentions.columns else []), F.coalesce(has("aliases", "array<string>"), F.array().cast("array<string>")).alias("aliases"))
    found = classify(c("canonical_name"), F.concat_ws(" ", "_said", "_proof"), c("_role"))
    m = m.withColumn("_t", F.coalesce("typed", found) if "typed" in mentions.columns else found)
    kind = F.coalesce("_kind", "_t.entity_type")
    where = F.when(kind == "place", T.place_granularity(c("canonical_name"), F.when(c("_proof") != "", c("_proof")).otherwise(c("_said")), F.lit(None).cast("string")))
    sure = c("_t.type_confidence")
    cols = ["story_id", "told", "ord", "id", "canonical_name", "entity_type", "place_granularity", "type_confidence", "graph_eligible", "aliases"]
    new = m.select("story_id", F.lit(True).alias("told"), c("ord").cast("long").alias("ord"), F.lit(None).cast("long").alias("id"), "canonical_name", kind.alias("entity_type"), where.alias("place_granularity"), sure.alias("type_confidence"), graph_eligible(kind, sure).alias("graph_eligible"), "aliases")
    have = lambda n, default: c(n) if n in entities.columns else default
    old = entities.where(c("story_id").isNotNull()).select("story_id", F.lit(False).alias("told"), c("id").cast("long").alias("ord"), c("id").cast("long").alias("id"), F.coalesce("canonical_name", F.lit("")).alias("canonical_name"), "entity_type", have("place_granularity", F.lit(None).cast("string")).alias("place_granularity"), have("type_confidence", F.lit(None).cast("double")).alias("type_confidence"), have("graph_eligible", F.lit(False)).alias("graph_eligible"), have("aliases", F.array().cast("array<string>")).alias("aliases"))
    both = old.select(*cols).unionByName(new.select(*cols)).withColumn("story_id", c("story_id").cast("long"))
    return both.repartition("story_id").sortWithinPartitions("story_id", "told", "ord", "canonical_name")


def with_narrator(mentions: DataFrame, povs: DataFrame) -> DataFrame:
    """Mentions and, before all of a story's, its narrator (story_id, pov) with the first person as aliases; none where pov is blank."""
    first = F.filter(F.array(F.lit("I"), F.lit("me"), F.lit("myself")), lambda a: F.lower(a) != T.norm(F.col("pov")))
    who = povs.where(T.norm(F.col("pov")) != "").select("story_id", F.lit(-1).cast("long").alias("ord"), F.trim("pov").alias("name"), F.lit("character").alias("entity_type"), first.alias("aliases")).distinct()
    return mentions.unionByName(who, allowMissingColumns=True)
