"""What an editor shows: issues of writing, edits, buckets, labels and the graph's layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spliced(text: Column, start: Column, length: Column, new: Column) -> Column:
    """text with a span replaced; start (from 0) and length are held inside the text."""
    n = F.length(text)
    at = F.greatest(F.lit(0), F.least(start, n))
    end = F.greatest(at, F.least(at + length, n))
    return F.concat(F.substring(text, F.lit(1), at), new, F.substring(text, end + 1, n))


def after_edit(issues: DataFrame, edits: DataFrame) -> DataFrame:
    """Issues of each text after one edit of it (doc_id, at, removed, added): those it touches go, later ones move."""
    c = F.col
    x = issues.join(edits, "doc_id", "left")
    end = c("at") + c("removed")
    touched = (c("start") < end) & (c("start") + c("length") > c("at"))
    moved = F.when(c("start") >= end, c("start") + c("added") - c("removed")).otherwise(c("start"))
    return x.where(~F.coalesce(touched, F.lit(False))).select("doc_id", "issue_id", F.coalesce(moved, c("start")).alias("start"), "length")


def issue_at(issues: DataFrame, cursors: DataFrame) -> DataFrame:
    """The shortest issue around each cursor (doc_id, offset), of equal ones the first; cursors outside all have none."""
    c = F.col
    inside = cursors.join(issues, (issues["doc_id"] == cursors["doc_id"]) & (c("offset") >= c("start")) & (c("offset") < c("start") + c("length")))
    best = F.min(F.struct("length", "issue_id"))
    return inside.groupBy(cursors["doc_id"], c("offset")).agg(best.alias("b")).select("doc_id", "offset", c("b.issue_id").alias("issue_id"))


def fingerprint(rule: Column, message: Column, matched: Column) -> Column:
    """What an issue of writing is known by wherever it stands: its rule, the matched words and the message, these two trimmed and in lower case."""
    told = [F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (matched, message)]
    return F.concat_ws("|", F.coalesce(rule, F.lit("")), *told)


def undismissed(issues: DataFrame, dismissed: DataFrame) -> DataFrame:
    """issues (doc_id, fingerprint, ...) but for those that a text's writer has dismissed."""
    return issues.join(dismissed.select("doc_id", "fingerprint"), ["doc_id", "fingerprint"], "left_anti")


def segments(spans: DataFrame) -> DataFrame:
    """Texts cut at all edges of their spans (doc_id, start, length): each piece that some span covers, with how many do.

    A sweep over edges: +1 where a span starts, -1 where it ends, summed in order; no span meets another."""
    edges = spans.where("length > 0").select("doc_id", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("start") + F.col("length")).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    w = Window.partitionBy("doc_id").orderBy("at")
    x = edges.groupBy("doc_id", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    x = x.select("doc_id", F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("d").over(w).alias("depth"))
    return x.where("depth > 0").select("doc_id", "start", "end", "depth")


def labelled_segments(spans: DataFrame, texts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Texts (doc_id, length) cut at all edges of their spans (doc_id, start, length, kind): start, end, the kinds that cover the piece, and the topmost.

    kinds: those that are shown, topmost first; spans of others, or without length, cut nothing. Spans are clipped to their text. Pieces
    tile each text that has a length. One sort of edges a text carries a count for each kind from edge to edge; no span meets another.
    """
    c = F.col
    clipped = spans.where(c("kind").isin(*kinds)).join(texts.select("doc_id", c("length").alias("n")), "doc_id")
    start, end = F.greatest("start", F.lit(0)), F.least(c("start") + c("length"), c("n"))
    clipped = clipped.select("doc_id", "kind", start.cast("long").alias("a"), end.cast("long").alias("b")).where("a < b")
    edge = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    edges = clipped.select("doc_id", "kind", F.explode(F.array(edge(c("a"), 1), edge(c("b"), -1))).alias("e")).select("doc_id", "kind", "e.at", "e.d")
    ends = texts.where("length > 0").select("doc_id", F.lit(None).cast("string").alias("kind"), F.explode(F.array(F.lit(0).cast("long"), c("length").cast("long"))).alias("at"), F.lit(0).alias("d"))
    steps = edges.unionByName(ends).groupBy("doc_id", "at").agg(*[F.sum(F.when(c("kind") == k, c("d")).otherwise(0)).alias(f"_{i}") for i, k in enumerate(kinds)])
    w = Window.partitionBy("doc_id").orderBy("at")
    live = F.array_compact(F.array(*[F.when(F.sum(f"_{i}").over(w) > 0, F.lit(k)) for i, k in enumerate(kinds)]))
    x = steps.select("doc_id", c("at").alias("start"), F.lead("at").over(w).alias("end"), live.alias("kinds"))
    return x.where("end is not null").select("doc_id", "start", "end", "kinds", F.get("kinds", F.lit(0)).alias("top"))


def confidence_label(confidence: Column) -> Column:
    mark = F.when(confidence >= 0.9, "✓").when(confidence >= 0.65, "○").otherwise("⚠")
    return F.concat(mark, F.lit(" "), F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%"))


def resolution(status: Column) -> Column:
    """open, fixed or rejected; anything else is open."""
    return F.when(status.isin("fixed", "rejected"), status).otherwise("open")


def circle(nodes: DataFrame, radius: float = 220.0) -> DataFrame:
    """Nodes of each story on a circle from the top, by importance, then label and id; a single one stands in the middle."""
    w = Window.partitionBy("story_id")
    order = w.orderBy(F.desc("importance_score"), F.lower("label"), "entity_id")
    angle = 2 * F.pi() * (F.row_number().over(order) - 1) / F.count("*").over(w) - F.pi() / 2
    return nodes.withColumns({"a": angle, "r": F.when(F.count("*").over(w) > 1, F.lit(radius)).otherwise(0.0)}).select("story_id", "entity_id", F.round(F.col("r") * F.cos("a"), 2).alias("x"), F.round(F.col("r") * F.sin("a"), 2).alias("y"))


def origins_told(claims: DataFrame, by: str = "scene_id") -> DataFrame:
    """Claims by origin as one line, most first, then by name."""
    n = claims.groupBy(by, "generation_origin").agg(F.count("*").alias("n"))
    told = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "generation_origin"))), lambda x: F.concat(x["generation_origin"], F.lit(": "), (-x["m"]).cast("string")))
    return n.groupBy(by).agg(F.array_join(told, ", ").alias("origins"))
