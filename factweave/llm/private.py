"""Personal data (5) by candidate gradient boosting.

Base rules find the plain formats exactly. High-recall generators propose further, overlapping
spans (spaced or spelled-out addresses, numbers grouped in other ways). Boosted trees score them
by format and context, a threshold calibrated on lines written by hand (`private_lines`) selects, and of
overlapping selected spans the best stays. Base spans always stay. The trees are trained here, from
examples that a seeded generator writes; nothing of the corpus is learnt.

All patterns take time in proportion to the text: they start where a run of their characters
starts, and give none of it back.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches, two
from .decontaminate import replaced
from .private_lines import examples as written

#: The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]")
#: A number's edges: a dot beside it counts as part of a longer number only if a digit stands behind that dot; a sentence's full stop doesn't.
_START, _END = r"(?<![0-9])(?<![0-9]\.)", r"(?![0-9]|\.[0-9])"
#: A base address's runs, told apart once: an ip starts where its digits do.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NAME, _LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++"
#: Candidates of each kind, without regard to their surroundings.
WIDE = (
    ("email", re.compile(_NAME + r" ?(?:@|\(at\)|\[at\]|\{at\}) ?" + _LABEL + r"(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot )" + _LABEL + ")++")),
    ("email", re.compile(_NAME + " at " + _LABEL + "(?: dot " + _LABEL + ")++")),
    ("ip", re.compile(_START + r"[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}" + _END)),
    ("card", re.compile(r"(?<![0-9])[1-9](?:[\x20\-./_]{0,2}[0-9]){11,18}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])(?:[1-9][0-9]{12,18}|[1-9][0-9]{3}(?:[ -][0-9]{4}){3})(?![0-9])")),
    ("phone", re.compile(_START + r"(?:00|\(?[0-9])[\x20().0-9/-]{5,18}[0-9]" + _END)),
    ("phone", re.compile(_START + r"\+?(?:[0-9]{1,2}[ .-])?\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
)
#: One of these stands in every text that has a candidate address.
SPELLED = ("@", " dot ", "(at)", "[at]", "{at}")
#: Words near a candidate that speak for a kind, or against all.
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "ping", "login", "client"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "tarjeta", "karte", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "telefono", "dial"),
}
AGAINST = ("version", "order", "invoice", "isbn", "serial", "id", "no", "item", "sku", "section", "page", "chapter", "build", "release", "figure", "table")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _base_email(text: str) -> list[tuple[int, int]]:
    """As the pattern's matches over the text: each @ takes the name before it, back to the last match, and the labels behind it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1].isascii() and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base rules for each kind; matches that fail a kind's test are dropped and not tried again."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _base_email(text)
    if DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() > 2 * 19:
                continue  # over 19 digits
            digits = _NOT_DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose; spans may overlap."""
    out = []
    has_digit = DIGIT.search(text) is not None
    spelled = any(x in text for x in SPELLED)
    for kind, pattern in WIDE:
        if spelled if kind == "email" else has_digit:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


_WORD = re.compile(r"[a-z-]+")


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a candidate."""
    span = text[a:b]
    digits = _NOT_DIGITS.sub("", span)
    groups = re.findall(r"[0-9]+", span)
    before = _WORD.findall(text[max(0, a - 40) : a].lower())[-4:]
    after = _WORD.findall(text[b : b + 20].lower())[:2]
    sizes = [len(g) for g in groups] or [0]
    marks = {c for c in span if not c.isalnum()}
    near = lambda words: float(any(w.strip("-") in words for w in before + after))
    return [
        float(KINDS.index(kind)),
        float(len(digits)),
        float(len(groups)),
        float(max(sizes)),
        float(min(sizes)),
        float(len(set(sizes)) == 1),
        float(len(marks - {" "})),
        float(span.count(" ")),
        float("(" in span and ")" in span),
        float("." in marks),
        float("-" in marks),
        float("/" in marks),
        float(bool(digits) and luhn(digits)),
        float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(digits[:1] in "3456" and bool(digits)),
        float(digits.startswith("00")),
        float(digits.startswith("0")),
        float(sizes[0]),
        near([w for k, words in CUES.items() if k != kind for w in words]),
        near(CUES[kind]),
        near(AGAINST),
        float("@" in span),
        float(bool(re.search(r"[\[({](?:at|dot)[\])}]", span.lower()))),
        float(len(re.split(r"\W+", span)[-1]) if kind == "email" else 0),
        float(b < len(text) and text[b].isalnum() or a > 0 and text[a - 1].isalnum()),
        float(sum(c.isalpha() for c in span)),
    ]


@dataclass
class Trees:
    """Boosted trees of fixed depth: the split of each inner node by level, and the leaves' steps."""

    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    depth: int
    thresholds: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, edge, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > edge[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2) -> Trees:
    """Gradient boosting of the log loss, Newton steps, splits tried at the features' distinct values."""
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    total, trees = np.full(len(y), start), []
    edges = [np.unique(x[:, j])[:-1] for j in range(x.shape[1])]
    edges = [e if len(e) <= 32 else e[:: len(e) // 32] for e in edges]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p) + 1e-9
        inner = (1 << depth) - 1
        feature, edge, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for i in range(inner):
            mine = np.flatnonzero(node == i)
            best, choice = 1e-6, None
            for j, places in enumerate(edges):
                for e in places if len(mine) else ():
                    right = x[mine, j] > e
                    hr, hl = h[mine][right].sum(), h[mine][~right].sum()
                    if hr < 0.5 or hl < 0.5:
                        continue
                    gr, gl = g[mine][right].sum(), g[mine][~right].sum()
                    gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
                    if gain > best:
                        best, choice = gain, (j, e)
            if choice:
                feature[i], edge[i] = choice
            node[mine] = 2 * i + 1 + (x[mine, feature[i]] > edge[i])
        leaf = np.zeros(inner + 1)
        for i in range(inner + 1):
            mine = node == i + inner
            leaf[i] = -rate * g[mine].sum() / (h[mine].sum() + 1)
        total += leaf[node - inner]
        trees.append((feature, edge, leaf))
    return Trees(start, trees, depth, np.full(len(KINDS), 0.5))


def _example(rng: random.Random) -> str:
    """One line: filler words with a private value, between zero characters, or with one that looks alike."""
    word = lambda: "".join(rng.choice(["an", "er", "in", "on", "th", "re", "ti", "es", "or", "st", "ha", "la", "de"]) for _ in range(rng.randint(1, 4)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + number(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def unlike(n: int) -> str:
        """A number whose check digit is wrong."""
        body = number(n - 1)
        return body + rng.choice([c for c in "0123456789" if not luhn(body + c)])

    def national() -> str:
        area, rest = "0" + number(rng.randint(1, 4)), number(rng.randint(5, 8))
        half = len(rest) // 2
        return rng.choice([f"{area} {rest}", f"{area}/{rest}", f"({area}) {rest}", f"{area}-{rest}", f"{area} {rest[:half]} {rest[half:]}", f"00{rng.randint(1, 9)}{number(1)} {area[1:]} {rest}"])

    kind, beside = rng.choice(("spelled", "ip", "card", "card", "phone", "not", "not", "not")), ""
    cue = rng.choice(CUES[{"spelled": "email"}.get(kind, kind)]) if kind != "not" and rng.random() < 0.6 else word()
    if kind == "spelled":
        at, dot = rng.choice([("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("{at}", "{dot}")])
        value = f"{word()}{rng.choice(['', '.' + word(), number(2)])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'example', 'de', 'fr'])}"
    elif kind == "ip":
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        value = rng.choice(["[.]", " . ", "(.)"]).join(parts)
    elif kind == "card":  # written oddly, or as usual but run together with other digits
        digits, mark = card(), rng.choice([".", "/", "_", "--", "  ", "", " ", "-"])
        value = mark.join(digits[i : i + 4] for i in range(0, 16, 4))
        beside = rng.choice(["\0 \0" + value, f"\0 {number(2)}/{number(2)}", f"\0 {number(3)}", f"\0 {number(2)} {number(2)} {number(3)}"]) if mark in ("", " ", "-") else ""
    elif kind == "phone":
        a, b, c = str(rng.randint(2, 9)) + number(2), number(3), number(4)
        value = rng.choice([f"({a}) {b}-{c}", f"1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"00{rng.randint(1, 9)}{number(1)} {a} {b} {c}", f"({a}){b}-{c}", f"+1 ({a}) {b}-{c}", f"{a}.{b}.{c}"])
        if rng.random() < 0.5:  # a national number is one only beside a word for it
            value, cue = national(), rng.choice(CUES["phone"])
    else:
        value = rng.choice(
            [
                f"{number(4)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
                f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1900, 2030)}",
                f"{number(4)}-{number(4)}",
                f"{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}",
                number(rng.randint(5, 20)),
                unlike(rng.choice([12, 13, 15, 16, 16])),
                f"{unlike(16)} {number(rng.randint(2, 16))}",
                f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
                " ".join(number(rng.randint(1, 4)) for _ in range(rng.randint(3, 6))),
                f"{word()} at {word()} dot {word()}",
                f"{word()} at {word()}.{word()}",
                f"{word()} at {word()} . {word().title()}",
                f"({rng.randint(1900, 2030)}) {rng.randint(1, 99)} {number(3)}",
                f"{number(3)}.{number(3)}.{number(3)}",
                national(),
                national(),
                f"{number(3)}-{number(3)}",
                " ".join([number(rng.randint(1, 3)), *(number(3) for _ in range(rng.randint(1, 3)))]),
                "-".join(str(rng.randint(1850, 2030)) for _ in range(2)),
                f"{rng.randint(1, 9)}/{rng.randint(10, 28)}/{rng.randint(1900, 2030)}",
                f"{rng.randint(300, 999)}.{rng.randint(256, 999)}.{number(3)}.{number(3)}",
                ".".join(number(4) for _ in range(4)),
                rng.choice([".", " . ", "[.]"]).join(str(rng.randint(*rng.choice([(1, 255), (256, 999)]))) for _ in range(3)) + f".{rng.randint(256, 999)}",
            ]
        )
        cue = rng.choice(AGAINST) if rng.random() < 0.5 else word()
    behind = rng.choice(["", "", "", ".", ".", ",", ";", ":", "!", "?", ")", "...", '".'])
    text = " ".join([*(word() for _ in range(rng.randint(1, 6))), cue, rng.choice(["", "", "", '"', "<"]) + "\0" + value + (beside or "\0") + ("\0" if beside.startswith("\0 \0") else "") + behind, *(word() for _ in range(rng.randint(0, 5)))])
    return kind + "\t" + text


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng, x, y = random.Random(seed), [], []
    for _ in range(n):
        kind, text = _example(rng).split("\t", 1)
        parts = text.split("\0")
        edges = np.cumsum([len(part) for part in parts]).tolist()
        text, values = "".join(parts), list(zip(edges[::2], edges[1::2], strict=False))
        for k, s, e in candidates(text):
            x.append(features(text, k, s, e))
            y.append(float(k == {"spelled": "email"}.get(kind, kind) and any(s >= a and e <= b and e - s >= 0.8 * (b - a) for a, b in values)))
    return np.array(x), np.array(y)


def _written() -> tuple[np.ndarray, np.ndarray]:
    """The candidates of the lines by hand, and which are right."""
    x, y = [], []
    for text, values in written():
        for k, s, e in candidates(text):
            x.append(features(text, k, s, e))
            y.append(float(any(k == kind and s >= a and e <= b and e - s >= 0.8 * (b - a) for kind, a, b in values)))
    return np.array(x), np.array(y)


#: Share of right ones that selected candidates must have on the lines by hand, by kind.
PRECISION = 0.995


@functools.cache
def model(examples: int = 5000, seed: int = 5) -> Trees:
    """Trees and, for each kind, the smallest threshold at which what is selected of the lines by hand is right often enough."""
    trees = boost(*_examples(examples, seed))
    x, y = _written()
    p = trees.score(x)
    for k in range(len(KINDS)):
        mine = x[:, 0] == k
        order = np.argsort(-p[mine], kind="stable")
        right = np.cumsum(y[mine][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= PRECISION)
        trees.thresholds[k] = max(0.5, p[mine][order][good[-1]]) if len(good) else 1.1
    return trees


class Taken:
    """Spans of which none overlaps another, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):  # those that overlap become one
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_right(self.ends, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def spans(text: str, trees: Trees) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind's place, end), in order. Added ones overlap no other span, of whatever kind: the likelier is chosen first."""
    base = [(a, k, b) for k, kind in enumerate(KINDS) for a, b in base_spans(text)[kind]] if "@" in text or DIGIT.search(text) else []
    taken = Taken([(a, b) for a, _, b in base])
    proposed = [c for c in dict.fromkeys(candidates(text)) if not taken.meets(c[1], c[2])]
    added: list[tuple[int, int, int]] = []
    if proposed:
        p = trees.score(np.array([features(text, *c) for c in proposed]))
        for q, (kind, a, b) in sorted(zip(-p, proposed, strict=True), key=lambda x: (x[0], x[1][1] - x[1][2], x[1])):  # of equal ones the longest
            k = KINDS.index(kind)
            if -q >= trees.thresholds[k] and not taken.meets(a, b):
                added.append((a, k, b))
                taken.add(a, b)
    return sorted(base), sorted([*base, *added])


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: how many base spans of each kind, their digest, and all spans.

    Offsets are code points. A null text is empty: no spans. Rows stay apart whatever their ids;
    an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model())  # some tens of small trees

    def build(batches: Iterator[pa.RecordBatch]):
        trees = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                text = text.as_py() or ""
                base, found = spans(text, trees)
                counts = [0] * len(KINDS)
                for _, k, _ in base:
                    counts[k] += 1
                for column, x in zip(out, (*counts, hashlib.sha256(_joined(base).encode()).hexdigest() if base else nothing, _joined(found)), strict=True):
                    column.append(x)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], SCHEMA.replace(",", "").split(" ")[::2])

    return two(docs, id_col, text_col).mapInArrow(build, SCHEMA)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """text with each span's characters replaced by its kind in brackets; spans that overlap become the first's."""
    out, last = [], 0
    for a, k, b in found:
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with all spans redacted; n_chars, if there is one, follows the text. Other rows and columns stay as they are."""
    small_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def build(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            new = {}
            for i, text in enumerate(batch.column(names[at])):
                text = text.as_py() or ""
                _, found = spans(text, shared.value)
                if found:
                    new[i] = redact(text, found)
            yield replaced(batch, at, new)

    return docs.mapInArrow(build, docs.schema)


#: The base columns in SQL. Matches are set between two private-use characters, so that their places can be counted.
_FOUND = r"""
m{k} AS (SELECT doc_id, {k} AS k, split_part(piece, '\uE001', 1) AS m, coalesce(sum(length(replace(piece, '\uE001', ''))) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, i
  FROM (SELECT r, doc_id, unnest(p) AS piece, unnest(generate_series(1, len(p))) AS i FROM (SELECT r, doc_id, string_split(regexp_replace(t, '{pattern}', '\uE000\0\uE001', 'g'), '\uE000') AS p FROM d WHERE contains(t, '{sign}') OR '{sign}' = '')) QUALIFY i > 1)
"""


def _base_sql() -> str:
    patterns = zip(KINDS, (EMAIL, IP, CARD, PHONE), ("@", ".", "", "+"), strict=True)
    found = ",".join(_FOUND.replace("{k}", str(k)).replace("{pattern}", "(" + p.pattern.replace(r"\x20", " ") + ")").replace("{sign}", sign) for k, (_, p, sign) in enumerate(patterns))
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), {found},
x AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS n FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)),
good AS (SELECT doc_id, k, a, a + length(m) AS b FROM x WHERE CASE k WHEN 0 THEN true
  WHEN 1 THEN list_max(list_transform(string_split(m, '.'), lambda p: p::HUGEINT)) <= 255
  WHEN 2 THEN length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(generate_series(1, length(n)), lambda i: CASE WHEN i % 2 = 1 THEN substr(n, length(n) + 1 - i, 1)::INTEGER ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(n, length(n) + 1 - i, 1)::INTEGER + 1] END)) % 10 = 0
  ELSE length(n) BETWEEN 9 AND 15 END),
told AS (SELECT doc_id, count(*) FILTER (k = 0) AS e, count(*) FILTER (k = 1) AS i, count(*) FILTER (k = 2) AS c, count(*) FILTER (k = 3) AS p,
  string_agg(({kinds})[k + 1] || ':' || a || ':' || b, ',' ORDER BY a, k) AS s FROM good GROUP BY 1)
SELECT doc_id, coalesce(e, 0)::BIGINT AS n_email, coalesce(i, 0)::BIGINT AS n_ip, coalesce(c, 0)::BIGINT AS n_card, coalesce(p, 0)::BIGINT AS n_phone, sha256(coalesce(s, '')) AS base_sha256
FROM d LEFT JOIN told USING (doc_id)
""".replace("\\uE000", chr(0xE000)).replace("\\uE001", chr(0xE001))


BASE_SQL = _base_sql()


def base_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_private that SQL can express."""
    return op5_private(spark, sf_dir).drop("spans")


def op5_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(read(spark, sf_dir, "documents"))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A stage: personal data gives way to its kind's name. Null texts stay null, each row is taken for itself; an empty table stays empty."""
    return redacted(docs)
