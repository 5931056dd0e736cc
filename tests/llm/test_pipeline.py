"""The corpus pipeline, stage by stage, against plain Python over a small input with awkward rows and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from factweave.llm import decontaminate, packing, private, quality, tokens
from factweave.llm.words import buffers

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """sf0.001 with nulls, an empty text, exact and near copies, benchmark passages, personal data, and columns that operators use themselves."""
    out = tmp_path_factory.mktemp("sf")
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    long = [d for d in docs if d["text"] and 60 < len(d["text"].split()) < 400]
    rng, top = random.Random(3), max(d["doc_id"] for d in docs) + 1
    passage = next(i["text"] for i in items if i["text"] and len(i["text"].split()) >= 12)
    texts = [None, "", " \n", long[0]["text"], long[1]["text"] + " and on", f"{long[2]['text']} {passage} {long[3]['text']}", passage, long[4]["text"] + " Write to a.b@c.example.org or 10.0.0.1.", long[5]["text"].upper()]
    docs += [{**docs[0], "doc_id": top + i, "text": t, "n_chars": None if t is None else len(t)} for i, t in enumerate(texts)]
    docs += [{**docs[0], "doc_id": None, "text": long[0]["text"]}, {**docs[0], "lang": None, "source": None, "doc_id": top + 50, "text": long[6]["text"][::-1]}]
    rng.shuffle(docs)
    kinds = pq.read_schema(f"{SF}/documents.parquet")
    table = pa.Table.from_pylist(docs, kinds)
    for name in ("score", "kept", "row", "spans", "same"):
        table = table.append_column(name, pa.array([f"{name}{i}" for i in range(len(docs))]))
    pq.write_table(table, out / "documents.parquet")
    for t in ("labels", "benchmark"):
        pq.write_table(pq.read_table(f"{SF}/{t}.parquet"), out / f"{t}.parquet")
    return str(out)


def _lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def _rows(df):
    return [r.asDict() for r in df.collect()]


def _key(r):
    return r["row"]  # one for each row of the input


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given, columns, stages = _rows(docs), docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "private", "packing"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, tables[-1], folder)
        path = f"{folder}/{name}"
        made.write.parquet(path)
        tables.append(spark.read.parquet(path))
        assert name == "packing" or tables[-1].columns == columns

    # Quality: each row by its own text.
    weights = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = []
    for r in given:
        _, slot, value = quality.features(*buffers(pa.array([r["text"]], pa.string())))
        if 1 / (1 + np.exp(-float(weights[slot] @ value))) >= quality.KEEP_AT:
            want.append(r)
    good = _rows(tables[1])
    assert sorted(good, key=_key) == sorted(want, key=_key) and 20 < len(good) < len(given)

    # Near copies: shingle sets of five words, similarity 0.8, the smallest id of each group stays.
    sets = {}
    for r in good:
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(r["text"] or ""))
        sets[_key(r)] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    withid = [r for r in good if r["doc_id"] is not None]
    group = {_key(r): {_key(r)} for r in withid}
    for r in withid:
        for q in withid:
            a, b = sets[_key(r)], sets[_key(q)]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[_key(r)] is not group[_key(q)]:
                whole = group[_key(r)] | group[_key(q)]
                for k in whole:
                    group[k] = whole
    ids = {_key(r): r["doc_id"] for r in withid}
    want = [r for r in good if r["doc_id"] is None or r["doc_id"] == min(ids[k] for k in group[_key(r)])]
    single = _rows(tables[2])
    assert sorted(single, key=_key) == sorted(want, key=_key) and len(single) < len(good)

    # Benchmark: hit words go with the separators behind them; a text that is over 0.8 hit goes.
    windows = defaultdict(set)
    for item in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = WORD.findall(_lower(item.text or ""))
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[min(10, len(w))].add(tuple(w[k : k + 10]))
    want, cut = [], 0
    for r in single:
        found = list(WORD.finditer(_lower(r["text"] or "")))
        low = [m[0] for m in found]
        hit = {i for k, ws in windows.items() for s in range(len(low) - k + 1) if tuple(low[s : s + k]) in ws for i in range(s, s + k)}
        if len(hit) > decontaminate.MAX_COVERAGE * len(found):
            continue
        if hit:
            cut += 1
            text, last = "", 0
            for i, m in enumerate(found):
                if i in hit:
                    text += r["text"][last : m.start()] if i - 1 not in hit else ""
                    last = found[i + 1].start() if i + 1 < len(found) else len(r["text"])
            text += r["text"][last:]
            r = {**r, "text": text, "n_chars": len(text)}
        want.append(r)
    clean = _rows(tables[3])
    assert sorted(clean, key=_key) == sorted(want, key=_key) and cut > 0

    # Personal data: each span becomes its kind.
    want, changed = [], 0
    for r in clean:
        _, spans = private.spans(r["text"] or "", private.model())
        if spans:
            text = r["text"]
            for a, k, b in sorted(spans, reverse=True):
                text = f"{text[:a]}[{private.KINDS[k].upper()}]{text[b:]}"
            overlap = any(x[2] > y[0] for x, y in zip(spans, spans[1:], strict=False))
            changed += 1
            r = {**r, "text": private.redact(r["text"], spans) if overlap else text}
            r["n_chars"] = len(r["text"])
        want.append(r)
    redacted = _rows(tables[4])
    assert sorted(redacted, key=_key) == sorted(want, key=_key) and changed > 0

    # Packing: every id of every text once, gapless sequences of at most 2048.
    encode = tokens.Encoder(tokens.public_path("word_bpe_49k.json")).tokenizer
    want = Counter(zlib.crc32(np.array([*encode.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in redacted)
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in tables[5].collect():
        pieces[r.doc_id, r.doc_tokens].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= packing.SIZE
    got = Counter()
    for (_, n), found in pieces.items():
        ids = b"".join(bytes(r.ids) for r in sorted(found, key=lambda r: r.start))
        assert len(ids) == 2 * n  # no two rows of one id have texts of one length here
        got[zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())] += 1
    assert got == want
    assert stages["packing"] is packing.pack_stage


def test_run(spark, folder):
    """run() gives the last stage's rows, and leaves only that stage's table behind."""
    first = corpus_pipeline.run(spark, folder)
    again = corpus_pipeline.run(spark, folder)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(map(tuple, first.select(columns).collect())) == Counter(map(tuple, again.select(columns).collect())) and first.count() > 0
    assert {p.split("/")[-2] for p in first.inputFiles()} == {"packing"}
