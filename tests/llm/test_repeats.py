"""Exact repeats against a plain set of windows."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from hedgewise.llm import repeats
from hedgewise.llm.repeats import LENGTH
from tests.llm.conftest import edge_rows, words


def plain(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + LENGTH] for _, b in data for i in range(len(b) - LENGTH + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            if seen[b[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs, batches=repeats.BATCHES):
    return sorted((tuple(r) for r in repeats.without_repeats(docs, batches).collect()), key=str)


def corpus(seed=13):
    rng = random.Random(seed)
    prose = lambda n: " ".join(words(rng, n, "abcdefé"))
    passages = [prose(60)[:n] for n in (399, 400, 401, 430)] + [prose(200), prose(90)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randrange(60)])
            parts += [p[a : a + rng.choice([len(p), 410, 600])], prose(rng.randint(0, 30))]
        rows.append((i, rng.choice(["", " "]).join(parts)))
    rows += [(100, "a" * 399), (101, "a" * 400), (102, "b" * 401), (103, "ab" * 300), (104, "x" * 150 + "ab" * 210)]
    rows += [(105, rows[3][1]), (105, rows[3][1]), (106, rows[4][1][:500]), (107, passages[4] * 3), (None, passages[5])]
    return rows


@pytest.mark.parametrize("batches", [1, 4])
def test_repeats(spark, batches):
    rows = corpus()
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs, batches) == plain(rows)


def test_windows_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    """Cut into pieces, a text has the same windows, each with one seed."""
    rng = random.Random(3)
    text = " ".join(words(rng, 1500)) + "ab" * 700
    batch = pa.record_batch({"k1": pa.array([1], pa.int64()), "k2": pa.array([2], pa.int64()), "text": [text]})

    def windows():
        out = []
        for rows in repeats._first_round(iter([batch])):
            for r in rows.to_pylist():
                out += range(r["seed"] - r["high"], r["seed"] - r["low"] + 1)
        return sorted(out)

    assert windows() == list(range(len(text) - LENGTH + 1))
    monkeypatch.setattr(repeats, "PIECE", 700)
    assert windows() == list(range(len(text) - LENGTH + 1))


def test_repeats_in_pieces(spark, monkeypatch):
    rows = corpus(14)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    rng = random.Random(5)
    text = " ".join(words(rng, 900))
    unlike = [(int(x), int(x) % 20, int(x) % 20 + 150) for x in range(400, 4000, 37)]
    k = pa.array([1], pa.int64())
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("seed", "low", "high")]))
    mixed = pa.array([[dict(zip(("seed", "low", "high"), u, strict=True)) for u in unlike]], kind)
    batch = pa.record_batch({"k1": k, "k2": k, "text": pa.array([text]), "mixed": mixed})
    cut = lambda: sorted(tuple(r.values()) for b in repeats._next_round(25)(iter([batch])) for r in b.to_pylist())
    whole = cut()
    monkeypatch.setattr(repeats, "PIECE", 700)
    assert cut() == whole and len(whole) > len(unlike)
    assert found(docs) == plain(rows)


def test_repeats_edges(spark, edge, none):
    assert found(edge) == plain([(r[0], r[1]) for r in edge_rows()])
    assert found(none) == []


def test_levels_merge_geometrically(spark):
    rows = spark.createDataFrame([(k, k % 7) for k in range(100)], "key long, cover long")
    levels = repeats.SuffixLevels(spark)
    new = [levels.add(rows.where(f"key % 6 = {b}")).count() for b in range(6)]
    assert new == [0] * 6 and [n for n, _ in levels.paths] == [4, 2]
    again = repeats.SuffixLevels(spark, levels.paths)
    hits = {r.key: (r.least, r.most) for r in again.add(spark.createDataFrame([(5, 1), (70, 9), (200, 0)], "key long, cover long")).collect()}
    assert hits == {5: (1, 5), 70: (0, 9)}


def test_joins_leave_the_texts_where_they_are(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    texts = repeats.DifferentTexts(repeats.identified(docs), 0)
    plan = texts.joined(texts.rows().groupBy("k1", "k2").agg({"text": "max"}))._jdf.queryExecution().executedPlan().toString()
    texts.forget()
    assert "Exchange" not in plan
    per_text = docs.selectExpr("doc_id AS k1", "doc_id AS k2")
    texts = repeats.DifferentTexts(repeats.identified(docs), 0)
    plan = texts.joined(per_text)._jdf.queryExecution().executedPlan().toString()
    texts.forget()
    assert plan.count("Exchange hashpartitioning") == 1
