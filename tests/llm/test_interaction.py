"""The filter audit against running every order over the rows in plain Python."""

import random
import re
from collections import Counter
from itertools import permutations

from hedgewise.llm import interaction
from tests.llm.conftest import edge_rows, words

LABELS = "doc_id long, quality int, toxic int, part string"


def plain(rows, labels):
    good = {d for d, q, _, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, _ in labels if t == 1 and d is not None}
    docs = []
    for r in rows:
        doc_id, text, part = r[0], r[1] or "", r[3] or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None
            and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in rows),
        }
        docs.append((part, {f for f, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        left = list(docs)
        for step, f in enumerate(order, 1):
            kept = [d for d in left if f not in d[1]]
            for part in {d[0] for d in docs}:
                own = lambda these, part=part: [d for d in these if d[0] == part]
                gone = [d for d in own(left) if f in d[1]]
                failing = [d for d in own(docs) if f in d[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(own(kept)), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in failing),
                    sum(d[2] for d in gone), sum(d[3] for d in gone), f,
                ]
            left = kept
    return {k: (*v[:6], shapley[k[0], v[6]]) for k, v in out.items()}


def found(docs, labels):
    return {
        (r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
        for r in interaction.audited(docs, labels).collect()
    }


def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(120):
        w = words(rng, rng.choice([3, 199, 200, 260]), rng.choice(["abcdefgh", "ab", "abcdefghXYZ"]))
        if rng.random() < 0.2:
            w = w[:60] * 4
        text = rng.choice([" ", "\n", "  "]).join(w) + rng.choice(["", "", "", " #", " 5%"])
        rows.append((i, text, "en", rng.choice(["s", "t", None, ""])))
    for i in range(120, 170):  # copies, most of them of one text, across parts
        rows.append((i, rows[7 if rng.random() < 0.7 else rng.randrange(120)][1], "en", rng.choice(["s", "u"])))
    return [(*r, len(r[1]), None, None, None, None) for r in rows]


def test_filter_interaction(spark):
    from tests.llm.conftest import SCHEMA

    rng = random.Random(12)
    rows = corpus() + edge_rows()
    rng.shuffle(rows)
    labels = [(rng.randrange(180), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for _ in range(90)]
    labels += [(None, 1, 1, "x"), (7, 1, 0, None), (7, 0, 1, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(docs, spark.createDataFrame(labels, LABELS)) == plain(rows, labels)


def test_filter_interaction_without_rows(spark, none):
    assert found(none, spark.createDataFrame([], LABELS)) == {}


def test_a_hot_text_is_dealt_over_parts(spark):
    rows = [(i, "same text", "en", "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    combos = {r.bits: r.n for r in interaction.combinations(docs, spark.createDataFrame([], LABELS)).collect()}
    assert combos == {1: 1, 1 | interaction.REPEATED_BIT: 2999}
