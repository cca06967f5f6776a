"""Near duplicates, decontamination, licences, quotations and the pipeline: against plain Python, and over odd rows."""

import hashlib
import random
import re

import duckdb

import corpus_pipeline
from hedgewise.llm import decontam, licenses, neardup, quotes
from hedgewise.llm.components import components
from hedgewise.llm.queries import ORACLES
from tests.llm.conftest import edge_rows, words

ROWS = len(edge_rows())
LOWER = {c: c + 32 for c in range(65, 91)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 240)] + [(9, 9)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[max(top(u), top(v))] = min(top(u), top(v))
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: top(x) for x in parent if x != 9 or any(9 in e and e != (9, 9) for e in edges)}


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_rows():
    rng = random.Random(2)
    base, rows = words(rng, 120), []
    for i in range(70):  # a crowded group whose members differ ever more
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 99))
        rows.append((100 + i, " ".join(w)))
    rows += [(i, " ".join(words(rng, rng.randint(1, 60)))) for i in range(60)]
    rows += [(1000 + i, rows[i % 20][1].upper() if i % 2 else rows[i][1]) for i in range(40)]
    return rows + [(2000, "one two"), (2001, "ONE  two"), (2002, "two one"), (2003, ""), (2004, None), (2004, None)]


def expected_groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return [(rows[i][0], len(sets[i]), least[top(i)]) for i in range(len(rows))]


def test_near_duplicates_are_those_of_all_pairs(spark):
    rows = near_rows()
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(expected_groups(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_one_row_of_each_group_stays(edge, none):
    kept = neardup.deduplicated(edge)
    assert kept.columns == edge.columns
    # two rows and another id share a text, which stays once; five rows have no words
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted([1, 2, 3, 4, 0, 0, 5])
    assert neardup.deduplicated(none).count() == 0


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def test_windows_are_found_where_they_stand(spark):
    rng = random.Random(3)
    vocabulary = words(rng, 40, "ab")
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(50, None), (51, "..."), (3, "aa bb"), (None, "qq rr ss")]
    docs = []
    for i in range(80):
        w = rng.choices(vocabulary, k=rng.randint(0, 40))
        if i % 2:
            item = alnum(rng.choice(items)[1])
            w[5:5] = item[rng.randint(0, 3) :]
        docs.append((i if i % 9 else None, (", " if i % 3 else "  ").join(w).upper()))
    docs += [(200, "aa"), (201, "bb aa bb"), (202, "qq rr ss")]
    windows = {}
    for item, text in items:
        w = alnum(text)
        for k in range(max(len(w) - 9, min(len(w), 1))):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if item is None else str(item))
    want = []
    for doc, text in docs:
        w, hit, names = alnum(text), set(), set()
        for window, its in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    names |= its
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want.append((doc or 0, len(w), len(hit), len(names), digest, bool(hit)))
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    found = [(r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(*frames).collect()]
    assert sorted(found) == sorted(want)


def test_proximity(spark):
    item = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = [(1, "x gamma y alpha delta z beta x"), (2, "alpha beta gamma delta"), (3, "alpha " + "x " * 50 + "beta gamma delta")]
    found = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), item, near=6)
    assert {r.doc_id: (r.n_hit, r.n_near > 0) for r in found.collect()} == {1: (0, True), 2: (4, True), 3: (0, False)}


def test_decontamination_edges(spark, edge, none):
    items = spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string")
    assert decontam.contamination(edge, items).where("contaminated").count() == 3
    kept = decontam.clean(edge, items)
    assert kept.columns == edge.columns and kept.count() == ROWS - 3
    assert decontam.clean(edge, items.limit(0)).count() == ROWS
    assert decontam.contamination(none, items).count() == 0


def test_licences(spark, edge, none):
    rng = random.Random(4)
    parts = ["MIT", "license", "License,", "apache", "general", "public", "GNU", "x", "é", "-", "Released under the MIT License."]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 20)))) for i in range(200)]
    rows += [(900, "Licensed under CC BY-NC 4.0."), (901, "a licensed cc thing by nc"), (902, "MİT license")]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w, places, labels = alnum(text), [], set()
        for label, phrase in licenses.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = found[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert found[900].labels == "cc-by-nc" and found[900].score == 1 and found[901].labels == ""
    assert licenses.scan(edge).count() == ROWS and licenses.scan(none).count() == 0


def test_quotations(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow are you?\n\nBye"),
        (1, 1, "a", "> Hello   there.\nFine!"),
        (1, 2, "u", "On Monday X wrote:\n> Fine!\n>> hello there.\nGood"),
        (1, 3, "a", "> > Fine!\n> How are you?\nok"),
        (2, 0, "u", "> Good\nwhat\n> nobody said this"),
        (1, 1, "a", "> Hello   there.\nFine!"),
        (None, None, None, None),
        (3, 0, None, ""),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "2 AS hash")
    found = quotes.linked(frame).collect()
    assert len(found) == len(rows)
    got = {(r.conv_id, r.turn): r for r in found}
    assert {k: (r.body, r.reply_to, r.depth, r.n_passages, r.n_linked) for k, r in got.items() if k[0] == 1} == {
        (1, 0): (rows[0][3], None, 0, 0, 0),
        (1, 1): ("Fine!", 0, 1, 1, 1),
        (1, 2): ("Good", 1, 2, 2, 2),
        (1, 3): ("ok", 0, 1, 2, 2),
    }
    assert got[1, 2].reply_path == "0000000000/0000000001/0000000002"
    other = got[2, 0]
    assert (other.body, other.reply_to, other.source_conv, other.source_turn, other.n_passages, other.n_linked) == ("what", None, 1, 2, 2, 1)
    assert got[None, None].body is None
    assert quotes.linked(frame.limit(0)).count() == 0


def test_quotations_match_their_sql(spark):
    rng = random.Random(8)
    said = ["good day", "What  now?", "a b c", "x"]
    rows = []
    for conv in range(6):
        for turn in range(7):
            lines = [("> " * rng.randint(0, 3) + rng.choice(said)) for _ in range(rng.randint(1, 5))]
            rows.append((conv, turn, rng.choice(["u", None]), rng.choice(["\n", "\n\n"]).join(lines)))
    rows += [(0, 0, "u", None), (None, 1, "u", "> x"), rows[3], rows[3]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    db = duckdb.connect()
    db.register("conversations", frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    plan = db.sql(ORACLES["op4_quotation_links"])
    found = quotes.linked(frame)
    assert set(plan.columns) == set(found.columns)
    assert sorted(map(str, plan.fetchall())) == sorted(str(tuple(r)) for r in found.select(*plan.columns).collect())


def test_the_pipeline_drops_pairs_between_80_and_85_percent(spark):
    rng = random.Random(12)
    rows = []
    for i in range(40):
        w = words(rng, 204)
        rows.append((2 * i, " ".join(w)))
        for k in rng.choice([(60, 120), (50, 100, 150), (40, 90, 140, 190)]):
            w[k] = f"new{i}x{k}"
        rows.append((2 * i + 1, " ".join(w)))
    between = set()
    for i in range(40):
        a, b = shingles(rows[2 * i][1]), shingles(rows[2 * i + 1][1])
        if 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b):
            between.add(2 * i + 1)
    assert len(between) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {2 * i for i in range(40)} and neardup.deduplicated(docs).where("doc_id % 2 = 1").count() == len(between)


def test_bands_follow_from_the_similarity():
    for percent in (50, 80, 85, 95):
        n = neardup.band_count(percent)
        assert (1 - (percent / 100) ** neardup.ROWS) ** n <= neardup.MISS
    assert neardup.band_count(85) == 25


def test_every_licence_of_a_file_and_every_place_counts(spark):
    rng = random.Random(13)
    bsd, sa, nc = (next(t for label, t, _ in licenses.TEMPLATES if label == k) for k in ("bsd", "cc-by-sa", "cc-by-nc"))
    rows = [(0, f"{bsd} and the text is {sa}"), (1, "see cc by nc " + " ".join(words(rng, 50)) + f" {nc}")]
    for i in range(2, 120):  # passages with words replaced, among others and partial mentions
        said = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(licenses.TEMPLATES)[1].split()
            for k in rng.sample(range(len(w)), int(rng.random() * 0.55 * len(w))):
                w[k] = rng.choice(["x", *licenses.VOCABULARY])
            said += words(rng, rng.randint(0, 5)) + w[rng.choice([0, 0, 1, 3]) :]
        rows.append((i, " ".join(said)))
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w, labels, score = alnum(text), set(), 0
        for label, passage, phrases in licenses.TEMPLATES:
            p = passage.split()
            share = max(
                sum(0 <= s + k < len(w) and w[s + k] == x for k, x in enumerate(p)) / len(p) for s in range(-len(p), len(w))
            )
            if share >= licenses.AGREE and all(f" {x} " in f" {' '.join(w)} " for x in phrases):
                labels.add(label)
                score = max(score, share)
        base = set(found[i].base_labels.split(",")) - {""}
        assert set(found[i].labels.split(",")) - {""} == labels | base and abs(found[i].score - score) < 1e-9
    assert found[0].labels == "bsd,cc-by-sa" and found[1].labels == "cc-by-nc"
