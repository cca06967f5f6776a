"""All stages of the corpus pipeline over odd rows and over empty tables."""

import random

import pytest

import corpus_pipeline
from hedgewise.plans import scratch_path
from tests.llm.conftest import edge_rows, words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SETTINGS = ["maxRecordsPerBatch", "maxBytesPerBatch"]


@pytest.fixture
def session(spark):
    names = [f"spark.sql.execution.arrow.{n}" for n in SETTINGS]
    before = {n: spark.conf.get(n) for n in names}
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def stored(spark, documents, labels, benchmark):
    folder = scratch_path(spark, "pipeline-test")
    for name, rows, schema in (
        ("documents", documents, DOCUMENTS),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", benchmark, "item_id string, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def staged(spark, folder):
    """Rows after each stage, each stage written and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = []
    for _, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage-test")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_every_stage_takes_effect_on_odd_rows(session):
    rng = random.Random(9)
    prose = lambda n: " ".join(words(rng, n))
    item = prose(14)
    rows = [r[:5] for r in edge_rows()]
    kept = [(100 + i, prose(60)) for i in range(20)]
    near = kept[0][1].split()
    near[30] = "changed"
    planted = [(200, kept[1][1]), (201, " ".join(near)), (202, f"{prose(20)} {item} {prose(20)}"), (203, f"{prose(20)} password=hunter2secret99 {prose(20)}")]
    rows += [(d, t, "en", "s", len(t)) for d, t in kept + planted]
    folder = stored(session, rows, [], [("b1", item), ("b2", None), ("b3", "")])
    toxic, deduplicated, clean, redacted, packed = staged(session, folder)
    assert all(d.columns == toxic.columns for d in (deduplicated, clean, redacted))
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert toxic.count() == len(rows)  # nothing was labelled
    assert ids(toxic) - ids(deduplicated) >= {200, 201} and {100, 101, 202, 203} <= ids(deduplicated)
    assert ids(deduplicated) - ids(clean) == {202}
    texts = {r.doc_id: r.text for r in redacted.collect()}
    assert "hunter2secret99" not in texts[203] and texts[105] == dict(kept)[105]
    assert ids(packed) == ids(redacted)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 2048
    run = corpus_pipeline.run(session, folder)
    assert run.columns == packed.columns and run.count() == packed.count()


def test_stages_on_empty_tables(session):
    folder = stored(session, [], [], [])
    assert [d.count() for d in staged(session, folder)] == [0] * len(corpus_pipeline.STAGES)
