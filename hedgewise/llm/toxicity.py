"""A toxicity classifier: hashed word embeddings, several filter widths and max pooling, thresholds by language.

Words enter by hashes of the whole word (two, so that two words rarely share both) and of its first bytes. The network is
trained on a bounded sample of labelled documents and scores every whole text. Thresholds are calibrated on all labelled
documents of a fold that training has not seen, by the language that the text's own function words show; the score is
shifted so that its threshold is one half.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from hedgewise.llm.convnet import ConvNet, Sequences, sigmoid
from hedgewise.llm.rows import fresh
from hedgewise.llm.textscan import give_back, lean, LOWER, SpanHasher, Texts, WORD_ALNUM, mixed, run_totals, slices, spans
from hedgewise.plans import written

#: Labelled documents of each label that are fitted on, at most; those with the least hashes of their ids.
SAMPLE = 3000
#: Longer documents are left out of that sample (never out of the calibration and the scoring).
SAMPLE_WORDS = 3000
#: Bins that calibration counts logits in, for each unit, and the logits at which the bins end.
BINS, LOGIT_MAX = 64, 100
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 12, (1, 2, 3), 16
PREFIXES = (5, 6, 7)
#: Calibration documents with and without the label that a language needs for a threshold of its own, and with how many
#: toxic ones the threshold of all languages counts as much as its own.
LEAST_CALIBRATED, SHARED = 4, 6

# Common words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and that with for this from",
    "de": "der die und das mit den zu ist nicht",
    "fr": "le les des et une est dans pour",
    "es": "el los que y las del por se",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def _hashes(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in data])])
    return SpanHasher(np.frombuffer(b"".join(data), np.uint8))(bounds[:-1], bounds[1:])


_KNOWN = {k: np.sort(_hashes(v.split())) for k, v in FUNCTION_WORDS.items()}


def features(texts: Texts) -> tuple[Sequences, np.ndarray]:
    """Ids of every word of every text, and each text's language as a number in LANGUAGES."""
    start, end, bounds = spans(texts, WORD_ALNUM[texts.data])
    hasher = SpanHasher(LOWER[texts.data])
    words = hasher(start, end)
    kinds = [words, mixed(words + np.uint64(1))]
    for n in PREFIXES:
        cut = np.minimum(start + n, end)
        kinds.append(mixed(hasher(start, cut) + np.uint64(n)))
    ids = np.stack([(k % np.uint64(BUCKETS - 1)).astype(np.int32) + 1 for k in kinds], 1)
    seen = np.stack([run_totals(np.isin(words, known), bounds) for known in _KNOWN.values()], 1)
    language = np.where(seen.max(1) > 0, seen.argmax(1), len(_KNOWN)) if len(texts) else np.zeros(0, int)
    return Sequences(ids, bounds), language


class Classifier:
    """The network with a logit threshold and a slope for each language."""

    def __init__(self, net: ConvNet, thresholds: np.ndarray):
        self.net, self.thresholds = net, thresholds

    def scores(self, texts: Texts) -> np.ndarray:
        seqs, language = features(texts)
        return sigmoid(self.net.logits(seqs) - self.thresholds[language])


def best_threshold(bins: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit with the best F1, in the middle of the gap between the filled bins that holds it."""
    filled, where = np.unique(-bins, return_inverse=True)
    hits = np.cumsum(np.bincount(where, toxic))
    called = hits + np.cumsum(np.bincount(where, clean))
    k = int((2 * hits / (called + max(1, hits[-1]))).argmax())
    low = -filled[k]  # the lower end of the last bin above the threshold
    high = 1 - filled[k + 1] if k + 1 < len(filled) else low
    return float(low + high) / 2 / BINS


def fold(key: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; 0 is held out of all learning, 1 calibrates, the rest trains."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5


def fitted(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learn from at most SAMPLE labelled documents of each label and calibrate on all of fold 1; without both labels every
    score is below one half. Fold 1 is learnt from only if the others lack a label, and they calibrate only if it is empty."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", fold()).where("fold != 0")
    net = _trained_on(docs, known.where("fold != 1")) or _trained_on(docs, known)
    if net is None:
        return _undecided()
    counts = _counted(docs.where(fold() == 1), known, net) or _counted(docs.where(fold() > 1), known, net)
    return Classifier(net, _thresholds(np.array(counts, np.int64)))


def _trained_on(docs: DataFrame, known: DataFrame) -> ConvNet | None:
    """The network, from a bounded sample; none without both labels."""
    part = F.xxhash64("doc_id")
    some = known.where("toxic = 1").orderBy(part, "doc_id").limit(SAMPLE).unionByName(
        known.where("toxic != 1").orderBy(part, "doc_id").limit(SAMPLE)
    )
    some = written(some, "labelled")  # 2 * SAMPLE rows at most, hence broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where("text IS NOT NULL")
    texts = written(texts.where(F.length("text") < 12 * SAMPLE_WORDS), "training")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch.column(0)):
                seqs, _ = features(own)
                cut = seqs.bounds
                ids = [seqs.ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                rows = batch.slice(own.first, len(own))
                yield pa.record_batch(
                    [rows.column(1), rows.column(2), pa.array(ids, pa.binary())], names=["doc_id", "toxic", "ids"]
                )

    rows = texts.select("text", "doc_id", F.col("toxic").cast("int")).mapInArrow(
        lean(run), "doc_id long, toxic int, ids binary"
    )
    # the sample is bounded, so one task trains on it and hands back the weights; the driver never holds the sample
    found = rows.withColumn("sample", F.lit(0)).groupBy("sample").applyInArrow(_trained, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def _trained(rows: pa.Table) -> pa.Table:
    _, order = np.unique(rows["doc_id"].to_numpy(), return_index=True)  # a row of each document, by doc_id
    y = (rows["toxic"].to_numpy()[order] == 1).astype(np.float32)
    sizes = pc.binary_length(rows["ids"]).to_numpy()[order] // (4 * (2 + len(PREFIXES)))
    ids = np.empty((int(sizes.sum()), 2 + len(PREFIXES)), np.int32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for i, a, b in zip(order.tolist(), bounds[:-1], bounds[1:], strict=True):
        ids[a:b] = np.frombuffer(rows["ids"][i].as_buffer(), np.int32).reshape(b - a, -1)
    del rows
    net = None
    if y.min() != y.max():
        net = ConvNet(BUCKETS, DIM, WIDTHS, FILTERS)
        net.fit(Sequences(ids, bounds), y)
    data = pickle.dumps(net)
    del ids, net
    give_back()
    return pa.table({"model": pa.array([data], pa.binary())})


def _undecided() -> Classifier:
    return Classifier(ConvNet(BUCKETS, DIM, WIDTHS, FILTERS), np.full(len(LANGUAGES), 30.0))


def _counted(docs: DataFrame, known: DataFrame, net: ConvNet) -> list[tuple[int, int, int, int]]:
    """(language, bin of the logit, toxic ones, clean ones) over all labelled ones of ``docs``, however long; rows that
    agree in doc_id, language and bin count once."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch.column(0)):
                seqs, language = features(own)
                bins = np.floor(np.clip(shared.value.logits(seqs), -LOGIT_MAX, LOGIT_MAX) * BINS).astype(np.int64)
                doc_id = batch.column(1).slice(own.first, len(own))
                yield pa.record_batch([doc_id, pa.array(language), pa.array(bins)], names=["doc_id", "language", "bin"])

    rows = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("text", F.col("doc_id").cast("long"))
    rows = rows.mapInArrow(lean(run), "doc_id long, language long, bin long").distinct()
    counts = rows.join(known, "doc_id").groupBy("language", "bin").agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1))
    return [tuple(r) for r in counts.collect()]  # a row per language and bin


def _thresholds(counts: np.ndarray) -> np.ndarray:
    """The languages' thresholds from the rows of _counted; where a language has few rows, mostly that of all."""
    if not len(counts):
        return np.zeros(len(LANGUAGES))
    shared = best_threshold(*counts[:, 1:].T)
    thresholds = np.full(len(LANGUAGES), shared)
    for k in range(len(LANGUAGES)):
        own = counts[counts[:, 0] == k, 1:]
        n, clean = own[:, 1].sum(), own[:, 2].sum()
        if min(n, clean) >= LEAST_CALIBRATED:
            thresholds[k] = (n * best_threshold(*own.T) + SHARED * shared) / (n + SHARED)
    return thresholds


def scored(docs: DataFrame, model: Classifier, column: str) -> DataFrame:
    """All columns of ``docs`` with a score between 0 and 1; null and empty texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.scores(own) for own in slices(batch.column(text))]
            found = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, column])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields]).add(column, DoubleType()))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier, learnt from the labelled ones among them, does not call toxic; all columns."""
    score = fresh(docs, "toxic_score")
    return scored(docs, fitted(docs, labels), score).where(F.col(score) < 0.5).select(docs.columns)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score of one half or more) of every document.

    Labels of documents whose crc32(doc_id as text) mod 5 is 0 are never learnt from (a null id is such a one). A label
    without a document, and rows with nulls in labels, are not used; a label given twice counts as the larger. An empty
    table gives no rows. No column but the text decides a score.
    """
    model = fitted(docs, labels)
    rows = scored(docs.select("doc_id", "text"), model, "score")
    return rows.select(
        "doc_id",
        (fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
