"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: a segment holds the postings of some neighbouring documents, a row per term. Queries never
read the text again, only the rows of the terms they name. A phrase is found from its rarest term: that term's positions,
moved back by its offset in the phrase, are the candidates, and each further term, by rarity, keeps those at which its own
moved positions also stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewise.llm.rows import fresh, without
from hedgewise.llm.textscan import lean, LOWER, SpanHasher, Texts, WORD_ALNUM, slices, spans
from hedgewise.plans import scratch_path, written

#: Words of a window of a test item.
WINDOW = 10
#: A segment ends with the slice of texts that brings it to so many bytes.
SEGMENT_BYTES = 3 << 20
#: Windows that are looked up at once: the test items are worked on in blocks, so what goes to the tasks is bounded.
BLOCK = 100_000

INDEX = pa.schema(
    [
        ("segment", pa.string()),
        ("term", pa.int64()),
        ("n", pa.int64()),
        ("positions", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
    ]
)
INDEX_DDL = "segment string, term long, n long, positions binary, doc_ids array<long>"
HITS = pa.schema(
    [
        ("segment", pa.string()),
        ("doc", pa.int32()),
        ("item", pa.string()),
        ("start", pa.int32()),
        ("size", pa.int32()),
        ("near", pa.bool_()),
    ]
)
HITS_DDL = "segment string, doc int, item string, start int, size int, near boolean"


def terms_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all words, as 64-bit hashes of their bytes in small letters, and the bounds of each text's words."""
    start, end, bounds = spans(texts, WORD_ALNUM[texts.data])
    return SpanHasher(LOWER[texts.data])(start, end).view(np.int64), bounds


def build(docs: DataFrame, path: str) -> DataFrame:
    """Write the index of every word of every text, and return it.

    A segment has a row per term with the term's positions, counted through all texts of the segment, and one row without
    a term that holds where each text begins (and the last one ends) and the texts' doc_ids. Texts are known by segment
    and place, so doc_ids may be null or repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            first = size = 0
            for texts in slices(batch.column(1)):
                found, bounds = terms_of(texts)
                held.append((found, np.diff(bounds)))
                size += len(texts.data)
                if size >= SEGMENT_BYTES or texts.first + len(texts) == batch.num_rows:
                    ids = batch.column(0).slice(first, texts.first + len(texts) - first)
                    yield segment(f"{task}-{made}", held, ids)
                    made, first, size = made + 1, texts.first + len(texts), 0
                    held = []

    def segment(name: str, held: list[tuple[np.ndarray, np.ndarray]], ids: pa.Array) -> pa.RecordBatch:
        terms = np.concatenate([x for x, _ in held])
        starts = np.concatenate([[0], np.cumsum(np.concatenate([x for _, x in held]))]).astype(np.int32).tobytes()
        order = np.argsort(terms, kind="stable").astype(np.int32)
        terms = terms[order]
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])[: len(terms)])
        n = len(first)
        ends = np.append(first, len(terms))
        offsets = np.append(ends * 4, len(terms) * 4 + len(starts)).astype(np.int32)
        data = order.tobytes() + starts
        lists = pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(ids)], pa.int32()), ids)
        return pa.record_batch(
            [
                pa.array([name] * (n + 1)),
                pa.concat_arrays([pa.array(terms[first]), pa.nulls(1, pa.int64())]),
                pa.array(np.append(np.diff(ends), len(ids))),
                pa.Array.from_buffers(pa.binary(), n + 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
                lists,
            ],
            schema=INDEX,
        )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), INDEX_DDL)
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(INDEX_DDL).parquet(path)


def documents(index: DataFrame) -> DataFrame:
    """(segment, doc, doc_id, n_words) of every indexed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, positions, ids in zip(*(batch.column(i) for i in range(3)), strict=True):
                n_words = np.diff(np.frombuffer(positions.as_buffer(), np.int32)).astype(np.int64)
                n = len(n_words)
                yield pa.record_batch(
                    [pa.array([segment.as_py()] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), ids.values, pa.array(n_words)],
                    names=["segment", "doc", "doc_id", "n_words"],
                )

    own = index.where("term IS NULL").select("segment", "positions", "doc_ids")
    return own.mapInArrow(lean(run), "segment string, doc int, doc_id long, n_words long")


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, terms) for every window of ``size`` consecutive words of an item; a shorter item is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                terms, bounds = terms_of(texts)
                names, found = [], []
                for i in range(len(texts)):
                    name = batch.column(0)[texts.first + i].as_py() or ""
                    own = terms[bounds[i] : bounds[i + 1]]
                    for k in range(max(len(own) - size + 1, min(len(own), 1))):
                        names.append(name)
                        found.append(own[k : k + size])
                yield pa.record_batch(
                    [pa.array(names, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=["item", "terms"]
                )

    return items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(lean(run), "item string, terms array<long>"
    )


def _at(positions: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` stand among the sorted positions."""
    place = np.searchsorted(positions, wanted)
    place[place == len(positions)] = 0
    return positions[place] == wanted


def _within(positions: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For which ranges, both ends included, there is a position."""
    return np.searchsorted(positions, low) < np.searchsorted(positions, high, "right")


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (start, end) with touching ones made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Phrases:
    """A block of windows, each with the order in which its terms are looked up: the rarest of the index first."""

    def __init__(self, rows: list, frequency: dict[int, int]):
        self.items = [r.item for r in rows]
        self.terms = [r.terms for r in rows]
        self.order = [sorted(range(len(t)), key=lambda i: frequency.get(t[i], 0)) for t in self.terms]
        self.rarest = np.array([t[o[0]] for t, o in zip(self.terms, self.order, strict=True)], np.int64)

    def search(self, segment: str, lists: dict[int, np.ndarray], starts: np.ndarray, near: int) -> list[tuple]:
        """Rows of HITS: ranges of words of a text that the windows of an item cover, and places of proximity matches."""
        exact: dict[tuple[int, str], list[tuple[int, int]]] = {}
        close: dict[tuple[int, str], list[tuple[int, int]]] = {}
        have = np.array(sorted(lists), np.int64)
        for w in np.flatnonzero(np.isin(self.rarest, have)):
            terms, order, item = self.terms[w], self.order[w], self.items[w]
            if any(t not in lists for t in terms):
                continue
            size, anchor = len(terms), lists[terms[order[0]]]
            at = anchor - order[0]
            for i in order[1:]:
                at = at[_at(lists[terms[i]], at + i)]
                if not len(at):
                    break
            doc = np.searchsorted(starts, at, "right") - 1
            for a, d in zip(at.tolist(), doc.tolist(), strict=True):
                if d >= 0 and a + size <= starts[d + 1]:
                    exact.setdefault((d, item), []).append((a - starts[d], a - starts[d] + size))
            if near:
                doc = np.searchsorted(starts, anchor, "right") - 1
                low = np.maximum(anchor - near, starts[doc])
                high = np.minimum(anchor + near, starts[doc + 1] - 1)
                for i in order[1:]:
                    keep = _within(lists[terms[i]], low, high)
                    low, high, doc = low[keep], high[keep], doc[keep]
                    if not len(low):
                        break
                for a, b, d in zip(low.tolist(), high.tolist(), doc.tolist(), strict=True):
                    close.setdefault((d, item), []).append((a - starts[d], b + 1 - starts[d]))
        return [
            (segment, d, item, int(a), int(b - a), kind)
            for kind, found in ((False, exact), (True, close))
            for (d, item), ranges in found.items()
            for a, b in _merged(ranges)
        ]


def _searcher(phrases: Broadcast, near: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        pairs = zip(rows["term"].to_pylist(), rows["positions"], strict=True)
        lists = {term: np.frombuffer(p.as_buffer(), np.int32) for term, p in pairs}
        starts = lists.pop(None)
        hits = phrases.value.search(rows["segment"][0].as_py(), lists, starts, near) if lists else []
        columns = zip(*hits, strict=True) if hits else [[]] * len(HITS)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, HITS, strict=True)], schema=HITS)

    return run


def matches(index: DataFrame, items: DataFrame, size: int = WINDOW, near: int = 0) -> DataFrame:
    """Where windows of the items occur: (segment, doc, item, start, size, near), ranges of one item and text made one.

    ``near`` false: the words stand there as in the window. True (only if ``near`` is over 0): all words of a window are
    within so many words of an occurrence of its rarest one, in any order. Only rows of terms that some window has are
    read; they move once, to their segment. Windows are worked on in blocks of a bounded number.
    """
    spark = index.sparkSession
    own = written(
        windows_of(items, size).distinct().withColumn("block", F.xxhash64("item", "terms")), "windows"
    )
    blocks = max(1, -(-own.count() // BLOCK))
    found = []
    for block in range(blocks):
        part = own.where(F.pmod("block", F.lit(blocks)) == block)
        terms = F.broadcast(part.select(F.explode("terms").alias("term")).distinct())  # of BLOCK windows at most
        wanted = index.join(terms, "term", "left_semi")
        frequency = {r.term: r.n for r in wanted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        phrases = spark.sparkContext.broadcast(Phrases(part.select("item", "terms").collect(), frequency))
        lists = wanted.unionByName(index.where("term IS NULL")).select("segment", "term", "positions")
        found.append(lists.groupBy("segment").applyInArrow(_searcher(phrases, near), HITS_DDL))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, near: int = 2 * WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    A word is hit if an occurrence of a window covers it; n_near counts the words in reach of a proximity match.
    Null or empty texts have no words and no hits; an item without words has no window; repeated rows of documents are
    searched each for itself; items with one item_id are one item, and a null item_id is an empty name. An empty
    benchmark, or an empty table of documents, gives no hits. Only doc_id, item_id and text are read.
    """
    index = build(docs, scratch_path(docs.sparkSession, "positions"))
    hits = written(matches(index, items, size, near), "hits")
    words = hits.select("segment", "doc", "near", F.explode(F.expr("sequence(start, start + size - 1)")).alias("word"))
    covered = words.distinct().groupBy("segment", "doc").agg(
        F.count_if(~F.col("near")).alias("n_hit"), F.count_if(F.col("near")).alias("n_near")
    )
    named = hits.where("NOT near").groupBy("segment", "doc").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = covered.join(named, ["segment", "doc"], "left")
    return documents(index).join(found, ["segment", "doc"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without an exact occurrence of a window of an item; all columns."""
    text = fresh(docs, "text_hash")
    known = docs.withColumn(text, F.xxhash64("text"))
    found = contamination(known.select(F.col(text).alias("doc_id"), "text"), items, near=0)
    found = written(found.where("contaminated").select(F.col("doc_id").alias(text)).distinct(), "contaminated")
    return without(known, found, [text]).select(docs.columns)
