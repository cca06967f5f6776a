"""Byte strings that stand anywhere else in the corpus, by a logarithmic family of sparse suffix arrays.

Every window of LENGTH bytes has a seed: the place in it whose next SEED bytes have the least hash. Equal windows have their
seeds at equal offsets, so two windows can only be equal if the suffixes that begin near their seeds share a long prefix.
The suffixes of a batch of texts, one for each bin of offsets of a seed, are kept in the order of the fingerprint of that
prefix (``SuffixLevels``): a new batch's array is merge-scanned against each level, and levels of equal size merge.

A shared prefix is shorter than a window, so what matches is narrowed: where all suffixes of a group agree on everything
that their windows cover, all of the windows are repeated; otherwise the bins are cut finer and compared again, down to
single windows. Nothing compares pairs, and a group is only ever counted, never gathered.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewise.llm.textscan import SpanHasher, lean, mixed, slices
from hedgewise.plans import keyed_join, scratch_path, written

LENGTH = 400
SEED = 16
#: Offsets in a bin, round by round.
WIDTHS = (200, 25, 5, 1)
#: Batches into which a table is dealt by a hash of its texts.
BATCHES = 4
#: Bytes of text in a bucket of the table of different texts, about.
BUCKET_BYTES = 32 << 20
#: Longer texts are worked on in pieces of so many window starts.
PIECE = 1 << 20
OVERLAP = 2 * LENGTH

ID = ["k1", "k2"]
SUFFIXES = pa.schema([(n, pa.int64()) for n in ("k1", "k2", "seed", "low", "high", "key", "cover")])
SUFFIXES_DDL = ", ".join(f"{n} long" for n in SUFFIXES.names)
_TAGS = mixed(np.arange(1, 5, dtype=np.uint64)) | np.uint64(1)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit fingerprint of the text, under which equal texts are one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns(
        {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text"), "n_bytes": F.octet_length("text").cast("long")}
    )


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each fingerprint in a task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        at = []
        for i, k in enumerate(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)):
            if k not in seen:
                seen.add(k)
                at.append(i)
        yield batch.take(pa.array(at, pa.int64()))


class DifferentTexts:
    """One row for each different text that can hold a window, bucketed by fingerprint: text moves between machines once.

    Copies are dropped inside tasks before the shuffle, so of a text that a third of all rows share each task sends one.
    There are at least as many buckets as a shuffle has partitions: with fewer, joins would shuffle the texts anew.
    """

    def __init__(self, rows: DataFrame, n_bytes: int):
        self.spark = rows.sparkSession
        path = scratch_path(self.spark, "texts")
        self.name = "hedgewise_texts_" + path.rsplit("-", 1)[-1]
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / BUCKET_BYTES))
        texts = rows.where(F.col("n_bytes") >= LENGTH).select(*ID, "text")
        schema = "k1 long, k2 long, text string"
        (
            texts.mapInArrow(lean(_once), schema)
            .repartition(buckets, *ID)
            .mapInArrow(lean(_once), schema)
            .write.bucketBy(buckets, *ID)
            .option("path", path)
            .saveAsTable(self.name)
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def joined(self, per_text: DataFrame) -> DataFrame:
        """The texts with rows of ``per_text``, at most one each: only ``per_text`` is shuffled."""
        return self.rows().join(per_text.hint("shuffle_hash"), ID)

    def forget(self) -> None:
        """Drop the name; the files stay in the scratch folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, bounds, first row, offset of the bytes in their text): several short texts, or a piece of a long one.

    A piece holds OVERLAP more bytes than starts, which is as far as the windows of one seed reach.
    """
    for texts in slices(column, PIECE):
        n = len(texts.data)
        if len(texts) > 1 or n <= PIECE + OVERLAP:
            yield texts.data, texts.bounds, texts.first, 0
            continue
        for at in range(0, n, PIECE):
            data = texts.data[at : at + PIECE + OVERLAP]
            yield data, np.array([0, len(data)]), texts.first, at


def seeds(data: np.ndarray, bounds: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each seed its place and the least and the greatest offset of it in the windows that it leads.

    Windows lie within a text and start before ``last``. Of equal seeds in a window the first leads.
    """
    n, width = len(data), LENGTH - SEED + 1
    none = np.zeros(0, np.int64)
    counts = np.clip(np.minimum(bounds[1:] - LENGTH + 1, last) - bounds[:-1], 0, None)
    if not counts.any():
        return none, none, none
    hasher = SpanHasher(data)
    h = mixed((hasher.sums[SEED:] - hasher.sums[: n - SEED + 1]) * hasher.down[: n - SEED + 1])
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(len(h), dtype=np.uint64)
    whole = -(-len(h) // width) * width
    blocks = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(h)] = h
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.repeat(bounds[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    leads = (np.minimum(behind[starts], ahead[starts + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.flatnonzero(np.r_[True, (leads[1:] != leads[:-1]) | (starts[1:] != starts[:-1] + 1)])
    ends = np.r_[begins[1:], len(starts)] - 1
    at = leads[begins]
    return at, at - starts[ends], at - starts[begins]


def suffixes(
    data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds' offsets cut into bins: (which seed, low, high, key, cover).

    ``key`` is the fingerprint of the suffix that begins with what all windows of a bin share, as long as that is;
    ``cover`` that of all bytes of the seed's own windows in the bin, and of which these are.
    """
    bins = high // width - low // width + 1
    which = np.repeat(np.arange(len(at)), bins)
    number = (low // width)[which] + np.arange(len(which)) - np.repeat(np.cumsum(bins) - bins, bins)
    x, lo, hi = at[which], np.maximum(low[which], number * width), np.minimum(high[which], (number + 1) * width - 1)
    hasher = SpanHasher(data)
    key = hasher(x - number * width, x + LENGTH + 1 - (number + 1) * width)
    cover = hasher(x - hi, x - lo + LENGTH)
    u = lambda a: a.astype(np.uint64)
    key = mixed(key + u(number + 1) * _TAGS[0] + np.array([width], np.uint64) * _TAGS[1])
    cover = mixed(cover + u(lo + 1) * _TAGS[2] + u(hi + 1) * _TAGS[3])
    return which, lo, hi, key, cover


def _rows(k1, k2, seed, low, high, key, cover) -> pa.RecordBatch:
    columns = (k1, k2, seed, low, high, key.view(np.int64), cover.view(np.int64))
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=SUFFIXES)


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2 = (batch.column(k).to_numpy() for k in ID)
        for data, bounds, first, offset in pieces(batch.column("text")):
            last = PIECE if offset or len(data) > PIECE and len(bounds) == 2 else len(data)
            at, low, high = seeds(data, bounds, last)
            if not len(at):
                continue
            which, lo, hi, key, cover = suffixes(data, at, low, high, WIDTHS[0])
            x = at[which]
            text = np.searchsorted(bounds, x, "right") - 1
            yield _rows(k1[first + text], k2[first + text], x - bounds[text] + offset, lo, hi, key, cover)


def _next_round(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in ID)
            owned = batch.column("mixed")
            cuts = owned.offsets.to_numpy().astype(np.int64)
            x, lo, hi = (owned.values.field(n).to_numpy() for n in ("seed", "low", "high"))
            for data, bounds, first, offset in pieces(batch.column("text")):
                own = slice(cuts[first], cuts[first + len(bounds) - 1])
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(cuts[first : first + len(bounds)]))
                at, low, high = x[own], lo[own], hi[own]
                begins = at - high - offset
                if len(bounds) == 2:  # perhaps a piece of a long text: only what starts in it
                    here = (begins >= 0) & (begins < PIECE) if offset or len(data) > PIECE else begins >= 0
                    text, at, low, high = text[here], at[here], low[here], high[here]
                if not len(at):
                    continue
                which, l, h, key, cover = suffixes(data, at - offset + bounds[text], low, high, width)
                yield _rows(k1[first + text[which]], k2[first + text[which]], at[which], l, h, key, cover)

    return run


def counted(suffix_rows: DataFrame) -> DataFrame:
    """A suffix array with equal prefixes as one entry: key, n, and the least and the greatest cover; in order of key."""
    return (
        suffix_rows.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("cover").alias("least"), F.max("cover").alias("most"))
        .sortWithinPartitions("key")
    )


class SuffixLevels:
    """A family of suffix arrays over all batches added so far: level i covers 2^i batches, so there are log2 of them.

    ``paths`` (number of batches, path of the array), newest last, reopens a stored family.
    """

    def __init__(self, spark: SparkSession, paths: list[tuple[int, str]] | None = None):
        self.spark, self.paths = spark, list(paths or [])

    def _stored(self, array: DataFrame) -> str:
        path = scratch_path(self.spark, "suffix-array")
        array.write.parquet(path)
        return path

    def add(self, suffix_rows: DataFrame) -> DataFrame:
        """Add a batch; return key, least, most of its prefixes that occur elsewhere in it or in what was added before."""
        path = self._stored(counted(suffix_rows))
        new = self.spark.read.parquet(path)
        scans = [new.where("n > 1").select("key", "least", "most")]
        for _, older in self.paths:
            level = self.spark.read.parquet(older).toDF("key", "n", "older_least", "older_most")
            met = new.join(level, "key")
            scans.append(met.select("key", F.least("least", "older_least").alias("least"), F.greatest("most", "older_most").alias("most")))
        found = written(reduce(DataFrame.unionByName, scans), "long-matches")
        size = 1
        while self.paths and self.paths[-1][0] == size:
            _, older = self.paths.pop()
            both = self.spark.read.parquet(older).unionByName(self.spark.read.parquet(path))
            merged = both.groupBy("key").agg(
                F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
            )
            path, size = self._stored(merged.sortWithinPartitions("key")), 2 * size
        self.paths.append((size, path))
        return found


def matched(suffix_rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The suffixes whose prefix occurs elsewhere, and whether all of its occurrences cover the same."""
    keys = keys.select("key", (F.col("least") == F.col("most")).alias("alike"))
    return written(keyed_join(suffix_rows, keys, ["key"], "inner").drop("key", "cover"), "matched")


def repeated_spans(texts: DifferentTexts, batches: int = BATCHES) -> DataFrame:
    """k1, k2, start, end: bytes of texts that lie in repeated windows; spans may overlap."""
    rows = written(texts.rows().mapInArrow(lean(_first_round), SUFFIXES_DDL), "suffixes")
    levels = SuffixLevels(texts.spark)
    hits = [levels.add(rows.where(F.pmod("k1", F.lit(batches)) == b)) for b in range(batches)]
    keys = reduce(DataFrame.unionByName, hits).groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    found = matched(rows, keys)
    decided = [found]
    for width in WIDTHS[1:]:
        unlike = found.where(~F.col("alike")).groupBy(*ID).agg(F.collect_list(F.struct("seed", "low", "high")).alias("mixed"))
        rows = written(texts.joined(unlike).mapInArrow(lean(_next_round(width)), SUFFIXES_DDL), "narrower")
        found = matched(rows, counted(rows).where("n > 1"))
        decided.append(found)
    spans = [
        f.where("alike").select(*ID, (F.col("seed") - F.col("high")).alias("start"), (F.col("seed") - F.col("low") + LENGTH).alias("end"))
        for f in decided
    ]
    return reduce(DataFrame.unionByName, spans)


CUT_DDL = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string"


def joined_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    begins = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[begins], reach[np.r_[begins[1:], len(start)] - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            data = memoryview(batch.column("text")[row].as_buffer())
            spans = batch.column("spans")[row].values
            start, end = joined_runs(spans.field("start").to_numpy(), spans.field("end").to_numpy())
            kept, at = hashlib.sha256(), 0
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out.append((int((end - start).sum()), len(start), kept.hexdigest()))
        removed, runs, kept = zip(*out, strict=True) if out else ((), (), ())
        yield pa.record_batch(
            [batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())],
            names=["k1", "k2", "n_removed", "n_spans", "kept_sha256"],
        )


def without_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Every document with what is left when each byte is cut that lies in LENGTH bytes that start anywhere else too.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256. All occurrences go, those within one document included, and
    those in rows with the same doc_id, or with none. A null text is empty; an empty table gives no rows; rows that are
    repeated as a whole are copies of each other. Only doc_id and text are read. Equal 128-bit fingerprints are taken for
    equal texts, and equal 64-bit fingerprints of windows whose prefixes have equal fingerprints too for equal windows.
    """
    rows = identified(docs)
    narrow = written(
        rows.select("doc_id", *ID, "n_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("whole")), "document-rows"
    )
    total = narrow.agg(F.sum("n_bytes").alias("n")).first().n or 0
    texts = DifferentTexts(rows, total)
    try:
        spans = repeated_spans(texts, batches).groupBy(*ID).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        cut = written(texts.joined(spans).mapInArrow(lean(_cut), CUT_DDL), "without-repeats")
    finally:
        texts.forget()
    copies = narrow.where(F.col("n_bytes") >= LENGTH).groupBy(*ID).agg(F.count(F.lit(1)).alias("copies"))
    facts = written(copies.join(cut, ID, "left").where("copies > 1 OR n_removed IS NOT NULL"), "per-text")
    again = F.coalesce(F.col("copies"), F.lit(0)) > 1
    nothing = hashlib.sha256(b"").hexdigest()
    return keyed_join(narrow, facts, ID).select(
        "doc_id",
        "n_bytes",
        F.when(again, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(again, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(again, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )
