"""Near-duplicate documents by banded MinHash with odd sketches.

A document's set holds its distinct five-word shingles. Documents with equal sets form a class, so exact copies never
meet as pairs. Bands of MinHash values propose pairs of classes. A second row of MinHash samples (the smallest hash in
each of 4096 ranges of one permutation) is folded into a parity bitmap: a bit is set if an odd number of samples fall on
it, so the XOR of two bitmaps counts the samples that only one side has. Its population count rejects pairs that are
far from the wanted similarity; what is left is confirmed on the full sets.

Pairs within a crowded band are not enumerated. First each bucket, and each pair of neighbouring buckets, compares its
members with the member that the most others meet (its hub). Then only members that are not yet in the hub's component
are compared with members of other components. Links inside a component cannot change it, so none that matters is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewise.llm.components import components
from hedgewise.llm.rows import fresh, without
from hedgewise.llm.textscan import lean, LOWER, PLACE, SpanHasher, Texts, WORD_BY_SPACE, mixed, slices, spans, windows
from hedgewise.plans import written

SHINGLE = 5
#: A pair that has just the wanted similarity s meets in none of the bands of ROWS values with probability
#: (1 - s^ROWS)^bands; there are as many bands as keep that within MISS (25 at 0.85, 37 at 0.80).
ROWS, MISS = 5, 4.5e-7
#: Ranges of the sampled permutation, and bits of the parity bitmap.
RANGES, BITS = 4096, 2048
#: Standard deviations that a pair's count may lie beyond the one expected at the wanted similarity.
MARGIN = 4.5
#: Up to so many rows of (doc_id) are broadcast to pick documents; more are joined by a shuffle.
PICKED_MAX = 1_000_000


SIGNATURES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n", pa.int64()),
        ("cls", pa.int64()),
        ("bands", pa.list_(pa.int64())),
        ("samples", pa.int32()),
        ("sketch", pa.list_(pa.int64())),
    ]
)
SIGNATURES_DDL = "doc_id long, text_hash long, n long, cls long, bands array<long>, samples int, sketch array<long>"


def band_count(percent: int) -> int:
    """Bands that a wanted similarity takes."""
    share = (percent / 100) ** ROWS
    return 1 if share >= 1 else int(np.ceil(np.log(MISS) / np.log1p(-share)))


def shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes, one text after the other, and the texts' bounds."""
    start, end, word_bounds = spans(texts, WORD_BY_SPACE[texts.data])
    words = SpanHasher(LOWER[texts.data])(start, end)
    hashes, bounds = windows(words, word_bounds, SHINGLE)
    sets = []
    for i in range(len(texts)):
        own = hashes[bounds[i] : bounds[i + 1]]
        few = word_bounds[i + 1] - word_bounds[i]
        if 0 < few < SHINGLE:
            whole = words[word_bounds[i] : word_bounds[i + 1]]
            own = mixed((whole * PLACE[:few]).sum(keepdims=True) + np.uint64(few))
        if len(own) > 1:
            own = np.sort(own)
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        sets.append(own)
    out = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=out[1:])
    return np.concatenate(sets), out


def class_ids(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, from two sums over its members and its size; 0 for an empty set."""
    n = np.diff(bounds).astype(np.uint64)
    names = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        at = bounds[:-1][full]
        one = np.add.reduceat(mixed(sets ^ np.uint64(0x51ED270B)), at)
        two = np.add.reduceat(mixed(sets ^ np.uint64(0xA0761D64)), at)
        names[full] = mixed(mixed(one) + two * PLACE[1] + n[full] * PLACE[2])
    return names.view(np.int64)


def signatures(sets: np.ndarray, bounds: np.ndarray, n_bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty sets: names of their bands, how many samples each has, and their parity bitmaps as 64-bit words."""
    n, at = len(bounds) - 1, bounds[:-1]
    low = sets.astype(np.uint32)
    bands = np.zeros((n, n_bands), np.uint64)
    values = np.arange(n_bands * ROWS, dtype=np.uint64)
    flips = mixed(values + np.uint64(1000)).astype(np.uint32)
    odds = mixed(values + np.uint64(5000)).astype(np.uint32) | np.uint32(1)
    places = mixed(values + np.uint64(9000)) | np.uint64(1)
    for i in range(n_bands * ROWS):
        least = np.minimum.reduceat((low ^ flips[i]) * odds[i], at)
        bands[:, i // ROWS] += least.astype(np.uint64) * places[i]
    bands = mixed(bands + places[:n_bands])
    ranges = sets >> np.uint64(64 - RANGES.bit_length() + 1)
    first = np.ones(len(sets), bool)
    first[1:] = ranges[1:] != ranges[:-1]
    first[at] = True
    owner = np.repeat(np.arange(n), np.diff(bounds))[first]
    place = (mixed(sets[first]) & np.uint64(BITS - 1)).astype(np.int64)
    words = np.zeros((n, BITS // 64), np.int64)
    for k in range(0, n, 1024):
        own = (owner >= k) & (owner < k + 1024)
        m = min(1024, n - k)
        odd = np.bincount((owner[own] - k) * BITS + place[own], minlength=m * BITS) & 1
        words[k : k + m] = np.packbits(odd.astype(bool).reshape(m, BITS), axis=1).view(np.int64)
    return bands.view(np.int64), np.bincount(owner, minlength=n).astype(np.int32), words


def _lists(rows: np.ndarray, full: np.ndarray) -> pa.Array:
    """Rows as lists; null where ``full`` is false."""
    offsets = np.zeros(len(full) + 1, np.int32)
    np.cumsum(full * (rows.shape[1] if rows.ndim > 1 else 0), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def with_signatures(docs: DataFrame, n_bands: int) -> DataFrame:
    """One row per document; ``cls`` is 0 and the lists are empty for those without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                sets, bounds = shingle_sets(texts)
                n = np.diff(bounds)
                full = n > 0
                bands = sketch = np.zeros((0, 1), np.int64)
                samples = np.zeros(len(n), np.int32)
                if full.any():
                    bands, samples[full], sketch = signatures(
                        sets, np.concatenate([bounds[:-1][full], bounds[-1:]]), n_bands
                    )
                columns = [
                    batch.column(0).slice(texts.first, len(texts)),
                    batch.column(2).slice(texts.first, len(texts)),
                    pa.array(n),
                    pa.array(class_ids(sets, bounds)),
                    _lists(bands, full),
                    pa.array(samples),
                    _lists(sketch, full),
                ]
                yield pa.record_batch(columns, schema=SIGNATURES)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(lean(run), SIGNATURES_DDL)


def _sizes_allow(percent: int) -> F.Column:
    """Whether the sets of two classes (columns of ``a`` and ``b``) are near enough in size."""
    n_a, n_b = F.col("a.n"), F.col("b.n")
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _bitmaps_allow(percent: int) -> F.Column:
    """Whether the bitmaps of two classes differ in few enough bits.

    A pair that has just the wanted similarity s shares s of the ranges that its union fills (as many as usual for its
    size, times how the two sets' own counts compare with the usual ones); the other samples differ. Their number strays by the draw of the samples (the less, the more of the sets is sampled), the bits by samples that
    fall on one bit. Both are added as independent, and MARGIN times the root is allowed for.
    """
    s = percent / 100

    def filled(n: F.Column) -> F.Column:
        return RANGES * (1 - F.exp(n * float(np.log1p(-1 / RANGES))))

    union = (F.col("a.n") + F.col("b.n")) / (1 + s)
    samples = F.col("a.samples") + F.col("b.samples")
    ranges = filled(union) * samples / (filled(F.col("a.n")) + filled(F.col("b.n")))
    apart = F.greatest(samples - 2 * s * ranges, F.lit(0.0))
    drawn = 4 * s * (1 - s) * ranges * F.greatest(1 - ranges / union, F.lit(0.0)) + 4
    slope = F.exp(-2 * apart / BITS)
    odd = BITS / 2 * (1 - slope)
    fallen = BITS / 4 * (1 - (1 + 4 * apart / BITS) * slope * slope)
    seen = reduce(
        add,
        [F.bit_count(F.col("a.sketch")[i].bitwiseXOR(F.col("b.sketch")[i])) for i in range(BITS // 64)],
    )
    return seen <= odd + MARGIN * F.sqrt(drawn * slope * slope + fallen) + 1


def _full_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cls, members) of every class that occurs in the pairs, from one document of each."""
    named = pairs.select(F.col("x").alias("cls")).unionByName(pairs.select(F.col("y").alias("cls"))).distinct()
    named = written(classes.join(named, "cls", "left_semi").select("cls", F.col("doc_id").alias("of")), "named")
    wanted = F.broadcast(named) if named.count() <= PICKED_MAX else named
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("d")
    rows = rows.join(wanted.alias("w"), F.expr("d.doc_id <=> w.of"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                sets, bounds = shingle_sets(texts)
                names = class_ids(sets, bounds)
                members = [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.record_batch([pa.array(names), pa.array(members, pa.binary())], names=["cls", "members"])

    sets = rows.mapInArrow(lean(run), "cls long, members binary")
    return sets.dropDuplicates(["cls"])


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets reach the similarity."""
    sets = written(_full_sets(docs, classes, pairs), "sets")
    both = pairs.join(sets.withColumnsRenamed({"cls": "x", "members": "left"}), "x").join(
        sets.withColumnsRenamed({"cls": "y", "members": "right"}), "y"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                a = np.frombuffer(left.as_buffer(), np.uint64)
                b = np.frombuffer(right.as_buffer(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_())).rename_columns(["u", "v"])

    return both.select("x", "y", "left", "right").mapInArrow(lean(run), "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Each document's class and component under 100 * intersection >= percent * union of shingle sets.

    Returns doc_id, text_hash, n_shingles, cls, component (its smallest class; null without shingles), component_id (the
    smallest doc_id reachable, itself included), kept. A null or empty
    text, or one of white space, has no shingles and is linked with nothing. Repeated rows share a class. A null doc_id
    never names a component that has another id; where all are null, so is the component_id. Only doc_id and text are
    read. Two texts count as equal if the 64-bit hashes of their shingles do.
    """
    n_bands = band_count(percent)
    signed = written(with_signatures(docs, n_bands), "signatures")
    classes = written(
        signed.where("n > 0").groupBy("cls").agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n").alias("n"),
            F.first("samples").alias("samples"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    # buckets with at least two classes
    banded = classes.select("cls", F.explode("bands").alias("bucket"))
    crowds = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    members = written(banded.join(crowds, "bucket"), "members")
    weight = members.groupBy("cls").agg(F.sum("crowd").alias("weight"))

    # hubs of buckets and of pairs of neighbouring buckets
    met = classes.join(weight, "cls").select("cls", "weight", "bands")
    met = met.select(
        "cls",
        "weight",
        F.explode(
            F.concat("bands", *[F.array(*[F.xxhash64(F.col("bands")[i], F.col("bands")[(i + 1) % n_bands]) for i in range(n_bands)])])
        ).alias("bucket"),
    )
    hubs = met.groupBy("bucket").agg(
        F.max(F.struct("weight", "cls")).getField("cls").alias("hub"), F.count(F.lit(1)).alias("crowd")
    )
    hubs = hubs.where("crowd > 1")
    spokes = (
        met.join(hubs, "bucket").where("cls != hub")
        .select(F.least("cls", "hub").alias("x"), F.greatest("cls", "hub").alias("y")).distinct()
    )
    facts = classes.select("cls", "n", "samples", "sketch")
    likely = (
        spokes.join(facts.alias("a"), F.expr("x = a.cls")).join(facts.alias("b"), F.expr("y = b.cls"))
        .where(_sizes_allow(percent) & _bitmaps_allow(percent)).select("x", "y")
    )
    likely = written(likely, "spokes")
    links = written(_confirmed(docs, classes, likely, percent), "links")
    grouped = written(components(links), "grouped")

    # members outside their hub's component against members of other components
    placed = members.join(grouped, F.expr("cls = node"), "left").select(
        "bucket", "cls", F.coalesce("component", "cls").alias("component")
    )
    placed = written(placed, "placed")
    shares = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    major = shares.groupBy("bucket").agg(
        F.max(F.struct("n", "component")).getField("component").alias("major"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1").select("bucket", "major")
    open_ones = placed.join(major, "bucket")
    open_ones = written(open_ones.join(classes.drop("doc_id"), "cls"), "open")
    a, b = open_ones.where("component != major").alias("a"), open_ones.alias("b")
    # the first bucket that both share: a pair is compared there alone
    met_before = reduce(
        lambda found, i: F.when(F.col("a.bands")[i] == F.col("b.bands")[i], F.col("a.bands")[i]).otherwise(found),
        range(n_bands - 1, -1, -1),
        F.lit(None).cast("long"),
    )
    rest = a.join(
        b,
        F.expr("a.bucket = b.bucket AND a.component != b.component")
        & F.expr("b.component = b.major OR a.cls < b.cls")
        & _sizes_allow(percent)
        & (met_before == F.col("a.bucket"))
        & _bitmaps_allow(percent),
    ).select(F.least("a.cls", "b.cls").alias("x"), F.greatest("a.cls", "b.cls").alias("y"))
    rest = written(rest.join(likely, ["x", "y"], "left_anti").distinct(), "rest")
    links = links.unionByName(_confirmed(docs, classes, rest, percent))
    final = written(components(links), "components")

    of_class = classes.select("cls", "doc_id").join(final, F.expr("cls = node"), "left").select(
        "cls", "doc_id", F.coalesce("component", "cls").alias("component")
    )
    lowest = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = of_class.join(lowest, "component").select("cls", "component", "component_id")
    rows = signed.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "cls")
    linked = rows.where("n_shingles > 0").join(of_class, "cls")
    alone = rows.where("n_shingles = 0").withColumns(
        {"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")}
    )
    return linked.unionByName(alone).withColumn("kept", F.expr("doc_id <=> component_id"))


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group of near duplicates, all columns: a row with the group's component_id.

    Documents without words all stay. Of rows that agree in doc_id and text one stays.
    """
    text = fresh(docs, "text_hash")
    known = docs.withColumn(text, F.xxhash64(F.col("text").cast("string")))
    found = near_duplicates(docs.select("doc_id", "text"), percent).where("component IS NOT NULL")
    per_row = found.groupBy("doc_id", "text_hash").agg(
        F.first("component").alias("component"), F.count(F.lit(1)).alias("rows")
    )
    per_row = written(per_row.withColumn("key", F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")), "documents")
    stays = per_row.groupBy("component").agg(F.min("key").alias("stays"))
    judged = written(per_row.join(stays, "component").withColumn("stay", F.col("key") == F.col("stays")), "judged")
    keys = ["doc_id", text]

    def named(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", F.col("text_hash").alias(text))

    left = without(known, named(judged.where("NOT stay")), keys)
    again = named(judged.where("stay AND rows > 1"))
    if again.limit(1).count():
        left = without(left, again, keys).unionByName(without(left, again, keys, "left_semi").dropDuplicates(keys))
    return left.select(docs.columns)
