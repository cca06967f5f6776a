"""Quality rules: counts of words, symbols and repeats, and perplexity bands of a Kneser-Ney model.

The model is a modified Kneser-Ney model of order 4 over bytes as they are: nothing is folded, so case, digits, signs and the
letters of every script count. Spark counts the n-grams of every whole text, the continuation counts of the lower orders,
their discounts and weights; the model's sorted hash arrays hold each different n-gram once, whose number levels off as the
corpus grows. A text's perplexity is rejected outside a band around its language's median. The operator also takes an alphabet
of byte classes, for a model of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgewise.llm.textscan import (
    lean,
    STARTS_CHAR,
    SpanHasher,
    Texts,
    WORD_BY_SPACE,
    mixed,
    owners,
    run_totals,
    slices,
    spans,
    windows,
)
from hedgewise.plans import keyed_join, written

ORDER = 4
#: Words of the windows that count as repeated.
REPEAT = 8
#: Half-quartile ranges around the median that a text's log perplexity may lie away.
BAND = 7.5
#: The band of a text of so many characters is wider by the root of two, of a shorter one by more: its mean is less sure.
SHORT = 400
#: A language with fewer judged texts than this is held to the band of all texts.
LEAST_TEXTS = 200
#: Up to so many languages the bands are broadcast; beyond, common languages are dealt over several parts.
LANGUAGES_MAX = 10_000
SLICE_BYTES = 4 << 20
#: Different n-grams that a task adds up before it hands them on.
TALLIED = 2_000_000

SIGNS = np.zeros(256, bool)
SIGNS[list(b"#*$%&|<>")] = True


def _classes() -> np.ndarray:
    c = np.full(256, 34, np.uint8)  # control characters
    c[0x21:0x7F] = 33  # other signs
    c[list(b" \t\v\f\r")] = 0
    c[0x0A] = 1
    for i in range(26):
        c[[0x41 + i, 0x61 + i]] = 2 + i
    c[0x30:0x3A] = 28
    c[list(b".")], c[list(b",")], c[list(b";:!?")] = 29, 30, 31
    c[SIGNS] = 32
    c[0xC0:0xC4], c[0xC4:] = 35, 36  # first bytes
    c[0x80:0xC0] = 37 + np.arange(64) % 11  # following bytes
    return c


#: Alphabets: the symbol of each byte. Every byte is its own symbol; or 48 classes, letters in either case, bytes of other
#: letters folded.
BYTES, CLASSES = np.arange(256, dtype=np.uint8), _classes()


def symbols(alphabet: np.ndarray) -> int:
    return int(alphabet.max()) + 1


def ngrams(texts: Texts, alphabet: np.ndarray = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text as numbers below symbols ** ORDER, which fit 32 bits, and the bounds of each text's n-grams."""
    counts = np.maximum(np.diff(texts.bounds) - ORDER + 1, 0)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    n = len(texts.data) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint32), bounds
    codes = alphabet[texts.data].astype(np.uint32)
    grams = codes[:n].copy()
    for i in range(1, ORDER):
        grams *= np.uint32(symbols(alphabet))
        grams += codes[i : i + n]
    whole = np.ones(n, bool)  # not over the end of a text
    for back in range(1, ORDER):
        at = texts.bounds[1:-1] - back
        whole[at[(at >= 0) & (at < n)]] = False
    return grams[whole], bounds


def counted(docs: DataFrame, alphabet: np.ndarray = CLASSES) -> DataFrame:
    """(gram, n): how often each n-gram occurs in all texts."""

    def rows(seen: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(seen.astype(np.int64)), pa.array(total)], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0), SLICE_BYTES):
                grams, n = np.unique(ngrams(texts, alphabet)[0], return_counts=True)
                seen, at = np.unique(np.concatenate([seen, grams]), return_inverse=True)
                counts = np.zeros(len(seen), np.int64)
                counts[at[: len(total)]] = total
                counts[at[len(total) :]] += n
                total = counts
                if len(seen) > TALLIED:  # the shuffle adds up what a task hands on in parts
                    yield rows(seen, total)
                    seen, total = seen[:0], total[:0]
        yield rows(seen, total)

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(
        F.sum("n").alias("n")
    )


def _discount(order_stats: dict, n: str) -> Column:
    """The modified Kneser-Ney discount of a count, by order."""
    whole = F.lit(0.0)
    for order, (d1, d2, d3) in order_stats.items():
        own = F.when(F.col(n) == 1, d1).when(F.col(n) == 2, d2).otherwise(d3)
        whole = F.when(F.col("order") == order, own).otherwise(whole)
    return whole


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams with counts 1 to 4; where those are too few, fixed ones."""
    if min(n1, n2, n3) <= 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


class SortedHashes:
    """Numbers by the hashes of n-grams: two arrays, the first one sorted."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        hashes = mixed(grams.astype(np.uint64))
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]

    def __call__(self, grams: np.ndarray, default: float) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(grams), default)
        wanted = mixed(grams.astype(np.uint64))
        at = np.searchsorted(self.hashes, wanted)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == wanted, self.values[at], default)


class KneserNey:
    """Per order the discounted share of each n-gram and the weight that its context leaves to the order below."""

    def __init__(self, shares: dict[int, SortedHashes], weights: dict[int, SortedHashes], n_symbols: int):
        self.shares, self.weights, self.n_symbols = shares, weights, n_symbols

    def probability(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full(len(grams), 1 / self.n_symbols)
        below = self.probability(grams % self.n_symbols ** (order - 1), order - 1)
        return self.shares[order](grams, 0.0) + self.weights[order](grams // self.n_symbols, 1.0) * below


def fitted(docs: DataFrame, alphabet: np.ndarray = CLASSES) -> KneserNey:
    """The model of all texts. What reaches the driver is a row for each different n-gram and context, never a text."""
    n_symbols = symbols(alphabet)
    level = counted(docs, alphabet).select(F.lit(ORDER).alias("order"), "gram", "n")
    level = grams = written(level, "grams")
    for order in range(ORDER - 1, 0, -1):
        level = level.groupBy(F.pmod("gram", F.lit(n_symbols**order)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        level = level.select(F.lit(order).alias("order"), "gram", "n")
        grams = grams.unionByName(level)
    grams = written(grams, "orders")
    counts = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    stats = {r.order: discounts(r.n1, r.n2, r.n3, r.n4) for r in grams.groupBy("order").agg(*counts).collect()}
    context = F.expr(f"gram div {n_symbols}").alias("context")
    cut = grams.withColumn("cut", _discount(stats, "n"))
    totals = cut.groupBy("order", context).agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
    shares = cut.withColumn("context", context).join(totals, ["order", "context"]).select(
        "order", "gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("value")
    )
    weights = totals.select("order", F.col("context").alias("gram"), (F.col("left") / F.col("total")).alias("value"))

    def arrays(table: DataFrame) -> dict[int, SortedHashes]:
        rows = table.toArrow()
        order, gram, value = (rows[c].to_numpy() for c in ("order", "gram", "value"))
        return {k: SortedHashes(gram[order == k], value[order == k]) for k in range(1, ORDER + 1)}

    return KneserNey(arrays(shares), arrays(weights), n_symbols)


FEATURES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("lang", pa.string()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("log_perplexity", pa.float64()),
    ]
)
FEATURES_DDL = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " log_perplexity double"
)


def repeated_words(words: np.ndarray, bounds: np.ndarray, size: int = REPEAT) -> np.ndarray:
    """Words of each text that lie in a window of ``size`` words found twice or more in that text."""
    hashes, own = windows(words, bounds, size)
    text = owners(own)
    keys = hashes + mixed(text.astype(np.uint64) + np.uint64(77)) if len(hashes) else hashes
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    again = np.zeros(len(keys), bool)
    again[1:] |= same
    again[:-1] |= same
    window = order[again]
    begin = window + (bounds[:-1] - own[:-1])[text[window]]
    step = np.zeros(len(words) + 1, np.int32)
    np.add.at(step, begin, 1)
    np.add.at(step, begin + size, -1)
    return run_totals(np.cumsum(step[:-1]) > 0, bounds)


def repeated_lines(texts: Texts, hasher: SpanHasher, word_start: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    feed = np.flatnonzero(texts.data == 0x0A)
    start = np.sort(np.concatenate([texts.bounds[:-1], feed + 1]), kind="stable")
    end = np.sort(np.concatenate([texts.bounds[1:], feed]), kind="stable")
    # texts' own bounds come in order with their line feeds, so the k-th start belongs to the k-th end
    worded = np.searchsorted(word_start, start) < np.searchsorted(word_start, end)
    start, end = start[worded], end[worded]
    text = np.searchsorted(texts.bounds, start, "right") - 1
    keys = hasher(start, end) + mixed(text.astype(np.uint64) + np.uint64(77))
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order][1:] == keys[order][:-1]]
    return np.bincount(text[again], minlength=len(texts))


def mean_logs(texts: Texts, model: KneserNey, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's mean of minus the logarithm of its n-grams' probabilities, and how many n-grams it has."""
    grams, bounds = ngrams(texts, alphabet)
    # every different n-gram of the slice is looked up once; n-grams are sorted together with their texts' numbers
    keys = np.sort(grams.astype(np.uint64) << np.uint64(32) | owners(bounds).astype(np.uint64))
    grams, text = keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    at = np.flatnonzero(first)
    logs = np.log(model.probability(grams[at].astype(np.int64)))
    total = np.bincount(text, np.repeat(logs, np.diff(at, append=len(grams))), minlength=len(texts))
    n = np.diff(bounds)
    return -total / np.maximum(n, 1), n


def measured(docs: DataFrame, model: KneserNey, alphabet: np.ndarray = CLASSES) -> DataFrame:
    """FEATURES of every document; log_perplexity is null for texts of fewer than ORDER bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                data = texts.data
                start, end, bounds = spans(texts, WORD_BY_SPACE[data])
                hasher = SpanHasher(data)
                words = hasher(start, end)
                mean, n = mean_logs(texts, shared.value, alphabet)
                columns = [
                    batch.column(0).slice(texts.first, len(texts)),
                    batch.column(2).slice(texts.first, len(texts)),
                    np.diff(bounds),
                    texts.per_text(WORD_BY_SPACE[data] & STARTS_CHAR[data]),
                    texts.per_text(SIGNS[data]),
                    repeated_lines(texts, hasher, start),
                    repeated_words(words, bounds),
                    pa.array(mean, mask=n == 0),
                ]
                yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=FEATURES)

    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")
    ).mapInArrow(lean(run), FEATURES_DDL)


def judged(docs: DataFrame, band: float = BAND, alphabet: np.ndarray = BYTES) -> DataFrame:
    """FEATURES of every document with base_failed and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. kept: not base_failed, and the log
    perplexity within ``band`` half-quartile ranges (more for short texts) of the median of the language's texts that did
    not fail, on either side (for rare languages, and where the language is null, of all texts). Null and empty texts have zero counts and
    fail; repeated rows are judged alike; an empty table gives no rows. Only doc_id, text and lang are read.
    """
    scored = written(measured(docs, fitted(docs, alphabet), alphabet), "perplexity").withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10000).alias("q")
    passed = scored.where("NOT base_failed")
    by_lang = passed.where("lang IS NOT NULL").groupBy("lang").agg(quartiles, F.count(F.lit(1)).alias("n"))
    by_lang = written(by_lang.where(F.col("n") >= LEAST_TEXTS).select("lang", "q"), "languages")
    overall = passed.agg(quartiles.alias("every"))
    low, mid, high = (F.coalesce(F.col("q")[i], F.col("every")[i]) for i in range(3))
    x = F.col("log_perplexity")
    least = F.lit(0.005)  # a band is never narrower than this, as where most texts are copies
    wide = band * F.sqrt(1 + SHORT / F.greatest("word_chars", F.lit(1)))
    within = (x >= mid - wide * F.greatest(mid - low, least)) & (x <= mid + wide * F.greatest(high - mid, least))
    if by_lang.count() <= LANGUAGES_MAX:
        with_lang = scored.join(F.broadcast(by_lang), "lang", "left")
    else:
        with_lang = keyed_join(scored, by_lang, ["lang"])
    return (
        with_lang.join(F.broadcast(overall), how="left")  # one row
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True))).drop("q", "every")
    )
