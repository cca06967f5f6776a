"""How quality filters interact: which of them drop what others would have dropped, in every order they could run in.

A document fails some of five filters; the set of its failures is a number of five bits. Once documents are counted by
part and bits, every order of the filters follows from those counts alone, so no order is ever run over documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgewise.llm.rows import KEYS_MAX
from hedgewise.plans import keyed_join, written
from hedgewise.plans.joins import HOT_SHARE

FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = r"[#$%&*|]"
#: Blank, tab, line feed, vertical tab, form feed, carriage return.
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"
REPEATED_BIT = 1 << FILTERS.index("E")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D, which read one text alone."""
    words = F.filter(F.split(text, BETWEEN_WORDS), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    checks = [
        F.size(words) < FEW_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * capitals > CAPITAL_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    ]
    return sum(F.when(c, 1 << i).otherwise(0) for i, c in enumerate(checks)).cast("int")


def of_hashes(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose hash is among ``keys``, with the columns of ``keys``. Broadcast up to KEYS_MAX keys, shuffled beyond."""
    return rows.join(F.broadcast(keys) if keys.count() <= KEYS_MAX else keys, "h")


def repeated_rows(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """doc_id, h, part of documents whose text a smaller doc_id has too.

    Only texts whose hash several doc_ids have are compared. The other side of the semi join is one row for each different
    text, with its smallest doc_id; a hash that many rows share is dealt over parts of at most 1/HOT_SHARE of all rows, and
    its few texts are copied to each part.
    """
    rows = flags.groupBy("h").agg(
        F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    )
    total = flags.count()
    shared = written(
        rows.where("least < most").select("h", F.ceil(F.col("rows") * HOT_SHARE / max(total, 1)).cast("int").alias("parts")),
        "shared-hashes",
    )
    texts = of_hashes(docs, shared)
    first = texts.groupBy("h", "parts", "text").agg(F.min("doc_id").alias("least"))
    first = first.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("first")
    own = texts.where(F.col("doc_id").isNotNull()).withColumn("deal", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).alias("own")
    same = [F.col(f"own.{c}") == F.col(f"first.{c}") for c in ("h", "deal", "text")]
    return own.join(first, [*same, F.col("own.doc_id") > F.col("first.least")], "left_semi").select("doc_id", "h", "part")


def label_bits(labels: DataFrame) -> DataFrame:
    """One row per labelled doc_id: whether any of its rows says good, whether any says toxic."""
    said = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "bad"))]
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*said)


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, n, good, toxic: how many documents of a part fail exactly these filters, and how many are labelled so.

    A null text counts as empty, a null source as the empty part. A row without a doc_id repeats nothing and has no labels.
    Rows with the same doc_id count as often as they come. Columns other than doc_id, text and source are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    flags = written(rows.select("doc_id", "h", "part", text_failures(F.col("text")).alias("bits")), "text-failures")
    repeated = repeated_rows(rows, flags).select("doc_id", "h", "part", F.lit(REPEATED_BIT).alias("bits"), F.lit(0).alias("n"))
    failed = (
        flags.withColumn("n", F.lit(1))
        .unionByName(repeated)
        .groupBy("doc_id", "h", "part")
        .agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    )
    said = keyed_join(written(failed, "failures"), label_bits(labels), ["doc_id"])
    count = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return said.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), count("good").alias("good"), count("bad").alias("toxic")
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does in each place of every order: a row per part, order and step, zeros included.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. An empty
    table has no parts and gives no rows. Documents are as in ``combinations``; the work of the orders is 600 sums over 32
    counts for each part, whatever the number of documents.
    """
    sets = range(1 << len(FILTERS))
    tallies = ("n", "good", "toxic")
    by_part = combinations(docs, labels).groupBy("part").agg(
        *[
            F.array(*[F.sum(F.when(F.col("bits") == b, F.col(c)).otherwise(0)) for b in sets]).alias(c)
            for c in tallies
        ]
    )
    orders = " ".join("".join(p) for p in permutations(FILTERS))
    steps = (
        by_part.withColumn("filter_order", F.explode(F.split(F.lit(orders), " ")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("own", F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)"))
        .withColumn(
            "before",
            F.expr(
                f"aggregate(sequence(1, 5), 0, (s, i) -> s + if(i < step, shiftleft(1, instr('{FILTERS}', substr(filter_order, i, 1)) - 1), 0))"
            ),
        )
    )

    def total(tally: str, condition: str, weight: str = "1") -> Column:
        """Sum of a tally over the failure sets b for which the condition holds."""
        return F.expr(
            f"aggregate(sequence(0, {len(sets) - 1}), 0L, (s, b) -> s + if({condition}, {tally}[b] * {weight}, 0L))"
        ).cast("long")

    here = "(b & own) <> 0 AND (b & before) = 0"
    n_orders = len(list(permutations(FILTERS)))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", "(b & (before | own)) = 0").alias("kept"),
        total("n", here).alias("removed"),
        total("n", "(b & own) <> 0 AND (b & before) <> 0").alias("redundant"),
        total("n", "b = own").alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        # of a document's failures each comes first in as many orders as any other
        total("n", "(b & own) <> 0", f"({n_orders} DIV bit_count(b))").alias("shapley"),
    )
