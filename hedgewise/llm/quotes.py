"""Quotation linking in DataFrame functions alone.

A line that begins with ``>`` signs is quoted, as deeply as there are signs. Lines of one depth in a row make a passage;
its normalised text is hashed and joined to the messages whose own text, paragraphs or lines have that hash. A message
replies to the original of its first linked passage of the least depth, and conversations are ordered by the paths of
replies, each message without what it quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgewise.plans import written

QUOTED = r"^[ \t]*>"
MARKS = r"^[ \t]*(>[ \t>]*)"
# Lines that announce a quotation.
ANNOUNCED = r"(?i)^[ \t]*(on .+ wrote|le .+ a écrit|am .+ schrieb .+|el .+ escribió)[ \t]*:[ \t]*$"


def normalised(text: Column) -> Column:
    """Small letters, white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def own_lines(text: Column) -> Column:
    """The lines that are neither quoted nor announce a quotation."""
    return F.filter(F.split(text, "\n"), lambda x: ~x.rlike(QUOTED) & ~x.rlike(ANNOUNCED))


def body(text: Column) -> Column:
    """A message without quotations: its own lines, no white space at the ends."""
    return F.regexp_replace(F.array_join(own_lines(text), "\n"), r"^\s+|\s+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, message, first_line, depth, hash) of every quoted passage; ``message`` is a hash of the row."""
    quoting = messages.where(F.col("text").rlike(r"(?m)" + QUOTED)).select("conv_id", "turn", "message", "text").distinct()
    lines = quoting.select("conv_id", "turn", "message", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    marks = F.regexp_extract("content", MARKS, 1)
    lines = lines.select(
        "conv_id",
        "turn",
        "message",
        "line",
        F.length(F.regexp_replace(marks, "[^>]", "")).alias("depth"),
        F.regexp_replace("content", MARKS, "").alias("content"),
    )
    of_message = Window.partitionBy("conv_id", "turn", "message").orderBy("line")
    starts = F.when(F.lag("depth").over(of_message) == F.col("depth"), 0).otherwise(1)
    runs = lines.withColumn("starts", starts).withColumn("run", F.sum("starts").over(of_message)).where("depth > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), " ")
    return (
        runs.groupBy("conv_id", "turn", "message", "run")
        .agg(F.min("line").alias("first_line"), F.first("depth").alias("depth"), normalised(joined).alias("content"))
        .where("content != ''")
        .select("conv_id", "turn", "message", "first_line", "depth", F.xxhash64("content").alias("hash"), F.length("content").alias("size"))
    )


def originals(messages: DataFrame) -> DataFrame:
    """(hash, size, conv_id, turn): whose whole own text, paragraph or line has a hash; the first turn of a conversation."""
    own = body(F.col("text"))
    parts = F.concat(F.array(own), F.split(own, r"\n\s*\n"), F.split(own, "\n"))
    return (
        messages.where("text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL")
        .select("conv_id", "turn", F.explode(F.array_distinct(F.transform(parts, normalised))).alias("content"))
        .where("content != ''")
        .groupBy(F.xxhash64("content").alias("hash"), F.length("content").alias("size"), "conv_id")
        .agg(F.min("turn").alias("turn"))
    )


def linked(conversations: DataFrame) -> DataFrame:
    """Every message with its place among the replies and without quotations.

    Returns conv_id, turn, role, body, n_passages, n_linked, reply_to (the turn it answers, in its own conversation),
    source_conv and source_turn (the original where only another conversation holds it), depth (0: answers none) and
    reply_path (turns from the first message down, ten digits each, so that ordering by conv_id and reply_path gives the
    conversation in the order of replies). A message only answers an earlier turn; where several hold a passage, the first.
    A null text has a null body and no passages; rows with a null conv_id or turn are nobody's original and answer none;
    repeated rows get equal results; an empty table gives no rows. Other columns are not read.
    """
    message = F.xxhash64("role", "text")
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("text").cast("string")
    ).withColumn("message", message)
    quoted = written(passages(rows), "passages")
    # only parts that are quoted at all are kept before anything is joined on conversations
    sources = written(originals(rows).join(quoted.select("hash", "size").distinct(), ["hash", "size"], "left_semi"), "originals")
    here = sources.withColumnRenamed("turn", "reply_to")
    first = sources.groupBy("hash", "size").agg(F.min(F.struct("conv_id", "turn")).alias("source"))
    matched = (
        quoted.join(here, ["hash", "size", "conv_id"], "left")
        .withColumn("reply_to", F.when(F.col("reply_to") < F.col("turn"), F.col("reply_to")))
        .join(first, ["hash", "size"], "left")
        .withColumn("source", F.when(F.col("source.conv_id") != F.col("conv_id"), F.col("source")))
        .withColumn("found", F.col("reply_to").isNotNull() | F.col("source").isNotNull())
    )
    by_place = F.struct("depth", "first_line")
    replies = matched.groupBy("conv_id", "turn", "message").agg(
        F.count(F.lit(1)).alias("n_passages"),
        F.count_if("found").alias("n_linked"),
        F.min_by("reply_to", F.when(F.col("reply_to").isNotNull(), by_place)).alias("reply_to"),
        F.min_by("source", F.when(F.col("source").isNotNull(), by_place)).alias("source"),
    )
    replies = written(replies, "replies")

    # paths by doubling: each round puts the path of the topmost known ancestor in front
    def padded(turn: str) -> Column:
        return F.lpad(F.col(turn).cast("string"), 10, "0")

    edges = replies.where("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("top"))
    paths = written(edges.withColumn("path", padded("top")), "paths")
    while True:
        above = paths.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("higher"), F.col("path").alias("before"))
        longer = paths.join(above, ["conv_id", "top"], "left").select(
            "conv_id",
            "turn",
            F.coalesce("higher", "top").alias("top"),
            F.concat_ws("/", "before", "path").alias("path"),
            F.col("higher").isNotNull().alias("moved"),
        )
        paths = written(longer, "paths")
        if not paths.where("moved").limit(1).count():
            break
    keys = ["conv_id", "turn", "message"]
    known = replies.join(paths.select("conv_id", "turn", "path"), ["conv_id", "turn"], "left")
    return rows.join(known, keys, "left").select(
        "conv_id",
        "turn",
        "role",
        body(F.col("text")).alias("body"),
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to",
        F.col("source.conv_id").alias("source_conv"),
        F.col("source.turn").alias("source_turn"),
        F.when(F.col("path").isNull(), 0).otherwise(F.size(F.split("path", "/"))).alias("depth"),
        F.concat_ws("/", "path", padded("turn")).alias("reply_path"),
    )
