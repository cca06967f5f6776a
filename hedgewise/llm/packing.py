"""Best-fit packing planned over a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Only the count of pieces of each length goes to the driver
(``capacity`` numbers, however many documents). Best fit runs over those counts, longest first, and moves whole runs of
equal sequences at once. A piece then takes the planned place of its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import operator
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgewise.llm.textscan import lean, slices
from hedgewise.plans import written

CAPACITY = 2048
#: Words whose ids a task remembers; the memory is two such generations.
REMEMBERED = 100_000
#: Texts are tokenized in slices of about so many bytes.
SLICE_BYTES = 4 << 20
#: Cells by which the pieces of one length are numbered.
CELLS = 256

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Latin letters that are in normal form and whose small forms are single letters, as a class of characters.
LATIN = r"a-zA-Z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{134}-\x{17e}"
#: A word of such letters, maybe with ASCII signs behind it: the vocabulary cuts it between the two and nowhere else.
WORD_AND_SIGNS = rf"^(?P<word>[{LATIN}]+)(?P<signs>[!-&(-/:-@\[-^`{{-~]*)$"
PLAIN = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), LATIN) + "]+")


ID = operator.attrgetter("id")


class WordIds(dict):
    """Token ids of the parts of texts as little-endian unsigned 32-bit bytes, remembering two generations of parts.

    The vocabulary's pieces never reach over white space, so a text's ids are those of its parts between blanks and line
    feeds; each different part is looked at once. Plain words, in small letters, go straight to the vocabulary's model,
    everything else through its whole chain.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = [chr(i) for i in range(0x180)]
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters if not c.isascii()}
        self.old: dict[str, bytes] = {}

    def _ids(self, part: str) -> bytes:
        if PLAIN.fullmatch(part):
            tokens = self.model.tokenize(part if part.isascii() else part.translate(self.shown))
            ids = list(map(ID, tokens))
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self._ids(part)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[part] = ids
        return ids

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and each text's bounds among them."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        distinct = parts.flatten().dictionary_encode()
        cut = pc.extract_regex(distinct.dictionary, WORD_AND_SIGNS)
        plain = cut.is_valid()
        words = pc.if_else(plain, pc.utf8_lower(cut.field("word")), distinct.dictionary).dictionary_encode()
        signs = pc.if_else(plain, cut.field("signs"), "").dictionary_encode()
        found = [self[p] for kind in (words, signs) for p in kind.dictionary.to_pylist()]
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        start = np.cumsum(size, dtype=np.int32) - size
        ids = np.frombuffer(b"".join(found), "<u4")
        which = distinct.indices.to_numpy()
        both = np.empty((len(which), 2), np.int32)
        both[:, 0] = words.indices.to_numpy()[which]
        both[:, 1] = signs.indices.to_numpy()[which] + len(words.dictionary)
        both = both.ravel()
        sizes = size[both]
        ends = np.zeros(len(both) + 1, np.int32 if len(both) < 1 << 24 else np.int64)
        np.cumsum(sizes, out=ends[1:])
        at = np.repeat(start[both] - ends[:-1], sizes)
        at += np.arange(len(at), dtype=at.dtype)
        offsets = parts.offsets.to_numpy()
        return ids[at], ends[2 * (offsets - offsets[0])]


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One memory for all tasks that a worker runs, one after the other."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def pieces_of(tokens: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    for piece, at in enumerate(range(0, len(tokens), 4 * capacity)):
        own = tokens[at : at + 4 * capacity]
        yield piece, at // 4, len(own) // 4, zlib.crc32(own)


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A document's ids end with ``end_id``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = batch.column(1).fill_null("")
            for own in slices(texts, SLICE_BYTES):
                ids, bounds = words(texts.slice(own.first, len(own)))
                rows: list[tuple] = []
                for i in range(len(own)):
                    tokens = ids[bounds[i] : bounds[i + 1]].tobytes() + end
                    rows.extend((doc_ids[own.first + i], *piece) for piece in pieces_of(tokens, capacity))
                columns = zip(*rows, strict=True)
                yield pa.record_batch(
                    [pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), PIECES_DDL)


def plan(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Best fit, longest first, over ``counts[length]`` pieces (index 0 unused).

    Returns rows (length, first rank, first sequence, offset, step): of the pieces of a length those from a rank on, up
    to the next row's rank, go to sequences one after the other (step 1) or all to one (step 0, then one behind the
    other); and the number of sequences. A run is a range of sequences with equal contents; a piece goes to the run with
    the least room that takes it, and splits the run only when pieces run out.
    """
    capacity = len(counts) - 1
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs of (first sequence, how many)
    open_rooms: list[int] = []  # sorted keys of room
    rows: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                bisect.insort(open_rooms, left)
                room[left] = []
            room[left].append((first, n))

    for length in range(capacity, 0, -1):
        todo, rank = int(counts[length]), 0

        def fill(left: int, first: int, n: int, length: int = length) -> None:
            """Pieces of this length into a run, each sequence full before the next one begins, as best fit does."""
            nonlocal todo, rank
            each = left // length
            whole = min(n, todo // each)
            for k in range(each if whole else 0):
                rows.append((length, rank, first, capacity - left + k * length, 1))
                rank += whole
            todo -= whole * each
            put(left - each * length, first, whole)
            if whole < n and todo:  # the last pieces share one more sequence
                rows.append((length, rank, first + whole, capacity - left, 0))
                used = todo
                rank, todo = rank + used, 0
                put(left - used * length, first + whole, 1)
                whole += 1
            put(left, first + whole, n - whole)

        while todo:
            at = bisect.bisect_left(open_rooms, length)
            if at == len(open_rooms):
                break
            left = open_rooms[at]
            first, n = room[left].pop()
            if not room[left]:
                del room[left]
                open_rooms.pop(at)
            fill(left, first, n)
        if todo:
            n = -(-todo // (capacity // length))
            first, made = made, made + n
            fill(capacity, first, n)
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], made


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces in sequences of at most ``capacity`` tokens, as few as best fit finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is its end id alone; only
    documents longer than ``capacity`` are cut; repeated rows are packed as often as they come; an empty table gives no
    rows. Only doc_id and text are read. Pieces are numbered within cells of their length, so a length that many pieces
    share is never sorted in one task. The plan's rows follow the number of lengths, not of documents.
    """
    spark = docs.sparkSession
    pieces = written(
        cut(docs, tokenizer_path, capacity).withColumn(
            "cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(CELLS)).cast("int")
        ),
        "pieces",
    )
    cells = written(pieces.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length
        counts[r.length] = r.n
    table, _ = plan(counts)
    first = cells.select(
        "length", "cell", (F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).alias("first")
    )
    # at most capacity * CELLS rows of three numbers, hence broadcast
    ranked = (
        pieces.withColumn(
            "rank", F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32"))
        )
        .join(F.broadcast(first), ["length", "cell"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - 1).alias("rank"))
    )
    planned = spark.sparkContext.broadcast(table)
    schema = PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = planned.value
        wide = np.int64(1) << np.int64(48)
        keys = rows[:, 0] * wide + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = rows[np.searchsorted(keys, length * wide + rank, "right") - 1]
            ahead = rank - row[:, 1]
            sequence = row[:, 2] + ahead * row[:, 4]
            offset = row[:, 3] + ahead * (1 - row[:, 4]) * length
            own = [batch.column(f.name).cast(f.type) for f in PIECES]
            yield pa.record_batch([*own, pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(lean(take), PIECES_DDL + ", sequence_id long, offset long")
