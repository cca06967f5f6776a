"""Which tokens of two tokenizers stand for the same bytes, over all documents.

Both tokenizers cut before a blank that follows a word, so a text is a row of chunks that each encodes for itself. A batch's
different chunks are encoded and aligned once: byte offsets at which tokens of both end cut the chunk into groups.

Most groups are one token of each with the same bytes, which the identity map (A id to the B id of the same bytes) names
without looking at B. They are counted in vectors as long as the vocabulary. Only the other groups are shuffled, and as
groups, once per document: a group's pairs are counted over the table of different groups, not over documents.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewise.llm.textscan import lean, run_totals, slices
from hedgewise.plans import keyed_join, written
from hedgewise.plans.joins import HOT_SHARE

#: Texts are encoded in slices of about so many bytes.
SLICE_BYTES = 4 << 20
#: The sign that stands for a blank in pieces.
BLANK = "▁"
#: White space at which A never begins a new part by itself, or that B reads as a blank: such a text is one chunk.
UNUSUAL = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2581}\x{3000}\x{feff}]"
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies show visible Latin-1 characters as themselves, other bytes as the signs from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Bytes, lengths and printed ids of all tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.shown = pa.array([str(i) for i in range(len(tokens))], pa.large_string())

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.first[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Tokenizers:
    """A (byte-level BPE, given blank and text) and B (pieces, given the text, before which it sets a blank itself)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(path_a)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.blank = self.second.piece_to_id(BLANK)
        signs = byte_of_sign()
        names = [self.first.id_to_token(i) or "" for i in range(self.first.get_vocab_size())]
        self.a = Vocabulary([bytes(signs[c] for c in n) if all(c in signs for c in n) else n.encode() for n in names])
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        as_byte = [self.second.is_byte(i) for i in range(len(pieces))]
        self.b = Vocabulary(
            [bytes([int(p[3:5], 16)]) if y else p.replace(BLANK, " ").encode() for p, y in zip(pieces, as_byte, strict=True)]
        )
        by_bytes: dict[bytes, int] = {}
        for i in sorted(range(len(pieces)), key=lambda i: as_byte[i]):  # a piece rather than a single byte's stand-in
            if not (self.second.is_control(i) or self.second.is_unknown(i) or self.second.is_unused(i)):
                by_bytes.setdefault(self.b.tokens[i], i)
        #: A id to the B id of the same bytes, or -1.
        self.same = np.array([by_bytes.get(t, -1) if t else -1 for t in self.a.tokens], np.int64)
        inside = "".join(p.lstrip(BLANK) for p, y in zip(pieces, as_byte, strict=True) if not y)
        #: Bytes before which both cut, unless white space stands before them.
        self.breaks = np.zeros(256, bool)
        for sign in " \n\t":
            self.breaks[ord(sign)] = (BLANK if sign == " " else sign) not in inside

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and their bounds, ids of B and their bounds."""
        a = [e.ids for e in self.first.encode_batch_fast(chunks, add_special_tokens=False)]
        blank = [c.startswith(" ") for c in chunks]
        b = self.second.encode([c[1:] if s else c for c, s in zip(chunks, blank, strict=True)], num_threads=1)
        for i, c in enumerate(chunks):
            if c == " ":  # before nothing B sets no blank
                b[i] = [self.blank]
            elif not blank[i]:  # without the blank that B has set before it
                b[i] = b[i][1:]
        return *_flat(a), *_flat(b)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=bounds[1:])
    return np.fromiter(chain.from_iterable(lists), np.int64, bounds[-1]), bounds


@functools.cache
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """Loaded once per worker."""
    return Tokenizers(path_a, path_b)


def cut_points(data: np.ndarray, bounds: np.ndarray, whole: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where chunks begin: at the texts that are not empty, and, but for texts that stay whole, at breaks after a word."""
    begins = np.zeros(len(data) + 1, bool)
    if len(data):
        begins[1:-1] = breaks[data[1:]] & ~SPACES[data[:-1]]
    for i in np.flatnonzero(whole):
        begins[bounds[i] : bounds[i + 1]] = False
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    begins[-1] = False
    return np.flatnonzero(begins)


def joined(strings: pa.Array, bounds: np.ndarray, between: str) -> pa.Array:
    """Strings of each run joined; a run with a null is null."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), strings), pa.scalar(between, strings.type))


def gathered(bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items of runs ``which``, one run after the other, and the new bounds."""
    sizes = np.diff(bounds)[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return np.repeat(bounds[which] - out[:-1], sizes) + np.arange(out[-1]), out


def tallied(owner: np.ndarray, value: np.ndarray, n_owners: int, n_values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds by owner, different values, and how often each comes."""
    key, times = np.unique(owner * max(n_values, 1) + value, return_counts=True)
    return np.searchsorted(key, np.arange(n_owners + 1) * max(n_values, 1)), key % max(n_values, 1), times


class Aligned:
    """Groups of some chunks. ``ok`` tells which chunks both tokenizers spell as they are; the others have no groups."""

    def __init__(self, t: Tokenizers, chunks: pa.Array):
        chunks = chunks.cast(pa.large_string())
        _, offsets, data = chunks.buffers()
        at = np.frombuffer(offsets, np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        own = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        a, a_at, b, b_at = t.encode(chunks.to_pylist())
        self.ok = np.ones(len(chunks), bool)
        for v, ids, bounds in ((t.a, a, a_at), (t.b, b, b_at)):
            self.ok &= run_totals(v.sizes[ids], bounds) == np.diff(at)
        sized = np.flatnonzero(self.ok)
        said = own[gathered(at, sized)[0]]
        for v, ids, bounds in ((t.a, a, a_at), (t.b, b, b_at)):
            unlike = v.spelled(ids[gathered(bounds, sized)[0]]) != said
            self.ok[sized] &= run_totals(unlike, gathered(at, sized)[1]) == 0
        good = np.flatnonzero(self.ok)
        a, b = a[gathered(a_at, good)[0]], b[gathered(b_at, good)[0]]
        self.n_a, self.n_b = np.diff(a_at) * self.ok, np.diff(b_at) * self.ok
        ends = np.cumsum(np.diff(at) * self.ok)
        common, a_cut, b_cut = groups(np.cumsum(t.a.sizes[a]), np.cumsum(t.b.sizes[b]))
        shown = pc.binary_join_element_wise(joined(t.a.shown.take(pa.array(a)), a_cut, ","), joined(t.b.shown.take(pa.array(b)), b_cut, ","), pa.scalar("|", t.a.shown.type))
        bounds = np.r_[0, np.searchsorted(common, ends, "right")]
        self.n_groups = np.diff(bounds)
        self.shown = joined(shown, bounds, ";")
        one = (np.diff(a_cut) == 1) & (np.diff(b_cut) == 1)
        head = a[a_cut[:-1]]
        plain = one & (t.same[head] == b[b_cut[:-1]])
        before = np.r_[0, np.cumsum(plain)]
        #: A ids of the groups that the identity map names, by chunk; the other groups, as numbers into ``others``.
        self.plain, self.plain_at = head[plain], before[bounds]
        rest = shown.filter(pa.array(~plain)).dictionary_encode()
        self.others = rest.dictionary
        self.rest, self.rest_at = rest.indices.to_numpy().astype(np.int64), bounds - before[bounds]


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets at which tokens of both end, and the bounds that they set among the tokens of A and of B."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return common, np.r_[0, np.searchsorted(a_ends, common, "right")], np.r_[0, np.searchsorted(b_ends, common, "right")]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of A and of B that overlap: a pair for each stretch between ends of either."""
    either = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, either), np.searchsorted(b_ends, either)


DOCUMENTS_DDL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "plain array<int>, plain_n array<int>, rest array<string>, rest_n array<int>"
)


def _documents(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        for batch in batches:
            for texts in slices(batch.column("text"), SLICE_BYTES):
                n = len(texts)
                own = batch.column("text").slice(texts.first, n)
                whole = pc.match_substring_regex(own.fill_null(""), UNUSUAL).to_numpy(zero_copy_only=False)
                starts = cut_points(texts.data, texts.bounds, whole, t.breaks)
                bounds = np.searchsorted(starts, texts.bounds)
                chunks = pa.LargeStringArray.from_buffers(
                    len(starts), pa.py_buffer(np.r_[starts, len(texts.data)].astype(np.int64)), pa.py_buffer(texts.data)
                )
                first = np.zeros(len(starts), bool)
                first[bounds[:-1][np.diff(bounds) > 0]] = True
                heads = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), chunks.filter(pa.array(first)), pa.scalar("", pa.large_string()))
                coded = pa.concat_arrays([heads, chunks.filter(pa.array(~first))]).dictionary_encode()
                place = np.where(first, np.cumsum(first) - 1, first.sum() + np.cumsum(~first) - 1)
                which = coded.indices.to_numpy().astype(np.int64)[place]
                found = Aligned(t, coded.dictionary)
                good = (run_totals(~found.ok[which], bounds) == 0) & (np.diff(bounds) > 0)
                total = lambda v: run_totals(v[which], bounds) * good  # noqa: E731, B023
                n_a, n_b, n_groups = total(found.n_a), total(found.n_b), total(found.n_groups)
                owner = np.repeat(np.arange(n), np.diff(bounds))
                kept = good[owner]
                which, owner = which[kept], owner[kept]
                said = joined(found.shown.take(pa.array(which)), np.searchsorted(owner, np.arange(n + 1)), ";")
                sha = [
                    hashlib.sha256(memoryview(s.as_buffer())).hexdigest() if g else ""
                    for s, g in zip(said, good.tolist(), strict=True)
                ]
                columns = [n_a, n_b, n_groups, n_a + n_b - n_groups]
                out = [batch.column("doc_id").slice(texts.first, n), *map(pa.array, columns), pa.array(sha, pa.string())]
                for values, at, size, names in (
                    (found.plain, found.plain_at, len(t.same), None),
                    (found.rest, found.rest_at, len(found.others), found.others),
                ):
                    place, cut = gathered(at, which)
                    where, value, times = tallied(np.repeat(owner, np.diff(cut)), values[place], n, size)
                    where = pa.array(where, pa.int32())
                    value = pa.array(value, pa.int32())
                    value = value if names is None else names.take(value).cast(pa.string())
                    out += [pa.ListArray.from_arrays(where, v) for v in (value, pa.array(times, pa.int32()))]
                yield pa.record_batch(out, names=[c.split()[0] for c in DOCUMENTS_DDL.split(", ")])

    return run


def _plain_counts(same: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(len(same), np.int64)
        for batch in batches:
            ids, times = (batch.column(c).flatten().to_numpy() for c in ("plain", "plain_n"))
            np.add.at(vector, ids, times)
        at = np.flatnonzero(vector)
        ids = (pa.array(v.astype(np.int32)) for v in (at, same[at]))
        yield pa.record_batch([*ids, pa.array(vector[at])], names=["a", "b", "n"])

    return run


def _pairs(path_a: str, path_b: str):
    """(group, n, a, b, times) of groups written as ``a1,a2|b1``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = pc.split_pattern(batch.column("group"), "|")
            ids, bounds, ends = [], [], []
            for k, v in enumerate((t.a, t.b)):
                parts = pc.split_pattern(pc.list_element(sides, k), ",")
                ids.append(parts.flatten().cast(pa.int64()).to_numpy())
                bounds.append(parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py())
                ends.append(np.cumsum(v.sizes[ids[k]]))
            i, j = overlaps(*ends)  # groups have as many bytes on both sides, so their ends stay level
            group = np.searchsorted(bounds[0], i, "right") - 1
            key = (group * len(t.a.tokens) + ids[0][i]) * len(t.b.tokens) + ids[1][j]
            key, times = np.unique(key, return_counts=True)
            group, pair = np.divmod(key, len(t.a.tokens) * len(t.b.tokens))
            a, b = np.divmod(pair, len(t.b.tokens))
            at = pa.array(group)
            yield pa.record_batch(
                [batch.column("group").take(at), batch.column("n").take(at), *(pa.array(v.astype(np.int32)) for v in (a, b, times))],
                names=["group", "n", "a", "b", "times"],
            )

    return run


def _plain_sums(total: np.ndarray, best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("plain")
            ids, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("plain", "plain_n"))
            bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            sums = [pa.array(run_totals(v[ids] * times, bounds)) for v in (best.astype(np.int64), total)]
            kept = [batch.column(c) for c in batch.schema.names if c not in ("plain", "plain_n")]
            yield pa.record_batch(
                [*kept, *sums], names=[*(c for c in batch.schema.names if c not in ("plain", "plain_n")), "plain_best", "plain_sum"]
            )

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every document's tokens of A and B aligned, and how common its links are over all documents.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Texts that are null or empty, or that a
    tokenizer does not spell as they are, have no tokens: zeros and ''. Repeated rows count as often as they come; an empty
    table gives no rows. Only doc_id and text are read.

    The driver holds a number per token, whatever the number of documents. A group in a large share of documents is dealt
    over many parts.
    """
    t = tokenizers(path_a, path_b)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(
        texts.mapInArrow(lean(_documents(path_a, path_b)), DOCUMENTS_DDL).withColumn("row", F.monotonically_increasing_id()),
        "aligned-documents",
    )
    plain = rows.select("plain", "plain_n").mapInArrow(lean(_plain_counts(t.same)), "a int, b int, n long")
    each = rows.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("g")).select(
        "row", F.col("g.rest").alias("group"), F.col("g.rest_n").alias("times")
    )
    kinds = written(each.groupBy("group").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("rows")), "groups")
    pairs = written(
        kinds.select("group", "n").mapInArrow(lean(_pairs(path_a, path_b)), "group string, n long, a int, b int, times int"), "pairs"
    )
    counts = written(
        pairs.select("a", "b", (F.col("n") * F.col("times")).alias("n"), F.lit(False).alias("plain"))
        .unionByName(plain.withColumn("plain", F.lit(True)))
        .groupBy("a", "b")
        .agg(F.sum("n").alias("total"), F.max("plain").alias("plain")),
        "pair-counts",
    )
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))  # at most a row per token of B
    ranked = counts.join(F.broadcast(highest), "b").select("a", "b", "total", (F.col("total") == F.col("highest")).alias("best"), "plain")
    total, best = np.zeros(len(t.same), np.int64), np.zeros(len(t.same), bool)
    for r in ranked.where("plain").collect():  # at most a row per token of A
        total[r.a], best[r.a] = r.total, r.best
    worth = written(
        keyed_join(pairs, ranked.drop("plain"), ["a", "b"], "inner")
        .groupBy("group")
        .agg(F.sum(F.col("times") * F.col("total")).alias("sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best")),
        "group-worth",
    )
    sums = (
        keyed_join(each, worth, ["group"], "inner", hot=hot_groups(kinds))
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("sum")).alias("rest_sum"), F.sum(F.col("times") * F.col("best")).alias("rest_best"))
    )
    names = ["row", *(c.split()[0] for c in DOCUMENTS_DDL.split(", ")[:6])]
    kept = rows.select(*names, "plain", "plain_n").mapInArrow(
        lean(_plain_sums(total, best)),
        "row long, " + ", ".join(DOCUMENTS_DDL.split(", ")[:6]) + ", plain_best long, plain_sum long",
    )
    return kept.join(sums, "row", "left").select(
        *names[1:6],
        (F.col("plain_best") + F.coalesce("rest_best", F.lit(0))).alias("n_best"),
        (F.col("plain_sum") + F.coalesce("rest_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def hot_groups(kinds: DataFrame) -> DataFrame:
    """Groups that hold more than 1/HOT_SHARE of all (document, group) rows, with the number of parts to deal them over."""
    total = kinds.agg(F.sum("rows").alias("n")).first().n or 0
    return kinds.where(F.col("rows") * HOT_SHARE > total).select(
        "group", F.ceil(F.col("rows") * HOT_SHARE / max(total, 1)).cast("int").alias("parts")
    )
