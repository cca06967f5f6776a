"""Secret scans: base rules, and a character convolutional network over every candidate and its surroundings.

Candidates are long tokens that mix letters and digits. The network sees a candidate's characters with those before and
after it, in windows that overlap over its whole length; the highest logit counts. It is trained on labelled findings: what
the base rules find is labelled 1; tokens with digits that hold no candidates (numbers, addresses, versions), and candidates
made of plain words, 0; other candidates have no label. Its logits are calibrated on all labelled findings of a part that
training has not seen, and the threshold is the highest that keeps the wanted recall there.
"""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewise.llm.convnet import ConvNet, Sequences, sigmoid
from hedgewise.llm.textscan import lean, STARTS_CHAR, Texts, WORD_BY_SPACE, run_totals, slices, spans
from hedgewise.plans import written

LOG = logging.getLogger(__name__)
KINDS = ("assign", "access", "hex", "model")
#: Bytes of a candidate, before it and after it in a window that the network sees, and how far apart windows begin.
INSIDE, BEFORE, AFTER, STRIDE = 40, 20, 8, 20
WINDOW = BEFORE + INSIDE + AFTER
#: Windows that are scored at once.
WINDOWS_AT_ONCE = 4096
#: Findings of each label that are fitted on, at most; those with the least hashes.
SAMPLE = 2000
#: Of the labelled secrets kept for calibration (one part in PARTS), at least this share must reach the threshold.
RECALL, PARTS = 0.98, 4
#: Bins that calibration counts logits in, for each unit, and the logits at which the bins end.
BINS, LOGIT_MAX = 64, 100
LEAST_CANDIDATE = 16

# The base rules.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
KEYWORD_ENDS = re.compile(rb"(password|passwd|secret|token|api_?key)\Z", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_TOKEN = _DIGIT | _LETTER
_TOKEN[list(b"+/_.=-")] = True


def base_findings(texts: Texts) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of the slice, of all base rules, matches that fail dropped."""
    raw, bounds = texts.data.tobytes(), texts.bounds
    found: list[tuple[int, int, int]] = []

    def limits(at: int) -> tuple[int, int]:
        k = int(np.searchsorted(bounds, at, "right")) - 1
        return int(bounds[k]), int(bounds[k + 1])

    done = 0
    for sign in np.flatnonzero((texts.data == 0x3A) | (texts.data == 0x3D)).tolist():
        low, high = limits(sign)
        end = sign
        while end > low and raw[end - 1] == 0x20:
            end -= 1
        if end > low and raw[end - 1] in b"\"'":
            end -= 1
        word = KEYWORD_ENDS.search(raw, max(low, end - 8), end)
        if word and word.start() >= done and (match := ASSIGN.match(raw, word.start(), high)):
            done = match.end()
            if len(match[2]) >= LEAST_ASSIGN:
                found.append((0, match.start(), match.end()))
    at = raw.find(b"AKIA")
    while at >= 0:
        match = ACCESS.match(raw, at, limits(at)[1])
        if match and len(match[0]) >= LEAST_ACCESS:
            found.append((1, match.start(), match.end()))
        at = raw.find(b"AKIA", match.end() if match else at + 1)
    start, end, _ = spans(texts, _HEX[texts.data])
    for i in np.flatnonzero(end - start >= LEAST_HEX).tolist():
        found.append((2, int(start[i]), int(end[i])))
    return sorted(found, key=lambda x: (x[1], x[0]))


def candidates(texts: Texts) -> list[tuple[int, int]]:
    """Tokens of LEAST_CANDIDATE bytes or more with a digit and a letter; full stops at the end are not part of them."""
    start, end, _ = spans(texts, _TOKEN[texts.data])
    out = []
    for i in np.flatnonzero(end - start >= LEAST_CANDIDATE).tolist():
        a, b = int(start[i]), int(end[i])
        own = texts.data[a:b]
        while b > a and own[b - a - 1] == 0x2E:
            b -= 1
        own = own[: b - a]
        if len(own) >= LEAST_CANDIDATE and _DIGIT[own].any() and _LETTER[own].any():
            out.append((a, b))
    return out


def plain_tokens(texts: Texts) -> list[tuple[int, int]]:
    """Tokens between white space that hold a digit: what findings must be told from."""
    start, end, bounds = spans(texts, WORD_BY_SPACE[texts.data])
    if not len(start):
        return []
    digits = run_totals(_DIGIT[texts.data], np.stack([start, end], 1).ravel())[::2]
    return [(int(start[i]), int(end[i])) for i in np.flatnonzero(digits).tolist()]


def all_names(token: bytes) -> bool:
    """Whether every window of a token is a name."""
    return all(is_name(token[at : at + INSIDE]) for at in window_starts(0, len(token)))


def is_name(token: bytes) -> bool:
    """Whether at least half of a token is parts of three letters or more and nothing else, as in host and file names."""
    parts = re.split(rb"[^0-9A-Za-z]+", token)
    return 2 * sum(len(p) for p in parts if len(p) >= 3 and p.isalpha()) >= len(token)


def window_starts(start: int, end: int) -> list[int]:
    """Where the windows of a candidate begin: every STRIDE bytes, the last one such that it ends with the candidate."""
    last = max(start, end - INSIDE)
    return [*range(start, last, STRIDE), last]


def window(texts: Texts, start: int, end: int) -> bytes:
    """A candidate's windows, one after the other: its bytes with those around, 0 where there is none."""
    k = int(np.searchsorted(texts.bounds, start, "right")) - 1
    low, high = int(texts.bounds[k]), int(texts.bounds[k + 1])
    data, out = texts.data, []
    for at in window_starts(start, end):
        until = min(end, at + INSIDE)
        out.append(data[max(low, at - BEFORE) : at].tobytes().rjust(BEFORE, b"\0"))
        out.append(data[at:until].tobytes().ljust(INSIDE, b"\0"))
        out.append(data[until : min(high, until + AFTER)].tobytes().ljust(AFTER, b"\0"))
    return b"".join(out)


_INSIDE = np.zeros(WINDOW, np.int32)
_INSIDE[BEFORE : BEFORE + INSIDE] = 256


def sequences(windows: list[bytes]) -> Sequences:
    """Ids of characters, those of the candidate apart from those around it; 0 is no character."""
    size = len(_INSIDE)
    data = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, size).astype(np.int32)
    ids = np.where(data > 0, data + _INSIDE, 0)
    return Sequences(ids.reshape(-1, 1), np.arange(len(data) + 1) * size)


SCAN_DDL = (
    "doc_id long, n_assign long, n_access long, n_hex long, spans array<struct<kind:int,start:long,end:long>>,"
    " found array<binary>, open array<struct<start:long,end:long,window:binary>>, others array<binary>"
)
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_OPEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("window", pa.binary())])
SCAN = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("spans", pa.list_(_SPAN)),
        ("found", pa.list_(pa.binary())),
        ("open", pa.list_(_OPEN)),
        ("others", pa.list_(pa.binary())),
    ]
)


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: base spans in code points, their windows, the candidates outside them, and what is labelled 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                n = len(texts)
                rows = [([], [], [], []) for _ in range(n)]
                chars = np.zeros(len(texts.data) + 1, np.int64)
                np.cumsum(STARTS_CHAR[texts.data], out=chars[1:])

                def text_of(at: int, texts: Texts = texts) -> int:
                    return int(np.searchsorted(texts.bounds, at, "right")) - 1

                def points(k: int, a: int, b: int, chars: np.ndarray = chars, texts: Texts = texts) -> dict:
                    first = chars[texts.bounds[k]]
                    return {"start": int(chars[a] - first), "end": int(chars[b] - first)}

                taken = base_findings(texts)
                for kind, a, b in taken:
                    k = text_of(a)
                    rows[k][0].append({"kind": kind} | points(k, a, b))
                    rows[k][1].append(window(texts, a, b))
                ranges = np.array([x[1:] for x in taken], np.int64).reshape(-1, 2)
                most = np.maximum.accumulate(ranges[:, 1]) if len(ranges) else ranges[:, 1]

                def free(a: int, b: int, ranges: np.ndarray = ranges, most: np.ndarray = most) -> bool:
                    before = int(np.searchsorted(ranges[:, 0], b))  # those that begin before b
                    return not before or most[before - 1] <= a

                own = {x for x in candidates(texts) if free(*x)}
                unsure = []  # candidates without a label; what holds one has none either
                for a, b in sorted(own):
                    k = text_of(a)
                    seen = window(texts, a, b)
                    rows[k][2].append(points(k, a, b) | {"window": seen})
                    if all_names(texts.data[a:b].tobytes()):
                        rows[k][3].append(seen)
                    else:
                        unsure.append((a, b))
                spots = np.array(unsure, np.int64).reshape(-1, 2)

                def plain(a: int, b: int, spots: np.ndarray = spots) -> bool:
                    before = int(np.searchsorted(spots[:, 0], b))
                    return not before or spots[before - 1, 1] <= a

                for a, b in plain_tokens(texts):
                    if free(a, b) and (a, b) not in own and plain(a, b):
                        rows[text_of(a)][3].append(window(texts, a, b))
                kinds = [[sum(s["kind"] == kind for s in r[0]) for r in rows] for kind in range(3)]
                columns = [batch.column(0).slice(texts.first, n), *kinds, *zip(*rows, strict=True)]
                yield pa.record_batch(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, SCAN, strict=True)],
                    schema=SCAN,
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), SCAN_DDL)


class Detector:
    """The network, its threshold and, of findings kept for calibration, the shares of secrets and of others that reach it."""

    def __init__(self, net: ConvNet | None, threshold: float = 0.0, recall: float = 0.0, false_alarms: float = 0.0):
        self.net, self.threshold, self.recall, self.false_alarms = net, threshold, recall, false_alarms

    def logits(self, windows: list[bytes]) -> np.ndarray:
        """Of candidates: the highest logit of their windows."""
        data = b"".join(windows)
        step = WINDOW * WINDOWS_AT_ONCE
        z = np.concatenate([self.net.logits(sequences([data[at : at + step]])) for at in range(0, len(data), step)])
        starts = np.cumsum([0, *(len(w) // WINDOW for w in windows[:-1])])
        return np.maximum.reduceat(z, starts)

    def scores(self, windows: list[bytes]) -> np.ndarray:
        """0 to 1; a candidate counts as a secret from one half on."""
        if self.net is None or not windows:
            return np.zeros(len(windows))
        return sigmoid(self.logits(windows) - self.threshold)


def threshold(bins: np.ndarray, secrets: np.ndarray, others: np.ndarray) -> tuple[float, float, float]:
    """The highest logit that RECALL of the secrets reach, from counts by bin; the share that does, and that of the others."""
    order = np.argsort(-bins)
    bins, secrets, others = bins[order], np.cumsum(secrets[order]), np.cumsum(others[order])
    k = int(np.searchsorted(secrets, RECALL * secrets[-1] - 1e-9))
    return float(bins[k]) / BINS, float(secrets[k] / secrets[-1]), float(others[k] / max(1, others[-1]))


def fitted(scans: DataFrame) -> Detector:
    """Train on at most SAMPLE findings of each label, found anywhere in the corpus, and calibrate on all of those that are
    held out; without both labels nothing is added."""
    labelled = scans.select(F.explode("found").alias("window"), F.lit(1).alias("secret")).unionByName(
        scans.select(F.explode("others").alias("window"), F.lit(0).alias("secret"))
    )
    labelled = written(labelled.groupBy("secret", "window").agg(F.count(F.lit(1)).alias("n")), "labelled")
    part = F.xxhash64("window")
    held_out = F.pmod(part, F.lit(PARTS)) == 0
    # of a secret its beginning, of another finding any window
    place = F.when(F.col("secret") == 1, 0).otherwise(F.pmod(part, F.floor(F.length("window") / WINDOW)))
    shown = labelled.where(~held_out).withColumn("part", part)
    shown = shown.withColumn("window", F.substring("window", place.cast("int") * WINDOW + 1, F.lit(WINDOW)))
    rows = [
        r
        for secret in (1, 0)
        for r in shown.where(F.col("secret") == secret).orderBy("part", "window").limit(SAMPLE).collect()
    ]
    y = np.array([r.secret for r in rows])
    if not len(y) or y.min() == y.max():
        return Detector(None)
    windows = [bytes(r.window) for r in rows]
    rng = np.random.default_rng(11)
    # a secret is one wherever it stands: each labelled one is also shown in the surroundings of another finding, and its
    # end behind another finding's token
    where = rng.permutation(np.flatnonzero(y == 0))
    moved = [
        windows[where[i % len(where)]][:BEFORE] + w[BEFORE : BEFORE + INSIDE] + windows[where[i % len(where)]][-AFTER:]
        for i, w in enumerate(windows)
        if y[i]
    ]
    behind = [_behind(windows[where[i % len(where)]], w) for i, w in enumerate(windows) if y[i]]
    truth = np.concatenate([y, np.ones(len(moved) + len(behind), int)])
    net = ConvNet(512, 12, (3, 5, 9), 16)
    net.fit(sequences(windows + moved + behind), truth.astype(np.float32), epochs=8)
    counts = _counted(labelled.where(held_out), net)
    if not len(counts) or not counts[:, 1].any():  # hardly any findings: no secret was held out
        counts = _counted(labelled, net)
    found = Detector(net, *threshold(*counts.T))
    LOG.info("threshold %.3f: recall %.4f, false alarms %.5f", found.threshold, found.recall, found.false_alarms)
    return found


def _behind(other: bytes, secret: bytes) -> bytes:
    """The window of a token that ends with the last STRIDE bytes of a secret."""
    end = secret[BEFORE : BEFORE + INSIDE].rstrip(b"\0")[-STRIDE:]
    token = other[: BEFORE + INSIDE].rstrip(b"\0") + b"/" + end
    return token[-BEFORE - INSIDE :].rjust(BEFORE + INSIDE, b"\0") + other[-AFTER:]


def _counted(labelled: DataFrame, net: ConvNet) -> np.ndarray:
    """(bin of the logit, secrets, others) over all findings."""
    shared = labelled.sparkSession.sparkContext.broadcast(Detector(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                z = shared.value.logits(batch.column("window").to_pylist())
                bins = np.floor(np.clip(z, -LOGIT_MAX, LOGIT_MAX) * BINS).astype(np.int64)
                yield pa.record_batch([batch.column("secret"), pa.array(bins)], names=["secret", "bin"])

    bins = labelled.select("secret", "window").mapInArrow(lean(run), "secret int, bin long")
    counts = bins.groupBy("bin").agg(F.count_if(F.col("secret") == 1), F.count_if(F.col("secret") == 0))
    return np.array([tuple(r) for r in counts.collect()], np.int64)  # as many rows as bins


def _joined(found: list[dict]) -> str:
    return ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in sorted(found, key=lambda s: (s["start"], s["kind"])))


FINDINGS_DDL = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long"
)


def findings(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base rules, base_sha256, all spans, and how many the network added.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas. A null or empty text
    has none (base_sha256 is then that of the empty string); repeated rows are scanned each for itself; an empty table
    gives no rows. Candidates that touch a base span are not added again. Only doc_id and text are read.
    """
    scans = written(scanned(docs), "scans")
    shared = docs.sparkSession.sparkContext.broadcast(fitted(scans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of, open_of = batch.column("spans").to_pylist(), batch.column("open").to_pylist()
            scores = iter(shared.value.scores([x["window"] for xs in open_of for x in xs]))
            hashes, joined, added = [], [], []
            for own, others in zip(spans_of, open_of, strict=True):
                more = [{"kind": 3, "start": x["start"], "end": x["end"]} for x in others if next(scores) >= 0.5]
                hashes.append(hashlib.sha256(_joined(own).encode()).hexdigest())
                joined.append(_joined(own + more))
                added.append(len(more))
            yield pa.record_batch(
                [*batch.columns[:4], pa.array(hashes, pa.string()), pa.array(joined, pa.string()), pa.array(added, pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"],
            )

    return scans.select("doc_id", "n_assign", "n_access", "n_hex", "spans", "open").mapInArrow(lean(run), FINDINGS_DDL)


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All documents and columns, each secret's span in the text replaced by ``mark``; touching spans become one.

    ``n_chars``, where there is one, is the new text's. A null text stays null.
    """
    scans = written(scanned(docs.select("doc_id", "text")), "scans")
    shared = docs.sparkSession.sparkContext.broadcast(fitted(scans))
    place = docs.columns.index("text")
    kind = docs.schema["text"].dataType

    def cut(texts: Texts) -> list[bytes]:
        found = [(a, b) for _, a, b in base_findings(texts)]
        ends = sorted(found)
        most = np.maximum.accumulate([b for _, b in ends]) if ends else []
        starts = [a for a, _ in ends]
        free = [
            (a, b) for a, b in candidates(texts) if not (k := int(np.searchsorted(starts, b))) or most[k - 1] <= a
        ]
        scores = shared.value.scores([window(texts, a, b) for a, b in free])
        found += [x for x, score in zip(free, scores, strict=True) if score >= 0.5]
        raw, out = texts.data.tobytes(), []
        by_text: dict[int, list[tuple[int, int]]] = {}
        for a, b in sorted(found):
            by_text.setdefault(int(np.searchsorted(texts.bounds, a, "right")) - 1, []).append((a, b))
        for i in range(len(texts)):
            at, end = int(texts.bounds[i]), int(texts.bounds[i + 1])
            pieces, until = [], at
            for a, b in by_text.get(i, ()):
                if a >= until and (a > until or not pieces):
                    pieces += [raw[until:a], mark.encode()]
                until = max(until, b)
            out.append(b"".join([*pieces, raw[until:end]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            new = pa.array([x for texts in slices(column) for x in cut(texts)], pa.binary()).cast(pa.string())
            new = pa.compute.if_else(column.is_valid(), new, None)
            columns = batch.columns
            columns[place] = new
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.withColumn("text", F.col("text").cast("string")) if kind.simpleString() != "string" else docs
    out = out.mapInArrow(lean(run), out.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
