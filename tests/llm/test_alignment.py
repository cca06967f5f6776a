"""Token alignment against aligning whole texts one by one."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from hedgewise.llm import alignment
from hedgewise.llm.queries import tokenizer_path
from tests.llm.conftest import edge_rows, words

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain(rows):
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    signs = alignment.byte_of_sign()
    piece = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        spelled = [bytes(signs[c] for c in first.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
            docs.append((doc_id, [], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
        links = []
        i = j = 0
        while i < len(a) and j < len(b):  # tokens overlap until one of them ends
            links.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
        common = sorted(set(ends[0]) & set(ends[1]))
        places = [{c: i + 1 for i, c in enumerate(e)} for e in ends]
        cut, low = [], [0, 0]
        for c in common:
            high = [p[c] for p in places]
            cut.append("|".join(",".join(map(str, s[p:q])) for s, p, q in zip((a, b), low, high, strict=True)))
            low = high
        counts.update(links)
        docs.append((doc_id, a, b, cut, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        (
            (
                d, len(a), len(b), len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k),
                hashlib.sha256(";".join(g).encode()).hexdigest() if a else "",
            )
            for d, a, b, g, k in docs
        ),
        key=str,
    )


def found(docs):
    return sorted((tuple(r) for r in alignment.aligned(docs, A, B).collect()), key=str)


PARTS = [
    " ", "  ", "\n", "\n\n", "\t", " \n ", "\r\n", "\x0b", "\x0c", " ", "　", " ", "\x1c", "▁", "word", "Word", "it's", "don't",
    "12345", "x9", "...", "!?", "日本語", "é", "é", "ﬁ", "😀", "<s>", "</s>", "<|endoftext|>", "<unk>", "<0x41>", "_", "(a)", "\x00", "﻿",
    "the", " the", "ing", "Zürich", "ÿ", "​", ");\r\n", "a" * 40, " " * 20, "http://x.y/z?a=b",
]


def test_chunks_encode_as_whole_texts_do(spark):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randint(1, 14)))) for i in range(1500)]
    usual = [p for p in PARTS if p not in ("▁", " ", "　", " ", "\x1c")]
    rows += [(2000 + i, "".join(rng.choices(usual, k=rng.randint(1, 25)))) for i in range(1500)]
    rows += [(4000 + i, " ".join(words(rng, 60, "etaoinshrdlu"))) for i in range(60)]
    rows += [(5000, None), (5001, ""), (5002, " "), (5003, "\n"), (5004, "\t\t"), (5005, rows[0][1]), (5005, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs) == plain(rows)


def test_alignment_edges(edge, none):
    assert found(edge) == plain([(r[0], r[1]) for r in edge_rows()])
    assert found(none) == []


@pytest.mark.parametrize("ends", [([1, 3, 6], [2, 3, 6]), ([6], [1, 2, 6]), ([4, 6], [2, 6])])
def test_overlaps(ends):
    owner = [np.repeat(np.arange(len(e)), np.diff(np.r_[0, e])) for e in ends]
    i, j = alignment.overlaps(*map(np.array, ends))
    assert set(zip(i, j, strict=True)) == set(zip(*owner, strict=True)) and len(i) == len(set(zip(*owner, strict=True)))
