"""Byte-level BPE and token counts against their libraries."""

import base64
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmap.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (500, 40), (30, 10)])
def test_encode_equals_library(edge_docs, edge_rows, library, chunk, overlap):
    got = bpe.encode(edge_docs, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
    want = Counter((i, np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes()) for i, t in edge_rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want


def test_pre_token_longer_than_the_overlap(make_docs, library):
    rows = [(1, "a" * 700 + " b " + "c" * 90 + "'ll go"), (2, " " * 300 + "x" + "\n" * 200), (3, "1" * 333 + "é" * 333)]
    got = bpe.encode(make_docs(rows), RANKS, public_tokenizers.PATTERN, chunk=100, overlap=20).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {i: library.encode_ordinary(t) for i, t in rows}


def test_round_trip_and_empty_table(edge_docs, edge_rows, no_docs):
    ids = bpe.encode(edge_docs, RANKS, public_tokenizers.PATTERN)
    got = ids.select("doc_id", bpe.decode(F.col("ids"), RANKS).alias("b")).collect()
    assert Counter((r.doc_id, bytes(r.b)) for r in got) == Counter((i, (t or "").encode()) for i, t in edge_rows)
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_overlap_must_exceed_look_ahead(edge_docs):
    with pytest.raises(ValueError):
        bpe.encode(edge_docs, RANKS, public_tokenizers.PATTERN, chunk=100, overlap=4)


ODD = ["İstanbul ﬁ ǅ", "x<|endoftext|>y<|startoftext|>", "<|endoftext|", "é å J̌", "\x1c\x1d\x85  a",
       "Σας ΣΑΣ", "don't I'll we've '", "½ ² 12３", "\U0001f600\U0001f44d🏽", "a b​c", "ÀÉ ß ẞ", "﻿x"]


def test_token_counts_equal_library(make_docs, edge_rows):
    rows = edge_rows + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = make_docs(rows)
    tok = Tokenizer.from_file(WORDS)
    got = docs.select("doc_id", token_counts.count_tokens(F.col("text"), WORDS).alias("k")).collect()
    want = Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r.doc_id, r.k) for r in got) == want


def test_proven_strings_are_one_token():
    tok = Tokenizer.from_file(WORDS)
    proven = token_counts.prove_whole_tokens(WORDS)
    assert 20_000 < len(proven) < tok.get_vocab_size()
    alphabet = {c: b for b, c in enumerate(token_counts.byte_alphabet())}
    plain = []
    for t in sorted(proven)[::50]:
        raw = bytes(alphabet[c] for c in t)
        if raw.isascii() and raw.isalpha():
            plain.append(raw.decode())
    assert len(plain) > 100
    assert all(len(e.ids) == 1 for e in tok.encode_batch(plain, add_special_tokens=False))
