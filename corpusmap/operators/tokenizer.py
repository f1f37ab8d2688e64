"""Ranked-merge BPE tokenisation of a text column (EMB-1).

Rules: every space becomes U+2581; the text is split into code points; the
adjacent pair with the lowest merge rank is merged repeatedly (leftmost pair on
equal rank); each final symbol maps to its vocabulary id, or -- when absent -- to one ``<0xXX>`` id per
UTF-8 byte (the unknown id when that byte token is missing too); bos/eos wrap
the sequence when enabled. No pre-tokenisation: merges may cross spaces. But a
merge only joins symbols whose touching characters some rule joins, so the text
is first cut where no rule can, and each distinct segment is merged once.

The corpus job is a ``mapInPandas`` over Arrow batches; the model is shipped
to each Python worker once through a broadcast variable.
"""

from __future__ import annotations

import json
import string
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmap.functions.text import truncate_bytes
from corpusmap.session import spread_small_input

SPACE = "▁"
CODE_BITS = 21              # a code point
NO_MERGE = 1 << 62
MEMO_LIMIT = 50_000         # distinct segments a worker remembers
MEMO_CHARS = 64             # longer segments are merged each time
ROWS = 256                  # texts a worker hands back at once


class Tokenizer(Protocol):
    """What ``tokenize_corpus`` needs from a tokenizer (the extension point a
    user plugs a real model's tokenizer into); ``BpeModel`` is one."""

    def encode(self, text: str) -> list[int]: ...


class BpeModel:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], bos: str = "<bos>",
                 eos: str = "<eos>", unk: str = "<unk>", add_bos: bool = True, add_eos: bool = True):
        self.vocab = vocab
        self.rank = {(a, b): r for r, (a, b) in enumerate(merges)}
        self.bos_id, self.eos_id, self.unk_id = vocab[bos], vocab[eos], vocab[unk]
        self.add_bos, self.add_eos = add_bos, add_eos
        # Character pairs that some merge joins, as sorted keys: only across these can symbols meet.
        self.joins = np.unique(np.array([(ord(a[-1]) << CODE_BITS) | ord(b[0]) for a, b in merges], dtype=np.int64))
        self.memo: dict[str, list[int]] = {}
        self.byte_id = [vocab.get(f"<0x{b:02X}>", self.unk_id) for b in range(256)]

    @classmethod
    def from_tokenizer_json(cls, path: str, config_path: str | None = None) -> "BpeModel":
        with open(path, encoding="utf-8") as fh:
            tj = json.load(fh)
        cfg = {}
        if config_path:
            with open(config_path, encoding="utf-8") as fh:
                cfg = json.load(fh)
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in tj["model"]["merges"]]
        return cls(tj["model"]["vocab"], merges, cfg.get("bos_token", "<bos>"), cfg.get("eos_token", "<eos>"),
                   cfg.get("unk_token", "<unk>"), cfg.get("add_bos_token", True), cfg.get("add_eos_token", True))

    def segments(self, text: str) -> list[str]:
        """The text cut between characters that no merge can join."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        if len(codes) < 2 or not len(self.joins):
            return list(text)
        pair = (codes[:-1] << CODE_BITS) | codes[1:]
        at = np.minimum(np.searchsorted(self.joins, pair), len(self.joins) - 1)
        cuts = [0, *(np.flatnonzero(self.joins[at] != pair) + 1).tolist(), len(text)]
        return [text[i:j] for i, j in zip(cuts, cuts[1:])]

    def segment_ids(self, segment: str) -> list[int]:
        """Merge one segment: always the leftmost pair of lowest rank."""
        syms, get = list(segment), self.rank.get
        ranks = [get(p, NO_MERGE) for p in zip(syms, syms[1:])]
        while ranks and (best := min(ranks)) != NO_MERGE:
            i = ranks.index(best)
            syms[i:i + 2] = [syms[i] + syms[i + 1]]
            del ranks[i]
            for k in (i - 1, i):
                if 0 <= k < len(ranks):
                    ranks[k] = get((syms[k], syms[k + 1]), NO_MERGE)
        ids: list[int] = []
        for sym in syms:
            tok = self.vocab.get(sym)
            ids += [tok] if tok is not None else [self.byte_id[b] for b in sym.encode("utf-8")]
        return ids

    def encode(self, text: str) -> list[int]:
        memo = self.memo
        ids = [self.bos_id] if self.add_bos else []
        for seg in self.segments(text.replace(" ", SPACE)):
            got = memo.get(seg)
            if got is None:
                got = self.segment_ids(seg)
                if len(seg) <= MEMO_CHARS:
                    if len(memo) >= MEMO_LIMIT:
                        memo.clear()
                    memo[seg] = got
            ids += got
        if self.add_eos:
            ids.append(self.eos_id)
        return ids


def demo_model() -> BpeModel:
    """A small rule-built model (no weights ship with this package): specials,
    the 256 byte tokens, single characters, then merges of the most common
    English letters pairwise and with the space marker, in a fixed rank order."""
    vocab: dict[str, int] = {}

    def add(t):
        if t not in vocab:
            vocab[t] = len(vocab)

    for t in ("<pad>", "<eos>", "<bos>", "<unk>"):
        add(t)
    for b in range(256):
        add(f"<0x{b:02X}>")
    for ch in string.ascii_letters + string.digits + string.punctuation + SPACE:
        add(ch)
    common = "etaoinshrdl"
    merges = []
    for a in common:
        for b in common:
            merges.append((a, b))
    for a in common:
        merges.append((SPACE, a))
    for a, b in merges:
        add(a + b)
    # second level: frequent pair + letter
    second = [(a + b, c) for a, b in merges[:40] for c in "eas"]
    for a, b in second:
        add(a + b)
    return BpeModel(vocab, merges + second)


def tokenize_corpus(df: DataFrame, key: str, text_col: str, model: Tokenizer,
                    max_tokens: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """``(key, ids array<int>, n_tokens)`` tokenised per Arrow batch. By default
    the whole text is tokenised; a model with a context window passes its
    limits (the original: ``max_bytes=32768`` cut natively before, and
    ``max_tokens=2048`` after tokenising, so ``<eos>`` is lost on long texts)."""
    bc = df.sparkSession.sparkContext.broadcast(model)
    text = truncate_bytes(text_col, max_bytes) if max_bytes else F.col(text_col)
    src = spread_small_input(df.select(key, text_col)).select(key, text.alias("_t"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                           T.StructField("n_tokens", T.IntegerType())])

    def run(batches):
        m = bc.value
        for pdf in (batch[i:i + ROWS] for batch in batches for i in range(0, len(batch), ROWS)):
            ids = [np.asarray(m.encode(t or "")[:max_tokens] if max_tokens else m.encode(t or ""), dtype=np.int32)
                   for t in pdf["_t"]]
            yield pd.DataFrame({key: pdf[key].to_numpy(), "ids": ids,
                                "n_tokens": np.asarray([len(x) for x in ids], dtype=np.int32)})

    return src.mapInPandas(run, schema=schema)


def word_tokens(df: DataFrame, key: str, text_col: str, vocab_size: int) -> DataFrame:
    """Stand-in token ids for the bag-of-tokens encoder: words ``[a-z]+`` of the
    lower-cased text, id = first four hex digits of ``md5(word)`` modulo
    ``vocab_size`` (native; writable in SQL)."""
    from corpusmap.operators.encoders import WORD_PATTERN
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD_PATTERN), 0)
    ids = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("long"),
                                              F.lit(vocab_size)).cast("int"))
    return spread_small_input(df.select(key, text_col)).select(key, ids.alias("ids"))
