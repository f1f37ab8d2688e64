"""Token counts by a whole-token shortcut.

Offline, ``prove_whole_tokens`` runs the merges on every string of the
vocabulary that can stand alone and keeps those that come out as one token.
Texts are then normalised and cut into pre-tokens; a pre-token among the proven
strings counts one without any merge, and only the others are merged (each
distinct one once per worker, while the memo lasts).

Special strings of the tokenizer inside a text count one each, as the library
does by default. Null and empty texts have no tokens, repeated rows give equal
rows, and an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Strings whose characters are all below this code point are normalised and
#: cut here; for others the library's own normaliser and pre-tokeniser run.
LATIN_END = 0x250
#: Characters on whose class (space or not) regex libraries differ.
UNSURE = regex.compile("[\x1c-\x1f\x85İ]")
MEMO_LIMIT = 1_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value in byte-level
    vocabularies: printable bytes stand for themselves, the others follow from
    U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Counter(dict):
    """``pre-token (byte-level characters) -> number of tokens``."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merge = self.tok.model.tokenize
        self.proven = prove_whole_tokens(path)
        self.update(dict.fromkeys(self.proven, 1))
        specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.cut = regex.compile(split_pattern(spec))
        self.byte = byte_alphabet()
        self.latin = LatinCounter(self)

    def __missing__(self, piece: str) -> int:
        n = len(self.merge(piece))
        if len(self) < MEMO_LIMIT:
            self[piece] = n
        return n

    def segment(self, text: str) -> int:
        if text.isascii() or (ord(max(text)) < LATIN_END and unicodedata.is_normalized("NFC", text)):
            if not UNSURE.search(text):
                return sum(map(self.latin.__getitem__, self.cut.findall(text.lower())))
        norm = self.tok.normalizer.normalize_str(text)
        return sum(self[piece] for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self.segment(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.segment(p) for p in parts if p)


class LatinCounter(dict):
    """The same counts by the pre-token's own characters."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, pre_token: str) -> int:
        n = self.counter["".join(self.counter.byte[b] for b in pre_token.encode())]
        if len(self) < MEMO_LIMIT:
            self[pre_token] = n
        return n


def split_pattern(spec: dict) -> str:
    """The pattern by which the tokenizer file cuts pre-tokens."""
    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    found = [s for s in steps if s["type"] == "Split"]
    if len(found) != 1 or not (found[0]["behavior"] == "Removed" and found[0]["invert"]):
        raise ValueError("the tokenizer file has no single splitting pattern")
    return found[0]["pattern"]["Regex"]


@lru_cache(maxsize=2)
def prove_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings, without their word-end mark, that the merges turn
    into exactly one token when they stand alone."""
    from tokenizers import Tokenizer
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    merge = Tokenizer.from_file(path).model.tokenize
    alone = (t[:-len(end)] if end else t for t in model["vocab"] if t.endswith(end))
    return frozenset(t for t in alone if t and len(merge(t)) == 1)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(text: Column, path: str) -> Column:
    """Column of the number of tokens of each text (0 for null)."""
    @pandas_udf("long")
    def count(col: pd.Series) -> pd.Series:
        of = counter(path).count
        return col.map(lambda t: of(t) if t else 0).astype("int64")
    return count(text)
