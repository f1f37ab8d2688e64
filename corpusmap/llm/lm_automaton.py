"""Language-model scoring with a weighted backoff automaton.

Tokens are the words of a lower-cased (A-Z) text, split at ASCII white space,
and one end per text. Unigrams are smoothed by adding ``ADD`` to every count
(one unseen word included); bigrams and trigrams use absolute discounting, and
what the discount frees is the weight of the failure arc to the shorter context.

The automaton's states are the contexts: the empty one, every word and every
pair of words of the training texts. A state's arcs are the words seen after it;
reading another word takes the failure arc to the state's suffix and adds its
weight. A text is read once from left to right: the state after two words is
their pair, and each word adds the log probability of its arc and the weights of
the failure arcs taken to reach one.

All training texts are counted and every n-gram has an arc. The automaton is cut
by the *middle* word b of the trigrams (a, b, c): the part of b holds the states
(b) and (a, b) with all their arcs, so a step from (a, b) over c, with its failure
arc to (b), never leaves the part.

Texts are read once, into chunks of about ``CHUNK_TOKENS`` tokens: a list of words and
the texts as places in it. A chunk asks each part for the steps its texts take, every
distinct one once, with the number of training texts' steps behind it -- packed, frequent
words as their ranks, sorted and compressed. The part sums what all chunks ask, builds
its arcs and failure weights from that, some middle words at a time (``SLICE_STEPS``), and
answers each chunk with the log probabilities of its steps, in the order asked. The chunk
then walks its texts from left to right over the answers. Neither an ask nor an answer
names a text, so what is sent does not grow with the number of parts.

What a part needs from elsewhere is the unigram part of words c, counted before: words
of a share of ``WORD_SHARE`` or more are broadcast (at most 1 / WORD_SHARE, whatever the
corpus), the counts of others come to the chunks by a join, and go on with what they ask.

A word with more than ``PART_TOKENS`` occurrences is split by the hash of a,
which keeps every state (a, b) whole. The counts of its own arcs, (b, c), and its
failure weight are then summed beforehand, and sent to the parts that ask for
them.

Null and empty texts are one end token. Without any training text, or in an empty
table, the counts are 0. Rows repeat as they come; a null id never trains; very
long texts are read whole. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import gc
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.common import MIX1, id_text, mix, prepare
from corpusmap.session import cut_lineage
from corpusmap.session import release as forget

ADD = 0.1
DISCOUNT = 0.75
WORD_SHARE = 2e-7
#: Tokens of a part of the automaton, about.
PART_TOKENS = 1_000_000
#: Tokens of a chunk of texts, about; a text is never cut.
CHUNK_TOKENS = 1_000_000
#: Steps of a part that are worked on at once, about: those of one middle word stay together.
SLICE_STEPS = 250_000
#: With fewer words in a chunk, a step's three places fit 64 bits.
PLACED_WORDS = 1 << 21
LEAST = 1e-9
#: No word contains a line feed.
END = b"\n"
#: In place of a neighbour that is not there.
NONE = np.uint64(0)


def box(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, compressed: the first bytes of all numbers, then the second ones, and so on."""
    head = b"".join(struct.pack("<2sI", x.dtype.str[1:].encode(), len(x)) for x in arrays)
    body = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays)
    return struct.pack("<B", len(arrays)) + head + zstandard.compress(body, 1)


def unbox(blob: bytes) -> list[np.ndarray]:
    kinds = [struct.unpack_from("<2sI", blob, 1 + 6 * k) for k in range(blob[0])]
    body, at, out = np.frombuffer(zstandard.decompress(blob[1 + 6 * len(kinds):]), np.uint8), 0, []
    for kind, size in kinds:
        kind = np.dtype(kind.decode())
        out.append(np.ascontiguousarray(body[at:at + size * kind.itemsize].reshape(kind.itemsize, size).T).view(kind).ravel())
        at += size * kind.itemsize
    return out


class Codes(dict):
    """Numbers the words it is asked for, from 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def read_chunks(rows: DataFrame) -> DataFrame:
    """texts: ids, which are null, which train, tokens of each; codes: the words of
    all tokens as places in words; words: their hashes and counts in training texts,
    the most frequent first."""
    def chunk(held: list[tuple[np.ndarray, ...]], found: Codes) -> pd.DataFrame:
        ids, no_id, trains, sizes, codes = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(-np.bincount(codes, minlength=len(found)), kind="stable")
        place = np.empty(len(found), np.int32)
        place[order] = np.arange(len(found), dtype=np.int32)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))[order]
        codes = place[codes]
        counts = np.bincount(codes, np.repeat(trains, sizes), len(found)).astype(np.int64)
        return pd.DataFrame({"texts": [box(ids, no_id, trains, sizes)], "codes": [box(codes)], "words": [box(hashes, counts)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, found, size = [], Codes(), 0
        for b in batches:
            if not len(b):
                continue
            flat, sizes = [], np.empty(len(b), np.int32)
            for k, text in enumerate(b["text"]):
                words = text.encode().lower().split()
                sizes[k] = len(words) + 1
                flat += words
                flat.append(END)
            held.append((b["id"].to_numpy(np.int64), b["no_id"].to_numpy(bool), b["trains"].to_numpy(bool), sizes,
                         np.fromiter(map(found.__getitem__, flat), np.int32, len(flat))))
            size += len(flat)
            if size >= CHUNK_TOKENS:
                yield chunk(held, found)
                held, found, size = [], Codes(), 0
        if held:
            yield chunk(held, found)

    return rows.mapInPandas(run, "texts binary, codes binary, words binary")


def count_words(chunks: DataFrame) -> DataFrame:
    """(key, c): how often each word is in training texts."""
    def run(batches):
        for b in batches:
            for words in b["words"]:
                hashes, counts = unbox(words)
                yield pd.DataFrame({"key": hashes.view(np.int64)[counts > 0], "n": counts[counts > 0]})
    return chunks.select("words").mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("c"))


def look_up(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in a sorted array, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Words:
    """Counts of the frequent words, by sorted hash."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, scale: float):
        order = np.argsort(words)
        self.words, self.counts, self.scale = words[order], counts[order], scale
        #: Places of the words, the most frequent first.
        self.by_rank = np.argsort(-self.counts, kind="stable").astype(np.int32)

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Rank by count, -1 for words that are not frequent."""
        if not hasattr(self, "rank"):
            self.rank = np.empty(len(self.words), np.int32)
            self.rank[self.by_rank] = np.arange(len(self.words), dtype=np.int32)
        at = look_up(self.words, hashes.astype(np.int64))
        return np.where(at < 0, -1, self.rank[at] if len(self.words) else -1)

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Training count, 0 for words that are not frequent."""
        at = look_up(self.words, hashes.astype(np.int64))
        return np.where(at < 0, 0, self.counts[at] if len(self.words) else 0)

    def log_p(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / self.scale)


def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The columns key and c of a table of bounded size."""
    t = df.select("key", "c").toArrow()
    return t["key"].to_numpy(), t["c"].to_numpy()


def splits(counts: np.ndarray, part_tokens: int) -> np.ndarray:
    """In how many a word of so many occurrences is split."""
    return 1 + counts // part_tokens


def part_of(b: np.ndarray, a: np.ndarray, split: np.ndarray, parts: int) -> np.ndarray:
    sub = np.where(split > 1, mix(a) % split.astype(np.uint64), 0).astype(np.uint64)
    return (mix(b * MIX1 + sub) % np.uint64(parts)).astype(np.int32)


def planes(codes: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, all lowest first: small numbers leave planes of zeros."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def pack(ranks: tuple[np.ndarray, ...], hashes: tuple[np.ndarray, ...], text: np.ndarray, row: np.ndarray, trains: np.ndarray,
         known: int, counts: tuple[np.ndarray, ...] | None = None) -> bytes:
    """One part's steps, sorted by the middle word's rank: ranks and hashes of the words
    (b, a, c), and a number of each (which ``row`` and ``trains`` are about). A frequent
    word is its rank, any other (rank -1) a place behind the ``known`` ranks in the blob's
    own list, which has their ``counts`` too."""
    n = len(text)
    code = np.concatenate(ranks).astype(np.int64)
    other = np.flatnonzero(code < 0)
    place, own = pd.factorize(np.concatenate(hashes)[other])
    own_counts = np.concatenate(counts)[other][first_places(place, len(own))] if counts else np.zeros(len(own))
    code[other] = place + known
    order = np.argsort(code[:n], kind="stable")             # nearly sorted: only the own words, first so far, move
    b, a, c = (code[k * n:(k + 1) * n][order] for k in range(3))
    texts, r = np.unique(text, return_inverse=True)
    step = np.diff(r[order].astype(np.int64), prepend=0)      # texts ascend within a word
    body = b"".join([own.astype("<u8").tobytes(), planes(own_counts), row[texts].astype("<i8").tobytes(), np.packbits(trains[texts]).tobytes(),
                     planes(np.diff(b, prepend=0)), planes(a), planes(c), planes(step << 1 ^ step >> 63)])
    return struct.pack("<III", n, len(own), len(texts)) + zstandard.compress(body, 1)


def unpack(blob: bytes, frequent: Words, rare: list | None = None) -> tuple[np.ndarray, ...]:
    """(a, b, c, row, trains); the blob's own words and their counts are added to ``rare``."""
    n, n_own, n_rows = struct.unpack_from("<III", blob)
    body, at = zstandard.decompress(blob[12:]), 0

    def take(kind: str, size: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, size, at)
        at += out.nbytes
        return out

    def numbers(size: int = n) -> np.ndarray:
        return np.ascontiguousarray(take("u1", 4 * size).reshape(4, size).T).view("<u4").ravel().astype(np.int64)

    own, own_counts, rows = take("<u8", n_own), numbers(n_own), take("<i8", n_rows)
    if rare is not None:
        rare.append((own.view(np.int64), own_counts))
    flag = np.unpackbits(take("u1", (n_rows + 7) // 8), count=n_rows).astype(bool)
    b, a, c = np.cumsum(numbers()), numbers(), numbers()
    step, known = numbers(), len(frequent.words)
    r = np.cumsum(step >> 1 ^ -(step & 1))

    def hashes(code: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.uint64)
        is_own = code >= known
        out[is_own] = own[code[is_own] - known]
        out[~is_own] = frequent.words[frequent.by_rank[code[~is_own]]].view(np.uint64)
        return out

    return hashes(a), hashes(b), hashes(c), rows[r], flag[r]


def first_places(code: np.ndarray, n: int) -> np.ndarray:
    """The first position of each of n codes."""
    out = np.zeros(n, np.int64)
    out[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return out


def failure(arcs: np.ndarray, lower: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """log10 weight of each of n states' failure arcs, from the probabilities of
    its arcs and those of the same words in its suffix; 0 for one without arcs."""
    left = np.maximum(1 - np.bincount(of, arcs, n), LEAST)
    rest = np.maximum(1 - np.bincount(of, lower, n), LEAST)
    return np.where(np.bincount(of, minlength=n) > 0, np.log10(left / rest), 0.0)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct keys, in 32 bits, and the keys."""
    number, distinct = pd.factorize(keys)
    return number.astype(np.int32), distinct


class Part:
    """The states and arcs of some middle words, and the steps over them.

    A step (a, b, c) was taken ``n`` times in training texts; the same one may come again.
    ``frequent`` has the counts of frequent words; ``rare`` (words ascending, counts) those
    of others; ``hot`` (b, c, count, weight) the arcs of the words that are split, with the
    failure weight of b."""

    def __init__(self, step: tuple[np.ndarray, ...], frequent: Words, rare: tuple[np.ndarray, np.ndarray],
                 hot: tuple[np.ndarray, ...], part_tokens: int):
        a, b, c, times = step
        n = len(b)
        code, words = numbered(np.concatenate([b, a, c]))
        b_of, a_of, c_of = code[:n], code[n:2 * n], code[2 * n:]
        size = len(words)
        common = frequent.count(words)
        at = look_up(rare[0], words.astype(np.int64))
        uni = (np.where(common > 0, common, np.where(at < 0, 0, rare[1][at] if len(rare[1]) else 0)) + ADD) / frequent.scale
        # the state (b): how often it was entered, its arcs and its failure weight
        entered = np.where(common > 0, common, np.bincount(b_of, times, size))
        two, pairs = numbered(b_of.astype(np.int64) * size + c_of)
        n2 = np.bincount(two, times, len(pairs))
        pair_b, pair_c = pairs // size, pairs % size
        del pairs
        own_weight = np.zeros(size)
        is_split = splits(common, part_tokens) > 1
        if is_split.any():
            given, weight = self._given(hot, words, pair_b, pair_c, size)
            n2 = np.where(is_split[pair_b], given, n2)
            own_weight = weight
        seen2 = n2 > 0
        p2 = np.where(seen2, (n2 - DISCOUNT) / np.maximum(entered[pair_b], 1), 1.0)
        weight1 = np.where(is_split, own_weight, failure(p2[seen2], uni[pair_c[seen2]], pair_b[seen2], size))
        # the state (a, b)
        has_a = a != NONE
        key = a_of.astype(np.int64)
        key *= size
        key += b_of
        key[~has_a] = -1 - b_of[~has_a]                         # (b) alone at a start
        state, key = numbered(key)
        n_states = len(key)
        entered2 = np.bincount(state, times, n_states)
        key = state.astype(np.int64)
        key *= size
        key += c_of
        del code, a_of, b_of, c_of
        three, key = numbered(key)
        n_arcs = len(key)
        del key
        place = first_places(three, n_arcs)
        of, lower, with_a = state[place], two[place], has_a[place]
        del place, state, two
        n3 = np.where(with_a, np.bincount(three, times, n_arcs), 0)
        seen3 = n3 > 0
        p3 = np.where(seen3, (n3 - DISCOUNT) / np.maximum(entered2[of], 1), 1.0)
        del n3
        weight2 = failure(p3[seen3], p2[lower[seen3]], of[seen3], n_states)
        # a step: over the arc of the longest state that has it, or the failure arcs down to the word alone
        step2 = np.where(seen2, np.log10(p2), weight1[pair_b] + np.log10(uni)[pair_c])
        log_p = np.log10(p3, out=p3)
        some = np.flatnonzero(~seen3)
        log_p[some] = np.where(with_a[some], weight2[of[some]], 0.0) + step2[lower[some]]
        #: log10 probability of each step
        self.log_p = log_p[three]

    @staticmethod
    def _given(hot, words, pair_b, pair_c, size) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the part's pairs and weights of its words, as they were sent."""
        where = pd.Index(words)
        b, c = (where.get_indexer(x.astype(np.uint64)) for x in hot[:2])
        here = (b >= 0) & (c >= 0)
        key = b[here].astype(np.int64) * size + c[here]
        order = np.argsort(key)
        at = look_up(key[order], pair_b * size + pair_c)
        given = np.where(at < 0, 0, hot[2][here][order][at] if len(order) else 0)
        weight = np.zeros(size)
        weight[b[here]] = hot[3][here]
        return given, weight


class Chunk:
    """Texts whose words' counts are known, by the most frequent words first."""

    def __init__(self, texts: bytes, codes: bytes, words: bytes, frequent: Words, parts: int, part_tokens: int):
        self.ids, self.no_id, self.trains, self.sizes = unbox(texts)
        self.codes, = unbox(codes)
        self.ranks, self.hashes, self.counts = self.vocabulary(words, frequent)
        self.split = splits(self.counts, part_tokens)
        self.parts = parts
        self.whole = part_of(self.hashes, self.hashes, np.ones_like(self.split), parts)
        # steps: all tokens but the end of a text, with the word before (at -1: none) and the one after
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        goes = np.ones(len(self.codes), bool)
        goes[ends - 1] = False
        self.at = np.flatnonzero(goes).astype(np.int32)
        before = np.roll(self.codes, 1)
        before[self.starts] = -1
        self.a, self.b, self.c = before[self.at], self.codes[self.at], self.codes[self.at + 1]

    @staticmethod
    def vocabulary(words: bytes, frequent: Words) -> tuple[np.ndarray, ...]:
        """Ranks, hashes and counts of the words, and at -1 of none."""
        steps, hashes, counts = unbox(words)
        ranks = np.cumsum(steps)
        common = frequent.by_rank[ranks]
        return (np.concatenate([ranks, np.full(len(hashes) + 1, -1)]),
                np.concatenate([frequent.words[common].view(np.uint64), hashes, [NONE]]).astype(np.uint64),
                np.concatenate([frequent.counts[common], counts, [0]]).astype(np.int64))

    def trained(self) -> np.ndarray:
        """Which steps are of training texts."""
        return np.repeat(self.trains, self.sizes)[self.at]

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, cut = self.whole[b], np.flatnonzero(self.split[b] > 1)
        if len(cut):
            out[cut] = part_of(self.hashes[b[cut]], self.hashes[a[cut]], self.split[b[cut]], self.parts)
        return out

    def split_arcs(self) -> tuple[np.ndarray, ...]:
        """b, c, part, n: the arcs (b, c) of split words, as places in the list of words, with
        the parts that need them and the training texts' steps."""
        at = np.flatnonzero(self.split[self.b] > 1)
        a, b, c, size = self.a[at], self.b[at], self.c[at], len(self.hashes)
        pair, pairs = pd.factorize(b.astype(np.int64) * size + c)
        key, keys = pd.factorize(pair * np.int64(self.parts) + self.part(a, b))
        n = np.bincount(key[self.trained()[at]], minlength=len(keys))
        b, c = np.divmod(pairs[keys // self.parts], size)
        return b.astype(np.int32), c.astype(np.int32), (keys % self.parts).astype(np.int32), n.astype(np.int64)

    def steps(self) -> tuple[np.ndarray, ...]:
        """a, b, c and part of each distinct step, by part and word b, and which one each step is."""
        size, states = len(self.hashes), None
        key = self.b.astype(np.int64)
        key *= size
        key += self.a
        key += 1
        if size >= PLACED_WORDS:
            states, key = np.unique(key, return_inverse=True)
        key *= size
        key += self.c
        order = np.argsort(key)
        key = key[order]
        new = np.diff(key, prepend=-1) > 0
        which = np.empty(len(key), np.int32)
        which[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        key = key[new]
        c = (key % size).astype(np.int32)
        key //= size
        if states is not None:
            key = states[key]
        b, a = (key // size).astype(np.int32), (key % size - 1).astype(np.int32)
        del key
        part = self.part(a, b)
        order = np.argsort(part, kind="stable").astype(np.int32)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return a[order], b[order], c[order], part[order], place[which]

    def asks(self, known: int) -> Iterator[tuple[int, bytes]]:
        a, b, c, part, which = self.steps()
        number, values = pd.factorize(np.bincount(which[self.trained()], minlength=len(part)))
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for some in map(slice, cuts[:-1], cuts[1:]):
            bac = b[some], a[some], c[some]
            of = lambda x: tuple(x[k] for k in bac)
            yield int(part[some.start]), pack(of(self.ranks), of(self.hashes), number[some], values, values > 0, known, of(self.counts))

    def scores(self, log_p: np.ndarray, frequent: Words) -> pd.DataFrame:
        """The texts, walked over the log probabilities of the distinct steps."""
        which = self.steps()[-1]
        of_token = frequent.log_p(self.counts)[self.codes]
        base = np.add.reduceat(of_token, self.starts)
        of_token[self.at + 1] = log_p[which]
        known = np.add.reduceat((self.counts > 0)[self.codes], self.starts, dtype=np.int64)
        return pd.DataFrame({"id": self.ids, "no_id": self.no_id, "n_tokens": self.sizes.astype(np.int64), "n_known": known,
                             "base_score": base, "score": np.add.reduceat(of_token, self.starts)})


def rare_words(chunks: DataFrame, shared) -> DataFrame:
    """(chunk, at, key): the words that are not frequent."""
    def run(batches):
        frequent = shared.value
        for batch in batches:
            for chunk, words in zip(batch["chunk"], batch["words"]):
                hashes, _ = unbox(words)
                at = np.flatnonzero(frequent.ranks(hashes) < 0)
                yield pd.DataFrame({"chunk": chunk, "at": at.astype(np.int32), "key": hashes[at].view(np.int64)})
    return chunks.select("chunk", "words").mapInPandas(run, "chunk long, at int, key long")


def learn_counts(chunks: DataFrame, rare: DataFrame, shared, parts: int, part_tokens: int) -> DataFrame:
    """The chunks with the counts of their words, ordered by rank, and the arcs of split
    words they need. ``rare``: chunk, at, c."""
    def run(own: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        frequent, out = shared.value, []
        for row in own.itertuples():
            (hashes, _), (codes,) = unbox(row.words), unbox(row.codes)
            ranks, counts = frequent.ranks(hashes).astype(np.int64), np.zeros(len(hashes), np.int64)
            counts[counted["at"].to_numpy(np.int64)] = counted["c"].to_numpy(np.int64)
            order = np.argsort(np.where(ranks < 0, len(frequent.words), ranks), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            few = order[ranks[order] < 0]
            steps = np.diff(ranks[order][:len(order) - len(few)], prepend=0).astype(np.int32)
            codes, words = box(place[codes]), box(steps, hashes[few], counts[few])
            arcs = Chunk(row.texts, codes, words, frequent, parts, part_tokens).split_arcs()
            out.append((row.chunk, row.texts, codes, words, box(*arcs)))
        return pd.DataFrame(out, columns=["chunk", "texts", "codes", "words", "arcs"])

    return (chunks.groupBy("chunk").cogroup(rare.groupBy("chunk"))
            .applyInPandas(run, "chunk long, texts binary, codes binary, words binary, arcs binary"))


def asks(chunks: DataFrame, shared, parts: int, part_tokens: int) -> DataFrame:
    """(part, chunk, blob): the distinct steps of a chunk, for the part of their words."""
    def run(batches):
        frequent = shared.value
        for batch in batches:
            for row in batch.itertuples():
                chunk = Chunk(row.texts, row.codes, row.words, frequent, parts, part_tokens)
                for part, blob in chunk.asks(len(frequent.words)):
                    yield pd.DataFrame({"part": [part], "chunk": [row.chunk], "blob": [blob]})
    return chunks.select("chunk", "texts", "codes", "words").mapInPandas(run, "part int, chunk long, blob binary")


def slices(b: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the steps of some middle words at a time."""
    code, words = numbered(b)
    n = np.bincount(code, minlength=len(words))
    number = ((np.cumsum(n) - n) // SLICE_STEPS).astype(np.int32)[code]
    order = np.argsort(number, kind="stable").astype(np.int32)
    return iter(np.split(order, np.flatnonzero(np.diff(number[order])) + 1))


def answers(asked: DataFrame, hot: DataFrame, shared, part_tokens: int) -> DataFrame:
    """(chunk, part, blob): the log probabilities of the steps that were asked for.
    ``hot``: part, b, c, n, weight."""
    def run(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"chunk": np.zeros(0, np.int64), "part": np.zeros(0, np.int32), "blob": []})
        frequent, rare = shared.value, []
        ends = np.cumsum([struct.unpack_from("<I", blob)[0] for blob in own["blob"]])
        step = tuple(np.empty(ends[-1], kind) for kind in (np.uint64, np.uint64, np.uint64, np.int64))
        for blob, end in zip(own["blob"], ends):
            for x, of_blob in zip(step, unpack(blob, frequent, rare)):
                x[end - len(of_blob):end] = of_blob
        few, first = np.unique(np.concatenate([x for x, _ in rare]), return_index=True)
        rare = few, np.concatenate([x for _, x in rare])[first]
        many = tuple(given[x].to_numpy() for x in ("b", "c", "n", "weight"))
        log_p = np.empty(len(step[0]))
        for some in slices(step[1]):
            log_p[some] = Part(tuple(x[some] for x in step), frequent, rare, many, part_tokens).log_p
        blobs = []
        for x in np.split(log_p, ends[:-1]):
            number, values = pd.factorize(x)
            blobs.append(box(values, number.astype(np.int32)))
        return pd.DataFrame({"chunk": own["chunk"], "part": own["part"], "blob": blobs})

    return (asked.groupBy("part").cogroup(hot.select("part", "b", "c", "n", "weight").groupBy("part"))
            .applyInPandas(run, "chunk long, part int, blob binary"))


def walk(chunks: DataFrame, answered: DataFrame, shared, parts: int, part_tokens: int) -> DataFrame:
    """The scores of the chunks' texts."""
    def run(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        log_p = [values[number] for values, number in map(unbox, given.sort_values("part")["blob"])]
        (row,) = own.itertuples()
        chunk = Chunk(row.texts, row.codes, row.words, shared.value, parts, part_tokens)
        return chunk.scores(np.concatenate([*log_p, np.zeros(0)]), shared.value)

    return (chunks.select("chunk", "texts", "codes", "words").groupBy("chunk").cogroup(answered.groupBy("chunk"))
            .applyInPandas(run, "id long, no_id boolean, n_tokens long, n_known long, base_score double, score double"))


def hot_arcs(chunks: DataFrame, counts: DataFrame, shared, scale: float) -> DataFrame:
    """(part, b, c, n, weight): the arcs of split words, for the parts that ask, with
    the failure weight of b."""
    def run(batches):
        for batch in batches:
            for words, arcs in zip(batch["words"], batch["arcs"]):
                b, c, part, n = unbox(arcs)
                _, hashes, _ = Chunk.vocabulary(words, shared.value)
                yield pd.DataFrame({"b": hashes[b].view(np.int64), "c": hashes[c].view(np.int64), "part": part, "n": n})

    asked = chunks.select("words", "arcs").mapInPandas(run, "b long, c long, part int, n long")
    # one row for each chunk, part and arc so far; sums before anything is joined
    by_part = cut_lineage(asked.groupBy("b", "c", "part").agg(F.sum("n").alias("n")), "hot-arcs")
    arcs = by_part.groupBy("b", "c").agg(F.sum("n").alias("n")).filter("n > 0")
    uni = counts.select(F.col("key").alias("c"), ((F.col("c") + ADD) / scale).alias("uni"))
    entered = counts.select(F.col("key").alias("b"), F.col("c").alias("entered"))
    arcs = cut_lineage(arcs.join(uni, "c").join(entered, "b"), "hot-counts")
    left = F.greatest(1 - F.sum((F.col("n") - DISCOUNT) / F.col("entered")), F.lit(LEAST))
    rest = F.greatest(1 - F.sum("uni"), F.lit(LEAST))
    weight = arcs.groupBy("b").agg(F.log10(left / rest).alias("weight"))
    pairs = by_part.select("part", "b", "c").join(arcs.select("b", "c", "n"), ["b", "c"], "left")
    return (pairs.join(weight, "b", "left")
            .select("part", "b", "c", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("weight", F.lit(0.0)).alias("weight")))


def release(spark) -> None:
    """Let Spark delete the shuffle files of plans that are written and gone: it
    does so when the driver's JVM has collected them, else after half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score_texts(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text",
                word_share: float = WORD_SHARE, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.
    ``train_rows`` is a condition on the column ``doc_id``."""
    spark = docs.sparkSession
    prepare(spark)
    rows = id_text(docs, id_col, text_col).withColumn("trains", F.coalesce(train_rows, F.lit(False)))
    # pandas has no null integers
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "trains", "text")
    read = cut_lineage(read_chunks(rows).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    counts = cut_lineage(count_words(read), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    release(spark)
    total, scale = int(total), float(total + ADD * (distinct + 1))
    shared = spark.sparkContext.broadcast(Words(*arrays(counts.filter(F.col("c") >= word_share * total)), scale))
    parts = max(1, -(-total // part_tokens))

    rare = rare_words(read, shared).join(counts, "key").select("chunk", "at", "c")
    chunks = cut_lineage(learn_counts(read, rare, shared, parts, part_tokens), "counted-chunks")
    forget(read)
    release(spark)
    hot = cut_lineage(hot_arcs(chunks, counts, shared, scale), "hot")
    release(spark)
    answered = answers(asks(chunks, shared, parts, part_tokens), hot, shared, part_tokens)
    scores = cut_lineage(walk(chunks, answered, shared, parts, part_tokens), "scores")
    forget(chunks, counts, hot)
    release(spark)
    return scores.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_tokens", "n_known",
                         F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
