"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes a slice of the corpus at a time, many texts or a block of a very
long one, collects its distinct words, and replays the merges over all of them
at once: an inverted index from token pair to the places of that pair is worked
off in rank order, and a merge touches only its neighbours. Texts are then
gathered from the ids of their words. Nothing is kept from slice to slice, so a
task's memory is that of one slice. No corpus-wide vocabulary goes through the
driver or one task.

Defined cases: null and empty texts have no tokens; repeated rows give equal
rows; ids decode to the very bytes of the text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from . import common

#: Characters of a slice, words of a slice and of a block of one text.
CHARS, SLICE, BLOCK = 1 << 21, 500_000, 100_000

#: Places indexed at a time.
PART = 1 << 17

KINDS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


class MergeReplay:
    """Encodes words by the ranks of a file of lines 'base64-token rank'. A pair of tokens is one number, the left one in the upper bits."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.pieces = [b""] * (max(ranks.values()) + 1)
        self.bits = len(self.pieces).bit_length()
        pairs, made = array("q"), array("q")
        for token, rank in ranks.items():
            self.pieces[rank] = token
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << self.bits | b)
                    made.append(rank)
        order = np.argsort(np.frombuffer(pairs, np.int64)) if pairs else np.zeros(0, np.int64)
        self.pairs = np.array(pairs, np.int64)[order]
        self.made = np.array(made, np.int64)[order] if pairs else np.zeros(1, np.int64)
        self.none = len(self.pieces)  # above every rank

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs and the ranks of what they make; ``none`` for a pair that makes nothing."""
        pair = (left.astype(np.int64) << self.bits) | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.made) - 1)
        fits = (self.pairs[at] == pair) & (left >= 0) & (right >= 0) if len(self.pairs) else np.zeros(len(pair), bool)
        return pair, np.where(fits, self.made[at], self.none)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word after the other, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes) + np.arange(1, len(words) + 1)  # no pair crosses -1, which stands before and after each word
        token = np.full(int(sizes.sum()) + len(words) + 1, -1, np.int32)
        inside = np.ones(len(token), bool)
        inside[0] = inside[ends] = False
        token[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        self._replay(token)
        before = np.cumsum(token >= 0)[ends]
        return token[token >= 0].astype("<u4"), np.diff(before, prepend=0)

    def _replay(self, token: np.ndarray) -> None:
        """Apply all merges to token in place; places that a merge takes become -2."""
        after, before = np.arange(1, len(token) + 1, dtype=np.int32), np.arange(-1, len(token) - 1, dtype=np.int32)
        places: dict[int, list[np.ndarray]] = {}  # the inverted index
        waiting: dict[int, list[int]] = {}  # rank to the pairs in the index that make it
        queue: list[int] = []

        def add(at, pair, rank):
            fits = rank < self.none
            at, pair, rank = at[fits], pair[fits], rank[fits]
            order = np.argsort(pair, kind="stable")
            at, pair, rank = at[order], pair[order], rank[order]
            begin = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist()] if len(at) else []
            for key, r, a, b in zip(pair[begin].tolist(), rank[begin].tolist(), begin, [*begin[1:], len(at)]):
                if key in places:
                    places[key].append(at[a:b])
                    continue
                places[key] = [at[a:b]]
                if r in waiting:
                    waiting[r].append(key)
                else:
                    waiting[r] = [key]
                    heappush(queue, r)

        for a in range(0, len(token) - 1, PART):  # in parts, so that no copy is as large as the slice
            left, right = token[a : a + PART], token[a + 1 : a + 1 + PART]
            add(np.arange(a, a + len(right), dtype=np.int32), *self._ranks(left[: len(right)], right))
        while queue:
            rank = heappop(queue)
            keys = waiting.pop(rank)
            p = np.concatenate([x for pair in keys for x in places.pop(pair)])
            p.sort()
            q = after[p]
            pair = (token[p].astype(np.int64) << self.bits) | token[q]
            fits = pair == keys[0]  # else a neighbour's merge has taken one side
            for key in keys[1:]:
                fits |= pair == key
            fits[1:] &= p[1:] != p[:-1]
            p, q = p[fits], q[fits]
            every, linked = p, p[1:] == q[:-1]
            if linked.any():  # of places that overlap, the first, third, ... merge
                at = np.arange(len(p))
                p = p[(at - np.maximum.accumulate(np.where(np.r_[False, linked], 0, at))) % 2 == 0]
                q = after[p]
            one, two, r, n = token[p], token[q], after[q], len(p)
            beside = token[r]
            token[p], token[q], after[p], before[r] = rank, -2, r, p
            left = before[p]
            pair, ranks = self._ranks(np.concatenate([token[left], token[p], token[p]]), np.concatenate([token[p], token[r], beside]))
            if (ranks > rank).all():
                add(np.concatenate([left, p]), pair[: 2 * n], ranks[: 2 * n])
                continue
            # one of these merges makes a pair that comes before the others: undo them and go on place by place
            token[p], token[q], after[p], before[r] = one, two, q, q
            for k, x in enumerate(every):
                y = after[x]
                if self._ranks(token[[x]], token[[y]])[1][0] != rank:
                    continue
                z = after[y]
                token[x], token[y], after[x], before[z] = rank, -2, z, x
                at = np.array([before[x], x])
                pair, ranks = self._ranks(token[at], token[after[at]])
                add(at, pair, ranks)
                if (ranks <= rank).any():
                    rest = every[k + 1 :]
                    add(rest, *self._ranks(token[rest], token[after[rest]]))
                    break

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class Encoder:
    """Texts to ids, a slice at a time."""

    def __init__(self, path: str, pattern: str):
        self.replay, self.pattern = MergeReplay(path), regex.compile(pattern)

    def _blocks(self, text: str):
        if len(text) < 4 * BLOCK:
            yield self.pattern.findall(text)
            return
        stream = (m.group() for m in self.pattern.finditer(text))
        while words := list(islice(stream, BLOCK)):
            yield words

    def slices(self, texts: list[str]):
        """(number of the text, ids) in order; a long text in several parts."""
        index: dict[str, int] = {}
        pieces, held = [], 0

        def flush():
            flat, sizes = self.replay.encode([w.encode() for w in index])
            starts = np.cumsum(sizes) - sizes
            for i, ix in pieces:
                n = sizes[ix]
                yield i, flat[np.repeat(starts[ix] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

        for i, text in enumerate(texts):
            for words in self._blocks(text):
                for w in set(words):
                    if w not in index:
                        index[w] = len(index)
                pieces.append((i, np.fromiter(map(index.__getitem__, words), np.int32, len(words))))
                held += len(words)
                if held >= SLICE:
                    yield from flush()
                    index.clear()
                    pieces.clear()
                    held = 0
        yield from flush()

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([ids for _, ids in self.slices([text])] or [np.zeros(0, "<u4")])


class _Row:
    """The outputs of one text, from its ids as they come."""

    def __init__(self, replay: MergeReplay, outputs: tuple[str, ...]):
        self.replay, self.outputs, self.n = replay, outputs, 0
        self.ids, self.pieces, self.sums, self.plain = [], [], hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        if "ids" in self.outputs:
            self.ids.append(ids.astype(np.int32))
        if "ids_sha256" in self.outputs:
            self.sums.update(ids.astype("<u4").tobytes())
        if "decoded" in self.outputs or "decoded_sha256" in self.outputs:
            piece = self.replay.decode(ids.tolist())
            self.plain.update(piece)
            if "decoded" in self.outputs:
                self.pieces.append(piece)

    def value(self, output: str):
        if output == "ids":
            return np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        return {"n_tokens": self.n, "ids_sha256": self.sums.hexdigest(), "decoded": b"".join(self.pieces), "decoded_sha256": self.plain.hexdigest()}[output]


def encode(docs: DataFrame, path: str, pattern: str, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id and the outputs asked for: ids, n_tokens, ids_sha256 (little-endian 32-bit), decoded (from the ids), decoded_sha256."""

    def start():
        encoder = Encoder(path, pattern)

        def made(texts):
            rows = [_Row(encoder.replay, outputs) for _ in texts]
            for i, ids in encoder.slices(texts):
                rows[i].add(ids)
            return {k: [r.value(k) for r in rows] for k in outputs}

        return made

    return common.per_text(docs, ", ".join(f"{k} {KINDS[k]}" for k in outputs), start, CHARS)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded (binary) of a table with doc_id and ids; null ids decode to nothing."""

    def run(frames):
        replay = MergeReplay(path)
        for f in frames:
            yield f[["doc_id"]].assign(decoded=[b"" if x is None else replay.decode(x) for x in f["ids"]])

    return tokens.select("doc_id", "ids").mapInPandas(run, "doc_id long, decoded binary")


def query(spark, sf_dir):
    import public_tokenizers

    return encode(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))
