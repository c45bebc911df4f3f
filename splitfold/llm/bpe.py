"""Byte-level BPE by merge replay: pieces of many texts are merged together, rank by rank.

An inverted index holds, by rank, the positions at which a pair of that rank starts, over all distinct pieces of a block of
texts. Merges in different pieces don't touch each other, so each step takes the lowest entries of the index, some thousands,
and applies of each piece the first one, in order of rank and place. A merge touches only its two neighbours, whose new pairs
join the index; entries that it made void are skipped. So each piece is merged exactly as if it were alone. Pieces of over LONG
bytes have many places of one rank and are replayed one merge at a time, from lists of places.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column

from splitfold.llm.common import scored

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes of distinct pieces replayed together, and encoded pieces that a worker keeps.
BLOCK_BYTES, KEEP = 1 << 20, 100_000
#: Index entries that a step takes at least; a larger index gives an eighth of its entries.
STEP = 1 << 12
#: Bytes from which a piece is replayed by lists. Tokens that are decoded at a time.
LONG, DECODE = 200, 1 << 20


class Replay:
    """Encodes and decodes by a rank file (lines of a base64 token and its rank)."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern).findall
        self.first = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.known: dict[str, bytes] = {}
        made = {(ranks[t[:k]] << 32 | ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pair_keys = np.array(sorted(made), np.int64)
        self.pair_ranks = np.array([made[k] for k in self.pair_keys.tolist()], np.int64)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes, self.lengths, self.offsets = np.frombuffer(b"".join(self.tokens), np.uint8), lengths, np.cumsum(lengths) - lengths

    def pair(self, a: int, b: int) -> int:
        """The rank of two adjacent tokens' merge, or -1."""
        key = a << 32 | b
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the merges of adjacent tokens, -1 for none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1) if len(self.pair_keys) else np.full(len(key), -1)

    def together(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each non-empty piece, as little-endian unsigned 32-bit integers; some thousand merges at a time."""
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends, n = np.cumsum(sizes), int(sizes.sum())
        token = np.array(self.first, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = before[ends - sizes] = -1
        starts = np.full(n, -1, np.int64)
        inner = np.flatnonzero(after >= 0)
        starts[inner] = self.merged(token[inner], token[inner + 1])
        # An entry of the index: its rank, then the place where its pair starts.
        entries = lambda at: (starts[at] << 36 | at)[starts[at] >= 0]
        index, place, first = entries(inner), (1 << 36) - 1, np.zeros(len(pieces), np.int64)
        while len(index):
            k = max(STEP, len(index) // 8)
            if k < len(index):
                index = np.partition(index, k)
            lowest, index = np.sort(index[:k]), index[k:]
            lowest = lowest[starts[lowest & place] == lowest >> 36]
            own, number = piece[lowest & place], np.arange(len(lowest))
            first[own[::-1]] = number[::-1]
            chosen = first[own] == number
            at, rank = lowest[chosen] & place, lowest[chosen] >> 36
            gone, left = after[at], before[at]
            right = after[gone]
            token[at], token[gone], starts[gone], starts[at], after[at] = rank, -1, -1, -1, right
            has = right >= 0
            before[right[has]] = at[has]
            starts[at[has]] = self.merged(rank[has], token[right[has]])
            had = left >= 0
            starts[left[had]] = self.merged(token[left[had]], rank[had])
            index = np.concatenate([index, lowest[~chosen], entries(at[has]), entries(left[had])])
        kept = token >= 0
        ids, cuts = token[kept].astype("<u4").tobytes(), (4 * np.cumsum(np.add.reduceat(kept.astype(np.int64), ends - sizes))).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each non-empty piece; one merge at a time."""
        token = [self.first[b] for p in pieces for b in p]
        n, pair = len(token), self.pair
        ends = np.cumsum([len(p) for p in pieces])
        piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]).tolist()
        last = set((ends - 1).tolist())
        after = [-1 if i in last else i + 1 for i in range(n)]
        before = [-1, *(-1 if i in last else i for i in range(n - 1))]
        starts = [-1 if after[i] < 0 else pair(token[i], token[after[i]]) for i in range(n)]
        index: dict[int, list[int]] = defaultdict(list)
        for i, rank in enumerate(starts):
            if rank >= 0:
                index[rank].append(i)
        queue = list(index)
        heapify(queue)
        while queue:
            rank = heappop(queue)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            places.reverse()
            waiting: list[int] = []
            while places:
                at = places.pop()
                if starts[at] != rank:
                    continue
                gone, token[at] = after[at], rank
                right, left = after[gone], before[at]
                token[gone], starts[gone], after[at] = -1, -1, right
                lowest = rank
                if right >= 0:
                    before[right] = at
                    new = starts[at] = pair(rank, token[right])
                    if new >= 0:
                        if new not in index:
                            heappush(queue, new)
                        index[new].append(at)
                        lowest = min(lowest, new)
                else:
                    starts[at] = -1
                if left >= 0:
                    new = starts[left] = pair(token[left], rank)
                    if new >= 0:
                        if new not in index:
                            heappush(queue, new)
                        index[new].append(left)
                        lowest = min(lowest, new)
                if lowest < rank:
                    while places and piece[places[-1]] == piece[at]:
                        waiting.append(places.pop())
            if waiting:
                index[rank].extend(waiting)
                heappush(queue, rank)
        out, at = [], 0
        for end in ends.tolist():
            out.append([t for t in token[at:end] if t >= 0])
            at = end
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that aren't known yet, in blocks; a whole piece with a rank is its own token."""
        if len(self.known) > KEEP:
            self.known = {p: x for p in pieces if (x := self.known.get(p)) is not None}
        block: list[tuple[str, bytes]] = []
        size = 0
        for p in pieces:
            if p in self.known:
                continue
            raw = p.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.known[p] = rank.to_bytes(4, "little")
                continue
            block.append((p, raw))
            size += len(raw)
            if size >= BLOCK_BYTES:
                self._flush(block)
                block, size = [], 0
        self._flush(block)

    def _flush(self, block: list[tuple[str, bytes]]) -> None:
        short, long = ([x for x in block if (len(x[1]) > LONG) == which] for which in (False, True))
        self.known.update(zip([p for p, _ in short], self.together([raw for _, raw in short]), strict=True))
        self.known.update((p, np.array(ids, "<u4").tobytes()) for (p, _), ids in zip(long, self.replay([raw for _, raw in long]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at, end in _blocks(texts):
            split = [self.split(t) for t in texts[at:end]]
            self.learn(set().union(*split))
            out += [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]
        return out

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """The bytes of each text, from what encode() gives."""
        ids = np.frombuffer(b"".join(texts), "<u4").astype(np.int64)
        parts = []
        for at in range(0, len(ids), DECODE):
            part = ids[at : at + DECODE]
            n = self.lengths[part]
            parts.append(self.bytes[np.repeat(self.offsets[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
        whole, ends = b"".join(parts), np.r_[0, np.cumsum(self.lengths[ids])][np.cumsum([len(t) // 4 for t in texts], dtype=np.int64)].tolist()
        return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _blocks(texts: list[str], chars: int = 1 << 22):
    """Ranges of texts with about so many characters; a longer text is alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts)


@lru_cache(maxsize=2)
def replay(path: str, pattern: str) -> Replay:
    return Replay(path, pattern)


def _coded(bpe: Replay, batch: pd.Series) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """(ids, decoded bytes) of texts of some megabytes at a time; a null text counts as empty."""
    texts = ["" if t is None else t for t in batch]
    for at, end in _blocks(texts):
        ids = bpe.encode(texts[at:end])
        yield ids, bpe.decode(ids)


def digests(text_col: str | Column, path: str, pattern: str) -> Column:
    """A struct of n_tokens and the digests of the encoded ids and of their decoded bytes.

    Null and empty texts have no tokens; a text of any length is encoded whole; repeated rows give equal values; an empty table
    gives no rows.
    """

    def load():
        bpe = replay(path, pattern)

        def run(batch: pd.Series) -> pd.DataFrame:
            rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(d).hexdigest()) for ids, decoded in _coded(bpe, batch) for x, d in zip(ids, decoded, strict=True)]
            return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

        return run

    return scored(text_col, SCHEMA, load)


def encoded(text_col: str | Column, path: str, pattern: str) -> Column:
    """A struct of the ids of each text and the text that they decode to; a null text gives no ids and an empty text."""

    def load():
        bpe = replay(path, pattern)

        def run(batch: pd.Series) -> pd.DataFrame:
            rows = [(np.frombuffer(x, "<u4").astype("i8"), d.decode()) for ids, decoded in _coded(bpe, batch) for x, d in zip(ids, decoded, strict=True)]
            return pd.DataFrame(rows, columns=["ids", "decoded"])

        return run

    return scored(text_col, "ids array<long>, decoded string", load)
