"""Tokens of one very long pre-token: overlapping chunks run in step, and their states are joined where they agree.

The encoding of a prefix ends in one token, the longest that may follow the encoding of the bytes before it. What comes after a
place depends on the last tokens of the ``longest`` prefixes before it alone: that is a chunk's state. Chunks begin ``WARM`` bytes
early as if the piece began there, and mostly reach the true state by their own first byte. Each chunk's map from the state before
it to the state after it is then constant, and the composition along the piece is a comparison: where the state that a
chunk was run from differs from the one the chunk before ends in, it is run again from that, until all agree. The first
chunk is right, so each round makes at least one more right, and agreement is proof. Memory is some twelve bytes a byte of the piece.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

CHUNKS, LEAST, WARM_MORE = 4096, 1024, 128
#: Steps whose candidate tokens are looked up together, and bits of the table of answers about pairs.
TOGETHER, TABLE_BITS = 32, 20
NONE = 1 << 40


class Tokens:
    """Tokens by number: bytes first, then what each merge makes, in the order of merges, so that a token's number is its rank."""

    def __init__(self, merges: list[tuple[bytes, bytes]], merged: Callable[[bytes], list[bytes]]):
        tokens = [bytes([k]) for k in range(256)] + [a + b for a, b in merges]
        number: dict[bytes, int] = {}
        for k, t in enumerate(tokens):
            number.setdefault(t, k)
        #: Whether each token is made in one way, which undoing merges rests on.
        self.sound = len(number) == len(tokens)
        own = np.arange(256)
        self.left = np.concatenate([own, [number[a] for a, _ in merges]]).astype(np.int64)
        self.right = np.concatenate([own, [number[b] for _, b in merges]]).astype(np.int64)
        keys = (self.left[256:] << 32) | self.right[256:]
        order = np.argsort(keys, kind="stable")
        self.pairs, self.ranks = keys[order], order + 256
        edges: dict[int, int] = {}  # of the tree of tokens read backwards
        ends = {0: -1}
        for t, k in number.items():
            if len(t) > 1 and merged(t) != [t]:
                continue  # its own bytes make other tokens, so it never stands anywhere
            node = 0
            for b in reversed(t):
                node = edges.setdefault((node << 8) | b, len(edges) + 1)
                ends.setdefault(node, -1)
            ends[node] = k
        self.edges = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.edges.tolist()], np.int64)
        self.token = np.array([ends[k] for k in range(len(ends))], np.int64)
        self.longest = max(map(len, number))
        self.asked = np.full(1 << TABLE_BITS, -1, np.int64)
        self.answer = np.zeros(1 << TABLE_BITS, bool)

    def walk(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes behind these by a byte, 0 where there is none."""
        key = (node << 8) | byte
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.child[at], 0)

    def undone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merges leave neighbours a, b as they are: the later of the two is undone again and again on the side where they
        touch, and no merge across may come before what was undone."""
        out, rows = np.zeros(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), NONE)
        while len(rows):
            key = (a << 32) | b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            across = np.where(self.pairs[at] == key, self.ranks[at], NONE)
            stays = across >= limit
            stays |= across == NONE
            whole = stays & (a < 256) & (b < 256)
            out[rows[whole]] = True
            on = stays & ~whole
            rows, a, b = rows[on], a[on], b[on]
            first = a > b
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.intp)
        out = self.answer[slot]
        miss = np.flatnonzero(self.asked[slot] != key)
        if len(miss):
            out[miss] = self.undone(a[miss], b[miss])
            self.asked[slot[miss]], self.answer[slot[miss]] = key[miss], out[miss]
        return out

    def candidates(self, piece: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
        """By length: the token of that length that ends with byte ``at``, -1 where there is none."""
        flat = at.ravel()
        node, found, rows = np.zeros(len(flat), np.int64), {}, np.arange(len(flat))
        for size in range(1, self.longest + 1):
            rows = rows[flat[rows] - size + 1 >= 0]
            after = self.walk(node[rows], piece[flat[rows] - size + 1].astype(np.int64))
            rows, after = rows[after > 0], after[after > 0]
            if not len(rows):
                break
            node[rows] = after
            token = self.token[after]
            if (token >= 0).any():
                found[size] = np.full(len(flat), -1, np.int64)
                found[size][rows] = token
        return {size: t.reshape(at.shape) for size, t in found.items()}

    def run(self, piece: np.ndarray, begin: np.ndarray, steps: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """Last tokens of the prefixes that end with each of a chunk's bytes, a row a chunk: ``steps`` bytes from ``begin``. seed: those of
        the ``longest`` prefixes before, -1 where the chunk stands for the piece's beginning."""
        back = seed.shape[1]
        last = np.full((len(begin), back + int(steps.max())), -1, np.int32)
        last[:, :back] = seed
        fresh = seed[:, -1] < 0
        for t0 in range(0, int(steps.max()), TOGETHER):
            width = min(TOGETHER, int(steps.max()) - t0)
            at = np.minimum(begin[:, None] + t0 + np.arange(width), len(piece) - 1)
            found = self.candidates(piece, at)
            sizes = sorted(found, reverse=True)
            for t in range(t0, t0 + width):
                open_ = steps > t
                for size in sizes:
                    token = found[size][:, t - t0]
                    rows = np.flatnonzero(open_ & (token >= 0) & ~(fresh & (size > t + 1)))
                    if not len(rows):
                        continue
                    before = last[rows, back + t - size].astype(np.int64)
                    starts = fresh[rows] & (size == t + 1)
                    fits = starts.copy()
                    ask = np.flatnonzero(~starts)
                    if len(ask):
                        fits[ask] = self.may_follow(before[ask], token[rows[ask]])
                    taken = rows[fits]
                    last[taken, back + t] = token[taken]
                    open_[taken] = False
        return last[:, back:]

    def lasts(self, piece: np.ndarray) -> np.ndarray:
        """The last token of each prefix of a piece."""
        n, back = len(piece), self.longest
        length = max(LEAST, -(-n // CHUNKS), 2 * back)
        begin = np.arange(0, n, length)
        steps = np.minimum(length, n - begin)
        warm = np.minimum(begin, 2 * back + WARM_MORE)
        ran = self.run(piece, begin - warm, steps + warm, np.full((len(begin), back), -1, np.int32))
        out, seeds = np.empty(n, np.int32), np.full((len(begin), back), -1, np.int32)
        for k in range(len(begin)):  # a copy of each chunk's own part, and of the state it was run from
            w = int(warm[k])
            out[begin[k] : begin[k] + steps[k]] = ran[k, w : w + steps[k]]
            if k:
                seeds[k] = ran[k, w - back : w]
        while True:
            ends = np.array([out[b - back : b] for b in begin[1:].tolist()], np.int32).reshape(-1, back)
            wrong = np.flatnonzero((ends != seeds[1:]).any(1)) + 1
            if not len(wrong):
                return out
            seeds[wrong] = ends[wrong - 1]
            again = self.run(piece, begin[wrong], steps[wrong], seeds[wrong])
            for row, k in zip(again, wrong.tolist(), strict=True):
                out[begin[k] : begin[k] + steps[k]] = row[: steps[k]]

    def count(self, piece: np.ndarray) -> int:
        """Tokens of a piece: those that the chain of last tokens goes back through."""
        sizes = self.sizes()[self.lasts(piece)].tolist()
        at, n = len(sizes), 0
        while at:
            at -= sizes[at - 1]
            n += 1
        return n

    def sizes(self) -> np.ndarray:
        out = np.ones(len(self.left), np.int64)
        for k in range(256, len(out)):
            out[k] = out[self.left[k]] + out[self.right[k]]
        return out
