"""Token counts of byte-level BPE by finite-state transducers.

Two transducers do the work. The first splits text into pre-tokens: it reads one character class a step and its
transitions say whether a pre-token begins there. A batch of texts is cut into lanes of equal length; each lane is run
from every state at once, which gives a map from the state before to the state after it; the maps compose by a parallel
prefix scan, which gives the state each lane begins in; a second run from that state marks where pre-tokens begin. The
second transducer counts tokens: it reads the bytes of a pre-token, its states hold the last token of the encoding of each
recent prefix, which decides what the tokens that may follow one another are, and each transition is annotated with the
change of the number of tokens emitted. Transitions are compiled as texts need them. A pre-token begins in the start state
whatever came before, so all pre-tokens of a slice are lanes that run in step, and the sums along them, composed by a prefix
sum, are the counts. States are told apart by what they hold, never by a hash of it.

Defined cases: a null text counts as empty: 0 bytes, 0 tokens; repeated rows are each counted; an empty table gives an empty
one; texts of any length are read whole, in slices of rows, and a pre-token of ``LONG`` bytes or more is cut into chunks whose
states are joined (``long_pieces``); other columns of the input play no part, whatever their names. A special token's string inside a text is one token and
splits the text, as the library does by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm._shared import row_slices, text_buffer
from gradeflow.llm.long_pieces import Tokens

RESULT = "struct<n_bytes:bigint,n_tokens:bigint>"
LANES = 4096
TABLE_BITS = 21
KEPT = 400_000  # states of a worker's transducer, which is compiled afresh when full
LONG = 16_384  # bytes from which a pre-token is cut into chunks of its own

# Character classes. An apostrophe that a contraction follows, and white space, are told apart by what comes next.
(LETTER, NUMBER, OTHER, PAIR, TRIPLE, SPACE_LAST, BLANK_LAST, BLANK_MORE) = range(8)
FIRST = 8  # added to the class of a text's first character
STAY = 16  # the bytes inside a character, and padding
# States: what kind of pre-token is open. CLOSED: whatever comes next begins one. ONE_MORE, TWO_MORE: inside a contraction.
CLOSED, LETTERS, NUMBERS, OTHERS, SPACE, BLANKS, ONE_MORE, TWO_MORE = range(8)
STATES = 8
NONE = 1 << 60
UNKNOWN = -(1 << 30)


def compiled_splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[class * 8 + state], and whether a pre-token begins at the character read."""
    follow = np.zeros((17, STATES), np.uint8)
    begins = np.zeros((17, STATES), bool)
    opened = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, PAIR: ONE_MORE, TRIPLE: TWO_MORE, SPACE_LAST: SPACE, BLANK_LAST: CLOSED, BLANK_MORE: BLANKS}
    goes_on = {(LETTERS, LETTER): LETTERS, (NUMBERS, NUMBER): NUMBERS, (BLANKS, BLANK_MORE): BLANKS}
    goes_on |= {(SPACE, LETTER): LETTERS, (SPACE, NUMBER): NUMBERS}
    goes_on |= {(state, c): OTHERS for state in (OTHERS, SPACE) for c in (OTHER, PAIR, TRIPLE)}
    goes_on |= {(ONE_MORE, c): CLOSED for c in range(8)} | {(TWO_MORE, c): ONE_MORE for c in range(8)}
    for c in range(8):
        for state in range(STATES):
            on = (state, c) in goes_on
            follow[c, state] = goes_on[state, c] if on else opened[c]
            begins[c, state] = not on
            follow[c + FIRST, state], begins[c + FIRST, state] = opened[c], True
    follow[STAY] = np.arange(STATES)
    return follow.ravel(), begins.ravel()


NEXT, BEGINS = compiled_splitter()


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """For each code point: LETTER, NUMBER, OTHER, or BLANK_MORE for white space."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    index = np.array(points)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK_MORE)):
        for m in regex.finditer(pattern, text):
            kinds[index[m.start() : m.end()]] = kind
    return kinds


def classes(buffer: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """The class of each byte; breaks: offsets at which a text begins, in order."""
    lead = np.flatnonzero((buffer & 0xC0) != 0x80)
    code = np.frombuffer(buffer.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(code)
    kind = character_kinds()[code]
    first = np.zeros(n + 3, bool)  # a text's first character; what lies beyond the end begins a text, too
    first[np.searchsorted(lead, breaks)] = True
    first[n:] = True
    ahead = np.append(code, [0, 0, 0])
    blank = np.append(kind == BLANK_MORE, [True] * 3)
    # white space that is followed by something else of the same text
    last = blank[:n] & ~blank[1 : n + 1] & ~first[1 : n + 1]
    kind = np.where(last, np.where(code == 32, SPACE_LAST, BLANK_LAST), kind).astype(np.uint8)
    quote = np.flatnonzero((code == 39) & ~first[1 : n + 1])
    one, two = ahead[quote + 1], ahead[quote + 2]
    kind[quote[np.isin(one, [ord(c) for c in "stmd"])]] = PAIR
    triple = np.zeros(len(quote), bool)
    for a, b in ("re", "ve", "ll"):
        triple |= (one == ord(a)) & (two == ord(b))
    kind[quote[triple & ~first[quote + 2]]] = TRIPLE
    kind[first[:n]] += FIRST
    out = np.full(len(buffer), STAY, np.uint8)
    out[lead] = kind
    return out


def beginnings(kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, by lanes whose state maps compose by prefix scan."""
    n = len(kinds)
    lanes = max(1, min(LANES, n // 64))
    length = -(-n // lanes)
    padded = np.full(lanes * length, STAY, np.uint8)
    padded[:n] = kinds
    steps = np.ascontiguousarray(padded.reshape(lanes, length).T).astype(np.intp) * STATES
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (lanes, 1))
    for row in steps:
        maps = NEXT[row[:, None] + maps]
    gap = 1
    while gap < lanes:  # after this, maps[k] leads from the state before lane 0 to that after lane k
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].astype(np.intp), axis=1)
        gap *= 2
    state = np.empty(lanes, np.uint8)
    state[0], state[1:] = CLOSED, maps[:-1, CLOSED]
    marks = np.empty((length, lanes), bool)
    for k, row in enumerate(steps):
        at = row + state
        marks[k] = BEGINS[at]
        state = NEXT[at]
    return np.flatnonzero(marks.T.ravel()[:n])


class Counter:
    """Transducer from the bytes of a pre-token to its number of tokens, compiled as needed from the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in letters}
        shown |= {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(letters)))}
        byte_of = {c: b for b, c in shown.items()}
        as_bytes = lambda s: bytes(byte_of[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}
        self.tokens = {as_bytes(t) for t in data["model"]["vocab"] if all(c in byte_of for c in t)}
        self.longest = max(map(len, self.tokens))
        self.specials = [t["content"].encode() for t in data["added_tokens"]]
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.byte = [bytes([k]) for k in range(256)]
        self.reset()

    def reset(self) -> None:
        """The start state alone: no bytes read."""
        self.states: dict[tuple[bytes, bytes], int] = {(b"", b""): 0}
        self.holds: list[tuple[bytes, bytes]] = [(b"", b"")]
        self.total = [0]  # tokens of a state's whole prefix, -1 where it holds the prefix's end alone
        self.moves: dict[int, tuple[int, int]] = {}
        # a table of transitions that many lanes look into at once; moves has them all
        self.key = np.full(1 << TABLE_BITS, -1, np.int64)
        self.next = np.zeros(1 << TABLE_BITS, np.int32)
        self.gain = np.zeros(1 << TABLE_BITS, np.int32)

    def may_follow(self, left: bytes, right: bytes) -> bool:
        """Whether the merges leave two neighbouring tokens as they are."""
        key = (left, right)
        found = self.follows.get(key)
        if found is None:
            if len(self.follows) > KEPT:
                self.follows.clear()
            found = self.follows[key] = self.merged(left + right) == [left, right]
        return found

    def merged(self, piece: bytes) -> list[bytes]:
        """Joins the pair of neighbours with the lowest rank, leftmost first, until no pair has one."""
        rank = self.rank.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        joint = [rank(pair, NONE) for pair in zip(parts, parts[1:], strict=False)]
        while joint and (low := min(joint)) < NONE:
            i = joint.index(low)
            parts[i] += parts.pop(i + 1)
            del joint[i]
            if i < len(joint):
                joint[i] = rank((parts[i], parts[i + 1]), NONE)
            if i:
                joint[i - 1] = rank((parts[i - 1], parts[i]), NONE)
        return parts

    def move(self, key: int) -> tuple[int, int]:
        """The transition from state key >> 8 by byte key & 255: the state after it, and the change of the number of tokens.
        A state holds the last bytes read, as many as a token can have, and how long the last token of each prefix is that
        ends at one of them."""
        found = self.moves.get(key)
        if found is not None:
            return found
        old = key >> 8
        read, lasts = self.holds[old]
        read += self.byte[key & 255]
        n, tokens, follows = len(read), self.tokens, self.follows
        for begin in range(max(0, n - self.longest), n):
            token = read[begin:]
            if token in tokens:
                if not begin:
                    break
                pair = (read[begin - lasts[begin - 1] : begin], token)
                fits = follows.get(pair)
                if self.may_follow(*pair) if fits is None else fits:
                    break
        lasts += self.byte[n - begin]
        cut = n > 2 * self.longest
        hold = (read[-2 * self.longest :], lasts[-2 * self.longest :]) if cut else (read, lasts)
        at, steps = begin, 1
        if self.total[old] >= 0 and not cut:  # the whole prefix is held, so its tokens can be counted
            while at > 0:
                at -= lasts[at - 1]
                steps += 1
            total, gain = steps, steps - self.total[old]
        else:  # tokens after this byte less those before it, by way of the last prefix that both go on from
            total, gain, chain, back = -1, UNKNOWN, {}, n - 1
            while back > 0:
                chain[back] = len(chain)
                back -= lasts[back - 1]
            while at > 0 and at not in chain:
                at -= lasts[at - 1]
                steps += 1
            if at in chain:  # else they meet further back than the state holds, and the piece is merged by itself
                gain = steps - chain[at]
        state = self.states.get(hold)
        if state is None:
            state = self.states[hold] = len(self.holds)
            self.holds.append(hold)
            self.total.append(total)
        self.moves[key] = found = (state, gain)
        return found

    def of_pieces(self, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each piece buffer[begin:end]: long ones by chunks, the others in groups that can't make more than ``KEPT`` states."""
        out = np.zeros(len(begin), np.int64)
        size = end - begin
        long = size >= LONG
        if long.any() and not self.long_tokens.sound:
            long[:] = False
        for k in np.flatnonzero(long).tolist():
            out[k] = self.long_tokens.count(buffer[int(begin[k]) : int(end[k])])
        short = np.flatnonzero(~long)
        whole = np.cumsum(size[short])
        if len(short) and len(self.holds) + int(whole[-1]) <= 3 * KEPT:
            groups = [short]
        else:
            groups = np.split(short, np.flatnonzero(np.diff(whole // KEPT)) + 1)
        for some in groups:
            out[some] = self.of_short(buffer, begin[some], end[some])
        return out

    @cached_property
    def long_tokens(self) -> Tokens:
        return Tokens(sorted(self.rank, key=self.rank.get), self.merged)

    def of_short(self, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of pieces that run through the transducer in step."""
        if len(self.holds) > KEPT:
            self.reset()
        order = np.argsort(begin - end, kind="stable")  # the longest first, so that those still running stand in front
        size = (end - begin)[order]
        at = begin[order].copy()
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        live = len(order)
        # of so many pieces, how many have more than k bytes
        lasting = np.searchsorted(-size, -np.arange(int(size[0]) if live else 0), side="left")
        for live in lasting.tolist():
            key = (state[:live] << 8) | buffer[at[:live]]
            slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.intp)
            miss = np.flatnonzero(self.key[slot] != key)
            after, gain = self.next[slot].astype(np.int64), self.gain[slot]
            if len(miss):
                some, back = np.unique(key[miss], return_inverse=True)
                found = np.array([self.move(k) for k in some.tolist()], np.int64).reshape(-1, 2)
                after[miss], gain[miss] = found[back, 0], found[back, 1]
                self.key[slot[miss]], self.next[slot[miss]], self.gain[slot[miss]] = key[miss], after[miss], gain[miss]
            state[:live] = after
            count[:live] += gain
            at[:live] += 1
        for k in np.flatnonzero(count < 0).tolist():
            a = int(begin[order[k]])
            count[k] = len(self.merged(buffer[a : a + int(size[k])].tobytes()))
        out = np.empty(len(order), np.int64)
        out[order] = count
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_slice(column: pa.Array, model: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text."""
    buffer, offsets = text_buffer(column)
    sizes = np.diff(offsets)
    tokens = np.zeros(len(sizes), np.int64)
    if not len(buffer):
        return sizes, tokens
    parts = [offsets[:-1][sizes > 0]]
    special = []
    data = buffer.tobytes()
    for word in model.specials:
        at = data.find(word)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            if at + len(word) <= offsets[row + 1]:
                special.append((at, at + len(word)))
                at = data.find(word, at + len(word))
            else:  # it runs across two texts
                at = data.find(word, at + 1)
    if special:
        parts += [np.array([x for s in special for x in s])]
    breaks = np.unique(np.concatenate(parts))
    breaks = breaks[breaks < len(buffer)]
    begin = beginnings(classes(buffer, breaks))
    if special:  # a special token's own pre-tokens are one token
        low, high = np.array(special).T
        inside = np.searchsorted(low, begin, side="right") - 1
        within = (inside >= 0) & (begin < high[np.maximum(inside, 0)])
        begin = np.union1d(begin[~within], low)
    end = np.append(begin[1:], len(buffer))
    counts = model.of_pieces(buffer, begin, end)
    if special:
        counts[np.isin(begin, low)] = 1
    total = np.append(0, np.cumsum(counts))
    edge = np.searchsorted(begin, offsets)
    return sizes, total[edge[1:]] - total[edge[:-1]]


def token_counts(text: Column, path: str) -> Column:
    """Column of (n_bytes, n_tokens) of whole texts."""

    @F.arrow_udf(RESULT)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = counter(path)
        for column in batches:
            found = [count_slice(column.slice(a, b - a), model) for a, b in row_slices(column)]
            sizes = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            tokens = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays([pa.array(sizes), pa.array(tokens)], ["n_bytes", "n_tokens"])

    return count(text)


def token_count_digest(documents: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: bytes, tokens, and whether the tokens exceed the limit."""
    rows = documents.select(F.col(key), token_counts(F.col(text), path).alias("found"))
    return rows.select(key, "found.n_bytes", "found.n_tokens", (F.col("found.n_tokens") > limit).alias("over_limit"))
