"""Removal of byte strings of 200 that occur twice, by refining buckets of suffixes.

Only some suffixes need sorting. Of the 153 q-grams of 48 bytes that a 200-byte string holds, the one with the smallest
hash is chosen; equal strings choose equal q-grams, so every repeated string shows as a repeated q-gram. The suffixes at
chosen q-grams are put into buckets by q-gram (about 1.3 % of all positions). Then buckets are refined, as in
bucket-pointer refinement, by sorting on identifiers of what stands at further offsets, and what is alone in its bucket
drops out at each step:

1. by the identifier of everything that any string around the q-gram can hold (152 bytes before to 200 bytes after it). A
   suffix that still has company is settled: all strings around it repeat. The rest goes on, with one suffix of each
   settled class to compare against.
2. by the identifier of the 76 bytes before the q-gram, and, as a second bucket, of the 76 bytes after it: every string
   around the q-gram holds one of the two.
3. by the identifier of the string itself, for each of its offsets, in every bucket that is left.

At every step, what shares the identifier of all that its open offsets can touch is settled there: each such suffix gives
its range and leaves, and one of the class stays for others to be compared with. So identical surroundings count once, however
many texts hold them, and only different surroundings of one string are refined further, at most two buckets a step for the
two ends of a repeated range.

Identifiers are hashes, which buckets sort by and reuse at the next step. They sum mixed words of eight bytes, so that no
pattern of bytes makes them collide, and equality is decided by 128 bits: the bucket's and the identifier's own. Exact copies
of whole texts are found first by hash: a task sends the suffixes of a text once, however often it holds it. Sorted buckets
are streamed; those of step 2 that have over ``CROWD`` classes are refined again, by identifiers of half as much more before
or after, until they are small or one string is left, so no bucket has to fit anywhere.

Defined cases: null counts as the empty text; texts under 200 bytes keep everything; repeated rows are texts of their own
and so remove one another; a null id is kept as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm._shared import row_slices, stored, text_buffer

LENGTH, GRAM = 200, 48
SLACK = LENGTH - GRAM  # bytes of a string beside its q-gram
HALF = SLACK // 2
CROWD = 8_000
ROWS = 4_000
SLICE = 1 << 19  # bytes of text whose hashes are held at once
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = "array<struct<start:bigint,end:bigint>>"


class Hash:
    """64-bit hashes of all substrings of 8 bytes or more of a buffer: sums of mixed words of 8 bytes."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.salt, self.tail = rng.integers(1, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 1 << 61)) * 8 + 5
        self.forth = self.back = np.ones(1, np.uint64)

    def prepare(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mixed word at each byte, and sums of words that stand a multiple of 8 apart."""
        rows = -(-len(buffer) // 8) + 1
        if len(self.forth) < rows:
            for name, b in (("forth", self.base), ("back", pow(self.base, -1, 1 << 64))):
                power = np.full(rows + rows // 4, np.uint64(b))
                power[0] = 1
                setattr(self, name, np.multiply.accumulate(power))
        padded = np.zeros(rows * 8 + 8, np.uint8)
        padded[: len(buffer)] = buffer
        word = mixed(np.ndarray(rows * 8, "<u8", padded, strides=(1,)) ^ self.salt)
        sums = np.zeros((rows + 1, 8), np.uint64)
        np.cumsum(word.reshape(rows, 8) * self.forth[:rows, None], axis=0, out=sums[1:])
        return word, sums.ravel()

    def of(self, state: tuple[np.ndarray, np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        word, sums = state
        size = end - begin
        whole = begin + (size & ~7)
        h = (sums[whole] - sums[begin]) * self.back[begin >> 3]
        rest = np.where(size & 7, word[np.maximum(end - 8, 0)], np.uint64(0)) * self.tail
        return mixed(h + rest + size.astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=4)
def hasher(seed: int) -> Hash:
    return Hash(seed)


def sliding(values: np.ndarray, width: int, fold: np.ufunc, fill: np.uint64) -> np.ndarray:
    """fold over values[i : i + width] for each i, as if followed by fill."""
    n = len(values)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, fill, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = fold.accumulate(grid, axis=1).ravel()
    behind = fold.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(behind[:n], ahead[width - 1 : n + width - 1])


def chosen(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the chosen q-grams, their text's number, and their hash."""
    n, first = len(buffer), hasher(1)
    count = n - GRAM + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    begins = np.arange(count)
    h = first.of(first.prepare(buffer), begins, begins + GRAM)
    np.minimum(h, TOP - np.uint64(1), out=h)
    np.maximum(h, np.uint64(1), out=h)
    least = sliding(h, SLACK + 1, np.minimum, TOP)
    whole = np.zeros(count, bool)  # where a string of a text begins
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        whole[a : max(a, b - LENGTH + 1)] = True
    least[~whole] = 0
    # a q-gram is chosen if it is the least of a string that ends at or after it: look at the strings from SLACK before it
    most = sliding(least[::-1], SLACK + 1, np.maximum, np.uint64(0))[::-1]
    at = np.flatnonzero(most == h)
    return at, np.searchsorted(offsets, at, side="right") - 1, h[at]


SUFFIX = pa.schema([("bucket", pa.int64()), ("around", pa.int64()), ("d1", pa.int64()), ("place", pa.int64())])


def distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d1, d2, text), each text once a task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        new = []
        for k in keys:
            new.append(k not in seen)
            seen.add(k)
        yield batch.filter(pa.array(new, pa.bool_()))


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d1, d2, text) to the suffixes at chosen q-grams. place: d2 and the position."""
    for batch in distinct_texts(batches):
        for low, high in row_slices(batch.column(2), SLICE):
            part = batch.slice(low, high - low)
            buffer, offsets = text_buffer(part.column(2))
            at, row, h = chosen(buffer, offsets)
            d1, d2 = (part.column(k).to_numpy() for k in (0, 1))
            begin, end = np.maximum(offsets[row], at - SLACK), np.minimum(offsets[row + 1], at + LENGTH)
            second = hasher(2)
            around = second.of(second.prepare(buffer), begin, end) + ((at - begin) * 1024 + end - at).astype(np.uint64)
            place = (d2[row] << 32) | (at - offsets[row])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), pa.array(d1[row]), pa.array(place)], schema=SUFFIX)


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in order of bucket and surroundings, to those with company: settled, and to be compared (speaks)."""
    names = ["bucket", "d1", "place", "settled", "speaks"]

    def judge(rows: np.ndarray, before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        """before, after: the neighbouring rows, if any."""
        table = np.concatenate([before, rows, after])
        bucket = table[1:, 0] == table[:-1, 0]
        same = bucket & (table[1:, 1] == table[:-1, 1])
        low, n = len(before), len(rows)
        pad = lambda x: np.concatenate([np.zeros(1 - low, bool), x, np.zeros(1 - len(after), bool)])
        bucket, same = pad(bucket), pad(same)
        b0, b1, s0, s1 = bucket[:n], bucket[1 : n + 1], same[:n], same[1 : n + 1]
        keep, settled = b0 | b1, s0 | s1
        speaks = (b0 & ~s0) | (b1 & ~s1)
        out = [rows[:, 0], rows[:, 2], rows[:, 3], settled, speaks]
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in out], names)

    none = np.zeros((0, 4), np.int64)
    before, held = none, none
    for batch in batches:
        if not len(batch):
            continue
        new = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        if len(held):
            yield judge(held, before, new[:1])
            before = held[-1:]
        held = new
    if len(held):
        yield judge(held, before, none)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges; ranges that touch are one run."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def verdict(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[list[dict], str]:
    """Removed runs, and a hash of the rest."""
    start, end = merged(start, end)
    left = np.append(0, end)
    kept = hashlib.sha256()
    for a, b in zip(left.tolist(), np.append(start, len(text)).tolist(), strict=True):
        kept.update(text[a:b])
    return [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)], kept.hexdigest()


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPEAKER = pa.struct([("bucket", pa.int64()), ("at", pa.int64()), ("settled", pa.bool_()), ("left", pa.int64()), ("around", pa.binary())])
_SETTLED = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("open", pa.string()), ("runs", _RUNS), ("kept_sha256", pa.string()), ("speakers", pa.list_(_SPEAKER))])
SETTLED = f"d1 bigint, d2 bigint, open string, runs {RUNS}, kept_sha256 string, speakers array<struct<bucket:bigint,at:bigint,settled:boolean,left:bigint,around:binary>>"


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d1, d2, text, marks) to the runs that settled suffixes remove. open: the text, where some suffix isn't settled."""
    for batch in batches:
        for low, high in row_slices(batch.column(2), SLICE):
            out = []
            for row in batch.slice(low, high - low).to_pylist():
                text = row["text"].encode()
                at = np.array([m["place"] & 0xFFFFFFFF for m in row["marks"]], np.int64)
                settled = np.array([m["settled"] for m in row["marks"]], bool)
                begin, end = np.maximum(at - SLACK, 0), np.minimum(at + LENGTH, len(text))
                speakers = [
                    {"bucket": m["bucket"], "at": p, "settled": m["settled"], "left": p - a, "around": text[a:b]}
                    for m, p, a, b in zip(row["marks"], at.tolist(), begin.tolist(), end.tolist(), strict=True)
                    if m["speaks"]
                ]
                runs, kept = verdict(text, begin[settled], end[settled])
                left = None if settled.all() else row["text"]
                out.append({"d1": row["d1"], "d2": row["d2"], "open": left, "runs": runs, "kept_sha256": kept, "speakers": speakers})
            yield pa.RecordBatch.from_pylist(out, _SETTLED)


_FOUND = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("half", pa.int64()), ("span", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("at", pa.int64()), ("settled", pa.bool_()), ("left", pa.int64()), ("around", pa.binary())])
FOUND = "d1 bigint, d2 bigint, start bigint, end bigint, half bigint, span bigint, low bigint, high bigint, at bigint, settled boolean, left bigint, around binary"


class Rows:
    """Suffixes of one or more buckets. The strings in question begin ``low`` to ``high`` bytes before the q-gram."""

    def __init__(self, table: pa.Table):
        self.table = table
        for name in ("half", "low", "high", "d1", "d2", "at", "settled", "left"):
            setattr(self, name, table[name].to_numpy())
        around = table["around"].combine_chunks().cast(pa.large_binary())
        ends = np.frombuffer(around.buffers()[1], np.int64)[around.offset : around.offset + len(around) + 1]
        buffer = np.frombuffer(around.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        self.edges = ends - ends[0]
        self.right = np.diff(self.edges) - self.left
        self.state = hasher(3).prepare(buffer)

    def ids(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the text goes from ``begin`` to ``end`` bytes after the q-gram's start, and the identifier of what stands there."""
        a, b = self.edges[:-1] + self.left + begin, self.edges[:-1] + self.left + end
        ok = (a >= self.edges[:-1]) & (b <= self.edges[1:])
        a, b = np.where(ok, a, 0), np.where(ok, b, 8)
        return ok, hasher(3).of(self.state, a, b)

    def spans(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Identifiers of all that strings from ``low`` to ``high`` bytes before the q-gram can touch, as far as the text goes."""
        before, after = np.minimum(high, self.left), np.minimum(LENGTH - low, self.right)
        return mixed(self.ids(-before, after)[1] + (before * 1024 + after).astype(np.uint64))

    def settled_by(self, span: np.ndarray) -> tuple[pa.Table, pa.RecordBatch | None]:
        """One row of each run of equal (half, span), and the ranges of those that have company there."""
        new = np.append(True, (self.half[1:] != self.half[:-1]) | (span[1:] != span[:-1]))
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(new))) > 1
        own = np.cumsum(new) - 1
        least, most = np.maximum(self.low, LENGTH - self.right), np.minimum(self.high, self.left)
        pick = np.flatnonzero(many[own] & ~self.settled & (least <= most))
        table = self.table.take(pa.array(first))
        at = table.schema.get_field_index("settled")
        table = table.set_column(at, "settled", pa.array(self.settled[first] | many))
        return table, self.found(pick, least[pick], most[pick]) if len(pick) else None

    def ranges(self) -> pa.RecordBatch | None:
        """The range that repeated strings cover for each unsettled row. All strings of one suffix hold its q-gram, so those
        that repeat cover one range: from the first to the last."""
        first, last = np.full(len(self.at), SLACK + 1), np.full(len(self.at), -1)
        for offset in range(int(self.low.min()), int(self.high.max()) + 1):
            ok, h = self.ids(-offset, LENGTH - offset)
            pick = np.flatnonzero(ok & (self.low <= offset) & (offset <= self.high))
            if not len(pick):
                continue
            sort = pick[np.lexsort((h[pick], self.half[pick]))]
            same = (self.half[sort[1:]] == self.half[sort[:-1]]) & (h[sort[1:]] == h[sort[:-1]])
            pick = sort[np.append(False, same) | np.append(same, False)]
            first[pick], last[pick] = np.minimum(first[pick], offset), offset
        pick = np.flatnonzero((last >= 0) & ~self.settled)
        return self.found(pick, first[pick], last[pick]) if len(pick) else None

    def found(self, pick: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(x) for x in (self.d1[pick], self.d2[pick], self.at[pick] - last, self.at[pick] - first + LENGTH)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(pick), f.type) for f in list(_FOUND)[4:])], schema=_FOUND)

    def split(self) -> Iterator[pa.RecordBatch]:
        """The same suffixes in two finer buckets each: every string in question either reaches the middle of their range to
        the left, or as far to the right as the middle's string does. One string in question was settled by its span."""
        middle = (self.low + self.high + 1) // 2
        for side in (0, 1):
            if side == 0:  # strings from the middle on: the bytes from there to what is known
                ok, h = self.ids(-middle, np.maximum(LENGTH - self.high, GRAM))
                low, high = middle, self.high
            else:  # strings before the middle
                ok, h = self.ids(-self.low, LENGTH - middle + 1)
                low, high = self.low, middle - 1
            pick = np.flatnonzero(ok & (self.low < self.high))
            if len(pick):
                half = mixed(mixed(self.half.view(np.uint64) * np.uint64(2) + np.uint64(side)) ^ h)
                span = self.spans(low, high)
                kept = self.table.take(pa.array(pick))
                none = pa.nulls(len(pick), pa.int64())
                new = [pa.array(x) for x in (half[pick].view(np.int64), span[pick].view(np.int64), low[pick], high[pick])]
                columns = [kept["d1"], kept["d2"], none, none, *new, kept["at"], kept["settled"], kept["left"], kept["around"]]
                yield from pa.Table.from_arrays(columns, schema=_FOUND).to_batches()


def first_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the span's identifier to rows (half, low, high, d1, d2, at, settled, left, around)."""
    for batch in batches:
        if len(batch):
            rows = Rows(pa.Table.from_batches([batch]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows.spans(rows.low, rows.high).view(np.int64))], [*batch.schema.names, "span"])


def compare(batches: Iterator[pa.RecordBatch], crowd_rows: int = CROWD, batch_rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Rows (half, span, low, high, d1, d2, at, settled, left, around) in order of half and span. Equal spans are settled, and
    one row of each stays. Buckets that then have up to ``crowd_rows`` give the ranges that repeat; the rows of larger ones
    are streamed on into finer buckets."""

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        half = table["half"].to_numpy()
        same = half[1:] == half[:-1]
        table = table.filter(pa.array(np.append(False, same) | np.append(same, False)))
        if table.num_rows and (out := Rows(table).ranges()) is not None:
            yield out

    def after(half: np.ndarray, bucket: int) -> int:
        """Where another bucket begins."""
        other = half != bucket
        return int(np.argmax(other)) if other.any() else len(half)

    held: pa.Table | None = None
    crowd = None  # the bucket that is being streamed
    for batch in _ended(batches):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < batch_rows:
                continue
        if held is None or not held.num_rows:
            continue
        held, out = Rows(held).settled_by(held["span"].to_numpy())
        if out is not None:
            yield out
        last = batch is None
        if crowd is not None:
            cut = after(held["half"].to_numpy(), crowd)
            send = cut if last or cut < held.num_rows else cut - 1  # the last class may go on
            if send:
                yield from Rows(held.slice(0, send)).split()
            held = held.slice(send)
            if cut < held.num_rows + send or last:
                crowd = None
        if crowd is None and held.num_rows:
            half = held["half"].to_numpy()
            inside = np.flatnonzero(half != half[-1])
            cut = len(half) if last else int(inside[-1]) + 1 if len(inside) else 0
            edges = np.append(np.flatnonzero(np.append(True, half[1:] != half[:-1])), len(half))
            sizes = np.diff(edges)
            big = np.repeat(sizes > crowd_rows, sizes)
            done = np.arange(len(half)) < cut
            small = held.filter(pa.array(done & ~big))
            if small.num_rows:
                yield from whole(small)
            large = held.filter(pa.array(done & big))
            if large.num_rows:
                yield from Rows(large).split()
            held = held.slice(cut)
            if held.num_rows > crowd_rows:
                crowd = half[-1]
                yield from Rows(held.slice(0, held.num_rows - 1)).split()
                held = held.slice(held.num_rows - 1)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None at their end."""
    yield from batches
    yield None


_FINAL = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("runs", _RUNS), ("kept_sha256", pa.string())])


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d1, d2, open, runs, more) to all removed runs."""
    for batch in batches:
        for low, high in row_slices(batch.column(2), SLICE):
            out = []
            for row in batch.slice(low, high - low).to_pylist():
                both = row["runs"] + (row["more"] or [])
                start, end = (np.array([r[k] for r in both], np.int64) for k in ("start", "end"))
                runs, kept = verdict(row["open"].encode(), start, end)
                out.append({"d1": row["d1"], "d2": row["d2"], "runs": runs, "kept_sha256": kept})
            yield pa.RecordBatch.from_pylist(out, _FINAL)


def text_key(text: Column) -> list[Column]:
    """95 bits that stand for a text."""
    return [
        F.xxhash64(text).alias("d1"),
        F.xxhash64(F.lit(1), text).bitwiseAND(F.lit(0x7FFFFFFF)).alias("d2"),
    ]


def repeated_runs(documents: DataFrame, key: str = "doc_id", text: str = "text", crowd_rows: int = CROWD, batch_rows: int = ROWS) -> DataFrame:
    """(key, n_bytes, runs, kept_sha256): removed byte ranges of each text, and a hash of what is left."""
    rows = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.select(*text_key(F.col("text")), "text")
    long = keyed.where(F.octet_length("text") >= LENGTH)
    ids = stored(rows.select(F.col(key), *text_key(F.col("text")), F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("all_sha256")), "texts")
    copies = ids.where(F.col("n_bytes") >= LENGTH).groupBy("d1", "d2").count().where("count > 1").select("d1", "d2")

    # step 1: buckets by q-gram, refined by all that surrounds it
    found = long.mapInArrow(suffixes, "bucket bigint, around bigint, d1 bigint, place bigint")
    sorted_ = found.repartition("bucket").sortWithinPartitions("bucket", "around")
    marks = sorted_.mapInArrow(repeated, "bucket bigint, d1 bigint, place bigint, settled boolean, speaks boolean")
    marks = marks.groupBy("d1", F.shiftright("place", 32).alias("d2")).agg(F.collect_list(F.struct("place", "bucket", "settled", "speaks")).alias("marks"))
    texts = long.mapInArrow(distinct_texts, "d1 bigint, d2 bigint, text string")
    settled = stored(texts.join(marks, ["d1", "d2"]).select("d1", "d2", "text", "marks").mapInArrow(settle, SETTLED), "settled")

    # steps 2 and 3: halves beside the q-gram, finer buckets of what is crowded, and then each string
    speakers = settled.select("d1", "d2", F.explode("speakers").alias("s")).select("d1", "d2", "s.*")
    before = F.expr(f"substring(around, cast(left as int) - {HALF} + 1, {HALF})")
    after = F.expr(f"substring(around, cast(left as int) + {GRAM} + 1, {HALF})")
    part = lambda side, low, high, beside: F.struct(F.xxhash64("bucket", F.lit(side), beside).alias("half"), F.lit(low).cast("bigint").alias("low"), F.lit(high).cast("bigint").alias("high"))
    sides = F.array(
        F.when(F.col("left") >= HALF, part(0, HALF, SLACK, before)),
        F.when(F.octet_length("around") - F.col("left") >= GRAM + HALF, part(1, 0, HALF, after)),
    )
    columns = ["half", "low", "high", "d1", "d2", "at", "settled", "left", "around"]
    halves = speakers.withColumn("h", F.explode(sides)).where("h is not null").select("h.*", *columns[3:])
    halves = halves.mapInArrow(first_spans, "half bigint, low bigint, high bigint, d1 bigint, d2 bigint, at bigint, settled boolean, left bigint, around binary, span bigint")
    step = partial(compare, crowd_rows=crowd_rows, batch_rows=batch_rows)
    more = None
    while True:
        found = stored(halves.repartition("half").sortWithinPartitions("half", "span").mapInArrow(step, FOUND), "ranges")
        ranges = found.where("around is null").select("d1", "d2", "start", "end")
        more = ranges if more is None else more.unionByName(ranges)
        halves = found.where("around is not null").select(*columns, "span")
        if halves.isEmpty():
            break
    more = more.groupBy("d1", "d2").agg(F.collect_set(F.struct("start", "end")).alias("more"))
    closed = settled.where("open is null").select("d1", "d2", "runs", "kept_sha256")
    opened = settled.where("open is not null").select("d1", "d2", "open", "runs").join(more, ["d1", "d2"], "left")
    opened = opened.mapInArrow(finish, f"d1 bigint, d2 bigint, runs {RUNS}, kept_sha256 string")
    results = closed.unionByName(opened).withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True)), allowMissingColumns=True)
    results = results.groupBy("d1", "d2").agg(F.max("runs").alias("runs"), F.max("kept_sha256").alias("kept_sha256"), F.max("copied").alias("copied"))
    joined = ids.join(results, ["d1", "d2"], "left")
    everything = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    return joined.select(
        key,
        "n_bytes",
        F.when(F.col("copied"), everything).otherwise(F.coalesce("runs", F.array().cast(RUNS))).alias("runs"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )


def dedup_digest(documents: DataFrame, key: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """One row for each document: bytes, removed bytes and runs, and a hash of what is left."""
    runs = repeated_runs(documents, key, text, **sizes)
    removed = F.aggregate("runs", F.lit(0).cast("bigint"), lambda acc, r: acc + r.end - r.start)
    return runs.select(key, "n_bytes", removed.alias("n_removed"), F.size("runs").cast("bigint").alias("n_spans"), "kept_sha256")
