"""Vector compression by product codes, whose nearest codebook entries are found by a geometric near-neighbour access tree.

A vector is cut into equal consecutive parts, and each part is replaced by the number of its nearest entry in that part's codebook
(squared distance, ties to the smaller number). Codebooks begin as the parts of the vectors of the smallest ids; each round
assigns every part and moves each entry to the floor of the mean of its parts.

The tree of a codebook: a node has up to ``DEGREE`` split points, far from one another, and the other entries below the nearest
of them. For each split point and each child, the node keeps the range of distances from the point to the child's entries. A query
measures its distance to the split points, and a child goes with its whole subtree where for some split point the range lies
strictly beyond what the best distance so far allows. Distances are integers when squared and are compared as such, ties included;
only the ranges need roots, which are rounded outward, so that rounding can keep a subtree but never lose an entry.

Spark holds the vectors: each round is one pass over the stored parts, in which a task looks up its rows and adds up its own
sums of each entry; the sums of tasks are grouped, and the driver gets the codebooks alone (``parts`` x ``entries`` rows), a size that
doesn't grow with the vectors. Trees are rebuilt by the tasks from the codebooks.

Defined cases: null vectors and those with a null, NaN or infinite component are dropped. The dimension is the commonest one that
can be cut (ties: the larger); vectors of another one, empty ones among them, keep a row with null code and error. Rows that
repeat an id are rows of their own, those of one id enter the codebooks in the order of their components, and null ids never do; fewer
vectors than entries make smaller codebooks; without any vector with an id, code and error are null and the codebooks' text is empty.
An empty table gives an empty one. Components are held at 2**59 after scaling; errors beyond a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm._shared import stored
from gradeflow.llm._vectors import BEYOND, as_long, decimals, exact_type, matrix, squared_distances, whole, whole_numbers

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
DEGREE = 16
#: Rows that are looked up at once; bounds a task's memory whatever the batch is.
ROWS = 8192


def below(squares: np.ndarray) -> np.ndarray:
    """Doubles that are not above the roots of whole numbers: two steps cover the rounding of the number and of its root."""
    return np.nextafter(np.nextafter(np.sqrt(squares.astype(float)), -np.inf), -np.inf)


def above(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.sqrt(squares.astype(float)), np.inf), np.inf)


@dataclass
class Node:
    """Split points by number of entry, ascending; for each point (row) and child (column) the range of distances; the children."""

    points: np.ndarray
    least: np.ndarray | None = None
    most: np.ndarray | None = None
    children: list[Node | None] = field(default_factory=list)


def tree(entries: np.ndarray, numbers: np.ndarray | None = None) -> Node:
    """The tree over the numbered entries: split points are chosen one by one, each the farthest from those before."""
    numbers = np.arange(len(entries)) if numbers is None else numbers
    if len(numbers) <= DEGREE:
        return Node(numbers)
    own = entries[numbers].astype(exact_type(entries))
    chosen, gap = [0], squared_distances(own, own[:1])[:, 0]
    while len(chosen) < DEGREE:
        gap = gap.copy()
        gap[chosen] = -1
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squared_distances(own, own[chosen[-1:]])[:, 0])
    chosen = np.sort(np.array(chosen))
    rest = np.setdiff1d(np.arange(len(numbers)), chosen)
    far = squared_distances(own[rest], own[chosen])
    child = far.argmin(1)
    node = Node(numbers[chosen], np.full((DEGREE, DEGREE), np.inf), np.full((DEGREE, DEGREE), -np.inf))
    for c in range(DEGREE):
        mine = child == c
        node.children.append(tree(entries, numbers[rest[mine]]) if mine.any() else None)
        if mine.any():
            node.least[:, c], node.most[:, c] = below(far[mine].min(0)), above(far[mine].max(0))
    return node


def nearest(root: Node, entries: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each query's nearest entry; of equal distances the smaller number."""
    kind = exact_type(entries, queries)
    entries, queries = entries.astype(kind), queries.astype(kind)
    sizes, reaches = (queries * queries).sum(1), (entries * entries).sum(1)
    best, found = np.full(len(queries), BEYOND[kind], kind), np.full(len(queries), len(entries))

    def visit(node: Node, rows: np.ndarray) -> None:
        far = sizes[rows, None] - 2 * (queries[rows] @ entries[node.points].T) + reaches[node.points]
        at = far.argmin(1)  # points ascend, so the first of equal ones has the smallest number
        near, number = far[np.arange(len(rows)), at], node.points[at]
        better = (near < best[rows]) | ((near == best[rows]) & (number < found[rows]))
        best[rows[better]], found[rows[better]] = near[better], number[better]
        if not node.children:
            return
        low, high = below(far), above(far)
        for first in (True, False):  # the child of the nearest point comes first, as it makes the best distance small
            for c, child in enumerate(node.children):
                some = np.flatnonzero((at == c) == first) if child else rows[:0]
                reach = above(best[rows[some]])[:, None]
                beyond = node.least[:, c] > np.nextafter(high[some] + reach, np.inf)
                within = node.most[:, c] < np.nextafter(low[some] - reach, -np.inf)
                alive = some[~(beyond | within).any(1)]
                if len(alive):
                    visit(child, rows[alive])

    visit(root, np.arange(len(queries)))
    return found, best


def looked_up(batch: pa.RecordBatch, books: list[np.ndarray], trees: list[Node]) -> Iterator[tuple[slice, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """By slices of a batch: the rows, their components, and for each part the numbers and squared distances of the nearest entries."""
    size = sum(b.shape[1] for b in books)
    for at in range(0, batch.num_rows, ROWS):
        rows = slice(at, min(at + ROWS, batch.num_rows))
        ints = matrix(batch.column("ints").slice(at, ROWS), size)
        parts = np.split(ints, len(books), axis=1)
        pairs = [nearest(t, b, p) for t, b, p in zip(trees, books, parts, strict=True)]
        yield rows, ints, [p[0] for p in pairs], [p[1] for p in pairs]


SUMS = "part int, entry int, sums array<decimal(38,0)>, n bigint"


def entry_sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's sums of the components of the parts of each entry that is used."""
    trees = [tree(b) for b in books]
    sums = [np.zeros(b.shape, object) for b in books]
    counts = [np.zeros(len(b), np.int64) for b in books]
    for batch in batches:
        for _, ints, numbers, _ in looked_up(batch, books, trees):
            for part, (rows, number) in enumerate(zip(np.split(ints, len(books), axis=1), numbers, strict=True)):
                order = np.argsort(number, kind="stable")
                used, starts, n = np.unique(number[order], return_index=True, return_counts=True)
                wide = object if max(np.abs(rows).max(initial=0), 1) > 2**62 // ROWS else np.int64
                sums[part][used] += np.add.reduceat(rows[order].astype(wide), starts, axis=0)
                counts[part][used] += n
    for part, (own, n) in enumerate(zip(sums, counts, strict=True)):
        used = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(np.arange(len(used) + 1) * own.shape[1], decimals(own[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), lists, pa.array(n[used])], ["part", "entry", "sums", "n"])


def commonest_size(kept: DataFrame, parts: int) -> int:
    """The commonest dimension that can be cut into the parts; 0 where there is none."""
    sizes = kept.groupBy(F.size("ints").alias("size")).count().where((F.col("size") > 0) & (F.col("size") % parts == 0))
    found = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def trained(kept: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id") -> list[np.ndarray]:
    """The codebooks, a matrix of integers for each part. kept: (key, ints) of which those of ``size`` components count."""
    fit = kept.where(F.size("ints") == size)
    first = fit.where(F.col(key).isNotNull()).orderBy(key, "ints").limit(entries).select("ints").collect()  # at most ``entries`` rows
    if not size or not first:
        return []
    books = np.split(np.array([r["ints"] for r in first], np.int64), parts, axis=1)
    for _ in range(rounds):
        held = [b.copy() for b in books]
        found = fit.select("ints").mapInArrow(lambda batches, held=held: entry_sums(batches, held), SUMS)
        totals = found.groupBy("part", "entry").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(size // parts)], F.sum("n").alias("n"))
        for row in totals.collect():  # one row an entry at most
            books[row["part"]][row["entry"]] = [int(row[f"s{k}"]) // row["n"] for k in range(size // parts)]
    return books


def encoded(kept: DataFrame, books: list[np.ndarray], keep: list[str]) -> DataFrame:
    """Rows of (keep, ints), all of the codebooks' dimension, as (keep, codes array<int>, error decimal(38,0))."""
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree(b) for b in books]
        for batch in batches:
            for rows, _, numbers, squares in looked_up(batch, books, trees):
                codes = np.stack(numbers, axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays((np.arange(len(codes) + 1) * len(books)).astype(np.int32), pa.array(codes.ravel()))
                own = [batch.column(c).slice(rows.start, rows.stop - rows.start) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, lists, decimals(sum(map(whole_numbers, squares)))], [*keep, "codes", "error"])

    return kept.select(*keep, "ints").mapInArrow(look_up, f"{schema}, codes array<int>, error decimal(38,0)")


def decoded(codes: Column, books: list[np.ndarray], scale: int = SCALE) -> Column:
    """The vector that codes stand for: the entries laid end to end, scaled back; null for null codes."""
    tables = [F.array(*[F.array(*[F.lit(x / scale) for x in entry.tolist()]) for entry in book]) for book in books]
    return F.concat(*[F.get(t, F.get(codes, k)) for k, t in enumerate(tables)])


def books_text(books: list[np.ndarray]) -> str:
    """All components by part, entry and position, with commas between."""
    return ",".join(str(x) for book in books for x in book.ravel().tolist())


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """((key, label, codes, error), codebooks) of every vector that isn't dropped."""
    kept = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), whole(F.col(vector), scale).alias("ints"))
    kept = stored(kept.where("ints is not null"), "parts")
    size = commonest_size(kept, parts)
    books = trained(kept, size, parts, entries, rounds)
    other = F.size("ints") != size if books else F.lit(True)
    rest = kept.where(other).select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("decimal(38,0)").alias("error"))
    return (encoded(kept.where(~other), books, ["vec_id", "label"]).unionByName(rest) if books else rest), books


def compression_digest(embeddings: DataFrame) -> DataFrame:
    coded, books = compressed(embeddings)
    coded = stored(coded, "codes")
    hexed = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))  # small: Spark broadcasts it below its own threshold, else splits hot labels
    rows = coded.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return rows.select("vec_id", hexed.alias("code"), as_long(F.col("error")).alias("error"), as_long(F.col("label_error")).alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
