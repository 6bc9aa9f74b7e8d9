"""Vector code compression: product codes from k-means with balls, exact in integers.

Components become floor(SCALE * x). Vectors are cut into PARTS equal consecutive parts; each part position has a codebook of ENTRIES,
which starts as that part of the vectors with the smallest vec_id. Each round assigns every part to its nearest entry (ties to the
lower index) and replaces each entry by the floor of the mean of its parts; entries without parts stay.

Assignment follows the balls. The parts of an entry are a ball, its radius the largest distance to the entry. Only entries closer to
it than twice the radius are neighbours. Parts within half the distance to the nearest neighbour are the stable core and keep their entry
without another look; the others lie in rings between half the distances to successive neighbours, and a ring is compared with the
neighbours inside it only. A ball that did not move and none of whose neighbours moved keeps all its parts. All tests compare integers
(4 d^2 with D^2), so the result is that of comparing all with all.

Spark scans the vectors once a round and sums in each task before anything is sent: what reaches the driver are the sums of the
PARTS * ENTRIES entries, of a size that does not depend on the number of rows. The assignment of earlier rounds is not stored but made again
in the same scan, from the codebooks so far; after the first round this touches little more than the rings.

Integers are exact at any size: a task works in 64 bits where they suffice and in unbounded integers elsewhere, and sums are sent in limbs.

Defined results: vectors that are null or hold null or non-finite components take no part. Shorter vectors, and a dimension that PARTS
does not divide, count as padded with zeros at the end. Among the first vectors, ties go to the smaller components and a null vec_id comes last;
with fewer vectors than ENTRIES the codebooks are as short. Repeated rows are kept. Errors beyond the range of long are given as its largest value.
Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.session import cut

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows handled together in a task, components of all of them at most.
ROWS = 1 << 15
CELLS = 1 << 22
#: Bits of a limb of a sum.
LIMB = 40
#: Components whose squared differences add up to less than 2^63 over a part of a million.
SMALL = 1 << 20
LARGEST = 2**63 - 1


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): int64 if all components are small, else unbounded integers."""
    if not x.size or np.abs(x).max() < SMALL / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [int(v) * SCALE if abs(v) >= 2.0**52 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


@dataclass
class Assigned:
    """One part position of a block of vectors."""

    entry: np.ndarray
    far: np.ndarray  # squared distance to the entry

    @staticmethod
    def first(points: np.ndarray, book: np.ndarray) -> Assigned:
        far = np.stack([squares(points, c) for c in book], axis=1)
        entry = far.argmin(axis=1)
        return Assigned(entry, far[np.arange(len(entry)), entry])

    def follow(self, points: np.ndarray, before: np.ndarray, book: np.ndarray) -> None:
        """Go on from the codebook `before` to `book`."""
        moved = (before != book).any(axis=1)
        if not moved.any():
            return
        between = np.stack([squares(book, c) for c in book])
        entry, far = self.entry.copy(), self.far
        for k in range(len(book)):
            ball = np.flatnonzero(self.entry == k)
            if not len(ball):
                continue
            if moved[k]:
                far[ball] = squares(points[ball], book[k])
            reach = 4 * far[ball].max()
            near = [j for j in np.argsort(between[k], kind="stable").tolist() if j != k and between[k, j] <= reach]
            if not moved[k] and not moved[near].any():
                continue  # entries that are no neighbours cannot take anything from this ball
            ring, best, at = ball, far[ball], np.full(len(ball), k)
            quarter = 4 * far[ball]
            for j in near:
                inside = quarter >= between[k, j]
                if not inside.all():  # what is left out is nearer to its entry than to this and all further neighbours
                    self._settle(entry, far, ring[~inside], at[~inside], best[~inside])
                    ring, best, at, quarter = ring[inside], best[inside], at[inside], quarter[inside]
                if not len(ring):
                    break
                other = squares(points[ring], book[j])
                better = (other < best) | ((other == best) & (j < at))
                best, at = np.where(better, other, best), np.where(better, j, at)
            self._settle(entry, far, ring, at, best)
        self.entry = entry

    @staticmethod
    def _settle(entry: np.ndarray, far: np.ndarray, rows: np.ndarray, at: np.ndarray, best: np.ndarray) -> None:
        entry[rows], far[rows] = at, best


def replay(points: np.ndarray, books: list[list[np.ndarray]]) -> list[Assigned]:
    """Assignment of each part position of `points` (rows, PARTS, width) to the last of `books`."""
    if any(book.dtype == object for round_ in books for book in round_):
        points = points.astype(object)
    out = []
    for p in range(points.shape[1]):
        own = np.ascontiguousarray(points[:, p])
        state = Assigned.first(own, books[0][p])
        for before, book in zip(books, books[1:], strict=False):
            state.follow(own, before[p], book[p])
        out.append(state)
    return out


def blocks(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows with their integer components as (rows, parts, width)."""
    held: list[pa.RecordBatch] = []
    most = max(1, min(ROWS, CELLS // (parts * width)))

    def ready() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        column = table.column("vector").combine_chunks()
        size = np.diff(column.offsets.to_numpy())
        full = np.zeros((len(size), parts * width))
        full[np.arange(parts * width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return table, whole(full).reshape(len(size), parts, width)

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            piece = batch.slice(at, most)
            if held and sum(b.num_rows for b in held) + piece.num_rows > most:
                yield ready()
                held = []
            held.append(piece)
    if held:
        yield ready()


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of the digits of a number in base 2^LIMB, with the sign of the number."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        value, digit = divmod(value, 1 << LIMB)
        if digit:
            yield place, sign * digit
        place += 1


def _sums(books: list, width: int, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for _, points in blocks(batches, width, parts):
            for p, state in enumerate(replay(points, books)):
                for k in range(len(books[0][p])):
                    own = points[state.entry == k, p]
                    for i, x in enumerate([len(own), *(own.sum(axis=0).tolist() if len(own) else [])]):
                        total[p, k, i] = total.get((p, k, i), 0) + int(x)
        rows = [(*key, place, digit) for key, value in total.items() for place, digit in limbs(value)]
        columns = zip(*rows, strict=True) if rows else ([],) * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32()] * 4 + [pa.int64()], strict=True)], ["part", "entry", "item", "place", "digit"])

    return run


def _codes(books: list, width: int, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, points in blocks(batches, width, parts):
            states = replay(points, books)
            entry = np.stack([s.entry for s in states], axis=1)
            far = sum(s.far for s in states)
            for batch in table.select(["vec_id", "label"]).to_batches():
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(["".join(f"{x:02x}" for x in r) for r in entry.tolist()], pa.string()), pa.array([min(int(x), LARGEST) for x in far.tolist()], pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    return run


@dataclass
class Codebooks:
    """Trained codebooks: the ones of every round, each a list of (entries, width) arrays by part position."""

    rounds: list[list[np.ndarray]]
    width: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.rounds[-1] for x in book.ravel()).encode()).hexdigest()


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector of double, label as text) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), label.alias("label"))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from the rows of `usable`; none if there is no row."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return None
    dimension = rows.agg(F.max(F.size("vector"))).first()[0]
    width = max(1, -(-dimension // parts))
    start = np.zeros((len(first), parts * width))
    for row, r in zip(start, first, strict=True):
        row[: len(r.vector)] = r.vector
    start = whole(start).reshape(len(first), parts, width)
    books = [[start[:, p] for p in range(parts)]]
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_sums(books, width, parts), "part int, entry int, item int, place int, digit long")
        total: dict[tuple[int, int, int], int] = {}
        for r in sums.groupBy("part", "entry", "item", "place").agg(F.sum("digit").alias("digit")).collect():
            total[r.part, r.entry, r.item] = total.get((r.part, r.entry, r.item), 0) + (r.digit << LIMB * r.place)
        new = [[[total.get((p, k, i + 1), 0) // n for i in range(width)] if (n := total.get((p, k, 0), 0)) else books[-1][p][k].tolist() for k in range(len(first))] for p in range(parts)]
        small = all(abs(x) < SMALL for book in new for entry in book for x in entry)
        books.append([np.array(book, np.int64 if small else object) for book in new])
    return Codebooks(books, width)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    rows = usable(vectors)
    books = train(rows, parts, entries, rounds)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    coded = cut(rows.mapInArrow(_codes(books.rounds, books.width, parts), "vec_id long, label string, code string, error long"))
    largest = F.lit(LARGEST).cast("decimal(38,0)")
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), largest).cast("long").alias("label_error"))
    joined = coded.alias("c").join(by_label.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label")))
    return joined.select("c.vec_id", "c.code", "c.error", "t.label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, for vectors of one dimension that `parts` divides and components of common size: all distances, no balls."""
    floor = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"""comp AS MATERIALIZED (SELECT r, (i - 1) // (len(embedding) // {parts}) AS p, (i - 1) % (len(embedding) // {parts}) AS d,
        CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) AS places)""",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, d, x FROM comp WHERE r <= {entries})",
    ]
    for t in range(rounds + 1):
        steps.append(f"""near{t} AS MATERIALIZED (SELECT r, p, min(far * {entries} + e) AS best FROM (
        SELECT c.r, c.p, b.e, sum((c.x - b.x) * (c.x - b.x)) AS far FROM comp c JOIN book{t} b ON c.p = b.p AND c.d = b.d GROUP BY c.r, c.p, b.e) AS all_{t} GROUP BY r, p)""")
        if t < rounds:
            steps.append(f"""book{t + 1} AS MATERIALIZED (SELECT b.p, b.e, b.d, CAST(coalesce(m.x, b.x) AS BIGINT) AS x FROM book{t} b LEFT JOIN (
            SELECT c.p, n.best % {entries} AS e, c.d, {floor} AS x FROM comp c JOIN near{t} n ON c.r = n.r AND c.p = n.p GROUP BY ALL) AS m ON b.p = m.p AND b.e = m.e AND b.d = m.d)""")
    steps.append(f"""coded AS (SELECT r, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY r)""")
    return "WITH " + ",\n".join(steps) + f"""
    SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, d)) FROM book{rounds}) AS codebooks_sha256 FROM kept k JOIN coded c ON k.r = c.r"""
