"""Whitening of embeddings by an incremental eigendecomposition.

A vector enters as whole numbers, ``floor(scale * c)``, and every different one counts once. Each
partition keeps the count, the mean and the eigenvalues and eigenvectors of the scatter around
that mean, and changes them by centred rank-one updates: with the new vector turned into the
basis at hand, the new eigenvalues are the roots of the secular equation

    1 + sum_j z_j^2 / (d_j - x) = 0,

after components that do not move have been deflated: those with a tiny z, and all but one of
those with the same d, which a reflection gathers in one. The new vectors come from z worked out
again from the roots, so that they stay orthogonal. A block of rows is first cut down to the
triangular factor of its centred rows, which has the same scatter and no more rows than there are
dimensions; those rows are the updates, and one more is the difference of the means. Spectra of
two partitions are combined in the same way: the eigenvectors of one, each as long as the root
of its eigenvalue, and the difference of the means update the other. Partitions are combined in
groups of ``JOINED`` until one is left, so no task and not the driver holds more.

A last pass refines what comes out (Rayleigh-Ritz): the covariance of all vectors in the basis
found is added up exactly centred, and its eigenvectors turn the basis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.llm.common import written

SCALE = 256
ROWS = 4096  # in a block of a partition
JOINED = 16  # spectra combined by one task
HALVINGS = 70  # of a secular interval, beyond the precision of a double
EPS = np.finfo(float).eps

STATE = "part bigint, state array<double>"
LONGEST = 2.0**62  # entries from here on are not taken


def roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of the secular equation of diag(d) + z z', as (nearest pole, distance to it).

    ``d`` ascends without equal values and no z is 0. Root i lies between d[i] and d[i + 1],
    the last within the length of z beyond the last one. Distances from the nearer pole
    keep their precision where a root all but touches a pole.
    """
    squares = z * z
    gaps = np.append(np.diff(d), squares.sum())
    middle = d + gaps / 2
    at_middle = 1 + (squares / (d[None, :] - middle[:, None])).sum(1)
    lower = at_middle >= 0  # the function rises from -inf to +inf, so the root is below
    lower[-1] = True
    pole = np.arange(len(d)) + ~lower
    apart = d[None, :] - d[pole][:, None]  # poles as seen from each root's own
    low, high = np.where(lower, 0.0, -gaps / 2), np.where(lower, gaps / 2, 0.0)
    high[-1] = gaps[-1]
    for _ in range(HALVINGS):
        x = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            value = 1 + (squares / (apart - x[:, None])).sum(1)
        below = value < 0
        low, high = np.where(below, x, low), np.where(below, high, x)
    return pole, (low + high) / 2


def updated(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of q diag(d) q' + v v'."""
    z = q.T @ v
    length = np.linalg.norm(z)
    tolerance = 8 * EPS * max(np.abs(d).max(initial=0.0), length * length)
    if length * length <= tolerance:
        return d, q
    d, q = d.copy(), q.copy()
    gathered(d, q, z, tolerance)
    moved = np.abs(z) * length > tolerance
    poles, w = d[moved], z[moved]
    pole, offset = roots(poles, w)
    # Entry (i, j): pole j as seen from root i.
    seen = (poles[None, :] - poles[pole][:, None]) - offset[:, None]
    between = poles[None, :] - poles[:, None]
    np.fill_diagonal(between, 1.0)
    ratio = seen / between
    np.fill_diagonal(ratio, np.diagonal(seen))
    again = np.copysign(np.sqrt(np.abs(ratio.prod(axis=0))), w)
    turn = again[None, :] / seen
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    d[moved] = poles[pole] + offset
    q[:, moved] = q[:, moved] @ turn.T
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def gathered(d: np.ndarray, q: np.ndarray, z: np.ndarray, tolerance: float) -> None:
    """Turn the vectors of equal eigenvalues, in place, so that z moves only one of them."""
    start = 0
    for stop in range(1, len(d) + 1):
        if stop < len(d) and d[stop] - d[start] <= tolerance:
            continue
        length = np.linalg.norm(z[start:stop])
        if stop - start > 1 and length > 0:
            signed = np.copysign(length, z[stop - 1])
            mirror = z[start:stop].copy()
            mirror[-1] += signed
            mirror /= np.linalg.norm(mirror)
            part = q[:, start:stop]
            part -= 2 * np.outer(part @ mirror, mirror)
            z[start:stop] = 0
            z[stop - 1] = -signed
            d[start:stop] = d[start:stop].mean()
        start = stop


@dataclass
class Spectrum:
    """Count, mean, and the eigenvalues and eigenvectors of the scatter around the mean."""

    n: float
    mean: np.ndarray
    d: np.ndarray
    q: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0.0, np.zeros(size), np.zeros(size), np.eye(size))

    def joined(self, n: float, mean: np.ndarray, rows: np.ndarray) -> Spectrum:
        """With ``n`` more vectors of this mean whose centred scatter is rows' rows."""
        both = self.n + n
        apart = mean - self.mean
        d, q = self.d, self.q
        for v in (*rows, np.sqrt(self.n * n / both) * apart):
            d, q = updated(d, q, v)
        return Spectrum(both, self.mean + apart * (n / both), d, q)

    def with_rows(self, x: np.ndarray) -> Spectrum:
        """With the vectors in the rows of x."""
        mean = x.mean(axis=0)
        centred = x - mean
        rows = np.linalg.qr(centred, mode="r") if len(x) > x.shape[1] else centred
        return self.joined(float(len(x)), mean, rows)

    def with_spectrum(self, other: Spectrum) -> Spectrum:
        rows = (np.sqrt(np.maximum(other.d, 0))[:, None] * other.q.T)[::-1]
        return self.joined(other.n, other.mean, rows)

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.n], self.mean, self.d, self.q.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray, size: int) -> Spectrum:
        return cls(
            flat[0], flat[1 : size + 1], flat[size + 1 : 2 * size + 1],
            flat[2 * size + 1 :].reshape(size, size),
        )


def pack(x: np.ndarray) -> bytes:
    """A vector of whole numbers as bytes, the same for equal vectors."""
    small = len(x) == 0 or (x.min() >= -(2**15) and x.max() < 2**15)
    return (b"\x02" + x.astype("<i2").tobytes()) if small else (b"\x08" + x.astype("<i8").tobytes())


def unpack(packed: list[bytes], size: int) -> np.ndarray:
    """The packed vectors as rows of 64-bit numbers."""
    if all(p[0] == 2 for p in packed):  # the usual case: one copy of all
        return np.frombuffer(b"".join(p[1:] for p in packed), "<i2").reshape(-1, size).astype(np.int64)
    return np.array([np.frombuffer(p[1:], f"<i{p[0]}").astype(np.int64) for p in packed])


def whole(docs: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x, size) of the rows whose vector can be used; ``x`` is packed."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LONGEST / scale))
    used = docs.select(F.col(f"`{id_col}`").alias("id"), vector.alias("v"))
    used = used.where(F.col("v").isNotNull() & F.forall("v", entry))
    id_type = docs.schema[id_col].dataType

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            values = np.floor(scale * rows.flatten().to_numpy(zero_copy_only=False))
            values = values.astype(np.int64)
            ends = np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))
            parts = np.split(values, ends[:-1]) if len(ends) else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([pack(x) for x in parts], pa.binary()),
                    pa.array([len(x) for x in parts], pa.int32()),
                ],
                ["id", "x", "size"],
            )

    return used.mapInArrow(packed, f"id {id_type.simpleString()}, x binary, size int")


def states(fit: DataFrame, size: int, start: Callable, add: Callable) -> DataFrame:
    """(part, state): what ``add(state, rows)`` makes of each partition's vectors, block by block."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, waiting, count = None, [], 0
        for batch in batches:
            waiting += batch.column(0).to_pylist()
            while len(waiting) >= ROWS:
                state = add(start() if state is None else state, unpack(waiting[:ROWS], size))
                waiting = waiting[ROWS:]
        if waiting:
            state = add(start() if state is None else state, unpack(waiting, size))
        if state is not None:
            flat = state.flat() if isinstance(state, Spectrum) else state
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int64()), pa.array([flat.tolist()], pa.list_(pa.float64()))],
                ["part", "state"],
            )

    found = written(fit.select("x").mapInArrow(fold, STATE), "whitening-states")
    return found.withColumn("part", F.monotonically_increasing_id())


def joined(found: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """All states combined into one, about ``JOINED`` of them by a task at a time."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for state in frame.sort_values("part")["state"]:
            state = np.asarray(state, dtype=float)
            total = state if total is None else combine(total, state)
        return pd.DataFrame({"part": [int(frame["bin"].iloc[0])], "state": [total.tolist()]})

    while (count := found.count()) > 1:
        bins = F.pmod(F.xxhash64("part"), F.lit(-(-count // JOINED)).cast("long"))
        binned = found.withColumn("bin", bins).groupBy("bin").applyInPandas(fold, STATE)
        found = written(binned, "whitening-joined")
    return np.asarray(found.first()["state"], dtype=float)


def exact_sums(fit: DataFrame, size: int) -> list[int]:
    """The sum of each entry over all vectors, as whole numbers of any size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=object)
        for batch in batches:
            x = unpack(batch.column(0).to_pylist(), size)
            if len(x):
                total += (x if np.abs(x).max() < 2**31 else x.astype(object)).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(size), pa.int32()),
                pa.array([Decimal(int(t)) for t in total], pa.decimal128(38)),
            ],
            ["entry", "total"],
        )

    parts = fit.select("x").mapInArrow(add, "entry int, total decimal(38,0)")
    rows = parts.groupBy("entry").agg(F.sum("total").alias("total")).collect()  # one per entry
    return [int(r["total"]) for r in sorted(rows)]


def spectrum(fit: DataFrame, size: int) -> Spectrum:
    """The spectrum of all vectors, from those of the partitions."""
    found = states(fit, size, lambda: Spectrum.empty(size), lambda s, x: s.with_rows(x.astype(float)))

    def combine(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return Spectrum.of(one, size).with_spectrum(Spectrum.of(other, size)).flat()

    return Spectrum.of(joined(found, combine), size)


def covariance(fit: DataFrame, n: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance of all vectors, centred and then turned into ``basis``."""
    k = basis.shape[1]

    def add(total: np.ndarray, x: np.ndarray) -> np.ndarray:
        turned = (x - mean) @ basis
        return total + (turned.T @ turned).ravel()

    found = states(fit, len(mean), lambda: np.zeros(k * k), add)
    return joined(found, np.add).reshape(k, k) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The squared lengths of n * x - sums, exact; None beyond 64 bits."""
    exact = np.array(sums, dtype=object)
    largest = float(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if largest * largest * max(len(sums), 1) < 2.0**62:
        apart = n * x - exact.astype(np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = n * x.astype(object) - exact
    return [v if v < 2**63 else None for v in (apart * apart).sum(axis=1)]


def whitened(
    docs: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = 4,
    scale: int = SCALE,
) -> DataFrame:
    """Each usable row's first principal components, scaled to variance 1.

    Gives for each row and component (from 1, by falling eigenvalue): ``id``, ``component``,
    ``n`` (different vectors), ``deviation`` (squared length of n * x - sums, exact; NULL where
    64 bits do not hold it), ``whitened``, ``explained`` (the eigenvalue's share of the trace) and
    ``identity_error`` (largest entry of the whitened covariance less the identity, one value).

    Rows with a NULL vector, or a NULL, infinite, undefined or (from 2 to the 62nd / scale on)
    too large entry are left out, and so are vectors of another length than most (of two such
    lengths the larger one counts). Equal vectors are one in all statistics, and each row gets
    its result. Components without variance are 0 for every row, explain 0 and are not
    in ``identity_error``. A NULL id is kept. No usable row gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {id_type}, component int, n bigint, deviation bigint, "
        "whitened double, explained double, identity_error double"
    )
    rows = written(whole(docs, id_col, vector_col, scale), "whitening-rows")
    common = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 0
    if size == 0:
        return docs.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.col("size") == size)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    n, sums = fit.count(), exact_sums(fit, size)
    mean = np.array([s / n for s in sums])

    basis = np.linalg.qr(spectrum(fit, size).q)[0]
    values, turn = np.linalg.eigh(covariance(fit, n, mean, basis))
    trace, falling = values.sum(), np.argsort(values)[::-1][:components]
    values, vectors = values[falling], basis @ turn[:, falling]
    vectors *= np.where(vectors.sum(axis=0) < 0, -1.0, 1.0)
    some = values > size * EPS * max(values[0], 0.0)
    scaled = np.where(some, vectors / np.sqrt(np.where(some, values, 1.0)), 0.0)
    share = np.where(some, values / (trace if some.any() else 1.0), 0.0)
    after = covariance(fit, n, mean, scaled[:, some]) if some.any() else np.zeros((0, 0))
    error = float(np.abs(after - np.eye(len(after))).max(initial=0.0))
    k = len(falling)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpack(batch.column(1).to_pylist(), size)
            if not len(x):
                continue
            m = len(x)
            order = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(order)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, dtype=np.int64)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(order)),
                    pa.array(((x - mean) @ scaled).ravel()),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, error)),
                ],
                [f.split()[0] for f in schema.split(", ")],
            )

    return rows.select("id", "x").mapInArrow(project, schema)
