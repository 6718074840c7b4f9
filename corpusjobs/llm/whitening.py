"""Embedding whitening: the covariance's eigenvectors by QDWH spectral divide and conquer, then a broadcast projection.

Sums and the covariance are added up in Spark over all vectors: a task gives one matrix, cut into its rows, and
the rows of the same number are added after a shuffle. The covariance alone (dimensions squared, whatever the
number of vectors) comes to the driver. There it is split: the orthogonal polar factor U of the matrix less a
shift, by QR-based dynamically weighted Halley iterations, gives the projector (U + 1) / 2 on the invariant
subspace of eigenvalues above the shift; bases of it and of its complement turn the matrix into two smaller
ones, and so on down to single components. Parts behind the last component that is asked for aren't split.
The projection (dimensions x components) is broadcast, and each row is whitened where it lies.

Vectors that are null or hold null or non-finite entries are left out. A vector shorter than the longest one
counts as filled up with zeros. An entry c becomes x = floor(1024 c) + 100000, held within +-2^61; deviations
beyond a long are given as the largest long. Components whose variance isn't above rounding (2^-40 of the
largest, or zero: equal vectors, a single vector) can't be whitened: their `whitened` is null, and
`identity_error` is about the others (0 if there are none). Equal eigenvalues share a subspace, of which any
orthonormal basis is right. Repeated rows and null ids get rows of their own; an empty table, or one without a
usable vector, none. Other columns of the table aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import slices

SCALE, SHIFT, MOST = 1024, 100_000, 2.0**61
#: A variance below this share of the largest is rounding.
FLOOR = 2.0**-40
EPS = float(np.finfo(np.float64).eps)


def polar(a: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix that isn't singular, by QDWH.

    Each round maps the singular values by x (a + b x^2) / (1 + c x^2), with the weights that lift the least of
    them the most; the map is evaluated by a QR factorisation of the stacked matrix, without an inverse.
    """
    d = len(a)
    x = a / max(float(np.linalg.norm(a)), np.finfo(np.float64).tiny)
    # A lower bound of the least singular value; too small a one only costs rounds.
    try:
        low = max(1 / float(np.linalg.norm(np.linalg.inv(x))), EPS)
    except np.linalg.LinAlgError:
        low = EPS
    eye = np.eye(d)
    for _ in range(rounds):
        square = low * low
        root = (4 * (1 - square) / square**2) ** (1 / 3) if square < 1 else 0.0
        wide = math.sqrt(1 + root)
        one = wide + 0.5 * math.sqrt(max(0.0, 8 - 4 * root + 8 * (2 - square) / (square * wide)))
        two = (one - 1) ** 2 / 4
        three = one + two - 1
        q, _r = np.linalg.qr(np.concatenate([math.sqrt(three) * x, eye]))
        new = (two / three) * x + (one - two / three) / math.sqrt(three) * (q[:d] @ q[d:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (one + two * square) / (1 + three * square))
        moved = float(np.linalg.norm(new - x))
        x = new
        if moved <= 5 * EPS ** (1 / 3) and 1 - low < 1e-8 or moved <= d * EPS:
            break
    return x


def range_basis(p: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range (of this rank) and of its complement: subspace iteration, two QRs."""
    order = np.argsort(-np.einsum("ij,ij->j", p, p), kind="stable")
    start = p[:, order[:rank]] + p @ np.random.default_rng(5).standard_normal((len(p), rank)) * 0.1
    for _ in range(2):
        start = p @ np.linalg.qr(start)[0]
    full = np.linalg.qr(start, mode="complete")[0]
    return full[:, :rank], full[:, rank:]


def split(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if the matrix is a multiple of one, up to rounding."""
    d = len(a)
    middle = float(np.trace(a)) / d
    if float(np.linalg.norm(a - middle * np.eye(d))) <= 4 * d * EPS * size:
        return None
    diagonal = np.sort(np.diag(a))
    # Eigenvalues lie on both sides of their mean; the median of the diagonal often halves them better.
    for shift in (float(np.median(diagonal)), middle, *(middle + k * float(np.linalg.norm(a - middle * np.eye(d))) / d for k in (0.01, -0.01, 0.1, -0.1, 0.5, -0.5))):
        u = polar(a - shift * np.eye(d))
        p = (u + np.eye(d)) / 2
        rank = int(round(float(np.trace(p))))
        if not 0 < rank < d:
            continue
        above, below = range_basis(p, rank)
        if float(np.linalg.norm(below.T @ a @ above)) <= 64 * d * EPS * size:
            return above, below
    return power_split(a)


def power_split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where every shift tried meets an eigenvalue: the space of the largest one by power steps on the shifted square."""
    d = len(a)
    low = float(np.trace(a)) / d - float(np.linalg.norm(a))
    m = a - low * np.eye(d)
    for _ in range(60):
        m = m @ m
        m /= float(np.linalg.norm(m))
    q = np.linalg.qr(m[:, [int(np.argmax(np.einsum("ij,ij->j", m, m)))]], mode="complete")[0]
    return q[:, :1], q[:, 1:]


def principal(a: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    size = max(float(np.linalg.norm(a)), np.finfo(np.float64).tiny)
    found: list[np.ndarray] = []
    waiting, have = [np.eye(len(a))], 0  # bases of subspaces; the one of the largest eigenvalues is last
    while waiting and have < components:
        basis = waiting.pop()
        inner = basis.T @ a @ basis
        parts = split((inner + inner.T) / 2, size) if basis.shape[1] > 1 else None
        if parts is None:
            found.append(basis)
            have += basis.shape[1]
            continue
        waiting += [basis @ parts[1], basis @ parts[0]]
    if not found:
        return np.zeros(0), np.zeros((len(a), 0))
    vectors = np.linalg.qr(np.concatenate(found, axis=1))[0]
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:components]
    return values[order], vectors[:, order]


def whole(column: pa.Array, dimensions: int) -> np.ndarray:
    """x of a batch of clean vectors as doubles (whole numbers), short ones filled up."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(lengths), dimensions))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x[np.repeat(np.arange(len(lengths)), lengths), at] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -MOST, MOST) + SHIFT


def clean(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """The rows whose vector is neither null nor holds null or non-finite entries, as `vec` of doubles."""
    fine = F.forall(F.col("vec"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector}`").cast("array<double>").alias("vec")).where(F.col("vec").isNotNull() & F.coalesce(fine, F.lit(False)))


def added(rows: DataFrame) -> DataFrame:
    """Rows (at, values) with the values of equal `at` added, entry by entry: a task streams by the parts it was dealt."""
    count = max(1, min(64, rows.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = values.values.to_numpy(zero_copy_only=False)
                sums[at] = sums[at] + got if at in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["at", "values"])

    return rows.repartition(count, "at").mapInArrow(run, "at int, values array<double>")


def matrix_sum(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], dimensions: int) -> np.ndarray:
    """The sum over all batches of a square matrix; partial sums are one matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in slices(batches, 4096):
            got = of(batch)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "values"])

    out = np.zeros((dimensions, dimensions))
    for r in added(rows.mapInArrow(run, "at int, values array<double>")).collect():  # a row for each dimension
        out[r["at"]] = r["values"]
    return out


def exact_sums(rows: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimensions
        for batch in slices(batches, 4096):
            x = whole(batch.column(0), dimensions)
            n += len(x)
            near = np.abs(x).max(initial=0.0) < 2.0**48  # then a slice's sums fit a long
            part = x.astype(np.int64).sum(axis=0).tolist() if near else [sum(map(int, c)) for c in x.T.tolist()]
            sums = [a + b for a, b in zip(sums, part)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dimensions)], pa.int32()), pa.array([str(n), *map(str, sums)], pa.string())], names=["at", "part"])

    parts = rows.select("vec").mapInArrow(run, "at int, part string")
    total = {r["at"]: int(r["s"]) for r in parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).cast("string").alias("s")).collect()}
    return total.get(-1, 0), [total.get(k, 0) for k in range(dimensions)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exactly."""
    most = 2**63 - 1
    if not len(x):
        return []
    reach = n * int(np.abs(x).max(initial=0.0)) + max(map(abs, sums), default=0)
    if reach < 2**62:
        off = n * x.astype(np.int64) - np.array(sums, np.int64)
        far = int(np.abs(off).max(initial=0))
        if far * far * x.shape[1] < 2**62:
            return (off * off).sum(axis=1).tolist()
    return [min(most, sum((n * int(c) - s) ** 2 for c, s in zip(row, sums))) for row in x.tolist()]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    session, rows = df.sparkSession, clean(df, vector, key)
    kind = df.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dimensions = rows.agg(F.max(F.size("vec")).alias("d")).first()["d"] or 0
    if not dimensions:
        return session.createDataFrame([], schema)
    n, sums = exact_sums(rows, dimensions)
    mean = np.array([s / n for s in sums])
    vecs = rows.select("vec")

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        y = whole(batch.column(0), dimensions) - mean
        return y.T @ y

    covariance = matrix_sum(vecs, spread, dimensions) / n
    values, vectors = principal((covariance + covariance.T) / 2, min(components, dimensions))
    trace = float(np.trace(covariance))
    able = values > FLOOR * max(float(values.max(initial=0.0)), 0.0)
    back = vectors / np.sqrt(np.where(able, values, 1.0))
    share = (values / trace if trace > 0 else np.zeros(len(values))).tolist()
    sent = session.sparkContext.broadcast((mean, back))  # dimensions x components

    def projected(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
        centre, by = sent.value
        x = whole(batch.column(column), dimensions)
        return x, (x - centre) @ by

    # The whitened rows' own covariance. Their mean isn't zero to the last bit, so it is taken off as well.
    width = back.shape[1]

    def own_sums(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((width, width))
        out[0] = projected(batch, 0)[1].sum(axis=0)
        return out

    centre = matrix_sum(vecs, own_sums, width)[0] / n

    def own_spread(batch: pa.RecordBatch) -> np.ndarray:
        w = projected(batch, 0)[1] - centre
        return w.T @ w

    own = (matrix_sum(vecs, own_spread, width) / n)[np.ix_(able, able)]
    error = float(np.abs(own - np.eye(len(own))).max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            x, w = projected(batch, 1)
            many = len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(many), width)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * width, n, np.int64)),
                    pa.array(np.repeat(np.array(deviations(x, n, sums), np.int64), width)),
                    pa.array(w.reshape(-1), mask=np.tile(~able, many)),
                    pa.array(np.tile(np.array(share), many)),
                    pa.array(np.full(many * width, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(F.col(f"`{key}`"), "vec").mapInArrow(run, schema)
