"""Whitening of embeddings by spectrum slicing.

Spark makes the list of distinct vectors, their sums and the sums of products of centred entries;
what comes to the driver is one matrix of dimensions by dimensions. There the inertia of the shifted
matrix (signs of an LDL' factorisation) counts the eigenvalues above a shift, bisection isolates each
leading one, and Rayleigh quotient iteration converges inside the isolating interval.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Rows of one numpy step.
BLOCK = 4_096
#: Bisection stops at this share of the matrix's norm: eigenvalues closer together count as one that repeats.
CLOSE = 1e-13
#: Bunch and Parlett's bound between a single pivot and a pair.
PIVOT = (1 + math.sqrt(17)) / 8


# ---------------------------------------------------------------- the spectrum


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """Positive, negative and zero eigenvalues of a symmetric matrix, by LDL' with complete pivoting (Bunch and Parlett)."""
    a = np.array(a, float)
    plus = minus = 0
    while len(a):
        diag = np.abs(a.diagonal())
        off = np.abs(np.tril(a, -1))
        r, (p, q) = int(diag.argmax()), divmod(int(off.argmax()), len(a))
        if not max(diag[r], off[p, q]):
            return plus, minus, len(a)
        first = [r] if diag[r] >= PIVOT * off[p, q] else [q, p]
        rest = np.setdiff1d(np.arange(len(a)), first)
        block, side = a[np.ix_(first, first)], a[np.ix_(rest, first)]
        signs = np.sign(block[0, 0]) if len(first) == 1 else 0  # a pair chosen here has one eigenvalue of each sign
        plus, minus = plus + (signs >= 0), minus + (signs <= 0)
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return plus, minus, 0


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) of a symmetric matrix and unit eigenvectors in columns.

    Eigenvalues within CLOSE of each other get an orthonormal basis of their common space. Each
    eigenvector's largest entry is positive. Counts on both sides of each value certify its number.
    """
    d, norm = len(v), float(np.abs(v).sum(axis=1).max(initial=0.0))
    eye, known = np.eye(d), {}

    def above(s: float) -> int:
        if s not in known:
            known[s] = inertia(v - s * eye)[0]
        return known[s]

    edge = norm * (1 + 1e-9) + 1e-300
    known |= {edge: 0, -edge: d}
    values, vectors = [], np.zeros((d, 0))
    for j in range(1, min(k, d) + 1):
        low, high = max(s for s, n in known.items() if n >= j), min(s for s, n in known.items() if n < j)

        def halve(low: float, high: float) -> tuple[float, float]:
            mid = (low + high) / 2
            return (mid, high) if above(mid) >= j else (low, mid)

        while above(low) - above(high) > 1 and high - low > CLOSE * norm:
            low, high = halve(low, high)
        certain = lambda x: above(x + 1e-10 * norm) < j <= above(x - 1e-10 * norm)  # noqa: E731,B023
        while True:
            found = _refine(v, vectors, low, high, j)
            if found is not None and certain(found[0]):
                break
            if high - low <= CLOSE * norm:
                found = _inverse(v, vectors, (low + high) / 2, j)
                if not certain(found[0]):
                    raise ArithmeticError(f"eigenvalue {j} is not certified by its counts")
                break
            for _ in range(4):
                low, high = halve(low, high)
        value, vector = found
        values.append(value)
        vectors = np.column_stack([vectors, vector * np.sign(vector[np.abs(vector).argmax()])])
    return np.array(values), vectors


def _unit(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x - others @ (others.T @ x)
    return x / np.linalg.norm(x)


def _solve(v: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    """(v - shift)^-1 x, by a shift moved by its last bits where the matrix is singular."""
    for moved in (shift, shift * (1 + 4e-16) + 1e-300, shift * (1 - 4e-16) - 1e-290):
        try:
            z = np.linalg.solve(v - moved * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(z).all() and z.any():
            return z / np.abs(z).max()
    return x


def _inverse(v: np.ndarray, others: np.ndarray, shift: float, seed: int, steps: int = 3) -> tuple[float, np.ndarray]:
    x = _unit(np.random.default_rng(seed).standard_normal(len(v)), others)
    for _ in range(steps):
        x = _unit(_solve(v, shift, x), others)
    return float(x @ v @ x), x


def _refine(v: np.ndarray, others: np.ndarray, low: float, high: float, seed: int) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the interval's middle; None if a quotient leaves the interval or it does not settle."""
    value, x = _inverse(v, others, (low + high) / 2, seed)
    norm, last = np.abs(v).sum(axis=1).max(), math.inf
    slack = 1e-13 * norm
    for _ in range(30):
        if not low - slack <= value <= high + slack:
            return None
        left = float(np.linalg.norm(v @ x - value * x))
        if left <= 1e-15 * norm or (left <= 1e-12 * norm and left >= last / 2):
            return value, x
        last = left
        x = _unit(_solve(v, value, x), others)
        value = float(x @ v @ x)
    return None


# ---------------------------------------------------------------- vectors in Spark


def _rows(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    """Rows of integers as bytes: two for each entry if all of a row's fit, else eight; so equal rows have equal bytes."""
    many = np.diff(bounds)
    large = np.zeros(len(many), bool)
    large[np.repeat(np.arange(len(many)), many)[(data < -(1 << 15)) | (data >= 1 << 15)]] = True
    if large.any():
        return pa.array([data[s:e].astype(np.int64 if wide else np.int16).tobytes() for s, e, wide in zip(bounds[:-1], bounds[1:], large)], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer((bounds * 2).astype(np.int32)), pa.py_buffer(data.astype(np.int16))])


def _code(scale: int, keep: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            col = batch.column("embedding")
            x = np.floor(pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            x = np.where(np.abs(x) < 2.0**63, x, np.nan)
            whole = np.nan_to_num(x).astype(np.int64)
            for bad in np.flatnonzero(np.isnan(x)):
                whole[bad] = np.iinfo(np.int64).max if pc.list_flatten(col)[int(bad)].as_py() > 0 else np.iinfo(np.int64).min
            many = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(many, pa.int32()), _rows(np.append(0, np.cumsum(many)), whole)], [*keep, "size", "x"])

    return run


def coded(vectors: DataFrame, scale: int, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """(keep, size, x): each vector's entries as floor(scale * entry), packed; rows whose vector is null or has a null or non-finite entry are left out. Entries beyond 64 bits become the nearest that fits. keep: columns of whole numbers that stay."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(F.col("embedding").isNotNull()).where(fine)
    return whole.select(*[F.col(c).cast("long").alias(c) for c in keep], "embedding").mapInArrow(_code(scale, keep), ", ".join(f"{c} long" for c in keep) + ", size int, x binary")


def matrix(col: pa.Array, size: int) -> np.ndarray:
    """Packed rows of so many entries as a matrix of 64-bit integers."""
    out = np.empty((len(col), size), np.int64)
    for i, raw in enumerate(col.to_pylist()):
        out[i] = np.frombuffer(raw, np.int16 if len(raw) == 2 * size else np.int64)
    return out


def blocks(batches, name: str = "x"):
    """(size, matrix, batch) of rows of one length at a time."""
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            own = batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))
            for at in range(0, own.num_rows, BLOCK):
                part = own.slice(at, BLOCK)
                yield int(size), matrix(part.column(name), int(size)), part


def _totals(batches):
    """Each length's rows and exact sums of entries in one task: (size, i, total), i = -1 for the rows."""
    sums: dict[int, np.ndarray] = {}
    for size, x, _ in blocks(batches):
        part = x.sum(axis=0) if not x.size or np.abs(x.astype(float)).max() < 2.0**50 else x.astype(object).sum(axis=0)
        sums[size] = sums.get(size, 0) + np.append(len(x), part).astype(object)
    for size, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([size] * len(total), pa.int32()), pa.array(np.arange(-1, len(total) - 1), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["size", "i", "total"])


@dataclass(frozen=True)
class Fit:
    """What whitens the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray  # falling, all over zero
    vectors: np.ndarray  # in columns
    trace: float

    @property
    def middle(self) -> np.ndarray:
        """Each mean, rounded to an integer."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What middle lacks to the means."""
        return np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.middle)])

    def near(self, x: np.ndarray) -> np.ndarray:
        """x less the rounded means: exact where entries are under 2**61."""
        return (x - self.middle).astype(float) if np.abs(x.astype(float)).max(initial=0.0) < 2.0**61 else x.astype(float) - self.middle

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.near(x) - self.rest) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sums)^2, exact; None where it needs more than 64 bits."""
        far = max((abs(s) for s in self.sums), default=0) + self.n * (int(max(x.max(), -int(x.min()))) if x.size else 0)
        if far * far * max(1, x.shape[1]) < 1 << 63:
            return (((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1)).tolist()
        out = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [t if t < 1 << 63 else None for t in out]


def _products(fits: dict[int, Fit], project: bool):
    """Each length's sums of products of centred entries (or of whitened ones) in one task: (size, i, j, total)."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for size, x, _ in blocks(batches):
            if not size:  # empty vectors have no entries
                continue
            y = fits[size].whiten(x) if project else fits[size].near(x)
            sums[size] = sums.get(size, 0) + y.T @ y
        for size, total in sums.items():
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, size), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["size", "i", "j", "total"])

    return run


def _matrices(rows: DataFrame, fits: dict[int, Fit], project: bool) -> dict[int, np.ndarray]:
    found = rows.mapInArrow(_products(fits, project), "size int, i int, j int, total double").groupBy("size", "i", "j").agg(F.sum("total").alias("total")).collect()
    out = {size: np.zeros((f.vectors.shape[1] if project else size,) * 2) for size, f in fits.items()}
    for r in found:
        out[r["size"]][r["i"], r["j"]] = r["total"]
    return out


def fit(rows: DataFrame, k: int) -> dict[int, Fit]:
    """By length of vectors, the fit over distinct rows(size, x). The driver sees one matrix of length by length for each length there is."""
    totals: dict[int, dict[int, int]] = {}
    for r in rows.mapInArrow(_totals, "size int, i int, total decimal(38,0)").groupBy("size", "i").agg(F.sum("total").alias("total")).collect():
        totals.setdefault(r["size"], {})[r["i"]] = int(r["total"])
    fits = {size: Fit(t[-1], [t[i] for i in range(size)], np.zeros(0), np.zeros((size, 0)), 0.0) for size, t in totals.items() if size}
    for size, products in _matrices(rows, fits, False).items():
        f = fits[size]
        v = products / f.n - np.outer(f.rest, f.rest)
        v = (v + v.T) / 2
        trace = float(np.trace(v))
        values, vectors = leading(v, k) if trace > 0 else (np.zeros(0), np.zeros((size, 0)))
        held = values > size * 1e-15 * trace
        fits[size] = Fit(f.n, f.sums, values[held], vectors[:, held], trace)
    return fits


def _whitened(fits: dict[int, Fit], errors: dict[int, float]):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for size, x, part in blocks(batches):
            f = fits.get(size)
            k = len(f.values) if f else 0
            if not k:
                continue
            many = len(x) * k
            vec_id = part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviation = pa.array(f.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([
                vec_id, pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(many, f.n), pa.int64()), deviation,
                pa.array(f.whiten(x).ravel()), pa.array(np.tile(f.values / f.trace, len(x))), pa.array(np.full(many, errors[size])),
            ], names)

    return run


def whiten(vectors: DataFrame, k: int = 4, scale: int = 256) -> DataFrame:
    """vectors(vec_id, embedding): each row on the k leading components of the distinct vectors, with unit variance.

    Entries become x = floor(scale * entry); the fit list holds each distinct x once: n vectors with
    sums S. Returns vec_id, component (from 1, by falling eigenvalue), n, deviation (the sum of
    (n * x - S)^2, exact; null where it needs more than 64 bits), whitened, explained (the eigenvalue's
    share of the trace) and identity_error (measured in a pass over the fit list: the largest entry of
    the whitened vectors' covariance less the identity).

    Rows whose vector is null or holds a null or non-finite entry are left out; null and repeated
    vec_ids stay. Vectors of each length have a fit of their own. A component without variance (the
    vectors lie in fewer dimensions, or there is one vector only) cannot be whitened and has no rows;
    so an empty table gives none. Other columns are ignored.
    """
    rows = stage(coded(vectors, scale), "whitening-rows")
    distinct = stage(rows.select("size", "x").distinct(), "whitening-distinct")
    fits = fit(distinct, k)
    errors = {size: float(np.abs(c / fits[size].n - np.eye(len(c))).max(initial=0.0)) for size, c in _matrices(distinct, fits, True).items()}
    return rows.mapInArrow(_whitened(fits, errors), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
