"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become whole numbers, so the scatter of a corpus (n squared times the covariance) is an
integer matrix, summed without rounding. Then, with the matrix in every task and the work dealt out:

1. Its characteristic polynomial is found modulo many primes, a prime a row, by reduction to
   Hessenberg form, and put together by the Chinese remainder theorem.
2. All its roots are real, so the changes of sign of the polynomial shifted by t count the roots
   above t exactly (Descartes). Bisection on that count isolates each root, or a root of some
   multiplicity, and bisection on the sign brings it to some sixty digits.
3. Components span the null space of the matrix less the root: elimination with full pivoting and
   inverse iteration in long decimals, a root a row, rounded to doubles at the end.

Only numbers of the dimensions' size reach the driver: sums, residues and components.

Cases: a vector that is null, empty, holds null or non-finite entries, or has another length than
most vectors have (of lengths equally frequent the largest counts), takes no part. Repeated rows
and rows with a null id are rows of their own. Components of an eigenvalue of zero have a null
``whitened`` and an ``explained`` of zero, and take no part in ``identity_error``; with a trace of
zero ``explained`` is null. Of equal eigenvalues any orthonormal components are given, the same for
all rows. An empty table gives an empty result. Only the id and the vector are read. Entries beyond
2^53 are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: Entries are taken in steps of 1 / STEPS, and moved by OFFSET.
STEPS, OFFSET = 64, 1_000_000
#: Binary places to which roots are told apart, and to which single ones are found.
APART_BITS, ROOT_BITS = 96, 192
#: Bits of a whole sum that go into its lower part.
LOW_BITS = 62
#: Vectors that are turned into rows together.
ROWS_TOGETHER = 2_000

SUMS_SCHEMA = "length long, place long, high long, low long"


@dataclass
class Fit:
    """What is known of all vectors: their number, sums and scatter, and the components."""

    n: int
    sums: list[int]
    scatter: list[list[int]]
    values: list[Decimal]
    components: np.ndarray
    explained: list[float | None]
    identity_error: float | None


def whole_vectors(vectors: pa.Array, length: int | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rows that take part, and by length their entries as whole numbers (without OFFSET).

    ``vectors`` is a list array of doubles.
    """
    offsets = np.asarray(vectors.offsets, np.int64)
    inner = vectors.values
    entries = np.asarray(inner.fill_null(float("nan")), np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    sizes = np.diff(offsets)
    fit = (bad[offsets[1:]] == bad[offsets[:-1]]) & (sizes > 0) & np.asarray(vectors.is_valid())
    if length is not None:
        fit &= sizes == length
    rows, by_length = np.nonzero(fit)[0], {}
    for size in np.unique(sizes[rows]).tolist():
        own = rows[sizes[rows] == size]
        steps = np.floor(STEPS * entries[offsets[own][:, None] + np.arange(size)])
        if len(steps) and np.abs(steps).max() > 2.0 ** 53:
            raise ValueError("an entry is too large to be counted in steps")
        by_length[size] = steps.astype(np.int64)
    return rows, by_length


def products(x: np.ndarray) -> np.ndarray:
    """The exact sums of x_i x_j over rows, as Python numbers."""
    largest = int(np.abs(x).max(initial=0))
    if largest * largest * len(x) < 1 << 53:
        x = x.astype(np.float64)
        return (x.T @ x).astype(np.int64).astype(object)
    if largest * largest * len(x) >= 1 << 63:
        x = x.astype(object)
    return (x.T @ x).astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length: at place 0 the number of vectors, then their sums, then the upper half of their
    products."""
    held: dict[int, np.ndarray] = {}

    def written() -> Iterator[pa.RecordBatch]:
        for length, sums in held.items():
            values = sums.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * len(values), pa.int64()), pa.array(range(len(values)), pa.int64()),
                 pa.array([v >> LOW_BITS for v in values], pa.int64()),
                 pa.array([v & (1 << LOW_BITS) - 1 for v in values], pa.int64())],
                ["length", "place", "high", "low"])
        held.clear()

    for batch in batches:
        for length, x in whole_vectors(batch["vector"])[1].items():
            own = np.concatenate([[len(x)], x.astype(object).sum(axis=0) if len(x) * int(
                np.abs(x).max(initial=0)) >= 1 << 63 else x.sum(axis=0).astype(object),
                products(x)[np.triu_indices(length)]])
            held[length] = held[length] + own if length in held else own
        if len(held) > 8:
            yield from written()
    yield from written()


def scatter(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums and n times the products less the products of the sums; all of OFFSET taken out,
    which the scatter doesn't depend on."""
    parts = staged(vectors.select("vector").mapInArrow(_sums, SUMS_SCHEMA).groupBy("length", "place").agg(
        F.sum(F.col("high").cast("decimal(20,0)")).alias("high"),
        F.sum(F.col("low").cast("decimal(20,0)")).alias("low")), "scatter")
    best = parts.filter("place = 0").orderBy(F.desc("high"), F.desc("low"), F.desc("length")).first()
    if best is None:
        return 0, [], []
    d = best["length"]
    found = {r["place"]: (int(r["high"]) << LOW_BITS) + int(r["low"])
             for r in parts.filter(F.col("length") == d).collect()}
    n, sums = found[0], [found[1 + i] for i in range(d)]
    matrix = [[0] * d for _ in range(d)]
    for place, (i, j) in enumerate(zip(*(ix.tolist() for ix in np.triu_indices(d)))):
        matrix[i][j] = matrix[j][i] = n * found[1 + d + place] - sums[i] * sums[j]
    return n, sums, matrix


def is_prime(n: int) -> bool:
    """For odd n below 2^31, by strong tests to bases that leave none out there."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1) or n == base:
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(matrix: list[list[int]]) -> list[int]:
    """Primes below 2^31 whose product is beyond twice any coefficient: of a matrix without
    negative eigenvalues, the k-th is at most that of d equal ones."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = 2 * max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1)) + 1
    primes, candidate, product = [], (1 << 31) - 1, 1
    while product <= bound:
        if is_prime(candidate):
            primes.append(candidate)
            product *= candidate
        candidate -= 2
    return primes


def hessenberg_characteristic(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo a prime below 2^31, the leading one first."""
    h, d = matrix % p, len(matrix)
    for k in range(d - 2):
        below = np.nonzero(h[k + 1:, k])[0]
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:, k:] = (h[k + 2:, k:] - factor[:, None] * h[k + 1, k:] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factor % p).sum(axis=1)) % p
    # Leading minors of t - h, lowest power first.
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        own = np.zeros(d + 1, np.int64)
        own[1:] = minors[k - 1, :-1]
        own = (own - int(h[k - 1, k - 1]) * minors[k - 1] % p) % p
        along = 1
        for i in range(1, k):
            along = along * int(h[k - i, k - i - 1]) % p
            if not along:
                break
            own = (own - int(h[k - i - 1, k - 1]) * along % p * minors[k - i - 1] % p) % p
        minors[k] = own
    return minors[d, ::-1].tolist()


def _dealt(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(0, count, 1, max(1, min(count, 2 * spark.sparkContext.defaultParallelism)))


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(t - matrix), the leading one first, exactly."""
    primes = primes_for(matrix)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch["id"].to_pylist()
            got = [hessenberg_characteristic(np.array([[v % primes[i] for v in row] for row in matrix], np.int64),
                                             primes[i]) for i in rows]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(got, pa.list_(pa.int64()))],
                                             ["id", "residues"])

    rows = _dealt(spark, len(primes)).mapInArrow(residues, "id long, residues array<long>").collect()
    whole, modulus = [0] * (len(matrix) + 1), 1
    for row in rows:
        p = primes[row["id"]]
        inverse = pow(modulus, -1, p)
        whole = [w + modulus * ((r - w) * inverse % p) for w, r in zip(whole, row["residues"])]
        modulus *= p
    return [w - modulus if 2 * w > modulus else w for w in whole]


def roots_above(polynomial: list[int], at: int, places: int = 0) -> int:
    """Roots above at / 2^places, each as often as it occurs; all roots have to be real."""
    shifted = [c << places * k for k, c in enumerate(polynomial)]
    for end in range(len(shifted), 1, -1):
        for i in range(1, end):
            shifted[i] += at * shifted[i - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(polynomial: list[int], at: int, places: int) -> int:
    value = 0
    for k, c in enumerate(polynomial):
        value = value * at + (c << places * k)
    return (value > 0) - (value < 0)


def isolate(polynomial: list[int], k: int) -> tuple[int, int, int, int]:
    """The k-th largest root (from 1): numerator, binary places, the number of the first root that
    is equal, and how many are. ``polynomial`` has k positive roots at least and no root of zero."""
    low, high, places = 0, -polynomial[1], 0
    above_low, above_high = len(polynomial) - 1, 0
    while above_low - above_high > 1 and not (places >= APART_BITS and low.bit_length() > 64):
        if high - low == 1:
            low, high, places = low << 16, high << 16, places + 16
        middle = (low + high) // 2
        above = roots_above(polynomial, middle, places)
        if above >= k:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    if above_low - above_high == 1:
        # The only root in (low, high]: the sign above it is that at high, unless high is the root.
        upper = _sign(polynomial, high, places)
        if not upper:
            return high, places, above_high + 1, 1
        while not (places >= ROOT_BITS and low.bit_length() > ROOT_BITS):
            low, high, places = 2 * low, 2 * high, places + 1
            middle = (low + high) // 2
            sign = _sign(polynomial, middle, places)
            if not sign:
                return middle, places, above_high + 1, 1
            low, high = (low, middle) if sign == upper else (middle, high)
    return low + high, places + 1, above_high + 1, above_low - above_high


def null_space(matrix: list[list[int]], root: Decimal, count: int, digits: int) -> np.ndarray:
    """Orthonormal vectors, a column each, that ``matrix`` multiplies by ``root``.

    Elimination with full pivoting leaves ``count`` pivots of almost zero at the end; these are
    replaced by a tiny number, and solving for them is a step of inverse iteration.
    """
    with localcontext() as context:
        context.prec = digits
        d = len(matrix)
        a = np.array([[Decimal(v) for v in row] for row in matrix], object)
        for i in range(d):
            a[i, i] -= root
        columns, zero = list(range(d)), Decimal(0)
        for k in range(d - count):
            rest = np.abs(a[k:, k:])
            i, j = divmod(int(rest.argmax()), d - k)
            if i:
                a[[k, k + i]] = a[[k + i, k]]
            if j:
                a[:, [k, k + j]] = a[:, [k + j, k]]
                columns[k], columns[k + j] = columns[k + j], columns[k]
            if not a[k, k]:
                break
            factor = a[k + 1:, k] / a[k, k]
            a[k + 1:, k:] -= factor[:, None] * a[k, k:]
        found: list[np.ndarray] = []
        for free in range(d - count, d):
            x = np.full(d, zero, object)
            x[free] = Decimal(1)
            for i in range(d - count - 1, -1, -1):
                x[i] = -(a[i, i + 1:] * x[i + 1:]).sum() / a[i, i]
            for other in found:
                x = x - (x * other).sum() * other
            found.append(x / (x * x).sum().sqrt())
        back = np.empty((d, count))
        for j, x in enumerate(found):
            back[columns, j] = [float(v) for v in x]
        return back


def eigen(spark: SparkSession, matrix: list[list[int]], count: int) -> tuple[list[Decimal], np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix without negative ones, and unit
    eigenvectors as columns."""
    d = len(matrix)
    polynomial = characteristic(spark, matrix)
    zeros = next(i for i, c in enumerate(reversed(polynomial)) if c)
    positive = polynomial[:d + 1 - zeros]
    size = max((abs(v).bit_length() for row in matrix for v in row), default=0)
    digits = 20 + (2 * size + 2 * ROOT_BITS + d) * 3 // 10

    def root_of(fraction: int, places: int) -> Decimal:
        with localcontext() as context:
            context.prec = digits
            return Decimal(fraction) / Decimal(1 << places)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [isolate(positive, k + 1) for k in batch["id"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([str(g[0]) for g in got], pa.string()),
                 *[pa.array([g[i] for g in got], pa.int64()) for i in (1, 2, 3)]],
                ["id", "fraction", "places", "first", "times"])

    wanted = min(count, d - zeros)
    groups: dict[int, tuple[Decimal, int]] = {}
    if wanted:
        for row in _dealt(spark, wanted).mapInArrow(
                roots, "id long, fraction string, places long, first long, times long").collect():
            groups[row["first"]] = root_of(int(row["fraction"]), row["places"]), row["times"]
    if wanted < count:
        groups[d - zeros + 1] = Decimal(0), zeros
    firsts = sorted(groups)

    def spaces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch["id"].to_pylist():
                found = null_space(matrix, *groups[firsts[i]], digits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), pa.array([found.ravel().tolist()], pa.list_(pa.float64()))],
                    ["id", "columns"])

    values, vectors = [], []
    found = {r["id"]: r["columns"] for r in _dealt(spark, len(firsts)).mapInArrow(
        spaces, "id long, columns array<double>").collect()}
    for i, first in enumerate(firsts):
        value, times = groups[first]
        values += [value] * times
        vectors.append(np.array(found[i]).reshape(d, times))
    return values[:count], np.hstack(vectors)[:, :count]


def fit(vectors: DataFrame, count: int) -> Fit | None:
    """The model of a table with a column ``vector``; None without any vector that takes part."""
    n, sums, matrix = scatter(vectors)
    if not n:
        return None
    values, components = eigen(vectors.sparkSession, matrix, min(count, len(sums)))
    trace = sum(matrix[i][i] for i in range(len(sums)))
    explained = [float(v / trace) if trace else None for v in values]
    return Fit(n, sums, matrix, values, components, explained, _identity_error(matrix, values, components))


def _identity_error(matrix: list[list[int]], values: list[Decimal], components: np.ndarray) -> float | None:
    """The covariance of the whitened vectors follows from the scatter and the components as they
    are (in doubles); how far it is from the identity."""
    used = [j for j, v in enumerate(values) if v > 0]
    if not used:
        return None
    with localcontext() as context:
        context.prec = 50
        scatter_ = np.array([[Decimal(v) for v in row] for row in matrix], object)
        w = np.array([[Decimal(float(components[i, j])) / values[j].sqrt() for j in used]
                      for i in range(len(matrix))], object)
        covariance = w.T.dot(scatter_).dot(w)
        for j in range(len(used)):
            covariance[j, j] -= 1
        return float(np.abs(covariance).max())


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", count: int = 32) -> DataFrame:
    """Per vector and component: the key, component, n, deviation (a decimal), whitened, explained,
    identity_error."""
    wanted = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    schema = (f"`{key}` long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    model = fit(wanted, count)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    n, d, c = model.n, len(model.sums), len(model.values)
    sums = np.array(model.sums, object)
    scale = np.array([1 / float(v.sqrt()) if v > 0 else np.nan for v in model.values])
    scaled = model.components * scale
    explained, error = model.explained, model.identity_error
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    most = max(map(abs, model.sums))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, by_length = whole_vectors(batch["vector"], d)
            for begin in range(0, len(keep), ROWS_TOGETHER):
                own = keep[begin:begin + ROWS_TOGETHER]
                x = by_length[d][begin:begin + ROWS_TOGETHER]
                reach = n * int(np.abs(x).max()) + most
                if d * reach * reach < 1 << 63:
                    apart = n * x - sums.astype(np.int64)
                else:
                    apart = n * x.astype(object) - sums
                deviation = pa.array((apart * apart).sum(axis=1).tolist(), pa.decimal128(38, 0))
                white = (apart.astype(np.float64) @ scaled).ravel()
                take = np.repeat(np.arange(len(own)), c)
                yield pa.RecordBatch.from_arrays(
                    [batch["key"].take(pa.array(own[take])), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(own))),
                     pa.array(np.full(len(take), n)), deviation.take(pa.array(take)),
                     pa.array(white, mask=np.isnan(white)), pa.array(explained * len(own), pa.float64()),
                     pa.array([error] * len(take), pa.float64())], names)

    return wanted.mapInArrow(project, schema)
