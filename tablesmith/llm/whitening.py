"""Whitening of embeddings: blockwise QR, a bidiagonal, its singular values by dqds, directions by twisted factors.

Vectors are integers, ``floor(256 * x)``. The fit list holds each distinct vector once. Its size
and its sums per dimension are exact; each task then reduces its centred rows to a triangle by QR
decompositions of a few thousand rows at a time, and triangles are stacked and reduced in groups until
one is left, whose size depends on the number of dimensions only. Householder reflections make it bidiagonal.
The squares of the bidiagonal's entries are all that the differential quotient-difference steps (dqds) need to find
every singular value to high relative accuracy. The vector of a singular value comes from
two factorisations of the shifted tridiagonal, one from the top and one from the bottom, twisted together
where they fit best; vectors of values that lie close are kept orthogonal, by inverse steps where needed.

Defined cases: vectors that are null or hold null or non-finite entries take no part; shorter ones
count as padded with zeros; an entry of 2**63 / 256 or more is an error; rows that repeat, and rows of
equal vectors, are one row of the fit list, but each gets its own result; null ids stay null. A
component without variance can't be scaled and is left out, so a table whose vectors are all equal
gives no row, as an empty table does. A deviation that no long can hold is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.topk import matrix
from tablesmith.session import stage

COMPONENTS = 4
#: So many rows are reduced to a triangle at once, and so many triangles.
ROWS_AT_ONCE, TRIANGLES_AT_ONCE = 4096, 16
EPS = float(np.finfo(float).eps)
LONG_MAX = (1 << 63) - 1
#: Singular values nearer than this part of the larger one are a cluster.
CLUSTER = 1e-3
SWEEPS = 100


def integers(embedding: Column) -> Column:
    """The entries as integers, null if the vector takes no part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    large = F.exists(embedding, lambda x: F.abs(x.cast("double") * 256) >= float(1 << 63))
    return F.when(~bad, F.when(large, F.raise_error(F.lit("an entry of an embedding times 256 is no long"))).otherwise(scaled))


def trimmed(ints: Column) -> Column:
    """Without zeros at the end, so that vectors equal but for padding are equal."""
    kept = F.array_max(F.transform(ints, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return F.slice(ints, 1, F.coalesce(kept, F.lit(0)))


def exact_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of rows of (ints) and their sum per dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, totals = 0, [0] * size
        for batch in batches:
            values = matrix(batch.column(0), size)
            rows += len(values)
            # two halves of 32 bits, so that sums of up to 2**31 rows fit
            high, low = (values >> 32).sum(axis=0), (values & 0xFFFFFFFF).sum(axis=0)
            totals = [t + (int(h) << 32) + int(l) for t, h, l in zip(totals, high, low)]
        cells = pa.array(np.arange(size + 1))
        yield pa.RecordBatch.from_arrays([cells, pa.array([str(v) for v in [*totals, rows]])], ["cell", "sum"])

    parts = fit.mapInArrow(work, "cell bigint, sum string")
    sums = dict(parts.groupBy("cell").agg(F.sum(F.col("sum").cast("decimal(38,0)"))).collect())  # a row per dimension
    return int(sums.get(size) or 0), [int(sums.get(i) or 0) for i in range(size)]


class Centre:
    """The deviation of rows from the mean of the fit list, exact before it becomes a double."""

    def __init__(self, rows: int, sums: list[int]) -> None:
        self.rows, self.sums = rows, sums
        self.widest = max(abs(s) for s in sums)

    def scaled(self, ints: np.ndarray) -> np.ndarray:
        """n * x - S, as longs where they fit, else as Python's integers."""
        largest = max(abs(int(ints.max(initial=0))), abs(int(ints.min(initial=0))))
        if largest * self.rows + self.widest > LONG_MAX:
            return ints.astype(object) * self.rows - np.array(self.sums, object)
        return ints * self.rows - np.array(self.sums, np.int64)

    def rows_of(self, ints: np.ndarray) -> np.ndarray:
        return self.scaled(ints).astype(float) / self.rows

    def deviation(self, ints: np.ndarray) -> pa.Array:
        """The sum of squares of the scaled deviations, null where no long can hold it."""
        scaled = self.scaled(ints)
        if scaled.dtype != object and (np.square(scaled.astype(float)).sum(axis=1) < 2.0**62).all():
            return pa.array(np.square(scaled).sum(axis=1))
        whole = [sum(int(v) ** 2 for v in row) for row in scaled]
        return pa.array([w if w <= LONG_MAX else None for w in whole], pa.int64())


def triangle(rows: np.ndarray, size: int) -> np.ndarray:
    """The square R of the QR decomposition of the rows."""
    if len(rows) < size:
        rows = np.vstack((rows, np.zeros((size - len(rows), size))))
    return np.linalg.qr(rows, mode="r")


def reduced(fit: DataFrame, centre: Centre, size: int) -> np.ndarray:
    """One triangle whose product with itself is that of all centred rows: QR per task, then of stacked triangles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, any_row = np.zeros((size, size)), False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = centre.rows_of(matrix(batch.column(0).slice(at, ROWS_AT_ONCE), size))
                held, any_row = triangle(np.vstack((held, rows)), size), True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["r"])

    def stacked(group: pa.Table) -> pa.Table:
        held = np.zeros((size, size))
        for piece in group.column("r").to_pylist():
            held = triangle(np.vstack((held, np.frombuffer(piece).reshape(size, size))), size)
        return pa.table({"r": pa.array([held.tobytes()], pa.binary())})

    triangles = stage(fit.mapInArrow(work, "r binary"), "triangles")
    count = triangles.count()
    while count > 1:
        groups = -(-count // TRIANGLES_AT_ONCE)
        dealt = triangles.withColumn("group", F.pmod(F.xxhash64("r"), F.lit(groups)))
        triangles = stage(dealt.groupBy("group").applyInArrow(stacked, "r binary"), "triangles")
        left = triangles.count()
        if left == count:  # each group held one triangle
            triangles = triangles.withColumn("group", F.lit(0)).groupBy("group").applyInArrow(stacked, "r binary")
            left = 1
        count = left
    return np.frombuffer(triangles.first().r).reshape(size, size).copy()


def bidiagonal(square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): ``square`` is u B v' with a on the diagonal of B and b above it."""
    work, size = square.astype(float).copy(), len(square)
    right = np.eye(size)
    for i in range(size):
        mirror = _reflector(work[i:, i])
        work[i:, i:] -= np.outer(2.0 * mirror, mirror @ work[i:, i:])
        if i + 2 < size:
            mirror = _reflector(work[i, i + 1 :])
            work[i:, i + 1 :] -= np.outer(work[i:, i + 1 :] @ mirror, 2.0 * mirror)
            right[:, i + 1 :] -= np.outer(right[:, i + 1 :] @ mirror, 2.0 * mirror)
    return np.diag(work).copy(), np.diag(work, 1).copy(), right


def _reflector(column: np.ndarray) -> np.ndarray:
    """The unit vector whose mirror leaves only the first entry of ``column``."""
    largest = np.abs(column).max(initial=0.0)
    if not largest:
        return np.zeros(len(column))
    mirror = column / largest
    mirror[0] += np.copysign(np.linalg.norm(mirror), mirror[0])
    return mirror / np.linalg.norm(mirror)


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squares of singular values of the bidiagonal, falling.

    Works from the end of each part that no zero cuts: a step without shift tells, by the sum of the reciprocals of its
    quotients, a bound that lies below the least value; a step with that shift brings the
    last entry nearer to it, until what couples it to the others is negligible.
    """
    # scaled, so that squares neither vanish nor overflow
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if not scale:
        return np.zeros(len(a))
    q, e = list(np.square(a / scale)), list(np.square(b / scale))
    found: list[float] = []
    parts = [(q, e, 0.0)]
    while parts:
        q, e, shifted = parts.pop()
        steps = 0
        while q:
            if len(q) == 1 or e[-1] <= EPS * EPS * (shifted + q[-1]) or (steps > SWEEPS and e[-1] <= EPS * EPS):
                found.append(q.pop() + shifted)
                if e:
                    e.pop()
                steps = 0
                continue
            cut = next((i for i in range(len(e) - 1) if e[i] <= EPS * EPS * min(shifted + q[i], shifted + q[i + 1])), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], shifted))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            plain_q, plain_e, quotients = _qd_step(q, e, 0.0)
            shift = 0.0 if min(quotients) <= 0.0 else 1.0 / sum(1.0 / d for d in quotients) * (1.0 - 4 * EPS)
            q, e, steps = plain_q, plain_e, steps + 1
            if shift > EPS * shifted:
                moved_q, moved_e, quotients = _qd_step(q, e, shift)
                if min(quotients) >= 0.0:
                    q, e, shifted = moved_q, moved_e, shifted + shift
    return np.array(sorted(found, reverse=True)) * scale * scale


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential step; the quotients are positive as long as the shift lies below the least value."""
    d = q[0] - shift
    new_q, new_e, quotients = [], [], [d]
    for i, coupling in enumerate(e):
        new_q.append(d + coupling)
        ratio = q[i + 1] / new_q[-1] if new_q[-1] else 0.0
        new_e.append(coupling * ratio)
        d = d * ratio - shift
        quotients.append(d)
    new_q.append(d)
    return new_q, new_e, quotients


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit vector z of B'B z = value z, from the twist of its two factorisations with the least remainder."""
    size, tiny = len(a), EPS * EPS * max(value, 1e-300)
    down, up = np.zeros(size), np.zeros(size)  # pivots from the top and from the bottom
    s, p = np.zeros(size), np.zeros(size)
    squares, couplings, products = a * a, b * b, a[:-1] * b
    s[0] = -value
    for i in range(size):
        down[i] = s[i] + squares[i] or tiny
        if i + 1 < size:
            s[i + 1] = couplings[i] / down[i] * s[i] - value
    p[-1] = squares[-1] - value
    for i in range(size - 2, -1, -1):
        up[i + 1] = couplings[i] + p[i + 1] or tiny
        p[i] = p[i + 1] * squares[i] / up[i + 1] - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(size)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -products[i] / down[i] * z[i + 1]
    for i in range(twist, size - 1):
        z[i + 1] = -products[i] / up[i + 1] * z[i]
    return z / np.linalg.norm(z)


def directions(square: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the largest squares of singular values of ``square``, and their right vectors as columns."""
    scale = float(np.abs(square).max(initial=0.0)) or 1.0
    a, b, right = bidiagonal(square / scale)
    values = dqds(a, b)
    tridiagonal = np.diag(a * a + np.concatenate(([0.0], b * b))) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    least = (len(a) * EPS) ** 2 * values[0] if len(values) else 0.0
    kept: list[np.ndarray] = []
    random = np.random.default_rng(0)
    chosen = [v for v in values[:most] if v > least]
    for i, value in enumerate(chosen):
        z = twisted(a, b, value)
        close = [kept[j] for j in range(i) if chosen[j] - value <= CLUSTER * chosen[j]]
        z = _cleaned(z, close)
        # a vector that others of its cluster have taken, or that isn't accurate, is sought anew by inverse steps
        for attempt in range(1, 9):
            norm = np.linalg.norm(z)
            if norm > 0.1:
                z = _cleaned(z / norm, close)
                z /= np.linalg.norm(z)
                if np.linalg.norm(tridiagonal @ z - value * z) <= 64 * EPS * values[0]:
                    break
            else:
                z = random.standard_normal(len(a))
            moved = tridiagonal - (value + attempt * 8 * EPS * values[0]) * np.eye(len(a))
            z = np.linalg.solve(moved, _cleaned(z, close))
            z = _cleaned(z / np.linalg.norm(z), close)
        kept.append(z / np.linalg.norm(z))
    vectors = right @ np.array(kept).T if kept else np.zeros((len(a), 0))
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if kept else 1.0
    return np.array(chosen) * scale * scale, vectors * signs


def _cleaned(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            z = z - (other @ z) * other
    return z


class Whitener:
    """The fitted mean, scales and directions."""

    def __init__(self, rows: int, sums: list[int], square: np.ndarray, most: int) -> None:
        self.size, self.centre = len(sums), Centre(rows, sums)
        values, self.vectors = directions(square, most)
        self.variances = values / rows
        total = float(np.square(square).sum()) / rows
        self.explained = self.variances / total if total else self.variances

    def __call__(self, ints: np.ndarray) -> np.ndarray:
        return self.centre.rows_of(ints) @ self.vectors / np.sqrt(self.variances)


def identity_error(fit: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.variances)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            white = model(matrix(batch.column(0), model.size))
            sums += white.sum(axis=0)
            products += white.T @ white
        cells = np.concatenate((products.ravel(), sums))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "sum"])

    parts = fit.mapInArrow(work, "cell bigint, sum double").groupBy("cell").agg(F.sum("sum").alias("sum"))
    cells = np.zeros(k * k + k)
    for cell, value in parts.collect():  # a row per pair of components
        cells[cell] = value
    mean = cells[k * k :] / model.centre.rows
    covariance = cells[: k * k].reshape(k, k) / model.centre.rows - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def fitted(rows: DataFrame, most: int = COMPONENTS) -> tuple[Whitener, float] | None:
    """The model of (ints) and the error of its covariance; none if there is no row."""
    fit = stage(rows.select(trimmed(F.col("ints")).alias("ints")).distinct(), "fit")
    size = fit.agg(F.max(F.size("ints"))).first()[0]
    if size is None:
        return None
    size = max(1, size)
    count, sums = exact_sums(fit, size)
    model = Whitener(count, sums, reduced(fit, Centre(count, sums), size), most)
    return model, identity_error(fit, model)


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component."""
    rows = vectors.select("vec_id", integers(F.col("embedding")).alias("ints")).where("ints is not null")
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = fitted(rows, most)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    model, error = fit
    k = len(model.variances)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = matrix(pa.concat_arrays([batch.column("ints")]), model.size) if batch.num_rows else np.zeros((0, model.size), np.int64)
            rows, each = len(ints), np.repeat(np.arange(len(ints)), k)
            deviation = model.centre.deviation(ints)
            columns = [
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.centre.rows)), deviation.take(pa.array(each)), pa.array(model(ints).ravel()),
                pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    cut = rows.select("vec_id", trimmed(F.col("ints")).alias("ints"))
    return cut.mapInArrow(work, schema)
