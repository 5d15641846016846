"""Whitening of embeddings by an incremental eigendecomposition.

Each partition keeps the spectrum of its own scatter matrix (eigenvalues and eigenvectors) and updates it, centred vector by
centred vector, by rank-one terms: the eigenvalues are the roots of a secular equation, and what the vector doesn't touch, or
touches in a space of equal eigenvalues, is deflated. A batch with more vectors than dimensions is first turned into as many vectors
with the same scatter (a triangular factor), so it costs as many updates as there are dimensions. Spectra of partitions are combined the same way, each
eigenpair being one more rank-one term and the distance of the means another, a few spectra a task, until one is left. A last pass over
all vectors in that basis (Rayleigh-Ritz) takes out the rounding of all these updates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import tidy
from .common import materialize

#: Entries count as x = floor(SCALE * c) + OFFSET; those beyond MOST_ENTRY count as that.
SCALE, OFFSET, MOST_ENTRY = 1024, 100_000, 1e9
COMPONENTS = 8
#: Partial results that one task combines.
FAN_IN = 16
EPS = np.finfo(float).eps
SPECTRUM = "dims int, n bigint, sums array<bigint>, mean array<double>, values array<double>, vectors array<double>"


def clean(batch: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and x-vectors of the rows of a batch that are kept, for each length of vectors."""
    good = np.flatnonzero(batch.is_valid().to_numpy(zero_copy_only=False))
    lists = batch.take(pa.array(good))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    odd = ~np.isfinite(values)
    row = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.ones(len(sizes), bool)
    keep[row[odd]] = False
    for d in np.unique(sizes[keep]):
        mine = keep & (sizes == d)
        if d:
            some = values[np.repeat(mine, sizes)].reshape(-1, d)
            yield good[mine], np.floor(np.clip(some, -MOST_ENTRY, MOST_ENTRY) * SCALE).astype(np.int64) + OFFSET


def deflated(values: np.ndarray, z: np.ndarray, vectors: np.ndarray, tiny: float) -> tuple[np.ndarray, np.ndarray]:
    """``z`` and ``vectors`` turned so that of equal eigenvalues at most the last has a part in ``z``."""
    ends = np.flatnonzero(np.r_[np.diff(values) > tiny, True])
    begin = 0
    for end in ends:
        if end > begin and np.abs(z[begin:end]).max() > 0:
            part = z[begin : end + 1]
            h = part.copy()
            h[-1] += np.copysign(np.linalg.norm(part), part[-1])  # a reflection onto the last axis
            h /= np.linalg.norm(h)
            z[begin : end + 1] = part - 2 * h * (h @ part)
            z[begin:end] = 0
            vectors[:, begin : end + 1] -= 2 * np.outer(vectors[:, begin : end + 1] @ h, h)
        begin = end + 1
    return z, vectors


def updated(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (ascending) of vectors @ diag(values) @ vectors.T + outer(v, v).

    The roots of 1 + sum(z[k]**2 / (values[k] - root)) are found by bisection between neighbouring eigenvalues, each as the distance from
    the nearer of them, and ``z`` is then taken anew from the roots, so that the new vectors are orthogonal however close roots lie.
    """
    z = vectors.T @ v
    size = float(z @ z)
    if size == 0:
        return values, vectors
    tiny = 8 * EPS * max(values[-1], size)
    z, vectors = deflated(values, z, vectors.copy(), tiny)
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > tiny)
    if not len(live):
        return values, vectors
    lam, w = values[live], z[live] ** 2
    gap = np.r_[np.diff(lam), w.sum()]
    # from which pole each root is reckoned: the sign of the function in the middle tells which is nearer
    middle = 1 + (w / (lam - (lam + gap / 2)[:, None])).sum(1)
    upper = middle < 0
    upper[-1] = False
    pole = np.where(upper, np.r_[lam[1:], lam[-1]], lam)
    apart = lam - pole[:, None]  # values from each root's pole
    low, high = np.where(upper, -gap / 2, 0), np.where(upper, 0, np.where(np.arange(len(lam)) < len(lam) - 1, gap / 2, gap))
    for _ in range(64):
        half = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            right = 1 + (w / (apart - half[:, None])).sum(1) < 0  # the root lies further up
        low, high = np.where(right, half, low), np.where(right, high, half)
    off = (low + high) / 2
    roots = pole + off
    away = apart - off[:, None]  # away[i, k] = values[k] - roots[i]
    ratio = -away
    others = lam[None, :] - lam[:, None]
    np.fill_diagonal(others, 1)
    # z[k]**2 = prod(roots - values[k]) / prod(other values - values[k])
    logs = np.log(np.maximum(np.abs(ratio), 1e-300)).sum(0) - np.log(np.maximum(np.abs(others), 1e-300)).sum(1)
    new_z = np.copysign(np.exp(logs / 2), z[live])
    turned = new_z / np.where(away == 0, 1e-300, away)
    turned /= np.linalg.norm(turned, axis=1)[:, None]
    out_values, out_vectors = values.copy(), vectors
    out_values[live] = roots
    out_vectors[:, live] = vectors[:, live] @ turned.T
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_vectors[:, order]


class Spectrum:
    """Number, exact sums, mean and scatter spectrum of vectors."""

    def __init__(self, d: int):
        self.n, self.sums, self.mean = 0, np.zeros(d, np.int64), np.zeros(d)
        self.values, self.vectors = np.zeros(d), np.eye(d)

    def rank_one(self, rows: np.ndarray) -> None:
        for v in rows:
            self.values, self.vectors = updated(self.values, self.vectors, v)

    def moved(self, n: int, mean: np.ndarray) -> None:
        """The term of two means when ``n`` vectors of another mean come."""
        both = self.n + n
        if self.n and n:
            self.rank_one([(mean - self.mean) * np.sqrt(self.n / both * n)])
        self.mean = self.mean + (mean - self.mean) * (n / both) if self.n else mean
        self.n = both

    def add(self, x: np.ndarray) -> None:
        """Vectors of a batch."""
        mean = x.mean(0)
        rows = x - mean
        if len(rows) > rows.shape[1]:
            rows = np.linalg.qr(rows, "r")
        self.sums = self.sums + x.sum(0)
        self.rank_one(rows)
        self.moved(len(x), mean)

    def combine(self, r) -> None:
        """Another spectrum's eigenpairs."""
        d = len(self.mean)
        values, vectors = np.asarray(r.values_, float), np.asarray(r.vectors, float).reshape(d, d)
        self.sums = self.sums + np.asarray(r.sums, np.int64)
        self.rank_one((vectors * np.sqrt(np.maximum(values, 0))).T[values > 0])
        self.moved(int(r.n), np.asarray(r.mean, float))

    def row(self) -> dict:
        return {"dims": len(self.mean), "n": self.n, "sums": self.sums.tolist(), "mean": self.mean.tolist(), "values": self.values.tolist(), "vectors": self.vectors.ravel().tolist()}


def partial_spectra(rows: DataFrame) -> DataFrame:
    """A spectrum for each partition and length of vectors; ``rows``: one array column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Spectrum] = {}
        for batch in tidy(b.column(0) for b in batches):
            for _, x in clean(batch):
                found.setdefault(x.shape[1], Spectrum(x.shape[1])).add(x)
        for s in found.values():
            yield pa.RecordBatch.from_pylist([s.row()], schema=ARROW)

    return rows.mapInArrow(run, SPECTRUM)


LONGS, DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())
ARROW = pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("sums", LONGS), ("mean", DOUBLES), ("values", DOUBLES), ("vectors", DOUBLES)])


def combined(pdf: pd.DataFrame) -> pd.DataFrame:
    s = Spectrum(int(pdf["dims"].iloc[0]))
    for r in pdf.rename(columns={"values": "values_"}).itertuples():
        s.combine(r)
    return pd.DataFrame([s.row()])


def in_few(df: DataFrame, keys: list[str], merge, schema: str) -> DataFrame:
    """One row for each value of ``keys``, of ``FAN_IN`` rows a task at a time."""
    df = materialize(df)
    while df.groupBy(*keys).count().filter("count > 1").count():
        numbered = df.withColumn("_at", F.monotonically_increasing_id())
        few = df.count() // FAN_IN + 1
        df = materialize(numbered.groupBy(*keys, F.pmod(F.xxhash64("_at"), F.lit(few)).alias("_g")).applyInPandas(lambda pdf: merge(pdf), schema))
    return df


class Fit:
    """What whitening needs: number and exact sums of the vectors, eigenvalues (falling) and components (rows) of their covariance."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, components: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.components, self.trace = n, sums, values, components, trace

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: whole and broken part of the mean apart, so nothing is lost for large offsets."""
        whole, rest = np.divmod(self.sums, self.n)
        return (x - whole) - rest / self.n


def second_moments(rows: DataFrame, shared, project) -> np.ndarray:
    """The matrix of sums of products of ``project``'s columns over all vectors of the fit's length: one matrix a partition, summed entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, total = shared.value, None
        for batch in tidy(b.column(0) for b in batches):
            for _, x in clean(batch):
                if x.shape[1] == fit.dims:
                    y = project(fit, x)
                    total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_pydict({"m": pa.array([total.ravel().tolist()], DOUBLES)})

    entries = rows.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("at", "v"))
    found = entries.groupBy("at").agg(F.sum("v").alias("v")).collect()  # as many as a matrix has entries
    out = np.zeros(len(found))
    for r in found:
        out[r["at"]] = r["v"]
    k = round(len(found) ** 0.5)
    return out.reshape(k, k)


def fit(vectors: DataFrame, vector_col: str = "embedding") -> Fit | None:
    """The covariance's eigenpairs; None if no vector is left.

    Null vectors, empty ones and those with a null or non-finite entry are left out. Vectors have one length: those of another than the commonest
    (of equally common ones the greatest) are left out too.
    """
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    spectra = materialize(partial_spectra(rows))
    sizes = spectra.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if sizes is None:
        return None
    s = in_few(spectra.filter(F.col("dims") == sizes.dims), ["dims"], combined, SPECTRUM).first()
    d = s["dims"]
    basis = np.array(s["vectors"]).reshape(d, d).T[::-1]  # rows, largest eigenvalue first
    basis = np.linalg.qr(basis.T)[0].T
    rough = Fit(s["n"], np.array(s["sums"], np.int64), np.array(s["values"])[::-1] / s["n"], basis, 1.0)
    context = vectors.sparkSession.sparkContext
    inner = second_moments(rows, context.broadcast(rough), lambda f, x: f.centred(x) @ f.components.T) / rough.n
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return Fit(rough.n, rough.sums, values[::-1], turn.T[::-1] @ basis, float(np.trace(inner)))


def whitened(f: Fit, x: np.ndarray) -> np.ndarray:
    """Projections on the first components over their standard deviations; NaN where a component has none."""
    k = min(COMPONENTS, f.dims)
    scale = np.array([np.sqrt(v) if v > EPS * f.dims * f.trace else np.nan for v in f.values[:k]])
    return f.centred(x) @ f.components[:k].T / scale


def deviations(f: Fit, x: np.ndarray) -> list[int | None]:
    """Exact sums of (n * x - sums)**2; None where that is no long."""
    y = f.n * x.astype(object) - f.sums.astype(object) if f.n * (np.abs(x).max() + np.abs(f.sums / f.n).max()) > 2**62 else f.n * x - f.sums
    if float(np.abs(y).max()) ** 2 * f.dims >= 2**62:
        y = y.astype(object)
    return [s if s < 2**63 else None for s in map(int, (y * y).sum(1))]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows ``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector that is kept and each component.

    Which are kept, see ``fit``. Components are numbered from 1 by falling eigenvalue, eight at most. ``deviation`` is null where it is no long. ``whitened``
    is null for a component without variance (fewer distinct vectors than dimensions), and such components don't count in ``identity_error``, which is
    the largest entry of the whitened vectors' covariance minus the identity; it is null if none counts, and ``explained`` is null if nothing varies. Null and
    repeated ids, and repeated rows, pass; other columns, whatever their names, are ignored. Without vectors the result is empty.
    """
    spark = vectors.sparkSession
    f = fit(vectors, vector_col)
    kind = "array<struct<component: int, n: bigint, deviation: bigint, whitened: double, explained: double>>"
    if f is None:
        return spark.createDataFrame([], f"vec_id {vectors.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    shared = spark.sparkContext.broadcast(f)
    varied = int((f.values[:COMPONENTS] > EPS * f.dims * f.trace).sum())
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    error = None
    if varied:
        ours = second_moments(rows.select("v"), shared, lambda f, x: whitened(f, x)[:, :varied]) / f.n
        error = float(np.abs(ours - np.eye(varied)).max())

    @F.arrow_udf(kind)
    def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = shared.value
        k = min(COMPONENTS, f.dims)
        share = [float(v) / f.trace if f.trace > 0 else None for v in np.maximum(f.values[:k], 0)]
        for batch in tidy(batches):
            sizes, columns = np.zeros(len(batch), np.int32), [[], []]
            for at, x in clean(batch):
                if x.shape[1] == f.dims:
                    sizes[at] = k
                    columns = [deviations(f, x), whitened(f, x).ravel()]
            m = int(sizes.sum()) // k
            made = pa.StructArray.from_arrays(
                [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)), pa.array([v for v in columns[0] for _ in range(k)], pa.int64()),
                    pa.array(np.asarray(columns[1], float), pa.float64(), from_pandas=True), pa.array(share * m, pa.float64()),
                ],
                ["component", "n", "deviation", "whitened", "explained"],
            )
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), made)

    out = rows.select("vec_id", F.explode(parts.asNondeterministic()(F.col("v"))).alias("p"))
    return out.select("vec_id", "p.*", F.lit(error).cast("double").alias("identity_error"))


def fitted(spark: SparkSession, f: Fit) -> DataFrame:
    """A fit as rows ``component, variance, explained, direction``."""
    rows = [(i + 1, float(v), float(v) / f.trace if f.trace > 0 else None, c.tolist()) for i, (v, c) in enumerate(zip(f.values, f.components, strict=True))]
    return spark.createDataFrame(rows, "component int, variance double, explained double, direction array<double>")
