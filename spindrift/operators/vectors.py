"""Vectors in groups: centroids, similarity to them, standardised scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spindrift.functions.deploy import ship

#: Centroids that are scored at a time.
BLOCK = 1024
#: Centroids that are broadcast; more are an error.
MOST_CENTROIDS = 100_000


def group_centroids(items: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, value): component-wise means. One partially aggregated shuffle of group x component sums.

    A null vector or component takes no part, rows of a null group are a group of their own, and an
    empty table has no rows.
    """
    each = items.select(F.col(group), F.posexplode(vector).alias("pos", "x"))
    return each.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def centroid_vectors(items: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): unit vectors along the means, as arrays; those of a zero mean hold nulls."""
    rows = group_centroids(items, group, vector).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s"))
    mean = F.transform("s", lambda x: x["value"])
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x * x))
    return rows.select(group, F.transform(mean, lambda x: x / norm).alias("centroid"))


def _matrix(centroids: DataFrame, group: str):
    """Names and centroids in the order of the groups, for a broadcast of bounded size. Null groups and zero centroids are left out."""
    found = centroids.where(F.col(group).isNotNull()).orderBy(group).limit(MOST_CENTROIDS + 1).collect()
    if len(found) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    rows = [r for r in found if r[1] and None not in r[1]]
    return [r[0] for r in rows], np.array([r[1] for r in rows], float)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as unit rows; zero vectors stay zero, and so does a vector with nulls or another number of components."""
    fit = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    if fit.any():
        out[fit] = column.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    out[~np.isfinite(out).all(1)] = 0
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def similarities(items: DataFrame, key: str, vector: str, centroids: DataFrame, group: str) -> DataFrame:
    """(key, group, sim): cosine of each item with each centroid, BLOCK of them at a time.

    Zero vectors, and those with null or non-finite components or a wrong number of them, have
    similarity 0 to all; null vectors and null groups take no part. Repeated keys give rows each.
    """
    ship(items.sparkSession)
    names, matrix = _matrix(centroids, group)
    kind = dict(items.dtypes)[key], dict(centroids.dtypes)[group]
    group_type = to_arrow_type(centroids.schema[group].dataType)
    sent = items.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches):
        names, matrix = sent.value
        for batch in batches:
            if not batch.num_rows or not len(matrix):
                continue
            v = _unit(batch.column(1), matrix.shape[1])
            for at in range(0, len(names), BLOCK):
                part = names[at : at + BLOCK]
                index = pa.array(np.repeat(np.arange(batch.num_rows), len(part)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(index), pa.array(part * batch.num_rows, group_type), pa.array((v @ matrix[at : at + BLOCK].T).reshape(-1))], ["key", "group", "sim"])

    own = items.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"key {kind[0]}, group {kind[1]}, sim double")
    return own.select(F.col("key").alias(key), F.col("group").alias(group), "sim")


def nearest_groups(items: DataFrame, key: str, vector: str, centroids: DataFrame, group: str, least: float) -> DataFrame:
    """(key, group, sim): the group of the most similar centroid, ties to the smaller group, null below ``least``.

    The largest is found where the item is read: nothing is shuffled and one row an item written.
    Vectors as in ``similarities``; without centroids, group and similarity are null.
    """
    ship(items.sparkSession)
    names, matrix = _matrix(centroids, group)
    kind = dict(items.dtypes)[key], dict(centroids.dtypes)[group]
    group_type = to_arrow_type(centroids.schema[group].dataType)
    sent = items.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches):
        names, matrix = sent.value
        for batch in batches:
            n = batch.num_rows
            if not len(matrix):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(n, group_type), pa.nulls(n, pa.float64())], ["key", "group", "sim"])
                continue
            v = _unit(batch.column(1), matrix.shape[1])
            best, value = np.zeros(n, int), np.full(n, -np.inf)
            for at in range(0, len(names), BLOCK):
                sim = v @ matrix[at : at + BLOCK].T
                top = sim.argmax(1)
                own = sim[np.arange(n), top]
                better = own > value
                best[better], value[better] = top[better] + at, own[better]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[b] if x >= least else None for b, x in zip(best.tolist(), value.tolist())], group_type), pa.array(value)], ["key", "group", "sim"])

    own = items.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"key {kind[0]}, group {kind[1]}, sim double")
    return own.select(F.col("key").alias(key), F.col("group").alias(group), "sim")


def standardised(scores: DataFrame, group: str, value: str = "sim") -> DataFrame:
    """Adds z: the value's population z-score within its group, 0 where the group has no spread. The statistics are one row a group."""
    stats = scores.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return scores.join(stats, group).withColumn("z", F.when(F.col("sd") > 0, (F.col(value) - F.col("mean")) / F.col("sd")).otherwise(0.0)).drop("mean", "sd")


def linear_mmd(items: DataFrame, key: str, vector: str, in_first: F.Column, gamma: float) -> DataFrame:
    """One row (n_pairs, mmd2): the linear-time unbiased estimate of the squared maximum mean discrepancy with a Gaussian kernel (Gretton et al. 2012, section 6).

    The i-th rows of both sets, by key, form quadruples of two neighbours each; a row without a
    partner is left out, and so is one with a null key, vector or condition. Keys are numbers; rows
    with equal keys are in the order of their vectors. Empty tables: n_pairs 0, mmd2 null.
    """
    ship(items.sparkSession)
    items = items.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    side = lambda first: items.where(in_first if first else ~in_first).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))

    def pairs(frame: DataFrame, name: str) -> DataFrame:
        ranked = _ranked(frame, "k")
        half = F.floor(F.col("r") / 2)
        return ranked.groupBy(half.alias("q")).agg(F.max_by("v", -F.col("r")).alias(f"{name}1"), F.max_by("v", "r").alias(f"{name}2"), F.count("*").alias(f"n_{name}")).where(f"n_{name} = 2")

    def kernel(a: str, b: str) -> F.Column:
        return F.exp(-gamma * F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    h = kernel("x1", "x2") + kernel("y1", "y2") - kernel("x1", "y2") - kernel("x2", "y1")
    return pairs(side(True), "x").join(pairs(side(False), "y"), "q").agg(F.count("*").alias("n_pairs"), F.avg(h).alias("mmd2"))


def _ranked(frame: DataFrame, key: str) -> DataFrame:
    """Adds r, the row's place by key (a number) and the other columns, from 0, without gathering the rows in one task.

    Ranges are cut at bounds that are computed once and then fixed, so that every evaluation of the
    plan, with whatever columns, deals a row to the same range; r is the place within it plus the
    sizes of those before, one number a range.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    bounds = np.unique(np.array(frame.agg(F.percentile_approx(key, shares, 10_000)).first()[0] or []))
    at = frame.columns.index(key)

    def place(batches):
        for batch in batches:
            own = np.searchsorted(bounds, batch.column(at).to_numpy(zero_copy_only=False), "left")
            yield batch.append_column("p", pa.array(own.astype(np.int32)))

    placed = frame.mapInArrow(place, T.StructType([*frame.schema.fields, T.StructField("p", T.IntegerType())]))
    sizes = {r["p"]: r["n"] for r in placed.groupBy("p").agg(F.count("*").alias("n")).collect()}  # one row a range
    before = np.cumsum([0, *[sizes.get(p, 0) for p in range(len(bounds))]]).tolist()
    within = F.row_number().over(Window.partitionBy("p").orderBy(key, *[c for c in frame.columns if c != key])) - 1
    return placed.withColumn("r", within + F.get(F.lit(before), F.col("p"))).drop("p")


def random_features(dim: int, n: int, gamma: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of n cosines whose mean product estimates exp(-gamma * |x - y|**2) (Rahimi and Recht 2007)."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, n)


def feature_mmd(items: DataFrame, key: str, vector: str, in_first: F.Column, gamma: float, features: int = 1024) -> DataFrame:
    """One row (n_first, n_second, mmd2, baseline): the squared maximum mean discrepancy of all pairs of rows, with random Fourier features, and that of two halves of the first set by a hash of the key.

    Unbiased: a row's product with itself is taken out (Gretton et al. 2012, lemma 6, with the
    features' inner product as the kernel). Linear in the rows: each task adds up feature vectors.
    Null keys, vectors or conditions and non-finite vectors take no part; a set of fewer than two
    rows gives null. The commonest number of components counts.
    """
    ship(items.sparkSession)
    rows = items.select(F.when(in_first, F.when(F.pmod(F.xxhash64(key), F.lit(2)) == 0, 0).otherwise(1)).when(~in_first, 2).alias("part"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.col("part").isNotNull())
    rows = rows.where("size(v) > 0 and forall(v, x -> x is not null and abs(x) < double('infinity'))")
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").head(1)
    dim = most[0]["dim"] if most else 1
    w, phase = random_features(dim, features, gamma)

    def run(batches):
        total, count, own = np.zeros((3, features)), np.zeros(3), np.zeros(3)
        for batch in batches:
            part = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            z = np.cos(v @ w.T + phase) * np.sqrt(2 / features)
            for k in range(3):
                mine = z[part == k]
                total[k] += mine.sum(0)
                count[k] += len(mine)
                own[k] += (mine * mine).sum()
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int32()), pa.array(count), pa.array(own), pa.array(total.tolist(), pa.list_(pa.float64()))], ["part", "n", "own", "total"])

    each = rows.where(F.size("v") == dim).mapInArrow(run, "part int, n double, own double, total array<double>")
    sums = each.select("part", "n", "own", F.posexplode("total").alias("pos", "x")).groupBy("part", "pos").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.sum("x").alias("x"))
    total, n, own = np.zeros((3, features)), np.zeros(3), np.zeros(3)
    for r in sums.collect():  # 3 x features rows
        total[r["part"], r["pos"]], n[r["part"]], own[r["part"]] = r["x"], r["n"], r["own"]

    def discrepancy(a: list[int], b: list[int]) -> float | None:
        (sa, na, oa), (sb, nb, ob) = ((total[k].sum(0), n[k].sum(), own[k].sum()) for k in (a, b))
        if na < 2 or nb < 2:
            return None
        return float((sa @ sa - oa) / (na * (na - 1)) + (sb @ sb - ob) / (nb * (nb - 1)) - 2 * (sa @ sb) / (na * nb))

    row = (int(n[0] + n[1]), int(n[2]), discrepancy([0, 1], [2]), discrepancy([0], [1]))
    return items.sparkSession.createDataFrame([row], "n_first long, n_second long, mmd2 double, baseline double")


def pairwise_mmd(items: DataFrame, key: str, vector: str, in_first: F.Column, gamma: float) -> DataFrame:
    """One row (n_first, n_second, mmd2): the unbiased estimate over all pairs (Gretton et al. 2012, lemma 6).

    Quadratic: for sets of at most MOST_PAIRED rows, which are broadcast and met by each batch in
    one matrix product; ``feature_mmd`` and ``linear_mmd`` take more. Rows as there.
    """
    ship(items.sparkSession)
    rows = items.where(F.col(key).isNotNull()).select(in_first.cast("int").alias("first"), F.col(vector).cast("array<double>").alias("v")).where("first is not null and v is not null")
    rows = rows.where("size(v) > 0 and forall(v, x -> x is not null and abs(x) < double('infinity'))")
    if rows.limit(MOST_PAIRED + 1).count() > MOST_PAIRED:
        raise ValueError(f"more than {MOST_PAIRED} rows: use feature_mmd or linear_mmd")
    table = rows.toArrow()
    first, v = table.column("first").to_numpy(), table.column("v").to_pylist()
    out = "n_first long, n_second long, mmd2 double"
    n = int(first.sum()), int((1 - first).sum())
    if min(n) < 2:
        return items.sparkSession.createDataFrame([(*n, None)], out)
    sent = items.sparkSession.sparkContext.broadcast((first.astype(bool), np.array(v)))

    def run(batches):
        side, all_ = sent.value
        square = (all_ * all_).sum(1)
        total = np.zeros(3)
        for batch in batches:
            own = batch.column(0).to_numpy().astype(bool)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            k = np.exp(-gamma * np.maximum(0, (x * x).sum(1)[:, None] + square[None, :] - 2 * x @ all_.T))
            total += [k[own][:, side].sum(), k[~own][:, ~side].sum(), k[own][:, ~side].sum()]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], ["xx", "yy", "xy"])

    s = rows.mapInArrow(run, "xx double, yy double, xy double").agg(*[F.sum(c).alias(c) for c in ("xx", "yy", "xy")])
    a, b = n
    value = (F.col("xx") - a) / (a * (a - 1)) + (F.col("yy") - b) / (b * (b - 1)) - 2 * F.col("xy") / (a * b)
    return s.select(F.lit(a).cast("long").alias("n_first"), F.lit(b).cast("long").alias("n_second"), value.alias("mmd2"))


#: Rows that pairwise_mmd takes.
MOST_PAIRED = 20_000
#: Components that principal_components takes; it keeps their products.
MOST_COMPONENTS = 4096


def principal_components(items: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, variances): the k directions of largest variance, by descending variance, each with its largest entry positive.

    Each task adds up products of components; the sums (dim x dim numbers) are added by a partial
    aggregation. Null, non-finite and odd-sized vectors take no part; no rows give no components.
    """
    ship(items.sparkSession)
    rows = items.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null and size(v) > 0 and forall(v, x -> x is not null and abs(x) < double('infinity'))")
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").head(1)
    if not most:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    dim, n = most[0]["dim"], most[0]["count"]
    if dim > MOST_COMPONENTS:
        raise ValueError(f"{dim} components; at most {MOST_COMPONENTS}")
    rows = rows.where(F.size("v") == dim)
    sums = rows.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x")).collect()
    mean = np.zeros(dim)
    for r in sums:
        mean[r["pos"]] = r["x"]

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["row", "total"])

    each = rows.mapInArrow(run, "row int, total array<double>").select("row", F.posexplode("total").alias("pos", "x"))
    product = np.zeros((dim, dim))
    for r in each.groupBy("row", "pos").agg(F.sum("x").alias("x")).collect():
        product[r["row"], r["pos"]] = r["x"]
    variance, axes = np.linalg.eigh(product / max(1, n - 1))
    order = np.argsort(-variance)[:k]
    axes = axes[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return mean, axes, np.maximum(0, variance[order])


def projected(items: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, projection): each vector less the mean along the k principal components. Rows as in ``principal_components``; others have a null projection."""
    mean, axes, _ = principal_components(items, vector, k)
    sent = items.sparkSession.sparkContext.broadcast((mean, axes))
    kind = dict(items.dtypes)[key]

    def run(batches):
        mean, axes = sent.value
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array(v, float) if v is not None and len(v) == len(mean) and None not in v else None
                out.append((axes @ (x - mean)).tolist() if x is not None and np.isfinite(x).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["key", "projection"])

    return items.select(key, F.col(vector).cast("array<double>")).mapInArrow(run, f"key {kind}, projection array<double>").select(F.col("key").alias(key), "projection")
