"""Mean vector, scatter matrix, principal basis and 3-D positions per dataset
(AGG-1, AGG-2, AGG-3, VEC-3, VEC-4).

Everything a map is fitted from is one *statistic* per dataset: the number of
its points, the sum of their vectors and the rows of ``X^T X``, as a table
``(dataset, i, row, s, n)``. Each task folds its rows into a partial statistic
per dataset (at most ``MAX_OPEN_GRAMS`` open at a time, the rest flushed as
extra partials); the partials are added per ``(dataset, i)``, a group bounded
by the number of partials, not by the rows; and one ``eigh`` of a d x d matrix
runs per dataset.

Statistics add up, so a stored one follows changes: ``changed_statistics``
folds the rows that left a dataset with a negative sign and those that came
with a positive one, and ``merge_statistics`` adds the result to what is
stored. Only changed rows are read. A dataset without points has no statistic,
so what rounding leaves behind goes with its last point.

The projection is one row per dataset (mean, basis), small enough to join back
to the points (AQE turns that join into a broadcast from runtime statistics).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmap.functions.vectors import dot, subtract
from corpusmap.session import cut_lineage

COMPONENTS = 3
FAN_IN = 256                # partial matrix rows added in one group
MAX_OPEN_GRAMS = 32         # d x d accumulators a task keeps before flushing


def mean_vectors(df: DataFrame, group_cols: list[str], vec_col: str = "vector",
                 out: str = "mean") -> DataFrame:
    """AGG-1: element-wise mean per group (native). Partial sums are combined
    map-side, so each task ships at most groups x d cells."""
    cells = (df.select(*group_cols, F.posexplode(vec_col).alias("pos", "val"))
             .groupBy(*group_cols, "pos").agg(F.avg(F.col("val").cast("double")).alias("m")))
    return (cells.groupBy(*group_cols)
            .agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_cells"))
            .select(*group_cols, F.transform("_cells", lambda s: s["m"]).alias(out)))


_GRAM_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("i", T.IntegerType()),
    T.StructField("row", T.ArrayType(T.DoubleType(), False)),
    T.StructField("s", T.DoubleType()),
    T.StructField("n", T.LongType()),
])


def _gram_frame(ds, g, s, n) -> pd.DataFrame:
    d = g.shape[0]
    return pd.DataFrame({"dataset": [ds] * d, "i": np.arange(d, dtype=np.int32),
                         "row": list(g), "s": s, "n": np.full(d, n, dtype=np.int64)})


def _partial_gram(batches, max_open: int = MAX_OPEN_GRAMS):
    acc: dict[str, list] = {}
    for pdf in batches:
        if pdf.empty:
            continue
        for ds, grp in pdf.groupby("dataset", sort=False):
            x = np.stack(grp["vector"].to_numpy()).astype(np.float64)
            sign = grp["sign"].to_numpy(dtype=np.float64) if "sign" in grp else np.ones(len(x))
            g = x.T @ (x * sign[:, None])
            s = sign @ x
            n = int(sign.sum())
            if ds in acc:
                acc[ds][0] += g
                acc[ds][1] += s
                acc[ds][2] += n
            else:
                if len(acc) >= max_open:              # bound memory: flush the oldest partial
                    old = next(iter(acc))
                    yield _gram_frame(old, *acc.pop(old))
                acc[ds] = [g, s, n]
    for ds, (g, s, n) in acc.items():
        yield _gram_frame(ds, g, s, n)


def _added() -> list:
    """Aggregates that add statistics of the same ``(dataset, i)``."""
    rows = F.collect_list("row")
    total = F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), F.element_at(rows, 1),
                        lambda acc, r: F.zip_with(acc, r, lambda a, b: a + b))
    return [total.alias("row"), F.sum("s").alias("s"), F.sum("n").cast("long").alias("n")]


def gram_rows(points: DataFrame, vec_col: str = "vector", max_open: int = MAX_OPEN_GRAMS) -> DataFrame:
    """Per (dataset, i): row i of X^T X, sum of coordinate i, n (AGG-2 input). A
    column ``sign`` (1 or -1), if there, says whether a point is added or taken away.

    The per-task partials are added natively in two levels: ``FAN_IN``
    neighbouring tasks first, then their sums, so a group stays small however
    many tasks saw the dataset."""
    sign = ["sign"] if "sign" in points.columns else []
    pv = points.select(F.col("dataset").cast("string"), F.col(vec_col).alias("vector"), *sign)
    partial = pv.mapInPandas(lambda it: _partial_gram(it, max_open), schema=_GRAM_SCHEMA)
    near = partial.withColumn("near", F.floor(F.spark_partition_id() / FAN_IN))
    return near.groupBy("dataset", "i", "near").agg(*_added()).groupBy("dataset", "i").agg(*_added())


def changed_statistics(gone: DataFrame, come: DataFrame, vec_col: str = "vector") -> DataFrame:
    """The statistic of a change: rows ``(dataset, vector)`` that left their
    dataset and rows that came to one. An edited row is in both."""
    signed = [df.select("dataset", F.col(vec_col).alias("vector"), F.lit(sign).alias("sign"))
              for df, sign in ((gone, -1), (come, 1))]
    return gram_rows(signed[0].unionByName(signed[1]))


def merge_statistics(stored: DataFrame, change: DataFrame) -> DataFrame:
    """Stored and changed statistics added; datasets without points left go."""
    both = stored.select("dataset", "i", "row", "s", "n").unionByName(change.select("dataset", "i", "row", "s", "n"))
    return both.groupBy("dataset", "i").agg(*_added()).filter(F.col("n") > 0)


def scatter_of(statistics: DataFrame) -> DataFrame:
    """AGG-2: ``(dataset, i, j, value)`` of ``Xc^T Xc = X^T X - n mu mu^T``."""
    mu = statistics.select("dataset", "i", (F.col("s") / F.col("n")).alias("mu_i"))
    means = (mu.groupBy("dataset")
             .agg(F.sort_array(F.collect_list(F.struct("i", "mu_i"))).alias("_m"))
             .select("dataset", F.transform("_m", lambda s: s["mu_i"]).alias("mu")))
    cells = (statistics.join(means, "dataset")
             .select("dataset", "i", "n", "s", "mu", F.posexplode("row").alias("j", "xtx")))
    return cells.select("dataset", "i", "j",
                        (F.col("xtx") - F.col("s") * F.element_at("mu", F.col("j") + 1)).alias("value"))


def scatter_matrix(points: DataFrame, vec_col: str = "vector") -> DataFrame:
    """AGG-2 from the points themselves. The statistic is small (d rows per
    dataset) and read twice, so it is written once."""
    return scatter_of(cut_lineage(gram_rows(points, vec_col), "statistics"))


_BASIS_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("mean", T.ArrayType(T.DoubleType(), False)),
    T.StructField("basis", T.ArrayType(T.ArrayType(T.DoubleType(), False), False)),
    T.StructField("eigenvalues", T.ArrayType(T.DoubleType(), False)),
])


def basis_from_scatter(xtx: np.ndarray, s: np.ndarray, n: int, components: int = COMPONENTS):
    """Mean, principal directions (rows, descending) and their eigenvalues.

    ``c = min(components, n - 1)`` directions are filled, the rest are zero;
    each direction's largest-magnitude loading is made positive.
    """
    d = xtx.shape[0]
    mean = s / n if n > 0 else np.zeros(d)
    basis = np.zeros((components, d))
    values = np.zeros(components)
    if n > 1:
        scatter = xtx - n * np.outer(mean, mean)
        scatter = (scatter + scatter.T) / 2.0
        w, v = np.linalg.eigh(scatter)
        c = min(components, n - 1)
        for k in range(c):
            vec = v[:, d - 1 - k]
            if vec[np.argmax(np.abs(vec))] < 0:
                vec = -vec
            basis[k] = vec
            values[k] = w[d - 1 - k]
    return mean, basis, values


def _fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("i")
    xtx = np.stack(pdf["row"].to_numpy())
    s = pdf["s"].to_numpy(dtype=np.float64)
    n = int(pdf["n"].iloc[0])
    mean, basis, values = basis_from_scatter(xtx, s, n)
    return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]], "n": [n], "mean": [mean],
                         "basis": [list(basis)], "eigenvalues": [values]})


def fit_projection(points: DataFrame, vec_col: str = "vector", max_open: int = MAX_OPEN_GRAMS) -> DataFrame:
    """AGG-3: one row per dataset ``(dataset, n, mean, basis[3][d], eigenvalues)``,
    from the partial Gram matrices (``eigh``) whatever the dataset's size."""
    return fit_statistics(gram_rows(points, vec_col, max_open))


def fit_statistics(statistics: DataFrame) -> DataFrame:
    """AGG-3 from a statistic table, stored or just computed."""
    return statistics.groupBy("dataset").applyInPandas(_fit_one, schema=_BASIS_SCHEMA)


def project(points: DataFrame, projection: DataFrame, vec_col: str = "vector",
            places: int | None = 4, how: str = "inner") -> DataFrame:
    """VEC-3/VEC-4: ``x, y, z = (v - mean) . basis_k`` with the dataset's own
    (stored) mean and basis; rounded half away from zero when ``places``. With
    ``how="left"`` a vector of a dataset without a map sits at the origin."""
    j = points.join(projection.select("dataset", "mean", "basis"), "dataset", how)
    centred = subtract(vec_col, "mean")
    out = j.withColumn("_c", centred)
    for k, name in enumerate(("x", "y", "z")):
        val = F.when(F.col("basis").isNull(), 0.0).otherwise(dot("_c", F.col("basis")[k]))
        out = out.withColumn(name, F.round(val, places) if places is not None else val)
    return out.drop("_c", "mean", "basis")
