"""Distributed order statistics without a global sort or a single-task window.

Both helpers use a two-level histogram: values are first counted per
equal-width cell (at most ``CELLS`` rows per group, so the running count over
cells is a bounded window), then only the cells that hold a wanted rank are
opened and their *distinct* values ranked.  No task ever sees more than one
cell's distinct values, and nothing passes through the driver.  The narrow
input (group, value) is checkpointed once, because it is read several times.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.session import checkpoint_dir

CELLS = 4096


def _materialise(df: DataFrame) -> DataFrame:
    """Write a narrow intermediate once to the shared checkpoint folder, so the
    several statistics below read it instead of recomputing its whole lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _stored(df: DataFrame) -> DataFrame:
    """Write a wide intermediate once as Parquet in the shared checkpoint folder: compressed
    columns, where a checkpoint holds 8 bytes and more a column and row."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _cell(x: Column, lo: Column, hi: Column, cells: int) -> Column:
    width = hi - lo
    raw = F.when(width > 0, F.floor((x - lo) / width * cells)).otherwise(F.lit(0))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(cells - 1)).cast("int")


MAX_CELL_ROWS = 1 << 20        # the final per-cell window never sees more rows than this
MAX_LEVELS = 12


def _pick_cells(hist: DataFrame, keys: list[str], want: DataFrame, rank: str) -> DataFrame:
    """From a cell histogram (keys…, _c, _cn) and wanted ranks (keys…, target…, rank)
    keep, per wanted rank, the cell holding it and the rank left inside it."""
    wc = Window.partitionBy(*keys).orderBy("_c").rowsBetween(
        Window.unboundedPreceding, -1)                          # ≤ cells rows per key
    h = hist.withColumn("_before", F.coalesce(F.sum("_cn").over(wc), F.lit(0)))
    j = want.join(h, keys)
    return (j.filter((F.col(rank) >= F.col("_before"))
                     & (F.col(rank) < F.col("_before") + F.col("_cn")))
             .withColumn(rank, F.col(rank) - F.col("_before")).drop("_before"))


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = (),
                    cells: int = CELLS, max_cell_rows: int = MAX_CELL_ROWS) -> DataFrame:
    """Linear-interpolated quantiles (numpy / ``quantile_cont`` definition).

    Returns one row per group and q: ``by..., q, value``.  Nulls are ignored.

    Level 1 counts values per equal-width cell of each group; only the cells
    holding a wanted rank are kept.  While such a cell still holds more than
    ``max_cell_rows`` distinct values, it is re-binned on its own exact
    min / max (each level narrows it by up to ``cells``×), so heavy clusters and
    far outliers cannot force a large group into one task.  The final window
    ranks the distinct values of small cells only.  The few wanted ranks
    (≤ 2 per group and q) are the only thing the loop inspects on the driver.
    """
    by = list(by)
    # equal values are counted first: all that follows costs the distinct values
    d = _materialise(df.select(*by, F.col(col).cast("double").alias("_x"))
                     .filter(F.col("_x").isNotNull()).groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_vn")))
    if by:
        stats = d.groupBy(*by).agg(F.sum("_vn").alias("_n"), F.min("_x").alias("_lo"),
                                   F.max("_x").alias("_hi"))
        d1 = d.join(stats, by)
    else:                                                      # scalar subqueries, no join
        d1 = d.withColumns({"_n": d.agg(F.sum("_vn")).scalar(),
                            "_lo": d.agg(F.min("_x")).scalar(),
                            "_hi": d.agg(F.max("_x")).scalar()})
    tk = by + ["q", "_side"]                                   # one wanted rank = one target
    cell = [F.sum("_vn").alias("_cn"), F.count(F.lit(1)).alias("_cd")]      # rows, distinct values

    # level 1 on whole groups (rows are not repeated per target); the wanted
    # ranks floor / ceil of h = (n − 1)·q are generated in-row on each cell
    d1 = d1.withColumn("_c", _cell(F.col("_x"), F.col("_lo"), F.col("_hi"), cells))
    hist = d1.groupBy(*by, "_c").agg(*cell, F.first("_n").alias("_n"))
    wc = (Window.partitionBy(*by) if by else Window).orderBy("_c").rowsBetween(
        Window.unboundedPreceding, -1)                         # ≤ cells rows per group
    hist = hist.withColumn("_before", F.coalesce(F.sum("_cn").over(wc), F.lit(0)))
    want = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(side).alias("_side"))
                     for q in qs for side in (0, 1)])
    t = hist.withColumn("_w", F.explode(want)).select(
        *by, "_c", "_cn", "_cd", "_before", F.col("_w.q").alias("q"), F.col("_w._side").alias("_side"),
        ((F.col("_n") - 1) * F.col("_w.q")).alias("_h"))
    t = t.withColumn("_r", F.when(F.col("_side") == 0, F.floor("_h")).otherwise(F.ceil("_h")))
    t = t.filter((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_cn")))
    picked = _materialise(t.withColumn("_r", (F.col("_r") - F.col("_before")).cast("long"))
                           .drop("_before"))
    rows = d1.join(picked.select(*by, "_c", "q", "_side"), by + ["_c"]).select(*tk, "_x", "_vn")

    for level in range(MAX_LEVELS + 1):
        big = picked.agg(F.max("_cd")).first()[0]
        if big is None or big <= max_cell_rows:
            break
        if level == MAX_LEVELS:
            raise RuntimeError(f"a cell still holds {big} values after {MAX_LEVELS} levels")
        rows = _materialise(rows)
        rng = rows.groupBy(*tk).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        r2 = rows.join(rng, tk).withColumn("_c", _cell(F.col("_x"), F.col("_lo"), F.col("_hi"), cells))
        hist = r2.groupBy(*tk, "_c").agg(*cell)
        picked = _materialise(_pick_cells(hist, tk, picked.select(*tk, "_h", "_r"), "_r"))
        rows = r2.join(picked.select(*tk, "_c"), tk + ["_c"]).select(*tk, "_x", "_vn")

    # final: rank the distinct values of each (small) wanted cell
    wv = Window.partitionBy(*tk).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    dv = rows.withColumn("_vb", F.coalesce(F.sum("_vn").over(wv), F.lit(0)))
    hit = (dv.join(picked.select(*tk, "_h", "_r"), tk)
             .filter((F.col("_r") >= F.col("_vb")) & (F.col("_r") < F.col("_vb") + F.col("_vn"))))
    g = hit.groupBy(*by, "q").agg(
        F.min_by("_x", "_side").alias("_vlo"), F.max_by("_x", "_side").alias("_vhi"),
        F.first("_h").alias("_h"))
    frac = F.col("_h") - F.floor("_h")
    val = F.col("_vlo") + frac * (F.col("_vhi") - F.col("_vlo"))
    return g.select(*by, "q", val.alias("value"))


def exact_quantile(df: DataFrame, col: str, q: float) -> Column:
    """One global quantile as a scalar subquery Column."""
    return exact_quantiles(df, col, [q]).select("value").scalar()


def ordered_prefix(df: DataFrame, order: list[str], value: str | None, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` (or a running row count when None) in
    the total order ``order``, computed without any single-task window over the
    data: range-partition on the order, sum inside each range partition (one
    task per balanced partition), add the totals of earlier partitions (a
    window over at most #partitions rows).  The partitioned rows are written
    once to the shared checkpoint folder, so the totals and the rows come from
    the same partitioning.  Runs one job (the checkpoint) when called.
    """
    v = F.lit(1).cast("long") if value is None else F.col(value)
    d = df.repartitionByRange(*order).withColumns({"_pid": F.spark_partition_id(), "_v": v})
    d = _materialise(d)
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_v").over(w), F.lit(0)))
    sizes = d.groupBy("_pid").agg(F.sum("_v").alias("_tot"))
    wp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_tot").over(wp), F.lit(0)))
    return (d.join(offs, "_pid").withColumn(out, F.col("_off") + F.col("_in"))
             .drop("_pid", "_v", "_in", "_tot", "_off"))


def global_index(df: DataFrame, order: list[str], name: str = "_gidx") -> DataFrame:
    """0-based position of every row in the total order ``order`` (a
    distributed zipWithIndex)."""
    return ordered_prefix(df, order, None, name)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve with tie-averaged ranks (Mann–Whitney).

    AUC = Σ_s pos(s)·(neg_below(s) + neg(s)/2) / (P·N) over distinct scores s;
    neg_below is a distributed prefix sum over the distinct scores.
    Returns one row ``roc_auc`` (null when a class is missing).
    """
    y = (F.col(label).cast("double") > 0).cast("long")
    s = df.select(y.alias("_y"), F.col(score).cast("double").alias("_s")).filter(
        F.col("_s").isNotNull())
    ds = s.groupBy("_s").agg(F.sum("_y").alias("_p"), F.sum(1 - F.col("_y")).alias("_n"))
    ds = ordered_prefix(ds, ["_s"], "_n", "_below")
    contrib = F.col("_p") * (F.col("_below") + F.col("_n") / 2.0)
    tot = ds.agg(F.sum(contrib).alias("_a"), F.sum("_p").alias("_P"), F.sum("_n").alias("_N"))
    return tot.select(F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                             F.col("_a") / (F.col("_P") * F.col("_N"))).alias("roc_auc"))
