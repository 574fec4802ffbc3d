"""Totals, means and shares with bootstrap errors.

Input frames carry `w` (final weight) and `draws` (see `design`). The full sample
travels as replicate 0. All weighting happens in one partial aggregation by (domain,
replicate), so what is shuffled is domains x replicates rows per task, whatever the
number of sample rows. Roll-ups, ratios and errors are computed on those few totals.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domicilia.functions.student import t_quantile
from domicilia.operators.aggregates import strict_sum, total_rows
from domicilia.operators.design import Design, Replicates
from domicilia.operators.joins import null_safe_left_join

Measures = Mapping[str, Column | None]


def replicate_totals(
    frame: DataFrame, by: Sequence[str], measures: Measures, replicates: Replicates, na_rm: bool = False
) -> DataFrame:
    """Weighted sums by domain and replicate; replicate 0 is the full sample.

    A measure of None counts rows. Every domain has a row for every replicate, also
    for those that drew none of its PSUs. A NULL value makes the domain's sum NULL
    unless `na_rm`.
    """
    design = replicates.design
    inputs = [value.alias(f"_x_{name}") for name, value in measures.items() if value is not None]
    if design.replicates:
        needed = dict.fromkeys(["w", "draws", *by])
        weighted = replicates.unfold(frame.select(*needed, *inputs)).withColumn("_w", F.col("w") * F.col("factor"))
    else:
        weighted = frame.select(*by, F.col("w").alias("_w"), *inputs)

    def total(name: str, value: Column | None) -> Column:
        if value is None:
            return F.sum("_w")
        product = F.col("_w") * F.col(f"_x_{name}")
        return F.sum(product) if na_rm else strict_sum(product)

    sums = [total(n, v).alias(n) for n, v in measures.items()]
    if design.replicates:
        return weighted.groupBy(*by, "rep").agg(*sums)
    return weighted.groupBy(*by).agg(*sums).withColumn("rep", F.lit(0))


def _with_totals(totals: DataFrame, by: Sequence[str], names: Sequence[str], fill: str | None) -> DataFrame:
    if fill is None:
        return totals
    return total_rows(totals, by, ["rep"], [strict_sum(F.col(n)).alias(n) for n in names], fill)


# At most so many sums of products are held at a time in a task that adds them up by domain.
_HELD_CELLS = 4_000_000


def degrees_of_freedom(frame: DataFrame, replicates: Replicates, by: Sequence[str] = ()) -> DataFrame:
    """(by, df): rank of the matrix of replicate weights of each domain's PSUs, less one.

    A row's weights are its numbers of draws times one positive scale, so the numbers alone have the same
    rank, and so has the matrix of their products, replicates by replicates, which tasks add up
    exactly in whole numbers. Nothing of the size of the sample is put in one place. A domain
    whose PSUs are drawn in no replicate has 0. NULL is a domain like any other.
    """
    size, by = replicates.design.replicates, list(by)
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, total in held.items():
                cells = np.arange(size * size)
                columns = [pa.array([name] * len(cells)), pa.array(cells), pa.array(total.ravel().astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "_cell", "_sum"])
            held.clear()

        for batch in batches:
            counts = batch.column("_counts").flatten().to_numpy(zero_copy_only=False).reshape(-1, size + 1)[:, 1:].astype(np.float64)
            names = batch.column("_key").dictionary_encode()
            which = names.indices.to_numpy()
            for k, name in enumerate(names.dictionary.to_pylist()):
                own = counts[which == k]
                held[name] = held.get(name, 0) + own.T @ own  # whole numbers below 2^53
                if len(held) * size * size > _HELD_CELLS:
                    yield from flush()
        yield from flush()

    def rank(cells: pa.Table) -> pa.Table:
        gram = np.zeros(size * size)
        gram[cells["_cell"].to_numpy()] = cells["_sum"].to_numpy()
        values = np.linalg.eigvalsh(gram.reshape(size, size))
        found = int((values > 1e-10 * max(values.max(), 0.0)).sum())
        return pa.table({"_key": [cells["_key"][0].as_py()], "df": pa.array([max(found - 1, 0)], pa.int32())})

    rows = frame.select(key.alias("_key"), F.col("draws.counts").alias("_counts"))
    partial = rows.mapInArrow(add, "_key string, _cell long, _sum long")
    sums = partial.groupBy("_key", "_cell").agg(F.sum("_sum").alias("_sum"))
    ranks = sums.groupBy("_key").applyInArrow(rank, "_key string, df int")
    if not by:
        return ranks.select("df")
    parsed = F.from_json("_key", frame.select(*by).schema)
    return ranks.select(parsed.alias("_by"), "df").select(*[F.col(f"_by.`{c}`").alias(c) for c in by], "df")


def _quantiles(result: DataFrame, by: Sequence[str], df: DataFrame, replicates: int) -> DataFrame:
    """The result with `_t`, the quantile for the degrees of freedom of each domain; NULL without any."""
    values = F.array(*[F.lit(t_quantile(0.95, k)) for k in range(1, replicates)])
    known = df.select(*by, F.when(F.col("df") > 0, F.element_at(values, F.col("df"))).alias("_t"))
    return null_safe_left_join(result, known, by) if by else result.join(F.broadcast(known))


def summarise(
    totals: DataFrame,
    by: Sequence[str],
    names: Sequence[str],
    design: Design,
    vartype: Sequence[str],
    df: float | DataFrame | None = None,
) -> DataFrame:
    """Estimate and errors (se, cv, ci) from one value per domain and replicate.

    Intervals use Student's t with `df` degrees of freedom, replicates - 1 by default, or those of
    each domain in a frame made by `degrees_of_freedom`; no interval where there are none. A design
    without replicates gives the estimates alone.
    """
    if not design.replicates:
        return totals.select(*by, *names)
    columns = []
    for name in names:
        columns.append(F.max(F.when(F.col("rep") == 0, F.col(name))).alias(name))
        columns.append(F.stddev_samp(F.when(F.col("rep") > 0, F.col(name))).alias(f"{name}_se"))
    result = totals.groupBy(*by).agg(*columns)
    extra, dropped = {}, []
    if "ci" in vartype and isinstance(df, DataFrame):
        result = _quantiles(result, [c for c in by if c in df.columns], df, design.replicates)
        quantile = F.col("_t")
        dropped.append("_t")
    elif "ci" in vartype:
        quantile = F.lit(t_quantile(0.95, df or design.replicates - 1))
    for name in names:
        value, error = F.col(name), F.col(f"{name}_se")
        if "ci" in vartype:
            extra[f"{name}_low"] = value - quantile * error
            extra[f"{name}_upp"] = value + quantile * error
        if "cv" in vartype:
            extra[f"{name}_cv"] = F.try_divide(error, value)
        if "se" not in vartype:
            dropped.append(f"{name}_se")
    return result.withColumns(extra).drop(*dropped) if extra else result.drop(*dropped)


def survey_total(
    frame: DataFrame,
    by: Sequence[str],
    measures: Measures,
    replicates: Replicates,
    vartype: Sequence[str] = ("se",),
    fill: str | None = None,
    na_rm: bool = False,
    df: float | DataFrame | None = None,
) -> DataFrame:
    """Weighted totals; `fill` adds roll-up rows labelled with it. No errors asked for: no replicates."""
    replicates = replicates if vartype else replicates.none()
    totals = _with_totals(replicate_totals(frame, by, measures, replicates, na_rm), by, list(measures), fill)
    return summarise(totals, by, list(measures), replicates.design, vartype, df)


def survey_mean(
    frame: DataFrame,
    by: Sequence[str],
    measures: Mapping[str, Column],
    replicates: Replicates,
    vartype: Sequence[str] = ("se",),
    fill: str | None = None,
    df: float | DataFrame | None = None,
) -> DataFrame:
    """Weighted means; the ratio is taken in each replicate."""
    names = list(measures)
    totals = replicate_totals(frame, by, {**measures, "_size": None}, replicates)
    totals = _with_totals(totals, by, [*names, "_size"], fill)
    ratios = totals.select(*by, "rep", *[F.try_divide(n, "_size").alias(n) for n in names])
    return summarise(ratios, by, names, replicates.design, vartype, df)


def survey_share(
    frame: DataFrame,
    outer: Sequence[str],
    inner: str,
    replicates: Replicates,
    name: str = "pct",
    vartype: Sequence[str] = ("se",),
    df: float | DataFrame | None = None,
) -> DataFrame:
    """Weighted share of each `inner` level within its outer group."""
    totals = replicate_totals(frame, [*outer, inner], {name: None}, replicates)
    whole = totals.groupBy(*outer, "rep").agg(F.sum(name).alias("_all"))
    ratios = null_safe_left_join(totals, whole, [*outer, "rep"]).withColumn(name, F.try_divide(name, "_all")).drop("_all")
    return summarise(ratios, [*outer, inner], [name], replicates.design, vartype, df)


def reposted_totals(
    frame: DataFrame,
    sample: DataFrame,
    by: Sequence[str],
    measures: Measures,
    replicates: Replicates,
    rows: str | None = None,
    na_rm: bool = False,
) -> DataFrame:
    """As `replicate_totals`, with each replicate post-stratified anew.

    `sample` is the full sample and `rows` the number of sample rows that one of its
    rows stands for. The correction is the same for all rows of a post-stratum and
    replicate, so it is applied to totals by domain and post-stratum.
    """
    post = replicates.design.post
    sizes = replicate_totals(sample, [post], {"_size": F.col(rows) if rows else None}, replicates)
    known = sizes.filter("rep = 0").select(post, F.col("_size").alias("_known"))
    corrections = sizes.join(known, post).select(post, "rep", F.try_divide("_known", "_size").alias("_g"))
    cells = replicate_totals(frame, [*by, post], measures, replicates, na_rm).join(corrections, [post, "rep"], "left")
    return cells.groupBy(*by, "rep").agg(*[strict_sum(F.col(n) * F.col("_g")).alias(n) for n in measures])
