"""Linearised variances of totals, means and shares, with a policy for strata of a single PSU.

A total's variance comes from the PSUs' weighted sums, centred in their stratum. With
post-stratified weights a row counts by its residual from the weighted mean of its
post-stratum. That gives every PSU of the sample a value in every domain; here only
those that a domain's own members make are kept, and the means' share is worked out from
moments of strata and post-strata. So no table of PSUs by domains is made, and what
is left after one aggregation by stratum grows with strata, domains and post-strata only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domicilia.functions.student import t_quantile
from domicilia.operators.aggregates import strict_sum
from domicilia.operators.design import Design
from domicilia.operators.estimate import Measures
from domicilia.operators.joins import attach, bounded_side, null_safe
from domicilia.session import materialize

POLICIES = ("adjust", "average", "remove", "certainty", "fail")


@dataclass(frozen=True)
class Linearised:
    """A sample with post-stratified weights `w`, a row for each PSU or each of its members.

    rows             column that says how many sample rows a row stands for, none: one
    policy           what a stratum of one PSU adds to a variance: adjust, the square of the PSU's
                     distance from the mean of all PSUs; average, as much as the other strata on average;
                     remove and certainty, nothing; fail, an error
    post_stratified  whether residuals from post-strata count, or the values as they are
    """

    sample: DataFrame
    design: Design
    rows: str | None = None
    policy: str = "adjust"
    post_stratified: bool = True

    def __post_init__(self):
        if self.policy not in POLICIES:
            raise ValueError(f"no such policy: {self.policy}")

    @cached_property
    def weights(self) -> DataFrame:
        """(stratum, psu, post, w): the weight of each PSU by post-stratum; stored, as the sample may take long to make."""
        d = self.design
        weight = F.col("w") * F.col(self.rows) if self.rows else F.col("w")
        return materialize(self.sample.groupBy(d.stratum, d.psu, d.post).agg(F.sum(weight).alias("_w")))

    def _strata(self) -> DataFrame:
        """PSUs of each stratum."""
        d = self.design
        psus = self.weights if self.post_stratified else self.sample
        return psus.select(d.stratum, d.psu).distinct().groupBy(d.stratum).agg(F.count("*").alias("n_h"))

    def variances(self, values: DataFrame, by: Sequence[str]) -> DataFrame:
        """(by, variance) of the sums of `_u` by domain.

        `values` has (by, stratum, psu, post, _u), weighted, in any number of rows for a PSU; PSUs
        without any row of a domain have zero there, and still take part by their residuals.
        """
        d, by = self.design, list(by)
        keys = [d.stratum, d.psu]
        own = values.groupBy(*by, *keys).agg(F.sum("_u").alias("_a"))
        terms = own.groupBy(*by, d.stratum).agg(F.sum("_a").alias("_s"), F.sum(F.col("_a") * F.col("_a")).alias("_q"))
        if self.post_stratified:
            weights = self.weights
            sizes = weights.groupBy(d.post).agg(F.sum("_w").alias("_size"))
            means = values.groupBy(*by, d.post).agg(F.sum("_u").alias("_t")).join(sizes, d.post)
            means = means.select(*by, d.post, F.try_divide("_t", "_size").alias("_mean"))
            terms = terms.unionByName(self._crossed(own, weights, means, by)).unionByName(self._squared(weights, means, by))
        sums = terms.groupBy(*by, d.stratum).agg(F.sum("_s").alias("_s"), F.sum("_q").alias("_q"))
        return self._over_strata(sums, by)

    def _crossed(self, own: DataFrame, weights: DataFrame, means: DataFrame, by: list[str]) -> DataFrame:
        """What a domain's own values and the post-strata's means give together."""
        d = self.design
        keys = [d.stratum, d.psu]
        products = own.join(weights, keys).groupBy(*by, d.stratum, d.post).agg(F.sum(F.col("_a") * F.col("_w")).alias("_c"))
        joined = _matched(products, means, [*by, d.post])
        return joined.groupBy(*by, d.stratum).agg(F.lit(0.0).alias("_s"), F.sum(-2.0 * F.col("_c") * F.col("_mean")).alias("_q"))

    def _squared(self, weights: DataFrame, means: DataFrame, by: list[str]) -> DataFrame:
        """What the post-strata's means give alone, for every stratum and domain that share a post-stratum."""
        d = self.design
        keys = [d.stratum, d.psu]
        first = weights.groupBy(d.stratum, d.post).agg(F.sum("_w").alias("_w"))
        other = weights.withColumnsRenamed({d.post: "_post", "_w": "_v"})
        pairs = weights.join(other, keys).groupBy(d.stratum, d.post, "_post").agg(F.sum(F.col("_w") * F.col("_v")).alias("_g"))
        others = means.withColumnsRenamed({d.post: "_post", "_mean": "_other"})
        sums = first.join(means, d.post).groupBy(*by, d.stratum).agg(F.sum(-F.col("_w") * F.col("_mean")).alias("_s"))
        both = _matched(pairs.join(means, d.post), others, [*by, "_post"])
        squares = both.groupBy(*by, d.stratum).agg(F.sum(F.col("_g") * F.col("_mean") * F.col("_other")).alias("_q"))
        zero = F.lit(0.0)
        return sums.withColumn("_q", zero).unionByName(squares.withColumn("_s", zero))

    def _over_strata(self, sums: DataFrame, by: list[str]) -> DataFrame:
        d = self.design
        strata = bounded_side(self._strata(), d.side_limit)
        if strata.rows is None:
            counts = strata.frame.agg(F.sum("n_h"), F.count("*"), F.sum((F.col("n_h") == 1).cast("int"))).first()
        else:
            sizes = strata.rows["n_h"].to_pylist()
            counts = (sum(sizes), len(sizes), sizes.count(1))
        psus, n_strata, lonely = counts
        if lonely and self.policy == "fail":
            raise ValueError(f"{lonely} strata have a single PSU")
        sized = attach(sums, strata, [d.stratum], by or [d.stratum])
        several = F.col("n_h") > 1
        spread = F.col("_q") - F.col("_s") * F.col("_s") / F.col("n_h")
        inside = F.when(several, spread * F.col("n_h") / F.greatest(F.col("n_h") - 1, F.lit(1))).otherwise(0.0)
        moments = sized.groupBy(*by).agg(
            F.sum(inside).alias("_inside"),
            F.sum("_s").alias("_all"),
            F.sum(F.when(several, 0.0).otherwise(F.col("_q"))).alias("_lone_q"),
            F.sum(F.when(several, 0.0).otherwise(F.col("_s"))).alias("_lone_s"),
        )
        if self.policy == "adjust":
            # Single PSUs without any value in the domain stand at zero, as far from the mean as it is.
            mean = F.col("_all") / F.lit(psus or 1)
            alone = F.col("_lone_q") - 2 * mean * F.col("_lone_s") + F.lit(lonely or 0) * mean * mean
            variance = F.col("_inside") + alone
        elif self.policy == "average":
            variance = F.col("_inside") * F.lit(n_strata / (n_strata - lonely) if n_strata > lonely else None).cast("double")
        else:
            variance = F.col("_inside")
        # Sums of squares can end a little below zero by rounding.
        return moments.select(*by, F.greatest(variance, F.lit(0.0)).alias("variance"))

    def total(self, frame: DataFrame, by: Sequence[str], measures: Measures, **options) -> DataFrame:
        """Weighted totals by domain with errors; see `_errors` for the options.

        `frame` has stratum, psu, post-stratum and `w`. A measure of None counts rows. A NULL value
        makes the domain's total NULL, and its errors.
        """
        rows, by = self._measured(frame, by, measures, options.pop("fill", None))
        names = list(measures)
        points = rows.groupBy(*by).agg(*[strict_sum(F.col("w") * F.col(f"_x_{n}")).alias(n) for n in names])
        weighted = {n: rows.withColumn("_u", F.col("w") * F.coalesce(F.col(f"_x_{n}"), F.lit(0.0))) for n in names}
        return self._errors(points, weighted, by, names, **options)

    def mean(self, frame: DataFrame, by: Sequence[str], measures: Measures, **options) -> DataFrame:
        """Weighted means by domain, linearised as ratios of two totals."""
        rows, by = self._measured(frame, by, measures, options.pop("fill", None))
        names = list(measures)
        sums = [strict_sum(F.col("w") * F.col(f"_x_{n}")).alias(n) for n in names]
        totals = rows.groupBy(*by).agg(F.sum("w").alias("_size"), *sums)
        points = totals.select(*by, "_size", *[F.try_divide(n, "_size").alias(n) for n in names])
        placed = _placed(rows, points, by)
        weighted = {}
        for n in names:
            residual = F.coalesce(F.col(f"_x_{n}") - F.col(n), F.lit(0.0))
            weighted[n] = placed.withColumn("_u", F.try_divide(F.col("w") * residual, F.col("_size")))
        return self._errors(points.drop("_size"), weighted, by, names, **options)

    def share(self, frame: DataFrame, outer: Sequence[str], inner: str, name: str = "pct", **options) -> DataFrame:
        """Weighted share of each `inner` level in its outer group.

        Members of the other levels lower a share, so each PSU's weight in the group counts for all of its levels.
        """
        d, outer = self.design, list(outer)
        rows = frame.select(*dict.fromkeys([*outer, inner, d.stratum, d.psu, d.post, "w"]))
        psu = [d.stratum, d.psu, d.post]
        members = materialize(rows.groupBy(*outer, inner, *psu).agg(F.sum("w").alias("_w")))
        cells = members.groupBy(*outer, inner).agg(F.sum("_w").alias("_cell"))
        whole = cells.groupBy(*outer).agg(F.sum("_cell").alias("_size"))
        points = _matched(cells, whole, outer).select(*outer, inner, "_size", F.try_divide("_cell", "_size").alias(name))
        # Dealt by PSU before each row is taken once for every level, so that those need no shuffle.
        dealt = members.withColumnRenamed(inner, "_level").repartition(d.stratum, d.psu)
        inside = F.when(F.col("_level").eqNullSafe(F.col(inner)), 1.0).otherwise(0.0)
        values = _placed(dealt, points, outer).withColumn("_u", F.try_divide(F.col("_w") * (inside - F.col(name)), F.col("_size")))
        values = values.select(*outer, inner, *psu, "_u")
        return self._errors(points.drop("_size"), {name: values}, [*outer, inner], [name], **options)

    def _measured(self, frame: DataFrame, by: Sequence[str], measures: Measures, fill: str | None) -> tuple[DataFrame, list[str]]:
        """Design columns, domains and measures, stored; with `fill` also a copy of each row for the outer groups and for all."""
        d, by = self.design, list(by)
        inputs = [(F.lit(1.0) if v is None else v.cast("double")).alias(f"_x_{n}") for n, v in measures.items()]
        rows = materialize(frame.select(*dict.fromkeys([*by, d.stratum, d.psu, d.post, "w"]), *inputs))
        if fill is None:
            return rows, by
        levels = F.explode(F.sequence(F.lit(0), F.lit(len(by))))
        copies = rows.withColumn("_level", levels)
        rolled = {c: F.when(F.col("_level") > k, F.col(c).cast("string")).otherwise(F.lit(fill)) for k, c in enumerate(by)}
        return copies.withColumns(rolled).drop("_level"), by

    def _errors(
        self,
        points: DataFrame,
        weighted: dict[str, DataFrame],
        by: list[str],
        names: list[str],
        vartype: Sequence[str] = ("se",),
        df: float | None = None,
    ) -> DataFrame:
        """Estimates with errors (se, cv, ci); intervals use Student's t with PSUs less strata degrees of freedom."""
        result = points
        for n in names:
            variance = self.variances(weighted[n], by).withColumnRenamed("variance", f"_v_{n}")
            result = _matched(result, variance, by, "left")
        quantile = t_quantile(0.95, df or self.degrees_of_freedom()) if "ci" in vartype else None
        out = []
        for n in names:
            value = F.col(n)
            error = F.when(value.isNotNull(), F.sqrt(f"_v_{n}"))
            out.append(value)
            if "se" in vartype:
                out.append(error.alias(f"{n}_se"))
            if "cv" in vartype:
                out.append(F.try_divide(error, value).alias(f"{n}_cv"))
            if quantile is not None:
                out += [(value - quantile * error).alias(f"{n}_low"), (value + quantile * error).alias(f"{n}_upp")]
        return result.select(*by, *out)

    def degrees_of_freedom(self) -> int:
        """PSUs less strata, one at least."""
        row = self._strata().agg(F.sum("n_h"), F.count("*")).first()
        return max((row[0] or 0) - row[1], 1)


def _matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key is a key like any other; without keys, one row meets all."""
    on = list(on)
    if not on:
        return left.join(F.broadcast(right), how="cross" if how == "inner" else how, on=F.lit(True))
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    joined = left.join(renamed, null_safe(left, renamed, [(c, f"_r_{c}") for c in on]), how)
    return joined.drop(*[f"_r_{c}" for c in on])


def _placed(rows: DataFrame, points: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with the estimates of their domains: broadcast where these were found to be few, a domain may hold most rows."""
    on = list(on)
    side = bounded_side(points)
    if not on:
        return rows.join(F.broadcast(side.frame))
    renamed = side.frame.withColumnsRenamed({c: f"_r_{c}" for c in on})
    if not side.bounded:
        return _matched(rows, side.frame, on)
    condition = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on])
    return rows.join(F.broadcast(renamed), condition).drop(*[f"_r_{c}" for c in on])
