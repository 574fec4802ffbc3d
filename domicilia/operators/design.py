"""Sample design: post-stratified weights and Rao-Wu bootstrap replicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domicilia.operators.joins import SIDE_LIMIT, Side, attach, bounded_side
from domicilia.session import materialize

# Poisson counts above this have a probability below double precision (rate <= 1).
_POISSON_TERMS = 18
# Hashing of 32-bit words.
_WORD, _MULTIPLIER, _STRIDE = 0xFFFFFFFF, 0x45D9F3B, 0x9E3779B1
_DRAW_CHUNK = 4096
_DRAWS_PER_TASK = 500_000
# A stratum's row holds arrays, so fewer of them count as small.
_STRATUM_ROW = 10
DRAWS = "struct<scale: double, counts: array<smallint>>"


@dataclass(frozen=True)
class Design:
    """Names the design columns and fixes the replicates.

    psu, stratum     primary sampling unit, nested in its stratum
    weight           weight before post-stratification
    post, population post-stratum and its known size
    replicates, seed number of bootstrap replicates (0: estimates without errors) and the
                     seed of their draws
    buckets          into how many parts a stratum is split to number its PSUs
    slack            see `replicate`
    """

    psu: str = "A01nficha"
    stratum: str = "A01setor"
    weight: str = "PESO_PRE"
    post: str = "POS_ESTRATO"
    population: str = "POP_AJUSTADA_PROJ"
    replicates: int = 50
    seed: int = 8888
    buckets: int = 256
    slack: float = 6.0
    side_limit: int = SIDE_LIMIT


def design_summary(frame: DataFrame, design: Design) -> DataFrame:
    """PSUs, rows and weights of each stratum, for a frame of PSUs or of their members."""
    psus = frame.groupBy(design.stratum, design.psu).agg(F.count("*").alias("n"), F.sum(design.weight).alias("w"))
    return psus.groupBy(design.stratum).agg(
        F.count("*").alias("n_psu"), F.sum("n").alias("n_rows"), F.sum("w").alias("weight_sum")
    )


def post_strata(frame: DataFrame, design: Design, rows: str | None = None) -> DataFrame:
    """Known population and sample weight of each post-stratum.

    `rows` names a column saying how many sample rows one row of `frame` stands for.
    """
    weight = F.col(design.weight) * (F.col(rows) if rows else F.lit(1))
    population = F.col(design.population)
    total = F.sum(weight)
    known = F.col(design.post).isNotNull() & (F.count(population) == F.count("*"))
    constant = F.min(population).eqNullSafe(F.max(population))
    checked = (
        F.when(~known, F.raise_error(F.lit("a post-stratum or its population is missing")))
        .when(constant, F.max(population))
        .otherwise(F.raise_error(F.lit("the population must be constant in a post-stratum")))
    )
    positive = F.when(total > 0, total).otherwise(F.raise_error(F.lit("a post-stratum has no weight")))
    return frame.groupBy(design.post).agg(checked.alias("freq"), positive.alias("weight_sum"))


def post_stratify(frame: DataFrame, design: Design, rows: str | None = None) -> DataFrame:
    """Add `w`, the weight scaled so that each post-stratum meets its population.

    A missing post-stratum, population, stratum or PSU, and a post-stratum without weight,
    are errors.
    """
    totals = bounded_side(post_strata(frame, design, rows), design.side_limit)
    factors = totals.map(lambda t: t.select(design.post, F.try_divide("freq", "weight_sum").alias("_g")))
    weighted = attach(frame, factors, [design.post], [design.stratum, design.psu])
    return weighted.withColumn("w", _placed(design, F.col(design.weight) * F.col("_g"))).drop("_g")


def _placed(design: Design, value: Column) -> Column:
    """The value, for rows that have a stratum and a PSU; an error for others."""
    known = F.col(design.stratum).isNotNull() & F.col(design.psu).isNotNull()
    return F.when(known, value).otherwise(F.raise_error(F.lit("a stratum or a PSU is missing")))


# Expressions that are used in several places are written as SQL text.


def _hex(text: str, start: int, digits: int) -> str:
    return f"cast(conv(substring({text}, {start}, {digits}), 16, 10) as bigint)"


def _digest(design: Design, *parts: str) -> str:
    return f"md5(concat_ws(':', '{design.seed}', `{design.stratum}`, {', '.join(parts)}))"


def _bucket(design: Design) -> Column:
    text = _hex(f"md5(cast(`{design.psu}` as string))", 1, 8)
    return F.expr(f"cast(pmod({text}, {design.buckets}) as int) as _bucket")


def _counter(replicates: int, more: Sequence[str] = ()):
    """Counts of each PSU in replicates 1..R, for whole columns of PSUs at a time.

    The independent count is that of a Poisson variable whose distribution function comes with
    `steps`, at a 52-bit number hashed from seed, stratum, PSU and replicate. `more` names the inputs that follow
    the first four: it is kept in the replicates that `_keep` marks, all where there is none, and `_extra` draws, if
    any, come on top. A PSU alone in its stratum counts once. The first place stands for the full sample.
    """

    def stirred(x: np.ndarray) -> np.ndarray:
        """Scatters 32-bit numbers held in 64 bits: shift, multiply, twice over."""
        for _ in range(2):
            x = ((x ^ (x >> np.uint64(16))) * np.uint64(_MULTIPLIER)) & np.uint64(_WORD)
        return x ^ (x >> np.uint64(16))

    def grid(column: pa.Array, kind: str) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)

    def count(first: pa.Array, second: pa.Array, n_h: pa.Array, steps: pa.Array, *others: pa.Array) -> pa.Array:
        rows, given = len(first), dict(zip(more, others, strict=True))
        turns = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(_STRIDE)
        a = stirred((first.to_numpy().astype(np.uint64)[:, None] + turns) & np.uint64(_WORD))
        b = stirred(a ^ second.to_numpy().astype(np.uint64)[:, None])
        uniform = (a * np.uint64(1 << 20) + (b >> np.uint64(12))).astype(np.float64) / 2.0**52
        out = np.zeros((rows, replicates + 1), np.int16)
        for step in grid(steps, "f8").T if rows else ():
            passed = uniform >= step[:, None]
            if not passed.any():
                break
            out[:, 1:] += passed
        if "_keep" in given and rows:
            out[:, 1:] *= grid(given["_keep"], "i2")
        if "_extra" in given:
            extra = given["_extra"]
            with_extra = np.flatnonzero(extra.is_valid().to_numpy(zero_copy_only=False))
            if len(with_extra):
                out[with_extra, 1:] += grid(extra.drop_null(), "i2")
        out[n_h.to_numpy() == 1] = 1
        edges = pa.array(np.arange(rows + 1, dtype=np.int32) * (replicates + 1))
        return pa.ListArray.from_arrays(edges, pa.array(out.ravel()))

    return F.arrow_udf(count, "array<smallint>")


def _with_counts(frame: DataFrame, strata: Side, design: Design, extra: DataFrame | None = None) -> DataFrame:
    """The frame with n_h and `_counts`, made in one pass over its PSUs; a digest is taken once a row."""
    digested = frame.withColumn("_md5", F.expr(_digest(design, f"`{design.psu}`")))
    words = {"_first": F.expr(_hex("_md5", 1, 8)), "_second": F.expr(_hex("_md5", 9, 8))}
    sized = attach(digested.withColumns(words).drop("_md5"), strata, [design.stratum], [design.psu])
    if extra is not None:
        sized = sized.join(extra, [design.stratum, design.psu], "left")
    # Only inputs that there are: a NULL literal of an array type takes Spark longer a row than all counts.
    more = [c for c in ("_keep", "_extra") if c in sized.columns]
    inputs = ["_first", "_second", "n_h", "_steps", *more]
    return sized.withColumn("_counts", _counter(design.replicates, more)(*inputs)).drop(*inputs[:2], "_steps", *more)


def _poisson_steps(rate: str) -> Column:
    """Distribution function of a Poisson count at 0, 1, 2, ..."""
    terms = f"transform(sequence(0, {_POISSON_TERMS - 1}), k -> exp(-{rate}) * pow({rate}, k) / factorial(k))"
    upto = f"sequence(1, {_POISSON_TERMS})"
    return F.expr(f"transform({upto}, n -> aggregate(slice({terms}, 1, n), 0D, (total, term) -> total + term))")


def _strata(sizes: Side, design: Design) -> Side:
    """PSU count of each stratum and the rate of its independent counts."""
    rate = f"greatest(0D, n_h - 1 - {design.slack}D * sqrt(n_h - 1)) / n_h as _rate"
    return sizes.map(
        lambda s: s.groupBy(design.stratum)
        .agg(F.sum("_n").alias("n_h"))
        .select(design.stratum, "n_h", F.expr(rate))
        .select(design.stratum, "n_h", _poisson_steps("_rate").alias("_steps"))
    )


def _unfolded(counts: str, name: str) -> Column:
    """Numbers of draws by replicate, of which there are some. Without "outer" Spark tests first whether there are, by making them twice."""
    return F.posexplode_outer(counts).alias("rep", name)


def _fills(counts: DataFrame, design: Design) -> DataFrame:
    """Per stratum: which replicates keep their independent counts, and the draws left."""
    unfolded = counts.select(design.stratum, "n_h", _unfolded("_counts", "_k")).filter("rep > 0")
    sums = unfolded.groupBy(design.stratum, "n_h", "rep").agg(F.sum("_k").alias("_sum"))
    listed = sums.groupBy(design.stratum, "n_h").agg(F.expr("array_sort(collect_list(struct(rep, _sum))) as _sums"))
    left = "if(s._sum <= n_h - 1, n_h - 1 - s._sum, n_h - 1)"
    return listed.select(
        design.stratum,
        F.expr("transform(_sums, s -> s._sum <= n_h - 1) as _keep"),
        F.expr(f"transform(_sums, s -> {left}) as _fill"),
    )


def _targets(strata: Side, design: Design) -> DataFrame:
    """The remaining draws: (stratum, number of the PSU drawn, replicate).

    Listed in chunks that spread over the tasks. Nothing lets the planner know how
    many draws a stratum has, so the join they are for gets its hint here: broadcast
    when their number is known to be small, sort-merge otherwise.
    """
    cells = strata.frame.select(design.stratum, "n_h", F.posexplode("_fill").alias("_pos", "_m")).filter("_m > 0")
    chunks = cells.withColumn("_from", F.expr(f"explode(sequence(0L, _m - 1, {_DRAW_CHUNK}L))"))
    drawn = None if strata.rows is None else sum(sum(fill) for fill in strata.rows["_fill"].to_pylist())
    if drawn is None:
        chunks = chunks.repartition(design.stratum, "_pos", "_from")
    elif drawn > _DRAWS_PER_TASK:
        chunks = chunks.repartition(-(-drawn // _DRAWS_PER_TASK), design.stratum, "_pos", "_from")
    draws = chunks.withColumn("_j", F.expr(f"explode(sequence(_from, least(_m - 1, _from + {_DRAW_CHUNK - 1})))"))
    target = f"pmod({_hex(_digest(design, "'draw'", '_pos + 1', '_j'), 1, 15)}, n_h) + 1 as _idx"
    targets = draws.select(design.stratum, F.expr(target), "_pos")
    return F.broadcast(targets) if drawn is not None and drawn <= design.side_limit else targets.hint("merge")


def _numbered(psus: DataFrame, sizes: Side, design: Design) -> DataFrame:
    """Number the PSUs of each stratum from 1, bucket by bucket.

    A stratum can hold a large part of all PSUs, so no window spans one: rows are
    numbered inside a bucket and shifted by the size of the buckets before it.
    """
    keys = [design.stratum, "_bucket"]
    before = Window.partitionBy(design.stratum).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.map(lambda s: s.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(design.psu))
    local = psus.select(design.stratum, design.psu, _bucket(design)).withColumn("_row", inside)
    numbered = attach(local, offsets, keys, [design.psu])
    return numbered.select(design.stratum, design.psu, (F.col("_before") + F.col("_row")).alias("_idx"))


@dataclass(frozen=True)
class Replicates:
    """Bootstrap replicates of a sample, held in a column of its frames.

    `draws` is a PSU's number of draws in each replicate, the place of the full sample first, and
    the scale that makes factors of them. It is NULL without replicates.
    """

    design: Design

    def none(self) -> Replicates:
        """For estimates without errors."""
        return Replicates(replace(self.design, replicates=0))

    def unfold(self, frame: DataFrame) -> DataFrame:
        """One row per replicate, with the `factor` on the weight of its PSU.

        Replicate 0 is the full sample. `frame` may hold members of PSUs and any
        part of the sample.
        """
        kept = [c for c in frame.columns if c != "draws"]
        scaled = frame.select(*kept, F.col("draws.scale").alias("_scale"), F.col("draws.counts").alias("_counts"))
        unfolded = scaled.select(*kept, "_scale", _unfolded("_counts", "_k")).filter("rep IS NOT NULL")
        return unfolded.withColumn("factor", F.expr("if(rep = 0, 1D, _k * _scale)")).drop("_k", "_scale")


def replicate(psus: DataFrame, design: Design) -> tuple[DataFrame, Replicates]:
    """Bootstrap replicates for a frame that has one row per PSU.

    Each replicate draws n_h - 1 of the n_h PSUs of a stratum with replacement; the
    factor of a PSU is the number of times it was drawn times n_h / (n_h - 1). A PSU
    alone in its stratum keeps factor 1.

    Moving every draw to its PSU would shuffle PSUs x replicates rows. Instead every
    PSU takes an independent Poisson count from a hash of its own key, with a rate
    such that the counts of a stratum sum to a little less than n_h - 1, `slack`
    standard deviations on average. Only the remainder, of the order of the square
    root of n_h, is drawn PSU by PSU. Poisson counts given their sum are the counts
    of that many draws with replacement, so the result has exactly the distribution
    of n_h - 1 draws. Should the counts of a stratum exceed n_h - 1 in some
    replicate, they are dropped there and all of its draws are made one by one.
    """
    if not design.replicates:
        return psus.withColumn("draws", F.lit(None).cast(DRAWS)), Replicates(design)
    bucketed = psus.select(design.stratum, _placed(design, _bucket(design)).alias("_bucket"))
    sizes = bounded_side(bucketed.groupBy(design.stratum, "_bucket").agg(F.count("*").alias("_n")), design.side_limit)
    strata = _strata(sizes, design)
    fills = _fills(_with_counts(psus.select(design.stratum, design.psu), strata, design), design)
    strata = bounded_side(strata.frame.join(fills, design.stratum), design.side_limit // _STRATUM_ROW)
    if not strata.bounded:
        strata = Side(materialize(strata.frame), False)
    times = "cast(size(filter(_drawn, d -> d = r)) as smallint)"
    dense = f"transform(sequence(0, {design.replicates - 1}), r -> {times}) as _extra"
    extra = (
        _numbered(psus, sizes, design)
        .join(_targets(strata, design), [design.stratum, "_idx"])
        .groupBy(design.stratum, design.psu)
        .agg(F.collect_list("_pos").alias("_drawn"))
        .select(design.stratum, design.psu, F.expr(dense))
    )
    counted = _with_counts(psus, strata.map(lambda s: s.drop("_fill")), design, extra)
    scale = F.expr("if(n_h = 1, 1D, try_divide(n_h, n_h - 1))").alias("scale")
    return counted.withColumn("draws", F.struct(scale, F.col("_counts").alias("counts"))).drop("n_h", "_counts"), Replicates(design)


def factors(frame: DataFrame, replicates: Replicates) -> DataFrame:
    """Replicate factors in long form: one row per PSU and replicate."""
    keys = [replicates.design.stratum, replicates.design.psu]
    return replicates.unfold(frame.select(*keys, "draws")).filter("rep > 0").select(*keys, "rep", "factor")
