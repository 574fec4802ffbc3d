"""Quality scores by learning from trusted positives and unlabelled web text.

No text is ever shown to the model as a negative. Logistic regression on shape features
minimises the non-negative unbiased risk: the loss of positives as positives, weighted by
the class prior, and the loss of unlabelled texts as negatives less the positives' share of
it, which is kept from falling below zero. The prior is estimated from the same two
samples: a first model ranks both, and the prior is the least ratio, over all thresholds,
of the unlabelled share above it to the positive share above it.

Fitting takes all ids and of each the text with the least hash. Means and the prior come from all of them; weights
are fitted in shards, dealt by hash, and averaged. Scoring covers all rows in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from domicilia.llm.tables import own, store
from domicilia.llm.words import Words, chunks, texts_of

_KIND = np.zeros(256, np.int64)  # 0: other signs; the rest by character class
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[32, 9, 11, 12, 13]] = 4
_KIND[10] = 5
_KIND[[44, 46, 59, 58, 39, 34, 45]] = 6
_KIND[128:] = 7
_SIGNS = b"!?|#$%&*<>{}[]()=+/\\_~^@`"
_SIGN = np.full(256, -1)
_SIGN[list(_SIGNS)] = np.arange(len(_SIGNS))
_EDGES = np.array([1, 2, 3, 5, 8, 12, 20])
# Scores are counted in so many bins up to this distance from zero.
_BINS, _REACH = 4096, 40.0
N_FEATURES = 8 + len(_SIGNS) + len(_EDGES) + 1 + 5


def features(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Shares of character classes, signs and word lengths, repetition and length of each text."""
    data, offsets = texts_of(column)
    words = Words.cut(data, offsets)
    hashes = words.hashes() if len(words.starts) else np.zeros(0, np.uint64)
    lengths = words.ends - words.starts
    signs = len(_SIGNS)
    out = np.zeros((len(offsets) - 1, N_FEATURES))
    for row in range(len(out)):
        text = data[offsets[row] : offsets[row + 1]]
        low, high = words.first[row], words.first[row + 1]
        size, count = max(len(text), 1), max(high - low, 1)
        here = _SIGN[text]
        own_words = hashes[low:high]
        where = np.searchsorted(_EDGES, lengths[low:high], "right")
        upper = np.count_nonzero(_KIND[data[words.starts[low:high]]] == 2)
        out[row, :8] = np.sqrt(np.bincount(_KIND[text], minlength=8) / size)
        out[row, 8 : 8 + signs] = np.sqrt(np.bincount(here[here >= 0], minlength=signs) / count)
        out[row, 8 + signs : 9 + signs + len(_EDGES)] = np.bincount(where, minlength=len(_EDGES) + 1) / count
        out[row, -5:] = (
            np.log1p(high - low) / 10,
            len(np.unique(own_words)) / count,
            np.count_nonzero(own_words[1:] == own_words[:-1]) / count,
            upper / count,
            min(lengths[low:high].sum() / count, 40) / 10,
        )
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float
    fitted: bool = True

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return _sigmoid(z @ self.weights[:-1] + self.weights[-1])


def nn_risk_fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Weights (bias last) that minimise the non-negative risk of logistic losses, by Adam."""
    pos, unl = (np.hstack([x, np.ones((len(x), 1))]) for x in (pos, unl))
    w = np.zeros(pos.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        s_pos, s_unl = _sigmoid(pos @ w), _sigmoid(unl @ w)
        # Losses of a text as a negative: -log(1 - s); their gradient is s x.
        negative = -np.log1p(-np.minimum(s_unl, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(s_pos, 1 - 1e-12)).mean()
        as_negative = unl.T @ s_unl / len(unl) - prior * (pos.T @ s_pos) / len(pos)
        if negative < 0:
            grad = -as_negative
        else:
            grad = prior * (pos.T @ (s_pos - 1)) / len(pos) + as_negative
        grad[:-1] += ridge * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def _least_ratio(above_pos: np.ndarray, above_unl: np.ndarray, n_pos: float, n_unl: float, confidence: float) -> float:
    bound = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(n_pos) + 1 / np.sqrt(n_unl))
    best = int(np.argmin((above_unl + bound) / np.maximum(above_pos, 1e-9)))
    return float(np.clip(above_unl[best] / max(above_pos[best], 1e-9), 0.02, 0.98))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, confidence: float = 0.05) -> float:
    """Share of positives among the unlabelled, from scores of texts that the ranking model has not seen.

    Above any threshold the unlabelled hold at least prior times the positives' share; the
    least ratio, each with its deviation bound, estimates the prior.
    """
    if not len(pos) or not len(unl):
        return 0.5
    cuts = np.unique(np.quantile(pos, np.linspace(0, 0.9, 91)))
    above_pos = 1 - np.searchsorted(np.sort(pos), cuts, "left") / len(pos)
    above_unl = 1 - np.searchsorted(np.sort(unl), cuts, "left") / len(unl)
    return _least_ratio(above_pos, above_unl, len(pos), len(unl), confidence)


def _binned_prior(pos: np.ndarray, unl: np.ndarray, confidence: float = 0.05) -> float:
    """As `estimate_prior`, from numbers of scores by narrow bins of all rows."""
    above_pos, above_unl = (np.cumsum(n[::-1])[::-1] / n.sum() for n in (pos, unl))
    kept = above_pos >= 0.1
    return _least_ratio(above_pos[kept], above_unl[kept], pos.sum(), unl.sum(), confidence)


def fit(pos: np.ndarray, unl: np.ndarray) -> Model:
    """The model of two feature matrices. Without positives or unlabelled texts it is not fitted and every score is 0.5."""
    both = np.vstack([pos, unl])
    if not len(pos) or not len(unl):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.5, fitted=False)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    pos, unl = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    halves = [(pos[::2], unl[::2], pos[1::2], unl[1::2]), (pos[1::2], unl[1::2], pos[::2], unl[::2])]
    seen = []
    for p, u, p_new, u_new in halves:
        if len(p) and len(u):
            w = nn_risk_fit(p, u, 0.5, steps=300)
            seen.append(estimate_prior(p_new @ w[:-1], u_new @ w[:-1]))
    prior = float(np.mean(seen)) if seen else 0.5
    return Model(mean, scale, nn_risk_fit(pos, unl, prior), prior)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, N_FEATURES)


def _added(rows: DataFrame, block: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of the `size` numbers that `block` gives for features, marks and halves of some of them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            is_good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            total += block(_matrix(batch.column("x")), is_good, batch.column("half").to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    sums = rows.mapInArrow(add, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # `size` rows
    out = np.zeros(size)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out


@dataclass(frozen=True)
class QualityClassifier:
    """`sample`: most texts of each of both kinds that the model is fitted on, None for all; `shard`: about so many
    unlabelled texts, with their positives, are fitted together, and no fewer positives than `least` if copies of
    others make up for that; the shards' weights are averaged; `threshold`: the
    score from which a text is predicted good; `folds`, `held`: documents whose crc32 of the id
    has this remainder are held out from learning.
    """

    sample: int | None = None
    shard: int = 16_000
    least: int = 1000
    threshold: float = 0.7
    folds: int = 4
    held: int = 2

    def _held_out(self) -> F.Column:
        return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % self.folds == self.held, F.lit(False))

    def model(self, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
        """Fits on texts not held out; `labels` serve to find the trusted positives alone."""
        docs = own(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        known = own(labels, doc_id=doc_id, label=label).filter("doc_id IS NOT NULL AND label IS NOT NULL")
        known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "label").filter(~self._held_out())
        good = known.groupBy("doc_id").agg(F.min("label").alias("label")).filter("label = 1").select("doc_id")
        learn = docs.filter("doc_id IS NOT NULL").filter(~self._held_out())
        if self.sample is None:
            return self._of_all(learn, good)
        order = F.xxhash64("doc_id", F.lit(7))
        pick = lambda ids: ids.select("doc_id", order.alias("o")).orderBy("o", "doc_id").limit(self.sample)
        pos = pick(good.join(learn.select("doc_id").distinct(), "doc_id", "left_semi"))
        unl = pick(learn.select("doc_id").distinct())
        picked = pos.select("doc_id", F.lit(True).alias("good")).union(unl.select("doc_id", F.lit(False)))

        def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text"):
                    rows = pa.array(list(features(part.column("text"))), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*part.drop_columns("text").columns, rows], ["doc_id", "good", "h", "x"])

        hashed = F.xxhash64("text").alias("h")
        texts = learn.join(F.broadcast(picked), "doc_id").select("doc_id", "good", hashed, "text")  # at most 2 * sample ids
        rows = texts.mapInArrow(convert, "doc_id long, good boolean, h long, x array<double>")
        rows = rows.groupBy("doc_id", "good").agg(F.min(F.struct("h", "x")).alias("least"))
        rows = rows.select("doc_id", "good", "least.x").orderBy("doc_id", "good").toPandas()  # at most 2 * sample rows
        x = np.array(rows["x"].tolist(), float).reshape(-1, N_FEATURES)
        is_good = rows["good"].to_numpy(bool)
        return fit(x[is_good], x[~is_good])

    def _of_all(self, learn: DataFrame, good: DataFrame) -> Model:
        """The model of all ids of `learn`, unlabelled, and those of them in `good`, positive."""

        def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text"):
                    cells = pa.array([x.tobytes() for x in features(part.column("text"))], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), cells], ["doc_id", "h", "x"])

        texts = learn.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(convert, "doc_id long, h long, x binary")
        ids = texts.groupBy("doc_id").agg(F.min(F.struct("h", "x")).alias("least"))
        marked = ids.join(good.withColumn("good", F.lit(True)), "doc_id", "left")
        half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).alias("half")
        rows = store(marked.select("doc_id", F.coalesce("good", F.lit(False)).alias("good"), half, F.col("least.x").alias("x")))

        def moments(x: np.ndarray, is_good: np.ndarray, half: np.ndarray) -> np.ndarray:
            times = 1.0 + is_good  # a positive is unlabelled as well
            return np.concatenate([[is_good.sum(), len(x)], times @ x, times @ (x * x)])

        found = _added(rows, moments, 2 + 2 * N_FEATURES)
        n_pos, n_unl = int(found[0]), int(found[1])
        if not n_pos:
            return fit(np.zeros((0, N_FEATURES)), np.zeros((0, N_FEATURES)))
        mean = found[2 : 2 + N_FEATURES] / (n_pos + n_unl)
        scale = np.sqrt(np.maximum(found[2 + N_FEATURES :] / (n_pos + n_unl) - mean * mean, 0)) + 1e-3
        shards = -(-n_unl // self.shard)
        # Each positive is a positive of its own shard and, where these would have too few, of those after it.
        copies = min(shards, -(-self.least * shards // n_pos))
        shard = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards))
        unlabelled = rows.select(shard.alias("shard"), "doc_id", F.lit(False).alias("good"), "half", "x")
        positive = rows.filter("good").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        positive = positive.select(F.pmod(shard + F.col("_k"), F.lit(shards)).alias("shard"), "doc_id", "good", "half", "x")
        dealt = unlabelled.unionByName(positive)

        def averaged(parts: list[int], prior: float, steps: int) -> dict[int, np.ndarray]:
            """Weights fitted on each part, a half or all (2), that has rows of both kinds."""

            def learn_shard(group: pa.Table) -> pa.Table:
                group = group.sort_by([("doc_id", "ascending")])
                x = np.clip((_matrix(group["x"]) - mean) / scale, -8, 8)
                is_good, half = group["good"].to_numpy().astype(bool), group["half"].to_numpy()
                out = []
                for part in parts:
                    mine = (half == part) | (part == 2)
                    pos, unl = x[mine & is_good], x[mine & ~is_good]
                    if len(pos) and len(unl):
                        out.append((group["shard"][0].as_py(), part, len(unl), nn_risk_fit(pos, unl, prior, steps).tolist()))
                columns = zip(*out, strict=True) if out else ([], [], [], [])
                return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "part", "n", "w"])

            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
            fitted = dealt.groupBy("shard").applyInArrow(learn_shard, "shard long, part long, n long, w array<double>")
            weights: dict[int, list] = {}
            for row in sorted(fitted.collect()):  # a short row a shard
                weights.setdefault(row["part"], []).append((row["n"], row["w"]))
            return {k: np.average([w for _, w in v], 0, [n for n, _ in v]) for k, v in weights.items()}

        ranking = averaged([0, 1], 0.5, 300)

        def scores(x: np.ndarray, is_good: np.ndarray, half: np.ndarray) -> np.ndarray:
            x = np.clip((x - mean) / scale, -8, 8)
            out = np.zeros((2, 2, _BINS))
            for k, w in ranking.items():  # rows that the model has not seen
                z = np.clip(x @ w[:-1], -_REACH, _REACH)
                bins = ((z + _REACH) * ((_BINS - 1) / (2 * _REACH))).astype(np.int64)
                for role, mine in enumerate((is_good, np.ones(len(x), bool))):
                    out[k, role] = np.bincount(bins[mine & (half != k)], minlength=_BINS)
            return out.ravel()

        counts = _added(rows, scores, 4 * _BINS).reshape(2, 2, _BINS)
        seen = [_binned_prior(*counts[k]) for k in sorted(ranking) if counts[k].sum(1).all()]
        prior = float(np.mean(seen)) if seen else 0.5
        return Model(mean, scale, averaged([2], prior, 600)[2], prior)

    def scored(self, docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
        """All columns of `docs` and the score of the text; a NULL text counts as empty."""
        shared = docs.sparkSession.sparkContext.broadcast(model)
        names = [*docs.columns, score]

        def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.names.index(text)
                values = [shared.value.scores(features(part.column(0))) for part in chunks(batch.select([at]), text)]
                scores = pa.array(np.concatenate([*values, np.zeros(0)]), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], names)

        return docs.mapInArrow(convert, StructType([*docs.schema.fields, StructField(score, DoubleType())]))

    def run(self, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
        """(doc_id, held_out, score, predicted), one row for each row of `docs`.

        NULL and empty texts get the score of an empty text. NULL ids are scored and never learnt
        from; equal ids are scored each for itself. Ids with labels 0 and 1 are no trusted
        positives. Without any positive all scores are 0.5. An empty table gives an empty result.
        """
        model = self.model(docs, labels, doc_id, text, label)
        rows = own(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        scored = self.scored(rows, model)
        return scored.select(
            "doc_id",
            self._held_out().alias("held_out"),
            "score",
            F.when(F.col("score") >= self.threshold, 1).otherwise(0).alias("predicted"),
        )
