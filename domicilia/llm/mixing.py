"""Mixing to target weights by iterative proportional fitting.

Every document belongs to one cell of the chosen columns. One aggregation gives the tokens
of each cell; raking multiplies the cells by one factor for each value of a column, column
after column, until all margins hold. Targets are given for named values or by a rule over the values that
the aggregation finds; all other values share one rest class, so the number of cells is bounded by the
targets and not by the data. Documents are then drawn by probabilities calibrated to the
factors, each by a hash of its own id, so that a repeated task draws the same ones, and
carry what is left of the factor as a weight.

Documents have no topic, so texts are clustered by their words: centres are fitted on all texts,
in rounds that each add up whole numbers by centre, and every text gets the nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from domicilia.llm.tables import own, store
from domicilia.llm.words import Words, chunks, mix

REST = "(rest)"
_FEW_GROUPS = 20_000


@dataclass(frozen=True)
class Topics:
    """Centres of unit length, and the weight of each hashed word (inverse share of texts that hold one)."""

    centres: np.ndarray
    weights: np.ndarray

    @property
    def names(self) -> list[str]:
        return [f"topic{k}" for k in range(len(self.centres))]

    def of(self, column: pa.Array | pa.ChunkedArray) -> tuple[list[str | None], np.ndarray]:
        """The nearest centre of each text, ties to the first, None without words; and its number of words."""
        words = Words.of(column)
        features = weighted_features(word_features(words, len(self.weights)), self.weights)
        nearest = (features @ self.centres.T).argmax(1).tolist()
        names = self.names
        return [names[k] if n else None for k, n in zip(nearest, words.counts.tolist(), strict=True)], words.counts


def word_features(words: Words, dims: int) -> np.ndarray:
    """How often words of each hash, case folded, stand in each text."""
    n = len(words.counts)
    if not len(words.starts):
        return np.zeros((n, dims), np.float32)
    slots = (words.hashes(fold=True) % np.uint64(dims)).astype(np.int64)
    doc = np.repeat(np.arange(n), words.counts)
    return np.bincount(doc * dims + slots, minlength=n * dims).reshape(n, dims).astype(np.float32)


def weighted_features(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logarithms of the counts by weight, at length one."""
    features = np.log1p(counts) * weights
    size = np.sqrt((features * features).sum(1, keepdims=True))
    return np.divide(features, size, out=features, where=size > 0)


# Features as whole numbers up to this, so that sums over all texts do not depend on their order.
_ONE = 65_535
# Texts as close as this to a centre are not far from it.
_SAME = 1e-4


def _whole(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.rint(weighted_features(counts, weights) * _ONE).astype(np.uint16)


def _closeness(features: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return features.astype(np.float32) @ centres.T / _ONE


def _racing(features: np.ndarray, keys: np.ndarray, centres: np.ndarray, turn: int) -> np.ndarray:
    """When each text arrives in a race that it wins with a chance by its distance from the centres."""
    far = 1 - _closeness(features, centres).max(1) if len(centres) else np.ones(len(features))
    uniform = ((mix(keys ^ mix(np.array([turn], np.uint64))) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    return np.where(far > _SAME, -np.log(uniform) / np.maximum(far, _SAME), np.inf)


def _sums(features: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sums of the texts nearest to each centre, exact."""
    nearest = _closeness(features, centres).argmax(1)
    return ((np.arange(len(centres))[:, None] == nearest).astype(float) @ features.astype(float)).astype(np.int64)


def _centres(
    first: Callable[[np.ndarray, int], np.ndarray | None], add: Callable[[np.ndarray], np.ndarray], dims: int, clusters: int, rounds: int
) -> np.ndarray:
    """Spherical k-means, started by k-means++. `first` gives the text that wins a race, `add` the sums by centre."""
    centres = np.zeros((0, dims), np.float32)
    while len(centres) < clusters and (found := first(centres, len(centres))) is not None:
        size = np.sqrt((found.astype(float) ** 2).sum())
        centres = np.vstack([centres, (found / max(size, 1)).astype(np.float32)])
    if not len(centres):
        return np.zeros((1, dims), np.float32)
    for _ in range(rounds):
        sums = add(centres).astype(float)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        moved = np.where(size > 0, sums / np.maximum(size, 1), centres).astype(np.float32)
        done, centres = np.abs(moved - centres).max() < 5e-4, moved
        if done:
            break
    return centres


def _weights(texts: int, held: np.ndarray) -> np.ndarray:
    return np.log((1 + texts) / (1 + held)).astype(np.float32)


def cluster(counts: np.ndarray, clusters: int, seed: int, rounds: int = 30) -> Topics:
    """Topics of the counts in one array. Fewer texts than clusters: one centre each."""
    counts = counts[counts.any(1)]
    weights = _weights(len(counts), (counts > 0).sum(0))
    features = _whole(counts, weights)
    keys = mix(np.arange(len(counts), dtype=np.uint64) + np.uint64(seed << 32))

    def first(centres: np.ndarray, turn: int) -> np.ndarray | None:
        arrival = _racing(features, keys, centres, turn)
        return features[arrival.argmin()] if np.isfinite(arrival).any() else None

    return Topics(_centres(first, lambda centres: _sums(features, centres), counts.shape[1], clusters, rounds), weights)


def _arrays(batch: pa.RecordBatch, column: str, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), kind).reshape(-1, dims)


def _added(rows: DataFrame, block: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of the `size` whole numbers that `block` gives for some of them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += block(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    sums = rows.mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # `size` rows
    out = np.zeros(size, np.int64)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out


@dataclass(frozen=True)
class TopicModel:
    """`clusters`, `dims`: topics and hashed words; `rounds`: of k-means at most. All texts fit the topics, or those of
    the smallest hashes if `sample` names a number of texts.
    """

    clusters: int = 8
    dims: int = 512
    sample: int | None = None
    seed: int = 23
    rounds: int = 20

    def fit(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Topics:
        """Texts are read once, to store their counts of hashed words; each round of k-means goes over features made of these."""
        rows = own(docs, doc_id=doc_id, text=text).filter("length(trim(text)) > 0")
        rows = rows.select("text", F.xxhash64("doc_id", "text").alias("key"))
        if self.sample is not None:
            rows = rows.orderBy("key", "text").limit(self.sample)
        dims, seed = self.dims, self.seed

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text"):
                    counts = word_features(Words.of(part.column("text")), dims)
                    some = counts.any(1)
                    cells = pa.array([c.tobytes() for c in counts[some]], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("key").filter(pa.array(some)), cells], ["key", "x"])

        counted = store(rows.mapInArrow(count, "key long, x binary"))
        held = lambda batch: np.append((_arrays(batch, "x", "f4", dims) > 0).sum(0), batch.num_rows)
        totals = _added(counted, held, dims + 1)
        weights = _weights(int(totals[-1]), totals[:-1])

        def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = [x.tobytes() for x in _whole(_arrays(batch, "x", "f4", dims), weights)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cells, pa.binary())], ["key", "x"])

        features = store(counted.mapInArrow(scale, "key long, x binary"))

        def first(centres: np.ndarray, turn: int) -> np.ndarray | None:
            def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    keys = mix(batch.column("key").to_numpy().view(np.uint64) + np.uint64(seed))
                    arrival = _racing(_arrays(batch, "x", "u2", dims), keys, centres, turn)
                    at = np.flatnonzero(np.isfinite(arrival) & (arrival == arrival.min(initial=np.inf)))
                    yield pa.RecordBatch.from_arrays([pa.array(arrival[at]), batch.column("x").take(pa.array(at))], ["at", "x"])

            winner = features.mapInArrow(race, "at double, x binary").orderBy("at", "x").limit(1).toArrow()  # one text
            return np.frombuffer(winner["x"][0].as_py(), "u2") if winner.num_rows else None

        def add(centres: np.ndarray) -> np.ndarray:
            block = lambda batch: _sums(_arrays(batch, "x", "u2", dims), centres).ravel()
            return _added(features, block, centres.size).reshape(centres.shape)

        return Topics(_centres(first, add, dims, self.clusters, self.rounds), weights)


def described(docs: DataFrame, topics: Topics, text: str = "text", topic: str = "topic", tokens: str = "n_tokens") -> DataFrame:
    """All columns of `docs` with topic and number of words of the text."""
    names = [*docs.columns, topic, tokens]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                values, counts = topics.of(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.string()), pa.array(counts, pa.int64())], names)

    added = [StructField(topic, StringType()), StructField(tokens, LongType())]
    return docs.mapInArrow(convert, StructType([*docs.schema.fields, *added]))


@dataclass(frozen=True)
class Tempered:
    """Targets by rule: values with at least `least` of all tokens, at most the `most` largest of them, weigh
    their tokens to the `power`; so does the rest class, with the tokens of all other values and NULL.
    """

    power: float = 0.5
    least: float = 0.001
    most: int = 64


def rake(tokens: np.ndarray, targets: list[np.ndarray], tolerance: float = 1e-10, rounds: int = 1000) -> np.ndarray:
    """Factors for each cell after which every margin of `tokens` has the target shares.

    The last value of a column is the rest class. Where a target names it, the shares are as stated; where
    it does not, it keeps its present share, and the targets divide the others. Targets of empty
    values are spread over those of their column. Where margins contradict each other, as empty cells
    may cause, the last round's factors are returned.
    """
    fitted = tokens / max(tokens.sum(), 1)
    axes = range(tokens.ndim)
    goals = []
    for axis in axes:
        margin = fitted.sum(tuple(a for a in axes if a != axis))
        stated = len(targets[axis]) == len(margin)
        goal = np.where(margin > 0, targets[axis] if stated else np.append(targets[axis], 0.0), 0.0)
        kept = 0.0 if stated else margin[-1]
        goal = goal * ((1 - kept) / goal.sum()) if goal.sum() else goal
        if not stated:
            goal[-1] = kept
        goals.append(goal)
    for _ in range(rounds):
        off = 0.0
        for axis in axes:
            margin = fitted.sum(tuple(a for a in axes if a != axis))
            factor = np.divide(goals[axis], margin, out=np.zeros_like(margin), where=margin > 0)
            off = max(off, float(np.abs(margin - goals[axis]).max(initial=0)))
            fitted = fitted * factor.reshape([-1 if a == axis else 1 for a in axes])
        if off < tolerance:
            break
    share = tokens / max(tokens.sum(), 1)
    return np.divide(fitted, share, out=np.zeros_like(fitted), where=share > 0)


def probabilities(factors: np.ndarray, tokens: np.ndarray, keep: float) -> np.ndarray:
    """min(1, c * factor), with c such that `keep` of all tokens is expected."""
    want = keep * tokens.sum()
    low, high = 0.0, 1.0
    while (np.minimum(1, high * factors) * tokens).sum() < want and high < 1e12:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * factors) * tokens).sum() < want else (low, mid)
    return np.minimum(1, high * factors)


@dataclass(frozen=True)
class Mixing:
    """`targets`: for each column the wanted weights of its values, positive and of any sum, or a rule.
    Without a rule all other values and NULL are the rest class, which keeps its present share; `keep`:
    expected share of tokens kept.
    """

    targets: Mapping[str, Mapping[str, float] | Tempered]
    keep: float = 0.9
    seed: str = "mix"

    def _goals(self, groups: DataFrame | list, k: int, name: str) -> tuple[list[str], np.ndarray]:
        """Values of a column that have targets, and these; the last is that of the rest class if it has one."""
        rule = self.targets[name]
        if not isinstance(rule, Tempered):
            return list(rule), np.array([*rule.values()], float)
        if isinstance(groups, list):
            totals: dict[str, float] = {}
            for row in groups:
                totals[row[k]] = totals.get(row[k], 0.0) + row[-1]
            total = float(sum(totals.values()))
            large = [(v, n) for v, n in totals.items() if v is not None and n > 0 and n >= rule.least * total]
            rows = sorted(large, key=lambda r: (-r[1], r[0].encode()))[: rule.most]
        else:
            total = float(groups.agg(F.sum("__n")).first()[0] or 0)
            sums = groups.groupBy(name).agg(F.sum("__n").alias("n")).filter(F.col(name).isNotNull() & (F.col("n") > 0))
            rows = sums.filter(F.col("n") >= rule.least * total).orderBy(F.desc("n"), name).limit(rule.most).collect()  # `most` rows
        values = [float(n) for _, n in rows]
        return [v for v, _ in rows], np.array([*values, max(total - sum(values), 0.0)]) ** rule.power

    def weighted(
        self,
        rows: DataFrame,
        doc_id: str = "doc_id",
        tokens: str = "n_tokens",
        columns: Mapping[str, str] | None = None,
        prefix: str = "",
    ) -> DataFrame:
        """`rows` with factor, probability, u, sampled and weight added, their names after `prefix`.

        `columns` names the column of a target where it is another than the target's own name. A column of
        `rows` that has the name of an added one is an error; choose a prefix then.
        Rows without tokens do not move any margin; they are drawn like the others of their
        cell, or always if it has no tokens. NULL ids draw by the hash of an empty id; equal ids
        draw alike. An empty table gives an empty result.
        """
        names, columns = list(self.targets), columns or {}
        added = [prefix + c for c in ("factor", "probability", "u", "sampled", "weight")]
        if clash := sorted(set(added) & set(rows.columns)):
            raise ValueError(f"columns would be replaced: {clash}")
        factor, probability, u, sampled, weight = added
        own_columns = [F.col(f"`{columns.get(n, n)}`").cast("string").alias(n) for n in names]
        groups = rows.select(*own_columns, F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).alias("__n"))
        groups = store(groups.groupBy(*names).agg(F.sum("__n").alias("__n")))
        few = groups.limit(_FEW_GROUPS + 1).collect()  # a checked number of rows; beyond it Spark goes on with them
        known = few if len(few) <= _FEW_GROUPS else groups
        found = [self._goals(known, k, n) for k, n in enumerate(names)]
        values, goals = [[*v, REST] for v, _ in found], [g for _, g in found]
        keys = [f"__cell_{k}" for k in range(len(names))]

        def cell(k: int, column: Column) -> Column:
            return F.when(column.isin(values[k][:-1]), column).otherwise(F.lit(REST))

        table = np.zeros([len(v) for v in values])
        places = [{v: i for i, v in enumerate(vs[:-1])} | {REST: len(vs) - 1} for vs in values]
        if known is not few:
            celled = groups.select(*[cell(k, F.col(n)).alias(keys[k]) for k, n in enumerate(names)], "__n")
            known = celled.groupBy(*keys).agg(F.sum("__n")).collect()  # no more rows than cells
        for row in known:
            table[tuple(p.get(row[k], len(p) - 1) for k, p in enumerate(places))] += row[-1]
        factors = rake(table, goals)
        drawn = probabilities(factors, table, self.keep)
        cells = [
            (*[v[i] for v, i in zip(values, at, strict=True)], float(factors[at]), float(drawn[at]) if table[at] else 1.0)
            for at in np.ndindex(*table.shape)
        ]
        schema = ", ".join(f"{k} string" for k in keys) + ", __f double, __p double"
        plan = F.broadcast(rows.sparkSession.createDataFrame(cells, schema))  # the cells of the targets
        ids = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
        digits = F.substring(F.md5(F.concat(F.lit(self.seed + ":"), ids)), 1, 12)
        rows = rows.withColumns({keys[k]: cell(k, F.col(f"`{columns.get(n, n)}`").cast("string")) for k, n in enumerate(names)})
        out = rows.join(plan, keys).withColumnsRenamed({"__f": factor, "__p": probability}).drop(*keys)
        out = out.withColumn(u, F.conv(digits, 16, 10).cast("double") / float(1 << 48))
        out = out.withColumn(sampled, F.col(u) < F.col(probability))
        return out.withColumn(weight, F.coalesce(F.when(F.col(sampled), F.col(factor) / F.col(probability)), F.lit(0.0)))

    def run(
        self,
        docs: DataFrame,
        doc_id: str = "doc_id",
        text: str = "text",
        source: str = "source",
        lang: str = "lang",
        topic: str | None = None,
        model: TopicModel | None = None,
    ) -> DataFrame:
        """(doc_id, source, lang, topic, n_tokens, factor, probability, u, sampled, weight), a row for each row.

        Tokens are words between white space; the targets' columns are source, lang and topic, which is
        a column of `docs` or else found by `model`. A NULL text has no tokens. NULL values belong to the rest class.
        """
        columns = {"doc_id": doc_id, "source": source, "lang": lang, "text": text} | ({"topic": topic} if topic else {})
        rows = own(docs, **columns)
        topics = Topics(np.zeros((1, 1), np.float32), np.ones(1, np.float32)) if topic else (model or TopicModel()).fit(rows)
        # Stored, without the texts, which are read once for this.
        rows = store(described(rows, topics, topic="__topic" if topic else "topic").drop("text", "__topic"))
        return self.weighted(rows.withColumn("doc_id", F.col("doc_id").cast("long")))


# Production weights of the queries: languages as stated, sources by rule, topics alike.
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
TARGETS = {"source": Tempered(), "lang": LANGUAGES, "topic": dict.fromkeys((f"topic{k}" for k in range(TopicModel.clusters)), 1.0)}
