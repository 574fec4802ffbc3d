"""Nearest neighbours by cosine: probed lists scanned with adaptively many dimensions.

Vectors are dealt to the lists of centroids fitted on a bounded sample; every row is
indexed. A query visits the nearest share of the lists. Within a list, rotated unit vectors
are compared in column blocks: after each block a hypothesis test on the partial distance
abandons candidates that will hardly come below the query's current k-th distance. What
survives all blocks is scored exactly on the original vectors. Lists are cut into blocks
of candidates and of queries, so no list meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domicilia.llm.tables import own, store
from domicilia.llm.vectors import padded, rotated, unit, usable


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors; starts from evenly spaced rows."""
    found = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        owner = (sample @ found.T).argmax(1)
        total = np.zeros_like(found)
        np.add.at(total, owner, sample)
        size = np.sqrt((total * total).sum(1))
        found[size > 0] = total[size > 0] / size[size > 0, None]
    return found


def scan(query: np.ndarray, rows: np.ndarray, k: int, columns: int, confidence: float, chunk: int) -> np.ndarray:
    """Rows whose squared distance may be among the k least, by partial distances with tests."""
    width = rows.shape[1]
    best = np.full(k, np.inf)
    kept = []
    for low in range(0, len(rows), chunk):
        alive = np.arange(low, min(low + chunk, len(rows)))
        partial = np.zeros(len(alive))
        radius = best[-1]
        for first in range(0, width, columns):
            part = rows[alive, first : first + columns] - query[first : first + columns]
            partial = partial + (part * part).sum(1)
            seen = min(first + columns, width)
            if np.isfinite(radius):
                slack = (1 + confidence / np.sqrt(seen)) ** 2 if seen < width else 1.0
                stay = partial * (width / seen) <= radius * slack + 1e-9
                alive, partial = alive[stay], partial[stay]
        kept.append((alive, partial))
        best = np.sort(np.concatenate([best, partial]))[:k]
    at, distance = (np.concatenate(x) for x in zip(*kept, strict=True))
    return at[distance <= best[-1] + 1e-9]


@dataclass(frozen=True)
class NearestNeighbours:
    """`k`: neighbours; `every`: rows whose id this divides are queries; `sample`: rows, those of
    smallest hashes, that centroids are fitted on; `share`: part of the lists that a query
    visits; `confidence`: of the tests, larger abandons less; `columns`: of one block;
    `block`: candidates, and `queries`: queries, of one task.
    """

    k: int = 5
    every: int = 50
    sample: int = 20_000
    share: float = 0.85
    confidence: float = 2.1
    columns: int = 16
    block: int = 4096
    queries: int = 1024
    chunk: int = 512
    seed: int = 41

    def run(self, rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score), a query's nearest rows, nearest first, ties to smaller ids.

        NULL, empty and zero vectors, those with NULL or non-finite components and rows without
        id take no part. Only vectors of one dimension are compared. Rows with a query's own id
        are no candidates of it. Rows of one id are each found; queries of one id share their
        ranks. An empty table gives an empty result.
        """
        rows = own(rows, vec_id=vec_id, embedding=embedding).filter("vec_id IS NOT NULL")
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

        def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, matrix in usable(batch.column("embedding")):
                    ids = batch.column("vec_id").take(pa.array(at))
                    dims = pa.array([matrix.shape[1]] * len(at), pa.int32())
                    yield pa.RecordBatch.from_arrays([ids, dims, pa.array([v.tobytes() for v in matrix], pa.binary())], ["vec_id", "dim", "vec"])

        plain = store(rows.mapInArrow(prepare, "vec_id long, dim int, vec binary"))
        n = plain.count()
        picked = plain.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(self.sample).select("vec").collect()  # bounded
        lists = int(np.clip(np.sqrt(n) / 4, 8, 1024))
        known: dict[int, list[np.ndarray]] = {}
        for row in picked:
            vector = np.frombuffer(row["vec"])
            known.setdefault(len(vector), []).append(vector)
        index = {dim: centroids(unit(np.stack(v)), lists) for dim, v in sorted(known.items())}
        shared = rows.sparkSession.sparkContext.broadcast(index)
        share = self.share

        def deal(visits: bool):
            def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    sizes = batch.column("dim").to_numpy()
                    for dim in np.unique(sizes).tolist():
                        part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                        # A dimension that the sample does not hold has one list.
                        middle = shared.value.get(dim, np.zeros((1, dim)))
                        near = unit(np.stack([np.frombuffer(v.as_py()) for v in part.column("vec")])) @ middle.T
                        count = int(np.ceil(len(middle) * share)) if visits else 1
                        order = np.argsort(-near, 1, kind="stable")[:, :count]
                        yield part.append_column("lists", pa.array(list(order.astype(np.int32)), pa.list_(pa.int32())))

            return convert

        schema = "vec_id long, dim int, vec binary, lists array<int>"
        dealt = plain.mapInArrow(deal(False), schema).select("vec_id", "dim", "vec", F.col("lists")[0].alias("list"))
        asked = plain.filter(F.col("vec_id") % self.every == 0).mapInArrow(deal(True), schema)
        asked = asked.select("vec_id", "dim", "vec", F.explode("lists").alias("list"))
        dealt, asked = store(dealt), store(asked)
        at = ["dim", "list"]
        blocks = dealt.groupBy(*at).agg(F.ceil(F.count("*") / self.block).cast("int").alias("blocks"))
        strips = asked.groupBy(*at).agg(F.ceil(F.count("*") / self.queries).cast("int").alias("strips"))
        cut = store(blocks.join(strips, at))
        one = lambda name: F.pmod(F.xxhash64("vec_id", "vec"), F.col(name)).cast("int")
        each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        key = ["dim", "list", "b", "s"]
        left = asked.join(cut, at).withColumn("s", one("strips")).withColumn("b", each("blocks")).select(*key, "vec_id", "vec")
        right = dealt.join(cut, at).withColumn("b", one("blocks")).withColumn("s", each("strips")).select(*key, "vec_id", "vec")
        k, columns, confidence, chunk, seed = self.k, self.columns, self.confidence, self.chunk, self.seed

        def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
            found: list[tuple[int, int, float]] = []
            if queries.num_rows and candidates.num_rows:
                ids = candidates.column("vec_id").to_numpy()
                rows = np.stack([np.frombuffer(v.as_py()) for v in candidates.column("vec")])
                asks = np.stack([np.frombuffer(v.as_py()) for v in queries.column("vec")])
                lengths = norms(rows)
                turned, ask_turned = rotated(padded(unit(rows)), seed), rotated(padded(unit(asks)), seed)
                for q, (query, size) in enumerate(zip(asks, norms(asks), strict=True)):
                    own_id = queries.column("vec_id")[q].as_py()
                    others = np.flatnonzero(ids != own_id)
                    if not len(others):
                        continue
                    at = others[scan(ask_turned[q], turned if len(others) == len(ids) else turned[others], k, columns, confidence, chunk)]
                    scores = ((rows[at] / scale(rows[at])) * (query / np.abs(query).max())).sum(1) / lengths[at] / size
                    order = np.lexsort((ids[at], -scores))[:k]
                    found += [(own_id, int(ids[at[o]]), float(scores[o])) for o in order]
            query_ids, vec_ids, scores = zip(*found, strict=True) if found else ((), (), ())
            return pa.table({"query_id": pa.array(query_ids, pa.int64()), "vec_id": pa.array(vec_ids, pa.int64()), "score": pa.array(scores, pa.float64())})

        parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return parts.withColumn("rank", rank).filter(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")


def scale(rows: np.ndarray) -> np.ndarray:
    return np.abs(rows).max(1, keepdims=True)


def norms(rows: np.ndarray) -> np.ndarray:
    """Lengths of rows divided by their largest component; each row for itself, so that equal rows have equal ones."""
    rows = rows / scale(rows)
    return np.sqrt((rows * rows).sum(1))
