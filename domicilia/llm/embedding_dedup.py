"""Near-duplicate embeddings by cross-polytope hashing.

A hash is the nearest signed axis after a fast random rotation; `joined` of them make the
key of a table. A vector lives in the bucket of its own key and visits the buckets of the
likeliest neighbouring keys, where one axis is replaced by the second nearest. Two vectors
are candidates when one lives where the other lives or visits; the cosine of the original
vectors decides.

Equal vectors form a class first. Only keys are shuffled to find the buckets that hold
somebody to compare; vectors follow into those alone. Buckets of many classes are dealt out
in pairs of blocks. Pairs never leave a task: it passes on counts and a spanning forest. A
pair that meets in several buckets is counted in the first of them, which both vectors'
keys tell without asking other tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domicilia.llm.components import components
from domicilia.llm.tables import own, store
from domicilia.llm.vectors import padded, rotated, unit, usable
from domicilia.llm.words import mix

_SLOT_ROWS = 2048
_ROUNDING = 1e-9  # of cosines of scaled vectors


@dataclass(frozen=True)
class EmbeddingDedup:
    """`cosine`: least cosine of a link; `joined`: axes in a key (three tell two million buckets
    apart at 64 dimensions; take one more for each hundredfold of that many vectors);
    `tables`, `probes`: keys of a vector; `block`: classes that one task compares with as many.
    """

    cosine: float = 0.9
    joined: int = 3
    tables: int = 20
    probes: int = 4
    block: int = 512
    seed: int = 97

    def keys(self, matrix: np.ndarray) -> np.ndarray:
        """(rows, tables, probes) keys of vectors of one dimension; the first of a table is the vector's own."""
        wide = padded(unit(matrix))
        n, width = wide.shape
        out = np.empty((n, self.tables, self.probes), np.int64)
        every = np.arange(n)
        for table in range(self.tables):
            axes, seconds, gaps = [], [], []
            for k in range(self.joined):
                turned = rotated(wide, self.seed + table * self.joined + k)
                size = np.abs(turned)
                best = size.argmax(1)
                top = size[every, best].copy()
                size[every, best] = -1
                second = size.argmax(1)
                gaps.append(top - size[every, second])
                axes.append(2 * best + (turned[every, best] < 0))
                seconds.append(2 * second + (turned[every, second] < 0))
            base = np.stack(axes, 1)
            order = np.argsort(np.stack(gaps, 1), 1, kind="stable")
            for probe in range(self.probes):
                codes = base.copy()
                for k in range(self.joined):  # the bits of `probe` say which of the closest calls are reversed
                    if probe >> k & 1:
                        at = order[:, k]
                        codes[every, at] = np.stack(seconds, 1)[every, at]
                key = np.full(n, (matrix.shape[1] << 16) + table, np.uint64)
                for k in range(self.joined):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + codes[:, k].astype(np.uint64))
                out[:, table, probe] = key.view(np.int64)
        return out

    def run(self, rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
        """(vec_id, n_links, component_id, kept), one row for each row.

        NULL, empty and zero vectors and those with NULL or non-finite components link with nothing,
        and neither do vectors of different dimensions. A row without id is compared with nothing:
        no links, component NULL, kept. Rows of one id are each compared, also with one another,
        and are one node of the components. An empty table gives an empty result.
        """
        rows = own(rows, vec_id=vec_id, embedding=embedding)
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

        def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors: list = [None] * batch.num_rows
                for at, matrix in usable(batch.column("embedding")):
                    for row, vector in zip(at.tolist(), matrix + 0.0, strict=True):
                        vectors[row] = vector.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(vectors, pa.binary())], ["vec_id", "vec"])

        plain = store(rows.mapInArrow(prepare, "vec_id long, vec binary"))
        known = plain.filter("vec_id IS NOT NULL AND vec IS NOT NULL")
        classes = store(known.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
        met = store(self.compare(classes))
        counts = met.filter("other IS NULL").groupBy("vec").agg(F.sum("linked").alias("linked"))
        found = classes.join(counts, "vec", "left").select("vec", "id", "n", F.coalesce("linked", F.lit(0)).alias("linked"))
        several = known.groupBy("vec_id").agg(F.min("vec").alias("u"), F.max("vec").alias("v")).filter("u != v").select("vec_id")
        repeated = known.join(several, "vec_id", "left_semi").join(classes.select("vec", "id"), "vec")
        links = met.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
        nodes = store(components(links.union(repeated.select(F.col("vec_id").alias("a"), F.col("id").alias("b")))))
        found = found.join(nodes, found["id"] == nodes["node"], "left").select(
            "vec", (F.col("n") - 1 + F.col("linked")).alias("n_links"), F.coalesce("component", "id").alias("component_id")
        )
        linked = known.join(found, "vec").select("vec_id", "n_links", "component_id")
        alone = plain.filter("vec_id IS NULL OR vec IS NULL").select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
        )
        return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

    def compare(self, classes: DataFrame) -> DataFrame:
        """(vec, linked, id, other): rows of a class's number of linked rows, in parts, and links id - other."""
        tables, probes, least, block = self.tables, self.probes, self.cosine, self.block

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.zeros((batch.num_rows, tables * probes), np.int64)
                vectors = [np.frombuffer(v.as_py()) for v in batch.column("vec")]
                sizes = np.array([len(v) for v in vectors])
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    for part in np.array_split(at, len(at) // 2048 + 1):
                        if len(part):
                            out[part] = self.keys(np.stack([vectors[i] for i in part])).reshape(len(part), -1)
                yield pa.RecordBatch.from_arrays([batch.column("vec"), pa.array(list(out), pa.list_(pa.int64()))], ["vec", "keys"])

        hashed = store(
            classes.select("vec")
            .mapInArrow(keyed, "vec binary, keys array<long>")
            .join(classes, "vec")
            .select("id", F.xxhash64("vec").alias("mark"), "n", "vec", "keys")
        )
        spread = hashed.select("id", "mark", F.posexplode("keys").alias("at", "key"))
        spread = spread.select("id", "mark", "key", (F.col("at") % probes == 0).alias("home"))
        sizes = spread.groupBy("key").agg(F.count("*").alias("size"), F.max("home").alias("lived_in"))
        sizes = sizes.filter("size > 1 AND lived_in").select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
        members = store(spread.join(sizes, "key").select("id", "mark", "key", "home", "blocks"))
        slots = max(32, members.count() // _SLOT_ROWS)
        rows = members.join(hashed, ["id", "mark"])
        rows = rows.withColumn("own", F.pmod(F.xxhash64("id", "mark", "key"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("across", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select(
            F.least("own", "across").alias("i"), F.greatest("own", "across").alias("j"), "own", "key", "home", "id", "n", "vec", "keys"
        )
        # Small buckets share a task call; each pair of blocks of a large one is a call of its own.
        slot = F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod("key", F.lit(slots))).otherwise(F.col("key"))

        def judge(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            key = table.column("key").to_numpy()
            ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
            home = table.column("home").to_numpy(zero_copy_only=False)
            side, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
            vecs = table.column("vec").to_pylist()
            keys = np.array(table.column("keys").combine_chunks().flatten()).reshape(len(key), tables, probes)
            linked = np.zeros(len(key), np.int64)
            edges: list[tuple[int, int]] = []
            order = np.lexsort((ids, key))
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for at in np.split(order, cuts):
                if len(at) < 2:
                    continue
                matrix = unit(np.stack([np.frombuffer(vecs[x]) for x in at]))
                cosines = matrix @ matrix.T
                near = cosines >= least - _ROUNDING
                np.fill_diagonal(near, False)
                near &= home[at][:, None] | home[at][None, :]
                if i[at[0]] != j[at[0]]:
                    near &= side[at][:, None] != side[at][None, :]
                for x, y in zip(*np.nonzero(np.triu(near & (cosines <= least + _ROUNDING))), strict=True):
                    if not reaches(np.frombuffer(vecs[at[x]]), np.frombuffer(vecs[at[y]]), least):
                        near[x, y] = near[y, x] = False
                for x in range(len(at)):
                    ys = np.flatnonzero(near[x, x + 1 :]) + x + 1
                    if len(ys):
                        ys = ys[_first_meeting(keys[at[x]], keys[at[ys]], key[at[x]])]
                        linked[at[x]] += n[at[ys]].sum()
                        linked[at[ys]] += n[at[x]]
                edges += [(int(ids[at[a]]), int(ids[at[b]])) for a, b in _forest(near)]
            some = np.flatnonzero(linked)
            return pa.table(
                {
                    "vec": pa.array([vecs[x] for x in some] + [None] * len(edges), pa.binary()),
                    "linked": pa.array(linked[some].tolist() + [0] * len(edges), pa.int64()),
                    "id": pa.array([None] * len(some) + [a for a, _ in edges], pa.int64()),
                    "other": pa.array([None] * len(some) + [b for _, b in edges], pa.int64()),
                }
            )

        return rows.withColumn("slot", slot).groupBy("slot", "i", "j").applyInArrow(judge, "vec binary, linked long, id long, other long")


def reaches(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the cosine of the original components reaches `least`."""
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))) >= least


def _first_meeting(one: np.ndarray, others: np.ndarray, key: int) -> np.ndarray:
    """Which of the others meet this vector for the first time in the bucket `key`.

    Tables are gone through in order; within one, a bucket that both live in comes first,
    then the smaller key of those where one lives and the other visits.
    """
    mine, theirs = one[None, :, 0], others[:, :, 0]
    visited = (others == mine[:, :, None]).any(2)
    visiting = (one[None] == theirs[:, :, None]).any(2)
    most = np.iinfo(np.int64).max
    where = np.minimum(np.where(visited, np.broadcast_to(mine, theirs.shape), most), np.where(visiting, theirs, most))
    where = np.where(mine == theirs, theirs, where)
    first = (visited | visiting).argmax(1)
    return where[np.arange(len(others)), first] == key


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, member) of the components of an adjacency matrix."""
    left = near.any(1)
    edges = []
    while left.any():
        root = int(left.argmax())
        seen = np.zeros(len(near), bool)
        seen[root] = True
        frontier = np.array([root])
        while len(frontier):
            new = near[frontier].any(0) & ~seen
            seen |= new
            frontier = np.flatnonzero(new)
        edges += [(root, int(x)) for x in np.flatnonzero(seen) if x != root]
        left &= ~seen
    return edges
