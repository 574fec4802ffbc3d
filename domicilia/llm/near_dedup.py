"""Near-duplicate texts by SetSketch registers in bands.

1. Each text becomes its set of shingles and one sketch. Texts of equal sets form a class
   at once, so that exact copies never meet again.
2. Two classes are candidates when a band of their registers agrees and the joint
   likelihood of both sketches does not rule the threshold out. First each class is only
   held against the smallest and the largest id of its bands (the two likeliest for
   each class), which joins most of a large group with few comparisons. Then candidates
   in different components are looked for; bands of many classes are dealt out in pairs of
   blocks for that. Components that candidates tie together form a cluster.
3. A candidate becomes a link when the shingle sets of both whole texts say so. In a
   cluster the texts outside its largest component meet all others, again in blocks.

Pairs never leave a task: it passes on one link for each two components that it joins. No
candidate is dropped for the size of its band or cluster. Chance that bands or likelihood miss a pair of exactly the threshold: below 2e-4.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domicilia.llm.components import components
from domicilia.llm.setsketch import SetSketch
from domicilia.llm.tables import own, store
from domicilia.llm.words import chunks, mix, shingle_sets


@dataclass(frozen=True)
class NearDedup:
    """`similarity`: least Jaccard similarity in percent of a link; `slack`: what the sketches'
    estimate may fall short of it (four standard deviations); `block`: classes of a band that
    one task compares with as many others; `texts`: the same for whole texts; `first`: pivots
    that a class is held against at first.
    """

    similarity: int = 75
    width: int = 5
    sketch: SetSketch = field(default_factory=SetSketch)
    slack: float = 0.18
    block: int = 1024
    texts: int = 256
    first: int = 2

    @property
    def likely(self) -> float:
        return self.similarity / 100 - self.slack

    def sketches(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, whole, sketch); `whole` is a 128-bit digest of the shingle set."""
        schema = "doc_id long, n_shingles long, whole binary, sketch binary"
        width, sketch = self.width, self.sketch

        def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text"):
                    sets = shingle_sets(part.column("text"), width)
                    rows = sketch.registers(sets)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"),
                            pa.array([len(s) for s in sets], pa.int64()),
                            pa.array([_digest(s) for s in sets], pa.binary()),
                            pa.array([r.tobytes() for r in rows], pa.binary()),
                        ],
                        ["doc_id", "n_shingles", "whole", "sketch"],
                    )

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(convert, schema)

    def run(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_shingles, component_id, kept), one row for each row of `docs`.

        Rows without words (or text) have no shingles and no links. Rows of one doc_id
        count as one document whose texts are linked. A row without doc_id is compared with
        nothing: its component is NULL and it is kept. An empty table gives an empty result.
        """
        docs = own(docs, doc_id=doc_id, text=text)
        sketches = store(self.sketches(docs))
        known = sketches.filter("doc_id IS NOT NULL AND n_shingles > 0")
        classes = store(
            known.groupBy("whole").agg(
                F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
            )
        )
        links = self.links(classes, docs)
        nodes = components(links.union(self._repeated(known)))
        found = classes.join(nodes, classes["id"] == nodes["node"], "left").select(
            "whole", F.coalesce("component", "id").alias("component_id")
        )
        found = store(found)
        linked = known.join(found, "whole").select("doc_id", "n_shingles", "component_id")
        alone = sketches.filter("doc_id IS NULL OR n_shingles = 0").select(
            "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
        )
        return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

    @staticmethod
    def _repeated(known: DataFrame) -> DataFrame:
        """Links of the smallest ids of the classes that one doc_id has texts in."""
        least = known.groupBy("whole").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
        texts = known.groupBy("doc_id").agg(F.count_distinct("whole").alias("texts")).filter("texts > 1")
        return (
            known.join(texts, "doc_id", "left_semi")
            .join(least, "whole")
            .select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
        )

    def links(self, classes: DataFrame, docs: DataFrame) -> DataFrame:
        """Links (a, b) of classes that give the components of all links."""
        rows, bands = self.sketch.rows, self.sketch.bands
        banded = classes.select("id", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), "sketch").select(
            "id", F.xxhash64("band", F.substring("sketch", F.col("band") * rows + 1, F.lit(rows))).alias("key")
        )
        ends = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
        ends = store(ends)
        members = store(banded.join(ends, "key"))
        pivots = members.select("id", F.explode(F.array("low", "high")).alias("pivot")).filter("id != pivot").distinct()
        likely = self._estimate(pivots.select(F.col("id").alias("a"), F.col("pivot").alias("b")), classes)
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("estimate"), "b"))
        linked = store(self.verify(likely.withColumn("rank", rank).filter(F.col("rank") <= self.first), docs))
        nodes = store(components(linked))
        tied = store(components(self._apart(members, nodes, classes)))
        return linked.union(self._across(tied, nodes, classes, docs))

    def _estimate(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sketches allow a link, with the estimate."""
        sketch, likely = self.sketch, self.likely
        side = classes.select("id", "n", "sketch")
        joined = pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
        joined = joined.join(side.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                a, b = (_matrix(batch.column(c), sketch.size) for c in ("s_a", "s_b"))
                n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                estimate = sketch.similarity(a, b, n_a, n_b)
                keep = pa.array(estimate >= likely)
                out = [batch.column("a"), batch.column("b"), pa.array(estimate)]
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in out], ["a", "b", "estimate"])

        return joined.mapInArrow(judge, "a long, b long, estimate double")

    def _apart(self, members: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
        """Components (a, b) that candidates of different components tie together."""
        sketch, likely, block = self.sketch, self.likely, self.block
        labelled = members.select("key", "id").join(nodes, F.col("id") == F.col("node"), "left")
        labelled = labelled.select("key", "id", F.coalesce("component", "id").alias("component"))
        mixed = (
            labelled.groupBy("key")
            .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"))
            .filter("x < y")
            .select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
        )
        mixed = store(mixed)
        side = classes.select("id", "n", "sketch")
        rows = store(labelled.join(mixed, "key")).join(side, "id")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select(
            "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n", "sketch"
        )

        def judge(table: pa.Table) -> pa.Table:
            ids, parts = table.column("id").to_numpy(), table.column("component").to_numpy()
            sizes, side = table.column("n").to_numpy().astype(float), table.column("own").to_numpy()
            regs = _matrix(table.column("sketch").combine_chunks(), sketch.size)
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            group = parts.copy()
            found = []
            for x in left:
                near = right[(group[right] != group[x]) & ((ids[right] > ids[x]) | (i != j))]
                near = near[sketch.possible(regs[x], regs[near], sizes[x], sizes[near], likely)]
                for y in near:
                    if group[y] != group[x]:
                        found.append((parts[x], parts[y]))
                        group[group == group[y]] = group[x]
            return _pairs(found)

        return rows.groupBy("key", "i", "j").applyInArrow(judge, "a long, b long").distinct()

    def _across(self, tied: DataFrame, nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
        """Links between the components of each cluster, one for each two that a task joins."""
        width, percent, sketch, likely, block = self.width, self.similarity, self.sketch, self.likely, self.texts
        tied = tied.select(F.col("node").alias("component"), F.col("component").alias("cluster"))
        side = classes.join(nodes, F.col("id") == F.col("node"), "left")
        side = side.select("id", "n", "sketch", F.coalesce("component", "id").alias("component"))
        side = store(side.join(tied, "component"))
        parts = side.groupBy("cluster", "component").agg(F.count("*").alias("size"))
        parts = parts.groupBy("cluster").agg(
            F.max_by("component", F.struct("size", "component")).alias("largest"),
            F.ceil(F.sum("size") / block).cast("int").alias("blocks"),
            F.ceil((F.sum("size") - F.max("size")) / block).cast("int").alias("strips"),
        )
        texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
        rows = side.join(store(parts), "cluster").join(texts, "id")
        met = """transform(sequence(0, strips - 1), i -> struct(i, int(pmod(xxhash64(id), blocks)) AS j, false AS alone))"""
        out = """transform(sequence(0, blocks - 1), j -> struct(int(pmod(xxhash64(id, 1), strips)) AS i, j, true AS alone))"""
        spread = F.expr(f"concat({met}, if(component != largest, {out}, array()))")
        rows = rows.select("cluster", "component", "id", "n", "sketch", "text", F.explode(spread).alias("at"))
        rows = rows.select("cluster", "at.*", "component", "id", "n", "sketch", "text")

        def judge(table: pa.Table) -> pa.Table:
            alone = table.column("alone").to_numpy()
            left, right = np.flatnonzero(alone), np.flatnonzero(~alone)
            group = table.column("component").to_numpy().copy()
            if (group[left] == group[right][0]).all() and (group[right] == group[right][0]).all():
                return _pairs([])
            ids, sizes = table.column("id").to_numpy(), table.column("n").to_numpy().astype(float)
            regs = _matrix(table.column("sketch").combine_chunks(), sketch.size)
            sets = shingle_sets(table.column("text"), width)
            found = []
            for x in left:
                near = right[group[right] != group[x]]
                near = near[sketch.possible(regs[x], regs[near], sizes[x], sizes[near], likely)]
                for y in near:
                    if group[y] == group[x]:
                        continue
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if shared and 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                        found.append((ids[x], ids[y]))
                        group[group == group[y]] = group[x]
            return _pairs(found)

        return rows.groupBy("cluster", "i", "j").applyInArrow(judge, "a long, b long")

    def verify(self, pairs: DataFrame, docs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole texts reach the similarity."""
        width, percent = self.width, self.similarity
        texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        joined = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("t_a")), "a")
        joined = joined.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t_b")), "b")

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "t_a"):
                    keep = []
                    last, known = None, None
                    for a, row in zip(shingle_sets(part.column("t_a"), width), part.column("t_b"), strict=True):
                        if last is None or not row.equals(last):
                            last, known = row, shingle_sets(pa.array([row.as_py()], pa.large_string()), width)[0]
                        shared = len(np.intersect1d(a, known, assume_unique=True))
                        keep.append(shared > 0 and 100 * shared >= percent * (len(a) + len(known) - shared))
                    mask = pa.array(keep, pa.bool_())
                    yield pa.RecordBatch.from_arrays([part.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

        return joined.mapInArrow(judge, "a long, b long").distinct()


def _digest(values: np.ndarray) -> bytes:
    """128 bits of a sorted set of 64-bit values."""
    other = mix(values ^ np.uint64(0xA0761D6478BD642F))
    return values.sum(dtype=np.uint64).tobytes() + other.sum(dtype=np.uint64).tobytes()


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    both = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": both[:, 0], "b": both[:, 1]})


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column), b"") if len(column) else None
    return np.frombuffer(flat[0].as_py(), np.uint8).reshape(-1, width) if flat is not None else np.zeros((0, width), np.uint8)
