"""Packing token pieces into sequences of one capacity by exact complements.

Which document goes where depends only on how many pieces of each length there are. So the
plan is made from a histogram of at most `capacity` lengths: for each length, from the
longest, single lengths, pairs and triples that fill the gap exactly are consumed as
often as the counts allow; what is left is placed best-fit, longest first, whole counts at
a time. The plan is a list of rank ranges for each length. Its size depends on the capacity
alone, since every step uses up a length or a group of equal sequences. Documents then look
up their place by their rank among the pieces of their length, which is counted in salted
parts, so that no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domicilia.llm.tables import own, store
from domicilia.llm.tokens import vocabulary
from domicilia.llm.words import chunks

Pattern = tuple[int, list[tuple[int, int]]]  # sequences, and (length, pieces of it) in each


def complements(counts: np.ndarray, gap: int, most: int) -> Iterator[tuple[int, ...]]:
    """Available lengths, longest first, that fill `gap`: one, then two, then three, `most` at most.

    The indexes are looked up in the counts as they are when the next one is asked for.
    """
    if counts[gap]:
        yield (gap,)
    for a in range(gap - 1, (gap + 1) // 2 - 1, -1) if most > 1 else ():
        if counts[a] and counts[gap - a]:
            yield (a, gap - a)
    for a in range(gap - 2, (gap + 2) // 3 - 1, -1) if most > 2 else ():
        if counts[a]:
            rest = gap - a
            b = np.arange(min(a, rest - 1), (rest + 1) // 2 - 1, -1)
            for x in b[(counts[b] > 0) & (counts[rest - b] > 0)].tolist():
                if counts[a] and counts[x] and counts[rest - x]:
                    yield (a, x, rest - x)


def _most(counts: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How often these lengths can be taken together."""
    return min(int(counts[x]) // lengths.count(x) for x in set(lengths))


def exact_fills(counts: np.ndarray, capacity: int, most: int = 3) -> list[Pattern]:
    """Consumes, from `counts`, lengths with up to `most` others that fill a sequence."""
    plan: list[Pattern] = []

    def take(lengths: tuple[int, ...]) -> None:
        if n := _most(counts, lengths):
            for x in lengths:
                counts[x] -= n
            plan.append((n, [(x, lengths.count(x)) for x in dict.fromkeys(lengths)]))

    take((capacity,))
    for length in range(capacity - 1, 0, -1):
        if counts[length]:
            for filled in complements(counts, capacity - length, most):
                take((length, *filled))
                if not counts[length]:
                    break
    return plan


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Places what is left, longest first, into the sequences with the least sufficient gap."""
    groups: dict[int, list[Pattern]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: Pattern) -> None:
        if pattern[0]:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append(pattern)

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(gaps, length)
            gap = gaps[at] if at < len(gaps) else capacity
            each = gap // length
            n, held = groups[gap].pop() if at < len(gaps) else (-(-left // each), [])
            if at < len(gaps) and not groups[gap]:
                del groups[gap], gaps[at]
            full = min(n, left // each)
            put(gap - each * length, (full, [*held, (length, each)]))
            left -= full * each
            if full < n and left:
                put(gap - left * length, (1, [*held, (length, left)]))
                full, left = full + 1, 0
            if held:
                put(gap, (n - full, held))
    return [pattern for gap in gaps for pattern in groups[gap]]


def plan_ranges(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, offset, pieces a sequence) by length and rank,
    and the number of sequences. `counts`: pieces of each length from 0 to `capacity`.

    Triples use up short lengths that residuals may need, so complements of up to three, two
    and one lengths are planned, and the plan of fewest sequences is taken.
    """
    plans = []
    for most in (3, 2, 1):
        left = counts.astype(np.int64).copy()
        plan = exact_fills(left, capacity, most)
        plans.append(plan + best_fit(left, capacity))
    plan = min(plans, key=lambda p: sum(n for n, _ in p))
    rank = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for n, held in plan:
        offset = 0
        for length, each in held:
            rows.append((length, rank[length], sequence, offset, each))
            rank[length] += n * each
            offset += length * each
        sequence += n
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5), sequence


@dataclass(frozen=True)
class Packing:
    """`path`: byte-level BPE vocabulary in tokenizers' .json form, at the same place on every
    executor; `capacity`: tokens of a sequence; `end`: the id put after each document;
    `part_rows`: pieces that are ranked in one task.
    """

    path: str
    capacity: int = 2048
    end: int = 0
    part_rows: int = 1_000_000

    def pieces(self, docs: DataFrame, with_ids: bool = False) -> DataFrame:
        """(doc_id, piece, start, length, ids_crc32[, ids]) of documents cut to the capacity.

        A longer document is cut from its end, so only its first piece may be shorter.
        """
        path, capacity, end = self.path, self.capacity, self.end
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = vocabulary(path)
            for batch in batches:
                for part in chunks(batch, "text"):
                    rows, pieces = [], []
                    for row, text in enumerate(part.column("text")):
                        ids = np.append(known.encode(text.as_py() or ""), end).astype("<u4")
                        edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                        for n, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
                            rows.append((row, n, low, high - low, zlib.crc32(ids[low:high].tobytes())))
                            pieces.append(ids[low:high])
                    values = np.array(rows, np.int64).reshape(-1, 5)
                    columns = [part.column("doc_id").take(pa.array(values[:, 0])), *[pa.array(values[:, k]) for k in range(1, 5)]]
                    if with_ids:
                        columns.append(pa.array(pieces, pa.list_(pa.uint32())).cast(pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names)

        schema = "doc_id long, piece long, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
        return docs.mapInArrow(cut, schema)

    def run(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
        """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), a row for each piece.

        A NULL or empty text is the end id alone. Rows of a NULL or repeated doc_id are packed
        each for itself. An empty table gives an empty result.
        """
        docs = own(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        pieces = store(self.pieces(docs, with_ids))
        counts = np.zeros(self.capacity + 1, np.int64)
        for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
            counts[row["length"]] = row["n"]
        ranges, _ = plan_ranges(counts, self.capacity)
        parts = max(64, int(counts.sum()) // self.part_rows)
        salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
        sizes = salted.groupBy("length", "part").agg(F.count("*").alias("size"))
        before = F.sum("size").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
        within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
        ranked = salted.withColumn("within", within).join(sizes, ["length", "part"])
        ranked = ranked.withColumn("rank", F.col("before") + F.col("within") - 1)
        shared = docs.sparkSession.sparkContext.broadcast(ranges)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"] + ["ids"] * with_ids

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            keys = (table[:, 0] << 48) + table[:, 1] if len(table) else np.zeros(0, np.int64)
            for batch in batches:
                length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
                _, first, sequence, offset, each = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1].T
                spot = rank - first
                columns = [batch.column(c) for c in names if c != "rank"]
                columns[5:5] = [pa.array(sequence + spot // each), pa.array(offset + spot % each * length)]
                yield pa.RecordBatch.from_arrays(columns, [*names[:5], "sequence_id", "offset", *names[6:]])

        schema = "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
        return ranked.select(*names).mapInArrow(place, schema + ", ids array<int>" * with_ids)
