"""Repeated passages by super-k-mers: windows that share a minimiser travel as one string.

The minimiser of a window is the run of `seed` words with the smallest hash in it; runs that
a sample of the texts shows to be frequent come after all others, so that a line that most texts share does
not send all of them to one bucket. The order is the same everywhere and any order gives the same
result. Consecutive windows with the same minimiser form one super-k-mer: their words, packed as
one string, go to the bucket of the minimiser. Equal windows have equal minimisers, so
each bucket finds its repeated windows by sorting, without any other bucket.

Before the shuffle each task keeps one copy, the earliest, of every super-k-mer it holds
and knows at once that the windows of the others are repeats. A passage that a third of
all texts share thus reaches its bucket once a chunk of texts, not once a text. The strings
for a bucket are packed into compressed blocks. The number of buckets follows the size
of the input; a bucket that is large all the same is gone through in several passes over
its windows' hashes, so that what is sorted at once stays bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domicilia.llm.tables import input_bytes, own
from domicilia.llm.words import Words, chunks, mix

CHUNK = 8 << 20
_GATHER = 1 << 16
_FREQUENT_RUNS = 1 << 16
_OTHER = np.uint64(0xA0761D6478BD642F)
_STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class SuperKmers:
    """Each one's first window, the one after its last, its text's row and its minimiser."""

    low: np.ndarray
    high: np.ndarray
    row: np.ndarray
    seed: np.ndarray

    @classmethod
    def cut(cls, words: Words, hashes: np.ndarray, width: int, seed: int, frequent: np.ndarray) -> SuperKmers:
        """Runs of windows of one text that have their minimiser at the same place; `frequent`: sorted seeds that come last."""
        windows = np.maximum(words.counts - width + 1, 0)
        total, span = int(windows.sum()), width - seed + 1
        runs = words.runs(hashes, seed)
        ranks = mix(runs ^ _OTHER) >> np.uint64(1)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)
            ranks[frequent[at] == runs] |= np.uint64(1 << 63)
        n = max(len(ranks) - span + 1, 0)
        least, at = ranks[:n].copy(), np.arange(n)
        for j in range(1, span):
            lower = np.flatnonzero(ranks[j : j + n] < least)
            least[lower] = ranks[lower + j]
            at[lower] = lower + j
        row = np.repeat(np.arange(len(windows)), windows)
        start = np.arange(total) + np.repeat(words.first[:-1] - (np.cumsum(windows) - windows), windows)
        least, at = least[start], at[start]
        new = np.ones(total, bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], total)[: len(first)] - 1
        return cls(start[first], start[last] + 1, row[first], least[first])


def _string_key(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, step: int) -> np.ndarray:
    """64 bits for the words [low, high) of each range."""
    factors = np.full(len(hashes) + 1, step, np.uint64)
    factors[0] = 1
    powers = np.cumprod(factors, dtype=np.uint64)
    factors[1:] = pow(step, -1, 1 << 64)
    back = np.cumprod(factors, dtype=np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers[:-1], out=sums[1:])
    return (sums[high] - sums[low]) * back[low] + (high - low).astype(np.uint64)


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges one after the other, and where each begins."""
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    out = np.empty(int(at[-1]), np.uint8)
    for low in range(0, len(starts), _GATHER):
        edge = at[low : low + _GATHER + 1]
        shift = np.repeat(starts[low : low + _GATHER] - edge[:-1], np.diff(edge))
        out[edge[0] : edge[-1]] = data[np.arange(edge[0], edge[-1]) + shift]
    return out, at


def _head(*columns: np.ndarray) -> bytes:
    """doc_id in 8 bytes, the other columns (a 32-bit tag, word places, sizes) in 4."""
    return b"".join(c.astype("<i8" if not i else "<i4").tobytes() for i, c in enumerate(columns))


def _columns(head: bytes) -> np.ndarray:
    n = len(head) // 20
    return np.stack([np.frombuffer(head, "<i8", n), *np.frombuffer(head, "<i4", 3 * n, 8 * n).reshape(3, n).astype(np.int64)])


def _same(*keys: np.ndarray) -> np.ndarray:
    """Which sorted rows equal the row before in all keys."""
    out = np.zeros(len(keys[0]), bool)
    out[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    return out


def _later(order: np.ndarray, equal: np.ndarray, *position: np.ndarray) -> np.ndarray:
    """Of groups of `equal` rows in `order`, the rows that are not at the first one's position."""
    first = order[np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))]
    moved = np.logical_or.reduce([p[order] != p[first] for p in position])
    return order[equal & moved]


@dataclass(frozen=True)
class SubstringDedup:
    """`width`: words of a window; `seed`: words of a minimiser; `bucket_bytes`: input bytes for
    each bucket; `pass_bytes`: bytes of a bucket's strings that are sorted at once; `sample`: about so
    many texts are looked at for frequent runs (0: none), which are those in one of
    `frequent` of them or more. All but the first two set how the work is dealt, not the result.
    """

    width: int = 20
    seed: int = 4
    bucket_bytes: int = 2 << 20
    pass_bytes: int = 48 << 20
    sample: int = 4000
    frequent: int = 200

    def frequent_runs(self, docs: DataFrame) -> np.ndarray:
        """Sorted hashes of the runs of `seed` words that occur in many texts of the sample."""
        total = docs.select("doc_id").count() if self.sample else 0
        if not total:
            return np.zeros(0, np.uint64)
        some = docs.select("text").sample(min(1.0, self.sample / max(total, 1)), 11)
        width, least = self.seed, max(8, min(total, self.sample) // self.frequent)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text", CHUNK):
                    words = Words.of(part.column("text"))
                    runs = words.runs(words.hashes(), width) if len(words.starts) else np.zeros(0, np.uint64)
                    doc = np.repeat(np.arange(len(words.counts)), words.counts)[: len(runs)]
                    pairs = np.unique(np.stack([runs, doc.astype(np.uint64)]), axis=1)[0] if len(runs) else runs
                    found, n = np.unique(pairs, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["run", "n"])

        counts = some.mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        rows = counts.orderBy(F.desc("n"), "run").limit(_FREQUENT_RUNS).select("run").toArrow()
        return np.sort(rows["run"].to_numpy().astype(np.int64).view(np.uint64))

    def removed(self, docs: DataFrame) -> DataFrame:
        """Word ranges (doc_id, tag, low, high) that windows with an earlier copy cover.

        `docs` has doc_id, text and tag, which tells rows of one doc_id apart.
        """
        buckets = max(128, -(-input_bytes(docs) // self.bucket_bytes))
        width, seed, most = self.width, self.seed, self.pass_bytes
        docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
        shared = docs.sparkSession.sparkContext.broadcast(self.frequent_runs(docs))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text", CHUNK):
                    yield from _cut(part, width, seed, buckets, shared.value)

        def meet(table: pa.Table) -> pa.Table:
            return _meet(table, width, most)

        packed = docs.mapInArrow(cut, "bucket long, head binary, body binary")
        return packed.groupBy("bucket").applyInArrow(meet, "doc_id long, tag long, low long, high long")

    def run(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256, kept_text), one row for each row of `docs`.

        A NULL text has no words. Texts shorter than a window lose nothing. A row without
        doc_id is kept whole and compared with nothing. Of rows of one doc_id the windows are
        ordered by place, then by the texts' hashes; equal rows count as one. An empty table
        gives an empty result. Without `with_text` the kept text is left out.
        """
        docs = own(docs, doc_id=doc_id, text=text)
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").cast("long").alias("tag"))
        ranges = self.removed(docs).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
        joined = docs.join(ranges, ["doc_id", "tag"], "left").select("doc_id", "text", "ranges")
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text", CHUNK):
                    yield _keep(part, with_text)

        return joined.mapInArrow(keep, schema)


def _cut(part: pa.RecordBatch, width: int, seed: int, buckets: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks for the buckets: a head (doc_id, tag, place, bytes) and the strings; without
    strings, ranges (doc_id, tag, low, high) that are settled already.
    """
    words = Words.of(part.column("text"))
    if not part.num_rows or words.counts.max() < width:
        return
    hashes = words.hashes()
    kmers = SuperKmers.cut(words, hashes, width, seed, frequent)
    doc = part.column("doc_id").to_numpy()[kmers.row]
    tag = part.column("tag").to_numpy()[kmers.row]
    place = kmers.low - words.first[kmers.row]
    stop = kmers.high + width - 1
    a = _string_key(hashes, kmers.low, stop, _STEPS[0])
    b = _string_key(words.hashes(seed=1), kmers.low, stop, _STEPS[1])
    order = np.lexsort((tag, place, doc, b, a))
    equal = _same(a[order], b[order])
    settled = _later(order, equal, doc, place, tag)
    sent = order[~equal]
    bucket = (kmers.seed % np.uint64(buckets)).astype(np.int64)
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    raw, at = _gather(words.data, words.starts[kmers.low[sent]], words.ends[stop[sent] - 1])
    squeeze = zstandard.ZstdCompressor(level=3)
    numbers, heads, bodies = [], [], []
    edges = np.flatnonzero(np.diff(bucket[sent], prepend=-1))
    for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(sent)], strict=True):
        some = sent[low:high]
        numbers.append(int(bucket[some[0]]))
        heads.append(squeeze.compress(_head(doc[some], tag[some], place[some], np.diff(at[low : high + 1]))))
        bodies.append(squeeze.compress(raw[at[low] : at[high]].tobytes()))
    if len(settled):
        ends = place[settled] + stop[settled] - kmers.low[settled]
        numbers.append(int(mix(doc[settled[:1]].astype(np.uint64))[0] % np.uint64(buckets)))
        heads.append(squeeze.compress(_head(doc[settled], tag[settled], place[settled], ends)))
        bodies.append(None)
    yield pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int64()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["bucket", "head", "body"]
    )


def _meet(table: pa.Table, width: int, most: int) -> pa.Table:
    """Ranges that the repeated windows of one bucket cover."""
    unpack = zstandard.ZstdDecompressor()
    heads = [_columns(unpack.decompress(h.as_py())) for h in table.column("head")]
    bodies = table.column("body")
    held = [i for i in range(len(heads)) if bodies[i].is_valid]
    found = [heads[i] for i in range(len(heads)) if not bodies[i].is_valid]
    passes = -(-sum(int(heads[i][3].sum()) for i in held) // most)
    for turn in range(passes):
        windows = [_windows(heads[i], unpack.decompress(bodies[i].as_py()), width, turn, passes) for i in held]
        a, b, doc, tag, place = (np.concatenate(c) for c in zip(*windows, strict=True))
        del windows
        order = np.lexsort((tag, place, doc, b, a))
        later = _later(order, _same(a[order], b[order]), doc, place, tag)
        later = later[np.lexsort((place[later], tag[later], doc[later]))]
        doc, tag, place = doc[later], tag[later], place[later]
        new = ~_same(doc, tag)
        new[1:] |= place[1:] > place[:-1] + width
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc))[: len(first)] - 1
        found.append(np.stack([doc[first], tag[first], place[first], place[last] + width]))
    rows = np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1)
    return pa.table([pa.array(r, pa.int64()) for r in rows], ["doc_id", "tag", "low", "high"])


def _windows(head: np.ndarray, body: bytes, width: int, turn: int, passes: int) -> tuple[np.ndarray, ...]:
    """(two hashes, doc_id, tag, place) of the windows of a block that this turn sorts."""
    doc, tag, place, sizes = head
    words = Words.cut(np.frombuffer(body, np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
    hashes = words.hashes()
    counts = words.counts - width + 1
    shift = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    start = shift + np.repeat(words.first[:-1], counts)
    a = words.runs(hashes, width)[start]
    b = words.runs(words.hashes(seed=1), width)[start]
    out = (a, b, np.repeat(doc, counts), np.repeat(tag, counts), np.repeat(place, counts) + shift)
    if passes == 1:
        return out
    mine = (b >> np.uint64(32)) % np.uint64(passes) == turn
    return tuple(x[mine] for x in out)


def _keep(part: pa.RecordBatch, with_text: bool) -> pa.RecordBatch:
    words = Words.of(part.column("text"))
    ranges = part.column("ranges")
    pairs = ranges.flatten()
    owner = np.repeat(np.arange(part.num_rows), [len(r) if r.is_valid else 0 for r in ranges])
    low, high = (pairs.field(k).to_numpy() for k in ("low", "high"))
    cover = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(cover, words.first[owner] + low, 1)
    np.add.at(cover, words.first[owner] + high, -1)
    kept = np.cumsum(cover[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[words.first]
    padded = np.append(words.data, np.uint8(32))
    raw, at = _gather(padded, words.starts[kept], words.ends[kept] + 1)
    raw[at[1:] - 1] = 32
    raw = raw.tobytes()
    texts = [raw[at[x] : max(at[y] - 1, at[x])] for x, y in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
    columns = [
        part.column("doc_id"),
        pa.array(words.counts, pa.int64()),
        pa.array(words.counts - np.diff(left), pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
    ]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if with_text:
        columns.append(pa.array([t.decode() for t in texts], pa.string()))
        names.append("kept_text")
    return pa.RecordBatch.from_arrays(columns, names)
