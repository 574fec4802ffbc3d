"""Exact token counts by merging pairs on a heap over a linked list.

A piece starts as one symbol a byte. The adjacent pair of lowest rank (leftmost first) is
popped and merged until no pair is in the vocabulary; the count is the number of
initial symbols minus the number of merges. No identifiers are made. Pieces recur, so a
worker remembers their counts up to a bound; a full memory is started anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domicilia.llm.tables import own
from domicilia.llm.tokens import Vocabulary, vocabulary
from domicilia.llm.words import chunks

MEMORY = 400_000


def merges(symbols: bytes, ranks: dict[bytes, int]) -> int:
    """How many merges byte-pair encoding makes in one piece."""
    n = len(symbols)
    end = list(range(1, n + 1))  # where the symbol that starts here ends; 0: no symbol starts here
    before = list(range(-1, n - 1))
    heap = [(ranks[pair], i, i + 2) for i in range(n - 1) if (pair := symbols[i : i + 2]) in ranks]
    heapify(heap)
    done = 0
    while heap:
        _, left, stop = heappop(heap)
        right = end[left]
        # An entry is stale when one of its symbols has been merged since.
        if not right or right >= n or end[right] != stop:
            continue
        end[left], end[right] = stop, 0
        done += 1
        if stop < n:
            before[stop] = left
            if (rank := ranks.get(symbols[left : end[stop]])) is not None:
                heappush(heap, (rank, left, end[stop]))
        if (first := before[left]) >= 0 and (rank := ranks.get(symbols[first:stop])) is not None:
            heappush(heap, (rank, first, stop))
    return done


class _Counts(dict):
    """Tokens of a piece, counted when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        symbols = piece.encode()
        count = 1 if symbols in self.ranks else len(symbols) - merges(symbols, self.ranks)
        if len(self) >= MEMORY:
            self.clear()
        if len(symbols) <= 64:
            self[piece] = count
        return count


_KNOWN: dict[str, _Counts] = {}


def count_tokens(text: str, known: _Counts, vocab: Vocabulary) -> int:
    """Tokens of a text; each special string in it is one token."""
    if vocab.cut is None:
        return sum(map(known.__getitem__, vocab.split(text)))
    parts = vocab.cut.split(text)
    return len(parts) - 1 + sum(sum(map(known.__getitem__, vocab.split(part))) for part in parts)


@dataclass(frozen=True)
class TokenCount:
    """`path`: a byte-level BPE vocabulary in tokenizers' .json form, at the same place on every
    executor; `limit`: the count above which a text is `over_limit`.
    """

    path: str
    limit: int = 1024

    def run(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of `docs`.

        A NULL text counts as empty: 0 bytes, 0 tokens. NULL and repeated ids are passed
        through. An empty table gives an empty result.
        """
        path, limit = self.path, self.limit

        def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab = vocabulary(path)
            known = _KNOWN.setdefault(path, _Counts(vocab.ranks))
            for batch in batches:
                for part in chunks(batch, "text"):
                    texts = [t.as_py() or "" for t in part.column("text")]
                    counts = [count_tokens(t, known, vocab) for t in texts]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"),
                            pa.array([len(t.encode()) for t in texts], pa.int64()),
                            pa.array(counts, pa.int64()),
                            pa.array([c > limit for c in counts], pa.bool_()),
                        ],
                        ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                    )

        rows = own(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return rows.mapInArrow(convert, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
