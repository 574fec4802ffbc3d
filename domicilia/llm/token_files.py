"""Token ids of a corpus as Parquet list columns that can be read in parts.

Texts are dealt by ranges of doc_id, sorted and encoded; each range partition writes one
file of rows (doc_id, part, before, n_tokens, ids) in ascending order, `before` being the
ids of the part in front of the row. A second, small table holds for each part where its ids
start in the whole stream. The files are Spark's own: its commit keeps them whole when a task
runs twice. Ids are dictionary or delta encoded, row groups and pages are bounded, and
page indexes are written, so a reader of some documents or tokens skips the pages of the
others, and a reader of the metadata never touches the ids.

A vocabulary whose pieces never span white space gives a text the ids of its words in a row.
So the distinct words of a run of texts are encoded once and put together. Other vocabularies are given whole texts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from domicilia.llm.tables import input_bytes, own
from domicilia.llm.tokens import byte_letters
from domicilia.llm.words import chunks
from domicilia.operators.joins import attach, bounded_side
from domicilia.session import shared_path

_CHUNK_BYTES = 8 << 20
_UNKNOWN_SIZE = 1 << 60  # what the optimizer says of frames it knows nothing about is larger
# Fixed value: the cutting pattern that leaves out white space, as the word vocabulary's file states it.
_WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same on words of printable ASCII and Latin letters up to U+017F, but for the one whose lower case is two code points.
_PLAIN = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*$"
_PLAIN_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]| |[^ a-z0-9\u00df-\u00f6\u00f8-\u017f]+"



def _by_words(described: dict) -> bool:
    """Whether ids of a text are those of its words in a row: white space is dropped by the
    cutting pattern, normalisation does not look across it, and nothing is put around the text.
    """
    cutters = (described.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, *rest = cutters
    cuts = first.get("type") == "Split" and first["pattern"] == {"Regex": _WORDWISE}
    cuts = cuts and first["behavior"] == "Removed" and first["invert"]
    plain = all(c.get("type") == "ByteLevel" and not c["add_prefix_space"] and not c["use_regex"] for c in rest)
    steps = (described.get("normalizer") or {}).get("normalizers") or [described.get("normalizer") or {"type": "NFC"}]
    blanks = {"pattern": {"Regex": r"\s+"}, "content": " "}
    local = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s.items() >= blanks.items() for s in steps)
    added = described.get("added_tokens") or []
    bare = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in added)
    model = described["model"]
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
    bpe = model["type"] == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in odd)
    return bool(bpe and cuts and plain and local and bare) and not described.get("truncation") and not described.get("padding")


def _ranks(model: dict) -> dict[bytes, int]:
    """Ids of entries as bytes; one at the end of a word has a closing zero byte, which no plain word holds."""
    letters, end = byte_letters(), model["end_of_word_suffix"]
    return {bytes(letters[c] for c in token.removesuffix(end)) + b"\0" * token.endswith(end): i for token, i in model["vocab"].items()}


def _merged(symbols: list[str], listed: dict[tuple[str, str], int]) -> list[str]:
    """Symbols after all listed merges, those of lowest rank first."""
    while len(symbols) > 1:
        rank, at = min((listed.get(pair, len(listed)), k) for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
        if rank == len(listed):
            break
        symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
    return symbols


@lru_cache(maxsize=4)
def merges_alike(path: str) -> bool:
    """Whether merging any two neighbours that make an entry gives what the file's listed merges give."""
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    if not _by_words(described):
        return False
    model = described["model"]
    end, vocabulary = model["end_of_word_suffix"], model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    singles = len(vocabulary) - len(pairs)
    numbered = [vocabulary.get(a + b) for a, b in pairs] == list(range(singles, len(vocabulary)))
    ranks = _ranks(model)
    symbols = [bytes([b]) + close for b in range(256) for close in (b"", b"\0")]
    if not numbered or len(ranks) != len(vocabulary) or any(ranks.get(s, singles) >= singles for s in symbols):
        return False
    listed = {pair: k for k, pair in enumerate(pairs)}
    for token in (a + b for a, b in pairs):
        letters = list(token.removesuffix(end))
        letters[-1] += end * token.endswith(end)
        if _merged(letters, listed) != [token]:
            return False
    return True


class Encoder:
    """Ids of many texts at a time, as the library gives them, without special tokens around them.

    The library spends most of its time on keeping track of places while it normalises. Words of
    printable ASCII and of Latin letters in one code point are changed by lower-casing alone, so those are
    cut here and their pieces merged by a faster encoder with the vocabulary's own ranks. Other words,
    and those that hold a special string, go through the library itself.

    The fast encoder merges any two neighbours that make an entry, the library only those the file
    lists. Both do the same if entries are numbered in the order of the merges and each entry's own symbols
    merge to it: two other neighbours cannot make it then, since its listed pair would have been
    there before them. `merges_alike` looks at both, entry by entry; without it the library does all.
    """

    def __init__(self, path: str, alike: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = alike and _by_words(described)
        if self.by_words:
            self.special = [t["content"] for t in described.get("added_tokens") or []]
            self.cut = re.compile(_PLAIN_PIECES).findall
            ranks = _ranks(described["model"])
            self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
            # A blank as a piece of its own stands between words.
            self.between = ranks[b" \0"]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words in a row, and where each word's start and the last one's end."""
        pieces = "\0".join([*self.cut(" ".join(words).lower()), ""])
        ids = self.fast.encode_to_numpy(pieces).astype(np.int32)
        gaps = ids == self.between
        starts = np.flatnonzero(gaps) - np.arange(len(words) - 1)
        return ids[~gaps], np.concatenate([[0], starts, [len(ids) - len(words) + 1]])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, and where each word's start and the last one's end."""
        plain = pc.match_substring_regex(words, _PLAIN)
        for special in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, special))
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        plain = plain.to_numpy(zero_copy_only=False)
        listed = words.to_numpy(zero_copy_only=False)
        if plain.all():
            return self._plain(listed.tolist())
        odd = [self.whole(w) for w in listed[~plain].tolist()]
        ids, starts = self._plain(listed[plain].tolist()) if plain.any() else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        sizes = np.zeros(len(listed), np.int64)
        sizes[plain], sizes[~plain] = np.diff(starts), [len(o) for o in odd]
        out = np.empty(int(sizes.sum()), np.int32)
        of_plain = np.repeat(plain, sizes)
        out[of_plain], out[~of_plain] = ids, np.concatenate(odd)
        return out, np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start and the last one's end."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_words:
            found = [self.whole(t) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.int32), *found]), np.cumsum([0, *map(len, found)])
        split = pc.ascii_split_whitespace(texts)
        unique = split.flatten().dictionary_encode()
        which = unique.indices.to_numpy(zero_copy_only=False)
        flat, starts = self._words(unique.dictionary)
        ends = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        taken = np.diff(starts)[which]
        until = np.concatenate([[0], np.cumsum(taken)])
        ids = flat[np.arange(until[-1]) + np.repeat(starts[which] - until[:-1], taken)]
        return ids, until[ends]


@lru_cache(maxsize=4)
def encoder(path: str, alike: bool) -> Encoder:
    return Encoder(path, alike)


def with_end(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end` after each text, and the new starts."""
    n = len(starts) - 1
    starts = starts + np.arange(n + 1)
    out = np.full(len(ids) + n, end, np.int32)
    keep = np.ones(len(out), bool)
    keep[starts[1:] - 1] = False
    out[keep] = ids
    return out, starts


def crc_of(ids: pa.ListArray | pa.LargeListArray) -> list[int]:
    """Unsigned crc32 of each row's ids as little-endian 32-bit integers."""
    values = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
    ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [zlib.crc32(values[4 * low : 4 * high]) for low, high in zip([0, *ends], ends, strict=False)]


@dataclass(frozen=True)
class TokenFiles:
    """`path`: a tokenizers .json file, at the same place on every executor; `end`: the id after
    each document; `encoding` of the ids: dictionary (16 bits and less an id) or delta (for ids that
    rise or repeat); `file_bytes`: input of one file; `group_bytes`, `page_bytes` and `page_rows`:
    bounds of row groups and pages.
    """

    path: str
    end: int = 2
    encoding: str = "dictionary"
    file_bytes: int = 64 << 20
    group_bytes: int = 16 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 1000

    def options(self) -> dict[str, str]:
        """Settings of Spark's Parquet writer. Integers without a dictionary are delta encoded by version 2."""
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError(f"no such encoding: {self.encoding}")
        return {
            "compression": "zstd",
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#ids.list.element": str(self.encoding == "dictionary").lower(),
            "parquet.block.size": str(self.group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
        }

    def encoded(self, rows: DataFrame) -> DataFrame:
        """(doc_id, part, before, n_tokens, ids) of sorted range partitions numbered `part`."""
        path, end, alike = self.path, self.end, merges_alike(self.path)

        def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, before = encoder(path, alike), 0
            for batch in batches:
                for piece in chunks(batch, "text", _CHUNK_BYTES):
                    ids, starts = with_end(*known.encode(piece.column("text")), end)
                    columns = [
                        piece.column("doc_id"),
                        piece.column("part"),
                        pa.array(before + starts[:-1], pa.int64()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "before", "n_tokens", "ids"])
                    before += int(starts[-1])

        return rows.mapInArrow(convert, "doc_id long, part int, before long, n_tokens long, ids array<int>")

    def write(self, docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> None:
        """Writes `folder`/ids, a file for each range of doc_id, and `folder`/parts, where each starts.

        Order: doc_id, NULL first, then the hash of the text; equal rows stand in any order, and
        may fill several parts. A NULL or empty text is the end id alone. An empty table gives
        empty files. Other columns of `docs` are not read.
        """
        spark = docs.sparkSession
        size = input_bytes(docs)
        by_size = size // self.file_bytes if size < _UNKNOWN_SIZE else 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), by_size)
        rows = own(docs, doc_id=doc_id, text=text).select(
            F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.spark_partition_id().alias("from")
        )
        dealt = rows.repartitionByRange(parts, "doc_id", "tie", "from").sortWithinPartitions("doc_id", "tie", "text")
        numbered = dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))
        self.encoded(numbered).write.options(**self.options()).parquet(f"{folder}/ids")
        _parts(spark.read.parquet(f"{folder}/ids")).write.parquet(f"{folder}/parts")

    def run(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of each row, read back from files written anew."""
        folder = shared_path(docs.sparkSession, "tokens")
        self.write(docs, folder, doc_id, text)
        return checked(read_documents(docs.sparkSession, folder))


_GROUP = 1024


def _parts(ids: DataFrame) -> DataFrame:
    """(part, first_id, last_id, n_docs, n_tokens, start) of the written rows; the ids are not read.

    Starts are running totals over a thousand parts, then over the totals of those runs.
    """
    totals = ids.groupBy("part").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
    )
    totals = totals.withColumn("run", F.expr(f"part div {_GROUP}"))
    inside = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    local = totals.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    runs, before = [], 0
    for run, n in sorted(totals.groupBy("run").agg(F.sum("n_tokens")).collect()):  # one row for a thousand files
        runs.append((run, before))
        before += n
    placed = local.join(F.broadcast(ids.sparkSession.createDataFrame(runs, "run long, earlier long")), "run")
    return placed.select("part", "first_id", "last_id", "n_docs", "n_tokens", (F.col("start") + F.col("earlier")).alias("start"))


def _with_starts(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    starts = bounded_side(spark.read.parquet(f"{folder}/parts").select("part", F.col("start").alias("__start")))
    placed = attach(rows, starts, ["part"], ["doc_id"], "inner")
    return placed.withColumn("start", F.col("__start") + F.col("before"))


def read_documents(spark: SparkSession, folder: str, low: int | None = None, high: int | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens[, ids]) of the documents with low <= doc_id < high, all by default.

    The bounds reach the statistics of row groups and pages; without `ids` only the metadata columns are read.
    """
    rows = spark.read.parquet(f"{folder}/ids")
    rows = rows if low is None else rows.filter(F.col("doc_id") >= low)
    rows = rows if high is None else rows.filter(F.col("doc_id") < high)
    return _with_starts(spark, folder, rows).select("doc_id", "start", "n_tokens", *["ids"] * ids)


def read_tokens(spark: SparkSession, folder: str, low: int, high: int) -> DataFrame:
    """(doc_id, start, ids): ids number low to high of the whole stream, by document, `start` the first one's number.

    Parts outside are not read; inside, pages that end before `low` or start at `high` or later are skipped.
    """
    found = spark.read.parquet(f"{folder}/parts").filter((F.col("start") < high) & (F.col("start") + F.col("n_tokens") > low))
    edge = found.agg(F.min("part"), F.max("part"), F.min("start")).first()
    first, last, start = edge if edge[0] is not None else (0, -1, 0)
    rows = spark.read.parquet(f"{folder}/ids").filter(F.col("part").between(first, last))
    # Rows of the first part by their place in it; `start` of later parts is decided below.
    rows = rows.filter((F.col("part") != first) | (F.col("before") < high - start))
    placed = _with_starts(spark, folder, rows).filter((F.col("start") < high) & (F.col("start") + F.col("n_tokens") > low))
    skip = F.greatest(F.lit(low) - F.col("start"), F.lit(0))
    n = F.least(F.lit(high) - F.col("start"), F.col("n_tokens")) - skip
    cut = F.slice("ids", (skip + 1).cast("int"), n.cast("int"))
    return placed.select("doc_id", (F.col("start") + skip).alias("start"), cut.alias("ids"))


def checked(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows read with their ids."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens"]
        for batch in batches:
            digest = pa.array(crc_of(batch.column("ids")), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], digest], [*names, "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(convert, "doc_id long, start long, n_tokens long, ids_crc32 long")
