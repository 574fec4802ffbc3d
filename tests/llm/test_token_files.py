"""Token files against the vocabulary's library: round trip, encodings, selective reads, hard rows."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from domicilia.llm.token_files import Encoder, TokenFiles, merges_alike, read_documents, read_tokens
from domicilia.session import shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODERS = {}
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def encoder(path):
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path, merges_alike(path))
    return ENCODERS[path]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def expected(docs, library):
    """(doc_id, start, ids) in the order of the files; the repeated id has equal texts."""
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for doc_id, text in rows:
        out.append((doc_id, start, _ids(library, text)))
        start += len(out[-1][2])
    return out


@pytest.fixture(scope="module", params=["dictionary", "delta"])
def written(spark, docs, request):
    folder = shared_path(spark, "tokens")
    TokenFiles(PATH, encoding=request.param, page_bytes=4096, page_rows=4).write(docs, folder)
    return folder


def test_query_rows(docs, expected):
    got = sorted(TokenFiles(PATH).run(docs).collect(), key=lambda r: r.start)
    crc = [zlib.crc32(np.array(ids, "<u4").tobytes()) for _, _, ids in expected]
    assert [tuple(r) for r in got] == [(i, s, len(ids), c) for (i, s, ids), c in zip(expected, crc, strict=True)]


def test_empty_table(no_docs):
    assert TokenFiles(PATH).run(no_docs).collect() == []


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files(spark, sf_dir, encoding):
    folder = shared_path(spark, "tokens")
    TokenFiles(PATH, encoding=encoding).write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    files = [f for f in glob.glob(f"{folder}/ids/*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    assert files
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        ids = columns["ids.list.element"]
        assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in ids.encodings
        assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index and ids.has_offset_index
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        found = [i for i in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist() if i is not None]
        assert found == sorted(found)


def test_row_groups_are_bounded(spark, sf_dir):
    folder = shared_path(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        TokenFiles(PATH, group_bytes=40_000, page_bytes=4096, page_rows=10).write(docs, folder)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    (file,) = glob.glob(f"{folder}/ids/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == docs.count() and meta.num_row_groups == 2  # sizes are looked at every hundred rows


def test_selective_reads(spark, written, expected):
    folder = written
    got = read_documents(spark, folder, 6, 10)
    assert sorted((r.doc_id, r.start, r.ids) for r in got.collect()) == [e for e in expected if e[0] is not None and 6 <= e[0] < 10]
    assert "GreaterThanOrEqual(doc_id,6)" in got._jdf.queryExecution().toString()
    metadata = read_documents(spark, folder, ids=False)
    assert "ids:array" not in metadata._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.start for r in metadata.collect()) == [s for _, s, _ in expected]
    stream = [i for _, _, ids in expected for i in ids]
    for low, high in ((0, 5), (17, 900), (len(stream) - 3, len(stream) + 9), (5, 5)):
        rows = sorted(read_tokens(spark, folder, low, high).collect(), key=lambda r: r.start)
        assert [i for r in rows for i in r.ids] == stream[low:high]
        assert not rows or rows[0].start == low


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), st.text(st.characters(max_codepoint=0x1FF), max_size=12)), max_size=4),
    st.sampled_from([" ", "\n\x0b", "\x1c", " ́", "<|endoftext|>", "'S", "ß'LLÄ"]),
)
def test_words_give_the_ids_of_the_text(parts, glue):
    library, text = encoder(PATH).tokenizer, glue.join(parts)
    ids, starts = encoder(PATH).encode(pa.array([text, None, text]))
    whole = library.encode(text, add_special_tokens=False).ids
    assert encoder(PATH).by_words and ids.tolist() == whole * 2 and starts.tolist() == [0, len(whole), len(whole), 2 * len(whole)]


def test_every_common_character(library):
    """Alone, doubled, and between letters, digits and signs."""
    chars = [chr(c) for c in [*range(0x250), *range(0x300, 0x310), 0x3A3, 0x3C2, 0x212B, 0x1E9E]]
    words = [w for c in chars for w in (c, f"a{c}B{c}", f"1{c}2", f"'{c}'{c}", f"{c}e\u0301")]
    ids, starts = encoder(PATH).encode(pa.array(words))
    for k, word in enumerate(words):
        assert ids[starts[k] : starts[k + 1]].tolist() == library.encode(word, add_special_tokens=False).ids, repr(word)


def test_other_vocabularies_get_whole_texts(texts):
    known = encoder(BYTES)
    assert not known.by_words
    ids, starts = known.encode(pa.array([t for _, t in texts[:4]]))
    assert ids[starts[0] : starts[1]].tolist() == known.tokenizer.encode(texts[0][1], add_special_tokens=False).ids


def test_given_texts(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").toArrow()["text"].combine_chunks()
    ids, starts = encoder(PATH).encode(rows)
    for k, text in enumerate(rows.to_pylist()[:60]):
        assert ids[starts[k] : starts[k + 1]].tolist() == _ids(library, text)[:-1]


def test_one_id_in_many_rows(spark, library):
    """An id that holds most rows fills several parts; ids of rows still follow each other without gaps."""
    docs = spark.range(0, 600, 1, 6).selectExpr("if(id % 3 = 0, id, 7L) as doc_id", "concat('w', id % 5) as text", "id as start")
    rows = sorted(TokenFiles(PATH).run(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and len(rows) == 600
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
