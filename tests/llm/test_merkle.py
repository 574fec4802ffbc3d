"""Merkle manifests against a plain recursive tree and against SQL."""

import hashlib
import zlib

import pytest
from compare import connect, difference

from domicilia.llm.merkle import ORACLE, MerkleManifest


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, more=0):
    n = None if row.n_chars is None else row.n_chars + more
    values = [row.doc_id, row.source, row.lang, n, row.text]
    return _hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(nodes):
    """Root, and for each leaf its siblings as (other, whether it stands left)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            if i ^ 1 < len(nodes):
                paths[k].append((nodes[i ^ 1], bool(i & 1)))
            else:
                paths[k].append((None, False))
        at = [i >> 1 for i in at]
        nodes = [_hash(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return nodes[0], paths


def _expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row.lang, []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, _leaf(r)))
    trees = {g: _tree([_leaf(r) for r in groups[g]]) for g in order}
    root, tops = _tree([trees[g][0] for g in order])
    for g, top in zip(order, tops, strict=True):
        for row, path in zip(groups[g], trees[g][1], strict=True):
            whole = path + top
            hit = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 0
            node = _leaf(row, int(hit))
            for other, left in whole:
                node = _hash(*([node] if other is None else [other, node] if left else [node, other]))
            yield row.doc_id, _leaf(row), trees[g][0], root, _hash(*[o for o, _ in whole if o]), node, node == root


def _sorted(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("bits", [2, 10])
def test_hard_rows(docs, bits):
    got = MerkleManifest(bits=bits).run(docs).collect()
    assert _sorted(map(tuple, got)) == _sorted(_expected(docs.collect()))


def test_many_groups_and_a_hot_one(spark):
    rows = [(k, f"text {k}", "hot" if k % 3 else f"g{k % 40}", "s", None if k % 5 == 0 else k) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = MerkleManifest(bits=5).run(docs).collect()
    assert _sorted(map(tuple, got)) == _sorted(_expected(docs.collect()))
    assert any(r.verified != (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in got)  # NULLs stay


def test_one_row_and_none(docs, no_docs):
    one = docs.filter("doc_id = 1")
    row = MerkleManifest().run(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == _hash("")
    assert MerkleManifest().run(no_docs).collect() == []
    assert MerkleManifest().versions(no_docs).collect() == []


def test_versions_copy_ancestors_only(docs):
    operator = MerkleManifest(bits=1)
    rows = {r.doc_id: r for r in operator.run(docs).collect()}
    versions = operator.versions(docs).collect()
    assert versions and all(zlib.crc32(str(v.doc_id).encode()) % 7 == 0 for v in versions)
    for v in versions:
        assert v.copies[-1] == rows[v.doc_id].folded_root
        assert (v.copies[0] == rows[v.doc_id].leaf) == rows[v.doc_id].verified


def test_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert difference(MerkleManifest(bits=6).run(docs), connect(sf_dir), ORACLE) is None
