"""Merkle manifest of a dataset as a persistent path-copying tree.

Leaves are hashed by Spark's own functions and numbered in each group by a distributed scan.
Runs of 2^bits leaves make aligned blocks; each block is one small task that builds its
subtree and stores all its nodes. Block roots are the leaves of the next, 2^bits times
smaller level, and so on to one node a group; the groups' roots make one more tree. A
tampered leaf gives a version of the tree that shares every node with the original but the
ancestors of that leaf. Those are copied inside its block, and the copy goes on along the
block's path through the upper levels. A block's path is a row of a table with one row for
2^bits leaves, so no group meets in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domicilia.llm.tables import own, store
from domicilia.operators.joins import bounded_side, null_safe
from domicilia.operators.prefix import positions

_LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(parts: Sequence[bytes]) -> bytes:
    """sha256 of the digests in a row, each as lowercase hexadecimal text."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def levels_of(leaves: list[bytes], height: int) -> list[list[bytes]]:
    """The nodes of a tree from its leaves up, `height` levels more; a last single node is hashed alone."""
    levels = [leaves]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest(below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels


def siblings(levels: list[list[bytes]], index: int) -> list[bytes | None]:
    """The other node of the run at each level below the top, None where there is none."""
    found = []
    for nodes in levels[:-1]:
        other = index ^ 1
        found.append(nodes[other] if other < len(nodes) else None)
        index >>= 1
    return found


def copied(leaf: bytes, index: int, others: Sequence[bytes | None]) -> list[bytes]:
    """The ancestors of a changed leaf, from the lowest; all other nodes stay as they are."""
    nodes = []
    for other in others:
        leaf = digest([leaf] if other is None else [other, leaf] if index & 1 else [leaf, other])
        nodes.append(leaf)
        index >>= 1
    return nodes


def height_of(n: int) -> int:
    """Levels above n leaves."""
    return max(n - 1, 0).bit_length()


def leaf_digest(values: dict[str, Column]) -> Column:
    """sha256 of the values: `-` for NULL, else UTF-8 byte count, colon, value; hexadecimal."""
    parts = []
    for value in values.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


_BLOCK = "grp string, block long, size long, row array<long>, nodes array<array<binary>>, changed array<binary>, root binary"
_NODE = "grp string, position long, group_rows long, node binary"


@dataclass(frozen=True)
class MerkleManifest:
    """`bits`: a block has 2^bits leaves; `every`: rows whose crc32 of the id it divides are tampered with."""

    bits: int = 10
    every: int = 7

    def leaves(self, docs: DataFrame, **columns: str) -> DataFrame:
        """(doc_id, lang, node, changed): each row's digest, and the one after tampering, NULL for others.

        Tampering adds 1 to n_chars and leaves a NULL there; a NULL doc_id is never chosen.
        """
        rows = own(docs, **{c: columns.get(c, c) for c in _LEAF})
        values = {c: F.col(c) for c in _LEAF}
        # As a decimal, so that the largest long can be added to as well.
        more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
        chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % self.every == 0
        changed = F.when(chosen, F.unhex(leaf_digest(values | {"n_chars": more})))
        return rows.select("doc_id", "lang", F.unhex(leaf_digest(values)).alias("node"), changed.alias("changed"))

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        """Stored subtrees of aligned runs; a group of one block ends at its root, all others at full height."""
        bits = self.bits

        def build(table: pa.Table) -> pa.Table:
            table = table.sort_by("position")
            first, n = table["position"][0].as_py(), table["group_rows"][0].as_py()
            levels = levels_of(table["node"].to_pylist(), height_of(n) if n <= 1 << bits else bits)
            changed = table["changed"].to_pylist() if "changed" in table.column_names else []
            ids = table["doc_id"].to_pylist() if "doc_id" in table.column_names else []
            row = [table["grp"][0].as_py(), first >> bits, len(levels[0]), ids, levels, changed, levels[-1][0]]
            return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.binary())), pa.list_(pa.binary()), pa.binary()]
        schema = pa.schema(list(zip([c.split()[0] for c in _BLOCK.split(", ")], kinds, strict=True)))
        block = F.shiftright("position", bits).alias("block")
        return store(nodes.groupBy("grp", block).applyInArrow(build, _BLOCK))

    def _paths(self, nodes: DataFrame, most: int) -> DataFrame:
        """(grp, position, path, subroot): for each node its siblings from here to the root of its group."""
        if most <= 1:
            return nodes.select("grp", "position", F.expr("cast(array() as array<binary>)").alias("path"), F.col("node").alias("subroot"))
        blocks = self._blocks(nodes)
        upper = self._paths(self._roots(blocks, nodes), -(-most // (1 << self.bits)))
        bits = self.bits

        def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    n = row["size"]
                    paths = [siblings(row["nodes"], k) + row["path"] for k in range(n)]
                    at = [(row["block"] << bits) + k for k in range(n)]
                    columns = [[row["grp"]] * n, at, paths, [row["subroot"]] * n]
                    kinds = [pa.string(), pa.int64(), pa.list_(pa.binary()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["grp", "position", "path", "subroot"])

        joined = self._with_upper(blocks, upper).select("grp", "block", "size", "nodes", "path", "subroot")
        return store(joined.mapInArrow(unfold, "grp string, position long, path array<binary>, subroot binary"))

    def _roots(self, blocks: DataFrame, nodes: DataFrame) -> DataFrame:
        """Block roots as the nodes of the next level."""
        sizes = nodes.groupBy("grp").agg(F.expr(f"(max(group_rows) + {(1 << self.bits) - 1}) div {1 << self.bits}").alias("group_rows"))
        roots = blocks.select("grp", F.col("block").alias("position"), F.col("root").alias("node"))
        side = bounded_side(sizes.withColumnRenamed("grp", "_g"))
        sizes = F.broadcast(side.frame) if side.bounded else side.frame
        return store(roots.join(sizes, null_safe(roots, sizes, [("grp", "_g")])).drop("_g"))

    @staticmethod
    def _with_upper(blocks: DataFrame, upper: DataFrame) -> DataFrame:
        """Blocks with the path above them: a row for a block, so no key is hot."""
        renamed = upper.withColumnsRenamed({"grp": "_g", "position": "_p"})
        return blocks.join(renamed, null_safe(blocks, renamed, [("grp", "_g"), ("block", "_p")])).drop("_g", "_p")

    def trees(self, docs: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
        """The stored blocks, (grp, block, ...) with `path` and `subroot`, and (grp, path, subroot) of the groups' tree."""
        # Stored, so that texts are read and hashed once; dealing by ranges looks at its input twice.
        placed = positions(store(self.leaves(docs, **columns)), ["lang"], ["doc_id", "node"])
        nodes = store(placed.withColumnRenamed("lang", "grp"))
        most = nodes.agg(F.max("group_rows")).first()[0] or 0
        blocks = self._blocks(nodes)
        upper = self._paths(self._roots(blocks, nodes), -(-most // (1 << self.bits)))
        blocks = store(self._with_upper(blocks, upper))
        groups = blocks.filter("block = 0").select(F.col("grp").alias("lang"), F.col("subroot").alias("node"), F.lit("").alias("grp"))
        tops = store(positions(groups, ["grp"], ["lang"]))
        paths = self._paths(tops, tops.count()).withColumnsRenamed({"path": "top", "subroot": "whole"})
        named = tops.select("grp", "position", "lang").join(paths, ["grp", "position"])
        return blocks, named.select(F.col("lang").alias("grp"), F.col("position").alias("group_position"), "top", "whole")

    def run(self, docs: DataFrame, **columns: str) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of `docs`.

        `columns` may name other columns for doc_id, source, lang, n_chars and text. Leaves of a
        group (a lang; NULL is one) ascend by doc_id, NULL first, rows of one id by digest. A row's
        proof are its siblings up to the root. folded_root is the root of the version that
        tampering with the row made, the original root for others; verified says whether both agree,
        as they do for tampered rows without n_chars. An empty table gives an empty result.
        """
        return self._folded(docs, False, **columns)

    def versions(self, docs: DataFrame, **columns: str) -> DataFrame:
        """(doc_id, lang, position, copies): the version of each tampered row.

        `copies` are its new nodes from the leaf up to the root; all others are the original's.
        """
        return self._folded(docs, True, **columns)

    def _folded(self, docs: DataFrame, versions: bool, **columns: str) -> DataFrame:
        blocks, tops = self.trees(docs, **columns)
        side = bounded_side(tops.withColumnRenamed("grp", "_g"))
        tops = F.broadcast(side.frame) if side.bounded else side.frame
        rows = blocks.join(tops, null_safe(blocks, tops, [("grp", "_g")])).drop("_g", "root")
        bits = self.bits

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    yield _version_rows(row, bits) if versions else _proof_rows(row, bits)

        schema = _VERSION if versions else _PROOF
        return rows.mapInArrow(fold, schema)


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_VERSION = "doc_id long, lang string, position long, copies array<string>"


def _version(row: dict, k: int, bits: int, changed: bytes) -> tuple[list[bytes | None], list[bytes]]:
    """Siblings of leaf k of a block up to the root, and the nodes copied for a changed leaf."""
    inside = siblings(row["nodes"], k)
    lower = copied(changed, k, inside)
    at = row["block"]
    upper = copied(lower[-1] if lower else changed, at, row["path"])
    top = copied((upper or lower or [changed])[-1], row["group_position"], row["top"])
    return [*inside, *row["path"], *row["top"]], [changed, *lower, *upper, *top]


def _proof_rows(row: dict, bits: int) -> pa.RecordBatch:
    leaves, whole, subroot = row["nodes"][0], row["whole"], row["subroot"].hex()
    proofs, folded = [], []
    for k, (leaf, changed) in enumerate(zip(leaves, row["changed"], strict=True)):
        path, copies = _version(row, k, bits, leaf if changed is None else changed)
        proofs.append(digest([p for p in path if p is not None]).hex())
        folded.append(copies[-1])
    n = len(leaves)
    columns = [
        pa.array(row["row"], pa.int64()),
        pa.array([leaf.hex() for leaf in leaves]),
        pa.array([subroot] * n),
        pa.array([whole.hex()] * n),
        pa.array(proofs),
        pa.array([f.hex() for f in folded]),
        pa.array([f == whole for f in folded]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _version_rows(row: dict, bits: int) -> pa.RecordBatch:
    found = [k for k, changed in enumerate(row["changed"]) if changed is not None]
    copies = [[c.hex() for c in _version(row, k, bits, row["changed"][k])[1]] for k in found]
    columns = [
        pa.array([row["row"][k] for k in found], pa.int64()),
        pa.array([row["grp"]] * len(found), pa.string()),
        pa.array([(row["block"] << bits) + k for k in found], pa.int64()),
        pa.array(copies, pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "position", "copies"])


def _checksum_table() -> str:
    """SQL for the 256 steps of crc32 by byte, as one list."""
    step = "SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM ({})"
    sql = "SELECT i, i AS x FROM (SELECT unnest(range(256)) AS i)"
    for _ in range(8):
        sql = step.format(sql)
    return f"SELECT list(x ORDER BY i) AS steps FROM ({sql})"


def _tree_sql(leaves: str, name: str) -> str:
    """SQL for all nodes (grp, level, i, h, n) of the trees over `leaves` (grp, i, h, n)."""
    return (
        f"{name} AS (SELECT grp, 0 AS level, i, h, n FROM {leaves} UNION ALL SELECT grp, level + 1, i // 2,"
        f" sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY grp, level, i // 2)"
    )


def _leaf_sql(n_chars: str) -> str:
    texts = ["cast(doc_id AS VARCHAR)", "source", "lang", f"cast({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"


# For tables whose rows have distinct ids.
ORACLE = f"""
WITH RECURSIVE sums AS ({_checksum_table()}),
d AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars + 1")} AS more,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(cast(doc_id AS VARCHAR)) + 1),
    lambda k: ascii(substr(cast(doc_id AS VARCHAR), k::INT, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, steps[((xor(c, b) & 255) + 1)::INT])), 4294967295) % 7 = 0 AS hit FROM documents, sums),
base AS (SELECT doc_id, lang AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, leaf AS h,
  count(*) OVER (PARTITION BY lang) AS n, CASE WHEN hit THEN more ELSE leaf END AS changed FROM d),
{_tree_sql("base", "nodes")},
subroots AS (SELECT 0 AS grp, grp AS lang, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS i, h,
  count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree_sql("subroots", "tops")},
path AS (SELECT b.doc_id, v.level, (b.i >> v.level) & 1 AS bit, s.h FROM base b
  JOIN (SELECT grp, level, max(n) AS n FROM nodes GROUP BY grp, level) v ON v.grp IS NOT DISTINCT FROM b.grp AND v.n > 1
  LEFT JOIN nodes s ON s.grp IS NOT DISTINCT FROM b.grp AND s.level = v.level AND s.i = xor(b.i >> v.level, 1)
  UNION ALL SELECT b.doc_id, 1000 + v.level, (r.i >> v.level) & 1, s.h FROM base b JOIN subroots r ON r.lang IS NOT DISTINCT FROM b.grp
  JOIN (SELECT level, max(n) AS n FROM tops GROUP BY level) v ON v.n > 1
  LEFT JOIN tops s ON s.level = v.level AND s.i = xor(r.i >> v.level, 1)),
steps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k FROM path),
fold AS (SELECT doc_id, 1 AS k, changed AS h FROM base UNION ALL
  SELECT f.doc_id, f.k + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.bit = 1 THEN s.h || f.h ELSE f.h || s.h END)
  FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k),
ends AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM fold GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(coalesce(string_agg(h, '' ORDER BY k), '')) AS proof_sha256 FROM steps GROUP BY doc_id)
SELECT b.doc_id, b.h AS leaf, r.h AS subroot, t.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root,
  e.folded_root = t.h AS verified FROM base b JOIN subroots r ON r.lang IS NOT DISTINCT FROM b.grp
  JOIN (SELECT h FROM tops WHERE n = 1) t ON true JOIN ends e ON e.doc_id = b.doc_id LEFT JOIN proofs p ON p.doc_id = b.doc_id
"""
