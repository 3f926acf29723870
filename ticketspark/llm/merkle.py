"""Merkle manifest of a dataset: a persistent tree in aligned blocks, where a changed leaf copies only its ancestors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import placed
from .scratch import keep

#: Levels of a block: it holds the subtree over 2 ** BLOCK_LEVELS consecutive nodes.
BLOCK_LEVELS = 10
#: The group of the tree over all groups' roots.
TOP = ""

PACKED = "key string, block long, of long, names array<string>, ids array<long>, nodes binary, altered array<binary>, root binary"
#: A step of a path upwards: this byte, then the sibling's 32 bytes where there is one.
ALONE, LEFT, RIGHT = 0, 1, 2


def canonical(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes of the value as text, a colon and that text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the canonical values one after another."""
    return F.sha2(F.concat(*map(canonical, values)), 256)


def parent(*children: bytes) -> bytes:
    """Digest of one or two nodes' digests as hex text."""
    return sha256("".join([c.hex() for c in children]).encode()).digest()


class Block:
    """The subtree over the consecutive nodes of one block: levels[0] are the nodes, and each level above halves the one below.

    height levels stand above the nodes: as many as a whole block has where the
    group goes on beyond it, so that a short last block is as high as the others.
    """

    def __init__(self, nodes: list[bytes], height: int):
        self.levels = [nodes]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([parent(*below[i : i + 2]) for i in range(0, len(below), 2)])

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def path(self, slot: int) -> list[tuple[int, bytes]]:
        """Side and digest of the sibling at each level from a node up to the root of the block."""
        steps = []
        for level in self.levels[:-1]:
            other = slot ^ 1
            steps.append((ALONE, b"") if other >= len(level) else (RIGHT if other > slot else LEFT, level[other]))
            slot >>= 1
        return steps

    @staticmethod
    def version(node: bytes, path: list[tuple[int, bytes]]) -> list[bytes]:
        """Copies of a node's ancestors along a path, the root last, once the node is as given; all other nodes are shared."""
        copies = []
        for side, other in path:
            node = parent(node) if side == ALONE else parent(node, other) if side == RIGHT else parent(other, node)
            copies.append(node)
        return copies


def _coded(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join([bytes([side]) + other for side, other in path])


def _decoded(path: bytes) -> list[tuple[int, bytes]]:
    steps, i = [], 0
    while i < len(path):
        n = 0 if path[i] == ALONE else 32
        steps.append((path[i], path[i + 1 : i + 1 + n]))
        i += 1 + n
    return steps


def _split(nodes: bytes) -> list[bytes]:
    return [nodes[i : i + 32] for i in range(0, len(nodes), 32)]


def _height(of: int, levels: int) -> int:
    """Levels above the nodes of a block, where the group has of nodes on the block's lowest level."""
    return min(levels, (of - 1).bit_length())


def _packed(levels: int):
    """Nodes of one block, in any order, to its one row."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        key, block, of = (table.column(c)[0].as_py() for c in ("key", "block", "of"))
        nodes = table.column("node").to_pylist()
        row = {"key": [key], "block": [block], "of": [of], "names": [table.column("name").to_pylist()], "ids": [table.column("id").to_pylist()], "nodes": [b"".join(nodes)]}
        row |= {"altered": [table.column("altered").to_pylist()], "root": [Block(nodes, _height(of, levels)).root]}
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.binary()]
        return pa.table([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

    return pack


def _paths(levels: int):
    """Blocks with the path above them to each node's own path up to the root: key, place, name, node, path, subroot."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = _split(row["nodes"])
                block = Block(nodes, _height(row["of"], levels))
                n = len(nodes)
                yield pa.record_batch([
                    pa.array([row["key"]] * n), pa.array([(row["block"] << levels) + i for i in range(n)], pa.int64()), pa.array(row["names"], pa.string()), pa.array(nodes, pa.binary()),
                    pa.array([_coded(block.path(i)) + row["path"] for i in range(n)], pa.binary()), pa.array([row["subroot"]] * n, pa.binary()),
                ], ["key", "place", "name", "node", "path", "subroot"])

    return paths


def _leaves(levels: int, with_copies: bool):
    """Blocks of leaves with the path above them to a row for each leaf, as merkle_manifest returns it."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes, above = _split(row["nodes"]), _decoded(row["path"])
                block = Block(nodes, _height(row["of"], levels))
                out: dict[str, list] = {c: [] for c in ("proof", "folded", "copies")}
                for i, (leaf, altered) in enumerate(zip(nodes, row["altered"], strict=True)):
                    path = block.path(i) + above
                    node = leaf if altered is None else altered
                    copies = Block.version(node, path)
                    out["proof"].append(sha256("".join([other.hex() for _, other in path]).encode()).hexdigest())
                    out["folded"].append((copies[-1] if copies else node).hex())
                    out["copies"].append([x.hex() for x in copies] if with_copies and altered is not None else None)
                n = len(nodes)
                columns = [pa.array(row["ids"], pa.int64()), pa.array([x.hex() for x in nodes]), pa.array([x is not None for x in row["altered"]]), pa.array([row["subroot"].hex()] * n)]
                columns += [pa.array(out["proof"]), pa.array(out["folded"]), pa.array(out["copies"], pa.list_(pa.string()))]
                yield pa.record_batch(columns, ["id", "leaf", "altered", "subroot", "proof_sha256", "folded_root", "copied_nodes"])

    return leaves


@dataclass
class Tree:
    """Tiers of written blocks, the lowest first; the root of each group is the root of its one block on the tier where its nodes fit in one."""

    tiers: list[DataFrame]
    levels: int

    def roots(self) -> DataFrame:
        """(key, root) of each group."""
        one = 1 << self.levels
        parts = [t.where(F.col("of") <= one).select("key", "root") for t in self.tiers]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def below(self, tops: DataFrame) -> DataFrame:
        """Blocks of the lowest tier with path and subroot; tops has those (key, path, subroot) for each group's root."""
        one = 1 << self.levels
        above = None
        for i, tier in reversed(list(enumerate(self.tiers))):
            last = tier.where(F.col("of") <= one).select("key", "block").join(tops, "key")
            paths = last if above is None else last.unionByName(above)
            blocks = tier.join(paths, ["key", "block"])
            if not i:
                return blocks
            # a block's nodes are the blocks of the tier below
            above = keep(blocks.mapInArrow(_paths(self.levels), "key string, place long, name string, node binary, path binary, subroot binary"), "paths").select("key", F.col("place").alias("block"), "path", "subroot")
        raise AssertionError


def tree(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> Tree:
    """The tree of each group of nodes (key, place, of, name, id, node, altered), whose places count from 0 to of - 1.

    2 ** levels consecutive nodes are a block, one row worked out by one task
    whatever the size of its group; the blocks' roots are the nodes of the next
    tier, until each group has one root.
    """
    tiers = []
    while True:
        grouped = nodes.withColumn("block", F.shiftright("place", levels)).groupBy("key", "block")
        tiers.append(keep(grouped.applyInArrow(_packed(levels), PACKED), "blocks"))
        more = tiers[-1].where(F.col("of") > (1 << levels))
        if not more.limit(1).count():
            return Tree(tiers, levels)
        none = {"name": F.lit(None).cast("string"), "id": F.lit(None).cast("long"), "altered": F.lit(None).cast("binary")}
        nodes = more.select("key", F.col("block").alias("place"), F.shiftright(F.col("of") + (1 << levels) - 1, levels).alias("of"), F.col("root").alias("node")).withColumns(none)


def merkle_manifest(rows: DataFrame, levels: int = BLOCK_LEVELS, with_copies: bool = False) -> DataFrame:
    """A row for each leaf of rows (group, id, leaf, altered): id, leaf, altered, subroot, root, proof_sha256, folded_root, copied_nodes.

    leaf is a digest in hex, altered another one for a changed leaf or null. The
    leaves of a group ascend by id; two consecutive nodes become their digest, a last
    one alone becomes its own, until one remains, the group's subroot. Subroots,
    by group in order of UTF-8 bytes with null first, become root in the same way.
    proof_sha256 is the digest of all siblings from the leaf up to root. For a changed
    leaf a version of the tree is made by copying the path: its ancestors in the
    leaf's block are new nodes, all others are shared with the original, and
    the version goes on along the block's path through the tiers above. folded_root
    is the version's root (for other leaves the root worked out along the same
    path), and copied_nodes, with with_copies, its new nodes from the leaf's parent to the root.

    A group of any size is dealt by places over blocks, and each block is one row.
    The driver gathers nothing but the root.

    A group null is one of its own. A null id comes first in its group; rows of
    equal ids are ordered by leaf, then altered, and each is a leaf. Without rows there are no leaves. Other columns are ignored.
    """
    key = F.when(F.col("group").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("group").cast("string")))
    leaves = keep(rows.select(key.alias("key"), F.col("id").cast("long").alias("id"), F.unhex("leaf").alias("node"), F.unhex("altered").alias("altered")), "leaves")
    at = placed(leaves, "key", [F.asc_nulls_first("id"), F.asc("node"), F.asc_nulls_first("altered")], "placed")
    trees = tree(at.select("key", F.col("__place").alias("place"), F.col("__of").alias("of"), F.lit(None).cast("string").alias("name"), "id", "node", "altered"), levels)
    tops = placed(keep(trees.roots().select(F.lit(TOP).alias("top"), F.col("key").alias("name"), F.col("root").alias("node")), "subroots"), "top", [F.asc("name")], "tops")
    none = {"id": F.lit(None).cast("long"), "altered": F.lit(None).cast("binary")}
    upper = tree(tops.select(F.col("top").alias("key"), F.col("__place").alias("place"), F.col("__of").alias("of"), "name", "node").withColumns(none), levels)
    root = upper.roots().select(F.lower(F.hex("root"))).first()
    start = rows.sparkSession.createDataFrame([(TOP, b"", b"")], "key string, path binary, subroot binary")
    schema = "key string, place long, name string, node binary, path binary, subroot binary"
    paths = keep(upper.below(start).mapInArrow(_paths(levels), schema), "paths").select(F.col("name").alias("key"), "path", F.col("node").alias("subroot"))
    out = trees.below(paths).mapInArrow(_leaves(levels, with_copies), "id long, leaf string, altered boolean, subroot string, proof_sha256 string, folded_root string, copied_nodes array<string>")
    return out.withColumn("root", F.lit(root[0] if root else None).cast("string"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether the root still holds once some have another n_chars."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = d.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf_digest(*fields(F.col("n_chars"))).alias("leaf"), F.when(tampered, leaf_digest(*fields(F.col("n_chars") + 1))).alias("altered"))
    m = merkle_manifest(leaves)
    return m.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT doc_id, source, lang, n_chars, text,
    flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: list_transform(range(8), lambda k: (ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) >> k) & 1))) AS bits
  FROM documents
),
d AS (
  SELECT *, xor(list_reduce(bits, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295), 4294967295) % 7 = 0 AS hit,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS a,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS z,
    CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS key
  FROM bits
),
l AS (
  SELECT key, doc_id, sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || z) AS leaf,
    CASE WHEN hit AND n_chars IS NOT NULL THEN sha256(a || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || z) END AS altered,
    row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY key) AS n
  FROM d
),
t(key, level, i, n, h) AS (
  SELECT key, 0, i, n, leaf FROM l
  UNION ALL SELECT key, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY key, level, i // 2, n
),
s AS (SELECT key, h AS subroot, row_number() OVER (ORDER BY encode(key)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, i, n, h) AS (
  SELECT 0, i, n, subroot FROM s
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 2, n
),
p(key, doc_id, level, i, n, h, proof) AS (
  SELECT key, doc_id, 0, i, n, coalesce(altered, leaf), '' FROM l
  UNION ALL
  SELECT p.key, p.doc_id, p.level + 1, p.i // 2, (p.n + 1) // 2, sha256(CASE WHEN p.i % 2 = 1 THEN coalesce(t.h, '') || p.h ELSE p.h || coalesce(t.h, '') END), proof || coalesce(t.h, '')
  FROM p LEFT JOIN t ON t.key = p.key AND t.level = p.level AND t.i = xor(p.i, 1) WHERE p.n > 1
),
q(key, doc_id, level, i, n, h, proof) AS (
  SELECT p.key, p.doc_id, 0, s.i, s.n, p.h, p.proof FROM p JOIN s USING (key) WHERE p.n = 1
  UNION ALL
  SELECT q.key, q.doc_id, q.level + 1, q.i // 2, (q.n + 1) // 2, sha256(CASE WHEN q.i % 2 = 1 THEN coalesce(u.h, '') || q.h ELSE q.h || coalesce(u.h, '') END), proof || coalesce(u.h, '')
  FROM q LEFT JOIN u ON u.level = q.level AND u.i = xor(q.i, 1) WHERE q.n > 1
)
SELECT q.doc_id, l.leaf, s.subroot, u.h AS root, sha256(q.proof) AS proof_sha256, q.h AS folded_root, q.h = u.h AS verified
FROM q JOIN l ON l.key = q.key AND l.doc_id IS NOT DISTINCT FROM q.doc_id JOIN s ON s.key = q.key JOIN u ON u.n = 1 WHERE q.n = 1
"""
