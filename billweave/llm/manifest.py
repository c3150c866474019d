"""Merkle manifest of a table, with a witness for each row.

Rows become leaves; the leaves of one group form a tree of runs of sixteen, the roots of the groups form
another. Leaves are appended in aligned blocks: a block is a stream of leaves of one task, in which each open
subtree keeps the partial witnesses of its leaves, and every sibling that completes later extends them. The root of
a block is itself a leaf of the next round of appends, until one node is left; a leaf's witness is the one of its
block's stream, followed by that of the block's root. No task sees more than one block, whatever a group's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from billweave.llm.tables import BATCH_ROWS, stored, work_folder

RUN = 16
BLOCK_LEVELS = 3
BLOCK = RUN ** BLOCK_LEVELS

Store = Callable[[DataFrame, str], DataFrame]


def node_digest(children: Iterable[bytes]) -> bytes:
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


class Stream:
    """Aligned append of leaves to a tree of given height.

    ``open[level]`` is the run that is being filled: its nodes and the leaves below each. A new
    node takes over the digests of the nodes before it in its run, and each leaf below those
    gets the new digest, so witnesses grow from left to right and are whole when the run ends.
    """

    def __init__(self, levels: int):
        self.levels, self.root = levels, None
        self.open: list[list[tuple[bytes, list[int]]]] = [[] for _ in range(levels)]
        self.witnesses: list[bytearray] = []

    def append(self, leaf: bytes) -> None:
        self.witnesses.append(bytearray())
        self._add(0, leaf, [len(self.witnesses) - 1])

    def _add(self, level: int, digest: bytes, below: list[int]) -> None:
        if level == self.levels:
            self.root = digest
            return
        run = self.open[level]
        before = b"".join([d for d, _ in run])
        for leaf in below:
            self.witnesses[leaf] += before
        for _, earlier in run:
            for leaf in earlier:
                self.witnesses[leaf] += digest
        run.append((digest, below))
        if len(run) == RUN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._add(level + 1, node_digest(d for d, _ in run), [leaf for _, below in run for leaf in below])

    def close(self) -> bytes:
        """End the runs that are still open, lowest first, and return the root."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.root


def folded(digest: bytes, position: int, n: int, witness: bytes) -> tuple[bytes, int]:
    """Root that a leaf and its siblings give, and the bytes of the witness that were used."""
    at = 0
    while n > 1:
        first = position - position % RUN
        size = 32 * (min(RUN, n - first) - 1)
        siblings, own = witness[at:at + size], 32 * (position - first)
        digest = hashlib.sha256((siblings[:own].hex() + digest.hex() + siblings[own:].hex()).encode()).digest()
        at, position, n = at + size, position // RUN, -(-n // RUN)
    return digest, at


def block_stream(digests: list[bytes], n: int) -> Stream:
    stream = Stream(BLOCK_LEVELS if n > BLOCK else height(n))
    for digest in digests:
        stream.append(digest)
    stream.close()
    return stream


def leaf_text(values: list[Column]) -> Column:
    """Each value as its UTF-8 byte count, a colon and the value; a dash for null."""
    return F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
                      for v in (v.cast("string") for v in values)])


def with_position(df: DataFrame, group: list[str], order: list[str], keep: Store, name: str) -> DataFrame:
    """Adds ``position`` of each row in its group and ``n``, the group's rows; nulls come first.

    Rows are sorted by ranges of (group, order), so one group may lie in many ranges; each range counts its
    rows of a group, and only these counts are summed. ``order`` has to tell rows apart for them to be dealt evenly.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    ranges = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = keep(ranges.withColumn("_row", F.monotonically_increasing_id()), f"{name}-sorted")
    placed = placed.withColumn("_range", F.shiftright("_row", 33))
    counts = placed.groupBy(*group, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_in"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("n"))
    starts = keep(starts, f"{name}-starts")
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    return placed.join(starts, [*same, F.col("_range") == F.col("_in")]).select(
        *df.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias("position"), "n")


def by_block(rows: DataFrame, function: Callable[[list[dict]], list[dict]], schema: StructType) -> DataFrame:
    """Apply a function to the rows of each (tree, block), in the order of ``position``. Blocks follow one another in a
    task, so small trees cost little; a task holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made, key = [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                own = row["tree"], row["block"]
                if held and own != key:
                    made += function(held)
                    held = []
                    if len(made) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(made, schema=arrow)
                        made = []
                key = own
                held.append(row)
        yield pa.RecordBatch.from_pylist(made + (function(held) if held else []), schema=arrow)

    arrow = to_arrow_schema(schema)
    sorted_rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")
    return sorted_rows.mapInArrow(run, schema)


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("position") / BLOCK))


def tree_levels(nodes: DataFrame, keep: Store, name: str) -> list[DataFrame]:
    """Rounds of appends over ``tree, position, n, digest``: the given nodes, the roots of their blocks,
    the roots of blocks of those, and so on until each tree has one node."""

    def root(rows: list[dict]) -> list[dict]:
        n = rows[0]["n"]
        return [{"tree": rows[0]["tree"], "position": rows[0]["block"], "n": -(-n // BLOCK),
                 "digest": block_stream([r["digest"] for r in rows], n).root}]

    levels, columns = [nodes], ["tree", "position", "n", "digest"]
    schema = nodes.select(columns).schema
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1 or len(levels) == 1:
        levels.append(keep(by_block(in_blocks(levels[-1].select(columns)), root, schema), f"{name}-level-{len(levels)}"))
    return levels


def witnesses(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``tree, position, n, digest, witness`` of the nodes of one round; ``above`` has the witness of each block's
    root, which comes first among the rows of the block."""

    def extended(rows: list[dict]) -> list[dict]:
        upper, *rows = rows
        stream = block_stream([r["digest"] for r in rows], rows[0]["n"])
        return [{"tree": r["tree"], "position": r["position"], "n": r["n"], "digest": r["digest"],
                 "witness": bytes(w) + upper["witness"]} for r, w in zip(rows, stream.witnesses, strict=True)]

    nodes = nodes.select("tree", "position", "n", "digest")
    heads = above.select("tree", F.col("position").alias("block"), F.lit(-1).cast("long").alias("position"), "witness")
    return by_block(in_blocks(nodes).unionByName(heads, allowMissingColumns=True), extended,
                    StructType([*nodes.schema.fields, StructField("witness", BinaryType())]))


def witnesses_above(levels: list[DataFrame], keep: Store, name: str) -> DataFrame:
    """Witnesses of the roots of the lowest blocks, from the single nodes downwards."""
    known = levels[-1].select("tree", "position", "n", "digest", F.lit(b"").alias("witness"))
    for at in range(len(levels) - 2, 0, -1):
        known = keep(witnesses(levels[at], known), f"{name}-above-{at}")
    return known


def merkle_manifest(
    df: DataFrame, id_column: str = "doc_id", group: str = "source", text: str = "text",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None,
) -> DataFrame:
    """Leaf, roots and proof of each row of a table.

    ``columns`` make up a leaf. Rows of a group ascend by id (null first; of equal ids by leaf digest, and equal rows
    are interchangeable); groups ascend by the bytes of their name, null first. ``tampered``, a condition
    on the rows, picks those whose proof is checked with A-Z of ``text`` lower-cased. Result:
    ``id_column``, ``group``, ``leaf``, ``subroot``, ``root``, ``proof`` (siblings' digests from the leaf up, 32 bytes each),
    ``proof_sha256``, ``folded_root``, ``verified``. Null values count as stated in ``leaf_text``; a null id is never tampered with
    by a null condition; a long text is hashed where it lies; repeated rows each get their own place; an empty table
    gives an empty result; further columns are left out, whatever their names.
    """
    spark = df.sparkSession
    folder = work_folder(spark, "manifest")

    def keep(made: DataFrame, name: str) -> DataFrame:
        return stored(made, folder, name)

    lower = F.translate(F.col(f"`{text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def leaf(value: Column) -> Column:
        return F.unhex(F.sha2(leaf_text([value if c == text else F.col(f"`{c}`") for c in columns]), 256))

    changed = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    hashed = df.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{group}`").alias("tree"),
        leaf(F.col(f"`{text}`")).alias("digest"),
        F.when(changed, leaf(lower)).alias("other"),
        F.monotonically_increasing_id().alias("tie"))
    leaves = keep(with_position(keep(hashed, "leaves"), ["tree"], ["id", "digest", "tie"], keep, "leaf").drop("tie"), "nodes")
    levels = tree_levels(leaves, keep, "leaf")
    trees = with_position(levels[-1].select(F.lit(0).alias("top"), F.col("tree").alias("name"), F.col("digest")),
                          [], ["name"], keep, "tree")
    trees = keep(trees.select(F.col("top").alias("tree"), "position", "n", "digest", "name"), "trees")
    top = tree_levels(trees, keep, "tree")
    root = top[-1].select("tree", F.col("digest").alias("root"))
    over = witnesses(trees.select("tree", "position", "n", "digest"), witnesses_above(top, keep, "tree"))
    over = over.select("tree", "position", F.col("witness").alias("over"), F.col("n").alias("n_trees"))
    groups = keep(trees.join(over, ["tree", "position"]).join(root, "tree").select(
        F.col("name").alias("group"), F.col("position").alias("place"), "n_trees", "over", "digest", "root"), "groups")
    blocks = witnesses_above(levels, keep, "leaf").select("tree", "position", "witness")
    blocks = blocks.join(groups, F.col("tree").eqNullSafe(F.col("group"))).select(
        "tree", F.col("position").alias("block"), F.lit(-1).cast("long").alias("position"), "witness", "over", "place",
        "n_trees", F.col("digest").alias("subroot"), "root")

    def proofs(rows: list[dict]) -> list[dict]:
        up, *rows = rows
        stream = block_stream([r["digest"] for r in rows], rows[0]["n"])
        tail, made = up["witness"] + up["over"], []
        for row, own in zip(rows, stream.witnesses, strict=True):
            proof = bytes(own) + tail
            subroot, used = folded(row["other"] or row["digest"], row["position"], row["n"], proof)
            made.append({
                "id": row["id"], "tree": row["tree"], "leaf": row["digest"].hex(), "subroot": up["subroot"].hex(),
                "root": up["root"].hex(), "proof": proof, "proof_sha256": node_digest([proof]).hex(),
                "folded_root": folded(subroot, up["place"], up["n_trees"], proof[used:])[0].hex()})
        return made

    strings = [StructField(name, StringType()) for name in ("leaf", "subroot", "root")]
    schema = StructType([leaves.schema["id"], leaves.schema["tree"], *strings, StructField("proof", BinaryType()),
                         StructField("proof_sha256", StringType()), StructField("folded_root", StringType())])
    rows = by_block(in_blocks(leaves).unionByName(blocks, allowMissingColumns=True), proofs, schema)
    return rows.withColumn("verified", F.col("folded_root") == F.col("root")).select(
        F.col("id").alias(id_column), F.col("tree").alias(group), "leaf", "subroot", "root", "proof", "proof_sha256",
        "folded_root", "verified")
