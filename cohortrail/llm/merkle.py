"""Merkle manifest of a dataset: a tree per source over its documents, and one over the sources.

A leaf is the SHA-256 of a document's fields. Per source, leaves ascend by id; every ``16``
consecutive nodes become the SHA-256 of their concatenated digests (as hex text) until one is left,
the subroot. Subroots in the order of their sources are joined to the root in the same way.

Nodes are numbered from counts of range partitions, so no task sorts a whole source. Each aligned
block of 4,096 nodes is one row that holds its levels as strings of hex digits, 64 to a digest:
the next level of a block are the hashes of its substrings of 1,024 digits, at most three levels up.
What is left of a block is a node of the next tier, where blocks are formed again, until every
source is one block, and the subroots go the same way. A node's siblings on a level are the two
substrings beside its own 64 digits within its run. On the way down every block gives each of its
nodes the sibling substrings on all levels above, so a leaf is folded to the root in its own row.

All is done by DataFrame functions. The largest row holds a block and its proofs, about 12 MB on
the way down, whatever the size of a source. A source with a third of all documents is many blocks.

Awkward input: a null field is hashed as ``-``, an empty one as ``0:``, so the two differ. Rows
with a null id come first in their source. Rows that repeat an id are leaves of their own, ordered
by their digests; equal rows are equal leaves in any order, and each is returned. A source of one
document is its own subroot, a single source's subroot is the root. An empty table gives an empty
result. Other columns than the five of a leaf are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortrail.llm.shared import Store

#: Children of a node, hex digits of a digest, levels and nodes of a block.
FAN, DIGITS, LEVELS = 16, 64, 3
BLOCK = FAN**LEVELS
#: The order of its fields is part of a leaf.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_HEX = "binary"
_SIDES = f"array<struct<left:{_HEX},right:{_HEX}>>"


def digest(value: Column) -> Column:
    """Lower-case hex SHA-256 as bytes, whose substrings are cut in constant time."""
    return F.sha2(value.cast(_HEX), 256).cast(_HEX)


def _field(value: Column) -> Column:
    """A value with its length in front, or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields."""
    return digest(F.concat(*[_field(f) for f in fields]))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(nodes: DataFrame, tree: str, order: list[str], store: Store) -> DataFrame:
    """``nodes`` with ``place``, the position from 0 within the tree, and ``total``, its nodes.

    Rows are ranged over partitions by tree and order, with a number of the row behind them so that
    equal rows are spread, too. A row's place is its place in its partition and the number of rows
    of its tree in earlier ones.
    """
    spread = nodes.withColumn("row", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(tree, *order, "row").withColumn("part", F.spark_partition_id())
    ranged = store.keep(ranged)
    counts = ranged.groupBy(F.col(tree).alias("of_tree"), F.col("part").alias("of_part")).agg(
        F.count("*").alias("n")
    )
    trees = Window.partitionBy("of_tree")
    earlier = trees.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "of_tree",
        "of_part",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(trees).alias("total"),
    )
    inside = F.row_number().over(Window.partitionBy(tree, "part").orderBy(*order, "row"))
    placed = ranged.withColumn("inside", inside - 1).join(
        offsets, (F.col(tree) == F.col("of_tree")) & (F.col("part") == F.col("of_part"))
    )
    place = (F.col("before") + F.col("inside")).alias("place")
    return placed.select(*nodes.columns, place, "total")


def _runs(level: Column) -> Column:
    """How many parents a level's digests have."""
    return F.ceil(F.octet_length(level) / (FAN * DIGITS)).cast("int")


def _parents(level: Column) -> Column:
    """The next level: the hash of every 1,024 digits, concatenated."""
    parts = F.transform(
        F.sequence(F.lit(0), _runs(level) - 1),
        lambda k: F.sha2(F.substring(level, k * (FAN * DIGITS) + 1, F.lit(FAN * DIGITS)), 256),
    )
    return F.array_join(parts, "").cast(_HEX)


def blocks(nodes: DataFrame, tree: str, carried: list[str]) -> DataFrame:
    """One row per tree and aligned block of nodes (``node``: the digest).

    ``members`` are the ``carried`` columns of its nodes in order, ``level0`` to ``level3`` its
    levels (null above the subroot), ``top`` the last of them and ``total`` the blocks of the tree.
    """
    block = F.floor(F.col("place") / BLOCK).cast("bigint")
    held = F.struct("place", "node", *carried)
    rows = nodes.groupBy(tree, block.alias("block"), "total").agg(
        F.sort_array(F.collect_list(held)).alias("members")
    )
    rows = rows.withColumn(
        "level0", F.array_join(F.transform("members", lambda m: m["node"].cast("string")), "").cast(_HEX)
    )
    for k in range(LEVELS):
        # Below the top of a small tree a level has several nodes, in a large one any block goes on.
        goes_on = (F.col("total") > BLOCK) | (F.octet_length(f"level{k}") > DIGITS)
        rows = rows.withColumn(f"level{k + 1}", F.when(goes_on, _parents(F.col(f"level{k}"))))
    levels = [f"level{k}" for k in range(LEVELS, -1, -1)]
    more = F.ceil(F.col("total") / BLOCK).cast("bigint")
    return rows.withColumn("top", F.coalesce(*levels)).withColumn("total", more)


def _siblings(place: Column) -> Column:
    """The substrings beside a node's digest and its ancestors' on the levels of its block."""
    sides = []
    for k in range(LEVELS):
        level = F.col(f"level{k}")
        at = F.shiftright(place, 4 * k)
        first = at - at % FAN
        left = F.substring(level, first * DIGITS + 1, (at - first) * DIGITS)
        right = F.substring(level, (at + 1) * DIGITS + 1, (first + FAN - 1 - at) * DIGITS)
        side = F.struct(left.alias("left"), right.alias("right"))
        sides.append(F.when(F.col(f"level{k + 1}").isNotNull(), side))
    return F.array_compact(F.array(*sides))


def fold(node: Column, sides: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(sides, node, lambda at, s: digest(F.concat(s["left"], at, s["right"])))


def proof_of(sides: Column) -> Column:
    """The siblings on all levels, left to right, in one string."""
    return F.array_join(
        F.transform(sides, lambda s: F.concat(s["left"], s["right"]).cast("string")), ""
    )


class Tiers:
    """The tiers of a set of trees: blocks of nodes, then of what is left of them."""

    def __init__(self, nodes: DataFrame, tree: str, carried: list[str], store: Store):
        """``nodes`` has tree, place, total, node and the ``carried`` columns."""
        self.tree, self.store = tree, store
        self.rows = [store.keep(blocks(nodes, tree, carried))]
        while self.rows[-1].where("total > 1").limit(1).count():
            upper = self.rows[-1].where("total > 1").select(
                tree, F.col("block").alias("place"), "total", F.col("top").alias("node")
            )
            self.rows.append(store.keep(blocks(upper, tree, [])))

    def tops(self) -> DataFrame:
        """tree and its last node."""
        parts = [t.where("total = 1").select(self.tree, F.col("top").alias("node")) for t in self.rows]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out

    def descend(self, above: DataFrame) -> DataFrame:
        """One row per node of the first tier: tree, its member, and from ``above`` (tree, sides and
        more columns) the sides on all levels above it and the other columns."""
        more = [c for c in above.columns if c not in (self.tree, "sides")]
        known = above.withColumnRenamed(self.tree, "of_tree")
        blocks_above = None
        for tier in reversed(self.rows):
            ends = tier.where("total = 1").join(known, F.col(self.tree) == F.col("of_tree"))
            rows = ends.select(*tier.columns, "sides", *more)
            if blocks_above is not None:
                inner = tier.where("total > 1").join(
                    blocks_above,
                    (F.col(self.tree) == F.col("of_tree")) & (F.col("block") == F.col("of_block")),
                )
                rows = rows.unionAll(inner.select(*tier.columns, "sides", *more))
            own = F.transform(
                "members",
                lambda m: F.struct(
                    m.alias("member"), _siblings((m["place"] % BLOCK).cast("int")).alias("own")
                ),
            )
            nodes = rows.select(self.tree, F.explode(own).alias("at"), "sides", *more).select(
                self.tree,
                F.col("at.member").alias("member"),
                F.concat("at.own", "sides").alias("sides"),
                *more,
            )
            blocks_above = nodes.select(
                F.col(self.tree).alias("of_tree"), F.col("member.place").alias("of_block"), "sides", *more
            )
        return nodes


def manifest(docs: DataFrame, tampered_text: Column, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    ``folded_root`` is computed from the document with ``tampered_text`` where ``tampered`` holds,
    and from its own leaf elsewhere, with the original siblings.
    """
    store = Store(docs.sparkSession, "merkle")
    ints = {"doc_id", "n_chars"}
    fields = {c: F.col(c).cast("bigint") if c in ints else F.col(c) for c in LEAF_FIELDS}
    altered = {**fields, "text": tampered_text}
    leaves = docs.select(
        # Null first and then bytewise, as Spark orders strings.
        F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("tree"),
        fields["doc_id"].alias("doc_id"),
        leaf(list(fields.values())).alias("node"),
        F.when(tampered, leaf(list(altered.values()))).alias("tampered"),
    )
    leaves = store.keep(leaves)
    documents = Tiers(
        numbered(leaves, "tree", ["doc_id", "node"], store), "tree", ["doc_id", "tampered"], store
    )
    subroots = store.keep(documents.tops()).select(
        F.lit("all").alias("dataset"), F.col("tree").alias("source"), "node"
    )
    sources = Tiers(
        numbered(subroots, "dataset", ["source"], store), "dataset", ["source"], store
    )
    roots = sources.tops().select(
        "dataset", F.array().cast(_SIDES).alias("sides"), F.col("node").alias("root")
    )
    of_source = store.keep(
        sources.descend(roots).select(
            F.col("member.source").alias("tree"), "sides", F.col("member.node").alias("subroot"), "root"
        )
    )
    proved = documents.descend(of_source)
    start = F.coalesce("member.tampered", "member.node")
    found = proved.select(
        F.col("member.doc_id").alias("doc_id"),
        F.col("member.node").cast("string").alias("leaf"),
        F.col("subroot").cast("string").alias("subroot"),
        F.col("root").cast("string").alias("root"),
        F.sha2(proof_of(F.col("sides")).cast(_HEX), 256).alias("proof_sha256"),
        fold(start, F.col("sides")).cast("string").alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
