"""Merkle manifest of a dataset: a digest per row, a tree per group of rows, a tree over the groups.

A level of a tree is one hexadecimal string, 64 characters a node. Leaves are numbered within
their group and cut into aligned blocks of ``SPAN`` = 3^5 nodes, so no run of three ever lies in two
blocks: every block hashes its own levels, cutting parents out of the level below as substrings
of fixed width, and what flanks a node in its run is its sibling segment. The blocks' last nodes
are the leaves of the next round, until a group has one block; the groups' roots go through the
same rounds once more. Columns only; no task sees more than a block of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contentgauge.llm.common import store
from contentgauge.operators.skew import salted_join

FAN, LEVELS, WIDTH = 3, 5, 64
SPAN = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"
BLOCKS_PER_TASK = 20_000


def digest(*values: Column) -> Column:
    """SHA-256 of the fields: ``-`` for a null, else the UTF-8 byte count, ``:`` and the value."""
    def field(v: Column) -> Column:
        text = v.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``pos`` (from 0 within ``tree``, by ``order``) and ``total``, the tree's rows.

    Rows are dealt to sorted ranges of equal size whatever their tree, also where one tree or
    one id holds most of them; a row's place is its place in its range and the tree's rows in
    earlier ranges. That table has a row per tree and range.
    """
    keys = ["tree", *order, "_tie"]
    sorted_ = rows.withColumn("_tie", F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = store(sorted_.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = store(sizes.select(
        "tree", "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"),
        F.sum("_n").over(whole).alias("total")), f"{name}-ranges")
    joined = placed.join(sizes, ["tree", "_range"])
    return joined.withColumn("pos", F.col("_at") + F.col("_base")).drop("_at", "_range", "_base")


def _levels(first: Column, depth: Column) -> Column:
    """The level strings of a block, ``first`` and ``depth`` levels above it."""
    def above(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (FAN * WIDTH)).cast("int"))
        return F.array_join(F.transform(runs, lambda r: F.sha2(
            F.substring(level, r * (FAN * WIDTH) + 1, F.lit(FAN * WIDTH)), 256)), "")

    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(first), lambda out, _: F.concat(out, F.array(above(F.element_at(out, -1)))))


def _segments(levels: Column, i: Column) -> Column:
    """For node ``i`` of the first level: what stands left and right of its ancestors in their runs."""
    def segment(level: Column, k: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(float(FAN)), k)).cast("int")
        start = at - at % FAN
        return F.struct(
            F.substring(level, start * WIDTH + 1, (at - start) * WIDTH).alias("left"),
            F.substring(level, at * WIDTH + WIDTH + 1, (start + FAN - 1 - at) * WIDTH).alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), segment)


def _last(levels: Column) -> Column:
    return F.element_at(levels, -1)


def _rounds(nodes: DataFrame, item: list[str], most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, roots): nodes (tree, pos, total, digest, ``item``) in blocks (tree, block, items,
    levels, path, root), ``path`` leading from a block's last node to the root; roots (tree, root)."""
    span = F.lit(SPAN)
    packed = nodes.withColumn("block", F.expr(f"pos div {SPAN}")).groupBy("tree", "total", "block").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", *item))).alias("items"))
    depth = sum(((F.col("total") > FAN ** k).cast("int") for k in range(1, LEVELS)), (F.col("total") > 1).cast("int"))
    first = F.array_join(F.transform("items", lambda x: x["digest"]), "")
    blocks = store(packed.withColumn("levels", _levels(first, depth)), name)
    if most <= SPAN:
        done = blocks.select("*", F.array().cast(PATH).alias("path"), _last(F.col("levels")).alias("root"))
        return done, done.select("tree", "root")
    above = blocks.select(
        "tree", F.col("block").alias("pos"), F.ceil(F.col("total") / span).alias("total"), _last(F.col("levels")).alias("digest"))
    upper, roots = _rounds(above, [], -(-most // SPAN), name)
    paths = paths_of(upper, []).select("tree", F.col("pos").alias("block"), "path", "root")
    return blocks.join(paths, ["tree", "block"]), roots


def paths_of(blocks: DataFrame, item: list[str]) -> DataFrame:
    """(tree, pos, digest, ``item``, path, root): a row per node again."""
    rows = F.transform("items", lambda x, i: F.struct(
        x["pos"].alias("pos"), x["digest"].alias("digest"), *[x[c].alias(c) for c in item],
        F.concat(_segments(F.col("levels"), i), F.col("path")).alias("path")))
    keep = [c for c in blocks.columns if c not in ("total", "block", "items", "levels", "path")]
    return blocks.select(*keep, F.explode(rows).alias("_row")).select(*keep, "_row.*")


def manifest(
    docs: DataFrame, doc_id: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS,
    claimed: Column | None = None,
) -> DataFrame:
    """(doc_id, leaf, claimed, subroot, root, path) of every row.

    ``leaf`` is the digest of ``fields``; leaves ascend by ``doc_id`` (nulls first) within ``group`` (a
    null is a group of its own and the first), rows of the same id by digest, equal rows in any
    order. ``path`` holds the sibling segments from the leaf through the group's root to the
    root. ``claimed`` is a digest to be proved later, the leaf if not given. Columns that are not
    among the fields take no part; an empty table has an empty manifest.
    """
    claim = F.lit(None).cast("string") if claimed is None else claimed
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(doc_id).alias("doc_id"),
        digest(*[F.col(f) for f in fields]).alias("digest"), claim.alias("claimed"))
    # most claims are the leaf itself, which is not carried twice
    rows = rows.withColumn("claimed", F.when(F.col("claimed") != F.col("digest"), F.col("claimed")))
    leaves = numbered(rows, ["doc_id", "digest"], "manifest-leaves")
    blocks, roots = _rounds(leaves, ["doc_id", "claimed"], _most(leaves), "manifest-levels")
    groups = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest")),
                      ["group"], "manifest-groups")
    top, _ = _rounds(groups, ["group"], _most(groups), "manifest-top")
    top = paths_of(top, ["group"]).select(
        F.col("group").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("_up"), F.col("root").alias("_root"))
    joined = salted_join(blocks, store(top, "manifest-roots"), "tree", "block", per_task=BLOCKS_PER_TASK)
    joined = joined.withColumn("path", F.concat("path", "_up")).drop("root", "_up").withColumnRenamed("_root", "root")
    return paths_of(joined, ["doc_id", "claimed"]).select(
        "doc_id", F.col("digest").alias("leaf"), F.coalesce("claimed", "digest").alias("claimed"), "subroot", "root", "path")


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("total")).first()[0] or 0


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its sibling segments lead to."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def without_breaks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fields: tuple[str, ...] = FIELDS) -> Column:
    """The digest of a row whose text lost its line breaks, as a careless copy would, where 2
    divides the CRC-32 of the decimal id; of the row as it is elsewhere and for null ids."""
    struck = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains(F.col(text), F.lit("\n"))
    return F.when(struck, digest(*[F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == text else F.col(f) for f in fields]))
