"""Merkle manifest of a dataset: a postorder append log of 8-ary trees, and proofs from it.

Every group of rows (here: a language) is a tree over its rows in the order of their ids,
and the roots of the groups, in the order of the groups, are the leaves of one more tree.
Nodes are written in the order in which they are completed: a node follows the last of its
children at once. So the place of a node in the log follows from the sizes of the subtrees
before it (`position`), and a proof asks the log for siblings by their places alone.

Builders are aligned: one takes 8^3 = 512 neighbouring nodes of a level and completes what
lies above them, three levels up; the next tier does the same with what these left on top.
No builder needs another of its tier, a tree of n leaves takes log(n) / log(512) tiers, and a
group with all rows is spread over n / 512 builders. A builder that is lost is run again.

Proofs go down the same way: a tier adds the siblings of its three levels to the path of the
node above, so that a task holds 512 leaves, their 74 inner nodes and one path.

Hashes are lowercase hex SHA-256, and those of inputs that follow each other: a field is
`-` if null, else its length in UTF-8 bytes, a colon and its text.

Defined cases: null ids sort first; rows with the same id sort by their leaf, and rows that
are wholly alike are leaves side by side. A null group is a tree of its own and comes first.
A tree of one leaf is that leaf. Empty and very long texts are fields like any other. An
empty table has no tree and gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.llm.frames import map_rows, materialise
from worktide.llm.order import in_order, ranked

ARITY = 8
ARITY_BITS = 3
LEVELS = 3
BLOCK = ARITY**LEVELS

NODES = "nodes array<struct<pos:bigint,level:int,at:bigint,hash:string>>"


def hashed(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def width(leaves: int, level: int) -> int:
    """How many nodes a tree of so many leaves has on a level."""
    return -(-leaves // ARITY**level)


def height(leaves: int) -> int:
    level = 0
    while width(leaves, level) > 1:
        level += 1
    return level


def position(leaves: int, level: int, at: int) -> int:
    """The place in the log, from 0, of the node `at` of a level.

    When the node's last leaf has been appended, all nodes up to its level over the leaves so
    far are complete, and above it those that end before that leaf.
    """
    end = min((at + 1) * ARITY**level, leaves)
    here = sum(width(end, k) for k in range(level + 1))
    return here + sum((end - 1) // ARITY**k for k in range(level + 1, height(leaves) + 1)) - 1


def complete(hashes: list[str], first: int, base: int, leaves: int) -> list[tuple[int, int, int, str]]:
    """Nodes above `hashes`, neighbours on level `base` from number `first` on, as completed."""
    top = min(base + LEVELS, height(leaves))
    last = [width(leaves, level) - 1 for level in range(top + 1)]
    runs: dict[int, list[str]] = {level: [] for level in range(base, top)}
    done = []
    for number, value in enumerate(hashes, first):
        level, at = base, number
        while level < top:
            runs[level].append(value)
            if at % ARITY < ARITY - 1 and at < last[level]:
                break
            value = hashed(*runs[level])
            runs[level].clear()
            level, at = level + 1, at // ARITY
            done.append((position(leaves, level, at), level, at, value))
    return done


def siblings(known: dict[int, str], at: int, base: int, leaves: int) -> Iterator[tuple[str, str]]:
    """What stands before and after the node in its run, level by level up to the block's top."""
    for level in range(base, min(base + LEVELS, height(leaves))):
        start = at - at % ARITY
        run = range(start, min(start + ARITY, width(leaves, level)))
        found = [known[position(leaves, level, k)] for k in run]
        yield "".join(found[: at - start]), "".join(found[at - start + 1 :])
        at //= ARITY


@dataclass
class Forest:
    """`tiers[t]`: (tree, leaves, block, items, nodes, top, more), a row for each builder of tier t."""

    tiers: list[DataFrame]

    @property
    def log(self) -> DataFrame:
        """(tree, pos, level, at, hash): the append log of every tree, leaves included."""
        lowest = self.tiers[0].select("tree", "leaves", F.explode("items").alias("x"))
        place = F.lit(0).cast("long")
        # A leaf stands after all leaves and whole nodes before it; 8^21 leaves fill a long.
        for level in range(1, 22):
            place = place + F.shiftright("x.at", ARITY_BITS * level)
        out = lowest.select("tree", (F.col("x.at") + place).alias("pos"), F.lit(0).alias("level"), "x.at", "x.hash")
        for tier in self.tiers:
            out = out.unionByName(tier.select("tree", F.inline("nodes")))
        return out

    @property
    def roots(self) -> DataFrame:
        """(tree, hash)"""
        ends = [t.filter("NOT more").select("tree", F.col("top").alias("hash")) for t in self.tiers]
        out = ends[0]
        for more in ends[1:]:
            out = out.unionByName(more)
        return out


def _builders(nodes: DataFrame, base: int) -> DataFrame:
    """Nodes (tree, leaves, at, hash, more columns) of a level, dealt out and completed by 512."""
    rest = [c for c in nodes.columns if c not in ("tree", "leaves")]
    dealt = nodes.groupBy("tree", F.floor(F.col("at") / BLOCK).alias("block")).agg(
        F.first("leaves").alias("leaves"), F.array_sort(F.collect_list(F.struct(*rest))).alias("items"))
    kind = dealt.schema["items"].dataType.simpleString()

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for rows in batches:
            out = {**rows, "nodes": [], "top": [], "more": []}
            for items, leaves in zip(rows["items"], rows["leaves"]):
                done = complete([x["hash"] for x in items], items[0]["at"], base, leaves)
                out["nodes"].append([dict(zip(("pos", "level", "at", "hash"), x)) for x in done])
                out["top"].append(done[-1][3] if done else items[0]["hash"])
                out["more"].append(height(leaves) > base + LEVELS)
            yield out

    schema = f"tree string, block bigint, leaves bigint, items {kind}, {NODES}, top string, more boolean"
    return materialise(map_rows(dealt, work, schema))


def forest(leaves: DataFrame) -> Forest:
    """Trees over leaves (tree, leaves, at, hash, more columns); `at` runs from 0 in each tree."""
    tiers = [_builders(leaves.select("tree", "leaves", "at", *[c for c in leaves.columns if c not in
                                                               ("tree", "leaves", "at")]), 0)]
    while not (left := tiers[-1].filter("more")).isEmpty():
        above = left.select("tree", "leaves", F.col("block").alias("at"), F.col("top").alias("hash"))
        tiers.append(_builders(above, LEVELS * len(tiers)))
    return Forest(tiers)


def _paths(tier: DataFrame, base: int, above: DataFrame) -> DataFrame:
    """(tree, the items' columns, before, after, roots): siblings of every item up to the root.

    `above` has the paths (tree, at, before, after, roots) of the builders' tops.
    """
    upper = above.select("tree", F.col("at").alias("block"), F.col("before").alias("b"), F.col("after").alias("a"),
                         F.col("roots").alias("r"))
    both = tier.join(upper, ["tree", "block"])
    item = tier.schema["items"].dataType.elementType

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for rows in batches:
            for k, (items, leaves) in enumerate(zip(rows["items"], rows["leaves"])):
                known = {position(leaves, base, x["at"]): x["hash"] for x in items}
                known |= {x["pos"]: x["hash"] for x in rows["nodes"][k]}
                out = {"tree": [rows["tree"][k]] * len(items)} | {c: [x[c] for x in items] for c in item.names}
                steps = [list(siblings(known, x["at"], base, leaves)) for x in items]
                out["before"] = [[s[0] for s in step] + rows["b"][k] for step in steps]
                out["after"] = [[s[1] for s in step] + rows["a"][k] for step in steps]
                out["roots"] = [rows["r"][k]] * len(items)
                yield out

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in item.fields)
    return map_rows(both.select("tree", "block", "leaves", "items", "nodes", "b", "a", "r"), work,
                    f"tree string, {columns}, before array<string>, after array<string>, roots array<string>")


def proofs(trees: Forest, above: DataFrame | None = None) -> DataFrame:
    """(tree, the leaves' columns, before, after, roots): the hashes left and right of a leaf, by level.

    `above`: paths (tree, before, after, roots) of the trees' roots in a tree over them. `roots`
    has the root of each tree on the way.
    """
    none = F.array().cast("array<string>")
    down = None
    for k in reversed(range(len(trees.tiers))):
        tier = trees.tiers[k]
        ends = tier.filter("NOT more").select("tree", F.lit(0).cast("long").alias("at"), "top")
        ends = ends.join(above, "tree") if above is not None else ends.withColumns(
            {"before": none, "after": none, "roots": none})
        ends = ends.withColumn("roots", F.concat(F.array("top"), "roots")).drop("top")
        tops = ends if down is None else down.select("tree", "at", "before", "after", "roots").unionByName(ends)
        down = _paths(tier, k * LEVELS, tops)
        if k:
            down = materialise(down)
    return down


def folded(leaf: Column, before: str, after: str) -> Column:
    """The root that a leaf and its siblings give."""
    steps = F.arrays_zip(F.col(before).alias("b"), F.col(after).alias("a"))
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["b"], h, s["a"]), 256))


@dataclass
class Manifest:
    """A tree for every group, and one over their roots, whose leaves have the group's `name`."""

    groups: Forest
    top: Forest

    def with_proofs(self) -> DataFrame:
        """(tree, leaves' columns, before, after, subroot, root), a row for each leaf."""
        ways = proofs(self.top).select(F.col("name").alias("tree"), "before", "after", "roots")
        roots = F.col("roots")
        return proofs(self.groups, materialise(ways)).withColumns({"subroot": roots[0], "root": roots[1]}).drop("roots")


def manifest(rows: DataFrame) -> Manifest:
    """Trees over rows (tree, id, hash, more columns): by `id` in each tree, trees by their names."""
    placed = in_order(rows, "tree", "id", "hash")
    numbered = ranked(placed, "tree").withColumnRenamed("total", "leaves")
    groups = forest(numbered.drop("part", "seq"))
    roots = in_order(groups.roots.withColumns({"name": F.col("tree"), "tree": F.lit("")}), "tree", "name")
    return Manifest(groups, forest(ranked(roots, "tree").withColumnRenamed("total", "leaves").drop("part", "seq")))


def tree_name(group: Column) -> Column:
    """Sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
