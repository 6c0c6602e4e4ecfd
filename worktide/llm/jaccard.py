"""N-gram Jaccard join: groups of tokens, count vectors in an R-tree, exact verification.

The shingles of a document are hashed into groups, and the group counts make a point.
For two documents the sum of the smaller count of each group bounds their overlap from
above; an R-tree of such points finds the few pairs whose bound is high enough, and the
shingle sets of these are compared.

Which documents meet in a tree is decided by the same grouping. Sets that are similar
enough differ in at most D shingles, D following from their sizes, so of more than D
groups at least one is the same in both, shingle by shingle. Documents are keyed by the
content of each group, for the size bands they may have a partner in; this loses no
pair, and a group is some shingles, so unrelated documents hardly meet. A group without
shingles is the same in many of them: there are so many groups that sets fill more than D,
of which one is the same in both, and only the rare set that fills no more keys its empty ones.

1. Documents with equal sets are one class; its smallest id stands for it.
2. Classes that share a key are compared with the smallest of them: first each with the
   smallest it meets anywhere, then what is not joined yet. Their links already join most
   families, and there are at most as many as (key, class) rows.
3. Where a key still holds several components (one key of those with the same members), the R-tree search runs over its
   members, in blocks, for pairs from different components only. What passes the bound,
   and that by counts of finer groups, is compared. Afterwards no unlinked pair of different components is left to test.

Scale: everything is shuffled by key or id. Equal sets are keyed once per task. The rows of
a key are sorted and streamed in step 2, and cut into pairs of blocks in step 3; a set has
some hundred keys, so even a family of a third of all sets is a small part of each task's
rows. Components are found by contraction over written tables.

Defined cases: null or empty texts have an empty set and link with nothing. Fewer words
than a shingle has make one shingle. Rows that share an id must share their text or one
of them is taken; rows with a null id are left out of links and come back as their own
component, null. Repeated rows come back once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktide.llm.components import components
from worktide.llm.frames import capitals_free, discard, map_rows, materialise, named

BAND = 1.5  # ratio of the bounds of a size band
SPARE = 2  # groups beyond those needed, at least
LIKELY = 3  # standard deviations that the filled groups of a set may stay below the mean
DIMENSIONS = 64  # of the count vectors
BLOCK = 4096  # members of a key that meet in one task
LEAF = 16
STAR = 64  # sets that are compared with one set in one group

U64 = np.uint64


class WordHashes(dict):
    """Hash of a word, remembered while there are not too many of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(31))) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a whole text."""
    # bytes.split() cuts at exactly the blanks \x20 and \x09-\x0D.
    words = capitals_free(text).split() if text else []
    if not words:
        return np.empty(0, dtype=U64)
    ids = np.fromiter(map(hashes.__getitem__, words), dtype=U64, count=len(words))
    size = min(width, len(ids))
    out = np.full(len(ids) - size + 1, size, dtype=U64)
    for at in range(size):
        out = mix(out * U64(0x100000001B3) + ids[at : len(ids) - size + 1 + at])
    return np.unique(out)


@cache
def groups_for(least: int, differ: int) -> int:
    """Groups of which sets of `least` shingles or more, but for a few, fill more than `differ`.

    Up to four times as many as needed; in larger sets more groups are filled.
    """
    groups = differ + 1 + SPARE
    while groups < 4 * (differ + 1 + SPARE):
        load = least / groups
        empty = math.exp(-load)
        spread = math.sqrt(groups * empty * max(0.0, 1 - (1 + load) * empty))
        if groups * (1 - empty) - LIKELY * spread > differ:
            break
        groups += 1 + groups // 64
    return groups


class Rule:
    """Integer arithmetic of the threshold: links hold 100 * overlap >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def need(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least overlap of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def bands(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(lower bound, groups, most that a pair differs in) of every band that an n-set may meet a partner in.

        A pair meets in the band of its smaller set, with a set below `high` and one of
        at most high * 100 / percent: that bounds in how many shingles they differ.
        """
        low = 1
        while low <= n:
            high = max(low + 1, int(low * BAND))
            smallest = -(-self.percent * n // 100)
            if smallest < high:
                both = high - 1 + (high - 1) * 100 // self.percent
                differ = both * (100 - self.percent) // (100 + self.percent)
                if differ:  # else only equal sets link, and these are one class
                    yield low, groups_for(low, differ), differ
            low = high


def group_keys(tokens: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of the group contents of a set, for all its bands.

    Every shingle that two sets differ in spoils one group. A set that fills more groups than that
    has one in common with its partner; two that fill fewer have their empty groups keyed too.
    """
    keys = []
    spread = mix(tokens ^ U64(0xA5A5A5A5A5A5A5A5))
    for low, groups, differ in rule.bands(len(tokens)):
        group = (spread >> U64(20)) % U64(groups)
        order = np.argsort(group, kind="stable")
        present, starts = np.unique(group[order], return_index=True)
        content = np.add.reduceat(spread[order], starts)
        mark = U64(low * 1_000_003) + present * U64(0x9E3779B97F4A7C15)
        keys.append(mix(content ^ mix(mark)))
        if len(present) <= differ:
            empty = np.setdiff1d(np.arange(groups, dtype=U64), present)
            keys.append(mix(mix(U64(low * 1_000_003) + empty * U64(0x9E3779B97F4A7C15))))
    return np.concatenate(keys) if keys else np.empty(0, dtype=U64)


def count_vector(tokens: np.ndarray) -> bytes:
    """Counts of the groups, two bytes each, or four where a set is too large for that."""
    counts = np.bincount((tokens % U64(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS)
    return counts.astype(np.uint16 if counts.max() < 2**16 else np.int32).tobytes()


def fine_groups(n: int) -> int:
    """Groups for a set of n shingles: a power of two, of 4 to 8 shingles each."""
    return max(DIMENSIONS, 1 << max(0, (n - 1).bit_length() - 3))


def fine_vector(tokens: np.ndarray) -> bytes:
    """Counts of as many groups as the set needs to tell it from others; empty where DIMENSIONS are enough."""
    groups = fine_groups(len(tokens))
    if groups == DIMENSIONS:
        return b""
    counts = np.bincount((tokens & U64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(next(k for k in (np.uint8, np.uint16, np.int32) if counts.max() <= np.iinfo(k).max)).tobytes()


def fine_counts(n: int, held: bytes) -> np.ndarray:
    groups = fine_groups(n)
    kind = {1: np.uint8, 2: np.uint16, 4: np.int32}[len(held) // groups]
    return np.frombuffer(held, dtype=kind).astype(np.int64)


def fine_overlap(na: int, a: bytes, nb: int, b: bytes) -> int:
    """The bound of the overlap of two sets by summed minima, over the groups of the one with fewer."""
    if not a or not b:
        return min(na, nb)
    one, two = sorted((fine_counts(na, a), fine_counts(nb, b)), key=len)
    # Group numbers are the low bits, so groups fold by adding up.
    return int(np.minimum(one, two.reshape(-1, len(one)).sum(axis=0)).sum())


def points_of(counts: list[bytes]) -> np.ndarray:
    kinds = {DIMENSIONS * 2: np.uint16, DIMENSIONS * 4: np.int32}
    if {len(c) for c in counts} == {DIMENSIONS * 2}:
        return np.frombuffer(b"".join(counts), dtype=np.uint16).astype(np.int32).reshape(-1, DIMENSIONS)
    return np.array([np.frombuffer(c, dtype=kinds[len(c)]) for c in counts], dtype=np.int32)


def set_hash(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two longs."""
    if not len(tokens):
        return 0, 0
    return (int(mix(tokens).sum().view(np.int64)), int(mix(tokens ^ U64(0x5DEECE66D)).sum().view(np.int64)))


def profiles(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """(row, n, h1, h2, counts, fine): size, 128-bit hash, point and finer counts of each set."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, width, hashes) for t in batch["text"]]
            marks = [set_hash(s) for s in sets]
            yield {"row": batch["row"], "n": [len(s) for s in sets], "h1": [m[0] for m in marks],
                   "h2": [m[1] for m in marks], "counts": [count_vector(s) for s in sets],
                   "fine": [fine_vector(s) for s in sets]}

    return map_rows(rows, run, f"row {kind}, n bigint, h1 bigint, h2 bigint, counts binary, fine binary")


def keys_of(rows: DataFrame, kind: str, width: int, percent: int) -> DataFrame:
    """(row, key) of the groups of each set.

    Of equal sets that one task meets only the first is keyed; classes join them later.
    """

    def run(batches):
        hashes, rule = WordHashes(), Rule(percent)
        met: set[tuple[int, int]] = set()
        for batch in batches:
            out = {"row": [], "keys": []}
            for row, text in zip(batch["row"], batch["text"], strict=True):
                tokens = shingle_set(text, width, hashes)
                mark = set_hash(tokens)
                if row is None or not len(tokens) or mark in met:
                    continue
                if len(met) > 200_000:
                    met.clear()
                met.add(mark)
                out["row"].append(row)
                out["keys"].append(group_keys(tokens, rule).view(np.int64))
            yield out

    made = map_rows(rows, run, f"row {kind}, keys array<bigint>")
    return made.select("row", F.explode("keys").alias("key"))


def shared_keys(keyed: DataFrame, kind: str) -> DataFrame:
    """(key, leader, row): for every key its smallest row, with each other row of the key.

    Rows are sorted by key and streamed, so a key of any length takes no memory.
    """

    def run(batches):
        last_key, leader = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, rows = batch.column("key").to_numpy(), batch.column("row").to_numpy(zero_copy_only=False)
            starts = np.concatenate(([True], keys[1:] != keys[:-1]))
            starts[0] = keys[0] != last_key
            places = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), -1))
            leaders = rows[np.maximum(places, 0)]
            if not starts[0]:
                leaders[places < 0] = leader
            last_key, leader = keys[-1], leaders[-1]
            keep = np.nonzero(rows != leaders)[0]
            kept = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [kept.column("key"), pa.array(leaders[keep], type=kept.column("row").type), kept.column("row")],
                names=["key", "leader", "row"])

    dealt = keyed.select("key", "row").repartition("key").sortWithinPartitions("key", "row")
    return dealt.mapInArrow(run, f"key bigint, leader {kind}, row {kind}")


def token_sets(rows: DataFrame, kind: str, width: int) -> DataFrame:
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            yield {"row": batch["row"],
                   "tokens": [shingle_set(t, width, hashes).view(np.int64) for t in batch["text"]]}

    return map_rows(rows, run, f"row {kind}, tokens array<bigint>")


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose summed minima of counts allow a link."""
    one = points.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    two = points.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    sized = pairs.join(two, "b").join(one, "a")
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    sized = sized.filter(100 * low >= percent * high)

    def run(batches):
        rule = Rule(percent)
        for batch in batches:
            if not batch["a"]:
                continue
            left, right = points_of(batch["ca"]), points_of(batch["cb"])
            need = rule.need(np.array(batch["na"]), np.array(batch["nb"]))
            keep = np.nonzero(np.minimum(left, right).sum(axis=1) >= need)[0]
            yield {"a": [batch["a"][i] for i in keep], "b": [batch["b"][i] for i in keep]}

    kind = dict(pairs.dtypes)["a"]
    return map_rows(sized, run, f"a {kind}, b {kind}")


def finely_bounded(pairs: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """Of pairs that passed `bounded`, those that also pass with groups of a few shingles each.

    Sets of thousands of shingles fill DIMENSIONS groups so evenly that any two of a size pass;
    their finer counts, a sixteenth of a set, go along with these few pairs only.
    """
    one = fine.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("fine").alias("fa"))
    two = fine.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("fb"))

    def run(batches):
        rule = Rule(percent)
        for batch in batches:
            rows = list(zip(*(batch[c] for c in ("a", "b", "na", "fa", "nb", "fb")), strict=True))
            keep = [(a, b) for a, b, na, fa, nb, fb in rows
                    if fine_overlap(na, fa, nb, fb) >= rule.need(np.int64(na), np.int64(nb))]
            yield _pair_columns(set(keep))

    kind = dict(pairs.dtypes)["a"]
    return map_rows(pairs.join(two, "b").join(one, "a"), run, f"a {kind}, b {kind}").distinct()


def verified(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Written pairs (a, b) that are links, by comparing their whole shingle sets.

    A set goes once to each set that it is compared with as the first of a pair: rows of one `a`
    stand together, its own set first, and are streamed past it, STAR of them in a group.
    """
    kind = dict(pairs.dtypes)["a"]
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    # The same plan at every size: the wanted ids grow with the data and are never broadcast.
    texts = rows.join(wanted.hint("merge"), "row", "left_semi").dropDuplicates(["row"])
    sets = token_sets(texts, kind, width)
    # Each set is asked for by the firsts of its pairs, and by every group that it is the first of.
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    own_group = F.pmod(F.hash("b"), F.col("parts"))
    asked = pairs.join(groups, "a").select(F.col("b").alias("row"), "a", own_group.alias("part")).unionByName(
        groups.select(F.col("a").alias("row"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    sent = sets.join(asked, "row").repartition("a", "part").withColumn("late", F.col("row") != F.col("a"))

    def run(batches):
        first, own = None, np.empty(0)
        for batch in batches:
            out = {"a": [], "b": []}
            for a, part, row, tokens in zip(batch["a"], batch["part"], batch["row"], batch["tokens"], strict=True):
                tokens = np.array(tokens, dtype=np.int64)
                if row == a:
                    first, own = (a, part), tokens
                    continue
                assert first == (a, part), "a set comes before those it is compared with"
                shared = len(np.intersect1d(own, tokens, assume_unique=True))
                if 100 * shared >= percent * (len(own) + len(tokens) - shared):
                    out["a"].append(a)
                    out["b"].append(row)
            yield out

    ordered = sent.sortWithinPartitions("a", "part", "late").select("a", "part", "row", "tokens")
    return materialise(map_rows(ordered, run, f"a {kind}, b {kind}"))


def joined_pairs(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    one = joined.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    two = joined.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    both = pairs.join(one, "a", "left").join(two, "b", "left")
    return both.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


class Tree:
    """Packed R-tree over count vectors: leaves in order of size, an upper corner each."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        starts = np.arange(0, len(sizes), LEAF)
        self.corner = np.maximum.reduceat(self.counts, starts)
        self.least = self.sizes[starts]
        self.most = np.maximum.reduceat(self.sizes, starts)
        self.starts = starts

    def search(self, point: np.ndarray, size: int, rule: Rule) -> np.ndarray:
        """Places of all points whose bound of overlap with `point` allows a link."""
        able = (100 * self.most >= rule.percent * size) & (100 * size >= rule.percent * self.least)
        bound = np.minimum(self.corner, point).sum(axis=1)
        leaves = np.nonzero(able & (bound >= rule.need(self.least, size)))[0]
        if not len(leaves):
            return leaves
        at = (self.starts[leaves][:, None] + np.arange(LEAF)).ravel()
        at = at[at < len(self.sizes)]
        near = np.minimum(self.counts[at], point).sum(axis=1) >= rule.need(self.sizes[at], size)
        return self.order[at[near]]


def tree_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a key and whose bound allows a link.

    `members` has (key, row, root, n, counts). A key of m members is cut into blocks of about
    BLOCK by a hash of the row; every pair of blocks is one group of bounded size.
    """
    kind = dict(members.dtypes)["row"]
    held = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(held, "key").withColumn("own", F.pmod(F.hash("row"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = dealt.select("*", other).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "row", "root", "n", "counts")

    def run(batches):
        rule = Rule(percent)
        block: list[tuple] = []
        mark = None
        for batch in batches:
            out: set[tuple] = set()
            for row in zip(*(batch[c] for c in ("key", "i", "j", "own", "row", "root", "n", "counts")),
                           strict=True):
                if row[:3] != mark:
                    out |= _linkable(block, rule)
                    block, mark = [], row[:3]
                block.append(row)
            yield _pair_columns(out)
        yield _pair_columns(_linkable(block, rule))

    sorted_blocks = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return map_rows(sorted_blocks, run, f"a {kind}, b {kind}").distinct()


def _pair_columns(pairs: set[tuple]) -> dict[str, list]:
    ordered = sorted(pairs)
    return {"a": [p[0] for p in ordered], "b": [p[1] for p in ordered]}


def _linkable(block: list[tuple], rule: Rule) -> set[tuple]:
    """Pairs of one pair of blocks that the tree lets through."""
    left = [r for r in block if r[3] == r[1]]
    right = [r for r in block if r[3] == r[2]]
    if not left or not right or len({r[5] for r in block}) < 2:
        return set()
    tree = Tree(points_of([r[7] for r in right]), np.array([r[6] for r in right]))
    out = set()
    for point, (_, _, _, _, row, root, n, _) in zip(points_of([r[7] for r in left]), left, strict=True):
        for at in tree.search(point, n, rule):
            if right[at][5] != root:
                out.add((min(row, right[at][4]), max(row, right[at][4])))
    return out


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = 3,
    percent: int = 90,
) -> DataFrame:
    """(id, n_shingles, component_id) for each document.

    `width` is the words of a shingle, `percent` the Jaccard similarity of a link, and
    `component_id` the smallest id reachable by links.
    """
    rows = named(docs, row=id_col, text=text_col)
    kind = dict(rows.dtypes)["row"]
    every = materialise(profiles(rows, kind, width))
    nameless = every.filter(F.col("row").isNull()).select("row", "n", F.col("row").alias("root"))
    base = every.filter(F.col("row").isNotNull())
    points = base.select("row", "n", "counts").dropDuplicates(["row"])
    fine = base.select("row", "n", "fine").dropDuplicates(["row"])

    classes = base.filter("n > 0").groupBy("h1", "h2").agg(
        F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # Only classes of several rows have anything to say; all others stand for themselves.
    several = materialise(classes.filter("copies > 1"))
    copies = materialise(base.select("row", "h1", "h2").join(several, ["h1", "h2"])
                         .filter(F.col("row") != F.col("rep")).select("row", "rep").distinct())

    def standing(frame: DataFrame, column: str) -> DataFrame:
        of = copies.select(F.col("row").alias(column), F.col("rep").alias("__rep"))
        return frame.join(of, column, "left").withColumn(column, F.coalesce("__rep", column)).drop("__rep")

    shared = shared_keys(keys_of(rows, kind, width, percent), kind)
    shared = materialise(standing(standing(shared, "leader"), "row"))
    stars = shared.filter(F.col("row") != F.col("leader")).select(
        F.least("leader", "row").alias("a"), F.greatest("leader", "row").alias("b")).distinct()
    near = materialise(finely_bounded(bounded(stars, points, percent), fine, percent))
    # Every row with the smallest it may link with joins most families; few other pairs are open then.
    least = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    nearest = verified(least, rows, width, percent)
    further = materialise(joined_pairs(near.join(least, ["a", "b"], "left_anti"), components(nearest)))
    others = verified(further, rows, width, percent)
    links = materialise(nearest.unionByName(others))
    joined = components(links)
    discard(nearest, others, further, near)

    members = shared.select("key", F.explode(F.array("leader", "row")).alias("row")).distinct()
    rooted = members.join(joined.select(F.col("node").alias("row"), "root"), "row", "left").select(
        "key", "row", F.coalesce("root", "row").alias("root"))
    # Of keys with the very same members, as most of a family's are, one says all.
    same = [F.bit_xor(F.xxhash64("row")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "row")).alias("x2"),
            F.count(F.lit(1)).alias("size")]
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), *same).filter(
        "low < high").groupBy("x1", "x2", "size").agg(F.min("key").alias("key")).select("key")
    members = materialise(rooted.join(open_keys, "key"))
    met = tree_pairs(members.join(points, "row"), percent)
    rest = materialise(finely_bounded(met.join(stars, ["a", "b"], "left_anti"), fine, percent))
    discard(shared, members)
    more = verified(rest, rows, width, percent)
    final = components(links.unionByName(more))
    discard(rest, more, links)

    # A copy follows the document that stands for its class.
    own = base.select("row", "n").dropDuplicates(["row"]).join(copies, "row", "left")
    placed = own.withColumn("stands", F.coalesce("rep", "row")).join(
        final.select(F.col("node").alias("stands"), "root"), "stands", "left"
    ).select("row", "n", F.coalesce("root", "stands").alias("root"))
    return placed.unionByName(nameless).select(
        F.col("row").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, percent: int = 90,
) -> DataFrame:
    """`docs` with the smallest id of every component only; columns as given."""
    found = jaccard_components(docs, id_col, text_col, width=width, percent=percent)
    gone = found.filter(F.col("component_id") != F.col(id_col)).select(id_col).hint("merge")
    return docs.join(gone, id_col, "left_anti")
