"""Conversation structure repair: the cheapest edits that give a well-formed order of roles.

A conversation is well-formed if the initials of its roles read `(s?(ua)+)?`. Its rows are
kept (K, free), given the role that fits (R, 2), deleted (D, 3; the only way for blank and
repeated ones), or an empty turn of the fitting role is inserted (I, 2); a truncated row that
stays costs 1. Which role fits follows from what stands before, so the letters alone tell the
result; of equally cheap ones the letters that sort first are the answer.

The search is iterative-deepening A*: depth first, letters in ASCII order, under a bound that
starts at the estimate for the whole and grows by one. The estimate counts what every way must
pay: forced deletions, truncated rows, and 2 for each edit that is needed where neighbours may
not meet, one for two such pairs in a row, as an edit touches one place. A table keeps, for a place and a state, the
largest rest of a bound that has failed there, and holds for later bounds too. The first
accepting path is the cheapest, and of these the first.

Scale: rows are placed by range, so a conversation of very many turns is spread over tasks,
and cut into blocks of `BLOCK` rows that are searched alone. Blocks of one conversation are
tied by costs from each of four states to each of four, then by what the rest costs from each
state, then by the state in which each block ends. These are some 20 small numbers for
a block, less than the letters of its rows, which come together in one output value anyway.
Only the digest of a repaired conversation needs its texts in one task, as SHA-256 is
sequential; they stream through it in order and are never held together.

Defined cases: a null role, text, turn or conversation id is one space where text is needed;
null turns sort first, a null id is a conversation. Rows of one turn sort by role, then by the
digest of their text, and wholly repeated rows are duplicates. A role with an empty name adds
no initial. Empty and very long texts are rows like others. An empty table gives no rows.
Only the named columns are read, whatever others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.llm.frames import map_rows, materialise, named
from worktide.llm.order import in_order, ranked

BLOCK = 32
BLANKS = " \t\n\x0b\f\r"

#: Initials as codes, in the order of this string; then any other one, and none.
INITIALS = "sua"
OTHER, NONE = 3, 4
#: A row's code is that of its initial plus FAULT times the number of its fault.
FAULT = 8
FAULTS = ("", "blank", "duplicate", "truncated")
MUST_GO, TRUNCATED = (1, 2), 3

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = range(4)
NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
FITTING = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
ENDS = {0: 0, 3: 0}
LEGAL = {(0, 1), (1, 2), (2, 1)}


def repair(codes: list[int], state: int, rest: dict[int, int], last: bool) -> tuple[int, str, int] | None:
    """(cost, letters, state after them) of the first cheapest way through a block from a state.

    `rest` has the states in which the block may end, and what follows costs from each. Inserts
    behind the last row belong to the next block, if there is one.
    """
    n = len(codes)
    roles = [c % FAULT for c in codes]
    fault = [c // FAULT for c in codes]
    must, cut = [f in MUST_GO for f in fault], [f == TRUNCATED for f in fault]
    # From each row on: what is paid for rows alone, the next row that is not deleted for sure
    # and has a role, and edits for pairs of such rows.
    alone, ahead, clashes = [0] * (n + 1), [n] * (n + 2), [0] * (n + 2)
    all_go = set(rest) == {state} and state < 2  # these states are left for good
    for i in reversed(range(n)):
        # A row without a role leaves every state as it is, so it may stay there as well.
        goes = must[i] or (all_go and roles[i] != NONE)
        alone[i] = alone[i + 1] + (3 if goes else cut[i])
        stays = not (goes or roles[i] == NONE)
        ahead[i] = i if stays else ahead[i + 1]
        clashes[i] = clashes[i + 1]
        follower = ahead[i + 1]
        if stays and follower < n and (roles[i], roles[follower]) not in LEGAL:
            # The edit of the follower also mends the pair behind it.
            clashes[i] = 2 + clashes[ahead[follower + 1]]
    cheapest = min(rest.values())

    def estimate(i: int, state: int) -> int:
        first = ahead[i]
        if first < n and (state, roles[first]) not in NEXT:
            return alone[i] + cheapest + 2 + clashes[ahead[first + 1]]
        return alone[i] + cheapest + clashes[i]

    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def find(i: int, state: int, left: int) -> tuple[int, int] | None:
        """(what is left of the bound, last state)"""
        if i == n:
            if rest.get(state, left + 1) <= left:
                return left - rest[state], state
            if not last:
                return None
        if estimate(i, state) > left or failed.get((i, state), -1) >= left:
            return None
        fits = FITTING[state][1]
        ways = [("I", i, fits, 2)]
        if i < n:
            ways.insert(0, ("D", i + 1, state, 3))
            if not must[i]:
                after = state if roles[i] == NONE else NEXT.get((state, roles[i]))
                if after is not None:
                    ways.append(("K", i + 1, after, int(cut[i])))
                ways.append(("R", i + 1, fits, 2 + cut[i]))
        for letter, at, after, cost in ways:
            if cost <= left:
                path.append(letter)
                if (found := find(at, after, left - cost)) is not None:
                    return found
                path.pop()
        failed[i, state] = left
        return None

    bound = estimate(0, state)
    # Deleting all and two inserts at the end reach whatever can be reached.
    while bound <= 4 * n + 4 + max(rest.values()):
        if (found := find(0, state, bound)) is not None:
            return bound - found[0], "".join(path), found[1]
        bound += 1
    return None


def applied(codes: list[int], letters: str, state: int) -> Iterator[tuple[list[str], str | None, bool]]:
    """For every row: roles inserted before it, its new role, if any, and whether it stays.

    Inserts behind the last row come as one more.
    """
    rows = iter(codes)
    before: list[str] = []
    for letter in letters:
        role, fits = FITTING[state]
        if letter == "I":
            before.append(role)
            state = fits
            continue
        initial = next(rows) % FAULT
        yield before, role if letter == "R" else None, letter != "D"
        before = []
        if letter == "R":
            state = fits
        elif letter == "K" and initial != NONE:
            state = NEXT[state, initial]
    if before:
        yield before, None, False


def or_space(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text", period: int = 20) -> DataFrame:
    """(conv, conv_id, turn, role, text): rows dropped, emptied, cut, repeated or renamed by their checksum."""
    rows = named(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    number = F.crc32(F.concat_ws(":", or_space(F.col("conv_id")), or_space(F.col("turn"))).cast("binary")) % period
    rows = rows.withColumn("kind", number).filter("kind <> 0")
    role, text = or_space(F.col("role")), or_space(F.col("text"))
    return rows.select(
        conversation(F.col("conv_id")).alias("conv"), "turn",
        F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def conversation(conv_id: Column) -> Column:
    """A key for a conversation, also for the one without an id."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def faults(placed: DataFrame) -> DataFrame:
    """(conv, part, seq, turn, code): rows without texts, judged."""
    mark = ["conv", "role", "mark"]
    tail = F.rtrim(F.col("text"), F.lit(BLANKS))
    end = F.substring(tail, -1, 1)
    rows = placed.select(*mark, "part", "seq", "turn", (tail == "").alias("blank"),
                         (~end.isin(".", "!", "?")).alias("cut"), F.substring("role", 1, 1).alias("initial"))
    # Only what occurs again has a first occurrence to look for.
    first = rows.groupBy(*mark).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("times")).filter(
        "times > 1").select(*mark, "first")
    rows = rows.join(first, mark, "left")
    fault = F.when(F.col("blank"), 1).when(F.col("seq") > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0)
    at = F.instr(F.lit(INITIALS), F.col("initial"))
    initial = F.when(F.col("initial") == "", NONE).when(at > 0, at - 1).otherwise(OTHER)
    return rows.select("conv", "part", "seq", "turn", (initial + FAULT * fault).alias("code"))


def _reaches(codes: list[int], state: int, end: int) -> bool:
    """Whether a block can lead from a state to another: a system turn is only ever kept, and first."""
    if end == 1 and state == 0:
        return any(c % FAULT == 0 and c // FAULT not in MUST_GO for c in codes)
    return end >= 2 or end == state


def _spread(blocks: DataFrame) -> DataFrame:
    """Small rows that take long are dealt to as many tasks as a shuffle has."""
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv", "block")


def _searched(blocks: DataFrame) -> DataFrame:
    """Blocks (conv, block, blocks, seqs, codes, led) with `ways`: for each possible first state, letters and last state."""
    many = blocks.filter("blocks > 1")

    def costs(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for rows in batches:
            out = {"conv": rows["conv"], "block": rows["block"], "costs": []}
            for codes, block, blocks in zip(rows["codes"], rows["block"], rows["blocks"]):
                last = block == blocks - 1
                ends = [ENDS] if last else [{s: 0} for s in STATES]
                found = [[repair(codes, s, end, last) if last or _reaches(codes, s, t) else None
                          for t, end in enumerate(ends)] for s in STATES]
                out["costs"].append([[-1 if x is None else x[0] for x in row] for row in found])
            yield out

    def rests(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        """What follows a block costs from each state, from the last block to the first."""
        for rows in batches:
            for conv, steps in zip(rows["conv"], rows["steps"]):
                out = {"conv": [], "block": [], "rest": []}
                rest = [0]
                for step in reversed(steps):
                    ways = [[c + r for c, r in zip(row, rest) if c >= 0 and r >= 0] for row in step["costs"]]
                    rest = [min(w, default=-1) for w in ways]
                    out["conv"].append(conv), out["block"].append(step["block"] - 1), out["rest"].append(rest)
                yield out

    key = "conv string, block bigint"
    steps = map_rows(_spread(many.select("conv", "block", "blocks", "codes")), costs, f"{key}, costs array<array<bigint>>")
    steps = steps.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "costs"))).alias("steps"))
    rest = map_rows(steps, rests, f"{key}, rest array<bigint>")

    def ways(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for rows in batches:
            out = {c: rows[c] for c in ("conv", "block", "blocks")} | {"ways": []}
            for codes, block, rest in zip(rows["codes"], rows["block"], rows["rest"]):
                ends = ENDS if rest is None else {s: r for s, r in enumerate(rest) if r >= 0}
                found = [repair(codes, s, ends, rest is None) for s in (STATES if block else (0,))]
                out["ways"].append([None if x is None else dict(zip(("cost", "letters", "state"), x)) for x in found])
            yield out

    both = blocks.select("conv", "block", "blocks", "codes").join(rest, ["conv", "block"], "left")
    return materialise(map_rows(
        _spread(both), ways, f"{key}, blocks bigint, ways array<struct<cost:bigint,letters:string,state:int>>"))


def _entered(searched: DataFrame) -> DataFrame:
    """(conv, block, state): the state in which each block of a conversation is entered."""
    steps = searched.filter("blocks > 1").select("conv", F.struct("block", F.col("ways.state").alias("to")).alias("s"))
    steps = steps.groupBy("conv").agg(F.array_sort(F.collect_list("s")).alias("steps"))

    def walk(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for rows in batches:
            for conv, steps in zip(rows["conv"], rows["steps"]):
                state, states = 0, []
                for step in steps:
                    states.append(state)
                    state = step["to"][state]
                yield {"conv": [conv] * len(steps), "block": [s["block"] for s in steps], "state": states}

    return map_rows(steps, walk, "conv string, block bigint, state int")


def _digests(placed: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, repaired): SHA-256 over the lines of each repaired conversation."""
    texts = placed.select("seq", "role", "text")
    # Inserts behind the last row stand without a text of their own.
    said = F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text")
    lines = F.concat(F.transform("before", lambda r: F.concat(r, F.lit(":"))),
                     F.when(F.col("stays"), F.array(said)).otherwise(F.array().cast("array<string>")))
    rows = edits.filter("stays OR size(before) > 0").join(texts, "seq", "left").select(
        "conv", "at", F.array_join(lines, "\n").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            for name, line in zip(batch["conv"].to_pylist(), batch["line"]):
                line = line.as_py().encode("utf-8", "surrogatepass")
                if state is None or name != conv:
                    if state is not None:
                        yield pa.RecordBatch.from_pydict({"conv": [conv], "repaired": [state.hexdigest()]})
                    conv, state = name, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"conv": [conv], "repaired": [state.hexdigest()]})

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "at")
    return ordered.mapInArrow(run, "conv string, repaired string")


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (conv, turn, role, text) to (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired)."""
    placed = in_order(rows.select("conv", "turn", "role", "text", F.sha2("text", 256).alias("mark")),
                      "conv", "turn", "role", "mark")
    judged = materialise(ranked(faults(placed), "conv"))
    fault = F.floor(F.col("code") / FAULT)
    counts = judged.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum((fault == k).cast("long")).alias(name) for k, name in enumerate(FAULTS) if k])

    items = F.array_sort(F.collect_list(F.struct("at", "seq", "code")))
    blocks = judged.groupBy("conv", F.floor(F.col("at") / block).alias("block")).agg(
        items.alias("items"), F.ceil(F.first("total") / block).alias("blocks"))
    blocks = materialise(blocks.select("conv", "block", "blocks", F.col("items.seq").alias("seqs"),
                                       F.col("items.code").alias("codes"), F.col("items.at")[0].alias("start")))
    # Neighbours inside a block, and the last row of a block with the first of the next.
    led = blocks.select("conv", (F.col("block") + 1).alias("block"), F.element_at("codes", -1).alias("led"))
    roles = F.transform(
        F.concat(F.when(F.col("led").isNull(), F.array().cast("array<int>")).otherwise(F.array("led")), "codes"),
        lambda c: c % FAULT)
    pairs = F.zip_with(F.slice(roles, 1, F.size(roles) - 1), F.slice(roles, 2, F.size(roles)), lambda a, b: a * FAULT + b)
    wrong = F.size(F.filter(pairs, lambda p: ~p.isin(*[a * FAULT + b for a, b in sorted(LEGAL)])))
    illegal = blocks.join(led, ["conv", "block"], "left").select("conv", wrong.alias("wrong")).groupBy("conv").agg(
        F.sum("wrong").alias("illegal"))

    searched = _searched(blocks)
    entered = searched.join(_entered(searched), ["conv", "block"], "left").withColumn(
        "state", F.coalesce("state", F.lit(0)))
    taken = entered.select("conv", "block", "state", F.expr("ways[state].cost").alias("cost"),
                           F.expr("ways[state].letters").alias("letters"))
    whole = taken.groupBy("conv").agg(
        F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))),
                                 lambda x: x["letters"]), "").alias("audit"))

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for rows in batches:
            for k, conv in enumerate(rows["conv"]):
                done = list(applied(rows["codes"][k], rows["letters"][k], rows["state"][k]))
                n, start = len(done), rows["start"][k]
                before, roles, stays = map(list, zip(*done))
                yield {"conv": [conv] * n, "at": list(range(start, start + n)), "before": before,
                       "seq": (rows["seqs"][k] + [None])[:n], "new_role": roles, "stays": stays}

    edits = map_rows(blocks.join(taken, ["conv", "block"]).select("conv", "codes", "letters", "state", "start", "seqs"), work,
                     "conv string, at bigint, seq bigint, before array<string>, new_role string, stays boolean")
    found = counts.join(illegal, "conv").join(whole, "conv").join(_digests(placed, edits), "conv", "left")
    return found.withColumn("repaired", F.coalesce("repaired", F.sha2(F.lit(""), 256)))
