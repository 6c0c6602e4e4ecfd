"""Toxicity, Merkle manifest and conversation repair against plain versions of their rules."""

from __future__ import annotations

import hashlib
import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from worktide.llm import merkle, repair, toxicity

# --- conversation repair


def plain_repair(rows):
    """(cost, letters, lines) of rows (role, text, fault) by a table over all states."""
    nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    fit = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def with_inserts(table):
        for _ in range(2):
            for state, (cost, letters, lines) in list(table.items()):
                role, to = fit[state]
                new = (cost + 2, letters + "I", [*lines, f"{role}:"])
                if to not in table or new[:2] < table[to][:2]:
                    table[to] = new
        return table

    best = {0: (0, "", [])}
    for role, text, fault in rows:
        step = {}
        for state, (cost, letters, lines) in with_inserts(best).items():
            ways = [(state, 3, "D", [])]
            cut = int(fault == "truncated")
            if fault not in ("blank", "duplicate"):
                to = state if role == "" else nxt.get((state, role[0]))
                if to is not None:
                    ways.append((to, cut, "K", [f"{role}:{text}"]))
                ways.append((fit[state][1], 2 + cut, "R", [f"{fit[state][0]}:{text}"]))
            for to, price, letter, line in ways:
                new = (cost + price, letters + letter, lines + line)
                if to not in step or new[:2] < step[to][:2]:
                    step[to] = new
        best = step
    ends = with_inserts(best)
    return min((ends[s] for s in (0, 3) if s in ends), key=lambda x: x[:2])


def plain_conversation(turns):
    """The contract's row for the damaged turns (turn, role, text) of one conversation."""
    def place(row):
        turn, role, text = row
        return (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest())

    rows, seen, faults = sorted(turns, key=place), set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        fault = ""
        if not body:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif body[-1] not in ".!?":
            fault = "truncated"
        faults.append(fault)
        seen.add((role, text))
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    pairs = zip(rows, rows[1:])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    cost, letters, lines = plain_repair([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    return (gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, letters,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, count, longest):
    rng = random.Random(seed)
    out = []
    for c in range(count):
        n = rng.choice([1, 2, 3, 5, 8, longest])
        for t in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            text = rng.choice(["Yes.", "No", " \t\n", "", "What?", f"Turn {t} of {c}!", "…", "Yes."])
            turn = rng.choice([t, t, t + 1, None]) if rng.random() < 0.3 else t
            out.append((f"={c}", turn, role, text))
    return out


KEPT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]


@pytest.mark.parametrize("block", [3, 64])
def test_repair_is_the_cheapest_first_way(spark, block):
    rows = conversations(5, 40, 30)
    df = spark.createDataFrame(rows, "conv string, turn bigint, role string, text string")
    got = {r.conv: tuple(r[c] for c in KEPT) for r in repair.repaired(df, block).collect()}
    want = {c: plain_conversation([x[1:] for x in rows if x[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_a_row_without_a_role_stays_where_a_block_leaves_its_state():
    """No system turn and no other one: keeping the row is free, and its block ends where it began."""
    for state in (0, 1):
        assert repair.repair([repair.NONE], state, {state: 0}, False) == (0, "K", state)
        cut = repair.NONE + repair.FAULT * repair.TRUNCATED
        assert repair.repair([cut, 0 + repair.OTHER], state, {state: 0}, False) == (4, "KD", state)


def test_search_agrees_with_the_table_on_all_short_conversations():
    roles = {0: "system", 1: "user", 2: "assistant", 3: "tool", 4: ""}
    for codes in product([0, 1, 2, 3, 4, 9, 25, 26], repeat=4):
        rows = [(roles[c % 8], "x", repair.FAULTS[c // 8]) for c in codes]
        assert repair.repair(list(codes), 0, repair.ENDS, True)[:2] == plain_repair(rows)[:2]


def test_damage_and_its_cases(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t, r, x in
            [(None, "user", "A."), (0, None, None), *[(k, "assistant", f"Is it {k}? Yes!") for k in range(80)]]]
    schema = "conv_id bigint, turn bigint, role string, text string, conv string, kind int, seq int, at int"
    df = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], schema)
    got = sorted(map(tuple, repair.damaged(df).collect()), key=str)
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else "".join(ch for ch in x if ch not in ".!?") if kind == 2 else x
        want += [("" if c is None else f"={c}", t, "user" if kind == 4 else r, x)] * (kind != 0) * (1 + (kind == 3))
    assert got == sorted(want, key=str)
    assert {k for k in (zlib.crc32(f"{c}:{t}".encode()) % 20 for c in (1, 2) for t in range(80))} >= {0, 1, 2, 3, 4}
    assert repair.repaired(repair.damaged(df.limit(0))).collect() == []


def test_a_very_long_conversation_and_repeated_rows(spark):
    rows = [("=1", t, ("user", "assistant")[t % 2], f"{t}.") for t in range(3000)]
    rows += [("=2", 5, "user", "Same.")] * 500 + [("=3", 0, "user", "x" * 300_000 + ".")]
    df = spark.createDataFrame(rows, "conv string, turn bigint, role string, text string")
    got = {r.conv: r for r in repair.repaired(df).collect()}
    assert (got["=1"].cost, got["=1"].audit) == (0, "K" * 3000)
    assert got["=1"].repaired == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in rows[:3000]).encode()).hexdigest()
    assert (got["=2"].duplicate, got["=2"].audit) == (499, "D" * 500 if 3 * 500 < 3 * 499 + 2 else "K" + "D" * 499 + "I")
    assert got["=3"].audit == "KI"


# --- Merkle manifest


def plain_tree(hashes):
    """(levels, root): every level of a tree of eights."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([merkle.hashed(*last[k : k + 8]) for k in range(0, len(last), 8)])
    return levels


def plain_proof(levels, at):
    out = []
    for level in levels[:-1]:
        start = at - at % 8
        out.append(("".join(level[start:at]), "".join(level[at + 1 : start + 8])))
        at //= 8
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"": 3, "=de": 9, "=en": 700, "=fr": 64}, {f"={k:03}": k % 3 + 1 for k in range(70)}])
def test_manifest_proofs_and_log(spark, sizes):
    rows = [(tree, None if not k else k // 2, merkle.hashed(tree, str(k)), k) for tree, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "tree string, id bigint, hash string, seq int").select("tree", "id", "hash")
    made = merkle.manifest(df)
    got = {(r.tree, r.hash): r for r in made.with_proofs().withColumn(
        "folded", merkle.folded(F.col("hash"), "before", "after")).collect()}
    trees = {}
    for tree, _, h, k in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        trees.setdefault(tree, []).append(h)
    built = {t: plain_tree(h) for t, h in trees.items()}
    names = sorted(built)
    top = plain_tree([built[t][-1][0] for t in names])
    for t in names:
        for at, h in enumerate(trees[t]):
            row = got[t, h]
            want = plain_proof(built[t], at) + plain_proof(top, names.index(t))
            assert list(zip(row.before, row.after)) == want
            assert row.root == row.folded == top[-1][0] and row.subroot == built[t][-1][0]
    log = sorted((r.tree, r.pos, r.level, r.at, r.hash) for r in made.groups.log.collect())
    for t in names:
        mine = [x[2:] for x in log if x[0] == t]
        assert [x[1] for x in log if x[0] == t] == list(range(sum(map(len, built[t]))))
        assert all(built[t][level][at] == h for level, at, h in mine)
        ends = [min((at + 1) * 8**level, len(trees[t])) for level, at, _ in mine]
        assert ends == sorted(ends)


def test_leaf_fields_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "é\n"), (None, "", "x" * 100_000)], "a bigint, b string, c string")
    got = [r[0] for r in df.select(merkle.leaf_hash(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [merkle.hashed("1:1-3:é\n"), merkle.hashed("-0:100000:" + "x" * 100_000)]
    none = spark.createDataFrame([], "tree string, id bigint, hash string")
    assert merkle.manifest(none).with_proofs().collect() == []


def test_repeated_rows_are_leaves_side_by_side(spark):
    rows = [("=x", 1, merkle.hashed("same"))] * 20 + [("=x", 0, merkle.hashed("first"))]
    got = merkle.manifest(spark.createDataFrame(rows, "tree string, id bigint, hash string")).with_proofs().collect()
    assert len(got) == 21 and {r.root for r in got} == {plain_tree([rows[-1][2]] + [r[2] for r in rows[:20]])[-1][0]}


# --- toxicity


def corpus(count, seed):
    """Documents whose toxic ones hold words of a lexicon, or invented ones with one beginning."""
    rng = random.Random(seed)
    parts = ["ta", "lo", "mi", "ner", "es", "un", "qua", "vel"]
    docs, labels = [], []
    for i in range(count):
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.2
        if bad and i % 2:
            words += rng.choices(["idiot", "scum", "moron"], k=2)
        elif bad:
            words += ["zrukk" + rng.choice(parts) for _ in range(3)]
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(1500, 3)
    frame = spark.createDataFrame([(i, t, 7, "k", 1) for i, t in docs], "doc_id bigint, text string, row int, votes string, toxic int")
    known = toxicity.known_labels(spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert all(zlib.crc32(str(r.row).encode()) % 3 != 1 for r in known.collect())
    extra = [(9000, None, 1, "", 0), (9001, "", 1, "", 0), (None, "you idiot, you moron", 1, "", 0),
             (9002, docs[0][1], 1, "", 0), (9003, "mita lo " * 40_000, 1, "", 0)]
    model = toxicity.train(frame, known, bits=14)
    every = frame.union(spark.createDataFrame(extra, frame.schema))
    got = {r.row: r.score for r in toxicity.scored(every, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    hits = [got[i] >= 0.7 for i, y in held if y]
    false = [got[i] >= 0.7 for i, y in held if not y]
    assert sum(hits) >= 0.95 * len(hits) and sum(false) <= 0.02 * len(false)
    assert got[9000] == got[9001] < 0.5 and got[None] > 0.7 and got[9002] == got[docs[0][0]] and got[9003] < 0.5


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = corpus(300, 8)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    scores = []
    for rows in (labels, flipped):
        model = toxicity.train(frame, toxicity.known_labels(spark.createDataFrame(rows, "doc_id bigint, toxic int")), bits=12)
        scores.append(sorted(map(tuple, toxicity.scored(frame, model).collect())))
    assert np.allclose(np.array(scores[0]), np.array(scores[1]), atol=1e-6)


def test_no_labels_and_empty_tables(spark):
    frame = spark.createDataFrame([(k, ("a quiet day", "you idiot and moron")[k % 2]) for k in range(40)], "doc_id bigint, text string")
    none = toxicity.known_labels(spark.createDataFrame([], "doc_id bigint, toxic int"))
    got = {r.row: r.score for r in toxicity.scored(frame, toxicity.train(frame, none, bits=10)).collect()}
    assert got[1] > got[2]
    empty = frame.limit(0)
    assert toxicity.scored(empty, toxicity.train(empty, none, bits=10)).collect() == []


def test_label_model_counts_copied_voters_once():
    """A voter and its copies are no more than one; an independent second voter is more."""
    rng = np.random.default_rng(4)
    n = 20_000
    toxic = rng.random(n) < 0.2
    def voter(hit, false):
        return rng.random(n) < np.where(toxic, hit, false)
    a, b = voter(0.8, 0.1), voter(0.8, 0.1)
    columns = [a, b] + [a.copy() for _ in range(5)] + [voter(0.02, 0.02) for _ in range(len(toxicity.VOTERS) - 7)]
    votes = sum(c.astype(int) << k for k, c in enumerate(columns))
    labels = np.where(rng.random(n) < 0.3, toxic, -1)
    keys, counts = np.unique(np.stack([votes, labels]), axis=1, return_counts=True)
    model = toxicity.fit_labels(keys[0], keys[1], counts)
    copies = sum(1 << k for k in (0, 2, 3, 4, 5, 6))
    alone = 0.2 * 0.8 * 0.2 / (0.2 * 0.8 * 0.2 + 0.8 * 0.1 * 0.9)
    both = 0.2 * 0.64 / (0.2 * 0.64 + 0.8 * 0.01)
    assert abs(model.posterior[copies] - alone) < 0.12 and abs(model.posterior[copies | 2] - both) < 0.05


def test_patterns():
    def disguised(text):
        return toxicity.disguised(*toxicity.words_of(text))

    assert disguised("such an 1d10t") and disguised("an i d i o t") and disguised("s.c.u.m") and disguised("$cum, b@stard")
    assert not disguised("idiot") and not disguised("a 5th day, 100 l") and not disguised("s c u t")
    assert toxicity.AIMED.search("you are a complete idiot") and not toxicity.AIMED.search("you left. the idiot")


def test_slots_go_on_from_beginning_to_word():
    mask = (1 << 14) - 1
    for word in ("", "a", "four", "fiver", "sevens!", "éclairéeux", "eightlet", "a much longer word"):
        slots = toxicity.slots_of(word, mask)
        assert len(slots) == 1 + sum(len(word) > n for n in toxicity.BEGINNINGS)
        assert slots[-1] == zlib.crc32(word.encode()) * 2 & mask
        assert all(s == (zlib.crc32(word[:n].encode()) * 2 + 1) & mask for s, n in zip(slots[:-1], toxicity.BEGINNINGS))
