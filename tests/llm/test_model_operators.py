"""Language model, sampled segmentations, neighbours, Jaccard join and pipeline against brute force."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from worktide.llm import jaccard, pieces
from worktide.llm.components import components
from worktide.llm.hashing import Lookup
from worktide.llm.jaccard import jaccard_components, one_of_each
from worktide.llm.kneser_ney import NO_LANGUAGE, classify, log_likelihoods, model, without_rejected
from worktide.llm.neighbours import nearest

SYLLABLES = "an be con da el fi gu ha il jo ka lu".split()
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, mean double, level int"


def text_of(rng, words, junk=False):
    out = " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words))
    return out.upper().replace(" ", "!! ") if junk else out


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, 0.5, 2) for i, t, lang in rows], DOC)


class PlainKneserNey:
    """The textbook recursion over dictionaries."""

    def __init__(self, texts, order=4):
        self.order = order
        self.counts = {order: Counter()}
        for text in texts:
            padded = "\0" * (order - 1) + text
            for at in range(order - 1, len(padded)):
                self.counts[order][padded[at - order + 1 : at + 1]] += 1
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.d = {}
        self.heads = {}
        for n, counts in self.counts.items():
            m = Counter(counts.values())
            y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else 0.5
            self.d[n] = [min(max(k - (k + 1) * y * (m[k + 1] / m[k] if m[k] else 0), 0.1), k - 0.1) for k in (1, 2, 3)]
            heads = defaultdict(list)
            for gram, c in counts.items():
                heads[gram[:-1]].append(c)
            self.heads[n] = heads

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(self.counts[1]) + 1)
        after = self.heads[n].get(gram[:-1])
        if not after:
            return self.p(gram[1:])
        total = sum(after)
        discount = [self.d[n][min(c, 3) - 1] for c in after]
        c = self.counts[n].get(gram, 0)
        own = max(c - self.d[n][min(c, 3) - 1], 0) / total if c else 0
        return own + sum(discount) / total * self.p(gram[1:])

    def nll(self, text):
        padded = "\0" * (self.order - 1) + text
        return -sum(math.log(self.p(padded[at - self.order + 1 : at + 1])) for at in range(self.order - 1, len(padded)))


@pytest.mark.parametrize("shard_entries", [4_000_000, 60])
def test_likelihood_is_kneser_neys(spark, shard_entries):
    rng = random.Random(4)
    texts = [text_of(rng, rng.randint(1, 30)) for _ in range(25)] + ["a", "ab\0c", "é𝄞x"]
    entries = model(spark.createDataFrame([("en", t) for t in texts] + [("de", "nur dies")], "lang string, text string"))
    plain = PlainKneserNey([t.replace("\0", "\1").replace("𝄞", "�") for t in texts])
    asked = [*texts[:6], text_of(rng, 12), "ZZZ unseen!", "x", "é𝄞x", "", None, texts[0]]
    rows = [(i, i, "en", t) for i, t in enumerate(asked)] + [(99, 0, "fr", "abc"), (0, 0, "en", asked[0])]
    docs = spark.createDataFrame(rows, "row bigint, mark bigint, lang string, text string")
    got = log_likelihoods(docs, entries, shard_entries).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain.nll(asked[r.row].replace("𝄞", "�")) if r.row < 99 and asked[r.row] else None
        assert (r.nll is None) == (want is None) and (want is None or r.nll == pytest.approx(want, rel=1e-9)), r


def test_probabilities_of_a_context_sum_to_one(spark):
    rng = random.Random(9)
    texts = [text_of(rng, 20) for _ in range(8)]
    plain = PlainKneserNey(texts)
    letters = {c for t in texts for c in t}
    for head in ("", "a", "an", "con"[:3], "zzz"):
        assert sum(plain.p(head + c) for c in letters) + plain.p(head + "@") == pytest.approx(1.0)


def test_junk_is_rejected_and_clean_kept(spark):
    rng = random.Random(6)
    clean = [(i, text_of(rng, rng.randint(5, 80)), rng.choice(["en", None])) for i in range(240)]
    junk = [(1000 + i, text_of(rng, 40, junk=True), "en") for i in range(20)]
    odd = [(2000, None, "en"), (2001, "", None), (2002, "ÑÑ ÑÑ", "xx"), (None, clean[0][1], "en"), clean[1], (2003, text_of(rng, 30_000), "en")]
    # A few words over and over, with a sign that no trusted text has, are not like trusted text.
    junk.append((2004, "con be. " * 20_000, "en"))
    docs = docs_of(spark, clean + junk + odd)
    trusted = spark.createDataFrame([(i,) for i in range(0, 240, 2)] + [(None,), (77_777,), (0,)], "doc_id bigint")
    got = classify(docs, trusted).collect()
    rejected = {r.doc_id for r in got if r.rejected}
    assert rejected == {i for i, _, _ in junk} and len(got) == len(clean + junk + odd)
    left = without_rejected(docs, trusted)
    assert left.columns == docs.columns and left.count() == len(clean + odd)
    assert classify(docs_of(spark, []), trusted).collect() == []
    assert not any(r.rejected for r in classify(docs, trusted.limit(0)).collect())
    assert NO_LANGUAGE not in {r.lang for r in got}


def test_a_junk_stretch_in_fluent_text_is_rejected(spark):
    rng = random.Random(21)
    clean = [(i, text_of(rng, 80), "en") for i in range(80)]
    stretch = text_of(rng, 700) + " " + text_of(rng, 40, junk=True) + " " + text_of(rng, 700)
    docs = docs_of(spark, [*clean, (100, stretch, "en"), (101, text_of(rng, 1400), "en")])
    trusted = spark.createDataFrame([(i,) for i in range(80)], "doc_id bigint")
    got = {r.doc_id: r.rejected for r in classify(docs, trusted).collect()}
    assert got[100] and not got[101]


def test_trusted_documents_are_not_scored_by_a_model_of_themselves(spark):
    rng = random.Random(22)
    clean = [(i, text_of(rng, 30), "en") for i in range(40)]
    own = "QXZ WVK " * 20
    docs = docs_of(spark, [*clean, (50, own, "en"), (60, "Qué", "es")])
    trusted = spark.createDataFrame([(i,) for i in (*range(40), 50, 60)], "doc_id bigint")
    got = {r.doc_id: r.perplexity for r in classify(docs, trusted).collect()}
    # Its letters are in no other document, yet the only document of a language has a score.
    assert got[50] > 20 * max(got[i] for i in range(40)) / 4 and got[60] is not None


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    found = Lookup(keys, np.arange(len(keys))).get(np.concatenate((keys, keys + np.uint64(1))))
    assert (found[: len(keys)] == np.arange(len(keys))).all() and np.isnan(found[len(keys) :]).all()
    assert np.isnan(Lookup(keys[:0], np.empty(0)).get(keys)).all()


VOCABULARY = pieces.Vocabulary(pieces.MODEL, 0.5)


def all_paths(text):
    """log p of every segmentation of a text, normalised."""
    weight = dict(zip(VOCABULARY.pieces, VOCABULARY.weight.tolist(), strict=True))
    ids = dict(zip(VOCABULARY.pieces, VOCABULARY.ids.tolist(), strict=True))

    def word(s):
        if not s:
            return [((), 0.0)]
        out = []
        for n in range(1, min(len(s), 16) + 1):
            if s[:n] in weight:
                head = ((ids[s[:n]],), weight[s[:n]])
            elif n == 1:
                raw = s.encode() if len(s) == 1 else s[0].encode()
                head = (tuple(VOCABULARY.bytes[b] for b in raw), len(raw) * VOCABULARY.byte_weight)
            else:
                continue
            out += [((*head[0], *p), head[1] + w) for p, w in word(s[n:])]
        return out

    words = [word(" " + w) for w in text.split(" ")]
    every = [(sum((p for p, _ in c), ()), sum(w for _, w in c)) for c in itertools.product(*words)]
    total = math.log(sum(math.exp(w) for _, w in every))
    return {p: w - total for p, w in every}


@pytest.mark.parametrize("text", ["there", "a b", "on é,"])
def test_samples_follow_the_distribution_without_replacement(text):
    lattices = pieces.Lattices(VOCABULARY)
    exact = all_paths(text)
    runs, k = 4000, 3
    first, included = Counter(), defaultdict(float)
    for seed in range(runs):
        rows = pieces.sample(lattices, [text], [seed * 2_654_435_761], k)[0]
        paths = [tuple(ids.tolist()) for ids, _, _ in rows]
        assert len(set(paths)) == len(paths) == min(k, len(exact))
        first[paths[0]] += 1
        for path, (_, log_p, inclusion) in zip(paths, rows, strict=True):
            assert log_p == pytest.approx(exact[path], abs=1e-4)
            included[path] += 1 / inclusion / runs
    for path, log_p in exact.items():
        p = math.exp(log_p)
        assert abs(first[path] / runs - p) < 5 * math.sqrt(p * (1 - p) / runs) + 1e-3
    # Weighted by its inclusion score every path counts once on average.
    likely = [included[p] for p, w in exact.items() if w > math.log(0.1)]
    assert all(abs(x - 1) < 0.15 for x in likely)


def test_long_tails_are_drawn_like_short_ones(monkeypatch):
    text = "the one"
    exact = all_paths(text)
    monkeypatch.setattr(pieces, "HEAD", 1)
    monkeypatch.setattr(pieces, "SHORT", 1)
    lattices, runs, pairs = pieces.Lattices(VOCABULARY), 3000, Counter()
    for seed in range(runs):
        rows = pieces.sample(lattices, [text], [seed * 40_503 + 1], 2)[0]
        pairs[tuple(rows[0][0].tolist())] += 1
        assert rows[0][0].tolist() != rows[1][0].tolist()
        for ids, log_p, _ in rows:
            assert log_p == pytest.approx(exact[tuple(ids.tolist())], abs=1e-4)
    for path, log_p in exact.items():
        p = math.exp(log_p)
        assert abs(pairs[path] / runs - p) < 5 * math.sqrt(p * (1 - p) / runs) + 2e-3


def test_later_paths_of_long_texts_are_drawn_without_replacement(monkeypatch):
    text, runs = "on at", 12_000
    exact = {path: math.exp(x) for path, x in all_paths(text).items()}
    second = {e: sum(d * exact[e] / (1 - d) for path, d in exact.items() if path != e) for e in exact}
    third = {e: sum(a * b / (1 - a) * exact[e] / (1 - a - b) for i, a in exact.items() for j, b in exact.items()
                    if len({i, j, e}) == 3) for e in exact}
    monkeypatch.setattr(pieces, "HEAD", 1)
    monkeypatch.setattr(pieces, "SHORT", 1)
    lattices, counts, weighted = pieces.Lattices(VOCABULARY), [Counter(), Counter(), Counter()], Counter()
    for seed in range(runs):
        rows = pieces.sample(lattices, [text], [seed * 40_503 + 7], 3)[0]
        for number, (ids, log_p, inclusion) in enumerate(rows):
            counts[number][tuple(ids.tolist())] += 1
            weighted[tuple(ids.tolist())] += math.exp(log_p) / inclusion
    for counted, wanted in zip(counts, (exact, second, third), strict=True):
        assert sum(wanted.values()) == pytest.approx(1.0, abs=1e-4)
        squares = sum((counted[e] - runs * p) ** 2 / (runs * p) for e, p in wanted.items() if runs * p >= 5)
        cells = sum(runs * p >= 5 for p in wanted.values())
        assert squares < cells + 5 * math.sqrt(2 * cells) + 5
    assert sum(weighted.values()) / runs == pytest.approx(1.0, abs=0.02)


@pytest.mark.parametrize("text", ["on at", "a b c", "the one"])
def test_all_endings_come_once_when_more_are_asked_for(monkeypatch, text):
    exact = all_paths(text)
    monkeypatch.setattr(pieces, "HEAD", 1)
    monkeypatch.setattr(pieces, "SHORT", 1)
    rows = pieces.sample(pieces.Lattices(VOCABULARY), [text], [11], len(exact) + 3)[0]
    assert sorted(tuple(ids.tolist()) for ids, _, _ in rows) == sorted(exact)
    assert all(inclusion == 1.0 and log_p == pytest.approx(exact[tuple(ids.tolist())], abs=1e-4)
               for ids, log_p, inclusion in rows)


@pytest.mark.parametrize("text", ["there is more", "on é, 日本 𝄞", "x" * 70])
def test_nodes_hold_an_arc_for_each_piece_and_no_more(monkeypatch, text):
    weight = dict(zip(VOCABULARY.pieces, VOCABULARY.weight.tolist(), strict=True))
    ids = dict(zip(VOCABULARY.pieces, VOCABULARY.ids.tolist(), strict=True))
    monkeypatch.setattr(pieces, "NODES", 8)
    lattices = pieces.Lattices(VOCABULARY)
    for _ in range(2):
        lattices.places(["gone", "soon"])
        lattices.trim()
        for segment, first, size in zip(cut := pieces.cut_up(text), *lattices.places(cut), strict=True):
            held = segment[0] if isinstance(segment, tuple) else " " + segment
            assert size == len(held)
            total = [0.0]
            for end in range(1, len(held) + 1):
                want = {n: (ids[held[end - n : end]], weight[held[end - n : end]])
                        for n in range(1, end + 1) if held[end - n : end] in weight}
                raw = held[end - 1].encode()
                want.setdefault(1, (VOCABULARY.bytes[raw[0]] if len(raw) == 1 else -1 - ord(held[end - 1]),
                                    len(raw) * VOCABULARY.byte_weight))
                logs = {n: total[end - n] + w for n, (_, w) in want.items()}
                total.append(math.log(sum(map(math.exp, logs.values()))))
                lengths, scores, found, shares = lattices.arcs(int(first) + end)
                assert lengths == sorted(want) and found == [want[n][0] for n in lengths]
                assert scores == pytest.approx([logs[n] - total[end] for n in lengths], abs=1e-4)
                assert shares[:-1] == pytest.approx(np.cumsum(np.exp(scores))[:-1].tolist(), abs=1e-5)


def every_path(text):
    """log p of every segmentation of a text that is not cut anywhere, normalised."""
    weight = dict(zip(VOCABULARY.pieces, VOCABULARY.weight.tolist(), strict=True))
    ids = dict(zip(VOCABULARY.pieces, VOCABULARY.ids.tolist(), strict=True))
    paths = [[((), 0.0)]]
    held = " " + text
    for end in range(1, len(held) + 1):
        found = []
        for n in range(1, min(end, 16) + 1):
            piece = held[end - n : end]
            if piece in weight:
                arc = ((ids[piece],), weight[piece])
            elif n == 1:
                arc = (tuple(VOCABULARY.bytes[b] for b in piece.encode()), len(piece.encode()) * VOCABULARY.byte_weight)
            else:
                continue
            found += [((*path, *arc[0]), w + arc[1]) for path, w in paths[end - n]]
        paths.append(found)
    top = max(w for _, w in paths[-1])
    total = top + math.log(sum(math.exp(w - top) for _, w in paths[-1]))
    return {path: w - total for path, w in paths[-1]}


CUT = "\U0001F0A1" * 30 + "on at"  # the 31st and 32nd characters are a piece


@pytest.mark.parametrize("text", [CUT, "a   b", "  a", " ", "a  ", "\U0001F0A1" * 40 + "a" + " " * 3])
@pytest.mark.parametrize("head", [None, 1, 0])
def test_pieces_cross_blanks_and_long_stretches(monkeypatch, text, head):
    """Every segmentation is there, however long a stretch is and however it is searched."""
    exact = every_path(text)
    if head is not None:
        monkeypatch.setattr(pieces, "HEAD", head)
        monkeypatch.setattr(pieces, "SHORT", 0)
    rows = pieces.sample(pieces.Lattices(VOCABULARY), [text], [11], len(exact) + 3)[0]
    assert sorted(tuple(ids.tolist()) for ids, _, _ in rows) == sorted(exact)
    assert all(inclusion == 1.0 and log_p == pytest.approx(exact[tuple(ids.tolist())], abs=1e-4)
               for ids, log_p, inclusion in rows)
    assert VOCABULARY.decode(rows[-1][0].tolist()) == text


def test_first_paths_over_blanks_and_long_stretches_follow_the_distribution(monkeypatch):
    monkeypatch.setattr(pieces, "PACKED", 3)
    lattices, runs = pieces.Lattices(VOCABULARY), 3000
    for text in (CUT, "a    on"):
        exact, whole, late = every_path(text), Counter(), Counter()
        for seed in range(runs):
            whole[tuple(pieces.sample(lattices, [text], [seed * 40_503 + 1], 1)[0][0][0].tolist())] += 1
        monkeypatch.setattr(pieces, "SHORT", 0)
        monkeypatch.setattr(pieces, "HEAD", 0)
        for seed in range(runs):
            late[tuple(pieces.sample(lattices, [text], [seed * 40_503 + 1], 1)[0][0][0].tolist())] += 1
        monkeypatch.undo()
        monkeypatch.setattr(pieces, "PACKED", 3)
        for path, log_p in exact.items():
            p = math.exp(log_p)
            for counted in (whole, late):
                assert abs(counted[path] / runs - p) < 5 * math.sqrt(p * (1 - p) / runs) + 2e-3


def test_cuts_are_where_no_piece_crosses():
    rng, lattices = random.Random(3), pieces.Lattices(VOCABULARY)
    letters = "abcde on the 日本語中文, ▁é\t\n" + "  "
    known = set(VOCABULARY.pieces)
    for text in ["".join(rng.choice(letters) for _ in range(200)) for _ in range(20)] + ["日本語" * 30, "x" * 40_000]:
        cut = lattices.segments(["", text, text])[2]
        held = [s[0] if isinstance(s, tuple) else " " + s for s in cut]
        assert "".join(held) == " " + text
        whole, at = " " + text, 0
        for segment in held[:-1]:
            at += len(segment)
            assert not any(whole[a:b] in known for a in range(max(0, at - 15), at) for b in range(at + 1, a + 17))
    # One long stretch is one segment, and a text of several slices' length is drawn whole.
    assert len(cut) == 1
    ids, log_p, _ = pieces.sample(lattices, [text], [5], 1)[0][0]
    assert VOCABULARY.decode(ids.tolist()) == text and log_p < 0


def test_round_trip_and_repeatability(spark):
    rng = random.Random(7)
    odd = ["", None, " ", "  two  blanks ", "tab\tnew\nline\r\n", "▁ sign", "日本語 𝄞 \0 é", "x" * 3000, "word " * 20_000, "\n" * 200]
    rows = [(i, t, "en") for i, t in enumerate(odd + [text_of(rng, 60) for _ in range(20)])] + [(None, "no id", "en"), (3, odd[3], "en")]
    docs = docs_of(spark, rows)
    made = pieces.encode(docs, paths=3)
    got = [tuple(r) for r in made.collect()]
    again = [tuple(r) for r in pieces.encode(docs.repartition(7), paths=3).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    texts = {(r.doc_id, r.text) for r in pieces.decode(made).collect()}
    assert texts == {(i, t or "") for i, t, _ in rows}
    by = defaultdict(list)
    for i, sample, ids, log_p, inclusion, _ in got:
        by[i].append(tuple(ids))
        assert log_p <= 1e-6 and 0 <= inclusion <= 1
    assert len(by[10]) == len(set(by[10])) == 3 and by[0] == by[1] == [()]
    assert pieces.encode(docs_of(spark, [])).collect() == []


def test_three_paths_by_default(spark):
    docs = docs_of(spark, [(1, "there is more than one way", "en")])
    assert [r["sample"] for r in pieces.encode(docs).orderBy("sample").collect()] == [1, 2, 3]


VECTOR = "vec_id bigint, embedding array<float>, id int, v int, block int"


def test_neighbours_recall_ties_and_unfit_vectors(spark):
    rng = np.random.default_rng(2)
    spread = rng.standard_normal((3000, 24)).astype(np.float32)
    spread[1000:1400] = spread[7]  # copies: ties go to smaller ids
    spread[2000] *= 5
    rows = [(i, x.tolist(), 1, 2, 3) for i, x in enumerate(spread)]
    bad = [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] * 24), (5080, [float("inf")] * 24), (5100, [1.0]), (None, [1.0] * 24)]
    rows += [(i, x, 1, 2, 3) for i, x in bad] + [rows[40]]
    table = spark.createDataFrame(rows, VECTOR)
    got = nearest(table, table.filter("vec_id % 20 = 0"), vector_block=1500, query_block=60).collect()
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(by) == list(range(0, 3000, 20))
    exact, hits = spread.astype(np.float64), 0
    for q, found in by.items():
        found.sort()
        scores = exact @ exact[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(3000), -np.round(scores, 9)))[:20]
        hits += len({v for _, v, _ in found} & set(best.tolist()))
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert all(s == pytest.approx(float(exact[v] @ exact[q]), rel=1e-12) for _, v, s in found)
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
    assert hits / (20 * len(by)) >= 0.9
    assert nearest(table.limit(0), table.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 2, 3), (1, [0.5, 0.5], 1, 2, 3)], VECTOR)
    assert [tuple(r) for r in nearest(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 1, 0.5)]


def plain_components(rows, width, percent):
    sets = {}
    for i, text, _ in rows:
        words = (text or "").encode().lower().split()
        n = min(width, len(words))
        sets[i] = frozenset(tuple(words[at : at + n]) for at in range(len(words) - n + 1)) if words else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def families(rng):
    """Exact copies, chains of near copies, a star whose points are not linked, short texts."""
    rows = [(i, text_of(rng, rng.randint(1, 120)), "en") for i in range(60)]
    at = 60
    for size, rate in ((40, 0.02), (30, 0.04), (25, 0.08)):
        base = text_of(rng, 150).split()
        for _ in range(size):
            words = list(base)
            for place in rng.sample(range(len(words)), max(1, int(rate * len(words) / 3))):
                words[place] = "new" + str(rng.random())
            rows.append((at, " ".join(words), "en"))
            at += 1
    chain = text_of(rng, 200).split()
    for _ in range(20):
        chain = [*chain[2:], "more", str(rng.random())]
        rows.append((at, " ".join(chain), "en"))
        at += 1
    rows += [(at + i, rng.choice(["a", "a b", "A  B\n", "a b c", "a b c d", "", " "]), "en") for i in range(30)]
    rows += [(at + 100 + i, rows[65][1].upper(), "en") for i in range(30)] + [(at + 200, None, "en"), (at + 201, "w " * 30_000, "en")]
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_are_exact(spark, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = families(random.Random(11))
    rng = random.Random(1)
    rng.shuffle(rows)
    got = jaccard_components(docs_of(spark, [*rows, rows[0], (None, "left out", "en")]), width=width, percent=percent).collect()
    want = plain_components(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(want) + 1
    assert len({c for _, c in want.values()}) < len(want)


def test_one_of_each_keeps_columns(spark):
    docs = docs_of(spark, [(3, "a b c d e f", "en"), (1, "A b c d e f", "en"), (2, "other words", "en"), (4, None, None)])
    left = one_of_each(docs, width=5, percent=80)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 4]
    assert one_of_each(docs_of(spark, [])).collect() == []


def test_fine_bounds_hold_and_tell_long_sets_apart():
    rng = np.random.default_rng(8)
    for n in (0, 1, 500, 512, 513, 900, 5000, 40_000):
        pool = np.unique(rng.integers(0, 2**63, 2 * n + 10).astype(np.uint64))
        rng.shuffle(pool)
        for shared in (0, n // 2, n * 9 // 10, n):
            a, b = pool[:n], np.concatenate((pool[:shared], pool[n : n + (n - shared)]))
            bound = jaccard.fine_overlap(len(a), jaccard.fine_vector(a), len(b), jaccard.fine_vector(b))
            assert shared <= bound <= n
            if n > 512 and not shared:
                assert bound < 0.85 * n
    # Sets of other sizes are compared over the groups of the smaller one.
    a, b = pool[:1000], pool[:1100]
    assert jaccard.fine_groups(1000) != jaccard.fine_groups(1100)
    assert jaccard.fine_overlap(1000, jaccard.fine_vector(a), 1100, jaccard.fine_vector(b)) == 1000


def test_group_keys_lose_no_pair():
    rng, rule = np.random.default_rng(5), jaccard.Rule(80)
    for _ in range(400):
        n = int(rng.integers(1, 90))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) > rng.random() * 0.25], rng.integers(0, 2**63, int(rng.integers(0, 8))).astype(np.uint64))))
        if len(b) and len(a) != len(b) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            assert len(np.intersect1d(jaccard.group_keys(a, rule), jaccard.group_keys(b, rule)))


@pytest.mark.parametrize("percent", [80, 90])
def test_unrelated_sets_do_not_meet_by_empty_groups(percent):
    rng, rule = np.random.default_rng(6), jaccard.Rule(percent)
    sets = [rng.integers(0, 2**63, int(rng.integers(60, 1500))).astype(np.uint64) for _ in range(1500)]
    _, met = np.unique(np.concatenate([jaccard.group_keys(s, rule) for s in sets]), return_counts=True)
    assert (met[met > 1] ** 2).sum() < 1500


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    rng = random.Random(0)
    rng.shuffle(edges)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000)}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(12)
    # Of the language's own syllables: what is unlike trusted text would go in the first stage.
    passage = " ".join(["belu", "fijo", "hakagu", "ilan", "condael", "gubefi", "luka", "jodail", "elhagu", "anfi", "kacon"])
    clean = [(i, text_of(rng, rng.randint(30, 80)), "en") for i in range(120)]
    line = "ilgu hafi elan joka condalu befi gujo"
    marked = [(200 + i, text_of(rng, 40) + "\n" + line, "en") for i in range(5)]
    junk = [(300 + i, text_of(rng, 40, junk=True), "en") for i in range(6)]
    # Equal lines would go to one of them in line dedup; so each ends in a word of its own.
    copies = [(400 + i, f"{clean[3][1]} {end}", "en") for i, end in enumerate(["andabe", "figu", "luil", "kajo"])]
    leaked = [(500, clean[5][1] + " " + text_of(rng, 30) + " " + passage, "en")]
    rows = clean + marked + junk + copies + leaked + [(600, None, None)]
    base = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    folder = str(tmp_path)
    base.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(200 + i, 1, 0) for i in range(5)] + [(300, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), []
    for number, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage{number}")
        docs = spark.read.parquet(f"{folder}/stage{number}")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if number < len(pipeline.STAGES) - 1:
            assert docs.columns == base.columns
    every = {i for i, _, _ in rows}
    assert every - ids[0] == {i for i, _, _ in junk} and ids[1] == ids[0]
    assert ids[1] - ids[2] == {400, 401, 402, 403} and ids[2] - ids[3] == {500} and ids[4] == ids[3]
    kept = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/stage1").collect()}
    assert [i for i in range(200, 205) if line in kept[i]] == [204]
    assert pipeline.run(spark, folder).count() == docs.count()
    for _, stage in pipeline.STAGES:
        assert stage(spark, base.limit(0), folder).count() == 0
