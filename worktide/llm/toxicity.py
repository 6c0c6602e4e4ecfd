"""Toxicity by weak supervision: voters, a label model of them, and a linear classifier.

Voters say "toxic" or nothing. Some look for words of a fixed lexicon, plain, disguised or
aimed at a reader; others for words and beginnings of words that mark out documents labelled
toxic. Which of them to believe is not taken from the labels alone: a generative model of the
votes of all documents has a hidden class and, within each class, a tree of the strongest
links between voters, so that voters that say the same thing twice count once. It is fitted
by expectation maximisation; a labelled document holds its class there. Its posteriors
are the labels of the linear classifier, a logistic regression over words, beginnings of words
and votes, which then scores texts that no voter knows.

Scale: lexicons and the classifier are fitted on samples of at most some `fit_rows` documents,
by a hash of the id. Votes are cast by all documents, and what meets the driver is their table
of patterns: at most 3 * 2^16 rows, as there are 16 voters. Scoring is one pass over the texts.
Words seen before are kept with their weights, up to a number, whatever the texts are.

Defined cases: labels of documents whose id's checksum mod 3 is 1 are never read; those are
held out. A null id is not held out, and has no label. A document that is labelled both ways
is toxic. Null texts are empty; an empty text gets the score of a text without known words.
Equal texts get equal scores. Without labels each vote of the fixed voters counts alike. Empty tables give no
rows. Texts are read whole. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.llm.frames import map_rows, materialise, named

WORD = re.compile(r"\w+")

#: Plain insults of four languages.
SEEDS = frozenset("""
    idiot idiots moron morons stupid dumb imbecile cretin scum trash garbage vermin filth loser losers
    pathetic disgusting worthless clown clowns bastard fool ugly
    dummkopf trottel depp abschaum dreckig widerlich
    imbécile crétin ordure minable
    estúpido estúpida imbécil basura asqueroso
""".split())
#: Signs that stand for letters.
SIGNS = str.maketrans("013457@$", "oieastas")
SIGNED = re.compile(r"[a-z0-9]*[@$][a-z0-9@$]*")
SPELLED = re.compile(r"(?<!\w)\w(?:[ .*_-]\w(?!\w)){3,}")
AIMED = re.compile(r"\b(?:you|your|du|dein|tu|vous|eres|usted)\b[^.!?\n]{0,40}?\b(?:" + "|".join(sorted(SEEDS)) + r")\b")

BEGINNINGS = (4, 5, 6, 7)
VOTERS = (
    "seed", "seeds", "disguised", "aimed", "word even", "word odd", "words", "words 3",
    *[f"{name} {n}" for n in BEGINNINGS for name in ("beginning", "beginnings")],
)
VOTE = {name: 1 << k for k, name in enumerate(VOTERS)}
#: What a word may be: in the lexicon, learned (by halves), with a learned beginning of so many letters.
FLAGS = {"seed": 1, "even": 2, "odd": 4} | {n: 8 << k for k, n in enumerate(BEGINNINGS)}
KNOWN_WORDS = 1_000_000


class Known(dict):
    """Remembers what a function gives for a word, for so many words at a time."""

    def __init__(self, of: Callable[[str], float]):
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = self.of(word)
        return found


def words_of(text: str | None) -> tuple[str, set[str]]:
    low = (text or "").lower()
    return low, set(WORD.findall(low))


def terms_of(word: str) -> list[str]:
    """The word and its beginnings, told apart by a mark."""
    return [f"={word}", *[f"{n}{word[:n]}" for n in BEGINNINGS if len(word) > n]]


@dataclass
class Lexicon:
    """Terms, as in terms_of(), that mark out documents labelled toxic."""

    terms: frozenset[str] = frozenset()

    def __post_init__(self):
        self.words = {t[1:] for t in self.terms if t[0] == "="}
        self.beginnings = [(n, {t[1:] for t in self.terms if t[0] == str(n)}) for n in BEGINNINGS]

    def flags(self, word: str) -> int:
        out = FLAGS["seed"] if word in SEEDS else 0
        if word in self.words:
            out |= FLAGS["odd" if crc32(word.encode("utf-8", "surrogatepass")) & 1 else "even"]
        for n, known in self.beginnings:
            if word[:n] in known and len(word) > n:
                out |= FLAGS[n]
        return out

    def voting(self) -> Callable[[str, Iterable[str]], int]:
        """A function from a lower-cased text and its words to votes, bit k for voter k."""
        known, count = Known(self.flags), self.counting()
        return lambda low, words: count(low, words, list(filter(None, map(known.__getitem__, words))))

    def counting(self) -> Callable[[str, Iterable[str], list[int]], int]:
        """The votes from a text, its words, and the flags of those that have any."""

        def votes_of(low: str, words: Iterable[str], found: list[int]) -> int:
            hidden = disguised(low, words)
            if not found:
                return VOTE["disguised"] if hidden else 0
            count = {name: sum(1 for f in found if f & bit) for name, bit in FLAGS.items()}
            learned = sum(1 for f in found if f > FLAGS["seed"])
            votes = [count["seed"] > 0, count["seed"] > 1, hidden, bool(found) and bool(AIMED.search(low)),
                     count["even"] > 0, count["odd"] > 0, learned > 1, learned > 2]
            for n in BEGINNINGS:
                votes += [count[n] > 0, count[n] > 1]
            return sum(1 << k for k, yes in enumerate(votes) if yes)

        return votes_of


def disguised(low: str, words: Iterable[str]) -> bool:
    """Whether a word of the lexicon stands there with signs for letters, or letter by letter."""
    if any(not w.isalpha() and w.translate(SIGNS) in SEEDS for w in words):
        return True
    if ("@" in low or "$" in low) and any(w.translate(SIGNS) in SEEDS for w in SIGNED.findall(low)):
        return True
    if sum(1 for w in words if len(w) == 1) < 3:
        return False
    return any(re.sub(r"[ .*_-]", "", found) in SEEDS for found in SPELLED.findall(low))


@dataclass
class LabelModel:
    """P(toxic | votes) for every pattern, how often each voter speaks in each class, links of voters."""

    posterior: np.ndarray
    rates: np.ndarray
    links: list[tuple[int, int]] = field(default_factory=list)


def _tree(strength: np.ndarray) -> list[int]:
    """The parent of each voter in the tree of strongest links; -1 for the first."""
    n = len(strength)
    parent, best, inside = [-1] * n, strength[0].copy(), {0}
    near = [0] * n
    while len(inside) < n:
        k = max((j for j in range(n) if j not in inside), key=lambda j: best[j])
        parent[k] = near[k]
        inside.add(k)
        for j in range(n):
            if strength[k, j] > best[j]:
                best[j], near[j] = strength[k, j], k
    return parent


def fit_labels(votes: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 30,
               prior: float = 0.05, unlabelled: float = 1.0) -> LabelModel:
    """Patterns of votes with their label (-1: none) and how many documents have them."""
    n = len(VOTERS)
    bits = (votes[:, None] >> np.arange(n) & 1).astype(float)
    weight = np.where(labels >= 0, counts, counts * unlabelled).astype(float)
    every = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(float)
    held = labels >= 0
    guess = np.where(held, labels, prior)
    if not held.any():
        # The tree knows nothing of good and bad by itself: votes stand for themselves.
        logs = np.log(prior / (1 - prior)) + every @ np.full(n, 2.0)
        return LabelModel(1 / (1 + np.exp(-logs)), np.tile(bits.mean(axis=0), (2, 1)))
    weight_now = np.where(held, weight, 0)
    for _ in range(rounds):
        joint, sums = [], []
        for w in (weight_now * (1 - guess), weight_now * guess):
            # As if two more documents, one with every vote and one with none, had been seen.
            both = (bits * w[:, None]).T @ bits + 0.5
            one = (bits * w[:, None]).sum(axis=0) + 1.0
            total = w.sum() + 2.0
            cells = np.stack([total - one[:, None] - one[None] + both, one[None] - both, one[:, None] - both, both])
            joint.append(np.maximum(cells, 1e-3) / total)
            sums.append((one / total, total))
        strength = np.zeros((n, n))
        for cells, (rate, total) in zip(joint, sums):
            single = [1 - rate, rate]
            for k, cell in enumerate(cells):
                apart = single[k // 2][:, None] * single[k % 2][None]
                strength += total * cell * np.log(cell / np.maximum(apart, 1e-9))
        parent = _tree(strength)
        share = np.array([sums[0][1] - 2 + 2 * (1 - prior), sums[1][1] - 2 + 2 * prior])
        logs = np.tile(np.log(share / share.sum()), (1 << n, 1))
        for c, (cells, (rate, _)) in enumerate(zip(joint, sums)):
            for j, p in enumerate(parent):
                if p < 0:
                    logs[:, c] += np.where(every[:, j] > 0, np.log(rate[j]), np.log(1 - rate[j]))
                    continue
                for value in (0, 1):
                    # cells[2 * first + second] of the pair (p, j)
                    off, on = cells[2 * value, p, j], cells[2 * value + 1, p, j]
                    here = every[:, p] == value
                    logs[here, c] += np.where(every[here, j] > 0, np.log(on / (on + off)), np.log(off / (on + off)))
        posterior = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        guess = np.where(held, labels, posterior[votes])
        weight_now = weight
    return LabelModel(posterior, np.stack([s[0] for s in sums]), [(p, j) for j, p in enumerate(parent) if p >= 0])


@dataclass
class Classifier:
    """Weights of hashed terms, of votes, and a bias."""

    lexicon: Lexicon
    weights: np.ndarray
    votes: np.ndarray
    bias: float

    def scoring(self) -> Callable[[str | None], float]:
        flags, votes_of, mask = self.lexicon.flags, self.lexicon.counting(), len(self.weights) - 1
        weights = {int(k): float(self.weights[k]) for k in np.flatnonzero(self.weights)}

        def worth(word: str) -> tuple[int, float] | None:
            found = flags(word), sum(weights[k] for k in slots_of(word, mask) if k in weights)
            return found if any(found) else None

        known = Known(worth)
        by_votes = np.array([(self.votes[[k for k in range(len(VOTERS)) if v >> k & 1]]).sum()
                             for v in range(1 << len(VOTERS))])

        def score(text: str | None) -> float:
            low, words = words_of(text)
            found = list(filter(None, map(known.__getitem__, words)))
            votes = votes_of(low, words, [f for f, _ in found if f])
            # In a fixed order, so that equal texts get the same score to the last digit.
            total = self.bias + by_votes[votes] + sum(sorted(w for _, w in found if w))
            return float(1 / (1 + np.exp(-min(max(total, -500.0), 500.0))))

        return score


def slots_of(word: str, mask: int) -> list[int]:
    """Places of a word and its beginnings among the hashed weights, by one checksum that goes on."""
    short = word[: BEGINNINGS[0]].encode("utf-8", "surrogatepass")
    check, out, size = crc32(short), [], len(word)
    for n in BEGINNINGS:
        if size <= n:
            break
        out.append((check * 2 + 1) & mask)
        check = crc32(word[n].encode("utf-8", "surrogatepass"), check)
    else:
        check = crc32(word[BEGINNINGS[-1] + 1 :].encode("utf-8", "surrogatepass"), check)
    out.append((check * 2) & mask)
    return out


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def known_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(row, toxic) of the labels that may be learned from."""
    rows = named(labels, row=id_col, toxic=label_col).filter("row IS NOT NULL AND toxic IS NOT NULL")
    return rows.filter(remainder(F.col("row")) != 1).groupBy("row").agg(F.max("toxic").alias("toxic"))


def _sampled(rows: DataFrame, share: float) -> DataFrame:
    """So many of the rows, by a hash of their ids."""
    return rows.filter(F.pmod(F.xxhash64("row", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))


def learn_lexicon(docs: DataFrame, labels: DataFrame, fit_rows: int, most: int = 4000, support: int = 3,
                  lift: float = 8.0) -> Lexicon:
    """Terms in at least `support` toxic documents of the sample, `lift` times as often as in others."""
    sizes = {r.toxic: r.rows for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon()
    toxic = _sampled(labels.filter("toxic = 1"), min(1.0, fit_rows / 3 / sizes[1]))
    clean = _sampled(labels.filter("toxic = 0"), min(1.0, fit_rows / sizes[0]))
    texts = materialise(docs.join(toxic.unionByName(clean), "row"))

    def counted(rows: DataFrame, among: frozenset[str] | None) -> DataFrame:
        """(term, docs): documents for each term; row 0 of the empty term counts documents."""

        def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            for batch in batches:
                seen: Counter = Counter()
                for text in batch["text"]:
                    found = {t for w in words_of(text)[1] for t in terms_of(w)}
                    seen.update(found if among is None else found & among)
                    seen[""] += 1
                yield {"term": list(seen), "docs": list(seen.values())}

        return map_rows(rows.select("text"), work, "term string, docs bigint").groupBy("term").agg(
            F.sum("docs").alias("docs"))

    a = {r.term: r.docs for r in counted(texts.filter("toxic = 1"), None).filter(f"docs >= {support}").orderBy(
        F.desc("docs"), "term").limit(5 * most + 1).collect()}
    among = frozenset(a) - {""}
    b = {r.term: r.docs for r in counted(texts.filter("toxic = 0"), among).collect()}
    n1, n0 = a.get("", 0) + 1, b.get("", 0) + 1
    lifts = {t: (a[t] / n1) / ((b.get(t, 0) + 0.5) / n0) for t in among}
    strong = sorted((t for t in among if lifts[t] >= lift), key=lambda t: (-a[t] * np.log(lifts[t]), t))
    return Lexicon(frozenset(strong[:most]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          fit_rows: int = 12_000, bits: int = 17) -> Classifier:
    """`labels`: rows of known_labels(). `fit_rows` bounds the sample of documents behind each fit."""
    rows = named(docs, row=id_col, text=text_col)
    lexicon = learn_lexicon(rows, labels, fit_rows)

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        vote = lexicon.voting()
        for batch in batches:
            yield {"row": batch["row"], "votes": [vote(*words_of(t)) for t in batch["text"]]}

    kind = rows.schema["row"].dataType.simpleString()
    votes = materialise(map_rows(rows, work, f"row {kind}, votes int"))
    patterns = votes.join(labels, "row", "left").groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("label")).agg(
        F.count(F.lit(1)).alias("docs")).toPandas()
    model = fit_labels(*[patterns[c].to_numpy() for c in ("votes", "label", "docs")]) if len(patterns) else None
    size = 1 << bits
    blank = Classifier(lexicon, np.zeros(size), np.zeros(len(VOTERS)), 0.0)
    if model is None:
        return blank

    may = F.coalesce(remainder(F.col("row")) != 1, F.lit(True))
    share = min(1.0, fit_rows / max(1, int(patterns.docs.sum())))
    picked = _sampled(rows.filter(may), share)
    mask, posterior = size - 1, np.clip(model.posterior, 1e-3, 1 - 1e-3)

    def features(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        vote = lexicon.voting()
        for batch in batches:
            out = {"slots": [], "p": []}
            for text in batch["text"]:
                low, words = words_of(text)
                said = vote(low, words)
                slots = {k for w in words for k in slots_of(w, mask)}
                out["slots"].append(sorted(slots) + [size + k for k in range(len(VOTERS)) if said >> k & 1])
                out["p"].append(float(posterior[said]))
            yield out

    sample = materialise(map_rows(picked, features, "slots array<int>, p double"))
    if sample.isEmpty():
        return blank
    vector = F.udf(lambda slots: Vectors.sparse(size + len(VOTERS), slots, [1.0] * len(slots)), VectorUDT())
    # A posterior is both labels, each with its weight.
    both = sample.select(vector("slots").alias("features"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("x")).select("features", "x.*")
    fitted = LogisticRegression(maxIter=60, regParam=3e-4, elasticNetParam=0.5, standardization=False,
                                weightCol="weight").fit(both)
    found = np.asarray(fitted.coefficients.toArray())
    return Classifier(lexicon, found[:size], found[size:], float(fitted.intercept))


def scored(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, score) for every document."""
    rows = named(docs, row=id_col, text=text_col)

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        score = model.scoring()
        for batch in batches:
            yield {"row": batch["row"], "score": [score(t) for t in batch["text"]]}

    return map_rows(rows, work, f"row {rows.schema['row'].dataType.simpleString()}, score double")
