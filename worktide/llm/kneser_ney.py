"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Characters are the words of the model, four to an n-gram, one model per language. The
n-grams of all trusted documents are counted; continuation counts, discounts and context
weights are group-bys and joins over the count tables. A document's perplexity, and that of
its worst passage, are compared with quantiles of its language's trusted documents.

No document is scored by a model that has read it: texts fall into two folds by their hash,
each fold's trusted documents make one model per language, and a document is scored by the
model of the other fold. So the quantiles hold for new text. Where only one fold of a
language has trusted documents, its model scores both.

    p(c | h) = max(n(hc) - D, 0) / n(h.) + gamma(h) * p(c | h without its first character)

The highest order counts occurrences, lower ones distinct predecessors; the lowest is
interpolated with the uniform distribution. D is one of three values by n = 1, 2, 3 or
more, estimated from the counts of counts of each language and order.

Scale: counting reads trusted texts once and sums per task before the shuffle, so that a
language with a third of all rows is no hot key. The tables stay sharded by n-gram while
they are joined. To score, entries with two or three characters of context are split by the
last two of these into shards of at most `shard_entries`, or, where one pair of characters has
more, into one shard for each pair; what has less context, at most all pairs of characters, goes
with every shard. The documents are joined with one shard after another as it is broadcast,
and the partial sums of a document are added. One scan per shard, texts never move. What is
counted covers all trusted text and grows with it.

Defined cases: a null language is a language of its own. A null or empty text has no
perplexity and is kept, as is a text of a language without trusted documents. Short
texts are drawn to their language's mean as if `prior_chars` characters of it preceded
them. Repeated rows each come back. Labels of unknown documents do nothing.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.llm.frames import map_rows, materialise, named
from worktide.llm.hashing import Lookup

ORDER = 4
BITS = 16
SPREAD = 40_503  # odd, so that pairs of characters fall evenly into shards
SHARD_ENTRIES = 4_000_000
BIN = 0.001  # width of a bin of log perplexity, for the quantiles
BLOCK = 100  # characters, about; two neighbouring blocks are a passage
NO_LANGUAGE = "\0"  # stands for a null language in keys

U64 = np.uint64


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers of all texts, each after ORDER - 1 zeros, and where each text starts."""
    gap = "\0" * (ORDER - 1)
    # A NUL in a text is no start of text, and what 16 bits cannot hold is one symbol.
    joined = "".join(gap + t.replace("\0", "\1") for t in texts)
    out = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.cumsum([0] + [len(t) + len(gap) for t in texts[:-1]])
    return np.where(out > 0xFFFF, 0xFFFD, out).astype(U64), starts


def grams(chars: np.ndarray) -> np.ndarray:
    """The key of the ORDER characters that end at each place but the first few."""
    key = chars[: len(chars) - ORDER + 1]
    for at in range(1, ORDER):
        key = (key << U64(BITS)) | chars[at : len(chars) - ORDER + 1 + at]
    return key


def by_language(batch: dict[str, list]) -> dict[str, list[int]]:
    places = defaultdict(list)
    for at, (language, text) in enumerate(zip(batch["lang"], batch["text"], strict=True)):
        if text:
            places[language].append(at)
    return places


def count_grams(trusted: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts of (lang, text)."""

    def merge(a: tuple, b: tuple) -> tuple:
        keys, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
        return keys, np.bincount(at, np.concatenate((a[1], b[1]))).astype(np.int64)

    def run(batches):
        held: dict[str, tuple] = {}
        for batch in batches:
            for language, places in by_language(batch).items():
                chars, _ = symbols([batch["text"][i] for i in places])
                keys = grams(chars)[chars[ORDER - 1 :] != 0]
                new = np.unique(keys, return_counts=True)
                held[language] = merge(held[language], new) if language in held else new
                if len(held[language][0]) > 1_000_000:
                    yield _gram_rows(language, *held.pop(language))
        for language, pair in held.items():
            yield _gram_rows(language, *pair)

    return map_rows(trusted, run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


def _gram_rows(language: str, keys: np.ndarray, counts: np.ndarray) -> dict[str, list]:
    return {"lang": [language] * len(keys), "gram": keys.view(np.int64), "n": counts}


def _low(key: Column, characters: int) -> Column:
    return key.bitwiseAND(F.lit((1 << (BITS * characters)) - 1)) if characters < 4 else key


def _discounted(counts: DataFrame) -> DataFrame:
    """Adds d, the discount of each entry, and d1, d2, d3 of its language."""
    of = counts.groupBy("lang").agg(*[
        F.count(F.when(F.col("n") == k, 1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

    def d(k: int) -> Column:
        rate = F.coalesce(F.try_divide(f"n{k + 1}", f"n{k}"), F.lit(0.0))
        # Counts of counts of a tiny corpus may leave the valid range.
        return F.least(F.greatest(k - (k + 1) * y * rate, F.lit(0.1)), F.lit(k - 0.1))

    of = of.select("lang", *[d(k).alias(f"d{k}") for k in (1, 2, 3)])
    return counts.join(of, "lang").withColumn(
        "d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))


def model(trusted: DataFrame) -> DataFrame:
    """(lang, kind, key, value): log p of n-grams (kind 1-4) and log gamma of contexts (kind 10-13).

    The key of a context holds its characters; kind 10 is the empty context, with the
    uniform share of a character added, so that an unseen character has that value.
    """
    counts = {ORDER: materialise(count_grams(trusted))}
    for order in range(ORDER - 1, 0, -1):
        longer = counts[order + 1]
        counts[order] = longer.groupBy("lang", _low(F.col("gram"), order).alias("gram")).agg(
            F.count(F.lit(1)).alias("n"))
        if order > 1:
            counts[order] = materialise(counts[order])
    entries, below = None, None
    for order in range(1, ORDER + 1):
        rows = _discounted(counts[order]).withColumn(
            "head", F.shiftrightunsigned("gram", BITS) if order > 1 else F.lit(0).cast("bigint"))
        heads = rows.groupBy("lang", "head").agg(
            F.sum("n").alias("total"), F.sum("d").alias("mass"), F.count(F.lit(1)).alias("kinds"))
        heads = heads.withColumn("gamma", F.col("mass") / F.col("total"))
        one = rows.select("lang", "gram", "head", "n", "d").join(heads, ["lang", "head"])
        own = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        if order == 1:
            share = F.col("gamma") / (F.col("kinds") + 1)
            p = one.select("lang", "gram", (own + share).alias("p"))
            gammas = heads.select("lang", F.lit(10).alias("kind"), F.col("head").alias("key"), share.alias("p"))
        else:
            under = below.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q"))
            p = one.withColumn("tail", _low(F.col("gram"), order - 1)).join(under, ["lang", "tail"]).select(
                "lang", "gram", (own + F.col("gamma") * F.col("q")).alias("p"))
            gammas = heads.select("lang", F.lit(9 + order).alias("kind"), F.col("head").alias("key"),
                                  F.col("gamma").alias("p"))
        below = materialise(p)
        part = below.select("lang", F.lit(order).alias("kind"), F.col("gram").alias("key"), "p").unionByName(gammas)
        entries = part if entries is None else entries.unionByName(part)
    return materialise(entries.select("lang", "kind", "key", F.log("p").alias("value")))


class Scorer:
    """Log probabilities of the characters of texts, for one language and shard."""

    def __init__(self, entries: dict[int, tuple[np.ndarray, np.ndarray]], shard: int, shards: int):
        empty = (np.empty(0, dtype=U64), np.empty(0))
        self.tables = {k: Lookup(*entries.get(k, empty)) for k in (1, 2, 3, 4, 11, 12, 13)}
        self.unseen = float(entries[10][1][0]) if 10 in entries else None
        self.shard, self.shards = shard, shards

    def log_p(self, chars: np.ndarray) -> np.ndarray:
        """For each character from the fourth on; 0 for starts and other shards' characters."""
        keys = grams(chars)
        near, far = chars[ORDER - 2 : -1].astype(np.int64), chars[ORDER - 3 : -2].astype(np.int64)
        places = np.nonzero((chars[ORDER - 1 :] != 0) & ((far * SPREAD + near) % self.shards == self.shard))[0]
        out = np.zeros(len(keys))
        keys = keys[places]
        value = self.tables[ORDER].get(keys)
        weight = np.zeros(len(keys))
        left = np.nonzero(np.isnan(value))[0]
        for order in range(ORDER - 1, 0, -1):
            if not len(left):
                break
            tail = keys[left] & U64((1 << (BITS * (order + 1))) - 1)
            # The context that failed gives its weight; one never seen gives all.
            gamma = self.tables[10 + order].get(tail >> U64(BITS))
            weight[left] += np.where(np.isnan(gamma), 0.0, gamma)
            value[left] = weight[left] + self.tables[order].get(tail & U64((1 << (BITS * order)) - 1))
            left = left[np.isnan(value[left])]
        value[left] = weight[left] + self.unseen
        out[places] = value
        return out


def _shard_of(kind: Column, key: Column, shards: int) -> Column:
    """The shard of what is looked up behind the entry's last two characters of context."""
    context = F.when(kind >= 10, key).otherwise(F.shiftrightunsigned(key, BITS))
    one = F.lit((1 << BITS) - 1)
    far = F.shiftrightunsigned(context, BITS).bitwiseAND(one)
    return F.pmod(far * SPREAD + context.bitwiseAND(one), F.lit(shards))


def _shard_count(entries: DataFrame, shard_entries: int) -> int:
    """So many shards that none has more than `shard_entries`, or that more would not help."""
    def largest(shards: int) -> int:
        sizes = entries.groupBy(_shard_of(F.col("kind"), F.col("key"), shards).alias("s")).count()
        return sizes.agg(F.max("count")).first()[0] or 0

    shards = max(1, -(-entries.count() // shard_entries))
    size = largest(shards) if shards > 1 else 0
    while size > shard_entries:
        # Where a doubling takes less than a tenth off, one pair of characters fills a shard.
        halved = largest(2 * shards)
        if halved > 0.9 * size:
            break
        shards, size = 2 * shards, halved
    return shards


def log_likelihoods(docs: DataFrame, entries: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(row, mark, lang, nll, chars, blocks) for each row of (row, mark, lang, text).

    `blocks` has the nll of each of the text's blocks, which are equally long but for
    rounding. Both are null where there is no text or no model. Shards are counted before
    they are sent.
    """
    spark = docs.sparkSession
    low = F.col("kind").isin(1, 2, 10, 11)
    shards = _shard_count(entries.filter(~low), shard_entries)
    shard = _shard_of(F.col("kind"), F.col("key"), shards)
    kind = dict(docs.dtypes)["row"]

    def scan(number: int) -> DataFrame:
        held = _columns(entries.filter(low | (shard == number)).select("lang", "kind", "key", "value"))
        sent = spark.sparkContext.broadcast(held)

        def run(batches):
            scorers = {}
            for language, parts in sent.value.items():
                scorers[language] = Scorer(parts, number, shards)
            for batch in batches:
                nll, blocks = [None] * len(batch["row"]), [None] * len(batch["row"])
                for language, places in by_language(batch).items():
                    if language not in scorers:
                        continue
                    for few in _slices(places, batch["text"]):
                        texts = [batch["text"][i] for i in few]
                        chars, starts = symbols(texts)
                        log_p = scorers[language].log_p(chars)
                        edges, stops = block_starts(starts, np.array([len(t) for t in texts]))
                        parts = -np.add.reduceat(log_p, edges)
                        for i, total, part in zip(few, np.add.reduceat(log_p, starts).tolist(),
                                                  np.split(parts, stops[:-1]), strict=True):
                            nll[i], blocks[i] = -total, part
                yield {"row": batch["row"], "mark": batch["mark"], "lang": batch["lang"], "nll": nll,
                       "chars": [len(t or "") for t in batch["text"]], "blocks": blocks}

        return map_rows(docs, run, f"row {kind}, mark bigint, lang string, nll double, chars bigint, "
                                   "blocks array<double>")

    if shards == 1:
        return scan(0)
    every = scan(0)
    for number in range(1, shards):
        every = every.unionAll(scan(number))
    # Equal rows are added up together and counted out again.
    met = every.groupBy("row", "mark", "lang", "chars").agg(
        F.sum("nll").alias("nll"), F.count(F.lit(1)).alias("scans"), F.collect_list("blocks").alias("parts"))
    times = (F.col("scans") / shards).cast("int")
    added = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.get("parts", F.lit(0)),
                        lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return met.select("row", "mark", "lang", (F.col("nll") / times).alias("nll"), "chars",
                      F.transform(added, lambda x: x / times).alias("blocks"),
                      F.explode(F.sequence(F.lit(1), times))).drop("col")


def block_starts(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of texts start, and the number of blocks up to the end of each text."""
    amount = np.maximum(1, (sizes + BLOCK // 2) // BLOCK)
    stops = np.cumsum(amount)
    number = np.arange(int(stops[-1])) - np.repeat(stops - amount, amount)
    return np.repeat(starts, amount) + number * np.repeat(sizes, amount) // np.repeat(amount, amount), stops


def _worst() -> tuple[Column, Column]:
    """(nll, characters) of the worst passage; that of a text of one block is the text."""
    blocks, count = F.col("blocks"), F.size("blocks")
    pairs = F.zip_with(F.slice(blocks, 1, F.greatest(count - 1, F.lit(0))), F.slice(blocks, 2, F.greatest(count - 1, F.lit(0))),
                       lambda a, b: a + b)
    return F.when(count > 1, F.array_max(pairs)).otherwise(F.get(blocks, F.lit(0))), F.col("chars") * F.least(F.lit(1.0), 2.0 / count)


def _slices(places: list[int], texts: list[str], limit: int = 400_000):
    """Rows of about `limit` characters at a time, so that arrays stay small."""
    few, size = [], 0
    for i in places:
        few.append(i)
        size += len(texts[i])
        if size >= limit:
            yield few
            few, size = [], 0
    if few:
        yield few


def _columns(entries: DataFrame) -> dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]:
    got = entries.toArrow()
    language = np.array(got["lang"].to_pylist(), dtype=object)
    kind, key = got["kind"].to_numpy(), got["key"].to_numpy().view(U64)
    value = got["value"].to_numpy()
    out: dict[str, dict] = {}
    for name in set(language):
        here = language == name
        out[name] = {int(k): (key[here & (kind == k)], value[here & (kind == k)]) for k in set(kind[here])}
    return out


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    trusted_id_col: str = "doc_id",
    *,
    quantile: float = 0.99,
    slack: float = 1.1,
    prior_chars: int = 50,
    shard_entries: int = SHARD_ENTRIES,
) -> DataFrame:
    """(id, mark, lang, chars, perplexity, threshold, worst, worst_threshold, rejected) for each input row.

    `trusted` holds the ids of trusted documents. A document is rejected when its
    perplexity, or that of its worst passage, exceeds `slack` times the `quantile` of its
    language's trusted documents.
    `mark` is the xxhash64 of the text, which tells rows of one id apart.
    """
    rows = named(docs, row=id_col, text=text_col, lang=lang_col)
    rows = rows.select("row", "text", F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    # The same plan at every size: the labels grow with the data and are never broadcast.
    known = named(trusted, row=trusted_id_col).distinct().hint("merge")
    fold = F.pmod("mark", F.lit(2)).cast("string")
    entries = model(rows.join(known, "row", "left_semi").select(F.concat("lang", fold).alias("lang"), "text"))
    # A model's name is its language and fold; a language has two at most.
    names = F.col("lang")
    have = entries.filter("kind = 10").select(F.expr("left(lang, length(lang) - 1)").alias("lang"),
                                              F.right(names, F.lit(1)).alias("fold"))
    have = have.groupBy("lang").agg(F.array_sort(F.collect_set("fold")).alias("folds"))
    other = F.when(fold == "0", "1").otherwise("0")
    rows = rows.join(F.broadcast(have), "lang", "left").select(
        "row", "mark", F.concat("lang", F.when(F.size("folds") == 1, F.get("folds", F.lit(0))).otherwise(other)).alias("lang"),
        "text")
    worst_nll, worst_chars = _worst()
    scored = materialise(log_likelihoods(rows, entries, shard_entries).select(
        "row", "mark", F.expr("left(lang, length(lang) - 1)").alias("lang"), "nll", "chars",
        worst_nll.alias("worst_nll"), worst_chars.alias("worst_chars")))

    good = scored.join(known, "row", "left_semi").filter(F.col("nll").isNotNull())
    means = good.groupBy("lang").agg((F.sum("nll") / F.sum("chars")).alias("mean"))

    def shrunk(frame: DataFrame) -> DataFrame:
        def level(nll: str, chars: str) -> Column:
            return (F.col(nll) + prior_chars * F.col("mean")) / (F.col(chars) + prior_chars)

        return frame.join(F.broadcast(means), "lang", "left").withColumn("level", level("nll", "chars")).withColumn(
            "worst_level", level("worst_nll", "worst_chars"))

    def limits(level: str, name: str) -> DataFrame:
        bins = shrunk(good).groupBy("lang", F.floor(F.col(level) / BIN).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"))
        all_bins = bins.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"),
                                            F.sum("n").alias("all"))
        seen = F.aggregate(
            "bins", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("bin")),
            lambda a, b: F.struct(
                (a["n"] + b["n"]).alias("n"),
                F.coalesce(a["bin"], F.when(a["n"] + b["n"] >= F.col("all") * quantile, b["bin"])).alias("bin")))
        return all_bins.select("lang", (F.exp((seen["bin"] + 1) * BIN) * slack).alias(name))

    out = shrunk(scored).join(F.broadcast(limits("level", "threshold")), "lang", "left")
    out = out.join(F.broadcast(limits("worst_level", "worst_threshold")), "lang", "left")
    perplexity, worst = F.exp("level"), F.exp("worst_level")
    return out.select(
        F.col("row").alias(id_col), "mark", F.nullif("lang", F.lit(NO_LANGUAGE)).alias(lang_col), "chars",
        perplexity.alias("perplexity"), "threshold", worst.alias("worst"), "worst_threshold",
        F.coalesce((perplexity > F.col("threshold")) | (worst > F.col("worst_threshold")), F.lit(False)).alias("rejected"))


def without_rejected(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", trusted_id_col: str = "doc_id", **settings) -> DataFrame:
    """`docs` without the rows that `classify` rejects; columns as given."""
    found = classify(docs, trusted, id_col, text_col, lang_col, trusted_id_col, **settings)
    bad = found.filter("rejected").select(F.col(id_col).alias("bad_id"), F.col("mark").alias("bad_mark")).distinct().hint("merge")
    mark = F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit("")))
    return docs.join(bad, docs[f"`{id_col}`"].eqNullSafe(F.col("bad_id")) & (mark == F.col("bad_mark")), "left_anti")
