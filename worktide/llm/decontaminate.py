"""Benchmark decontamination: Wu-Manber search for benchmark passages in documents.

A benchmark item is cut into windows of `window` words; a shorter item is one
window. All windows of a length make one search: a shift table over blocks of two
words says how far the search may jump when the block at hand ends no window soon,
a bucket of windows is chosen by the last block, and the words are then compared
one by one. Words stand where the classic form has characters.

Scale: documents are read once for each block of windows, never shuffled by a
benchmark word. Blocks hold at most about `block_windows` (window, item) rows, so
what is broadcast has a fixed bound; a larger benchmark takes more blocks, and a
window that very many items share is spread over blocks too. Hits of a document
from several blocks meet by row. Lost executors repeat their scan.

Defined cases: a null or empty text has no words and no hit. Repeated rows each
come back. Items without words have no window; repeated item rows count once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktide.llm.frames import capitals_free, map_rows, materialise, named

# Digits, a-z and everything beyond ASCII, in UTF-8 with A-Z lower-cased.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK_WINDOWS = 200_000

Words = tuple[bytes, ...]


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(capitals_free(text)) if text else []


class Search:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, windows: dict[Words, list[str]]):
        self.length = length
        self.block = block = min(2, length)
        self.jump = length - block + 1
        self.shift: dict[Words, int] = {}
        self.bucket: dict[Words, list[tuple[Words, list[str]]]] = defaultdict(list)
        for words, items in windows.items():
            for end in range(block, length + 1):
                key = words[end - block : end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.bucket[words[-block:]].append((words, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of every occurrence."""
        length, block, jump, shift = self.length, self.block, self.jump, self.shift.get
        end, last = length, len(words)
        while end <= last:
            key = tuple(words[end - block : end])
            step = shift(key, jump)
            if step:
                end += step
                continue
            here = tuple(words[end - length : end])
            for candidate, items in self.bucket[key]:
                if candidate == here:
                    yield end - length, items
            end += 1


def searches(rows: list[tuple[list[bytes], str]]) -> list[Search]:
    by_length: dict[int, dict[Words, list[str]]] = defaultdict(lambda: defaultdict(list))
    for words, item in rows:
        by_length[len(words)][tuple(words)].append(item)
    return [Search(n, windows) for n, windows in sorted(by_length.items())]


def spans_and_items(words: list[bytes], tables: list[Search]) -> tuple[list[int], list[str]]:
    """Flat start, end pairs of merged hit stretches, and the items that were met."""
    found, items = [], set()
    for table in tables:
        for start, owners in table.find(words):
            found.append((start, start + table.length))
            items.update(owners)
    merged: list[int] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged, sorted(items)


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, words) for each distinct window of each item; runs in parts of an item's words."""

    def cut(batches):
        for batch in batches:
            out = {"item": [], "words": []}
            for item, text in zip(batch["item"], batch["text"], strict=True):
                words = words_of(text)
                size = min(window, len(words))
                for at in range(len(words) - size + 1 if words else 0):
                    out["item"].append(item)
                    out["words"].append(words[at : at + size])
            yield out

    return map_rows(items, cut, "item string, words array<binary>").distinct()


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    *,
    window: int = 10,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """(id, n_words, spans, items) for each input row.

    `spans` holds start and end word numbers of the hit stretches in turn, `items` the
    ids (as sorted strings) of the items with a window in the text.
    """
    spark = docs.sparkSession
    rows = named(docs, row=id_col, text=text_col)
    kind = dict(rows.dtypes)["row"]
    bench = named(items, item=item_id_col, text=item_text_col)
    bench = bench.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text")
    cut = materialise(item_windows(bench, window))
    blocks = max(1, -(-cut.count() // block_windows))
    placed = cut.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))

    def scan(block: int) -> DataFrame:
        # At most about block_windows rows of a few words: the bound of what is sent.
        held = [([bytes(w) for w in r.words], r.item)
                for r in placed.filter(F.col("block") == block).collect()]
        sent = spark.sparkContext.broadcast(held)

        def look(batches):
            tables = searches(sent.value)
            for batch in batches:
                out = {"row": batch["row"], "n_words": [], "spans": [], "items": []}
                for text in batch["text"]:
                    words = words_of(text)
                    spans, owners = spans_and_items(words, tables)
                    out["n_words"].append(len(words))
                    out["spans"].append(spans)
                    out["items"].append(owners)
                if blocks > 1:
                    out["copy"] = batch["copy"]
                yield out

        schema = f"row {kind}, n_words bigint, spans array<int>, items array<string>"
        return map_rows(rows, look, schema + ", copy string" * (blocks > 1))

    if blocks > 1:
        # Texts of one id are told apart by their content; equal rows are counted again below.
        rows = rows.withColumn("copy", F.sha2(F.coalesce("text", F.lit("")), 256))
        every = scan(0)
        for block in range(1, blocks):
            every = every.unionAll(scan(block))
        met = every.groupBy("row", "copy").agg(
            F.max("n_words").alias("n_words"),
            (F.count(F.lit(1)) / blocks).cast("int").alias("times"),
            F.sort_array(F.collect_set(F.struct("spans"))).alias("stretches"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        merged = map_rows(met, _merge, f"row {kind}, n_words bigint, spans array<int>, "
                                       "items array<string>, times int")
        out = merged.select("row", "n_words", "spans", "items",
                            F.explode(F.sequence(F.lit(1), F.col("times"))))
    else:
        out = scan(0)
    return out.select(F.col("row").alias(id_col), "n_words", "spans", "items")


def _merge(batches):
    for batch in batches:
        spans = []
        for stretches in batch["stretches"]:
            merged: list[int] = []
            pairs = [p for s in stretches for p in zip(s["spans"][::2], s["spans"][1::2], strict=True)]
            for start, end in sorted(pairs):
                if merged and start <= merged[-1]:
                    merged[-1] = max(merged[-1], end)
                else:
                    merged += [start, end]
            spans.append(merged)
        yield {name: batch[name] for name in ("row", "n_words", "items", "times")} | {"spans": spans}


def without_passages(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    window: int = 10, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """`docs` without the rows that hold a benchmark passage; columns as given.

    The search reads id and text alone; only ids of contaminated rows are joined back.
    Rows are told apart by id and text, so a clean text under a reused id stays.
    """
    mark = F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit("")))
    keyed = docs.select(docs[f"`{id_col}`"].alias("row"), docs[f"`{text_col}`"].alias("text"),
                        F.struct(docs[f"`{id_col}`"].alias("id"), mark.alias("mark")).alias("key"))
    found = find_passages(keyed, items, "key", "text", window=window, block_windows=block_windows)
    bad = found.filter(F.size("spans") > 0).select(
        F.col("key.id").alias("bad_id"), F.col("key.mark").alias("bad_mark")).distinct().hint("merge")
    same = docs[f"`{id_col}`"].eqNullSafe(F.col("bad_id")) & (mark == F.col("bad_mark"))
    return docs.join(bad, same, "left_anti")
