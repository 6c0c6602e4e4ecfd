"""Secret scans: fixed patterns, and Markov models that tell random strings from names.

Two first-order character models are counted from labelled samples, random strings
and ordinary identifiers. A stretch of identifier characters, anywhere in a run of them
and of any length, is reported when the log-likelihood ratio of the two models exceeds a
threshold; it is widened to the whole letters and digits around it. Spans that a fixed
pattern found stay as they are, and the models add others in what lies beside them.

Scale: one pass counts, one pass scores. Training counts are summed per task into
2 x 96 x 96 cells before they are shuffled; the summed cells are all that reaches
the driver and is broadcast, whatever the input size. Texts never move.

Defined cases: a null or empty text has no span. Without samples both models are
uniform, the ratio is 0 and nothing is added. Repeated rows each come back.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktide.llm.frames import map_rows, named

# Fixed patterns of the contract.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = re.compile(r"(?i)password|passwd|secret|token|api", re.ASCII)
KINDS = ("assign", "access", "hex", "markov")

CELLS = 96  # printable ASCII, and one cell for the start of a string
BACKOFF = 10.0  # weight of the fallback, in transitions
IDENTIFIER = np.array([chr(c) in "+/_=-" or chr(c).isalnum() for c in range(128)] + [False])

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if KEYWORDS.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def codes(string: str) -> np.ndarray:
    """Cells of a string's ASCII characters, after one for its start."""
    raw = np.frombuffer(string.encode("ascii", "replace"), dtype=np.uint8).astype(np.int64)
    return np.concatenate(([0], np.clip(raw - 31, 1, CELLS - 1)))


def transitions(string: str) -> np.ndarray:
    at = codes(string)
    return at[:-1] * CELLS + at[1:]


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(cell, label, n): transitions of strings that the text itself labels.

    Values that a fixed pattern gives away are random strings (label 1); other runs of
    identifier characters, of two or more, are ordinary (label 0).
    """
    rows = named(docs, text=text_col)
    other = re.compile(r"[A-Za-z0-9+/_=-]{2,}")

    def count(batches):
        cells = np.zeros((2, CELLS * CELLS), dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                if not text:
                    continue
                spans = base_spans(text)
                taken = [text]
                if spans:
                    for start, end, kind in spans:
                        value = text[start:end]
                        value = ASSIGN.match(value)[2] if kind == "assign" else value
                        cells[1] += np.bincount(transitions(value), minlength=CELLS * CELLS)
                    edges = sorted((start, end) for start, end, _ in spans)
                    taken, at = [], 0
                    for start, end in edges:
                        taken.append(text[at:max(start, at)])
                        at = max(at, end)
                    taken.append(text[at:])
                # Joined by a blank, whose cell stands for the start of the next string.
                runs = " ".join(run for part in taken for run in other.findall(part))
                raw = np.frombuffer(runs.encode("ascii"), dtype=np.uint8).astype(np.int64)
                at = np.concatenate(([0], np.where(raw == 32, 0, np.clip(raw - 31, 1, CELLS - 1))))
                pairs = (at[:-1] * CELLS + at[1:])[at[1:] > 0]
                cells[0] += np.bincount(pairs, minlength=CELLS * CELLS)
        label, cell = np.nonzero(cells)
        yield {"cell": cell.tolist(), "label": label.tolist(), "n": cells[label, cell].tolist()}

    return map_rows(rows, count, "cell int, label int, n bigint")


def train(samples: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each transition; `samples` has (cell, label, n) or (string, label).

    At most 2 x 96 x 96 sums come back to the driver.
    """
    if "string" in samples.columns:
        def count(batches):
            for batch in batches:
                sums = defaultdict(int)
                for string, label in zip(batch["string"], batch["label"], strict=True):
                    if string is not None and label is not None:
                        for cell in transitions(string).tolist():
                            sums[cell, int(label)] += 1
                yield {"cell": [c for c, _ in sums], "label": [k for _, k in sums],
                       "n": list(sums.values())}

        samples = map_rows(named(samples, string="string", label="label"), count,
                           "cell int, label int, n bigint")
    counts = np.zeros((2, CELLS, CELLS))
    for cell, label, n in samples.groupBy("cell", "label").agg(F.sum("n")).collect():
        counts[label].flat[cell] += n
    # A transition falls back on how common the second character is, and that on one of each.
    single = counts.sum(axis=1, keepdims=True) + 1.0
    single /= single.sum(axis=2, keepdims=True)
    logs = np.log((counts + BACKOFF * single) / (counts.sum(axis=2, keepdims=True) + BACKOFF))
    return (logs[1] - logs[0]).ravel()


def score(string: str, ratio: np.ndarray) -> float:
    return float(ratio[transitions(string)].sum())


def stretches(text: str, taken: list[tuple[int, int]], ratio: np.ndarray, min_score: float) -> list[tuple[int, int]]:
    """Spans outside `taken` whose best-scoring stretch reaches `min_score`, in order."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.where(IDENTIFIER[np.minimum(raw, len(IDENTIFIER) - 1)], np.clip(raw.astype(np.int64) - 31, 1, CELLS - 1), 0)
    for start, end in taken:
        at[start:end] = 0
    # The character after a break starts a string of its own.
    step = ratio[np.concatenate(([0], at[:-1])) * CELLS + at]
    inside = np.concatenate(([False], at > 0, [False]))
    edges = np.nonzero(inside[1:] != inside[:-1])[0]
    begins, ends = edges[::2], edges[1::2]
    # No stretch scores more than the gains of its run. Single characters are not counted by
    # `labelled_samples`, so they have no score.
    gains = np.concatenate(([0.0], np.cumsum(np.maximum(step, 0.0) * (at > 0))))
    near = (gains[ends] - gains[begins] >= min_score - 1e-6) & (ends - begins > 1)
    out: list[tuple[int, int]] = []
    todo = list(zip(begins[near].tolist(), ends[near].tolist(), strict=True))
    while todo:
        low, high = todo.pop()
        if low >= high:
            continue
        # Maximum-sum segment.
        sums = np.concatenate(([0.0], np.cumsum(step[low:high])))
        least = np.minimum.accumulate(sums[:-1])
        end = int(np.argmax(sums[1:] - least))
        if sums[end + 1] - least[end] < min_score:
            continue
        first, last = low + int(np.argmin(sums[: end + 1])), low + end + 1
        while first > low and text[first - 1].isalnum():
            first -= 1
        while last < high and text[last].isalnum():
            last += 1
        out.append((first, last))
        todo += [(low, first), (last, high)]
    return sorted(out)


def secret_spans(
    docs: DataFrame,
    ratio: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_score: float = 14.0,
) -> DataFrame:
    """(id, spans) for each input row; a span is (start, end, kind) in code points.

    `min_score` is the log-likelihood ratio from which a string counts as random; it
    stands for prior odds of a million to one.
    """
    rows = named(docs, row=id_col, text=text_col)
    kind = dict(rows.dtypes)["row"]
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def look(batches):
        table = sent.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                spans = base_spans(text) if text else []
                taken = [s[:2] for s in spans]
                if text:
                    spans += [(a, b, "markov") for a, b in stretches(text, taken, table, min_score)]
                spans.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                out.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
            yield {"row": batch["row"], "spans": out}

    schema = f"row {kind}, spans array<struct<start:int,end:int,kind:string>>"
    return map_rows(rows, look, schema).select(F.col("row").alias(id_col), "spans")
