"""SentencePiece encoding and decoding: segmentations sampled without replacement.

The vocabulary of a SentencePiece model spans a lattice over each text. Segmentations are
drawn from it by Gumbel top-k: every complete path has a Gumbel-perturbed log probability,
and a best-first (A-star) search pops paths in the order of these values without listing
them. The value of a node is the largest of all paths below it, so it is its own exact
heuristic: on expansion one child, drawn by its share, inherits it and the others get
Gumbels truncated there. The k first paths are a sample without replacement; the value of
the one after them gives each its inclusion score, 1 - exp(-exp(log p - kappa)).

Piece weights are the unigram law of `temperature` over Zipf's rule of the piece's rank,
p ~ 1 / (rank + 10), since a BPE vocabulary has ranks but no probabilities. A character
without a piece is spelled in byte pieces. A text is cut into segments only where no piece of
the vocabulary crosses: before blanks that follow another character and, in stretches of more
than 31 characters, at all places that no piece found there spans. So a text's lattice is the
product of its segments' lattices; a stretch without such a place is one segment.

The search branches piece by piece over the first segments of a text, as many as are no longer
than four short ones. All that follows is
one more node: the path drawn there and, below it, every other ending as a single node of
the remaining mass. Every path takes a drawn ending of its own; if its node has had that one,
another is drawn from the lattice without those that it has had. That is the same
distribution, and a long text costs k drawn paths.

Scale: one pass, no shuffle; a text is one row's work. Lattices of segments are computed
as arrays and kept per task up to a fixed number of nodes; all segments of a slice are worked on
together, place by place, so a slice takes as many steps as its longest segment has characters. Draws depend on the row key and
`seed` alone, not on batches or partitions, so a lost task gives the same rows again. The
vocabulary is the only thing sent; its size is fixed by the model file.

Defined cases: a null or empty text has one segmentation, without pieces. A text with
fewer than k segmentations gives them all, each with inclusion score 1. Repeated rows each
come back, with the same draws. A null key is a key of its own.
"""

from __future__ import annotations

import gc
import heapq
import math
import random
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktide.llm.frames import named
from worktide.llm.hashing import Lookup, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONGEST = 31  # segments of more characters, besides their blank, are cut where no piece crosses
HEAD = 4  # segments that the search branches over piece by piece
SHORT = 32  # in texts of at most so many segments it branches over all
NODES = 3_000_000  # lattice nodes a task keeps
LISTED = 20_000  # nodes whose arcs a task keeps as lists
SLICE = 200_000  # characters worked on at a time
PACKED = 1024  # steps of a draw that are held one by one

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15


class Vocabulary:
    """Pieces of a model file, as (text, id, weight) with blanks for the file's blank sign."""

    def __init__(self, path: str, temperature: float):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.bytes = [0] * 256
        self.spelled: list[bytes | None] = [None] * len(model)
        self.text: list[str] = [""] * len(model)
        ids, texts = [], []
        for i in range(len(model)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece.replace("▁", " ")
                ids.append(i)
                texts.append(self.text[i])
        #: Whether a piece goes on with a blank after another character.
        self.over_blanks = any(" " in text.lstrip(" ") for text in texts)
        self.ids = np.array(ids, dtype=np.int64)
        self.pieces = texts
        share = 1.0 / (np.arange(len(ids) + 256) + 10.0)
        weight = temperature * np.log(share / share.sum())
        self.weight, self.byte_weight = weight[: len(ids)], float(weight[-1])
        self.longest = max(map(len, texts))

    def decode(self, ids: list[int]) -> str:
        """Text of a piece sequence, without the blank put before every text."""
        spelled, text = self.spelled, self.text
        out = b"".join(text[i].encode() if spelled[i] is None else spelled[i] for i in ids)
        return out.decode("utf-8", "surrogatepass")[1:]

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """`decode` of many sequences, which follow each other in `ids`, as whole arrays."""
        if not hasattr(self, "blob"):
            each = [(s if s is not None else t.encode()) for s, t in zip(self.spelled, self.text, strict=True)]
            self.blob = np.frombuffer(b"".join(each), dtype=np.uint8)
            self.widths = np.array([len(x) for x in each])
            self.starts = np.cumsum(self.widths) - self.widths
        widths = self.widths[ids]
        ends = np.cumsum(widths)
        total = int(ends[-1]) if len(ends) else 0
        out = self.blob[np.repeat(self.starts[ids] - (ends - widths), widths) + np.arange(total)].tobytes()
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        return [out[a:b].decode("utf-8", "surrogatepass")[1:] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _known_ends(table: Lookup, chars: np.ndarray, place: np.ndarray, longest: int) -> Iterator[tuple]:
    """(n, ends, index) of the pieces of n characters, for n from 1; ends count from 0."""
    ends = np.nonzero(place > 0)[0]
    code = mix(chars.astype(U64) + U64(1))
    value = np.zeros(len(ends), dtype=U64)
    power = 1
    for n in range(1, longest + 1):
        value = value + code[ends - (n - 1)] * U64(power)
        power = power * BASE % 2**64
        found = table.get(mix(value + U64(n)))
        have = found >= 0
        yield n, ends[have], found[have].astype(np.int64)
        go = ~np.isnan(found) & (place[ends] > n)
        ends, value = ends[go], value[go]
        if not len(ends):
            return


class Lattices:
    """Lattices of segments: one node for each end of a piece, and an arc for each piece that ends there.

    The arcs of `node` stand at `start[node]` up to `start[node + 1]`, short ones first: `length`
    in characters, `score` the log probability of a last piece, `share` the summed probability of
    arcs up to this one (infinite at the last) and `piece` its id; characters to be spelled have
    -1 - code point. Most nodes have one or two arcs.
    """

    KEPT = {"share": np.float32, "score": np.float32, "piece": np.int32, "length": np.int8}

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        codes = "".join(vocabulary.pieces)
        chars = np.frombuffer(codes.encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(p) for p in vocabulary.pieces])
        last = np.cumsum(sizes) - 1
        code = mix(chars.astype(U64) + U64(1))
        # All that pieces end with: an end whose last n characters are none of these has no longer piece.
        value, power = np.zeros(len(sizes), dtype=U64), 1
        keys, index = [], []
        for n in range(1, vocabulary.longest + 1):
            long = np.nonzero(sizes >= n)[0]
            value[long] += code[last[long] - (n - 1)] * U64(power)
            power = power * BASE % 2**64
            keys.append(mix(value[long] + U64(n)))
            index.append(np.where(sizes[long] == n, long, -1))
        flat, held = np.concatenate(keys), np.concatenate(index)
        order = np.lexsort((-held, flat))
        flat, held = flat[order], held[order]
        one = np.concatenate(([True], flat[1:] != flat[:-1]))
        self.table = Lookup(flat[one], held[one])
        self.reset()

    def reset(self) -> None:
        self.known: defaultdict = defaultdict(count().__next__)
        self.first = np.empty(0, dtype=np.int64)
        self.sizes = np.empty(0, dtype=np.int64)
        self.uses = np.empty(0, dtype=np.int64)
        self.used = 0
        self.start = np.zeros(1, dtype=np.int64)
        for name, kind in self.KEPT.items():
            setattr(self, name, np.empty(0, dtype=kind))
        self.listed: dict[int, tuple] = {}

    def trim(self) -> None:
        """When there are too many nodes, only the segments used most stay, up to half."""
        if len(self.listed) > LISTED:
            self.listed = {}
        if self.used <= NODES:
            return
        rank = np.argsort(-self.uses, kind="stable")
        stay = np.sort(rank[np.cumsum(self.sizes[rank] + 1) <= NODES // 2])
        names = list(self.known)
        self.known = defaultdict(count(len(stay)).__next__, zip([names[i] for i in stay.tolist()], range(len(stay))))
        sizes = self.sizes[stay]
        ends = np.cumsum(sizes + 1)
        nodes = np.repeat(self.first[stay] - (ends - sizes - 1), sizes + 1) + np.arange(int(ends[-1]) if len(ends) else 0)
        arcs = self.start[nodes + 1] - self.start[nodes]
        stops = np.cumsum(arcs)
        total = int(stops[-1]) if len(stops) else 0
        kept = np.repeat(self.start[nodes] - (stops - arcs), arcs) + np.arange(total)
        for name in self.KEPT:
            table = getattr(self, name)
            table[:total] = table[kept]
        self.start[1 : len(nodes) + 1] = stops
        self.first, self.sizes, self.uses = ends - sizes - 1, sizes, self.uses[stay] // 2
        self.used, self.listed = len(nodes), {}

    def add(self, segments: list) -> None:
        """Lattices of new segments; `first` gets the node before a segment's characters.

        A string stands for itself after a blank, a tuple of one for itself alone.
        """
        words = self.vocabulary
        segments = [s[0] if isinstance(s, tuple) else " " + s for s in segments]
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        # The character before each segment only holds the place of its first node.
        chars = np.frombuffer(("\0" + "\0".join(segments)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.cumsum(sizes + 1) - sizes - 1
        total = len(chars)
        place = np.arange(total) - np.repeat(starts, sizes + 1)
        found = list(self._found(chars, place))
        amount = np.zeros(total, dtype=np.int64)
        for _, ends, _, _ in found:
            amount[ends] += 1
        # Arcs stand by the place of their node here: one place of all segments follows the other.
        order = np.argsort(place.astype(np.int16) if int(sizes.max()) < 2**15 else place, kind="stable")
        held = amount[order]
        stops = np.cumsum(held)
        begin = np.empty(total, dtype=np.int64)
        begin[order] = stops - held
        count_of = int(stops[-1])
        weight, piece = np.empty(count_of, dtype=np.float32), np.empty(count_of, dtype=np.int32)
        length, source = np.empty(count_of, dtype=np.int8), np.empty(count_of, dtype=np.int64)
        free = begin.copy()
        for n, ends, weights, ids in found:
            at = free[ends]
            weight[at], piece[at], length[at], source[at] = weights, ids, n, ends - n
            free[ends] += 1
        # Forward sums of all segmentations of a prefix, one place of all segments at a time.
        forward = np.zeros(total)
        score, part = np.empty(count_of), np.empty(count_of)
        cuts = np.searchsorted(place[order], np.arange(1, int(sizes.max()) + 2))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            here, many = order[low:high], held[low:high]
            a, b = begin[here[0]], stops[high - 1]
            heads = begin[here] - a
            logs = weight[a:b] + forward[source[a:b]]
            top = np.maximum.reduceat(logs, heads)
            parts = np.exp(logs - np.repeat(top, many))
            whole = np.add.reduceat(parts, heads)
            forward[here] = top + np.log(whole)
            score[a:b] = logs - np.repeat(forward[here], many)
            part[a:b] = parts / np.repeat(whole, many)
        summed = np.cumsum(part)
        some = held > 0
        heads = (stops - held)[some]
        share = summed - np.repeat(summed[heads] - part[heads], held[some])
        share[stops[some] - 1] = np.inf
        ends = np.cumsum(amount)
        back = np.repeat(begin - (ends - amount), amount) + np.arange(count_of)
        base, arcs = self._room(total, count_of)
        self.start[base + 1 : base + total + 1] = ends + arcs
        for name, made in (("share", share), ("score", score), ("piece", piece), ("length", length)):
            getattr(self, name)[arcs : arcs + count_of] = made[back]
        self.first = np.concatenate((self.first, starts + base))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.uses = np.concatenate((self.uses, np.zeros(len(sizes), dtype=np.int64)))

    def segments(self, texts: list[str]) -> list[list]:
        """Segments of each text: a string is one after a blank, a tuple holds what follows another cut."""
        cut = [([t] if self.vocabulary.over_blanks else cut_up(t)) if t else [] for t in texts]
        long = [c for c in cut if c and max(map(len, c)) > LONGEST]
        parts = iter(self._apart([s for c in long for s in c if len(s) > LONGEST]) if long else ())
        for c in long:
            c[:] = [part for s in c for part in (next(parts) if len(s) > LONGEST else (s,))]
        return cut

    def _apart(self, segments: list[str]) -> Iterator[list]:
        """Each segment cut at all places that no piece found in it spans."""
        held = [" " + s for s in segments]
        sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
        chars = np.frombuffer(("\0" + "\0".join(held)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.cumsum(sizes + 1) - sizes
        place = np.arange(len(chars)) - np.repeat(starts - 1, sizes + 1)
        spans = np.zeros(len(chars) + 1, dtype=np.int64)
        for n, ends, _ in _known_ends(self.table, chars, place, self.vocabulary.longest):
            if n > 1:
                # The ends of one length differ, so none is counted twice.
                spans[ends - n + 2] += 1
                spans[ends + 1] -= 1
        free = np.cumsum(spans) == 0
        for text, start, size in zip(held, starts.tolist(), sizes.tolist(), strict=True):
            cuts = [0, *(np.nonzero(free[start + 1 : start + size])[0] + 1).tolist(), size]
            parts = [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield [parts[0][1:], *((part,) for part in parts[1:])]

    def _found(self, chars: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        """(n, ends, weights, ids) of the pieces of n characters, for n from 1, where every end has one."""
        words = self.vocabulary
        for n, ends, index in _known_ends(self.table, chars, place, words.longest):
            weights, ids = words.weight[index], words.ids[index]
            if n == 1:
                bare = place > 0
                bare[ends] = False
                rest = np.nonzero(bare)[0]
                code = chars[rest].astype(np.int64)
                spelled = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                ends = np.concatenate((ends, rest))
                weights = np.concatenate((weights, spelled * words.byte_weight))
                ids = np.concatenate((ids, np.where(
                    code < 128, np.array(words.bytes)[np.minimum(code, 127)], -1 - code)))
            yield n, ends, weights, ids

    def _room(self, nodes: int, arcs: int) -> tuple[int, int]:
        """Places of the next node and arc, after room has been made for so many."""
        base, held = self.used, int(self.start[self.used])
        self.used += nodes
        for name, used, need in (("start", base + 1, base + nodes + 1), *((x, held, held + arcs) for x in self.KEPT)):
            old = getattr(self, name)
            if need > len(old):
                new = np.empty(need + need // 2, dtype=old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)
        return base, held

    def places(self, segments: list) -> tuple[np.ndarray, np.ndarray]:
        """(first node, characters) of each segment; unknown ones are added."""
        known, before = self.known, len(self.known)
        at = np.fromiter(map(known.__getitem__, segments), dtype=np.int64, count=len(segments))
        if len(known) > before:
            self.add(list(islice(reversed(known), len(known) - before))[::-1])
        self.uses += np.bincount(at, minlength=len(self.uses))
        return self.first[at], self.sizes[at]

    def arcs(self, node: int) -> tuple[list[int], list[float], list[int], list[float]]:
        """(lengths, scores, pieces, shares) of a node's arcs."""
        found = self.listed.get(node)
        if found is None:
            a, b = self.start[node], self.start[node + 1]
            found = self.listed[node] = tuple(
                table[a:b].tolist() for table in (self.length, self.score, self.piece, self.share))
        return found


def cut_up(text: str) -> list[str]:
    """Stretches of a text, each after a blank that is not part of it; all but the last blank of several begin it."""
    words = text.split(" ")
    if "" not in words:
        return words
    out, blanks = [], 0
    for word in words:
        if word:
            out.append(" " * blanks + word)
            blanks = 0
        else:
            blanks += 1
    return [*out, " " * (blanks - 1)] if blanks else out


def uniforms(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key of row, draw and segment, and on the piece."""
    bits = mix(keys + U64(step + 1))
    return (bits >> U64(11)).astype(float) * 2.0**-53 + 2.0**-54


def draw_paths(lattices: Lattices, first: np.ndarray, sizes: np.ndarray, seeds: np.ndarray,
               number: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One path of each segment by ancestral sampling: (pieces in text order, their number, log p)."""
    node = first + sizes
    who = np.arange(len(first))
    log_p = np.zeros(len(first))
    count = np.zeros(len(first), dtype=np.int64)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    packed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    done = 0

    def pack() -> None:
        """Steps as whole arrays: those of a long segment would be very many small ones."""
        sizes = [len(segment) for segment, _ in steps]
        packed.append((np.concatenate([s for s, _ in steps]), np.concatenate([p for _, p in steps]),
                       np.repeat(np.arange(done, done + len(steps)), sizes)))
        steps.clear()

    start, share, score = lattices.start, lattices.share, lattices.score
    keys = mix(seeds + U64((draw * 0x9E3779B97F4A7C15) & (2**64 - 1))) + number * U64(0xD1B54A32D192ED03)
    while len(who):
        u = uniforms(keys, done + len(steps)).astype(np.float32)
        # The first arc whose summed share exceeds u.
        at = start[node]
        late = np.nonzero(share[at] <= u)[0]
        while len(late):
            at[late] += 1
            late = late[share[at[late]] <= u[late]]
        log_p[who] += score[at]
        count[who] += 1
        steps.append((who, lattices.piece[at]))
        if len(steps) == PACKED:
            pack()
            done += PACKED
        node -= lattices.length[at]
        go = np.nonzero(node > first)[0]
        node, who, keys, first = node[go], who[go], keys[go], first[go]
    stops = np.cumsum(count)
    out = np.empty(int(stops[-1]) if len(stops) else 0, dtype=np.int64)
    for segment, piece, step in packed:
        out[stops[segment] - 1 - step] = piece
    for step, (segment, piece) in enumerate(steps, done):
        out[stops[segment] - 1 - step] = piece
    return out, count, log_p


def gumbel(rng: random.Random, log_mass: float, limit: float) -> float:
    """A Gumbel of location `log_mass`, truncated to values below `limit`."""
    free = log_mass - math.log(-math.log(rng.random() or 5e-324))
    if limit == math.inf:
        return free
    # -log(exp(-limit) + exp(-free)), without overflow
    low, high = min(limit, free), max(limit, free)
    return low - math.log1p(math.exp(low - high))


def _text_order(chain: tuple | None) -> list[int]:
    """Pieces of a chain of (rest, segment, piece), whose segments were walked from their ends."""
    by_segment: dict[int, list[int]] = {}
    while chain is not None:
        chain, segment, piece = chain
        by_segment.setdefault(segment, []).append(piece)
    return [piece for segment in sorted(by_segment) for piece in by_segment[segment]]


def _without(lattices: Lattices, tail: np.ndarray, had: list[np.ndarray]) -> tuple[list, list[float]]:
    """The steps that the endings `had` take through the lattice, and the share of other endings below each.

    A step is [segment, node, {arc: next step, or -1 at the end}], walked from the end of the
    text. Shares are sums over what the endings leave aside, so small ones are not lost in rounding.
    """
    steps: list[list] = []
    todo = [(list(range(len(had))), 0, len(tail) - 1, int(tail[-1].sum()), None, 0)]
    while todo:
        group, depth, segment, node, parent, arc = todo.pop()
        if parent is not None:
            parent[2][arc] = len(steps)
        lengths, _, piece, _ = lattices.arcs(node)
        step = [segment, node, {}]
        steps.append(step)
        taken: dict[int, list[int]] = {}
        for h in group:
            taken.setdefault(piece.index(int(had[h][-1 - depth])), []).append(h)
        for n, members in taken.items():
            place = _before(tail, segment, node - lengths[n])
            step[2][n] = -1
            if place is not None:
                todo.append((members, depth + 1, *place, step, n))
    shares = [0.0] * len(steps)
    for at in range(len(steps) - 1, -1, -1):
        _, node, after = steps[at]
        score = lattices.arcs(node)[1]
        shares[at] = math.fsum(math.exp(x) * _share(after, n, shares) for n, x in enumerate(score))
    return steps, shares


def _share(after: dict[int, int], n: int, shares: list[float]) -> float:
    at = after.get(n)
    return 1.0 if at is None else 0.0 if at < 0 else shares[at]


def _before(tail: np.ndarray, segment: int, node: int) -> tuple[int, int] | None:
    """(segment, node) where a walk from the end goes on; None at the beginning."""
    if node > tail[segment][0]:
        return segment, node
    return (segment - 1, int(tail[segment - 1].sum())) if segment else None


def other_ending(lattices: Lattices, tail: np.ndarray, had: list[np.ndarray],
                 rng: random.Random) -> tuple[float, np.ndarray]:
    """(log p, pieces) of an ending drawn by its probability among all but those in `had`."""
    steps, shares = _without(lattices, tail, had)
    at, log_p, out = 0, 0.0, []
    place: tuple[int, int] | None = (steps[0][0], steps[0][1])
    while place is not None:
        segment, node = place
        after = steps[at][2] if at is not None else {}
        lengths, score, piece, _ = lattices.arcs(node)
        n = rng.choices(range(len(score)), [math.exp(x) * _share(after, i, shares) for i, x in enumerate(score)])[0]
        log_p += score[n]
        out.append(piece[n])
        at = after.get(n)
        place = _before(tail, segment, node - lengths[n])
    return log_p, np.array(out[::-1], dtype=np.int64)


def search(lattices: Lattices, head: list[list[int]], tail: np.ndarray,
           endings: list[tuple[float, np.ndarray]], paths: int,
           rng: random.Random) -> tuple[list[tuple[list[int], np.ndarray | None, float]], float]:
    """The first `paths` paths by perturbed value, as (head pieces, ending, log p), and kappa.

    `head` has (first, size) of the segments to branch over, `tail` of those that follow.
    `endings` are (log p, pieces) of `paths` independent draws of what follows.
    """
    turn = 0
    # Entries: -value, tie, log mass, segment, node, pieces so far, endings that a head has had, their mass.
    heap = [(-gumbel(rng, 0.0, math.inf), turn, 0.0, 0, sum(head[0]) if head else 0, None, (), 0.0)]
    out: list[tuple[list[int], np.ndarray | None, float]] = []
    while heap:
        value, _, mass, segment, node, chain, had, gone = heapq.heappop(heap)
        value = -value
        if segment < len(head):
            lengths, score, piece, share = lattices.arcs(node)
            heir = bisect_right(share, rng.random())
            for n, length in enumerate(lengths):
                child = mass + score[n]
                g = value if n == heir else gumbel(rng, child, value)
                at, to = segment, node - length
                if to == head[segment][0]:
                    at += 1
                    to = sum(head[at]) if at < len(head) else 0
                turn += 1
                heapq.heappush(heap, (-g, turn, child, at, to, (chain, segment, piece[n]), (), 0.0))
            continue
        if len(out) == paths:
            return out, value
        if not len(tail):
            out.append((_text_order(chain), None, mass))
            continue
        # A draw is used once, for one path; a repeat is replaced by a draw among all others.
        log_tail, ending = endings[len(out)]
        if any(np.array_equal(ending, e) for e in had):
            log_tail, ending = other_ending(lattices, tail, list(had), rng)
        out.append((_text_order(chain), ending, mass + log_tail))
        had, gone = (*had, ending), gone + math.exp(log_tail)
        left = 1.0 - gone if gone < 0.5 else _without(lattices, tail, list(had))[1][0]
        if left > 0.0:
            turn += 1
            g = gumbel(rng, mass + math.log(left), value)
            heapq.heappush(heap, (-g, turn, mass, segment, node, chain, had, gone))
    return out, -math.inf


def _spell(ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Byte pieces in the place of characters without a piece."""
    if not (ids < 0).any():
        return ids
    out: list[int] = []
    for i in ids.tolist():
        if i < 0:
            out += [vocabulary.bytes[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
        else:
            out.append(i)
    return np.array(out)


def sample(lattices: Lattices, texts: list[str], seeds: list[int], paths: int) -> list[list[tuple]]:
    """For each text its sampled (ids, log p, inclusion score), best perturbed value first."""
    cut = lattices.segments(texts)
    amount = np.array([len(c) for c in cut])
    flat = [s for c in cut for s in c]
    if not flat:
        return [[(np.empty(0, dtype=np.int64), 0.0, 1.0)] for _ in texts]
    first, sizes = lattices.places(flat)
    spots = np.column_stack((first, sizes))
    stops = np.cumsum(amount)
    starts = stops - amount
    owner = np.repeat(np.arange(len(texts)), amount)
    number = np.arange(len(flat)) - starts[owner]
    # What the search branches over is bounded in characters too: a segment may be of any length.
    ends = np.concatenate(([0], np.cumsum(sizes)))
    sofar = ends[1:] - ends[starts[owner]]
    some = np.bincount(owner[(number < HEAD) & (sofar <= HEAD * (LONGEST + 1))], minlength=len(texts))
    short = (amount <= SHORT) & (ends[stops] - ends[starts] <= SHORT * (LONGEST + 1))
    heads = np.where(short, amount, some)
    late = np.nonzero(number >= heads[owner])[0]
    keys = np.array(seeds, dtype=U64)
    drawn = []
    for draw in range(paths if len(late) else 0):
        pieces, count, log_p = draw_paths(lattices, first[late], sizes[late], keys[owner[late]],
                                          number[late].astype(U64), draw)
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner[late], count, minlength=len(texts))))).astype(np.int64)
        drawn.append((pieces, ends, np.bincount(owner[late], log_p, minlength=len(texts))))
    results = []
    for t in range(len(texts)):
        if not amount[t]:
            results.append([(np.empty(0, dtype=np.int64), 0.0, 1.0)])
            continue
        lead, rest = slice(starts[t], starts[t] + heads[t]), slice(starts[t] + heads[t], stops[t])
        endings = [(float(log_p[t]), pieces[ends[t] : ends[t + 1]]) for pieces, ends, log_p in drawn]
        found = search(lattices, spots[lead].tolist(), spots[rest], endings, paths, random.Random(seeds[t]))
        rows = []
        for pieces, ending, log_p in found[0]:
            ids = np.array(pieces, dtype=np.int64)
            if ending is not None:
                ids = np.concatenate((ids, ending))
            inclusion = -math.expm1(-math.exp(min(log_p - found[1], 700.0)))
            rows.append((_spell(ids, lattices.vocabulary), log_p, inclusion))
        results.append(rows)
    return results


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    paths: int = 3,
    temperature: float = 0.5,
    seed: int = 0,
    model: str = MODEL,
) -> DataFrame:
    """(id, sample, ids, log_prob, inclusion, mark): `paths` rows for each input row, or fewer.

    `sample` counts from 1 in order of the perturbed values; `mark` is the xxhash64 of the text.
    """
    rows = named(docs, row=id_col, text=text_col).select(
        "row", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    kind = dict(rows.dtypes)["row"]
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(model, temperature))

    def made_of(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(sent.value)
        for batch in source:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names = batch.column("row").to_pylist()
            at, size = 0, 0
            for stop in range(1, len(texts) + 1):
                size += len(texts[stop - 1])
                if size < SLICE and stop < len(texts):
                    continue
                lattices.trim()
                keys = [xxhash.xxh3_64_intdigest(f"{seed}:{r!r}".encode()) for r in names[at:stop]]
                made = sample(lattices, texts[at:stop], keys, paths)
                place = np.repeat(np.arange(at, stop), [len(found) for found in made])
                flat = [one for found in made for one in found]
                ids = np.concatenate([one[0] for one in flat]).astype(np.int32)
                ends = np.cumsum([0] + [len(one[0]) for one in flat]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").take(pa.array(place)),
                    pa.array([n for found in made for n in range(1, len(found) + 1)], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)),
                    pa.array([one[1] for one in flat], pa.float64()),
                    pa.array([one[2] for one in flat], pa.float64()),
                    batch.column("mark").take(pa.array(place)),
                ], names=["row", "sample", "ids", "log_prob", "inclusion", "mark"])
                at, size = stop, 0

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Searches make many small tuples and no cycles: looking for cycles is some 7 % of the time.
        looked = gc.isenabled()
        gc.disable()
        try:
            yield from made_of(source)
        finally:
            if looked:
                gc.enable()

    made = rows.mapInArrow(run, f"row {kind}, sample int, ids array<int>, log_prob double, "
                                "inclusion double, mark bigint")
    return made.select(F.col("row").alias(id_col), "sample", "ids", "log_prob", "inclusion", "mark")


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "text", *, model: str = MODEL) -> DataFrame:
    """`encoded` with the text of each id sequence in `text_col` in the place of the ids."""
    rest = [c for c in encoded.columns if c not in (ids_col, text_col)]
    packed = encoded.select(F.struct(*rest).alias("rest") if rest else F.lit(None).alias("rest"),
                            F.col(ids_col).alias("ids"))
    kind = packed.schema["rest"].dataType.simpleString()
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model, 1.0))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in source:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = words.decode_all(ids.flatten().to_numpy(zero_copy_only=False), sizes)
                here = ids.is_valid().to_pylist()
                texts = pa.array([t if ok else None for t, ok in zip(texts, here, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("rest"), texts], names=["rest", "text"])

    out = packed.mapInArrow(run, f"rest {kind}, text string")
    return out.select(*[F.col(f"rest.`{c}`").alias(c) for c in rest], F.col("text").alias(text_col))
