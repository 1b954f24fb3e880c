"""Runs of repeated word sequences, found in a grammar of each text.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are equal) and at least ``max(6, 4 * q)`` words that no neighbouring word
extends. The words of a text become numbers, and Re-Pair turns them into a
grammar:

1. The most frequent pair of neighbouring symbols becomes a new nonterminal,
   again and again, until no pair occurs ``LEAST_PAIRS`` times. In one round all
   pairs are replaced that are more frequent than every pair that shares a
   symbol with them: they stand apart, so the order among them does not matter.
   What remains is joined by a balanced binary tree, whose nodes are
   nonterminals as well.
2. For each nonterminal, runs that cross the boundary of its two parts are
   computed once, at its first place in the text. At least two periods of such
   a run lie on one side of the boundary, so a period is tried only if the
   word at the boundary equals the word one period away; prefix hashes then give
   the extent.
3. What a nonterminal holds is translated to all places where it was derived.
   The smallest nonterminal around a run holds it whole; cuttings that other
   nonterminals hold are maximal in them, not in the text, and merge with it:
   only stretches that no neighbouring word extends stay, each with its smallest
   period. Each extent is read off the words again, so that a collision of
   hashes cannot show.

Texts of a batch go through the rounds together, about ``BATCH_WORDS`` words at
a time; the memory of a task follows that number or the longest text, not the
table. No shuffle.

Defined cases: null and empty texts and texts of blanks have no words and no
run; rows that repeat an id are treated one by one; an empty table gives an
empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import words

LEAST_WORDS = 6
LEAST_PERIODS = 4
LEAST_PAIRS = 3
BATCH_WORDS = 200_000
# Words compared one by one before an extent is looked up by hashes.
_STEPS = 8
TRIED_AT_ONCE = 2_000_000
# Two primes below 2**31 and the bases of the prefix hashes.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)

SCHEMA = (
    "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint,"
    " exponent_milli bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>,"
    " collapsed string"
)


def planted(parts: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth text, by the checksum of its id, goes on periodically from some word.

    The rule of the query's contract. A null id has no checksum and changes nothing.
    """
    n = len(parts)
    if doc_id is None or not n:
        return parts
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return parts
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = parts[a : a + p]
    return parts[:a] + (unit * ((n - a) // p + 1))[: n - a]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts one after the other, equal only within a text; offsets."""
    fresh = count()
    ids = np.concatenate(
        [
            np.fromiter(map(defaultdict(fresh.__next__).__getitem__, t), np.int64, len(t))
            for t in texts
        ]
        or [np.empty(0, np.int64)]
    )
    return ids, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


class Grammar:
    """Re-Pair over the texts of a batch: rules with their places, and what remains.

    ``low``, ``cut`` and ``high`` bound a rule's first place and the border of its
    parts; ``places[first[r] : first[r + 1]]`` are the places of rule ``r``.
    ``left`` is the sequence that remains, as places of its symbols.
    """

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, least: int = LEAST_PAIRS):
        n = len(ids)
        symbol = np.concatenate([ids, [-1]])
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        ends = np.zeros(n + 1, bool)  # last symbol of its text
        ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
        alive = np.ones(n + 1, bool)
        size = [np.ones(int(ids.max()) + 1 if n else 0, np.int64)]
        known = len(size[0])
        rules, places = [], []
        often = np.bincount(ids, minlength=known) >= least
        at = np.flatnonzero(~ends[:n])
        at = at[often[symbol[at]] & often[symbol[after[at]]]]
        while len(at):
            key = (symbol[at] << 32) | symbol[after[at]]
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            at, group, counts = _apart(at, key, new, after)
            fit = counts >= least
            at = at[fit[group]]
            if not len(at):
                break
            group = (np.cumsum(fit) - 1)[group[fit[group]]]
            counts = counts[fit]
            head = np.concatenate([[0], np.cumsum(counts)[:-1]])
            x, y = symbol[at[head]], symbol[after[at[head]]]
            # Counts first; equal ones by chance, or a chain of pairs would go one by one.
            chance = words.mixed(((x << 32) | y).astype(np.uint64)).argsort().argsort()
            rank = counts * len(counts) + chance
            best = np.zeros(known, np.int64)
            np.maximum.at(best, x, rank)
            np.maximum.at(best, y, rank)
            chosen = (best[x] == rank) & (best[y] == rank)
            sizes = np.concatenate(size) if len(size) > 1 else size[0]
            wide, first = sizes[x[chosen]], at[head[chosen]]
            total = wide + sizes[y[chosen]]
            rules.append(np.stack([first, first + wide, first + total]))
            taken = chosen[group]
            here = at[taken]
            places.append((here, counts[chosen]))
            gone = after[here]
            symbol[here] = (known + np.cumsum(chosen) - 1)[group[taken]]
            ends[here] = ends[gone]
            alive[gone] = False
            after[here] = after[gone]
            before[after[here]] = here
            known += int(chosen.sum())
            size = [sizes, total]
            ahead = before[here]
            near = np.concatenate([at[~taken], here, ahead[ahead >= 0]])
            near = np.unique(near[alive[near]])
            at = near[~ends[near]]
        self.low, self.cut, self.high = (
            np.concatenate([r[k] for r in rules] or [np.empty(0, np.int64)]) for k in range(3)
        )
        self.places = np.concatenate([p for p, _ in places] or [np.empty(0, np.int64)])
        counts = np.concatenate([c for _, c in places] or [np.empty(0, np.int64)])
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.left = np.flatnonzero(alive[:n])


def _apart(
    at: np.ndarray, key: np.ndarray, new: np.ndarray, after: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that do not overlap, sorted by pair; their pair's number; counts by pair.

    Only a pair of equal symbols overlaps itself: in a chain every other place counts.
    """
    group = np.cumsum(new) - 1
    follows = np.zeros(len(at), bool)
    follows[1:] = ~new[1:] & (at[1:] == after[at[:-1]])
    if follows.any():
        starts = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
        keep = (np.arange(len(at)) - starts) % 2 == 0
        at, group = at[keep], group[keep]
    return at, group, np.bincount(group, minlength=int(new.sum()))


def tree_nodes(
    left: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds and borders of the balanced trees over what remains of each text."""
    roots = np.searchsorted(left, offsets)  # first symbol of each text
    sizes = np.diff(roots)
    text = np.repeat(np.arange(len(sizes)), sizes)
    t = np.arange(len(left)) - roots[text]
    inner = t > 0
    t, text = t[inner], text[inner]
    half = t & -t
    edge = np.concatenate([left, offsets[-1:]])
    end = np.minimum(t + half, sizes[text]) + roots[text]
    last = end == roots[text + 1]
    high = np.where(last, offsets[text + 1], edge[end])
    return edge[roots[text] + t - half], edge[roots[text] + t], high


class Hashes:
    """Prefix hashes under two primes: equality of two stretches in constant time."""

    def __init__(self, ids: np.ndarray):
        self.parts = []
        mixed = words.mixed(ids.astype(np.uint64) + np.uint64(1))
        for prime, base in zip(PRIMES, BASES, strict=True):
            p = np.uint64(prime)
            power = np.ones(len(ids) + 1, np.uint64)
            done, step = 1, np.uint64(base)
            while done < len(power):
                more = min(done, len(power) - done)
                power[done : done + more] = power[:more] * step % p
                done, step = done + more, step * step % p
            total = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(mixed % p * power[:-1] % p, out=total[1:])
            self.parts.append((p, power, total))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at ``i`` and, behind it, at ``j`` are equal."""
        same = np.ones(len(i), bool)
        for p, power, total in self.parts:
            a = (total[i + length] - total[i]) % p * power[j - i] % p
            same &= a == (total[j + length] - total[j]) % p
        return same

    def ahead(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and ``j`` on are equal, ``most`` at most."""
        return self._search(most, lambda n: self.equal(i, j, n))

    def back(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``i`` and ``j`` are equal, ``most`` at most."""
        return self._search(most, lambda n: self.equal(i - n, j - n, n))

    def _search(self, most: np.ndarray, test) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            fits = test(mid)
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        return low


def _tried(
    ids: np.ndarray, nodes: np.ndarray, room: np.ndarray, cut: np.ndarray, backwards: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, period and first compared word where the words next to the border agree.

    The compared words lie on the side of the border that has to hold two periods.
    """
    node = np.repeat(nodes, room)
    q = np.arange(len(node)) - np.repeat(np.cumsum(room) - room, room) + 1
    i = cut[node] - 1 - q if backwards else cut[node]
    for step in range(_STEPS):
        at = i - np.minimum(step, q - 1) if backwards else i + np.minimum(step, q - 1)
        fits = ids[at] == ids[at + q]
        node, q, i = node[fits], q[fits], i[fits]
    return node, q, i


def crossing(
    ids: np.ndarray, low: np.ndarray, cut: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Node, start, end and period of stretches at the border of each node, cut to the node."""
    nodes = np.flatnonzero(high - low >= LEAST_WORDS)
    found = [(nodes[:0], nodes[:0], nodes[:0])]
    for backwards in (True, False):
        room = (cut - low if backwards else high - cut)[nodes] // 2
        room = np.minimum(room, (high - low)[nodes] // LEAST_PERIODS)
        part = np.cumsum(room) // TRIED_AT_ONCE
        for own in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(part)) + 1):
            found.append(_tried(ids, nodes[own], room[own], cut, backwards))
    node, q, i = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(node):
        return node, i, i, q
    hashes = Hashes(ids)
    start = i - hashes.back(i, i + q, i - low[node])
    end = i + q + hashes.ahead(i, i + q, high[node] - i - q)
    fits = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    node, start, end, q = node[fits], start[fits], end[fits], q[fits]
    # Of equal stretches of a node the smallest period counts.
    order = np.lexsort((q, end, start, node))
    node, start, end, q = node[order], start[order], end[order], q[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[new], start[new], end[new], q[new]


def runs(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of text number, start (in the text), length and period, sorted by text, start, period."""
    grammar = Grammar(ids, offsets)
    trees = tree_nodes(grammar.left, offsets)
    rules = len(grammar.low)
    low, cut, high = (
        np.concatenate([a, b])
        for a, b in zip((grammar.low, grammar.cut, grammar.high), trees, strict=True)
    )
    node, start, end, q = crossing(ids, low, cut, high)
    inside = node < rules
    many = np.ones(len(node), np.int64)
    many[inside] = np.diff(grammar.first)[node[inside]]
    each = np.repeat(np.arange(len(node)), many)
    turn = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    shift = np.zeros(len(each), np.int64)
    of_rule = inside[each]
    at = node[each[of_rule]]
    shift[of_rule] = grammar.places[grammar.first[at] + turn[of_rule]] - low[at]
    start, end, q = start[each] + shift, end[each] + shift, q[each]
    text = np.searchsorted(offsets, start, side="right") - 1
    maximal = (start == offsets[text]) | (ids[start - 1] != ids[start - 1 + q])
    maximal &= (end == offsets[text + 1]) | (
        ids[np.minimum(end, len(ids) - 1)] != ids[end - q]
    )
    text, start, end, q = text[maximal], start[maximal], end[maximal], q[maximal]
    order = np.lexsort((q, end, start))
    text, start, end, q = text[order], start[order], end[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    out = np.stack([text, start, end, q], axis=1)[new]
    true = [
        bool((ids[s : e - p] == ids[s + p : e]).all()) for _, s, e, p in out.tolist()
    ]
    out = out[np.array(true, bool)]
    out[:, 2] -= out[:, 1]
    out[:, 1] -= offsets[out[:, 0]]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Mask of words that no run holds beyond its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, found[:, 1] + found[:, 3], 1)
    np.add.at(depth, found[:, 1] + found[:, 2], -1)
    return np.cumsum(depth[:-1]) == 0


def _rows(doc_ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
    ids, offsets = numbered(texts)
    found = runs(ids, offsets) if len(ids) else np.empty((0, 4), np.int64)
    border = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    columns: list[list] = [[] for _ in range(9)]
    for k, parts in enumerate(texts):
        own = found[border[k] : border[k + 1]]
        best = (None,) * 4
        kept = parts
        if len(own):
            # Sorted by start and period: the first of the longest.
            _, s, length, p = own[np.argmax(own[:, 2])].tolist()
            best = (s, length, p, 1000 * length // p)
            mask = kept_words(len(parts), own)
            kept = [w for w, m in zip(parts, mask.tolist(), strict=True) if m]
        listed = [{"start": s, "length": n, "period": p} for _, s, n, p in own.tolist()]
        values = (doc_ids[k], len(parts), len(own), *best, listed, b" ".join(kept))
        for column, value in zip(columns, values, strict=True):
            column.append(value)
    run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
    kinds = [pa.int64()] * 7 + [pa.list_(run), pa.binary()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    arrays[-1] = arrays[-1].cast(pa.string())
    return pa.RecordBatch.from_arrays(arrays, names)


def _find(changed: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            doc_ids: list[int | None] = []
            texts: list[list[bytes]] = []
            held = 0
            rows = zip(batch.column(0).to_pylist(), words.texts_of(batch.column(1)), strict=True)
            for doc_id, body in rows:
                parts = words.split(body)
                doc_ids.append(doc_id)
                texts.append(planted(parts, doc_id) if changed else parts)
                held += len(parts)
                if held >= BATCH_WORDS:
                    yield _rows(doc_ids, texts)
                    doc_ids, texts, held = [], [], 0
            if texts:
                yield _rows(doc_ids, texts)

    return search


def find_runs(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", changed: bool = False
) -> DataFrame:
    """Every text's runs, its longest run (first start, then period), and what collapses to.

    ``changed`` first plants periodic tails by the rule of ``planted``.
    """
    rows = docs.select(
        F.col(row_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    return rows.mapInArrow(_find(changed), SCHEMA)


def listing(runs_column: str = "runs"):
    """Every run as a line ``start,length,period``, by start, then period."""
    line = F.transform(
        F.col(runs_column),
        lambda r: F.concat(
            F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]), F.lit("\n")
        ),
    )
    return F.array_join(line, "")
