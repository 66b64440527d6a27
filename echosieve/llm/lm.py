"""Language-model scores from a probabilistic suffix tree over words.

The symbols of a text are its words and one end. A context is the last words, back to the text's start
at most; its state holds a distribution of the next symbol. Contexts grow from frequent to longer ones,
a pass over the corpus for each length, and one becomes a state where what follows it diverges from what
its parent, the context without its first word, predicts; all suffixes of a state are states. Frequent
symbols after a state keep their discounted share, and the rest is shared as the parent shares it; at the
root, unseen words are one symbol with the share that discounting words leaves. The longest state predicts.

A window is a run of symbols of one text; without its last symbol it is the context of that symbol, without
its first one it is the same symbol after the context's parent, and a hash of the names of those two names it.

Texts are dealt into blocks, and what the corpus knows of a block's windows comes back to the block: it asks
with the sorted names of its different windows, cut by ranges into parts; a part sums the counts of all
blocks and answers each in the order it asked. A window is asked for only where both its parts are kept, so
longer windows are ever fewer (all of one or two symbols are asked for at once), and names cross the network
as plain arrays. What follows a context is summed in the same way: for a window that many blocks have, one of them
speaks, and each gets the sums of all contexts it has, whole numbers that the rest follows from, and whether what
follows diverges; as the chances after a context's parent must be known for that, contexts come a length behind
windows. At last blocks tell which contexts are suffixes of states. Each pass is written before the next, and its
shuffles deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written
from .text import COPIES, collapsed, copied, mix, word_hashes

_U = np.uint64
#: Hashes that stand for a text's start and end; no word's, but by a chance of one in 2**64.
START, END = _U(0x1B873593CC9E2D51), _U(0x85EBCA6BC2B2AE35)
_STEP = _U(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Tree:
    """How a tree is learned.

    ``depth``: words in a context at most. ``least``: how often a context, and a symbol after it, must occur
    to be kept, at any size of corpus. ``rare``: if given, a share of all training tokens that a context
    needs besides, and 16 times less a symbol after it. ``gain``: nats by which a state must describe the kept symbols better than its parent does, for
    itself and for each of them. ``discount`` is taken off the count of a kept symbol.
    """

    depth: int = 3
    least: int = 2
    rare: float = 0.0
    gain: float = 4.0
    discount: float = 0.75


#: Bytes of text in a block, and bytes of text whose windows' names make up a part.
BLOCK_BYTES, PART_BYTES = 6 << 20, 12 << 20
#: What blocks ask for: counts of windows, sums of what follows contexts, and which contexts are suffixes of states.
WINDOWS, CONTEXTS, MARKS = 0, 1, 2
#: Answers to a block by kind and number of symbols, as :func:`_answers` has them.
Told = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
#: Tokens that a counting task holds before it sums and passes them on.
HELD_TOKENS = 1 << 21


def unseen_fold(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the doc_id's text leaves ``fold``; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) == fold


def _summed(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns and how often each occurs; rows are told apart by a 64-bit mix."""
    key = columns[0].view(_U)
    for c in columns[1:]:
        key = mix(key * _STEP + c.astype(_U))
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return [c[order[at]] for c in columns], np.diff(np.append(at, len(order)))


def word_counts(docs: DataFrame) -> DataFrame:
    """The hash of every word of ``docs(held_out, text)`` and how often training texts have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[np.ndarray], training: bool) -> pa.RecordBatch:
            (words,), counts = _summed(np.concatenate(parts).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts * training)], ["h", "c"])

        held: dict[bool, list[np.ndarray]] = {False: [], True: []}
        for b in batches:
            out = b.column("held_out").to_numpy(zero_copy_only=False)
            for first, words, at in word_hashes(b.column("text")):
                mine = np.repeat(out[first : first + len(at) - 1], np.diff(at))
                for unseen in (False, True):
                    held[unseen].append(words[mine == unseen])
                    if sum(map(len, held[unseen])) > HELD_TOKENS:
                        yield summed(held[unseen], not unseen)
                        held[unseen] = []
        for unseen, parts in held.items():
            if sum(map(len, parts)):
                yield summed(parts, not unseen)

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _sequences(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start, words and end of each text in a row, and where each text starts."""
    n = len(at) - 1
    starts = at[:-1] + 2 * np.arange(n)
    flat = np.empty(len(words) + 2 * n, dtype=_U)
    inner = np.ones(len(flat), dtype=bool)
    ends = at[1:] + 2 * np.arange(n) + 1
    inner[starts] = inner[ends] = False
    flat[inner], flat[starts], flat[ends] = words, START, END
    return flat, starts


#: The primes of the 64-bit xxHash.
_PRIMES = [_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _hashed(values: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """The 64-bit xxHash of whole integers, as the session's ``xxhash64`` has it."""
    one, two, three, four, five = _PRIMES
    turned = values * two
    turned = (turned << _U(31) | turned >> _U(33)) * one
    out = seed + (five + _U(8)) ^ turned
    out = (out << _U(27) | out >> _U(37)) * one + four
    out = (out ^ out >> _U(33)) * two
    out = (out ^ out >> _U(29)) * three
    return out ^ out >> _U(32)


def named(ctx: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The names of windows by those of their two parts: ``xxhash64(ctx, low)``."""
    out = np.empty(len(ctx), dtype=_U)
    for i in range(0, len(ctx), 1 << 14):  # short arrays stay near the processor
        out[i : i + (1 << 14)] = _hashed(low[i : i + (1 << 14)], _hashed(ctx[i : i + (1 << 14)], _U(42)))
    return out


def ordered(keys: np.ndarray) -> np.ndarray:
    """The order that sorts 64-bit hashes, equal ones as they stand: ``argsort(keys, kind="stable")``.

    A key's first bits and its place are sorted as one integer, which is several times faster; the few keys
    that only later bits tell apart are put in order after that, so the result is exact.
    """
    bits = _U(max(1, (len(keys) - 1).bit_length()))
    low = (_U(1) << bits) - _U(1)
    packed = keys & ~low | np.arange(len(keys), dtype=_U)
    packed.sort()
    order = (packed & low).astype(np.int64)
    found, first = keys[order], packed >> bits
    wrong = np.flatnonzero((first[1:] == first[:-1]) & (found[1:] < found[:-1]))
    if len(wrong) > 1000:
        return np.argsort(keys, kind="stable")
    for lo, hi in {(int(np.searchsorted(first, x)), int(np.searchsorted(first, x, side="right"))) for x in first[wrong]}:
        order[lo:hi] = order[lo:hi][np.argsort(found[lo:hi], kind="stable")]
    return order


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different hashes, which of them each hash is, and where each occurs first."""
    order = ordered(keys)
    found = keys[order]
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    place = np.empty(len(keys), dtype=np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return found[new], place, order[new]


class Index:
    """Where distinct hashes stand in an array: open addressing, half filled at most, in whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask, self.slots = _U(size - 1), np.full(size, -1, dtype=np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), keys & self.mask
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + _U(1)) & self.mask

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash; -1 for those that aren't there."""
        out, left, at = np.full(len(wanted), -1, dtype=np.int64), np.arange(len(wanted)), wanted & self.mask
        while len(left):
            got = self.slots[at]
            used = got >= 0
            left, at, got = left[used], at[used], got[used]
            same = self.keys[got] == wanted[left]
            out[left[same]] = got[same]
            left, at = left[~same], (at[~same] + _U(1)) & self.mask
        return out


@dataclass(frozen=True)
class Root:
    """The sizes of the training texts, and what the tree's root says."""

    texts: int
    tokens: int
    different: int
    unseen: float
    discount: float

    def chances(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the chance of symbols by their training counts; 0 is the unseen word."""
        with np.errstate(divide="ignore"):
            known = np.log10(np.maximum(counts - self.discount, 1e-9) / max(1, self.tokens))
        return np.where(counts > 0, known, np.log10(self.unseen))


def _bounds(start: Root, how: Tree) -> tuple[float, float]:
    """How often a context, and a window, must occur."""
    return max(how.least, how.rare * start.tokens), max(how.least, how.rare / 16 * start.tokens)


def predicted(c: list[np.ndarray], rest: list[np.ndarray], root: np.ndarray, starts: np.ndarray, discount: float) -> np.ndarray:
    """log10 of each symbol's chance after its longest state; 0 at texts' starts.

    For windows of n symbols by where they end: ``c[n]`` is how often training texts have them, 0 for those not
    kept, ``rest[n]`` their rest as states, not a number for those that are none. ``root``: log10 of each symbol's
    chance without context.
    """
    chance = [np.zeros(0), 10.0**root]
    for n in range(2, len(c)):
        own = np.zeros(len(root))
        at = np.flatnonzero(c[n] > 0)
        at = at[~np.isnan(rest[n - 1][at - 1])]
        own[at] = (c[n][at] - discount) / c[n - 1][at - 1] + rest[n - 1][at - 1] * chance[n - 1][at]
        chance.append(own)
    out, open_ = np.zeros(len(root)), np.ones(len(root), dtype=bool)
    open_[starts] = False
    for n in range(len(c) - 2, 0, -1):
        left = np.flatnonzero(open_)
        left = left[~np.isnan(rest[n][left - 1])]
        known = c[n + 1][left] > 0
        out[left[known]] += np.log10(chance[n + 1][left[known]])
        open_[left[known]] = False
        left = left[~known]
        out[left] += np.log10(rest[n][left - 1])
    out[open_] += root[open_]
    return out


class Block:
    """The texts of a block and their windows, length by length as far as there are answers.

    For windows of n symbols: ``names[n]`` are the different ones that are asked for, ``first[n]`` where each ends
    first, ``at[n]`` where all of them end and ``place[n]`` which one ends there; ``c[n]`` has, by where a window
    ends, how often training texts have it, 0 if it isn't kept; and ``owned[n]`` where those end that this block
    speaks for. For contexts of n symbols, by name: ``often[n]`` those that occur often enough, ``rest[n]`` their rest, not a
    number where nothing kept follows, and ``grown[n]`` those that diverge.
    """

    def __init__(self, texts: pa.Array, told: Told, start: Root | None, how: Tree, longest: int) -> None:
        self.start, self.how = start, how
        least = _bounds(start, how)[0] if start else 0
        flats, starts, size = [], [], 0
        for _, words, at in word_hashes(texts):
            flat, own = _sequences(words, at)
            flats.append(flat)
            starts.append(own + size)
            size += len(flat)
        self.flat, self.starts = np.concatenate(flats), np.concatenate(starts)
        lengths = np.diff(np.append(self.starts, size))
        self.text = np.repeat(np.arange(len(self.starts), dtype=np.int32), lengths)
        back = np.arange(size) - np.repeat(self.starts, lengths)
        none = np.zeros(0, dtype=np.int64)
        self.c, self.keys, self.names, self.first, self.at, self.place, self.owned = ([none] for _ in range(7))
        self.often, self.rest, self.grown = [none], [none], [none]
        full, at = self.flat, np.arange(size)
        for n in range(1, longest + 1):
            if n > 1:
                fits = back >= n - 1
                if n > 2:  # windows of two symbols are asked for before words are known
                    fits[1:] &= (self.c[n - 1][1:] > 0) & (self.c[n - 1][:-1] >= least)
                at, before = np.flatnonzero(fits), full
                full = np.zeros(size, dtype=_U)
                full[at] = named(before[at - 1], before[at])
            names, place, ahead = distinct(full[at])
            first = at[ahead]
            for into, of in zip((self.keys, self.names, self.first, self.at, self.place), (full, names, first, at, place), strict=True):
                into.append(of)
            if (WINDOWS, n) not in told and len(names):
                if n == 1:
                    continue
                return
            count = told.get((WINDOWS, n), (none, none))[0]
            found = np.zeros(size, dtype=np.int64)
            found[at] = (count >> 1)[place]
            if n > 1:
                found[1:][(self.c[n - 1][:-1] < least) | (self.c[n - 1][1:] == 0)] = 0
            self.c.append(found)
            first = first[count & 1 > 0]
            self.owned.append(first[found[first] > 0])
            self._after(n, told, least)

    def _after(self, n: int, told: Told, least: float) -> None:
        """Take in what is known of the contexts of n symbols."""
        t = self.c[n][self.first[n]]
        often, rest, grown = (t > 0) & (t >= least), np.full(len(t), np.nan), np.zeros(len(t), dtype=bool)
        if (CONTEXTS, n) in told:
            m, sums = told[CONTEXTS, n]
            grown[often], m, t = m & 1 > 0, m >> 1, t[often]
            rest[often] = np.where(m > 0, (t - sums + self.how.discount * m) / t, np.nan)
        for into, of in zip((self.often, self.rest, self.grown), (often, rest, grown), strict=True):
            into.append(of)

    def spread(self, n: int, values: np.ndarray, none: float | bool) -> np.ndarray:
        """Values of the names of windows of n symbols by where those end, ``none`` where none does."""
        out = np.full(len(self.flat), none, dtype=values.dtype)
        out[self.at[n]] = values[self.place[n]]
        return out

    def follows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What this block says of its contexts of n symbols: kept windows, their counts' sum, the nats gained."""
        at = self.owned[n + 1]
        up = (self.c[1][at] - self.start.discount) / max(1, self.start.tokens)
        for k in range(2, n + 1):
            up = (self.c[k][at] - self.how.discount) / self.c[k - 1][at - 1] + self.spread(k - 1, self.rest[k - 1], np.nan)[at - 1] * up
        c, t = self.c[n + 1][at], self.c[n][at - 1]
        own, size = self.spread(n, np.arange(len(self.names[n])), 0)[at - 1], len(self.names[n])
        gain = np.bincount(own, weights=c * np.log(c / t / up), minlength=size)
        return np.bincount(own, minlength=size), np.bincount(own, weights=c, minlength=size).astype(np.int64), gain

    def unsure(self, n: int) -> np.ndarray:
        """The contexts of n symbols, by name, that are states only as suffixes of states."""
        return ~np.isnan(self.rest[n]) & ~self.grown[n]

    def marks(self, n: int) -> np.ndarray:
        """The contexts of n symbols, by name, that are suffixes of those here that diverge."""
        out = np.zeros(len(self.names[n]), dtype=bool)
        longer = np.logical_or.reduce([self.spread(k, self.grown[k], False) for k in range(n + 1, self.how.depth + 1)])
        out[self.place[n][longer[self.at[n]]]] = True
        return out

    def states(self, n: int, told: Told) -> np.ndarray:
        """The rest of the contexts of n symbols, by name; not a number for those that are no states."""
        own = self.grown[n].copy()
        if (MARKS, n) in told:
            own[self.unsure(n)] = told[MARKS, n][0] > 0
        return np.where(own, self.rest[n], np.nan)


def _bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers as a byte each, 255 for those that are larger; those, and where they stand."""
    large = np.flatnonzero(values >= 255)
    return np.minimum(values, 255).astype(np.uint8), values[large].astype(np.int64), large


def _numbers(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Undo :func:`_bytes`."""
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


def _binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Pieces of an array as binary values."""
    data = np.ascontiguousarray(data)
    ends = (np.append(cuts, len(data)) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Binary values, one behind the other, as an array."""
    parts = [np.frombuffer(b"", dtype=kind)]
    for chunk in column.chunks:
        _, ends, data = chunk.buffers()
        at = np.frombuffer(ends, dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk) and at[-1] > at[0]:
            parts.append(np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(kind))
    return np.concatenate(parts)


def _sizes(column: pa.ChunkedArray) -> np.ndarray:
    """How many bytes each binary value has."""
    ends = [np.frombuffer(c.buffers()[1], dtype=np.int32)[c.offset : c.offset + len(c) + 1] for c in column.chunks if len(c)]
    return np.concatenate([np.zeros(0, dtype=np.int32), *map(np.diff, ends)])


def _parted(names: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted names fall into, and where each begins."""
    part = ((names >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), dtype=bool), part[1:] != part[:-1])))
    return part[cuts], cuts


def _counted(kind: int, n: int, block: int, names: np.ndarray, parts: int, counts: np.ndarray, sums: np.ndarray | None = None, gains: np.ndarray | None = None) -> pa.Table:
    """A row for each part that a block's names fall into; ``gains`` are told where ``counts`` aren't 0."""
    part, cuts = _parted(names, parts)
    rows = len(cuts)
    columns = {"kind": pa.array(np.full(rows, kind, dtype=np.int32)), "n": pa.array(np.full(rows, n, dtype=np.int32)), "part": pa.array(part)}
    columns |= {"block": pa.array(np.full(rows, block, dtype=np.int64)), "names": _binary(names, cuts)}
    columns |= {"gains": pa.nulls(rows, pa.binary()), "sums": pa.nulls(rows, pa.binary()), "sums_large": pa.nulls(rows, pa.binary())}
    columns["counts"], columns["large"] = _both(counts, cuts)
    if sums is not None and gains is not None:
        columns["sums"], columns["sums_large"] = _both(sums, cuts)
        told = np.flatnonzero(counts)
        columns["gains"] = _binary(gains[told], np.searchsorted(told, cuts))
    return pa.table(columns).select(_ASK_COLUMNS)


def _both(values: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Pieces of whole numbers as two columns of binary values."""
    small, large, at = _bytes(values)
    return _binary(small, cuts), _binary(large, np.searchsorted(at, cuts))


def _answers(table: pa.Table) -> Told:
    """The answers to a block, by kind and length, in the order it asked.

    For windows, twice the total, and one more if it shall speak; for contexts, twice the number of kept windows,
    and one more if they diverge, and the sum of their counts; for marks, how many there are.
    """
    if not table.num_rows:
        return {}
    table = table.sort_by([("kind", "ascending"), ("n", "ascending"), ("part", "ascending")])
    code = table.column("kind").to_numpy().astype(np.int64) << 32 | table.column("n").to_numpy()
    cuts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))).tolist()
    out = {}
    for lo, hi in zip(cuts, [*cuts[1:], len(code)], strict=True):
        own = table.slice(lo, hi - lo)
        numbers = [_numbers(_joined(own.column(c), np.uint8), _joined(own.column(d), np.int64)) for c, d in (("totals", "large"), ("sums", "sums_large"))]
        out[int(code[lo]) >> 32, int(code[lo]) & 0xFFFFFFFF] = tuple(numbers)
    return out


_ASK = "kind int, n int, part long, block long, names binary, counts binary, large binary, sums binary, sums_large binary, gains binary"
_ASK_COLUMNS = [c.split()[0] for c in _ASK.split(", ")]
_TOLD = ["kind", "n", "part", "block", "totals", "large", "sums", "sums_large"]
_ANSWER = "kind int, n int, part long, block long, totals binary, large binary, sums binary, sums_large binary, different long, tokens long, one long, two long"


def _summed_parts(asked: DataFrame, floor: float, gain: float) -> DataFrame:
    """Answers to the rows of :func:`_ask`, as :func:`_answers` reads them; 0 for windows of two or more under ``floor``.

    One block of those that ask for a window shall speak for it. For words a row of block -1 tells how many
    different ones training texts have, how many in all, and how many once and twice.
    """

    def run(table: pa.Table) -> pa.Table:
        kind, n, part = (table.column(c)[0].as_py() for c in ("kind", "n", "part"))
        names, sizes = _joined(table.column("names"), _U), _sizes(table.column("names")) // 8
        counts = _numbers(_joined(table.column("counts"), np.uint8), _joined(table.column("large"), np.int64))
        order = ordered(names << _U(32) | names >> _U(32))  # names of a part begin alike
        names = names[order]
        at = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        times = np.diff(np.append(at, len(names)))
        totals, cuts = np.add.reduceat(counts[order], at), np.cumsum(sizes) - sizes

        def each(values: np.ndarray) -> np.ndarray:
            out = np.empty(len(names), dtype=np.int64)
            out[order] = np.repeat(values, times)
            return out

        rows, facts = len(sizes), [0, 0, 0, 0]
        sums = (pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary()))
        if kind == WINDOWS:
            kept = np.where(totals >= (1 if n == 1 else floor), totals, 0)
            out = each(2 * kept)
            out[order[at]] += kept > 0
            word = (names[at] != START) & (names[at] != END) & (totals > 0) & (n == 1)
            facts = [int(word.sum()), int(totals[word].sum()), int((totals[word] == 1).sum()), int((totals[word] == 2).sum())]
        elif kind == CONTEXTS:
            gains = np.zeros(len(names))
            gains[counts > 0] = _joined(table.column("gains"), np.float64)
            diverge = np.add.reduceat(gains[order], at) > gain * (1 + totals)
            out = each(2 * totals + (diverge & (totals > 0)))
            own = _numbers(_joined(table.column("sums"), np.uint8), _joined(table.column("sums_large"), np.int64))
            sums = _both(each(np.add.reduceat(own[order], at)), cuts)
        else:
            out = each(totals)
        empty = pa.array([b""], pa.binary())
        columns = {k: pa.array([v] * (rows + 1), t) for k, v, t in (("kind", kind, pa.int32()), ("n", n, pa.int32()), ("part", part, pa.int64()))}
        columns["block"] = pa.concat_arrays([*table.column("block").chunks, pa.array([-1], pa.int64())])
        columns |= {k: pa.concat_arrays([v, empty]) for k, v in zip(_TOLD[4:], (*_both(out, cuts), *sums), strict=True)}
        return pa.table(columns | {k: pa.array([0] * rows + [v], pa.int64()) for k, v in zip(("different", "tokens", "one", "two"), facts, strict=True)})

    return asked.groupBy("kind", "n", "part").applyInArrow(run, _ANSWER)


def _told(dealt: DataFrame, answers: list[DataFrame], longest: int, run: Callable[[pa.Table, Told], pa.Table], schema: str) -> DataFrame:
    """``run`` over each block's rows and the answers it got so far for up to ``longest`` symbols."""
    if not answers:
        return dealt.groupBy("block").applyInArrow(lambda rows: run(rows, {}), schema)
    got = reduce(DataFrame.unionByName, answers).where((F.col("block") >= 0) & (F.col("n") <= longest)).select(*_TOLD)
    both = dealt.groupBy("block").cogroup(got.groupBy("block"))
    return both.applyInArrow(lambda rows, told: run(rows, _answers(told)), schema)


def _ask(dealt: DataFrame, answers: list[DataFrame], kinds: list[tuple[int, int]], start: Root | None, how: Tree, parts: int) -> DataFrame:
    """What blocks ask for next: ``kinds`` and numbers of symbols."""
    longest = max(n + (kind == CONTEXTS) for kind, n in kinds)

    def run(rows: pa.Table, told: Told) -> pa.Table:
        block, number, out = Block(rows.column("text"), told, start, how, longest), rows.column("block")[0].as_py(), []
        times = np.where(rows.column("held_out").to_numpy(zero_copy_only=False), 0, rows.column("times").to_numpy())
        for kind, n in kinds:
            if kind == WINDOWS:
                names, at, place = block.names[n], block.at[n], block.place[n]
                counts = np.bincount(place, weights=times[block.text[at]], minlength=len(names)).astype(np.int64)
                out.append(_counted(kind, n, number, names, parts, counts))
            elif kind == CONTEXTS:
                often = block.often[n]
                out.append(_counted(kind, n, number, block.names[n][often], parts, *(x[often] for x in block.follows(n))))
            else:
                for k in range(1, n):
                    unsure = block.unsure(k)
                    out.append(_counted(kind, k, number, block.names[k][unsure], parts, block.marks(k)[unsure].astype(np.int64)))
        return pa.concat_tables(out)

    return _told(dealt, answers, longest, run, _ASK)


def _spoken(dealt: DataFrame, answers: list[DataFrame], start: Root, how: Tree) -> DataFrame:
    """Every kept window of two symbols or more, once: (ctx, low, c)."""

    def run(rows: pa.Table, told: Told) -> pa.Table:
        block, out = Block(rows.column("text"), told, start, how, how.depth + 1), []
        for n in range(2, how.depth + 2):
            at = block.owned[n]
            out.append((block.keys[n - 1][at - 1].view(np.int64), block.keys[n - 1][at].view(np.int64), block.c[n][at]))
        return pa.table({k: pa.array(np.concatenate(x)) for k, x in zip(("ctx", "low", "c"), zip(*out, strict=True), strict=True)})

    return _told(dealt, answers, how.depth + 1, run, "ctx long, low long, c long")


def _states(dealt: DataFrame, answers: list[DataFrame], start: Root, how: Tree) -> DataFrame:
    """Every state, once: (g, rest), the names of contexts with the share of what isn't kept."""

    def run(rows: pa.Table, told: Told) -> pa.Table:
        block = Block(rows.column("text"), told, start, how, how.depth + 1)
        rest = np.concatenate([block.states(n, told) for n in range(1, how.depth + 1)])
        names = np.concatenate(block.names[1 : how.depth + 1])[~np.isnan(rest)]
        return pa.table({"g": pa.array(names.view(np.int64)), "rest": pa.array(rest[~np.isnan(rest)])})

    return _told(dealt, answers, how.depth + 1, run, "g long, rest double").distinct()


def dealt_out(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows(doc_id, held_out, text)`` with a block for each, repeated rows once with ``times``; and the most times.

    Blocks are of about ``BLOCK_BYTES``.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    once, most = collapsed(rows)
    if most > 1:
        once = written(once, "once")
    return once.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(max(1, -(-size // BLOCK_BYTES)))).cast("long")), most


def tree(dealt: DataFrame, how: Tree) -> tuple[Root, list[DataFrame]]:
    """Learn from the training texts of :func:`dealt_out`.

    Returns the root and the answers to all blocks, as :func:`_answers` reads them: written tables in parts, as
    large as the corpus makes them.
    """
    size = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    texts = dealt.where("not held_out").agg(F.sum("times")).first()[0] or 0
    answers = [written(_summed_parts(_ask(dealt, [], [(WINDOWS, 1), (WINDOWS, 2)], None, how, parts), how.least, how.gain), "answers", "zstd")]
    found = answers[0].agg(*(F.sum(c).alias(c) for c in ("different", "tokens", "one", "two"))).first()
    tokens, different = (found.tokens or 0) + texts, (found.different or 0) + bool(texts)
    discount = min(0.95, max(0.05, (found.one or 0) / max(1, (found.one or 0) + 2 * (found.two or 0))))
    start = Root(texts, tokens, different, discount * different / tokens if tokens else 1.0, discount)
    # Contexts of two and more symbols are most of what is asked, so the disk holds them without windows.
    steps = [[(WINDOWS, 3), (CONTEXTS, 1)] if how.depth > 1 else [(CONTEXTS, 1)]]
    for n in range(2, how.depth + 1):
        steps += [[(CONTEXTS, n)], [(WINDOWS, n + 2)] if n < how.depth else [(MARKS, n)]]
    for kinds in steps:
        asked = _ask(dealt, answers, kinds, start, how, parts)
        answers.append(written(_summed_parts(asked, _bounds(start, how)[1], how.gain), "answers", "zstd"))
    return start, answers


class Model:
    """A whole tree, held here."""

    def __init__(self, start: Root, windows: tuple[np.ndarray, np.ndarray], states: tuple[np.ndarray, np.ndarray], how: Tree) -> None:
        self.start, self.how = start, how
        self.windows, self.counts = Index(windows[0]), np.append(windows[1], 0)
        self.states, self.rest = Index(states[0]), np.append(states[1], np.nan)

    def root(self, counts: np.ndarray) -> np.ndarray:
        return self.start.chances(counts)

    def predict(self, flat: np.ndarray, starts: np.ndarray, root: np.ndarray) -> np.ndarray:
        """log10 of each symbol's chance after its longest state; ``root``: its chance without context."""
        back = np.arange(len(flat)) - np.repeat(starts, np.diff(np.append(starts, len(flat))))
        c, rest, keys = [np.zeros(0)], [np.zeros(0)], flat
        for n in range(1, self.how.depth + 2):
            at = np.flatnonzero(back >= n - 1)
            if n > 1:
                own = np.zeros(len(flat), dtype=_U)
                own[at] = named(keys[at - 1], keys[at])
                keys = own
            c.append(np.zeros(len(flat), dtype=np.int64))
            rest.append(np.full(len(flat), np.nan))
            c[n][at] = self.counts[self.windows.find(keys[at])]
            rest[n][at] = self.rest[self.states.find(keys[at])]
        return predicted(c, rest, root, starts, self.how.discount)


def learn(rows: DataFrame, words: DataFrame, how: Tree) -> Model:
    """The whole tree of a small corpus ``rows(held_out, text)``, whose words' counts are ``words(h, c)``."""
    dealt, _ = dealt_out(rows.select(F.lit(0).cast("long").alias("doc_id"), "held_out", F.coalesce("text", F.lit("")).alias("text")))
    start, answers = tree(dealt, how)
    windows, states = _spoken(dealt, answers, start, how), _states(dealt, answers, start, how)
    edges = np.array([START, END], dtype=_U)
    found, held, own = windows.toArrow(), words.where("c > 0").toArrow(), states.toArrow()
    integers = lambda table, c: table.column(c).to_numpy().astype(np.int64)
    names = [integers(held, "h").view(_U), edges, named(integers(found, "ctx").view(_U), integers(found, "low").view(_U))]
    counts = [integers(held, "c"), np.full(2, start.texts), integers(found, "c")]
    dropped(*answers)
    return Model(start, (np.concatenate(names), np.concatenate(counts)), (integers(own, "g").view(_U), own.column("rest").to_numpy()), how)


def scores(docs: DataFrame, how: Tree = Tree()) -> DataFrame:  # noqa: B008
    """Score every whole text, learning from those that aren't held out.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns a row per row: ``doc_id``,
    ``held_out``, ``n_tokens`` and ``n_known`` (with the end), ``train_tokens``, ``base_score`` (add-one
    unigrams) and ``score`` (the tree's log10 probability; unseen words are one symbol, as in the base).
    Null and empty texts are one end. Rows that repeat are texts each. Without training texts nothing is
    known, ``train_tokens`` is 0 and all scores are 0. No rows, none.

    Rows that repeat doc_id and text are read once, whatever their number, and count as often as they occur.
    Neither a vocabulary nor a text nor the tree is broadcast or held whole: a task holds a block of texts with
    the answers to it, or a part of all names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), unseen_fold(F.col("doc_id")).alias("held_out"), text.alias("text"))
    dealt, most = dealt_out(rows)
    start, answers = tree(dealt, how)
    longest = how.depth + 1
    tokens, divisor = start.tokens, float(start.tokens + start.different + 1)

    def score(rows: pa.Table, told: Told) -> pa.Table:
        block = Block(rows.column("text"), told, start, how, longest)
        rest = [np.zeros(0), *(block.spread(n, block.states(n, told), np.nan) for n in range(1, longest))]
        ones = np.ones(len(block.flat))
        ones[block.starts] = 0.0
        counts = block.c[1]
        values = (ones, ones * (counts > 0), ones * np.log10((counts + 1) / divisor), predicted(block.c, rest, start.chances(counts), block.starts, how.discount))
        n, known, b, p = (np.add.reduceat(x, block.starts) for x in values)
        return pa.table(
            {
                "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"),
                "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
                "train_tokens": pa.array(np.full(len(n), tokens, dtype=np.int64)),
                "base_score": pa.array(b), "score": pa.array(p), "times": rows.column("times"),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, times long"
    found = written(_told(dealt, answers, longest, score, schema), "scores")
    dropped(*answers)
    return copied(found, F.col("times"), "_copy", most > COPIES).drop("times", "_copy") if most > 1 else found.drop("times")
