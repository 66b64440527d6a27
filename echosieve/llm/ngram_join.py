"""Exact n-gram Jaccard self join over size-banded tiles.

The named method compares sets inside size-banded tiles: a bitmap of hashed shingles per set, bit
counts that bound the overlap from above, then an exact intersection of sorted arrays. Tiles made of
size bands alone would hold every pair of documents of similar length, so they are narrowed first:

1. A pair with ``den*I >= num*U`` differs in at most ``H = (den-num)(r+s)/(den+num)`` shingles. The
   hash space of a tile is cut into more than H equal ranges, so the two sets agree wholly in all
   but H ranges. Ranges have one order for all sets, those with most shingles first; then two linked
   sets agree in one of the first H + 1 of each. Each set emits the digests of those; sets that share
   one are candidates. So a line that very many texts share, alone in its range, makes no candidates
   while other ranges do. The shuffle carries two integers a range.
2. Candidates fall into clusters (connected components of a star for each shared digest). Very large
   ones, which chance or a common passage chains together, are told apart by other cuts of the hash
   space, as linked sets meet under any cut. In each
   size-banded tile of a cluster the bitmaps alone are compared; what they can't tell apart stays
   together, which leaves small clusters. No link leaves one.
3. Only then texts move, each once unless its cluster is large, and each tile is compared exactly:
   bitmaps again, sorted-array intersections for what is left, and pairs that earlier links already
   connect are skipped.
4. Links become components.

A tile over its bound is cut into blocks, and every pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import dropped, written
from .text import mix, shingle_sets

_U = np.uint64


@dataclass(frozen=True)
class Jaccard:
    """``words`` in a shingle, and the least similarity ``num / den`` of a link.

    ``tile_shingles`` bounds the shingles of a tile that is compared exactly, ``tile_rows`` the sets of
    one whose bitmaps are compared.
    """

    words: int = 5
    num: int = 4
    den: int = 5
    tile_shingles: int = 1_000_000
    tile_rows: int = 8192
    ratio: float = 1.4

    def differ(self, r: int, s: int) -> int:
        """The most shingles in which linked sets of these sizes can differ."""
        return (self.den - self.num) * (r + s) // (self.den + self.num)

    def partner(self, r: int) -> int:
        """The largest set that a set of r shingles can link with."""
        return r * self.den // self.num


@lru_cache(maxsize=8)
def _bands(how: Jaccard) -> tuple[np.ndarray, list[int]]:
    """Where size bands start, and into how many ranges each band's tile cuts the hash space."""
    starts, ranges = [1], []
    while starts[-1] < 1 << 40:
        lo = starts[-1]
        nxt = max(lo + 1, int(lo * how.ratio))
        if len(starts) > 1:
            nxt = max(nxt, how.partner(lo - 1) + 1)
        starts.append(nxt)
        need = how.differ(nxt - 1, how.partner(nxt - 1)) + 1
        k = need
        for _ in range(8):  # some ranges more, as some will be empty
            void = k * exp(-lo / k)
            k = need + (int(void + 3 * sqrt(void)) if need > 1 else 0)
        ranges.append(min(k, 2 * need))
    return np.array(starts[:-1], dtype=np.int64), ranges


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set, as two signed integers."""
    d = xxhash.xxh3_128_digest(np.ascontiguousarray(shingles).tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def range_digests(shingles: np.ndarray, how: Jaccard, cut: int = 0) -> np.ndarray:
    """The tile keys of one sorted set; linked sets share at least one, whatever way the hash space is ``cut``."""
    n = len(shingles)
    if not n:
        return shingles
    if cut:
        shingles = np.sort(mix(shingles + _U(cut)))
    starts, ranges = _bands(how)
    own = int(np.searchsorted(starts, n, side="right")) - 1
    run = np.zeros(n + 1, dtype=_U)
    np.cumsum(mix(shingles + _U(0x632BE59BD9B4E019)), out=run[1:])
    out = []
    for tile in (own, own - 1):
        if tile < 0 or tile < own and n > how.partner(int(starts[own]) - 1):
            continue
        k = ranges[tile]
        cuts = np.arange(1, k, dtype=_U) * _U((2**64 - 1) // k)
        at = np.concatenate(([0], np.searchsorted(shingles, cuts), [n]))
        sums = run[at[1:]] - run[at[:-1]]
        name = mix(np.arange(k, dtype=_U) + _U(tile << 32))
        keys = mix(sums ^ name)
        # In the lower tile a set meets those of the band that gave the tile its name; others in its own.
        most = how.differ(n, how.partner(n) if tile == own else int(starts[own]) - 1)
        # Of k keys in one order, k - most at least are shared, so one of the first most + 1 of each set is.
        keys = keys[np.lexsort((keys, at[:-1] - at[1:]))[: most + 1]]
        out.append(keys)
    return np.concatenate(out)


_FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, bits binary"
#: Widths of bitmaps; a set has the width next above its size.
NARROWEST, WIDEST = 256, 8192


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The bits that the hashes of a set name, as 64-bit words; as wide as the set is large."""
    bits = min(WIDEST, max(NARROWEST, 1 << (len(shingles) - 1).bit_length()))
    flags = np.zeros(bits, dtype=np.uint8)
    flags[mix(shingles) & _U(bits - 1)] = 1
    return np.packbits(flags, bitorder="little").view(_U)


def same_width(bitmaps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps folded to the width of the narrowest, as a matrix."""
    least = min(map(len, bitmaps))
    return np.stack([np.bitwise_or.reduce(b.reshape(-1, least), axis=0) for b in bitmaps])


def set_features(docs: DataFrame, how: Jaccard) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: size, digest and bitmap of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, d1, d2, bits = [], [], [], []
            for s in shingle_sets(b.column("text"), how.words):
                x, y = digest(s) if len(s) else (0, 0)
                sizes.append(len(s))
                d1.append(x)
                d2.append(y)
                bits.append(bitmap(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, d1, d2)), pa.array(bits, pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FEATURES)


#: Tile keys that a task holds before it joins those that are equal and passes them on.
HELD_KEYS = 1 << 18


def _tile_keys(docs: DataFrame, how: Jaccard, cut: int = 0) -> DataFrame:
    """Rows (tile, node, hub): sets by the tiles they take part in.

    Of the sets that share a tile in one task only the least stands for the tile, without a hub; the others
    come as edges to it, dealt by their own names. So a tile that very many sets share is a few rows. Rows of a
    set come together, which shuffles well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
            tile, node = np.concatenate(keys).view(np.int64), np.concatenate(nodes)
            order = np.lexsort((node, tile))
            tile, node = tile[order], node[order]
            new = np.concatenate(([True], tile[1:] != tile[:-1]))
            hub = np.repeat(node[new], np.diff(np.append(np.flatnonzero(new), len(tile))))
            edge = hub != node
            tile = np.where(edge, mix(node.view(_U)).view(np.int64), tile)
            edges = np.unique(np.stack([tile[edge], node[edge], hub[edge]], axis=1), axis=0)
            out = [np.concatenate([x[new], edges[:, i]]) for i, x in enumerate((tile, node, hub))]
            alone = np.arange(len(out[0])) < new.sum()
            order = np.argsort(out[1], kind="stable")
            columns = [pa.array(out[0][order]), pa.array(out[1][order]), pa.array(out[2][order], mask=alone[order])]
            return pa.RecordBatch.from_arrays(columns, ["tile", "node", "hub"])

        seen: set[int] = set()
        keys, nodes, count = [], [], 0
        for b in batches:
            for s in shingle_sets(b.column("text"), how.words):
                if not len(s) or (d := digest(s)[0]) in seen:
                    continue
                seen.add(d)
                keys.append(k := range_digests(s, how, cut))
                nodes.append(np.full(len(k), d, dtype=np.int64))
                count += len(k)
                if count > HELD_KEYS:
                    yield joined(keys, nodes)
                    keys, nodes, count = [], [], 0
        if keys:
            yield joined(keys, nodes)

    return docs.select("text").mapInArrow(run, "tile long, node long, hub long")


def _stars(keys: DataFrame) -> DataFrame:
    """An edge from each set to the least of those that share a tile key with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, least = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            t, n, hubs = b.column("tile").to_numpy(), b.column("node").to_numpy(), b.column("hub").fill_null(0).to_numpy()
            edge = b.column("hub").is_valid().to_numpy(zero_copy_only=False)
            found = [np.stack([n[edge], hubs[edge]], axis=1)]
            t, n = t[~edge], n[~edge]
            if len(t):
                new = np.empty(len(t), dtype=bool)
                new[0] = tile is None or t[0] != tile
                np.not_equal(t[1:], t[:-1], out=new[1:])
                at = np.flatnonzero(new)
                hubs = np.full(len(t), least, dtype=np.int64)
                if len(at):
                    hubs[at[0] :] = np.repeat(n[at], np.diff(np.append(at, len(t))))
                tile, least = t[-1], hubs[-1]
                other = hubs != n
                found.append(np.stack([n[other], hubs[other]], axis=1))
            if len(pairs := np.unique(np.concatenate(found), axis=0)):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    by_tile = keys.repartition("tile").sortWithinPartitions("tile", "node")
    return by_tile.mapInArrow(run, "u long, v long").distinct()


#: Times that the sets of large clusters are told apart by another cut, and what a cluster must lose for one more.
CUTS, LOSS = 3, 0.2


def _narrowed(docs: DataFrame, copies: DataFrame, near: DataFrame, how: Jaccard) -> DataFrame:
    """The clusters ``near(node, cluster)``, those over four tiles split by other cuts of the hash space.

    Linked sets share a tile under every cut, so no link leaves a cluster; sets that share a tile by chance under
    one cut seldom do under the next. Real groups of near copies stay whole.
    """
    before = None
    for cut in range(1, CUTS + 1):
        sizes = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * how.tile_rows)
        large = written(sizes, "large")
        now = large.agg(F.sum("n")).first()[0] or 0
        if not now or before is not None and now > before * (1 - LOSS):
            dropped(large)
            break
        before = now
        inside = written(near.join(large, "cluster", "left_semi"), "inside")
        reps = copies.join(inside, copies.d1 == inside.node).select("rep")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        texts = texts.join(reps.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("text")
        again = written(components(_stars(_tile_keys(texts, how, cut))).select(F.col("node").alias("other"), F.col("label").alias("again")), "again")
        split = inside.join(again, inside.node == again.other).select("node", F.xxhash64("cluster", "again").alias("cluster"))
        old, near = near, written(near.join(large, "cluster", "left_anti").select("node", "cluster").unionByName(split), "near")
        dropped(old, large, inside, again)
    return near


class _Sweep:
    """Sets in order of size, joined to groups; for each the later ones that its bitmap allows."""

    def __init__(self, sizes: list[int], bitmaps: list[np.ndarray], how: Jaccard) -> None:
        self.order = sorted(range(len(sizes)), key=lambda i: sizes[i])
        self.sizes = np.array([sizes[i] for i in self.order], dtype=np.int64)
        self.maps = same_width([bitmaps[i] for i in self.order])
        self.group, self.how = np.arange(len(sizes)), how

    def join(self, i: int, j: int) -> tuple[int, int]:
        self.group[self.group == self.group[j]] = self.group[i]
        return self.order[i], self.order[j]

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        how = self.how
        for i in range(len(self.order) - 1):
            r = int(self.sizes[i])
            end = int(np.searchsorted(self.sizes, how.partner(r), side="right"))
            rest = np.flatnonzero(self.group[i + 1 : end] != self.group[i]) + i + 1
            if len(rest):
                # Each bit that only one bitmap has set stands for a shingle that only that set has.
                apart = np.bitwise_count(self.maps[rest] ^ self.maps[i]).sum(axis=1, dtype=np.int64)
                rest = rest[apart * (how.den + how.num) <= (how.den - how.num) * (self.sizes[rest] + r)]
                yield i, rest


def alike(sizes: list[int], bitmaps: list[np.ndarray], how: Jaccard) -> list[tuple[int, int]]:
    """Pairs that connect all that bitmaps can't tell apart."""
    out, sweep = [], _Sweep(sizes, bitmaps, how)
    for i, rest in sweep:
        for j in rest.tolist():
            if sweep.group[i] != sweep.group[j]:
                out.append(sweep.join(i, j))
    return out


def linked(sets: list[np.ndarray], how: Jaccard) -> list[tuple[int, int]]:
    """Links between sorted sets that connect all that links connect; exact."""
    out, sweep = [], _Sweep([len(s) for s in sets], [bitmap(s) for s in sets], how)
    for i, rest in sweep:
        a = sets[sweep.order[i]]
        for j in rest.tolist():
            if sweep.group[i] == sweep.group[j]:
                continue
            b = sets[sweep.order[j]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if how.den * both >= how.num * (len(a) + len(b) - both):
                out.append(sweep.join(i, j))
    return out


_KEYS = ["cluster", "band", "lo", "hi"]


def _edges(nodes: list[int], found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        columns = [pa.array([nodes[x[k]] for x in found], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["u", "v"])


def _alike(tiled: DataFrame, how: Jaccard) -> DataFrame:
    """Edges between sets of a tile that their bitmaps can't tell apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, nodes, sizes, maps = None, [], [], []
        for b in batches:
            for *own, node, n, bits in zip(*(b.column(c).to_pylist() for c in (*_KEYS, "node", "n_shingles", "bits")), strict=True):
                if own != tile:
                    if len(nodes) > 1:
                        yield from _edges(nodes, alike(sizes, maps, how))
                    tile, nodes, sizes, maps = own, [], [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sizes.append(n)
                    maps.append(np.frombuffer(bits, dtype=_U))
        if len(nodes) > 1:
            yield from _edges(nodes, alike(sizes, maps, how))

    by_tile = tiled.select(*_KEYS, "node", "n_shingles", "bits").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "node")
    return by_tile.mapInArrow(run, "u long, v long")


def _links(tiled: DataFrame, how: Jaccard) -> DataFrame:
    """Links inside each tile of ``tiled``, which has the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, nodes, sets = None, [], []
        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in (*_KEYS, "node")), strict=True)
            for (*own, node), s in zip(keys, shingle_sets(b.column("text"), how.words), strict=True):
                if own != tile:
                    if len(nodes) > 1:
                        yield from _edges(nodes, linked(sets, how))
                    tile, nodes, sets = own, [], []
                # A row that merely shares its doc_id with the wanted text has another digest.
                if (not nodes or nodes[-1] != node) and digest(s)[0] == node:
                    nodes.append(node)
                    sets.append(s)
        if len(nodes) > 1:
            yield from _edges(nodes, linked(sets, how))

    by_tile = tiled.select(*_KEYS, "node", "text").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "node")
    return by_tile.mapInArrow(run, "u long, v long")


def _tiled(wanted: DataFrame, how: Jaccard, weight: Column, most: int) -> DataFrame:
    """Send the rows of ``wanted(cluster, node, n_shingles, ...)`` to every tile they take part in.

    A cluster of at most ``most`` in ``weight`` is one tile. A larger one has a tile for each size band,
    with the sets of the band and those larger ones that can link with them, cut into blocks.
    """
    sums = wanted.groupBy("cluster").agg(F.sum(weight).alias("weight"))
    large = written(sums.where(F.col("weight") > most).select("cluster", F.lit(True).alias("large")), "large")
    starts = _bands(how)[0]
    starts = starts[: np.searchsorted(starts, 1 << 33)].tolist()
    own = sum((F.when(F.col("n_shingles") >= s, 1).otherwise(0) for s in starts), F.lit(-1)).cast("long")
    joined = wanted.join(large, "cluster", "left")
    none = F.lit(0).cast("long")
    one = joined.where("large is null").select(*wanted.columns, none.alias("band"), none.alias("lo"), none.alias("hi"))
    many = joined.where("large").withColumn("own", own).withColumn("first", F.element_at(F.array(*map(F.lit, starts)), (F.col("own") + 1).cast("int")))
    many = many.select("*", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("band"))
    reached = F.col("n_shingles") * how.num <= (F.col("first") - 1) * how.den
    many = written(many.where((F.col("band") == F.col("own")) | (F.col("band") >= 0) & reached).select(*wanted.columns, "band"), "bands")
    blocks = many.groupBy("cluster", "band").agg(F.ceil(F.sum(weight) / most).alias("blocks"))
    many = many.join(written(blocks, "blocks"), ["cluster", "band"])
    mine, other = F.pmod(F.xxhash64("node"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    many = many.withColumn("mine", mine).withColumn("other", other)
    many = many.select(*wanted.columns, "band", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    return one.unionByName(many)


def ngram_components(docs: DataFrame, how: Jaccard = Jaccard()) -> DataFrame:  # noqa: B008
    """Join documents with equal or similar shingle sets, exactly, and label what links connect.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns a row per row of
    ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the least doc_id that links reach).
    Null and empty texts, and white space alone, have no shingles and link with nothing; their
    component is their own doc_id. A null doc_id is never a component's name unless it is alone.
    Repeated rows are equal texts and link. An empty table gives no rows. Sets are compared by
    64-bit hashes of shingles and named by the first half of a 128-bit digest.
    """
    return _labelled(docs, how).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, how: Jaccard) -> DataFrame:
    """The rows of :func:`ngram_components` with ``d1``, the name of a row's set."""
    docs = docs.select("doc_id", "text")
    rows = written(set_features(docs, how), "features")
    copies = rows.where("n_shingles > 0").groupBy("n_shingles", "d1").agg(F.min("doc_id").alias("rep"))
    near = written(components(_stars(_tile_keys(docs, how))).select("node", F.col("label").alias("cluster")), "near")
    near = _narrowed(docs, copies, near, how)
    wanted = copies.join(near, copies.d1 == near.node).select("node", "cluster", "n_shingles", "rep")
    first = rows.select(F.col("doc_id").alias("id"), F.col("d1").alias("d"), "bits")
    signed = wanted.join(first, F.col("rep").eqNullSafe(F.col("id")) & (F.col("node") == F.col("d"))).drop("id", "d", "rep")
    signed = written(signed, "signed")
    dropped(near)
    closer = written(components(_alike(_tiled(signed, how, F.lit(1), how.tile_rows), how)).select("node", F.col("label").alias("cluster")), "closer")
    dropped(signed)
    wanted = written(copies.join(closer, copies.d1 == closer.node).select("node", "cluster", "n_shingles", "rep"), "wanted")
    dropped(closer)
    tiled = _tiled(wanted, how, F.col("n_shingles"), how.tile_shingles)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with_text = texts.join(tiled.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep")))
    links = _links(with_text, how)
    labels = written(components(links).select(F.col("node").alias("d1"), "label"), "labels")
    dropped(wanted)
    names = copies.join(labels, "d1", "left").withColumn("label", F.coalesce("label", "d1"))
    least = written(names.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    names = written(names.join(least, "label").select("n_shingles", "d1", "component_id"), "names")
    dropped(labels, least)
    out = rows.select("doc_id", "n_shingles", "d1").join(names, ["n_shingles", "d1"], "left")
    out = written(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "d1"), "labelled")
    dropped(rows, names)
    return out


def keep_one(docs: DataFrame, how: Jaccard = Jaccard()) -> DataFrame:  # noqa: B008
    """Keep one row of each component, the one with the least doc_id, with all its columns.

    Rows without a doc_id or without shingles stay. Of rows that repeat doc_id and text one stays.
    """
    found = written(_labelled(docs, how).where("n_shingles > 0 and doc_id is not null"), "found")
    # Texts without shingles count here: a doc_id may have one besides.
    again = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    losers = written(found.where("doc_id <> component_id").select("doc_id").distinct().join(again, "doc_id", "left_anti"), "losers")
    single = docs.join(losers, "doc_id", "left_anti").join(again, "doc_id", "left_anti")
    if not again.limit(1).count():
        return single
    # Rows that repeat a doc_id are told apart by their sets, found by the texts' hashes.
    repeated = docs.join(again, "doc_id", "left_semi").withColumn("_text", F.xxhash64("text"))
    sets = set_features(repeated.select(F.col("_text").alias("doc_id"), "text").dropDuplicates(["doc_id"]), how)
    sets = sets.select(F.col("doc_id").alias("_text"), F.col("n_shingles").alias("_n"), F.col("d1").alias("_d1"))
    lost = found.where("doc_id <> component_id").select("doc_id", F.col("n_shingles").alias("_n"), F.col("d1").alias("_d1")).distinct()
    kept = repeated.join(sets, "_text").join(lost, ["doc_id", "_n", "_d1"], "left_anti")
    bare = kept.where("_n = 0").unionByName(kept.where("_n > 0").dropDuplicates(["doc_id", "text"]))
    return single.unionByName(bare.select(*single.columns))
