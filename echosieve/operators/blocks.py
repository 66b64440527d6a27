"""Pairs of fingerprints, block against block: whole arrays of pairs are judged before any of them becomes a row.

A join by shared bytes meets a fourth of all pairs one by one where texts are alike, which takes some hundred
nanoseconds a pair; over arrays a pair takes one or two, whatever its bytes, and no bucket can be hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import COARSE_D, STRICT_D, Gate, most_distance, whash_bounds
from ..functions import hashing as H

#: Rows of a block, the least number of blocks, and pairs that are judged at once.
BLOCK, LEAST_BLOCKS, CHUNK = 16_384, 12, 1 << 15
#: Pairs that leave as one batch.
BATCH = 1 << 16
_LOW, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_BOUNDS = np.array(whash_bounds())


@dataclass(frozen=True)
class Rule:
    """What a pair must pass, in this order: distance with a shared byte, folders apart, colour, wavelet verdict."""

    most: int = COARSE_D
    apart: bool = False
    gate: Gate | None = None
    least: float | None = None


Arrays = dict[str, np.ndarray]


def _numbers(items: DataFrame) -> list[Column]:
    """What rules judge by, as flat columns without nulls; a missing colour counts as black."""
    zero = F.lit(0.0)
    own = [F.col("folder_path").cast("string").alias("folder")] if "folder_path" in items.columns else []
    own += [F.coalesce("whash", F.lit(0).cast("bigint")).alias("whash")] if "whash" in items.columns else []
    return own + [F.coalesce(F.col("hsv")[c].cast("double"), zero).alias(c) for c in "hsv" if "hsv" in items.columns]


def _arrays(table: pa.Table, *keys: str) -> Arrays:
    """Columns as arrays; ``keys`` as their places in order, folders as numbers with null as one of its own."""
    out: Arrays = {}
    for name in table.column_names:
        column = table.column(name).combine_chunks()
        if name in keys:
            order = column.cast(pa.binary()) if pa.types.is_string(column.type) else column
            out[name] = pc.rank(order, "ascending", tiebreaker="dense").to_numpy().astype(np.int32)
        elif name == "folder":
            out[name] = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        elif pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
            out[name] = column.to_numpy(zero_copy_only=False)
            if name in ("phash", "whash") or name.startswith("turn"):
                out[name] = out[name].view(np.uint64)
    if "h" in out:
        out["low"] = out["s"]
        known = np.isfinite(out["h"]) & (out["h"] >= 0) & (out["h"] <= 360)
        out["hue"] = (np.where(known, out["h"], 0) * (256 / 360)).astype(np.int64).astype(np.uint8)
        out["odd"] = ~known
    return out


def _taken(x: Arrays, at: np.ndarray | slice) -> Arrays:
    return {k: v[at] for k, v in x.items()}


def _coarse(x: Arrays, y: Arrays, d: np.ndarray, gate: Gate) -> np.ndarray:
    """Pairs that may pass the colour stage: none that passes is left out, hues are compared in 256ths of the circle."""
    reach = math.ceil(gate.hue * 256 / 360) + 1
    if reach > 127 or x["odd"].any() or y["odd"].any():
        return np.ones(d.shape, bool)
    m = ((x["hue"] + np.uint8(reach))[:, None] - y["hue"][None]) <= np.uint8(2 * reach)
    m |= (x["low"] < gate.low_saturation)[:, None] & (y["low"] < gate.low_saturation)[None]
    m |= d <= STRICT_D
    return m


def _colours(x: Arrays, y: Arrays, d: np.ndarray, gate: Gate) -> np.ndarray:
    """The colour stage as :func:`color.passes` has it, over arrays."""
    h, s1, s2, v1, v2 = np.abs(x["h"] - y["h"]), x["s"], y["s"], x["v"], y["v"]
    s = np.abs(s1 - s2)
    gray = (np.abs(v1 - v2) <= gate.value) & (np.abs(v1 * (1.0 - s1) - v2 * (1.0 - s2)) <= gate.achroma) & (s <= gate.low_saturation_step)
    colour = (np.minimum(h, 360.0 - h) <= gate.hue) & (s <= gate.saturation)
    return (d <= STRICT_D) | np.where(np.maximum(s1, s2) < gate.low_saturation, gray, colour)


def _verdict(x: Arrays, y: Arrays, d: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the wavelet hash accepts, its distance (-1 where a hash is missing) and the final similarity."""
    d = d.astype(np.int32)
    valid = (x["whash"] != 0) & (y["whash"] != 0)
    d_w = np.where(valid, np.bitwise_count(x["whash"] ^ y["whash"]), -1).astype(np.int32)
    passes = valid & (d_w <= _BOUNDS[np.minimum(d, COARSE_D)])
    sim = 1 - np.where(passes, np.minimum(d, d_w), d) / 64.0
    return (passes | valid & (d <= STRICT_D)) & (sim >= least), d_w, sim


def _chunks(x: Arrays, y: Arrays, most: int, turns: tuple[str, ...] = ("phash",), same: bool = False) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows lo to hi of ``x`` with ``y`` from ``off``: which pairs are within ``most`` bits, their distances, and the bits they differ in.

    The nearest of ``turns`` of ``y`` counts; the bits are those of the upright fingerprints. Where both sides are the ``same``,
    rows must be in the order of their paths, and a pair is given once.
    """
    lo, n = 0, len(x["phash"])
    while lo < n:
        off = lo if same else 0
        ys = y["phash"][off:]
        hi = min(n, lo + max(1, CHUNK // max(1, len(ys))))
        own = x["phash"][lo:hi, None]
        z = own ^ ys
        d = np.bitwise_count(z)
        for t in turns[1:]:
            np.minimum(d, np.bitwise_count(own ^ y[t][off:]), out=d)
        m = d <= most
        if same:
            m &= x["path"][lo:hi, None] < y["path"][off:]
        yield lo, hi, off, m, d, z
        lo = hi


def _shared(z: np.ndarray) -> np.ndarray:
    """Whether a byte of the differing bits is zero."""
    low = z - _LOW
    low &= ~z
    low &= _HIGH
    return low != 0


def _found(m: np.ndarray, lo: int, off: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both sides that ``m`` marks, and their places in it."""
    at = np.flatnonzero(m)
    row = np.repeat(np.arange(len(m)), np.diff(np.searchsorted(at, np.arange(len(m) + 1) * m.shape[1])))
    return row + lo, at - row * m.shape[1] + off, at


def _narrowed(m: np.ndarray, d: np.ndarray, x: Arrays, y: Arrays, rule: Rule) -> np.ndarray:
    """Marks that folders and coarse colours leave."""
    if rule.apart:
        m = m & (x["folder"][:, None] != y["folder"][None])
    return m & _coarse(x, y, d, rule.gate) if rule.gate else m


def _judged(m: np.ndarray, d: np.ndarray, z: np.ndarray | None, x: Arrays, y: Arrays, lo: int, off: int, rule: Rule) -> dict[str, np.ndarray]:
    """The marked pairs that share a byte of ``z`` (None: known to) and pass colour and verdict: rows ``i`` and ``j``, ``d`` and, after a verdict, ``d_w`` and ``sim``."""
    if rule.least is not None:
        d_w = np.bitwise_count(x["whash"][lo : lo + len(m), None] ^ y["whash"][off:])
        m = m & ((np.minimum(d, d_w) <= most_distance(rule.least)) & (d_w <= _BOUNDS.max()) | (d <= STRICT_D))
    i, j, at = _found(m, lo, off)
    if z is not None:
        ok = _shared(z.ravel()[at])
        i, j, at = i[ok], j[ok], at[ok]
    out = {"i": i, "j": j, "d": d.ravel()[at]}
    if rule.gate and len(i):
        need = ("h", "s", "v")
        ok = _colours({c: x[c][i] for c in need}, {c: y[c][j] for c in need}, out["d"], rule.gate)
        out = _taken(out, ok)
    if rule.least is not None:
        ok, d_w, sim = _verdict({"whash": x["whash"][out["i"]]}, {"whash": y["whash"][out["j"]]}, out["d"], rule.least)
        out = _taken(out | {"d_w": d_w, "sim": sim}, ok)
    return out


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each pair of blocks; they come in the order of ``pair``."""
    part, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column("pair").to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
        for a, b in zip(cuts, cuts[1:]):
            if held and of[a] != part:
                yield pa.Table.from_batches(held)
                held = []
            part = of[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _blocks(rows: DataFrame, size: int = 0) -> int:
    return max(LEAST_BLOCKS, -(-rows.count() // (size or BLOCK)))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _with_itself(items: DataFrame, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, *columns: Column) -> DataFrame:
    """``run`` over each pair of blocks of valid ``items``: rows with ``side`` 0 or 1, or 2 where a block meets itself."""
    rows = items.where(H.valid(F.col("phash")) & F.col("path").isNotNull()).select("path", "phash", *columns)
    n = _blocks(rows)
    deal = items.sparkSession.range(n * n).select(F.expr(f"id div {n}").alias("i"), F.expr(f"id % {n}").alias("j"), F.col("id").alias("pair")).where("i <= j")
    deal = deal.select("pair", F.explode(F.expr("if(i = j, array(struct(i as block, 2 as side)), array(struct(i as block, 0 as side), struct(j as block, 1 as side)))")).alias("_s")).select("pair", "_s.*")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("path"), F.lit(n))).join(F.broadcast(deal), "block").drop("block")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            yield from run(table)

    return dealt.repartition(_parts(items), "pair").sortWithinPartitions("pair").mapInArrow(over, schema)


def _sides(table: pa.Table) -> tuple[pa.Table, Arrays, Arrays, bool]:
    """The rows in the order of their paths with both sides' arrays, and whether they are one block."""
    order = np.argsort(_arrays(table.select(["path"]), "path")["path"], kind="stable")
    table = table.take(pa.array(order))
    both = _arrays(table, "path") | {"row": np.arange(table.num_rows)}
    side = both.pop("side")
    return table, _taken(both, side != 1), _taken(both, side != 0), bool((side == 2).any())


def pairs(items: DataFrame, rule: Rule) -> DataFrame:
    """Pairs a < b of ``items(path, phash, ...)`` that share a byte and pass ``rule``: (a, b, d) and, after a verdict, (d_w, sim)."""
    kind = items.schema["path"].dataType.simpleString()
    verdict = rule.least is not None
    names = ["a", "b", "d", "d_w", "sim"] if verdict else ["a", "b", "d"]

    def out(paths: pa.Array, held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        whole = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        columns = [paths.take(pa.array(whole[k])) for k in "ab"] + [pa.array(whole["d"].astype(np.int32))]
        if verdict:
            columns += [pa.array(whole["d_w"]), pa.array(whole["sim"])]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table, x, y, same = _sides(table)
        paths, held, size = table.column("path").combine_chunks(), [], 0
        for lo, hi, off, m, d, z in _chunks(x, y, rule.most, same=same):
            m = _narrowed(m, d, {k: v[lo:hi] for k, v in x.items()}, {k: v[off:] for k, v in y.items()}, rule)
            got = _judged(m, d, z, x, y, lo, off, rule)
            i, j = x["row"][got.pop("i")], y["row"][got.pop("j")]
            held.append(got | {"a": np.minimum(i, j), "b": np.maximum(i, j)})
            size += len(i)
            if size >= BATCH:
                yield out(paths, held)
                held, size = [], 0
        if size:
            yield out(paths, held)

    schema = f"a {kind}, b {kind}, d int" + ", d_w int, sim double" * verdict
    return _with_itself(items, run, schema, *_numbers(items))


def counts(items: DataFrame, rule: Rule, whash: bool) -> DataFrame:
    """One row: how many pairs each step of ``rule`` leaves, and how many have wavelet hashes to be judged by.

    Without ``whash`` pairs are accepted by their distance alone.
    """
    names = ["passed_phash", "passed_folder", "passed_color", "entered_whash", "filtered_inter", "accepted"]
    before = replace(rule, least=None)

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        _, x, y, same = _sides(table)
        n = np.zeros(6, np.int64)
        for lo, hi, off, m, d, z in _chunks(x, y, rule.most, same=same):
            own, other = {k: v[lo:hi] for k, v in x.items()}, {k: v[off:] for k, v in y.items()}
            m &= _shared(z)
            near = np.count_nonzero(m)
            m = _narrowed(m, d, own, other, replace(before, gate=None))
            apart = np.count_nonzero(m)
            got = _judged(_narrowed(m, d, own, other, replace(before, apart=False)), d, None, x, y, lo, off, before)
            ws = [{"whash": t["whash"][got[k]]} for t, k in ((x, "i"), (y, "j"))]
            entered = np.count_nonzero((ws[0]["whash"] != 0) & (ws[1]["whash"] != 0)) if whash else 0
            ok = _verdict(*ws, got["d"], rule.least)[0] if whash else got["d"] <= most_distance(rule.least)
            n += (near, apart, len(got["d"]), entered, near - apart, np.count_nonzero(ok))
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in n], names)

    found = _with_itself(items, run, ", ".join(f"{c} long" for c in names), *_numbers(items))
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in names))


#: Items of a block that meets blocks of ads.
ITEMS = 4_096


def best_members(ads: DataFrame, gallery: DataFrame, rule: Rule, turns: tuple[str, ...]) -> DataFrame:
    """For each (leader, item) the best ad that passes ``rule``: (leader, item, member, d_p, d_w, sim).

    ``ads`` has path, leader, phash and the columns ``turns`` of valid turned fingerprints. All ads of a leader
    are in one block, so what a block of items finds in it is final and no pair is moved.
    """
    kind = {"leader": ads.schema["leader"].dataType.simpleString(), "item": gallery.schema["path"].dataType.simpleString(), "member": ads.schema["path"].dataType.simpleString()}
    left = ads.where(H.valid(F.col("phash")) & F.col("path").isNotNull()).select("path", "leader", "phash", *turns, *_numbers(ads))
    right = gallery.where(H.valid(F.col("phash")) & F.col("path").isNotNull()).select("path", "phash", *_numbers(gallery))
    ls, rs = _blocks(left), _blocks(right, ITEMS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumns({"l": F.pmod(F.xxhash64("leader"), F.lit(ls)).cast("int"), "side": F.lit(1)}).select("*", every(rs).alias("r"))
    upright = {t: F.lit(0).cast("bigint") for t in turns}
    right = right.withColumns(upright | {"r": F.pmod(F.xxhash64("path"), F.lit(rs)).cast("int"), "side": F.lit(0)}).select("*", every(ls).alias("l"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("pair", F.col("r").cast("long") * ls + F.col("l")).drop("l", "r")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            first = table.column("side").to_numpy() == 0
            items, known = table.filter(pa.array(first)), table.filter(pa.array(~first))
            if not items.num_rows or not known.num_rows:
                continue
            whole = _arrays(table, "path", "leader")
            x, y = _taken(whole, first), _taken(whole, ~first)
            paths, members, leaders = items.column("path").combine_chunks(), known.column("path").combine_chunks(), known.column("leader").combine_chunks()
            for lo, hi, off, m, d, z in _chunks(x, y, rule.most, ("phash", *turns)):
                m = _narrowed(m, d, {k: v[lo:hi] for k, v in x.items()}, y, rule)
                got = _judged(m, d, z, x, y, lo, off, rule)
                i, j = got["i"], got["j"]
                got = _taken(got, x["path"][i] != y["path"][j])
                i, j = got["i"], got["j"]
                if not len(i):
                    continue
                led = y["leader"][j]
                order = np.lexsort((y["path"][j], -got["sim"], led, i))
                i, led = i[order], led[order]
                best = order[np.concatenate([[True], (i[1:] != i[:-1]) | (led[1:] != led[:-1])])]
                i, j = pa.array(got["i"][best]), pa.array(got["j"][best])
                d_w = got["d_w"][best]
                columns = [leaders.take(j), paths.take(i), members.take(j), pa.array(got["d"][best].astype(np.int32)), pa.array(d_w, mask=d_w < 0), pa.array(got["sim"][best])]
                yield pa.RecordBatch.from_arrays(columns, ["leader", "item", "member", "d_p", "d_w", "sim"])

    schema = ", ".join(f"{k} {v}" for k, v in kind.items()) + ", d_p int, d_w int, sim double"
    return both.repartition(_parts(both), "pair").sortWithinPartitions("pair").mapInArrow(over, schema)
