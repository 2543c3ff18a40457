"""Continuous periods and gaps from overlapping intervals, by dyadic blocks.

Closed integer intervals are mapped to half-open ones on a doubled axis, ``[2s, 2e + 1)``, so that
intervals that touch in one instant join and intervals one unit apart do not. Each is cut at fixed
tiles of the axis and decomposed into canonical dyadic blocks ``[i * 2**k, (i + 1) * 2**k)``; blocks
inside a larger one are dropped, sibling pairs merge upward, and neighbouring blocks coalesce.
(key, tile) is the unit of work, so that a key that holds a third of all rows is spread over its tiles;
only the first and the last period of a tile go on to a per-key step. An interval over many tiles is cut at its first and its last one only;
between them it stays whole, as the canonical blocks above the tile, each once per key however many intervals hold it. What lies in a
tile that such a block covers is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: log2 of a tile's length on the doubled axis: 2**33 half-microseconds are about 72 minutes.
TILE_BITS = 33
#: An interval over more tiles than this is kept as blocks above the tile.
LONG_TILES = 64


def dyadic_union(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint, separated [lo, hi) per key, sorted by (key, lo); no interval may cross a multiple of 2**top."""
    ks, starts, levels = [], [], []
    live = np.arange(len(key))
    a, b = lo.copy(), hi.copy()
    for k in range(top + 1):
        if not len(live):
            break
        left = live[(a[live] & 1 == 1)]
        ks.append(key[left]), starts.append(a[left] << k), levels.append(np.full(len(left), k))
        a[left] += 1
        right = live[(b[live] & 1 == 1) & (a[live] < b[live])]
        b[right] -= 1
        ks.append(key[right]), starts.append(b[right] << k), levels.append(np.full(len(right), k))
        a >>= 1
        b >>= 1
        live = live[a[live] < b[live]]
    k, s, v = np.concatenate(ks), np.concatenate(starts), np.concatenate(levels)
    # blocks nest or are disjoint: with larger blocks first at a start, one is covered iff the ends so far reach past its start
    o = np.lexsort((-v, s, k))
    k, s, v = k[o], s[o], v[o]
    if not len(k):
        return k, s, s
    new = np.r_[True, k[1:] != k[:-1]]
    far = _running_max(s + (np.int64(1) << v), new)
    keep = new | (s >= np.r_[0, far[:-1]])
    k, s, v = k[keep], s[keep], v[keep]
    for level in range(top):
        at = v == level
        if not at.any():
            continue
        first = at[:-1] & at[1:] & (k[:-1] == k[1:]) & ((s[:-1] >> level) & 1 == 0) & (s[1:] == s[:-1] + (1 << level))
        i = np.nonzero(first)[0]
        if len(i):
            v[i] += 1
            keep = np.ones(len(k), bool)
            keep[i + 1] = False
            k, s, v = k[keep], s[keep], v[keep]
    e = s + (np.int64(1) << v)
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != e[:-1])
    at = np.nonzero(new)[0]
    return k[at], s[at], e[np.r_[at[1:], len(k)] - 1]


def _running_max(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Cumulative maximum that begins anew wherever ``start`` is true."""
    group = np.cumsum(start) - 1
    span = np.int64(x.max() - x.min() + 1) if len(x) else np.int64(1)
    if len(x) and span < (1 << 62) // max(1, int(group[-1]) + 1):
        base = x.min() + 0
        return np.maximum.accumulate((x - base) + group * span) - group * span + base
    return pd.Series(x).groupby(group).cummax().to_numpy()


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Regroups sorted frames so that no group of ``keys`` is split between two of them."""
    rest: list[pd.DataFrame] = []
    for f in frames:
        if f.empty:
            continue
        last = f[keys].iloc[-1]
        tail = (f[keys] == last).all(axis=1).to_numpy()
        cut = len(f) - int(np.argmin(tail[::-1])) if not tail.all() else 0
        if cut:
            yield pd.concat([*rest, f.iloc[:cut]]) if rest else f.iloc[:cut]
            rest = [f.iloc[cut:]]
        elif rest and not (rest[-1][keys].iloc[-1] == last).all():
            yield pd.concat(rest)
            rest = [f]
        else:
            rest.append(f)
    if rest:
        yield pd.concat(rest)


def _blocks_above(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, first, last) of the canonical dyadic blocks, in tiles, of tile ranges [first, last)."""
    for f in frames:
        a, b, key = f["first"].to_numpy(np.int64).copy(), f["last"].to_numpy(np.int64).copy(), f["key"].to_numpy()
        keys, starts, levels = [], [], []
        k = 0
        while (live := a < b).any():
            left = live & (a & 1 == 1)
            right = live & (b & 1 == 1) & (a + left < b)
            keys += [key[left], key[right]]
            starts += [a[left] << k, (b[right] - 1) << k]
            levels += [np.full(left.sum(), k), np.full(right.sum(), k)]
            a, b, k = (a + left) >> 1, (b - right) >> 1, k + 1
        if keys:
            at, level = np.concatenate(starts), np.concatenate(levels)
            yield pd.DataFrame({"key": np.concatenate(keys), "first": at, "last": at + (np.int64(1) << level)})


def _tiles(bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, ["key", "tile"]):
            key, tile = f["key"].to_numpy(), f["tile"].to_numpy()
            new = np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]
            group, at = np.cumsum(new) - 1, np.nonzero(new)[0]
            base = tile.astype(np.int64) << bits
            g, lo, hi = dyadic_union(group, f["lo"].to_numpy() - base, f["hi"].to_numpy() - base, bits)
            off = tile[at][g].astype(np.int64) << bits
            lo, hi = lo + off, hi + off
            first = np.r_[True, g[1:] != g[:-1]]
            last = np.r_[g[1:] != g[:-1], True]
            out = pd.DataFrame({"key": key[at][g], "tile": tile[at][g], "edge": first | last, "is_gap": False, "lo": lo, "hi": hi})
            i = np.nonzero(~first)[0]
            gaps = pd.DataFrame({"key": out["key"].to_numpy()[i], "tile": out["tile"].to_numpy()[i], "edge": False, "is_gap": True, "lo": hi[i - 1], "hi": lo[i]})
            yield pd.concat([out, gaps])

    return run


def periods_and_gaps(df: DataFrame, key: str, start_us: Column, end_us: Column, max_gap_us: int | None = None, tile_bits: int = TILE_BITS) -> DataFrame:
    """(key, kind, start_us, end_us) with kind ``period`` or ``gap``.

    Rows with a null key or bound and rows that end before they start do not count; zero length does.
    Repeated rows have no effect, an empty input gives no rows, other columns of ``df`` are ignored
    whatever their names. A gap of ``max_gap_us`` or longer is left out; None keeps all. The key must
    be an integer. An interval costs one row per tile it meets, up to LONG_TILES of them, or as many blocks as the logarithm of its length.
    """
    tile = 1 << tile_bits
    rows = df.select(F.col(key).cast("bigint").alias("key"), start_us.alias("s"), end_us.alias("e")).where("key is not null and s is not null and e is not null and e >= s")
    rows = rows.select("key", (F.col("s") * 2).alias("s"), (F.col("e") * 2 + 1).alias("e"))
    first, last = F.shiftright("s", tile_bits), F.shiftright(F.col("e") - 1, tile_bits)
    rows = rows.select("key", "s", "e", first.alias("first"), last.alias("last"))
    is_long = F.col("last") - F.col("first") > LONG_TILES
    met = F.when(is_long, F.array("first", "last")).otherwise(F.when(~is_long, F.sequence("first", F.least("last", F.col("first") + LONG_TILES))))
    above = rows.where(is_long).select("key", (F.col("first") + 1).alias("first"), "last").mapInPandas(_blocks_above, "key bigint, first bigint, last bigint").distinct()
    above = above.select(
        "key", F.col("first").alias("tile"), F.lit(True).alias("edge"), F.lit(False).alias("is_gap"), (F.col("first") * tile).alias("lo"), (F.col("last") * tile).alias("hi")
    )
    cut = rows.select("key", "s", "e", F.explode(met).alias("tile")).select(
        "key",
        "tile",
        F.greatest("s", F.col("tile") * tile).alias("lo"),
        F.least("e", (F.col("tile") + 1) * tile).alias("hi"),
    )
    blocks = (
        cut.repartition("key", "tile")
        .sortWithinPartitions("key", "tile")
        .mapInPandas(_tiles(tile_bits), "key bigint, tile bigint, edge boolean, is_gap boolean, lo bigint, hi bigint")
    )
    # without long intervals nothing is covered, and what follows reads the tiles once
    long = not rows.where(is_long).isEmpty()
    if long:
        blocks = blocks.unionByName(above)
    # edge rows of a key, two a tile, and its blocks above come together; inner rows keep their tile as a part of the partition key
    part = blocks.withColumn("slot", F.when(~F.col("edge"), F.col("tile")))
    w = Window.partitionBy("key", "slot").orderBy("is_gap", "lo", F.desc("hi"))
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("prev_hi", F.max("hi").over(so_far)).withColumn("prev_tile", F.lag("tile").over(w))
    part = part.withColumn("begins", ~F.col("edge") | F.col("prev_hi").isNull() | (F.col("prev_hi") < F.col("lo")))
    part = part.withColumn("chain", F.sum(F.col("begins").cast("int")).over(w))
    # inner rows of tiles that a block covers, which only blocks can, are dropped with the tile
    if long:
        tile_end = (F.col("tile") + 1) * tile
        covered = part.where(F.col("edge") & (F.col("prev_hi") >= tile_end) & (F.col("lo") < tile_end)).select("key", F.col("tile").alias("slot")).distinct()
        part = part.join(covered, ["key", "slot"], "left_anti")
    merged = part.groupBy("key", "slot", "is_gap", "chain").agg(
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min(F.when(F.col("edge") & F.col("begins") & (F.col("prev_tile") != F.col("tile")), F.col("prev_hi"))).alias("before"),
    )
    out = merged.select(
        "key",
        F.explode(
            F.array(
                F.struct(F.when(F.col("is_gap"), "gap").otherwise("period").alias("kind"), F.col("lo").alias("lo"), F.col("hi").alias("hi")),
                F.struct(F.lit("gap").alias("kind"), F.col("before").alias("lo"), F.when(F.col("before").isNotNull(), F.col("lo")).alias("hi")),
            )
        ).alias("x"),
    ).select("key", "x.*").where("lo is not null")
    # a period is [2s, 2e + 1); a gap lies between the odd end of one and the even start of the next
    start = F.when(F.col("kind") == "gap", F.shiftright(F.col("lo") - 1, 1)).otherwise(F.shiftright("lo", 1))
    end = F.when(F.col("kind") == "gap", F.shiftright("hi", 1)).otherwise(F.shiftright(F.col("hi") - 1, 1))
    out = out.select(F.col("key").alias(key), "kind", start.alias("start_us"), end.alias("end_us"))
    if max_gap_us is not None:
        out = out.where((F.col("kind") == "period") | (F.col("end_us") - F.col("start_us") < max_gap_us))
    return out
