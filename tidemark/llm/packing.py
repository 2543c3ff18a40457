"""Filling containers of fixed capacity with items of varying length.

Bounded-space online packing: each partition keeps ``open_windows`` containers open. An item goes into the
one it fills best; if it fits none, the fullest is closed and emitted and a new one opened. What is still
open at the end of a partition is merged: the items of these windows, and no others, are packed again in rounds over
ever fewer partitions, so that a task of a round meets at most ``FAN_IN * open_windows`` containers. The last round closes all.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import cut

OPEN_WINDOWS = 64
#: Leftovers of so many partitions are merged by one task of the next round.
FAN_IN = 16
_DDL = "box bigint, open boolean, item bigint, piece bigint, start bigint, size bigint"


class Packer:
    """Best fit over a bounded number of open containers, which hold their items until they close."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows, self.next = capacity, windows, 0
        self.free: list[tuple[int, int]] = []  # (free space, container), ascending
        self.held: dict[int, list[tuple]] = {}

    def place(self, size: int, item: tuple) -> Iterator[tuple[int, list[tuple]]]:
        """Puts an item away and gives (container, items) of those this closes: the one it fills to the brim, or the fullest, if it fits none."""
        i = bisect_left(self.free, (size, -1))
        if i < len(self.free):
            space, box = self.free.pop(i)
        else:
            if len(self.free) >= self.windows:
                full = self.free.pop(0)[1]
                yield full, self.held.pop(full)
            space, box = self.capacity, self.next
            self.next += 1
        self.held.setdefault(box, []).append(item)
        if space > size:
            insort(self.free, (space - size, box))
        else:
            yield box, self.held.pop(box)


def _pack(capacity: int, windows: int, salt: int, last: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, part = Packer(capacity, windows), TaskContext.get().partitionId()
        base = (salt << 56) | (part << 32)
        columns = ["box", "open", "item", "piece", "start", "size"]
        for f in frames:
            out = []
            for item in f[columns[2:]].itertuples(index=False, name=None):
                for box, items in packer.place(item[3], item):
                    out.extend((base | box, False, *x) for x in items)
            yield pd.DataFrame(out, columns=columns)
        left = [(base | box, not last, *x) for box, items in packer.held.items() for x in items]
        yield pd.DataFrame(left, columns=columns)

    return run


def _round(items: DataFrame, capacity: int, windows: int, salt: int, partitions: int, last: bool) -> DataFrame:
    """Rows of ``_DDL``; ordered by a hash, so that sizes come mixed and a rerun packs alike."""
    mixed = items.repartition(partitions, "item", "piece").sortWithinPartitions(F.xxhash64("item", "piece", F.lit(salt)), "item", "piece")
    return cut(mixed.mapInPandas(_pack(capacity, windows, salt, last), _DDL))


def _merge_round(left: DataFrame, capacity: int, windows: int, salt: int, partitions: int) -> DataFrame:
    """The windows of FAN_IN partitions meet in one task, by the number of the partition that left them, which their container's name holds."""
    part = F.shiftright("box", 32).bitwiseAND(F.lit((1 << 24) - 1))
    mixed = left.repartitionById(partitions, F.floor(part / FAN_IN).cast("int")).sortWithinPartitions(F.xxhash64("item", "piece", F.lit(salt)), "item", "piece")
    return cut(mixed.mapInPandas(_pack(capacity, windows, salt, partitions == 1), _DDL))


def pack(items: DataFrame, item: str, size: str, capacity: int, windows: int = OPEN_WINDOWS, partitions: int | None = None) -> DataFrame:
    """(container_id, item, piece_no, start, size): where each item, or each piece of one, lies.

    Only an item larger than ``capacity`` is split, into full pieces and a rest; ``start`` is the piece's
    offset in its item. Items of null, zero or negative size, and of null id, get no container. A repeated row is
    an item of its own; equal sizes are placed in the order of a hash of their ids. No container holds more than ``capacity``.
    """
    spark = items.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = items.select(F.col(item).cast("bigint").alias("item"), F.col(size).cast("bigint").alias("total")).where("item is not null and total > 0")
    pieces = rows.select("item", "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / capacity))).alias("piece")).select(
        "item", F.col("piece").cast("bigint").alias("piece"), (F.col("piece") * capacity).cast("bigint").alias("start"), F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("bigint").alias("size")
    )
    packed = _round(pieces, capacity, windows, 0, partitions, partitions == 1)
    closed = packed.where("not open")
    salt = 0
    while partitions > 1:
        salt, partitions = salt + 1, -(-partitions // FAN_IN)
        packed = _merge_round(packed.where("open"), capacity, windows, salt, partitions)
        closed = closed.unionByName(packed.where("not open"))
    return closed.select(F.concat(F.lit("b"), "box").alias("container_id"), F.col("item").alias(item), F.col("piece").alias("piece_no"), "start", F.col("size").alias(size))


def fill_figures(packed: DataFrame, size: str, capacity: int) -> DataFrame:
    """(containers, least_containers, mean_fill): how many there are, the lower bound by volume, and the share of their space in use."""
    total = F.sum(size)
    boxes = F.count_distinct("container_id")
    return packed.agg(boxes.alias("containers"), F.ceil(total / capacity).alias("least_containers"), F.round(total / (boxes * capacity), 6).alias("mean_fill"))
