"""Items packed into containers of fixed capacity, by swap-based local search.

Items are dealt by a hash into blocks of a bounded number, and each block is packed on its own, in
parallel; a block's packing wastes at most what its last containers leave open. Within a block a
best-fit packing is improved by moves between underfull containers, each of which makes the sum of
squared fills larger: moving an item, exchanging one for one, one for two or two for one, until none
is left. Squared fill grows by filling some containers at the cost of others, until the others are empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items in a block at most, on average; bounds a task's work and memory.
BLOCK_ITEMS = 10_000


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers (lists of item numbers), largest items first, each into the fullest that holds it."""
    bins: list[list[int]] = []
    open_bins: list[tuple[int, int]] = []  # (free, bin), sorted
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        at = bisect_left(open_bins, (size, -1))
        if at == len(open_bins):
            bins.append([int(item)])
            free, b = capacity - size, len(bins) - 1
        else:
            free, b = open_bins.pop(at)
            bins[b].append(int(item))
            free -= size
        if free:
            insort(open_bins, (free, b))
    return bins


class _Fills:
    """Containers by a size they can give: for each distinct size, those that have it, least full first."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.at: dict[int, list[tuple[int, int]]] = {}

    def add(self, size: int, fill: int, b: int) -> None:
        if size not in self.at:
            self.at[size] = []
            insort(self.sizes, size)
        insort(self.at[size], (fill, b))

    def remove(self, size: int, fill: int, b: int) -> None:
        own = self.at[size]
        del own[bisect_left(own, (fill, b))]
        if not own:
            del self.at[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def largest(self, least: int, most: int, base: int, fill: int, b: int) -> tuple[int, int] | None:
        """(size, container) of the largest size whose container, other than ``b``, is less full than
        ``b`` will be: ``b`` has ``fill`` and gains the size less ``base``."""
        for at in range(bisect_right(self.sizes, most) - 1, -1, -1):
            size = self.sizes[at]
            if size < least:
                return None
            own = self.at[size]
            first = own[0] if own[0][1] != b else own[1] if len(own) > 1 else None
            if first and first[0] < fill + size - base:
                return size, first[1]
        return None


class LocalSearch:
    """Improves a packing until no move does. Sizes are positive and at most the capacity.

    The underfull containers are indexed by the sizes of their items and by those of their pairs. A
    move makes the sum of squared fills larger exactly if the container that gains ends fuller than
    the other was, so that per size only the least full container needs a look.
    """

    def __init__(self, sizes: np.ndarray, capacity: int, bins: list[list[int]]) -> None:
        self.size = [int(s) for s in sizes]
        self.capacity = capacity
        self.bins: list[dict[int, list[int]]] = [{} for _ in bins]  # items by size
        self.fill = [0] * len(bins)
        self.one, self.two = _Fills(), _Fills()
        for b, items in enumerate(bins):
            for i in items:
                self.bins[b].setdefault(self.size[i], []).append(i)
                self.fill[b] += self.size[i]
            self._index(b, _Fills.add)

    def _pairs(self, b: int) -> dict[int, tuple[int, int]]:
        """Two sizes of different items of ``b`` for each of their sums that fits a container."""
        own = sorted(self.bins[b])
        out = {2 * s: (s, s) for s in own if len(self.bins[b][s]) > 1}
        for i, p in enumerate(own):
            out.update((p + q, (p, q)) for q in own[i + 1 :])
        return out

    def _index(self, b: int, change: Callable[[_Fills, int, int, int], None]) -> None:
        """Adds container ``b`` to the indexes or removes it; full and empty ones are in none."""
        if 0 < self.fill[b] < self.capacity:
            for s in self.bins[b]:
                change(self.one, s, self.fill[b], b)
            for s in self._pairs(b):
                change(self.two, s, self.fill[b], b)

    def _move(self, size: int, at: int, to: int) -> None:
        item = self.bins[at][size].pop()
        if not self.bins[at][size]:
            del self.bins[at][size]
        self.bins[to].setdefault(size, []).append(item)
        self.fill[at] -= size
        self.fill[to] += size

    def _improve(self, b: int) -> bool:
        """The move into container ``b`` that closes the most of its free space."""
        fill = self.fill[b]
        free = self.capacity - fill
        best: tuple[int, int, tuple[int, ...], tuple[int, ...]] | None = None  # (gain, other, sizes in, sizes out)

        def look(index: _Fills, base: int, out: tuple[int, ...]) -> None:
            nonlocal best
            found = index.largest(base + (best[0] if best else 0) + 1, base + free, base, fill, b)
            if found:
                size, other = found
                best = (size - base, other, (size,) if index is self.one else self._pairs(other)[size], out)

        look(self.one, 0, ())  # a move
        for index in (self.one, self.two):  # one for one, two for one
            for s in sorted(self.bins[b]):
                if best and best[0] == free:
                    break
                look(index, s, (s,))
        if not best or best[0] < free:  # one for two
            for s, pair in self._pairs(b).items():
                look(self.one, s, pair)
                if best and best[0] == free:
                    break
        if best is None:
            return False
        _, other, into, out = best
        for x in (b, other):
            self._index(x, _Fills.remove)
        for s in into:
            self._move(s, other, b)
        for s in out:
            self._move(s, b, other)
        for x in (b, other):
            self._index(x, _Fills.add)
        return True

    def run(self) -> list[list[int]]:
        moved = True
        while moved:  # each move makes the sum of squared fills larger, so this ends
            moved = False
            # the fullest of the underfull take from the others
            for b in sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], b)):
                while 0 < self.fill[b] < self.capacity and self._improve(b):
                    moved = True
        return [sorted(i for items in b.values() for i in items) for b in self.bins if b]


def pack_block(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; items of size 0 join the first container."""
    out = np.zeros(len(sizes), np.int64)
    real = np.flatnonzero(sizes > 0)
    if len(real):
        own = sizes[real]
        for number, items in enumerate(LocalSearch(own, capacity, best_fit(own, capacity)).run()):
            out[real[items]] = number
    return out


#: Targets that a plan may hold; packing for more is an error.
MOST_TARGETS = 1_000


def pack(items: DataFrame, targets: DataFrame, id_col: str, blocks: int) -> DataFrame:
    """(target_id, capacity, container, id, piece, pieces, size): every item of every target.

    ``items`` has the id, ``size`` and ``tokenizer`` (what the size is counted in); ``targets`` has
    target_id, tokenizer and capacity, at most MOST_TARGETS rows. An item larger than the capacity is
    split into full pieces, which fill containers of their own, and a rest that is packed like an
    item; no other item is split. Items of size 0 take no room. Null sizes count as 0, targets
    without a positive capacity or of another tokenizer give nothing. Which block an item is in
    follows from its id and size alone, so a packing does not depend on how the input is stored;
    repeated rows, which would gather in one block, are dealt to the blocks that follow by their
    number. ``container`` is unique within a target.

    Each (target, block) is a task of its own.
    """
    wanted = targets.filter("capacity > 0").select("target_id", "tokenizer", F.col("capacity").cast("long").alias("capacity"))
    few = wanted.limit(MOST_TARGETS + 1).collect()
    if len(few) > MOST_TARGETS:
        raise ValueError(f"at most {MOST_TARGETS} targets can be packed for at once")
    few = sorted(map(tuple, few), key=str)
    kinds = [wanted.schema[c].dataType.simpleString() for c in ("target_id", "tokenizer", "capacity")]
    each = F.array(*[F.struct(F.lit(i).alias("at"), *[F.lit(v).cast(k).alias(c) for v, k, c in zip(r, kinds, wanted.columns, strict=True)]) for i, r in enumerate(few)])
    each = each if few else each.cast(f"array<struct<at: int, target_id: {kinds[0]}, tokenizer: {kinds[1]}, capacity: bigint>>")

    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long")
    sized = items.select(F.col(id_col).alias("id"), "tokenizer", size.alias("size"))
    # equal rows are counted first, so that many copies of one row do not meet before they are parted
    sized = sized.groupBy("id", "tokenizer", "size").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("id", "size") + F.col("copy"), F.lit(blocks)).cast("int"))
    rows = sized.select("id", "size", "block", F.explode(F.filter(each, lambda t: t["tokenizer"] == F.col("tokenizer"))).alias("t")).select("t.*", "id", "size", "block")
    rows = rows.select("target_id", "capacity", "id", "size", "block", (F.col("at") * blocks + F.col("block")).cast("int").alias("group"))
    # a partition for each block: adaptive execution would put all of these few bytes into one task
    rows = rows.repartitionById(max(1, len(few) * blocks), "group")
    id_type = items.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("target_id", targets.schema["target_id"].dataType),
            T.StructField("capacity", T.LongType()),
            T.StructField("container", T.StringType()),
            T.StructField(id_col, id_type),
            *(T.StructField(c, T.LongType()) for c in ("piece", "pieces", "size")),
        ]
    )

    def one_block(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("size", "ascending")])
        size = group["size"].to_numpy()
        capacity, block = group["capacity"][0].as_py(), group["block"][0].as_py()
        # full pieces first, then the rest of each item
        rest = np.where((size > 0) & (size % capacity == 0), capacity, size % capacity)
        full = (size - rest) // capacity
        number = pack_block(rest, capacity)
        item = np.r_[np.repeat(np.arange(len(size)), full), np.arange(len(size))]
        piece = np.r_[np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full), full]
        name = [f"{block}-{i}.{p}" for i, p in zip(item[: int(full.sum())], piece, strict=False)] + [f"{block}:{n}" for n in number]
        return pa.table(
            [
                group["target_id"].take(pa.array(item)),
                group["capacity"].take(pa.array(item)),
                pa.array(name),
                group["id"].take(pa.array(item)),
                pa.array(piece),
                pa.array(full[item] + 1),
                pa.array(np.r_[np.full(int(full.sum()), capacity), rest]),
            ],
            schema=pa.schema(list(zip(schema.fieldNames(), [group["target_id"].type, pa.int64(), pa.string(), group["id"].type, pa.int64(), pa.int64(), pa.int64()], strict=True))),
        )

    return rows.groupBy("group").applyInArrow(one_block, schema)
