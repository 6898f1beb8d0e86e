"""Containers of fixed capacity filled with items of varying length.

The plan is made on the histogram of lengths, which has at most ``capacity`` bins however many items there are:

1. the configuration linear program (least number of containers whose contents cover the histogram, one variable a
   possible content of a container) is solved over classes of lengths by multiplicative weights; each step prices the
   contents by an unbounded knapsack, a dynamic program over the capacity;
2. the fractions are rounded down and their places filled with true lengths, longest first within a class;
3. what the rounding left over, and the short items, go by best fit into the room that is left, then into new
   containers. All of it moves runs of equal containers, never single items.

The items get their number within their length by a salted count (a hot length, such as the empty text, is spread over
many tasks) and look up their container in the plan.

Defined cases: an item of size 0 or null takes no room and is spread evenly over the containers; an item above the
capacity is cut into full pieces and a rest that is packed like any item; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweir.session import cut_lineage

#: Rows of a length that one counting task takes, about.
SALT_ROWS = 200_000


def fractional_configurations(counts: np.ndarray, capacity: int, rounds: int = 1500, eta: float = 0.08) -> list[tuple[dict[int, int], float]]:
    """Multiplicative weights on the covering program: counts[k] items of size k (k=1..capacity); the configurations
    and how often each is used, so that the classes are covered about once."""
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return []
    need = counts[sizes].astype(float)
    cover = np.zeros(len(sizes))
    used: dict[tuple[tuple[int, int], ...], float] = {}
    index = {int(s): i for i, s in enumerate(sizes)}
    for _ in range(rounds):
        price = np.exp(-(cover - cover.min())) / need
        price /= price.max()
        # cheapest first: value[c] is the best worth of a container with room c
        value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
        for c in range(1, capacity + 1):
            n = np.searchsorted(sizes, c, "right")
            if n:
                worth = value[c - sizes[:n]] + price[:n]
                k = int(worth.argmax())
                if worth[k] > value[c - 1]:
                    value[c], choice[c] = worth[k], sizes[k]
                    continue
            value[c], choice[c] = value[c - 1], 0
        content: dict[int, int] = {}
        c = capacity
        while c > 0:
            s = int(choice[c])
            if s:
                content[s] = content.get(s, 0) + 1
                c -= s
            else:
                c -= 1
        step = eta * min(need[index[s]] / m for s, m in content.items())
        for s, m in content.items():
            cover[index[s]] += step * m / need[index[s]]
        key = tuple(sorted(content.items()))
        used[key] = used.get(key, 0) + step
    scale = 1 / max(np.quantile(cover, 0.5), 1e-9)
    return [(dict(k), x * scale) for k, x in used.items()]


class _Runs:
    """Runs of equal containers by the room they have left."""

    def __init__(self):
        self.rooms: list[int] = []
        self.by_room: dict[int, list[tuple[int, int]]] = {}
        self.containers = 0

    def add(self, room: int, first: int, number: int) -> None:
        if room <= 0 or number <= 0:
            return
        if room not in self.by_room:
            bisect.insort(self.rooms, room)
            self.by_room[room] = []
        self.by_room[room].append((first, number))

    def new(self, number: int) -> int:
        first = self.containers
        self.containers += number
        return first

    def best(self, size: int, most: int) -> tuple[int, int, int] | None:
        """Take up to most containers of the smallest sufficient room."""
        at = bisect.bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        held = self.by_room[room]
        first, number = held.pop()
        if number > most:
            held.append((first + most, number - most))
            number = most
        if not held:
            del self.by_room[room]
            self.rooms.pop(at)
        return room, first, number


def plan(histogram: dict[int, int], capacity: int, grain: int = 16, small: int = 64) -> tuple[list[tuple[int, int, int, int]], int]:
    """(size, first rank, end rank, first container) rows, each giving one item to each container of a run; and the
    number of containers. The rows depend on the lengths and the capacity, not on the number of items."""
    left = {int(s): int(n) for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    taken = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int]] = []
    runs = _Runs()

    def put(size: int, first: int, number: int) -> None:
        rows.append((size, taken[size], taken[size] + number, first))
        taken[size] += number
        left[size] -= number

    classes: dict[int, list[int]] = {}
    for s in sorted(left):
        if s > small:
            classes.setdefault(-(-s // grain), []).append(s)
    units = capacity // grain
    counts = np.zeros(units + 2)
    for k, members in classes.items():
        if k <= units:
            counts[k] = sum(left[s] for s in members)
    remaining = {k: sum(left[s] for s in v) for k, v in classes.items()}
    for content, x in sorted(fractional_configurations(counts, units), key=lambda c: -c[1]):
        number = min([math.floor(x), *(remaining[k] // m for k, m in content.items())])
        if number <= 0:
            continue
        for k, m in content.items():
            remaining[k] -= m * number
        open_runs = [(runs.new(number), number, capacity)]
        for k, m in sorted(content.items(), reverse=True):
            for _ in range(m):
                after = []
                for first, n, room in open_runs:
                    while n:
                        while not left[classes[k][-1]]:
                            classes[k].pop()
                        s = classes[k][-1]
                        part = min(n, left[s])
                        put(s, first, part)
                        after.append((first, part, room - s))
                        first, n = first + part, n - part
                open_runs = after
        for first, n, room in open_runs:
            runs.add(room, first, n)
    for s in sorted(left, reverse=True):
        while left[s]:
            found = runs.best(s, left[s])
            if found is None:
                number = -(-left[s] // (capacity // s))
                runs.add(capacity, runs.new(number), number)
                continue
            room, first, number = found
            put(s, first, number)
            runs.add(room - s, first, number)
    return rows, runs.containers


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 2048) -> DataFrame:
    """(key, piece, start, n, container): where each item, or each piece of an item above the capacity, goes."""
    spark = sizes.sparkSession
    items = sizes.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    pieces = F.when(F.col("_size") <= capacity, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), ((F.col("_size") - 1) / capacity).cast("int"))
    )
    items = items.select("_key", "_size", F.explode(pieces).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    items = items.select("_key", "piece", start.alias("start"), F.least(F.col("_size") - start, F.lit(capacity)).cast("long").alias("n"))
    items = cut_lineage(items)
    histogram = {r["n"]: r["count"] for r in items.groupBy("n").count().collect()}  # at most capacity + 1 rows
    total = sum(histogram.values())
    rows, containers = plan(histogram, capacity)
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    shipped = spark.sparkContext.broadcast((table, max(containers, 1)))
    salts = max(8, total // SALT_ROWS)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("_key", "piece"), F.lit(salts)).cast("int"))
    within = Window.partitionBy("n", "_salt").orderBy("_key", "piece")
    before = Window.partitionBy("n").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("n", "_salt").count().select("n", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["n", "_salt"])
    ranked = ranked.select("_key", "piece", "start", "n", (F.col("_rank") + F.col("_before")).alias("_rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, containers = shipped.value
        code = (rows[:, 0] << 40) + rows[:, 1]
        for b in batches:
            n, rank = b["n"].to_numpy(), b["_rank"].to_numpy()
            at = np.searchsorted(code, (n << 40) + rank, "right") - 1
            at = np.clip(at, 0, max(len(rows) - 1, 0))
            box = rank % containers if not len(rows) else np.where(n > 0, rows[at, 3] + rank - rows[at, 1], rank % containers)
            yield pd.DataFrame({"k": b["_key"], "piece": b["piece"], "start": b["start"], "n": n, "container": box.astype("int64")})

    kind = sizes.schema[key].dataType.simpleString()
    return ranked.mapInPandas(place, f"k {kind}, piece int, start long, n long, container long").withColumnRenamed("k", key)
