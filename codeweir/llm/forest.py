"""The k most similar vectors of every vector, by a forest of sorted hash strings.

Each tree gives a vector a string of bits. The string is made of digits: a digit is the place of the nearest of a few
pivots, which are vectors of a bounded sample (``SAMPLE``), and pivots whose places share leading bits lie near each
other, so that every prefix, also within a digit, is a coarser cell of the same kind. Only the pivots come from the
sample; every vector is indexed. The strings of a tree, sorted, are its array; a prefix is a run of it.

The search is the forest's own:

1. Descent. The trees' upper nodes are counted, a digit at a time and only below nodes that still hold more rows than
   a tree's part of the candidates. With these counts each vector descends in every tree to its longest prefix that
   is counted.
2. Ascent. From there all trees go up together, bit by bit, until the nodes that hold the vector have ``reach``
   members in all. A vector in thin nodes goes up further than one in dense ones; none is left with fewer.
3. Comparison. The rows of a node are compared in blocks by matrix products, every vector with the members of its own
   node only; the best of all trees are merged. A node larger than a block is cut into pairs of blocks, in tasks of
   their own, and loses no pair.

What meets depends on the strings alone: neither the number of partitions nor the size of a task changes a row.
``reach`` is ``REACH * n ** POWER`` candidates for n vectors: clusters of even noise hold their accuracy only if it
grows with the collection. Vectors of equal direction are one class, indexed once however many there are.

Defined cases: null vectors, vectors of another size, with NaN or infinite numbers, and zero vectors are left out;
ties go to the smaller id; with fewer than k + 1 usable vectors all others are given; an empty table gives an empty
result; repeated ids count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweir.session import write_shared

#: Trees, bits of each digit, vectors that pivots are drawn from.
TREES, DIGITS, SAMPLE = 6, (7, 7, 6), 4000
REACH, POWER = 0.5, 0.85
#: Rows of a block of a node, rows that a task takes, about, and similarities held at once.
BLOCK, TASK_ROWS, AT_ONCE = 16_384, 40_000, 4_000_000


def usable(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(key, v): vectors of that size with finite numbers that are not all zero."""
    v = F.col(vector)
    fine = F.coalesce(F.size(v) == size, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & v.isNotNull()).where(fine).select(F.col(key).alias("k"), v.cast("array<double>").alias("v"))


def _directions(df: DataFrame) -> DataFrame:
    """(k, u): the unit vector as 32-bit floats, rounded so that equal directions have equal bytes."""

    def norm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                x = x / np.abs(x).max(1, keepdims=True)
                x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 6).astype(np.float32) + np.float32(0)
                yield pd.DataFrame({"k": b["k"], "u": [r.tobytes() for r in x]})

    return df.mapInPandas(norm, f"k {df.schema['k'].dataType.simpleString()}, u binary")


def _ordered(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each half, quarter and so on lies together."""
    if len(pivots) < 3:
        return pivots
    centred = pivots - pivots.mean(0)
    one = centred[(centred**2).sum(1).argmax()]
    other = centred[((centred - one) ** 2).sum(1).argmax()]
    order, half = np.argsort(centred @ (one - other), kind="stable"), len(pivots) // 2
    return np.concatenate((_ordered(pivots[order[:half]]), _ordered(pivots[order[half:]])))


def make_pivots(sample: np.ndarray, trees: int, digits: tuple[int, ...], seed: int = 7) -> list[list[np.ndarray]]:
    """The pivots of each digit of each tree."""
    rng = np.random.default_rng(seed)
    draw = lambda size: rng.choice(len(sample), size, replace=len(sample) < size)
    return [[_ordered(sample[draw(1 << b)]) for b in digits] for _ in range(trees)]


def strings(x: np.ndarray, pivots: list[list[np.ndarray]], digits: tuple[int, ...]) -> np.ndarray:
    """The code of each row in each tree."""
    codes = np.zeros((len(x), len(pivots)), np.int64)
    for t, own in enumerate(pivots):
        for b, p in zip(digits, own):
            codes[:, t] = (codes[:, t] << b) + (x @ p.T).argmax(1)
    return codes


class Trie(NamedTuple):
    """The counted nodes of a tree: disjoint runs of codes, sorted, that hold all rows."""

    low: np.ndarray
    high: np.ndarray
    before: np.ndarray  # rows in the runs before each, and all rows at the end

    def sizes(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows in the nodes [low, high); a node inside a counted one counts as that one."""
        return self.before[np.searchsorted(self.low, high, "left")] - self.before[np.searchsorted(self.high, low, "right")]


def _node(codes: np.ndarray, bits: int, depth) -> tuple[np.ndarray, np.ndarray]:
    rest = bits - depth
    low = (codes >> rest) << rest
    return low, low + (np.int64(1) << rest)


def ascend(codes: np.ndarray, tries: list[Trie], bits: int, reach: int) -> np.ndarray:
    """The greatest depth at which the nodes of all trees hold at least reach rows together; 0 if none does."""
    depth = np.zeros(len(codes), np.int64)
    for d in range(1, bits + 1):
        total = sum(trie.sizes(*_node(codes[:, t], bits, d)) for t, trie in enumerate(tries))
        enough = total >= reach
        depth[enough] = d
        if not enough.any():
            break
    return depth


def _matrix(column: pd.Series, trees: int) -> np.ndarray:
    return np.concatenate(column.to_numpy()).astype(np.int64).reshape(-1, trees) if len(column) else np.zeros((0, trees), np.int64)


def count_nodes(index: DataFrame, trees: int, digits: tuple[int, ...], least: int) -> list[Trie]:
    """The tries of the upper nodes: a node of more than least rows is divided by its next digit.

    The driver holds at most trees * n / least * 2 ** digit counts; with the default reach that grows with n ** 0.15."""
    spark, bits, at = index.sparkSession, sum(digits), 0
    kept: list[list[tuple[int, int, int]]] = [[] for _ in range(trees)]
    parents = [np.zeros(1, np.int64)] * trees
    for step, width in enumerate(digits):
        at += width
        shipped = spark.sparkContext.broadcast((parents, bits - at, width))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            wanted, rest, own = shipped.value
            for b in batches:
                codes = _matrix(b["codes"], trees)
                for t in range(trees):
                    node = codes[:, t] >> rest
                    value, n = np.unique(node[np.isin(node >> own, wanted[t])], return_counts=True)
                    yield pd.DataFrame({"tree": t, "node": value, "n": n})

        counted = index.select("codes").mapInPandas(count, "tree int, node long, n long").groupBy("tree", "node").agg(F.sum("n")).collect()
        parents_next: list[list[int]] = [[] for _ in range(trees)]
        for t, node, n in counted:
            if n > least and step + 1 < len(digits):
                parents_next[t].append(node)
            else:
                kept[t].append((node << (bits - at), (node + 1) << (bits - at), n))
        parents = [np.array(sorted(p), np.int64) for p in parents_next]
        shipped.unpersist()
    tries = []
    for own in kept:
        low, high, n = np.array(sorted(own), np.int64).T
        tries.append(Trie(low, high, np.concatenate(([0], np.cumsum(n)))))
    return tries


class Placed(NamedTuple):
    """The nodes of a tree whose rows are compared together, with their blocks and the first group of each."""

    low: np.ndarray
    blocks: np.ndarray
    first: np.ndarray


def place(tries: list[Trie], reached: list[np.ndarray], bits: int, block: int) -> list[Placed]:
    """For each tree the largest of the nodes that rows have ascended to, given the least depth in each counted node."""
    out, group = [], 0
    for trie, depth in zip(tries, reached):
        width = (trie.high - trie.low).astype(float)
        own = bits - np.round(np.log2(width)).astype(np.int64)
        low, high = _node(trie.low, bits, np.minimum(depth, own))
        order = np.lexsort((-high, low))
        low, high = low[order], high[order]
        ends = np.maximum.accumulate(high)
        outer = np.concatenate(([True], low[1:] >= ends[:-1]))
        low, high = low[outer], high[outer]
        blocks = -(-trie.sizes(low, high) // block)
        first = group + np.concatenate(([0], np.cumsum(blocks**2)))
        group = int(first[-1])
        out.append(Placed(low, blocks, first[:-1]))
    return out


QUERY, MEMBER = 1, 2


def _groups(codes: np.ndarray, c: np.ndarray, placed: list[Placed]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree, group, role): the groups that each row goes to. A node of one block is one group; of a larger one each
    pair of blocks is one, and a row meets all blocks as query and is met by all as member."""
    rows, trees, groups, roles = [], [], [], []
    for t, p in enumerate(placed):
        node = np.searchsorted(p.low, codes[:, t], "right") - 1
        blocks, first = p.blocks[node], p.first[node]
        own = (c.view(np.uint64) % blocks.astype(np.uint64)).astype(np.int64)
        for j in range(int(blocks.max(initial=0))):
            there = np.flatnonzero(blocks > j)
            same = own[there] == j
            for at, role in ((there, np.where(same, QUERY | MEMBER, QUERY)), (there[~same], MEMBER)):
                i = own[at]
                groups.append(first[at] + (i * blocks[at] + j if role is not MEMBER else j * blocks[at] + i))
                rows.append(at)
                trees.append(np.full(len(at), t))
                roles.append(np.broadcast_to(role, len(at)))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, trees, groups, roles))


def _best(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, depth: np.ndarray, role: np.ndarray, bits: int, k: int, floor: float) -> Iterator[tuple]:
    """(id, id of a neighbour, similarity): of the members in each query's node, its k most similar of at least floor."""
    members = np.flatnonzero(role & MEMBER)
    members = members[np.lexsort((ids[members], codes[members]))]
    queries = np.flatnonzero(role & QUERY)
    low, high = _node(codes[queries], bits, depth[queries])
    i, j = np.searchsorted(codes[members], low), np.searchsorted(codes[members], high)
    order = np.lexsort((ids[queries], j, i))
    queries, i, j = queries[order], i[order], j[order]
    edges = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True])))
    for a, b in zip(edges[:-1], edges[1:]):
        near = members[i[a] : j[a]]
        y = x[near].T
        size = max(1, AT_ONCE // max(1, len(near)))
        for at in range(a, b, size):
            own = queries[at : min(at + size, b)]
            s = x[own] @ y
            least = np.full(len(own), floor - 1e-5 if floor > -1 else -2.0, np.float32)
            if floor <= -1 and len(near) > k + 1:  # the query itself is among them
                least = np.partition(s, len(near) - k - 1, axis=1)[:, len(near) - k - 1]
            row, col = np.nonzero(s >= least[:, None])
            row, col = own[row], near[col]
            other = row != col
            row, col = row[other], col[other]
            value = np.round(np.einsum("ij,ij->i", x[row].astype(np.float64), x[col].astype(np.float64)), 9)
            order = np.lexsort((ids[col], -value, row))
            row, col, value = row[order], col[order], value[order]
            keep = (np.arange(len(row)) - np.searchsorted(row, row, "left") < k) & (value >= floor)
            yield ids[row[keep]], ids[col[keep]], value[keep]


def _whole_groups(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """The groups of sorted batches, each whole, one at a time."""
    held: list[pd.DataFrame] = []
    for b in batches:
        g = b[column].to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(b)]))
        for low, high in zip(edges[:-1], edges[1:]):
            if low == high:
                continue
            if held and held[-1][column].iloc[0] != g[low]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(b.iloc[low:high])
    if held:
        yield pd.concat(held, ignore_index=True)


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 10, floor: float = -1.0, trees: int = TREES, digits: tuple[int, ...] = DIGITS, reach: float = REACH, block: int = BLOCK) -> DataFrame:
    """(key_a, key_b, similarity, place): key_b is among the k most similar of key_a.

    With a floor only neighbours at least so similar are given; as all that outrank them are so similar too, that
    changes nothing about their places but saves carrying the rest."""
    spark = df.sparkSession
    units = _directions(usable(df, key, vector, size).dropDuplicates(["k"]))
    members = write_shared(units.select("k", "u", F.xxhash64("u").alias("c")))
    firsts = members.withColumn("_n", F.row_number().over(Window.partitionBy("c").orderBy("k"))).where(F.col("_n") <= k + 1)
    classes = firsts.groupBy("c").agg(F.first("u").alias("u"), F.sort_array(F.collect_list("k")).alias("firsts"))
    sample = members.select("c", "u").distinct().orderBy(F.xxhash64("c")).limit(SAMPLE).collect()  # bounded, 1 MB
    kind = df.schema[key].dataType.simpleString()
    out = f"{key}_a {kind}, {key}_b {kind}, similarity double, place int"
    if not sample:
        return spark.createDataFrame([], out)
    bits = sum(digits)
    pivots = spark.sparkContext.broadcast(make_pivots(np.stack([np.frombuffer(r["u"], np.float32) for r in sample]), trees, digits))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                x = np.frombuffer(b"".join(part["u"]), np.float32).reshape(len(part), -1)
                yield part.assign(codes=list(strings(x, pivots.value, digits)))

    index = write_shared(classes.select("c", "u", "firsts").mapInPandas(hashed, f"c long, u binary, firsts array<{kind}>, codes array<long>"))
    count = index.count()
    wanted = math.ceil(max(reach * count**POWER, 4 * k * trees))
    tries = count_nodes(index, trees, digits, max(1, wanted // (2 * trees)))
    shipped = spark.sparkContext.broadcast(tries)

    def depths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        least = [np.full(len(t.low), bits, np.int64) for t in own]
        for b in batches:
            codes = _matrix(b["codes"], trees)
            depth = ascend(codes, own, bits, wanted)
            for t in range(trees):
                np.minimum.at(least[t], np.searchsorted(own[t].low, codes[:, t], "right") - 1, depth)
        yield pd.DataFrame({"tree": np.repeat(np.arange(trees), [len(x) for x in least]), "node": np.concatenate([np.arange(len(x)) for x in least]), "depth": np.concatenate(least)})

    reached = [np.full(len(t.low), bits, np.int64) for t in tries]
    for r in index.select("codes").mapInPandas(depths, "tree int, node int, depth int").groupBy("tree", "node").agg(F.min("depth").alias("depth")).collect():  # a row a counted node
        reached[r["tree"]][r["node"]] = r["depth"]
    placed = spark.sparkContext.broadcast(place(tries, reached, bits, block))

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes, c, u = _matrix(b["codes"], trees), b["c"].to_numpy(), b["u"].to_numpy()
            depth = ascend(codes, shipped.value, bits, wanted)
            row, tree, group, role = _groups(codes, c, placed.value)
            yield pd.DataFrame({"g": group, "role": role.astype(np.int8), "depth": depth[row].astype(np.int8), "code": codes[row, tree], "c": c[row], "u": u[row]})

    parts = max(spark.sparkContext.defaultParallelism, math.ceil(count * trees / TASK_ROWS))
    arrays = index.select("c", "u", "codes").mapInPandas(sent, "g long, role byte, depth byte, code long, c long, u binary")
    arrays = arrays.repartition(parts, "g").sortWithinPartitions("g", "code", "c")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_groups(batches, "g"):
            x = np.frombuffer(b"".join(b["u"]), np.float32).reshape(len(b), -1)
            numbers = [b[c].to_numpy(np.int64) for c in ("c", "code", "depth", "role")]
            for a, n, s in _best(numbers[0], x, *numbers[1:], bits, k, floor):
                if len(a):
                    yield pd.DataFrame({"c": a, "n": n, "s": s})

    found = arrays.mapInPandas(search, "c long, n long, s double").groupBy("c", "n").agg(F.max("s").alias("s"))
    order = Window.partitionBy("c").orderBy(F.desc("s"), "n")
    found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    names = index.select("c", "firsts")
    far = found.join(names.select(F.col("c").alias("n"), "firsts"), "n").groupBy("c").agg(F.collect_list(F.struct("s", "firsts")).alias("far"))
    entries = F.flatten(F.transform("far", lambda e: F.transform(e["firsts"], lambda x: F.struct((-e["s"]).alias("s"), x.alias("k")))))
    own = F.transform("firsts", lambda x: F.struct(F.lit(-1.0).alias("s"), x.alias("k")))
    none = F.array().cast(f"array<struct<s:double,k:{kind}>>")
    near = names.join(far, "c", "left").select("c", F.slice(F.array_sort(F.concat(own, F.coalesce(entries, none))), 1, k + 1).alias("near"))
    each = members.select("k", "c").join(near, "c").select("k", F.filter("near", lambda e: e["k"] != F.col("k")).alias("near"))
    each = each.select("k", F.posexplode(F.slice("near", 1, k)).alias("_p", "e"))
    return each.select(F.col("k").alias(f"{key}_a"), F.col("e.k").alias(f"{key}_b"), (-F.col("e.s")).alias("similarity"), (F.col("_p") + 1).alias("place"))


def close_pairs(near: DataFrame, key: str = "vec_id", least: float = 0.95) -> DataFrame:
    """(key_a, key_b), the smaller first: pairs at least so similar of which one is among the other's nearest."""
    a, b = F.col(f"{key}_a"), F.col(f"{key}_b")
    return near.where(F.col("similarity") >= least).select(F.least(a, b).alias(f"{key}_a"), F.greatest(a, b).alias(f"{key}_b")).distinct()
