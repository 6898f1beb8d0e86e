"""Cutting oversized texts at natural boundaries, with an overlap, by pointer doubling.

A cut may fall after a blank line, a line end, a sentence end or a space; only where a stretch has none of these it
falls between characters.  For every possible cut the next one is fixed: the best boundary within the limit, counted
from where the next piece starts (the cut less the overlap).  That makes a successor table with a row for each
boundary.  The chain of cuts from the start of each text is then read off by squaring the table: jumping 1, 2, 4, ...
steps from the cuts known so far doubles them each time, for all texts of a batch at once, in log2(pieces) rounds.

Defined cases: null, empty and short texts give no piece (they need no cutting); a text of one unbroken run is cut
into pieces of exactly the limit; repeated rows give repeated pieces, so callers drop repeats of a key first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Natural breaks, the strongest first: blank line, line end, sentence end, white space.
BREAKS = (r"\n[ \t]*\r?\n+", r"\r\n|\n|\r", r"[.!?;](?=\s)|[。！？；]", r"\s+")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which the text may be cut, and how strong each break is (4 the strongest)."""
    strength = np.zeros(len(text) + 1, np.int8)
    for level, pattern in enumerate(reversed(BREAKS), 1):
        ends = np.fromiter((m.end() for m in re.finditer(pattern, text)), np.int64)
        strength[ends] = level
    strength[0] = 0
    strength[len(text)] = 5
    at = np.flatnonzero(strength)
    return at, strength[at]


def successors(at: np.ndarray, strength: np.ndarray, start: int, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every boundary (and the text's start, first) the farthest legal next cut, and where its piece starts.

    The piece after a cut starts at the first boundary in the first half of the overlap's window before it, so that it
    opens at a break and repeats at least half of the overlap, else exactly the overlap before. Among the cuts in reach a stronger break wins in the last half of the piece.
    Where a reach holds no boundary, positions between characters are added."""
    end = int(at[-1])
    nodes = np.concatenate(([start], at))
    power = np.concatenate(([0], strength))
    fresh = nodes
    extra: list[np.ndarray] = [nodes]
    while len(fresh):  # add hard cuts until every node has a successor
        begin = np.maximum(fresh - overlap, start)
        reach = np.minimum(begin + limit, end)
        last = np.searchsorted(nodes, reach, "right") - 1
        stuck = (nodes[last] <= fresh) & (fresh < end)
        fresh = np.setdiff1d(reach[stuck], nodes)
        if len(fresh):
            order = np.argsort(np.concatenate((nodes, fresh)), kind="stable")
            power = np.concatenate((power, np.zeros(len(fresh), power.dtype)))[order]
            nodes = np.concatenate((nodes, fresh))[order]
            extra.append(fresh)
    low = np.searchsorted(nodes, np.maximum(nodes - overlap, start), "left")
    opened = nodes[low]
    near = opened <= nodes - (overlap + 1) // 2
    begin = np.where((nodes > start) & near & (opened < nodes) & (power[low] > 0), opened, np.maximum(nodes - overlap, start))
    reach = np.minimum(begin + limit, end)
    last = np.searchsorted(nodes, reach, "right") - 1
    nxt = last.copy()
    half = np.searchsorted(nodes, np.maximum(begin + limit // 2, nodes + 1), "left")
    for level in (1, 2, 3, 4):
        where = np.where(power >= level, np.arange(len(nodes)), -1)
        best = np.maximum.accumulate(where)[last]
        nxt = np.where((best >= half) & (best > np.arange(len(nodes))), best, nxt)
    nxt = np.where(nodes[last] == end, last, nxt)
    return np.maximum(nxt, np.minimum(np.arange(len(nodes)) + 1, len(nodes) - 1)), np.stack((nodes, begin))


def cuts(texts: list[str], limit: int, overlap: int) -> list[list[tuple[int, int]]]:
    """(start, end) of the pieces of each text; all texts share one successor table, squared until every chain has
    reached its text's end."""
    if not texts:
        return []
    tables, places, roots, base = [], [], [], 0
    for text in texts:
        nxt, where = successors(*boundaries(text), 0, limit, overlap)
        tables.append(nxt + base)
        places.append(where)
        roots.append(base)
        base += len(nxt)
    jump, place = np.concatenate(tables), np.concatenate(places, axis=1)
    one = jump
    chain = np.array(roots)[:, None]  # column j: the node after j cuts
    while (one[chain[:, -1]] != chain[:, -1]).any():
        chain = np.concatenate((chain, jump[chain]), axis=1)
        jump = jump[jump]
    out = []
    for row in chain:
        nodes = row[np.concatenate(([True], row[1:] != row[:-1]))]
        out.append(list(zip(place[1][nodes[:-1]].tolist(), place[0][nodes[1:]].tolist())))
    return out


def _portions(b: pd.DataFrame, rows: int = 256, room: int = 1 << 26) -> Iterator[pd.DataFrame]:
    """Rows to be cut together: as the chains of a portion are as long as its longest text's, rows times the longest text
    stay below room characters; a longer text goes alone."""
    b = b.iloc[np.argsort(b["_t"].str.len().to_numpy(), kind="stable")]
    sizes, low = b["_t"].str.len().to_numpy(), 0
    for high in range(1, len(b) + 1):
        if high == len(b) or high - low == rows or (high + 1 - low) * sizes[high] > room:
            yield b.iloc[low:high]
            low = high


def split_oversized(df: DataFrame, key: str, fields: tuple[str, ...], limit: int = 6000, overlap: int = 200) -> DataFrame:
    """(key, field, piece, start, end, text) for every field of every key with more than limit code points.

    The length filter runs in the JVM before anything else, so only oversized texts are shuffled (to drop repeated
    keys) and only they reach Python."""
    if overlap >= limit:
        raise ValueError("the overlap must be smaller than the limit")
    long = None
    for f in fields:
        part = df.where(F.length(f) > limit).select(F.col(key).alias("_k"), F.lit(f).alias("field"), F.col(f).alias("_t"))
        long = part if long is None else long.unionByName(part)
    long = long.dropDuplicates(["_k", "field"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _portions(b):
                texts, out = part["_t"].tolist(), []
                for k, f, t, spans in zip(part["_k"], part["field"], texts, cuts(texts, limit, overlap)):
                    out += [(k, f, i, s, e, t[s:e]) for i, (s, e) in enumerate(spans)]
                yield pd.DataFrame(out, columns=["k", "field", "piece", "start", "end", "text"])

    kind = df.schema[key].dataType.simpleString()
    return long.mapInPandas(run, f"k {kind}, field string, piece int, start int, end int, text string").withColumnRenamed("k", key)
