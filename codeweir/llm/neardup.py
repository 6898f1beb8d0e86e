"""Groups of near-equal records, by SetSketch registers.

The features of a record are its distinct runs of successive words. Each register holds the truncated, exponentially
spaced minimum of the features' hashes, ``1 - floor(log_b(x))``; registers of two records merge by the maximum and
agree with a probability close to their similarity, so bands of registers make buckets. Inside a bucket no list of
pairs is made: pivots meet the members of other components, then leave, until the bucket holds one component. A bucket
in which, after its first pivots, more than ``MANY`` members are still outside the largest component is hot: it holds
unlike records with a part in common. The members of all hot buckets are joined exactly: their features are put in one
order, the rarer first, and of two sets alike enough a feature in common stands early in both, so each is listed under
its early features only, which the part in common seldom reaches. What is listed under a feature is a bucket again, in
which a pair meets if as many features can follow as it needs; its pivots grow fourfold a round, and after ``DEEPEST``
rounds all are taken. A pair is first estimated by the joint likelihood of its registers and sizes; what the estimate
does not rule out is verified on the whole feature sets.

Exact copies (equal feature sets) are one class from the start. With ``bands`` bands of ``rows`` registers a pair of
similarity s shares a bucket with probability 1 - (1 - s**rows)**bands: 0.9987 at 0.6 with the defaults, above 0.9999
from 0.65, whether its buckets are hot or not. Class keys are 64-bit digests; N classes make about N**2 / 2**65 false copies.

Defined cases: a null text, and one with fewer words than a run, has no features and is in no group; equal sets are
alike whatever their size; repeated rows of a key count once; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweir.llm.components import components
from codeweir.session import cut_lineage, write_shared

BANDS, ROWS = 48, 4
BASE, RATE, LIMIT = 1.001, 20.0, 65535
#: A pair is dropped unverified only if its estimate is this far below the threshold, five standard errors.
SLACK = 0.18
#: Members outside the largest component that a bucket may hold to be finished by pivots in one round; first pivots of a
#: larger bucket; rounds after which a feature's bucket takes all its pivots at once.
MANY, FIRST, DEEPEST = 64, 8, 5
#: Counters that features are ordered by, 8 MB; two features may share one, which changes the order, not the result.
COUNTERS = 1 << 20
#: A list of at most so many nodes (1.6 MB) is broadcast.
NODES = 200_000
_words = re.compile(r"\w+").findall
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Word to 64-bit hash, held between batches and emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def features(text: str | None, hashes: WordHashes, run: int = 3) -> np.ndarray:
    """Sorted hashes of the distinct runs of successive words."""
    words = _words(text.lower()) if text else []
    if len(words) < run:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - run + 1
    mixed = h[:n].copy()
    for k in range(1, run):
        mixed = _mix(mixed * _M1 + h[k : k + n])
    return np.unique(mixed)


def _seeds(registers: int) -> np.ndarray:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**64, registers, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, registers, dtype=np.uint64)


def sketch(f: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Registers of a feature set. The minimum is taken over integer hashes; the logarithm follows once a register."""
    times, plus = seeds
    low = np.full(len(times), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(f), 256):  # blocks that stay in the cache
        h = (f[at : at + 256, None] ^ plus[None, :]) * times[None, :]
        h ^= h >> np.uint64(32)
        h *= times[None, :]
        np.minimum(low, (h >> np.uint64(32)).min(0).astype(np.uint32), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 100) -> np.ndarray:
    """Similarity of each pair of register rows by maximum likelihood, given the sizes."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, steps + 1)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    level = above[:, None] * np.log(up) + below[:, None] * np.log(down) + same[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    return j[np.arange(len(j)), level.argmax(1)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(len(a) + len(b) - common, 1)


def _sketched(df: DataFrame, key: str, text: str, run: int, registers: int) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seeds = WordHashes(), _seeds(registers)
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"]):
                f = features(t, hashes, run)
                if len(f):
                    digest = int.from_bytes(hashlib.blake2b(f.tobytes(), digest_size=8).digest(), "little", signed=True)
                    rows.append((k, digest, len(f), sketch(f, seeds).tobytes(), f.tobytes()))
            yield pd.DataFrame(rows, columns=["k", "node", "n", "registers", "features"])

    source = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    return source.mapInPandas(make, f"k {df.schema[key].dataType.simpleString()}, node long, n int, registers binary, features binary")


def _band_hashes(registers: pd.Series, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each row of registers; its last six bits are the band."""
    if bands > 64:
        raise ValueError("at most 64 bands")
    weights = _seeds(rows)[0] * _M1
    r = np.frombuffer(b"".join(registers), np.uint16).reshape(len(registers), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros((len(registers), bands), np.uint64)
        for i in range(rows):
            h = _mix((h ^ r[:, :, i]) * weights[i] + np.uint64(i + 1))
        number = np.arange(bands, dtype=np.uint64)[None, :]
        return (_mix(h + (number + np.uint64(1)) * _M1) & ~np.uint64(63)) | number


#: A member of a bucket; turn counts the bucket's rounds. Under a feature, n is the size of the member's set and room the
#: number of its features from this one on.
_BUCKETS = "bucket long, node long, turn int, n int, room int"


def _shared(banded: DataFrame) -> DataFrame:
    """The rows of the buckets with more than one node."""
    shared = banded.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    return banded.join(shared, "bucket", "left_semi")


def _buckets(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """The members of the bands' buckets with more than one node."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                h = _band_hashes(b["registers"], bands, rows)
                yield pd.DataFrame({"bucket": h.ravel().view(np.int64), "node": np.repeat(b["node"].to_numpy(), bands)})

    shared = _shared(nodes.select("node", "registers").mapInPandas(cut, "bucket long, node long"))
    none = F.lit(None).cast("int")
    return shared.select("bucket", "node", F.lit(0).alias("turn"), none.alias("n"), none.alias("room"))


def _divided(hot: DataFrame, whole: DataFrame, threshold: float) -> DataFrame:
    """The members of hot buckets under each of their early features. A pair as alike as the threshold has a feature in
    common from which on both have room for the number they must share, so none is lost."""

    def slots(f: np.ndarray) -> np.ndarray:
        return (f % np.uint64(COUNTERS)).astype(np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNTERS, np.int64)
        for b in batches:
            if len(b):
                counts += np.bincount(slots(np.frombuffer(b"".join(b["features"]), np.uint64)), minlength=COUNTERS)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": at, "c": counts[at]})

    wanted = cut_lineage(hot.select("node").distinct())
    few = wanted.count() <= NODES
    sets = whole.select("node", "features").join(F.broadcast(wanted) if few else wanted, "node")
    total = sets.select("features").mapInPandas(count, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[total["slot"].to_numpy(np.int64)] = total["c"].to_numpy(np.int64)

    def early(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            keys, rooms, sizes = [], [], []
            for data in b["features"]:
                f = np.frombuffer(data, np.uint64)
                c = counts[slots(f)]
                order = np.lexsort((f, c))
                room = len(f) - np.arange(len(f))
                kept = (room + 1e-6 >= threshold * len(f)) & (c[order] > 1)  # one counted once is in no other set
                keys.append(f[order[kept]].view(np.int64))
                rooms.append(room[kept])
                sizes.append(len(f))
            times = [len(k) for k in keys]
            yield pd.DataFrame({"bucket": np.concatenate(keys), "node": np.repeat(b["node"].to_numpy(), times), "turn": 0, "n": np.repeat(sizes, times), "room": np.concatenate(rooms)})

    return _shared(sets.mapInPandas(early, _BUCKETS)).dropDuplicates(["bucket", "node"])


def _verified(pairs: DataFrame, nodes: DataFrame, whole: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose feature sets are at least threshold alike."""

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ra, rb = (np.frombuffer(b"".join(b[c]), np.uint16).reshape(len(b), -1) for c in ("ra", "rb"))
                j = estimate(ra, rb, b["na"].to_numpy(float), b["nb"].to_numpy(float))
                yield b.loc[j >= threshold - SLACK, ["a", "b"]]

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                alike = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold for x, y in zip(b["fa"], b["fb"])]
                yield b.loc[np.array(alike, bool), ["a", "b"]]

    def both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        """The pairs with both sides' columns. Only the rows of nodes in a pair are moved: a short list of nodes goes to
        the table, a longer one than NODES is joined by shuffling."""
        wanted = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        few = wanted.count() <= NODES
        rows = table.select("node", *columns).join(F.broadcast(wanted) if few else wanted, "node").dropDuplicates(["node"])
        for side in ("a", "b"):
            pairs = pairs.join(rows.select(F.col("node").alias(side), *[F.col(c).alias(f"{c[0]}{side}") for c in columns]), side)
        return pairs

    near = cut_lineage(both(cut_lineage(pairs), nodes, ["registers", "n"]).mapInPandas(screen, "a long, b long"))
    return both(near, whole, ["features"]).mapInPandas(exact, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "id", text: str = "code", threshold: float = 0.6, run: int = 3, bands: int = BANDS, rows: int = ROWS, many: int = MANY) -> DataFrame:
    """(key, class, group, links) for every record that has features: its class of equal sets, its group, and the number
    of verified links of its class to others. Records of no group stand alone in theirs."""
    made = write_shared(_sketched(df, key, text, run, bands * rows))
    members = made.select("k", "node").distinct()
    nodes = write_shared(made.select("node", "n", "registers").dropDuplicates(["node"]))
    pending = cut_lineage(_buckets(nodes, bands, rows))
    labels = links = None
    rounds = 0  # no bucket has had more
    # of a pair under a feature, the smaller set has room for twice its share; only such a member leads
    lead = F.coalesce((1 + threshold) * F.col("room") + 1e-6 >= 2 * threshold * F.col("n"), F.lit(True))
    fits = F.coalesce((1 + threshold) * F.least("room", "p_room") + 1e-6 >= threshold * (F.col("n") + F.col("p_n")), F.lit(True))
    while True:
        own = pending if labels is None else pending.join(labels, "node", "left")
        own = own.select("bucket", "node", "turn", "n", "room", (F.col("node") if labels is None else F.coalesce("label", "node")).alias("label"))
        parts = own.groupBy("bucket", "label").agg(F.count("*").alias("size"), F.count_if(lead).alias("leads"), F.max("n").alias("n"))
        state = parts.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("most"), F.count("*").alias("parts"), F.sum("size").alias("all"), F.sum("leads").alias("leads"), F.max("n").isNull().alias("band"))
        state = state.where("parts > 1 and leads > 0").withColumn("outside", F.col("all") - F.col("most.size"))
        state = state.select("bucket", "band", F.col("most.label").alias("kept"), F.least("outside", "leads").alias("left"), (F.col("leads") < F.col("outside")).alias("by_leads"))
        rows_left = cut_lineage(own.join(state, "bucket"))
        if rows_left.isEmpty():
            break
        hot = F.col("band") & (F.col("turn") > 0) & (F.col("left") > many)
        members_of = rows_left.where(hot)
        divided = None if members_of.isEmpty() else _divided(members_of, made, threshold)
        rows_left = rows_left.where(~hot)
        # all that lead, or all outside the largest component, are pivots in the end: every other pair is of one component
        # or does not fit. A fresh bucket has one pivot, a large one FIRST; later ones many, then four times as many a round
        order = Window.partitionBy("bucket").orderBy("node")
        grown = F.when(F.col("turn") > DEEPEST, F.col("left")).otherwise(many * F.pow(F.lit(4), F.col("turn") - 1))
        allowed = F.when(F.col("turn") > 0, grown).when(F.col("left") > many, FIRST).otherwise(1)
        chosen = rows_left.where(F.when(F.col("by_leads"), lead).otherwise(F.col("label") != F.col("kept"))).withColumn("_n", F.row_number().over(order))
        if rounds <= DEEPEST:  # a plain number, which the window keeps to
            chosen = chosen.where(F.col("_n") <= max(FIRST, many * 4 ** max(rounds - 1, 0)))
        chosen = chosen.where(F.col("_n") <= allowed)
        rows_left = rows_left.join(chosen.select("bucket", "node", F.lit(True).alias("pivot")), ["bucket", "node"], "left").select("bucket", "node", "turn", "n", "room", "label", F.coalesce("pivot", F.lit(False)).alias("pivot"))
        pivots = rows_left.where("pivot").select("bucket", F.col("node").alias("p"), F.col("label").alias("p_label"), F.col("n").alias("p_n"), F.col("room").alias("p_room"))
        met = rows_left.join(pivots, "bucket").where("label <> p_label").where(fits)
        pairs = met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        found = cut_lineage(_verified(pairs, nodes, made, threshold))
        rounds += 1
        pending = rows_left.where("not pivot").select("bucket", "node", (F.col("turn") + 1).alias("turn"), "n", "room")
        if divided is not None:
            pending = pending.unionByName(divided)
        if links is not None and found.isEmpty():
            continue
        links = found if links is None else cut_lineage(links.unionByName(found).distinct())
        labels = cut_lineage(components(links))
    if labels is None:
        return members.select(F.col("k").alias(key), F.col("node").alias("class"), F.col("node").alias("group"), F.lit(0).cast("long").alias("links"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    out = members.join(labels, "node", "left").join(degree, "node", "left")
    return out.select(F.col("k").alias(key), F.col("node").alias("class"), F.coalesce("label", "node").alias("group"), F.coalesce("count", F.lit(0)).alias("links"))


def pairs_in_groups(groups: DataFrame, key: str = "id") -> DataFrame:
    """(key_a, key_b): every two keys of a group, the smaller first. As many rows as the groups have pairs, as asked."""
    own = groups.select(F.col("group").alias("g"), F.col(key).alias("k"))
    many = own.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    own = own.join(many, "g", "left_semi")
    a, b = own.withColumnRenamed("k", f"{key}_a"), own.withColumnRenamed("k", f"{key}_b")
    return a.join(b, "g").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
