"""Byte-level BPE over a whole corpus, as a streaming transducer with bounded lookahead.

A text is cut into pre-tokens by the tokenizer's pattern, and the bytes of every pre-token pass the transducer. Bytes
that are still to come can change the tokens before them only so far, and how far follows from the merge list:

- The first token that they can change begins less than the longest token before the end of what was read.
- A change goes on to the left only through a merge: if ``u v`` was joined in one case and not in the other, the place
  before ``u`` can differ only by a merge of a higher rank whose right part begins with ``u``, that is, was built from
  ``u`` by adding to its right. The change then reaches the begin of that merge's left part.

Ranks rise along such a chain of merges, so there is a longest one, counted in bytes of left parts. ``lookahead`` finds it
in one pass over the merges from the highest rank down. Tokens that end at least that far before the end of what was
read are stable and leave the transducer; its buffer is a multiple of the lookahead, whatever the length of the text.
A boundary between stable tokens is crossed by no merge, so the rest is encoded as if the text began there.

Pre-tokens stream as well: of a run that fills the buffer all characters but the last go on to the transducer at once.

Defined cases: a null and an empty text both give an empty list; characters outside the vocabulary cannot occur, as
all 256 bytes are tokens; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Pre-tokens held in the memo at most; it is emptied when full, so a worker's memory stays bounded.
MEMO = 400_000
#: Texts longer than this are scanned in blocks of this many characters.
BLOCK = 1 << 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_vocabulary(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def merge_bytes(ranks: dict[bytes, int], data: bytes) -> list[bytes]:
    """The tokens of a short run by the merge list itself: the lowest-ranked neighbours are joined first."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def merge_long(ranks: dict[bytes, int], data: bytes) -> list[bytes]:
    """merge_bytes for a long run: the neighbours wait in a heap."""
    n = len(data)
    parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    waiting = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapify(waiting)
    while waiting:
        _, i, size = heappop(waiting)
        left = parts[i]
        j = after[i]
        if left is None or j >= n or len(left) + len(parts[j]) != size:
            continue  # one of the two has been joined meanwhile
        parts[i], parts[j] = left + parts[j], None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(parts[i] + parts[k])) is not None:
                heappush(waiting, (r, i, size + len(parts[k])))
        h = before[i]
        if h >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
            heappush(waiting, (r, h, len(parts[h]) + size))
    return [p for p in parts if p is not None]


def lookahead(ranks: dict[bytes, int]) -> int:
    """How many bytes before the end of what was read a token must end to be stable. Every way to build a token from two
    of lower rank counts as a merge."""
    reach: dict[bytes, int] = {}  # of the merges seen, the longest chain that goes on from a piece
    longest = 0
    for token, rank in sorted(ranks.items(), key=lambda e: -e[1]):
        merges = [(token[:i], token[i:]) for i in range(1, len(token))]
        chains = [(v, len(u) + reach.get(u, 0)) for u, v in merges if ranks.get(u, rank) < rank and ranks.get(v, rank) < rank]
        for v, size in chains:
            longest = max(longest, size)
            for piece in (v[:i] for i in range(1, len(v) + 1)):  # what v may have been built from by adding to its right
                if piece in ranks:
                    reach[piece] = max(reach.get(piece, 0), size)
    return max(map(len, ranks)) - 1 + longest


class Transducer:
    """Bytes of one pre-token in, stable token ids out."""

    def __init__(self, ranks: dict[bytes, int], ahead: int):
        self.ranks, self.ahead = ranks, ahead
        self.room = 8 * max(ahead, 32)

    def run(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """The buffer holds at most room bytes and a block; what is stable leaves it."""
        held, ranks = b"", self.ranks
        for block in blocks:
            held = held + block if held else block
            while len(held) > self.room:
                window, done = held[: self.room], 0
                for token in merge_long(ranks, window):
                    if done + len(token) > self.room - self.ahead:
                        break
                    done += len(token)
                    yield ranks[token]
                held = held[done:]
        if held:
            for token in merge_bytes(ranks, held) if len(held) < 32 else merge_long(ranks, held):
                yield ranks[token]


#: Characters for which the classes of the standard library differ from the pattern's: numbers that are no decimal digits, and four separators.
ODD = frozenset("\x1c\x1d\x1e\x1f") | {c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()}
_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
_plain = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")).findall
_any = regex.compile(PATTERN).findall


def _split(text: str) -> list[str]:
    """The pattern's matches, by the fastest engine that gives the same ones."""
    if text.isascii():
        return _ascii(text)
    return _plain(text) if ODD.isdisjoint(text) else _any(text)


_RUNS = {k: regex.compile(v) for k, v in {"L": r"\p{L}*", "N": r"\p{N}*", "O": r"[^\s\p{L}\p{N}]*", "S": r"\s*"}.items()}


def _run_kind(c: str) -> str:
    return next(k for k, r in _RUNS.items() if r.match(c).end())


def pretokens(blocks: Iterable[str], most: int = BLOCK) -> Iterator[tuple[str, bool]]:
    """Pieces of pre-tokens of a text that comes in blocks, and whether each ends one. The last two matches of what was
    read wait for more: no pre-token's end depends on anything beyond the two that follow it. Of a match longer than
    ``most`` characters all but the last are given at once, as it can only grow."""
    held, kind = "", ""
    for block in chain(blocks, (None,)):
        last = block is None
        held += block or ""
        if kind:
            end = _RUNS[kind].match(held).end()
            if end == len(held) and not last:
                yield held[:-1], False
                held = held[-1:]
                continue
            if kind == "S" and end < len(held):
                end -= 1  # the last blank belongs to what follows
            yield held[:end], True
            held, kind = held[end:], ""
        found = _split(held)
        if last:
            yield from ((f, True) for f in found)
        elif len(found) > 2 and len(found[-1]) <= most:
            yield from ((f, True) for f in found[:-2])
            held = found[-2] + found[-1]
        elif found and len(found[-1]) > most:
            yield from ((f, True) for f in found[:-1])
            yield found[-1][:-1], False
            held = found[-1][-1:]
            kind = _run_kind(held)


class Memo(dict):
    """Pre-token to its ids, as the transducer gives them; emptied when full."""

    def __init__(self, transducer: Transducer, count_only: bool = False):
        self.transducer, self.count_only = transducer, count_only

    def __missing__(self, word: str):
        data = word.encode()
        ids = tuple(self.transducer.run((data,)))
        value = len(ids) if self.count_only else ids
        if len(data) <= 256:
            if len(self) >= MEMO:
                self.clear()
            self[word] = value
        return value


class Encoder:
    def __init__(self, ranks: dict[bytes, int], ahead: int | None = None):
        self.transducer = Transducer(ranks, lookahead(ranks) if ahead is None else ahead)
        self.ids, self.sizes = Memo(self.transducer), Memo(self.transducer, True)

    def stream(self, blocks: Iterable[str]) -> Iterator[int]:
        """The ids of a text that comes in blocks, in memory that does not grow with it."""
        pieces = pretokens(blocks)
        for piece, ends in pieces:
            if ends:
                yield from self.ids[piece]
                continue

            def rest(first: str = piece) -> Iterator[bytes]:
                yield first.encode()
                for more, last in pieces:
                    yield more.encode()
                    if last:
                        return

            yield from self.transducer.run(rest())

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= BLOCK:
            return list(chain.from_iterable(map(self.ids.__getitem__, _split(text))))
        return list(self.stream(text[i : i + BLOCK] for i in range(0, len(text), BLOCK)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) <= BLOCK:
            return sum(map(self.sizes.__getitem__, _split(text)))
        return sum(1 for _ in self.stream(text[i : i + BLOCK] for i in range(0, len(text), BLOCK)))


class Decoder:
    """Ids in, text out: a state machine over bytes that holds back an unfinished character."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = {i: t for t, i in ranks.items()}

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            piece = state.decode(self.bytes[i])
            if piece:
                yield piece
        rest = state.decode(b"", True)
        if rest:
            yield rest

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


_encoders: dict[int, Encoder] = {}


def encoder_of(shipped: tuple[bytes, int]) -> Encoder:
    """One encoder a worker process; the vocabulary and its lookahead came with the broadcast."""
    key = hash(shipped)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(parse_vocabulary(shipped[0]), shipped[1])
    return _encoders[key]


@lru_cache(maxsize=4)
def _lookahead_of(raw: bytes) -> int:
    return lookahead(parse_vocabulary(raw))


def _ship(df: DataFrame, vocabulary: str | None):
    # one vocabulary file, under 1 MB whatever the corpus
    raw = read_vocabulary(vocabulary or default_vocabulary())
    return df.sparkSession.sparkContext.broadcast((raw, _lookahead_of(raw)))


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's text. No shuffle; one pass over the two columns it needs."""
    raw = _ship(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(raw.value)
        for batch in batches:
            offsets, flat = [0], array("i")
            for value in batch.column(1).to_pylist():
                flat.extend(encode.encode(value))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memoryview(flat), pa.int32()) if len(flat) else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["k", "ids"])

    source = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return source.mapInArrow(run, f"k {df.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens) without building the ids."""
    raw = _ship(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(raw.value)
        for batch in batches:
            sizes = [encode.count(value) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["k", "n_tokens"])

    source = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return source.mapInArrow(run, f"k {df.schema[key].dataType.simpleString()}, n_tokens long").withColumnRenamed("k", key)
