"""Self-describing values, patches and model answers: recursive or sequential logic, as Arrow-batched functions."""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

#: Exception names of two platforms with their common one; fixed values.
EXCEPTION_ALIASES = {
    "NullPointerException": "NullReferenceException",
    "NullReferenceException": "NullReferenceException",
    "IllegalArgumentException": "ArgumentException",
    "ArgumentException": "ArgumentException",
    "IllegalStateException": "InvalidOperationException",
    "InvalidOperationException": "InvalidOperationException",
    "NoSuchElementException": "InvalidOperationException",
    "IndexOutOfBoundsException": "ArgumentOutOfRangeException",
    "ArgumentOutOfRangeException": "ArgumentOutOfRangeException",
    "UnsupportedOperationException": "NotSupportedException",
    "NotSupportedException": "NotSupportedException",
    "ClassCastException": "InvalidCastException",
    "InvalidCastException": "InvalidCastException",
    "ParseException": "ParseException",
    "IOException": "IOException",
    "FormatException": "ArgumentException",
    "UnsupportedCharsetException": "ArgumentException",
}


def exception_alias(c: Column) -> Column:
    """The last dotted part of an exception's name, mapped to the common name if it has one."""
    simple = F.element_at(F.split(c, r"\."), -1)
    table = F.create_map(*[F.lit(x) for pair in EXCEPTION_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, simple), simple)


def equal_values(a: dict, b: dict, tolerance: float | None = None, relative: float | None = None, fold_case: bool = False) -> bool:
    """Whether two tagged values are equal; tolerances hold for numbers at any depth, NaN equals NaN."""
    kind = a.get("type")
    if kind != b.get("type"):
        return False
    x, y = a.get("value"), b.get("value")
    if kind == "null":
        return True
    if kind == "number":
        x, y = float(x), float(y)
        if math.isnan(x) or math.isnan(y):
            return math.isnan(x) and math.isnan(y)
        if x == y:
            return True
        gap = abs(x - y)
        near = tolerance is not None and gap <= tolerance
        scale = max(abs(x), abs(y), 2.0**-52)
        return near or (relative is not None and math.isfinite(gap) and gap / scale <= relative)
    if kind == "string" and fold_case:
        return x.lower() == y.lower()
    if kind == "list":
        return len(x) == len(y) and all(equal_values(p, q, tolerance, relative, fold_case) for p, q in zip(x, y))
    if kind == "map":
        return x.keys() == y.keys() and all(equal_values(x[k], y[k], tolerance, relative, fold_case) for k in x)
    return kind in ("string", "boolean") and x == y


def typed_equal(a: Column, b: Column, tolerance: float | None = None, relative: float | None = None, fold_case: bool = False) -> Column:
    """equal_values over two JSON columns; false where either is null or no JSON."""

    @F.pandas_udf(BooleanType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x, y) -> bool:
            try:
                return equal_values(json.loads(x), json.loads(y), tolerance, relative, fold_case)
            except (TypeError, ValueError, AttributeError):
                return False

        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype=bool)

    return run(a, b)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(StringType())
def driver_name(s: pd.Series) -> pd.Series:
    """The first eight hex digits of the digest of a value's canonical JSON."""
    return s.map(lambda x: None if x is None else hashlib.sha256(canonical_json(json.loads(x)).encode()).hexdigest()[:8])


def vector_hex(values: list[float]) -> str:
    """A vector as the hexadecimal of its little-endian 32-bit floats."""
    return struct.pack(f"<{len(values)}f", *values).hex()


def hex_vector(text: str) -> list[float]:
    raw = bytes.fromhex(text)
    return list(struct.unpack(f"<{len(raw) // 4}f", raw))


HUNKS = "array<struct<header:string,lines:array<struct<type:string,content:string>>>>"


def apply_hunks(original: str, hunks: list[dict]) -> str:
    """The text with all hunks applied; each must match exactly at or after the end of the one before."""
    if not hunks:
        raise ValueError("no hunks")
    rest, done = original.replace("\r\n", "\n").split("\n"), []
    for h in hunks:
        old = [x["content"] for x in h["lines"] if x["type"] != "add"]
        if not old:
            raise ValueError(f"{h['header']}: nothing to match")
        at = next((i for i in range(len(rest) - len(old) + 1) if rest[i : i + len(old)] == old), None)
        if at is None:
            raise ValueError(f"{h['header']}: no match")
        done += rest[:at] + [x["content"] for x in h["lines"] if x["type"] != "remove"]
        rest = rest[at + len(old) :]
    return "\n".join(done + rest)


def new_file(hunks: list[dict]) -> str:
    lines = [x for h in hunks for x in h["lines"]]
    if not hunks or any(x["type"] != "add" for x in lines):
        raise ValueError("a new file takes added lines only")
    return "\n".join(x["content"] for x in lines)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
def patched(original: pd.Series, hunks: pd.Series) -> pd.DataFrame:
    """(text, error) for each row; a null original makes a new file."""
    rows = []
    for text, own in zip(original, hunks):
        try:
            own = [{"header": h["header"], "lines": list(h["lines"])} for h in (own if own is not None else [])]
            rows.append((new_file(own) if text is None else apply_hunks(text, own), None))
        except ValueError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["text", "error"])


def _readings(text: str):
    yield text
    if m := re.search(r"```(?:json)?\s*(.*?)```", text, re.S):
        yield m[1]
    low, high = text.find("["), text.rfind("]")
    if 0 <= low < high:
        yield text[low : high + 1]
        yield re.sub(r"([{,])\s*([A-Za-z_]\w*)\s*:", r'\1"\2":', text[low : high + 1])


def ranked_answer(text: str | None) -> list[dict] | None:
    """The scored ids in a model's answer, by the first reading that gives any; None if none does."""
    for reading in _readings((text or "").strip()):
        try:
            items = json.loads(reading)
        except ValueError:
            continue
        good = []
        for x in items if isinstance(items, list) else ():
            score = x.get("score") if isinstance(x, dict) else None
            if isinstance(score, int | float) and not isinstance(score, bool) and math.isfinite(score) and isinstance(x.get("id"), str) and x["id"]:
                good.append((x["id"], min(1.0, max(0.0, float(score))), x.get("reason")))
        if good:
            return [{"id": i, "score": s, "reason": r if isinstance(r, str) else f"rank {n}"} for n, (i, s, r) in enumerate(good, 1)]
    return None


@F.pandas_udf(ArrayType(StructType([StructField("id", StringType()), StructField("score", DoubleType()), StructField("reason", StringType())])))
def parse_ranking(s: pd.Series) -> pd.Series:
    return s.map(ranked_answer)


#: Sections given up first when a context is over its budget.
GIVEN_UP = ("callers", "types", "dependencies", "members", "fields")


def within_budget(sections: dict[str, str], most: int) -> dict[str, str]:
    """Sections cut in rounds, the longest first, to 65 % of their length but not below 160 characters; when nothing is
    left to cut, sections are dropped in the order of GIVEN_UP."""
    held = {k: v for k, v in sections.items() if v}
    while sum(map(len, held.values())) > most:
        longest = max(held, key=lambda k: len(held[k]))
        size = max(160, len(held[longest]) * 65 // 100)
        if size < len(held[longest]):
            held[longest] = held[longest][: size * 7 // 10] + held[longest][-(size - size * 7 // 10) :]
            continue
        drop = next((k for k in GIVEN_UP if k in held), None)
        if drop is None:
            break
        del held[drop]
    return held
