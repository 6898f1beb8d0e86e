"""What surrounds a declaration: its range, the type around it, fields, members, constraints, imports; and patches that
replace it. All from the tokens of one file, as Arrow-batched functions; callers in other files are a join (store.callers)."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from codeweir.sources import extract

#: Lines after a given one in which a declaration is looked for; members listed.
SEARCHED, MEMBERS = 33, 12
_constraint = re.compile(r"\bREQ\s*:\s*(.+?)\s*(?:\*/)?\s*$")
_imports = re.compile(r"^\s*(?:(?:using|import|use)\s+[^;]*;?|from\s+\S+\s+import\s+.*)\s*$")
_space = re.compile(r"^\s*(?:namespace|package)\s+([\w.:]+)")
_unfinished = re.compile(r"\b(?:TODO|NotImplemented(?:Error|Exception)?|UnsupportedOperationException|unimplemented!|todo!)|not\s+implemented", re.I)


class Range(NamedTuple):
    kind: str
    name: str
    start: int  # lines, from 0
    end: int


def ranges(text: str, language: str) -> list[Range]:
    """The declarations of a file with the lines they take, whole, in order."""
    lines = extract.scan(text, language)
    out = []
    for s in extract.extract(text, language):
        at = s.line - 1
        end, size = at, extract.PREVIEW_LINES
        while end < len(lines.raw):  # the body may be longer than a preview
            end = extract._last_line(lines, at, language, size)
            if end < at + size:
                break
            size *= 2
        out.append(Range(s.kind, s.name, at, min(end, len(lines.raw)) - 1))
    return out


def _only_prefix(lines: extract.Lines, at: int) -> bool:
    """A blank line, a comment, an annotation or an attribute."""
    row = lines.code[at]
    return not row or row[0] in ("@", "[") or row[:2] == ["#", "["]


def located(text: str, line: int, language: str, kind: str | None = None) -> Range | None:
    """The declaration at a line (from 1), or the next one if nothing but its comments and annotations is between."""
    lines = extract.scan(text, language)
    own = {r.start: r for r in reversed(ranges(text, language)) if kind in (None, r.kind)}
    for at in range(max(line - 1, 0), min(line - 1 + SEARCHED, len(lines.raw))):
        if at in own:
            return own[at]
        if not _only_prefix(lines, at):
            return None
    return None


def context(text: str | None, line: int | None, language: str | None) -> dict | None:
    """What surrounds the declaration at a line; None if there is none."""
    if not text or line is None or language not in extract.GRAMMARS:
        return None
    text = re.sub(r"\r\n?", "\n", text)
    target = located(text, line, language)
    if target is None:
        return None
    raw, every = text.split("\n"), ranges(text, language)
    around = [r for r in every if r.kind == "class" and r.start <= target.start and target.end <= r.end and r != target]
    holder = around[-1] if around else target if target.kind == "class" else None
    inside = [r for r in every if holder and holder.start < r.start <= holder.end and r != target]
    lines = extract.scan(text, language)
    body = range(holder.start + 1, holder.end) if holder else range(0)
    covered = {i for r in inside + [target] if r != holder for i in range(r.start, r.end + 1)}
    depth, direct = 0, set()  # lines directly in the holder's block
    for i in range(holder.start, holder.end) if holder else ():
        if depth == 1 or language == "Python":
            direct.add(i)
        depth += lines.code[i].count("{") - lines.code[i].count("}")
    plain = [i for i in body if i in direct and i not in covered and lines.code[i]]
    fields = [raw[i].strip() for i in plain if lines.code[i][-1] in (";", ",") and "(" not in lines.code[i]]
    makers = [raw[i].strip() for i in plain if holder and re.search(rf"\b(?:{re.escape(holder.name)}|constructor|__init__)\s*\(", raw[i])]
    makers += [raw[r.start].strip() for r in inside if r.name == "__init__"]
    marks = range(holder.start, holder.end + 1) if holder else range(target.start, target.end + 1)
    spaces = [m[1] for m in map(_space.match, raw) if m]
    return {
        "name": target.name,
        "holder": holder.name if holder else None,
        "space": spaces[0] if spaces else None,
        "imports": [x.strip() for x in raw if _imports.match(x)],
        "fields": fields,
        "constructor": makers[0] if makers else None,
        "members": [raw[r.start].strip() for r in inside if r.name != "__init__"][:MEMBERS],
        "constraints": [m[1] for i in marks if (m := _constraint.search(raw[i]))],
        "source": "\n".join(raw[target.start : target.end + 1]),
        "status": "unimplemented" if _unfinished.search("\n".join(raw[target.start : target.end + 1])) else "implemented",
    }


_NODE = StructType([StructField("kind", StringType()), StructField("name", StringType()), StructField("line", IntegerType()), StructField("parent", StringType()), StructField("depth", IntegerType()), StructField("status", StringType())])


def nodes(text: str | None, language: str | None) -> list[dict]:
    """The declarations of a file as nodes of its tree: the type around each, how deep it is, whether it is a stub."""
    if not text or language not in extract.GRAMMARS:
        return []
    raw, out, open_types = re.sub(r"\r\n?", "\n", text).split("\n"), [], []
    for r in ranges(text, language):
        open_types = [t for t in open_types if r.end <= t.end]
        body = "\n".join(raw[r.start : r.end + 1])
        stub = r.kind == "function" and bool(_unfinished.search(body))
        out.append({"kind": r.kind, "name": r.name, "line": r.start + 1, "parent": open_types[-1].name if open_types else None, "depth": len(open_types), "status": "unimplemented" if stub else "implemented"})
        if r.kind == "class":
            open_types.append(r)
    return out


@F.pandas_udf(ArrayType(_NODE))
def module_nodes(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([nodes(t, x) for t, x in zip(text, language)])


_LISTS = ("imports", "fields", "members", "constraints")
CONTEXT = StructType([StructField(c, ArrayType(StringType()) if c in _LISTS else StringType()) for c in ("name", "holder", "space", "imports", "fields", "constructor", "members", "constraints", "source", "status")])


@F.pandas_udf(CONTEXT)
def collect(text: pd.Series, line: pd.Series, language: pd.Series) -> pd.DataFrame:
    rows = [context(t, None if pd.isna(n) else int(n), x) or dict.fromkeys(CONTEXT.names) for t, n, x in zip(text, line, language)]
    return pd.DataFrame(rows, columns=CONTEXT.names)


def replacement(text: str, line: int, code: str, language: str, kind: str | None = None) -> list[dict]:
    """The hunk that replaces the declaration at a line by code, which takes over its indent; a line of context on either
    side. ValueError where no declaration of the kind is."""
    text = text.replace("\r\n", "\n")
    target = located(text, line, language, kind)
    if target is None:
        raise ValueError(f"line {line}: no {kind or 'declaration'}")
    raw = text.split("\n")
    indent = re.match(r"\s*", raw[target.start])[0]
    new = [indent + x if x.strip() else x for x in code.replace("\r\n", "\n").strip("\n").split("\n")]
    old = raw[target.start : target.end + 1]
    line_of = lambda kind, lines: [{"type": kind, "content": x} for x in lines]
    before, after = raw[max(target.start - 1, 0) : target.start], raw[target.end + 1 : target.end + 2]
    header = f"@@ -{target.start + 1},{len(old)} +{target.start + 1},{len(new)} @@"
    return [{"header": header, "lines": line_of("context", before) + line_of("remove", old) + line_of("add", new) + line_of("context", after)}]


_HUNKS = ArrayType(StructType([StructField("header", StringType()), StructField("lines", ArrayType(StructType([StructField("type", StringType()), StructField("content", StringType())])))]))
_PATCH = StructType([StructField("hunks", _HUNKS), StructField("added", IntegerType()), StructField("removed", IntegerType()), StructField("error", StringType())])


@F.pandas_udf(_PATCH)
def patch(text: pd.Series, line: pd.Series, code: pd.Series, language: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """(hunks, added, removed, error) for each row."""
    rows = []
    for t, n, c, x, k in zip(text, line, code, language, kind):
        try:
            if t is None or c is None or pd.isna(n) or x not in extract.GRAMMARS:
                raise ValueError("nothing to patch")
            hunks = replacement(t, int(n), c, x, k)
            count = lambda kind: sum(y["type"] == kind for y in hunks[0]["lines"])  # noqa: B023, E731
            rows.append((hunks, count("add"), count("remove"), None))
        except ValueError as e:
            rows.append((None, None, None, str(e)))
    return pd.DataFrame({"hunks": [r[0] for r in rows], "added": pd.array([r[1] for r in rows], "Int32"), "removed": pd.array([r[2] for r in rows], "Int32"), "error": [r[3] for r in rows]})


# What an editor's selection names: fixed values of editors' language ids.
EDITOR_LANGUAGES = {"typescript": "TypeScript", "typescriptreact": "TypeScript", "python": "Python", "java": "Java", "csharp": "C#", "rust": "Rust", "go": "Go"}


def selection(text: str, line: int, editor_language: str) -> Range | None:
    """The declaration that a selection at a line means: the one that begins there, else the innermost around it."""
    language = EDITOR_LANGUAGES.get(editor_language)
    if language is None or not text:
        return None
    around = [r for r in ranges(text, language) if r.start <= line - 1 <= r.end]
    return located(text, line, language) or (max(around, key=lambda r: r.start) if around else None)
