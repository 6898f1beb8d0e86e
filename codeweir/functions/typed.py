"""Self-describing values: checks, readings of raw JSON, normal forms and a side's results, as Arrow-batched functions.

A tagged value is ``{"type": ..., "value": ...}`` with the types string, number, boolean, null, list and map. Errors are
data here: every function gives them beside its result and never fails a task."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

DEEPEST, LONGEST = 12, 200
_FINITE = "a finite number"
_SPECIAL = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def _is_number(x: object) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


_SCALARS: dict[str, tuple[Callable[[object], bool], str]] = {
    "string": (lambda x: isinstance(x, str), "a string"),
    "number": (lambda x: _is_number(x) and math.isfinite(x), _FINITE),
    "boolean": (lambda x: isinstance(x, bool), "a boolean"),
    "null": (lambda x: x is None, "null"),
}


def typed_issues(value: object, path: str = "value", special: bool = False) -> list[str]:
    """What is wrong with a tagged value, with its path; ``special`` allows NaN and the infinities as strings."""
    if not isinstance(value, dict):
        return [f"{path}: no tagged value"]
    kind, inner = value.get("type"), value.get("value")
    if kind in _SCALARS:
        fine, name = _SCALARS[kind]
        return [] if fine(inner) or (special and kind == "number" and (_is_number(inner) or inner in _SPECIAL)) else [f"{path}: not {name}"]
    if kind == "list":
        if not isinstance(inner, list):
            return [f"{path}: not a list"]
        return [x for i, item in enumerate(inner) for x in typed_issues(item, f"{path}[{i}]", special)]
    if kind == "map":
        if not isinstance(inner, dict):
            return [f"{path}: not a map"]
        return [x for k, item in inner.items() for x in ([f"{path}: empty key"] if not k and not special else typed_issues(item, f"{path}.{k}", special))]
    return [f"{path}: unknown type"]


def tagged(value: object) -> dict:
    """Raw JSON as a tagged value; what is tagged already stays so, its parts are read in turn."""
    if isinstance(value, dict):
        if isinstance(value.get("type"), str) and "value" in value:
            inner = value["value"]
            if value["type"] == "list" and isinstance(inner, list):
                inner = [tagged(x) for x in inner]
            elif value["type"] == "map" and isinstance(inner, dict):
                inner = {k: tagged(x) for k, x in inner.items()}
            return {**value, "value": inner}
        return {"type": "map", "value": {k: tagged(x) for k, x in value.items()}}
    if isinstance(value, list):
        return {"type": "list", "value": [tagged(x) for x in value]}
    if value is None or isinstance(value, bool | str):
        return {"type": "null" if value is None else "boolean" if isinstance(value, bool) else "string", "value": value}
    return {"type": "number", "value": value} if math.isfinite(value) else {"type": "string", "value": str(value)}


def normal(value: object, deepest: int = DEEPEST, longest: int = LONGEST) -> dict:
    """A plain value as a tagged one of bounded size: too deep parts and the rest of long lists leave a note. A value that
    holds itself raises ValueError."""
    open_parts: set[int] = set()

    def read(x: object, depth: int) -> dict:
        if depth > deepest:
            return {"type": "string", "value": f"<truncated at depth {deepest}>"}
        if not isinstance(x, dict | list | tuple):
            if x is None or isinstance(x, bool | str) or _is_number(x):
                kind = "null" if x is None else "boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "number"
                return {"type": kind, "value": x}
            return {"type": "string", "value": str(x)}
        if id(x) in open_parts:
            raise ValueError("a cyclic value")
        open_parts.add(id(x))
        try:
            if isinstance(x, dict):
                return {"type": "map", "value": {str(k): read(v, depth + 1) for k, v in list(x.items())[:longest]}}
            items = [read(v, depth + 1) for v in x[:longest]]
            more = [{"type": "string", "value": f"<{len(x) - longest} more items truncated>"}] if len(x) > longest else []
            return {"type": "list", "value": items + more}
        finally:
            open_parts.discard(id(x))

    return read(value, 0)


def description_issues(value: object, version: str = "1.0", languages: tuple[str, ...] = ("Java", "C#")) -> list[str]:
    """What is wrong with the description of a differential test: target, constructor arguments and cases."""
    if not isinstance(value, dict):
        return ["no object"]
    out = [] if value.get("schemaVersion") == version else [f"schemaVersion: not {version}"]
    target = value.get("target")
    if not isinstance(target, dict):
        return [*out, "target: missing"]
    if target.get("language") not in languages:
        out.append("target.language: unknown")
    out += [f"target.{k}: empty" for k in ("className", "method") if not (isinstance(target.get(k), str) and target[k].strip())]
    if not isinstance(target.get("isStatic"), bool):
        out.append("target.isStatic: not a boolean")
    if target.get("entryKind", "method") not in ("method", "constructor"):
        out.append("target.entryKind: unknown")
    given = target.get("constructorArgs")
    out += [x for i, a in enumerate(given) for x in typed_issues(a, f"target.constructorArgs[{i}]")] if isinstance(given, list) else ["target.constructorArgs: not a list"]
    cases = value.get("cases")
    if not isinstance(cases, list) or not cases:
        return [*out, "cases: none"]
    return out + [x for i, c in enumerate(cases) for x in _case_issues(c, f"cases[{i}]")]


def _case_issues(case: object, path: str) -> list[str]:
    if not isinstance(case, dict):
        return [f"{path}: no object"]
    out = [] if isinstance(case.get("id"), str) and case["id"].strip() else [f"{path}.id: empty"]
    if not isinstance(case.get("description", ""), str):
        out.append(f"{path}.description: not a string")
    inputs, wanted = case.get("inputs"), case.get("expected")
    out += [x for i, v in enumerate(inputs) for x in typed_issues(v, f"{path}.inputs[{i}]")] if isinstance(inputs, list) else [f"{path}.inputs: not a list"]
    if not isinstance(wanted, dict) or wanted.get("kind") not in ("return", "exception"):
        return [*out, f"{path}.expected.kind: unknown"]
    if wanted["kind"] == "return":
        return out + typed_issues(wanted.get("value"), f"{path}.expected.value")
    if not (isinstance(wanted.get("type"), str) and wanted["type"].strip()):
        out.append(f"{path}.expected.type: empty")
    if not isinstance(wanted.get("messageContains", ""), str):
        out.append(f"{path}.expected.messageContains: not a string")
    return out


def side_results(text: str | None) -> tuple[list[dict], list[str]]:
    """(results, issues) of a side's output: a bad row is an issue of its own and leaves the others; extra keys are fine."""
    try:
        raw = json.loads(text)
    except (TypeError, ValueError):
        return [], ["no JSON"]
    rows = raw.get("results") if isinstance(raw, dict) else None
    if not isinstance(rows, list):
        return [], ["no list of results"]
    results, issues = [], []
    for i, r in enumerate(rows):
        case = r.get("caseId") if isinstance(r, dict) else None
        if not isinstance(case, str) or not case.strip():
            issues.append(f"results[{i}]: no case")
        elif r.get("outcome") == "return":
            wrong = typed_issues(r.get("returnValue"), f"{case}.returnValue", special=True)
            issues += wrong
            if not wrong:
                results.append({"case_id": case, "outcome": "return", "value": json.dumps(r["returnValue"], sort_keys=True, separators=(",", ":"), ensure_ascii=False), "exception": None, "message": None})
        elif r.get("outcome") == "exception":
            name, message = r.get("exceptionType"), r.get("exceptionMessage")
            if isinstance(name, str) and name.strip():
                results.append({"case_id": case, "outcome": "exception", "value": None, "exception": name, "message": message if isinstance(message, str) else ""})
            else:
                issues.append(f"{case}: no exception type")
        else:
            issues.append(f"{case}: unknown outcome")
    return results, issues


_RESULT = StructType([StructField(c, StringType()) for c in ("case_id", "outcome", "value", "exception", "message")])


@F.pandas_udf(StructType([StructField("results", ArrayType(_RESULT)), StructField("issues", ArrayType(StringType()))]))
def parse_side(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([side_results(x) for x in s], columns=["results", "issues"])


def _of_json(check: Callable[[object], list[str]]):
    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str]:
            try:
                return check(json.loads(x))
            except (TypeError, ValueError):
                return ["no JSON"]

        return s.map(one)

    return run


check_typed, check_description = _of_json(typed_issues), _of_json(description_issues)


@F.pandas_udf(StringType())
def tag_json(s: pd.Series) -> pd.Series:
    """The canonical JSON of raw JSON's tagged value; null where it is no JSON."""

    def one(x: str | None) -> str | None:
        try:
            return json.dumps(tagged(json.loads(x)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return s.map(one)


# The closed lists of an analysis report.
LEVELS = ("direct", "adapt", "reference", "reject")
COVERED = ("covered", "partial", "missing", "conflict")
ACTIONS = ("preserve", "rename", "convert", "inject", "replace", "adapt", "map", "delegate", "wrap")
PLANS = ("reuse-existing", "adapt", "inline", "unresolved")


def _filled(x: object) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _strings(x: object, some: bool = False) -> bool:
    return isinstance(x, list) and all(isinstance(i, str) for i in x) and (not some or (bool(x) and all(map(_filled, x))))


def report_issues(value: object, version: str = "1.0") -> list[str]:
    """What is wrong with an analysis report: closed lists, empty texts, missing evidence, a confidence outside [0, 1]."""
    if not isinstance(value, dict):
        return ["no object"]
    out = [] if value.get("schemaVersion") == version else [f"schemaVersion: not {version}"]
    fit = value.get("applicability")
    if not isinstance(fit, dict):
        out.append("applicability: missing")
    else:
        sure = fit.get("confidence")
        checks = (("level", fit.get("level") in LEVELS), ("confidence", _is_number(sure) and 0 <= sure <= 1), ("reasons", _strings(fit.get("reasons"), True)))
        out += [f"applicability.{k}: invalid" for k, fine in checks if not fine]
    tables = {
        "behaviorMapping": lambda r: {
            "requirement": _filled(r.get("requirement")), "status": r.get("status") in COVERED, "targetAction": _filled(r.get("targetAction")),
            "candidateEvidence": _strings(r.get("candidateEvidence")) and (bool(r["candidateEvidence"]) or r.get("status") == "missing"),
        },
        "contractMapping": lambda r: {**{k: _filled(r.get(k)) for k in ("source", "target", "note")}, "action": r.get("action") in ACTIONS},
        "dependencyPlan": lambda r: {
            "sourceDependency": _filled(r.get("sourceDependency")), "action": r.get("action") in PLANS, "targetDependency": "targetDependency" not in r or _filled(r["targetDependency"]),
        },
    }
    for name, checks in tables.items():
        rows = value.get(name)
        if not isinstance(rows, list):
            out.append(f"{name}: not a list")
            continue
        out += [f"{name}[{i}].{k}: invalid" for i, r in enumerate(rows) for k, fine in (checks(r) if isinstance(r, dict) else {"": False}).items() if not fine]
    out += [f"{k}: invalid" for k in ("implementationPlan",) if not _strings(value.get(k), True)]
    return out + [f"{k}: invalid" for k in ("risks", "assumptions", "unresolved") if not _strings(value.get(k))]


def object_answer(text: str | None) -> dict | None:
    """The JSON object in a model's answer: the whole, a fenced block, or from the first brace to the last."""
    text = (text or "").strip()
    tries = [text]
    if text.count("```") >= 2:
        tries.append(text.split("```")[1].removeprefix("json"))
    if 0 <= text.find("{") < text.rfind("}"):
        tries.append(text[text.find("{") : text.rfind("}") + 1])
    for t in tries:
        try:
            value = json.loads(t)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


@F.pandas_udf(ArrayType(StringType()))
def check_report(s: pd.Series) -> pd.Series:
    """Issues of the analysis report in a model's answer; none means valid."""

    def one(x: str | None) -> list[str]:
        value = object_answer(x)
        return ["no JSON object"] if value is None else report_issues(value)

    return s.map(one)
