"""The licence that applies to each source file and repository.

Every statement (a licence field, a line of a header or licence file, and its whole text) is normalised: copyright lines
go, case, punctuation and the spellings of names, versions and clause counts are made one. Its word runs are hashed and
equi-joined with the hashes of licence templates; of overlapping hits the longest counts. Templates are the names of the
catalogue in all their forms, further names of well-known licences, and the sentences by which licence texts open. Only
runs that begin with a template's first word and have a template's length are hashed. Distinct statements are matched
once, however many files carry them. Licence files are inherited from the nearest folder that has any.

A name of one word (MIT, ISC, Unlicense) counts only between words that a statement of a licence has there; a name that
is denied ("not", "formerly", "instead of" shortly before it) does not count, the rest of its statement does.

Defined cases: null, blank and unrecognised statements name nothing; a source may name several licences (a choice);
no source naming any gives ``unknown``, disjoint sources give ``conflict``, else ``ok``; repeated rows count once;
a file missing from the file table has no header; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LICENCE_FILE = r"(?i)^(LICENSE|LICENCE|COPYING)"
#: Family names by licence, and the version or clause count that must follow or precede; fixed values.
FAMILIES = {
    "MIT": (["mit", "expat"], ""),
    "ISC": (["isc"], ""),
    "Apache-2.0": (["apache", "asl", "apache software", "apache public"], "2"),
    "MPL-2.0": (["mpl", "mozilla public", "mozilla"], "2"),
    "GPL-2.0": (["gpl", "gnu gpl", "general public", "gnu general public"], "2"),
    "GPL-3.0": (["gpl", "gnu gpl", "general public", "gnu general public"], "3"),
    "LGPL-2.1": (["lgpl", "gnu lgpl", "lesser general public", "gnu lesser general public"], "2.1"),
    "AGPL-3.0": (["agpl", "gnu agpl", "affero general public", "gnu affero general public"], "3"),
    "BSD-2-Clause": (["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd", "bsd simplified"], ""),
    "BSD-3-Clause": (["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd", "bsd new"], ""),
}
#: Sentences of licence texts that no other licence has; fixed values.
TEXTS = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-3-Clause": ["may be used to endorse or promote products derived from this software without specific prior written permission"],
    "GPL-2.0": ["GNU General Public License as published by the Free Software Foundation; either version 2"],
    "GPL-3.0": ["GNU General Public License as published by the Free Software Foundation, either version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"],
    "AGPL-3.0": ["GNU Affero General Public License as published by the Free Software Foundation, either version 3"],
}
#: A text that holds the sentence of the second licence is that licence's, though it holds the first one's too.
WIDER = {"BSD-2-Clause": "BSD-3-Clause"}
# Words that may stand before and after a name of one word, and words that deny the name they precede.
BEFORE = frozenset("the a an and or under by of to in as either both dual triple follow license licensed licence identifier spdx use uses type name".split())
AFTER = frozenset("license licensed licence or and not but as at see whichever with for which that code text file terms style in from if when".split())
DENIED = frozenset("not no never neither nor formerly previously without except instead rather former".split())


def canonical(c: Column) -> Column:
    """One spelling for names, versions and clause counts; words separated by single blanks."""
    steps = [
        (r"[^\p{L}\p{N}.+]+", " "),
        (r"\blicen[cs]e([sd]?)\b", "license$1"),
        (r"\blicenses\b", "license"),
        (r"\b(a?l?gpl|mpl|apache|asl|bsd)\s*v?\.?\s*(\d)", "$1 $2"),
        (r"\bv(?:er(?:sion)?)?\.?\s*(\d)", "$1"),
        (r"\btwo(?= clause)", "2"),
        (r"\bthree(?= clause)", "3"),
        (r"(\d)\.0\b", "$1"),
        (r"\+|\bor (?:any )?(?:later|newer)(?: version)?\b|\bonly\b|\bthe\b", " "),
        (r"(?<!\d)\.|\.(?!\d)", " "),
        (r"\s+", " "),
    ]
    c = F.lower(c)
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return F.trim(c)


def _forms(name: Column) -> Column:
    """The forms of a normalised name: with and without the word license, before and after the version."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"\blicense\b", ""), r"\s+", " "))
    family, version = F.regexp_extract(bare, r"^(.*?)((?: \d[\d.]*)?)$", 1), F.trim(F.regexp_extract(bare, r"^(.*?)((?: \d[\d.]*)?)$", 2))
    spelled = [F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in parts]) for parts in ((family, version), (family, F.lit("license"), version), (family, version, F.lit("license")))]
    return F.array_distinct(F.filter(F.array(name, *spelled), lambda f: (f != "") & (f != "license")))


def templates(catalog: DataFrame) -> DataFrame:
    """(license_id, h, words, first, text): a row for each form of each licence of the catalogue; text marks sentences."""
    spark = catalog.sparkSession
    rows = [(licence, f"{name} {version}".strip(), False) for licence, (names, version) in FAMILIES.items() for name in names]
    rows += [(licence, text, True) for licence, texts in TEXTS.items() for text in texts]
    own = spark.createDataFrame(rows, "license_id string, form string, text boolean").join(catalog.select("license_id").distinct(), "license_id")
    named = catalog.select("license_id", F.explode(F.array("license_id", "full_name")).alias("form"), F.lit(False).alias("text")).where("form is not null")
    forms = own.unionByName(named).withColumn("form", canonical(F.col("form")))
    forms = forms.select("license_id", "text", F.explode(F.when(F.col("text"), F.array("form")).otherwise(_forms(F.col("form")))).alias("form")).distinct()
    words = F.split("form", " ")
    return forms.select("license_id", F.xxhash64("form").alias("h"), F.size(words).alias("words"), words[0].alias("first"), "text")


def named_licences(statements: DataFrame, catalog: DataFrame) -> DataFrame:
    """statements(text) -> (text, licences): the set of licences each distinct statement names; none where it names none."""
    t = templates(catalog)
    # a row for each first word and length of a template: bounded by the catalogue, whatever the statements
    shapes = t.groupBy("first").agg(F.collect_set("words").alias("sizes")).collect()
    none = statements.select("text", F.array().cast("array<string>").alias("licences")).limit(0)
    if not shapes:
        return none
    sizes = F.create_map(*[x for r in shapes for x in (F.lit(r["first"]), F.array(*map(F.lit, sorted(r["sizes"]))))])
    s = statements.where("text is not null").select("text").distinct()
    s = s.select("text", F.split(canonical(F.col("text")), " ").alias("w"))
    places = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.map_contains_key(sizes, F.element_at("w", i)))
    fitting = lambda i: F.filter(F.element_at(sizes, F.element_at("w", i)), lambda n: i + n - 1 <= F.size("w"))
    runs = F.flatten(F.transform(places, lambda i: F.transform(fitting(i), lambda n: F.struct(i.alias("at"), n.alias("n"), F.xxhash64(F.array_join(F.slice("w", i, n), " ")).alias("h")))))
    among = lambda words, known: F.arrays_overlap(words, F.array(*map(F.lit, sorted(known))))
    at, n = F.col("at"), F.col("n")
    before, after = F.slice("w", F.greatest(at - 1, F.lit(1)), F.when(at > 1, 1).otherwise(0)), F.slice("w", at + n, F.lit(1))
    fits_after = (F.size(after) == 0) | among(after, AFTER) | F.coalesce(F.try_element_at(after, F.lit(1)).rlike(r"^\d"), F.lit(False))
    odd = (n == 1) & ~(((F.size(before) == 0) | among(before, BEFORE)) & fits_after)
    denied = among(F.slice("w", F.greatest(at - 3, F.lit(1)), F.least(at - 1, F.lit(3))), DENIED)
    grams = s.select("text", "w", F.explode(runs).alias("g")).select("text", "w", "g.*").select("text", "at", "n", "h", odd.alias("odd"), denied.alias("denied"))
    hits = grams.join(t.select("h", F.col("words").alias("n"), "license_id", F.col("text").alias("sentence")), ["h", "n"]).where(~F.col("denied"))
    # names of one word next to another name, as in "MIT OR ISC", stand between words of the list; so do versions
    found = hits.groupBy("text").agg(F.collect_set(F.struct("at", "n", "license_id", "sentence", "odd")).alias("all"))
    inside = lambda a, b: (b["n"] > a["n"]) & (b["at"] <= a["at"]) & (b["at"] + b["n"] >= a["at"] + a["n"])
    touches = lambda a, b: (b["at"] + b["n"] == a["at"]) | (a["at"] + a["n"] == b["at"])
    kept = F.filter("all", lambda a: ~F.exists("all", lambda b: inside(a, b)))
    kept = F.filter(kept, lambda a: ~a["odd"] | F.exists("all", lambda b: touches(a, b)))
    holds = lambda licence: F.exists("kept", lambda b: b["sentence"] & (b["license_id"] == licence))
    kept = found.select("text", kept.alias("kept"))
    for one, other in WIDER.items():
        less = F.filter("kept", lambda a: ~(a["sentence"] & (a["license_id"] == one)))
        kept = kept.withColumn("kept", F.when(holds(other), less).otherwise(F.col("kept")))
    return kept.select("text", F.array_sort(F.array_distinct(F.transform("kept", lambda m: m["license_id"]))).alias("licences")).where(F.size("licences") > 0)


_opening = re.compile(r"\s*(?:(//[^\n]*)|(\#[^\n]*)|(/\*.*?(?:\*/|\Z))|([rbuRBU]?(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))))", re.S)


def opening_comment(text: str | None, path: str | None) -> list[str]:
    """The lines of the comment or docstring before anything else in a file, without comment marks."""
    if not text:
        return []
    python, at, parts = (path or "").endswith((".py", ".pyi")), 0, []
    text = text.removeprefix("﻿")
    while m := _opening.match(text, at):
        if m[2] and not (python or (at == 0 and m[2].startswith("#!"))) or m[4] and not python:
            break
        parts.append(m[0])
        at = m.end()
    lines = "\n".join(parts).splitlines()
    return [x for x in (re.sub(r"^[\s/*#!\"']+|[\s*/\"']+$", "", line) for line in lines) if x]


def _statements(lines: list[str]) -> list[str]:
    """The lines, each two neighbours, as a name may be wrapped, and the whole, for the sentences of a text."""
    kept = [x for x in lines if not re.match(r"(?i)\s*(copyright\b|\(c\)|©|rights holder)", x)]
    return list(dict.fromkeys([*kept, *(f"{a} {b}" for a, b in zip(kept, kept[1:])), " ".join(kept)]))


def header_statements(files: DataFrame) -> DataFrame:
    """source files -> (repository, path, text), a row for each statement of the opening comment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, p, s) for r, p, t in zip(b["repository"], b["path"], b["file_text"]) for s in _statements(opening_comment(t, p))]
            yield pd.DataFrame(rows, columns=["repository", "path", "text"])

    return files.select("repository", "path", "file_text").mapInPandas(run, "repository string, path string, text string")


def _named(statements: DataFrame, keys: list[str], catalog: DataFrame) -> DataFrame:
    """(keys, licences): what the statements of each key name together."""
    names = named_licences(statements, catalog)
    return statements.join(names, "text").groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("licences")))).alias("licences"))


def _verdict(df: DataFrame, sources: list[str]) -> DataFrame:
    sets = F.filter(F.array(*sources), lambda s: s.isNotNull() & (F.size(s) > 0))
    common = F.aggregate(F.slice("_sets", 2, len(sources)), F.element_at("_sets", 1), lambda a, b: F.array_intersect(a, b))
    df = df.withColumn("_sets", sets).withColumn("licences", F.when(F.size("_sets") > 0, common).otherwise(F.array().cast("array<string>")))
    finding = F.when(F.size("_sets") == 0, "unknown").when(F.size("licences") == 0, "conflict").otherwise("ok")
    return df.select("repository", "path", "licences", finding.alias("finding"))


def license_findings(symbols: DataFrame, files: DataFrame, manifests: DataFrame, license_files: DataFrame, catalog: DataFrame, prefix: str = "fixture/") -> DataFrame:
    """(repository, path, licences, finding) for every file of the symbols and every repository (path '')."""
    rows = symbols.select("repository", "path", F.col("license").alias("text")).where("repository is not null and path is not null").distinct()
    declared = _named(rows.where("text is not null"), ["repository", "path"], catalog).withColumnRenamed("licences", "by_field")
    header = _named(header_statements(files), ["repository", "path"], catalog).withColumnRenamed("licences", "by_header")

    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    texts = license_files.where(name.rlike(LICENCE_FILE)).select(F.concat(F.lit(prefix), "repository").alias("repository"), folder.alias("folder"), "path", "file_text")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(r, f, s) for r, f, t in zip(b["repository"], b["folder"], b["file_text"]) for s in _statements([x.strip() for x in (t or "").splitlines() if x.strip()])]
            yield pd.DataFrame(out, columns=["repository", "folder", "text"])

    said = texts.select("repository", "folder", "file_text").mapInPandas(lines, "repository string, folder string, text string")
    by_folder = texts.select("repository", "folder").distinct().join(_named(said, ["repository", "folder"], catalog), ["repository", "folder"], "left")

    paths = rows.select("repository", "path").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.when(n == 0, "").otherwise(F.array_join(F.slice(parts, 1, n), "/")).alias("folder")))
    climbed = paths.select("repository", "path", F.explode(above).alias("a")).select("repository", "path", "a.depth", "a.folder")
    nearest = climbed.join(by_folder, ["repository", "folder"]).groupBy("repository", "path").agg(F.max_by(F.coalesce("licences", F.array().cast("array<string>")), "depth").alias("by_folder"))
    of_files = _verdict(
        paths.join(declared, ["repository", "path"], "left").join(header, ["repository", "path"], "left").join(nearest, ["repository", "path"], "left"),
        ["by_field", "by_header", "by_folder"],
    )

    repos = manifests.select(F.concat(F.lit(prefix), "repository").alias("repository"), F.col("license").alias("text")).where("repository is not null")
    own = _named(repos.where("text is not null"), ["repository"], catalog).withColumnRenamed("licences", "by_field")
    root = by_folder.where("folder = ''").select("repository", F.col("licences").alias("by_folder"))
    of_repos = _verdict(
        repos.select("repository").distinct().withColumn("path", F.lit("")).join(own, "repository", "left").join(root, "repository", "left"),
        ["by_field", "by_folder"],
    )
    return of_files.unionByName(of_repos)


