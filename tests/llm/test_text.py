"""The operators on texts, against plain versions and on the cases their docstrings define."""

import random

import pytest
from pyspark.sql import functions as F

from codeweir.llm import bpe, docpairs, lexers, licenses, packing, prose, residue, split

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    return bpe.parse_vocabulary(bpe.read_vocabulary(bpe.default_vocabulary()))


TEXTS = [None, "", " ", "a", "don't we'll I'VE\t\tx  \n\n y", "Prüfsumme ½Ⅳ \x1c\x85 一二三 𝛴🛰", "ab" * 3000, "=" * 500 + " x", "日本語のテキスト。" * 50, "int f(int a) { return a*2; } // ok\r\n"]


def test_encoding_equals_the_library(ranks):
    import tiktoken

    own, lib = bpe.Encoder(ranks), tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab'sé 1\n\t½日.") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in texts:
        want = lib.encode_ordinary(t) if t else []
        assert own.encode(t) == want and own.count(t) == len(want)
        if t:
            assert bpe.Decoder(ranks).decode(want) == t
            for size, most in ((3, 5), (7, 11), (50, 20)):
                words, part = [], ""
                for piece, ends in bpe.pretokens((t[i : i + size] for i in range(0, len(t), size)), most):
                    part += piece
                    if ends:
                        words.append(part)
                        part = ""
                assert words == bpe._split(t) and not part


def test_lookahead_holds_for_any_merge_list():
    rng = random.Random(1)
    for _ in range(150):
        own = {bytes([c]): i for i, c in enumerate(b"abc")}
        for _ in range(rng.randint(2, 25)):
            token = rng.choice(list(own)) + rng.choice(list(own))
            if token not in own and len(token) < 9:
                own[token] = len(own)
        ahead = bpe.lookahead(own)
        for _ in range(40):
            x, y = (bytes(rng.choices(b"abc", k=rng.randint(1, n))) for n in (60, 25))
            alone, more = bpe.merge_bytes(own, x), bpe.merge_bytes(own, x + y)
            assert bpe.merge_long(own, x) == alone
            end = 0
            for a, b in zip(alone, more):
                end += len(a)
                assert end > len(x) - ahead or a == b
                if a != b:
                    break
        text = bytes(rng.choices(b"abc", k=3000))
        machine = bpe.Transducer(own, ahead)
        assert list(machine.run(text[i : i + 7] for i in range(0, 3000, 7))) == [own[t] for t in bpe.merge_long(own, text)]


def test_transducer_emits_before_the_end_in_little_memory(ranks):
    import tracemalloc

    own, read = bpe.Encoder(ranks), 0

    def blocks(n):
        nonlocal read
        for _ in range(n):
            read += 1
            yield "ledgerquotasilo" * 2000

    next(own.stream(blocks(100)))
    assert read < 10
    peaks = []
    for n in (4, 16):
        tracemalloc.start()
        assert sum(1 for _ in own.stream(blocks(n))) > 0
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + 200_000


def test_encode_corpus_keeps_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "y")], "doc_id long, text string, ids string")
    got = bpe.encode_corpus(df).collect()
    assert len(got) == len(TEXTS) + 1 and all(r["ids"] == [] for r in got if r["doc_id"] in (0, 1))
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_plan_is_exact_and_tight():
    rng = random.Random(1)
    sizes = [min(2048, int(rng.lognormvariate(5.3, 1))) for _ in range(5000)]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    rows, containers = packing.plan(histogram, 2048)
    fill, given = {}, {}
    for s, a, b, first in rows:
        given.setdefault(s, []).append((a, b))
        for c in range(first, first + b - a):
            fill[c] = fill.get(c, 0) + s
    assert max(fill.values()) <= 2048 and len(fill) == containers <= -(-sum(sizes) // 2048) * 1.02 + 1
    for s, n in histogram.items():
        if s:
            spans = sorted(given[s])
            assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_pack(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([None, 0, 1, 5000, 2048, 2049, 700, 700, 700])], "doc_id long, n_tokens long")
    rows = packing.pack(df).collect()
    fill = {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["n"]
    assert max(fill.values()) <= 2048 and {r["doc_id"] for r in rows} == set(range(9))
    assert sorted((r["start"], r["n"]) for r in rows if r["doc_id"] == 3) == [(0, 2048), (2048, 2048), (4096, 904)]
    assert packing.pack(df.limit(0)).count() == 0 and packing.pack(df.where("n_tokens = 0")).count() == 1


def test_pieces_cover_overlap_and_break():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("ab \n.。") if rng.random() < 0.5 else "x" for _ in range(rng.randint(1, 300)))
        limit = rng.randint(2, 40)
        overlap = rng.randint(0, limit - 1)
        for t, spans in zip([text, "y" * 100], split.cuts([text, "y" * 100], limit, overlap)):
            assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(0 < e - s <= limit for s, e in spans)
            assert all(c <= b and overlap // 2 <= b - c <= overlap and d > b for (_, b), (c, d) in zip(spans, spans[1:]))
    lines = "".join(f"line {i}\n" for i in range(2000))
    assert all(lines[e - 1] == "\n" for s, e in split.cuts([lines], 600, 50)[0])


def test_split_only_long_texts(spark):
    df = spark.createDataFrame([("a", "x" * 30, None), ("a", "x" * 30, None), ("b", "y" * 10, "z z " * 20), (None, None, "")], "id string, content string, text string")
    got = split.split_oversized(df, "id", ("content", "text"), limit=10, overlap=2)
    assert {(r["id"], r["field"]) for r in got.collect()} == {("a", "content"), ("b", "text")}
    assert got.where("id = 'a'").agg(F.max(F.length("text"))).first()[0] == 10 and got.where("id = 'a' and piece = 0").count() == 1


CATALOG = [(k, k) for k in licenses.FAMILIES]


MORE = [("Zlib", "zlib License"), ("EPL-2.0", "Eclipse Public License 2.0"), ("CC0-1.0", "Creative Commons Zero v1.0 Universal"), ("Unlicense", "The Unlicense"), ("X-1.0", None), (None, None)]
BSD2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"


def test_licence_names(spark):
    catalog = spark.createDataFrame(CATALOG + MORE, "license_id string, full_name string")
    cases = {
        "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
        "GPLv2+": ["GPL-2.0"],
        "GNU Lesser General Public License 2.1": ["LGPL-2.1"],
        "GNU Affero General Public License v3": ["AGPL-3.0"],
        "3-clause BSD": ["BSD-3-Clause"],
        "SPDX-License-Identifier: (MIT OR MPL-2.0)": ["MIT", "MPL-2.0"],
        "The MIT Licence": ["MIT"],
        "mit": ["MIT"],
        "Wir lesen mit dem Puffer": None,
        "Wir lesen mit dem Puffer License: Apache 2": ["Apache-2.0"],
        "You can redistribute this unit provided that you follow the mit.": ["MIT"],
        "Take it under mit or Apache2, whichever suits you.": ["Apache-2.0", "MIT"],
        "MIT, not GPL 3": ["MIT"],
        "licensed under the MIT License; the header may not be removed": ["MIT"],
        "formerly under the MIT License, now ISC License": ["ISC"],
        "MIT (see acme docs)": ["MIT"],
        "zlib License": ["Zlib"],
        "SPDX-License-Identifier: EPL-2.0": ["EPL-2.0"],
        "Eclipse Public License v2.0": ["EPL-2.0"],
        "Creative Commons Zero v1.0 Universal": ["CC0-1.0"],
        "The Unlicense": ["Unlicense"],
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the X)": ["MIT"],
        BSD2: ["BSD-2-Clause"],
        BSD2 + ": Neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": ["BSD-3-Clause"],
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version": ["LGPL-2.1"],
        "see LICENSE": None,
        "": None,
        "BSD": None,
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "text string")
    got = {r["text"]: r["licences"] for r in licenses.named_licences(df, catalog).collect()}
    assert {t: got.get(t) for t in cases} == cases


def test_license_findings(spark):
    catalog = spark.createDataFrame(CATALOG, "license_id string, full_name string")
    symbols = spark.createDataFrame(
        [("fixture/r", "a/x.py", "MIT"), ("fixture/r", "a/x.py", None), ("fixture/r", "b/y.go", "GPL 3"), ("fixture/r", "v/z.go", "unspecified"), ("fixture/q", "k.go", None)], "repository string, path string, license string"
    )
    files = spark.createDataFrame([("fixture/r", "a/x.py", "#!/usr/bin/env python3\n# Copyright 2020 GPL 2 Ltd\n# License: MIT\nimport os\n"), ("fixture/r", "b/y.go", "package x\n// License: MIT\n"), ("fixture/r", "b/y.go", None)], "repository string, path string, file_text string")
    manifests = spark.createDataFrame([("r", "MIT"), ("q", ""), ("q", None)], "repository string, license string")
    texts = spark.createDataFrame([("r", "LICENSE", "MIT License\n"), ("r", "v/COPYING", "Terms of use"), ("r", "NOTICE", "GPL 3"), ("r", "b/README.md", "ISC")], "repository string, path string, file_text string")
    got = {(r["repository"], r["path"]): r["finding"] for r in licenses.license_findings(symbols, files, manifests, texts, catalog).collect()}
    assert got == {("fixture/r", "a/x.py"): "ok", ("fixture/r", "b/y.go"): "conflict", ("fixture/r", "v/z.go"): "unknown", ("fixture/q", "k.go"): "unknown", ("fixture/r", ""): "ok", ("fixture/q", ""): "unknown"}
    empty = licenses.license_findings(symbols.limit(0), files.limit(0), manifests.limit(0), texts.limit(0), catalog)
    assert empty.count() == 0


def test_lexers_and_passages():
    code = 'x = 1  # "no string"\ns = "a # no comment"\nt = ("one " +\n  "two")\n'
    assert [k for k, _, _ in lexers.passages(code, lexers.LEXERS["python"])] == ["comment", "string", "string"]
    assert lexers.passages(code, lexers.LEXERS["python"])[2][2] == "one two"
    assert lexers.passages(r'f("こ\u{43d}\x41")', lexers.LEXERS["rust"])[0][2] == "こнA"
    assert lexers.spans("/* open", lexers.LEXERS["java"])[0].kind == "block" and lexers.spans("", lexers.LEXERS["go"]) == []


SENTENCES = {
    "en": "The cache is read once because a second pass would disturb the order of the values.",
    "de": "Der Puffer wird nur einmal gelesen, weil sonst die Werte doppelt gezählt würden.",
    "fr": "Le tampon est lu une seule fois parce que les valeurs seraient comptées deux fois.",
    "es": "El registro se lee una sola vez porque los valores se contarían dos veces en el total.",
    "pt": "O registo é lido uma única vez porque os valores seriam contados duas vezes no total.",
    "ru": "Буфер читается только один раз, потому что иначе значения учитываются дважды.",
    "ja": "値が二重に計算されないように、ここではバッファを一度だけ読み込みます。",
    "zh": "这里只读取一次缓冲区，否则数值会被重复计算。",
}


def test_hidden_prose(spark):
    docs = spark.createDataFrame([(i * 10 + k, t + " " + t, lang) for i in range(3) for k, (lang, t) in enumerate(SENTENCES.items())], "doc_id long, text string, lang string")
    model = prose.fit_languages(docs)
    rows = [(lang, "Java", "A.java", f"// {t}\nint x;", None) for lang, t in SENTENCES.items()]
    rows += [("accents", "Python", "a.py", 's = "Der Puffer wird nur einmal gelesen, weil sonst die Werte doppelt gezaehlt wuerden."', None), ("word", "Go", "a.go", "// see Приложение 4 in the old summit\n", None)]
    rows += [("null", "Go", "a.go", None, None), ("none", "Go", "a.go", "", ""), ("preview", "Go", "a.go", None, f"/* {SENTENCES['ru']}"), ("de", "Java", "A.java", rows[1][3], None)]
    df = spark.createDataFrame(rows, "id string, code_language string, path string, content string, preview string")
    got = prose.hidden_prose(df, model=model).collect()
    assert sorted((r["id"], r["lang"]) for r in got if r["lang"] != "en") == sorted([(k, k) for k in SENTENCES if k != "en"] + [("accents", "de"), ("preview", "ru")])
    assert all(0 < r["share"] <= 1 for r in got) and prose.hidden_prose(df.limit(0), model=model).count() == 0


def test_function_descriptions(spark):
    good = "The counter is kept apart because a second reader would otherwise disturb its order."
    rows = [
        ("r:a.java:1:run", "function", "Java", "a.java", "int run()", None, f"/** {good} */\n@Override\npublic int run() {{\n return 1; }}", None),
        ("r:a.java:9:bare", "function", "Java", "a.java", "int bare()", None, f"// {good}\nint x = 1;\nint bare() {{ }}", None),
        ("r:a.py:1:f", "function", "Python", "a.py", "def f(a):", None, f'def f(a):\n    """{good}"""\n    return a', None),
        ("r:a.py:9:t", "function", "Python", "a.py", "def t(a):", None, "# TODO: describe what this function really does with it all\ndef t(a):\n    pass", None),
        ("r:a.py:19:c", "function", "Python", "a.py", "def c(a):", None, '# raise ValueError("cannot render the glacier while it is expired")\ndef c(a):\n    pass', None),
        ("r:a.go:1:g", "function", "Go", "a.go", "func g()", good, None, "func g() {\n}"),
        ("r:a.go:2:h", "function", "Go", "a.go", "func h()", f"Function h: {good}", None, "func h() {\n}"),
        ("r:a.ts:1:K", "class", "TypeScript", "a.ts", "class K {", None, f"// {good}\nclass K {{\n  // {good}\n  one(a: string): number {{\n  }}\n\n  two() {{\n  }}\n}}", None),
        ("r:n:1:n", "function", "Go", "a.go", None, None, None, None),
    ]
    df = spark.createDataFrame(rows + rows[:1], "id string, kind string, code_language string, path string, signature string, summary string, content string, preview string")
    got = sorted((r["id"], r["name"]) for r in docpairs.pair(df).collect())
    assert got == [("r:a.go:1:g", "g"), ("r:a.java:1:run", "run"), ("r:a.py:1:f", "f"), ("r:a.ts:1:K", "one")]
    both = f"class K {{\n  /** {good} */\n  int add(int a) {{ }}\n  /** {good} */\n  int add(long a) {{ }}\n  int add() {{ }}\n}}"
    overloads = df.limit(0).unionByName(spark.createDataFrame([("r:k.java:1:K", "class", "Java", "k.java", "class K {", None, both, None)] * 2, df.schema))
    assert sorted((r["name"], "long" in r["declaration"]) for r in docpairs.pair(overloads).collect()) == [("add", False), ("add", True)]


@pytest.mark.parametrize(
    "language, whole",
    [
        ("java", "void run(" + ", ".join(f"Map<String, Integer> value{i}" for i in range(200)) + ") throws IOException {"),
        ("c#", "public int Run(" + ", ".join(f"int value{i}" for i in range(300)) + ") {"),
        ("typescript", "function run({ first, second }: { first: string }, " + ", ".join(f"value{i}: {{ a: number }}" for i in range(200)) + "): Promise<{ last: string }> {"),
        ("typescript", "export function run<T extends { first: string }>(a: T): { last: T } {"),
        ("go", "func (s *Store) Run(first interface{}, " + ", ".join(f"value{i} struct{{ a int }}" for i in range(200)) + ") (last map[string]interface{}, err error) {"),
        ("rust", "pub fn run(" + ", ".join(f"value{i}: &[u8; 4]" for i in range(200)) + ") -> Vec<u8> where Last: Copy {"),
        ("python", "def run(a={}, " + ", ".join(f"value{i}: dict[str, int] = {{1: 2}}" for i in range(200)) + ") -> Last:"),
    ],
)
def test_declarations_are_whole(language, whole):
    body = "\n  bodyword " * 50
    for text in (f"{whole}{body}", f"x\n{whole}{body}\n{whole}{body}"):
        for d in docpairs.declarations(text, language):
            assert d.name in ("run", "Run") and d.head.strip() == whole.rstrip("{").strip()


def test_declarations_that_never_end():
    assert [d.head for d in docpairs.declarations("def f(a,\ndef g(b):\n  pass", "python")] == ["def f(a,\n", "def g(b):"]
    assert [d.head for d in docpairs.declarations("func f(a int) int\nfunc g() {", "go")] == ["func f(a int) int", "func g() "]
    assert [d.head for d in docpairs.declarations("void f(int a);\nint g() { }", "java")] == ["void f(int a)", "int g() "]
    assert len(docpairs.declarations("def f(\n" * 20000, "python")) == 20000


def test_a_word_late_in_a_declaration_is_told(spark):
    """What a description repeats of the end of a long declaration is no news, nor is a body's word told."""
    told = "The cobalt and the ember and the lagoon of it are used by the method."
    args = ", ".join(f"value{i}: int" for i in range(200))
    rows = [
        ("r:a.py:1:late", "function", f"# {told}\ndef late({args}, cobalt, ember, lagoon):\n    pass"),
        ("r:a.py:2:body", "function", f"# {told}\ndef body(a):\n    cobalt, ember, lagoon = a"),
        ("r:a.ts:1:wrapped", "function", f"// {told}\nexport const wrapped = memo(({{ {args.replace(': int', '')}, cobalt, ember, lagoon }}) => {{ return 1; }});"),
        ("r:a.ts:2:inner", "function", f"// {told}\nexport const inner = memo(({{ a }}) => {{ return cobalt + ember + lagoon; }});"),
    ]
    df = spark.createDataFrame([(i, k, {"py": "Python", "ts": "TypeScript"}[i[4:6]], i.split(":")[1], None, None, t, None) for i, k, t in rows], "id string, kind string, code_language string, path string, signature string, summary string, content string, preview string")
    assert sorted(r["name"] for r in docpairs.pair(df).collect()) == ["body", "inner"]


@pytest.mark.parametrize(
    "text, kinds",
    [
        (None, []),
        (" \n", []),
        ("Owner: {{ release_date }}", ["placeholder"]),
        ("Report for NaN: three of four cases passed.", ["placeholder"]),
        ("Report for [MODULE_NAME]: three of four cases passed.", ["placeholder"]),
        ("[GUIDE]: https://a.b/c", []),
        ("The generator replaces `{{crest}}` with the name.", []),
        ("The slot {fence} in the set notation means a single element.", []),
        ("```\n# {{ title }}\n```\nReal text follows here.", []),
        ("404 Not Found", ["error"]),
        ("When the registry answers with 404 Not Found, the client carries on.", []),
        ('We log "502 Bad Gateway" separately, as the retry hides it.', []),
        ("Real text.\n\nPlease enable JavaScript to see the report.", ["scripts"]),
        ("Users who block scripts still see the table, since enabling JavaScript only adds sorting.", []),
        ("请在浏览器中启用脚本后再查看本页内容。", ["scripts"]),
        ("Lorem ipsum dolor sit amet consectetur.", ["filler"]),
        ("xxxxx xxxx xxx xx xxxxx.", ["filler"]),
        ("ledgerquotasilo" * 50, []),
    ],
)
def test_residue(text, kinds):
    assert residue.evidence(text) == kinds


def test_residue_table(spark):
    df = spark.createDataFrame([(1, "Menu\nForbidden", "s", "k"), (2, None, None, "k"), (3, "Menu\nreal text", "s", "k"), (4, "", "s", "k"), (None, "{{ x }}", None, "k")], "doc_id long, text string, source string, kinds string")
    assert sorted((r["doc_id"] or 0, r["kinds"]) for r in residue.residue(df).collect()) == [(0, ["placeholder"]), (1, ["error"])]
    assert residue.residue(df.limit(0)).count() == 0


def test_boilerplate_is_subtracted(spark, monkeypatch):
    """A notice on every page of a host is no evidence against them; the same notice in one page of another is, and so is
    a page of nothing but its host's template."""
    notice = "Please enable JavaScript to see all 12 reports."
    rows = [(i, f"Report {chr(97 + i % 26) * (i + 1)} tells of other things each time.\n{notice}\nhttps://a.b/{i}", "a") for i in range(40)]
    rows += [(100 + i, f"Text {i} of another host", "b") for i in range(40)] + [(200, f"Some text.\n{notice}", "b"), (201, notice, "a"), (202, f"Owner: {{{{ name }}}}\n{notice}", "a")]
    rows += [(203, "Report 9 tells of other things each time.\nForbidden", "a"), (204, "Forbidden\n" + "many other words " * 9 + "\n" + "and some more words " * 9, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    flagged = lambda: {r["doc_id"]: r["kinds"] for r in residue.residue(df).collect()}
    assert flagged() == {200: ["scripts"], 201: ["scripts"], 202: ["placeholder"], 203: ["error"]}
    monkeypatch.setattr(residue, "SHARE", 2.0)  # nothing is boilerplate
    assert len(flagged()) == 44


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("test test test test test", ["filler"]),
        ("content content, content content content", ["filler"]),
        ('x1 "a" x1 "b" x1 "c" x1 `d` x1', []),
        ("Bla, bla, bla.", ["filler"]),
        ("xx xx xx xx", ["filler"]),
        ("jkl jkl jkl", ["filler"]),
        ("uiop uiop uiop", ["filler"]),
        ("404", ["error"]),
        ("well\n503\n", ["error"]),
        ("dolor sit amet consectetur adipiscing elit", ["filler"]),
        ("Lorem ipsum here", ["filler"]),
        ("sed sed sed", []),
        ("Vamper, odis kular benti sombre. Tilar odis vemper kular.", []),
        ("Vamper, odis kular benti sombre. Tilar odis vemper kular sombre.", ["filler"]),
        ("Fixed buffer overflow. Added retry logic and removed the old client.", []),
        ("Sorry, this page could not be found.", ["error"]),
        ("The client retries when the server cannot be reached.", []),
        ("Your session has expired. Please log in again.", ["error"]),
        ("The session has expired before the second pass of the reader could begin its work.", []),
        ("Service unavailable", ["error"]),
        ("Bitte aktivieren Sie JavaScript.", ["scripts"]),
        ("The module requires JavaScript modules of version 4 and a loader.", []),
        ("```\nopen fence with {{ name }}", ["placeholder"]),
        ('{"status": 503, "error": "x"}', ["error"]),
        ("test test test test\ntest", []),
        ("> 404", []),
        ("the the book of 404 pages, ii. aa.", []),
    ],
)
def test_residue_filter_changes_no_evidence(text, kinds):
    assert residue.evidence(text) == residue.evidence(text, every_line=True) == kinds
