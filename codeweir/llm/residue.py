"""Documents with template residue, filler, error pages or script notices in place of content.

Normalised lines are counted by host (the source of a document) over the whole corpus; a line that recurs in a large
share of a host's documents is boilerplate: navigation, footers, a notice on every page. It is subtracted by a join on
host and line, and what remains of a document is judged. Of a document that has nothing else, the page itself is the
template, and its lines are judged as they are.

A line is judged without code (fenced, indented or in back quotes) and quotations, for four kinds of evidence. A
placeholder is a marker left unfilled or the print of a missing value. Filler is text about text to come, repeats, and
sentences without a single common word of a language. An error page names a thing of the web and what is wrong with it,
and speaks to its reader, gives a code, or says nothing else; a script notice names scripts, that they are needed or
off, and the reader or the view. A bare status phrase counts only if little else remains.

Defined cases: null, empty and blank texts hold no evidence; a document with any evidence is excluded, whatever else it
holds; repeated texts are judged alike; a null source is a host of its own; an unclosed fence is no fence; a null key is
a key like others; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line is boilerplate of a host if at least this share of its documents have it, and at least LEAST.
SHARE, LEAST = 0.05, 5
#: A bare status phrase counts if fewer words than this remain.
LITTLE = 30

# Common words of languages in Latin letters, status phrases, prints of missing values.
COMMON = frozenset(
    "the a an of to in on at by for from with without and or but not no nor so if then than that this these those it its is are was were be been as which who what when where while because "
    "we you they he she i our your their his her do does did has have had will would can could should must may might only also more most some any all each every into over under between "
    "der die das den dem des ein eine einen einem einer und oder nicht ist sind war wird werden wurde im am zu zur zum von mit für auf aus bei nach wenn weil dass als auch nur noch sich es er sie wir ihr hier bis ohne "
    "le la les un une des du de et ou ne pas est sont dans pour par sur avec sans que qui au aux ce cette ces il elle nous vous si plus "
    "el los las una y o en con sin por para se su sus es son al lo como más ya si cuando porque este esta "
    "os as um uma e ou não em no na nos nas com sem por para se seu sua é são ao aos mais já quando porque este esta do da dos das".split()
)
_STATUS = r"(?:bad request|unauthorized|payment required|forbidden|not found|method not allowed|request timeout|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway time-?out)"
_NOTHING = r"(?:undefined|null|nan|none|nil)"

_indented = re.compile(r"^(?: {4}|\t)[^\n]*$", re.M)
_inline = re.compile(r"``?[^`\n]+``?")
_quotes = re.compile(r"\"[^\"\n]{1,160}\"|“[^”\n]{1,160}”|„[^“”\n]{1,160}[“”]|(?<!\w)'[^'\n]{1,60}'(?!\w)|「[^」\n]{1,160}」")

_N = r"[A-Za-z][\w .-]{0,40}"
_holder = re.compile(
    rf"\{{\{{\s*{_N}?\s*\}}\}}|<%[=-]?\s*{_N}\s*%>|[$#]\{{\s*{_N}\s*\}}|%\({_N}\)[sSdD]|\[\[\s*{_N}\s*\]\]|\{{%\s*{_N}\s*%\}}|\$\$\s*{_N}\s*\$\$|@@\s*{_N}\s*@@"
    r"|(?<![\w_])__(?!(?:init|main|name|all|str|repr|call|enter|exit|len|iter|next|doc|file|dict|class|future|version|new|eq|hash)__)[A-Za-z](?:\w|[ ])*?[^_ ]__(?![\w_])"
    rf"|<\s*insert {_N} here\s*>|&lt;\s*{_N}\s*&gt;|(?<![\w/])<(?!(?:A|B|I|P|BR|HR|LI|UL|OL|EM|TD|TR|TH|H\d|DIV|PRE|SPAN|HTML|HEAD|BODY|TITLE|TABLE|CODE|STRONG|NOSCRIPT|SCRIPT|IMG)>)[A-Z][A-Z0-9_]+(?: [A-Z0-9_]+)*>"
    r"|(?<!\w)\[(?!(?:TODO|WIP|RFC|BUG|API|PR|OK|NOTE|INFO|WARN|ERROR)\])[A-Z][A-Z0-9_]{2,}(?: [A-Z0-9_]+)*\](?![(\[]|:\s*(?:\w+:|[/<#.]))|(?<![\w%])%[A-Za-z][\w ]{0,40}[A-Za-z_]%(?![\w%])|«\s*[A-Z][A-Z0-9_]+(?: [A-Z0-9_]+)*\s*»"
    r"|\[object object\]",
)
_holder_any_case = re.compile(rf"\[object object\]|<\s*insert {_N} here\s*>|^\W*\[(?:content|text|title|name|description|summary)\]\W*$", re.I | re.M)
_brace = re.compile(r"(?<![\w$#%{\\])\{([A-Za-z][\w ]{0,40})\}(?!\})")
_notation = re.compile(r"\b(?:notation|index|syntax|slot|element|set of|bracket|braces?)\b", re.I)
_missing = re.compile(
    rf"^\W*(?:[^\W\d_][\w ]{{0,30}}:\s*)?{_NOTHING}\W*$|^\W*(?:dear|release|candidate|report for)\s+{_NOTHING}\b|^\W*{_NOTHING}\s+was\b"
    rf"|\b(?:by|from|of|on|with|for|in)\s+{_NOTHING}(?=\s+(?:was|were|of|on|brings?|finished|cases?|by|from)\b|[.,:!]|$)|:\s*{_NOTHING}\s+of\b|\bbrings\s+{_NOTHING}\b",
    re.I | re.M,
)

_THINGS = (
    r"pages?|(?:web ?)?sites?|address|url|links?|server|host|gateway|upstream|backend|application|app|services?|session|requests?|client|resource|what you|on our (?:side|end)|access"
    r"|seiten?|adresse|dienst|sitzung|lien|serveur|página|paginas?|enlace|sitio|servidor|link"
)
_THINGS_OTHER = r"страниц|сервер|адрес|сайт|ссылк|页面|网页|链接|网站|服务器|ページ|サイト|サーバー|リンク"
_FAILS = (
    r"(?:not|n't|cannot|never|no longer) (?:be )?(?:found|find|exist|available|displayed|reached|loaded|shown|opened|on this (?:server|host|site))|(?:unavailable|offline|broken|forbidden|unauthori[sz]ed)"
    r"|down for|maintenance|denied|not (?:allowed|authori[sz]ed|permitted)|(?:no|lacks?|lacking|not have)(?: \w+){0,2} (?:permissions?|rights?|access)|(?:has|have|was|is) (?:ended|expired|timed out)|tim(?:ed|e)[ -]?out|too long to (?:load|respond|answer)"
    r"|(?:been|was|were) (?:moved|deleted|removed)|moved (?:or|permanently)|taken down|went wrong|failures?|failed|no(?: \w+)? (?:answer|response)|too many requests|slowed down|bad gateway|internal server error"
    r"|nicht (?:gefunden|erreichbar|verfügbar|vorhanden)|existiert nicht|introuvable|n[’']existe (?:plus|pas)|(?:no|não) (?:fue |foi |se |ha sido )?(?:encontrad[ao]|existe|encontrou|encontró|disponível|disponible)|rot[oa]|indisponible"
)
_FAILS_OTHER = r"не (?:найден|существует|доступн)|ошибк|不存在|未找到|找不到|删除|错误|出错|見つかりません|存在しません|エラー|表示できません"
_READER = (
    r"you|your|you're|(?:we're|we are) sorry|oops|sorry|please|try again|retry|reload|refresh|go back|sign in|log in|shortly|incident|this (?:server|host|page|address|site|viewer|app|view|report)|(?:turn|switch) it on"
    r"|bitte|sie|ihre?[mnr]?|vous|votre|veuillez|su|usted|por favor|seu|você"
)
_READER_OTHER = r"пожалуйста|браузер|вашем|запрошенн|您|请|浏览器|本页|お探し|ください|このページ"
_CODE = r"(?:err(?:or|eur|o)?|fehler|ошибка|错误|エラー|http|status)[_ :#(-]*[45]\d\d\b|\((?:after )?\d+(?: \w+)?\)|^\W*[45]\d\d\b"
_SCRIPT = r"java ?script|scripts|scripting|скрипт|сценари|脚本|スクリプト"
_NEEDED = (
    r"enabled?|(?:turn|switch)(?:ed)? (?:it )?(?:on|off)|activate|allow(?:ed)?|needs?|requires?|required|must be|disabled|blocks?|blocked|without|habilit[ea]|activ[ae]r?|activez|ative|desactivado"
    r"|(?:ein|aus)(?:schalten)?|schalten|aktivier(?:en|t)|deaktiviert|включ|отключ|启用|开启|打开|启动|允许|禁用|有効|オン|無効|必要"
)
_VIEW = r"browser|navigateur|navegador|navegante|ansicht|rapport|informe|relatório|просмотр"


def _whole(*parts: str) -> re.Pattern:
    """Words of the first list, whole, or stems of the others anywhere."""
    return re.compile("|".join((rf"(?<!\w)(?:{parts[0]})(?!\w)", *parts[1:])))


_thing, _fail, _reader, _code = _whole(_THINGS, _THINGS_OTHER), _whole(_FAILS, _FAILS_OTHER), _whole(_READER, _READER_OTHER), re.compile(_CODE)
_script, _need, _view = re.compile(_SCRIPT), re.compile(_NEEDED), _whole(_VIEW)
#: Forms of a machine's answer: a title or field with a code, an unhandled exception, a page for browsers without scripts.
_answer = re.compile(
    rf"^\W*(?:http(?:/\d(?:\.\d)?)?\s*)?(?:error:?\s*)?[45]\d\d\s*[-–—:.|]?\s*{_STATUS}\W*$|^\W*error\s+[45]\d\d\b\W*$|<title>\s*[45]\d\d\b|\b(?:unhandled|uncaught) (?:exception|error|\w+error)\b[^.]*:", re.I
)
_field = re.compile(rf"\"(?:status|code|statuscode)\"\s*:\s*\"?[45]\d\d\b|\"error\"\s*:\s*\"{_STATUS}\"", re.I)
_bare = re.compile(rf"^\W*(?:error:?\s*)?(?:{_STATUS}|[45]\d\d)\W*$", re.I)
_no_script = re.compile(r"<noscript", re.I)

_TEXTS = r"(?:text|content|copy|description|summary|title|name|headline|heading|paragraph|section|body|caption|details)"
_filler = re.compile(
    rf"lorem ipsum|dolor sit amet|\b(?:your|the|some|more) {_TEXTS} (?:goes|comes|will be|will go|belongs) here\b|\b(?:insert|enter|put|type|add) (?:your|a|the|some) {_TEXTS} (?:in|into|here)\b|\breplace this {_TEXTS}\b|\bplaceholder {_TEXTS}\b"
    rf"|^\W*(?:{_TEXTS}|more) (?:to follow|to come|follows|coming soon)\b|\b(?:write|enter|put|describe) (?:a|the|your) \w+ .{{0,60}}\bin this (?:space|field|box|place)\b|\b(?:dummy|filler|blind|teaser) {_TEXTS}\b|\bsample (?:text|paragraph|copy)\b"
    r"|^\W*(?:paragraph|headline|heading|title|subtitle|caption|column) (?:one|two|three|four|five)\b"
    r"|\btextes? (?:viendra|à venir|ici)|\bhier (?:steht|folgt|kommt|entsteht|erscheint) .{0,40}\b(?:text|inhalt)\b|\b(?:aqu[ií]) (?:va|vai|irá|vem) (?:el|o|su|seu) (?:texto|conteúdo|contenido)\b|\btexto de (?:ejemplo|relleno|exemplo|preenchimento)\b"
    r"|здесь (?:будет|появится|должен быть) текст|此处(?:填写|输入|插入|添加)|在此(?:填写|输入|插入)|ここに(?:本文|テキスト|文章|説明)|(?:\bbla\b[\s,.]*){2,}|\b(?:blah[\s,.]*){2,}",
    re.I,
)
_keyboard = re.compile(r"(?:\b(?:asdf\w*|jkl\w*|qwer\w*|yxcv\w*|zxcv\w*|hjkl|uiop)\b[\s,.]*){3,}", re.I)
_letters = re.compile(r"(?:(?<!\w)(?:([A-Za-z])\1{1,})(?!\w)[\s,.]*){4,}")
_again = re.compile(r"\b(\w{2,12})(?:[\s,]+\1\b){4,}", re.I)
#: Words of which one is in every passage that a pattern of the kind can match, but for what TRIGGERS and repeats find.
LITERALS = {
    "missing": ["undefined", "null", "nan", "none", "nil"],
    "filler": ["lorem", "sit amet", " here", "insert ", "replace this", "placeholder", "to follow", "to come", "follows", "coming soon", "in this space", "in this field", "in this box", "in this place", "dummy", "filler", "blind ", "teaser",
               "sample ", "paragraph ", "headline ", "heading ", "title ", "caption ", "column ", "texte", "hier ", "aqu", "texto", "здесь", "此处", "在此", "ここに", "bla"],
    "keyboard": ["asdf", "jkl", "qwer", "yxcv", "zxcv", "uiop"],
    "answer": ["<title>", "unhandled", "uncaught", '"status"', '"code"', '"statuscode"', '"error"'],
    "status": ["bad request", "unauthorized", "payment required", "forbidden", "not found", "not allowed", "timeout", "time-out", "gone", "too many requests", "server error", "not implemented", "bad gateway", "unavailable"],
    "fail": ["found", "find", "exist", "available", "displayed", "reached", "loaded", "shown", "opened", "not be on", "not on this", "longer on this", "unavailable", "offline", "broken", "forbidden", "unauthori", "down for", "maintenance", "denied",
             "not allowed", "not authori", "not permitted", "permission", "right", "access", " ended", "expired", "timed out", "timeout", "time-out", "time out", "timed-out", "too long to", "moved", "was deleted", "were deleted", "been deleted",
             "was removed", "were removed", "been removed", "taken down", "went wrong", "failure", "failed", "answer", "response", "too many requests", "slowed down", "bad gateway", "server error", "erreichbar", "verfügbar", "vorhanden",
             "existiert", "gefunden", "introuvable", "encontr", "dispon", "roto", "rota", "indisponible", "не найден", "не существует", "не доступн", "ошибк", "不存在", "未找到", "找不到", "删除", "错误", "出错", "見つかりません", "存在しません",
             "エラー", "表示できません"],
    "thing": ["page", "site", "address", "url", "link", "server", "host", "gateway", "upstream", "backend", "app", "service", "session", "request", "client", "resource", "what you", "on our ", "access", "seite", "adresse", "dienst", "sitzung", "lien",
              "serveur", "página", "enlace", "sitio", "servidor", "страниц", "сервер", "адрес", "сайт", "ссылк", "页面", "网页", "链接", "网站", "服务器", "ページ", "サイト", "サーバー", "リンク"],
    "scripts": ["javascript", "java script", "script", "скрипт", "сценари", "脚本", "スクリプト"],
}
#: Passages without a fixed word.
TRIGGERS = {
    "marks": re.compile(r"[{<\[%«$@]|__|&lt;"),
    "letters": re.compile(r"(?<!\w)([a-z])\1+(?!\w)"),
    "status": re.compile(r"^\W*(?:http\S*\s*)?(?:error:?\s*)?[45]\d\d(?!\d)", re.M),
    "code": re.compile(_CODE, re.M),
}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in {w for words in LITERALS.values() for w in words}:
        a.add_word(w, ([kind for kind, words in LITERALS.items() if w in words], len(w)))
    a.make_automaton()
    return a


_literals = _automaton()


def _uncommon(line: str) -> bool:
    """A sentence of eight or more plain words, or two of five, without one common word of a language in Latin letters."""
    odd = 0
    for part in re.split(r"(?<=[.!?])\s+", line):
        words = part.rstrip(".!?").lower().replace(",", "").split()
        if len(words) < 5 or not part.endswith((".", "!", "?")) or not all(w.isalpha() and w < "\u0250" for w in words) or any(w in COMMON for w in words):
            odd = 0
            continue
        odd += 1
        if len(words) >= 8 or odd == 2:
            return True
    return False


_sentence = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_told = re.compile(r"^\W*(?:when|if|while|whenever|once|as|since|because|although|after|before)\b")
_clause = re.compile(r"\b(?:when|if|while|whenever|once|since|because|although|that|which)\b")


def _wrong(line: str) -> bool:
    """An error page's sentence: what is wrong with which thing of the web, and there or in a sentence beside it the
    reader or a code; or nothing else in the line. A sentence that only tells of a case is none."""
    if not _fail.search(line) or not _thing.search(line):
        return False
    parts = _sentence.split(line)
    for i, part in enumerate(parts):
        if _fail.search(part) and not _told.match(part):
            code, reader = bool(_code.search(part)), any(_reader.search(x) for x in parts[max(0, i - 1) : i + 2])
            if (code and reader) or (_thing.search(part) and (code or reader or (len(line.split()) <= 9 and not _clause.search(line)))):
                return True
    return False


def _off(line: str) -> bool:
    """A script notice: scripts, that they are needed or off, and in a sentence beside it the reader or the view."""
    if _no_script.search(line):
        return True
    if not _script.search(line):
        return False
    parts = _sentence.split(line)
    near = (" ".join(parts[max(0, i - 1) : i + 2]) for i, part in enumerate(parts) if _script.search(part) and _need.search(part))
    return any(_reader.search(x) or _view.search(x) for x in near)


class Line(NamedTuple):
    text: str
    kinds: tuple[str, ...]
    weak: bool  # a bare status phrase


_fence = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?^[ \t]*\1[^\n]*$", re.S | re.M)


def lines_of(text: str | None, every_line: bool = False) -> list[Line]:
    """The lines of a text outside code, with the kinds of evidence in each. Only lines that hold a trigger or a literal
    of a kind meet that kind's patterns, unless every line is asked for, which gives the same."""
    if not text or text.isspace():
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _fence.sub("", text)
    if "    " in text or "\t" in text:
        text = _indented.sub("", text)
    low = text.lower()
    if len(low) != len(text):
        low = text
    asked: dict[int, set[str]] = {}
    if every_line:
        kinds = {*TRIGGERS, *LITERALS, "again", "words"}
        asked = {at: kinds for at in (0, *(m.end() for m in re.finditer("\n", text)))}
    else:
        _triggered(low, asked)
    found = {}
    for begin, kinds in asked.items():
        end = text.find("\n", begin)
        line = text[begin : end if end >= 0 else len(text)]
        got, weak = _judge(line, kinds)
        if got:
            found[begin] = (got, weak)
    if not found:
        return []
    out, at = [], 0
    for line in text.split("\n"):
        if line.strip():
            out.append(Line(line, *found.get(at, ((), False))))
        at += len(line) + 1
    return out


def _triggered(low: str, asked: dict[int, set[str]]) -> None:
    """The lines (by their first place) that can hold evidence, and of which kinds."""
    parts: dict[str, set[int]] = {"fail": set(), "thing": set(), "code": set()}  # sentences, by their first place

    def note(kind: str, at: int) -> None:
        begin = low.rfind("\n", 0, at) + 1
        if kind in parts:
            parts[kind].add(max(begin, *(low.rfind(stop, begin, at + 1) + 1 for stop in (". ", "! ", "? "))))
        else:
            asked.setdefault(begin, set()).add(kind)

    for kind, trigger in TRIGGERS.items():
        for m in trigger.finditer(low):
            note(kind, m.start())
    for end, (kinds, size) in _literals.iter(low):
        for kind in kinds:
            note(kind, end - size + 1)
    for at in parts["fail"] & (parts["thing"] | parts["code"]):
        asked.setdefault(low.rfind("\n", 0, at) + 1, set()).add("wrong")
    if _doubled(low):
        at = 0
        for line in low.split("\n"):
            if _doubled(line):
                asked.setdefault(at, set()).add("again")
            at += len(line) + 1
    at = 0
    for part in low.replace("\n", ". ").split(". "):
        words = part.split()
        if len(words) >= 5 and COMMON.isdisjoint(words) and "".join(words[:4]).replace(",", "").isalpha() and words[0] < "\u0250":
            where = low.find(part, at)
            asked.setdefault(low.rfind("\n", 0, max(where, 0)) + 1, set()).add("words")
            at = max(where, at)


def _doubled(low: str) -> bool:
    words = low.replace(",", " ").split()
    return any(map(eq, words, words[1:]))


def _judge(line: str, kinds: set[str]) -> tuple[tuple[str, ...], bool]:
    if line.lstrip().startswith(">"):
        return (), False
    raw = _inline.sub(" ", line) if "`" in line else line
    plain = _quotes.sub(" ", raw)
    low = plain.lower()
    found = set()
    if ("marks" in kinds and _holders(plain)) or ("missing" in kinds and _missing.search(plain)):
        found.add("placeholder")
    if (
        ("filler" in kinds and _filler.search(low))
        or ("keyboard" in kinds and _keyboard.search(low))
        or ("again" in kinds and _again.search(line.lower()))
        or ("letters" in kinds and _letters.search(low))
        or ("words" in kinds and _uncommon(low.strip()))
    ):
        found.add("filler")
    weak = False
    if kinds & {"answer", "status", "wrong", "fail"}:
        if _answer.search(plain) or _field.search(raw):
            found.add("error")
        elif _bare.match(plain):
            weak = True
        elif kinds & {"wrong", "fail"} and _wrong(low):
            found.add("error")
    if "scripts" in kinds and _off(low):
        found.add("scripts")
    return (tuple(sorted({*found, "error"})), True) if weak and not found else (tuple(sorted(found)), False)


def evidence(text: str | None, every_line: bool = False) -> list[str]:
    """The kinds of evidence in a text that shares no line with others."""
    lines = lines_of(text, every_line)
    little = sum(len(x.text.split()) for x in lines) < LITTLE
    return sorted({k for x in lines if little or not x.weak for k in x.kinds})


def _holders(line: str) -> bool:
    if _holder.search(line) or _holder_any_case.search(line):
        return True
    for m in _brace.finditer(line):
        around = line[line.rfind(".", 0, m.start()) + 1 : m.end() + 80]
        if not _notation.search(around):
            return True
    return False


def line_hash(line: Column) -> Column:
    """A line's hash without case, outer blanks and the values of numbers."""
    return F.xxhash64(F.regexp_replace(F.lower(F.trim(line)), r"\d+", "0"))


def boilerplate_lines(documents: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(host, h): hashes of the lines that recur in at least SHARE of a host's documents. Counts combine before the
    shuffle, and only hashes are moved."""
    own = documents.where(F.col(text).isNotNull()).select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("t"))
    hashes = F.array_distinct(F.transform(F.filter(F.split("t", r"\r\n|\r|\n"), lambda x: F.length(F.trim(x)) > 0), line_hash))
    counted = own.select("host", F.explode(hashes).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    hosts = own.groupBy("host").agg(F.count("*").alias("docs"))
    often = counted.join(hosts, "host").where(F.col("n") >= F.greatest(F.lit(LEAST), F.col("docs") * SHARE))
    return often.select("host", "h")


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, kinds): documents that hold evidence, and of which kinds."""
    kind = documents.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, h in zip(b["k"], b["t"], b["host"]):
                rows += [(k, h, x.text, len(x.text.split()), list(x.kinds), x.weak) for x in lines_of(t)]
            yield pd.DataFrame(rows, columns=["k", "host", "l", "words", "kinds", "weak"])

    source = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("t"))
    lines = source.mapInPandas(judge, f"k {kind}, host string, l string, words int, kinds array<string>, weak boolean")
    lines = lines.select("k", "host", line_hash(F.col("l")).alias("h"), "words", "kinds", "weak")
    lines = lines.join(boilerplate_lines(documents, text, host).withColumn("often", F.lit(True)), ["host", "h"], "left")
    own = F.col("often").isNull()

    def kinds_of(which: Column) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(which, F.col("kinds"))))))

    whole = ~F.col("weak")
    seen = lines.groupBy("k").agg(
        F.coalesce(F.sum(F.when(own, F.col("words"))), F.lit(0)).alias("left"), F.sum("words").alias("words"),
        kinds_of(own & whole).alias("rest"), kinds_of(own).alias("rest_weak"), kinds_of(whole).alias("page"), kinds_of(F.lit(True)).alias("page_weak"),
    )
    kinds = F.when(F.col("left") > 0, F.when(F.col("left") < LITTLE, F.col("rest_weak")).otherwise(F.col("rest"))).otherwise(F.when(F.col("words") < LITTLE, F.col("page_weak")).otherwise(F.col("page")))
    return seen.select(F.col("k").alias(key), kinds.alias("kinds")).where(F.size("kinds") > 0)
