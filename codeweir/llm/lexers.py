"""Comments and string literals of source text, by a small lexer for each language.

Each lexer is one pattern that matches the next comment or literal whole, so that marks inside the other kind are
never taken for openings.  Unclosed comments and literals (texts cut at a limit) end with the text.
"""

from __future__ import annotations

import html
import re
import unicodedata
from typing import NamedTuple

_LINE, _BLOCK = r"(?P<line>//[^\n]*)", r"(?P<block>/\*[\s\S]*?(?:\*/|\Z))"
_PLAIN = r'(?P<plain>"(?:[^"\\\n]|\\[\s\S])*(?:"|$|\Z))'
_CHAR = r"(?P<char>'(?:\\[^'\n]{1,10}|[^'\\\n])')"
_THREE = r'(?P<raw>"""[\s\S]*?(?:"""|\Z))'
PATTERNS = {
    "python": r"(?P<line>\#[^\n]*)|(?P<raw>[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)))"
    r"|(?P<plain>[rRbBuUfF]{0,2}(?:\"(?:[^\"\\\n]|\\[\s\S])*(?:\"|$|\Z)|'(?:[^'\\\n]|\\[\s\S])*(?:'|$|\Z)))",
    "typescript": "|".join((_LINE, _BLOCK, _PLAIN, r"(?P<single>'(?:[^'\\\n]|\\[\s\S])*(?:'|$|\Z))", r"(?P<raw>`(?:[^`\\]|\\[\s\S])*(?:`|\Z))")),
    "java": "|".join((_LINE, _BLOCK, _THREE, _PLAIN, _CHAR)),
    "c#": "|".join((_LINE, _BLOCK, _THREE, r'(?P<verbatim>(?:@\$?|\$@)"(?:[^"]|"")*(?:"|\Z))', _PLAIN, _CHAR)),
    "go": "|".join((_LINE, _BLOCK, r"(?P<raw>`[^`]*(?:`|\Z))", _PLAIN, _CHAR)),
    "rust": "|".join((_LINE, _BLOCK, r'(?P<raw>\bb?r(?P<h>#*)"[\s\S]*?(?:"(?P=h)|\Z))', _PLAIN, _CHAR)),
}
LEXERS = {k: re.compile(v, re.M) for k, v in PATTERNS.items()}
_EXTENSIONS = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "java": "java", "cs": "c#", "go": "go", "rs": "rust"}


class Span(NamedTuple):
    kind: str  # line, block, or a kind of literal
    start: int
    end: int
    text: str


def lexer_of(language: str | None, path: str | None = None) -> re.Pattern:
    name = (language or "").lower()
    if name not in LEXERS:
        name = _EXTENSIONS.get((path or "").rpartition(".")[2].lower(), "java")
    return LEXERS[name]


def spans(text: str, lexer: re.Pattern) -> list[Span]:
    return [Span(m.lastgroup if m.lastgroup != "h" else "raw", m.start(), m.end(), m[0]) for m in lexer.finditer(text)]


def is_comment(span: Span) -> bool:
    return span.kind in ("line", "block")


_mark = re.compile(r"^[ \t]*(?:///?!?|//!|/\*+!?|\*+/|\*+(?!/)|#+[:!]?)?[ \t]?|[ \t]*\*+/[ \t]*$", re.M)
_tag = re.compile(r"</?[a-zA-Z][^<>\n]*/?>")


def comment_text(text: str) -> str:
    """A comment without its marks and markup, line by line."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = "\n".join(_mark.sub("", x) for x in text.split("\n"))
    return _tag.sub(" ", text)


_escape = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|((?:x[0-9A-Fa-f]{2}\\)*x[0-9A-Fa-f]{2})|([0-7]{3})|([\s\S]))")
_short = {"n": "\n", "t": " ", "r": " ", "\n": "", "0": ""}


def _unescaped(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if code:
        value = int(code, 16)
        return chr(value) if value < 0x110000 else ""
    if m[4]:
        data = bytes.fromhex(m[4].replace("\\", "").replace("x", ""))
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode("latin-1")
    if m[5]:
        return chr(int(m[5], 8))
    return _short.get(m[6], m[6])


def string_text(text: str) -> str:
    """A literal without prefix and quotes, its escapes and entities resolved."""
    body = text.lstrip("rRbBuUfF@$").strip("#")
    quote = body[:3] if body[:3] in ('"""', "'''") else body[:1]
    body = body[len(quote) :]
    if quote and body.endswith(quote):
        body = body[: -len(quote)]
    if "\\" in body:
        body = _escape.sub(_unescaped, body)
        if any("\ud800" <= c <= "\udfff" for c in body):
            body = body.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return body


def readable(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


_between_strings = re.compile(r"\s*[+.,\\]?\s*")
_between_lines = re.compile(r"[ \t]*\r?\n?[ \t]*")


def passages(text: str, lexer: re.Pattern) -> list[tuple[str, int, str]]:
    """(kind, bytes, readable text) of comments and literals; line comments on successive lines are one passage, and
    so are literals joined by nothing or a plus sign."""
    out: list[list] = []
    end = -1
    for s in spans(text, lexer):
        comment = is_comment(s)
        kind = "comment" if comment else "string"
        body = comment_text(s.text) if comment else string_text(s.text)
        size = len(s.text.encode())
        gap = text[end : s.start] if end >= 0 else None
        if out and gap is not None and out[-1][0] == kind and len(gap) < 200:
            if comment and s.kind == "line" and out[-1][3] == "line" and _between_lines.fullmatch(gap):
                out[-1][1] += size
                out[-1][2] += "\n" + body
                end = s.end
                continue
            if not comment and (_between_strings.fullmatch(gap) and "," not in gap):
                out[-1][1] += size
                out[-1][2] += body
                end = s.end
                continue
        out.append([kind, size, body, s.kind])
        end = s.end
    return [(k, n, readable(t)) for k, n, t, _ in out]


_cjk = r"\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_stop = re.compile(rf"(?<=[.!?…])[\"')\]]*(?=\s|$|[{_cjk}])|(?<=[。！？])")
_blank = re.compile(r"\n[ \t]*\n")
_join_cjk = re.compile(rf"(?<=[{_cjk}、，。])\n[ \t]*(?=[{_cjk}])")


def sentences(text: str) -> list[str]:
    """Sentences of prose whose lines may be wrapped; a tag or list mark starts a new one."""
    out = []
    for block in _blank.split(text):
        block = _join_cjk.sub("", block.strip("\n"))
        block = re.sub(r"\n[ \t]*(?=[@:\-•][A-Za-z ])", "\n\n", block)
        for part in block.split("\n\n"):
            flat = " ".join(part.split())
            out += [x.strip() for x in _stop.split(flat) if x.strip()]
    return out
