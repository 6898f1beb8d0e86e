"""Natural language in the comments and string literals of source code.

Per-language lexers give comments and literals; code-like matter (identifiers, paths, numbers, calls) is removed; what
is left is cut into sentences, and each sentence long enough is assigned a language by naive Bayes over its character
trigrams.  The model is fitted here, on a bounded sample of documents whose language is labelled: ``PER_LANGUAGE``
documents a language, taken by hash, each of at most ``LONGEST`` characters; words are learnt with and without their
accents.  Labels that the first fit contradicts are dropped and the model is fitted once more.

Defined cases: null and empty code, and code without comments and literals, gives no row; a language is reported for
an item only from a full sentence of five words (eight characters in Chinese and Japanese) in it; the shares are bytes
of the passages that hold such sentences, over the bytes of the item; repeated rows of an id count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweir.llm import lexers

LANGUAGES = ("en", "de", "es", "fr", "ja", "pt", "ru", "zh")
PER_LANGUAGE, LONGEST = 300, 8000
BITS = 16
_word = re.compile(r"[^\W\d_]+")
_code = re.compile(r"https?://\S++|\b\w++(?:(?:\.|::|[/\\])\w++)++|\b\w++\(\S*+|\b[a-z]++[A-Z]\w*+|\b[A-Za-z0-9]++_\w*+|[{}<>=;|\\$`]++")
_cjk = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_kana = re.compile(r"[\u3040-\u30ff]")
_cyrillic = re.compile(r"[\u0400-\u04ff]+")


def plain(sentence: str) -> str:
    """Lower-case letters, everything else a single blank."""
    return f" {' '.join(_word.findall(sentence.lower()))} "


def unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts together, and where each text's begin."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    mixed = ((mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x2C1B3C6D) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return mixed.astype(np.int64), starts


class Model:
    """log P(trigram | language) by hash."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def fit(cls, samples: list[tuple[str, str]]) -> Model:
        counts = np.full((1 << BITS, len(LANGUAGES)), 0.02)
        for k, language in enumerate(LANGUAGES):
            texts = [t for t, own in samples if own == language]
            hashed, _ = grams(texts)
            counts[:, k] += np.bincount(hashed, minlength=1 << BITS)
        return cls(np.log(counts / counts.sum(0)).astype(np.float32))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Mean log-probability of each text in each language; trigrams across two texts do not count."""
        hashed, starts = grams(texts)
        lengths = np.fromiter((max(len(t) - 2, 0) for t in texts), np.int64, len(texts))
        if not len(hashed):
            return np.zeros((len(texts), len(LANGUAGES)), np.float32)
        out = np.zeros((len(texts), len(LANGUAGES)), np.float64)
        for at in range(0, len(texts), 2000):
            first = starts[at]
            last = min(starts[min(at + 2000, len(texts)) - 1] + lengths[min(at + 2000, len(texts)) - 1], len(hashed))
            part = np.zeros((last - first + 1, len(LANGUAGES)), np.float64)
            np.cumsum(self.table[hashed[first:last]], axis=0, dtype=np.float64, out=part[1:])
            own = slice(at, at + 2000)
            ends = np.minimum(starts[own] + lengths[own], last) - first
            out[own] = (part[ends] - part[np.minimum(starts[own] - first, ends)]) / np.maximum(lengths[own], 1)[:, None]
        return out


def _training(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out = []
    for text, language in rows:
        text = re.sub(r"```.*?(?:```|\Z)", "\n", text, flags=re.S)
        for s in lexers.sentences(lexers.readable(text)):
            own = plain(_code.sub(" ", s))
            if len(own) > 12:
                out += [(own, language), (unaccented(own), language)]
                if language == "de":
                    out.append((own.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss"), language))
    return out


def fit_languages(documents: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> Model:
    """The model from a bounded sample of labelled documents: at most 8 * per_language texts of at most longest characters."""
    labelled = documents.select("doc_id", "text", F.lower("lang").alias("lang")).where(F.length("text").between(40, longest))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = labelled.where(F.col("lang").isin(*LANGUAGES)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)
    samples = _training([(r["text"], r["lang"]) for r in sample.select("text", "lang").collect()])
    model = Model.fit(samples)
    if samples:
        best = model.scores([t for t, _ in samples]).argmax(1)
        model = Model.fit([s for s, b in zip(samples, best) if LANGUAGES[b] == s[1]])
    return model


def _long_enough(sentence: str) -> bool:
    if len(_cjk.findall(sentence)) >= 8:
        return True
    return len(_word.findall(sentence)) >= 5


def judge(model: Model, passages: list[list[str]]) -> list[list[str]]:
    """For each passage (a list of sentences) the languages of its full sentences."""
    flat, owner = [], []
    for k, sentences in enumerate(passages):
        for s in sentences:
            cleaned = _code.sub(" ", s)
            if _long_enough(cleaned):
                flat.append(cleaned)
                owner.append(k)
    out: list[list[str]] = [[] for _ in passages]
    if not flat:
        return out
    distinct = list(dict.fromkeys(flat))
    best = dict(zip(distinct, model.scores([plain(s) for s in distinct]).argmax(1)))
    for s, k in zip(flat, owner):
        language = LANGUAGES[best[s]]
        han = len(_cjk.findall(s))
        if han >= 8:
            language = "ja" if len(_kana.findall(s)) >= 2 else "zh"
        elif language in ("zh", "ja"):
            continue
        elif (language == "ru") != (len(_cyrillic.findall(s)) >= 4):
            language = "ru" if len(_cyrillic.findall(s)) >= 5 else "en"
        if language not in out[k]:
            out[k].append(language)
    return out


def hidden_prose(symbols: DataFrame, documents: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """(id, lang, bytes, share) for each id and language of the prose in its visible code."""
    fitted = symbols.sparkSession.sparkContext.broadcast((model or fit_languages(documents)).table)  # 2 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(fitted.value)
        for b in batches:
            rows = []
            found, owner = [], []
            codes = b["code"].tolist()
            for k, (code, language, path) in enumerate(zip(codes, b["code_language"], b["path"])):
                for kind, size, text in lexers.passages(code, lexers.lexer_of(language, path)):
                    if len(text) >= 8:
                        found.append((size, lexers.sentences(text)))
                        owner.append(k)
            totals: dict[tuple[int, str], int] = {}
            for k, (size, _), languages in zip(owner, found, judge(own, [s for _, s in found])):
                for language in languages:
                    totals[k, language] = totals.get((k, language), 0) + size // len(languages)
            ids = b["id"].tolist()
            for (k, language), size in totals.items():
                rows.append((ids[k], language, size, size / max(len(codes[k].encode()), 1)))
            yield pd.DataFrame(rows, columns=["id", "lang", "bytes", "share"])

    code = symbols.select("id", "code_language", "path", F.coalesce("content", "preview").alias("code")).where("code is not null and id is not null")
    return code.mapInPandas(run, "id string, lang string, bytes long, share double").dropDuplicates(["id", "lang"])
