"""Problem 10: repetition inside a single document.

``divergence`` is the method asked for: Jensen-Shannon distance between a document's histograms of
character classes and common words (a bin for each) and the references of its language, with a guard for
short texts. It tells unusual text from usual text, but a text that repeats its own normal sentences has much
the same histogram: measured on these tables it does not separate the cases (README has the figures), so
``p10_found`` rests on ``repeated_share``, an exact count of words in repeated eight-word passages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sacbe.storage import materialize, table

#: Words of a passage, and the least share of words in repeated passages (fixed by the problem).
PASSAGE, LEAST_SHARE = 8, 0.3
#: Texts of fewer words get no divergence.
LEAST_WORDS = 40

_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CLASSES = (("vocal", r"[aeiouáéíóúüàèìòùâêîôûãõ]"), ("consonante", r"(?:(?![aeiouáéíóúüàèìòùâêîôûãõ])[^\W\d_])"), ("cifra", r"\d"), ("espacio", r" "), ("linea", r"\n"), ("punto", r"[.!?…]"), ("coma", r"[,;:]"), ("otro", r"[^\w\s.!?…,;:]"))


def repeated_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of them lie in a passage of which an equal one begins earlier in the text.

    All texts of a batch are handled as one array of word codes; passages that would cross from one text
    to the next are left out.
    """
    words = [_WORD.findall((t or "").lower()) for t in texts]
    size = np.array([len(w) for w in words], dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.int64)
    if size.sum() < PASSAGE:
        return size, out
    code = pd.factorize(np.array([x for w in words for x in w], dtype=object))[0].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), size)
    n = len(code) - PASSAGE + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(PASSAGE):
        h = (h ^ (code[k : k + n] + np.uint64(k + 1))) * _MIX
        h ^= h >> np.uint64(31)
    whole = owner[:n] == owner[PASSAGE - 1 :]
    h = (h ^ owner[:n].astype(np.uint64)) * _MIX
    at = np.flatnonzero(whole)
    again = pd.Series(h[at]).duplicated(keep="first").to_numpy()  # an equal one begins earlier
    cover = np.zeros(len(code) + 1, dtype=np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + PASSAGE, -1)
    inside = np.cumsum(cover[:-1]) > 0
    np.add.at(out, owner[inside], 1)
    return size, out


def repeated_share(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, palabras, repetidas, parte of each row; null and blank texts have 0 words and share 0.

    One pass over the input without a shuffle. Texts are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size, inside = repeated_words(list(b["text"]))
            yield pd.DataFrame({"id": b["id"].to_numpy(), "palabras": size, "repetidas": inside, "parte": inside / np.maximum(size, 1)})

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id bigint, palabras bigint, repetidas bigint, parte double")


def histograms(df: DataFrame, common: dict[str, list[str]], id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, lang, palabras, clases (a share per character class), comunes (a share per common word of the language, then of all other words) of each row.

    ``lang``: the declared language if there are common words for it, else the language whose common words
    the text has most of. Shares of null and blank texts are 0.
    """
    languages = sorted(common)
    place = {x: {w: k for k, w in enumerate(common[x])} for x in languages}
    patterns = [re.compile(p, re.I) for _, p in _CLASSES]

    def measure(text: str | None, lang: str | None) -> tuple:
        text = text or ""
        words = Counter(_WORD.findall(text.lower()))
        n = sum(words.values())
        if lang not in common:
            lang = max(languages, key=lambda x: (sum(words[w] for w in place[x]), x))
        bins = np.zeros(len(common[lang]) + 1, dtype=np.float32)
        for w, k in place[lang].items():
            bins[k] = words[w]
        bins[-1] = n - bins.sum()
        kinds = np.array([len(p.findall(text)) for p in patterns], dtype=np.float32)
        return lang, n, kinds / max(kinds.sum(), 1), bins / max(n, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame([measure(t, x) for t, x in zip(b["text"], b["lang"])], columns=["lang", "palabras", "clases", "comunes"])
            got.insert(0, "id", b["id"].to_numpy())
            yield got

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInPandas(run, "id bigint, lang string, palabras bigint, clases array<float>, comunes array<float>")


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of ``p`` and the distribution ``q``."""
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0.0).sum(axis=-1)

    return np.sqrt(np.maximum((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0.0))


def references(h: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean histograms of all texts of each language with LEAST_WORDS words or more: a fixed number of bins a language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, own in b.groupby("lang"):
                for kind in ("clases", "comunes"):
                    total = np.sum(np.vstack(own[kind].to_numpy()), axis=0, dtype=float)
                    yield pd.DataFrame({"lang": lang, "tipo": kind, "k": np.arange(len(total), dtype="int32"), "v": total})

    rows = h.filter(F.col("palabras") >= LEAST_WORDS).select("lang", "clases", "comunes").mapInPandas(run, "lang string, tipo string, k int, v double").groupBy("lang", "tipo", "k").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for lang, own in rows.groupby("lang"):
        both = [own[own["tipo"] == kind].sort_values("k")["v"].to_numpy() for kind in ("clases", "comunes")]
        out[lang] = tuple(x / max(x.sum(), 1e-12) for x in both)
    return out


def divergence(df: DataFrame, common: dict[str, list[str]], id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, lang, palabras, divergencia: mean of two distances to the reference of the language, of character classes and of common words.

    Texts of fewer than LEAST_WORDS words get null. ``common``: the common words of each language, a fixed small table.
    """
    h = materialize(histograms(df, common, id_col, text_col, lang_col), "histograms")
    usual = references(h)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            far = np.full(len(b), np.nan)
            for lang, own in b[b["palabras"] >= LEAST_WORDS].groupby("lang"):
                far[own.index] = sum(jensen_shannon(np.vstack(own[c].to_numpy()).astype(float), q) for c, q in zip(("clases", "comunes"), usual[lang])) / 2
            yield pd.DataFrame({"id": b["id"], "lang": b["lang"], "palabras": b["palabras"], "divergencia": far})

    out = h.mapInPandas(run, "id bigint, lang string, palabras bigint, divergencia double")
    return out.withColumn("divergencia", F.nanvl("divergencia", F.lit(None).cast("double")))


def p10_divergence(spark, folder: str) -> DataFrame:
    """Divergence of every document from the usual text of its language, beside its share of repeated words."""
    docs = table(spark, folder, "documents")
    common: dict[str, list[str]] = {}
    for lang, word in sorted(table(spark, folder, "palabras_comunes").filter("lang is not null and palabra is not null").select("lang", F.lower("palabra")).distinct().collect()):
        common.setdefault(lang, []).append(word)
    far = divergence(docs, common, "doc_id", "text", "lang")
    share = repeated_share(docs, "doc_id", "text").select("id", "parte")
    return far.join(share, "id").withColumnRenamed("id", "doc_id")


def p10_found(spark, folder: str) -> DataFrame:
    """Documents of which at least three tenths of the words lie in repeated passages."""
    docs = table(spark, folder, "documents")
    return repeated_share(docs, "doc_id", "text").filter(F.col("parte") >= LEAST_SHARE).select(F.col("id").alias("doc_id")).distinct()
