"""Problem 2: the school level a text demands.

The language of a sentence is the one under whose letter trigrams it is likelier, and its syllables follow
the hyphenation rules of that language. It is measured by five classic formulas; each score is turned into a school
grade through three knots (the medians of the three labelled levels), and the estimates are combined by
their median. A text keeps to one level but for some sentences, so its own grade is the median of three
robust summaries over its sentences: median, mean, and mean weighted by words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sacbe.llm.quality import examples_by_kind, measured
from sacbe.llm.syllables import english, spanish
from sacbe.llm.words import WORD, Languages, Memo, Parsed, parse
from sacbe.storage import table

#: School year in the middle of each level.
LEVELS = {"primaria_baja": 2.0, "primaria_alta": 5.0, "basicos": 8.0}
#: Grades where the text of one level ends and the next begins: about midway between the knots, the upper one lower since a text of basicos may hold many sentences of primaria_alta.
CUTS = (3.6, 5.6)
#: Shortest piece measured, in words, and the grades estimates are held to.
LEAST_WORDS, LOWEST, HIGHEST = 3, -1.0, 12.0
#: Bands of the stored score (fixed values of the problem): at or above the first, below the second.
EASY, HARD = 83, 60

#: Languages with formulas, and the subject that tells the language of a labelled text.
LANGUAGES = ("en", "es")
ENGLISH_SUBJECT = "ingles"


def language_model(examples: pd.DataFrame) -> Languages:
    """Letter trigrams of the labelled texts of each language (texto, materia)."""
    english = examples["materia"] == ENGLISH_SUBJECT
    return Languages({"en": list(examples["texto"][english]), "es": list(examples["texto"][~english])})


def _token(token: str, languages: Languages) -> tuple:
    """Words, letters, evidence for English over Spanish, and for each language syllables and words of three syllables or more."""
    words = [w.lower() for w in WORD.findall(token)]
    en, es = [len(english(w)) for w in words], [len(spanish(w)) for w in words]
    a, b = languages.evidence(token)
    return (len(words), sum(map(len, words)), a - b, sum(en), sum(n >= 3 for n in en), sum(es), sum(n >= 3 for n in es))


def sentence_measures(x: Parsed, memo: Memo) -> pd.DataFrame:
    """owner (place of the text), english, words, syllables, letters, long words of each rough piece of at least LEAST_WORDS words."""
    known = x.table(memo, float).reshape(-1, 7)
    piece = x.piece
    if not len(piece):
        return pd.DataFrame({c: np.zeros(0) for c in ("owner", "english", "words", "syllables", "letters", "long")})
    first = np.flatnonzero(np.diff(piece, prepend=-1))
    n, letters, lean, en, en3, es, es3 = np.add.reduceat(known[x.codes], first, axis=0).T
    is_english = lean > 0
    out = pd.DataFrame({"owner": x.owner[first], "english": is_english, "words": n, "syllables": np.where(is_english, en, es), "letters": letters, "long": np.where(is_english, en3, es3)})
    return out[out["words"] >= LEAST_WORDS]


def scores(s: pd.DataFrame) -> np.ndarray:
    """The formulas of each sentence (a row each), turned so that more is easier.

    Spanish: Fernández-Huerta, Szigriszt-Pazos, Gutiérrez de Polini, Crawford, and Fog; English: Flesch,
    Flesch-Kincaid, ARI, Fog, Coleman-Liau.
    """
    words = s["words"].to_numpy(float)
    p, c, h = s["syllables"].to_numpy(float) / words, s["letters"].to_numpy(float) / words, s["long"].to_numpy(float) / words
    en = np.column_stack([206.835 - 84.6 * p - 1.015 * words, -(0.39 * words + 11.8 * p - 15.59), -(4.71 * c + 0.5 * words - 21.43), -0.4 * (words + 100 * h), -(5.88 * c - 29.6 / words - 15.8)])
    es = np.column_stack([206.84 - 60 * p - 1.02 * words, 206.835 - 62.3 * p - words, 95.2 - 9.7 * c - 0.35 * words, -(-20.5 / words + 4.9 * p - 3.407), -0.4 * (words + 100 * h)])
    return np.where(s["english"].to_numpy(bool)[:, None], en, es)


def knots(examples: pd.DataFrame, languages: Languages) -> dict[bool, np.ndarray]:
    """Per language (English or not) an array (formula, level) of median scores over the sentences of the labelled texts."""
    known = examples[examples["nivel"].isin(list(LEVELS))].reset_index(drop=True)
    s = sentence_measures(parse(list(known["texto"])), Memo(lambda t: _token(t, languages)))
    level = known["nivel"].map(list(LEVELS).index).to_numpy()[s["owner"].to_numpy(int)] if len(s) else np.zeros(0)
    x, is_english = scores(s), s["english"].to_numpy(bool)
    out = {}
    for e in (True, False):
        own = [x[(is_english == e) & (level == k)] for k in range(3)]
        if all(map(len, own)):
            out[e] = np.array([np.median(o, axis=0) for o in own]).T
    return out


def _medians(values: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Median of the values of each owner that has any (``owner`` ascending, ``size``: values of each such owner)."""
    v = values[np.lexsort((values, owner))]
    start = np.cumsum(size) - size
    return (v[start + (size - 1) // 2] + v[start + size // 2]) / 2


class Levels:
    """nota (the grade a text demands; null without a measurable sentence) and oraciones (the sentences it rests on)."""

    schema = "nota double, oraciones int"

    def __init__(self, languages: Languages, at: dict[bool, np.ndarray]):
        self.languages, self.at = languages, at
        self.memo: Memo | None = None

    def __getstate__(self):
        return {"languages": self.languages, "at": self.at, "memo": None}

    def __call__(self, x: Parsed) -> pd.DataFrame:
        self.memo = self.memo if self.memo is not None else Memo(lambda t: _token(t, self.languages))
        s = sentence_measures(x, self.memo)
        s = s[s["english"].isin(list(self.at))]
        note, n = np.full(x.n, np.nan), np.zeros(x.n, dtype=int)
        if len(s):
            score, is_english = scores(s), s["english"].to_numpy(bool)
            k = np.stack([self.at.get(e, np.zeros((5, 3))) for e in (False, True)])[is_english.astype(int)]  # (sentence, formula, level)
            low = 2 + 3 * (score - k[..., 0]) / np.minimum(k[..., 1] - k[..., 0], -1e-9)
            high = 5 + 3 * (score - k[..., 1]) / np.minimum(k[..., 2] - k[..., 1], -1e-9)
            grade = np.median(np.clip(np.where(score > k[..., 1], low, high), LOWEST, HIGHEST), axis=1)
            at, owner, size = np.unique(s["owner"].to_numpy(int), return_inverse=True, return_counts=True)
            words = s["words"].to_numpy(float)
            mean = np.bincount(owner, grade) / size
            weighted = np.bincount(owner, grade * words) / np.bincount(owner, words)
            note[at] = np.median([_medians(grade, owner, size), mean, weighted], axis=0)
            n[at] = size
        return pd.DataFrame({"nota": note, "oraciones": n})


def with_level(df: DataFrame) -> DataFrame:
    """``df`` with ``nivel`` of its ``nota``."""
    low, high = CUTS
    return df.withColumn("nota", F.nanvl("nota", F.lit(None).cast("double"))).withColumn("nivel", F.when(F.col("nota") < low, "primaria_baja").when(F.col("nota") < high, "primaria_alta").when(F.col("nota").isNotNull(), "basicos"))


def fitted(spark, folder: str) -> Levels:
    """The measure fitted to the labelled texts (a fixed small table)."""
    labelled = table(spark, folder, "muestra_etiquetada").filter("clase = 'prosa' and texto is not null").select("texto", "nivel", "materia").toPandas()
    languages = language_model(labelled)
    return Levels(languages, knots(labelled, languages))


def reading_level(df: DataFrame, id_col: str, text_col: str, levels: Levels) -> DataFrame:
    """id, nota (grade), oraciones, nivel of each row; nulls for texts without a measurable sentence."""
    return with_level(measured(df, id_col, text_col, levels))


def grade_level(column: str) -> Column:
    """The level of a declared grade that names a school year (``4to_primaria``, ``Segundo básico``, ``6° primaria``), else null."""
    g = F.translate(F.lower(F.col(column)), "áéíóú", "aeiou")
    year = F.coalesce(
        F.regexp_extract(g, r"([1-9])", 1).try_cast("int"),
        F.coalesce(*[F.when(g.contains(w), F.lit(n)) for n, w in enumerate(("primer", "segund", "tercer", "cuart", "quint", "sext"), 1)]),
    )
    return (
        F.when(g.rlike("primari") & year.between(1, 3), "primaria_baja")
        .when(g.rlike("primari") & year.between(4, 6), "primaria_alta")
        .when(g.rlike("basico") & year.between(1, 3), "basicos")
    )


def p2_levels(spark, folder: str) -> DataFrame:
    """Every example with its grade and level."""
    return reading_level(table(spark, folder, "ejemplos"), "ejemplo_id", "texto", fitted(spark, folder)).dropDuplicates(["id"]).withColumnRenamed("id", "ejemplo_id")


def p2_found(spark, folder: str) -> DataFrame:
    """Declared grades and stored scores that contradict the level the text is written for."""
    prose = examples_by_kind(spark, folder, fitted(spark, folder)).filter("clase = 'prosa'")  # kinds and levels from one pass over the texts
    level = with_level(prose).filter("nivel in ('primaria_baja', 'basicos')").select(F.col("id").alias("ejemplo_id"), "nivel")
    declared = table(spark, folder, "ejemplos").select("ejemplo_id", grade_level("grado").alias("declarado")).filter("declarado in ('primaria_baja', 'basicos')")
    stored = table(spark, folder, "metricas_legibilidad").select("ejemplo_id", F.when(F.col("puntuacion") >= EASY, "primaria_baja").when(F.col("puntuacion") < HARD, "basicos").alias("declarado")).filter("declarado is not null")
    said = declared.withColumn("hallazgo", F.lit("grado")).unionByName(stored.withColumn("hallazgo", F.lit("puntuacion")))
    return level.join(said, "ejemplo_id").filter("nivel <> declarado").select("ejemplo_id", "hallazgo").distinct()
