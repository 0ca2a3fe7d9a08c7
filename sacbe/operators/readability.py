"""Reading ease, bands and numeric features of documents, computed inside the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sacbe.functions.text import SENTENCE_END, WORD, count, syllable_count, text, word_count, words
from sacbe.functions.vocabulary import LEXICON, STOP_ENGLISH, STOP_SPANISH

#: Bands of the score: the calibrated cuts and the classic ones (fixed values).
CUTS, CLASSIC_CUTS = (83.0, 60.0), (90.0, 75.0)
SEGMENT = 100
# What a heading begins with, and signs of mathematics.
_HEADING = r"(?imu)^\s*(cap[íi]tulo|unidad|lecci[óo]n|tema|bloque|secci[óo]n)\s+(\d+|[ivxlcdm]+|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez)(?![\p{L}\p{N}_])"
_MATH = r"[+\-×÷=<>≤≥±%°√∑πΔ/*^]"


def band(score: Column, cuts: tuple[float, float] = CUTS) -> Column:
    """Level of a score."""
    return F.when(score >= cuts[0], "primaria_baja").when(score >= cuts[1], "primaria_alta").otherwise("basicos")


def readability(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with palabras, oraciones, silabas, silabas_por_palabra, palabras_por_oracion, puntuacion (not rounded), nivel.

    Texts without words (nulls too) get zeros and the most careful level; any other text has at least one sentence.
    """
    c = text(column)
    out = df.withColumn("palabras", word_count(c)).withColumn("silabas", syllable_count(c)).withColumn("oraciones", F.when(F.col("palabras") == 0, 0).otherwise(F.greatest(count(c, SENTENCE_END), F.lit(1))))
    some = F.col("palabras") > 0
    out = out.withColumn("silabas_por_palabra", F.when(some, F.col("silabas") / F.col("palabras")).otherwise(0.0))
    out = out.withColumn("palabras_por_oracion", F.when(some, F.col("palabras") / F.col("oraciones")).otherwise(0.0))
    score = F.lit(206.84) - F.lit(0.6) * (F.col("silabas_por_palabra") * 100) - F.lit(1.02) * F.col("palabras_por_oracion")
    return out.withColumn("puntuacion", F.when(some, score).otherwise(0.0)).withColumn("nivel", F.when(some, band(F.col("puntuacion"))).otherwise("basicos"))


def _share(c: Column, vocabulary: list[str]) -> Column:
    """Words of a lower-case text that are in a short list, by one pattern with letter borders."""
    letters = "a-záéíóúüñ"
    return count(c, f"(?<![{letters}])(?:{'|'.join(sorted(set(vocabulary)))})(?![{letters}])")


def lexical_richness(c: Column) -> Column:
    """Mean share of distinct words over full segments of SEGMENT words; for shorter texts of all words."""
    w = F.transform(words(c, WORD), F.lower)
    n = F.size(w)
    full = F.floor(n / SEGMENT).cast("int")
    per = F.transform(F.sequence(F.lit(0), full - 1), lambda i: F.size(F.array_distinct(F.slice(w, i * SEGMENT + 1, SEGMENT))) / SEGMENT)
    return F.when(n == 0, 0.0).when(n < SEGMENT, F.size(F.array_distinct(w)) / n).otherwise(F.aggregate(per, F.lit(0.0), lambda a, x: a + x) / full)


def features(df: DataFrame, column: str = "text") -> DataFrame:
    """The 14 numeric features of the subject classifier, in their fixed order, after the other columns.

    Readability values are the stored, rounded ones. Texts without words get zeros.
    """
    c, low = text(column), F.lower(text(column))
    base = readability(df, column).drop("nivel", "silabas", "oraciones")
    n = F.col("palabras")
    size = F.greatest(F.length(c), F.lit(1))
    got = {
        "densidad_matematica": count(c, _MATH) / size,
        "densidad_digitos": count(c, r"(?U)\d") / size,
        "prop_stopwords_ingles": _share(low, STOP_ENGLISH) / n,
        "prop_stopwords_espanol": _share(low, STOP_SPANISH) / n,
        "riqueza_lexica": lexical_richness(c),
        "largo_promedio_palabra": F.length(F.regexp_replace(c, "[^a-záéíóúüñA-ZÁÉÍÓÚÜÑ]+", "")) / n,
        "palabras_por_oracion": F.round("palabras_por_oracion", 2),
        "silabas_por_palabra": F.round("silabas_por_palabra", 3),
        "indice_fernandez_huerta": F.round("puntuacion", 2),
        "encabezados_por_1000_palabras": count(c, _HEADING) / n * 1000,
        **{f"lexico_{s}": _share(low, v) / n * 1000 for s, v in LEXICON.items()},
    }
    return base.select(*df.columns, *[F.when(n > 0, v).otherwise(0.0).alias(k) for k, v in got.items()])


FEATURES = ("densidad_matematica", "densidad_digitos", "prop_stopwords_ingles", "prop_stopwords_espanol", "riqueza_lexica", "largo_promedio_palabra", "palabras_por_oracion", "silabas_por_palabra", "indice_fernandez_huerta", "encabezados_por_1000_palabras", *[f"lexico_{s}" for s in LEXICON])
