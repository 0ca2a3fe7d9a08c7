"""Corpus preparation: manifest rows, their texts, rejects with reasons, class counts, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sacbe.functions.text import strip, text, tokens
from sacbe.functions.vocabulary import SUBJECTS

LEAST_WORDS = 120
LEAST_CHARACTERS = 200


def manifest_rows(df: DataFrame) -> DataFrame:
    """Manifest rows with trimmed fields: no comments, no blank names, repeats once."""
    cols = [strip(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    return df.select(*cols).filter("archivo is not null and archivo <> '' and not startswith(archivo, '#')").distinct()


def with_verdict(rows: DataFrame, text_col: str = "texto", subject_col: str = "materia") -> DataFrame:
    """``rows`` with ``palabras`` and ``motivo``: why a row is rejected, null if it is accepted."""
    n = F.size(tokens(text(text_col)))
    reason = F.when(F.col(subject_col).isNull() | ~F.col(subject_col).isin(*SUBJECTS), "materia desconocida").when(F.col(text_col).isNull(), "falta el texto").when(n < LEAST_WORDS, "texto corto")
    return rows.withColumn("palabras", n).withColumn("motivo", reason)


def long_enough(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose trimmed text has at least LEAST_CHARACTERS code points."""
    return df.filter(F.length(strip(text(column))) >= LEAST_CHARACTERS)


def class_counts(df: DataFrame, column: str = "materia") -> DataFrame:
    """Rows per class; classes without rows don't show."""
    return df.groupBy(column).agg(F.count("*").alias("ejemplos"))


def required(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it has no rows: no manifest, no usable text."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def enough_classes(df: DataFrame, class_col: str) -> DataFrame:
    """``df``, or an error if its rows are of fewer than two classes: nothing could be told apart."""
    if df.filter(F.col(class_col).isNotNull()).select(class_col).distinct().limit(2).count() < 2:
        raise ValueError("at least two classes are needed")
    return df


def stratified_split(df: DataFrame, id_col: str, class_col: str, test: float = 0.25, seed: int = 42) -> DataFrame:
    """``df`` with ``parte``: ``prueba`` for the given share of each class, else ``entrenamiento``.

    The draw is the rank of a hash of the id, so it doesn't depend on partitions. Ranks are taken in
    two steps, inside hash slices of a class and over the slices' sizes, so that no class is sorted in one
    task. Null classes are a class of their own. If a class has a single row, the share is drawn from all rows
    alike, since each part of a stratified split needs a row of each class.
    """
    slices = 64
    alone = df.groupBy(class_col).agg(F.count("*").alias("n")).filter("n < 2").limit(1).count() > 0
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    dealt = df.withColumn("_h", h).withColumn("_s", (F.conv(F.substring("_h", 1, 2), 16, 10).cast("int") / (256 / slices)).cast("int")).withColumn("_k", F.lit(None).cast("string") if alone else F.col(class_col))
    sizes = dealt.groupBy("_k", "_s").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_s")  # at most 64 rows a class
    offsets = sizes.withColumn("_before", F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_all", F.sum("_n").over(Window.partitionBy("_k")))
    offsets = offsets.select(F.col("_k").alias("_class"), F.col("_s").alias("_slice"), F.coalesce("_before", F.lit(0)).alias("_before"), "_all")
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_k", "_s").orderBy("_h", id_col)))
    both = ranked.join(offsets, ranked["_k"].eqNullSafe(offsets["_class"]) & (ranked["_s"] == offsets["_slice"]))
    return both.select(*df.columns, F.when(F.col("_r") + F.col("_before") <= F.ceil(F.col("_all") * test), "prueba").otherwise("entrenamiento").alias("parte"))
