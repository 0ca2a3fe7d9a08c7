"""Evaluation: confusion counts, per-class report, majority baseline, level bands, cross-validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sacbe.operators import router
from sacbe.operators.readability import CLASSIC_CUTS, CUTS
from sacbe.storage import materialize

#: Fewest rows of a class for cross-validation.
LEAST_ROWS = 3


def confusion(df: DataFrame, real: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(real).alias("real"), F.col(predicted).alias("predicho")).agg(F.count("*").alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """clase, precision, recall, f1, soporte from confusion counts; a zero denominator gives 0."""
    hit = matrix.groupBy("real").agg(F.sum("n").alias("soporte"), F.sum(F.when(F.col("real") == F.col("predicho"), F.col("n")).otherwise(0)).alias("tp")).withColumnRenamed("real", "clase")
    said = matrix.groupBy(F.col("predicho").alias("clase")).agg(F.sum("n").alias("dichos"))
    j = hit.join(said, "clase", "full").na.fill(0, ["soporte", "tp", "dichos"])
    p = F.when(F.col("dichos") > 0, F.col("tp") / F.col("dichos")).otherwise(0.0)
    r = F.when(F.col("soporte") > 0, F.col("tp") / F.col("soporte")).otherwise(0.0)
    return j.withColumn("precision", p).withColumn("recall", r).select("clase", "precision", "recall", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0).alias("f1"), "soporte")


def overall(matrix: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted means of precision, recall and f1."""
    acc = matrix.agg((F.sum(F.when(F.col("real") == F.col("predicho"), F.col("n")).otherwise(0)) / F.sum("n")).alias("exactitud"))
    rep = class_report(matrix)
    means = rep.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[(F.sum(F.col(c) * F.col("soporte")) / F.sum("soporte")).alias(f"ponderado_{c}") for c in ("precision", "recall", "f1")])
    return acc.join(F.broadcast(means))  # one row each


def majority_baseline(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent class of ``train`` (of equals the first by name) and its share in ``test``."""
    counts = train.groupBy(column).agg(F.count("*").alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(column).alias("clase")))["clase"].alias("clase"))
    return test.join(F.broadcast(best)).groupBy("clase").agg(F.avg(F.when(F.col(column) == F.col("clase"), 1.0).otherwise(0.0)).alias("exactitud"))


def expected_band(year: Column) -> Column:
    """Level a school year is expected to read at: the first three years the lowest, others above."""
    return F.when(year.between(1, 3), "primaria_baja").otherwise("primaria_alta")


def level_hits(df: DataFrame, year: str, score: str) -> DataFrame:
    """One row: books whose band agrees with their year, by the calibrated cuts and by the classic ones (on the rounded score), and the least score."""
    want = expected_band(F.col(year))

    def agrees(c: Column, cuts: tuple[float, float]) -> Column:
        low = c >= cuts[0]
        return F.when(want == "primaria_baja", low).otherwise(~low & (c >= cuts[1]))

    s = F.col(score)
    return df.agg(F.count("*").alias("libros"), F.count_if(agrees(s, CUTS)).alias("aciertos"), F.count_if(agrees(F.round(s, 2), CLASSIC_CUTS)).alias("aciertos_clasicos"), F.min(s).alias("minimo"))


def folds(df: DataFrame, id_col: str, class_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``pliegue`` 0..k-1: the rank of a hash of the id within the class, modulo k.

    Ranks are taken inside hash slices of a class and over the slices' sizes, so that no class is sorted in
    one task. Null classes are a class of their own.
    """
    slices = 64
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    ranked = df.withColumn("_h", h).withColumn("_s", F.pmod(F.shiftright("_h", 32), F.lit(slices))).withColumn("_r", F.row_number().over(Window.partitionBy(class_col, "_s").orderBy("_h", id_col)))
    before = Window.partitionBy("_class").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # at most 64 rows a class
    sizes = ranked.groupBy(F.col(class_col).alias("_class"), F.col("_s").alias("_slice")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_class", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    both = ranked.join(offsets, ranked[class_col].eqNullSafe(offsets["_class"]) & (ranked["_s"] == offsets["_slice"]))
    return both.select(*df.columns, F.pmod(F.col("_r") + F.col("_before") - 1, F.lit(k)).cast("int").alias("pliegue"))


def cross_validation(df: DataFrame, id_col: str, text_col: str, class_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """One row: pliegues, media and desviacion (of the population) of the accuracy of the classifier refitted without each fold.

    Labelled rows with text count, once for each id. There are at most as many folds as rows of the smallest
    class; if it has fewer than LEAST_ROWS, none (0 and nulls). ``router.fit_on`` on all rows gives the final model.
    """
    own = df.filter(F.col(class_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("texto"), F.col(class_col).alias("clase")).dropDuplicates(["id"])
    own = materialize(own, "labelled")
    least = own.groupBy("clase").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    k = min(k, least)
    if least < LEAST_ROWS:
        return df.sparkSession.createDataFrame([(0, None, None)], "pliegues int, media double, desviacion double")
    dealt = materialize(folds(own, "id", "clase", k, seed), "folds")

    def accuracy(i: int) -> DataFrame:
        model = router.fit_on(dealt.filter(F.col("pliegue") != i), "id", "texto", "clase")
        test = dealt.filter(F.col("pliegue") == i)
        said = router.predict(test, model, "id", "texto").select("id", "materia_explicada")
        return test.select("id", "clase").join(said, "id").agg(F.avg((F.col("clase") == F.col("materia_explicada")).cast("double")).alias("exactitud"))

    scores = reduce(DataFrame.unionByName, [accuracy(i) for i in range(k)])
    return scores.agg(F.count("*").cast("int").alias("pliegues"), F.avg("exactitud").alias("media"), F.stddev_pop("exactitud").alias("desviacion"))
