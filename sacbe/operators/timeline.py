"""Dates in sentences and the timeline of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sacbe.functions.text import roman

MOST_EVENTS, MOST_DATES = 14, 2
# How dates are written.
BEFORE_CHRIST = r"(?iu)(?<![\p{L}\p{N}_])(\d{1,4})\s*a\.?\s*(?:de\s*)?C(?![\p{L}\p{N}_])"
YEAR = r"(?<![\d.,])(1\d{3}|20\d{2})(?![\d.,])"
CENTURY = r"(?iu)(?<![\p{L}\p{N}_])siglos?\s+([IVXLC]{1,6})(?![\p{L}\p{N}_])"


def dates(c: Column) -> Column:
    """array of struct(valor, fecha): years before Christ, years 1000 to 2099 set apart from points and commas, middles of centuries."""
    bc = F.transform(F.regexp_extract_all(c, F.lit(BEFORE_CHRIST), F.lit(1)), lambda x: F.struct((-x.cast("int")).alias("valor"), F.concat(x, F.lit(" a. C.")).alias("fecha")))
    years = F.transform(F.regexp_extract_all(c, F.lit(YEAR), F.lit(1)), lambda x: F.struct(x.cast("int").alias("valor"), x.alias("fecha")))
    cent = F.transform(F.regexp_extract_all(c, F.lit(CENTURY), F.lit(1)), lambda x: F.struct(((roman(x) - 1) * 100 + 50).cast("int").alias("valor"), F.concat(F.lit("Siglo "), F.upper(x)).alias("fecha")))
    return F.concat(bc, years, F.filter(cent, lambda x: x["valor"].isNotNull()))


def events(sentences: DataFrame) -> DataFrame:
    """libro, orden, pagina, texto, valor, fecha: the earliest date of each sentence with one or two different dates."""
    d = sentences.select("libro", "orden", "pagina", "texto", F.explode(F.array(dates(F.col("texto")))).alias("_d"))  # so the patterns run once
    n = F.size(F.array_distinct(F.transform("_d", lambda x: x["valor"])))
    first = F.array_min(F.col("_d"))
    return d.filter(n.between(1, MOST_DATES)).select("libro", "orden", "pagina", "texto", first["valor"].alias("valor"), first["fecha"].alias("fecha"))


def first_events(found: DataFrame) -> DataFrame:
    """One event per date: the first sentence of the book that gives it."""
    return found.groupBy("libro", "valor").agg(F.min(F.struct("orden", "pagina", "fecha", "texto")).alias("m")).select("libro", "valor", "m.fecha", "m.texto", "m.pagina")


def timeline(first: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """libro, puesto, fecha, valor, texto, pagina in order of time; if there are more than ``most``, spread evenly over all."""
    w = Window.partitionBy("libro").orderBy("valor", "pagina")
    row = first.withColumn("_i", F.row_number().over(w) - 1).join(first.groupBy("libro").agg(F.count("*").alias("_n")), "libro")
    if most <= 1:
        picked = row.filter(F.col("_i") < most).withColumn("puesto", F.col("_i") + 1)
    else:
        step = (F.col("_n") - 1) / F.lit(most - 1)
        places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * step).cast("int"))
        at = F.array_position(places, F.col("_i").cast("int"))
        picked = row.withColumn("puesto", F.when(F.col("_n") <= most, F.col("_i") + 1).otherwise(at)).filter("puesto > 0")
    return picked.select("libro", F.col("puesto").cast("int").alias("puesto"), "fecha", "valor", "texto", "pagina")
