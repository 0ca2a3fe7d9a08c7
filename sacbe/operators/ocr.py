"""Recognised pages: words to lines and paragraphs, confidence, error rates against printed text, low-text pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sacbe.functions.text import squeeze, strip, text, tokens

FEW_WORDS, SCANNED = 20, 0.5


def rebuild_pages(words: DataFrame) -> DataFrame:
    """doc, pagina, texto, confianza from a word table (doc, pagina, idx, text, conf, block_num, par_num, line_num).

    Words of a line are joined by blanks, lines by line breaks, paragraphs by blank lines, in the order they
    first appear. Blank words don't count; a confidence below 0 marks no word; pages without any have 0.
    """
    own = words.withColumn("text", strip(text("text"))).filter("text <> ''")
    lines = own.groupBy("doc", "pagina", "block_num", "par_num", "line_num").agg(F.min("idx").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("linea"))
    page = Window.partitionBy("doc", "pagina").orderBy("at")
    new = (F.lag("block_num").over(page) != F.col("block_num")) | (F.lag("par_num").over(page) != F.col("par_num"))
    lead = F.when(F.row_number().over(page) == 1, "").when(new, "\n\n").otherwise("\n")
    joined = lines.withColumn("linea", F.concat(lead, F.col("linea"))).groupBy("doc", "pagina").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "linea"))), lambda x: x["linea"]), "").alias("texto"))
    return joined.join(page_confidence(own), ["doc", "pagina"])


def page_confidence(words: DataFrame) -> DataFrame:
    """doc, pagina, confianza (0..1, not rounded) of pages with at least one non-blank word."""
    own = words.filter(strip(text("text")) != "")
    return own.groupBy("doc", "pagina").agg(F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100, F.lit(0.0)).alias("confianza"))


def compare_text(c: Column) -> Column:
    """What error rates compare: blanks collapsed."""
    return squeeze(c)


def without_order(c: Column) -> Column:
    """Words in sorted order, so that the order of columns doesn't count."""
    return F.array_join(F.array_sort(tokens(c)), " ")


def error_rates(df: DataFrame, reference: str = "referencia", got: str = "obtenido", prepare=compare_text) -> DataFrame:
    """``df`` with errores, caracteres, cer and cer_sin_orden per page; pages without a reference get nulls."""
    a, b = prepare(text(reference)), prepare(text(got))
    n = F.length(a)
    some = n > 0
    wrong, loose = F.levenshtein(a, b), F.levenshtein(without_order(a), without_order(b))
    return df.withColumn("caracteres", n).withColumn("errores", F.when(some, wrong)).withColumn("errores_sin_orden", F.when(some, loose)).withColumn("cer", F.when(some, wrong / n)).withColumn("cer_sin_orden", F.when(some, loose / n))


def error_summary(rated: DataFrame) -> DataFrame:
    """One row: global error rates weighed by characters, exact median of pages, mean confidence and seconds of all pages."""
    return rated.agg(
        F.count("*").alias("paginas"),
        (F.sum("errores") / F.sum(F.when(F.col("cer").isNotNull(), F.col("caracteres")))).alias("cer_global"),
        (F.sum("errores_sin_orden") / F.sum(F.when(F.col("cer").isNotNull(), F.col("caracteres")))).alias("cer_sin_orden"),
        F.expr("percentile(cer, 0.5)").alias("cer_mediana"),
        F.avg("confianza").alias("confianza_media"),
        F.avg("segundos").alias("segundos_por_pagina"),
    )


def low_text_books(pages: DataFrame) -> DataFrame:
    """libro, paginas, casi_vacias, escaneado: books most of whose pages have fewer than FEW_WORDS words look scanned."""
    few = F.size(tokens(text("texto"))) < FEW_WORDS
    return pages.groupBy("libro").agg(F.count("*").alias("paginas"), F.count_if(few).alias("casi_vacias"), (F.count_if(few) > F.count("*") * SCANNED).alias("escaneado"))
