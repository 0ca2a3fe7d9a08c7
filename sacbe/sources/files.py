"""Sources and sinks: manifest files, texts, page lists, document bytes, metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sacbe.functions.text import page_list, strip

#: Limits of documents taken in (fixed values).
MOST_BYTES, MOST_PAGES = 150 * 1024 * 1024, 600
PAGES = "array<struct<pagina:int,texto:string,confianza:double>>"


def manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with header, as text columns; a byte-order mark before the header is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """archivo, texto: one row per file, trimmed; bytes that are no UTF-8 become replacement characters."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.input_file_name(), r"^.*/", "").alias("archivo"), strip(F.col("value")).alias("texto"))


def with_texts(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """Manifest rows with their text, null where the file is missing."""
    return manifest.join(texts, "archivo", "left")


def pages_json(df: DataFrame, column: str = "paginas", book: str = "libro") -> DataFrame:
    """libro, pagina, pos, texto, confianza from a JSON list of pages per row; malformed lists give no pages."""
    return df.select(F.col(book).alias("libro"), F.posexplode(F.from_json(F.col(column), PAGES)).alias("pos", "p")).select("libro", "p.pagina", "pos", "p.texto", "p.confianza")


def document_bytes(spark: SparkSession, path: str) -> DataFrame:
    """ruta, bytes, motivo: files with the reason they are refused, null if none. Empty files don't show: the source skips them."""
    b = spark.read.format("binaryFile").load(path)
    head = F.decode(F.substring("content", 1, 4), "ISO-8859-1")
    reason = F.when(F.col("length") > MOST_BYTES, "demasiado grande").when(head != "%PDF", "no es PDF")
    return b.select(F.col("path").alias("ruta"), F.col("length").alias("bytes"), reason.alias("motivo"))


def requested_pages(df: DataFrame, column: str, total: str) -> DataFrame:
    """``df`` with ``paginas`` asked for, and ``motivo`` if the list is malformed, too long or names pages that don't exist."""
    p = page_list(F.col(column))
    bad = F.when(p.isNull() | (F.size(p) == 0), "lista no valida").when(F.size(p) > MOST_PAGES, "demasiadas paginas").when((F.array_min(p) < 1) | (F.array_max(p) > F.col(total)), "pagina inexistente")
    return df.withColumn("paginas", p).withColumn("motivo", bad)


def recognise(pages: DataFrame, recogniser: Callable[[str, int], tuple[str, float]]) -> DataFrame:
    """doc, pagina, texto, confianza, error of each requested page by any recogniser (path, page) -> (text, confidence).

    Pages are spread over tasks one by one; a failing page gives its error and no text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, page in zip(b["doc"], b["pagina"]):
                try:
                    text, sure = recogniser(doc, int(page))
                    out.append((doc, int(page), text, float(sure), None))
                except Exception as e:  # noqa: BLE001 - any failure of a recogniser is a result
                    out.append((doc, int(page), None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["doc", "pagina", "texto", "confianza", "error"])

    return pages.select("doc", "pagina").repartition("doc", "pagina").mapInPandas(run, "doc string, pagina int, texto string, confianza double, error string")


def write_metrics(df: DataFrame, path: str) -> None:
    """A full snapshot of metrics as JSON lines, in place of the one before."""
    df.write.mode("overwrite").json(path)


#: Settings of recognition: default and least value (fixed values).
SETTINGS = {"dpi": (300, 72), "workers": (1, 1), "most_pages": (MOST_PAGES, 1), "most_megabytes": (MOST_BYTES // 1024**2, 1), "expires_s": (1800, 1)}


def recognition_settings(given: dict[str, str | int | None]) -> dict[str, int]:
    """Every setting of SETTINGS, as given or by default; an error names what is no whole number, too small or unknown."""
    if unknown := sorted(set(given) - set(SETTINGS)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = {}
    for name, (default, least) in SETTINGS.items():
        raw = str(given.get(name) if given.get(name) is not None else "").strip()
        try:
            value = int(raw) if raw else default
        except ValueError:
            raise ValueError(f"{name} must be a whole number, not {raw!r}") from None
        if value < least:
            raise ValueError(f"{name} must be at least {least}, not {value}")
        out[name] = value
    return out
