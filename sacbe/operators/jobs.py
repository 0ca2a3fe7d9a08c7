"""State of recognition jobs from their events; the same aggregation serves batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPIRES_AFTER_S = 1800


def job_marks(events: DataFrame) -> DataFrame:
    """First time of each kind of event per job, by associative aggregates only."""
    def at(kind: str):
        return F.min(F.when(F.col("evento") == kind, F.col("ts")))

    return events.groupBy("trabajo").agg(at("created").alias("creado"), at("started").alias("iniciado"), at("cancelled").alias("cancelado"), at("page_failed").alias("fallo"), F.max("ts").alias("ultimo"))


def job_status(events: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """trabajo, estado, hechas, total, tardias, error, creado, terminado of each job, repeats once.

    A job is ``listo`` when as many pages are done as it has; a failed page or a cancellation before that ends
    it with ``error`` (at the same moment they come first); results after the end are late and don't count.
    Otherwise it is ``procesando`` once it has started or has a page, else ``pendiente``. ``totals``: trabajo,
    total of the pages asked for; without it a job has the pages that its events name.
    ``error``: ``cancelado``, or ``pagina N`` for the first that failed.
    Pages are counted per (job, page) first, so a job that holds many events isn't gathered in one task.
    """
    own = events.select("trabajo", "pagina", "evento", "ts").filter("trabajo is not null and evento is not null").distinct()
    failed = F.min(F.when(F.col("evento") == "page_failed", F.struct("ts", "pagina")))
    marks = job_marks(own).join(own.groupBy("trabajo").agg(failed["pagina"].alias("fallida")), "trabajo")
    pages = own.filter("pagina is not null").groupBy("trabajo", "pagina").agg(F.min(F.when(F.col("evento") == "page_done", F.col("ts"))).alias("hecha"))
    reached = pages.groupBy("trabajo").agg(F.count("*").alias("total"), F.count("hecha").alias("vistas"), F.max("hecha").alias("ultima"))
    if totals is not None:
        reached = reached.drop("total").join(totals.select("trabajo", "total"), "trabajo", "full")
    full = F.when((F.col("vistas") > 0) & (F.col("vistas") >= F.col("total")), F.col("ultima")).when(F.col("total") == 0, F.col("creado"))
    ends = marks.join(reached, "trabajo", "left").withColumn("completo", full).withColumn("terminado", F.least("cancelado", "fallo", "completo"))
    counted = pages.filter("hecha is not null").join(ends.select("trabajo", "terminado"), "trabajo").groupBy("trabajo").agg(
        F.count_if(F.col("terminado").isNull() | (F.col("hecha") <= F.col("terminado"))).alias("hechas"),
        F.count_if(F.col("hecha") > F.col("terminado")).alias("tardias"),
    )
    done, over = F.coalesce("hechas", F.lit(0)), F.col("terminado").isNotNull()
    error = F.when(F.col("fallo") == F.col("terminado"), F.concat_ws(" ", F.lit("pagina"), F.col("fallida").cast("string"))).when(F.col("cancelado") == F.col("terminado"), "cancelado")
    state = F.when(error.isNotNull(), "error").when(over, "listo").when(F.col("iniciado").isNotNull() | (done > 0), "procesando").otherwise("pendiente")
    return ends.join(counted, "trabajo", "left").select("trabajo", state.alias("estado"), done.alias("hechas"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("tardias", F.lit(0)).alias("tardias"), error.alias("error"), "creado", "terminado")


def expired(status: DataFrame, now: str) -> DataFrame:
    """Jobs that ended more than EXPIRES_AFTER_S seconds before ``now``."""
    return status.filter(F.col("terminado").isNotNull() & (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("terminado") > EXPIRES_AFTER_S * 1_000_000)).select("trabajo", "estado", "terminado")


def ordered_pages(events: DataFrame, status: DataFrame) -> DataFrame:
    """trabajo, paginas: the pages of each finished job (``listo``) in ascending order."""
    over = status.filter("estado = 'listo'").select("trabajo", "terminado")
    done = events.filter("evento = 'page_done' and pagina is not null").select("trabajo", "pagina", "ts").join(over, "trabajo").filter("ts <= terminado").select("trabajo", "pagina").distinct()
    return done.groupBy("trabajo").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pagina")), lambda x: x.cast("string")), ",").alias("paginas"))
