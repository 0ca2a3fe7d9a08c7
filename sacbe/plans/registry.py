"""Queries of the core by name, over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sacbe.functions import text as tx
from sacbe.functions.vocabulary import LEVEL_NAMES, SUBJECT_NAMES
from sacbe.operators import corpus, definitions, evaluation, jobs, materials, ocr, pages, ranking, readability, router, sentences, terms, timeline
from sacbe.plans.oracles import ORACLES  # noqa: F401
from sacbe.sources import files
from sacbe.storage import materialize, table
from sacbe.streaming import jobs as stream

#: Least confidence of scanned pages used for study materials.
CONFIDENCE = 0.6


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def book_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.book_pages(table(spark, d, "paginas"))


def book_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all pages of the books, written once for the steps that follow."""
    return materialize(sentences.sentences(book_pages(spark, d)), "sentences")


def study_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the pages that concepts, flashcards and quizzes are made of."""
    return materialize(sentences.sentences(pages.confident(book_pages(spark, d), CONFIDENCE)), "sentences")


def examples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ejemplos").dropDuplicates(["ejemplo_id"])


def raw_pieces(spark: SparkSession, d: str) -> DataFrame:
    return sentences.pieces(book_pages(spark, d))


def ocr_words(spark: SparkSession, d: str) -> DataFrame:
    """A word table made from recognised pages: a line is a line, five lines a paragraph, confidences from -1 to 100 by position."""
    p = table(spark, d, "paginas_reconocidas").select(F.col("reconocida_id").alias("doc"), F.col("numero").alias("pagina"), "texto").dropDuplicates(["doc"])
    lines = p.select("doc", "pagina", F.posexplode(F.split("texto", "\n")).alias("l", "linea"))
    w = lines.select("doc", "pagina", "l", F.posexplode(F.split("linea", " ")).alias("w", "text"))
    return w.select("doc", "pagina", (F.col("l") * 1000 + F.col("w")).alias("idx"), "text", (F.pmod(F.col("doc") * 31 + F.col("l") * 7 + F.col("w") * 17, F.lit(102)) - 1).cast("double").alias("conf"), F.lit(0).alias("block_num"), F.floor(F.col("l") / 5).cast("int").alias("par_num"), F.col("l").alias("line_num"))


def q_readability(s, d):
    return readability.readability(documents(s, d)).select("doc_id", "palabras", "oraciones", "silabas", "silabas_por_palabra", "palabras_por_oracion", F.round("puntuacion", 6).alias("puntuacion"), "nivel")


def q_level_band(s, d):
    r = readability.readability(documents(s, d))
    return r.select("doc_id", "nivel", readability.band(F.round("puntuacion", 2), readability.CLASSIC_CUTS).alias("nivel_clasico"))


def q_level_distribution(s, d):
    return readability.readability(documents(s, d)).groupBy("lang", "nivel").agg(F.count("*").alias("n"), F.sum("palabras").alias("palabras"))


def q_features(s, d, cols):
    own = readability.features(documents(s, d).select("doc_id", "text"))
    return own.select("doc_id", *[F.round(c, 9).alias(c) for c in cols])


def q_corpus(s, d):
    rows = corpus.manifest_rows(table(s, d, "manifiesto")).select("fila_id", "archivo", "materia")
    texts = examples(s, d).select("archivo", "texto").filter("archivo is not null").groupBy("archivo").agg(F.min("texto").alias("texto"))
    return corpus.with_verdict(rows.join(texts, "archivo", "left")).select("fila_id", "palabras", "motivo")


def q_piece_flags(s, d):
    p = raw_pieces(s, d)
    c = F.col("texto")
    return p.select("libro", "pagina", "pos", "trozo", sentences.study_words(c).alias("palabras"), tx.count(c, r"(?U)\d").alias("cifras"), sentences.is_legible(c).alias("legible"))


def q_predicates(s, d):
    c = F.col("texto")
    return book_sentences(s, d).select("libro", "orden", sentences.is_dialogue(c).alias("dialogo"), sentences.is_personal(c).alias("persona"), sentences.is_task(c).alias("actividad"), sentences.is_capitals(c).alias("mayusculas"), sentences.explains(c).alias("explica"))


def q_timeline(s, d):
    return timeline.timeline(timeline.first_events(timeline.events(book_sentences(s, d))), 3)


def labelled(s, d):
    """Levels stored against levels computed, as a classification to evaluate."""
    stored = table(s, d, "metricas_legibilidad").filter("nivel is not null").select("ejemplo_id", F.col("nivel").alias("real")).distinct()
    return readability.readability(examples(s, d).select("ejemplo_id", "texto"), "texto").select("ejemplo_id", F.col("nivel").alias("predicho")).join(stored, "ejemplo_id")


def school_years(s, d):
    """Manifest years (number at the front, primaria) with the computed score of the text."""
    own = examples(s, d).select("ejemplo_id", "archivo", "texto", F.regexp_extract("grado", r"^([1-6])[a-z]*_primaria$", 1).alias("y")).filter("y <> ''").filter(~F.coalesce(F.contains(F.col("archivo"), F.lit("material_manipulable")), F.lit(False)))
    return readability.readability(own, "texto").select(F.col("y").cast("int").alias("anio"), "puntuacion")


def stratified(s, d):
    return corpus.stratified_split(examples(s, d).select("ejemplo_id", "materia"), "ejemplo_id", "materia")


def routed(s, d, explain):
    x = examples(s, d)
    coded = x.filter(F.col("materia").isin(*SUBJECT_NAMES))
    model = router.fit_on(coded, "ejemplo_id", "texto", "materia")
    return router.predict(x, model, "ejemplo_id", "texto", explain)


def read_by_name(doc: str, page: int) -> tuple[str, float]:
    """A recogniser that knows a page by its name and can't read every seventh one."""
    if page % 7 == 0:
        raise ValueError("ilegible")
    return f"{doc}:{page}", 0.5


def q_recognised(s, d):
    asked = table(s, d, "paginas_reconocidas").filter("trabajo is not null and numero is not null").select(F.col("trabajo").alias("doc"), F.col("numero").alias("pagina")).distinct()
    return files.recognise(asked, read_by_name)


def q_requested(s, d):
    asked = F.concat(F.lit("["), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit(", "), F.pmod("doc_id", F.lit(3)).cast("string"), F.lit(",12"), F.when(F.pmod("doc_id", F.lit(5)) == 0, "x").otherwise("]"))
    return files.requested_pages(documents(s, d).select("doc_id", asked.alias("lista"), F.pmod("doc_id", F.lit(15)).alias("total")), "lista", "total").select("doc_id", "motivo")


def q_stream(s, d):
    """The job events run through as a stream, the closed windows written as they close."""
    events = stream.event_stream(s, f"{d}/eventos_ocr*.parquet", 1_000_000)
    return stream.run_to_table(stream.pages_per_window(events)).select(F.date_format("desde", "yyyy-MM-dd").alias("desde"), "hechas", "fallidas")


QUERIES = {
    "readability": q_readability,
    "level_band": q_level_band,
    "level_distribution": q_level_distribution,
    "features_density": lambda s, d: q_features(s, d, ["densidad_matematica", "densidad_digitos", "largo_promedio_palabra"]),
    "features_stopwords": lambda s, d: q_features(s, d, ["prop_stopwords_ingles", "prop_stopwords_espanol"]),
    "features_lexicon": lambda s, d: q_features(s, d, [c for c in readability.FEATURES if c.startswith("lexico_")]),
    "features_headings": lambda s, d: q_features(s, d, ["encabezados_por_1000_palabras"]),
    "msttr": lambda s, d: q_features(s, d, ["riqueza_lexica"]),
    "min_chars_gate": lambda s, d: corpus.long_enough(documents(s, d)).select("doc_id"),
    "fold_text": lambda s, d: documents(s, d).select("doc_id", F.md5(tx.fold(tx.text("text"))).alias("huella")),
    "corpus_accept_reject": q_corpus,
    "class_counts": lambda s, d: corpus.class_counts(examples(s, d)),
    "label_names": lambda s, d: examples(s, d).select("ejemplo_id", F.coalesce(*[F.when(F.col("materia") == k, v) for k, v in SUBJECT_NAMES.items()]).alias("nombre")),
    "level_names": lambda s, d: table(s, d, "metricas_legibilidad").select("ejemplo_id", F.coalesce(*[F.when(F.col("nivel") == k, v) for k, v in LEVEL_NAMES.items()]).alias("nombre")).distinct(),
    "confidence_filter": lambda s, d: pages.excluded_pages(book_pages(s, d), CONFIDENCE),
    "low_text_books": lambda s, d: ocr.low_text_books(book_pages(s, d)),
    "page_list_parse": lambda s, d: documents(s, d).select("doc_id", F.array_join(F.transform(tx.page_list(F.concat(F.lit("["), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit(", "), F.pmod("doc_id", F.lit(3)).cast("string"), F.lit(",12"), F.when(F.pmod("doc_id", F.lit(5)) == 0, "x").otherwise("]"))), lambda x: x.cast("string")), ",").alias("paginas")),
    "repeated_header": lambda s, d: pages.repeated_border(book_pages(s, d)),
    "without_headers": lambda s, d: pages.without_headers(book_pages(s, d)).select("libro", "pagina", "pos", F.length("texto").alias("largo")),
    "sentence_split": lambda s, d: raw_pieces(s, d).select("libro", "pagina", "pos", "trozo", "texto"),
    "sentence_filters": q_piece_flags,
    "sentence_dedup": lambda s, d: sentences.sentences(book_pages(s, d), headers=False),
    "sentences": book_sentences,
    "sentence_predicates": q_predicates,
    "ngram_freq": lambda s, d: terms.ngram_counts(terms.ngrams(book_sentences(s, d))),
    "modal_form": lambda s, d: terms.modal_forms(terms.ngrams(book_sentences(s, d))),
    "candidate_rank": lambda s, d: terms.ranked_candidates(terms.ngram_counts(terms.ngrams(book_sentences(s, d)))),
    "overlap_removal": lambda s, d: terms.without_overlaps(terms.ranked_candidates(terms.ngram_counts(terms.ngrams(book_sentences(s, d))))),
    "tfidf_weights": lambda s, d: terms.tfidf(book_sentences(s, d)).select("libro", "orden", "termino", F.round("peso", 6).alias("peso")),
    "sentence_similarity": lambda s, d: terms.similar_sentences(materialize(terms.tfidf(book_sentences(s, d)), "weights")).select("libro", "a", "b", F.round("similitud", 6).alias("similitud")),
    "term_coverage": lambda s, d: (lambda x: materials.term_coverage(x, materials.concepts(x)[0]))(study_sentences(s, d)),
    "concepts": lambda s, d: materials.concepts(study_sentences(s, d))[0].select("libro", "puesto", "clave", "termino", "es_definicion", "veces"),
    "definition_match": lambda s, d: definitions.definitions(book_sentences(s, d)),
    "first_definition": lambda s, d: (lambda x: definitions.first_definitions(definitions.definitions(x), terms.without_overlaps(terms.ranked_candidates(terms.ngram_counts(terms.ngrams(x))))))(book_sentences(s, d)),
    "timeline_dates": lambda s, d: timeline.events(book_sentences(s, d)),
    "timeline_first": lambda s, d: timeline.first_events(timeline.events(book_sentences(s, d))),
    "timeline_even_sample": q_timeline,
    "roman_numeral": lambda s, d: documents(s, d).select("doc_id", tx.roman(F.element_at(F.array(*[F.lit(x) for x in ("I", "IV", "ix", "XL", "XLIX", "LXXX", "XC", "C", "Q", "", "XIX")]), (F.pmod("doc_id", F.lit(11)) + 1).cast("int"))).alias("valor")),
    "ocr_lines": lambda s, d: ocr.rebuild_pages(ocr_words(s, d)).select("doc", "pagina", F.md5("texto").alias("huella")),
    "ocr_confidence": lambda s, d: ocr.page_confidence(ocr_words(s, d)).select("doc", "pagina", F.round("confianza", 6).alias("confianza")),
    "ocr_clean": lambda s, d: table(s, d, "paginas_reconocidas").select("reconocida_id", F.md5(tx.clean_recognised(tx.text("texto"))).alias("huella")).distinct(),
    "hyphen_join": lambda s, d: table(s, d, "paginas_reconocidas").select("reconocida_id", F.md5(tx.join_hyphens(tx.text("texto"))).alias("huella")).distinct(),
    "extracted_text": lambda s, d: table(s, d, "paginas_reconocidas").select("reconocida_id", F.length(tx.normalize_extracted(tx.text("texto"))).alias("largo")).distinct(),
    "cer_pages": lambda s, d: ocr.error_rates(table(s, d, "evaluacion_ocr")).select("pagina", "caracteres", "errores", F.round("cer", 9).alias("cer")),
    "cer_order_free": lambda s, d: ocr.error_rates(table(s, d, "evaluacion_ocr")).select("pagina", "errores_sin_orden"),
    "cer_summary": lambda s, d: ocr.error_summary(ocr.error_rates(table(s, d, "evaluacion_ocr"))).select("paginas", *[F.round(c, 9).alias(c) for c in ("cer_global", "cer_sin_orden", "cer_mediana", "confianza_media", "segundos_por_pagina")]),
    "confusion_matrix": lambda s, d: evaluation.confusion(labelled(s, d), "real", "predicho"),
    "class_report": lambda s, d: evaluation.class_report(evaluation.confusion(labelled(s, d), "real", "predicho")).select("clase", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "soporte"),
    "overall_report": lambda s, d: (lambda r: r.select(*[F.round(c, 9).alias(c) for c in r.columns]))(evaluation.overall(evaluation.confusion(labelled(s, d), "real", "predicho"))),
    "majority_baseline": lambda s, d: (lambda x: evaluation.majority_baseline(x.filter("parte = 'entrenamiento' and materia is not null"), x.filter("parte = 'prueba' and materia is not null"), "materia").select("clase", F.round("exactitud", 9).alias("exactitud")))(stratified(s, d)),
    "stratified_split": lambda s, d: stratified(s, d).select("ejemplo_id", "parte"),
    "level_accuracy": lambda s, d: evaluation.level_hits(school_years(s, d), "anio", "puntuacion").select("libros", "aciertos", "aciertos_clasicos", F.round("minimo", 6).alias("minimo")),
    "job_status": lambda s, d: jobs.job_status(table(s, d, "eventos_ocr")).select("trabajo", "estado", "hechas", "total", "tardias", "error"),
    "job_pages": lambda s, d: jobs.ordered_pages(table(s, d, "eventos_ocr"), jobs.job_status(table(s, d, "eventos_ocr"))),
    "job_purge": lambda s, d: jobs.expired(jobs.job_status(table(s, d, "eventos_ocr")), "2025-01-01 00:00:00").select("trabajo", "estado"),
    "pages_json": lambda s, d: files.pages_json(book_pages(s, d).select("libro", F.to_json(F.array(F.struct("pagina", "texto", "confianza"))).alias("paginas"))).select("libro", "pagina", "pos", F.length("texto").alias("largo"), F.round("confianza", 9).alias("confianza")),
    "requested_pages": q_requested,
    "recogniser_hook": q_recognised,
    "stream_windows": q_stream,
    # without SQL: iterative, greedy or learned
    "textrank": lambda s, d: ranking.sentence_scores(book_sentences(s, d)).select("libro", "orden", F.round("puntos", 9).alias("puntos")),
    "mmr_summary": lambda s, d: materials.summary(book_sentences(s, d)),
    "glossary": lambda s, d: materials.glossary(study_sentences(s, d)),
    "flashcards": lambda s, d: materials.flashcards(study_sentences(s, d)),
    "quiz": lambda s, d: materials.quiz(study_sentences(s, d), pages.confident(book_pages(s, d), CONFIDENCE)),
    "router_predict": lambda s, d: routed(s, d, False).select("id", "materia", "materia_explicada", "confianza", "baja_confianza"),
    "router_explain": lambda s, d: routed(s, d, True).select("id", "materia_explicada", F.explode("explicacion").alias("e")).select("id", "materia_explicada", "e.feature", "e.contribucion", "e.valor"),
}
