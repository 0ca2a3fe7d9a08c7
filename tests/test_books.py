import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sacbe.operators import corpus, evaluation, jobs, materials, ocr, pages, ranking, router, sentences, terms

PAGE = "libro bigint, pagina int, pos int, texto string, confianza double"
BODY = "La ciudad antigua creció junto al río durante muchos siglos y sus vecinos {} levantaron murallas, plazas, templos y mercados donde vendían telas, granos y vasijas de barro a los viajeros."


def book(n=6, head="Guía de Historia Universal"):
    words = "sabios fuertes lentos grandes nobles pobres ricos altos".split()
    return [(1, k + 1, 0, f"{k + 1} {head}\n{BODY.format(words[k])}", None) for k in range(n)]


def test_headers_go_with_their_folios(spark):
    df = spark.createDataFrame(book() + [(2, 1, 0, "corto", None), (3, 1, 0, None, None)], PAGE)
    assert [(r["libro"], r["frase"], r["veces"]) for r in pages.repeated_border(df).collect()] == [(1, "guia de historia universal la ciudad antigua crecio", 6)]  # the first quarter of a page, folio left out
    varied = [(1, k + 1, 0, f"{k + 1} Guía de Historia Universal\n{w} {BODY.format(w)}", None) for k, w in enumerate("Sabios Fuertes Lentos Grandes".split())]
    df = spark.createDataFrame(varied, PAGE)
    assert pages.repeated_border(df).collect()[0]["frase"] == "guia de historia universal"
    first = pages.without_headers(df).orderBy("pagina").first()["texto"]
    assert first.startswith("Sabios La ciudad")


def test_pages_outside_their_range_are_left_out(spark):
    df = spark.createDataFrame([(1, 0, 0, "a", None), (1, 1, 0, "a", 2.0), (None, 1, 0, "a", None), (1, 2, 0, "a", 0.5), (1, 2, 0, "a", 0.5)], PAGE)
    assert pages.book_pages(df).count() == 1
    assert pages.confident(pages.book_pages(df), 0.6).count() == 0


def test_sentences_are_numbered_without_gaps_and_once(spark):
    t = "El perro grande corre por la calle. La luna ilumina todo el valle verde.\nEL PERRO grande corre por la calle. Corto."
    df = spark.createDataFrame([(1, 2, 0, t, None), (1, 1, 0, "La luna ilumina todo el valle verde. Nada más que agua y sal en casa.", None), (2, 1, 0, "", None)], PAGE)
    got = [(r["orden"], r["pagina"], r["texto"]) for r in sentences.sentences(df).orderBy("libro", "orden").collect()]
    assert got == [(0, 1, "La luna ilumina todo el valle verde."), (1, 1, "Nada más que agua y sal en casa."), (2, 2, "El perro grande corre por la calle.")]


def test_empty_tables(spark):
    df = spark.createDataFrame([], PAGE)
    s = sentences.sentences(df)
    assert s.count() == 0 and terms.tfidf(s).count() == 0 and materials.glossary(s).count() == 0 and materials.summary(s).count() == 0


def test_textrank_matrix_equals_joins(spark):
    texts = ["El agua del río corre limpia", "El agua del mar es salada siempre", "El río cruza la ciudad vieja", "Nada parecido queda fuera", "La ciudad vieja mira el mar"]
    s = spark.createDataFrame([(1, k, 1, t) for k, t in enumerate(texts)], "libro bigint, orden int, pagina int, texto string")
    v = ranking.vectors(texts)
    want = ranking.textrank(v @ v.T, 6)
    got = [r["puntos"] for r in ranking.textrank_by_joins(s, 6).orderBy("orden").collect()]
    assert np.allclose(got, want, atol=1e-9) and abs(want.sum() - 1) < 1e-9


def test_mmr_prefers_new_ideas():
    sim = np.array([[1, 0.95, 0.1], [0.95, 1, 0.1], [0.1, 0.1, 1]])
    assert ranking.mmr(sim, np.array([1.0, 0.9, 0.7]), 2) == [0, 2]
    assert ranking.mmr(sim[:0, :0], np.zeros(0), 3) == []


def test_long_books_are_summarised_from_all_sentences(spark, monkeypatch):
    words = "agua río mar ciudad viento piedra fuego árbol nube camino".split()
    texts = [f"La historia de {words[k % 10]} y {words[k * 3 % 7]} cuenta {words[k * k % 9]} con {words[(k + 4) % 10]} número {'abcdefghij'[k % 10] * 4} siempre" for k in range(30)]
    s = spark.createDataFrame([(b, k, 1, t + " otra vez" * (b - 1)) for b in (1, 2) for k, t in enumerate(texts[: 30 - 24 * (b - 1)])], "libro bigint, orden int, pagina int, texto string")
    want = sorted(map(tuple, materials.summary(s, 5).collect()))
    monkeypatch.setattr(materials, "MATRIX_SENTENCES", 6)  # the second book still goes by a matrix
    assert sorted(map(tuple, materials.summary(s, 5).collect())) == want and len(want) == 10


def test_overlaps_and_ties(spark):
    counts = spark.createDataFrame([(1, "sistema solar", 4), (1, "sistema", 5), (1, "sol", 5), (1, "luna", 5)], "libro bigint, clave string, veces int")
    ranked = terms.ranked_candidates(counts)
    assert [r["clave"] for r in ranked.orderBy("puesto").collect()] == ["sistema solar", "sol", "sistema", "luna"]
    assert [r["clave"] for r in terms.without_overlaps(ranked).orderBy("puesto").collect()] == ["sistema solar", "luna"]


def story():
    subjects = ["volcán", "glaciar", "desierto", "océano", "pantano", "bosque"]
    out = []
    for k, w in enumerate(subjects):
        out += [f"El {w} cubre una región extensa del continente cercano.", f"Muchas especies habitan el {w} durante el verano entero.", f"Los científicos estudian el {w} con instrumentos modernos cada año."]
    return out


def test_materials_of_a_small_book(spark):
    text = [" ".join(story()[k : k + 3]) for k in range(0, 18, 3)]
    df = spark.createDataFrame([(7, k + 1, 0, t, None) for k, t in enumerate(text)], PAGE)
    s = sentences.sentences(df, headers=False).cache()
    cards = materials.flashcards(s, 6).orderBy("puesto").collect()
    assert len(cards) == 6 and {c["tipo"] for c in cards} <= {"definicion", "contexto", "cloze"}
    assert all("_____" in c["pregunta"] for c in cards if c["tipo"] == "cloze")
    questions = materials.quiz(s, df, 3).collect()
    assert questions
    for q in questions:
        assert len(q["opciones"]) == len(set(q["opciones"])) == 4 and 0 <= q["correcta"] < 4
    points = materials.summary(s, 3).orderBy("puesto").collect()
    assert len(points) == 3 and [p["orden"] for p in points] == sorted(p["orden"] for p in points)


def test_quiz_asks_contexts_only_beside_definitions(spark, monkeypatch):
    text = [" ".join(story()[k : k + 3]) for k in range(0, 18, 3)]
    defines = "La fotosíntesis se define como el proceso por el cual las plantas fabrican su propio alimento."
    df = spark.createDataFrame([(b, k + 1, 0, t + f" {defines}" * (b == 8 and k == 2), None) for b in (7, 8) for k, t in enumerate(text)], PAGE)
    s = sentences.sentences(df, headers=False).cache()
    asked, real = [], materials.with_contexts

    def noted(got, uses, *more):
        asked.append({r["libro"] for r in uses.select("libro").distinct().collect()})
        return real(got, uses, *more)

    monkeypatch.setattr(materials, "with_contexts", noted)
    questions = materials.quiz(s, df, 3).collect()
    assert asked == [{8}]
    assert {q["libro"] for q in questions} == {7, 8}
    q = next(q for q in questions if q["pregunta"] == "¿Cuál de estas afirmaciones describe «fotosíntesis»?")
    assert (q["libro"], q["pagina"], q["opciones"][q["correcta"]]) == (8, 3, defines.replace("fotosíntesis", "_____"))
    assert len(set(q["opciones"])) == 4 and all(o for o in q["opciones"])


def test_terms_meet_sentences_beside_them_or_by_first_words(spark, monkeypatch):
    s = spark.createDataFrame([(1, 0, 1, "El río Lempa cruza El Salvador."), (1, 1, 1, "Los ríos no son el río, dijo."), (2, 0, 1, "La (luna) llena brilla."), (3, 0, 1, "Nada.")], "libro bigint, orden int, pagina int, texto string")
    t = spark.createDataFrame([(1, "río", 1), (1, "el río", 2), (1, "Salvador", 3), (1, "salva", 4), (1, "—", 5), (2, "(luna)", 1), (4, "nada", 1)], "libro bigint, termino string, puesto int")
    want = [(1, 0, "Salvador"), (1, 0, "el río"), (1, 0, "río"), (1, 1, "el río"), (1, 1, "río"), (2, 0, "(luna)")]
    for most in (300, 1, 0):
        monkeypatch.setattr(terms, "PAIRED", most)
        assert sorted((r["libro"], r["orden"], r["termino"]) for r in terms.sentences_with(s, t).collect()) == want


def test_options_are_shuffled_the_same_way():
    assert materials.assemble("¿x?", "a", ["b", "A ", "c", "d"]) == materials.assemble("¿x?", "a", ["b", "c", "d"])
    assert materials.assemble("¿x?", "a", ["A", " a", "b"]) is None


def test_rebuilt_page(spark):
    rows = [(1, 1, 0, "Hola", 90.0, 0, 0, 0), (1, 1, 1, "mundo", 80.0, 0, 0, 0), (1, 1, 2, " ", -1.0, 0, 0, 1), (1, 1, 3, "otra", -1.0, 0, 0, 1), (1, 1, 4, "fin", 70.0, 0, 1, 0)]
    df = spark.createDataFrame(rows, "doc bigint, pagina int, idx int, text string, conf double, block_num int, par_num int, line_num int")
    r = ocr.rebuild_pages(df).first()
    assert r["texto"] == "Hola mundo\notra\n\nfin" and abs(r["confianza"] - 0.8) < 1e-9


def test_error_rates_leave_pages_without_reference_out(spark):
    df = spark.createDataFrame([(1, "hola mundo", "mundo hola", 0.5, 1.0), (2, None, "x", 0.7, 3.0)], "pagina int, referencia string, obtenido string, confianza double, segundos double")
    got = ocr.error_summary(ocr.error_rates(df)).first()
    assert got["paginas"] == 2 and got["cer_sin_orden"] == 0 and got["cer_global"] > 0 and got["segundos_por_pagina"] == 2


def test_report_of_known_counts(spark):
    m = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "b", 2), ("c", "a", 1)], "real string, predicho string, n int")
    r = {x["clase"]: x for x in evaluation.class_report(m).collect()}
    assert r["a"]["precision"] == 0.75 and r["a"]["recall"] == 0.75 and r["c"]["f1"] == 0 and r["c"]["soporte"] == 1
    assert abs(evaluation.overall(m).first()["exactitud"] - 5 / 7) < 1e-9


def test_split_is_stratified_and_whole(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(100)], "id int, c string")
    got = corpus.stratified_split(df, "id", "c").groupBy("c", "parte").count().collect()
    assert sum(r["count"] for r in got) == 100
    assert {r["c"]: r["count"] for r in got if r["parte"] == "prueba"} == {None: 5, "a": 10, "b": 10}


def test_rejects_have_reasons(spark):
    long = "palabra " * 130
    df = spark.createDataFrame([("matematicas", long), ("magia", long), ("otro", None), ("otro", "poco"), (None, long)], "materia string, texto string")
    assert [r["motivo"] for r in corpus.with_verdict(df).collect()] == [None, "materia desconocida", "falta el texto", "texto corto", "materia desconocida"]


def events(spark):
    t = "2024-01-01 00:00:{:02d}"
    rows = [(1, "a", None, "created", t.format(0)), (2, "a", 1, "page_done", t.format(1)), (2, "a", 1, "page_done", t.format(1)), (3, "a", 2, "page_failed", t.format(2)), (4, "a", 3, "page_done", t.format(3)), (5, "b", None, "created", t.format(0)), (6, "c", None, "started", t.format(0)), (7, "c", None, "cancelled", t.format(5)), (8, None, 1, "page_done", t.format(1))]
    return spark.createDataFrame(rows, "evento_id bigint, trabajo string, pagina int, evento string, ts string").withColumn("ts", F.to_timestamp("ts"))


def test_job_states(spark):
    got = {r["trabajo"]: (r["estado"], r["hechas"], r["tardias"]) for r in jobs.job_status(events(spark)).collect()}
    assert got == {"a": ("error", 1, 1), "b": ("pendiente", 0, 0), "c": ("error", 0, 0)}


def test_finished_jobs(spark):
    t = "2024-01-01 00:00:{:02d}"
    rows = [(1, "d", None, "created", t.format(0)), (2, "d", 3, "page_done", t.format(1)), (3, "d", 2, "page_done", t.format(2)), (4, "d", None, "cancelled", t.format(9)), (5, "e", 1, "page_done", t.format(1)), (6, "e", 2, "page_failed", t.format(1)), (7, "f", None, "started", t.format(1)), (8, "g", None, "created", t.format(1))]
    own = spark.createDataFrame(rows, "evento_id bigint, trabajo string, pagina int, evento string, ts string").withColumn("ts", F.to_timestamp("ts"))
    status = jobs.job_status(own)
    got = {r["trabajo"]: (r["estado"], r["hechas"], r["total"], r["error"]) for r in status.collect()}
    assert got == {"d": ("listo", 2, 2, None), "e": ("error", 1, 2, "pagina 2"), "f": ("procesando", 0, 0, None), "g": ("pendiente", 0, 0, None)}
    assert [tuple(r) for r in jobs.ordered_pages(own, status).collect()] == [("d", "2,3")]
    asked = spark.createDataFrame([("d", 3), ("g", 0), ("e", 2), ("f", 1)], "trabajo string, total bigint")
    got = {r["trabajo"]: (r["estado"], r["error"]) for r in jobs.job_status(own, asked).collect()}
    assert got == {"d": ("error", "cancelado"), "e": ("error", "pagina 2"), "f": ("procesando", None), "g": ("listo", None)}


def test_stream_gives_the_marks_of_the_batch(spark, tmp_path):
    from sacbe.streaming import jobs as stream

    own = events(spark).filter("trabajo is not null").withColumn("recibido_ts", F.col("ts"))
    own.repartition(3).write.parquet(str(tmp_path / "in"))
    got = stream.run_to_end(stream.running_marks(stream.event_stream(spark, str(tmp_path / "in"))), "marks", "complete", str(tmp_path / "c1"))
    want = jobs.job_marks(own.distinct())
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    late = stream.run_to_end(stream.pages_per_window(stream.event_stream(spark, str(tmp_path / "in"))), "windows", "append", str(tmp_path / "c2"))
    assert late.columns == ["desde", "hechas", "fallidas"]


def test_router_learns_and_comes_back_from_disk(spark, tmp_path):
    a, b = "suma resta número fracción decimal", "planta célula animal agua energía"
    rows = [(i, f"{(a if i % 2 else b)} texto {i % 7} ejemplo del libro", "matematicas" if i % 2 else "ciencias_naturales") for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, texto string, materia string")
    m = router.fit_on(df, "id", "texto", "materia")
    m.save(str(tmp_path / "m.npz"))
    m = router.Router.load(str(tmp_path / "m.npz"))
    got = router.predict(df.union(spark.createDataFrame([(99, None, None)], df.schema)), m, "id", "texto", explain=True)
    right = got.join(df.select("id", F.col("materia").alias("real")), "id").filter("materia = real").count()
    assert right == 40 and got.filter("id = 99").count() == 1
    assert got.filter("id = 1").first()["explicacion"][0]["contribucion"] > 0
    with pytest.raises(ValueError):
        router.fit(["a b"], ["x"], np.zeros((1, 14)))


def test_folds_hold_every_class(spark):
    df = spark.createDataFrame([(i, None if i < 5 else "a" if i < 10 else "b") for i in range(33)], "id bigint, c string")
    got = {(r["c"], r["pliegue"]): r["count"] for r in evaluation.folds(df, "id", "c").groupBy("c", "pliegue").count().collect()}
    assert [got.get((c, i)) for c in (None, "a", "b") for i in range(5)] == [1] * 10 + [5, 5, 5, 4, 4]


def test_cross_validation_refits_per_fold(spark):
    words = {"m": "suma resta número fracción decimal", "c": "planta célula animal agua energía"}
    rows = [(i, f"{words['mc'[i % 2]]} texto {i % 7} ejemplo del libro", "mc"[i % 2]) for i in range(22)] + [(22, words["m"], "c"), (22, words["m"], "c"), (30, None, "m"), (31, "x", None)]
    df = spark.createDataFrame(rows, "id bigint, texto string, materia string")
    got = evaluation.cross_validation(df, "id", "texto", "materia", 3).first()
    # one row has the words of the other class: one of its fold of 7 or 8 is wrong, the other two folds are right
    n = {r["pliegue"]: r["count"] for r in evaluation.folds(df.filter("id < 23").distinct(), "id", "materia", 3).groupBy("pliegue").count().collect()}
    size = n[evaluation.folds(df.filter("id < 23").distinct(), "id", "materia", 3).filter("id = 22").first()["pliegue"]]
    want = [1, 1, 1 - 1 / size]
    assert got["pliegues"] == 3 and abs(got["media"] - np.mean(want)) < 1e-9 and abs(got["desviacion"] - np.std(want)) < 1e-9
    assert tuple(evaluation.cross_validation(df.filter("id < 5"), "id", "texto", "materia").first()) == (0, None, None)


def test_models_are_published_in_one_step(spark, tmp_path):
    texts = [f"la suma del número {k} es par" for k in range(12)] + [f"la planta y el río {k} son verdes" for k in range(12)]
    labels = ["m"] * 12 + ["n"] * 12
    model = router.fit(texts, labels, np.zeros((24, len(router.FEATURES))))
    assert router.current(str(tmp_path / "none")) is None
    first = router.publish(model, str(tmp_path))
    model.demo = True
    assert router.publish(model, str(tmp_path)) != first
    got = router.current(str(tmp_path))
    assert got.classes == ["m", "n"] and got.demo and got.trained_at == model.trained_at is not None
    x = model.rows(texts, np.zeros((24, len(router.FEATURES))))
    assert np.allclose(got.probabilities(*x), model.probabilities(*x)) and (model.probabilities(*x).argmax(axis=1) == np.repeat([0, 1], 12)).all()


def test_a_class_of_one_row_is_not_stratified(spark):
    df = spark.createDataFrame([(k, "a" if k else "b") for k in range(100)], "id bigint, clase string")
    got = corpus.stratified_split(df, "id", "clase")
    assert got.count() == 100 and got.filter("parte = 'prueba'").count() == 25
    with pytest.raises(ValueError):
        corpus.enough_classes(df.filter("clase = 'a'"), "clase")
    with pytest.raises(ValueError):
        corpus.required(df.limit(0), "manifest")


def slow_central(texts, prior, count):
    """TextRank and picks by plain loops over words."""
    words = [[w for w in re.findall(r"(?<![a-z0-9_])[a-z]{3,}(?![a-z0-9_])", ranking.fold(t)) if w not in ranking._STOP] for t in texts]
    n = len(texts)
    rows = []
    for own in words:
        row = {w: (1 + math.log(own.count(w))) * (math.log((1 + n) / (1 + sum(w in x for x in words))) + 1) for w in set(own)}
        size = math.sqrt(sum(v * v for v in row.values())) or 1.0
        rows.append({w: v / size for w, v in row.items()})
    sim = [[sum(v * y.get(w, 0.0) for w, v in x.items()) for y in rows] for x in rows]
    link = [[sim[i][j] if i != j and sim[i][j] >= 0.05 else 0.0 for j in range(n)] for i in range(n)]
    score = [1 / n] * n
    for _ in range(60):
        loose = sum(score[i] for i in range(n) if not sum(link[i]))
        score = [0.15 / n + 0.85 * (sum(score[i] * link[i][j] / sum(link[i]) for i in range(n) if sum(link[i])) + loose / n) for j in range(n)]
    score = [a * b for a, b in zip(score, prior)]
    top, out = max(score) or 1.0, []
    while len(out) < min(count, n):
        value = {i: 0.7 * score[i] / top - 0.3 * max([sim[i][j] for j in out], default=0.0) for i in range(n) if i not in out}
        out.append(min(value, key=lambda i: (-round(value[i], 12), i)))
    return sorted(out)


def test_central_sentences_equal_plain_loops():
    r = random.Random(8)
    vocabulary = [f"pal{c}{d}" for c in "abcdefgh" for d in "xyz"]
    for _ in range(25):
        texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 14))]
        prior = [r.choice([0.02, 0.4, 1.0]) for _ in texts]
        assert ranking.central(texts, prior, None, 4) == slow_central(texts, prior, 4)


def test_contexts_of_frequent_terms_come_from_all_uses(spark, monkeypatch):
    r = random.Random(5)
    words = [f"tema{c}{d}" for c in "abcdef" for d in "uvw"]
    rows = [(1, p, k, k // 5, f"El agua {' '.join(r.choice(words) for _ in range(6))} sigue {k}.", r.random() < 0.7, r.random() < 0.4) for p in (1, 2) for k in range(30 if p == 1 else 4)]
    uses = spark.createDataFrame(rows, "libro bigint, puesto int, orden int, pagina int, texto string, explica boolean, de_tema boolean")
    got = spark.createDataFrame([(1, p, "agua", "agua", False, None, None, 3) for p in (1, 2)], "libro bigint, puesto int, clave string, termino string, es_definicion boolean, definicion string, pagina int, veces int")
    want = sorted(map(tuple, materials.with_contexts(got, uses).collect()))
    monkeypatch.setattr(materials, "MATRIX_SENTENCES", 10)
    assert sorted(map(tuple, materials.with_contexts(got, uses).collect())) == want
    monkeypatch.setattr(ranking, "MATRIX_SENTENCES", 10)
    assert sorted(map(tuple, materials.with_contexts(got, uses).collect())) == want
