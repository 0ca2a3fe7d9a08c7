"""Defined results for odd input, and brute-force versions, of the operators on texts."""

import itertools
import pickle
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sacbe.llm import boundaries, quality, reading, repetition, scan_repair, subjects, syllables, words
from sacbe import storage

LONG = "Esta es una oración normal del libro de lectura. " * 4000
ODD = [None, "", "   \n \t ", "a", "1 2 3", "....", LONG, "日本語の文。", "\u0000x", "🙂 🙂"]


def texts(spark, values, extra=True):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, text string")
    return df.withColumn("words", F.lit("x")).withColumn("clase", F.lit(1)).withColumn("palabras", F.lit(2)) if extra else df  # clashing names


def test_statistics_of_odd_texts(spark):
    got = quality.text_statistics(texts(spark, ODD), frozenset({"de"}), "id", "text").orderBy("id").collect()
    assert [r["lines"] for r in got][:5] == [0, 0, 0, 1, 1] and got[6]["words"] == 36000
    assert quality.text_statistics(texts(spark, []), frozenset(), "id", "text").count() == 0


def kinds():
    prose = [f"El niño {w} corre por la calle. La casa de la abuela es grande y tiene un patio." for w in "alto bajo feliz triste lento".split()] * 4
    lists = ["\n".join(f"- {w} {k}" for k, w in enumerate("perro gato casa mesa silla".split())) for _ in range(6)]
    tables = ["\n".join(f"{k} | {k * 7} | {k * 3}.5" for k in range(8)) for _ in range(6)]
    junk = ["¬¬ ~~ %& x= ||\n~ ^^ ## && %%" for _ in range(6)]
    return [(t, c) for c, ts in (("prosa", prose), ("lista", lists), ("tabla", tables), ("basura", junk)) for t in ts]


def test_mixture_names_components(spark):
    rows = kinds()
    common = frozenset("el la de es y un por".split())
    labelled = quality.labelled_statistics(spark.createDataFrame(rows, "texto string, clase string"), common)
    stats = quality.text_statistics(texts(spark, [t for t, _ in rows] + [None, ""]), common, "id", "text")
    model = quality.fit_mixture(stats, labelled)
    got = quality.name_kinds(stats, model).orderBy("id").collect()
    assert [r["clase"] for r in got] == [c for _, c in rows] + [None, None]
    assert quality.name_kinds(stats.limit(0), model).count() == 0
    assert quality.fit_mixture(stats.limit(0), labelled).weight.sum() == pytest.approx(1)


def test_wrong_counts(spark):
    e = spark.createDataFrame([(1, "uno dos"), (1, "uno dos"), (2, "ñandú çà"), (3, None), (4, "x")], "ejemplo_id bigint, texto string")
    m = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (4, None), (9, 1)], "ejemplo_id bigint, palabras int")
    assert sorted(r[0] for r in quality.wrong_counts(e, m).collect()) == [2, 3]  # ç and à are no letters of the count


def test_declared_grades(spark):
    said = ["4to_primaria", "Segundo básico", "6° primaria", "primaria", None, "Primero Primaria", "1ro_basicos", "7mo_primaria", ""]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(said)], "i int, grado string")
    assert [r[0] for r in df.orderBy("i").select(reading.grade_level("grado")).collect()] == ["primaria_alta", "basicos", "primaria_alta", None, None, "primaria_baja", "basicos", None, None]


def slow_measure(text, common):
    """Statistics of one text, piece by piece."""
    text = text or ""
    words, marks = words_of(text), text.split()
    if not marks:
        return (0, 0, *[0.0] * len(quality.MEASURES))
    n, solid, letters = len(words), sum(map(len, marks)), sum(map(len, words))
    digits = len(re.findall(r"\d", text))
    lines = [x for x in text.split("\n") if x.strip()]
    ends = [bool(re.search(r"[.!?…:。！？।؟][\"'”»)\]]*\s*$", x)) for x in lines]
    closed = sum(len(words_of(x)) for x, e in zip(lines, ends) if e)
    plain = sum(quality._PLAIN.fullmatch(x) is not None for x in marks)
    return (n, len(lines), letters / max(n, 1), max(0, solid - letters - digits) / solid, digits / solid, sum(ends) / len(lines), sum(w.lower() in common for w in words) / max(n, 1), len(quality._VOWEL.findall(text)) / max(letters, 1), plain / len(marks), closed / max(n, 1), float(np.log((n + 0.5) / len(lines))))


def words_of(text):
    return re.findall(r"[^\W\d_]+", text)


def test_statistics_equal_a_slow_count():
    values = [*ODD, "Título\n\n- uno: 12,5 «dos»\n Fin. (Sí!)  \r\n\x0cOtra línea… 3x4", "a\u2028b\x1cc. \n\n\n", "¿Qué?\n" * 40] * 3
    got = quality.Statistics(frozenset({"de", "la"}))(words.parse(values))
    want = [slow_measure(v, {"de", "la"}) for v in values]
    assert np.allclose(got.to_numpy(float), np.array(want)) and len(got) == len(values)
    frame = pd.DataFrame({"text": values})
    assert sum(len(p) for p in words.parts(frame, "text")) == len(values) and len(list(words.parts(frame, "text"))) > 0


def test_pieces_end_at_marks_before_capitals_and_at_lines():
    x = words.parse(["Uno dos. «Tres» cuatro.\") ¿Qué pasa? no\nfin. así", None, "Otro"])
    assert x.piece.tolist() == [0, 0, 1, 1, 2, 2, 2, 3, 3, 4] and x.owner.tolist() == [0] * 9 + [2]


def test_syllables_follow_hyphenation_rules():
    said = "cons-truc-ción at-lán-ti-co pa-ís guí-a rey ex-tra-or-di-na-rio o-í-do trans-por-te quien y a-bri-gar car-ta pe-rro ca-lle"
    for w in said.split():
        assert syllables.spanish(w.replace("-", "")) == w.split("-")
    counts = {"people": 2, "table": 2, "wanted": 2, "jumped": 1, "makes": 1, "boxes": 2, "nation": 2, "the": 1, "actual": 3, "radio": 3, "rhythm": 1, "yellow": 2, "studying": 3}
    assert {w: len(syllables.english(w)) for w in counts} == counts
    assert syllables.spanish("xyz") and syllables.english("bcd") == ["bcd"] and syllables.spanish("ñ") == ["ñ"]


def labelled_levels():
    easy = "El sol sale hoy. La vaca come pan. El gato ve la luna. " * 3
    mid = "Cuando la niña camina por el parque, la familia prepara una comida sencilla para compartir con la comunidad. " * 3
    hard = "Conforme a las investigaciones contemporáneas, la biodiversidad característica condiciona sistemáticamente la reproducción especializada, independientemente de la interpretación convencional extraordinariamente divulgada. " * 3
    return pd.DataFrame({"texto": [easy, mid, hard, "The cat sat with the dog. They were happy when the sun came out."], "nivel": [*reading.LEVELS, "basicos"], "materia": ["otro", "otro", "otro", "ingles"]})


def test_reading_levels(spark):
    known = labelled_levels()
    languages = reading.language_model(known)
    levels = reading.Levels(languages, reading.knots(known, languages))
    assert list(levels.at) == [False]  # there are no texts of all levels in English
    got = reading.reading_level(texts(spark, [*known["texto"][:3], *ODD]), "id", "text", levels).orderBy("id").collect()
    assert [r["nivel"] for r in got[:3]] == list(reading.LEVELS)
    assert got[3]["nivel"] is None and got[3]["nota"] is None and len(got) == 3 + len(ODD)
    assert reading.reading_level(texts(spark, []), "id", "text", levels).count() == 0


def test_language_follows_letters():
    languages = reading.language_model(labelled_levels())
    assert languages.names == ["en", "es"]
    lean = lambda t: sum(a - b for a, b in map(languages.evidence, t.split()))
    assert lean("the dog was with them") > 0 > lean("la comunidad prepara la interpretación") and languages.evidence("12 --") == [0.0, 0.0]


def test_subject_classifiers():
    a, b = "El triángulo y la suma del número decimal.", "La planta y la célula del animal vivo."
    w, bias = subjects.train([f"{a} {k}" for k in range(30)] + [f"{b} {k}" for k in range(30)], ["matematicas"] * 30 + ["ciencias_naturales"] * 30)
    model = subjects.Subjects(w, bias, np.zeros(6, dtype=np.float32))
    got = model.shares(words.parse([a, b, f"{a} {b}", None, ""]))
    assert got[0].argmax() == 0 and got[1].argmax() == 1 and (got[2][:2] > 0.3).all() and got[3:].sum() == 0
    assert (subjects.train([], [])[0] == 0).all()


def test_thresholds_come_from_texts_not_trained_on():
    a, b = "El triángulo y la suma del número decimal.", "La planta y la célula del animal vivo."
    labelled = [(f"{a} {k}", "matematicas") for k in range(20)] + [(f"{b} {k}", "ciencias_naturales") for k in range(20)]
    model, least = subjects.fit([(f"{a} más {k}", "matematicas") for k in range(20)], labelled)
    held = [x for x in labelled if not subjects._hash(x[0]) % 2]
    z = subjects.features(words.parse([x[0] for x in held])).sums(model.weights) + model.bias
    for k, name in enumerate(("matematicas", "ciencias_naturales")):
        own = np.array([x[1] == name for x in held])
        assert z[own, k].min() >= model.threshold[k] > z[~own, k].max()
    assert (least >= subjects.LEAST_SHARE).all() and subjects.fit([], [])[0].shares(words.parse(["a b"])).shape == (1, 6)


def slow_repeated(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    seen, inside = set(), set()
    for i in range(len(words) - 7):
        p = tuple(words[i : i + 8])
        if p in seen:
            inside.update(range(i, i + 8))
        seen.add(p)
    return len(words), len(inside)


def test_repetition_equals_brute_force(spark):
    r = random.Random(5)
    made = []
    for _ in range(60):
        base = [r.choice("uno dos tres cuatro cinco seis siete".split()) for _ in range(r.randint(0, 60))]
        made.append(" ".join(base + base[: r.randint(0, 30)]))
    values = made + ODD
    size, inside = repetition.repeated_words(values)
    assert list(zip(size.tolist(), inside.tolist())) == [slow_repeated(v) for v in values]
    got = repetition.repeated_share(texts(spark, values), "id", "text").orderBy("id").collect()
    assert [(x["palabras"], x["repetidas"]) for x in got] == [slow_repeated(v) for v in values]
    assert repetition.repeated_share(texts(spark, []), "id", "text").count() == 0


def test_divergence_guards_short_texts(spark):
    df = texts(spark, ["la casa de la abuela " * 20, "x" * 400 + " %%%" * 60, "corto", None]).withColumn("lang", F.lit("es"))
    got = {r["id"]: r["divergencia"] for r in repetition.divergence(df, {"es": ["de", "la"]}, "id", "text", "lang").collect()}
    assert got[2] is None and got[3] is None and got[0] is not None
    assert repetition.divergence(df.limit(0), {"es": ["de", "la"]}, "id", "text", "lang").count() == 0


def test_each_common_word_has_a_bin(spark):
    df = texts(spark, ["la la de casa", "de the of of and", None]).withColumn("lang", F.lit(None).cast("string"))
    got = {r["id"]: r for r in repetition.histograms(df, {"es": ["de", "la"], "en": ["and", "of", "the"]}, "id", "text", "lang").collect()}
    assert got[0]["lang"] == "es" and np.allclose(got[0]["comunes"], [0.25, 0.5, 0.25])
    assert got[1]["lang"] == "en" and np.allclose(got[1]["comunes"], [0.2, 0.4, 0.2, 0.2]) and sum(got[2]["comunes"]) == 0
    p, q = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]]), np.array([0.5, 0.5, 0.0])
    assert np.allclose(repetition.jensen_shannon(p, q), [0.0, 1.0])


SENTENCES = [
    ("El Dr. {} midió el agua.", "Vera Lara Soto Paz Luna Rey".split()), ("La niña ve {} hoy.", "perros gatos patos peces osos aves".split()),
    ("¿Quién vive en {}?", "casa paz Roma Lima Cuba Perú".split()), ("Compró pan, sal, etc.", [""]),
]


def sentence_texts(n=300):
    r = random.Random(3)
    out = []
    for _ in range(n):
        some = [t.format(r.choice(w)) for t, w in (r.choice(SENTENCES) for _ in range(r.randint(1, 4)))]
        out.append((" ".join(some), some))
    return out


def test_sentences_are_found_and_offsets_are_exact(spark):
    rows = sentence_texts()
    df = texts(spark, [t for t, _ in rows]).select(F.lit("t").alias("tabla"), F.col("id").alias("registro"), F.col("text").alias("texto"))
    found = storage.materialize(boundaries.find_gaps(df), "gaps")
    model = boundaries.train(found)
    hits = sum([t[i:j] for i, j in boundaries.sentence_spans(t, model)] == want for t, want in rows)
    assert hits >= 0.97 * len(rows)
    got = boundaries.sentences(found, model).collect()
    assert sorted((r["registro"], r["inicio"], r["fin"]) for r in boundaries.sentences(found, model, with_text=False).collect()) == sorted((r["registro"], r["inicio"], r["fin"]) for r in got)
    assert all(r["texto"] == rows[r["registro"]][0][r["inicio"] : r["fin"]] for r in got)
    for t in ODD:
        spans = boundaries.sentence_spans(t, model)
        assert all(t[i:j].strip() and t[i:j] == t[i:j].strip() for i, j in spans)
        assert "".join("".join(t[i:j].split()) for i, j in spans) == "".join((t or "").split())  # nothing but blanks is left out
    assert boundaries.sentence_spans("Título\n\nLa niña ve osos hoy.\n \nFin", model) == [(0, 6), (8, 28), (31, 34)]
    assert boundaries.sentences(found.limit(0), model).count() == 0 and len(boundaries.train(found.limit(0)).keys) == 0
    few = boundaries.train(found, most=20)  # a bound on the contexts kept leaves the shorter ones
    assert len(few.keys) < len(model.keys) and sum([t[i:j] for i, j in boundaries.sentence_spans(t, few)] == want for t, want in rows) >= 0.6 * len(rows)
    back = pickle.loads(pickle.dumps(model))
    assert boundaries.sentence_spans(rows[0][0], back) == boundaries.sentence_spans(rows[0][0], model)


def slow_posteriors(model, g, inside):
    """Forward-backward over the gaps of one paragraph by plain loops."""
    p, r = model.before(g), model.ratio(g)
    steps = []
    for i in range(len(p)):
        own = []
        for e in (0, 1):
            odds = p[i] * model.link[g["palabras"][i] - 1, e]
            q = odds / (odds + 1 - p[i])
            own.append((1.0, 0.0) if inside[i] else (1 - q, q * r[i]))
        steps.append(own)
    total = {}
    for path in itertools.product((0, 1), repeat=len(p)):
        weight, was = 1.0, 1
        for i, e in enumerate(path):
            weight *= steps[i][was][e]
            was = e
        total[path] = weight
    return [sum(w for path, w in total.items() if path[i]) / sum(total.values()) for i in range(len(p))]


def test_posteriors_equal_the_sum_over_all_paths(spark):
    rows = sentence_texts(60)
    df = texts(spark, [t for t, _ in rows]).select(F.lit("t").alias("tabla"), F.col("id").alias("registro"), F.col("text").alias("texto"))
    model = boundaries.train(storage.materialize(boundaries.find_gaps(df), "gaps"))
    for t in ["El Dr. Paz vive en Roma. (¿Quién vive. Uno) aquí? Compró pan, sal, etc. La niña ve 3.5 osos… ¡Sí! Fin.", "Una. Dos.\n\nTres. Cuatro. Cinco."]:
        p, g = boundaries.analysed(t)
        x = boundaries.Batch({c: np.array([r[k] for r in g], dtype=np.int64) for k, c in enumerate(boundaries.GAP)}, {c: np.array([r[k] for r in p], dtype=np.int64) for k, c in enumerate(boundaries.PARAGRAPH)})
        got, at = model.posteriors(x), 0
        for n in x.paragraph["cuantos"]:
            own = {c: v[at : at + n] for c, v in x.gap.items()}
            assert np.allclose(got[at : at + n], slow_posteriors(model, own, own["dentro"] > 0))
            at += n
        assert at == len(got) >= 3


def test_quotes_never_closed_are_passed_over():
    assert boundaries._spans("a (b [c) d «e» f", 0, 16) == [(2, 7), (11, 13)]
    assert boundaries._spans("((a) (b)", 0, 8) == [(1, 3), (5, 7)]
    assert boundaries._spans("([a] b) \"c\"", 0, 11) == [(0, 6), (8, 10)]
    long = "( [ « Uno dos. " * 100_000
    assert boundaries._spans(long, 0, len(long)) == []
    began = time.time()
    assert len(boundaries.analysed(long)[1]) == 100_000 - 1 and time.time() - began < 20
    wide = "一只猫。" * 50_000  # a text without spaces takes time in proportion to its length
    began = time.time()
    assert len(boundaries.analysed(wide)[1]) == 50_000 - 1 and time.time() - began < 20


def test_quotes_and_scripts_without_marks(spark):
    df = texts(spark, ["เด็ก วาด ภาพ", "一只猫。两只狗！", "Dijo: «Ven. Corre.» y salió."] * 20).select(F.lit("t").alias("tabla"), F.col("id").alias("registro"), F.col("text").alias("texto"))
    model = boundaries.train(storage.materialize(boundaries.find_gaps(df), "gaps"))
    t = "Ana dijo: «No toquen. Es mío. ¡Cuidado!», y se fue."
    assert boundaries.sentence_spans(t, model) == [(0, len(t))]
    thai = "เด็กวาดภาพ ชาวนานับ 12 อัน"
    assert boundaries.sentence_spans(thai, model) == [(0, 10), (11, len(thai))]


KNOWN = "la casa grande tiene una ventana pequeña y el niño lee cuentos de lectura muy bien temperatura socio económico socio-económico"
PAGE = "La casa gran-\nde tiene una ven¬ \ntana\n*,;~\n= 13\nla ternperatura\nmuy socio-\neconómico bien\nla ca sa\nla tempe-\nrafura la venfa-\nna bien"
FAULTS = [(1, "guion"), (2, "guion"), (4, "mancha"), (6, "caracter"), (9, "caracter"), (10, "guion"), (11, "caracter"), (11, "guion"), (11, "caracter")]


def scanned(spark, values):
    return spark.createDataFrame([("p", k, "b", k, t) for k, t in enumerate(values, 1)], "tabla string, registro bigint, libro string, pagina bigint, texto string")


def forms_of(spark, native, read=()):
    rows = spark.createDataFrame([(t, False) for t in native] + [(t, True) for t in read], "texto string, leido boolean")
    return scan_repair.known_forms(storage.materialize(scan_repair.token_forms(rows), "forms"), [])


def found_faults(spark, values, known, compounds, most=1000):
    got = scan_repair.faults(scanned(spark, values), known, compounds, scan_repair.hot_forms(known, most)).distinct().collect()
    return sorted((r["registro"], r["renglon"], r["hallazgo"]) for r in got)


def test_faults_of_a_page(spark):
    known, compounds = forms_of(spark, [KNOWN])
    want = sorted({(1, *f) for f in FAULTS})
    for most in (1000, 3, 0):  # what isn't among the frequent forms is found by joins
        assert found_faults(spark, [PAGE, None, ""], known, compounds, most) == want
    assert found_faults(spark, [], known, compounds) == []


def test_rare_native_words_stay_known(spark):
    many = [f"palabra{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    known, compounds = forms_of(spark, [KNOWN] * 300 + [" ".join(many)])
    assert known.count() >= len(many) + len(KNOWN.split())
    assert found_faults(spark, [PAGE, " ".join(many[:5])], known, compounds) == sorted({(1, *f) for f in FAULTS})


def test_words_only_scans_have(spark):
    read = ["la brújula"] * 30 + ["la brújuia"] * 6 + ["bru jula"] * 2 + ["la ven tana"] * 6 + ["la mdigo"] * 6 + ["índigo indigo"] * 30 + ["todavía.la"] * 9 + ["rara"] * (scan_repair.SCANNED_LEAST - 1)
    known, _ = forms_of(spark, [KNOWN] * 200, read)
    words_ = {r["forma"] for r in known.collect()}
    assert {"brújula", "índigo"} <= words_ and not words_ & {"brújuia", "tana", "ven", "mdigo", "todavía.la", "rara"}
    assert {"socio-económico", "socio"} <= words_
    asked = spark.createDataFrame([("ternperafura", scan_repair.skeleton("ternperafura")), ("zzz", "zzz")], "nucleo string, esqueleto string")
    assert [tuple(r) for r in scan_repair.corrections(asked, known).collect()] == [("ternperafura", "temperatura")]


def test_repaired_paragraphs(spark):
    page = "Guía\n\nLa casa gran-\nde tiene una ven­\ntana.\n*,;~\n\nEl niño lee cuentos de ternperatura socio-\neconómico y la ca sa."
    known, compounds = forms_of(spark, [KNOWN])
    for most in (1000, 2):
        hot = scan_repair.hot_forms(known, most)
        got = scan_repair.answers(scanned(spark, [page]), known, compounds, hot).first()
        hot.answer(got["conocidas"], got["pares"], {f["nucleo"]: f["arreglo"] for f in got["arreglos"]})
        assert scan_repair.repaired(page, {1}, hot) == (["La casa grande tiene una ventana.", "El niño lee cuentos de temperatura socio-económico y la casa."], None)
        assert scan_repair.repaired(None, set(), hot) == ([], None)
    assert scan_repair.answers(scanned(spark, []), known, compounds, hot).count() == 0


def test_words_cut_between_pages(spark):
    rows = [("p", "b", 1, 1, 1, True, "venta", "La casa tiene una venta-"), ("p", "b", 2, 2, 1, False, None, "na grande y"), ("p", "b", 2, 2, 2, True, None, "El niño lee"), ("p", "b", 3, 3, 1, True, "socio", "cuentos de socio-"), ("p", "b", 4, 4, 1, True, None, "económico."), ("p", "b", 5, 5, 1, True, "a", "Fin a-"), ("p", "b", 6, 6, 1, True, None, "b"), ("p", "b", 6, 7, 1, True, None, "c"), ("p", None, None, 9, 1, True, "x", "x-")]
    df = spark.createDataFrame(rows, "tabla string, libro string, pagina bigint, registro bigint, parrafo int, ultimo boolean, abierta string, texto string")
    known, _ = forms_of(spark, [KNOWN])
    got = {(r["registro"], r["parrafo"]): (r["texto"], r["continua"]) for r in scan_repair.across_pages(df, known).collect()}
    assert got == {(1, 1): ("La casa tiene una ventana", True), (2, 1): ("grande y", False), (2, 2): ("El niño lee", True), (3, 1): ("cuentos de socio-económico.", True), (5, 1): ("Fin a-", False), (6, 1): ("b", False), (7, 1): ("c", False), (9, 1): ("x-", False)}


def test_furniture(spark):
    rows = [("p", k, "b", k, f"Guía de lecturas | Pág. {k}\n\nLa casa tiene una ventana, y el niño lee.\nEl final llega pronto, dijo.\n\n[{k}]") for k in range(1, 7)]
    rows += [("p", 7, "b", 7, "Guía de lccturas | Pág. 7\ncuerpo largo, sí.\n[l7]"), ("p", 8, "b", None, None), ("p", 9, "b", 9, "  \n ")]
    pages = spark.createDataFrame(rows, "tabla string, registro bigint, libro string, pagina bigint, texto string").withColumn("renglon", F.lit("x"))
    got = {(r["registro"], r["renglon"], r["hallazgo"]) for r in scan_repair.furniture(scan_repair.edge_lines(pages)).collect()}
    assert got == {(k, 1, "cabecera") for k in range(1, 8)} | {(k, 6, "folio") for k in range(1, 7)} | {(7, 3, "folio")} - {(7, 3, "folio")}


def test_repeated_pages_make_no_furniture(spark):
    rows = [("p", k, "b", k, f"Línea {'abcdefgh'[k] * 5} del texto que sigue, sí.\ncuerpo largo, sí.") for k in range(1, 7)]
    once = ("p", 7, "b", 7, "Se llama combustible a lo que protege\nla casa de la rana, sí.\n7")
    pages = spark.createDataFrame([*rows, once, once], "tabla string, registro bigint, libro string, pagina bigint, texto string")
    edges = scan_repair.edge_lines(pages)
    assert edges.count() == 2 * 6 + 3
    assert {(r["registro"], r["renglon"], r["hallazgo"]) for r in scan_repair.furniture(edges).collect()} == {(7, 3, "folio")}
