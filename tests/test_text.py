import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sacbe.functions import text as tx
from sacbe.operators import definitions, readability, sentences, timeline


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


def slow_syllables(word):
    strong, all_ = set("aeoáéó"), set("aeoáéóiuíúü")
    n, before = 0, None
    for c in word.lower():
        if c in all_:
            n += before is None or (before in strong and c in strong)
            before = c
        else:
            before = None
    return max(n, 1)


def test_syllables_equal_a_letter_by_letter_count(spark):
    texts = ["causa viejo", "aéreo", "y s mm", "poeta leía", "", "ÁREA océano", "guía país baúl", "pingüino ahínco"]
    got = column(spark, texts, tx.syllable_count)
    assert got == [sum(slow_syllables(w) for w in re.findall("[a-záéíóúüñA-ZÁÉÍÓÚÜÑ]+", t)) for t in texts]


def test_readability_of_texts_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... 4"), (4, "Sin punto final")], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in readability.readability(df).collect()}
    assert all(rows[k]["oraciones"] == 0 and rows[k]["nivel"] == "basicos" and rows[k]["puntuacion"] == 0 for k in (1, 2, 3))
    assert rows[4]["oraciones"] == 1


def test_split_keeps_christ_and_glues_speech(spark):
    texts = ["Nació en 20 a. C. y murió. Otra vez. ¿Sí? No", "—Ven. —dijo el niño. Luego salió.", "uno\ndos\n\ntres"]
    got = column(spark, texts, sentences.split_pieces)
    assert got[0] == ["Nació en 20 a. C. y murió.", "Otra vez.", "¿Sí?", "No"]
    assert got[1] == ["—Ven. —dijo el niño.", "Luego salió."]
    assert got[2] == ["uno", "dos", "tres"]


def test_pieces_lose_titles_headings_and_numbers(spark):
    texts = ["MICHEL FOUCAULT: LA OBRA El autor nació", "Capítulo 3 - La célula vive", "6 2 La agricultura es", "El vi civil", "IV La guerra", "— hola •"]
    assert column(spark, texts, sentences.piece_text) == ["El autor nació", "La célula vive", "La agricultura es", "El vi civil", "La guerra", "hola"]


def test_legible(spark):
    texts = ["El agua corre por el río", "LUSAR f TRJS / Ê xx", "12 13 14", "", "b c d"]
    assert column(spark, texts, sentences.is_legible) == [True, False, False, False, False]


def test_predicates(spark):
    assert column(spark, ["—Hola", "Nada", "vino — dijo ella"], sentences.is_dialogue) == [True, False, True]
    assert column(spark, ["Copio en mi cuaderno", "Formamos equipos", "La célula vive", "¿Qué es?"], sentences.is_task) == [True, True, False, True]


def test_definitions(spark):
    texts = [
        "La célula es la unidad básica de la vida en la Tierra.", "Domesticar significa crear lazos con otro ser.", "El paso del agua a vapor por el calor se llama evaporación.",
        "El desierto es bello por la noche y frío al alba.", "Materiales: limón, ruda, tilo, agua, sal y azúcar.", "Importante: los nombres no se repiten nunca en la lista.", "Yo soy la persona que define el mundo entero.", None,
    ]
    got = column(spark, texts, definitions.definition)
    assert [g and (g["termino"], g["fuerte"]) for g in got] == [("célula", False), ("Domesticar", True), ("evaporación", False), None, None, None, None, None]


def test_dates(spark):
    texts = ["En 1821 hubo paz", "en 1821.", "Hacia el 300 a. C. y 1900", "siglo XIX y siglos iv", "1200 a. C.", "1.821 y 2100"]
    got = [[(d["valor"], d["fecha"]) for d in x] for x in column(spark, texts, timeline.dates)]
    assert got == [[(1821, "1821")], [], [(-300, "300 a. C."), (1900, "1900")], [(1850, "Siglo XIX"), (350, "Siglo IV")], [(-1200, "1200 a. C."), (1200, "1200")], []]


def test_even_sample_spreads_over_all(spark):
    df = spark.createDataFrame([(1, 1000 + k, str(k), "t", k) for k in range(10)] + [(2, 5, "a", "t", 1)], "libro int, valor int, fecha string, texto string, pagina int")
    got = timeline.timeline(df, 4).orderBy("libro", "puesto").collect()
    assert [r["valor"] for r in got] == [1000, 1003, 1006, 1009, 5]
    assert [r["valor"] for r in timeline.timeline(df, 1).orderBy("libro").collect()] == [1000, 5]


def test_hide_and_contain(spark):
    df = spark.createDataFrame([("La Célula y la celula, celular", "célula"), ("sin ella", "x.*"), ("el sol", None)], "s string, t string")
    got = df.select(tx.hide_term(F.col("s"), F.col("t")), tx.contains_term(F.col("s"), F.col("t"))).collect()
    assert tuple(got[0]) == ("La _____ y la _____, celular", True)
    assert tuple(got[1]) == ("sin ella", False) and got[2][1] is False


def test_cleaning(spark):
    assert column(spark, ["cé-\nlula Norte-\nSur ﬁn\n~~ | 3 4\n\n\n\nfin"], tx.clean_recognised) == ["célula Norte-Sur fin\n\nfin"]
    assert column(spark, ["abc de", "x" * 150, "a " * 80], lambda c: tx.cut_at_word(c))[0] == "abc de"


def test_page_lists(spark):
    assert column(spark, ["[3, 1,2]", "5", "1,,2", "a", None, "[1"], tx.page_list) == [[1, 2, 3], [5], None, None, None, [1]]


def test_roman(spark):
    assert column(spark, ["IV", "xix", "C", "", "Q", None], tx.roman) == [4, 19, 100, None, None, None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aeiouáéíóúbcdñ AEIO.!?", max_size=40), min_size=1, max_size=20))
def test_counts_of_any_text(spark, texts):
    got = column(spark, texts, tx.syllable_count)
    assert got == [sum(slow_syllables(w) for w in re.findall("[a-záéíóúüñA-ZÁÉÍÓÚÜÑ]+", t)) for t in texts]


def test_marks_set_apart_and_ligatures(spark):
    apart = "nin\u0303o canción ﬁn"
    assert column(spark, [apart], tx.fold) == ["nino cancion fin"]
    assert column(spark, [apart, "x"], tx.composed) == ["niño canción ﬁn", "x"]
