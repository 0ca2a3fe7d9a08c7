import numpy as np
import pytest

from sacbe.functions import image
from sacbe.sources import files


def test_manifest_and_texts(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿archivo,materia,grado,fuente\na.txt,otro,1ro_primaria,x\n# nota,,,\nb.txt,otro,,y\n", encoding="utf-8")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("  hola\nmundo \n", encoding="utf-8")
    m = files.manifest_csv(spark, str(tmp_path / "m.csv"))
    assert m.columns == ["archivo", "materia", "grado", "fuente"]
    got = {r["archivo"]: r["texto"] for r in files.with_texts(m, files.whole_texts(spark, str(tmp_path / "t"))).collect()}
    assert got["a.txt"] == "hola\nmundo" and got["b.txt"] is None


def test_pages_from_json(spark):
    df = spark.createDataFrame([(1, '[{"pagina": 2, "texto": "a", "confianza": null}, {"pagina": 1, "texto": "b", "confianza": 0.5}]'), (2, "no"), (3, None)], "libro int, paginas string")
    assert [tuple(r) for r in files.pages_json(df).collect() if r["pagina"]] == [(1, 2, 0, "a", None), (1, 1, 1, "b", 0.5)]


def test_documents_are_refused_with_reasons(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"nope")
    (tmp_path / "c.pdf").write_bytes(b"")
    got = {r["ruta"][-5:]: r["motivo"] for r in files.document_bytes(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": None, "b.pdf": "no es PDF"}  # empty files are skipped


def test_requested_pages(spark):
    df = spark.createDataFrame([("1,2", 3), ("4", 3), ("x", 3), (None, 3)], "p string, n int")
    assert [r["motivo"] for r in files.requested_pages(df, "p", "n").collect()] == [None, "pagina inexistente", "lista no valida", "lista no valida"]


def test_recogniser_failures_are_results(spark):
    def read(doc, page):
        if page == 2:
            raise ValueError("mala")
        return f"{doc}-{page}", 0.9

    df = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, pagina int")
    got = {r["pagina"]: (r["texto"], r["error"]) for r in files.recognise(df, read).collect()}
    assert got == {1: ("d-1", None), 2: (None, "mala")}


def test_metrics_are_replaced(spark, tmp_path):
    p = str(tmp_path / "m")
    for k in (1, 2):
        files.write_metrics(spark.createDataFrame([(k,)], "v int"), p)
    assert [r["v"] for r in spark.read.json(p).collect()] == [2]


@pytest.mark.parametrize("angle", [-2.0, 0.0, 3.0])
def test_skew_is_found(angle):
    page = np.full((400, 400), 230, np.uint8)
    page[40:360:20, 40:360] = 20
    page[41:360:20, 40:360] = 20
    turned = image.rotate(page, -angle, 230)
    found = image.skew(image.binarize(turned))
    assert abs(found - angle) <= 0.5
    assert image.skew(np.full((50, 50), 255, np.uint8)) == 0.0


def test_settings_are_checked():
    assert files.recognition_settings({"dpi": "150", "workers": None})["dpi"] == 150 and files.recognition_settings({})["most_pages"] == 600
    for bad in ({"dpi": "x"}, {"dpi": 10}, {"nada": 1}):
        with pytest.raises(ValueError):
            files.recognition_settings(bad)
