"""Subject classifier with explanations: TF-IDF and numeric features into logistic regression.

The model is fitted on a bounded sample (at most ``TRAINING_ROWS`` rows, by hash of the id); every row is
classified, in Arrow batches against the broadcast model, whose size is bounded by ``VOCABULARY``.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sacbe.operators.ranking import fold
from sacbe.operators.readability import FEATURES, features

TRAINING_ROWS, VOCABULARY = 3000, 30_000
#: Below this probability the label is ``otro`` and the explained class is kept beside it.
UNSURE, MOST_FREQUENT, TOP = 0.35, 0.85, 8
#: Inverse strength of the penalty; most steps, and the gradient at which fitting has settled.
STRENGTH, STEPS, SETTLED = 1.0, 2000, 1e-4
CURRENT = "current.json"
_TOKEN = re.compile(r"\w\w+")


def _terms(text: str | None) -> Counter:
    t = _TOKEN.findall(fold(text or ""))
    return Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])])


@dataclass
class Router:
    """A fitted classifier."""

    classes: list[str]
    terms: dict[str, int]
    idf: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (terms + numeric features, classes)
    bias: np.ndarray
    demo: bool = True
    trained_at: str | None = None

    def rows(self, texts: list, numbers: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Sparse TF-IDF rows of unit length, and standardized, clipped numeric rows of unit length."""
        sparse = []
        for t in texts:
            own = [(self.terms[k], n) for k, n in _terms(t).items() if k in self.terms]
            at = np.array([a for a, _ in own], dtype=np.int64)
            w = (1 + np.log(np.array([n for _, n in own], dtype=float))) * self.idf[at] if own else np.zeros(0)
            sparse.append((at, w / (np.sqrt((w**2).sum()) or 1.0)))
        z = np.clip((numbers - self.mean) / self.scale, -5, 5)
        size = np.sqrt((z**2).sum(axis=1, keepdims=True))
        return sparse, z / np.where(size > 0, size, 1)

    def scores(self, sparse, numeric: np.ndarray) -> np.ndarray:
        k = len(self.terms)
        out = numeric @ self.weights[k:] + self.bias
        for i, (at, w) in enumerate(sparse):
            out[i] += w @ self.weights[at]
        return out

    def probabilities(self, sparse, numeric: np.ndarray) -> np.ndarray:
        z = self.scores(sparse, numeric)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def save(self, path: str) -> None:
        order = sorted(self.terms, key=self.terms.get)
        np.savez_compressed(path, weights=self.weights, bias=self.bias, idf=self.idf, mean=self.mean, scale=self.scale, meta=np.array(json.dumps({"classes": self.classes, "terms": order, "demo": self.demo, "trained_at": self.trained_at})))

    @staticmethod
    def load(path: str) -> Router:
        x = np.load(path)
        meta = json.loads(str(x["meta"]))
        return Router(meta["classes"], {t: i for i, t in enumerate(meta["terms"])}, x["idf"], x["mean"], x["scale"], x["weights"], x["bias"], meta.get("demo", True), meta.get("trained_at"))


def publish(model: Router, folder: str) -> str:
    """Store a model under a new name in a folder and make it the current one in a single step; a failure before that leaves the old one."""
    os.makedirs(folder, exist_ok=True)
    name = f"router-{uuid.uuid4().hex}.npz"
    model.save(os.path.join(folder, name))
    draft = os.path.join(folder, f".{name}.json")
    with open(draft, "w", encoding="utf-8") as f:
        json.dump({"model": name, "classes": model.classes, "trained_at": model.trained_at, "demo": model.demo}, f)
    os.replace(draft, os.path.join(folder, CURRENT))
    return name


def current(folder: str) -> Router | None:
    """The current model of a folder, None if there is none."""
    path = os.path.join(folder, CURRENT)
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return Router.load(os.path.join(folder, json.load(f)["model"]))


def fit(texts: list[str], labels: list[str], numbers: np.ndarray, demo: bool = False) -> Router:
    """Multinomial logistic regression with balanced weights and L2, by accelerated gradient steps."""
    classes = sorted(set(labels))
    if len(classes) < 2:
        raise ValueError("at least two classes are needed")
    counts = [_terms(t) for t in texts]
    df = Counter(k for c in counts for k in c)
    least = 2 if len(texts) >= 20 else 1
    total = Counter()
    for c in counts:
        total.update(c)
    kept = [k for k, n in df.items() if least <= n <= MOST_FREQUENT * len(texts)]
    kept = sorted(sorted(kept, key=lambda k: (-total[k], k))[:VOCABULARY])
    idf = np.log((1 + len(texts)) / (1 + np.array([df[k] for k in kept], dtype=float))) + 1
    scale = numbers.std(axis=0)
    model = Router(classes, {k: i for i, k in enumerate(kept)}, idf, numbers.mean(axis=0), np.where(scale > 0, scale, 1.0), np.zeros((len(kept) + numbers.shape[1], len(classes))), np.zeros(len(classes)), demo)
    sparse, numeric = model.rows(texts, numbers)
    y = np.array([classes.index(x) for x in labels])
    per = np.bincount(y, minlength=len(classes))
    weight = (len(y) / (len(classes) * per))[y] / len(y)
    flat = np.concatenate([a for a, _ in sparse])
    value = np.concatenate([w for _, w in sparse])
    row = np.repeat(np.arange(len(y)), [len(a) for a, _ in sparse])
    order = np.argsort(flat, kind="stable")
    flat_s, row_s, value_s = flat[order], row[order], value[order]
    starts = np.flatnonzero(np.r_[True, flat_s[1:] != flat_s[:-1]]) if len(flat_s) else np.zeros(0, int)
    target = np.eye(len(classes))[y]
    w, b = model.weights.copy(), model.bias.copy()
    v, vb, t = w.copy(), b.copy(), 1.0
    k = len(kept)
    rate, penalty = 1.0, 1.0 / (STRENGTH * len(y))
    bounds = np.cumsum([0, *[len(a) for a, _ in sparse]])[:-1]
    some = np.array([len(a) > 0 for a, _ in sparse])
    for _ in range(STEPS):
        z = numeric @ v[k:] + vb
        if len(flat):
            z[some] += np.add.reduceat(v[flat] * value[:, None], bounds[some], axis=0)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) * weight[:, None]
        grad = np.vstack([np.zeros((k, len(classes))), numeric.T @ g])
        if len(flat):
            grad[flat_s[starts]] = np.add.reduceat(g[row_s] * value_s[:, None], starts, axis=0)
        grad += penalty * v
        if max(np.abs(grad).max(), np.abs(g.sum(axis=0)).max()) < SETTLED * weight.sum():
            break
        new, newb = v - rate * grad, vb - rate * g.sum(axis=0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), newb + (t - 1) / t2 * (newb - b)
        w, b, t = new, newb, t2
    model.weights, model.bias = w, b
    model.trained_at = datetime.now(timezone.utc).isoformat(timespec="seconds")
    return model


def fit_on(df: DataFrame, id_col: str, text_col: str, label_col: str, limit: int = TRAINING_ROWS) -> Router:
    """Fit on at most ``limit`` labelled rows with text, those whose ids have the smallest hash."""
    own = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("texto"), F.col(label_col).alias("clase")).dropDuplicates(["id"])
    sample = features(own.orderBy(F.xxhash64("id"), "id").limit(limit), "texto").toPandas()
    return fit(list(sample["texto"]), list(sample["clase"]), sample[list(FEATURES)].to_numpy(float))


def predict(df: DataFrame, model: Router, id_col: str, text_col: str, explain: bool = False) -> DataFrame:
    """id, materia, materia_explicada, confianza, baja_confianza, probabilidades and, if asked, the terms that spoke most for the class."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = "id bigint, materia string, materia_explicada string, confianza double, baja_confianza boolean, probabilidades map<string,double>" + (", explicacion array<struct<feature:string,contribucion:double,valor:double>>" if explain else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = sorted(m.terms, key=m.terms.get)
        for b in batches:
            sparse, numeric = m.rows(list(b["texto"]), b[list(FEATURES)].to_numpy(float))
            p = m.probabilities(sparse, numeric) if len(b) else np.zeros((0, len(m.classes)))
            best = p.argmax(axis=1) if len(b) else np.zeros(0, int)
            label = [m.classes[k] for k in best]
            sure = p.max(axis=1) if len(b) else np.zeros(0)
            got = {"id": b["id"].to_numpy(), "materia": [x if s >= UNSURE else "otro" for x, s in zip(label, sure)], "materia_explicada": label, "confianza": sure, "baja_confianza": sure < UNSURE, "probabilidades": [dict(zip(m.classes, map(float, r))) for r in p]}
            if explain:
                out = []
                for (at, w), z, k in zip(sparse, numeric, best):
                    parts = [(f"palabra:{names[a]}", float(x * m.weights[a, k]), float(x)) for a, x in zip(at, w)]
                    parts += [(f"estructura:{f}", float(x * m.weights[len(names) + i, k]), float(x)) for i, (f, x) in enumerate(zip(FEATURES, z))]
                    parts = sorted((q for q in parts if q[1] > 0), key=lambda q: (-q[1], q[0]))[:TOP]
                    out.append([{"feature": f, "contribucion": c, "valor": x} for f, c, x in parts])
                got["explicacion"] = out
            yield pd.DataFrame(got)

    own = features(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("texto")), "texto")
    return own.mapInPandas(run, schema)
