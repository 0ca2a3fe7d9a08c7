"""Problem 7: splits that keep records of one source or file together.

``components`` links each record to the smallest record of its source and of its file and contracts the
links by alternating large-star and small-star rounds; each round is two aggregations and two joins, and
the rounds needed grow with the logarithm of the longest chain. A key or root that many rows share is
joined by a broadcast of at most ``HOT`` rows (a key counts as hot only with at least 1/HOT of all rows,
so there can't be more), all others by a shuffle: no group is ever gathered in one task.

``stratified_splits`` places components by grouped iterative stratification. Components that hold at least
1/HOT of the rows, at most HOT of them, are placed first, on the driver; the others are dealt by hash into
blocks of about ``BLOCK`` components, and each block is placed against its part of what is still wanted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sacbe.llm.subjects import SUBJECTS, declared_subject
from sacbe.storage import materialize, table

HOT = 1000
BLOCK = 20_000
NO_SUBJECT = "sin_materia"
#: What stands for "no source" once letters only are left (fixed values), besides blanks.
FILLERS = ("", "sf", "nd", "na", "desconocida", "desconocido", "sinfuente", "sindato", "sindatos", "ninguna", "ninguno", "noaplica", "nodisponible", "pordefinir", "pendiente", "unknown", "none", "null", "nan", "xxx")
_COMBINED = [(base + mark, whole) for mark, pairs in (("́", "aáeéiíoóuúAÁEÉIÍOÓUÚ"), ("̃", "nñNÑ"), ("̈", "uüUÜ")) for base, whole in zip(pairs[::2], pairs[1::2])]


def _composed(c: Column) -> Column:
    for apart, whole in _COMBINED:
        c = F.replace(c, F.lit(apart), F.lit(whole))
    return c


def source_key(column: str) -> Column:
    """One spelling for each source: host in lower case and path; null for fillers.

    Scheme, ``www.``, percent encoding, query, fragment, final slashes and outer blanks make no difference.
    """
    raw = F.regexp_replace(F.col(column), r"^[\s ]+|[\s ]+$", "")
    raw = F.regexp_replace(raw, r"^(?i)[a-z][a-z0-9+.-]*://", "")
    raw = F.regexp_replace(raw, r"[?#].*$", "")
    raw = F.regexp_replace(raw, r"^(?i)www\.", "")
    raw = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    raw = F.regexp_replace(_composed(raw), r"[/\s]+$", "")
    cut = F.instr(raw, "/")
    key = F.when(cut > 0, F.concat(F.lower(raw.substr(F.lit(1), cut - 1)), raw.substr(cut, F.length(raw)))).otherwise(F.lower(raw))
    letters = F.regexp_replace(F.translate(F.lower(F.col(column)), "áéíóú", "aeiou"), "[^a-z]", "")
    return F.when(F.col(column).isNotNull() & ~letters.isin(*FILLERS) & (F.length(key) > 0), key)


def file_key(column: str) -> Column:
    """One spelling for each file: no folder, extension, case, separators, or mark of copy or version; null if nothing is left."""
    name = F.lower(_composed(F.regexp_replace(F.col(column), r"^.*[/\\]", "")))
    name = F.translate(name, "áéíóúüñ", "aeiouun")
    name = F.regexp_replace(name, r"\.[a-z0-9]{1,5}\s*$", "")
    name = F.regexp_replace(name, r"[\s_.-]+", "_")
    name = F.regexp_replace(name, r"^_?(?:(?:copia|copy)(?:_(?:de|of))?_(?:\(\d+\)_)?)+", "")
    for _ in range(2):  # marks may follow each other
        name = F.regexp_replace(name, r"(?:_*\(\d+\)|_+\(?(?:copia|copy)\)?(?:_?\(?\d+\)?)?|_+v(?:er(?:sion)?)?_?\d+|_+(?:final|definitiv[oa]|rev\d*|borrador))_*$", "")
    name = F.regexp_replace(name, r"^_+|_+$", "")
    return F.when(F.length(name) > 0, name)


def records(df: DataFrame) -> DataFrame:
    """The records of the manifest: no comment lines, each id once."""
    return df.filter("archivo is null or not startswith(ltrim(archivo), '#')").filter("fila_id is not null").dropDuplicates(["fila_id"])


def _with_least(df: DataFrame, key: str, value: str, total: int, name: str) -> DataFrame:
    """``df`` with the least ``value`` of each row's ``key``; hot keys by broadcast (at most HOT rows), others by shuffle."""
    least = df.groupBy(key).agg(F.min(value).alias(name), F.count("*").alias("_n"))
    limit = max(total // HOT, 1)
    hot = F.broadcast(least.filter(F.col("_n") > limit).select(F.col(key).alias("_k"), F.col(name).alias("_h")))
    cold = least.filter(F.col("_n") <= limit).select(key, name)
    marked = df.join(hot, F.col(key) == F.col("_k"), "left")
    warm = marked.filter("_k is not null").select(*df.columns, F.col("_h").alias(name))
    return warm.unionByName(marked.filter("_k is null").select(*df.columns).join(cold, key).select(*df.columns, name))


def star_edges(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Links (a, b), a > b: each record and the smallest record with the same key, for each key."""
    total = df.count()
    out = None
    for k in keys:
        own = df.filter(F.col(k).isNotNull()).select(F.col(id_col).alias("a"), F.col(k).alias("k"))
        part = _with_least(own, "k", "a", total, "b").filter("a > b").select("a", "b")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return (r[0], r[1])


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(a, b): each linked node but the smallest of its component, and that smallest node."""
    e = materialize(edges, "edges")
    state = _state(e)
    for _ in range(most_rounds):
        total = max(2 * state[0], 1)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both.select(F.col("a").alias("u"), F.col("b").alias("v")), "u", "v", total, "m").select("v", F.least("m", "u").alias("m"), "u").filter("v > u and v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "large")
        small = _with_least(large.select(F.col("a").alias("u"), F.col("b").alias("v")), "u", "v", total, "m")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b").unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = materialize(small.distinct(), "small")
        now = _state(e)
        if now == state:
            return e
        state = now
    raise RuntimeError("components did not settle")


def groups(manifest: DataFrame) -> DataFrame:
    """fila_id and grupo of every record: records alone in their component are their own group."""
    own = materialize(records(manifest).select("fila_id", source_key("fuente").alias("fuente_k"), file_key("archivo").alias("archivo_k")), "record_keys")
    roots = components(star_edges(own, "fila_id", ["fuente_k", "archivo_k"])).select(F.col("a").alias("fila_id"), F.col("b").alias("grupo"))
    return own.select("fila_id").join(roots, "fila_id", "left").select("fila_id", F.coalesce("grupo", "fila_id").alias("grupo"))


def place(vectors: list[tuple], wanted: dict[str, list[float]]) -> dict:
    """Grouped iterative stratification of components.

    ``vectors``: (group, rows per label); ``wanted``: per split the rows of each label it still needs, which
    is updated. The label with the fewest outstanding rows comes first; its components, largest first, each
    go to the split that needs that label most, then needs most rows at all, then comes first.
    """
    splits = list(wanted)
    labels = len(next(iter(wanted.values())))
    left = [sum(v[k] for _, v in vectors) for k in range(labels)]
    having: list[list[int]] = [sorted((i for i, (_, v) in enumerate(vectors) if v[k]), key=lambda i: (-vectors[i][1][k], -sum(vectors[i][1]), vectors[i][0])) for k in range(labels)]
    done: dict = {}
    while any(x > 0 for x in left):
        k = min((k for k in range(labels) if left[k] > 0), key=lambda k: (left[k], k))
        for i in having[k]:
            group, v = vectors[i]
            if group in done:
                continue
            best = max(splits, key=lambda s: (wanted[s][k], sum(wanted[s]), -splits.index(s)))
            done[group] = best
            for j in range(labels):
                wanted[best][j] -= v[j]
                left[j] -= v[j]
        left[k] = 0
    return done


def stratified_splits(grouped: DataFrame, targets: DataFrame, label: str = "etiqueta") -> DataFrame:
    """fila_id, grupo, particion of each row of ``grouped`` (fila_id, grupo, label).

    ``targets`` is the fixed table of shares. All rows of a group go to one split. Rows are never dropped.
    """
    labels = [*SUBJECTS, NO_SUBJECT]
    shares = {r[0]: float(r[1]) for r in targets.select("particion", "proporcion").orderBy(F.desc("proporcion"), "particion").collect()}
    scale = sum(shares.values())
    vector = materialize(grouped.groupBy("grupo").agg(*[F.count_if(F.col(label) == x).alias(f"n{k}") for k, x in enumerate(labels)], F.count("*").alias("n")), "vectors")
    cols = [f"n{k}" for k in range(len(labels))]
    sums = vector.agg(F.count("*"), F.sum("n"), *[F.sum(c) for c in cols]).first()
    if not sums[0]:
        return grouped.select("fila_id", "grupo", F.lit(None).cast("string").alias("particion"))
    wanted = {s: [p / scale * x for x in sums[2:]] for s, p in shares.items()}
    large = F.col("n") * HOT >= F.lit(int(sums[1]))
    few = vector.filter(large & (F.col("n") > 1))
    first = place([(r["grupo"], [r[c] for c in cols]) for r in few.collect()], wanted)
    rest = vector.filter(~(large & (F.col("n") > 1)))
    blocks = max(1, -(-int(sums[0]) // BLOCK))
    part = {s: [x / blocks for x in v] for s, v in wanted.items()}

    def run(x: pd.DataFrame) -> pd.DataFrame:
        got = place(list(zip(x["grupo"].tolist(), x[cols].to_numpy().tolist())), {s: list(v) for s, v in part.items()})
        return pd.DataFrame({"grupo": list(got), "particion": list(got.values())})

    placed = rest.withColumn("_b", F.pmod(F.xxhash64("grupo"), F.lit(blocks))).groupBy("_b").applyInPandas(run, "grupo bigint, particion string")
    if first:
        known = grouped.sparkSession.createDataFrame(list(first.items()), "grupo bigint, particion string")
        placed = placed.unionByName(known)
        hot = F.broadcast(known.withColumnRenamed("particion", "_p").withColumnRenamed("grupo", "_g"))
        both = grouped.join(hot, F.col("grupo") == F.col("_g"), "left")
        warm = both.filter("_g is not null").select("fila_id", "grupo", F.col("_p").alias("particion"))
        return warm.unionByName(both.filter("_g is null").select("fila_id", "grupo").join(placed, "grupo").select("fila_id", "grupo", "particion"))
    return grouped.select("fila_id", "grupo").join(placed, "grupo").select("fila_id", "grupo", "particion")


def p7_splits(spark, folder: str) -> DataFrame:
    """Every record of the manifest with its group and split."""
    manifest = table(spark, folder, "manifiesto")
    label = records(manifest).select("fila_id", F.coalesce(declared_subject("materia"), F.lit(NO_SUBJECT)).alias("etiqueta"))
    grouped = materialize(groups(manifest).join(label, "fila_id"), "grouped")
    return stratified_splits(grouped, table(spark, folder, "particiones_objetivo"))


def p7_balance(spark, folder: str) -> DataFrame:
    """Rows of each split and subject, with the share reached and the share wanted."""
    manifest = table(spark, folder, "manifiesto")
    label = records(manifest).select("fila_id", F.coalesce(declared_subject("materia"), F.lit(NO_SUBJECT)).alias("materia"))
    counted = p7_splits(spark, folder).join(label, "fila_id").groupBy("materia", "particion").agg(F.count("*").alias("filas"))
    total = counted.groupBy("materia").agg(F.sum("filas").alias("todas"))
    return counted.join(total, "materia").join(table(spark, folder, "particiones_objetivo"), "particion").select("materia", "particion", "filas", (F.col("filas") / F.col("todas")).alias("parte"), "proporcion")


def p7_found(spark, folder: str) -> DataFrame:
    """Every record and the smallest record it must stay with."""
    return groups(table(spark, folder, "manifiesto")).distinct()
