"""Problem 8: documents packed into containers of fixed capacity.

Bin completion: the largest item left gets the undominated fillings of its container, fullest first; a
branch is cut when the waste so far exceeds what a solution better than the incumbent may waste. The
incumbent starts as best-fit decreasing, and the search ends when the lower bound is met, when no better
solution is left, or after NODES fillings tried; each row tells whether its block is proved to be packed in
as few containers as possible. Items are dealt by hash into blocks of about BLOCK items, packed independently, so a
block wastes at most part of one container more than the whole would.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sacbe.llm.tokens import TOKENIZER, token_sizes
from sacbe.storage import materialize, table

BLOCK = 2000
NODES = 6000
#: Fillings of one to three items tried before all others, and the most waste in one container that these are looked for.
WIDTH, WASTE = 3, 64
_END = object()


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: containers as lists of positions in ``sizes`` (sorted, largest first)."""
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    out: list[list[int]] = []
    for i, s in enumerate(sizes):
        at = bisect_right(room, (s, -1))
        if at < len(room):
            left, k = room.pop(at)
            out[k].append(i)
        else:
            left, k = capacity, len(out)
            out.append([i])
        entry = (left - s, k)
        room.insert(bisect_right(room, entry), entry)
    return out


class _Stock:
    """Sizes left, as counts and as a bit set and its mirror image, for sums of one to three items."""

    def __init__(self, sizes: list[int], capacity: int):
        self.capacity = capacity
        self.count = [0] * (capacity + 1)
        self.bits = self.mirror = 0
        for s in sizes:
            self.add(s)

    def add(self, s: int) -> None:
        self.count[s] += 1
        if self.count[s] == 1:
            self.bits |= 1 << s
            self.mirror |= 1 << (self.capacity - s)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            self.bits &= ~(1 << s)
            self.mirror &= ~(1 << (self.capacity - s))

    def largest(self, most: int) -> int:
        """Largest size left of at most ``most``, or 0."""
        return max((self.bits & ((2 << most) - 1)).bit_length() - 1, 0) if most > 0 else 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two sizes left with this sum, the larger as large as possible."""
        both = self.bits & (self.mirror >> (self.capacity - total))  # bit s: s and total - s are left
        if total % 2 == 0 and self.count[total // 2] < 2:
            both &= ~(1 << (total // 2))
        if not both:
            return None
        s = both.bit_length() - 1
        return s, total - s

    def fillings(self, room: int, waste: int) -> Iterator[tuple[int, ...] | None]:
        """Every undominated filling of ``room`` that wastes at most ``waste``; None for one tried and found dominated.

        At most WIDTH of few items that are fast to find come first, then all others, fullest first. They are
        found one by one as the search asks for them: most are never needed.
        """
        one = self.largest(room)
        if not one:
            if room <= waste:
                yield ()
            return
        if one == room:
            yield (one,)  # dominates all others
            return
        given: set[tuple[int, ...]] = set()
        for total in range(room, max(one - 1, room - min(waste, WASTE) - 1), -1):
            p = (one,) if total == one else self.pair(total) or (self._three(total) if not given else None)
            if p:
                given.add(tuple(sorted(p, reverse=True)))
                yield p
                if len(given) == WIDTH:
                    break
        if not given:
            g = self._greedy(room)
            if room - sum(g) <= waste:
                given.add(g)
                yield g
        yield from (None if self._dominated(f, room) else f for f in self._all(room, waste) if f not in given)

    def _all(self, room: int, waste: int) -> Iterator[tuple[int, ...]]:
        """Every filling of ``room`` that wastes at most ``waste``, fullest first, its items from the largest."""
        sizes = [s for s in range(1, room + 1) if self.bits >> s & 1]
        reach = [1]  # bit t of reach[i]: the i smallest sizes have a sum of t
        for s in sizes:
            r = reach[-1]
            for _ in range(min(self.count[s], room // s)):
                r |= r << s & ((2 << room) - 1)
            reach.append(r)

        def made(i: int, total: int) -> Iterator[tuple[int, ...]]:
            if not total:
                yield ()
                return
            while reach[i] >> total & 1:
                i -= 1
                s = sizes[i]
                for c in range(min(self.count[s], total // s), 0, -1):
                    for rest in made(i, total - c * s):
                        yield (s,) * c + rest

        for total in range(room, max(room - waste, 1) - 1, -1):
            yield from made(len(sizes), total)

    def _dominated(self, filling: tuple[int, ...], room: int) -> bool:
        """Whether a size left fits instead of smaller items of the filling (or of none), or of several of the same sum."""
        some, several = 1, 0  # sums of any items, and of two or more
        for s in filling:
            several |= (some & ~1 | several) << s
            some |= some << s
        gap = room - sum(filling)
        larger = 0
        for g in range(1, gap + 1):
            larger |= some << g
        for s in filling:
            self.take(s)
        left = self.bits
        for s in filling:
            self.add(s)
        return bool(left & (larger | several))

    def _three(self, total: int) -> tuple[int, ...] | None:
        """Three sizes left with this sum, among the six largest for the first."""
        bits, mirror, capacity, count = self.bits, self.mirror, self.capacity, self.count
        smallest = (bits & -bits).bit_length() - 1
        if smallest < 1 or 3 * smallest > total:
            return None
        below = bits & ((2 << (total - 2 * smallest)) - 1)
        for _ in range(6):
            first = below.bit_length() - 1
            if first < 1:
                return None
            rest = total - first
            shift = capacity - rest
            if count[first] > 1:
                both = bits & (mirror >> shift)
            else:  # the only one of its size is taken
                both = bits & ~(1 << first) & ((mirror & ~(1 << (capacity - first))) >> shift)
            if both:
                half = rest // 2
                if rest == 2 * half and count[half] - (half == first) < 2:
                    both &= ~(1 << half)
                if both:
                    second = both.bit_length() - 1
                    return first, second, rest - second
            below &= (1 << first) - 1
        return None

    def _greedy(self, room: int) -> tuple[int, ...]:
        out: list[int] = []
        while s := self.largest(room):
            self.take(s)
            out.append(s)
            room -= s
        for s in out:
            self.add(s)
        return tuple(out)


def fewest(sizes: list[int], capacity: int) -> int:
    """Lower bound of containers: for each k, items above capacity - k stand alone, items above half each need one, and those from k on must fit beside them."""
    up = sorted(sizes)
    sums = [0, *accumulate(up)]
    best = -(-sums[-1] // capacity)
    half = bisect_right(up, capacity // 2)
    for k in sorted(set(up[:half])):
        a, b = bisect_left(up, k), bisect_right(up, capacity - k)
        room = (b - half) * capacity - (sums[b] - sums[half]) if b > half else 0
        small = sums[half] - sums[a]
        best = max(best, len(up) - max(b, half) + max(b - half, 0) + max(0, -(-(small - room) // capacity)))
    return best


def bin_completion(sizes: list[int], capacity: int, nodes: int | None = NODES) -> tuple[list[list[int]], bool]:
    """Containers as lists of sizes, for sizes of 1 to ``capacity``, and whether none fewer are possible.

    That is proved if the lower bound is met or the search for fewer ends without one. With no limit of
    ``nodes`` (None) it always is.
    """
    ordered = sorted(sizes, reverse=True)
    best = [[ordered[i] for i in b] for b in best_fit(ordered, capacity)]
    total = sum(ordered)
    least = fewest(ordered, capacity)
    left = float("inf") if nodes is None else nodes
    while len(best) > least:
        found, used = _search(ordered, capacity, (len(best) - 1) * capacity - total, left)
        left -= used
        if found is None:
            return best, left > 0
        best = found
    return best, True


def _search(ordered: list[int], capacity: int, waste: int, nodes: float) -> tuple[list[list[int]] | None, int]:
    """Depth-first search for a packing that wastes at most ``waste``; None if there's none or the nodes are used up."""
    stock = _Stock(ordered, capacity)
    left = len(ordered)
    path: list[tuple[list[int], int, Iterator[tuple[int, ...] | None]]] = []  # container, waste allowed before it, fillings not tried
    used = 0

    def opened() -> tuple[int, Iterator[tuple[int, ...] | None]]:
        top = stock.largest(capacity)
        stock.take(top)
        return top, stock.fillings(capacity - top, waste)

    top, options = opened()
    while used < nodes:
        used += 1
        fill = next(options, _END)
        if fill is None:
            continue
        if fill is not _END:
            for s in fill:
                stock.take(s)
            left -= 1 + len(fill)
            path.append(([top, *fill], waste, options))
            waste -= capacity - top - sum(fill)
            if not left:
                return [p[0] for p in path], used
            top, options = opened()
            continue
        if not path:
            break
        stock.add(top)
        (top, *fill), waste, options = path.pop()
        for s in fill:
            stock.add(s)
        left += 1 + len(fill)
    return None, used


def pack(ids: np.ndarray, tokens: np.ndarray, capacity: int, first: int = 0) -> pd.DataFrame:
    """Pieces of items in containers numbered from ``first``: id, parte, desde, tokens, caja, probada (no fewer containers are possible).

    An item above the capacity is cut into full pieces, each a container of its own, and a rest that is
    packed like any other item. Items of size 0 go into the first container.
    """
    ids, tokens = np.asarray(ids, dtype=np.int64), np.asarray(tokens, dtype=np.int64)
    full = tokens // capacity
    rest = tokens - full * capacity
    n_full = int(full.sum())
    owner = np.repeat(np.arange(len(ids)), full)
    part = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)
    frames = [pd.DataFrame({"id": ids[owner], "parte": part, "desde": part * capacity, "tokens": np.full(n_full, capacity), "caja": first + np.arange(n_full)})]
    box = first + n_full
    waiting: dict[int, list[int]] = {}
    for i in np.argsort(ids, kind="stable")[::-1]:
        if rest[i]:
            waiting.setdefault(int(rest[i]), []).append(int(i))
    at, boxes = [], []
    content_of, proved = bin_completion([int(r) for r in rest if r], capacity)
    for k, content in enumerate(content_of):
        for s in content:
            at.append(waiting[s].pop())
            boxes.append(box + k)
    empty = np.flatnonzero(tokens == 0)
    at += empty.tolist()
    boxes += [first] * len(empty)
    a = np.array(at, dtype=np.int64)
    frames.append(pd.DataFrame({"id": ids[a], "parte": full[a], "desde": full[a] * capacity, "tokens": rest[a], "caja": np.array(boxes, dtype=np.int64)}))
    return pd.concat(frames, ignore_index=True).assign(probada=proved)


def pack_documents(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """contenedor, caja, id, parte, desde, tokens, probada for every row of ``sizes`` (id, tokens) and every container type.

    ``containers`` is the fixed table of types (null and non-positive capacities are left out). Repeated
    ids are one item; null sizes count as 0.
    """
    types = [(r[0], int(r[1])) for r in containers.distinct().collect() if r[0] is not None and r[1] and r[1] > 0]
    items = materialize(sizes.select("id", F.coalesce("tokens", F.lit(0)).alias("tokens")).dropDuplicates(["id"]), "sizes")
    blocks = max(1, -(-items.count() // BLOCK))
    kinds = F.explode(F.array(*[F.struct(F.lit(a).alias("contenedor"), F.lit(b).alias("capacidad")) for a, b in types]))
    dealt = items.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("_k", kinds).select("id", "tokens", "_b", "_k.contenedor", "_k.capacidad")

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        got = pack(x["id"].to_numpy(), x["tokens"].to_numpy(), int(key[2]), first=int(key[1]) << 32)
        got.insert(0, "contenedor", key[0])
        return got

    return dealt.groupBy("contenedor", "_b", "capacidad").applyInPandas(run, "contenedor string, id bigint, parte int, desde bigint, tokens bigint, caja bigint, probada boolean")


def p8_packing(spark, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every document in containers of every type."""
    sizes = token_sizes(table(spark, folder, "documents"), "doc_id", "text", tokenizer)
    return pack_documents(sizes, table(spark, folder, "contenedores")).withColumnRenamed("id", "doc_id")


def p8_waste(spark, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per container type: containers used, the least any packing could use, the share of room left over, blocks, and blocks proved to use as few as possible."""
    packed = p8_packing(spark, folder, tokenizer).groupBy("contenedor", "caja").agg(F.sum("tokens").alias("t"), F.any_value("probada").alias("probada"))
    per_block = packed.groupBy("contenedor", F.shiftright("caja", 32).alias("bloque")).agg(F.count("*").alias("cajas"), F.sum("t").alias("tokens"), F.any_value("probada").alias("probada"))
    total = per_block.groupBy("contenedor").agg(F.sum("cajas").alias("cajas"), F.sum("tokens").alias("tokens"), F.count("*").alias("bloques"), F.count_if("probada").alias("bloques_probados"))
    kinds = table(spark, folder, "contenedores").filter("contenedor is not null and capacidad_tokens > 0").distinct()
    return total.join(F.broadcast(kinds), "contenedor").select("contenedor", "cajas", F.ceil(F.col("tokens") / F.col("capacidad_tokens")).alias("minimo"), "tokens", (1 - F.col("tokens") / (F.col("cajas") * F.col("capacidad_tokens"))).alias("sobra"), "bloques", "bloques_probados")
