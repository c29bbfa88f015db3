"""Problem 9: packing texts into containers of fixed token capacity.

A text over the capacity is cut into full containers and a rest; nothing else
is split.  Then, per capacity, large-item matching:

* pieces above a third of the capacity go at most two to a container; each,
  largest first, is matched with the largest such piece that still fits;
* smaller pieces, largest first, go to the tightest remaining gap that takes
  them, and open a new container only if no gap does.

Piece sizes are whole token counts, so the plan is made on the *histogram* of
sizes (at most ``capacity`` rows however many texts there are) with runs of
identical containers, and each text finds its place by its rank among the
pieces of its size.  The rank is a two-level count (salted partitions plus
offsets), so a size shared by a third of all rows is spread over all tasks.

Defined results: a null or empty text has no tokens and takes no container
(``container_id`` null); a capacity below 1 or null is ignored; repeated
capacity rows count once.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missive.llm.p8_encode import VOCABULARY_DIR, token_count
from missive.runtime import durable

RANK_SALTS = 64

Run = tuple[int, int, int, int]  # size, items, first container, items per container


class _Gaps:
    """Groups of identical open containers by free space, tightest first."""

    def __init__(self) -> None:
        self.free: list[int] = []
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def add(self, free: int, first: int, count: int) -> None:
        if free <= 0 or count <= 0:
            return
        if free not in self.groups:
            insort(self.free, free)
            self.groups[free] = []
        self.groups[free].append((first, count))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The tightest group with at least ``least`` free: (free, first, count)."""
        at = bisect_left(self.free, least)
        if at == len(self.free):
            return None
        free = self.free[at]
        first, count = self.groups[free].pop()
        if not self.groups[free]:
            del self.groups[free]
            self.free.pop(at)
        return free, first, count


def plan(capacity: int, histogram: dict[int, int], full: int = 0) -> tuple[list[Run], int]:
    """Runs that place every piece of the histogram, and the number of containers.

    ``full`` containers are already taken by cut pieces that fill one each.
    Work and result depend on the number of different sizes, not of pieces.
    """
    runs: list[Run] = []
    used = full
    gaps = _Gaps()

    def place(size: int, items: int, first: int, each: int) -> None:
        runs.append((size, items, first, each))

    left = {s: n for s, n in histogram.items() if n > 0}
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        n = left[size]
        # The largest large piece that fits beside it, itself included.
        at = bisect_left(large, capacity - size + 1) - 1
        mate = large[at] if at >= 0 else None
        if mate is None:
            place(size, n, used, 1)
            gaps.add(capacity - size, used, n)
            used += n
            left[size] = 0
        elif mate == size:
            pairs = n // 2
            if pairs:
                place(size, 2 * pairs, used, 2)
                gaps.add(capacity - 2 * size, used, pairs)
                used += pairs
            left[size] = n % 2
            if left[size]:
                at -= 1
                if at >= 0:
                    mate = large[at]
                    place(size, 1, used, 1)
                    place(mate, 1, used, 1)
                    gaps.add(capacity - size - mate, used, 1)
                    left[mate] -= 1
                    if not left[mate]:
                        large.pop(at)
                else:
                    place(size, 1, used, 1)
                    gaps.add(capacity - size, used, 1)
                used += 1
                left[size] = 0
        else:
            pairs = min(n, left[mate])
            place(size, pairs, used, 1)
            place(mate, pairs, used, 1)
            gaps.add(capacity - size - mate, used, pairs)
            used += pairs
            left[size] -= pairs
            left[mate] -= pairs
            if not left[mate]:
                large.pop(at)
        if not left[size]:
            large.pop()

    for size in sorted((s for s in left if 3 * s <= capacity and left[s]), reverse=True):
        n = left[size]
        while n:
            found = gaps.take(size)
            if found is None:
                each = capacity // size
                whole, rest = divmod(n, each)
                if whole:
                    place(size, whole * each, used, each)
                    gaps.add(capacity - each * size, used, whole)
                    used += whole
                if rest:
                    place(size, rest, used, rest)
                    gaps.add(capacity - rest * size, used, 1)
                    used += 1
                break
            free, first, count = found
            each = free // size
            whole = min(count, n // each)
            rest = 0
            if whole:
                place(size, whole * each, first, each)
                gaps.add(free - each * size, first, whole)
                n -= whole * each
            if whole < count and 0 < n < each:
                rest = n
                place(size, rest, first + whole, rest)
                gaps.add(free - rest * size, first + whole, 1)
                n = 0
            gaps.add(free, first + whole + (rest > 0), count - whole - (rest > 0))
    return runs, used


def sized(documents: DataFrame, key: str, text: str, vocabulary_dir: str) -> DataFrame:
    """(key, n_tokens) of each document, computed once and made durable."""
    return durable(
        documents.select(F.col(key), F.coalesce(token_count(F.col(text), vocabulary_dir), F.lit(0)).alias("n_tokens"))
    )


def pack(
    documents: DataFrame,
    capacities: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary_dir: str = VOCABULARY_DIR,
) -> DataFrame:
    """One row per piece: pack_name, doc_id, piece_no, token_start, n_tokens, container_id."""
    sizes = sized(documents, key, text, vocabulary_dir)
    # A fixed table of a few container kinds, named and typed by its owner.
    kinds = [
        (r.pack_name, int(r.capacity_tokens))
        for r in capacities.where("capacity_tokens >= 1 AND pack_name IS NOT NULL")
        .groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity_tokens")).collect()
    ]
    columns = ["pack_name", key, "piece_no", "token_start", "n_tokens", "container_id"]
    if not kinds:
        return sizes.select(
            F.lit("").alias("pack_name"), key, F.lit(0).alias("piece_no"), F.lit(0).alias("token_start"),
            "n_tokens", F.lit(0).cast("bigint").alias("container_id"),
        ).where("false").select(*columns)
    kind_rows = F.array(*(F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("capacity")) for n, c in kinds))
    n_full = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / F.col("capacity")).cast("int")
    per_kind = (
        sizes.withColumn("kind", F.explode(kind_rows)).select(key, "n_tokens", "kind.*")
        .withColumn("n_full", n_full)
        .withColumn("rest", F.col("n_tokens") - F.col("n_full") * F.col("capacity"))
        .withColumn("salt", F.pmod(F.xxhash64(key), F.lit(RANK_SALTS)).cast("int"))
    )
    # Level one of the ranks: pieces by (kind, size, salt); full pieces by (kind, salt).
    counts = durable(
        per_kind.groupBy("pack_name", "capacity", "rest", "salt")
        .agg(F.count("*").alias("n"), F.sum("n_full").cast("bigint").alias("n_cut"))
    )
    by_size = Window.partitionBy("pack_name", "rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    by_pack = Window.partitionBy("pack_name").orderBy("rest", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "pack_name", "rest", "salt",
        F.coalesce(F.sum("n").over(by_size), F.lit(0)).alias("rank_from"),
        F.coalesce(F.sum("n_cut").over(by_pack), F.lit(0)).alias("full_from"),
    )

    def plan_kind(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, name = int(pdf.capacity.iloc[0]), pdf.pack_name.iloc[0]
        histogram = {int(s): int(n) for s, n in zip(pdf.rest, pdf.n) if s > 0}
        runs, _ = plan(capacity, histogram, int(pdf.n_cut.sum()))
        seen: dict[int, int] = {}
        rows = []
        for size, items, first, each in runs:
            start = seen.get(size, 0)
            rows.append((name, size, start, start + items, first, each))
            seen[size] = start + items
        return pd.DataFrame(rows, columns=["pack_name", "rest", "rank_start", "rank_end", "first_container", "per_container"])

    histogram = counts.groupBy("pack_name", "capacity", "rest").agg(F.sum("n").alias("n"), F.sum("n_cut").alias("n_cut"))
    runs = histogram.groupBy("pack_name").applyInPandas(
        plan_kind,
        "pack_name string, rest int, rank_start bigint, rank_end bigint, first_container bigint, per_container bigint",
    )
    runs_of_size = runs.groupBy("pack_name", "rest").agg(
        F.array_sort(F.collect_list(F.struct("rank_end", "rank_start", "first_container", "per_container"))).alias("runs")
    )
    # Level two: the place within (kind, size, salt); hot sizes are cut by salt.
    within = Window.partitionBy("pack_name", "rest", "salt").orderBy(key)
    ranked = (
        per_kind.withColumn("at", F.row_number().over(within) - 1)
        .withColumn(
            "cut_at",
            F.coalesce(F.sum("n_full").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .join(offsets, ["pack_name", "rest", "salt"])
        .join(runs_of_size, ["pack_name", "rest"], "left")
        .withColumn("rank", F.col("rank_from") + F.col("at"))
        .withColumn("run", F.filter("runs", lambda r: r["rank_end"] > F.col("rank"))[0])
    )
    last = F.struct(
        F.col("n_full").alias("piece_no"),
        (F.col("n_full") * F.col("capacity")).alias("token_start"),
        F.col("rest").alias("n_tokens"),
        (
            F.col("run.first_container")
            + F.floor((F.col("rank") - F.col("run.rank_start")) / F.col("run.per_container"))
        ).cast("bigint").alias("container_id"),
    )
    full = F.transform(
        F.sequence(F.lit(1), F.col("n_full")),
        lambda i: F.struct(
            (i - 1).alias("piece_no"),
            ((i - 1) * F.col("capacity")).alias("token_start"),
            F.col("capacity").alias("n_tokens"),
            (F.col("full_from") + F.col("cut_at") + i - 1).cast("bigint").alias("container_id"),
        ),
    )
    pieces = F.when(F.col("n_full") > 0, F.concat(full, F.array(last))).otherwise(F.array(last))
    return (
        ranked.select("pack_name", key, F.explode(pieces).alias("p")).select("pack_name", key, "p.*").select(*columns)
    )


def pack_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, fill and the least number of containers possible."""
    kinds = capacities.where("capacity_tokens >= 1").groupBy("pack_name").agg(
        F.max("capacity_tokens").alias("capacity_tokens")
    )
    return (
        packed.where("n_tokens > 0").groupBy("pack_name")
        .agg(
            F.sum("n_tokens").alias("tokens"),
            (F.max("container_id") + 1).alias("containers"),
            F.count("*").alias("pieces"),
        )
        .join(kinds, "pack_name")
        .withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")))
        .withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4))
    )
