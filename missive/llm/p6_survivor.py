"""Problem 6: one surviving value for each field of a group of duplicate rows.

Groups are the rows connected through a pointer column; roots are found by
pointer doubling over the few rows that are both parent and child.

The survivor of a field is elected by a weighted consensus of its usable
values.  Equal values pool their weight.  A value with more than half of the
weight wins every column of any alignment, so such groups are decided by an
aggregate and their texts never move.  The others are aligned progressively,
token by token, heaviest value first; each column's heaviest token enters the
consensus, and the existing value closest to it is emitted.  A group larger
than a block is settled as a tournament of blocks, so no task holds a whole
hot group.

``prefer`` gives lexicographic weights: each candidate outweighs all behind it
together, so the first in the order always holds more than half.

Defined results: a field without usable value has no row; a group whose rows
form a cycle, or whose root is missing, has no root and no rows; ties end at
the lowest id; a source without rank is trusted least, a null time is oldest.
"""

from __future__ import annotations

import difflib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from missive.runtime import durable

BLOCK = 16
FIELDS = ("description", "salary", "posted_at", "scrape_status")
#: Dates that stand for no date.
DEFAULT_DATES = ("0001-01-01", "1900-01-01", "1970-01-01", "2000-01-01", "2099-12-31", "9999-12-31")


def groups(rows: DataFrame, key: str = "id", pointer: str = "duplicate_of") -> DataFrame:
    """(key, root_id) of every row of a group of two or more."""
    edges = rows.where(F.col(pointer).isNotNull()).select(F.col(key).alias("id"), F.col(pointer).alias("up"))
    parents = edges.select(F.col("up").alias("id")).distinct()
    # Chains: parents that themselves point on.  Usually few.
    chain = durable(edges.join(parents, "id", "left_semi"))
    n = chain.count()
    for _ in range(math.ceil(math.log2(n)) + 1 if n else 0):
        hop = chain.select(F.col("id").alias("up"), F.col("up").alias("on"))
        step = durable(
            chain.join(hop, "up", "left").select(
                "id", F.coalesce("on", "up").alias("up"), F.col("on").isNotNull().alias("moved")
            )
        )
        chain = step.select("id", "up")
        if step.where("moved").isEmpty():
            break
    ends = chain.select(F.col("id").alias("up"), F.col("up").alias("end"))
    rooted = edges.join(ends, "up", "left").select("id", F.coalesce("end", "up").alias("root_id"))
    roots = rows.where(F.col(pointer).isNull()).select(F.col(key).alias("root_id"))
    real = roots.join(rooted.select("root_id").distinct(), "root_id", "left_semi")
    members = rooted.join(real, "root_id", "left_semi").select("id", "root_id")
    return members.unionByName(real.select(F.col("root_id").alias("id"), "root_id"))


def _real_date(value: Column) -> Column:
    shaped = value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(shaped & ~value.isin(*DEFAULT_DATES), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date"))


def candidates(
    job: DataFrame, bad_descriptions: DataFrame, trust: DataFrame, member: DataFrame | None = None, texts: bool = True
) -> DataFrame:
    """Usable values of grouped rows: root_id, field, job_id, value, trust_rank, received_at.

    Without ``texts`` the value is null, and no text is shuffled.

    ``bad_descriptions``: ids whose description is no posting or was cut;
    ``member``: the groups, if they are at hand.
    """
    member = (groups(job) if member is None else member).withColumnRenamed("id", "job_id")
    ranks = trust.groupBy("source").agg(F.min("trust_rank").alias("trust_rank"))
    posted = _real_date(F.col("posted_at"))
    usable = {
        "description": F.col("description").rlike(r"\S"),
        "salary": F.col("salary").rlike(r"[1-9]"),
        "posted_at": posted.isNotNull() & (posted <= F.to_date("received_at")),
        "scrape_status": F.col("scrape_status") == "ok",
    }
    # What a value is worth is settled before the joins, so that they move flags.
    rows = (
        job.select(
            F.col("id").alias("job_id"), "source", "received_at", *(ok.alias(f"ok_{f}") for f, ok in usable.items()),
            *(FIELDS if texts else ()),
        )
        .join(member, "job_id")
        .join(ranks, "source", "left")
        .join(bad_descriptions.select(F.col("id").alias("job_id"), F.lit(True).alias("bad")).distinct(), "job_id", "left")
        .withColumn("ok_description", F.col("ok_description") & F.col("bad").isNull())
    )
    value = lambda f: F.col(f) if texts else F.lit(None).cast("string")
    entries = F.array(
        *(F.struct(F.lit(f).alias("field"), F.col(f"ok_{f}").alias("ok"), value(f).alias("value")) for f in FIELDS)
    )
    return (
        rows.select("root_id", "job_id", "trust_rank", "received_at", F.explode(entries).alias("e"))
        .select("root_id", "job_id", "trust_rank", "received_at", "e.*")
        .where("ok").drop("ok")
    )


def closest(values: list[str], weights: list[float]) -> int:
    """Index of the value closest to the weighted token consensus of all."""
    order = sorted(range(len(values)), key=lambda i: (-weights[i], i))
    tokens = [v.split() for v in values]
    columns: list[dict[str | None, float]] = [{t: weights[order[0]]} for t in tokens[order[0]]]
    voted = weights[order[0]]

    def leader(column: dict[str | None, float]) -> str | None:
        return max(column.items(), key=lambda x: (x[1], x[0] is not None, x[0] or ""))[0]

    for i in order[1:]:
        w, mine = weights[i], tokens[i]
        spine = [next(iter(sorted((t for t in c if t is not None), key=lambda t: -c[t]))) for c in columns]
        match = difflib.SequenceMatcher(None, spine, mine, autojunk=False)
        merged: list[dict[str | None, float]] = []
        for kind, a, b, c, d in match.get_opcodes():
            for k in range(max(b - a, d - c)):
                old = columns[a + k] if a + k < b else {None: voted}
                new = mine[c + k] if c + k < d else None
                merged.append(old | {new: old.get(new, 0.0) + w})
        columns, voted = merged, voted + w
    consensus = [t for t in map(leader, columns) if t is not None]
    near = [difflib.SequenceMatcher(None, consensus, t, autojunk=False).ratio() for t in tokens]
    return max(range(len(values)), key=lambda i: (near[i], weights[i], -i))


@F.arrow_udf(LongType())
def _elect(blocks: pa.Array) -> pa.Array:
    """Job id of the winner of each block of (job_id, value, weight)."""
    out = []
    for block in blocks.to_pylist():
        block.sort(key=lambda e: (-e["weight"], e["job_id"]))
        out.append(block[closest([e["value"] for e in block], [e["weight"] for e in block])]["job_id"])
    return pa.array(out, pa.int64())


def consensus(values: DataFrame, weight: Column) -> DataFrame:
    """(root_id, field, job_id): the survivor by weighted token consensus."""
    pooled = (
        values.select("root_id", "field", "job_id", "value", weight.cast("double").alias("weight"))
        .groupBy("root_id", "field", "value").agg(F.min("job_id").alias("job_id"), F.sum("weight").alias("weight"))
    )
    pooled = durable(pooled)
    totals = pooled.groupBy("root_id", "field").agg(
        F.sum("weight").alias("total"), F.max("weight").alias("top"), F.count("*").alias("n"),
        F.min_by("job_id", F.struct(-F.col("weight"), F.col("job_id"))).alias("leader"),
    )
    settled = (F.col("n") == 1) | (2 * F.col("top") > F.col("total"))
    done = totals.where(settled).select("root_id", "field", F.col("leader").alias("job_id"))
    open_ = durable(pooled.join(totals.where(~settled).select("root_id", "field", "n"), ["root_id", "field"]))
    while not open_.isEmpty():
        block = F.pmod(F.xxhash64("job_id"), F.ceil(F.col("n") / BLOCK).cast("bigint"))
        won = (
            open_.withColumn("block", block).groupBy("root_id", "field", "block")
            .agg(F.collect_list(F.struct("job_id", "value", "weight")).alias("entries"), F.sum("weight").alias("weight"))
            .select("root_id", "field", "entries", "weight", _elect("entries").alias("job_id"))
            .select(
                "root_id", "field", "job_id", "weight",
                F.filter("entries", lambda e: e["job_id"] == F.col("job_id"))[0]["value"].alias("value"),
            )
        )
        left = won.groupBy("root_id", "field").agg(F.count("*").alias("n"))
        won = durable(won.join(left, ["root_id", "field"]))
        done = done.unionByName(won.where("n = 1").select("root_id", "field", "job_id"))
        open_ = won.where("n > 1")
    return done


def prefer(values: DataFrame) -> DataFrame:
    """The consensus under lexicographic weights: trust, then recency, then lowest id.

    Each candidate outweighs all behind it, so the leader has the majority and
    the election ends at its first step, a map-side combined minimum.
    """
    order = F.struct(
        F.coalesce("trust_rank", F.lit(2**31 - 1)).alias("rank"),
        (-F.coalesce(F.unix_micros("received_at"), F.lit(-(2**62)))).alias("age"),
        F.col("job_id"),
    )
    return values.groupBy("root_id", "field").agg(F.min(order).alias("first")).select("root_id", "field", "first.job_id")


def found(job: DataFrame, bad_descriptions: DataFrame, trust: DataFrame, member: DataFrame | None = None) -> DataFrame:
    return prefer(candidates(job, bad_descriptions, trust, member, texts=False))


def merged(job: DataFrame, bad_descriptions: DataFrame, trust: DataFrame, member: DataFrame | None = None) -> DataFrame:
    """Survivors by consensus, weighted by trust: root_id, field, job_id."""
    weight = 1 / F.sqrt(F.coalesce(F.col("trust_rank").cast("double"), F.lit(1000.0)))
    return consensus(candidates(job, bad_descriptions, trust, member), weight)
