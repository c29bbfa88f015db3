"""Folding event logs into entity state.

Statuses advance by rank and never fall back, so the fold is an aggregate
(``max_by`` of a struct) and order only matters for ties, which end at the
earliest event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.operators import dedup


def rank_of(label: Column, ranks: dict[str, int]) -> Column:
    """Rank of a label; 0 for unknown ones."""
    pairs = [x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*pairs), lambda k, _: k == label)), F.lit(0)), F.lit(0))


def fold_status(events: DataFrame, entity: str, label: str, order: list[str], ranks: dict[str, int], closed: set[str]) -> DataFrame:
    """entity, status (highest rank, earliest event of it), n_events, closed."""
    rank = rank_of(F.col(label), ranks)
    first = events.groupBy(entity, label).agg(F.min(F.struct(*order)).alias("at"), F.count("*").alias("n"))
    return (
        first.groupBy(entity)
        .agg(F.min_by(label, F.struct((-rank).alias("r"), F.col("at"))).alias("status"), F.sum("n").alias("n_events"))
        .withColumn("closed", F.col("status").isin(*sorted(closed)))
    )


def last_event(events: DataFrame, entity: str, order: list[str], *columns: str) -> DataFrame:
    """entity with ``columns`` of its last event in ``order``; later ids win ties."""
    return events.groupBy(entity).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("e")).select(entity, "e.*")


def sticky(events: DataFrame, entity: str, column: str, order: list[str]) -> DataFrame:
    """entity with its last non-empty value of a column."""
    filled = events.where((F.col(column) != "") & F.col(column).isNotNull())
    return filled.groupBy(entity).agg(F.max_by(column, F.struct(*order)).alias(column))


def timeline(events: DataFrame, entity: str, time: str, id_column: str, *columns: str) -> DataFrame:
    """(entity, place, id, columns): each entity's events, place 1 for the newest.

    Rows, not an array per entity, so no group is held in one place; places come
    from ``dedup.pointers``, which splits a hot entity by days.
    """
    places = dedup.pointers(events.select(id_column, entity, time), entity, [time, id_column], id_column)
    size = events.groupBy(entity).agg(F.count("*").alias("_n"))
    ranked = places.join(size, entity).select(entity, id_column, (F.col("_n") - F.col("seq")).alias("place"))
    told = events.select(id_column, *(c for c in columns if c not in (id_column, entity)))
    return ranked.join(told, id_column).select(entity, "place", id_column, *(c for c in columns if c not in (id_column, entity)))


def _prefixes(name: Column) -> Column:
    """The name's beginnings of whole words, itself left out."""
    words = F.split(name, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))


def same_or_longer(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Pairs (name_a, name_b) of different names one of which begins with the whole words of the other.

    Both frames hold different names.  Names meet on their beginnings, so only true pairs arise.
    """
    heads = lambda df, n, m: df.where(F.size(F.split(n, " ")) > 1).select(F.col(n), F.explode(_prefixes(F.col(n))).alias(m))
    longer = heads(a, name_a, name_b).join(b.select(name_b), name_b)
    shorter = heads(b, name_b, name_a).join(a.select(name_a), name_a)
    return longer.select(name_a, name_b).unionByName(shorter.select(name_a, name_b))


def attach(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Events (event_id, company, role, has_role) to entities (entity_id, company, role, last_event_at, closed).

    Of the entities of the event's company, or if there are none, of companies
    whose whole words begin like it or the other way round:

    0. the one of exactly the event's company and role, if a role is given;
    1. the newest whose role holds the event's or is held by it;
    2. the newest open one;
    3. the newest.

    Newest is by ``last_event_at``, ties and exact ones end at the least id.
    Events without company have no row.  Rows of one company and role are brought
    down to one before they meet, so that a company that holds a third of all
    rows gives as many pairs as it has different roles.
    """
    asked = events.where("company <> ''").select(F.col("company").alias("ec"), F.col("role").alias("er"), "has_role").distinct()
    newest = F.struct((-F.unix_micros("last_event_at")).alias("age"), F.col("entity_id"))
    kinds = (
        entities.where("company <> ''").groupBy(F.col("company").alias("tc"), F.col("role").alias("tr"))
        .agg(F.min("entity_id").alias("least"), F.min(newest).alias("newest"), F.min(F.when(~F.col("closed"), newest)).alias("open"))
    )
    companies, known = asked.select("ec").distinct(), kinds.select("tc").distinct()
    near = same_or_longer(companies.join(known, F.col("ec") == F.col("tc"), "left_anti"), known, "ec", "tc")
    own = asked.join(kinds, F.col("ec") == F.col("tc")).withColumn("prefix", F.lit(False))
    other = asked.join(near, "ec").join(kinds, "tc").withColumn("prefix", F.lit(True))
    pairs = own.unionByName(other.select(*own.columns))
    within = (F.col("er") != "") & (F.col("tr") != "") & (F.contains("er", F.col("tr")) | F.contains("tr", F.col("er")))
    exact = F.col("has_role") & ~F.col("prefix") & (F.col("er") == F.col("tr"))
    best = pairs.groupBy("ec", "er", "has_role").agg(
        F.min(F.when(exact, F.col("least"))).alias("exact"), F.min(F.when(within, F.col("newest"))).alias("alike"),
        F.min("open").alias("open"), F.min("newest").alias("newest"), F.first("prefix").alias("prefix"),
    )
    tiers = [F.col("exact"), F.col("alike.entity_id"), F.col("open.entity_id"), F.col("newest.entity_id")]
    tier = F.when(tiers[0].isNotNull(), 0).when(tiers[1].isNotNull(), 1).when(tiers[2].isNotNull(), 2).otherwise(3)
    best = best.select("ec", "er", "has_role", F.coalesce(*tiers).alias("entity_id"), tier.alias("tier"), "prefix")
    keyed = events.select("event_id", F.col("company").alias("ec"), F.col("role").alias("er"), "has_role")
    return keyed.join(best, ["ec", "er", "has_role"]).select("event_id", "entity_id", "tier", "prefix")
