"""References to records that do not exist (dangling foreign keys), also against the time of reading.

Method: references with composite keys are grouped by which key parts are null (the null mask); each mask is
anti-joined on its non-null columns, under declared match semantics:

* ``simple``  - a reference with any null part is not checked (SQL's default);
* ``partial`` - the non-null parts must match some parent; an all-null reference is not checked;
* ``full``    - a reference with some but not all parts null is itself an orphan; all-null is not checked.

The groups are disjoint and every reference is in one of them. Each semantics decides a whole group at a time: by an
anti-join on the mask's non-null columns, or, where the mask alone decides, without a join. Under ``partial`` only masks
that occur cost a join: they are found by one aggregation of at most 2**k rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_orphans(
    references: DataFrame, parents: DataFrame, keys: dict[str, str], match: str = "simple", visible: Column | None = None
) -> DataFrame:
    """Rows of ``references`` whose key has no parent, with the column ``null_mask`` (bit i: key part i is null).

    keys: reference column -> parent column. visible: a further condition over columns of both sides (parent columns
    are named ``__p_<name>``), such as a validity interval. Extra columns of either side may have clashing names: only
    the references' columns come out. Empty parents make every checked reference an orphan; repeated references are
    kept as often as they occur; repeated parents change nothing."""
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    cols = list(keys)
    mask = reduce(lambda a, b: a + b, [F.when(F.col(f"`{c}`").isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(cols)])
    refs = references.withColumn("null_mask", mask.cast("int"))
    right = parents.select(*[F.col(f"`{c}`").alias(f"__p_{c}") for c in parents.columns])
    every = (1 << len(cols)) - 1

    def anti(df: DataFrame, kept: list[str]) -> DataFrame:
        on = reduce(lambda a, b: a & b, [df[f"`{c}`"] == right[f"__p_{keys[c]}"] for c in kept])
        return df.join(right, on if visible is None else on & visible, "left_anti")

    whole = anti(refs.where("null_mask = 0"), cols)
    if match == "simple":
        return whole
    some = refs.where(f"null_mask > 0 and null_mask < {every}")
    if match == "full":  # the mask alone makes these orphans
        return whole.unionByName(some)
    masks = sorted(r[0] for r in some.select("null_mask").distinct().collect())
    groups = (anti(some.where(F.col("null_mask") == m), [c for i, c in enumerate(cols) if not m >> i & 1]) for m in masks)
    return reduce(DataFrame.unionByName, groups, whole)


def relation_orphans(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(relation_pk, endpoint, reason, emitted_at): endpoints of relations that no entity row visible at the relation's
    first arrival bears, each with the reason ``missing``, ``deleted`` or ``late``.

    Null or empty endpoints are no references. Rows delivered twice count once, at their first arrival. A relation
    without an arrival time is read as arriving after everything (t = infinity); an entity without one never arrives.
    A reference whose cluster or emission is null can match no parent and is ``missing``. Empty tables: no entities
    make all references missing, no relations give no rows."""
    never = F.lit("9999-12-31 00:00:00").cast("timestamp")
    first = relations.groupBy("relation_pk").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("cluster_id", "emission", "source", "target", "emitted_at")],
        F.coalesce(F.min("arrived_at"), never).alias("t"),
    )
    refs = first.select(
        "relation_pk", "cluster_id", "emission", "emitted_at", "t",
        F.explode(F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(e).alias("ref")) for e in ("source", "target")])).alias("x"),
    ).select("*", "x.endpoint", "x.ref").drop("x").where("ref <> ''")
    key = {"cluster_id": "cluster_id", "emission": "emission", "ref": "id"}
    later = F.lit("9999-12-31 01:00:00").cast("timestamp")
    rows = entities.where("id <> ''").select("cluster_id", "emission", "id", F.coalesce("arrived_at", later).alias("arrived_at"), "deleted_at")
    visible = (F.col("__p_arrived_at") <= F.col("t")) & (F.col("__p_deleted_at").isNull() | (F.col("__p_deleted_at") > F.col("t")))
    # under partial semantics a null cluster or emission would match any; here it matches none, as in ``full``
    orphans = find_orphans(refs, rows, key, "full", visible)
    # the few orphans are met with the same shuffled entities again
    known = rows.select("cluster_id", "emission", F.col("id").alias("ref"), F.col("arrived_at").alias("seen"), "deleted_at")
    met = orphans.join(known, ["cluster_id", "emission", "ref"], "left")
    seen = met.groupBy("relation_pk", "endpoint", "emitted_at", "t").agg(F.min("seen").alias("seen"))
    reason = F.when(F.col("seen").isNull(), "missing").when(F.col("seen") <= F.col("t"), "deleted").otherwise("late")
    return seen.select("relation_pk", "endpoint", reason.alias("reason"), "emitted_at")


def source_orphans(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(relation_pk, null_mask): relations whose source no entity of the extraction has, under ``partial`` semantics and
    whatever the time: a relation with a null source (or cluster, or emission) is an orphan if no entity has what is given."""
    refs = relations.select("relation_pk", "cluster_id", "emission", "source").dropDuplicates(["relation_pk"])
    parents = entities.where("id <> ''").select("cluster_id", "emission", "id").distinct()
    return find_orphans(refs, parents, {"cluster_id": "cluster_id", "emission": "emission", "source": "id"}, "partial").select("relation_pk", "null_mask")


def orphan_report(orphans: DataFrame, table: str = "relations", period: str = "month") -> DataFrame:
    """Orphans per table, period of emitted_at and reason; an unknown time counts under the null period."""
    at = F.date_trunc(period, "emitted_at").alias("period")
    return orphans.groupBy(F.lit(table).alias("table_name"), at, "endpoint", "reason").agg(F.count("*").alias("orphans"))
