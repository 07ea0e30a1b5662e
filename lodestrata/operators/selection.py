"""Reproducible sampling: quotas, seeded draws and splits that keep groups together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class SelectionError(ValueError):
    """A selection that can't be made."""


def seeded(seed: int, *keys: str) -> Column:
    """A pseudo-random order: the same for the same seed, another for another, however the rows are distributed."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), *[F.col(k).cast("string") for k in keys]), 256)


def quotas(capacity: dict[str, int], total: int) -> dict[str, int]:
    """Seats for a few strata: equal shares, none above its capacity, odd seats to the largest.

    Strata that can't fill the equal share of what is left are filled, smallest first; the others
    share the rest evenly.
    """
    if sum(capacity.values()) < total:
        raise SelectionError(f"{total} of {sum(capacity.values())} can't be taken")
    left, seats = total, {}
    small = sorted(capacity, key=lambda k: (capacity[k], k))
    while small and capacity[small[0]] * len(small) <= left:
        k = small.pop(0)
        seats[k] = capacity[k]
        left -= seats[k]
    each, odd = divmod(left, len(small)) if small else (0, 0)
    for n, k in enumerate(sorted(small, key=lambda k: (-capacity[k], k))):
        seats[k] = each + (n < odd)
    return seats


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int, by: list[str] | None = None, least: int = 0) -> DataFrame:
    """``(by, key, seats)``: ``total`` seats in proportion to the weights, odd ones to the largest remainders, ties by key. Whole-number arithmetic.

    least: seats that every key gets beforehand; where they would be more than ``total``, none.
    """
    w = Window.partitionBy(*(by or [F.lit(1)]))
    sized = weights.withColumn("_least", F.when(F.count("*").over(w) * least <= total, least).otherwise(0).cast("bigint"))
    sized = sized.withColumn("_left", F.lit(total) - F.sum("_least").over(w))
    exact = F.col(weight).cast("bigint") * F.col("_left")
    parts = sized.withColumn("_sum", F.sum(weight).over(w).cast("bigint")).withColumn("_floor", F.floor(exact / F.col("_sum")).cast("bigint")).withColumn("_rest", exact - F.col("_floor") * F.col("_sum"))
    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("_rest"), key)
    given = F.col("_left") - F.sum("_floor").over(w)
    placed = parts.withColumn("_given", given).withColumn("_n", F.row_number().over(order))
    return placed.select(*(by or []), key, (F.col("_least") + F.col("_floor") + F.when(F.col("_n") <= F.col("_given"), 1).otherwise(0)).cast("bigint").alias("seats"))


#: Steps of the seeded order, by which it is cut where a stratum has its seats.
STEPS = 4096


def draw(df: DataFrame, stratum: str, key: str, seats: DataFrame, seed: int) -> DataFrame:
    """The first rows of each stratum in the seeded order, as many as its ``seats``.

    The order is cut into ``STEPS`` steps. How many rows each step of a stratum holds is counted, which
    says exactly in which step the last seat lies; rows of later steps are dropped before the window.
    So the window sorts little more than the winners, and none of them can be lost.
    """
    step = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    keyed = df.withColumn("_h", seeded(seed, key)).withColumn("_step", step)
    counts = keyed.groupBy(stratum, "_step").agg(F.count("*").alias("_rows")).join(seats, stratum)
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(stratum).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = counts.withColumn("_before", before).where(F.col("_before") < F.col("seats")).groupBy(stratum).agg(F.max("_step").alias("_last"), F.max("seats").alias("seats"))
    w = Window.partitionBy(stratum).orderBy("_h", key)
    return keyed.join(reached, stratum).where(F.col("_step") <= F.col("_last")).withColumn("_n", F.row_number().over(w)).where("_n <= seats").drop("_h", "_n", "_step", "_last", "seats")


def representatives(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """One row's key of each group, the first in the seeded order."""
    return df.groupBy(group).agg(F.min(F.struct(seeded(seed, key).alias("h"), F.col(key).alias("k"))).alias("m")).select(group, F.col("m.k").alias(key))


def pairs_across_groups(pairs: DataFrame, members: DataFrame, key: str, group: str, a: str = "posting_id_a", b: str = "posting_id_b") -> DataFrame:
    """The pairs whose ends stand in different groups, with both groups; an end without a group is in none."""
    of = lambda end: members.select(F.col(key).alias(end), F.col(group).alias(f"{end}_group"))
    return pairs.join(of(a), a, "left").join(of(b), b, "left").where(~F.col(f"{a}_group").eqNullSafe(F.col(f"{b}_group")))


def leaking_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose rows stand in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def select_set(df: DataFrame, key: str, stratum: str, group: str, total: int, development: int, seed: int, cell: str | None = None, variety: str | None = None) -> DataFrame:
    """``(key, group, stratum, split)``: one representative of each of ``total`` groups, balanced over strata, ``development`` of them as such, the rest for evaluation.

    A stratum's seats go to its cells in proportion to their rows, one at least where they suffice;
    what a cell has no rows for goes to those with most room. Within a cell the draw spreads over
    ``variety``. Strata and cells are few (their counts come to the driver); all else is distributed.
    """
    spark = df.sparkSession
    heads = representatives(df, group, key, seed).join(df.select(key, stratum, *[c for c in (cell, variety) if c]), key)
    heads = heads.withColumn("_cell", F.to_json(F.struct(F.col(stratum).alias("s"), (F.coalesce(F.col(cell).cast("string"), F.lit("")) if cell else F.lit("")).alias("c"))))
    heads = heads.withColumn("_variety", F.coalesce(F.col(variety).cast("string"), F.lit("")) if variety else F.lit(""))
    sizes = heads.groupBy(stratum, "_cell").count().collect()
    capacity: dict = {}
    for r in sizes:
        capacity[r[0]] = capacity.get(r[0], 0) + r[2]
    seats = quotas(capacity, total)
    cells: dict[str, int] = {}
    for name, wanted in seats.items():
        room = {r[1]: r[2] for r in sizes if r[0] == name}
        frame = spark.createDataFrame([(k, n) for k, n in room.items()], "cell string, n bigint")
        given = {r["cell"]: r["seats"] for r in largest_remainder(frame, "cell", "n", wanted, least=1).collect()} if len(room) > 1 else dict.fromkeys(room, wanted)
        cells |= overflow(given, room)
    as_table = lambda d, c: spark.createDataFrame(list(d.items()), f"`{c}` string, seats int")
    chosen = diverse_draw(heads, "_cell", "_variety", key, as_table(cells, "_cell"), seed)
    exact = {k: n * development / total for k, n in seats.items()}
    dev = {k: int(x) for k, x in exact.items()}
    for k in sorted(dev, key=lambda k: (-(exact[k] - dev[k]), k))[: development - sum(dev.values())]:
        dev[k] += 1
    first = draw(chosen.select(key, stratum), stratum, key, as_table(dev, stratum), seed + 1).select(key, F.lit("development").alias("split"))
    return chosen.join(first, key, "left").select(key, group, stratum, F.coalesce("split", F.lit("evaluation")).alias("split"))


def diverse_draw(df: DataFrame, stratum: str, variety: str, key: str, seats: int | DataFrame, seed: int) -> DataFrame:
    """``seats`` rows of each stratum that spread over the values of ``variety``: the first of every value before the second of any, each in the seeded order; ties by key.

    seats: one number, or a table ``(stratum, seats)``. Only as many rows of a value as the stratum
    has seats can be among them, so the others are dropped first.
    """
    keyed = df.withColumn("_h", seeded(seed, key))
    keyed = keyed.join(seats.select(stratum, F.col("seats").alias("_seats")), stratum) if isinstance(seats, DataFrame) else keyed.withColumn("_seats", F.lit(seats))
    turn = F.row_number().over(Window.partitionBy(stratum, variety).orderBy("_h", key))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_turn", "_h", key))
    return keyed.withColumn("_turn", turn).where("_turn <= _seats").withColumn("_n", place).where("_n <= _seats").drop("_h", "_turn", "_n", "_seats")


def overflow(wanted: dict[str, int], room: dict[str, int]) -> dict[str, int]:
    """Seats of cells with too little room handed to those with most room left, ties by name."""
    given = {k: min(n, room.get(k, 0)) for k, n in wanted.items()}
    left = sum(wanted.values()) - sum(given.values())
    while left:
        open_cells = [k for k in room if room[k] > given.get(k, 0)]
        if not open_cells:
            raise SelectionError(f"no room for {left}")
        k = min(open_cells, key=lambda x: (given.get(x, 0) - room[x], x))
        given[k] = given.get(k, 0) + 1
        left -= 1
    return given


def selection_problems(chosen: DataFrame, source: DataFrame, key: str, digest: str, group: str, split: str, sizes: dict[str, int]) -> DataFrame:
    """``(problem, n)``: rows that the source lacks or has with another digest, groups in two splits, repeated keys, splits of another size."""
    joined = chosen.join(source.select(key, F.col(digest).alias("_now")), key, "left")
    counts = joined.agg(
        F.count_if(F.col("_now").isNull()).alias("not in the source"), F.count_if(F.col("_now") != F.col(digest)).alias("text has changed"),
        (F.count("*") - F.countDistinct(key)).alias("repeated keys"), *[F.abs(F.count_if(F.col(split) == s) - n).alias(f"rows off in {s}") for s, n in sizes.items()],
    ).crossJoin(leaking_groups(chosen, group, split).agg(F.count("*").alias("groups in two splits")))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("problem"), F.col(f"`{c}`").cast("bigint").alias("n")) for c in counts.columns]))
    return counts.select(pairs.alias("p")).select("p.*").where("n > 0")
