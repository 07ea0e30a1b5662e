"""Event logs as ordered keyed state: what was applied, what came again, what came too late.

A scope's events are applied in their order. An event may state the version of the scope that its
writer saw; if others were applied since, it is stale and goes to a side output instead. A
request that comes again is applied once. Every applied event gives the scope its next version.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

APPLIED, STALE, REPEATED = "applied", "stale", "repeated"


def step(version: int, expected: int | None, repeated: bool) -> tuple[str, int]:
    """What becomes of an event in a scope at ``version``: outcome and the scope's version after it."""
    if repeated:
        return REPEATED, version
    if expected is not None and expected != version:
        return STALE, version
    return APPLIED, version + 1


def replay(events: DataFrame, scope: str, order: str, expected: str, request: str) -> DataFrame:
    """``events`` with ``outcome`` and ``version`` (of the scope after the event).

    ``order`` is unique within a scope; a null ``expected`` accepts any version, a null ``request`` is no
    retry. Rows with a null scope are one scope. A request's first event is found by an aggregate. Scopes
    are then read in order, a batch after the other: a worker keeps one number a scope, never its
    events, so a scope with a third of all rows takes time but no memory.
    """
    first = events.where(F.col(request).isNotNull()).groupBy(F.col(scope).alias("_s"), F.col(request).alias("_r")).agg(F.min(order).alias("_first"))
    known = (F.col(scope).eqNullSafe(F.col("_s"))) & (F.col(request) == F.col("_r"))
    marked = events.join(first, known, "left").withColumn("_again", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_s", "_r", "_first")
    sorted_rows = marked.repartition(scope).sortWithinPartitions(scope, order)
    names = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, version, begun = None, 0, False
        for batch in batches:
            outcomes, versions = [], []
            for s, wanted, again in zip(*(batch.column(c).to_pylist() for c in (scope, expected, "_again")), strict=True):
                if not begun or s != at:
                    at, version, begun = s, 0, True
                outcome, version = step(version, wanted, again)
                outcomes.append(outcome)
                versions.append(version)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(outcomes, pa.string()), pa.array(versions, pa.int64())], names=[*names, "outcome", "version"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return sorted_rows.mapInArrow(run, f"{schema}, outcome string, version bigint")


def last_decisions(replayed: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """``keys, columns`` and ``decisions`` of each record: the last applied event decides, and how many there were."""
    applied = replayed.where(F.col("outcome") == APPLIED)
    last = applied.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_l"), F.count("*").alias("decisions"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in columns], "decisions")


def stale_events(replayed: DataFrame) -> DataFrame:
    """The side output: events whose writer hadn't seen the scope's version."""
    return replayed.where(F.col("outcome") == STALE)


def replay_stream(events: DataFrame, scope: str, order: str, expected: str) -> DataFrame:
    """``(scope, order, outcome, version)`` of each event of a stream, with a scope's version kept as state.

    Events of one micro-batch are applied in their order, batches as they come. Repeats are dropped
    before, within the watermark (``streaming.events.deduplicated``).
    """
    kinds = dict(events.dtypes)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version = state.get[0] if state.exists else 0
        rows = []
        for at, wanted in sorted(((r[0], None if pd.isna(r[1]) else int(r[1])) for pdf in frames for r in pdf[[order, expected]].itertuples(index=False)), key=lambda r: r[0]):
            outcome, version = step(version, wanted, False)
            rows.append((key[0], at, outcome, version))
        state.update((version,))
        yield pd.DataFrame(rows, columns=[scope, order, "outcome", "version"])

    schema = f"`{scope}` {kinds[scope]}, `{order}` {kinds[order]}, outcome string, version bigint"
    return events.select(scope, order, expected).groupBy(scope).applyInPandasWithState(update, schema, "version bigint", "append", GroupStateTimeout.NoTimeout)
