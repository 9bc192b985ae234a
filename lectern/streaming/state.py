"""Streaming state: progress, change events and highlight toggles over Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_progress(events: DataFrame) -> DataFrame:
    """The last progress per document of a stream ``doc, ts, seq, ...``, for update or complete mode."""
    rest = [c for c in events.columns if c != "doc"]
    latest = F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("v")
    return events.groupBy("doc").agg(latest).select("doc", *[F.col(f"v.{c}").alias(c) for c in rest])


#: Seconds by which an event may come late and still take its place in time order.
LATENESS = 86_400


def _micros(ts: pd.Series) -> list[int]:
    return (ts.astype("datetime64[us]").astype("int64")).tolist()


def _whole(numbers: pd.Series) -> list[int | None]:
    return [None if pd.isna(x) else int(x) for x in numbers]


def _settled(events: list[tuple], lateness: float) -> int:
    """How many of some events in time order are older than what may still come late."""
    newest = events[-1][0] if events else 0
    return sum(e[0] < newest - lateness * 1_000_000 for e in events)


def _changes_of(lateness: float):  # noqa: ANN202
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        fresh = list(zip(_micros(rows["ts"]), rows["seq"].tolist(), _whole(rows["offset"]), _whole(rows["viewport_offset"]), strict=True))
        held = list(zip(*state.get, strict=True)) if state.exists else []
        new, events = set(fresh), sorted(held + fresh, key=lambda e: e[:2])
        # a late event also decides anew about the one after it
        out = [(e, k == 0 or e[2:] != events[k - 1][2:]) for k, e in enumerate(events) if e in new or (k and events[k - 1] in new)]
        state.update(tuple(map(list, zip(*events[max(0, _settled(events, lateness) - 1) :], strict=True))))
        if out:
            times, seqs, offsets, views = zip(*(e for e, _ in out), strict=True)
            yield pd.DataFrame({"doc": key[0], "ts": pd.to_datetime(list(times), unit="us"), "seq": seqs, "offset": pd.array(offsets, "Int64"), "viewport_offset": pd.array(views, "Int64"), "changed": [c for _, c in out]})

    return run


def changes(events: DataFrame, lateness: float = LATENESS) -> DataFrame:
    """Whether each event's line or viewport differs from the document's previous one, for update mode.

    ``events`` is a stream of ``doc string, ts timestamp, seq long, offset long, viewport_offset long``; rows come
    back with ``changed``. An event may come ``lateness`` seconds late: it then takes its place in time order,
    and the row after it is put out again. Of rows with one ``doc, seq`` the last counts (see :func:`drained`).
    State holds a document's events of that span and the one before them.
    """
    return events.groupBy("doc").applyInPandasWithState(
        _changes_of(lateness), "doc string, ts timestamp, seq long, offset long, viewport_offset long, changed boolean",
        "ts array<long>, seq array<long>, offset array<long>, viewport_offset array<long>", "update", GroupStateTimeout.NoTimeout,
    )


def toggle(have: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """One toggle: remove all that it overlaps, or else add it."""
    apart = [h for h in have if h[1] <= start or h[0] >= end]
    return apart if len(apart) < len(have) else [*have, (start, end)]


def _toggles_of(lateness: float):  # noqa: ANN202
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        fresh = list(zip(_micros(rows["ts"]), rows["seq"].tolist(), rows["start"].tolist(), rows["end"].tolist(), strict=True))
        kept = state.get if state.exists else ([], [], [], [], [], [])
        have, events = list(zip(*kept[:2], strict=True)), sorted(list(zip(*kept[2:], strict=True)) + fresh)
        done = _settled(events, lateness)
        for e in events[:done]:
            have = toggle(have, e[2], e[3])
        rest = events[done:]
        state.update((*map(list, zip(*have, strict=True)), *map(list, zip(*rest, strict=True))) if have else ([], [], *map(list, zip(*rest, strict=True))))
        for e in rest:
            have = toggle(have, e[2], e[3])
        yield pd.DataFrame({"doc": [key[0]], "n_highlights": [len(have)], "starts": [[s for s, _ in have]], "ends": [[e for _, e in have]]})

    return run


def toggled(events: DataFrame, lateness: float = LATENESS) -> DataFrame:
    """Highlights of each document after the toggles seen so far: ``doc, n_highlights, starts, ends``, for update mode.

    ``events`` is a stream of ``doc string, ts timestamp, seq long, start long, end long``. Toggles may come
    ``lateness`` seconds late and are then applied in time order; older ones are settled in the state. Of
    rows with one ``doc`` the last counts (see :func:`drained`).
    """
    return events.groupBy("doc").applyInPandasWithState(
        _toggles_of(lateness), "doc string, n_highlights long, starts array<long>, ends array<long>",
        "starts array<long>, ends array<long>, ts array<long>, seq array<long>, start array<long>, stop array<long>", "update", GroupStateTimeout.NoTimeout,
    )


def drained(stream: DataFrame, folder: str, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over all data that is there now and read what it put out last.

    Each trigger's output is a folder of its own under ``folder``, so a repeated trigger overwrites
    itself. In complete mode the last trigger counts, in update mode each key's last one.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of which the last row counts")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/trigger={number if mode != 'complete' else 0}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/log").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    spark, kind = stream.sparkSession, stream.schema
    out = spark.read.schema(T.StructType([*kind.fields, T.StructField("trigger", T.LongType())])).parquet(f"{folder}/out")
    if mode != "update":
        return out.drop("trigger")
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*kind.names), "trigger").alias("v"))
    return last.select("v.*")
