"""Continuous twins of two batch operators: playback tracking and rolling conversation context."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronotext.operators import timejoin


def located(batch: DataFrame, sections: DataFrame, seg: DataFrame) -> DataFrame:
    """(viewer, source_id, event_time, t, section_id, line_seq): the positions of one batch, each once, with what is shown then.

    ``sections`` and ``seg`` are as for :func:`timejoin.active_section` and :func:`timejoin.active_line`, whose cell joins
    do the work, so neither an event nor a task meets all lines of a source.
    """
    key = ["viewer", "source_id", "event_time", "t"]
    rows = batch.select(*key).dropDuplicates(key).withColumn("_at", F.col("t"))
    shown = timejoin.active_section(rows, sections, ["viewer", "event_time", "_at"])
    return timejoin.active_line(shown, seg, ["viewer", "event_time", "_at"]).select(*key, "section_id", "line_seq")


def track_positions(stream: DataFrame, delay: str = "10 minutes", ttl_ms: int = 3_600_000, buckets: int = 1024) -> DataFrame:
    """Changes of what each viewer of a source is shown, from the stream of :func:`located` positions: a row whenever section or line differs from the one before.

    The watermark bounds late positions; a viewer that the watermark leaves ``ttl_ms`` behind is forgotten.  A call of the
    state function costs milliseconds, so it serves a bucket of viewers, not one: their states lie side by side, each with
    the time until which it is kept.
    """
    rows = stream.withWatermark("event_time", delay).withColumn("bucket", F.pmod(F.xxhash64("viewer", "source_id"), F.lit(buckets)))

    def changes(key, batches, state: GroupState):
        held = {(v, s): now for v, s, *now in zip(*state.get, strict=True)} if state.exists else {}
        mark, nothing = state.getCurrentWatermarkMs(), (None, None, 0)
        if not state.hasTimedOut:
            pdf = pd.concat(list(batches)).sort_values(["event_time", "t"], ignore_index=True)
            at = pdf["event_time"].to_numpy("datetime64[ms]").astype("int64").tolist()
            changed, sections, lines = [], pdf["section_id"].tolist(), pdf["line_seq"].tolist()
            for k, (who, ms, section, line) in enumerate(zip(zip(pdf["viewer"].tolist(), pdf["source_id"].tolist(), strict=True), at, sections, lines, strict=True)):
                section, line = section if isinstance(section, str) else None, None if pd.isna(line) else int(line)
                if (section, line) != tuple(held.get(who, nothing)[:2]):
                    changed.append(k)
                held[who] = (section, line, max(ms, mark) + ttl_ms)
            yield pdf.loc[changed, ["viewer", "source_id", "event_time", "section_id", "line_seq"]].astype({"line_seq": "Int64"})
        held = {who: now for who, now in held.items() if now[2] > mark}
        if held:
            state.update(tuple(list(c) for c in zip(*(who + tuple(now) for who, now in held.items()), strict=True)))
            state.setTimeoutTimestamp(min(now[2] for now in held.values()))
        else:
            state.remove()

    one = "viewer long, source_id long, event_time timestamp, section_id string, line_seq int"
    kept = "viewer array<long>, source_id array<long>, section_id array<string>, line_seq array<int>, until array<long>"
    return rows.groupBy("bucket").applyInPandasWithState(changes, one, kept, "append", GroupStateTimeout.EventTimeTimeout)


def rolling_history(stream: DataFrame, n: int = 8, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """(conv_id, turn, history): after each batch, the last ``n`` turns of every conversation that got one; state holds just these.

    A conversation idle for ``ttl_ms`` (a day) is forgotten.  Such a stream never runs out of batches, so one that is to be
    drained is given None: its state then lives no longer than the run.
    """

    def keep(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        old = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            old += [(int(r.turn), str(r.role or "user"), str(r.text or "")) for r in pdf.itertuples(index=False)]
        old = sorted(old)[-n:]
        state.update(tuple(list(c) for c in zip(*old, strict=True)))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        lines = [f"{'User' if role.strip().lower() == 'user' else 'Assistant'}: {text.strip()}" for _, role, text in old if text.strip()]
        yield pd.DataFrame([(key[0], old[-1][0], "\n".join(lines))], columns=["conv_id", "turn", "history"])

    return stream.groupBy("conv_id").applyInPandasWithState(keep, "conv_id long, turn long, history string", "turn array<long>, role array<string>, text array<string>", "update", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def drained(stream: DataFrame, folder: str, mode: str, per_batch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What ``stream`` gives for all input there is now, as a table with the column ``batch``; ``per_batch`` is applied to each batch.

    State and output lie below ``folder``; a batch that is tried again replaces its own output.  No input gives no rows.
    """
    spark, root, work = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}", per_batch or (lambda rows: rows)

    def keep(rows: DataFrame, no: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{root}/out/batch={no}")

    none = work(spark.createDataFrame([], stream.schema))
    none.write.parquet(f"{root}/out/batch=-1")
    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(none.schema.add("batch", "long")).parquet(f"{root}/out")


def following(table: DataFrame) -> DataFrame:
    """The files of a drained table as a stream, so that one stream can read what another has written."""
    files = sorted({f.rsplit("/", 1)[0] for f in table.inputFiles()})
    root = files[0].rsplit("/", 1)[0] if files else ""
    return table.sparkSession.readStream.schema(table.schema).parquet(root)
