"""Streaming operators over keyed events. Each takes a stream or a batch, unless it says so."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codequarry.sources.store import changed_partitions

TERMINAL = ("session.idle", "session.error")


def debounced(events: DataFrame, key: str, ts: str, value: str, gap: str = "500 milliseconds", lateness: str = "10 minutes") -> DataFrame:
    """Trailing debounce: for each key the last value of every run of events closer than ``gap``.

    ``key, first_ts, last_ts, n_events, value``. A run ends when a gap passes without an event; on a stream it comes out when
    the watermark passes that.
    """
    e = events.withWatermark(ts, lateness) if events.isStreaming else events
    runs = e.groupBy(F.session_window(ts, gap), key)
    last = F.max(F.struct(ts, value))
    return runs.agg(F.min(ts).alias("first_ts"), F.count("*").alias("n_events"), last.alias("l")).select(key, "first_ts", F.col(f"l.{ts}").alias("last_ts"), "n_events", F.col(f"l.{value}").alias("value"))


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """``start, kind, n`` of tumbling or sliding windows; late events beyond the watermark are left out on a stream."""
    e = events.withWatermark(ts, lateness) if events.isStreaming else events
    return e.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def deduplicated(events: DataFrame, keys: list[str], ts: str, lateness: str = "1 hour") -> DataFrame:
    """The first event of each key; state is kept for the lateness only.

    On a batch that is the one of the smallest time (no time comes last), of equal times the first by the other columns in
    their order, so it is the same in every run. In a stream it is the first to arrive.
    """
    if events.isStreaming:
        return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)
    ties = [f.name for f in events.schema.fields if f.name != ts and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    first = F.min_by(F.struct(*events.columns), F.struct(F.col(ts).isNull(), ts, *ties))
    return events.groupBy(*keys).agg(first.alias("_first")).select("_first.*")


def frame_payloads(text: str) -> tuple[list[str], str]:
    """The payloads of the complete frames of a buffer, and what remains of it."""
    *frames, rest = text.replace("\r\n", "\n").split("\n\n")
    out = []
    for f in frames:
        data = "\n".join(line[5:].lstrip() for line in f.split("\n") if line.startswith("data:")).strip()
        if data and data != "[DONE]":
            out.append(data)
    return out, rest


def sse_payloads(pieces: DataFrame, connection: str = "connection", order: str = "ts", text: str = "text") -> DataFrame:
    """``connection, seq, payload`` from pieces of event streams; frames may be cut anywhere between pieces.

    A batch is sorted by connection and order inside partitions and read once, with a buffer a connection. On a stream the
    buffer is state. Payloads that aren't JSON, ``[DONE]`` and an unfinished last frame give no row.
    """
    schema = f"{connection} string, seq long, payload string"
    p = pieces.select(F.col(connection).cast("string").alias(connection), F.col(order), F.col(text)).where(F.col(connection).isNotNull() & F.col(text).isNotNull())
    if not pieces.isStreaming:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, buffer, seq = None, "", 0
            for b in batches:
                rows = []
                for c, t in zip(b[connection], b[text]):
                    if c != held:
                        held, buffer, seq = c, "", 0
                    got, buffer = frame_payloads(buffer + t)
                    rows += [(c, seq + i, g) for i, g in enumerate(got)]
                    seq += len(got)
                yield pd.DataFrame(rows, columns=[connection, "seq", "payload"])

        out = p.repartition(connection).sortWithinPartitions(connection, order).mapInPandas(run, schema)
    else:

        def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            buffer, seq = state.get if state.exists else ("", 0)
            rows = []
            for t in pd.concat(batches).sort_values(order)[text]:
                got, buffer = frame_payloads(buffer + t)
                rows += [(key[0], seq + i, g) for i, g in enumerate(got)]
                seq += len(got)
            state.update((buffer, seq))
            yield pd.DataFrame(rows, columns=[connection, "seq", "payload"])

        out = p.groupBy(connection).applyInPandasWithState(step, schema, "buffer string, seq long", "append", GroupStateTimeout.NoTimeout)
    return out.where(F.try_parse_json("payload").isNotNull())


def until_terminal(events: DataFrame, session: str, ts: str, kind: str, deadline_ms: int = 300_000) -> DataFrame:
    """``session, outcome, ended``: how each session's wait from its first event ends: idle, error, or timeout.

    A batch looks for the first terminal event within the deadline; on a stream the deadline is an event-time timer. A
    session whose deadline lies beyond all events it could have (the stream's watermark, a batch's last event) is open yet.
    """
    schema = f"{session} string, outcome string, ended timestamp"
    e = events.select(F.col(session).cast("string").alias(session), F.col(ts).cast("timestamp").alias(ts), F.col(kind).alias(kind))
    if not events.isStreaming:
        first = e.groupBy(session).agg(F.min(ts).alias("began"))
        last = e.agg(F.max(ts).alias("m")).first().m
        limit = F.timestamp_millis(F.unix_millis("began") + deadline_ms)
        ends = e.where(F.col(kind).isin(*TERMINAL)).join(first, session).where(F.col(ts) <= limit).groupBy(session).agg(F.min(F.struct(ts, kind)).alias("m"))
        got = first.join(ends, session, "left").withColumn("ended", F.coalesce(F.col(f"m.{ts}"), limit))
        outcome = F.coalesce(F.regexp_extract(F.col(f"m.{kind}"), r"([a-z]+)$", 1), F.lit("timeout"))
        return got.where(F.col("m").isNotNull() | (limit <= F.lit(last))).select(session, outcome.alias("outcome"), "ended")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (limit, done) = state.get
            state.remove()
            if not done:
                yield pd.DataFrame({session: [key[0]], "outcome": ["timeout"], "ended": [pd.Timestamp(limit, unit="us")]})
            return
        rows = pd.concat(batches).sort_values(ts)
        limit, done = state.get if state.exists else (int(rows[ts].iloc[0].value // 1000) + deadline_ms * 1000, False)
        ends = rows[rows[kind].isin(TERMINAL) & (rows[ts].astype("datetime64[us]").astype("int64") <= limit)]
        if not done and len(ends):
            done = True
            yield pd.DataFrame({session: [key[0]], "outcome": [ends[kind].iloc[0].split(".")[-1]], "ended": [ends[ts].iloc[0]]})
        state.update((limit, done))
        if limit // 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(limit // 1000)

    keyed = e.withWatermark(ts, "1 minute").groupBy(session)
    return keyed.applyInPandasWithState(step, schema, "deadline long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def unseen_messages(messages: DataFrame, session: str, key: str, most: int = 2000) -> DataFrame:
    """Stream only. ``session, key`` of messages whose key isn't among the last ``most`` keys of their session."""
    schema = f"{session} string, {key} string"

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        seen, new = set(kept), []
        for b in batches:
            for k in b[key]:
                if k not in seen:
                    seen.add(k)
                    new.append(k)
        state.update(((kept + new)[-most:],))
        yield pd.DataFrame({session: [group[0]] * len(new), key: new})

    m = messages.select(F.col(session).cast("string").alias(session), F.col(key).cast("string").alias(key))
    return m.groupBy(session).applyInPandasWithState(step, schema, "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def poll_deltas(polls: DataFrame, session: str, ts: str, count: str, most_empty: int = 5) -> DataFrame:
    """Stream or batch of polls (session, time, number of messages so far): what each poll adds and whether it ends the watch.

    ``session, ts, added, done``: a watch is done after ``most_empty`` polls in a row without a new message, once something
    was seen. Polls after that give no row. A poll without a number adds nothing. A batch is one sort by session and time.
    """
    schema = f"{session} string, {ts} timestamp, added long, done boolean"
    p = polls.select(F.col(session).cast("string").alias(session), F.col(ts).cast("timestamp").alias(ts), F.col(count).cast("long").alias(count))

    if not polls.isStreaming:
        so_far = W.partitionBy(session).orderBy(ts, count).rowsBetween(W.unboundedPreceding, W.currentRow)
        before = so_far.rowsBetween(W.unboundedPreceding, -1)
        p = p.withColumn("added", F.greatest(F.coalesce(F.col(count) - F.coalesce(F.max(count).over(before), F.lit(0)), F.lit(0)), F.lit(0)))
        p = p.withColumn("_at", F.count(F.lit(1)).over(so_far))
        p = p.withColumn("_empty", F.col("_at") - F.max(F.when(F.col("added") > 0, F.col("_at"))).over(so_far))
        p = p.withColumn("done", F.coalesce(F.col("_empty") >= most_empty, F.lit(False)))
        p = p.withColumn("_over", F.coalesce(F.max("done").over(before), F.lit(False)))
        return p.where(~F.col("_over")).select(session, ts, "added", "done")

    def play(name: str, rows: pd.DataFrame, seen: int, empty: int, done: bool) -> tuple[list, int, int, bool]:
        out = []
        for t, n in zip(rows[ts], rows[count]):
            if done:
                break
            added = max(0, n - seen)
            seen, empty = max(seen, n), 0 if added else empty + 1
            done = empty >= most_empty and seen > 0
            out.append((name, t, added, done))
        return out, seen, empty, done

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, empty, done = state.get if state.exists else (0, 0, False)
        out, *now = play(key[0], pd.concat(batches).sort_values([ts, count]), seen, empty, done)
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=[session, ts, "added", "done"])

    return p.groupBy(session).applyInPandasWithState(step, schema, "seen long, empty long, done boolean", "append", GroupStateTimeout.NoTimeout)


def reindex_sink(path: str, build: Callable[[DataFrame], DataFrame], keys: list[str], partition: str = "project_path") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps a Parquet index at ``path``, partitioned by project, current.

    Each micro-batch of changed sources is built into rows that replace all rows of their keys; only the partitions it touches
    are rewritten. A batch that is repeated after a failure replaces the same rows once more.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = build(batch)
        try:
            table = batch.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)
        except AnalysisException:
            table = rows.limit(0)
        changed_partitions(table, rows, rows, list(dict.fromkeys([partition, *keys])), path, partition)

    return apply


def watched_changes(before: DataFrame, after: DataFrame, path: str = "file_path", value: str = "file_hash") -> DataFrame:
    """``path, change`` between two listings of files: add, change or unlink."""
    b, a = before.select(path, F.col(value).alias("_b"), F.lit(1).alias("_was")), after.select(path, F.col(value).alias("_a"), F.lit(1).alias("_is"))
    both = b.join(a, path, "full")
    kind = F.when(F.col("_was").isNull(), "add").when(F.col("_is").isNull(), "unlink").when(~F.col("_a").eqNullSafe(F.col("_b")), "change")
    return both.select(path, kind.alias("change")).where(F.col("change").isNotNull())
