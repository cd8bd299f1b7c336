"""Sessions that end at a deadline, with what a turn-taking system asks of them, as state between micro-batches.

A session has until the end of its clip plus a grace while audio is sent, and until the end of the audio plus the grace once a row of kind "audio_end" has
said that. What comes later doesn't count. Up to then the state holds a few numbers and the last interim text: rows counted, interim texts and how many of them rewrote what
was shown, finals, ends of utterance before the end of speech, and the first one at or after it, in order of arrival (seq). At the deadline the session is
given out and a mark is left that it is closed; at the last deadline it could have had, the mark goes too, so nothing is held for ever.

Whether a row is in time goes by its ts, not by what has come before it: a row past the clip's deadline counts if the end of the audio, which may come later, gives the
session so long. Such a row waits in the state with those that come after it, until the end of the audio has come or can't come any more.

Sessions are dealt to buckets by a hash; a bucket's sessions are handled as arrays, with one state and one timer. The timer runs on event time: it fires when the
watermark is past the bucket's next deadline, so rows that come late by no more than `late` count whatever the cut into micro-batches. A bucket's rows of one
micro-batch are put in order together; the trigger's limits and the number of buckets bound them. They reach the state in blocks, a block a row, as Spark hands
state its rows as Python objects one by one.
Nulls: rows without session, ts or kind are left out; a null text is none; a session without began or clip_s can't have a deadline and is left out. Ties in seq go by ts, kind and text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.folders import new_path

IN = "session long, seq long, ts timestamp, kind string, text string, began timestamp, clip_s double, speech_end_s double"
OUT = "session long, ended_by string, ended_s double, events long, interim long, revised long, finals long, early_ends long, first_end_s double"
STATE = "sessions binary, waiting binary, timer long"
KINDS = ("audio_end", "eou", "final", "interim")  # in the order of ties; any other is 0
_AUDIO_END, _EOU, _FINAL, _INTERIM = range(1, 5)
_NONE = np.iinfo("int64").min
_COUNTS = ("events", "interim", "revised", "finals", "early")
_SESSIONS = pa.schema([("session", pa.int64()), *((k, pa.int64()) for k in ("began", "end", "speech", "deadline", "first", *_COUNTS)), ("tight", pa.bool_()), ("closed", pa.bool_()), ("shown", pa.string())])
_ROWS = pa.schema([*((k, pa.int64()) for k in ("session", "seq", "us", "kind", "began", "end", "speech")), ("text", pa.string())])
BLOCK = 200_000  # rows of a task that are dealt to buckets together
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(rows: pd.DataFrame | pa.Table, schema: pa.Schema) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as writer:
        writer.write_table(rows if isinstance(rows, pa.Table) else pa.Table.from_pandas(rows, schema, preserve_index=False))
    return out.getvalue().to_pybytes()


def _unpacked(held: Iterable[bytes], schema: pa.Schema) -> pd.DataFrame:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(x).read_all() for x in held)]).to_pandas()


def _block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).sort_by("bucket")
    buckets, starts = np.unique(rows["bucket"].to_numpy(), return_index=True)
    rows = rows.select(_ROWS.names).cast(_ROWS)
    parts = [_packed(rows.slice(a, b - a), _ROWS) for a, b in pairwise([*starts, len(rows)])]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(parts, pa.binary())], ["bucket", "rows"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket in some batches one row that holds its rows."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(map(len, some)) >= BLOCK:
            yield _block(some)
            some = []
    if some:
        yield _block(some)


def _firsts(of: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sessions that have a chosen row, and the place of the first of them."""
    at = np.flatnonzero(chosen)
    who, first = np.unique(of[at], return_index=True)
    return who, at[first]


def _timer(us):
    return us // 1000 + 1


class Deadlines(StatefulProcessor):
    def __init__(self, grace_us: int, late_us: int):
        self.grace_us, self.late_us = grace_us, late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark_ms = timerValues.getCurrentWatermarkInMs()
        new = _unpacked((x for part in rows for x in part["rows"]), _ROWS)
        yield self._step(new[new["us"] > mark_ms * 1000] if mark_ms else new, mark_ms, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._step(_unpacked([], _ROWS), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _step(self, rows: pd.DataFrame, mark_ms: int, fired: int | None) -> pd.DataFrame:
        """Rows of a bucket's sessions into its state; the sessions whose deadline is past are given out."""
        if self.state.exists():
            sessions, waiting, timer = self.state.get()
            s, rows = _unpacked([sessions], _SESSIONS), pd.concat([_unpacked([waiting], _ROWS), rows])
        else:
            s, timer = _unpacked([], _SESSIONS), None
        s, rows, of = self._known(s, rows, mark_ms)
        waits = self._counted(s, rows, of, mark_ms)
        out = (~s["closed"] & (_timer(s["deadline"]) <= mark_ms)).to_numpy()
        tight, some = s["tight"].to_numpy(), (s["events"] > 0).to_numpy()
        given = s[out & (tight | some)]
        s["closed"] |= out & tight
        last = s["deadline"].where(~s["closed"], s[["deadline", "end"]].max(axis=1))  # rows from before the last deadline may still come to a closed session
        held = np.bincount(of[waits], minlength=len(s)) > 0
        live = (_timer(last) > mark_ms).to_numpy() & (tight | some | held)
        after = int(_timer(last[live].min())) if live.any() else None
        if timer is not None and timer not in (fired, after):
            self.handle.deleteTimer(timer)
        if after is None:
            self.state.clear()
        else:
            if after != timer or fired is not None:
                self.handle.registerTimer(after)
            self.state.update((_packed(s[live], _SESSIONS), _packed(rows[waits & live[of]], _ROWS), after))
        first = ((given["first"] - given["speech"]) / 1e6).where(given["first"] != _NONE)
        ended = np.where(given["tight"], "audio", "clip")
        values = (given["session"], ended, (given["deadline"] - given["began"]) / 1e6, *(given[k] for k in _COUNTS), first)
        return pd.DataFrame(dict(zip([x.split()[0] for x in OUT.split(", ")], values, strict=True)))

    def _known(self, s: pd.DataFrame, rows: pd.DataFrame, mark_ms: int) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
        """The sessions with new ones, the rows that may count in order, and the place of each row's session. A session whose clip's deadline is past gets no state any more: nothing that comes can be in time."""
        rows = rows.sort_values(["session", "seq", "us", "kind", "text"], ignore_index=True)
        new = rows.drop_duplicates("session")[["session", "began", "end", "speech"]]
        new = new[~new["session"].isin(s["session"]) & (_timer(new["end"]) > mark_ms)]
        s = pd.concat([s, new.assign(deadline=new["end"], first=_NONE, tight=False, closed=False, shown=None, **dict.fromkeys(_COUNTS, 0))], ignore_index=True).astype({"tight": bool, "closed": bool, "shown": object})
        of = pd.Index(s["session"]).get_indexer(rows["session"])
        open_ = (of >= 0) & ~np.append(s["closed"].to_numpy(), True)[of]
        return s, rows[open_].reset_index(drop=True), of[open_]

    def _counted(self, s: pd.DataFrame, rows: pd.DataFrame, of: np.ndarray, mark_ms: int) -> np.ndarray:
        """Counts the rows that are in time, in place; returns which have to wait."""
        us, kind, text = (rows[k].to_numpy() for k in ("us", "kind", "text"))
        end, speech, shown = (s[k].to_numpy(copy=True) for k in ("end", "speech", "shown"))
        tight, deadline, first = (s[k].to_numpy(copy=True) for k in ("tight", "deadline", "first"))
        who, at = _firsts(of, (kind == _AUDIO_END) & (us <= end[of]) & ~tight[of])
        tight[who], deadline[who] = True, us[at] + self.grace_us
        sure = tight | (_timer(end) <= mark_ms)
        in_time = (kind != _AUDIO_END) & (us <= np.where(sure, deadline, end + self.grace_us)[of])
        reach = max(mark_ms * 1000, us.max(initial=_NONE + self.late_us) - self.late_us) + self.grace_us  # an end of audio still to come leaves rows up to here in time
        unsure = in_time & ~sure[of] & ((us > end[of]) | (us > reach))
        who, at = _firsts(of, unsure)
        since = np.full(len(s), len(rows))
        since[who] = at
        waits = in_time & (np.arange(len(rows)) >= since[of])

        chosen = in_time & ~waits
        of, us, kind, text = of[chosen], us[chosen], kind[chosen], text[chosen]
        count = lambda which: np.bincount(of[which], minlength=len(s))
        eou, spoken = (kind == _EOU) & (speech[of] != _NONE), us >= speech[of]
        who, at = _firsts(of, eou & spoken & (first[of] == _NONE))
        first[who] = us[at]
        at = np.flatnonzero(kind == _INTERIM)
        here, said = of[at], text[at]
        begins = np.diff(here, prepend=-1) != 0
        before = np.append(None, said)[:-1]
        before[begins] = shown[here[begins]]
        known = np.array([x is not None for x in before], dtype=bool)
        revised = np.array([x is not None and not t.startswith(x) for x, t in zip(before, said, strict=True)], dtype=bool)
        ends = np.diff(here, append=-1) != 0
        shown[here[ends]] = said[ends]
        for name, which in (("events", slice(None)), ("finals", kind == _FINAL), ("early", eou & ~spoken), ("interim", at[known]), ("revised", at[revised])):
            s[name] += count(which)
        for name, value in (("tight", tight), ("deadline", deadline), ("first", first), ("shown", shown)):
            s[name] = value
        return waits


def by_deadline(rows: DataFrame, grace_s: float, late: str = "3 hours", buckets: int = 512) -> DataFrame:
    """rows: a stream with the columns of IN. A row for each session once its deadline is past."""
    grace_us, late_us = int(grace_s * 1e6), pd.Timedelta(late) // pd.Timedelta(microseconds=1)
    known = rows.where("session is not null and ts is not null and kind is not null and began is not null and clip_s is not null").withWatermark("ts", late)
    kind = F.coalesce(*[F.when((F.col("kind") == k) & ((F.col("text") != "") if k == "interim" else F.lit(True)), n) for n, k in enumerate(KINDS, 1)], F.lit(0)).cast("long")
    began = F.unix_micros("began")
    speech = F.when(F.col("speech_end_s") > 0, began + (F.col("speech_end_s") * 1e6).cast("long")).otherwise(_NONE)
    told = known.select(
        F.pmod(F.xxhash64("session"), F.lit(buckets)).cast("int").alias("bucket"), "session", "seq", F.unix_micros("ts").alias("us"), kind.alias("kind"), began.alias("began"),
        (began + (F.col("clip_s") * 1e6).cast("long") + grace_us).alias("end"), speech.alias("speech"), F.when(kind == _INTERIM, F.col("text")).alias("text"),
    )
    return told.mapInArrow(_blocks, "bucket int, rows binary").groupBy("bucket").transformWithStateInPandas(Deadlines(grace_us, late_us), OUT, "append", "eventTime")


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """State of this kind needs the RocksDB provider, and each part of it costs a worker and a store in each micro-batch, so there are at most two for a core; what the session had set is put back."""
    parts = "spark.sql.shuffle.partitions"
    wanted = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, parts: str(min(int(spark.conf.get(parts)), 2 * spark.sparkContext.defaultParallelism))}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def replayed(rows: DataFrame, grace_s: float, cuts: int = 2, late: str = "3 hours") -> tuple[DataFrame, int]:
    """Stored rows as a stream of `cuts` micro-batches in order of arrival, until they are used up: the sessions given out, and the rows of state left."""
    spark = rows.sparkSession
    out = new_path(spark, "deadlines")
    bounds = rows.approxQuantile("seq", [k / cuts for k in range(1, cuts)], 0.001) if cuts > 1 else []
    low = left = None
    for k, high in enumerate([*bounds, None]):  # the stream goes on where it was once a cut is written, so each is one micro-batch, of as many files as there are
        part = rows if low is None else rows.where(F.col("seq") > low)
        part = part if high is None else part.where(F.col("seq") <= high)
        part.select(*[F.col(name).cast(kind).alias(name) for name, kind in (x.split() for x in IN.split(", "))]).write.parquet(f"{out}/in/{k:04}")
        low = high
        with state_in_rocksdb(spark):
            stream = spark.readStream.schema(IN).parquet(f"{out}/in/*")
            asked = by_deadline(stream, grace_s, late).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start(f"{out}/rows")
            asked.awaitTermination()
        left = next((p.stateOperators[0].numRowsTotal for p in reversed(asked.recentProgress) if p.stateOperators), left)
    return spark.read.schema(OUT).parquet(f"{out}/rows"), left or 0
