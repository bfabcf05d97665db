"""Keyed stateful jobs: request limits, reply assembly, import admissions, stalled-job watch, progress feed.

State per key is small and bounded: at most `limit` times, one reply, at most ten imports, one job.  It ends, too: a
reply, job or feed is forgotten when event time has passed its end by the patience of the job, a key's accepted times
after a time to live, if one is given; imports are kept, as an account's slots are.  Rows of a key inside one batch are put
in order first; a batch is bounded by the files it takes in.
"""

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.rate_limits import SlidingLog
from .runner import event_time


def _state(**fields):
    """State schemas are built where no session exists, so without DDL text."""
    return StructType([StructField(name, kind()) for name, kind in fields.items()])


def _in_order(key, rows, *columns):
    """The rows of a key sorted by columns, nulls last; those without a key are unrelated and stay as they come."""
    return rows if key[0] is None else sorted(rows, key=lambda r: [(r[c] is None, r[c] if r[c] is not None else 0) for c in columns])


class RequestLimit(StatefulProcessor):
    def __init__(self, limit, seconds, ttl=None):
        self.limit, self.micros, self.ttl = limit, seconds * 1_000_000, ttl

    def init(self, handle):
        self.times = handle.getListState("times", _state(t=LongType), ttlDurationMs=self.ttl and self.ttl * 1000)

    def handleInputRows(self, key, rows, timerValues):
        before = [t for (t,) in self.times.get()]
        log = SlidingLog(self.limit, self.micros, before)
        for row in _in_order(key, rows, "t", "request_id"):
            wait = log.offer(row.t)
            yield Row(key=row.key, request_id=row.request_id, accepted=wait == 0, retry_after=wait)
        if list(log.times) != before:
            self.times.put([(t,) for t in log.times])

    def close(self):
        pass


def limit_requests(requests, key, time, request_id, limit, seconds, ttl=None):
    """Streaming form of `replay_limits`: one verdict per request.

    With `ttl`, a key is forgotten after so many seconds without an accepted request (more than the window: requests may
    be handled late).  That takes the clock, so it is for streams that run on; one that only catches up never ends.
    """
    kinds = dict(requests.dtypes)
    staged = requests.select(
        F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"),
        F.col(request_id).alias("request_id"),
    )
    schema = f"key {kinds[key]}, request_id {kinds[request_id]}, accepted boolean, retry_after bigint"
    return staged.groupBy("key").transformWithState(
        RequestLimit(limit, seconds, ttl), schema, "Append", "ProcessingTime" if ttl else "None"
    ).select(F.col("key").alias(key), F.col("request_id").alias(request_id), "accepted", "retry_after")


def _one_timer(handle, at):
    """Put the key's only timer at a time in milliseconds."""
    for timer in handle.listTimers():
        handle.deleteTimer(timer)
    handle.registerTimer(at)


class ReplyAssembly(StatefulProcessor):
    """Tokens of a reply until its end marker; without one the reply fails after `patience` seconds.

    That a reply is closed, so that late tokens are ignored, is remembered for `patience` seconds more.
    """

    def __init__(self, patience):
        self.patience = patience * 1000

    def init(self, handle):
        self.handle = handle
        self.tokens = handle.getListState("tokens", _state(seq=LongType, token=StringType))
        self.closed = handle.getValueState("closed", _state(at=LongType))

    def _emit(self, key, status, text):
        self.tokens.clear()
        return pd.DataFrame({"reply_id": [key[0]], "status": [status], "content": [text]})

    def handleInputRows(self, key, rows, timerValues):
        if self.closed.exists():
            return
        held = list(self.tokens.get()) if self.tokens.exists() else []
        ended, latest = False, 0
        for frame in rows:
            latest = max(latest, frame["ts"].max().value // 1_000_000)
            for seq, token, end in zip(frame["seq"], frame["token"], frame["is_end"]):
                ended |= bool(end)
                if not end:
                    held.append((int(seq), token))
        if ended:
            text = "".join(token for _, token in sorted(held))
            self.closed.update((latest,))
            _one_timer(self.handle, latest + self.patience)
            yield self._emit(key, "COMPLETED" if text.strip() else "FAILED", text if text.strip() else None)
        else:
            if held:
                self.tokens.put(held)
            _one_timer(self.handle, latest + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.closed.exists():
            self.closed.clear()
        else:
            now = expiredTimerInfo.getExpiryTimeInMs()
            self.closed.update((now,))
            self.handle.registerTimer(now + self.patience)
            yield self._emit(key, "FAILED", None)  # an incomplete answer is never saved

    def close(self):
        pass


def assemble_replies(tokens, patience=60, delay="1 minute"):
    """tokens: (reply_id, seq, token, is_end, ts) -> (reply_id, status, content)."""
    kind = dict(tokens.dtypes)["reply_id"]
    return event_time(tokens, "ts", delay).groupBy("reply_id").transformWithStateInPandas(
        ReplyAssembly(patience), f"reply_id {kind}, status string, content string", "Append", "EventTime"
    )


class Admissions(StatefulProcessor):
    """Imports of one owner: a pair that holds a slot is reused, failed imports give theirs back at once."""

    def __init__(self, limit):
        self.limit = limit

    def init(self, handle):
        self.slots = handle.getListState("slots", _state(source_key=StringType, revision=StringType))

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(s) for s in self.slots.get()]
        before = len(held)
        for row in _in_order(key, rows, "at", "repository_id"):
            pair = (row.source_key, row.revision)
            outcome = "reused" if pair in held else "admitted" if len(held) < self.limit else "refused"
            if outcome == "admitted" and not row.failed:
                held.append(pair)
            yield Row(owner_id=row.owner_id, repository_id=row.repository_id, outcome=outcome)
        if len(held) > before:
            self.slots.put(held)

    def close(self):
        pass


def admit_imports(requests, limit):
    """requests: (owner_id, repository_id, source_key, revision, failed, created_at) -> outcome per request.

    The overall queue bound crosses owners, so it is checked on the table (`queue_depth`), not inside a key.
    """
    kinds = dict(requests.dtypes)
    schema = f"owner_id {kinds['owner_id']}, repository_id {kinds['repository_id']}, outcome string"
    at = F.col("created_at")
    staged = requests.select(
        "owner_id", "repository_id", "source_key", "revision", "failed",
        (F.unix_micros(at.cast("timestamp")) if kinds["created_at"].startswith("timestamp") else at).alias("at"),
    )
    return staged.groupBy("owner_id").transformWithState(Admissions(limit), schema, "Append", "None")


class StalledWatch(StatefulProcessor):
    """One job per key; silence for `patience` seconds of event time reports an open one as stalled and forgets any."""

    def __init__(self, patience, done):
        self.patience, self.done = patience * 1000, done

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", _state(at=LongType, status=StringType))

    def handleInputRows(self, key, rows, timerValues):
        at, status = self.last.get() if self.last.exists() else (-1, None)
        for frame in rows:
            for ts, s in zip(frame["ts"], frame["status"]):
                now = ts.value // 1_000_000
                if now >= at:
                    at, status = now, s
        self.last.update((at, status))
        _one_timer(self.handle, at + self.patience)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, status = self.last.get()
        self.last.clear()
        if status not in self.done:
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "silent_since": [at]})

    def close(self):
        pass


def watch_stalled(jobs, patience, done=("READY", "FAILED", "COMPLETED", "STALE"), delay="1 minute"):
    """jobs: (job_id, status, ts) -> (job_id, last status, silent_since in ms)."""
    kind = dict(jobs.dtypes)["job_id"]
    return event_time(jobs, "ts", delay).groupBy("job_id").transformWithStateInPandas(
        StalledWatch(patience, done), f"job_id {kind}, status string, silent_since bigint", "Append", "EventTime"
    )


class ProgressFeed(StatefulProcessor):
    """The status of a repository as its updates arrive; the first terminal status ends the feed.

    A feed is forgotten after `patience` seconds of event time without an update.
    """

    def __init__(self, patience, terminal):
        self.patience, self.terminal = patience * 1000, terminal

    def init(self, handle):
        self.handle = handle
        self.feed = handle.getValueState("feed", _state(at=LongType, status=StringType, seen=LongType))

    def handleInputRows(self, key, rows, timerValues):
        before = self.feed.get() if self.feed.exists() else None
        at, status, seen = before or (-1, None, -1)
        for frame in rows:
            for ts, s in zip(frame["ts"], frame["status"]):
                now, ended = ts.value // 1_000, status in self.terminal
                seen = max(seen, now)
                if (s in self.terminal and (not ended or now < at)) or (s not in self.terminal and not ended and now >= at):
                    at, status = now, s
        self.feed.update((at, status, seen))
        _one_timer(self.handle, seen // 1000 + self.patience)
        if before is None or (at, status) != before[:2]:
            yield pd.DataFrame({"repository_id": [key[0]], "status": [status], "terminal": [status in self.terminal], "updated_at": [pd.Timestamp(at, unit="us")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.feed.clear()
        return iter(())

    def close(self):
        pass


def feed_progress(updates, patience, terminal, delay="1 hour"):
    """updates: (repository_id, status, ts) -> a row per batch in which a repository's status has changed."""
    kind = dict(updates.dtypes)["repository_id"]
    return event_time(updates, "ts", delay).groupBy("repository_id").transformWithStateInPandas(
        ProgressFeed(patience, terminal), f"repository_id {kind}, status string, terminal boolean, updated_at timestamp", "Append", "EventTime"
    )
