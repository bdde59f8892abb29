"""Streams with kept state by key, on ``transformWithStateInPandas``: what is held lies in the state store, not in a worker's memory.

Rows of one batch come in no order. ``InOrder`` puts a batch's frames into map state by buckets of their order and reads them back
bucket by bucket, so a key's batch needs no more memory than its largest bucket. The state store must be RocksDB's, which
``keeps_state`` sees to; the provider is noted in each stream's checkpoint, so streams of other stores are not touched.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stripweave.operators.attempts import learn, new_preference
from stripweave.operators.dialogue import MENTION, Profiles, new_profiles
from stripweave.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000_000


def keeps_state(
    rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, *, time: str = "None", mode: str = "Update"
) -> DataFrame:
    """``rows`` by ``key`` through ``processor``; rows without a key take no part."""
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.filter(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(processor, schema, mode, time)


class InOrder(StatefulProcessor):
    """Reads each key's rows of a batch in ``order``; ``bucket`` gives the number of the bucket of each row of a frame, rising with the
    order. Frames are put together to ``together`` rows before they are parted into buckets: each bucket of each is an entry of the state."""

    def __init__(self, order: Sequence[str], bucket: Callable[[pd.DataFrame], pd.Series], together: int = 1) -> None:
        self.order, self.bucket, self.together = list(order), bucket, together

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getMapState("pending", "bucket long, frame int", "rows binary")

    def close(self) -> None:
        pass

    def in_order(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = self._together(frames)
        first = next(frames, None)
        second = next(frames, None)
        if first is None:
            return
        if second is None:  # all in one frame
            yield first.sort_values(self.order)
            return
        number = 0
        for frame in self._all(first, second, frames):
            for bucket, part in frame.groupby(self.bucket(frame)):
                self.pending.updateValue((int(bucket), number), (self._packed(part),))
            number += 1
        held: dict[int, list[int]] = {}
        for bucket, frame in self.pending.keys():
            held.setdefault(bucket, []).append(frame)
        for bucket in sorted(held):
            keys = [(bucket, frame) for frame in sorted(held[bucket])]
            parts = [self._unpacked(self.pending.getValue(k)[0]) for k in keys]
            yield pd.concat(parts).sort_values(self.order)
            for k in keys:
                self.pending.removeKey(k)

    def _together(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some, n = [], 0
        for frame in frames:
            some.append(frame)
            n += len(frame)
            if n >= self.together:
                yield pd.concat(some) if len(some) > 1 else frame
                some, n = [], 0
        if some:
            yield pd.concat(some)

    @staticmethod
    def _all(first: pd.DataFrame, second: pd.DataFrame, rest: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield first
        yield second
        yield from rest

    @staticmethod
    def _packed(part: pd.DataFrame) -> bytes:
        table, sink = pa.Table.from_pandas(part, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def _unpacked(held: bytes) -> pd.DataFrame:
        return pa.ipc.open_stream(bytes(held)).read_pandas()


def by_hour(frame: pd.DataFrame) -> pd.Series:
    return pd.to_datetime(frame["ts"]).astype("datetime64[ns]").astype("int64") // (3600 * SECOND)


class AttemptLearner(InOrder):
    """A domain's preferred method after each batch."""

    SCHEMA = "domain string, best string, delay double, attempts long, successes long"

    def __init__(self, methods: Sequence[str]) -> None:
        super().__init__(["ts", "attempt_id"], by_hour)
        self.methods = list(methods)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("preference", "state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        s = json.loads(self.held.get()[0]) if self.held.exists() else new_preference(self.methods)
        for frame in self.in_order(rows):
            for r in frame.itertuples(index=False):
                learn(s, self.methods, r.method, bool(r.success), bool(r.blocked))
        self.held.update((json.dumps(s),))
        names = ["best", "delay", "attempts", "successes"]
        yield pd.DataFrame({"domain": [key[0]]} | {c: [s[c]] for c in names})


class ArmLearner(InOrder):
    """An arm's requests, successes, moving average of latency and end of cooldown after each batch. A timer tells when a cooldown ends;
    an arm not heard of for ``forget_s`` seconds is forgotten."""

    SCHEMA = "arm string, requests long, successes long, ema double, cooldown_end timestamp, cooling boolean"

    def __init__(self, blocked_s: int, failing_s: int, forget_s: int) -> None:
        super().__init__(["ts", "attempt_id"], by_hour)
        self.blocked_s, self.failing_s, self.forget_s = blocked_s, failing_s, forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.held = handle.getValueState("arm", "n long, ok long, ema double, until long", self.forget_s * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, ok, ema, until = self.held.get() if self.held.exists() else (0, 0, 5.0, None)
        for frame in self.in_order(rows):
            at = pd.to_datetime(frame["ts"]).astype("datetime64[us]").astype("int64") // 1000
            for t, r in zip(at.tolist(), frame.itertuples(index=False), strict=True):
                rate, n, pause = ok / max(n, 1), n + 1, None
                if r.success:
                    ok += 1
                elif r.blocked:
                    pause = self.blocked_s
                elif ok == 0 or (rate < 0.2 and n > 5):
                    pause = self.failing_s
                until = until if pause is None else t + pause * 1000
                ema = 0.3 * float(r.duration) + 0.7 * ema
        self.held.update((n, ok, ema, until))
        now = timerValues.getCurrentProcessingTimeInMs()
        for timer in list(self.handle.listTimers()):  # of an earlier cooldown
            self.handle.deleteTimer(timer)
        if until is not None and until > now:
            self.handle.registerTimer(until)
        yield self._told(key, n, ok, ema, until, until is not None and until > now)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            yield self._told(key, *self.held.get(), False)

    @staticmethod
    def _told(key: tuple, n: int, ok: int, ema: float, until: int | None, cooling: bool) -> pd.DataFrame:
        end = pd.to_datetime(pd.Series([until]), unit="ms", utc=True)
        row = {"arm": [key[0]], "requests": [n], "successes": [ok], "ema": [ema]}
        return pd.DataFrame(row | {"cooldown_end": end, "cooling": [cooling]})


class IdentityStream(InOrder):
    """The profile of each mention; a series' profiles, names and mergers are map state, of which only what a batch changes is written."""

    PROFILE = "aliases array<string>, signatures array<array<double>>, first long, last long, seen long"

    #: Chapters of a bucket, and rows of a batch that are parted into buckets together.
    BUCKET, TOGETHER = 512, 50_000

    def __init__(self) -> None:
        each = self.BUCKET
        super().__init__(["chapter", "block"], lambda frame: frame["chapter"] // each, self.TOGETHER)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.made = handle.getValueState("made", "n int")
        self.profiles = handle.getMapState("profiles", "id string", self.PROFILE)
        self.names = handle.getMapState("names", "name string", "id string")
        self.merged = handle.getMapState("merged", "id string", "keeper string")

    def _load(self) -> Profiles:
        p = new_profiles()
        p.made = self.made.get()[0] if self.made.exists() else 0
        for (name,), (aliases, signatures, first, last, seen) in self.profiles.iterator():
            vectors = [list(s) for s in signatures]
            p.all[name] = {"aliases": list(aliases), "signatures": vectors, "first": first, "last": last, "seen": seen}
        p.names = {k: v for (k,), (v,) in self.names.iterator()}
        p.merged = {k: v for (k,), (v,) in self.merged.iterator()}
        return p

    def _rows(self, p: Profiles) -> list[tuple[object, dict]]:
        fields = ("aliases", "signatures", "first", "last", "seen")
        every = {k: tuple(list(v[f]) if isinstance(v[f], list) else int(v[f]) for f in fields) for k, v in p.all.items()}
        names, merged = ({k: (v,) for k, v in x.items()} for x in (p.names, p.merged))
        return [(self.profiles, every), (self.names, names), (self.merged, merged)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        p = self._load()
        before = self._rows(p)
        columns = [f.split()[0] for f in MENTION.split(", ")]
        for frame in self.in_order(rows):
            out = []
            for r in frame.itertuples(index=False):
                signature = [] if r.signature is None else [float(x) for x in r.signature]
                name = r.name_hint if isinstance(r.name_hint, str) else None
                out.append((r.series, r.chapter, r.block, *p.observe(int(r.chapter), name, signature)))
            yield pd.DataFrame(out, columns=columns)
        self.made.update((p.made,))
        for (state, new), (_, old) in zip(self._rows(p), before, strict=True):
            for k in old.keys() - new.keys():
                state.removeKey((k,))
            for k, v in new.items():
                if old.get(k) != v:
                    state.updateValue((k,), v)


#: Fixed value: chapters whose names are one entry of the state.
CHAPTERS_EACH = 64


class ReadOnce:
    """A map state of which each entry is read once and, where it was put, written once by ``flush``; None is no entry."""

    def __init__(self, state: object, unpacked: Callable[[tuple], object], packed: Callable[[object], tuple]) -> None:
        self.state, self.unpacked, self.packed = state, unpacked, packed
        self.now: dict = {}
        self.changed: set = set()

    def get(self, key: object) -> object:
        if key not in self.now:
            self.now[key] = self.unpacked(self.state.getValue((key,))) if self.state.containsKey((key,)) else None
        return self.now[key]

    def put(self, key: object, value: object) -> None:
        self.now[key] = value
        self.changed.add(key)

    def all(self) -> Iterator[object]:
        yield from (v for v in self.now.values() if v is not None)
        yield from (self.unpacked(v) for (k,), v in self.state.iterator() if k not in self.now)

    def flush(self) -> dict:
        """What was put, by key."""
        for key in self.changed:
            if self.now[key] is None:
                self.state.removeKey((key,))
            else:
                self.state.updateValue((key,), self.packed(self.now[key]))
        return {key: self.now[key] for key in self.changed}


class ChapterMemory(StatefulProcessor):
    """What is remembered of a series: its chapters under the retention rule, and in how many of all chapters each character was.

    A chapter that comes again replaces itself if it was sent later than the one held, else it changes nothing; so batches may come
    twice, and chapters in any order. Out go the changes: the latest of each chapter and character is what holds.
    """

    SCHEMA = (
        "series string, kind string, chapter long, name string, kept boolean, characters long, dialogue_count long, "
        "has_action boolean, appearances long, first_chapter long, last_seen long"
    )

    def __init__(self, most: int, recent: int, older: int) -> None:
        self.most, self.recent, self.older = most, recent, older

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "chapter long", "characters long, dialogue_count long, has_action boolean")
        self.told = handle.getMapState("told", "bucket long", "chapters string")  # by chapter when it was sent and its names, as JSON
        self.cast = handle.getMapState("cast", "name string", "appearances long, first long, last long")

    def close(self) -> None:
        pass

    def _character(self, told: ReadOnce, cast: ReadOnce, name: str, chapter: int, *, here: bool) -> None:
        n, first, last = cast.get(name) or (0, chapter, chapter)
        if here:
            cast.put(name, (n + 1, min(first, chapter), max(last, chapter)))
        elif n <= 1:
            cast.put(name, None)
        else:
            if chapter in (first, last):  # the ends are looked for anew
                rest = [int(c) for held in told.all() for c, (_, names) in held.items() if int(c) != chapter and name in names]
                first, last = min(rest), max(rest)
            cast.put(name, (n - 1, first, last))

    def _dropped(self, held: dict[int, tuple]) -> list[int]:
        """The chapters that the retention rule leaves out."""
        every = sorted(((c, *v) for c, v in held.items()), reverse=True)
        if len(every) <= self.most:
            return []
        score = lambda c, n, lines, act: (-(2 * n + 0.1 * lines + (5 if act else 0)), c)
        return [c for _, c in sorted(score(*x) for x in every[self.recent :])[self.older :]]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        chapters, changed = {}, {}
        for frame in rows:
            # What a frame's rows need of the state is read and written once for the frame: a call for each row and name takes a tenth of a millisecond and more.
            told = ReadOnce(self.told, lambda v: json.loads(v[0]), lambda v: (json.dumps(v),))
            cast = ReadOnce(self.cast, tuple, tuple)
            for r in frame.itertuples(index=False):
                chapter, new = int(r.chapter), sorted(set(r.names))
                bucket = chapter // CHAPTERS_EACH
                held = told.get(bucket) or {}
                sent, old = held.get(str(chapter), (None, []))
                if sent is not None and int(r.sent) <= sent:
                    continue
                for name in set(old) - set(new):
                    self._character(told, cast, name, chapter, here=False)
                held[str(chapter)] = (int(r.sent), new)
                told.put(bucket, held)
                for name in set(new) - set(old):
                    self._character(told, cast, name, chapter, here=True)
                chapters[chapter] = (True, len(new), int(r.dialogue_count), bool(r.has_action))
            changed |= cast.flush()
            told.flush()
        before = {c: tuple(v) for (c,), v in self.kept.iterator()}
        held = before | {c: v[1:] for c, v in chapters.items()}
        for chapter in self._dropped(held):  # those of this batch never enter the state
            del held[chapter]
            chapters[chapter] = (False, None, None, None)
        for chapter in before.keys() - held.keys():
            self.kept.removeKey((chapter,))
        for chapter, about in held.items():
            if before.get(chapter) != about:
                self.kept.updateValue((chapter,), about)
        out = [(key[0], "chapter", c, None, *v, None, None, None) for c, v in sorted(chapters.items())]
        for name, counts in sorted(changed.items()):
            out.append((key[0], "character", None, name, counts is not None, None, None, None, *(counts or (0, None, None))))
        columns = [f.split()[0] for f in self.SCHEMA.split(", ")]
        frame = pd.DataFrame(out, columns=columns)
        yield frame.astype({c: "Int64" for c in ("chapter", "characters", "dialogue_count", *columns[-3:])} | {"has_action": "boolean"})
