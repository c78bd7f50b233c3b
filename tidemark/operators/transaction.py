"""Events into transactions by keys, start and end brackets, span and count limits."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.args import ArgumentError, names_of
from tidemark.operators.ordered import Laid, lay, reached, span_links
from tidemark.scratch import written

# Names that are not fields of an event.
RESERVED = ("_time", "_message", "_duration", "_event_count", "_is_closed", "$transaction_starts_with$", "$transaction_ends_with$")
DEFAULT_MAX_EVENTS = 1000
_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def span_micros(text: str | None) -> int | None:
    """The first number and unit in the text, in microseconds; none if unset or negative."""
    if not text:
        return None
    if not (m := re.search(r"(-?\d+)([smhd])", text)):
        raise ArgumentError(f"max_span cannot be read: {text}")
    return None if int(m[1]) < 0 else int(m[1]) * _SECONDS[m[2]] * 1_000_000


@dataclass
class Params:
    fields: list[str]
    starts_with: str = ""
    starts_with_regex: str = ""
    starts_if_field: str = ""
    ends_with: str = ""
    ends_with_regex: str = ""
    ends_if_field: str = ""
    span: int | None = None
    max_events: int | None = DEFAULT_MAX_EVENTS
    names: tuple = field(default=(), repr=False)

    @property
    def starts(self) -> bool:
        return bool(self.starts_with or self.starts_with_regex or self.starts_if_field)

    @property
    def ends(self) -> bool:
        return bool(self.ends_with or self.ends_with_regex or self.ends_if_field)

    def closed(self, start: bool, end: bool) -> bool:
        return (start or not self.starts) and (end or not self.ends)


# -- one key's events ------------------------------------------------------------------------------


class _Live:
    """Live groups by key, found by the parts that two keys both know.

    A key's mask tells which of its parts it has. For each mask, and each of its submasks that has been
    asked for, keys are held by their values there, in the order in which they were last touched: a lookup is
    one probe for each mask, whatever the number of groups.
    """

    def __init__(self):
        self.group: dict[tuple, int] = {}
        self.index: dict[int, dict[int, dict[tuple, dict[tuple, None]]]] = {}

    @staticmethod
    def _mask(key: tuple) -> int:
        return sum(1 << i for i, a in enumerate(key) if a is not None)

    @staticmethod
    def _part(key: tuple, mask: int) -> tuple:
        return tuple(a for i, a in enumerate(key) if mask >> i & 1)

    def get(self, key: tuple) -> int | None:
        return self.group.get(key)

    def __setitem__(self, key: tuple, group: int) -> None:
        self.group[key] = group
        for mask, held in self.index.setdefault(self._mask(key), {0: {}}).items():
            held.setdefault(self._part(key, mask), {})[key] = None

    def pop(self, key: tuple) -> int:
        for mask, held in self.index[self._mask(key)].items():
            same = held[part := self._part(key, mask)]
            del same[key]
            if not same:
                del held[part]
        return self.group.pop(key)

    def touch(self, key: tuple) -> None:
        for mask, held in self.index[self._mask(key)].items():
            same = held[self._part(key, mask)]
            same[key] = same.pop(key)

    def best(self, key: tuple, time: int, oldest: list[int]) -> tuple | None:
        """Of the live keys that differ from ``key`` in no part that both know: one with the most such parts, then
        the oldest event nearest to ``time`` (none is newer than ``time``, so it was touched last), then the least, unknown parts first."""
        own, found, choice = self._mask(key), None, None
        for mask, held in self.index.items():
            both = mask & own
            if both not in held:
                held[both] = {}
                for k in held[0].get((), ()):
                    held[both].setdefault(self._part(k, both), {})[k] = None
            last = None
            for k in reversed(held[both].get(self._part(key, both), ())):
                at = oldest[self.group[k]]
                if last is not None and at != last:
                    break
                last = at
                rank = (-both.bit_count(), abs(time - at), tuple((a is not None, a or "") for a in k))
                if found is None or rank < found:
                    found, choice = rank, k
        return choice


class _Replay:
    """Deals one key's events, newest first, to groups: ends with limits, and null keys. What comes out are
    numbers only: the group of each event, which groups are closed, and which events lend a full group
    no more than their time."""

    def __init__(self, params: Params):
        self.p = params
        self.group_of: list[int] = []
        self.time_only: list[bool] = []
        self.count: list[int] = []
        self.end: list[bool] = []
        self.newest: list[int] = []
        self.oldest: list[int] = []
        self.key_of: dict[int, tuple] = {}
        self.state: list[bool | None] = []  # None while the group is open for events
        self.queue: deque[tuple[int, int]] = deque()
        self.live = _Live()
        self.stack: dict[int, None] = {}  # in order of opening; any of them may leave
        self.waiting: list[int] = []  # events of the live group while only ends are told
        self.limit = params.max_events if params.max_events is not None else 1 << 62

    def new(self, time: int, end: bool = False) -> int:
        for column, value in ((self.count, 0), (self.end, end), (self.newest, time), (self.oldest, time), (self.state, None)):
            column.append(value)
        self.queue.append((len(self.count) - 1, time))
        return len(self.count) - 1

    def put(self, group: int, i: int, time: int) -> None:
        """Event i joins the group; a full one takes its time only."""
        self.group_of[i] = group
        self.time_only[i] = self.full(group)
        self.count[group] += not self.time_only[i]
        self.oldest[group] = min(self.oldest[group], time)
        if group in self.key_of:
            self.live.touch(self.key_of[group])

    def wait(self, group: int, key: tuple = ()) -> int:
        """The group is the live one of the key."""
        self.live[key], self.key_of[group] = group, key
        return group

    def top(self) -> int:
        return next(reversed(self.stack))

    def full(self, group: int) -> bool:
        return self.count[group] >= self.limit

    def freeze(self, group: int, closed: bool | None = None) -> None:
        self.state[group] = self.p.closed(False, self.end[group]) if closed is None else closed
        self.stack.pop(group, None)
        key = self.key_of.pop(group, None)
        if key is not None and self.live.get(key) == group:
            self.live.pop(key)

    def expire(self, time: int) -> None:
        while self.p.span is not None and self.queue and time < self.queue[0][1] - self.p.span:
            group, _ = self.queue.popleft()
            if self.state[group] is None:
                self.freeze(group)

    def run(self, times, ends, keys, last: int):
        n, self.times = len(times), times
        self.group_of, self.time_only = [-1] * n, [False] * n
        step = self.ended if self.p.ends else self.grouped
        for i in range(n):
            self.expire(int(times[i]))
            step(i, int(times[i]), bool(ends[i]), keys[i])
        self.expire(last)
        return self.drain()

    def ended(self, i: int, time: int, end: bool, key: tuple) -> None:
        if end:
            group = self.new(time, True)
            self.put(group, i, time)
            self.stack[group] = None
            # Of earlier (newer) events that wait, only those of the same instant can still join.
            while self.p.span and (live := self.live.get(())) is not None and not self.full(group) and self.oldest[live] == time:
                j = self.waiting.pop()
                self.group_of[j] = group
                self.count[group] += 1
                self.count[live] -= 1
                if not self.waiting:
                    self.freeze(live, False)
                    break
                self.oldest[live] = self.times[self.waiting[-1]]
            if self.full(group):
                self.freeze(group, True)
            return
        while self.stack and (self.full(self.top()) or self.p.span and time < self.newest[self.top()] - self.p.span):
            self.freeze(self.top())
        if self.stack:
            group = self.top()
            self.put(group, i, time)
            if self.full(group):
                self.freeze(group)
            return
        live = self.live.get(())
        if live is None:
            live, self.waiting = self.wait(self.new(time)), []
        self.waiting.append(i)
        self.group_of[i] = live  # the waiting events have no cap; drain() cuts them
        self.count[live] += 1
        self.oldest[live] = time

    def grouped(self, i: int, time: int, end: bool, key: tuple) -> None:
        group = self.live.get(key)
        partial = None in key
        if group is None or partial:
            best = self.live.best(key, time, self.oldest)
            if best is not None and partial:
                group = self.live.get(best)
            elif best is not None and None in best:
                group = self.wait(self.live.pop(best), key)
        if group is None:
            group = self.wait(self.new(time), key)
        self.put(group, i, time)
        if self.full(group):
            self.freeze(group)

    def drain(self):
        """(group of each event, time only, closed by group, groups whose messages stay newest first)."""
        only_ends, cut = self.p.ends, set()
        for group, state in enumerate(self.state):
            if state is not None:
                continue
            if only_ends:
                self.state[group] = self.end[group]
            else:
                self.state[group] = self.p.span is not None and self.newest[group] - self.oldest[group] >= self.p.span
        if only_ends:
            for group in range(len(self.state)):
                if group < len(self.end) and not self.end[group] and self.count[group] > self.limit:
                    own = [i for i, g in enumerate(self.group_of) if g == group]
                    for lo in range(0, len(own), self.limit):
                        self.state.append(False)
                        cut.add(len(self.state) - 1)
                        for i in own[lo : lo + self.limit]:
                            self.group_of[i] = len(self.state) - 1
        return self.group_of, self.time_only, self.state, cut


def replay(params: Params, times, ends, keys, last: int):
    """Groups of one key's events, sorted newest first; ``last``: the oldest time of any event."""
    return _Replay(params).run(times, ends, keys, last)


# -- the plan --------------------------------------------------------------------------------------


def _texts(c: Column, kind: T.DataType) -> Column:
    """A column's values as texts: a list's items, or the one value; null where there is none."""
    if isinstance(kind, T.ArrayType):
        return F.array_compact(F.flatten(F.transform(c, lambda x: F.coalesce(_texts(x, kind.elementType), F.array().cast("array<string>"))))) if isinstance(kind.elementType, T.ArrayType) else F.array_compact(F.transform(c, lambda x: _text(x, kind.elementType)))
    return F.when(c.isNotNull(), F.array(_text(c, kind)))


def _text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):  # whole numbers without ".0", none with an exponent
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def _micros(df: DataFrame) -> Column:
    kind = df.schema["_time"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col("_time").cast("timestamp"))
    return F.col("_time").cast("string").try_cast("bigint")


def transaction(df: DataFrame, fields: str | list[str] = "", *, starts_with: str = "", starts_with_regex: str = "", starts_if_field: str = "", ends_with: str = "", ends_with_regex: str = "", ends_if_field: str = "", max_span: str = "", max_events: int = DEFAULT_MAX_EVENTS) -> DataFrame:
    """A row per transaction: _time, _message, _duration, _event_count, _is_closed, then the other
    columns by name, keys as texts and the rest as sorted lists of distinct texts.

    Events are taken newest first by ``_time``; ties come in any order. Keys without nulls are grouped by
    counts and spans, and brackets with a start are matched, by scans over ranges of (key, time): a key of any size
    is many tasks (see bracket_groups() and chains()). Ends alone with limits, and null keys, which are
    wildcards when grouping, are replayed by a small state machine that returns group numbers, one key
    a task; with null keys rows are dealt by the key columns that are never null, all together if there is none.
    """
    names = names_of(fields) if isinstance(fields, str) else list(fields)
    p = Params(names, starts_with, starts_with_regex, starts_if_field, ends_with, ends_with_regex, ends_if_field, span_micros(max_span), None if max_events < 0 else max_events)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    message = _texts(F.col("_message"), kinds["_message"]) if "_message" in kinds else F.lit(None).cast("array<string>")
    extras = sorted((n for n in kinds if n not in RESERVED and n not in names), key=lambda n: n.encode())
    events = df.select(_micros(df).alias("_t"), message.alias("_m"), *[F.nullif(F.trim(F.get(_texts(F.col(f"`{n}`"), kinds[n]), F.lit(0))), F.lit("")).alias(f"_k{i}") if n in kinds else F.lit(None).cast("string").alias(f"_k{i}") for i, n in enumerate(names)], *[_texts(F.col(f"`{n}`"), kinds[n]).alias(f"_x{i}") for i, n in enumerate(extras)], _mark(p.starts_with, p.starts_with_regex, p.starts_if_field, kinds).alias("_s"), _mark(p.ends_with, p.ends_with_regex, p.ends_if_field, kinds).alias("_e"))
    keys = [f"_k{i}" for i in range(len(names))]
    bracket = p.starts or p.ends
    some = [F.col(k).isNotNull() for k in keys]
    events = events.filter("_t IS NOT NULL")
    if keys:
        ok = some[0]
        for c in some[1:]:
            ok = ok & c if bracket else ok | c
        events = events.filter(ok)
    elif not bracket:
        events = events.limit(0)
    grouped = _grouped(events, p, keys)
    return _collected(grouped, names, keys, extras)


def _mark(text: str, pattern: str, flag: str, kinds: dict) -> Column:
    out = F.lit(False)
    if text:
        out = out | F.coalesce(F.exists("_m", lambda x: x.contains(text)), F.lit(False))
    if pattern:
        re.compile(pattern)
        out = out | F.coalesce(F.exists("_m", lambda x: x.rlike(pattern)), F.lit(False))
    if flag and flag in kinds:
        values = _texts(F.col(f"`{flag}`"), kinds[flag])
        out = out | (values.isNotNull() & F.forall(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(x) == "true"))
    return out


@dataclass
class _Closing:
    """Events with their groups, and the aggregate that tells whether a group is closed."""

    events: DataFrame
    closed: Column


def _grouped(events: DataFrame, p: Params, keys: list[str]) -> DataFrame | _Closing:
    """Events with _g (group within its keys), _closed, _only (lends its time only), _plain (newest first)."""
    flags = lambda group, closed: events.select("*", group.alias("_g"), closed.alias("_closed"), F.lit(False).alias("_only"), F.lit(False).alias("_plain"), F.col("_t").alias("_seq"))
    if p.max_events == 0 or p.span == 0:
        alone = F.col("_s") & F.col("_e") if p.starts and p.ends else F.lit(not p.starts and not p.ends)
        return flags(F.monotonically_increasing_id(), alone)
    newest = Window.partitionBy(*keys).orderBy(F.desc("_t"))
    oldest = Window.partitionBy(*keys).orderBy(F.asc("_t"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = p.span is None
    if not p.starts and not p.ends:
        if not keys or not any(events.agg(*[F.max(F.col(k).isNull().cast("int")).alias(k) for k in keys]).first()):
            if free and p.max_events is None:
                return flags(F.lit(0).cast("bigint"), F.lit(False))
            if not free:
                return _spanned(events, p, keys)
            number = F.row_number().over(newest) - 1
            chunk = F.floor(number / p.max_events).cast("bigint")
            sized = flags(chunk, F.lit(False))
            return sized.withColumn("_closed", F.count("*").over(Window.partitionBy(*keys, "_g")) == p.max_events)
    if free and p.max_events is None and p.starts != p.ends:
        mark = F.col("_s") if p.starts else F.col("_e")
        island = F.sum(mark.cast("bigint")).over(upto(oldest if p.starts else newest))
        return flags(island, island > 0)
    return _bracketed(events, p, keys) if p.starts else _replayed(events, p, keys)


_SLIM = ("_part", "_no", "_t", "_s", "_e")


def _placed(events: DataFrame, keys: list[str]) -> Laid:
    return lay(events, keys, [F.desc("_t")], [c for c in events.columns if c not in keys], "events")


def _put(laid: Laid, groups: DataFrame) -> DataFrame:
    """The events with what ``groups`` (_no, _g, _only, _more) tells of them."""
    told = groups.select(F.col("_no").alias("_n"), "_g", "_only", "_more")
    return laid.rows.join(told, F.col("_no") == F.col("_n")).drop("_n", "_part").withColumn("_plain", F.lit(False)).withColumn("_seq", F.col("_t"))


def _spanned(events: DataFrame, p: Params, keys: list[str]) -> _Closing:
    """Keys alone: a group is closed once a later one begins, the whole table goes on for longer than the
    span, the group itself lasts that long, or it is full."""
    laid = _placed(events, keys)
    last = laid.rows.agg(F.min("_t")).first()[0]
    slim = laid.on(laid.rows.select(*keys, "_part", "_no", "_t", F.lit(0).alias("_seg")))
    rows = chains(slim, p.span, p.max_events)
    out = _put(laid, rows)
    full = F.lit(False) if p.max_events is None else F.sum(F.lit(1)) >= p.max_events
    return _Closing(out, F.coalesce(F.max(F.when(F.col("_no") == F.col("_g"), F.col("_more"))), F.lit(False)) | (F.max("_t") - p.span > F.lit(last if last is not None else 0)) | (F.max("_t") - F.min("_t") >= p.span) | full)


def _bracketed(events: DataFrame, p: Params, keys: list[str]) -> _Closing:
    """Starts, with or without ends: a group is closed if it has what was asked for."""
    laid = _placed(events, keys)
    slim = laid.on(laid.rows.select(*keys, *_SLIM))
    groups = bracket_groups(slim, p) if p.ends else chains(_segments(slim), p.span, p.max_events)
    closed = F.max("_s") & F.max("_e") if p.ends else F.max("_s")
    return _Closing(_put(laid, groups), closed)


def _segments(rows: Laid) -> Laid:
    """Add _seg, the number of starts that are newer than the row: a start is the oldest event of its group."""
    return rows.total(F.col("_s").cast("int"), "_seg", inclusive=False)


def bracket_groups(slim: Laid, p: Params) -> DataFrame:
    """_no, _g, _only and _more of each event, newest first, where an end opens a group and a start closes it.

    How many groups are open ahead of an event is depth(); an event joins the last end that opened at its
    own depth. What finds none open, or one beyond the span (then all that are open are), forms the
    groups that no end leads: events up to and with a start. Ends whose groups outgrow ``max_events``
    are taken, with all up to where nothing is open, to a replay of that stretch alone.
    """
    both, opens, shuts = (F.col("_s") & F.col("_e")), (F.col("_e") & ~F.col("_s")), (F.col("_s") & ~F.col("_e"))
    level = F.when(both, F.lit(0)).when(opens, F.col("_depth") + 1).otherwise(F.col("_depth"))
    step = F.when(opens, 1).when(shuts, -1).otherwise(0)
    deep = slim.depth(step, "_depth")
    deep = deep.on(deep.rows.withColumn("_level", level.cast("bigint")).drop("_depth")).settled("levels")
    found = deep.last(F.when(opens, F.struct("_no", "_t")), "_open", "_level")
    reach = F.lit(True) if p.span is None else F.col("_open._t") - p.span <= F.col("_t")
    stacked = (F.col("_level") > 0) & reach
    rows = found.on(found.rows.withColumn("_g", F.when(both, F.col("_no")).when(stacked, F.col("_open._no"))).withColumn("_only", F.lit(False)).drop("_open"))
    if p.max_events is not None:
        rows = _within_limit(rows, p, opens)
    rows = rows.settled("stacked") if p.span is None else rows.on(written(rows.rows, "stacked"))
    live = chains(_segments(rows.on(rows.rows.filter("_g IS NULL"))), p.span, p.max_events)
    whole = ("_no", "_g", "_only", "_more")
    return rows.rows.filter("_g >= 0").withColumn("_more", F.lit(None).cast("boolean")).select(*whole).unionAll(live.select(*whole))


def _within_limit(rows: Laid, p: Params, opens: Column) -> Laid:
    """Replace _g (null: none) where a group has more than ``max_events``; -1 is for events that go."""
    rows = rows.on(written(rows.rows, "matched"))
    sizes = rows.rows.filter("_g IS NOT NULL").groupBy("_g").count()
    over = sizes.filter(F.col("count") > p.max_events).select(F.col("_g").alias("_big"))
    if p.max_events > 1 and over.isEmpty():
        return rows
    # A stretch begins where an end opens at depth 1 and holds all events at depth 1 or more.
    named = rows.last(F.when(opens & (F.col("_level") == 1), F.col("_no")), "_stretch").rows.filter("_level > 0")
    if p.max_events > 1:
        bad = named.join(over, F.col("_g") == F.col("_big"), "left_semi").select(F.col("_stretch").alias("_bad")).distinct()
        named = named.join(bad, F.col("_stretch") == F.col("_bad"), "left_semi")
    again = named.select("_stretch", "_no", "_t", "_s", "_e").repartition("_stretch").sortWithinPartitions("_stretch", "_no").mapInArrow(_limited(p), "_n bigint, _g2 bigint, _o2 boolean")
    told = rows.rows.join(again, F.col("_no") == F.col("_n"), "left")
    hit = F.col("_n").isNotNull()
    return rows.on(told.withColumn("_g", F.when(hit, F.col("_g2")).otherwise(F.col("_g"))).withColumn("_only", F.when(hit, F.col("_o2")).otherwise(F.col("_only"))).drop("_n", "_g2", "_o2"))


def _limited(p: Params):
    """Stretches one after the other, a few numbers of each open group held: (_n, _g2, _o2) of each event."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, stack = None, []
        for batch in batches:
            out: list[tuple] = []
            for stretch, no, time, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stretch != here:
                    here, stack = stretch, []
                if stack and p.span is not None and stack[-1][1] - p.span > time:
                    stack = []
                if end:
                    stack.append([no, time, 1])
                    out.append((no, no, False))
                    continue
                if start and stack and stack[-1][2] >= p.max_events:
                    stack.pop()
                if not stack:
                    out.append((no, None, False))
                    continue
                full = stack[-1][2] >= p.max_events
                out.append((no, stack[-1][0] if start or not full else -1, full))
                stack[-1][2] += 1
                if start or stack[-1][2] >= p.max_events:
                    stack.pop()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.bool_())], ["_n", "_g2", "_o2"])

    return match


def chains(laid: Laid, span: int | None, limit: int | None) -> DataFrame:
    """_no, _g (the _no of the group's newest event), _only (false) and _more (another group follows in the same _seg) of
    rows with _t and _seg, newest first: a group takes events no older than its newest less the span,
    ``limit`` at most, of one _seg.

    A row after a gap beyond the span begins a group whatever is before it. Elsewhere each row is linked to
    the one that would begin the next group if it began one, and reached() walks those links.
    """
    keys = laid.keys
    laid = laid.last(F.struct("_t", "_seg"), "_prev", inclusive=False)
    alone = F.col("_prev").isNull() | (F.col("_prev._seg") != F.col("_seg"))
    gap = F.lit(False) if span is None else F.col("_prev._t") - span > F.col("_t")
    laid = laid.on(laid.rows.withColumn("_first", alone).withColumn("_root", alone | gap).drop("_prev"))
    if limit is not None:
        laid = laid.total(F.lit(1), "_c")
    if span is None:
        head = F.col("_root")
        if limit is not None:
            laid = laid.settled("counted").last(F.when(F.col("_first"), F.col("_c")), "_c0")
            head = (F.col("_c") - F.col("_c0")) % limit == 0
        out = laid.settled("chained").last(F.when(head, F.col("_no")), "_g")
        return out.rows.select("_no", "_g", F.lit(False).alias("_only"), F.lit(None).cast("boolean").alias("_more"))
    laid = laid.on(written(laid.rows, "gaps"))
    links = span_links(laid, [*keys, "_seg"], span)
    if limit is not None:
        ahead = laid.rows.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], F.col("_seg").alias("_os"), (F.col("_c") - limit).alias("_oc"), F.col("_no").alias("y2"))
        same = (F.col("_c") == F.col("_oc")) & (F.col("_seg") == F.col("_os"))
        for i, k in enumerate(keys):
            same = same & (F.col(k) == F.col(f"_o{i}"))
        full = laid.rows.join(ahead, same).select(F.col("_no").alias("x"), F.col("y2").alias("y"))
        links = links.unionAll(full).groupBy("x").agg(F.min("y").alias("y"))
    links = written(links, "nexts")
    roots = laid.rows.filter("_root").select(F.col("_no").alias("no"))
    inner = links.join(roots, F.col("y") == F.col("no"), "left_anti")
    heads = reached(roots, inner).select(F.col("no").alias("_head"))
    more = links.select(F.col("x").alias("_x"))
    marked = laid.rows.join(heads, F.col("_no") == F.col("_head"), "left").join(more, F.col("_no") == F.col("_x"), "left")
    out = laid.on(marked.withColumn("_more", F.col("_x").isNotNull()).drop("_x")).settled("marked").last(F.col("_head"), "_g")
    return out.rows.select("_no", "_g", F.lit(False).alias("_only"), "_more")


def _replayed(events: DataFrame, p: Params, keys: list[str]) -> DataFrame:
    whole = not p.ends
    deal = keys
    if whole:
        nulls = events.agg(*[F.sum(F.col(k).isNull().cast("int")).alias(k) for k in keys]).first()
        deal = [k for k in keys if not nulls[k]]
    last = events.agg(F.min("_t")).first()[0] if p.span is not None else 0
    schema = T.StructType([*events.schema.fields, T.StructField("_g", T.LongType()), T.StructField("_closed", T.BooleanType()), T.StructField("_only", T.BooleanType()), T.StructField("_plain", T.BooleanType()), T.StructField("_seq", T.LongType())])

    names = [f.name for f in schema.fields]

    def assigned(table: pa.Table, owners: list[tuple]) -> list[pa.RecordBatch]:
        """Whole keys, one after the other, each newest first."""
        times, ends = (table.column(c).to_pylist() for c in ("_t", "_e"))
        tuples = list(zip(*(table.column(k).to_pylist() for k in keys), strict=True)) if whole else [()] * table.num_rows
        added: list[list] = [[], [], [], [], []]
        lo = 0
        for hi in range(1, len(owners) + 1):
            if hi < len(owners) and owners[hi] == owners[lo]:
                continue
            group, only, closed, plain = replay(p, times[lo:hi], ends[lo:hi], tuples[lo:hi], last if last is not None else 0)
            for column, values in zip(added, (group, [g >= 0 and bool(closed[g]) for g in group], only, [g in plain for g in group], range(hi - lo, 0, -1)), strict=True):
                column.extend(values)
            lo = hi
        for name, values, kind in zip(names[-5:], added, (pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64()), strict=True):
            table = table.append_column(name, pa.array(values, kind))
        return table.filter(pa.array([g >= 0 for g in added[0]], pa.bool_())).to_batches()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # of the key that may go on in the next batch
        owner, n_held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            owners = list(zip(*(table.column(k).to_pylist() for k in deal), strict=True)) if deal else [()] * table.num_rows
            if held and owners[0] == owner == owners[-1]:
                held.append(table)
                n_held += table.num_rows
                continue
            owners = [owner] * n_held + owners
            table = pa.concat_tables([*held, table])
            cut = len(owners) - 1
            while cut and owners[cut - 1] == owners[-1]:
                cut -= 1
            if cut:
                yield from assigned(table.slice(0, cut), owners[:cut])
            held, owner, n_held = [table.slice(cut)], owners[-1], len(owners) - cut
        if held:
            yield from assigned(pa.concat_tables(held), [owner] * n_held)

    dealt = (events.repartition(*deal) if deal else events.repartition(1)).sortWithinPartitions(*deal, F.desc("_t")).mapInArrow(assign, schema)
    if whole and deal != keys:  # groups hold rows of several keys: they are named by what dealt them
        return dealt.withColumn("_deal", F.array(*[F.col(k) for k in deal]) if deal else F.array().cast("array<string>"))
    return dealt


def _collected(grouped: DataFrame | _Closing, names: list[str], keys: list[str], extras: list[str]) -> DataFrame:
    events, closed = (grouped.events, grouped.closed) if isinstance(grouped, _Closing) else (grouped, F.max("_closed"))
    by = ["_deal", "_g"] if "_deal" in events.columns else [*keys, "_g"]
    inside = ~F.col("_only")
    messages = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(inside & F.col("_m").isNotNull(), F.struct(F.when(F.col("_plain"), -F.col("_seq")).otherwise(F.col("_seq")).alias("o"), F.col("_m").alias("m"))))), lambda x: x["m"]))
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(inside & ~F.col("_plain"), F.col(f"_x{i}")))))).alias(f"_x{i}") for i in range(len(extras))]
    firsts = [F.min(k).alias(f"_v{i}") for i, k in enumerate(keys)]
    out = events.groupBy(*by).agg(F.min("_t").alias("_from"), F.max(F.when(inside, F.col("_t"))).alias("_to"), messages.alias("_message"), F.sum(inside.cast("bigint")).alias("_event_count"), closed.alias("_is_closed"), *lists, *firsts)
    rest = {n: F.col(f"_v{i}").alias(n) for i, n in enumerate(names)} | {n: F.when(F.size(f"_x{i}") > 0, F.col(f"_x{i}")).alias(n) for i, n in enumerate(extras)}
    return out.filter("_event_count > 0").select(F.timestamp_micros("_from").alias("_time"), "_message", ((F.col("_to") - F.col("_from")) / 1e6).alias("_duration"), "_event_count", "_is_closed", *[rest[n] for n in sorted(rest, key=lambda n: n.encode())])
