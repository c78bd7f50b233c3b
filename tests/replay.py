"""Transactions one event at a time, newest first: what the plans must agree with."""

from __future__ import annotations

from collections import deque

from tidemark.operators.transaction import Params


class _Replay:
    """Deals one key's events, newest first, to groups. What comes out are numbers only: the group of
    each event, which groups are closed, and which events lend a full group no more than their time."""

    def __init__(self, params: Params):
        self.p = params
        self.group_of: list[int] = []
        self.time_only: list[bool] = []
        self.count: list[int] = []
        self.start: list[bool] = []
        self.end: list[bool] = []
        self.newest: list[int] = []
        self.oldest: list[int] = []
        self.key_of: dict[int, tuple] = {}
        self.state: list[bool | None] = []  # None while the group is open for events
        self.queue: deque[tuple[int, int]] = deque()
        self.live: dict[tuple, int] = {}
        self.stack: dict[int, None] = {}  # in order of opening; any of them may leave
        self.waiting: list[int] = []  # events of the live group while only ends are told
        self.limit = params.max_events if params.max_events is not None else 1 << 62

    def new(self, time: int, start: bool = False, end: bool = False) -> int:
        for column, value in ((self.count, 0), (self.start, start), (self.end, end), (self.newest, time), (self.oldest, time), (self.state, None)):
            column.append(value)
        self.queue.append((len(self.count) - 1, time))
        return len(self.count) - 1

    def put(self, group: int, i: int, time: int) -> None:
        """Event i joins the group; a full one takes its time only."""
        self.group_of[i] = group
        self.time_only[i] = self.full(group)
        self.count[group] += not self.time_only[i]
        self.oldest[group] = min(self.oldest[group], time)

    def wait(self, group: int, key: tuple = ()) -> int:
        """The group is the live one of the key."""
        self.live[key], self.key_of[group] = group, key
        return group

    def top(self) -> int:
        return next(reversed(self.stack))

    def full(self, group: int) -> bool:
        return self.count[group] >= self.limit

    def freeze(self, group: int, closed: bool | None = None) -> None:
        self.state[group] = self.p.closed(self.start[group], self.end[group]) if closed is None else closed
        self.stack.pop(group, None)
        if self.live.get(key := self.key_of.pop(group, None)) == group:
            del self.live[key]

    def expire(self, time: int) -> None:
        while self.p.span is not None and self.queue and time < self.queue[0][1] - self.p.span:
            group, _ = self.queue.popleft()
            if self.state[group] is None:
                self.freeze(group)

    def run(self, times, starts, ends, keys, last: int):
        n, self.times = len(times), times
        self.group_of, self.time_only = [-1] * n, [False] * n
        step = self.grouped if not (self.p.starts or self.p.ends) else self.bracketed if self.p.starts and self.p.ends else self.opened if self.p.starts else self.ended
        for i in range(n):
            self.expire(int(times[i]))
            step(i, int(times[i]), bool(starts[i]), bool(ends[i]), keys[i])
        self.expire(last)
        return self.drain()

    def bracketed(self, i: int, time: int, start: bool, end: bool, key: tuple) -> None:
        live = self.live.get(())
        if end:
            group = self.new(time, start, True)
            self.put(group, i, time)
            if start:
                self.freeze(group, True)
            else:
                self.stack[group] = None
            return
        if start:
            if self.stack and self.full(self.top()):
                self.freeze(self.top())
            if self.stack:
                group = self.top()
                self.put(group, i, time)
                self.start[group] = True
                self.freeze(group, True)
            elif live is not None and not self.start[live]:
                self.put(live, i, time)
                self.start[live] = True
                self.queue.append((live, self.newest[live]))
            else:
                if live is not None:
                    self.freeze(live, False)
                self.put(self.wait(self.new(time, True)), i, time)
        elif self.stack:
            group = self.top()
            if not self.full(group):
                self.put(group, i, time)
            if self.full(group):
                self.freeze(group)
        else:
            if live is not None and self.start[live]:
                self.freeze(live, False)
                live = None
            if live is None:
                live = self.wait(self.new(time))
            self.put(live, i, time)
        self.cap(())

    def opened(self, i: int, time: int, start: bool, end: bool, key: tuple) -> None:
        live = self.live.get(())
        if live is None:
            live = self.wait(self.new(time))
        self.put(live, i, time)
        if start:
            if self.stack:
                self.freeze(self.top(), True)
            self.start[live] = True
            del self.live[()]
            self.stack[live] = None
        self.cap(())

    def ended(self, i: int, time: int, start: bool, end: bool, key: tuple) -> None:
        if end:
            group = self.new(time, False, True)
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

    def grouped(self, i: int, time: int, start: bool, end: bool, key: tuple) -> None:
        group = self.live.get(key)
        partial = None in key
        if group is None or partial:
            fits = [k for k in self.live if all(a is None or b is None or a == b for a, b in zip(k, key, strict=True))]
            if fits:
                rank = lambda k: (-sum(a is not None and a == b for a, b in zip(k, key, strict=True)), abs(time - self.oldest[self.live[k]]), tuple((a is not None, a or "") for a in k))
                best = min(fits, key=rank)
                if partial:
                    group = self.live[best]
                elif None in best:
                    group = self.wait(self.live.pop(best), key)
        if group is None:
            group = self.wait(self.new(time), key)
        self.put(group, i, time)
        if self.full(group):
            self.freeze(group)

    def cap(self, key: tuple) -> None:
        if (live := self.live.get(key)) is not None and self.full(live):
            self.freeze(live)

    def drain(self):
        """(group of each event, time only, closed by group, groups whose messages stay newest first)."""
        only_ends, cut = self.p.ends and not self.p.starts, set()
        for group, state in enumerate(self.state):
            if state is not None:
                continue
            if self.p.starts and self.p.ends:
                self.state[group] = False
            elif self.p.starts or only_ends:
                self.state[group] = (self.start if self.p.starts else self.end)[group]
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


def replay(params: Params, times, starts, ends, keys, last: int):
    """Groups of one key's events, sorted newest first; ``last``: the oldest time of any event."""
    return _Replay(params).run(times, starts, ends, keys, last)
