"""Calls of a scorer within a task (U6): side by side, bounded in time, none left behind.

A call that never returns cannot be ended inside its process. So calls with a time
limit, or side by side, run in a child process of the task, each in a thread. A child
that holds ``MOST_LATE`` late calls gets no more of them, is ended when the others have
replied, and the next child takes over; the last one ends with the task. So threads and
the prompts they hold are bounded however many calls are late.
"""

from __future__ import annotations

import heapq
import itertools
import multiprocessing
import os
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.connection import Connection, wait

import pandas as pd

#: So many late calls a child process holds before another takes over.
MOST_LATE = 256

#: Batches of a task under way: calls of the second start while the first waits for its last replies.
MOST_BATCHES = 2

#: Replies of the call or None, its error, and whether the scorer itself failed (which may be tried again).
Outcome = tuple[list | None, str | None, bool]


@dataclass
class _Batch:
    prompts: pd.Series
    replies: list
    errors: list
    left: int  # rows without an outcome


@dataclass
class _Call:
    batch: _Batch
    at: int
    n: int
    whole: bool  # one call of n prompts, or n calls of one prompt, one after the other
    tries: int = 0

    def prompts(self) -> list[pd.Series] | list[str]:
        part = self.batch.prompts.iloc[self.at : self.at + self.n]
        return [part.reset_index(drop=True)] if self.whole else part.tolist()


def _outcome(scorer: Callable[[pd.Series], pd.Series], prompts: pd.Series | str) -> Outcome:
    ran = False
    try:
        whole = isinstance(prompts, pd.Series)
        out = scorer(prompts if whole else pd.Series([prompts]))
        ran = True
        if whole:
            out = pd.Series(out, index=prompts.index).astype(object)
            return out.where(out.notna(), None).tolist(), None, False
        reply = pd.Series(out).iloc[0]
        return [None if pd.isna(reply) else reply], None, False
    except Exception as e:  # noqa: BLE001 - failures stay per row
        return None, f"{type(e).__name__}: {e}"[:500], not ran


def _serve(scorer: Callable[[pd.Series], pd.Series], limit: float | None, pipe: Connection, parents_end: Connection) -> None:
    """The child: runs what it is sent in threads and tells the outcomes, up to the first late one. Ends with its parent."""
    parents_end.close()
    under_way: dict[int, tuple[float, list[Outcome]]] = {}  # when the call began, outcomes before it
    taking, sending = threading.Lock(), threading.Lock()

    def tell(key: int, outcomes: list[Outcome] | None, late: int) -> None:
        with sending:
            try:
                pipe.send((key, outcomes, late))
            except OSError:  # the parent is gone
                os._exit(1)
            except Exception as e:  # noqa: BLE001 - a reply that cannot be sent
                pipe.send((key, [(None, f"{type(e).__name__}: {e}"[:500], False)] * len(outcomes), late))

    def run(key: int, calls: list) -> None:
        outcomes: list[Outcome] = []
        for prompts in calls:
            under_way[key] = time.monotonic(), outcomes
            outcome = _outcome(scorer, prompts)
            with taking:
                late = under_way.pop(key, None) is None
            if late:
                tell(key, None, -1)  # it was told as late, and has ended after all
                return
            outcomes.append(outcome)
        tell(key, outcomes, 0)

    def watch(limit: float) -> None:
        while True:
            now = time.monotonic()
            with taking:
                late = [(key, under_way.pop(key)[1]) for key, (began, _) in list(under_way.items()) if began + limit <= now]
                ends = min([now, *(began for began, _ in list(under_way.values()))]) + limit
            for key, outcomes in late:
                tell(key, [*outcomes, (None, f"TimeoutError: no reply within {limit:g} s", True)], 1)
            time.sleep(max(0.0, ends - time.monotonic()))  # a call that begins meanwhile ends later

    if limit is not None:
        threading.Thread(target=watch, args=(limit,), daemon=True).start()
    tell(-1, None, 0)  # ready
    while True:  # never waits for the parent to read, which may be sending
        try:
            key, calls = pipe.recv()
        except (EOFError, OSError):
            os._exit(0)
        threading.Thread(target=run, args=(key, calls), daemon=True).start()


class _Child:
    def __init__(self, scorer: Callable[[pd.Series], pd.Series], limit: float | None) -> None:
        fork = multiprocessing.get_context("fork")  # the scorer need not be pickled again
        self.pipe, theirs = fork.Pipe()
        self.process = fork.Process(target=_serve, args=(scorer, limit, theirs, self.pipe), daemon=True)
        self.process.start()
        theirs.close()
        self.under_way: dict[int, _Call] = {}
        self.late = 0
        self.recv()

    def recv(self) -> tuple:
        try:
            return self.pipe.recv()
        except (EOFError, OSError):
            raise RuntimeError("the scorer's process has ended") from None

    def end(self) -> None:
        self.process.kill()
        self.process.join()
        self.pipe.close()


def score_batches(batches: Iterator[pd.Series], scorer: Callable[[pd.Series], pd.Series], call_rows: int, patience) -> Iterator[tuple[list, list]]:
    """Replies and errors of each batch of prompts, in order. ``patience``: a ``scoring.Patience``.

    The rows of a failed call are tried one by one and leave its place to the next
    call. They come first, or have ``rows_at_once`` places of their own.
    """
    shared = patience.rows_at_once is None
    inline = shared and patience.limit is None and patience.at_once == 1
    stopped = f"Stopped: {patience.give_up} rows without a reply"
    opened: deque[_Batch] = deque()
    wholes: deque[_Call] = deque()
    rows: deque[_Call] = deque()
    pausing: list[tuple[float, int, _Call]] = []  # rows before their next try
    busy = {True: 0, False: 0}  # whole calls and runs of rows under way
    children: list[_Child] = []
    keys = itertools.count()
    silent = 0  # rows in a row without a reply

    def free(whole: bool) -> bool:
        if shared:
            return sum(busy.values()) + len(pausing) < patience.at_once and not (whole and rows)
        return busy[whole] < (patience.at_once if whole else patience.rows_at_once)

    def settle(call: _Call, replies: list, errors: list) -> None:
        call.batch.replies[call.at : call.at + call.n] = replies
        call.batch.errors[call.at : call.at + call.n] = errors
        call.batch.left -= call.n

    def part(call: _Call, at: int, n: int, tries: int = 0) -> _Call:
        return _Call(call.batch, at, n, False, tries)

    def done(call: _Call, outcomes: list[Outcome]) -> None:
        nonlocal silent
        busy[call.whole] -= 1
        if call.whole:
            replies, error, _ = outcomes[0]
            if error is None:
                silent = 0
                settle(call, replies, [None] * call.n)
            else:  # one try for the whole call: its rows have their own
                step = 1 if shared else call.n
                rows.extend(part(call, at, step) for at in range(call.at, call.at + call.n, step))
            return
        for at, (replies, error, again) in enumerate(outcomes, call.at):
            if error is None:
                silent = 0
                settle(part(call, at, 1), replies, [None])
            elif again and call.tries < patience.retries:
                next_try = time.monotonic() + patience.pause * 2**call.tries
                heapq.heappush(pausing, (next_try, next(keys), part(call, at, 1, call.tries + 1)))
            else:
                silent += 1
                settle(part(call, at, 1), [None], [error])
        # the rows after a late one: in halves, so that many late ones do not wait for each other
        at, end = call.at + len(outcomes), call.at + call.n
        middle = (at + end + 1) // 2
        rows.extendleft(part(call, a, b - a) for a, b in ((middle, end), (at, middle)) if a < b)

    def start(call: _Call) -> None:
        if patience.give_up is not None and silent >= patience.give_up and not call.tries:
            busy[call.whole] -= 1
            settle(call, [None] * call.n, [stopped] * call.n)
        elif inline:
            done(call, [_outcome(scorer, p) for p in call.prompts()])
        else:
            if not children or children[-1].late >= MOST_LATE:
                children.append(_Child(scorer, patience.limit))
            key = next(keys)
            children[-1].under_way[key] = call
            children[-1].pipe.send((key, call.prompts()))

    batches = iter(batches)
    more = True
    try:
        while True:
            while opened and not opened[0].left:
                batch = opened.popleft()
                yield batch.replies, batch.errors
            if more and not wholes and len(opened) < MOST_BATCHES:
                prompts = next(batches, None)
                if prompts is None:
                    more = False
                else:
                    n = len(prompts)
                    opened.append(_Batch(prompts, [None] * n, [None] * n, n))
                    wholes.extend(_Call(opened[-1], at, min(call_rows, n - at), True) for at in range(0, n, call_rows))
                continue
            if not opened:
                return
            while pausing and pausing[0][0] <= time.monotonic():
                rows.appendleft(heapq.heappop(pausing)[-1])
            for ready, whole in ((rows, False), (wholes, True)):
                while ready and free(whole):
                    busy[whole] += 1
                    start(ready.popleft())
            rest = max(0.0, pausing[0][0] - time.monotonic()) if pausing else None
            if any(c.under_way for c in children):
                for pipe in wait([c.pipe for c in children], rest):
                    child = next(c for c in children if c.pipe is pipe)
                    while pipe.poll():
                        key, outcomes, late = child.recv()
                        child.late += late
                        if outcomes is not None:
                            done(child.under_way.pop(key), outcomes)
            elif rest:
                time.sleep(rest)
            for child in [c for c in children if c.late >= MOST_LATE and not c.under_way]:
                children.remove(child)
                child.end()
    finally:
        for child in children:
            child.end()
