"""Keyed state in streams: entries that are inserted or updated by their URL, and a queue of claimed work with leases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPSERTS = "url string, at long, content string, change string, version int"
ASSIGNED = "shard long, item long, what string, worker long, tries int, at long, until long"


def _stateful(rows: DataFrame) -> DataFrame:
    """State of any shape is kept by RocksDB, which the session has to name before the stream starts."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows


class _Upserts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "at bigint, content string, version int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.entry.get() if self.entry.exists() else None
        frames = [f for f in rows if len(f)]
        found = pd.concat(frames).sort_values(["at", "content"], kind="stable") if frames else []
        out = []
        for at, content in zip(found["at"].tolist(), found["content"].tolist(), strict=True) if len(found) else ():
            if last is None:
                change, last = "insert", (at, content, 1)
            elif at < last[0]:
                change = "late"
            elif content != last[1]:
                change, last = "update", (at, content, last[2] + 1)
            else:
                change, last = "same", (at, content, last[2])
            out.append((key[0], at, content, change, last[2]))
        if last is not None:
            self.entry.update(tuple(last))
        yield pd.DataFrame(out, columns=["url", "at", "content", "change", "version"])

    def close(self) -> None:
        pass


def url_upserts(entries: DataFrame) -> DataFrame:
    """(url, at, content, change, version) of the stream entries(url, at, content): what each entry does to the row of its URL.

    change is insert for the first entry of a URL, update for other content, same for equal content, and late for an
    entry older than the newest one seen, which changes nothing; version counts inserts and updates. Within a batch
    entries are taken by time, then content. Rows without a URL, a time or content are left out. State is one row a URL.
    """
    rows = _stateful(entries).where("url is not null and at is not null and content is not null").selectExpr("cast(url as string) url", "cast(at as long) at", "cast(content as string) content")
    return rows.groupBy("url").transformWithStateInPandas(_Upserts(), UPSERTS, "append", "none")


class _Queue(StatefulProcessor):
    """Items wait by priority and due time; a claim leases the best of them; an expired lease waits again until its tries are used up."""

    def __init__(self, lease: int, tries: int) -> None:
        self.lease, self.tries = lease, tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        # worker and until are -1 for an item that waits
        self.items = handle.getMapState("items", "item bigint", "priority bigint, due bigint, tries int, worker bigint, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shard, held, gone, out = key[0], {k[0]: list(v) for k, v in self.items.iterator()}, set(), []
        frames = [f for f in rows if len(f)]
        found = pd.concat(frames).sort_values(["at", "seq"]) if frames else pd.DataFrame(columns=["at", "seq", "action", "item", "priority", "due", "worker"])
        for at, action, item, priority, due, worker in zip(*(found[c].tolist() for c in ("at", "action", "item", "priority", "due", "worker")), strict=True):
            for k in sorted(k for k, x in held.items() if x[3] >= 0 and x[4] <= at):  # leases that have run out by now
                x = held[k]
                out.append((shard, k, "expired" if x[2] < self.tries else "dead", x[3], x[2], at, x[4]))
                x[3] = x[4] = -1
                if x[2] >= self.tries:
                    held.pop(k)
                    gone.add(k)
            if action == "add" and item not in held:
                held[item] = [priority, due, 0, -1, -1]
                gone.discard(item)
            elif action == "claim":
                ready = [(x[0], x[1], k) for k, x in held.items() if x[3] < 0 and x[1] <= at]
                if ready:
                    k = min(ready)[2]
                    x = held[k]
                    x[2], x[3], x[4] = x[2] + 1, worker, at + self.lease
                    out.append((shard, k, "leased", worker, x[2], at, x[4]))
            elif action == "done" and item in held and held[item][3] == worker:
                x = held.pop(item)
                gone.add(item)
                out.append((shard, item, "done", worker, x[2], at, x[4]))
        for k in gone:
            self.items.removeKey((k,))
        for k, x in held.items():
            self.items.updateValue((k,), tuple(x))
        yield pd.DataFrame(out, columns=["shard", "item", "what", "worker", "tries", "at", "until"])

    def close(self) -> None:
        pass


def work_queue(commands: DataFrame, lease: int, tries: int = 3) -> DataFrame:
    """(shard, item, what, worker, tries, at, until) of the stream commands(shard, seq, at, action, item, priority, due, worker).

    add puts an item in line unless it is there; claim leases to a worker the item of the smallest priority, then due
    time, then number, of those that are due and not leased; done ends a lease that its worker still holds. A lease that
    has run out when a later command comes is reported as expired and the item waits again, or as dead after so many
    tries. Commands are taken by time and seq. A shard's items that wait or are leased are its state: give queues so
    many shards that those fit a task.
    """
    names = ("shard", "seq", "at", "item", "priority", "due", "worker")
    rows = _stateful(commands).selectExpr(*(f"cast({c} as long) {c}" for c in names), "cast(action as string) action").where("shard is not null and at is not null and action is not null").fillna(-1)
    return rows.groupBy("shard").transformWithStateInPandas(_Queue(lease, tries), ASSIGNED, "append", "none")
