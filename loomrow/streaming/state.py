"""Streaming forms: micro-batches of requests, marks and responses with state, and tables kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomrow.operators.fold import apply_changes


def low_water_marks(commits: DataFrame, dispatchers: int = 1) -> DataFrame:
    """dispatcher, mark: each dispatcher's mark after a micro-batch of commits (tx); commits may come in any order.

    The state holds the mark and the commits above it; what is below is forgotten.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, ahead = state.get if state.exists else (key[0] - dispatchers, [])
        waiting = set(ahead)
        for frame in frames:
            waiting.update(int(t) for t in frame["tx"] if t > mark)
        while mark + dispatchers in waiting:
            mark += dispatchers
            waiting.remove(mark)
        state.update((mark, sorted(waiting)))
        yield pd.DataFrame({"dispatcher": [key[0]], "mark": [mark]})

    keyed = commits.selectExpr("tx", f"cast(tx % {dispatchers} as int) as dispatcher")
    return keyed.groupBy("dispatcher").applyInPandasWithState(step, "dispatcher int, mark long", "mark long, ahead array<long>", "update", GroupStateTimeout.NoTimeout)


def accepted_responses(responses: DataFrame) -> DataFrame:
    """Of each connection the responses with a number above the last accepted one; columns client_id, rte_id, tx, committed, node.

    The state is one number a connection.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        got = pd.concat(list(frames)).sort_values(["tx", "node"]).drop_duplicates("tx")
        got = got[got["tx"] > last]
        if len(got):
            state.update((int(got["tx"].max()),))
        yield got[["client_id", "rte_id", "tx", "committed", "node"]]

    schema = "client_id int, rte_id long, tx long, committed boolean, node int"
    return responses.groupBy("client_id", "rte_id").applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)


class StateTable:
    """A table that micro-batches of changes keep up to date: one version a batch, found again by its number.

    A batch that is run again writes the same version from the one before, so a
    restart neither loses nor repeats changes.
    """

    def __init__(self, base: DataFrame, path: str, on: Sequence[str]):
        self.spark, self.path, self.on = base.sparkSession, path.rstrip("/"), list(on)
        self.base = base

    def _version(self, number: int) -> str:
        return f"{self.path}/version={number}"

    def read(self, number: int | None = None) -> DataFrame:
        """The table after a batch, the base before the first; without a number, after the last one."""
        if number is None:
            number = self.last()
        return self.base if number < 0 else self.spark.read.parquet(self._version(number))

    def last(self) -> int:
        """The number of the last version, -1 for none."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return -1
        done = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return max((int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(top) if "=" in s.getPath().getName() and done(s.getPath())), default=-1)

    def apply(self, changes: DataFrame, number: int) -> None:
        """Folds a batch's changes (keys, tx, op, fields) into the next version."""
        before = self.read(number - 1) if number else self.base
        fields = [c for c in self.base.columns if c not in self.on]
        after = apply_changes(before.select(*self.base.columns), changes.select(*self.on, "tx", "op", *fields), self.on)
        after.select(*self.base.columns).write.mode("overwrite").parquet(self._version(number))

    def follow(self, requests: DataFrame, changes: Callable[[DataFrame], DataFrame], checkpoints: str, trigger: dict | None = None):
        """Starts a stream that folds changes(requests) of each micro-batch; requests come in the order of the log."""
        return requests.writeStream.foreachBatch(lambda batch, i: self.apply(changes(batch), i)).option("checkpointLocation", checkpoints).trigger(**(trigger or {"availableNow": True})).start()
