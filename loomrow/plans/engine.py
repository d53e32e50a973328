"""Procedures, and an engine that runs a log of requests through them.

A procedure is two DataFrame functions: which keys its requests name, and what
they change given what they read. The engine numbers, places, routes and folds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrow.config import Config, Migration, Service
from loomrow.operators import analysis, conflicts, fold, graph, migration, placement, routing
from loomrow.sources.requests import without_no_ops


@dataclass(frozen=True)
class Procedure:
    """declare(requests) gives accesses (tx, seq, tbl, k, op); change(requests, values read) gives change rows (tbl, k, tx, op, value).

    aborts(requests) gives the transactions that roll back, by tx.
    """

    pid: int
    declare: Callable[[DataFrame], DataFrame]
    change: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    aborts: Callable[[DataFrame], DataFrame] | None = None

    @property
    def read_only(self) -> bool:
        return self.change is None


@dataclass(frozen=True)
class Results:
    accesses: DataFrame
    batches: DataFrame
    routes: DataFrame
    roles: DataFrame
    levels: DataFrame
    outcomes: DataFrame
    table: DataFrame


@dataclass
class Engine:
    """Runs logs over one keyed table of values (tbl, k, value)."""

    spark: SparkSession
    config: Config = field(default_factory=Config)
    plan: object = None
    procedures: dict[int, Procedure] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.plan = self.plan or placement.NotificationPlan(placement.ModuloPlan(self.config.partitions))

    def register(self, procedure: Procedure) -> Engine:
        if procedure.pid in self.procedures:
            raise ValueError(f"procedure {procedure.pid} is registered already")
        self.procedures[procedure.pid] = procedure
        return self

    def with_config(self, **changes: object) -> Engine:
        return replace(self, config=replace(self.config, **changes))

    def _each(self, log: DataFrame, f: Callable[[Procedure, DataFrame], DataFrame | None], empty: str) -> DataFrame:
        out = self.spark.createDataFrame([], empty)
        for pid, procedure in sorted(self.procedures.items()):
            made = f(procedure, log.where(F.col("pid") == pid))
            out = out if made is None else out.unionByName(made.select(*out.columns))
        return out

    def accesses(self, log: DataFrame) -> DataFrame:
        """Placed accesses of all requests; one of a procedure that isn't registered is an error."""
        unknown = without_no_ops(log).where(~F.col("pid").isin(*self.procedures)).select("pid").first()
        if unknown:
            raise ValueError(f"no procedure {unknown.pid}")
        return self.plan.place(self._each(log, lambda p, rows: p.declare(rows), "tx long, seq int, tbl string, k long, op string"))

    def batches(self, placed: DataFrame) -> DataFrame:
        return graph.batches(placed, self.config.batch_size if self.config.batched else 1)

    def routes(self, placed: DataFrame, batched: DataFrame) -> DataFrame:
        """tx, node by the configured service; on the replicated one, node 0 answers."""
        c, n = self.config, self.config.partitions
        if c.service == Service.REPLICATED:
            return analysis.transactions(placed).select("tx", F.lit(0).alias("node"))
        if c.service == Service.READ_WRITE_SETS:
            return analysis.most_reads_node(placed).select("tx", "node")
        if c.service == Service.LOCAL_FIRST:
            return routing.local_first(placed, n).select("tx", "node")
        keys = graph.keyed(placed, batched)
        if c.service == Service.COST_ROUTED:
            return routing.cost_routes(keys, n, c.routing_beta).select("tx", "node")
        rule = "balanced" if c.service == Service.FUSED_REBALANCED else "local_first"
        return routing.fused_routes(keys, n, rule=rule, size=c.fusion_size, tolerance=c.imbalance_tolerance).where("k is null").select("tx", "node")

    def migrate(self, placed: DataFrame, ranges: DataFrame, start: int, end: int, caught_up_at: int | None = None) -> tuple[DataFrame, object]:
        """What every node does (tx, node, kind, tbl, k) while ranges move by the configured way, and the plan that holds then.

        The move begins with transaction start and has ended at transaction end.
        A crabbing one changes its phase at caught_up_at (None, or a setting of
        caught_up that says no: never). A stopped copy has ended where it
        begins: the plan changes at start, whatever end is.
        """
        c, after = self.config, placement.OverridePlan(self.plan, ranges)
        if c.migration == Migration.STOP_AND_COPY:
            return migration.analyse(migration.stopped_copy(placed, ranges, start), c.partitions, "stop_and_copy"), placement.VersionedPlan(((0, self.plan), (start, after)))
        seen, later = migration.over_time(placed, ranges, start, end), placement.VersionedPlan(((0, self.plan), (end, after)))
        how = {Migration.SOURCE_ONLY: "source_only", Migration.ON_DEMAND: "on_demand", Migration.CRABBING: "crabbing"}[c.migration]
        if c.migration != Migration.CRABBING or not c.caught_up or caught_up_at is None:
            return migration.analyse(seen, c.partitions, how), later
        first = migration.analyse(seen.where(F.col("tx") < caught_up_at), c.partitions, how)
        return first.unionByName(migration.analyse(seen.where(F.col("tx") >= caught_up_at), c.partitions, "caught_up")), later

    def run(self, log: DataFrame, values: DataFrame) -> Results:
        """The results of a log over a table of values; transactions that abort change nothing."""
        placed = self.accesses(log)
        batched = self.batches(placed)
        aborted = self._each(log, lambda p, rows: p.aborts and p.aborts(rows), "tx long").distinct()
        outcomes = without_no_ops(log).select("tx").distinct().join(aborted.withColumn("a", F.lit(True)), "tx", "left").select("tx", F.col("a").isNull().alias("committed"))
        changes = self._each(log, lambda p, rows: None if p.read_only else p.change(rows, values), "tbl string, k long, tx long, op string, value double")
        written = fold.declared_only(fold.committed(changes, outcomes), placed, ["tbl", "k"])
        table = fold.apply_changes(values.select("tbl", "k", "value"), written, ["tbl", "k"])
        return Results(placed, batched, self.routes(placed, batched), analysis.participant_roles(placed, self.config.partitions), conflicts.levels(conflicts.requests(placed), batched), outcomes, table)
