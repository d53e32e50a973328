"""The tables of a folder, and the request tables that the queries make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrow.operators.frames import parallelism

#: Partitions that the queries place keys on, and transactions in a batch.
NODES, BATCH = 4, 10
#: Lines whose accesses a task takes; some three times as many rows.
LINES_A_TASK = 60_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def accesses_parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts that accesses are dealt to: as many as the session shuffles to, more for a log of more lines, so that a task's share doesn't grow."""
    return max(parallelism(spark), -(-read(spark, sf_dir, "lineitem").count() // LINES_A_TASK))


def order_accesses(spark: SparkSession, sf_dir: str, replicated: bool = False) -> DataFrame:
    """tx, seq, tbl, k, op: one transaction an order, which reads and updates its customer, reads its lines' parts and suppliers and updates the first line's supplier.

    With replicated, it also reads the customer's nation, which lies on every node.
    """
    # rows are dealt by transaction before they multiply; what follows by transaction needs no other shuffle
    parts = accesses_parts(spark, sf_dir)
    orders = read(spark, sf_dir, "orders").repartition(parts, "o_orderkey")
    mine = F.array(F.struct(F.lit("R").alias("op")), F.struct(F.lit("U").alias("op")))
    customers = orders.select(F.col("o_orderkey").alias("tx"), F.lit(0).alias("seq"), F.lit("customer").alias("tbl"), F.col("o_custkey").alias("k"), F.inline(mine))
    row = lambda seq, tbl, k, op: F.struct(seq.cast("int").alias("seq"), F.lit(tbl).alias("tbl"), F.col(k).alias("k"), F.lit(op).alias("op"))
    line = F.col("l_linenumber")
    each = F.array(row(line, "part", "l_partkey", "R"), row(line + 100, "supplier", "l_suppkey", "R"), F.when(line == 1, row(F.lit(0), "supplier", "l_suppkey", "U")))
    lines = read(spark, sf_dir, "lineitem").repartition(parts, "l_orderkey").select(F.col("l_orderkey").alias("tx"), F.explode(each).alias("a")).where("a is not null")
    lines = lines.groupBy("tx", "a.tbl", "a.k", "a.op").agg(F.min("a.seq").alias("seq")).select("tx", "seq", "tbl", "k", "op")
    out = customers.unionByName(lines)
    if replicated:
        nations = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("tx"), F.lit(1).alias("seq"), F.lit("nation").alias("tbl"), F.col("c_nationkey").cast("long").alias("k"), F.lit("R").alias("op"))
        out = out.unionByName(nations.repartition(parts, "tx"))
    return out


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx of every order or line, once."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx")).unionByName(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx"))).distinct()


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx, client_id, conn_id, pid, k, value: a request for each event; 1 reads, 2 and 3 update, 4 inserts, 5 aborts."""
    kind = F.col("event_type")
    pid = F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(5)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("tx"), (F.col("user_id") % 8).cast("int").alias("client_id"), F.col("user_id").alias("conn_id"), pid.alias("pid"), F.col("user_id").alias("k"), "value")


def event_changes(log: DataFrame) -> DataFrame:
    """k, tx, op, value of the requests that write; every eleventh update deletes."""
    op = F.when(F.col("pid") == 4, "I").when(F.col("pid").isin(2, 3), F.when(F.col("tx") % 11 == 0, "D").otherwise("U"))
    return log.select("k", "tx", op.alias("op"), F.when(op != "D", F.col("value")).alias("value")).where("op is not null")


def event_votes(log: DataFrame, nodes: int = NODES) -> DataFrame:
    """tx, node, commit, message: every node's vote; a few abort."""
    each = log.select("tx", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node"))
    no = (F.col("tx") * 31 + F.col("node")) % 97 == 0
    return each.select("tx", "node", (~no).alias("commit"), F.when(no, F.concat(F.lit("abort at "), F.col("node").cast("string"))).alias("message"))


def event_commits(log: DataFrame) -> DataFrame:
    """n, tx: commits in the order in which they arrive, a little out of that of the log."""
    from loomrow.operators.frames import numbered

    late = log.select("tx", (F.col("tx") + (F.col("tx") * 7919) % 17).alias("at"))
    return numbered(late, "at", "n", ties=("tx",)).select("n", "tx")


def customer_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, k, src, dest, push_order: every tenth customer goes to the next partition."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").where(k % 10 == 0).select(F.lit("customer").alias("tbl"), k.alias("k"), (k % NODES).cast("int").alias("src"), ((k % NODES + 1) % NODES).cast("int").alias("dest"), k.alias("push_order"))


def order_period(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The transactions at a quarter and three quarters of the order keys: when the move starts and ends."""
    most = read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    return most // 4, most * 3 // 4
