"""Queries over the request tables, and DuckDB SQL that gives the same rows.

Every query runs over whole tables. Transactions are orders (sources.tables.
order_accesses), requests are events, moves are every tenth customer's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrow.functions.keys import Key, key_text, record_text, sink_id, truncate
from loomrow.operators import analysis, conflicts, crud, fold, graph, migration, placement, repartition, routing, watermarks
from loomrow.config import Config
from loomrow.operators.frames import checkpoint, scratch
from loomrow.plans.engine import Engine
from loomrow.sources import requests, tables
from loomrow.sources.tables import BATCH, NODES, read

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Accesses of orders, their placement, and what follows from both.
_ACC = """acc as (
    select o_orderkey as tx, 0 as seq, 'customer' as tbl, o_custkey as k, 'R' as op from orders
    union all select o_orderkey, 0, 'customer', o_custkey, 'U' from orders
    union all select l_orderkey, min(l_linenumber), 'part', l_partkey, 'R' from lineitem group by l_orderkey, l_partkey
    union all select l_orderkey, min(l_linenumber) + 100, 'supplier', l_suppkey, 'R' from lineitem group by l_orderkey, l_suppkey
    union all select distinct l_orderkey, 0, 'supplier', l_suppkey, 'U' from lineitem where l_linenumber = 1
), placed as (select *, (k % 4)::integer as part, false as replicated from acc)"""
_ACC_REPLICATED = _ACC.replace("), placed as (select *, (k % 4)::integer as part, false as replicated from acc)", "    union all select o_orderkey, 1, 'nation', c_nationkey, 'R' from orders join customer on o_custkey = c_custkey\n), placed as (select *, (k % 4)::integer as part, tbl = 'nation' as replicated from acc)")
_NODES = "nodes as (select unnest([0, 1, 2, 3])::integer as node)"
_MOST = """counts as (
    select tx, part, count(*) as n, max(struct_pack(s := seq, t := tbl, k := k)) as reached from placed where op = 'R' and not replicated group by tx, part
), most as (
    select t.tx, coalesce(c.part, 0)::integer as node, coalesce(c.n, 0)::bigint as n_local, (coalesce(a.total, 0) - coalesce(c.n, 0))::bigint as n_remote
    from (select distinct tx from placed) t
    left join (select * from counts qualify row_number() over (partition by tx order by n desc, reached) = 1) c using (tx)
    left join (select tx, sum(n) as total from counts group by tx) a using (tx)
)"""
_ACTIVE = f"""{_MOST}, active as (
    select distinct tx, part as node from placed where op <> 'R' and not replicated
    union all select tx, node from most where tx not in (select tx from placed where op <> 'R' and not replicated)
)"""
_KEYED = """batches as (
    select tx, floor((row_number() over (order by tx) - 1) / 10)::bigint as batch from (select distinct tx from placed)
), keyed as (
    select batch, tx, tbl, k, bool_or(op = 'R') as rd, bool_or(op <> 'R') as wr, any_value(part) as part, bool_or(replicated) as replicated
    from placed join batches using (tx) group by batch, tx, tbl, k
), edges as (
    select batch, case when replicated then null else coalesce(writer, -(part + 1)) end as src, tx as dst, tbl, k, part, replicated
    from (select *, last_value(case when wr then tx end ignore nulls) over (partition by batch, tbl, k order by tx rows between unbounded preceding and 1 preceding) as writer from keyed) where rd
), backs as (select batch, max(tx) as src, tbl, k, any_value(part) as part from keyed where wr group by batch, tbl, k)"""
_ROUTES = """own as (
    select tx, node, count(distinct tbl || ':' || k) filter (part = node) as c, count(distinct tbl || ':' || k) filter (part is not null) as total
    from (select t.tx, n.node, p.part, p.tbl, p.k from (select distinct tx from placed) t cross join nodes n left join (select * from placed where op = 'R' and not replicated) p on p.tx = t.tx) group by tx, node
), tied as (
    select tx, list(node order by node) as ties, any_value(total - c) as n_remote from (select *, max(c) over (partition by tx) as best from own) where c = best group by tx
), routes as (select tx, ties[tx % len(ties) + 1] as node, n_remote::bigint as n_remote from tied)"""
_SOURCES = """placed_edges as (
    select e.batch, coalesce(e.src, -(r.node + 1)) as src, e.dst, e.tbl, e.k, e.part, r.node, coalesce(s.node, -coalesce(e.src, -(r.node + 1)) - 1)::integer as src_node
    from edges e join routes r on r.tx = e.dst left join routes s on s.tx = e.src
)"""
_EVENTS = """log as (
    select event_id as tx, (user_id % 8)::integer as client_id, user_id as conn_id,
        case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end::integer as pid, user_id as k, value from events
)"""
_VOTES = f"""{_EVENTS}, votes as (select tx, node, (tx * 31 + node) % 97 <> 0 as yes, case when (tx * 31 + node) % 97 = 0 then 'abort at ' || node end as message from log cross join (select unnest([0, 1, 2, 3])::integer as node))"""
_MOVES = """moves as (
    select 'customer' as tbl, c_custkey as k, (c_custkey % 4)::integer as src, ((c_custkey % 4 + 1) % 4)::integer as dest, c_custkey as push_order from customer where c_custkey % 10 = 0
), period as (select max(o_orderkey) // 4 as a, max(o_orderkey) * 3 // 4 as z from orders)"""
_STATUS = f"""{_MOVES}, migrated as (
    select tbl, k, min(tx) as migrated_tx from placed semi join moves using (tbl, k) where op in ('R', 'U') and tx >= (select a from period) and tx < (select z from period) group by tbl, k
), seen as (
    select p.*, m.src, m.dest, coalesce(g.migrated_tx < p.tx, false) as is_migrated from placed p left join moves m using (tbl, k) left join migrated g using (tbl, k)
)"""
_HEAT = """occurrences as (
    select tx, tbl || ':' || k as v, any_value(part) as part, count(distinct op <> 'R')::bigint as n from placed where not replicated group by tx, tbl || ':' || k
), vertices as (select v, any_value(part) as part, sum(n)::bigint as weight from occurrences group by v),
heat_edges as (
    select a.v as src, b.v as dst, sum(a.n * b.n)::bigint as weight from occurrences a join occurrences b on a.tx = b.tx and a.v <> b.v group by a.v, b.v
), loads as (
    select node as part, coalesce(l, 0)::double as local_load, coalesce(c, 0)::double as cross_load, (coalesce(l, 0) + coalesce(c, 0))::double as total_load from nodes
    left join (select part, sum(weight) as l from vertices group by part) a on a.part = node
    left join (select s.part, sum(e.weight) as c from heat_edges e join vertices s on s.v = src join vertices d on d.v = dst where s.part <> d.part group by s.part) b on b.part = node
)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _placed(spark: SparkSession, sf_dir: str, replicated: bool = False) -> DataFrame:
    plan = placement.NotificationPlan(placement.ModuloPlan(NODES, ("nation",) if replicated else ()))
    return plan.place(tables.order_accesses(spark, sf_dir, replicated))


def _keyed(spark: SparkSession, sf_dir: str, replicated: bool = False) -> DataFrame:
    """Keys in batches."""
    return graph.keyed(_placed(spark, sf_dir, replicated), graph.batches(tables.order_transactions(spark, sf_dir), BATCH))


def _routed(spark: SparkSession, sf_dir: str, replicated: bool = False) -> DataFrame:
    """Keys in batches with the routes of the local-first rule, dealt by batch."""
    return routing.routed_locally(_keyed(spark, sf_dir, replicated), NODES).repartition(tables.accesses_parts(spark, sf_dir), "batch")


# --- placement and read/write sets


@query(f"with {_ACC}, {_MOST} select tx, node, n_local, n_remote from most")
def most_reads_node(spark, sf_dir):
    """The node that owns most of what each transaction reads."""
    return analysis.most_reads_node(_placed(spark, sf_dir))


@query(f"with {_ACC} select tx, seq, tbl, k, op, part from placed")
def place_mod(spark, sf_dir):
    """Every access with its partition."""
    return _placed(spark, sf_dir).select("tx", "seq", "tbl", "k", "op", "part")


@query(f"with {_ACC}, {_MOVES} select tx, seq, tbl, k, op, coalesce(dest, part)::integer as part from placed left join (select tbl, k, dest from moves) using (tbl, k)")
def place_override(spark, sf_dir):
    """Every access under explicit places for some keys."""
    plan = placement.OverridePlan(placement.ModuloPlan(NODES), tables.customer_moves(spark, sf_dir))
    return plan.place(tables.order_accesses(spark, sf_dir)).select("tx", "seq", "tbl", "k", "op", "part")


@query(f"with {_ACC}, {_MOVES} select tx, seq, tbl, k, op, case when tx >= (select a from period) then coalesce(dest, part) else part end::integer as part from placed left join (select tbl, k, dest from moves) using (tbl, k)")
def place_versions(spark, sf_dir):
    """Every access under the plan that holds at its place in the log."""
    start, _ = tables.order_period(spark, sf_dir)
    base = placement.ModuloPlan(NODES)
    plan = placement.VersionedPlan(((0, base), (start, placement.OverridePlan(base, tables.customer_moves(spark, sf_dir)))))
    return plan.place(tables.order_accesses(spark, sf_dir)).select("tx", "seq", "tbl", "k", "op", "part")


@query(f"with {_ACC_REPLICATED}, {_NODES}, used as (select part, tbl, k, count(*) as c from placed where not replicated group by part, tbl, k) select node as part, count(c)::bigint as keys, coalesce(sum(c), 0)::bigint as accesses from nodes left join used on part = node group by node")
def partition_load(spark, sf_dir):
    """Keys and accesses of every partition."""
    return placement.partition_load(_placed(spark, sf_dir, True), NODES)


@query(f"""with {_ACC_REPLICATED}, {_NODES}, {_ACTIVE}
select t.tx, node, case when (t.tx, node) in (select tx, node from active) then 'ACTIVE' when (t.tx, node) in (select tx, part from placed where op = 'R' and not replicated) then 'PASSIVE' else 'IGNORE' end as role
from (select distinct tx from placed) t cross join nodes""")
def participant_roles(spark, sf_dir):
    """Which nodes run, feed or ignore each transaction."""
    return analysis.participant_roles(_placed(spark, sf_dir, True), NODES)


@query(f"with {_ACC_REPLICATED}, {_ACTIVE} select distinct p.tx, p.part as node, a.node as target, tbl, k from placed p join active a on a.tx = p.tx and a.node <> p.part where op = 'R' and not replicated")
def push_sets(spark, sf_dir):
    """What owners send to other active nodes."""
    return analysis.push_sets(_placed(spark, sf_dir, True))


@query(f"with {_ACC_REPLICATED}, {_ACTIVE} select distinct p.tx, a.node, tbl, k from placed p join active a using (tx) where op = 'R' and replicated")
def replicated_reads(spark, sf_dir):
    """Reads of replicated keys, local on active nodes."""
    return analysis.replicated_reads(_placed(spark, sf_dir, True))


@query(f"""with {_ACC_REPLICATED}, {_NODES}, {_ACTIVE}
select distinct tx, node, case when part = node then 'local_read' else 'remote_read' end as kind, tbl, k from placed cross join nodes where op = 'R' and not replicated
union all select distinct tx, part, 'update', tbl, k from placed where op = 'U' and not replicated
union all select distinct tx, a.node, 'local_read', tbl, k from placed join active a using (tx) where op = 'R' and replicated""")
def local_sets(spark, sf_dir):
    """Local and remote reads and local writes of every node."""
    return analysis.local_sets(_placed(spark, sf_dir, True), NODES)


@query(f"""with {_ACC_REPLICATED}, {_NODES}, {_ACTIVE}, pushed as (
    select p.tx, p.part as node, count(distinct (a.node, tbl, k)) as pushes from placed p join active a on a.tx = p.tx and a.node <> p.part where op = 'R' and not replicated group by all
), every as (select tx, node from (select distinct tx from placed) cross join nodes)
select e.tx, e.node, case when a.node is not null then 'ACTIVE' when r.own then 'PASSIVE' else 'IGNORE' end as role, not coalesce(r.writes, false) as read_only,
    coalesce(r.own or (r.rep and a.node is not null), false) as has_local_reads, coalesce(r.away, false) as has_remote_reads, coalesce(p.pushes, 0)::bigint as pushes
from every e left join active a using (tx, node) left join pushed p using (tx, node)
left join (select e.tx, e.node, bool_or(op = 'R' and not replicated and part = node) as own, bool_or(op = 'R' and not replicated and part <> node) as away, bool_or(op <> 'R' and part = node) as writes, bool_or(op = 'R' and replicated) as rep from every e join placed p using (tx) group by all) r using (tx, node)""")
def plan_flags(spark, sf_dir):
    """What each node's plan for a transaction amounts to."""
    return analysis.plan_flags(_placed(spark, sf_dir, True), NODES)


@query(f"with {_ACC_REPLICATED} select distinct tx, op <> 'R' as is_write, tbl, k from placed where not replicated")
def monitored_keys(spark, sf_dir):
    """Keys that a sequencer hands on for watching."""
    return analysis.monitored_keys(_placed(spark, sf_dir, True))


# --- records


@query("select * from customer where c_custkey = 42")
def point_read(spark, sf_dir):
    """One customer by key."""
    return crud.point_read(read(spark, sf_dir, "customer"), Key.of("customer", c_custkey=42))


@query("select c.* from customer c where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def batch_read(spark, sf_dir):
    """The customers of all urgent orders; a missing one fails the job."""
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return crud.batch_read(read(spark, sf_dir, "customer"), urgent, ["c_custkey"])


@query("select * from supplier union all select s_suppkey + (select max(s_suppkey) + 1 from supplier), s_name || ' copy', s_nationkey, s_acctbal from supplier where s_nationkey < 5")
def insert_rows(spark, sf_dir):
    """Suppliers with new ones."""
    suppliers = read(spark, sf_dir, "supplier")
    first = (suppliers.agg(F.max("s_suppkey")).first()[0] or 0) + 1
    return crud.insert(suppliers, suppliers.where("s_nationkey < 5").withColumns({"s_suppkey": F.col("s_suppkey") + first, "s_name": F.concat("s_name", F.lit(" copy"))}))


@query("""select c_custkey, c_name, c_nationkey, case when c_custkey % 7 = 0 then c_acctbal + 100 else c_acctbal end as c_acctbal, case when c_custkey % 7 = 0 and c_custkey % 2 = 0 then 'MOVED' else c_mktsegment end as c_mktsegment from customer""")
def update_dirty(spark, sf_dir):
    """Customers after updates that touch one or two fields."""
    customers = read(spark, sf_dir, "customer")
    records = crud.as_records(customers.where("c_custkey % 7 = 0"))
    changed = crud.set_values(records, {"c_acctbal": F.col("c_acctbal") + 100}, ["c_custkey"])
    changed = changed.withColumns({"c_mktsegment": F.lit("MOVED"), crud.DIRTY: F.when(F.col("c_custkey") % 2 == 0, F.array_union(crud.DIRTY, F.array(F.lit("c_mktsegment")))).otherwise(F.col(crud.DIRTY))})
    return crud.update(customers, changed.select("c_custkey", "c_acctbal", "c_mktsegment", crud.DIRTY), ["c_custkey"], crud.DIRTY)


@query("select * from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def delete_keys(spark, sf_dir):
    """Orders without those of customers in debt."""
    debt = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return crud.delete(read(spark, sf_dir, "orders"), debt, ["o_custkey"])


@query("""with n as (select s_suppkey * 2 as s_suppkey, s_name || ' new' as s_name, null::integer as s_nationkey, s_acctbal from supplier)
select coalesce(s.s_suppkey, n.s_suppkey) as s_suppkey, coalesce(n.s_name, s.s_name) as s_name, coalesce(n.s_nationkey, s.s_nationkey) as s_nationkey, coalesce(n.s_acctbal, s.s_acctbal) as s_acctbal from supplier s full join n using (s_suppkey)""")
def upsert_fallback(spark, sf_dir):
    """Suppliers after updates that insert what they don't find."""
    suppliers = read(spark, sf_dir, "supplier")
    rows = suppliers.withColumns({"s_suppkey": F.col("s_suppkey") * 2, "s_name": F.concat("s_name", F.lit(" new")), "s_nationkey": F.lit(None).cast("int")})
    return crud.upsert(suppliers, rows, ["s_suppkey"])


@query("select c_custkey, c_name, case when c_custkey % 3 = 0 then -1.0 else c_acctbal end as c_acctbal, c_custkey % 3 = 0 as from_cache from customer where c_custkey % 2 = 0")
def read_through(spark, sf_dir):
    """Records from a cache where it has them, else from storage."""
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    cache = customers.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0))
    return crud.read_through(cache, customers, customers.where("c_custkey % 2 = 0"), ["c_custkey"])


@query("select l_orderkey, l_linenumber, count(*)::bigint as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """Keys that several rows have."""
    return crud.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select c_custkey, '{customer: c_custkey -> ' || c_custkey || '}' as key_text, 'nation: {*n_nationkey: ' || n_nationkey || ', n_name: ' || n_name || ', n_regionkey: ' || n_regionkey || '}' as nation_text from customer join nation on c_nationkey = n_nationkey")
def printed_records(spark, sf_dir):
    """Keys and records as text."""
    both = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select("c_custkey", key_text("customer", {"c_custkey": "c_custkey"}).alias("key_text"), record_text("nation", ["n_nationkey"], ["n_name", "n_regionkey"]).alias("nation_text"))


@query("select event_id, trunc(value)::bigint + trunc((value - trunc(value)) * 10000.0)::bigint / 10000.0 as cut from events")
def truncated_values(spark, sf_dir):
    """Values cut after four decimals."""
    return read(spark, sf_dir, "events").select("event_id", truncate(F.col("value")).alias("cut"))


# --- the graph of transactions


@query(f"with {_ACC}, {_KEYED} select tx, batch from batches")
def tx_batches(spark, sf_dir):
    """Batches of ten transactions."""
    return graph.batches(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx")), BATCH)


@query(f"with {_ACC}, {_KEYED} select batch, src, dst, tbl, k from edges")
def read_edges(spark, sf_dir):
    """Who each read of a batch comes from."""
    return graph.read_edges(_keyed(spark, sf_dir)).select("batch", "src", "dst", "tbl", "k")


@query(f"with {_ACC}, {_KEYED} select batch, src, dst, tbl, k from edges where src >= 0")
def write_edges(spark, sf_dir):
    """What transactions pass to later ones of their batch."""
    return graph.write_edges(graph.read_edges(_keyed(spark, sf_dir))).select("batch", "src", "dst", "tbl", "k")


@query(f"with {_ACC}, {_KEYED} select batch, src, tbl, k, part from backs")
def writeback_edges(spark, sf_dir):
    """Who writes each key of a batch back, and where to."""
    return graph.writeback_edges(_keyed(spark, sf_dir))


@query(f"with {_ACC_REPLICATED}, {_NODES}, {_KEYED}, {_ROUTES}, {_SOURCES} select batch, dst as tx, tbl, k, src_node, node from placed_edges where src < 0")
def sink_reads(spark, sf_dir):
    """Reads from storage, replicated keys at the reader's node."""
    return graph.sources(graph.routed(_routed(spark, sf_dir, True), None)).where("rd and src < 0").select("batch", "tx", "tbl", "k", "src_node", "node")


@query(f"""with {_ACC_REPLICATED}, {_NODES}, {_KEYED}, {_ROUTES}, {_SOURCES}
select batch, dst as tx, node, 'read' as kind, tbl, k, src as other, null::integer as target from placed_edges
union all select batch, dst, node, 'storage_read', tbl, k, src, null from placed_edges where src < 0 and src_node = node
union all select batch, dst, src_node, 'storage_push', tbl, k, dst, node from placed_edges where src < 0 and src_node <> node
union all select batch, src, src_node, case when src_node = node then 'pass' else 'push' end, tbl, k, dst, case when src_node <> node then node end from placed_edges where src >= 0
union all select batch, src, part, 'write_back', tbl, k, src, null from backs
union all select batch, src, node, 'push', tbl, k, -(part + 1), part from backs join routes on tx = src where part <> node""")
def sunk_plan_roles(spark, sf_dir):
    """What every node does for the transactions of a routed batch."""
    return graph.sunk_plans(_routed(spark, sf_dir, True))


@query(f"""with {_ACC}, {_NODES}, {_KEYED}, {_ROUTES}, {_SOURCES}, does as (
    select dst as tx, node, false as wb from placed_edges union all select dst, src_node, false from placed_edges where src < 0 union all select src, src_node, false from placed_edges where src >= 0
    union all select src, part, true from backs union all select src, node, false from backs join routes on tx = src where part <> node union all select tx, node, false from routes
)
select tx, node::integer as node, (tx, node) in (select tx, node from routes) as is_master, not bool_or(wb) as read_only from does group by tx, node""")
def sunk_flags(spark, sf_dir):
    """Which nodes run a transaction's plan, and whether they write."""
    return graph.sunk_flags(_routed(spark, sf_dir))


@query(f"""with {_ACC}, {_NODES}, {_KEYED}, {_ROUTES}, {_SOURCES}, per as (
    select batch, n.node, count(r.tx) as c, sum(count(r.tx)) over (partition by batch) as total from (select distinct batch from batches) cross join nodes n left join (select * from batches join routes using (tx)) r using (batch, node) group by batch, n.node
)
select p.batch, any_value(total)::bigint as n_tx, any_value(e.t)::bigint as remote_tx_reads, any_value(e.s)::bigint as remote_storage_reads, sum(abs(c - total // 4))::bigint as imbalance
from per p join (select batch, count(*) filter (src_node <> node and src >= 0) as t, count(*) filter (src_node <> node and src < 0) as s from placed_edges group by batch) e using (batch) group by p.batch""")
def graph_stats(spark, sf_dir):
    """Remote reads and imbalance of every batch."""
    return graph.statistics(_routed(spark, sf_dir), None, NODES)


@query(f"""with {_ACC}, {_NODES}, {_KEYED}, {_ROUTES}, {_SOURCES}, per as (
    select r.tx, r.node, coalesce(count(*) filter (e.src_node <> e.node), 0) as away from routes r left join placed_edges e on e.dst = r.tx group by r.tx, r.node
)
select n.node, count(p.tx)::bigint as n_tx, count(*) filter (away > 0)::bigint as n_distributed, coalesce(count(*) filter (away > 0) / nullif(count(p.tx), 0), 0)::double as ratio, coalesce(sum(away), 0)::bigint as remote_reads from nodes n left join per p using (node) group by n.node""")
def remote_read_ratio(spark, sf_dir):
    """Transactions, distributed ones and remote reads of every partition."""
    return graph.partition_statistics(_routed(spark, sf_dir), None, NODES)


@query(f"""with {_ACC}, {_NODES}, {_KEYED}, {_ROUTES}, {_SOURCES}, lines as (
    select batch, tx, 0 as g, 0 as src, 0 as dst, '' as tbl, 0 as k, 'Node.' || tx || ' on part.' || node as line from batches join routes using (tx)
    union all select batch, dst, 1, src, dst, tbl, k, null from placed_edges
    union all select batch, src, 2, src, dst, tbl, k, null from placed_edges where src >= 0
    union all select batch, src, 3, src, -(part + 1), tbl, k, null from backs
)
select batch, row_number() over (partition by batch order by tx, g, src, dst, tbl, k)::bigint as line_no, coalesce(line, '{{Resource: {{' || tbl || ': k -> ' || k || '}} from tx.' || src || ' to tx.' || dst || '}}') as line from lines""")
def graph_lines(spark, sf_dir):
    """The graph of every batch as text."""
    return graph.edge_lines(_routed(spark, sf_dir))


@query(f"with {_ACC}, {_NODES}, {_KEYED}, {_ROUTES}, {_SOURCES} select batch, src, dst, max(k) as k from (select batch, src, dst, k from placed_edges union all select batch, src, -(part + 1), k from backs) group by batch, src, dst")
def compact_graph(spark, sf_dir):
    """One edge between any two nodes of the graph."""
    return graph.compact_edges(_routed(spark, sf_dir))


@query(f"with {_ACC}, {_NODES}, {_ROUTES} select tx, node, n_remote from routes")
def route_local_first(spark, sf_dir):
    """The partition with fewest remote reads for each transaction."""
    return routing.local_first(_placed(spark, sf_dir), NODES)


_IN_BATCH = "in_batch as (select tx, batch, row_number() over (partition by batch order by tx) - 1 as pos from batches)"


@query(f"""with recursive {_ACC}, {_KEYED}, {_IN_BATCH}, met as (
    select d.batch, d.pos, s.pos as writer, case when src < 0 then -src - 1 end as home from edges e join in_batch d on d.tx = dst left join in_batch s on s.tx = src
), each as (
    select b.batch, b.pos, coalesce(list(writer) filter (writer is not null), []) as writers, [count(*) filter (home = 0), count(*) filter (home = 1), count(*) filter (home = 2), count(*) filter (home = 3)] as homes
    from in_batch b left join met using (batch, pos) group by all
), step as (
    select distinct batch, 0::bigint as pos, []::integer[] as route from batches
    union all
    select s.batch, s.pos + 1, list_append(route, list_position(n, list_max(n)) - 1)
    from (select s.batch, s.pos, route, list_transform([0, 1, 2, 3], lambda p: homes[p + 1] + len(list_filter(writers, lambda w: route[w + 1] = p))) as n from step s join each using (batch, pos)) s
)
select b.batch, b.tx, route[b.pos + 1]::integer as node from in_batch b join step s on s.batch = b.batch join (select batch, max(pos) + 1 as n from in_batch group by batch) t on t.batch = s.batch and t.n = s.pos""")
def route_cost(spark, sf_dir):
    """Routes by cost inside batches."""
    return routing.cost_routes(_keyed(spark, sf_dir), NODES)


@query()
def route_balanced(spark, sf_dir):
    """Routes by fewest remote reads, balanced inside batches."""
    return routing.balanced_routes(_keyed(spark, sf_dir), NODES)


@query()
def route_fused(spark, sf_dir):
    """Balanced routes with written records staying where they were written."""
    return routing.fused_routes(checkpoint(_keyed(spark, sf_dir)), NODES)


@query()
def route_local_fused(spark, sf_dir):
    """Local-first routes, one transaction at a time, with written records staying where they were written."""
    keys = checkpoint(graph.keyed(_placed(spark, sf_dir), graph.batches(tables.order_transactions(spark, sf_dir), 1)))
    return routing.fused_routes(keys, NODES, rule="local_first")


# --- change rows and outcomes

_FOLD = f"""{_EVENTS}, changes as (
    select k, tx, case pid when 4 then 'I' else case when tx % 11 = 0 then 'D' else 'U' end end as op, case when pid <> 4 and tx % 11 = 0 then null else value end as value from log where pid in (2, 3, 4)
), base as (select distinct user_id as k, 0.0::double as value from events where user_id % 3 = 0),
since as (select k, max(tx) as since from changes where op <> 'U' group by k),
last as (select k, max(tx) as last_tx, arg_max(op, tx) as op, arg_max(value, tx) filter (op <> 'D') as value, any_value(since) is not null as replaced from changes left join since using (k) where since is null or tx >= since group by k)"""


@query(f"with {_FOLD} select coalesce(b.k, l.k) as k, case when l.replaced then l.value else coalesce(l.value, b.value) end as value, coalesce(last_tx, -1)::bigint as version from base b full join last l using (k) where l.op is distinct from 'D'")
def fold_state(spark, sf_dir):
    """A table after all changes of the log."""
    log = tables.event_log(spark, sf_dir)
    base = log.where("k % 3 = 0").select("k", F.lit(0.0).alias("value")).distinct()
    return fold.apply_changes(base, tables.event_changes(log), ["k"])


@query(f"with {_VOTES}, outcomes as (select tx, bool_and(yes) as ok from votes group by tx), kept as (select l.* from log l join outcomes using (tx) where ok and pid in (2, 3, 4)) select k, count(*)::bigint as n_changes, max(tx) as last_tx, round(sum(value), 2) as total from kept group by k")
def committed_changes(spark, sf_dir):
    """Changes of committed transactions by key."""
    log = tables.event_log(spark, sf_dir)
    outcomes = fold.two_phase_decisions(tables.event_votes(log))
    kept = fold.committed(log.where("pid in (2, 3, 4)"), outcomes)
    return kept.groupBy("k").agg(F.count(F.lit(1)).alias("n_changes"), F.max("tx").alias("last_tx"), F.round(F.sum("value"), 2).alias("total"))


@query(f"with {_EVENTS} select client_id, conn_id as rte_id, tx, 0 as node, pid <> 5 as committed from log")
def response_dedup(spark, sf_dir):
    """One answer for each request that every node answers."""
    log = tables.event_log(spark, sf_dir)
    answers = log.select("client_id", F.col("conn_id").alias("rte_id"), "tx", (F.col("pid") != 5).alias("committed"), F.explode(F.array(*map(F.lit, range(NODES)))).alias("node"))
    return fold.accepted_responses(answers)


@query(f"with {_VOTES} select tx, bool_and(yes) as committed, min(node) filter (not yes) as abort_node, arg_min(message, node) filter (not yes) as message from votes group by tx")
def vote_2pc(spark, sf_dir):
    """The decision on every transaction that all nodes vote on."""
    return fold.two_phase_decisions(tables.event_votes(tables.event_log(spark, sf_dir)))


@query(f"with {_EVENTS} select pid, client_id, count(*)::bigint as requests, min(tx) as first_tx, max(tx) as last_tx from log where pid <> 1 group by pid, client_id")
def request_log(spark, sf_dir):
    """Logged requests: those that write."""
    log = tables.event_log(spark, sf_dir).where("pid <> 1")
    return log.groupBy("pid", "client_id").agg(F.count(F.lit(1)).alias("requests"), F.min("tx").alias("first_tx"), F.max("tx").alias("last_tx"))


@query(f"with {_EVENTS} select tx, client_id, conn_id, pid, k::varchar as k, value::integer as cents from (select * replace (floor(value) as value) from log) where pid <> 1")
def stored_log(spark, sf_dir):
    """Requests that write, with their parameters, as read back from the stored log."""
    whole = F.floor("value").cast("string")
    log = tables.event_log(spark, sf_dir).withColumn("params", F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("cents"), whole))
    path = scratch(spark, "request-log")
    requests.write_log(log, path, read_only=(1,))
    return requests.read_log(spark, path).select("tx", "client_id", "conn_id", "pid", F.col("params")["k"].alias("k"), F.col("params")["cents"].cast("int").alias("cents"))


# --- conflicts

_LOCKS = f"{_ACC}, locks as (select tx, tbl, k, case when bool_or(op <> 'R') then 'X' else 'S' end as mode from acc group by tx, tbl, k)"


@query(f"""with {_LOCKS}, w as (
    select *, last_value(case when mode = 'X' then tx end ignore nulls) over (partition by tbl, k order by tx rows between unbounded preceding and 1 preceding) as x_before,
        lag(mode) over (partition by tbl, k order by tx) as mode_before, lag(tx) over (partition by tbl, k order by tx) as tx_before,
        first_value(case when mode = 'X' then tx end ignore nulls) over (partition by tbl, k order by tx rows between 1 following and unbounded following) as x_after from locks
)
select tbl, k, tx, mode, x_before as waits_for, 'X' as held_mode from w where mode = 'S' and x_before is not null
union all select tbl, k, x_after, 'X', tx, 'S' from w where mode = 'S' and x_after is not null
union all select tbl, k, tx, mode, tx_before, 'X' from w where mode = 'X' and mode_before = 'X'""")
def conflict_pairs(spark, sf_dir):
    """Which request directly waits for which."""
    return conflicts.waits(checkpoint(conflicts.requests(tables.order_accesses(spark, sf_dir))))


@query(f"with {_LOCKS} select *, row_number() over (partition by tbl, k order by tx)::bigint as position from locks")
def lock_queue_position(spark, sf_dir):
    """Each request's place in its key's queue."""
    return conflicts.queue_positions(checkpoint(conflicts.requests(tables.order_accesses(spark, sf_dir))))


@query("""with m as (select unnest(['S', 'X', 'SIX', 'IX', 'IS']) as mode)
select a.mode as requested, b.mode as held, (a.mode, b.mode) in (('S', 'S'), ('S', 'IS'), ('SIX', 'IS'), ('IX', 'IX'), ('IX', 'IS'), ('IS', 'IS'), ('IS', 'IX'), ('IS', 'S'), ('IS', 'SIX')) as compatible from m a cross join m b""")
def lock_compatibility(spark, sf_dir):
    """Which lock modes go together."""
    return conflicts.compatibility(spark)


@query(f"""with recursive {_LOCKS}, batches as (
    select tx, floor((row_number() over (order by tx) - 1) / 10)::bigint as batch from (select distinct tx from acc)
), {_IN_BATCH}, held as (select batch, pos, tbl, k, mode from locks join in_batch using (tx)), each as (
    select i.batch, i.pos, coalesce(list(distinct b.pos) filter (b.pos is not null), []) as behind
    from in_batch i left join held a using (batch, pos) left join held b on b.batch = a.batch and b.tbl = a.tbl and b.k = a.k and b.pos < a.pos and (a.mode = 'X' or b.mode = 'X') group by all
), step as (
    select distinct batch, 0::bigint as pos, []::integer[] as levels from batches
    union all
    select s.batch, s.pos + 1, list_append(levels, coalesce(list_max(list_transform(behind, lambda p: levels[p + 1])), -1) + 1) from step s join each using (batch, pos)
)
select b.batch, b.tx, levels[b.pos + 1]::integer as level from in_batch b join step s on s.batch = b.batch join (select batch, max(pos) + 1 as n from in_batch group by batch) t on t.batch = s.batch and t.n = s.pos""")
def dependency_levels(spark, sf_dir):
    """Which transactions of a batch can run side by side."""
    acc = checkpoint(tables.order_accesses(spark, sf_dir))
    return conflicts.levels(conflicts.requests(acc), graph.batches(acc, BATCH))


# --- marks on transaction numbers

_COMMITS = "commits as (select (row_number() over (order by event_id + (event_id * 7919) % 17, event_id) - 1)::bigint as n, event_id as tx, (event_id % 2)::integer as dispatcher from events)"
_MARKS = f"""{_COMMITS}, need as (select *, max(n) over (partition by dispatcher order by tx) as need from commits),
reached as (select dispatcher, need as n, max(tx) as t from need group by all),
marks as (select c.n, c.tx, dispatcher, coalesce(max(t) over (partition by dispatcher order by c.n), dispatcher - 2)::bigint as mark from commits c left join reached using (dispatcher, n))"""


@query(f"with {_MARKS} select n, tx, dispatcher, mark from marks")
def low_water_mark(spark, sf_dir):
    """Each dispatcher's mark after every commit."""
    return watermarks.marks(checkpoint(tables.event_commits(tables.event_log(spark, sf_dir))), 2)


@query(f"""with {_MARKS}, records as (select event_id as tx, event_id + 1 as at, (event_id % 2)::integer as dispatcher from events)
select r.tx, r.at, case when r.tx <= coalesce(m.mark, r.dispatcher - 2) then 'dropped' else 'kept' end as fate from records r asof left join marks m on m.dispatcher = r.dispatcher and r.at > m.n""")
def late_records(spark, sf_dir):
    """Records that come after all transactions up to theirs have committed."""
    log = tables.event_log(spark, sf_dir)
    return watermarks.record_fates(log.select("tx", (F.col("tx") + 1).alias("at")), checkpoint(tables.event_commits(log)), 2)


# --- migration


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, moves = _placed(spark, sf_dir), tables.customer_moves(spark, sf_dir)
    return migration.status(placed, moves, migration.first_touches(placed, moves, *tables.order_period(spark, sf_dir)))


@query(f"with {_MOVES} select tbl, k, src, dest, push_order, ((row_number() over (partition by src, dest order by push_order) - 1) // 50)::bigint as chunk from moves")
def migration_chunks(spark, sf_dir):
    """The chunks in which keys are pushed."""
    return migration.chunks(tables.customer_moves(spark, sf_dir), 50)


@query(f"with {_ACC}, {_STATUS} select tx, seq, tbl, k, op, part, src, dest, is_migrated from seen")
def migration_status(spark, sf_dir):
    """Every access with where its key stands in the migration."""
    return _seen(spark, sf_dir).select("tx", "seq", "tbl", "k", "op", "part", "src", "dest", "is_migrated")


def _ways(homes: str, copied: str, before: str = "") -> str:
    return f"""with {_ACC}, {_NODES}, {_STATUS}{before}, homed as (
    select *, case when src is null then [part] else {homes} end as homes, src is not null and {copied} as copied from {"seen" if not before else "joined"}
)
select distinct tx, node, case when op = 'U' then 'update' when list_contains(homes, node) then 'local_read' else 'remote_read' end as kind, tbl, k from homed cross join nodes where op = 'R' or list_contains(homes, node)
union all select distinct tx, src, 'copy_out', tbl, k from homed where copied
union all select distinct tx, dest, 'copy_in', tbl, k from homed where copied"""


@query(_ways("[src]", "false"))
def source_only_sets(spark, sf_dir):
    """Reads and writes of all nodes while data moves in the background."""
    return migration.analyse(_seen(spark, sf_dir), NODES, "source_only")


@query(_ways("[case when tx >= (select a from period) then dest else src end]", "false"))
def stop_and_copy_sets(spark, sf_dir):
    """Reads and writes of all nodes when everything is copied at once, before the first transaction of the period."""
    placed, moves = _placed(spark, sf_dir), tables.customer_moves(spark, sf_dir)
    return migration.analyse(migration.stopped_copy(placed, moves, tables.order_period(spark, sf_dir)[0]), NODES, "stop_and_copy")


@query(f"with {_MOVES}, chunked as (select k, src, dest, ((row_number() over (partition by src, dest order by push_order) - 1) // 20)::bigint as chunk from moves) select c_custkey, c_acctbal, chunk, src, dest from customer join chunked on c_custkey = k")
def stop_and_copy_rows(spark, sf_dir):
    """Rows that are copied at once, in chunks of four times five keys."""
    found = migration.copied_chunks(read(spark, sf_dir, "customer"), tables.customer_moves(spark, sf_dir), "c_custkey", 5)
    return found.select("c_custkey", "c_acctbal", "chunk", "src", "dest")


@query(_ways("[src, dest]", "not is_migrated"))
def crabbing_reads(spark, sf_dir):
    """Reads and writes of all nodes while both ends run moving keys."""
    return migration.analyse(_seen(spark, sf_dir), NODES, "crabbing")


@query(_ways("case when op = 'R' and not is_migrated then [src, dest] else [dest] end", "not is_migrated"))
def caught_up_reads(spark, sf_dir):
    """Reads and writes of all nodes when destinations run moving keys."""
    return migration.analyse(_seen(spark, sf_dir), NODES, "caught_up")


@query(_ways(
    "case when tx < (select (a + z) // 2 from period) or (op = 'R' and not is_migrated) then [src, dest] else [dest] end",
    "not is_migrated",
    ", joined as (select * replace (case when tx >= (select z from period) then coalesce(dest, part) else part end as part, case when tx >= (select a from period) and tx < (select z from period) then src end as src, case when tx >= (select a from period) and tx < (select z from period) then dest end as dest) from seen)",
))
def live_migration_sets(spark, sf_dir):
    """Reads and writes of all nodes before, in both phases of, and after a migration that the engine runs."""
    start, end = tables.order_period(spark, sf_dir)
    engine = Engine(spark, Config(partitions=NODES))
    return engine.migrate(_placed(spark, sf_dir), tables.customer_moves(spark, sf_dir), start, end, (start + end) // 2)[0]


@query(_ways("[spot]", "spot = dest and not is_migrated", ", joined as (select s.*, case when bool_or(is_migrated) over (partition by tx, src, dest) then dest else src end as spot from seen s)"))
def on_demand_paths(spark, sf_dir):
    """Reads and writes of all nodes when a transaction's moving keys run at one end."""
    return migration.analyse(_seen(spark, sf_dir), NODES, "on_demand")


@query(f"""with {_ACC}, {_NODES}, {_STATUS}, reads as (
    select distinct tx, tbl, k, unnest(case when src is null then [part] else [src, dest] end) as node from seen where op = 'R'
), writers as (
    select distinct tx, unnest(case when src is null then [part] else [src, dest] end) as node from seen where op <> 'R'
), active as (
    select * from writers union all select tx, node from (select tx, node, count(*) as n from reads group by all) where tx not in (select tx from writers) qualify row_number() over (partition by tx order by n desc, node) = 1
)
select t.tx, node, case when (t.tx, node) in (select tx, node from active) then 'ACTIVE' when (t.tx, node) in (select tx, node from reads) then 'PASSIVE' else 'IGNORE' end as role from (select distinct tx from placed) t cross join nodes""")
def crabbing_roles(spark, sf_dir):
    """Which nodes take part while both ends run moving keys."""
    seen = _seen(spark, sf_dir)
    return migration.roles(migration.analyse(seen, NODES, "crabbing", remote=False), seen, NODES, "crabbing")


@query(f"""with {_ACC}, {_STATUS}, reads as (
    select distinct tx, tbl, k, src, dest, unnest(case when src is null then [part] else [src, dest] end) as node from seen where op = 'R'
), active as (
    select distinct tx, unnest(case when src is null then [part] else [src, dest] end) as node from seen where op <> 'R'
)
select r.tx, r.node, a.node as target, tbl, k from reads r join active a on a.tx = r.tx and a.node <> r.node where src is null or not (r.node in (src, dest) and a.node in (src, dest))""")
def crabbing_pushes(spark, sf_dir):
    """What nodes send, but for keys that both already have."""
    seen = _seen(spark, sf_dir)
    sets = migration.analyse(seen, NODES, "crabbing", remote=False)
    return migration.pushes(sets, migration.roles(sets, seen, NODES, "crabbing"), tables.customer_moves(spark, sf_dir))


@query(f"with {_ACC}, {_MOVES}, marked as (select dest, tbl, k, case when op = 'U' and tx % 13 = 0 then 'D' when op = 'U' and tx % 17 = 0 then 'I' else op end as op from placed join moves using (tbl, k) where op <> 'R' and tx >= (select a from period) and tx < (select z from period)) select dest, tbl, k, case when bool_or(op = 'I') then 'I' when bool_or(op = 'D') then 'D' else 'U' end as op from marked group by dest, tbl, k")
def handover_changes(spark, sf_dir):
    """What a source hands over of keys that changed while they were copied."""
    odd = F.when((F.col("op") == "U") & (F.col("tx") % 13 == 0), "D").when((F.col("op") == "U") & (F.col("tx") % 17 == 0), "I").otherwise(F.col("op"))
    placed = _placed(spark, sf_dir).withColumn("op", odd)
    return migration.handover(migration.changed_keys(placed, tables.customer_moves(spark, sf_dir), *tables.order_period(spark, sf_dir)))


@query(f"""with {_MOVES}, a as (select tbl, k, src, dest from moves), b as (select tbl, k, dest as src, case when k % 3 = 0 then src else ((dest + 1) % 4)::integer end as dest from moves where k % 2 = 0)
select tbl, k, a.src, coalesce(b.dest, a.dest)::integer as dest from a left join b using (tbl, k) where a.src <> coalesce(b.dest, a.dest)""")
def route_merge(spark, sf_dir):
    """Two plans' moves as one."""
    first = tables.customer_moves(spark, sf_dir).select("tbl", "k", F.lit(0).alias("step"), "src", "dest")
    again = F.when(F.col("k") % 3 == 0, F.col("src")).otherwise((F.col("dest") + 1) % NODES).cast("int")
    second = first.where("k % 2 = 0").select("tbl", "k", F.lit(1).alias("step"), F.col("dest").alias("src"), again.alias("dest"))
    return migration.merge_routes(first.unionByName(second))


@query(f"""with {_ACC}, {_STATUS}, chunked as (select tbl, k, ((row_number() over (partition by src, dest order by push_order) - 1) // 50)::bigint as chunk from moves),
phases as (select chunk, (select a from period) + chunk * 500 as read_tx, (select a from period) + chunk * 500 + 250 as store_tx from (select distinct chunk from chunked))
select chunk, tbl, k, coalesce(migrated_tx >= read_tx, true) as shipped, coalesce(migrated_tx >= read_tx, true) and coalesce(migrated_tx >= store_tx, true) as stored from chunked join phases using (chunk) left join migrated using (tbl, k)""")
def two_phase_push(spark, sf_dir):
    """Which pushed keys are shipped, and stored in the end."""
    placed, moves, (start, end) = _placed(spark, sf_dir), tables.customer_moves(spark, sf_dir), tables.order_period(spark, sf_dir)
    chunked = migration.chunks(moves, 50)
    phases = chunked.select("chunk").distinct().select("chunk", (F.col("chunk") * 500 + start).alias("read_tx"), (F.col("chunk") * 500 + start + 250).alias("store_tx"))
    return migration.two_phase_stored(chunked, migration.first_touches(placed, moves, start, end), phases)


@query(f"""with {_ACC}, {_STATUS}, chunked as (select tbl, k, src, dest, ((row_number() over (partition by src, dest order by push_order) - 1) // 50)::bigint as chunk from moves)
select c.c_custkey, c.c_acctbal, chunk, src, dest from chunked join customer c on c.c_custkey = k left join migrated using (tbl, k) where migrated_tx is null or migrated_tx >= (select a from period) + chunk * 500""")
def background_push(spark, sf_dir):
    """Rows that background pushes carry."""
    placed, moves, (start, end) = _placed(spark, sf_dir), tables.customer_moves(spark, sf_dir), tables.order_period(spark, sf_dir)
    chunked = migration.chunks(moves, 50)
    pushed = chunked.select("chunk").distinct().select("chunk", (F.col("chunk") * 500 + start).alias("push_tx"))
    found = migration.background_copy(read(spark, sf_dir, "customer"), chunked, migration.first_touches(placed, moves, start, end), "c_custkey", pushed)
    return found.select("c_custkey", "c_acctbal", "chunk", "src", "dest")


@query(f"with {_ACC}, {_MOVES}, used as (select distinct tbl, k from placed) select tbl, k, src, dest from used left join moves using (tbl, k)")
def moving_keys(spark, sf_dir):
    """Which of the used keys are on the move, and between which ends."""
    used = _placed(spark, sf_dir).select("tbl", "k").distinct()
    return migration.containing_range(used, tables.customer_moves(spark, sf_dir).withColumn("range_no", F.col("push_order")))


@query(f"with {_MOVES} select tbl, k, src, dest from moves where src <> 0 or k % 3 = 0")
def still_to_push(spark, sf_dir):
    """Keys that are left when the ranges from partition 0 are cut to every third key."""
    moves = tables.customer_moves(spark, sf_dir).select("src", "dest", "tbl", "k")
    return migration.remaining(moves, moves.where("src = 0 and k % 3 = 0")).select("tbl", "k", "src", "dest")


@query(f"with {_MOVES}, done as (select src, dest, max(k) as finish_tx from moves group by src, dest) select finish_tx, (select count(*) from done) - row_number() over (order by finish_tx, src, dest) as ranges_left from done")
def ranges_left(spark, sf_dir):
    """The count-down of ranges whose moves have finished."""
    moves = tables.customer_moves(spark, sf_dir)
    return migration.ranges_left(moves, moves.groupBy("src", "dest").agg(F.max("k").alias("finish_tx")))


@query(f"with {_MOVES}, older as (select 'customer' as tbl, c_custkey as k, 3 as dest from customer where c_custkey % 15 = 0) select tbl, k, coalesce(m.dest, o.dest)::integer as dest from older o full join moves m using (tbl, k)")
def override_map(spark, sf_dir):
    """Explicit places after a migration, the new ones first."""
    older = read(spark, sf_dir, "customer").where("c_custkey % 15 = 0").select(F.lit("customer").alias("tbl"), F.col("c_custkey").alias("k"), F.lit(3).alias("dest"))
    return migration.new_overrides(older, tables.customer_moves(spark, sf_dir))


@query(f"with {_MOVES} select (row_number() over (order by k, tbl) - 1)::bigint as plan, tbl, k, src, dest from moves")
def key_plans(spark, sf_dir):
    """One plan for each moving key."""
    return migration.single_key_plans(tables.customer_moves(spark, sf_dir))


# --- heat and new placements


@query(f"with {_ACC}, {_NODES}, {_HEAT} select v, part, weight from vertices")
def heat_vertices(spark, sf_dir):
    """How often every key is accessed."""
    return repartition.heat_vertices(_placed(spark, sf_dir))


@query(f"with {_ACC}, {_NODES}, {_HEAT} select src, dst, weight from heat_edges")
def heat_edges(spark, sf_dir):
    """How often two keys are accessed together."""
    return repartition.heat_edges(_placed(spark, sf_dir))


@query(f"with {_ACC}, {_NODES}, {_HEAT} select part, local_load, cross_load, total_load from loads")
def partition_heat(spark, sf_dir):
    """The load of every partition."""
    return repartition.partition_loads(_placed(spark, sf_dir), NODES)


@query(f"with {_ACC}, {_NODES}, {_HEAT} select (select avg(total_load) from loads)::double as threshold, (select min(part) from loads where total_load > (select avg(total_load) from loads))::integer as overloaded")
def overload_threshold(spark, sf_dir):
    """The load above which a partition gives keys away, and the first one there."""
    return repartition.overload_threshold(repartition.partition_loads(_placed(spark, sf_dir), NODES), 1.0)


@query(f"with {_ACC}, {_NODES}, {_HEAT} select part, (row_number() over (partition by part order by weight desc, v))::integer as rank, v, weight from vertices qualify rank <= 10")
def hottest_keys(spark, sf_dir):
    """The ten hottest keys of every partition."""
    return repartition.hottest_vertices(repartition.heat_vertices(_placed(spark, sf_dir)), 10)


@query(f"""with {_ACC}, {_NODES}, {_HEAT}, seeds as (select v, part from vertices qualify row_number() over (partition by part order by weight desc, v) = 1),
near as (select s.v, d.part as dest, count(*) as n from seeds s join heat_edges e on e.src = s.v join vertices d on d.v = e.dst where d.part <> s.part group by all)
select v, dest from near qualify row_number() over (partition by v order by n desc, dest) = 1""")
def clump_seed(spark, sf_dir):
    """Where the hottest key of every partition would go first."""
    placed = _placed(spark, sf_dir)
    vertices = checkpoint(repartition.heat_vertices(placed))
    seeds = checkpoint(repartition.hottest_vertices(vertices).select("v", "part"))
    return repartition.first_destination(seeds, vertices, repartition.edges_from(seeds, placed), repartition.partition_loads(placed, NODES))


@query(f"""with {_ACC}, {_NODES}, {_HEAT}, clump as (select v, part, weight from vertices order by weight desc, v limit 3)
select node as dest, ((select coalesce(sum(weight), 0) from clump where part <> node) + (
    select coalesce(sum(case when d.part = node then -e.weight when d.v in (select v from clump) then 0 else e.weight end), 0) from clump c join heat_edges e on e.src = c.v join vertices d on d.v = e.dst where c.part <> node))::double as delta from nodes""")
def recv_load_delta(spark, sf_dir):
    """The load that each partition would gain by receiving the three hottest keys."""
    placed = _placed(spark, sf_dir)
    vertices = checkpoint(repartition.heat_vertices(placed))
    clump = checkpoint(vertices.orderBy(F.desc("weight"), "v").limit(3))
    return repartition.receive_delta(clump, vertices, repartition.edges_from(clump, placed), NODES)


@query(f"""with {_ACC}, {_NODES}, {_HEAT}, ids as (select v, weight, row_number() over (order by split_part(v, ':', 2)::bigint, v) as id from vertices)
select 0::bigint as line_no, (select count(*) from vertices) || ' ' || (select count(*) // 2 from heat_edges) || ' 011' as line
union all select i.id, any_value(i.weight) || coalesce(' ' || string_agg(o.id || ' ' || e.weight, ' ' order by o.id), '') from ids i left join heat_edges e on e.src = i.v left join ids o on o.v = e.dst group by i.id""")
def metis_lines(spark, sf_dir):
    """The heat graph as METIS lines."""
    return repartition.metis_graph(_placed(spark, sf_dir))


@query(f"with {_ACC}, {_NODES}, {_HEAT} select v, weight, row_number() over (order by split_part(v, ':', 2)::bigint, v) as id from vertices")
def metis_mapping(spark, sf_dir):
    """The keys behind the vertex numbers of the METIS form."""
    return repartition.metis_vertices(repartition.heat_vertices(_placed(spark, sf_dir)))


@query(f"with {_ACC}, {_NODES}, {_HEAT}, ids as (select v, part, row_number() over (order by split_part(v, ':', 2)::bigint, v) as id from vertices) select v, part as src, (id % 3)::integer as dest from ids where part <> id % 3")
def metis_moves(spark, sf_dir):
    """The moves that a METIS result (here: the number's remainder) asks for."""
    vertices = checkpoint(repartition.heat_vertices(_placed(spark, sf_dir)))
    found = repartition.metis_vertices(vertices).select(F.col("id").alias("line_no"), (F.col("id") % 3).alias("part"))
    return repartition.metis_partition(vertices, found)


@query()
def plan_moves(spark, sf_dir):
    """The moves that bring partitions towards the threshold, after a fifth of the parts came to partition 0."""
    came = read(spark, sf_dir, "part").where("p_partkey % 10 in (1, 2)").select(F.lit("part").alias("tbl"), F.col("p_partkey").alias("k"), F.lit(0).alias("dest"))
    plan = placement.OverridePlan(placement.ModuloPlan(NODES), came)
    return repartition.plan_moves_of(checkpoint(plan.place(tables.order_accesses(spark, sf_dir))), NODES, overload=1.03)


@query("select -((c_custkey % 4) + 1) as sink, count(*)::bigint as n from customer group by all")
def storage_ids(spark, sf_dir):
    """Customers by the number that stands for their partition's storage."""
    return read(spark, sf_dir, "customer").groupBy(sink_id(F.pmod("c_custkey", F.lit(NODES))).alias("sink")).agg(F.count(F.lit(1)).alias("n"))
