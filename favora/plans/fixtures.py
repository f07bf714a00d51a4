"""Spatial views over the driver's tables; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_points2d": """select c_custkey as gid, cast((c_custkey * 7919) % 1000 as double) as x,
       cast((c_custkey * 104729) % 997 as double) as y, c_acctbal as value, c_nationkey as grp
from customer""",
    "fx_points3d": """select o_orderkey as gid, cast((o_custkey * 37) % 500 as double) as x,
       cast((o_orderkey * 53) % 500 as double) as y, cast(o_orderkey % 8 as double) * -100e0 as z,
       o_totalprice as value, o_custkey % 25 as fault_id
from orders""",
    "fx_lines": """select s_suppkey as gid, cast((s_suppkey * 131) % 1000 as double) as x0,
       cast((s_suppkey * 257) % 1000 as double) as y0,
       cast((s_suppkey * 131) % 1000 + 50 + (s_suppkey * 13) % 200 as double) as x1,
       cast((s_suppkey * 257) % 1000 + 150 - (s_suppkey * 29) % 300 as double) as y1
from supplier""",
    "fx_rects": """select n_nationkey as gid, cast(n_nationkey % 5 as double) * 200e0 as xmin,
       floor(n_nationkey / 5e0) * 200e0 as ymin,
       cast(n_nationkey % 5 as double) * 200e0 + 150e0 as xmax,
       floor(n_nationkey / 5e0) * 200e0 + 120e0 as ymax,
       n_nationkey % 3 as dn, cast(n_regionkey as double) as value
from nation""",
    "fx_grid2d": """select o_orderkey % 21 as ix, cast(floor(o_orderkey / 21e0) as bigint) as iy,
       cast(o_orderkey % 21 as double) * 50e0 as x, floor(o_orderkey / 21e0) * 50e0 as y
from orders where o_orderkey < 441""",
    "fx_lattice": """select x, y, case when (x + y) % 7 = 0 then null else a end as a,
       case when (x * 3 + y) % 11 = 0 then null else b end as b
from (select cast(o_custkey % 20 as double) as x, cast(o_orderkey % 15 as double) as y,
             round(avg(o_totalprice), 6) as a, cast(count(*) as double) as b
      from orders group by 1, 2) t""",
    "fx_well": """select seq, cast(floor((seq - 1) / 2e0) % 5 as double) as x, cast(floor((seq - 1) / 2e0) % 3 as double) as y,
       floor((seq - 1) / 2e0) * -10e0 as z, value
from (select row_number() over (order by ts, event_id) as seq, value from events where user_id = 8) t""",
    "fx_edges": """select gid, 0 as edge, xmin as x0, ymin as y0, xmax as x1, ymin as y1 from fx_rects
union all select gid, 1, xmax, ymin, xmax, ymax from fx_rects
union all select gid, 2, xmax, ymax, xmin, ymax from fx_rects
union all select gid, 3, xmin, ymax, xmin, ymin from fx_rects""",
}
TABLES = ("customer", "orders", "supplier", "nation", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    sql = re.sub(r"\b(fx_\w+)\b", lambda m: f"({VIEWS[m[1]]})", VIEWS[name])
    for table in TABLES:
        sql = re.sub(rf"(from|join) {table}\b", rf"\1 parquet.`{sf_dir}/{table}.parquet`", sql)
    return spark.sql(sql)


def with_views(sql: str) -> str:
    """DuckDB SQL that may use the views by name."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+\b", text):
            if name in VIEWS:
                need(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    head = ", ".join(f"{n} as ({VIEWS[n]})" for n in needed)
    if not head:
        return sql
    return f"with {head}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {head} {sql}"
