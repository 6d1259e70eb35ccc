"""Parquet table scans and the ``accounts_raw`` stand-in view.

The driver's tables hold no subscription records, so every job starts from
``accounts_raw``: a deterministic derivation of subscriber rows from
customer, orders, nation and region (FIXTURES.md F7). The text below is a
fixed value shared with the DuckDB oracle; Spark plans it like any other
query (partial aggregation of orders map-side, one shuffle on the customer
key, broadcast of the 25-row nation and 5-row region tables).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    return spark.read.parquet(path)


# FIXED VALUE (FIXTURES.md F7): one placeholder per table, filled by spark.sql kwargs.
ACCOUNTS_SQL_TEMPLATE = """
with o as (
  select o_custkey, min(o_orderdate) as f, max(o_orderdate) as l, count(*) as n,
         cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents
  from {orders} group by o_custkey),
b as (
  select c.c_custkey as k, c.c_name as nm, c.c_mktsegment as seg, n.n_name as nat, r.r_name as reg,
         n.n_regionkey as r, o.l as l,
         cast(((year(o.l) - year(o.f)) * 12 + month(o.l) - month(o.f)) * 7 + c.c_custkey as bigint) % 73 as ten,
         1825 + cast(floor(o.cents / o.n / 4000) as bigint) as mcc,
         cast(floor(o.cents / o.n / 5000) as bigint) as cltv,
         case when o.l < timestamp '2001-01-01 00:00:00' then 1 else 0 end as churn
  from {customer} c join o on o.o_custkey = c.c_custkey
       join {nation} n on n.n_nationkey = c.c_nationkey
       join {region} r on r.r_regionkey = n.n_regionkey),
a as (
  select k,
    case when k % 79 = 0 then ' ' else nm end as customerID,
    case when k % 43 = 0 then null when k % 2 = 0 then 'Female' else 'Male' end as gender,
    case when k % 83 = 0 then 'Yes' when k % 6 = 0 then '1' else '0' end as SeniorCitizen,
    case when k % 37 = 0 then 'maybe' when r in (0, 2, 4) then 'Yes' else 'No' end as Partner,
    case when k % 10 in (1, 4, 7) then 'Yes' else 'No' end as Dependents,
    case when k % 101 = 0 then '-3' when k % 103 = 0 then '150' when k % 107 = 0 then 'abc'
         else cast(ten as string) end as tenure,
    case when k % 10 = 9 then 'No' else 'Yes' end as PhoneService,
    case when k % 10 = 9 then 'No phone service' when k % 4 < 2 then 'Yes' else 'No' end as MultipleLines,
    case seg when 'AUTOMOBILE' then 'No' when 'HOUSEHOLD' then 'DSL' when 'FURNITURE' then 'DSL'
         else 'Fiber optic' end as InternetService,
    case when seg = 'AUTOMOBILE' then 'No internet service' when k % 3 = 0 then 'Yes' else 'No' end as OnlineSecurity,
    case when seg = 'AUTOMOBILE' then 'No internet service' when k % 5 < 2 then 'Yes' else 'No' end as OnlineBackup,
    case when seg = 'AUTOMOBILE' then 'No internet service' when k % 7 < 3 then 'Yes' else 'No' end as DeviceProtection,
    case when seg = 'AUTOMOBILE' then 'No internet service' when k % 4 = 0 then 'Yes' else 'No' end as TechSupport,
    case when seg = 'AUTOMOBILE' then 'No internet service' when k % 8 < 3 then 'Yes' else 'No' end as StreamingTV,
    case when seg = 'AUTOMOBILE' then 'No internet service' when k % 9 < 4 then 'Yes' else 'No' end as StreamingMovies,
    case when k % 41 = 0 then ' Month-to-month ' when r = 0 then 'One year' when r = 1 then 'Two year'
         else 'Month-to-month' end as Contract,
    case when k % 5 < 3 then 'Yes' else 'No' end as PaperlessBilling,
    case k % 4 when 0 then 'Electronic check' when 1 then 'Mailed check'
         when 2 then 'Bank transfer (automatic)' else 'Credit card (automatic)' end as PaymentMethod,
    case when k % 97 = 0 then ' '
         else concat(cast(cast(floor(mcc / 100) as bigint) as string), '.', lpad(cast(mcc % 100 as string), 2, '0'))
         end as MonthlyCharges,
    case when ten = 0 then ' ' when k % 89 = 0 then null
         else concat(cast(cast(floor(mcc * ten / 100) as bigint) as string), '.', lpad(cast((mcc * ten) % 100 as string), 2, '0'))
         end as TotalCharges,
    nat as City, reg as State, cast(90000 + k as string) as ZipCode,
    cast(churn as int) as ChurnValue, cast((k * 37) % 101 as int) as ChurnScore, cltv as CLTV,
    case when churn = 1 and k % 2 = 0 then 'Competitor offer' when churn = 1 then 'Price' else null end as ChurnReason
  from b)
select k * 2 as row_no, a.* from a
union all
select k * 2 + 1 as row_no, a.* from a where k % 50 = 0
"""


def accounts_sql(table_ref=lambda name: name) -> str:
    """The F7 text with each table placeholder replaced by ``table_ref(name)``."""
    return ACCOUNTS_SQL_TEMPLATE.format(**{t: table_ref(t) for t in ("orders", "customer", "nation", "region")})


_UNION_TAIL = """select k * 2 as row_no, a.* from a
union all
select k * 2 + 1 as row_no, a.* from a where k % 50 = 0"""


def accounts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriber rows (raw text cells, dirty on purpose) with ``row_no`` input order.

    Same rows as the F7 text, but the duplicated rows come from one pass over
    ``a`` (explode of one or two copies) instead of a UNION ALL that would
    scan and aggregate ``orders`` twice.
    """
    from pyspark.sql import functions as F
    dfs = {t: read_table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")}
    body = ACCOUNTS_SQL_TEMPLATE.replace(_UNION_TAIL, "select * from a")
    assert body != ACCOUNTS_SQL_TEMPLATE
    a = spark.sql(body, **dfs)
    copies = F.when(F.col("k") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = a.select(F.explode(copies).alias("__copy"), "*")
    return out.select((F.col("k") * 2 + F.col("__copy")).alias("row_no"), *a.columns)
