"""Business aggregates: KPI row, churn rate, contract views.

All are single aggregations with map-side partial aggregation; grouped ones
shuffle only (key, partial state) pairs, so the shuffle is bounded by the
number of distinct keys per partition, not by rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.functions.numeric import half_even


def row_count(df: DataFrame, alias: str = "TotalRecords") -> DataFrame:
    """``COUNT(*)``."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def churn_counts(df: DataFrame, label: str = "ChurnValue") -> DataFrame:
    """Churned and not-churned counts."""
    return df.agg(F.count_if(F.col(label) == 1).alias("ChurnedCustomers"),
                  F.count_if(F.col(label) == 0).alias("NotChurnedCustomers"))


def churn_rate(df: DataFrame, label: str = "ChurnValue", decimals: int = 2) -> DataFrame:
    """Churned share in percent, in one pass (no scalar subquery).

    SQL Server ROUND is half away from zero, which is Spark ``round``.
    """
    rate = F.try_divide(F.count_if(F.col(label) == 1).cast("double") * F.lit(100.0),
                        F.count(F.lit(1)).cast("double"))
    return df.agg(F.round(rate, decimals).alias("ChurnRate"))


def customers_by_contract(df: DataFrame) -> DataFrame:
    """``GROUP BY Contract`` (null key kept, as in SQL)."""
    return df.groupBy("Contract").agg(F.count(F.lit(1)).alias("CustomerCount"))


def churn_by_contract(df: DataFrame, label: str = "ChurnValue") -> DataFrame:
    """Groups by (Contract, label value), shows a CASE label."""
    return (df.groupBy("Contract", label).agg(F.count(F.lit(1)).alias("Customers"))
            .select("Contract",
                    F.when(F.col(label) == 1, "Churned").otherwise("Not Churned").alias("ChurnStatus"),
                    "Customers")
            .orderBy("Contract"))


def kpi_row(df: DataFrame, label: str = "ChurnValue") -> DataFrame:
    """The KPI view (TotalCustomers, ChurnedCustomers, RetainedCustomers)."""
    return df.agg(
        F.count(F.lit(1)).alias("TotalCustomers"),
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("ChurnedCustomers"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("long").alias("RetainedCustomers"))


def contract_analysis(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Customers and mean monthly charge per contract."""
    return (df.groupBy("Contract")
            .agg(F.count(F.lit(1)).alias("TotalCustomers"),
                 half_even(F.avg("MonthlyCharges"), decimals).alias("AvgMonthlyCharges")))


def churn_summary_view(df: DataFrame) -> DataFrame:
    """A10/B1: the seven-column churn summary view."""
    return df.select("customerID", "gender", "tenure", "Contract", "MonthlyCharges",
                     "TotalCharges", "ChurnValue")


#: Names under which the original's reports find the accounts and its three views.
VIEWS = {"vw_ChurnSummary": churn_summary_view, "vw_KPI_Churn": kpi_row, "vw_Contract_Analysis": contract_analysis}


def create_views(accounts: DataFrame) -> list[str]:
    """A10: register the accounts table and the three business views in the
    session, so that SQL texts over these names run as they are."""
    accounts.createOrReplaceTempView("Customer_Churn_Data")
    for name, view in VIEWS.items():
        view(accounts).createOrReplaceTempView(name)
    return ["Customer_Churn_Data", *VIEWS]
