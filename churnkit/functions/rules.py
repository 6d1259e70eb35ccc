"""Business rules as Catalyst expressions (inventory H1-H13).

Each function returns a Column; rows are never handed to Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.functions.numeric import half_even


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def churn_status(label="ChurnValue") -> Column:
    """H1: CASE WHEN label = 1 THEN 'Churned' ELSE 'Not Churned'."""
    return F.when(_c(label) == 1, F.lit("Churned")).otherwise(F.lit("Not Churned"))


def risk_level(p, preset: str = "console", thresholds: tuple[float, float] | None = None) -> Column:
    """H2/H3: risk band with the thresholds of a named preset.

    ``console``: < 0.30 Low, < 0.60 Medium, else High.
    ``campaign``: >= 0.80 High, >= 0.50 Medium, else Low.
    A null/NaN probability falls through the comparisons exactly as the
    original branch order does (console: High, campaign: Low).
    """
    med, high = thresholds or K.RISK_PRESETS[preset]
    p = _c(p)
    if preset == "console" and thresholds is None:
        return (F.when(p < med, F.lit(K.RISK_LOW)).when(p < high, F.lit(K.RISK_MEDIUM))
                .otherwise(F.lit(K.RISK_HIGH)))
    return (F.when(p >= high, F.lit(K.RISK_HIGH)).when(p >= med, F.lit(K.RISK_MEDIUM))
            .otherwise(F.lit(K.RISK_LOW)))


def clip_probability(p) -> Column:
    """H4."""
    return F.least(F.greatest(_c(p), F.lit(0.0)), F.lit(1.0))


def probability_percent(p, decimals: int = 1) -> Column:
    """H5: ``np.round(p * 100, 1)``."""
    return half_even(_c(p) * F.lit(100.0), decimals)


def prediction_label(p) -> Column:
    """H6: label at 0.5 on the unrounded probability."""
    return F.when(_c(p) >= K.CHURN_CUTOFF, F.lit(K.LABEL_CHURN)).otherwise(F.lit(K.LABEL_STAY))


def will_churn(p) -> Column:
    return _c(p) >= K.CHURN_CUTOFF


def signal_bars(p) -> Column:
    """H7: ``max(1, min(5, round((1 - p) * 5)))`` with half-even rounding."""
    return F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.rint((F.lit(1.0) - _c(p)) * F.lit(5.0)))).cast("int")


def campaign_recommendation(segment="Risk_Segment", monthly="Monthly Charges",
                            tenure="Tenure Months", security_yes="Online Security_Yes",
                            support_yes="Tech Support_Yes", one_year="Contract_One year",
                            two_year="Contract_Two year", cltv="CLTV") -> Column:
    """H8: first matching rule per campaign segment (11 texts)."""
    seg = _c(segment)
    high = (F.when(_c(monthly) > K.CAMPAIGN_HIGH_CHARGE, F.lit(K.REC_HIGH_DISCOUNT))
            .when(_c(tenure) < K.CAMPAIGN_NEW_TENURE, F.lit(K.REC_HIGH_WELCOME))
            .when(_c(security_yes) == 0, F.lit(K.REC_HIGH_SECURITY))
            .when(_c(support_yes) == 0, F.lit(K.REC_HIGH_SUPPORT))
            .when((_c(one_year) == 0) & (_c(two_year) == 0), F.lit(K.REC_HIGH_CONTRACT))
            .otherwise(F.lit(K.REC_HIGH_CALL)))
    medium = (F.when(_c(monthly) > K.CAMPAIGN_HIGH_CHARGE, F.lit(K.REC_MED_DISCOUNT))
              .when(_c(security_yes) == 0, F.lit(K.REC_MED_SECURITY))
              .otherwise(F.lit(K.REC_MED_LOYALTY)))
    low = F.when(_c(cltv) > K.CAMPAIGN_VIP_CLTV, F.lit(K.REC_LOW_VIP)).otherwise(F.lit(K.REC_LOW_STANDARD))
    return (F.when(seg == K.RISK_HIGH, high).when(seg == K.RISK_MEDIUM, medium).otherwise(low))


def retention_plan(p="churn_probability", risk="risk_level", contract="Contract",
                   monthly="MonthlyCharges", tenure="tenure", tech="TechSupport",
                   security="OnlineSecurity", internet="InternetService",
                   payment="PaymentMethod", paperless="PaperlessBilling") -> Column:
    """H9: the console plan, an ``array<string>`` of at most four texts.

    Seven conditions count as issues (the paperless one does not); three or
    more issues put the priority text first; an empty plan gets a fallback.
    """
    has_internet = _c(internet) != "No"
    counted = [
        (_c(contract) == "Month-to-month", K.PLAN_CONTRACT),
        (_c(monthly) >= K.PLAN_HIGH_CHARGE, K.PLAN_PRICING),
        ((_c(tech) == "No") & has_internet, K.PLAN_SUPPORT),
        ((_c(security) == "No") & has_internet, K.PLAN_SECURITY),
        ((_c(tenure) >= K.PLAN_LOYAL_TENURE) & (_c(p) >= K.CHURN_CUTOFF), K.PLAN_LOYAL),
        ((_c(internet) == "Fiber optic") & (_c(monthly) >= K.PLAN_FIBER_CHARGE)
         & (_c(risk) == K.RISK_HIGH), K.PLAN_FIBER),
        (_c(payment) == "Electronic check", K.PLAN_AUTOPAY),
    ]
    digital = (_c(paperless) == "Yes") & _c(risk).isin(K.RISK_MEDIUM, K.RISK_HIGH)
    items = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in counted],
                                    F.when(digital, F.lit(K.PLAN_DIGITAL))))
    issues = sum((F.coalesce(cond, F.lit(False)).cast("int") for cond, _ in counted), F.lit(0))
    empty = F.array().cast("array<string>")
    plan = F.concat(F.when(issues >= K.PLAN_PRIORITY_ISSUES, F.array(F.lit(K.PLAN_PRIORITY)))
                    .otherwise(empty), items)
    fallback = F.when(_c(risk) == K.RISK_LOW, F.lit(K.PLAN_LOW_FALLBACK)).otherwise(F.lit(K.PLAN_OTHER_FALLBACK))
    plan = F.when(F.size(plan) == 0, F.array(fallback)).otherwise(plan)
    return F.slice(plan, 1, K.PLAN_MAX_ITEMS)


def plan_summary(plan) -> Column:
    """The first plan text."""
    return F.coalesce(F.get(_c(plan), 0), F.lit("Monitor account."))


def revenue_saved(monthly="Monthly Charges", months: int = 12) -> Column:
    """Potential revenue saved = monthly charge x 12 (every customer)."""
    return _c(monthly) * F.lit(float(months))


def _driver_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in K.DRIVER_NAMES.items() for x in kv])


def driver_name(feature) -> Column:
    """Readable driver name; unmapped features: '_' -> ' '."""
    f = _c(feature)
    return F.coalesce(F.try_element_at(_driver_map(), f), F.replace(f, F.lit("_"), F.lit(" ")))


def service_count() -> Column:
    """H13 (own definition): Yes-valued service columns plus one for any
    internet service."""
    services = ["PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
                "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]
    n = sum((F.when(F.col(c) == "Yes", 1).otherwise(0) for c in services), F.lit(0))
    return n + F.when(F.col("InternetService") != "No", 1).otherwise(0)


def revenue_per_month(total="TotalCharges", tenure="tenure") -> Column:
    """H13 (own definition): total charges per month of tenure."""
    return F.try_divide(_c(total), _c(tenure).cast("double"))


def customer_value(monthly="MonthlyCharges", tenure="tenure") -> Column:
    """H13 (own definition): monthly charge x tenure."""
    return _c(monthly) * _c(tenure)
