"""DuckDB SQL text that states each query independently of the Spark code.

The oracle is plain SQL over the driver's views (customer, orders, nation,
region): ``accounts_raw`` is the shared F7 text, ``cleaned`` restates the
cleaning rules in SQL, and each query adds its own SELECT. The rules are
written out here a second time on purpose: the comparison is only worth
something if the two sides do not share an implementation.
"""

from __future__ import annotations

from churnkit import constants as K
from churnkit.sources.tables import accounts_sql

NUM = r"'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


def parse(x: str) -> str:
    return f"(case when regexp_matches(trim({x}), {NUM}) then try_cast(trim({x}) as double) end)"


def dbl(v: float) -> str:
    """A double literal both engines read as the same binary value."""
    s = format(float(v), ".17g")
    return s if ("e" in s or "inf" in s or "nan" in s) else s + "e0"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


_defaults = ",\n    ".join(
    f"coalesce(nullif(trim({c}), ''), {q(d)}) as {c}" for c, d in K.CATEGORY_DEFAULTS.items())
_yesno = ",\n    ".join(
    f"case when trim({c}) in ('Yes', 'No') then trim({c}) else 'No' end as {c}" for c in K.YES_NO_COLUMNS)

CLEANED_CTE = f"""
cleaned0 as (
  select row_no, k,
    case when trim(coalesce(customerID, '')) = ''
         then 'ROW-' || cast(sum(case when trim(coalesce(customerID, '')) = '' then 1 else 0 end)
              over (order by row_no rows between unbounded preceding and current row) as varchar)
         else customerID end as customerID,
    least(greatest(cast(trunc(coalesce(
        case when trim(SeniorCitizen) = 'Yes' then 1.0e0 when trim(SeniorCitizen) = 'No' then 0.0e0
             else {parse('SeniorCitizen')} end, 0.0e0)) as integer), 0), 1) as SeniorCitizen,
    cast(trunc(least(greatest(coalesce({parse('tenure')}, 0.0e0), 0.0e0), 100.0e0)) as integer) as tenure,
    coalesce({parse('MonthlyCharges')},
             (select median({parse('MonthlyCharges')}) from accounts_raw), 65.0e0) as MonthlyCharges,
    {parse('TotalCharges')} as TotalCharges0,
    {_yesno},
    {_defaults},
    City, State, ZipCode, ChurnValue, ChurnScore, CLTV, ChurnReason
  from accounts_raw),
cleaned as (
  select * exclude (TotalCharges0),
         coalesce(TotalCharges0, tenure * MonthlyCharges) as TotalCharges
  from cleaned0)"""


def with_cleaned(select_sql: str, *extra_ctes: str) -> str:
    ctes = [f"accounts_raw as ({accounts_sql()})", CLEANED_CTE.strip(), *extra_ctes]
    return "with " + ",\n".join(ctes) + "\n" + select_sql


def with_raw(select_sql: str, *extra_ctes: str) -> str:
    ctes = [f"accounts_raw as ({accounts_sql()})", *extra_ctes]
    return "with " + ",\n".join(ctes) + "\n" + select_sql


# --- features, scorecard, console fields ----------------------------------------

def _flag_sql(src: str, value) -> str:
    v = str(value) if isinstance(value, int) else q(value)
    return f"case when {src} = {v} then 1 else 0 end"


FEATURES_CTE = "features as (\n  select *,\n    " + ",\n    ".join(
    [f"cast({src} as double) as {ident(feat)}" for feat, src in K.NUMERIC_FEATURES]
    + [f"{_flag_sql(src, v)} as {ident(feat)}" for feat, src, v in K.FLAG_FEATURES]) + "\n  from cleaned)"


def margin_sql(weights=K.SCORECARD_WEIGHTS, intercept=K.SCORECARD_INTERCEPT) -> str:
    z = dbl(intercept)
    for f in K.FEATURE_COLUMNS:
        z += f" + {dbl(weights.get(f, 0.0))} * {ident(f)}"
    return z


def rint(x: str, k: int) -> str:
    s = dbl(10.0 ** k)
    return f"(round_even(({x}) * {s}, 0) / {s})"


SCORED_CTE = (f"scored as (\n  select *, least(greatest({rint('1.0e0 / (1.0e0 + exp(-(' + margin_sql() + ')))', 6)}, "
              f"0.0e0), 1.0e0) as churn_probability\n  from features)")

_counted = [
    ("Contract = 'Month-to-month'", K.PLAN_CONTRACT),
    (f"MonthlyCharges >= {K.PLAN_HIGH_CHARGE}", K.PLAN_PRICING),
    ("TechSupport = 'No' and InternetService <> 'No'", K.PLAN_SUPPORT),
    ("OnlineSecurity = 'No' and InternetService <> 'No'", K.PLAN_SECURITY),
    (f"tenure >= {K.PLAN_LOYAL_TENURE} and churn_probability >= 0.5e0", K.PLAN_LOYAL),
    (f"InternetService = 'Fiber optic' and MonthlyCharges >= {K.PLAN_FIBER_CHARGE} and risk_level = 'High Risk'",
     K.PLAN_FIBER),
    ("PaymentMethod = 'Electronic check'", K.PLAN_AUTOPAY),
]
_items = ", ".join(f"case when {c} then {q(t)} end" for c, t in _counted) + \
    f", case when PaperlessBilling = 'Yes' and risk_level in ('Medium Risk', 'High Risk') then {q(K.PLAN_DIGITAL)} end"
_issues = " + ".join(f"(case when {c} then 1 else 0 end)" for c, _ in _counted)

CONSOLE_CTES = [
    "console0 as (select *, case when churn_probability < 0.3e0 then 'Low Risk' "
    "when churn_probability < 0.6e0 then 'Medium Risk' else 'High Risk' end as risk_level from scored)",
    f"console1 as (select *, list_concat(case when ({_issues}) >= 3 then [{q(K.PLAN_PRIORITY)}] "
    f"else []::varchar[] end, list_filter([{_items}], lambda x: x is not null)) as plan0 from console0)",
    f"console as (select * exclude (plan0), (case when len(plan0) = 0 then "
    f"[case when risk_level = 'Low Risk' then {q(K.PLAN_LOW_FALLBACK)} else {q(K.PLAN_OTHER_FALLBACK)} end] "
    f"else plan0 end)[1:4] as plan from console1)",
]

RESULTS_CTE = f"""results as (
  select row_no, customerID as "Customer ID", {rint('churn_probability * 100.0e0', 1)} as "Churn Probability",
         case when churn_probability >= 0.5e0 then 'Likely to Churn' else 'Likely to Stay' end as "Prediction",
         risk_level as "Risk Level", {rint('MonthlyCharges', 2)} as "Monthly Charges", tenure as "Tenure",
         Contract as "Contract", coalesce(plan[1], 'Monitor account.') as "Recommendation"
  from console)"""

_camp_rec = f"""case when Risk_Segment = 'High Risk' then
      case when "Monthly Charges" > {K.CAMPAIGN_HIGH_CHARGE} then {q(K.REC_HIGH_DISCOUNT)}
           when "Tenure Months" < {K.CAMPAIGN_NEW_TENURE} then {q(K.REC_HIGH_WELCOME)}
           when "Online Security_Yes" = 0 then {q(K.REC_HIGH_SECURITY)}
           when "Tech Support_Yes" = 0 then {q(K.REC_HIGH_SUPPORT)}
           when "Contract_One year" = 0 and "Contract_Two year" = 0 then {q(K.REC_HIGH_CONTRACT)}
           else {q(K.REC_HIGH_CALL)} end
    when Risk_Segment = 'Medium Risk' then
      case when "Monthly Charges" > {K.CAMPAIGN_HIGH_CHARGE} then {q(K.REC_MED_DISCOUNT)}
           when "Online Security_Yes" = 0 then {q(K.REC_MED_SECURITY)}
           else {q(K.REC_MED_LOYALTY)} end
    else case when CLTV > {K.CAMPAIGN_VIP_CLTV} then {q(K.REC_LOW_VIP)} else {q(K.REC_LOW_STANDARD)} end end"""

CAMPAIGN_CTES = [
    "campaign0 as (select * exclude (churn_probability), churn_probability as Churn_Probability, "
    "case when churn_probability >= 0.8e0 "
    "then 'High Risk' when churn_probability >= 0.5e0 then 'Medium Risk' else 'Low Risk' end as Risk_Segment "
    "from scored)",
    f"campaign as (select *, {_camp_rec} as Retention_Recommendation, \"Monthly Charges\" * 12.0e0 "
    f"as Potential_Revenue_Saved from campaign0)",
]


def with_scored(select_sql: str, *extra: str) -> str:
    return with_cleaned(select_sql, FEATURES_CTE, SCORED_CTE, *extra)


def with_console(select_sql: str, *extra: str) -> str:
    return with_scored(select_sql, *CONSOLE_CTES, *extra)


def with_results(select_sql: str, *extra: str) -> str:
    return with_console(select_sql, RESULTS_CTE, *extra)


def with_campaign(select_sql: str, *extra: str) -> str:
    return with_scored(select_sql, *CAMPAIGN_CTES, *extra)
