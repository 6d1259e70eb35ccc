"""churnkit: customer-churn and retention analytics as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` (so ``df.transform``
composes them) built from Catalyst expressions; Python runs inside tasks only
where a built-in cannot express the rule (tree attribution).
"""

__version__ = "0.1.0"
