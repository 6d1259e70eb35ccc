"""Fixed values.

Everything below is a FIXED VALUE that must equal the original application's
contract for results to agree: column names, alias spellings, defaults,
category levels, thresholds and the exact recommendation texts. They are kept
together, in their natural order, as plain text.
"""

from __future__ import annotations

# --- FIXED VALUES: scoring input schema -------------------------------------

RAW_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
    "MonthlyCharges", "TotalCharges",
]
REQUIRED_COLUMNS = [c for c in RAW_COLUMNS if c != "customerID"]

# Legacy (spaces) and SQL (underscores) spellings -> canonical names.
ALIASES = {
    "CustomerID": "customerID", "Customer ID": "customerID",
    "Gender": "gender", "Senior Citizen": "SeniorCitizen",
    "Tenure Months": "tenure", "Phone Service": "PhoneService",
    "Multiple Lines": "MultipleLines", "Internet Service": "InternetService",
    "Online Security": "OnlineSecurity", "Online Backup": "OnlineBackup",
    "Device Protection": "DeviceProtection", "Tech Support": "TechSupport",
    "Streaming TV": "StreamingTV", "Streaming Movies": "StreamingMovies",
    "Paperless Billing": "PaperlessBilling", "Payment Method": "PaymentMethod",
    "Monthly Charges": "MonthlyCharges", "Total Charges": "TotalCharges",
}
# The SQL spelling differs from the legacy one only by "_" for " ".
ALIASES.update({k.replace(" ", "_"): v for k, v in list(ALIASES.items()) if " " in k})

YES_NO_COLUMNS = ["Partner", "Dependents", "PhoneService", "PaperlessBilling"]

CATEGORY_DEFAULTS = {
    "gender": "Female", "MultipleLines": "No", "InternetService": "No",
    "OnlineSecurity": "No internet service", "OnlineBackup": "No internet service",
    "DeviceProtection": "No internet service", "TechSupport": "No internet service",
    "StreamingTV": "No internet service", "StreamingMovies": "No internet service",
    "Contract": "Month-to-month", "PaymentMethod": "Mailed check",
}

MONTHLY_FALLBACK = 65.0          # used when no MonthlyCharges value parses
TENURE_MAX = 100

# Tokens pandas' CSV reader treats as missing (its documented default list).
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- FIXED VALUES: 30-column feature frame, in model order ------------------

NUMERIC_FEATURES = [
    ("Tenure Months", "tenure"),
    ("Monthly Charges", "MonthlyCharges"),
    ("Total Charges", "TotalCharges"),
]
# (feature, source column, value that sets the flag)
FLAG_FEATURES = [
    ("Gender_Male", "gender", "Male"),
    ("Senior Citizen_Yes", "SeniorCitizen", 1),
    ("Partner_Yes", "Partner", "Yes"),
    ("Dependents_Yes", "Dependents", "Yes"),
    ("Phone Service_Yes", "PhoneService", "Yes"),
    ("Multiple Lines_No phone service", "MultipleLines", "No phone service"),
    ("Multiple Lines_Yes", "MultipleLines", "Yes"),
    ("Internet Service_Fiber optic", "InternetService", "Fiber optic"),
    ("Internet Service_No", "InternetService", "No"),
    ("Online Security_No internet service", "OnlineSecurity", "No internet service"),
    ("Online Security_Yes", "OnlineSecurity", "Yes"),
    ("Online Backup_No internet service", "OnlineBackup", "No internet service"),
    ("Online Backup_Yes", "OnlineBackup", "Yes"),
    ("Device Protection_No internet service", "DeviceProtection", "No internet service"),
    ("Device Protection_Yes", "DeviceProtection", "Yes"),
    ("Tech Support_No internet service", "TechSupport", "No internet service"),
    ("Tech Support_Yes", "TechSupport", "Yes"),
    ("Streaming TV_No internet service", "StreamingTV", "No internet service"),
    ("Streaming TV_Yes", "StreamingTV", "Yes"),
    ("Streaming Movies_No internet service", "StreamingMovies", "No internet service"),
    ("Streaming Movies_Yes", "StreamingMovies", "Yes"),
    ("Contract_One year", "Contract", "One year"),
    ("Contract_Two year", "Contract", "Two year"),
    ("Paperless Billing_Yes", "PaperlessBilling", "Yes"),
    ("Payment Method_Credit card (automatic)", "PaymentMethod", "Credit card (automatic)"),
    ("Payment Method_Electronic check", "PaymentMethod", "Electronic check"),
    ("Payment Method_Mailed check", "PaymentMethod", "Mailed check"),
]
FEATURE_COLUMNS = [f for f, _ in NUMERIC_FEATURES] + [f for f, _, _ in FLAG_FEATURES]

# Features whose attribution counts as a driver even when the value is not 1.
DRIVER_NUMERIC = ["Tenure Months", "Monthly Charges", "Total Charges", "Senior Citizen_Yes"]

# Readable driver names; anything else: "_" -> " ".
DRIVER_NAMES = {
    "Tenure Months": "Short account tenure",
    "Monthly Charges": "High monthly charges",
    "Total Charges": "Total charges pattern",
    "Contract_One year": "One-year contract",
    "Contract_Two year": "Two-year contract",
    "Internet Service_Fiber optic": "Fiber optic internet service",
    "Internet Service_No": "No internet service",
    "Payment Method_Electronic check": "Electronic check payment method",
    "Paperless Billing_Yes": "Paperless billing",
    "Tech Support_Yes": "Has tech support",
    "Online Security_Yes": "Has online security",
    "Senior Citizen_Yes": "Senior citizen status",
}

# --- FIXED VALUES: risk scales ---------------------------------------------

RISK_HIGH, RISK_MEDIUM, RISK_LOW = "High Risk", "Medium Risk", "Low Risk"
# preset name -> (medium lower bound, high lower bound)
RISK_PRESETS = {
    "console": (0.30, 0.60),    # < 0.30 Low, < 0.60 Medium, else High
    "campaign": (0.50, 0.80),   # >= 0.80 High, >= 0.50 Medium, else Low
}
CHURN_CUTOFF = 0.5
LABEL_CHURN, LABEL_STAY = "Likely to Churn", "Likely to Stay"

# --- FIXED VALUES: campaign recommendations (first match wins) --------------

REC_HIGH_DISCOUNT = "Offer 15% Discount"
REC_HIGH_WELCOME = "Welcome Retention Package"
REC_HIGH_SECURITY = "Free Online Security"
REC_HIGH_SUPPORT = "Free Premium Support"
REC_HIGH_CONTRACT = "Promote Long-Term Contract"
REC_HIGH_CALL = "Personal Retention Call"
REC_MED_DISCOUNT = "5% Discount Offer"
REC_MED_SECURITY = "Security Upgrade Offer"
REC_MED_LOYALTY = "Loyalty Reward Program"
REC_LOW_VIP = "VIP Customer Benefits"
REC_LOW_STANDARD = "Standard Customer Engagement"
CAMPAIGN_HIGH_CHARGE = 80
CAMPAIGN_NEW_TENURE = 12
CAMPAIGN_VIP_CLTV = 5000

# Segment -> action table.
SEGMENT_ACTIONS = [
    ("High Risk", "Immediate Retention Call"),
    ("Medium Risk", "Offer Discount / Promotion"),
    ("Low Risk", "Regular Monitoring"),
]

# --- FIXED VALUES: console retention plan, in output order ------------------

PLAN_CONTRACT = ("Offer an incentive to switch from a month-to-month plan to a 1- or 2-year contract "
                 "(e.g. a discounted rate for committing longer-term).")
PLAN_PRICING = ("Review pricing -- this customer's monthly bill is high; consider a loyalty discount "
                "or a right-sized plan to reduce bill shock.")
PLAN_SUPPORT = "Proactively offer a free trial of Tech Support -- customers without it churn more often."
PLAN_SECURITY = "Bundle in an Online Security add-on at a promotional rate to increase stickiness."
PLAN_LOYAL = ("This is a long-tenured customer showing high churn risk -- escalate to a loyalty "
              "retention specialist with a personalized win-back offer.")
PLAN_FIBER = ("Fiber customer paying a premium and at high risk -- schedule a personalized "
              "service/pricing review call before the next billing cycle.")
PLAN_AUTOPAY = ("Encourage a switch to automatic payment (credit card / bank transfer) -- "
                "electronic-check customers show a higher churn tendency in this segment.")
PLAN_DIGITAL = ("Send a personalized retention email/SMS (this customer is opted into paperless "
                "communication, making digital outreach the most effective channel).")
PLAN_PRIORITY = ("Multiple service and pricing risk factors detected -- route this account to "
                 "priority customer support for a full account review.")
PLAN_LOW_FALLBACK = ("No urgent action needed -- continue standard engagement and periodic "
                     "satisfaction check-ins to maintain loyalty.")
PLAN_OTHER_FALLBACK = ("Monitor this account closely and consider a general satisfaction survey "
                       "to catch emerging dissatisfaction early.")
PLAN_MAX_ITEMS = 4
PLAN_PRIORITY_ISSUES = 3
PLAN_HIGH_CHARGE = 80
PLAN_FIBER_CHARGE = 85
PLAN_LOYAL_TENURE = 24

# --- FIXED VALUES: console limits -------------------------------------------

TOP_N_WITH_DRIVERS = 10
MAX_DISPLAY_ROWS = 150
TOP_DRIVERS = 4
ALLOWED_EXTENSIONS = ("csv",)

# --- Own parameters (not taken from the original) ----------------------------

# Report files written by bulk runs are named PREFIX + run id + ".csv".
REPORT_PREFIX = "churn_predictions_"

# Scorecard (I13): a fixed logistic model so that scoring is checkable in SQL.
# Own coefficients, chosen to give a realistic spread of churn probabilities.
SCORECARD_INTERCEPT = -1.1
SCORECARD_WEIGHTS = {
    "Tenure Months": -0.045,
    "Monthly Charges": 0.018,
    "Total Charges": -0.0002,
    "Gender_Male": 0.02,
    "Senior Citizen_Yes": 0.35,
    "Partner_Yes": -0.15,
    "Dependents_Yes": -0.25,
    "Phone Service_Yes": -0.3,
    "Multiple Lines_No phone service": 0.1,
    "Multiple Lines_Yes": 0.2,
    "Internet Service_Fiber optic": 0.9,
    "Internet Service_No": -0.8,
    "Online Security_No internet service": -0.1,
    "Online Security_Yes": -0.45,
    "Online Backup_No internet service": -0.1,
    "Online Backup_Yes": -0.2,
    "Device Protection_No internet service": -0.1,
    "Device Protection_Yes": -0.05,
    "Tech Support_No internet service": -0.1,
    "Tech Support_Yes": -0.4,
    "Streaming TV_No internet service": -0.1,
    "Streaming TV_Yes": 0.15,
    "Streaming Movies_No internet service": -0.1,
    "Streaming Movies_Yes": 0.15,
    "Contract_One year": -0.9,
    "Contract_Two year": -1.7,
    "Paperless Billing_Yes": 0.35,
    "Payment Method_Credit card (automatic)": -0.1,
    "Payment Method_Electronic check": 0.45,
    "Payment Method_Mailed check": -0.05,
}
PROB_DECIMALS = 6
