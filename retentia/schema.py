"""Table schemas, feature lists and the fixed values results depend on."""

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# TotalCharges and Churn arrive as text and are typed by operators.clean.
RAW_CUSTOMERS = _struct(
    customerID=STRING, gender=STRING, SeniorCitizen=INT, Partner=STRING,
    Dependents=STRING, tenure=INT, PhoneService=STRING, InternetService=STRING,
    Contract=STRING, PaperlessBilling=STRING, PaymentMethod=STRING,
    MonthlyCharges=DOUBLE, TotalCharges=STRING, Churn=STRING,
)
CUSTOMERS = T.StructType(
    RAW_CUSTOMERS.fields[:-2]
    + [T.StructField("TotalCharges", DOUBLE), T.StructField("Churn", INT)]
)
TRANSACTIONS = _struct(
    customerID=STRING, month_num=INT, amount=DOUBLE, payment_method=STRING,
    paid_on_time=INT,
)
SUPPORT_TICKETS = _struct(customerID=STRING, category=STRING, resolved=INT, rating=INT)
SEGMENT_SUMMARY = _struct(
    Contract=STRING, InternetService=STRING, total_customers=LONG, churned=LONG,
    avg_monthly=DOUBLE, avg_tenure=DOUBLE,
)

TABLES = ("customers", "transactions", "support_tickets", "segment_summary")

# ---------------------------------------------------------------------------
# Results must match these exactly.
# ---------------------------------------------------------------------------

# Model inputs, numbers first; the order is the order of the feature vector.
NUMERIC_FEATURES = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
CATEGORY_FEATURES = [
    "gender", "Partner", "Dependents", "PhoneService", "InternetService",
    "Contract", "PaperlessBilling", "PaymentMethod",
]

# What a scoring request gets for a field it leaves out.
REQUEST_DEFAULTS = {
    "gender": "Male",
    "SeniorCitizen": 0,
    "Partner": "No",
    "Dependents": "No",
    "tenure": 12,
    "PhoneService": "Yes",
    "InternetService": "Fiber optic",
    "Contract": "Month-to-month",
    "PaperlessBilling": "Yes",
    "PaymentMethod": "Electronic check",
    "MonthlyCharges": 70.0,
    "TotalCharges": 840.0,
}

# Tenure cohorts: (first month, last month, label); everything else is LOYAL.
COHORTS = [
    (0, 12, "0-12 months (New)"),
    (13, 24, "13-24 months"),
    (25, 48, "25-48 months"),
]
LOYAL = "48+ months (Loyal)"

# Risk bands: a probability at or above the bound gets the label.
RISK_BANDS = [(0.70, "HIGH"), (0.40, "MEDIUM")]
LOWEST_RISK = "LOW"
CLASS_THRESHOLD = 0.5

CLASS_NAMES = {0: "Retained", 1: "Churned"}

# Recommendation texts, in the order they are listed to the user.
ADVICE_CONTRACT = "Offer a discounted 1-year or 2-year contract to reduce churn risk."
ADVICE_PAYMENT = "Encourage switch to auto-pay — it significantly reduces churn."
ADVICE_FIBER = "Fiber optic churners are price-sensitive — offer a loyalty discount."
ADVICE_NEW = "New customer — enroll in an onboarding rewards program immediately."
ADVICE_SPEND = "High spender — offer a bundled plan to improve perceived value."
ADVICE_STABLE = "Customer appears stable. Maintain regular engagement touchpoints."
