"""DuckDB SQL that gives the same rows as the registered queries.

Ratios are rounded in whole numbers, halves up, as in retentia.functions.exact.
"""


def _pct(part, whole):
    return f"(20000 * ({part}) + ({whole})) // (2 * ({whole})) / 100.0"


def _avg(total, n):
    """total and n whole numbers; two decimals."""
    return f"(200 * ({total}) + ({n})) // (2 * ({n})) / 100.0"


def _cent_avg(cents, n):
    return f"(2 * ({cents}) + ({n})) // (2 * ({n})) / 100.0"


def _cents(col):
    return f"CAST(round({col} * 100) AS BIGINT)"


def _months(a, b):
    return f"((year({b}) - year({a})) * 12 + month({b}) - month({a}))"


N = "count(*)"
LOST = "CAST(sum(Churn) AS BIGINT)"
CHARGES = f"CAST(sum({_cents('MonthlyCharges')}) AS BIGINT)"
RATE = _pct(LOST, N)
AVG_CHARGE = _cent_avg(CHARGES, N)

_PLACES = """
place AS (
  SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

_CUSTOMERS = f"""
prof AS (
  SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS tot
  FROM orders GROUP BY o_custkey
),
pay AS (
  SELECT o_custkey, o_orderpriority AS pm
  FROM (SELECT o_custkey, o_orderpriority,
               row_number() OVER (PARTITION BY o_custkey
                                  ORDER BY count(*) DESC, o_orderpriority) AS rn
        FROM orders GROUP BY o_custkey, o_orderpriority)
  WHERE rn = 1
),
{_PLACES},
raw AS (
  SELECT c_custkey AS customerID, CAST(c_acctbal < 0 AS INTEGER) AS SeniorCitizen,
         CAST(coalesce({_months('a', 'b')}, 0) AS INTEGER) AS tenure,
         r_name AS InternetService, c_mktsegment AS Contract, pm AS PaymentMethod,
         coalesce(CAST(tot * 100 AS BIGINT), 0) AS cents,
         coalesce(CAST(tot AS VARCHAR), ' ') AS TotalText,
         CASE WHEN b IS NULL OR b < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY
              THEN 'Yes' ELSE 'No' END AS ChurnText
  FROM customer
  LEFT JOIN prof ON c_custkey = prof.o_custkey
  LEFT JOIN pay ON c_custkey = pay.o_custkey
  LEFT JOIN place ON c_nationkey = n_nationkey
),
rawc AS (
  SELECT *, {_cent_avg('cents', 'greatest(tenure, 1)')} AS MonthlyCharges FROM raw
),
cust AS (
  SELECT customerID, SeniorCitizen, tenure, InternetService, Contract, PaymentMethod,
         MonthlyCharges, CAST(TotalText AS DOUBLE) AS TotalCharges,
         CAST(ChurnText = 'Yes' AS INTEGER) AS Churn
  FROM rawc WHERE trim(TotalText) <> ''
)"""

_FACTS = f"""
tx AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customerID,
         CAST({_months('f', 'o_orderdate')} + 1 AS INTEGER) AS month_num,
         o_totalprice AS amount, o_orderpriority AS payment_method,
         CAST(o_orderstatus = 'F' AS INTEGER) AS paid_on_time
  FROM (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS f FROM orders)
),
tick AS (
  SELECT event_id AS ticket_id, user_id AS customerID, event_type AS category,
         CAST(value < 50 AS INTEGER) AS resolved,
         CAST(1 + least(4, floor(value / 50)) AS INTEGER) AS rating
  FROM events WHERE event_type IN ('error', 'click')
),
seg AS (
  SELECT Contract, InternetService, {N} AS total_customers, {LOST} AS churned,
         {AVG_CHARGE} AS avg_monthly, {_avg('CAST(sum(tenure) AS BIGINT)', N)} AS avg_tenure
  FROM cust GROUP BY Contract, InternetService
)"""

_SCORES = """
sc AS (
  SELECT customerID, Churn AS label, greatest(0, 100 - tenure) / 100.0 AS score,
         CAST(greatest(0, 100 - tenure) / 100.0 >= 0.5 AS INTEGER) AS pred
  FROM cust
)"""

_CELLS = """
cells AS (
  SELECT count(*) FILTER (label = 0 AND pred = 0) AS n00,
         count(*) FILTER (label = 0 AND pred = 1) AS n01,
         count(*) FILTER (label = 1 AND pred = 0) AS n10,
         count(*) FILTER (label = 1 AND pred = 1) AS n11
  FROM sc
),
rates AS (
  SELECT *, n00 + n01 AS s0, n10 + n11 AS s1, n00 + n01 + n10 + n11 AS s,
         coalesce(n00 / nullif(n00 + n10, 0), 0.0) AS p0,
         coalesce(n11 / nullif(n11 + n01, 0), 0.0) AS p1,
         coalesce(n00 / nullif(n00 + n01, 0), 0.0) AS r0,
         coalesce(n11 / nullif(n11 + n10, 0), 0.0) AS r1
  FROM cells
),
fs AS (
  SELECT *, coalesce(2.0 * p0 * r0 / nullif(p0 + r0, 0), 0.0) AS f0,
         coalesce(2.0 * p1 * r1 / nullif(p1 + r1, 0), 0.0) AS f1
  FROM rates
),
report AS (
  SELECT 'Retained' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM fs
  UNION ALL SELECT 'Churned', p1, r1, f1, s1 FROM fs
  UNION ALL SELECT 'accuracy', NULL, NULL, (n00 + n11) / s, s FROM fs
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2.0, (r0 + r1) / 2.0, (f0 + f1) / 2.0, s FROM fs
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / s, (r0 * s0 + r1 * s1) / s,
                   (f0 * s0 + f1 * s1) / s, s FROM fs
)"""

_ROC = """
steps AS (
  SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM sc GROUP BY score
),
runs AS (
  SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn,
         sum(pos) OVER () AS ap, sum(neg) OVER () AS an,
         lead(pos) OVER (ORDER BY score DESC) AS np, lead(neg) OVER (ORDER BY score DESC) AS nn,
         row_number() OVER (ORDER BY score DESC) AS rn
  FROM steps
),
area AS (
  SELECT CAST(sum(neg * (2 * (cp - pos) + pos)) AS DOUBLE)
         / CAST(max(2 * ap * an) AS DOUBLE) AS roc_auc
  FROM runs
)"""

_START = "SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr"
_POINT = "SELECT score AS threshold, cn / an AS fpr, cp / ap AS tpr FROM runs"

_TRAINING = f"""
cut AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS c FROM orders),
before AS (SELECT orders.* FROM orders, cut WHERE o_orderdate < c),
prof AS (
  SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b, count(*) AS n,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS tot
  FROM before GROUP BY o_custkey
),
pay AS (
  SELECT o_custkey, o_orderpriority AS pm
  FROM (SELECT o_custkey, o_orderpriority,
               row_number() OVER (PARTITION BY o_custkey
                                  ORDER BY count(*) DESC, o_orderpriority) AS rn
        FROM before GROUP BY o_custkey, o_orderpriority)
  WHERE rn = 1
),
later AS (SELECT DISTINCT o_custkey FROM orders, cut WHERE o_orderdate >= c),
{_PLACES},
base AS (
  SELECT c_custkey AS customerID, CAST(c_acctbal < 0 AS INTEGER) AS SeniorCitizen,
         CAST({_months('a', 'b')} AS INTEGER) AS tenure, CAST(tot AS DOUBLE) AS TotalCharges,
         CAST(tot * 100 AS BIGINT) AS cents, n AS n_orders,
         CAST(date_diff('day', CAST(b AS DATE), CAST(c AS DATE)) AS INTEGER) AS recency,
         r_name AS InternetService, c_mktsegment AS Contract, pm AS PaymentMethod,
         CAST(later.o_custkey IS NULL AS INTEGER) AS Churn
  FROM prof CROSS JOIN cut
  JOIN customer ON c_custkey = prof.o_custkey
  JOIN pay ON pay.o_custkey = prof.o_custkey
  LEFT JOIN later ON later.o_custkey = prof.o_custkey
  LEFT JOIN place ON c_nationkey = n_nationkey
)"""


def _on_customers(select):
    return f"WITH {_CUSTOMERS}\n{select}"


def _on_tables(select):
    return f"WITH {_CUSTOMERS},{_FACTS}\n{select}"


def _on_scores(select, *more):
    return "WITH " + ",".join([_CUSTOMERS, _SCORES, *more]) + f"\n{select}"


_RAW_RATE = "CAST(sum(Churn) AS DOUBLE) / CAST(count(Churn) AS DOUBLE)"

_KPI = f"""
SELECT {N} AS total_customers, {LOST} AS churned, {N} - {LOST} AS retained,
       {RATE} AS churn_rate_pct, {AVG_CHARGE} AS avg_monthly,
       CAST(sum({_cents('MonthlyCharges')}) FILTER (Churn = 1) AS BIGINT) / 100.0 AS revenue_at_risk
FROM cust"""

_SPINE = "SELECT customerID, Contract, tenure, unnest(range(1, greatest(tenure, 1) + 1)) AS m FROM cust"

_COUNTS = f"""
SELECT 'customers' AS table_name, {N} AS n_rows FROM cust
UNION ALL SELECT 'transactions', {N} FROM tx
UNION ALL SELECT 'support_tickets', {N} FROM tick
UNION ALL SELECT 'segment_summary', {N} FROM seg"""


def _z(col):
    dev = f"stddev_pop({col}) OVER ()"
    return (f"coalesce(round(({col} - avg({col}) OVER ()) / nullif({dev}, 0), 6), 0.0) AS {col}")


ORACLES = {
    "customers": _on_customers("SELECT * FROM cust"),
    "clean_customers": _on_customers(
        "SELECT customerID, TotalCharges, Churn, SeniorCitizen FROM cust"),
    "transactions": _on_tables("SELECT * FROM tx"),
    "support_tickets": _on_tables("SELECT * FROM tick"),
    "segment_summary": _on_tables("SELECT * FROM seg"),
    "training": f"""WITH {_TRAINING}
SELECT customerID, SeniorCitizen, tenure, {_cent_avg('cents', 'greatest(tenure, 1)')} AS MonthlyCharges,
       TotalCharges, n_orders, recency, InternetService, Contract, PaymentMethod, Churn
FROM base""",
    "csv_ingest": _on_customers(
        "SELECT * REPLACE (CAST(customerID AS VARCHAR) AS customerID) FROM cust"),
    "table_roundtrip": _on_tables(_COUNTS),
    "row_count_report": _on_tables(_COUNTS),
    "score_requests": _on_customers("""
SELECT customerID, SeniorCitizen, tenure, MonthlyCharges,
       CASE WHEN trim(TotalText) = '' THEN tenure * MonthlyCharges
            ELSE CAST(TotalText AS DOUBLE) END AS TotalCharges,
       'Male' AS gender, 'No' AS Partner, 'No' AS Dependents, 'Yes' AS PhoneService,
       'Fiber optic' AS InternetService, Contract, 'Yes' AS PaperlessBilling,
       'Electronic check' AS PaymentMethod
FROM (SELECT * REPLACE (nullif(TotalText, '') AS TotalText) FROM rawc)"""),
    "billing_month_spine": _on_customers(
        f"SELECT customerID, Contract, CAST(m AS INTEGER) AS month_num FROM ({_SPINE})"),
    "spine_fill": _on_tables(f"""
SELECT s.customerID, s.tenure, CAST(m AS INTEGER) AS month_num,
       coalesce(CAST(paid AS DOUBLE), 0.0) AS amount
FROM (
  SELECT c.customerID, tenure, unnest(range(1, greatest(tenure, 1, coalesce(last, 1)) + 1)) AS m
  FROM cust c LEFT JOIN (SELECT customerID, max(month_num) AS last FROM tx GROUP BY customerID) t
    ON c.customerID = t.customerID
) s LEFT JOIN (
  SELECT customerID, month_num, sum(CAST(amount AS DECIMAL(18,2))) AS paid
  FROM tx GROUP BY customerID, month_num
) p ON s.customerID = p.customerID AND s.m = p.month_num"""),
    "churn_rate_overall": _on_customers(
        f"SELECT {N} AS total_customers, {LOST} AS churned, {RATE} AS churn_rate_pct FROM cust"),
    "churn_by_contract": _on_customers(f"""
SELECT Contract, {N} AS total, {LOST} AS churned, {RATE} AS churn_pct,
       {AVG_CHARGE} AS avg_monthly_charge
FROM cust GROUP BY Contract ORDER BY churn_pct DESC, Contract"""),
    "revenue_at_risk_by_service": _on_customers(f"""
SELECT InternetService, {N} AS churned_customers, {CHARGES} / 100.0 AS monthly_revenue_lost,
       {AVG_CHARGE} AS avg_charge
FROM cust WHERE Churn = 1 GROUP BY InternetService ORDER BY monthly_revenue_lost DESC"""),
    "top_risk_customers": _on_customers("""
SELECT customerID, Contract, InternetService, tenure, MonthlyCharges, TotalCharges
FROM cust WHERE Churn = 1 ORDER BY MonthlyCharges DESC, customerID LIMIT 10"""),
    "churn_by_payment": _on_customers(f"""
SELECT PaymentMethod, {N} AS total, {LOST} AS churned, {RATE} AS churn_pct
FROM cust GROUP BY PaymentMethod ORDER BY churn_pct DESC"""),
    "tenure_cohorts": _on_customers(f"""
SELECT CASE WHEN tenure >= 0 AND tenure <= 12 THEN '0-12 months (New)'
            WHEN tenure >= 13 AND tenure <= 24 THEN '13-24 months'
            WHEN tenure >= 25 AND tenure <= 48 THEN '25-48 months'
            ELSE '48+ months (Loyal)' END AS tenure_cohort,
       {N} AS total, {LOST} AS churned, {RATE} AS churn_pct, {AVG_CHARGE} AS avg_charge
FROM cust GROUP BY 1 ORDER BY churn_pct DESC"""),
    "senior_segments": _on_customers(f"""
SELECT CASE SeniorCitizen WHEN 1 THEN 'Senior' ELSE 'Non-Senior' END AS segment,
       {N} AS total, {LOST} AS churned, {RATE} AS churn_pct, {AVG_CHARGE} AS avg_monthly
FROM cust GROUP BY SeniorCitizen"""),
    "tickets_vs_churn": _on_tables(f"""
SELECT c.customerID, c.Churn, c.Contract, count(t.ticket_id) AS num_tickets,
       {_avg('CAST(sum(t.rating) AS BIGINT)', 'nullif(count(t.rating), 0)')} AS avg_rating
FROM cust c LEFT JOIN tick t ON c.customerID = t.customerID
GROUP BY c.customerID, c.Churn, c.Contract
ORDER BY num_tickets DESC, c.customerID LIMIT 20"""),
    "segment_report": _on_tables(f"""
SELECT Contract, InternetService, total_customers, churned,
       {_pct('churned', 'total_customers')} AS churn_pct, avg_monthly, avg_tenure
FROM seg ORDER BY churn_pct DESC"""),
    "transactions_by_churn": _on_tables(f"""
SELECT c.Churn, count(DISTINCT c.customerID) AS customers, count(t.transaction_id) AS total_transactions,
       {_cent_avg(f"CAST(sum({_cents('t.amount')}) AS BIGINT)", 'count(t.amount)')} AS avg_txn_amount,
       {_pct('count(*) FILTER (t.paid_on_time = 0)', 'count(t.transaction_id)')} AS late_payment_pct
FROM cust c JOIN tx t ON c.customerID = t.customerID GROUP BY c.Churn"""),
    "adhoc_sql": _on_tables("""
SELECT c.Contract, t.category, count(*) AS tickets, CAST(sum(t.resolved) AS BIGINT) AS resolved
FROM cust c JOIN tick t ON c.customerID = t.customerID
WHERE c.Churn = 0 GROUP BY c.Contract, t.category"""),
    "kpi_bundle": _on_customers(_KPI),
    "kpi_by_contract": _on_customers(f"""
SELECT Contract AS contract, {N} AS total, {RATE} AS churn_pct
FROM cust GROUP BY Contract ORDER BY 3 DESC"""),
    "kpi_record": _on_customers(f"""
SELECT k.*, CAST(row_number() OVER (ORDER BY churn_pct DESC, contract) - 1 AS INTEGER) AS position,
       contract, total, churn_pct
FROM ({_KPI}) k, (SELECT Contract AS contract, {N} AS total, {RATE} AS churn_pct
                  FROM cust GROUP BY Contract)"""),
    "kpi_text": _on_customers(f"""
SELECT format('{{:,}}', total_customers) AS total_customers, format('{{:,}}', churned) AS churned,
       format('{{:,}}', retained) AS retained, CAST(churn_rate_pct AS VARCHAR) || '%' AS churn_rate,
       '$' || format('{{:,}}', CAST(round(revenue_at_risk) AS BIGINT)) AS revenue_at_risk
FROM ({_KPI})"""),
    "contract_rate_raw": _on_customers(f"""
SELECT Contract, {LOST} AS "sum", count(Churn) AS "count", {_RAW_RATE} * 100.0 AS churn_pct
FROM cust GROUP BY Contract"""),
    "rate_by_service": _on_customers(f"""
SELECT InternetService, {_RAW_RATE} * 100.0 AS churn_pct FROM cust GROUP BY InternetService"""),
    "rate_by_payment": _on_customers(f"""
SELECT PaymentMethod, {RATE} AS churn_pct
FROM cust WHERE PaymentMethod IS NOT NULL GROUP BY PaymentMethod"""),
    "share_of_total": _on_customers(f"""
SELECT *, round(churn_pct / sum(churn_pct) OVER (), 8) AS share
FROM (SELECT InternetService, {_RAW_RATE} * 100.0 AS churn_pct FROM cust GROUP BY InternetService)"""),
    "histogram_by_class": _on_customers("""
SELECT CASE Churn WHEN 0 THEN 'Retained' WHEN 1 THEN 'Churned' END AS status,
       CAST(least(39, floor((MonthlyCharges - low) / ((high - low) / 40.0))) AS INTEGER) AS bin,
       count(*) AS n
FROM (SELECT *, min(MonthlyCharges) OVER () AS low, max(MonthlyCharges) OVER () AS high FROM cust)
GROUP BY 1, 2"""),
    "sample_fixed": _on_customers("""
SELECT customerID, tenure, MonthlyCharges,
       CASE Churn WHEN 0 THEN 'Retained' WHEN 1 THEN 'Churned' END AS status
FROM cust ORDER BY md5('42:' || customerID), customerID LIMIT 1500"""),
    "preview": _on_customers("SELECT * FROM cust ORDER BY customerID LIMIT 200"),
    "stratified_split": _on_customers("""
SELECT customerID, Churn, CAST(rn <= ceil(0.2 * n) AS INTEGER) AS is_test
FROM (SELECT customerID, Churn, count(*) OVER (PARTITION BY Churn) AS n,
             row_number() OVER (PARTITION BY Churn
                                ORDER BY md5('42:' || customerID), customerID) AS rn
      FROM cust)"""),
    "hash_split": _on_customers("""
SELECT customerID, Churn,
       CAST(CAST('0x' || substr(md5('42:' || customerID), 1, 8) AS BIGINT) < 858993459 AS INTEGER) AS is_test
FROM cust"""),
    "mean_abs_attribution": _on_customers("""
SELECT * FROM (
  SELECT 'tenure' AS feature, sum(abs(tenure - 50)) / count(*) AS importance, 'rule' AS method FROM cust
  UNION ALL SELECT 'SeniorCitizen', sum(abs(SeniorCitizen - 1)) / count(*), 'rule' FROM cust
)"""),
    "label_encode": _on_customers("""
SELECT customerID,
       CAST(dense_rank() OVER (ORDER BY InternetService) - 1 AS INTEGER) AS InternetService,
       CAST(dense_rank() OVER (ORDER BY Contract) - 1 AS INTEGER) AS Contract,
       CAST(dense_rank() OVER (ORDER BY PaymentMethod) - 1 AS INTEGER) AS PaymentMethod
FROM cust"""),
    "standardise": _on_customers(f"""
SELECT customerID, {_z('SeniorCitizen')}, {_z('tenure')}, {_z('MonthlyCharges')}, {_z('TotalCharges')}
FROM cust"""),
    "accuracy": _on_scores("""
SELECT CAST(count(*) FILTER (label = pred) AS DOUBLE) / count(*) AS accuracy FROM sc"""),
    "confusion_matrix": _on_scores("""
SELECT 0 AS actual, 0 AS predicted, n00 AS n FROM cells UNION ALL SELECT 0, 1, n01 FROM cells
UNION ALL SELECT 1, 0, n10 FROM cells UNION ALL SELECT 1, 1, n11 FROM cells""", _CELLS),
    "classification_report": _on_scores("SELECT * FROM report", _CELLS),
    "roc_curve": _on_scores(f"{_START} UNION ALL {_POINT}", _ROC),
    "roc_curve_corners": _on_scores(
        f"{_START} UNION ALL {_POINT} WHERE rn = 1 OR np IS NULL OR pos <> np OR neg <> nn", _ROC),
    "roc_auc": _on_scores("SELECT roc_auc FROM area", _ROC),
    "evaluate_report": _on_scores("""
SELECT 'accuracy' AS metric, CAST(n00 + n11 AS DOUBLE) / s AS value FROM fs
UNION ALL SELECT 'roc_auc', roc_auc FROM area
UNION ALL SELECT 'actual_0_predicted_0', n00 FROM cells
UNION ALL SELECT 'actual_0_predicted_1', n01 FROM cells
UNION ALL SELECT 'actual_1_predicted_0', n10 FROM cells
UNION ALL SELECT 'actual_1_predicted_1', n11 FROM cells
UNION ALL SELECT class || ' precision', precision FROM report WHERE class <> 'accuracy'
UNION ALL SELECT class || ' recall', recall FROM report WHERE class <> 'accuracy'
UNION ALL SELECT class || ' f1', f1 FROM report WHERE class <> 'accuracy'
UNION ALL SELECT class || ' support', support FROM report WHERE class <> 'accuracy'""",
        _CELLS, _ROC),
    "log_loss": _on_scores("""
SELECT round(-avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 8) AS log_loss
FROM (SELECT label, greatest(1e-15, least(1 - 1e-15, score)) AS p FROM sc)"""),
    "risk_band": _on_scores("""
SELECT customerID, score,
       CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM sc"""),
    "threshold_class": _on_scores("SELECT customerID, score, pred FROM sc"),
    "recommendations": f"WITH {_CUSTOMERS}" + """,
fired AS (
  SELECT customerID, list_filter([
    CASE WHEN Contract = 'BUILDING'
         THEN 'Offer a discounted 1-year or 2-year contract to reduce churn risk.' END,
    CASE WHEN PaymentMethod = '1-URGENT'
         THEN 'Encourage switch to auto-pay — it significantly reduces churn.' END,
    CASE WHEN InternetService = 'EUROPE' AND tenure < 50
         THEN 'Fiber optic churners are price-sensitive — offer a loyalty discount.' END,
    CASE WHEN tenure < 12
         THEN 'New customer — enroll in an onboarding rewards program immediately.' END,
    CASE WHEN MonthlyCharges > 80
         THEN 'High spender — offer a bundled plan to improve perceived value.' END
  ], lambda x: x IS NOT NULL) AS texts
  FROM cust
), listed AS (
  SELECT customerID, CASE WHEN len(texts) = 0
    THEN ['Customer appears stable. Maintain regular engagement touchpoints.'] ELSE texts END AS texts
  FROM fired
)
SELECT customerID, CAST(i AS INTEGER) AS position, texts[i + 1] AS advice
FROM (SELECT customerID, texts, unnest(range(0, len(texts))) AS i FROM listed)""",
}

_MODEL_FEATURES = ("['SeniorCitizen', 'tenure', 'MonthlyCharges', 'TotalCharges', 'n_orders', 'recency', "
                   "'InternetService', 'Contract', 'PaymentMethod']")

_SPLIT = f"""{_TRAINING},
split AS (
  SELECT customerID, Churn, CAST(rn <= ceil(0.2 * n) AS INTEGER) AS is_test
  FROM (SELECT customerID, Churn, count(*) OVER (PARTITION BY Churn) AS n,
               row_number() OVER (PARTITION BY Churn
                                  ORDER BY md5('42:' || customerID), customerID) AS rn
        FROM base)
)"""

# What must hold between the results of a fitted model, and inputs for rarer branches.
ORACLES |= {
    "attributions_add_up": f"""WITH {_TRAINING}
SELECT customerID, CAST(len({_MODEL_FEATURES}) AS BIGINT) AS features, true AS adds_up FROM base""",
    "predictions_follow": f"""WITH {_TRAINING},
charged AS (SELECT *, {_cent_avg('cents', 'greatest(tenure, 1)')} AS MonthlyCharges FROM base)
SELECT customerID, true AS rounded, true AS class_follows, true AS band_follows,
       CASE WHEN tenure >= 12 AND MonthlyCharges <= 80
            THEN 'Customer appears stable. Maintain regular engagement touchpoints.'
            ELSE concat_ws(' | ',
              CASE WHEN tenure < 12
                   THEN 'New customer — enroll in an onboarding rewards program immediately.' END,
              CASE WHEN MonthlyCharges > 80
                   THEN 'High spender — offer a bundled plan to improve perceived value.' END)
       END AS advice
FROM charged""",
    "reloaded_agrees": f"WITH {_TRAINING} SELECT customerID, true AS same FROM base",
    "loss_rounds": """
SELECT CAST(r AS INTEGER) AS round, true AS positive, CASE WHEN r = 300 THEN true END AS final_agrees
FROM range(1, 301) t(r)""",
    "gains_sum_to_one": f"""
SELECT unnest({_MODEL_FEATURES}) AS feature, 'gain' AS method, true AS sums_to_one""",
    "importance_ranks": "SELECT CAST(r AS INTEGER) AS rank FROM range(1, 6) t(r)",
    "importance_sample": f"""WITH {_SPLIT}
SELECT customerID FROM split WHERE is_test = 0
ORDER BY md5('42:' || customerID), customerID LIMIT 500""",
    "evaluation_support": f"""WITH {_SPLIT},
sizes AS (SELECT CAST(count(*) FILTER (Churn = 0) AS DOUBLE) AS stayed,
                 CAST(count(*) FILTER (Churn = 1) AS DOUBLE) AS left_ FROM split WHERE is_test = 1)
SELECT 'Retained support' AS metric, stayed AS value FROM sizes
UNION ALL SELECT 'Churned support', left_ FROM sizes
UNION ALL SELECT 'macro avg support', stayed + left_ FROM sizes
UNION ALL SELECT 'weighted avg support', stayed + left_ FROM sizes""",
    "request_chain": f"""WITH {_TRAINING}
SELECT customerID, n_orders = 1 AS rejected, CAST(1 AS BIGINT) AS n, true AS same FROM base""",
    "clean_blanks": _on_customers("SELECT customerID, TotalCharges FROM cust WHERE tenure >= 12"),
    "label_encode_unseen": _on_customers("""
SELECT customerID, CAST(coalesce(code, 0) AS INTEGER) AS Contract
FROM cust LEFT JOIN (
  SELECT Contract AS seen, row_number() OVER (ORDER BY Contract) - 1 AS code
  FROM (SELECT DISTINCT Contract FROM cust WHERE Contract <> 'BUILDING')
) ON Contract = seen"""),
    "request_rejections": _on_customers("""
SELECT customerID, tenure < 12 AS rejected, CASE WHEN tenure < 12 THEN 12 ELSE tenure END AS tenure,
       MonthlyCharges,
       CASE WHEN tenure > 60 OR trim(TotalText) = ''
            THEN (CASE WHEN tenure < 12 THEN 12 ELSE tenure END) * MonthlyCharges
            ELSE CAST(TotalText AS DOUBLE) END AS TotalCharges
FROM (SELECT * REPLACE (nullif(TotalText, '') AS TotalText) FROM rawc)"""),
    "sample_transactions": _on_tables("""
SELECT transaction_id, customerID FROM tx
ORDER BY md5('42:' || transaction_id), transaction_id LIMIT 1500"""),
    "recommendations_scaled": ORACLES["recommendations"].replace(
        "MonthlyCharges > 80", "MonthlyCharges / 100 > 80"),
    "stored_customers": ORACLES["customers"],
    "stored_transactions": ORACLES["transactions"],
    "missing_marks_learn": f"""WITH {_SPLIT}
SELECT count(*) AS n_test, count(*) FILTER (Churn = 1 AND customerID % 10 <> 0) AS n_missing,
       true AS above_floor
FROM split WHERE is_test = 1""",
    "stream_accepted": f"""WITH {_TRAINING}
SELECT customerID, CAST(1 AS BIGINT) AS n, true AS same FROM base
WHERE n_orders <> 1 AND customerID % 7 <> 0""",
    "stream_rejected": f"""WITH {_TRAINING}
SELECT customerID, CASE WHEN n_orders = 1 THEN 'n/a' ELSE CAST(tenure AS VARCHAR) END AS tenure,
       concat_ws(', ', CASE WHEN n_orders = 1 THEN 'tenure' END,
                 CASE WHEN customerID % 7 = 0 THEN 'recency' END) AS unreadable
FROM base WHERE n_orders = 1 OR customerID % 7 = 0""",
    "label_table": _on_tables("""
SELECT class, row_number() OVER (ORDER BY class) - 1 AS code
FROM (SELECT DISTINCT CAST(customerID AS VARCHAR) AS class FROM tx)"""),
    "label_encode_table": _on_tables("""
SELECT transaction_id, coalesce(code, 0) AS customerID
FROM tx LEFT JOIN (
  SELECT seen, row_number() OVER (ORDER BY CAST(seen AS VARCHAR)) - 1 AS code
  FROM (SELECT DISTINCT customerID AS seen FROM tx WHERE paid_on_time = 1)
) ON customerID = seen"""),
    "lookup_payments": _on_tables("""
SELECT c.customerID, c.Contract, count(*) AS payments,
       CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS paid
FROM cust c JOIN tx t ON c.customerID = t.customerID GROUP BY c.customerID, c.Contract"""),
    "contract_lookup": _on_customers("""
SELECT customerID, Contract, tenure, Churn FROM cust WHERE Contract IN ('BUILDING', 'MACHINERY')"""),
    "segment_batches": _on_tables("SELECT * FROM seg"),
    "distinct_by_sketch": _on_tables("""
SELECT month_num, count(DISTINCT customerID) AS "exact", true AS within_bound FROM tx GROUP BY month_num
UNION ALL SELECT NULL, count(DISTINCT customerID), true FROM tx"""),
    "adhoc_refused": _on_customers(f"""
SELECT * FROM (VALUES ('file', true, NULL::BIGINT), ('brackets', true, NULL), ('two', true, NULL),
                      ('subquery', true, NULL), ('command', true, NULL)) v("text", refused, n)
UNION ALL SELECT 'answered', false, {N} FROM cust"""),
}
