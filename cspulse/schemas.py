"""Declared schemas of the two analysis tables and the optional baseline.

Kept in one place: the activity table's DDL is not published, so its types
are inferred (integers for counts and 0-100 scores, nullable NPS).
"""

from pyspark.sql import types as T

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.IntegerType(), False),
    T.StructField("company_name", T.StringType(), True),
    T.StructField("signup_date", T.DateType(), True),
    T.StructField("plan_type", T.StringType(), True),
    T.StructField("industry", T.StringType(), True),
    T.StructField("account_owner", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("mrr", T.DecimalType(10, 2), True),
])

ACTIVITY = T.StructType([
    T.StructField("activity_id", T.LongType(), False),
    T.StructField("customer_id", T.IntegerType(), False),
    T.StructField("activity_date", T.DateType(), False),
    T.StructField("logins_count", T.IntegerType(), True),
    T.StructField("feature_usage_score", T.IntegerType(), True),
    T.StructField("support_tickets_opened", T.IntegerType(), True),
    T.StructField("nps_score", T.IntegerType(), True),
])

# Optional snapshot of each customer's plan and MRR at signup, used by the
# cohort analysis to compare "starting" against "current" state.
BASELINE = T.StructType([
    T.StructField("customer_id", T.IntegerType(), False),
    T.StructField("starting_plan", T.StringType(), True),
    T.StructField("starting_mrr", T.DecimalType(10, 2), True),
])

CUSTOMER_COLUMNS = [f.name for f in CUSTOMERS.fields]
ACTIVITY_COLUMNS = [f.name for f in ACTIVITY.fields]
