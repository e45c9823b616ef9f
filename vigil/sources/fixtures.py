"""Test inputs derived from the driver tables (FIXTURES.md).

Each fixture is a list of SQL expressions that run unchanged in Spark (``selectExpr``)
and in DuckDB (the oracle), so both engines see the same derived table. All fixtures
read their whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# dirty_orders: the clean ``orders`` table with injected dirt, plus exact copies of
# the rows with o_orderkey % 50 = 0 (duplicates are part of the fixture).
DIRTY_ORDERS_EXPRS = [
    "o_orderkey",
    "o_custkey",
    "CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN -1.0 * o_totalprice "
    "WHEN o_orderkey % 113 = 0 THEN 100.0 * o_totalprice ELSE o_totalprice END AS price",
    "CASE WHEN o_orderkey % 53 = 0 THEN 'n/a?' WHEN o_orderkey % 59 = 0 THEN NULL "
    "ELSE CAST(CAST(floor(o_totalprice) AS bigint) AS string) END AS price_txt",
    "CASE WHEN o_orderkey % 37 = 0 THEN 'X' WHEN o_orderkey % 43 = 0 THEN NULL ELSE o_orderstatus END AS status",
    "CASE WHEN o_orderkey % 61 = 0 THEN '2024-13-01' WHEN o_orderkey % 67 = 0 THEN '01/05/1998' "
    "WHEN o_orderkey % 71 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS date) AS string) END AS date_txt",
    "CASE WHEN o_orderkey % 73 = 0 THEN 'not-an-email' "
    "ELSE concat('user', CAST(o_custkey AS string), '@example.com') END AS email",
    "CASE WHEN o_orderkey % 79 = 0 THEN CAST('Infinity' AS double) WHEN o_orderkey % 83 = 0 THEN CAST('-Infinity' AS double) "
    "WHEN o_orderkey % 89 = 0 THEN CAST('NaN' AS double) ELSE o_totalprice / 1000.0 END AS ratio",
    "'const' AS constant_col",
    "o_orderpriority AS priority",
]
DIRTY_DUP_PREDICATE = "o_orderkey % 50 = 0"


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").selectExpr(*DIRTY_ORDERS_EXPRS)
    return base.unionByName(base.where(DIRTY_DUP_PREDICATE))


def dirty_orders_sql() -> str:
    sel = ",\n    ".join(DIRTY_ORDERS_EXPRS)
    return (f"base AS (SELECT\n    {sel}\n  FROM orders),\n"
            f"dirty_orders AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE {DIRTY_DUP_PREDICATE})")


RULE_COLUMNS = ["Colonne", "Type", "Obligatoire", "Valeurs_Autorisées", "Min", "Max", "Format", "Action_Si_Anomalie"]
RULES_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RULE_COLUMNS])

# The 7-rule data dictionary for dirty_orders (FIXTURES.md section 3).
DIRTY_RULES = [
    ("o_orderkey", "numerique", "oui", None, "0", None, None, "ignorer"),
    ("price", "numerique", "oui", None, "0", "1000000", None, "imputer_mediane"),
    ("price_txt", "numerique", "non", None, "20000", None, None, "mettre_vide"),
    ("status", "categorique", "oui", "F,O,P", None, None, None, "imputer_mode"),
    ("date_txt", "date", "oui", None, None, "1998-06-30", "%Y-%m-%d", "supprimer_ligne"),
    ("email", "texte", "non", None, None, None, "email", "mettre_vide"),
    ("segment", "categorique", "oui", "A,B", None, None, None, "ignorer"),
]


def dirty_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIRTY_RULES, RULES_SCHEMA)


# scored_events: binary label and a deterministic score in [0, 1)
SCORED_EVENTS_EXPRS = [
    "event_id AS key",
    "CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS double) AS label",
    "value / (value + 20.0) AS probability",
]


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions table (key, label, probability, prediction = probability >= 0.5)."""
    d = table(spark, sf_dir, "events").selectExpr(*SCORED_EVENTS_EXPRS)
    return d.withColumn("prediction", F.when(F.col("probability") >= 0.5, 1.0).otherwise(0.0))


def scored_events_sql() -> str:
    sel = ", ".join(SCORED_EVENTS_EXPRS)
    return (f"scored_events AS (SELECT *, CASE WHEN probability >= 0.5 THEN 1.0 ELSE 0.0 END AS prediction "
            f"FROM (SELECT {sel} FROM events) s)")


# scored_lines: regression predictions
SCORED_LINES_EXPRS = [
    "l_orderkey * 10 + l_linenumber AS key",
    "l_extendedprice AS label",
    "l_quantity * 1500.0 AS prediction",
]


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*SCORED_LINES_EXPRS)


def scored_lines_sql() -> str:
    return f"scored_lines AS (SELECT {', '.join(SCORED_LINES_EXPRS)} FROM lineitem)"


# high_card: orders with the customer key as a high-cardinality string feature
HIGH_CARD_EXPRS = [
    "o_orderkey",
    "CAST(o_custkey AS string) AS cust",
    "o_orderpriority AS priority",
    "o_totalprice AS price",
    "o_orderstatus AS status",
    "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_f",
]


def high_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*HIGH_CARD_EXPRS)


def high_card_sql() -> str:
    return f"high_card AS (SELECT {', '.join(HIGH_CARD_EXPRS)} FROM orders)"


# Rules for the ``events`` table (also used on its streaming form).
EVENTS_RULES = [
    ("value", "numerique", "oui", None, "0", "300", None, "ignorer"),
    ("event_type", "categorique", "oui", "view,click,purchase,signup", None, None, None, "ignorer"),
    ("props", "texte", "non", None, None, None, r'^\{"k": \d+\}$', "ignorer"),
]


def events_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENTS_RULES, RULES_SCHEMA)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a file stream (schema taken from the batch table)."""
    schema = table(spark, sf_dir, "events").schema
    base = sf_dir.rstrip("/")
    # a file source reads a directory; the glob picks the one table file inside it
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("basePath", base)
            .parquet(f"{base}/event[s].parquet"))
