"""A history, a target and a sample made of TPC-H-like order tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.sources import colocated
from rowtide.sources.shared import new_folder

_MODULUS = {
    "pre_since_opened": "(l_partkey + l_suppkey) % 20", "pre_since_confirmed": "(l_orderkey + l_suppkey) % 18", "pre_pterm": "(l_partkey + l_linenumber) % 18",
    "pre_fterm": "(l_partkey + l_orderkey) % 17", "pre_till_pclose": "(l_suppkey + l_linenumber) % 17", "pre_till_fclose": "(l_partkey + 2 * l_suppkey) % 16",
    "pre_loans_credit_limit": "l_orderkey % 20", "pre_loans_next_pay_summ": "l_partkey % 7", "pre_loans_outstanding": "l_suppkey % 6", "pre_loans_total_overdue": "l_partkey % 2",
    "pre_loans_max_overdue_sum": "(l_partkey + l_suppkey) % 4", "pre_loans_credit_cost_rate": "l_suppkey % 14",
    "pre_loans5": "(l_partkey + l_linenumber) % 20", "pre_loans530": "(l_suppkey + l_linenumber) % 20", "pre_loans3060": "l_partkey % 10", "pre_loans6090": "l_suppkey % 5", "pre_loans90": "(l_orderkey + l_linenumber) % 20",
    "pre_util": "CAST(l_quantity AS INT) % 20", "pre_over2limit": "l_partkey % 20", "pre_maxover2limit": "(l_partkey + l_orderkey) % 20",
    "enc_loans_account_holder_type": "l_linenumber - 1",
    "enc_loans_credit_status": "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END",
    "enc_loans_credit_type": "l_partkey % 8", "enc_loans_account_cur": "l_suppkey % 4",
    "pclose_flag": "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END", "fclose_flag": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    **{f"enc_paym_{i}": f"(l_partkey * {i + 1} + l_suppkey) % 5" for i in range(25)},
}
_ZERO = {"is_zero_loans5": "pre_loans5", "is_zero_loans530": "pre_loans530", "is_zero_loans3060": "pre_loans3060", "is_zero_loans6090": "pre_loans6090", "is_zero_loans90": "pre_loans90", "is_zero_util": "pre_util", "is_zero_over2limit": "pre_over2limit", "is_zero_maxover2limit": "pre_maxover2limit"}
_CODES = {**_MODULUS, **{c: f"CASE WHEN {_MODULUS[of]} = 0 THEN 1 ELSE 0 END" for c, of in _ZERO.items()}}

#: Columns of the order tables that codes are made of.
_RAW = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")

#: Runs on Spark and on other engines alike: only the input is shared with the SQL that checks the queries.
HISTORY_SQL = (
    "SELECT o.o_custkey AS id, CAST(ROW_NUMBER() OVER (PARTITION BY o.o_custkey ORDER BY l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS INT) AS rn, "
    + ", ".join(f"CAST({x} AS INT) AS {c}" for c, x in _CODES.items())
    + " FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey"
)
TARGET_SQL = "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS flag FROM {customer}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few order columns dealt by id. The session's shuffle partitions are kept as they are: merged by their narrow rows, they
    would be too large for what aggregations by id hold."""
    raw = spark.sql(f"SELECT o.o_custkey AS id, {', '.join(_RAW)}, l.l_shipdate FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey", lineitem=_table(spark, sf_dir, "lineitem"), orders=_table(spark, sf_dir, "orders"))
    return raw.repartition(_parts(spark), "id")


def _number(dealt: DataFrame) -> DataFrame:
    return dealt.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order columns numbered where they are dealt."""
    return _number(_dealt(spark, sf_dir))


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _coded(numbered: DataFrame) -> DataFrame:
    return numbered.selectExpr("id", "rn", *(f"CAST({x} AS INT) AS {c}" for c, x in _CODES.items()))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``HISTORY_SQL``. Order columns are dealt by id first and codes are computed after that: one narrow shuffle serves
    whatever is grouped by id afterwards, and neither a row's codes nor the hundreds of counts that an aggregation before a shuffle
    makes of it travel."""
    return _coded(_numbered(spark, sf_dir))


def kept_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, for several aggregations: order columns and numbers are written once, in a table bucketed by id."""
    return _coded(colocated.write(_numbered(spark, sf_dir).drop("l_shipdate"), new_folder(spark, "history"), _parts(spark), dealt=True))


def dealt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, for what is not an aggregation: rows are numbered as they are read, which keeps all rows of a bucket in one task."""
    return _coded(_number(colocated.write(_dealt(spark, sf_dir), new_folder(spark, "history"), _parts(spark), dealt=True)))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TARGET_SQL, customer=_table(spark, sf_dir, "customer"))


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The denser history of ``events``: id, rn by time, event type and value bucket as codes."""
    return spark.sql(
        "SELECT user_id AS id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS rn, "
        "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS event_code, "
        "CAST(floor(value / 50) AS INT) AS value_bucket FROM {events}",
        events=_table(spark, sf_dir, "events"),
    )
