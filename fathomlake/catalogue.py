"""The queries of the engine's own operators, and the same in DuckDB SQL.

Results are rounded alike on both sides, as sums of floating-point numbers
depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .functions import keys as keyfn
from .operators import cleaning, enrichment, ordering, sampling, stability, targets
from .plans.compiler import features
from .plans.formula import parse
from .sources.files import read_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name).cast("double"), digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema.fields])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def formula(name: str, source: str | Callable[[SparkSession, str], DataFrame], ids: Sequence[str], text: str, sql: str, row_id: str | None = None, **params: object) -> None:
    """A query that computes one formula over a table, as ``value`` beside the ``ids``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source) if isinstance(source, str) else source(spark, sf_dir)
        node = parse(text)
        for k, v in params.items():
            node.op._assign(k, v)
        return rounded(features(df, {"value": node}, row_id=row_id, keep=ids))

    query(name, sql)(run)


# Row-local operators

for _op, _sql in {
    "abs": "abs(c_acctbal)", "log": "trunc(ln(abs(nullif(c_acctbal, 0))) * 1e10) / 1e10", "sqrt": "sqrt(abs(c_acctbal))", "square": "c_acctbal * c_acctbal",
    "floor": "floor(c_acctbal)", "residual": "c_acctbal - floor(c_acctbal)",
}.items():
    formula(f"op_{_op}", "customer", ["c_custkey"], f"{_op}(c_acctbal)", f"SELECT c_custkey, round(CAST({_sql} AS DOUBLE), 6) AS value FROM customer")

_LINE = ["l_orderkey", "l_linenumber"]
formula("op_sigmoid", "lineitem", _LINE, "sigmoid(l_discount)", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-l_discount)), 6) AS value FROM lineitem")
for _op, _text, _sql in (
    ("add", "(l_quantity+l_tax)", "l_quantity + l_tax"), ("sub", "(l_extendedprice-l_quantity)", "l_extendedprice - l_quantity"), ("mul", "(l_extendedprice*l_discount)", "l_extendedprice * l_discount"),
    ("div", "(l_extendedprice/l_discount)", "l_extendedprice / nullif(l_discount, 0)"), ("min", "min(l_quantity,l_extendedprice)", "least(l_quantity, l_extendedprice)"),
    ("max", "max(l_discount,l_tax)", "greatest(l_discount, l_tax)"), ("mean", "mean(l_quantity,l_discount,l_tax)", "(coalesce(l_quantity, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0)) / 3"),
    ("sum", "sum(l_quantity,l_discount,l_tax)", "coalesce(l_quantity, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0)"),
):
    formula(f"op_{_op}", "lineitem", _LINE, _text, f"SELECT l_orderkey, l_linenumber, round({_sql}, 6) AS value FROM lineitem")
formula("op_bin", "part", ["p_partkey"], "bin(p_size)", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 4 WHEN p_size >= 25 THEN 3 WHEN p_size >= 10 THEN 2 WHEN p_size >= 5 THEN 1 ELSE -1 END AS value FROM part", bin_bounds=[5, 10, 25, 40])
formula("op_combine", "orders", ["o_orderkey"], "Combine(o_orderstatus,o_orderpriority)", "SELECT o_orderkey, o_orderstatus || '_' || o_orderpriority AS value FROM orders")
formula("op_freq", "events", ["event_id"], "freq(event_type)", "SELECT event_id, round(count(*) OVER (PARTITION BY event_type) / count(*) OVER (), 6) AS value FROM events")
formula("op_norm", "orders", ["o_orderkey"], "norm(o_totalprice)", "SELECT o_orderkey, round(o_totalprice / sqrt(sum(o_totalprice * o_totalprice) OVER ()), 6) AS value FROM orders")
formula("op_combine_freq", "orders", ["o_orderkey"], "CombineThenFreq(o_orderstatus,o_orderpriority)", "SELECT o_orderkey, round(count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) / count(*) OVER (), 6) AS value FROM orders")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


_PAIR_SQL = "SELECT a.vec_id, round({}list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
formula("op_dist", _pairs, ["vec_id"], "dist(a,b)", _PAIR_SQL.format("1 - "))
formula("op_sim", _pairs, ["vec_id"], "sim(a,b)", _PAIR_SQL.format(""))
for _op, _sql in {
    "sim_lv": "1 - levenshtein(p_brand, p_type) / greatest(length(p_brand), length(p_type))", "sim_jw1": "jaro_winkler_similarity(p_name, p_type)",
    "sim_jw2": "jaro_winkler_similarity(reverse(p_name), reverse(p_type))",
}.items():
    formula(f"op_{_op}", "part", ["p_partkey"], f"{_op}({'p_brand' if _op == 'sim_lv' else 'p_name'},p_type)", f"SELECT p_partkey, round({_sql}, 6) AS value FROM part")


@query("op_vectorize", "SELECT l_orderkey, l_linenumber, CAST([l_quantity, l_tax][1] AS DOUBLE) AS first, CAST([l_quantity, l_tax][2] AS DOUBLE) AS second FROM lineitem")
def _vectorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features(table(spark, sf_dir, "lineitem"), {"v": "vectorize(l_quantity,l_tax)"}, keep=_LINE)
    return out.select(*_LINE, F.col("v")[0].alias("first"), F.col("v")[1].alias("second"))


# Group-by operators

for _op, _sql in {
    "Min": "min(l_extendedprice) OVER w", "Max": "max(l_extendedprice) OVER w", "Mean": "avg(l_extendedprice) OVER w", "Sum": "sum(l_extendedprice) OVER w", "Std": "stddev_samp(l_extendedprice) OVER w",
    "Var": "var_samp(l_quantity) OVER w", "Count": "CAST(count(l_extendedprice) OVER w AS DOUBLE)", "Median": "median(l_extendedprice) OVER w",
}.items():
    formula(f"gb_{_op.lower()}", "lineitem", _LINE, f"GroupByThen{_op}({'l_quantity' if _op == 'Var' else 'l_extendedprice'},l_suppkey)", f"SELECT l_orderkey, l_linenumber, round({_sql}, 6) AS value FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
formula("gb_rank", "lineitem", _LINE, "GroupByThenRank(l_quantity,l_returnflag)", """
    SELECT l_orderkey, l_linenumber, round((rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0)
        / count(l_quantity) OVER (PARTITION BY l_returnflag), 6) AS value FROM lineitem""")
formula("gb_nunique", "lineitem", _LINE, "GroupByThenNUnique(l_quantity,l_suppkey)", "SELECT l_orderkey, l_linenumber, n AS value FROM lineitem JOIN (SELECT l_suppkey, count(DISTINCT l_quantity) AS n FROM lineitem GROUP BY 1) USING (l_suppkey)")
formula("gb_freq", "lineitem", _LINE, "GroupByThenFreq(l_linestatus,l_returnflag)", "SELECT l_orderkey, l_linenumber, round(count(*) OVER (PARTITION BY l_returnflag, l_linestatus) / count(*) OVER (PARTITION BY l_returnflag), 6) AS value FROM lineitem")
formula("gb_first", "events", ["event_id"], "GroupByThenFirst(value,user_id)", "SELECT event_id, round(first_value(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS value FROM events", row_id="event_id")
formula("gb_last", "events", ["event_id"], "GroupByThenLast(value,user_id)", "SELECT event_id, round(last_value(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS value FROM events", row_id="event_id")


@query("gb_batch", """
    SELECT l_orderkey, l_linenumber, min(l_quantity) OVER w AS low, max(l_quantity) OVER w AS high, round(avg(l_discount) OVER w, 6) AS mean,
           round(l_quantity / nullif(max(l_quantity) OVER w, 0), 6) AS share FROM lineitem WINDOW w AS (PARTITION BY l_partkey)""")
def _gb_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"low": "GroupByThenMin(l_quantity,l_partkey)", "high": "GroupByThenMax(l_quantity,l_partkey)", "mean": "GroupByThenMean(l_discount,l_partkey)", "share": "(l_quantity/GroupByThenMax(l_quantity,l_partkey))"}
    return rounded(features(table(spark, sf_dir, "lineitem"), texts, keep=_LINE))


# Dates


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")


_SHIPPED = "FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
formula("date_diff", _shipped, _LINE, "date_diff(l_shipdate,o_orderdate)", f"SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS value {_SHIPPED}")
formula("date_diff_years", _shipped, _LINE, "date_diff(l_shipdate,o_orderdate)", f"SELECT l_orderkey, l_linenumber, trunc(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 365) AS value {_SHIPPED}", diff_unit="Y")
formula("date_diff_type2", _shipped, _LINE, "date_diff_type2(l_shipdate,o_orderdate)", f"""
    SELECT l_orderkey, l_linenumber, round((epoch_us(CASE WHEN t < l_shipdate THEN n ELSE t END) - epoch_us(l_shipdate)) / 86400e6, 6) AS value
    FROM (SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate + to_years(CAST(year(l_shipdate) - year(o_orderdate) AS INTEGER)) AS t,
                 o_orderdate + to_years(CAST(year(l_shipdate) - year(o_orderdate) + 1 AS INTEGER)) AS n {_SHIPPED})""")


def _ship_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_shipdate").alias("ships"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(lists, "o_orderkey")


_DAYS = "SELECT o_orderkey, (epoch_us(o_orderdate) - epoch_us(l_shipdate)) / 86400e6 AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
for _op, _sql in {"min": "min(d)", "max": "max(d)", "mean": "avg(d)", "nunique": "CAST(count(DISTINCT d) AS DOUBLE)", "count": "CAST(count(d) AS DOUBLE)", "std": "stddev_pop(d)"}.items():
    formula(f"datelist_{_op}", _ship_lists, ["o_orderkey"], f"date_diff_{_op}(o_orderdate,ships)", f"SELECT o_orderkey, round({_sql}, 6) AS value FROM ({_DAYS}) GROUP BY o_orderkey")
formula("datelist_bounded", _ship_lists, ["o_orderkey"], "date_diff_D_minusinf_0_count_norm(o_orderdate,ships)", f"SELECT o_orderkey, round(count(*) FILTER (d < 0) / count(*), 6) AS value FROM ({_DAYS}) GROUP BY o_orderkey")
formula("date_per", "orders", ["o_orderkey"], "date_per(o_orderdate,o_totalprice)", """
    SELECT o_orderkey, CASE WHEN o_totalprice >= 300000.0 + s THEN 4 WHEN o_totalprice >= 150000.0 + s THEN 3 WHEN o_totalprice >= 50000.0 + s THEN 2 WHEN o_totalprice >= 0.0 + s THEN 1 END AS value
    FROM (SELECT o_orderkey, o_totalprice, (12 * (year(o_orderdate) - 1995) + month(o_orderdate) - 1) * 30 AS s FROM orders)""", zero_month=1, zero_year=1995, zero_bounds=[0.0, 50000.0, 150000.0, 300000.0])


# Time series

_US = {"D": 86_400_000_000, "H": 3_600_000_000}


def _frame(begin: int, end: int = 0) -> str:
    side = lambda n: "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    return f"OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {side(begin)} AND {side(end)})"


def _event(name: str, text: str, expression: str, source: str = "events") -> None:
    formula(name, "events", ["event_id"], f"{text}(ts,user_id,value)", f"SELECT event_id, round({expression}, 6) AS value FROM {source}", row_id="event_id")


_W7, _W2H = _frame(1 - 7 * _US["D"]), _frame(1 - 2 * _US["H"])
for _op, _sql in {
    "mean": f"avg(value) {_W7}", "sum": f"sum(value) {_W7}", "min": f"min(value) {_W7}", "max": f"max(value) {_W7}", "std": f"stddev_samp(value) {_W7}", "median": f"median(value) {_W7}",
    "q25": f"quantile_cont(value, 0.25) {_W7}", "iqr": f"quantile_cont(value, 0.75) {_W7} - quantile_cont(value, 0.25) {_W7}", "norm_mean": f"value / avg(value) {_W7}", "count": f"CAST(count(value) {_W7} AS DOUBLE)",
}.items():
    _event(f"roll_7D_{_op}", f"roll_7D_{_op}", _sql)
_event("roll_2H_mean", "roll_2H_mean", f"avg(value) {_W2H}")
_LAG = f"first_value(value) {_frame(1 - 2 * _US['D'], -_US['D'])}"
_event("lag_1D", "lag_1D", _LAG)
_event("delta_1D", "delta_1D", f"value - {_LAG}")
_event("delta2_1D", "delta2_1D", f"value - first_value(value) {_frame(1 - 2 * _US['D'], -_US['D'])}", f"(SELECT event_id, ts, user_id, value - {_LAG} AS value FROM events)")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = e.groupBy(F.date_trunc("DAY", "ts").alias("day"), "event_type").agg(F.round(F.sum("value"), 2).alias("total"))
    return day.withColumn("row_id", F.xxhash64("day", "event_type"))


_DAILY = "SELECT date_trunc('day', ts) AS day, event_type, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"
_RETURNS = f"""
    WITH d AS ({_DAILY}),
    r AS (SELECT a.day, a.event_type, a.total, coalesce(a.total / nullif(b.total, 0) - 1, 0) AS r FROM d a LEFT JOIN d b ON b.event_type = a.event_type AND b.day = a.day - INTERVAL 1 DAY)"""


def _vol(days: int, what: str = "r") -> str:
    return f"stddev_samp({what}) OVER (PARTITION BY event_type ORDER BY epoch_us(day) RANGE BETWEEN {days * _US['D'] - 1} PRECEDING AND CURRENT ROW)"


def _series(name: str, text: str, sql: str | None, **params: object) -> None:
    formula(name, _daily, ["day", "event_type"], f"{text}(day,event_type,total)", sql or "", row_id="row_id", **params)


_series("roll_vol", "roll_vol_7D", f"{_RETURNS} SELECT day, event_type, round({_vol(7)}, 6) AS value FROM r")
_series("vol_ratio", "vol_ratio_3D_to_7D", f"{_RETURNS} SELECT day, event_type, round(coalesce({_vol(3)} / nullif({_vol(7)}, 0), 1), 6) AS value FROM r")
_series("roll_vol2", "roll_vol2_3D", f"""
    {_RETURNS}, v AS (SELECT day, event_type, {_vol(3, 'abs(r)')} AS total FROM r),
    f AS (SELECT day, event_type, last_value(total IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day) AS total FROM v),
    r2 AS (SELECT a.day, a.event_type, CASE WHEN b.total = 0 AND a.total <> 0 THEN NULL ELSE coalesce(a.total / nullif(b.total, 0) - 1, 0) END AS r
           FROM f a LEFT JOIN f b ON b.event_type = a.event_type AND b.day = a.day - INTERVAL 1 DAY)
    SELECT day, event_type, round({_vol(3)}, 6) AS value FROM r2""")
_series("ewma_vol", "ewma_vol_5", f"""
    {_RETURNS}, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM r),
    p AS (SELECT a.day, a.event_type, b.r, power(2.0 / 3.0, a.i - b.i) AS w FROM i a JOIN i b ON b.event_type = a.event_type AND b.i <= a.i),
    m AS (SELECT day, event_type, sum(w * r) / sum(w) AS m, sum(w) AS s, sum(w * w) AS s2 FROM p GROUP BY 1, 2)
    SELECT day, event_type, round(CASE WHEN any_value(s * s - s2) > 1e-12 * any_value(s * s) THEN sqrt(sum(w * (r - m) * (r - m)) / any_value(s) * any_value(s * s / (s * s - s2))) END, 6) AS value
    FROM p JOIN m USING (day, event_type) GROUP BY 1, 2""")
_series("trend_coef", "trend_coef", f"""
    WITH d AS ({_DAILY}), s AS (SELECT event_type, min(day) AS first, max(day) AS last FROM d GROUP BY 1),
    g AS (SELECT event_type, unnest(range(first, last + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day, first FROM s),
    y AS (SELECT g.event_type, date_diff('day', g.first, g.day) AS i, d.total AS y FROM g ASOF JOIN d ON g.event_type = d.event_type AND g.day >= d.day)
    SELECT d.day, d.event_type, round(c.slope, 6) AS value FROM d JOIN (SELECT event_type, regr_slope(y, i) AS slope FROM y GROUP BY 1) c USING (event_type)""")


@query("roll_offset", f"""
    WITH d AS ({_DAILY}), s AS (SELECT a.day, a.event_type, b.total FROM d a JOIN d b ON b.event_type = a.event_type AND b.day = a.day - INTERVAL 2 DAY)
    SELECT d.day, d.event_type, round(m, 6) AS value FROM d LEFT JOIN (SELECT day, event_type, avg(total) OVER
        (PARTITION BY event_type ORDER BY epoch_us(day) RANGE BETWEEN {3 * _US['D'] - 1} PRECEDING AND CURRENT ROW) AS m FROM s) USING (day, event_type)""")
def _roll_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(_daily(spark, sf_dir), {"value": "roll_3D_mean_offset_2D(day,event_type,total)"}, row_id="row_id", keep=["day", "event_type"]))


@query("cross_add", f"""
    WITH d AS ({_DAILY}), t AS (SELECT min(event_type) AS a, max(event_type) AS b FROM d)
    SELECT d.day, d.event_type, round(x.total + y.total, 6) AS value FROM d CROSS JOIN t
    LEFT JOIN d x ON x.day = d.day AND x.event_type = t.a LEFT JOIN d y ON y.day = d.day AND y.event_type = t.b WHERE d.event_type IN (t.a, t.b)""")
def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    low, high = d.agg(F.min("event_type"), F.max("event_type")).first()
    node = parse("cross_add(day,event_type,total)")
    node.op.descriptor_indices, node.op.left_descriptor, node.op.right_descriptor = [1], [low], [high]
    out = features(d, {"value": node}, row_id="row_id", keep=["day", "event_type"])
    return rounded(out.filter(F.col("event_type").isin(low, high)))


# Keys and cleaning


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.when(key % 7 != 0, F.concat(F.lit("User."), key, F.lit("@Mail"), key % 5, F.lit(".Example.com"))).otherwise(F.lit("no address")).alias("email"),
        F.concat(F.lit("+1 ("), F.lpad((key % 1000).cast("string"), 3, "2"), F.lit(") "), F.lpad(key.cast("string"), 7, "0")).alias("phone"),
        F.concat(F.lit("  0"), F.lower(F.lit("aB-")), key, F.lit(" ")).alias("postal"), F.when(key % 3 == 0, F.lit(" uK")).otherwise(F.col("n_name")).alias("country"),
        F.concat_ws(".", F.lit("10"), key % 256, F.lit("0"), (key % 200).cast("string")).alias("ip"),
    )


_CONTACTS = """(SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN 'User.' || c_custkey || '@Mail' || c_custkey % 5 || '.Example.com' ELSE 'no address' END AS email,
    '+1 (' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '2') || ') ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone, '  0ab-' || c_custkey || ' ' AS postal,
    '10.' || c_custkey % 256 || '.0.' || c_custkey % 200 AS ip FROM customer)"""


def _key_query(name: str, column: Callable[[], Column], sql: str) -> None:
    query(name, f"SELECT c_custkey, {sql} AS value FROM {_CONTACTS}")(lambda spark, sf_dir: _contacts(spark, sf_dir).select("c_custkey", column().alias("value")))


_key_query("key_email_hash", lambda: keyfn.email_hash(F.col("email")), "CASE WHEN email LIKE '%@%' THEN sha256(lower(email)) END")
_key_query("key_email_domain", lambda: keyfn.email_domain(F.col("email")), "CASE WHEN email LIKE '%@%' THEN split_part(email, '@', 2) END")
_key_query("key_email_one_domain", lambda: keyfn.email_one_domain(F.col("email")), "CASE WHEN email LIKE '%@%' THEN left(email, 1) || '@' || split_part(email, '@', 2) END")
_key_query("key_phone", lambda: keyfn.phone(F.col("phone")), "CAST(regexp_replace(phone, '[^0-9]', '', 'g') AS BIGINT)")
_key_query("key_postal", lambda: keyfn.postal_code(F.col("postal")), "'AB' || c_custkey")
_key_query("key_ip_prefix", lambda: keyfn.ip(F.col("ip"))["prefix"], "'10.' || c_custkey % 256")
_key_query("key_ip_binary", lambda: F.hex(keyfn.ip(F.col("ip"))["binary"]), "printf('0A%02X00%02X', c_custkey % 256, c_custkey % 200)")


@query("key_country", """
    SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'GB' ELSE regexp_replace(upper(n_name), '[^A-Z]', '', 'g') END AS value FROM nation""")
def _key_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("c", F.when(F.col("n_nationkey") % 3 == 0, F.lit(" uK")).otherwise(F.concat(F.col("n_name"), F.lit("#1"))))
    return n.select("n_nationkey", F.regexp_replace(keyfn.country(F.col("c")), "#1", "").alias("value"))


@query("key_date", "SELECT o_orderkey, epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS value FROM orders WHERE o_orderdate > TIMESTAMP '1999-12-31' UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderdate <= TIMESTAMP '1999-12-31'")
def _key_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return o.select("o_orderkey", keyfn.date_key(keyfn.parse_dates(o, "d")).alias("value"))


_COPIES = "SELECT o_orderkey, o_custkey AS customer, o_orderpriority AS priority, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS target FROM orders"


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") > 200000).cast("int").alias("target"))


@query("dedup_full", f"""
    WITH d AS (SELECT min(o_orderkey) AS o_orderkey, customer, priority, target FROM ({_COPIES}) GROUP BY 2, 3, 4)
    SELECT o_orderkey, customer, priority, target FROM (SELECT *, count(*) OVER (PARTITION BY customer, priority) AS n FROM d) WHERE n = 1""")
def _dedup_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_full_duplicates(_repeats(spark, sf_dir), "o_orderkey")


@query("dedup_contradictions", """
    WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS target FROM orders),
    s AS (SELECT *, lag(target) OVER w AS before, epoch_ms(o_orderdate) - lag(epoch_ms(o_orderdate)) OVER w AS gap FROM r WINDOW w AS (PARTITION BY o_custkey, quarter ORDER BY o_orderdate, target)),
    p AS (SELECT o_custkey, quarter, count(DISTINCT o_orderdate) AS dates, count(DISTINCT target) AS targets, bool_or(target IS DISTINCT FROM before AND gap < 5184000000) AS bad FROM s GROUP BY 1, 2)
    SELECT o_orderkey, o_custkey, target FROM r WHERE (SELECT avg(CASE WHEN dates > 1 THEN 1 ELSE 0 END) FROM p) >= 0.6
        OR (o_custkey, quarter) NOT IN (SELECT (o_custkey, quarter) FROM p WHERE bad AND targets > 1)""")
def _contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person is a customer in a quarter of a year, so that few have several dates and the removal applies."""
    r = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.date_trunc("QUARTER", "o_orderdate").cast("date").alias("quarter"), (F.col("o_totalprice") > 200000).cast("int").alias("target"))
    return cleaning.drop_contradictions(r, ["o_custkey", "quarter"], "o_orderdate", "target").select("o_orderkey", "o_custkey", "target")


@query("record_ids", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS system_record_id FROM events")
def _record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return ordering.numbered(e, [F.col("ts"), F.col("event_id")], "system_record_id").select("event_id", "system_record_id")


@query("melt_keys", "SELECT c_custkey, 'n' || c_nationkey AS place FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer")
def _melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("a"), F.col("c_mktsegment").alias("b"))
    return cleaning.melt_keys(c, {"place": ["a", "b"]})


@query("one_hot_decode", "SELECT o_orderkey, left(o_orderpriority, 1) AS p_ FROM orders")
def _one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", *[(F.substring("o_orderpriority", 1, 1) == str(i)).cast("int").alias(f"p_{i}") for i in range(1, 6)])
    return cleaning.decode_one_hot(o, cleaning.one_hot_groups(o.drop("o_orderkey")))


@query("valid_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0 AND (l_tax > 0 OR l_linenumber > 3)")
def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*_LINE, F.nullif("l_tax", F.lit(0.0)).alias("k1"), F.when(F.col("l_linenumber") > 3, F.col("l_linenumber")).alias("k2"), F.nullif("l_discount", F.lit(0.0)).alias("y"))
    return cleaning.valid_rows(rows, ["k1", "k2"], target="y").select(*_LINE)


@query("feature_validators", "SELECT 'high_cardinality' AS what, 'o_orderkey' AS name UNION ALL SELECT 'constant', 'one'")
def _validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.lit("x").alias("one"))
    found = [("high_cardinality", c) for c in cleaning.high_cardinality_columns(o)] + [("constant", c) for c in cleaning.constant_columns(o)]
    return spark.createDataFrame(found, "what string, name string")


# Enrichment

_SOURCE = "SELECT c_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1"


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders by customer: a source in which not all customers are."""
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))


@query("enrich_left", f"SELECT c_custkey, c_mktsegment, n_orders, spent FROM customer LEFT JOIN ({_SOURCE}) USING (c_custkey)")
def _enrich_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.enrich(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), _source(spark, sf_dir), ["c_custkey"])


@query("enrich_inner", f"SELECT c_custkey, c_mktsegment, n_orders, spent FROM customer JOIN ({_SOURCE}) USING (c_custkey)")
def _enrich_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.enrich(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), _source(spark, sf_dir), ["c_custkey"], "inner")


@query("full_outer_blocks", """
    SELECT k, a.n AS n_a, b.n AS n_b FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a
    FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) b USING (k)""")
def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda t, key, name: table(spark, sf_dir, t).groupBy(F.col(key).alias("k")).agg(F.count("*").alias(name))
    return enrichment.join_blocks([count("orders", "o_custkey", "n_a"), count("events", "user_id", "n_b")], "k")


@query("hit_rate", f"""
    SELECT 'all' AS key, count(*) AS rows, count(n_orders) AS matched, round(avg(CASE WHEN n_orders IS NULL THEN 0 ELSE 1 END), 6) AS hit_rate
    FROM customer LEFT JOIN ({_SOURCE}) USING (c_custkey)
    UNION ALL SELECT 'custom_key', count(*), count(n_orders), round(avg(CASE WHEN n_orders IS NULL THEN 0 ELSE 1 END), 6) FROM customer LEFT JOIN ({_SOURCE}) USING (c_custkey)""")
def _hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _enrich_left(spark, sf_dir).withColumn("hit", F.col("n_orders").isNotNull().cast("int"))
    return rounded(enrichment.hit_rates(joined, "hit", {"c_custkey": "custom_key"}))


@query("best_match", """
    WITH s AS (SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS segment, n_nationkey * 10 AS f FROM nation)
    SELECT c_custkey, CASE WHEN b.f IS NOT NULL THEN 'nation+segment' WHEN n.f IS NOT NULL THEN 'nation' WHEN g.f IS NOT NULL THEN 'segment' END AS matched_by, coalesce(b.f, n.f, g.f) AS f
    FROM customer c LEFT JOIN s b ON b.nation = c_nationkey AND b.segment = c_mktsegment LEFT JOIN (SELECT nation, min(f) AS f FROM s GROUP BY 1) n ON n.nation = c_nationkey
    LEFT JOIN (SELECT segment, min(f) AS f FROM s GROUP BY 1) g ON g.segment = c_mktsegment""")
def _best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.when(F.col("n_nationkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("segment"), (F.col("n_nationkey") * 10).alias("f"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return enrichment.best_match(c, n, ["nation", "segment"], "c_custkey").select("c_custkey", "matched_by", "f")


def _as_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All events, and the totals that a user had at the end of each hour with an event."""
    e = table(spark, sf_dir, "events")
    right = e.groupBy("user_id", (F.date_trunc("HOUR", "ts") + F.expr("interval 1 hour")).alias("at")).agg(F.round(F.sum("value"), 6).alias("last_value"))
    return e.select("event_id", "user_id", "ts"), right


_HOURS = "(SELECT user_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS at, round(sum(value), 6) AS last_value FROM events GROUP BY 1, 2)"


@query("asof", f"""
    SELECT a.event_id, a.user_id, round(CASE WHEN epoch_us(a.ts) - epoch_us(b.at) <= 172800000000 THEN b.last_value END, 6) AS last_value FROM events a ASOF LEFT JOIN {_HOURS} b ON a.user_id = b.user_id AND a.ts >= b.at""")
def _asof_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _as_of(spark, sf_dir)
    return rounded(enrichment.as_of_join(left, right, ["user_id"], "ts", "at", "event_id", limit_days=2).select("event_id", "user_id", "last_value"))


@query("asof_window", f"""
    SELECT a.event_id, a.user_id, round(b.last_value, 6) AS last_value FROM events a ASOF LEFT JOIN {_HOURS} b ON a.user_id = b.user_id AND a.ts >= b.at""")
def _asof_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _as_of(spark, sf_dir)
    return rounded(enrichment.as_of_by_window(left, right, ["user_id"], "ts", "at", "event_id").select("event_id", "user_id", "last_value"))


@query("asof_forward", f"""
    SELECT a.event_id, a.user_id, round(b.last_value, 6) AS last_value FROM events a ASOF LEFT JOIN {_HOURS} b ON a.user_id = b.user_id AND a.ts <= b.at""")
def _asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _as_of(spark, sf_dir)
    return rounded(enrichment.as_of_join(left, right, ["user_id"], "ts", "at", "event_id", direction="forward").select("event_id", "user_id", "last_value"))


@query("range_join", """
    WITH r AS (SELECT p_partkey, CAST(p_partkey * 37 % 5000 AS BIGINT) AS b, CAST(p_partkey * 37 % 5000 + p_size * 3 AS BIGINT) AS e FROM part)
    SELECT o_orderkey, p_partkey FROM orders LEFT JOIN r ON o_custkey BETWEEN b AND e""")
def _range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 5000).alias("b"), (F.col("p_partkey") * 37 % 5000 + F.col("p_size") * 3).alias("e"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return enrichment.range_join(o, p, "o_custkey", "b", "e", width=50).select("o_orderkey", "p_partkey")


@query("two_hop_join", "SELECT o_orderkey, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def _two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return enrichment.two_hop_join(o, table(spark, sf_dir, "customer"), n, "c_custkey", "c_nationkey").select("o_orderkey", "n_name")


@query("outliers_anti", """
    WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) SELECT c_custkey, c_acctbal FROM customer, s WHERE abs(c_acctbal - m) <= 1.5 * s""")
def _outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return enrichment.without(c, targets.outliers(c, "c_acctbal", 1.5), ["c_custkey"])


@query("leakage", "SELECT count(*) > 0 AS leaked FROM (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')")
def _leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the years before in those after."""
    o, early = table(spark, sf_dir, "orders"), F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    return spark.createDataFrame([(enrichment.leaked(o.filter(early).select("o_custkey"), o.filter(~early).select("o_custkey")),)], "leaked boolean")


# Targets, samples, folds, stability


@query("task_types", "SELECT * FROM (VALUES ('quality', 'BINARY'), ('o_orderpriority', 'MULTICLASS'), ('o_totalprice', 'REGRESSION'), ('l_linenumber', 'MULTICLASS')) t(target, task)")
def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(c, targets.task_type(table(spark, sf_dir, t), c)) for t, c in (("labels", "quality"), ("orders", "o_orderpriority"), ("orders", "o_totalprice"), ("lineitem", "l_linenumber"))]
    return spark.createDataFrame(found, "target string, task string")


@query("sample_caps", """
    WITH n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT min(n) AS least FROM (SELECT sum(n) AS n FROM n GROUP BY l_returnflag))
    SELECT l_returnflag, CAST(least(sum(n), max(least)) AS BIGINT) AS n FROM n, m GROUP BY 1""")
def _caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return sampling.under_sample(rows, "l_returnflag", "row_id").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("sample_random", "SELECT 500 AS n, 500 AS n_distinct")
def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(table(spark, sf_dir, "orders"), 500, "o_orderkey").agg(F.count("*").cast("int").alias("n"), F.count_distinct("o_orderkey").cast("int").alias("n_distinct"))


@query("series_recent", "SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id) AS last FROM events) WHERE ts > last - INTERVAL 7 DAY")
def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.recent(table(spark, sf_dir, "events"), ["user_id"], "ts", "7 days").select("event_id")


@query("time_unit", f"""
    WITH g AS (SELECT CAST(epoch_us(day) - lag(epoch_us(day)) OVER (PARTITION BY event_type ORDER BY day) AS DOUBLE) / 1e6 AS gap FROM ({_DAILY}))
    SELECT gap AS seconds FROM g WHERE gap IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""")
def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(float(sampling.time_unit(_daily(spark, sf_dir), ["event_type"], "day")),)], "seconds double")


@query("cv_blocked", """
    WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () // 5 AS size FROM events)
    SELECT event_id, CAST(i // size AS INTEGER) AS fold, i % size >= floor(0.75 * size) AS is_test FROM r WHERE i < 5 * size""")
def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = _record_ids(spark, sf_dir)
    return sampling.blocked_time_series(numbered, "system_record_id", 5, 0.25).filter("fold is not null").select("event_id", "fold", "is_test")


@query("target_psi", """
    WITH t AS (SELECT o_totalprice AS t, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 0 ELSE 1 END AS side FROM orders), m AS (SELECT (min(t) + max(t)) / 2 AS mid FROM t),
    s AS (SELECT avg(CASE WHEN t > mid THEN 1.0 ELSE 0.0 END) FILTER (side = 0) AS e, avg(CASE WHEN t > mid THEN 1.0 ELSE 0.0 END) FILTER (side = 1) AS a FROM t, m)
    SELECT round((CASE WHEN e > 0 AND a > 0 THEN (e - a) * ln(e / a) ELSE 0 END) + (CASE WHEN e < 1 AND a < 1 THEN (a - e) * ln((1 - e) / (1 - a)) ELSE 0 END), 6) AS psi FROM s""")
def _target_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    return rounded(stability.target_psi(o.filter(early), o.filter(~early), "o_totalprice"))


_PARTS = " + ".join(f"CAST(t > (SELECT quantile_cont(t, {i / 12}) FROM base) AS INTEGER)" for i in range(1, 12))
_BINS = lambda c: " + ".join(f"CAST({c} >= (SELECT quantile_cont({c}, {k / 10}) FROM parts WHERE part = 0) AS INTEGER)" for k in range(1, 10))


@query("feature_psi", f"""
    WITH base AS (SELECT epoch_us(l_shipdate) AS t, l_quantity AS q, l_extendedprice AS e, l_returnflag AS g, CASE WHEN l_linenumber > 2 THEN l_tax END AS s FROM lineitem WHERE l_shipdate IS NOT NULL),
    parts AS (SELECT *, {_PARTS} AS part FROM base),
    cells AS (SELECT part, unnest(['l_quantity', 'l_extendedprice', 'l_returnflag', 'sparse is present']) AS f, unnest([CAST({_BINS('q')} AS VARCHAR), CAST({_BINS('e')} AS VARCHAR), g, CASE WHEN s IS NULL THEN 'false' ELSE 'true' END]) AS v FROM parts),
    counts AS (SELECT part, f, v, count(*) AS n FROM cells GROUP BY 1, 2, 3), total AS (SELECT f, v, sum(n) AS total FROM counts WHERE v IS NOT NULL GROUP BY 1, 2),
    ranked AS (SELECT f, v, (rank() OVER (PARTITION BY f ORDER BY total) + (count(*) OVER (PARTITION BY f, total) - 1) / 2.0) / count(*) OVER (PARTITION BY f) AS rank FROM total),
    kept AS (SELECT f, v FROM ranked WHERE f IN ('l_returnflag', 'sparse is present') AND rank >= 0.7 UNION ALL SELECT f, CAST(i AS VARCHAR) FROM (VALUES ('l_quantity'), ('l_extendedprice')) t(f), range(10) r(i) UNION ALL SELECT DISTINCT f, CAST(NULL AS VARCHAR) FROM cells),
    there AS (SELECT f, part, sum(n) AS n FROM counts GROUP BY 1, 2),
    shares AS (SELECT k.f, t.part, k.v, coalesce(c.n, 0) / t.n AS share FROM kept k JOIN there t ON t.f = k.f LEFT JOIN counts c ON c.f = k.f AND c.part = t.part AND c.v IS NOT DISTINCT FROM k.v),
    lows AS (SELECT f, part, coalesce(min(share) FILTER (share > 0), 1e-4) AS least FROM shares GROUP BY 1, 2),
    filled AS (SELECT f, part, v, CASE WHEN share > 0 THEN share WHEN least <= 1e-4 THEN 1e-4 ELSE least / 1e6 END AS share FROM shares JOIN lows USING (f, part)),
    psi AS (SELECT a.f, a.part, sum((b.share - a.share) * ln(b.share / a.share)) AS psi FROM filled a JOIN filled b ON b.part = 0 AND a.part > 0 AND b.f = a.f AND b.v IS NOT DISTINCT FROM a.v GROUP BY 1, 2)
    SELECT f AS feature, round(max(psi), 6) + 0.0 AS psi FROM psi GROUP BY 1""")
def _feature_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("sparse", F.when(F.col("l_linenumber") > 2, F.col("l_tax")))
    sparse = stability.with_nulls(rows, ["sparse", "l_tax"])
    found = stability.feature_psi(rows, ["l_quantity", "l_extendedprice", "l_returnflag"], "l_shipdate", ["l_returnflag"], presence=sparse)
    return rounded(spark.createDataFrame(list(found.items()), "feature string, psi double"))


@query("spearman", """
    WITH r AS (SELECT p_size AS x, p_retailprice AS y, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rx,
                      rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS ry FROM part)
    SELECT 'p_size' AS "column", round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def _spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.evaluation import correlations

    return rounded(correlations(table(spark, sf_dir, "part"), ["p_size"], "p_retailprice"))


@query("parquet_filter_sort", "SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem WHERE l_discount > 0 ORDER BY l_shipdate, l_orderkey, l_linenumber")
def _filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_discount > 0")
    return rows.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice").orderBy("l_shipdate", "l_orderkey", "l_linenumber")

