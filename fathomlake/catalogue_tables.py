"""More queries, of what works on whole tables: sources, keys, cleaning, samples, folds, scores, stability, streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _DAILY, _LINE, _daily, _event, _series, _shipped, _W7, formula, query, rounded, table
from .functions import keys as keyfn
from .operators import cleaning, enrichment, evaluation, ordering, sampling, stability, targets, timelines
from .plans.compiler import features
from .plans.formula import parse
from .plans.operator import Operator, find, unregister
from .sources import files
from .sources.registry import Enricher, Registry, Source, select_features, with_literals
from .streaming import stream_features, windowed


def _values(rows: list[tuple], columns: str) -> str:
    say = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) t({columns})"


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; in local mode without one, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='fathomlake-')}/{name}-{uuid.uuid4().hex}"


# Formulas

_FORMULAS = [
    ("(a+b)", "+", "a,b", "f_a_f_b_autofe_add"), ("abs((a/b))", "abs", "a,b", "f_a_f_b_autofe_div_abs"), ("GroupByThenMin(f2,f1)", "GroupByThenMin", "f2,f1", "f_f2_f_f1_autofe_groupbythenmin"),
    ("mean(a,b,c)", "mean", "a,b,c", "f_a_f_b_f_c_autofe_mean"), ("roll_3D_mean_offset_1D(d,k,v)", "roll_3D_mean_offset_1D", "d,k,v", "f_d_f_k_f_v_autofe_roll_3d_mean_offset_1d"),
    ("date_diff_Y_18_23_count(a,b)", "date_diff_Y_18_23_count", "a,b", "f_a_f_b_autofe_date_diff_y_18_23_count"), ("lag_1D(d,roll_3D_mean(d,v))", "lag_1D", "d,v", "f_d_f_v_autofe_roll_3d_mean_lag_1d"),
]


@query("formula_names", _values([(f, f, *rest) for f, *rest in _FORMULAS], "formula, printed, operator, columns, display"))
def _formula_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas read and printed; their operators, columns and display names."""
    nodes = [(f, parse(f)) for f, *_ in _FORMULAS]
    return spark.createDataFrame([(f, n.formula(), n.op.formula(), ",".join(dict.fromkeys(n.columns())), n.display_name()) for f, n in nodes], "formula string, printed string, operator string, columns string, display string")


@query("formula_hash", "SELECT '(a/b)' AS formula, left(sha256('/_a_b'), 10) AS hash UNION ALL SELECT '(b/a)', left(sha256('/_b_a'), 10)")
def _formula_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f, parse(f).digest()) for f in ("(a/b)", "(b/a)")], "formula string, hash string")


_OPERATORS = [("add", "+"), ("freq", "freq"), ("GroupByThenMin", "GroupByThenMin"), ("date_diff_Y_18_23_count", "date_diff_Y_18_23_count"), ("roll_3d_mean", "roll_3d_mean"), ("nothing", None)]


@query("registry_lookup", _values(_OPERATORS, "name, operator"))
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(name, find(name)) for name, _ in _OPERATORS]
    return spark.createDataFrame([(name, op and op.formula()) for name, op in found], "name string, operator string")


@query("formula_params", "SELECT p_partkey, CASE WHEN p_size >= 25 THEN 2 WHEN p_size >= 10 THEN 1 ELSE -1 END AS value FROM part")
def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters given as texts, read back from an operator and set on another one."""
    first = parse("bin(p_size)").set_params({"bin_bounds": "[10, 25]"})
    return features(table(spark, sf_dir, "part"), {"value": parse("bin(p_size)").set_params(first.get_params())}, keep=["p_partkey"])


@query("user_operator", "SELECT p_partkey, CAST(p_size * p_size * p_size AS DOUBLE) AS value FROM part")
def _user_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator that a user adds by a subclass with a name, and takes back."""

    class Cube(Operator):
        name, kind = "cube", "unary"

        def column(self, x):  # noqa: ANN001, ANN202
            return F.pow(x.cast("double"), F.lit(3.0))

    out = features(table(spark, sf_dir, "part"), {"value": "cube(p_size)"}, keep=["p_partkey"])
    unregister("cube")
    return out


for _op, _sql in {"Prod": "product(1 + l_tax)", "Sem": "stddev_samp(1 + l_tax) / sqrt(count(*))", "Skew": "CASE WHEN count(*) < 3 THEN NULL WHEN max(l_tax) = min(l_tax) THEN 0.0 ELSE skewness(1 + l_tax) END + 0.0"}.items():
    formula(
        f"gb_{_op.lower()}", lambda s, d: table(s, d, "lineitem").withColumn("factor", 1 + F.col("l_tax")), _LINE, f"GroupByThen{_op}(factor,l_orderkey)",
        f"SELECT l_orderkey, l_linenumber, round(v, 6) + 0.0 AS value FROM lineitem JOIN (SELECT l_orderkey, {_sql} AS v FROM lineitem GROUP BY 1) USING (l_orderkey)",
    )
formula("roll_7D_var", "events", ["event_id"], "log(roll_7D_var(ts,user_id,value))", f"SELECT event_id, round(ln(nullif(var_samp(value) {_W7}, 0)), 6) AS value FROM events", row_id="event_id")
for _op, _sql in {"q75": f"quantile_cont(value, 0.75) {_W7}", "sem": f"stddev_samp(value) {_W7} / sqrt(nullif(count(value) {_W7} - 1, 0))"}.items():
    _event(f"roll_7D_{_op}", f"roll_7D_{_op}", _sql)
_FRAME7 = f"PARTITION BY event_type ORDER BY epoch_us(day) RANGE BETWEEN {7 * 86_400_000_000 - 1} PRECEDING AND CURRENT ROW"
_series("roll_skew", "roll_7D_skew", f"SELECT day, event_type, round(skewness(total) OVER ({_FRAME7}), 6) AS value FROM ({_DAILY})")
_series("roll_kurt", "roll_7D_kurt", f"SELECT day, event_type, round(kurtosis(total) OVER ({_FRAME7}), 6) AS value FROM ({_DAILY})")
formula(
    "date_diff_epoch", lambda s, d: _shipped(s, d).select(*_LINE, "l_shipdate", F.unix_millis("o_orderdate").alias("ordered")), _LINE, "date_diff(l_shipdate,ordered)",
    "SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey", right_unit="ms",
)


# Files and streams


@query("csv_read", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).option("sep", ";").csv(path)
    return files.read_csv(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal")


@query("parquet_write", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _parquet_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "orders")
    files.write_parquet(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, "zstd", ["o_orderstatus"])
    return files.read_parquet(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parque[t]")
    return stream.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")


@query("stream_rows", "SELECT event_id, round(value * value, 6) AS squared, round(value - floor(value), 6) AS rest FROM events")
def _stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas on a stream of all events, written to a table."""
    out = stream_features(_event_stream(spark, sf_dir), {"squared": "square(value)", "rest": "residual(value)"}).select("event_id", "squared", "rest")
    path = _scratch(spark, "stream")
    out.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema("event_id long, squared double, rest double").parquet(path))


@query("stream_windows", """
    SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, round(avg(value), 6) AS value_mean, count(value) AS value_count FROM events GROUP BY 1, 2, 3""")
def _stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by day of a stream of all events; a row for a day and type is kept on the driver."""
    name = f"windows_{uuid.uuid4().hex}"
    out = windowed(_event_stream(spark, sf_dir), "ts", "value", ["event_type"], "1 day")
    out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.table(name))


# Keys


@query("detect_keys", _values([("c_phone", "phone"), ("home_email", "email"), ("joined_date", "date"), ("country", "country"), ("zip", "postal_code")], '"column", kind'))
def _detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        key, F.concat(F.lit("+1 202 555 "), F.lpad((key % 10000).cast("string"), 4, "0")).alias("c_phone"), F.concat(F.lit("u"), key, F.lit("@mail.example.com")).alias("home_email"),
        F.date_add(F.lit("2020-01-01").cast("date"), (key % 900).cast("int")).cast("string").alias("joined_date"), F.element_at(F.array(*map(F.lit, ["US", "DE", "FR"])), (key % 3 + 1).cast("int")).alias("country"),
        F.lpad((10000 + key % 80000).cast("string"), 5, "0").alias("zip"), (key * 1.5).alias("score"),
    )
    return spark.createDataFrame(list(keyfn.detect(c.drop("c_custkey")).items()), "`column` string, kind string")


_KEY_SETS = [({"a": "email", "b": "phone"}, True, True), ({"a": "date", "b": "datetime"}, False, False), ({"a": "postal_code"}, False, True), ({"a": "postal_code", "b": "country"}, True, True), ({"a": "date", "b": "date"}, False, False), ({"a": "phone", "b": "date"}, True, False)]


@query("key_sets", _values([("+".join(k.values()), ok, today) for k, ok, today in _KEY_SETS], "kinds, valid, needs_today"))
def _key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of keys go together, and which need the current date."""

    def valid(keys: dict[str, str]) -> bool:
        try:
            keyfn.validate_keys(keys)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([("+".join(k.values()), valid(k), keyfn.needs_current_date(k)) for k, *_ in _KEY_SETS], "kinds string, valid boolean, needs_today boolean")


@query("key_groups", "SELECT 'c_mktsegment' AS name UNION ALL SELECT 'c_nationkey'")
def _key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns whose values folds must not tear apart: without phones or addresses those that vary."""
    c = table(spark, sf_dir, "customer").withColumn("one", F.lit(1))
    return spark.createDataFrame([(g,) for g in timelines.group_columns(c, {"c_mktsegment": "custom_key", "c_nationkey": "custom_key", "one": "custom_key"})], "name string")


@query("key_phone_prefix", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 12000000000 + c_custkey WHEN c_custkey % 3 = 1 THEN 2000000000 + c_custkey ELSE 40000000 + c_custkey END AS value FROM customer")
def _phone_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten digits get the code of the US, whose numbers have ten; others and those of no country stay."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 3 == 2, key + 40_000_000).otherwise(key + 2_000_000_000).alias("p"), F.when(key % 3 != 1, F.lit("US")).alias("c"))
    return c.select("c_custkey", keyfn.phone_with_prefix(F.col("p"), F.col("c")).alias("value"))


for _name, _unit in (("s", 1_000_000), ("ms", 1000), ("us", 1)):

    def _epoch(spark: SparkSession, sf_dir: str, unit: int = _unit) -> DataFrame:
        o = table(spark, sf_dir, "orders").select("o_orderkey", (F.unix_micros("o_orderdate") / unit).cast("long").alias("t"))
        return o.select("o_orderkey", keyfn.date_key(keyfn.parse_dates(o, "t")).alias("value"))

    query(f"key_epoch_{_name}", "SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '1999-12-31' THEN epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) END AS value FROM orders")(_epoch)


@query("key_short_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN epoch_ms(CAST(CAST(o_orderdate + INTERVAL 10 YEAR AS DATE) AS TIMESTAMP)) END AS value FROM orders")
def _short_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of fewer than six digits are no dates."""
    later = F.col("o_orderdate") + F.expr("interval 10 years")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.date_format(later, "dd.MM.yyyy")).otherwise(F.lit("1.1.20")).alias("d"))
    return o.select("o_orderkey", keyfn.date_key(keyfn.parse_dates(o, "d")).alias("value"))


@query("key_cyclical", """
    SELECT event_id, round(sin(6.283185307179586 * hour(ts) / 24.0), 6) + 0.0 AS hour_24_sin, round(cos(6.283185307179586 * minute(ts) / 60.0), 6) + 0.0 AS minute_60_cos,
           round(sin(6.283185307179586 * date_diff('day', date_trunc('quarter', ts), ts) / date_diff('day', date_trunc('quarter', ts), date_trunc('quarter', ts) + INTERVAL 3 MONTH)), 6) + 0.0 AS day_in_quarter_sin FROM events""")
def _cyclical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = keyfn.cyclical(F.col("ts"))
    return rounded(table(spark, sf_dir, "events").select("event_id", *[c[n].alias(n) for n in ("hour_24_sin", "minute_60_cos", "day_in_quarter_sin")]))


# Cleaning


@query("normal_forms", """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END AS flag, c_custkey + 0.5 AS comma, left(repeat(c_name, 1500), 24573) AS long,
           sha256('u' || c_custkey || '@mail.example.com') AS mail FROM customer""")
def _normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans, numbers with decimal commas, long texts and an address in their normal forms."""
    key = F.col("c_custkey")
    c = files.spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")  # a row grows by 24 KB
    c = c.select("c_custkey", (key % 2 == 0).alias("flag"), F.concat(key, F.lit(",5")).alias("comma"), F.repeat("c_name", F.lit(1500)).alias("long"), F.concat(F.lit("U"), key, F.lit("@Mail.Example.com")).alias("mail"))
    return cleaning.normalize(c, {"mail": "email"})


@query("normal_names", "SELECT name, CASE WHEN regexp_matches(lower(name), '^[a-z]') THEN '' ELSE 'a' END || regexp_replace(lower(name), '[^a-z0-9_]', '_', 'g') || '_' || left(sha256(name), 6) AS new FROM (VALUES ('Total Price'), ('9lives'), ('plain')) t(name)")
def _normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(cleaning.normal_names(["Total Price", "9lives", "plain"]).items()), "name string, new string")


@query("renamed", "SELECT r_regionkey AS id, r_name AS title FROM region")
def _renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.rename(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), {"r_regionkey": "id", "r_name": "title"})


@query("literals", "SELECT n_nationkey, 'US' AS country, DATE '2024-05-01' AS today FROM nation")
def _literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    return with_literals(table(spark, sf_dir, "nation").select("n_nationkey"), {"country": "US", "today": datetime.date(2024, 5, 1)})


@query("dummies", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders")
def _dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.dummies(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@query("beside", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return enrichment.beside([o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_orderstatus")], "o_orderkey")


@query("hash_ids", "SELECT count(*) AS rows, count(DISTINCT (c_nationkey, c_mktsegment)) AS ids FROM customer")
def _hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.hash_ids(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"]).agg(F.count("*").alias("rows"), F.count_distinct("entity_system_record_id").alias("ids"))


@query("digest", "SELECT true AS same_in_any_order, false AS same_without_a_row")
def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    whole = cleaning.digest(n)
    return spark.createDataFrame([(whole == cleaning.digest(n.repartition(7)), whole == cleaning.digest(n.filter("n_nationkey > 0")))], "same_in_any_order boolean, same_without_a_row boolean")


@query("whole_numbers", _values([("l_quantity", True), ("l_tax", False), ("l_linenumber", True), ("l_returnflag", False)], "name, whole"))
def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(c, cleaning.whole_numbers(lines, c)) for c in ("l_quantity", "l_tax", "l_linenumber", "l_returnflag")], "name string, whole boolean")


@query("segments_full_dedup", """
    WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 0 ELSE 1 END AS segment, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN CAST(o_totalprice > 200000 AS INTEGER) END AS target FROM orders),
    d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, target ORDER BY segment, o_orderkey) AS place FROM r),
    n AS (SELECT *, count(*) FILTER (segment = 0) OVER (PARTITION BY o_custkey, o_orderpriority) AS times FROM d WHERE place = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE WHEN segment = 0 THEN 0 ELSE 1 END, segment, o_orderkey) AS first FROM n WHERE segment > 0 OR times = 1)
    SELECT o_orderkey, segment, target FROM k WHERE first = 1""")
def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates over a training segment and one without targets."""
    early = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    r = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.when(early, 0).otherwise(1).alias("segment"), F.when(early, (F.col("o_totalprice") > 200000).cast("int")).alias("target"))
    return cleaning.drop_full_duplicates(r, "o_orderkey", "target", "segment").select("o_orderkey", "segment", "target")


# Targets


@query("numeric_target", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS y FROM lineitem")
def _numeric_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.numeric_target(table(spark, sf_dir, "lineitem").select(*_LINE, F.col("l_quantity").cast("string").alias("y")), "y")


@query("imbalance", """
    SELECT 'o_orderstatus' AS name, min(n) < 0.6 / count(*) * sum(n) AS imbalanced FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
    UNION ALL SELECT 'o_orderpriority', min(n) < 0.6 / count(*) * sum(n) FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def _imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return spark.createDataFrame([(c, targets.is_imbalanced(o, c, targets.MULTICLASS)) for c in ("o_orderstatus", "o_orderpriority")], "name string, imbalanced boolean")


@query("outliers_top", """
    WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)
    SELECT o_orderkey, o_totalprice FROM orders, s WHERE abs(o_totalprice - m) > 1.5 * s ORDER BY abs(o_totalprice - m) DESC, o_orderkey LIMIT 3""")
def _outliers_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three that are farthest from the mean."""
    return targets.outliers(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 1.5).limit(3)


# Samples and folds


def _flags(spark: SparkSession, sf_dir: str, dear: int) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > dear).cast("int").alias("y"))


@query("balance_binary", """
    WITH c AS (SELECT CAST(o_totalprice > 400000 AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT min(n) AS least, sum(n) AS total FROM c)
    SELECT y, CAST(CASE WHEN total <= 1000 OR n = least THEN n ELSE least(n, 5 * (least + greatest(1000 - 2 * least, 0))) END AS BIGINT) AS n FROM c, m""")
def _balance_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balance(_flags(spark, sf_dir, 400_000), "y", "BINARY", "o_orderkey", binary_rows=1000).groupBy("y").agg(F.count("*").alias("n"))


@query("balance_multiclass", """
    WITH c AS (SELECT o_orderstatus AS y, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT min(n) AS least, sum(n) AS total, count(*) AS k, max(n) AS most FROM c),
    t AS (SELECT *, 2 * (least + greatest((1000 - k * least) / (k - 1), 0)) AS top FROM m)
    SELECT y, CAST(CASE WHEN total <= 1000 OR most <= 2 * least OR n = least THEN n ELSE least(n, floor(top)) END AS BIGINT) AS n FROM c, t""")
def _balance_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("y"))
    return sampling.balance(o, "y", "MULTICLASS", "o_orderkey", multi_rows=1000).groupBy("y").agg(F.count("*").alias("n"))


@query("forced_sample", """
    WITH c AS (SELECT CAST(o_totalprice > 300000 AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT min(n) AS least, sum(n) AS total FROM c)
    SELECT y, CAST(CASE WHEN total <= 1000 THEN n WHEN n = least THEN least(n, 500) ELSE least(n, 1000 - least(least, 500)) END AS BIGINT) AS n FROM c, m""")
def _forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.forced_sample(_flags(spark, sf_dir, 300_000), "y", "BINARY", "o_orderkey", 1000).groupBy("y").agg(F.count("*").alias("n"))


@query("series_sample", """
    WITH p AS (SELECT user_id, max(ts) AS last, count(*) AS n FROM events GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY last DESC, n DESC) AS total FROM p)
    SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM s WHERE total <= (SELECT count(*) / 2 FROM events))""")
def _series_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole series of the users seen last, half of all rows."""
    e = table(spark, sf_dir, "events")
    return sampling.sample_series(e, ["user_id"], "ts", int(e.count() / 2)).select("event_id")


@query("series_truncated", "SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id) AS last FROM events) WHERE ts > last - INTERVAL 30 MONTH")
def _series_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return sampling.truncated_series(e, ["user_id"], "ts", e.count()).select("event_id")


@query("folds_k", "SELECT count(*) AS rows, 5 AS folds, 0 AS torn FROM events")
def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event has one of five folds, and no user is in two."""
    f = sampling.k_folds(table(spark, sf_dir, "events"), "event_id", 5, groups=["user_id"])
    torn = f.groupBy("user_id").agg(F.count_distinct("fold").alias("k")).filter("k > 1").count()
    return f.agg(F.count("*").alias("rows"), F.count_distinct("fold").cast("int").alias("folds")).withColumn("torn", F.lit(torn).cast("int"))


@query("folds_shuffled", "SELECT count(*) AS rows, 0 AS torn FROM events")
def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sampling.shuffle_split(table(spark, sf_dir, "events"), ["user_id"])
    torn = s.groupBy("user_id").agg(F.count_distinct("is_test").alias("k")).filter("k > 1").count()
    return s.agg(F.count("*").alias("rows")).withColumn("torn", F.lit(torn).cast("int"))


@query("folds_stratified", """
    SELECT o_orderstatus, CAST(f AS INTEGER) AS fold, CAST(n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), range(5) r(f)""")
def _stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sampling.stratified_folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", F.xxhash64("o_orderkey"))
    return f.groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"))


@query("folds_expanding", "SELECT i AS fold, n - (5 - i) * (n // 6) AS train, n // 6 AS test FROM (SELECT count(*) AS n FROM orders), range(5) r(i)")
def _expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = sampling.expanding_folds(table(spark, sf_dir, "orders").count())
    return spark.createDataFrame([(i, len(a), len(b)) for i, (a, b) in enumerate(folds)], "fold long, train long, test long")


@query("fold_choice", _values([("REGRESSION", "k_fold"), ("BINARY", "group_k_fold"), ("MULTICLASS", "group_k_fold")], "task, folds"))
def _choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    return spark.createDataFrame([(t, timelines.cross_validation(o, {"o_custkey": "custom_key"}, t, "o_totalprice")) for t in ("REGRESSION", "BINARY", "MULTICLASS")], "task string, folds string")


@query("time_structure", f"""
    WITH d AS ({_DAILY}), c AS (SELECT day, count(*) AS n FROM d GROUP BY 1), g AS (SELECT n, epoch_us(day) - lag(epoch_us(day)) OVER (ORDER BY day) AS gap FROM c),
    e AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), h AS (SELECT n, row_number() OVER (ORDER BY day) > round_even(count(*) OVER () / 2.0, 0) AS late FROM e)
    SELECT (SELECT count(DISTINCT n) = 1 AND count(DISTINCT gap) = 1 FROM g) AS is_series, (SELECT avg(n) FILTER (late) / avg(n) FILTER (NOT late) BETWEEN 0.8 AND 1.2 FROM h) AS is_even""")
def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(timelines.is_time_series(_daily(spark, sf_dir), "day"), timelines.dates_are_even(table(spark, sf_dir, "events"), "ts"))], "is_series boolean, is_even boolean")


# Scores


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select((F.col("l_extendedprice") / 1000).alias("t"), F.col("l_quantity").cast("double").alias("p"), (F.col("l_discount") > 0.05).cast("int").alias("y"), (F.col("l_tax") > 0.04).cast("int").alias("c"), F.col("l_tax").alias("q"))


_SCORES = {
    "mae": "avg(abs(p - t))", "mse": "avg((p - t) * (p - t))", "rmse": "sqrt(avg((p - t) * (p - t)))", "mape": "avg(abs(p - t) / abs(t))", "msle": "avg(power(ln(1 + p) - ln(1 + t), 2))",
    "rmsle": "sqrt(avg(power(ln(1 + p) - ln(1 + t), 2)))", "r2": "1 - avg((p - t) * (p - t)) / var_pop(t)", "max_error": "max(abs(p - t))", "median_absolute_error": "median(abs(p - t))",
    "explained_variance": "1 - var_pop(p - t) / var_pop(t)", "accuracy": "avg(CAST(y = c AS INTEGER))", "precision": "sum(y * c) / sum(c)", "recall": "sum(y * c) / sum(y)", "f1": "2 * sum(y * c) / (sum(c) + sum(y))",
    "balanced_accuracy": "(sum(y * c) / sum(y) + sum((1 - y) * (1 - c)) / sum(1 - y)) / 2", "brier_score": "avg((q - y) * (q - y))", "log_loss": "-avg(y * ln(greatest(q, 1e-15)) + (1 - y) * ln(1 - greatest(q, 1e-15)))",
}
_LINES = "(SELECT l_extendedprice / 1000 AS t, CAST(l_quantity AS DOUBLE) AS p, CAST(l_discount > 0.05 AS INTEGER) AS y, CAST(l_tax > 0.04 AS INTEGER) AS c, l_tax AS q FROM lineitem)"
_PAIR = {n: ("y", "c") if n in ("accuracy", "precision", "recall", "f1", "balanced_accuracy") else ("y", "q") if n in ("brier_score", "log_loss") else ("t", "p") for n in _SCORES}


@query("scores", " UNION ALL ".join(f"SELECT '{n}' AS metric, round({s}, 6) AS score FROM {_LINES}" for n, s in _SCORES.items()) + f" UNION ALL SELECT 'own', round(avg(p) - avg(t), 6) FROM {_LINES}")
def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores but those of ranks, and one of the user's own."""
    rows = _predicted(spark, sf_dir)
    own = lambda d: d.agg(F.avg("p") - F.avg("t")).first()[0]
    got = [(n, evaluation.score(rows, n, *_PAIR[n])) for n in _SCORES] + [("own", evaluation.score(rows, own, "t", "p"))]
    return rounded(spark.createDataFrame(got, "metric string, score double"))


_AUC = """(sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))
    FROM (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM {})"""


@query("roc_auc", f"SELECT round(a, 6) AS roc_auc, round(2 * a - 1, 6) AS gini FROM (SELECT {_AUC.format('(SELECT y, q AS x FROM ' + _LINES + ')')}) t(a)")
def _roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir)
    return rounded(spark.createDataFrame([tuple(evaluation.score(rows, m, "y", "q") for m in ("roc_auc", "gini"))], "roc_auc double, gini double"))


@query("target_encoding", """
    SELECT l_returnflag, round((sum(y) + 10 * (SELECT avg(CAST(l_discount > 0.05 AS DOUBLE)) FROM lineitem)) / (count(*) + 10), 6) AS l_returnflag_encoded
    FROM (SELECT l_returnflag, CAST(l_discount > 0.05 AS DOUBLE) AS y FROM lineitem) GROUP BY 1""")
def _encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_discount") > 0.05).cast("int").alias("y"))
    return rounded(evaluation.target_encoding(rows, ["l_returnflag"], "y")["l_returnflag"])


@query("cross_validate", "SELECT 'gini' AS metric, 1.0 AS mean, 0.0 AS std, 'hint' AS best")
def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds with a model of the user's, on a text that tells the target."""
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", F.col("quality").alias("y"), F.concat(F.lit("q"), "quality").alias("hint"), (F.col("doc_id") % 7).alias("noise"))
    got = evaluation.cross_validate(sampling.k_folds(rows, "doc_id", 3), ["hint", "noise"], "y", "BINARY", "fold", "gini", DecisionTreeClassifier())
    return spark.createDataFrame([("gini", got["mean"], got["std"], next(iter(got["importance"])))], "metric string, mean double, std double, best string")


@query("uplift", _values([("train", "gini", 0.5, 0.6, 0.1, 20.0), ("later", "mae", 4.0, 3.0, 1.0, 25.0)], "segment, metric, baseline, enriched, uplift, uplift_percent"))
def _uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = [(s, m, *evaluation.uplift(a, b, m).values()) for s, m, a, b in (("train", "gini", 0.5, 0.6), ("later", "mae", 4.0, 3.0))]
    return rounded(spark.createDataFrame(got, "segment string, metric string, baseline double, enriched double, uplift double, uplift_percent double"))


@query("drift", f"""
    SELECT 'later' AS segment, round(greatest(a, 1 - a), 6) AS drift_auc FROM (SELECT {_AUC.format("(SELECT CAST(o_orderdate >= TIMESTAMP '1997-01-01' AS INTEGER) AS y, o_totalprice AS x FROM orders)")}) t(a)""")
def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, early = table(spark, sf_dir, "orders"), F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    got = evaluation.drift(o.filter(early), {"later": o.filter(~early)}, ["o_totalprice"])
    return rounded(spark.createDataFrame([(g["segment"], g["drift_auc"]) for g in got], "segment string, drift_auc double"))


@query("column_order", """
    WITH r AS (SELECT l_extendedprice AS y, unnest(['l_quantity', 'l_discount', 'l_tax']) AS c, unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem),
    k AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY x) + (count(*) OVER (PARTITION BY c, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY c ORDER BY y) + (count(*) OVER (PARTITION BY c, y) - 1) / 2.0 AS ry FROM r)
    SELECT row_number() OVER (ORDER BY trunc(greatest(abs(corr(x, y)), abs(corr(rx, ry))) * 1e7) DESC, sha256(c)) - 1 AS place, c AS name FROM k GROUP BY c""")
def _column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluation.column_order(table(spark, sf_dir, "lineitem"), [], ["l_tax", "l_discount", "l_quantity"], "l_extendedprice")
    return spark.createDataFrame(list(enumerate(got)), "place long, name string")


@query("feature_selection", _values([(0, "d"), (1, "b"), (2, "k")], "place, name"))
def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(select_features({"a": 0.2, "b": 0.3, "c": 0.0, "d": 0.5, "k": 0.0}, {"b": 0.1, "d": 0.1}, keep=["k"]))), "place int, name string")


# Distributions


@query("quantiles", " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS p, round(quantile_cont(l_extendedprice, {p}), 6) AS value FROM lineitem" for p in (0.0, 0.1, 0.5, 0.75, 1.0)))
def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = ordering.quantiles(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), shares)
    return rounded(spark.createDataFrame(list(zip(shares, got)), "p double, value double"))


@query("date_intervals", f"""
    WITH e AS (SELECT epoch_us(o_orderdate) AS t FROM orders), q AS (SELECT {', '.join(f'quantile_cont(t, {i / 10}) AS q{i}' for i in range(1, 10))} FROM e)
    SELECT CAST({' + '.join(f'CAST(t > q{i} AS INTEGER)' for i in range(1, 10))} AS INTEGER) AS part, count(*) AS n FROM e, q GROUP BY 1""")
def _date_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(stability.intervals(o, "o_orderdate", 10).alias("part")).agg(F.count("*").alias("n"))


@query("ks", """
    WITH r AS (SELECT o_totalprice AS x, CAST(o_orderdate < TIMESTAMP '1997-01-01' AS INTEGER) AS a FROM orders), v AS (SELECT x, sum(a) AS a, sum(1 - a) AS b FROM r GROUP BY 1),
    c AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS ca, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS cb FROM v) SELECT round(max(abs(ca - cb)), 6) AS d FROM c""")
def _ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, early = table(spark, sf_dir, "orders"), F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    return rounded(spark.createDataFrame([(stability.ks_statistic(o.filter(early), o.filter(~early), "o_totalprice"),)], "d double"))


# Enricher


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with addresses in capitals, the second one of every other customer."""
    mail = lambda what: F.concat(F.lit(what), F.col("c_custkey"), F.lit("@Mail.Example.com"))
    even = F.col("c_custkey") % 2 == 0
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), "c_acctbal", F.when(even, mail("USER")).alias("email"), mail("User").alias("second"), F.lit("2024-06-30").alias("seen"))


def _spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return o.select(F.concat(F.lit("user"), "o_custkey", F.lit("@mail.example.com")).alias("address"), "n_orders", "spent")


_SPENT = "(SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1)"


def _enricher(spark: SparkSession, sf_dir: str, keys: dict[str, str], **source: object) -> Enricher:
    registry = Registry()
    registry.register(Source("spending", _spending(spark, sf_dir), {"address": "email"}, **source), 1)
    return Enricher(registry, keys, detect_keys=False)


@query("enricher_transform", f"SELECT c_custkey AS row_id, n_orders, round(spent, 6) AS spent FROM customer LEFT JOIN {_SPENT} ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def _enricher_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address, compared in its normal form."""
    out = _enricher(spark, sf_dir, {"email": "email"}).transform(_people(spark, sf_dir), keep_input=False)
    return rounded(out.select("row_id", "n_orders", "spent"))


@query("enricher_several_keys", f"SELECT c_custkey AS row_id, n_orders, round(spent, 6) AS spent FROM customer LEFT JOIN {_SPENT} ON o_custkey = c_custkey")
def _enricher_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of addresses, of which the first that matches counts; no row is multiplied."""
    return rounded(_enricher(spark, sf_dir, {"email": "email", "second": "email"}).transform(_people(spark, sf_dir)).select("row_id", "n_orders", "spent"))


@query("enricher_as_of", """
    WITH s AS (SELECT o_custkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS snap, min(o_totalprice) AS price FROM orders GROUP BY 1, 2), c AS (SELECT c_custkey, TIMESTAMP '1997-03-01' AS seen FROM customer)
    SELECT c_custkey AS row_id, round(price, 6) AS price FROM c ASOF LEFT JOIN s ON o_custkey = c_custkey AND seen >= snap""")
def _enricher_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price up to a date that is a text."""
    source = table(spark, sf_dir, "orders").groupBy("o_custkey", F.date_trunc("DAY", "o_orderdate").alias("at")).agg(F.min("o_totalprice").alias("price"))
    registry = Registry()
    registry.register(Source("prices", source, {"o_custkey": "custom_key"}, snapshot="at"), 1)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_custkey").alias("who"), F.lit("1997-03-01").alias("seen"))
    return rounded(Enricher(registry, {"who": "custom_key", "seen": "date"}, detect_keys=False).transform(c).select("row_id", "price"))


@query("enricher_ranges", """
    WITH r AS (SELECT p_partkey * 37 % 5000 AS lo, p_partkey * 37 % 5000 + p_size AS hi, p_partkey AS part FROM part),
    m AS (SELECT o_orderkey, part, row_number() OVER (PARTITION BY o_orderkey ORDER BY lo, hi, part) AS place FROM orders LEFT JOIN r ON o_custkey BETWEEN lo AND hi) SELECT o_orderkey AS row_id, part FROM m WHERE place = 1""")
def _enricher_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of overlapping ranges the first counts."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") * 37 % 5000).alias("lo"), (F.col("p_partkey") * 37 % 5000 + F.col("p_size")).alias("hi"), F.col("p_partkey").alias("part"))
    registry = Registry()
    registry.register(Source("parts", p, {}, ranges={"custom_key": ("lo", "hi")}, range_width=50), 1)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey")
    return Enricher(registry, {"o_custkey": "custom_key"}, detect_keys=False).transform(o).select("row_id", "part")


@query("enricher_hit_rate", f"""
    WITH c AS (SELECT c_custkey, CAST(c_acctbal > 5000 AS INTEGER) AS y FROM customer), m AS (SELECT c.c_custkey, n_orders FROM c LEFT JOIN {_SPENT} ON o_custkey = c_custkey WHERE c_custkey % 2 = 0)
    SELECT key, count(*) AS rows, count(n_orders) AS matched, round(count(n_orders) / count(*), 6) AS hit_rate FROM m, (VALUES ('all'), ('email')) k(key) GROUP BY 1""")
def _enricher_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir).select("row_id", "email", (F.col("c_acctbal") > 5000).cast("int").alias("y"))
    return rounded(_enricher(spark, sf_dir, {"email": "email"}).fit(people, "y").hit_rates["spending"])


@query("enricher_metrics", f"""
    WITH c AS (SELECT CAST(n_orders > 10 AS INTEGER) AS y, c_nationkey FROM customer JOIN {_SPENT} ON o_custkey = c_custkey)
    SELECT 'train' AS segment, count(*) AS rows, round(avg(y), 6) AS mean_target, 1.0 AS enriched FROM c UNION ALL SELECT 'abroad', count(*), round(avg(y), 6), 1.0 FROM c WHERE c_nationkey >= 12""")
def _enricher_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores without and with a source that tells the target, of all customers and of an evaluation table."""
    from pyspark.ml.classification import DecisionTreeClassifier

    busy = _spending(spark, sf_dir).select("address", F.when(F.col("n_orders") > 10, "busy").otherwise("calm").alias("kind"))
    registry = Registry()
    registry.register(Source("busy", busy, {"address": "email"}), 1)
    mail = F.concat(F.lit("USER"), F.col("c_custkey"), F.lit("@Mail.Example.com")).alias("email")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count("*") > 10).cast("int").alias("y"))
    people = table(spark, sf_dir, "customer").join(n, "c_custkey").select(F.col("c_custkey").alias("row_id"), mail, "c_acctbal", "c_nationkey", "y")
    enricher = Enricher(registry, {"email": "email"}, detect_keys=False)
    got = enricher.calculate_metrics(people.drop("c_nationkey"), "y", {"abroad": people.filter("c_nationkey >= 12").drop("c_nationkey")}, folds=2, estimator=DecisionTreeClassifier())
    return rounded(got.select("segment", "rows", "mean_target", "enriched"))
