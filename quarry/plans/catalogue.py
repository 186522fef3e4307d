"""Queries over the shared tables, each with its SQL twin where there is one.

Tables hold no missing values, so some are made by a predicate on the key,
written alike on both sides. Reals are rounded on both sides.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import missing as M
from quarry.functions.values import modes
from quarry.operators import evaluate as E
from quarry.operators import models as mod
from quarry.operators import prepare as P
from quarry.operators import profile as pr

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVENTS = "(SELECT event_id, event_type, user_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS value, CASE WHEN event_id % 7 = 2 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS uid, CASE WHEN event_id % 5 = 1 THEN ' N/A' ELSE event_type END AS kind FROM events)"


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    """events with missing values of three sorts: null, NaN and a token."""
    e = t(spark, sf, "events")
    return e.select(
        "event_id", "event_type", "user_id",
        F.when(F.col("event_id") % 10 != 3, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 7 == 2, F.lit(float("nan"))).otherwise(F.col("user_id").cast("double")).alias("uid"),
        F.when(F.col("event_id") % 5 == 1, F.lit(" N/A")).otherwise(F.col("event_type")).alias("kind"),
    )


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


_SKEW = "CASE WHEN count({c}) < 3 THEN NULL WHEN min({c}) = max({c}) THEN 0.0 ELSE skewness({c}) END"
_KURT = "CASE WHEN count({c}) < 4 THEN NULL WHEN min({c}) = max({c}) THEN 0.0 ELSE kurtosis({c}) END"


def profile_sql(columns: list[str], table: str) -> str:
    one = """SELECT '{c}' AS name, count({c})::BIGINT AS count, (count(*) - count({c}))::BIGINT AS missing, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
    round((SELECT {c} FROM {t} x WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)::DOUBLE, 4) AS mode, round(stddev_samp({c}), 4) AS std, round(var_samp({c}), 2) AS variance, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max,
    round((max({c}) - min({c}))::DOUBLE, 4) AS range, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, round(""" + _SKEW + """, 4) AS skewness, round(""" + _KURT + """, 4) AS kurtosis FROM {t} z"""  # fmt: skip
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


def profiled(df: DataFrame, columns: list[str]) -> DataFrame:
    out = pr.profile(df, columns)
    return out.select(*[F.round(c, 2 if c == "variance" else 4).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


@query("profile_lineitem", profile_sql(LINE, "lineitem"))
def profile_lineitem(spark, sf):
    return profiled(t(spark, sf, "lineitem"), LINE)


@query("profile_with_missing", profile_sql(["value", "uid"], EVENTS))
def profile_with_missing(spark, sf):
    return profiled(gaps(spark, sf), ["value", "uid"])


def _stats(name: str, table: str, columns: list[str], chosen: dict[str, str]) -> None:
    """One row a column with a few statistics of the profile."""
    sql = " UNION ALL ".join(f"SELECT '{c}' AS name, " + ", ".join(f"round(({e.format(c=c)})::DOUBLE, 3) AS {s}" for s, e in chosen.items()) + f" FROM {table}" for c in columns)

    @query(name, sql)
    def run(spark, sf):
        return pr.profile(t(spark, sf, table), columns).select("name", *[F.round(s, 3).alias(s) for s in chosen])


_stats("stats_mean_var_std", "lineitem", LINE[:1] + LINE[2:], {"mean": "avg({c})", "variance": "var_samp({c})", "std": "stddev_samp({c})"})
_stats("stats_quantiles", "lineitem", LINE, {"min": "min({c})", "q1": "quantile_cont({c}, 0.25)", "median": "quantile_cont({c}, 0.5)", "q3": "quantile_cont({c}, 0.75)", "max": "max({c})", "range": "max({c}) - min({c})"})
_stats("stats_skew_kurt", "lineitem", LINE, {"skewness": _SKEW, "kurtosis": _KURT})


@query("stats_mode", "SELECT * FROM (SELECT 'l_quantity' AS name, l_quantity::BIGINT::VARCHAR AS mode FROM lineitem GROUP BY l_quantity ORDER BY count(*) DESC, l_quantity LIMIT 1) UNION ALL SELECT * FROM (SELECT 'o_orderpriority' AS name, o_orderpriority AS mode FROM orders GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)")
def stats_mode(spark, sf):
    found = modes(t(spark, sf, "lineitem"), {"l_quantity": F.col("l_quantity").cast("long")}) | modes(t(spark, sf, "orders"), {"o_orderpriority": F.col("o_orderpriority")})
    return spark.createDataFrame([(name, str(v)) for name, v in found.items()], "name string, mode string")


@query("missing_counts", f"SELECT sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS value, sum(CASE WHEN uid IS NULL THEN 1 ELSE 0 END)::BIGINT AS uid, sum(CASE WHEN lower(trim(kind)) IN ('', 'nan', 'none', 'null', 'na', 'n/a') THEN 1 ELSE 0 END)::BIGINT AS kind, count(*)::BIGINT AS n_rows FROM {EVENTS}")
def missing_counts(spark, sf):
    g = gaps(spark, sf)
    return g.agg(*[F.count_if(M.is_missing(F.col(c), g.schema[c].dataType)).alias(c) for c in ("value", "uid", "kind")], F.count("*").alias("n_rows"))


@query("py_float_parse", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id + 0.5 WHEN 1 THEN NULL WHEN 2 THEN 1000.0 * (event_id % 9 + 1) WHEN 3 THEN NULL ELSE -25.0 END::DOUBLE AS number FROM events")
def py_float_parse(spark, sf):
    e = t(spark, sf, "events")
    k, i = F.col("event_id") % 5, F.col("event_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit(" "), i, F.lit(".5 "))).when(k == 1, F.concat(i, F.lit("d"))).when(k == 2, F.concat((F.col("event_id") % 9 + 1).cast("string"), F.lit("_000"))).when(k == 3, F.lit("nan")).otherwise(F.lit("-2.5e1"))
    return e.select("event_id", text.alias("x")).select("event_id", M.to_number(F.col("x"), gaps(spark, sf).schema["kind"].dataType).alias("number"))


def _types_sql(table: str, columns: dict[str, bool]) -> str:
    """Name, type, distinct and missing counts of number (True) and text columns."""
    one = "SELECT '{c}' AS name, CASE WHEN count(DISTINCT {c}) IN (1, 2) AND bool_and(lower({c}::VARCHAR) IN ('true','yes','1','t','y','on','false','no','0','f','n','off','0.0','1.0')) THEN 'boolean' WHEN {n} AND NOT (count(DISTINCT {c}) * 1.0 / count({c}) <= 0.05 AND count(DISTINCT {c}) <= 20) THEN 'numerical' ELSE 'categorical' END AS inferred_type, count(DISTINCT {c})::BIGINT AS n_unique, (count(*) - count({c}))::BIGINT AS n_missing FROM {t}"
    return " UNION ALL ".join(one.format(c=c, n=n, t=table) for c, n in columns.items())


def _types(df: DataFrame) -> DataFrame:
    rows = [(x.name, x.inferred_type, x.n_unique, x.n_missing) for x in pr.detect_types(df)]
    return df.sparkSession.createDataFrame(rows, "name string, inferred_type string, n_unique long, n_missing long")


_LINE_TYPES = {"l_orderkey": True, "l_partkey": True, "l_suppkey": True, "l_linenumber": True, "l_quantity": True, "l_extendedprice": True, "l_discount": True, "l_tax": True, "l_returnflag": False, "l_linestatus": False, "l_shipdate": False}


@query("column_types", _types_sql("lineitem", _LINE_TYPES))
def column_types(spark, sf):
    return _types(t(spark, sf, "lineitem").select(*_LINE_TYPES))


@query("boolean_detect", _types_sql("labels", {"quality": True, "toxic": True}))
def boolean_detect(spark, sf):
    return _types(t(spark, sf, "labels").select("quality", "toxic"))


@query("type_summary", f"SELECT inferred_type, count(*)::BIGINT AS n FROM ({_types_sql('lineitem', _LINE_TYPES)}) GROUP BY 1")
def type_summary(spark, sf):
    return column_types(spark, sf).groupBy("inferred_type").agg(F.count("*").alias("n"))


@query("sample_values", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5")
def sample_values(spark, sf):
    found = pr.detect_types(t(spark, sf, "customer").select("c_custkey", "c_name"), samples=5, order="c_custkey")
    keys, names = ([*x.sample_values] for x in found)
    return spark.createDataFrame(list(zip(keys, names)), "c_custkey long, c_name string")


def _corr_sql(columns: list[str], table: str) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(coalesce(CASE WHEN isnan(corr({b}, {a})) THEN 0 ELSE corr({b}, {a}) END, 0)::DOUBLE, 6) AS r FROM {table} z" for a, b in pairs)


@query("corr_matrix", f"WITH u AS ({_corr_sql(LINE, 'lineitem')}) SELECT * FROM u UNION ALL SELECT y, x, r FROM u UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in LINE))
def corr_matrix(spark, sf):
    return rounded(pr.correlation_matrix(t(spark, sf, "lineitem"), LINE), 6)


@query("corr_pairwise_missing", _corr_sql(["event_id", "value", "uid"], EVENTS))
def corr_pairwise_missing(spark, sf):
    return rounded(pr.correlation(gaps(spark, sf), ["event_id", "value", "uid"]).select("x", "y", "r"), 6)


@query("corr_constant_guard", "SELECT 'l_quantity' AS x, 'flat' AS y, coalesce(covar_pop(l_quantity, 7.0) / nullif(stddev_pop(l_quantity) * stddev_pop(7.0), 0), 0)::DOUBLE AS r FROM lineitem")
def corr_constant_guard(spark, sf):
    return pr.correlation(t(spark, sf, "lineitem").select("l_quantity", F.lit(7.0).alias("flat")), ["l_quantity", "flat"]).select("x", "y", "r")


@query("high_corr_pairs", f"SELECT * FROM ({_corr_sql(['l_quantity', 'l_extendedprice', 'l_tax', 'twice'], '(SELECT *, 2 * l_extendedprice + l_tax AS twice FROM lineitem)')}) WHERE abs(r) >= 0.9")
def high_corr_pairs(spark, sf):
    df = t(spark, sf, "lineitem").withColumn("twice", 2 * F.col("l_extendedprice") + F.col("l_tax"))
    return rounded(pr.high_correlations(df, ["l_quantity", "l_extendedprice", "l_tax", "twice"]).select("x", "y", "r"), 6)


@query("outlier_report", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, round(q1 - 0.5 * (q3 - q1), 4) AS lower, round(q3 + 0.5 * (q3 - q1), 4) AS upper, count(*) FILTER ({c} < q1 - 0.5 * (q3 - q1))::BIGINT AS n_low, count(*) FILTER ({c} > q3 + 0.5 * (q3 - q1))::BIGINT AS n_high, count(*) FILTER ({c} < q1 - 0.5 * (q3 - q1) OR {c} > q3 + 0.5 * (q3 - q1))::BIGINT AS n_total, round(100.0 * count(*) FILTER ({c} < q1 - 0.5 * (q3 - q1) OR {c} > q3 + 0.5 * (q3 - q1)) / count({c}), 4)::DOUBLE AS pct FROM {tb}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {tb}) GROUP BY q1, q3" for c, tb in (("o_totalprice", "orders"), ("c_acctbal", "customer"))))
def outlier_report(spark, sf):
    return rounded(pr.outlier_report(t(spark, sf, "orders"), ["o_totalprice"], 0.5).union(pr.outlier_report(t(spark, sf, "customer"), ["c_acctbal"], 0.5)))


_FENCE = "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"


@query("outlier_rows", f"SELECT 'value' AS \"column\", event_id AS row_id, round(value, 4) AS value FROM events, {_FENCE} WHERE value < q1 - 0.5 * (q3 - q1) OR value > q3 + 0.5 * (q3 - q1)")
def outlier_rows(spark, sf):
    return rounded(pr.outlier_rows(t(spark, sf, "events"), "event_id", ["value"], 0.5))


@query("outlier_cap", f"SELECT event_id, round(least(greatest(value, q1 - 0.5 * (q3 - q1)), q3 + 0.5 * (q3 - q1)), 4) AS value FROM events, {_FENCE}")
def outlier_cap(spark, sf):
    return rounded(pr.cap(t(spark, sf, "events"), ["value"], 0.5).select("event_id", "value"))


_NUMERIC = ["event_id", "user_id", "value", "uid"]
_WARNINGS = " UNION ALL ".join(
    [f"SELECT '''{a}'' and ''{b}'' are nearly collinear (r = ' || format('{{:.4f}}', r) || ')' AS warning FROM (SELECT round(coalesce(corr({a}, {b}), 0), 6) AS r FROM e) WHERE abs(r) >= 0.9 AND (SELECT bool_and(numeric) FROM k WHERE c IN ('{a}', '{b}'))" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]]
    + [f"SELECT '''{c}'' has ' || format('{{:.1f}}', pct) || '% outliers' FROM (SELECT round(100.0 * count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}), 6)::DOUBLE AS pct FROM e, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM e)) WHERE pct > 5 AND (SELECT numeric FROM k WHERE c = '{c}')" for c in _NUMERIC]
    + [f"SELECT '''{c}'' has ' || n || ' missing values (' || format('{{:.1f}}', 100.0 * n / total) || '%)' FROM (SELECT count(*) FILTER ({c} IS NULL OR trim(lower({c}::VARCHAR)) IN ('', 'nan', 'none', 'null', 'na', 'n/a')) AS n, count(*) AS total FROM e) WHERE n > 0" for c in ("event_id", "event_type", "user_id", "value", "uid", "kind")]
)


@query("inspector_warnings", f"WITH e AS (SELECT * FROM {EVENTS}), k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) > 0.05 * count({c}) OR count(DISTINCT {c}) > 20 AS numeric FROM e" for c in _NUMERIC) + f") {_WARNINGS}")
def inspector_warnings(spark, sf):
    return spark.createDataFrame([(w,) for w in pr.inspect(gaps(spark, sf)).warnings], "warning string")


_MAP = {"event_id": "id", "value": "numerical", "kind": "categorical"}
_CLEAN_KIND = "CASE WHEN kind = ' N/A' THEN {fill} ELSE kind END"
_MODE = f"(SELECT event_type FROM {EVENTS} WHERE kind <> ' N/A' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"

for _strategy, _fill in {"mean": "(SELECT avg(value) FROM e)", "median": "(SELECT quantile_cont(value, 0.5) FROM e)", "mode": "(SELECT value FROM e WHERE value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"}.items():

    def _impute(spark, sf, strategy=_strategy):
        g = gaps(spark, sf).select("event_id", "value", "kind")
        return rounded(P.SimpleImputer(strategy).fit_transform(g, _MAP))

    query(f"impute_{_strategy}", f"WITH e AS (SELECT * FROM {EVENTS}) SELECT event_id, round(coalesce(value, {_fill}), 4) AS value, {_CLEAN_KIND.format(fill=_MODE)} AS kind FROM e")(_impute)


@query("impute_constant", f"SELECT event_id, {_CLEAN_KIND.format(fill=chr(39) + 'unknown' + chr(39))} AS kind FROM {EVENTS}")
def impute_constant(spark, sf):
    return P.SimpleImputer("constant", "unknown").fit_transform(gaps(spark, sf).select("event_id", "kind"), _MAP).select(F.col("event_id").cast("long").alias("event_id"), "kind")


@query("impute_summary", f"SELECT 'value' AS \"column\", 'mean' AS strategy, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_filled FROM {EVENTS} UNION ALL SELECT 'kind', 'mean', sum(CASE WHEN kind = ' N/A' THEN 1 ELSE 0 END)::BIGINT FROM {EVENTS}")
def impute_summary(spark, sf):
    s = P.SimpleImputer("mean").fit(gaps(spark, sf).select("value", "kind"), _MAP).summary()
    return spark.createDataFrame([(x["column"], x["strategy"], x["n_filled"]) for x in s], "column string, strategy string, n_filled long")


_NUM = {"l_quantity": "numerical", "l_extendedprice": "numerical", "p_retailprice": "numerical", "p_size": "numerical", "o_totalprice": "numerical", "flat": "numerical"}


@query("minmax_scale", "SELECT l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo), 6) AS l_extendedprice FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)")
def minmax_scale(spark, sf):
    return rounded(P.MinMaxScaler().fit_transform(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), _NUM), 6)


@query("minmax_scale_range", "SELECT p_partkey, round((p_retailprice - lo) / (hi - lo) * 2.0 + -1.0, 6)::DOUBLE AS p_retailprice FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def minmax_scale_range(spark, sf):
    return rounded(P.MinMaxScaler((-1.0, 1.0)).fit_transform(t(spark, sf, "part").select("p_partkey", "p_retailprice"), _NUM), 6)


@query("minmax_constant", "WITH f AS (SELECT p_partkey, 3.0::DOUBLE AS flat FROM part) SELECT p_partkey, coalesce((flat - lo) / nullif(hi - lo, 0), 0)::DOUBLE AS flat FROM f, (SELECT min(flat) AS lo, max(flat) AS hi FROM f)")
def minmax_constant(spark, sf):
    return P.MinMaxScaler().fit_transform(t(spark, sf, "part").select("p_partkey", F.lit(3.0).alias("flat")), _NUM)


@query("standard_scale", "SELECT o_orderkey, round((o_totalprice - m) / s, 5) AS o_totalprice FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)")
def standard_scale(spark, sf):
    return rounded(P.StandardScaler().fit_transform(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), _NUM), 5)


@query("standard_constant", "WITH f AS (SELECT p_partkey, 3.0::DOUBLE AS flat FROM part) SELECT p_partkey, coalesce((flat - m) / nullif(s, 0), 0)::DOUBLE AS flat FROM f, (SELECT avg(flat) AS m, stddev_samp(flat) AS s FROM f)")
def standard_constant(spark, sf):
    return P.StandardScaler().fit_transform(t(spark, sf, "part").select("p_partkey", F.lit(3.0).alias("flat")), _NUM)


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("onehot_long", "SELECT o_orderkey, o_orderpriority AS category, 1::INT AS on_ FROM orders")
def onehot_long(spark, sf):
    """Exactly one indicator is 1 in each row, and its name holds the category."""
    df = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    enc = P.OneHotEncoder().fit(df, {"o_orderpriority": "categorical"})
    out = enc.transform(df)
    names = enc.get_feature_names()
    return out.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(n.removeprefix("o_orderpriority_")).alias("category"), F.col(f"`{n}`").cast("int").alias("on_")) for n in names])).alias("x")).select("o_orderkey", "x.category", "x.on_").filter("on_ = 1")


@query("onehot_unknown", "SELECT c_custkey, (c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_mktsegment < 'C'))::INT AS total FROM customer")
def onehot_unknown(spark, sf):
    """Segments that the encoder hasn't seen are 0 in all indicators."""
    df = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    enc = P.OneHotEncoder().fit(df.filter("c_mktsegment < 'C'"), {"c_mktsegment": "categorical"})
    total = F.lit(0)
    for n in enc.get_feature_names():
        total = total + F.col(f"`{n}`").cast("int")
    return enc.transform(df).select("c_custkey", total.alias("total"))


@query("onehot_drop_first", "SELECT count(DISTINCT o_orderpriority)::BIGINT - 1 AS n_columns, min(o_orderpriority) AS dropped FROM orders")
def onehot_drop_first(spark, sf):
    df = t(spark, sf, "orders").select("o_orderpriority")
    enc = P.OneHotEncoder(drop_first=True).fit(df, {"o_orderpriority": "categorical"})
    return spark.createDataFrame([(len(enc.transform(df).columns), enc.categories["o_orderpriority"][0])], "n_columns long, dropped string")


@query("label_encode", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS o_orderpriority FROM orders")
def label_encode(spark, sf):
    return P.LabelEncoder().fit_transform(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), {"o_orderpriority": "categorical"})


@query("label_encode_unknown_missing", "SELECT o_orderkey, (CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 0 ELSE -1 END)::INT AS s FROM orders")
def label_encode_unknown_missing(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("s"))
    return P.LabelEncoder().fit(df.filter("s = 'F'"), {"s": "categorical"}).transform(df)


@query("cleaner_label_minmax", "SELECT round((o_totalprice - lo) / (hi - lo), 6) AS o_totalprice, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INT AS o_orderstatus FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def cleaner_label_minmax(spark, sf):
    config = P.CleanerConfig(impute_strategy="median", scaler="minmax", encoder="label")
    return rounded(P.Cleaner(config).run(t(spark, sf, "orders").select("o_totalprice", "o_orderstatus"))[0], 6)


@query("cleaner_onehot_standard", "SELECT round((o_totalprice - m) / s, 5) AS o_totalprice, (o_orderstatus = 'F')::INT AS f, (o_orderstatus = 'O')::INT AS o FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)")
def cleaner_onehot_standard(spark, sf):
    out = P.Cleaner().run(t(spark, sf, "orders").select("o_totalprice", "o_orderstatus"))[0]
    return rounded(out.select("o_totalprice", F.col("o_orderstatus_F").cast("int").alias("f"), F.col("o_orderstatus_O").cast("int").alias("o")), 5)


@query("detect_task", "SELECT " + ", ".join(f"(SELECT CASE WHEN count(DISTINCT {c}) > least(20, greatest(5, floor(0.3 * count(*)))) AND {number} THEN 'regression' ELSE 'classification' END FROM {tb}) AS {name}" for name, c, tb, number in (("price", "o_totalprice", "orders", "true"), ("status", "o_orderstatus", "orders", "false"), ("quality", "quality", "labels", "true"))))
def detect_task(spark, sf):
    o = t(spark, sf, "orders")
    return spark.createDataFrame([(P.detect_task(o, "o_totalprice"), P.detect_task(o, "o_orderstatus"), P.detect_task(t(spark, sf, "labels"), "quality"))], "price string, status string, quality string")


@query("encode_target", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS label FROM orders")
def encode_target(spark, sf):
    return P.encode_target(t(spark, sf, "orders"), "o_orderstatus", "classification")[0].select("o_orderkey", "label")


@query("bool_finalize", "SELECT quality::DOUBLE AS quality, (1 - quality)::DOUBLE AS word FROM labels")
def bool_finalize(spark, sf):
    return P.finalise(t(spark, sf, "labels").select("quality", F.when(F.col("quality") == 1, "No").otherwise(" yes").alias("word")))


#: Numbers name rows if they are whole and leave no gap; texts do anyway.
_DENSE = "bool_and({c} = floor({c})) AND count(DISTINCT {c}) = count({c}) AND max({c}) - min({c}) + 1 = count(DISTINCT {c})"
_ID_SHAPES = {"c_custkey": _DENSE.format(c="c_custkey"), "c_name": "true", "c_nationkey": _DENSE.format(c="c_nationkey"), "c_acctbal": _DENSE.format(c="c_acctbal"), "c_mktsegment": "true"}


@query("drop_id_columns", "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dropped, count(DISTINCT {c}) * 1.0 / count(*) > 0.9 AND ({dense}) AS is_id FROM customer" for c, dense in _ID_SHAPES.items()) + ") SELECT dropped FROM c WHERE is_id")
def drop_id_columns(spark, sf):
    return spark.createDataFrame([(c,) for c in P.id_columns(t(spark, sf, "customer").select(*_ID_SHAPES))], "dropped string")


_STRICT = {c: d if c in ("c_name", "c_mktsegment") else "true" for c, d in _ID_SHAPES.items()}


@query("drop_id_columns_strict", "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dropped, count(DISTINCT {c}) * 1.0 / count(*) > 0.9 AND ({dense}) AS is_id FROM customer" for c, dense in _STRICT.items()) + ") SELECT dropped FROM c WHERE is_id")
def drop_id_columns_strict(spark, sf):
    """Numbers that are nearly always unique go too."""
    return spark.createDataFrame([(c,) for c in P.id_columns(t(spark, sf, "customer").select(*_ID_SHAPES), strict=True)], "dropped string")


@query("sample_exact", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 500")
def sample_exact(spark, sf):
    return P.sample_exact(t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 500)


def _fold_sql(order: str) -> str:
    return f"SELECT o_orderkey, (CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE (n % 7) + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END)::INT AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {order}) - 1 AS i, count(*) OVER () AS n FROM orders)"


@query("kfold_sequential", _fold_sql("o_orderkey"))
def kfold_sequential(spark, sf):
    return E.assign_folds(t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7, shuffle=False)


@query("kfold_md5_shuffle", _fold_sql("md5(o_orderkey || ':42'), o_orderkey"))
def kfold_md5_shuffle(spark, sf):
    return E.assign_folds(t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("fold_info", "SELECT k::INT AS fold, (n // 7 + (k < n % 7)::INT)::BIGINT AS n_val, (n - n // 7 - (k < n % 7)::INT)::BIGINT AS n_train FROM range(7) r(k), (SELECT count(*) AS n FROM orders)")
def fold_info(spark, sf):
    return spark.createDataFrame([(x["fold"], x["n_val"], x["n_train"]) for x in E.fold_info(t(spark, sf, "orders").count(), 7)], "fold int, n_val long, n_train long")


def _judged(spark, sf):
    return t(spark, sf, "labels").select(F.col("quality").cast("int").alias("y"), (F.col("doc_id") % 3 != 0).cast("int").alias("p"))


_JUDGED = "(SELECT quality::INT AS y, (doc_id % 3 <> 0)::INT AS p FROM labels)"


@query("accuracy", f"SELECT round(avg((y = p)::INT), 6)::DOUBLE AS accuracy FROM {_JUDGED}")
def accuracy(spark, sf):
    return rounded(_judged(spark, sf).agg(E.accuracy(F.col("y"), F.col("p")).alias("accuracy")), 6)


@query("precision_recall_f1", f"SELECT round(a, 6)::DOUBLE AS precision, round(b, 6)::DOUBLE AS recall, round(2 * a * b / (a + b), 6)::DOUBLE AS f1 FROM (SELECT sum(y * p) * 1.0::DOUBLE / sum(p) AS a, sum(y * p) * 1.0::DOUBLE / sum(y) AS b FROM {_JUDGED})")
def precision_recall_f1(spark, sf):
    y, p = F.col("y"), F.col("p")
    return rounded(_judged(spark, sf).agg(E.precision(y, p).alias("precision"), E.recall(y, p).alias("recall"), E.f1(y, p).alias("f1")), 6)


@query("confusion_matrix", f"SELECT a.l AS \"true\", b.l AS pred, (SELECT count(*) FROM {_JUDGED} WHERE y = a.l AND p = b.l)::BIGINT AS n FROM (VALUES (0), (1)) a(l), (VALUES (0), (1)) b(l)")
def confusion_matrix(spark, sf):
    return E.confusion(_judged(spark, sf), "y", "p")


@query("mse_mae_r2", "SELECT round(avg((y - p) * (y - p)), 4) AS mse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT l_quantity::DOUBLE AS y, (l_extendedprice / 1500)::DOUBLE AS p FROM lineitem)")
def mse_mae_r2(spark, sf):
    df = t(spark, sf, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1500).alias("p"))
    y, p = F.col("y"), F.col("p")
    return df.agg(F.round(E.mse(y, p), 4).alias("mse"), F.round(E.mae(y, p), 4).alias("mae"), F.round(E.r2(y, p), 6).alias("r2"))


@query("r2_constant", "SELECT CASE WHEN sum((y - 2) * (y - 2)) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS exact, CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS wrong FROM (SELECT 2.0::DOUBLE AS y, p_size::DOUBLE AS p FROM part)")
def r2_constant(spark, sf):
    return t(spark, sf, "part").agg(E.r2(F.lit(2.0), F.lit(2.0)).alias("exact"), E.r2(F.lit(2.0), F.col("p_size").cast("double")).alias("wrong"))


_NB = ["l_quantity", "l_discount", "l_tax"]


@query("gnb_fit", "SELECT l_returnflag AS class, round(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM lineitem), 6) AS prior, " + ", ".join(f"round(avg({c}), 5) AS mean_{c}, round(var_pop({c}), 4) AS var_{c}" for c in _NB) + " FROM lineitem GROUP BY 1")
def gnb_fit(spark, sf):
    m = mod.GaussianNaiveBayes().fit(t(spark, sf, "lineitem"), _NB, "l_returnflag")
    rows = [(c, p, *[v for a, b in zip(mu, va) for v in (a, b)]) for c, p, mu, va in zip(m.classes, m.priors, m.means, m.variances)]
    df = spark.createDataFrame(rows, "class string, prior double, " + ", ".join(f"mean_{c} double, var_{c} double" for c in _NB))
    return df.select("class", F.round("prior", 6).alias("prior"), *[F.round(f"mean_{c}", 5).alias(f"mean_{c}") for c in _NB], *[F.round(f"var_{c}", 4).alias(f"var_{c}") for c in _NB])


@query("linreg_gd_fit", "WITH RECURSIVE d AS (SELECT l_quantity / 50.0::DOUBLE AS x, l_extendedprice / 100000.0::DOUBLE AS y FROM lineitem), m AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM d), g AS (SELECT 0 AS t, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b UNION ALL SELECT t + 1, w - 0.1::DOUBLE * 2 / n * (sxx * w + sx * b - sxy), b - 0.1::DOUBLE * 2 / n * (sx * w + n * b - sy) FROM g, m WHERE t < 100) SELECT round(w, 6) AS weight, round(b, 6) AS bias FROM g WHERE t = 100")
def linreg_gd_fit(spark, sf):
    df = t(spark, sf, "lineitem").select((F.col("l_quantity") / 50.0).alias("x"), (F.col("l_extendedprice") / 100000.0).alias("y"))
    m = mod.LinearRegression(0.1, 100).fit(df, ["x"], "y")
    return spark.createDataFrame([(round(float(m.weights[0]), 6), round(m.bias, 6))], "weight double, bias double")


@query("logreg_fit", "WITH RECURSIVE d AS (SELECT (doc_id % 17) / 17.0::DOUBLE AS x, quality::DOUBLE AS y FROM labels), g AS (SELECT 0 AS t, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b UNION ALL SELECT t + 1, w - 0.5::DOUBLE * (SELECT avg((1 / (1 + exp(-(g.w * x + g.b))) - y) * x) FROM d), b - 0.5::DOUBLE * (SELECT avg(1 / (1 + exp(-(g.w * x + g.b))) - y) FROM d) FROM g WHERE t < 10) SELECT round(w, 6) AS weight, round(b, 6) AS bias FROM g WHERE t = 10")
def logreg_fit(spark, sf):
    df = t(spark, sf, "labels").select(((F.col("doc_id") % 17) / 17.0).alias("x"), F.col("quality").cast("double").alias("y"))
    m = mod.LogisticRegression(0.5, 10).fit(df, ["x"], "y")
    return spark.createDataFrame([(round(float(m.weights[0]), 6), round(m.bias, 6))], "weight double, bias double")


_PART = "(SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice::DOUBLE AS b, (p_partkey % 3)::DOUBLE AS y FROM part)"


def _part(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").cast("double").alias("b"), (F.col("p_partkey") % 3).cast("double").alias("y"))


_KNN = "WITH p AS (SELECT * FROM {part}), n AS (SELECT q.p_partkey, tr.y, row_number() OVER (PARTITION BY q.p_partkey ORDER BY {distance}, tr.p_partkey) AS r FROM p q, p tr WHERE q.p_partkey <> tr.p_partkey) {vote}"
_DIST = {"euclidean": "(q.a - tr.a) * (q.a - tr.a) + (q.b - tr.b) * (q.b - tr.b)", "manhattan": "abs(q.a - tr.a) + abs(q.b - tr.b)"}
_CLASS = "SELECT p_partkey, y AS prediction FROM (SELECT p_partkey, y, row_number() OVER (PARTITION BY p_partkey ORDER BY count(*) DESC, y) AS k FROM n WHERE r <= 5 GROUP BY 1, 2) WHERE k = 1"
_MEAN = "SELECT p_partkey, round(avg(y), 6) AS prediction FROM n WHERE r <= 5 GROUP BY 1"
for _name, _task, _metric, _vote in (("knn_classify", "classification", "euclidean", _CLASS), ("knn_regress", "regression", "euclidean", _MEAN), ("knn_manhattan", "classification", "manhattan", _CLASS)):

    def _knn(spark, sf, task=_task, metric=_metric):
        """Every row of part, from its nearest among all others."""
        return rounded(mod.KNN(5, task, metric).fit(_part(spark, sf), ["a", "b"], "y", "p_partkey").leave_one_out(), 6)

    query(_name, _KNN.format(part=_PART, distance=_DIST[_metric], vote=_vote))(_knn)


@query("tree_stump_mse", "WITH d AS (SELECT l_quantity::DOUBLE AS x, (l_extendedprice / 1000)::DOUBLE AS y FROM lineitem), c AS (SELECT x, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM d GROUP BY x), w AS (SELECT x, sum(n) OVER o AS n, sum(s) OVER o AS s, sum(q) OVER o AS q, sum(n) OVER () AS tn, sum(s) OVER () AS ts, sum(q) OVER () AS tq FROM c WINDOW o AS (ORDER BY x)) SELECT x AS threshold, round(((tq - ts * ts / tn) - (q - s * s / n) - ((tq - q) - (ts - s) * (ts - s) / (tn - n))) / tn, 4) AS gain FROM w WHERE n < tn ORDER BY ((tq - ts * ts / tn) - (q - s * s / n) - ((tq - q) - (ts - s) * (ts - s) / (tn - n))) DESC, x LIMIT 1")
def tree_stump_mse(spark, sf):
    df = t(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    root = mod.DecisionTree("regression", 1).fit(df, ["x"], "y").nodes[1]
    return spark.createDataFrame([(root["threshold"], round(root["gain"], 4))], "threshold double, gain double")


def _tree_sql(features: list[str], depth: int, regression: bool, weight: str = "1.0") -> str:
    """p_partkey and prediction of a tree on part: CTEs r0, r1, ... hold each row's node."""
    parts = ["sum(w * y) AS s", "sum(w * y * y) AS q"] if regression else [f"sum(CASE WHEN y = {c} THEN w ELSE 0 END) AS c{c}" for c in range(3)]
    names = ["n", *[p.split()[-1] for p in parts]]
    mass = (lambda x: f"({x('q')} - {x('s')} * {x('s')} / {x('n')})") if regression else (lambda x: f"({x('n')} - ({' + '.join(f'{x(c)} * {x(c)}' for c in names[1:])}) / {x('n')})")
    out = [f"r0 AS (SELECT p_partkey, a, b, y, {weight}::DOUBLE AS w, 1 AS node FROM {_PART} WHERE {weight} > 0)", f"every0 AS (SELECT p_partkey, a, b, 1 AS node FROM {_PART})"]
    for k in range(depth):
        long = " UNION ALL ".join(f"SELECT node, {i} AS f, {c} AS v, y, w FROM r{k}" for i, c in enumerate(features))
        run = ", ".join(f"sum({c}) OVER (PARTITION BY node, f ORDER BY v) AS l_{c}, sum({c}) OVER (PARTITION BY node, f) AS t_{c}" for c in names)
        left, total, right = mass(lambda c: f"l_{c}"), mass(lambda c: f"t_{c}"), mass(lambda c: f"(t_{c} - l_{c})")
        feature = "CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(features)) + " END"
        out += [
            f"cells{k} AS (SELECT node, f, v, sum(w) AS n, {', '.join(parts)} FROM ({long}) GROUP BY 1, 2, 3)",
            f"gains{k} AS (SELECT node, f, v, round(({total} - {left} - {right}) / t_n, 12) AS gain, {total} AS mass, t_n FROM (SELECT node, f, v, {run} FROM cells{k}) WHERE l_n < t_n)",
            f"best{k} AS (SELECT node, f, v FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) AS k FROM gains{k} WHERE mass > 1e-9 AND t_n >= 2) WHERE k = 1)",
            *[f"{name}{k + 1} AS (SELECT r.* REPLACE (CASE WHEN f IS NULL THEN r.node WHEN {feature} <= v THEN 2 * r.node ELSE 2 * r.node + 1 END AS node) FROM {name}{k} r LEFT JOIN best{k} USING (node))" for name in ("r", "every")],
        ]
    value = "sum(w * y) / sum(w)" if regression else "arg_min(y, (-n, y))"
    leaf = f"SELECT node, {value} AS prediction FROM r{depth} GROUP BY node" if regression else f"SELECT node, y AS prediction FROM (SELECT node, y, row_number() OVER (PARTITION BY node ORDER BY sum(w) DESC, y) AS k FROM r{depth} GROUP BY node, y) WHERE k = 1"
    return f"WITH {', '.join(out)}, leaf AS ({leaf}) SELECT p_partkey, prediction FROM every{depth} JOIN leaf USING (node)"


@query("tree_depth2", _tree_sql(["a", "b"], 2, False))
def tree_depth2(spark, sf):
    df = _part(spark, sf)
    return mod.DecisionTree("classification", 2).fit(df, ["a", "b"], "y").transform(df).select("p_partkey", "prediction")


_FOREST = mod.RandomForest(3, "regression", 2)
_STEPS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
_DRAWN = "(" + " + ".join(f"(('0x' || substr(md5(p_partkey || ':42:{{t}}'), 1, 7))::BIGINT / 268435456.0::DOUBLE >= {x!r}::DOUBLE)::INT" for x in _STEPS) + ")"


@query("forest_predict", "SELECT p_partkey, round(avg(prediction), 6) AS prediction FROM (" + " UNION ALL ".join(f"SELECT * FROM ({_tree_sql(own, 2, True, _DRAWN.format(t=i))})" for i, own in enumerate(_FOREST.subsets(["a", "b"]))) + ") GROUP BY p_partkey")
def forest_predict(spark, sf):
    df = _part(spark, sf)
    return rounded(mod.RandomForest(3, "regression", 2).fit(df, ["a", "b"], "y", "p_partkey").transform(df).select("p_partkey", "prediction"), 6)


_LIKELY = "SELECT p_partkey, c.y AS class, ln(n / total) - " + " - ".join(f"(0.5 * ln(2 * pi() * (v{x} + 1e-9)) + (p.{x} - m{x}) * (p.{x} - m{x}) / (2 * (v{x} + 1e-9)))" for x in "ab") + f" AS ll FROM {_PART} p, (SELECT y, count(*)::DOUBLE AS n, sum(count(*)) OVER () AS total, " + ", ".join(f"avg({x}) AS m{x}, var_pop({x}) AS v{x}" for x in "ab") + f" FROM {_PART} GROUP BY y) c"


@query("gnb_predict", f"WITH l AS ({_LIKELY}) SELECT p_partkey, arg_max(class, ll) AS prediction, round(1 / sum(exp(ll - top)), 6) AS certainty FROM (SELECT *, max(ll) OVER (PARTITION BY p_partkey) AS top FROM l) GROUP BY p_partkey")
def gnb_predict(spark, sf):
    df = _part(spark, sf)
    out = mod.GaussianNaiveBayes().fit(df, ["a", "b"], "y").transform(df)
    return out.select("p_partkey", "prediction", F.round(F.array_max("probabilities"), 6).alias("certainty"))


@query("feature_importances", "SELECT 'l_extendedprice' AS feature, round(abs(corr(l_extendedprice, l_quantity)), 4) AS importance FROM lineitem UNION ALL SELECT 'l_tax', round(abs(corr(l_tax, l_quantity)), 4) FROM lineitem")
def feature_importances(spark, sf):
    from quarry.plans.autofit import feature_importances

    got = feature_importances(t(spark, sf, "lineitem"), ["l_extendedprice", "l_tax"], "l_quantity")
    return spark.createDataFrame([(x["feature"], x["importance"]) for x in got], "feature string, importance double")


_FOLDED = f"(SELECT *, (CASE WHEN i < (n % 3) * (n // 3 + 1) THEN i // (n // 3 + 1) ELSE (n % 3) + (i - (n % 3) * (n // 3 + 1)) // (n // 3) END)::INT AS fold FROM (SELECT *, row_number() OVER (ORDER BY md5(p_partkey || ':42'), p_partkey) - 1 AS i, count(*) OVER () AS n FROM {_PART}))"
_SCORED = "SELECT {k} AS k, fold, avg((y = prediction)::INT) AS score FROM (SELECT fold, y, prediction FROM (SELECT p_partkey, fold, y, label AS prediction, row_number() OVER (PARTITION BY p_partkey ORDER BY count(*) DESC, label) AS turn FROM near WHERE r <= {k} GROUP BY 1, 2, 3, 4) WHERE turn = 1) GROUP BY fold"


@query("grid_search_knn", f"WITH p AS {_FOLDED}, near AS (SELECT q.p_partkey, q.fold, q.y, tr.y AS label, row_number() OVER (PARTITION BY q.p_partkey ORDER BY {_DIST['euclidean']}, tr.p_partkey) AS r FROM p q, p tr WHERE q.fold <> tr.fold), scored AS ({_SCORED.format(k=3)} UNION ALL {_SCORED.format(k=5)}) SELECT k::INT AS k, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score FROM scored GROUP BY k")
def grid_search_knn(spark, sf):
    from quarry.operators.local_models import Neighbours
    from quarry.operators.search import Search

    s = Search(Neighbours, {"k": [3, 5], "task": ["classification"]}, "accuracy", 3, strict=True).fit(_part(spark, sf), ["a", "b"], "y", "p_partkey")
    return rounded(spark.createDataFrame([(r.params["k"], r.mean_score, r.std_score) for r in s.results], "k int, mean_score double, std_score double"), 6)


@query("orchestrator_report", f"WITH p AS {_FOLDED}, near AS (SELECT q.p_partkey, q.fold, q.y, tr.y AS label, row_number() OVER (PARTITION BY q.p_partkey ORDER BY {_DIST['euclidean']}, tr.p_partkey) AS r FROM p q, p tr WHERE q.fold <> tr.fold), scored AS ({_SCORED.format(k=3)} UNION ALL {_SCORED.format(k=7)}), m AS (SELECT k, avg(score) AS mean FROM scored GROUP BY k) SELECT arg_min(k, (-mean, k))::INT AS best_k, round(max(mean), 6) AS best_score, count(*)::BIGINT AS candidates FROM m")
def orchestrator_report(spark, sf):
    from quarry.operators.local_models import Neighbours
    from quarry.operators.search import Orchestrator, OrchestratorConfig

    r = Orchestrator(OrchestratorConfig(cv=3)).run(_part(spark, sf), ["a", "b"], "y", "p_partkey", Neighbours, {"k": [3, 7], "task": ["classification"]})
    return spark.createDataFrame([(r.best_params["k"], round(r.best_score, 6), r.n_candidates_evaluated)], "best_k int, best_score double, candidates long")


@query("search_grid", "SELECT a.v AS lr, b.v AS steps FROM (VALUES (0.001::DOUBLE), (0.01), (0.1)) a(v), (SELECT DISTINCT 100 * (c_nationkey % 3 + 1)::INT AS v FROM customer) b")
def search_grid(spark, sf):
    """Every combination of a fixed list and one read off a table."""
    from quarry.operators.search import grid

    steps = sorted(100 * (r[0] % 3 + 1) for r in t(spark, sf, "customer").select(F.col("c_nationkey") % 3).distinct().collect())
    return spark.createDataFrame([(x["lr"], x["steps"]) for x in grid({"lr": [0.001, 0.01, 0.1], "steps": sorted(set(steps))})], "lr double, steps int")


def _descent_sql(rate: str, steps: int) -> str:
    return f"SELECT round(w, 6) AS weight, round(b, 6) AS bias FROM (WITH RECURSIVE d AS (SELECT l_quantity / 50.0::DOUBLE AS x, l_extendedprice / 100000.0::DOUBLE AS y FROM lineitem), m AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM d), g AS (SELECT 0 AS t, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b UNION ALL SELECT t + 1, w - {rate} * 2 / n * (sxx * w + sx * b - sxy), b - {rate} * 2 / n * (sx * w + n * b - sy) FROM g, m WHERE t < {steps}) SELECT * FROM g WHERE t = {steps})"


_RATES = {"time_decay": "(0.1::DOUBLE / (1 + 0.01 * t))", "step_decay": "(0.1::DOUBLE * power(0.5::DOUBLE, (1 + t) // 100))"}


@query("linreg_schedules", " UNION ALL ".join(f"SELECT '{name}' AS schedule, * FROM ({_descent_sql(rate, 150)})" for name, rate in _RATES.items()))
def linreg_schedules(spark, sf):
    df = t(spark, sf, "lineitem").select((F.col("l_quantity") / 50.0).alias("x"), (F.col("l_extendedprice") / 100000.0).alias("y"))
    fits = {name: mod.LinearRegression(0.1, 150, name, 0.01 if name == "time_decay" else 0.5).fit(df, ["x"], "y").get_params() for name in _RATES}
    return spark.createDataFrame([(name, round(p["weights"][0], 6), round(p["bias"], 6)) for name, p in fits.items()], "schedule string, weight double, bias double")


@query("linreg_score", f"SELECT round(1 - avg((y - (f.w * x + f.b)) * (y - (f.w * x + f.b))) / var_pop(y), 5) AS r2 FROM (SELECT l_quantity / 50.0::DOUBLE AS x, l_extendedprice / 100000.0::DOUBLE AS y FROM lineitem), (SELECT weight AS w, bias AS b FROM ({_descent_sql('0.1::DOUBLE', 100)})) f")
def linreg_score(spark, sf):
    df = t(spark, sf, "lineitem").select((F.col("l_quantity") / 50.0).alias("x"), (F.col("l_extendedprice") / 100000.0).alias("y"))
    return spark.createDataFrame([(round(mod.LinearRegression(0.1, 100).fit(df, ["x"], "y").score(df), 5),)], "r2 double")


@query("logreg_threshold", "WITH RECURSIVE d AS (SELECT doc_id, (doc_id % 17) / 17.0::DOUBLE AS x, quality::DOUBLE AS y FROM labels), g AS (SELECT 0 AS t, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b UNION ALL SELECT t + 1, w - 0.5::DOUBLE * (SELECT avg((1 / (1 + exp(-(g.w * x + g.b))) - y) * x) FROM d), b - 0.5::DOUBLE * (SELECT avg(1 / (1 + exp(-(g.w * x + g.b))) - y) FROM d) FROM g WHERE t < 5) SELECT doc_id, round(p, 6) AS probability, (p >= 0.45)::INT::DOUBLE AS prediction FROM (SELECT doc_id, 1 / (1 + exp(-(g.w * x + g.b))) AS p FROM d, g WHERE t = 5)")
def logreg_threshold(spark, sf):
    df = t(spark, sf, "labels").select("doc_id", ((F.col("doc_id") % 17) / 17.0).alias("x"), F.col("quality").cast("double").alias("y"))
    m = mod.LogisticRegression(0.5, 5, threshold=0.45).fit(df, ["x"], "y")
    return m.transform(df).select("doc_id", F.round("probability", 6).alias("probability"), "prediction")


@query("split_target", "SELECT 'features' AS part, count(*)::BIGINT AS n, min(o_orderkey) AS low FROM orders UNION ALL SELECT 'target', count(o_totalprice)::BIGINT, NULL FROM orders")
def split_target(spark, sf):
    x, y = P.split_target(t(spark, sf, "orders"), "o_totalprice")
    return x.agg(F.lit("features").alias("part"), F.count("*").alias("n"), F.min("o_orderkey").alias("low")).union(y.agg(F.lit("target"), F.count("o_totalprice"), F.lit(None).cast("long")))


_GONE = {c: f"count(*) FILTER ({c} IS NULL OR trim(lower({c}::VARCHAR)) IN ('', 'nan', 'none', 'null', 'na', 'n/a'))" for c in ("value", "kind", "flat")}


@query("cleaner_warnings", f"WITH e AS (SELECT value, kind, 1.5::DOUBLE AS flat FROM {EVENTS}) " + " UNION ALL ".join([f"SELECT '''{c}'' has ' || n || ' missing values; they will be imputed' AS warning FROM (SELECT {g} AS n FROM e) WHERE n > 0" for c, g in _GONE.items()] + ["SELECT '''flat'' is constant; scaling sets it to one value' FROM (SELECT min(flat) AS a, max(flat) AS b FROM e) WHERE a = b"]))
def cleaner_warnings(spark, sf):
    df = gaps(spark, sf).select("value", "kind", F.lit(1.5).alias("flat"))
    cleaner = P.Cleaner(P.CleanerConfig(encoder=None)).fit(df, {"value": "numerical", "kind": "categorical", "flat": "numerical"})
    return spark.createDataFrame([(w,) for w in cleaner.report.warnings], "warning string")


@query("inspector_capped", f"SELECT round(least(greatest(value, q1 - 0.2 * (q3 - q1)), q3 + 0.2 * (q3 - q1)), 4) AS value FROM {EVENTS}, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {EVENTS}) WHERE value IS NOT NULL")
def inspector_capped(spark, sf):
    report = pr.inspect(gaps(spark, sf).select("value"), pr.InspectorConfig(outlier_k=0.2, cap_outliers=True))
    return rounded(report.capped.filter("value IS NOT NULL"))


@query("message_table", "SELECT n_nationkey::VARCHAR AS id, n_name AS name, 'name' AS target FROM nation")
def message_table(spark, sf):
    """A table within a message, between prose with commas, and the column that the message asks for."""
    from quarry.sources import csv_source

    rows = t(spark, sf, "nation").orderBy("n_nationkey").collect()  # a catalogue of 25 rows
    message = "Well, hello, there\n\nplease predict **name**:\n\n" + "\n".join(["id,name", *[f"{r.n_nationkey},{r.n_name}" for r in rows]]) + "\n\nthanks, or so"
    df = csv_source.read_csv_text(spark, csv_source.find_csv(message))
    return df.select("id", "name", F.lit(csv_source.find_target(message, ["id", "name"])).alias("target"))


_FACTS = {"rows": "count(*)", "nations": "count(DISTINCT c_nationkey)", "keys": "max(c_custkey)"}


@query("report_json", "SELECT '{' || chr(10) || " + " || ',' || chr(10) || ".join(f"'  \"{k}\": ' || {e}" for k, e in _FACTS.items()) + " || chr(10) || '}' AS json, format('{:.4f}', sqrt(avg(c_acctbal * c_acctbal))) AS rmse, replace('&' || min(c_name) || '<', '&', '&amp;') AS shown FROM customer")
def report_json(spark, sf):
    """Facts as JSON, a squared error as shown, and a name as a page shows it."""
    import html

    from quarry.sources import reports

    r = t(spark, sf, "customer").agg(F.count("*").alias("rows"), F.count_distinct("c_nationkey").alias("nations"), F.max("c_custkey").alias("keys"), F.avg(F.col("c_acctbal") * F.col("c_acctbal")).alias("mse"), F.min("c_name").alias("name")).first()
    return spark.createDataFrame([(reports.to_json({k: r[k] for k in _FACTS}), reports.shown_score(-r["mse"], "neg_mse"), html.escape(f"&{r['name']}<").replace("&lt;", "<"))], "json string, rmse string, shown string")


@query("csv_ingest", "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS _row, n_nationkey::VARCHAR AS id, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey || '.5' END AS score FROM nation")
def csv_ingest(spark, sf):
    """The text of a small table: cells are trimmed, blanks are null."""
    from quarry.sources.csv_source import read_csv_text

    rows = t(spark, sf, "nation").orderBy("n_nationkey").collect()  # a catalogue of 25 rows
    lines = ["id, name ,score", *[f"{r.n_nationkey}, {r.n_name} ,{'' if r.n_nationkey % 3 == 0 else f'{r.n_regionkey}.5'}" for r in rows]]
    return read_csv_text(spark, "\n".join(lines))


@query("csv_file", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'in ' || c_mktsegment || ', or \"so\"' END AS segment FROM customer")
def csv_file(spark, sf):
    """A table of any size written as CSV files in the shared folder and read back as text."""
    from quarry.sources.csv_source import read_csv_file
    from quarry.streaming.storage import shared_folder

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    segment = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("in "), "c_mktsegment", F.lit(', or "so"')))
    t(spark, sf, "customer").select("c_custkey", "c_name", segment.alias("segment")).write.csv(path, header=True, escape='"')
    return read_csv_file(spark, path)


@query("autofit_rankings")
def autofit_rankings(spark, sf):
    """Every row and every point of the grids, with no time limit; any error ends it. LogisticRegression takes two classes only."""
    from quarry.plans.autofit import AutoFitConfig, autofit

    df = t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    r = autofit(df, "c_mktsegment", "c_custkey", AutoFitConfig(n_iter=None, time_budget=None, without=("LogisticRegression",), strict=True))
    return spark.createDataFrame([(i, x["model"], x["score"]) for i, x in enumerate(r.rankings, 1)], "rank int, model string, score double")
