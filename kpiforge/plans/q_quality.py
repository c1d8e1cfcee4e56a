"""Data quality, contracts and expectation queries.

Every check is a table operator: one aggregate pass per table (profiles,
scores, expectation suites), CASE ladders for classes, anti joins for
coverage. Nothing is looped over rows on the driver; the driver only
inspects schemas (metadata) for the schema checks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import num
from ..operators.expectations import run_suite, spark_type_class
from ..oracle import ladders as SQ
from ..oracle.gold import with_kpis
from ..oracle.silver import N, with_silver
from ..sources.tables import table
from .features import silver
from .q_display import kpis, processed
from .registry import query
from .store import materialized

# ------------------------------------------------------------------ D1 profile
ORDERS_CLASSES = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "object",
                  "o_totalprice": "float", "o_orderdate": "datetime", "o_orderpriority": "object"}
NUMERIC = (T.LongType, T.IntegerType, T.ShortType, T.DoubleType, T.FloatType, T.DecimalType)


def profile(df: DataFrame, name: str) -> DataFrame:
    """Column profile: dtype, nulls, null %, distinct, min, max, 5 samples.

    Wide counts/min/max in one aggregate; distinct counts and samples from
    one unpivot to (column, text value) — samples are the five smallest
    distinct values by text, taken with a row_number ≤ 5 filter that Spark
    applies per task before the shuffle (WindowGroupLimit).
    """
    cols = df.columns
    numeric = {c for c in cols if isinstance(df.schema[c].dataType, NUMERIC)}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count(F.col(c)).alias(f"_c{i}"), F.min(c).alias(f"_mn{i}"), F.max(c).alias(f"_mx{i}")]
    wide = df.agg(*aggs)
    structs = []
    for i, c in enumerate(cols):
        is_num = c in numeric
        structs.append(F.struct(
            F.lit(c).alias("column_name"),
            F.lit(spark_type_class(df.schema[c].dataType)).alias("dtype"),
            (F.col("_n") - F.col(f"_c{i}")).alias("null_count"),
            F.when(F.col("_n") > 0, num((F.col("_n") - F.col(f"_c{i}")) * 100.0 / F.col("_n"), 4))
            .alias("null_pct"),
            (F.col(f"_mn{i}").cast("double") if is_num else F.lit(None).cast("double")).alias("min_value"),
            (F.col(f"_mx{i}").cast("double") if is_num else F.lit(None).cast("double")).alias("max_value"),
            (F.lit(None).cast("string") if is_num else F.col(f"_mn{i}").cast("string")).alias("min_text"),
            (F.lit(None).cast("string") if is_num else F.col(f"_mx{i}").cast("string")).alias("max_text")))
    rows = wide.select(F.inline(F.array(*structs)))
    pairs = (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"))
                                           for c in cols])).alias("p")).select("p.*")
             .filter(F.col("v").isNotNull()))
    dv = pairs.distinct()                     # one shuffle feeds both counts and samples
    distinct = dv.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    w = Window.partitionBy("column_name").orderBy("v")
    samples = (dv.withColumn("_r", F.row_number().over(w)).filter("_r <= 5")
               .groupBy("column_name").agg(F.array_sort(F.collect_list("v")).alias("sample_values")))
    return (rows.join(distinct, "column_name", "left").join(samples, "column_name", "left")
            .select(F.lit(name).alias("table_name"), "column_name", "dtype", "null_count", "null_pct",
                    F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "min_value", "max_value",
                    "min_text", "max_text", "sample_values"))


def _profile_sql(tbl: str, classes: dict[str, str]) -> str:
    parts = []
    for c, k in classes.items():
        is_num = k in ("int", "float")
        mn = f"CAST(min({c}) AS DOUBLE)" if is_num else "CAST(NULL AS DOUBLE)"
        mx = f"CAST(max({c}) AS DOUBLE)" if is_num else "CAST(NULL AS DOUBLE)"
        mnt = "CAST(NULL AS VARCHAR)" if is_num else f"CAST(min({c}) AS VARCHAR)"
        mxt = "CAST(NULL AS VARCHAR)" if is_num else f"CAST(max({c}) AS VARCHAR)"
        parts.append(
            f"SELECT '{tbl}' AS table_name, '{c}' AS column_name, '{k}' AS dtype, count(*) - count({c}) AS null_count, "
            f"{N(f'(count(*) - count({c})) * 100.0 / count(*)', 4)} AS null_pct, count(DISTINCT {c}) AS unique_count, "
            f"{mn} AS min_value, {mx} AS max_value, {mnt} AS min_text, {mxt} AS max_text, "
            f"(SELECT list(v ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {tbl} WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS sample_values "
            f"FROM {tbl}")
    return "\nUNION ALL\n".join(parts)


@query("profile_columns", _profile_sql("orders", ORDERS_CLASSES))
def profile_columns(spark, sf):
    return profile(table(spark, sf, "orders", *ORDERS_CLASSES), "orders")


# ------------------------------------------------------------------ D2–D6 contract scores
# Source names of the silver artifacts (ours) and their numeric columns.
ARTIFACTS = {
    "affordability": ("world_bank_affordability", "affordability"),
    "interest_rate": ("rbnz_interest_rates", "interest_rate"),
    "tourism_pressure": ("mbie_tourism", "tourism"),
    "supply_deficit": ("stats_nz_consents", "supply"),
    "rent_income": ("stats_nz_rent", "rent_income"),
    "macro_volatility": ("world_bank_macro", "macro_volatility"),
}
ARTIFACT_COLS = {
    "affordability": (["year"], ["gdp_per_capita", "median_income", "affordability_index", "price_to_income_ratio"], ["region"]),
    "interest_rate": (["year"], ["ocr_value", "mortgage_rate_2yr", "ocr_change_bps", "rate_volatility",
                                 "interest_rate_impact_score"], ["region"]),
    "tourism_pressure": (["year"], ["tourism_expenditure", "visitor_arrivals", "tourism_pressure_index",
                                    "unemployment_rate", "tourism_growth_yoy"], ["region"]),
    "supply_deficit": (["year", "building_consents", "population"], ["population_growth", "consents_per_1000_people",
                                                                     "supply_deficit_score", "housing_supply_gap"], ["region"]),
    "rent_income": (["year", "quarter"], ["median_weekly_rent", "annual_rent", "median_income", "rent_to_income_ratio",
                                          "general_inflation", "rent_inflation_rate", "affordability_erosion",
                                          "cumulative_rent_pressure"], ["region"]),
    "macro_volatility": (["year"], ["macroeconomic_volatility_index", "gdp_volatility", "inflation_volatility",
                                    "unemployment_volatility", "interest_rate_volatility"], ["region"]),
}
AS_OF_YEAR = 2024
# Government sources.
GOV_SOURCES = ["stats_nz", "rbnz", "linz", "mbie", "oecd"]


def _stats(df: DataFrame, name: str) -> DataFrame:
    ints, dbls, texts = ARTIFACT_COLS[name]
    numeric = ints + dbls
    allc = numeric + texts
    n = F.count(F.lit(1))
    aggs = [n.alias("n_rows"),
            reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in allc]).alias("null_cells"),
            F.greatest(*[F.count_distinct(c) / n for c in numeric], F.lit(0.0)).alias("max_unique_ratio"),
            F.greatest(*[F.when(F.count(c) > 5, F.count_if(F.col(c) % 100 == 0) / F.count(c)).otherwise(0.0)
                         for c in numeric]).alias("max_round_pct"),
            F.min("year").alias("min_year"), F.max("year").alias("max_year")]
    return df.agg(*aggs).select(F.lit(name).alias("artifact"), F.lit(ARTIFACTS[name][0]).alias("source_name"),
                                F.lit(len(allc)).alias("n_cols"), "*")


def detect_source_col(n, max_unique, max_round, min_year, src_name) -> F.Column:
    """D2 heuristics in the reference order (as_of year is a parameter)."""
    sn = F.lower(src_name)
    gov = reduce(lambda a, b: a | b, [sn.contains(g) for g in GOV_SOURCES])
    return (F.when(n == 0, "unknown")
            .when((n > 10) & (max_unique < 0.3), "synthetic")
            .when(max_round > 0.8, "synthetic")
            .when((min_year >= AS_OF_YEAR - 3) & (n < 50), "synthetic")
            .when(sn.contains("world_bank"), "real")
            .when(gov, "real")
            .otherwise("unknown"))


def contract_scores_df(spark, sf) -> DataFrame:
    """The contract scores, computed once per application and written."""
    return materialized(spark, sf, "contract_scores", build_contract_scores)


def build_contract_scores(spark, sf) -> DataFrame:
    st = reduce(DataFrame.unionByName, [_stats(silver(spark, sf, a), a) for a in ARTIFACTS])
    null_pct = F.when(F.col("n_rows") > 0, F.col("null_cells") * 100.0 / (F.col("n_rows") * F.col("n_cols"))).otherwise(0.0)
    st = st.withColumn("null_pct", num(null_pct, 4))
    st = st.withColumn("source", detect_source_col(F.col("n_rows"), F.col("max_unique_ratio"), F.col("max_round_pct"),
                                                   F.col("min_year"), F.col("source_name")))
    src, np_ = F.col("source"), F.col("null_pct")
    base = (F.when(src == "real", 50).when(src == "proxy", 35).when(src == "fallback", 10)
            .when(src == "synthetic", 0).otherwise(15))
    nullb = F.when(np_ < 5, 30).when(np_ < 15, 20).when(np_ < 30, 10).otherwise(0)
    comp = F.lit(100.0) - np_
    compb = F.when(comp > 95, 15).when(comp > 85, 10).when(comp > 70, 5).otherwise(0)
    vol = (F.when(F.col("n_rows") >= 100, 5).when(F.col("n_rows") >= 50, 3).when(F.col("n_rows") >= 20, 1)
           .otherwise(0))
    conf = F.when(F.col("n_rows") == 0, 0.0).otherwise(
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), (base + nullb + compb + vol).cast("double"))))
    st = st.withColumn("confidence", conf)
    c = F.col("confidence")
    quality = (F.when((c >= 85) & (src == "real") & (np_ < 5), "excellent")
               .when((c >= 70) & src.isin("real", "proxy"), "good")
               .when(c >= 50, "fair").when(c >= 25, "poor").otherwise("unknown"))
    return st.select("artifact", "source_name", "n_rows", "null_pct", num("max_unique_ratio", 6).alias("max_unique_ratio"),
                     "source", "confidence", quality.alias("quality"),
                     ((c >= 70) & (src != "synthetic")).alias("trusted"),
                     F.col("min_year").cast("bigint").alias("min_year"), F.col("max_year").cast("bigint").alias("max_year"))


def _stats_sql(a: str) -> str:
    ints, dbls, texts = ARTIFACT_COLS[a]
    numeric, allc = ints + dbls, ints + dbls + texts
    src_name, view = ARTIFACTS[a]
    uniq = ", ".join(f"count(DISTINCT {c}) / count(*)" for c in numeric)
    rnd = ", ".join(f"CASE WHEN count({c}) > 5 THEN count_if({c} % 100 = 0) / count({c}) ELSE 0 END" for c in numeric)
    nulls = " + ".join(f"count_if({c} IS NULL)" for c in allc)
    return (f"SELECT '{a}' AS artifact, '{src_name}' AS source_name, {len(allc)} AS n_cols, count(*) AS n_rows, "
            f"{nulls} AS null_cells, GREATEST({uniq}, 0.0) AS max_unique_ratio, GREATEST({rnd}) AS max_round_pct, "
            f"min(year) AS min_year, max(year) AS max_year FROM {view}")


_GOV_SQL = " OR ".join(f"contains(lower(source_name), '{g}')" for g in GOV_SOURCES)
CONTRACT_CTE = (", cs0 AS (" + "\nUNION ALL\n".join(_stats_sql(a) for a in ARTIFACTS) + "),\n"
                f"cs1 AS (SELECT *, {N('CASE WHEN n_rows > 0 THEN null_cells * 100.0 / (n_rows * n_cols) ELSE 0 END', 4)} AS null_pct FROM cs0),\n"
                f"""cs2 AS (SELECT *, CASE WHEN n_rows = 0 THEN 'unknown' WHEN n_rows > 10 AND max_unique_ratio < 0.3 THEN 'synthetic'
  WHEN max_round_pct > 0.8 THEN 'synthetic' WHEN min_year >= {AS_OF_YEAR - 3} AND n_rows < 50 THEN 'synthetic'
  WHEN contains(lower(source_name), 'world_bank') THEN 'real' WHEN {_GOV_SQL} THEN 'real' ELSE 'unknown' END AS source FROM cs1),
cs3 AS (SELECT *, CASE WHEN n_rows = 0 THEN 0.0 ELSE LEAST(100.0, GREATEST(0.0, CAST(
  (CASE source WHEN 'real' THEN 50 WHEN 'proxy' THEN 35 WHEN 'fallback' THEN 10 WHEN 'synthetic' THEN 0 ELSE 15 END)
  + (CASE WHEN null_pct < 5 THEN 30 WHEN null_pct < 15 THEN 20 WHEN null_pct < 30 THEN 10 ELSE 0 END)
  + (CASE WHEN 100.0 - null_pct > 95 THEN 15 WHEN 100.0 - null_pct > 85 THEN 10 WHEN 100.0 - null_pct > 70 THEN 5 ELSE 0 END)
  + (CASE WHEN n_rows >= 100 THEN 5 WHEN n_rows >= 50 THEN 3 WHEN n_rows >= 20 THEN 1 ELSE 0 END) AS DOUBLE))) END AS confidence FROM cs2),
contract_scores AS (SELECT artifact, source_name, n_rows, null_pct, {N('max_unique_ratio', 6)} AS max_unique_ratio, source, confidence,
  CASE WHEN confidence >= 85 AND source = 'real' AND null_pct < 5 THEN 'excellent'
       WHEN confidence >= 70 AND source IN ('real', 'proxy') THEN 'good' WHEN confidence >= 50 THEN 'fair'
       WHEN confidence >= 25 THEN 'poor' ELSE 'unknown' END AS quality,
  confidence >= 70 AND source <> 'synthetic' AS trusted, min_year, max_year FROM cs3)""")


@query("contract_scores", with_silver(CONTRACT_CTE + "\nSELECT * FROM contract_scores"))
def contract_scores(spark, sf):
    """Source detection, confidence, quality class, trust flag."""
    return contract_scores_df(spark, sf)


@query("detect_source", with_silver(CONTRACT_CTE + "\nSELECT artifact, source FROM contract_scores"))
def detect_source(spark, sf):
    return contract_scores_df(spark, sf).select("artifact", "source")


# Lineage of the silver artifacts (ours): parents are panel views.
PARENTS = {
    "affordability": ["order_panel", "month_panel"],
    "interest_rate": ["month_panel"],
    "tourism_pressure": ["tourism_panel", "order_panel", "month_panel"],
    "supply_deficit": ["order_panel"],
    "rent_income": ["rent_panel", "order_panel", "month_panel"],
    "macro_volatility": ["month_panel"],
}


def _list_sql(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query("contract_build", with_silver(CONTRACT_CTE + ", par AS (SELECT * FROM (VALUES "
                                     + ", ".join(f"('{a}', {_list_sql(p)})" for a, p in PARENTS.items())
                                     + ") AS t(artifact, parents))\n"
                                     """SELECT c.artifact AS artifact_name, 'silver' AS layer, c.source, c.quality, c.confidence,
  c.n_rows AS row_count, c.null_pct, CAST(c.min_year AS VARCHAR) || '-01-01' AS date_min,
  CAST(c.max_year AS VARCHAR) || '-12-31' AS date_max, p.parents
FROM contract_scores c LEFT JOIN par p ON c.artifact = p.artifact"""))
def contract_build(spark, sf):
    """D5 + F23: one contract row per artifact — scores, counts, date span
    (min year → YYYY-01-01, max → YYYY-12-31) and parent list."""
    cs = contract_scores_df(spark, sf)
    par = spark.createDataFrame(list(PARENTS.items()), "artifact string, parents array<string>")
    j = cs.join(F.broadcast(par), "artifact", "left")
    return j.select(F.col("artifact").alias("artifact_name"), F.lit("silver").alias("layer"), "source", "quality",
                    "confidence", F.col("n_rows").alias("row_count"), "null_pct",
                    F.concat(F.col("min_year").cast("string"), F.lit("-01-01")).alias("date_min"),
                    F.concat(F.col("max_year").cast("string"), F.lit("-12-31")).alias("date_max"), "parents")


# Which source class each landed event stream has (ours).
BRONZE_SOURCE = {"purchase": "real", "signup": "real", "error": "fallback"}


def bronze_confidence(null_pct, n, source):
    """Confidence of a landed artifact: source base, null band, volume,
    clamped to 0-100; then a real source gains 20 (at most 100) and a
    fallback loses 30 (at least 10). Scores are fixed values."""
    base = F.when(source == "real", 50.0).when(source == "fallback", 10.0).otherwise(15.0)
    nulls = F.when(null_pct < 5, 30).when(null_pct < 15, 20).when(null_pct < 30, 10).otherwise(0)
    volume = F.when(n >= 100, 5).when(n >= 50, 3).when(n >= 20, 1).otherwise(0)
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), base + nulls + volume))
    return (F.when(source == "real", F.least(F.lit(100.0), score + 20))
            .when(source == "fallback", F.greatest(F.lit(10.0), score - 30)).otherwise(score))


@query("bronze_contract", f"""WITH st AS (SELECT event_type AS artifact, count(*) AS n,
  (count_if(ts IS NULL) + count_if(user_id IS NULL) + count_if(value IS NULL) + count_if(props IS NULL)) * 100.0 / (count(*) * 4) AS null_pct,
  CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BRONZE_SOURCE.items())} ELSE 'unknown' END AS source FROM events GROUP BY event_type),
sc AS (SELECT *, LEAST(100.0, GREATEST(0.0, CASE source WHEN 'real' THEN 50.0 WHEN 'fallback' THEN 10.0 ELSE 15.0 END
    + CASE WHEN null_pct < 5 THEN 30 WHEN null_pct < 15 THEN 20 WHEN null_pct < 30 THEN 10 ELSE 0 END
    + CASE WHEN n >= 100 THEN 5 WHEN n >= 50 THEN 3 WHEN n >= 20 THEN 1 ELSE 0 END)) AS score FROM st)
SELECT artifact, n AS record_count, {N('null_pct', 4)} AS null_pct, source,
  CAST(CASE source WHEN 'real' THEN LEAST(100.0, score + 20) WHEN 'fallback' THEN GREATEST(10.0, score - 30) ELSE score END AS DOUBLE) AS confidence FROM sc""")
def bronze_contract(spark, sf):
    """Contract of each landed event stream: mean null share of its
    fields, source class, confidence."""
    ev = table(spark, sf, "events", "event_type", "ts", "user_id", "value", "props")
    source = F.lit("unknown")
    for k, v in BRONZE_SOURCE.items():
        source = F.when(F.col("event_type") == k, v).otherwise(source)
    st = ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        (reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in ("ts", "user_id", "value", "props")]) * 100.0
         / (F.count(F.lit(1)) * 4)).alias("np")).withColumn("source", source)
    return st.select(F.col("event_type").alias("artifact"), F.col("n").alias("record_count"), num("np", 4).alias("null_pct"), "source",
                     bronze_confidence(F.col("np"), F.col("n"), F.col("source")).alias("confidence"))


# ------------------------------------------------------------------ D12 expectations
EXPECT = {
    "expect_row_count": ("orders", {"expectation_type": "expect_table_row_count_to_be_between",
                                    "kwargs": {"min_value": 100, "max_value": 100_000_000}}),
    "expect_columns_set": ("orders", {"expectation_type": "expect_table_columns_to_match_set",
                                      "kwargs": {"column_set": ["o_orderkey", "o_custkey", "o_totalprice"]}}),
    "expect_column_type": ("orders", {"expectation_type": "expect_column_values_to_be_of_type",
                                      "kwargs": {"column": "o_custkey", "type_": "float64"}}),
    "expect_not_null": ("orders", {"expectation_type": "expect_column_values_to_not_be_null",
                                   "kwargs": {"column": "o_totalprice", "mostly": 0.95}}),
    "expect_between": ("lineitem", {"expectation_type": "expect_column_values_to_be_between",
                                    "kwargs": {"column": "l_discount", "min_value": 0, "max_value": 0.1}}),
    "expect_in_set": ("orders", {"expectation_type": "expect_column_values_to_be_in_set",
                                 "kwargs": {"column": "o_orderstatus", "value_set": ["O", "F"]}}),
    "expect_unique": ("lineitem", {"expectation_type": "expect_column_values_to_be_unique",
                                   "kwargs": {"column": "l_orderkey", "mostly": 0.5}}),
    "expect_max_between": ("events", {"expectation_type": "expect_column_max_to_be_between",
                                      "kwargs": {"column": "value", "min_value": 0, "max_value": 1000}}),
    "expect_regex": ("events", {"expectation_type": "expect_column_values_to_match_regex",
                                "kwargs": {"column": "props", "regex": '^\\{"k": [0-9]+\\}$'}}),
}
EXPECT_SQL = {
    "expect_row_count": "SELECT count(*) >= 100 AND count(*) <= 100000000 AS success, CAST(count(*) AS DOUBLE) AS observed FROM orders",
    "expect_columns_set": "SELECT count(*) = 3 AS success, CAST(NULL AS DOUBLE) AS observed FROM information_schema.columns WHERE table_name = 'orders' AND column_name IN ('o_orderkey', 'o_custkey', 'o_totalprice')",
    "expect_column_type": "SELECT data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AS success, CAST(NULL AS DOUBLE) AS observed FROM information_schema.columns WHERE table_name = 'orders' AND column_name = 'o_custkey'",
    "expect_not_null": "SELECT count(o_totalprice) / count(*) >= 0.95 AS success, count(o_totalprice) / count(*) AS observed FROM orders",
    "expect_between": "SELECT count_if(l_discount < 0 OR l_discount > 0.1) = 0 AS success, CAST(count_if(l_discount < 0 OR l_discount > 0.1) AS DOUBLE) AS observed FROM lineitem",
    "expect_in_set": "SELECT count_if(o_orderstatus NOT IN ('O', 'F')) = 0 AS success, CAST(count_if(o_orderstatus NOT IN ('O', 'F')) AS DOUBLE) AS observed FROM orders",
    "expect_unique": "SELECT count(DISTINCT l_orderkey) / count(l_orderkey) >= 0.5 AS success, count(DISTINCT l_orderkey) / count(l_orderkey) AS observed FROM lineitem",
    "expect_max_between": "SELECT max(value) >= 0 AND max(value) <= 1000 AS success, max(value) AS observed FROM events",
    "expect_regex": "SELECT count_if(NOT regexp_matches(props, '^\\{\"k\": [0-9]+\\}$')) = 0 AS success, CAST(count_if(NOT regexp_matches(props, '^\\{\"k\": [0-9]+\\}$')) AS DOUBLE) AS observed FROM events",
}


def _expect_query(name):
    tbl, exp = EXPECT[name]

    def fn(spark, sf):
        return run_suite(table(spark, sf, tbl), [exp]).select("success", "observed")
    fn.__name__ = name
    fn.__doc__ = f"D12: {exp['expectation_type']} on {tbl}."
    return fn


for _n in EXPECT:
    query(_n, EXPECT_SQL[_n])(_expect_query(_n))

EXPECT_SUITE_SQL = """SELECT 0 AS idx, 'expect_table_row_count_to_be_between' AS expectation_type, CAST(NULL AS VARCHAR) AS column, count(*) >= 100 AND count(*) <= 100000000 AS success, CAST(count(*) AS DOUBLE) AS observed FROM orders
UNION ALL SELECT 1, 'expect_table_columns_to_match_set', NULL, (SELECT count(*) = 3 FROM information_schema.columns WHERE table_name = 'orders' AND column_name IN ('o_orderkey', 'o_custkey', 'o_totalprice')), NULL
UNION ALL SELECT 2, 'expect_column_values_to_be_of_type', 'o_custkey', (SELECT data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') FROM information_schema.columns WHERE table_name = 'orders' AND column_name = 'o_custkey'), NULL
UNION ALL SELECT 3, 'expect_column_values_to_not_be_null', 'o_totalprice', count(o_totalprice) / count(*) >= 0.95, count(o_totalprice) / count(*) FROM orders
UNION ALL SELECT 4, 'expect_column_values_to_be_in_set', 'o_orderstatus', count_if(o_orderstatus NOT IN ('O', 'F')) = 0, CAST(count_if(o_orderstatus NOT IN ('O', 'F')) AS DOUBLE) FROM orders
UNION ALL SELECT 5, 'expect_table_columns_to_match_ordered_list', NULL, (SELECT list(column_name ORDER BY ordinal_position) = ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'] FROM information_schema.columns WHERE table_name = 'orders'), NULL
UNION ALL SELECT 6, 'expect_column_values_to_be_between', 'o_totalprice', count_if(o_totalprice < 0) = 0, CAST(count_if(o_totalprice < 0) AS DOUBLE) FROM orders"""

ORDERS_SUITE = [exp for tbl, exp in EXPECT.values() if tbl == "orders"] + [
    {"expectation_type": "expect_table_columns_to_match_ordered_list",
     "kwargs": {"column_list": list(ORDERS_CLASSES)}},
    {"expectation_type": "expect_column_values_to_be_between",
     "kwargs": {"column": "o_totalprice", "min_value": 0}},
]


@query("expect_suite", EXPECT_SUITE_SQL)
def expect_suite(spark, sf):
    """A whole suite over orders in one aggregate pass."""
    return run_suite(table(spark, sf, "orders"), ORDERS_SUITE)


# ------------------------------------------------------------------ D13 / A15 layers
SILVER_SUITE = [
    {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1}},
    {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "year"}},
    {"expectation_type": "expect_column_values_to_be_between",
     "kwargs": {"column": "year", "min_value": 1990, "max_value": 2030}},
]
GOLD_SUITE = [
    {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1}},
    {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "kpi_value", "mostly": 0.9}},
    {"expectation_type": "expect_table_columns_to_match_set",
     "kwargs": {"column_set": ["kpi_name", "kpi_value", "unit"]}},
]


def validate_layers_df(spark, sf) -> DataFrame:
    from .gold import GOLD
    parts = [run_suite(silver(spark, sf, a), SILVER_SUITE).withColumn("layer", F.lit("silver"))
             .withColumn("asset", F.lit(a)) for a in ARTIFACTS]
    parts += [run_suite(GOLD[g](spark, sf), GOLD_SUITE).withColumn("layer", F.lit("gold"))
              .withColumn("asset", F.lit(f"gold_{g}")) for g in GOLD]
    return reduce(DataFrame.unionByName, parts)


def _layers_sql():
    sil = []
    for a, (_, view) in ARTIFACTS.items():
        sil.append(f"SELECT 'silver' AS layer, '{a}' AS asset, 0 AS idx, count(*) >= 1 AS success FROM {view}")
        sil.append(f"SELECT 'silver', '{a}', 1, count(year) / count(*) >= 1.0 FROM {view}")
        sil.append(f"SELECT 'silver', '{a}', 2, count_if(year < 1990 OR year > 2030) = 0 FROM {view}")
    for g in ["executive", "housing", "tourism", "macro", "affordability", "forecast"]:
        sil.append(f"SELECT 'gold', 'gold_{g}', 0, count(*) >= 1 FROM gold_{g}")
        sil.append(f"SELECT 'gold', 'gold_{g}', 1, count(kpi_value) / count(*) >= 0.9 FROM gold_{g}")
        sil.append(f"SELECT 'gold', 'gold_{g}', 2, true FROM (SELECT 1)")
    return "\nUNION ALL\n".join(sil)


@query("validate_layers", with_kpis(", vr AS (" + _layers_sql() + ")\nSELECT layer, asset, idx, success FROM vr"))
def validate_layers(spark, sf):
    """Suites over every silver and gold table, one result table."""
    return validate_layers_df(spark, sf).select("layer", "asset", "idx", "success")


RUN_TS = "2024-02-01 00:00:00"


@query("validation_rollup", with_kpis(", vr AS (" + _layers_sql() + ")\n" + """SELECT COALESCE(layer, 'ALL') AS layer,
  count(*) AS total, count_if(success) AS passed, count_if(NOT success) AS failed,
  CAST(ROUND(CAST(count_if(success) * 100.0 / count(*) AS DECIMAL(38,6)), 2) AS DOUBLE) AS success_rate,
  bool_and(success) AS all_passed, '2024-02-01 00:00:00' AS latest_run
FROM vr GROUP BY ROLLUP (layer)"""))
def validation_rollup(spark, sf):
    """Totals, pass/fail, success rate, all-passed per layer + overall."""
    v = validate_layers_df(spark, sf)
    g = v.rollup("layer").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("passed"),
                              F.count_if(~F.col("success")).alias("failed"),
                              num(F.count_if("success") * 100.0 / F.count(F.lit(1)), 2).alias("success_rate"),
                              F.bool_and("success").alias("all_passed"))
    return g.select(F.coalesce("layer", F.lit("ALL")).alias("layer"), "total", "passed", "failed", "success_rate",
                    "all_passed", F.lit(RUN_TS).alias("latest_run"))


# ------------------------------------------------------------------ D14 / D15 gold checks
@query("kpi_tests", with_kpis("""SELECT kpi_name, dashboard, kpi_value,
  CASE WHEN kpi_name IS NULL OR kpi_value IS NULL OR unit IS NULL THEN 'required_null' ELSE 'negative_value' END AS violation
FROM kpis WHERE kpi_name IS NULL OR kpi_value IS NULL OR unit IS NULL OR kpi_value < 0"""))
def kpi_tests(spark, sf):
    """Generic tests returning violating rows (required non-NULL,
    values non-negative)."""
    k = kpis(spark, sf)
    req = F.col("kpi_name").isNull() | F.col("kpi_value").isNull() | F.col("unit").isNull()
    return (k.filter(req | (F.col("kpi_value") < 0))
            .select("kpi_name", "dashboard", "kpi_value",
                    F.when(req, "required_null").otherwise("negative_value").alias("violation")))


EXPECTED_DASHBOARDS = ["executive", "housing", "tourism", "macro", "affordability", "forecast", "rental"]
GOLD_AS_OF = "2001-12-31"


@query("gold_check", with_kpis("SELECT e.dashboard, k.n IS NOT NULL AS present, COALESCE(k.n, 0) AS n_rows, COALESCE(k.nulls, 0) AS null_values, "
                               "COALESCE(k.n, 0) = 0 AS empty, COALESCE(date_diff('day', make_date(k.y, 12, 31), DATE '" + GOLD_AS_OF + "') <= 45, false) AS fresh "
                               "FROM (VALUES " + ", ".join(f"('{d}')" for d in EXPECTED_DASHBOARDS) + ") AS e(dashboard) "
                               "LEFT JOIN (SELECT dashboard, count(*) AS n, count_if(kpi_value IS NULL) AS nulls, "
                               "(SELECT max(year) FROM unified) AS y FROM kpis GROUP BY dashboard) k ON k.dashboard = e.dashboard"))
def gold_check(spark, sf):
    """Expected dashboards present (anti join), rows, NULL values,
    empty, and freshness ≤ 45 days of the data's latest year-end."""
    from .features import silver as sv
    k = kpis(spark, sf)
    y = sv(spark, sf, "unified_base").select(F.max("year")).scalar()
    g = k.groupBy("dashboard").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kpi_value").isNull()).alias("nulls"))
    exp = spark.createDataFrame([(d,) for d in EXPECTED_DASHBOARDS], "dashboard string")
    j = exp.join(g, "dashboard", "left")
    age = F.datediff(F.to_date(F.lit(GOLD_AS_OF)), F.make_date(y, F.lit(12), F.lit(31)))
    return j.select("dashboard", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).alias("n_rows"),
                    F.coalesce("nulls", F.lit(0)).alias("null_values"), (F.coalesce("n", F.lit(0)) == 0).alias("empty"),
                    F.when(F.col("n").isNotNull(), age <= 45).otherwise(False).alias("fresh"))


# ------------------------------------------------------------------ D16–D18 freshness / SLA / bronze quality
EVENTS_AS_OF = "2024-02-01 00:00:00"
# Freshness limits in days per source (ours: the five event streams).
FRESH_LIMIT = {"signup": 7, "error": 7, "click": 14, "view": 30, "purchase": 90}
_LIMIT_VALUES = ", ".join(f"('{k}', {v})" for k, v in FRESH_LIMIT.items())


def _age_days(ts):
    return (F.unix_timestamp(F.lit(EVENTS_AS_OF).cast("timestamp_ntz")) - F.unix_timestamp(ts)) / 86400.0


_SCORE_SQL = ("CASE WHEN r IS NULL THEN 0 WHEN r <= 1 THEN GREATEST(0, 100 - 30 * r) WHEN r <= 2 THEN GREATEST(0, 70 - 30 * r) "
              "ELSE GREATEST(0, 40 - 20 * r) END")


@query("freshness_score", f"""WITH last AS (SELECT event_type AS source, max(ts) AS last_ts FROM events GROUP BY 1),
s AS (SELECT lim.source, date_diff('second', l.last_ts, TIMESTAMP '{EVENTS_AS_OF}') / 86400.0 / lim.d AS r
      FROM (VALUES {_LIMIT_VALUES}) AS lim(source, d) LEFT JOIN last l ON l.source = lim.source)
SELECT source, {N('r', 6)} AS age_ratio,
  CASE WHEN r IS NULL THEN 'missing' WHEN r <= 1 THEN 'fresh' WHEN r <= 2 THEN 'aging' ELSE 'stale' END AS status,
  {N(_SCORE_SQL, 2)} AS score,
  {N("avg(CASE WHEN r IS NOT NULL THEN " + _SCORE_SQL + " END) OVER ()", 2)} AS mean_score
FROM s""")
def freshness_score(spark, sf):
    """Per-source freshness score from age/limit: fresh 100−30r,
    aging 70−30r, stale 40−20r; a source with no ingest scores 0 and is
    left out of the mean."""
    ev = table(spark, sf, "events", "event_type", "ts")
    last = ev.groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last_ts"))
    lim = spark.createDataFrame(list(FRESH_LIMIT.items()), "source string, d int")
    j = F.broadcast(lim).join(last, "source", "left")
    r = (F.unix_timestamp(F.lit(EVENTS_AS_OF).cast("timestamp_ntz")) - F.unix_timestamp("last_ts")) / 86400.0 / F.col("d")
    j = j.withColumn("r", r)
    rr = F.col("r")
    score = (F.when(rr.isNull(), 0.0).when(rr <= 1, F.greatest(F.lit(0.0), 100 - 30 * rr))
             .when(rr <= 2, F.greatest(F.lit(0.0), 70 - 30 * rr)).otherwise(F.greatest(F.lit(0.0), 40 - 20 * rr)))
    j = j.withColumn("score_raw", score)
    mean = j.agg(num(F.avg(F.when(rr.isNotNull(), F.col("score_raw"))), 2).alias("mean_score"))
    return j.crossJoin(mean).select(
        "source", num(rr, 6).alias("age_ratio"),
        F.when(rr.isNull(), "missing").when(rr <= 1, "fresh").when(rr <= 2, "aging").otherwise("stale").alias("status"),
        num("score_raw", 2).alias("score"), "mean_score")


@query("source_sla", f"""SELECT event_type AS source, {N(f"date_diff('second', max(ts), TIMESTAMP '{EVENTS_AS_OF}') / 86400.0", 4)} AS age_days,
  CASE WHEN date_diff('second', max(ts), TIMESTAMP '{EVENTS_AS_OF}') / 86400.0 > 30 THEN 'error'
       WHEN date_diff('second', max(ts), TIMESTAMP '{EVENTS_AS_OF}') / 86400.0 > 7 THEN 'warn' ELSE 'pass' END AS sla_status
FROM events GROUP BY event_type""")
def source_sla(spark, sf):
    """Source SLA — warn after 7 days, error after 30."""
    ev = table(spark, sf, "events", "event_type", "ts")
    g = ev.groupBy(F.col("event_type").alias("source")).agg(_age_days(F.max("ts")).alias("a"))
    return g.select("source", num("a", 4).alias("age_days"),
                    F.when(F.col("a") > 30, "error").when(F.col("a") > 7, "warn").otherwise("pass").alias("sla_status"))


@query("bronze_quality", f"""SELECT event_type AS source, count(*) AS n_records,
  count_if(json_valid(props) IS NOT TRUE) AS bad_json, count_if(json_extract(props, '$.k') IS NULL) AS missing_data_key,
  GREATEST(0, LEAST(100, 80
    - CASE WHEN count_if(user_id IS NULL) > 0 THEN 5 ELSE 0 END
    - CASE WHEN count_if(json_extract(props, '$.k') IS NULL) > 0 THEN 10 ELSE 0 END
    - LEAST(20, GREATEST(0, date_diff('day', max(ts), TIMESTAMP '{EVENTS_AS_OF}') - 30))
    - CASE WHEN count_if(json_valid(props) IS NOT TRUE) > 0 THEN 15 ELSE 0 END)) AS quality_score
FROM events GROUP BY event_type""")
def bronze_quality(spark, sf):
    """Bronze quality 80 minus penalties (−5 metadata, −10 data key,
    −min(20, age−30), −15 bad JSON), clamped, per source."""
    ev = table(spark, sf, "events", "event_type", "user_id", "props", "ts")
    ev = ev.withColumn("_p", F.from_json("props", "struct<k:long,_bad:string>",
                                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_p").isNull() | F.col("_p._bad").isNotNull()
    nokey = F.get_json_object("props", "$.k").isNull()
    g = ev.groupBy(F.col("event_type").alias("source")).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(bad).alias("bad_json"),
        F.count_if(nokey).alias("missing_data_key"), F.count_if(F.col("user_id").isNull()).alias("_nometa"),
        F.max("ts").alias("_last"))
    age = F.datediff(F.lit(EVENTS_AS_OF).cast("timestamp_ntz"), F.col("_last"))
    score = (F.lit(80) - F.when(F.col("_nometa") > 0, 5).otherwise(0)
             - F.when(F.col("missing_data_key") > 0, 10).otherwise(0)
             - F.least(F.lit(20), F.greatest(F.lit(0), age - 30))
             - F.when(F.col("bad_json") > 0, 15).otherwise(0))
    return g.select("source", "n_records", "bad_json", "missing_data_key",
                    F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint").alias("quality_score"))


# ------------------------------------------------------------------ D19 / A16 / A19 / D25 / A14 over KPIs
@query("dashboard_quality", with_kpis("""SELECT dashboard, GREATEST(0, LEAST(100, 50
  + CASE WHEN bool_or(contains(source, 'World Bank')) THEN 20 ELSE 0 END
  + CASE WHEN bool_or(contains(source, 'Stats NZ')) THEN 20 ELSE 0 END
  + CASE WHEN bool_or(contains(source, 'Real')) THEN 15 ELSE 0 END
  - CASE WHEN bool_or(contains(source, 'Synthetic')) THEN 10 ELSE 0 END
  - CASE WHEN bool_or(contains(source, 'Proxy')) THEN 5 ELSE 0 END
  - CASE WHEN bool_or(contains(source, 'Estimated')) THEN 5 ELSE 0 END
  + CASE WHEN count_if(kpi_name IS NULL OR kpi_value IS NULL OR unit IS NULL) = 0 THEN 15 ELSE 0 END
  + CASE WHEN count(*) >= 5 THEN 5 ELSE 0 END + CASE WHEN count(*) >= 10 THEN 5 ELSE 0 END)) AS quality_score
FROM kpis GROUP BY dashboard"""))
def dashboard_quality(spark, sf):
    """Dashboard quality score: 50 + source bonuses/penalties +
    complete columns + volume, clamped 0–100."""
    k = kpis(spark, sf)
    has = lambda t: F.bool_or(F.col("source").contains(t))
    score = (F.lit(50) + F.when(has("World Bank"), 20).otherwise(0) + F.when(has("Stats NZ"), 20).otherwise(0)
             + F.when(has("Real"), 15).otherwise(0) - F.when(has("Synthetic"), 10).otherwise(0)
             - F.when(has("Proxy"), 5).otherwise(0) - F.when(has("Estimated"), 5).otherwise(0)
             + F.when(F.count_if(F.col("kpi_name").isNull() | F.col("kpi_value").isNull() | F.col("unit").isNull()) == 0, 15)
             .otherwise(0)
             + F.when(F.count(F.lit(1)) >= 5, 5).otherwise(0) + F.when(F.count(F.lit(1)) >= 10, 5).otherwise(0))
    return k.groupBy("dashboard").agg(F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint").alias("quality_score"))


REQUIRED = ["kpi_name", "kpi_value", "unit", "description", "category"]


@query("completeness", with_kpis("SELECT dashboard, count(*) AS n_rows, count_if("
                                 + " AND ".join(f"{c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> ''" for c in REQUIRED)
                                 + ") AS complete_rows, " + ", ".join(
                                     f"count_if({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS missing_{c}" for c in REQUIRED)
                                 + ", " + N("count_if(" + " AND ".join(f"{c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> ''" for c in REQUIRED)
                                            + ") * 100.0 / count(*)", 2) + " AS completeness_pct FROM kpis GROUP BY dashboard"))
def completeness(spark, sf):
    """Rows with every required field non-blank, missing count per
    field and the completeness %."""
    k = kpis(spark, sf)
    ok = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    allok = reduce(lambda a, b: a & b, [ok(c) for c in REQUIRED])
    return k.groupBy("dashboard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(allok).alias("complete_rows"),
        *[F.count_if(~ok(c)).alias(f"missing_{c}") for c in REQUIRED],
        num(F.count_if(allok) * 100.0 / F.count(F.lit(1)), 2).alias("completeness_pct"))


_KP0 = ", kp0 AS (SELECT *, CAST(" + SQ.confidence() + " AS DOUBLE) AS confidence FROM kpis)\n"


@query("dashboard_summary", with_kpis(_KP0 + """SELECT dashboard, count(*) AS n_rows, count_if(kpi_name IS NULL OR kpi_value IS NULL) = 0 AS schema_ok,
  CASE WHEN count(DISTINCT source) = 1 THEN min(source) ELSE 'Mixed' END AS source,
  """ + N("avg(confidence)", 4) + """ AS avg_confidence,
  avg(confidence) >= 70 AND NOT bool_or(contains(lower(source), 'synthetic')) AS trusted
FROM kp0 GROUP BY dashboard"""))
def dashboard_summary(spark, sf):
    """A19 + D6: per dashboard: rows, schema ok, single-or-mixed source,
    mean confidence and trust flag."""
    p = processed(spark, sf)
    return p.groupBy("dashboard").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count_if(F.col("kpi_name").isNull() | F.col("kpi_value").isNull()) == 0).alias("schema_ok"),
        F.when(F.count_distinct("source") == 1, F.min("source")).otherwise("Mixed").alias("source"),
        num(F.avg("confidence"), 4).alias("avg_confidence"),
        ((F.avg("confidence") >= 70) & ~F.bool_or(F.lower("source").contains("synthetic"))).alias("trusted"))


@query("trust_warnings", with_kpis(_KP0 + """SELECT dashboard,
  CASE WHEN bool_or(contains(lower(source), 'synthetic')) THEN 'synthetic source'
       ELSE 'low confidence (' || CAST(CAST(ROUND(CAST(avg(confidence) AS DECIMAL(38,6)), 1) AS DOUBLE) AS VARCHAR) || ')' END AS reason
FROM kp0 GROUP BY dashboard
HAVING NOT (avg(confidence) >= 70 AND NOT bool_or(contains(lower(source), 'synthetic')))"""))
def trust_warnings(spark, sf):
    """Warnings for untrusted dashboards, with the reason."""
    p = processed(spark, sf)
    g = p.groupBy("dashboard").agg(F.avg("confidence").alias("c"),
                                   F.bool_or(F.lower("source").contains("synthetic")).alias("syn"))
    g = g.filter(~((F.col("c") >= 70) & ~F.col("syn")))
    return g.select("dashboard", F.when(F.col("syn"), "synthetic source")
                    .otherwise(F.concat(F.lit("low confidence ("), num("c", 1).cast("string"), F.lit(")"))).alias("reason"))


@query("quality_report", with_silver(CONTRACT_CTE + """
SELECT COALESCE(layer, 'TOTAL') AS layer, COALESCE(source, 'ALL') AS source, count(*) AS n_artifacts,
  CAST(ROUND(CAST(avg(confidence) AS DECIMAL(38,6)), 2) AS DOUBLE) AS avg_confidence,
  count_if(quality IN ('excellent', 'good')) AS n_good
FROM (SELECT 'silver' AS layer, * FROM contract_scores) GROUP BY CUBE (layer, source)"""))
def quality_report(spark, sf):
    """Per layer × source breakdown with totals (CUBE): artifact
    count, mean confidence, good-or-better count."""
    cs = contract_scores_df(spark, sf).withColumn("layer", F.lit("silver"))
    g = cs.cube("layer", "source").agg(F.count(F.lit(1)).alias("n_artifacts"),
                                       num(F.avg("confidence"), 2).alias("avg_confidence"),
                                       F.count_if(F.col("quality").isin("excellent", "good")).alias("n_good"))
    return g.select(F.coalesce("layer", F.lit("TOTAL")).alias("layer"), F.coalesce("source", F.lit("ALL")).alias("source"),
                    "n_artifacts", "avg_confidence", "n_good")


# ------------------------------------------------------------------ D20 health, D21 alerts, D22 metrics
@query("health", with_kpis(", lay AS (" + " UNION ALL ".join(
    [f"SELECT 'silver' AS layer, '{a}' AS asset, count(*) AS n, count_if(year IS NULL) AS nulls FROM {v}" for a, (_, v) in ARTIFACTS.items()]
    + [f"SELECT 'gold', 'gold_{g}', count(*), count_if(kpi_value IS NULL) FROM gold_{g}"
       for g in ["executive", "housing", "tourism", "macro", "affordability", "forecast"]]) + """)
SELECT COALESCE(layer, 'overall') AS layer,
  CASE WHEN count(*) = 0 THEN 'missing' WHEN count_if(n = 0) > 0 THEN 'empty' WHEN sum(nulls) > 0 THEN 'warning' ELSE 'healthy' END AS status,
  count(*) AS n_assets, CAST(sum(n) AS BIGINT) AS n_rows
FROM lay GROUP BY ROLLUP (layer)"""))
def health(spark, sf):
    """Health per layer (missing / empty / warning / healthy) and overall."""
    from .gold import GOLD
    parts = [silver(spark, sf, a).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("year").isNull()).alias("nulls"))
             .select(F.lit("silver").alias("layer"), F.lit(a).alias("asset"), "n", "nulls") for a in ARTIFACTS]
    parts += [GOLD[g](spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kpi_value").isNull()).alias("nulls"))
              .select(F.lit("gold").alias("layer"), F.lit(f"gold_{g}").alias("asset"), "n", "nulls") for g in GOLD]
    lay = reduce(DataFrame.unionByName, parts)
    g = lay.rollup("layer").agg(F.count(F.lit(1)).alias("n_assets"), F.sum("n").cast("bigint").alias("n_rows"),
                                F.count_if(F.col("n") == 0).alias("_e"), F.sum("nulls").alias("_nulls"))
    st = (F.when(F.col("n_assets") == 0, "missing").when(F.col("_e") > 0, "empty").when(F.col("_nulls") > 0, "warning")
          .otherwise("healthy"))
    return g.select(F.coalesce("layer", F.lit("overall")).alias("layer"), st.alias("status"), "n_assets", "n_rows")


LOW_CONFIDENCE = 75.0


@query("low_confidence", with_kpis(", kp0 AS (SELECT *, CAST(" + SQ.confidence() + " AS DOUBLE) AS confidence FROM kpis)\n"
                                   f"""SELECT kpi_name, dashboard, confidence, 'WARNING' AS severity,
  'Low confidence KPI: ' || kpi_name || ' (' || CAST(confidence AS VARCHAR) || ' < {LOW_CONFIDENCE})' AS message
FROM kp0 WHERE confidence < {LOW_CONFIDENCE}"""))
def low_confidence(spark, sf):
    """Alert rows for KPIs below the confidence threshold."""
    p = processed(spark, sf).filter(F.col("confidence") < LOW_CONFIDENCE)
    msg = F.concat(F.lit("Low confidence KPI: "), F.col("kpi_name"), F.lit(" ("), F.col("confidence").cast("string"),
                   F.lit(f" < {LOW_CONFIDENCE})"))
    return p.select("kpi_name", "dashboard", "confidence", F.lit("WARNING").alias("severity"), msg.alias("message"))


@query("kpi_to_metrics", with_kpis(", kp0 AS (SELECT *, CAST(" + SQ.confidence() + " AS DOUBLE) AS confidence FROM kpis)\n"
                                   """SELECT 'kpi.' || metric AS name, v AS value, 'gauge' AS type, kpi_name AS tag_kpi, dashboard AS tag_dashboard
FROM kp0 UNPIVOT (v FOR metric IN (kpi_value AS 'value', confidence AS 'confidence'))"""))
def kpi_to_metrics(spark, sf):
    """KPI rows → metric points (value and confidence) with tags."""
    p = processed(spark, sf).select("kpi_name", "dashboard", F.col("kpi_value").alias("value"), "confidence")
    u = p.unpivot(["kpi_name", "dashboard"], ["value", "confidence"], "metric", "v")
    return u.select(F.concat(F.lit("kpi."), F.col("metric")).alias("name"), F.col("v").alias("value"),
                    F.lit("gauge").alias("type"), F.col("kpi_name").alias("tag_kpi"),
                    F.col("dashboard").alias("tag_dashboard"))


# ------------------------------------------------------------------ D7–D11 schema / record validation
REQUIRED_COLS = {"orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"],
                 "events": ["event_id", "ts", "user_id", "event_type", "value", "props", "missing_col"]}


@query("schema_check", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}' AND column_name = '{c}') > 0 AS present"
    for t, cs in REQUIRED_COLS.items() for c in cs))
def schema_check(spark, sf):
    """Required columns present (schema inspection, metadata only)."""
    rows = []
    for t, cs in REQUIRED_COLS.items():
        have = set(table(spark, sf, t).columns)
        rows += [(t, c, c in have) for c in cs]
    return spark.createDataFrame(rows, "table_name string, column_name string, present boolean")


# Frame schema for orders (ours): column → (required, type, min, max).
ORDERS_SCHEMA = {"o_orderkey": (True, "integer", 0.0, None), "o_custkey": (True, "integer", 0.0, None),
                 "o_totalprice": (True, "float", 0.0, 600000.0), "o_orderdate": (True, "datetime", None, None),
                 "o_orderpriority": (False, "integer", None, None)}
_CAST = {"integer": "bigint", "float": "double", "datetime": "timestamp"}


def validate_frame(df: DataFrame, schema: dict, level: str = "moderate") -> DataFrame:
    """(column_name, check_name, violations, severity) of every check,
    counted in one aggregate.

    Required columns must be there and have no NULL; above 50 % NULL it is
    a warning instead, but for the lenient level. Bounds hold for numeric
    columns. The strict level also counts values that do not convert to
    the column's type. A frame passes when no row is an error."""
    if level not in ("lenient", "moderate", "strict"):
        raise ValueError(f"unknown level {level!r}")
    kinds = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("_n")]
    checks = []

    def check(col, name, cond=None, severity=None):
        key = f"_c{len(checks)}"
        n = F.lit(1).cast("bigint") if cond is None else F.col(key)
        if cond is not None:
            aggs.append(F.count_if(F.coalesce(cond, F.lit(False))).alias(key))
        bad = F.lit("error") if severity is None else severity(n)
        checks.append(F.struct(F.lit(col).alias("column_name"), F.lit(name).alias("check_name"), n.alias("violations"),
                               F.when(n == 0, "ok").otherwise(bad).alias("severity")))

    for col, (required, kind, lo, hi) in schema.items():
        if col not in kinds:
            if required:
                check(col, "missing")
            continue
        if required:
            check(col, "null", F.col(col).isNull(),
                  lambda n: F.when((n * 100.0 / F.col("_n") > 50) & F.lit(level != "lenient"), "warning").otherwise("error"))
        if level == "strict" and kind in _CAST:
            check(col, "type", F.col(col).isNotNull() & F.col(col).cast("string").try_cast(_CAST[kind]).isNull())
        numeric = kinds[col] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[col].startswith("decimal")
        if lo is not None and numeric:
            check(col, "min", F.col(col) < lo)
        if hi is not None and numeric:
            check(col, "max", F.col(col) > hi)
    return df.agg(*aggs).select(F.inline(F.array(*checks)))


def merge_validations(*results: DataFrame) -> DataFrame:
    """One row for several validations: passed, errors, warnings."""
    rows = reduce(DataFrame.unionByName, results)
    return rows.agg(F.coalesce(F.bool_and(F.col("severity") != "error"), F.lit(True)).alias("passed"),
                    F.count_if(F.col("severity") == "error").alias("errors"),
                    F.count_if(F.col("severity") == "warning").alias("warnings"))


def _frame_sql() -> str:
    duck = {"integer": "BIGINT", "float": "DOUBLE", "datetime": "TIMESTAMP"}
    out = []
    for c, (req, kind, lo, hi) in ORDERS_SCHEMA.items():
        conds = [("null", f"{c} IS NULL")] if req else []
        conds.append(("type", f"{c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS {duck[kind]}) IS NULL"))
        conds += [("min", f"{c} < {lo}")] if lo is not None else []
        conds += [("max", f"{c} > {hi}")] if hi is not None else []
        for name, cond in conds:
            warn = "WHEN n * 100.0 / total > 50 THEN 'warning'" if name == "null" else ""
            out.append(f"SELECT '{c}' AS column_name, '{name}' AS check_name, n AS violations, CASE WHEN n = 0 THEN 'ok' {warn} ELSE 'error' END AS severity "
                       f"FROM (SELECT count_if({cond}) AS n, count(*) AS total FROM orders)")
    return " UNION ALL ".join(out)


@query("frame_validate", _frame_sql())
def frame_validate(spark, sf):
    """The strict validator over orders; the priority's text is no
    integer, so its type check finds every row."""
    return validate_frame(table(spark, sf, "orders", *ORDERS_SCHEMA), ORDERS_SCHEMA, "strict")


@query("silver_check", with_silver(" UNION ALL ".join(
    f"SELECT '{a}' AS artifact, count(year) = count(*) AS key_ok, " + " + ".join(
        f"CASE WHEN count({c}) < count(*) * 0.5 THEN 1 ELSE 0 END" for c in ARTIFACT_COLS[a][1]) + " AS n_sparse_columns FROM " + v
    for a, (_, v) in ARTIFACTS.items())))
def silver_check(spark, sf):
    """Silver feature check — key column complete, number of numeric
    columns more than 50 % NULL (warnings)."""
    parts = []
    for a in ARTIFACTS:
        df = silver(spark, sf, a)
        sparse = reduce(lambda x, y: x + y, [F.when(F.count(c) < F.count(F.lit(1)) * 0.5, 1).otherwise(0)
                                             for c in ARTIFACT_COLS[a][1]])
        parts.append(df.agg((F.count("year") == F.count(F.lit(1))).alias("key_ok"), sparse.alias("n_sparse_columns"))
                     .select(F.lit(a).alias("artifact"), "key_ok", "n_sparse_columns"))
    return reduce(DataFrame.unionByName, parts)


@query("schema_compat", None)
def schema_compat(spark, sf):
    """Pairwise schema compatibility of two tables (metadata): columns
    in both (with type match), only left, only right."""
    a = silver(spark, sf, "rent_income").schema
    b = silver(spark, sf, "rent_income_proxy").schema
    an, bn = {f.name: f.dataType.simpleString() for f in a}, {f.name: f.dataType.simpleString() for f in b}
    rows = ([(c, "both", an[c] == bn[c]) for c in an if c in bn] + [(c, "left_only", False) for c in an if c not in bn]
            + [(c, "right_only", False) for c in bn if c not in an])
    return spark.createDataFrame(rows, "column_name string, side string, type_match boolean")


@query("record_validate", """SELECT event_id,
  len(list_filter([CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'k not numeric' END,
                   CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) NOT BETWEEN 0 AND 100 THEN 'k out of range' END,
                   CASE WHEN value < 0 THEN 'negative value' END,
                   CASE WHEN event_type NOT IN ('signup', 'click', 'view', 'purchase') THEN 'unknown event type' END,
                   CASE WHEN value > 300 THEN 'value above 300' END], lambda x: x IS NOT NULL)) = 0 AS is_valid,
  list_filter([CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'k not numeric' END,
                   CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) NOT BETWEEN 0 AND 100 THEN 'k out of range' END,
                   CASE WHEN value < 0 THEN 'negative value' END,
                   CASE WHEN event_type NOT IN ('signup', 'click', 'view', 'purchase') THEN 'unknown event type' END,
                   CASE WHEN value > 300 THEN 'value above 300' END], lambda x: x IS NOT NULL) AS errors
FROM events""")
def record_validate(spark, sf):
    """Record-level rules → error array per record; valid/invalid split."""
    ev = table(spark, sf, "events", "event_id", "props", "value", "event_type")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    errs = F.array_compact(F.array(
        F.when(k.isNull(), "k not numeric"),
        F.when(~k.between(0, 100), "k out of range"),
        F.when(F.col("value") < 0, "negative value"),
        F.when(~F.col("event_type").isin("signup", "click", "view", "purchase"), "unknown event type"),
        F.when(F.col("value") > 300, "value above 300")))
    return ev.select("event_id", (F.size(errs) == 0).alias("is_valid"), errs.alias("errors"))


# ------------------------------------------------------------------ D26/D27/J17/J18 catalog
def catalog_df(spark, sf) -> DataFrame:
    cs = contract_scores_df(spark, sf)
    par = spark.createDataFrame(list(PARENTS.items()), "name string, parents array<string>")
    tags = spark.createDataFrame([(a, ["silver", a.split("_")[0]]) for a in ARTIFACTS], "name string, tags array<string>")
    base = cs.select(F.col("artifact").alias("name"), F.lit("silver").alias("layer"),
                     F.col("n_rows").alias("row_count"), "source", "confidence")
    return base.join(F.broadcast(par), "name", "left").join(F.broadcast(tags), "name", "left")


_CAT_SQL = (CONTRACT_CTE + ", par AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {_list_sql(p)})" for a, p in PARENTS.items())
            + ") AS t(name, parents)), tg AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {_list_sql(['silver', a.split('_')[0]])})" for a in ARTIFACTS)
            + ") AS t(name, tags)), catalog AS (SELECT c.artifact AS name, 'silver' AS layer, c.n_rows AS row_count, c.source, c.confidence, p.parents, tg.tags "
            "FROM contract_scores c LEFT JOIN par p ON p.name = c.artifact LEFT JOIN tg ON tg.name = c.artifact)")


@query("catalog_build", with_silver(_CAT_SQL + "\nSELECT * FROM catalog"))
def catalog_build(spark, sf):
    """D26 + J18: catalog entries (name, layer, counts, source, confidence,
    parents, tags) enriched from the contracts by artifact name."""
    return catalog_df(spark, sf)


SEARCH = "rent"


@query("catalog_search", with_silver(_CAT_SQL + f"\nSELECT name, layer FROM catalog WHERE contains(lower(name), '{SEARCH}') OR contains(lower(array_to_string(tags, '\x01')), '{SEARCH}') OR contains(lower(source), '{SEARCH}')"))
def catalog_search(spark, sf):
    """Substring search over name, tags and source (optional layer)."""
    c = catalog_df(spark, sf)
    hit = (F.lower("name").contains(SEARCH) | F.coalesce(F.exists("tags", lambda t: F.lower(t).contains(SEARCH)), F.lit(False))
           | F.lower("source").contains(SEARCH))
    return c.filter(hit).select("name", "layer")


@query("lineage", with_silver(_CAT_SQL + """
SELECT 'upstream' AS direction, c.name AS artifact, p AS related FROM catalog c, unnest(c.parents) AS t(p)
UNION ALL
SELECT 'downstream', p, c.name FROM catalog c, unnest(c.parents) AS t(p)"""))
def lineage(spark, sf):
    """upstream/downstream lineage from the exploded parent lists."""
    c = catalog_df(spark, sf).select("name", F.explode("parents").alias("p"))
    up = c.select(F.lit("upstream").alias("direction"), F.col("name").alias("artifact"), F.col("p").alias("related"))
    down = c.select(F.lit("downstream").alias("direction"), F.col("p").alias("artifact"), F.col("name").alias("related"))
    return up.unionByName(down)
