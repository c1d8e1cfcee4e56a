"""Sources, payload parsers and sinks (S1–S18, K18) and scalar-function
queries (F1, F5, F6, F13–F15, F17, F19–F23, F29–F31).

Payloads are built from the driver tables (as an ingestor would land
them), written to the shared folder where the operator reads files, and
parsed back with explicit schemas — never inferred.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import num, snake_case, snake_name, surrogate_key
from ..oracle import ladders as SQ
from ..oracle.gold import GOLD_SQL, with_kpis
from ..oracle.silver import N, with_silver
from ..session import scratch_path
from ..sources.tables import bounded_broadcast, nation_dim, region_dim, table
from . import panel
from .features import silver
from .registry import query

INDICATORS = ["gdp", "inflation", "unemployment", "interest"]


def _macro_long(spark, sf) -> DataFrame:
    m = panel.macro_panel(spark, sf)
    return m.unpivot(["year"], INDICATORS, "indicator", "value")


_MACRO_LONG_SQL = with_silver(", ml AS (SELECT year, indicator, value FROM macro_panel UNPIVOT (value FOR indicator IN ("
                              + ", ".join(INDICATORS) + ")))\n")

WRAPPED_SCHEMA = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("source", T.StringType()), T.StructField("date_fetched", T.StringType()),
        T.StructField("record_count", T.LongType()), T.StructField("description", T.StringType())])),
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("year", T.StringType()), T.StructField("value", T.StringType())])))])


@query("read_wrapped_json", _MACRO_LONG_SQL + f"""SELECT indicator, 'driver:lineitem' AS source, year, {N('value', 6)} AS value,
  count(*) OVER (PARTITION BY indicator) AS record_count FROM ml""")
def read_wrapped_json(spark, sf):
    """Land one wrapped JSON document per dataset ({metadata, data[]}),
    read them back with an explicit schema, explode ``data`` and coerce the
    non-text fields to numbers (bad values → NULL)."""
    ml = _macro_long(spark, sf)
    docs = ml.groupBy("indicator").agg(
        F.struct(F.lit("driver:lineitem").alias("source"), F.lit("2024-02-01T00:00:00").alias("date_fetched"),
                 F.count(F.lit(1)).alias("record_count"), F.concat(F.lit("yearly "), F.col("indicator")).alias("description"))
        .alias("metadata"),
        F.collect_list(F.struct(F.col("year").cast("string").alias("year"),
                                F.col("value").cast("string").alias("value"))).alias("data"))
    path = scratch_path(spark, "bronze-wrapped")
    for row_ind in INDICATORS:
        (docs.filter(F.col("indicator") == row_ind).select(F.to_json(F.struct("metadata", "data"), {"pretty": "true"}))
         .write.mode("errorifexists").text(f"{path}/world_bank_{row_ind}.json"))
    return parse_wrapped_json(wrapped_json(spark, path, "world_bank_*.json"))


def wrapped_json(spark, path: str, pattern: str = "*.json") -> DataFrame:
    """Landed wrapped JSON files, indented or not (one document a file),
    with their file names; contract files are skipped."""
    return (spark.read.schema(WRAPPED_SCHEMA).option("multiLine", "true").json(f"{path}/{pattern}")
            .withColumn("file", F.col("_metadata.file_path")).filter(~F.col("file").rlike("contract[^/]*$")))


def parse_wrapped_json(raw: DataFrame) -> DataFrame:
    """One row for each record of ``data``; bad numbers are NULL."""
    rows = raw.select(F.regexp_extract("file", r"world_bank_([a-z]+)\.json", 1).alias("indicator"),
                      F.col("metadata.source").alias("source"), F.col("metadata.record_count").alias("record_count"),
                      F.explode("data").alias("d"))
    return rows.select("indicator", "source", F.col("d.year").try_cast("bigint").alias("year"),
                       num(F.col("d.value").try_cast("double"), 6).alias("value"), "record_count")


SDMX_SCHEMA = "struct<data:struct<dataSets:array<struct<observations:map<string,array<double>>>>>>"


@query("sdmx_rows", with_silver(f"\nSELECT CAST(year AS VARCHAR) || ':' || CAST(month AS VARCHAR) AS series_key, {N('rate', 6)} AS value FROM rate_panel"))
def sdmx_rows(spark, sf):
    """SDMX payload (observations map series key → [value, …]) → rows
    (series key, first value)."""
    r = panel.rate_panel(spark, sf)
    payload = (r.groupBy("year").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(":", F.col("year").cast("string"), F.col("month").cast("string")),
        F.array(F.col("rate"), F.lit(None).cast("double"))))).alias("obs"))
        .select(F.to_json(F.struct(F.struct(F.array(F.struct(F.col("obs").alias("observations"))).alias("dataSets"))
                                   .alias("data"))).alias("payload")))
    p = payload.select(F.from_json("payload", SDMX_SCHEMA).alias("j"))
    ds = p.select(F.explode("j.data.dataSets").alias("ds"))
    obs = ds.select(F.explode("ds.observations").alias("series_key", "v"))
    return obs.select("series_key", num(F.element_at("v", 1), 6).alias("value"))


OBS_SCHEMA = "struct<observations:array<struct<date:string,period:string,value:string,obs_value:string>>>"


@query("obs_rows", with_silver(f"\nSELECT strftime(make_date(year, month, 1), '%Y-%m') AS period, {N('rate', 6)} AS value FROM rate_panel"))
def obs_rows(spark, sf):
    """Observation lists with key aliases date|period, value|obs_value;
    unparsable dates or numbers dropped."""
    r = panel.rate_panel(spark, sf)
    label = F.date_format(F.make_date("year", "month", F.lit(1)), "yyyy-MM")
    odd = (F.col("month") % 2) == 1
    ob = F.to_json(F.struct(label.alias("date"), F.col("rate").cast("string").alias("value")))
    ev = F.to_json(F.struct(label.alias("period"), F.col("rate").cast("string").alias("obs_value")))
    items = r.select("year", F.when(odd, ob).otherwise(ev).alias("item"))
    bad = items.select("year").distinct().select("year", F.lit('{"date": "n/a", "value": "x"}').alias("item"))
    payload = (items.unionByName(bad).groupBy("year")
               .agg(F.concat(F.lit('{"observations": ['), F.concat_ws(", ", F.collect_list("item")), F.lit("]}"))
                    .alias("payload")))
    o = payload.select(F.explode(F.from_json("payload", OBS_SCHEMA)["observations"]).alias("o"))
    o = o.select(F.coalesce("o.date", "o.period").alias("period"),
                 F.coalesce("o.value", "o.obs_value").try_cast("double").alias("value"))
    ok = F.try_to_timestamp(F.col("period"), F.lit("yyyy-MM")).isNotNull() & F.col("value").isNotNull()
    return o.filter(ok).select("period", num("value", 6).alias("value")).orderBy("period")


PAGE_SCHEMA = "array<struct<date:string,value:double>>"


@query("page_rows", _MACRO_LONG_SQL + f"SELECT indicator, year, {N('value', 6)} AS value FROM ml WHERE value IS NOT NULL")
def page_rows(spark, sf):
    """Two-element page payload [page_meta, [rows]] → (year, value),
    NULL values and dates dropped."""
    ml = _macro_long(spark, sf)
    rows = ml.groupBy("indicator").agg(F.to_json(F.collect_list(F.struct(
        F.col("year").cast("string").alias("date"), F.col("value").alias("value")))).alias("rows"),
        F.count(F.lit(1)).alias("n"))
    extra = '{"date": null, "value": 1.0}, {"date": "2099", "value": null}'
    payload = rows.select("indicator", F.concat(F.lit('[{"page": 1, "pages": 1, "total": '), F.col("n").cast("string"),
                                                F.lit("}, "), F.expr(f"concat(substr(rows, 1, length(rows) - 1), ', {extra}]')"),
                                                F.lit("]")).alias("payload"))
    el = payload.select("indicator", F.explode(F.from_json(F.get_json_object("payload", "$[1]"), PAGE_SCHEMA)).alias("r"))
    el = el.filter(F.col("r.date").isNotNull() & F.col("r.value").isNotNull())
    return el.select("indicator", F.col("r.date").try_cast("bigint").alias("year"), num("r.value", 6).alias("value"))


PAGE_SIZE = 100
PAGED_SCHEMA = "struct<data:array<struct<event_id:bigint,value:double>>,results:array<struct<event_id:bigint,value:double>>>"


@query("paged_union", "SELECT event_id, value FROM events")
def paged_union(spark, sf):
    """Paged payloads in three shapes ({data, has_more}, {results,
    pagination}, bare list) concatenated; pages hold 100 records each."""
    ev = table(spark, sf, "events", "event_id", "value")
    pages = ev.groupBy((F.col("event_id") / PAGE_SIZE).cast("bigint").alias("page")).agg(
        F.to_json(F.collect_list(F.struct("event_id", "value"))).alias("items"))
    shape = F.col("page") % 3
    payload = pages.select(F.when(shape == 0, F.concat(F.lit('{"data": '), F.col("items"), F.lit(', "has_more": true}')))
                           .when(shape == 1, F.concat(F.lit('{"results": '), F.col("items"),
                                                      F.lit(', "pagination": {"has_more": false}}')))
                           .otherwise(F.col("items")).alias("payload"))
    obj = F.from_json("payload", PAGED_SCHEMA)
    bare = F.from_json(F.when(F.col("payload").startswith("["), F.col("payload")),
                       "array<struct<event_id:bigint,value:double>>")
    return payload.select(F.explode(F.coalesce(obj["data"], obj["results"], bare)).alias("r")).select("r.*")


# Fallback thresholds — the API candidate needs > 10 rows,
# the CSV candidate needs any row, the historical table always qualifies.
API_MIN_ROWS = 10


@query("fallback_chain", with_silver(f""", cand AS (
  SELECT 'rate' AS dataset, 1 AS priority, 'api' AS source_used, year, {N('avg(rate)', 6)} AS value FROM rate_panel GROUP BY year
  UNION ALL SELECT 'rate', 3, 'historical', year, {N('avg(rate)', 6)} FROM rate_panel GROUP BY year
  UNION ALL SELECT 'gdp', 1, 'api', year, {N('gdp', 6)} FROM macro_panel
  UNION ALL SELECT 'gdp', 2, 'csv', year, {N('gdp', 6)} FROM macro_panel
  UNION ALL SELECT 'gdp', 3, 'historical', year, {N('gdp', 6)} FROM macro_panel
  UNION ALL SELECT 'population', 3, 'historical', year, CAST(population AS DOUBLE) FROM nat_pop),
rows_per AS (SELECT dataset, priority, count(*) AS n FROM cand GROUP BY 1, 2),
api_rate AS (SELECT dataset, priority, count(*) AS n FROM (SELECT 'rate' AS dataset, 1 AS priority FROM rate_panel) GROUP BY 1, 2),
ok AS (SELECT r.dataset, min(r.priority) AS p FROM rows_per r LEFT JOIN api_rate a ON a.dataset = r.dataset AND a.priority = r.priority
       WHERE (r.priority = 1 AND COALESCE(a.n, r.n) > {API_MIN_ROWS}) OR (r.priority = 2 AND r.n > 0) OR r.priority = 3 GROUP BY 1)
SELECT c.dataset, c.source_used, c.year, c.value FROM cand c JOIN ok ON ok.dataset = c.dataset AND ok.p = c.priority"""))
def fallback_chain(spark, sf):
    """Candidates per dataset tagged with a priority; the first
    priority whose row count passes its threshold wins (window count per
    dataset × priority, then min priority) and records which source won."""
    rate = panel.rate_panel(spark, sf)
    macro = panel.macro_panel(spark, sf)
    pop = panel.national_population(panel.order_panel(spark, sf))
    api_rate = rate.groupBy("year").agg(num(F.avg("rate"), 6).alias("value"))
    cands = [
        (api_rate, "rate", 1, "api"),
        (rate.groupBy("year").agg(num(F.avg("rate"), 6).alias("value")), "rate", 3, "historical"),
        (macro.select("year", num("gdp", 6).alias("value")), "gdp", 1, "api"),
        (macro.select("year", num("gdp", 6).alias("value")), "gdp", 2, "csv"),
        (macro.select("year", num("gdp", 6).alias("value")), "gdp", 3, "historical"),
        (pop.select("year", F.col("population").cast("double").alias("value")), "population", 3, "historical"),
    ]
    u = reduce(DataFrame.unionByName, [d.select(F.lit(ds).alias("dataset"), F.lit(p).alias("priority"),
                                                F.lit(s).alias("source_used"), "year", "value") for d, ds, p, s in cands])
    # The API candidate for 'rate' is judged by its raw monthly rows.
    n_api_rate = rate.agg(F.count(F.lit(1)).alias("_n_raw"))
    counts = u.groupBy("dataset", "priority").agg(F.count(F.lit(1)).alias("n"))
    counts = (counts.crossJoin(n_api_rate)
              .withColumn("n", F.when((F.col("dataset") == "rate") & (F.col("priority") == 1), F.col("_n_raw"))
                          .otherwise(F.col("n"))))
    passes = ((F.col("priority") == 1) & (F.col("n") > API_MIN_ROWS)) | ((F.col("priority") == 2) & (F.col("n") > 0)) \
        | (F.col("priority") == 3)
    win = counts.filter(passes).groupBy("dataset").agg(F.min("priority").alias("priority"))
    return u.join(win, ["dataset", "priority"]).select("dataset", "source_used", "year", "value")


@query("wide_to_long", with_silver("\nSELECT region, year, quarter, median_weekly_rent AS value FROM rent_income"))
def wide_to_long(spark, sf):
    """A wide literal-style table (one column per quarter) back to long
    rows (region, year, quarter, value) — pivot then unpivot."""
    r = silver(spark, sf, "rent_income")
    wide = r.groupBy("region", "year").pivot("quarter", [1, 2, 3, 4]).agg(F.first("median_weekly_rent"))
    wide = wide.select("region", "year", *[F.col(str(q)).alias(f"q{q}") for q in range(1, 5)])
    long = wide.unpivot(["region", "year"], [f"q{q}" for q in range(1, 5)], "q", "value")
    return long.filter(F.col("value").isNotNull()).select(
        "region", "year", F.substring("q", 2, 1).cast("bigint").alias("quarter"), "value")


CARD_CAP = 50
_A_RE = r'<a href="([^"]*)">([^<]*)</a>'


@query("html_cards", f"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS url,
  unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS title,
  unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) + 1)) AS card_index FROM pages)
SELECT page_id, card_index, title, url FROM c WHERE title <> '' AND card_index <= {CARD_CAP}""")
def html_cards(spark, sf):
    """S12 (re-aimed to the pages table): link cards {title, url} pulled
    from each page's HTML with ``regexp_extract_all`` + ``arrays_zip``;
    cards with an empty title dropped; at most 50 per page (the cap is the
    feature). Whole pages are scanned, never prefixes."""
    p = table(spark, sf, "pages", "page_id", "html")
    z = p.select("page_id", F.posexplode(F.arrays_zip(
        F.regexp_extract_all("html", F.lit(_A_RE), 1).alias("url"),
        F.regexp_extract_all("html", F.lit(_A_RE), 2).alias("title"))).alias("pos", "c"))
    return (z.filter((F.col("c.title") != "") & (F.col("pos") < CARD_CAP))
            .select("page_id", (F.col("pos") + 1).cast("bigint").alias("card_index"),
                    F.col("c.title").alias("title"), F.col("c.url").alias("url")))


def _contract_sql():
    from .q_quality import CONTRACT_CTE
    return with_silver(CONTRACT_CTE + """
SELECT artifact, (SELECT count(*) FROM affordability) AS row_count_file, n_rows AS row_count_contract, source, confidence, quality
FROM contract_scores WHERE artifact = 'affordability'""")


@query("write_contract", _contract_sql())
def write_contract(spark, sf):
    """Write a feature table with a sidecar contract (JSON), then
    load both; the contract is optional on read (left join)."""
    from .q_quality import contract_scores_df
    base = scratch_path(spark, "silver-with-contract")
    silver(spark, sf, "affordability").write.parquet(f"{base}/affordability.parquet")
    (contract_scores_df(spark, sf).filter(F.col("artifact") == "affordability")
     .write.json(f"{base}/affordability.contract.json"))
    data = spark.read.parquet(f"{base}/affordability.parquet")
    contract = spark.read.schema("artifact string, source string, confidence double, quality string, n_rows long") \
        .json(f"{base}/affordability.contract.json")
    counted = data.agg(F.count(F.lit(1)).alias("row_count_file")).withColumn("artifact", F.lit("affordability"))
    return counted.join(contract, "artifact", "left").select(
        "artifact", "row_count_file", F.col("n_rows").alias("row_count_contract"), "source", "confidence", "quality")


@query("materialize_parquet", GOLD_SQL["gold_housing"])
def materialize_parquet(spark, sf):
    """External Parquet materialisation of a model, read back."""
    from .gold import housing
    path = scratch_path(spark, "gold-housing")
    housing(spark, sf).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


# Naming generations of dashboard files (first existing wins).
GENERATIONS = ["kpis_{d}.parquet", "kpis-{d}_complete.parquet", "gold_{d}.parquet"]
LANDED = {"executive": 1, "housing": 2, "tourism": 1, "macro": 2, "affordability": 2, "forecast": 1}


@query("candidate_files", with_kpis("\nSELECT k.dashboard, g.generation, count(*) AS n_rows FROM kpis k JOIN (VALUES "
                                    + ", ".join(f"('{d}', {g})" for d, g in LANDED.items())
                                    + ") AS g(dashboard, generation) ON g.dashboard = k.dashboard GROUP BY 1, 2"))
def candidate_files(spark, sf):
    """Candidate file names per dashboard in three naming generations;
    the first that exists wins (existence checked on the file system, the
    reads are ordinary Parquet scans)."""
    from .q_display import kpis
    base = scratch_path(spark, "dashboards")
    k = kpis(spark, sf)
    for d, g in LANDED.items():
        k.filter(F.col("dashboard") == d).write.parquet(f"{base}/{GENERATIONS[g].format(d=d)}")
    parts = []
    for d in LANDED:
        for gi, pattern in enumerate(GENERATIONS):
            try:   # first existing candidate wins; a missing path fails at analysis
                found = spark.read.parquet(f"{base}/{pattern.format(d=d)}")
            except AnalysisException:
                continue
            parts.append(found.select("dashboard", F.lit(gi).alias("generation")))
            break
    u = reduce(DataFrame.unionByName, parts)
    return u.groupBy("dashboard", "generation").agg(F.count(F.lit(1)).alias("n_rows"))


@query("json_sink", with_kpis(", kp0 AS (SELECT *, CAST(" + SQ.confidence() + " AS DOUBLE) AS confidence FROM kpis)\n"
                              """SELECT 'kpi.' || metric AS name, v AS value, 'gauge' AS type, kpi_name AS tag_kpi, dashboard AS tag_dashboard
FROM kp0 UNPIVOT (v FOR metric IN (kpi_value AS 'value', confidence AS 'confidence'))"""))
def json_sink(spark, sf):
    """Metric points exported as JSON lines and read back."""
    from .q_quality import kpi_to_metrics
    path = scratch_path(spark, "metrics-json")
    kpi_to_metrics(spark, sf).write.json(path)
    return spark.read.schema("name string, value double, type string, tag_kpi string, tag_dashboard string").json(path)


@query("scan_projection", with_silver(", names AS (SELECT 'affordability' AS stem, count(*) AS n FROM affordability UNION ALL "
                                      "SELECT 'interest_rate', count(*) FROM interest_rate UNION ALL SELECT 'supply_deficit', count(*) FROM supply)\n"
                                      "SELECT stem, n AS n_rows FROM names"))
def scan_projection(spark, sf):
    """Read every feature file in a folder by glob, skipping stems that
    contain "fixed" and empty files (``_metadata.file_path``)."""
    base = scratch_path(spark, "silver-folder")
    for n in ["affordability", "interest_rate", "supply_deficit"]:
        silver(spark, sf, n).select("year", "region").write.parquet(f"{base}/{n}.parquet")
    silver(spark, sf, "affordability").select("year", "region").write.parquet(f"{base}/affordability_fixed.parquet")
    silver(spark, sf, "affordability").select("year", "region").limit(0).write.parquet(f"{base}/empty_table.parquet")
    df = spark.read.parquet(f"{base}/*.parquet").withColumn(
        "stem", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.parquet/", 1))
    df = df.filter(~F.col("stem").contains("fixed"))
    return df.groupBy("stem").agg(F.count(F.lit(1)).alias("n_rows"))


@query("staging_projection", "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total_price, "
                             "strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders")
def staging_projection(spark, sf):
    """S3: explicit staging projection (only these columns reach the scan)."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                    F.col("o_totalprice").alias("total_price"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))


SEED_SCHEMA = "region_code string, region string, parent string, nation_key int"


@query("seed_csv", "SELECT substr(upper(n_name), 1, 10) AS region_code, n_name AS region, r_name AS parent, n_nationkey AS nation_key, "
                   "count(c_custkey) AS n_customers FROM nation JOIN region ON n_regionkey = r_regionkey "
                   "LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def seed_csv(spark, sf):
    """A CSV seed (the region dimension, landed from the tables) read
    back with declared types and used as a checked broadcast dimension."""
    n, r = nation_dim(spark, sf), region_dim(spark, sf)
    seed = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.substring(F.upper("n_name"), 1, 10).alias("region_code"), F.col("n_name").alias("region"),
        F.col("r_name").alias("parent"), F.col("n_nationkey").alias("nation_key"))
    path = scratch_path(spark, "seed-regions")
    seed.write.option("header", True).csv(path)
    dim = bounded_broadcast(spark.read.schema(SEED_SCHEMA).option("header", True).csv(path))
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    counts = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"))
    j = dim.join(counts, dim.nation_key == counts.c_nationkey, "left")
    return j.select("region_code", "region", "parent", F.col("nation_key").cast("bigint").alias("nation_key"),
                    F.coalesce("n_customers", F.lit(0)).alias("n_customers"))


MESSY = {"event_id": "Event ID", "ts": " Time-Stamp ", "user_id": "User.Id", "event_type": "Event Type!",
         "value": "Value ($)"}


@query("clean_chain", """SELECT DISTINCT event_id, strftime(ts, '%Y-%m-%d') AS time_stamp, user_id, event_type,
  TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value FROM events""")
def clean_chain(spark, sf):
    """snake_case column names → date normalisation → dedup →
    numeric coercion (bad numbers → NULL)."""
    ev = table(spark, sf, "events", *MESSY).select(*[F.col(k).alias(v) for k, v in MESSY.items()])
    df = ev.toDF(*[snake_name(c) for c in ev.columns])
    df = df.withColumn("time_stamp", F.date_format(F.try_to_timestamp(F.col("time_stamp").cast("string")), "yyyy-MM-dd"))
    df = df.dropDuplicates()
    return df.withColumn("value", F.col("value").cast("string").try_cast("double"))


# ------------------------------------------------------------------ scalar function queries
@query("scalar_math", f"""SELECT p_partkey, {N('p_retailprice', 0)} AS r0, {N('p_retailprice', 1)} AS r1, {N('p_retailprice', 2)} AS r2,
  {N('abs(p_retailprice - 1500)', 4)} AS abs_gap, CAST(sign(p_retailprice - 1500) AS DOUBLE) AS sign_gap,
  {N('sqrt(p_retailprice)', 6)} AS sqrt_price, {N('pow(p_size, 2)', 0)} AS size_sq,
  CASE WHEN p_size = 25 THEN -1.0 ELSE {N('p_retailprice / (p_size - 25)', 4)} END AS finite_or_default,
  {N('GREATEST(900, LEAST(1800, p_retailprice))', 2)} AS clamped FROM part""")
def scalar_math(spark, sf):
    """rounding, abs, sign, sqrt, pow, finite guard, clamp."""
    from ..functions.scalar import clamp, finite_or, safe_div
    p = table(spark, sf, "part", "p_partkey", "p_retailprice", "p_size")
    return p.select("p_partkey", num("p_retailprice", 0).alias("r0"), num("p_retailprice", 1).alias("r1"),
                    num("p_retailprice", 2).alias("r2"), num(F.abs(F.col("p_retailprice") - 1500), 4).alias("abs_gap"),
                    F.signum(F.col("p_retailprice") - 1500).alias("sign_gap"),
                    num(F.sqrt("p_retailprice"), 6).alias("sqrt_price"), num(F.pow("p_size", 2), 0).alias("size_sq"),
                    finite_or(num(safe_div(F.col("p_retailprice"), F.col("p_size") - 25), 4), -1.0).alias("finite_or_default"),
                    num(clamp("p_retailprice", 900, 1800), 2).alias("clamped"))


@query("scalar_string", """SELECT p_partkey,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_type || ' ' || p_brand)), '[\\s\\-.]', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS type_key,
  regexp_matches(p_name, '(?i)ring|widget') AS is_hardware,
  CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'series-1' WHEN contains(p_name, 'blue') THEN 'blue' ELSE 'other' END AS klass,
  CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 8) || '...' ELSE p_name END AS short_name,
  regexp_matches(p_brand, '^Brand#[0-9]+$') AS brand_ok,
  md5(concat_ws('|', COALESCE(CAST(p_partkey AS VARCHAR), ''), COALESCE(p_brand, ''))) AS part_sk FROM part""")
def scalar_string(spark, sf):
    """snake_case normaliser, case-insensitive any-of
    regex, prefix/substring class ladder, truncation, regex check, md5
    surrogate key."""
    from ..functions.ladders import truncate_title
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return p.select("p_partkey", snake_case(F.concat_ws(" ", "p_type", "p_brand")).alias("type_key"),
                    F.col("p_name").rlike("(?i)ring|widget").alias("is_hardware"),
                    F.when(F.col("p_brand").startswith("Brand#1"), "series-1")
                    .when(F.col("p_name").contains("blue"), "blue").otherwise("other").alias("klass"),
                    truncate_title("p_name", 8).alias("short_name"),
                    F.col("p_brand").rlike("^Brand#[0-9]+$").alias("brand_ok"),
                    surrogate_key("p_partkey", "p_brand").alias("part_sk"))


DATE_AS_OF = "2001-12-31"


@query("scalar_date", f"""SELECT o_orderkey, year(o_orderdate) AS year, CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter_label,
  strftime(o_orderdate, '%Y-%m') AS month_text,
  strftime(CAST(strptime(strftime(o_orderdate, '%Y-%m'), '%Y-%m') AS DATE), '%Y-%m-%d') AS month_start,
  date_diff('day', CAST(o_orderdate AS DATE), DATE '{DATE_AS_OF}') AS age_days,
  strftime(make_date(year(o_orderdate), 12, 31), '%Y-%m-%d') AS year_end,
  TRY_STRPTIME(CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR), '%Y-%m') IS NULL AS quarter_text_unparsed
FROM orders""")
def scalar_date(spark, sf):
    """Year, quarter label, yyyy-MM parse (quarter text does not
    parse), date formatting, age in days vs an explicit as-of, year end."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    qlabel = F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    mtext = F.date_format("o_orderdate", "yyyy-MM")
    return o.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"), qlabel.alias("quarter_label"),
                    mtext.alias("month_text"),
                    F.date_format(F.try_to_timestamp(mtext, F.lit("yyyy-MM")), "yyyy-MM-dd").alias("month_start"),
                    F.datediff(F.to_date(F.lit(DATE_AS_OF)), F.to_date("o_orderdate")).cast("bigint").alias("age_days"),
                    F.date_format(F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)), "yyyy-MM-dd").alias("year_end"),
                    F.try_to_timestamp(qlabel, F.lit("yyyy-MM")).isNull().alias("quarter_text_unparsed"))


@query("nested_values", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  [CAST(json_extract_string(props, '$.k') AS BIGINT)] AS k_list,
  json_array_length(CASE WHEN starts_with(props, '[') THEN props ELSE '[' || props || ']' END) AS n_objects,
  map_from_entries([('type', event_type), ('user', CAST(user_id AS VARCHAR))])['type'] AS tag_type FROM events""")
def nested_values(spark, sf):
    """nested JSON access, single object wrapped to a list, arrays,
    structs and a map built from entries."""
    ev = table(spark, sf, "events", "event_id", "props", "event_type", "user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    wrapped = F.when(F.col("props").startswith("["), F.col("props")).otherwise(F.concat(F.lit("["), F.col("props"), F.lit("]")))
    tags = F.map_from_entries(F.array(F.struct(F.lit("type").alias("k"), F.col("event_type").alias("v")),
                                      F.struct(F.lit("user").alias("k"), F.col("user_id").cast("string").alias("v"))))
    return ev.select("event_id", k.alias("k"), F.array(k).alias("k_list"),
                     F.json_array_length(wrapped).cast("bigint").alias("n_objects"), tags["type"].alias("tag_type"))


@query("try_numeric", """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority_num,
  TRY_CAST(o_orderpriority AS DOUBLE) AS whole_text_num FROM orders""")
def try_numeric(spark, sf):
    """numeric coercion with errors → NULL (``try_cast``)."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderpriority")
    return o.select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("bigint").alias("priority_num"),
                    F.col("o_orderpriority").try_cast("double").alias("whole_text_num"))





# File-name prefix → source label (first match wins).
SOURCE_PREFIXES = [("world_bank", "World Bank"), ("rbnz", "RBNZ"), ("stats_nz", "Stats NZ"), ("mbie", "MBIE")]


@query("files_by_source")
def files_by_source(spark, sf):
    """Land bronze datasets under source-prefixed names, then count
    datasets and files per source prefix and per layer from the file
    listing (``_metadata.file_path``), classified by a prefix ladder."""
    base = scratch_path(spark, "layers")
    m = panel.macro_panel(spark, sf)
    for ind in INDICATORS:
        m.select("year", ind).write.json(f"{base}/bronze/world_bank_{ind}.json")
    panel.rate_panel(spark, sf).write.json(f"{base}/bronze/rbnz_ocr.json")
    panel.order_panel(spark, sf).select("region", "year", "population").write.json(f"{base}/bronze/stats_nz_population.json")
    panel.tourism_panel(spark, sf).write.json(f"{base}/bronze/mbie_expenditure.json")
    silver(spark, sf, "affordability").write.parquet(f"{base}/silver/affordability.parquet")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
             .select(F.col("path")))
    name = F.regexp_extract("path", r"/([^/]+)/(?:[^/]+)$", 1)
    layer = F.regexp_extract("path", r"/(bronze|silver|gold)/", 1)
    src = F.lit("Other")
    for prefix, label in reversed(SOURCE_PREFIXES):
        src = F.when(name.startswith(prefix), label).otherwise(src)
    f = files.select(layer.alias("layer"), src.alias("source"), name.alias("dataset"))
    return f.groupBy("layer", "source").agg(F.count_distinct("dataset").alias("n_datasets"),
                                            F.count(F.lit(1)).alias("n_files"))


@query("normalize_shapes", with_kpis(""", basic AS (SELECT kpi_name AS c0, kpi_value AS c1, unit AS c2 FROM kpis WHERE dashboard = 'tourism')
SELECT trim(kpi_name) AS name, kpi_value AS value, trim(unit) AS unit, trim(description) AS description, trim(category) AS category,
  trim(source) AS source, 'quality' AS detected_schema FROM kpis WHERE dashboard = 'macro'
UNION ALL
SELECT trim(name), value, trim(unit), trim(description), trim(category), trim(source), 'legacy' FROM (
  SELECT kpi_name AS name, kpi_value AS value, unit, description, category, 'sql-form' AS source FROM kpis WHERE dashboard = 'executive')
UNION ALL
SELECT trim(c0), TRY_CAST(c1 AS DOUBLE), trim(c2), '', 'general', 'Unknown', 'basic' FROM basic"""))
def normalize_shapes(spark, sf):
    """Detect the input shape (quality: kpi_name/kpi_value; legacy:
    name/value; basic: positional) and map each to the canonical KPI shape
    — renames, positional renames, literals for missing fields, trimmed
    text, numeric value by ``try_cast``."""
    from .q_display import kpis
    k = kpis(spark, sf)
    quality = k.filter(F.col("dashboard") == "macro")
    legacy = (k.filter(F.col("dashboard") == "executive")
              .select(F.col("kpi_name").alias("name"), F.col("kpi_value").alias("value"), "unit", "description",
                      "category", F.lit("sql-form").alias("source")))
    basic = k.filter(F.col("dashboard") == "tourism").select("kpi_name", "kpi_value", "unit").toDF("c0", "c1", "c2")
    return reduce(DataFrame.unionByName, [normalize_kpi_frame(d) for d in (quality, legacy, basic)])


def normalize_kpi_frame(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    if {"kpi_name", "kpi_value"} <= cols:
        shape, name, value = "quality", "kpi_name", "kpi_value"
    elif {"name", "value"} <= cols:
        shape, name, value = "legacy", "name", "value"
    else:
        shape = "basic"
        df = df.toDF(*(["name", "value", "unit"] + df.columns[3:])[: len(df.columns)])
        name, value = "name", "value"
    txt = lambda c, d: F.trim(F.col(c)) if c in df.columns else F.lit(d)
    return df.select(F.trim(F.col(name)).alias("name"), F.col(value).cast("string").try_cast("double").alias("value"),
                     txt("unit", "").alias("unit"), txt("description", "").alias("description"),
                     txt("category", "general").alias("category"), txt("source", "Unknown").alias("source"),
                     F.lit(shape).alias("detected_schema"))


CONVERT_COLS = {"orders": ["o_orderpriority", "o_orderstatus"], "events": ["props", "event_type"], "part": ["p_brand"]}


@query("convertible_check", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count_if({c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) AS n_unconvertible, "
    f"count_if({c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) = 0 AS convertible FROM {t}"
    for t, cs in CONVERT_COLS.items() for c in cs))
def convertible_check(spark, sf):
    """Can a text column be converted to a number? Counted as the NULL
    delta of ``try_cast`` over non-NULL values, one aggregate per table."""
    parts = []
    for t, cs in CONVERT_COLS.items():
        df = table(spark, sf, t, *cs)
        bad = lambda c: F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull())
        one = df.agg(*[bad(c).alias(f"_{i}") for i, c in enumerate(cs)])
        parts.append(one.select(F.inline(F.array(*[
            F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_unconvertible"),
                     (F.col(f"_{i}") == 0).alias("convertible")) for i, c in enumerate(cs)]))))
    return reduce(DataFrame.unionByName, parts)
