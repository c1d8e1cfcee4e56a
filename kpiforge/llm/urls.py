"""URL filter: host rules, and gradient-boosted trees where no rule fits.

The trees see lexical features only: lengths, depth, digit ratios,
character entropy, parameter counts, and statistics of the host's suffixes
(how frequent a suffix is among all urls, and how often its labelled urls
are blocked, smoothed). They are trained from labelled urls (``label``: 1
block, 0 allow), of which at most ``sample`` distinct ones are used, half
of the room for either label, weighted by the rows they stand for. Hosts
are dealt to ``FOLDS`` folds by hash, and a labelled url's block rates come
from the other folds' labels, so no row sees its own label or its host's.

Urls are never shuffled but for the join with suffix statistics, which are
counted with partial sums, so a suffix that a third of all pages share
only sends counts. Null urls, and such without ``://``, have an empty host
and path, fit no rule and go to the trees. Without labels of both kinds
the verdict is the one kind there is (none: allow). Repeated rows are
judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import label_sample, written

#: (verdict, host, path): fixed values.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
SAMPLE = 20_000
FOLDS = 8
FEATURES = ["f_len", "f_host_len", "f_path_len", "f_labels", "f_depth", "f_digit", "f_host_digit", "f_entropy", "f_host_entropy", "f_params", "f_query_len", "f_fragment", "f_hyphen", "f_https", "f_slash", "f_dot", "f_seen1", "f_block1", "f_seen2", "f_block2"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, url, host, path."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return pages.select(F.col(key), F.coalesce(F.col(url), F.lit("")).alias("url"), F.translate(part(1), _UPPER, _LOWER).alias("host"), part(2).alias("path"))


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (host and path of the longest that fits, else null) and
    its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def _entropy(col: str) -> Column:
    """Bits per character."""
    chars = F.split(F.col(col), "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.length(col)
    return F.when(F.length(col) > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features of the url alone, and its suffixes."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    digits = lambda c: F.regexp_count(c, F.lit("[0-9]")) / F.greatest(F.length(c), F.lit(1))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return urls.withColumns({
        "f_len": F.length(url), "f_host_len": F.length(host), "f_path_len": F.length(path),
        "f_labels": F.size(F.split(host, r"\.")), "f_depth": F.regexp_count(path, F.lit("/[^/]")),
        "f_digit": digits(path), "f_host_digit": digits(host), "f_entropy": _entropy("path"), "f_host_entropy": _entropy("host"),
        "f_params": F.regexp_count(query, F.lit("[^&=]+=")), "f_query_len": F.length(query), "f_fragment": flag(url.contains("#")),
        "f_hyphen": F.regexp_count(url, F.lit("-")), "f_https": flag(url.startswith("https")), "f_slash": flag(path.endswith("/")),
        "f_dot": flag(path.rlike(r"\.[A-Za-z0-9]{1,5}$")),
        "suffix1": F.substring_index(host, ".", -1), "suffix2": F.substring_index(host, ".", -2)})


def suffix_stats(urls: DataFrame, level: int, weight: float = 20.0) -> DataFrame:
    """Of each suffix and fold with urls: log frequency, and the smoothed
    block rate (0.5 without labels) for unlabelled urls (``all``, over every
    label) and labelled ones (``other``, over the other folds' labels)."""
    col, same = f"suffix{level}", Window.partitionBy(f"suffix{level}")
    part = urls.groupBy(col, "fold").agg(F.count("*").alias("n"), F.sum(F.coalesce("label", F.lit(0))).alias("blocked"), F.count("label").alias("labelled"))
    rate = lambda b, n: (b + 0.5 * weight) / (n + weight)
    b, n = F.sum("blocked").over(same), F.sum("labelled").over(same)
    return part.select(col, "fold", F.log2(F.sum("n").over(same) + 1).alias(f"f_seen{level}"), rate(b, n).alias("all"), rate(b - F.col("blocked"), n - F.col("labelled")).alias("other"))


def judge(pages: DataFrame, key: str = "page_id", rules=RULES, sample: int = SAMPLE, trees: int = 20, depth: int = 4, seed: int = 3) -> DataFrame:
    """key, host, path, rule, verdict and score (the trees' probability of
    block) of every url. Urls that a rule fits are the labelled ones."""
    urls = lexical(ruled(parsed(pages, key), rules)).withColumn("label", (F.col("rule_verdict") == "block").cast("int"))
    urls = written(urls.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS))), "url_features")
    for level in (1, 2):
        rate = F.when(F.col("label").isNull(), F.col("all")).otherwise(F.col("other"))
        urls = urls.join(suffix_stats(urls, level), [f"suffix{level}", "fold"]).withColumn(f"f_block{level}", rate).drop("all", "other")
    urls = written(urls, "url_rows")
    labelled = urls.filter("label IS NOT NULL").select("url", *FEATURES, F.col("label").cast("double").alias("label"))
    some = label_sample(labelled, ["url", *FEATURES], "label", sample).coalesce(1)
    kinds = [r["label"] for r in some.select("label").distinct().collect()]
    if len(kinds) == 2:
        vector = VectorAssembler(inputCols=FEATURES, outputCol="__features")
        model = GBTClassifier(featuresCol="__features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2).fit(vector.transform(some))
        urls = model.setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__hat").transform(vector.transform(urls)).withColumn("score", vector_to_array("__p")[1])
    else:
        urls = urls.withColumn("score", F.lit(kinds[0] if kinds else 0.0))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return urls.select(key, "host", "path", "rule", verdict.alias("verdict"), F.round("score", 9).alias("score"))
