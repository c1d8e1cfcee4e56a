"""Secret scan with a random forest that removes false positives.

Candidates are runs of 16 or more characters of ``[A-Za-z0-9_+/-]``
(and up to two ``=`` of padding), and of any characters from four on: what
is assigned to a credential word (in quotes, or up to white space), and
the password of a url.
A random forest on their length, character mix and transitions between
character classes, dictionary coverage, path and neighbouring words tells
secrets from long words, numbers and paths. It is trained from labelled
findings (column ``label``: 1 secret, 0 false positive, null unknown).

All of it is DataFrame functions and Spark's own forest; no Python runs in
tasks. Only texts with a candidate are cut into words. The dictionary is
learnt from all words of the corpus: the letter trigrams more frequent
than a uniform share; there are at most 26^3 of them, which is the proven
bound of its broadcast. The forest is fitted on at most ``sample``
distinct labelled findings (the least by hash, so always the same ones),
half of the room for either label, weighted by the rows they stand for.

Null and empty texts have no candidates; without labelled findings of
both kinds the label itself decides (null: no secret); repeated rows are
scanned each; an empty table has no findings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import label_sample, written

SHORTEST = 16
CANDIDATE = "[A-Za-z0-9_+/-]{%d,}={0,2}" % SHORTEST
SPACE = "[\\x20\\x09-\\x0D]+"
#: Words that announce a credential (fixed values).
CREDENTIAL = "token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|credential|bearer"
_HEAD = "(?i)(?:%s)[A-Za-z0-9_.-]*+[\"'`\\])]{0,3}[ \\t]*+(?:=>|:=|={1,3}|:)[ \\t]*+(?:(?:bearer|basic)[ \\t]+)?" % CREDENTIAL
#: (word announced, head, head and value): what is assigned to a credential word; url passwords.
VALUES = [("", _HEAD + "[\"'`]?", _HEAD + "(?:" + "|".join("%s((?:[^%s\\\\\\r\\n]++|\\\\.){1,200}+)%s" % (q, q, q) for q in "\"'`") + "|[\"'`]?([^\\s\"'`]\\S*[^\\s\"'`,;)\\]}>]))"),
          ("password of ", "[A-Za-z]://[^\\s/@:]*:", "[A-Za-z]://[^\\s/@:]*:([^\\s/]+)@")]
FEWEST = 4
#: Paths that hold examples rather than live secrets (fixed values).
EXAMPLE_PATH = "test|example|sample|mock|fixture|doc"
FEATURES = ["f_len", "f_digit", "f_upper", "f_lower", "f_other", "f_change", "f_distinct", "f_hex", "f_cover", "f_key", "f_assign", "f_quote", "f_path"]
SAMPLE = 20_000


def candidates(docs: DataFrame, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """key, row (digest of the text), path, word_no, start, candidate and
    ``around``: the two words before and what stands before the candidate in
    its own word; of an assigned value or url password, the word and
    assignment, or url, before it. ``start``: characters before it."""
    docs = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).alias("text"))
    found = hits(docs, CANDIDATE, F.split("text", SPACE))
    before = [F.coalesce(F.get("more", F.col("word_no") - k), F.lit("")) for k in (2, 1)]
    found = found.select("doc_id", "row", "path", "word_no", "start", F.col("hit").alias("candidate"), F.concat_ws(" ", *before, F.expr("substring_index(get(more, word_no), hit, 1)")).alias("around"))
    for said, head, pattern in VALUES:
        groups = max(1, pattern.count("(") - pattern.count("(?"))
        each = hits(docs, pattern, F.lit(None)).withColumn("around", F.regexp_extract("hit", f"^({head})", 1))
        each = each.withColumn("candidate", F.concat(*[F.regexp_extract("hit", pattern, g + 1) for g in range(groups)]))
        each = each.filter((F.length("candidate") >= FEWEST) & ~F.col("candidate").rlike(f"^{CANDIDATE}$"))
        found = found.unionByName(each.select("doc_id", "row", "path", (F.col("word_no") + spaces(F.col("around"))).cast("int").alias("word_no"), (F.col("start") + F.length("around")).alias("start"),
                                              "candidate", F.concat(F.lit(said), "around").alias("around")))
    return found


def spaces(c: Column) -> Column:
    """Runs of white space."""
    return F.regexp_count(c, F.lit(SPACE))


def hits(docs: DataFrame, pattern: str, more: Column) -> DataFrame:
    """doc_id, row, path, hit, word_no, start and ``more`` (that
    column) of every match of the pattern: a text is what lies between the
    matches and the matches, in turn. A match neither starts nor ends with
    white space, so a word's number is the count of white spaces before it."""
    some = docs.filter(F.col("text").rlike(pattern)).select("doc_id", "row", "path", more.alias("more"), F.regexp_extract_all("text", F.lit(f"({pattern})"), 1).alias("hit"), F.split("text", pattern).alias("gap"))
    step = F.transform("hit", lambda h, i: F.struct((spaces(F.get("gap", i)) + F.when(i > 0, spaces(F.get("hit", i - 1))).otherwise(0)).alias("words"),
                                                    (F.length(F.get("gap", i)) + F.when(i > 0, F.length(F.get("hit", i - 1))).otherwise(0)).alias("chars")))
    some = some.withColumn("step", step)
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("chars"))
    each = some.select("doc_id", "row", "path", "more", F.explode(F.transform("hit", lambda h, i: F.struct(
        h.alias("hit"), F.aggregate(F.slice("step", 1, i + 1), none, lambda a, s: F.struct((a["words"] + s["words"]).alias("words"), (a["chars"] + s["chars"]).alias("chars"))).alias("at")))).alias("x"))
    return each.select("doc_id", "row", "path", "more", "x.hit", F.col("x.at.words").alias("word_no"), F.col("x.at.chars").alias("start"))


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """tri: letter trigrams of the corpus' words above a uniform share."""
    words = docs.select(F.explode(F.split(F.lower(text), "[^a-z]+")).alias("w")).filter(F.length("w") >= 3).groupBy("w").agg(F.count("*").alias("n"))
    tri = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))).alias("tri"), "n")
    tri = written(tri.groupBy("tri").agg(F.sum("n").alias("n")), "secret_trigrams")
    total = tri.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return tri.filter(F.col("n") * 26**3 >= total).select("tri")


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def featured(found: DataFrame, tri: DataFrame) -> DataFrame:
    """Adds FEATURES to candidates."""
    each = found.select("candidate").distinct()
    parts = each.select("candidate", F.explode(F.transform(F.sequence(F.lit(1), F.length("candidate") - 2), lambda i: F.substring(F.lower("candidate"), i, F.lit(3)))).alias("tri"))
    cover = parts.join(F.broadcast(tri.withColumn("known", F.lit(1))), "tri", "left").groupBy("candidate").agg((F.sum(F.coalesce("known", F.lit(0))) / F.count("*")).alias("f_cover"))
    around = F.lower("around")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return found.join(cover, "candidate").withColumns({
        "f_len": F.log2(F.length("candidate")),
        "f_digit": _share("[0-9]"), "f_upper": _share("[A-Z]"), "f_lower": _share("[a-z]"), "f_other": _share("[^0-9A-Za-z]"),
        "f_change": _share("(?<=[a-z])[0-9A-Z]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"),
        "f_distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate"),
        "f_hex": flag(F.col("candidate").rlike("^[0-9a-fA-F]+$") & F.col("candidate").rlike("[a-fA-F]")),
        "f_key": flag(around.rlike(CREDENTIAL)), "f_assign": flag(around.rlike("[=:][\"']?\\s*[\"']?$")),
        "f_quote": flag(F.col("around").rlike("[\"'`]$")), "f_path": flag(F.lower("path").rlike(EXAMPLE_PATH)),
    })


def format_labels(found: DataFrame) -> DataFrame:
    """Labelled findings by format and context, for corpora without a
    reviewer's labels: a mixed candidate that is assigned to a credential
    word is a secret; one of a single character class, or made of
    dictionary parts, without such a word is none, nor is a word of the
    dictionary after a colon and a blank; others stay unknown."""
    prose = (F.col("f_lower") + F.col("f_upper") == 1) & (F.col("f_cover") >= 0.5) & F.col("around").rlike(":[ \\t]+$")
    mixed = (F.col("f_digit") > 0) & (F.col("f_digit") < 1) & (F.col("f_cover") < 0.5)
    return found.withColumn("label", F.when((F.col("f_key") == 1) & (F.col("f_assign") == 1) & mixed, 1)
                            .when((F.col("f_key") == 0) & ((F.col("f_digit") == 0) | (F.col("f_digit") == 1) | (F.col("f_cover") >= 0.5)), 0)
                            .when(prose, 0))


def classify(found: DataFrame, labelled: DataFrame, sample: int = SAMPLE, trees: int = 20, depth: int = 6, seed: int = 11) -> DataFrame:
    """found (with FEATURES) plus ``score``, the forest's share of trees."""
    labelled = labelled.filter("label IS NOT NULL").select(*FEATURES, F.col("label").cast("double").alias("label"))
    some = label_sample(labelled, FEATURES, "label", sample).coalesce(1)
    kinds = {r["label"] for r in some.select("label").distinct().collect()}
    if kinds != {0.0, 1.0}:
        return found.withColumn("score", F.coalesce(F.col("label"), F.lit(0)).cast("double") if "label" in found.columns else F.lit(0.0))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="__features")
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vector.transform(some))
    ranked = forest.setProbabilityCol("__probability").setRawPredictionCol("__raw").setPredictionCol("__prediction").transform(vector.transform(found))
    return ranked.withColumn("score", vector_to_array("__probability")[1]).drop("__features", "__probability", "__raw", "__prediction")


def scan(docs: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row for each candidate: doc_id, row, path, word_no, start,
    candidate, around, label, score, is_secret. ``labelled``: reviewed
    findings with FEATURES and ``label``; by default :func:`format_labels`
    of the findings. Candidates are written once, before their features."""
    found = written(candidates(docs), "secret_candidates")
    found = written(format_labels(featured(found, dictionary(docs))), "secret_findings")
    out = classify(found, found if labelled is None else labelled, sample)
    return out.select("doc_id", "row", "path", "word_no", "start", "candidate", "around", "label", F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of ``found`` cut out of ``text`` where it
    stands (and ``n_chars``, where there is one, set anew for those rows).
    Rows are joined by id and text, so rows that share an id keep their own
    secrets; secrets that overlap leave one mark. Only rows that have a
    candidate at all take part in the join."""
    names = docs.columns
    some = reduce(Column.__or__, [F.col("text").rlike(p) for p in (CANDIDATE, *(x[2] for x in VALUES))])
    some = F.coalesce(some, F.lit(False))
    rest, docs = docs.filter(~some), docs.filter(some)
    marks = found.filter("is_secret").groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(
        F.sort_array(F.collect_set(F.struct(F.col("start").alias("a"), (F.col("start") + F.length("candidate")).alias("b")))).alias("__spans"))
    out = docs.withColumn("__text", F.xxhash64("text"))
    out = out.join(marks, out["doc_id"].eqNullSafe(marks["__id"]) & (out["__text"] == marks["__row"]), "left")
    done = F.aggregate(
        "__spans", F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda x, s: F.struct(F.when(s["a"] >= x["at"], F.concat(x["text"], F.substring(F.col("text"), x["at"] + 1, s["a"] - x["at"]), F.lit(mark))).otherwise(x["text"]).alias("text"),
                              F.greatest(x["at"], s["b"]).alias("at")),
        lambda x: F.concat(x["text"], F.substring(F.col("text"), x["at"] + 1, F.length("text"))))
    clean = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(done)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length(clean)))
    return rest.unionByName(out.withColumn("text", clean).select(*names))
