"""Record schemas (D11): declarative rules over landed JSON records.

A record is one JSON object as text. Its fields are read as text by
``from_json``, so a value of the wrong type is a finding, not a null; each
field's rules give at most one error, and a record's errors stand in the
order of its schema's fields.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"


@dataclass(frozen=True)
class Field:
    """kind: int, float, text or date; ``low`` and ``high`` bound a number
    (both included), ``shortest`` a text."""

    name: str
    kind: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    shortest: int = 0

    def error(self, v: Column) -> Column:
        said = lambda what: F.lit(f"{self.name}: {what}")
        found = F.when(v.isNull(), said("required") if self.required else F.lit(None).cast("string"))
        if self.kind in ("int", "float"):
            number = v.try_cast("double")
            found = found.when(number.isNull(), said("not a number"))
            if self.kind == "int":
                found = found.when(number != F.floor(number), said("not a whole number"))
            if self.low is not None:
                found = found.when(number < self.low, said(f"below {self.low}"))
            if self.high is not None:
                found = found.when(number > self.high, said(f"above {self.high}"))
        elif self.kind == "date":
            found = found.when(~v.rlike(ISO_DATE) | F.left(v, F.lit(10)).try_cast("date").isNull(), said("not a date"))
        elif self.shortest:
            found = found.when(F.length(v) < self.shortest, said("too short"))
        return found


_REGION = [Field("region", "text", True, shortest=1), Field("year", "int", True, 1990, 2030)]
# The fields and bounds of the six sources.
SCHEMAS = {
    "world_bank": [Field("year", "int", True, 1960, 2030), Field("value", "float", True), Field("country", "text"), Field("indicator", "text")],
    "rbnz": [Field("date", "date", True), Field("value", "float", True), Field("indicator", "text")],
    "stats_nz": [*_REGION, Field("value", "float"), Field("population", "int"), Field("consents", "int"), Field("median_household_income", "float")],
    "mbie_tourism": [*_REGION, Field("visitors", "int"), Field("tourism_expenditure_nzd_millions", "float"), Field("growth_yoy", "float")],
    "linz": [*_REGION, Field("property_count", "int"), Field("median_price", "float")],
    "reinz": [*_REGION, Field("month", "int", False, 1, 12), Field("sales_count", "int"), Field("median_price", "float"), Field("days_to_sell", "int")],
}


def validate(records: DataFrame, schemas: dict[str, list[Field]] = SCHEMAS) -> DataFrame:
    """records (source, id, payload) plus ``errors`` (ordered) and
    ``is_valid``. Text that is no JSON object has the error ``not an
    object``; a source without a schema has none of its records valid.

    The errors pass through a generator of one row each: a filter on them
    stays behind it, or the optimizer would copy it, with one parse of the
    record for every look at a field, before the one that makes them."""
    fields = F.from_json("payload", "map<string,string>")
    checks = F.lit(None).cast("array<string>")
    for source, rules in schemas.items():
        found = F.array_compact(F.array(*[rule.error(F.col("_fields")[rule.name]) for rule in rules]))
        checks = F.when(F.col("source") == source, found).otherwise(checks)
    errors = (F.when(~F.coalesce(F.col("source").isin(*schemas), F.lit(False)), F.array(F.concat(F.lit("no schema for source "), F.coalesce("source", F.lit("null")))))
              .when(F.col("_fields").isNull(), F.array(F.lit("not an object"))).otherwise(checks))
    found = records.withColumn("_fields", fields).withColumn("_errors", errors)
    return found.select(*records.columns, F.inline_outer(F.array(F.struct(F.col("_errors").alias("errors"))))).withColumn("is_valid", F.size("errors") == 0)


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and rejected ones with their errors."""
    return checked.filter("is_valid").drop("errors", "is_valid"), checked.filter("NOT is_valid").drop("is_valid")


def summary(checked: DataFrame, first: int = 10) -> DataFrame:
    """source, valid, valid_count, invalid_count and the ``first`` error
    messages by record id. Each task keeps its own first few of a source
    before anything is shuffled."""
    counts = checked.groupBy("source").agg(F.count_if("is_valid").alias("valid_count"), F.count_if(~F.col("is_valid")).alias("invalid_count"))
    message = F.concat(F.lit("Record "), F.col("id").cast("string"), F.lit(": "), F.array_join("errors", "; "))
    place = F.row_number().over(Window.partitionBy("source").orderBy("id", "message"))
    few = checked.filter("NOT is_valid").select("source", "id", message.alias("message")).withColumn("_place", place).filter(F.col("_place") <= first)
    listed = few.groupBy(F.col("source").alias("_source")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "message"))), lambda x: x["message"]).alias("errors"))
    out = counts.join(listed, counts["source"].eqNullSafe(listed["_source"]), "left")
    return out.select("source", (F.col("invalid_count") == 0).alias("valid"), "valid_count", "invalid_count", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
