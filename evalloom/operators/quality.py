"""Declarative data-quality rules: a report, or an error in strict mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataQualityError(ValueError):
    """Raised by strict mode."""


def require(report: DataFrame, what: str) -> None:
    """Raise if a violation query has rows."""
    rows = report.limit(5).collect()
    if rows:
        raise DataQualityError(f"{what}: {[r.asDict() for r in rows]}")


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataQualityError(f"missing columns: {missing}")
    return df


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def conflicts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys with more than one distinct combination of ``values`` (a broken functional dependency)."""
    return df.select(*keys, F.struct(*values).alias("_v")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")


def report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): all rules counted in one pass; a rule is a condition that should never hold."""
    one = df.agg(*[F.coalesce(F.count_if(c), F.lit(0)).cast("long").alias(k) for k, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("r")).select("r.*")


def class_report(df: DataFrame, group: str, label: str, least: int) -> DataFrame:
    """(rule, violations): a class that is absent, and classes with fewer groups than ``least``. A group counts
    for the class of its rows."""
    per = df.groupBy(F.col(label).alias("_y")).agg(F.count_distinct(group).alias("_n")).where("_y is not null")
    one = per.agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("_n") < least).alias("few"))
    rules = F.array(F.struct(F.lit("absent_class").alias("rule"), F.greatest(2 - F.col("k"), F.lit(0)).cast("long").alias("violations")), F.struct(F.lit("few_groups").alias("rule"), F.col("few").alias("violations")))
    return one.select(F.explode(rules).alias("r")).select("r.*")


def require_classes(df: DataFrame, group: str, label: str, least: int = 1) -> DataFrame:
    """Both classes, each with at least ``least`` groups, or an error."""
    require(class_report(df, group, label, least).where("violations > 0"), "classes")
    return df


def null_report(df: DataFrame, *columns: str) -> DataFrame:
    """(rule, violations): nulls of every column, counted in one pass."""
    return report(df, {c: F.col(c).isNull() for c in require_columns(df, *columns).columns if c in columns})


def in_unit(x: Column) -> Column:
    """A finite number of [0, 1]; null where the value is none."""
    v = x.try_cast("double")
    return v.isNotNull() & ~F.isnan(v) & v.between(0, 1)


def single_value(df: DataFrame, column: str) -> bool:
    """Whether the column has one value only; null counts as a value."""
    r = df.agg(F.count_distinct(column).alias("n"), F.max(F.col(column).isNull().cast("int")).alias("z")).first()
    return r["n"] + (r["z"] or 0) == 1


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def set_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(missing, unexpected) counts of keys of ``a`` not in ``b`` and the reverse, by one full outer join."""
    x, y = a.select(F.col(column).alias("_a")).distinct(), b.select(F.col(column).alias("_b")).distinct()
    j = x.join(y, F.col("_a") == F.col("_b"), "full_outer")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("unexpected"))


#: A response has variants v01 to v10 of each family.
VARIANTS = 10


def check_request(docs: DataFrame) -> DataFrame:
    """(problem, n) for request documents ``json`` of the form {"tasks":[{family_id, original_problem}]}."""
    v = docs.select(F.try_parse_json("json").alias("v"))
    task = v.select(F.explode(F.expr("try_variant_get(v, '$.tasks', 'array<variant>')")).alias("t"))
    got = task.select(
        F.expr("schema_of_variant(try_variant_get(t, '$.family_id', 'variant')) = 'STRING'").alias("id_ok"), F.expr("try_variant_get(t, '$.family_id', 'string')").alias("f"),
        F.expr("try_variant_get(t, '$.original_problem', 'string')").alias("p"), F.expr("array_sort(map_keys(try_variant_get(t, '$', 'map<string,variant>')))").alias("keys"),
    )
    rules = {"bad_id": ~F.coalesce("id_ok", F.lit(False)), "blank_problem": F.coalesce(F.trim("p") == "", F.lit(True)), "bad_keys": F.col("keys") != F.array(F.lit("family_id"), F.lit("original_problem"))}
    dup = duplicates(got, "f").agg(F.lit("duplicate_family").alias("rule"), F.count(F.lit(1)).alias("violations"))
    empty = v.agg(F.lit("bad_document").alias("rule"), F.count_if(F.coalesce(F.expr("size(try_variant_get(v, '$.tasks', 'array<variant>'))"), F.lit(0)) == 0).alias("violations"))
    return report(got, rules).unionByName(dup).unionByName(empty)


def check_response(variants: DataFrame, request: DataFrame) -> DataFrame:
    """(rule, violations) for ``variants(family_id, variant_id, problem)`` against ``request(family_id, original_problem)``."""
    from ..functions.keys import stripped

    v = variants.withColumn("_p", stripped(F.col("problem")))
    ids = F.array(*[F.lit(f"v{i:02d}") for i in range(1, VARIANTS + 1)])
    per = v.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("variant_id")).alias("ids"), F.count_distinct("_p").alias("texts"), F.count_if(F.coalesce(F.col("_p") == "", F.lit(True))).alias("blank"))
    j = per.join(request.select("family_id", stripped(F.col("original_problem")).alias("_o")).withColumnRenamed("family_id", "_f"), F.col("family_id") == F.col("_f"), "full_outer")
    out = report(j, {
        "wrong_count": F.col("n") != VARIANTS, "wrong_ids": F.col("ids") != ids, "repeated_text": F.col("texts") < F.col("n"), "blank_text": F.col("blank") > 0,
        "missing_family": F.col("family_id").isNull(), "unexpected_family": F.col("_f").isNull(),
    })
    same = v.join(request, "family_id").agg(F.lit("equals_original").alias("rule"), F.count_if(F.col("_p") == stripped(F.col("original_problem"))).alias("violations"))
    return out.unionByName(same)


def forbidden_fields(schema, names: frozenset[str], path: str = "") -> list[str]:
    """Paths of forbidden names anywhere in a nested schema; no data is read."""
    from pyspark.sql import types as T

    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            at = f"{path}.{f.name}".lstrip(".")
            out += ([at] if f.name in names else []) + forbidden_fields(f.dataType, names, at)
        return out
    if isinstance(schema, T.ArrayType):
        return forbidden_fields(schema.elementType, names, path + "[]")
    if isinstance(schema, T.MapType):
        return forbidden_fields(schema.valueType, names, path + "{}")
    return []
