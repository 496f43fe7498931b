"""Sources: strict and lenient JSON lines, JSON envelopes, Parquet shards, paged rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import ALIASES, compact_json, resolve_alias, stripped
from ..operators.cache import content_digest
from ..operators.digests import sequence_digest
from ..operators.quality import DataQualityError, conflicts, duplicates, require, require_columns
from . import files


def in_file_order(df: DataFrame, out: str) -> DataFrame:
    """Adds ``out``, each row's place from 0 in files by name and in a file by its own order. ``df`` is a scan with its
    files' ``_path`` and ``_block`` (the split's first byte), filtered at most.

    Spark packs large splits first, so rows are counted by split and splits are put in order: a row a file split
    is all that is ranked. A split that comes otherwise in a second reading is an error, not another number.
    """
    t = df.withColumn("_id", F.monotonically_increasing_id())
    per = t.groupBy("_path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_path", "_block")) - F.col("_n")
    starts = per.select(F.col("_path").alias("_p"), F.col("_block").alias("_b"), "_first", before.alias("_before"))
    if starts.limit(SPLITS + 1).count() <= SPLITS:
        starts = F.broadcast(starts)
    at = F.coalesce(F.col("_before"), F.raise_error(F.lit("the files' splits changed between two readings"))) + F.col("_id") - F.col("_first")
    return t.join(starts, (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")), "left").withColumn(out, at).drop("_id", "_p", "_b", "_first", "_before")


#: File splits whose counts are broadcast at most.
SPLITS = 100_000


def _scan(df: DataFrame, *columns) -> DataFrame:
    return df.select(*columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))


def _text(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark.read.text(path), F.col("value").alias("raw"))


def _blank():
    return F.col("raw").rlike(r"^\s*$")


def _parsed(rows: DataFrame) -> DataFrame:
    got = rows.drop("_path", "_block").withColumn("v", F.try_parse_json("raw"))
    return got.withColumn("is_object", F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False)))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw, v, is_object) of the non-blank lines of JSONL files; ``v`` is null for malformed JSON.

    Lines end at CR or LF only. The ordinal is physical, counted before blanks go; a folder's files follow each
    other by name. A line that repeats a key inside one object counts as malformed.
    """
    rows = in_file_order(_text(spark, path), "line_no").withColumn("line_no", F.col("line_no") + 1)
    return _parsed(rows.where(~_blank()))


def exact(v: str, field: str, kind: str) -> Column:
    """The field if it has exactly this JSON type (STRING or BOOLEAN), else null; 1 is no boolean."""
    it = f"try_variant_get({v}, '$.{field}', 'variant')"
    return F.expr(f"CASE WHEN schema_of_variant({it}) = '{kind}' THEN try_variant_get({v}, '$.{field}', '{'string' if kind == 'STRING' else 'boolean'}') END")


def strict_objects(spark: SparkSession, path: str) -> DataFrame:
    rows = json_lines(spark, path)
    require(rows.where(~F.col("is_object")).select("line_no"), "lines that are no JSON objects")
    return rows


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """(_pos, id, model_id, problem): typed, non-empty and unique, or an error."""
    c = strict_objects(spark, path).select(F.col("line_no").alias("_pos"), *[exact("v", f, "STRING").alias(f) for f in ("id", "model_id", "problem")])
    require(c.where(F.coalesce(F.length("id") == 0, F.lit(True)) | F.coalesce(F.length("model_id") == 0, F.lit(True)) | F.coalesce(F.length("problem") == 0, F.lit(True))).select("_pos"), "cases with a missing or empty field")
    require(duplicates(c, "id"), "repeated case ids")
    if c.isEmpty():
        raise DataQualityError("no cases")
    return c


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = strict_objects(spark, path).select(F.col("line_no").alias("_pos"), exact("v", "id", "STRING").alias("id"), exact("v", "is_robust", "BOOLEAN").alias("is_robust"))
    require(rows.where(F.col("id").isNull() | (F.col("id") == "") | F.col("is_robust").isNull()).select("_pos"), "labels without id or boolean")
    require(duplicates(rows, "id"), "repeated label ids")
    if rows.isEmpty():
        raise DataQualityError("no labels")
    return rows


def load_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(predictions (_pos, id, is_robust, valid), malformed lines); a missing file has none of either.

    ``is_robust`` and ``valid`` are null unless they are exact booleans: such a prediction covers nothing.
    """
    if not files.exists(spark, path):
        return spark.createDataFrame([], "_pos long, id string, is_robust boolean, valid boolean"), 0
    rows = json_lines(spark, path).select(F.col("line_no").alias("_pos"), "is_object", exact("v", "id", "STRING").alias("id"), exact("v", "is_robust", "BOOLEAN").alias("is_robust"), exact("v", "valid", "BOOLEAN").alias("valid"))
    fine = F.col("is_object") & F.coalesce(F.length("id") > 0, F.lit(False))
    bad = rows.where(~fine).count()
    return rows.where(fine).drop("is_object"), bad


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, a JSON array or envelope, or JSON lines, by suffix."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    if path.endswith(".json"):
        return unwrap(spark.read.option("multiLine", True).json(path))
    raise DataQualityError(f"unknown kind of file: {path}")


def study_records(spark: SparkSession, path: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """(_pos, v): a file's rows as variants, numbered from 0 in their order without blank lines. A JSON array is one
    value, so its size is bounded by a variant's; larger tables come as lines or Parquet.

    A Parquet file has all its columns as keys of every row, of which ``keep`` are read (a study's, if it isn't given); rows of JSON lines and of a JSON array have the keys that they have.
    """
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        keep = [c for c in df.columns if c in (keep or STUDY_KEYS)]
        v = F.to_variant_object(F.struct(*[F.col(c) for c in keep])) if keep else F.try_parse_json(F.lit("{}"))
        return in_file_order(_scan(df, v.alias("v")), "_pos").select("_pos", "v")
    if path.endswith(".jsonl"):
        rows = _parsed(in_file_order(_text(spark, path).where(~_blank()), "_pos"))
        require(rows.where(~F.col("is_object")).select("_pos"), "lines that are no JSON objects")
        return rows.select("_pos", "v")
    if path.endswith(".json"):
        whole = in_file_order(_scan(spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(path), "v"), "_file")
        if not whole.where(F.expr("try_variant_get(v, '$.rows', 'variant')").isNotNull()).isEmpty():
            unwrap(spark.read.option("multiLine", True).json(path))  # an envelope's checks
        rows = F.expr("coalesce(transform(try_variant_get(v, '$.rows', 'array<variant>'), e -> try_variant_get(e, '$.row', 'variant')), try_variant_get(v, '$', 'array<variant>'))")
        require(whole.where(rows.isNull()).select("_file"), "files that are no lists of records")
        got = whole.select("_file", F.posexplode(rows).alias("_at", "v"))  # a file's list is one value
        require(got.where(~F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))).select("_at"), "rows that are no JSON objects")
        return got.select((F.col("_file") * (1 << 32) + F.col("_at")).alias("_pos"), "v")
    raise DataQualityError(f"unknown kind of file: {path}")


def read_study(spark: SparkSession, path: str, model: str | None = None, mixed: bool = False) -> DataFrame:
    """Rows of any kind of file as study rows: typed, with unique ids, no text with two families or labels, and one model.

    If ``mixed``, texts with two labels stay, and each row keeps its own.
    """
    r = _keyed(study_records(spark, path))
    wrong = F.coalesce(stripped(F.col("problem")) == "", F.lit(True)) | F.col("is_robust").isNull() | F.coalesce(F.col("family_id") == "", F.lit(True))
    require(r.where(wrong).select("_pos"), "rows without problem string, boolean label or family")
    require(r.where(F.col("id").isNull()).select("_pos"), "ids that are no strings")
    r = r.drop("_pos")
    require(duplicates(r, "id"), "repeated ids")
    if mixed:
        require(conflicts(r, ["problem"], ["family_id"]), "texts with two families")
    else:
        require(conflicts(r, ["problem"], ["family_id", "is_robust"]), "texts with two families or labels")
    models = r.where(F.col("model_id") != "").select("model_id").distinct().limit(3).collect()
    wanted = {ALIASES.get(m, m) for m in [model, *[x["model_id"] for x in models]] if m}
    if len(wanted) > 1:
        raise DataQualityError(f"several models: {sorted(wanted)}")
    if r.isEmpty():
        raise DataQualityError("no rows")
    return r


def unwrap(df: DataFrame) -> DataFrame:
    """Rows of a ``{"rows":[{"row":{...}}]}`` envelope, checked; other tables as they are. Partial envelopes are refused."""
    if "rows" not in df.columns:
        return df
    kind = df.schema["rows"].dataType.simpleString()
    if not kind.startswith("array<struct<") or "row:struct<" not in kind:
        raise DataQualityError(f"rows must be an array of objects with an object row, not {kind}")
    if "partial" in df.columns:
        require(df.where(F.col("partial")).select("partial"), "partial pages")
    require(df.where(F.col("rows").isNull() | F.exists("rows", lambda r: r["row"].isNull())).select(F.size("rows").alias("rows")), "malformed rows")
    return df.select(F.explode("rows").alias("r")).select("r.row.*")


def read_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All rows of page files in the order given, with ``_pos`` from 0: page i starts where those before it end.

    Totals must be whole numbers of at least 0, agree and be met; a page without rows before the last row
    has come is an early end; partial pages are refused.
    """
    order = spark.createDataFrame(list(enumerate(paths)), "page long, path string")
    name = F.regexp_replace("path", r"^file:/*", "/")
    raw = spark.read.option("multiLine", True).json(list(paths)).withColumn("path", F.col("_metadata.file_path"))
    pages = raw.withColumn("path", name).join(F.broadcast(order.withColumn("path", name)), "path")  # a row a page
    require_columns(pages, "rows", "num_rows_total")
    t = pages.select("page", "num_rows_total", F.size("rows").alias("n")).orderBy("page").collect()
    totals = {r["num_rows_total"] for r in t}
    if len(totals) != 1:
        raise DataQualityError("the total changed between pages")
    total = totals.pop()
    if not isinstance(total, int) or total < 0:
        raise DataQualityError("the total is no number of rows")
    start, at = {}, 0
    for r in t:
        if r["n"] <= 0 and at < total:
            raise DataQualityError("pages ended before all rows had come")
        start[r["page"]], at = at, at + max(r["n"], 0)
    if at != total:
        raise DataQualityError(f"{at} rows of {total}")
    unwrap(pages.drop("page", "path"))  # its checks
    starts = spark.createDataFrame(list(start.items()), "page long, _start long")
    rows = pages.join(F.broadcast(starts), "page").select("_start", F.posexplode("rows").alias("_i", "r"))
    return rows.select((F.col("_start") + F.col("_i")).alias("_pos"), "r.row.*")


def split_files(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The union of ``{split}-*.parquet`` of a folder, with the files' place by name in ``_file``."""
    found = [n for n in files.names(spark, folder) if n.startswith(f"{split}-") and n.endswith(".parquet")]
    if not found:
        raise DataQualityError(f"no files of split {split}")
    df = spark.read.parquet(*[f"{folder}/{n}" for n in found])
    place = spark.createDataFrame(list(enumerate(found)), "_file long, _name string")
    top = F.regexp_extract(F.col("_metadata.file_path"), rf"/({split}-[^/]*\.parquet)(?:/|$)", 1)
    return df.withColumn("_name", top).join(F.broadcast(place), "_name").drop("_name")


def verified(read: Callable[[], DataFrame], *columns: str, order: list[str] | None = None, revision: Callable[[], str] | None = None, pinned: str | None = None) -> DataFrame:
    """A source read twice: the digests of both reads must agree, that of their order too if ``order`` is given.

    ``revision`` tells the source's revision: a non-empty string, the same before and after, and ``pinned`` if that is given.
    """

    def at() -> str | None:
        got = revision() if revision else None
        if revision and not (isinstance(got, str) and got):
            raise DataQualityError("the source tells no revision")
        if pinned is not None and got != pinned:
            raise DataQualityError(f"the source is at revision {got}, not {pinned}")
        return got

    before, first, again = at(), read(), read()
    digest = (lambda df: sequence_digest(df, order, list(columns or df.columns))) if order else (lambda df: content_digest(df, *(columns or df.columns)))
    one, two = (digest(df).first() for df in (first, again))
    if one != two or at() != before:
        raise DataQualityError("the source changed between two reads")
    return again


def first_source(*readers) -> DataFrame:
    """The first source that can be read."""
    errors = []
    for r in readers:
        try:
            return r()
        except Exception as e:  # noqa: BLE001 kept and raised if none is left
            errors.append(e)
    raise DataQualityError(f"no source can be read: {errors}")


#: The keys of a study's rows.
STUDY_KEYS = "id family_id dataset_id problem_id original_problem problem model_is_robust is_robust model_id".split()


def _at(key: str) -> Column:
    """The key's value as a variant: a null variant for JSON null, null where the row lacks the key."""
    return F.expr(f"try_variant_get(v, '$.{key}', 'variant')")


def _as_text(key: str) -> Column:
    """A scalar as text (true as ``True``); null for null, missing keys, objects and lists."""
    kind, text = F.schema_of_variant(_at(key)), F.expr(f"try_variant_get(v, '$.{key}', 'string')")
    return F.when(kind == "BOOLEAN", F.initcap(text)).when(~kind.rlike("^(OBJECT|ARRAY|VOID)"), text)


def _keyed(rows: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(_pos, id, family_id, problem, is_robust, model_id) of ``rows(_pos, v)``; each row takes its own keys.

    ``original_problem`` and ``model_is_robust`` go before ``problem`` and ``is_robust`` wherever a row has them, null or
    not. A family that is missing or null is the compact JSON of dataset and problem, if the row has both. An id that
    is missing, null, false, 0 or empty is the SHA-256 of the compact JSON ``[family,problem,place]``. Null
    are: problems and families that are no strings, labels that are no booleans, and ids that are something else.
    """
    string = lambda key: exact("v", key, "STRING")
    problem = F.when(_at("original_problem").isNotNull(), string("original_problem")).otherwise(string("problem"))
    label = F.when(_at("model_is_robust").isNotNull(), exact("v", "model_is_robust", "BOOLEAN")).otherwise(exact("v", "is_robust", "BOOLEAN"))
    without = lambda key: _at(key).isNull() | F.is_variant_null(_at(key))
    d, p = _as_text("dataset_id"), _as_text("problem_id")
    derived = F.when(d.isNotNull() & p.isNotNull(), compact_json(d, p))
    family = F.when(without("family_id"), derived).otherwise(string("family_id"))
    falsy = without("id") | F.coalesce(F.expr("try_variant_get(v, '$.id', 'string')").isin("", "false", "0", "0.0"), F.lit(False)) & ~F.coalesce(string("id").isin("false", "0", "0.0"), F.lit(False))
    named = rows.select("_pos", "v", problem.alias("problem"), label.alias("is_robust"), family.alias("family_id"), resolve_alias(string("model_id"), aliases).alias("model_id"))
    place = F.col("_pos").cast("string")
    made = F.sha2(F.concat(F.regexp_replace(compact_json(F.col("family_id"), F.col("problem")), r"\]$", ","), place, F.lit("]")), 256)
    return named.select("_pos", F.when(falsy, made).otherwise(string("id")).alias("id"), "family_id", "problem", "is_robust", "model_id")


def normalise_study_rows(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(id, family_id, problem, is_robust, model_id) of a table with ``_pos``, whose columns are the keys of all its rows; see ``_keyed``."""
    keep = [F.col(c) for c in df.columns if c in STUDY_KEYS]
    return _keyed(df.select(F.col("_pos").cast("long").alias("_pos"), F.to_variant_object(F.struct(*keep)).alias("v")), aliases).drop("_pos")


def parquet_shards(spark: SparkSession, path: str) -> DataFrame:
    """The union of a file or a folder's shards by column name, with ``source_feature_file``; partial shards are left out."""
    df = spark.read.option("mergeSchema", True).option("pathGlobFilter", "*.parquet").parquet(path)
    df = df.withColumn("source_feature_file", F.col("_metadata.file_name"))
    return df.where(~F.endswith("source_feature_file", F.lit(".partial.parquet")))


def directory_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path below the folder, length, sha256) of all files but hidden and compiled ones, by path; none is an error."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.regexp_extract("path", rf"^.*?{re.escape(path.rstrip('/').rpartition('://')[2].lstrip('/'))}/(.*)$", 1)
    df = df.select(below.alias("path"), "length", F.sha2("content", 256).alias("sha256"))
    df = df.where(~F.col("path").rlike(r"(^|/)__pycache__/|\.py[co]$|(^|/)\.[^/]*$"))
    if df.isEmpty():
        raise DataQualityError(f"no files in {path}")
    return df.orderBy("path")


def string_list(x: Column) -> Column:
    """A JSON list of strings, or a plain string as one element; other JSON is null."""
    v = F.try_parse_json(x)
    kind = F.schema_of_variant(v)
    parsed = F.try_variant_get(v, "$", "array<string>")
    return F.when(F.startswith(kind, F.lit("ARRAY<STRING")) & (F.size(parsed) > 0), parsed).when(v.isNull() & (F.length(x) > 0), F.array(x))
