"""Readers of tasks, labelled documents, predictions and run records.

Payloads stay text; envelopes have fixed schemas. Every reader adds ``_errors``,
the reasons why a row is not valid; ``strict`` turns a row that has any into an
error. Files are read by Spark, never by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grids
from ..functions.payload import parsed
from . import files

GRID_TASK = "task_id string, train array<struct<input:array<array<int>>,output:array<array<int>>>>, test array<struct<input:array<array<int>>,output:array<array<int>>>>"
TEXT_TASK = "task_id string, train array<struct<input:string,output:string>>, test array<struct<input:string,output:string>>"
ARM = (
    "rung string, k int, seed int, arm string, device string, dtype string, eval_n int, mean_micro_f1 double, invalid_json int, scored int, no_completion int, "
    "exact_match int, adapt_seconds double, tenant string, schema string, spec string, error string, note string, "
    "results array<struct<index:int,valid_json:boolean,exact_match:boolean,micro_f1:double,prediction:string,error:string>>"
)
CELL = "addendum string, seed int, j int, device string, dtype string, n_test int, kshot_mean_micro_f1 double, adapted_mean_micro_f1 double, per_doc array<struct<index:int,kshot:double,adapted:double,delta:double>>"
#: The classes of a receipt's labels that are kept.
RECEIPT_CLASSES = ("menu", "void_menu", "sub_total", "void_total", "total")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def whole_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """file, stem, text: one row per file."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_name").alias("file"), file_stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), text of every line that isn't blank. Files are
    read split by split: a line's number is its place within its split, which
    tasks count as they read, plus the lines of the splits before it."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path_"), F.col("_metadata.file_block_start").alias("at_"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("id_"))
    # Within one task ids go up by one from line to line, so a split's first id tells the place of each.
    splits = lines.groupBy("path_", "at_").agg(F.min("id_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("path_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("path_", "at_", (F.coalesce(before, F.lit(0)) - F.col("first_") + 1).alias("shift_"))
    numbered = lines.join(starts, ["path_", "at_"]).where(F.trim("text") != "")
    return numbered.select(F.regexp_extract("path_", r"([^/]*)$", 1).alias("file"), (F.col("id_") + F.col("shift_")).cast("int").alias("line_no"), "text")


def with_errors(df: DataFrame, *checks: tuple[str, Column]) -> DataFrame:
    """``df`` with _errors: the names of the conditions that hold (null counts as holding)."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in checks]), lambda x: x.isNotNull())
    return df.withColumn("_errors", found)


def strict(df: DataFrame, what: str) -> DataFrame:
    """``df`` without _errors; reading a row that has any raises, naming them and, where rows have one, the line."""
    line = F.coalesce(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": ")), F.lit("")) if "line_no" in df.columns else F.lit("")
    message = F.concat(F.lit(f"{what}: "), line, F.array_join("_errors", ", "))
    guard = F.when(F.size("_errors") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return df.where(guard).drop("_errors")


def at_least(df: DataFrame, n: int, what: str) -> DataFrame:
    """``df``, or an error if it has fewer than ``n`` rows."""
    if (found := len(df.select(F.lit(1)).take(n))) < n:  # reads from the first tasks on, until there are n
        raise ValueError(f"{what}: {found} rows, at least {n} are needed")
    return df


def duplicated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(key)


def _task(files: DataFrame, schema: str, grid: bool) -> DataFrame:
    t = files.withColumn("t", F.from_json("text", schema, {"mode": "PERMISSIVE"}))
    place = [c for c in ("file", "line_no") if c in files.columns and "line_no" in files.columns]
    rows = t.select(*place, F.coalesce("t.task_id", "stem").alias("task_id"), F.col("t.train").alias("train"), F.col("t.test").alias("test"))
    if grid:
        bad = lambda g: ~grids.valid(g)
    else:
        bad = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    return with_errors(
        rows,
        ("no id", F.trim("task_id") == ""),
        ("no train pairs", F.coalesce(F.size("train") <= 0, F.lit(True))),
        ("no test pairs", F.coalesce(F.size("test") <= 0, F.lit(True))),
        ("bad train input", F.exists("train", lambda p: bad(p["input"]))),
        ("bad train output", F.exists("train", lambda p: bad(p["output"]))),
        ("bad test input", F.exists("test", lambda p: bad(p["input"]))),
        ("bad test output", F.exists("test", lambda p: p["output"].isNotNull() & bad(p["output"]))),
    )


def grid_tasks(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """task_id, train, test, _errors of the grid tasks in a folder or file; the id
    is the file's stem. A folder without tasks is an error."""
    return at_least(_task(whole_files(spark, path, glob), GRID_TASK, True), 1, path)


def text_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The same with text pairs; the id comes from the body, else from the file."""
    return _task(whole_files(spark, path), TEXT_TASK, False)


def text_task_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no and the text task of each line; the id is required and must
    be unique. A file without a line that isn't blank has a row of its own, which says so."""
    lines = numbered_lines(spark, path).withColumn("stem", F.lit(None).cast("string"))
    rows = _task(lines, TEXT_TASK, False)
    names = [(f.rpartition("/")[2],) for f in spark.read.text(path).inputFiles()]  # the driver lists files anyway; scans skip those of no bytes
    every = spark.createDataFrame(names, "file string")
    empty = every.join(lines.select("file").distinct(), "file", "left_anti").withColumn("_errors", F.array(F.lit("empty file")))
    rows = rows.unionByName(empty, allowMissingColumns=True)
    again = duplicated(rows, "task_id").withColumn("again_", F.lit(True))
    joined = rows.join(again, "task_id", "left")
    return joined.withColumn("_errors", F.when(F.col("again_"), F.concat("_errors", F.array(F.lit("duplicate id")))).otherwise(F.col("_errors"))).drop("again_")


def task_map(spark: SparkSession, path: str, solutions: str | None = None) -> DataFrame:
    """task_id, train, test of a file {id: task}; with ``solutions`` ({id: outputs})
    only the answered tasks, their outputs filled in by position."""
    body = GRID_TASK.split(", ", 1)[1]
    fields = body.replace("train ", "train:").replace("test ", "test:")
    in_pieces = lambda p: files.readable(p) and not set(p) & set("*?[{")

    def read(p: str, kind: str) -> DataFrame:
        if in_pieces(p):  # entry by entry; else Spark reads the file whole
            return files.entries(spark, p).select(F.col("key").alias("task_id"), F.from_json("value", kind).alias("t"))
        return spark.read.text(p, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("task_id", "t"))

    tasks = read(path, f"struct<{fields}>").select("task_id", "t.train", "t.test")
    if not solutions:
        return tasks
    answers = read(solutions, "array<array<array<int>>>").withColumnRenamed("t", "answers")
    filled = F.transform("test", lambda p, i: F.struct(p["input"].alias("input"), F.get(F.col("answers"), i).alias("output")))
    return tasks.join(answers, "task_id").withColumn("test", filled).drop("answers")


def pairs(tasks: DataFrame) -> DataFrame:
    """task_id, split, index, input, output: one row per pair."""
    side = lambda name: tasks.select("task_id", F.lit(name).alias("split"), F.posexplode(name).alias("index", "p")).select("task_id", "split", "index", "p.input", "p.output")
    return side("train").union(side("test"))


def receipts(rows: DataFrame) -> DataFrame:
    """``rows`` (gt_parse, valid_line) with text, gold and _errors: words as lines,
    labels as JSON of the kept classes with sorted keys."""
    words = F.transform("valid_line", lambda x: F.trim(F.array_join(F.transform(x["words"], lambda w: w["text"]), " ")))
    kept = F.map_filter(F.from_json("gt_parse", "map<string,string>"), lambda k, v: k.isin(*RECEIPT_CLASSES))
    body = F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), kept[k]))
    out = rows.withColumn("text", F.array_join(F.filter(words, lambda x: x != ""), "\n")).withColumn("gold", F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}")))
    return with_errors(out, ("no lines", F.coalesce(F.size("valid_line") <= 0, F.lit(True))), ("no allowed label", F.coalesce(F.size(kept) <= 0, F.lit(True))))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """line_no, id, text, gold (JSON text), _errors of labelled documents, one to a
    line. A kit has at least three (``at_least``)."""
    rows = numbered_lines(spark, path).select("line_no", F.from_json("text", "id string, text string, gold string").alias("r")).select("line_no", "r.*")
    rows = rows.withColumn("p_", parsed("gold"))
    again = duplicated(rows, "id").withColumn("again_", F.lit(True))
    rows = rows.join(again, "id", "left")
    return with_errors(rows, ("no id", F.col("id").isNull()), ("no text", F.col("text").isNull()), ("gold is not an object", ~F.col("p_.valid")), ("duplicate id", F.coalesce(F.col("again_"), F.lit(False)))).drop("p_", "again_")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """line_no, id, prediction (JSON text or null)."""
    return numbered_lines(spark, path).select("line_no", F.from_json("text", "id string, prediction string").alias("r")).select("line_no", "r.*")


def arms(spark: SparkSession, path: str, glob: str = "*.json", identity: tuple[str, ...] = ("rung", "k", "seed", "arm")) -> tuple[DataFrame, DataFrame]:
    """(arms, others): records that have the ``identity`` fields (some families
    have three), error arms among them, and the files that aren't arms. ``family`` is the file name up to its
    first underscore-digit group; env is kernel where a device is stamped."""
    files = whole_files(spark, path, glob).withColumn("r", F.from_json("text", ARM))
    is_arm = F.lit(True)
    for name in identity:
        is_arm = is_arm & F.col(f"r.{name}").isNotNull()
    found = files.where(F.coalesce(is_arm, F.lit(False))).select("file", F.regexp_extract("stem", r"^(.*?)_\d", 1).alias("family"), "r.*").withColumn("env", F.when(F.col("device").isNotNull(), "kernel").otherwise("local"))
    return found, files.where(~F.coalesce(is_arm, F.lit(False))).select("file")


def receipt_rows(arms_: DataFrame) -> DataFrame:
    """family, rung, k, seed, arm, index, valid_json, exact_match, micro_f1, prediction, error."""
    return arms_.select("family", "rung", "k", "seed", "arm", F.inline("results"))


def _asserted(rows: DataFrame, **facts: str | int) -> DataFrame:
    """``rows``, which raise when one is read whose fields aren't as said."""
    for name, want in facts.items():
        message = F.concat(F.lit(f"{name} is not {want} but "), F.coalesce(F.col(name).cast("string"), F.lit("null")))
        rows = rows.where(F.when(F.col(name).eqNullSafe(F.lit(want)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return rows


def cells(spark: SparkSession, path: str, addendum: str, glob: str = "*.json", **environment: str) -> DataFrame:
    """The cells of one addendum; ``environment`` (device, dtype) is asserted of each."""
    rows = whole_files(spark, path, glob).select(F.from_json("text", CELL).alias("r")).select("r.*").where(F.col("addendum") == addendum)
    return _asserted(rows, **environment)


def one_arm(spark: SparkSession, path: str, rows: int | None = None, **facts: str | int) -> DataFrame:
    """The record of one file (its name as glob below ``path``), asserted to have
    ``facts`` (device, dtype, k, arm) and, if given, as many results as ``rows``."""
    folder, _, name = path.rpartition("/")
    found, _ = arms(spark, folder, name, ("k", "arm"))
    found = _asserted(found, **facts)
    return found if rows is None else _asserted(found.withColumn("results_n", F.size("results")), results_n=rows).drop("results_n")


def scores_by_index(arm: DataFrame, **environment: str) -> DataFrame:
    """index, micro_f1 of the results that have a score; ``environment`` is asserted of their arms."""
    return _asserted(arm, **environment).select(F.inline("results")).where("micro_f1 is not null").select("index", "micro_f1")


def subset(rows: DataFrame, wanted: DataFrame, index: str) -> DataFrame:
    """The rows whose ``index`` is among the ``wanted`` ones (a table with that column; repeats don't matter)."""
    return rows.join(wanted.select(index).distinct(), index, "left_semi")


def positional(rows: DataFrame, left: str, right: str) -> DataFrame:
    """``rows`` with index, left and right of two lists of equal length; another length raises."""
    same = F.when(F.size(left) == F.size(right), F.lit(True)).otherwise(F.raise_error(F.lit("lists of different lengths")).cast("boolean"))
    keep = [c for c in rows.columns if c not in (left, right)]
    return rows.where(same).select(*keep, F.posexplode(F.arrays_zip(left, right)).alias("index", "z_")).select(*keep, "index", F.col(f"z_.{left}").alias(left), F.col(f"z_.{right}").alias(right))


def latest_per_id(rows: DataFrame, key: str, value: str, order: str = "line_no") -> DataFrame:
    """key, value: the last row of a key wins."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def pruned_rows(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``column`` (JSON text) and its gt_parse, of the rows that have one; no other column is read."""
    return spark.read.parquet(path).select(column, F.get_json_object(column, "$.gt_parse").alias("gt_parse")).where("gt_parse is not null")


def pruned_labels(spark: SparkSession, path: str, column: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of one JSON column that have gt_parse; reads that column only."""
    return spark.read.parquet(path).select(F.get_json_object(column, "$.gt_parse").alias("gt_parse")).where("gt_parse is not null").limit(limit)


def sweep(spark: SparkSession, path: str, skip: str = "node_modules") -> DataFrame:
    """file, text of the documents below a folder, but for names that contain
    ``skip`` and documents marked as superseded in their first 600 characters."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return files.where(~F.col("file").contains(skip) & ~F.substring("text", 1, 600).contains("SUPERSEDED"))


def first_per_task(tasks: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key in a given order."""
    return tasks.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("r_") <= n).drop("r_")
