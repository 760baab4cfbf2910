"""Entity tables: keyed replacement, corrections, deletion, work queues.

Tables are DataFrames or Parquet folders. ``model_name`` NULL and '' mean the same: no model. Where a function takes a
model, ``ANY_MODEL`` matches every row and '' only rows without one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechlytics.session import Written, fresh

ANY_MODEL = object()
RESULT_KEY = ["sample_id", "service_name", "model_name"]


def no_model(model: Column | str = "model_name") -> Column:
    return F.coalesce(F.col(model) if isinstance(model, str) else model, F.lit(""))


def for_service(rows: DataFrame, service: str, model: object = ANY_MODEL) -> DataFrame:
    """The rows of a service and, unless ANY_MODEL, of exactly one model."""
    rows = rows.filter(F.col("service_name") == service)
    return rows if model is ANY_MODEL else rows.filter(no_model() == (model or ""))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by ``order`` (NULLs first). Name enough columns in ``order`` to decide ties.

    The rank filter is pushed below the shuffle, so of a key with very many rows each task sends one.
    """
    (rank,) = fresh(rows, "rank")
    last = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return rows.withColumn(rank, F.row_number().over(last)).filter(F.col(rank) == 1).drop(rank)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` inserted or put in place of those with the same key; within ``new`` the last
    by ``order`` counts. Columns that one side lacks become NULL."""
    (side,) = fresh(stored, "side")
    both = stored.withColumn(side, F.lit(0)).unionByName(new.withColumn(side, F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [side, *order]).drop(side)


def write_results(new: DataFrame, path: str, order: list[str]) -> None:
    """Upsert results into a Parquet folder partitioned by service; only the services in ``new`` are rewritten."""
    spark = new.sparkSession
    new = new.withColumn("model_name", no_model())
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    if exists:  # only rows of the services at hand move; a NULL service is one
        touched = new.select(F.col("service_name").alias("__service")).distinct()
        stored = spark.read.parquet(path)
        stored = stored.join(touched, F.col("service_name").eqNullSafe(F.col("__service")), "left_semi")
        merged = upsert(stored, new, RESULT_KEY, order)
    else:
        merged = latest(new, RESULT_KEY, order)
    kept = Written(merged, "upsert")  # a folder cannot be read and overwritten
    kept.read().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("service_name").parquet(path)
    kept.drop()


def correct_ground_truth(truth: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replace texts by ``corrections`` (sample_id, text, verified_by, verified_at), one row a sample.

    The first correction keeps the text it replaces in original_text; later ones leave that alone.
    """
    fix = corrections.select("sample_id", *(F.col(c).alias(f"__{c}") for c in ("text", "verified_by", "verified_at")))
    fixed = F.col("__text").isNotNull()
    changed = {
        "original_text": F.when(fixed, F.coalesce("original_text", "text")).otherwise(F.col("original_text")),
        "verified_by": F.when(fixed, F.col("__verified_by")).otherwise(F.col("verified_by")),
        "verified_at": F.when(fixed, F.col("__verified_at")).otherwise(F.col("verified_at")),
    }
    joined = truth.join(fix, "sample_id", "left").withColumns(changed)
    return joined.withColumn("text", F.coalesce("__text", "text")).select(*truth.columns)


def delete_service(rows: DataFrame, service: str, model: object = ANY_MODEL) -> tuple[DataFrame, DataFrame]:
    """(what stays, the one-row count of what goes)."""
    gone = F.col("service_name") == service
    if model is not ANY_MODEL:
        gone = gone & (no_model() == (model or ""))
    gone = F.coalesce(gone, F.lit(False))
    return rows.filter(~gone), rows.filter(gone).agg(F.count(F.lit(1)).alias("n_deleted"))


def pending_samples(samples: DataFrame, results: DataFrame, service: str, model: object = ANY_MODEL) -> DataFrame:
    """Samples without a result of the service. A result with an error counts as one."""
    return samples.join(for_service(results, service, model).select("sample_id"), "sample_id", "left_anti")


def missing_truth(samples: DataFrame, truth: DataFrame) -> DataFrame:
    return samples.join(truth.select("sample_id"), "sample_id", "left_anti")


def pending_scores(
    samples: DataFrame, results: DataFrame, truth: DataFrame, scores: DataFrame, service: str, strict: bool = False
) -> DataFrame:
    """Samples with a transcript (which may be empty) and ground truth that have no score yet.

    ``strict`` repeats a sample for each of its results, as a join does; else each sample appears once.
    """
    heard = for_service(results, service).filter(F.col("transcription").isNotNull()).select("sample_id")
    known = samples.join(truth.select("sample_id"), "sample_id", "left_semi")
    done = for_service(scores, service).select("sample_id")
    queue = known.join(heard, "sample_id") if strict else known.join(heard, "sample_id", "left_semi")
    return queue.join(done, "sample_id", "left_anti")


def result_with_truth(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results beside the ground truth of their sample."""
    return results.join(truth.select("sample_id", F.col("text").alias("reference")), "sample_id")


def import_transcripts(
    generated: DataFrame, samples: DataFrame, truth: DataFrame, edits: DataFrame, force: bool = False
) -> DataFrame:
    """Ground-truth rows from generated transcripts: of known samples, without one yet unless ``force``, with a human edit
    (sample_id, corrected_text) put in place of the text and the text then kept as original."""
    rows = generated.join(samples.select("sample_id"), "sample_id", "left_semi").filter(F.col("transcription").isNotNull())
    if not force:
        rows = rows.join(truth.select("sample_id"), "sample_id", "left_anti")
    fixed = F.col("corrected_text").isNotNull()
    return rows.join(edits.select("sample_id", "corrected_text"), "sample_id", "left").select(
        "sample_id", F.coalesce("corrected_text", "transcription").alias("text"),
        F.when(fixed, F.lit("human")).alias("verified_by"), F.when(fixed, F.col("transcription")).alias("original_text"),
    )


def copy_if_empty(source: DataFrame, target: DataFrame) -> DataFrame:
    """``target``, or ``source`` if it has no rows."""
    none = target.limit(1).agg((F.count(F.lit(1)) == 0).alias("__none"))
    # One boolean decides, so it may be sent to every task.
    return target.unionByName(source.join(F.broadcast(none), F.col("__none")).drop("__none"))


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the declared schema: missing columns become NULL, further ones are dropped."""
    have = {c.lower() for c in rows.columns}
    typed = lambda f: F.col(f.name) if f.name.lower() in have else F.lit(None)
    return rows.select(*(typed(f).cast(f.dataType).alias(f.name) for f in schema.fields))


def violations(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows that lack a required value, with the names of the columns in __missing."""
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))
    return rows.withColumn("__missing", missing).filter(F.size("__missing") > 0)


def services_present(rows: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Distinct (service_name, model_name), no model as NULL, only registered services if a registry is given."""
    found = rows.select("service_name", F.nullif(no_model(), F.lit("")).alias("model_name")).distinct()
    return found if registry is None else found.join(registry.select("service_name"), "service_name", "left_semi")


def missing_services(wanted: list[str], registry: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(registered, unknown) of service names compared without case and outer blanks."""
    names = spark.createDataFrame([(w,) for w in wanted], "service_name string")
    clean = names.select(F.lower(F.trim("service_name")).alias("service_name"))
    known = registry.select("service_name")
    return clean.join(known, "service_name", "left_semi"), clean.join(known, "service_name", "left_anti")


def by_prefix(samples: DataFrame, prefix: str, show: int = 10) -> DataFrame:
    """The first ``show`` samples whose id begins with the prefix, each with the number of all that do."""
    found = samples.filter(F.col("sample_id").startswith(prefix))
    total = found.agg(F.count(F.lit(1)).alias("n_matches"))
    return found.select("sample_id").orderBy("sample_id").limit(show).join(F.broadcast(total))


def seeded_slice(rows: DataFrame, key: str, seed: int, offset: int, limit: int) -> DataFrame:
    """Rows offset..offset+limit-1 of a seeded shuffle: the order of md5(seed:key)."""
    position = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    return rows.orderBy(position, key).offset(offset).limit(limit)


def union_last(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several tables; of a key in more than one the later table's."""
    marked = [t.withColumn("__file", F.lit(k)) for k, t in enumerate(tables)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    return latest(both, keys, ["__file"]).drop("__file")


def overlay(rows: DataFrame, column: str, fixes: DataFrame, key: str) -> DataFrame:
    """Fields of a struct column replaced by the non-NULL fields of the same struct in ``fixes`` (key, column)."""
    fields = [f.name for f in rows.schema[column].dataType.fields]
    patch = fixes.select(F.col(key).alias("__key"), F.col(column).alias("__patch"))
    merged = F.struct(*(F.coalesce(f"__patch.{f}", f"{column}.{f}").alias(f) for f in fields))
    joined = rows.join(patch, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(column, F.when(F.col("__patch").isNull(), F.col(column)).otherwise(merged)).drop("__key", "__patch")


def first_samples(samples: DataFrame, count: int) -> DataFrame:
    """The first samples in the order of the dataset (a top-k, each task sends no more than ``count``)."""
    rest = [c for c in samples.columns if c != "dataset_index"]
    return samples.orderBy(F.asc_nulls_last("dataset_index"), *(F.asc_nulls_last(c) for c in rest)).limit(count)


def newest_first(rows: DataFrame, time: str, key: str) -> DataFrame:
    """Rows in order of time, the newest first, ties by key."""
    return rows.orderBy(F.desc_nulls_last(time), F.desc(key))


def lookup(rows: DataFrame, **key: object) -> DataFrame:
    """The rows with given values of some columns; None stands for NULL. The conditions reach the scan."""
    met = [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in key.items()]
    return rows.filter(reduce(lambda a, b: a & b, met))


def first_service(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows of the service and model of the first row by ``order``: what statistics are taken over where none is named."""
    first = rows.agg(F.min(F.struct(*order, "service_name", no_model().alias("model"))).alias("x"))
    named = first.select(F.col("x.service_name").alias("__s"), F.col("x.model").alias("__m"))
    # One row, so it may be sent to every task.
    return rows.join(F.broadcast(named), F.col("service_name").eqNullSafe(F.col("__s")) & (no_model() == F.col("__m"))).drop("__s", "__m")


def in_selection(pending: DataFrame, selected: DataFrame) -> DataFrame:
    """Of a work queue the samples that were selected."""
    return pending.join(selected.select("sample_id"), "sample_id", "left_semi")


def available_services(registry: DataFrame, wanted: list[str]) -> DataFrame:
    """Registered services of those wanted; ``all`` means those that are available (column available, NULL: yes)."""
    names = [w.strip().lower() for w in wanted]
    if "all" in names:
        return registry.filter(F.coalesce("available", F.lit(True)))
    return registry.filter(F.col("service_name").isin(names))


def start_run(runs: DataFrame | None, run: DataFrame) -> DataFrame:
    """Runs with a new one; its run_id must not be there yet (checked by ``violations`` of the caller's table)."""
    return run if runs is None else runs.unionByName(run.join(runs.select("run_id"), "run_id", "left_anti"), allowMissingColumns=True)


def finish_run(runs: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs with completed_at (and num_samples, where given) of ``finished`` (run_id, completed_at, num_samples)."""
    ends = finished.select("run_id", F.col("completed_at").alias("__at"), F.col("num_samples").alias("__n"))
    joined = runs.join(ends, "run_id", "left")
    changed = joined.withColumns({"completed_at": F.coalesce("__at", "completed_at"), "num_samples": F.coalesce("__n", "num_samples")})
    return changed.select(*runs.columns)


def quarantine(rows: DataFrame, required: list[str], allowed: dict[str, list]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with a reason): a required value missing, or one that is none of those allowed for its column."""
    absent = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in required]
    unknown = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(values), F.lit(f"{c} unknown")) for c, values in allowed.items()]
    checked = rows.withColumn("reason", F.coalesce(*absent, *unknown, F.lit(None).cast("string")))
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())
