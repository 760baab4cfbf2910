"""Scoring of spoken identity details, and verification of callers by rules and policies."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlytics.functions import identity as I
from speechlytics.functions import spoken
from speechlytics.operators.stats import beside, true_median
from speechlytics.operators.store import latest
from speechlytics.session import Written, fresh

NAME_RULES = (("exact", 1.0), ("similarity >= 0.95", 0.95), ("similarity >= 0.90", 0.9), ("similarity >= 0.85", 0.85))
SIMILAR_ENOUGH = 0.8
ADDRESS_PARTS = ("unit", "number", "unit_order", "street", "type", "suburb", "state", "postcode")
#: Policies of the full flow: (label, transcript with the record as hint, spelling as fallback and its least score, dob).
POLICIES = (
    ("A", True, None, True), ("B", False, None, True), ("C1", False, 1.0, True), ("C2", False, 0.9, True),
    ("D", False, 1.0, False),
)


#: Conditions in the order of reports.
CONDITIONS = ("none", "generic", "domain", "record")


def place_in(column: str, values: tuple[str, ...]) -> Column:
    """The place of a value in a fixed order; values that are not in it come last."""
    at = F.array_position(F.array(*map(F.lit, values)), F.col(column))
    return F.when(at > 0, at - 1).otherwise(F.lit(len(values))).cast("int")


def in_fixed_order(rows: DataFrame, vendors: tuple[str, ...] = (), conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """Rows of (vendor, condition, ...) in the order of reports: the vendors named first, in their order, then by name."""
    first = [place_in("vendor", vendors)] if vendors else []
    return rows.orderBy(*first, "vendor", place_in("condition", conditions), "condition")


def scorable(field: Column) -> Column:
    """The kind of detail a field is scored as: clips of the full flow count as what they hold."""
    return F.when(field == "flow_spelled", "spelled").when(field == "flow_dob", "dob").otherwise(field)


def latest_then_valid(results: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each (vendor, condition, id), if it has a transcript and no error."""
    return latest(results, ["vendor", "condition", "id"], order).filter(_valid())


def valid_then_latest(results: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each (vendor, condition, id) among those with a transcript and no error."""
    return latest(results.filter(_valid()), ["vendor", "condition", "id"], order)


def _valid() -> Column:
    return F.col("transcript").isNotNull() & (F.coalesce("error", F.lit("")) == "")


def score_rows(items: DataFrame, results: DataFrame) -> DataFrame:
    """Transcripts scored against what was said: ok, ok_strict, and what applies to the field, else NULL.

    ``items`` has one row an id. Each reading runs only on the rows of its field.
    """
    joined = results.join(
        items.select("id", "field", "item_set", "voice", "noise", "impostor", "homophone", "expected", "record"), "id"
    ).withColumn("kind", scorable(F.col("field")))
    only = lambda kind, column: F.when(F.col("kind") == kind, column)
    text = F.col("transcript")
    read = joined.select(
        "*",
        I.check_name(only("name", text), F.col("expected.surname")).alias("surname"),
        I.check_name(only("name", text), F.col("expected.given")).alias("given"),
        I.check_name(
            F.when(F.col("impostor"), only("name", text)), F.col("record.surname")
        ).alias("leak"),
        I.check_spelled(only("spelled", text), F.col("expected.surname")).alias("spelled"),
        I.check_email(only("email", text), F.col("expected.email")).alias("email"),
        I.check_dob(only("dob", text), F.col("expected.dob")).alias("dob"),
        I.check_address(only("address", text), F.col("expected")).alias("address"),
    )
    parts = [F.col(f"address.{p}").alias(f"addr_{p}") for p in ADDRESS_PARTS]
    return read.select(
        "id", "vendor", "condition", "field", "kind", "item_set", "voice", "noise", "impostor", "homophone", "ttfs",
        "transcript",
        F.coalesce("surname.lenient", "spelled.lenient", "email.lenient", "dob.lenient", "address.all").alias("ok"),
        F.coalesce("surname.strict", "spelled.strict", "email.strict", "dob.strict").alias("ok_strict"),
        F.col("given.lenient").alias("given_ok"), F.col("surname.near_miss").alias("near_miss"),
        F.col("leak.lenient").alias("record_leak"), F.col("dob.us_order").alias("us_order"),
        F.col("dob.parsed").alias("parsed"), *parts,
    )


def share(flag: Column, where: Column) -> list[Column]:
    """Passed and counted rows of a group among those where a condition holds and the flag is known."""
    held = where & flag.isNotNull()
    return [F.count_if(held & flag), F.count_if(held)]


def rate_text(passed: Column, counted: Column) -> Column:
    """'k/n (p%)', or '-' for none."""
    percent = F.bround(100 * passed / F.nullif(counted, F.lit(0)), 0).cast("int")
    return F.when(counted == 0, F.lit("-")).otherwise(F.format_string("%d/%d (%d%%)", passed, counted, percent))


def _rates(rows: DataFrame, by: list[str], cells: dict[str, tuple[Column, Column]]) -> DataFrame:
    sums = []
    for name, (flag, where) in cells.items():
        passed, counted = share(flag, where)
        sums += [passed.alias(f"{name}_passed"), counted.alias(f"{name}_n")]
    return rows.groupBy(*by).agg(*sums)


def field_accuracy(scores: DataFrame, by: tuple[str, ...] = ("vendor", "condition")) -> DataFrame:
    """Genuine callers: passed and counted per kind of detail, and the median time to the final transcript."""
    own = scores.filter(~F.coalesce("impostor", F.lit(False)))
    kind = lambda k: F.col("kind") == k
    close = F.col("ok") | (F.col("near_miss") >= SIMILAR_ENOUGH)
    cells = {
        "surname": (F.col("ok"), kind("name")), "surname_close": (close, kind("name")),
        "spelled": (F.col("ok"), kind("spelled")), "email_strict": (F.col("ok_strict"), kind("email")),
        "email": (F.col("ok"), kind("email")), "dob": (F.col("ok_strict"), kind("dob")),
        "dob_us": (F.col("us_order"), kind("dob")), "address": (F.col("ok"), kind("address")),
    }
    known = own.filter(F.col("ttfs").isNotNull())
    latency = true_median(known, list(by), "ttfs").withColumnRenamed("median", "ttfs_median").drop("n")
    return beside(_rates(own, list(by), cells), latency, list(by))


def address_parts(scores: DataFrame) -> DataFrame:
    cells = {p: (F.col(f"addr_{p}"), F.col("kind") == "address") for p in ADDRESS_PARTS}
    return _rates(scores, ["vendor", "condition"], cells)


def impostor_leakage(scores: DataFrame) -> DataFrame:
    """Callers who say another surname than the record's: did the record's appear, was the said one heard?"""
    wrong = F.coalesce("impostor", F.lit(False))
    alike = F.coalesce("homophone", F.lit(False))
    cells = {
        "leak_similar": (F.col("record_leak"), wrong & ~alike), "said_ok": (F.col("ok"), wrong & ~alike),
        "said_close": (F.col("near_miss") >= SIMILAR_ENOUGH, wrong & ~alike),
        "leak_homophone": (F.col("record_leak"), wrong & alike),
    }
    return _rates(scores.filter(wrong), ["vendor", "condition"], cells)


def by_voice(scores: DataFrame) -> DataFrame:
    """Without hints, genuine callers: passed and counted by voice and vendor (long form; pivot for a table)."""
    own = scores.filter((F.col("condition") == "none") & ~F.coalesce("impostor", F.lit(False)))
    return _rates(own, ["voice", "vendor"], {"all": (F.col("ok"), F.lit(True))})


def failures(items: DataFrame, results: DataFrame, order: list[str]) -> DataFrame:
    """Per vendor and condition how many synthetic items without the full flow last gave no transcript or an error."""
    last = latest(results, ["vendor", "condition", "id"], order).filter(~_valid())
    plain = items.filter((F.coalesce("item_set", F.lit("synthetic")) == "synthetic") & ~F.col("field").startswith("flow_"))
    return last.join(plain.select("id"), "id", "left_semi").groupBy("vendor", "condition").agg(F.count(F.lit(1)).alias("n"))


def paired_accuracy(pairs: DataFrame) -> DataFrame:
    """From (vendor, kind, synthetic_ok, real_ok) of the same script: n and both accuracies."""
    return pairs.groupBy("vendor", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("synthetic_ok").cast("double")).alias("synthetic"),
        F.avg(F.col("real_ok").cast("double")).alias("real"),
    )


def name_rule_rates(items: DataFrame, results: DataFrame) -> DataFrame:
    """Surnames of the record against honest transcripts: per vendor and rule, passes of genuine callers and impostors.

    The score is computed once a transcript; the rules are an array of thresholds unfolded beside it.
    """
    names = items.filter(F.col("field") == "name").select("id", "impostor", "homophone", F.col("record.surname").alias("surname"))
    scored = results.join(names, "id").select(
        "vendor", "condition", "impostor", "homophone",
        I.name_score(F.col("transcript"), F.col("surname")).alias("s"),
    )
    rules = [F.struct(F.lit(label).alias("rule"), (F.col("s.similarity") >= t).alias("ok")) for label, t in NAME_RULES]
    sounds = F.struct(
        F.lit("sounds alike OR >= 0.90").alias("rule"), (F.col("s.same_sound") | (F.col("s.similarity") >= 0.9)).alias("ok")
    )
    long = scored.select("vendor", "condition", "impostor", "homophone", F.explode(F.array(*rules, sounds)).alias("r"))
    wrong, alike = F.coalesce("impostor", F.lit(False)), F.coalesce("homophone", F.lit(False))
    ok = F.col("r.ok")
    cells = {"genuine": (ok, ~wrong), "similar": (ok, wrong & ~alike), "homophone": (ok, wrong & alike)}
    return _rates(long.withColumn("rule", F.col("r.rule")), ["vendor", "condition", "rule"], cells)


#: Values that a block of records holds in an all-against-all comparison.
BLOCK = 2000
#: Texts and values that a task compares, and the number of tasks from which it compares more.
NEAR_BLOCK, NEAR_TASKS = 1000, 4000


def all_against_all(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row of ``left`` beside every row of ``right``; by definition of the measure, the right ones are the query set.

    It runs as an equi-join on a block number. The right side, counted first, is cut in blocks of some ``block`` rows, and
    left rows are repeated for each, so that no task needs all of it.
    """
    blocks = max(1, -(-right.count() // block))
    (number,) = fresh(left, "block")
    spread = left.withColumn(number, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = right.withColumn(number, F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).cast("int"))
    return spread.join(placed, number).drop(number)


def impostor_pairs(honest: DataFrame, records: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each transcript against every other record: (id, other_id, vendor, text, other)."""
    others = records.select(F.col("id").alias("other_id"), F.col("value").alias("other"))
    return all_against_all(honest, others, block).filter(F.col("id") != F.col("other_id"))


def near_pairs(texts: DataFrame, values: DataFrame, least: float, block: int = NEAR_BLOCK) -> DataFrame:
    """(text, other, m, s): of all different texts beside all different values those with a window_sim of at least ``least``.

    Both sides, counted first, are cut in blocks, and each task has one block of either (see ``spoken.near_pairs``), so that
    pairs are made within it and only the near ones leave it. ``texts`` is (text), ``values`` (other, m); none is NULL.
    """
    n_texts, n_values = texts.count(), values.count()
    block = max(block, math.isqrt(n_texts * n_values // NEAR_TASKS))
    down, across = max(1, -(-n_texts // block)), max(1, -(-n_values // block))
    of = lambda column, blocks: F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")
    places = lambda blocks, place: F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), place)).alias("place")
    left = texts.select("text", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("m"), of("text", down).alias("row"))
    left = left.select("text", "other", "m", places(across, lambda k: F.col("row") * across + k))
    right = values.select(F.lit(None).cast("string").alias("text"), "other", F.col("m").cast("long").alias("m"), of("other", across).alias("column"))
    right = right.select("text", "other", "m", places(down, lambda k: k * across + F.col("column")))
    # The number of partitions is given, so AQE, which sees how small they are, leaves them apart.
    placed = left.union(right).repartitionById(down * across, F.col("place")).drop("place")
    return placed.mapInArrow(_near_in_block(least), "text string, other string, m long, s double")


def _near_in_block(least: float) -> Callable:
    """Near pairs of the texts and the values of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, values, counts = [], [], []
        for batch in batches:
            for text, other, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if other is None:
                    texts.append(text)
                else:
                    values.append(other)
                    counts.append(m)
        i, j, s = spoken.near_pairs(texts, values, least)
        for k in range(0, len(i), 10_000):
            x, y = i[k : k + 10_000].tolist(), j[k : k + 10_000].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([texts[t] for t in x]), pa.array([values[v] for v in y]), pa.array([counts[v] for v in y], pa.int64()), pa.array(s[k : k + 10_000])],
                names=["text", "other", "m", "s"],
            )

    return run


def cross_rates(honest: DataFrame, records: DataFrame, score: str, rules: tuple[float, ...]) -> DataFrame:
    """Per vendor and threshold: passes of genuine callers against their own record and of all others against it.

    ``honest`` is (id, vendor, text), already normalised; ``records`` (id, value), normalised too. Only different texts and
    values meet, each pair once, with the numbers of transcripts and records they stand for, and only pairs that pass the
    least threshold are made rows; how many there are is a product. Pairs of an id with itself are then taken off.
    """
    honest = Written(honest.filter(F.col("text").isNotNull()), "heard").read()
    records = Written(records, "records").read()
    texts = honest.groupBy("vendor", "text").agg(F.count(F.lit(1)).alias("n"))
    values = records.groupBy(F.col("value").alias("other")).agg(F.count(F.lit(1)).alias("m"))
    different, known = texts.select("text").distinct(), values.filter(F.col("other").isNotNull())
    if score == "window_sim":
        met = near_pairs(different, known, min(rules))
    else:
        met = all_against_all(different, known).withColumn("s", getattr(I, score)(F.col("text"), F.col("other")))
        met = met.filter(F.col("s") >= min(rules))
    met = Written(met, "met").read()
    own = honest.join(records, "id").groupBy("vendor", "text", F.col("value").alias("other")).agg(F.count(F.lit(1)).alias("own_n"))
    none, unknown = F.lit(0).cast("long"), F.lit(None).cast("double")
    every = texts.groupBy("vendor").agg(F.sum("n").alias("n")).crossJoin(values.agg(F.sum("m").alias("m")))
    counted = (
        every.filter(F.col("m").isNotNull())
        .select("vendor", (F.col("n") * F.col("m")).alias("all_n"), none.alias("near"), none.alias("own_n"), unknown.alias("s"))
        .union(met.join(texts, "text").select("vendor", none, F.col("n") * F.col("m"), none, "s"))
        .union(own.join(met.drop("m"), ["text", "other"], "left").select("vendor", none, none, "own_n", "s"))
    )
    counted = counted.withColumn("least", F.explode(F.array(*map(F.lit, rules))))
    passed = lambda c: F.sum(F.when(F.col("s") >= F.col("least"), F.col(c)).otherwise(0))
    sums = counted.groupBy("vendor", "least").agg(
        passed("own_n").alias("genuine_passed"), F.sum("own_n").alias("genuine_n"), passed("near").alias("all_passed"), F.sum("all_n").alias("all_n")
    )
    return sums.select(
        "vendor", "least", "genuine_passed", "genuine_n", (F.col("all_passed") - F.col("genuine_passed")).alias("impostor_passed"),
        (F.col("all_n") - F.col("genuine_n")).alias("impostor_n"),
    )


def verification_flow(callers: DataFrame, results: DataFrame, hinted: str = "record") -> DataFrame:
    """One decision a caller, vendor and policy: name, then spelling if the name fails, then date of birth.

    ``callers`` has (id, surname, dob, impostor, homophone); the spelled and the dob clip of caller c are
    flow_spelled_c and flow_dob_c. Only callers with all of their clips count. ``results`` is valid and latest;
    ``hinted`` is the condition whose transcripts were made with the record as a hint.
    """
    def clip(condition: str, prefix: str, name: str) -> DataFrame:
        rows = results.filter((F.col("condition") == condition) & F.col("id").startswith(prefix))
        caller = F.expr(f"substring(id, {len(prefix) + 1})").alias("id")
        return rows.select("vendor", caller, F.col("transcript").alias(name))

    whole = callers
    for condition, prefix, name in (
        ("none", "", "honest"), (hinted, "", "hinted"), ("none", "flow_spelled_", "spelling"), ("none", "flow_dob_", "birth")
    ):
        keys = ["id"] if name == "honest" else ["vendor", "id"]
        whole = whole.join(clip(condition, prefix, name), keys)
    scored = whole.select(
        "id", "vendor", "impostor", "homophone",
        I.name_score(F.col("honest"), F.col("surname"))["similarity"].alias("honest"),
        I.name_score(F.col("hinted"), F.col("surname"))["similarity"].alias("hinted"),
        I.spelled_score(F.col("spelling"), F.col("surname")).alias("spelling"),
        I.dob_match(F.col("birth"), F.col("dob")).alias("born"),
    )
    decisions = []
    for label, with_hint, fallback, dob in POLICIES:
        similarity = F.col("hinted" if with_hint else "honest")
        named = similarity >= (1.0 if fallback is None else 0.95)
        spelling = F.lit(False) if fallback is None else ~named
        passed = named | (spelling & (F.col("spelling") >= (fallback or 0.0)))
        ok = passed & F.col("born") if dob else passed
        decisions.append(F.struct(F.lit(label).alias("policy"), ok.alias("ok"), spelling.alias("spelled")))
    long = scored.withColumn("d", F.explode(F.array(*decisions))).withColumn("policy", F.col("d.policy"))
    wrong, alike = F.coalesce("impostor", F.lit(False)), F.coalesce("homophone", F.lit(False))
    ok = F.col("d.ok")
    cells = {
        "genuine": (ok, ~wrong), "spelling": (F.col("d.spelled"), ~wrong), "similar": (ok, wrong & ~alike),
        "homophone": (ok, wrong & alike),
    }
    return _rates(long, ["vendor", "policy"], cells)
