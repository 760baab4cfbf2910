"""Postal addresses of the same place, written differently.

Method: a self-built gazetteer. Mentions are parsed into parts; within each locality (postcode) the spellings of street
names are clustered around the dominating ones, which gives the gazetteer's streets, each with the types and the suburbs
it occurs with. Every address is then resolved by a beam search over gazetteer entries (locality, then street, then type
and suburb), scored by all its mentions, and addresses are joined on street identifier, number and unit.

All steps are aggregations and equi-joins that have a locality in their key. Spellings meet through shared deletion keys,
and only the best neighbour of each is kept, so no pairs of spellings are emitted; evidence is counted by (address, part,
value) before it moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlytics.llm.address_text import Parts, parse_fields, parse_text
from speechlytics.session import Written

#: Candidates kept after each stage of the beam search.
BEAM = 4
#: A spelling joins a neighbour that stands in so many times as many addresses, or stands in SELDOM or fewer itself; names
#: of fewer than LONG letters are too often one letter apart and need more evidence (see ``cluster_spellings``).
DOMINANCE, SELDOM, LONG = 4, 2, 7
#: Addresses that a postcode must have with a suburb for another postcode to be read as a slip of it.
SETTLED = 3

_PARTS = ", ".join(f"{p} string" for p in Parts._fields)


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorted runs, whatever the tables' sizes seem to be. What is planned is taken from the length of compressed
    files, a small part of what the rows take in memory, and a join once planned as a broadcast stays one; so all
    that is sent this way would grow with the input, and the driver holds it."""
    return left.join(right.hint("merge"), on, how)


def _parsed(column: str, parse) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [parse(x) for x in batch[column].to_pylist()]
            columns = list(zip(*parts, strict=True)) or [[]] * len(Parts._fields)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], *(pa.array(c, pa.string()) for c in columns)], names=["id", *Parts._fields]
            )

    return run


def mentions(addresses: DataFrame, texts: DataFrame) -> DataFrame:
    """Parsed mentions: (id, unit, number, street, type, suburb, state, postcode), each distinct wording once.

    ``addresses`` has id and a struct ``expected`` (and optionally ``record``) with the fields of ``Parts``; ``texts``
    has id and transcript. NULL structs, NULL and blank texts say nothing.
    """
    schema = f"id string, {_PARTS}"
    own = [
        addresses.select("id", F.col(c).alias("fields")).filter(F.col("fields").isNotNull()).distinct()
        .mapInArrow(_parsed("fields", parse_fields), schema)
        for c in ("expected", "record") if c in addresses.columns
    ]
    known = addresses.select("id").distinct()
    heard = (
        _met(texts.select("id", "transcript").filter(F.col("transcript").isNotNull() & (F.trim("transcript") != "")), known, "id", "left_semi")
        .distinct()
        .mapInArrow(_parsed("transcript", parse_text), schema)
    )
    return reduce(DataFrame.unionByName, [*own, heard])


def _votes(found: DataFrame) -> DataFrame:
    """(id, part, value, n): in how many wordings an address has a value."""
    pairs = F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("value")) for p in Parts._fields))
    long = found.select("id", F.explode(pairs).alias("x")).select("id", "x.part", "x.value")
    return long.filter(F.col("value").isNotNull()).groupBy("id", "part", "value").agg(F.count(F.lit(1)).alias("n"))


def deletion_keys(name: Column) -> Column:
    """The name and the name without one of its letters: names one slip apart share one of these."""
    shorter = F.transform(
        F.sequence(F.lit(1), F.length(name)),
        lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))),
    )
    return F.array_distinct(F.concat(F.array(name), F.when(F.length(name) > 2, shorter).otherwise(F.array(name))))


def cluster_spellings(names: DataFrame, homes: DataFrame | None = None) -> DataFrame:
    """(place, name, root, n) for ``names`` (place, name, n): each spelling with the one it is a slip of.

    A spelling is drawn to the most frequent one that shares a deletion key with it in the same place, if that dominates it or
    it is seldom. That is enough for long names; where one of the two is short ("hall", "hill") both must also stand at one
    address or in one house: ``homes`` (place, name, mark) gives the marks, ids or house numbers, that names were seen with.
    The least spelling wins ties. Roots are followed to the end.
    """
    keyed = names.withColumn("key", F.explode(deletion_keys(F.col("name"))))
    rank = F.struct(F.col("n"), F.col("name"))
    # Of equal counts the alphabetically greater name is the root; a root has none greater.
    best = keyed.groupBy("place", "key").agg(F.max(rank).alias("top"))
    near = (
        _met(keyed, best, ["place", "key"])
        .filter(F.col("top") > rank)
        .filter((F.col("top.n") >= DOMINANCE * F.col("n")) | (F.col("n") <= SELDOM))
        .select("place", "name", "top").distinct()
    )
    long = (F.length("name") >= LONG) & (F.length("top.name") >= LONG)
    sure = near.filter(long)
    if homes is not None:
        marks = homes.select("place", "name", "mark").distinct()
        seen = _met(near.filter(~long), marks, ["place", "name"]).withColumn("other", F.col("top.name"))
        shared = _met(seen, marks.withColumnRenamed("name", "other"), ["place", "other", "mark"], "left_semi")
        sure = sure.unionByName(shared.select("place", "name", "top").distinct())
    drawn = sure.groupBy("place", "name").agg(F.max("top").alias("top")).select("place", "name", F.col("top.name").alias("up"))
    linked = Written(_met(names, drawn, ["place", "name"], "left").withColumn("root", F.coalesce("up", "name")).drop("up"), "spellings")
    while True:  # doubling: a chain of k slips takes log2(k) rounds
        rows = linked.read()
        above = rows.filter(F.col("root") != F.col("name")).select("place", F.col("name").alias("root"), F.col("root").alias("above"))
        moved = _met(rows, above, ["place", "root"], "left_semi")
        if moved.isEmpty():
            return rows.select("place", "name", "root", "n")
        step = Written(
            _met(rows, above, ["place", "root"], "left").withColumn("root", F.coalesce("above", "root")).drop("above"), "spellings"
        )
        linked.drop()
        linked = step


def _best(rows: DataFrame, keep: int, by: list[str], order: list[str]) -> DataFrame:
    ranked = Window.partitionBy(*by).orderBy(F.desc("score"), *order)
    return rows.withColumn("__rank", F.row_number().over(ranked)).filter(F.col("__rank") <= keep).drop("__rank")


def _slip(a: Column, b: Column) -> Column:
    """Whether two postcodes differ by one digit, or by two neighbours in the other order."""
    swapped = F.exists(
        F.sequence(F.lit(1), F.length(a) - 1),
        lambda k: F.concat(F.substring(a, F.lit(1), k - 1), F.substring(a, k + 1, F.lit(1)), F.substring(a, k, F.lit(1)), F.substring(a, k + 2, F.length(a))) == b,
    )
    return (a != b) & (F.length(a) == F.length(b)) & (F.length(a) > 1) & ((F.levenshtein(a, b) <= 1) | swapped)


def _suburbs(votes: DataFrame, home: DataFrame, streets: DataFrame) -> DataFrame:
    """(id, suburb): the suburb of an address as a root of its locality; none where it is not told, or only once and that a
    street's name.

    Spellings follow the dominating ones; a root that is a few letters from the locality's first suburb, or a part of its
    name and seldom, is that suburb as well.
    """
    said = _met(votes.filter(F.col("part") == "suburb").select("id", F.col("value").alias("name"), "n"), home, "id")
    counted = said.groupBy("place", "name").agg(F.sum("n").alias("n"))
    roots = cluster_spellings(counted, said.select("place", "name", F.col("id").alias("mark")))
    sizes = roots.groupBy("place", "root").agg(F.sum("n").alias("n"))
    first = sizes.groupBy("place").agg(F.max(F.struct("n", "root")).alias("top"))
    top = F.col("top.root")
    inside = (F.contains(top, F.col("root")) | F.contains(F.col("root"), top)) & (F.col("n") * DOMINANCE <= F.col("top.n"))
    close = F.levenshtein("root", top) <= F.greatest(F.lit(2), F.floor(F.least(F.length("root"), F.length(top)) / 4))
    street = streets.select("place", F.col("name").alias("root"), F.lit(True).alias("street")).distinct()
    settled = _met(_met(sizes, first, "place"), street, ["place", "root"], "left").select(
        "place", "root",
        F.when((F.col("root") != top) & (inside | close), top).when(F.col("street") & (F.col("n") == 1), None).otherwise(F.col("root")).alias("suburb"),
    )
    each = _met(_met(said, roots.select("place", "name", "root"), ["place", "name"]), settled, ["place", "root"])
    by = each.filter(F.col("suburb").isNotNull()).groupBy("id", "suburb").agg(F.sum("n").alias("n"))
    return by.groupBy("id").agg(F.min(F.struct(-F.col("n"), F.col("suburb")))["suburb"].alias("suburb"))


def resolve(addresses: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, street_id, unit, number) for every address whose locality, street and number can be told.

    street_id is ``locality|street|type|suburb``; unit is NULL where no mention has one, which is a place of its own (a unit
    is not left out of an address). An address of which nothing, no number, or neither postcode nor suburb is known is not
    resolved. A missing type or suburb is filled with the street's most frequent one. Rows of the same id are mentions of one
    address. Ids may be NULL: such rows are left out.
    """
    addresses, texts = addresses.filter(F.col("id").isNotNull()), texts.filter(F.col("id").isNotNull())
    votes = Written(_votes(mentions(addresses, texts)), "votes").read()
    of = lambda part: votes.filter(F.col("part") == part).select("id", F.col("value").alias(part), "n")
    # The value of each part with the most votes, the least of equal ones.
    most = lambda p: F.min(F.when(F.col("part") == p, F.struct(-F.col("n"), F.col("value"))))["value"].alias(p)
    tops = Written(votes.groupBy("id").agg(*(most(p) for p in Parts._fields)), "tops").read()

    # Stage 1: localities. A postcode that hardly any address has gives way to one that is a slip away and has many with
    # the same suburb; an address without postcode takes those its suburb, or a slip of it, is known in.
    coded = tops.filter(F.col("postcode").isNotNull())
    with_suburb = _met(of("suburb"), coded.select("id", F.col("postcode").alias("place")), "id")
    known = with_suburb.groupBy("place", F.col("suburb").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    lonely = coded.groupBy("postcode").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") <= SELDOM)
    alone = _met(coded.select("id", "postcode", F.col("suburb").alias("name")), lonely, "postcode")
    moved = (
        _met(alone, known.filter(F.col("n") >= SETTLED), "name").filter(_slip(F.col("postcode"), F.col("place")))
        .select("id", "place", (F.log1p("n") + 100.0).alias("score"))
    )
    lost = _met(of("suburb"), coded.select("id"), "id", "left_anti").withColumn("key", F.explode(deletion_keys(F.col("suburb"))))
    theirs = known.withColumn("key", F.explode(deletion_keys(F.col("name")))).groupBy("key", "place").agg(F.sum("n").alias("n"))
    by_suburb = (
        _met(lost.select("id", "key").distinct(), theirs, "key").groupBy("id", "place").agg(F.max("n").alias("seen"))
        .select("id", "place", F.log1p("seen").alias("score"))
    )
    by_code = of("postcode").select("id", F.col("postcode").alias("place"), (F.col("n") * 3.0).alias("score"))
    localities = Written(
        _best(by_code.unionByName(by_suburb).unionByName(moved), BEAM, ["id"], ["place"]), "localities"
    ).read()

    # The gazetteer: per locality the street names with their spellings, and the types and suburbs of each.
    home = Written(_best(localities, 1, ["id"], ["place"]).select("id", "place"), "homes").read()
    named = _met(of("street"), home, "id").select("id", "place", F.col("street").alias("name"))
    house = F.concat_ws("|", F.coalesce("unit", F.lit("")), "number")
    marks = named.select("place", "name", F.concat(F.lit("id "), "id").alias("mark")).unionByName(
        _met(named, tops.filter(F.col("number").isNotNull()).select("id", house.alias("house")), "id")
        .select("place", "name", F.concat(F.lit("house "), "house").alias("mark"))
    )
    counts = named.groupBy("place", "name").agg(F.count(F.lit(1)).alias("n"))
    spellings = cluster_spellings(counts, marks)

    # Stage 2: streets of those localities. A spelling seen there has its root; another may be one slip from some.
    tried = _met(localities, of("street").withColumnRenamed("n", "said"), "id")
    exact = _met(tried, spellings.select("place", F.col("name").alias("street"), "root"), ["place", "street"], "left")
    there = exact.filter(F.col("root").isNotNull()).select(
        "id", "place", "root", (F.col("score") + F.col("said")).alias("score")
    )
    rest = exact.filter(F.col("root").isNull()).withColumn("key", F.explode(deletion_keys(F.col("street"))))
    entries = spellings.withColumn("key", F.explode(deletion_keys(F.col("name")))).groupBy("place", "key").agg(
        F.max_by("root", F.struct("n", "root")).alias("near"))
    guessed = (
        _met(rest.drop("root"), entries, ["place", "key"])
        .select("id", "place", F.col("near").alias("root"), (F.col("score") + 0.5 * F.col("said")).alias("score"))
    )
    roots = there.unionByName(guessed).groupBy("id", "place", "root").agg(F.sum("score").alias("score"))
    beam = Written(_best(roots, BEAM, ["id"], ["place", "root"]), "beam").read()

    # Stage 3: types. One that is said counts much more than one that is only usual for the street.
    parts = tops.select("id", "unit", "number", "type")
    kinds = (
        _met(_met(beam, home, ["id", "place"], "left_semi"), parts.filter(F.col("type").isNotNull()), "id")
        .groupBy("place", "root", F.col("type").alias("kind")).agg(F.count_distinct("id").alias("uses"))
    )
    typed = (
        _met(_met(beam, parts, "id"), kinds, ["place", "root"], "left")
        .withColumn(
            "score",
            F.col("score")
            + F.when(F.col("type") == F.col("kind"), 4.0).otherwise(0.0)
            + 0.1 * F.log1p(F.coalesce("uses", F.lit(0))),
        )
    )
    suburbs = _suburbs(votes, home, spellings)
    chosen = _best(typed, 1, ["id"], ["place", "root", "kind"]).withColumn("type", F.coalesce("type", "kind", F.lit("")))
    chosen = Written(_met(chosen.filter(F.col("number").isNotNull()), suburbs, "id", "left"), "chosen").read()
    usual = (
        chosen.filter(F.col("suburb").isNotNull()).groupBy("place", "root", "type", "suburb").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("place", "root", "type").agg(F.min(F.struct(-F.col("n"), F.col("suburb")))["suburb"].alias("usual"))
    )
    street = F.concat_ws("|", "place", "root", "type", F.coalesce("suburb", "usual", F.lit("")))
    return _met(chosen, usual, ["place", "root", "type"], "left").select("id", street.alias("street_id"), "unit", "number")


def same_place(resolved: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of addresses resolved to the same place."""
    slim = resolved.select("street_id", F.coalesce("unit", F.lit("")).alias("unit"), "number", "id")
    a = slim.withColumnRenamed("id", "id_a")
    b = slim.withColumnRenamed("id", "id_b")
    return _met(a, b, ["street_id", "unit", "number"]).filter(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")


def places(addresses: DataFrame, resolved: DataFrame) -> DataFrame:
    """(id, place_id, n_ids): each address with the least id of its place and the number of ids there.

    An address that could not be resolved is a place of its own.
    """
    unit = F.coalesce("unit", F.lit("")).alias("unit")
    groups = resolved.groupBy("street_id", unit, "number").agg(
        F.min("id").alias("place_id"), F.count(F.lit(1)).alias("n_ids")
    )
    placed = _met(resolved.select("id", "street_id", unit, "number"), groups, ["street_id", "unit", "number"])
    ids = addresses.filter(F.col("id").isNotNull()).select("id").distinct()
    return _met(ids, placed, "id", "left").select(
        "id", F.coalesce("place_id", "id").alias("place_id"), F.coalesce("n_ids", F.lit(1)).alias("n_ids")
    )
