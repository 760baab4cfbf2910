"""Column functions for identity details: what was said, as numbers, letters, names, e-mail addresses, dates, addresses.

All are expressions of built-in functions, but for three Arrow functions: number words to digits, which looks ahead over several
words, and the similarities of strings. NULL in gives NULL out.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from speechlytics.functions import spoken

ADDRESS_PARTS = ("unit", "number", "unit_order", "street", "type", "suburb", "state", "postcode", "all")


PARTS = ("unit", "number", "street", "type", "suburb", "state", "postcode")


def _mapped(words: Column, table: dict[str, str], otherwise: Callable[[Column], Column] = lambda w: w) -> Column:
    """The words of an array with those of a small table replaced."""
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), otherwise(w)))


def words(text: Column, breaks: bool = False) -> Column:
    """Lower-case runs of letters or digits; with ``breaks``, a "," wherever , / ; or . stands between them."""
    found = F.regexp_extract_all(F.replace(F.lower(text), F.lit("'"), F.lit("")), F.lit("[a-z]+|[0-9]+" + ("|[,/;.]" if breaks else "")), F.lit(0))
    return F.transform(found, lambda w: F.when(w.rlike("^[/;.]$"), F.lit(",")).otherwise(w)) if breaks else found


@functools.cache
def _digits() -> Callable:
    def read(rows: pd.Series) -> pd.Series:
        known: dict[str, str] = {}  # equal texts of a batch are read once
        for t in rows:
            if t is not None and t not in known:
                known[t] = " ".join(spoken.numbers_to_digits(t.split()))
        return pd.Series([known.get(t) for t in rows], dtype=object)

    read.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(read, "string")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it refers to several times: computed once, and written once in the plan.

    The body may not call the Arrow functions of this module (lambdas cannot); what they give belongs in the value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def digit_words(tokens: Column) -> Column:
    """An array of words with number words as digit strings; digits said one by one join, commas end such a run and vanish."""
    return F.filter(F.split(_digits()(F.array_join(tokens, " ")), " "), lambda w: w != "")


def digits(text: Column) -> Column:
    return F.array_join(digit_words(words(text, True)), " ")


def letter_runs(text: Column) -> Column:
    """Spelled letters as a string, a space for each other word.

    Words in capitals are letters; "m for mike" and "m as in mary" are m; "double x" is xx; a word that sounds like a letter is
    one only beside another letter.
    """
    apart = F.regexp_replace(text, r"(?<=\b[A-Z]{1,60})(?=[A-Z]{1,60}\b)", " ")
    line = F.array_join(words(apart), " ")
    said = F.regexp_replace(line, r"\bdouble ([a-z])\b|\b([a-z]) (?:for|as in) [a-z0-9]+", "$1 $1 $2")
    tokens = F.filter(F.split(said, " +"), lambda w: w != "")
    sounds = {w: letter.upper() for w, letter in spoken.LETTERS.items()}
    marks = _mapped(tokens, sounds, lambda w: F.when(w.rlike("^[a-z]$"), w).otherwise(F.lit(" ")))
    return F.lower(F.regexp_replace(F.array_join(marks, ""), "(?<![A-Za-z])[A-Z](?![A-Za-z])", " "))


def spelled(text: Column) -> Column:
    return F.replace(letter_runs(text), F.lit(" "), F.lit(""))


@functools.cache
def _pairwise(kind: str) -> Callable:
    """Functions of two columns over whole batches."""

    def both(a: pd.Series, b: pd.Series) -> pd.Series:
        known = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
        out = np.full(len(a), np.nan)
        x, y = [a.iloc[k] for k in known], [b.iloc[k] for k in known]
        if kind == "ratio":
            out[known] = [spoken.best_ratio(name, tokens) for tokens, name in zip(x, y, strict=True)]
        elif kind == "best":
            out[known] = spoken.best_similarities(x, y)
        elif kind == "slices":
            slices = {(t, len(n)): None for t, n in zip(x, y, strict=True)}
            slices = {k: spoken.slices_near(*k) for k in slices}
            out[known] = spoken.best_similarities([slices[t, len(n)] for t, n in zip(x, y, strict=True)], y)
        else:
            out[known] = spoken.similarities(x, y)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    both.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(both, "double")


def jaro_winkler(a: Column, b: Column) -> Column:
    """See ``spoken.similarities``."""
    return _pairwise("pair")(a, b)


def best_similarity(options: Column, name: Column) -> Column:
    """The best similarity of a name to any string of an array."""
    return _pairwise("best")(options, name)


def window_sim(text: Column, target: Column) -> Column:
    """The best similarity of a target to a slice of a text at most two characters shorter or longer."""
    return _pairwise("slices")(text, target)


def _known(*columns: Column) -> Column:
    return functools.reduce(lambda x, y: x & y, (c.isNotNull() for c in columns))


def _flags(known: Column, **flags: Column) -> Column:
    """A struct of results, each NULL where an argument is."""
    return F.struct(*(F.when(known, c).alias(n) for n, c in flags.items()))


def check_name(transcript: Column, expected: Column) -> Column:
    """strict: a word is the name; lenient: the name stands in the joined or the spelled letters; near_miss: best ratio."""
    name, tokens = norm_name(expected), name_tokens(transcript)
    given = F.struct(
        name.alias("name"), tokens.alias("tokens"), spelled(transcript).alias("letters"), _pairwise("ratio")(tokens, name).alias("near")
    )

    def read(v: Column) -> Column:
        strict = F.array_contains(v["tokens"], v["name"])
        lenient = strict | F.contains(F.array_join(v["tokens"], ""), v["name"]) | F.contains(v["letters"], v["name"])
        return _flags(_known(v["name"], v["tokens"]), strict=strict, lenient=lenient, near_miss=v["near"])

    return _let(given, read)


def check_spelled(transcript: Column, expected: Column) -> Column:
    """strict: a word is the name, or it stands both in the text's letters and in the spelled ones; lenient: in either."""
    tokens = F.transform(F.filter(F.split(transcript, r"(?U)\s+"), lambda w: w != ""), norm_name)
    given = F.struct(
        norm_name(expected).alias("name"), tokens.alias("tokens"), norm_name(transcript).alias("text"), spelled(transcript).alias("letters")
    )

    def read(v: Column) -> Column:
        in_text, in_runs = F.contains(v["text"], v["name"]), F.contains(v["letters"], v["name"])
        strict = F.array_contains(v["tokens"], v["name"]) | (in_text & in_runs)
        return _flags(_known(v["name"], v["text"]), strict=strict, lenient=in_text | in_runs)

    return _let(given, read)


def normalise_email(text: Column) -> Column:
    """A spoken e-mail address as one string."""
    line = F.regexp_replace(F.replace(F.lower(text), F.lit("full stop"), F.lit("dot")), r"\.(?=\S)", " dot ")
    line = F.replace(F.replace(line, F.lit("@"), F.lit(" at ")), F.lit("_"), F.lit(" underscore "))
    table = spoken.EMAIL_SIGNS | {sound: spoken.LETTERS[sound] for sound in spoken.EMAIL_LETTERS}
    return F.array_join(_mapped(digit_words(words(line)), table), "")


def check_email(transcript: Column, expected: Column) -> Column:
    """strict: the address stands in the text without its white space; lenient: or in what was said of it."""
    wanted = F.lower(expected)
    strict = F.contains(F.regexp_replace(F.lower(transcript), r"(?U)\s+", ""), wanted)
    return _flags(_known(transcript, expected), strict=strict, lenient=strict | F.contains(normalise_email(transcript), wanted))


def full_year(year: Column) -> Column:
    """Two digits over 30 are of the last century."""
    return F.when(year >= 100, year).otherwise(year + F.when(year > 30, 1900).otherwise(2000)).cast("int")


def _number(digits: Column) -> Column:
    return F.when(F.length(digits) <= 9, digits.try_cast("int"))


def parse_dob(text: Column) -> Column:
    """(day, month, year), day first; parts that are not said are NULL, as are numbers of more than nine digits."""
    low = F.lower(text)
    written = F.regexp_extract_all(low, F.lit(r"([0-9]{1,2})\s*[/.-]\s*([0-9]{1,2})\s*[/.-]\s*([0-9]{2,4})"), F.lit(0))
    tokens = digit_words(_mapped(words(low, True), spoken.ORDINALS))
    given = F.struct(F.try_element_at(written, F.lit(1)).alias("written"), tokens.alias("tokens"))
    return F.when(text.isNotNull(), _let(given, _read_date))


def _read_date(v: Column) -> Column:
    months = F.create_map(*(F.lit(x) for pair in spoken.MONTHS.items() for x in pair))
    named = F.filter(F.transform(v["tokens"], lambda w: F.try_element_at(months, w)), lambda m: m.isNotNull())

    def joined(found: Column, token: Column) -> Column:  # "nineteen eighty-five"
        last = F.try_element_at(found, F.lit(-1))
        century = last.isin("19", "20") & (F.length(token) == 2)
        whole = F.concat(F.slice(found, 1, F.greatest(F.lit(0), F.size(found) - 1)), F.array(F.concat(last, token)))
        return F.when(century, whole).otherwise(F.concat(found, F.array(token)))

    numbers = F.aggregate(F.filter(v["tokens"], lambda w: w.rlike("^[0-9]+$")), F.array().cast("array<string>"), joined)
    parts = F.regexp_extract_all(v["written"], F.lit("[0-9]+"), F.lit(0))
    return _let(
        F.struct(parts.alias("written"), F.try_element_at(named, F.lit(1)).alias("month"), numbers.alias("numbers")), _order_parts
    )


def _order_parts(v: Column) -> Column:
    numbers, month = v["numbers"], v["month"]
    at = lambda k: F.try_element_at(numbers, F.lit(k))
    first_day = _number(F.try_element_at(F.filter(numbers, lambda w: (F.length(w) <= 2) & _number(w).between(1, 31)), F.lit(1)))

    def with_month(day: Column) -> Column:  # the year is the last number that is not the day
        others = F.filter(numbers, lambda w: day.isNull() | (F.length(w) > 2) | (_number(w) != day))
        return _date(day, month, _number(F.try_element_at(others, F.lit(-1))))

    cut = lambda start, n=9: _number(F.substring(at(1), start, n))
    size, one = F.size(numbers), F.length(at(1))
    return (
        F.when(v["written"].isNotNull(), _date(*(_number(F.try_element_at(v["written"], F.lit(k))) for k in (1, 2, 3))))
        .when(month.isNotNull(), _let(first_day, with_month))
        .when(size >= 3, _date(*(_number(at(k)) for k in (1, 2, 3))))
        .when((size == 1) & one.isin(6, 8), _date(cut(1, 2), cut(3, 2), cut(5)))
        .when((size == 2) & (one == 4), _date(cut(1, 2), cut(3, 2), _number(at(2))))
        .otherwise(_date(*(F.lit(None).cast("int"),) * 3))
    )


def _date(day: Column, month: Column, year: Column) -> Column:
    return F.struct(day.alias("day"), month.alias("month"), full_year(year).alias("year"))


def check_dob(transcript: Column, expected: Column) -> Column:
    """``expected`` is yyyy-mm-dd. A month-first reading is recoverable only when the day cannot be a month."""
    wanted = (F.split_part(expected, F.lit("-"), F.lit(k)).try_cast("int").alias(n) for k, n in ((1, "y"), (2, "m"), (3, "d")))

    def read(v: Column) -> Column:
        got, year, month, day = v["got"], v["y"], v["m"], v["d"]
        same = lambda *parts: functools.reduce(
            lambda x, y: x & y, (got[n].eqNullSafe(p) for n, p in zip(("day", "month", "year"), parts, strict=True))
        )
        strict = same(day, month, year)
        swapped = same(month, day, year) & ~strict
        shown = F.concat_ws("-", *(F.coalesce(got[n].cast("string"), F.lit("?")) for n in ("day", "month", "year")))
        known = got.isNotNull() & v["d"].isNotNull()
        return _flags(known, strict=strict, lenient=strict | (swapped & (day > 12)), us_order=swapped, parsed=shown)

    return _let(F.struct(parse_dob(transcript).alias("got"), *wanted), read)


def dob_match(transcript: Column, expected: Column) -> Column:
    return check_dob(transcript, expected)["lenient"]


def normalise_address(text: Column) -> Column:
    """Digits for number words, codes for states, street types written out; padded with spaces."""
    line = F.concat(F.lit(" "), F.array_join(digit_words(words(text, True)), " "), F.lit(" "))
    for name, code in spoken.STATE_NAMES.items():  # the order counts: longer names before their parts
        line = F.replace(line, F.lit(f" {name} "), F.lit(f" {code} "))
    tokens = F.filter(F.split(line, " "), lambda w: w != "")
    return F.concat(F.lit(" "), F.array_join(_mapped(tokens, spoken.STREET_SHORT), " "), F.lit(" "))


def _address_words(line: Column) -> tuple[Column, Column]:
    """The numbers and the other words of a normalised address."""
    tokens = F.filter(F.split(line, " "), lambda w: w != "")
    return F.filter(tokens, lambda w: w.rlike("^[0-9]+$")), F.filter(tokens, lambda w: ~w.rlike("^[0-9]+$"))


def _in_order(numbers: Column, unit: Column, number: Column) -> Column:
    """Whether the number is the next one after the unit's first mention."""
    at = F.array_position(numbers, unit)
    return F.coalesce((at > 0) & (F.try_element_at(numbers, (at + 1).cast("int")) == number), F.lit(False))


def _part(address: Column, name: str) -> Column:
    return F.coalesce(address[name], F.lit(""))


def _any_part(address: Column) -> Column:
    return F.coalesce(*(address[p] for p in PARTS)).isNotNull()


def check_address(transcript: Column, address: Column) -> Column:
    """Struct of flags for the parts of an address struct that were heard; NULL where there is no transcript or no part is
    known. unit and unit_order only where a unit is expected; ``all`` of the others."""
    known = transcript.isNotNull() & _any_part(address)
    given = F.struct(normalise_address(transcript).alias("line"), known.alias("known"), *(_part(address, n).alias(n) for n in PARTS))

    def read(v: Column) -> Column:
        numbers = v["numbers"]
        with_unit = v["known"] & (v["unit"] != "")
        heard = {n: F.contains(v["line"], F.concat(F.lit(" "), F.lower(v[n]), F.lit(" "))) for n in ("street", "type", "suburb", "state")}
        parts = {
            "unit": F.when(with_unit, F.array_contains(numbers, v["unit"])), "number": F.array_contains(numbers, v["number"]),
            "unit_order": F.when(with_unit, _in_order(numbers, v["unit"], v["number"])), **heard,
            "postcode": F.array_contains(numbers, v["postcode"]) | F.contains(F.array_join(numbers, ""), v["postcode"]),
        }
        return F.struct(v["known"].alias("known"), *(c.alias(n) for n, c in parts.items()))

    def all_of(v: Column) -> Column:
        every = functools.reduce(lambda x, y: x & y, (F.coalesce(v[n], F.lit(True)) for n in ADDRESS_PARTS if n != "all"))
        return _flags(v["known"], **{n: v[n] for n in ADDRESS_PARTS if n != "all"}, all=every)

    def numbered(v: Column) -> Column:
        return F.struct(*(v[n].alias(n) for n in ("line", "known", *PARTS)), _address_words(v["line"])[0].alias("numbers"))

    return _let(_let(_let(given, numbered), read), all_of)


def address_score(transcript: Column, address: Column) -> Column:
    """(numbers_exact, similarity): whether all numbers are exact, and the lesser similarity of street and suburb to words or pairs of words."""
    numbers, names = _address_words(normalise_address(transcript))
    p = {n: _part(address, n) for n in PARTS}
    exact = F.array_contains(numbers, p["number"]) & (
        F.array_contains(numbers, p["postcode"]) | F.contains(F.array_join(numbers, ""), p["postcode"])
    )
    exact = exact & F.when(p["unit"] != "", _in_order(numbers, p["unit"], p["number"])).otherwise(True)
    options = with_pairs(names)
    # Without any word there is nothing to compare.
    best = lambda n: F.when(F.size(options) > 0, best_similarity(options, norm_name(p[n]))).otherwise(0.0)
    return _flags(transcript.isNotNull() & _any_part(address), numbers_exact=exact, similarity=F.least(best("street"), best("suburb")))


def name_score(transcript: Column, record: Column) -> Column:
    """(similarity, same_sound): the best similarity of a candidate, and whether one of more than a letter sounds the same."""
    options, code = name_candidates(transcript), soundex(record)
    sounds = F.exists(options, lambda c: (F.length(c) > 1) & (soundex(c) == code))
    return _flags(_known(transcript, record), similarity=best_similarity(options, norm_name(record)), same_sound=sounds)


def email_score(transcript: Column, record: Column) -> Column:
    return window_sim(normalise_email(transcript), F.lower(record))


def spelled_score(transcript: Column, record: Column) -> Column:
    return window_sim(spelled(transcript), norm_name(record))


def norm_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def soundex(name: Column) -> Column:
    """The sound code of a name; '' where it has no letters."""
    plain = norm_name(name)
    return F.when(plain == "", F.lit("")).otherwise(F.soundex(plain))


def name_tokens(transcript: Column) -> Column:
    """The words of a text as names: letters only, those without any left out."""
    return F.filter(F.transform(F.split(transcript, r"(?U)[\s,.;:!?]+"), norm_name), lambda t: t != "")


def with_pairs(tokens: Column) -> Column:
    """Words, and adjacent ones joined, as a name may be split."""
    following = F.slice(tokens, 2, F.greatest(F.lit(1), F.size(tokens)))
    joined = F.filter(F.zip_with(tokens, following, lambda a, b: F.concat(a, b)), lambda t: t.isNotNull())
    return F.concat(tokens, joined)


def name_candidates(transcript: Column) -> Column:
    """Words of a transcript and pairs of adjacent ones joined."""
    return with_pairs(name_tokens(transcript))


def stable_uuid(*parts: Column) -> Column:
    """md5 of the parts joined by a colon, written as a UUID."""
    digest = F.md5(F.concat_ws(":", *parts))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *(F.substring(digest, at, n) for at, n in cuts))


def short_hash(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def tolerant_timestamp(text: Column) -> Column:
    """A timestamp from ISO text that may carry an offset and a Z besides it; NULL if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2}:?\d{2})Z$", "$1"))


def pair_key(service: Column, model: Column, sample: Column) -> Column:
    return F.concat_ws("|", service, F.coalesce(model, F.lit("")), sample)


def parse_judge(spec: Column) -> Column:
    """'model:effort' as struct (model, effort); effort 'none' is NULL; NULL where the effort is missing."""
    model, effort = F.substring_index(spec, ":", 1), F.substring_index(spec, ":", -1)
    whole = F.struct(model.alias("model"), F.nullif(effort, F.lit("none")).alias("effort"))
    return F.when(F.contains(spec, F.lit(":")) & (effort != ""), whole)


def recording_id(original: Column) -> Column:
    """The id of a real-voice recording of an item: "real_" goes before the id, after the prefix of a full-flow clip."""
    return F.regexp_replace(original, "^(flow_spelled_|flow_dob_|)", "$1real_")


def hint_terms(condition: Column, generic: list[str], record: Column) -> Column:
    """What a recogniser is told in advance: nothing, a generic list, or what the record holds (empty parts left out)."""
    parts = F.array(*(record[k] for k in ("given", "surname", "email", "street", "suburb")))
    held = F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return F.when(condition == "record", held).when(condition == "generic", F.array(*map(F.lit, generic))).otherwise(none)
