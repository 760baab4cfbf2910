"""Word counts, error weights and word error rates as Column expressions.

All functions map Columns to Columns and stay in the JVM. NULL text counts as empty unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters around a word that do not belong to it, contractions that stand for two words, and what the
# endings of contractions may be written out as.
EDGE_MARKS = '.,!?;:"()[]{}…'
EDGE_MARKS_AND_QUOTE = EDGE_MARKS + "'"
CONTRACTION_ENDINGS = ("n't", "'m", "'re", "'ve", "'ll", "'d")
IS_STEMS = ("it", "that", "what", "there", "here", "he", "she", "who", "where", "how", "when", "why", "let")
ENDING_WORDS = {
    "'s": ("is", "has"),
    "'m": ("am",),
    "'re": ("are",),
    "'ve": ("have",),
    "'ll": ("will",),
    "'d": ("would", "had"),
    "n't": ("not",),
}
ERROR_TYPES = ("substitution", "deletion", "insertion")

_ANY_SPACE = r"(?U)\s+"
_SPACE_OR_HYPHEN = r"(?U)[\s\-]+"
_MARKS = r"[.,!?;:\"()\[\]{}…]*"
#: From the first letter or digit of a token to its end: one match for each token that has one.
_WORD = r"(?U)[\p{L}\p{N}]\S*"
#: A token that, without its edge marks, ends like a contraction of two words, or is one with "is".
_TWO_WORDS = (
    rf"(?U)(?:(?:{'|'.join(CONTRACTION_ENDINGS)})|(?:(?<=\s)|^){_MARKS}(?:{'|'.join(IS_STEMS)})'s){_MARKS}(?=\s|$)"
)


def _lowered(text: Column) -> Column:
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("’"), F.lit("'"))


def plain_words(text: Column) -> Column:
    """The words of a text: lower case, split at white space, without edge marks; tokens of marks only are dropped."""
    tokens = F.transform(F.split(_lowered(text), _ANY_SPACE), lambda t: F.btrim(t, F.lit(EDGE_MARKS)))
    return F.filter(tokens, lambda t: t.rlike(r"[\p{L}\p{N}]"))


def count_words(text: Column) -> Column:
    """Words of a reference: contractions count as the two words they stand for, compounds and numbers as one.

    The same words as ``plain_words``, counted by two scans of the text without taking it apart.
    """
    lowered = _lowered(text)
    return F.regexp_count(lowered, F.lit(_WORD)) + F.regexp_count(lowered, F.lit(_TWO_WORDS))


def error_weight(kind: Column, reference: Column, hypothesis: Column) -> Column:
    """How many errors an entry counts for: its words when dropped or added, or when it replaces several by several."""
    said, heard = count_words(reference), count_words(hypothesis)
    return (
        F.when(kind == "deletion", F.greatest(said, F.lit(1)))
        .when(kind == "insertion", F.greatest(heard, F.lit(1)))
        .when(F.least(said, heard) <= 1, F.lit(1))
        .otherwise(said)
    )


def vocabulary(hypothesis: Column) -> Column:
    """The words of a hypothesis and the forms a judge may have normalised them to."""
    tokens = F.transform(
        F.split(_lowered(hypothesis), _SPACE_OR_HYPHEN), lambda t: F.btrim(t, F.lit(EDGE_MARKS_AND_QUOTE))
    )

    def forms(token: Column) -> Column:
        nothing = F.array().cast("array<string>")
        parts = [F.array(token)]
        for ending, words in ENDING_WORDS.items():
            stem = F.substring(token, F.lit(1), F.length(token) - len(ending))
            parts.append(F.when(F.endswith(token, F.lit(ending)), F.array(stem, *map(F.lit, words))).otherwise(nothing))
        return F.concat(*parts)

    return F.array_distinct(F.flatten(F.transform(tokens, forms)))


def invented_insertions(errors: Column, hypothesis: Column) -> Column:
    """Whether at least three, and more than half, of the inserted words do not stand in the hypothesis.

    ``errors`` is an array of structs with type and hypothesis; numbers count as inserted but never as missing. An
    empty or NULL list has none.
    """
    inserted_entries = F.filter(errors, lambda e: e["type"] == "insertion")
    words = F.flatten(
        F.transform(
            inserted_entries,
            lambda e: F.filter(
                F.split(F.lower(F.coalesce(e["hypothesis"], F.lit(""))), _ANY_SPACE), lambda w: w != ""
            ),
        )
    )
    stripped = F.transform(words, lambda w: F.btrim(w, F.lit(EDGE_MARKS_AND_QUOTE)))
    known = vocabulary(hypothesis)
    missing = F.size(
        F.filter(stripped, lambda w: (w != "") & ~w.rlike(r"^\p{Nd}+$") & ~F.array_contains(known, w))
    )
    return F.coalesce((missing >= 3) & (missing * 2 > F.size(stripped)), F.lit(False))


def errors_valid(errors: Column) -> Column:
    """Whether a judge's list is one: not NULL, and every entry has a known type."""
    known = F.forall(errors, lambda e: F.coalesce(e["type"].isin(*ERROR_TYPES), F.lit(False)))
    return errors.isNotNull() & F.coalesce(known, F.lit(False))


def weighted_count(errors: Column, kind: str) -> Column:
    """The weighted number of errors of one type in an array of structs (type, reference, hypothesis)."""
    return F.aggregate(
        F.filter(errors, lambda e: e["type"] == kind),
        F.lit(0),
        lambda total, e: total + error_weight(e["type"], e["reference"], e["hypothesis"]),
    )


def word_error_rate(substitutions: Column, deletions: Column, insertions: Column, reference_words: Column) -> Column:
    """Errors over reference words; without reference words 0 if there are no errors, else infinite."""
    errors = substitutions + deletions + insertions
    return (
        F.when((reference_words == 0) & (errors == 0), F.lit(0.0))
        .when(reference_words == 0, F.lit(float("inf")))
        .otherwise(errors.cast("double") / F.nullif(reference_words, F.lit(0)))
    )


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, _ANY_SPACE, " ")), F.lit("")) == ""


def blank_case(reference: Column, hypothesis: Column) -> Column:
    """The score where a side is blank, as struct (wer, substitutions, deletions, insertions, reference_words); else NULL."""
    spoken = F.size(F.filter(F.split(F.coalesce(hypothesis, F.lit("")), _ANY_SPACE), lambda w: w != ""))

    def score(wer: float, deleted: Column, inserted: Column, words: Column) -> Column:
        return F.struct(
            F.lit(wer).alias("wer"), F.lit(0).alias("substitutions"), deleted.alias("deletions"),
            inserted.alias("insertions"), words.alias("reference_words"),
        )

    zero, words = F.lit(0), count_words(reference)
    return (
        F.when(_blank(reference) & _blank(hypothesis), score(0.0, zero, zero, zero))
        .when(_blank(reference), score(float("inf"), zero, spoken, zero))
        .when(_blank(hypothesis), score(1.0, words, zero, words))
    )


def errors_text(errors: Column, fields: list[str]) -> Column:
    """A judge's errors on one line, 'none' without any; ``fields`` are its structs' field names, of either scheme."""

    def either(entry: Column, default: str, *names: str) -> Column:
        return F.coalesce(*(F.nullif(entry[n], F.lit("")) for n in names if n in fields), F.lit(default))

    def render(e: Column) -> Column:
        kind, said = either(e, "?", "error_type", "type"), either(e, "∅", "reference_word", "reference")
        return F.format_string("%s: %s → %s", kind, said, either(e, "∅", "hypothesis_word", "hypothesis"))

    return F.coalesce(F.nullif(F.array_join(F.transform(errors, render), "; "), F.lit("")), F.lit("none"))
