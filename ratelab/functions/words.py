"""Word-level edit distance and word error rate, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelab.functions.binding import bind
from ratelab.functions.text import normalize_tokens

# Words become Unicode code points, so the built-in levenshtein, which counts code points, counts
# words. The points from SURROGATES on are reserved for 0x800 places and skipped.
SURROGATES, SKIPPED, CODES = 0xD800, 0x800, 0x110000 - 0x800 - 1


# Distances are first sought below START, then below WIDER times as much, and so on.
START, WIDER = 64, 2
# Words are numbered by hashes first; that a pair's hashes are all different is checked.
SEEDS = (0, 1)


def _place(ordered: Column, word: Column) -> Column:
    """Where a word stands in a sorted array that holds it, counted from 1, by halving."""
    steps = F.sequence(F.ceil(F.log2(F.size(ordered))).cast("int"), F.lit(0), F.lit(-1))

    def closer(at: Column, power: Column) -> Column:
        ahead = at + F.pow(F.lit(2), power).cast("int")
        return F.when(F.get(ordered, ahead) <= word, ahead).otherwise(at)

    return F.aggregate(steps, F.lit(0), closer) + 1


def _hashed(word: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(word, F.lit(seed)), F.lit(CODES)).cast("int") + 1


def _text(places: Column) -> Column:
    """Places from 1 on as the code points of a text."""
    points = F.transform(places, lambda p: F.lpad(F.hex(F.when(p < SURROGATES, p).otherwise(p + SKIPPED)), 8, "0"))
    return F.decode(F.unhex(F.array_join(points, "")), "UTF-32")


def _coded(w: Column) -> Column:
    """Both word arrays as texts in which equal words, and only those, are the same character."""

    def by(place: Callable[[Column], Column]) -> Column:
        return F.struct(_text(F.transform(w["ref"], place)).alias("ref"), _text(F.transform(w["hyp"], place)).alias("hyp"))

    def ranked(ordered: Column) -> Column:
        too_many = F.raise_error(F.lit(f"more than {CODES} distinct words in a pair of texts"))
        return by(lambda word: F.when(F.size(ordered) <= CODES, _place(ordered, word)).otherwise(too_many.cast("int")))

    coded = bind(F.array_sort(w["distinct"]), ranked)
    for seed in reversed(SEEDS):
        apart = F.size(F.array_distinct(F.transform(w["distinct"], lambda word: _hashed(word, seed)))) == F.size(w["distinct"])
        coded = F.when(apart, by(lambda word: _hashed(word, seed))).otherwise(coded)
    return coded


def _distance(t: Column) -> Column:
    """The built-in distance within a band around the diagonal that widens until the distance fits in."""
    longer = F.greatest(F.length(t["ref"]), F.length(t["hyp"]))
    apart = F.abs(F.length(t["ref"]) - F.length(t["hyp"]))
    widths = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.least(longer, apart + START * F.pow(F.lit(WIDER), k)).cast("int"))

    def wider(found: Column, width: Column) -> Column:
        return F.when(found >= 0, found).otherwise(F.call_function("levenshtein", t["ref"], t["hyp"], width))

    return F.aggregate(widths, F.lit(-1), wider)


def token_edit_distance(ref: Column, hyp: Column) -> Column:
    """Insertions, deletions and substitutions of words that turn one word array into the other.

    The time goes with the words times the distance. A pair with more distinct words than Unicode has code points
    fails with a message.
    """
    return bind(
        F.struct(ref.alias("ref"), hyp.alias("hyp"), F.array_union(ref, hyp).alias("distinct")),
        lambda w: bind(_coded(w), _distance),
    )


def word_error_rate(ref_words: Column, hyp_words: Column) -> Column:
    """Struct of wer, edit_ops, ref_words and hyp_words; zero rate and ops when the reference is empty."""

    def rate(w: Column) -> Column:
        n = F.size(w["ref"])
        return F.struct(
            F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(w["ops"].cast("double"), n)).alias("wer"),
            F.when(n == 0, F.lit(0)).otherwise(w["ops"]).alias("edit_ops"),
            n.alias("ref_words"),
            F.size(w["hyp"]).alias("hyp_words"),
        )

    def with_ops(w: Column) -> Column:
        ops = token_edit_distance(w["ref"], w["hyp"])
        return bind(F.struct(w["ref"].alias("ref"), w["hyp"].alias("hyp"), ops.alias("ops")), rate)

    return bind(F.struct(ref_words.alias("ref"), hyp_words.alias("hyp")), with_ops)


def text_error_rate(reference: Column, hypothesis: Column) -> Column:
    return word_error_rate(normalize_tokens(reference), normalize_tokens(hypothesis))
