"""Text expressions: ratings, labels, tokens, model replies, keys and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelab import constants as C

# The rating pattern, the reasoning tags, and what a spoken word loses.
LABELLED_RATING = r"(?i)rating\"?\s*[:=]\s*([0-9])"
THINK_BODY = r"(?s)<think>(.*?)</think>"
THINK_END = "</think>"
WORD_NOISE = r"(?s)[-–—].*|[^a-zA-Z']"
# End of fixed values.


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends; the built-in trim drops spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rating_in_range(c: Column, low: int = C.RATING_LOW, high: int = C.RATING_HIGH) -> Column:
    """The last run of digits whose value lies in [low, high]; null when there is none."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), 1), lambda d: d.try_cast("int"))
    return F.try_element_at(F.filter(runs, lambda v: v.between(low, high)), F.lit(-1))


def rating_labelled(c: Column) -> Column:
    """A reply that is one digit is its rating; otherwise the first digit after a `rating` label."""
    s = strip(c)
    labelled = F.regexp_extract(s, LABELLED_RATING, 1)
    return F.when(s.rlike("^[0-9]$"), s).when(labelled != "", labelled).cast("int")


def canonical_group(c: Column, groups: list[str] = C.ACCENTS) -> Column:
    """The first listed group named anywhere in a free-text label, whatever the case."""
    text = F.lower(c)
    out = F.lit(None).cast("string")
    for g in reversed(groups):
        out = F.when(text.contains(g.lower()), g).otherwise(out)
    return out


def normalize_tokens(c: Column) -> Column:
    """Lower-case words of a to z; every other character separates words."""
    return F.filter(F.split(F.lower(c), "[^a-z]+"), lambda t: t != "")


def remove_fillers(c: Column, fillers: list[str] = C.FILLER_WORDS) -> Column:
    """The normalized text without filler words."""
    return F.array_join(F.filter(normalize_tokens(c), lambda t: ~t.isin(fillers)), " ")


def script_words(c: Column) -> Column:
    """Distinct lower-case words of a script: hyphen and em dash separate, other marks vanish."""
    text = F.regexp_replace(F.regexp_replace(c, "[—-]", " "), "[^a-zA-Z' ]", "")
    return F.array_distinct(F.filter(F.split(F.lower(text), " +"), lambda t: t != ""))


def normalize_word(c: Column) -> Column:
    """The part of a spoken word before the first hyphen or dash, letters and apostrophes only."""
    return F.lower(F.regexp_replace(c, WORD_NOISE, ""))


def answer_text(c: Column) -> Column:
    """What follows the last closing reasoning tag; empty when there is no tag."""
    return F.when(c.contains(THINK_END), strip(F.substring_index(c, THINK_END, -1))).otherwise("")


def think_text(c: Column) -> Column:
    """All reasoning passages, each stripped, joined without a separator."""
    bodies = F.regexp_extract_all(c, F.lit(THINK_BODY), 1)
    return F.coalesce(F.array_join(F.transform(bodies, strip), ""), F.lit(""))


def flatten_breaks(c: Column, drop_returns: bool = True) -> Column:
    """One line: strip, line feeds to spaces, carriage returns dropped (or left in a transcript)."""
    return F.translate(strip(c), "\n\r" if drop_returns else "\n", " ")


def is_rate_limited(c: Column) -> Column:
    text = F.lower(c)
    hit = F.lit(False)
    for marker in C.RATE_LIMIT_MARKERS:
        hit = hit | text.contains(marker)
    return F.coalesce(hit, F.lit(False))


def reply_status(c: Column, error_prefix: str = C.ERROR_PREFIX) -> Column:
    """Class of a flattened model reply: empty, rate_limited, error or ok."""
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(is_rate_limited(c), "rate_limited")
        .when(c.startswith(error_prefix), "error")
        .otherwise("ok")
    )


def is_valid_output(c: Column, error_prefix: str | None = C.ERROR_PREFIX) -> Column:
    """Whether a stored output counts as finished work."""
    ok = c.isNotNull() & ~c.isin(C.FAILED, "")
    return ok if error_prefix is None else ok & ~c.startswith(error_prefix)


def title_label(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.split(c, r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 2**31 - 1)))),
        "",
    )


def safe_key(c: Column) -> Column:
    """Lower-case key in which anything but letters, digits and underscore is an underscore."""
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9_]", "_"))


def underscore_key(c: Column, lower: bool = False) -> Column:
    """Key with underscores for spaces, optionally lower-cased."""
    return F.replace(F.lower(c) if lower else c, F.lit(" "), F.lit("_"))


def corpus_path(category: Column, speaker: Column) -> Column:
    """Path of a recording: `category/prefix - speaker.wav`."""
    prefix = F.coalesce(map_value(category, C.CORPUS_PREFIXES), F.substring(category, 1, 2))
    return F.concat(category, F.lit("/"), prefix, F.lit(" - "), F.coalesce(speaker, F.lit("")), F.lit(".wav"))


def join_path(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def name_field(c: Column, position: int) -> Column:
    """One field of an underscore-delimited name, counted from 1, or from the end when negative."""
    return F.split_part(c, F.lit("_"), F.lit(position))


def strip_piece(c: Column, piece: str) -> Column:
    return F.replace(c, F.lit(piece), F.lit(""))


def short_label(c: Column, length: int = 40) -> Column:
    return F.substring(c, 1, length)


def contains_ignoring_case(c: Column, piece: str) -> Column:
    """Substring test in which a missing text does not contain the piece."""
    return F.coalesce(F.lower(c).contains(piece.lower()), F.lit(False))


def map_value(c: Column, table: dict[str, str]) -> Column:
    """Value of a short fixed table, null for other keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def map_or_keep(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(map_value(c, table), c)


def map_or_default(c: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(map_value(c, table), F.lit(default))
