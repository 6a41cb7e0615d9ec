import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ratelab import constants as C
from ratelab.functions import text as X


def test_last_rating_in_range(values):
    cases = {
        "Rating: 5": 5, "5/7": 7, "6.5": 5, "10": None, "05": 5, "FAILED": None, None: None,
        "12345678901234567890": None, "first 3, then 9": 3, "0": None, "7 of 70": 7, "": None,
    }
    assert values("string", list(cases), X.rating_in_range) == list(cases.values())
    assert values("string", ["1 of 10", "11"], lambda c: X.rating_in_range(c, 0, 10)) == [10, None]


def test_labelled_rating(values):
    cases = {
        "4": 4, "rating=3": 3, '"Rating" : 6': 6, "Rating: 10": 1, "Rating: **5**": None, "9": 9, None: None,
        " 2\n": 2, "RATING:7 and rating: 1": 7, "rated 5": None, "": None, "44": None,
    }
    assert values("string", list(cases), X.rating_labelled) == list(cases.values())


def test_canonical_group_follows_list_order(values):
    cases = {
        "American English": "American", " nigerian ": "Nigerian", "Indian American": "American", "French": None,
        None: None, "british-chinese": "British",
    }
    assert values("string", list(cases), X.canonical_group) == list(cases.values())


def test_tokens_and_fillers(values):
    assert values("string", ["It's 3 o'clock—um, OK?", "", "Uh", "naïve"], X.normalize_tokens) == [
        ["it", "s", "o", "clock", "um", "ok"], [], ["uh"], ["na", "ve"],
    ]
    assert values("string", ["Um, the the uh end", "um"], X.remove_fillers) == ["the the end", ""]


def test_script_words_keep_apostrophes_and_ignore_line_breaks(values):
    script = "I've a detail-oriented plan—really, heads–up\nnow"
    got = values("string", [script], X.script_words)[0]
    assert sorted(got) == sorted({"i've", "a", "detail", "oriented", "plan", "really", "headsupnow"})


def test_normalize_word(values):
    cases = {
        "detail-oriented": "detail", "heads–up": "heads", "'Pay": "'pay", "—": "", "a—b": "a", "(Yes),": "yes",
        "x\n-y": "x", "": "", "R2D2": "rd",
    }
    assert values("string", list(cases), X.normalize_word) == list(cases.values())


def test_reasoning_passages(values):
    replies = ["<think> a\nb </think> yes <think>c</think>\n no ", "no tags", None, "<think>open", "x</think>"]
    assert values("string", replies, X.answer_text) == ["no", "", "", "", ""]
    assert values("string", replies, X.think_text) == ["a\nbc", "", "", "", ""]


def test_flatten(values):
    assert values("string", [" a\r\nb\n", "\tc", None], X.flatten_breaks) == ["a b", "c", None]


def test_reply_status_and_validity(values):
    replies = ["ok then", "", None, "Error analyzing: x", "HTTP 429", "Too Many Requests", "Error analyzing: quota", "FAILED"]
    assert values("string", replies, X.reply_status) == [
        "ok", "empty", "empty", "error", "rate_limited", "rate_limited", "rate_limited", "ok",
    ]
    assert values("string", replies, lambda c: F.coalesce(X.is_valid_output(c), F.lit(False))) == [
        True, False, False, False, True, True, False, False,
    ]


@pytest.mark.parametrize("marker", C.RATE_LIMIT_MARKERS)
def test_every_rate_limit_marker(values, marker):
    assert values("string", [f"oops {marker.upper()}!"], X.is_rate_limited) == [True]


def test_title_label_matches_python(values):
    labels = ["personal-introduction", "they're 2nd a_b", "ÉCOLE x", "", "already-Title"]
    assert values("string", labels, X.title_label) == [s.title() for s in labels]


def test_keys_and_paths(spark, values):
    assert values("string", ["Chinedu Dike", "Ziyu ", "É!"], X.safe_key) == ["chinedu_dike", "ziyu_", "__"]
    assert values("string", ["Chinedu Dike", "Ziyu "], X.underscore_key) == ["Chinedu_Dike", "Ziyu_"]
    assert values("string", ["Ololade Awaye"], lambda c: X.map_or_keep(X.underscore_key(c, True), C.SYNTHETIC_NAME_FIXES)) == ["ololade"]
    rows = spark.createDataFrame([("client-disagreement", "Ann"), ("other-topic", None)], "c string, s string")
    assert [r[0] for r in rows.select(X.corpus_path(F.col("c"), F.col("s"))).collect()] == [
        "client-disagreement/cd - Ann.wav", "other-topic/ot - .wav",
    ]
    assert values("string", ["bio_conceptual_fluent"], lambda c: F.array(X.name_field(c, 2), X.name_field(c, -1))) == [
        ["conceptual", "fluent"]
    ]
    assert values("string", ["critical_v2"], lambda c: X.strip_piece(c, "_v2")) == ["critical"]
    assert values("string", ["x" * 50], X.short_label) == ["x" * 40]
    assert values("string", ["a/UNSCRIPTED.wav", "b", None], lambda c: X.contains_ignoring_case(c, "unscripted")) == [
        True, False, False,
    ]
    assert values("string", ["strong", "zebra"], lambda c: X.map_or_default(c, C.FEATURE_BY_WORD, "Other")) == [
        "Consonant cluster", "Other",
    ]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab7 09.,:\n", max_size=12), min_size=20, max_size=40))
def test_ratings_against_plain_python(texts):
    from ratelab.session import local_session

    spark = local_session(8)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").orderBy("i")
    got = [r[0] for r in df.select(X.rating_in_range(F.col("v"))).collect()]
    want = []
    for t in texts:
        runs = [int(d) for d in re.findall("[0-9]+", t)]
        runs = [d for d in runs if 1 <= d <= 7]
        want.append(runs[-1] if runs else None)
    assert got == want
