import pytest
from pyspark.sql import functions as F

from ratelab.functions import signal


def test_mixdown_and_first_channel(values):
    stereo = [[1.0, 3.0], [-2.0, 0.0]]
    assert values("array<array<float>>", [stereo], signal.mixdown) == [[2.0, -1.0]]
    assert values("array<array<float>>", [stereo], signal.first_channel) == [[1.0, -2.0]]
    assert values("array<array<float>>", [[[1.0, 2.0], [-1.0, -2.0]]], lambda c: signal.truncate(signal.mixdown(c))) == [[1, -1]]


def test_quantize_clips_and_truncates(values):
    # a half is 16383.5 steps, 0.99999 is 32766.67; both ends of the range hold
    clip = {0.0: 0, 0.5: 16383, 1.0: 32767, 1.5: 32767, -1.0: -32767, -2.0: -32768, 0.99999: 32766}
    assert values("array<float>", [list(clip)], signal.quantize) == [list(clip.values())]


def test_resample_by_hand(spark):
    cases = [
        ([0.0, 10.0, 20.0], 8000, [0.0, 6.0, 12.0, 18.0, 20.0, 20.0]),  # six places, 0.6 samples apart, held at the end
        ([0.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0], 22050, [0.0, 3.5, 12.0, 40.0, 64.0]),  # five places, 1.75 apart
        ([3.0, 1.0, 4.0, 7.0], 32000, [3.0, 7.0]), ([1.5], 8000, [1.5, 1.5]), ([9.0, 8.0], 44100, []),
        ([5.0, 1.0, 5.0], 16000, [5.0, 1.0, 5.0]),  # already at the target rate
    ]
    df = spark.createDataFrame([(i, x, r) for i, (x, r, _) in enumerate(cases)], "i int, x array<double>, r int")
    rows = df.orderBy("i").select(signal.resample(F.col("x"), F.col("r")).alias("y")).collect()
    for (_, _, want), row in zip(cases, rows):
        assert row.y == pytest.approx(want, abs=1e-12)


def test_resample_of_a_ramp_tells_the_places(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(440)), lambda k: k.cast("double")).alias("x"))
    got = df.select(signal.resample(F.col("x"), F.lit(44100))).first()[0]
    assert len(got) == 160  # 441 samples of 44,100 a second last as long as 160 of 16,000
    assert got == pytest.approx([min(440.0, 441 * i / 159) for i in range(160)], abs=1e-9)


def test_crop_past_the_end(spark):
    df = spark.createDataFrame([(list(range(20)),)], "x array<int>")

    def cut(start, end):
        return df.select(signal.crop(F.col("x"), F.lit(start), F.lit(end), F.lit(10))).first()[0]

    x = list(range(20))
    assert cut(0.25, 0.79) == x[2:7]
    assert cut(1.5, 9.0) == x[15:]
    assert cut(3.0, 4.0) == []
    assert cut(1.0, 0.5) == []


def test_minimum_length(values):
    assert values("array<int>", [[0] * 399, [0] * 400], signal.long_enough) == [False, True]
