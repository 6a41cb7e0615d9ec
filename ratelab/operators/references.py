"""Distance of every spoken word to the reference speakers' utterances of it, the speaker left out.

Every target meets every reference utterance of the same word, so the work per word is the product of
the two counts. The product is laid out as a grid of cells: targets are spread over one side and
references over the other by hash, and a cell holds about TARGETS_PER_CELL x REFERENCES_PER_CELL
utterances. A word with a third of all rows becomes many cells; each cell is one bounded task that
returns one partial sum per target, so pairs never leave it. An utterance is sent to every cell of its row
or column, so beyond CELLS_PER_WORD cells the cells of a word grow instead of their number, as far as the
utterances of one side (SIDE_TOKENS) and their values (SIDE_VALUES) stay bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelab import constants as C
from ratelab.functions.align import dtw_block
from ratelab.functions.numeric import normalized_distance
from ratelab.operators.sizing import attach, fan_out
from ratelab.session import settle

TARGETS_PER_CELL = 128
REFERENCES_PER_CELL = 128
CELLS_PER_WORD = 64
SIDE_TOKENS = 4096
SIDE_VALUES = 4 << 20


def durations(timestamps: DataFrame) -> DataFrame:
    return timestamps.withColumn("dur", F.col("end") - F.col("start"))


def reference_durations(words: DataFrame, keys: Sequence[str] = ("word",),
                        reference: str = C.REFERENCE_ACCENT) -> DataFrame:
    """Mean duration of each word over the reference speakers, too short segments included."""
    return words.where(F.col("accent") == reference).groupBy(*keys).agg(F.avg("dur").alias("am_dur"))


def overall_durations(timestamps: DataFrame, keys: Sequence[str] = ("word",)) -> DataFrame:
    """Mean duration of each word over all speakers and all its occurrences."""
    return durations(timestamps).groupBy(*keys).agg(F.avg("dur").alias("all_dur"))


def reference_pool(tokens: DataFrame, keys: Sequence[str], speaker: str = "speaker_id", accent: str = "accent",
                   reference: str = C.REFERENCE_ACCENT, measures: Sequence[str] = ()) -> DataFrame:
    """Size of every target's reference pool, and the pool mean of each measure, the target left out.

    Totals per word less the target's own share give the same as going over the pool. Expects one row
    per key and speaker. Targets with an empty pool are dropped; a pool mean is taken over the values that
    are there and is null where there are none.
    """
    is_ref = F.col(accent) == reference
    totals = tokens.where(is_ref).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pool_n"), *[F.sum(m).alias(f"{m}_pool") for m in measures],
        *[F.count(m).alias(f"{m}_known") for m in measures],
    )
    own = F.when(is_ref, 1).otherwise(0)
    n = F.col("pool_n") - own
    return (
        attach(tokens, totals, keys, "inner")
        .where(n > 0)
        .select(
            *keys, speaker, accent, n.alias("n_ref"),
            *[F.try_divide(
                F.coalesce(f"{m}_pool", F.lit(0)) - F.coalesce(own * F.col(m), F.lit(0)),
                F.col(f"{m}_known") - F.when(is_ref & F.col(m).isNotNull(), 1).otherwise(0),
            ).alias(f"{m}_ref") for m in measures],
        )
    )


def _cell_sums(keys: list[str], cell: pd.DataFrame) -> pd.DataFrame:
    """Sum and number of defined alignment costs per target of one cell."""
    target, ref = cell[~cell["pooled"]], cell[cell["pooled"]]
    out = target[[*keys, "speaker_id", "accent"]].copy()
    if target.empty or ref.empty:
        return out.assign(cost=0.0, n=0)
    cost = dtw_block(
        [np.asarray(v, np.float32).reshape(n, -1) for v, n in zip(target["values"], target["frames"])],
        [np.asarray(v, np.float32).reshape(n, -1) for v, n in zip(ref["values"], ref["frames"])],
    )
    cost[target["speaker_id"].to_numpy()[:, None] == ref["speaker_id"].to_numpy()[None, :]] = np.nan
    return out.assign(cost=np.nansum(cost, axis=1), n=np.isfinite(cost).sum(axis=1))


def _cell_grid(census: DataFrame, sized: DataFrame, keys: Sequence[str], is_ref: Column, targets_per_cell: int,
               references_per_cell: int) -> DataFrame:
    """Rows and columns of cells per key, from token counts and the mean number of values of a token. They only steer balance."""
    counts = census.groupBy(*keys).agg(F.count(F.lit(1)).alias("targets"), F.count(F.when(is_ref, 1)).alias("pool"))
    values = sized.groupBy(*keys).agg(F.avg(F.size("emb") * F.size(F.get("emb", F.lit(0)))).alias("values"))
    counts = counts.where(F.col("pool") > 0).join(values, list(keys), "left")
    cells = F.ceil(F.col("targets") / targets_per_cell) * F.ceil(F.col("pool") / references_per_cell)
    growth = F.greatest(F.lit(1.0), F.sqrt(cells / CELLS_PER_WORD))
    room = F.least(F.lit(float(SIDE_TOKENS)), SIDE_VALUES / F.greatest(F.coalesce("values", F.lit(1.0)), F.lit(1.0)))

    def parts(count: str, per_cell: int) -> Column:
        return F.ceil(F.col(count) / F.greatest(F.lit(float(per_cell)), F.least(per_cell * growth, room))).cast("int")

    return counts.select(*keys, parts("targets", targets_per_cell).alias("rows"), parts("pool", references_per_cell).alias("cols"))


def left_out_distances(tokens: DataFrame, keys: Sequence[str] = ("word",), reference: str = C.REFERENCE_ACCENT,
                       targets_per_cell: int = TARGETS_PER_CELL, references_per_cell: int = REFERENCES_PER_CELL,
                       census: DataFrame | None = None, census_keys: Sequence[str] | None = None,
                       sized: DataFrame | None = None) -> DataFrame:
    """Mean alignment cost of every token to the reference pool of its word, and the pool size.

    Expects one row per key and speaker_id with accent and emb (frames of floats). Words without a
    reference, and tokens whose pool is empty, give no row. A census is a lighter table of the same
    tokens, keyed by some of the keys, to count instead of the tokens themselves; sized is a table with their emb, to
    measure instead of them. The cell sizes are the least ones: cells of words with many grow.
    """
    keys = list(keys)
    is_ref = F.col("accent") == reference
    grid_keys = list(census_keys or keys)
    grid = _cell_grid(tokens if census is None else census, tokens if sized is None else sized, grid_keys, is_ref,
                      targets_per_cell, references_per_cell)

    def place(side: str) -> Column:
        return F.pmod(F.xxhash64("speaker_id", F.lit(side)), F.col(side)).cast("int")

    def cell(row: Column, col: Column, pooled: bool) -> Column:
        return F.struct(row.alias("row"), col.alias("col"), F.lit(pooled).alias("pooled"))

    # A token goes to every cell of its own row of the grid as target and, if it is a reference, to
    # every cell of its own column as reference.
    as_target = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: cell(F.col("own_row"), c, False))
    as_pool = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: cell(r, F.col("own_col"), True))
    placed = (
        attach(tokens.where(F.size("emb") > 0), grid, grid_keys, "inner")
        .withColumn("own_row", place("rows"))
        .withColumn("own_col", place("cols"))
        .select(
            *keys, "speaker_id", "accent", F.size("emb").alias("frames"), F.flatten("emb").alias("values"),
            F.explode_outer(F.when(is_ref, F.concat(as_target, as_pool)).otherwise(as_target)).alias("cell"),
        )
        .select(*keys, "cell.*", "speaker_id", "accent", "frames", "values")
    )
    schema = T.StructType(
        [tokens.schema[k] for k in keys]
        + [T.StructField("speaker_id", tokens.schema["speaker_id"].dataType),
           T.StructField("accent", tokens.schema["accent"].dataType),
           T.StructField("cost", T.DoubleType()), T.StructField("n", T.LongType())]
    )

    def sums(one_cell: pd.DataFrame) -> pd.DataFrame:
        return _cell_sums(keys, one_cell)

    cell_keys = [*keys, "row", "col"]
    partial = fan_out(placed, *cell_keys).groupBy(*cell_keys).applyInPandas(sums, schema)
    return (
        partial.groupBy(*keys, "speaker_id", "accent")
        .agg(F.sum("cost").alias("cost"), F.sum("n").alias("n_ref"))
        .where(F.col("n_ref") > 0)
        .select(*keys, "speaker_id", "accent", (F.col("cost") / F.col("n_ref")).alias("distance"), "n_ref")
    )


def word_distances(words: DataFrame, frames: DataFrame, keys: Sequence[str] = ("word",),
                   frame_keys: Sequence[str] | None = None, reference: str = C.REFERENCE_ACCENT,
                   **cells: int) -> DataFrame:
    """The word-distance table: distance, pool size, durations and duration-normalized distance.

    `words` holds one row per keys and speaker_id (the first occurrence) with accent and dur; `frames`
    holds the embeddings of the same tokens, further keyed by frame_keys (layer, say).
    """
    words = settle(words)
    frame_keys = list(frame_keys or keys)
    token_keys = [*keys, "speaker_id"]
    if "n_samples" in frames.columns:
        frames = frames.where(F.col("n_samples") >= C.MIN_SEGMENT_SAMPLES)
    embedded = frames.select(*token_keys, *[k for k in frame_keys if k not in keys], "emb")
    tokens = words.select(*token_keys, "accent").join(embedded, token_keys)
    dist = left_out_distances(tokens, frame_keys, reference, census=words, census_keys=keys, sized=embedded, **cells)
    timed = dist.join(words.select(*token_keys, F.col("dur").alias("speaker_dur")), token_keys)
    norm = normalized_distance(F.col("distance"), F.col("speaker_dur"), F.col("am_dur"))
    return attach(timed, reference_durations(words, keys, reference), keys).select(
        *frame_keys, "speaker_id", "accent", "distance", "n_ref",
        F.round("speaker_dur", 5).alias("speaker_dur"), F.round("am_dur", 5).alias("am_dur"),
        F.round(norm, 7).alias("norm_dist"),
    )
