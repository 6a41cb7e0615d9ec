"""Resumable scoring runs: what is pending, scored by a caller's function, as rows to append.

Recordings themselves are joined in only for pending work. The scoring function gets the named columns
of a row, among them those of `audio`, a table keyed by the clip.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab import constants as C
from ratelab.operators import worklist as W
from ratelab.plans.transcripts import score_transcripts

Score = Callable[[dict], str | None]


def _with_audio(work: DataFrame, audio: DataFrame | None, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Pending work with its recordings; work without a recording is left out.

    Recordings kept in buckets of these keys (writers.write_recordings) are read where they lie; only work travels.
    """
    if audio is None:
        return work, []
    return work.join(audio, list(keys)), [c for c in audio.columns if c not in keys]


def _resumed(work: DataFrame, progress: str | None, keys: Sequence[str]) -> DataFrame:
    return work if progress is None else W.resumed(work, progress, keys)


def rate_corpus(recordings: DataFrame, prompts: DataFrame, results: DataFrame, score: Score, model: str,
                audio: DataFrame | None = None, progress: str | None = None) -> DataFrame:
    """Ratings of human recordings under every prompt of their category; failed calls are kept as failed."""
    work = W.corpus_work(W.corpus_metadata(recordings), prompts)
    keys = ["file_path", "prompt_type", "script_type"]
    work, extra = _with_audio(_resumed(W.pending(work, results, keys), progress, keys), audio, ["file_path"])
    scored = W.score_pending(work, score, ["prompt", "file_path", *extra], leave=extra, spread=audio is None, progress=progress)
    return scored.select(
        *C.METADATA_COLUMNS, "prompt_type", "script_type", "prompt", F.lit(model).alias("model_version"), "model_output"
    )


def rate_synthetic(clips: DataFrame, prompts: DataFrame, results: DataFrame, score: Score, model: str,
                   audio: DataFrame | None = None, progress: str | None = None) -> DataFrame:
    """Ratings of synthetic clips; the prompt's script type wins over the clip's, failed calls leave no row."""
    work = W.pair_with_prompts(clips, prompts)
    keys = ["speaker_name", "script_filename"]
    work = _resumed(W.pending(work, results, [*keys, "prompt_type", "prompt"]), progress, [*keys, "prompt_type", "prompt"])
    work, extra = _with_audio(work, audio, keys)
    scored = W.score_pending(work, score, ["prompt", *keys, *extra], keep_failed=False, leave=extra, spread=audio is None, progress=progress)
    return scored.drop("status").withColumn("model_version", F.lit(model))


def transcribe(manifest: DataFrame, scripts: DataFrame, results: DataFrame, score: Score, model: str,
               audio: DataFrame | None = None, progress: str | None = None) -> DataFrame:
    """Transcripts of the manifest's clips with error rates against the script; failed calls are kept as failed."""
    work = manifest.select(
        "file_path", "category", F.col("name").alias("speaker_id"), F.col("accent_nationality_origin").alias("accent"),
        F.lit(model).alias("model"),
    )
    work = _resumed(W.pending(work, results, ["file_path", "model"], "raw_transcription", None), progress, ["file_path", "model"])
    work, extra = _with_audio(work, audio, ["file_path"])
    scored = W.score_pending(
        work, score, ["file_path", *extra], "raw_transcription", error_prefix=C.TRANSCRIPT_ERROR_PREFIX, drop_returns=False,
        leave=extra, spread=audio is None, progress=progress,
    )
    return score_transcripts(scored.drop("status"), scripts).select(*C.TRANSCRIPTION_COLUMNS, "status")
