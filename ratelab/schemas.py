"""Explicit schemas of the files and tables the jobs read. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from ratelab import constants as C


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


METADATA = _strings(C.METADATA_COLUMNS)
RATINGS_HUMAN = _strings(
    C.METADATA_COLUMNS + ["prompt_type", "script_type", "prompt", "model_version", "model_output"]
)
CLIP_METADATA = _strings(
    ["file_name", "speaker_name", "gender", "voice_id", "accent", "language", "script_filename",
     "script_text", "category", "script_type", "domain"]
)
# The raw header names category and script_type twice; both copies hold the prompt's values, so the
# first pair keeps the plain name and the second is read by position and dropped.
RATINGS_SYNTHETIC = _strings(
    ["speaker_name", "gender", "voice_id", "accent", "language", "script_filename", "script_text",
     "category", "script_type", "category_1", "script_type_1", "prompt", "prompt_type",
     "model_version", "model_output"]
)
PROMPTS = _strings(["category", "script_type", "prompt"])
SCRIPTS = _strings(["category", "script"])
VOICE_SCRIPTS = _strings(["category", "filename", "script"])
VOICES = _strings(["name", "accent", "language", "gender", "voice_id", "voice type", "notes"])
QUESTIONS = T.StructType(
    [T.StructField("category", T.StringType()), T.StructField("question_number", T.IntegerType()),
     T.StructField("question", T.StringType())]
)
SPEAKERS = _strings(["speaker_id", "accent", "wav"])
RUN_CONFIG = _strings(["source", "script_type", "note", "category", "synthetic_path"])
MANIFEST = T.StructType(
    list(SPEAKERS.fields)
    + [T.StructField("run_config", RUN_CONFIG), T.StructField("speakers", T.ArrayType(SPEAKERS))]
)
TIMESTAMPS = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("start", T.DoubleType()),
     T.StructField("end", T.DoubleType())]
)
# wer is text in the file because a failed row holds a word there.
TRANSCRIPTIONS = _strings(C.TRANSCRIPTION_COLUMNS)
WORD_DISTANCES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("speaker_id", "accent", "word")]
    + [T.StructField("distance", T.DoubleType()), T.StructField("n_ref", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("speaker_dur", "am_dur", "norm_dist", "all_dur")]
)
CLIPS = T.StructType(
    [T.StructField("clip_id", T.StringType()), T.StructField("sampling_rate", T.IntegerType()),
     T.StructField("samples", T.ArrayType(T.ArrayType(T.FloatType())))]
)
FRAMES = T.StructType(
    [T.StructField("speaker_id", T.StringType()), T.StructField("word", T.StringType()),
     T.StructField("layer", T.IntegerType()), T.StructField("n_samples", T.LongType()),
     T.StructField("emb", T.ArrayType(T.ArrayType(T.FloatType())))]
)
