import corpus_pipeline
from pyspark.sql import functions as F

from ratelab.llm import bpe, decontaminate, queries, simhash, surrogates, toxicity


def test_stages_against_their_operators(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "byte_level_bpe"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, folder).cache()
        kept[name] = now
        rows = {r.doc_id: r for r in before.collect()}
        if name == "toxicity":
            model = toxicity.train(toxicity.labelled_sample(docs, spark.read.parquet(f"{folder}/labels.parquet")))
            assert {r.doc_id for r in now.collect()} == {d for d, r in rows.items() if model.score(r.text) < toxicity.THRESHOLD}
        elif name == "near_duplicates":
            groups = simhash.near_duplicates(before).groupBy("component_id").agg(F.min("doc_id").alias("d")).collect()
            assert sorted(r.doc_id for r in now.collect()) == sorted(r.d for r in groups) and now.count() < before.count()
        elif name == "decontamination":
            found = decontaminate.find_windows(before, spark.read.parquet(f"{folder}/benchmark.parquet"))
            bad = {r.doc_id for r in found.where(decontaminate.contaminated()).collect()}
            assert bad and {r.doc_id for r in now.collect()} == set(rows) - bad
        elif name == "personal_data":
            after = {r.doc_id: r.text for r in now.collect()}
            touched = {r.doc_id for r in before.where(surrogates.has_mention(F.col("text"))).collect()}
            assert set(after) == set(rows) and all((after[d] != r.text) == (d in touched) for d, r in rows.items())
        else:
            encoder = queries.bpe_vocabulary().encoder()
            assert {r.doc_id: r.n_tokens for r in now.collect()} == {d: len(encoder.encode_ordinary(r.text)) for d, r in rows.items()}
        if name != "byte_level_bpe":
            assert now.columns == columns
    assert bpe.OUT_TOKENS and sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, kept["byte_level_bpe"].collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, row int, text_hash long"


def test_odd_rows_pass_every_stage(spark):
    """Nulls, empty texts, repeated rows and clashing columns; what each stage keeps is stated in its docstring."""
    folder = "/root/testdata/sf0.001"
    long_text = "und die Zeit " * 30_000
    rows = [(900_001, None, "en", "s", 0), (900_002, "", None, None, None), (None, "mail me at a.b@c.org today", "en", "s", 1), (None, "mail me at a.b@c.org today", "en", "s", 1),
            (900_003, long_text, "de", "s", 2), (900_004, "one two three four five six", "en", "s", 3), (900_004, "one two three four five six", "en", "s", 3)]
    now = spark.createDataFrame([(*r, 0.5, "f", 1, 7) for r in rows], SCHEMA)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder).cache()
        counts.append(now.count())
        if name != "byte_level_bpe":
            assert now.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        if name == "near_duplicates":
            # of the texts without words the smallest id stays, of equal rows one
            assert sorted(map(str, (r.doc_id for r in now.collect()))) == ["900001", "900003", "900004", "None"]
        if name == "personal_data":
            texts = {r.doc_id: r.text for r in now.collect()}
            assert texts[900_001] is None and texts[900_003] == long_text and "a.b@c.org" not in texts[None]
    assert counts == [7, 4, 4, 4, 4]
    assert {r.doc_id: r.n_tokens for r in now.collect()}[900_001] == 0


def test_empty_table_passes_every_stage(spark):
    now = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "/root/testdata/sf0.001")
        assert now.count() == 0
