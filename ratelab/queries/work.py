"""Work lists, file inputs, lookups and reconciled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab import constants as C
from ratelab.operators import picks
from ratelab.operators import worklist as W
from ratelab.queries.registry import Tables, query
from ratelab.session import settle
from ratelab.sources import readers


def order_clips(t: Tables) -> DataFrame:
    """Orders as clips; the priority is the category."""
    return t("orders").select(
        F.col("o_orderkey").alias("file_path"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("script_type")
    )


def order_prompts(t: Tables) -> DataFrame:
    """One prompt per priority and status, as a prompt file has per category and script type."""
    return t("orders").select(
        F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("script_type"),
        F.concat("o_orderpriority", F.lit(" / "), "o_orderstatus").alias("prompt"),
    ).distinct()


def line_results(t: Tables) -> DataFrame:
    """Line items as stored results of (order, status); flag R marks a failed attempt."""
    flag = F.col("l_returnflag")
    output = F.when(flag == "R", C.FAILED).when(flag == "N", "Error analyzing: no reply").otherwise("Rating: 4")
    return t("lineitem").select(
        F.col("l_orderkey").alias("file_path"), F.col("l_linestatus").alias("script_type"), output.alias("model_output")
    )


WORK = """
prompts AS (SELECT DISTINCT o_orderpriority AS category, o_orderstatus AS script_type,
    o_orderpriority || ' / ' || o_orderstatus AS prompt FROM orders),
done AS (SELECT DISTINCT l_orderkey AS file_path, l_linestatus AS script_type FROM lineitem WHERE l_returnflag = 'A'),
work AS (SELECT o.o_orderkey AS file_path, p.category, o.o_orderstatus AS clip_script_type, p.script_type, p.prompt
    FROM orders o JOIN prompts p ON o.o_orderpriority = p.category)
"""


@query("worklist_pending", f"WITH {WORK} SELECT * FROM work ANTI JOIN done USING (file_path, script_type)")
def worklist_pending(t: Tables) -> DataFrame:
    work = W.pair_with_prompts(order_clips(t), order_prompts(t))
    return W.pending(work, line_results(t), ["file_path", "script_type"])


@query("worklist_progress", f"""WITH {WORK}
SELECT count(*) FILTER (d.file_path IS NOT NULL) AS completed, count(*) FILTER (d.file_path IS NULL) AS remaining
FROM work w LEFT JOIN done d USING (file_path, script_type)
""")
def worklist_progress(t: Tables) -> DataFrame:
    work = W.pair_with_prompts(order_clips(t), order_prompts(t))
    return W.progress(work, line_results(t), ["file_path", "script_type"])


@query("clips_without_prompts", """
SELECT c_custkey AS category, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def clips_without_prompts(t: Tables) -> DataFrame:
    clips = t("customer").select(F.col("c_custkey").alias("category"), "c_name")
    return W.without_prompts(clips, t("orders").select(F.col("o_custkey").alias("category")))


@query("voice_script_cross", """
SELECT c_custkey, c_name, r_name || '.wav' AS script_filename, r_regionkey FROM customer, region
""")
def voice_script_cross(t: Tables) -> DataFrame:
    pairs = W.voice_script_pairs(t("customer").select("c_custkey", "c_name"), t("region").select("r_name", "r_regionkey"))
    return pairs.select("c_custkey", "c_name", F.concat("r_name", F.lit(".wav")).alias("script_filename"), "r_regionkey")


SCORED = """
first_run AS (SELECT doc_id, CASE WHEN n_chars % 5 = 2 THEN 'FAILED' ELSE 'Rating: ' || (length(text) % 7 + 1) END AS model_output
    FROM documents),
second_run AS (SELECT doc_id, 'Rating: ' || (length(text) % 7 + 1) AS model_output FROM documents
    WHERE doc_id IN (SELECT doc_id FROM first_run WHERE model_output = 'FAILED')),
results AS (SELECT 1 AS run, * FROM first_run UNION ALL SELECT 2, * FROM second_run)
"""


@query("batch_score_rerun", f"""WITH {SCORED}
SELECT doc_id, run, model_output, CASE WHEN model_output = 'FAILED' THEN 'error' ELSE 'ok' END AS status FROM results
""")
def batch_score_rerun(t: Tables) -> DataFrame:
    """A first scoring run in which some calls fail, and a second run over what is still pending."""
    work = t("documents").select("doc_id", "n_chars", "text")

    def flaky(row: dict) -> str:
        if row["n_chars"] % 5 == 2:
            raise RuntimeError("no connection")
        return steady(row)

    def steady(row: dict) -> str:
        return f"\nRating: {len(row['text']) % 7 + 1}\r\n"

    columns = ["n_chars", "text"]
    first = settle(W.score_pending(work, flaky, columns).withColumn("run", F.lit(1)))
    again = W.pending(work, first, ["doc_id"])
    second = W.score_pending(again, steady, columns).withColumn("run", F.lit(2))
    return first.unionByName(second).select("doc_id", "run", "model_output", "status")


@query("latest_valid_result", """
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY event_type <> 'error' DESC, ts DESC, event_id DESC) AS k FROM events) WHERE k = 1
""")
def latest_valid_result(t: Tables) -> DataFrame:
    events = t("events").select("user_id", "event_id", "event_type", "value", "ts")
    valid = F.col("event_type") != "error"
    return W.latest_valid(events, ["user_id"], ["ts", "event_id"], valid).drop("ts")


@query("first_occurrence", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
    ORDER BY ts, event_id) AS k FROM events) WHERE k = 1
""")
def first_occurrence(t: Tables) -> DataFrame:
    events = t("events").select("user_id", "event_type", "event_id", "value", "ts")
    return picks.first_per_key(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("manifest_unique", """
SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority, 'audio/' || o_orderpriority AS full_path FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k
  FROM lineitem WHERE l_returnflag = 'A') JOIN orders ON o_orderkey = l_orderkey
WHERE k = 1 AND (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'
    OR o_orderpriority = '5-LOW' AND o_orderstatus <> 'F')
""")
def manifest_unique(t: Tables) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    orders = t("orders").where(
        (priority.isin("1-URGENT", "2-HIGH") & (status == "F")) | ((priority == "5-LOW") & ~status.isin("F"))
    ).select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    items = t("lineitem").where(F.col("l_returnflag") == "A").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    first = picks.first_per_key(items, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")
    return first.join(orders, "l_orderkey").withColumn("full_path", F.concat(F.lit("audio/"), "o_orderpriority"))


@query("strict_map_join", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
  ELSE 'Low' END AS category FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'
""")
def strict_map_join(t: Tables) -> DataFrame:
    names = {"1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Medium", "5-LOW": "Low"}
    return picks.keep_mapped(t("orders"), "o_orderpriority", names, "category").select("o_orderkey", "category")


@query("existing_inputs", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def existing_inputs(t: Tables) -> DataFrame:
    return W.existing_inputs(t("documents").select("doc_id", "source"), t("labels"), "doc_id")


@query("located_inputs", "SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)")
def located_inputs(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id")


@query("missing_inputs_report", """
SELECT source, count(*) AS n_missing, min(doc_id) AS first_missing FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source
""")
def missing_inputs_report(t: Tables) -> DataFrame:
    missing = W.missing_inputs(t("documents").select("doc_id", "source"), t("labels"), "doc_id")
    return missing.groupBy("source").agg(F.count(F.lit(1)).alias("n_missing"), F.min("doc_id").alias("first_missing"))


@query("attribute_lookup", """
SELECT event_id, coalesce(c_mktsegment, '?') AS accent FROM events LEFT JOIN customer ON c_custkey = user_id * 40
""")
def attribute_lookup(t: Tables) -> DataFrame:
    speakers = t("customer").select(F.col("c_custkey").alias("speaker"), F.col("c_mktsegment").alias("accent"))
    events = t("events").select("event_id", (F.col("user_id") * 40).alias("speaker"))
    return events.join(speakers, "speaker", "left").select("event_id", F.coalesce("accent", F.lit("?")).alias("accent"))


@query("tagged_prompt_stack", """
SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, 'customer' AS prompt_type FROM customer
UNION ALL SELECT s_name, s_nationkey, NULL, 'supplier' FROM supplier
""")
def tagged_prompt_stack(t: Tables) -> DataFrame:
    customers = t("customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = t("supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return readers.stack([
        customers.withColumn("prompt_type", F.lit("customer")), suppliers.withColumn("prompt_type", F.lit("supplier"))
    ])


@query("reconcile_columns", """
SELECT c_name AS name, c_nationkey AS nation, coalesce(c_mktsegment, '') AS segment, substr(c_name, 1, 8) AS label FROM customer
UNION ALL SELECT s_name, s_nationkey, '', substr(s_name, 1, 8) FROM supplier
""")
def reconcile_columns(t: Tables) -> DataFrame:
    """Two tables under canonical names, each value from whichever column holds it, empty by default."""
    both = readers.stack([t("customer").drop("c_acctbal", "absent"), t("supplier").drop("s_acctbal", "absent")])
    name = F.coalesce("c_name", "s_name")
    return both.select(
        name.alias("name"), F.coalesce("c_nationkey", "s_nationkey").alias("nation"),
        F.coalesce("c_mktsegment", F.lit("")).alias("segment"), F.substring(name, 1, 8).alias("label"),
    )


@query("right_biased_merge", """
SELECT s_suppkey, s_name AS clip_name, n_name AS name, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def right_biased_merge(t: Tables) -> DataFrame:
    clips = t("supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("category"))
    prompts = t("nation").select(F.col("n_nationkey").alias("category"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return W.pair_with_prompts(clips, prompts).drop("category")


@query("file_family_scan", """
SELECT 'documents' AS kind, doc_id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels
""")
def file_family_scan(t: Tables) -> DataFrame:
    glob = f"{t.folder}/{{documents,labels}}.parquet"
    return readers.read_family_parquet(t.spark, glob, ["doc_id"], r"^(\w+)\.parquet$", ["kind"])


@query("tolerant_scan", """
SELECT 'documents.parquet' AS file, true AS found, count(*) AS n FROM documents
UNION ALL SELECT 'labels.parquet', true, count(*) FROM labels UNION ALL SELECT 'ratings.parquet', false, 0
""")
def tolerant_scan(t: Tables) -> DataFrame:
    """Rows per listed file; an absent file is reported, not an error."""
    names = ["documents.parquet", "labels.parquet", "ratings.parquet"]
    found, missing = readers.existing_paths(t.spark, [f"{t.folder}/{n}" for n in names])
    rows = readers.read_family_parquet(t.spark, found, ["doc_id"], r"^(.*)$", ["file"])
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    listed = [(p.rsplit("/", 1)[1], True) for p in found] + [(p.rsplit("/", 1)[1], False) for p in missing]
    files = t.spark.createDataFrame(listed, "file string, found boolean")
    return files.join(counts, "file", "left").withColumn("n", F.coalesce("n", F.lit(0)))
