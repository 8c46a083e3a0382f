"""Gates between model output and stored claims, and the overlay on events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureframe.functions.ordered import top_per_group
from lureframe.sources.reference import CLASSIFICATIONS, RISK_LEVELS

TEXT_LIMIT, CITED_LIMIT = 500, 50
PRIORITIES = ("P1", "P2", "P3")
VERDICT_DDL = (
    "classification string, confidence double, risk_score int, risk string, behavior_summary string,"
    " evidence array<struct<event_id:string,artifact:string>>"
)


def classification_gate(raw: DataFrame, heads: DataFrame, commands: DataFrame) -> DataFrame:
    """Model verdicts as JSON text against the closed schema. An unusable one degrades to
    Unclassified / 0, citing the session's first command or, without one, its first event.

    `raw` holds (session_id, chunk_no, body); `heads` is compact_summary, `commands` compact.
    """
    first = commands.groupBy("session_id").agg(
        F.min(F.struct("ts", "event_id", "command")).alias("_c"), F.count(F.lit(1)).alias("_n")
    )
    v = lambda c: F.col(f"_v.{c}")
    usable = (
        v("classification").isin(*CLASSIFICATIONS) & v("risk").isin(*RISK_LEVELS) & v("confidence").between(0, 1)
        & v("risk_score").between(0, 100) & v("behavior_summary").isNotNull() & (F.size(v("evidence")) > 0)
        & F.forall(v("evidence"), lambda e: e["event_id"].isNotNull() & e["artifact"].isNotNull())
    )
    rows = (
        raw.withColumn("_v", F.from_json("body", VERDICT_DDL)).withColumn("_ok", F.coalesce(usable, F.lit(False)))
        .join(first, "session_id", "left").join(heads.select("session_id", "first_event_id"), "session_id", "left")
    )
    n = F.coalesce("_n", F.lit(0))
    fallback = F.array(F.struct(
        F.coalesce(F.col("_c.event_id"), F.col("first_event_id")).cast("string").alias("event_id"),
        F.coalesce(F.col("_c.command"), F.lit("no command on record")).alias("artifact"),
    ))
    pick = lambda c, other: F.when(F.col("_ok"), v(c)).otherwise(other).alias(c)
    return rows.select(
        "session_id", "chunk_no", pick("classification", F.lit("Unclassified")), pick("confidence", F.lit(0.0)),
        pick("risk_score", F.lit(0)), pick("risk", F.lit("informational")),
        pick("behavior_summary", F.concat(
            F.lit("No valid verdict; the session has "), n.cast("string"), F.lit(" commands on record.")
        )),
        pick("evidence", fallback), (~F.col("_ok")).alias("degraded"),
    )


def barrier(cl: DataFrame, ct: DataFrame, ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept citations, rejected claims).

    `cl`: claim_id, session_id, kind, technique_id, text. `ct`: claim_id, event_id, artifact. A
    claim stays if a citation names an event of its own session; citations that do not resolve are
    dropped from it. Both outputs are rows, so a claim may cite any number of events.
    """
    cited = ct.join(cl.select("claim_id", "session_id"), "claim_id")
    kept = cited.join(ev.select("session_id", "event_id", "ts").distinct(), ["session_id", "event_id"]).select(
        "claim_id", "session_id", "event_id", "ts", "artifact"
    )
    refused = cl.join(kept.select("claim_id").distinct(), "claim_id", "left_anti")
    # The stored list is short by design: the first citations in order.
    some = top_per_group(ct.join(refused.select("claim_id"), "claim_id", "left_semi"), ["claim_id"], [F.asc("event_id")], CITED_LIMIT)
    lists = some.groupBy("claim_id").agg(F.array_sort(F.collect_list("event_id")).alias("cited_event_ids"))
    rejected = refused.join(lists, "claim_id", "left").select(
        "claim_id", "session_id", "kind", "technique_id", F.lit("evidence_barrier").alias("stage"),
        F.lit("citations_unresolved").alias("reason"), F.left("text", F.lit(TEXT_LIMIT)).alias("text"),
        F.coalesce("cited_event_ids", F.array().cast(lists.schema["cited_event_ids"].dataType)).alias("cited_event_ids"),
    )
    return kept, rejected


def technique_gate(
    proposals: DataFrame, cites: DataFrame, offered: DataFrame, catalog: DataFrame, ruled: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted with grounded citations, rejected, dropped as already produced by a rule).

    `proposals`: proposal_id, session_id, chunk_no, technique_id, confidence, explanation.
    `cites`: proposal_id, event_id. `offered`: session_id, chunk_no, event_id. `ruled`:
    session_id, technique_id. The checks apply in that order; a rule duplicate is not a rejection.
    """
    known = catalog.select("technique_id", F.lit(True).alias("_known"))
    grounded = (
        cites.distinct().join(proposals.select("proposal_id", "session_id", "chunk_no"), "proposal_id")
        .join(offered.select("session_id", "chunk_no", "event_id").distinct(), ["session_id", "chunk_no", "event_id"])
        .select("proposal_id", "event_id")
    )
    weights = grounded.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("weight"), F.min("event_id").alias("earliest"))
    rule = ruled.select("session_id", "technique_id").distinct().withColumn("_ruled", F.lit(True))
    judged = (
        proposals.join(known, "technique_id", "left").join(weights, "proposal_id", "left")
        .join(rule, ["session_id", "technique_id"], "left")
        .withColumn("reason", F.when(F.col("_known").isNull(), "unknown_technique").when(F.col("weight").isNull(), "citations_not_offered"))
    )
    cols = ["proposal_id", "session_id", "chunk_no", "technique_id", "confidence", "explanation"]
    clean = judged.filter(F.col("reason").isNull())
    accepted = clean.filter(F.col("_ruled").isNull()).select(*cols, "weight", "earliest")
    return accepted, judged.filter(F.col("reason").isNotNull()).select(*cols, "reason"), clean.filter("_ruled").select(*cols)


def merge_proposals(accepted: DataFrame) -> DataFrame:
    """Per (session, technique) the evidence-weighted mean confidence and the distinct
    explanations in order of their earliest event. No result depends on chunk order."""
    key = ["session_id", "technique_id"]
    scores = accepted.groupBy(*key).agg(
        F.bround(F.sum(F.col("confidence") * F.col("weight")) / F.sum("weight"), 3).alias("confidence"), F.count(F.lit(1)).alias("proposals")
    )
    said = F.trim(F.coalesce("explanation", F.lit("")))
    distinct = accepted.withColumn("_x", said).filter("_x <> ''").groupBy(*key, "_x").agg(F.min("earliest").alias("_e"))
    texts = distinct.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_e", "_x"))).alias("_l"))
    return scores.join(texts, key, "left").select(
        *key, "confidence", "proposals", F.array_join("_l._x", " ").alias("explanation"),
        F.lit("llm").alias("source"), F.lit(False).alias("observed"),
    )


def merged_evidence(accepted: DataFrame, cites: DataFrame, offered: DataFrame) -> DataFrame:
    """The union of the merged proposals' grounded events, one row each."""
    return (
        accepted.select("proposal_id", "session_id", "chunk_no", "technique_id").join(cites.distinct(), "proposal_id")
        .join(offered.select("session_id", "chunk_no", "event_id").distinct(), ["session_id", "chunk_no", "event_id"])
        .select("session_id", "technique_id", "event_id").distinct()
    )


def merge_classifications(chunks: DataFrame) -> DataFrame:
    """One verdict per session: the worst chunk's label and risk, the mean confidence, the
    distinct summaries in chunk order."""
    worst = F.max(F.struct("risk_score", (-F.col("chunk_no")).alias("_first"), "classification", "risk"))
    merged = chunks.groupBy("session_id").agg(worst.alias("_w"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("chunks"))
    said = chunks.filter(F.coalesce("behavior_summary", F.lit("")) != "").groupBy("session_id", "behavior_summary").agg(F.min("chunk_no").alias("_o"))
    texts = said.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("_o", "behavior_summary"))).alias("_l"))
    return merged.join(texts, "session_id", "left").select(
        "session_id", F.col("_w.classification").alias("classification"), "confidence",
        F.col("_w.risk_score").alias("risk_score"), F.col("_w.risk").alias("risk"),
        F.coalesce(F.array_join("_l.behavior_summary", " "), F.lit("")).alias("behavior_summary"), "chunks",
    )


def enrich(ev: DataFrame, verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """E5: the analysis overlay on events. Every event of an analysed session takes its risk and
    label; `mitre.*` is cleared there and set only from rule-backed evidence, first technique first.

    `verdicts`: session_id, risk_score, risk, classification. `evidence`: session_id, event_id,
    technique_id, tactic, position (rule-backed only).
    """
    v = verdicts.select("session_id", F.col("risk_score").alias("_s"), F.col("risk").alias("_r"), F.col("classification").alias("_c"))
    stamp = evidence.groupBy("session_id", "event_id").agg(F.min(F.struct("position", "technique_id", "tactic")).alias("_t"))
    joined = ev.join(v, "session_id", "left").join(stamp, ["session_id", "event_id"], "left")
    done = F.col("_r").isNotNull()
    over = {
        "risk_score": F.when(done, F.col("_s")).otherwise(F.col("risk_score")),
        "risk_level": F.when(done, F.col("_r")).otherwise(F.col("risk_level")),
        "ai_classification": F.when(done, F.col("_c")).otherwise(F.col("ai_classification")),
        "mitre_technique_id": F.when(done, F.col("_t.technique_id")).otherwise(F.col("mitre_technique_id")),
    }
    if "mitre_tactic" in ev.columns:
        over["mitre_tactic"] = F.when(done, F.col("_t.tactic")).otherwise(F.col("mitre_tactic"))
    return joined.select(*[over[c].alias(c) if c in over else F.col(c) for c in ev.columns])


def rejection_counts(rejected: DataFrame) -> DataFrame:
    """E6."""
    return rejected.groupBy("stage", "kind", "reason").agg(F.count(F.lit(1)).alias("n"))


def verdict_gate(verdicts: DataFrame, cites: DataFrame, packages: DataFrame) -> DataFrame:
    """An evaluator verdict stands only on a rating in [0, 1], a critique, and citations that
    were all in its package; one invented citation refuses it whole.

    `verdicts`: run_id, characteristic, rating, critique. `cites`: run_id, characteristic,
    item_id. `packages`: run_id, characteristic, item_id.
    """
    key = ["run_id", "characteristic"]
    offered = packages.select(*key, "item_id").distinct().withColumn("_in", F.lit(True))
    counted = cites.select(*key, "item_id").distinct().join(offered, [*key, "item_id"], "left").groupBy(*key).agg(
        F.count(F.lit(1)).alias("cited"), F.count_if(F.col("_in").isNull()).alias("_invented")
    )
    reason = (
        F.when(~F.coalesce(F.col("rating").between(0, 1), F.lit(False)), "rating_out_of_range")
        .when(F.coalesce("critique", F.lit("")) == "", "empty_critique")
        .when(F.col("cited").isNull(), "no_evidence_cited").when(F.col("_invented") > 0, "cited_evidence_not_in_package")
    )
    judged = verdicts.join(counted, key, "left").withColumn("reason", reason)
    return judged.select(
        *key, F.when(F.col("reason").isNull(), F.col("rating")).alias("rating"),
        F.when(F.col("reason").isNull(), "completed").otherwise("evaluator_failed").alias("status"), "reason",
        F.coalesce("cited", F.lit(0)).alias("cited"),
    )


def recommendation_gate(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recommended actions need a known priority, an action and a rationale."""
    ok = F.coalesce(F.col("priority").isin(*PRIORITIES) & F.col("action").isNotNull() & F.col("rationale").isNotNull(), F.lit(False))
    return actions.filter(ok), actions.filter(~ok)
