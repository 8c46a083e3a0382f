"""Technique rules over command lines (G2-G6) and their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureframe.functions import text
from lureframe.functions.bind import bind
from lureframe.sources import reference

# Case-insensitive, Unicode-aware, `$` before a final newline only.
_FLAGS = "(?iuUd)"


def techniques_of(raw: Column, executed: Column, rules=None) -> Column:
    """The ids of every rule a command hits, in rule order. One array expression, no join."""
    rules = reference.rule_patterns() if rules is None else rules
    tests = [
        F.when((raw if i in reference.RAW_TEXT_RULES else executed).rlike(_FLAGS + p), F.lit(i))
        for i, _, _, p in rules
    ]
    return F.array_compact(F.array(*tests))


def match_commands(commands: DataFrame, command: str = "command_line") -> DataFrame:
    """Each distinct command with its `techniques` array.

    The rulebook runs once per distinct text: the distinct is combined map-side, and the executed
    text is bound once for all the rules that read it.
    """
    distinct = commands.select(command).filter(F.col(command).isNotNull()).distinct()
    hits = bind(text.executed_text(command), lambda executed: techniques_of(F.col(command), executed))
    return distinct.select(command, hits.alias("techniques"))


def command_hits(commands: DataFrame, command: str = "command_line") -> DataFrame:
    """Each distinct command with one row per technique it hits."""
    return _one_each(match_commands(commands, command))


def _one_each(rows: DataFrame) -> DataFrame:
    # explode_outer: a plain explode makes the optimizer test the array's size below, which would
    # run the rules a second time.
    return rows.withColumn("technique_id", F.explode_outer("techniques")).drop("techniques").filter(F.col("technique_id").isNotNull())


def with_techniques(rows: DataFrame, command: str = "command_line") -> DataFrame:
    """Rows with a `techniques` array; rows without a command get null.

    Distinct-first: the text is matched once and joined back on its hash. A hot command is one
    small row on the build side, so the join is broadcast or skew-split by AQE.
    """
    matched = match_commands(rows, command)
    return rows.join(matched, command, "left")


def rule_hits(commands: DataFrame, command: str = "command_line") -> DataFrame:
    """One row per (command row, technique)."""
    hits = command_hits(commands, command)
    return commands.join(hits, command).select(*commands.columns, "technique_id")


def unmatched(commands: DataFrame, command: str = "command_line") -> DataFrame:
    """The command rows no rule matched."""
    tagged = with_techniques(commands.filter(F.col(command).isNotNull()), command)
    return tagged.filter(F.size("techniques") == 0).drop("techniques")


def technique_mappings(hits: DataFrame) -> DataFrame:
    """One observed mapping per (session, technique), with evidence counted and bounded ends.

    The citations themselves stay rows (`mapping_evidence`): a session may hold any number.
    """
    return hits.groupBy("session_id", "technique_id").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event_id"),
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event_id"),
        F.lit(1.0).alias("confidence"),
        F.lit("rule").alias("source"),
        F.lit(True).alias("observed"),
    )


def mapping_evidence(hits: DataFrame) -> DataFrame:
    """The ordered citations behind each mapping, one row each."""
    return hits.select("session_id", "technique_id", "ts", "event_id", F.col("command_line").alias("artifact"))


def mapping_quality(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Micro-averaged tp/fp/fn per origin from (case_id, origin, technique_id) labels and
    (case_id, origin, technique_id) predictions; a ratio with an empty denominator is null."""
    want = expected.select("case_id", "origin", "technique_id").distinct().withColumn("_e", F.lit(1))
    got = predicted.select("case_id", "origin", "technique_id").distinct().withColumn("_p", F.lit(1))
    both = want.join(got, ["case_id", "origin", "technique_id"], "full")
    counts = both.groupBy("origin").agg(
        F.count_if(F.col("_e").isNotNull() & F.col("_p").isNotNull()).alias("tp"),
        F.count_if(F.col("_e").isNull()).alias("fp"),
        F.count_if(F.col("_p").isNull()).alias("fn"),
    )
    ratio = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other)))
    return counts.withColumn("precision", ratio("fp")).withColumn("recall", ratio("fn"))


def mapping_spread(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """E7 over runs: mean, smallest and largest precision and recall per origin, from predictions with a `run`; runs without a
    denominator are left out of a ratio. A run that says nothing about an origin missed all of it."""
    want = expected.select("case_id", "origin", "technique_id").distinct()
    got = predicted.select("run", "case_id", "origin", "technique_id").distinct()
    hits = got.join(want, ["case_id", "origin", "technique_id"], "left_semi").groupBy("run", "origin").agg(F.count(F.lit(1)).alias("tp"))
    said = got.groupBy("run", "origin").agg(F.count(F.lit(1)).alias("said"))
    labelled = want.groupBy("origin").agg(F.count(F.lit(1)).alias("labelled"))
    # Every run has every origin that is labelled or spoken of: two aggregates of a few rows.
    origins = labelled.select("origin").union(said.select("origin")).distinct().withColumn("_k", F.lit(1))
    axis = origins.join(got.select("run").distinct().withColumn("_k", F.lit(1)), "_k").drop("_k")
    rows = axis.join(hits, ["run", "origin"], "left").join(said, ["run", "origin"], "left").join(labelled, "origin", "left").fillna(0, ["tp", "said", "labelled"])
    ratio = lambda of: F.when(F.col(of) > 0, F.col("tp") / F.col(of))
    three = lambda name, c: [F.avg(c).alias(f"{name}_mean"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("runs"), *three("precision", ratio("said")), *three("recall", ratio("labelled")))
