"""Runs of a collection and the evidence they leave: reports, confirmed counts, resolved gaps.

Evidence is one row a (run_id, source, key); a run knows its group and when it
started. Everything is a grouped aggregate or a window over the few runs of a
group; runs are few beside the evidence, which is only ever summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notefold.functions.joins import merge_join
from notefold.operators import reconcile

#: Sources of evidence, in order of precedence.
SOURCES = ["network", "dom", "embedded_state", "redbook"]
#: Pairs of sources whose differences are reported.
DIFFERENCES = [("network", "dom"), ("dom", "network"), ("network", "embedded_state"), ("embedded_state", "network"), ("dom", "embedded_state"), ("embedded_state", "dom"), ("network", "redbook"), ("redbook", "network"), ("dom", "redbook")]
CONFIRMED = ["complete", "complete_after_invalid_notes_cleanup"]


def keep_first(evidence: DataFrame, key: list[str], arrival: list[str], columns: list[str]) -> DataFrame:
    """One row a key of repeated evidence: every column from the earliest arrival that has it."""
    pick = [F.min_by(c, F.struct(F.col(c).isNull(), *arrival)).alias(c) for c in columns]
    return evidence.groupBy(*key).agg(*pick, F.min(F.struct(*arrival)).alias("_first")).select(*key, *columns, *(F.col(f"_first.{a}").alias(f"first_{a}") for a in arrival))


def expected_count(stated: Column, shown: Column, confirmed: Column) -> Column:
    """Struct (count, source, mismatch): what the user states, else what the page shows, else what was confirmed last; 0 is no count."""
    count = lambda c: F.when(c > 0, c)
    source = F.when(count(stated).isNotNull(), "user").when(count(shown).isNotNull(), "page").when(count(confirmed).isNotNull(), "confirmed").otherwise("unknown")
    return F.struct(F.coalesce(count(stated), count(shown), count(confirmed)).alias("count"), source.alias("source"), F.coalesce(stated != shown, F.lit(False)).alias("mismatch"))


def reports(runs: DataFrame, evidence: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """One row a run: distinct keys by source and of the union, keys new to the group, gap, status and flags.

    ``runs``: run_id, grp, started, expected, has_more; ``evidence``: run_id, source, key.
    A key is new in the first run of its group that saw it. A run without evidence has zeros.
    """
    sources = sources or SOURCES
    flags = reconcile.presence(evidence, ["run_id", "key"], "source", sources)
    counted = flags.groupBy("run_id").agg(*(F.count_if(F.col(s)).alias(f"{s}_count") for s in sources), F.count("*").alias("union_count"))
    placed = merge_join(flags.select("run_id", "key"), runs.select("run_id", "grp", "started"), "run_id")
    fresh = placed.groupBy("grp", "key").agg(F.min(F.struct("started", "run_id")).alias("first")).groupBy(F.col("first.run_id").alias("run_id")).agg(F.count("*").alias("new_count"))
    joined = merge_join(merge_join(runs, counted, "run_id", "left"), fresh, "run_id", "left").fillna(0, [*(f"{s}_count" for s in sources), "union_count", "new_count"])
    expected, found = F.col("expected"), F.col("union_count")
    return joined.select(
        "run_id", "grp", "started", "expected", "has_more", *(f"{s}_count" for s in sources), "union_count", "new_count", reconcile.gap(expected, found).cast("bigint").alias("gap"), reconcile.count_status(expected, found, F.col("has_more")).alias("status"),
        F.coalesce((expected > 0) & (found < expected), F.lit(False)).alias("possibly_incomplete"), F.coalesce((expected > 0) & (found >= expected), F.lit(False)).alias("complete"),
    )


def confirmed_counts(report: DataFrame, last: int = 20) -> DataFrame:
    """(grp, confirmed): the expected count of the newest of a group's ``last`` runs that reached it; groups without one are absent."""
    newest = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("started"), F.desc("run_id")))
    good = F.col("complete") | (F.col("status").isin(CONFIRMED) & (F.col("expected") > 0) & (F.col("expected") <= F.col("union_count")))
    return report.withColumn("_n", newest).where((F.col("_n") <= last) & good).groupBy("grp").agg(F.min_by("expected", "_n").alias("confirmed"))


def resolved(report: DataFrame) -> DataFrame:
    """Each run beside the one before it, and whether fewer expected keys explain the gap of that one exactly.

    A resolved run was complete at once: as many found as before, as many expected as
    found, and the expectation lower by just the gap. Its status says so.
    """
    w = Window.partitionBy("grp").orderBy("started", "run_id")
    before = lambda c: F.lag(c).over(w)
    seen = report.withColumns({"previous_run": before("run_id"), "_e": before("expected"), "_u": before("union_count"), "_g": before("gap")})
    solved = (F.col("_e") > 0) & (F.col("_g") > 0) & (F.col("expected") == F.col("union_count")) & (F.col("_u") == F.col("union_count")) & (F.col("_e") - F.col("expected") == F.col("_g"))
    solved = F.coalesce(solved, F.lit(False))
    return seen.select("run_id", "grp", "started", "previous_run", solved.alias("resolved"), F.when(solved, F.col("_g")).alias("removed"), F.when(solved & (F.col("status") == "complete"), CONFIRMED[1]).otherwise(F.col("status")).alias("status"))
