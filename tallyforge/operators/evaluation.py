"""Evaluation of retrieval, routing and answers: choices between configurations, causes of misses, frontiers, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.staging import dealt

#: Rows of a task that looks for latest attempts, about.
ATTEMPTS = 200_000


def staged_choice(runs: list[dict], metric: str, least_gain: float) -> tuple[dict, list[str]]:
    """The simplest configuration that no later one beats by ``least_gain``, and why; ``runs`` stand in order of complexity,
    a few of them, already measured. A run that failed (metric None) is left out and named."""
    usable = [r for r in runs if r.get(metric) is not None]
    if not usable:
        raise ValueError("no configuration could run")
    best, why = usable[0], [f"{r['name']} did not run" for r in runs if r.get(metric) is None]
    for r in usable[1:]:
        gain = r[metric] - best[metric]
        why.append(f"{r['name']} {'gains' if gain >= least_gain else 'does not gain enough'}: {gain:+.3f} on {best['name']}")
        best = r if gain >= least_gain else best
    return best, why


def miss_causes(wanted: DataFrame, matching: DataFrame, admitted: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(question, evidence, cause) of evidence that is not among the first ``k`` hits: NOT_IN_CHUNKS, OUT_OF_SCOPE,
    RANKED_BELOW or NOT_RETRIEVED, the first that holds.

    ``wanted`` (question, evidence), ``matching`` (evidence, chunk), ``admitted`` (question, chunk), ``hits`` (question,
    chunk, rank).
    """
    rows = wanted.join(matching, "evidence", "left").join(admitted.withColumn("__in", F.lit(True)), ["question", "chunk"], "left").join(hits, ["question", "chunk"], "left")
    per = rows.groupBy("question", "evidence").agg(F.count("chunk").alias("chunks"), F.count("__in").alias("inside"), F.min("rank").alias("rank"))
    cause = F.when(F.col("chunks") == 0, "NOT_IN_CHUNKS").when(F.col("inside") == 0, "OUT_OF_SCOPE").when(F.col("rank") > k, "RANKED_BELOW").when(F.col("rank").isNull(), "NOT_RETRIEVED")
    return per.select("question", "evidence", cause.alias("cause")).filter("cause is not null")


def frontier(gains: DataFrame, key: str, gain: str, order: list[Column]) -> DataFrame:
    """(n, rate, gain_so_far, retained, expected): what is kept of the whole gain if only the first n are treated by a policy's
    order, against what n at random would keep; a row for each distinct n of the policy's ranks, numbered by counts of ranks
    so that no window spans all rows."""
    ranked = gains.groupBy(*order).agg(F.count(F.lit(1)).alias("__c"), F.sum(gain).alias("__g"))
    names = ranked.columns[: len(order)]
    upto = Window.orderBy(*(F.col(n).desc() for n in names)).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each rank
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ranked.select(F.sum("__c").over(upto).alias("n"), F.sum("__g").over(upto).alias("gain_so_far"), F.sum("__c").over(whole).alias("__all"), F.sum("__g").over(whole).alias("__whole"))
    share = F.round(F.col("n") / F.col("__all"), 6)
    return rows.select("n", share.alias("rate"), "gain_so_far", F.round(F.try_divide(F.col("gain_so_far").cast("double"), F.col("__whole").cast("double")), 6).alias("retained"), F.round(F.col("n") / F.col("__all") * F.col("__whole").cast("double"), 6).alias("expected"))


def pass_consistency(passes: DataFrame, key: str, ranked: str, metric: str, tolerance: float) -> DataFrame:
    """(key, n_passes, same_ranking, drift, stable) of repeated runs."""
    per = passes.groupBy(key).agg(F.count(F.lit(1)).alias("n_passes"), (F.count_distinct(ranked) == 1).alias("same_ranking"), F.round(F.max(metric) - F.min(metric), 6).alias("drift"))
    return per.withColumn("stable", F.col("same_ranking") & (F.col("drift") <= tolerance))


def family_left_out(neighbours: DataFrame, case: str, family: str, other_family: str, label: str, score: str, k: int) -> DataFrame:
    """(case, label, best): the vote of the k nearest examples of other families; ties of votes by score, then label."""
    near = neighbours.filter(F.col(family) != F.col(other_family))
    nth = F.row_number().over(Window.partitionBy(case).orderBy(F.col(score).desc(), label))
    votes = near.withColumn("__n", nth).filter(F.col("__n") <= k).groupBy(case, label).agg(F.count(F.lit(1)).alias("votes"), F.max(score).alias("best"))
    first = F.row_number().over(Window.partitionBy(case).orderBy(F.col("votes").desc(), F.col("best").desc(), label))
    return votes.withColumn("__f", first).filter("__f = 1").drop("__f")


def coverage_curve(predictions: DataFrame, score: str, correct: str, thresholds: list[float]) -> DataFrame:
    """(threshold, coverage, accuracy) of answers at or above each threshold, in one aggregation."""
    at = lambda t: F.col(score) >= t
    rows = predictions.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(at(t)).alias(f"a{i}") for i, t in enumerate(thresholds)), *(F.count_if(at(t) & F.col(correct)).alias(f"c{i}") for i, t in enumerate(thresholds)))
    each = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.round(F.col(f"a{i}") / F.col("n"), 6).alias("coverage"), F.round(F.try_divide(F.col(f"c{i}"), F.col(f"a{i}")), 6).alias("accuracy")) for i, t in enumerate(thresholds)))
    return rows.select(F.inline(each))


def verdicts(cases: DataFrame, facts: DataFrame, citations: DataFrame, key: str) -> DataFrame:
    """(case, facts_found, facts_wanted, cited, foreign, verdict): PASS with all facts and no foreign citation, PARTIAL with
    some, FAIL with none or with a foreign one. ``facts`` (case, ok), ``citations`` (case, foreign)."""
    f = facts.groupBy(key).agg(F.count_if(F.col("ok")).alias("facts_found"), F.count(F.lit(1)).alias("facts_wanted"))
    c = citations.groupBy(key).agg(F.count(F.lit(1)).alias("cited"), F.count_if(F.col("foreign")).alias("foreign_cited"))
    rows = cases.select(key).join(f, key, "left").join(c, key, "left").fillna(0, ["facts_found", "facts_wanted", "cited", "foreign_cited"])
    verdict = F.when(F.col("foreign_cited") > 0, "FAIL").when(F.col("facts_found") == F.col("facts_wanted"), "PASS").when(F.col("facts_found") > 0, "PARTIAL").otherwise("FAIL")
    return rows.withColumn("verdict", verdict)


def agreement(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, n, agreed, rate): how often each column of the cases agrees, null agreeing with null; a case without an
    answer agrees in nothing."""
    both = expected.select(key, *(F.col(c).alias(f"e_{c}") for c in columns)).join(actual.select(key, F.lit(True).alias("__there"), *(F.col(c).alias(f"a_{c}") for c in columns)), key, "left")
    same = {c: F.coalesce(F.col("__there") & F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")), F.lit(False)) for c in columns}
    one = both.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(s).alias(f"s_{c}") for c, s in same.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"s_{c}").alias("agreed"), F.round(F.col(f"s_{c}") / F.col("n"), 6).alias("rate")) for c in columns))))


def latest_attempt(runs: DataFrame, case: str, attempt: str) -> DataFrame:
    """The latest attempt of each case, with how many there were; earlier ones stay in the store."""
    n, nth = F.count(F.lit(1)).over(Window.partitionBy(case)), F.row_number().over(Window.partitionBy(case).orderBy(F.col(attempt).desc()))
    return dealt(runs, case, rows=ATTEMPTS).withColumn("attempts", n).withColumn("__n", nth).filter("__n = 1").drop("__n")
