"""Scoped retrieval and what is done with its evidence: scopes, parents, reranking, batches, facts, claims, budgets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """What may be retrieved. Unset parts admit everything; a row without a date is outside any range of dates."""

    project: object
    strategy: str | None = None
    role: str = "RETRIEVAL"
    types: tuple[str, ...] = ()
    documents: tuple[object, ...] = ()
    sequences: tuple[int, ...] = ()
    since: str | None = None
    until: str | None = None

    def admits(self) -> Column:
        parts = [F.col("project_id") == F.lit(self.project), F.col("chunk_role") == self.role]
        if self.strategy:
            parts.append(F.col("chunk_strategy") == self.strategy)
        for values, column in ((self.types, "document_type"), (self.documents, "document_id"), (self.sequences, "isr_sequence")):
            if values:
                parts.append(F.col(column).isin(*values))
        if self.since:
            parts.append(F.col("document_date") >= F.lit(self.since).cast("date"))
        if self.until:
            parts.append(F.col("document_date") <= F.lit(self.until).cast("date"))
        return F.coalesce(reduce(and_, parts), F.lit(False))


def scoped(chunks: DataFrame, scope: Scope) -> DataFrame:
    """The chunks of a scope; the condition stands before any scoring, so it reaches the scan."""
    return chunks.where(scope.admits())


def with_parents(found: DataFrame, chunks: DataFrame, key: str = "chunk_id", parent: str = "parent_chunk_id", text: str = "chunk_text") -> DataFrame:
    """Evidence with the text of its parent chunk, null where it has none."""
    above = chunks.select(F.col(key).alias("__p"), F.col(text).alias("parent_text"))
    return found.join(above, F.col(parent) == F.col("__p"), "left").drop("__p")


def latest_only(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of each key's greatest ``order``; ties stay together."""
    top = F.max(order).over(Window.partitionBy(key))
    return rows.withColumn("__top", top).filter(F.col(order) == F.col("__top")).drop("__top")


def reranked(found: DataFrame, query_key: str, key: str, score: Column, k: int) -> DataFrame:
    """Candidates by a second score, ties keeping their first rank."""
    nth = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col("rerank_score").desc(), "rank", key))
    return found.withColumn("rerank_score", score).withColumn("new_rank", nth.cast("long")).filter(F.col("new_rank") <= k)


def overlap(question: Column, text: Column) -> Column:
    """Share of a question's distinct tokens that a text has: the score that stands for a cross-encoder."""
    from tallyforge.functions.text import search_tokens

    q = F.array_distinct(search_tokens(question))
    return F.coalesce(F.round(F.try_divide(F.size(F.array_intersect(q, search_tokens(text))).cast("double"), F.size(q).cast("double")), 6), F.lit(0.0))


def answered(found: DataFrame, questions: DataFrame, query_key: str, least: float | None = None) -> DataFrame:
    """(query, n_evidence, best, status): OK, or INSUFFICIENT_EVIDENCE where nothing was found or the best is too low."""
    per = found.groupBy(query_key).agg(F.count(F.lit(1)).alias("n_evidence"), F.max("score").alias("best"))
    rows = questions.select(query_key).join(per, query_key, "left")
    enough = F.col("n_evidence").isNotNull() & (F.lit(True) if least is None else F.col("best") >= least)
    return rows.select(query_key, F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), "best", F.when(enough, "OK").otherwise("INSUFFICIENT_EVIDENCE").alias("status"))


def fact(value: Column, *needs: Column) -> Column:
    """(value, status): KNOWN, or UNKNOWN and null if the value or any fact that it was derived from is unknown."""
    known = reduce(and_, (n["status"] == "KNOWN" for n in needs), value.isNotNull())
    return F.struct(F.when(known, value).alias("value"), F.when(known, "KNOWN").otherwise("UNKNOWN").alias("status"))


def evidence_id(*parts: Column) -> Column:
    return F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)), 256), 1, 16))


def merged_evidence(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row for each evidence id: the calls that gave it, its value if they agree, and whether they conflict."""
    per = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("call")), ",").alias("calls"), F.count_distinct(value).alias("__n"), F.min(value).alias("__v"))
    return per.select(key, "calls", F.when(F.col("__n") == 1, F.col("__v")).alias(value), (F.col("__n") > 1).alias("conflict"))


def claim_status(cited: Column, known: Column, periods: Column, covered: Column, number: Column, numbers: Column) -> Column:
    """The first reason to refuse a claim, or VALID: no citation, a citation outside of the evidence, a period that the
    evidence doesn't cover, a number that stands in none of it."""
    return (
        F.when(F.size(cited) == 0, "NO_CITATION")
        .when(F.size(F.array_except(cited, known)) > 0, "UNKNOWN_CITATION")
        .when(F.size(F.array_except(periods, covered)) > 0, "PERIOD_NOT_COVERED")
        .when(number.isNotNull() & ~F.array_contains(numbers, number), "NUMBER_NOT_IN_EVIDENCE")
        .otherwise("VALID")
    )


def final_status(valid: Column, refused: Column, conflicts: Column) -> Column:
    """How an answer is finished: what is refused is left out, nothing valid is no answer."""
    return F.when(valid == 0, "INSUFFICIENT_EVIDENCE").when(conflicts > 0, "PARTIAL_WITH_CONFLICTS").when(refused > 0, "PARTIAL").otherwise("ANSWERED")


def ledger(operations: DataFrame, run: str, order: str, cost: str, budget: float) -> DataFrame:
    """Operations with what a run has spent up to each; from the first that would exceed the budget on they are refused."""
    upto = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = operations.withColumn("spent", F.sum(cost).over(upto))
    return rows.withColumn("admitted", F.col("spent") <= F.lit(budget))


def anchored(events: DataFrame, key: str, order: list[str], which: str, n: int | None = None) -> DataFrame:
    """(key, event_id, status): the event that a question names as 'the last one', by its ordinal, or 'the one' of a year:
    RESOLVED if it is unique, else UNRESOLVED."""
    if which == "year":
        per = events.filter(F.year("day") == n).groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.min("event_id").alias("e"))
    else:
        nth = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() if which == "last" else F.col(c) for c in order)))
        per = events.withColumn("__n", nth).filter(F.col("__n") == (1 if which == "last" else n)).select(key, F.lit(1).alias("c"), F.col("event_id").alias("e"))
    rows = events.select(key).distinct().join(per, key, "left")
    one = F.col("c") == 1
    return rows.select(key, F.when(one, F.col("e")).alias("event_id"), F.when(one, "RESOLVED").otherwise("UNRESOLVED").alias("status"))


def truncated(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each key, each with how many there were and whether some were left out: never a silent cut."""
    nth, n = F.row_number().over(Window.partitionBy(key).orderBy(*order)), F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.withColumn("__n", nth).withColumn("total", n).filter(F.col("__n") <= most).drop("__n").withColumn("truncated", F.col("total") > most)
