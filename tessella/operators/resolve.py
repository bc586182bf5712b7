"""Entity resolution as retrieve, score, decide over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class CandidateSource(Protocol):
    """Edges source_id, target_id of source rows."""

    def retrieve(self, source: DataFrame) -> DataFrame: ...


class PairScorer(Protocol):
    """The edges with a score."""

    def score(self, candidates: DataFrame) -> DataFrame: ...


class DecisionPolicy(Protocol):
    """At most one edge a source, with decision match or review."""

    def decide(self, scored: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class ThresholdPolicy:
    """The best edge of each source: a match from `accept` if it leads the second by `lead`, for review from `review`."""

    accept: float = 0.9
    review: float = 0.6
    lead: float = 0.0

    def decide(self, scored: DataFrame) -> DataFrame:
        order = W.partitionBy("source_id").orderBy(F.desc("score"), "target_id")
        best = scored.withColumn("n", F.row_number().over(order)).withColumn("ahead", F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(float("-inf")))).where("n = 1")
        decision = F.when((F.col("score") >= self.accept) & (F.col("ahead") >= self.lead), "match").when(F.col("score") >= self.review, "review")
        return best.withColumn("decision", decision).where("decision IS NOT NULL").select("source_id", "target_id", "score", "decision")


@dataclass(frozen=True)
class Resolver:
    candidates: CandidateSource
    scorer: PairScorer
    policy: DecisionPolicy

    def resolve(self, source: DataFrame) -> DataFrame:
        return self.policy.decide(self.scorer.score(self.candidates.retrieve(source)))
