"""Parts chosen by name: linkers and scorers, with the caller's own where a model is meant."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import guarded_score
from ..operators.linking import link_best


def link_resolved(mentions: DataFrame, nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """key, id and score 1 of the mentions (key, mention) that a resolver gives a node of this graph for (resolved:
    mention, id). Ids that the graph lacks are no links; a mention resolved twice takes the least id."""
    known = resolved.join(nodes.select("id"), "id", "left_semi").groupBy("mention").agg(F.min("id").alias("id"))
    return mentions.select("key", "mention").join(known, "mention").select("key", "id", F.lit(1.0).alias("score"))


def linker(name: str, resolve: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A function from mentions (key, mention) and nodes to key, id, score: ``labels``, or ``resolver``, where the caller's
    function turns distinct mentions (mention) into mention and id. Other names raise ValueError."""
    if name == "labels":
        return link_best
    if name == "resolver":
        if resolve is None:
            raise ValueError("the resolver needs a function")
        return lambda mentions, nodes: link_resolved(mentions, nodes, resolve(mentions.select("mention").distinct()))
    raise ValueError(f"unknown linker {name!r}: labels or resolver")


def scorer(name: str, score: Callable[[Column, Column], Column] | None = None) -> Callable[[Column, Column], Column]:
    """A function from premise and hypothesis to a score of 0 to 1: ``lexical``, or ``model``, where the caller's function
    gives the column, as a Pandas UDF over a model does. Other names raise ValueError."""
    if name == "lexical":
        return guarded_score
    if name == "model":
        if score is None:
            raise ValueError("the model scorer needs a function")
        return score
    raise ValueError(f"unknown scorer {name!r}: lexical or model")


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A scorer over a model: ``load`` is called once a task and gives a function from premises and hypotheses to scores,
    which then sees one Arrow batch after the other. A null premise or text scores 0."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for premise, text in batches:
            out = pd.Series(0.0, premise.index)
            some = premise.notna() & text.notna()
            if some.any():
                out[some] = list(model(premise[some].tolist(), text[some].tolist()))
            yield out

    return score


@dataclass(frozen=True)
class Choices:
    """What the cascade scores and links by. With ``candidates``, a function from claims (key, text) and premises (pid,
    premise, ord) to the pairs (key, text, pid, premise, ord) that are worth scoring, evidence is searched among these by
    ``score``, as a model needs it; without, by the lexical search, which no other score may replace."""

    score: Callable[[Column, Column], Column] = guarded_score
    link: Callable[[DataFrame, DataFrame], DataFrame] = link_best
    candidates: Callable[[DataFrame, DataFrame], DataFrame] | None = None

    def __post_init__(self):
        if self.candidates is None and self.score is not guarded_score:
            raise ValueError("a scorer of one's own needs candidates")


def best_scored(pairs: DataFrame, score: Callable[[Column, Column], Column] = guarded_score, place: bool = False) -> DataFrame:
    """From candidate pairs (key, text, pid, premise, ord): key, pid and score (with ``place`` ord too) of the best premise
    of each key by any scorer, the first on ties; keys without a positive score are absent."""
    rows = pairs.select("key", "pid", "ord", score(F.col("premise"), F.col("text")).alias("score")).where("score > 0")
    best = rows.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "ord", "pid")).alias("b"))
    return best.select("key", F.col("b.pid").alias("pid"), (-F.col("b.minus")).alias("score"), *([F.col("b.ord").alias("ord")] if place else []))


def generation_key(question: Column, context: Column, temperature: Column, seed: Column) -> Column:
    """The key of a cached answer: sha256 over the JSON of all that the draw depends on. Each draw of one question has its
    own seed, and so its own key; null seeds are a value of their own."""
    return F.sha2(F.to_json(F.struct(question.alias("question"), context.alias("context"), temperature.cast("double").alias("temperature"), seed.alias("seed")), {"ignoreNullFields": "false"}), 256)


def cached_answers(plan: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plan rows (with generation_key) that the cache (generation_key, answer_text) has an answer to, and those still to be
    drawn. A key cached twice takes the least answer."""
    known = cache.groupBy("generation_key").agg(F.min("answer_text").alias("answer_text"))
    return plan.join(known, "generation_key"), plan.join(known, "generation_key", "left_anti")
