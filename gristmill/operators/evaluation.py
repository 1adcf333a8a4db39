"""Losses and choice metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_loss(tokens: DataFrame, loss: str = "loss", target: str = "target", ignored: int = -100) -> DataFrame:
    """One row: tokens that count, their summed loss, its mean; an error if there are none."""
    row = tokens.where(F.col(target) != ignored).agg(F.count("*").alias("tokens"), F.coalesce(F.sum(loss), F.lit(0.0)).alias("total"))
    return row.withColumn("mean", F.when(F.col("tokens") > 0, F.col("total") / F.col("tokens")).otherwise(F.raise_error(F.lit("no token has a target")).cast("double")))


def cross_entropy(logits: DataFrame, token: str = "token", option: str = "option", logit: str = "logit", target: str = "target", ignored: int = -100) -> DataFrame:
    """(token, loss, z): minus log probability of the target and the squared log of the normaliser, from logits (token, option, logit, target)."""
    top = logits.where(F.col(target) != ignored).groupBy(token).agg(F.max(logit).alias("_top"))
    sums = logits.join(top, token).groupBy(token, "_top").agg(F.sum(F.exp(F.col(logit) - F.col("_top"))).alias("_sum"), F.max(F.when(F.col(option) == F.col(target), F.col(logit))).alias("_own"))
    norm = F.col("_top") + F.ln("_sum")
    return sums.select(token, (norm - F.col("_own")).alias("loss"), (norm * norm).alias("z"))


def option_scores(tokens: DataFrame, by_length: bool = False) -> DataFrame:
    """(item, option, score): summed log probability of each option's tokens, by length if asked."""
    score = F.sum("logprob") / F.count("*") if by_length else F.sum("logprob")
    return tokens.groupBy("item", "option").agg(score.alias("score"), F.count("*").alias("tokens"))


def choice_items(options: DataFrame, by_length: bool = False) -> DataFrame:
    """(item, correct_prob, right, answer): probability of the correct option among an item's, whether the first of the best is it, and its log probability a token.

    Options are (item, option, score, tokens, correct) with scores as ``option_scores`` makes them, by length or not; an item's options are few and meet by key.
    """
    of = Window.partitionBy("item")
    weighed = options.withColumn("_w", F.exp(F.col("score") - F.max("score").over(of)))
    return weighed.groupBy("item").agg(
        (F.sum(F.when(F.col("option") == F.col("correct"), F.col("_w"))) / F.sum("_w")).alias("correct_prob"),
        (F.min(F.struct((-F.col("score")).alias("s"), F.col("option").alias("o")))["o"] == F.first("correct")).alias("right"),
        F.sum(F.when(F.col("option") == F.col("correct"), F.col("score") if by_length else F.col("score") / F.col("tokens"))).alias("answer"),
    )


def choice_metrics(options: DataFrame, by_length: bool = False) -> DataFrame:
    """One row: items, mean probability of the correct option, accuracy, mean log probability of its tokens."""
    return choice_items(options, by_length).agg(F.count("*").alias("items"), F.avg("correct_prob").alias("mean_prob"), F.avg(F.col("right").cast("double")).alias("accuracy"), F.avg("answer").alias("answer_log_prob"))


def bytes_per_token(texts: DataFrame, text: str = "text", tokens: str = "tokens") -> DataFrame:
    return texts.agg((F.sum(F.octet_length(text)) / F.greatest(F.sum(F.size(tokens)), F.lit(1))).alias("bytes_per_token"))
