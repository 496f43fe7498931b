"""Token-level distributions to per-step statistics and per-response confidence metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The metrics' names in their contractual order.
METRICS = (
    "generation_mean_logprob generation_mean_prob generation_mean_nll generation_ppl generation_min_logprob generation_max_logprob "
    "generation_std_logprob generation_min_k_logprob generation_mean_entropy generation_mean_top1_prob generation_mean_top2_margin "
    "generation_frac_selected_is_top1 generation_frac_high_conf_tokens generation_frac_low_conf_tokens"
).split()


def log_softmax(logits: Column) -> Column:
    """By subtraction of the maximum; never the logarithm of a probability."""
    x = F.transform(logits, lambda v: v.cast("double"))
    bound = F.struct(x.alias("x"), F.array_max(x).alias("m"))
    shifted = F.transform(F.array(bound), lambda b: F.transform(b["x"], lambda v: v - b["m"]))[0]
    total = F.transform(F.array(shifted), lambda s: F.struct(s.alias("s"), F.log(F.aggregate(s, F.lit(0.0), lambda a, v: a + F.exp(v))).alias("z")))
    return F.transform(total, lambda t: F.transform(t["s"], lambda v: v - t["z"]))[0]


def step_stats(steps: DataFrame) -> DataFrame:
    """Adds ``log_prob, prob, entropy, top1_prob, top1_id, margin, is_top1`` to rows with ``logits`` and ``token``.

    The selected token is a column of the row, so nothing is pending between steps.
    """
    lp = steps.withColumn("_lp", log_softmax(F.col("logits")))
    top = F.sort_array("_lp", asc=False)
    d = lp.withColumns({
        "log_prob": F.element_at("_lp", F.col("token").cast("int") + 1),
        "entropy": -F.aggregate("_lp", F.lit(0.0), lambda a, v: a + F.nanvl(F.exp(v) * v, F.lit(0.0))),
        "_t1": F.element_at(top, 1), "_t2": F.element_at(top, 2),
        "top1_id": (F.array_position("_lp", F.array_max("_lp")) - 1).cast("long"),
    })
    return d.withColumns({"prob": F.exp("log_prob"), "top1_prob": F.exp("_t1"), "margin": F.exp("_t1") - F.exp("_t2"), "is_top1": F.col("top1_id") == F.col("token")}).drop("_lp", "_t1", "_t2")


def valid_token(token: Column, pad: int, eos: list[int]) -> Column:
    return (token != pad) & ~token.isin(*eos) if eos else token != pad


def generation_metrics(steps: DataFrame, key: str, *, low: float = 0.1, high: float = 0.9, fraction: float = 0.2) -> DataFrame:
    """(key, generation_num_tokens, METRICS) from step rows; ``valid`` marks the tokens that count.

    A response without valid tokens has count 0 and NaN elsewhere. Deviations are population ones. Min-K
    is the mean of the max(1, ceil(n * fraction)) smallest log probabilities; comparisons are inclusive
    and NaN is never high or low. A mean log probability that isn't finite has no NLL and no perplexity.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    v = F.col("valid")
    pick = lambda c: F.when(v, F.col(c))
    share = lambda cond: F.avg(F.when(v, cond.cast("double")))
    p = F.col("prob")
    g = steps.groupBy(key).agg(
        F.count_if(v).alias("generation_num_tokens"), F.avg(pick("log_prob")).alias("_mean"), F.min(pick("log_prob")).alias("_min"), F.max(pick("log_prob")).alias("_max"),
        F.stddev_pop(pick("log_prob")).alias("_std"), F.sort_array(F.collect_list(pick("log_prob"))).alias("_all"), F.avg(pick("prob")).alias("_mp"),
        F.avg(pick("entropy")).alias("_me"), F.avg(pick("top1_prob")).alias("_t1"), F.avg(pick("margin")).alias("_t2"), share(F.col("is_top1")).alias("_f1"),
        share(~F.isnan(p) & (p >= high)).alias("_fh"), share(~F.isnan(p) & (p <= low)).alias("_fl"),
    )
    k = F.greatest(F.lit(1), F.ceil(F.size("_all") * F.lit(fraction)).cast("int"))
    mink = F.aggregate(F.slice("_all", F.lit(1), k), F.lit(0.0), lambda a, x: a + x) / F.least(k, F.greatest(F.size("_all"), F.lit(1)))
    finite = ~F.isnan("_mean") & (F.abs("_mean") != float("inf"))
    nll = F.when(finite, -F.col("_mean"))
    values = [F.col("_mean"), F.col("_mp"), nll, F.exp(nll), F.col("_min"), F.col("_max"), F.col("_std"), F.when(F.size("_all") > 0, mink), *map(F.col, ("_me", "_t1", "_t2", "_f1", "_fh", "_fl"))]
    return g.select(key, "generation_num_tokens", *[F.coalesce(x, F.lit(float("nan"))).alias(n) for n, x in zip(METRICS, values)])
