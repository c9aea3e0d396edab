"""Scores of predictions: per sample, by overlapping keys, with confidence, and between runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import rules as R
from quern.functions import passes as P
from quern.functions import text as T
from quern.operators.profile import ends_of_series, repeat_ratio


def scored(pairs: DataFrame, pred: str = "pred", ref: str = "ref", question: str = "question") -> DataFrame:
    """pairs with bucket, token_f1, rouge_l and accuracy; a metric that doesn't apply is null. Columns type and source, if there are any, tell the bucket first."""
    told = {k: F.col(c) if c in pairs.columns else None for k, c in (("kind", "type"), ("source", "source"))}
    b = T.bucket(question, ref, **told)
    a, c = T.option_letter(pred), T.option_letter(ref)
    y, z = T.yes_no(pred), T.yes_no(ref)
    out = pairs.withColumn("bucket", b)
    is_open = F.col("bucket") == "open"
    hit = F.when(F.col("bucket") == "mcqa", F.coalesce(a == c, F.lit(False))).when(F.col("bucket") == "yesno", F.coalesce(y == z, F.lit(False)))
    return out.withColumns({"accuracy": hit.cast("double"), "token_f1": F.when(is_open, T.token_f1(pred, ref)), "rouge_l": F.when(is_open, P.rouge(F.col(pred), F.col(ref)))})


def long_scores(df: DataFrame, index: str, keys: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """(index, keys, metric, score), a row for each score that there is."""
    stack = ", ".join(f"'{m}', {m}" for m in metrics)
    return df.select(index, *keys, F.expr(f"stack({len(metrics)}, {stack}) as (metric, score)")).where("score is not null")


def by_keys(long: DataFrame, bucket: str = "bucket", lang: str = "lang") -> DataFrame:
    """(key, metric, mean, n) by bucket, bucket and language, language, and overall, from one grouping-sets aggregation."""
    long.createOrReplaceTempView("quern_long_scores")
    key = f"""case when grouping({bucket}) = 0 and grouping({lang}) = 0 then concat('bucket:', {bucket}, '|lang:', {lang}) when grouping({bucket}) = 0 then concat('bucket:', {bucket})
              when grouping({lang}) = 0 then concat('lang:', {lang}) else 'overall' end"""
    return long.sparkSession.sql(
        f"""select {key} as key, metric, avg(score) as mean, count(*) as n from quern_long_scores
            group by grouping sets ((metric, {bucket}), (metric, {bucket}, {lang}), (metric, {lang}), (metric))"""
    )


def bootstrap(long: DataFrame, by: tuple[str, ...], rounds: int = 2000, low: float = 0.025, high: float = 0.975, seed: int = R.SEED) -> DataFrame:
    """(by, n, mean, low, high): percentile interval of the mean. Every row weighs Poisson(1) in each round, drawn from its own hash, so
    rows are read once and tasks hand on sums, a row for each group. A round in which no row weighs anything has no mean."""

    def sums(batches):
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for group, part in pdf.groupby(list(by), dropna=False, sort=False) if by else [((), pdf)]:
                group = group if isinstance(group, tuple) else (group,)
                total = held.setdefault(group, np.zeros((2, rounds + 1)))
                for h, x in zip(part["_h"], part["score"], strict=True):
                    w = np.concatenate([[1], np.random.default_rng([seed, h & (2**63 - 1)]).poisson(1, rounds)])
                    total[0] += w
                    total[1] += w * x
        yield pd.DataFrame([dict(zip(by, g, strict=True)) | {"w": t[0].tolist(), "wx": t[1].tolist()} for g, t in held.items()], columns=[*by, "w", "wx"])

    kinds = "".join(f"{b} {long.schema[b].dataType.simpleString()}, " for b in by)
    rows = long.select(*by, F.col("score").cast("double").alias("score"), F.xxhash64(*long.columns).alias("_h"))
    part = rows.mapInPandas(sums, f"{kinds}w array<double>, wx array<double>").select(*by, F.posexplode(F.arrays_zip("w", "wx")).alias("round", "s"))
    total = part.groupBy(*by, "round").agg(F.sum("s.w").alias("w"), F.sum("s.wx").alias("wx")).withColumn("mean", F.try_divide("wx", "w"))
    drawn = F.array_sort(F.collect_list(F.when(F.col("round") > 0, F.col("mean"))))
    out = total.groupBy(*by).agg(F.max(F.when(F.col("round") == 0, F.col("w"))).cast("long").alias("n"), F.max(F.when(F.col("round") == 0, F.col("mean"))).alias("mean"), drawn.alias("d"))
    at = lambda p: F.get("d", F.floor(p * (F.size("d") - 1)).cast("int"))
    return out.select(*by, "n", "mean", at(low).alias("low"), at(high).alias("high"))


def paired_bootstrap(a: DataFrame, b: DataFrame, index: str, by: tuple[str, ...] = (), **more) -> DataFrame:
    """The interval of the mean difference b - a over samples that both have, and whether it leaves out 0."""
    d = a.select(index, *by, F.col("score").alias("_a")).join(b.select(index, *by, F.col("score").alias("_b")), [index, *by]).select(index, *by, (F.col("_b") - F.col("_a")).alias("score"))
    return bootstrap(d, by, **more).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def run_deltas(runs: DataFrame, suffix: str = "_finetuned", base: str = "_baseline", target: float = R.TARGET_SCORE) -> DataFrame:
    """(label, key, metric, value, base_value, delta, reached) for each run whose label has the suffix; base values are null without a base run."""
    own = runs.where(F.col("label").endswith(suffix)).withColumn("base_label", F.regexp_replace("label", f"{suffix}$", base))
    other = runs.select(F.col("label").alias("base_label"), "key", "metric", F.col("value").alias("base_value"))
    out = own.join(other, ["base_label", "key", "metric"], "left")
    return out.select("label", "key", "metric", "value", "base_value", (F.col("value") - F.col("base_value")).alias("delta"), (F.col("value") >= target).alias("reached"))


def quantisation_gap(runs: DataFrame, suffix: str = "_q4") -> DataFrame:
    """run_deltas() of quantised runs against the run of the same label without the suffix; runs without one are left out."""
    return run_deltas(runs, suffix, "").where("base_value is not null")


def small_cells(cells: DataFrame, n: str = "n", least: int = R.SMALL_CELL) -> DataFrame:
    return cells.where(F.col(n) < least)


def best_checkpoint(log: DataFrame, step: str, loss: str, run: str) -> DataFrame:
    """(run, step, loss) with the least loss of each run, the earliest of equals."""
    row = F.struct(F.col(loss).alias(loss), F.col(step).alias(step))
    return log.where(F.col(loss).isNotNull()).groupBy(run).agg(F.min(row).alias("r")).select(run, f"r.{step}", f"r.{loss}")


def spot_check_rates(forms: DataFrame, model: str, flags: tuple[str, ...]) -> DataFrame:
    """(model, n, a rate for each flag) of human judgements."""
    return forms.groupBy(model).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags])


def pilot_checks(log: DataFrame, outputs: DataFrame, step: str, loss: str, text: str, language_ok: str, share: float = 0.2, most: float = 0.3, least: float = 0.9) -> DataFrame:
    """(check, passed) of a short training run: the loss falls, stays finite and doesn't explode, answers are in the language and don't repeat."""
    ends = ends_of_series(log, step, loss, share)
    whole = log.agg(F.bool_and(F.col(loss).isNotNull() & ~F.isnan(loss) & (F.abs(loss) < float("inf"))).alias("finite"), F.max(loss).alias("highest"), F.min_by(loss, step).alias("begin"))
    texts = outputs.agg(F.avg(F.col(language_ok).cast("double")).alias("in_language"), F.max(repeat_ratio(T.words(text, "[a-z0-9]+"))).alias("repeats"))
    row = ends.join(F.broadcast(whole), F.lit(True)).join(F.broadcast(texts), F.lit(True))
    made = row.select((F.col("last") < F.col("first")).alias("trend"), (F.col("highest") <= 2 * F.col("begin")).alias("no_explosion"), "finite", (F.col("in_language") >= least).alias("language"), (F.col("repeats") <= most).alias("no_repeats"))
    return made.select(F.expr("stack(5, 'trend', trend, 'no_explosion', no_explosion, 'finite', finite, 'language', language, 'no_repeats', no_repeats) as (check, passed)"))
