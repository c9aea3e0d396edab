"""Mixing sources to target weights by capped water-filling.

Sources get words in proportion to their weights; a source that would be used for more than `epochs` passes is
clamped there and the excess goes to the others by weight, until none is above. Sorted by cap over weight, the
clamped sources are a prefix, so the water level has a closed form over prefix sums of one row per source.

A target is then met by whole passes and a fractional one: the documents that come first by a seeded hash,
until half a document would be too much. The cut is found on sums of 4096 hash buckets per source, and only the
bucket in which it falls is sorted, so a source of any size is never in one task.

Defined results: a null text has size 0; null sources are one source, the last; a null doc_id is hashed like
any other value; repeated rows count and are taken alike; a source of size 0 has target 0; documents of size 0 follow
the passes of their source like any other, and none is taken more often than `epochs`; texts are counted whole, however
long; other columns are kept, under a new name (given_…) where they clash; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import NULL_ID, WORD, written

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Sources up to which their plan, a row of some 100 bytes for each, is broadcast.
FEW_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """16 hexadecimal digits, the order in which a fractional pass takes documents."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 16)


def water_level(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size) with each source's target. One row per source, so the windows are small."""
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank + 1)).withColumn("cap", epochs * F.col("source_size").cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumns(
        {
            "left": F.sum(F.col("source_size").cast("double")).over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    s = s.withColumn("clamped", F.col("ratio") * F.col("open") <= F.col("left"))
    # the first source that isn't clamped sees what is left for it and all after it
    level = F.min_by(F.when(~F.col("clamped"), F.col("left") / F.col("open")), F.when(~F.col("clamped"), F.col("ratio"))).over(everything)
    return s.select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: float = EPOCHS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep_text: bool = True,
) -> DataFrame:
    """The documents with mix_size, mix_source_size, mix_target and mix_repeats: how often the mix takes each.

    keep_text=False leaves the text out of the result, and no text is read twice.
    """
    own = [c for c in docs.columns if keep_text or c != text_col]
    added = {"mix_size": word_count(F.col(text_col)), "_draw": draw(F.col(id_col), seed), "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))}
    if clash := sorted({c.lower() for c in docs.columns} & {*added, "mix_source_size", "mix_target", "mix_repeats", "_whole", "_last", "_last_id", "_source"}):
        docs = docs.select(*[F.col(f"`{c}`").alias(f"given_{c}" if c.lower() in clash else c) for c in docs.columns])
        own = [f"given_{c}" if c.lower() in clash else c for c in own]
    sized = docs.withColumns(added)
    narrow = written(sized.select(*([] if keep_text else [f"`{c}`" for c in own if c not in (source_col,)]), F.col(source_col).alias("_source"), *added), "sizes")
    per = narrow.groupBy("_source", F.substring("_draw", 1, 3).alias("bucket")).agg(F.sum("mix_size").alias("words"))
    sources = written(water_level(per.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size")), weights, share, epochs), "targets")
    targets = sources.select(
        F.col("source").alias("_to"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(epochs)))).otherwise(0).cast("int").alias("_whole"),
    ).withColumn("_part", F.col("mix_target") - F.col("_whole") * F.col("mix_source_size"))
    so_far = Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = per.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0))).join(targets, F.col("_source").eqNullSafe(F.col("_to")))
    # a clamped source has no fractional pass
    cut = cut.where("_part > 0 and before <= _part and _part < before + words").select(F.col("_source").alias("_cut"), "bucket", "before", "_part")
    ahead = Window.partitionBy("_source").orderBy("_draw", "_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = narrow.select("_source", "_draw", "_id", "mix_size").join(cut, F.col("_source").eqNullSafe(F.col("_cut")) & (F.substring("_draw", 1, 3) == F.col("bucket")))
    inside = inside.withColumn("at", F.col("before") + F.coalesce(F.sum("mix_size").over(ahead), F.lit(0)) + F.col("mix_size") / 2).where("at <= _part")
    inside = inside.groupBy("_source").agg(F.max(F.struct("_draw", "_id")).alias("last"))
    last = cut.join(inside, F.col("_cut").eqNullSafe(F.col("_source")), "left").select(
        "_cut", F.coalesce("last._draw", "bucket").alias("_last"), F.coalesce("last._id", F.lit(NULL_ID)).alias("_last_id")
    )
    plan = written(targets.join(last, F.col("_to").eqNullSafe(F.col("_cut")), "left").drop("_cut"), "plan")
    if plan.count() <= FEW_SOURCES:  # else a join, in which Spark splits the sources that many rows have
        plan = F.broadcast(plan)
    rows = sized.withColumn("_source", F.col(source_col)) if keep_text else narrow
    extra = F.coalesce((F.col("_draw") < F.col("_last")) | ((F.col("_draw") == F.col("_last")) & (F.col("_id") <= F.col("_last_id"))), F.lit(False))
    out = rows.join(plan, F.col("_source").eqNullSafe(F.col("_to")), "left").withColumn("mix_repeats", F.col("_whole") + extra.cast("int"))
    shown = [F.col("_source").alias(c) if c == source_col else F.col(f"`{c}`") for c in own]
    return out.select(*shown, "mix_size", "mix_source_size", "mix_target", "mix_repeats")


#: The whole operator with the default parameters in DuckDB SQL, over the view documents.
SQL = f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    substr(sha256(concat('{SEED}:', coalesce(doc_id::varchar, 'null'))), 1, 16) as draw from documents),
named as (
  select source, sum(size)::bigint as source_size, [3.0::double, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from sized group by source),
ratios as (select *, {EPOCHS} * source_size::double as cap, {EPOCHS} * source_size::double / weight as ratio from named),
prefix as (
  select *, sum(source_size::double) over () * {SHARE} - coalesce(sum(cap) over w, 0) as rest, sum(weight) over () - coalesce(sum(weight) over w, 0) as open
  from ratios window w as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
level as (select arg_min(rest / open, ratio) as level from prefix where ratio * open > rest),
targets as (
  select source, source_size, case when ratio * open <= rest then cap else weight * level end as target from prefix cross join level),
passes as (
  select *, case when source_size > 0 then least(floor(target / source_size), {EPOCHS}) else 0 end as whole from targets),
ahead as (
  select doc_id, source, size, coalesce(sum(size) over (partition by source order by draw, doc_id rows between unbounded preceding and 1 preceding), 0) as before from sized)
select doc_id, size, source_size, target, (size * (whole + case when before + size / 2.0 <= target - whole * source_size then 1 else 0 end))::bigint as taken
from ahead join passes on ahead.source is not distinct from passes.source
"""
