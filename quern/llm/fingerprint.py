"""SimHash document fingerprints and the search for near ones, in DataFrame functions only.

Terms are the words of a text (A-Z lower-cased), weighted by their length up to 12 code points, so that the
short words that all texts share count little. Each term's XXH64 votes with its weight on 64 signed bits. Two
32-bit lanes share a 64-bit sum, so a fingerprint is 33 sums in one hash aggregation, without a shuffle of its
own where rows are already together.

Near fingerprints are found in permuted block tables: with radius + 2 blocks, any two within the radius agree
in two blocks at least, so every pair of blocks leads one table, and a table's equal leads are compared; a pair is of the
first table in which it agrees. Copies are one fingerprint. Pairs are asked for by queries, a part of the fingerprints
(by default those of documents whose id is divisible by EVERY), so that a group of near copies is not all its pairs.

Defined results: a null text is empty and has fingerprint zero, as has any text without words; a null doc_id
comes before all others and is no query; rows that share a doc_id follow each other in the order of their texts' hashes;
texts are read whole, however long; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import id_back, keyed, written

HEAVIEST = 12
#: Documents in a stretch of the order by doc_id, and stretches at most.
STRETCH, STRETCHES = 2000, 100_000
#: Bits in which near fingerprints may differ, and one in how many identifiers is a query.
RADIUS, EVERY = 3, 50
_LANES = 0x0000000100000001


def terms(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(F.translate(lower, "\t\n\x0b\x0c\r", "     "), " +")


def votes(weight: Column, h: Column) -> list[Column]:
    """Sums for fingerprint_of: bit i and bit i + 32 of the hashes in one sum each, then the weights."""
    lanes = [F.sum(weight * F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_LANES))).alias(f"v{i}") for i in range(32)]
    return [*lanes, F.sum(weight).alias("all")]


def fingerprint_of() -> Column:
    """The 64-bit fingerprint of the sums that votes() made: bits that have over half the weight."""
    out = F.lit(0).cast("long")
    for i in range(32):
        low = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("all")
        high = F.shiftrightunsigned(f"v{i}", 32) * 2 > F.col("all")
        out = out.bitwiseOR(F.when(low, F.lit(1 << i)).otherwise(F.lit(0)))
        out = out.bitwiseOR(F.when(high, F.lit((1 << (i + 32)) - (1 << 64 if i == 31 else 0))).otherwise(F.lit(0)))
    return out


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the differing bits tell of, 0 at the least."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * (math.pi / 64)))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def stretches(docs: DataFrame) -> tuple[Column, Column, int]:
    """For rows with k: the number of each one's stretch of the order by k, whether k is the least in it, and the last number.

    Bounds are quantiles, STRETCHES at most, and looked up by bisection.
    """
    n = docs.select(F.count(F.lit(1))).first()[0]
    many = max(1, min(math.ceil(n / STRETCH), STRETCHES))
    bounds, least = [], None
    if n:
        at = [i / many for i in range(1, many)]
        asked = [F.min("k").alias("least")] + ([F.percentile_approx("k", at, max(10_000, 10 * many)).alias("at")] if at else [])
        row = docs.select(*asked).first()
        least = row["least"]
        bounds = sorted({x for x in (row["at"] if at else []) if x > least})
    held = F.split(F.lit(",".join(map(str, [least or 0, *bounds]))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))]) if bounds else F.array().cast("array<int>")
    number = F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.coalesce(F.get(held, p + s) <= F.col("k"), F.lit(False)), p + s).otherwise(p))
    return number, F.get(held, F.col("stretch")) == F.col("k"), len(bounds)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp) of every text, of the text with its last quarter replaced by the
    beginning of the next document's, and of that next document; after the last comes the first."""
    base = keyed(docs, id_col, text_col)
    number, first, last = stretches(base)
    rows = base.withColumn("stretch", number).withColumn("first", first)
    before = F.when(F.col("stretch") == 0, F.lit(last)).otherwise(F.col("stretch") - 1)
    # the first document of a stretch also ends the stretch before it, to be the next one there
    places = F.when(F.col("first"), F.array(F.struct(F.col("stretch").alias("s"), F.lit(False).alias("tail")), F.struct(before.alias("s"), F.lit(True).alias("tail"))))
    places = places.otherwise(F.array(F.struct(F.col("stretch").alias("s"), F.lit(False).alias("tail"))))
    rows = rows.select("k", "text", F.explode(places).alias("p")).select("k", "text", "p.s", "p.tail")
    order = Window.partitionBy("s").orderBy("tail", "k", "h")
    rows = rows.withColumn("h", F.xxhash64("text")).select("s", "k", "tail", "text", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("follows"))
    n = F.length("text")
    quarter = F.floor(n / 4)
    edited = F.when(F.col("tail"), F.lit("")).otherwise(F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("follows", "text"), F.lit(1), quarter)))
    rows = rows.select("s", "at", "k", "tail", "text", n.cast("long").alias("n_chars"), edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    own = ["s", "at", "k", "tail", "n_chars", "edited_sha256"]
    both = rows.select(*own, F.posexplode(F.array("text", "edited")).alias("which", "version"))
    words = both.select(*own, "which", F.explode(terms(F.col("version"))).alias("term"))
    weight = F.least(F.length("term"), F.lit(HEAVIEST)).cast("long")  # an empty string between spaces weighs nothing
    sums = words.select(*own, "which", weight.alias("w"), F.xxhash64("term").alias("h")).groupBy(*own, "which").agg(*votes(F.col("w"), F.col("h")))
    each = sums.select(*own, "which", fingerprint_of().alias("fp")).groupBy(*own).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    out = each.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("s").orderBy("at"))).where(~F.col("tail"))
    return out.select(id_back(name=id_col), "n_chars", "edited_sha256", "fp", "edited_fp", F.coalesce("next_fp", "fp").alias("next_fp"))


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, fp: str = "fp", queries: DataFrame | None = None) -> DataFrame:
    """(fp, other_fp, distance) for all pairs of different fingerprints within the radius, from permuted block tables; with queries (fp), the pairs of each query with any other."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = lambda c, i: F.shiftrightunsigned(c, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    tables = list(combinations(range(blocks), 2))
    leads = F.array(*[F.struct(F.lit(t).alias("t"), part("x", i).alias("a"), part("x", j).alias("b")) for t, (i, j) in enumerate(tables)])
    led = lambda df: df.select(F.col(fp).cast("long").alias("x")).where("x is not null").distinct().select("x", F.explode(leads).alias("lead"))
    left, right = led(prints if queries is None else queries).alias("l"), led(prints).select(F.col("x").alias("y"), F.col("lead").alias("other")).alias("r")
    apart = F.col("x").bitwiseXOR(F.col("y"))
    distance = F.bit_count(apart).cast("int")
    first = F.lit(False)
    for t, (i, j) in enumerate(tables):
        first = first | ((F.col("lead.t") == t) & reduce(lambda p, q: p & q, [part(apart, k) != 0 for k in range(j) if k != i], F.lit(True)))
    once = F.col("x") < F.col("y") if queries is None else F.col("x") != F.col("y")
    pairs = left.join(right, (F.col("lead") == F.col("other")) & once & (distance <= radius) & first)
    return pairs.select(F.col("x").alias(fp), F.col("y").alias(f"other_{fp}"), distance.alias("distance"))


def with_near(prints: DataFrame, radius: int = RADIUS, every: int = EVERY, id_col: str = "doc_id") -> DataFrame:
    """document_fingerprints() with n_near: for documents whose id is divisible by `every`, the number of others with a fingerprint within the radius; else null."""
    prints = written(prints, "fingerprints")
    asked = F.col(id_col) % every == 0
    queries = written(prints.where(asked).select("fp").distinct(), "queries")
    have = written(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "counts")
    pairs = near_fingerprints(have, radius, "fp", queries).select("fp", "other_fp").union(queries.select("fp", F.col("fp").alias("other_fp")))
    near = pairs.join(have.withColumnRenamed("fp", "other_fp"), "other_fp").groupBy("fp").agg((F.sum("n") - 1).alias("n_near"))
    return prints.join(near, "fp", "left").select(*prints.columns, F.when(asked, F.col("n_near")).alias("n_near"))
