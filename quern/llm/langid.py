"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts become code points, A-Z and the Latin-1 capitals lower-cased and all else but letters of that range made
one blank; the n-grams of each order are hashed into a fixed number of bins. Training counts bins for each
language in the tasks and adds up the counts; the matrix of log-probabilities is broadcast, which its size,
at most LANGUAGES times bins, bounds; with more languages there is a matrix, and a pass, for each so many, and the best
of all passes is told. Texts are scored by gathers of a bounded number of rows and a sum per text, however long a text is.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if nothing could be
learned; a null doc_id is never held out and never learned from; repeated rows get equal results; texts are read whole,
however long; texts shorter
than the n-grams are told by the prior; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import buffers, column, few_rows, slices

ORDERS, BINS, SMOOTH = (2, 3), 1 << 15, 0.5
#: Bound of the training sample: about so many labelled rows of each language, chosen by hash; all if there are fewer.
SAMPLE = 5000
#: Languages of one matrix; with BINS it bounds what is broadcast. Numbers that a gather holds at once.
LANGUAGES, GATHERED = 200, 1 << 22

_M = np.uint32(0x9E3779B1)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and code points of texts, normalised."""
    at, data = buffers(texts)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    upper = (points >= 65) & (points <= 90) | (points >= 0xC0) & (points <= 0xDE) & (points != 0xD7)
    points[upper] += 32
    points[(points < 97) | (points > 122) & (points < 0xAA)] = 32
    return lead[at], points


def grams(bounds: np.ndarray, points: np.ndarray, order: int) -> np.ndarray:
    """The bin of the n-gram that begins at each code point; BINS, an empty bin, where it would leave the text."""
    n = len(points)
    if n < order:
        return np.full(n, BINS, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n - order + 1, order, np.uint32)
        for i in range(order):
            h = (h ^ points[i : n - order + 1 + i]) * _M
            h ^= h >> np.uint32(15)
    out = np.full(n, BINS, np.int64)
    out[: n - order + 1] = h % np.uint32(BINS)
    for i in range(1, order):
        out[np.maximum(bounds[1:] - i, bounds[:-1])[np.diff(bounds) > 0]] = BINS
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Languages, and log-probabilities of bins (rows) by language (columns); the last row is the empty bin."""

    def __init__(self, names: list[str], prior: np.ndarray, logs: np.ndarray):
        self.names, self.prior, self.logs = names, prior, logs

    def score(self, texts: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Of each text the best language, null without a letter, its log-probability, and the logarithm of the sum of all."""
        bounds, points = code_points(texts)
        total = np.tile(self.prior, (len(bounds) - 1, 1))
        step = max(1, GATHERED // len(self.names))
        for order in ORDERS:
            bins = grams(bounds, points, order)
            for begin in range(0, len(points), step):
                end = min(begin + step, len(points))
                edge = np.clip(bounds, begin, end)
                full = np.flatnonzero(np.diff(edge))
                total[full] += np.add.reduceat(self.logs[bins[begin:end]], edge[:-1][full] - begin, axis=0, dtype=np.float64)
        known = letters(bounds, points, texts)
        top = total.max(1)
        with np.errstate(under="ignore"):
            all_ = top + np.log(np.exp(total - top[:, None]).sum(1))
        return [self.names[b] if ok else None for b, ok in zip(total.argmax(1).tolist(), known.tolist(), strict=True)], top, all_


def letters(bounds: np.ndarray, points: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.concatenate([[0], np.cumsum((points >= 97) & (points <= 122))])
    has = total[bounds[1:]] > total[bounds[:-1]]
    for i in np.flatnonzero(~has & (np.diff(bounds) > 0)):
        has[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return has


def fit(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[Model]:
    """Models of rows with a language, LANGUAGES in each: about `sample` rows of each language, chosen by a hash of id_col, and whole texts."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    names = sorted(counts)
    return [_fit(rows, names[at : at + LANGUAGES], counts, sample, id_col, text_col, lang_col) for at in range(0, len(names), LANGUAGES)]


def _fit(rows: DataFrame, names: list[str], counts: dict[str, int], sample: int, id_col: str, text_col: str, lang_col: str) -> Model:
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, sample / counts[n]))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(10)), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(draw < F.element_at(share, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        held = np.zeros((len(names), BINS + 1), np.int64)
        number = {n: i for i, n in enumerate(names)}
        for batch in batches:
            for part in slices(batch, "text"):
                bounds, points = code_points(column(part, "text"))
                lang = np.repeat([number[x] for x in column(part, "lang").to_pylist()], np.diff(bounds))
                for order in ORDERS:
                    held += np.bincount(lang * (BINS + 1) + grams(bounds, points, order), minlength=held.size).reshape(held.shape)
        lang, bin_ = np.nonzero(held[:, :BINS])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bin_, pa.int32()), pa.array(held[lang, bin_])], ["lang", "bin", "n"])

    # a bounded sample, so a fixed number of tasks; the sums are languages times bins rows at most
    table = chosen.repartition(12).mapInArrow(count, "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((BINS + 1, len(names)))
    n[table.column("bin").to_numpy(), table.column("lang").to_numpy()] = table.column("n").to_numpy()
    n[:BINS] += SMOOTH
    logs = np.zeros((BINS + 1, len(names)), np.float32)
    logs[:BINS] = np.log(n[:BINS] / n[:BINS].sum(0))
    return Model(names, np.log(np.array([counts[x] for x in names]) / sum(counts.values())), logs)


def predict(docs: DataFrame, models: list[Model], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, lang_pred and score of every whole text; only the text is looked at."""
    few_rows(docs.sparkSession)
    names = [f"c{i}" for i in range(len(keep))]
    text = names[keep.index(text_col)] if text_col in keep else "the_text"
    best = [F.lit(None).cast("string").alias("best"), F.lit(float("-inf")).alias("top"), F.lit(float("-inf")).alias("all")]
    told = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], *([] if text_col in keep else [F.col(text_col).alias("the_text")]), *best)

    def scored(model, given):
        held = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            for batch in batches:
                parts = [held.value.score(column(part, text)) for part in slices(batch, text, 1 << 19)]
                name = [x for p in parts for x in p[0]]
                top, all_ = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in (1, 2))
                before = column(batch, "top").to_numpy()
                own = [n if a > b else o for n, o, a, b in zip(name, column(batch, "best").to_pylist(), top, before, strict=True)]
                # one batch out for one in: the columns that pass through are not cut
                put = {"best": pa.array(own, pa.string()), "top": pa.array(np.maximum(top, before)), "all": pa.array(np.logaddexp(all_, column(batch, "all").to_numpy()))}
                yield pa.RecordBatch.from_arrays([put[n] if n in put else column(batch, n) for n in given], given)

        return run

    for i, model in enumerate(models, 1):
        # the text goes on to the next model, and out only if it is kept
        given = T.StructType([f for f in told.schema if i < len(models) or f.name != "the_text"])
        told = told.mapInArrow(scored(model, given.names), given)
    score = F.when(F.col("best").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("top") - F.col("all"))))
    return told.select(*names, F.coalesce("best", F.lit("und")).alias("lang_pred"), score.alias("score")).toDF(*keep, "lang_pred", "score")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, keep: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out, told of all."""
    out = held_out(F.col(id_col))
    models = fit(docs.where(~out & F.col(id_col).isNotNull()), sample, id_col, text_col, lang_col)
    return predict(docs.withColumn("held_out", out), models, text_col, keep or (id_col, "held_out"))
