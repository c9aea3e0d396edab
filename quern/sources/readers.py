"""Readers with declared schemas, and adapters of each source to questions and answers.

Columns that a source names in different ways are looked for in a stated order; strings that stand for nothing
('nan', 'none', '') are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import rules as R
from quern.functions import passes as P
from quern.operators.selection import first_rows, sample

MESSAGE = "array<struct<role: string, content: string>>"
CHAT = f"messages {MESSAGE}, source string"
CHAT_SCORED = f"messages {MESSAGE}, domain string, type string, source string, source_lang string, translated boolean, quality_score double, relevance double"
QA_CSV = "title string, question string, answer string, question_clean string, answer_clean string"
POOL = "q string, a string, title string, scores struct<lang: double, len: double, relevance: double, medical: double, coherence: double, composite: double>"
RUN = "label string, model string, model_type string, metrics map<string, map<string, double>>, examples array<struct<bucket: string, lang: string, pred: string, ref: string>>"


def value(c: str) -> Column:
    t = F.trim(F.col(c).cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "none"), t)


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that the table has, null where all are."""
    found = [value(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def json_lines(spark: SparkSession, path: str, schema: str = CHAT, limit: int | None = None) -> DataFrame:
    """Blank lines are skipped; a line that is no JSON raises."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.limit(limit) if limit else df


def csv_table(spark: SparkSession, path: str, schema: str = QA_CSV, columns: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """A CSV file with a header, quotes and line ends in fields; only the columns asked for."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit else df


def nested_questions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents that are a list of questions or have one under `questions`; files that are not there are skipped.

    ideal and exact answers come as JSON text, since they may be strings, lists or lists of lists.
    """
    text = spark.read.option("wholetext", True).option("ignoreMissingFiles", True).text(paths)
    one = "array<struct<body: string, type: string, ideal_answer: variant, exact_answer: variant>>"
    root = F.when(F.trim("value").startswith("["), F.from_json("value", one)).otherwise(F.from_json("value", f"questions {one}")["questions"])
    q = text.select(F.explode(root).alias("q"))
    return q.select("q.body", "q.type", F.to_json("q.ideal_answer").alias("ideal_answer"), F.to_json("q.exact_answer").alias("exact_answer"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def parquet_or_json(spark: SparkSession, path: str) -> DataFrame | None:
    """A data set that was fetched before; None if it isn't there."""
    if not exists(spark, path):
        return None
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def sheet(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A spreadsheet by its CSV export; all columns are strings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return df.select(*[value(c).alias(f.name) for c, f in zip(columns, schema, strict=True)])


def prefix(df: DataFrame, key: str, n: int) -> DataFrame:
    return first_rows(df, [F.col(key).asc()], n)


def pool(spark: SparkSession, paths: list[str], schema: str = POOL) -> DataFrame:
    """The first path that is there, or the union of the later ones."""
    found = [p for p in paths if exists(spark, p)]
    if not found:
        raise FileNotFoundError(", ".join(paths))
    tables = [json_lines(spark, p, schema) for p in (found[:1] if found[0] == paths[0] else found)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def latest(spark: SparkSession, pattern: str) -> DataFrame:
    """The file of the greatest name that fits the pattern, as lines; only that one is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    paths = sorted(x.getPath().toString() for x in found or [])
    if not paths:
        raise FileNotFoundError(pattern)
    return spark.read.text(paths[-1]).select("value")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """(label, key, metric, value) of all run files in a folder; files of predictions are left out."""
    df = spark.read.schema(RUN).option("multiLine", True).json(folder).where(~F.col("_metadata.file_name").startswith("preds_"))
    return df.select("label", F.explode("metrics").alias("key", "m")).select("label", "key", F.explode("m").alias("metric", "value"))


def questions_csv(df: DataFrame, key: Column, question: int = R.SOURCE_QUESTION_CHARS, answer: tuple[int, int] = R.SOURCE_ANSWER_CHARS, reject: str | None = R.NOT_ANSWER, n: int | None = None) -> DataFrame:
    """(q, a) of a table of questions, cleaned: questions of some length, answers within two, no echo, no users' follow-ups, one row per question, n of them."""
    rows = df.select(first_of(df, "question_clean", "question").alias("q"), first_of(df, "answer_clean", "answer").alias("a"), key.alias("_k")).where("q is not null and a is not null")
    rows = rows.select(P.source_cleaned(F.col("q")).alias("q"), P.source_cleaned(F.col("a")).alias("a"), "_k")
    rows = rows.where((F.length("q") >= question) & F.length("a").between(*answer) & (F.col("q") != F.col("a")))
    if reject:
        rows = rows.where(~F.col("a").rlike(reject))
    rows = rows.groupBy("q").agg(F.min_by("a", "_k").alias("a"))
    return sample(rows, n, "q") if n else rows


def any_layout(df: DataFrame) -> DataFrame:
    """(q, a) of a table in one of four layouts: question and answer, instruction and output, prompt and completion, messages."""
    q, a = first_of(df, "question", "input", "instruction", "prompt"), first_of(df, "answer", "output", "response", "completion")
    if "messages" in df.columns:
        of = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), 0)["content"]
        q, a = F.coalesce(q, of("user")), F.coalesce(a, of("assistant"))
    if not {"question", "input", "instruction", "prompt", "messages"} & set(df.columns):
        raise ValueError(f"no known layout in {df.columns}")
    return df.select(q.alias("q"), a.alias("a")).where("q is not null and a is not null")
