"""Queries that make questions of records, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import rules as R
from quern.operators import gates as G
from quern.plans import samples
from quern.plans.tables import PAIRS, table
from quern.plans.tables import pairs as table_pairs
from quern.sources import adapters as A
from quern.sources import builders as B
from quern.sources import readers
from quern.streaming import gates as stream


def code_questions(spark, d):
    """Parts as a sheet of codes, with blocks, missing codes, short titles, an extension chapter and notes of several lengths among them."""
    k = F.col("p_partkey")
    chapter = F.when(k % 23 == 0, "X").when(k % 19 == 0, " V ").otherwise(F.lpad((k % 29).cast("string"), 2, "0"))
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(k % 13 > 0, F.concat(F.lit(" C"), k.cast("string"))).alias("code"), F.when(k % 17 == 0, "-- ab").otherwise(F.concat(F.lit("- - "), "p_name")).alias("title"), chapter.alias("chapter"),
        F.when(k % 3 == 0, F.concat("p_name", F.lit(" of the "), "p_brand", F.lit(" "))).when(k % 3 == 1, F.col("p_brand")).alias("note"), F.when(k % 11 == 0, "block").otherwise("category").alias("kind"),
    )
    return B.code_templates(B.code_rows(rows, "code", "title", "chapter", "note", "kind", ("p_partkey",)), ("p_partkey",))


_CHAPTERS = ", ".join(f"('{k}', '{v}')" for k, v in R.CHAPTERS.items())
_CODES = f"""with s as (select p_partkey, 'C' || p_partkey as code, p_name as title, case when p_partkey % 19 = 0 then 'V' else lpad((p_partkey % 29)::varchar, 2, '0') end as chapter, case p_partkey % 3 when 0 then p_name || ' of the ' || p_brand when 1 then p_brand else '' end as note
from part where p_partkey % 11 > 0 and p_partkey % 13 > 0 and p_partkey % 23 > 0 and p_partkey % 17 > 0 and length(p_name) > 3),
r as (select s.*, coalesce(c.name, 'Unknown chapter') as name from s left join (values {_CHAPTERS}) as c(chapter, name) using (chapter))
select p_partkey, 'What is the ICD-11 code for ' || title || '?' as q, 'The ICD-11 code for **' || title || '** is **' || code || '**. It is classified under Chapter ' || chapter || ': ' || name || '.' as a from r
union all select p_partkey, 'A patient has been diagnosed with ICD-11 code ' || code || '. What condition does this represent?', 'ICD-11 code **' || code || '** represents **' || title || '**. This condition is classified under Chapter ' || chapter || ': ' || name
  || ' in the ICD-11 international classification system. For detailed clinical information and patient-specific advice, please consult a qualified healthcare professional.' from r
union all select p_partkey, 'Describe ' || title || ' according to ICD-11 classification guidelines.', '**' || title || '** (ICD-11: ' || code || ') — ' || note || ' This condition falls under Chapter ' || chapter || ': ' || name || '.' from r where length(note) > 20"""


def indicator_questions(spark, d):
    """Nations as indicators, what is known of them told in several ways and not at all."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    rows = n.select(
        "n_nationkey", F.when(k % 8 == 7, "nan").otherwise(F.concat(F.lit(" "), "n_name")).alias("name"), F.when(k % 5 > 0, F.col("r_name")).alias("topic"), F.when(k % 3 > 0, "the census").otherwise("").alias("data"),
        F.when(k % 2 > 0, "year ").otherwise("NaN").alias("dimension"), F.when(k % 7 > 0, F.substring("n_name", 1, 3)).alias("short"), F.when(k % 4 > 0, k.cast("string")).alias("data_id"),
    )
    return B.indicator_templates(rows, "name", "topic", "data", "dimension", "short", "data_id", ("n_nationkey",))


_INDICATORS = """with r as (select n_nationkey, n_name as name, r_name as topic, substr(n_name, 1, 3) as short from nation join region on n_regionkey = r_regionkey where n_nationkey % 8 <> 7)
select n_nationkey, 'What does the health indicator ''' || short || ''' measure?' as q, 'The indicator ''' || short || ''' measures **' || name || '**' || case when n_nationkey % 2 > 0 then ', categorized under the dimension: year.' else '.' end as a from r where n_nationkey % 7 > 0
union all select n_nationkey, 'Which dataset covers the health indicator ''' || name || '''?', 'The indicator **' || name || '** is covered by the **the census** dataset' || case when n_nationkey % 4 > 0 then ' (ID: ' || n_nationkey || ')' else '' end || '.' from r where n_nationkey % 3 > 0
union all select n_nationkey, 'What topic area does ''' || name || ''' fall under in WHO HIDR?', '**' || name || '** falls under the **''' || topic || '''** topic area in the WHO Health Indicator and Data Repository (HIDR).' from r where n_nationkey % 5 > 0"""


def option_questions(spark, d):
    p = table(spark, d, "part")
    choices = ["p_brand", "p_type", "p_name", F.col("p_size").cast("string")]
    q = B.options(F.concat(F.lit("What is "), "p_name", F.lit("?")), choices)
    why = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.lit("None"))
    a = B.option_answer(F.when(F.col("p_partkey") % 7 > 0, F.col("p_partkey") % 6 - 1).cast("int"), choices, why)
    return p.select("p_partkey", q.alias("q"), a.alias("a")).where("a is not null")


_OPTIONS = """select p_partkey, 'What is ' || p_name || '?' || chr(10) || 'A) ' || p_brand || chr(10) || 'B) ' || p_type || chr(10) || 'C) ' || p_name || chr(10) || 'D) ' || p_size as q,
'The correct answer is **' || case p_partkey % 6 - 1 when 0 then 'A) ' || p_brand when 1 then 'B) ' || p_type when 2 then 'C) ' || p_name when 3 then 'D) ' || p_size else '?) ' end || '**.' || case when p_partkey % 3 = 0 then ' ' || p_type else '' end as a from part where p_partkey % 7 > 0"""


def typed_answers(spark, d):
    p = table(spark, d, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("yesno", "factoid", "list", "summary")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    verdict = F.array(F.when(F.col("p_partkey") % 8 == 0, "YES").otherwise("unclear"))
    listed = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name", "p_name", "p_name"), " ")
    exact = F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).when(F.col("p_partkey") % 4 == 0, verdict).otherwise(listed)
    ideal = F.when(F.col("p_partkey") % 3 > 0, F.col("p_type"))
    given = F.when(F.col("p_partkey") % 3 == 0, F.lit("None")).when(F.col("p_partkey") % 3 == 1, F.col("p_type"))
    return p.select("p_partkey", B.typed_answer(kind, ideal, exact).alias("a"), B.decision_answer(F.when(F.col("p_partkey") % 2 == 0, "mAYBE"), "p_type").alias("decision"), B.instruction("p_name", given).alias("instruction"))


_TYPED = """select p_partkey, case when p_partkey % 3 = 0 then '' when p_partkey % 5 = 0 then p_type else case p_partkey % 4 when 0 then case when p_partkey % 8 = 0 then 'Yes. ' else 'No. ' end when 1 then array_to_string(e[1:5], ', ') || '. ' when 2 then 'These include: ' || array_to_string(e[1:10], '; ') || '. ' else '' end || p_type end as a,
case when p_partkey % 2 = 0 then 'Maybe. ' || p_type else p_type end as decision, case when p_partkey % 3 = 1 then p_name || chr(10) || p_type else p_name end as instruction
from (select *, string_split(concat_ws(' ', p_name, p_type, p_brand, p_name, p_name, p_name), ' ') as e from part)"""


def named_regions(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 6 == 0, F.lit(99)).otherwise(F.col("n_regionkey")).cast("long").alias("key"))
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    return B.with_name(n, r, "key", "name", "Unknown").select("n_nationkey", "name")


_REGIONS = "select n_nationkey, coalesce(r_name, 'Unknown') as name from nation left join region on r_regionkey = case when n_nationkey % 6 = 0 then 99 else n_regionkey end"


def clean_questions(spark, d):
    """Conversations' first question and answer, and made-up rows, as a source table: cleaned, in length bands, no echo or follow-up, one row per question."""
    c = table(spark, d, "conversations")
    rows = c.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("question"), F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"))
    made = samples.frame(spark, samples.QUESTIONS, samples.NAMES).select(F.col("id").alias("conv_id"), F.col("q").alias("question"), F.col("a").alias("answer"))
    return readers.questions_csv(rows.union(made), F.col("conv_id"))


_BARE = "regexp_replace({0}, '<[^>]+>', ' ', 'g')"
_TIDY = "trim(regexp_replace(regexp_replace(replace(replace(replace(" + _BARE + r", '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), 'https?://\S+', '', 'g'), '\s{{2,}}', ' ', 'g'))"
_FOLLOW_UP = r"(?i)tolong\s*(d\s*)?balas|tolong\s*di\s*jawab|gmna\s*dok|belum\s*di\s*balas|kenapa\s*belum|mohon\s*d\s*balas|dong\s*dok|ma[''\s]?af.*belum|dok\s*tolong|harap\s*di\s*balas"
_QUESTIONS = f"""with r as (select conv_id, arg_min(text, turn) filter (role = 'user') as q, arg_min(text, turn) filter (role = 'assistant') as a from conversations group by conv_id union all select id, q, a from {samples.values(samples.QUESTIONS, samples.NAMES)}),
v as (select conv_id, case when lower(trim(q)) not in ('', 'nan', 'none') then {_TIDY.format("trim(q)")} end as q, case when lower(trim(a)) not in ('', 'nan', 'none') then {_TIDY.format("trim(a)")} end as a from r)
select q, a from v where length(q) >= 20 and length(a) between 100 and 2000 and q <> a and not regexp_matches(a, '{_FOLLOW_UP}') qualify row_number() over (partition by q order by conv_id) = 1"""


def source_rows(spark, d):
    """Pairs of turns and made-up rows as sources of four layouts, each by its own filters."""
    rows = samples.with_questions(table_pairs(spark, d)).withColumn("k", F.pmod(F.col("id"), F.lit(4)))
    long = F.concat_ws(" ", "a", "q", "a", "q", "a", "q", "a")
    asked = rows.select("id", F.col("q").alias("question"), F.when(F.col("k") == 0, F.substring("a", 1, 49)).when(F.col("k") == 1, F.substring("a", 1, 50)).when(F.col("k") == 2, long).otherwise(F.lit("NaN")).alias("answer"))
    told = rows.select("id", F.col("q").alias("instruction"), F.when(F.col("k") == 0, " none ").when(F.col("k") == 1, " x y ").alias("input"), F.col("a").alias("output"))
    judged = rows.select("id", F.col("q").alias("question"), F.when(F.col("k") != 3, F.col("a")).otherwise("nan").alias("long_answer"), F.when(F.col("k") == 0, "MAYBE").when(F.col("k") == 1, "nan").alias("final_decision"))
    chatted = rows.select("id", F.when(F.col("k") == 0, F.substring("q", 1, 19)).otherwise(F.col("q")).alias("input"), F.when(F.col("k") == 1, F.substring("a", 1, 99)).when(F.col("k") == 2, long).otherwise(F.col("a")).alias("output"))
    made = {"plain": A.plain(asked, ("id",)), "instructions": A.instructions(told, ("id",)), "decisions": A.decisions(judged, ("id",)), "dialogues": A.dialogues(chatted, ("id",))}
    out = None
    for layout, df in made.items():
        one = df.select("id", F.lit(layout).alias("layout"), F.md5("q").alias("q"), F.md5("a").alias("a"))
        out = one if out is None else out.unionByName(one)
    return out


_END = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CUT_AT = "case when length({0}) > 2000 then regexp_replace(substr({0}, 1, 2000), ' [^ ]*$', '') || '...' else {0} end"
_LONG = "concat_ws(' ', a, q, a, q, a, q, a)"
_ROWS = f"""with {PAIRS}, {samples.WITH_QUESTIONS}, k as (select id, q, a, ((id % 4) + 4) % 4 as k from qa),
r as (select id, 'plain' as layout, q, case k when 0 then substr(a, 1, 49) when 1 then substr(a, 1, 50) when 2 then {_LONG} else 'NaN' end as a, 1 as least_q, 50 as least_a, true as cut from k
union all select id, 'instructions', {_END.format("q")} || case when k = 1 then chr(10) || 'x y' else '' end, a, 1, 50, true from k
union all select id, 'decisions', q, case when k = 0 then 'Maybe. ' else '' end || {_END.format("a")}, 1, 1, false from k where k <> 3 and lower({_END.format("a")}) not in ('', 'none', 'nan')
union all select id, 'dialogues', case when k = 0 then substr(q, 1, 19) else q end, case k when 1 then substr(a, 1, 99) when 2 then {_LONG} else a end, 20, 100, true from k),
s as (select id, layout, {_END.format("q")} as q, {_END.format("a")} as a, least_q, least_a, cut from r)
select id, layout, md5(q) as q, md5(case when cut then {_CUT_AT.format("a")} else a end) as a from s where length(q) >= least_q and length(a) >= least_a and lower(a) not in ('', 'none', 'nan')"""


def first_rows(spark, d):
    return readers.prefix(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 5000)


def stream_gates(spark, d):
    """The gates on a stream of documents: the same rows and reasons as on the table."""
    path = f"{d}/documents.parquet"
    s = stream.read(spark, path, spark.read.parquet(path).schema)
    gates = [G.noise_gate("text", "(?i)licen[cs]e", "(?i)^in ", "(?i)www[.]")]
    return stream.drained(stream.labelled(s, gates).select("doc_id", "failed"))


_STREAM = "select doc_id, case when regexp_matches(text, '(?i)licen[cs]e') then 'noise:platform_ref' when regexp_matches(text, '(?i)^in ') then 'noise:greeting' when regexp_matches(text, '(?i)www[.]') then 'noise:url' when length(text) < 120 then 'noise:too_short' end as failed from documents"


def stream_windows(spark, d):
    """Events of each kind in each hour, counted as a stream."""
    path = f"{d}/events.parquet"
    s = stream.read(spark, path, spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = stream.drained(stream.windowed_counts(s, "ts", ["event_type"]), "complete")
    return out.select(F.date_format("begin", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


_WINDOWS = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n from events group by all"


def stream_unique(spark, d):
    """Users seen in a stream, each once."""
    path = f"{d}/events.parquet"
    s = stream.read(spark, path, spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.drained(stream.unique(s, F.col("user_id"), "ts", "100000 hours").select("user_id"))


QUERIES = {
    "code_questions": (code_questions, _CODES), "indicator_questions": (indicator_questions, _INDICATORS), "option_questions": (option_questions, _OPTIONS), "typed_answers": (typed_answers, _TYPED), "named_regions": (named_regions, _REGIONS),
    "clean_questions": (clean_questions, _QUESTIONS), "source_rows": (source_rows, _ROWS), "first_rows": (first_rows, "select o_orderkey, o_custkey from orders order by o_orderkey limit 5000"), "stream_gates": (stream_gates, _STREAM), "stream_windows": (stream_windows, _WINDOWS),
    "stream_unique": (stream_unique, "select distinct user_id from events"),
}
