"""Queries on duplicates and on what splits share."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import dedup as D
from quern.operators import leaks as L
from quern.operators import selection as S
from quern.operators import vectors as V
from quern.plans.tables import PAIRS, SPLIT, conversations, documents, pairs, split_documents, table
from quern.shared import written

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_ALNUM = "regexp_replace(lower({}), '[^0-9a-z]+', '', 'g')"


def dedup_question(spark, d):
    key = F.lower(T.strip("q"))
    return D.first_per_key(pairs(spark, d).where(key != ""), key, ["conv_id", "turn"]).select("conv_id", "turn")


DEDUP_QUESTION = rf"""with {PAIRS}, k as (select *, lower({_TRIM.format("q")}) as key from pairs)
select conv_id, turn from k where key <> '' qualify row_number() over (partition by key order by conv_id, turn) = 1"""


def dedup_pair(spark, d):
    return D.first_per_key(pairs(spark, d), D.pair_key("q", "a"), ["conv_id", "turn"]).select("conv_id", "turn")


DEDUP_PAIR = rf"""with {PAIRS}, k as (select *, regexp_replace(regexp_replace(lower(q || ' ||| ' || a), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as key from pairs)
select conv_id, turn from k qualify row_number() over (partition by key order by conv_id, turn) = 1"""


def dedup_md5(spark, d):
    m = conversations(spark, d).withColumn("sig", D.message_digest("messages"))
    return D.first_per_key(m.select("conv_id", "sig"), F.col("sig"), ["conv_id"])


DEDUP_MD5 = rf"""with sigs as (select conv_id, md5(coalesce(string_agg(lower({_TRIM.format("coalesce(text, '')")}), ' ' order by turn) filter (role in ('user', 'assistant')), '')) as sig from conversations group by conv_id)
select min(conv_id) as conv_id, sig from sigs group by sig"""


def dedup_documents(spark, d):
    """One document per text of letters and digits: the longest, the first of equals."""
    docs = documents(spark, d).select("doc_id", "n_chars", T.alnum("text").alias("key"))
    return D.best_per_key(docs, F.col("key"), F.col("n_chars"), "doc_id").select("doc_id", F.md5("key").alias("key"))


DEDUP_DOCUMENTS = f"""with k as (select doc_id, n_chars, {_ALNUM.format("text")} as key from documents)
select doc_id, md5(key) as key from k qualify row_number() over (partition by key order by n_chars desc, doc_id) = 1"""


def cap_repeats(spark, d):
    return D.cap_per_key(documents(spark, d).select("doc_id", "text"), F.substring(T.strip("text"), 1, 120), ["doc_id"], 2).select("doc_id")


CAP = rf"""select doc_id from documents qualify row_number() over (partition by substr({_TRIM.format("text")}, 1, 120) order by doc_id) <= 2"""


def near_pairs(spark, d):
    sets = documents(spark, d).select("doc_id", D.shingles("text", 3, "[a-z0-9]+").alias("items"))
    pairs_, members = D.similar_pairs(sets, "doc_id", "items", 0.8)
    return pairs_.select("a", "b", F.round("similarity", 6).alias("similarity"))


_SHINGLES = """w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents),
s as (select doc_id, case when len(w) >= 3 then list_sort(list_distinct([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)])) else list_sort(list_distinct(w)) end as items from w),
reps as (select min(doc_id) as a, items, len(items) as n from s where len(items) > 0 group by items)"""
NEAR_PAIRS = f"""with {_SHINGLES}, one as (select a, n, unnest(items) as item from reps),
common as (select x.a, y.a as b, x.n, y.n as m, count(*) as c from one x join one y on x.item = y.item and x.a < y.a group by all)
select a, b, round(c::double / (n + m - c), 6) as similarity from common where c::double / (n + m - c) >= 0.8"""


def near_members(spark, d):
    """Every document that has a shingle with the first of its class, by which near_pairs has the class, and the size of the class."""
    sets = documents(spark, d).select("doc_id", D.shingles("text", 3, "[a-z0-9]+").alias("items"))
    return D.with_class_size(D.class_members(sets.where(F.size("items") > 0), "doc_id", "items"))


NEAR_MEMBERS = f"""with {_SHINGLES} select s.doc_id, reps.a, count(*) over (partition by reps.a) as n from s join reps using (items)"""


def _greedy(edges: str) -> str:
    """Relations that take nodes in order and let one go if an earlier one that stays is near: gone (x)."""
    return f"""edges as ({edges}), placed as (select b, list(a) as near, row_number() over (order by b) as r from edges group by b),
walk as (select 0::bigint as r, []::bigint[] as gone union all select p.r, case when len(list_filter(near, lambda x: not list_contains(gone, x))) > 0 then list_append(gone, p.b) else gone end from walk join placed p on p.r = walk.r + 1),
gone as (select unnest(gone) as x from (select gone from walk order by r desc limit 1))"""


def near_greedy(spark, d):
    sets = documents(spark, d).select("doc_id", D.shingles("text", 3, "[a-z0-9]+").alias("items"))
    return D.greedy_keep(*D.similar_pairs(sets, "doc_id", "items", 0.8), "doc_id")


_NEAR = NEAR_PAIRS[NEAR_PAIRS.index("one as (") : NEAR_PAIRS.rindex("select a, b, round")].rstrip()
NEAR_GREEDY = f"""with recursive {_SHINGLES}, {_NEAR}, {_greedy("select a, b from common where c::double / (n + m - c) >= 0.8")}
select min(doc_id) as doc_id from s group by items having min(doc_id) not in (select x from gone)"""


def near_text(spark, d):
    """Five words, similarity 0.9, over both sides of a pair."""
    p = pairs(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), D.shingles(F.concat("q", F.lit(" "), "a"), 5, r"\S+", "whole").alias("items"))
    return D.greedy_keep(*D.similar_pairs(p, "id", "items", 0.9), "id")


_FIVE = """w as (select conv_id * 1000 + turn as doc_id, regexp_extract_all(lower(q || ' ' || a), '\\S+') as w from pairs),
s as (select doc_id, case when len(w) >= 5 then list_sort(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as items from w),
reps as (select min(doc_id) as a, items, len(items) as n from s where len(items) > 0 group by items)"""
NEAR_TEXT = f"""with recursive {PAIRS}, {_FIVE}, {_NEAR}, {_greedy("select a, b from common where c::double / (n + m - c) >= 0.9")}
select min(doc_id) as id from s group by items having min(doc_id) not in (select x from gone)"""


def near_leaks(spark, d):
    """Training documents that a validation or test document is similar to."""
    docs = split_documents(spark, d).select("doc_id", "split", D.shingles("text", 3, "[a-z0-9]+").alias("items"))
    return D.similar_to(docs.where("split = 'train'").drop("split"), docs.where("split <> 'train'").drop("split"), "doc_id", "items", 0.8)


NEAR_LEAKS = f"""with {_SHINGLES.replace("from documents", "from documents")}, {SPLIT}, one as (select a, n, unnest(items) as item from reps),
common as (select x.a, y.a as b, x.n, y.n as m, count(*) as c from one x join one y on x.item = y.item and x.a < y.a group by all),
near as (select a, b from common where c::double / (n + m - c) >= 0.8 union all select b, a from common where c::double / (n + m - c) >= 0.8 union all select a, a from reps),
members as (select s.doc_id, reps.a, split.split from s join reps using (items) join split using (doc_id))
select distinct t.doc_id from members t join near on t.a = near.a join members o on o.a = near.b where t.split = 'train' and o.split <> 'train'"""


def bucketed_similar(spark, d):
    return D.bucketed_pairs(documents(spark, d), "doc_id", "text")[0].select("a", "b", F.round("similarity", 6).alias("similarity"))


BUCKETED = f"""with r as (select doc_id, substr({_ALNUM.format("text")}, 1, 200) as bucket, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) as items from documents),
reps as (select bucket, items, min(doc_id) as k from r group by bucket, items),
p as (select x.k as a, y.k as b, len(list_intersect(x.items, y.items)) as c, len(x.items) as n, len(y.items) as m from reps x join reps y on x.bucket = y.bucket and x.k < y.k)
select a, b, round(c::double / (n + m - c), 6) as similarity from p where n + m > 0 and c::double / (n + m - c) >= 0.8"""


def bucketed_members(spark, d):
    """Every document that has a word with the first of its bucket and set of words, by which bucketed_similar has them, and how many those are."""
    sets = D.bucketed_sets(documents(spark, d), "doc_id", "text")
    return D.with_class_size(D.class_members(sets.where(F.size("items") > 0), "doc_id", "items"))


BUCKETED_MEMBERS = f"""with r as (select doc_id, substr({_ALNUM.format("text")}, 1, 200) as bucket, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) as items from documents),
m as (select doc_id, min(doc_id) over (partition by bucket, items) as a from r where len(items) > 0) select doc_id, a, count(*) over (partition by a) as n from m"""


def minhash_candidates(spark, d):
    """How many documents share each number of bands with another one."""
    sets = documents(spark, d).select("doc_id", D.shingles("text").alias("items"))
    signed = V.with_minhash(sets, "doc_id", "items", 32)
    # written, or both sides of the join would sign all documents
    keys = written(signed.select("doc_id", F.posexplode(V.bands("sig", 32)).alias("band", "key")), "bands")
    shared = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(shared, ["band", "key"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("bands"))


def exact_leaks(spark, d):
    s = split_documents(spark, d).select("doc_id", "split", F.md5(F.lower(T.strip("text"))).alias("sig"))
    return L.without_keys_of(s.where("split = 'train'"), s.where("split = 'test'"), "sig").select("doc_id")


EXACT_LEAKS = rf"""with {SPLIT}, s as (select doc_id, split, md5(lower({_TRIM.format("text")})) as sig from split)
select doc_id from s where split = 'train' and not exists (select 1 from s o where o.split = 'test' and o.sig = s.sig)"""


def leak_counts(spark, d):
    s = split_documents(spark, d).select("split", F.md5(T.alnum("text")).alias("sig"))
    return L.common_keys(s, "sig", "split")


LEAK_COUNTS = f"""with {SPLIT}, s as (select distinct split, md5({_ALNUM.format("text")}) as sig from split), g as (select distinct split from split where split is not null),
c as (select x.split as a, y.split as b, count(*) as n from s x join s y on x.sig = y.sig and x.split < y.split group by all)
select x.split as a, y.split as b, coalesce(n, 0)::bigint as common from g x join g y on x.split < y.split left join c on c.a = x.split and c.b = y.split"""


def eval_reasons(spark, d):
    """Why pairs of turns, and made-up rows, set aside for tests would leave beside the others."""
    from quern.plans import samples

    rows = samples.with_questions(pairs(spark, d))
    test = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    return L.eval_reasons(rows.where(test), rows.where(~test), "id")


def union_sources(spark, d):
    a = documents(spark, d).select(F.col("doc_id").alias("id"), "text", "lang")
    b = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text", "role")
    c = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    u = L.union_all({"documents": a, "conversations": b, "benchmark": c}, "origin")
    return u.groupBy("origin", "lang", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


UNION = """with u as (select 'documents' as origin, text, lang, null::varchar as role from documents union all select 'conversations', text, null, role from conversations union all select 'benchmark', text, null, null from benchmark)
select origin, lang, role, count(*) as n, sum(length(text))::bigint as chars from u group by all"""


def not_chosen(spark, d):
    docs = documents(spark, d).select("doc_id", "n_chars")
    return L.not_chosen(docs, S.top(docs, 300, "n_chars", "doc_id"), "doc_id").select("doc_id")


NOT_CHOSEN = "select doc_id from documents where doc_id not in (select doc_id from documents order by n_chars desc, doc_id limit 300)"


def benchmark_overlap(spark, d):
    return L.contamination(documents(spark, d), table(spark, d, "benchmark"), 8)


BENCHMARK = """with g as (select doc_id, unnest(list_distinct([array_to_string(w[i:i+7], ' ') for i in range(1, len(w) - 6)])) as gram from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents)),
t as (select item_id, unnest(list_distinct([array_to_string(w[i:i+7], ' ') for i in range(1, len(w) - 6)])) as gram from (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from benchmark))
select doc_id, item_id, count(*) as shared from g join t using (gram) group by all"""


def rare_keywords(spark, d):
    """Words of part names that at most three kinds of part have."""
    words = table(spark, d, "part").select(F.col("p_type").alias("kind"), F.explode(T.words("p_name")).alias("keyword")).distinct()
    return L.rare_keywords(words, "keyword", "kind", 60)


RARE = """with k as (select distinct p_type as kind, unnest(regexp_extract_all(lower(p_name), '[a-z]+')) as keyword from part)
select kind, keyword from k where keyword in (select keyword from k group by keyword having count(*) <= 60)"""


def positional_zip(spark, d):
    """Documents beside their cleaned form by number, with whether they differ."""
    a = documents(spark, d).select("doc_id", "text")
    b = documents(spark, d).select("doc_id", T.squeeze("text").alias("clean"))
    return a.join(b, "doc_id").select("doc_id", (F.col("text") != F.col("clean")).alias("changed"), (F.length("text") - F.length("clean")).cast("long").alias("lost"))


ZIP = rf"""with c as (select doc_id, text, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as clean from documents) select doc_id, text <> clean as changed, (length(text) - length(clean))::bigint as lost from c"""

QUERIES = {
    "dedup_question": (dedup_question, DEDUP_QUESTION), "dedup_pair": (dedup_pair, DEDUP_PAIR), "dedup_md5": (dedup_md5, DEDUP_MD5), "dedup_documents": (dedup_documents, DEDUP_DOCUMENTS), "cap_repeats": (cap_repeats, CAP),
    "near_pairs": (near_pairs, NEAR_PAIRS), "near_members": (near_members, NEAR_MEMBERS), "near_greedy": (near_greedy, NEAR_GREEDY), "near_text": (near_text, NEAR_TEXT), "near_leaks": (near_leaks, NEAR_LEAKS), "bucketed_similar": (bucketed_similar, BUCKETED), "bucketed_members": (bucketed_members, BUCKETED_MEMBERS), "minhash_candidates": (minhash_candidates, None),
    "exact_leaks": (exact_leaks, EXACT_LEAKS), "eval_reasons": (eval_reasons, None), "leak_counts": (leak_counts, LEAK_COUNTS), "union_sources": (union_sources, UNION), "not_chosen": (not_chosen, NOT_CHOSEN), "benchmark_overlap": (benchmark_overlap, BENCHMARK),
    "rare_keywords": (rare_keywords, RARE), "positional_zip": (positional_zip, ZIP),
}
