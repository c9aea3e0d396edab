"""Queries that clean texts. A long text is returned as its md5 beside its length."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import rules as R
from quern.functions import ladders as L
from quern.functions import passes as P
from quern.functions import text as T
from quern.plans import samples
from quern.plans.tables import PAIRS, documents, pairs, table


def _md5(c, name):
    return [F.md5(c).alias(f"{name}_md5"), F.length(c).cast("long").alias(f"{name}_chars")]


def _sql(c: str, name: str) -> str:
    return f"md5({c}) as {name}_md5, length({c})::bigint as {name}_chars"


def html_url_clean(spark, d):
    return table(spark, d, "pages").select("page_id", *_md5(T.clean_basic("html"), "basic"), *_md5(T.strip_markup("html"), "markup"))


_STRIP = r"'^\s+|\s+$', '', 'g'"
HTML = rf"""with c as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]{{1,80}}>', ' ', 'g'), 'https?://\S+|www\.\S+', '', 'g'), '[ ' || chr(9) || ']{{2,}}', ' ', 'g'), chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), {_STRIP}) as basic,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), 'https?://\S+|www\.\S+', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'), {_STRIP}) as markup from pages)
select page_id, {_sql("basic", "basic")}, {_sql("markup", "markup")} from c"""


def redact_contacts(spark, d):
    return documents(spark, d).select("doc_id", *_md5(T.drop("text", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+", "[EMAIL]"), "email"), F.regexp_count("text", F.lit(r"[0-9]{9,12}")).cast("long").alias("numbers"))


REDACT = rf"""select doc_id, {_sql("regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+', '[EMAIL]', 'g')".replace(chr(92) * 2, chr(92)), "email")}, len(regexp_extract_all(text, '[0-9]{{9,12}}'))::bigint as numbers from documents"""


def fix_glued(spark, d):
    return documents(spark, d).select("doc_id", *_md5(T.split_glued("text"), "split"), T.glued_count("text").cast("long").alias("n"), *_md5(T.split_prepositions("text"), "preposition"))


FIX_GLUED = rf"""select doc_id, {_sql("regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')".replace(chr(92) * 2, chr(92)), "split")}, len(regexp_extract_all(text, '[a-z][A-Z]'))::bigint as n,
{_sql(f"regexp_replace(regexp_replace(text, '{R.PREPOSITION_DI}', 'di " + chr(92) + f"1', 'g'), '{R.PREPOSITION_KE}', 'ke " + chr(92) + "1', 'g')", "preposition")} from documents"""


def punctuation(spark, d):
    return documents(spark, d).select(
        "doc_id", *_md5(T.drop(T.drop("text", R.ORPHAN_PUNCTUATION, "$1"), R.REPEATED_PUNCTUATION, "$1"), "tidy"), *_md5(T.strip_citations("text"), "citation"), *_md5(T.drop("text", R.ARTICLE_TAIL), "tail"),
        *_md5(T.drop("text", r"^[\s.,;:!?-]+"), "lead"), *_md5(T.safe_name("text"), "safe"), *_md5(T.code_title("text"), "title"),
    )


_ONE = "'" + chr(92) + "1', 'g'"
PUNCTUATION = rf"""select doc_id, {_sql(f"regexp_replace(regexp_replace(text, '{R.ORPHAN_PUNCTUATION}', {_ONE}), '{R.REPEATED_PUNCTUATION}', {_ONE})", "tidy")}, {_sql(f"regexp_replace(text, '{R.CITATION}', '', 'g')", "citation")},
{_sql(f"regexp_replace(text, '{R.ARTICLE_TAIL}', '', 'g')", "tail")}, {_sql(r"regexp_replace(text, '^[\s.,;:!?-]+', '')", "lead")}, {_sql("regexp_replace(text, '[^A-Za-z0-9]', '_', 'g')", "safe")}, {_sql(r"regexp_replace(text, '^[-\s]+', '')", "title")} from documents"""


def truncate_words(spark, d):
    return documents(spark, d).select("doc_id", *_md5(T.truncate_words("text"), "cut"), *_md5(T.sentence_case("text"), "sentence"), *_md5(T.capitalised("text"), "capital"))


TRUNCATE = rf"""with c as (select doc_id, case when length(text) > 2000 then regexp_replace(substr(text, 1, 2000), ' [^ ]*$', '') || '...' else text end as cut, upper(substr(text, 1, 1)) || substr(text, 2) as sentence,
upper(substr(text, 1, 1)) || lower(substr(text, 2)) as capital from documents) select doc_id, {_sql("cut", "cut")}, {_sql("sentence", "sentence")}, {_sql("capital", "capital")} from c"""


def normalize_text(spark, d):
    return table(spark, d, "pages").select("page_id", *_md5(P.normalized(F.col("html")), "text"))


def _texts(spark, d):
    """(id, text) of whole documents, and of the questions and answers of pairs of turns and of made-up rows."""
    qa = samples.with_questions(pairs(spark, d))
    return documents(spark, d).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").union(qa.select(F.concat(F.lit("q"), "id"), "q")).union(qa.select(F.concat(F.lit("a"), "id"), "a"))


_TEXTS = f"{PAIRS}, {samples.WITH_QUESTIONS}, texts as (select 'd' || doc_id as id, text from documents union all select 'q' || id, q from qa union all select 'a' || id, a from qa)"


def _steps(begin: str, *steps: str, keep: str = "id") -> str:
    """Relations t0, t1, …, each a step on the column t of the one before; {0} in a step is t. A step may have further columns after `;`, which use {0} too."""
    out = [f"t0 as ({begin})"]
    for i, step in enumerate(steps):
        value, _, more = step.partition(" ; ")
        out.append(f"t{i + 1} as (select {keep}, {value.replace('{0}', 't')} as t{', ' + more.replace('{0}', 't') if more else ''} from t{i})")
    return ", ".join(out)


_STRIP_SQL = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_UPPER_SQL = r"case when regexp_matches({0}, '^\p{Ll}') then upper(substr({0}, 1, 1)) || substr({0}, 2) else {0} end"


def _sub(pattern: str, by: str = "", inner: str = "{0}") -> str:
    p, b = (x.replace("'", "''") for x in (pattern, by))
    return f"regexp_replace({inner}, '{p}', '{b}', 'g')"


def _squeezed(inner: str = "{0}") -> str:
    return _STRIP_SQL.replace("{0}", _sub(r"\s+", " ", inner))


#: The greetings with what they look ahead to as a group that is put back.
_GREETINGS_SQL = [(p.replace("(?=(?:thanks|thank|terima|hai|dear))", "(thanks|thank|terima|hai|dear)"), "\\1" if "(?=" in p else "") for p in R.GREETINGS]


def _greeting_steps(keep: int) -> list[str]:
    """From t, stripped: four rounds, and what it was (w) if too little is left. Needs a column w."""
    rounds = [_STRIP_SQL.replace("{0}", _sub(p, by)) for _ in range(4) for p, by in _GREETINGS_SQL]
    return [*rounds, _UPPER_SQL, f"case when length({_STRIP_SQL}) >= {keep} then {{0}} else w end"]


def time_stamps(spark, d):
    return _texts(spark, d).select("id", *_md5(T.strip_times("text"), "times"), *_md5(T.drop("text", R.PLACEHOLDER_ANY, " "), "placeholder"), *_md5(T.drop(T.drop("text", R.PII_INTRO_ANY, " "), R.PLACEHOLDER_INTRO, " "), "intro"))


TIMES = f"""with {_TEXTS}, c as (select id, {_sub(R.CLOCK, " ", _sub(R.TIMESTAMP, " ", "text"))} as times, {_sub(R.PLACEHOLDER_ANY, " ", "text")} as placeholder, {_sub(R.PLACEHOLDER_INTRO, " ", _sub(R.PII_INTRO_ANY, " ", "text"))} as intro from texts)
select id, {_sql("times", "times")}, {_sql("placeholder", "placeholder")}, {_sql("intro", "intro")} from c"""


def collapse_triples(spark, d):
    return _texts(spark, d).select("id", *_md5(T.collapse_triples("text"), "text"))


def _twice(inner: str) -> str:
    for ch in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        inner = f"regexp_replace({inner}, '{ch}{{3,}}', '{ch}{ch}', 'g')"
    return inner


TRIPLES = f"""with {_TEXTS}, p as (select id, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') as p from texts),
c as (select id, array_to_string(list_transform(p, lambda w: case when not regexp_matches(w, '^[A-Za-z]') or regexp_full_match(w, '(?i)[ivxlcdm]+') then w else {_twice("w")} end), '') as t from p) select id, {_sql("t", "text")} from c"""


def greeting_strip(spark, d):
    """The three passes on the beginnings of all texts."""
    c = F.col("text")
    return _texts(spark, d).select("id", *_md5(L.without_greeting(c), "shared"), *_md5(L.without_opening(c), "extended"), *_md5(L.without_address(c), "address"))


def shared_greeting(spark, d):
    """The greeting pass on all texts."""
    return _texts(spark, d).select("id", *_md5(L.without_greeting(F.col("text")), "shared"))


SHARED = f"with {_TEXTS}, {_steps(f'select id, {_STRIP_SQL.replace("{0}", "text")} as t, {_STRIP_SQL.replace("{0}", "text")} as w from texts', *_greeting_steps(15), keep='id, w')} select id, {_sql('t', 'shared')} from t{4 * len(_GREETINGS_SQL) + 2}"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _named(pattern: str) -> str:
    words = tuple(dict.fromkeys((*R.CONTENT_WORDS, *R.LEAD_ADVERBS)))
    name = f"lower(regexp_extract({{0}}, '{_quoted(pattern)}', 1))"
    return f"({name} <> '' and {name} not in {words})"


def _after(pattern: str, by: str = "") -> str:
    return r"regexp_replace(regexp_replace({0}, '" + _quoted(pattern) + "', '" + by + r"'), '^\s+', '')"


#: The comma pattern with what it looks ahead to as a group that is put back.
_COMMA_SQL = R.ADDRESS_COMMA.replace("(?=[A-Za-z])", "([A-Za-z])")
_GOOD_SQL = f"regexp_matches({{0}}, '{_quoted(R.ADDRESS_GOOD)}')"
_ADDRESS_SQL = f"""case when g then case when {_named(R.ADDRESS_WORD)} then {_after(R.ADDRESS_WORD)} else {{0}} end when {_GOOD_SQL} then {_after(R.ADDRESS_GOOD)}
  when {_named(R.ADDRESS_DOTS)} then {_after(R.ADDRESS_DOTS)} when {_named(_COMMA_SQL)} then {_after(_COMMA_SQL, chr(92) + "2")} else {{0}} end"""


def stripped_address(spark, d):
    """The pass on addresses, on all texts."""
    return _texts(spark, d).select("id", *_md5(L.without_address(F.col("text")), "address"))


_GREET_FIRST = f"case when regexp_matches({{0}}, '{R.ADDRESS_GREETING}') then {_after(R.ADDRESS_GREETING)} else {{0}} end ; regexp_matches({{0}}, '{R.ADDRESS_GREETING}') as g"
ADDRESS = f"with {_TEXTS}, {_steps(f'select id, {_STRIP_SQL.replace("{0}", "text")} as t, false as g from texts', *[_GREET_FIRST, _ADDRESS_SQL] * 4, _UPPER_SQL)} select id, {_sql('t', 'address')} from t9"


def redact_names(spark, d):
    """Introduced names, telephone numbers and addresses of all texts."""
    p = _texts(spark, d).select("id", L.redacted(F.col("text")).alias("r"))
    return p.select("id", F.col("r.n").cast("long").alias("n"), *_md5(F.col("r.text"), "text"))


def remediation(spark, d):
    """Doctors' names, pointers and broken ends of all texts."""
    c = F.col("text")
    p = _texts(spark, d).select("id", L.scrubbed(c).alias("s"), L.tail_trimmed(c).alias("c"), L.truncation_trimmed(c).alias("t"))
    return p.select("id", F.col("s.n").cast("long").alias("doctors"), *_md5(F.col("s.text"), "scrubbed"), F.col("c.cut").alias("tail_cut"), *_md5(F.col("c.text"), "tail"), F.col("t.status").alias("status"), *_md5(F.col("t.text"), "whole"))


def citation_tails(spark, d):
    """Pointers to other texts at the end of all texts."""
    p = _texts(spark, d).select("id", L.tail_trimmed(F.col("text")).alias("c"))
    return p.select("id", F.col("c.cut").alias("cut"), *_md5(F.col("c.text"), "text"))


def _head(pattern: str) -> str:
    at = f"string_split_regex(regexp_replace({{0}}, '\\s+$', ''), '{pattern}')"
    return f"case when regexp_matches(regexp_replace({{0}}, '\\s+$', ''), '{pattern}') and {at}[1] <> '' then {{{{'n': length({at}[1]), 't': {at}[1]}}}} end"


_TAIL_STEP = ("coalesce(regexp_replace(list_min(list_filter([" + ", ".join(_head(p) for p in R.CITATION_TAILS) + "], lambda x: x is not null)).t, '[ ,:;-]+$', ''), {0})").replace("{{", "{").replace("}}", "}")
_TERMINAL_SQL = R.TERMINAL.replace("'", "''")
TAILS = f"""with {_TEXTS}, {_steps("select id, text as t, text as w from texts", *[_TAIL_STEP] * 3, keep="id, w")}
select id, t <> w as cut, {_sql(f"case when t <> w and t <> '' and not regexp_matches(t, '{_TERMINAL_SQL}') then t || '.' else t end", "text")} from t3"""


def truncated_ends(spark, d):
    """Broken ends of all texts, cut at the last sentence end or told to go."""
    p = _texts(spark, d).select("id", L.truncation_trimmed(F.col("text")).alias("t"))
    return p.select("id", F.col("t.status").alias("status"), *_md5(F.col("t.text"), "text"))


_LAST_SQL = R.LAST_WORD.replace("'", "''")
ENDS = rf"""with {_TEXTS}, r as (select id, text, regexp_replace(text, '\s+$', '') as r from texts), l as (select *, lower(regexp_extract(r, '{_LAST_SQL}', 1)) as last, {_STRIP_SQL.replace("{0}", "regexp_extract(r, '(?s)^(.*[.!?])(?:" + chr(92) + "s|$)', 1)")} as ended from r),
s as (select *, case when regexp_matches(r, '{_TERMINAL_SQL}') or last in {R.SIGN_OFF_WORDS} or (last <> '' and last not in {R.DANGLING_WORDS}) then 'noop' when length(ended) >= 25 then 'kept' else 'drop' end as status from l)
select id, status, {_sql("case when status = 'kept' then ended else text end", "text")} from s"""


def strip_artefacts(spark, d):
    """Questions and answers of pairs of turns and of made-up rows without artefacts."""
    p = samples.with_questions(pairs(spark, d))
    return p.select("id", *_md5(L.clean_question(F.col("q")), "q"), *_md5(L.clean_answer(F.col("a")), "a"), *_md5(T.drop_sentences("a"), "sign_off"))


def sign_offs(spark, d):
    """All texts without the sentences that sign off."""
    return _texts(spark, d).select("id", *_md5(T.drop_sentences("text"), "text"))


SIGN_OFFS = rf"""with {_TEXTS}, s as (select id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\S') and not regexp_matches(x, '{R.SIGN_OFF}')) as s from texts),
c as (select id, {_squeezed("array_to_string(s, ' ')")} as t from s) select id, {_sql("t", "text")} from c"""


def strict_clean(spark, d):
    p = samples.with_questions(pairs(spark, d)).select("id", L.strict_question(P.normalized(F.col("q"))).alias("sq"), L.strict_answer(P.normalized(F.col("a"))).alias("sa"))
    return p.select("id", *_md5(F.col("sq.text"), "q"), *_md5(F.col("sa.text"), "a"), F.greatest("sq.glued", "sa.glued").cast("long").alias("glued"))


def over_strip_audit(spark, d, k: int = 25):
    """The answers that lose most by the extended greeting pass, over 50 characters."""
    p = samples.with_questions(pairs(spark, d)).select("id", "a", L.without_opening(F.col("a")).alias("after"))
    lost = (F.length("a") - F.length("after")).cast("long")
    return p.withColumn("lost", lost).where("lost > 50").orderBy(F.col("lost").desc(), "id").limit(k).select("id", "lost")


def conservative_clean(spark, d):
    """What each rule changes in all texts: a row for each rule with the texts that it changed."""
    p = _texts(spark, d).select(F.explode(L.conservative(F.col("text"))["fired"]).alias("rule"))
    return p.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def emoji_strip(spark, d):
    return documents(spark, d).select("doc_id", *_md5(T.strip_emoji(F.concat(F.col("text"), F.lit("✓ 😀"))), "emoji"))


EMOJI = rf"""select doc_id, {_sql(f"regexp_replace(text || '✓ 😀', '{R.EMOJI}', '', 'g')", "emoji")} from documents"""

QUERIES = {
    "html_url_clean": (html_url_clean, HTML), "redact_contacts": (redact_contacts, REDACT), "fix_glued": (fix_glued, FIX_GLUED), "punctuation": (punctuation, PUNCTUATION), "truncate_words": (truncate_words, TRUNCATE),
    "emoji_strip": (emoji_strip, EMOJI), "normalize_text": (normalize_text, None), "greeting_strip": (greeting_strip, None), "shared_greeting": (shared_greeting, SHARED), "stripped_address": (stripped_address, ADDRESS),
    "strip_artefacts": (strip_artefacts, None), "sign_offs": (sign_offs, SIGN_OFFS), "strict_clean": (strict_clean, None), "over_strip_audit": (over_strip_audit, None), "remediation": (remediation, None), "citation_tails": (citation_tails, TAILS), "truncated_ends": (truncated_ends, ENDS),
    "conservative_clean": (conservative_clean, None), "collapse_triples": (collapse_triples, TRIPLES), "redact_names": (redact_names, None), "time_stamps": (time_stamps, TIMES),
}
