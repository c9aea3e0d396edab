"""Queries on chats: roles, templates, gates and their funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import rules as R
from quern.functions import text as T
from quern.operators import gates as G
from quern.operators import roles
from quern.plans import samples
from quern.plans.tables import MESSAGES, PAIRS, conversations, documents, pairs

PROFILES = {"en": ("the", "of", "and", "in", "to"), "fr": ("le", "la", "les", "de", "et"), "de": ("der", "die", "und", "das", "ein"), "es": ("el", "los", "que", "y", "en")}
WORDS = ("the", "and", "of", "in", "is", "la", "de", "und")


def role_views(spark, d):
    m = conversations(spark, d)
    one = lambda c: F.md5(F.coalesce(c, F.lit("")))
    return m.select("conv_id", one(roles.first("messages", "user")).alias("first_user"), one(roles.last("messages", "user")).alias("last_user"), one(roles.joined("messages", "user")).alias("all_user"), one(roles.joined("messages", "user", "assistant")).alias("all_both"))


ROLE_VIEWS = f"""with {MESSAGES} select conv_id, md5(coalesce(arg_min(content, turn) filter (role = 'user'), '')) as first_user, md5(coalesce(arg_max(content, turn) filter (role = 'user'), '')) as last_user,
md5(coalesce(string_agg(content, ' ' order by turn) filter (role = 'user'), '')) as all_user, md5(coalesce(string_agg(content, ' ' order by turn) filter (role in ('user', 'assistant')), '')) as all_both
from messages group by conv_id"""


def chat_render(spark, d):
    m = conversations(spark, d)
    asked, ref = roles.prompt_and_reference("messages")
    return m.select("conv_id", roles.render("messages").alias("rendered"), roles.render(roles.with_system("messages")).alias("one_system"), asked.alias("prompt"), ref.alias("reference"))


_TURN = r"'<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10)"
CHAT_RENDER = f"""with {MESSAGES} select conv_id, string_agg({_TURN}, '' order by turn) as rendered,
'<|im_start|>system' || chr(10) || '{roles.SYSTEM}' || '<|im_end|>' || chr(10) || coalesce(string_agg({_TURN}, '' order by turn) filter (role <> 'system'), '') as one_system,
coalesce(string_agg({_TURN}, '' order by turn) filter (role in ('system', 'user')), '') || '<|im_start|>assistant' || chr(10) as prompt,
coalesce(arg_min(content, turn) filter (role = 'assistant'), '') as reference from messages group by conv_id"""


def merge_system_prompt(spark, d):
    return conversations(spark, d).select("conv_id", roles.render(roles.merge_system("messages")).alias("rendered"))


MERGE_SYSTEM = f"""with {MESSAGES}, told as (select conv_id, coalesce(arg_max(content, turn) filter (role = 'system'), '') as told, min(turn) filter (role = 'user') as first_user from messages group by conv_id),
merged as (select conv_id, turn, role, case when turn = first_user and told <> '' then trim(told, ' ') || chr(10) || chr(10) || content else content end as content from messages join told using (conv_id) where role <> 'system')
select conv_id, case when told <> '' and first_user is null then '<|im_start|>user' || chr(10) || told || '<|im_end|>' || chr(10) else '' end || coalesce(r, '') as rendered
from told left join (select conv_id, string_agg({_TURN}, '' order by turn) as r from merged group by conv_id) using (conv_id)"""


def inference_prompts(spark, d):
    p = pairs(spark, d)
    rendered = roles.render(roles.to_messages(F.col("q"), F.col("a")))
    return p.select("conv_id", "turn", roles.prompt(F.col("q")).alias("prompt"), roles.reference_after(rendered).alias("after_marker"))


INFERENCE = f"""with {PAIRS} select conv_id, turn, '<|im_start|>system' || chr(10) || '{roles.SYSTEM}' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || q || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) as prompt,
a || '<|im_end|>' || chr(10) as after_marker from pairs"""


def row_validity(spark, d):
    m = conversations(spark, d)
    return m.select("conv_id", roles.has_roles("messages", "user", "assistant").alias("valid"), G.low_quality("messages").alias("low_strict"), G.low_quality("messages", False).alias("low"))


_BANNED = " or ".join(f"contains(lower(content), '{b}')" for b in R.BANNED)
ROW_VALIDITY = f"""with {MESSAGES}, bad as (select *, length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) as n from messages)
select conv_id, bool_or(role = 'user') and bool_or(role = 'assistant') and bool_and(n > 0) as valid,
bool_or((role = 'assistant' and (n < 20 or length(content) > 3000 or {_BANNED})) or (role = 'user' and n < 5)) as low_strict,
bool_or((role = 'assistant' and (n < 20 or length(content) > 3000)) or (role = 'user' and n < 5)) as low from bad group by conv_id"""


def ladder() -> list[G.Gate]:
    return [G.format_gate(), G.encoding_gate(), G.artefact_gate(), G.length_gate(), G.invisible_gate(), G.deflection_gate(), G.spam_gate()]


def _hits(c: str, terms) -> str:
    return f"len(list_intersect(regexp_extract_all(lower({c}), '[a-z]+'), {list(terms)}))"


def _n(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '\S+'))"


_SAID = f"len(list_intersect(regexp_extract_all(lower(a), '[a-z]+'), {list(R.MEDICAL_TERMS)}))"
FAILED = rf"""case when q is null or a is null then 'G1_format:non_string_or_null' when not regexp_matches(q, '\S') or not regexp_matches(a, '\S') then 'G1_format:empty_field'
when contains(q, '{R.REPLACEMENT}') or contains(a, '{R.REPLACEMENT}') then 'G2_encoding:mojibake'
when regexp_matches(a, '{R.DOCTOR_NAME}') then 'G5_artifacts:doctor_name_embedded' when regexp_matches(a, '{R.NAMED_GREETING}') then 'G5_artifacts:named_greeting' when regexp_matches(a, '{R.PATIENT_FOLLOW_UP}') then 'G5_artifacts:patient_followup_as_answer'
when length(q) < 20 then 'G4_length:question_too_short' when {_n("q")} > 400 then 'G4_length:question_too_long' when {_n("a")} < 20 then 'G4_length:answer_too_short' when {_n("a")} > 400 then 'G4_length:answer_too_long'
when lower(regexp_replace(q, '^\s+|\s+$', '', 'g')) = lower(regexp_replace(a, '^\s+|\s+$', '', 'g')) then 'G4_length:q_equals_a'
when regexp_matches(a, '{R.INVISIBLE}') then 'G6_invisible_ref:invisible_ref'
when {_n("a")} < 45 and regexp_matches(a, '{R.DEFLECTION}') and {_SAID} < 3 then 'G9_deflection:deflection_only'
when regexp_matches(q || ' ' || a, '{R.SPAM}') then 'G10_toxic_spam:spam' when regexp_matches(q || ' ' || a, '{R.PROFANITY}') then 'G10_toxic_spam:profanity' end"""


def qa_gates(spark, d):
    """The gates with their fixed rules on pairs of turns and made-up rows."""
    return samples.with_questions(pairs(spark, d)).select("id", G.first_failed(ladder()).alias("failed"))


QA_GATES = f"with {PAIRS}, {samples.WITH_QUESTIONS} select id, {FAILED} as failed from qa"


def qa_gate_funnel(spark, d):
    return G.funnel(samples.with_questions(pairs(spark, d)), ladder()).select(F.col("ord").cast("long").alias("ord"), "gate", "reason", "n_in", "n_dropped", "n_out")


_STEPS = [("G1_format", "non_string_or_null"), ("G1_format", "empty_field"), ("G2_encoding", "mojibake"), *[("G5_artifacts", r) for r in ("doctor_name_embedded", "named_greeting", "patient_followup_as_answer")],
          *[("G4_length", r) for r in ("question_too_short", "question_too_long", "answer_too_short", "answer_too_long", "q_equals_a")], ("G6_invisible_ref", "invisible_ref"), ("G9_deflection", "deflection_only"), ("G10_toxic_spam", "spam"), ("G10_toxic_spam", "profanity")]
QA_FUNNEL = f"""with {PAIRS}, {samples.WITH_QUESTIONS}, failed as (select {FAILED} as failed, count(*) as n from qa group by 1), total as (select coalesce(sum(n), 0) as total from failed),
steps as (select * from (values {", ".join(f"({i}, '{g}', '{r}')" for i, (g, r) in enumerate(_STEPS))}) as s(ord, gate, reason)),
counted as (select s.*, coalesce(n, 0) as n_dropped, total from steps s left join failed on failed = gate || ':' || reason cross join total)
select ord::bigint as ord, gate, reason, (total - coalesce(sum(n_dropped) over w, 0))::bigint as n_in, n_dropped::bigint as n_dropped, (total - coalesce(sum(n_dropped) over w, 0) - n_dropped)::bigint as n_out
from counted window w as (order by ord rows between unbounded preceding and 1 preceding)"""


def noise_reasons(spark, d):
    """The noise gate and two others with their fixed rules on whole documents and made-up answers."""
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), "text").union(samples.frame(spark, samples.QUESTIONS, samples.NAMES).select("id", "a"))
    return rows.select("id", G.first_failed([G.noise_gate("text")]).alias("reason"), G.first_failed([G.short_answer_gate("text"), G.greeting_gate("text")]).alias("answer_reason"))


_GENERIC = r"(?i)^(Hello[,.]?\s*Thank you for (asking|consulting)|Hi+[.,]?\s*(Thank you|Hope this message|I have gone through)|Hi+[.,]?\s*Thank you for consulting in Chat Doctor\.\s*$)"
NOISE = rf"""with t as (select doc_id as id, text from documents union all select id, a from {samples.values(samples.QUESTIONS, samples.NAMES)})
select id, case when regexp_matches(text, '{R.NOISE_PLATFORM}') then 'noise:platform_ref' when regexp_matches(text, '{R.NOISE_GREETING}') then 'noise:greeting' when regexp_matches(text, '{R.NOISE_URL}') then 'noise:url' when length(text) < 120 then 'noise:too_short' end as reason,
case when length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 80 then 'short_answer:short' when regexp_matches(text, '{_GENERIC}') and length(text) < 150 then 'generic_greeting:greeting' end as answer_reason from t"""


def echo_pairs(spark, d):
    """Echoes between neighbouring turns, and whether an answer is a patient's."""
    return pairs(spark, d).select("conv_id", "turn", T.is_echo("q", "a").alias("echo"), T.is_echo("q", F.concat(F.col("q"), F.lit(" "), F.col("a"))).alias("echo_of_own"), F.md5(T.echo_norm("q")).alias("norm"), T.patient_speaks("a").alias("patient"))


def _echo(c: str) -> str:
    inner = rf"regexp_replace(regexp_replace({c}, '{R.ECHO_GREETING}', ''), '(?i)\bdok(ter)?\b', '', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({inner}), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


ECHO = rf"""with {PAIRS}, n as (select *, {_echo("q")} as nq, {_echo("a")} as na, {_echo("q || ' ' || a")} as nb from pairs)
select conv_id, turn, length(nq) >= 40 and (contains(na, substr(nq, 1, 80)) or contains(nq, substr(na, 1, 80))) as echo,
length(nq) >= 40 and (contains(nb, substr(nq, 1, 80)) or contains(nq, substr(nb, 1, 80))) as echo_of_own, md5(nq) as norm, regexp_matches(a, '{R.PATIENT_SPEAKS.replace("'", "''")}') as patient from n"""


def qa_pairs(spark, d):
    return pairs(spark, d)


def person_gate(spark, d):
    """The last gate with a rule-based recogniser in place of a model."""
    from quern.operators.vectors import capitalised_entities

    p = capitalised_entities("a", "a_entities")(capitalised_entities("q", "q_entities")(pairs(spark, d)))
    return p.select("conv_id", "turn", G.first_failed([G.person_gate("q_entities", "a_entities")]).alias("failed"))


def language_gate(spark, d):
    """Told by profiles of frequent words, for want of a model."""
    from quern.operators.vectors import by_profile

    p = by_profile(PROFILES, "a", "a")(by_profile(PROFILES, "q", "q")(pairs(spark, d)))
    return p.select("conv_id", "turn", "a_lang", "a_prob", G.first_failed([G.language_gate("q_lang", "q_prob", "a_lang", "a_prob", ("en",))]).alias("failed"), G.language_reason("q_lang", "q_prob", "a_lang", "a_prob", ("en",)).alias("reason"))


def _told(c: str, name: str) -> str:
    hits = {k: f"len(list_filter(regexp_extract_all(lower({c}), '[' || chr(92) || 'p{{L}}]+'), lambda w: w in {v}))" for k, v in PROFILES.items()}
    most, total = f"greatest({', '.join(hits.values())})", " + ".join(hits.values())
    lang = f"case when length(trim({c})) < 12 then 'unknown' when {most} = 0 then 'unknown' {' '.join(f"when {n} = {most} then '{k}'" for k, n in hits.items())} end"
    return f"{lang} as {name}_lang, case when {total} > 0 then {most}::double / ({total}) else 0.0 end as {name}_prob"


LANGUAGE = f"""with {PAIRS}, t as (select conv_id, turn, {_told("q", "q")}, {_told("a", "a")} from pairs)
select conv_id, turn, a_lang, a_prob, case when a_lang <> 'en' or a_prob < 0.65 then 'G3_language:answer' when q_lang <> 'en' or q_prob < 0.3 then 'G3_language:question' end as failed,
case when a_lang <> 'en' or a_prob < 0.65 then 'answer_' || a_lang when q_lang <> 'en' or q_prob < 0.3 then 'question_' || q_lang end as reason from t""".replace("{{", "{").replace("}}", "}")


def code_lookups(spark, d):
    """Questions for codes among pairs of turns and made-up rows: by any message or the source, and by the question alone."""
    rows = samples.with_questions(pairs(spark, d))
    messages = roles.to_messages(F.col("q"), F.col("a"))
    return rows.select("id", G.any_code_lookup(messages, F.col("source"), R.CODE_SOURCES).alias("noise"), G.content_lookup("q").alias("lookup"))


_ASKS = "(contains({0}, 'What is the') and contains(lower({0}), 'code') and contains({0}, 'ICD') and length({0}) < 200)"
LOOKUPS = f"""with {PAIRS}, {samples.WITH_QUESTIONS} select id, source in ('icd11', 'hidr') or {_ASKS.format("q")} or {_ASKS.format("a")} as noise, contains(lower(q), 'icd') and contains(lower(q), 'code') as lookup from qa"""

QUERIES = {
    "qa_pairs": (qa_pairs, f"with {PAIRS} select * from pairs"), "role_views": (role_views, ROLE_VIEWS), "chat_render": (chat_render, CHAT_RENDER), "merge_system_prompt": (merge_system_prompt, MERGE_SYSTEM),
    "inference_prompts": (inference_prompts, INFERENCE), "row_validity": (row_validity, ROW_VALIDITY), "qa_gates": (qa_gates, QA_GATES), "qa_gate_funnel": (qa_gate_funnel, QA_FUNNEL), "noise_reasons": (noise_reasons, NOISE),
    "echo_pairs": (echo_pairs, ECHO), "person_gate": (person_gate, None), "language_gate": (language_gate, LANGUAGE), "code_lookups": (code_lookups, LOOKUPS),
}

