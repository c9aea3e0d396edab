"""Ladders of text rules as expressions: rules are data in quern/rules.py, and one driver applies them in their order.

Passes that repeat until nothing changes are aggregates over their greatest number of rounds: after a round that changes nothing
the rest is skipped. let() binds a value that a rule looks at more than once. All runs in the JVM; nulls stay
null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import rules as R
from quern.functions import text as T
from quern.functions.text import let

Step = Callable[[Column], Column]


def ladder(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Each pattern replaced, in order."""
    return reduce(lambda t, rule: T.drop(t, *rule), rules, c)


def rounds(c: Column, most: int, step: Step) -> Column:
    """step() up to `most` times; after a round that changes nothing no other is worked out."""

    def next_(s: Column, _: Column) -> Column:
        return F.when(s["go"], let(step(s["t"]), lambda after: F.struct(after.alias("t"), (~after.eqNullSafe(s["t"])).alias("go")))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(c.alias("t"), F.lit(True).alias("go")), next_, lambda s: s["t"])


def trimmed(c: Column, marks: str, side: str = "end") -> Column:
    """Without the marks (a class of characters) at its end or begin."""
    return T.drop(c, f"[{marks}]+$" if side == "end" else f"^[{marks}]+")


def upper_first(c: Column) -> Column:
    return let(c, lambda t: F.when(t.rlike(R.LOWER_FIRST), T.sentence_case(t)).otherwise(t))


def long_enough(short: Column, least: int, otherwise: Column) -> Column:
    return let(short, lambda t: F.when(F.length(T.strip(t)) >= least, t).otherwise(otherwise))


def before(c: Column, pattern: str) -> Column:
    """What stands before the first match; null without one."""
    return let(F.split(c, pattern, 2), lambda s: F.when(F.size(s) == 2, F.get(s, 0)))


def has_any(t: Column, words: Iterable[str]) -> Column:
    """Whether the text has one of the words (in lower case), as a part of whatever it has them in: what a pattern can't match without."""
    # a long word is found sooner by a pattern, which skips ahead
    one = lambda x, w: x.rlike(re.escape(w)) if len(w) > 6 else F.contains(x, F.lit(w))
    return let(F.lower(t), lambda x: reduce(lambda a, b: a | b, [one(x, w) for w in words]))


# ------------------------------------------------------------------ beginnings


#: What a text begins with that any of the greetings matches.
_GREETED = "|".join("(?:" + p.replace("^", "", 1) + ")" for p in R.GREETINGS)
_GREETED = f"^(?:{_GREETED})"


def without_greeting(c: Column, keep: int = 15) -> Column:
    """Without the greetings it begins with, in up to four rounds; as it was if fewer than `keep` characters remain."""
    bare = lambda t: F.when(t.rlike(_GREETED), reduce(lambda x, p: T.strip(T.drop(x, p)), R.GREETINGS, t)).otherwise(t)
    return let(T.strip(c), lambda whole: long_enough(upper_first(rounds(whole, 4, bare)), keep, whole))


def _without_boilerplate(t: Column) -> Column:
    """Without the first sentence, if it is one of those that open an answer, is short, and enough follows."""

    def judged(sentence: Column) -> Column:
        said, rest = T.strip(sentence), T.strip(F.substring(t, F.length(sentence) + 1, F.length(t)))
        limit = F.when(said.rlike(rf"(?i)^\s*(?:{R.GREETING_WORDS})\b"), R.GREETING_SENTENCE_CHARS).otherwise(R.BOILERPLATE_CHARS)
        return F.when(said.rlike(R.BOILERPLATE) & (F.length(said) <= limit) & (F.length(rest) >= R.KEEP_CHARS), rest).otherwise(t)

    return let(F.regexp_extract(t, f"^(?:{R.SENTENCE})", 0), judged)


def without_opening(c: Column) -> Column:
    """The extended pass: also names after greetings and whole opening sentences, of limited length."""

    def opened(t: Column) -> Column:
        return let(reduce(lambda x, o: trimmed(T.drop(x, o[0]), o[1], "begin"), R.OPENERS, t), _without_boilerplate)

    def finished(whole: Column) -> Column:
        cut = let(rounds(whole, 8, opened), lambda t: long_enough(without_greeting(t), R.KEEP_CHARS, t))
        return long_enough(upper_first(cut), R.KEEP_CHARS, whole)

    return let(T.strip(c), finished)


def without_address(c: Column) -> Column:
    """Without a greeting and the name after it, a name before dots or a comma, in up to four rounds."""
    cut = lambda t, p: trimmed(T.drop(t, p), r"\s", "begin")

    def named(t: Column, pattern: str) -> Column:
        name = F.lower(F.regexp_extract(t, pattern, 1))
        return (name != "") & ~name.isin(*R.CONTENT_WORDS, *R.LEAD_ADVERBS)

    def step(t: Column) -> Column:
        greeted = let(cut(t, R.ADDRESS_GREETING), lambda u: F.when(named(u, R.ADDRESS_WORD), cut(u, R.ADDRESS_WORD)).otherwise(u))
        out = F.when(t.rlike(R.ADDRESS_GREETING), greeted).when(t.rlike(R.ADDRESS_GOOD), cut(t, R.ADDRESS_GOOD))
        for pattern in (R.ADDRESS_DOTS, R.ADDRESS_COMMA):
            out = out.when(named(t, pattern), cut(t, pattern))
        return out.otherwise(t)

    return upper_first(rounds(T.strip(c), 4, step))


def clean_question(c: Column) -> Column:
    return T.squeeze(T.drop(without_greeting(without_address(c), 10), R.PLACEHOLDER))


def clean_answer(c: Column) -> Column:
    return T.squeeze(T.drop(without_address(without_greeting(T.drop_sentences(without_address(c)))), R.PLACEHOLDER))


def lead_names_stripped(names: Iterable[str]) -> Step:
    """Without up to three known names at the beginning, if 15 characters remain."""
    known = sorted(set(names))

    def strip(c: Column) -> Column:
        if not known:
            return T.col(c)
        word = lambda t, i: trimmed(trimmed(F.get(F.split(t, r"\s+"), i), ",.!?:;\\-"), ",.!?:;\\-", "begin").isin(*known)

        def cut(t: Column) -> Column:
            rest = t
            for n in (1, 2, 3):
                had = reduce(lambda a, b: a & b, [F.coalesce(word(t, i), F.lit(False)) for i in range(n)])
                rest = F.when(had, trimmed(T.drop(t, rf"^\s*(?:\S+(?:\s+|$)){{{n}}}"), r" ,.!?:;\-–—\t", "begin")).otherwise(rest)
            return let(rest, lambda r: F.when(t.rlike(R.LEAD_NAME) & (F.length(r) >= 15), r).otherwise(t))

        return let(T.col(c), cut)

    return strip


# ------------------------------------------------------------------ names and contacts


def redacted(c: Column) -> Column:
    """(text, n): introduced names, telephone numbers and addresses replaced, and how many there were."""
    stages = ((R.PII_INTRO, "$1 [NAMA]"), (R.PII_PHONE, "[NOMOR]"), (R.PII_EMAIL, "[EMAIL]"))
    out = F.struct(c.alias("text"), F.lit(0).alias("n"))

    def stage(pattern: str, by: str) -> Step:
        return lambda s: F.struct(T.drop(s["text"], pattern, by).alias("text"), (s["n"] + F.regexp_count(s["text"], F.lit(pattern))).alias("n"))

    for pattern, by in stages:
        out = let(out, stage(pattern, by))
    return let(out, lambda s: F.struct(T.drop(s["text"], R.NAMED_SELF, "nama saya [NAMA]").alias("text"), s["n"].alias("n")))


def scrubbed(c: Column) -> Column:
    """(text, n): doctors' names become the word, in up to four rounds."""
    count = lambda t, p: F.regexp_count(t, F.lit(p))

    def step(s: Column) -> Column:
        def named(t: Column) -> Column:
            return F.struct(T.drop(T.drop(t, R.DOCTOR_NAMED, "dokter"), R.DOCTOR_TWICE, "dokter").alias("text"), (s["n"] + count(s["text"], R.DOCTOR_KNOWN) + count(t, R.DOCTOR_NAMED)).alias("n"))

        return let(T.drop(s["text"], R.DOCTOR_KNOWN, "dokter"), named)

    began = F.struct(c.alias("text"), F.lit(0).alias("n"))
    out = F.when(~has_any(c, ("dr.", "drg.", "dokter", *R.KNOWN_DOCTORS)), began).otherwise(rounds(began, 4, step))
    return let(out, lambda s: F.struct(T.strip(T.drop(s["text"], r"\s{2,}", " ")).alias("text"), s["n"].alias("n")))


# ------------------------------------------------------------------ strict cleaning


def _strict(normalized: Column, answer: bool) -> Column:
    leaked = (r"(?i)\b(?:" + "|".join(R.LEAKED_NAMES) + r")\b", " ")
    first = ladder(normalized, (leaked, *R.STRICT_FIRST))

    def rest(t: Column) -> Column:
        t = ladder(T.split_glued(t), R.STRICT_ANSWER if answer else R.STRICT_QUESTION)
        t = ladder(without_address(t), ((R.LEAD_BANG, ""), (R.TITLED, " ")))
        t = T.drop(rounds(t, 3, lambda x: T.strip(T.drop(x, R.DOCTOR_TRAIL))), R.DOCTOR_INSIDE, "dokter")
        if answer:
            name = lambda x: F.lower(F.regexp_extract(x, R.TRAIL_NAME, 1))
            t = let(t, lambda x: F.when((name(x) != "") & ~name(x).isin(*R.TRAIL_NAME_STOP), T.strip(T.drop(x, R.TRAIL_NAME))).otherwise(x))
        t = without_address(without_greeting(t))
        return T.squeeze(ladder(t, R.STRICT_LAST))

    return let(first, lambda t: F.struct(rest(t).alias("text"), T.glued_count(t).alias("glued")))


def strict_question(normalized: Column) -> Column:
    """(text, glued): the strict rules in order on a normalised text, and how many glued words were split."""
    return _strict(normalized, False)


def strict_answer(normalized: Column) -> Column:
    return _strict(normalized, True)


# ------------------------------------------------------------------ ends


def tail_trimmed(c: Column) -> Column:
    """(text, cut): without pointers to other texts at the end, in up to three rounds; what was cut ends in a full stop."""

    def step(s: Column) -> Column:
        def shortest(t: Column) -> Column:
            heads = F.array(*[let(before(t, p), lambda h: F.when(h != "", F.struct(F.length(h).alias("n"), h.alias("head")))) for p in R.CITATION_TAILS])
            return F.array_min(F.array_compact(heads))["head"]

        head = let(T.strip_end(s["text"]), shortest)
        return let(head, lambda h: F.struct(F.when(h.isNull(), s["text"]).otherwise(trimmed(h, r" ,:;\-")).alias("text"), (s["cut"] | h.isNotNull()).alias("cut")))

    began = F.struct(c.alias("text"), F.lit(False).alias("cut"))
    out = F.when(~has_any(c, R.TAIL_WORDS), began).otherwise(rounds(began, 3, step))
    return let(out, lambda s: F.struct(F.when(s["cut"] & (s["text"] != "") & ~T.ended(s["text"]), F.concat(s["text"], F.lit("."))).otherwise(s["text"]).alias("text"), s["cut"].alias("cut")))


def truncation_trimmed(c: Column) -> Column:
    """(text, status): noop, kept (cut at its last sentence end) or drop."""

    def judged(t: Column) -> Column:
        last = T.last_word(t)
        whole = T.ended(t) | last.isin(*R.SIGN_OFF_WORDS) | ((last != "") & ~last.isin(*R.DANGLING_WORDS))
        ended = T.strip(F.regexp_extract(t, r"(?s)^(.*[.!?])(?:\s|$)", 1))
        status = F.when(whole, "noop").when(F.length(ended) >= R.MIN_REPAIRED_CHARS, "kept").otherwise("drop")
        return let(status, lambda x: F.struct(F.when(x == "kept", ended).otherwise(c).alias("text"), x.alias("status")))

    return let(T.strip_end(c), judged)


# ------------------------------------------------------------------ answers of an older source


def _signed(pattern: str, least: int, may: Step) -> Step:
    """Without a signature of a few words at the end; may tells texts that can have one."""

    def step(t: Column) -> Column:
        near = lambda head: T.word_count(F.substring(t, F.length(head) + 1, F.length(t))) <= R.SIGNATURE_WORDS
        cut = let(before(t, pattern), lambda head: F.when((F.length(head) >= least) & near(head), trimmed(head, r" .,;:\-")).otherwise(t))
        return F.when(may(t), cut).otherwise(t)

    return step


def _pointers(t: Column) -> Column:
    """Sentences without the short pointer to another text or a platform that they end in; those with little else go."""

    def sentence(s: Column) -> Column:
        def judged(head: Column) -> Column:
            bare = trimmed(head, r" ,;:\-—")
            ended = F.when(bare.rlike("[.!?]$"), bare).otherwise(F.concat(bare, F.lit(".")))
            return F.when(head.isNull() | (F.length(s) - F.length(head) > R.POINTER_CHARS), s).when(F.length(bare) >= R.HEAD_CHARS, ended)

        return let(before(s, R.POINTER), judged)

    cut = F.array_join(F.array_compact(F.transform(F.split(t, R.SENTENCE_END), sentence)), " ")
    return T.strip(F.when(has_any(t, R.POINTER_WORDS) & t.rlike(R.POINTER), cut).otherwise(T.drop(t, r"([.!?])(?:\s{2,}|[\t\n\x0b\f\r])", "$1 ")))


def _typos(t: Column) -> Column:
    return F.when(has_any(t, map(str.lower, R.TYPOS)), ladder(t, tuple((rf"\b{wrong}\b", right) for wrong, right in R.TYPOS.items()))).otherwise(t)


def _abbreviated(pattern: str, by: str) -> Step:
    return lambda t: F.when(has_any(t, ("dll", "dsb", "dst")), T.drop(t, pattern, by)).otherwise(t)


_NAMES = r"(?i)[\s.,;:-]*(?:dr\.?\s+|drg\.?\s+)?(?:" + "|".join(map(re.escape, R.SIGNATURE_NAMES)) + r")\b.*$"
_STARTS = r"(?<=[a-z])\s(?=[A-Z])(?=(?:" + "|".join(R.SENTENCE_STARTERS) + r")\b)"


def _credited(t: Column) -> Column:
    """Whether the end may be one of the credentials: by its last characters, unless they are no more than what may follow one, or end a line."""
    return let(T.last_chars(T.strip_end(t), 100), lambda x: x.rlike(r"(?:Med|Sci?|Ked|Sp\.?[A-Z().\-]*|Kes|MARS|FINASIM|drg?\.)\.?$") | x.rlike(r"(?:[A-Z().\-]{80}|[\x{85}\x{2028}\x{2029}])$"))


_named = lambda t: has_any(t, map(str.lower, R.SIGNATURE_NAMES))
#: The rules of the older source, in order, by name.
CONSERVATIVE: tuple[tuple[str, Step], ...] = (
    ("sig_name", _signed(_NAMES, 0, _named)),
    ("sig_cred", _signed(R.CREDENTIALS, 1, _credited)),
    ("sig_name", _signed(_NAMES, 0, _named)),
    ("sig_cred", _signed(R.CREDENTIALS, 1, _credited)),
    ("sentence_split", lambda t: T.drop(t, _STARTS, ". ")),
    ("platform_or_ref", _pointers),
    ("prep_di", lambda t: T.drop(t, R.PREPOSITION_DI, "di $1")),
    ("prep_ke", lambda t: T.drop(t, R.PREPOSITION_KE, "ke $1")),
    ("triple", T.collapse_triples),
    ("comma_space", lambda t: T.drop(t, R.COMMA_LETTER, ", ")),
    ("abbr_comma", _abbreviated(R.ABBREVIATION_COMMA, ", ")),
    ("abbr_dot", _abbreviated(R.ABBREVIATION_DOT, "$1.")),
    ("typo_map", _typos),
    ("add_period", T.finish_sentence),
)
RULES = tuple(dict.fromkeys(name for name, _ in CONSERVATIVE))


def conservative(c: Column) -> Column:
    """(text, fired): the rules of the older source in order, and the names of those that changed something."""
    blanks = F.when(F.contains(c, F.lit("  ")) | F.contains(c, F.lit("\t")), T.drop(c, "[ \t]+", " ")).otherwise(c)
    out = F.struct(T.strip(blanks).alias("text"), F.array().cast("array<string>").alias("fired"))

    def step(name: str, rule: Step) -> Step:
        told = lambda s, after: F.when(after != s["text"], F.array_append(s["fired"], F.lit(name))).otherwise(s["fired"])
        return lambda s: let(rule(s["text"]), lambda after: F.struct(after.alias("text"), told(s, after).alias("fired")))

    for name, rule in CONSERVATIVE:
        out = let(out, step(name, rule))
    ordered = lambda fired: F.filter(F.array(*map(F.lit, RULES)), lambda r: F.array_contains(fired, r))
    return let(out, lambda s: F.struct(s["text"].alias("text"), ordered(s["fired"]).alias("fired")))
