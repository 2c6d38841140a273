"""Building the text a model reads and reading the text a model returns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gabble import catalog
from gabble.functions import text as T

_FIRST_BLOCK = r"(?s)\{.*?\}"
_OUTER_BLOCK = r"(?s)\{.*\}"
_WHOLE_OBJECT = r"(?s)\A\{.*\}\z"
_WHOLE_ARRAY = r"(?s)\A\[.*\]\z"
_WHOLE_SCALAR = (
    r'(?s)\A(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|"(?:[^"\\]|\\.)*")\z'
)

FLAGS_SCHEMA = "speedskating boolean, performance boolean, negative boolean"


def context(subreddit: Column, thread: Column, comment: Column, *,
            thread_chars: int | None = None, comment_chars: int | None = None) -> Column:
    """Comment with its subreddit and thread, the form zero-shot classifiers get."""
    return F.format_string(
        catalog.CONTEXT_FORMAT, subreddit,
        T.truncate(T.strip_control(T.filled(thread)), thread_chars),
        T.truncate(T.strip_control(T.filled(comment)), comment_chars),
    )


def prompt(person: Column, subreddit: Column, thread: Column, comment: Column, *,
           preamble: str = "", thread_chars: int | None = None,
           comment_chars: int | None = None) -> Column:
    """Instruction preamble followed by the fields of one comment, the form chat models get."""
    body = F.format_string(catalog.PROMPT_FORMAT, person,
                           T.truncate(T.filled(thread), thread_chars), subreddit,
                           T.truncate(T.filled(comment), comment_chars))
    return F.concat(F.lit(preamble), body) if preamble else body


def pronoun(gender: Column) -> Column:
    """Pronoun pair used in candidate labels."""
    return F.when(gender == "vrouw", "she/her").otherwise("he/him")


def evaluation_labels(persoon: Column, full_name: Column, pronouns: Column, subreddit: Column,
                      off_topic: Iterable[str] = catalog.OFF_TOPIC_SUBREDDITS) -> Column:
    """Candidate pair (about, not about): the first name, or the full name in off-topic places."""
    short = F.array(F.format_string(catalog.EVALUATES_FORMAT, persoon, pronouns),
                    F.format_string(catalog.NOT_ABOUT_FORMAT, persoon))
    full = F.array(F.format_string(catalog.EVALUATES_FULL_FORMAT, full_name, pronouns),
                   F.format_string(catalog.NOT_ABOUT_FULL_FORMAT, full_name, full_name))
    return F.when(T.member(subreddit, off_topic), full).otherwise(short)


def about_labels(persoon: Column) -> Column:
    """Candidate pair of the two-way decision."""
    return F.array(F.format_string(catalog.ABOUT_FORMAT, persoon),
                   F.format_string(catalog.NOT_ABOUT_SIMPLE_FORMAT, persoon))


def first_object(response: Column) -> Column:
    """The response as a JSON object: the whole text, else its first ``{…}`` block, else null.

    The block ends at the first closing brace, so a nested object after prose is unreadable. A
    response that is one JSON value of another kind is readable but no object, hence null too.
    """
    stripped = T.strip(response)

    def read(t: Column) -> Column:
        other_kind = t.rlike(_WHOLE_SCALAR) | (
            t.rlike(_WHOLE_ARRAY) & F.try_parse_json(t).isNotNull())
        whole = F.when(t.rlike(_WHOLE_OBJECT), F.try_parse_json(t))
        block = F.try_parse_json(F.nullif(F.regexp_extract(t, _FIRST_BLOCK, 0), F.lit("")))
        return F.when(~other_kind, F.coalesce(whole, block))

    return T.bind(stripped, read)


def _member_text(obj: Column, name: str, absent: str = "") -> Column:
    """A member as text: its value, ``None`` for a JSON null, or ``absent`` when it is not there."""
    value = F.try_variant_get(obj, f"$.{name}", "string")
    is_null = F.is_variant_null(F.try_variant_get(obj, f"$.{name}", "variant"))
    return F.coalesce(value, F.when(is_null, F.lit("None")), F.lit(absent))


def relevance_answer(response: Column, allowed: Iterable[str] = catalog.RELEVANCE_LABELS, *,
                     reason_chars: int | None = None, raw_chars: int | None = None) -> Column:
    """Validated struct ``label, confidence, reason, raw`` of a model response.

    Reason and raw text are kept whole unless limits are given.

    Labels are trimmed and upper-cased; any label outside ``allowed`` and any unreadable response
    gives label ``ERROR`` with the cause as reason.
    """
    stripped = T.strip(response)

    def validate(obj: Column) -> Column:
        label = T.strip(F.upper(_member_text(obj, "label")))
        cause = F.when(
            obj.isNull(),
            F.concat(F.lit("Could not parse JSON from: "), T.truncate(stripped, reason_chars)),
        ).otherwise(F.concat(F.lit("Bad label: '"), label, F.lit("'")))
        good = F.struct(
            label.alias("label"),
            F.lower(_member_text(obj, "confidence")).alias("confidence"),
            T.truncate(_member_text(obj, "reason"), reason_chars).alias("reason"),
            T.truncate(response, raw_chars).alias("raw"),
        )
        bad = F.struct(
            F.lit("ERROR").alias("label"),
            F.lit("").alias("confidence"),
            T.truncate(F.concat(F.lit("parse_fail: "), cause), reason_chars).alias("reason"),
            F.lit("").alias("raw"),
        )
        return F.when(label.isin(*allowed), good).otherwise(bad)

    return T.bind(first_object(response), validate)


def flags_answer(response: Column) -> Column:
    """Struct of three nullable booleans from the text between the outermost braces."""
    block = F.nullif(F.regexp_extract(response, _OUTER_BLOCK, 0), F.lit(""))
    return F.from_json(block, FLAGS_SCHEMA)
