"""License scans: canonical digests of entire texts, looked up among digests of known licences.

The canonical form of a text drops what does not tell licences apart: lines that are only a copyright notice, or only say that all
rights are reserved, go; A-Z become lower case; runs of anything but letters and digits become one space; equivalent spellings become one.
The SHA-256 of the form is joined to the known ones.

A line is a notice if it is one from its first to its last sign: comment marks, ``copyright``, ``(c)`` or ``©``, then years, names
and placeholders without an end of a sentence, without verbs or words of grants and limits, perhaps ``all rights reserved``, and
``NOTICE_LENGTH`` characters at most.  A line that says more, such as ``copyright holders be liable``, ``(c) You must retain`` or
``All rights reserved. Commercial use is forbidden.``, stays whole, so a text with terms of its own never matches.

A null text has the form and digest of an empty one and matches nothing, as does a text without letters or digits.  Very long texts are taken whole.
Rows are looked up alone: repeated rows agree; an empty table gives an empty result; of known licences with one digest the first name
counts.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.known_licenses import EVERY
from tamis.shared import col

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOTICE_LENGTH = 300
# Words that go on a sentence after ``copyright`` or ``(c)``.
_GOES_ON = (
    r"holders? owners? notices? licen[cs]e(?:s|d|es)? licensors? laws? lines? statements? interests? rights? protections? infring\w* claims? ownership status "
    "disclaimers? treat(?:y|ies) acts? permissions? management terms? grants? information headers? polic(?:y|ies) assignments? materials? violations? directives? "
    "conventions? subject works? and or on in of to is are was for as that which with may shall must also does means like you your it its an? if when where "
    "under neither either nor each every such no not all any this these redistributions?"
).split()
# Words that no plain name holds, in lower case or capitals, and in any case.
_SENTENCE = (
    "is are be was shall must may will hereby granted provided permission permitted warranty warranties liable liability notice notices means that which you "
    "your not redistribution redistributions redistribute distribute distributed this these licensed following without any if unless except nor under retain reproduce"
).split()
_TERMS = "use uses used using forbidden prohibited excluded allowed permitted granted grants void revoked restricted except unless hereby must shall only".split()
# Last words of names that are written in lower case, and words that end in a point inside a name.
_BODIES = "inc|ltd|llc|corp|corporation|gmbh|company|authors?|contributors?|foundation|project|developers?|maintainers?|team|community|university"
_SHORT = r"\p{L}|(?i:inc|ltd|corp|co|llc|gmbh|st|dr|jr|sr|mr|ms|mrs|dept|univ|assoc|bros|al)"

_BEFORE, _AFTER, _S = r"^[ \t\r#*/;.%!|<>-]*", r"[ \t\r*/#.>|;-]*$", r"[ \t]"
_C, _SIGN, _WORD = r"\([cC]\)", r"(?:\([cC]\)|©)", r"(?i:copyright)"
_EDGE, _END = r"(?:^|[ \t(,;:/\"'])", r"(?:[ \t\r,.;:!?)/\"']|$)"
_HEAD = rf"(?:{_WORD}|{_SIGN})(?:[ \t:,]*(?:{_WORD}|{_SIGN}))*[ \t:,]*"
_NAME = rf"(?:(?:{_SHORT})\.|[^ \t\r]*[^ \t\r.,!?;:]),*"
_RESERVED = r"(?i:all[ \t]+rights[ \t]+reserved)[.!]?"

#: What any notice holds; a cheap test of whole texts and of lines.
MENTION = r"(?i)copyright|\(c\)|©|all[ \t]+rights[ \t]+reserved"
#: A notice from its first to its last sign.
WHOLE = rf"{_BEFORE}(?:{_HEAD}{_NAME}(?:{_S}+{_NAME})*[.,;]?(?:{_S}*{_RESERVED})?|{_RESERVED}){_AFTER}"
#: How one begins or ends: a sign or colon, a name with a capital, a body's name, a year; ``(c)`` alone may number a clause.
SHAPE = (
    rf"{_BEFORE}(?:(?:{_WORD}{_S}*(?::{_S}*(?:{_SIGN}{_S}*)?|{_SIGN}{_S}*)|{_SIGN}{_S}*{_WORD}{_S}*:?{_S}*|©{_S}*)(?i:by[ \t]+)?[\p{{L}}\p{{N}}(<\[{{\"']"
    rf"|{_WORD}{_S}+(?i:by[ \t]+)?(?:(?:[Tt]he|THE){_S}+)?[\p{{Lu}}\p{{Lo}}0-9<\[{{\"']"
    rf"|{_C}{_S}*[0-9<\[{{]|{_C}{_S}*[^ \t\r]+{_AFTER}|{_RESERVED})"
    rf"|{_BEFORE}{_WORD}{_S}+[^\n]*[^\p{{L}}](?i:{_BODIES}){_AFTER}"
)
CLAUSE = rf"{_BEFORE}{_C}{_S}*[\p{{Lu}}\p{{Lo}}]|{_BEFORE}{_C}{_S}+[^\n]*[^\p{{L}}](?i:{_BODIES}){_AFTER}"
ARTICLE = rf"{_EDGE}(?:the|a|an|to|for|with|all|each|every|from|of){_END}"
GOES_ON = rf"{_BEFORE}{_HEAD}(?i:{'|'.join(_GOES_ON)}){_END}"
SAYS = rf"{_EDGE}(?:{'|'.join([*_SENTENCE, *map(str.upper, _SENTENCE)])}|(?i:{'|'.join(_TERMS)})){_END}"
OTHER = r"[^\p{L}\p{N}]+"

# Spellings that are read as equal, in canonical form.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("organis", "organiz"), ("authoris", "authoriz"), ("recognis", "recogniz"),
    ("favour", "favor"), ("honour", "honor"), ("labour", "labor"), ("per cent", "percent"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"), ("fulfil ", "fulfill "), ("and or ", "or "), ("https", "http"),
)


def is_notice(line: Column) -> Column:
    """Whether a line is a copyright notice and nothing else."""
    begins = line.rlike(SHAPE) | (line.rlike(CLAUSE) & ~line.rlike(ARTICLE))
    said = line.rlike(MENTION) & line.rlike(WHOLE) & begins & ~line.rlike(GOES_ON) & ~line.rlike(SAYS)
    return F.when(F.length(line) <= NOTICE_LENGTH, said).otherwise(F.lit(False))


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: ~is_notice(line))
    form = F.when(whole.rlike(MENTION), F.array_join(lines, "\n")).otherwise(whole)
    form = F.trim(F.regexp_replace(F.translate(form, UPPER, LOWER), OTHER, " "))
    for one, other in SPELLINGS:
        form = F.replace(form, F.lit(one), F.lit(other))
    return form


def license_scan(
    docs: DataFrame, known: Sequence[tuple[str, str]] = EVERY, id_col: str = "doc_id", text_col: str = "text", most_known: int = 100_000
) -> DataFrame:
    """For each row of ``docs``: ``doc_id``, the ``digest`` of its whole text and the ``license_id``, or null."""
    spark = docs.sparkSession
    listed = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(known)], "place int, license_id string, text string")
    names = listed.select("place", "license_id", canonical(F.col("text")).alias("form")).where("form <> ''")
    names = names.groupBy(F.sha2("form", 256).alias("known")).agg(F.min_by("license_id", "place").alias("license_id"))
    if len(known) <= most_known:  # under 10 MB; a longer list is joined by shuffle
        names = F.broadcast(names)
    digests = docs.select(col(id_col).alias("doc_id"), F.sha2(canonical(col(text_col)), 256).alias("digest"))
    return digests.join(names, F.col("digest") == F.col("known"), "left").select("doc_id", "digest", "license_id")


def oracle(known: Sequence[tuple[str, str]] = EVERY) -> str:
    """DuckDB SQL for :func:`license_scan` over ``documents``, with the whole texts of all known licences."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def matches(pattern: str) -> str:
        return f"regexp_matches(x, {quoted(pattern)})"

    begins = f"({matches(SHAPE)} OR ({matches(CLAUSE)} AND NOT {matches(ARTICLE)}))"
    notice = f"length(x) <= {NOTICE_LENGTH} AND {matches(MENTION)} AND {matches(WHOLE)} AND {begins} AND NOT {matches(GOES_ON)} AND NOT {matches(SAYS)}"

    def form(text: str) -> str:
        out = f"array_to_string(list_filter(string_split(coalesce({text}, ''), chr(10)), lambda x: NOT ({notice})), chr(10))"
        out = f"trim(regexp_replace(translate({out}, '{UPPER}', '{LOWER}'), {quoted(OTHER)}, ' ', 'g'), ' ')"
        for one, other in SPELLINGS:
            out = f"replace({out}, {quoted(one)}, {quoted(other)})"
        return out

    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(known))
    return f"""
WITH listed AS (SELECT license_id, place, {form('body')} AS form FROM (VALUES {rows}) v(place, license_id, body)),
known AS (SELECT sha256(form) AS digest, min_by(license_id, place) AS license_id FROM listed WHERE form <> '' GROUP BY 1),
d AS (SELECT doc_id, sha256({form('text')}) AS digest FROM documents)
SELECT doc_id, d.digest, license_id FROM d LEFT JOIN known ON known.digest = d.digest
"""
