"""Text expressions that stay in the JVM.

``\\w`` of these rules is any Unicode letter or digit or ``_``, and stripping removes every Unicode space, so both are
spelled out as classes.  All functions take null for an empty text unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SPACES = r"[\s\p{Z}]"

# The lower-case letters with marks that tell Vietnamese words.
VIETNAMESE = "áàảãạăắằẳẵặâấầẩẫậđéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵ"

# Warnings about the characters of a text.
NO_TEXT = "Scanned PDF: Document contains no extractable text."
REPLACED = "Weird character: Document contains corrupted encoding or replacement characters (\\ufffd/null bytes)."
CONTROL = "Weird character: Document contains invalid control characters (%d found)."
PRIVATE = "Weird character: Document contains private use area / unmappable font characters (%d found)."
CONTROL_CLASS = r"[^\x{00}-\x{08}\x{0B}\x{0E}-\x{1F}]+"
PRIVATE_CLASS = r"[^\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def strip(value: Column) -> Column:
    """Without any Unicode white space at the ends."""
    return F.regexp_replace(F.regexp_replace(text_of(value), f"^{SPACES}+", ""), f"{SPACES}+$", "")


def clean_markup(value: Column) -> Column:
    """Lower-case content without tags, link targets and Markdown signs.

    Entities and composition are left alone; :func:`tamis.functions.python.normalised` does those first.
    """
    text = F.regexp_replace(text_of(value), r"<[^>]+>", " ")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^\)]+\)", "$1")
    text = F.regexp_replace(text, "[–—−]", "-")
    text = F.lower(F.regexp_replace(text, r"[*_#`|~>•]", " "))
    return strip(F.regexp_replace(text, f"{SPACES}+", " "))


def words_only(value: Column) -> Column:
    """Lower-case words with one space between them; tags are dropped first."""
    text = F.regexp_replace(F.lower(text_of(value)), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "))


def contains_text(value: Column, markup: Column, words: Column) -> Column:
    """Whether a text stands in a source, given the source's :func:`clean_markup` and :func:`words_only` forms.

    By its clean form, else by its words, else line by line if it has several.  A text without content always does.
    """
    lines = F.filter(F.transform(F.split(text_of(value), "\n"), words_only_line), lambda x: x["kept"])
    by_line = (F.size(lines) > 1) & F.forall(lines, lambda x: (x["words"] == "") | F.contains(words, x["words"]))
    clean, own = clean_markup(value), words_only(value)
    return (clean == "") | F.contains(markup, clean) | (own == "") | F.contains(words, own) | by_line


def words_only_line(line: Column) -> Column:
    return F.struct((strip(line) != "").alias("kept"), words_only(line).alias("words"))


def markdown_warnings(value: Column) -> Column:
    """Warnings, in order, about a text that was read from a file."""
    text = text_of(value)
    control = F.length(F.regexp_replace(text, CONTROL_CLASS, ""))
    private = F.length(F.regexp_replace(text, PRIVATE_CLASS, ""))
    return F.array_compact(
        F.array(
            F.when(~text.rlike(r"[\p{L}\p{N}]"), F.lit(NO_TEXT)),
            F.when(text.rlike(r"[\x{FFFD}\x{00}]"), F.lit(REPLACED)),
            F.when(control > 0, F.format_string(CONTROL, control)),
            F.when(private > 0, F.format_string(PRIVATE, private)),
        )
    )


#: Runs of letters, digits and ``_`` that are plain letters and marked ones only, and those of them with a marked one; every marked
#: letter is one and the same by then, as a class of many letters is slow.
MARK = "á"
_RUN = r"[\p{L}\p{N}_]"
LANGUAGE_WORD = f"[a-zA-Z{MARK}](?<!{_RUN}.)[a-zA-Z{MARK}]*+(?!{_RUN})"
MARKED_WORD = f"[a-zA-Z{MARK}](?<!{_RUN}.)(?:(?<={MARK})|[a-zA-Z]*+{MARK})[a-zA-Z{MARK}]*+(?!{_RUN})"


def language_counts(value: Column) -> Column:
    """``struct<words, marked>``: words of plain letters and marked lower-case ones, and how many of them hold a mark."""
    text = F.translate(text_of(value), VIETNAMESE, MARK * len(VIETNAMESE))
    marked = F.when(F.contains(text, F.lit(MARK)), F.regexp_count(text, F.lit(MARKED_WORD))).otherwise(0)
    return F.struct(F.regexp_count(text, F.lit(LANGUAGE_WORD)).alias("words"), marked.alias("marked"))


def language_status(counts: Column) -> Column:
    """``unknown``, ``english``, ``bilingual`` or ``vietnamese`` for :func:`language_counts`."""
    total, marked = counts["words"], counts["marked"]
    return (
        F.when(total == 0, "unknown")
        .when(marked < 2, "english")
        .when(100 * marked >= 15 * total, "vietnamese")
        .otherwise("bilingual")
    )


def normal_email(value: Column) -> Column:
    return F.regexp_replace(F.lower(strip(value)), "^mailto:", "")


def normal_phone(value: Column) -> Column:
    """Digits, with the country code 84 as 0."""
    return F.regexp_replace(F.regexp_replace(text_of(value), r"[^\p{Nd}]", ""), "^84", "0")


def tokens(items: Column) -> Column:
    """Distinct lower-case tokens of an array of strings; ``+``, ``#`` and ``-`` belong to words."""
    joined = F.regexp_replace(F.lower(F.array_join(items, " ")), r"[^\p{L}\p{N}_+#\-]+", " ")
    return F.array_distinct(F.filter(F.split(joined, " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if one has no length."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def distinct_capped(items: Column, most: int) -> Column:
    """Stripped, without empties and repeats, in the order of first occurrence, at most ``most``."""
    filled = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda x: x != "")
    return F.slice(F.array_distinct(filled), 1, most)


def valid_score(value: Column) -> Column:
    """A score from 0 to 100 read from a text, or null.

    All but digits and points is dropped first, so ``85/100`` is out of range and ``-5`` is 5; halves round to even.
    """
    text = strip(value)
    number = F.when(~text.startswith("<") & text.rlike(r"\p{Nd}"), F.regexp_replace(text, "[^0-9.]", "")).try_cast("double")
    score = F.bround(number).cast("long")
    return F.when(score.between(0, 100), score.cast("int"))


def safe_name(value: Column) -> Column:
    """A name for a file: everything but letters, digits, ``_`` and ``-`` becomes ``_``."""
    return F.regexp_replace(text_of(value), "[^a-zA-Z0-9_-]", "_")


def file_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*[/\\]", "")


def stem(name: Column) -> Column:
    """A file's name without its last ending."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def natural_key(name: Column) -> Column:
    """A sort key in which runs of digits, however long, count as numbers: lower case, and each run after its length in ten digits."""
    pieces = F.regexp_extract_all(F.lower(text_of(name)), F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def sized(digits: Column) -> Column:
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), sized(F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(p)), "")


def html_escaped(value: Column) -> Column:
    text = text_of(value)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text
