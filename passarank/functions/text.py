"""Text preparation as column expressions."""

from string import Formatter

from pyspark.sql import functions as F

from passarank.fixed_values import ALLOWED_CHARACTERS, SYLLABUS_ROWS, TITLE_SUFFIX

NO_STRINGS = "array<string>"
# White space of every script, and the four separators that Python counts as such.
SPACE, NO_SPACE = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"


def strip(text):
    """Remove white space, line breaks included, at both ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def normalize(text, any_language=False):
    """Keep Hangul, ASCII letters and digits; each run of anything else becomes one space.

    ``any_language`` keeps the letters and digits of every script instead. Joining the runs to
    keep is nine times as fast as replacing the others, whose pattern is a negated class.
    """
    kept = r"\p{L}\p{N}" if any_language else ALLOWED_CHARACTERS
    return F.array_join(F.regexp_extract_all(text, F.lit(f"[{kept}]+"), F.lit(0)), " ")


def title_prefix(title):
    """First word of a title, cut at the first ``(`` and then at the first ``[``; blank gives NULL."""
    word = F.nullif(F.regexp_extract(title, rf"(?U)^{SPACE}*({NO_SPACE}+)", 1), F.lit(""))
    return F.substring_index(F.substring_index(word, "(", 1), "[", 1)


def strip_ordinal(text):
    """Remove a leading ``12: ``."""
    return F.regexp_replace(text, r"^\d+:\s*", "")


def sentences(text):
    """Split a document into sentences at ``. ! ?`` followed by white space."""
    return F.split(text, r"(?<=[.!?])\s+")


def lines(text):
    """Split at line breaks; a trailing break leaves a trailing empty item."""
    return F.split(text, "\n")


def title_sentence(title, suffix=TITLE_SUFFIX):
    """One synthetic passage made from a title, or none if the title is blank."""
    prefix = title_prefix(title)
    return F.when(prefix.isNotNull(), F.array(F.concat(prefix, F.lit(suffix)))).otherwise(no_strings())


def no_strings():
    return F.array().cast(NO_STRINGS)


def concat_lists(*lists):
    """Concatenate arrays of strings in the order given, a missing array counting as empty."""
    return F.concat(*[F.coalesce(part, no_strings()) for part in lists])


def leading_int(text):
    """The first character as an integer, NULL if it is not a digit."""
    return F.substring(text, 1, 1).try_cast("int")


def words(line):
    return F.split(strip(line), rf"(?U){SPACE}+")


def timeslot(text):
    """First word of every line, joined by spaces; a blank line adds nothing."""
    first = F.transform(lines(text), lambda line: F.nullif(F.try_element_at(words(line), F.lit(1)), F.lit("")))
    return F.array_join(first, " ")


def room(text):
    """All words of the first line but the first; empty if there are none."""
    first_line = words(F.try_element_at(lines(text), F.lit(1)))
    return F.array_join(F.slice(first_line, 2, F.greatest(F.size(first_line) - 1, F.lit(0))), " ")


def search_key(number, name):
    return F.concat_ws(" ", number, name)


def two_cells(first, second):
    return F.concat(first, F.lit("\n"), second)


def numbered_lines(rows, label, content, limit=SYLLABUS_ROWS):
    """The first ``limit`` rows (a feature of the format), each written as ``label: content`` and a line break.

    ``label`` and ``content`` map a row of the array to a text column.
    """
    kept = F.slice(rows, 1, limit)
    written = F.transform(kept, lambda row: F.concat(strip(label(row)), F.lit(": "), strip(content(row)), F.lit("\n")))
    return F.array_join(written, "")


def fill(template, **columns):
    """Fill the ``{slots}`` of a template with columns; NULL fills nothing in."""
    parts = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if slot:
            parts.append(F.coalesce(columns[slot].cast("string"), F.lit("")))
    return F.concat(*parts)
