"""Text functions as Column expressions. (?U) makes \\s, \\w and \\b cover all of Unicode in Java's patterns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as an e-mail address and as a URL when scripts are counted.
EMAIL = r"(?U)[\w.\-]+@[\w.\-]+\.\w+"
URL = r"(?U)https?://\S+|www\.\S+"
HANGUL, LATIN = "[가-힣]", "[A-Za-z]"
LATIN_RUN = r"[A-Za-z][A-Za-z0-9\s.,'\-]{20,}"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim only takes spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def squash(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def collapse(c: Column) -> Column:
    """Runs of white space become a space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalized_keyword(c: Column) -> Column:
    return collapse(c)


def excerpt(c: Column, length: int = 120) -> Column:
    """The first characters, then collapsed."""
    return collapse(F.substring(F.coalesce(c, F.lit("")), 1, length))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n+"), strip), lambda p: p != "")


def title_key(c: Column) -> Column:
    """Letters and digits of a title without its last ' - publisher'; case stays."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)^(.*) - .*\z", "$1"), r"[^\p{L}\p{N}]", "")


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def script_ratio(c: Column, script: str = HANGUL, others: str = LATIN) -> Column:
    """The share of one script among its and the others' letters, without URLs and addresses; 0 without letters."""
    sample = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), URL, " "), EMAIL, " ")
    own, rest = count_of(sample, script), count_of(sample, others)
    return F.when(own + rest > 0, own / (own + rest)).otherwise(F.lit(0.0))


def longest_latin_run(c: Column) -> Column:
    """For reports on rejected texts; null if there is none."""
    runs = F.regexp_extract_all(c, F.lit(LATIN_RUN), F.lit(0))
    return F.when(F.size(runs) > 0, F.reduce(runs, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a)))


def mention_pattern(keyword: Column) -> Column:
    """A pattern for the keyword's words with or without space between them, whatever the case; null for a blank keyword."""
    quoted = F.transform(F.split(collapse(keyword), " "), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.when(collapse(keyword) != "", F.concat(F.lit("(?iuU)"), F.array_join(quoted, r"\s*")))


def mentions(body: Column, keyword: Column) -> Column:
    return F.coalesce(F.regexp_count(F.coalesce(body, F.lit("")), mention_pattern(keyword)), F.lit(0))


def mentioned(title: Column, keyword: Column) -> Column:
    return F.coalesce(F.regexp_like(F.coalesce(title, F.lit("")), mention_pattern(keyword)), F.lit(False))


def density(count: Column, length: Column, digits: int = 2) -> Column:
    """Mentions for each 1,000 characters; 0 for an empty body."""
    return F.when(length > 0, F.bround(count * 1000.0 / length, digits)).otherwise(F.lit(0.0))


def csv_cell(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def plain(c: Column) -> Column:
    """Without tags; entities are decoded in textloom.sources.html.unescaped."""
    return F.regexp_replace(c, "<[^>]+>", "")


def is_title_line(line: Column, title: Column, least_prefix: int = 10) -> Column:
    """The line is the title, or begins with what is left of a title that was cut with dots."""
    own, whole = squash(line), squash(title)
    prefix = squash(F.regexp_replace(title, r"(?U)\s*(?:\.{2,}|…)\s*\z", ""))
    cut = (prefix != whole) & (F.length(prefix) >= least_prefix) & own.startswith(prefix)
    same = F.coalesce((own != "") & (whole != "") & ((own == whole) | cut), F.lit(False))
    # Equal as they stand, and not blank: nothing has to be replaced to tell.
    return F.when(line == title, F.regexp_like(line, F.lit(r"(?U)\S"))).otherwise(same)
