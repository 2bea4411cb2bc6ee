"""Removal of boilerplate from article bodies: ordered steps, each a Column expression over the text and its lines.

Steps are applied with a projection each (`cleaned`), as nested ones would repeat their input over and over. A step looks at the
lines of those texts only that it can change: `Step.needs` says which, by plain searches that are far cheaper than the step.
Patterns start with (?U), so that white space and word characters are those of Unicode.
"""

from collections.abc import Callable
from functools import partial, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import EMAIL, HANGUL, LATIN, count_of, is_title_line, script_ratio, strip

# The limits and patterns of the steps.
LEAST_LENGTH = 100
LEAST_SHARE = 0.5
CAPTION_KEEPS = 0.3
SUMMARY_LINES = 6
COPYRIGHT_LINE = 80
UI_LINE = 40
CAPTION_LINE = 100
HEADER_LINE = 20
BODY_BEFORE_HEADER = 100
PHOTO_CAPTION = 200
FOREIGN_LETTERS = 40
FOREIGN_SHARE = 0.7
SUBTITLE_LENGTH = 60
SUBTITLE_LINES = 4
SUMMARY_NOTE = r"(?U)^\s*전체\s*내용을\s*이해하기\s*위해서는\s*기사\s*본문과\s*함께\s*읽어야\s*합니다\.?\s*$"
AGENCY_TAG = r"(?U)^\s*(?:\([^()]{1,30}=[^()]{1,30}\)|\[[^\[\]]{1,30}=[^\[\]]{1,30}\])"
AGENCY_PREFIX = AGENCY_TAG + r"\s*[가-힣]{2,4}\s*(?:기자|특파원)\s*=\s*"
RESALE_TAIL = r"(?iuU)\*?\s*재판매\s*및\s*DB\s*금지\s*\.?\s*$"
EMAIL_PROTECTED = r"(?iuU)\[\s*email\s*protected\s*\]"
DATE_TAIL = r"(?iuU)\d{4}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}\s*\.?\s*(?:[\w.\-]+@[\w.\-]+\.\w+|\[\s*email\s*protected\s*\])?\s*$"
COPYRIGHT = r"(?iuU)(무단\s*전재|재배포|저작권자|ⓒ|©|copyright)"
COPYRIGHT_NOTICE = r"(?iuU)[<\[(]?\s*(?:ⓒ|©|copyright)?[^.\n]{0,40}?(?:무단\s*전재|재배포|저작권자)[^.\n]{0,40}?(?:금지|엄금)\s*[>\])]?\.?"
BYLINE = r"(?U)^\s*(?:[가-힣A-Za-z]+\s*=\s*)?[가-힣]{2,4}\s*기자(?:\s*[\w.\-]+@[\w.\-]+)?\s*$"
OUTLET_FOOTER = r"(?U)^\s*◎?\s*공감언론\s*뉴시스"
UI_TEXT = r"(?U)^\s*(?:기사\s*본문\s*영역|읽어주기\s*기능|브라우저에서만\s*사용|Google\s*선호\s*출처|Google에서\s.{1,20}?(?:자주\s*보기|선택해\s*주세요)\.?\s*$)"
BRACKET_BYLINE = r"\[[^\[\]]{0,30}(?:기자|특파원)[^\[\]]{0,30}\]"
ANGLE_BYLINE = r"<[^<>]{0,30}(?:기자|특파원)[^<>]{0,10}>"
PAREN_BYLINE = r"(?mU)^(\s*)\([^()=]{0,20}[가-힣]{2,4}\s*(?:기자|특파원)\)\s*"
CAPTION_TAIL = r"(?U)(?:모습|장면)\s*\.?\s*$"
TERMINATOR = r"(?U)^\s*\(끝\)"
ORNAMENTS = r"^[\[\]<>()【】〔〕·■□◆◇●○▶▷►▸☞※★☆|\-*• \t]+|[\[\]<>()【】〔〕·■□◆◇●○▶▷►▸☞※★☆|\-*• \t]+$"
# Headers of other articles, as lines of their own and glued to the text.
SECTION_HEADERS = (
    "관련기사", "관련 기사", "연관기사", "추천기사", "추천 기사", "많이 본 뉴스", "많이본 뉴스", "많이 본 기사", "인기기사", "인기 기사", "주요뉴스", "주요 뉴스", "핫이슈", "실시간 뉴스", "최신기사", "최신 기사", "이시각 주요뉴스",
    "포토뉴스", "많이 읽은 기사", "베스트 클릭", "이 기사 어때요", "함께 보면 좋은 기사", "오늘의 주요뉴스", "관련 키워드", "관련키워드", "제보하기",
)
HEADER_WORDS = ("기사", "뉴스", "핫이슈", "베스트 클릭", "키워드", "제보하기")
INLINE_HEADERS = ("관련 키워드", "관련키워드", "관련 기사", "관련기사")
NAMED_HEADER = f"(?:{'|'.join(SECTION_HEADERS)})"
PHOTO_CREDIT = r"(?U)\s*(?:\d{4}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}\.?\s*)?[ⓒ©]\s*[가-힣A-Za-z0-9]{1,10}\s+[가-힣]{2,4}\s*기자"
TO_LAST_SENTENCE = r"""(?sU)^(.*[.!?]["'”’]?\s+)"""
SENTENCE_TAIL = r"""(?U)[.!?]["'”’)]?\s*$"""
#: A line that is neither blank nor a list item: a mark alone is none.
INNER_LINE = r"(?U)^\s*+(?![-*•]\s+\S|[▶▷►☞※])\S"
#: In lines, not at their ends: what becomes one space. White space at a line's ends.
WIDE_SPACE = "[ \t\u00a0]{2,}|[\t\u00a0]"
LINE_ENDS = r"(?U)[\s&&[^\n]]+(?=\n)|(?<=\n)[\s&&[^\n]]+"
#: White space other than spaces, tabs and line ends; with those next to each other, all that the last step may change within a text.
RARE_SPACE = r"(?U)[\s&&[^\n\t ]]"
UNEVEN_SPACE = ("|", "\t", "  ", " \n", "\n ", "\n\n\n")


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def holding(*words: str) -> Callable[[Column], Column]:
    """Of texts, whether they hold one of the words: without, the step has nothing to do."""
    return lambda text: reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def space_at_ends(text: Column) -> Column:
    return matches(F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))), r"(?U)\s")


def stripped(text: Column) -> Column:
    """strip, for long texts: most have nothing to lose. An array of one, so that the text has a name and is computed once."""
    return F.transform(F.array(text), lambda t: F.when(space_at_ends(t), strip(t)).otherwise(t))[0]


def _length(lines: Column) -> Column:
    return F.length(F.array_join(F.transform(lines, strip), ""))


def caption_lines(text: Column, lines: Column) -> Column:
    """Lines that begin or end with a pipe go, unless hardly anything would be left: then the page was a table."""
    piped = lambda line: strip(line).startswith("|") | strip(line).endswith("|")
    kept = F.filter(lines, lambda line: ~piped(line))
    return F.when((_length(lines) > 0) & (_length(kept) < _length(lines) * CAPTION_KEEPS), text).otherwise(joined(kept))


def summary_box(text: Column, lines: Column) -> Column:
    """All up to a note that ends an automatic summary, if it stands near the top."""
    at = F.array_position(F.transform(F.slice(lines, 1, SUMMARY_LINES), lambda line: matches(line, SUMMARY_NOTE)), True)
    return F.when(at > 0, joined(F.slice(lines, at.cast("int") + 1, F.greatest(F.size(lines), F.lit(1))))).otherwise(text)


def agency_prefixes(text: Column, lines: Column) -> Column:
    """Photo captions of agencies go; of a lead, only the prefix does."""
    first = F.transform(lines, lambda line: F.when(matches(line, RESALE_TAIL), F.when(~matches(line, AGENCY_TAG), F.regexp_replace(line, RESALE_TAIL, ""))).otherwise(line))
    then = F.transform(first, lambda line: F.when(matches(line, AGENCY_PREFIX), F.when(~matches(line, DATE_TAIL), F.regexp_replace(line, AGENCY_PREFIX, ""))).otherwise(line))
    return joined(F.filter(then, lambda line: line.isNotNull()))


def boilerplate_lines(text: Column, lines: Column) -> Column:
    """Copyright lines (of long ones only the notice), bylines, the outlet's footer, hints of the page."""
    cut = F.transform(lines, lambda line: F.when(matches(line, COPYRIGHT), F.when(F.length(line) > COPYRIGHT_LINE, F.regexp_replace(line, COPYRIGHT_NOTICE, " "))).otherwise(line))
    footer = lambda line: (F.length(line) <= COPYRIGHT_LINE) & matches(line, OUTLET_FOOTER)
    hint = lambda line: (F.length(strip(line)) <= UI_LINE) & matches(line, UI_TEXT)
    return joined(F.filter(cut, lambda line: line.isNotNull() & ~matches(line, BYLINE) & ~footer(line) & ~hint(line)))


def bylines(text: Column, lines: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, BRACKET_BYLINE, ""), ANGLE_BYLINE, ""), PAREN_BYLINE, "$1")


def unmarked_captions(text: Column, lines: Column) -> Column:
    """Short lines that end like a caption."""
    return joined(F.filter(lines, lambda line: ~((strip(line) != "") & (F.length(strip(line)) <= CAPTION_LINE) & matches(strip(line), CAPTION_TAIL))))


def terminator(text: Column, lines: Column) -> Column:
    at = F.array_position(F.transform(lines, lambda line: matches(line, TERMINATOR)), True).cast("int")
    return F.when(at > 0, joined(F.slice(lines, 1, at - 1))).otherwise(text)


def section_headers(text: Column, lines: Column) -> Column:
    """The text ends at a header of other articles behind enough body; headers before that only lose their line."""
    bare = lambda line: F.regexp_replace(strip(line), ORNAMENTS, "")
    named = NAMED_HEADER
    # Of each line once: its length, and whether it is a header, for which it must hold one's words.
    header = lambda line: matches(line, named) & (F.length(bare(line)) <= HEADER_LINE) & matches(bare(line), f"^{named}")
    seen = F.transform(lines, lambda line: F.struct(line.alias("line"), F.length(strip(line)).alias("length"), header(line).alias("header")))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("body"), F.lit(None).cast("int").alias("cut"))

    def step(state: Column, x: Column) -> Column:
        ends = state["cut"].isNull() & x["header"] & (state["body"] >= BODY_BEFORE_HEADER)
        return F.struct((state["i"] + 1).alias("i"), (state["body"] + F.when(x["header"], 0).otherwise(x["length"])).alias("body"), F.when(ends, state["i"]).otherwise(state["cut"]).alias("cut"))

    def left(all_lines: Column) -> Column:
        cut = F.aggregate(all_lines, start, step, lambda state: F.coalesce(state["cut"], state["i"]))
        return joined(F.transform(F.filter(F.slice(all_lines, 1, cut), lambda x: ~x["header"]), lambda x: x["line"]))

    # An array of one, so that the lines' properties have a name and are computed once.
    return F.transform(F.array(seen), left)[0]


def inline_headers(text: Column, lines: Column) -> Column:
    """The text ends at a header that is glued to the word before it, behind enough body."""
    pattern = rf"(?sU)^(\s*\S.{{{BODY_BEFORE_HEADER - 1},}}?(?<=\S))(?:{'|'.join(INLINE_HEADERS)})"
    return F.when(matches(text, pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def photo_captions(text: Column, lines: Column) -> Column:
    """Photo credits go with the caption before them: all of a short stretch, else its last sentence."""

    def left(part: Column) -> Column:
        body = F.regexp_replace(part, r"(?U)\s+\z", "")
        return F.when(F.length(strip(part)) <= PHOTO_CAPTION, F.lit("")).otherwise(F.regexp_extract(F.substring(body, F.lit(1), F.length(body) - 1), TO_LAST_SENTENCE, 1))

    def line_of(line: Column) -> Column:
        parts = F.split(line, PHOTO_CREDIT, -1)
        some = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, left(p)).otherwise(p))
        return F.when(F.size(parts) > 1, F.array_join(F.filter(some, lambda p: strip(p) != ""), " ")).otherwise(line)

    return joined(F.transform(lines, line_of))


def edge_lists(text: Column, lines: Column) -> Column:
    """List items and blank lines at both ends; lists within the text are facts."""
    inner = F.transform(lines, lambda line, i: F.when(matches(line, INNER_LINE), i))
    low, high = F.array_min(inner), F.array_max(inner)
    return F.when(low.isNull(), F.lit("")).otherwise(joined(F.slice(lines, low + 1, high - low + 1)))


def outer_lists(text: Column) -> Column:
    """Whether the first or the last line is blank or a list item."""
    return ~(matches(F.substring_index(text, "\n", 1), INNER_LINE) & matches(F.substring_index(text, "\n", -1), INNER_LINE))


def emails(text: Column, lines: Column | None = None) -> Column:
    return F.regexp_replace(F.when(text.contains("@"), F.regexp_replace(text, EMAIL, "")).otherwise(text), EMAIL_PROTECTED, "")


def foreign_lines(text: Column, lines: Column, own: str = HANGUL, foreign: str = LATIN) -> Column:
    """Lines with many letters, most of them foreign."""

    def drop(line: Column) -> Column:
        a, b = count_of(line, own), count_of(line, foreign)
        return matches(line, foreign_run(foreign)) & (a + b >= FOREIGN_LETTERS) & (b >= (a + b) * FOREIGN_SHARE)

    return joined(F.filter(lines, lambda line: ~drop(line)))


def foreign_run(foreign: str) -> str:
    """A line with as many foreign letters as one that goes has at least. foreign: a class of characters."""
    return rf"(?:{foreign}[^{foreign[1:-1]}\n]*+){{{int(FOREIGN_LETTERS * FOREIGN_SHARE)}}}"


def without_foreign_lines(own: str = HANGUL, foreign: str = LATIN) -> "Step":
    return Step("foreign_lines", partial(foreign_lines, own=own, foreign=foreign), lambda text: matches(text, foreign_run(foreign)))


def whitespace(text: Column, lines: Column) -> Column:
    """Runs of spaces and tabs become a space; none at the ends of lines; at most one blank line at a time."""
    one = F.regexp_replace(F.replace(text, F.lit("|"), F.lit(" ")), WIDE_SPACE, " ")
    return strip(F.regexp_replace(F.regexp_replace(one, LINE_ENDS, ""), "\n{3,}", "\n\n"))


def uneven_space(text: Column) -> Column:
    return space_at_ends(text) | holding(*UNEVEN_SPACE)(text) | matches(text, RARE_SPACE)


def below_title(lines: Column) -> Column:
    """Without the first line, and the short lines after it that end no sentence."""
    subtitle = lambda line: (strip(line) != "") & (F.length(strip(line)) <= SUBTITLE_LENGTH) & ~matches(line, SENTENCE_TAIL)
    flags = F.transform(F.slice(lines, 2, SUBTITLE_LINES), subtitle)
    other = F.array_position(flags, False).cast("int")
    skipped = F.when(other > 0, other).otherwise(F.size(flags) + 1)
    return stripped(joined(F.slice(lines, skipped + 1, F.size(lines))))


def title_block(text: Column, lines: Column, title: Column) -> Column:
    """A first line that is the title, and the short lines after it that end no sentence."""
    return F.when(is_title_line(lines[0], title), below_title(lines)).otherwise(text)


class Step(NamedTuple):
    name: str
    apply: Callable[[Column, Column], Column]
    #: Whether the step may change a text; null counts as no. Without it, every text is worked on.
    needs: Callable[[Column], Column] | None = None
    #: As how many lines a text is given: the last one holds the rest. -1: all.
    most_lines: int = -1


def boilerplate(text: Column) -> Column:
    return holding("무단", "재배포", "저작권자", "ⓒ", "Ⓒ", "©", "기사", "기자", "공감언론", "읽어주기", "브라우저에서만", "Google")(text) | matches(text, "[Cc](?iu:opyright)")


def headers(text: Column) -> Column:
    """Whether a header's words occur; a look for the few words that are in all headers comes first."""
    return holding(*HEADER_WORDS)(text) & matches(text, NAMED_HEADER)


#: The order matters: an inline header must still be glued to the credit that a later step removes.
STEPS = (
    Step("caption_lines", caption_lines, holding("|")), Step("summary_box", summary_box, holding("내용을")), Step("agency_prefixes", agency_prefixes, holding("재판매", "기자", "특파원")), Step("boilerplate_lines", boilerplate_lines, boilerplate),
    Step("bylines", bylines, holding("기자", "특파원")), Step("unmarked_captions", unmarked_captions, holding("모습", "장면")), Step("terminator", terminator, holding("(끝)")), Step("section_headers", section_headers, headers),
    Step("inline_headers", inline_headers, holding(*INLINE_HEADERS)), Step("photo_captions", photo_captions, holding("ⓒ", "©")), Step("edge_lists", edge_lists, outer_lists), Step("emails", emails, holding("@", "[")),
    without_foreign_lines(), Step("whitespace", whitespace, uneven_space),
)


def applied(df: DataFrame, step: Step, column: str) -> DataFrame:
    """One step in projections of its own: the lines are split once, and only of texts that need the step."""
    text, lines = F.col(column), F.split(F.col(column), "\n", step.most_lines)
    with_lines = df.withColumn("_lines", lines if step.needs is None else F.when(step.needs(text), lines))
    changed = step.apply(text, F.col("_lines"))
    # A null text has no lines either, and is the step's own matter.
    out = changed if step.needs is None else F.when(F.col("_lines").isNotNull() | text.isNull(), changed).otherwise(text)
    return with_lines.withColumn(column, out).drop("_lines")


def cleaned(df: DataFrame, text_col: str, out_col: str = "cleaned", title_col: str | None = None, steps: tuple[Step, ...] = STEPS, report_col: str | None = None) -> DataFrame:
    """out_col: the text after all steps ('' for null or blank). report_col: struct (step, removed) of the steps that made it shorter."""
    out = df.withColumn(out_col, F.when(matches(F.col(text_col), r"(?U)\S"), F.col(text_col)).otherwise(F.lit("")))
    todo = list(steps)
    if title_col is not None:
        first_is_title = lambda text: is_title_line(F.substring_index(text, "\n", 1), F.col(title_col))
        todo.append(Step("title_block", lambda text, lines: below_title(lines), first_is_title, SUBTITLE_LINES + 2))
    sizes = []
    for i, step in enumerate(todo):
        if report_col:
            out = out.withColumn(f"_size_{i}", F.length(out_col))
            sizes.append(f"_size_{i}")
        out = applied(out, step, out_col)
    # Filters on the result must stay above the steps: moved below, they would repeat every step within the next. Spark moves no
    # filter below a projection that is not deterministic.
    out = out.withColumn(out_col, F.when(F.monotonically_increasing_id() >= 0, F.col(out_col)))
    if report_col:
        after = [F.col(x) for x in sizes[1:]] + [F.length(out_col)]
        parts = [F.struct(F.lit(step.name).alias("step"), (F.col(before) - now).alias("removed")) for step, before, now in zip(todo, sizes, after, strict=True)]
        out = out.withColumn(report_col, F.filter(F.array(*parts), lambda x: x["removed"] > 0)).drop(*sizes)
    return out


def gated(df: DataFrame, column: str, least_length: int | Column = LEAST_LENGTH, least_share: float | None = LEAST_SHARE, script: str = HANGUL, others: str = LATIN) -> DataFrame:
    """Texts that are long enough and, unless least_share is None, mostly of one script."""
    out = df.where(F.length(column) >= least_length)
    return out if least_share is None else out.where(script_ratio(F.col(column), script, others) >= least_share)
