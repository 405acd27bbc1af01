"""Text and number expressions shared by the operators."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Results must equal those of other systems that index the same texts.
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)?"
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below "
    "between both but by can could did do does doing down during each few for from further had has have "
    "having he her here hers herself him himself his how i if in into is it its itself just me more most my "
    "myself no nor not now of off on once only or other our ours ourselves out over own same she should so "
    "some such than that the their theirs them themselves then there these they this those through to too "
    "under until up very was we were what when where which while who whom why will with would you your "
    "yours yourself yourselves s t d ll m o re ve y"
).split()
MISSING = (
    "#n/a n/a na n.a. n.a nan none null — – - -- ... … * ** (*) x s . #value! #div/0! #ref! (d) (x) (na) n.s. † ‡"
).split()
NUMBER = r"^\(?[-+−]?\$?\s?(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d+)?\)?\s?%?$"
RANGE = r"^[-−]?\d+(?:\.\d+)?\s?[–—-]\s?[-−]?\d+(?:\.\d+)?%?$|^\d+-\d/\d$"
CITATION = r"\[([DWM]\d+(?:\s*[,;]\s*[DWM]\d+)*)\]"
CHART_WORDS = (
    "percent percentage points basis billions millions trillions of dollars ratio index monthly weekly daily quarterly annual "
    "average median rate thousands jobs level change share number scale log right left years months z-score standard "
    "deviations % = nsa sa saar"
).split()
MONTH_NAMES = "january february march april may june july august september october november december".split()
# End of the fixed values.

_TICK = r"^(?:[-+]?\$?\(?[-+]?\d[\d,]*(?:\.\d+)?\)?%?|(?:jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)\.?|q[1-4]|h[12]|\d{4}:[qh][1-4]|[-–—+=|]|n\.?a\.?)$"


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers, decimals kept whole; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0), F.array().cast("array<string>"))


def content_tokens(text: Column) -> Column:
    """tokens without stop words."""
    return F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS))


def sort_date(date: Column) -> Column:
    """A date of any precision ('2024', '2024-03', '2024-03-05') as the last text of its year or month that sorts after all its days."""
    text = F.trim(date)
    return F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-12-31"))).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-31"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10))


def filed_date(date: Column) -> Column:
    """Where a document of this date is filed: the middle of its month, the last day of its year; other texts stay as they are."""
    return F.when(date.rlike(r"^\d{4}-\d{2}$"), F.concat(date, F.lit("-15"))).when(date.rlike(r"^\d{4}$"), F.concat(date, F.lit("-12-31"))).otherwise(date)


def date_bound(date: Column, end: bool) -> Column:
    """A filter's date as the first or last text of its year or month; compared as text only, for '2026-02-31' is no date."""
    month, day = ("-12", "-31") if end else ("-01", "-01")
    return F.when(date.rlike(r"^\d{4}$"), F.concat(date, F.lit(month + day))).when(date.rlike(r"^\d{4}-\d{2}$"), F.concat(date, F.lit(day))).otherwise(date)


def plain_number(text: Column) -> Column:
    """The number of a cell: thousands commas, currency marks and percent signs left out; null for marks of missing values and other text."""
    return F.regexp_replace(F.trim(text), r"[,$€£%\s]", "").try_cast("double")


def cell(text: Column) -> Column:
    """A cell's text with single spaces; null for an empty one."""
    return F.nullif(F.trim(F.regexp_replace(text, r"[\s ]+", " ")), F.lit(""))


def is_missing(text: Column) -> Column:
    """Whether a cell holds one of the marks of a missing value."""
    return F.coalesce(F.lower(F.trim(text)).isin(MISSING), F.lit(False))


def number_in(text: Column) -> Column:
    """A cell's number: parentheses and the typographic minus are signs, currency, commas and a percent sign are left out; null for other text."""
    s = F.replace(F.trim(text), F.lit("−"), F.lit("-"))
    size = F.regexp_replace(s, r"[()$,%\s]", "").try_cast("double")
    return F.when(s.rlike(NUMBER) & s.rlike(r"\d"), F.when(s.rlike(r"^\(.*\)$"), -size).otherwise(size))


def is_value(text: Column, ranges: bool = False) -> Column:
    """Whether a cell is a data value: a number or a mark of a missing one; with ranges also '1.3–1.8'."""
    found = number_in(text).isNotNull() | is_missing(text)
    return F.coalesce(found | F.trim(text).rlike(RANGE) if ranges else found, F.lit(False))


def period_of(text: Column) -> Column:
    """The period a label names, as '2003', '2003-06', '2003-Q1' or '2003-06-30'; null for any other label."""
    s = F.regexp_replace(F.trim(text), r"^(\d{4}|\d{6})\.0$", "$1")
    part = lambda pattern, k: F.regexp_extract(s, pattern, k)
    short, quarter, turned, us = r"^(\d{2}):Q([1-4])$", r"(?i)^(\d{4})\s?[:-]?\s?Q([1-4])$", r"(?i)^Q([1-4])\s?[:-]?\s?(\d{4})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    month, packed, day = r"^(\d{4})[-/](\d{2})$", r"^((?:19|20)\d\d)(0[1-9]|1[0-2])$", r"^(\d{4}-\d{2}-\d{2})(?:[ T]00:00:00)?$"
    century = F.when(part(short, 1) < "60", F.lit("20")).otherwise(F.lit("19"))
    return (
        F.when(s.rlike(short), F.concat(century, part(short, 1), F.lit("-Q"), part(short, 2)))
        .when(s.rlike(quarter), F.concat(part(quarter, 1), F.lit("-Q"), part(quarter, 2)))
        .when(s.rlike(turned), F.concat(part(turned, 2), F.lit("-Q"), part(turned, 1)))
        .when(s.rlike(month), F.concat_ws("-", part(month, 1), part(month, 2)))
        .when(s.rlike(packed), F.concat_ws("-", part(packed, 1), part(packed, 2)))
        .when(s.rlike(day), part(day, 1))
        .when(s.rlike(us), F.concat_ws("-", part(us, 3), F.lpad(part(us, 1), 2, "0"), F.lpad(part(us, 2), 2, "0")))
        .when(s.rlike(r"^(?:18|19|20)\d\d$"), s)
    )


def _shown(v: float) -> str | None:
    if v is None or v != v:
        return None
    return str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else f"{v:.6g}" if abs(v) >= 1e-4 else f"{v:.3g}"


@F.pandas_udf(StringType())
def shown_number(values: pd.Series) -> pd.Series:
    """A number as a cell shows it: whole numbers without a point, others with six significant digits, tiny ones with three."""
    return values.map(_shown)


# Characters and what stands for them.
SPACES = "     \t"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
# End of the fixed values.


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normal_text(text: Column) -> Column:
    """Text with ligatures written out, one kind of space and hyphen, no soft hyphens, composed letters and single spaces; line breaks stay."""
    out = F.translate(text, SPACES + "−‑­", " " * len(SPACES) + "--")
    for mark, letters in LIGATURES.items():
        out = F.replace(out, F.lit(mark), F.lit(letters))
    return F.regexp_replace(F.when(out.rlike(r"[^\x00-\x7f]"), _composed(out)).otherwise(out), " {2,}", " ")


def is_numeric_noise(text: Column) -> Column:
    """Whether a row is a chart's ticks rather than content: numbers, months and quarters only, or up to four of these and unit words; an empty row is."""
    words = F.filter(F.split(F.lower(text), r"[\s|]+"), lambda w: w != "")
    tick = lambda w: w.rlike(_TICK)
    unit = lambda w: tick(w) | F.regexp_replace(w, r"^[().,:]+|[().,:]+$", "").isin(CHART_WORDS)
    return F.forall(words, tick) | ((F.size(words) <= 4) & F.forall(words, unit))


def furniture_key(text: Column) -> Column:
    """A running header's or footer's text so that it is the same on every page: digits and roman numerals are '#'."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", "#"), r"\b[ivxlc]+\b", "#"), r"[\s|]+", " "))


def joined_lines(lines: Column) -> Column:
    """Lines (an array) as one text; a word broken at a line's end is put together."""
    text = F.array_join(lines, "\n")
    return F.regexp_replace(F.regexp_replace(text, r"([A-Za-z])-\n(\p{Ll})", "$1$2"), "\n", " ")


def is_heading(text: Column, n_rows: Column, size: Column, all_bold: Column, body_size: Column) -> Column:
    """Whether a short paragraph reads like a heading: larger than the body, or bold throughout, and neither caption nor sentence."""
    plain = (F.length(text) <= 160) & (n_rows <= 3) & ~text.rlike(r"(?i)^(?:figure|table|sources?|notes?|chart|exhibit)\b")
    open_end = ~text.rlike(r"[.,;]$") | text.endswith("etc.")
    return plain & open_end & ((size >= body_size + 1.5) | (all_bold & (size >= body_size - 0.6)))


def sql_names(labels: Column) -> Column:
    """Unique names of columns for their labels (an array): letters and digits in lower case, '%' as pct, later ones of a name numbered from 2."""
    base = lambda x: F.substring(F.regexp_replace(F.regexp_replace(F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("%"), F.lit(" pct ")), "[^0-9a-z]+", "_"), "^_+|_+$", ""), 1, 60)
    named = F.transform(labels, lambda x: F.when(base(x) == "", F.lit("col")).when(base(x).rlike(r"^\d"), F.concat(F.lit("c_"), base(x))).otherwise(base(x)))

    def add(taken: Column, name: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda i: F.when(i == 1, name).otherwise(F.concat_ws("_", name, i.cast("string"))))
        return F.concat(taken, F.slice(F.filter(tries, lambda t: ~F.array_contains(taken, t)), 1, 1))

    return F.aggregate(named, F.array().cast("array<string>"), add)


def slug(text: Column, length: int = 40) -> Column:
    """ASCII letters and digits in lower case, joined by '_', cut at `length`."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(F.substring(plain, 1, length), "^_+|_+$", "")


def part_name(title: Column, sheet: Column, nth: Column, n_tables: Column) -> Column:
    """Name of one of a document's tables: by its number in the title, by its sheet, or by its place."""
    numbered = r"(?i)^(table|figure|exhibit|chart)\s+([0-9]+(?:\.[0-9a-z]+)?)"
    return (
        F.when(title.rlike(numbered), slug(F.concat_ws("_", F.regexp_extract(title, numbered, 1), F.regexp_extract(title, numbered, 2))))
        .when(F.length(sheet) > 0, slug(sheet, 30)).when(n_tables == 1, F.lit("")).otherwise(F.concat(F.lit("t"), nth.cast("string")))
    )


def series_title(title: Column) -> Column:
    """A title without months, years, ranges of years and all that is no letter, in lower case: equal for the releases of a series."""
    bare = F.regexp_replace(F.lower(title), rf"\b(?:{'|'.join(MONTH_NAMES)})\b", " ")
    bare = F.regexp_replace(bare, r"\b(?:19|20)\d{2}(?:\s*[–-]\s*\d{2,4})?\b", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z]+", " "))


def heading_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def locator(unit: Column, start: Column, end: Column) -> Column:
    """'p. 4' or 'pp. 4-5' of paged documents, 'table 3', else 'part 2' or 'parts 2-3'."""
    last = F.coalesce(F.nullif(end, F.lit(0)), start)
    a, b = start.cast("string"), last.cast("string")
    one = start == last
    return (
        F.when(unit == "page", F.when(one, F.concat(F.lit("p. "), a)).otherwise(F.concat(F.lit("pp. "), a, F.lit("-"), b)))
        .when(unit == "table", F.concat(F.lit("table "), a))
        .otherwise(F.when(one, F.concat(F.lit("part "), a)).otherwise(F.concat(F.lit("parts "), a, F.lit("-"), b)))
    )


def passage_header(title: Column, date: Column, section: Column) -> Column:
    head = F.concat(F.coalesce(title, F.lit("")), F.lit(" ("), F.coalesce(date, F.lit("")), F.lit(")"))
    return F.when(F.length(section) > 0, F.concat(head, F.lit("\nSection: "), section)).otherwise(head)


def citation_label(kind: Column, title: Column, table: Column, unit: Column, start: Column, end: Column) -> Column:
    """How a passage is cited: its title with the table's name, or with its place in the document."""
    place = F.when(kind == "table", F.concat(F.lit("data table `"), table, F.lit("`"))).otherwise(locator(F.coalesce(unit, F.lit("page")), start, end))
    return F.concat_ws(", ", title, place)


def cited_ids(text: Column) -> Column:
    """Ids cited as [D3] or [D3, W1], each once, in order of first appearance."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), 1)
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[,;]\s*"))))


def known_citations(text: Column, known: Column) -> Column:
    """text with each group of citations as single ones, without those that aren't in known (an array)."""
    pieces = F.split(F.regexp_replace(text, CITATION, "\u0001$1\u0001"), "\u0001")
    ids = lambda p: F.filter(F.split(p, r"\s*[,;]\s*"), lambda i: F.array_contains(known, i))
    rebuilt = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.array_join(F.transform(ids(p), lambda x: F.concat(F.lit("["), x, F.lit("]"))), "")).otherwise(p))
    return F.trim(F.array_join(rebuilt, ""))


def evidence_url(url: Column, fmt: Column, unit: Column, page: Column) -> Column:
    """A document's address, at the page of a PDF."""
    paged = (F.coalesce(fmt, F.lit("pdf")) == "pdf") & (F.coalesce(unit, F.lit("page")) == "page")
    return F.when(paged, F.concat(url, F.lit("#page="), F.coalesce(page, F.lit(1)).cast("string"))).otherwise(url)


def us_date(text: Column) -> Column:
    """'10/1/2026 1:30:00 PM' as '2026-10-01'; empty for anything else."""
    day = F.try_to_timestamp(F.split(F.trim(text), r"\s+")[0], F.lit("M/d/yyyy"))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Text with character references resolved and single spaces."""
    return texts.map(lambda t: " ".join(html.unescape(t).split()), na_action="ignore")


def _object(text: str) -> str | None:
    bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", text.strip())
    inner = bare[bare.find("{") : bare.rfind("}") + 1]
    for piece in (bare, inner):
        try:
            value = json.loads(piece)
        except ValueError:
            continue
        return json.dumps(value if isinstance(value, dict) else {"value": value}, ensure_ascii=False)
    return None


@F.pandas_udf(StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """The JSON object in an answer, without fences and text around it; other values become {"value": ...}, null where there is none."""
    return texts.map(_object, na_action="ignore")
