"""What documents and code declare in marks: drift notes, endpoints, variables, sections, review dates; and a run as XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .drift import path_key
from .extract import numbered_lines

METHODS = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS"
TEST_FILE = r"(^|/)(__tests__|tests?|spec)/|\.(test|spec)\.[^.]+$"
#: The form of a note on a deviation.
DRIFT = r"(?i)(?://|#|/\*|--)[ \t]*DRIFT:[ \t]*(.+)"
#: Variables of the system, which no document needs to name.
SYSTEM_VARIABLES = (
    "PATH", "HOME", "USER", "USERNAME", "SHELL", "PWD", "OLDPWD", "TMPDIR", "TEMP", "TMP", "LANG", "LC_ALL", "LC_CTYPE", "LC_MESSAGES", "TZ",
    "EDITOR", "VISUAL", "PAGER", "TERM", "COLORTERM", "DISPLAY", "SSH_AUTH_SOCK", "SSH_CONNECTION", "SSH_TTY", "XDG_CONFIG_HOME", "XDG_DATA_HOME",
    "XDG_CACHE_HOME", "XDG_RUNTIME_DIR",
)


def drift_comments(df: DataFrame, path: str, text: str, tests: bool = False) -> DataFrame:
    """``path, line, comment`` of notes that admit a deviation, in other than test files unless ``tests``."""
    files = df.where(F.contains(F.col(text), F.lit("DRIFT:")))
    files = files if tests else files.where(~F.col(path).rlike(TEST_FILE))
    return numbered_lines(files, path, text).where(F.col("content").rlike(DRIFT)).select(path, "line", t.trimmed(F.regexp_extract("content", DRIFT, 1)).alias("comment"))


def documented_endpoints(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, method, path``: endpoints in headings and table rows of a reference, each once, paths as ``path_key`` gives them."""
    head = rf"(?i)^#{{2,6}}[ \t]+`?({METHODS})`?[ \t]+`?(/[^ \t\r`|]+)`?"
    rows = numbered_lines(df, key, text).where(F.col("content").rlike(head) | F.contains("content", F.lit("|")))
    plain = lambda x: t.trimmed(F.regexp_replace(x, "`", ""))
    cells = F.filter(F.transform(F.split("content", r"\|"), t.trimmed), lambda x: x != "")
    first = F.upper(plain(F.coalesce(F.try_element_at(cells, F.lit(1)), F.lit(""))))
    route = F.try_element_at(F.filter(F.transform(F.slice(cells, 2, 1_000_000), plain), lambda x: x.startswith("/")), F.lit(1))
    is_head, is_row = F.col("content").rlike(head), first.rlike(f"^({METHODS})$")
    method = F.when(is_head, F.upper(F.regexp_extract("content", head, 1))).when(is_row, first)
    raw = F.when(is_head, F.regexp_extract("content", head, 2)).when(is_row, route)
    return rows.select(key, method.alias("method"), path_key(raw).alias("path")).where("method IS NOT NULL AND length(path) >= 2").distinct()


def documented_variables(docs: DataFrame, text: str) -> DataFrame:
    """``name`` of variables in backticks or in the first column of a table, without those of the system."""
    ticks = F.regexp_extract_all(F.col(text), F.lit("`([A-Z][A-Z0-9_]*[A-Z0-9])`"), F.lit(1))
    table = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^[ \t\r\n\f]*\|[ \t]*([A-Z][A-Z0-9_]*[A-Z0-9])[ \t]*\|"), F.lit(1))
    names = docs.select(F.explode(F.concat(ticks, table)).alias("name"))
    return names.where((F.length("name") >= 3) & ~F.col("name").isin(*SYSTEM_VARIABLES)).distinct()


def example_variables(files: DataFrame, text: str) -> DataFrame:
    """``name`` of variables that an example of an environment file sets."""
    return files.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^([A-Z][A-Z0-9_]*[A-Z0-9])[ \t]*="), F.lit(1))).alias("name")).distinct()


def undocumented_variables(reads: DataFrame, documented: DataFrame) -> DataFrame:
    """``name`` of variables that code reads and nothing documents; those documented and not read are no finding."""
    return reads.select("name").distinct().join(documented.select("name").distinct(), "name", "left_anti")


def sections(df: DataFrame, key: str, text: str, mark: str = "folioscope:section") -> DataFrame:
    """``key, open_line, close_line, id, source, body`` of marked sections; they don't nest.

    A close without an open is nothing, and an open that meets another open is given
    up, so that no body ever holds lines that a person wrote between two sections.
    """
    opens, closes = rf"^[ \t]*<!--[ \t]*{mark}\b(.*?)-->[ \t]*$", rf"^[ \t]*<!--[ \t]*/{mark}[ \t]*-->[ \t]*$"
    marks = numbered_lines(df, key, text).where(F.col("content").rlike(opens) | F.col("content").rlike(closes))
    w = Window.partitionBy(key).orderBy("line")
    is_close = F.col("content").rlike(closes)
    paired = marks.select(key, F.col("line").alias("close_line"), is_close.alias("is_close"), F.lag("line").over(w).alias("open_line"), F.lag("content").over(w).alias("opened"), F.lag(is_close).over(w).alias("after_close"))
    paired = paired.where("is_close AND NOT after_close")
    tail = F.regexp_extract("opened", opens, 1)

    def attribute(name: str) -> Column:
        form = rf"""(?:^|[ \t]){name}[ \t]*=[ \t]*(?:"([^"]*)"|'([^']*)'|([^ \t"']+))"""
        return F.concat(*[F.regexp_extract(tail, form, k) for k in (1, 2, 3)])

    found = paired.select(key, "open_line", "close_line", attribute("id").alias("id"), F.coalesce(F.nullif(attribute("source"), F.lit("")), F.lit("code")).alias("source"))
    lines = df.select(key, t.lines(F.col(text)).alias("_lines"))
    body = F.array_join(F.slice("_lines", F.col("open_line").cast("int") + 1, F.col("close_line").cast("int") - F.col("open_line").cast("int") - 1), "\n")
    return found.join(lines, key).select(key, "open_line", "close_line", "id", "source", body.alias("body"))


def review_marks(df: DataFrame, key: str, text: str, today: str, mark: str = "folioscope") -> DataFrame:
    """``key, reviewed, status``: the first date of review, null if it is no date or over a day ahead of ``today``, and the first status."""
    date = F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(F.col(text), rf"<!--\s*{mark}:last-reviewed\s+([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\s*-->", 1), F.lit("")), F.lit("yyyy-MM-dd")))
    status = F.lower(F.nullif(F.regexp_extract(F.col(text), rf"(?i)<!--\s*{mark}:status\s+([a-z]+)\s*-->", 1), F.lit("")))
    return df.select(key, F.when(date <= F.date_add(F.lit(today).cast("date"), 1), date).alias("reviewed"), status.alias("status"))


def xml_escaped(x: Column) -> Column:
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(raw), F.lit(code))
    return x


def junit(rows: DataFrame, findings: DataFrame, project: str, timestamp: str) -> DataFrame:
    """One row ``junit``: a run (``guard.run`` with ``threw``) and its findings as a JUnit document.

    Errors are a failure, one that threw an error, warnings text of a test that passes,
    and what was skipped or didn't apply a skipped test. For reports, which are short.
    """
    code, place = F.when(F.col("code").isNotNull(), F.concat(F.lit("["), F.col("code"), F.lit("] "))).otherwise(""), F.when(F.col("location").isNotNull(), F.concat(F.lit(" ("), F.col("location"), F.lit(")"))).otherwise("")
    line = F.struct("seq", F.concat(code, F.col("message"), place).alias("line"), F.col("message"), F.coalesce("code", F.lit("folioscope")).alias("code"))
    is_error = F.coalesce(F.col("severity") == "error", F.lit(False))
    texts = findings.groupBy("validator").agg(F.array_sort(F.collect_list(F.when(is_error, line))).alias("e"), F.array_sort(F.collect_list(F.when(~is_error, line))).alias("w"))
    x = rows.join(texts, "validator", "left")
    body = lambda c: xml_escaped(F.array_join(F.transform(c, lambda f: f["line"]), "\n"))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    off, failed = F.col("status").isin("skipped", "na"), some(F.col("e"))
    crashed = ~off & ~failed & (F.col("status") == "fail")
    attrs = F.concat(F.lit('name="'), xml_escaped(F.col("validator")), F.lit('" classname="folioscope.guard"'))
    case = lambda *inner: F.concat(F.lit("    <testcase "), attrs, F.lit(">\n      "), *inner, F.lit("\n    </testcase>"))
    crash = F.coalesce("threw", F.lit("validator failed without structured findings"))
    xml = (
        F.when(off, F.concat(F.lit("    <testcase "), attrs, F.lit("><skipped/></testcase>")))
        .when(failed, case(F.lit('<failure message="'), xml_escaped(F.col("e")[0]["message"]), F.lit('" type="'), xml_escaped(F.col("e")[0]["code"]), F.lit('">'), body("e"), F.lit("</failure>")))
        .when(crashed, case(F.lit('<error message="'), xml_escaped(F.coalesce("threw", F.lit("validator failed"))), F.lit('" type="folioscope.crash">'), xml_escaped(crash), F.lit("</error>")))
        .when(some(F.col("w")), case(F.lit("<system-out>"), body("w"), F.lit("</system-out>")))
        .otherwise(F.concat(F.lit("    <testcase "), attrs, F.lit("/>")))
    )
    cases = x.select("place", xml.alias("xml"), (~off & failed).alias("failed"), crashed.alias("crashed"), off.alias("off"))
    one = cases.agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("f"), F.count_if("crashed").alias("c"), F.count_if("off").alias("s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "xml"))), lambda r: r["xml"]), "\n").alias("xml"))
    counts = F.format_string('tests="%d" failures="%d" errors="%d"', "n", "f", "c")
    suite = F.concat(F.lit('  <testsuite name="folioscope guard — '), xml_escaped(F.lit(project)), F.lit('" '), counts, F.format_string(' skipped="%d"', "s"), F.lit(' timestamp="'), xml_escaped(F.lit(timestamp)), F.lit('">\n'))
    inner = F.when(F.col("n") > 0, F.concat("xml", F.lit("\n"))).otherwise("")
    return one.select(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<testsuites '), counts, F.lit(">\n"), suite, inner, F.lit("  </testsuite>\n</testsuites>")).alias("junit"))
