"""Documents that may be out of date, by what a diff removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.shared import stored, work_folder
from . import text_index
from .extract import numbered_lines

CODE_FILE = r"\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|kt|rb|php|cs|swift|scala|dart)$"
#: Tokens that any document and any diff may share.
GENERIC = (
    "page", "components", "component", "shared", "nav", "state", "use", "set", "active", "tab", "react", "props", "prop", "string", "type", "types",
    "value", "values", "data", "status", "config", "client", "none", "all", "com", "https", "http", "url", "text", "download", "request", "response",
    "error", "index", "item", "items", "list", "name", "key", "map", "log", "update", "updated", "version", "content", "document", "description",
    "service", "services", "object", "array", "number", "boolean", "async", "await", "promise", "void", "render", "component", "element", "style",
    "styles", "class", "div", "span", "button", "input", "form", "label", "title", "header", "footer", "main", "font", "color", "colors", "tracking",
    "surface", "auto", "full", "next", "body", "sans", "blue", "accent", "size", "spacing", "margin", "padding", "width", "height", "flex", "grid",
    "bold", "bg", "rounded", "code", "json", "err", "error", "message", "auth", "get", "put", "post", "patch", "delete", "req", "res", "route",
    "routes", "handler", "endpoint", "method", "headers", "query", "params", "param", "cron", "process", "api", "path", "lib", "util", "utils",
    "helper", "helpers", "admin", "roles", "role", "user", "users", "email", "price", "json", "fetch", "axios", "send", "call",
)


def diff_files(df: DataFrame, key: str, diff: str) -> DataFrame:
    """``key, file, old_path, path, status`` (modified, added, deleted, renamed) of the files of a diff in git's form."""
    rows = numbered_lines(df, key, diff).where(F.col("content").rlike(r"^(diff --git|rename (from|to) |--- |\+\+\+ )"))
    file = F.sum(F.col("content").startswith("diff --git").cast("int")).over(Window.partitionBy(key).orderBy("line"))
    c, git = F.col("content"), r"^diff --git a/(.+?) b/(.+)$"
    found = lambda pattern, group: F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
    no_null = F.when(~c.rlike(r"^(---|\+\+\+) /dev/null$"), c)
    old = F.coalesce(found(git, 1), found("^rename from (.*)$", 1), F.nullif(F.regexp_extract(no_null, "^--- (?:a/)?(.*)$", 1), F.lit("")))
    new = F.coalesce(found(git, 2), found("^rename to (.*)$", 1), F.nullif(F.regexp_extract(no_null, r"^\+\+\+ (?:b/)?(.*)$", 1), F.lit("")))
    status = F.when(c.startswith("rename "), "renamed").when(c == "--- /dev/null", "added").when(c == "+++ /dev/null", "deleted")
    marked = rows.select(key, "line", file.cast("long").alias("file"), old.alias("old"), new.alias("new"), status.alias("s")).where("file > 0")
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col("line")))
    return marked.groupBy(key, "file").agg(last("old").alias("old_path"), last("new").alias("path"), F.coalesce(last("s"), F.lit("modified")).alias("status"))


def changed_tokens(lines: DataFrame, op: str = "delete") -> DataFrame:
    """``path, first_seq, token``: tokens of the removed (or added) lines of each file, once."""
    each = lines.where(F.col("op") == op).select("path", "seq", F.explode(t.tokens(F.col("text"))).alias("token"))
    return each.groupBy("path", "token").agg(F.min("seq").alias("first_seq"))


def suspects(docs: DataFrame, lines: DataFrame, key: str, text: str, least: int = 2, cap: int = 5) -> DataFrame:
    """``key, place, path, kind, shared``: documents that name a changed file and share ``least`` telling tokens with what left it.

    Most shared first, ``cap`` a document, then a row with null path and how many more.
    Only pairs of a document and a file that it names are made; their tokens are compared after that.
    """
    gone = changed_tokens(lines.where(F.col("path").rlike(CODE_FILE))).where(~F.col("token").isin(*GENERIC))
    gone = stored(gone, f"{work_folder(docs.sparkSession, 'gone')}/tokens")
    file = F.regexp_replace("path", r"^\./", "")
    stem = F.regexp_replace(F.regexp_extract(file, "[^/]*$", 0), r"\.[^.]+$", "")
    ticked = F.concat(F.lit("`"), stem, F.lit("`"))
    forms = gone.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("path", F.explode(F.array(file, ticked)).alias("pattern"))
    near = text_index.found_in(docs, [key], text, forms).join(forms, "pattern").select(key, "path").distinct()
    has = docs.join(near.select(key).distinct(), key, "left_semi").select(key, F.explode(t.tokens(F.col(text))).alias("token"))
    met = has.join(near, key).join(gone, ["path", "token"])
    pairs = met.groupBy(key, "path").agg(F.count(F.lit(1)).alias("shared"), F.min("first_seq").alias("seq")).where(F.col("shared") >= least)
    # the first line that names the file decides; within a line the path does
    line_of = lambda what: F.when(F.contains(F.col(text), what), F.length(F.regexp_replace(F.split_part(F.col(text), what, F.lit(1)), "[^\n]", "")))
    by_path, by_stem = line_of(file), line_of(ticked)
    kind = F.when(by_path.isNotNull() & (by_stem.isNull() | (by_path <= by_stem)), "path").when(by_stem.isNotNull(), "module")
    named = pairs.join(docs.select(key, text), key).select(key, "path", "shared", "seq", kind.alias("kind")).where("kind IS NOT NULL")
    ranked = named.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("shared"), "seq", "path")).cast("long"))
    more = named.groupBy(key).agg((F.count(F.lit(1)) - cap).alias("shared")).where("shared > 0")
    first = ranked.where(F.col("place") <= cap).select(key, "place", "path", "kind", "shared")
    return first.unionByName(more.select(key, F.lit(cap + 1).cast("long").alias("place"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("kind"), "shared"))
