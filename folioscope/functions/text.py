"""Column expressions over text: lines, prose, sentences, words, tokens, slugs.

Everything stays in built-in functions. Character classes are spelled out in
ASCII so that they mean the same to every regex engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\r\n\f\x0B]"
#: Words that carry no topic, among prose and code words.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "else", "for", "of", "to", "in", "on", "at", "by", "as", "is", "are", "was", "were", "be",
    "been", "this", "that", "these", "those", "it", "its", "with", "from", "not", "no", "we", "you", "return", "returns", "const", "let", "var",
    "function", "class", "import", "export", "default", "new", "true", "false", "null", "void", "public", "private",
)
#: Terms the audience knows, two syllables each.
TECH_VOCABULARY = (
    "dynamodb", "redis", "postgres", "postgresql", "mongodb", "mysql", "sqlite", "kubernetes", "docker", "dockerfile", "nginx", "apache",
    "cloudfront", "cloudwatch", "elasticsearch", "opensearch", "terraform", "ansible", "memcached", "cassandra", "rabbitmq", "kafka", "typescript",
    "javascript", "python", "fastify", "express", "nextjs", "webpack", "vite", "vitest", "playwright", "cypress", "mocha", "nestjs", "angular",
    "svelte", "nuxtjs", "gatsby", "remix", "websocket", "websockets", "middleware", "microservice", "microservices", "graphql", "restful", "oauth",
    "openapi", "webhook", "webhooks", "grpc", "protobuf", "pubsub", "lambda", "cognito", "amplify", "apprunner", "cloudformation", "apigateway",
    "secretsmanager", "parameterstore", "eventbridge", "fargate", "elasticache", "sagemaker", "namespace", "endpoint", "endpoints", "timestamp",
    "timestamps", "boolean", "callback", "callbacks", "codebase", "monorepo", "frontend", "backend", "fullstack", "changelog", "localhost",
    "hostname", "username", "eslint", "prettier", "rollup", "authentication", "authorization", "infrastructure", "serialization", "deserialization",
    "polymorphism", "abstraction",
)
#: Syllables of words that the rules get wrong.
SYLLABLES = {"the": 1, "are": 1, "were": 1, "have": 1, "there": 1, "where": 1, "here": 1, "every": 3, "everything": 4, "create": 2, "file": 1, "style": 1, "quite": 1}
#: Abbreviations whose point ends no sentence, pronouns without a name, and the patterns of passive, compound, negated and conditional clauses.
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|approx|incl"
PRONOUNS = (
    "it", "this", "that", "they", "them", "these", "those", "its", "their", "theirs",
)
PASSIVE = r"(is|was|were|been|being|are|be|am)\s+([\w]+\s+)?([\w]*(?:ed|en|wn|lt|nt|pt|ft|zed))"
COMPOUND = r"(and also|and then|as well as|in addition to|additionally|furthermore|moreover)"
NEGATION = r"(not|no|never|none|neither|nor|cannot|can't|don't|doesn't|didn't|won't|wouldn't|shouldn't|isn't|aren't|wasn't|weren't|hasn't|haven't|hadn't)"
CONDITIONAL = r"(if|unless|when|whenever|otherwise|except|provided that|assuming|in case|as long as|only if|until)"


def bounded(pattern: str) -> str:
    """A pattern between ASCII word boundaries, whatever the engine takes ``\\b`` for."""
    return rf"(?i)(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\r\n\f\x0B"))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def outside_fences(text: Column) -> Column:
    """Trimmed lines that are in no fenced block and no comment of several lines."""
    plain = F.transform(lines(text), trimmed)
    empty = F.expr("CAST(array() AS array<string>)")

    def step(acc: Column, x: Column) -> Column:
        fence = x.rlike("^`{3,}")
        opens = x.contains("<!--") & ~x.contains("-->")
        code = F.when(fence & ~acc["comment"] | fence & acc["code"], ~acc["code"]).otherwise(acc["code"])
        comment = F.when(acc["code"] | fence, acc["comment"]).when(acc["comment"], ~x.contains("-->")).otherwise(opens)
        keep = ~fence & ~acc["code"] & ~acc["comment"] & ~opens
        return F.struct(code.alias("code"), comment.alias("comment"), F.when(keep, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(False).alias("code"), F.lit(False).alias("comment"), empty.alias("out"))
    folded = F.aggregate(plain, start, step, lambda acc: acc["out"])
    stateful = F.coalesce(text, F.lit("")).rlike("```|<!--")
    return F.when(stateful, folded).otherwise(plain)


def prose(text: Column) -> Column:
    """The prose lines of a document, cleaned of markup, joined by line feeds."""

    def is_prose(x: Column) -> Column:
        return ~x.rlike(r"^(\||#|!|[-*_]{3,}[ \t]*$|[|:\- \t]+$|<!--.*-->$|<[^>]+>|$)")

    def cleaned(x: Column) -> Column:
        for pattern, by in (
            (r"\[([^\]]*)\]\([^)]*\)", "$1"),
            (r"`[^`]+`", ""),
            (r"!\[.*?\]\(.*?\)", ""),
            (r"\*{1,3}([^*]+)\*{1,3}", "$1"),
            (r"_{1,3}([^_]+)_{1,3}", "$1"),
            (r"^[-*+][ \t]+", ""),
            (r"^[0-9]+\.[ \t]+", ""),
        ):
            x = F.regexp_replace(x, pattern, by)
        return trimmed(x)

    def wordy(x: Column) -> Column:
        letters = F.length(F.regexp_replace(x, "[^a-zA-Z]", ""))
        return (F.length(x) >= 15) & (letters / F.length(x) >= 0.55) & (F.size(F.split(x, rf"{SPACE}+", -1)) >= 5)

    kept = F.filter(outside_fences(text), is_prose)
    return F.array_join(F.filter(F.transform(kept, cleaned), wordy), "\n")


def sentences(text: Column) -> Column:
    """Sentences of ten characters and three words at least.

    Only points before white space end a sentence, so the points to protect are
    those of abbreviations and at the end of addresses.
    """
    x = F.regexp_replace(text, rf"(?i)(?<![A-Za-z0-9_])({ABBREVIATIONS})\.", "$1≈")
    x = F.regexp_replace(x, r"(?i)(?<![A-Za-z0-9_])e\.g\.", "e≈g≈")
    x = F.regexp_replace(x, r"(?i)(?<![A-Za-z0-9_])i\.e\.", "i≈e≈")
    x = F.regexp_replace(x, r"(https?://[^ \t\r\n\f)]*)\.(?=[ \t\r\n\f]|$)", "$1≈")
    parts = F.transform(F.split(x, rf"[.!?]+(?:{SPACE}+|$)", -1), lambda s: trimmed(F.regexp_replace(s, "≈", ".")))
    return F.filter(parts, lambda s: (F.length(s) >= 10) & (F.size(F.split(s, rf"{SPACE}+", -1)) >= 3))


def words(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(text), r"[^a-z0-9 \t\r\n\f'-]", " ")
    return F.filter(F.split(flat, rf"{SPACE}+", -1), lambda w: w != "")


def syllables(word: Column) -> Column:
    """Syllables of a word as ``words`` gives it (no regular expression but one per word)."""
    w = F.translate(word, "0123456789'-", "")
    groups = F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")))
    silent = w.endswith("e") & ~(w.endswith("le") | w.endswith("ce") | w.endswith("ge"))
    past = w.endswith("ed") & ~(w.endswith("ted") | w.endswith("ded"))
    out = F.when(F.length(w) <= 2, 1).when(w.isin(*TECH_VOCABULARY), 2)
    for n in sorted(set(SYLLABLES.values())):
        out = out.when(w.isin([k for k, v in SYLLABLES.items() if v == n]), n)
    return out.otherwise(F.greatest(F.lit(1), groups - silent.cast("int") - past.cast("int")))


def identifier_words(x: Column) -> Column:
    """The lower-case words of an identifier in any of the usual cases."""
    x = F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")
    x = F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    x = F.lower(F.regexp_replace(x, r"[_\-.]+", " "))
    return F.filter(F.split(x, " +", -1), lambda w: w != "")


def tokens(text: Column, least: int = 3) -> Column:
    """Identifiers and their words, lower case, without short and stop words, each once in order of first sight."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_.-]*"), F.lit(0))
    each = F.flatten(F.transform(F.array_distinct(found), lambda w: F.concat(F.array(F.lower(w)), identifier_words(w))))
    return F.array_distinct(F.filter(each, lambda t: (F.length(t) >= least) & ~t.isin(*STOP_WORDS)))


def slug(heading: Column) -> Column:
    """The anchor of a heading: dashes for white space first, other characters dropped after."""
    x = F.lower(F.regexp_replace(heading, rf"^#+{SPACE}+", ""))
    x = F.regexp_replace(x, "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}]", "")
    x = F.regexp_replace(x, r"[.,;:!?'\"`()\[\]{}<>|\\/]", "")
    return F.regexp_replace(F.regexp_replace(x, rf"{SPACE}+", "-"), "[^a-z0-9-]", "")


def rule_norm(text: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(text), "['’]", ""), "[^a-z0-9 \\t\\r\\n\\f]", " ")
    return trimmed(F.regexp_replace(x, rf"{SPACE}+", " "))


def fingerprint(code: Column, location: Column, message: Column) -> Column:
    """What stays of a finding when lines and numbers move."""
    path = F.regexp_replace(location, r":[0-9]+$", "")
    calm = F.regexp_replace(F.regexp_replace(message, "[0-9]+", "#"), rf"{SPACE}+", " ")
    return F.substring(F.sha2(F.concat_ws("|", code, path, calm), 256), 1, 16)


def rounded(x: Column, places: int = 1) -> Column:
    """Half up, ties included."""
    return F.floor(x * 10**places + 0.5) / 10**places
