"""Column builders over text: harness noise, identities, literals, fingerprints, remotes, moments, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space around an entry, the openings of entries a harness writes for itself, and the whole
#: entries that are such (a bare slash command; image references only).
SPACE = " \t\n\r\f\x0b"
NOISE_OPENINGS = (
    "<",
    "[Request interrupted",
    "Base directory for this skill",
    "This session is being continued from a previous conversation",
    "Stop hook feedback:",
    "A session-scoped Stop hook is now active",
    "Goal check-in:",
    "Another Claude session sent a message:",
    "Continue from where you left off.",
    "(Re-invocation of /",
)
NOISE_WHOLE = r"(?U)\A[ \t\n\r\f\x0B]*(/[\w:.-]+|(\[Image[^\]]*\][ \t\n\r\f\x0B]*)+)[ \t\n\r\f\x0B]*\z"


def noise(body: Column) -> Column:
    """Whether a harness wrote the entry for itself; null for a null body, so that it is excluded either way."""
    start = F.ltrim(body, F.lit(SPACE))
    opens = F.lit(False)
    for opening in NOISE_OPENINGS:
        opens = opens | start.startswith(opening)
    return opens | body.rlike(NOISE_WHOLE)


def not_noise(body: Column) -> Column:
    return ~noise(body)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def short_prompt(text: Column, words: int = 12) -> Column:
    return word_count(text) <= words


def clean_nul(text: Column) -> Column:
    """U+0000 becomes U+FFFD."""
    return F.translate(text, "\x00", "�")


def lenient(text: Column, kind: str) -> Column:
    """The text as a number, null if it is none."""
    return text.try_cast(kind)


def nanos_time(text: Column) -> Column:
    """Nanoseconds since 1970 as a timestamp, truncated to microseconds; null if it is no number."""
    return F.call_function("timestamp_micros", F.call_function("div", text.try_cast("bigint"), F.lit(1000).cast("bigint")))


def identity(entry: Column, kind: Column, within: Column | None = None) -> Column:
    """entry:kind:within without the empty parts; null if all are empty."""
    parts = [F.nullif(p, F.lit("")) for p in (entry, kind, *([] if within is None else [within]))]
    return F.nullif(F.concat_ws(":", *parts), F.lit(""))


def session_in_path(path: Column) -> Column:
    """The session id in a session file's path: the last part of its name after an underscore."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl\z", "")
    return F.when(F.length(path) > 0, F.element_at(F.split(name, "_"), -1))


def fingerprint(of: Column) -> Column:
    """16 hex digits that name a map, whatever the order of its keys."""
    return F.left(F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(of)))), 256), F.lit(16))


def remote_parts(url: Column) -> Column:
    """struct(owner, name) of a repository's remote, as an address or as user@host:path.

    The last two non-empty parts of its path; the owner is empty where there is one part only.
    """
    path = F.when(url.contains("://"), F.regexp_extract(url, r"\A.*?://(.*)\z", 1)).when(url.contains("@") & url.contains(":"), F.regexp_extract(url, r"\A[^:]*:(.*)\z", 1)).otherwise(url)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    name = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\.git\z", "")
    return F.struct(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).alias("owner"), F.coalesce(name, F.lit("")).alias("name"))


def looks_like_domain(name: Column) -> Column:
    """A dot, none at the start, and a last label of two letters or more."""
    return name.rlike(r"\A[^.].*\.[A-Za-z]{2,}\z")


#: The shapes of what a reader copies exactly. A slash between two words or numbers is prose.
URL = r"(?i)\b[a-z][a-z0-9+.-]*://\S+"
HASH = r"(?U)(?<![\w.-])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{7,40}(?![\w-])(?!\.\w)"
BACKTICKED = r"`([^`\n]+)`"
LONG_FLAG = r"(?U)(?<![\w-])--[A-Za-z0-9][\w-]*"
SHORT_FLAG = r"(?U)(?<![\w-])-[A-Za-z](?![\w-])"
PATH = r"(?U)(?<![\w/:.@+~-])[~.]{0,2}[\w.@+-]*(?:/[\w.@+-]*)+"
DOTTED = r"(?U)(?<![\w./-])[\w-]+(?:\.[\w-]+)*\.[A-Za-z][\w-]*"
ENVIRONMENT = r"(?U)\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"
SNAKE = r"(?U)\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
GLUED_VERSION = r"(?U)(?<![\w.])[A-Za-z]+(\d+(?:\.\d+)+)"
NUMBER = r"(?U)(?<![\w.])v?(\d{1,3}(?:,\d{3})+(?!\d)|\d+(?:\.\d+)*)"
TRAILING = r"[.,;:!?)\]}'\"/]+\z"
PROSE_PAIRS = ("and/or", "either/or", "yes/no", "on/off", "true/false", "read/write", "input/output", "pass/fail", "start/stop", "open/close", "he/she", "his/her")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _path_shaped(token: Column) -> Column:
    name = F.regexp_replace(token, TRAILING, "")
    parts = F.split(name, "/")
    rooted = name.rlike(r"\A(/|~/|\./|\.\./)")
    many = F.length(name) - F.length(F.replace(name, F.lit("/"), F.lit(""))) >= 2
    ends = F.regexp_replace(token, r"[.,;:!?)\]}'\"]+\z", "").endswith("/")
    capitals = F.forall(parts, lambda p: p.rlike(r"\A[A-Z0-9]+\z"))
    return (name != "") & (rooted | many | ends | ~(F.lower(name).isin(*PROSE_PAIRS) | capitals))


def literals(text: Column) -> Column:
    """The sorted set of literals a text names: addresses, hashes, flags, paths, dotted and code names, versions, numbers.

    Addresses and hashes are taken out before the other shapes are read; backticks are read in the whole text. Native
    expressions only, so it runs inside one code-generated stage.
    """
    tidy = lambda xs: F.transform(xs, lambda x: F.regexp_replace(x, TRAILING, ""))
    rest = F.regexp_replace(text, URL, " ")
    bare = F.regexp_replace(rest, HASH, " ")
    dotted = F.filter(_all(bare, DOTTED), lambda x: F.exists(F.split(x, r"\."), lambda p: F.length(p) > 1))
    sets = [
        tidy(_all(text, URL)),
        _all(rest, HASH),
        F.transform(_all(text, BACKTICKED, 1), lambda x: F.trim(x)),
        _all(bare, LONG_FLAG),
        _all(bare, SHORT_FLAG),
        tidy(F.filter(_all(bare, PATH), _path_shaped)),
        dotted,
        _all(bare, ENVIRONMENT),
        _all(bare, SNAKE),
        _all(bare, GLUED_VERSION, 1),
        F.transform(_all(bare, NUMBER, 1), lambda x: F.replace(x, F.lit(","), F.lit(""))),
    ]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*sets))))


def lacking(retired: Column, survivor: Column) -> Column:
    """The literals of the retired text that the surviving one does not hold."""
    return F.array_except(literals(retired), literals(survivor))


def json_items(reply: Column, schema: str) -> Column:
    """The JSON array inside a reply that has prose around it, as structs; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit("")), f"array<struct<{schema}>>")


def moments(said_at: Column, zone: str) -> Column:
    """struct(today, tomorrow_morning, tomorrow, monday) after an instant, in a person's zone, as instants.

    today is the coming midnight, tomorrow_morning nine on the next day, tomorrow the midnight after that, monday nine
    on the first Monday strictly after the local day.
    """
    day = F.to_date(F.from_utc_timestamp(said_at, zone))
    at = lambda d, hours: F.to_utc_timestamp(d.cast("timestamp") + F.expr(f"INTERVAL {hours} HOURS"), zone)
    return F.struct(at(F.date_add(day, 1), 0).alias("today"), at(F.date_add(day, 1), 9).alias("tomorrow_morning"), at(F.date_add(day, 2), 0).alias("tomorrow"), at(F.next_day(day, "MON"), 9).alias("monday"))


def age_words(said_at: Column, now: Column) -> Column:
    """How many whole days ago; today for none or the future, undated for null."""
    days = F.call_function("div", F.unix_micros(now) - F.unix_micros(said_at), F.lit(86_400_000_000).cast("bigint"))
    return F.when(said_at.isNull(), "undated").when(days <= 0, "today").when(days == 1, "1 day ago").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def block_line(kind: Column, scope: Column, actor: Column, depth: Column, said_at: Column, statement: Column, now: Column) -> Column:
    """One line of a handed block: - kind, where, who, age: statement."""
    where = F.coalesce(F.nullif(scope, F.lit("")), F.lit("everywhere"))
    level = F.coalesce(depth, F.lit(0))
    who = F.when((actor == "human") & (level == 0), "person").otherwise(F.concat(F.coalesce(F.nullif(actor, F.lit("")), F.lit("unknown")), F.lit(" at depth "), level.cast("string")))
    return F.concat(F.lit("- "), F.coalesce(kind, F.lit("")), F.lit(", "), where, F.lit(", "), who, F.lit(", "), age_words(said_at, now), F.lit(": "), F.coalesce(statement, F.lit("")))
