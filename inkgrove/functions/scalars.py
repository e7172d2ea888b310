"""Scalar text, time and vector expressions; all built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the retrieval model: trust weights of rings 0 to 4, recency amplitude and half life in days.
RING_WEIGHTS = (1.15, 1.10, 1.00, 0.92, 0.80)
RECENCY_AMPLITUDE, HALF_LIFE_DAYS = 0.015, 90.0
DEDUP_MIN_CHARS = 80
SOON_DAYS = 7
MAX_NAME = 120

# Letters that slugs spell without their accents, and those that the index folds.
_ACCENTED = "àáâãåèéêëìíîïòóôõøùúûçñÀÁÂÃÅÈÉÊËÌÍÎÏÒÓÔÕØÙÚÛÇÑ"
_PLAIN = "aaaaaeeeeiiiiooooouuucn" * 2
STRIPPED_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
STRIPPED_TO = "aaaaaaceeeeiiiinooooouuuuyy"


def approx_tokens(text: Column) -> Column:
    """Quarter-length of every run of ASCII letters and digits, rounded up, plus one for each other visible character."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda r: F.ceil(F.length(r) / 4))
    other = F.length(F.regexp_replace(text, r"(?U)[A-Za-z0-9]|\s", ""))
    return (F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, r: a + r) + other).cast("bigint")


def fold(text: Column) -> Column:
    """Lower case without diacritics, as the full-text index sees it."""
    return F.translate(F.lower(text), STRIPPED_FROM, STRIPPED_TO)


def tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def collapsed(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\s+", " "))


def dedup_key(text: Column) -> Column:
    """SHA-256 of the lower-cased text with white space collapsed; null under DEDUP_MIN_CHARS characters."""
    c = collapsed(text)
    return F.when(F.length(c) >= DEDUP_MIN_CHARS, F.sha2(c, 256))


def citation(ring: Column, note_id: Column, idx: Column, text: Column) -> Column:
    """r{ring}- and 12 hex digits of a hash of note, position and text."""
    return F.concat(F.lit("r"), ring, F.lit("-"), F.substring(F.sha2(F.concat_ws(":", note_id, idx, text), 256), 1, 12))


def citation_ring(cited: Column) -> Column:
    """The ring of a well-formed citation, else null."""
    return F.when(cited.rlike("^r[0-4]-[0-9a-f]{12}$"), F.substring(cited, 2, 1).cast("int"))


def mentions(text: Column) -> Column:
    """Different citations in the text, word-bounded, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\br[0-4]-[0-9a-f]{12}\b"), F.lit(0)))


def mentions_newest(text: Column) -> Column:
    """The same, the last named first."""
    return F.array_distinct(F.reverse(F.regexp_extract_all(text, F.lit(r"\br[0-4]-[0-9a-f]{12}\b"), F.lit(0))))


def preview(text: Column) -> Column:
    """First line without leading #, 80 characters."""
    return F.substring(F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), "^#+", "")), 1, 80)


def slugify(text: Column) -> Column:
    """ASCII slug: umlauts spelt out, accents dropped, everything else one hyphen; cut at a hyphen over MAX_NAME."""
    s = text
    for chars, put in (("[äÄ]", "ae"), ("[öÖ]", "oe"), ("[üÜ]", "ue"), ("ß", "ss")):
        s = F.regexp_replace(s, chars, put)
    s = F.translate(s, _ACCENTED, _PLAIN)
    s = F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    s = F.btrim(F.regexp_replace(s, "[^a-z0-9]+", "-"), F.lit("-"))
    head = F.substring(s, 1, MAX_NAME)
    cut = F.when(F.instr(head, "-") > 0, F.regexp_replace(head, "-[^-]*$", "")).otherwise(head)
    return F.when(F.length(s) <= MAX_NAME, s).otherwise(cut)


def name_problem(name: Column) -> Column:
    """Why a string is no note name (null if it is one)."""
    letters = r"^[a-z0-9\-\u00DF-\u00F6\u00F8-\u00FF\u0100-\u024F\u1E00-\u1EFF]*\z"  # $ would let a last line end pass
    return (
        F.when(name.isNull() | (name == ""), "empty")
        .when(F.length(name) > MAX_NAME, "long")
        .when(F.octet_length(name) > 2 * MAX_NAME, "bytes")
        .when(name.startswith("-") | name.endswith("-"), "edge-hyphen")
        .when(name.contains("--"), "double-hyphen")
        .when(~name.rlike(letters) | (F.lower(name) != name), "characters")
    )


def scope_problem(scope: Column) -> Column:
    """Why a string is no department label (null if it is one)."""
    return (
        F.when(scope == "", "empty").when(F.length(scope) > 64, "long").when(scope.rlike(r"(?U)\s"), "space").when(scope.rlike(r"[/\\]"), "separator").when(scope.rlike(r"\p{Cntrl}"), "control")
    )


def untrusted_source(tags: Column) -> Column:
    """First src: tag of rows tagged trust:untrusted, "unspecified" without one, null for trusted rows."""
    first = F.try_element_at(F.filter(tags, lambda t: t.startswith("src:")), F.lit(1))
    return F.when(F.array_contains(tags, "trust:untrusted"), F.coalesce(F.substring(first, 5, 1 << 30), F.lit("unspecified")))


def tag_problem(tags: Column) -> Column:
    """Why tags on trust and source contradict themselves or are empty (null if they do not)."""
    trust = F.filter(tags, lambda t: t.startswith("trust:"))
    empty = F.exists(tags, lambda t: t.startswith("src:") & (F.btrim(F.substring(t, 5, 1 << 30), F.lit(":")) == ""))
    return F.when(F.exists(trust, lambda t: ~t.isin("trust:trusted", "trust:untrusted")), "unknown-trust").when(F.size(F.array_distinct(trust)) > 1, "both-trusts").when(empty, "no-source")


def stamp_untrusted(tags: Column, client: Column) -> Column:
    """tags marked as from outside: trust:untrusted in place of any other trust, and a source, the client, where none is named."""
    kept = F.filter(tags, lambda t: ~t.startswith("trust:"))
    named = F.exists(kept, lambda t: t.startswith("src:"))
    source = F.when(named, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("src:"), client)))
    return F.concat(kept, F.array(F.lit("trust:untrusted")), source)


def short_hash(text: Column) -> Column:
    """Eight hex digits of a hash of the text, to tell names apart; equal texts have the same."""
    return F.substring(F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0")), 1, 8)


def located_part(locator: Column, text: Column) -> Column:
    """A part of a body under a line that names its place; without a line where the place is empty, over lines, or would end the comment."""
    place = F.btrim(locator)
    usable = place.isNotNull() & (place != "") & ~place.rlike("[\\r\\n]") & ~F.contains(place, F.lit("-->"))
    return F.when(usable, F.concat(F.lit("<!-- at: "), place, F.lit(" -->\n"), text)).otherwise(text)


def moment(text: Column) -> Column:
    """RFC 3339 or a bare date (midnight UTC); null if neither."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d))?$"), F.try_to_timestamp(text))


_DURATION = r"^P(?=.)(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"


def duration_parts(text: Column) -> list[Column]:
    return [F.coalesce(F.regexp_extract(text, _DURATION, k).try_cast("int"), F.lit(0)) for k in range(1, 8)]


def duration_ok(text: Column) -> Column:
    """A positive ISO 8601 duration in calendar and clock units."""
    total = duration_parts(text)
    return text.rlike(_DURATION) & (F.greatest(*total) > 0)


def expires_at(created: Column, duration: Column) -> Column:
    """created plus a duration, by the UTC calendar; null for an invalid duration."""
    years, months, weeks, days, hours, minutes, seconds = duration_parts(duration)
    span = F.make_interval(years, months, weeks, days, hours, minutes, seconds)
    return F.when(duration_ok(duration), created + span)


def recency_weight(updated: Column, now: Column) -> Column:
    """1 - A + 2A * 0.5^(age / half life): a slight preference for the recent; the future counts as now."""
    days = F.greatest((F.unix_timestamp(now) - F.unix_timestamp(updated)) / 86400.0, F.lit(0.0))
    return 1 - RECENCY_AMPLITUDE + 2 * RECENCY_AMPLITUDE * F.pow(F.lit(0.5), days / HALF_LIFE_DAYS)


def ring_weight(ring: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RING_WEIGHTS)), ring.cast("int") + 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def shannon_bits(text: Column) -> Column:
    """Entropy of the characters, bits per character; one pass over the text for each different character."""
    n = F.length(text).cast("double")
    each = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    share = F.transform(each, lambda c: F.try_divide(n - F.length(F.replace(text, c, F.lit(""))), n))
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def mod97(text: Column) -> Column:
    """ISO 7064 mod 97 of letters and digits, letters as 10 to 35."""
    chars = F.filter(F.split(F.upper(text), ""), lambda c: c.rlike("[0-9A-Z]"))
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: (F.when(value(c) > 9, a * 100).otherwise(a * 10) + value(c)) % 97)


def iban_ok(text: Column) -> Column:
    bare = F.upper(F.regexp_replace(text, " ", ""))
    return bare.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}$") & (mod97(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))) == 1)


def mod11_10(digits: Column) -> Column:
    """ISO 7064 mod 11,10 check of a digit string including its check digit."""
    step = lambda p, d: F.when((p + d) % 10 == 0, F.lit(10)).otherwise((p + d) % 10) * 2 % 11
    body = F.transform(F.filter(F.split(F.substring(digits, F.lit(1), F.length(digits) - 1), ""), lambda c: c != ""), lambda c: c.try_cast("int"))
    return (11 - F.aggregate(body, F.lit(10), step)) % 10 == F.right(digits, F.lit(1)).try_cast("int")


def older_version(a: Column, b: Column) -> Column:
    """Dotted numeric comparison a < b; anything unreadable is not older."""
    parts = lambda v: F.transform(F.split(v, r"\."), lambda p: F.regexp_extract(p, "^([^-+]*)", 1).try_cast("int"))
    x, y = parts(a), parts(b)
    bad = F.exists(F.concat(x, y), lambda p: p.isNull())
    return F.coalesce(~bad & (x < y), F.lit(False))


def glob_regex(pattern: str) -> str:
    """* within a path part, ? one character of it, ** over parts; a leading / anchors, else any parent folder may stand before."""
    anchored, body, out, i = pattern.startswith("/"), pattern.lstrip("/"), "", 0
    while i < len(body):
        if body[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif body[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "/_" else c), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$"


def canary_form(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def excerpt(text: Column, needle: Column, reach: int = 60) -> Column:
    """reach characters either side of the first occurrence, any case; null if absent."""
    at = F.position(F.lower(needle), F.lower(text))
    start = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(needle) + reach))


def occurrences(text: Column, needle: str) -> Column:
    """How often the needle stands in the text, any case, without overlap."""
    import re

    return F.regexp_count(text, F.lit("(?iu)" + re.escape(needle)))


def occurrence_spans(text: Column, needle: str) -> Column:
    """array of (start, end, whole) of the occurrences, any case, without overlap; characters from 0, end exclusive; whole if no letter or digit stands beside it. A null text has none."""
    import re

    pattern = F.lit("(?iu)" + re.escape(needle))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    upto = lambda parts, k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x))
    start = lambda k: upto(gaps, k) + upto(found, k - 1)
    beside = lambda at: F.substring(text, at, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    ends = F.transform(F.when(F.size(found) > 0, F.sequence(F.lit(1), F.size(found))).otherwise(F.array().cast("array<int>")), lambda k: F.struct(start(k).alias("start"), (start(k) + F.length(F.element_at(found, k))).alias("end")))
    return F.transform(ends, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (~((s["start"] > 0) & beside(s["start"])) & ~beside(s["end"] + 1)).alias("whole")))


def whole_word(text: Column, needle: str) -> Column:
    import re

    return text.rlike(r"(?iu)(?<![\p{L}\p{N}])" + re.escape(needle) + r"(?![\p{L}\p{N}])")


def age_words(seconds: Column) -> Column:
    """A rough age in words."""
    return F.when(seconds < 3600, F.concat(F.floor(seconds / 60), F.lit(" min"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600), F.lit(" h"))).otherwise(F.concat(F.floor(seconds / 86400), F.lit(" d")))


def open_points(text: Column) -> Column:
    """Lines that read as unfinished: an unticked box, or todo / pending / open / next at their start."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"(?i)^\s*(?:[-*]\s*)?(?:\[ \]|(?:todo|pending|open|next)\b)"))


def clean_turn(text: Column) -> Column:
    """A transcript turn without system reminders, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?s)<system-reminder>.*?</system-reminder>", ""))


def window_state(approved: Column, expires: Column, now: Column) -> Column:
    """pending until approved; open until a readable expiry; else closed."""
    until = moment(expires)
    return F.when(approved.isNull(), "pending").when(until.isNotNull() & (now <= until), "open").otherwise("closed")


def token_state(expires: Column, now: Column) -> Column:
    """open without an expiry; expired at it or if unreadable; soon within SOON_DAYS; else valid."""
    until = moment(expires)
    left = F.unix_timestamp(until) - F.unix_timestamp(now)
    return F.when(expires.isNull() | (expires == ""), "open").when(until.isNull() | (until <= now), "expired").when(left <= SOON_DAYS * 86400, "soon").otherwise("valid")


def chain_hash(prev: Column, *fields: Column) -> Column:
    """Length-prefixed fields after the previous hash, hashed."""
    parts = [F.concat(F.octet_length(c), F.lit(":"), c) for c in (F.coalesce(f.cast("string"), F.lit("")) for f in fields)]
    return F.sha2(F.concat(F.coalesce(prev, F.lit("")), F.lit("|"), *parts), 256)


def query_hash(query: Column, key: str) -> Column:
    """Keyed hash of a normalised query, so a search log need not hold the query."""
    return F.sha2(F.concat(F.lit(key), F.lit("|"), collapsed(query)), 256)


def name_from(template: str, **parts: Column) -> Column:
    """A note name from a template with {stem} {dir} {heading} {index} {hash}."""
    out = F.lit(template)
    for k, v in parts.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return slugify(out)
