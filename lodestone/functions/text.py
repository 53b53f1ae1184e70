"""Scalar text functions as Column expressions.

Sizes are bytes or characters as each function says; white space and case mean
ASCII throughout, so results do not depend on a locale or a Unicode version.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f\x0B]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ELLIPSIS = "…"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    """The text, empty where null."""
    return F.coalesce(col(c), F.lit(""))


def ascii_lower(c: Column | str) -> Column:
    """A-Z to a-z; other letters keep their case."""
    return F.translate(col(c), UPPER, LOWER)


def trim_ws(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+$", "")


def collapse_ws(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"{WS}+", " "))


def blank(c: Column | str) -> Column:
    return ~text_of(c).rlike(r"[^ \t\n\r\f\x0B]")


def word_count(c: Column | str) -> Column:
    t = trim_ws(text_of(c))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"{WS}+")))


def clip_bytes(c: Column | str, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes."""
    head = F.substring(F.encode(col(c), "UTF-8"), 1, most).cast("string")
    return F.regexp_replace(F.make_valid_utf8(head), "�+$", "")


def squeeze(c: Column | str, most: int) -> Column:
    """White space collapsed; cut to ``most`` bytes with an ellipsis if longer."""
    flat = collapse_ws(text_of(c))
    return F.when(F.octet_length(flat) <= most, flat).otherwise(F.concat(clip_bytes(flat, most), F.lit(ELLIPSIS)))


def pad(c: Column | str, width: int) -> Column:
    """Spaces on the right up to ``width`` characters; longer text stays."""
    c = text_of(c)
    return F.when(F.char_length(c) < width, F.rpad(c, width, " ")).otherwise(c)


def stable_key(session: Column | str, ts: Column | str, role: Column | str, text: Column | str) -> Column:
    """A row's identity across re-ingestion: session, time, role and the first 64 characters."""
    return F.concat(text_of(session), F.lit("|"), text_of(ts), F.lit("|"), text_of(role), F.lit("|"), F.substring(text_of(text), 1, 64))


def date_of(ts: Column | str, unknown: str = "no-date") -> Column:
    return F.when(F.length(text_of(ts)) >= 10, F.substring(text_of(ts), 1, 10)).otherwise(F.lit(unknown))


def iso_minute(seconds: Column | str) -> Column:
    """Seconds since 1970 as ``yyyy-MM-dd HH:mm`` (UTC session)."""
    return F.date_format(F.timestamp_seconds(col(seconds)), "yyyy-MM-dd HH:mm")


def iso_date(seconds: Column | str) -> Column:
    return F.substring(iso_minute(seconds), 1, 10)


def basename(c: Column | str) -> Column:
    return F.substring_index(col(c), "/", -1)


def head_of_command(c: Column | str, most: int = 48) -> Column:
    """First piece of a command (pieces end at a line feed or semicolon) that is not empty or a comment."""
    pieces = F.transform(F.split(text_of(c), "[\n;]"), lambda x: F.regexp_replace(x, f"^{WS}+", ""))
    real = F.filter(pieces, lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return squeeze(F.coalesce(F.get(real, F.lit(0)), F.lit("")), most)


def flatten_path(c: Column | str) -> Column:
    return F.translate(col(c), "/.", "--")


def project_label(dirname: Column | str, home: str) -> Column:
    """Label of a flattened directory name: below ``home`` its rest, else the name without leading dashes."""
    d, flat = col(dirname), home.replace("/", "-").replace(".", "-")
    rest = F.regexp_replace(d, "^-+", "")
    label = F.when(d == flat, F.lit("home")).when(F.startswith(d, F.lit(flat + "-")) & (F.length(d) > len(flat) + 1), F.substring(d, len(flat) + 2, 1 << 20)).otherwise(rest)
    return F.when(label == "", F.lit("misc")).otherwise(label)


def essence(c: Column | str) -> Column:
    """Of a note with front matter its ``description:`` value, else the text."""
    t = text_of(c)
    value = F.regexp_extract(t, r'(?s)^---.*?description:[ \t"]*([^\n]*)', 1)
    has = t.rlike(r'(?s)^---.*?description:[ \t"]*[^ \t"]')
    return F.when(has, F.regexp_replace(value, r'[" ]+$', "")).otherwise(t)


def wikilinks(c: Column | str) -> Column:
    """Targets of ``[[links]]``: trimmed, lower case, 1 to 99 bytes, in order."""
    found = F.regexp_extract_all(text_of(c), F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))
    names = F.transform(found, lambda x: ascii_lower(F.regexp_replace(x, r"^[ \t\r\n]+|[ \t\r\n]+$", "")))
    return F.filter(names, lambda x: (F.octet_length(x) > 0) & (F.octet_length(x) < 100))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def split_lines(c: Column | str) -> Column:
    """Lines without the empty piece after a last line feed; an empty text has none."""
    parts = F.split(text_of(c), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def indented(c: Column | str) -> Column:
    return col(c).rlike(r"^[ \t]")


def plain_name(c: Column | str) -> Column:
    """Safe as one path component."""
    c = text_of(c)
    return (c != "") & ~F.contains(c, F.lit("/")) & ~F.contains(c, F.lit(".."))


def fib_sphere(i: Column, n: Column) -> tuple[Column, Column, Column]:
    """The i-th of n points of a golden-angle lattice on the unit sphere."""
    nf = F.greatest(n.cast("double"), F.lit(1.0))
    y = F.lit(1.0) - F.lit(2.0) * (i.cast("double") + F.lit(0.5)) / nf
    r = F.sqrt(F.greatest(F.lit(1.0) - y * y, F.lit(0.0)))
    phi = i.cast("double") * F.lit(2.399963229728653)
    return r * F.cos(phi), y, r * F.sin(phi)


#: Fixed values of the layout jitter: multiplier and increment modulo 2**64.
JITTER_MUL, JITTER_ADD = 6364136223846793005, 1442695040888963407


def jitter(seed: Column) -> Column:
    """Deterministic offset of a non-negative seed: the top 31 bits of a 64-bit
    congruential step over 2**32 - 1, times 2, minus 1.

    The step is done in halves of the multiplier so that decimals hold it exactly.
    """
    d = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    s = seed.cast("decimal(19,0)")
    two64 = d(1 << 64)
    hi, lo = JITTER_MUL >> 32, JITTER_MUL & 0xFFFFFFFF
    high = F.pmod((s * F.lit(str(hi)).cast("decimal(10,0)")).cast("decimal(38,0)"), d(1 << 32)).cast("decimal(10,0)") * F.lit(str(1 << 32)).cast("decimal(10,0)")
    low = s * F.lit(str(lo)).cast("decimal(10,0)")
    x = F.pmod(high.cast("decimal(38,0)") + low.cast("decimal(38,0)") + d(JITTER_ADD), two64)
    return F.floor(x.cast("decimal(38,0)") / d(1 << 33)).cast("double") / F.lit(4294967295.0) * F.lit(2.0) - F.lit(1.0)
