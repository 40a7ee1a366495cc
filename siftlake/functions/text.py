"""Text functions: masking, paths, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is white space at the ends of a line; keys, and values behind secret names; what stands in their place.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SECRET = r"""(?i)(sk-[A-Za-z0-9_\-]{8,})|((?:password|passwd|secret|token|api_?key|apikey)\s*[:=]\s*["']?)([A-Za-z0-9_\-+/=]{6,})"""
HIDDEN = "[已掩码]"
#: A match in marks, by the place of its parts, and what each kind of match becomes.
MARKED = (SECRET, "\x01$1\x02$2\x03$3\x04")
SHOWN = ((r"\x01([^\x02]{6})[^\x02]*\x02\x03\x04", f"$1…{HIDDEN}"), (r"\x01\x02([^\x03]*)\x03[^\x04]*\x04", f"$1***{HIDDEN}"))


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends; trim() takes spaces only."""
    return F.trim(col, F.lit(WHITE))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(WHITE))


def mask_secrets(col: Column) -> Column:
    """``sk-`` keys to their first six characters, values of secret names to stars: one reading from the left, so that a
    key behind a secret name is that name's value."""
    out = F.regexp_replace(col, "(?U)" + MARKED[0], MARKED[1])
    for pattern, to in SHOWN:
        out = F.regexp_replace(out, pattern, to)
    return out


def base_name(col: Column) -> Column:
    return F.element_at(F.split(col, r"[/\\]"), -1)


def suffix(col: Column) -> Column:
    return F.regexp_extract(base_name(col), r"(\.[^.]+)$", 1)


def stem(col: Column) -> Column:
    return F.regexp_replace(base_name(col), r"\.[^.]+$", "")


def short_hash(col: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(col), 1, n)


def prompt_key(model: Column, prompt: Column) -> Column:
    return F.substring(F.sha2(F.concat(model, F.lit("\0"), prompt), 256), 1, 32)


def masked_setting(col: Column) -> Column:
    """A secret setting as its first six and last four characters; short ones as stars."""
    return F.when(F.length(col) > 12, F.concat(F.substring(col, 1, 6), F.lit("..."), F.substring(col, -4, 4))).when(F.length(col) > 0, "***").otherwise("")


def knowledge_text(title: Column, pattern: Column, tags: Column, triggers: Column) -> Column:
    """What of an item is embedded, cut to 1500 characters; fields that are missing are empty."""
    given = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.concat_ws(" ", given(title), given(pattern), given(F.array_join(tags, " ")), given(F.array_join(triggers, " "))), 1, 1500)


def valid_id(col: Column) -> Column:
    """2 to 64 letters, digits, dots, dashes and underscores, the first a letter or digit."""
    return F.rlike(col, F.lit(r"^[A-Za-z0-9][A-Za-z0-9_.\-]{1,63}$"))


def stamp(col: Column) -> Column:
    """A time as ISO text to the second, as records keep it."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")


def epoch(col: Column) -> Column:
    """Seconds since 1970 of an ISO text, null where it is none."""
    return F.unix_timestamp(F.try_to_timestamp(col))


def checksum(col: Column) -> Column:
    """The first 32 hexadecimal digits of the sha256."""
    return F.substring(F.sha2(col, 256), 1, 32)
