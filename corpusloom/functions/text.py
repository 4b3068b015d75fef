"""Text functions: columns where built-in expressions can say it, Arrow UDFs where they can't."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headings that open a boilerplate tail.
BOILERPLATE_HEADINGS = ["references", "external links", "see also", "further reading", "acknowledgments", "acknowledgements"]
#: Byte-size units and their factors.
SIZE_UNITS = {"b": 1, "kb": 10**3, "kib": 2**10, "mb": 10**6, "mib": 2**20, "gb": 10**9, "gib": 2**30, "tb": 10**12, "tib": 2**40}
#: Digest lengths in hex digits.
DIGEST_KINDS = {32: "md5", 40: "sha1", 64: "sha256"}


def strip(c: Column) -> Column:
    """Without white space at either end; ``trim`` would take blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def squeeze(c: Column) -> Column:
    """Control characters to blanks, one blank for runs of blanks and tabs, lines stripped, at most one empty line, ends stripped."""
    c = unix_lines(F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", " "))
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "(?m)^ | $", "")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


#: A run that one-byte decoding makes of a UTF-8 sequence: a lead byte's letter, then letters of trailing bytes.
_MISREAD = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178]{1,3}")


def _decoded(found: re.Match) -> str:
    for codec in ("cp1252", "latin-1"):
        try:
            return found.group().encode(codec).decode("utf-8")
        except UnicodeError:
            continue
    return found.group()


def repaired(text: str) -> str:
    """UTF-8 that was read as a one-byte code page, read again; other text stays."""
    return text if text.isascii() else _MISREAD.sub(_decoded, text)


@F.pandas_udf(T.StringType())
def repair(s: pd.Series) -> pd.Series:
    """Entities resolved, mis-decoded UTF-8 repaired, compatibility characters folded (NFKC)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", repaired(html.unescape(x))))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def fingerprint_text(s: pd.Series) -> pd.Series:
    """NFKC, white space to single blanks, stripped, case folded (ß as ss)."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())


def digest(c: Column) -> Column:
    """The digest by which equal texts are found."""
    return F.sha2(fingerprint_text(c), 256)


def stable_id(source: Column, identity: Column) -> Column:
    return F.concat(source, F.lit(":"), F.substring(F.sha2(F.concat(source, F.char(F.lit(0)), identity), 256), 1, 24))


def words(c: Column) -> Column:
    """The default tokenizer: runs without white space."""
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def paragraphs(c: Column) -> Column:
    """Non-empty stripped paragraphs, between lines that are empty or blank."""
    return F.filter(F.transform(F.split(unix_lines(c), r"\n\s*\n"), strip), lambda p: p != "")


def _fold_table() -> tuple[str, str]:
    """Letters with one base letter under their marks, up to Latin Extended Additional, and that letter."""
    pairs = [(chr(k), unicodedata.normalize("NFKD", chr(k))[0]) for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha() and all(unicodedata.combining(x) for x in unicodedata.normalize("NFKD", a)[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def index_terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits, marks removed, in order."""
    return F.regexp_extract_all(F.translate(F.lower(c), *_fold_table()), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(c: Column) -> Column:
    """Distinct query terms in order: ASCII, two characters or more, inner - and _ kept."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z0-9][A-Za-z0-9_-]{1,}"), F.lit(0)))


def byte_count(c: Column) -> Column:
    """``1.5GB`` or ``2 KiB`` as bytes; null where it isn't a size."""
    given = F.lower(strip(c))
    number = F.regexp_extract(given, r"^[0-9]+([.][0-9]+)?", 0)
    unit = strip(F.substr(given, F.length(number) + 1))
    factors = F.create_map(*[F.lit(x) for kv in (SIZE_UNITS | {"": 1}).items() for x in kv])
    return F.floor(F.nullif(number, F.lit("")).cast("double") * F.try_element_at(factors, unit)).cast("long")


def checksum_line(c: Column) -> Column:
    """A checksum-file line, digest first, then the name, as (name, algorithm, digest); null where it isn't one."""
    parts = F.split(strip(c), r"\s+", 2)
    found = F.lower(parts[0])
    kinds = F.create_map(*[F.lit(x) for kv in DIGEST_KINDS.items() for x in kv])
    kind = F.try_element_at(kinds, F.length(found))
    path = F.regexp_replace(F.get(parts, F.lit(1)), "^[*]", "")
    fine = found.rlike("^[0-9a-f]+$") & kind.isNotNull() & (F.length(path) > 0)
    return F.when(fine, F.struct(F.substring_index(path, "/", -1).alias("name"), kind.alias("algorithm"), found.alias("digest")))


def plain_markup(c: Column) -> Column:
    """HTML as plain text: scripts, styles and tags off, white space collapsed."""
    return strip(F.regexp_replace(repair(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<[^>]+>", " ")), r"\s+", " "))


def multimap(pairs: Column) -> Column:
    """Array of (key, value) as key -> values, both in order of appearance."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"])))


def merged(a: Column, b: Column) -> Column:
    """Map ``a`` with the entries of ``b`` put over it."""
    kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return F.map_concat(kept, b)


def cc_licenses(links: Column) -> Column:
    """Sorted distinct Creative Commons codes in an array of URLs."""
    zero = F.exists(links, lambda u: F.lower(u).contains("creativecommons.org/publicdomain/zero/"))
    form = r"creativecommons\.org/licenses/(by(?:-nc)?(?:-sa|-nd)?)/\d\.\d"
    codes = F.filter(F.transform(links, lambda u: F.regexp_extract(F.lower(u), form, 1)), lambda x: x != "")
    named = F.transform(codes, lambda x: F.concat(F.lit("CC "), F.upper(x)))
    return F.array_sort(F.array_distinct(F.concat(named, F.when(zero, F.array(F.lit("CC0"))).otherwise(F.array().cast("array<string>")))))


def micros(changed: Column) -> Column:
    """Microseconds since 1970, of a time with or without zone (without: UTC)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), changed.cast("timestamp_ntz"))


def signature(size: Column, changed: Column, *settings: Column) -> Column:
    """Change token of an input: size, time of change in microseconds, and the settings that shape its output."""
    return F.concat_ws(":", size, micros(changed), *settings)


def https_of_s3(c: Column) -> Column:
    """s3:// address as https, with its md5 parameter apart."""
    form = r"^s3://([^/]+)/([^?]*)"
    url = F.concat(F.lit("https://"), F.regexp_extract(c, form, 1), F.lit(".s3.amazonaws.com/"), F.regexp_extract(c, form, 2))
    return F.when(c.startswith("s3://"), F.struct(url.alias("url"), F.nullif(F.regexp_extract(c, r"[?&]md5=([0-9a-fA-F]+)", 1), F.lit("")).alias("md5")))
