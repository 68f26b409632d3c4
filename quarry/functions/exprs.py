"""Column expressions: text folding, tokens, names, dates, numbers, display."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType



def _decomposed(form: str, keep: Callable[[str], bool]) -> dict[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks and what is left of their decomposition."""
    out = {}
    for code in (*range(0xA0, 0x530), *range(0x1E00, 0x2000), *range(0x2070, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize(form, c) if keep(x))
        if plain != c:
            out[c] = plain
    return out


#: A letter and its base letter, for folding; and its ASCII form, for slugs, where that is one character.
_BASE = {c: p for c, p in _decomposed("NFD", lambda x: not unicodedata.combining(x)).items() if len(p) == 1}
_ASCII = {c: p for c, p in _decomposed("NFKD", str.isascii).items() if p}
ACCENTED, PLAIN = "".join(_BASE), "".join(_BASE.values())
_TO_ASCII = {c: p for c, p in _ASCII.items() if len(p) == 1}
_SPELLED = {c: p for c, p in _ASCII.items() if len(p) > 1}
#: What a letter of one character is in a slug: its ASCII form, or '-'.
_WORD = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_DASHED = {c: p if p in _WORD else "-" for c, p in {**{chr(i): chr(i) for i in range(128)}, **_TO_ASCII}.items() if c != p or p not in _WORD}
TOKEN = "([\\p{L}\\p{N}]+)"
TOKEN_MARKED = "([\\p{L}\\p{N}][\\p{L}\\p{N}\\p{Mn}]*)"  # the same tokens in a text that is not folded


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(x: Column) -> Column:
    """Lower case without diacritics, combined or apart."""
    return F.regexp_replace(F.translate(F.lower(x), ACCENTED, PLAIN), "\\p{Mn}+", "")


def tokens(x: Column) -> Column:
    """Folded runs of letters and digits; a null text has none."""
    return F.coalesce(F.regexp_extract_all(fold(x), F.lit(TOKEN)), F.array().cast("array<string>"))


def slug(x: Column) -> Column:
    """ASCII file-name stem: runs of other characters become '-', or '_' where one stood."""
    # what is spelled out is looked up: a class of all those letters would be tried one by one at every character
    spelled, other = F.create_map(*[F.lit(y) for c, p in _SPELLED.items() for y in (c, "".join(z if z in _WORD else "-" for z in p))]), "[^\\x00-\\x7F]"

    def ascii_of(plain: Column) -> Column:
        pieces = F.zip_with(F.split(plain, other, -1), F.regexp_extract_all(plain, F.lit(f"({other})")), lambda p, c: F.concat(p, F.coalesce(F.try_element_at(spelled, c), F.lit(""))))
        return F.when(F.octet_length(plain) == F.length(plain), plain).otherwise(F.array_join(pieces, ""))

    dashed = let(F.translate(x, "".join(_DASHED), "".join(_DASHED.values())), ascii_of)
    joined = let(dashed, lambda s: F.when(F.contains(s, F.lit("_")), F.regexp_replace(s, "[-_]*_[-_]*", "_")).otherwise(s))
    trimmed = F.btrim(F.regexp_replace(joined, "--+", "-"), F.lit("-_"))
    return let(F.coalesce(trimmed, F.lit("")), lambda s: F.when(s == "", F.lit("file")).otherwise(s))


def strip_timestamp(stem: Column) -> Column:
    """Without a leading ``YYYY-MM-DD_HH-MM-SS__``."""
    return F.regexp_replace(stem, "^\\d{4}-\\d{2}-\\d{2}_\\d{2}-\\d{2}-\\d{2}__", "")


def strip_leading_date(stem: Column) -> Column:
    """Without a leading ``YYYY-MM[-DD]`` and separator, unless nothing is left."""
    bare = lambda s: F.regexp_replace(s, "^\\d{4}-\\d{2}(?:-\\d{2})?[-_]+", "")
    return let(stem, lambda s: F.coalesce(F.nullif(bare(s), F.lit("")), s))


def truncate_stem(stem: Column, limit: int = 180, floor: int = 135) -> Column:
    """At most ``limit`` characters, cut at the last separator beyond ``floor``."""
    far = 1 << 20

    def cut(head: Column) -> Column:
        last = lambda c: F.coalesce(F.nullif(F.locate(c, F.reverse(head)), F.lit(0)), F.lit(far))
        at = F.length(head) - F.least(last("-"), last("_"))
        clipped = F.when(at >= floor, F.substring(head, F.lit(1), at.cast("int"))).otherwise(head)
        return F.coalesce(F.nullif(F.regexp_replace(clipped, "^[-_]+|[-_]+$", ""), F.lit("")), F.lit("file"))

    return let(stem, lambda s: F.when(F.octet_length(s) <= limit, s).otherwise(let(F.substring(s, 1, limit), cut)))


def safe_stem(x: Column) -> Column:
    return truncate_stem(strip_leading_date(slug(strip_timestamp(x))))


def timestamped_name(name: Column, ts: Column) -> Column:
    """``YYYY-MM-DD_HH-mm-ss__stem.ext``."""
    ext = F.regexp_extract(name, "(?<=[^.])(\\.[^.]+)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.concat(F.date_format(ts, "yyyy-MM-dd_HH-mm-ss"), F.lit("__"), safe_stem(stem), ext)


def day(x: Column) -> Column:
    """A date of four digits, one or two and one or two as a date; null if it is none."""
    return F.when(x.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_timestamp(x, F.lit("y-M-d")).cast("date"))


def whole(x: Column) -> Column:
    """A tolerant non-null integer: trimmed numeric text, else 0."""
    return F.coalesce(F.trim(x).try_cast("bigint"), F.lit(0))


def price(x: Column) -> Column:
    """A usable price: 0 to 10,000, neither NaN nor infinite, else null."""
    return F.when(~F.isnan(x) & x.between(0, 10_000), x)


def clock(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", (seconds / 60).cast("int"), (seconds % 60).cast("int"))


def release(version: Column) -> Column:
    """[major, minor, micro] of a version that begins with three numbers, else null; what follows ``+`` is no part."""
    bare = F.substring_index(F.trim(version), "+", 1)
    parts = F.array(*[F.regexp_extract(bare, "(?s)^(\\d+)\\.(\\d+)\\.(\\d+)(?:\\..*)?$", i).try_cast("int") for i in (1, 2, 3)])
    return F.when(F.forall(parts, lambda p: p.isNotNull()), parts)


def json_value(x: Column) -> Column:
    """A text that is one JSON value as a variant; null for any other, and for one that goes on after its value.

    Spark's parser reads the first value and leaves the rest unread, so the
    text is parsed in a list before a text that it can't hold, which must come second.
    """
    end = F.md5(x)
    listed = F.try_parse_json(F.concat(F.lit("["), x, F.lit(',"'), end, F.lit('"]')))
    return F.when(F.try_variant_get(listed, "$[1]", "string") == end, F.try_parse_json(x))


def _json_object(text: str | None) -> str | None:
    text = (text or "").strip()
    fence = "```"
    tries = [text]
    for piece in text.split(fence)[1::2]:  # between two fences
        body = piece.strip()
        tries.append((body[4:] if body[:4].lower() == "json" else body).strip())
    for one in tries:
        if one.startswith("{"):
            try:
                if isinstance(json.loads(one), dict):
                    return one
            except ValueError:
                pass
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            return text[at : decoder.raw_decode(text, at)[1]]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def _json_objects(x: pd.Series) -> pd.Series:
    return x.map(_json_object)


def json_object(x: Column) -> Column:
    """The JSON object in a noisy reply: all of it, a fenced block, or the first that can be decoded; else null."""
    return F.pandas_udf(_json_objects, StringType())(x)


def frame_budget(seconds: Column) -> Column:
    """Frames to look at, by duration; none without one."""
    out = F.lit(12)
    # Upper bounds in seconds and the frames below them.
    for limit, n in ((1800, 9), (900, 7), (300, 5), (120, 4), (30, 3)):
        out = F.when(seconds < limit, n).otherwise(out)
    return F.when(seconds > 0, out).otherwise(0)


def midpoint(start: Column, end: Column) -> Column:
    """The middle of a passage, or its start if it has no length."""
    return F.when(end > start, (start + end) / 2).otherwise(start)


def rescaled(segments_: Column, speed: float) -> Column:
    """Segments (start, end, text) of a sped-up recording on the clock of the original."""
    return F.transform(segments_, lambda s: F.struct((s["start"] * speed).alias("start"), (s["end"] * speed).alias("end"), s["text"].alias("text")))


# Where to listen in a recording, as shares of what a probe can reach.
PROBES = (0.03, 0.26, 0.5, 0.74, 0.96)


def probe_offsets(seconds: Column, span: float) -> Column:
    """Five offsets over a recording, the last of which leaves room for a probe of ``span`` seconds."""
    usable = F.greatest(F.lit(0.0), seconds - span)
    return F.transform(F.array(*map(F.lit, PROBES)), lambda p: F.bround(usable * p, 3))


def clamped(x: Column, low: float, high: float, otherwise: float) -> Column:
    """A setting as a number within bounds, a comma taken as the decimal point; ``otherwise`` if it is none."""
    number = F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(number.isNull(), F.lit(otherwise)).otherwise(F.least(F.greatest(number, F.lit(low)), F.lit(high)))


def provider_chain(raw: Column) -> Column:
    """Array of (provider, model) from ``provider:model, ...``; tokens without either are left out."""
    token = lambda t: F.struct(F.lower(F.trim(F.substring_index(t, ":", 1))).alias("provider"), F.trim(F.regexp_extract(t, "(?s)^[^:]*:(.*)$", 1)).alias("model"))
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ",", -1), token), lambda e: (e["provider"] != "") & (e["model"] != ""))


def document_marker(text: Column) -> Column:
    """(text without its last ``DOCUMENT: yes|no`` line, is_document or null)."""
    # Fixed value: the line by which a reader tells whether a picture is a document.
    line = "(?im)^\\s*DOCUMENT\\s*:\\s*(oui|yes|non|no)\\s*$"
    marks = F.regexp_extract_all(text, F.lit(line), F.lit(0))

    def body(last: Column) -> Column:
        at = F.length(text) - F.length(F.call_function("substring_index", text, last, F.lit(-1))) - F.length(last)
        cut = F.concat(F.substring(text, F.lit(1), at.cast("int")), F.substring(text, (at + F.length(last) + 1).cast("int"), F.length(text)))
        answer = F.lower(F.regexp_extract(last, line, 1)).isin("oui", "yes")
        strip = lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")
        return F.when(last.isNull(), F.struct(strip(text).alias("text"), F.lit(None).cast("boolean").alias("is_document"))).otherwise(F.struct(strip(cut).alias("text"), answer.alias("is_document")))

    return let(F.try_element_at(marks, F.lit(-1)), body)


def clean_context(text: Column, limit: int = 2000) -> Column:
    """Without HTML comments and ``#`` lines, trimmed and capped."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?s)<!--.*?-->", ""), "(?m)^\\s*#.*$", "")
    return F.substring(F.regexp_replace(bare, "^\\s+|\\s+$", ""), 1, limit)


def cleaned(x: Column) -> Column:
    """Trimmed, null if nothing is left."""
    return F.nullif(F.regexp_replace(x, "^\\s+|\\s+$", ""), F.lit(""))


def cleaned_list(x: Column, of=cleaned) -> Column:
    """The items of a list that something is left of; an empty list for none."""
    return F.coalesce(F.filter(F.transform(x, of), lambda v: v.isNotNull()), F.array().cast("array<string>"))


def cleaned_path(x: Column) -> Column:
    return F.regexp_replace(cleaned(x), "^/+|/+$", "")


def duration_text(seconds: Column) -> Column:
    """``1h 02m 03s``, or ``2m 03s`` below an hour."""
    total = F.bround(seconds, 0).cast("long")
    hours, minutes, rest = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.when(hours > 0, F.format_string("%dh %02dm %02ds", hours, minutes, rest)).otherwise(F.format_string("%dm %02ds", F.floor(total / 60), rest))


def hash_bits(cells: Column) -> Column:
    """Perceptual hash of 64 cells: bit i is set where cell i lies above their mean."""
    mean = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c) / F.size(cells)
    with_mean = lambda m: F.aggregate(F.transform(cells, lambda c, i: F.when(c > m, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))
    return let(mean, with_mean)


def evidence(hints: list[tuple[str, Column]]) -> Column:
    """Dated hints that are there, in order, as (source, day)."""
    return F.filter(F.array(*[F.struct(F.lit(n).alias("source"), d.alias("day")) for n, d in hints]), lambda h: h["day"].isNotNull())
