"""Column-to-column functions: identifiers, names, labels, numbers and dates.

All of them compile to JVM expressions and keep null as null unless stated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings that stand for a missing identifier (compared in lower case).
MISSING_TOKENS = ("", "nan", "none", "<na>")

# Generational suffixes that are not part of a person's name.
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_id(c: Column | str) -> Column:
    """Trimmed text without a trailing ``.0``; missing spellings become null."""
    text = F.btrim(as_column(c).cast("string"), F.lit(" \t\n\x0b\f\r"))
    text = F.when(F.endswith(text, F.lit(".0")), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    return F.when(~F.lower(text).isin(*MISSING_TOKENS), text)


def _accent_table() -> tuple[str, str]:
    """Letters of the Latin blocks with the base letter each one decomposes to."""
    import unicodedata

    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accent_table()


def fold_accents(c: Column | str) -> Column:
    """Letters without their marks; precomposed and combining marks alike."""
    text = F.translate(as_column(c), _ACCENTED, _PLAIN)
    return F.regexp_replace(text, r"\p{Mn}+", "")


def normalize_name(c: Column | str) -> Column:
    """Lower-case words of a person's name, suffixes dropped; null becomes ``''``."""
    text = F.lower(fold_accents(F.coalesce(as_column(c).cast("string"), F.lit(""))))
    text = F.regexp_replace(text, rf"\b({'|'.join(NAME_SUFFIXES)})\b\.?", " ")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def compact_name(c: Column | str) -> Column:
    """:func:`normalize_name` without the blanks."""
    return F.replace(normalize_name(c), F.lit(" "), F.lit(""))


def split_qualifier(c: Column | str) -> Column:
    """Struct (base, base_compact, qualifier_compact) of ``Name (Qualifier)``."""
    text = F.coalesce(as_column(c).cast("string"), F.lit(""))
    pattern = r"\s*\(([^()]*)\)\s*$"
    base = F.trim(F.regexp_replace(text, pattern, ""))
    return F.struct(base.alias("base"), compact_name(base).alias("base_compact"), compact_name(F.regexp_extract(text, pattern, 1)).alias("qualifier_compact"))


def snake_label(c: Column | str) -> Column:
    """Lower-case label, other characters as single inner underscores."""
    text = F.regexp_replace(F.lower(as_column(c).cast("string")), r"[^a-z0-9]+", "_")
    return F.regexp_replace(text, r"^_+|_+$", "")


def normalize_position(c: Column | str) -> Column:
    """Upper-case position with tight dashes; blank becomes null."""
    text = F.replace(F.upper(F.trim(as_column(c).cast("string"))), F.lit("/"), F.lit("-"))
    text = F.regexp_replace(text, r"\s*-\s*", "-")
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


# Long position names and their letters.
POSITION_WORDS = {"GUARD": "G", "FORWARD": "F", "CENTER": "C"}


def college_position(c: Column | str) -> Column:
    """:func:`normalize_position` with the long names mapped to letters."""
    text = normalize_position(c)
    return reduce(lambda chain, kv: chain.when(text == kv[0], F.lit(kv[1])), POSITION_WORDS.items(), F.when(F.lit(False), text)).otherwise(text)


def season_label(start_year: Column | str) -> Column:
    """``2019`` becomes ``2019-20``."""
    y = as_column(start_year).cast("int")
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def season_start(label: Column | str) -> Column:
    """First four digits of a season label, null when they are no year."""
    return F.substring(as_column(label), 1, 4).try_cast("int")


def sheet_column_index(ref: Column | str) -> Column:
    """Zero-based index of a spreadsheet column such as ``AB12``."""
    letters = F.split(F.regexp_replace(F.upper(as_column(ref)), r"[^A-Z]", ""), "")
    return F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1


def number(c: Column | str) -> Column:
    """Lenient number: unreadable text, NaN and infinities become null."""
    return finite(as_column(c).try_cast("double"))


def finite(c: Column | str) -> Column:
    x = as_column(c)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """Quotient; null for a zero or missing denominator and for non-finite results."""
    return finite(as_column(a).cast("double") / F.nullif(as_column(b).cast("double"), F.lit(0.0)))


def sum_columns(cols: Sequence[Column | str]) -> Column:
    """Row-wise sum that is null only where every input is null."""
    xs = [as_column(c) for c in cols]
    return F.when(F.coalesce(*xs).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in xs]))


def any_null(cols: Sequence[Column | str]) -> Column:
    return reduce(lambda a, b: a | b, [as_column(c).isNull() for c in cols])


def any_value(cols: Sequence[Column | str]) -> Column:
    return F.coalesce(*[as_column(c).cast("string") for c in cols]).isNotNull()


def within(c: Column | str, low: float, high: float) -> Column:
    """The value where it lies in the closed range, else null."""
    x = as_column(c)
    return F.when(x.between(low, high), x)


def right_closed_bins(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]``; null outside."""
    x = as_column(c)
    pairs = list(zip(edges[:-1], edges[1:], labels, strict=True))
    out = F.when((x > pairs[0][0]) & (x <= pairs[0][1]), F.lit(pairs[0][2]))
    for low, high, label in pairs[1:]:
        out = out.when((x > low) & (x <= high), F.lit(label))
    return out


def parse_time(c: Column | str) -> Column:
    """Lenient timestamp: ISO text with or without seconds; anything else is null."""
    text = as_column(c).cast("string")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mmX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm")))


def age_on_july_first(year: Column | str, born: Column | str) -> Column:
    """Whole days from birth to 1 July of ``year``, over 365.2425."""
    seconds = F.unix_timestamp(F.make_date(as_column(year).cast("int"), F.lit(7), F.lit(1)).cast("timestamp")) - F.unix_timestamp(as_column(born).cast("timestamp"))
    return F.floor(seconds / 86400.0) / F.lit(365.2425)


def clipped_logit(p: Column | str, eps: float = 1e-6) -> Column:
    """Logit of a probability kept ``eps`` off 0 and 1; null stays null, NaN and infinities fail the job."""
    p = as_column(p).cast("double")
    x = F.when(F.isnan(p) | (F.abs(p) == float("inf")), F.raise_error(F.lit("logit of a score that is not finite")).cast("double")).when(p.isNotNull(), F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p)))
    return F.ln(x / (1.0 - x))


def half_up_count(x: Column) -> Column:
    return F.floor(x.cast("double") + F.lit(0.5))


def close_to(a: Column | str, b: Column | str, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(as_column(a) - as_column(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(as_column(b))


def any_alias(text: Column, aliases: Column) -> Column:
    """Whether the text contains any non-empty alias of an array; null-safe."""
    return F.coalesce(F.exists(aliases, lambda a: (a != "") & text.contains(a)), F.lit(False))


def contains_either_way(a: Column, b: Column) -> Column:
    """True when one non-empty text equals or contains the other; null-safe."""
    return F.coalesce((a != "") & (b != "") & (a.contains(b) | b.contains(a)), F.lit(False))
