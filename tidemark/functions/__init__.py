"""Column helpers with defined results for NULL, zero and ties."""

from __future__ import annotations

import html as entities
import math
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRADING_DAYS = 252


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b; 0 if b is 0; NULL if either is NULL."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(a, b), F.lit(0.0)))


def clamp(v: Column | str, low: float, high: float) -> Column:
    """v inside [low, high]; NULL stays NULL."""
    v = col(v)
    return F.when(v.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v)))


def or_default(v: Column | str, default: float) -> Column:
    """v, or the default if it is NULL or 0."""
    return F.coalesce(F.nullif(col(v), F.lit(0.0)), F.lit(float(default)))


def mean0(v: Column | str) -> Column:
    return F.coalesce(F.avg(v), F.lit(0.0))


def std0(v: Column | str) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(v), F.lit(0.0))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation within [-1, 1]; 0 for fewer than two pairs or without variance."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    r = F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))
    return F.coalesce(clamp(r, -1, 1), F.lit(0.0))


def tanh_score(v: Column | str, scale: float) -> Column:
    """0.5 + 0.5 tanh(v / scale); 0.5 if scale is not positive."""
    return F.lit(0.5) + 0.5 * F.tanh(col(v) / scale) if scale > 0 else F.lit(0.5)


def smoothstep(v: Column | str) -> Column:
    """x * x * (3 - 2 x) of v clamped to [0, 1]."""
    x = clamp(v, 0, 1)
    return x * x * (3 - 2 * x)


def decay(rate: Column | float, days: Column, norm: float) -> Column:
    """exp(-rate * max(days, 1) / norm)."""
    return F.exp(-rate * F.greatest(days, F.lit(1)) / norm)


def daily_rate(annual: Column | str) -> Column:
    return F.pow(1 + col(annual), F.lit(1.0 / TRADING_DAYS)) - 1


def annualize(v: Column | str) -> Column:
    return col(v) * math.sqrt(TRADING_DAYS)


def keyword_count(text: Column | str, words: list[str]) -> Column:
    """Occurrences of all words in a text, case aside, each word counted for itself without overlaps."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    total = F.lit(0)
    for w in words:
        w = w.lower()
        gone = F.octet_length(low) - F.octet_length(F.replace(low, F.lit(w), F.lit("")))
        total = total + (gone / len(w.encode())).cast("int")
    return total


def squeeze(text: Column | str) -> Column:
    """White space as single blanks, none at the ends. Only what is not yet a single blank is replaced."""
    return F.trim(F.regexp_replace(col(text), r"\s{2,}|[\t\n\x0B\f\r]", " "))


@F.arrow_udf(T.StringType())
def unescape(texts: pa.Array) -> pa.Array:
    """Texts with all character references of HTML decoded, named and numeric, once."""
    return pa.array([None if t is None else entities.unescape(t) for t in texts.to_pylist()], pa.string())


_ENDED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([0-9A-Za-z]+));")


@F.arrow_udf(T.StringType())
def unescape_ended(texts: pa.Array) -> pa.Array:
    """As unescape, but only references with a semicolon; a name cut short, such as &amp, stays as it is."""
    decode = lambda m: entities.unescape(m[0]) if m[1] is None or f"{m[1]};" in html5 else m[0]
    return pa.array([None if t is None else _ENDED.sub(decode, t) for t in texts.to_pylist()], pa.string())


def strip_html(html: Column | str, keep_bodies: bool = False, ended: bool = False) -> Column:
    """Text of a page: script and style bodies out (unless keep_bodies), tags to blanks, character
    references decoded (ended: only those with a semicolon), white space squeezed. Only texts with references
    leave the JVM."""
    t = col(html)
    marked = t
    if not keep_bodies:
        marked = F.regexp_replace(marked, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    # Patterns are slow and Python is far, so texts without a tag or the start of a reference are spared both.
    t = F.when(t.contains("<"), F.regexp_replace(marked, r"(?s)<[^>]+>", " ")).otherwise(t)
    return squeeze(F.coalesce((unescape_ended if ended else unescape)(F.when(t.rlike("&[#A-Za-z]"), t)), t))


def title_case(code: Column | str) -> Column:
    """A code such as annual_report as a title."""
    return F.initcap(F.replace(col(code), F.lit("_"), F.lit(" ")))


def announced_at(accepted: Column | str, filed: Column | str) -> Column:
    """The time of acceptance; 20:05 of the filing day where it is missing."""
    return F.coalesce(col(accepted), F.to_timestamp(F.concat(F.date_format(col(filed), "yyyy-MM-dd"), F.lit(" 20:05:00"))))


#: Suffixes of amounts and what they multiply by.
SCALES = (("trillion", 1e12), ("tn", 1e12), ("billion", 1e9), ("bn", 1e9), ("b", 1e9), ("million", 1e6), ("m", 1e6), ("thousand", 1e3), ("k", 1e3))
#: A number, and what follows an amount for one share.
_NUMBER, _PER_SHARE = r"(\d+(?:\.\d+)?)", r"\s*(?:per\s+share|/share)"
_SUFFIX = "|".join(name for name, _ in SCALES)


def money_scale(suffix: Column | str) -> Column:
    """What a suffix (any case; none: 1) multiplies an amount by."""
    s, out = F.lower(F.coalesce(col(suffix), F.lit(""))), F.lit(1.0)
    for name, value in reversed(SCALES):
        out = F.when(s == name, F.lit(value)).otherwise(out)
    return out


def context_money(text: Column | str, words: list[str], radius: int = 120, least: float = 1e6, strict_suffix: bool = False) -> Column:
    """Largest amount of `least` or more within `radius` characters of any of the words; NULL if none.
    A suffix counts even at the start of a longer word, unless strict_suffix. Only texts with digits leave the JVM."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    pattern = re.compile(rf"{_NUMBER}\s*({_SUFFIX})?{'(?![a-z])' if strict_suffix else ''}", re.ASCII)
    words, scale = [w.lower() for w in words], dict(SCALES)

    @F.arrow_udf(T.DoubleType())
    def largest(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _largest(t, words, radius, least, pattern, scale) for t in texts.to_pylist()], pa.float64())

    return largest(F.when(low.rlike("[0-9]"), low))


def _largest(text: str, words: list[str], radius: int, least: float, pattern: re.Pattern, scale: dict[str, float]) -> float | None:
    """Looks only around the words that have a digit in reach; a number that begins or ends outside is cut there."""
    best = None
    for w in words:
        at, n = text.find(w), len(w)
        for digits in re.finditer("[0-9]+", text):
            first = digits.start() - radius - n + 1
            if _overlaps(w):  # such a word is counted from the start of the text, others where they are
                while 0 <= at < first:
                    at = text.find(w, at + n)
            elif 0 <= at < first:
                at = text.find(w, first)
            while 0 <= at < digits.end() + radius:
                for m in pattern.finditer(text, max(at - radius, 0), at + n + radius):
                    value = float(m[1]) * scale.get(m[2], 1.0)
                    if value >= least and (best is None or value > best):
                        best = value
                at = text.find(w, at + n)
            if at < 0:
                break
    return best


def _overlaps(word: str) -> bool:
    return any(word.startswith(word[i:]) for i in range(1, len(word)))


def per_share(text: Column | str) -> Column:
    """The first amount followed by 'per share' or '/share', NULL if none."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.when(low.contains("share"), F.nullif(F.regexp_extract(low, _NUMBER + _PER_SHARE, 1), F.lit("")).cast("double"))


def market_day(ts: Column | str, close_hour: int = 16, zone: str = "America/New_York") -> tuple[Column, Column]:
    """Local date and whether the market has closed, of a UTC timestamp."""
    local = F.from_utc_timestamp(col(ts), zone)
    return F.to_date(local), F.hour(local) >= close_hour
