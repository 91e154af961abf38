"""Column functions over short posts: normalized forms, mentions, ambiguity and safe envelopes."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

URL = r"https?://\S+"
HANDLE = r"(?U)@\w+"
MODEL_CHARS = 512
SCORER_CHARS = 4000
SARCASM = ("sure", "totally", "\U0001f644", '"')
EMOJI = "[\U0001F300-\U0001FAFF\U00002600-\U000027BF\U0001F1E6-\U0001F1FF]"
PRICE_TARGET = r"(?U)\$[\s\x1c-\x1f]?\d|\d[\s\x1c-\x1f]?%"
INCIDENTS = ("hack", "exploit", "outage", "halt", "depeg", "rug", "liquidation", "insolvent", "delist", "breach")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def dedup_key(text: Column) -> Column:
    """Lower case without URLs and handles: what near-equal posts share."""
    bare = F.regexp_replace(F.regexp_replace(text, URL, " "), HANDLE, " ")
    return squeeze(F.lower(bare))


@F.pandas_udf(T.StringType())
def compose(text: pd.Series) -> pd.Series:
    """Unicode NFC; SQL has no function for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities resolved."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def model_input(text: Column) -> tuple[Column, Column]:
    """Text for a model with marks for URLs and handles, at most MODEL_CHARS long; and whether it was cut."""
    marked = squeeze(F.regexp_replace(F.regexp_replace(text, URL, "<URL>"), HANDLE, "<USER>"))
    return F.left(marked, F.lit(MODEL_CHARS)), F.char_length(marked) > MODEL_CHARS


def display_text(text: Column) -> Column:
    """Plain text for a prompt: no URLs, tags, markup or control characters."""
    out = F.regexp_replace(F.regexp_replace(text, URL, " "), r"<[^>]*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[*_`#>~\[\]]", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.left(squeeze(out), F.lit(MODEL_CHARS))


def envelope(text: Column, tag: str = "untrusted_post") -> Column:
    """The text between tags; look-alikes of the tags inside are escaped."""
    safe = F.regexp_replace(text, rf"(?i)<(\s*/?\s*{tag}\s*)>", "&lt;$1&gt;")
    return F.concat(F.lit(f"<{tag}>"), safe, F.lit(f"</{tag}>"))


def mentions(text: Column, assets: dict[str, str]) -> Column:
    """Symbols among ``assets`` (symbol -> name) that the text mentions as $SYM, SYM or name, in order."""
    found = [F.when(F.regexp_like(text, F.lit(rf"(?i)(^|[^\p{{L}}\p{{N}}_])({symbol}|{name})($|[^\p{{L}}\p{{N}}_])")), symbol) for symbol, name in assets.items()]
    return F.array_compact(F.array(*found))


def ambiguity(mentioned: Column) -> Column:
    n = F.size(mentioned)
    return F.when(n == 0, "none").when(n == 1, "single").otherwise("multi_asset")


def parse_time(text: Column) -> Column:
    """ISO times, or ``EEE MMM dd HH:mm:ss Z yyyy`` (the weekday is skipped); others are NULL."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.substr(text, F.lit(5)), F.lit("MMM dd HH:mm:ss Z yyyy")))


def parse_created(text: Column) -> Column:
    """RFC 2822 times such as ``Fri, 02 Jan 2026 03:04:05 +0000`` (the weekday may be missing), or what ``parse_time`` reads; else NULL."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), parse_time(text))


def query_time(at: Column) -> Column:
    """A time as search queries write it."""
    return F.concat(F.date_format(at, "yyyy-MM-dd_HH:mm:ss"), F.lit("_UTC"))


def base_symbol(instrument: Column) -> Column:
    """The part before the first dash, and of that before the first slash."""
    return F.split_part(F.split_part(instrument, F.lit("-"), F.lit(1)), F.lit("/"), F.lit(1))


def age_days(now: Column, created: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(created)) / 8.64e10


def scorer_input(text: Column) -> Column:
    return F.left(F.trim(F.coalesce(text, F.lit(""))), F.lit(SCORER_CHARS))


def label(p_negative: Column, p_neutral: Column, p_positive: Column) -> Column:
    """The likeliest label, NULL counting as 0; ties go to negative, then neutral."""
    neg, neu, pos = (F.coalesce(p, F.lit(0.0)) for p in (p_negative, p_neutral, p_positive))
    return F.when((neg >= neu) & (neg >= pos), "negative").when(neu >= pos, "neutral").otherwise("positive")


def sign_label(sentiment: Column) -> Column:
    s = F.coalesce(sentiment, F.lit(0.0))
    return F.when(s > 0.2, "positive").when(s < -0.2, "negative").otherwise("neutral")


def tercile(sentiment: Column) -> Column:
    return F.when(sentiment <= -1 / 3, "negative").when(sentiment >= 1 / 3, "positive").otherwise("neutral")


def softmax(values: Column) -> Column:
    """Shifted by the maximum; of a total of zero, uniform."""
    raised = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raised, lambda v: F.when(total > 0, v / total).otherwise(F.lit(1.0) / F.size(values)))


def entropy(*probabilities: Column) -> Column:
    return sum((F.when(p > 0, -p * F.ln(p)).otherwise(0.0) for p in probabilities), F.lit(0.0))


def short_hash(text: Column, prefix: str, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(text, 256), F.lit(digits)))


def uuid5(namespace: str, name: Column) -> Column:
    """A version-5 UUID by built-in functions: SHA-1 with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substr(digest, F.lit(17), F.lit(1)), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    cut = lambda a, n: F.substr(digest, F.lit(a), F.lit(n))
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def _holds_any(text: Column, words: tuple[str, ...]) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(w)) for w in words))


def strata(text: Column, assets: int | Column) -> Column:
    """Labels of the kinds of post that are hard to score."""
    return F.array_compact(F.array(
        F.when(_holds_any(text, SARCASM), "sarcasm"),
        F.when(F.regexp_count(text, F.lit(EMOJI)) >= 2, "emoji"),
        F.when(F.regexp_like(text, F.lit(PRICE_TARGET)), "price_target"),
        F.when(F.lit(assets) >= 2, "multi_asset"),
        F.when(_holds_any(text, INCIDENTS), "incident"),
    ))


def percent(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.1f%%", value * 100)).otherwise("n/a")


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars for a call at prices per million tokens; an unknown price costs nothing."""
    return F.coalesce((tokens_in * price_in + tokens_out * price_out) / 1_000_000, F.lit(0.0))


def json_block(text: Column) -> Column:
    """The JSON of a reply, with or without a code fence around it."""
    return F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def round_price(price: Column, max_places: int) -> Column:
    """Five significant figures, then at most that many places (half to even)."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(price))) - 4)
    return F.when(price == 0, 0.0).otherwise(F.bround(F.bround(price / step) * step, max_places))
