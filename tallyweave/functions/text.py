"""Text functions as Columns."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, functions as F

from tallyweave import vocab

_BREAK = re.compile(r"[.\n]")
_SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_SPACES = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value once, so that nested uses do not repeat its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(c) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), f"^{_SPACE}+", ""), rf"{_SPACE}+\z", "")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Literal substrings; the text is expected in lower case."""
    return reduce(or_, [F.contains(text, F.lit(w.lower())) for w in words], F.lit(False))


# --- chunking -------------------------------------------------------------------------------------

def overlapping_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Where the chunks of a text longer than `size` begin and end, from the sorted places behind its breaks."""
    ends = [0, *(m.end() for m in _BREAK.finditer(text))]
    spans, begin = [], 0
    while begin + size <= len(text):
        reached = ends[bisect_right(ends, begin + size + 1) - 1]
        spans.append((begin, reached if reached > begin + overlap else begin + size))
        if spans[-1][1] == len(text):
            return spans
        begin = spans[-1][1] - overlap
    return [*spans, (begin, len(text))]


def chunk_text(text, size: int, overlap: int = 0) -> Column:
    """Chunks of about `size` characters, ended after the last '.' or newline within reach.

    Text no longer than `size` is one chunk as it is; other chunks are trimmed. Without overlap the rule
    is a single regular expression. With overlap (smaller than `size`) each chunk starts `overlap` before
    the end of the one before; a break counts only beyond that overlap, so that every chunk brings more
    than it repeats. That form searches the breaks of each text in an Arrow function.
    """
    if size < 2 or not 0 <= overlap < size:
        raise ValueError("size must be at least 2 and overlap from 0 to below size")
    text = _col(text)
    if overlap:
        @F.pandas_udf("array<string>")
        def walk(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: t if t is None else [t] if len(t) <= size else [
                t[a:b].strip(_SPACES) for a, b in overlapping_spans(t, size, overlap)])
        return walk(text)
    rule = rf"(?s).{{1,{size - 1}}}\z|.{{1,{size}}}[.\n]|.{{{size}}}"
    pieces = F.transform(F.regexp_extract_all(text, F.lit(rule), F.lit(0)), trim)
    return F.when(F.length(text) <= size, F.array(text)).when(text.isNotNull(), pieces)


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / vocab.CHARS_PER_TOKEN)


def _first_chunk(text: Column, size: Column) -> Column:
    head = F.substring(text, F.lit(1), size + 1)

    def last(mark: str) -> Column:
        found = F.locate(mark, F.reverse(head))
        return F.when(found > 0, F.length(head) - found).otherwise(F.lit(-1))

    brk = F.greatest(last("."), last("\n"))
    return trim(F.substring(text, F.lit(1), F.when(brk > 0, brk + 1).otherwise(size)))


def fit_budget(text, max_tokens: int, tokens: Callable[[Column], Column] = estimated_tokens) -> Column:
    """Shorten text to a token budget. Each round takes the first chunk of the length that the excess
    suggests, or the shortest cut when that length is too small; rounds go on until the text fits or is
    that short. Three rounds suffice for the default estimate; only texts that need more are folded over
    a sequence as long as the rounds they can need, as each round removes three characters at least."""
    def once(t: Column) -> Column:
        excess = tokens(t) - max_tokens
        target = (F.length(t) - vocab.CHARS_PER_TOKEN * excess).cast("int")
        chunk = let(_first_chunk(t, target), lambda c: F.when(F.length(c) == F.length(t), F.substring(t, F.lit(1), target))
                     .otherwise(c))
        shortest = F.substring(t, 1, vocab.SHORTEST_CUT)
        return F.when(excess <= 0, t).when(target < vocab.SHORTEST_CUT, shortest).otherwise(chunk)

    result = F.coalesce(_col(text), F.lit(""))
    for _ in range(3):
        result = let(result, once)

    def on(t: Column) -> Column:
        left = F.sequence(F.lit(1), F.ceil(F.length(t) / vocab.CHARS_PER_TOKEN).cast("int") + 1)
        over = (tokens(t) > max_tokens) & (F.length(t) > vocab.SHORTEST_CUT)
        return F.when(over, F.aggregate(left, t, lambda now, _: once(now))).otherwise(t)

    return let(result, on)


# --- markup ---------------------------------------------------------------------------------------

def strip_html(s) -> Column:
    out = F.regexp_replace(_col(s), r"<[^>]*>", "")
    for entity, char in vocab.HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.coalesce(trim(out), F.lit(""))


def markdown_to_html(s, display_math_first: bool = False) -> Column:
    """Ordered rewrites. By default `$...$` runs before `$$...$$`, so display math ends up tagged inline."""
    maths = [vocab.INLINE_MATH, vocab.DISPLAY_MATH]
    out = _col(s)
    for pattern, into in [*vocab.MARKUP_REWRITES, *(reversed(maths) if display_math_first else maths), vocab.CODE_BLOCK]:
        out = F.regexp_replace(out, pattern, into)
    return F.format_string(vocab.MARKUP_WRAPPER, out)


def truncate(s, n: int) -> Column:
    return F.when(F.length(_col(s)) > n, F.concat(F.substring(_col(s), 1, n), F.lit("..."))).otherwise(_col(s))


def slugify(s) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(s)), "[^a-z0-9]+", "-"), r"^-|-\z", "")


# --- checks and formats ---------------------------------------------------------------------------

def is_valid_email(s) -> Column:
    return _col(s).rlike(vocab.EMAIL)


def is_valid_currency(s) -> Column:
    return _col(s).rlike(vocab.CURRENCY_CODE)


def is_supported(s, values: Sequence[str]) -> Column:
    return _col(s).isin(list(values))


def is_strong_password(s) -> Column:
    kinds = ["[A-Z]", "[a-z]", "[0-9]", "[^A-Za-z0-9]"]
    return reduce(and_, [_col(s).rlike(k) for k in kinds], F.length(_col(s)) >= vocab.SHORTEST_PASSWORD)


def format_currency(x, currency) -> Column:
    """en-US money: symbol, grouped digits, minus sign first; JPY has no fraction."""
    if isinstance(currency, str):
        currency = F.lit(currency) if currency in vocab.CURRENCIES else F.col(currency)
    symbols = F.create_map(*[F.lit(v) for pair in vocab.CURRENCIES.items() for v in pair])
    symbol = F.coalesce(F.try_element_at(symbols, currency), F.concat(currency, F.lit(" ")))
    whole = currency.isin(vocab.NO_FRACTION_CURRENCIES)
    size = F.abs(_col(x).cast("double"))
    digits = F.when(whole, F.format_number(F.round(size, 0), 0)).otherwise(F.format_number(F.round(size, 2), 2))
    return F.concat(F.when(_col(x) < 0, "-").otherwise(""), symbol, digits)


def format_number(x) -> Column:
    """en-US number with at most three decimals."""
    return F.regexp_replace(F.format_number(F.round(_col(x).cast("double"), 3), 3), r"\.?0+\z", "")


# --- answers --------------------------------------------------------------------------------------

def bullets(text) -> Column:
    lines = F.filter(F.transform(F.split(_col(text), "\n"), trim), lambda line: line.startswith("-"))
    return F.transform(lines, lambda line: trim(F.substring(line, 2, 1 << 30)))


def labelled_field(text, field: str) -> Column:
    pattern, default = vocab.FIELD_PATTERNS[field]
    found = F.nullif(F.regexp_extract(_col(text), pattern, 1), F.lit(""))
    if field == "complexity":
        found = F.lower(found)
    return F.coalesce(found, _col(text) if default is None else F.lit(default))


def priority(text) -> Column:
    return let(F.lower(_col(text)), lambda low: F.when(contains_any(low, vocab.HIGH_PRIORITY_WORDS), "high")
               .when(contains_any(low, vocab.LOW_PRIORITY_WORDS), "low").otherwise("medium"))


def escalate(base, text) -> Column:
    critical = let(F.lower(_col(text)), lambda low: contains_any(low, vocab.CRITICAL_WORDS))
    return F.when(critical, "high").otherwise(_col(base))


def _lookup(key, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), _col(key))


def complexity_to_priority(c) -> Column:
    return _lookup(c, vocab.COMPLEXITY_PRIORITY)


def priority_order(c) -> Column:
    return _lookup(c, vocab.PRIORITY_ORDER)


def mention_notes(text, low_terms: Sequence[str] = tuple(vocab.LOW_IMPACT_TERMS),
                  high_terms: Sequence[str] = tuple(vocab.HIGH_IMPACT_TERMS)) -> Column:
    """A note for each term found in the text, low-impact terms first."""
    notes = [(t, vocab.LOW_IMPACT_NOTE) for t in low_terms] + [(t, vocab.HIGH_IMPACT_NOTE) for t in high_terms]
    return let(F.lower(_col(text)), lambda low: F.array_compact(F.array(*[
        F.when(F.contains(low, F.lit(t)), F.lit(note % t)) for t, note in notes])))


def disclaimer(role) -> Column:
    return _lookup(role, vocab.DISCLAIMERS)


def with_disclaimer(message, role) -> Column:
    return F.concat(_col(message), F.lit("\n\n"), disclaimer(role))


def recommendations_with_disclaimer(items, role) -> Column:
    return F.array_append(_col(items), disclaimer(role))


def enrich_text(query, context, role) -> Column:
    """Query, the context lines that exist, and the role hint. `context` is a struct column or NULL;
    an empty or zero field counts as absent."""
    context = _col(context)
    lines = []
    for field, form in vocab.CONTEXT_LINES:
        value = context[field]
        text = F.concat_ws(", ", value) if field == "medications" else value.cast("string")
        absent = value.isNull() if field == "medications" else F.coalesce(text.isin("", "0", "0.0"), F.lit(True))
        lines.append(F.when(~absent, F.format_string(form, text)))
    block = F.concat(F.lit("\n\n"), F.concat_ws("\n", F.lit(vocab.CONTEXT_TITLE), *lines))
    hint = F.concat(F.lit("\n\n"), F.format_string(vocab.ROLE_HINT, _col(role)))
    return F.concat(_col(query), F.when(context.isNull(), "").otherwise(block), hint)


# --- calls ----------------------------------------------------------------------------------------

def transcript_text(segments) -> Column:
    """`speaker: text` lines of an ordered segment array."""
    return F.array_join(F.transform(_col(segments), lambda s: F.concat_ws(": ", s["speaker"], s["text"])), "\n")


def valid_outcome(call_type, label) -> Column:
    """The trimmed label where the call type allows it, else NULL."""
    label = trim(label)
    allowed = [
        (_col(call_type) == kind) & label.isin(values) for kind, values in vocab.OUTCOMES.items()
    ]
    return F.when(reduce(or_, allowed), label)


def response_confidence(finish, temperature) -> Column:
    scored = F.least(F.lit(1.0), (1 - _col(temperature)) * 0.8 + 0.2)
    return F.when(_col(finish) == "stop", scored).otherwise(F.lit(0.5))


# --- lists and hashes -----------------------------------------------------------------------------

def content_hash(text) -> Column:
    return F.md5(F.encode(_col(text), "UTF-8"))


def split_list(s) -> Column:
    return F.transform(F.split(_col(s), ","), trim)


def highlight(text, terms: Sequence[str], around: int = 30) -> Column:
    """The text around the earliest of the terms, NULL without a hit; case does not matter."""
    lowered = F.lower(_col(text))
    hits = F.filter(F.array(*[F.locate(t.lower(), lowered) for t in terms]), lambda p: p > 0)
    return let(F.array_min(hits), lambda at: F.when(at.isNotNull(), F.substring(
        _col(text), F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around)) + around + 1)))


def compact(items) -> Column:
    """An array without NULLs and empty strings."""
    return F.filter(_col(items), lambda x: x.isNotNull() & (x != ""))


def join_lines(items) -> Column:
    return F.array_join(_col(items), "\n")


def numbered_list(items) -> Column:
    return F.array_join(F.transform(_col(items), lambda x, i: F.concat_ws(". ", (i + 1).cast("string"), x)), "\n")
