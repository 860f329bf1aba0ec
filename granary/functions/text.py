"""Column functions over text: cleaning, tokenising, n-grams, extraction and rule-based quality scores.

Word characters are letters, numbers and the underscore of any script; white space includes the Unicode separators.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\p{Z}"

# The patterns that the cleaner removes, in the order in which it removes them.
HTML = r"<[^>]+>"
URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
EMAIL = rf"[{WORD}.-]+@[{WORD}.-]+\.[{WORD}]+"
# The same for Java's engine: a match may start where the last one ended or where a run of its characters starts, and nowhere
# else, so that words without an at-sign are looked at once.
EMAIL_ONCE = rf"(?:\G|(?<![{WORD}.-]))[{WORD}.-]++@[{WORD}.-]+\.[{WORD}]+"

# Words that don't count as content.
STOP_WORDS = (
    "the", "and", "that", "this", "with", "from", "have", "has", "been", "were", "was", "are", "for", "not", "but",
    "what", "all", "can", "had", "her", "his", "one", "our", "out", "their", "there", "they", "which", "will", "would",
    "your", "about", "also", "into", "more", "some", "than", "them", "then", "these", "when", "who", "how", "its",
    "may", "each",
)


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def as_text(x: Column) -> Column:
    """A null is the empty string; ends are stripped."""
    return strip(F.coalesce(x.cast("string"), F.lit("")))


def _where_cued(pattern: str, cues: tuple[str, ...]) -> Callable[[Column], Column]:
    """Matches become spaces; the pattern runs only over texts that have what each of its matches has."""
    return lambda y: F.when(reduce(operator.or_, [F.contains(y, F.lit(c)) for c in cues]), F.regexp_replace(y, pattern, " ")).otherwise(y)


def clean(x: Column, min_length: int = 10, max_length: int | None = None, html: bool = True, urls: bool = True, emails: bool = True, lower: bool = True) -> Column:
    """Markup, addresses and e-mails become spaces, spaces collapse; null if too short; cut to max_length."""
    for on, pattern, cues in ((html, HTML, ("<",)), (urls, URL, ("http", "www.")), (emails, EMAIL_ONCE, ("@",))):
        if on:
            x = let(x, _where_cued(pattern, cues))
    x = strip(F.regexp_replace(x, rf"[{SPACE}]+", " "))
    if lower:
        x = F.lower(x)
    kept = let(x, lambda y: F.when(F.length(y) >= F.lit(max(min_length, 1)), y))
    return F.substring(kept, 1, max_length) if max_length else kept


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, even where the body uses it inside a lambda of its own."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _full(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def plain_tokens(x: Column) -> Column:
    """Lower case, split on white space."""
    return _full(F.split(F.lower(x), rf"[{SPACE}]+"))


def split_words(x: Column) -> Column:
    return _full(F.split(x, rf"[{SPACE}]+"))


def metric_tokens(x: Column) -> Column:
    """Lower case without punctuation, split on white space."""
    return _full(F.split(F.regexp_replace(F.lower(x), rf"[^{WORD}{SPACE}]", ""), rf"[{SPACE}]+"))


def chat_words(x: Column) -> Column:
    """Runs of word characters and apostrophes, lower case."""
    return F.regexp_extract_all(F.lower(x), F.lit(rf"([{WORD}']+)"), F.lit(1))


def opening_key(x: Column, words: int = 5) -> Column:
    """The first words of a text, without case and punctuation."""
    return F.array_join(F.slice(_full(F.split(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "), " ")), 1, words), " ")


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of an array of tokens, in order, as strings; empty if there are fewer tokens."""
    if n == 1:
        return tokens
    return let(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>")))


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"[.!?]+"), strip), lambda s: s != "")


def first_code_block(x: Column) -> Column:
    """The first fenced Python block, or else the whole text, stripped."""
    block = F.regexp_extract(x, r"(?is)```(?:python|py)?[ \t\r\f]*\n(.*?)```", 1)
    return strip(F.when(F.regexp_like(x, F.lit(r"(?is)```(?:python|py)?[ \t\r\f]*\n(.*?)```")), block).otherwise(x))


def choice_answer(x: Column) -> Column:
    """The letter A to D that an answer names, by five patterns in order; null if there is none."""
    tries = [
        F.regexp_extract(x, rf"(?i)(?:the[{SPACE}]+)?answer[{SPACE}]*(?:is|:)[{SPACE}]*([A-D])(?![{WORD}])", 1),
        F.regexp_extract(x, r"\\boxed\{([A-Da-d])\}", 1),
        F.regexp_extract(strip(x), rf"(?m)^([A-Da-d])[).{SPACE}]", 1),
        F.regexp_extract(x, r"\*\*([A-Da-d])\*\*", 1),
        F.coalesce(F.try_element_at(F.regexp_extract_all(x, F.lit(rf"(?<![{WORD}])([A-Da-d])(?![{WORD}])"), F.lit(1)), F.lit(-1)), F.lit("")),
    ]
    return F.upper(F.coalesce(*[F.when(t != "", t) for t in tries]))


def has_answer_format(x: Column) -> Column:
    return F.regexp_like(x, F.lit(rf"(?i)(?:the[{SPACE}]+)?answer[{SPACE}]*(?:is|:)[{SPACE}]*[A-D](?![{WORD}])"))


# ---- rule-based scores ---------------------------------------------------------------------------------------------


def _variety(grams: Column) -> Column:
    return let(grams, lambda g: F.size(F.array_distinct(g)) / F.greatest(F.size(g), F.lit(1)))


def repetition_rate(tokens: Column, n: int) -> Column:
    """1 less the share of different n-grams; 0 if there are fewer tokens than n."""
    return let(tokens, lambda t: F.when(F.size(t) < n, F.lit(0.0)).otherwise(1 - _variety(ngrams(t, n))))


def trigram_variety(x: Column) -> Column:
    return let(plain_tokens(x), lambda t: F.when(F.size(t) < 5, F.lit(0.0)).otherwise(_variety(ngrams(t, 3))))


def length_score(x: Column, low: int = 20, high: int = 200) -> Column:
    def score(n: Column) -> Column:
        return F.when(n < 5, F.lit(0.0)).when(n < low, n / F.lit(low)).when(n <= high, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (n - high) / F.lit(high)))

    return let(F.size(split_words(x)), score)


def coherence_score(x: Column) -> Column:
    """0.3 for a sentence end, 0.2 for a capital at a sentence's start, 0.3 for few odd characters, 0.2 for varied words."""
    capital = F.exists(F.split(x, rf"[.!?][{SPACE}]+"), lambda s: F.regexp_like(s, F.lit(r"^\p{Lu}")))
    odd = F.length(F.regexp_replace(x, rf"[a-zA-Z0-9{SPACE}.,!?;:'\"()\-]", "")) / F.greatest(F.length(x), F.lit(1))
    varied = let(plain_tokens(x), lambda t: (F.size(t) >= 5) & (_variety(t) > 0.4))
    one = lambda condition, weight: F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
    return one(F.regexp_like(x, F.lit(r"[.!?]")), 0.3) + one(capital, 0.2) + one((F.length(x) > 0) & (odd < 0.1), 0.3) + one(varied, 0.2)


def content_words(x: Column) -> Column:
    """Different runs of four or more letters a-z that are no stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z]{4,})"), F.lit(1))), F.array(*map(F.lit, STOP_WORDS)))


def topic_score(prompt: Column, completion: Column) -> Column:
    """How much of the prompt's content the second half of a completion keeps, against the first half."""

    def score(asked: Column, words: Column) -> Column:
        half = F.floor(F.size(words) / 2).cast("int")
        overlap = lambda part: F.size(F.array_intersect(content_words(F.array_join(part, " ")), asked)) / F.greatest(F.size(asked), F.lit(1))
        first, second = overlap(F.slice(words, F.lit(1), half)), overlap(F.slice(words, half + 1, F.size(words)))
        kept = let(F.struct(first.alias("a"), second.alias("b")), lambda p: F.when(p["a"] > 0, F.least(F.lit(1.0), p["b"] / p["a"])).otherwise(F.least(F.lit(1.0), p["b"] * 5)))
        return F.when((F.size(asked) == 0) | (F.size(words) < 20), F.lit(1.0)).otherwise(kept)

    return let(F.struct(content_words(prompt).alias("a"), split_words(completion).alias("w")), lambda p: score(p["a"], p["w"]))


def language_quality(prompt: Column, completion: Column) -> Column:
    """0.25 variety + 0.15 length + 0.25 coherence + 0.20 topic + 0.15 for five words; 0 under three characters."""
    x = strip(completion)
    topic = F.when(F.coalesce(F.length(prompt), F.lit(0)) > 0, topic_score(prompt, x)).otherwise(1.0)
    full = F.when(F.size(split_words(x)) >= 5, 1.0).otherwise(0.0)
    return F.when(F.length(x) < 3, 0.0).otherwise(0.25 * trigram_variety(x) + 0.15 * length_score(x) + 0.25 * coherence_score(x) + 0.20 * topic + 0.15 * full)
