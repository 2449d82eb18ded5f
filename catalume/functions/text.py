"""Text: folding, word tokens, term matching."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Latin letters with a diacritic and their bases, from the Unicode decompositions."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_ACCENTED, _PLAIN = _fold_table()


def fold(text: Column) -> Column:
    """Lower case without diacritics; plain ASCII texts have none to look for."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(F.lower(F.regexp_replace(text, r"\p{Mn}", "")), _ACCENTED, _PLAIN))


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def fold_literal(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def literal_tokens(text: str) -> list[str]:
    """The word tokens of a query string."""
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in fold_literal(text)).split()


def has_word(tokens: Column, term: str, prefix: bool = False) -> Column:
    if prefix:
        return F.exists(tokens, lambda t: t.startswith(term))
    return F.array_contains(tokens, term)


def trigrams(text: Column) -> Column:
    """The distinct three-character substrings of the lower-cased text, for an inverted index."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3)))).otherwise(F.array().cast("array<string>"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def query_words(text: str, compat: bool = False) -> list[str]:
    """The words of a search, the last one a prefix; with compat they are what spaces separate, folded."""
    trimmed = text.strip()
    return [fold_literal(w) for w in trimmed.lower().split()] if compat else literal_tokens(trimmed)


def query_parts(text: str, compat: bool = False) -> list[str]:
    """The substrings of a search, from three characters on."""
    trimmed = text.strip()
    if len(trimmed) < 3:
        return []
    parts = trimmed.lower().split() if compat else "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in trimmed.lower()).split()
    return [p for p in parts if len(p) >= 3 or not compat]


def match_text(text: str, columns: dict[str, Column], target: str = "anywhere", compat: bool = False) -> Column:
    """Whether the columns match the query: by words (the last one a prefix) or, from three characters on, by substrings.

    Terms may match in different columns; `target` names the column that they are held
    to. With compat, the target binds the first term only, and of the substring terms
    those under three characters are dropped.
    """
    trimmed = text.strip()
    if not trimmed:
        return F.lit(True)
    words = trimmed.lower().split() if compat else literal_tokens(trimmed)
    if not words:
        return F.lit(False)

    def where(k: int, from_: dict[str, Column]) -> list[Column]:
        held = target != "anywhere" and (k == 0 or not compat)
        return [from_[target]] if held else list(from_.values())

    def all_words(s: Column) -> Column:
        own = {name: s[name] for name in columns}
        return all_of([any_of([has_word(c, fold_literal(w), k == len(words) - 1) for c in where(k, own)]) for k, w in enumerate(words)])

    # The array of one struct binds the tokens of each column, so that they are made once for all words.
    by_word = F.exists(F.array(F.struct(*[word_tokens(c).alias(name) for name, c in columns.items()])), all_words)
    if len(trimmed) < 3:
        return by_word
    parts = trimmed.lower().split() if compat else [w for w in "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in trimmed.lower()).split()]
    terms = [(k, p) for k, p in enumerate(parts) if len(p) >= 3 or not compat]
    if not terms:
        return by_word
    by_substring = all_of([any_of([F.contains(F.lower(c), F.lit(p)) for c in where(k, columns)]) for k, p in terms])
    return by_word | by_substring
