"""Text functions as Columns: folding, tokens, n-grams, phrases, query views."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the query views (folded Vietnamese).
PLAIN_STOPWORDS = ["bao", "nhieu", "la", "cua", "cho", "trong", "nam", "vao", "den", "ngay", "cong", "ty", "vnd", "dong", "tyle", "phan", "tram", "trieu", "nghin"]
UNIT_WORDS = ["vnd", "dong", "tyle", "phan", "tram", "trieu", "nghin"]
CONTEXT_STOPWORDS = [w for w in PLAIN_STOPWORDS if w not in UNIT_WORDS]
METRIC_STOPWORDS = CONTEXT_STOPWORDS + [
    "tinh", "hay", "biet", "gia", "tri", "muc", "do", "so", "voi", "giua",
    "tu", "den", "vao", "tai", "cuoi", "dau", "ky", "theo", "tren",
    "duoi", "tang", "giam", "truong", "ty", "le", "phan", "tram",
    "chenh", "lech", "binh", "quan", "lon", "nho", "cao", "thap",
]
# Words of legal forms, not part of a company's own name.
LEGAL_WORDS = ["cong", "ty", "co", "phan", "ctcp", "tong", "tap", "doan", "ngan", "hang", "tmcp", "thuong", "mai", "trach", "nhiem", "huu", "han"]


@lru_cache(maxsize=1)
def _bare() -> tuple[str, str]:
    """Single code points in lower case whose decomposition is one letter plus marks, and those letters."""
    source, target = [], []
    for point in range(0x80, 0x2000):
        c = chr(point)
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if plain != c and len(plain) == 1:
            source.append(c)
            target.append(plain)
    return "".join(source) + "đĐ", "".join(target) + "dD"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row. Inside higher-order functions Spark computes a repeated expression at every mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_marks(c: Column) -> Column:
    """Without diacritics; đ becomes d. One translate over precomposed letters after dropping loose marks, where there are other than ASCII signs."""
    source, target = _bare()
    return let(c, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.translate(F.regexp_replace(x, r"\p{Mn}", ""), source, target)).otherwise(x))


def folded(c: Column) -> Column:
    """Lower case without diacritics; punctuation and spacing stay (for binding and operator wording)."""
    return strip_marks(F.lower(c))


def fold_words(c: Column) -> Column:
    """Runs of ASCII letters and digits of the folded text, joined by blanks (for the document gate)."""
    return F.array_join(F.regexp_extract_all(folded(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def tokens(c: Column) -> Column:
    """Folded tokens of two characters or more; % counts as a letter (for ranking)."""
    return F.regexp_extract_all(folded(c), F.lit("[a-z0-9%]{2,}"), F.lit(0))


def text_tokens(c: Column) -> Column:
    """``tokens`` of whole texts. They are mentioned once and so need no ``let``, after which Spark generates no code for the search."""
    bare = F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}", ""), *_bare())
    return F.regexp_extract_all(bare, F.lit("[a-z0-9%]{2,}"), F.lit(0))


def unicode_tokens(c: Column) -> Column:
    """Tokens of two characters or more with diacritics kept; input is taken as NFC."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))


def without(words: Column, stop: list[str]) -> Column:
    """``words`` that aren't in ``stop``; repetitions stay."""
    blocked = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    return F.filter(words, lambda w: ~F.array_contains(blocked, w))


def content_words(c: Column) -> Column:
    return without(F.regexp_extract_all(folded(c), F.lit("[a-z0-9]+"), F.lit(0)), LEGAL_WORDS)


def percent_spelled(c: Column) -> Column:
    return F.replace(c, F.lit("%"), F.lit(" percent "))


def query_view(question: Column, view: str, blocked: Column | None = None, keep_years: bool = False) -> Column:
    """Query tokens of a view: plain, context, metric or unicode. ``blocked``: tickers (and years, where they don't count).

    Digits drop in all views but context (metric keeps them with ``keep_years``); % is spelled out in all but plain.
    """
    if view == "unicode":
        words = unicode_tokens(percent_spelled(question))
        plain = F.array(*map(F.lit, PLAIN_STOPWORDS))
        words = F.filter(words, lambda w: ~F.array_contains(plain, folded(w)) & ~w.rlike("^[0-9]+$"))
    else:
        words = tokens(question if view == "plain" else percent_spelled(question))
        words = without(words, {"plain": PLAIN_STOPWORDS, "context": CONTEXT_STOPWORDS, "metric": METRIC_STOPWORDS}[view])
        if view == "plain" or (view == "metric" and not keep_years):
            words = F.filter(words, lambda w: ~w.rlike("^[0-9]+$"))
    return words if blocked is None else F.filter(words, lambda w: ~F.array_contains(blocked, w))


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by blanks; none if there are fewer words."""
    firsts = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(firsts, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + j) for j in range(1, n)]))


def phrase_bonus(query: Column, row: Column) -> Column:
    """1.4 for each different shared trigram and 0.35 for each different shared bigram."""
    shared = lambda n: F.size(F.array_intersect(ngrams(query, n), ngrams(row, n)))
    return shared(3) * 1.4 + shared(2) * 0.35


def says(text: Column, *phrases: str) -> Column:
    """Whether folded text holds one of the phrases as whole words."""
    return text.rlike(r"(?U)(?<!\w)(" + "|".join(phrases) + r")(?!\w)")


def says_any_padded(text: Column, phrases: list[str]) -> Column:
    """Whether a phrase stands between blanks."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(padded, F.lit(f" {p} "))
    return found
