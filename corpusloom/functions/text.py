"""Text to words to features, as Column expressions (no Python in the data path).

Two profiles exist: ``v1`` works on the text as stored, ``v3`` applies NFKC first. NFKC is not a
Spark built-in; :func:`nfkc` is an Arrow function that touches only texts holding a character that
NFKC can change.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words are letters and digits, with apostrophes only inside.
WORD = r"[a-z0-9\p{IsAlphabetic}\p{N}]++(?:'++[a-z0-9\p{IsAlphabetic}\p{N}]++)*+"
ALNUM_RUN = r"[\p{IsAlphabetic}\p{N}]+"
MAX_CHARS = 512


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def squeeze(c: Column | str) -> Column:
    """Every run of Unicode white space becomes one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def lower_by_char(c: Column | str) -> Column:
    """Lower case character by character: a capital sigma never becomes a final one."""
    return F.lower(F.replace(col(c), F.lit("Σ"), F.lit("σ")))


def straight(c: Column) -> Column:
    """Typographic apostrophes become straight ones."""
    return F.replace(F.replace(c, F.lit("’"), F.lit("'")), F.lit("‘"), F.lit("'"))


def normalize(c: Column | str) -> Column:
    """v1 normal form: lower case, straight apostrophes, single blanks. Null stays null."""
    return squeeze(straight(lower_by_char(c)))


def nfkc_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column | str) -> Column:
    """NFKC. A text without characters from U+00A0 on is passed to Python as null and kept as it is."""
    c = col(c)
    unstable = F.when(c.rlike(r"[^\x00-\x7f]"), c)
    return F.coalesce(F.pandas_udf(nfkc_of, StringType())(unstable), c)


def normalize_nfkc(c: Column | str) -> Column:
    """v3 normal form: NFKC, then the v1 form."""
    return normalize(nfkc(c))


def words(normal: Column | str) -> Column:
    """Words of a normalised text. Apostrophes inside a word stay, those at its ends go."""
    return F.regexp_extract_all(col(normal), F.lit(WORD), F.lit(0))


def tokens(c: Column | str, profile: str = "v1") -> Column:
    """Words of a text. White space is left as it is, since it separates words in any amount."""
    plain = {"v1": col, "v3": nfkc}[profile](c)
    return words(straight(lower_by_char(plain)))


def feature_identity(toks: Column | str) -> Column:
    return F.array_join(col(toks), " ")


def contains_phrase(toks: Column | str, phrase: Column | str) -> Column:
    """A contiguous run of whole words; an empty phrase is in no text."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return (phrase != "") & F.concat(F.lit(" "), F.array_join(col(toks), " "), F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


# Words swapped when a statement is turned back on its speaker.
REFLECTIONS = {"i": "you", "me": "you", "my": "your", "mine": "yours", "am": "are", "you": "I", "your": "my", "yours": "mine", "are": "am"}


def reflect(toks: Column | str) -> Column:
    swap = F.create_map(*[F.lit(x) for pair in REFLECTIONS.items() for x in pair])
    return F.array_join(F.transform(col(toks), lambda w: F.coalesce(F.try_element_at(swap, w), w)), " ")


def _windows(size: Column, n: int, piece) -> Column:
    """``piece(i)`` for every window of ``n`` that begins at i, counted from 1."""
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), piece)).otherwise(F.array().cast("array<string>"))


def word_ngrams(toks: Column | str, low: int, high: int) -> Column:
    """``w2:a_b`` and so on, shorter ones first."""

    def of(t: Column, n: int) -> Column:
        return _windows(F.size(t), n, lambda i: F.concat(F.lit(f"w{n}:"), F.array_join(F.slice(t, i, n), "_")))

    return let(col(toks), lambda t: F.concat(*[of(t, n) for n in range(low, high + 1)]))


def char_ngrams(toks: Column | str, low: int, high: int) -> Column:
    """``c3:^ab`` and so on over the joined words between ``^`` and ``$``; repeats are kept."""
    body = F.concat(F.lit("^"), F.array_join(col(toks), " "), F.lit("$"))

    def of(b: Column, n: int) -> Column:
        return _windows(F.length(b), n, lambda i: F.concat(F.lit(f"c{n}:"), F.substring(b, i, F.lit(n))))

    return let(body, lambda b: F.concat(*[of(b, n) for n in range(low, high + 1)]))


def extract_terms(toks: Column | str, w: tuple[int, int] = (1, 2), c: tuple[int, int] = (3, 5)) -> Column:
    """Word n-grams, then character n-grams; a text without words has none."""
    return let(col(toks), lambda t: F.when(F.size(t) > 0, F.concat(word_ngrams(t, *w), char_ngrams(t, *c))).otherwise(F.array().cast("array<string>")))


def run_lengths(items: Column) -> Column:
    """Distinct items of an array with how often each occurs, sorted: (``item``, ``n``). Counted within the row, without an exchange."""

    def count(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("item"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("bigint").alias("n"))))

    return let(F.array_sort(items), lambda s: F.when(F.size(s) > 0, count(s)).otherwise(F.array().cast("array<struct<item:string,n:bigint>>")))


def valid_feature_name(c: Column | str) -> Column:
    """Shape of a feature name: kind, size in range, payload without colon and of that size."""
    c = col(c)
    payload = F.substring(c, 4, 1 << 30)
    n = F.try_to_number(F.substring(c, 2, 1), F.lit("9")).cast("int")
    edge = r"^[\p{IsAlphabetic}\p{N}]([\p{IsAlphabetic}\p{N}']*[\p{IsAlphabetic}\p{N}])?$"
    parts = F.split(payload, "_", -1)
    word_ok = n.between(1, 3) & (F.size(parts) == n) & F.forall(parts, lambda p: p.rlike(edge))
    char_ok = n.between(2, 6) & (F.length(payload) == n) & payload.rlike(r"^[\p{IsAlphabetic}\p{N}'^$ ]+$")
    shaped = c.rlike(r"^[wc][0-9]:[^:]+$")
    return F.coalesce(shaped & F.when(F.substring(c, 1, 1) == "w", word_ok).otherwise(char_ok), F.lit(False))


def quantize(c: Column | str, scale: float = 1e12) -> Column:
    """Rounds half away from zero to 1/scale."""
    return F.round(col(c) * F.lit(scale)) / F.lit(scale)


def safe_ratio(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))

