"""Scalar functions on text and vectors, as Column expressions; a pandas UDF only for Unicode decomposition."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Function words left out of term weights.
STOP_WORDS = "a about after all also an and any are as at be been before between both but by can could did do does during each few for from further had has have he her here how if in into is it its may more most no nor not of on only or other our out over same she should so some such than that the their then there these they this those through to under until up was we were what when where which while who with would you your".split()
WORD = r"[\p{L}\p{N}_]{2,}"
SPACE = r"[\s\p{Z}]+"


def squeeze(text: Column) -> Column:
    """Any run of white space as one blank, none at the ends; null stays null."""
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


@F.pandas_udf(StringType())
def decompose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKD", t) if t is not None and not t.isascii() else t)


def clean_for_match(text: Column) -> Column:
    """Compatibility decomposition, lower case, every other sign than letters, digits and _ a blank; null is ''.

    A decomposed accent is such a sign: words are split at accents.
    """
    return squeeze(F.regexp_replace(F.lower(decompose(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}_\s\p{Z}]", " "))


def year_of(text: Column) -> Column:
    """First 19xx or 20xx anywhere, else a number from 1900 to 2100, else null."""
    found = F.regexp_extract(text, r"((?:19|20)[0-9]{2})", 1)
    number = text.try_cast("double")
    return F.when(found != "", found.cast("int")).when((number >= 1900) & (number <= 2100), F.floor(number).cast("int"))


def cut(text: Column, n: int) -> Column:
    """White space squeezed, cut to ``n`` characters and '...' if longer; null is ''."""
    t = squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def words(text: Column) -> Column:
    """Runs of two or more letters, digits or _ in lower case, without stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~F.array_contains(stop, w))


#: Latin letters with accents and the letters beneath them.
ACCENTED, BARE = "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöōőŕřśšşťùúûüūůűýÿźżž", "aaaaaaaaacccdeeeeeeeeiiiiiinnnooooooorrssstuuuuuuuyyzzz"


def bare(text: Column) -> Column:
    """Lower case without the accents of Latin letters; null is ''."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, BARE)


def simple_words(text: Column) -> Column:
    """Runs of three or more letters and hyphens that begin with a letter, without accents."""
    return F.regexp_extract_all(bare(text), F.lit(r"[a-z][a-z\-]{2,}"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(tokens, i, n)))).otherwise(F.array().cast("array<string>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """``v`` over its length, or over 1e-12 if it is shorter than that."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def human_bytes(n: Column) -> Column:
    out = F.concat(F.format_number(n / 1024**4, 2), F.lit(" TB"))
    for k, name in ((3, " GB"), (2, " MB"), (1, " KB"), (0, " B")):
        out = F.when(n < 1024 ** (k + 1), F.concat(F.format_number(n / 1024**k, 2), F.lit(name))).otherwise(out)
    return out


def word_limit(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(squeeze(text), " "), 1, n), " ")


def percent(share: Column, digits: int = 2) -> Column:
    """A share as '12.34%'; null stays null."""
    return F.when(share.isNotNull(), F.format_string(f"%.{digits}f%%", share.cast("double") * 100))
