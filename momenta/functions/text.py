"""Column expressions on texts and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes that stand for rare words.
UPPER, DIGIT, LOWER, MISC = "@UPPER@", "@DIGIT@", "@LOWER@", "@MISC@"


def tokenize(text: Column) -> Column:
    """Words between blanks, tabs and line ends, in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \n\t\r]+"), lambda x: x != "")


def tokens(df: DataFrame, seq_id: str, text: str) -> DataFrame:
    """(seq_id, pos, word): a row for each word, pos from 0."""
    return df.select(F.col(seq_id).alias("seq_id"), F.posexplode(tokenize(F.col(text))).alias("pos", "word"))


def split_tag(token: Column, sep: str = "_") -> Column:
    """struct(word, tag) of word_TAG; null unless there are exactly two parts."""
    parts = F.split(token, sep)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("word"), parts[1].alias("tag")))


def word_class(word: Column) -> Column:
    """The class of a word's first character: capital, then digit, then small letter, else the rest."""
    return F.when(word.rlike(r"^\p{Lu}"), UPPER).when(word.rlike(r"^\p{Nd}"), DIGIT).when(word.rlike(r"^\p{Ll}"), LOWER).otherwise(MISC)


def rare_class(word: Column, n: Column, threshold: int) -> Column:
    """word, or its class if it occurs less than threshold times."""
    return F.when(n < threshold, word_class(word)).otherwise(word)


def contains_digit(word: Column) -> Column:
    return word.rlike("[0-9]")


def contains_hyphen(word: Column) -> Column:
    return word.contains("-")


def initial_cap(word: Column) -> Column:
    return word.rlike("^[A-Z]")


def char_trigrams(word: Column, drop_last: bool = False) -> Column:
    """Runs of three characters; drop_last leaves the last one out."""
    last = F.length(word) - (3 if drop_last else 2)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(word, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def word_features(word: Column, drop_last: bool = False) -> Column:
    """Names of a word's features: its predicates and its distinct character trigrams."""
    flag = lambda c, name: F.when(c, F.lit(name))
    predicates = F.array(flag(contains_digit(word), "digit"), flag(contains_hyphen(word), "hyphen"), flag(initial_cap(word), "cap"))
    grams = F.transform(F.array_distinct(char_trigrams(word, drop_last)), lambda g: F.concat(F.lit("tri="), g))
    return F.concat(F.filter(predicates, lambda x: x.isNotNull()), grams)
