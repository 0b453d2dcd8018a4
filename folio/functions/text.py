"""Text helpers as Catalyst expressions: byte lengths, Unicode white space, words, paths.

Lengths are bytes. White space is Unicode's White_Space, written out as a class
that Java's and RE2's regular expressions read alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The White_Space characters as a regular-expression class body.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


#: The same characters as a text.
WHITE_CHARACTERS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def staged(items: Column, *stages) -> Column:
    """An array of structs with further fields, a stage at a time.

    A stage takes the struct and its place and gives new columns by name; a
    field that a stage made is computed once, however often later ones use it.
    """
    for stage in stages:
        items = F.transform(items, _adding(stage))
    return items


def _adding(stage):
    def add(x: Column, i: Column) -> Column:
        out = x
        for name, value in stage(x, i).items():
            out = out.withField(name, value)
        return out

    return add


def exploded(df: DataFrame, rest: Sequence[str | Column], values: Column, place: str, item: str) -> DataFrame:
    """``rest`` of ``df`` and a row for each item of ``values`` with its place from 0.

    The outer form is used since Spark would compute the array of a plain
    explode twice, once to drop rows with none before.
    """
    return df.select(*rest, F.posexplode_outer(values).alias(place, item)).where(F.col(place).isNotNull())


def trim_space(c: str | Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(col(c), F.lit(WHITE_CHARACTERS))


def is_blank(c: str | Column) -> Column:
    """True where nothing but white space is left; null counts as blank."""
    return ~F.coalesce(col(c).rlike(rf"[^{WHITE}]"), F.lit(False))


def fields(c: str | Column) -> Column:
    """Words between runs of white space, without empty ones."""
    return F.filter(F.split(col(c), rf"[{WHITE}]+", -1), lambda w: w != "")


def lines(c: str | Column) -> Column:
    """Lines between line feeds, trailing empty ones included."""
    return F.split(col(c), "\n", -1)


def count_of(c: str | Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    c = col(c)
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle.encode())).cast("int")


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/", -1), -1)


def extension(path: str | Column) -> Column:
    """From the last dot of the last path element on; empty without one."""
    return F.regexp_extract(col(path), r"(\.[^./]*)\z", 1)


def stem(path: str | Column) -> Column:
    """The last path element without its extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*\z", "")


def title_name(path: str | Column) -> Column:
    """The stem with underscores and hyphens as spaces, each word capitalised."""
    return F.initcap(F.translate(stem(path), "_-", "  "))


def token_estimate(c: str | Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(col(c)) / 4).cast("int")


def repaired(c: str | Column) -> Column:
    """Bytes or text as valid UTF-8, each run of invalid bytes as one U+FFFD."""
    return F.regexp_replace(F.make_valid_utf8(col(c).cast("string")), "�+", "�")


def sanitised(c: str | Column, limit: int = 60) -> Column:
    """Lower-case letters, digits and single underscores for all other runs, none at the ends; ``untitled_section`` where nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9_]+", "_"), r"\A_+|_+\z", "")
    cut = F.substring(F.regexp_replace(clean, "_{2,}", "_"), 1, limit)
    return F.when(cut == "", "untitled_section").otherwise(cut)


def template(text: str, *pairs: tuple[str, str | Column]) -> Column:
    """``{{.name}}`` replaced by values in the given order, so that a later value is never read as a template by an earlier one."""
    out: Column = F.lit(text)
    for name, value in pairs:
        out = F.replace(out, F.lit("{{." + name + "}}"), col(value))
    return out
