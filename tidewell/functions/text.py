"""Text as Column expressions: two tokenisers, paragraphs, and what a query says about itself.

Tokens for term statistics keep their punctuation; tokens for overlap lose it. A null text counts as empty.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as white space, for Java's regular expressions.
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same characters, and those of them that aren't a space: a letter is told at the first look, and a single space is no match for ``_RUN``.
_ANY = WS.replace(r"[\s", r"[[^!-~]&&[ \t-\r") + "]"
_OTHER = WS.replace(r"[\s", r"[[^ -~]&&[\t-\r") + "]"
_RUN = f"(?:{_OTHER}| {_ANY}){_ANY}*"
#: Fixed value: ASCII punctuation.
PUNCTUATION = string.punctuation


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), f"^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(c), _RUN, " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(text_or_empty(c), f"{WS}+"), lambda t: t != "")


def first_tokens(c: Column, n: int) -> Column:
    """The first ``n`` tokens; the rest isn't looked at."""
    token = f"[^{WS[1:]}+"
    return tokens(F.regexp_extract(text_or_empty(c), f"^{WS}*({token}(?:{WS}+{token}){{0,{n - 1}}})", 1))


def has_word(c: Column) -> Column:
    """Whether there is any token."""
    return F.regexp(text_or_empty(c), F.lit(f"[^{WS[1:]}"))


def lower_tokens(c: Column) -> Column:
    return tokens(F.lower(c))


def join_tokens(c: Column) -> Column:
    return F.array_join(F.filter(c, lambda t: t != ""), " ")


def lower_squeeze(c: Column) -> Column:
    return squeeze(F.lower(c))


def match_tokens(c: Column) -> Column:
    """Lower-case tokens without ASCII punctuation."""
    return F.filter(F.transform(lower_tokens(c), lambda t: F.translate(t, PUNCTUATION, "")), lambda t: t != "")


def paragraphs(c: Column) -> Column:
    """Squeezed paragraphs, which blank lines part."""
    unix = F.replace(F.replace(text_or_empty(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.filter(F.transform(F.split(unix, rf"\n{WS}*\n+"), squeeze), lambda p: p != "")


def quoted_phrases(c: Column) -> Column:
    found = F.regexp_extract_all(text_or_empty(c), F.lit('"([^"]+)"'), F.lit(1))
    return F.filter(F.transform(found, lambda p: F.lower(strip(p))), lambda p: p != "")


def has_code(c: Column) -> Column:
    """Whether any of the tokens looks like code: path or call characters, letters with digits, mixed case.

    Fixed values: the three patterns.
    """
    marked = lambda t: F.regexp(t, F.lit(r"[_/\\.()\[\]]|::"))
    numbered = lambda t: F.contains(t, F.lit("-")) & F.regexp(t, F.lit(r"\p{L}")) & F.regexp(t, F.lit(r"\p{Nd}"))
    mixed = lambda t: F.regexp(t, F.lit(r"[a-z][A-Z]|[A-Z][a-z].*\d|\d.*[A-Za-z]"))
    return F.exists(c, lambda t: marked(t) | numbered(t) | mixed(t))


def with_digits(c: Column) -> Column:
    return F.filter(c, lambda t: F.regexp(t, F.lit(r"\p{Nd}")))


def titled(title: Column, body: Column) -> Column:
    """Title, a blank line and body; only one of them if the other is empty."""
    title, body = text_or_empty(title), text_or_empty(body)
    return F.when((title != "") & (body != ""), F.concat(title, F.lit("\n\n"), body)).otherwise(F.concat(title, body))


def page_text(title: Column, content: Column) -> Column:
    """A page as one text: title, a blank line and content, without white space at the ends."""
    title, content = text_or_empty(title), text_or_empty(content)
    return strip(F.when(title != "", F.concat(title, F.lit("\n\n"), content)).otherwise(content))


def page_number_or_null(c: Column) -> Column:
    """A page id from a number or a string of digits, white space around it aside; null for anything else."""
    text = strip(c.cast("string"))
    return F.when(F.regexp(text, F.lit(r"^\d+$")), text.try_cast("bigint"))


def page_number(c: Column) -> Column:
    """A page id from a number or a string of digits; raises on anything else."""
    text = c.cast("string")
    return F.coalesce(page_number_or_null(c), F.raise_error(F.concat(F.lit("not a page id: "), F.coalesce(text, F.lit("null")))).cast("bigint"))
