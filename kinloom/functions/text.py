"""Name and text normalisation as Column expressions.

Everything is native but the folding of letters beyond Latin, which one Arrow
UDF does for the rows that hold any.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import vocab as V

DOUBLED = "([bcdfghjklmnpqrstvwxz])\\1+"
ASCII = "^[\\x00-\\x7F]*$"


def in_list(c: Column, words) -> Column:
    return c.isin(*words)


def mapped(c: Column, table: dict[str, str]) -> Column:
    """A token's normal form, or the token."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, c), c)


def non_empty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def _letters(text: str) -> str:
    """ASCII for any text: accents dropped; letters of other scripts spelled by their Unicode names, an inherent vowel dropped."""
    out = []
    for ch in unicodedata.normalize("NFKD", text):
        if ch.isascii():
            out.append(ch)
            continue
        name = unicodedata.name(ch, "")
        if " LETTER " in name or " VOWEL SIGN " in name:
            said = name.split(" LETTER " if " LETTER " in name else " VOWEL SIGN ")[1].split(" WITH ")[0].split()[-1].lower()
            indic = name.startswith(("DEVANAGARI", "BENGALI", "GUJARATI", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "GURMUKHI"))
            if indic and " LETTER " in name and len(said) > 1 and said.endswith("a"):
                said = said[:-1]
            out.append(said)
        elif "ANUSVARA" in name:
            out.append("n")
        elif unicodedata.category(ch)[0] in "ZP":
            out.append(" ")
    return "".join(out)


@F.pandas_udf(T.StringType())
def _fold_other(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else _letters(unicodedata.normalize("NFKC", x)))


def _latin(text: Column) -> Column:
    out = F.translate(text, V.LATIN_FROM, V.LATIN_TO)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold_scripts(text: Column) -> Column:
    """Latin letters stay as they are; a text with any other non-ASCII letter is spelled in ASCII (the one Python step)."""
    other = ~_latin(text).rlike(ASCII)
    return F.when(other, _fold_other(F.when(other, text))).otherwise(text)


def fold(text: Column, was: Column | None = None) -> Column:
    """ASCII; where the text (or what it was before `fold_scripts`) was not, lower case with doubled letters collapsed."""
    was = text if was is None else was
    low = F.lower(_latin(text))
    for v in "aeiou":
        low = F.replace(low, F.lit(v + v), F.lit(v))
    return F.when(was.rlike(ASCII), text).otherwise(F.regexp_replace(low, DOUBLED, "$1"))


def looks_like_domain(text: Column) -> Column:
    t = F.trim(text)
    head = F.expr("true") & (F.length(t) > F.length(F.substring_index(t, ".", -1)) + 1)
    return t.contains(".") & ~t.contains(" ") & head & in_list(F.substring_index(t, ".", -1), V.TOP_LEVEL_DOMAINS)


def basic_clean(text: Column, was: Column | None = None) -> Column:
    """Tokens: folded, lower-case, & and + spelled out, dots dropped, split at all else."""
    t = F.replace(F.replace(F.lower(fold(text, was)), F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))
    t = F.when(looks_like_domain(t), F.regexp_replace(t, "\\.com\\b", " ")).otherwise(t)
    return non_empty(F.split(F.replace(t, F.lit("."), F.lit("")), "[^0-9a-z]+"))


def clean_missing(text: Column) -> Column:
    """Empty for null and for words that say that a value is missing."""
    return F.when(text.isNull() | in_list(F.lower(F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")), V.MISSING), "").otherwise(text)


def normalise_country(country: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold(F.coalesce(country, F.lit("")))), "(?U)\\s+", " "))


def name_tokens(name: Column, was: Column | None = None) -> Column:
    """A name's tokens before its legal form is told apart."""
    low = F.lower(F.trim(name))
    host = F.regexp_replace(F.regexp_replace(low, "^www\\.", ""), "\\.[^.]*$", "")
    from_domain = non_empty(F.split(host, "[^0-9a-z]+"))
    tokens = F.when(looks_like_domain(low), from_domain).otherwise(basic_clean(name, was))
    tokens = F.transform(tokens, lambda t: F.regexp_replace(mapped(t, V.NAME_ABBREVIATIONS), "^[0-9]+(?=[a-z])", ""))
    return F.filter(tokens, lambda t: (t != "") & ~in_list(t, V.MISSING))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _near_legal(tokens: pd.Series) -> pd.Series:
    from .similarity import indel_ratio

    def best(t: str) -> str | None:
        if len(t) < 4:
            return None
        r, form = max((indel_ratio(t, f), f) for f in V.LEGAL_FORMS)
        return V.LEGAL_FORMS[form] if r >= 0.85 else None

    return tokens.map(lambda ts: None if ts is None else [best(t) for t in ts])


def legal_split(tokens: Column, near: Column | None = None) -> Column:
    """Struct of core and legal tokens: a trailing phrase, or else up to three trailing forms past stop words."""
    n = F.size(tokens)
    forms = F.create_map(*[F.lit(x) for kv in V.LEGAL_FORMS.items() for x in kv])
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")

    def step(s: Column, i: Column) -> Column:
        t = F.get(tokens, i)
        canon = F.try_element_at(forms, t)
        if near is not None:
            canon = F.coalesce(canon, F.get(near, i))
        state = lambda legal, left, stop: F.struct(legal.alias("legal"), left.cast("int").alias("left"), F.lit(stop).alias("stop"))
        return (
            F.when(s["stop"] | (F.size(s["legal"]) >= 3), state(s["legal"], s["left"], True))
            .when(in_list(t, V.NAME_STOPWORDS), state(s["legal"], s["left"] - 1, False))
            .when(canon.isNotNull(), state(F.concat(F.array(canon), s["legal"]), s["left"] - 1, False))
            .otherwise(state(s["legal"], s["left"], True))
        )

    start = F.struct(strings().alias("legal"), n.cast("int").alias("left"), F.lit(False).alias("stop"))
    down = F.when(n > 0, F.sequence(n - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    peeled = F.aggregate(down, start, step)
    out = F.when(F.size(peeled["legal"]) > 0, F.struct(F.slice(tokens, F.lit(1), peeled["left"]).alias("core"), peeled["legal"].alias("legal"))).otherwise(F.struct(tokens.alias("core"), strings().alias("legal")))
    for phrase, canon in reversed(V.LEGAL_PHRASES):
        words = phrase.split()
        k = len(words)
        hit = (n > k) & (F.slice(tokens, F.greatest(n - k + 1, F.lit(1)), F.lit(k)) == strings(*words))
        out = F.when(hit, F.struct(F.slice(tokens, F.lit(1), F.greatest(n - k, F.lit(0))).alias("core"), strings(*canon.split()).alias("legal"))).otherwise(out)
    return out


def with_name(df: DataFrame, name: str, out: str = "name", scripts: bool = True) -> DataFrame:
    """Adds a struct `out` of the `core` name and the `legal` form.

    `scripts` also handles letters beyond Latin and near misses of legal forms
    in names that were not ASCII; without it the plan has no Python step.
    """
    if scripts:
        ship(df.sparkSession)
    cols, raw = [F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col(name), F.lit(""))
    one = df.select(*cols, raw.alias("__nm_raw"), (fold_scripts(raw) if scripts else raw).alias("__nm_f"))
    two = one.select(*cols, "__nm_raw", name_tokens(F.col("__nm_f"), F.col("__nm_raw")).alias("__nm_t"))
    near = _near_legal(F.when(~F.col("__nm_raw").rlike(ASCII), F.col("__nm_t"))) if scripts else F.lit(None).cast("array<string>")
    three = two.select(*cols, "__nm_raw", "__nm_t", near.alias("__nm_n"))
    four = three.select(*cols, "__nm_raw", "__nm_t", legal_split(F.col("__nm_t"), F.col("__nm_n")).alias("__nm_s"))
    core = F.when(F.size("__nm_s.core") > 0, F.col("__nm_s.core")).otherwise(F.col("__nm_t"))
    core = F.filter(core, lambda t: ~in_list(t, V.LEGAL_INFIX))
    return four.select(*cols, F.struct(F.array_join(core, " ").alias("core"), F.when(looks_like_domain(F.lower(F.trim("__nm_raw"))), "").otherwise(F.array_join("__nm_s.legal", " ")).alias("legal")).alias(out))
