"""Address parsing as chained array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import vocab as V
from .text import basic_clean, fold_scripts, in_list, mapped

FIELDS = ("norm", "core", "house", "postal", "state", "city", "tail2", "landmark")
P = "__ad_"


def _by_country(country: Column, table: dict, default=()) -> Column:
    arr = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    out = None
    for k, v in table.items():
        out = F.when(country == k, arr(v)) if out is None else out.when(country == k, arr(v))
    return out.otherwise(arr(default))


def _clauses(address: Column) -> Column:
    """Per clause a struct of tokens before its first landmark marker and after it."""

    def parts(tokens: Column) -> Column:
        at = F.array_position(F.transform(tokens, lambda t: in_list(t, V.LANDMARK_MARKERS)), True).cast("int")
        n = F.size(tokens)
        geo = F.when(at == 0, tokens).otherwise(F.slice(tokens, F.lit(1), F.greatest(at - 1, F.lit(0))))
        mark = F.when((at == 0) | (at >= n), F.array().cast("array<string>")).otherwise(F.slice(tokens, F.greatest(at + 1, F.lit(1)), F.greatest(n - at, F.lit(0))))
        return F.struct(geo.alias("geo"), mark.alias("mark"))

    return F.transform(address, lambda c: parts(F.filter(basic_clean(c), lambda t: ~in_list(t, V.MISSING))))


def parse_address(df: DataFrame, address: str, country: str, out: str = "addr", scripts: bool = True) -> DataFrame:
    """Adds a struct `out` of the fields above. `country` is already normalised."""
    if scripts:
        ship(df.sparkSession)
    cols = df.columns
    raw = F.coalesce(F.col(address), F.lit(""))
    df = df.select("*", (fold_scripts(raw) if scripts else raw).alias(P + "raw"))
    a = F.col(P + "raw")
    split = _clauses(F.split(a, "[,;]|\\s-\\s"))
    whole = _clauses(F.array(a))
    one = df.select("*", split.alias(P + "c"), whole.alias(P + "w"))
    geo0 = F.flatten(F.transform(P + "c", lambda c: c["geo"]))
    one = one.select("*", F.when(F.size(geo0) > 0, geo0).otherwise(F.flatten(F.transform(P + "w", lambda c: c["geo"]))).alias(P + "e"), F.flatten(F.transform(P + "c", lambda c: c["mark"])).alias(P + "m"))
    normal = lambda t: mapped(mapped(mapped(t, V.DIRECTIONS), V.STREET_TYPES), V.ADDRESS_SYNONYMS)
    two = one.select(*cols, P + "m", F.transform(F.filter(P + "e", lambda t: ~in_list(t, V.MISSING)), normal).alias(P + "t"))
    three = two.select(*cols, F.filter(P + "t", lambda t: ~in_list(t, V.LANDMARK_WORDS)).alias(P + "g"), F.concat(P + "m", F.filter(P + "t", lambda t: in_list(t, V.LANDMARK_WORDS))).alias(P + "l"))
    g, digits = F.col(P + "g"), "^[0-9]+$"
    lengths = F.when(F.col(country).isin(*V.POSTAL_LENGTHS), F.when(F.col(country) == "india", F.array(F.lit(6))).otherwise(F.array(F.lit(5)))).otherwise(F.array(*map(F.lit, V.ANY_POSTAL_LENGTHS)))
    pos = F.filter(F.transform(g, lambda t, i: F.when(t.rlike(digits), i)), lambda i: i.isNotNull())
    four = three.select("*", pos.alias(P + "n"), lengths.alias(P + "len"), _by_country(F.col(country), V.REGIONS).alias(P + "words"), _by_country(F.col(country), V.STATE_CODES).alias(P + "codes"))
    n = F.col(P + "n")
    fits = lambda i: F.array_contains(P + "len", F.length(F.get(g, i)))
    first = F.get(F.filter(n, lambda i: (i > 0) & fits(i)), 0)
    lone = F.when((F.size(n) == 1) & fits(F.get(n, 0)), F.get(n, 0))
    plus4 = F.when((F.size(n) >= 2) & (F.get(n, 0) == 0) & (F.get(n, 1) == 1) & (F.length(F.get(g, 0)) == 5) & (F.length(F.get(g, 1)) == 4), F.lit(0))
    alpha = F.filter(F.transform(g, lambda t, i: F.when(~t.rlike(digits), i)), lambda i: i.isNotNull())
    five = four.select("*", F.coalesce(first, lone, plus4, F.lit(-1)).alias(P + "p"), alpha.alias(P + "a"))
    # The state: the last word or pair of words that names one.
    al, words, codes = F.col(P + "a"), F.col(P + "words"), F.col(P + "codes")

    def found(k: Column) -> Column:
        t = F.get(g, F.get(al, k))
        pair = F.when(k > 0, F.concat_ws(" ", F.get(g, F.get(al, k - 1)), t))
        single = F.array_contains(codes, t) | F.array_contains(words, t)
        return F.when(single, F.struct(t.alias("name"), F.array(F.get(al, k)).alias("at"))).when(F.array_contains(words, pair), F.struct(pair.alias("name"), F.array(F.get(al, k - 1), F.get(al, k)).alias("at")))

    down = F.when(F.size(al) > 0, F.sequence(F.size(al) - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    six = five.select("*", F.get(F.filter(F.transform(down, found), lambda s: s.isNotNull()), 0).alias(P + "s"))
    postal = F.when(F.col(P + "p") >= 0, F.get(g, F.col(P + "p"))).otherwise("")
    number = F.get(F.filter(n, lambda i: i != F.col(P + "p")), 0)
    bare = F.regexp_replace(F.get(g, number), "^0+", "")
    house = F.when(number.isNull(), "").otherwise(F.when(bare == "", "0").otherwise(bare))
    gone = F.coalesce(F.col(P + "s")["at"], F.array().cast("array<int>"))
    indexed = F.filter(F.transform(g, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: ~F.array_contains(gone, x["i"]) & ~x["t"].rlike(digits) & (F.length(x["t"]) >= 2))
    core = F.filter(F.transform(indexed, lambda x: x["t"]), lambda t: ~in_list(t, V.ADDRESS_STOPWORDS) & ~in_list(t, V.LANDMARK_WORDS) & ~F.array_contains(words, t) & ~F.array_contains(codes, t))
    seven = six.select("*", postal.alias(P + "postal"), house.alias(P + "house"), core.alias(P + "core0"))
    c0, hs, pc = F.col(P + "core0"), F.col(P + "house"), F.col(P + "postal")
    full = F.concat(F.when(hs != "", F.array(hs)).otherwise(F.array().cast("array<string>")), c0, F.when((pc != "") & (pc != hs), F.array(pc)).otherwise(F.array().cast("array<string>")))
    state = F.coalesce(mapped(F.col(P + "s")["name"], V.US_STATES), F.lit(""))
    some = F.size(g) > 0
    value = {
        "norm": F.array_join(g, " "),
        "core": F.array_join(full, " "),
        "house": hs,
        "postal": pc,
        "state": state,
        "city": F.coalesce(F.get(F.filter(F.reverse(c0), lambda t: F.length(t) >= 4), 0), F.lit("")),
        "tail2": F.array_join(F.slice(c0, F.greatest(F.size(c0) - 1, F.lit(1)), F.lit(2)), " "),
        "landmark": F.array_join(P + "l", " "),
    }
    return seven.select(*cols, F.struct(*[F.when(some, v).otherwise("").alias(k) for k, v in value.items()]).alias(out))
