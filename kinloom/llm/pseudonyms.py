"""Personal data: format-preserving Feistel pseudonyms, as native expressions.

Found values are validated (Luhn, mod 97, calendar, octets, area and group
ranges) and keyed-permuted inside their own format by a Feistel network whose
round function is a keyed SHA-256. The permutation depends on the key, the
kind and the value alone, so equal values stay linked across documents, and
two values of a kind and length never meet. Separators stay where they were.

Kinds: e-mail (letters and digits of the local part), payment card (Luhn stays
right), phone in international form (country code stays) or as (555) 123-4567,
555-123-4567 and 555.123.4567 (first digit stays), IPv4, dashed / dotted /
slashed date (a valid date of the same 400 years), US social security number,
IBAN, unbroken or in groups of four (check digits stay right). What fails its
validation is left alone, so is a date of the year 0000. IPv6, dates with month
names or two-digit years, and other national phones are not looked for.

Dates keep four-digit years: a permuted date beyond 9999 is permuted again
until it is none (cycle walking), which stays one to one. Slashed dates are
read in `slash_order`, or else in the other; the latter, days 13 to 31, are
walked among themselves, so no two slashed dates meet. A one-digit and a padded
spelling are the same date and get the same one.

Defined results: a null text stays null, an empty one empty, and the count is 0
for both. Rows are independent: repeated rows get equal results. Extra columns
pass through; one named like `count` is replaced. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
#: 7 to 15 digits in all, over single spaces, dashes and brackets, or over dots.
#: In two parts: between them any_value() says what a phone must not go on into.
PHONE = (
    r"(?<![0-9A-Za-z+])\+(?:1[ -]?\(?[0-9]{3}\)?[ -]?[0-9]{3}[ -]?[0-9]{4}(?![0-9])|[1-9](?:(?:(?:",
    r"(?:[ -]?\(|\)[ -]?|[ -]))?[0-9]){6,14}|(?:\.?[0-9]){6,14})(?![0-9]|[./-][0-9]))",
)
NATIONAL = r"(?<![0-9A-Za-z+]|[0-9][.-])(?:\([2-9][0-9]{2}\)[ -]?[0-9]{3}[ .-]|[2-9][0-9]{2}-[0-9]{3}-|[2-9][0-9]{2}\.[0-9]{3}\.)[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
START, END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Not before the rest of a date or an address.
LAST = r"(?![0-9A-Za-z]|[./][0-9])"
#: Cards as they are printed, and all other digit groups of 13 to 19 digits over single spaces or dashes.
CARD = (r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}" + LAST, r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})" + END)
GROUPS = tuple(rf"[0-9](?:[ -]?[0-9]){{{n - 1}}}" + LAST for n in range(19, 12, -1))
#: IBANs in groups of four, the longest first.
IBAN_GROUPS = tuple(rf"[A-Z]{{2}}[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{g}}}{last}" + END for g in range(7, 1, -1) for last in (" [A-Z0-9]{1,3}", ""))
OTHERS = "|".join((DATE, SSN, IPV4, NATIONAL))
#: Days in 400 Gregorian years, as a product for the two halves of the network.
CYCLE, CYCLE_A, CYCLE_B = 146097, 189, 773
#: Days from 0001-01-01 to 9999-12-31, and how often a date is permuted at most: 0.42 ** 64 of late days would need more.
LAST_DAY, WALKS = 3652058, 64
P = "__pn_"


def digest(key: str, kind: str, i: Column, value: Column) -> Column:
    """60 pseudo-random bits of a value, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Permutes a pair of numbers below size_a and size_b; a struct of both."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        new = lambda: F.pmod(s["a"] + F.pmod(digest(key, kind + "a", i, s["b"]), size_a), size_a)
        return F.struct(new().alias("a"), F.pmod(s["b"] + F.pmod(digest(key, kind + "b", i, new()), size_b), size_b).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def digits_permuted(key: str, kind: str, d: Column) -> Column:
    """A digit string of 2 to 34 digits, permuted among those of its length."""
    half = F.floor(F.length(d) / 2).cast("int")
    left, right = F.substr(d, F.lit(1), half), F.substr(d, half + 1)
    ten = lambda x: F.pow(F.lit(10.0), F.length(x)).cast("long")
    out = feistel(key, kind, F.concat(F.lit("0"), left), F.concat(F.lit("0"), right), ten(left), ten(right))
    return F.concat(F.lpad(out["a"].cast("string"), half, "0"), F.lpad(out["b"].cast("string"), F.length(d) - half, "0"))


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def refill(shape: Column, chars: Column, kind: str = "[0-9]") -> Column:
    """Puts the characters of a string, in order, where `shape` has one of that kind."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(kind)
        return F.struct(F.concat(s["out"], F.when(hit, F.substr(chars, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["i"] + hit.cast("int")).alias("i"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step)["out"]


def luhn_sum(d: Column, check: bool) -> Column:
    """The Luhn sum; check: the last digit is the check digit, else it is still to come."""
    chars = F.reverse(F.filter(F.split(d, ""), lambda c: c != ""))
    worth = F.transform(chars, lambda c, i: F.when((i + (0 if check else 1)) % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x)


def mod97(iban: Column) -> Column:
    """ISO 7064 remainder of an IBAN, its first four characters moved to the end."""
    chars = F.filter(F.split(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def letters_permuted(key: str, kind: str, x: Column) -> Column:
    """Letters and digits of a string, each inside its own alphabet: halves shift each other in turn."""
    half = F.floor(F.length(x) / 2).cast("int")
    size = lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26)
    base = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).otherwise(97)

    def shifted(part: Column, other: Column, i: Column, side: str) -> Column:
        stream = lambda j: digest(key, kind + side, F.concat_ws(".", i.cast("string"), j.cast("string"), F.length(part).cast("string")), other)
        moved = F.transform(
            F.filter(F.split(part, ""), lambda c: c != ""),
            lambda c, j: F.when(c.rlike("[A-Za-z0-9]"), F.chr((base(c) + F.pmod(F.ascii(c) - base(c) + F.pmod(stream(j), F.lit(260)), size(c))).cast("long"))).otherwise(c),
        )
        return F.array_join(moved, "")

    start = F.struct(F.substr(x, F.lit(1), half).alias("a"), F.substr(x, half + 1).alias("b"))
    out = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, i: F.when(i % 2 == 1, F.struct(s["a"].alias("a"), shifted(s["b"], s["a"], i, "b").alias("b"))).otherwise(F.struct(shifted(s["a"], s["b"], i, "a").alias("a"), s["b"].alias("b"))),
    )
    return F.concat(out["a"], out["b"])


def date_permuted(key: str, day: Column, late: bool) -> Column:
    """A date of the same 400 years, of a four-digit year; late: and of a day after the 12th, as `day` is."""
    base = F.lit("0001-01-01").cast("date")

    def permuted(n: Column) -> Column:
        rest = F.pmod(n, F.lit(CYCLE))
        out = feistel(key, "date", F.floor(rest / CYCLE_B), rest % CYCLE_B, F.lit(CYCLE_A).cast("long"), F.lit(CYCLE_B).cast("long"))
        return (n - rest + out["a"] * CYCLE_B + out["b"]).cast("int")

    def fine(n: Column) -> Column:
        return (n <= LAST_DAY) & ((F.dayofmonth(F.date_add(base, n)) > 12) if late else F.lit(True))

    def walk(s: Column, _: Column) -> Column:
        new = F.struct(permuted(s["n"]).alias("n"), F.lit(True).alias("moved"))
        return F.when(s["moved"] & fine(s["n"]), s).otherwise(new)

    start = F.struct(F.datediff(day, base).alias("n"), F.lit(False).alias("moved"))
    n = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, walk)["n"]
    return F.date_add(base, F.when(fine(n), n))


def slashed(key: str, m: Column, first: str, second: str) -> Column:
    """In the first order, or else in the second: those have days after the 12th only."""
    return F.coalesce(date_out(key, m, first), date_out(key, m, second, late=True))


def date_out(key: str, m: Column, f: str, late: bool = False) -> Column:
    """A date permuted in the format f, without leading zeros where a part has one digit; null where it is none."""
    day = F.try_to_timestamp(m, F.lit(f.replace("MM", "M").replace("dd", "d"))).cast("date")
    out = F.date_format(date_permuted(key + f, F.when(F.year(day) >= 1, day), late), f)
    return F.when(m.rlike("(^|[./-])[0-9]([./-]|$)"), F.regexp_replace(out, "(^|[./-])0", "$1")).otherwise(out)


def replaced(m: Column, key: str, slash_order: str = "mdy") -> Column:
    """The pseudonym of one found value, or null where it is not valid."""
    d = only_digits(m)
    slash = ("MM/dd/yyyy", "dd/MM/yyyy") if slash_order == "mdy" else ("dd/MM/yyyy", "MM/dd/yyyy")
    full = lambda p: m.rlike("^(?:" + p + ")$")
    octets = F.transform(F.split(m, "[.]"), lambda x: x.cast("int"))
    ip = feistel(key, "ip", F.get(octets, 0) * 256 + F.get(octets, 1), F.get(octets, 2) * 256 + F.get(octets, 3), F.lit(65536).cast("long"), F.lit(65536).cast("long"))
    dotted = F.concat_ws(".", F.floor(ip["a"] / 256).cast("string"), (ip["a"] % 256).cast("string"), F.floor(ip["b"] / 256).cast("string"), (ip["b"] % 256).cast("string"))
    ip_fine = ~F.exists(octets, lambda x: x > 255) & ~m.rlike(r"(^|\.)0[0-9]")
    # Areas 001-665, 667-899; groups 01-99; serials 0001-9999.
    area, group, serial = (F.substr(d, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    ssn_fine = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    ssn = feistel(key, "ssn", (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"))
    back = F.floor(ssn["a"] / 99) + 1
    ssn_out = F.concat_ws("-", F.lpad((back + F.when(back >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((ssn["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((ssn["b"] + 1).cast("string"), 4, "0"))
    body = digits_permuted(key, "card", F.substr(d, F.lit(1), F.length(d) - 1))
    card_out = refill(m, F.concat(body, F.pmod(F.lit(10) - luhn_sum(body, False) % 10, F.lit(10)).cast("string")))
    # A country code stays: the number after it is permuted.
    code = F.regexp_extract(m, r"^\+(?:1|[2-9][0-9]{0,2}(?=[ .(-])|[2-9][0-9]?)(?:[ -]?\(0\))?", 0)
    rest = F.substr(m, F.length(code) + 1)
    phone_out = F.concat(code, refill(rest, digits_permuted(key, "phone", only_digits(rest))))
    national_out = refill(m, F.concat(F.substr(d, F.lit(1), F.lit(1)), digits_permuted(key, "phone", F.substr(d, F.lit(2)))))
    local = F.substring_index(m, "@", 1)
    iban = F.regexp_replace(m, " ", "")
    bban = letters_permuted(key, "iban", F.substr(iban, F.lit(5)))
    iban_check = F.lpad((F.lit(98) - mod97(F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lit("00"), bban))).cast("string"), 2, "0")
    iban_out = refill(m, F.concat(F.substr(m, F.lit(1), F.lit(2)), iban_check, bban), "[A-Z0-9]")
    return (
        F.when(m.contains("@"), F.concat(letters_permuted(key, "mail", local), F.substr(m, F.length(local) + 1)))
        .when(m.startswith("+"), phone_out)
        .when(full(DATE), F.coalesce(*[date_out(key, m, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy")], slashed(key, m, *slash)))
        .when(full(SSN), F.when(ssn_fine, ssn_out))
        .when(full(IPV4), F.when(ip_fine, dotted))
        .when(m.rlike("^[A-Z]{2}"), F.when(mod97(iban) == 1, iban_out))
        .when(full(NATIONAL), national_out)
        .otherwise(F.when(luhn_fine(m), card_out))
    )


def luhn_fine(m: Column) -> Column:
    return (luhn_sum(only_digits(m), True) % 10 == 0) & ~m.rlike("^[0 -]+$")


def cards(t: Column, shapes: tuple[str, ...]) -> Column:
    """What has one of these shapes from any group on, overlapping or not, and is right by Luhn."""
    every = F.concat(*[F.regexp_extract_all(t, F.lit(f"{START}(?=({x}))"), F.lit(1)) for x in shapes])
    return F.when(t.rlike("[0-9](?:[ -]?[0-9]){12}"), F.filter(F.array_distinct(every), luhn_fine)).otherwise(F.array().cast("array<string>"))


def grouped_ibans(t: Column) -> Column:
    every = F.concat(*[F.regexp_extract_all(t, F.lit(f"{START}(?=({x}))"), F.lit(1)) for x in IBAN_GROUPS])
    fine = lambda m: mod97(F.regexp_replace(m, " ", "")) == 1
    return F.when(t.rlike(START + "[A-Z]{2}[0-9]{2} [A-Z0-9]{4} "), F.filter(F.array_distinct(every), fine)).otherwise(F.array().cast("array<string>"))


def any_value(printed: Column, grouped: Column) -> Column:
    """The pattern of all kinds in one text, with the cards found there: other digits are free for what follows.

    Groups that are no printed card give way to a printed card after their first group.
    """
    one = F.concat(F.lit("(?:"), F.array_join(printed, "|"), F.lit(")" + END))
    first = F.when(F.size(printed) > 0, F.concat(F.lit("|" + START), one)).otherwise("")
    yields = F.when(F.size(printed) > 0, F.concat(F.lit("(?!(?:[0-9]+[ -]){1,9}"), one, F.lit(")"))).otherwise("")
    last = F.when(F.size(grouped) > 0, F.concat(F.lit("|" + START), yields, F.lit("(?:"), F.array_join(grouped, "|"), F.lit(")" + LAST))).otherwise("")
    stop = F.when(F.size(printed) > 0, F.concat(F.lit("(?![ -]"), one, F.lit(")"))).otherwise("")
    return F.concat(F.lit(EMAIL), first, F.lit("|" + IBAN + "|" + PHONE[0]), stop, F.lit(PHONE[1] + "|" + OTHERS), last)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None, slash_order: str = "mdy") -> DataFrame:
    """The same columns with personal values in `text` permuted; `count` names a column for how many were."""
    t = F.col(f"`{text}`")
    zero = docs.select("*", F.concat(grouped_ibans(t), cards(t, CARD)).alias(P + "printed"), cards(t, GROUPS).alias(P + "grouped"))
    zero = zero.select("*", any_value(F.col(P + "printed"), F.array_except(P + "grouped", P + "printed")).alias(P + "any"))
    one = zero.select("*", F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.col(P + "any"), F.lit(0))).alias(P + "found"))
    two = one.select("*", F.when(F.size(P + "found") > 0, F.transform(F.col(P + "found"), lambda m: replaced(m, key, slash_order))).alias(P + "new"))
    some = F.col(P + "new").isNotNull()
    gaps = F.split(t, F.col(P + "any"), -1)
    three = two.select("*", F.when(some, gaps).alias(P + "gaps"))
    found, new, gap = F.col(P + "found"), F.col(P + "new"), F.col(P + "gaps")
    pieces = F.transform(gap, lambda g, i: F.concat(g, F.coalesce(F.get(new, i), F.get(found, i), F.lit(""))))
    kept = [c for c in docs.columns if not count or c.lower() != count.lower()]
    cols = [F.when(some, F.array_join(pieces, "")).otherwise(t).alias(c) if c == text else F.col(f"`{c}`") for c in kept]
    if count:
        cols.append(F.coalesce(F.size(F.filter(new, lambda x: x.isNotNull())), F.lit(0)).cast("long").alias(count))
    return three.select(*cols)
