"""String similarities: plain definitions, and Arrow UDFs that measure whole columns at once.

Indel ratios use the bit-parallel longest common subsequence: on big integers
for one pair, on arrays of 64-bit words for a column of pairs. Pairs with a
string over 64 characters go through the plain definitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    whole = (1 << len(a)) - 1
    v = whole
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & whole
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_rests(a: str, b: str) -> tuple[int, str, str] | None:
    """Length of the joined shared tokens and what is left on either side, sorted; null if a side has no token."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return None
    return len(" ".join(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set_ratio(a: str, b: str) -> float:
    """Best of three ratios: shared tokens with either rest, and shared tokens alone against each of them."""
    rests = token_rests(a, b)
    return 0.0 if rests is None else _token_set(rests, lcs(rests[1], rests[2]))


def _token_set(rests: tuple[int, str, str], common: int) -> float:
    shared, left, right = rests
    if shared and (not left or not right):
        return 1.0
    one, two = shared + (shared > 0) + len(left), shared + (shared > 0) + len(right)
    best = 1 - (len(left) + len(right) - 2 * common) / (one + two)
    if shared:
        best = max(best, 1 - (1 + len(left)) / (shared + one), 1 - (1 + len(right)) / (shared + two))
    return best


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Best ratio of the shorter string against every window of its length, cut at the ends; of equals, both ways."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    if least and lcs(a, b) < needed(len(a), least) - 1e-9:
        return 0.0
    best = _windows(a, b)
    if len(a) == len(b):
        best = max(best, _windows(b, a))
    return best if best >= least else 0.0


def needed(size, least: float):
    """What a string of this size shares at least with one that has a window of ratio `least`."""
    return least / 2 * (1 + least / (2 - least)) * size


def _windows(a: str, b: str) -> float:
    m = len(a)
    return max(indel_ratio(a, b[max(0, s) : max(0, s) + m + min(s, 0)]) for s in range(1 - m, len(b)))


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    turned = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


#: Bits of a word, and pairs measured at a time, so that their arrays stay in a core's cache.
WORD, AT_A_TIME = 64, 1000


class Strings:
    """A column of ASCII strings of at most 64 characters as codes, padded with 0."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], np.int64)
        raw = np.array([t.encode() for t in texts], f"S{max(1, int(self.size.max(initial=0)))}")
        self.code = raw.view(np.uint8).reshape(len(texts), -1)

    def masks(self) -> np.ndarray:
        """For every string and code, at which places it stands, as bits."""
        out = np.zeros((len(self.size), 128), np.uint64)
        rows = np.arange(len(self.size))
        for k in range(self.code.shape[1]):
            out[rows, self.code[:, k]] |= np.uint64(1) << np.uint64(k)
        out[:, 0] = 0
        return out


def lcs_column(a: Strings, b: Strings) -> np.ndarray:
    """Lengths of longest common subsequences, pair by pair."""
    return _common(a, np.arange(len(a.size)), b.code)


def _common(a: Strings, rows: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The same of a's strings `rows` and rows of codes; a code of 0 is skipped."""
    masks, size = a.masks(), a.size[rows]
    whole = np.where(size > 0, ~np.uint64(0) >> (WORD - np.maximum(size, 1)).astype(np.uint64), np.uint64(0))
    v = whole.copy()
    for k in range(code.shape[1]):
        u = v & masks[rows, code[:, k]]
        v = ((v + u) | (v - u)) & whole
    return size - np.bitwise_count(v).astype(np.int64)


def jaro_winkler_column(a: Strings, b: Strings) -> np.ndarray:
    masks, rows, one = b.masks(), np.arange(len(a.size)), np.uint64(1)
    reach = np.maximum(0, np.maximum(a.size, b.size) // 2 - 1)
    of_a, of_b = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
    below = lambda n: np.where(n >= WORD, ~np.uint64(0), (one << np.clip(n, 0, WORD - 1).astype(np.uint64)) - one)
    for k in range(a.code.shape[1]):
        near = below(k + reach + 1) & ~below(np.maximum(0, k - reach))
        free = masks[rows, a.code[:, k]] & near & ~of_b
        first = free & (~free + one)
        of_b |= first
        of_a |= np.where(first > 0, one << np.uint64(k), np.uint64(0))
    m = np.bitwise_count(of_a).astype(np.int64)
    turned, x, y = np.zeros(len(rows), np.int64), of_a.copy(), of_b.copy()
    place = lambda bits: np.minimum(np.bitwise_count((bits & (~bits + one)) - one), 63).astype(np.int64)
    for _ in range(int(m.max(initial=0))):
        i, j, live = np.minimum(place(x), a.code.shape[1] - 1), np.minimum(place(y), b.code.shape[1] - 1), x > 0
        turned += live & (a.code[rows, i] != b.code[rows, j])
        x, y = x & (x - one), y & (y - one)
    m1 = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(a.size, 1) + m / np.maximum(b.size, 1) + (m - turned // 2) / m1) / 3, 0.0)
    wide = min(4, a.code.shape[1], b.code.shape[1])
    alike = np.cumprod((a.code[:, :wide] == b.code[:, :wide]) & (a.code[:, :wide] > 0), 1).sum(1)
    out = np.where(jaro > 0.7, jaro + 0.1 * alike * (1 - jaro), jaro)
    return np.where((a.size == 0) & (b.size == 0), 1.0, out)


def _ratio(a: Strings, b: Strings) -> np.ndarray:
    total = a.size + b.size
    return np.where(total > 0, 2 * lcs_column(a, b) / np.maximum(total, 1), 1.0)


def _token_set_column(a: list[str], b: list[str]) -> np.ndarray:
    rests = [token_rests(x, y) for x, y in zip(a, b)]
    common = lcs_column(*(Strings([r[k] if r else "" for r in rests]) for k in (1, 2)))
    return np.array([_token_set(r, c) if r else 0.0 for r, c in zip(rests, common.tolist())], float)


def _partial_column(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Windows are tried only where they can reach `least`: one that does shares at least this much of the shorter string."""
    short, long = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)])
    one = Strings(list(short))
    out = np.where((one.size == 0) & (np.array([len(x) for x in long]) == 0), 1.0, 0.0)
    tried = np.flatnonzero((lcs_column(one, Strings(list(long))) >= needed(one.size, least) - 1e-9) & (one.size > 0)).tolist()
    for at in range(0, len(tried), 256):
        part = [(k, short[k], long[k]) for k in tried[at : at + 256]]
        part += [(k, y, x) for k, x, y in part if len(x) == len(y)]
        best = _window_ratios([x for _, x, _ in part], [y for _, _, y in part])
        np.maximum.at(out, [k for k, _, _ in part], np.where(best >= least, best, 0.0))
    return out


def _window_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Of each pair, the best ratio of a against the windows of b."""
    one, two = Strings(a), Strings(b)
    each = []
    for k, (m, n) in enumerate(zip(one.size.tolist(), two.size.tolist())):
        padded = np.zeros(n + 2 * (m - 1), np.uint8)
        padded[m - 1 : m - 1 + n] = two.code[k, :n]
        windows = np.zeros((n + m - 1, one.code.shape[1]), np.uint8)
        windows[:, :m] = np.lib.stride_tricks.sliding_window_view(padded, m)
        each.append(windows)
    rows = np.repeat(np.arange(len(a)), [len(w) for w in each])
    code = np.concatenate(each)
    ratio = 2 * _common(one, rows, code) / (one.size[rows] + (code > 0).sum(1))
    return np.maximum.reduceat(ratio, np.flatnonzero(np.diff(rows, prepend=-1)))


def _sorted_tokens(texts: list[str]) -> Strings:
    return Strings([" ".join(sorted(t.split())) for t in texts])


PARTIAL_LEAST = 0.9
MEASURES = {"indel": indel_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": lambda a, b: partial_ratio(a, b, PARTIAL_LEAST), "jaro_winkler": jaro_winkler}
COLUMN_MEASURES = {
    "indel": lambda a, b: _ratio(Strings(a), Strings(b)),
    "token_sort": lambda a, b: _ratio(_sorted_tokens(a), _sorted_tokens(b)),
    "token_set": _token_set_column,
    "partial": lambda a, b: _partial_column(a, b, PARTIAL_LEAST),
    "jaro_winkler": lambda a, b: jaro_winkler_column(Strings(a), Strings(b)),
}


def measure_columns(left: list[str], right: list[str], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Each named measure of all pairs; equal pairs are measured once."""
    seen: dict[tuple[str, str], int] = {}
    at = np.array([seen.setdefault(p, len(seen)) for p in zip(left, right)], np.int64)
    pairs = list(seen)
    fits = np.array([len(x) <= WORD and len(y) <= WORD and x.isascii() and y.isascii() and "\0" not in x and "\0" not in y for x, y in pairs], bool)
    few = np.flatnonzero(~fits).tolist()
    out = {}
    a, b = [x for (x, _), f in zip(pairs, fits) if f], [y for (_, y), f in zip(pairs, fits) if f]
    for n in names:
        values = np.zeros(len(pairs))
        if a:
            values[fits] = np.concatenate([COLUMN_MEASURES[n](a[k : k + AT_A_TIME], b[k : k + AT_A_TIME]) for k in range(0, len(a), AT_A_TIME)])
        for k in few:
            values[k] = MEASURES[n](*pairs[k])
        out[n] = values[at]
    return out


def measured(a: Column, b: Column, *names: str) -> Column:
    """A struct of the named measures of two columns, in one pass through Python."""
    fields = ", ".join(f"{n} double" for n in names)

    @F.pandas_udf(fields)
    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(measure_columns(left.fillna("").tolist(), right.fillna("").tolist(), names), columns=list(names), dtype=float)

    return run(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 where either is empty."""
    # One element, so that the intersection is made once.
    share = F.get(F.transform(F.array(F.size(F.array_intersect(a, b))), lambda both: both / (F.size(a) + F.size(b) - both)), 0)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), share).otherwise(0.0)


def char_grams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams (n up to 3) of a text with a space at either end, as numbers: 21 bits hold a code point."""
    t = F.concat(F.lit(" "), text, F.lit(" "))
    points = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    # One element, so that the code points are made once.
    grams = F.flatten(F.transform(F.array(points), lambda ps: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ps) - n, F.lit(0))), lambda i: sum(F.get(ps, i + k) * (1 << 21 * k) for k in range(n)))))
    return F.when(F.length(t) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>"))


def token_hashes(tokens: Column) -> Column:
    """Distinct tokens as 64-bit hashes: two of one pair of records meet with a chance below 1e-17."""
    return F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))


def soundexes(tokens: Column) -> Column:
    long = F.filter(tokens, lambda t: (F.length(t) >= 4) & t.rlike("^[a-z]"))
    return F.array_distinct(F.transform(long, F.soundex))


def length_ratio(a: Column, b: Column) -> Column:
    return F.when(F.greatest(F.length(a), F.length(b)) > 0, F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def same(a: Column, b: Column) -> Column:
    return F.when((a != "") & (a == b), 1.0).otherwise(0.0)
