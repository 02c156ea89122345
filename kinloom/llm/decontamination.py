"""Benchmark decontamination with suffix arrays of the corpus.

Each Arrow batch of documents is a shard. Its suffix array holds, in sorted
order, every suffix that starts with two words which stand together in the
benchmark; no other can match a window. Every test suffix (window) is found by
binary search, which gives all places where it occurs; matches that follow
each other on one diagonal join to the longest verbatim match.

The test side is dealt into blocks of about `block_words` words (an item is
never split, so one block may be as large as the largest item). The documents
pass all blocks in turn and are written between two of them, so one block is
broadcast at a time and no document row is shuffled. Places of matches are
unfolded for so many documents at a time that about `PLACES` are held.

Defined results: a null or empty text has no words and is not contaminated; a
null or empty benchmark text has no windows; rows of one item_id count as one
item, a null item_id never counts. Repeated documents are judged one by one.
An empty benchmark leaves all documents clean. Extra columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, drop_table, settle

WINDOW, PLACES = 13, 2_000_000
P = "__dc_"
#: Bytes of words: digits, a-z and all beyond ASCII; A-Z go to lower case, the rest parts words.
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
STATE = T.StructType(
    [
        T.StructField(P + "n_words", T.LongType()),
        T.StructField(P + "spans", T.ArrayType(T.LongType())),
        T.StructField(P + "items", T.ArrayType(T.StringType())),
        T.StructField(P + "longest", T.LongType()),
        T.StructField(P + "longest_at", T.LongType()),
        T.StructField(P + "longest_item", T.StringType()),
    ]
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Vocabulary(dict):
    def __missing__(self, _word: bytes) -> int:
        return 0


class TestSuffixes:
    """The windows of one block of benchmark items, sorted, with all their places."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.vocabulary = window, Vocabulary()
        texts: dict[str, list[list[bytes]]] = defaultdict(list)
        for item, text in items:
            if (ws := words(text)) and ws not in texts[item]:
                texts[item].append(ws)
        flat, keys, lengths, places, owners, names = [], [], [], [], [], []
        for item in sorted(texts):
            for ws in texts[item]:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]
                n = min(window, len(ids))
                for o in range(len(ids) - n + 1):
                    row = ids[o : o + n] + [0] * (window - n)
                    keys.append(np.array(row, ">u4").tobytes())
                    lengths.append(n)
                    places.append(len(flat) + o)
                    owners.append(len(names))
                flat += [*ids, 0]
                names.append((item, len(flat) - len(ids) - 1))
        self.empty = not keys
        if self.empty:
            return
        key = np.frombuffer(b"".join(keys), f"S{4 * window}")
        order = np.lexsort((np.array(lengths), key))
        key, lengths = key[order], np.array(lengths)[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (lengths[1:] != lengths[:-1])))
        self.key, self.length = key[new], lengths[new]
        # Past the last suffix that starts with the window: its words, then the highest bytes.
        raw = np.frombuffer(self.key.astype(f"S{4 * window}").tobytes(), np.uint8).reshape(-1, 4 * window).copy()
        raw[np.arange(4 * window)[None, :] >= 4 * self.length[:, None]] = 255
        self.past = np.frombuffer(raw.tobytes(), f"S{4 * window}")
        self.first = np.concatenate((np.flatnonzero(new), [len(new)]))
        self.place, self.owner, self.names = np.array(places)[order], np.array(owners)[order], names
        self.short = int(self.length.min())
        ids = np.array(flat, np.int64)
        self.singles = np.zeros(len(self.vocabulary) + 1, bool)
        self.singles[1:] = True
        pairs = np.unique((ids[:-1] << 32 | ids[1:])[(ids[:-1] > 0) & (ids[1:] > 0)])
        self.pairs = pairs

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of all occurrences in a shard's word ids; 0 is a foreign word or a text's end."""
        x = np.concatenate((ids, np.zeros(self.window, ids.dtype)))
        if self.short >= 2:
            both = (x[: len(ids)] > 0) & (x[1 : len(ids) + 1] > 0)
            for k in range(2, min(self.short, 4)):
                both &= x[k : len(ids) + k] > 0
            start = np.flatnonzero(both)
            pair = x[start].astype(np.int64) << 32 | x[start + 1]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            start = start[self.pairs[at] == pair]
        else:
            start = np.flatnonzero(ids > 0)
        suffix = np.frombuffer(x[start[:, None] + np.arange(self.window)].astype(">u4").tobytes(), f"S{4 * self.window}")
        order = np.argsort(suffix, kind="stable")
        suffix, start = suffix[order], start[order]
        a, b = np.searchsorted(suffix, self.key), np.searchsorted(suffix, self.past, "right")
        n = b - a
        window = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        return window, start[at]


def _merge(old: list[int], starts: np.ndarray, stops: np.ndarray) -> list[int]:
    spans = sorted([*zip(old[::2], old[1::2]), *zip(starts.tolist(), stops.tolist())])
    out: list[int] = []
    for a, b in spans:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def scan(texts: list[str | None], state: list[dict], suffixes: TestSuffixes) -> None:
    """Adds what one block of windows finds in a shard to its documents' states."""
    each = [words(t) for t in texts]
    sizes = np.array([len(w) for w in each])
    for s, n in zip(state, sizes.tolist()):
        s["n_words"] = n
    if suffixes.empty or not sizes.sum():
        return
    get = suffixes.vocabulary.__getitem__
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    ids = np.zeros(begin[-1], np.int64)
    for k, ws in enumerate(each):
        ids[begin[k] : begin[k] + len(ws)] = np.fromiter(map(get, ws), np.int64, len(ws))
    window, at = suffixes.matches(ids)
    if not len(window):
        return
    doc = np.searchsorted(begin, at, "right") - 1
    length = suffixes.length[window]
    order = np.lexsort((at, doc))
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    for part in np.split(order, cuts):
        k = int(doc[part[0]])
        s = state[k]
        s["spans"] = _merge(s["spans"], at[part] - begin[k], at[part] - begin[k] + length[part])
    order = np.argsort(doc, kind="stable")
    window, at, doc, length = window[order], at[order], doc[order], length[order]
    # Slices of whole documents with about PLACES places each.
    held = np.cumsum(suffixes.first[window + 1] - suffixes.first[window])
    ends = np.flatnonzero(np.concatenate((doc[1:] != doc[:-1], [True]))) + 1
    a = 0
    while a < len(doc):
        before = held[a - 1] if a else 0
        k = int(np.searchsorted(held[ends - 1], before + PLACES, "right"))
        b = int(max(ends[max(k - 1, 0)], ends[np.searchsorted(ends, a, "right")]))
        _places(suffixes, state, begin, window[a:b], at[a:b], doc[a:b], length[a:b])
        a = b


def _places(suffixes: TestSuffixes, state: list[dict], begin: np.ndarray, window: np.ndarray, at: np.ndarray, doc: np.ndarray, length: np.ndarray) -> None:
    """Who owns each window found, and the diagonals on which matches follow each other."""
    first, last = suffixes.first[window], suffixes.first[window + 1]
    n = last - first
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    docs, pos, place, owner, size = np.repeat(doc, n), np.repeat(at, n), suffixes.place[j], suffixes.owner[j], np.repeat(length, n)
    for key in np.unique(docs.astype(np.int64) << 32 | owner).tolist():
        item = suffixes.names[key & 0xFFFFFFFF][0]
        state[key >> 32]["items"].add(item)
    order = np.lexsort((pos, pos - place))
    p, diagonal, size, docs, owner = pos[order], (pos - place)[order], size[order], docs[order], owner[order]
    new = np.concatenate(([True], (diagonal[1:] != diagonal[:-1]) | (p[1:] != p[:-1] + 1)))
    run = np.flatnonzero(new)
    long = np.diff(np.concatenate((run, [len(p)]))) + size[run] - 1
    for r, n_ in zip(run[np.argsort(-long, kind="stable")].tolist(), np.sort(-long).tolist()):
        s = state[int(docs[r])]
        if -n_ > s["longest"]:
            s["longest"], s["longest_at"], s["longest_item"] = -n_, int(p[r] - begin[docs[r]]), suffixes.names[owner[r]][0]


def blocks_of(benchmark: DataFrame, block_words: int) -> list[list[tuple[str, str | None]]]:
    """The benchmark in blocks; an item never spans two of them."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (6 * block_words)))
    part = F.pmod(F.xxhash64("item"), F.lit(n))
    # One block at a time comes to the driver.
    return ([tuple(r) for r in rows.where(part == k).orderBy("item", "text").collect()] for k in range(n))


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 2_000_000, text: str = "text") -> DataFrame:
    """The documents with what was found in each, under a private prefix."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs
    names = [f.name for f in STATE]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
    where = docs.columns.index(text)
    test = earlier = None
    for k, items in enumerate(blocks_of(benchmark, block_words)):
        if test is not None:
            # What the blocks so far found is written, so that only one is held at a time.
            out = settle(out, "decontamination")
            test.unpersist()
            if earlier is not None:
                drop_table(earlier)
            earlier = out
        test = spark.sparkContext.broadcast(TestSuffixes(items, window))

        def search(batches: Iterator[pa.RecordBatch], test=test, later=bool(k)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.columns[: batch.num_columns - (len(names) if later else 0)]
                if later:
                    old = batch.columns[-len(names) :]
                    state = [{"n_words": 0, "spans": s or [], "items": set(i or []), "longest": m, "longest_at": a, "longest_item": o} for s, i, m, a, o in zip(*(c.to_pylist() for c in old[1:]))]
                else:
                    state = [{"n_words": 0, "spans": [], "items": set(), "longest": 0, "longest_at": None, "longest_item": None} for _ in range(batch.num_rows)]
                scan(batch.column(where).to_pylist(), state, test.value)
                cols = [[sorted(s[n.removeprefix(P)]) if n == P + "items" else s[n.removeprefix(P)] for s in state] for n in names]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(cols, types))], [*batch.schema.names[: len(own)], *names])

        out = out.mapInArrow(search, T.StructType([*docs.schema.fields, *STATE.fields]))
    return out


def n_hit():
    """Words inside any match, from the merged spans."""
    return F.aggregate(F.transform(F.col(P + "spans"), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated():
    """By the share of words hit: a twentieth or more."""
    return (n_hit() > 0) & (F.lit(20) * n_hit() >= F.col(P + "n_words"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row a row of `docs`: what the contract names, then the longest verbatim match: words, first word in the text, item."""
    found = annotate(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id",
        F.col(P + "n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size(P + "items").cast("long").alias("n_items"),
        F.sha2(F.array_join(P + "items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        F.col(P + "longest").alias("longest"),
        F.col(P + "longest_at").alias("longest_at"),
        F.col(P + "longest_item").alias("longest_item"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return annotate(docs, benchmark, **options).where(~contaminated()).select(*[F.col(f"`{c}`") for c in docs.columns])
