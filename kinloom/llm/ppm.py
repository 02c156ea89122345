"""Language-model scoring: prediction by partial matching over bytes.

A text is read as its words, each followed by a space, and one end symbol. The
trie holds contexts of up to ORDER bytes with the counts of the next byte over
all training texts. A byte's probability starts at the longest context in the
trie; a byte not seen there costs an escape and is looked for one byte shorter,
where all bytes seen in the longer context are excluded; at the end all bytes
left are alike. The escape is estimated by the number of distinct bytes seen
there: each gives DISCOUNT of its count to it (method D has a half). The code
length of a text is the sum over its bytes.

Counts are gathered over all training texts by partial sums a task and one
shuffle, and all entries of the trie stay, as a written table. Costs of the
most frequent bytes in their longest context, at most `max_entries` of them,
are broadcast. What a text holds besides is counted a row, its distinct codes
get their costs by joins with the whole table, and these are joined back: how
many are broadcast changes no score. The baseline's vocabulary has no bound
either: its `head` most frequent tokens are broadcast, all others are joined.

Defined results: a null or empty text has the end token alone. A null doc_id
counts as remainder 0, so it is held out. Repeated rows are trained on and
scored as rows. With no training text all bytes are alike and base counts are
0. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER_BYTES, bounded_batches, settle

ORDER, DISCOUNT = 5, 0.25
END = "\n"  # can be in no word
CHUNK = 1 << 20
SPLIT = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def words(text: str | None) -> list[bytes]:
    return [w for w in (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).translate(SPLIT).split(b" ") if w]


def stream(ws: list[bytes]) -> bytes:
    """The bytes that the model codes, after ORDER zero bytes that stand for the start."""
    return b"\0" * ORDER + b" ".join(ws) + (b" \n" if ws else b"\n")


def codes(data: bytes, order: int = ORDER) -> np.ndarray:
    """At each byte: it and the `order` bytes before it, packed into one number."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(len(x), np.uint64)
    for k in range(order, -1, -1):
        out <<= np.uint64(8)
        if k:
            out[k:] |= x[:-k]
        else:
            out |= x
    return out


def tally(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts (or sums of weights)."""
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    sums = np.diff(np.concatenate((first, [len(values)]))) if weights is None else np.add.reduceat(weights, first) if len(first) else weights
    return values[first], sums.astype(np.int64)


def held_out(every: int = 10):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % every == 0


def partial_counts(training: DataFrame) -> DataFrame:
    """Each task's sums: (word, null, n) for tokens and (null, code, n) for bytes in context."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            return tally(np.concatenate([g for g, _ in grams]), np.concatenate([n for _, n in grams])) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def words_out():
            keys, ns = [k.decode("utf-8", "surrogatepass") for k in tokens], list(tokens.values())
            return pa.RecordBatch.from_pydict({"word": pa.array(keys, pa.string()), "code": pa.nulls(len(keys), pa.int64()), "n": pa.array(ns, pa.int64())})

        def grams_out():
            c, n = merged()
            return pa.RecordBatch.from_pydict({"word": pa.nulls(len(c), pa.string()), "code": pa.array(c.view(np.int64)), "n": pa.array(n)})

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                ws = words(text.as_py())
                tokens.update(ws)
                tokens[END.encode()] += 1
                held.append(stream(ws))
                size += len(held[-1])
                if size >= CHUNK:
                    grams.append(tally(_coded(held)))
                    held, size = [], 0
                    if len(grams) >= 12:
                        grams[:] = [merged()]
            if len(tokens) > 600_000:
                yield words_out()
                tokens.clear()
            if sum(len(g) for g, _ in grams) > 8_000_000:
                yield grams_out()
                grams.clear()
        if held:
            grams.append(tally(_coded(held)))
        yield words_out()
        yield grams_out()

    bounded_batches(training.sparkSession)
    return training.select("text").mapInArrow(count, "word string, code long, n long")


def _coded(streams: list[bytes]) -> np.ndarray:
    """Codes of all real bytes of some streams, in order."""
    every = codes(b"".join(streams))
    sizes = np.array([len(s) for s in streams])
    begin = np.cumsum(sizes) - sizes
    real = np.ones(len(every), bool)
    for k in range(ORDER):
        real[begin + k] = False
    return every[real]


def by_order(grams: DataFrame) -> DataFrame:
    """Counts of every context length: the order in the top byte, the last bytes of the code below."""
    parts = F.array(*[F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).bitwiseOR(F.lit(k << 56)) for k in range(ORDER + 1)])
    return grams.select(F.explode(parts).alias("entry"), "n").groupBy("entry").agg(F.sum("n").alias("n"))


class Costs:
    """Costs of some coded bytes. Only they are sent; each Python worker makes the table once, the driver never."""

    def __init__(self, code: np.ndarray, cost: np.ndarray):
        self.code, self.cost, self.keys = code, cost, None

    def _table(self) -> None:
        """Open addressing by multiplication."""
        code, cost = self.code, self.cost
        self.bits = max(4, int(len(code) * 2.5).bit_length())
        size = 1 << self.bits
        self.keys, self.costs = np.full(size, np.uint64((1 << 64) - 1)), np.zeros(size)
        left, at = np.arange(len(code)), self._slot(code)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[at] == np.uint64((1 << 64) - 1)
            slots, first = np.unique(at[free], return_index=True)
            who = left[free][first]
            self.keys[slots], self.costs[slots] = code[who], cost[who]
            stay = self.keys[at] != code[left]
            left, at = left[stay], (at[stay] + 1) & (size - 1)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, code: np.ndarray) -> np.ndarray:
        """The cost of each code, NaN where it is not held."""
        if self.keys is None:
            self._table()
        at = self._slot(code)
        found = self.keys[at] == code
        out = np.where(found, self.costs[at], 0.0)
        left = np.flatnonzero(~found)
        at = at[left]
        for _ in range(1, self.probes):
            go = self.keys[at] != np.uint64((1 << 64) - 1)  # an empty slot ends the search
            left_done, left, at = left[~go], left[go], (at[go] + 1) & (len(self.keys) - 1)
            if len(left_done):
                out[left_done] = np.nan
            if not len(left):
                break
            hit = self.keys[at] == code[left]
            out[left[hit]] = self.costs[at[hit]]
            left, at = left[~hit], at[~hit]
        out[left] = np.nan
        return out


class Trie:
    """The model over a few entries in memory: contexts and counts as sorted arrays by order."""

    def __init__(self, entries: np.ndarray, counts: np.ndarray):
        order = np.argsort(entries, kind="stable")
        entries, counts = entries[order], counts[order].astype(np.float64)
        top = entries >> np.int64(56)
        self.code, self.count, self.context, self.n, self.d, self.out_n = [], [], [], [], [], []
        for k in range(ORDER + 1):
            code = (entries[top == k] & np.int64((1 << 56) - 1)).astype(np.uint64)
            c = counts[top == k]
            ctx, at = np.unique(code >> np.uint64(8), return_inverse=True)
            self.code.append(code)
            self.count.append(c)
            self.context.append(ctx)
            self.n.append(np.bincount(at, c, len(ctx)))
            self.d.append(np.bincount(at, minlength=len(ctx)).astype(np.float64))
            # What a context's bytes hold in the context one byte shorter: excluded after an escape.
            out = np.zeros(len(ctx))
            if k and len(code):
                shorter = code & np.uint64((1 << 8 * k) - 1)
                i = np.searchsorted(self.code[k - 1], shorter)
                out = np.bincount(at, self.count[k - 1][i], len(ctx))
            self.out_n.append(out)
        code, c = self.code[ORDER], self.count[ORDER]
        ctx = np.searchsorted(self.context[ORDER], code >> np.uint64(8))
        self.longest = Costs(code, np.log10((c - DISCOUNT) / self.n[ORDER][ctx]) if len(code) else np.zeros(0))

    def log10(self, code: np.ndarray) -> np.ndarray:
        """Log probability of each coded byte in its context."""
        out = self.longest.get(code)
        rest = np.flatnonzero(np.isnan(out))
        if len(rest):
            values, back = np.unique(code[rest], return_inverse=True)
            out[rest] = self._escaped(values)[back]
        return out

    def _escaped(self, code: np.ndarray) -> np.ndarray:
        """The whole walk, for bytes that their longest context lacks."""
        out, done = np.zeros(len(code)), np.zeros(len(code), bool)
        out_n, out_d = np.zeros(len(code)), np.zeros(len(code))
        for k in range(ORDER, -1, -1):
            if not len(self.code[k]):
                continue
            now = code & np.uint64((1 << 8 * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(self.context[k], now >> np.uint64(8)), len(self.context[k]) - 1)
            known = ~done & (self.context[k][c] == now >> np.uint64(8))
            e = np.minimum(np.searchsorted(self.code[k], now), len(self.code[k]) - 1)
            hit = known & (self.code[k][e] == now)
            n, d = self.n[k][c] - out_n, self.d[k][c] - out_d
            out[hit] += np.log10((self.count[k][e][hit] - DISCOUNT) / n[hit])
            miss = known & ~hit
            open_ = miss & (d > 0)  # else nothing is left here: the escape is sure
            out[open_] += np.log10(DISCOUNT * d[open_] / n[open_])
            done |= hit
            out_d = np.where(miss, self.d[k][c], 0.0)
            out_n = np.where(miss, self.out_n[k][c], 0.0)
        rest = ~done
        out[rest] -= np.log10(256 - out_d[rest])
        return out


def whole_trie(counts: DataFrame) -> DataFrame:
    """All entries of all orders, written: entry, n, and its context's key, sum and number of distinct bytes.

    Keys of entries and of contexts hold the order in the top byte. A context has at most 256 entries.
    """
    low = F.col("entry").bitwiseAND(F.lit((1 << 56) - 1))
    ctx = F.col("entry").bitwiseAND(F.lit(127 << 56)).bitwiseOR(F.shiftright(low, 8))
    within = Window.partitionBy("ctx")
    each = by_order(counts.where("code is not null")).withColumn("ctx", ctx)
    return settle(each.select("entry", "n", "ctx", F.sum("n").over(within).alias("ctx_n"), F.count(F.lit(1)).over(within).alias("ctx_d")), "trie")


def longest_costs(entries: DataFrame) -> DataFrame:
    """code, n, cost: bytes seen in their longest context."""
    return entries.where(F.col("entry") >= ORDER << 56).select(F.col("entry").bitwiseAND(F.lit((1 << 56) - 1)).alias("code"), "n", F.log10((F.col("n") - DISCOUNT) / F.col("ctx_n")).alias("cost"))


def contexts(entries: DataFrame) -> DataFrame:
    """ctx, ctx_n, ctx_d and out_n: what a context's bytes hold in the context one byte shorter."""
    k = F.shiftright("entry", 56)
    shorter = F.coalesce(*[F.when(k == j, F.col("entry").bitwiseAND(F.lit((1 << 8 * j) - 1)).bitwiseOR(F.lit((j - 1) << 56))) for j in range(1, ORDER + 1)])
    own = entries.select("ctx", "ctx_n", "ctx_d", shorter.alias("shorter"))
    held = entries.select(F.col("entry").alias("shorter"), F.col("n").alias("held"))
    return own.join(held, "shorter", "left").groupBy("ctx").agg(F.first("ctx_n").alias("ctx_n"), F.first("ctx_d").alias("ctx_d"), F.coalesce(F.sum("held"), F.lit(0)).alias("out_n"))


def walked(levels: Column) -> Column:
    """The cost of a byte from its levels, the longest first; see Trie._escaped."""
    start = F.struct(F.lit(False).alias("done"), F.lit(0.0).alias("out_n"), F.lit(0.0).alias("out_d"), F.lit(0.0).alias("cost"))

    def step(s: Column, x: Column) -> Column:
        known = ~s["done"] & x["ctx_n"].isNotNull()
        hit, miss = known & x["n"].isNotNull(), known & x["n"].isNull()
        d = x["ctx_d"] - s["out_d"]
        left = x["ctx_n"] - s["out_n"]
        more = F.when(hit, F.log10((x["n"] - DISCOUNT) / left)).when(miss & (d > 0), F.log10(DISCOUNT * d / left)).otherwise(0.0)  # d is 0: the escape is sure
        zero = F.lit(0.0)
        return F.struct((s["done"] | hit).alias("done"), F.when(miss, x["out_n"]).otherwise(zero).alias("out_n"), F.when(miss, x["ctx_d"]).otherwise(zero).alias("out_d"), (s["cost"] + more).alias("cost"))

    return F.aggregate(levels, start, step, lambda s: F.when(s["done"], s["cost"]).otherwise(s["cost"] - F.log10(F.lit(256.0) - s["out_d"])))


def costs(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """code, cost for distinct codes, from the whole trie."""
    first = settle(asked.join(longest_costs(entries).select("code", "cost"), "code", "left"), "costs")
    at = []
    for k in range(ORDER + 1):
        end = F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        at.append(F.struct(F.lit(k).alias("k"), end.bitwiseOR(F.lit(k << 56)).alias("entry"), F.shiftright(end, 8).bitwiseOR(F.lit(k << 56)).alias("ctx")))
    each = first.where("cost is null").select("code", F.explode(F.array(*at)).alias("x")).select("code", "x.*")

    def looked_up(rows: DataFrame, found: DataFrame, key: str, bytes_: int) -> DataFrame:
        """Keys of at most two bytes are few and asked for by many: broadcast."""
        near, far, edge = rows.where(F.col("k") <= bytes_), rows.where(F.col("k") > bytes_), F.lit((bytes_ + 1) << 56)
        return near.join(F.broadcast(found.where(F.col(key) < edge)), key, "left").unionByName(far.join(found.where(F.col(key) >= edge), key, "left"))

    each = looked_up(each, contexts(entries), "ctx", 2)
    each = looked_up(each, entries.select("entry", "n"), "entry", 1)
    level = F.struct("k", *[F.col(c).cast("double").alias(c) for c in ("ctx_n", "ctx_d", "out_n", "n")])
    rest = each.groupBy("code").agg(F.sort_array(F.collect_list(level), asc=False).alias("levels")).select("code", walked(F.col("levels")).alias("cost"))
    return first.where("cost is not null").unionByName(rest)


def frequent_costs(entries: DataFrame, max_entries: int = 1_500_000) -> Costs:
    """Costs of the most frequent bytes in their longest context; ties at the limit are all left to the joins."""
    every = longest_costs(entries)
    sizes = every.agg(*[F.sum((F.col("n") >= (1 << k)).cast("long")).alias(str(k)) for k in range(40)]).first()
    least = next((1 << k for k in range(40) if (sizes[str(k)] or 0) <= max_entries), 1 << 40)
    table = every.where(F.col("n") >= least).select("code", "cost").toArrow()  # at most max_entries rows
    return Costs(table.column("code").to_numpy().astype(np.uint64), table.column("cost").to_numpy())


def scored(docs: DataFrame, frequent_bytes: Costs, head: tuple[list[bytes], np.ndarray]) -> DataFrame:
    """Per row: id, tokens, score of frequent bytes summed, others counted; the same of the baseline's tokens."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((frequent_bytes, head))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[bytes]]]:
        """Parts of batches with about CHUNK bytes of text."""
        for batch in batches:
            first, each, held, size = 0, [], [], 0
            for k, t in enumerate(batch.column(2)):
                each.append(words(t.as_py()))
                held.append(stream(each[-1]))
                size += len(held[-1])
                if size >= CHUNK or k + 1 == batch.num_rows:
                    yield batch.slice(first, k + 1 - first), each, held
                    first, each, held, size = k + 1, [], [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_bytes, (frequent, cost) = shared.value
        index = {w: k for k, w in enumerate(frequent)}
        for batch, each, held in pieces(batches):
            sizes = np.array([len(s) - ORDER for s in held])
            coded = _coded(held)
            found = frequent_bytes.get(coded)
            lacks = np.isnan(found)
            scores = np.add.reduceat(np.where(lacks, 0.0, found), np.cumsum(sizes) - sizes)
            # Distinct (row, code) pairs of the others.
            who, code = np.repeat(np.arange(len(held)), sizes)[lacks], coded[lacks]
            order = np.lexsort((code, who))
            who, code = who[order], code[order]
            new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (code[1:] != code[:-1])))) if len(who) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate((new, [len(who)])))
            offsets = np.searchsorted(who[new], np.arange(len(held) + 1)).astype(np.int32)
            others = pa.MapArray.from_arrays(pa.array(offsets), pa.array(code[new].astype(np.int64)), pa.array(times.astype(np.int64)))
            known, base, rare = [], [], []
            for ws in each:
                at = [index.get(w, -1) for w in ws]
                a = np.array(at, np.int64)
                hit = a >= 0
                known.append(int(hit.sum()))
                base.append(float(cost[a[hit]].sum()))
                rare.append(list(Counter(w.decode("utf-8", "surrogatepass") for w, k in zip(ws, at) if k < 0).items()) if not hit.all() else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(w) + 1 for w in each], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.array(rare, pa.map_(pa.string(), pa.int64())), others],
                ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "others"],
            )

    bounded_batches(spark)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare map<string,long>, others map<long,long>")


def score(docs: DataFrame, head_size: int = 150_000, max_entries: int = 1_500_000) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    counts = settle(partial_counts(docs.where(~held_out())), "counts")
    trie = whole_trie(counts)
    tokens = settle(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "tokens")
    total = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count(F.lit(1)).alias("V"), F.coalesce(F.max(F.when(F.col("word") == END, F.col("c"))), F.lit(0)).alias("end")).first()
    n, v, ends = total["N"], total["V"], total["end"]
    log = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    top = tokens.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(head_size).toArrow()
    head = ([w.encode("utf-8", "surrogatepass") for w in top.column("word").to_pylist()], log(top.column("c").to_numpy()))
    del top
    rows = settle(scored(docs, frequent_costs(trie, max_entries), head).withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = rows.select("row", F.explode("rare").alias("word", "times"))
    cost = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(float(n + 0.1 * (v + 1))))
    summed = rare.join(tokens, "word", "left").groupBy("row").agg(F.sum(F.col("times") * cost).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("found"))
    others = rows.select("row", F.explode("others").alias("code", "times"))
    coded = others.join(costs(others.select("code").distinct(), trie), "code").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("rest"))
    return rows.join(summed, "row", "left").join(coded, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(float(log(ends)))).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
