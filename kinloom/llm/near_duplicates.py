"""MinHash near-duplicates: many universal hash minima, banding, verification, components.

1. A text's set is its distinct word shingles, as 64-bit hashes. Documents
   with equal sets form one class; a class goes on as one row.
2. `BANDS * WIDTH` universal hashes (odd multiplier and offset modulo 2**32,
   over mixed shingle hashes) give minima; a bucket is a band with equal minima.
3. Every class is paired with one centre of each of its buckets: the member
   that shares most buckets, so the plainest variant of a family. Pairs whose
   signatures agree in at least AGREEMENT are verified on the full sets;
   verified ones are links, and links give components.
4. Buckets that still hold several components are open: links between their
   members are found exactly. Two sets of similarity t share one of the first
   `n - ceil(t n) + 1` shingles in any common order (rarest first here), at
   places that their sizes bound. Pairs of different components that meet so
   are checked as in 3. Texts that merely share a passage differ in their rare
   shingles and never meet, so neither step makes all pairs of a group.
5. Components come from alternating large-star and small-star.

With 32 bands of width 4 a pair at similarity 0.8 shares no bucket with
probability 5e-8; the bound on signatures adds less than a hundredth of that.
Hot keys (buckets, classes, shingles, star hubs) are joined by broadcast of
their one row, bounded in number; no group is gathered in one task.

Defined results: null, empty and wordless texts have 0 shingles, link with
nothing and are kept. Rows of one doc_id are one document: links of any of its
texts are links of it, and all its rows with words get its component, with
n_shingles of their own text. `deduplicate` drops a document whole. A row with a null doc_id is never linked and is kept, with a
null component. An empty table gives an empty result. Extra columns pass
through `deduplicate` and are ignored by `groups`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import LOWER_TEXT, bounded_batches, drop_table, hot_size, join_groups, settle

BANDS, WIDTH = 32, 4
#: Signatures that agree in less are not verified: at similarity 0.8 that is below 1e-10 of pairs.
AGREEMENT = 0.55
BLOCK = 256
_rng = np.random.default_rng(20)
MULTIPLIERS = _rng.integers(0, 1 << 32, BANDS * WIDTH, dtype=np.uint32) | np.uint32(1)
OFFSETS = _rng.integers(0, 1 << 32, BANDS * WIDTH, dtype=np.uint32)
_words: dict[str, bytes] = {}


def words(text: str) -> list[str]:
    """Words between ASCII white space, A-Z in lower case."""
    t = text.translate(LOWER_TEXT) if not text.islower() else text
    for c in "\t\n\x0b\x0c\r":
        if c in t:
            t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of the whole sequence if it has fewer words."""
    ws = words(text or "")
    if not ws:
        return np.empty(0, np.uint64)
    cache, parts = _words, []
    for w in ws:
        h = cache.get(w)
        if h is None:
            h = xxhash.xxh3_64_digest(w.encode("utf-8", "surrogatepass"))
            if len(w) <= 32:
                if len(cache) >= 500_000:
                    cache.clear()
                cache[w] = h
        parts.append(h)
    h = np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(size, len(h))), np.uint64)
    for k in range(min(size, len(h))):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of every universal hash over a set, in blocks of shingles so that long texts need little memory."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(len(MULTIPLIERS), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 512):
        np.minimum(least, (MULTIPLIERS[:, None] * x[None, a : a + 512] + OFFSETS[:, None]).min(1), out=least)
    return least


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set) and sig (minima as bytes; null for an empty set)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, sigs = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), size)
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, "doc_id long, n_shingles long, set_key binary, sig binary")


def set_classes(sketch: DataFrame) -> DataFrame:
    """One row a distinct set: class_id, rep (its least doc_id), copies, set_key, n_shingles, sig."""
    known = sketch.where("set_key is not null and doc_id is not null")
    rows = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    # The written table holds the numbers, so all later steps see the same ones.
    return settle(rows.withColumn("class_id", F.monotonically_increasing_id()), "classes")


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, class_id): one row a band."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, WIDTH).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2]).copy()
            for k in range(WIDTH):
                key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k]
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(ids, BANDS))], ["key", "class_id"])

    return classes.select("class_id", "sig").mapInArrow(keys, "key long, class_id long")


def shared_buckets(classes: DataFrame, hot: int | None) -> tuple[DataFrame, int]:
    """(key, class_id, n) of buckets with n > 1 members, written; and from how many rows on a key is hot."""
    keys = settle(band_keys(classes), "keys")
    hot = hot or hot_size(keys.count())
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = settle(join_groups(keys, sizes, "key", hot), "buckets")
    drop_table(keys)
    return buckets, hot


def centre_pairs(buckets: DataFrame, hot: int) -> DataFrame:
    """(a, b): each member of a bucket with its centre, the member that meets most others; ties go to the least."""
    fame = buckets.groupBy("class_id").agg(F.sum("n").alias("fame"))
    centre = buckets.join(fame, "class_id").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("class_id", F.struct("fame", -F.col("class_id"))).alias("centre"))
    return join_groups(buckets.select("key", "class_id"), centre, "key", hot).where("class_id != centre").select(F.col("class_id").alias("a"), F.col("centre").alias("b")).distinct()


def bucket_members(buckets: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """class_id, rep, set_key, sig and text of all classes that share a bucket, written: whole texts are shuffled once.

    Where a rep has several texts, all of them come (see own_set).
    """
    ids = buckets.select("class_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    return settle(classes.join(ids, "class_id").select("class_id", "rep", "set_key", "sig").join(texts, "rep"), "members")


def own_set(text: str | None, size: int, set_key: bytes) -> np.ndarray | None:
    """A text's set if it is the one of the class asked for: a repeated doc_id brings other texts along."""
    s = shingle_set(text, size)
    return s if xxhash.xxh3_128_digest(s.tobytes()) == set_key else None


def verified(pairs: DataFrame, members: DataFrame, size: int, percent: int, hot: int) -> DataFrame:
    """Of the pairs of classes (a, b), those whose signatures agree and whose full sets are similar enough, as (a, b).

    The pairs of one b are dealt into blocks; its text goes to each block once.
    """
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    known = members.select("class_id", "set_key", "sig", "text")
    dealt = join_groups(pairs, counts, "b", hot).select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"))
    asked = dealt.join(known, F.col("a") == F.col("class_id")).select("b", "block", "a", "set_key", "sig", "text")
    heads = counts.join(known, F.col("b") == F.col("class_id")).select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("a"), "set_key", "sig", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted, b's own text before those of its block.
        head, own, own_sig, last, last_set = None, None, None, None, None
        for batch in batches:
            us, vs = [], []
            bs, blocks, ids, keys, sigs, text = *(batch.column(k).to_pylist() for k in range(5)), batch.column(5)
            for k, (b, block, a) in enumerate(zip(bs, blocks, ids)):
                sig = np.frombuffer(sigs[k], np.uint32)
                if a is None:
                    if last != b:
                        last, last_set = b, None
                    if last_set is None:
                        last_set = own_set(text[k].as_py(), size, keys[k])
                    if last_set is not None:
                        head, own, own_sig = (b, block), last_set, sig
                elif head == (b, block) and (sig == own_sig).mean() >= AGREEMENT:
                    s = own_set(text[k].as_py(), size, keys[k])
                    if s is not None and similar(own, s, percent):
                        us.append(a)
                        vs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["a", "b"])

    rows = heads.unionByName(asked).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())
    return rows.mapInArrow(check, "a long, b long").distinct()


def open_members(buckets: DataFrame, members: DataFrame, found: DataFrame, hot: int) -> DataFrame:
    """(class_id, component) of the members of buckets with several components."""
    of = members.select("class_id", "rep").distinct().join(found, F.col("rep") == F.col("node"), "left").select("class_id", F.coalesce("component", "rep").alias("component"))
    named = buckets.select("key", "class_id").join(of, "class_id")
    several = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x != y").select("key", "n")
    return of.join(join_groups(buckets.select("key", "class_id"), several, "key", hot).select("class_id").distinct(), "class_id")


def prefixes(opened: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(token, class_id, component, n, p): the shingles at the first places p of every set, rarest first.

    A shingle in one set only meets nothing, so it takes a place but makes no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["class_id", "component", "size", "token"]
        for batch in batches:
            held: list[tuple[int, int, np.ndarray]] = []
            ids, comps, keys, text = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for k, (i, c) in enumerate(zip(ids, comps)):
                s = own_set(text[k].as_py(), size, keys[k])
                if s is not None:
                    held.append((i, c, s))
                if held and (k + 1 == len(ids) or sum(len(x) for _, _, x in held[-64:]) > 100_000 or len(held) >= 256):
                    ns = [len(x) for _, _, x in held]
                    fixed = [np.repeat(np.array(v, np.int64), ns) for v in ([i for i, _, _ in held], [c for _, c, _ in held], ns)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, fixed), pa.array(np.concatenate([x for _, _, x in held]).view(np.int64))], names)
                    held.clear()

    rows = opened.join(members.select("class_id", "set_key", "text"), "class_id").select("class_id", "component", "set_key", "text")
    each = settle(rows.mapInArrow(run, "class_id long, component long, size long, token long"), "tokens")
    common = each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("f", F.col("n"))
    held = join_groups(each, common, "token", hot_size(each.count()))
    own = held.groupBy("class_id").agg(F.first("component").alias("component"), F.first("size").alias("n"), F.sort_array(F.collect_list(F.struct("f", "token"))).alias("held"))
    # Shingles of this set alone come before the others.
    alone = F.col("n") - F.size("held")
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    out = own.where(alone < most).select("class_id", "component", "n", alone.alias("alone"), F.posexplode(F.slice("held", F.lit(1), (most - alone).cast("int"))).alias("k", "x"))
    out = settle(out.select(F.col("x.token").alias("token"), "class_id", "component", "n", (F.col("alone") + F.col("k")).alias("p")), "prefixes")
    drop_table(each)
    return out


def met_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that share a shingle at places where similarity is possible.

    For sizes a <= b the overlap must be at least `percent * (a + b) / (100 +
    percent)`, which leaves so many places free in either set. Sizes are
    joined by classes of 2.5 %. In a shingle's group the largest component is
    joined with all others only, never with itself.
    """
    need = lambda a, b: F.ceil(percent * (a + b) / F.lit(100 + percent))
    step = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(1.025))).cast("int")
    per = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"))
    per = per.groupBy("token").agg(F.sum("m").alias("rows"), F.max_by("component", F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("several")).where("several > 1")
    each = join_groups(rows, per.select("token", "main", F.col("rows").alias("g")), "token", hot_size(rows.count()), n="g")
    each = settle(each.select("token", "class_id", "component", "n", "p", (F.col("component") != F.col("main")).alias("minor")), "met")
    small = each.where(F.col("p") <= F.col("n") - need(F.col("n"), F.col("n"))).select("token", step(F.col("n")).alias("step"), *[F.col(c).alias(f"s_{c}") for c in ("class_id", "component", "n", "p", "minor")])
    # The sizes that a partner of at most this size can have, from this place on.
    least = F.ceil(F.col("n") * percent / 100)
    most = F.least(F.col("n"), F.floor((100 + percent) * (F.col("n") - F.col("p")) / F.lit(percent)) - F.col("n"))
    large = each.withColumn("least", least).withColumn("most", most).where("least <= most")
    large = large.select("token", F.explode(F.sequence(step(F.col("least")), step(F.col("most")))).alias("step"), "least", "most", *[F.col(c).alias(f"l_{c}") for c in ("class_id", "component", "n", "p", "minor")])
    fits = (
        (F.col("s_component") != F.col("l_component"))
        & F.col("s_n").between(F.col("least"), F.col("most"))
        & ((F.col("s_n") < F.col("l_n")) | (F.col("s_class_id") < F.col("l_class_id")))
        & (F.col("s_p") <= F.col("s_n") - need(F.col("s_n"), F.col("l_n")))
    )
    keys = ["token", "step"]
    one = small.where("s_minor").join(large, keys).where(fits)
    two = small.where("not s_minor").join(large.where("l_minor"), keys).where(fits)
    return one.unionByName(two).select(F.col("s_class_id").alias("a"), F.col("l_class_id").alias("b")).distinct()


def links_of(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): links of classes as links of their representative documents."""
    rep = classes.select("class_id", "rep")
    return pairs.join(rep.withColumnsRenamed({"class_id": "a", "rep": "u"}), "a").join(rep.withColumnsRenamed({"class_id": "b", "rep": "v"}), "b").select("u", "v")


def groups(docs: DataFrame, size: int = 5, percent: int = 80, hot: int | None = None) -> DataFrame:
    """One row a row of `docs`: doc_id, n_shingles, component_id, kept. `hot`: see hot_size()."""
    sketch = settle(sketches(docs, size), "sketches")
    classes = set_classes(sketch)
    buckets, hot = shared_buckets(classes, hot)
    known = sketch.where("set_key is not null and doc_id is not null")
    several = known.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not several.isEmpty():
        docs = docs.select("doc_id", "text").dropDuplicates(["doc_id", "text"])
    members = bucket_members(buckets, classes, docs)

    pairs = settle(centre_pairs(buckets, hot), "pairs")
    links = settle(verified(pairs, members, size, percent, hot), "links")
    # One document with several texts stands in several classes.
    own = known.join(several, "doc_id").join(classes.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = settle(components(links_of(links, classes).unionByName(own)), "components")

    # Buckets of one component stay so: only the open ones can still hold a link.
    opened = settle(open_members(buckets, members, found, hot), "open")
    drop_table(pairs, links, buckets)
    if not opened.isEmpty():
        rows = prefixes(opened, members, size, percent)
        met = settle(met_pairs(rows, percent), "pairs")
        new = settle(verified(met, members, size, percent, hot), "links")
        if not new.isEmpty():
            # The stars of what is found stand for all earlier links.
            stars = found.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v"))
            found = settle(components(stars.unionByName(links_of(new, classes))), "components")
        drop_table(rows, met, new)
    drop_table(opened, members)

    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("set_key", F.col("copies").alias("n"), F.coalesce("component", "rep").alias("component_id"))
    alone = sketch.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = join_groups(known, named, "set_key", hot).select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, hot: int | None = None) -> DataFrame:
    """The documents that stay: one of each group, with their own columns."""
    gone = groups(docs, size, percent, hot).where("not kept").select(F.col("doc_id").alias("__nd_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__nd_gone"), "left_anti")
