"""Corpus operators against brute force, on small fixtures with nulls, ties, repeats and odd columns."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

LONG = " ".join(f"w{i % 700}" for i in range(9000))
WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"t{rng.randint(0, vocabulary)}" for _ in range(n))


def fixture_rows():
    base = [prose(i, 60 + i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, None), (21, ""), (22, " \t\n "), (23, LONG), (24, base[3]), (25, base[3] + " more"), (26, base[4].replace("t1 ", "t2 ", 1)), (27, "Mail a.b1@mail.example.com or 4111 1111 1111 1111 on 2024-02-29."), (5, base[5])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0, "extra") for i, t in fixture_rows()], "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(3)


def empty(spark, like):
    return spark.createDataFrame([], like.schema)


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_quality_statistics_and_list(spark, docs):
    from kinloom.llm import quality_rules as Q

    rows = fixture_rows() + [(40, "a b c a b c a"), (41, "x\nx\n\nx y\n#$"), (42, "a a a a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(set)
    for r in Q.judge(df, []).collect():
        got[r.doc_id].add((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept))
    for i, t in rows:
        w = WORD.findall(t or "")
        g = Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        bad = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        assert (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), bad, not bad) in got[i], i
    assert Q.judge(empty(spark, docs), []).count() == 0
    assert Q.filter_documents(docs, []).columns == docs.columns
    noisy = [(100 + i, prose(i, 80).replace(" ", "# ")) for i in range(60)] + [(300 + i, prose(i + 99, 80)) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 300)) for i, _ in noisy] + [(9999, 1), (None, 0), (100, None)], "doc_id long, quality int")
    ndf = spark.createDataFrame(noisy, "doc_id long, text string")
    rules = Q.fit(ndf, labels)
    assert rules and {r.doc_id for r in Q.judge(ndf, rules).where("kept").collect()} == {i for i, _ in noisy if i >= 300}


def test_quality_rules_name_rare_kinds(spark):
    from kinloom.llm import quality_rules as Q

    def kept(kinds):
        rows = [(1000 * k + i, text(i), good) for k, (n, good, text) in enumerate(kinds) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
        rules = Q.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
        return Counter(r.doc_id // 1000 for r in Q.judge(df, rules).where("kept").collect())

    plain = lambda i: prose(i, 80)
    # One in ten of the bad labels has symbols, which are 0 in all others.
    assert kept([(100, 1, plain), (90, 0, lambda i: prose(i + 500, 80).upper()), (10, 0, lambda i: prose(i + 700, 80).replace(" ", "# "))]) == {0: 100}
    # Equal texts with both labels are no rule, and do not end the list: the kind after them is named.
    same = prose(1, 80).replace(" ", "# ")
    assert kept([(100, 1, plain), (60, 0, lambda i: same), (12, 1, lambda i: same), (8, 0, lambda i: prose(i + 700, 80).replace(" ", "! "))]) == {0: 100, 1: 60, 2: 12}


def test_decontamination(spark, docs):
    from kinloom.llm import decontamination as D

    t = dict(fixture_rows())
    items = [(1, " ".join(t[3].split()[5:30]).upper()), (2, "zz yy"), (3, None), (4, ""), (5, "t1 t2"), (1, " ".join(t[7].split()[:14])), (None, t[2])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    windows = defaultdict(set)
    for i, x in items:
        w = find(low(x))
        n = min(13, len(w))
        for o in range(len(w) - n + 1 if w and i is not None else 0):
            windows[tuple(w[o : o + n])].add(str(i))
    texts = {str(i): [] for i, _ in items}
    for i, x in items:
        if i is not None:
            texts[str(i)].append(find(low(x)))

    def longest(w):
        """The most words in a row that a text shares with an item, in whole windows."""
        best = 0
        for own in (t for ts in texts.values() for t in ts if t):
            n = min(13, len(own))
            for a in range(len(w)):
                for b in range(len(own)):
                    k = 0
                    while a + k < len(w) and b + k < len(own) and w[a + k] == own[b + k]:
                        k += 1
                    best = max(best, k if k >= n else 0)
        return best

    for block_words, places in ((2_000_000, D.PLACES), (8, 3)):  # one block, and several with few places at a time
        D.PLACES = places
        found = {r.doc_id: r for r in D.report(docs, bench, block_words=block_words).collect()}
        got = {i: tuple(r)[1:6] for i, r in found.items()}
        for i, x in fixture_rows():
            w = find(low(x))
            if i != 23:
                assert (found[i].longest, found[i].longest_at is None) == (longest(w), longest(w) == 0), i
            if found[i].longest:
                run = w[found[i].longest_at :][: found[i].longest]
                assert any(own[k : k + len(run)] == run for own in texts[found[i].longest_item] for k in range(len(own))), i
        for i, x in fixture_rows():
            w = find(low(x))
            hit, found = set(), set()
            for n in {len(k) for k in windows}:
                for k in range(len(w) - n + 1):
                    if own := windows.get(tuple(w[k : k + n])):
                        hit.update(range(k, k + n))
                        found |= own
            assert got[i] == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)), i
    assert D.report(docs, empty(spark, bench)).where("contaminated").count() == 0
    assert D.report(empty(spark, docs), bench).count() == 0
    out = D.remove(docs, bench)
    assert out.columns == docs.columns and {3, 24} & {r.doc_id for r in out.collect()} == set()


def test_html(spark):
    from kinloom.llm import html_text as H

    page = """<html><head><title>x</title></head><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="ad">Buy now and save</div>
    <article><h1>T</h1><p>One &eacute;\n two <b>bo</b>ld.<br><p>Short.</p><script>"</p>"</script><form><p>no</p></form><div class="comments"><p>I agree fully</p></div></article>
    <aside>side bar</aside><footer>&copy; me</footer></body>"""
    assert H.extract(page) == "T One é two bold. Short."
    assert H.extract(page[: page.index("Short") + 3]).endswith("Sho")
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page)], "page_id long, url string, html string")
    got = [tuple(r) for r in H.extract_pages(df).orderBy("page_id").collect()]
    assert got[0] == got[1] == (1, "u", "T One é two bold. Short.", 24) and got[2] == (2, None, "", 0) and got[3] == (3, "v", "", 0)


class PlainReader(HTMLParser):
    """A second, plainer implementation: the library's parser, and a walk to the root for every block."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.path, self.text, self.linked, self.out, self.silent, self.link = [], "", "", [], 0, False

    def flush(self):
        from kinloom.llm import html_text as H

        text = " ".join(html.unescape(self.text).split())
        if text:
            inside = next((m for name, a in reversed(self.path) if (m := H.marks(name, a))), 0)
            n = len(text.split(" "))
            self.out.append((text, n, len(html.unescape(self.linked).split()) / n, inside))
        self.text = self.linked = ""

    def handle_starttag(self, name, attrs):
        from kinloom.llm import html_text as H

        if self.silent or name in H.SILENT:
            self.silent += name in H.SILENT
            if self.silent == 1 and name in H.SILENT:
                self.flush()
        elif name == "a":
            self.link = True
        elif name not in H.INLINE:
            self.flush()
            if name in H.SAME and self.path and self.path[-1][0] == name:
                self.path.pop()
            if name not in H.VOID:
                self.path.append((name, self.get_starttag_text()[1 + len(name) : -1]))

    def handle_endtag(self, name):
        from kinloom.llm import html_text as H

        if name in H.SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.silent:
            pass
        elif name == "a":
            self.link = False
        elif name not in H.INLINE:
            self.flush()
            names = [n for n, _ in self.path]
            if name in names:
                del self.path[len(names) - 1 - names[::-1].index(name) :]

    def handle_data(self, data):
        if not self.silent:
            self.text += data
            if self.link:
                self.linked += data + " "

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def plain_extract(page):
    """Verdicts by a walk over the tree with features made one by one."""
    from kinloom.llm import html_text as H

    reader = PlainReader()
    reader.feed(page)
    reader.flush()
    found, kept = reader.out, []
    for k, (text, n, density, inside) in enumerate(found):
        at = lambda j: found[j][1:3] if 0 <= j < len(found) else (0, 0.0)
        row = (n, density, *at(k - 1), *at(k + 1), *at(k - 2), *at(k + 2), inside)
        node = H.tree()
        while node.feature >= 0:
            node = node.high if row[node.feature] >= node.cut else node.low
        kept += [text] if node.share >= 0.5 else []
    return " ".join(kept)


def random_page(seed):
    rng = random.Random(seed)
    some = lambda a, b: prose(rng.random(), rng.randint(a, b))
    links = lambda n: "".join(f"<li><a href='/{i}'>{some(1, 3)}</a></li>" for i in range(n))
    body = [f"<h1>{some(3, 12)}</h1>"]
    for _ in range(rng.randint(1, 9)):
        body.append(rng.choice([f"<p>{some(1, 90)} <b>{some(1, 3)}</b> &amp; &#233; {some(1, 9)}</p>", f"<p>{some(1, 5)}", f"<ul>{links(4)}</ul>", f"<script>var x='<p>{some(2, 4)}</p>'</script>", f"<form><p>{some(2, 9)}</p><input></form>", f"<p title=\"a > b\">see <a href=x>{some(1, 4)}</a> {some(5, 40)}</p>", f"<!-- {some(2, 5)} -->", "<hr>"]))
    return f"<html><head><title>{some(2, 5)}</title></head><body><nav><ul>{links(5)}</ul></nav><div class='{rng.choice(['ad', 'cookie-notice', 'x'])}'>{some(4, 20)}</div><article>{''.join(body)}</article>" + rng.choice([f"<div id=comments><p>{some(5, 60)}</p><p>{some(5, 60)}</p></div>", f"<aside>{some(4, 30)}</aside>", ""]) + f"<footer>&copy; {some(3, 20)}</footer></body></html>"


def test_html_against_a_plain_implementation():
    from kinloom.llm import html_text as H

    pages = [random_page(k) for k in range(200)]
    assert [H.extract(p) for p in pages] == [plain_extract(p) for p in pages]
    # Both kinds of leaves are there, and numbers alone already settle much.
    assert sum(H.extract(p, by_marks=False) == H.extract(p) for p in pages) > 20


def test_html_takes_time_in_proportion_to_the_page():
    import time

    from kinloom.llm import html_text as H

    for page in ("<p>x</p>" + "<b " * 300_000 + "'", "<div>" * 100_000 + "</zz>" * 100_000, "<p a='" * 150_000, "<!--" * 200_000, "<script>" * 100_000, "<" * 900_000, "<p title=\"'" * 80_000, "<article>" + f"<p>{LONG}</p>" * 20 + "</article>"):
        t = time.process_time()
        H.extract(page)
        assert time.process_time() - t < 5, page[:20]


def test_html_edge_tables(spark):
    from kinloom.llm import html_text as H

    df = spark.createDataFrame([(None, None, None, "x", 1)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in H.extract_pages(df).collect()] == [(None, None, "", 0)]
    assert H.extract_pages(df.where("false")).columns == ["page_id", "url", "text", "n_chars"] and H.extract_pages(df.where("false")).count() == 0


def test_ppm(spark, docs):
    from kinloom.llm import ppm as M

    trie = M.Trie(*_entries(["the cat sat on the mat", "the dog"]))
    for context in (b"\0\0\0\0\0", b"e the", b" cat ", b"zzzzz"):
        codes = M.codes(b"".join(context + bytes([b]) for b in range(256)))[5::6]
        assert (10 ** trie.log10(codes)).sum() == pytest.approx(1)
    got = {r.doc_id: r for r in M.score(docs, head_size=50).collect()}
    train = [(i, t) for i, t in fixture_rows() if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for _, t in train for w in [*WORD.findall(low(t)), "\n"])
    n, v = sum(c.values()), len(c)
    for i, t in fixture_rows():
        w = [*WORD.findall(low(t)), "\n"]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) and r.score < 0
    assert M.score(empty(spark, docs)).count() == 0


def test_ppm_scores_do_not_depend_on_what_is_broadcast(spark):
    from kinloom.llm import ppm as M

    rows = [(k, prose(k, 60, 40 + k) + f" once{k}x seen only here {'é' * (k % 3)}") for k in range(80)] + [(80, None), (81, ""), (None, "caf\u00e9 zq!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    trie = M.Trie(*_entries([t for i, t in rows if not held(i)]))
    want = {i: trie.log10(M._coded([M.stream(M.words(t))])).sum() for i, t in rows}
    for most in (0, 30, 1_500_000):
        got = {r.doc_id: r.score for r in M.score(docs, max_entries=most).collect()}
        assert got == pytest.approx(want), most


def plain_ppm(training):
    """A second, plain implementation: counts in dictionaries, byte by byte; gives a text's log10 probability."""
    from kinloom.llm import ppm as M

    counts = defaultdict(Counter)
    coded = lambda t: b"\0" * M.ORDER + b"".join(w + b" " for w in low(t).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).encode().split(b" ") if w) + b"\n"
    for t in training:
        data = coded(t)
        for at in range(M.ORDER, len(data)):
            for k in range(M.ORDER + 1):
                counts[data[at - k : at]][data[at]] += 1

    def score(t):
        data, total = coded(t), 0.0
        for at in range(M.ORDER, len(data)):
            gone = set()
            for k in range(M.ORDER, -1, -1):
                seen = {b: n for b, n in counts.get(data[at - k : at], {}).items() if b not in gone}
                if not seen:
                    continue
                if data[at] in seen:
                    total += math.log10((seen[data[at]] - M.DISCOUNT) / sum(seen.values()))
                    break
                total += math.log10(M.DISCOUNT * len(seen) / sum(seen.values()))
                gone |= set(seen)
            else:
                total -= math.log10(256 - len(gone))
        return total

    return score


def test_ppm_equals_a_plain_implementation(spark):
    from kinloom.llm import ppm as M

    rows = [(k, prose(k, 30, 30 + k) + f" Once{k}X only\there {'é' * (k % 3)}") for k in range(60)] + [(60, None), (61, ""), (62, " \n "), (None, "caf\u00e9 zq!"), (5, prose(5, 20))]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    want = plain_ppm([t or "" for i, t in rows if not held(i)])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (20, 1_500_000):
        got = sorted((str(r.doc_id), r.score) for r in M.score(docs, max_entries=most).collect())
        assert [i for i, _ in got] == sorted(str(i) for i, _ in rows)
        assert [s for _, s in got] == pytest.approx([s for _, s in sorted((str(i), want(t or "")) for i, t in rows)])


def _entries(texts):
    from kinloom.llm import ppm as M

    c = Counter()
    for t in texts:
        for code in M._coded([M.stream(M.words(t))]).tolist():
            for k in range(M.ORDER + 1):
                c[code & ((1 << 8 * (k + 1)) - 1) | k << 56] += 1
    return np.array(list(c)), np.array(list(c.values()))


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from kinloom.llm import packing

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, room=256, group_size=20).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in fixture_rows():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by[i]})
        assert sum(x[2] for x in own) == len(ids) and all(x[2] == 256 for x in own[1:])
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in own)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(empty(spark, docs)).count() == 0


def test_encoders_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from kinloom.llm.tokens import Encoder

    texts = ["<|endoftext|> hello", "<|startoftext|>", "a<|endoftext|>  B<|startoftext|>\n", "<|ENDOFTEXT|> <|endof text|>", "a  b\n\n c \t d", " x", "x ", "", "ÀÉ Σας İstanbul ŉ", "it's  I'LL x.\nY z", "a\x1cb \x1c c", "“q” 12 3.5 naïve…", "́ é x"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e, t = Encoder(name, cached=3), Tokenizer.from_file(public_tokenizers.path(name))
        for x in texts * 2:
            assert np.frombuffer(e.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, (name, x)


def test_near_duplicates(spark, docs):
    from kinloom.llm import near_duplicates as N

    rows = fixture_rows()
    rng = random.Random(5)
    origin = prose(77, 120).split()
    for k in range(60):  # a chain-like family: each drifts from the one before
        origin[rng.randrange(120)] = f"n{k}"
        rows.append((1000 + k, " ".join(origin)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = N.groups(df, 4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert N.groups(empty(spark, docs)).count() == 0
    assert N.deduplicate(docs).columns == docs.columns


def test_near_duplicates_lose_fewer_pairs_by_agreement_than_by_bands():
    from kinloom.llm import near_duplicates as N

    n = N.BANDS * N.WIDTH
    below = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(n) if k / n < N.AGREEMENT)
    assert 100 * below <= (1 - 0.8**N.WIDTH) ** N.BANDS


def near_components(rows, size):
    """Brute force: each doc_id's least reachable doc_id over its texts' exact shingle sets."""
    sets = []
    for i, t in rows:
        w = WORD.findall(low(t))
        if w and i is not None:
            sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}))
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("hot", [None, 2])
def test_near_duplicates_of_families_and_repeated_ids(spark, hot):
    from kinloom.llm import near_duplicates as N

    rng, rows = random.Random(9), []
    for family in range(3):
        base = prose(family, 150, 5000).split()
        for k in range(60):  # variants at all distances around the limit
            w = list(base)
            for at in rng.sample(range(150), rng.randrange(0, 9)):
                w[at] = f"v{family}x{k}x{at}"
            rows.append((len(rows), " ".join(w)))
    shared = prose(50, 90, 5000)
    rows += [(300 + k, f"{shared} {prose(60 + k, 60, 5000)}") for k in range(40)]  # a passage, but not similar
    a, b = prose(70, 100), prose(71, 100)
    rows += [(505, a), (505, b), (507, a + " z"), (509, b + " z"), (505, a), (None, a), (None, None), (510, "")]
    rows += [(600 + k, a + " z") for k in range(30)]
    want = near_components(rows, 4)
    got = N.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, hot=hot).collect()
    assert len(got) == len(rows) and len(set(want.values())) > 45
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id]), r.doc_id
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_components(spark):
    from kinloom.llm.components import components

    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 101), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}
    assert got == want
    hubs = components(spark.createDataFrame([*edges, (None, 3), (0, 1)], "u long, v long"), hot=2)  # every node is a hub
    assert {r.node: r.component for r in hubs.collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_compression_quality(spark):
    from kinloom.llm import compression_quality as C

    good = [(i, prose(i, 90)) for i in range(120)]
    bad = [(500 + i, " ".join(["spam" + str(i % 7)] * 40 + ["!!! $$$"] * 30)) for i in range(120)]
    df = spark.createDataFrame([*good, *bad, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 500)) for i, _ in good + bad] + [(900, None)], "doc_id long, quality int")
    model = C.fit(df.where("doc_id % 2 = 0"), labels)
    got = {r.doc_id: (r.score, r.predicted) for r in C.score(df, model).collect()}
    assert len(got) == 242 and all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in got.values())
    assert sum(got[i][1] == int(i < 500) for i, _ in good + bad if i % 2) > 0.97 * 120
    assert C.score(empty(spark, df), model).count() == 0
    clash = df.selectExpr("doc_id", "'x' as score", "1 as Predicted", "text", "'y' as kept")
    assert C.score(clash, model).columns == ["doc_id", "kept", "score", "predicted"]
    C.score(df, C.fit(df, empty(spark, labels))).count()


def test_token_files(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from kinloom.llm import token_files as T

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    for i, t in sorted(fixture_rows(), key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in T.round_trip(docs).collect()) == want
    assert T.round_trip(empty(spark, docs)).count() == 0
    path = str(tmp_path / "x.tok.zst")
    store, p = T.open_store("file://" + path)
    w = T.FrameWriter(store.open_output_stream(p, compression=None))
    for k in range(5):
        w.add(k // 2, np.arange(k, dtype="<u4").tobytes())
    w.close()
    reader = T.FrameReader(store.open_input_file(p))
    assert reader.nulls == 0 and [x.tolist() for x in reader.document(1)] == [[0, 1], [0, 1, 2]] and reader.document(7) == []
    raw = bytearray(open(path, "rb").read())
    raw[int(reader.offsets[4]) + 8] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        T.FrameReader(store.open_input_file(p)).read(4)


def test_token_files_of_null_and_extreme_ids_over_several_files(spark):
    from kinloom.llm import token_files as T

    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(i, f"word {k}") for k, i in enumerate([None, low, None, high, 0, 0, 7, low])]
    got = [tuple(r) for r in T.round_trip(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), most=(1 << 30, 2)).collect()]
    assert Counter(r[0] for r in got) == Counter(i for i, _ in rows)
    order = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in order] == [None, None, low, low, 0, 0, 7, high]
    assert all(a[1] + a[2] == b[1] for a, b in zip(order, order[1:]))


def test_pseudonyms_of_dates(spark):
    from kinloom.llm import pseudonyms as P

    def mapped(values, **options):
        rows = spark.createDataFrame([(v,) for v in values], "text string").repartition(4)
        out = P.pseudonymise(rows.withColumn("plain", F.col("text")), "k", **options).collect()
        return {r.plain: r.text for r in out}

    from pyspark.sql import functions as F

    assert mapped(["0000-05-05", "05/05/0000", "0001-01-01 x"])["0000-05-05"] == "0000-05-05"
    last = [f"{y}-{m:02d}-{d:02d}" for y in range(9601, 10000, 7) for m in (1, 6, 12) for d in (1, 15, 28)]
    got = mapped(last)
    assert all(re.fullmatch(r"9[6-9][0-9]{2}-[01][0-9]-[0-3][0-9]", g) for g in got.values()) and len(set(got.values())) == len(last)
    month = [f"{a:02d}/{b:02d}/{y}" for y in (2002, 2008) for a in range(1, 32) for b in range(1, 32) if a <= 12 or b <= 12]
    for order in ("mdy", "dmy"):
        got = mapped(month, slash_order=order)
        real = [v for v in month if got[v] != v]
        assert len(real) > 950 and len(set(got.values())) == len(month)
        late = (lambda v: int(v[:2]) > 12) if order == "mdy" else (lambda v: int(v[3:5]) > 12)
        assert all(late(v) == late(got[v]) for v in real)


def test_pseudonyms_replace_a_clashing_count(spark):
    from kinloom.llm import pseudonyms as P

    df = spark.createDataFrame([(1, "on 2024-01-05", "x"), (2, None, "y")], "doc_id long, text string, N_values string")
    out = P.pseudonymise(df, "k", count="n_values")
    assert out.columns == ["doc_id", "text", "n_values"] and [r.n_values for r in out.orderBy("doc_id").collect()] == [1, 0]


def test_pseudonyms(spark, docs):
    from kinloom.llm import pseudonyms as P

    values = ["4111111111111111", "4111 1111 1111 1111", "4111111111111112", "a.b1@mail.example.com", "+1 (692) 555-7565", "+49 30 1234567", "97.51.17.173", "300.1.1.1", "2024-02-29", "2023-02-29", "12/31/1999", "31.12.1999", "123-45-6789", "000-45-6789", "DE89370400440532013000", "DE89370400440532013001"]
    rows = [(k, f"x {v} y {v}") for k, v in enumerate(values)] + [(90, None), (91, ""), (92, "no data")]
    got = {r.doc_id: r for r in P.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k", count="n").collect()}
    kept = {2, 7, 9, 13, 15}
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    for k, v in enumerate(values):
        m = re.fullmatch("x (.*) y (.*)", got[k].text)
        assert m[1] == m[2], v  # equal values stay linked
        if k in kept:
            assert m[1] == v and got[k].n == 0, v
        else:
            assert m[1] != v and got[k].n == 2 and re.sub(r"\d+" if k == 6 else r"\d", "9", re.sub("[a-z]", "a", m[1].split("@")[0])) == re.sub(r"\d+" if k == 6 else r"\d", "9", re.sub("[a-z]", "a", v.split("@")[0])), (v, m[1])
    assert luhn(re.sub(r"\D", "", got[1].text.split(" y ")[0])) and got[3].text.count("@mail.example.com") == 2 and got[4].text.startswith("x +1 (")
    assert got[90].text is None and got[91].text == "" and got[92].text == "no data"
    # A permutation: all values of a small format, without meeting.
    cards = spark.range(0, 2000).selectExpr("id as doc_id", "concat('10.0.', cast(floor(id / 250) as string), '.', cast(id % 250 as string)) as text")
    assert P.pseudonymise(cards, "k").select("text").distinct().count() == 2000
    assert P.pseudonymise(docs, "k").columns == docs.columns and P.pseudonymise(empty(spark, docs), "k").count() == 0


def test_pseudonyms_of_cards_beside_digits(spark):
    from kinloom.llm import pseudonyms as P

    card = "4111 1111 1111 1111"
    texts = ["4111111111111111 190.137.223.204", "4111111111111111 12/31/1999", f"paid 12 {card}", f"{card} 12", f"{card} 1234", f"1234 {card}", f"{card} 2024-01-05", f"{card} {card}", "3782 822463 10005 7", "41111111 11111111"]
    got = [r.text for r in P.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    for t, g in zip(texts, got):
        for value in (card, "4111111111111111", "3782 822463 10005", "41111111 11111111", "190.137.223.204", "12/31/1999", "2024-01-05"):
            assert value not in g, (t, g)
    assert [g.split(" ")[-1] for g in got[3:5]] == ["12", "1234"] and got[2].startswith("paid 12 ") and got[5].startswith("1234 ")
    assert got[7][:19] == got[7][20:]


@pytest.fixture(scope="module")
def common_forms(spark):
    from kinloom.llm import pseudonyms as P

    texts = {
        "phone": ["+33 1 23 45 67 89", "+49 (0)30 1234567", "+1.692.555.7565", "+33 12 34 56 78 90", "(555) 123-4567", "555-123-4567"],
        "iban": ["DE89 3704 0044 0532 0130 00", "AT61 1904 3002 3457 3201"],
        "card": ["+49 30 1234567 4111 1111 1111 1111", "+1 692 555 7565 4111 1111 1111 1111"],
        "date": ["2024/01/05", "1/5/2024", "2024-1-5", "5.1.2024", "31/1/2024"],
    }
    rows = [(k, t, f"on {t} 12 end") for k, t in enumerate(t for ts in texts.values() for t in ts)]
    got = {r.plain: r.text for r in P.pseudonymise(spark.createDataFrame(rows, "doc_id long, plain string, text string"), "k").collect()}
    return {k: [(t, got[t]) for t in ts] for k, ts in texts.items()}


@pytest.mark.parametrize("kind", ["phone", "iban", "card", "date"])
def test_pseudonyms_of_common_forms(common_forms, kind):
    shape = lambda x: re.sub("[0-9]", "9", x)
    for t, g in common_forms[kind]:
        assert g.startswith("on ") and g.endswith(" end") and t not in g, (t, g)
        if kind == "phone":
            assert shape(g) == shape(f"on {t} 12 end") and t.split(" ")[-1] not in g, (t, g)
        elif kind == "card":
            assert "1111 1111" not in g and t[:-20] not in g, (t, g)
        elif kind == "iban":
            new = g[3:-7].replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1 and g.endswith(" 12 end") and shape(g) == shape(f"on {t} 12 end"), (t, g)
        else:
            assert re.sub("[0-9]+", "9", g) == re.sub("[0-9]+", "9", f"on {t} 12 end") and g.endswith(" 12 end"), (t, g)


def test_sharding(spark, docs):
    from kinloom.llm import sharding as S

    rows = [(i, t) for i, t in fixture_rows()] + [(2000 + i, "hot text") for i in range(300)] + [(4000 + i, prose(i, 30)) for i in range(400)]
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4).collect()
    assert len(got) == len(rows)
    slots, where = defaultdict(list), defaultdict(set)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(((len(t.encode()) if t else 0) + 1, zlib.crc32((t or "").encode())))
    for r in got:
        assert (r["size"], r.text_crc32) in texts[r.doc_id]
        slots[r.shard].append(r.slot)
        where[r.text_crc32, r["size"]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(w) == 1 for (c, _), w in where.items() if c not in (zlib.crc32(b"hot text"), zlib.crc32(LONG.encode())))
    # One text is larger than a shard's share: its shard takes little else, the others are alike.
    alone = next(r.shard for r in got if r.text_crc32 == zlib.crc32(LONG.encode()))
    weight = Counter()
    for r in got:
        weight[r.shard] += r["size"]
    others = [k for k in slots if k != alone]
    assert len(others) == 3 and max(weight[k] for k in others) < 1.1 * min(weight[k] for k in others)
    assert max(len(slots[k]) for k in others) < 1.1 * min(len(slots[k]) for k in others)
    assert S.shard(empty(spark, docs)).count() == 0


def pipeline_tables(spark, folder, rows, items, labels):
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from kinloom.llm import queries as Q
    from kinloom.llm.shared import settle

    rng = random.Random(3)
    texts = {i: prose(i, 80 + i, 3000) for i in range(40)}
    for i in range(40, 70):  # copies, near and exact
        w = texts[i % 10].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"c{i}"
        texts[i] = " ".join(w)
    texts |= {70 + i: prose(200 + i, 20) for i in range(5)}  # too short
    texts |= {80 + i: " ".join(prose(300 + i, 12, 3000) for _ in range(2)) + " " + prose(320 + i, 70, 3000) for i in range(5)}
    texts |= {90: None, 91: "", 92: "same three words " * 40, 93: prose(400, 90, 3000) + " mail a.b@c.example.com or 4111 1111 1111 1111", 94: texts[11] + " x"}
    rows = [(i, t, "en", "s", len(t) if t else None) for i, t in texts.items()] + [(None, prose(500, 70, 3000), None, None, None), (12, texts[12], "en", "s", 1)]
    items = [(1, " ".join(texts[20].split()[10:40])), (2, texts[21][:200]), (3, None), (4, " ".join(texts[22].split()[:13]))]
    docs = pipeline_tables(spark, str(tmp_path), rows, items, [(None, 1, 0)])
    columns, sf = docs.columns, str(tmp_path)

    def ids(df):
        return Counter(r.doc_id for r in df.select("doc_id").collect())

    def run(k, docs):
        return settle(Q.STAGES[k][1](spark, docs, sf), Q.STAGES[k][0])

    # Without labels, only the base rule rejects.
    def fails(t):
        w = WORD.findall(t or "")
        g = Counter(zip(w, w[1:], w[2:]))
        again = {k + j for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for j in range(3)}
        return len(w) < 50 or 100 * len(again) > 50 * len(w)

    good = [r for r in rows if not fails(r[1])]
    one = run(0, docs)
    assert one.columns == columns and ids(one) == Counter(r[0] for r in good) and 70 not in ids(one) and 92 not in ids(one)

    root = near_components([r[:2] for r in good], 5)
    kept = [r for r in good if r[0] is None or root[r[0]] == r[0]]
    two = run(1, one)
    assert two.columns == columns and ids(two) == Counter(r[0] for r in kept) and len(kept) < len(good) - 10

    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall

    def hit(t):
        w, found = find(low(t)), set()
        for _, item in items:
            own = find(low(item))
            n = min(13, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= set(range(k, k + n))
        return bool(found) and 20 * len(found) >= len(w)

    clean = [r for r in kept if not hit(r[1])]
    three = run(2, two)
    assert three.columns == columns and ids(three) == Counter(r[0] for r in clean) and {20, 21, 22} & set(ids(three)) == set()

    four = run(3, three)
    new = {r.doc_id: r for r in four.collect()}
    assert four.columns == columns and ids(four) == ids(three)
    for i, t, *_ in clean:
        assert (new[i].text == t) == (i != 93) and new[i].n_chars == len(new[i].text)
    assert "4111 1111" not in new[93].text and "a.b@" not in new[93].text

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = Counter()
    for r in Q.STAGES[4][1](spark, four, sf).collect():
        size[r.doc_id] += r.length
    repeated = ids(four)
    assert size == {i: repeated[i] * (len(tok.encode(r.text, add_special_tokens=False).ids) + 1) for i, r in new.items()}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    pipeline_tables(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
