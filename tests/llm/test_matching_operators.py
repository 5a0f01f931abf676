"""WARC, top-k, URL rules, decontamination, substring and SimHash against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from shapelab.llm import decontam, simhash, substring, topk, urlfilter, warc

MAGIC = "WARC/1.1\r\n"
FAKE = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_comes_back_with_magic_inside_payloads(frame, compression):
    rows = [(1, "http://a", "x" * 120), (2, None, "x" * 120), (3, "u", "short"), (4, "u", "short"), (5, "u\r\nz", None), (6, "u", FAKE), (7, "u", "a" + FAKE + FAKE + "é\r\n"), (8, "u", MAGIC), (None, "u", "y" * 100), (9, "q", "y" * 100), (9, "q", "y" * 100), (10, "u", "é" * 60), (11, "u", ""), (12, "u", "z" * 300_000)]
    pages = frame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(map(str, warc.round_trip(pages, per_file=4, compression=compression).collect()))
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        first = min(same) if same else None
        revisit = len(data) >= 100 and i != first
        want.append(str(type(pages).__name__) and (i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    from pyspark.sql import Row

    make = Row("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(str(make(*w)) for w in want)


def test_warc_payload_full_of_magic_lines(frame):
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:9>\r\nContent-Length: 0\r\n\r\n\r\n"
    texts = [record * 400, "x" + "WARC/1.1\r\n" * 700, "plain", "é" * 70_000 + record, ""]
    pages = frame([(i, "u", t) for i, t in enumerate(texts)] + [(None, "u", "x")], "page_id long, url string, html string").withColumn("block", F.lit(1))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in warc.round_trip(pages, per_file=4, compression="none").collect()}
    want = {i: t.encode() for i, t in enumerate(texts)} | {None: b"x"}
    assert got == {i: (len(b), hashlib.sha256(b).hexdigest(), "response") for i, b in want.items()}


def test_warc_of_an_empty_table(frame):
    assert warc.round_trip(frame([], "page_id long, url string, html string")).count() == 0


def test_topk_equals_brute_force_with_ties_and_odd_vectors(frame):
    import math

    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(40)] + [(300, None), (320, [1.0, None, 1.0, 1.0]), (340, [float("nan")] * 4), (360, [float("inf")] * 4), (None, [1.0] * 4), (380, [2.0, 2.0]), (381, [1.0, 1.0])]
    got = {}
    frame_ = frame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0))
    for r in topk.search(frame_, F.col("id") % 20 == 0, k=7, query_block=3, row_block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    import numpy as np

    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != q and len(w) == len(v))[:7]
            assert sorted(got.get(q, [])) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert set(got) <= {q for q, _ in ok if q % 20 == 0}


def test_topk_of_an_empty_table(frame):
    assert topk.search(frame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).count() == 0


URLS = ["http://a.example.com/en/7x", "https://EXAMPLE.com/en/8?q", "http://x.net/de/#a", "http://example.net/de/81", "http://net/de/", "http://xnet/de/", "nothing", None, "", "http://", "http://foo/x.com/en/", "http://ads.x.org/es/1", "http://a.org/es", "http://q/login", "http://q/login/x", "http://m.a.b/x/print", "ftp://h.com/en/" + "y" * 5000, "http://q/a.GIF", "http://q/ü.gif", "x://é.com/en/"]


def test_url_rules_equal_regular_expressions(frame):
    rng = random.Random(2)
    hosts, paths = ["com", "a.com", "example.com", "ads.example.net", "org", "x.casino1.de", "localhost"], ["/en/", "/en/7", "/de/8", "/es/", "/login", "/wp-admin/x", "/a/amp/b/amp/c", "", "/x.gif", "/calendar/1/2/3"]
    urls = URLS + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(100)]
    got = {r.page_id: r for r in urlfilter.judge(frame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(r, v) for r, v in urlfilter.BASE_RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
        globs = [(g, v) for g, v in urlfilter.GLOB_RULES if re.fullmatch(urlfilter._regex(g), "." + host + path, re.S)]
        glob, other = min(globs, key=lambda x: (-len(x[0]), x[0])) if globs else (None, "allow")
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict, r.glob) == (host, path, rule, verdict or other, glob)
    assert urlfilter.judge(frame([], "page_id long, url string")).count() == 0


def _edit(p, t):
    col, out = list(range(len(p) + 1)), []
    for w in t:
        new = [0]
        for i in range(1, len(p) + 1):
            new.append(min(col[i] + 1, new[-1] + 1, col[i - 1] + (p[i - 1] != w)))
        col = new
        out.append(col[-1])
    return out


def test_decontamination_equals_full_edit_distance(frame):
    rng = random.Random(7)
    letters = "abcdefgh"
    items, docs = [], []
    for i in range(25):
        items.append((i, " ".join(rng.choice(letters) for _ in range(rng.randrange(1, 25)))))
    for d in range(60):
        words = [rng.choice(letters) for _ in range(rng.randrange(0, 40))]
        if d % 2:
            q = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(len(q) + 1)
                q[at : at + rng.randrange(2)] = rng.choice([[], ["zz"]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = q
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "a " * 5000)]
    bench = frame([*items, (99, None), (98, ""), (97, items[0][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.matches(frame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")), bench).collect()}
    want = {}
    for d, text in docs:
        t = (text or "").split()
        for i, p in [*items, (97, items[0][1])]:
            p = p.split()
            best = min(_edit(p, t), default=99)
            if best <= int(0.2 * len(p) + 1e-9):
                want[(d, i)] = best
    assert {k: r.distance for k, r in got.items()} == want
    by_doc, by_item = dict(docs), dict([*items, (97, items[0][1])])
    for (d, i), r in got.items():
        assert _edit(by_item[i].split(), by_doc[d].split()[r.start_word : r.end_word])[-1] == r.distance or r.start_word == r.end_word
    kept = {r.doc_id for r in decontam.without_matches(frame(docs, "doc_id long, text string"), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.matches(frame(docs, "doc_id long, text string"), bench.limit(0)).count() == 0
    assert decontam.matches(frame([], "doc_id long, text string"), bench).count() == 0


def _kept(rows, k):
    first = {}
    ordered = sorted({((i is not None, i or 0), (t or "")) for i, t in rows})
    out = {}
    for i, t in ordered:
        w = t.encode().split()
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p : p + k]), (i, p))
    for i, t in ordered:
        w = t.encode().split()
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (i, p):
                gone |= set(range(p, p + k))
        out[i] = (len(w), len(gone), [x for j, x in enumerate(w) if j not in gone])
    return out


@pytest.mark.parametrize("k", [1, 4, 20])
def test_substring_removal_equals_brute_force(frame, k):
    rng = random.Random(k)
    passages = [[rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.randrange(5, 50))] for _ in range(6)]
    rows = []
    for i in range(50):
        words = []
        for _ in range(rng.randrange(0, 6)):
            words += rng.choice(passages)[rng.randrange(4) :] if rng.random() < 0.6 else [rng.choice("xyz") * rng.randrange(1, 4) for _ in range(rng.randrange(30))]
        rows.append((i * 3, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += [(700, None), (701, ""), (702, "é\u00a0ü " * 30), (703, "same " * 300), rows[5], rows[6], (None, rows[7][1])]
    want = _kept(rows, k)
    for r in substring.removal_digest(frame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)), k=k).collect():
        n, gone, kept = want[(r.doc_id is not None, r.doc_id or 0)]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(b" ".join(kept)).hexdigest())
    texts = substring.remove_repeats(frame(rows, "doc_id long, text string"), k=k).collect()
    assert len(texts) == len(rows)
    for r in texts:
        n, gone, kept = want[(r.doc_id is not None, r.doc_id or 0)]
        assert (r.text or "").encode().split() == kept and r.n_removed == gone


def test_substring_small_buffers_and_empty_table(frame, monkeypatch):
    monkeypatch.setattr(substring, "HOLD", 50)
    monkeypatch.setattr(substring, "SLICE", 40)
    rows = [(i, "p q r s t u v w " * 2 + str(i % 3)) for i in range(20)]
    want = _kept(rows, 4)
    for r in substring.removal_digest(frame(rows, "doc_id long, text string"), k=4).collect():
        assert (r.n_words, r.n_removed) == want[(True, r.doc_id)][:2]
    assert substring.removal_digest(frame([], "doc_id long, text string")).count() == 0


def _removed(frame, rows, k):
    return {r.doc_id: (r.n_words, r.n_removed) for r in substring.removal_digest(frame(rows, "doc_id long, text string"), k=k).collect()}


def _around_phrases(seed, n):
    """Phrases that come again and again in ever new surroundings, some words of which come again too."""
    rng = random.Random(seed)
    phrases = [[f"{c}{i}" for i in range(9)] for c in "pqr"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [str(rng.randrange(10**9)) for _ in range(rng.randrange(12))] + rng.choice(phrases) + [rng.choice("uvw") for _ in range(rng.randrange(4))]
        rows.append((i, " ".join(words)))
    return rows


def test_substring_phrases_in_new_surroundings_are_no_repeats(frame):
    rng = random.Random(3)
    phrase = [f"p{i}" for i in range(9)]
    new = lambda: [str(rng.randrange(10**12)) for _ in range(12)]
    rows = [(i, " ".join(new() + phrase + new())) for i in range(3000)]
    assert all(gone == 0 for _, gone in _removed(frame, rows, 20).values())


@pytest.mark.parametrize("bits", [0, 2, 6, 10])
def test_substring_false_candidates_are_decided_by_words(frame, monkeypatch, bits):
    real = substring.edge_spans

    def weak(*args):
        *spans, check = real(*args)
        return (*spans, check & ((1 << bits) - 1))

    monkeypatch.setattr(substring, "edge_spans", weak)
    monkeypatch.setattr(substring, "PIECE", 3)
    rows = _around_phrases(bits, 60)
    want = _kept(rows, 8)
    assert _removed(frame, rows, 8) == {i: want[(True, i)][:2] for i, _ in rows}


def test_substring_hot_minimizers_are_dealt_out(frame, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 2)
    rows = _around_phrases(5, 120)
    want = _kept(rows, 8)
    hot, size = substring.hot_minimizers(frame(rows, "doc_id long, text string"), 8, 3, 1)
    assert len(hot) > 3 and size == sum(len(t) for _, t in rows)
    assert _removed(frame, rows, 8) == {i: want[(True, i)][:2] for i, _ in rows}


def test_substring_ids_of_other_types_and_long_words(frame, monkeypatch):
    from shapelab.llm import common

    monkeypatch.setattr(common.WordHasher, "PIECE", 64)
    long = "y" * 500
    rows = [("b", "1 2 3 4 5 6 " + long), ("a", f"9 2 3 4 5 6 {long} 8"), (None, "3 4 5 6 7"), ("c", None)]
    got = {r.doc_id: r.n_removed for r in substring.removal_digest(frame(rows, "doc_id string, text string"), k=4).collect()}
    assert got == {None: 0, "a": 4, "b": 6, "c": 0}


def _prints(text):
    import xxhash

    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(values, linked):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if linked(values[a], values[b]):
                root[find(a)] = find(b)
    return [find(i) for i in range(len(values))]


def test_simhash_groups_equal_brute_force(frame):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(120)) for _ in range(8)]
    rows = []
    for i in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "Changed"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "ONE"), (105, "one two"), rows[0], (None, rows[3][1]), (110, "z " * 20_000)]
    fp = [_prints(t) for _, t in rows]
    comp = _components(fp, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(str((i, f, least[c])) for (i, _), f, c in zip(rows, fp, comp))
    got = simhash.near_duplicates(frame(rows, "doc_id long, text string").withColumn("node", F.lit(1)), limit=3).collect()
    assert sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in got) == want
    assert simhash.near_duplicates(frame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("limit", [2, 1000])
def test_simhash_links_lose_nothing_in_dense_groups(frame, limit):
    rng = random.Random(limit)
    base, values = rng.getrandbits(64), set()
    while len(values) < 150:
        x = base
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    values = sorted(values)
    got = {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.links(frame([(simhash._signed(v),) for v in values], "fp long"), 3, limit).collect()}
    assert got == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin(a ^ b).count("1") <= 3}


def _plans(spark, run):
    """The plans, as they ended, of the SQL that run() executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = store.executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(int(before), found.size())]


def test_simhash_variants_are_not_broadcast(spark, tmp_path):
    """Spark takes the variants for as small as the fingerprints that they are made of."""
    rng = random.Random(5)
    values = [rng.getrandbits(63) for _ in range(300)]
    spark.createDataFrame([(v ^ bit,) for v in values for bit in (0, 1 << 40)], "fp long").distinct().write.parquet(f"{tmp_path}/p")
    plans = _plans(spark, lambda: simhash.links(spark.read.parquet(f"{tmp_path}/p")))
    expanded = [p for p in plans if "Generate" in p and "Join" in p]
    assert expanded and not any("BroadcastExchange" in p for p in expanded)


def test_simhash_links_leave_out_pairs_of_one_label(frame):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = sorted({v ^ sum(1 << b for b in rng.sample(range(6), rng.randrange(4))) for v in [*base, base[0] ^ (1 << 50)] for _ in range(60)})
    label = {v: v >> 51 & 3 for v in values}
    nodes = frame([(simhash._signed(v),) for v in values], "fp long")
    labels = frame([(simhash._signed(v), label[v]) for v in values], "fp long, label long")
    want = {(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 3}
    for key in (label, {v: v >> 50 & 7 for v in values}):
        labels = frame([(simhash._signed(v), key[v]) for v in values], "fp long, label long")
        for limit in (4, 64):
            got = [tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.links(nodes, 3, limit, labels=labels).collect()]
            assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if key[a] != key[b]}


def test_components_of_chains_stars_and_loops(frame):
    rng = random.Random(9)
    names = rng.sample(range(10**6), 400)
    edges = list(zip(names[:99], names[1:100])) + [(names[100], x) for x in names[101:200]] + list(zip(sorted(names[200:260]), sorted(names[200:260])[1:]))
    edges += [tuple(rng.sample(names[260:400], 2)) for _ in range(90)] + [(7 * 10**6, 7 * 10**6)]
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    rows = simhash.components(frame(edges, "a long, b long")).collect()
    assert len(rows) == len(comp) and {r.node: r.root for r in rows} == comp
