"""Language, toxicity, license scan and BPE against plain Python."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from shapelab.llm import bpe, langid, license, queries, toxicity

SCHEMA = "doc_id long, text string, lang string"
ODD = [(900, None, None), (901, "", "aa"), (902, " 123 !", "aa"), (903, "x" * 200_000, "bb"), (None, "ab ab", "aa")]


def _texts(seed=1, n=60):
    rng = random.Random(seed)
    words = {"aa": "abra babra dabra araba".split(), "bb": "xylo zyxo lyxo oxyz".split()}
    return [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i in range(n) for lang in [("aa", "bb")[i % 2]]]


def test_language_is_learned_and_odd_texts_are_defined(frame):
    docs = frame(_texts() + ODD + [(0, "abra babra", "aa")], SCHEMA + "").withColumn("score", F.lit("clash"))
    tree = langid.train(docs, min_count=1)
    got = {(r.doc_id, r.lang_pred, round(r.score, 6) if r.lang_pred == "und" else None) for r in langid.identify(docs, tree).collect()}
    assert {(900, "und", 0.0), (901, "und", 0.0), (902, "und", 0.0), (0, "aa", None)} <= got
    assert all((i, lang, None) in got for i, _, lang in _texts())


def test_language_code_lengths_equal_a_plain_ppm():
    rows = [("aa", b"abracadabra abra"), ("bb", b"banana bandana")]
    grams = []
    for lang, text in rows:
        padded = b"\n\n\n" + text
        found = {}
        for i in range(len(text)):
            g = int.from_bytes(padded[i : i + 4], "big")
            found[g] = found.get(g, 0) + 1
        keys = np.array(sorted(found), np.int64)
        grams.append((lang, keys, np.array([found[int(k)] for k in keys])))
    tree = langid.build_tree(grams, 1 << 15, 1)
    known = {b for g in grams for k in g[1] for b in [int(k) & 255]} | {10}

    def cost(text, lang_at):
        count = {}
        for g, n in zip(*grams[lang_at][1:]):
            gram = int(g).to_bytes(4, "big")
            for k in range(4):
                c = count.setdefault(gram[3 - k : 3], {})
                c[gram[3]] = c.get(gram[3], 0) + n
        total, padded = 0.0, b"\n\n\n" + text
        for i in range(len(text)):
            b, bits = padded[i + 3], 0.0
            for k in (3, 2, 1, 0):
                c = count.get(padded[i + 3 - k : i + 3], {})
                if any(x not in known for x in padded[i + 3 - k : i + 3]) or not c:
                    continue
                n, kinds = sum(c.values()), len(c)
                if b in c:
                    bits -= np.log2(c[b] / (n + kinds))
                    break
                bits -= np.log2(kinds / (n + kinds))
            else:
                bits += 8
            total += bits
        return total

    texts = [b"abra", b"banana cadabra", b"", b"zz\xc3\xa9 ab"]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    got = langid.code_lengths(tree, np.frombuffer(b"".join(texts), np.uint8), offsets)
    want = [[cost(t, 0), cost(t, 1)] for t in texts]
    assert np.allclose(got, want, atol=1e-3)


def test_language_without_labels_or_rows(frame):
    empty = frame([], SCHEMA)
    assert langid.train(empty) is None
    assert langid.identify(empty, None).count() == 0
    assert langid.identify(frame([(1, "abc", None)], SCHEMA), None).first().lang_pred == "und"


def _toxic(n=300):
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}{chr(98 + i)}lo" for i in range(12)]
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        rows.append((i, " ".join(rng.choice(words) for _ in range(20)) + (" Grumpfel " if bad else " "), int(bad)))
    return rows


def test_toxicity_learns_held_out_rows_and_odd_texts(frame, spark):
    rows = _toxic()
    docs = frame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "GRUMPFEL walo")], "doc_id long, text string")
    labels = frame([(i, y) for i, _, y in rows if i % 2] + [(1, 0), (5, None), (None, 1), (7777, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, least_docs=3, least_z=3.0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows)
    assert got[1000] == got[1001] < 0.7 <= got[None]
    kept = {r.doc_id for r in toxicity.without_toxic(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert kept == {i for i, _, y in rows if not y} | {1000, 1001}


def _plain_buckets(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    grams = ((k, data[i : i + k]) for k in toxicity.SIZES for i in range(len(data) - k + 1))
    return {(int.from_bytes(g, "big") * toxicity._SALTS[k] % 2**64) >> (64 - toxicity.BITS) for k, g in grams}


def test_toxicity_equals_a_plain_version(frame):
    rows = _toxic(150) + [(500, "Grumpfel", 0), (501, "é Grümpfel ABCD", 1), (502, "", 0), (503, "abc", 1)]
    docs = frame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, frame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), docs_per_class=10**6, features=40, least_docs=3, least_z=2.0)
    has, labels = [_plain_buckets(t) for _, t, _ in rows], np.array([y for _, _, y in rows], float)
    n1, n0, rated = sum(labels), len(labels) - sum(labels), []
    for b in set().union(*has):
        ones = sum(y for h, y in zip(has, labels) if b in h)
        zeros = sum(b in h for h in has) - ones
        p, q, mix = (ones + 1) / (n1 + 2), (zeros + 1) / (n0 + 2), (ones + zeros + 1) / (n1 + n0 + 2)
        if ones + zeros >= 3 and abs(p - q) / (mix * (1 - mix) * (1 / n1 + 1 / n0)) ** 0.5 >= 2.0:
            rated.append((-round(abs(p - q) * abs(np.log(p / q)), 9), b, np.log(p / q)))
    chosen = sorted(rated)[:40]
    assert set(model.weights) == {b for _, b, _ in chosen}
    ratio = np.array([r for _, _, r in chosen])
    x = np.array([[b in h for _, b, _ in chosen] for h in has]) * ratio
    step, w, c, pw, pc = 1 / (0.25 * ((x**2).sum(1) + 1).mean() + 1e-5), np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0
    for t in range(1, 601):
        vw, vc = w + (t - 1) / (t + 2) * (w - pw), c + (t - 1) / (t + 2) * (c - pc)
        err = (1 / (1 + np.exp(-(x @ vw + vc))) - labels) / len(labels)
        pw, pc, w, c = w, c, vw - step * (x.T @ err + 1e-5 * vw / 2), vc - step * err.sum()
    assert abs(model.bias - c) < 1e-6 and all(abs(model.weights[b] - v * r) < 1e-6 for (_, b, r), v in zip(chosen, w))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for (i, _, _), h in zip(rows, has):
        assert abs(got[i] - 1 / (1 + np.exp(-sum(model.weights.get(b, 0.0) for b in h) - model.bias))) < 1e-5


def test_toxicity_without_a_class_or_rows(frame):
    docs, none = frame([(1, "a")], "doc_id long, text string"), frame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).first().score < 0.7
    assert toxicity.score(docs, toxicity.train(docs, frame([(1, 1)], "doc_id long, toxic int"))).first().score > 0.7
    assert toxicity.score(docs.limit(0), toxicity.train(docs, none)).count() == 0


def test_license_base_phrases_equal_a_plain_search(frame):
    rng = random.Random(3)
    parts = ["GNU General", "Public", "License", "general public license", "Apache  License", "cc-by", "CC BY", "MIT\nLicense", "é", "x", "mit license."]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(200)] + [None, "", "---"]
    rows = {r.doc_id: r for r in license.scan(frame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit(1))).collect()}
    lower = {c: c + 32 for c in range(65, 91)}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        found = [(k, label) for phrase, label in license.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None)) or (r.first_word, r.last_word) == (min(k for k, _ in found), max(k for k, _ in found))
        assert r.base_labels == ",".join(sorted({label for _, label in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the Apache License, Version 2.0", {"apache-2.0"}),
        ("SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3.0"}),
        ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
        ("BSD 3-Clause License", {"bsd-3-clause"}),
        ("CC BY-SA 4.0", {"cc-by-sa-4.0"}),
        ("nothing of the kind", set()),
    ],
)
def test_license_rules_suppress_what_they_contain(text, labels):
    assert {d[3] for d in license.Scanner().scan(text.encode())[4]} == labels
    assert len(license.rules()) > 300


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.load_ranks(f.read())
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_comes_back(encoding, frame):
    ranks, other = encoding
    rng = random.Random(8)
    pool = [*range(32, 127), *range(160, 0x2FF), 10, 32, 32, 0x4E2D, 0x1F600]
    texts = ["".join(chr(rng.choice(pool)) for _ in range(rng.randrange(120))) for _ in range(400)]
    texts += ["a" * 3000, "the" * 500, "  \n\n  ", "'s 've", "<|endoftext|>", "", "1234567890" * 20]
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    ids = [i.tolist() for i in codec.encode(texts)]
    assert ids == [other.encode_ordinary(t) for t in texts]
    assert [codec.decode(i).decode() for i in ids] == texts
    docs = frame([(i, t) for i, t in enumerate(texts)] + [(10_000, None)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    path, pattern = queries.rank_file()
    got = {r.doc_id: r for r in bpe.round_trip_digest(docs, path, pattern).collect()}
    import hashlib

    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(ids[i])
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids[i])).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert got[10_000].n_tokens == 0
    assert bpe.encode_verified(docs.limit(0), path, pattern).count() == 0
    two = bpe.decode(bpe.encode(docs.drop("ids"), path, pattern), path, pattern)
    assert all((r.text or "").encode() == bytes(r.decoded) for r in two.collect())


def test_bpe_lower_rank_made_by_a_merge_goes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 280, b"ab": 310, b"cb": 290}
    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1)), default=(10**9, 0))
            if best[0] == 10**9:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(4)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14))) for _ in range(500)]
    assert bpe.replay(words, ranks) == [plain(w) for w in words]


@pytest.mark.parametrize(
    "text, label",
    [
        ("licensed under the GPLv2", "gpl-2.0-v"),
        ("GPLv3 or later", "gpl-3.0-v"),
        ("Common Development and Distribution License 1.0", "cddl-1.0"),
        ("do what the fuck you want to public license", "wtfpl"),
        ("PNG Reference Library License", "libpng"),
    ],
)
def test_license_names_need_no_other_word(text, label):
    assert label in {d[3] for d in license.Scanner().scan(text.encode())[4]}


def _forms(tree):
    """Strings that a parsed expression matches, with every branch and option."""
    from re import _parser as p

    out = {""}
    for op, arg in tree:
        if op is p.LITERAL:
            ways = {chr(arg)}
        elif op is p.IN:
            ways = {chr(c) for _, c in arg}
        elif op is p.BRANCH:
            ways = {w for way in arg[1] for w in _forms(way)}
        elif op is p.SUBPATTERN:
            ways = _forms(arg[-1])
        elif op is p.MAX_REPEAT:
            ways = {""} | _forms(arg[2])
        else:
            ways = {""}  # the spaces around
        out = {a + w for a in out for w in ways}
    return out


def test_license_gates_let_every_match_through():
    from re import _parser as p

    for label, _, gates, expression in license.rules():
        for form in _forms(p.parse(expression.pattern.decode())):
            line = f" {form} ".encode()
            assert license.line_of(line)[0] == line, (label, form)
            assert expression.search(line) and any(g in line for g in gates), (label, form)
