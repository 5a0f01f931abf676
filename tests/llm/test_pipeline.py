"""The stages on a small corpus with planted cases."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = {i: text(80) for i in range(200)}
    for i in range(0, 200, 5):
        docs[i] += " Grumpfel wumpf"
    docs[301] = docs[1]
    docs[302] = docs[2].replace(docs[2].split()[40], "other", 1)
    passage = text(60)
    docs[303], docs[304] = text(30) + " " + passage + " " + text(30), text(20) + " " + passage
    item = text(30)
    words = item.split()
    words[4] = "edited"
    docs[305] = text(20) + " " + " ".join(words) + " " + text(20)
    rows = [(i, t, "en", "src", len(t)) for i, t in docs.items()] + [(400, None, None, None, None), (401, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, passage


def test_every_stage_takes_what_it_should_and_nothing_else(spark, folder):
    path, docs, passage = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, path)
        seen.append({r.doc_id for r in frame.select("doc_id").collect()})
        if name == "substring_dedup":
            text = {r.doc_id: r.text for r in frame.collect()}
            assert passage in text[303] and passage.split()[30] not in text[304] and text[303] == docs[303]
            assert all(text[i] == docs[i] for i in text if i in docs and i != 304)
    toxic = {i for i in range(0, 200, 5)}
    everything = set(docs) | {400, 401}
    assert seen[0] == everything - toxic
    assert seen[1] == seen[0] - {301, 302, 401} and seen[2] == seen[1]
    assert seen[3] == seen[2] - {305} and seen[4] == seen[3]
    assert frame.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_an_empty_table_runs_through(spark, folder, tmp_path):
    path = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_columns_with_clashing_names_pass_through(spark, folder):
    from pyspark.sql import functions as F

    names = ["score", "doc", "mark", "spans", "n_removed", "copy", "fp0", "node", "component_id", "gone_key", "count", "item_id", "least", "row"]
    frame = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id > 290 or doc_id < 12").select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    columns = frame.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder[0])
        assert frame.columns == columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in frame.collect() for n in names)


def test_near_dedup_takes_the_planted_near_copy(spark, folder):
    frame = spark.read.parquet(f"{folder[0]}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, folder[0]).select("doc_id").collect()}
    assert kept == set(folder[1]) - {301, 302} | {400}


def test_near_dedup_equals_brute_force(spark, folder):
    rng = random.Random(31)
    rows = []
    for _ in range(12):
        words = [str(rng.randrange(10**6)) for _ in range(rng.choice([5, 9, 40, 120, 400]))]
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 30)):
                copy[rng.randrange(len(copy))] = "Changed"
            rows.append(" ".join(copy[: len(copy) - rng.randrange(1 + len(copy) // 5)]))
    rows += [None, "", " \n", "one", "ONE", "one two", "a b c d", "a b c d e", "a b c d f", "z " * 20_000, rows[5].upper()]
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(i, rows[k]) for i, k in enumerate(order)]

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, folder[0]).collect())
    assert kept == [i for i in range(len(rows)) if find(i) == i] and len(kept) > 20


def test_near_dedup_judges_rows_and_not_keys(spark):
    from shapelab.llm import neardup

    text = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "ABCDE"}
    rows = [(3, "A"), (5, "A"), (5, "B"), (None, "A"), (None, "C"), (7, "D"), (7, "E"), (7, "E"), (None, "C"), (None, "F"), (None, "F")]
    text["F"] = None
    frame = spark.createDataFrame([(k, text[c], c) for k, c in rows], "doc_id long, text string, name string").repartition(3)
    kept = sorted((str(r.doc_id), r.name) for r in neardup.one_of_each(frame).collect())
    assert kept == sorted([("3", "A"), ("5", "B"), ("None", "C"), ("7", "D"), ("7", "E"), ("None", "F")])
    assert neardup.one_of_each(frame.limit(0)).count() == 0


def test_near_dedup_broadcasts_nothing_by_an_estimate(spark, folder, monkeypatch):
    from shapelab.llm import neardup, simhash

    plans, compute = [], neardup.stash

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return compute(df)

    monkeypatch.setattr(neardup, "stash", planned)
    monkeypatch.setattr(simhash, "stash", planned)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    neardup.one_of_each(spark.read.parquet(f"{folder[0]}/documents.parquet"))
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == limit


def test_near_dedup_lists_no_pairs_inside_a_group_that_is_linked(spark, monkeypatch):
    from shapelab.llm import neardup

    rng = random.Random(77)
    words = [str(rng.randrange(10**6)) for _ in range(600)]
    texts = []
    for i in range(80):
        copy = list(words)
        copy[rng.randrange(600)] = f"other{i}"
        texts.append(" ".join(copy))
    listed, find = [], neardup.links
    monkeypatch.setattr(neardup, "links", lambda *a, **b: listed.append(find(*a, **b)) or listed[-1])
    monkeypatch.setattr(neardup, "release", lambda *frames: None)
    rows = [(i, t) for i, t in enumerate(texts)]
    assert [r.doc_id for r in neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()] == [0]
    assert sum(x.count() for x in listed) < len(rows)
