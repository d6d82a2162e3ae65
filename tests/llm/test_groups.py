"""Components, the Jaccard join, mixing and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from payloom.llm import bpe, common, jaccard_join, mixing, registry
from payloom.llm.components import components

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def lowest(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    real = [e for e in edges if e[1] is not None and e[0] != e[1]]
    assert got == lowest({n for e in real for n in e}, real)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def grouped(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    of = lowest(range(len(rows)), edges)
    best = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[of[i]] = d if best[of[i]] is None else min(best[of[i]], d)
    return sorted((str(d), len(sets[i]), str(best[of[i]]) if d is not None else "None") for i, (d, _) in enumerate(rows))


def near_texts(seed, n=90):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    base = [[rng.choice(words) for _ in range(rng.choice((3, 6, 7, 8, 20, 60, 150)))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.choice((0, 1))] = [rng.choice(words)] * rng.choice((0, 1))
        if rng.random() < 0.2:
            w = passage + w
        rows.append((i, rng.choice((" ", "  ", "\n")).join(w)))
    return rows


@pytest.mark.parametrize("seed,k,percent", [(0, 4, 85), (1, 5, 80), (2, 2, 60)])
def test_jaccard_join(spark, seed, k, percent, monkeypatch):
    rows = near_texts(seed) + [(200, None), (201, ""), (201, ""), (202, " \n"), (None, "w1 w2 w3 w4 w5 w6"), (203, "W1 w2\tw3 w4 w5 w6"), (204, "w1")]
    # Small counts make nearly every token frequent, so that pairs of tokens are exercised.
    for buckets in (1 << 17, 1 << 3):
        monkeypatch.setattr(jaccard_join, "COUNT_BUCKETS", buckets)
        if buckets == 8:
            monkeypatch.setattr(jaccard_join, "_heavy_buckets", lambda counts, spark: spark.sparkContext.broadcast(b"\xfe"))
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ident", "sig", "n", "lead")})
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.similar_components(docs, k, percent).collect())
        want = grouped(rows, k, percent)
        assert [g for g in got if g[0] != "None"] == [w for w in want if w[0] != "None"] and len(got) == len(want)


def test_jaccard_join_of_messy_and_no_rows(messy, empty):
    assert jaccard_join.similar_components(messy).count() == 12
    assert jaccard_join.similar_components(empty).count() == 0


def filled(words, weights, share, most):
    """Water filling by rounds: what a full source can't take is reshared."""
    names, full = sorted(words, key=lambda s: (s is None, (s or "").encode())), {}
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    while True:
        left, total = share * sum(words.values()) - sum(full.values()), sum(w[n] for n in names if n not in full)
        over = [n for n in names if n not in full and left * w[n] / total > most * words[n]]
        if not over:
            return {n: full.get(n, left * w[n] / total if total else 0) for n in names}
        full |= {n: most * words[n] for n in over}


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice((0, 1, 5, 20, 21, 22, 60)), rng.choice(["a", "a", "a", "b", "é", None, "z", "B"])) for i in range(3000)] + [(3000, None, "only"), (3001, "x y", "a"), (3001, "x y", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("size", "up", "part", "number", "bin")})
    out = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r["size"]) for r in out) == sorted((d, len(WORD.findall(t or ""))) for d, t, _ in rows)
    words, taken, source = Counter(), Counter(), {d: s for d, _, s in rows}
    for d, t, s in rows:
        words[s] += len(WORD.findall(t or ""))
    goal = filled(words, (3, 1, 2), 1.5, 2.0)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == words[s] and abs(r.target - goal[s]) < 1e-6 and r.taken in (0, r["size"], 2 * r["size"])
        rate = goal[s] / words[s] if words[s] else 0
        assert r["size"] == 0 or rate - 1 < r.taken / r["size"] < rate + 1
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 120 for s in words)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, out))


def test_mixing_keeps_expectations(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', 1 + cast(id % 40 as int)) as text", "if(id % 4 = 0, 'a', 'b') as source")
    mean = np.mean([[r.copies for r in mixing.mix(docs, seed=s).orderBy("doc_id").collect()] for s in range(12)], axis=0)
    rate = mixing.mix(docs).orderBy("doc_id").selectExpr("target / source_size as r").toPandas()["r"].to_numpy()
    assert np.abs(mean - rate).mean() < 0.2 and abs((mean - rate).mean()) < 0.01


def test_mixing_of_messy_and_no_rows(messy, empty):
    assert mixing.mix(messy).count() == 12 and mixing.mix(empty).count() == 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert df.columns and (df.count() > 0 or name in ("op6_secrets", "op9_licences"))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        rows = docs.collect()
        assert docs.columns == corpus_pipeline.COLUMNS
        docs, kept[name] = spark.createDataFrame(rows, docs.schema), rows
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept["quality"]}
    assert sum(d in ids for d, q in labels.items() if q == 1) >= 0.97 * sum(q == 1 for q in labels.values())
    pairs = grouped([(r.doc_id, r.text) for r in kept["quality"]], 5, 80)
    assert sorted(str(r.doc_id) for r in kept["near duplicates"]) == sorted(d for d, _, c in pairs if d == c)
    assert not any(re.search(r'token = "[0-9a-f]{16,}', r.text or "") for r in kept["secrets"])
    assert len(kept["secrets"]) == len(kept["near duplicates"])
    copies = Counter(r.doc_id for r in kept["mixing"])
    assert max(copies.values()) <= 2
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, hashlib.sha256(np.array(encoding.encode_ordinary(r.text), "<u4").tobytes()).hexdigest()) for r in kept["mixing"])
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()) == want


def test_pipeline_of_messy_and_no_rows(spark, messy, empty):
    import corpus_pipeline

    counts = {}
    for which, docs in (("messy", messy), ("empty", empty)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
            rows = docs.collect()
            counts[which, name] = rows
            docs = spark.createDataFrame(rows, docs.schema)
    assert not any(counts["empty", name] for name, _ in corpus_pipeline.STAGES)
    kept = corpus_pipeline.near_duplicates(spark, messy, DATA).collect()
    # Ids 5 (twice), null and 6 hold one text; the rest are alone, and the two rows of id 10 and 1 have no words.
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, (1, 2, 3, 4, 5, 7, 8, 9, 10)))
    assert corpus_pipeline.secret_scan(spark, messy, DATA).count() == 12


def test_stages_on_repeated_and_null_ids(spark):
    import corpus_pipeline

    alike = [(None, "one two three four five six seven eight nine", "en", "a", 44)] * 3000
    others = [(None, f"row {i} " + "w " * (i % 7), "en", "b", 20) for i in range(500)] + [(7, f"id seven {i} x", "en", None, 20) for i in range(300)]
    docs = spark.createDataFrame(alike + others, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    size = sum(len(WORD.findall(r[1])) for r in alike + others)
    mixed = corpus_pipeline.mix_sources(spark, docs, DATA).collect()
    took = Counter(r.text for r in mixed)
    assert abs(sum(len(WORD.findall(t)) * n for t, n in took.items()) - 1.5 * size) <= 40
    assert all(n <= 2 for t, n in took.items() if t != alike[0][1]) and took[alike[0][1]] <= 6000
    assert sorted(map(str, corpus_pipeline.mix_sources(spark, docs.repartition(3), DATA).collect())) == sorted(map(str, mixed))
    kept = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert kept.where(F.col("text") == alike[0][1]).count() == 1 and kept.count() <= 801
    out = mixing.mix(docs)
    assert out.count() == 3800 and out.agg(F.max("copies")).first()[0] <= 2


def test_groups_of_rows_that_are_alike_stay_small(spark):
    rows = spark.range(40_000).selectExpr("cast(null as long) as id", "'s' as source", "5L as size")
    numbered = mixing._numbered(rows)
    assert numbered.count() == 40_000 and numbered.distinct().count() == 40_000
    slots = numbered.groupBy(F.pmod(F.xxhash64("id", "size", "nth", F.lit(17)), F.lit(313))).count()
    assert slots.agg(F.max("count")).first()[0] < 4 * mixing.GROUP


def test_driver_gives_freed_memory_back(spark, monkeypatch):
    """Native memory that the driver's JVM has freed goes back to the system once a table is written."""
    jvm = spark.sparkContext._jvm
    common.Cut(spark.range(10), "warm")
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) / 1024
    data = spark.sparkContext._gateway.new_array(jvm.byte, 1 << 16)
    some = [jvm.java.util.zip.Deflater() for _ in range(600)]
    for x in some:
        x.setInput(data)
        x.deflate(spark.sparkContext._gateway.new_array(jvm.byte, 16))
    full = held()
    for x in some[:-1]:  # the last one stays, so that what is free lies below it
        x.end()
    monkeypatch.setattr(common, "GIVE_BACK_S", 0, raising=False)
    assert common.Cut(spark.range(10), "given").df.count() == 10
    assert held() < full - 50
