"""Near duplicates, embeddings and fixity against brute force; the pipeline end to end."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wachter.llm import common, embedding_neardup, jaccard_join, warc_fixity
from wachter.llm.common import components, forest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def groups(ids, links):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def near_copies(rng, n):
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 60))] for _ in range(n // 6)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("block", [256, 7])
def test_jaccard(spark, monkeypatch, block):
    rng = random.Random(6)
    texts = near_copies(rng, 240) + [None, "", " \n", "one", "One", "two words", "a " * 5000]
    base = [f"v{i}" for i in range(100)]
    texts += [" ".join(base[:40] + [f"z{k}"] + base[41:]) for k in range(30)]  # a group larger than a block
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).withColumn("fp", F.lit("clash"))
    monkeypatch.setattr(jaccard_join.classes, "__defaults__", (*jaccard_join.classes.__defaults__[:-1], block))
    got = {r["doc_id"]: r for r in jaccard_join.digest(df).collect()}
    s = [shingles(t) for t in texts]
    links = [(a, b) for b in range(len(s)) for a in range(b) if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8]
    n, top = Counter(x for e in links for x in e), groups(range(len(s)), links)
    assert len(got) == len(texts) and len(links) > 500
    for i in range(len(s)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], top[i], top[i] == i), i
    kept = jaccard_join.deduplicate(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(top.values()))


def test_jaccard_edges(spark):
    assert jaccard_join.digest(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e f", "en", None, None), (None, "a b c d e f", "en", None, None), (4, "g h i j k l", None, None, None), (4, "g h i j k l", None, None, None), (4, "other text", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in jaccard_join.digest(df).collect()) == [("4", 0), ("4", 1), ("4", 1), ("None", 0), ("None", 1), ("None", 1)]
    assert jaccard_join.deduplicate(df).count() == 4


def test_bands():
    b, r = jaccard_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 256


@pytest.mark.parametrize("few", [1024, 50])
def test_embeddings(spark, few):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 32))
    x = np.concatenate([x, x[:80] + rng.normal(size=(80, 32)) * 0.2, x[:1] + rng.normal(size=(60, 32)) * 0.05, x[5:8]])
    short = rng.normal(size=(6, 5))
    short = np.concatenate([short, short[:3] * 2, short[:1] + 1e-3])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    k = len(rows)
    rows += [(k + i, v.tolist(), 1) for i, v in enumerate(short)]
    odd = [None, [], [0.0] * 32, [math.nan] * 32, [math.inf] + [1.0] * 31, [None] + [1.0] * 31, [1.0] * 7]
    first = len(rows)
    rows += [(first + i, v, 1) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("key", "cid", "dim", "packed")})
    got = {r["id"]: r for r in embedding_neardup.near_duplicates(df, few=few).collect()}
    links = []
    for part, base in ((x, 0), (short, k)):
        u = part / np.linalg.norm(part, axis=1, keepdims=True)
        links += [(base + a, base + b) for a, b in np.argwhere(np.triu(u @ u.T >= 0.9, 1))]
    n, top = Counter(v for e in links for v in e), groups(range(len(rows)), links)
    assert len(got) == len(rows) and all((got[first + i]["n_links"], got[first + i]["component"], got[first + i]["kept"]) == (0, first + i, True) for i in range(len(odd)))
    if few > len(x):  # all pairs are candidates
        assert all((got[i]["n_links"], got[i]["component"], got[i]["kept"]) == (n[i], top[i], top[i] == i) for i in range(first))
    assert all(got[i]["n_links"] <= n[i] for i in range(first)) and sum(got[i]["n_links"] for i in range(first)) >= 0.95 * sum(n.values()) > 2000
    # where all of a vector's links are found, so is its component
    whole = [i for i in range(first) if all(got[j]["n_links"] == n[j] for j in range(first) if top[j] == top[i])]
    assert len(whole) > 0.9 * first and all((got[i]["component"], got[i]["kept"]) == (top[i], top[i] == i) for i in whole)
    assert embedding_neardup.digest(df.limit(0)).count() == 0
    assert embedding_neardup.digest(df.where(f"vec_id >= {first} and vec_id < {first + 6}")).count() == 6
    alike = embedding_neardup.digest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, [2.0, 4.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in alike) == [("0", 3, 0), ("1", 3, 0), ("2", 0, 2), ("3", 3, 0), ("None", 3, 0)]


@pytest.mark.parametrize("noise", [0.05, 0.2, 0.4])
def test_embedding_recall(spark, noise):
    """Recall of planted pairs down to the threshold, against brute force, of an index with pivots."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x = np.concatenate([x, x[:600] + rng.normal(size=(600, 64)) * noise])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int(np.triu(u @ u.T >= 0.9, 1).sum())
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = embedding_neardup.near_duplicates(df).agg(F.sum("n_links")).first()[0] // 2
    assert want > 500 and 0.9 * want <= found <= want


def test_shared_pivots():
    rng = np.random.default_rng(2)
    near = np.stack([rng.permutation(12)[:4] for _ in range(40)])
    near = near[(near == 5).any(1)]
    enough, earlier = embedding_neardup.shared_pivots(near, 5, 2)
    for i, a in enumerate(near):
        for j, b in enumerate(near):
            both = set(a) & set(b)
            assert enough[i, j] == (i != j and len(both) >= 2) and earlier[i, j] == (enough[i, j] and min(both) < 5)


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_embedding_cells(spark, monkeypatch, kind):
    """A list of usual length is dealt once; lists of many blocks give the same. At the threshold the
    cosine in double precision decides."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)).astype(kind)
    x = np.concatenate([x, x[:150] + rng.normal(size=(150, 16)) * 0.05, x[:1] + rng.normal(size=(200, 16)) * 0.1])
    x = np.concatenate([x, x[:100] + rng.normal(size=(100, 16)) * 0.4]).astype(kind).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = u @ u.T
    np.fill_diagonal(cosine, -1)
    threshold = float(np.sort(cosine[cosine > 0.8])[1000]) + 1e-12  # a pair just below it, others within a float's error
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    top = groups(range(len(x)), np.argwhere(np.triu(cosine >= threshold)).tolist())
    want = [(i, int((cosine[i] >= threshold).sum()), top[i]) for i in range(len(x))]
    dealt = []

    def block_pairs(*args):
        dealt.append(common.block_pairs(*args))
        return dealt[-1]

    monkeypatch.setattr(embedding_neardup, "block_pairs", block_pairs)

    def run(**more):
        return sorted((r["id"], r["n_links"], r["component"]) for r in embedding_neardup.near_duplicates(df, threshold=threshold, **more).collect())

    assert run(few=10_000) == want
    assert dealt[0].count() == len(x)
    pivoted = run(few=100)
    assert dealt[1].count() == 10 * len(x)
    for block in (400, 60):
        monkeypatch.setattr(embedding_neardup, "BLOCK", block)
        assert run(few=10_000) == want
        assert run(few=100) == pivoted


def test_nearest_pivots():
    rng = np.random.default_rng(6)
    near = rng.integers(0, 12, (300, 40)) / 11.0  # many ties
    for k in (1, 10, 40):
        assert (embedding_neardup.nearest_pivots(near, k) == np.argsort(-near, 1, kind="stable")[:, :k]).all()


def test_forest_and_components(spark):
    link = np.zeros((6, 6), bool)
    for a, b in ((0, 1), (1, 4), (2, 3), (3, 4)):
        link[a, b] = link[b, a] = True
    assert forest(link, np.zeros(6)).tolist() == [0, 0, 0, 0, 0, 5]
    assert forest(link, np.array([0, 0, 1, 1, 1, 0])).tolist() == [0, 1, 0, 3, 4, 5]  # the blocks' inner links are elsewhere
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)}


PAGES = "page_id long, url string, html string"


def test_fixity(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "x" * rng.randint(0, 300)) for i in range(700)] + [(None, "u", None), (None, "u", None), (5, "again", "y")]
    a = spark.createDataFrame(rows, PAGES).withColumn("file", F.lit("clash"))
    b = a.where("page_id is null or page_id not in (17, 650)").withColumn("html", F.when(F.col("page_id").isin(3, 400), F.concat("html", F.lit("!"))).otherwise(F.col("html"))).union(a.where("page_id = 1").withColumn("page_id", F.lit(900).cast("long")))
    x, y = warc_fixity.trees([warc_fixity.records(t, file_records=64) for t in (a, b)], 4, 64)
    assert x.levels[-1].count() == 1 and x.levels[-1].collect() != y.levels[-1].collect()
    got = {(r["page_id"], r["kind"]) for r in warc_fixity.audit(x, y).collect()}
    assert got == {(3, "changed"), (400, "changed"), (17, "missing"), (650, "missing"), (900, "extra")}
    same = warc_fixity.trees([warc_fixity.records(t, file_records=64) for t in (a, a.repartition(3))], 4, 64)
    assert same[0].levels[-1].collect() == same[1].levels[-1].collect() and warc_fixity.audit(*same).count() == 0
    empty = warc_fixity.trees([warc_fixity.records(t, file_records=64) for t in (a, a.limit(0))], 4, 64)
    assert warc_fixity.audit(*empty).count() == len(rows)
    assert warc_fixity.digest(a.limit(0)).count() == 0


def test_fixity_descends_to_what_differs(spark):
    """One lost record, one that has grown: one node a level for each, whatever moves after them."""
    a = spark.range(4096).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat('x', cast(id % 90 as int)) as html")
    b = a.where("page_id <> 700").withColumn("html", F.when(F.col("page_id") == 3000, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    x, y = warc_fixity.trees([warc_fixity.records(t) for t in (a, b)])
    seen = [level.count() for level in warc_fixity.descend(x, y)]
    assert seen == [1] + [2] * (len(x.levels) - 1) and sum(level.count() for level in x.levels) > 256
    got = {(r["file"], r["page_id"], r["kind"]) for r in warc_fixity.audit(x, y).collect()}
    assert got == {(0, 700, "missing"), (2, 3000, "changed")}


def test_fixity_bounds_files(spark):
    """Many equal pages, many contents of one id, many pages without id: no file has more than a few times its number of records."""
    many = spark.range(5000).selectExpr("cast(7 as long) as page_id", "concat('u', id) as url", "cast(id as string) as html")
    lost = spark.range(3000).selectExpr("cast(null as long) as page_id", "'u' as url", "cast(null as string) as html")
    a = many.union(lost).union(spark.createDataFrame([(9, "u", None)] * 2, PAGES))
    b = many.where("url <> 'u77'").union(lost.limit(2998)).union(spark.createDataFrame([(9, "u", None), (9, "u", " ")], PAGES))
    slices = warc_fixity.layout(a, 64)
    x, y = warc_fixity.trees([warc_fixity.records(t, slices, 64) for t in (a, b)], 4, 64)
    assert x.leaves.groupBy("file", "slice").count().agg(F.max("count")).first()[0] < 200
    got = Counter((r["page_id"], r["kind"]) for r in warc_fixity.audit(x, y).collect())
    assert got == {(7, "missing"): 1, (None, "missing"): 2, (9, "changed"): 1}
    nulls = spark.createDataFrame([(i, None, None) for i in range(300)], PAGES)
    want = {i for i in range(300) if hashlib.md5(str(i).encode()).hexdigest()[0] == "0"}
    assert {r["page_id"] for r in warc_fixity.digest(nulls).collect() if r["kind"] == "changed"} == want


def test_fixity_of_files(spark, tmp_path):
    a = spark.createDataFrame([(i, f"http://h/{i}", "WARC/1.1\r\n é\r\n\r\n" * (i % 5)) for i in range(300)] + [(5, None, None), (None, "u", "x")], PAGES)
    out = str(tmp_path / "warc")
    warc_fixity.write_warc(a, out, file_records=100)
    cols = ["file", "slice", "offset", "length", "page_id", "digest", "copies"]
    rows = lambda t: sorted(map(str, t.select(*cols).collect()))
    assert rows(warc_fixity.read_warc(spark, out)) == rows(warc_fixity.records(a, file_records=100))
    good = warc_fixity.trees([warc_fixity.records(a, file_records=100)], 4, 100)[0]
    at = {r["page_id"]: r for r in good.leaves.where("file - 0 >= 0").collect()}
    for path in (tmp_path / "warc").glob("file=*/slice=0/part-*"):  # one byte of a content, one of a head
        raw = bytearray(path.read_bytes())
        for page, into in ((151, -5), (250, 2)):
            if f"file={page // 100}/" in str(path):
                place = at[page]["offset"] + (into if into >= 0 else at[page]["length"] + into)
                raw[place] ^= 1
                path.write_bytes(raw)
                (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    x, y = warc_fixity.trees([warc_fixity.records(a, file_records=100), warc_fixity.read_warc(spark, out)], 4, 100)
    got = {(r["page_id"], r["kind"]) for r in warc_fixity.audit(x, y).collect()}
    assert got == {(151, "changed"), (250, "missing"), (None, "extra")}


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 60)))
    item = " ".join(f"q{i}" for i in range(30))
    docs, marks = [], []
    for i in range(400):
        t = text()
        if i % 5 == 1:
            t += " vile rotten foul"
            marks.append((i, 1))
        elif i % 5 != 4:
            marks.append((i, 0))
        docs.append((i, t, "en", f"s{i % 4}", len(t)))
    docs += [(500 + i, docs[i][1] + " more", "en", "s1", 1) for i in (0, 2, 3)] + [(600, text() + " " + item, "en", "s1", 1), (601, None, None, None, None)]
    for name, rows, schema in (("documents", docs, DOCS), ("labels", [(a, 0, b) for a, b in marks], "doc_id long, quality int, toxic int"), ("benchmark", [(0, item)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    step, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, f in corpus_pipeline.STAGES:
        step = f(spark, step, str(tmp_path))
        seen.append({r["doc_id"] for r in step.collect()})
        if name != "token ids":
            assert step.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    toxic = {i for i, *_ in docs if i < 400 and i % 5 == 1}
    assert len(seen[0] & toxic) <= 0.2 * len(toxic) and len(seen[0]) >= len(docs) - len(toxic)
    assert seen[0] - seen[1] == {500, 502, 503} and seen[1] - seen[2] == {600} and 601 in seen[2] and seen[4] == seen[3] <= seen[2]
