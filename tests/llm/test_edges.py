"""What all operators and the pipeline have in common: clashing column names, empty tables, repeated rows, very long texts, and the SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scripts.compare import TABLES, norm
from wachter.llm import decontaminate, jaccard_join, katz, line_dedup, mixing, queries, token_counts, token_ids, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "_h _n _k _id _size _g _d _t _row row fp th cid h k d runs gone score held_out label size repeats ids start block part".split()


def corpus(rng, n):
    text = lambda: "\n".join(" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(3, 15))) for _ in range(rng.randint(1, 6)))
    rows = [(i, text() + (" vile rotten foul" if i % 5 == 1 else ""), "en", f"s{i % 3}", 1) for i in range(n)]
    return rows + [rows[4], rows[4], (None, None, None, None, None), (None, "same words in two rows without an id", None, None, None), (None, "same words in two rows without an id", None, None, None), (n, "", "en", None, 0), (n + 1, " \n\t", "en", "s1", 0)]


def tables(spark, folder, rows, item="q1 q2 q3 q4 q5 q6 q7 q8 q9", more=()):
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"clash {c}") for c in more})
    marks = [(r[0], 0, int("vile" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 5 != 4]
    for name, t in (("documents", df), ("labels", spark.createDataFrame(marks, "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(0, item), (1, None)] if item else [], "item_id long, text string"))):
        t.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return df


def same(df, names):
    return all(all(r[c] == f"clash {c}" for c in names) for r in df.collect())


def test_clashing_names(spark, tmp_path):
    rows = corpus(random.Random(1), 60) + [(90, "a b c q1 q2 q3 q4 q5 q6 q7 q8 q9 d", "en", "s1", 1)]
    df = tables(spark, str(tmp_path), rows, more=CLASH)
    labels, bench = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("labels", "benchmark"))
    for got, count in ((decontaminate.decontaminate(df, bench), len(rows) - 1), (jaccard_join.deduplicate(df), len(rows) - 3), (line_dedup.deduplicate(df), len(rows)), (toxicity.drop_toxic(df, labels), None), (mixing.mix(df), None)):
        assert got.columns == df.columns and same(got, CLASH) and (count is None or got.count() == count)
    for digest in (katz.digest, token_counts.digest, token_ids.digest, mixing.digest, jaccard_join.digest, line_dedup.digest):
        assert digest(df).count() >= len(rows) - 1
    assert toxicity.digest(df, labels).count() == len(rows)


def test_empty_tables(spark, tmp_path):
    df = tables(spark, str(tmp_path), [], item=None)
    labels, bench = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("labels", "benchmark"))
    for got in (decontaminate.decontaminate(df, bench), jaccard_join.deduplicate(df), line_dedup.deduplicate(df), toxicity.drop_toxic(df, labels), mixing.mix(df), token_counts.digest(df), token_ids.digest(df)):
        assert got.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("more", [(), CLASH])
def test_pipeline(spark, tmp_path, more):
    rows = corpus(random.Random(2), 300) + [(400, "a b c q1 q2 q3 q4 q5 q6 q7 q8 q9 d", "en", "s1", 1)]
    docs = tables(spark, str(tmp_path), rows, more=more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns and same(docs, more)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "n-gram Jaccard join":
            assert docs.where("doc_id = 4").count() == 1 and docs.where("text like 'same words%'").count() == 1 and docs.where("doc_id is null and text is null").count() == 1
    assert docs.where("doc_id = 400").count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == docs.count()


def test_very_long_texts(spark, tmp_path):
    lines, words = "line\n" * 1_000_000, "word " * 1_000_000
    rows = [(0, lines, "en", "a", 1), (1, words, "en", "a", 1), (2, lines + "x", "en", "b", 1), (3, "a few words that stand alone here", "en", "b", 1), (4, "\n" * 1_000_000, "en", "b", 1)]
    df = tables(spark, str(tmp_path), rows)
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r["n_deleted"] for r in line_dedup.digest(df).collect()}
    assert got == {0: 999_999, 1: 0, 2: 1_000_000, 3: 0, 4: 0}
    assert {r["doc_id"]: r["n_tokens"] for r in katz.digest(df).collect()} == {0: 1_000_001, 1: 1_000_001, 2: 1_000_002, 3: 8, 4: 1}
    assert toxicity.digest(df, labels).count() == 5 and mixing.digest(df).agg(F.sum("size")).first()[0] == 3_000_008
    assert token_counts.digest(df).count() >= 5
    assert sorted(r["doc_id"] for r in jaccard_join.deduplicate(df).collect()) == [0, 1, 2, 3, 4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    rel = con.execute(queries.ORACLE_SQL[name])
    have = [d[0] for d in rel.description]
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    assert sorted(have) == cols and got == sorted(repr(tuple(norm(r[have.index(c)]) for c in cols)) for r in rel.fetchall())
