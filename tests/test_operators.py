"""Roll-ups, sources, stores, search and shapes on small inputs: nulls, ties, repeated rows, empty tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import text as X
from quillgrid.operators import chunking, dedup, documents, quality, rollups, search, statistics
from quillgrid.sources import readers, writers

T = datetime.datetime(2026, 1, 1)


def at(n):
    return T + datetime.timedelta(hours=n)


def test_running_total_and_peak(spark):
    rows = [(i % 50, i, 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(9)
    got = {(r.a, r.b): r.total for r in rollups.running_total(df, ["a", "b"], "v").collect()}
    assert [got[k] for k in sorted(got)] == list(range(1, 1001))
    jobs = spark.createDataFrame([(at(0), at(2)), (at(1), at(3)), (at(2), at(4)), (at(1), None), (None, at(9))], "s timestamp, e timestamp")
    assert rollups.peak_concurrency(jobs, "s", "e").first().peak == 3
    assert rollups.peak_concurrency(jobs.limit(0), "s", "e").first().peak == 0


def test_worst_state_and_best_by(spark):
    df = spark.createDataFrame([("a", "completed"), ("a", "failed"), ("b", "completed"), ("c", None), ("c", "odd")], "k string, s string")
    got = {r.k: (r.worst, r.n, r.failed) for r in rollups.worst_state(df, ["k"], "s").collect()}
    assert got == {"a": ("failed", 2, 1), "b": ("completed", 1, 0), "c": ("unknown", 2, 0)}
    sizes = spark.createDataFrame([("u", 1, 5.0), ("u", 1, 5.0), ("u", 2, 5.0), ("u", 2, 5.0), ("u", 3, 9.0)], "k string, size int, v double")
    assert [tuple(r) for r in rollups.best_by(sizes, ["k"], "size", F.col("v"), 2).collect()] == [("u", 1, 5.0)]
    with pytest.raises(ValueError, match="add up"):
        rollups.weighted({"a": (F.lit(1.0), 0.5)})


def test_touched_counters(spark):
    table = spark.createDataFrame([("x", 1, at(0)), ("y", None, None), (None, 3, at(0))], "k string, n int, seen timestamp")
    asked = spark.createDataFrame([("x", at(1)), ("x", at(2)), ("z", at(1)), (None, at(5))], "k string, t timestamp")
    got = {r.k: (r.n, r.seen) for r in rollups.touched(table, asked, "k", "n", "seen", "t").collect()}
    assert got == {"x": (3, at(2)), "y": (0, None), None: (3, at(0))}


def test_responses(spark):
    texts = ['[{"library_id": "/a/b", "name": "B"}, {"id": "/c/d", "title": "D"}]', '{"items": [{"library_id": "/e/f"}]}', '{"library_id": "/g/h", "trust_score": 7.5, "stars": 3}', '{"unexpected": 1}', "no json", "[]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {(r.i, r.library_id, r.name, r.trust_score) for r in readers.search_rows(df, "t", ["i"]).collect()} == {(0, "/a/b", "B", None), (0, "/c/d", "D", None), (1, "/e/f", None, None), (2, "/g/h", None, 7.5)}
    docs = spark.createDataFrame([('"quoted \\n text"',), ('{"body": "b"}',), ('{"content": "c", "body": "b"}',), ('{"other": 1}',), ("plain",), (None,)], "t string")
    assert [r.x for r in docs.select(readers.response_text(F.col("t")).alias("x")).collect()] == ["quoted \n text", "b", "c", '{"other": 1}', "plain", None]


def test_broken_json_is_mended(spark):
    texts = ['{"a": "he said "hi" to me", "b": [1, 2,],}', '{"a": "x\\"y"}', '{"a": }', "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.try_variant_get(documents.parsed(F.col("t")), "$.a", "string").alias("a"))
    assert [r.a for r in df.collect()] == ['he said "hi" to me', 'x"y', None, None, None]


def test_keyed_store_rewrites_only_touched_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, at int")
    writers.write_upsert(rows(*[(f"k{i}", i, 1) for i in range(200)]), path, ["k"], ["at"])
    writers.write_upsert(rows(("k7", 70, 2), ("k7", 60, 0), ("new", 1, 1)), path, ["k"], ["at"])
    got = {r.k: r.v for r in readers.read_current(spark, path).collect()}
    assert got["k7"] == 70 and got["new"] == 1 and len(got) == 201
    assert len(list((tmp_path / "store" / "run-000000001").glob("_bucket=*"))) <= 2
    (tmp_path / "store" / "run-000000002" / "_bucket=3").mkdir(parents=True)  # of a merge that failed
    assert readers.read_current(spark, path).count() == 201
    assert writers.vacuum(spark, path) == 0
    writers.write_upsert(rows(*[(f"k{i}", -i, 3) for i in range(200)], ("new", 2, 3)), f"{path}2", ["k"], ["at"])
    writers.write_upsert(rows(*[(f"k{i}", i, 4) for i in range(200)], ("new", 2, 4)), f"{path}2", ["k"], ["at"])
    assert writers.vacuum(spark, f"{path}2") == 1 and {r.v for r in readers.read_current(spark, f"{path}2").where("k = 'k9'").collect()} == {9}


def test_backup_has_a_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, at(0)), (2, at(5)), (3, None)], "i int, t timestamp")
    assert writers.incremental_backup(df, "t", F.lit(at(1)), f"file://{tmp_path}/b") == 1
    assert writers.incremental_backup(df, "t", F.lit(at(9)), f"file://{tmp_path}/b") == 0
    assert sorted((r.rows, r.first) for r in readers_manifest(spark, tmp_path)) == [(0, None), (1, at(5))]


def readers_manifest(spark, tmp_path):
    rows = writers.read_manifest(spark, f"file://{tmp_path}/b").collect()
    return [type("M", (), {"rows": r["rows"], "first": r["first"]}) for r in rows]


def test_postings_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "apple pie apple"), (2, "Pie!"), (3, None), (4, ""), (None, "apple"), (5, "x" * 100_000)], "doc_id int, text string")
    index = search.Postings(docs)
    got = {r.doc_id: r.score for r in index.bm25(["apple", "APPLE", "pie"]).collect()}
    assert set(got) == {1, 2} and got[1] > got[2] > 0 and index.n == 5
    assert index.bm25(["absent"]).isEmpty()
    with pytest.raises(ValueError):
        index.bm25(["two words"])
    assert search.Postings(docs.limit(0)).bm25(["apple"]).isEmpty()


def test_cells_hold_every_row_and_hot_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(search, "ROW_BLOCK", 16)
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    rows = [(i, [1.0, 0.001 * (i % 7)] if i % 3 else [0.0, 1.0 + i]) for i in range(90)] + [(200, None), (201, [0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id int, embedding array<double>, cell string")
    index = search.CellIndex(df)
    assert index.read().count() == 90
    asked = df.where("vec_id < 20")
    exact = {(r.query_id, r.match_id, r["rank"]) for r in search.top_k_batch(asked, df, 5, query_block=4, row_block=16).collect()}
    assert {(r.query_id, r.match_id, r["rank"]) for r in index.search(asked, 5, len(index.centroids)).collect()} == exact and len(exact) == 100
    assert search.recall_of(index.search(asked, 5, len(index.centroids)), search.top_k_batch(asked, df, 5)).first().recall == 1.0


def test_scores_of_unsound_vectors_and_ties(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id int, embedding array<float>")
    assert [(r.vec_id, round(r.score, 6), r["rank"]) for r in search.top_k(df, [1.0, 0.0], 2).collect()] == [(1, 1.0, 1), (3, 1.0, 2)]
    assert search.top_k(df, [0.0, 0.0], 2).isEmpty() and search.top_k(df.limit(0), [1.0, 0.0], 2).isEmpty()


def test_fusions(spark):
    sem = spark.createDataFrame([(1, 0.9), (2, 0.5)], "doc_id int, score double")
    kw = spark.createDataFrame([(2, 4.0), (3, 8.0)], "doc_id int, score double")
    docs = spark.createDataFrame([(1, "Apple tree"), (2, None)], "doc_id int, text string")
    as_dict = lambda df: {r.doc_id: round(r.score, 6) for r in df.collect()}
    assert as_dict(search.fuse_by_words(sem, docs, ["apple", "pie"])) == {1: 0.78, 2: 0.35}
    assert as_dict(search.fuse_raw(sem, kw)) == {1: 0.63, 2: 1.55}
    assert as_dict(search.fuse_both(sem, kw)) == {1: 0.9, 2: 1.9, 3: 8.0}
    assert as_dict(search.scaled(kw)) == {2: 0.0, 3: 1.0} and as_dict(search.scaled(kw.limit(1))) == {2: 1.0}
    assert [search.clamped(n) for n in (-1, 7, 99)] == [1, 7, 50]
    boost = spark.range(1).select(search.popularity_boost(F.lit(1.0), F.lit(9.0), F.lit(10), F.lit(5000)).alias("x"), search.popularity_boost(F.lit(1.0), F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("y")).first()
    assert round(boost.x, 6) == 1.4 and boost.y == 1.0


def test_chunkers():
    text = "Intro.\n## One\nbody one\n* a\n* b\n1. x\n| t |\n\nPara two"
    parts = chunking.structured(text, 4)
    assert parts[0] == "Intro." and all(len(p.split()) <= 4 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())
    assert chunking.structured("no structure here", 2) == chunking.narrative("no structure here", 2)
    assert chunking.sentences("One two. Three four. Five six.", 4) == ["One two. Three four.", "Three four. Five six."]
    assert chunking.sentences("One two. Three four.", 2) == ["One two.", "Three four."] and chunking.sentences("", 5) == []


def test_shapes_and_maps(spark):
    df = spark.createDataFrame([("a", '{"some_key": {"x": 1}, "camelCase": "a longer text", "n": 1}'), ("b", "text"), ("c", None), ("d", "{}")], "i string, t string")
    assert [tuple(r) for r in documents.key_metrics(df, "i", "t").collect()] == [("a", 3, 1, 1, 1, 1)]
    m = spark.range(1).select(documents.merged_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"), documents.merged_maps(F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,string>")).alias("n")).first()
    assert m.m == {"a": "1", "b": "3"} and m.n == {}
    lists = spark.createDataFrame([("l", '[{"entry_id": "1", "title": "A"}, {"entry_id": "2"}]'), ("m", "broken"), ("n", "[]")], "k string, j string")
    assert {tuple(r) for r in documents.exploded_list(lists, ["k"], "j", "entry_id string, title string").collect()} == {("l", "1", "A"), ("l", "2", None)}


def test_quality(spark):
    whole = '{"metadata": {"name": "n", "version": "1", "description": "d"}, "installation": "pip install x", "examples": "`code one`", "getting_started": "usage"}'
    df = spark.createDataFrame([("good", whole), ("poor", "Brief content."), ("none", None)], "i string, t string")
    got = {r.i: r for r in quality.quality_dimensions(df, "i", "t").collect()}
    assert set(got) == {"good", "poor"} and got["good"].overall > got["poor"].overall >= 0 and abs(got["good"].metadata - 0.6) < 1e-9
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(quality.pair_similarity(F.col("a"), F.col("b"))).first()[0]
    assert round(pair("red apple", "red apple"), 9) == 1 and pair("red", None) == 0 and 0 < pair("python data science", "python machine learning") < 1


def test_entry_cascade(spark):
    rows = [
        ("1", "/a", "How to read all the files of one folder here", "d1", "content one", "documentation"),
        ("2", "/a", "How to read all the files of one folder here", "d2", "content two", "documentation"),  # title
        ("3", "/a", "Other", "a b c d e f g h i", "content three", "documentation"),
        ("4", "/a", "Other", "a b c d e f g h i j", "content four", "documentation"),  # title and description
        ("5", "/a", "Fourth", "x", "content three", "documentation"),  # content
        ("6", "/b", "Other", "a b c d e f g h i", "content three", "documentation"),  # another library
        (None, "/a", "Other", "d", "content three", "documentation"), ("8", None, "Other", "d", None, None),
    ]
    df = spark.createDataFrame(rows, "entry_id string, library_id string, title string, description string, content string, entry_type string")
    assert {r.entry_id for r in dedup.entry_cascade(df, "library_id", "entry_id").collect()} == {"1", "3", "6", None, "8"}


def test_texts(spark):
    one = lambda f, *args: spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args)))).select(f(*[F.col(f"c{i}") for i in range(len(args))])).first()[0]
    assert one(X.entry_type, "Code part", None, None) == "code_snippet" and one(X.entry_type, None, None, "how to do it") == "tutorial" and one(X.entry_type, None, None, None) == "documentation"
    assert one(X.name_domain, "requests") == "web" and one(X.name_domain, "pandas") == "data" and one(X.name_domain, None) == "general"
    assert one(X.code_examples, None) == 0 and one(X.code_examples, ">>> a\n`b`") == 2
    assert one(lambda c: X.cut_words(c, 2), "a  b c") == "a b" and one(lambda c: X.cut_words(c, 5), "a  b c") == "a  b c"
    assert one(X.description_lines, "t\n a \nb") == "a b" and one(X.description_lines, None) is None
    assert one(lambda c: dedup.word_shingles(c, 2), "A b c") == ["a b", "b c"] and one(lambda c: dedup.word_shingles(c, 5), "A b") == ["a b"] and one(dedup.word_shingles, None) == []


def test_percentiles_of_nothing(spark):
    assert statistics.nearest_rank(spark.createDataFrame([("k", None)], "k string, v double"), ["k"], "v", {"p": 0.5}).isEmpty()
