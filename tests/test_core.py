"""Operators of the library on small inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import hashing as H, text as X, vectors as V
from quillgrid.operators import chunking, dedup, documents, relational, search, statistics, tables
from quillgrid.operators.filters import apply_filter
from quillgrid.operators.graph import connected_components
from quillgrid.sources import readers, writers
from quillgrid.streaming import jobs


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "f, text, want",
    [
        (X.section_type, "def example():\n    return True", "code"),
        (X.section_type, "GET /api/v1/users\nReturns list of users", "api"),
        (X.section_type, "This is a comprehensive guide to using the library.", "text"),
        (X.section_type, None, "text"),
        (X.code_language, "import numpy as np\ndef function(): pass", "python"),
        (X.code_language, "function example() { return true; }", "javascript"),
        (X.code_language, "nothing here", None),
        (X.content_type, "Step 1: open it\nStep 2: close it", "tutorial"),
        (X.content_type, "", "documentation"),
        (X.sanitized_id, "normal/library", "normal_library"),
        (X.sanitized_id, "lib:with<>chars", "lib_with_chars"),
        (X.sanitized_id, "lib..with...dots", "lib.with.dots"),
        (X.sanitized_id, "  ", "unknown_library"),
        (X.sanitized_id, "CON", "CON_lib"),
        (X.word_count, " a  b\n", 2),
        (X.word_count, None, 0),
        (X.line_count, "", 1),
        (X.sentence_count, "A. B! C?!", 3),
        (X.token_estimate, "abcd" * 5, 5),
        (X.readability, " ", 0.0),
        (X.error_kind, "Connection refused", "network"),
        (X.error_kind, None, None),
        (X.first_line_title, "# head\n  a telling first line\n", "a telling first line"),
        (H.xxh64_hex, "a", "d24ec4f1a98c6e5b"),
        (H.xxh64_hex, None, None),
    ],
)
def test_text_functions(spark, f, text, want):
    assert one(spark, f, text) == want


def test_long_ids_are_cut(spark):
    assert len(one(spark, X.sanitized_id, "x" * 150)) == 89


@pytest.mark.parametrize("n, want", [(None, "-"), (0, "-"), (999, "999"), (1_000, "1.0K"), (1_299_999, "1.2M")])
def test_compact_numbers(spark, n, want):
    assert spark.createDataFrame([(n,)], "n bigint").select(X.compact_number(F.col("n"))).first()[0] == want


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["a"], ["a"]), ([], ["a"]), (None, ["a"])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [0.333333, 1.0, 0.0, 0.0]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0, 1.0]), ([float("nan"), 1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.vector_problem(F.col("a"), 2).alias("p")).collect()
    assert round(rows[0].c, 6) == 0.707107 and [rows[i].c for i in (1, 2, 3)] == [None] * 3
    assert [r.p for r in rows] == [None, "norm", "dimension", "missing", "nan"]


def test_filters(spark):
    df = spark.createDataFrame([(1, "api", ["x", "y"]), (2, "guide", ["x"]), (3, None, None)], "id int, kind string, tags array<string>")
    ids = lambda f, **k: [r.id for r in apply_filter(df, f, **k).orderBy("id").collect()]
    assert ids({"kind": "api"}) == [1] and ids({"kind": ["api", "guide"]}) == [1, 2] and ids({"kind": ["api", "guide"]}, list_mode="all") == []
    assert ids({"tags": "x"}) == [1, 2] and ids({"tags": ["x", "y"]}, list_mode="all") == [1] and ids({"id": {"gt": 1, "lte": 3}}) == [2, 3]
    assert ids({"kind": None}) == [3] and ids(None) == [1, 2, 3] and ids({"kind": []}) == []
    with pytest.raises(ValueError):
        apply_filter(df, {"other": 1})


def test_filter_reaches_the_scan(spark, sf):
    plan = search.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), [1.0] * 64, 5, {"label": {"gte": 3}})._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(label,3)" in plan and "TakeOrderedAndProject" in plan


def test_approximate_search_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.match_id) for r in search.top_k_batch(asked, vectors, 10).collect()}
    index = search.CellIndex(vectors)
    found = index.search(asked, 10, index.tune_probes(asked, 10, 0.97))
    near = {(r.query_id, r.match_id) for r in found.collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_search_of_empty_and_unsound_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in search.top_k(df, [1.0, 0.0], 5).collect()] == [1]
    assert search.more_like_this(df, 99, 5).count() == 0
    assert search.top_k_batch(df.limit(0), df, 3).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 1), (200, 201), (201, 202), (200, 202)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}
    star = spark.createDataFrame([(0, i) for i in range(1, 2000)], "a bigint, b bigint")
    assert connected_components(star).where("component = 0").count() == 2000
    assert connected_components(star.limit(0)).count() == 0


def test_scratch_tables(spark):
    from quillgrid.plans import materialize as M

    one, two = (M.materialize(spark.range(n).toDF("n"), "scratch") for n in (3, 4))
    M.drop_scratch(one)
    assert two.count() == 4
    with pytest.raises(Exception):
        one.count()


def test_similar_pairs_are_complete(spark):
    texts = ["a b c d e f", "a b c d e g", "a b c d", "x y z", "x y z", "", None, "q"]
    rows = [(i, "k", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, k string, t string")
    got = {(r.a, r.b) for r in dedup.similar_pairs(df, ["k"], "id", "t", 0.6).collect()}
    own = dedup.word_sets(df, ["k"], "id", dedup.space_words(F.col("t")))
    assert {(r.id, r.class_id) for r in own.collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (7, 7)}
    groups = dedup.similar_groups(own, dedup.similar_classes(own, ["k"], 0.6))
    assert {(r.id, r.component) for r in groups.collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)}
    kept = dedup.representatives(df, groups, "id", F.length("t"))
    assert {r.id for r in kept.collect()} == {0, 3, 5, 6, 7}
    sets = {i: set(t.split()) for i, _, t in rows if t and i != 4}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}


def test_keep_best_and_diverse(spark):
    df = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 7.0), ("k", 3, 7.0), ("z", 4, None), (None, 5, 1.0)], "k string, id int, s double")
    assert {r.id for r in dedup.keep_best(df, ["k"], F.col("s"), ["id"]).collect()} == {2, 4, 5}
    texts = spark.createDataFrame([("p", 1, "a b c d"), ("p", 2, "a b c e"), ("p", 3, "x y"), ("p", 4, None), ("q", 5, "a b c d")], "g string, n int, t string")
    assert {r.n for r in dedup.keep_diverse(texts, ["g"], "n", "t").collect()} == {1, 3, 5}


def test_chunking(spark):
    text = "Intro words here. More of them.\n\n```python\ndef f():\n    return 1\n```\n\nThe End of it."
    df = spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "GET /a\nx\nPOST /b\ny"), (5, "word. " * 900)], "doc_id int, t string")
    rows = chunking.chunk_documents(df, "doc_id", "t").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 4, 5} and by[1][0].strategy == "mixed" and [r.content for r in by[4]] == ["GET /a\nx", "POST /b\ny"]
    assert all(r.total_chunks == len(by[r.doc_id]) for r in rows) and len(by[5]) <= 900 // (200 - 40) + 1
    assert chunking.fixed_chunks(df, "doc_id", "t", 200).where("doc_id = 5").count() == 5
    assert "".join(r.content for r in by[1]).count("```") == 2


def test_tables(spark):
    t = lambda n: datetime.datetime(2026, 1, n)
    base = spark.createDataFrame([("a", 1, t(1)), ("b", 2, t(1))], "k string, v int, at timestamp_ntz")
    changes = spark.createDataFrame([("a", 9, t(3)), ("a", 5, t(2)), ("c", 3, t(1))], "k string, v int, at timestamp_ntz")
    assert {tuple(r)[:2] for r in tables.upsert(base, changes, ["k"], ["at"]).collect()} == {("a", 9), ("b", 2), ("c", 3)}
    gone = spark.createDataFrame([("a", 9, t(3), True)], "k string, v int, at timestamp_ntz, gone boolean")
    assert {r.k for r in tables.apply_changes(base, gone, ["k"], ["at"], "gone").collect()} == {"b"}
    assert {r.k for r in tables.delete_where(base, F.col("v") > 1).collect()} == {"a"}
    many = spark.createDataFrame([(i, i % 3, i) for i in range(20)], "id int, c int, at int")
    assert {r.id for r in tables.evict_least_used(many, "at", "c", "id", 10).collect()} == set(range(12, 20))
    assert sorted((r.id, r.batch_id) for r in tables.batches(many, "id", 6).collect()) == [(i, i // 6) for i in range(20)]


def test_statistics(spark):
    df = spark.createDataFrame([("k", i, float(i)) for i in range(1, 11)] + [("n", 1, None)], "k string, i int, v double")
    assert statistics.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()[0][1:] == (10, 6.0, 10.0)
    row = statistics.trend(df, ["k"], ["i"], "v").where("k = 'k'").first()
    assert row.trend == "increasing" and round(row.slope, 6) == 1.0
    ema = 1.0
    for i in range(2, 11):
        ema = 0.8 * ema + 0.2 * i
    assert round(statistics.moving_average(df, ["k"], "i", "v").where("k = 'k'").first().ema, 9) == round(ema, 9)


def test_joins(spark):
    points = spark.createDataFrame([("u", 5), ("u", 10), ("u", None), ("w", 5)], "k string, at int")
    ranges = spark.createDataFrame([("u", 0, 10, "r1"), ("u", 10, 95, "r2"), ("u", 7, 7, "empty")], "k string, a int, b int, name string")
    got = {(r.at, r.name) for r in relational.interval_join(points, ranges, ["k"], "at", "a", "b", 10).collect()}
    assert got == {(5, "r1"), (10, "r2")}
    left = spark.createDataFrame([("u", 1), ("u", 5), ("w", 5)], "k string, t int")
    right = spark.createDataFrame([("u", 2, "x"), ("u", 5, "y"), ("u", 6, "z")], "k string, t2 int, name string")
    assert {tuple(r) for r in relational.as_of_join(left, right, ["k"], "t", "t2", ["name"]).collect()} == {("u", 1, None), ("u", 5, "y"), ("w", 5, None)}
    assert relational.salted_join(left, right, ["k"]).count() == 6


def test_documents(spark):
    rows = [("1", '{"contexts": [], "library_info": {}}'), ("2", '{"name": 1, "version": 2, "description": 3}'), ("3", '{"text": "x"}'), ("4", '{"zz": 1}'), ("5", "plain"), ("6", None)]
    df = spark.createDataFrame(rows, "id string, t string")
    shapes = [r[0] for r in df.orderBy("id").select(documents.document_shape(F.col("t"))).collect()]
    assert shapes == ["tool_output", "standard_library", "generic_documentation", "unknown", "raw_text", "raw_text"]
    nested = spark.createDataFrame([("1", '{"usage": {"intro": "How to use", "more": ["one", "two"]}, "name": "x", "bad": 1,}'), ("2", "plain text"), ("3", None)], "id string, t string")
    found = {(r.doc_id, r.name): r.content for r in documents.sections(nested, "id", "t").collect()}
    assert found == {("1", "usage.intro"): "How to use", ("1", "usage.more[0]"): "one", ("1", "usage.more[1]"): "two", ("2", "content"): "plain text"}
    block = "TITLE: The name\nDESCRIPTION: two\nlines\nLANGUAGE: Python\nCODE:\nx = 1\n"
    r = documents.entry_fields(spark.createDataFrame([("1", block), ("2", "prose")], "id string, c string"), "id", "c").collect()
    assert len(r) == 1 and (r[0].title, r[0].description, r[0].language, r[0].code, r[0].source) == ("The name", "two\nlines", "python", "x = 1", None)
    text = "=" * 20 + "\nSNIPPETS\n" + "=" * 20 + "\nfirst entry of twenty characters\n" + "-" * 30 + "\nsecond entry of twenty characters\n" + "=" * 20 + "\nQA\n" + "=" * 20 + "\nthird entry of twenty characters"
    cut = documents.split_entries(spark.createDataFrame([("1", text), ("2", None)], "id string, t string"), "id", "t").orderBy("entry_no").collect()
    assert [(r.section, r.entry_no, r.entry.split()[0]) for r in cut] == [("SNIPPETS", 0, "first"), ("SNIPPETS", 1, "second"), ("QA", 2, "third")]


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"name": "x", "content": "c",}')
    (folder / "b.txt").write_text("just text")
    (folder / "c.json").write_text('{"broken": ')
    docs = readers.read_documents(spark, str(folder))
    good, corrupt = readers.split_corrupt(docs)
    assert good.count() == 1 and corrupt.count() == 2
    assert {r.format for r in readers.read_quality_documents(spark, str(folder)).collect()} == {"json", "text"}
    assert readers.read_checked(spark, str(folder)).where("is_gzip").count() == 0
    store = str(tmp_path / "store")
    at = lambda n: F.lit(f"2026-01-0{n} 00:00:00.5").cast("timestamp")
    df = spark.createDataFrame([("/l", "old"), ("/m", "x")], "library_id string, text string")
    writers.write_version(df, store, at(1))
    writers.write_version(df.withColumn("text", F.lit("new")), store, at(2))
    assert [r.text for r in readers.read_version(spark, store, "/l").collect()] == ["new"]
    assert readers.list_versions(spark, store).count() == 4 and readers.read_version(spark, store, "/none").count() == 0
    table = str(tmp_path / "table")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int, at int")
    writers.write_upsert(rows(("a", 1, 1), ("a", 2, 2)), table, ["k"], ["at"])
    writers.write_upsert(rows(("a", 0, 1), ("b", 5, 1)), table, ["k"], ["at"])
    assert {tuple(r)[:2] for r in readers.read_current(spark, table).select("k", "v").collect()} == {("a", 2), ("b", 5)}
    sums = writers.write_json_checked(df, str(tmp_path / "json"), "library_id")
    assert sums.where("bytes > 0 and length(sha256) = 64").count() == 2
    assert readers.read_json_lines(spark, str(tmp_path / "json"), "library_id string, text string").count() == 2


def test_stream_windows_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, k string, v int"
    t = lambda h, m=0: datetime.datetime(2026, 1, 1, h, m)
    for i, rows in enumerate([[(t(1), "a", 1), (t(5), "a", 2)], [(t(9), "b", 1)], [(t(1, 30), "a", 9), (t(12), "b", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = jobs.event_stream(spark, str(tmp_path / "in/*"), schema, files_per_trigger=1)
    out = jobs.run_to_table(jobs.windowed(stream, ["k"], "ts", "1 hour", None, "30 minutes", {"n": F.count("*")}), "late")
    assert {(r.window_start.hour, r.k, r.n) for r in out.collect()} >= {(1, "a", 1)}


def test_neighbours_across_partitions_and_percentiles_of_ties(spark):
    """One document of nearly all rows, cut into several partitions; a key of one value; keys that are null."""
    n = 3000
    df = spark.range(n).select(F.when(F.col("id") < n - 5, "hot").otherwise(F.lit(None)).alias("d"), F.col("id").alias("p"), F.concat(F.lit("c"), "id").alias("c"))
    rows = {r.p: r for r in chunking.with_neighbours(df.repartition(7), "d", "p", "c", F.lit(1)).collect()}
    assert len(rows) == n and rows[0].previous_id is None and rows[n - 6].next_id is None and rows[n - 5].previous_id is None and rows[0].total == n - 5
    assert all(rows[i].previous_id == f"c{i - 1}" and rows[i - 1].next_id == f"c{i}" for i in range(1, n) if i != n - 5)
    values = df.select(F.lit(None).cast("string").alias("k"), F.when(F.col("p") % 3 == 0, 7.0).otherwise(F.col("p") * 1.0).alias("v"))
    got = statistics.nearest_rank(values, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()
    want = sorted(7.0 if i % 3 == 0 else float(i) for i in range(n))
    assert [tuple(r) for r in got] == [(None, n, want[0], want[1500], want[2850], want[-1])]


def test_sections_at_any_depth(spark):
    deep = '{"a": ' * 8 + '"the deepest text"' + "}" * 8
    got = documents.sections(spark.createDataFrame([("x", deep), ("y", '["one text", {"b": "two"}]'), ("z", "plain")], "i string, t string"), "i", "t").collect()
    assert {(r.doc_id, r.name, r.level) for r in got} == {("x", ".".join("a" * 8), 7), ("y", "[0]", 0), ("y", "[1].b", 1), ("z", "content", 0)}
