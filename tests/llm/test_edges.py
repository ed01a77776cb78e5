"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import bisect
import datetime

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import batch_history, boilerplate, canonical, entry, likeness, near_duplicates, packing, subjects, token_budget, tokenizer
from quillgrid.operators import graph
from quillgrid.operators.graph import connected_components

LONG = " ".join(f"word{i}" for i in range(200_000))
ENTRY = "entry_id string, title string, content string, flat string, h1 string, node string, words string"


@pytest.fixture(scope="module")
def entries(spark):
    fields = "TITLE: A b\nDESCRIPTION: some text here\nCODE: x = 1"
    moved = "code: X=1\r\n  Title: a-B\r\ndescription: Some text, here!"
    rows = [
        ("e1", "One", fields), ("e2", "one!", moved), ("e3", "One", fields), ("e3", "One", fields),
        ("e4", "J", '{"b": {"y": 1, "x": [1, 2]}, "a": "T"}'), ("e5", "j", '{"A": "t", "B": {"X": [1,2], "Y": 1}}'), ("e6", "j", '{"A": "t", "B": {"X": [2,1], "Y": 1}}'),
        ("e7", None, "some text"), ("e8", " ", "some text"), ("e9", "t", None), ("e10", "t", ""), ("e11", "t", "  \n"), (None, "t", "some text"),
        ("e12", "L", LONG), ("e13", "l", LONG.upper()), ("e14", "L", LONG + " more"), ("e15", "t", "\n" * 50_000 + "x"), ("e16", "q", "two words"), ("e17", "r", "Two, words"),
    ]
    return rows, spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], ENTRY)


def test_formatting_groups(entries):
    rows, df = entries
    groups = canonical.formatting_groups(df)
    assert {tuple(r) for r in canonical.copies_found(groups).collect()} == brute.p1(rows) == {("e1", "e2"), ("e1", "e3"), ("e4", "e5"), ("e12", "e13")}
    counts = {r.first_id: r.copies for r in canonical.copy_counts(groups).collect()}
    assert counts["e1"] == 3 and counts["e6"] == 1 and "e7" not in counts and "e11" not in counts


def test_one_flat_form_with_several_ordered_ones(spark):
    fields, moved = "TITLE: a\nCODE: b", "CODE: b\nTITLE: a"
    rows = [("1", "t", fields), ("2", "t", moved), ("3", "t", fields.replace("\n", " ")), ("4", "t", moved.replace("\n", " "))]
    df = spark.createDataFrame(rows, "entry_id string, title string, content string")
    assert {tuple(r) for r in canonical.copies_found(canonical.formatting_groups(df)).collect()} == {("1", "2"), ("1", "3"), ("1", "4")}


def test_json_of_any_depth(spark):
    """Objects nested 20,000 levels deep are ordered like others; broken ones aren't objects."""
    deep = lambda inner, n: '{"b": 1, "a": ' * n + inner + "}" * n
    for text in ('{"b": {"y": 1, "x": [1, 2.50, "a_b"]}, "a": "T"}', '{"a": [], "b": {}, "c": [{"z": null, "y": true}]}', deep('"x"', 30), '{"a" 1}', '{"a": 1,}', "[1]", '{"a": 1} 2', '{"a": tru}', '{"k": "\\u00e9"}', "{}", '{"a": [1,]}'):
        assert canonical._ordered_deep(text) == canonical.ordered_json(text), text
    one, two = deep('{"d": 1, "c": "X"}', 20_000), deep('{"c": "x", "d": 1}', 20_000)
    assert canonical.ordered_json(one) == canonical.ordered_json(two) is not None and canonical.ordered_json(one[:-1]) is None
    df = spark.createDataFrame([("1", "t", one), ("2", "T", two)], "entry_id string, title string, content string")
    assert {tuple(r) for r in canonical.copies_found(canonical.formatting_groups(df)).collect()} == {("1", "2")}


@pytest.mark.parametrize("hot_list", [2_000, 2])
def test_near_duplicates(entries, monkeypatch, hot_list):
    rows, df = entries
    monkeypatch.setattr(near_duplicates, "HOT_LIST", hot_list)
    found = near_duplicates.near_duplicate_groups(df)
    assert {tuple(r) for r in near_duplicates.groups_found(found).collect()} == brute.p5(rows)
    assert {r.id for r in found.collect()} == {"e1", "e2", "e3", "e4", "e5", "e6", "e7", "e8", "e12", "e13", "e14", "e15", "e16", "e17"}


def _varied(n, seed=1):
    """Texts of a few families, each a chain of small edits, with many copies of one text."""
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        base = [f"f{i % 7}w{k}" for k in range(60)]
        for _ in range(int(rng.integers(0, 4))):
            base[int(rng.integers(0, 60))] = f"edit{rng.integers(0, 1000)}"
        out.append((f"{i:04d}", "t", " ".join(base) if i % 3 else "the same text stands in a third of all rows of this table"))
    return out


@pytest.mark.parametrize(("hot_list", "bits"), [(2_000, 20), (3, 20), (3, 3), (2_000, 0)])
def test_near_duplicates_with_hot_lists_lose_nothing(spark, hot_list, bits):
    """Short and long lists, a sketch that is full (8 counters), and one that tells nothing (1 counter)."""
    rows = _varied(240)
    df = spark.createDataFrame(rows, "entry_id string, title string, content string")
    signed = likeness.with_signatures(df.withColumn("text_hash", F.xxhash64("content")), "content", ("entry_id", "text_hash"))
    classes = near_duplicates.text_classes(signed, "entry_id")
    links = near_duplicates.alike_classes(classes, df, "entry_id", "content", hot_list=hot_list, bits=bits)
    name = {r.node: r.first for r in classes.collect()}
    c = brute.Components()
    for r in links.collect():
        c.join(name[r.a], name[r.b])
    want = brute.Components()
    sets = {}
    for e, _, x in rows:
        sets.setdefault(brute.shingles(x), e)
    for a, b in brute.alike_pairs({e: s for s, e in sets.items()}):
        want.join(a, b)
    assert brute.groups(c) == brute.groups(want)


def test_a_long_list_costs_its_members_not_their_square(spark):
    """20,000 members of one list, all but 50 in one component: pairs are those of the 50 with the others."""
    n = 20_000
    hot = spark.range(n).select(F.lit(1).cast("bigint").alias("key"), F.col("id").alias("node"), F.lit(0).cast("bigint").alias("b1"), F.lit(0).cast("bigint").alias("b2"))
    edges = spark.range(1, n - 50).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    pairs = near_duplicates.apart(hot, connected_components(edges), 14)
    assert pairs.count() == 50 * (n - 50) + 50 * 49 // 2
    assert near_duplicates.apart(hot, connected_components(spark.range(1, n).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))), 14).isEmpty()


def test_likeness_is_exact(spark):
    rows = [("1", "a b c d e", "a b c d e"), ("2", "a b c d e", "A-b_c d f"), ("3", "x", "x"), ("4", "x y", "x y"), ("5", "x y", "y x"), ("6", "é ß ü", "É SS Ü")]
    df = spark.createDataFrame(rows, "id string, a string, b string").select("id", likeness.words(F.col("a")).alias("words_a"), likeness.words(F.col("b")).alias("words_b"))
    got = {r.id: round(r.likeness, 6) for r in likeness.exact_likeness(df, ("id",), 0.0).collect()}
    assert got == {"1": 1.0, "2": 0.5, "3": 1.0, "4": 1.0, "5": 0.0, "6": 1.0}


@pytest.mark.parametrize(("hot_range", "links"), [(2_000, 10_000), (3, 10_000), (3, 2)])
def test_batch_duplicates(spark, monkeypatch, hot_range, links):
    monkeypatch.setattr(batch_history, "HOT_RANGE", hot_range)
    monkeypatch.setattr(graph, "COMPONENT_LINKS", links)
    day = lambda n: None if n is None else datetime.datetime(2026, 2, 25) + datetime.timedelta(days=n)
    a = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, day(0), a), (2, day(1), a.upper()), (3, day(9), a + " more"), (4, day(9), "another text of some words"), (5, day(10), "another text, of some words"), (6, day(8), None), (7, None, a), (8, day(8), ""), (9, day(11), "x"), (10, day(12), "X!"), (None, day(9), a), (3, day(9), a + " more"), (11, day(13), LONG), (12, day(14), LONG + " z")]
    rows += [(100 + i, day(20 + i), " ".join(f"w{k}" for k in range(i, i + 30))) for i in range(12)]  # a chain: acceptance depends on the order
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "cache_id bigint, created_at timestamp_ntz, content string, turn string, node int")
    found = batch_history.found_pairs(batch_history.batch_duplicates(df, "2026-03-01 00:00:00"))
    want = brute.p2(list(dict.fromkeys(rows)), datetime.datetime(2026, 3, 1))
    assert {tuple(r) for r in found.collect()} == want and (1, 3) in want and (9, 10) in want


def test_history_goes_on_batch_by_batch(spark, sf, monkeypatch):
    """Batches checked one after the other, by a history that is opened again each time, give what one check gives."""
    jobs = spark.read.parquet(f"{sf}/ingestion_job.parquet")
    texts = spark.read.parquet(f"{sf}/embedding_cache.parquet").select("cache_id", "job_id", "content")
    rows = batch_history.with_job_time(texts, jobs)
    monkeypatch.setattr(batch_history, "MERGE_RUNS", 2)  # so the last batch reads a merged run
    monkeypatch.setattr(batch_history, "BUCKET_CLASSES", 16)
    monkeypatch.setattr(batch_history, "SLOT_CLASSES", 16)
    borders = ["2026-03-01 00:00:00", "2026-05-01 00:00:00", "2026-06-01 00:00:00", "2027-01-01 00:00:00"]
    at = F.col("job_created_at")
    path = batch_history.AcceptedHistory(spark).path
    batch_history.AcceptedHistory(spark, path).accept_all(rows.where(at < borders[0]), "cache_id", "job_created_at", "content")
    found = set()
    for lo, hi in zip(borders, borders[1:]):
        history = batch_history.AcceptedHistory(spark, path)
        found |= {tuple(r) for r in history.check(rows.where((at >= lo) & (at < hi)), "cache_id", "job_created_at", "content").collect()}
    whole = batch_history.batch_duplicates(rows, borders[0], at="job_created_at")
    assert found == {tuple(r) for r in whole.collect()} and found


def _history(spark, n, monkeypatch):
    monkeypatch.setattr(batch_history, "BUCKET_CLASSES", 50)
    monkeypatch.setattr(batch_history, "SLOT_CLASSES", 10)
    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.xxhash64("id", F.lit(k)).cast("string")) for k in range(12)])
    df = spark.range(n).select(F.col("id").alias("cache_id"), F.lit("2026-01-01").cast("timestamp_ntz").alias("at"), words.alias("content"))
    history = batch_history.AcceptedHistory(spark)
    history.accept_all(df, "cache_id", "at", "content")
    return df, history


def test_a_batch_reads_only_what_it_touches(spark, monkeypatch):
    """A history of ten times as many texts costs a batch of two texts no more bytes of forest or texts."""
    import os

    def size(df):  # of the files that rows come from: the others are pruned by their partition
        return sum(os.path.getsize("/" + r[0].split(":", 1)[-1].lstrip("/")) for r in df.select(F.input_file_name()).distinct().collect())

    read = []
    for n in (100, 800):
        df, history = _history(spark, n, monkeypatch)
        batch = df.where("cache_id < 2")
        signed = likeness.with_signatures(batch, "content", ("cache_id",), short=True, with_words=True)
        classes = near_duplicates.text_classes(signed, "cache_id", keep="words")
        entries = batch_history.forest_entries(classes)
        found = history.forest(entries)
        met = batch_history.meet(entries.withColumn("node", F.col("node") + F.lit(7 << 50)), found, 3)
        assert met.count() == 2 and found.count() < 40 * 200
        assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()
        texts = history.of_nodes("texts", met.select(F.col("b").alias("node")))
        assert texts.count() == 2 and "PartitionFilters: [slot" in texts._jdf.queryExecution().executedPlan().toString()
        read.append(size(found))
    assert read[1] <= 1.5 * read[0]


def test_runs_merge_at_the_historys_path(spark, monkeypatch):
    df, history = _history(spark, 60, monkeypatch)
    for k in (1, 2):
        history.accept_all(df.select((F.col("cache_id") + 100 * k).alias("cache_id"), "at", F.concat("content", F.lit(f" v{k}"))).toDF("cache_id", "at", "content"), "cache_id", "at", "content")
    again = batch_history.AcceptedHistory(spark, history.path)
    before = sorted(map(tuple, again.forest().collect()))
    turn = "struct<at:timestamp_ntz,id:bigint>"
    nodes = spark.createDataFrame(again.forest().select("node").distinct().collect())
    rows = sorted(map(str, again.of_nodes("rows", nodes, turn).select("turn", "node").collect()))
    assert len(again.runs()) == 3 and len(before) == 3 * 60 * batch_history.TREES and len(rows) == 180
    spark.range(1).write.parquet(f"{history.path}/run-000003-000003-0-0-deadbeef/forest")  # of a job that failed
    again.merge(again.runs()[1:], turn)
    assert [(r.first, r.last) for r in batch_history.AcceptedHistory(spark, history.path).runs()] == [(0, 0), (1, 2)]
    again.vacuum()
    assert sorted(map(tuple, again.forest().collect())) == before
    assert sorted(map(str, again.of_nodes("rows", nodes, turn).select("turn", "node").collect())) == rows


def test_a_large_group_of_near_copies_is_not_paired_with_itself(spark, monkeypatch):
    """600 near copies new in one batch: compared with the earliest of their ranges, not with each other."""
    monkeypatch.setattr(batch_history, "HOT_RANGE", 50)
    words = [f"w{k}" for k in range(80)]
    rows = [(i, datetime.datetime(2026, 4, 1), " ".join(words[:j] + [f"own{i}"] + words[j + 1 :])) for i, j in ((i, 5 + i % 70) for i in range(600))]
    df = spark.createDataFrame(rows, "cache_id bigint, created_at timestamp_ntz, content string")
    compared = []
    real = batch_history.compare
    monkeypatch.setattr(batch_history, "compare", lambda pairs, *a: (compared.append(pairs.count()), real(pairs, *a))[1])
    found = {tuple(r) for r in batch_history.found_pairs(batch_history.batch_duplicates(df, "2026-03-01 00:00:00")).collect()}
    assert found == brute.p2(rows, datetime.datetime(2026, 3, 1)) and sum(compared) < 20 * len(rows)


def test_long_chains_are_decided(spark):
    """A chain of 500 links is decided in its component, and so is one that hangs on a decided node."""
    links = [(i + 1, i) for i in range(500)] + [(1000, 0), (1001, 1000), (1002, 1001)]
    earlier = spark.createDataFrame(links, "node bigint, before bigint")
    nodes = earlier.select("node").union(earlier.select("before"))
    for small in (10_000, 1):
        if small == 1:
            earlier, nodes = earlier.where("node < 30"), nodes.where("node < 30")
        got = {r.node: r.accepted for r in graph.first_accepted(nodes, earlier, rounds=3, small=small).collect()}
        assert all(got[i] == (i % 2 == 0) for i in got if i < 1000)
        assert small == 1 or (got[1000], got[1001], got[1002]) == (False, True, False)


def test_forest_meets_pairs_at_the_threshold(spark):
    """Of 20,000 pairs of likeness 0.7 none is lost before the exact comparison (about 20 were when trees shared coordinates)."""
    n = 20_000
    word = lambda k: F.concat(F.lit("p"), "pair", F.lit(f"w{k} "))
    texts = [F.concat(*[word(k) for k in (*range(16), *own)]) for own in ((16, 17, 18), (19, 20, 21))]
    df = spark.range(n).withColumnRenamed("id", "pair").select("pair", F.explode(F.array(*texts)).alias("content"))
    signed = likeness.with_signatures(df.withColumn("text_hash", F.xxhash64("content")), "content", ("pair", "text_hash"))
    classes = near_duplicates.text_classes(signed, "pair")
    entries = batch_history.forest_entries(classes).select("*", F.lit(True).alias("open"), F.lit(False).alias("known"))
    met = batch_history.meet_within(entries, batch_history.prefix_length())
    pair = classes.select("node", F.col("first").alias("pair"))
    same = met.join(pair.toDF("a", "pair"), "a").join(pair.toDF("b", "pair_b"), "b").where("pair = pair_b")
    assert same.select("pair").distinct().count() == n


def test_recall_counts_only_independent_trees(monkeypatch):
    assert batch_history.prefix_length(0.7) == 3 and batch_history.recall_at(3, 0.7, 40, 2) >= batch_history.RECALL
    monkeypatch.setattr(batch_history, "_TREE", np.array([[0, 1, 2, 3]] * 40))  # forty times the same tree
    assert round(batch_history.recall_at(3, 0.7, 40, 1), 6) == 0.343 and batch_history.prefix_length(0.7) == 1


def test_boilerplate(spark):
    t = datetime.datetime(2026, 1, 1)
    note, share = "Copyright by all the authors", "Share this page with friends"
    rows = [(f"d{i}", "/a", f"text {i} of it all\r\n{note}\r\n{share.upper()} {i}\n{note.lower()}", t) for i in range(12)]
    rows += [("d0", "/a", rows[0][2], t + datetime.timedelta(days=1)), ("n", None, note, t), (None, "/a", note, t), ("e", "/a", None, t), ("f", "/a", "", t), ("g", "/a", LONG, t)] + [(f"b{i}", "/b", note, t) for i in range(11)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "id string, library_id string, content string, indexed_at timestamp_ntz, lines string, lines_removed int")
    docs = boilerplate.prepared_documents(df)
    nodes = boilerplate.repeated_lines(docs)
    blocks = boilerplate.library_blocks(docs)
    found = boilerplate.block_occurrences(docs, blocks)
    assert {(r.id, r.line_no) for r in found.collect()} == brute.p3(rows) == {(f"d{i}", k) for i in range(12) for k in (1, 2, 3)}
    assert blocks.count() == 2 and len({r.block for r in found.collect()}) == 1  # consecutive lines are one block
    alone = boilerplate.boilerplate_blocks(nodes, boilerplate.repeated_edges(docs, nodes).limit(0))
    assert len({r.block for r in boilerplate.block_occurrences(docs, alone).collect()}) == 2  # and aren't without edges
    assert boilerplate.block_occurrences(docs, blocks.limit(0)).isEmpty()
    clean = {r.id: (r.content, r.lines_removed) for r in boilerplate.remove_blocks(df, blocks).collect() if r.id is not None}
    assert clean["d3"] == ("text 3 of it all\r", 3) and clean["e"] == (None, 0) and clean["b1"] == (note, 0) and clean["n"] == (note, 0) and clean["f"] == ("", 0)


def test_an_older_row_of_an_id_loses_only_its_own_boilerplate(spark):
    t, note = datetime.datetime(2026, 1, 1), "Copyright by all the authors"
    rows = [(f"d{i}", "/a", f"{note}\nsome text {i}", t) for i in range(12)] + [("d0", "/a", f"first line kept\n{note}\nlast", datetime.datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, "id string, library_id string, content string, indexed_at timestamp_ntz")
    blocks = boilerplate.library_blocks(boilerplate.prepared_documents(df))
    assert {r.content for r in boilerplate.remove_blocks(df, blocks).where("id = 'd0'").collect()} == {"some text 0", "first line kept\nlast"}

def test_token_counts_only_encode_what_is_new(spark):
    counts = token_budget.CountTable(spark, tokenizer.Vocabulary(spark))
    t = datetime.datetime(2026, 1, 1)
    schema = "id string, content string, token_count bigint, indexed_at timestamp_ntz, library_id string, programming_language string, n_tokens int"
    rows = [("a", "hello world", 2, t, "/x", " PY ", 9), ("b", None, 1, t, None, None, 9), ("c", "", 0, t, "/x", "", 9), ("d", LONG, None, t, "/y", "go", 9), ("a", "hello world", 2, t + datetime.timedelta(1), "/x", "py", 9), (None, "x", 1, t, "/x", "py", 9)]
    df = spark.createDataFrame(rows, schema)
    counts.refresh(df, "content")
    assert counts.read().count() == 4
    counts.refresh(df, "content")
    assert counts.read().count() == 4

    def state(df):
        keyed = token_budget.latest_rows(df).withColumn("text_key", token_budget.text_key(F.col("content"))).drop("content")
        alias = spark.createDataFrame([("py", "python"), ("go", "go"), (None, "x")], "alias string, language string")
        info = spark.createDataFrame([("/x", "web"), (None, "y")], "library_id string, category string")
        return token_budget.with_slices(counts.counts_of_keys(keyed), alias, info)

    before = state(df)
    assert {(r.id, r.library_id, r.language, r.category) for r in before.collect()} == {("a", "/x", "python", "web"), ("b", "(unknown)", "(unknown)", "(unknown)"), ("c", "/x", "(unknown)", "web"), ("d", "/y", "go", "(unknown)")}
    cells = token_budget.apply_deltas(None, token_budget.signed_deltas(None, before))
    changed = df.where("id <> 'd'").union(spark.createDataFrame([("a", "hello world again", 2, t + datetime.timedelta(2), "/x", "py", 9), ("z", "new", 1, t, "/y", "go", 9)], schema))
    counts.refresh(changed, "content")
    after = state(changed)
    deltas = token_budget.signed_deltas(before, after)
    fresh = token_budget.apply_deltas(None, token_budget.signed_deltas(None, after))
    assert sorted(map(tuple, token_budget.apply_deltas(cells, deltas).collect())) == sorted(map(tuple, fresh.collect()))
    total = [r for r in token_budget.budget_cube(fresh).collect() if r.library_id is None and r.language is None and r.category is None]
    assert total[0].documents == 4 and total[0].tokens == after.agg(F.sum("n_tokens")).first()[0]


def test_encoding_and_decoding(spark):
    texts = [None, "", " ", "a", "<|endoftext|>", "we'll  go\n\n\tthere ", "日本語の文章 🧪👩‍💻", "x" * 50_000, LONG, "é ß ​ ", "'s 'S I'D don’t", "\r\n \r\n", "1234567 ½ ² Ⅷ"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(3, "a", "clash"), (None, "b", "c")], "doc_id bigint, text string, ids string")
    vocabulary = tokenizer.Vocabulary(spark)
    found = tokenizer.encode_documents(df, vocabulary).collect()
    assert len(found) == len(texts) + 2
    ids = {r.doc_id: r.ids for r in found}
    whole = vocabulary.tokenizer()
    for i, t in enumerate(texts):
        assert ids[i] == (whole.encode(t, add_special_tokens=False).ids if t else [])
    back = tokenizer.decode_documents(tokenizer.encode_documents(df, vocabulary), vocabulary).collect()
    assert {r.doc_id: r.text for r in back if r.doc_id is not None} == {i: t or "" for i, t in enumerate(texts)}
    counted = tokenizer.token_counts(df, vocabulary, "text", ("doc_id",)).collect()
    assert {r.doc_id: r.n_tokens for r in counted} == {k: len(v) for k, v in ids.items()}


def test_offsets_cover_split_characters(spark):
    vocabulary = tokenizer.Vocabulary(spark)
    text = "hi 🧪 ok"
    ids = vocabulary.tokenizer().encode(text, add_special_tokens=False).ids
    width = np.array([len(x) for x in vocabulary.token_bytes()])
    offsets = list(zip(*map(np.ndarray.tolist, tokenizer.token_offsets(width, text, ids))))
    assert offsets[0] == (0, 2) and offsets[-1] == (4, 7) and all(text[a:b] for a, b in offsets)
    assert tokenizer.decode_ids(vocabulary.token_bytes(), ids) == text
    assert "�" in tokenizer.decode_ids(vocabulary.token_bytes(), ids[: len(ids) - 2])


def test_offsets_of_documents(spark):
    texts = [None, "", "hi 🧪 ok", "日本語 <|endoftext|>", LONG]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] * 2, "doc_id bigint, text string, starts string")
    found = tokenizer.covered_characters(tokenizer.offset_documents(df, tokenizer.Vocabulary(spark))).collect()
    assert sorted((r.doc_id, r.n_chars) for r in found) == sorted((i, len(t or "")) for i, t in enumerate(texts) for _ in range(2))


def test_other_vocabularies_are_refused(spark):
    with pytest.raises(ValueError, match="byte_bpe_multi_50k"):
        tokenizer.Vocabulary(spark, "byte_bpe_multi_50k")


def test_counts_of_other_files_are_not_reused(spark):
    df = spark.createDataFrame([("hello world",)], "content string")
    counts = token_budget.CountTable(spark, tokenizer.Vocabulary(spark))
    counts.refresh(df, "content")
    changed = tokenizer.Vocabulary(spark)
    changed.version = "byte_bpe_50k:another"
    again = token_budget.CountTable(spark, changed, counts.path)
    assert again.read().isEmpty()
    again.refresh(df, "content")
    assert again.read().count() == counts.read().count() == 1


def test_a_repeated_text_is_encoded_once_by_a_task(spark, tmp_path):
    vocabulary = tokenizer.Vocabulary(spark)
    df = spark.createDataFrame([(i, LONG if i % 3 else f"text {i}") for i in range(300)], "doc_id int, text string").coalesce(1)
    found = {r.doc_id: r.n_tokens for r in tokenizer.token_counts(df, vocabulary, "text", ("doc_id",)).collect()}  # 200 * 1.7 MB, one encoding
    assert len(found) == 300 and len({n for i, n in found.items() if i % 3}) == 1


def test_packing_ties_hot_lengths_and_empty_documents(spark):
    sizes = [(i, 0) for i in range(30)] + [(100 + i, 7) for i in range(40)] + [(200, 25), (201, 10), (202, 3), (203, None), (None, 5), (204, 10), (204, 10)]
    df = spark.createDataFrame([(*r, "clash") for r in sizes], "doc_id bigint, n_tokens bigint, container_id string")
    got = packing.pack(df, capacity=10).collect()
    assert sum(r.length for r in got) == sum(n or 0 for _, n in sizes)
    used = {}
    for r in got:
        if r.length:
            used.setdefault(r.container_id, []).append(r)
    assert max(sum(r.length for r in v) for v in used.values()) <= 10
    assert [r.length for r in sorted((r for r in got if r.doc_id == 200), key=lambda r: r.piece_no)] == [10, 10, 5]
    assert all(r.container_id is None for r in got if r.length == 0) and sum(r.length == 0 for r in got) == 31
    assert [r.doc_id for r in packing.split_documents(packing.pack(df, capacity=10)).collect()] == [200]
    fill = {r.container_id: r.unused for r in packing.container_fill(packing.pack(df, capacity=10), 10).collect()}
    assert len(fill) == len(used) and min(fill.values()) >= 0


def test_split_documents_come_from_planned_slots(spark, monkeypatch):
    monkeypatch.setattr(packing, "plan_slots", lambda *a: [])
    df = spark.createDataFrame([(1, 25), (2, 3)], "doc_id bigint, n_tokens bigint")
    assert packing.split_documents(packing.pack(df, capacity=10)).isEmpty()


def test_plan_is_best_fit_over_counts():
    rng = np.random.default_rng(3)
    histogram = {int(k): int(n) for k, n in zip(range(1, 2049), rng.integers(0, 50, 2048))}
    plan = packing.plan_slots(histogram, 2048)
    placed, load = {}, {}
    for length, rank, n, start in plan:
        for i in range(n):
            placed.setdefault(length, set()).add(rank + i)
            load[start + i] = load.get(start + i, 0) + length
    assert all(placed.get(k, set()) == set(range(n)) for k, n in histogram.items()) and max(load.values()) <= 2048
    rooms, opened = [], 0  # best-fit decreasing item by item
    for k in sorted(histogram, reverse=True):
        for _ in range(histogram[k]):
            at = bisect.bisect_left(rooms, k)
            room = rooms.pop(at) if at < len(rooms) else 2048
            opened += room == 2048
            bisect.insort(rooms, room - k)
    assert len(load) == opened


def test_subjects_of_odd_texts(spark):
    areas = spark.createDataFrame([(i, f"subject {i}", "") for i in range(12)], "subject_id int, subject string, about string")
    words = [[f"{chr(97 + s)}{w}" for w in ("orbit", "galaxy", "molecule", "isotope", "enzyme", "fossil")] for s in range(12)]
    fill = ["nothing", "stops", "reading", "small", "default", "keeps", "copy", "near"]
    rng = np.random.default_rng(0)

    def text(s, n=6):
        return " ".join(f"{rng.choice(fill).capitalize()} the {rng.choice(words[s])} {rng.choice(words[s])} {rng.choice(fill)}." for _ in range(n))

    first = text(0)
    rows = [(i, text(i % 12), "en" if i % 9 else None, "/l/n", "clash") for i in range(1, 600)] + [(0, first, "en", "/l/n", "")] * 2
    rows += [(900, None, "en", None, ""), (901, "", "en", None, ""), (902, "```\naorbit agalaxy\n```", "en", None, ""), (None, first, "en", None, ""), (903, LONG, "en", None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, library_id string, terms string")
    labels = spark.createDataFrame([(i, i % 12, "r") for i in range(0, 600, 5)] + [(1, 2, "r"), (1, 2, "r"), (None, 1, "r"), (7, None, "r")], "doc_id bigint, subject_id int, rater string")
    found = {(r.doc_id, r.subject_id) for r in subjects.document_subjects(df, areas, labels).collect()}
    right = {(i, i % 12) for i in range(600)}
    assert len(found & right) >= 570 and len(found - right) <= 30
    assert not {d for d, _ in found} & {900, 901, 902, 903, None}


def test_subject_of_a_third_of_all_documents(spark):
    """A hot subject's own words stand in nearly 30 % of all documents; they are kept and its documents found."""
    areas = spark.createDataFrame([(i, f"subject {i}") for i in range(12)], "subject_id int, subject string")
    words = [[f"{chr(97 + s)}{w}" for w in ("orbit", "galaxy", "molecule", "isotope", "enzyme", "fossil")] for s in range(12)]
    fill = ["nothing", "stops", "reading", "small", "default", "keeps", "copy", "near"]
    rng = np.random.default_rng(5)
    of = [0 if i % 3 == 0 else 1 + i % 11 for i in range(660)]
    text = lambda s: " ".join(f"{rng.choice(fill).capitalize()} the {rng.choice(words[s])} {rng.choice(words[s])} {rng.choice(fill)}." for _ in range(6))
    df = spark.createDataFrame([(i, text(s), "en", "/l/n") for i, s in enumerate(of)], "doc_id bigint, text string, lang string, library_id string")
    labels = spark.createDataFrame([(i, s) for i, s in enumerate(of) if i % 5 == 0], "doc_id bigint, subject_id int")
    found = {(r.doc_id, r.subject_id) for r in subjects.document_subjects(df, areas, labels).collect()}
    hot = {(i, 0) for i, s in enumerate(of) if s == 0}
    assert len(found & hot) >= 0.95 * len(hot) and len(found - set(enumerate(of))) <= 33
    kept = subjects.vocabulary(subjects.document_terms(df), labels=labels).kept
    assert set(words[0]) <= set(kept) and not set(fill) & set(kept)


def test_every_document_is_in_the_fit(spark, monkeypatch):
    """The parts of the steps are disjoint and together hold every document of a language, as often as each other."""
    monkeypatch.setattr(subjects, "PART_DOCUMENTS", 10)
    terms = spark.createDataFrame([(i, "en", [f"t{i}"], [i], [0]) for i in range(100)], "doc_id int, lang string, terms array<string>, numbers array<int>, sentence_of array<int>")
    words = subjects.Vocabulary([f"t{i}" for i in range(100)], {"en": set()}, {"en": set()}, {"en": 100})
    models = subjects.first_models(terms, words, 2, 1)
    after = subjects.fit_topics(terms, words, topics=2, steps=10)
    names = after["en"][0]
    before = dict(zip(models["en"][0], models["en"][1].sum(0)))
    seen = {t: w for t, w in zip(names, after["en"][1].sum(0))}
    assert len(seen) == 100
    # a term of a document that no part held would only shrink
    shrunk = np.prod([1 - (subjects.OFFSET + k) ** -subjects.DECAY for k in range(10)])
    assert all(seen[t] > before[t] * shrunk + 2 * subjects.TERM_PRIOR + 0.1 for t in seen)


def test_terms_of_a_small_language_are_kept(spark):
    """A term in a tenth of 40 documents is kept, however many documents of other languages there are."""
    rows = [(i, "en", f"common w{i % 50}") for i in range(6000)] + [(10_000 + i, "fi", "sana" if i % 10 else "harva") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, sentences string")
    assert {"harva", "w7"} <= set(subjects.vocabulary(df).kept)


def test_subjects_of_languages_with_few_documents(spark):
    """Languages of 24 and 1 documents have no model of their own; the first has labels, the second shares words with it."""
    areas = spark.createDataFrame([(i, f"subject {i}") for i in range(2)], "subject_id int, subject string")
    large = [["orbit", "galaxy", "comet", "planet"], ["enzyme", "fossil", "protein", "cell"]]
    small = [["rata", "galaksi", "komeetta", "planeetta"], ["entsyymi", "fossiili", "proteiini", "solu"]]
    rng = np.random.default_rng(2)
    text = lambda w: " ".join(f"{rng.choice(w).capitalize()} {rng.choice(w)}." for _ in range(6))
    rows = [(i, text(large[i % 2]), "en") for i in range(60)] + [(100 + i, text(small[i % 2]), "fi") for i in range(24)] + [(200, text(small[0]), "et")]
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id bigint, text string, lang string, library_id string")
    labels = spark.createDataFrame([(i, i % 2) for i in (*range(0, 60, 3), *range(100, 112))], "doc_id bigint, subject_id int")
    found = {(r.doc_id, r.subject_id) for r in subjects.document_subjects(df, areas, labels).collect()}
    assert {(100 + i, i % 2) for i in range(24)} | {(200, 0)} <= found


@pytest.mark.parametrize("kind", ["entries", "cache", "embedding", "documents"])
def test_empty_tables(spark, kind):
    if kind == "entries":
        df = spark.createDataFrame([], "entry_id string, title string, content string")
        assert canonical.copies_found(canonical.formatting_groups(df)).count() == 0
        assert near_duplicates.groups_found(near_duplicates.near_duplicate_groups(df)).count() == 0
    elif kind == "cache":
        df = spark.createDataFrame([], "cache_id bigint, created_at timestamp_ntz, content string")
        assert batch_history.batch_duplicates(df, "2026-03-01 00:00:00").count() == 0
    elif kind == "embedding":
        df = spark.createDataFrame([], "id string, library_id string, content string, indexed_at timestamp_ntz")
        docs = boilerplate.prepared_documents(df)
        assert boilerplate.block_occurrences(docs, boilerplate.library_blocks(docs)).count() == 0
        counts = token_budget.CountTable(spark, tokenizer.Vocabulary(spark))
        counts.refresh(df, "content")
        assert counts.read().count() == 0
    else:
        df = spark.createDataFrame([], "doc_id bigint, text string, lang string, library_id string, n_tokens bigint")
        assert tokenizer.encode_documents(df, tokenizer.Vocabulary(spark)).count() == 0
        assert packing.pack(df).count() == 0
        areas = spark.createDataFrame([], "subject_id int, subject string")
        labels = spark.createDataFrame([], "doc_id bigint, subject_id int")
        assert subjects.document_subjects(df, areas, labels).count() == 0
