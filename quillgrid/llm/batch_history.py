"""Deduplicating new batches against all history (problem 2): a prefix-tree hash forest.

The forest persists several signature permutations of every accepted class of texts. Each tree's key concatenates DEPTH
coordinates of the signature, so entries with a common prefix are a range of the sorted tree. The forest is kept as runs,
one for each batch, sorted inside files of one range of one tree each; a batch opens only the files whose ranges it
touches. It is looked up by prefixes: whole keys first, then wider ranges, until pairs at the wanted likeness are met
with at least the wanted recall. What is met is compared exactly, with the words that the history keeps for each class.
Runs are merged when there are many.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillgrid.llm import likeness as L, sketch as S
from quillgrid.llm.near_duplicates import ALIKE, compare, text_classes
from quillgrid.operators.graph import first_accepted
from quillgrid.plans.materialize import delete_folder, drop_scratch, finished_runs, mark_finished, materialize, scratch_path

TREES = 40
DEPTH = 4
#: A pair counts as met when it shares a range in so many trees: chance hits of unlike texts are mostly single.
MIN_TREES = 2
RECALL = 0.99999
#: Coordinates of each tree. The first three are the tree's own, so prefixes of three meet independently of each other;
#: the fourth is the first of the tree half way round, so whole keys are independent in half of the trees.
_TREE = np.array([[3 * t, 3 * t + 1, 3 * t + 2, 3 * ((t + TREES // 2) % TREES)] for t in range(TREES)])
#: Classes of a run in one file of a tree, and in one file of texts; at most 2^8 files a tree and 2^12 files of texts.
BUCKET_CLASSES, SLOT_CLASSES = 1_000_000, 8_192
_MOST_BUCKET_BITS, _MOST_SLOT_BITS = 8, 12
#: So many runs of equal length at the end of the history are merged into one.
MERGE_RUNS = 8
#: Ranges of more open classes of one batch are first compared with their earliest one, for so many rounds at most.
HOT_RANGE, LEADER_ROUNDS = 2_000, 8
#: Nodes of a batch lie in a range of their own.
_RUN = 1 << 50

ENTRY_SCHEMA = "tree int, path bigint, node bigint"


def recall_at(length: int, alike: float, trees: int, min_trees: int) -> float:
    """The least probability that a pair of that likeness shares a prefix of ``length`` coordinates in enough trees.

    Trees that have a coordinate of an earlier one in their prefix depend on it and aren't counted; the others are
    independent, and the trees left out can only add to what is met.
    """
    p, used, n = alike**length, set(), 0
    for own in (set(t) for t in _TREE[:trees, :length].tolist()):
        if not own & used:
            used, n = used | own, n + 1
    return 1 - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min_trees))


def prefix_length(alike: float = ALIKE, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, min_trees: int = MIN_TREES) -> int:
    """The longest prefix that reaches the recall target: prefixes are widened from whole keys down to one coordinate.

    Ranges of a shorter prefix hold those of the longer ones, so only the widest one needed is then searched.
    """
    return next((n for n in range(depth, 1, -1) if recall_at(n, alike, trees, min_trees) >= recall), 1)


def forest_entries(classes: DataFrame, trees: int = TREES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(tree, path, node, *keep): each class once in each tree; ``path`` has 16 bits of each coordinate of the tree, the
    first ones highest, so the order of paths is the order of the tree."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            top = L.short_matrix(batch.column("sig")).astype(np.uint64)[:, _TREE[:trees]]
            path = np.zeros(top.shape[:2], np.uint64)
            for d in range(DEPTH):
                path = (path << np.uint64(16)) | top[:, :, d]
            n = batch.num_rows
            again = pa.array(np.repeat(np.arange(n), trees))
            columns = [pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(path.astype(np.int64).ravel())] + [batch.column(c).take(again) for c in ("node", *keep)]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "path", "node", *keep])

    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in classes.select(*keep).schema) if keep else ""
    return classes.select("node", "sig", *keep).mapInArrow(plant, ENTRY_SCHEMA + more)


def _spot(length: int) -> Column:
    """One number for a range of a tree: equal for entries of a tree with a common prefix of that length."""
    if length == DEPTH:
        return F.xxhash64("tree", "path")
    return F.shiftrightunsigned("path", 16 * (DEPTH - length)) + F.col("tree").cast("bigint") * F.lit(1 << (16 * length))


def meet(batch: DataFrame, stored: DataFrame, length: int, min_trees: int = MIN_TREES) -> DataFrame:
    """(a, b): pairs of a batch entry with a stored one that are in a common range of prefixes of that length in enough
    trees."""
    left = batch.select(_spot(length).alias("p"), F.col("node").alias("a"))
    right = stored.select(_spot(length).alias("p"), F.col("node").alias("b"))
    return left.join(right, "p").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("trees")).where(F.col("trees") >= min_trees).select("a", "b")


def meet_within(entries: DataFrame, length: int, min_trees: int = MIN_TREES) -> DataFrame:
    """(a, b) with a > b: pairs of one batch in a common range in enough trees, of which one at least is ``open`` and none
    ``known``. Both sides of the join read one exchange."""
    left = entries.where("not known").select(_spot(length).alias("p"), "node", "open").repartition("p")
    right = left.select("p", F.col("node").alias("other"), F.col("open").alias("other_open"))
    met = left.join(right, "p").where("node > other and (open or other_open)")
    return met.groupBy(F.col("node").alias("a"), F.col("other").alias("b")).agg(F.count("*").alias("trees")).where(F.col("trees") >= min_trees).select("a", "b")


def hot_ranges(entries: DataFrame, length: int, most: int | None = None, bits: int = S.SKETCH_BITS) -> DataFrame:
    """(p, first): ranges of more than ``most`` open entries, with the earliest (turn, node) of them.

    A count sketch tells which ranges may be; only their entries are shuffled and counted.
    """
    most = HOT_RANGE if most is None else most
    spots = entries.where("open and not known").select(_spot(length).alias("p"), "node", "turn")
    keys = lambda batch: batch.column("p").to_numpy(zero_copy_only=False)
    sketch = spots.sparkSession.sparkContext.broadcast(S.count_sketch(spots.select("p"), keys, bits))  # 2^bits * 4 bytes

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sketch.value[S.slots_of(keys(batch), bits)] > most))

    found = spots.mapInArrow(maybe, spots.schema)
    return found.groupBy("p").agg(F.count("*").alias("n"), F.min(F.struct("turn", "node")).alias("first")).where(F.col("n") > most).select("p", "first")


@dataclass(frozen=True)
class Run:
    """A finished run: batches first .. last, and how many bits of a path and of a node's hash name its files."""

    path: str
    first: int
    last: int
    bucket_bits: int
    slot_bits: int

    _NAME = re.compile(r"run-(\d+)-(\d+)-(\d+)-(\d+)-\w+$")

    @classmethod
    def of(cls, path: str) -> Run:
        return cls(path, *map(int, cls._NAME.search(path).groups()))


def _bits(n: int, most: int, limit: int) -> int:
    return min(limit, max(0, math.ceil(math.log2(max(1, n) / most))))


def _bucket(bits: int) -> Column:
    top = F.shiftrightunsigned("path", 64 - bits).cast("int") if bits else F.lit(0)
    return F.col("tree") * F.lit(1 << bits) + top


def _slot(bits: int) -> Column:
    return F.pmod(F.xxhash64("node"), F.lit(1 << bits)).cast("int")


class AcceptedHistory:
    """What has been accepted so far, as runs under ``path``: the forest, texts of classes, and accepted rows.

    A run is a folder with three tables and a marker that is written last; a run without it (of a job that failed) is
    never read. The forest is partitioned by tree and range, texts and rows by a hash of their node, and a batch reads
    only those files that it touches: of the forest at most as many as it has entries, of texts only those of classes it
    has met. Nothing that has been accepted is signed, hashed or compared with its like again. :meth:`accept_all` and
    :meth:`check` add a run each and merge runs; a history opened on the same path goes on where it was left.
    """

    SCHEMAS = {"forest": "path bigint, node bigint, bucket int", "texts": "node bigint, words string, slot int", "rows": "turn {turn}, node bigint, slot int"}

    def __init__(self, spark: SparkSession, path: str | None = None, alike: float = ALIKE):
        self.spark, self.path, self.alike = spark, path or scratch_path(spark, "history"), alike

    def runs(self) -> list[Run]:
        """Finished runs in order; a merged one stands for those it holds."""
        found = sorted((Run.of(x) for x in finished_runs(self.spark, self.path)), key=lambda r: (r.first, -r.last, r.path))
        out: list[Run] = []
        for r in found:
            if not out or r.last > out[-1].last:
                out.append(r)
        return out

    def _next(self) -> int:
        return self.runs()[-1].last + 1 if self.runs() else 0

    def _table(self, run: Run, name: str, turn: str = "") -> DataFrame:
        return self.spark.read.schema(self.SCHEMAS[name].format(turn=turn)).parquet(f"{run.path}/{name}")

    def _write(self, first: int, last: int, entries: DataFrame, texts: DataFrame, rows: DataFrame) -> None:
        """Write a run of ``entries`` (tree, path, node), ``texts`` (node, words) and ``rows`` (turn, node)."""
        n = texts.count()
        b, s = _bits(n, BUCKET_CLASSES, _MOST_BUCKET_BITS), _bits(n, SLOT_CLASSES, _MOST_SLOT_BITS)
        folder = f"{self.path}/run-{first:06d}-{last:06d}-{b}-{s}-{uuid.uuid4().hex}"
        # a range or slot that is much larger than the others is split over several tasks and files
        spread = lambda df, column: df.hint("rebalance", F.col(column))
        spread(entries.select("path", "node", _bucket(b).alias("bucket")), "bucket").sortWithinPartitions("bucket", "path").write.partitionBy("bucket").parquet(f"{folder}/forest")
        spread(texts.select("node", "words", _slot(s).alias("slot")), "slot").sortWithinPartitions("slot", "node").write.partitionBy("slot").parquet(f"{folder}/texts")
        spread(rows.select("turn", "node", _slot(s).alias("slot")), "slot").sortWithinPartitions("slot", "node").write.partitionBy("slot").parquet(f"{folder}/rows")
        mark_finished(self.spark, folder)

    def _add(self, batch: int, classes: DataFrame, rows: DataFrame) -> None:
        """Append a run of ``classes`` (node, words, sig) and accepted ``rows`` (turn, node), and merge where it is due."""
        self._write(batch, batch, forest_entries(classes), classes.select("node", "words"), rows)
        turn = rows.schema["turn"].dataType.simpleString()
        while len(tail := self.runs()[-MERGE_RUNS:]) == MERGE_RUNS and len({r.last - r.first for r in tail}) == 1:
            self.merge(tail, turn)

    def merge(self, runs: list[Run], turn: str) -> None:
        """Merge neighbouring runs into one at the history's own path; ``turn`` is the type of the rows' turns.

        The old runs' files stay for readers that still use them until :meth:`vacuum`.
        """
        every = lambda name: [self._table(r, name, turn) for r in runs]
        entries = [t.select(F.shiftright("bucket", r.bucket_bits).alias("tree"), "path", "node") for r, t in zip(runs, every("forest"))]
        self._write(runs[0].first, runs[-1].last, _union(entries), _union(every("texts")), _union(every("rows")))

    def vacuum(self) -> None:
        """Delete runs that a merged one stands for."""
        live = {r.path for r in self.runs()}
        for path in finished_runs(self.spark, self.path):
            if path not in live:
                delete_folder(self.spark, path)

    def forest(self, entries: DataFrame | None = None) -> DataFrame:
        """(tree, path, node) of all runs, or of those files of them whose range ``entries`` (tree, path) touch."""
        runs, touched = self.runs(), None
        most = max((r.bucket_bits for r in runs), default=0)
        if entries is not None and most:
            touched = {r[0] for r in entries.select(_bucket(most)).distinct().collect()}  # at most TREES * 2^_MOST_BUCKET_BITS numbers
        out = []
        for r in runs:
            t, down = self._table(r, "forest"), most - r.bucket_bits
            # the bits of a bucket below its tree's number are the first bits of paths, so fewer bits are a shift
            t = t if touched is None else _only(t, "bucket", {x >> down for x in touched})
            out.append(t.select(F.shiftright("bucket", r.bucket_bits).alias("tree"), "path", "node"))
        return _union(out) if out else self.spark.createDataFrame([], ENTRY_SCHEMA)

    def of_nodes(self, name: str, nodes: DataFrame, turn: str = "") -> DataFrame:
        """The rows of ``texts`` or ``rows`` of these nodes, from those files only that hold one of them."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], self.SCHEMAS[name].format(turn=turn)).drop("slot")
        batch = F.shiftrightunsigned("node", 50)
        number = F.lit(None).cast("int")
        for i, r in enumerate(runs):
            number = F.when(batch.between(r.first, r.last), i).otherwise(number)
        most = max(r.slot_bits for r in runs)
        touched = nodes.select(number.alias("run"), _slot(most).alias("slot")).distinct().where("run is not null").collect()  # at most runs * 2^_MOST_SLOT_BITS rows
        out = []
        for i, r in enumerate(runs):
            t = _only(self._table(r, name, turn), "slot", {x["slot"] & ((1 << r.slot_bits) - 1) for x in touched if x["run"] == i})
            out.append(t.drop("slot"))
        return _union(out).join(nodes.select("node").distinct(), "node", "left_semi")

    def _signed(self, rows: DataFrame, row_id: str, at: str, text: str) -> tuple[int, DataFrame, DataFrame]:
        """The number of this batch, its rows (turn, node) with an id, a time and a word, and their classes (node, first,
        words, sig)."""
        good = rows.where(F.col(row_id).isNotNull() & F.col(at).isNotNull())
        good = good.select(F.struct(F.col(at).alias("at"), F.col(row_id).alias("id")).alias("turn"), text)
        signed = materialize(L.with_signatures(good, text, ("turn",), short=True, with_words=True), "signed")
        batch = self._next()
        classes = text_classes(signed, "turn", batch * _RUN, keep="words")
        top = classes.agg(F.max("node")).first()[0]
        if top is not None and top >= (batch + 1) * _RUN:
            raise RuntimeError("too many partitions for one run; coalesce the batch")
        members = materialize(signed.select("turn", "h1", "h2").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("turn", "node"), "members")
        drop_scratch(signed)
        return batch, members, classes

    def accept_all(self, rows: DataFrame, row_id: str, at: str, text: str) -> None:
        """Take rows in without a check."""
        batch, members, classes = self._signed(rows, row_id, at, text)
        self._add(batch, classes, members)
        drop_scratch(classes)

    def check(self, rows: DataFrame, row_id: str, at: str, text: str) -> DataFrame:
        """(case_id, accepted_id) of a batch: its rows that repeat an accepted row before them, with each of these.

        Rows are taken by ``at`` and ``row_id`` and come after all that has been accepted; one is accepted, and added to
        the history, unless it is alike an accepted one before it. Equal sets are decided once, by their first row.
        """
        batch, members, classes = self._signed(rows, row_id, at, text)
        turn_type = members.schema["turn"].dataType.simpleString()
        length = prefix_length(self.alike)
        # against the history; equal sets share every range, so they are met like others
        entries = forest_entries(classes)
        met = materialize(meet(entries, self.forest(entries), length), "met")
        words = classes.select("node", "words")
        old_words = self.of_nodes("texts", met.select(F.col("b").alias("node")))
        old = materialize(compare(met, words, self.alike, old_words).select("a", "b"), "old-links")
        beaten = materialize(old.select(F.col("a").alias("node")).distinct(), "beaten")
        # within the batch: a link matters only if its earlier end may be accepted
        links = self._links_within(classes, beaten, length)
        ordered = classes.select("node", "first")
        inner = links.join(ordered.toDF("a", "first_a"), "a").join(ordered.toDF("b", "first_b"), "b")
        later = F.col("first_a") > F.col("first_b")
        among = inner.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("before"))
        among = materialize(among.join(beaten.withColumnRenamed("node", "before"), "before", "left_anti").select("node", "before"), "among")
        undecided = among.join(beaten, "node", "left_anti")
        state = first_accepted(undecided.select("node").union(undecided.select("before")), undecided)
        refused = materialize(beaten.union(state.where("not accepted").select("node")).distinct(), "refused")
        # accepted is the first row of each class that isn't refused
        member = members.join(ordered, "node").join(refused.withColumn("refused", F.lit(True)), "node", "left")
        decided = materialize(member.select("turn", "node", (F.col("refused").isNull() & (F.col("turn") == F.col("first"))).alias("accepted")), "decided")
        fine = decided.where("accepted").select("turn", "node")
        old_rows = self.of_nodes("rows", old.select(F.col("b").alias("node")), turn_type)
        before = old_rows.select("turn", "node").union(fine).select(F.col("turn").alias("turn_b"), F.col("node").alias("before"))
        near = old.select(F.col("a").alias("node"), F.col("b").alias("before")).union(among).union(ordered.select("node", F.col("node").alias("before")))
        out = decided.where("not accepted").join(near, "node").join(before, "before").where("turn_b < turn")
        out = materialize(out.select(F.col("turn.id").alias("case_id"), F.col("turn_b.id").alias("accepted_id")).distinct(), "cases")
        self._add(batch, classes.join(refused, "node", "left_anti"), fine)
        drop_scratch(classes)
        return out

    def _links_within(self, classes: DataFrame, beaten: DataFrame, length: int) -> DataFrame:
        """(a, b) links between classes of one batch whose earlier end may be accepted.

        While some range holds very many open classes, the earliest class of each such range is compared with all that
        share ranges with it. If it isn't alike an open one before it, it is sure to be accepted, and those alike it are
        beaten and no longer open, so a large group of near copies is never paired with itself. What remains is paired
        in full.
        """
        flagged = classes.select("node", "sig", F.col("first").alias("turn")).join(beaten.withColumn("b", F.lit(True)), "node", "left")
        flagged = materialize(flagged.select("node", "sig", "turn", F.col("b").isNull().alias("open"), F.lit(False).alias("known")), "flagged")
        words, found = classes.select("node", "words"), []
        for _ in range(LEADER_ROUNDS):
            hot = materialize(hot_ranges(forest_entries(flagged, keep=("turn", "open", "known")), length), "hot-ranges")
            if hot.isEmpty():
                break
            leaders = hot.select("first.node", "first.turn").distinct()
            entries = forest_entries(flagged.where("not known"))
            met = materialize(meet(entries.join(leaders.select("node"), "node", "left_semi"), entries, length), "leader-pairs")
            links = materialize(compare(met, words, self.alike).select("a", "b"), "leader-links")
            found.append(links)
            state = flagged.select(F.col("node").alias("b"), F.col("turn").alias("turn_b"), "open")
            every = _union(found)  # those of former leaders too, which may be earlier than these and alike
            seen = every.union(every.select("b", "a")).join(leaders.select(F.col("node").alias("a"), "turn"), "a").join(state, "b")
            unsure = seen.where("turn_b < turn and open").select("a").distinct()
            lost = seen.where("turn_b > turn").join(unsure, "a", "left_anti").select(F.col("b").alias("node")).distinct().withColumn("lost", F.lit(True))
            lead = leaders.select("node", F.lit(True).alias("lead"))
            after = flagged.join(lost, "node", "left").join(lead, "node", "left")
            after = materialize(after.select("node", "sig", "turn", (F.col("open") & F.col("lost").isNull()).alias("open"), (F.col("known") | F.col("lead").isNotNull()).alias("known")), "flagged")
            drop_scratch(flagged)
            flagged = after
        met = materialize(meet_within(forest_entries(flagged, keep=("open", "known")), length), "met-within")
        return materialize(_union([compare(met, words, self.alike).select("a", "b"), *found]).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _only(df: DataFrame, column: str, values: set[int]) -> DataFrame:
    """The files of a partition column's values; Spark lists and opens no others."""
    return df.where(f"{column} in ({', '.join(map(str, sorted(values)))})") if values else df.where("false")


def batch_duplicates(rows: DataFrame, cutoff: str, row_id: str = "cache_id", at: str = "created_at", text: str = "content", alike: float = ALIKE) -> DataFrame:
    """(case_id, accepted_id): each row from ``cutoff`` on that repeats an accepted row before it, with each of these.

    Rows are taken by ``at`` and ``row_id``; all before the cutoff are accepted, a later one unless it is alike an
    accepted row before it. Rows with a null id, a null time, or without any word are neither cases nor accepted.
    Repeated rows count once, an empty table gives an empty result.
    """
    history = AcceptedHistory(rows.sparkSession, alike=alike)
    old = F.col(at) < F.lit(cutoff).cast(rows.schema[at].dataType)
    history.accept_all(rows.where(old), row_id, at, text)
    return history.check(rows.where(~old), row_id, at, text)


def measured_recall(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(prefix_length, pairs, met, recall): of alike pairs (a, b) of classes found in another way, how many the forest
    meets at each length of prefixes, whole keys first."""
    wanted = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "wanted")
    entries = materialize(forest_entries(classes), "entries")
    own = wanted.join(entries.select(F.col("node").alias("a"), "tree", F.col("path").alias("path_a")), "a").join(entries.select(F.col("node").alias("b"), "tree", F.col("path").alias("path_b")), ["b", "tree"])
    depth = F.lit(0)
    for n in range(1, DEPTH + 1):
        bits = 16 * (DEPTH - n)
        cut = lambda c: F.shiftrightunsigned(c, bits) if bits else F.col(c)  # noqa: B023, E731
        depth = depth + (cut("path_a") == cut("path_b")).cast("int")
    shared = own.withColumn("depth", depth).groupBy("a", "b").agg(*[F.sum((F.col("depth") >= n).cast("int")).alias(f"n{n}") for n in range(1, DEPTH + 1)])
    by = shared.select(F.explode(F.array(*[F.struct(F.lit(n).alias("prefix_length"), (F.col(f"n{n}") >= MIN_TREES).cast("bigint").alias("met")) for n in range(DEPTH, 0, -1)])).alias("x")).select("x.*")
    return by.groupBy("prefix_length").agg(F.count("*").alias("pairs"), F.sum("met").alias("met")).withColumn("recall", F.col("met") / F.col("pairs"))


def recall_by_length(df: DataFrame, row_id: str = "cache_id", text: str = "content", alike: float = ALIKE) -> DataFrame:
    """:func:`measured_recall` over a table's own alike pairs, which the inverted join of problem 5 finds."""
    from quillgrid.llm.near_duplicates import alike_classes

    rows = df.where(F.col(row_id).isNotNull()).select(row_id, text)
    signed = materialize(L.with_signatures(rows.withColumn("text_hash", F.xxhash64(text)), text, (row_id, "text_hash")), "signed")
    classes = text_classes(signed, row_id)
    return measured_recall(alike_classes(classes, rows, row_id, text, alike=alike), classes)


def with_job_time(cache: DataFrame, jobs: DataFrame) -> DataFrame:
    """The cache's rows with ``job_created_at``: creation of their job, the earliest where its rows disagree.

    Rows whose job is unknown have null there. Repeated job rows are combined first.
    """
    when = jobs.where("job_id is not null").groupBy("job_id").agg(F.min("created_at").alias("job_created_at"))
    return cache.join(when, "job_id", "left")


def found_pairs(found: DataFrame) -> DataFrame:
    """(cache_id_a, cache_id_b): both ids of each pair, the smaller first."""
    return found.select(F.least("case_id", "accepted_id").alias("cache_id_a"), F.greatest("case_id", "accepted_id").alias("cache_id_b")).distinct()
