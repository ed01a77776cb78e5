"""Subject areas of documents (problem 8): distributed latent Dirichlet topic models.

Terms of a document are words of its prose (code is left out), pairs of Han characters and runs of katakana. Terms that
are rare, or common within a language and as common in documents of any subject, say nothing about a subject; document
frequencies are counted over all documents, the evenness of common terms over the hand-labelled ones.

A topic model is fitted to all documents of each language, by stochastic collapsed variational inference: minibatches are
disjoint parts of the documents, so each pass sees every one of them; tasks infer the topics of a part, Spark sums what
they give each topic, and the driver moves the model by it. Topics are mapped to subjects through their top terms: what
hand-labelled documents say of these, by their weight in the topic. A document is assigned the subjects that its topic
proportions hold a share of, if terms of more than one sentence speak for them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgrid.plans.materialize import materialize, scratch_path

TOPICS = 24
#: Steps of the fit; a step takes one of at most PARTS disjoint parts of a language's documents, of at least PART_DOCUMENTS
#: where it has so many, so every document is seen in STEPS / PARTS steps or more.
STEPS, PARTS, PART_DOCUMENTS = 20, 10, 200
#: Rounds of inference for a document in a step of the fit; it is met again in later steps, under a better model.
FIT_ROUNDS = 5
#: Priors of topics in documents and of terms in topics; a step's weight is (offset + step) ** -decay.
DOCUMENT_PRIOR, TERM_PRIOR, OFFSET, DECAY = 0.1, 0.02, 10.0, 0.51
#: Terms of a topic that are inspected for its subject.
TOP_TERMS = 30
#: Share of a document's topic proportions that a subject must hold.
LEAST_PROPORTION = 0.02
#: A term is kept from this share of the documents of any language on; beyond this share of a language's it is common.
LEAST_SHARE, MOST_SHARE = 0.001, 0.12
#: A common term is kept as a subject's own if in labelled documents of one subject it is so many times as frequent as in
#: the mean over subjects. So many documents in which it is as frequent as in its language count with those of each.
UNEVEN, EVEN_DOCUMENTS = 1.8, 5.0
#: Languages with fewer documents have one model together, under the name SHARED.
LEAST_DOCUMENTS, SHARED = 30, ""
#: Share of a term's weight that must lie in topics of one subject for the term to speak for it.
SPECIFIC = 0.5
LEAST_SENTENCES = 2
#: The topics that hold a term count as much as this many times the labelled documents that a term of its language has
#: in the median, so that more labels don't drown the topics.
TRUST = 0.5
_BREAK = "\n"


def split_terms(text: str, patterns: tuple) -> list[list[str]]:
    """The terms of each sentence of a text's prose; fenced and inline code are left out."""
    fence, inline, sentence, latin, term, han = patterns
    out = []
    prose = inline.sub(" ", fence.sub(" ", text)).lower()
    if prose.isascii():
        return [found for s in sentence.split(prose) if (found := latin.findall(s))]
    for s in sentence.split(prose):
        found = []
        for w in term.findall(s):
            if han.match(w):
                found += [w[i : i + 2] for i in range(len(w) - 1)]
            elif len(w) > 2:
                found.append(w)
        if found:
            out.append(found)
    return out


def _patterns() -> tuple:
    import re

    import regex

    return (
        re.compile(r"```.*?(?:```|\Z)", re.S),
        re.compile(r"`[^`\n]*`"),
        re.compile(r"(?<=[.!?])\s+|[。！？]|\n+"),
        re.compile(r"[a-z]{3,}"),
        regex.compile(r"\p{Katakana}[\p{Katakana}ー]*|\p{Han}+|[\p{Latin}\p{M}]+"),
        regex.compile(r"\p{Han}"),
    )


def document_terms(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", library: str = "library_id") -> DataFrame:
    """(doc_id, lang, sentences): the terms of each document, blanks between terms and line ends between sentences.

    ``lang`` is the two-letter code in lower case, null where unknown. The name of the document's own library is no
    term. Null ids and texts without terms have no row.
    """
    code = F.lower(F.substring(F.trim(lang), 1, 2))
    source = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.when(code != "", code).alias("lang"), F.col(text).alias("_text"), F.lower(F.substring_index(library, "/", -1)).alias("_name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _patterns()
        for batch in batches:
            bags = []
            for text, name in zip(batch.column("_text").to_pylist(), batch.column("_name").to_pylist()):
                bags.append(_BREAK.join(" ".join(t for t in s if t != name) for s in split_terms(text, patterns)))
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(bags, pa.string())], names=["doc_id", "lang", "sentences"])
            yield out.filter(pa.array([b != "" for b in bags]))

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, lang string, sentences string")


def term_frequencies(terms: DataFrame) -> DataFrame:
    """(lang, term, documents): in how many documents of a language a term stands, counted over all of them.

    Tasks count before the shuffle, so a frequent term costs one row for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["lang", "term", "n"])

        for batch in batches:
            for lang, bag in zip(batch.column("lang").to_pylist(), batch.column("sentences").to_pylist()):
                seen.update((lang, t) for t in {*bag.split(), ""})  # "" counts the documents
            if len(seen) > 500_000:
                yield flush()
                seen.clear()
        yield flush()

    part = terms.select("lang", "sentences").mapInArrow(run, "lang string, term string, n bigint")
    return part.groupBy("lang", "term").agg(F.sum("n").alias("documents"))


@dataclass
class Vocabulary:
    """Kept terms, common terms of each language, terms left out in each, and documents of each; all bounded by the least
    share."""

    kept: list[str]
    common: dict[str, set[str]]
    left_out: dict[str, set[str]]
    documents: dict[str, int]


def _given(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and subject_id is not null").select("doc_id", "subject_id").distinct()


def uneven_terms(terms: DataFrame, labels: DataFrame, shares: dict[tuple[str, str], float]) -> set[tuple[str, str]]:
    """Those (lang, term) of ``shares``, which has their shares of the documents, that are a subject's own.

    What reaches the driver is bounded by these terms times subjects.
    """
    if not shares:
        return set()
    found = terms.where("lang is not null").join(_given(labels), "doc_id").dropDuplicates(["doc_id", "subject_id"])
    term = F.explode(F.array_union(F.split("sentences", "[ \n]"), F.array(F.lit(""))))  # "" counts the documents
    found = found.select("lang", "subject_id", term.alias("term")).where(F.col("term").isin(["", *sorted({t for _, t in shares})]))
    seen = {(r["lang"], r["term"], r["subject_id"]): r["n"] for r in found.groupBy("lang", "term", "subject_id").agg(F.count("*").alias("n")).collect()}
    subjects = {s for _, _, s in seen}
    out = set()
    for (lang, t), x in shares.items():
        p = [(seen.get((lang, t, s), 0) + EVEN_DOCUMENTS * x) / (seen.get((lang, "", s), 0) + EVEN_DOCUMENTS) for s in subjects]
        if p and max(p) >= UNEVEN * sum(p) / len(p):
            out.add((lang, t))
    return out


def vocabulary(terms: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE, labels: DataFrame | None = None) -> Vocabulary:
    """Terms to model. At most (mean distinct terms of a document) / ``least`` terms of each language reach the driver.

    A term is kept if it is frequent enough within a language, or within all documents; the languages with few documents
    count as one, in which no term is left out for being common: their documents are too few and too mixed to tell.

    A term that is common in a language and no subject's own there, by the labelled documents, is left out; in other
    languages it is left out unless it is a subject's own in them.
    """
    counted = materialize(term_frequencies(terms), "term-frequencies")
    sizes = {r["lang"]: r["documents"] for r in counted.where("term = ''").collect()}  # one row for each language code
    total = sum(sizes.values())
    large = {k: n for k, n in sizes.items() if k is not None and n >= LEAST_DOCUMENTS}
    few = sum(n for k, n in sizes.items() if k not in large)  # those of unknown language too, which may turn out to be of any
    floor = max(3, least * total)
    lang = F.when(F.col("lang").isin(list(large)), F.col("lang")).otherwise(SHARED)
    merged = counted.where("term <> ''").groupBy(lang.alias("lang"), "term").agg(F.sum("documents").alias("documents"))
    own_floor = F.lit(max(3, least * few))
    for k, n in sorted(large.items()):
        own_floor = F.when(F.col("lang") == k, max(3, least * n)).otherwise(own_floor)
    enough = merged.groupBy("term").agg(F.sum("documents").alias("all"), F.max(F.col("documents") >= own_floor).alias("own")).where((F.col("all") >= floor) | F.col("own"))
    found = merged.join(enough, "term").select("lang", "term", "documents").collect()
    rows = [r for r in found if r["lang"] != SHARED]
    share = {(r["lang"], r["term"]): r["documents"] / large[r["lang"]] for r in rows}
    common: dict[str, set[str]] = {k: set() for k in large}
    for (lang, t), x in share.items():
        if x > most:
            common[lang].add(t)
    frequent = set().union(*common.values())
    own = uneven_terms(terms, labels, {k: x for k, x in share.items() if k[1] in frequent}) if labels is not None else set()
    function = {t for k in large for t in common[k] if (k, t) not in own}
    left_out = {k: {t for t in function if (k, t) not in own} for k in large}
    kept = {t for k, t in share if t not in left_out[k]} | ({r["term"] for r in found if r["lang"] == SHARED} - function)
    return Vocabulary(sorted(kept), common, left_out | {SHARED: function}, large | ({SHARED: few} if few else {}))


def modelled_terms(terms: DataFrame, words: Vocabulary) -> DataFrame:
    """(doc_id, lang, terms, numbers, sentence_of): the kept terms of each document, as text and by their numbers, and
    the sentence in which each stands.

    A document of unknown language takes the language whose common terms it has most of. One of a language with few
    documents, or of unknown language without any common term, goes to the shared model.
    """
    spark = terms.sparkSession
    shared = spark.sparkContext.broadcast((words.kept, words.common, words.left_out))  # bounded by the least share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, common, left_out = shared.value
        number = {t: i for i, t in enumerate(kept)}
        for batch in batches:
            langs, bags, at = [], [], []
            for lang, bag in zip(batch.column("lang").to_pylist(), batch.column("sentences").to_pylist()):
                if lang is None and common:
                    own = set(bag.split())
                    lang = max(sorted(common), key=lambda k: len(own & common[k]) / max(1, len(common[k])) ** 0.5)
                    lang = lang if own & common[lang] else SHARED
                elif lang not in common:
                    lang = SHARED
                without = left_out.get(lang, ())
                pairs = [(t, i) for i, s in enumerate(bag.split(_BREAK)) for t in s.split() if t in number and t not in without]
                langs.append(lang)
                bags.append([t for t, _ in pairs])
                at.append([i for _, i in pairs])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(bags, pa.list_(pa.string())), pa.array([[number[t] for t in b] for b in bags], pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "lang", "terms", "numbers", "sentence_of"])

    kind = terms.schema["doc_id"].dataType.simpleString()
    return terms.mapInArrow(run, f"doc_id {kind}, lang string, terms array<string>, numbers array<int>, sentence_of array<int>")


def first_models(documents: DataFrame, words: Vocabulary, topics: int, seed: int) -> dict[str, tuple[list[str], np.ndarray]]:
    """For each language with terms these and nearly even weights [topics, terms]."""
    here: dict[str, list[str]] = {}
    found = documents.where(F.size("terms") > 0).select("lang", F.explode("terms").alias("t")).distinct()
    for r in sorted(map(tuple, found.collect())):  # a part of the vocabulary for each language
        here.setdefault(r[0], []).append(r[1])
    rng = np.random.default_rng(seed)
    return {k: (here[k], rng.gamma(100.0, 0.01, (topics, len(here[k])))) for k in sorted(words.documents) if k in here}


def fit_topics(documents: DataFrame, words: Vocabulary, topics: int = TOPICS, steps: int = STEPS, seed: int = 11) -> dict[str, tuple[list[str], np.ndarray]]:
    """For each language its terms and the weights [topics, terms] of a topic model of all its documents.

    All languages are fitted by the same jobs, one for each step. A model holds topics * terms numbers, whatever the
    number of documents; what tasks give to it is summed in two levels before it reaches the driver.
    """
    spark = documents.sparkSession
    models = first_models(documents, words, topics, seed)
    if not models:
        return {}
    lookup = _lookups(models, words.kept)
    parts = {k: max(1, min(PARTS, words.documents[k] // PART_DOCUMENTS)) for k in models}
    spread = F.lit(1)
    for k, n in parts.items():
        spread = F.when(F.col("lang") == k, n).otherwise(spread)
    # written by part, so a step reads its own part only; every number of parts up to PARTS divides them evenly enough
    shuffled = documents.select("lang", F.array_sort("numbers").alias("numbers"), F.pmod(F.xxhash64("doc_id"), spread).cast("int").alias("part"), spread.alias("parts"))
    path = scratch_path(spark, "parts")
    shuffled.write.partitionBy("parts", "part").parquet(path)
    parted = spark.read.schema("lang string, numbers array<int>, parts int, part int").parquet(path)
    schema = "lang string, grp int, n bigint, stats binary"

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, "<f4") for x in pdf["stats"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"lang": [key[0]], "grp": [0], "n": [pdf["n"].sum()], "stats": [total.astype("<f4").tobytes()]})

    for step in range(steps):
        current = spark.sparkContext.broadcast((models, lookup))  # topics * terms numbers for each language

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, columns_of = current.value
            total = {k: np.zeros((w.shape[1], w.shape[0])) for k, (_, w) in own.items()}
            n = dict.fromkeys(own, 0)
            for batch in batches:
                for lang, columns, share, seen in _inferred_bags(batch, own, columns_of):
                    order = np.argsort(columns, kind="stable")
                    at = np.flatnonzero(np.diff(columns[order], prepend=-1))
                    total[lang][columns[order][at]] += np.add.reduceat(share[order], at, axis=0)
                    n[lang] += seen
            seen = [k for k in own if n[k]]
            group = sum(n.values()) % 16
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([group] * len(seen), pa.int32()), pa.array([n[k] for k in seen], pa.int64()), pa.array([total[k].T.astype("<f4").tobytes() for k in seen], pa.binary())], names=["lang", "grp", "n", "stats"])

        now = " or ".join(f"parts = {k} and part = {step % k}" for k in sorted(set(parts.values())))
        part = parted.where(now).select("lang", "numbers").mapInArrow(run, schema)
        weight, after = (OFFSET + step) ** -DECAY, dict(models)
        for r in part.groupBy("lang", "grp").applyInPandas(add, schema).groupBy("lang").applyInPandas(add, schema).collect():  # one row a language
            names, old = models[r["lang"]]
            stats = np.frombuffer(r["stats"], "<f4").reshape(old.shape).astype(np.float64)
            after[r["lang"]] = names, (1 - weight) * old + weight * stats * (words.documents[r["lang"]] / r["n"])
        models = after
        current.unpersist()
    return {k: (names, w + TERM_PRIOR) for k, (names, w) in models.items()}


def infer(weights: np.ndarray, columns: np.ndarray, rows: np.ndarray, n: int, rounds: int = 15, prior: float = DOCUMENT_PRIOR, still: float = 0.002, times: np.ndarray | None = None) -> np.ndarray:
    """The share of each term of some documents that falls to each topic, [terms, topics]; ``times`` says how often each
    term stands, and shares are multiplied by it.

    Proportions of topics and shares of terms are found in turn until the proportions change no more by ``still``.
    """
    phi = (weights / weights.sum(1, keepdims=True)).astype(np.float32).T[columns] + np.float32(1e-12)
    begin = np.flatnonzero(np.concatenate([np.ones(1, bool), rows[1:] != rows[:-1]]))
    size = np.diff(np.append(begin, len(rows)))
    theta = np.full((len(begin), weights.shape[0]), 1 / weights.shape[0], np.float32)
    for _ in range(rounds):
        share = phi * np.repeat(theta, size, axis=0)
        share /= share.sum(1, keepdims=True)
        share = share if times is None else share * times[:, None]
        after = np.add.reduceat(share, begin, axis=0) + np.float32(prior)
        after /= after.sum(1, keepdims=True)
        moved = np.abs(after - theta).max()
        theta = after
        if moved < still:
            break
    return share


def _inferred(batch: pa.RecordBatch, models: dict, lookup: dict) -> Iterator[tuple]:
    """(lang, documents of the batch, document of each term by its place in these, column of each term, its shares, its
    sentence), language by language."""
    langs = np.array(batch.column("lang").to_pylist(), dtype=object)
    numbers = batch.column("numbers")
    values, sentence = numbers.flatten().to_numpy(), batch.column("sentence_of").flatten().to_numpy()
    doc_of = np.repeat(np.arange(batch.num_rows), np.diff(numbers.offsets.to_numpy()))
    for lang in models:
        columns = np.where((langs == lang)[doc_of], lookup[lang][values], -1)
        good = columns >= 0
        if good.any():
            docs, rows = np.unique(doc_of[good], return_inverse=True)
            yield lang, docs.tolist(), rows, columns[good], infer(models[lang][1], columns[good], rows, len(docs)), sentence[good]


def _inferred_bags(batch: pa.RecordBatch, models: dict, lookup: dict) -> Iterator[tuple]:
    """(lang, column of each distinct term of each document, its shares times its number, documents), language by
    language; the numbers of a document's terms are sorted."""
    langs = np.array(batch.column("lang").to_pylist(), dtype=object)
    numbers = batch.column("numbers")
    values = numbers.flatten().to_numpy()
    doc_of = np.repeat(np.arange(batch.num_rows), np.diff(numbers.offsets.to_numpy()))
    first = np.flatnonzero((np.diff(values, prepend=-1) != 0) | (np.diff(doc_of, prepend=-1) != 0))
    times = np.diff(np.append(first, len(values))).astype(np.float32)
    values, doc_of = values[first], doc_of[first]
    for lang in models:
        columns = np.where((langs == lang)[doc_of], lookup[lang][values], -1)
        good = columns >= 0
        if good.any():
            docs, rows = np.unique(doc_of[good], return_inverse=True)
            yield lang, columns[good], infer(models[lang][1] + TERM_PRIOR, columns[good], rows, len(docs), rounds=FIT_ROUNDS, times=times[good]), len(docs)


def _lookups(models: dict, kept: list[str]) -> dict[str, np.ndarray]:
    """For each language the column in its model of every kept term, -1 where it has none."""
    number = {t: i for i, t in enumerate(kept)}
    out = {}
    for lang, (terms, _) in models.items():
        out[lang] = np.full(len(kept), -1)
        out[lang][[number[t] for t in terms]] = np.arange(len(terms))
    return out


def labelled_terms(documents: DataFrame, models: dict, kept: list[str], labels: DataFrame, subjects: list[int]) -> dict[str, np.ndarray]:
    """How subjects given by hand go with terms: for each language [terms, subjects].

    A labelled document adds one to each of its terms, shared between its subjects; repeated labels count once. What
    reaches the driver is bounded by terms times subjects.
    """
    lookup = _lookups(models, kept)
    given = _given(labels).groupBy("doc_id").agg(F.collect_set("subject_id").alias("subject_ids"))
    order = {x: i for i, x in enumerate(subjects)}
    own = documents.join(given, "doc_id").select("lang", F.explode(F.array_distinct("numbers")).alias("number"), "subject_ids")
    found = own.select("lang", "number", F.explode("subject_ids").alias("subject"), (1 / F.size("subject_ids")).alias("w")).groupBy("lang", "number", "subject").agg(F.sum("w").alias("w"))
    terms = {k: np.zeros((v[1].shape[1], len(subjects))) for k, v in models.items()}
    for r in found.collect():
        if r["subject"] in order and r["lang"] in terms:
            terms[r["lang"]][lookup[r["lang"]][r["number"]], order[r["subject"]]] += r["w"]
    return terms


def lend_terms(models: dict, terms: dict) -> None:
    """Add to the shared model, for its terms, what labelled documents of the other languages say of them."""
    if SHARED not in models:
        return
    column, lent = {t: i for i, t in enumerate(models[SHARED][0])}, np.zeros_like(terms[SHARED])
    for lang in models.keys() - {SHARED}:
        there = [i for i, t in enumerate(models[lang][0]) if t in column]
        lent[[column[models[lang][0][i]] for i in there]] += terms[lang][there]
    terms[SHARED] += lent


def top_terms(weights: np.ndarray, n: int = TOP_TERMS) -> np.ndarray:
    """The shares [topics, terms] of the ``n`` heaviest terms of each topic, 0 for the others; ties stay together."""
    share = weights / weights.sum(1, keepdims=True)
    least = np.sort(share, axis=1)[:, -min(n, share.shape[1])][:, None]
    return np.where(share >= least, share, 0.0)


def _even(a: np.ndarray) -> np.ndarray:
    """Rows that add up to 1, after subjects have been weighed by how often they are given."""
    a = a / np.maximum(a.sum(0, keepdims=True), 1.0)
    return a / np.maximum(a.sum(1, keepdims=True), 1e-9)


def map_topics(models: dict, terms: dict, trust: float = TRUST) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language the subjects of topics [topics, subjects] and of terms [terms, subjects], in shares.

    A topic has the subjects of its top terms, by their weight in it. A term has the subjects of the topics that hold
    its weight; the labelled documents that have the term speak too, the more the more of them there are, which parts
    topics in which two subjects have met.
    """
    out = {}
    for lang, (_, weights) in models.items():
        even, seen = _even(terms[lang]), terms[lang].sum(1, keepdims=True)
        of_topic = top_terms(weights) @ even
        of_topic /= np.maximum(of_topic.sum(1, keepdims=True), 1e-9)
        by_topic = (weights / weights.sum(0, keepdims=True)).T @ of_topic
        k = trust * (float(np.median(seen[seen > 0])) if (seen > 0).any() else 1.0)
        out[lang] = of_topic, (k * by_topic + seen * even) / (k + seen)
    return out


def assign_subjects(documents: DataFrame, models: dict, kept: list[str], mapped: dict, subjects: list[int], specific: float = SPECIFIC, least_sentences: int = LEAST_SENTENCES, least_proportion: float = LEAST_PROPORTION) -> DataFrame:
    """(doc_id, subject_id, sentences, share): subjects that hold enough of a document's topic proportions, and for which
    terms of enough of its sentences speak.

    ``share`` is the subject's part of the topic proportions. A term speaks for a subject when it is specific to one at
    all and when the topics it falls to in this document and its own subjects together point there. A document without
    such a subject has no row.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((models, _lookups(models, kept), mapped))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lookup, words = shared.value
        for batch in batches:
            doc, subject, many, part = [], [], [], []
            for lang, docs, rows, columns, share, sentence in _inferred(batch, own, lookup):
                of_topic, of_term = words[lang]
                here = (share @ of_topic + 0.02) * of_term[columns]
                here /= here.sum(1, keepdims=True) + 1e-12
                clear = (here.max(1) >= specific) & (of_term[columns].max(1) >= specific * 0.8)
                speaks = np.unique(np.stack([rows[clear], here[clear].argmax(1), sentence[clear]], 1), axis=0)
                pair, count = np.unique(speaks[:, :2], axis=0, return_counts=True)
                proportions = np.zeros((len(docs), of_topic.shape[1]))
                begin = np.flatnonzero(np.diff(rows, prepend=-1))  # terms stand document by document
                proportions[rows[begin]] = np.add.reduceat(share @ of_topic, begin, axis=0)
                proportions /= np.maximum(proportions.sum(1, keepdims=True), 1e-9)
                for (k, s), c in zip(pair, count):
                    if c >= least_sentences and proportions[k, s] >= least_proportion:
                        doc.append(docs[k]), subject.append(subjects[s]), many.append(int(c)), part.append(float(proportions[k, s]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(subject, pa.int32()), pa.array(many, pa.int32()), pa.array(part, pa.float64())], names=["doc_id", "subject_id", "sentences", "share"])

    return documents.select("doc_id", "lang", "numbers", "sentence_of").mapInArrow(run, f"doc_id {kind}, subject_id int, sentences int, share double")


def topic_terms(models: dict, mapped: dict, areas: DataFrame, subjects: list[int], n: int = 10) -> DataFrame:
    """(lang, topic, rank, term, weight, subject_id, subject_share): the heaviest terms of each topic and the subject that
    it is mapped to with that subject's share; ties by term. At most languages * topics * n rows."""
    rows = []
    for lang, (names, weights) in models.items():
        of_topic = mapped[lang][0]
        for k, w in enumerate(weights / weights.sum(1, keepdims=True)):
            best = int(of_topic[k].argmax()) if of_topic.shape[1] else -1
            for rank, i in enumerate(sorted(range(len(names)), key=lambda i: (-w[i], names[i]))[:n], 1):
                rows.append((lang, k, rank, names[i], float(w[i]), subjects[best] if best >= 0 else None, float(of_topic[k, best]) if best >= 0 else None))
    return areas.sparkSession.createDataFrame(rows, "lang string, topic int, rank int, term string, weight double, subject_id int, subject_share double")


def mapped_topics(df: DataFrame, areas: DataFrame, labels: DataFrame, topics: int = TOPICS) -> tuple:
    """(documents, vocabulary, models, mapped, subjects): everything that documents are assigned by."""
    terms = materialize(document_terms(df), "terms")
    words = vocabulary(terms, labels=labels)
    documents = materialize(modelled_terms(terms, words), "modelled")
    models = fit_topics(documents, words, topics)
    subjects = sorted(r["subject_id"] for r in areas.where("subject_id is not null").select("subject_id").distinct().collect())  # a fixed table
    of_terms = labelled_terms(documents, models, words.kept, labels, subjects)
    lend_terms(models, of_terms)
    return documents, words, models, map_topics(models, of_terms), subjects


def document_subjects(df: DataFrame, areas: DataFrame, labels: DataFrame, topics: int = TOPICS) -> DataFrame:
    """(doc_id, subject_id, sentences, share) of every document of ``df`` (doc_id, text, lang)."""
    documents, words, models, mapped, subjects = mapped_topics(df, areas, labels, topics)
    return assign_subjects(documents, models, words.kept, mapped, subjects)


def held_out_agreement(df: DataFrame, areas: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(labelled, found, both): hand-given pairs of the documents of one fold by id, pairs found for these documents with
    the labels of the other folds only, and pairs in both. Labels may be wrong or missing, so neither share can be 1."""
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds)) == 0
    held = _given(labels).where(fold)
    found = document_subjects(df, areas, labels.where(~fold)).join(held.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "subject_id").distinct()
    both = held.withColumn("l", F.lit(1)).join(found.withColumn("f", F.lit(1)), ["doc_id", "subject_id"], "full")
    return both.agg(F.count("l").alias("labelled"), F.count("f").alias("found"), F.count(F.col("l") * F.col("f")).alias("both"))
