"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from quillgrid.functions import patterns as P

SPACE = r"[ \t\n\r\f]+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it; inside a lambda it would be each time."""
    return F.element_at(F.transform(F.array(value), f), 1)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null, empty and blank texts."""
    return zero_if_null(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")))


def line_count(text: Column) -> Column:
    """Lines between newlines; an empty text has one, a null none."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))


def sentence_count(text: Column) -> Column:
    """Runs of sentence marks; 0 for null."""
    return zero_if_null(F.regexp_count(text, F.lit(r"[.!?]+")))


def count_of(text: Column, word: str) -> Column:
    """Occurrences of a literal, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def weighted_score(text: Column, weights: dict[str, float]) -> Column:
    """Sum of weight times number of matches over lower-cased text; 0.0 for null."""
    low = F.lower(text)
    parts = [F.regexp_count(low, F.lit(p)) * F.lit(w) for p, w in weights.items()]
    return F.coalesce(reduce(lambda a, b: a + b, parts), F.lit(0.0)).cast("double")


def best_of(scores: dict[str, Column], default: Column) -> Column:
    """Name of the highest positive score; the first of equals wins; ``default`` where none is positive."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.when(top <= 0, default)
    for name, score in scores.items():
        out = out.when(score == top, F.lit(name))
    return out.otherwise(default)


def language_score(text: Column, language: str) -> Column:
    """Weighted matches by length: min(1, sum / (characters / 1000 + 1))."""
    return F.least(F.lit(1.0), weighted_score(text, P.LANGUAGE_WEIGHTS[language]) / (F.coalesce(F.length(text), F.lit(0)) / 1000 + 1))


def code_language(text: Column) -> Column:
    """The programming language with the highest score, null without any."""
    return best_of({k: language_score(text, k) for k in P.LANGUAGE_WEIGHTS}, F.lit(None).cast("string"))


def content_type(text: Column) -> Column:
    """One of the weighted content types, or "documentation"."""
    return best_of({k: weighted_score(text, w) for k, w in P.CONTENT_TYPE_WEIGHTS.items()}, F.lit("documentation"))


def doc_type(kind: Column) -> Column:
    """The document type of a content type; "reference" for others."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in P.DOC_TYPES.items() for x in kv])[kind], F.lit("reference"))


def section_type(text: Column) -> Column:
    """code, api, example or text: one match decides for code, two for the others; null counts as text."""
    low = F.lower(text)
    hits = {k: reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in ps]) for k, ps in P.SECTION_TYPES.items()}
    return F.when(hits["code"] >= 1, "code").when(hits["api"] >= 2, "api").when(hits["example"] >= 2, "example").otherwise("text")


def hierarchy_level(name: Column, text: Column) -> Column:
    """Level of a section by words in its name, then by its first kind of header, else 2."""
    low, out = F.lower(F.coalesce(name, F.lit(""))), None
    for level, keys in P.HIERARCHY:
        cond = reduce(lambda a, b: a | b, [low.contains(k) for k in keys])
        out = F.when(cond, level) if out is None else out.when(cond, level)
    return out.when(text.rlike(r"(^|\n)# "), 0).when(text.rlike(r"(^|\n)## "), 1).when(text.rlike(r"(^|\n)### "), 2).otherwise(2)


def technologies(text: Column) -> Column:
    """Names of mentioned technologies, whole words only, in alphabetical order; empty for null."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(f"(^|[^a-z0-9_])({p})($|[^a-z0-9_])"), F.lit(k)) for k, p in P.TECHNOLOGIES.items()]))


def feature(text: Column, name: str) -> Column:
    return F.coalesce(text.rlike(P.FEATURES[name]), F.lit(False))


def complexity(text: Column) -> Column:
    """0 to 1 from technical words by length, shapes of code and request methods; 0 for null."""
    low, words = F.lower(text), word_count(text)
    terms = reduce(lambda a, b: a + b, [count_of(low, w) for w in P.TECHNICAL_WORDS])
    shapes = reduce(lambda a, b: a + b, [F.regexp_count(low, F.lit(p)) for p in P.CODE_SHAPES])
    calls = F.regexp_count(text, F.lit("GET|POST|PUT|DELETE|PATCH"))
    dense = F.when(words > 0, F.least(F.lit(0.3), terms / words * 10)).otherwise(0.0)
    return F.coalesce(F.least(F.lit(1.0), dense + F.least(F.lit(0.4), shapes / 20) + F.least(F.lit(0.3), calls / 10)), F.lit(0.0))


def technical_depth(score: Column) -> Column:
    return F.when(score < 0.3, "beginner").when(score < 0.7, "intermediate").otherwise("advanced")


def readability(text: Column) -> Column:
    """0 to 1 from sentence length, structure and clarity words; 0 for null and blank texts, 0.5 without a sentence."""
    parts = F.regexp_count(text, F.lit(r"[^.!? \t\n\r\f][^.!?]*"))  # runs between sentence marks that aren't blank
    mean = word_count(text) / F.nullif(parts, F.lit(0))
    length = F.when((mean >= 5) & (mean <= 20), 1.0).when(mean < 5, 0.6).otherwise(F.greatest(F.lit(0.2), 1.0 - (mean - 20) / 50))
    shape = F.when(text.contains("\n\n"), 0.3).otherwise(0.0) + F.when(text.rlike(r"(^|\n)#+ "), 0.3).otherwise(0.0) + F.when(text.rlike(r"(^|\n)(\* |[0-9]+\. )"), 0.2).otherwise(0.0)
    low = F.lower(text)
    clear = F.least(F.lit(0.2), reduce(lambda a, b: a + b, [F.when(low.contains(w), 0.1).otherwise(0.0) for w in P.CLARITY]))
    return F.when(word_count(text) == 0, 0.0).when(parts == 0, 0.5).otherwise(F.least(F.lit(1.0), length * 0.5 + shape + clear))


def completeness(text: Column) -> Column:
    """0 to 1 from length and from the parts that a complete text has; 0 for null."""
    n, low = F.length(text), F.lower(text)
    size = F.when(n > 1000, 0.5).when(n > 500, 0.4).when(n > 100, 0.2).otherwise(0.0)
    return F.coalesce(F.least(F.lit(1.0), size + reduce(lambda a, b: a + b, [F.when(low.rlike(p), 0.1).otherwise(0.0) for p in P.PARTS])), F.lit(0.0))


def usefulness(text: Column) -> Column:
    """0 to 1 from features and practical words; 0 for null."""
    low = F.lower(text)
    weights = {"has_code_examples": 0.3, "has_api_references": 0.2, "has_installation_instructions": 0.2, "has_configuration_details": 0.1}
    base = reduce(lambda a, b: a + b, [F.when(feature(text, k), w).otherwise(0.0) for k, w in weights.items()])
    hints = F.least(F.lit(0.2), reduce(lambda a, b: a + b, [F.when(low.contains(w), 0.05).otherwise(0.0) for w in P.PRACTICAL]))
    return F.coalesce(F.least(F.lit(1.0), base + F.coalesce(hints, F.lit(0.0))), F.lit(0.0))


def token_estimate(text: Column) -> Column:
    """The greater of words and a quarter of the characters; 0 for null."""
    return F.greatest(word_count(text), F.floor(zero_if_null(F.length(text)) / 4)).cast("bigint")


def keywords(text: Column, least: int = 3) -> Column:
    """Distinct lower-cased words of ASCII letters, digits and underscores without stop words, sorted; empty for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*P.KEYWORD_STOP_WORDS))))


def comparable(text: Column) -> Column:
    """Lower-cased words with abbreviations spelt out, synonyms replaced and stop words left out; empty for null."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " ")), F.lit(" "))
    for mark in ("```", "<code>", "</code>"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    for old, new in (*P.ABBREVIATIONS, *P.SYNONYMS):
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.array_join(F.filter(F.split(out, " "), lambda w: (w != "") & ~w.isin(*P.STOP_WORDS)), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Common members of two arrays by members of either; 0.0 where either is empty or null."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def sanitized_id(name: Column) -> Column:
    """A library id as a file name: forbidden characters become underscores, dots and underscores are collapsed."""
    out = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r'[<>:"/\\|?*]+', "_")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\.{2,}", "."), r"_{2,}", "_"), r"^[._ ]+|[._ ]+$", "")
    out = F.when(F.upper(out).isin("CON", "PRN", "AUX", "NUL"), F.concat(out, F.lit("_lib"))).when(out == "", F.lit("unknown_library")).otherwise(out)
    return F.when(F.length(out) > 100, F.concat(F.substring(out, 1, 80), F.lit("_"), F.substring(F.md5(out), 1, 8))).otherwise(out)


def compact_number(n: Column) -> Column:
    """1.2M, 3.4K, plain below a thousand, "-" for null and 0."""
    tenth = lambda unit: F.concat(F.floor(n / (unit / 10)).cast("bigint").cast("string"), F.lit(""))
    scaled = lambda unit, mark: F.concat(F.floor(n / unit).cast("string"), F.lit("."), F.pmod(tenth(unit).cast("bigint"), F.lit(10)).cast("string"), F.lit(mark))
    return F.when(n.isNull() | (n == 0), "-").when(n >= 1_000_000, scaled(1_000_000, "M")).when(n >= 1_000, scaled(1_000, "K")).otherwise(n.cast("string"))


def error_kind(message: Column) -> Column:
    """The first kind whose pattern the message has, "unknown" for others, null for null."""
    low, out = F.lower(message), F.when(message.isNull(), F.lit(None).cast("string"))
    for kind, p in P.ERROR_KINDS:
        out = out.when(low.rlike(p), kind)
    return out.otherwise("unknown")


def first_line_title(text: Column) -> Column:
    """The first line of over 10 characters that doesn't begin with =, - or #, cut to 100 with an ellipsis; null without."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 10) & ~x.rlike("^[=#-]"))
    first = F.try_element_at(lines, F.lit(1))
    return F.when(F.length(first) > 100, F.concat(F.substring(first, 1, 100), F.lit("..."))).otherwise(first)


def highlighted(text: Column, term: str) -> Column:
    """Every occurrence of a term (letters and digits), case ignored, between <em> marks."""
    return F.regexp_replace(text, f"(?i)({term})", "<em>$1</em>")


def language_votes(text: Column, language: str) -> Column:
    """Matches of a language's patterns, each counting one; 0.0 for null."""
    return weighted_score(text, dict.fromkeys(P.LANGUAGE_WEIGHTS[language], 1.0))


def code_examples(text: Column) -> Column:
    """Fenced and inline code, code elements and prompts; 0 for null."""
    return zero_if_null(reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in P.CODE_EXAMPLES]))


def api_references(text: Column) -> Column:
    """Definitions, decorators, request methods and routes; 0 for null."""
    return zero_if_null(reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in P.API_REFERENCES]))


def has_installation(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(w) for w in P.INSTALL_COMMANDS]), F.lit(False))


def entry_type(kind: Column, code: Column, text: Column) -> Column:
    """An entry's type by its section's name, its code, then words of its text; "documentation" for the rest."""
    k, low = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    out = F.when(k.contains("code"), "code_snippet").when(k.contains("qa"), "qa_section").when(k.contains("example"), "example").when(k.contains("documentation"), "documentation")
    out = out.when((F.coalesce(code, F.lit("")) != "") | low.contains("```"), "code_snippet")
    for name, words in P.ENTRY_TYPES:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), name)
    return out.otherwise("documentation")


def name_domain(name: Column) -> Column:
    """The domain of a library by the first class of which its name has a part; "general" for others."""
    low, out = F.lower(F.coalesce(name, F.lit(""))), None
    for domain, parts in P.NAME_DOMAINS.items():
        cond = reduce(lambda a, b: a | b, [low.contains(p) for p in parts])
        out = F.when(cond, domain) if out is None else out.when(cond, domain)
    return out.otherwise("general")


def description_lines(text: Column, most: int = 300) -> Column:
    """Lines 2 to 5 of a text in one, cut to ``most`` characters; null for null, empty without such lines."""
    return F.substring(F.trim(F.array_join(F.transform(F.slice(F.split(text, "\n"), 2, 4), lambda x: F.trim(x)), " ")), 1, most)


def technical_accuracy(language: Column, claimed: Column, kind: Column, chunk: Column, text: Column) -> Column:
    """0.5 to 1.0 from whether found and claimed language and type agree, and from whole and indented code."""
    expected = F.when(kind == "api_reference", "api").when(kind == "tutorial", "example").otherwise("text")
    fences = F.regexp_count(text, F.lit("```"))
    code = F.when(feature(text, "has_code_examples"), F.when((fences > 0) & (fences % 2 == 0), 0.1).otherwise(0.0) + F.when(text.rlike(r"(^|\n)(    |\t)"), 0.1).otherwise(0.0)).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + F.when(F.coalesce(language == claimed, F.lit(False)), 0.2).otherwise(0.0) + F.when(F.coalesce(expected == chunk, F.lit(False)), 0.1).otherwise(0.0) + code)


def chunk_completeness(text: Column, strategy: Column) -> Column:
    """0 to 1 from what a whole chunk of its strategy holds and from whether it ends naturally; 0 for null and blank."""
    fences, low = F.regexp_count(text, F.lit("```")), F.lower(text)
    code = F.when(text.rlike(r"(^|\n)\s*(def\s+\w+\([^)]*\):|class\s+\w+)"), 0.4).when((fences > 0) & (fences % 2 == 0), 0.3).otherwise(0.1)
    api = F.when(text.rlike(r"(GET|POST|PUT|DELETE|PATCH)\s+/"), 0.2 + F.when(low.contains("response"), 0.2).otherwise(0.0) + F.when(low.contains("parameter"), 0.2).otherwise(0.0) + F.when(low.contains("example"), 0.2).otherwise(0.0)).otherwise(0.0)
    prose = F.when(text.rlike(r"[.!?]"), 0.4).otherwise(0.0) + F.when(text.contains("\n\n"), 0.2).otherwise(0.0)
    by_strategy = F.when(strategy == "code_aware", code).when(strategy == "api", api).when(strategy == "narrative", prose).otherwise(0.0)
    ends = F.when(text.rlike(r"([.!?})]|```)$"), 0.1).otherwise(0.0)
    return F.coalesce(F.when(word_count(text) > 0, F.least(F.lit(1.0), 0.3 + by_strategy + ends)), F.lit(0.0))


def recency_step(at: Column, as_of: Column) -> Column:
    """0.5 within a day, 0.3 within a week, else 0; 0 without a time."""
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 3_600_000_000
    return F.when(hours <= 24, 0.5).when(hours <= 168, 0.3).otherwise(0.0)


def cut_words(text: Column, most: int) -> Column:
    """A text of more than ``most`` words cut to its first ones with single blanks between them; others unchanged."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.when(F.size(words) > most, F.array_join(F.slice(words, 1, most), " ")).otherwise(text)
