"""Text functions as column expressions: tokens, entities, topics, references, classification, normalisation.

Word characters are letters, digits and '_' of any script, spelled out: \\w and \\b differ between engines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words

RUN = r"[\p{L}\p{N}_]+"


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def runs(text: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(0))


def any_in(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def count_in(text: Column, parts) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in parts])


def dedupe_by(items: Column, key) -> Column:
    """items without those whose key an earlier one has; items is evaluated once."""
    none = F.struct(strings([]).alias("seen"), strings([]).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        more = F.struct(F.concat(acc["seen"], F.array(key(x))).alias("seen"), F.concat(acc["out"], F.array(x)).alias("out"))
        return F.when(F.array_contains(acc["seen"], key(x)), acc).otherwise(more)

    return F.aggregate(items, none, add, lambda acc: acc["out"])


def long_words(text: Column) -> Column:
    """Lower-cased words of at least two characters, stop words among them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def text_tokens(text: Column) -> Column:
    """Lower-cased words of at least two characters that are no stop words (all occurrences)."""
    return F.filter(long_words(text), lambda w: ~w.isin(words.STOP_WORDS))


def code_tokens(code: Column) -> Column:
    """Distinct lower-cased words with the parts of camelCase and snake_case names; keywords stay though stop words."""
    dropped = sorted(set(words.STOP_WORDS) - set(words.CODE_KEYWORDS))

    def expand(t: Column) -> Column:
        low = F.lower(t)
        camel = F.regexp_extract_all(t, F.lit("[a-z]+|[A-Z][a-z]*"), F.lit(0))
        shout = (F.upper(t) == t) & (F.lower(t) != t)
        camel = F.when((F.size(camel) > 1) & ~shout, F.transform(camel, F.lower)).otherwise(strings([]))
        snake = F.when(low.contains("_"), F.filter(F.split(low, "_"), lambda p: (p != "") & ~p.isin(words.STOP_WORDS))).otherwise(strings([]))
        return F.when(low.isin(dropped), strings([])).otherwise(F.concat(F.array(low), camel, snake))

    found = F.regexp_extract_all(code, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(found, expand)))


def entities(text: Column) -> Column:
    """camelCase, snake_case, Capitalised and backticked names, each once whatever its case, of at least 3 characters."""

    def named(found: Column) -> Column:
        camel = F.filter(found, lambda w: w.rlike("^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$"))
        snake = F.filter(found, lambda w: w.contains("_") & w.rlike("^[a-z_][a-z0-9_]{2,}$"))
        capital = F.filter(found, lambda w: w.rlike("^[A-Z][A-Za-z0-9]{2,}$"))
        return F.concat(camel, snake, capital)

    words_ = F.transform(F.array(F.array_distinct(runs(text))), named)[0]  # as an array's only item the words are found once
    ticked = F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))
    every = F.array_distinct(F.concat(words_, ticked))
    return dedupe_by(F.filter(every, lambda w: F.length(w) >= 3), F.lower)


def topic(text: Column, names: Column) -> Column:
    """The topic with the most keywords in the text or its entities; ties: the earlier topic; none: general."""
    both = F.concat(F.lower(text), F.lit(" "), F.lower(F.array_join(names, " ")))
    scores = F.array(*[F.struct(count_in(both, keys).alias("s"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, keys) in enumerate(words.TOPICS.items())])
    best = F.array_max(scores)
    return F.when(best["s"] > 0, best["t"]).otherwise("general")


def tag_confidence(names: Column) -> Column:
    return F.least(F.lit(1.0), F.size(names) / 5.0)


def suggested_tags(names: Column, subject: Column, similar: Column, most: int = 5) -> Column:
    """Three entities, the topic, and two similar existing tags, each once whatever its case."""
    every = F.concat(F.slice(names, 1, 3), F.array(F.concat(F.lit("topic:"), subject)), F.slice(similar, 1, 2))
    return F.slice(dedupe_by(every, F.lower), 1, most)


def code_references(text: Column) -> Column:
    """Backticked identifiers, file names, and names before function, method, class or implementation; in order, once."""
    ticked = F.regexp_extract_all(text, F.lit(r"`([a-zA-Z_][a-zA-Z0-9_./]*)`"), F.lit(1))
    files = F.regexp_extract_all(text, F.lit(r"(?:^|[\s(])((?:\.?\.?/)?[a-zA-Z0-9_\-/]+\.[a-zA-Z]{1,4})(?::\d+)?(?:[\s),]|$)"), F.lit(1))
    named = F.regexp_extract_all(text, F.lit(r"(?i)\b([a-z][a-z0-9_]{2,})\s+(?:function|method|class|implementation)\b"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(F.concat(ticked, files, named), lambda r: F.trim(r))), lambda r: r != "")


def query_class(query: Column) -> Column:
    q = F.lower(query)
    has_code, security, explains = any_in(q, words.CODE_TERMS), any_in(q, words.SECURITY_TERMS), any_in(q, words.EXPLAINING)
    return (
        F.when(reduce(lambda a, b: a | b, [q.rlike(p) for p, _, _ in words.DATAFLOW_PATTERNS]), "dataflow")
        .when(any_in(q, words.STRONG_CODE), "code")
        .when(any_in(q, words.ACTIONS) & has_code, "code")
        .when(security & any_in(q, words.CODE_INDICATORS), "hybrid")
        .when(explains & has_code, "hybrid")
        .when(security & explains, "hybrid")
        .otherwise("text")
    )


def code_confidence(query: Column) -> Column:
    q = F.lower(query)
    hits = lambda patterns: reduce(lambda a, b: a + b, [q.rlike(p).cast("int") for p in patterns])
    total = F.least(count_in(q, words.CODE_WORDS), F.lit(5)) + F.least(hits(words.CODE_PATTERNS) * 1.5, F.lit(3.0)) + F.least(hits(words.CODE_QUESTIONS), F.lit(2))
    return F.least(total / 10.0, F.lit(1.0))


def tool(query: Column) -> Column:
    q = F.lower(query)
    out = F.when(q.rlike(words.TOOLS[0][0]), words.TOOLS[0][1])
    for pattern, name in words.TOOLS[1:]:
        out = out.when(q.rlike(pattern), name)
    return out.when(any_in(q, words.TOOL_TERMS), words.FALLBACK_TOOL)


def dataflow_ends(query: Column) -> tuple[Column, Column]:
    """Source and sink of the first data-flow pattern that a question has; null without one."""
    q = F.lower(query)
    ends = []
    for side in (1, 2):
        first, *rest = words.DATAFLOW_PATTERNS
        out = F.when(q.rlike(first[0]), F.regexp_extract(q, first[0], first[side]))
        for p in rest:
            out = out.when(q.rlike(p[0]), F.regexp_extract(q, p[0], p[side]))
        ends.append(out)
    return ends[0], ends[1]


def word_after(query: Column, prefixes: list[str]) -> Column:
    """The first word after the first of the prefixes that the question has, without quotes; null without one."""
    out = None
    for p in prefixes:
        rest = F.btrim(F.substr(query, F.locate(p, F.lower(query)) + len(p)), F.lit(" ?."))
        word = F.regexp_replace(F.element_at(F.split(rest, " +"), 1), "[\"']", "")
        hit = F.lower(query).contains(p)
        out = F.when(hit, word) if out is None else out.when(hit, word)
    return F.nullif(out, F.lit(""))


def chain_ends(query: Column) -> tuple[Column, Column]:
    pattern = r"(?i)(from|between)\s+(.+?)\s+(to|and)\s+(.+)"
    hit = query.rlike(pattern)
    return F.when(hit, F.trim(F.regexp_extract(query, pattern, 2))), F.when(hit, F.btrim(F.regexp_extract(query, pattern, 4), F.lit(" ?.")))


def safe_expansions(terms: Column) -> Column:
    """Expansion terms that are no identifiers."""
    trimmed = F.transform(terms, lambda t: F.trim(t))
    starts = lambda t: reduce(lambda a, b: a | b, [F.lower(t).startswith(s) for s in words.IDENTIFIER_STARTS])
    return F.filter(trimmed, lambda t: (t != "") & ~t.rlike("[a-z0-9][A-Z]") & ~t.contains("_") & ~t.rlike("[./()@]") & ~starts(t))


def normal_triple_part(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def span_key(s: Column) -> Column:
    """A surface form without title, qualifier and article, words joined by '_'."""
    s = F.trim(F.lower(s))
    for pattern, to in ((r"^dr\.?\s+", ""), (r"\s+robotic arm$", ""), (r"^(the|a|an)\s+", ""), (r"^the_company$", "nova_dynamics"), (r"[^a-z0-9]+", " ")):
        s = F.regexp_replace(s, pattern, to)
    return F.replace(F.trim(s), F.lit(" "), F.lit("_"))


def relative_date(said: Column, published: Column) -> Column:
    """The day before publication for 'yesterday', else the day of publication."""
    day = F.to_date(F.substring(published, 1, 10))
    return F.date_format(F.when(F.trim(F.lower(said)).isin("yesterday", "dün"), F.date_sub(day, 1)).otherwise(day), "yyyy-MM-dd")


def safe_query(query: Column, most: int = 10_000) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.replace(query, F.lit("\0"), F.lit("")), r"\s+", " ")), 1, most)


def safe_filename(name: Column, most: int = 255) -> Column:
    s = F.regexp_replace(F.replace(name, F.lit("\0"), F.lit("")), r'[<>:"/\\|?*]', "_")
    s = F.regexp_replace(s, r"^[. \t\n\r]+|[. \t\n\r]+$", "")
    extension = F.regexp_extract(s, r"[^.](\.[^.]*)$", 1)
    cut = F.concat(F.left(s, F.lit(most) - F.length(extension) - 1), extension)
    s = F.when(F.length(s) > most, cut).otherwise(s)
    return F.when(F.upper(s).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("_"), s)).otherwise(F.nullif(s, F.lit("")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.lower(path), r"[/\\]"), -1)


def file_type_multiplier(path: Column) -> Column:
    name = file_name(path)
    extension = F.when(name.contains("."), F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).otherwise("")
    return (
        F.when(name.isin(words.META_NAMES), 0.3)
        .when(extension.isin(words.CONFIG_EXTENSIONS) | name.isin(words.CONFIG_NAMES), 0.4)
        .when(extension.isin(words.CODE_EXTENSIONS), 1.3)
        .otherwise(1.0)
    )


def query_path_boost(query: Column, path: Column) -> Column:
    q, p = F.trim(F.lower(query)), F.lower(F.coalesce(path, F.lit("")))
    long = F.filter(F.split(q, r"\s+"), lambda w: F.length(w) > 3)
    in_path = F.split(F.regexp_replace(p, r"[/\\.\-]", " "), r"\s+")
    compact = F.regexp_replace(p, r"[/\\.\-_]", "")
    return (
        F.when(p.contains(q), 0.30)
        .when((F.size(long) >= 2) & F.forall(long, lambda w: F.array_contains(in_path, w)), 0.20)
        .when((F.size(long) == 1) & compact.contains(F.element_at(long, 1)), 0.25)
        .otherwise(0.0)
    )


def version_parts(v: Column) -> Column:
    """(major, minor, patch) of a semantic version, null for anything else."""
    pattern = r"^v?(\d+)\.(\d+)\.(\d+)$"
    part = lambda i: F.regexp_extract(v, pattern, i).try_cast("int")
    return F.when(v.rlike(pattern), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def noisy_symbol(name: Column) -> Column:
    return name.isin(words.GENERIC_SYMBOLS) | name.startswith("test_") | name.startswith("Test") | name.endswith("_test") | (F.length(name) <= 1)


def skipped_call(caller: Column, callee: Column) -> Column:
    return (caller == "") | caller.startswith("<") | (callee == "") | callee.startswith("<") | (caller == callee) | callee.isin(words.SKIPPED_CALLS) | callee.startswith("__")


def hash_slots(token: Column, size: int = 384) -> tuple[Column, Column]:
    """(slot, sign) of a token for feature hashing: crc32 of its ASCII characters, sign by the top bit."""
    h = F.crc32(F.regexp_replace(token, r"[^\x00-\x7e]", ""))
    return (h % size).cast("int"), F.when(F.shiftright(h, 31) == 1, 1.0).otherwise(-1.0)


def markdown(text: Column) -> Column:
    """Line ends as LF, lines right-trimmed, at most two blank lines in a row, and a blank line after a heading."""
    s = F.regexp_replace(text, r"\r\n?", "\n")
    s = F.regexp_replace(s, r"(?m)[ \t\f\x0B]+$", "")
    # n line ends between texts leave n - 1 blank lines, before the first or after the last text n, without any text n + 1.
    for pattern, to in ((r"^\n+\z", "\n"), (r"^\n{3,}(?=[^\n])", "\n\n"), (r"(?<=[^\n])\n{3,}\z", "\n\n"), (r"\n{4,}", "\n\n\n")):
        s = F.regexp_replace(s, pattern, to)
    return F.regexp_replace(s, r"(?m)^(#[^\n]*)\n(?=[^\n])", "$1\n\n")


def whitespace_tokens(text: Column) -> Column:
    """The documented token count: words between white space."""
    return F.regexp_count(text, F.lit(r"[^\s]+"))
