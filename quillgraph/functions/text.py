"""Column functions: paths, languages, hashes, tokens, calls, sizes. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph import schema

# Words that precede "(" without being a call.
CALL_STOP = "if for while switch catch require import return console log error warn info typeof sizeof new def class func fn lambda struct".split()


# What separates words, the letters and digits of a token, the two places where a word is split, and a token's length.
WORD_GAPS = r"[\s,.;:()\[\]{}<>\"'`\\/|!?*+=~^%#@&$-]+"
NO_TOKEN, LOWER_UPPER, UPPER_WORD = "[^a-zA-Z0-9]", "([a-z0-9])([A-Z])", "([A-Z]+)([A-Z][a-z])"
SHORTEST, LONGEST = 2, 50


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty for names without one or that only begin with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in sorted(schema.EXTENSIONS.items()) for x in kv]
    return F.coalesce(F.create_map(*pairs)[extension(path)], F.lit("unknown"))


def content_hash(content: Column) -> Column:
    return F.sha2(F.encode(content, "UTF-8"), 256)


def ignored(path: Column) -> Column:
    """Whether a relative path is never scanned."""
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    low, hit = F.lower(norm), F.arrays_overlap(F.split(norm, "/"), F.array(*[F.lit(s) for s in schema.IGNORED_SEGMENTS]))
    for s in schema.IGNORED_SUFFIXES:
        hit = hit | low.endswith(s)
    return hit


def scanned(path: Column, size: Column) -> Column:
    return ~ignored(path) & extension(path).isin(schema.SCANNED) & (size <= schema.MAX_FILE_BYTES)


def secret_file(path: Column) -> Column:
    return F.lower(basename(path)).rlike("|".join(f"(?:{p})" for p in schema.SECRET_NAMES))


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n", -1))


def line_of(content: Column, position: Column) -> Column:
    """Line number of a 0-based character position."""
    return F.length(F.substring(content, F.lit(1), position)) - F.length(F.replace(F.substring(content, F.lit(1), position), F.lit("\n"), F.lit(""))) + 1


def source_lines(content: Column, start: Column, end: Column, around: int = 2) -> Column:
    """Lines ``start`` to ``end`` (from 1) with up to ``around`` more on each side, as one text."""
    lines = F.split(content, "\n", -1)
    first = F.greatest(start - around, F.lit(1))
    last = F.least(end + around, F.size(lines))
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def symbol_tokens(name: Column) -> Column:
    """Distinct lower-case tokens of 2 to 50 letters and digits, in order of first appearance."""
    clean = F.trim(F.coalesce(name, F.lit("")))
    segments = F.filter(F.split(clean, NO_TOKEN + "+"), lambda s: s != "")
    split = lambda s: F.split(F.regexp_replace(F.regexp_replace(s, LOWER_UPPER, "$1 $2"), UPPER_WORD, "$1 $2"), " ")
    words = F.flatten(F.transform(segments, lambda s: F.concat(F.array(F.lower(s)), F.transform(split(s), F.lower))))
    all_ = F.concat(words, F.array(F.lower(F.regexp_replace(clean, NO_TOKEN, ""))))
    kept = lambda ws: F.filter(ws, lambda w: F.length(w).between(SHORTEST, LONGEST))
    # a word in lower case, but for its first letter, has one token and needs no splitting
    return F.when(clean.rlike(r"^[A-Za-z]?[a-z0-9]*\z"), kept(F.array(F.lower(clean)))).otherwise(F.array_distinct(kept(all_)))


def text_tokens(text: Column) -> Column:
    """Distinct symbol tokens of the words of a text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAPS), lambda s: F.length(s) >= SHORTEST)
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(words), symbol_tokens)))


def calls(body: Column) -> Column:
    """Distinct names called in a piece of code, by pattern, in order."""
    names = F.regexp_extract_all(body, F.lit(r"(?:\.|\b)([A-Za-z0-9_$]+)\s*\("), F.lit(1))
    return F.array_distinct(F.filter(names, lambda n: ~n.isin(CALL_STOP)))


def token_cost(text: Column, per_token: float = 3.8) -> Column:
    return F.ceil(F.length(text) / F.lit(per_token)).cast("long")


def savings(part: Column, whole: Column) -> Column:
    """Percent of the tokens of ``whole`` that ``part`` spares, to two digits; 0 for nothing at all."""
    return F.when(whole > 0, F.round((F.lit(1.0) - part / whole) * 100, 2)).otherwise(F.lit(0.0))


def risk(total: Column, files: Column, routes: Column) -> Column:
    """Risk of a change from the callers, files and routes that it reaches."""
    return (
        F.when((routes > 0) | (total > 15) | (files > 5), "CRITICAL").when((total > 6) | (files > 2), "HIGH").when(total > 1, "MEDIUM").otherwise("LOW")
    )


def risk_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in schema.RISKS]), level)
