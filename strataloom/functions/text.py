"""Column expressions on identifiers, paths, lines and tokens. All stay inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.fixed import COMMENT_WORDS, GENERATED, GENERIC, NOISE

#: A longest run of ASCII letters, digits and underscores, or any other visible character.
TOKENS = r"[A-Za-z0-9_]+|[^ \t\r\n]"


def words(identifier: Column) -> Column:
    """Lower-case words of an identifier, cut at underscores and changes of case: parseHTTPRequest -> parse, http, request."""
    cut = F.regexp_replace(F.regexp_replace(identifier, r"([a-z])([A-Z])", "$1_$2"), r"([A-Z])([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(cut), "_"), lambda w: w != "")


def generic_name(identifier: Column) -> Column:
    return F.arrays_overlap(words(identifier), F.array(*map(F.lit, GENERIC)))


def has_word(identifier: Column, word: str) -> Column:
    return F.array_contains(words(identifier), word)


def predicate_name(identifier: Column) -> Column:
    return identifier.rlike(r"^Is[A-Z0-9_]")


def name_prefix(identifier: Column) -> Column:
    """First of at least two words, else null."""
    w = words(identifier)
    return F.when(F.size(w) >= 2, F.element_at(w, 1))


def occurrences(text: Column, name: Column) -> Column:
    """How often name stands in text as a whole identifier (letters, digits, _, $ and bytes beyond ASCII belong to one)."""
    quoted = F.concat(F.lit(r"(?<![\w$\x{80}-\x{10ffff}])\Q"), name, F.lit(r"\E(?![\w$\x{80}-\x{10ffff}])"))
    return F.when(name == "", 0).otherwise(F.regexp_count(text, quoted))


def comment_words(comment: Column, noise: tuple[str, ...] = NOISE) -> Column:
    return F.filter(F.split(F.lower(comment), r"[^\p{L}\p{Nd}]+"), lambda w: (w != "") & (~w.isin(*noise) if noise else F.lit(True)))


def restates(comment: Column, identifier: Column, noise: tuple[str, ...] = NOISE, cap: int = COMMENT_WORDS) -> Column:
    """The comment says no more than the identifier: the same words, up to endings s, ed, ing and noise words."""
    said, named = comment_words(comment, noise), words(identifier)
    stems = lambda w: F.array(w, F.regexp_replace(w, "s$", ""), F.regexp_replace(w, "ed$", ""), F.regexp_replace(w, "ing$", ""))
    return (
        (F.size(said) > 0) & (F.size(said) <= cap) & (F.size(named) > 0) & (F.size(said) == F.size(named))
        & F.forall(said, lambda w: F.arrays_overlap(stems(w), named))
        & F.forall(named, lambda n: F.exists(said, lambda w: F.array_contains(stems(w), n)))
    )


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def directory(path: Column) -> Column:
    """Directory of a path; the root is the empty string."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.instr(plain, "/") > 0, F.regexp_replace(plain, "/[^/]*$", "")).otherwise("")


def script_language(path: Column) -> Column:
    """go, ts or py by suffix; null for others, declaration files and generated or minified bundles."""
    b = base_name(path)
    skipped = b.endswith(".d.ts") | b.endswith(".gen.ts") | b.contains(".min.")
    return F.when(skipped, None).when(b.endswith(".ts") | b.endswith(".tsx"), "ts").when(b.endswith(".py"), "py").when(b.endswith(".go"), "go")


def test_file(path: Column) -> Column:
    """Test or test-support file by the conventions of its language."""
    b, dirs, lang = base_name(path), F.split(directory(path), "/"), script_language(path)
    stem = F.regexp_replace(b, r"\.tsx?$", "")
    return (
        F.when(lang == "ts", stem.endswith(".test") | stem.endswith(".spec") | F.array_contains(dirs, "__tests__"))
        .when(lang == "py", b.startswith("test_") | b.endswith("_test.py") | (b == "conftest.py") | F.array_contains(dirs, "tests"))
        .otherwise(b.endswith("_test.go"))
    )


def generated_file(content: Column) -> Column:
    return F.array_join(F.slice(F.split(content, "\n"), 1, 5), "\n").rlike(GENERATED)


def line_count(content: Column) -> Column:
    """Lines; an unterminated last one counts."""
    return F.regexp_count(content, F.lit("\n")) + F.when((content != "") & ~content.endswith("\n"), 1).otherwise(0)


def numbered_lines(content: Column) -> Column:
    return F.transform(F.split(content, "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit(": "), line))


def tokens(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(TOKENS), F.lit(0))


def shingles(tokens_: Column, width: int = 5) -> Column:
    """Distinct sequences of ``width`` tokens as 64-bit hashes; fewer tokens give none."""
    n = F.size(tokens_) - width + 1
    at = lambda i: F.xxhash64(*[F.element_at(tokens_, i + j) for j in range(width)])
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at)))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 64 bits, of the UTF-8 bytes of a text, as an unsigned decimal number; null for null. The multiplication
    wraps, which no built-in function does, so texts go through Arrow batches, byte by byte for all of a batch at once."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        raw = [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(r or b"") for r in raw], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat, starts = np.frombuffer(b"".join(r or b"" for r in raw), np.uint8), np.cumsum(sizes) - sizes
        h = np.full(len(raw), 14695981039346656037, np.uint64)
        live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
        for i, n in enumerate(live):
            rows = order[:n]
            h[rows] = (h[rows] ^ flat[starts[rows] + i]) * np.uint64(1099511628211)
        return pd.Series([None if r is None else str(x) for r, x in zip(raw, h.tolist(), strict=True)], dtype=object)

    return run(text)


def jaccard(left: Column, right: Column) -> Column:
    """Share of what either set holds that both hold; 0 where one is empty. The sets must be distinct."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) < 1) | (F.size(right) < 1), 0.0).otherwise(both / (F.size(left) + F.size(right) - both))


def pair_id(left: Column, left_hash: Column, right: Column, right_hash: Column, prefix: str = "sim-") -> Column:
    """Order-free name of a pair: prefix and the first 16 hex digits of the digest of its sorted ends."""
    nul = F.lit("\x00")
    ends = F.array_sort(F.array(F.concat(left, nul, left_hash), F.concat(right, nul, right_hash)))
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(ends, "\x00"), 256), 1, 16))


def position(file: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"), column.cast("string"))


def listing(items: Column) -> Column:
    """a; a and b; a, b and c. Empty for no items."""
    n = F.size(items)
    return F.when(n < 1, "").when(n == 1, F.element_at(items, 1)).otherwise(
        F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1))
    )


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none outside; blank texts are null."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(plain != "", plain)


#: Words and characters of a description (fixed values).
DESCRIPTION_WORDS, DESCRIPTION_CHARS = (4, 40), 240


def description_fits(text: Column) -> Column:
    """Does a description keep the limits? White space counts as one blank; null does not."""
    plain = squeeze(text)
    return F.coalesce(F.size(F.split(plain, " ")).between(*DESCRIPTION_WORDS) & (F.length(plain) <= DESCRIPTION_CHARS), F.lit(False))


def printf_directives(text: Column) -> Column:
    """The formatting directives of a printf text, without %%."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"%[-+# 0]*[0-9*]*(?:\.[0-9*]+)?[a-zA-Z%]"), F.lit(0)), lambda d: ~d.endswith("%"))


def compare(left: Column, op: str, right: Column) -> Column:
    """Ordered comparison by operator text."""
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right, "==": left == right, "!=": left != right}[op]


#: Operators with their sides exchanged (fixed values).
REVERSED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


def both_known(a: Column, b: Column) -> Column:
    """Three-valued and: false if either is, unknown if undecided."""
    return a & b


def either_known(a: Column, b: Column) -> Column:
    """Three-valued or: true if either is, unknown if undecided."""
    return a | b
