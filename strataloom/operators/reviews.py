"""Items that a reviewer decides: requests, votes, and the findings that stand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators import findings as R
from strataloom.operators import models as M
from strataloom.runtime import Scratch

#: Verdicts of each kind of item, the accepting one first, and the finding each other one gives (fixed values).
VERDICTS = {
    "comment": ("keep", "restates", "excuse", "crutch"),
    "error": ("handled", "swallowed"),
    "test": ("sound", "trivial", "mock_only", "wasteful"),
    "serial": ("serial_ok", "serial_excuse"),
    "helper": ("own_job", "fragment"),
}
KINDS = {
    "restates": "comment_noise", "excuse": "comment_excuse", "crutch": "comment_crutch", "swallowed": "swallowed_error", "trivial": "test_trivial",
    "mock_only": "test_mock_only", "wasteful": "test_wasteful", "serial_excuse": "test_serial_excuse", "fragment": "helper_fragment",
}
#: Words and characters of an advice (fixed values).
LEAST_WORDS, MOST_WORDS, MOST_CHARS = 4, 40, 240

ANSWER = T.StructType([T.StructField("id", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("advice", T.StringType())])


def requests(items: DataFrame, policy: dict, keys: list[str]) -> DataFrame:
    """Items with ``key`` and ``prompt``. The key is all an answer depends on: the policy of the item's own kind and its
    content; equal contents share a key, whatever their place."""
    kinds = F.create_map(*[x for k, v in VERDICTS.items() for x in (F.lit(k), F.lit(", ".join(v)))])
    asked = items.withColumn("verdicts", kinds[F.col("item")]).where("verdicts is not null and content is not null")
    asked = asked.withColumn("key", M.request_key(policy, ["item", "verdicts", "content"]))
    body = F.concat(F.lit("item "), "key", F.lit(" ("), "item", F.lit("): one of "), "verdicts", F.lit("\n\n"), "content")
    return asked.select(*keys, "item", "line", "name", "key", M.prompt_text("Judge this item of a code base.", ANSWER, body).alias("prompt"))


def _valid(answer: Column) -> Column:
    """Its own id, a verdict of the item's kind and, for a finding, an advice within the limits."""
    kinds = F.create_map(*[x for k, v in VERDICTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    allowed = kinds[F.get_json_object("id", "$.item")]
    advice = F.trim(F.regexp_replace(answer["advice"], r"\s+", " "))
    fits = F.size(F.split(advice, " ")).between(LEAST_WORDS, MOST_WORDS) & (F.length(advice) <= MOST_CHARS)
    ok = F.array_contains(allowed, answer["verdict"]) & ((answer["verdict"] == F.element_at(allowed, 1)) | fits)
    return (answer["id"] == F.get_json_object("id", "$.key")) & F.coalesce(ok, F.lit(False))


def votes(asked: DataFrame, provider: M.Responder, vote: int, done: DataFrame | None = None, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """``(key, item, vote, verdict, advice)`` of every key that got a valid answer; what is not valid is asked again."""
    one = asked.groupBy("key", "item").agg(F.first("prompt").alias("prompt")).select(F.to_json(F.struct("key", "item")).alias("id"), "prompt")
    got, _ = M.run_tasks(one, "id", "prompt", provider, ANSWER, _valid, done, progress=progress)
    part = lambda n: F.get_json_object("id", f"$.{n}").alias(n)
    return got.select(part("key"), part("item"), F.lit(vote).alias("vote"), F.col("answer.verdict").alias("verdict"), F.col("answer.advice").alias("advice"))


def judged(items: DataFrame, provider: M.Responder, policy: dict, keys: list[str], progress: Callable[[int, int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings (keys..., line, kind, message), votes). Every item is asked once; only what the first vote finds is asked a
    second time, and stands if that says the same."""
    scratch = Scratch(items.sparkSession, "review")
    asked = scratch.cut(requests(items, policy, keys), "requests")
    first = scratch.cut(votes(asked, provider, 1, progress=progress), "first")
    doubtful = first.where(F.col("verdict").isin(*KINDS)).select("key")
    second = scratch.cut(votes(asked.join(doubtful, "key", "left_semi"), provider, 2, progress=progress), "second")
    every = first.unionByName(second)
    accepting = F.lit(None).cast("string")  # which of them is the accepting verdict no longer matters
    stands = R.agree(every, "key", "verdict", "vote", accepting, F.col("v1").isin(*KINDS)).where("verdict is not null")
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    advice = first.select("key", F.trim(F.regexp_replace("advice", r"\s+", " ")).alias("message"))
    found = asked.join(stands, "key").withColumn("kind", kinds[F.col("verdict")]).where("kind is not null").join(advice, "key")
    return found.select(*keys, "line", "kind", "message"), every


def candidates_and_findings(found: DataFrame, candidates: tuple[str, ...] = ("split_helper_candidate", "dropped_error_candidate"), both: str = "repeated_test_fixture") -> tuple[DataFrame, DataFrame]:
    """(findings, candidates for a review): candidates are no findings, but one kind is both."""
    return found.where(~F.col("kind").isin(*candidates)), found.where(F.col("kind").isin(*candidates, both))


def with_declarations(candidates: DataFrame, declarations: DataFrame, file: str, line: str, start: str, end: str) -> DataFrame:
    """Candidates with the declaration of their file that holds them, the innermost; one without any is an error, as its
    review would be lost."""
    c = candidates.withColumn("_id", F.monotonically_increasing_id())
    c = Scratch(candidates.sparkSession, "candidates").cut(c, "candidates")
    d = declarations.select(F.col(file).alias("_f"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.struct(*declarations.columns).alias("declaration"))
    met = c.join(d, (F.col(file) == F.col("_f")) & (F.col(line) >= F.col("_s")) & (F.col(line) <= F.col("_e")))
    best = met.groupBy("_id").agg(F.min_by("declaration", F.struct(F.col("_e") - F.col("_s"), "_s")).alias("declaration"))
    out = c.join(best, "_id", "left")
    checked = F.when(F.col("declaration").isNull(), F.raise_error(F.concat(F.lit("no declaration holds "), F.col(file), F.lit(":"), F.col(line).cast("string")))).otherwise(F.col("declaration"))
    return out.withColumn("declaration", checked).drop("_id")
