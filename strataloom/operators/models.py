"""Model calls as operators: injected providers, content-addressed inputs, bounded batches, validated answers, retries."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.text import description_fits, squeeze
from strataloom.runtime import Scratch

#: Most items and bytes of an embedding call, and most records, bytes and padding a record of a prompt (fixed values).
EMBED_ITEMS, EMBED_BYTES = 128, 64_000
PROMPT_RECORDS, PROMPT_BYTES, PADDING, ATTEMPTS = 16, 64_000, 32, 2
#: Requests that one task packs into prompts.
LANE = 20_000


class Embedder(Protocol):
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Responder(Protocol):
    def ask(self, prompt: str) -> str: ...


class HashEmbedder:
    """Offline stand-in: counts of hashed words, scaled to length 1. Deterministic; equal texts have equal vectors."""

    name = "hash-words"

    def __init__(self, dims: int = 32):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in t.split():
                h = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "little") % self.dims] += 1 if h[4] & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        out[:, 0] += n[:, 0] == 0
        return (out / np.where(n == 0, 1, n)).tolist()


class HttpEmbedder:
    """POST of a batch of texts to a server that answers {"model", "data": [{"index", "embedding"}]}."""

    def __init__(self, url: str, name: str, timeout: float = 180.0, most: int = 16 << 20):
        self.url, self.name, self.timeout, self.most = url, name, timeout, most

    def embed(self, texts: list[str]) -> list[list[float]]:
        import urllib.request

        body = json.dumps({"model": self.name, "input": texts}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            raw = answer.read(self.most + 1)
        if len(raw) > self.most:
            raise ValueError("the answer is too long")
        got = json.loads(raw)
        if got.get("model") != self.name:
            raise ValueError(f"the server runs {got.get('model')}, not {self.name}")
        by_index = {d["index"]: d["embedding"] for d in got["data"]}
        return [by_index[i] for i in range(len(texts))]


class SubprocessResponder:
    """One process a prompt: prompt to its input, one JSON document from its output.

    ``{schema}`` in the command stands for the JSON schema of the answer.
    """

    def __init__(self, command: list[str], timeout: float = 600.0, schema: T.StructType | None = None):
        self.command, self.timeout = command, timeout
        self.schema = json.dumps(json_schema(schema)) if schema is not None else "{}"

    def ask(self, prompt: str) -> str:
        import subprocess

        command = [self.schema if c == "{schema}" else c for c in self.command]
        return subprocess.run(command, input=prompt, capture_output=True, text=True, timeout=self.timeout, check=True).stdout


def packs(sizes: list[int], most_items: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items within both caps; an item over the byte cap goes alone."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and (i - start == most_items or total + s > most_bytes):
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def balanced(sizes: list[int], most: int = PROMPT_RECORDS, most_bytes: int = PROMPT_BYTES, padding: int = PADDING) -> list[int]:
    """Batch of each item, items given longest first: the least loaded batch with room; a too large item goes alone."""
    n = -(-len(sizes) // most)
    loads, counts = [0] * n, [0] * n
    heap = [(0, b) for b in range(n)]
    out = []
    for s in (x + padding for x in sizes):
        skipped, at = [], None
        while heap:
            load, b = heapq.heappop(heap)
            if counts[b] == 0 or load + s <= most_bytes:
                at = b
                break
            skipped.append((load, b))  # fuller ones follow, so none of them fits either
            break
        if at is None:
            at = len(loads)
            loads.append(0)
            counts.append(0)
        for x in skipped:
            heapq.heappush(heap, x)
        loads[at] += s
        counts[at] += 1
        if counts[at] < most:
            heapq.heappush(heap, (loads[at], at))
        out.append(at)
    return out


def balanced_batches(df: DataFrame, key: str, size: str, per_lane: int = LANE) -> DataFrame:
    """``(lane, batch, key, size)``: prompt batches within the caps. Rows are dealt by hash to as many lanes as their number
    asks for; a lane packs its own rows longest first, so no task sees more than about ``per_lane`` of them."""
    lanes = max(1, -(-df.count() // per_lane))
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int").alias("lane"), key, F.col(size).cast("bigint").alias("size"))
    schema = T.StructType([T.StructField("lane", T.IntegerType()), T.StructField("batch", T.IntegerType()), rows.schema[key], T.StructField("size", T.LongType())])

    def run(pdf):
        pdf = pdf.sort_values(["size", key], ascending=[False, True], kind="stable")
        pdf["batch"] = np.array(balanced(pdf["size"].tolist()), np.int32)
        return pdf[["lane", "batch", key, "size"]]

    return rows.groupBy("lane").applyInPandas(run, schema)


def once_per_content(df: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that ``compute`` makes for each distinct text: (input_key, text) -> (input_key, ...).

    Inputs are addressed by their digest, computed once and joined back to every row; null texts get nulls.
    """
    keyed = df.withColumn("input_key", F.sha2(F.col(text), 256))
    inputs = keyed.where("input_key is not null").groupBy("input_key").agg(F.first(text).alias("text"))
    return keyed.join(compute(inputs), "input_key", "left").drop("input_key")


def embed(inputs: DataFrame, provider: Embedder) -> DataFrame:
    """(input_key, text) -> (input_key, vec). Inputs of like length meet in a call, within the item and byte caps."""
    ranged = inputs.withColumn("bytes", F.octet_length("text")).repartitionByRange("bytes").sortWithinPartitions("bytes", "input_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            for i, j in packs(b.column("bytes").to_pylist(), EMBED_ITEMS, EMBED_BYTES):
                got = provider.embed(texts[i:j])
                if len(got) != j - i or any(not np.isfinite(v).all() for v in got):
                    raise ValueError(f"{provider.name} gave no usable vectors")
                out += got
            yield pa.RecordBatch.from_arrays([b.column("input_key"), pa.array(out, pa.list_(pa.float64()))], names=["input_key", "vec"])

    return ranged.mapInArrow(run, "input_key string, vec array<double>")


def request_key(policy: dict, columns: list[str]) -> Column:
    """Everything an answer depends on: the policy and the request's own columns, as one digest."""
    return F.sha2(F.concat(F.lit(json.dumps(policy, sort_keys=True)), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), 256)


def decode_strict(text: Column, schema: T.StructType) -> Column:
    """The record, or null unless the text is one JSON object with exactly the schema's fields, all of the right type."""
    keys = F.json_object_keys(text)
    exact = (F.size(keys) == len(schema)) & (F.size(F.array_except(keys, F.array(*[F.lit(f.name) for f in schema]))) == 0)
    record = F.from_json(text, schema)
    typed = F.lit(True)
    for f in schema:
        typed = typed & record[f.name].isNotNull()
    return F.when(exact & typed, record)


def run_tasks(
    requests: DataFrame, key: str, prompt: str, provider: Responder, schema: T.StructType, valid: Callable[[Column], Column] | None = None,
    done: DataFrame | Callable[[], DataFrame] | None = None, attempts: int = ATTEMPTS, progress: Callable[[int, int], None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(answers (key, answer), unresolved requests). Valid answers are kept, the rest is asked again, up to ``attempts``
    times without progress.

    done: answers of other runs, (key, answer): those requests are not asked; as a function it is looked at before every
    round, so that what another process has answered meanwhile is not asked again. progress(answered, all) is told after
    every round.
    """
    scratch = Scratch(requests.sparkSession, "tasks")
    rest = scratch.cut(requests, "requests")
    every = left = rest.count()
    answers, tries = None, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [provider.ask(p) if p is not None else None for p in b.column(prompt).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.string())], names=[key, "raw"])

    def keep(got: DataFrame) -> tuple[DataFrame, int]:
        nonlocal answers
        got = scratch.cut(got, "answers")  # asked once, whatever is read later
        answers = got if answers is None else answers.unionByName(got)
        new = scratch.cut(rest.join(got.select(key), key, "left_anti"), "rest")
        return new, new.count()

    while left and tries < attempts:
        if done is not None and (callable(done) or answers is None):
            known = done() if callable(done) else done
            rest, left = keep(known.join(rest.select(key), key, "left_semi").select(key, "answer"))
            if not left:
                break
        got = rest.select(key, prompt).mapInArrow(run, T.StructType([rest.schema[key], T.StructField("raw", T.StringType())]))
        got = got.select(key, decode_strict(F.col("raw"), schema).alias("answer")).where("answer is not null")
        if valid is not None:
            got = got.where(valid(F.col("answer")))
        before = left
        rest, left = keep(got)
        tries = 0 if left < before else tries + 1
        if progress:
            progress(every - left, every)
    if answers is None:
        answers = requests.sparkSession.createDataFrame([], T.StructType([requests.schema[key], T.StructField("answer", schema)]))
    return answers, rest


#: The answer of a describer.
DESCRIPTION = T.StructType([T.StructField("description", T.StringType())])


def described(inputs: DataFrame, provider: Responder, policy: dict, done: DataFrame | Callable[[], DataFrame] | None = None, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """(input_key, text) -> (input_key, description): one description a distinct text, within the limits, for
    ``once_per_content``. What is not is asked again; texts that get none have none."""
    asked = inputs.withColumn("key", request_key(policy, ["input_key"])).withColumn("prompt", prompt_text("Describe what this code does.", DESCRIPTION, F.col("text")))
    got, _ = run_tasks(asked.select("input_key", "key", "prompt"), "key", "prompt", provider, DESCRIPTION, lambda a: description_fits(a["description"]), done, progress=progress)
    return asked.select("input_key", "key").join(got, "key").select("input_key", squeeze(F.col("answer.description")).alias("description"))


def prompt_text(instruction: str, schema: T.StructType, body: Column) -> Column:
    """A prompt: what to do, the schema of the answer, the request."""
    return F.concat(F.lit(instruction + "\nAnswer with one JSON object of this schema: " + json.dumps(json_schema(schema)) + "\n\n"), body)


def json_schema(kind: T.DataType) -> dict:
    """The JSON schema of a type: objects with exactly their fields, all required."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind}, "required": kind.names, "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    return {"type": "integer" if isinstance(kind, T.IntegralType) else "number" if isinstance(kind, T.NumericType) else "string"}
