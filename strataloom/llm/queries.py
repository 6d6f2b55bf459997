"""Queries of the operators for training data, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.paths import canonical_identity
from strataloom.llm.chunking import split_oversized
from strataloom.llm.components import group_identities
from strataloom.llm.language import Fit, fit_model, label_language, tag_documents, tag_words
from strataloom.llm.leximin import leximin_order, leximin_top, leximin_vectors
from strataloom.llm.mixing import mix_sources
from strataloom.llm.neardup import all_pairs, near_duplicates, trie_pairs
from strataloom.llm.packing import pack_documents
from strataloom.llm.vectors import recall, similar_pairs
from strataloom.operators.ordering import keep_best
from strataloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

# Problem 1: the matches of a review queue.

#: 1: higher is stronger; -1: lower is stronger.
SIGNALS = {"embedding_score": 1, "description_score": 1, "structural_score": 1, "locality_tier": -1}


def _match_vectors(spark: SparkSession, d: str) -> DataFrame:
    columns = ["queue_id", *SIGNALS]
    once = keep_best(table(spark, d, "matches").where("match_id is not null"), ["match_id"], [F.col("loaded_at"), F.xxhash64(*columns)], columns)
    scored = once.withColumn("description_score", F.when(F.col("description_score") != 0, F.col("description_score")))
    return leximin_vectors(scored, "match_id", "queue_id", SIGNALS)


def _queues(spark: SparkSession, d: str) -> DataFrame:
    return keep_best(table(spark, d, "review_queues").where("queue_id is not null"), ["queue_id"], [F.col("top_k")], ["top_k"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return leximin_top(_match_vectors(spark, d), "match_id", "queue_id", _queues(spark, d), "top_k").select("queue_id", "match_id")


def p1_order(spark: SparkSession, d: str) -> DataFrame:
    """Every match of a queue with its place in the queue's one order."""
    return leximin_order(_match_vectors(spark, d), "match_id", "queue_id")


# Problem 3: blocks that differ by small edits.


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, d, "blocks"), "block_id", "content", "loaded_at")


def p3_method(spark: SparkSession, d: str) -> DataFrame:
    """What the tries give before the exact check: pairs of classes within the error budget, with their differing bits."""
    return trie_pairs(table(spark, d, "blocks"), "block_id", "content", "loaded_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as TESTDATA.md fixes them; groups of equal contents are spelled out here only."""
    return all_pairs(*_near(spark, d), "block_id", "block_a", "block_b")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a block with content: its class of equal contents and the number of other classes it is linked to."""
    members, links = _near(spark, d)
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select("block_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


# Problem 4: pieces of oversized blocks.


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "blocks"), "block_id", "content", "loaded_at", limit=2000, window=512, overlap=256)


def p4_match_pieces(spark: SparkSession, d: str) -> DataFrame:
    """For each side of each match: does the piece it names still exist in its block?"""
    pieces = p4_found(spark, d).groupBy("block_id").agg(F.count("*").alias("pieces"))
    blocks = keep_best(table(spark, d, "blocks").where("block_id is not null"), ["block_id"], [F.col("loaded_at")], ["identity"])
    sizes = blocks.join(pieces, "block_id", "left").groupBy(canonical_identity(F.col("identity")).alias("identity")).agg(
        F.max(F.coalesce("pieces", F.lit(1))).alias("pieces")
    )
    m = keep_best(table(spark, d, "matches").where("match_id is not null"), ["match_id"], [F.col("loaded_at")], ["left_identity", "right_identity", "left_chunk", "right_chunk"])
    side = F.explode(
        F.array(*[F.struct(F.lit(s).alias("side"), canonical_identity(F.col(f"{s}_identity")).alias("identity"), F.col(f"{s}_chunk").alias("chunk_ix")) for s in ("left", "right")])
    )
    named = m.select("match_id", side.alias("x")).select("match_id", "x.*").where("identity is not null and chunk_ix is not null")
    state = F.when(F.col("pieces").isNull(), "no block").when(F.col("chunk_ix") < F.col("pieces"), "piece").otherwise("out of date")
    return named.join(sizes, "identity", "left").select("match_id", "side", "chunk_ix", state.alias("state"))


# Problem 5: nearest vectors.


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(table(spark, d, "vectors"), "vec_id", "channel", "vec", k=5, floor=0.85, dims=64).select("vec_a", "vec_b")


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of p5_found against brute force, over the vectors whose id is divisible by 20."""
    v = table(spark, d, "vectors")
    return recall(v, p5_found(spark, d), "vec_id", "channel", "vec")


# Problem 6: chains of matches.


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of every match; where one is null, both ends of the row of pairs with its pair_id."""
    m = table(spark, d, "matches").select("pair_id", "left_identity", "right_identity")
    whole = F.col("left_identity").isNotNull() & F.col("right_identity").isNotNull()
    p = table(spark, d, "pairs").where("pair_id is not null and left_identity is not null and right_identity is not null").select("pair_id", "left_identity", "right_identity").distinct()
    mended = m.where(~whole).select("pair_id").distinct().join(p, "pair_id")
    ends = m.where(whole).select("left_identity", "right_identity").unionByName(mended.select("left_identity", "right_identity"))
    return ends.select(canonical_identity(F.col("left_identity")).alias("l"), canonical_identity(F.col("right_identity")).alias("r"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return group_identities(_links(spark, d), "l", "r")


# Problems 7 and 8: documents by tokens.


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be cut: the packing has more than one piece of them."""
    return p7_method(spark, d).where("piece_ix = 1").select("doc_id")


def p7_method(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document in its container."""
    return pack_documents(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "container_specs"), "capacity_tokens")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "source_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].where("short").select("source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_method(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return _mix(spark, d)[0]


# Problem 9: languages of documents and of their parts.


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = fit_model(documents, "doc_id", "text", "lang")
    labelled = documents.select("doc_id", "text", label_language(F.col("lang")).alias("label"))
    return tag_documents(labelled, "doc_id", "text", model, ["label"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    lines = _tagged(spark, d).select("doc_id", "label", F.explode("lines").alias("l"))
    return lines.where("label is null or l.lang <> label").select("doc_id", F.col("l.line_no"), F.col("l.lang"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("doc_id", "label", "lang", "confidence")


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.*")


def p9_words(spark: SparkSession, d: str) -> DataFrame:
    """The runs of words in one language, also within a line."""
    documents = table(spark, d, "documents")
    return tag_words(documents, "doc_id", "text", fit_model(documents, "doc_id", "text", "lang", Fit(spliced=8)))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_order": p1_order,
    "p3_method": p3_method,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_match_pieces": p4_match_pieces,
    "p5_found": p5_found,
    "p5_recall": p5_recall,
    "p6_found": p6_found,
    "p7_method": p7_method,
    "p7_found": p7_found,
    "p8_method": p8_method,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_documents": p9_documents,
    "p9_segments": p9_segments,
    "p9_words": p9_words,
}
