"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

A text up to ``chunk_chars`` long is encoded where it is read. A longer one is cut into overlapping chunks
that are spread over the cluster: each is pre-tokenised on its own, neighbours are stitched at the first
pre-token boundary that both see in their overlap (from such a boundary on, splitting depends on the text
to its right alone), and the pieces between stitches are encoded in parallel. Chunks that never agree, as
inside one run of letters longer than the overlap, stay one piece, so the ids equal those of the whole text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.storage import spread

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the published pattern that splits a text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS, OVERLAP_CHARS = 8192, 512


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    """The encoder of a rank file, loaded once a worker."""
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=_ranks(os.path.join(folder, f"{vocabulary}.tiktoken")), special_tokens={})


def boundaries(text: str) -> list[int]:
    """Start of each pre-token, and the text's length."""
    import regex

    return [m.start() for m in regex.finditer(PATTERN, text)] + [len(text)]


def _encode(text_col: str, out: str, folder: str, vocabulary: str, count_only: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary)
        for f in frames:
            texts = ["" if t is None else t for t in f.pop(text_col)]
            ids = [enc.encode_ordinary(t) for t in texts]
            yield f.assign(**{out: [len(x) for x in ids] if count_only else ids})

    return run


def _split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        # after white space a boundary is of no use: how a run of it splits depends on what follows
        cuts = [[at + b for b in boundaries(t)[:-1] if b and not t[b - 1].isspace()] for at, t in zip(f["at"], f["chunk"], strict=True)]
        yield f.assign(cuts=cuts)


def _long_pieces(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc, hash, copies, piece_no, piece): texts cut at pre-token boundaries, which concatenate to the text.

    A text goes by its id and its SHA-256, so two texts of one id stay apart and exact copies of a row are coded once, ``copies`` times over.
    """
    step = chunk - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - overlap - 1), F.lit(step))
    chunks = long.select("doc", F.sha2("text", 256).alias("hash"), "text", F.posexplode(starts).alias("no", "at"))
    chunks = chunks.select("doc", "hash", "no", "at", F.substring("text", F.col("at") + 1, F.lit(chunk)).alias("chunk"))
    once = chunks.groupBy("doc", "hash", "no", "at", "chunk").agg(F.count("*").alias("copies"))
    cut = once.mapInPandas(_split, "doc bigint, hash string, no int, at int, chunk string, copies bigint, cuts array<bigint>")
    w = Window.partitionBy("doc", "hash").orderBy("no")
    # a boundary both neighbours see; a chunk's own first position is no boundary of the text, its last token may be cut off
    cut = cut.withColumn("next_cuts", F.lead("cuts").over(w)).withColumn("next_at", F.lead("at").over(w))
    seen = F.array_intersect("cuts", F.filter("next_cuts", lambda x: x > F.col("next_at")))
    cut = cut.withColumn("stitch", F.array_min(seen)).drop("next_cuts", "next_at", "cuts")
    begin = F.lag("stitch").over(w)
    cut = cut.withColumn("begin", F.when(F.col("no") == 0, F.lit(0).cast("bigint")).otherwise(begin))
    cut = cut.withColumn("piece_no", F.sum(F.col("begin").isNotNull().cast("int")).over(w))
    # chunks without a stitch between them make one piece: each adds what follows the start of its successor's chunk
    parts = F.array_sort(F.collect_list(F.struct("no", "at", "chunk")))
    piece = cut.groupBy("doc", "hash", "piece_no").agg(parts.alias("parts"), F.min("begin").alias("begin"), F.max("stitch").alias("stitch"), F.max("copies").alias("copies"))
    whole = F.array_join(F.transform("parts", lambda p, i: F.when(i == F.size("parts") - 1, p.chunk).otherwise(F.substring(p.chunk, F.lit(1), F.lit(step)))), "")
    first = F.col("parts")[0]["at"]
    size = F.coalesce(F.col("stitch"), F.lit(2**31 - 1)) - F.col("begin")
    text = F.substring(whole, (F.col("begin") - first + 1).cast("int"), F.least(size, F.lit(2**31 - 1)).cast("int"))
    return piece.select("doc", "hash", "copies", "piece_no", text.alias("text"))


def token_ids(
    docs: DataFrame, doc_id: str, text: str, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, count_only: bool = False
) -> DataFrame:
    """(doc_id, ids array<bigint>), or (doc_id, n_tokens) with ``count_only``, one row for every row of ``docs``.

    A null and an empty text have the empty list. Strings of special tokens are ordinary text. Ids may be null or
    repeated: each row has its own text's ids, whatever its length. Columns other than the two named are ignored, so their names cannot clash.
    """
    rows = spread(docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")), "doc")
    out, kind = ("n_tokens", "bigint") if count_only else ("ids", "array<bigint>")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    short = rows.where(~is_long).mapInPandas(_encode("text", out, folder, vocabulary, count_only), f"doc bigint, {out} {kind}")
    pieces = _long_pieces(rows.where(is_long), chunk_chars, overlap_chars)
    coded = pieces.repartition("doc", "hash", "piece_no").mapInPandas(_encode("text", out, folder, vocabulary, count_only), f"doc bigint, hash string, copies bigint, piece_no bigint, {out} {kind}")
    if count_only:
        joined = coded.groupBy("doc", "hash").agg(F.sum(out).alias(out), F.max("copies").alias("copies"))
    else:
        ordered = F.array_sort(F.collect_list(F.struct("piece_no", out)))
        joined = coded.groupBy("doc", "hash").agg(F.flatten(F.transform(ordered, lambda x: x[out])).alias(out), F.max("copies").alias("copies"))
    joined = joined.select("doc", out, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc", out)
    return short.unionByName(joined).withColumnRenamed("doc", doc_id)


def decode_ids(coded: DataFrame, doc_id: str, ids: str = "ids", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): the tokens' raw bytes concatenated, then read as UTF-8; a null list gives the empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece = {rank: token for token, rank in _ranks(os.path.join(folder, f"{vocabulary}.tiktoken")).items()}
        for f in frames:
            yield pd.DataFrame({"doc": f["doc"], "text": [b"".join(piece[i] for i in (() if x is None else x)).decode("utf-8", "replace") for x in f["ids"]]})

    rows = coded.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(ids).alias("ids"))
    return rows.mapInPandas(run, "doc bigint, text string").withColumnRenamed("doc", doc_id)
