"""Best-fit packing by sums of squares (Csirik, Johnson and others).

Documents become token ids, longer ones than a sequence are cut, and the pieces are dealt by a hash of their place into groups of bounded
size, each packed in a task of its own: longest pieces first, each where the sum of the squared counts of open
sequences per residual gap becomes smallest. A group leaves a few sequences unfilled, whatever the size of the corpus.

Whether a new sequence is one of the choices (`late=False`), or is opened only where no open one has room, is a parameter. The
latter is what the queries use, as it needs fewer sequences: over the pieces of sf0.1 4,539, the least that their ids could fill, against 4,551.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.common import as_bytes, batches, read, small_batches, stored
from refrain.llm.shingles import ODD, mix64

LIMIT = 2048
#: Pieces that are packed together, on average.
GROUP = 40_000
#: What marks the end of a word for tiktoken. No text that it gets holds it.
END = b"\0"
MARK = "\0"
#: Letters that the pattern's classes surely hold, and anything but them, printable ASCII, its white space and common punctuation.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
OTHER = re.compile(f"[^ -~\t\n\x0b\x0c\r{LATIN}\u2013\u2014\u2018-\u201e\u2020-\u2022\u2026\u20ac]")
UNITS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\\sa-z0-9{LATIN}]+")
VOCABULARY = "word_bpe_49k.json"


def merge_table(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """The vocabulary as ranks for tiktoken, with END after what ends a word: None if those merges might differ.

    The tokenizer merges listed pairs, by rank; tiktoken merges neighbours that together are in the vocabulary, by id. If every token is
    itself what its own characters merge to, the two agree on every word: neighbours that make up a token have been merged as
    the token alone would be, and that would go on to merge them.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as lines:
        model = json.load(lines)["model"]
    vocabulary, end = model["vocab"], model["end_of_word_suffix"]
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    rest = [b for b in range(256) if b not in letters]
    byte_of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks: dict[bytes, int] = {}
    bare = Tokenizer.from_file(path).model
    for at, pair in enumerate(model["merges"]):
        first, second = pair if isinstance(pair, list) else pair.split(" ")
        if vocabulary[first + second] != 512 + at:
            return None
    for token, rank in vocabulary.items():
        whole = token.removesuffix(end)
        if rank >= 512 + len(model["merges"]):
            continue  # special tokens
        if not token.endswith(end) or not whole:
            if rank >= 512 and not all(c in byte_of for c in token):
                return None
        raw = bytes(byte_of[c] for c in whole)
        if END in raw:
            continue  # no text holds it
        ranks[raw + END if token.endswith(end) else raw] = rank
        if rank >= 512 and token.endswith(end) and [t.id for t in bare.tokenize(whole)] != [rank]:
            return None
    ranks[END] = 1 << 20
    return ranks


class Ids:
    """Ids, as little-endian bytes, of texts.

    Texts of ASCII, Latin letters and common punctuation are lower-cased and split here by the tokenizer's own pattern, whose classes are then known,
    and merged by tiktoken; composed Latin letters without combining marks are what NFC leaves as it is. The tokenizer
    itself takes all others.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        mark = END.decode()
        self.fast = tiktoken.Encoding("own", pat_str=f"[^{mark}]+{mark}", mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def of(self, text: bytes) -> bytes:
        found = text.decode("utf-8", "replace")
        if self.fast is None or OTHER.search(found):
            return np.array(self.tokenizer.encode(found, add_special_tokens=False).ids, "<u4").tobytes()
        words = UNITS.findall(found.lower())
        return self.fast.encode_to_numpy(MARK.join(words) + MARK, disallowed_special=()).astype("<u4").tobytes() if words else b""


def deal_of(part: int, made: int) -> int:
    """31 bits that deal the pieces of all partitions evenly, also those of equal rows; the same in each run over the same partitions."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([part << 40 | made], np.uint64) * ODD)[0] >> np.uint64(33))


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) and deal (a hash of the piece's place) of documents.

    The ids of a document end with id 0; a null or empty text has that id alone. A document of more than `limit` ids is
    cut into pieces of `limit`, of which the last may be shorter; a text is tokenized whole, whatever its length. Repeated rows, ids and null ids are documents
    of their own. Other columns are not looked at; a table without rows gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(merge_table(path))
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("deal", pa.int32())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = Ids(path, shared.value), TaskContext.get().partitionId()

        def rows():
            made = 0
            for batch in stream:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = known.of(text.as_py()) + b"\0\0\0\0"
                    for k, start in enumerate(range(0, len(ids), 4 * limit)):
                        own = ids[start : start + 4 * limit]
                        made += 1
                        yield i, k, start // 4, len(own) // 4, own, deal_of(part, made)

        yield from batches(rows(), out, 1024)

    return small_batches(docs).select(F.col("doc_id").cast("bigint"), as_bytes("text")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary, deal int")


def sum_of_squares(lengths: np.ndarray, limit: int = LIMIT, late: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and offset of each length (1 to limit), longest first; of equal sums the fullest sequence wins, then an open one.

    late: a new sequence is opened only where no open one has room; else it is one of the choices.
    """
    open_at = np.zeros(limit + 1, np.int64)  # open sequences by gap
    bins: list[list[int]] = [[] for _ in range(limit + 1)]
    place, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = 4 * limit * (len(lengths) + 1)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        here = open_at[n:]
        change = 2 * (open_at[: limit + 1 - n] - here) + 2  # what the sum of squares gains from filling a gap of n, n + 1, ...
        change[0] = 1 - 2 * here[0]
        change = np.where(here > 0, change, never)
        best = int(change.argmin())
        opened = 2 * int(open_at[limit - n]) + 1 if n < limit else 0
        if here[best] and (late or change[best] <= opened):
            gap = n + best
            at = bins[gap].pop()
            open_at[gap] -= 1
        else:
            gap, at = limit, made
            made += 1
        place[i], offset[i] = at, limit - gap
        if gap > n:
            bins[gap - n].append(at)
            open_at[gap - n] += 1
    return place, offset


def pack(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """found (length, deal, ...), a stored table, with sequence_id and offset; deal goes. Equal lengths are packed in the order of their rows; without rows there are none."""
    groups = max(1, -(-found.count() // GROUP))
    keep = found.drop("deal")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows.pop("group").iat[0])
        place, offset = sum_of_squares(rows["length"].to_numpy(), limit)
        return rows.drop(columns="deal").assign(sequence_id=place + group * (1 << 40), offset=offset)

    dealt = found.withColumn("group", F.pmod("deal", F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(run, keep.schema.add("sequence_id", "long").add("offset", "long"))


def packed(docs: DataFrame, path: str) -> DataFrame:
    """The places of all pieces, with the CRC-32 of their ids."""
    found = pieces(docs, path).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "deal")
    return pack(stored(found, "pieces"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the pieces of every document, as pieces and pack make them: null and empty texts are id 0 alone, repeated
    rows are documents of their own, longer documents than a sequence are cut, and a table without rows gives none."""
    return packed(read(spark, sf_dir, "documents"), vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, packed: the rows of op8 over them."""
    return packed(docs, vocabulary())
