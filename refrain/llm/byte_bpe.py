"""Byte-level BPE encoding and decoding with a global table of distinct words.

1. Documents are dealt into blocks of some 16 MB of text, each text compressed on its own; this is the only shuffle of texts.
2. A block's pre-tokens are taken in order of position. Each distinct one goes, once per block, into the global shuffle by word: the hash
   of a word says its part, and a block sends each part one pack of the part's words, in the order of their first positions.
3. A part encodes each distinct word once and answers each pack with the ids, in the same order.
4. A block goes through its positions again: a word that is new there takes the next ids of its part's answer, and a known one
   its own, so that ids and positions are joined without a row for either.

So a word that is in every document is a few bytes per block, not a row per position. Packs are never more than the distinct words of
the blocks. Rows are dealt to blocks one by one, so that equal rows spread, and blocks are named so that Spark's hash partitioning gives
each a partition of its own. Decoding joins the ids with the table of the vocabulary's bytes, which has as many rows as the vocabulary.
"""

from __future__ import annotations

import base64
import collections
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrain.llm.common import as_bytes, batches, read, small_batches, with_computed
from refrain.llm.shingles import mix64

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text in a block, on average.
BLOCK = 16_000_000
#: Different rows of a task whose repetitions are counted at once; some 100 bytes each.
COUNTED = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}


class Splitter:
    """Splits texts as a pattern of tiktoken's syntax does there.

    newer: ranges of code points that this machine's `regex` takes for letters or numbers, but tiktoken, whose Unicode is
    older, does not. ASCII texts are split by `re`, for which the classes are spelled out.
    """

    def __init__(self, pattern: str, newer: str):
        import regex

        less = f"--[{newer}]" if newer else ""
        self.any = regex.compile(re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]", "(?!#)", pattern).replace(r"\p{L}", rf"[\p{{L}}{less}]").replace(r"\p{N}", rf"[\p{{N}}{less}]").replace("(?!#)", rf"[^\s[\p{{L}}{less}][\p{{N}}{less}]]"), regex.V1)
        self.ascii = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII)

    def split(self, text: bytes) -> list[str]:
        found = text.decode("utf-8", "replace")
        return (self.ascii if found.isascii() else self.any).findall(found)


def newer_letters(ranks: dict[bytes, int], pattern: str) -> str:
    """The ranges for Splitter: code points unassigned in Python's own Unicode tables that `regex` calls letters or numbers and tiktoken does not."""
    import regex
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    letters = regex.compile(r"[\p{L}\p{N}]")
    last = ranks[b"'s"]  # after a letter or number, and only there, the two characters are a match of their own
    found = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and letters.match(chr(c)) and probe.encode_ordinary(chr(c) + "'s")[-1] != last]
    spans: list[list[int]] = []
    for c in found:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans)


def spread(places: np.ndarray) -> np.ndarray:
    """Integers whose Murmur3 hashes, as Spark deals rows by, are these places: the hash of one integer, undone step by step."""
    h = places.astype(np.uint32)
    times = lambda x, c: x * np.uint32(pow(c, -1, 1 << 32))
    turned = lambda x, n: x >> np.uint32(n) | x << np.uint32(32 - n)
    h ^= h >> np.uint32(16)
    h = times(h, 0xC2B2AE35)
    h ^= (h >> np.uint32(13)) ^ (h >> np.uint32(26))
    h = times(h, 0x85EBCA6B)
    h ^= h >> np.uint32(16)
    h ^= np.uint32(4)  # bytes of an integer
    h = turned(times(h - np.uint32(0xE6546B64), 5), 13) ^ np.uint32(42)  # Spark's seed
    return times(turned(times(h, 0x1B873593), 15), 0xCC9E2D51).view(np.int32)


def blocks(docs: DataFrame, size: int = BLOCK) -> tuple[DataFrame, int]:
    """block, doc_id and text (compressed) of documents, dealt by block, and to how many partitions.

    A row's block is a hash of the row, of its task and of how many equal rows the task has met: the same whenever the task runs again.
    """
    import zstandard

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // size))
    schema = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("text", pa.binary())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, task = zstandard.ZstdCompressor(level=1).compress, np.uint64(TaskContext.get().partitionId())
        names, met = spread(np.arange(n)), collections.Counter()
        for batch in stream:
            if len(met) > COUNTED:
                met.clear()
            own = batch.column(0).to_numpy()
            again = np.empty(len(own), np.uint64)
            for i, x in enumerate(own.tolist()):
                again[i] = met[x]
                met[x] += 1
            block = names[(mix64(own.view(np.uint64) + mix64(task << np.uint64(40) | again)) % np.uint64(n)).astype(np.int64)]
            texts = pa.array((pack(t.as_py()) for t in batch.column(2)), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column(1), texts], schema=schema)

    own = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("bigint"), as_bytes("text"))
    to = max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return small_batches(own).mapInArrow(run, "block int, doc_id bigint, text binary").repartition(to, "block"), to


def _texts(rows: Iterable[tuple[int | None, bytes]]) -> list[tuple[int | None, bytes]]:
    """The ids and texts of a block, in the order in which its words are numbered."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    texts = [(i, unpack(text)) for i, text in rows]
    return sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def part_of(word: bytes, parts: int) -> int:
    return zlib.crc32(word) % parts


def distinct_words(dealt: DataFrame, parts: int, pattern: str, newer: str) -> DataFrame:
    """block, part and pack: the distinct pre-tokens of each block that belong to a part, by first position."""
    schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("pack", pa.binary())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        splitter, pack = Splitter(pattern, newer), zstandard.ZstdCompressor(level=3).compress

        def packs(block: int, rows: list) -> Iterator[tuple[int, int, bytes]]:
            words: dict[str, None] = {}
            for _, text in _texts(rows):
                words.update(dict.fromkeys(splitter.split(text)))
            lists: dict[int, list[bytes]] = {}
            for word in map(str.encode, words):
                lists.setdefault(part_of(word, parts), []).append(word)
            for part, found in lists.items():
                yield block, part, pack(b"\xff".join(found))  # no UTF-8 holds this byte

        def rows():
            now, held = None, []
            for batch in stream:
                for block, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if block != now:
                        yield from packs(now, held)
                        now, held = block, []
                    held.append((i, text))
            yield from packs(now, held)

        yield from batches(rows(), schema, 256)

    return dealt.sortWithinPartitions("block").mapInArrow(run, "block int, part int, pack binary")


def encoded_words(words: DataFrame, parts: int, ranks: dict[bytes, int]) -> DataFrame:
    """block, part and answer: the number of ids of each word of a pack, then the ids. A part, all in one task, encodes a word once."""
    schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("answer", pa.binary())])
    table = words.sparkSession.sparkContext.broadcast(ranks)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        import zstandard

        whole = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=table.value, special_tokens={})  # a word is one piece
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress

        class Known(dict):
            def __missing__(self, word: bytes) -> bytes:
                self[word] = found = whole.encode_to_numpy(word.decode(), disallowed_special=()).astype("<u4").tobytes()
                return found

        known = Known()

        def rows():
            for batch in stream:
                for block, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids = list(map(known.__getitem__, unpack(data).split(b"\xff")))
                    sizes = np.fromiter(map(len, ids), "<u4", len(ids))
                    yield block, part, pack(np.uint32(len(ids)).astype("<u4").tobytes() + sizes.tobytes() + b"".join(ids))

        yield from batches(rows(), schema, 256)

    return words.repartitionById(parts, F.col("part")).mapInArrow(run, "block int, part int, answer binary")


def encode(docs: DataFrame, path: str, pattern: str, size: int = BLOCK) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of documents (doc_id, text).

    The ids are those that tiktoken's encode_ordinary finds with the same ranks and pattern. Null and empty texts have none. Every row
    has a row, also those with a null doc_id, or one that others have too. Other columns are not looked at. A text is encoded whole,
    within one block, however long; a table without rows gives none.
    """
    ranks = load_ranks(path)
    newer = newer_letters(ranks, pattern)
    dealt, parts = blocks(docs.select("doc_id", "text"), size)
    answers = encoded_words(distinct_words(dealt, parts, pattern, newer), parts, ranks)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def assemble(texts: pa.Table, table: pa.Table) -> pa.Table:
        import zstandard

        splitter, unpack = Splitter(pattern, newer), zstandard.ZstdDecompressor().decompress

        def each(answer: bytes) -> Iterator[bytes]:
            data = unpack(answer)
            n = int(np.frombuffer(data, "<u4", 1)[0])
            at = 4 + 4 * n
            for length in np.frombuffer(data, "<u4", n, 4).tolist():
                yield data[at : at + length]
                at += length

        next_of = {part: each(answer) for part, answer in zip(table.column("part").to_pylist(), table.column("answer").to_pylist(), strict=True)}

        class Known(dict):
            def __missing__(self, word: str) -> bytes:
                self[word] = found = next(next_of[part_of(word.encode(), parts)])
                return found

        known = Known()
        rows = [(i, b"".join(map(known.__getitem__, splitter.split(text)))) for i, text in _texts(zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), strict=True))]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (ids, ...), with `decoded`, the bytes that the ids stand for. The table of the vocabulary is broadcast."""
    ranks = load_ranks(path)
    table: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        table[rank] = word
    words = encoded.sparkSession.sparkContext.broadcast(table)

    def decoder() -> Callable[[pa.Array], pa.Array]:

        word_of = words.value.__getitem__
        return lambda ids: pa.array((b"".join(map(word_of, np.frombuffer(x.as_py(), "<u4").tolist())) for x in ids), pa.binary())

    return with_computed(encoded, "ids", "decoded", T.BinaryType(), decoder)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, a row each, as encode and decode make them.

    Null and empty texts have no ids; repeated rows and null ids are rows of their own; other columns are not looked at;
    a table without rows gives none.
    """
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    found = decode(encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return found.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
