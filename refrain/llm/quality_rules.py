"""Quality rules: repetition by suffix array, beside plain counts.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return, case and all.
The words of a document get a suffix array by prefix doubling (many documents in one run of array operations; suffixes of
different documents never compare equal). The longest-common-prefix values of neighbours in it delimit the LCP
intervals, each of which is a repeated substring that can't be extended to the right; the longest one that starts at
a position is the larger of the values on its two sides. The union of these spans is what repeats cover. Suffix array and
common prefixes take memory in proportion to the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from refrain.llm.common import fresh, quoted, read, with_computed

#: Words whose suffixes are sorted in one go, at least.
BLOCK_WORDS = 150_000
SPACE = b" \t\n\x0b\x0c\r"
NOT_IN_WORDS = SPACE + bytes(range(0x80, 0xC0))  # white space, and the second to last bytes of a character
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


@dataclass(frozen=True)
class Limits:
    """min_words: of a document. max_repeat_percent: words in 3-word windows found again. The others are for repeated
    substrings of at least min_repeat words: max_covered_percent of the words that they may cover, and the words of the
    longest one: max_longest, or max_longest_percent of the document where that is more, but most_longest in any document."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_repeat: int = 8
    max_covered_percent: int = 40
    max_longest: int = 60
    max_longest_percent: int = 10
    most_longest: int = 200

    def longest(self, n_words: int) -> int:
        """The words that the longest repeat of a document may have."""
        return min(max(self.max_longest, self.max_longest_percent * n_words // 100), self.most_longest)


def longest_repeats(words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each position, the most words from there on that are found from another position of the same document too.

    words: numbers from 0 on; docs: the document of each position, ascending. Memory is linear in the words.
    """
    n_docs = int(docs[-1]) + 1
    ends = np.searchsorted(docs, np.arange(1, n_docs + 1)) + np.arange(n_docs)  # where the end mark of each document goes
    total = len(words) + n_docs
    inner = np.ones(total, bool)
    inner[ends] = False
    key = np.empty(total, np.int64)
    width = int(words.max()) + 2
    key[inner] = docs.astype(np.int64) * width + words + 1
    key[ends] = np.arange(n_docs, dtype=np.int64) * width
    suffixes = _suffixes(key)
    before = np.empty(total, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    before[suffixes[0]] = total  # nothing: no key equals the mark that stands there
    common = _common(np.append(key, -1), before)
    most = common.copy()
    np.maximum.at(most, suffixes[:-1], common[suffixes[1:]])
    return most[inner]


def _suffixes(key: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence whose last key is its own, by prefix doubling."""
    order = np.argsort(key, kind="stable")
    rank = np.zeros(len(key), np.int64)
    active = _rank(key[order], order, rank, None)
    reach = 1
    while active.size:
        pair = rank[active] * len(key) + rank[active + reach]
        by = np.argsort(pair, kind="stable")
        active, pair = active[by], pair[by]
        active = _rank(pair, active, rank, rank[active])
        reach *= 2
    found = np.empty(len(key), np.int64)
    found[rank] = np.arange(len(key))
    return found


def _rank(keys: np.ndarray, places: np.ndarray, rank: np.ndarray, groups: np.ndarray | None) -> np.ndarray:
    """Ranks places, whose keys are ascending, anew, and returns those that still share theirs. groups: their ranks so far, ascending."""
    at = np.arange(len(keys))
    first = np.empty(len(keys), bool)
    first[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    start = np.maximum.accumulate(np.where(first, at, 0))
    if groups is not None:
        new = np.empty(len(keys), bool)
        new[:1] = True
        np.not_equal(groups[1:], groups[:-1], out=new[1:])
        start += groups - np.maximum.accumulate(np.where(new, at, 0))
    rank[places] = start
    alone = first.copy()
    alone[:-1] &= first[1:]
    return places[~alone]


def _common(key: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each position, how many keys it has in common with the suffix before it in order.

    Where the keys to the left of both are equal, that is one less than to the left (Karkkainen, Manzini and Puglisi); so only the
    others are compared, and what they find sums to at most n log n.
    """
    n = len(before)
    at = np.arange(n)
    told = np.zeros(n, bool)  # by the position to the left
    told[1:] = (before[1:] > 0) & (before[1:] < n)
    told[1:] &= key[at[1:] - 1] == key[before[1:] - 1]
    known = np.zeros(n, np.int64)
    left = np.flatnonzero(~told & (before < n))
    length = 0
    while left.size > 64 or (left.size and length < 16):
        left = left[key[left + length] == key[before[left] + length]]
        length += 1
        known[left] = length
    for i in left.tolist():  # few, by longer and longer steps
        j, same, step = int(before[i]), length, 64
        while True:
            own, other = key[i + same : i + same + step], key[j + same : j + same + step]
            size = min(len(own), len(other))  # not 0: where a document ends, its mark differs
            differ = own[:size] != other[:size]
            if differ.any():
                known[i] = same + int(differ.argmax())
                break
            same, step = same + step, 2 * step
    return np.maximum.accumulate(np.where(told, 0, known + at)) - at


def _covered(starts: np.ndarray, lengths: np.ndarray, total: int) -> np.ndarray:
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + lengths, 1)
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: list[np.ndarray], min_repeat: int) -> list[tuple[int, int, int]]:
    """For each document: words in 3-word windows found again, words covered by repeats of min_repeat words, the longest repeat."""
    sizes = np.array([len(d) for d in docs])
    if not sizes.sum():
        return [(0, 0, 0)] * len(docs)
    of = np.repeat(np.arange(len(docs)), sizes)
    used, of = np.unique(of, return_inverse=True)
    most = longest_repeats(np.concatenate(docs), of)
    three, long = np.flatnonzero(most >= 3), np.flatnonzero(most >= min_repeat)
    windows = _covered(three, np.full(len(three), 3), len(most))
    spans = _covered(long, most[long], len(most))
    begin = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
    out = np.zeros((len(docs), 3), np.int64)
    out[used, 0] = np.add.reduceat(windows.astype(np.int64), begin)
    out[used, 1] = np.add.reduceat(spans.astype(np.int64), begin)
    out[used, 2] = np.maximum.reduceat(most, begin)
    return [tuple(row) for row in out.tolist()]


def counts(text: bytes) -> tuple[int, int, int]:
    """Code points in words, symbols, and lines with a word that equal an earlier one."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(text.translate(None, NOT_IN_WORDS)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines))


def measure(texts: Iterator[bytes], min_repeat: int) -> Iterator[tuple[int, ...]]:
    """COUNTS of each text, in order."""
    known: dict[bytes, int] = {}
    rows, held, words = [], [], 0

    def done():
        for (n, row), found in zip(rows, repeats(held, min_repeat), strict=True):
            yield n, *row, *found

    for text in texts:
        split = text.split()
        held.append(np.array([known.setdefault(w, len(known)) for w in split], np.int64))
        rows.append((len(split), counts(text)))
        words += len(split)
        if words >= BLOCK_WORDS or len(rows) >= 5000:
            yield from done()
            rows, held, words, known = [], [], 0, {}
    if rows:
        yield from done()


def with_counts(docs: DataFrame, text: str = "text", limits: Limits = Limits(), name: str = "quality") -> DataFrame:
    """docs, with COUNTS, base_failed and kept of the text column as structure `quality` (or another name).

    Null and empty texts have no words and fail. Repeated rows and ids are judged row by row; other columns stay as
    they are, whatever their names (a column of the structure's name is replaced). A table without rows gives none.
    A text is judged whole, in one task and some 150 bytes of memory a word; equal lines and words are ties of no order.
    """
    fields = [*((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    lim = limits

    def judged() -> Callable[[pa.Array], pa.Array]:
        def compute(texts: pa.Array) -> pa.Array:
            columns: list[list] = [[] for _ in fields]
            for row in measure((t.as_py() for t in texts), lim.min_repeat):
                n, repeat, covered, longest = row[0], row[4], row[5], row[6]
                failed = n < lim.min_words or 100 * repeat > lim.max_repeat_percent * n
                long = longest > lim.longest(n)
                for column, value in zip(columns, (*row, failed, not (failed or long or 100 * covered > lim.max_covered_percent * n)), strict=True):
                    column.append(value)
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
            return pa.StructArray.from_arrays(arrays, fields=[pa.field(n, t) for n, t in fields])

        return compute

    kinds = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType()}
    return with_computed(docs, text, name, T.StructType([T.StructField(n, kinds[t]) for n, t in fields]), judged)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept of every document, a row each, as with_counts judges them.

    Null and empty texts have no words and fail; repeated rows are judged each; other columns are not looked at; a table
    without rows gives none.
    """
    return with_counts(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; the others go."""
    name = fresh(docs, "quality")
    return with_counts(docs, name=name).where(f"{name}.kept").select(*quoted(docs.columns))
