"""Benchmark decontamination: BM25 retrieval of test items by every training passage."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SIMILARITY = 0.8
PART = 0.5  # of the shingles of the question, and of the answer, that a leak holds at least
K1, B = 1.2, 0.75
BLOCKS = 32  # of an index's items, whose largest impacts are kept per term
INDEX_ITEMS = 5_000  # items of one index; a larger test set makes several
CHUNK_BYTES = 1 << 20  # of documents that are looked up together

_WORD = re.compile(rb"[0-9a-z_\x80-\xff]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)  # base of the word hash; any odd number has an inverse
_SENTENCE_END = re.compile(r"[?!.]\s+|\n")


def words_of(text: str) -> list[bytes]:
    """Runs of letters, digits, underscores and non-ASCII characters, in lower case."""
    return _WORD.findall(text.lower().encode())


_IN_WORD = np.zeros(256, dtype=np.uint64)
for _byte in range(256):
    if _WORD.fullmatch(bytes([_byte])):
        _IN_WORD[_byte] = _byte


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of lower-case text.

    Bytes are weighted with powers of an odd base by place and summed per word; the inverse
    power of the word's start makes the sum independent of where the word stands.
    """
    value = _IN_WORD[np.frombuffer(blob, dtype=np.uint8)]
    inside = value > 0
    starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    powers = np.full(len(value), _ODD)
    inverse = np.full(len(value), np.uint64(pow(int(_ODD), -1, 1 << 64)))
    powers[0] = inverse[0] = 1
    found = np.add.reduceat(value * np.cumprod(powers), starts) * np.cumprod(inverse)[starts]
    found ^= found >> np.uint64(29)
    return starts, found * _ODD


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words before and after the end of the last sentence but one; one sentence is all question."""
    ends = [m.end() for m in _SENTENCE_END.finditer(text.rstrip())]
    at = ends[-1] if ends else len(text)
    return words_of(text[:at]), words_of(text[at:])


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[k : k + SHINGLE_WORDS]) for k in range(max(1, len(words) - SHINGLE_WORDS + 1))}


class Index:
    """BM25 impacts of test items by term, in blocks of items with the largest impact of each.

    An item stands in the index with the longer of its question and answer, as a leak holds
    both but not always side by side. An impact is divided by the score that this part must
    reach: the score of the whole part less the heaviest terms that may be absent in a leak.
    Words at ``k`` places lie in at least ``k`` shingles, so no more terms can be absent than
    shingles are broken; where an item repeats shingles, each absent term breaks at least the
    one that starts with its first occurrence, if that is not among the last four words. No
    passage that passes the shingle check can therefore score below 1.
    """

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        parts = [(item, *question_and_answer(text or "")) for item, text in items]
        parts = [p for p in parts if p[1] or p[2]]
        self.items = [p[0] for p in parts]
        self.parts = [(shingles(q), shingles(a), shingles(q + a)) for _, q, a in parts]
        self.longer = [int(len(a) > len(q)) for _, q, a in parts]
        self.broken = []  # shingles of the longer part that a leak may lack
        counts = [Counter(p[1 + k]) for p, k in zip(parts, self.longer, strict=True)]
        self.longest = max((len(q) + len(a) for _, q, a in parts), default=0)
        mean = sum(c.total() for c in counts) / max(len(counts), 1)
        held = Counter(w for c in counts for w in c)
        self.terms = {w: k for k, w in enumerate(held)}
        hashes = np.concatenate([word_hashes(w)[1] for w in held] or [np.empty(0, np.uint64)])
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.prefixes = np.zeros(1 << 16, dtype=bool)
        self.prefixes[hashes >> np.uint64(48)] = True
        rarity = {w: math.log1p((len(parts) - n + 0.5) / (n + 0.5)) for w, n in held.items()}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for k, c in enumerate(counts):
            norm = K1 * (1 - B + B * c.total() / mean)
            impact = {w: rarity[w] * n * (K1 + 1) / (n + norm) for w, n in c.items()}
            part = self.parts[k][self.longer[k]]
            broken = math.floor(min((1 - similarity) * len(self.parts[k][2]), (1 - PART) * len(part)) + 1e-9)
            self.broken.append(broken)
            repeats = len(part) < c.total() - SHINGLE_WORDS + 1
            absent = broken + (SHINGLE_WORDS - 1 if broken and repeats else 0)
            heaviest = sorted(impact.values(), reverse=True)
            need = max(sum(heaviest[absent:]), heaviest[-1])
            for w, x in impact.items():
                postings[self.terms[w]].append((k, x / need * (1 + 1e-9)))
        self.of_item = [np.array([k for k, _ in p]) for p in postings]
        self.impact = [np.array([x for _, x in p]) for p in postings]
        self.lists = [(k.tolist(), x.tolist()) for k, x in zip(self.of_item, self.impact, strict=True)]
        self.most = [max(x) for _, x in self.lists]
        self.block_items = max(1, -(-len(parts) // BLOCKS))
        self.block_most = np.zeros((len(postings), BLOCKS), dtype=np.float32)
        for t, (of_item, impact) in enumerate(zip(self.of_item, self.impact, strict=True)):
            np.maximum.at(self.block_most[t], of_item // self.block_items, impact * (1 + 1e-6))

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The term of each word hash, -1 where no item has it."""
        found = np.full(len(hashes), -1)
        at = np.flatnonzero(self.prefixes[hashes >> np.uint64(48)])
        near = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[near] == hashes[at]
        found[at[same]] = self.by_hash[near[same]]
        return found

    def bounds(self, stretch: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Per stretch and block, the sum of the block's largest impacts of the stretch's distinct terms."""
        found = np.zeros((n, BLOCKS), dtype=np.float32)
        pairs = np.unique(stretch * len(self.terms) + term)
        if len(pairs):
            stretch, term = np.divmod(pairs, len(self.terms))
            rows, starts = np.unique(stretch, return_index=True)
            found[rows] = np.add.reduceat(self.block_most[term], starts, axis=0)
        return found

    def retrieve(self, terms: np.ndarray, by_block: np.ndarray) -> list[tuple[int, float]]:
        """Items that score 1 or more for a passage of ``terms``, in order, by block-max WAND.

        Cursors stand on each term's postings. The pivot is the first item that the sum of the
        largest impacts of the cursors up to it can lift to 1; a pivot in a block whose bound
        stays below 1 moves them to the next block whose bound does not.
        """
        found, lists, most = [], self.lists, self.most
        open_ = np.append(np.flatnonzero(by_block >= 1), len(by_block))
        at = dict.fromkeys(terms.tolist(), 0)
        ahead = [(lists[t][0][0], t) for t in at]
        while True:
            ahead.sort()
            total, pivot = 0.0, None
            for item, t in ahead:
                total += most[t]
                if total >= 1:
                    pivot = item
                    break
            if pivot is None:
                return found
            block = pivot // self.block_items
            if by_block[block] < 1:
                target = int(open_[np.searchsorted(open_, block)]) * self.block_items
            elif ahead[0][0] < pivot:
                target = pivot
            else:
                here = [t for item, t in ahead if item == pivot]
                score = sum(lists[t][1][at[t]] for t in here)
                if score >= 1:
                    found.append((pivot, float(score)))
                target = pivot + 1
            moved = bisect_left(ahead, (target,))
            for k, (_, t) in enumerate(ahead[:moved]):
                own = lists[t][0]
                at[t] = place = bisect_left(own, target, at[t])
                ahead[k] = (own[place] if place < len(own) else len(self.items), t)
            ahead = [x for x in ahead if x[0] < len(self.items)]

    def overlaps(self, item: int, have: dict[int, set[tuple[bytes, ...]]]) -> tuple[float, float, float]:
        """Shares of an item's shingles that are held: all, of the question, of the answer."""

        def share(part: set[tuple[bytes, ...]]) -> float:
            return sum(x in have[len(x)] for x in part) / len(part) if part else 1.0

        question, answer, whole = self.parts[item]
        return share(whole), share(question), share(answer)


def word_runs(words: list[bytes]) -> dict[int, set[tuple[bytes, ...]]]:
    """All runs of 1 to ``SHINGLE_WORDS`` words, by their number of words."""
    return {n: {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} for n in range(1, SHINGLE_WORDS + 1)}


def is_leak(shares: tuple[float, float, float], similarity: float) -> bool:
    """Question and answer are both held, ``PART`` of each, and ``similarity`` of the whole item or of each."""
    whole, *parts = shares
    return min(parts) >= PART and max(whole, min(parts)) >= similarity


def scan(index: Index, similarity: float, texts: list[str]) -> list[tuple]:
    """``(document, item, position, score, overlaps)`` of each leak, the best passage per item.

    A passage is two neighbouring stretches of a document, each a quarter longer than the
    longest item; passages overlap by a stretch, so whatever fits in one lies in a passage. The
    block bounds of a passage are at most the sums of its stretches'. A passage must hold enough
    of an item's longer part; what decides, and is reported, is counted over the whole document.
    """
    if not index.items:
        return []
    size = math.ceil(1.25 * max(SHINGLE_WORDS, index.longest))
    blobs = [text.lower().encode() for text in texts]
    at, hashes = word_hashes(b"\n".join(blobs))
    ids = index.look_up(hashes)
    ends = np.cumsum([len(b) + 1 for b in blobs])
    doc_of_word = np.searchsorted(ends, at, side="right")
    lengths = np.bincount(doc_of_word, minlength=len(texts))
    stretches = np.maximum(1, -(-lengths // size))
    base = np.cumsum(stretches) - stretches
    start = np.cumsum(lengths) - lengths
    place = np.arange(len(ids)) - start[doc_of_word]
    stretch = base[doc_of_word] + place // size
    known = ids >= 0
    bound = index.bounds(stretch[known], ids[known], int(stretches.sum()))
    doc_of = np.repeat(np.arange(len(texts)), stretches)
    joined = np.append(doc_of[1:] == doc_of[:-1], False)
    bound[joined] += bound[1:][joined[:-1]]
    best: dict[tuple[int, int], tuple] = {}
    shares: dict[tuple[int, int], tuple[float, float, float]] = {}
    read, words, everywhere = -1, [], None  # the document at hand
    for row in np.flatnonzero(bound.max(axis=1) >= 1).tolist():
        doc = int(doc_of[row])
        a = (row - int(base[doc])) * size
        if a and not joined[row]:
            continue  # a last stretch lies in the passage before it
        b = a + 2 * size
        own = np.unique(ids[start[doc] + a : start[doc] + min(b, lengths[doc])])
        own = own[own >= 0]
        by_block = index.block_most[own].sum(axis=0)
        if by_block.max() < 1:
            continue
        have = None
        for item, score in index.retrieve(own, by_block):
            if doc != read:
                read, words, everywhere = doc, words_of(texts[doc]), None
            have = have or word_runs(words[a:b])
            part = index.parts[item][index.longer[item]]
            if sum(x not in have[len(x)] for x in part) > index.broken[item]:
                continue
            if (doc, item) not in shares:
                everywhere = everywhere or word_runs(words)
                shares[doc, item] = index.overlaps(item, everywhere)
            if is_leak(shares[doc, item], similarity):
                rank = (index.overlaps(item, have)[0], score, -a)
                if (doc, item) not in best or rank > best[doc, item][0]:
                    best[doc, item] = (rank, a, score)
    return [(*key, a, score, *shares[key]) for key, (_, a, score) in best.items()]


LEAK_SCHEMA = (
    "doc_id bigint, item_id bigint, word_position bigint, score double, "
    "overlap double, question_overlap double, answer_overlap double"
)


def indexes(items: DataFrame, item_col: str = "item_id", text_col: str = "text", similarity: float = SIMILARITY) -> Iterator[Index]:
    """Indexes of at most about ``INDEX_ITEMS`` items each, collected one at a time.

    Test sets are small beside a corpus; a larger one is scanned for slice by slice, so that
    what travels to a task stays bounded.
    """
    rows = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("text IS NOT NULL")
    slices = max(1, -(-rows.count() // INDEX_ITEMS))
    for k in range(slices):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
        yield Index([(r.item, r.text) for r in part.orderBy("item", "text").collect()], similarity)


def _scanned(index: Index, similarity: float, batch: pa.Array) -> Iterator[tuple]:
    """The leaks of a batch of texts, some texts at a time."""
    texts = [t or "" for t in batch.to_pylist()]
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_BYTES or k == len(texts) - 1:
            for doc, *rest in scan(index, similarity, texts[start : k + 1]):
                yield start + doc, *rest
            start, size = k + 1, 0


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Benchmark items that documents hold, one row per row of ``docs`` and item.

    Words are runs of letters and digits in lower case. Each document is cut into overlapping
    passages, all of which query a BM25 index of the items' longer parts, question or answer (the
    last sentence); those that may hold enough of its five-word shingles are retrieved. The
    shingles of the whole item, its question and its answer are then counted in the document, so
    text between the two does not matter. A leak holds ``PART`` of the question and of the
    answer, and ``similarity`` of the whole item or of each. Returns ``doc_id, item_id,
    word_position`` (start of the best passage), ``score`` (1: the least that can pass),
    ``overlap, question_overlap, answer_overlap``. An item of fewer words is one shingle.

    Null and empty texts and items match nothing; repeated rows and repeated items each
    return; equal overlaps go to the higher score, then the earlier passage. Empty tables give
    no rows, other columns are ignored. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = [_leaks_of(rows, index, similarity) for index in indexes(items, similarity=similarity)]
    return reduce(DataFrame.unionByName, found)


def _leaks_of(rows: DataFrame, index: Index, similarity: float) -> DataFrame:
    names = [c.split()[0] for c in LEAK_SCHEMA.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [
                (ids[doc], index.items[item], *rest)
                for doc, item, *rest in _scanned(index, similarity, batch.column(1))
            ]
            if found:
                kinds = [pa.int64()] * 3 + [pa.float64()] * 4
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(each, LEAK_SCHEMA)


def drop_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; checked as they are read."""
    place = docs.columns.index(text_col)
    for index in indexes(items, similarity=similarity):
        docs = docs.mapInArrow(_clean_rows(index, similarity, place), docs.schema)
    return docs


def _clean_rows(index: Index, similarity: float, place: int) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for doc, *_ in _scanned(index, similarity, batch.column(place)):
                keep[doc] = False
            yield batch.filter(pa.array(keep))

    return each
