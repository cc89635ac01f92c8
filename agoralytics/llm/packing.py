"""Token packing into windows of several sizes."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 0
TIERS = (128, 256, 512, 1024)
BUFFER_TOKENS = 1 << 21  # a task packs together documents of about so many tokens
CACHE_WORDS = 1 << 20  # a worker remembers the ids of so many words
STEP_TOKENS = 1 << 15  # tokens of one training step

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, tier int, step_group bigint"
)
# Fixed value: how byte-level vocabularies of this kind cut a text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")  # the same kind of character in every version
Piece = tuple[int, int, int]  # length, document, first token


def quick_encoding(path: str):
    """The file's vocabulary for a faster library that gives the same ids, or None for other kinds of file.

    That library always joins the pair whose joint piece has the lowest id. This is the order
    of the file's merges if their pieces have rising ids, as in byte-level vocabularies.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    model, split = made["model"], made.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not made.get("normalizer") and not model.get("ignore_merges")
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return None
    vocabulary, added = model["vocab"], {t["content"] for t in made["added_tokens"]}
    pieces = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(pieces, pieces[1:], strict=False)):
        return None
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in added}
    return tiktoken.Encoding("words", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """Ids of texts, as little-endian 32-bit bytes, remembering the ids of single words.

    The vocabulary's pattern starts a new piece at a single space between two other characters
    and makes a single line break there a piece of its own. A text may therefore be encoded
    word by word, each with the space or line break before it. Words with white space at
    either end break this rule; a text that holds one is encoded whole. So is a text that holds
    an added token such as ``<|endoftext|>``, which is one id as in the given file.
    """

    _BREAK = "\x00"  # stands for a line break in front of a word

    def __init__(self, path: str):
        import tokenizers

        self._tokenizer = tokenizers.Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._newline = self._ids("\n")
        self._quick = quick_encoding(path)
        self._known: dict[str, bytes] = {}  # no bytes: the word cannot stand alone

    def encode(self, text: str) -> bytes:
        if len(self._known) > CACHE_WORDS:
            self._known.clear()
        if self._BREAK in text or any(t in text for t in self._added):
            return self._ids(text).tobytes()
        words = f"\n{text}".replace("\n", f" {self._BREAK}").split(" ")[1:]
        parts = list(map(self._known.get, words))
        if None in parts:
            self._learn({w for w, p in zip(words, parts, strict=True) if p is None})
            parts = list(map(self._known.get, words))
        if b"" in parts:
            return self._ids(text).tobytes()
        return b"".join(parts)[self._newline.nbytes :]

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _quick_ids(self, text: str) -> np.ndarray:
        return np.asarray(self._quick.encode_ordinary(text), dtype="<u4")

    def _learn(self, words: set[str]) -> None:
        """Encode many words at once, a line each; the line break is one id, which no word holds."""
        self._known.update(dict.fromkeys(words, b""))
        plain = {w: w.removeprefix(self._BREAK) for w in words}
        alone = [w for w, p in plain.items() if p and not p[0].isspace() and not p[-1].isspace()]
        if len(self._newline) != 1:
            return
        quick = [w for w in alone if self._quick and _LATIN.fullmatch(plain[w])]
        other = [w for w in alone if not self._quick or not _LATIN.fullmatch(plain[w])]
        for space, own, encode in (
            (space, [w for w in group if (plain[w] == w) == bool(space)], encode)
            for group, encode in ((quick, self._quick_ids), (other, self._ids))
            for space in (" ", "")
        ):
            if own:
                ids = encode("\n".join(space + plain[w] for w in own))
                ends = np.append(np.flatnonzero(ids == self._newline[0]), len(ids)).tolist()
                raw, start = ids.tobytes(), 0
                before = b"" if space else self._newline.tobytes()
                for word, end in zip(own, ends, strict=True):
                    self._known[word] = before + raw[4 * start : 4 * end]
                    start = end + 1


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which serves one task after another and need not learn words anew.

    The functions of this module reach a worker with each task, so what lasts is kept at the
    tokenizer library, which the worker loads once.
    """
    import tokenizers

    held = vars(tokenizers).setdefault("_word_encoders", {})
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows ``(size, pieces)`` that hold every token of documents of ``lengths`` once.

    Documents longer than the largest tier are cut into whole windows. What is left goes to the
    smallest tier that holds it. From the largest tier down, each piece opens a window whose gap
    takes the largest shorter pieces that fit, from its own tier and then from the shorter ones;
    the last of the gap is filled by cutting the next piece. Pieces that fill no window end in
    windows of falling powers of two, so only tiers that are no power of two are ever padded.
    """
    largest = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    pools: list[list[Piece]] = [[] for _ in tiers]

    def route(piece: Piece) -> None:
        insort(pools[next(k for k, t in enumerate(tiers) if piece[0] <= t)], piece)

    for doc, length in enumerate(lengths):
        whole = length - length % largest
        windows += [(largest, [(largest, doc, at)]) for at in range(0, whole, largest)]
        if length > whole:
            route((length - whole, doc, whole))

    def fitting(gap: int, tier: int) -> Piece | None:
        for pool in reversed(pools[: tier + 1]):
            if pool and (k := bisect_right(pool, (gap, 1 << 62, 0))):
                return pool.pop(k - 1)
        return None

    def cut(gap: int, tier: int) -> Piece | None:
        for pool in pools[: tier + 1]:
            if pool:
                length, doc, at = pool.pop(0)
                route((length - gap, doc, at + gap))
                return gap, doc, at
        return None

    rest: list[Piece] = []
    for tier in range(len(tiers) - 1, -1, -1):
        while pools[tier]:
            window = [pools[tier].pop()]
            gap = tiers[tier] - window[0][0]
            while gap and (piece := fitting(gap, tier) or cut(gap, tier)):
                window.append(piece)
                gap -= piece[0]
            if gap:  # nothing is left to fill it
                rest += window
            else:
                windows.append((tiers[tier], window))
    while rest:
        total = sum(p[0] for p in rest)
        size = min(largest, 1 << (total.bit_length() - 1))
        window, gap = [], size
        while gap:
            length, doc, at = rest.pop()
            window.append((min(length, gap), doc, at))
            if length > gap:
                rest.append((length - gap, doc, at + gap))
            gap -= window[-1][0]
        windows.append((size, window))
    return windows


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A training step per window: about ``step_tokens`` tokens and like attention cost in each.

    Windows in falling order of cost (sum of squared piece lengths) go round the steps, forth and back.
    """
    steps = max(1, round(sum(size for size, _ in windows) / step_tokens))
    cost = [sum(p[0] ** 2 for p in pieces) for _, pieces in windows]
    step = [0] * len(windows)
    for turn, k in enumerate(sorted(range(len(windows)), key=lambda i: -cost[i])):
        lap, place = divmod(turn, steps)
        step[k] = steps - 1 - place if lap % 2 else place
    return step


def packer(path: str, tiers: tuple[int, ...], buffer_tokens: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        base = TaskContext.get().partitionId() << 36
        sequences = steps = 0
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequences, steps
            windows = pack_lengths([len(ids) // 4 for _, ids in held], tiers)
            step = step_groups(windows)
            rows = []
            for (tier, pieces), s in zip(windows, step, strict=True):
                offset = 0
                for length, doc, at in pieces:
                    doc_id, ids = held[doc]
                    crc = zlib.crc32(memoryview(ids)[4 * at : 4 * (at + length)])
                    rows.append((doc_id, at, length, crc, len(ids) // 4, base + sequences, offset, tier, base + steps + s))
                    offset += length
                sequences += 1
            steps += max(step, default=-1) + 1
            columns = zip(*rows, strict=True)
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                held.append((doc_id, ids))
                size += len(ids) // 4
                if size >= buffer_tokens:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most ``tiers[-1]`` tokens.

    Returns one row per piece: ``doc_id, start`` (tokens of the document before it), ``length,
    ids_crc32, doc_tokens, sequence_id, offset`` (its place there), ``tier`` (the sequence's
    size) and ``step_group`` (training step). A document is its ids and one end id; null and
    empty texts are that id alone. Every row counts, also repeated ones and those without an id
    (null then); an empty table gives no rows, other columns are ignored.

    Each task packs what it reads, ``buffer_tokens`` at a time, without a shuffle: sequence ids
    hold the task's number, a lost task gives the same rows again, and memory is bounded by the
    buffer and the longest text. ``tiers`` must rise; with powers of two nothing is padded.
    """
    if list(tiers) != sorted(set(tiers)) or tiers[0] < 1:
        raise ValueError("tiers must rise")
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return texts.mapInArrow(packer(tokenizer_path, tuple(tiers), buffer_tokens), SCHEMA)
