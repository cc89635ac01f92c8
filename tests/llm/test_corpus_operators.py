"""The corpus operators against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from agoralytics.llm import (
    covertree,
    decontamination,
    fixity,
    licences,
    packing,
    pseudonyms,
    quality,
    queries,
    repeats,
    sharding,
    simhash,
)
from agoralytics.llm.components import connected_components
from agoralytics.llm.runlength import RunLengthIndex

WORDS = [f"{a}{b}" for a in ("tion", "ra", "el", "mo", "ou", "né") for b in ("", "s", "ter", "li")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, score string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, null, empty, blank and long texts, repeated rows, no id."""
    rng = random.Random(3)
    long, passage = sentence(rng, 6000), sentence(rng, 40)
    texts = {0: sentence(rng, 80), 1: long, 2: None, 3: "", 4: " \n\t", 5: "one two", 6: passage}
    for i in range(7, 40):
        texts[i] = sentence(rng, rng.randint(1, 90))
    for i in range(40, 50):
        texts[i] = f"{sentence(rng, 20)}\n{passage}. {sentence(rng, 20)}"
        texts[i + 10] = texts[0]
        texts[i + 20] = texts[7].replace("ra", "RA", 1)
    out = [(i, t) for i, t in texts.items()]
    return out + [out[0], out[0], (None, passage), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 9, "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def linked(ids, link):
    """Smallest id reachable, by repeated minima; ids that are null give none."""
    label = [float("inf") if i is None else i for i in ids]
    near = [[j for j in range(len(ids)) if link(i, j)] for i in range(len(ids))]
    while True:
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(ids))]
        if new == label:
            return [None if x == float("inf") else x for x in label]
        label = new


def test_components_of_chains_stars_and_repeats(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 60)] + [(5, 6), (70, 70)]
    edges = spark.createDataFrame([*pairs, (None, 4)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(5, 60), 5)}
    assert connected_components(edges.limit(0)).count() == 0


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_follow_the_published_walk(docs, rows, none):
    got = sharding.assign_shards(docs, 5).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == sorted(
        (-1 if i is None else i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), jump((i or 0) % 2**64, 5), jump((i or 0) % 2**64, 6))
        for i, t in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(none, 5).count() == 0


def test_a_negative_key_is_unsigned(spark):
    frame = spark.createDataFrame([(-1,), (-(2**63),), (2**63 - 1,)], "k bigint")
    got = frame.select("k", sharding.jump_shards(F.col("k"), 40).alias("p")).collect()
    assert all(r.p.shard == jump(r.k % 2**64, 40) and r.p.grown == jump(r.k % 2**64, 41) for r in got)


def test_pieces_hold_every_id_once(docs, rows, none):
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.encode_special_tokens = True
    want = sorted(
        (-1 if i is None else i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())
        for i, t in rows
    )
    got = packing.pack_documents(docs, queries.tokenizer_path(), buffer_tokens=5000).collect()
    by_sequence, tokens = defaultdict(list), defaultdict(int)
    texts = defaultdict(set)
    for i, raw in want:
        texts[i].add(raw)
    for r in got:
        i = -1 if r.doc_id is None else r.doc_id
        cuts = {zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) for raw in texts[i] if len(raw) == 4 * r.doc_tokens}
        assert r.ids_crc32 in cuts
        tokens[i] += r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sum(tokens.values()) == sum(len(raw) // 4 for _, raw in want)
    for pieces in by_sequence.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        total = sum(n for _, n in pieces)
        assert total <= 1024 and total & (total - 1) == 0
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["", " a", "a ", "a  b", "a\n\nb", "x\ty z", "a\r\nb c", "\x00 a", "é «ok» don't", "<|endoftext|> b"])
def test_word_by_word_ids_are_those_of_the_text(text):
    encoder = packing.WordEncoder(queries.tokenizer_path())
    for _ in range(2):
        assert encoder.encode(f"{text} common words") == encoder._ids(f"{text} common words").tobytes()
        assert encoder.encode(text) == encoder._ids(text).tobytes()


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>\n<|endoftext|>b c"])
def test_ids_of_added_tokens_are_those_of_the_file(text):
    import tokenizers

    plain = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    ids = plain.encode(text, add_special_tokens=False).ids
    assert ids.count(50256) == text.count("<|endoftext|>")
    encoder = packing.WordEncoder(queries.tokenizer_path())
    for _ in range(2):
        assert encoder.encode(text) == np.array(ids, dtype="<u4").tobytes()


def simple_fingerprint(text):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    grams = [b" ".join(parts[k : k + 4]) for k in range(max(1, len(parts) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_equal_brute_force(docs, rows, none):
    fps = [simple_fingerprint(t) for _, t in rows]
    want = linked([i for i, _ in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    for shard_rows in (10, 20_000):
        got = simhash.simhash_groups(docs, shard_rows=shard_rows).collect()
        assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(
            ((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want, strict=True)), key=str
        )
    assert simhash.simhash_groups(none).count() == 0
    assert key((None, 1)) == (-1, 1)


def test_the_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    rng = random.Random(8)
    a, b, c, d, e = (sentence(rng, 80) for _ in range(5))
    rows = [(None, a), (3, b), (2, b), (2, b), (None, b), (None, c), (None, c), (5, d), (5, d), (5, e), (4, e), (None, a + " end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_row", F.lit("x"))
    fps = {t: simple_fingerprint(t) for _, t in rows}
    assert all((fps[x] ^ fps[y]).bit_count() > 4 for x, y in itertools.combinations((a, b, c, d, e), 2))
    near = (fps[a] ^ fps[a + " end"]).bit_count() <= 4
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    want = [(None, a), (2, b), (None, c), (5, d), (4, e)] + [(None, a + " end")] * (not near)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.simhash_near_dedup(spark, docs.limit(0), "").count() == 0


def test_vantage_shards_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.unique([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(12)])
    fps = np.array(fps, dtype=np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    edges = simhash.fingerprint_links(frame, 4, shard_rows=40).collect()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    joined = simhash.Forest(len(fps))
    joined.link(np.array([place[r.a] for r in edges]), np.array([place[r.b] for r in edges]))
    want = simhash.Forest(len(fps))
    want.link(*np.nonzero(near))
    assert np.array_equal(joined.roots(np.arange(len(fps))), want.roots(np.arange(len(fps))))


def test_every_pair_of_a_cut_shard_meets_once_in_bounded_groups():
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    tree = simhash.VantageTree(fps, 2)
    _, shard, home = simhash.Dealing.visited(tree, fps, 4)
    homes, visits = (np.bincount(shard[h], minlength=len(tree.leaves)) for h in (home, ~home))
    dealing = simhash.Dealing(tree, homes, visits, 100)
    assert dealing.parts.max() > 2 and dealing.chunks.max() > 1
    met, groups = {}, {}
    for s, p, c, role, fp in zip(*(x.tolist() for x in dealing.groups(fps, 4)), strict=True):
        groups.setdefault((s, p, c), []).append((role, fp))
    for members in groups.values():
        assert len(members) <= (2 + simhash.CHUNK_SHARDS) * 100 * 1.2
        trees = [f for r, f in members if r != dealing.QUERY]
        own = any(r == dealing.TREE_AND_QUERY for r, _ in members)
        for f in trees:
            for g in [g for r, g in members if r == dealing.QUERY] + [g for g in trees if own and g < f]:
                pair = (f, g) if f < g else (g, f)
                met[pair] = met.get(pair, 0) + 1
    assert set(met.values()) == {1}
    place = {}
    for i, s, h in zip(*simhash.Dealing.visited(tree, fps, 4), strict=True):
        place.setdefault(int(s), ([], []))[0 if h else 1].append(int(fps[i]))
    want = sum(len(a) * (len(a) - 1) // 2 + len(a) * len(b) for a, b in place.values())
    assert len(met) == want


def test_cut_shards_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    fps = np.unique([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(5)])
    fps = np.array(fps, dtype=np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    want = simhash.Forest(len(fps))
    want.link(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4))
    for shard_rows in (60, 300):
        edges = simhash.fingerprint_links(frame, 4, shard_rows).collect()
        joined = simhash.Forest(len(fps))
        joined.link(np.array([place[r.a] for r in edges]), np.array([place[r.b] for r in edges]))
        assert np.array_equal(joined.roots(np.arange(len(fps))), want.roots(np.arange(len(fps))))


def test_repeats_equal_brute_force(docs, rows, none):
    raw = [(i, (t or "").encode()) for i, t in rows]
    order = [float("inf") if i is None else i for i, _ in raw]
    first = {}
    for key, (_, x) in sorted(zip(order, raw, strict=True), key=lambda z: z[0]):
        for a in range(len(x) - 49):
            first.setdefault(x[a : a + 50], key)
    want = []
    for key, (i, x) in zip(order, raw, strict=True):
        gone = bytearray(len(x))
        for a in range(len(x) - 49):
            if first[x[a : a + 50]] < key:
                gone[a : a + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        want.append((i, len(x), sum(1 for run in bytes(gone).split(b"\x00") if run), hashlib.sha256(kept).hexdigest()))
    for hot in (repeats.HOT_BLOCKS, 0):  # with 0, every shared seed is dealt by its strings
        got = [(r.doc_id, r.n_bytes, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in repeats.strip_repeats(docs, hot_blocks=hot).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert repeats.strip_repeats(none).count() == 0


def test_matching_statistics_of_foreign_texts():
    rng = np.random.default_rng(2)
    base = rng.integers(1, 4, (6, 84))
    texts = base[rng.integers(0, 6, 60)].copy()
    change = rng.random(texts.shape) < 0.03
    texts[change] = rng.integers(1, 4, change.sum())
    index = RunLengthIndex(texts.astype(np.uint16), np.arange(60), 50)
    foreign = rng.integers(1, 6, (5, 84)).astype(np.uint16)
    foreign[0] = texts[3]
    _, match = index.statistics(foreign)
    held = [bytes(t.astype(np.uint8)) for t in texts]
    for i, j in itertools.product(range(5), range(84)):
        q = bytes(foreign[i].astype(np.uint8))[j : j + 50]
        assert match[i, j] == max(n for n in range(len(q) + 1) if any(q[:n] in t for t in held))


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 8))
    x = np.concatenate((x, x[:10] + 0.05 * rng.normal(size=(10, 8)), x[:3], np.repeat(x[:1], 20, axis=0) + 0.01 * rng.normal(size=(20, 8))))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] + [1.0] * 7, 0), (903, [None] + [1.0] * 7, 0), (904, [], 0), (905, [1.0], 1), (906, [2.0], 1)]
    monkeypatch.setattr(covertree, "CELL_ROWS", 20)
    monkeypatch.setattr(covertree, "PART_ROWS", 8)
    monkeypatch.setattr(covertree, "LEAF_PAIRS", 4)
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.embedding_links(frame).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    component = linked(range(len(x)), lambda i, j: near[i, j])
    want = {i: (int(near[i].sum()), component[i], component[i] == i) for i in range(len(x))}
    want |= {i: (0, i, True) for i, *_ in odd if i < 905} | {905: (1, 905, True), 906: (1, 905, False)}
    assert got == want
    assert covertree.embedding_links(frame.limit(0)).count() == 0


ITEMS = [(1, "Rates of the ternary elmo rise with every second tion. Why do they rise?\nBecause the outer moli is warm and the inner one is not."), (2, "too short"), (3, None), (4, ""), (1, "too short")]


def test_leaks_equal_a_count_of_shingles(spark, rows):
    rng = random.Random(4)
    item = ITEMS[0][1]
    changed = item.replace("warm", "cold")
    texts = [t for _, t in rows] + [f"{sentence(rng, 300)} {item} {sentence(rng, 50)}", f"{sentence(rng, 9)} {changed}", item.upper(), item[: len(item) // 2], "Too short!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("score", F.lit("x"))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, round(r.overlap, 9)) for r in decontamination.leaks(docs, items).collect())

    def grams(text, n):
        words = decontamination.words_of(text or "")
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}

    want = []
    for i, t in enumerate(texts):
        for item_id, x in ITEMS:
            n = min(5, len(decontamination.words_of(x or "")))
            if n and (share := len(grams(x, n) & grams(t, n)) / len(grams(x, n))) >= 0.8:
                want.append((i, item_id, round(share, 9)))
    assert got == sorted(want) and len(got) >= 4
    kept = {r.doc_id for r in decontamination.drop_leaks(docs, items).collect()}
    assert kept == set(range(len(texts))) - {i for i, *_ in got}
    assert decontamination.leaks(docs, items.limit(0)).count() == 0
    assert decontamination.leaks(docs.limit(0), items).count() == 0


def test_leaks_hold_question_and_answer_wherever_they_stand(spark):
    rng = random.Random(11)
    question, answer = "Which of the " + " ".join(f"q{k}" for k in range(40)) + "?", "It is the warm outer moli of them."
    other, gap = "No one can say what that might ever be.", sentence(rng, 600)
    texts = [f"{question}\n{answer}", f"{question} {gap} {answer}", f"{answer} {gap} {question}", f"{question}\n{other}", question, f"{gap} {answer}", f"{gap} {question}\n{other} {gap}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, texts[0]), (2, f"{sentence(rng, 9)} x?\n{sentence(rng, 30)} y.")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.question_overlap, r.answer_overlap) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(k, 1): (1.0, 1.0) for k in range(3)}
    assert {r.doc_id for r in decontamination.drop_leaks(docs, items).collect()} == {3, 4, 5, 6}


def test_scores_separate_classes_and_depend_on_the_text_alone(spark, docs, rows, none):
    rng = random.Random(6)
    good = [(i, sentence(rng, rng.randint(20, 90)) + ".") for i in range(1000, 1120)]
    bad = [(i, sentence(rng, rng.randint(20, 90)).upper().replace(" ", "!! ")) for i in range(1120, 1240)]
    corpus = spark.createDataFrame(good + bad + rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 1120)) for i in range(1000, 1240)] + [(1000, None), (None, 1)], "doc_id bigint, quality int")
    got = quality.score_documents(corpus, labels).collect()
    assert len(got) == len(good) + len(bad) + len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    tested = [r for r in got if r.doc_id is not None and r.doc_id >= 1000 and r.held_out]
    assert tested and sum(r.predicted == int(r.doc_id < 1120) for r in tested) >= 0.95 * len(tested)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len({r.score for r in got if r.doc_id in (0, 50, 51)}) == 1
    kept = quality.keep_good(corpus, labels)
    assert kept.columns == corpus.columns and kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(none, labels).count() == 0


PRIVATE = [
    ("4111 1111 1111 1111", r"\d{4} \d{4} \d{4} \d{4}"),
    ("233.254.104.120", r"(\d+\.){3}\d+"),
    ("2021-03-04", r"\d{4}-\d\d-\d\d"),
    ("31/12/1999", r"\d\d/\d\d/\d{4}"),
    ("123-45-6789", r"\d{3}-\d\d-\d{4}"),
    ("+1 (017) 555-7713", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
    ("the.72@mail3.example.com", r"[a-z]{3}\.\d\d@mail3\.example\.com"),
    ("DE89370400440532013000", r"DE\d{20}"),
    ("9233A8ECF7C5B09FE5949719B6B82BC439E9329B", r"[0-9A-F]{40}"),
]


def luhn(number):
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_keep_format_validity_and_links(spark, docs, rows, none):
    import re

    values = [v for v, _ in PRIVATE]
    texts = [f"x {v}, y" for v in values] + [" | ".join(values), "4111111111111112 999.1.1.1 2021-02-30 12345", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("found", F.lit(1))
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(frame, "k").collect()}
    for k, (value, form) in enumerate(PRIVATE):
        new = got[k].text[2:-3]
        assert re.fullmatch(form, new) and new != value and got[k].n_pseudonyms == 1
        assert new in got[len(values)].text and value not in got[len(values)].text
    assert luhn(got[0].text) and all(int(o) < 256 for o in got[1].text[2:-3].split("."))
    iban = got[7].text[2:-3]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[len(values) + 1].text == texts[len(values) + 1]
    assert got[len(values) + 2].text is None and got[len(values) + 3].text == ""
    other = {r.doc_id: r.text for r in pseudonyms.pseudonymise(frame, "other key").collect()}
    assert other[1] != got[1].text
    assert [r.text for r in pseudonyms.replace_personal_data(docs).collect()] == [t for _, t in rows]
    assert pseudonyms.pseudonymise(none).count() == 0


@pytest.mark.parametrize("text", ["password: correcthorse", '"api_key": "abcdefghijkl"', f"key {'abcdef' * 6} end", f"key {'ABCDEF' * 6} end"])
def test_secrets_without_a_digit_are_replaced(spark, text):
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = pseudonyms.pseudonymise(frame, "k").first()
    assert got.n_pseudonyms == 1 and got.text != text and len(got.text) == len(text)
    assert pseudonyms.replace_personal_data(frame, "k").first().text == got.text


BESIDE = [  # text, and the only values in it that are valid
    ("pay ES9121000418450200051332 BIC now", ["ES9121000418450200051332"]),
    ("BE68 5390 0754 7034 NOW", ["BE68 5390 0754 7034"]),
    ("AT61 1904 3002 3457 3201 SWIFT", ["AT61 1904 3002 3457 3201"]),
    ("IBAN BE68 5390 0754 7034 4111 1111 1111 1111 CVV", ["BE68 5390 0754 7034", "4111 1111 1111 1111"]),
    ("exp 2025 4111 1111 1111 1111, 12", ["4111 1111 1111 1111"]),
    ("AMEX 3782 822463 10005 VISA", ["3782 822463 10005"]),
    ("378282246310005 X", ["378282246310005"]),
    ("DB_PASSWORD=hunter2hunter2 X", ["DB_PASSWORD=hunter2hunter2"]),
    ("access_token: abcdEFGH1234", ["access_token: abcdEFGH1234"]),
    ("client_secret = qwertyuiop", ["client_secret = qwertyuiop"]),
    ("a.b.c@d.org,1.2.3.4", ["a.b.c@", "1.2.3.4"]),
]


def test_values_beside_upper_case_words_and_numbers(spark):
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(BESIDE)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(frame, "k").collect()}
    for k, (text, values) in enumerate(BESIDE):
        new, at = got[k].text, 0
        assert len(new) == len(text) and got[k].n_pseudonyms == len(values), (text, new)
        for value in values:
            start = text.index(value, at)
            assert new[at:start] == text[at:start] and new[start : start + len(value)] != value
            at = start + len(value)
        assert new[at:] == text[at:]
    for k in range(4):
        value = BESIDE[k][1][0]
        start = BESIDE[k][0].index(value)
        iban = got[k].text[start : start + len(value)].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert luhn(got[5].text) and got[7].text.startswith("DB_PASSWORD=")


CRAFTED = {  # what once took a deep stack or a time that grew with the square
    "dashes": "1 " + "-" * 200_000,
    "labels": "1 x@" + "a." * 100_000,
    "addresses": "x@a.a.a." * 25_000,
    "digits": "7" * 100_000,
    "groups": "1111 " * 20_000,
    "ones": "1 " * 100_000,
}


@pytest.mark.parametrize("name", CRAFTED)
def test_long_crafted_texts_end_soon(spark, name):
    frame = spark.createDataFrame([(1, CRAFTED[name])], "doc_id bigint, text string")
    pseudonyms.pseudonymise(frame.limit(0), "k").collect()
    started = time.monotonic()
    (got,) = pseudonyms.pseudonymise(frame, "k").collect()
    assert time.monotonic() - started < 20
    assert len(got.text) == len(CRAFTED[name]) and got.n_pseudonyms == (name == "digits")


def test_many_values_in_one_text_link_and_prose_stays(spark):
    texts = ["2020-01-02 x " * 2000, "The token: something else. Secret: nothing.", "token: Abcdefgh1", "token=abcdefgh", "a@x.org b@x.org 010.1.20.255"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(frame, "k").collect()}
    assert got[0].n_pseudonyms == 2000 and len(set(got[0].pseudonyms)) == 1
    assert got[0].text == f"{got[0].pseudonyms[0]} x " * 2000
    assert got[1].text == texts[1] and got[2].n_pseudonyms == got[3].n_pseudonyms == 1
    assert [len(o) for o in got[4].text.split()[2].split(".")] == [3, 1, 2, 3]


def test_the_plan_holds_each_rule_once(spark, none):
    plan = pseudonyms.pseudonymise(none)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000


def test_feistel_is_a_permutation(spark):
    single = spark.createDataFrame([([k],) for k in range(26)], "d array<int>")
    alone = single.select(pseudonyms.feistel(F.col("d"), F.array(F.lit(26)), F.lit("t"), "k")[0].alias("m"))
    assert sorted(r.m for r in alone.collect()) == list(range(26))
    assert len({(r.m - k) % 26 for k, r in enumerate(alone.collect())}) > 1
    frame = spark.range(27 * 11).select(F.array((F.col("id") / 11).cast("int"), (F.col("id") % 11).cast("int")).alias("d"))
    moved = frame.select(pseudonyms.feistel(F.col("d"), F.array(F.lit(27), F.lit(11)), F.lit("t"), "k").alias("m"))
    assert {tuple(r.m) for r in moved.collect()} == set(itertools.product(range(27), range(11)))


def test_audit_finds_exactly_the_changed_records(spark):
    ours = spark.range(900).select((F.col("id") % 5).alias("file"), F.floor(F.col("id") / 5).alias("position"), (F.floor(F.col("id") / 5) * 10).alias("offset"), F.lit(10).cast("bigint").alias("length"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    lost = "NOT (file = 2 AND position >= 170)"
    theirs = ours.where(lost).withColumn("digest", F.when(F.expr("position = 7 AND file IN (0, 4)"), None).otherwise(F.col("digest")))
    got = {(r.file, r.position): (r.status, r.offset, r.length) for r in fixity.audit(ours, theirs).collect()}
    want = {(2, p): ("missing", 10 * p, 10) for p in range(170, 180)} | {(f, 7): ("damaged", 70, 10) for f in (0, 4)}
    assert got == want
    assert {r.status for r in fixity.audit(theirs.where("file = 2"), ours.where("file = 2")).collect()} == {"extra"}
    assert fixity.audit(ours, ours).count() == 0
    assert fixity.audit(ours.limit(0), ours.limit(0)).count() == 0


def test_manifest_places_records_without_gaps(spark):
    from agoralytics.plans.staging import staged

    pages = spark.createDataFrame([(i % 7 or None, "u", "x" * i) for i in range(40)] + [(1, None, None)] * 3, "page_id bigint, url string, html string")
    records = staged(pages.select("page_id", F.length(fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))).cast("bigint").alias("length")), "t")
    rows = fixity.manifest(records, file_bytes=1000).collect()
    files = defaultdict(list)
    for r in rows:
        files[r.file].append((r.position, r.offset, r.length))
    assert len(rows) == 43 and len(files) > 2
    for held in files.values():
        held.sort()
        assert [p for p, *_ in held] == list(range(len(held)))
        assert [o for _, o, _ in held] == [sum(n for *_, n in held[:k]) for k in range(len(held))]


def test_licences_of_notices_and_nearest_directory(spark):
    apache, mit = licences.TEMPLATES["Apache-2.0"][0], licences.TEMPLATES["MIT"][0]
    rows = [
        (1, "a/LICENSE", f"Notes.\n{mit}"),
        (2, "a/b/c/x.py", "plain"),
        (3, "a/b/LICENSE.txt", apache),
        (4, "a/y.py", None),
        (5, "z.py", f"# {apache}\r\ncode"),
        (6, None, ""),
        (7, "q/LICENSE", "All rights reserved by somebody else entirely, of no known form at all."),
        (8, "q/w.py", "plain"),
        (2, "a/b/c/x.py", "plain"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumn("licence", F.lit("?"))
    got = sorted((r.doc_id, r.licence, r.origin, r.origin_directory) for r in licences.scan_licences(frame).collect())
    assert got == [
        (1, "MIT", "notice", None),
        (2, "Apache-2.0", "inherited", "a/b"),
        (2, "Apache-2.0", "inherited", "a/b"),
        (3, "Apache-2.0", "notice", None),
        (4, "MIT", "inherited", "a"),
        (5, "Apache-2.0", "notice", None),
        (6, None, "none", None),
        (7, None, "none", None),
        (8, None, "none", None),
    ]
    assert licences.scan_licences(frame.limit(0)).count() == 0


PROSE = "The committee met in spring and spoke of rivers, bridges and the cost of grain.\n" * 3
COMMENTED = {
    "spdx": "// SPDX-License-Identifier: Apache-2.0\n#include <x.h>\nint main() { return 0; }",
    "choice": "# SPDX-License-Identifier: (MIT OR Apache-2.0)\nimport os",
    "inside": "A small parser. Released under the MIT License. It reads one file at a time and prints it.",
    "mpl": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL "
    "was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n\nvoid f();",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General "
    "Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) "
    "any later version.\n#\n# This program is distributed in the hope that it will be useful,\n\nx = 1",
    "apache": ' * Copyright 2019 Somebody\n *\n * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not '
    "use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n",
    "bsd2": "// Copyright (c) 2020, A. N. Other\n//\n// " + licences.TEMPLATES["BSD-2-Clause"][0].replace(" 1. ", "\n//\n// 1. ")
    .replace(" 2. ", "\n//\n// 2. ").replace(" THIS SOFTWARE", "\n//\n// THIS SOFTWARE", 1) + "\n\nint g();",
    "bsd3": "BSD 3-Clause License\n\nCopyright (c) 2020\n\n" + licences.TEMPLATES["BSD-3-Clause"][1].replace(" 1. ", "\n\n1. ")
    .replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ").replace(" THIS SOFTWARE", "\n\nTHIS SOFTWARE", 1),
    "mit": "Copyright (c) 2021 A\n\n" + licences.TEMPLATES["MIT"][3].replace(" The above", "\n\nThe above", 1),
    "gpl2": "            GNU GENERAL PUBLIC LICENSE\n               Version 2, June 1991\n\n Copyright (C) 1989, 1991\n\n" + PROSE,
    "legal": "The licensee shall keep the premises in good repair. Any licence granted by the council may be withdrawn.\n"
    "All rights reserved to the landlord under this agreement, and copyright in the drawings stays with the architect.",
    "plain": PROSE,
    "empty": "",
}
FOUND = {
    "spdx": "Apache-2.0", "choice": "MIT OR Apache-2.0", "inside": "MIT", "mpl": "MPL-2.0", "gpl": "GPL-3.0",
    "apache": "Apache-2.0", "bsd2": "BSD-2-Clause", "bsd3": "BSD-3-Clause", "mit": "MIT", "gpl2": "GPL-2.0",
}


def test_licence_headers_and_licence_files(spark):
    rows = [(k, f"{name}/main.c", text) for k, (name, text) in enumerate(COMMENTED.items())]
    rows += [(100 + k, f"file-{name}/LICENSE", text) for k, (name, text) in enumerate(COMMENTED.items())]
    rows += [(200, "long/x.c", COMMENTED["mpl"] + "word " * 200_000), (201, None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    got = {r.doc_id: r for r in licences.scan_licences(frame).collect()}
    assert len(got) == len(rows) and got[201].origin == "none" and got[200].licence == "MPL-2.0"
    for k, name in enumerate(COMMENTED):
        assert got[k].licence == FOUND.get(name), (name, got[k])
        assert got[100 + k].licence == FOUND.get(name), (name, got[100 + k])
    assert got[0].origin == "spdx" and got[2].origin == "notice"


def test_licence_cosines_against_brute_force(spark):
    import math
    import re
    from collections import Counter

    texts = [t for t in COMMENTED.values()]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = frame.select(F.explode(licences.statements(F.col("text"), F.lit(True))).alias("statement")).distinct()
    parts = found.where("statement <> ''").withColumn("key", F.unhex(F.md5("statement"))).cache()
    got = {bytes(r.key): (r.licence, r.cosine) for r in licences.template_cosines(parts).collect()}

    def bag(text):
        return Counter(re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower()))

    own = {bytes(r.key): bag(r.statement) for r in parts.collect()}
    models = [(name, bag(t)) for name, ts in licences.TEMPLATES.items() for t in ts]
    bags = [*own.values(), *(m for _, m in models)]
    df = Counter(w for b in bags for w in b)

    def weighted(b):
        return {w: n * (math.log((1 + len(bags)) / (1 + df[w])) + 1) for w, n in b.items()}

    def cosine(a, b):
        dot = sum(x * b.get(w, 0.0) for w, x in a.items())
        return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    vectors = [(name, weighted(m)) for name, m in models]
    assert len(own) > 30
    for key, b in own.items():
        best = max(cosine(weighted(b), m) for _, m in vectors)
        if best > 0:
            assert got[key][1] == pytest.approx(best, abs=1e-8)
            assert max(cosine(weighted(b), m) for n, m in vectors if n == got[key][0]) == pytest.approx(best, abs=1e-8)
        else:
            assert key not in got


def test_licence_scan_runs_without_python_workers(spark):
    frame = spark.createDataFrame([(1, "a/b", "x")], "doc_id bigint, path string, text string")
    plan = licences.scan_licences(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
