import bisect
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vitrine.llm.bpe import as_bytes, as_sizes, encoder
from vitrine.llm.packing import Limits, best_fit, pack
from vitrine.llm.token_counts import LOW, PrefixCounts, token_prefixes

TEXTS = [
    "", None, "plain words", "  two  blanks ", "line\n\n line\t\tx", "don't 've  'll", "<|endoftext|> in<|endoftext|>side", "é ü　漢字 🙂\x1c x", "a" * 3000,
    "word " * 4000, "\r\n \n", "100% 3.14!!! ### $$$",
]
PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "bc", "'s", "é", "1", "!!", "<|endoftext|>", " ", "　", "\x1c", "🙂"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_chunked_ids_are_the_librarys(pieces):
    import public_tokenizers

    known = encoder(public_tokenizers.path("byte_bpe_50k.json"), "bytes")
    text = "".join(pieces)
    want = known.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(b"".join(known.pieces(text, as_bytes)), "<u4").tolist() == want


def test_prefix_table_answers_every_prefix(documents, tokenizer, tokenizer_path):
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rows = {r["doc_id"]: r for r in token_prefixes(documents(TEXTS), tokenizer_path).collect()}
    for i, text in enumerate(TEXTS):
        text = text or ""
        assert (rows[i]["n_bytes"], rows[i]["prefix_tokens"][-1]) == (len(text.encode()), count(text))
        table = PrefixCounts(text, rows[i]["prefix_bytes"], rows[i]["prefix_tokens"], tokenizer_path)
        asked = range(len(text) + 1) if len(text) <= 100 else range(0, len(text) + 1, 251)
        counts = {len(text[:k].encode()): count(text[:k]) for k in asked}
        assert {n: table.count(n) for n in counts} == counts, text
        if len(text) <= 100:
            for budget in range(max(counts.values()) + 1):
                assert table.longest_within(budget) == max(n for n, c in counts.items() if c <= budget), (text, budget)


@settings(max_examples=100, deadline=None)
@given(PIECES)
def test_every_prefix_and_budget(pieces):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    known, text = encoder(path, "sizes"), "".join(pieces)
    ends = np.cumsum(np.array([0, *known.pieces(text, as_sizes)], np.int64))
    table = PrefixCounts(text, (ends >> 32).tolist(), (ends & LOW).tolist(), path)
    counts = {len(text[:k].encode()): len(known.library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)}
    assert {n: table.count(n) for n in counts} == counts
    for budget in range(max(counts.values()) + 1):
        assert table.longest_within(budget) == max(n for n, c in counts.items() if c <= budget)


def one_by_one(counts, capacity):
    """Best-fit decreasing, piece by piece."""
    rooms = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            at = bisect.bisect_left(rooms, n)
            room = rooms.pop(at) if at < len(rooms) else capacity
            bisect.insort(rooms, room - n)
    return len(rooms)


def check_packing(rows, limits):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(pieces) <= limits.documents
        assert sum(n * n for _, n in pieces) <= limits.attention
    return len(by)


def test_pack_round_trip(documents, tokenizer, tokenizer_path):
    limits = Limits(tokens=64, documents=64, attention=64 * 64)
    texts = [t for t in TEXTS for _ in range(3)]
    packing = pack(documents(texts), tokenizer_path, 2, limits)
    placed = packing.place(packing.pieces).collect()
    used = check_packing(placed, limits)
    total = sum(r["length"] for r in placed)
    assert used <= -(-total // 64) + 2 and used == packing.plan.sequences
    assert [r["piece"] for r in sorted(placed, key=lambda r: (r["doc_id"], r["start"]))] == [
        r["piece"] for r in sorted(placed, key=lambda r: (r["doc_id"], r["piece"]))
    ]
    sequences = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences().collect()}
    for i, text in enumerate(texts):
        own = sorted((r for r in placed if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = b"".join(sequences[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] for r in own)
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert all(r["length"] == 64 for r in own[1:])
        assert zlib.crc32(ids) == zlib.crc32(np.array(want, "<u4").tobytes())


@pytest.mark.parametrize("choose", ["norm", "dot"])
@pytest.mark.parametrize("limits", [Limits(100, 100, 10_000), Limits(100, 3, 10_000), Limits(100, 8, 10_000)])
def test_best_fit_keeps_every_limit(choose, limits):
    rng = np.random.default_rng(3)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 101, 60), rng.integers(1, 400, 60), strict=True)}
    plan = best_fit(counts, limits, choose)
    rows, placed = [], {}
    for length, rank, n, first, offset in zip(plan.length, plan.rank, plan.count, plan.first, plan.offset, strict=True):
        placed.setdefault(int(length), []).extend(range(rank, rank + n))
        rows += [{"sequence_id": first + k, "offset": int(offset), "length": int(length)} for k in range(n)]
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(v)) for k, v in counts.items()}
    assert check_packing(rows, limits) == plan.sequences
    if limits.documents == 100 and choose == "norm":
        assert plan.sequences == one_by_one(counts, limits.tokens)


def test_pack_nothing(documents, tokenizer_path):
    packing = pack(documents([]), tokenizer_path, 2)
    assert packing.place(packing.pieces).count() == 0 and packing.plan.sequences == 0


def test_table_has_every_prefix(documents, tokenizer, tokenizer_path, monkeypatch):
    """Of long chunks and special strings too, and answers encode nothing."""
    texts = [*TEXTS, "<|endoftext|>" * 3 + " a <|endo", "x" * 40 + "<|endoftext|>" + "  \n y'll 've", "ab" * 60 + "漢字é" * 20, "\n" * 40 + " \n", "http://" + "a1b2-c3_" * 20, None]
    rows = {r["doc_id"]: r for r in token_prefixes(documents(texts), tokenizer_path).collect()}
    for name in ("pieces", "prefix_counts"):
        monkeypatch.setattr(type(encoder(tokenizer_path, "prefixes")), name, None)
    for i, text in enumerate(texts):
        text = text or ""
        assert rows[i]["prefix_bytes"] == [len(text[:k].encode()) for k in range(len(text) + 1)] if len(text) < 5000 else True
        asked = range(len(text) + 1) if len(text) <= 500 else range(0, len(text) + 1, 97)
        want = {k: len(tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in asked}
        assert {k: rows[i]["prefix_tokens"][k] for k in asked} == want, text[:80]
        table = PrefixCounts(text, rows[i]["prefix_bytes"], rows[i]["prefix_tokens"], tokenizer_path)
        if len(text) <= 500:
            for budget in range(max(want.values()) + 1):
                assert table.longest_within(budget) == len(text[: max(k for k, c in want.items() if c <= budget)].encode())
