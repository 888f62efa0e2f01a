"""Exact byte-level BPE, remembered per blank-separated chunk."""

from __future__ import annotations

import json
import struct

import numpy as np

#: The split pattern of byte-level BPE vocabularies; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_symbol() -> dict[str, int]:
    """Printable bytes stand for themselves in the vocabulary; the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ChunkEncoder:
    """Token ids of whole texts, as the tokenizer file gives them without added special tokens.

    The pattern never joins a blank-free chunk with the one before a single blank, so a text is cut at such blanks and each
    chunk with its blank is encoded once and remembered. Runs of white space are kept with the chunk that follows.
    Texts that hold a special string, and vocabularies whose ids do not follow the order of their merges, are
    encoded by the library of the file itself.

    ``remember`` bounds the number of chunks held at once; the table is emptied when it is full.
    """

    def __init__(self, path: str, remember: int = 1_000_000):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = [x["content"] for x in described.get("added_tokens", [])]
        vocabulary, symbols = described["model"]["vocab"], _byte_of_symbol()
        ranks = {bytes(symbols[c] for c in t): i for t, i in vocabulary.items() if t not in set(self.special)}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in described["model"]["merges"]]
        ordered = all(a < b for a, b in zip(merged, merged[1:], strict=False))
        known = described["pre_tokenizer"] or {}
        plain = ordered and described["normalizer"] is None and known.get("type") == "ByteLevel"
        simple = plain and not known.get("add_prefix_space") and known.get("use_regex", True)
        core = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe if simple else None
        self.fast, self.whole = (core.encode_ordinary, core.encode_single_piece) if core else (None, None)
        self.ranks, self.longest, self.valid = ranks, max(map(len, ranks), default=1), {}
        self.split = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s+", r"\p{White_Space}+").replace(r"\S", r"\P{White_Space}"))
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        #: Whether special strings end a text part and stand for one token wherever they are.
        self.apart = len(self.special) < 2 and not any(x.get(f) for x in described.get("added_tokens", []) for f in ("lstrip", "rstrip", "single_word"))
        self.remember, self.known, self.words = remember, {}, {}

    def pieces(self, text: str, value) -> list:
        """``value(ids, chunk)`` of each chunk in order; the chunks make up the text.

        Where white space joins chunks, the first of them has the value of all and the others that of an empty chunk.
        """
        if self.fast is None or any(s in text for s in self.special):
            return [value(self.library.encode(text, add_special_tokens=False).ids, text)] if text else []
        parts, known = text.split(" "), self.known
        found = list(map(known.get, parts))
        found[0] = None  # no blank stands before it
        empty, i = value([], ""), -1
        while True:
            try:
                i = found.index(None, i + 1)
            except ValueError:
                return found
            part = parts[i]
            if i and part and not part[0].isspace() and not part[-1].isspace():
                if len(known) >= self.remember:
                    known.clear()
                chunk = " " + part
                found[i] = known[part] = value(self.fast(chunk), chunk)
                continue
            j = i
            while j + 1 < len(parts) and (
                not parts[j] or parts[j][-1].isspace() or not parts[j + 1] or parts[j + 1][0].isspace()
            ):
                j += 1
                found[j] = empty
            chunk = (" " if i else "") + " ".join(parts[i : j + 1])
            found[i] = value(self.fast(chunk), chunk)
            i = j


    def prefix_steps(self, _ids: list[int], chunk: str) -> bytes:
        """By how many tokens the count grows, or falls, with each character of a chunk."""
        counts = self.prefix_counts(chunk)
        return struct.pack(f"<{len(counts)}h", *map(int.__sub__, counts, [0, *counts]))

    def prefix_counts(self, chunk: str) -> list[int]:
        """Tokens of every prefix of a chunk, by whole characters; linear in its length."""
        marked = any(s in chunk for s in self.special)
        if self.fast is None or marked and not self.apart:
            return [len(self.library.encode(chunk[:k], add_special_tokens=False).ids) for k in range(1, len(chunk) + 1)]
        if not marked:
            return self._plain_counts(chunk)
        out, base, at = [], 0, 0
        for mark in self.marks.finditer(chunk):
            # until its last character a special string is text like any other
            counts, before = self._plain_counts(chunk[at : mark.end() - 1]), mark.start() - at
            out += [base + c for c in counts]
            base += (counts[before - 1] if before else 0) + 1
            out.append(base)
            at = mark.end()
        return out + [base + c for c in self._plain_counts(chunk[at:])]

    def _plain_counts(self, text: str) -> list[int]:
        """A prefix splits as the text does up to its last word; only white space that ends it is one word with its run."""
        out, base, run, run_base = [], 0, "", 0
        for word in self.split.findall(text):
            counts = self.words.get(word)
            if counts is None:
                if len(self.words) >= self.remember:
                    self.words.clear()
                counts = self._word_counts(word)
                if len(word) <= 64:
                    self.words[word] = counts
            here = [base + c for c in counts] if base else list(counts)
            if run:
                here[0] = run_base + len(self.fast(run + word[0]))
            out += here
            run, run_base = (word, base) if word.isspace() else ("", 0)
            base += counts[-1]
        return out

    def _word_counts(self, word: str) -> list[int]:
        if len(word) <= 16:
            return [len(self.fast(word[:k])) for k in range(1, len(word) + 1)]
        raw = word.encode()
        last, count = [0] * (len(raw) + 1), [0] * (len(raw) + 1)
        for end in range(1, len(raw) + 1):
            for size in range(min(end, self.longest), 0, -1):
                start = end - size
                if raw[start:end] in self.ranks and self._follows(raw[start - last[start] : start], raw[start:end]):
                    last[end], count[end] = size, count[start] + 1
                    break
        if count[-1] != len(self.whole(raw)):
            return [len(self.fast(word[:k])) for k in range(1, len(word) + 1)]
        ends = np.cumsum([len(c.encode()) for c in word]).tolist()
        return [count[e] for e in ends]

    def _follows(self, before: bytes, token: bytes) -> bool:
        """Whether a token can follow another: the encoding of both together is the two.

        Tokens are the encoding of a word just if all neighbours are so, hence each prefix's last token follows from
        the last tokens of shorter prefixes.
        """
        if (before, token) not in self.valid:
            if len(self.valid) >= self.remember:
                self.valid.clear()
            want = [self.ranks[before], self.ranks[token]] if before else [self.ranks[token]]
            self.valid[before, token] = self.whole(before + token) == want
        return self.valid[before, token]


def as_bytes(ids: list[int], _chunk: str) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def as_sizes(ids: list[int], chunk: str) -> int:
    """Bytes and tokens of a chunk in one number."""
    return len(chunk.encode()) << 32 | len(ids)


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, use: str) -> ChunkEncoder:
    """One encoder per worker, file and kind of value."""
    if (path, use) not in _ENCODERS:
        _ENCODERS[path, use] = ChunkEncoder(path)
    return _ENCODERS[path, use]
