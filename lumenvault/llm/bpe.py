"""Byte-pair encoding: token counts by heap and linked list, and byte-level encoding by padded matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

#: Distinct pieces that a Python worker remembers before it starts afresh.
REMEMBER = 300_000
#: Pieces of more bytes than this are merged by heap: a matrix round merges one pair a row, so a row takes the square of
#: its length (measured: 0.17 s for 1024 bytes, 4.9 s for 16,384; by heap 0.003 s and 0.07 s).
LONGEST_ROW = 1024
#: Cells of a padded matrix.
CELLS = 1 << 20
NONE = np.int32(2**31 - 1)


def heap_merge(symbols: list[int], pairs: dict[int, int], merged) -> tuple[int, list[int], list[int]]:
    """Merges the lowest-rank adjacent pair of symbol ids, leftmost first, until none has a rank.

    pairs: left << 32 | right -> rank; merged[rank]: the symbol made. Symbols form a linked list; the
    heap holds rank << 32 | position, and `live` the rank of the pair that now starts at a position,
    so a popped entry that differs is stale. Returns the number of merges, the symbols by position
    and the links.
    """
    n, get, merges = len(symbols), pairs.get, 0
    live = [get(a << 32 | b, -1) for a, b in zip(symbols, symbols[1:])]
    live.append(-1)
    heap = [r << 32 | i for i, r in enumerate(live) if r >= 0]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapq.heapify(heap)
    while heap:
        x = heapq.heappop(heap)
        i, r = x & 0xFFFFFFFF, x >> 32
        if live[i] != r:
            continue
        j = after[i]
        k = after[i] = after[j]
        m = symbols[i] = merged[r]
        merges += 1
        live[j] = q = -1
        if k < n:
            before[k] = i
            q = get(m << 32 | symbols[k], -1)
            if q >= 0:
                heapq.heappush(heap, q << 32 | i)
        live[i] = q
        h = before[i]
        if h >= 0:
            q = live[h] = get(symbols[h] << 32 | m, -1)
            if q >= 0:
                heapq.heappush(heap, q << 32 | h)
    return merges, symbols, after


class Remembered(dict):
    """What `make` gives for a key. Holds the first REMEMBER keys; later ones are made each time."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < REMEMBER:
            self[key] = value
        return value


# ---------------------------------------------------------------- token counts

#: Code points that the split library takes for neither letters nor numbers, while newer tables than its own do.
UNCLASSED = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
#: Capital letters (first, last, their small letter's distance) that the library lower-cases and Python's older tables do not.
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)


def _ranges(spans) -> str:
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b, *_ in spans)


class WordCounter:
    """Token counts of a `tokenizers` BPE file with NFC, white space, lower case, split and byte-level steps.

    The heap merges symbols; the count is the number of first symbols less the merges, and no
    identifiers are made. Added tokens of the file found in a text are one token each, as the library
    does by default; the texts between them are normalised and counted apart.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]] + [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        model = spec["model"]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or model["type"] != "BPE" or model["ignore_merges"] or model["dropout"]:
            raise ValueError(f"{path}: not a word BPE file of the supported form")
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        ids: dict[str, int] = {}
        name = lambda symbol: ids.setdefault(symbol, len(ids))
        self.pairs, self.merged = {}, []
        for rank, (a, b) in enumerate(pairs):
            self.pairs.setdefault(name(a) << 32 | name(b), rank)
            self.merged.append(name(a + b))
        self.letters = [name(x) for x in byte_letters()]
        self.ends = [name(x + self.suffix) for x in byte_letters()]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.piece = regex.compile(pattern)
        # for texts with code points on which the tables of the two libraries differ
        self.rare = regex.compile(f"[{_ranges(UNCLASSED)}{_ranges(NEW_CAPITALS)}]")
        self.small = {c: c + d for a, b, d in NEW_CAPITALS for c in range(a, b + 1)}
        for name_ in ("L", "N"):
            pattern = pattern.replace(rf"\p{{{name_}}}", rf"[\p{{{name_}}}--[{_ranges(UNCLASSED)}]]")
        self.rare_piece = regex.compile(pattern, regex.V1)
        added = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.sign = os.path.commonprefix(added)  # a text without it holds no added token; "" is in every text
        self.known = Remembered(self.count_piece)

    def count_piece(self, piece: str) -> int:
        raw = piece.encode("utf-8")
        symbols = [self.letters[b] for b in raw]
        symbols[-1] = self.ends[raw[-1]]
        return len(symbols) - heap_merge(symbols, self.pairs, self.merged)[0]

    def normalise(self, text: str) -> str:
        if not text.isascii():
            # the library lower-cases code point by code point, so no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def count(self, text: str) -> int:
        n = 0
        if self.special is not None and self.sign in text:
            n = len(self.special.findall(text))
            parts = self.special.split(text) if n else [text]
        else:
            parts = [text]
        look = self.known.__getitem__
        for part in parts:
            if part.isascii() or not self.rare.search(part):
                n += sum(map(look, self.piece.findall(self.normalise(part))))
            else:
                n += sum(map(look, self.rare_piece.findall(self.normalise(part).translate(self.small))))
        return n


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(2)
def word_counter(path: str) -> WordCounter:
    return WordCounter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit. A null text counts as empty: 0 tokens.

    Every row stays, repeated ones too. Columns of these names are replaced, others pass through. An empty table gives an empty result.
    """

    def build():
        counter = word_counter(path)

        def work(texts):
            out = []
            for t in texts:
                n = counter.count(t)
                out.append((len(t.encode("utf-8")), n, n > limit))
            return out

        return work

    return append_columns(docs, text, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())], build)


# ---------------------------------------------------------------- byte-level encoding


class ByteBpe:
    """Byte-level BPE of a .tiktoken rank file."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.piece = regex.compile(pattern)
        get = self.ranks.get
        found = {}
        for token, rank in self.ranks.items():
            for s in range(1, len(token)):
                left, right = get(token[:s]), get(token[s:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.pairs = found
        self._hash(np.fromiter(found.keys(), np.uint64, len(found)), np.fromiter(found.values(), np.int32, len(found)))
        self.known: dict[str, dict[str, object]] = {}

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, filled in vectorised rounds."""
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.probes = np.full(size, np.uint64(2**64 - 1)), np.full(size, NONE), 1
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & (size - 1)
            self.probes += bool(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of token ids merges to, NONE if it has none; negative ids pad."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], NONE)
        todo = np.flatnonzero(((at != keys) & (at != np.uint64(2**64 - 1))).ravel())
        flat, keys, slot = out.reshape(-1), keys.reshape(-1), slot.reshape(-1)
        mask = len(self.keys) - 1
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & mask
            at = self.keys[slot]
            hit = at == keys[todo]
            flat[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (at != np.uint64(2**64 - 1))
            todo, slot = todo[more], slot[more]
        return np.where((left < 0) | (right < 0), NONE, out)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece. Pieces are bucketed by length; rows of a bucket form padded matrices."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = [whole]
            elif len(piece) > LONGEST_ROW:
                out[k] = self.encode_long(piece)
            elif piece:
                buckets.setdefault((len(piece) + 3) // 4 * 4 if len(piece) <= 32 else 1 << (len(piece) - 1).bit_length(), []).append(k)
            else:
                out[k] = []
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(members), step):
                own = members[at : at + step]
                for k, ids in zip(own, self._matrix([pieces[k] for k in own], width)):
                    out[k] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.single[raw], np.int32(-1))
        row = np.arange(len(pieces))
        done: list = [None] * len(pieces)
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(row):
            best = ranks.min(1)
            over = best == NONE
            ended = ids[over]
            for r, line, n in zip(row[over].tolist(), ended.tolist(), (ended >= 0).sum(1).tolist()):
                done[r] = line[:n]
            row, ids, ranks, best = row[~over], ids[~over], ranks[~over], best[~over]
            if not len(row):
                break
            at = ranks.argmin(1)  # leftmost of the lowest rank
            n, w = np.arange(len(row)), ids.shape[1]
            take = np.arange(w - 1) + (np.arange(w - 1) > at[:, None])
            ids = np.take_along_axis(ids, take, 1)
            ids[n, at] = best
            if w == 2:
                ranks = np.full((len(row), 1), NONE)
                ids = np.concatenate([ids, np.full((len(row), 1), -1, np.int32)], 1)
                continue
            ranks = np.take_along_axis(ranks, np.minimum(take[:, : w - 2], w - 2), 1)
            left = np.maximum(at - 1, 0)
            ranks[n, left] = self.pair_ranks(ids[n, left], ids[n, left + 1])
            right = np.minimum(at, w - 3)
            ranks[n, right] = self.pair_ranks(ids[n, right], ids[n, right + 1])
        return done

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece by heap: time n log n, where matrix rounds would take the square."""
        _, ids, after = heap_merge(self.single[np.frombuffer(piece, np.uint8)].tolist(), self.pairs, range(1 << 31))
        out, at = [], 0
        while at < len(ids):
            out.append(ids[at])
            at = after[at]
        return out

    def encode(self, texts: list[str], form) -> list[list]:
        """form(ids) of every piece of each text.

        Pieces that are not remembered under this form are encoded together, once for all the texts given.
        """
        known = self.known.setdefault(form.__name__, {})
        split = [self.piece.findall(t) for t in texts]
        fresh = [p for p in {p for s in split for p in s} if p not in known]
        new = {p: form(self, ids) for p, ids in zip(fresh, self.encode_pieces([p.encode("utf-8") for p in fresh]))}
        if len(known) + len(new) <= REMEMBER:
            known.update(new)
            look = known.__getitem__
        else:
            look = lambda p, old=known.get: old(p) or new[p]
        return [list(map(look, s)) for s in split]

    def as_digest(self, ids: list[int]) -> tuple[int, str, bytes]:
        """(number of ids, ids as text, their bytes)"""
        return len(ids), ",".join(map(str, ids)), b"".join([self.bytes[i] for i in ids])

    def as_packed(self, ids: list[int]) -> bytes:
        return np.array(ids, np.int32).tobytes()


@lru_cache(2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with token_ids (array of int) of each whole text; a null text gives an empty array.

    Every row stays, repeated ones too. A column of that name is replaced, others pass through. An empty table gives an empty result.
    """

    def build():
        bpe = byte_bpe(path, pattern)

        def work(texts):
            return [(np.frombuffer(b"".join(s), np.int32),) for s in bpe.encode(texts, ByteBpe.as_packed)]

        return work

    return append_columns(docs, text, [T.StructField("token_ids", T.ArrayType(T.IntegerType()))], build)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with n_tokens, ids_sha256 and decoded_sha256 of each whole text's ids and their decoding.

    A null text is empty: 0 tokens and the digests of nothing. Every row stays, repeated ones too. Columns of
    these names are replaced, others pass through. An empty table gives an empty result.
    """

    def build():
        bpe = byte_bpe(path, pattern)

        def work(texts):
            out = []
            for found in bpe.encode(texts, ByteBpe.as_digest):
                ids = ",".join([f[1] for f in found])
                back = b"".join([f[2] for f in found])
                out.append((sum([f[0] for f in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
            return out

        return work

    return append_columns(docs, text, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], build)
