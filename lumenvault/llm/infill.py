"""Fill-in-middle transformation: texts are cut in three at code points and rearranged around sentinels.

The byte offset of the k-th code point comes from a learned rank index over all code point boundaries: straight segments that
are off by ERROR bytes at most, and the residual of each boundary, a byte each, which makes the prediction exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import ship
from .common import SLICE_BYTES

#: Sentinels of prefix, suffix and middle, and the shares of texts (in a hundred) left plain and put suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Most bytes that a segment is off: a residual fits in one byte.
ERROR = 127
#: Bytes whose boundaries are fitted at a time.
BLOCK = 1 << 22


class RankIndex:
    """Byte offsets of the code points of UTF-8 bytes by rank; the rank after the last is the end.

    A run of boundaries is one segment, the line through its first and last, if no boundary is further off than ERROR; else
    its halves are tried, all runs of a level at once. Only segments and residuals are kept.
    """

    def __init__(self, raw: bytes):
        first, base, slope, residuals, rank = [], [], [], [], 0
        for at in range(0, len(raw) + 1, BLOCK):
            part = np.frombuffer(raw, np.uint8, min(BLOCK, len(raw) - at), at)
            offsets = np.flatnonzero((part & 0xC0) != 0x80) + at
            if at + BLOCK > len(raw):
                offsets = np.append(offsets, len(raw))
            if len(offsets):
                f, b, s, r = self._fit(offsets)
                first.append(f + rank)
                base.append(b)
                slope.append(s)
                residuals.append(r)
                rank += len(offsets)
        self.first, self.base, self.slope, self.residuals = (np.concatenate(x) for x in (first, base, slope, residuals))

    @staticmethod
    def _line(base, slope, steps):
        return base + np.floor(slope * steps).astype(np.int64)

    @classmethod
    def _fit(cls, offsets: np.ndarray):
        lo, hi = np.array([0]), np.array([len(offsets)])
        residuals, done = np.zeros(len(offsets), np.int8), []
        while len(lo):
            length = hi - lo
            begins = np.cumsum(length) - length
            steps = np.arange(length.sum()) - np.repeat(begins, length)
            slope = (offsets[hi - 1] - offsets[lo]) / np.maximum(1, length - 1)
            at = np.repeat(lo, length) + steps
            off = offsets[at] - cls._line(np.repeat(offsets[lo], length), np.repeat(slope, length), steps)
            good = np.maximum.reduceat(np.abs(off), begins) <= ERROR
            held = np.repeat(good, length)
            residuals[at[held]] = off[held]
            done.append((lo[good], offsets[lo[good]], slope[good]))
            lo, hi = lo[~good], hi[~good]
            middle = (lo + hi) // 2
            lo, hi = np.concatenate((lo, middle)), np.concatenate((middle, hi))
        first, base, slope = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(first)
        return first[order], base[order], slope[order], residuals

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Predicted by the rank's segment, corrected by its residual."""
        s = np.searchsorted(self.first, ranks, "right") - 1
        return self._line(self.base[s], self.slope[s], ranks - self.first[s]) + self.residuals[ranks]

    def ranks(self, offsets: np.ndarray) -> np.ndarray:
        """The ranks of boundaries: the segment inverts its line, which ERROR bounds, so a short search around the guess is enough."""
        lo, hi = np.zeros(len(offsets), np.int64), np.full(len(offsets), len(self.residuals) - 1, np.int64)
        s = np.searchsorted(self.base, offsets, "right") - 1
        lo = np.maximum(lo, self.first[s])
        hi = np.minimum(hi, np.append(self.first[1:] - 1, len(self.residuals) - 1)[s])
        reach = np.ceil(ERROR / np.maximum(self.slope[s], 1)).astype(np.int64) + 1
        guess = self.first[s] + np.floor((offsets - self.base[s]) / np.maximum(self.slope[s], 1e-9)).astype(np.int64)
        lo, hi = np.clip(guess - reach, lo, hi), np.clip(guess + reach, lo, hi)
        while (lo < hi).any():
            middle = (lo + hi) // 2
            low = self.offsets(middle) < offsets
            lo, hi = np.where(low, middle + 1, lo), np.where(low, hi, middle)
        return lo


def _slices(raws):
    """Runs of whole texts of about SLICE_BYTES."""
    run, held = [], 0
    for raw in raws:
        if run and held + len(raw) > SLICE_BYTES:
            yield run
            run, held = [], 0
        run.append(raw)
        held += len(raw)
    if run:
        yield run


def cut_texts(raws: list[bytes], keys: list[str]) -> list[tuple]:
    """(output, n, form, prefix_chars, middle_chars) of each text: all texts share one rank index."""
    ends = np.cumsum([len(r) for r in raws])
    index = RankIndex(b"".join(raws))
    upto = index.ranks(ends)
    n = np.diff(upto, prepend=0)
    digests = (hashlib.sha256(b"1:" + k.encode()).hexdigest() for k in keys)
    h = np.array([[int(d[i : i + 8], 16) for i in (0, 8, 16, 24)] for d in digests], np.int64)
    ks = np.sort(h[:, :2] % (n + 1)[:, None], 1)
    cuts = index.offsets((upto - n)[:, None] + ks) - (ends - [len(r) for r in raws])[:, None]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for raw, units, (_, _, plain, order), (k1, k2), (c1, c2) in zip(raws, n.tolist(), h.tolist(), ks.tolist(), cuts.tolist()):
        if not raw or plain % 100 >= PLAIN_FROM or p in raw or s in raw or m in raw:
            out.append((raw, units, "plain", None, None))
        elif order % 100 < SPM_BELOW:
            out.append((b"".join((s, raw[c2:], p, raw[:c1], m, raw[c1:c2])), units, "spm", k1, k2 - k1))
        else:
            out.append((b"".join((p, raw[:c1], s, raw[c2:], m, raw[c1:c2])), units, "psm", k1, k2 - k1))
    return out


def transformed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with `text` rearranged, and n (code points), form (plain, psm, spm), prefix_chars and middle_chars.

    Where a text is cut follows from its key alone. A null text is empty, and an empty one plain; a null key counts as no digits.
    Texts that hold a sentinel stay plain. prefix_chars and middle_chars are null for plain texts. Repeated rows and
    null keys keep their rows. Other columns pass through; those with the names of the new ones (in any case) are replaced.
    """
    ship(docs.sparkSession)
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]
    given = [c for c in docs.columns if c.lower() not in {f.name for f in fields}]
    plain = [F.col(f"`{c}`") for c in given if c != text]
    rows = docs.select(*plain, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__raw"))
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    kept, own = len(plain), [f"__made_{k}" for k in range(5)]
    names = [c for c in given if c != text] + own

    def run(batches):
        for batch in batches:
            keys, done = batch.column(kept).to_pylist(), 0
            for raws in _slices(x.as_py() for x in batch.column(kept + 1)):
                made = list(zip(*cut_texts(raws, keys[done : done + len(raws)])))
                arrays = [pa.array(x, kind) for x, kind in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays([*batch.slice(done, len(raws)).columns[:kept], *arrays], names=names)
                done += len(raws)

    types = [docs.schema[c] for c in given if c != text] + [T.StructField(n, t) for n, t in zip(own, [T.BinaryType(), *(f.dataType for f in fields)])]
    made = rows.mapInArrow(run, T.StructType(types))
    back = [F.col("__made_0").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in given]
    return made.select(*back, *[F.col(n).alias(f.name) for n, f in zip(own[1:], fields)])


def restored(output: Column, form: Column) -> Column:
    """The text that transformed() rearranged: no part holds a sentinel, so each sentinel marks its place."""
    after = lambda x, mark: F.substring_index(x, mark, -1)
    upto = lambda x, mark: F.substring_index(x, mark, 1)
    head = lambda x: F.substring(x, len(PREFIX) + 1, (1 << 31) - 1)
    middle = after(output, MIDDLE)
    psm = F.concat(head(upto(output, SUFFIX)), middle, upto(after(output, SUFFIX), MIDDLE))
    spm = F.concat(upto(after(output, PREFIX), MIDDLE), middle, head(upto(output, PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
