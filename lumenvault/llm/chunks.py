"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written
from .spans import KEYS, kept_digests, kept_text, keyed

#: A cut falls where MASK_BITS bits of the gear hash of the last WINDOW bytes are zero, MIN bytes or more after the last cut.
#: Of such places less than MIN bytes apart the least hash is taken, and where there is none within BACKUP bytes, the least
#: hash from MIN to BACKUP bytes after the last cut; so words that repeat are cut at the same places in any document.
WINDOW, MASK_BITS, MIN, BACKUP = 16, 4, 20, 64
#: What a passage is: repeated chunks count where they line up to a run of this many bytes, about 15 words.
#: Shorter runs are phrases that unlike documents share, not copied passages.
MIN_RUN = 80
BLOCK = 1 << 22


def gear() -> np.ndarray:
    """A 32-bit random number for each byte, from a fixed rule."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)


def cut_points(raw: bytes, table: np.ndarray) -> list[int]:
    """Ends of the chunks of `raw`, the last of which is its length."""
    data, ends, last = np.frombuffer(raw, np.uint8), [], 0
    mask, want = np.uint32(((1 << MASK_BITS) - 1) << (WINDOW - MASK_BITS)), np.uint32(0)
    known, places = np.empty(0, np.uint32), []  # hashes of the last bytes, from `base` on, and places whose followers are not known yet

    def backups(upto: int) -> None:
        """Cuts at least hashes as long as the next place, or the end of what is known, is beyond BACKUP."""
        nonlocal last
        while upto - last > BACKUP:
            near = known[last + MIN - 1 - base : last + BACKUP - base]
            last += MIN + int(near.argmin())
            ends.append(last)

    for at in range(0, len(data), BLOCK):
        begin = max(0, at - WINDOW + 1)
        h, m = table[data[begin : at + BLOCK]], 1
        while m < WINDOW:  # h of m bytes to h of 2m: h[i] = (h[i - m] << m) + h[i]
            h = np.concatenate((h[:m], (h[:-m] << np.uint32(m)) + h[m:]))
            m *= 2
        h, tail = h[at - begin :], known[-BACKUP - MIN :]
        base, known, top = at - len(tail), np.concatenate((tail, h)), at + len(h)
        places += (np.flatnonzero((h & mask) == want) + at + 1).tolist()
        done = len(places) if top == len(data) else bisect_right(places, top - MIN + 1)
        for i in range(done):
            x = places[i]
            backups(x)
            if x - last >= MIN:
                last, i = x, i + 1
                while i < len(places) and places[i] < x + MIN:
                    if known[places[i] - 1 - base] < known[last - 1 - base]:
                        last = places[i]
                    i += 1
                ends.append(last)
        places = places[done:]
        backups(places[0] if places else top)
    if last < len(raw):
        ends.append(len(raw))
    return ends


def chunks(rows: DataFrame) -> DataFrame:
    """(__k, __th, d1, d2, at, len): each distinct chunk of each document with its start offsets."""
    ship(rows.sparkSession)

    def run(batches):
        table, digest = gear(), hashlib.blake2b
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                piece = batch.slice(part, 512)
                k, th, d, starts, lengths = [], [], [], [], []
                for a, b, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2)):
                    raw, found, last = (text.as_py() or "").encode("utf-8", "surrogatepass"), {}, 0
                    for end in cut_points(raw, table):
                        found.setdefault(digest(raw[last:end], digest_size=16).digest(), []).append((last, end - last))
                        last = end
                    for x, at in found.items():
                        k.append(a), th.append(b), d.append(x), starts.append([s for s, _ in at]), lengths.append(at[0][1])
                both = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(th, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.int64())], names=["__k", "__th", "d1", "d2", "at", "len"])

    return rows.select(*KEYS, "__text").mapInArrow(run, "__k long, __th long, d1 long, d2 long, at array<long>, len long")


def repeats(rows: DataFrame) -> DataFrame:
    """(__k, __th, n_repeated, spans): bytes that repeat and what to remove of each document, written to a table.

    A chunk's first place is its first offset in the document of least (key, text hash); every
    other place is a repeat. Repeated chunks, first places included, are lined up; in runs of MIN_RUN
    bytes or more the repeats are removed.
    """
    found = chunks(rows)
    # the order of (key, text hash) decides which document is first; the least and greatest tell whether there are several
    ends = F.struct("__k", "__th")
    first = found.groupBy("d1", "d2").agg(F.min(ends).alias("a"), F.max(ends).alias("z"), F.max(F.size("at")).alias("n"))
    first = written(first.where("a < z or n > 1").select("d1", "d2", F.col("a.__k").alias("k0"), F.col("a.__th").alias("t0")))
    met = found.join(first, ["d1", "d2"])
    own = (F.col("__k") == F.col("k0")) & (F.col("__th") == F.col("t0"))
    places = F.transform("at", lambda s, i: F.struct(s.alias("s"), (s + F.col("len")).alias("e"), (~own | (i > 0)).alias("drop")))
    lined = met.groupBy(*KEYS).agg(F.array_sort(F.flatten(F.collect_set(places))).alias("p"))  # a set, as repeated rows bring the same places
    ship(rows.sparkSession)

    def run(batches):
        from lumenvault.llm.spans import merged

        for batch in batches:
            out, repeated = [], []
            for p in batch.column(2):
                flat = p.values if hasattr(p, "values") else p
                s, e, drop = (np.asarray(flat.field(n)) for n in ("s", "e", "drop"))
                first_ = np.concatenate(([True], s[1:] != e[:-1]))
                run_of = np.cumsum(first_) - 1
                size = np.bincount(run_of, e - s)
                repeated.append(int(size[size >= MIN_RUN].sum()))
                keep = (size[run_of] >= MIN_RUN) & drop.astype(bool)
                a, b = merged(s[keep], e[keep])
                out.append([{"s": x, "e": y} for x, y in zip(a.tolist(), b.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(repeated, pa.int64()), pa.array(out, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], names=["__k", "__th", "n_repeated", "spans"])

    return written(lined.mapInArrow(run, "__k long, __th long, n_repeated long, spans array<struct<s:bigint,e:bigint>>").where("n_repeated > 0"))


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_bytes, n_repeated, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets).

    n_repeated counts the first places too. A null text is empty. Rows that agree in key and text count as one document; a null key orders
    after all others, by its text. An empty table gives an empty result.
    """
    rows = keyed(docs, key, text)
    return kept_digests(rows, repeats(rows), key, "n_repeated")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text) of every row, less the repeated passages whose first place is elsewhere."""
    rows = keyed(docs, key, text)
    return kept_text(rows, repeats(rows), key)
