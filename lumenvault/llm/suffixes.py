"""Removal of byte strings that occur more than once, by merging shard Burrows-Wheeler transforms.

A removed string has LENGTH bytes. Three steps find every such string that starts at two places:

1. Anchors. Of the hashes of all GRAM-byte strings inside a window of LENGTH bytes the least is the
   window's anchor. Equal windows have equal anchors at the same place, so windows are compared only
   within the places of one anchor. The windows of one anchor place form a region; regions that agree
   as a whole are one class, and a class of two places or more is repeated throughout.
2. Cores. A region is cut into groups of STEP window starts. All windows of a group contain its core
   of LENGTH - STEP + 1 bytes. Groups are compared only if anchor, group number and core agree; there
   the core is one symbol, and a window is STEP symbols: some bytes before it, the core, some bytes after.
3. Transforms. The strings (margin, core symbol, margin) are dealt by core. A task sorts the suffixes
   of each shard of strings, and merges the shards' Burrows-Wheeler transforms by refining their
   interleaving, one symbol of depth a round. After STEP rounds rows are ordered by their first STEP
   symbols, and neighbours that no round told apart share a prefix of STEP symbols: the repeated windows.

A core shared by more than HOT groups is not left to one task: its windows are listed and counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, ship, written
from .spans import KEYS, kept_digests, kept_text, keyed, unions

LENGTH, GRAM, STEP = 400, 64, 32
CORE = LENGTH - STEP + 1
HOT = 500
#: Strings whose suffixes are sorted together, and strings whose shards are merged together.
SHARD, BATCH = 256, 8192
#: Bytes of a text whose anchors are found at a time; positions inside take 24 bits.
BLOCK = 1 << 23
_MIX = (0x9E3779B97F4A7C15, 0x632BE59BD9B4E019, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    a, b, p, c = (np.array([x], np.uint64) for x in _MIX)
    h, m = data.astype(np.uint64) * a + b, 1
    while m < GRAM:
        h, p, m = h[:-m] * p + h[m:], p * p, 2 * m
    h ^= h >> np.uint64(29)
    h *= c
    return h ^ (h >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive numbers, by running minima over blocks."""
    y = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    down, up = np.minimum.accumulate(y, 1).ravel(), np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(up[: len(x) - width + 1], down[width - 1 : len(x)])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first start, last start) of the anchors of all windows of `raw`, by start.

    A run of starts that a block border cuts in two is joined again, so results do not depend on blocks.
    """
    data, width = np.frombuffer(raw, np.uint8), LENGTH - GRAM + 1
    parts = []
    for at in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        h = gram_hashes(data[at : at + BLOCK + LENGTH - 1])
        low = np.uint64((1 << 24) - 1)
        place = (sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        parts.append((h[place[first]].view(np.int64), place[first] + at, first + at, np.concatenate((first[1:], [len(place)])) - 1 + at))
    if not parts:
        return (np.empty(0, np.int64),) * 4
    h, p, lo, hi = (np.concatenate(x) for x in zip(*parts))
    new = np.concatenate(([True], p[1:] != p[:-1]))
    return h[new], p[new], lo[new], hi[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(p) - 1]))]


def regions(raw: bytes) -> tuple[np.ndarray, ...]:
    """(h, c, lo, n, p, reps) of the anchor places of `raw`: the anchor's hash, a hash of its region, the first window start, the number of
    starts less 1, the anchor less lo, and how many equal regions follow one another from there on.

    In a stretch that repeats itself every few bytes each period has a region of its own, equal to the one before; such a run is one row.
    """
    from xxhash import xxh3_64_intdigest as digest

    h, place, lo, hi = anchors(raw)
    n, p = hi - lo, place - lo
    if not len(h):
        return h, h, lo, n, p, n
    like = np.concatenate(([False], (h[1:] == h[:-1]) & (n[1:] == n[:-1]) & (p[1:] == p[:-1]) & (lo[1:] == lo[:-1] + n[:-1] + 1)))
    first = np.flatnonzero(~like)
    reps = np.diff(np.append(first, len(h)))
    data = np.frombuffer(raw, np.uint8)
    for k in np.flatnonzero(reps > 1).tolist():
        step, s = int(n[first[k]]) + 1, int(lo[first[k]])
        e = s + (int(reps[k]) - 1) * step + step - 1 + LENGTH
        if (data[s : e - step] != data[s + step : e]).any():  # equal anchors of regions that differ
            like[first[k] : first[k] + reps[k]] = False
    first = np.flatnonzero(~like)
    reps = np.diff(np.append(first, len(h)))
    h, lo, n, p = h[first], lo[first], n[first], p[first]
    c = np.array([digest(raw[s : s + k + LENGTH]) for s, k in zip(lo.tolist(), n.tolist())], np.uint64).view(np.int64)
    return h, c, lo, n, p, reps


def _batches(columns: list[tuple[str, pa.DataType]], rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(rows, columns)], names=[n for n, _ in columns])


def places(rows: DataFrame) -> DataFrame:
    """(__k, __th, h, c, lo, n, p, reps): the regions() of each document."""
    ship(rows.sparkSession)
    names = ["__k", "__th", "h", "c", "lo", "n", "p", "reps"]

    def run(batches):
        from lumenvault.llm.suffixes import regions as of

        def handed_on(out):
            flat = [np.concatenate(x) for x in zip(*out)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], names=names)

        for batch in batches:
            out, held = [], 0
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                found = of(raw)
                if len(found[0]):
                    out.append((np.full(len(found[0]), a), np.full(len(found[0]), b), *found))
                held += len(raw)
                if out and held > SLICE_BYTES:
                    yield handed_on(out)
                    out, held = [], 0
            if out:
                yield handed_on(out)

    return rows.select(*KEYS, "__text").mapInArrow(run, "__k long, __th long, h long, c long, lo long, n long, p long, reps long")


def groups(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """(h, c, j, core, left, right): the groups of window starts of each region, cut from its document.

    regions: (__k, __th, regions array<struct<h, c, lo, n, p>>).
    """
    ship(rows.sparkSession)
    names = [("h", pa.int64()), ("c", pa.int64()), ("j", pa.int32()), ("core", pa.int64()), ("off", pa.int32()), ("left", pa.binary()), ("right", pa.binary())]

    def run(batches):
        from xxhash import xxh3_64_intdigest as digest

        def handed_on(out):
            out[3] = np.array(out[3], np.uint64).view(np.int64)
            return _batches(names, out)

        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text, own in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for x in own.as_py():
                    lo, hi, p = x["lo"], x["lo"] + x["n"], x["lo"] + x["p"]
                    # starts p - STEP * j - STEP + 1 .. p - STEP * j make group j
                    for j in range((p - hi) // STEP, (p - lo) // STEP + 1):
                        core = p - STEP * j
                        row = (x["h"], x["c"], j, digest(raw[core : core + CORE]), core - lo, raw[max(lo, core - STEP + 1) : core], raw[core + CORE : min(hi + LENGTH, core + LENGTH)])
                        for to, v in zip(out, row):
                            to.append(v)
                    if len(out[0]) >= BATCH:
                        yield handed_on(out)
                        out = [[] for _ in names]
            if out[0]:
                yield handed_on(out)

    return rows.join(regions, list(KEYS)).select("__text", "regions").mapInArrow(run, "h long, c long, j int, core long, off int, left binary, right binary")


# ------------------------------------------------------------ transforms


def shard_transform(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(transform, suffix array) of the strings, each followed by an end symbol 0, as one text of uint16 symbols.

    Suffixes are sorted by prefix doubling within their string; a symbol of the transform is the one before the suffix.
    """
    text = np.concatenate([np.append(s, 0) for s in strings]).astype(np.int64)
    ends = np.flatnonzero(text == 0)
    end_of = np.repeat(ends, np.diff(np.concatenate(([-1], ends))))
    rank, n, step = text.copy(), len(text), 1
    # ends differ, so no two suffixes tie
    rank[ends] = np.arange(len(ends)) - len(ends)
    while True:
        ahead = np.arange(n) + step
        second = np.where(ahead <= end_of, rank[np.minimum(ahead, n - 1)], -(1 << 40))
        order = np.lexsort((second, rank))
        new = np.concatenate(([False], (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    return text[order - 1].astype(np.uint16), order


def merge_transforms(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleaving, breaks): the shard of each row of the merged transform after `depth` rounds, and
    whether a row's first `depth` symbols differ from those of the row before.

    A round reads the shards' transforms in the order that the interleaving gives and deals the rows
    stably by symbol: rows ordered by d symbols become rows ordered by d + 1. No suffix is compared.
    """
    text = np.concatenate([t for t, _ in shards])
    of = np.repeat(np.arange(len(shards)), [len(t) for t, _ in shards]).astype(np.uint16)
    breaks = np.zeros(len(text), bool)
    breaks[:1] = True
    for _ in range(depth):
        symbols = np.empty_like(text)
        symbols[np.argsort(of, kind="stable")] = text
        block = np.cumsum(breaks)
        deal = np.argsort(symbols, kind="stable")
        dealt, block = symbols[deal], block[deal]
        breaks = np.concatenate(([True], (dealt[1:] != dealt[:-1]) | (block[1:] != block[:-1])))
        of = of[deal]
    return of, breaks


def repeated_windows(lefts: list[bytes], rights: list[bytes], cores: np.ndarray) -> list[list[int]]:
    """For each string (left, core, right): how many bytes before the core a window of STEP symbols with
    the core starts, for every such window that another string has too.

    cores: a symbol from 257 on for each string; only windows with the core are looked for.
    """
    texts = [np.concatenate((np.frombuffer(a, np.uint8).astype(np.uint16) + 1, [c], np.frombuffer(b, np.uint8).astype(np.uint16) + 1)).astype(np.uint16) for a, b, c in zip(lefts, rights, cores)]
    shards = [shard_transform(texts[at : at + SHARD]) for at in range(0, len(texts), SHARD)]
    of, breaks = merge_transforms(shards, STEP)
    lengths = np.array([len(t) + 1 for t in texts])
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    base = np.concatenate(([0], np.cumsum([len(t) for t, _ in shards])[:-1]))
    suffix = np.empty(len(of), np.int64)
    suffix[np.argsort(of, kind="stable")] = np.concatenate([order + b for (_, order), b in zip(shards, base)])
    string = np.searchsorted(begins, suffix, "right") - 1
    offset = suffix - begins[string]
    left = np.array([len(a) for a in lefts])
    usable = (offset <= left[string]) & (offset + STEP > left[string]) & (offset + STEP <= lengths[string] - 1)
    block = np.cumsum(breaks) - 1
    many = np.bincount(block[usable], minlength=int(block[-1]) + 1) > 1
    hit = usable & many[block]
    out: list[list[int]] = [[] for _ in texts]
    for s, r in zip(string[hit].tolist(), (left[string[hit]] - offset[hit]).tolist()):
        out[s].append(r)
    return out


def repeated_starts(found: DataFrame) -> DataFrame:
    """(h, c, s): starts, counted from the region's first, of windows that several regions have. found: from groups()."""
    ship(found.sparkSession)
    keys = ["h", "j", "core"]
    sizes = written(found.groupBy(*keys).count().where("count > 1"))
    met = found.join(sizes, keys)
    # a core's strings meet in one task, HOT of them at most
    calm = met.where(F.col("count") <= HOT).select("h", "c", "j", "core", "off", "left", "right").repartition(*keys)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * BATCH:
                rest, done = solve(pa.Table.from_batches(held), False)
                held = [*rest.to_batches()]
                yield from done
        if held:
            yield from solve(pa.Table.from_batches(held), True)[1]

    def solve(rows: pa.Table, last: bool):
        """Merges whole groups; rows arrive sorted by group, so the last group waits for the next batches."""
        from lumenvault.llm.suffixes import BATCH as most
        from lumenvault.llm.suffixes import repeated_windows as windows

        ids = np.stack([rows[n].to_numpy() for n in ("h", "j", "core")], 1)
        new = np.concatenate(([True], (ids[1:] != ids[:-1]).any(1)))
        starts = np.append(np.flatnonzero(new), len(ids))
        if not last:
            starts = starts[:-1]
        done, at = [], 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
            part = rows.slice(int(starts[at]), int(starts[to] - starts[at]))
            symbol = np.repeat(np.arange(to - at), np.diff(starts[at : to + 1])) + 257
            hits = windows(part["left"].to_pylist(), part["right"].to_pylist(), symbol)
            h, c, off = (part[n].to_pylist() for n in ("h", "c", "off"))
            flat = [(h[i], c[i], off[i] - r) for i, rs in enumerate(hits) for r in rs]
            done.append(pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], pa.int64()) for k in range(3)], names=["h", "c", "s"]))
            at = to
        return rows.slice(int(starts[-1])), done

    merged = calm.sortWithinPartitions(*keys).mapInArrow(run, "h long, c long, s long")
    hot = met.where(F.col("count") > HOT)
    tail = lambda r: F.expr("substring(left, length(left) - r + 1, r)")
    listed = hot.select("*", F.explode(F.sequence(F.lit(0), F.lit(STEP - 1))).alias("r")).where(f"r <= length(left) and {STEP - 1} - r <= length(right)")
    listed = listed.select("h", "c", "j", "core", "r", (F.col("off") - F.col("r")).cast("long").alias("s"), F.sha2(F.concat(tail("r"), F.lit(b"|"), F.expr(f"substring(right, 1, {STEP - 1} - r)")), 256).alias("d"))
    window = ["h", "j", "core", "r", "d"]
    twice = written(listed.groupBy(*window).agg(F.count("*").alias("n")).where("n > 1").select(*window))
    return merged.unionByName(listed.join(twice, window).select("h", "c", "s"))


def repeats(rows: DataFrame) -> DataFrame:
    """(__k, __th, spans): the bytes to remove from each document of keyed() rows, written to a table."""
    found = places(rows)
    first = [F.first(x).alias(x) for x in ("__k", "__th", "lo", "n", "p")]
    classes = written(found.groupBy("h", "c").agg(F.sum("reps").alias("many"), *first))
    several = written(classes.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("h"))
    unclear = classes.join(several, "h").groupBy(*KEYS).agg(F.collect_list(F.struct("h", "c", "lo", "n", "p")).alias("regions"))
    parts = written(groups(rows, written(unclear)))
    starts = repeated_starts(parts).groupBy("h", "c").agg(F.collect_set("s").alias("starts"))
    whole = classes.where("many > 1").select("h", "c", F.lit(None).cast("array<bigint>").alias("starts"))
    known = written(starts.join(whole.select("h", "c"), ["h", "c"], "left_anti").unionByName(whole))
    met = found.join(known, ["h", "c"])
    intervals = met.select(*KEYS, F.inline(F.when(F.col("starts").isNull(), F.array(F.struct(F.col("lo").alias("s"), (F.col("lo") + F.col("reps") * (F.col("n") + 1) - 1 + LENGTH).alias("e")))).otherwise(F.transform("starts", lambda s: F.struct((F.col("lo") + s).alias("s"), (F.col("lo") + s + LENGTH).alias("e"))))))
    return written(unions(intervals))


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets).

    Every byte covered by a string of LENGTH bytes that also starts elsewhere goes, all its places alike.
    A null text is empty; shorter texts lose nothing. Repeated rows are places of their own. Other
    columns play no part. An empty table gives an empty result.
    """
    rows = keyed(docs, key, text)
    return kept_digests(rows, repeats(rows), key).drop("spans")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text) of every row, less the repeated strings."""
    rows = keyed(docs, key, text)
    return kept_text(rows, repeats(rows), key)
