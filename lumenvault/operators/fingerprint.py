"""Perceptual fingerprints from pixel and frame tables."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship, small, written

#: Pixels of an image at most; larger ones are rejected.
MOST_PIXELS = 100_000_000


def gray(red, green, blue):
    """Integer luma of 0..255 channels."""
    return (77 * red.astype(np.int64) + 150 * green.astype(np.int64) + 29 * blue.astype(np.int64) + 128) >> 8


def resized(image: np.ndarray, size: int) -> np.ndarray:
    """Bilinear resampling to size x size with pixel centres at halves and clamped borders."""

    def axis(n: int):
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(image.shape[0])
    x0, x1, fx = axis(image.shape[1])
    rows = image[:, x0] * (1 - fx) + image[:, x1] * fx
    return rows[y0] * (1 - fy)[:, None] + rows[y1] * fy[:, None]


@lru_cache(4)
def cosines(size: int, kept: int) -> np.ndarray:
    """The first rows of the orthonormal DCT-II matrix."""
    k, x = np.arange(kept)[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * size)) * np.where(k == 0, np.sqrt(1 / size), np.sqrt(2 / size))


def frequency_bits(image: np.ndarray, size: int, kept: int) -> np.ndarray:
    """Whether each low frequency but the first exceeds their median."""
    m = cosines(size, kept)
    values = (m @ resized(image.astype(np.float64), size) @ m.T).ravel()[1:]
    return values > np.sort(values)[len(values) // 2]


def _packed(bits: np.ndarray) -> list[int]:
    padded = np.zeros(-(-len(bits) // 64) * 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view("<i8").tolist()


def phash(image: np.ndarray) -> int:
    return _packed(frequency_bits(image, 32, 8))[0]


def hash256(image: np.ndarray) -> list[int]:
    return _packed(frequency_bits(image, 64, 16))


def crop_hashes(image: np.ndarray) -> list[int]:
    """Hashes of centre crops of 0.90, 0.75, 0.60 and corner crops of 0.78 of the sides."""
    h, w = image.shape
    side = lambda n, r: min(n, max(1, int(n * r)))
    out = []
    for r in (0.90, 0.75, 0.60):
        ch, cw = side(h, r), side(w, r)
        y, x = (h - ch) // 2, (w - cw) // 2
        out.append(phash(image[y : y + ch, x : x + cw]))
    ch, cw = side(h, 0.78), side(w, 0.78)
    for y, x in ((0, 0), (0, w - cw), (h - ch, 0), (h - ch, w - cw)):
        out.append(phash(image[y : y + ch, x : x + cw]))
    return out


def fingerprint_stills(images: DataFrame) -> DataFrame:
    """(key, phash, hash256, crop_hashes) of gray images (key, width, height, pixels binary); too large ones are left out."""

    def work(batches):
        for pdf in batches:
            rows = []
            for key, w, h, data in zip(pdf.key, pdf.width, pdf.height, pdf.pixels):
                image = np.frombuffer(data, np.uint8).reshape(h, w)
                rows.append((key, phash(image), hash256(image), crop_hashes(image)))
            yield pd.DataFrame(rows, columns=["key", "phash", "hash256", "crop_hashes"])

    ship(images.sparkSession)
    return images.where(F.col("width").cast("bigint") * F.col("height") <= MOST_PIXELS).select("key", "width", "height", "pixels").mapInPandas(work, "key string, phash long, hash256 array<long>, crop_hashes array<long>")


def gray_of_image_source(images: DataFrame) -> DataFrame:
    """(key, width, height, pixels) from rows of Spark's image source, whose bytes are blue, green, red."""

    def work(batches):
        for pdf in batches:
            out = []
            for w, h, n, data in zip(pdf.width, pdf.height, pdf.nChannels, pdf.data):
                c = np.frombuffer(data, np.uint8).reshape(h, w, n)
                g = c[:, :, 0] if n == 1 else gray(c[:, :, 2], c[:, :, 1], c[:, :, 0])
                out.append(g.astype(np.uint8).tobytes())
            yield pd.DataFrame({"key": pdf.origin, "width": pdf.width, "height": pdf.height, "pixels": out})

    ship(images.sparkSession)
    return images.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").mapInPandas(work, "key string, width int, height int, pixels binary")


def sampled_frames_gif(frames: DataFrame, most: int = 32) -> DataFrame:
    """Chosen (key, sample, frame_index): evenly timed samples, each the frame shown then, stepped on if it repeats.

    frames: (key, frame_index, start_ns, duration_ns); without durations samples are even by index.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index")
        starts, total, n = pdf.start_ns.to_numpy(), int(pdf.duration_ns.sum()), len(pdf)
        wanted, last, rows = min(most, n), -1, []
        for k in range(wanted):
            at = max(0, int(np.searchsorted(starts, total * k // wanted, "right")) - 1) if total > 0 else k * n // wanted
            at = min(at, n - 1)
            if at == last and at + 1 < n:
                at += 1
            rows.append((pdf.key.iloc[0], k, int(pdf.frame_index.iloc[at])))
            last = at
        return pd.DataFrame(rows, columns=["key", "sample", "frame_index"])

    ship(frames.sparkSession)
    return frames.groupBy("key").applyInPandas(choose, "key string, sample int, frame_index long")


def sampled_frames_video(frames: DataFrame, most: int = 48) -> DataFrame:
    """Chosen (key, sample, frame_index): a frame is taken once its time reaches the next target, one sample a frame."""
    ordered = frames.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("frame_index", "timestamp_ns"))).alias("fs"), F.max("total_ns").alias("total"))
    step = lambda z, f: F.when((F.size(z) < most) & (F.greatest(f["timestamp_ns"], F.lit(0)) >= F.floor(F.col("total") * F.size(z) / most)), F.concat(z, F.array(f["frame_index"]))).otherwise(z)
    return ordered.select("key", F.posexplode(F.aggregate("fs", F.array().cast("array<bigint>"), step)).alias("sample", "frame_index"))


def majority(frames: DataFrame, key: str = "key", h: str = "h", bits: int = 64) -> DataFrame:
    """(key, majority): each bit set in at least half of a key's hashes, by partial sums of bits."""
    sums = [F.sum(F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(bits)]
    counted = frames.groupBy(key).agg(F.count("*").alias("n"), *sums)
    out = F.lit(0).cast("bigint")
    for b in range(bits):
        out = out.bitwiseOR(F.when(2 * F.col(f"b{b}") >= F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return counted.select(key, out.alias("majority"))


def majority_wide(frames: DataFrame, key: str = "key", h: str = "h256") -> DataFrame:
    """(key, majority256): as majority(), word by word, for hashes of several 64-bit words."""
    words = frames.select(key, F.posexplode(h).alias("word", "h"))
    each = majority(words.select(F.struct(key, "word").alias("kw"), "h"), "kw")
    return each.groupBy(F.col(f"kw.{key}").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("kw.word", "majority"))), lambda x: x["majority"]).alias("majority256"))


def timelines(frames: DataFrame) -> DataFrame:
    """(key, timeline, majority, majority256, crop_hashes): hashes in frame order, their majorities, the crops of the first frame."""
    lines = frames.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "h"))), lambda x: x["h"]).alias("timeline"), F.min_by("crops", "frame_index").alias("crop_hashes"))
    return lines.join(majority(frames), "key").join(majority_wide(frames), "key").select("key", "timeline", "majority", "majority256", "crop_hashes")


def chosen_frames(frames: DataFrame) -> DataFrame:
    """(key, sample, frame_index) by the rules of the media's kind. frames: (key, frame_index, timestamp_ns, total_ns, duration_ns, way), metadata only; way: gif or video."""
    gif = sampled_frames_gif(frames.where("way = 'gif'").select("key", "frame_index", F.col("timestamp_ns").alias("start_ns"), "duration_ns"))
    return gif.unionByName(sampled_frames_video(frames.where("way = 'video'").select("key", "frame_index", "timestamp_ns", "total_ns")))


def moving_fingerprints(frames: DataFrame, pixels: DataFrame) -> DataFrame:
    """(key, timeline, majority, majority256, crop_hashes, samples) of moving media, from the pixels of their chosen frames.

    frames: metadata as for chosen_frames(). pixels: (key, frame_index, width, height, pixels), a table in folders by frame_index.
    Frames are chosen first; the table of choices, if small enough to be sent out, prunes the folders that are read, and only
    chosen frames are hashed. The crops are those of the first one. Media of which no chosen frame has pixels are left out.
    """

    def work(batches):
        for pdf in batches:
            rows = []
            for key, sample, w, h, data in zip(pdf["key"], pdf["sample"], pdf["width"], pdf["height"], pdf["pixels"]):
                image = np.frombuffer(data, np.uint8).reshape(h, w)
                rows.append((key, sample, phash(image), hash256(image), crop_hashes(image) if sample == 0 else []))
            yield pd.DataFrame(rows, columns=["key", "frame_index", "h", "h256", "crops"])

    ship(frames.sparkSession)
    chosen = small(written(chosen_frames(frames)).where("frame_index >= 0"))
    met = pixels.where(F.col("width").cast("bigint") * F.col("height") <= MOST_PIXELS).join(chosen, ["key", "frame_index"]).select("key", "sample", "width", "height", "pixels")
    hashed = written(met.mapInPandas(work, "key string, frame_index long, h long, h256 array<long>, crops array<long>"))
    return timelines(hashed).withColumn("samples", F.size("timeline"))


def dispatch(extension):
    """How media of an extension are fingerprinted: still, gif or video; null for others."""
    from ..functions.rules import CLIP, STILL

    e = F.lower(extension)
    return F.when(e.isin(*STILL), "still").when(e == "gif", "gif").when(e.isin(*CLIP), "video")
