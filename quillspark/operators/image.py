"""Image functions in numpy over rows of pixels: no decoder library is needed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.augment import Config


def sample(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """img at the given places, between pixels in proportion, beyond the edge as at the edge."""
    h, w = img.shape[:2]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    a, b = np.floor(y).astype(int), np.floor(x).astype(int)
    c, d = np.minimum(a + 1, h - 1), np.minimum(b + 1, w - 1)
    p, q = (y - a)[..., None], (x - b)[..., None]
    return img[a, b] * (1 - p) * (1 - q) + img[c, b] * p * (1 - q) + img[a, d] * (1 - p) * q + img[c, d] * p * q


def resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    y, x = np.meshgrid((np.arange(h) + 0.5) * img.shape[0] / h - 0.5, (np.arange(w) + 0.5) * img.shape[1] / w - 0.5, indexing="ij")
    return sample(img, y, x)


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian in two passes; beyond the edge is 0."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        a = np.apply_along_axis(lambda v: np.convolve(v, k)[r : r + len(v)], axis, a)
    return a


def elastic(img: np.ndarray, r: np.random.Generator, alpha: float, sigma: float) -> np.ndarray:
    shape = img.shape[:2]
    dy, dx = (blur(r.uniform(-1, 1, shape), sigma) * alpha for _ in range(2))
    y, x = np.meshgrid(np.arange(shape[0]), np.arange(shape[1]), indexing="ij")
    return sample(img, y + dy, x + dx)


def augment(img: np.ndarray, r: np.random.Generator, c: Config = Config()) -> np.ndarray:
    """Seven steps, each by chance: shift, turn, brightness, contrast, noise, zoom, elastic. Values stay in [0, 1]."""
    h, w = img.shape[:2]
    y, x = np.meshgrid(np.arange(h, dtype=float), np.arange(w, dtype=float), indexing="ij")
    if r.random() < 0.7:
        img = sample(img, y - r.uniform(-1, 1) * c.translation_range * h, x - r.uniform(-1, 1) * c.translation_range * w)
    if r.random() < 0.7:
        t = np.deg2rad(r.uniform(-1, 1) * c.rotation_range)
        u, v = y - (h - 1) / 2, x - (w - 1) / 2
        img = sample(img, u * np.cos(t) - v * np.sin(t) + (h - 1) / 2, u * np.sin(t) + v * np.cos(t) + (w - 1) / 2)
    if r.random() < 0.7:
        img = np.clip(img * r.uniform(1 - c.brightness_range, 1 + c.brightness_range), 0, 1)
    if r.random() < 0.6:
        mean = img.mean((0, 1), keepdims=True)
        img = np.clip((img - mean) * r.uniform(1 - c.contrast_range, 1 + c.contrast_range) + mean, 0, 1)
    if r.random() < 0.5:
        img = np.clip(img + r.normal(0, c.noise_level, img.shape), 0, 1)
    if r.random() < 0.6:
        z = r.uniform(1 - c.zoom_range, 1 + c.zoom_range)
        u, v = (y - (h - 1) / 2) / z + (h - 1) / 2, (x - (w - 1) / 2) / z + (w - 1) / 2
        inside = (u > -0.5) & (u < h - 0.5) & (v > -0.5) & (v < w - 0.5)  # a smaller image is framed in black
        img = sample(img, u, v) * inside[..., None]
    if c.use_elastic_deform and r.random() < 0.5:
        img = elastic(img, r, c.elastic_deform_alpha, c.elastic_deform_sigma)
    return img


def augmented(df: DataFrame, key: str, pixels: str, shape: tuple[int, int, int], n: int, config: Config = Config()) -> DataFrame:
    """(key, aug_no, pixels, mean_diff, max_diff): n variants of each image; the draws depend on the key and the number alone."""
    rows = df.select(F.col(key).alias("k"), F.col(pixels).alias("p"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("aug_no")).withColumn("seed", F.xxhash64(F.lit(config.random_seed), "k", "aug_no"))

    def run(frames):
        for f in frames:
            out = []
            for p, seed in zip(f["p"], f["seed"]):
                img = np.asarray(p, np.float64).reshape(shape)
                new = augment(img, np.random.default_rng(int(seed) & (2**63 - 1)), config)
                gap = np.abs(new - img)
                out.append((new.ravel().astype(np.float32).tolist(), float(gap.mean()), float(gap.max())))
            yield pd.DataFrame({"k": f["k"], "aug_no": f["aug_no"], "pixels": [x[0] for x in out], "mean_diff": [x[1] for x in out], "max_diff": [x[2] for x in out]})

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"k {kind}, aug_no int, pixels array<float>, mean_diff double, max_diff double").withColumnRenamed("k", key)


def stats(df: DataFrame, pixels: str) -> DataFrame:
    """(n_values, n_images, low, high, non_zero_pct) of images by their number of values."""
    p = F.col(pixels)
    per = df.select(F.size(p).alias("n_values"), F.array_min(p).alias("lo"), F.array_max(p).alias("hi"), F.size(F.filter(p, lambda x: x != 0)).alias("nz"))
    return per.groupBy("n_values").agg(F.count("*").alias("n_images"), F.min("lo").alias("low"), F.max("hi").alias("high"), F.round(100 * F.sum("nz") / F.sum("n_values"), 6).alias("non_zero_pct"))
