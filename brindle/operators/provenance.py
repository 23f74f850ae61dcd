"""Fusion of provenance signals, label and media parsing."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.scalars import camel_to_words, score_level
from brindle.operators.relational import entity_provider

#: Markers of labelled media, in the order they are looked for (fixed values).
MARKERS = ("jumb", "C2PA", "TC260:AIGC", "<TC260")
#: Weights of signals (fixed values).
STRONG, MEDIUM, LOW, IRONCLAD = 40.0, 20.0, 10.0, 100.0
SOFTWARE = ("gpt", "dall", "midjourney", "stable", "firefly", "imagen")
#: The luminance and chrominance tables that most encoders scale (fixed values).
LUMINANCE = (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99)
CHROMINANCE = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, *[99] * 38)


def marker_scan(content: Column) -> Column:
    """(marker, slice): the first of MARKERS in bytes and what lies from 64 before to 4096 after it, as Latin-1."""
    s = F.decode(content, "ISO-8859-1")
    marker = F.coalesce(*(F.when(F.locate(m, s) > 0, m) for m in MARKERS))
    at = F.coalesce(*(F.when(F.locate(m, s) > 0, F.locate(m, s)) for m in MARKERS))
    start = F.greatest(at - 64, F.lit(1))
    return F.struct(marker.alias("marker"), F.substr(s, start, at + 4096 - start).alias("slice"))


def c2pa_strings(text: Column) -> Column:
    """(vendor, software, version, source) from the distinct printable runs of more than four characters, each the first that tells: vendor and software are the runs that name one, a version is short, starts with a digit and has a dot, source is the last part of a source type's address, in words."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit("[ -~]{5,}"), F.lit(0)))
    first = lambda test: F.get(F.filter(runs, test), F.lit(0))
    source = first(lambda r: r.contains("digitalsourcetype/"))
    return F.struct(
        first(lambda r: F.lower(r).contains("openai")).alias("vendor"),
        first(lambda r: F.lower(r).rlike("|".join(SOFTWARE))).alias("software"),
        first(lambda r: (F.length(r) <= 10) & r.rlike(r"^[0-9].*\.")).alias("version"),
        camel_to_words(F.nullif(F.substring_index(source, "/", -1), F.lit(""))).alias("source"),
    )


def infer_synthid(vendor: Column, software: Column, source: Column) -> Column:
    """(present, likely, source), or null where nothing tells."""
    v, w, s = (F.lower(F.coalesce(c, F.lit(""))) for c in (vendor, software, source))
    known = v.contains("google") | w.rlike("imagen|gemini|goo_") | v.contains("openai") | w.rlike("dall|gpt-image")
    flagged = s.contains("ai generated") | s.contains("algorithmic")
    made = lambda p, c: F.struct(F.lit(p).alias("present"), F.lit(True).alias("likely"), c.alias("source"))
    return F.when(known, made(True, vendor)).when(flagged, made(False, source))


def parse_tc260(text: Column) -> Column:
    """The fields of a label as a map: HTML escapes and an outer string undone, a nested AIGC object taken if there is one."""
    t = F.trim(text)
    for a, b in (("&quot;", '"'), ("&#34;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.when(t.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), t, F.lit("}")), "$.x")).otherwise(t)
    inner = F.get_json_object(t, "$.AIGC")
    return F.from_json(F.coalesce(inner, t), "map<string,string>")


def label_provider(df: DataFrame, fields: str, codes: DataFrame) -> DataFrame:
    """df with provider: that of the label's (a map of fields) producer among codes (entity, provider), else that of its propagator."""
    own = df.withColumns({"_producer": F.col(fields)["ContentProducer"], "_propagator": F.col(fields)["ContentPropagator"]})
    first = entity_provider(own, codes, "_producer").withColumnRenamed("provider", "_first")
    both = entity_provider(first, codes, "_propagator")
    return both.withColumn("provider", F.coalesce("_first", "provider")).drop("_producer", "_propagator", "_first")


def fused_signals(present: dict[str, Column]) -> Column:
    """(rate, level, signals) from flags c2pa_source, c2pa_vendor, tc260, tc260_provider, watermark, synthid, synthid_likely, camera and scores model, llm, fft, noise, jpeg (null or negative: absent).

    A signed AI source, a label or a visible mark saturate; otherwise the weighted mean.
    """
    p = lambda k: present.get(k, F.lit(None))
    yes = lambda k: F.coalesce(p(k).cast("boolean"), F.lit(False))
    sig = lambda name, score, weight: F.struct(F.lit(name).alias("name"), score.cast("double").alias("score"), F.lit(weight).alias("weight"))
    c2pa = F.coalesce(p("c2pa_source") == "AI Generated", F.lit(False))
    strong = F.when(c2pa, F.array(sig("C2PA Content Credentials", F.lit(1.0), IRONCLAD))).when(yes("tc260"), F.array(sig("TC260 AIGC Label", F.lit(1.0), IRONCLAD))).when(yes("watermark"), F.array(sig("Visible AI Watermark", F.lit(1.0), IRONCLAD)))
    scored = lambda name, k, w: F.when(p(k).cast("double") >= 0, sig(name, p(k), w))
    weak = F.array(
        F.when(yes("synthid"), sig("SynthID Watermark", F.when(yes("synthid_likely"), 0.85).otherwise(0.8), STRONG)),
        F.when(yes("camera"), sig("Camera EXIF", F.lit(0.1), STRONG)).otherwise(sig("No Camera EXIF", F.lit(0.55), LOW)),
        scored("AI Model", "model", MEDIUM),
        scored("LLM Assessment", "llm", MEDIUM),
        scored("FFT Spectral", "fft", LOW),
        scored("Noise Residual", "noise", LOW),
        scored("JPEG Analysis", "jpeg", MEDIUM),
    )
    weak = F.filter(weak, lambda s: s.isNotNull())
    total = F.aggregate(weak, F.lit(0.0), lambda a, s: a + s["weight"])
    mean = F.aggregate(weak, F.lit(0.0), lambda a, s: a + s["score"] * s["weight"]) / total
    rate = F.when(strong.isNotNull(), 0.99).otherwise(mean)
    return F.struct(rate.alias("rate"), F.when(strong.isNotNull(), 4).otherwise(score_level(mean)).alias("level"), F.coalesce(strong, weak).alias("signals"))


def signal_breakdown(signals: Column) -> Column:
    return F.array_join(F.transform(signals, lambda s: F.concat(s["name"], F.lit("="), F.format_string("%.0f", s["score"] * 100), F.lit("%"))), "; ")


def png_text(content: bytes) -> dict[str, str]:
    """Text chunks of a PNG."""
    out: dict[str, str] = {}
    at = 8
    while content[:4] == b"\x89PNG" and at + 8 <= len(content):
        n, kind = struct.unpack_from(">I4s", content, at)
        data = content[at + 8 : at + 8 + n]
        key, _, rest = data.partition(b"\0")
        try:
            if kind == b"tEXt":
                out[key.decode("latin-1")] = rest.decode("latin-1")
            elif kind == b"zTXt":
                out[key.decode("latin-1")] = zlib.decompress(rest[1:]).decode("latin-1")
            elif kind == b"iTXt":
                packed, (_, _, text) = rest[:1] == b"\1", rest[2:].split(b"\0", 2)
                out[key.decode("latin-1")] = (zlib.decompress(text) if packed else text).decode()
            elif kind in (b"AIGC", b"caBX"):
                out[kind.decode()] = data.decode("latin-1")
        except (ValueError, zlib.error):
            pass
        at += n + 12
    return out


def usual_table(values: bytes, wide: bool) -> bool:
    """Whether 48 of 64 entries are near one of the usual tables; never for 16-bit tables."""
    near = lambda usual: sum(abs(a - b) <= max(2, b // 8) for a, b in zip(values, usual, strict=False))
    return not wide and max(near(LUMINANCE), near(CHROMINANCE)) >= 48


def jpeg_quant_score(content: bytes) -> float:
    """-1 no JPEG, .4 no segment of tables, .65 an unusual table in the first two segments, .25 more than two segments, else .45."""
    if content[:2] != b"\xff\xd8":
        return -1.0
    segments, unusual, at = 0, False, 2
    while 0 <= (at := content.find(b"\xff", at)) < len(content) - 1:
        kind = content[at + 1]
        at += 2
        if kind in (0xDA, 0xD9):
            break
        if 0xD0 <= kind <= 0xD7:
            continue
        size = int.from_bytes(content[at : at + 2], "big") - 2
        at += 2
        if at > len(content) or (size > 0 and at + size > len(content)):
            break
        if size <= 0:
            continue
        if kind == 0xDB:
            segments += 1
            tables = [content[k : k + 65] for k in range(at, at + size - 64, 65)]
            unusual |= segments <= 2 and any(not usual_table(t[1:], t[0] >> 4 == 1) for t in tables)
        at += size
    return 0.4 if not segments else 0.65 if unusual else 0.25 if segments > 2 else 0.45


def _gray(pixels, least: int, most: int) -> np.ndarray | None:
    """Shares of full white from rows of 0 to 255, by nearest pixels to at most `most` a side; None if a side is under `least`."""
    x = np.array([list(r) for r in pixels], dtype=float)
    if x.ndim != 2 or min(x.shape) < least:
        return None
    h, w = x.shape
    if max(h, w) > most:
        scale = most / w
        if h * scale > most:
            scale = most / h
        w, h = max(int(x.shape[1] * scale), least), max(int(x.shape[0] * scale), least)
    rows, cols = np.arange(h) * x.shape[0] // h, np.arange(w) * x.shape[1] // w
    return x[np.ix_(rows, cols)] / 255


def radial_bins(power: np.ndarray) -> np.ndarray:
    """Mean of log power by whole distance from the middle, up to half the shorter side."""
    h, w = power.shape
    n = min(h // 2, w // 2)
    y, x = np.indices(power.shape)
    r = np.sqrt((x - w // 2) ** 2 + (y - h // 2) ** 2).astype(int)
    inside = r < n
    total = np.bincount(r[inside], np.log(1e-10 + power[inside]), n)
    return total / np.maximum(np.bincount(r[inside], minlength=n), 1)


def profile_features(profile: np.ndarray) -> tuple[float, float]:
    """(slope, high): the slope of the log profile over log distance from the fourth bin on (-2 from fewer than three positive bins), and the part of the last 30 % of the bins."""
    cut = len(profile) * 7 // 10
    high, low = profile[cut:].sum(), profile[:cut].sum()
    r = np.arange(3, len(profile))
    r = r[profile[3:] > 0]
    slope = -2.0
    if len(r) > 2:
        a, b = np.log(r), np.log(profile[r])
        slope = (len(r) * (a * b).sum() - a.sum() * b.sum()) / (len(r) * (a * a).sum() - a.sum() ** 2 + 1e-10)
    return float(slope), float(high / (high + low + 1e-10))


def fft_features(pixels) -> tuple[float, float, float]:
    """(score, slope, high) of the power spectrum's radial profile; score -1 under 64 samples a side. A steep slope and little in the high bins look natural (constants are fixed values)."""
    x = _gray(pixels, 64, 512)
    if x is None:
        return -1.0, 0.0, 0.0
    hann = lambda n: 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    x = (x - 0.5) * np.outer(hann(x.shape[0]), hann(x.shape[1]))
    h, w = x.shape
    spectrum = np.fft.fft2(x)[np.ix_((np.arange(h) + h // 2) % h, (np.arange(w) + w // 2) % w)]
    slope, high = profile_features(radial_bins(np.abs(spectrum) ** 2))
    score = 0.6 * np.clip(0.5 - (slope + 2) * 0.3, 0, 1) + 0.4 * np.clip((high - 0.15) / 0.35, 0, 1)
    return float(np.clip(score, 0, 1)), slope, high


#: The published high-pass kernel (fixed values).
KERNEL = np.array([[-1, 2, -2, 2, -1], [2, -6, 8, -6, 2], [-2, 8, -12, 8, -2], [2, -6, 8, -6, 2], [-1, 2, -2, 2, -1]]) / 12.0


def noise_moments(pixels) -> tuple[float, float]:
    """(std, excess kurtosis) of the residual of a high-pass filter; std -1 under 16 samples a side."""
    x = _gray(pixels, 16, 1024)
    if x is None:
        return -1.0, 0.0
    r = sum(KERNEL[i, j] * x[i : x.shape[0] - 4 + i, j : x.shape[1] - 4 + j] for i in range(5) for j in range(5))
    d = r - r.mean()
    variance = (d * d).mean()
    return float(np.sqrt(variance)), float((d**4).mean() / (variance * variance + 1e-10) - 3)


def score_pixels(df: DataFrame, key: str = "id", pixels: str = "pixels") -> DataFrame:
    """(key, fft, slope, high, noise_std, noise_kurtosis, error): a row that fails carries its error and fails nothing else."""

    def run(frames):
        for f in frames:
            rows = []
            for k, p in zip(f[key], f[pixels], strict=True):
                try:
                    rows.append((k, *fft_features(p), *noise_moments(p), None))
                except (ValueError, TypeError) as e:
                    rows.append((k, -1.0, 0.0, 0.0, -1.0, 0.0, str(e)))
            yield pd.DataFrame(rows, columns=[key, "fft", "slope", "high", "noise_std", "noise_kurtosis", "error"])

    return df.select(key, pixels).mapInPandas(run, f"{key} long, fft double, slope double, high double, noise_std double, noise_kurtosis double, error string")


def noise_band(std: Column, kurtosis: Column) -> Column:
    """Mean of the scores of both moments (bands are fixed values): too smooth, too noisy and heavy-tailed or too even residuals look made; -1 without a residual."""
    s = F.when(std < 0.015, 0.7).when(std < 0.03, 0.55).when(std > 0.12, 0.6).when(std > 0.08, 0.4).otherwise(0.2)
    k = F.when(kurtosis > 10, 0.8).when((kurtosis > 5) | (kurtosis < -1), 0.6).otherwise(0.3)
    return F.when(std < 0, -1.0).otherwise(s * 0.5 + k * 0.5)


def png_text_chunks(content) -> Column:
    """The text chunks of PNG bytes as a map."""

    @F.pandas_udf("map<string,string>")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: png_text(bytes(c or b"")))

    return run(content)


def jpeg_scores(content) -> Column:
    @F.pandas_udf("double")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: jpeg_quant_score(bytes(c or b"")))

    return run(content)


def score_items(items: DataFrame) -> DataFrame:
    """(id, rate, level, signals, error) of media items (id, content, and pixels if there are decoded ones): labels and markers in the bytes, text chunks, tables, spectrum and noise fused; an item that can't be read carries its error and fails nothing else."""

    def read(c) -> tuple[str | None, float | None, str | None]:
        if not c:
            return None, None, "no content"
        try:
            return png_text(c).get("AIGC"), jpeg_quant_score(c), None
        except (ValueError, TypeError, IndexError, struct.error) as e:
            return None, None, f"{type(e).__name__}: {e}"

    def looked_at(p) -> tuple[float, float, float]:
        try:
            return (-1.0, -1.0, 0.0) if p is None else (fft_features(p)[0], *noise_moments(p))
        except (ValueError, TypeError):
            return -1.0, -1.0, 0.0

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(i, *read(c), *looked_at(p)) for i, c, p in zip(f["id"], f["content"], f["pixels"], strict=True)], columns=["id", "label", "jpeg", "error", "fft", "std", "kurtosis"])

    pixels = F.col("pixels") if "pixels" in items.columns else F.lit(None).cast("array<array<double>>").alias("pixels")
    marked = c2pa_strings(marker_scan(F.col("content"))["slice"])["source"]
    source = F.when(F.lower(marked).contains("algorithmic"), "AI Generated")
    read_items = items.select("id", "content", pixels).mapInPandas(run, "id long, label string, jpeg double, error string, fft double, std double, kurtosis double")
    both = read_items.join(items.select("id", source.alias("source")), "id")
    f = fused_signals({"c2pa_source": F.col("source"), "tc260": F.col("label").isNotNull(), "fft": F.col("fft"), "noise": noise_band(F.col("std"), F.col("kurtosis")), "jpeg": F.col("jpeg")})
    return both.select("id", F.when(F.col("error").isNull(), f).alias("f"), "error").select("id", "f.rate", "f.level", "f.signals", "error")
