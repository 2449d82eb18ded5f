"""Media: image sizes and audio properties from headers, and thumbnails, in Arrow batches."""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of PNG, GIF, BMP, JPEG and WebP headers; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker in range(0xC0, 0xD0) and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None


def _wav(data: bytes) -> tuple[int, int, int] | None:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    with wave.open(io.BytesIO(data)) as w:
        rate = w.getframerate()
        return (w.getnframes() * 1000 // rate if rate else 0), rate, w.getnchannels()


def _flac(data: bytes) -> tuple[int, int, int] | None:
    """The stream block of a FLAC header: 20 bits of rate, 3 of channels less one, 5 of width, 36 of samples."""
    if data[:4] != b"fLaC" or data[4] & 0x7F or len(data) < 26:
        return None
    bits = int.from_bytes(data[18:26], "big")
    rate, channels, samples = bits >> 44, (bits >> 41 & 7) + 1, bits & (1 << 36) - 1
    return (samples * 1000 // rate if rate else 0), rate, channels


def _ogg(data: bytes) -> tuple[int, int, int] | None:
    """Vorbis or Opus in Ogg: the head names rate and channels, the last page's position the samples."""
    last = data.rfind(b"OggS")
    if data[:4] != b"OggS" or last + 14 > len(data):
        return None
    samples = struct.unpack("<q", data[last + 6 : last + 14])[0]
    at = data.find(b"\x01vorbis", 0, 200)
    if at >= 0:
        channels, rate = struct.unpack("<BI", data[at + 11 : at + 16])
        return (samples * 1000 // rate if rate else 0), rate, channels
    at = data.find(b"OpusHead", 0, 200)
    if at >= 0:
        channels, skip, rate = struct.unpack("<BHI", data[at + 9 : at + 16])
        return max(0, samples - skip) // 48, rate, channels
    return None


#: Bit rates (kbit/s) of MPEG-1 and MPEG-2 layer III by index, and rates of MPEG-1.
_MP3_RATES = {1: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], 2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
_MP3_HZ = [44_100, 48_000, 32_000]


def _mp3(data: bytes) -> tuple[int, int, int] | None:
    """The frames of layer III, counted by their headers; a tag in front is left out."""
    at, samples, first = 0, 0, None
    if data[:3] == b"ID3" and len(data) >= 10:
        at = 10 + sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(data[6:10]))
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] & 0xE6 == 0xE2:
        version, index, hz = data[at + 1] >> 3 & 3, data[at + 2] >> 4, data[at + 2] >> 2 & 3
        if version == 1 or index in (0, 15) or hz == 3:
            break
        rate = _MP3_HZ[hz] >> {3: 0, 2: 1, 0: 2}[version]
        frame = 1152 if version == 3 else 576
        first = first or (rate, 1 if data[at + 3] >> 6 == 3 else 2)
        samples += frame
        at += frame // 8 * _MP3_RATES[1 if version == 3 else 2][index] * 1000 // rate + (data[at + 2] >> 1 & 1)
    return (samples * 1000 // first[0], *first) if first else None


def _boxes(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes of an MP4 file between two places, contents alone; a size of 0 runs to the end."""
    while lo + 8 <= hi:
        size, kind = struct.unpack(">I4s", data[lo : lo + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", data[lo + 8 : lo + 16])[0], 16
        end = min(hi, lo + size) if size else hi
        if end < lo + head:
            return
        yield kind, lo + head, end
        lo = end


def _box(data: bytes, lo: int, hi: int, *path: bytes) -> tuple[int, int] | None:
    """The contents of the first box that the path leads to."""
    for step in path:
        found = next(((a, b) for kind, a, b in _boxes(data, lo, hi) if kind == step), None)
        if found is None:
            return None
        lo, hi = found
    return lo, hi


def _m4a(data: bytes) -> tuple[int, int, int] | None:
    """The first sound track of an MP4 file: its own clock's duration (mdhd), rate and channels of its sample entry (stsd)."""
    movie = _box(data, 0, len(data), b"moov") if data[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide") else None
    for kind, lo, hi in _boxes(data, *movie) if movie else ():
        handler, clock, entry = (_box(data, lo, hi, b"mdia", *path) for path in ((b"hdlr",), (b"mdhd",), (b"minf", b"stbl", b"stsd")))
        if kind != b"trak" or not (handler and clock and entry) or data[handler[0] + 8 : handler[0] + 12] != b"soun":
            continue
        at = clock[0]
        scale, length = struct.unpack(">IQ", data[at + 20 : at + 32]) if data[at] == 1 else struct.unpack(">II", data[at + 12 : at + 20])
        # The first entry follows a count; version and flags, then 8 bytes of box head and 8 of reference precede its fields.
        sound = entry[0] + 8 + 16
        channels, rate = struct.unpack(">H", data[sound + 8 : sound + 10])[0], struct.unpack(">I", data[sound + 16 : sound + 20])[0] >> 16
        return (length * 1000 // scale if scale else 0), rate or scale, channels
    return None


#: Sampling rates of ADTS frames by index.
_ADTS_HZ = [96_000, 88_200, 64_000, 48_000, 44_100, 32_000, 24_000, 22_050, 16_000, 12_000, 11_025, 8_000, 7_350]


def _adts(data: bytes) -> tuple[int, int, int] | None:
    """AAC as a chain of ADTS frames, whose blocks of 1024 samples are counted; a tag in front is left out."""
    at, samples, first = 0, 0, None
    if data[:3] == b"ID3" and len(data) >= 10:
        at = 10 + sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(data[6:10]))
    while at + 7 <= len(data) and data[at] == 0xFF and data[at + 1] & 0xF6 == 0xF0:
        index, channels = data[at + 2] >> 2 & 15, (data[at + 2] & 1) << 2 | data[at + 3] >> 6
        size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        if index >= len(_ADTS_HZ) or size < 7:
            break
        first = first or (_ADTS_HZ[index], {0: 2, 7: 8}.get(channels, channels))
        samples += 1024 * (1 + (data[at + 6] & 3))
        at += size
    return (samples * 1000 // first[0], *first) if first else None


#: Tried in this order; the first that knows the data answers.
AUDIO_READERS = [_wav, _flac, _ogg, _mp3, _m4a, _adts]


def audio_properties(data: bytes, readers=None) -> tuple[int, int, int] | None:
    """(duration_ms, sample_rate, channels) by the first reader that knows the data; None if none does. A reader that fails hands on to the next."""
    for read in AUDIO_READERS if readers is None else readers:
        try:
            found = read(data)
        except (wave.Error, EOFError, struct.error, IndexError, ValueError):
            continue
        if found:
            return found
    return None


def png_pixels(data: bytes) -> np.ndarray:
    """Height x width x 4 pixels of an 8-bit PNG without interlacing (grey, colour or palette, with or without alpha)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette, clear = 8, [], None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or laced:
        raise ValueError("only 8-bit PNG without interlacing")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * planes)
    out = np.zeros((height, width, planes), np.uint8)
    above = np.zeros((width, planes), np.uint8)
    for y in range(height):
        own, kind = lines[y, 1:].reshape(width, planes).copy(), lines[y, 0]
        if kind == 1:
            own = np.cumsum(own, 0, dtype=np.uint8)
        elif kind == 2:
            own += above
        elif kind in (3, 4):  # each pixel needs the one before it
            left, corner = np.zeros(planes, np.int64), np.zeros(planes, np.int64)
            for x in range(width):
                up = above[x].astype(np.int64)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                own[x] = (own[x] + guess) & 255
                left, corner = own[x].astype(np.int64), up
        out[y] = above = own
    if colour == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.concatenate((palette[out[..., 0]], alpha[out[..., 0]][..., None]), 2)
    full = np.full((height, width, 1), 255, np.uint8)
    return np.concatenate({0: (out, out, out, full), 2: (out, full), 4: (out[..., :1],) * 3 + (out[..., 1:],), 6: (out,)}[colour], 2)


def lanczos(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resized by a Lanczos kernel of three lobes, along one axis after the other; alpha weighs the colours."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = max(old / new, 1.0)
        x = (np.arange(old)[None, :] + 0.5 - (np.arange(new)[:, None] + 0.5) * old / new) / scale
        w = np.where(abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        return w / w.sum(1, keepdims=True)

    alpha = pixels[..., 3:].astype(float) / 255
    plane = np.concatenate((pixels[..., :3] * alpha, alpha), 2)
    plane = np.einsum("ij,jkc->ikc", weights(pixels.shape[0], height), plane)
    plane = np.einsum("ij,kjc->kic", weights(pixels.shape[1], width), plane)
    alpha = plane[..., 3:].clip(0, 1)
    colour = plane[..., :3] / np.where(alpha > 1e-6, alpha, 1)
    return np.concatenate((colour, alpha * 255), 2).round().clip(0, 255).astype(np.uint8)


def png_bytes(pixels: np.ndarray) -> bytes:
    """Height x width x 4 pixels as a PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width = pixels.shape[:2]
    raw = np.zeros((height, 1 + 4 * width), np.uint8)
    raw[:, 1:] = pixels.reshape(height, -1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def thumbnails(images: DataFrame, most: int = 128, decoders=(png_pixels,), encode=png_bytes) -> DataFrame:
    """(asset_id, width, height, thumbnail_data, error) of images given as (asset_id, data).

    Decoders are tried in turn; the picture is resized to fit most x most, never enlarged, and
    encoded. Decoders and the encoder can be replaced: no library for WebP or JPEG is needed here.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["asset_id"], batch["data"]):
                errors, pixels = [], None
                for decode in decoders if data is not None else ():
                    try:
                        pixels = decode(bytes(data))
                        break
                    except Exception as e:  # the next decoder may know the data
                        errors.append(str(e) or type(e).__name__)
                if pixels is None:
                    rows.append((name, None, None, None, "; ".join(errors) or "nothing to decode"))
                    continue
                height, width = pixels.shape[:2]
                scale = min(most / max(width, height), 1.0)
                if scale < 1:
                    pixels = lanczos(pixels, max(int(width * scale), 1), max(int(height * scale), 1))
                rows.append((name, width, height, encode(pixels), None))
            yield pd.DataFrame(rows, columns=["asset_id", "width", "height", "thumbnail_data", "error"]).astype({"width": "Int32", "height": "Int32"})

    return images.select("asset_id", "data").mapInPandas(run, f"asset_id {images.schema['asset_id'].dataType.simpleString()}, width int, height int, thumbnail_data binary, error string")


@F.pandas_udf(T.StructType().add("width", "integer").add("height", "integer").add("error", "string"))
def probe_image(data: pd.Series) -> pd.DataFrame:
    rows = []
    for x in data:
        size = image_size(bytes(x)) if x is not None else None
        rows.append((*size, None) if size else (None, None, "not an image that can be read"))
    return pd.DataFrame(rows, columns=["width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})


@F.pandas_udf(T.StructType().add("duration_ms", "long").add("sample_rate", "integer").add("channels", "integer").add("error", "string"))
def probe_audio(data: pd.Series) -> pd.DataFrame:
    rows = []
    for x in data:
        found = audio_properties(bytes(x)) if x is not None else None
        rows.append((*found, None) if found else (None, None, None, "not audio that can be read"))
    return pd.DataFrame(rows, columns=["duration_ms", "sample_rate", "channels", "error"]).astype({"duration_ms": "Int64", "sample_rate": "Int32", "channels": "Int32"})


@F.pandas_udf(T.StructType().add("cell_width", "integer").add("cell_height", "integer"))
def sprite_grid(pixels: pd.Series, width: pd.Series) -> pd.DataFrame:
    """The period of a sprite sheet along both axes, from the spectra of the column and row means of grey pixels; null without a period."""

    def period(profile: np.ndarray) -> int | None:
        n = len(profile)
        power = np.abs(np.fft.rfft(profile - profile.mean()))
        if n < 8 or power[2:].max(initial=0) <= 1e-6 * max(1.0, np.abs(profile).max()) * n:
            return None
        k = int(power[2:].argmax()) + 2
        return round(n / k) if power[k] > 4 * np.median(power[1:]) else None

    rows = []
    for p, w in zip(pixels, width):
        if p is None or not w or len(p) % w:
            rows.append((None, None))
            continue
        grey = np.asarray(p, float).reshape(-1, int(w))
        rows.append((period(grey.mean(0)), period(grey.mean(1))))
    return pd.DataFrame(rows, columns=["cell_width", "cell_height"]).astype("Int32")
