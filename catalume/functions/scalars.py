"""Durations, sizes, similarities, media arithmetic, category rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The duration filter's presets (label, least ms, greatest ms); they overlap at their ends.
DURATION_PRESETS = [("< 100ms", None, 100), ("< 1s", None, 1000), ("1-10s", 1000, 10_000), ("10-60s", 10_000, 60_000), ("1-5 min", 60_000, 300_000), ("> 1 min", 60_000, None)]


def parse_duration(text: Column) -> Column:
    """Milliseconds of `1:30`, `2m30s`, `2min 30sec`, or a number with ms, s, sec, m, min or none (seconds); null for anything else.

    Numbers have digits before any point; halves of a millisecond go up.
    """
    t = F.lower(F.trim(text))
    number, blank = r"(\d+(?:\.\d+)?)", r"\s*"

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("double")

    clock, both, single = rf"^(\d+):{number}$", rf"^{number}{blank}m(?:in)?{blank}{number}{blank}s(?:ec)?$", rf"^{number}{blank}(ms|s|sec|m|min)?$"
    unit = F.regexp_extract(t, single, 2)
    factor = F.when(unit == "ms", 1.0).when(unit.isin("m", "min"), 60.0 * 1000).otherwise(1000.0)
    minutes = lambda p: (part(p, 1) * 60 + part(p, 2)) * 1000
    value = F.when(t.rlike(clock), minutes(clock)).when(t.rlike(both), minutes(both)).when(t.rlike(single), part(single, 1) * factor)
    return F.floor(value + 0.5).cast("bigint")


def _tenths(ms: Column) -> Column:
    """Tenths of a second nearest to the double ms / 1000; the larger one if both are equally near."""
    seconds, fives = ms / 1000.0, ms / 50.0
    # Where the milliseconds are a tie, the double's own rounding decides: its distance from the tie, twentyfold and exact.
    beyond = (seconds * 16 - fives) + seconds * 4 >= 0
    up = (ms % 100 > 50) | ((ms % 100 == 50) & beyond)
    return F.floor(ms / 100) + up.cast("int")


def format_duration_label(ms: Column) -> Column:
    """`250ms` under a second, `12s` or `12.5s` under a minute, else `2m` or `2m30s` with the seconds rounded (up to 60)."""
    tenths, seconds = _tenths(ms), F.floor((ms % 60_000) / 1000.0 + 0.5).cast("bigint")
    short = F.when(ms % 1000 == 0, F.floor(ms / 1000).cast("string")).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")))
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, F.concat(short, F.lit("s")))
        .otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m"), F.when(seconds > 0, F.concat(seconds.cast("string"), F.lit("s"))).otherwise("")))
    )


def format_duration_clock(ms: Column) -> Column:
    """`m:ss`, with milliseconds under ten seconds."""
    minutes, seconds = F.floor(ms / 60_000), F.floor(ms % 60_000 / 1000)
    text = F.format_string("%d:%02d", minutes, seconds)
    return F.when(ms < 10_000, F.concat(text, F.format_string(".%03d", ms % 1000))).otherwise(text)


def format_file_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB of 1024, one decimal."""
    scaled = lambda k, unit: F.format_string(f"%.1f {unit}", size / float(1 << k))
    return F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, scaled(10, "KB")).when(size < 1 << 30, scaled(20, "MB")).otherwise(scaled(30, "GB"))


def format_similarity(x: Column) -> Column:
    """A share as a whole percentage."""
    return F.concat(F.floor(x * 100 + 0.5).cast("bigint").cast("string"), F.lit("%"))


def duration_presets(ms: Column) -> Column:
    """The labels of all presets that hold the duration; none for null."""
    tests = [F.when(ms.isNotNull() & (F.lit(True) if lo is None else ms >= lo) & (F.lit(True) if hi is None else ms <= hi), F.lit(label)) for label, lo, hi in DURATION_PRESETS]
    return F.array_compact(F.array(*tests))


def duration_category(ms: Column) -> Column:
    """Under 0.5 s, 0.5 to 2 s, 2 to 5 s, longer."""
    return F.when(ms < 500, "oneshot").when(ms < 2000, "short").when(ms <= 5000, "medium").when(ms > 5000, "long")


def thumbnail_size(width: Column, height: Column, most: int = 128) -> Column:
    """The size that fits into most x most, never larger than the image, at least 1 x 1."""
    scale = F.least(F.lit(1.0), most / F.greatest(width, height))
    side = lambda c: F.greatest(F.floor(c * scale), F.lit(1)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def frames_to_ms(frames: Column, rate: Column) -> Column:
    """Milliseconds of so many frames, 0 if unknown."""
    return F.when((frames > 0) & (rate > 0), F.floor(frames / rate * 1000)).otherwise(0).cast("bigint")


def parse_category(text: Column) -> Column:
    """image, audio or clap in any case; anything else raises."""
    low = F.lower(text)
    return F.when(text.isNull() | low.isin("image", "audio", "clap"), low).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), text)))


def warnings_json(warnings: Column) -> Column:
    """The warnings as a JSON array, null if there are none."""
    return F.when(F.size(warnings) > 0, F.to_json(warnings))


def slow_load_ms(size_bytes: Column) -> Column:
    """From when loading an archive counts as slow: four seconds and its size at 15 MB/s."""
    return (4000 + size_bytes / float(1 << 20) / 15.0 * 1000).cast("bigint")


def asset_type(extension: Column) -> Column:
    """image, audio or null by the extension."""
    e = F.lower(extension)
    return F.when(e.isin("png", "jpg", "jpeg", "webp", "gif", "bmp"), "image").when(e.isin("mp3", "wav", "ogg", "flac", "m4a", "aac"), "audio")


#: Archive compression methods by number.
COMPRESSION = {0: "store", 8: "deflate", 9: "deflate64", 12: "bzip2", 14: "lzma", 93: "zstd"}


def compression_name(method: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in COMPRESSION.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(names, method.cast("int")), F.lit("unknown"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax(logits: Column) -> Column:
    """Of an array of doubles."""
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


#: What a tag has to hold to put a sound into a category, tried in this order; any other sound is an Effect.
SOUND_KEYWORDS = {"Voice": ["speech", "voice"], "Music": ["music", "instrument"], "Impact": ["explosion", "impact", "bang"], "Ambient": ["ambient", "nature", "wind"]}


def sound_category(tags: Column) -> Column:
    """The category of the first tag that has one, in the order of the tags."""

    def of(tag: Column) -> Column:
        low, out = F.lower(tag), F.lit(None).cast("string")
        for category, keys in reversed(SOUND_KEYWORDS.items()):
            test = F.lit(False)
            for key in keys:
                test = test | F.contains(low, F.lit(key))
            out = F.when(test, category).otherwise(out)
        return out

    return F.coalesce(F.get(F.array_compact(F.transform(tags, of)), F.lit(0)), F.lit("Effect"))


def audio_tags(labels: Column, logits: Column, least: float = 0.3, most: int = 10) -> Column:
    """Tags (label, confidence) of the `most` highest sigmoids that are over `least`, the highest first."""
    scored = F.zip_with(logits, labels, lambda x, n: F.struct(sigmoid(x).alias("confidence"), n.alias("label")))
    best = F.filter(F.slice(F.sort_array(scored, asc=False), 1, most), lambda s: s["confidence"] > least)
    return F.transform(best, lambda s: F.struct(s["label"].alias("label"), s["confidence"].alias("confidence")))


def timestamp_now(precision: str = "s") -> Column:
    """Seconds or milliseconds since the epoch, the same for all rows of a query."""
    return F.unix_millis(F.current_timestamp()) if precision == "ms" else F.unix_seconds(F.current_timestamp())


def hamming_similarity(a: Column, b: Column) -> Column:
    """1 - differing bits / 64."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


#: Estimated milliseconds an asset by processing tier, over eight workers.
TIER_MS = {"fast": 60, "quality": 130, "premium": 550}


def processing_estimate_s(count: Column, tier: str) -> Column:
    return count * TIER_MS[tier] / 8 / 1000.0
