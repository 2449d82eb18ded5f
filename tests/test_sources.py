"""Listings, archives, media headers, encoders, the catalogue object and streams, on generated files."""

import io
import json
import struct as packing
import wave
import zipfile
import zlib

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from catalume.plans.catalogue import Catalogue
from catalume.schema import SearchParams
from catalume.sources import archives, encoders, media
from catalume.streaming import progress


def png(w, h):
    def chunk(kind, data):
        return packing.pack(">I", len(data)) + kind + data + packing.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + b"\0" * 3 * w for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", packing.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def wav(samples=4410):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(44_100)
        w.writeframes(b"\0\0" * samples)
    return out.getvalue()


def test_wav_durations_are_whole_milliseconds():
    """8 * 1011 samples at 8000 Hz are 1011 ms; as a quotient of floats they were 1010."""
    for ms in (1010, 1011, 4047, 4079, 16313):
        n = 8 * ms
        head = b"RIFF" + packing.pack("<I", 36 + n) + b"WAVEfmt " + packing.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + packing.pack("<I", n)
        assert media.audio_properties(head + bytes(n)) == (ms, 8000, 1)


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "assets"
    (root / "Packs" / "sfx").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / ".hidden" / "x.png").write_bytes(png(1, 1))
    (root / "Packs" / "a.png").write_bytes(png(64, 48))
    (root / "Packs" / "sfx" / "b.wav").write_bytes(wav())
    (root / "notes.txt").write_text("no asset")
    (root / "broken.zip").write_bytes(b"PK nothing")
    (root / "pack.zip").write_bytes(zipped({"images/t.png": png(32, 32), "readme.md": b"x", "inner.zip": zipped({"deep/c.wav": wav(), "most.zip": zipped({"d.PNG": png(2, 3)})})}))
    return root


def test_listing(spark, folder):
    got = {(r.rel_path, r.zip_file, r.zip_entry or r.filename, r.asset_type) for r in archives.listing(spark, str(folder), 1).collect()}
    assert got == {("Packs", None, "a.png", "image"), ("Packs/sfx", None, "b.wav", "audio"), ("", "pack.zip", "images/t.png", "image"), ("", "pack.zip", "inner.zip/deep/c.wav", "audio"), ("", "pack.zip", "inner.zip/most.zip/d.PNG", "image")}
    assert archives.folder_bytes(spark, str(folder)).first().files == 5


def test_a_folder_of_parts_is_one_place(spark, tmp_path):
    """Tables as a file, as a folder of parts and as nested parts."""
    for name in ("a.parquet", "b.parquet/part-0", "b.parquet/part-1", "c.PARQUET/k=1/part-0", "b.parquet/.part-1.crc", ".d/part-0"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = {(r.filename, r.extension, r.rel_path, r.file_size) for r in archives.places(spark, str(tmp_path)).collect()}
    assert got == {("a.parquet", "parquet", "", 5), ("b.parquet", "parquet", "", 10), ("c.PARQUET", "parquet", "", 5)}


def test_folder_scan_over_tables_in_parts(spark, tmp_path):
    from catalume.plans import queries as catalogue

    sf = "/root/testdata/sf0.001"
    for name in ("labels", "documents"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.read.parquet(f"{sf}/region.parquet").toPandas().to_parquet(tmp_path / "region.parquet")
    got = sorted((r.filename, r.extension, r.rel_path, r.has_bytes) for r in catalogue.queries()["folder_scan"](spark, str(tmp_path)).collect())
    assert got == [(f"{n}.parquet", "parquet", "", True) for n in ("documents", "labels", "region")]


def test_entries_and_reads(spark, folder):
    contents = archives.read_archives(spark, str(folder))
    errors = archives.entries(contents).where("error is not null").collect()
    assert len(errors) == 1 and errors[0].zip_path.endswith("broken.zip")
    path = next(r.path for r in contents.select("path").collect() if r.path.endswith("pack.zip"))
    wanted = spark.createDataFrame([(path, e) for e in ("images/t.png", "inner.zip/deep/c.wav", "inner.zip/most.zip/d.PNG", "absent.png")], "zip_path string, zip_entry string")
    rows = archives.read_entries(contents, wanted)
    got = {r.zip_entry: (r.data, r.error) for r in rows.collect()}
    assert bytes(got["inner.zip/deep/c.wav"][0]) == wav() and got["absent.png"][0] is None and got["absent.png"][1]
    sizes = {r.zip_entry: (r.p.width, r.p.height) for r in rows.where("lower(zip_entry) like '%png'").select("zip_entry", media.probe_image("data").alias("p")).collect()}
    assert sizes == {"images/t.png": (32, 32), "inner.zip/most.zip/d.PNG": (2, 3), "absent.png": (None, None)}
    sound = rows.where("zip_entry like '%wav'").select(media.probe_audio("data").alias("p")).first().p
    assert (sound.duration_ms, sound.sample_rate, sound.channels) == (100, 44_100, 1)


def test_image_headers():
    assert media.image_size(b"GIF89a" + packing.pack("<HH", 3, 4)) == (3, 4)
    assert media.image_size(b"BM" + b"\0" * 16 + packing.pack("<ii", 5, -6)) == (5, 6)
    assert media.image_size(b"\xff\xd8\xff\xe0\0\x04\0\0\xff\xc0\0\x11\x08\0\x07\0\x08" + b"\0" * 9) == (8, 7)
    assert media.image_size(b"") is None


def test_encoder_errors_stay_in_their_batch(spark):
    def encode(items):
        if "bad" in items:
            raise RuntimeError("refused")
        return encoders.hashing_encoder(8)(items)

    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "bad")], "id long, t string").coalesce(1)
    got = {r.id: (r.embedding, r.error) for r in encoders.embed(rows, "id", "t", encode, batch=2).collect()}
    assert got[1][1] is None and len(got[1][0]) == 8 and got[2] == (None, "nothing to encode") and got[3] == (None, "refused")


def test_catalogue(spark, folder, tmp_path):
    c = Catalogue(spark, str(tmp_path / "catalogue"))
    fid = c.add_folder(str(folder), "Assets")
    assert c.add_folder(str(folder)) == fid and c.table("assets").count() == 5
    assert {r.asset_type: r.n for r in c.type_counts().collect()} == {"image": 3, "audio": 2}
    assert [r.filename for r in c.search(SearchParams("c", asset_type="audio")).collect()] == ["c.wav"]
    assert c.count(SearchParams("deep")) == 1
    assert c.roots().first().asset_count == 5
    assert {r.category: r.n for r in c.pending_counts().collect()} == {"image": 3, "audio": 2, "clap": 2}
    first = c.table("assets").where("filename = 'a.png'").first().id
    c.record("image_metadata", spark.createDataFrame([(first, 64, 48, 1)], "asset_id long, width int, height int, processed_at long"))
    (folder / "Packs" / "a.png").unlink()
    (folder / "Packs" / "new.png").write_bytes(png(3, 3))
    assert {r.status: r["count"] for r in c.preview_rescan(fid).groupBy("status").count().collect()} == {"removed": 1, "added": 1, "unchanged": 4}
    c.apply_rescan(fid)
    with pytest.raises(LookupError):
        c.apply_rescan(fid)
    assert c.table("assets").count() == 5 and c.table("image_metadata").count() == 0
    c.set_excludes(fid, spark.createDataFrame([(None, "Packs")], "zip_file string, excluded_path string"))
    assert c.table("assets").where("filename = 'b.wav'").first().searchable_path == "sfx"
    c.rename_folder(fid, "Other")
    assert c.folders().first().label == "Other"
    c.remove_folder(fid)
    assert c.table("assets").count() == 0 and c.folders().count() == 0


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    seen = []
    stream = progress.chunks(spark, source, events.schema.simpleString()[7:-1].replace(":", " "), 1)
    q = progress.write_batches(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "checkpoint"))
    assert q.awaitTermination(120) and sum(seen) == events.count() and len(seen) == 3
    q = progress.windowed_counts(stream, "1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == progress.windowed_counts(events, "1 hour").agg(F.sum("n")).first()[0]
    ticks = stream.select((F.col("user_id") % 3).alias("k"), "event_id", "value")
    q = progress.ewma_stream(ticks, "k", "event_id", "value").writeStream.format("memory").queryName("rates").outputMode("update").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert spark.table("rates").groupBy("k").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == events.count()
    assert progress.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_hashing_encoder_reads_all_bytes():
    from catalume.sources.encoders import hashing_encoder

    same = b"abcd" * (1 << 14)
    a, b = hashing_encoder(64)([same + b"one tail", same + b"another tail, longer"])
    assert (a != b).any()


def test_broken_inner_archives_leave_their_neighbours(spark, tmp_path):
    """Whatever a broken archive raises, the rows beside it stay, and the folder keeps a warning."""
    import io
    import zipfile

    good = io.BytesIO()
    with zipfile.ZipFile(good, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.wav", wav())
    raw = bytearray(good.getvalue())
    raw[40:60] = bytes(20)  # breaks the compressed data, not the directory
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.png", png(2, 2))
        z.writestr("no.zip", b"PK\x05\x06 nothing")
        z.writestr("deep/half.zip", good.getvalue()[:60])
        z.writestr("fine.zip", good.getvalue())
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.zip").write_bytes(outer.getvalue())
    (tmp_path / "in" / "q.zip").write_bytes(bytes(raw))
    rows = archives.entries(archives.archive_paths(spark, str(tmp_path / "in"))).collect()
    got = {r.zip_entry: r.error is None for r in rows if r.zip_path.endswith("p.zip")}
    assert got == {"a.png": True, "no.zip": False, "deep/half.zip": False, "fine.zip/x.wav": True}
    path = next(r.zip_path for r in rows if r.zip_path.endswith("q.zip"))
    read = archives.read_entries(None, spark.createDataFrame([(path, "x.wav"), (path, "y")], "zip_path string, zip_entry string")).collect()
    assert len(read) == 2 and all(r.error and r.data is None for r in read)
    c = Catalogue(spark, str(tmp_path / "catalogue"))
    c.add_folder(str(tmp_path / "in"), "In")
    found = json.loads(c.folders().first().scan_warnings)
    assert [w.split(":")[0] for w in found] == ["p.zip/deep/half.zip", "p.zip/no.zip"] and c.table("assets").count() == 3
    files = archives.read_files(archives.files(spark, str(tmp_path / "in")).select("path").union(spark.createDataFrame([(str(tmp_path / "none"),)], "path string"))).collect()
    assert sorted((r.error is None, len(r.data or b"")) for r in files)[1:] == sorted((True, len(x)) for x in (outer.getvalue(), bytes(raw))) and "Failed to read file" in next(r.error for r in files if r.error)
    row = c.info().first()
    assert (row.assets, row.active_folders) == (3, 1) and row.bytes > 0 and row.files > 0


def test_audio_headers():
    flac = b"fLaC" + packing.pack(">I", 34) + bytes(10) + ((48_000 << 44) | 1 << 41 | 15 << 36 | 96_000).to_bytes(8, "big") + bytes(16)
    assert media.audio_properties(flac) == (2000, 48_000, 2)
    page = lambda position, body: b"OggS\0\2" + packing.pack("<q", position) + bytes(12) + b"\1\x1e" + body
    assert media.audio_properties(page(0, b"\x01vorbis" + bytes(4) + packing.pack("<BI", 1, 22_050)) + page(11_025, b"")) == (500, 22_050, 1)
    assert media.audio_properties(page(0, b"OpusHead\x01" + packing.pack("<BHI", 2, 312, 44_100)) + page(48_312, b"")) == (1000, 44_100, 2)
    frame = b"\xff\xfb\x90\xc0"  # 128 kbit/s, 44.1 kHz, one channel
    mp3 = b"ID3\x04\0\0\0\0\0\x05" + bytes(5) + (frame + bytes(417 - 4)) * 100
    assert media.audio_properties(mp3) == (100 * 1152 * 1000 // 44_100, 44_100, 1)
    assert media.audio_properties(b"") is None and media.audio_properties(b"fLaC") is None and media.audio_properties(b"RIFF\0\0\0\0WAVE") is None

    def failing(data):
        raise ValueError("no")

    assert media.audio_properties(b"abc", [failing, lambda d: None, lambda d: (len(d), 1, 1)]) == (3, 1, 1)


def test_thumbnails(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    pixels = draw.integers(0, 256, (20, 30, 4), dtype=np.uint8)
    assert (media.png_pixels(media.png_bytes(pixels)) == pixels).all()
    flat = np.tile(np.array([10, 200, 30, 255], np.uint8), (300, 200, 1))
    rows = [(1, media.png_bytes(flat)), (2, media.png_bytes(pixels)), (3, b"junk"), (4, None)]
    got = {r.asset_id: r for r in media.thumbnails(spark.createDataFrame(rows, "asset_id long, data binary")).collect()}
    small = media.png_pixels(bytes(got[1].thumbnail_data))
    assert small.shape == (128, 85, 4) and (small == flat[0, 0]).all() and (got[1].width, got[1].height) == (200, 300)
    assert (media.png_pixels(bytes(got[2].thumbnail_data)) == pixels).all() and got[3].error and got[4].error == "nothing to decode"
    other = media.thumbnails(spark.createDataFrame(rows[2:3], "asset_id long, data binary"), decoders=(media.png_pixels, lambda d: pixels)).first()
    assert other.error is None and other.width == 30


def test_sprite_grid(spark):
    import numpy as np

    sheet = np.zeros((64, 96))
    sheet[::8] = sheet[:, ::16] = 255
    plain = np.full((64, 96), 7.0)
    df = spark.createDataFrame([(sheet.ravel().tolist(), 96), (plain.ravel().tolist(), 96)], "pixels array<double>, width int")
    got = df.select(media.sprite_grid("pixels", "width").alias("g")).select("g.*").collect()
    assert tuple(got[0]) == (16, 8) and tuple(got[1]) == (None, None)


def test_encoded_texts_against_brute_force(spark):
    import hashlib
    import math

    from catalume.plans import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.queries()["encode_text"](spark, sf).collect():
        want = [0] * 64
        for w in texts[r.doc_id].lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            want[h % 64] += 1 if h >> 63 else -1
        norm = math.sqrt(sum(x * x for x in want)) or 1.0
        assert [float(x) for x in r.embedding.split(",")] == pytest.approx([x / norm for x in want], abs=2e-5)


def test_item_map(spark):
    from catalume.operators.layout import layout

    rows = [(k, [5.0 * (k % 3 == g) + (k % 7) / 100 for g in range(3)]) for k in range(60)] + [(99, None)]
    got = layout(spark.createDataFrame(rows, "asset_id long, embedding array<float>"), 3).collect()
    assert len(got) == 60 and all(len({r.cluster for r in got if r.asset_id % 3 == g}) == 1 for g in range(3)) and len({r.cluster for r in got}) == 3


def test_processing(spark, tmp_path):
    """One category at a time, pause and resume without loss, stop by generations, progress events."""
    from catalume.streaming.control import Processing

    for c in ("image", "audio"):
        spark.range(40).repartition(8).write.parquet(str(tmp_path / c))
    seen, events, hold = {"image": [], "audio": []}, [], []

    def sink(category, df, k):
        if hold:
            hold.pop()
            work.pause("image")
        seen[category] += [r.id for r in df.collect()]

    work = Processing(str(tmp_path / "checkpoint"), lambda c: progress.chunks(spark, str(tmp_path / c), "id long", 2), sink, events.append)
    assert work.start("image") == "running" and work.start("audio") == "queued" and work.start("audio") == "queued"
    assert work.progress("audio")["state"] == "queued"
    work.wait(240)
    assert sorted(seen["image"]) == sorted(seen["audio"]) == list(range(40))
    assert [e["category"] for e in events] == ["image"] * 4 + ["audio"] * 4 and events[-1]["done"] == 40 and events[-1]["rate"] > 0
    assert work.progress("image")["state"] == "done" and work.progress("clap")["state"] == "idle"
    with pytest.raises(ValueError, match="unknown category"):
        work.start("video")
    seen["image"].clear()
    assert work.start("image") == "running"
    work.pause("image")
    assert work.progress("image")["state"] == "paused" and work.start("audio") == "queued"
    work.resume("image")
    work.wait(240)
    assert sorted(set(seen["image"])) == list(range(40)) and work.progress("image")["generation"] == 2
    work.start("image")
    work.stop_all()
    before = len(seen["image"])
    work._batch("image", 2, spark.range(5), 0)  # a late batch of an old generation
    assert len(seen["image"]) == before and work.progress("image")["state"] == "stopped" and not work.queued


def test_previews_expire(spark):
    from catalume.streaming.control import Previews

    now = [0.0]
    kept = Previews(clock=lambda: now[0])
    kept.put(1, spark.range(1))
    kept.put(1, spark.range(2))
    kept.put(2, spark.range(3))
    now[0] = 1800.0
    assert kept.take(1).count() == 2
    with pytest.raises(LookupError, match="no pending"):
        kept.take(1)
    now[0] = 1801.0
    with pytest.raises(TimeoutError, match="30 minutes"):
        kept.take(2)


def test_latest_wins(spark, tmp_path):
    latest = progress.Latest(spark, "search")
    assert latest.run(lambda: 1) == 1

    def outer():
        assert latest.run(lambda: "newer") == "newer"
        return "older"

    assert latest.run(outer) is None
    requests = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:02")], "id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.id for r in progress.distinct_requests(requests).collect()) == [1, 2]
    requests.coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = progress.distinct_requests(progress.chunks(spark, str(tmp_path / "r"), "id int, ts timestamp"))
    q = stream.writeStream.format("memory").queryName("requests").outputMode("append").option("checkpointLocation", str(tmp_path / "rc")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and sorted(r.id for r in spark.table("requests").collect()) == [1, 2]


def test_ewma_stream_waits_for_a_rate(spark, tmp_path):
    ticks = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([0, 0, 10, 10])], "k string, i int, v double")
    ticks.coalesce(1).write.parquet(str(tmp_path / "t"))
    out = progress.ewma_stream(progress.chunks(spark, str(tmp_path / "t"), "k string, i int, v double"), "k", "i", "v")
    q = out.writeStream.format("memory").queryName("waits").outputMode("update").option("checkpointLocation", str(tmp_path / "tc")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and spark.table("waits").first().rate == 10.0


def mp4(duration, scale, rate, channels, version=0, video_first=True):
    box = lambda kind, body: packing.pack(">I", 8 + len(body)) + kind + body

    def track(kind, entry):
        times = bytes([version, 0, 0, 0]) + (bytes(16) + packing.pack(">IQ", scale, duration) if version else bytes(8) + packing.pack(">II", scale, duration))
        handler = bytes(8) + kind + bytes(12)
        return box(b"trak", box(b"tkhd", bytes(80)) + box(b"mdia", box(b"mdhd", times + bytes(4)) + box(b"hdlr", handler) + box(b"minf", box(b"stbl", box(b"stsd", packing.pack(">II", 0, 1) + entry)))))

    sound = box(b"mp4a", bytes(8) + bytes(8) + packing.pack(">HHHHI", channels, 16, 0, 0, rate << 16))
    tracks = track(b"vide", box(b"avc1", bytes(70))) * video_first + track(b"soun", sound)
    wide = packing.pack(">I", 1) + b"mdat" + packing.pack(">Q", 16 + 20) + bytes(20)
    return box(b"ftyp", b"M4A \0\0\0\0") + wide + box(b"moov", box(b"mvhd", bytes(100)) + tracks)


def test_m4a_and_adts_headers():
    for version in (0, 1):
        assert media.audio_properties(mp4(441_000, 44_100, 44_100, 2, version)) == (10_000, 44_100, 2)
    assert media.audio_properties(mp4(48_000, 48_000, 0, 1, video_first=False)) == (1000, 48_000, 1)
    assert media.audio_properties(mp4(5, 0, 8_000, 1)) == (0, 8_000, 1)
    assert media.audio_properties(mp4(1, 1, 1, 1)[:60]) is None

    def frame(size, index=4, channels=2, blocks=1):
        head = bytes([0xFF, 0xF1, 1 << 6 | index << 2 | channels >> 2, (channels & 3) << 6 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 0x1F, 0xFC | blocks - 1])
        return head + bytes(size - 7)

    assert media.audio_properties(frame(300) * 430) == (430 * 1024 * 1000 // 44_100, 44_100, 2)
    assert media.audio_properties(b"ID3\x04\0\0\0\0\0\x05" + bytes(5) + frame(9, 11, 1, 2) * 3 + b"end") == (3 * 2048 * 1000 // 8000, 8_000, 1)
    assert media.audio_properties(frame(300, 15)) is None and media.audio_properties(bytes([0xFF, 0xF1, 0x50, 0, 0, 0, 0])) is None


def nested_zip(tmp_path, names=("i.zip", "j.zip", "k.zip"), size=3000):
    import io
    import zipfile

    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        for name in names:
            inner = io.BytesIO()
            with zipfile.ZipFile(inner, "w") as y:
                y.writestr("deep.zip", _one_entry())
                for k in range(6):
                    y.writestr(f"{k}.bin", bytes([k]) * (size // 6))
            z.writestr(name, inner.getvalue())
    path = tmp_path / "outer.zip"
    path.write_bytes(outer.getvalue())
    return str(path)


def _one_entry():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.txt", "x")
    return out.getvalue()


def test_nested_archives_are_opened_once_under_a_budget(tmp_path, monkeypatch):
    import zipfile

    cache, outer = archives.ArchiveCache(budget=9000), zipfile.ZipFile(nested_zip(tmp_path))
    for _ in range(4):
        for name in ("i.zip", "j.zip"):
            assert archives._read(outer, f"{name}/3.bin", cache, "o") == bytes([3]) * 500
    assert cache.opened == 2 and 0 < cache.bytes <= 9000
    assert archives._read(outer, "i.zip/deep.zip/x.txt", cache, "o") == b"x" and "o::i.zip/deep.zip" in cache.held
    archives._read(outer, "k.zip/0.bin", cache, "o")
    assert cache.bytes <= 9000 and "o::j.zip" not in cache.held  # the least recently used one went
    archives._read(outer, "j.zip/0.bin", cache, "another outer")
    assert cache.opened == 5
    small = archives.ArchiveCache(budget=10)
    assert archives._read(outer, "i.zip/deep.zip/x.txt", small, "o") == b"x" and small.bytes == 0 and not small.held
    with pytest.raises(ValueError, match="more than 100 bytes"):
        archives._inner(outer, "i.zip", 100)
    with pytest.raises(KeyError):
        archives._read(outer, "i.zip/none", cache, "o")
    assert not +cache.pins


def test_nested_entries_through_the_workers_cache(spark, tmp_path):
    """A second pass, which may meet what a worker has kept, and a changed file, which must not."""
    path = nested_zip(tmp_path)
    wanted = spark.createDataFrame([(path, f"{n}/{k}.bin") for n in ("i.zip", "j.zip") for k in range(6)], "zip_path string, zip_entry string").coalesce(1)
    for _ in range(2):
        rows = archives.read_entries(None, wanted).collect()
        assert len(rows) == 12 and all(r.error is None and r.data == bytes([int(r.zip_entry[6])]) * 500 for r in rows)
    (tmp_path / "outer.zip").unlink()
    nested_zip(tmp_path, size=600)
    assert {len(r.data) for r in archives.read_entries(None, wanted).collect()} == {100}
    cloudpickle.loads(cloudpickle.dumps(archives.worker_cache))  # by name: tasks take their own process's cache
    assert cloudpickle.loads(cloudpickle.dumps(archives.worker_cache))() is archives.worker_cache()


def test_archives_leave_arrow_one_at_a_time(spark):
    """No batch of archives becomes pandas objects as a whole; an archive without content is a row with its error."""
    data = zipped({"a.txt": b"1", "in.zip": zipped({"b.txt": b"22"}), "empty.txt": b""})
    contents = spark.createDataFrame([("x", bytearray(data)), ("none", None), ("bad", bytearray(b"no"))], "path string, content binary")
    found = archives.entries(contents)
    rows = {(r.zip_path, r.zip_entry): (r.file_size, r.error is None) for r in found.collect()}
    assert rows == {("x", "a.txt"): (1, True), ("x", "in.zip/b.txt"): (2, True), ("x", "empty.txt"): (0, True), ("none", None): (None, False), ("bad", None): (None, False)}
    wanted = found.where("zip_path = 'x'").select("zip_path", "zip_entry").union(spark.createDataFrame([("x", "gone"), ("none", "a"), ("bad", "a")], "p string, e string"))
    read = archives.read_entries(contents, wanted)
    got = {(r.zip_path, r.zip_entry): (None if r.data is None else bytes(r.data), r.error is None) for r in read.collect()}
    assert got == {("x", "a.txt"): (b"1", True), ("x", "in.zip/b.txt"): (b"22", True), ("x", "empty.txt"): (b"", True), ("x", "gone"): (None, False), ("none", "a"): (None, False), ("bad", "a"): (None, False)}
    for df in (found, read):
        assert "MapInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()
