import struct

import numpy as np
import pytest

from tonearm.sources import boxes, containers, pictures, reader, tags
from tonearm.sources.containers import Sound


@pytest.mark.parametrize("kind", ["wav", "aiff", "au"])
@pytest.mark.parametrize("bits", [8, 16, 24])
@pytest.mark.parametrize("channels", [1, 2, 6])
def test_containers(kind, bits, channels):
    top = (1 << (bits - 1)) - 1
    block = np.random.default_rng(bits).integers(-top - 1, top, (37, channels), endpoint=True)
    block[0], block[1] = -top - 1, top
    extra = [(b"note", b"odd")] if kind != "au" else []
    data = containers.WRITERS[kind](Sound(44100, bits, 0x3F if channels == 6 else 0, block, extra))
    back = containers.READERS[kind](data)
    assert (back.rate, back.bits, back.channels) == (44100, bits, channels) and (back.samples == block).all()
    assert back.chunks == extra and tags.sniff(data) == kind
    assert kind == "au" or containers.faults(data) == []


def test_broken_files():
    data = containers.to_wav(Sound(8000, 16, 0, np.zeros((4, 1), int)))
    assert containers.faults(data[:-2]) and len(containers.from_wav(data[:-2]).samples) == 3
    for f in containers.READERS.values():
        with pytest.raises(ValueError):
            f(b"nothing of the kind")
    with pytest.raises(ValueError):
        containers.to_wav(Sound(8000, 8, 0, np.array([[300]])))


def test_extended_floats():
    for x in (0.0, 1.0, 44100.0, 96000.0, -2.5, 8000.0):
        assert containers.from_extended(containers.to_extended(x)) == x


def test_tags():
    items = [("TIT2", "Für Größe"), ("TPE1", "海"), ("TPE1", "zweite")]
    assert tags.from_id3v2(tags.to_id3v2(items)) == items
    assert tags.from_vorbis(tags.to_vorbis([("TITLE", "a=b"), ("x", "y")])) == [("TITLE", "a=b"), ("X", "y")]
    assert tags.from_ape(b"audio" + tags.to_ape([("Title", "é"), ("Year", "1999")])) == [("Title", "é"), ("Year", "1999")]
    v1 = b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30) + bytes(30) + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07\x01"
    assert tags.from_id3v1(b"xx" + v1) == [("TITLE", "Title"), ("ARTIST", "Artist"), ("YEAR", "1999"), ("COMMENT", "note"), ("TRACK", "7")]
    assert tags.id3v2_size(tags.to_id3v2(items) * 2 + b"fLaC") == 2 * len(tags.to_id3v2(items))
    assert tags.sniff(tags.to_id3v2(items) + b"fLaC") == "flac" and tags.sniff(b"") is None
    for f in tags.READERS.values():
        assert f(b"") == [] and f(b"ID3\x03") == []
    assert tags.sync_safe(tags.to_sync_safe(123456789 % (1 << 28))) == 123456789 % (1 << 28)


def test_pictures():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 5, 7, 8, 2, 0, 0, 0) + bytes(4)
    assert pictures.metrics(png) == ("image/png", 5, 7, 24, 0)
    assert pictures.metrics(b"GIF89a" + struct.pack("<HHB", 3, 4, 0x82)) == ("image/gif", 3, 4, 24, 8)
    bmp = b"BM" + bytes(12) + struct.pack("<IiiHHIIiiII", 40, 9, -8, 1, 24, 0, 0, 0, 0, 0, 0)
    assert pictures.metrics(bmp) == ("image/x-ms-bmp", 9, 8, 24, 0)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx\xff\xc0" + struct.pack(">HBHHB", 17, 8, 20, 30, 3)
    assert pictures.metrics(jpeg) == ("image/jpeg", 30, 20, 24, 0)
    entry = lambda tag, kind, v: struct.pack("<HHIHH", tag, kind, 1, v, 0)
    tiff = b"II*\0" + struct.pack("<IH", 8, 3) + entry(0x100, 3, 11) + entry(0x101, 3, 12) + entry(0x102, 3, 8)
    assert pictures.metrics(tiff) == ("image/tiff", 11, 12, 8, 0)
    assert pictures.metrics(b"") is pictures.metrics(b"\xff\xd8\xff") is None


def test_boxes():
    box = lambda name, body: struct.pack(">I4s", 8 + len(body), name) + body
    data = box(b"ftyp", b"M4A ") + box(b"moov", box(b"mvhd", b"1234") + box(b"udta", box(b"meta", bytes(4) + box(b"ilst", box(b"\xa9nam", box(b"data", b"x"))))))
    assert [p for p, _, _ in boxes.atoms(data)] == ["ftyp", "moov", "moov/mvhd", "moov/udta", "moov/udta/meta", "moov/udta/meta/ilst", "moov/udta/meta/ilst/©nam", "moov/udta/meta/ilst/©nam/data"]
    assert boxes.atom(data, "moov/mvhd") == b"1234" and boxes.atom(data, "free") is None
    page = lambda n, sizes, body: b"OggS\0\0" + struct.pack("<qIII", n, 5, n, 0) + bytes([len(sizes), *sizes]) + body
    ogg = page(0, [3, 255], b"abc" + b"x" * 255) + page(1, [2], b"yz")
    assert boxes.ogg_packets(ogg) == [b"abc", b"x" * 255 + b"yz"]
    flac = b"fLaC" + struct.pack(">I", 34) + bytes(34) + struct.pack(">I", 0x84000002) + b"vc"
    assert [(k, n) for k, _, n in boxes.flac_blocks(flac)] == [(0, 34), (4, 2)]
    wv = b"wvpk" + struct.pack("<IHBBIIIII", 26, 0x410, 0, 0, 100, 0, 100, 0, 0) + b"zz"
    assert boxes.wavpack_blocks(wv * 2) == [(0, 34, 100), (34, 34, 100)]


def test_folder_as_table(spark, tmp_path):
    rows = [(f"s{s}", k, c, (k * 7 + c * 3 + s) % 100 - 50) for s in range(2) for k in range(20) for c in range(2)]
    df = spark.createDataFrame(rows, "name string, frame_idx bigint, channel int, sample bigint")
    assert reader.write_sounds(df, "name", str(tmp_path)) == 2
    (tmp_path / "broken.wav").write_bytes(b"RIFFxxxxWAVE")
    spark.dataSource.register(reader.SoundSource)
    got = spark.read.format("sound").option("path", str(tmp_path)).load()
    assert got.count() == len(rows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("sound").option("path", str(tmp_path)).option("pushdown", "true").load()
    assert pushed.filter("frame_idx >= 5 and frame_idx < 7").count() == 8
    some = got.filter("frame_idx >= 5 and frame_idx < 7 and channel = 1")
    assert sorted((r.path.split("/")[-1][:2], r.frame_idx, r.channel, r.sample) for r in some.collect()) == sorted(r for r in rows if 5 <= r[1] < 7 and r[2] == 1)
    assert {r.format for r in reader.formats(reader.files(spark, str(tmp_path))).collect()} == {"wav"}
