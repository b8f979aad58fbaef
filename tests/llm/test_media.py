import hashlib
import json
import zlib

import pytest

from sievewright.llm import media
from sievewright.llm.common import scratch_uri

TEXTS = [None, "", "x", "y" * 64, "z" * 65, "é" * 100000, "line\n" * 50, "\x00"] + [f"text {i} " * (i % 90) for i in range(400)]


def test_round_trip(spark):
    rows = [(i, t, "m", 1) for i, t in enumerate(TEXTS)] + [(None, "x", "m", 1), (3, TEXTS[3], "m", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes int")
    got = media.store_and_describe(df).collect()
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        p = raw + bytes((-len(raw)) % 64 if raw else 64)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    same = [tuple(r)[1:] for r in got if r.doc_id in (2, None)]
    assert same[0] == same[1] and all(r.feature and r.media_bytes > 60 for r in got)
    assert media.store_and_describe(df.limit(0)).collect() == []


def test_ranges_read_each_member_once(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    folder = scratch_uri(spark, "media")
    media.write_archives(df.repartition(3), folder, "doc_id", "text", archive_bytes=20000)
    for size in (700, 5000, 10**9):
        back = media.read_archives(spark, folder, rangeBytes=size)
        assert sorted(json.loads(r.id)["v"] for r in back.collect()) == list(range(len(TEXTS)))


def test_damage_is_seen_and_retried(tmp_path):
    png = bytearray(media.to_png(media.padded(b"abc")))
    assert media.from_png(bytes(png)) == media.padded(b"abc")
    png[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(png))

    import zipfile

    name = str(tmp_path / "a.zip")
    with zipfile.ZipFile(name, "w") as z:
        z.writestr("m.png", b"payload")
    info = zipfile.ZipFile(name).infolist()[0]

    class Flaky:
        opened = 0

        def open_input_file(self, path):
            from pyarrow import fs

            Flaky.opened += 1
            if Flaky.opened < 3:
                raise OSError("not now")
            return fs.LocalFileSystem().open_input_file(path)

    reader = media.ArchiveReader({"path": "file://" + str(tmp_path)})
    assert reader._member(Flaky(), name, info) == b"payload" and Flaky.opened == 3
    Flaky.opened, reader._open = -10, None
    with pytest.raises(OSError):
        reader._member(Flaky(), name, info)
