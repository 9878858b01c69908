"""Image derivations, jobs and the command line on a tree of plain Netpbm images."""

import struct
import sys
import threading

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from silverleaf import cli
from silverleaf.catalog import Library
from silverleaf.functions import images
from silverleaf.operators import media
from silverleaf.plans import ingest, jobs
from silverleaf.sources import scan

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def picture(seed, rows=40, columns=50, flip=0):
    made = np.random.default_rng(seed).integers(0, 256, (8, 10)).repeat(rows // 8, 0).repeat(columns // 10, 1).astype(np.uint8)
    made[:1, :flip] ^= 1
    return b"P5\n# comment\n%d %d 255\n" % (columns, rows) + made.tobytes()


class Encoder(media.Encoder):
    def images(self, contents):
        return [None if (p := images.decode(c)) is None else images.shrink(images.luma(p), 4, 4).ravel() - 128 for c in contents]

    def text(self, query):
        return np.arange(16.0) - len(query)


class Detector(media.FaceDetector):
    def faces(self, contents):
        return [[((0, 0, 1, 1), 0.9, np.array([1.0, c[-1] % 7])), ((0, 0, 2, 2), 0.5, np.zeros(2))] for c in contents]


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("media")
    for k, (name, data) in enumerate([("a/1.gif", picture(1)), ("a/2.gif", picture(1, flip=3)), ("b/3.gif", picture(2)), ("b/4.gif", b"broken"), ("5.gif", picture(3))]):
        p = root / "photos" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    lib = Library(spark, f"file://{root}/lib")
    assert cli.main(["index", f"{root}/photos", "--library", lib.root], spark) == 0
    return lib, f"{root}/photos", root


def test_contents_are_read_by_name_or_with_the_tree(spark, tmp_path, monkeypatch):
    names = ["a.jpg", "b [1] {x} 100%+? %20é.jpg", "c*d.jpg"]
    (tmp_path / "photos" / "k=v").mkdir(parents=True)
    for n in names:
        (tmp_path / "photos" / "k=v" / n).write_bytes(n.encode())
    lib = Library(spark, str(tmp_path / "lib"))
    ingest.index(lib, str(tmp_path / "photos"), 1)
    queue = lib.read("assets").filter("filename <> 'a.jpg'")
    want = sorted((r["id"], r["filename"].encode()) for r in queue.collect())
    assert len(want) == 2
    for few in (0, 1, 2, 20):
        monkeypatch.setattr(scan, "FEW", few)
        assert sorted((r["asset_id"], bytes(r["content"])) for r in jobs.contents(lib, str(tmp_path / "photos"), queue).collect()) == want
        assert jobs.contents(lib, str(tmp_path / "photos"), queue.limit(0)).count() == 0


def test_decoding_and_hashing():
    assert images.decode(b"") is images.decode(b"nothing") is images.decode(b"P5 9 9 255 x") is None
    pixels = images.decode(b"P6 2 1 255\n" + bytes([255, 0, 0, 0, 0, 255]))
    assert pixels.shape == (1, 2, 3) and images.luma(pixels).round().tolist() == [[76.0, 29.0]]
    grid = np.random.default_rng(0).integers(0, 256, (16, 17)).astype(np.uint8)
    assert images.shrink(grid, 16, 17) == pytest.approx(grid)
    want = sum(1 << (r * 16 + c) for r in range(16) for c in range(16) if grid[r, c] > grid[r, c + 1])
    assert int(images.difference_hash(np.stack([grid] * 3, 2)), 16) == want
    flat = images.pixel_statistics(np.full((9, 9, 3), 100, np.uint8))
    assert flat == pytest.approx({"edge_variance": 0, "mean_luma": 100, "luma_deviation": 0, "residual_rms": 0}, abs=1e-6)


def tiff(order, exif=True):
    """A block of three directories, with a text, numbers, a fraction and raw bytes."""
    import struct

    fixed, heap = [], b""
    where = lambda n: 8 + sum(2 + 12 * len(d) + 4 for d in fixed[:n])
    main = [(0x010F, 2, 5, b"Acme\0"), (0x0112, 3, 1, struct.pack(order + "H", 6)), (0x011A, 5, 1, struct.pack(order + "II", 72, 1)), (0xEEEE, 9, 2, struct.pack(order + "ii", -1, 5)), (0x0110, 2, 9, None)]
    sub = [(0x829A, 5, 1, struct.pack(order + "II", 1, 4)), (0x9286, 7, 3, b"\xe9\xe8 "), (0x9000, 7, 4, b"0230")]
    gps = [(1, 2, 2, b"N\0"), (2, 5, 3, struct.pack(order + "6I", 48, 1, 30, 2, 0, 0))]
    fixed = [main + ([(0x8769, 4, 1, 1), (0x8825, 4, 1, 2)] if exif else []), sub, gps]
    start = where(3)
    out = b""
    for d in fixed:
        out += struct.pack(order + "H", len(d))
        for tag, kind, count, value in d:
            if isinstance(value, int):
                value = struct.pack(order + "I", where(value))
            if value is None:  # points outside the block
                out += struct.pack(order + "HHII", tag, kind, count, 1 << 30)
            elif len(value) <= 4:
                out += struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
            else:
                out += struct.pack(order + "HHII", tag, kind, count, start + len(heap))
                heap += value
        out += bytes(4)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + out + heap


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_of_every_container(spark, order):
    import json

    from silverleaf.functions import exif

    want = {
        "Make": "Acme", "Orientation": 6, "XResolution": 72.0, "Tag_0xeeee": [-1, 5],
        "ExifIFD": {"ExposureTime": 0.25, "UserComment": "éè ", "ExifVersion": "0230"}, "GPSIFD": {"GPSLatitudeRef": "N", "GPSLatitude": [48.0, 15.0, 0.0]},
    }
    raw = tiff(order)
    jpeg = b"\xff\xd8\xff\xe0\0\x06abcd\xff\xe1" + (len(raw) + 8).to_bytes(2, "big") + b"Exif\0\0" + raw + b"\xff\xda"
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\x02IHDRxxcrcc" + len(raw).to_bytes(4, "big") + b"eXIf" + raw
    for data in (raw, jpeg, png):
        assert json.loads(exif.document(data)) == want
    assert "ExifIFD" not in exif.document(tiff(order, False))
    for data in (None, b"", b"\xff\xd8", raw[:20], raw[:60], b"II*\0" + bytes(3), picture(1)):
        exif.document(data)  # never fails
    rows = spark.createDataFrame([(1, jpeg), (2, b"broken"), (3, None)], "asset_id long, content binary")
    assert [(r["asset_id"], json.loads(r["exif"])) for r in media.exif(rows).collect()] == [(1, want)]


def test_hash_cluster_and_export(library, spark):
    lib, root, tmp = library
    for _ in range(2):  # the second run finds nothing missing
        assert cli.main(["hash", root, "--library", lib.root], spark) == 0
        assert lib.read("phash").count() == 4
    assert cli.main(["score", root, "--library", lib.root, "--variant", "luminosity"], spark) == 0
    scores = lib.read("asset_scores")
    assert scores.count() == 10 and scores.filter("value = 0").count() == 2
    assert jobs.score_images(lib, root, media.SimpleScorer, 9, "luminosity") == (0, 0)
    assert cli.main(["cluster", root, "--library", lib.root], spark) == 0
    runs = lib.read("clustering_runs").collect()
    assert len(runs) == 1 and runs[0]["params_json"] == '{"linkage":"complete","min_cluster_size":2,"threshold":20,"window":200}'
    assert lib.read("cluster_members").count() == 2
    assert jobs.cluster_images(lib, 9, threshold=0, min_size=4) == 0 and lib.read("clustering_runs").count() == 1
    assert cli.main(["export", root, "--library", lib.root, "--out", f"{tmp}/out", "--scorer", "simple", "--metric", "contrast"], spark) == 0
    assert len(list((tmp / "out").iterdir())) == 1
    assert cli.main(["browse", root, "--library", lib.root, "--sort", "simple:luminosity:brightness"], spark) == 0


def test_embed_search_and_map(library):
    lib, root, _ = library
    cache = jobs.MapCache(lib)
    jobs.embed_images(lib, root, Encoder, 1)
    assert lib.read("clip_embeddings").count() == 4
    assert jobs.search_text(lib, Encoder(), " ").count() == 0 and jobs.search_text(lib, Encoder(), "word").count() == 4
    assert jobs.cluster_images(lib, 2, "clip") == 1
    found = cache.get(3)
    points = found.points
    assert points.count() == 4 == found.total and found.params == {"clustering_method": "kmeans", "max_clusters": 3} and cache.get(3)[0] is points
    jobs.embed_images(lib, root, Encoder, 2)
    assert not cache.made


def test_search_and_analysis_of_a_picture_handed_in(library, spark, monkeypatch):
    from silverleaf.plans import upload

    lib, root, _ = library
    jobs.hash_images(lib, root, 1)
    jobs.embed_images(lib, root, Encoder, 1)
    near = upload.search_by_image(lib, picture(1), "phash").collect()
    assert [r["score"] for r in near] == sorted(r["score"] for r in near) and {r["filename"] for r in near} == {"1.gif", "2.gif"}
    like = upload.search_by_image(lib, picture(1), encoder=Encoder(), threshold=0.9).collect()
    assert like[0]["score"] == 1.0 and like[0]["filename"] == "1.gif"
    vocabulary = spark.createDataFrame([("same", [float(x) for x in upload.vector_of(picture(1), Encoder())], False), ("other", [1.0] + [0.0] * 15, True)], "term string, vector array<double>, user_tag boolean")
    said = upload.analyze(lib, picture(1), Encoder(), vocabulary, 1)
    assert (said["rows"], said["columns"], said["exif"]) == (40, 50, None) and said["words"] == [{"term": "same", "score": 1.0, "user_tag": False}]
    assert upload.analyze(lib, picture(2))["words"] == []
    monkeypatch.setattr(upload, "MAX_BYTES", 10)
    for content, limit, status in ((b"broken", 50, 400), (b"", 50, 400), (picture(1), 10, 413)):
        with pytest.raises(upload.UploadError) as e:
            upload.checked(content, limit)
        assert e.value.status == status
    with pytest.raises(upload.UploadError):
        upload.search_by_image(lib, picture(1))


def test_progress_goes_forward_and_adds_up(spark):
    from silverleaf.plans.progress import Progress

    told = []
    p = Progress(lambda phase, percent: told.append((phase, percent)))
    assert [p.at("scan", 1, 2), p.at("process", 0, 0), p.at("scan", 1, 2), p.at("process", 9, 3)] == [2.5, 5.0, 5.0, 100.0] and len(told) == 4
    for n in (3, 5):
        with p.stage("hash") as items:
            items.append(n)
    with p.stage("idle"):
        pass
    got = {r["stage"]: r for r in p.report(spark).collect()}
    assert (got["hash"]["runs"], got["hash"]["items"]) == (2, 8) and got["hash"]["ms_per_item"] > 0 and got["idle"]["ms_per_item"] is None


def test_profile_of_a_folder(spark, tmp_path, capsys):
    for k in range(5):
        (tmp_path / f"{k}.json").write_text('{"a": %d, "b": "x"}' % k if k < 4 else "{")
    assert cli.main(["profile", str(tmp_path)], spark) == 0
    out = capsys.readouterr().out
    assert "4 parsed, 1 failed" in out and "$.a\tinteger\t4\trequired\t0, 1, 2" in out
    assert cli.main(["profile", str(tmp_path), "--pattern", "*.json", "--limit", "2"], spark) == 0 and "2 parsed, 0 failed" in capsys.readouterr().out
    assert cli.main(["profile", str(tmp_path), "--pattern", "*.none"], spark) == 2


def test_faces(library):
    lib, root, _ = library
    assert jobs.detect(lib, root, Detector, "m", 1) == 5  # the empty vectors drop out
    assert jobs.cluster_faces(lib, 2, "dbscan", eps=0.5, min_samples=2) >= 1
    assert lib.read("face_cluster_members").filter("is_representative").count() == lib.read("face_clusters").count()
    assert jobs.detect(lib, root, Detector, "m", 3) == 5 and lib.read("face_clusters").count() == 0


def test_jobs_run_once_at_a_time_and_can_be_cancelled(spark):
    runner, gate = jobs.Jobs(spark), threading.Event()
    first = runner.start("work", lambda: gate.wait(30))
    with pytest.raises(jobs.Busy):
        runner.start("work", lambda: None)
    gate.set()
    first.thread.join(30)
    assert first.state == "done" and first.result is True
    bad = runner.start("work", lambda: 1 / 0)
    bad.thread.join(30)
    assert bad.state == "failed" and not runner.cancel("work")
    begun = threading.Event()

    def long():
        begun.set()
        return spark.range(1 << 40).repartition(4).agg(F.sum(F.sqrt("id"))).collect()

    slow = runner.start("slow", long)
    begun.wait(30)
    import time

    time.sleep(3)
    assert runner.cancel("slow")
    slow.thread.join(60)
    assert slow.state == "cancelled" and not slow.thread.is_alive()


@pytest.mark.skipif(images.pillow() is None, reason="Pillow is not installed")
def test_thumbnails_with_pillow():
    assert images.decode(images.thumbnail(picture(1, 800, 1000))).shape[1] == images.THUMB_SIZE


def test_pointers_of_any_type_are_no_error(order="<"):
    from silverleaf.functions import exif

    for kind, raw in ((2, b"ab\0\0"), (11, struct.pack("<f", 8.0)), (5, struct.pack("<I", 8)), (7, b"\x01\x02\x03\x04")):
        entry = struct.pack("<HHI", 0x8769, kind, 4 if kind in (2, 7) else 1) + raw
        block = b"II*\0" + struct.pack("<IH", 8, 1) + entry + bytes(40)
        assert exif.document(block) is None or isinstance(exif.document(block), str)


def test_only_new_pictures_are_opened(spark, tmp_path, monkeypatch):
    root = tmp_path / "photos"
    root.mkdir()
    for k in range(3):
        (root / f"{k}.jpg").write_bytes(b"x" * (k + 1))
    (root / "film.mp4").write_bytes(b"film")
    (root / "0.jpg.supplemental-metadata.json").write_text("{}")
    asked = []
    plain = scan.opened
    monkeypatch.setattr(scan, "opened", lambda s, r, wanted: asked.append(sorted(x["relpath"] for x in wanted.collect())) or plain(s, r, wanted))
    lib = Library(spark, str(tmp_path / "lib"))
    late = 4_000_000_000
    ingest.index(lib, str(root), late)
    (root / "3.jpg").write_bytes(b"new")
    (root / "1.jpg").write_bytes(b"longer now")
    ingest.index(lib, str(root), late)
    assert asked == [["0.jpg", "1.jpg", "2.jpg"], ["1.jpg", "3.jpg"]]
    assert lib.read("assets").filter("sha256 IS NULL").count() == 0 and lib.read("assets").select("sha256").distinct().count() == 4


def test_scoring_opens_what_lacks_a_score(spark, tmp_path, monkeypatch):
    root = tmp_path / "photos"
    root.mkdir()
    for k in range(2):
        (root / f"{k}.gif").write_bytes(picture(k))
    lib = Library(spark, str(tmp_path / "lib"))
    ingest.index(lib, str(root), 1)
    assert jobs.score_images(lib, str(root), media.SimpleScorer, 2) == (2, 2)
    (root / "2.gif").write_bytes(picture(7))
    ingest.index(lib, str(root), 3)
    asked = []
    plain = scan.opened
    monkeypatch.setattr(scan, "opened", lambda s, r, wanted: asked.append(wanted.count()) or plain(s, r, wanted))
    assert jobs.score_images(lib, str(root), media.SimpleScorer, 4) == (1, 1) and asked == [1]


def test_a_write_never_loses_anothers(spark, tmp_path):
    from silverleaf import catalog

    root, tag = str(tmp_path / "lib"), "id long, term string, created_at long"
    one, two = Library(spark, root), Library(spark, root)
    for lib, k in ((one, 1), (two, 2)):
        lib.held = lib.read("clip_user_tags").unionByName(spark.createDataFrame([(k, f"t{k}", k)], tag))
    one.write("clip_user_tags", one.held)
    with pytest.raises(catalog.Stale):
        two.write("clip_user_tags", two.held)
    two.write("clip_user_tags", two.read("clip_user_tags").unionByName(spark.createDataFrame([(2, "t2", 2)], tag)))
    assert sorted(r["term"] for r in one.read("clip_user_tags").collect()) == ["t1", "t2"]
    fs, claim = one._path(f"clip_user_tags/_markers/{3:012d}")  # a writer that died between claim and snapshot
    fs.createNewFile(claim)
    with pytest.raises(catalog.Stale):
        one.write("clip_user_tags", one.read("clip_user_tags"))
    fs.setTimes(claim, 1000, -1)
    one.write("clip_user_tags", one.read("clip_user_tags").filter("id = 1"))
    assert [r["term"] for r in two.read("clip_user_tags").collect()] == ["t1"]
