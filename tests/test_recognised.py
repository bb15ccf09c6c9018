import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from toponym.operators import images
from toponym.operators import recognised as r

SCHEMA = "image_id long, mode string, idx int, text string, conf string, left int, top int, width int, height int, block_num int, par_num int, line_num int"


def test_lines_documents_best(spark):
    rows = [
        (1, "gray", 0, "later", "90", 5, 5, 10, 4, 1, 1, 2), (1, "gray", 1, " b ", "150", 10, 0, 4, 4, 1, 1, 1), (1, "gray", 2, "cc", "50", 0, 2, 4, 9, 1, 1, 1),
        (1, "gray", 3, " ", "99", 0, 0, 1, 1, 1, 1, 1), (1, "gray", 4, "no", "-1", 0, 0, 1, 1, 1, 1, 1), (1, "gray", 5, "no", "x", 0, 0, 1, 1, 1, 1, 1), (1, "gray", 6, None, "50", 0, 0, 1, 1, 1, 1, 1),
        (1, "otsu", 0, "zzzzzzzzzzz", "83.75", 0, 0, 1, 1, 1, 1, 1), (2, "gray", 0, "", "10", 0, 0, 1, 1, 1, 1, 1), (2, "otsu", 0, "no", None, 0, 0, 1, 1, 1, 1, 1),
    ]
    words = spark.createDataFrame(rows, SCHEMA)
    lines = r.lines(r.kept_words(words))
    got = {(x["image_id"], x["mode"], x["line_num"]): (x["text"], x["x"], x["y"], x["width"], x["height"]) for x in lines.collect()}
    assert got == {(1, "gray", 1): ("b cc", 0, 0, 14, 11), (1, "gray", 2): ("later", 5, 5, 10, 4), (1, "otsu", 1): ("zzzzzzzzzzz", 0, 0, 1, 1)}
    docs = r.documents(lines, words)
    found = {(x["image_id"], x["mode"]): (x["text"], x["conf_e4"], x["n_lines"]) for x in docs.collect()}
    assert found == {(1, "gray"): ("b cc\nlater", 8125, 2), (1, "otsu"): ("zzzzzzzzzzz", 8375, 1), (2, "gray"): ("", 0, 0), (2, "otsu"): ("", 0, 0)}
    assert {(x["image_id"], x["mode"]) for x in r.best_attempt(docs).collect()} == {(1, "otsu"), (2, "gray")}
    assert {x["image_id"]: [a["mode"] for a in x["alternatives"]] for x in r.alternatives(docs).collect()} == {1: ["gray", "otsu"], 2: ["gray", "otsu"]}
    assert [x["mode"] for x in r.attempts_as_rows(spark.range(1), "auto").collect()] == ["gray", "otsu"]
    assert r.lines(r.kept_words(words.limit(0))).isEmpty()


def test_attempts_need_no_shuffle(spark):
    rnd = random.Random(2)
    rows = [
        (i, mode, k, rnd.choice(["a", " bb\t", "", " ", None, "ccc"]), rnd.choice(["90", "12.345", "-1", "x", None, "150"]), rnd.randrange(50), rnd.randrange(50), rnd.randrange(9), rnd.randrange(9), *(rnd.choice([1, 2, None]) for _ in range(3)))
        for i in range(12) for mode in ("gray", "otsu") for k in range(rnd.randrange(40))
    ]
    words = spark.createDataFrame(rows, SCHEMA)
    attempts = words.groupBy("image_id", "mode").agg(F.collect_list(F.struct(*words.columns[2:])).alias("words")).localCheckpoint()
    empty = spark.createDataFrame([(99, "gray")], "image_id long, mode string").withColumn("words", F.lit(None).cast(attempts.schema["words"].dataType))
    lines, docs = r.attempt_lines(attempts.unionByName(empty)), r.attempt_documents(attempts.unionByName(empty))
    expected = r.lines(r.kept_words(words))
    as_set = lambda df: {tuple(x[c] for c in sorted(df.columns)) for x in df.collect()}
    assert sorted(lines.columns) == sorted(expected.columns) and as_set(lines) == as_set(expected)
    assert as_set(docs) == as_set(r.documents(expected, words.unionByName(empty.drop("words"), allowMissingColumns=True)))
    assert not any("Exchange" in df._jdf.queryExecution().executedPlan().toString() for df in (lines, docs))


def test_rounding_is_by_the_binary_value(spark):
    rnd = random.Random(1)
    values = [k / 20000 for k in range(1, 20000, 7)] + [rnd.random() for _ in range(500)] + [0.0, 1.0, 0.87345, 0.5 / 10000, 1.5 / 10000]
    values += [round(rnd.randrange(100005) / 1000, 3) / 100 for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values if v <= 1], "x double").select("x", r.round4(F.col("x")).alias("e4")).collect()
    assert all(x["e4"] / 10000 == round(x["x"], 4) for x in rows)


def test_times(spark):
    rows = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, None), (2, None)], "image_id long, ocr_ms double")
    assert {x["image_id"]: (x["ocr_ms"], x["attempts"]) for x in r.times(rows).collect()} == {1: (0.3, 3), 2: (0.0, 1)}


def test_requests():
    assert images.RecognitionRequest() == images.RecognitionRequest("auto", True, 11, "rus+eng", False)
    for wrong in ({"psm": 4}, {"preprocess": "blur"}, {"lang": "x"}, {"lang": "x" * 65}):
        with pytest.raises(ValueError):
            images.RecognitionRequest(**wrong)


def test_image_source(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 8000, 6000) + b"\x08\2\0\0\0"
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 640, 480)
    for name, data in {"a.png": png, "b.bmp": bmp, "c.jpg": b"\xff\xd8\xff\xe0xx", "d.txt": b"text", "f.tif": b"II*\0" + b"x" * 1_200_000}.items():
        (tmp_path / name).write_bytes(data)
    status = lambda **k: {x["path"][-5:].split("/")[-1]: x["status"] for x in images.read_images(spark, str(tmp_path), **k).collect()}
    assert status() == {"a.png": 413, "b.bmp": 200, "c.jpg": 200, "d.txt": 415, "f.tif": 200}
    assert status(most_mb=1, most_pixels=10**9) == {"a.png": 200, "b.bmp": 200, "c.jpg": 200, "d.txt": 415, "f.tif": 413}


def test_pixels_by_headers(spark):
    jpeg = lambda *parts: b"\xff\xd8" + b"".join(parts)
    frame = b"\xff\xc2\x00\x11\x08" + (300).to_bytes(2, "big") + (400).to_bytes(2, "big") + b"\x03" + b"\0" * 9
    segment = b"\xff\xe1" + (1002).to_bytes(2, "big") + b"\xff\xc0" * 500
    entry = lambda order, tag, kind, value: b"".join(x.to_bytes(n, order) for x, n in ((tag, 2), (kind, 2), (1, 4))) + (value.to_bytes(4, order) if kind == 4 else value.to_bytes(2, order) + b"\0\0")
    tiff = lambda order, *entries: (b"II*\0" if order == "little" else b"MM\0*") + (12).to_bytes(4, order) + b"junk" + len(entries).to_bytes(2, order) + b"".join(entries)
    bmp = lambda size, *n: b"BM" + b"\0" * 12 + size.to_bytes(4, "little") + b"".join(n) + b"\0" * 8
    four = lambda n: n.to_bytes(4, "little", signed=True)
    cases = [
        (jpeg(segment, frame), 120_000), (jpeg(*[segment] * 300, frame), 120_000), (jpeg(b"\xff\xff\xff", frame[1:]), 120_000), (jpeg(b"\xff\xda\0\2", frame), None), (jpeg(segment), None), (jpeg(frame[:6]), None), (jpeg(b"\xff"), None),
        (jpeg(b"\xff\xd0", b"\xff\xe0\0\0", frame), 120_000), (tiff("little", entry("little", 254, 4, 0), entry("little", 256, 3, 700), entry("little", 257, 4, 9000)), 6_300_000),
        (tiff("big", entry("big", 256, 4, 70_000), entry("big", 257, 3, 80)), 5_600_000), (tiff("big", entry("big", 256, 3, 5)), None), (tiff("little")[:9], None), (tiff("little", entry("little", 256, 3, 5))[:20], None),
        (bmp(40, four(7), four(-9)), 63), (bmp(12, (7).to_bytes(2, "little"), (9).to_bytes(2, "little")), 63), (b"\x89PNG\r\n\x1a\n" + b"\0" * 4, None), (b"", None), (None, None),
    ]
    df = spark.createDataFrame([(i, c and bytearray(c), len(c or b"")) for i, (c, _) in enumerate(cases)], "i int, content binary, length long")
    got = df.select("i", images.pixels(F.col("content")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [n for _, n in cases]
    status = {r["i"]: r["status"] for r in images.checked(df.where("content is not null"), most_pixels=100_000).collect()}
    assert status[0] == 413 and status[4] == 200 and status[13] == 200 and status[16] == 400


def test_otsu_of_odd_images(spark):
    rows = [(1, g) for g in [10] * 5 + [200] * 3] + [(2, 7)] * 4 + [(3, None)] + [(4, g) for g in range(256)] + [(5, 0), (5, 255), (5, None)]
    pixels = spark.createDataFrame(rows, "image_id int, gray int")
    assert {r["image_id"]: r["threshold"] for r in images.otsu_thresholds(pixels).collect()} == {1: 10, 2: 0, 3: 0, 4: 127, 5: 0}
    assert {(r["gray"], r["white"]) for r in images.binarised(pixels).where("image_id in (1, 3)").collect()} == {(10, 0), (200, 255), (None, None)}


def _own_adaptive(image, block, darker):
    """White or not by a double loop over whole neighbourhoods; None is a pixel without a value."""
    half, weights = block // 2, images.gaussian_weights(block)
    at = lambda y, x: 255 if image[y][x] is None else image[y][x]
    inside = lambda k, n: min(max(k, 0), n - 1)
    out = {}
    for y, line in enumerate(image):
        for x, g in enumerate(line):
            total = sum(weights[half + i] * weights[half + j] * at(inside(y + i, len(image)), inside(x + j, len(line))) for i in range(-half, half + 1) for j in range(-half, half + 1))
            out[y, x] = None if g is None else 255 if g > ((total + (1 << 31)) >> 32) - darker else 0
    return out


@pytest.mark.parametrize("block", [3, 7, 35])
def test_adaptive_threshold(spark, block):
    rnd = random.Random(block)
    made = {1: [[rnd.choice((0, 40, 200, 255)) for _ in range(9)] for _ in range(6)], 2: [[rnd.randrange(256)]], 3: [[rnd.choice((None, 10, 240)) for _ in range(4)] for _ in range(11)], 4: [[90] * 40]}
    rows = [(k, y, x, g) for k, image in made.items() for y, line in enumerate(image) for x, g in enumerate(line)]
    pixels = spark.createDataFrame(rows, "image_id int, row int, col int, gray int")
    got = {(r["image_id"], r["row"], r["col"]): r["white"] for r in images.adaptive(pixels, block=block, darker=5).collect()}
    assert got == {(k, y, x): w for k, image in made.items() for (y, x), w in _own_adaptive(image, block, 5).items()}
    assert images.adaptive(pixels.limit(0)).isEmpty() and sum(images.gaussian_weights(block)) == 65536


def _own_angle(points):
    """Smallest rectangle over all directions between two points that have all others on one side."""
    best = None
    for ax, ay in points:
        for bx, by in points:
            dx, dy = bx - ax, by - ay
            if not (dx or dy) or any(dx * (y - ay) - dy * (x - ax) < 0 for x, y in points):
                continue
            along, across = [x * dx + y * dy for x, y in points], [y * dx - x * dy for x, y in points]
            area = Fraction((max(along) - min(along)) * (max(across) - min(across)), dx * dx + dy * dy)
            while not (dx > 0 and dy >= 0):
                dx, dy = dy, -dx
            best = min(best or (area, 91.0), (area, math.degrees(math.atan2(dy, dx)) or 90.0))
    return best and best[1]


def test_skew_angles(spark, monkeypatch):
    monkeypatch.setattr(images, "BAND", 8)  # many bands
    rnd = random.Random(3)
    dark = {
        1: {(x, y) for x in range(60) for y in range(60) if abs(10 * (y - 30) - (x - 30)) <= 60},  # about 6 degrees
        2: {(x, y) for x in range(30) for y in range(5)},  # straight
        3: {(x, y) for x in range(40) for y in range(40) if abs(y - 20 - (x - 20)) <= 3},  # 45 degrees
        4: {(5, 5), (6, 7)},  # too few
        5: {(x, 9) for x in range(120)}, 6: {(9, y) for y in range(120)},  # lines
        8: {(x, y) for x in range(50) for y in range(50) if abs(8 * (y - 25) + (x - 25)) <= 50},  # the other way
    }
    dark |= {k: {(rnd.randrange(45), rnd.randrange(70)) for _ in range(150)} for k in range(10, 16)}
    rows = [(k, y, x, 20) for k, p in dark.items() for x, y in p] + [(k, 300, 300, 250) for k in dark] + [(7, 1, 1, None), (9, None, 3, 20), (9, 1, 1, 250)]
    rows += rows[:50]  # repeated rows count for the number only
    pixels = spark.createDataFrame(rows, "image_id int, row int, col int, gray int")
    got = {r["image_id"]: r["angle"] for r in images.skew_angles(pixels).collect()}
    corners = {r["image_id"]: {(p["x"], p["y"]) for p in r["hull"]} for r in images.hulls(pixels.where("gray = 20")).collect()}
    for k, points in dark.items():
        assert corners[k] <= points
        rect = _own_angle(sorted(corners[k]))
        ends = {(f([x for x, b in points if b == y]), y) for y in {y for _, y in points} for f in (min, max)}
        assert rect == _own_angle(sorted(ends))
        assert got[k] == (round(-rect, 3) if len(points) >= 100 and 0.2 <= rect <= 15 else 0.0)
    assert -6.5 < got[1] < -5 and got[2] == got[3] == got[4] == got[5] == got[6] == got[8] == got[7] == got[9] == 0.0
    assert images.skew_angles(pixels.limit(0)).isEmpty()
