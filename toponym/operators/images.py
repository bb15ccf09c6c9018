"""Images as rows of Spark's binaryFile source, with the limits on what is taken, and the parameters of a recognition request."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .recognised import MODES

#: Limits of an image, page segmentation modes, and defaults. (Fixed values.)
MOST_MB = 20
MOST_PIXELS = 40_000_000
SEGMENTATION = (3, 6, 11, 12)
LANGUAGE = "rus+eng"


@dataclass(frozen=True)
class RecognitionRequest:
    """The parameters of a request; what is wrong with them raises ValueError."""

    preprocess: str = "auto"
    deskew: bool = True
    psm: int = 11
    lang: str = LANGUAGE
    include_alternatives: bool = False

    def __post_init__(self) -> None:
        if self.preprocess not in (*MODES, "auto"):
            raise ValueError(f"preprocess has to be one of {', '.join((*MODES, 'auto'))}")
        if self.psm not in SEGMENTATION:
            raise ValueError(f"psm has to be one of {', '.join(map(str, SEGMENTATION))}")
        if not 2 <= len(self.lang) <= 64:
            raise ValueError("lang has to have 2 to 64 characters")


def _number(content: Column, first: Column | int, size: int, little: bool = False) -> Column:
    """The unsigned number in `size` bytes from the place `first`, counted from 1."""
    digits = F.hex(F.substring(content, F.lit(first) if isinstance(first, int) else first.cast("int"), F.lit(size)))
    if little:
        digits = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1)))
    return F.conv(digits, 16, 10).cast("long")


#: Segments of a JPEG file that are walked at first; a file with more is walked again to its end.
SEGMENTS = 256
#: JPEG markers without a length, markers of frames, and those after which no frame comes. (Fixed values.)
_ALONE = (0x01, *range(0xD0, 0xD9))
_FRAME = tuple(m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC))
_END = (0xD9, 0xDA)


def _jpeg_pixels(content: Column) -> Column:
    """Width times height of the first frame header, found by walking from segment to segment; null without one."""
    length = F.octet_length(content)

    def step(state: Column, _: Column) -> Column:
        at, code = state["at"], _number(content, state["at"] + 1, 1)
        to = lambda place, pixels, done: F.struct(place.cast("long").alias("at"), pixels.cast("long").alias("pixels"), done.alias("done"))
        stop, go, none = F.lit(True), F.lit(False), F.lit(None)
        frame = to(at, _number(content, at + 5, 2) * _number(content, at + 7, 2), stop)
        walk = F.when((at + 3 > length) | (_number(content, at, 1) != 0xFF), to(at, none, stop)).when(code == 0xFF, to(at + 1, none, go)).when(code.isin(*_ALONE), to(at + 2, none, go))
        walk = walk.when(code.isin(*_FRAME), F.when(at + 8 > length, to(at, none, stop)).otherwise(frame)).when(code.isin(*_END), to(at, none, stop))
        return F.when(state["done"], state).otherwise(walk.otherwise(to(at + 2 + F.greatest(_number(content, at + 2, 2), F.lit(2)), none, go)))

    start = F.struct(F.lit(3).cast("long").alias("at"), F.lit(None).cast("long").alias("pixels"), F.lit(False).alias("done"))
    walked = lambda n: F.aggregate(F.sequence(F.lit(1), n), start, step)
    short = walked(F.lit(SEGMENTS))
    # each step goes on by a byte at least
    return F.when(short["done"], short["pixels"]).otherwise(walked(F.greatest(length, F.lit(1)))["pixels"])


def _tiff_pixels(content: Column, little: bool) -> Column:
    """Width times height by the tags 256 and 257 of the first directory; null without them."""
    at = _number(content, 5, 4, little) + 1
    count = F.coalesce(_number(content, at, 2, little), F.lit(0))
    entries = F.when((count > 0) & (at + 1 + 12 * count <= F.octet_length(content)), F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: at + 2 + 12 * i))
    # a value of two bytes stands at the left of its field
    value = lambda e: F.when(_number(content, e + 2, 2, little) == 3, _number(content, e + 8, 2, little)).otherwise(_number(content, e + 8, 4, little))
    tag = lambda n: F.get(F.transform(F.filter(entries, lambda e: _number(content, e, 2, little) == n), value), F.lit(0))
    return tag(256) * tag(257)


def _bmp_pixels(content: Column) -> Column:
    """Width times height; headers of 12 bytes have numbers of two bytes, later ones may have a negative height."""
    short = _number(content, 15, 4, True) == 12
    signed = lambda n: F.least(n, F.lit(1 << 32) - n)
    return F.when(short, _number(content, 19, 2, True) * _number(content, 21, 2, True)).otherwise(signed(_number(content, 19, 4, True)) * signed(_number(content, 23, 4, True)))


def pixels(content: Column) -> Column:
    """Width times height by the header of a JPEG, PNG, BMP or TIFF file; null where the header has none."""
    first, length = F.hex(F.substring(content, 1, 8)), F.octet_length(content)
    kinds = F.when(first.startswith("FFD8FF"), _jpeg_pixels(content)).when((first == "89504E470D0A1A0A") & (length >= 24), _number(content, 17, 4) * _number(content, 21, 4)).when(first.startswith("424D") & (length >= 26), _bmp_pixels(content))
    return kinds.when(first.startswith("49492A00") & (length >= 8), _tiff_pixels(content, True)).when(first.startswith("4D4D002A") & (length >= 8), _tiff_pixels(content, False))


def otsu_thresholds(pixels: DataFrame, key: str = "image_id", gray: str = "gray") -> DataFrame:
    """(key, threshold) by Otsu's method from one row for each pixel, gray from 0 to 255: the level whose parting of the histogram has the largest variance between both sides, of level ones the lowest; 0 where one level is all.

    Levels are counted in the tasks first, so that at most 256 rows of an image are shuffled by each; a fold over the 256 levels finds the best. Null pixels do not count; an image of null pixels only has 0.
    """
    counts = pixels.groupBy(key, gray).count()
    of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    level = F.when(F.col(gray).isNotNull(), F.struct(F.col(gray).cast("int").alias("k"), F.col("count").alias("n")))
    image = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(level)).alias("bins"), of(F.when(F.col(gray).isNotNull(), F.col("count"))).alias("n"), of(F.col(gray).cast("long") * F.col("count")).alias("total"))
    state = lambda w, s, best, at: F.struct(w.cast("long").alias("w"), s.cast("long").alias("s"), best.cast("double").alias("best"), at.cast("int").alias("at"))

    def step(a: Column, k: Column) -> Column:
        n = F.coalesce(F.try_element_at("bins", k), F.lit(0))
        w, s = a["w"] + n, a["s"] + k * n
        apart = s.cast("double") * F.col("n") - F.col("total").cast("double") * w
        between = F.when((w > 0) & (w < F.col("n")), apart * apart / (w.cast("double") * (F.col("n") - w))).otherwise(F.lit(0.0))
        return F.when(between > a["best"], state(w, s, between, k)).otherwise(state(w, s, a["best"], a["at"]))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(255)), state(F.lit(0), F.lit(0), F.lit(0.0), F.lit(0)), step)
    return image.select(key, found["at"].alias("threshold"))


def binarised(pixels: DataFrame, key: str = "image_id", gray: str = "gray") -> DataFrame:
    """pixels with `white`: 255 above its image's threshold, else 0. Thresholds are one row for each image."""
    return pixels.join(otsu_thresholds(pixels, key, gray), key, "left").withColumn("white", F.when(F.col(gray) > F.col("threshold"), 255).when(F.col(gray).isNotNull(), 0))


#: Side of the neighbourhood and what a pixel may be darker than its mean by. (Fixed values.)
BLOCK, DARKER = 35, 11


def gaussian_weights(block: int = BLOCK) -> list[int]:
    """Weights of the places -block // 2 .. block // 2 in 65536ths, whose sum is 65536; what rounding leaves goes to the middle."""
    half = block // 2
    sigma = 0.3 * (half - 1) + 0.8
    bell = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-half, half + 1)]
    out = [round(b / sum(bell) * 65536) for b in bell]
    out[half] += 65536 - sum(out)
    return out


def adaptive(pixels: DataFrame, key: str = "image_id", row: str = "row", col: str = "col", gray: str = "gray", block: int = BLOCK, darker: int = DARKER) -> DataFrame:
    """pixels with `white`: 255 where gray is above the weighted mean of its neighbourhood less `darker`, else 0.

    One row for each pixel. The weights are a product, so lines of an image are summed along rows and then along columns: each task sorts some lines of some images, and a large image is many tasks' work.
    Beyond the border its last pixel goes on. Sums are whole numbers, means are rounded half up. Null pixels count as 255 for their neighbours and have no `white`; a line's pixels count as neighbours in the order
    of their places, so a missing pixel closes up; pixels that repeat a place are neighbours in no set order. Rows without an image are an image.
    """
    half, weights = block // 2, gaussian_weights(block)

    def along(c: Column, line: str, place: str) -> Column:
        w = Window.partitionBy(key, line).orderBy(place)
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(c).over(every), F.last(c).over(every)
        total = c * weights[half]
        for d in range(1, half + 1):
            total = total + (F.coalesce(F.lag(c, d).over(w), first) + F.coalesce(F.lead(c, d).over(w), last)) * weights[half + d]
        return total

    rows = pixels.withColumn("__rows", along(F.coalesce(F.col(gray).cast("long"), F.lit(255).cast("long")), row, col))
    rows = rows.withColumn("__both", along(F.col("__rows"), col, row))
    mean = F.shiftright(F.col("__both") + (1 << 31), 32)
    return rows.withColumn("white", F.when(F.col(gray) > mean - darker, 255).when(F.col(gray).isNotNull(), 0)).drop("__rows", "__both")


#: Dark pixels that an estimate needs, and degrees between which an image is turned. (Fixed values.)
FEWEST, LEAST_ANGLE, MOST_ANGLE = 100, 0.2, 15.0
#: Rows of an image whose hull is found by itself.
BAND = 256
_CHAIN = "array<struct<x:bigint,y:bigint>>"


def _chain(points: Column, side: int) -> Column:
    """The convex chain at the left (side -1) or right (1) of points in the order of y: of the points so far, those stay that the new one leaves on the outer side."""

    def outer(before: Column, b: Column, p: Column) -> Column:
        return ((b["x"] - before["x"]) * (p["y"] - before["y"]) - (b["y"] - before["y"]) * (p["x"] - before["x"])) * side > 0

    def step(chain: Column, p: Column) -> Column:
        # along a convex chain the turn towards p changes its sign once, so testing all of it is the same as taking away from its end
        return F.concat(F.filter(chain, lambda b, i: (i == 0) | outer(F.get(chain, i - 1), b, p)), F.array(p))

    return F.aggregate(points, F.array().cast(_CHAIN), step)


def hulls(points: DataFrame, key: str = "image_id", row: str = "row", col: str = "col") -> DataFrame:
    """(key, n, hull): how many points an image has, and the corners of their convex hull around it, array<struct<x, y>>.

    Of each row of an image only its first and last point can be corners, so tasks send two numbers for each. Bands of BAND rows have hulls of their own, and an image's hull is the hull of those: no row of
    the plan holds an image's points. Points without a place do not count.
    """
    placed = points.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    ends = placed.groupBy(key, F.col(row).cast("long").alias("y")).agg(F.min(col).cast("long").alias("lo"), F.max(col).cast("long").alias("hi"), F.count("*").alias("n"))
    point = lambda x: F.struct(F.col(x).alias("x"), F.col("y"))
    own = ends.groupBy(key, F.floor(F.col("y") / BAND).alias("band")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("y", point("lo").alias("lo"), point("hi").alias("hi")))).alias("ends"))
    bands = own.select(key, "band", "n", _chain(F.col("ends.lo"), -1).alias("left"), _chain(F.col("ends.hi"), 1).alias("right"))
    image = bands.groupBy(key).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("band", "left", "right"))).alias("bands"))
    sides = image.select(key, "n", _chain(F.flatten("bands.left"), -1).alias("left"), _chain(F.flatten("bands.right"), 1).alias("right"))
    return sides.select(key, "n", F.array_distinct(F.concat("left", F.reverse("right"))).alias("hull"))


def skew_angles(pixels: DataFrame, key: str = "image_id", row: str = "row", col: str = "col", gray: str = "gray") -> DataFrame:
    """(key, n_dark, angle) for each image: the degrees by which it is to be turned, 0.0 for an image that stays as it is.

    Dark pixels are those not above the image's threshold. The smallest rectangle around them lies along an edge of their hull; of equal ones that with the smallest angle counts, from above 0 to 90 degrees, and the
    image is turned back by it if it is one of LEAST_ANGLE to MOST_ANGLE degrees. Images of fewer than FEWEST dark pixels, or whose dark pixels are all in one place, stay. Null pixels are not dark.
    """
    dark = binarised(pixels, key, gray).where("white = 0")
    found = hulls(dark, key, row, col)
    size = F.size("hull")

    def edge(a: Column, i: Column) -> Column:
        b = F.get("hull", (i + 1) % size)
        return F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))

    def span(dx: Column, dy: Column) -> Column:
        along = F.transform("hull", lambda p: p["x"] * dx + p["y"] * dy)
        return F.array_max(along) - F.array_min(along)

    def rectangle(e: Column) -> Column:
        dx, dy = e["dx"], e["dy"]
        area = span(dx, dy).cast("double") * span(-dy, dx) / (dx * dx + dy * dy)
        # by quarter turns into the first quadrant, where a straight one has 90 degrees
        u = F.when((dx > 0) & (dy >= 0), dx).when((dx <= 0) & (dy > 0), dy).when((dx < 0) & (dy <= 0), -dx).otherwise(-dy)
        v = F.when((dx > 0) & (dy >= 0), dy).when((dx <= 0) & (dy > 0), -dx).when((dx < 0) & (dy <= 0), -dy).otherwise(dx)
        return F.struct(area.alias("area"), F.when(v == 0, 90.0).otherwise(F.degrees(F.atan2(v.cast("double"), u.cast("double")))).alias("angle"))

    edges = found.select(key, "n", "hull", F.filter(F.transform("hull", edge), lambda e: (e["dx"] != 0) | (e["dy"] != 0)).alias("edges"))
    least = edges.select(key, "n", F.array_min(F.transform("edges", rectangle))["angle"].alias("rect"))
    turn = F.when((F.col("n") >= FEWEST) & F.col("rect").between(LEAST_ANGLE, MOST_ANGLE), F.round(-F.col("rect"), 3)).otherwise(F.lit(0.0))
    every = pixels.select(key).distinct()
    return every.join(least.withColumn("angle", turn), key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n_dark"), F.coalesce("angle", F.lit(0.0)).alias("angle"))


def known_format(content: Column) -> Column:
    """Whether the first bytes are those of a JPEG, PNG, BMP or TIFF file."""
    first = F.hex(F.substring(content, 1, 8))
    return first.startswith("FFD8FF") | (first == "89504E470D0A1A0A") | first.startswith("424D") | first.startswith("49492A00") | first.startswith("4D4D002A")


def checked(files: DataFrame, most_mb: int = MOST_MB, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """files (path, length, content and others) with `status`: 413 too large, 400 empty, 415 no image, 413 too many pixels, else 200. A header without a size, which only a decoder can judge, is let through."""
    large = F.col("length") > most_mb * 1024 * 1024
    status = F.when(large, 413).when(F.col("length") == 0, 400).when(~known_format(F.col("content")), 415).when(F.coalesce(F.col("__pixels") > most_pixels, F.lit(False)), 413).otherwise(200)
    return files.withColumn("__pixels", F.when(~large, pixels(F.col("content")))).withColumn("status", status.cast("int")).drop("__pixels")


def read_images(spark: SparkSession, path: str, most_mb: int = MOST_MB, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """The images of a folder: path, length, content, status. The content of files that are too large is not read: the limit on length is pushed to the source. Spark's file sources leave out empty files."""
    source = spark.read.format("binaryFile").load(path)
    small = source.where(F.col("length") <= most_mb * 1024 * 1024).select("path", "length", "content")
    large = source.where(F.col("length") > most_mb * 1024 * 1024).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return checked(small.unionByName(large), most_mb, most_pixels)
