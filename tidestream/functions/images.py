"""Functions of images as pandas UDFs: correction, measurement, positions, classes, drawings.

Images stay encoded in their column; each function decodes what it needs within its batch.
"""

import functools
import struct
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidestream import schemas as S
from tidestream.functions import shapes, tiff
from tidestream.functions.labels import LABEL_KEYS
from tidestream.functions.scalars import GRAY

#: A scorer makes model outputs (images x labels) of a batch (images x channels x side x side, 0 to 1), which it must not keep. If it has an
#: attribute `most`, it is given no more images than that at a time.
Scorer = Callable[[np.ndarray], np.ndarray]
SIDE = 256
#: Images that are decoded at a time.
BATCH = 255

# Names of the tags of TIFF and EXIF files by their numbers.
TAG_NAMES = {
    254: "NewSubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 266: "FillOrder",
    269: "DocumentName", 270: "ImageDescription", 271: "Make", 272: "Model", 273: "StripOffsets", 274: "Orientation", 277: "SamplesPerPixel", 278: "RowsPerStrip",
    279: "StripByteCounts", 282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration", 285: "PageName", 296: "ResolutionUnit", 297: "PageNumber",
    301: "TransferFunction", 305: "Software", 306: "DateTime", 315: "Artist", 316: "HostComputer", 317: "Predictor", 318: "WhitePoint", 319: "PrimaryChromaticities",
    320: "ColorMap", 322: "TileWidth", 323: "TileLength", 324: "TileOffsets", 325: "TileByteCounts", 338: "ExtraSamples", 339: "SampleFormat", 529: "YCbCrCoefficients",
    530: "YCbCrSubSampling", 531: "YCbCrPositioning", 532: "ReferenceBlackWhite", 700: "XMLPacket", 33432: "Copyright", 33434: "ExposureTime", 33437: "FNumber",
    34665: "ExifOffset", 34853: "GPSInfo", 34855: "ISOSpeedRatings", 36864: "ExifVersion", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 37377: "ShutterSpeedValue",
    37378: "ApertureValue", 37380: "ExposureBiasValue", 37383: "MeteringMode", 37385: "Flash", 37386: "FocalLength", 37500: "MakerNote", 37510: "UserComment",
    40960: "FlashPixVersion", 40961: "ColorSpace", 40962: "ExifImageWidth", 40963: "ExifImageHeight", 41729: "SceneType", 41986: "ExposureMode", 41987: "WhiteBalance",
}
GPS_TAG_NAMES = {
    0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp",
    8: "GPSSatellites", 9: "GPSStatus", 10: "GPSMeasureMode", 11: "GPSDOP", 12: "GPSSpeedRef", 13: "GPSSpeed", 14: "GPSTrackRef", 15: "GPSTrack",
    16: "GPSImgDirectionRef", 17: "GPSImgDirection", 18: "GPSMapDatum", 19: "GPSDestLatitudeRef", 20: "GPSDestLatitude", 21: "GPSDestLongitudeRef",
    22: "GPSDestLongitude", 23: "GPSDestBearingRef", 24: "GPSDestBearing", 25: "GPSDestDistanceRef", 26: "GPSDestDistance", 27: "GPSProcessingMethod",
    28: "GPSAreaInformation", 29: "GPSDateStamp", 30: "GPSDifferential", 31: "GPSHPositioningError",
}


def corrected(data: bytes, image: tiff.Tiff | None = None) -> np.ndarray:
    """The image's pixels less the row of background that follows its file: each column is raised to white by what its
    background lacks. Without a whole row, the image stays as it is. image: data, if it has been read."""
    image = image or tiff.Tiff(data)
    pixels = image.pixels()
    n = pixels.shape[1] * pixels.shape[2]
    row = data[image.end : image.end + n]
    if len(row) < n:
        return pixels
    lacking = ~np.frombuffer(row, np.uint8).reshape(1, *pixels.shape[1:])
    return pixels - np.minimum(pixels, lacking)


def plain(pixels: np.ndarray) -> np.ndarray:
    """One channel where three are equal: scaled and measured it gives what they do, as their weights in a gray value add up to one."""
    if pixels.shape[2] != 3:
        return pixels
    flat = pixels.ravel()
    unlike = flat[1:] != flat[:-1]
    return pixels[:, :, :1] if np.count_nonzero(unlike) == np.count_nonzero(unlike[2::3]) else pixels


@F.pandas_udf(T.BinaryType())
def background_corrected(payload: pd.Series) -> pd.Series:
    """The image as a file without its tags; null where it cannot be read."""
    return payload.map(lambda x: _or(None, lambda b: tiff.encode(corrected(b)), x))


def _or(default, f, x):
    try:
        return f(bytes(x)) if x is not None else default
    except (ValueError, LookupError, TypeError, ArithmeticError, struct.error, zlib.error):
        return default


_NOTHING = (0.0, 0.0, 0.0, 0.0, 0.0, None)
_NOWHERE = (None, None, None, False)


@F.pandas_udf(S.MEASURES)
def measured(payload: pd.Series) -> pd.DataFrame:
    """All zeros where an image cannot be read or shows nothing."""
    found = []
    for first in range(0, len(payload), BATCH):
        found += shapes.all_measures([_or(None, lambda b: tiff.Tiff(b).pixels(), x) for x in payload.iloc[first : first + BATCH]])
    return pd.DataFrame([x or _NOTHING for x in found], columns=S.MEASURES.names)


def position(data: bytes, image: tiff.Tiff | None = None) -> tuple[float, float, str, bool]:
    tags = image or tiff.of_file(data)
    degrees = lambda v, ref, minus: float(v[0] + v[1] / 60 + v[2] / 3600) * (-1 if ref[:1] == minus else 1)
    return degrees(tags.gps[tiff.LAT], tags.gps[tiff.LAT_REF], "S"), degrees(tags.gps[tiff.LON], tags.gps[tiff.LON_REF], "W"), tags.tags[tiff.DATE_TIME], True


@F.pandas_udf(S.POSITION)
def positioned(payload: pd.Series) -> pd.DataFrame:
    """Nulls and gps_ok false where an image tells no position or time."""
    return pd.DataFrame([_or(_NOWHERE, position, x) for x in payload], columns=S.POSITION.names)


def _exif(data: bytes) -> tuple[int, int, str | None]:
    tags = tiff.of_file(data).tags
    return int(tags[tiff.WIDTH][0]), int(tags[tiff.LENGTH][0]), tags.get(tiff.DATE_TIME)


def _printed(found: dict) -> dict[int, str]:
    return {int(k): v if isinstance(v, str) else " ".join(map(str, v)) if isinstance(v, tuple) else str(v) for k, v in found.items()}


@F.pandas_udf(T.MapType(T.IntegerType(), T.StringType()))
def tags(payload: pd.Series) -> pd.Series:
    """The number and the printed value of each tag of an image; null where it cannot be read."""
    return payload.map(lambda x: _or(None, lambda b: _printed(tiff.of_file(b).tags), x))


@F.pandas_udf(T.MapType(T.IntegerType(), T.StringType()))
def gps_tags(payload: pd.Series) -> pd.Series:
    """The same of an image's position."""
    return payload.map(lambda x: _or(None, lambda b: _printed(tiff.of_file(b).gps), x))


def named_tags(tags: Column, names: dict[int, str] = TAG_NAMES) -> Column:
    """A map of tags with their names in place of their numbers; a number without a known name stands for itself."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(tags, lambda k, _: F.coalesce(F.element_at(known, k), k.cast("string")))


@F.pandas_udf(S.EXIF)
def exif(payload: pd.Series) -> pd.DataFrame:
    frame = pd.DataFrame([_or((None, None, None), _exif, x) for x in payload], columns=S.EXIF.names)
    return frame.astype({"width": "Int64", "length": "Int64"})


# --- classes ---------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=64)
def _spread(n: int, side: int) -> np.ndarray:
    """Weights (side x n) of linear resampling; when shrinking, each output averages over its whole share."""
    scale = n / side
    at = (np.arange(side) + 0.5) * scale - 0.5
    w = np.clip(1 - np.abs(np.arange(n)[None, :] - at[:, None]) / max(scale, 1.0), 0, None)
    return (w / w.sum(1, keepdims=True)).astype(np.float32)


@functools.lru_cache(maxsize=64)
def _between(n: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """When growing: the input before each output, and the share that the next one has in it."""
    weights = _spread(n, side)
    before = (weights > 0).argmax(1)
    return before, 1 - weights[np.arange(side), before][:, None]


def _scaled(rows: np.ndarray, side: int, out: np.ndarray) -> None:
    """Fills out with side rows, resampled from the given ones."""
    n, width = rows.shape
    if n > side or not n:
        np.matmul(_spread(n, side), rows, out=out)
    elif side % n == 0:  # each row gives as many
        each, step = out.reshape(n, side // n, width), rows[1:] - rows[:-1]
        for k in range(side // n):
            share = np.float32((k + 0.5) * n / side - 0.5)
            if share < 0:
                np.add(rows[1:], step * share, out=each[1:, k])
                each[0, k] = rows[0]
            else:
                np.add(rows[:-1], step * share, out=each[:-1, k])
                each[-1, k] = rows[-1]
    else:
        before, share = _between(n, side)
        step = np.zeros_like(rows)
        np.subtract(rows[1:], rows[:-1], out=step[:-1])
        np.multiply(step.take(before, 0, mode="clip"), share, out=out)
        out += rows.take(before, 0, mode="clip")


def model_input(pixels: np.ndarray, gray: bool = False, side: int = SIDE, out: np.ndarray | None = None) -> np.ndarray:
    """3 x side x side floats from 0 to 1; gray: all three channels are the gray value. out: where to write them."""
    image = pixels[:, :, :3].transpose(2, 0, 1).astype(np.float32, order="C") / np.float32(255)
    channels, height, _ = image.shape
    out, wide = np.empty((3, side, side), np.float32) if out is None else out, np.empty((height, side), np.float32)
    for k in range(channels):
        _scaled(image[k].T, side, wide.T)
        _scaled(wide, side, out[k])
    if gray and channels > 1:
        out[0] = np.tensordot(np.array(GRAY, np.float32), out, 1)
    if gray or channels == 1:
        out[1:] = out[0]
    return out


def stand_in_scorer(batch: np.ndarray) -> np.ndarray:
    """Outputs fixed by each image's mean tones and contrast: for tests and plumbing, since no weights are published."""
    tone, ones = np.empty((len(batch), 2 * batch.shape[1]), np.float32), np.ones(batch.shape[2], np.float32)
    for one, (means, deviations) in zip(batch, tone.reshape(len(batch), 2, -1), strict=True):
        for k, channel in enumerate(one):  # one at a time, as differences are copies; sums by rows first
            means[k] = (ones @ channel).sum() / channel.size
            differences = channel - means[k]
            deviations[k] = np.sqrt(np.vecdot(differences, differences).sum() / channel.size)
    weights = np.sin(np.arange(1, tone.shape[1] * len(LABEL_KEYS) + 1, dtype=np.float64)).reshape(tone.shape[1], -1)
    return 8 * tone @ weights


stand_in_scorer.most = 4  # it has no use for more, and inputs stay in the cache


class OnnxScorer:
    """A model file in ONNX form; it is opened once in each Python worker.

    path: a file that every executor has under that path, or one given to SparkContext.addFile, by its name. `of_file` reads the model
    on the driver instead and sends it along with the function."""

    def __init__(self, path: str | None = None, model: bytes | None = None):
        self.path, self.model, self._session = path, model, None

    @classmethod
    def of_file(cls, path: str) -> "OnnxScorer":
        return cls(model=Path(path).read_bytes())

    def __getstate__(self):
        return {"path": self.path, "model": self.model, "_session": None}

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        if self._session is None:
            import onnxruntime

            model = self.model
            if model is None:
                model = self.path if Path(self.path).exists() else SparkFiles.get(self.path)
            self._session = onnxruntime.InferenceSession(model, providers=onnxruntime.get_available_providers())
        return self._session.run(None, {self._session.get_inputs()[0].name: batch})[0]


def _classes(pixels: list[np.ndarray | None], scorer: Scorer, labels: tuple[str, ...], gray: bool, batch: int) -> list[tuple]:
    """Label and scores (softmax) of images, at most `batch` at a time; nulls where there is none, or neither one gray channel nor three."""
    out: list[tuple] = [(None, None)] * len(pixels)
    there = [i for i, p in enumerate(pixels) if p is not None and p.shape[2] != 2]
    batch = min(batch, getattr(scorer, "most", batch))
    inputs = np.empty((min(batch, len(there)), 3, SIDE, SIDE), np.float32)
    for first in range(0, len(there), batch):
        some = there[first : first + batch]
        for k, i in enumerate(some):
            model_input(pixels[i], gray, out=inputs[k])
        outputs = np.asarray(scorer(inputs[: len(some)]), np.float64)
        powers = np.exp(outputs - outputs.max(1, keepdims=True))
        scores = (powers / powers.sum(1, keepdims=True)).astype(np.float32)
        for i, k, s in zip(some, outputs.argmax(1).tolist(), scores, strict=True):
            out[i] = (labels[k], s)
    return out


def classifier(scorer: Scorer = stand_in_scorer, labels: tuple[str, ...] = LABEL_KEYS, gray: bool = False, batch: int = BATCH):
    """A UDF from images to label and scores; nulls where one cannot be read."""

    @F.pandas_udf(S.PREDICTION)
    def classified(payloads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for payload in payloads:
            for first in range(0, len(payload), batch):
                pixels = [_or(None, lambda b: tiff.Tiff(b).pixels(), x) for x in payload.iloc[first : first + batch]]
                yield pd.DataFrame(_classes(pixels, scorer, labels, gray, batch), columns=["label", "scores"])

    return classified


#: What `viewer` finds, field by field.
SEEN = T.StructType([*S.POSITION, *S.PREDICTION, *S.MEASURES])


def viewer(scorer: Scorer = stand_in_scorer, labels: tuple[str, ...] = LABEL_KEYS, gray: bool = False, batch: int = BATCH, correct: bool = True, classify: bool = True, measure: bool = True, locate: bool = True):
    """A UDF from images, as they came, to SEEN: position, class and measures in one pass that decodes each image once.

    correct: take off the background before classifying and measuring. What isn't asked for is null. It is marked as not
    deterministic so that Spark runs it once a row, however many of its fields are used."""

    @F.pandas_udf(SEEN)
    def seen(payloads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decode = corrected if correct else lambda _, image: image.pixels()
        for payload in payloads:
            for first in range(0, len(payload), batch):
                some = payload.iloc[first : first + batch]
                read = [_or(None, tiff.Tiff, x) for x in some]
                places = [_or(_NOWHERE, lambda b, t=t: position(b, t), x) for x, t in zip(some, read, strict=True)] if locate else [(None,) * 4] * len(some)
                pixels = [_or(None, lambda b, t=t: plain(decode(b, t)), x) if t and (classify or measure) else None for x, t in zip(some, read, strict=True)]
                classes = _classes(pixels, scorer, labels, gray, batch) if classify else [(None, None)] * len(some)
                sizes = [x or _NOTHING for x in shapes.all_measures(pixels)] if measure else [(None,) * len(_NOTHING)] * len(some)
                yield pd.DataFrame([(*a, *b, *c) for a, b, c in zip(places, classes, sizes, strict=True)], columns=SEEN.names)

    return seen.asNondeterministic()


# --- drawings --------------------------------------------------------------------------------------------------


def annotated(data: bytes, radii: tuple[float, float], points: list | None) -> bytes:
    """The image with its longest line, the line's middle, and circles of two radii in pixels around it."""
    pixels = tiff.Tiff(data).pixels()
    pixels = (pixels.repeat(3, axis=2) if pixels.shape[2] == 1 else pixels[:, :, :3]).copy()
    if points is None:
        return tiff.encode(pixels)
    (x0, y0), (x1, y1) = points
    height, width = pixels.shape[:2]

    def dot(x, y, colour):
        x, y = np.rint(x).astype(int), np.rint(y).astype(int)
        ok = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        pixels[y[ok], x[ok]] = colour

    t = np.linspace(0, 1, 2 * max(abs(x1 - x0), abs(y1 - y0)) + 2)
    dot(x0 + (x1 - x0) * t, y0 + (y1 - y0) * t, (255, 0, 0))
    turn = np.linspace(0, 2 * np.pi, 1440)
    for radius, colour in zip(radii, ((0, 255, 0), (0, 0, 255)), strict=True):
        dot((x0 + x1) / 2 + radius * np.cos(turn), (y0 + y1) / 2 + radius * np.sin(turn), colour)
    dot(np.array([(x0 + x1) / 2]), np.array([(y0 + y1) / 2]), (255, 255, 0))
    return tiff.encode(pixels)


@F.pandas_udf(T.BinaryType())
def drawn(payload: pd.Series, radius_1: pd.Series, radius_2: pd.Series, points: pd.Series) -> pd.Series:
    rows = zip(payload, radius_1, radius_2, points, strict=True)
    return pd.Series([_or(None, lambda b, a=a, c=c, p=p: annotated(b, (a, c), None if p is None else [list(map(int, x)) for x in p]), x) for x, a, c, p in rows])
