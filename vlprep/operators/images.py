"""Image jobs on the ``image`` struct of Spark's image source, in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vlprep.config import CHANNEL_MEAN, CHANNEL_STD, IMAGE_SIZE, PATCH_SIZE
from vlprep.session import qualified

IMAGE_TYPE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
ROWS_PER_YIELD = 64
_BGR_MODE = 16  # fixed value: three unsigned byte channels


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Height x width x RGB bytes; grey is replicated, alpha dropped."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, 2::-1]


def _image_row(origin, rgb: np.ndarray) -> dict:
    height, width, _ = rgb.shape
    return {
        "origin": origin, "height": height, "width": width, "nChannels": 3, "mode": _BGR_MODE,
        "data": np.ascontiguousarray(rgb[:, :, ::-1]).tobytes(),
    }


def _valid(im) -> bool:
    return im is not None and im["width"] is not None and im["width"] > 0 and im["height"] > 0


def normalize_images(df: DataFrame, image: str = "image", mean=CHANNEL_MEAN, std=CHANNEL_STD, out: str = "pixels") -> DataFrame:
    """Pixels by channel, row and column: scaled to [0, 1], then ``(x - mean) / std`` per channel.

    Invalid images give null.
    """
    m, s = np.asarray(mean, dtype=np.float64), np.asarray(std, dtype=np.float64)

    def one(row) -> np.ndarray | None:
        if not _valid(row):
            return None
        rgb = to_rgb(row["data"], row["height"], row["width"], row["nChannels"])
        return ((rgb / 255.0 - m) / s).transpose(2, 0, 1).reshape(-1).astype(np.float32)

    @F.pandas_udf("array<float>")
    def pixels(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([one(r) for r in frame.to_dict("records")], dtype=object)

    return df.withColumn(out, pixels(F.col(image)))


def _resized(rgb: np.ndarray, size: int, method: str) -> np.ndarray:
    height, width, _ = rgb.shape
    if method == "nearest":
        rows = np.minimum(((np.arange(size) + 0.5) * height / size).astype(int), height - 1)
        cols = np.minimum(((np.arange(size) + 0.5) * width / size).astype(int), width - 1)
        return rgb[rows][:, cols]
    y = np.clip((np.arange(size) + 0.5) * height / size - 0.5, 0, height - 1)
    x = np.clip((np.arange(size) + 0.5) * width / size - 0.5, 0, width - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, height - 1), np.minimum(x0 + 1, width - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    f = rgb.astype(np.float64)
    top = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx
    low = f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.uint8)


def resize_images(df: DataFrame, size: int = IMAGE_SIZE, method: str = "bilinear", image: str = "image") -> DataFrame:
    """Images of ``size`` x ``size`` in place of the originals; invalid ones give null."""
    if method not in ("nearest", "bilinear"):
        raise ValueError(f"method must be 'nearest' or 'bilinear', got {method!r}")

    def one(row) -> dict | None:
        if not _valid(row):
            return None
        rgb = to_rgb(row["data"], row["height"], row["width"], row["nChannels"])
        return _image_row(row["origin"], _resized(rgb, size, method))

    return _map_images(df, image, one, image)


def _map_images(df: DataFrame, source: str, one: Callable, out: str) -> DataFrame:
    fields = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{out}` {IMAGE_TYPE}"])
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), ROWS_PER_YIELD):
                part = pdf.iloc[start : start + ROWS_PER_YIELD]
                done = part[names].copy()
                done[out] = pd.Series([one(v) for v in part[source]], index=part.index, dtype=object)
                yield done

    return df.mapInPandas(run, schema)


def decode_images(df: DataFrame, loader: Callable[[], Callable] | None = None, content: str = "jpg", out: str = "image",
                  on_error: str = "skip") -> DataFrame:
    """Image bytes to an RGB ``image`` struct.

    ``loader()`` runs once per Python worker and returns a function from bytes to
    a height x width x channels array in RGB order; the default uses an imaging
    package where one is installed. Unreadable bytes give null (``skip``) or end
    the job (``fail``).
    """
    if on_error not in ("skip", "fail"):
        raise ValueError(f"on_error must be 'skip' or 'fail', got {on_error!r}")
    load = loader or _package_decoder
    state: dict = {}

    def one(data) -> dict | None:
        if data is None:
            return None
        decode = state.get("decode") or state.setdefault("decode", load())
        try:
            pixels = np.asarray(decode(bytes(data)), dtype=np.uint8)
        except Exception:
            if on_error == "fail":
                raise
            return None
        if pixels.ndim == 2:
            pixels = pixels[:, :, None]
        rgb = np.repeat(pixels, 3, axis=2) if pixels.shape[2] == 1 else pixels[:, :, :3]
        return _image_row("", rgb)

    return _map_images(df, content, one, out)


def _package_decoder() -> Callable:
    import io

    try:
        from PIL import Image
    except ImportError as error:
        raise RuntimeError("no imaging package installed: pass decode_images a loader") from error
    return lambda data: np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def _grey_png(data: bytes, width: int, height: int) -> bytes:
    lines = b"".join(b"\0" + data[i * width : (i + 1) * width] for i in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    # fixed values: signature and chunk names of the format
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_grey_pngs(df: DataFrame, folder: str, width: int, height: int, name: str = "name", data: str = "data") -> int:
    """Write an image file ``<name>.png`` for every row into a shared folder, in the tasks; returns their number.

    Rows of null bytes give files that are no images.
    """
    target = qualified(df.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(target) if ":" in target else (pafs.LocalFileSystem(), target)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for file, pixels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_output_stream(f"{root}/{file}.png") as sink:
                    sink.write(b"no image" if pixels is None else _grey_png(pixels, width, height))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return df.select(F.col(name).cast("string"), data).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def patchify(df: DataFrame, row_id: str, patch: int = PATCH_SIZE, pixels: str = "pixels", height: str = "height", width: str = "width",
             channels: int = 3) -> DataFrame:
    """One row per ``patch`` x ``patch`` square: ``row_id``, ``patch``, ``values``.

    Patches run row by row; values run by channel, row and column. Sides must be
    multiples of ``patch``. Rows without pixels give none.
    """
    kind = df.schema[row_id].dataType.simpleString()

    def squares(values, h: int, w: int) -> np.ndarray:
        if h % patch or w % patch:
            raise ValueError(f"image sides {h}x{w} are not multiples of {patch}")
        grid = np.asarray(values, dtype=np.float32).reshape(channels, h // patch, patch, w // patch, patch)
        return grid.transpose(1, 3, 0, 2, 4).reshape(-1, channels * patch * patch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf[pixels].notna()]
            for start in range(0, len(pdf), ROWS_PER_YIELD):
                part = pdf.iloc[start : start + ROWS_PER_YIELD]
                flat = [squares(v, int(h), int(w)) for v, h, w in zip(part[pixels], part[height], part[width])]
                counts = [len(f) for f in flat]
                yield pd.DataFrame(
                    {
                        row_id: np.repeat(part[row_id].to_numpy(), counts),
                        "patch": np.concatenate([np.arange(n) for n in counts]),
                        "values": [row for f in flat for row in f],
                    }
                )

    return df.select(row_id, pixels, height, width).mapInPandas(run, f"`{row_id}` {kind}, patch bigint, values array<float>")


def attach_images(samples: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """Samples with their image bytes. Join last: bytes should cross one shuffle only."""
    return samples.join(images, key)
