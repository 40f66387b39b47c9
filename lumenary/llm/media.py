"""Media columns: baseline JPEG bytes with dimensions, luminance thumbnails and their hashes."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm import jpeg
from lumenary.llm.common import documents, map_slices, utf8

#: A payload is filled up with bytes 255 to a positive multiple of this.
UNIT = 576


def encode_texts(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up, as a JPEG of flat blocks."""

    def start():
        def step(part):
            raw = utf8(part)
            full = [t + b"\xff" * (max(1, -(-len(t) // UNIT)) * UNIT - len(t)) for t in raw]
            return [part.column("doc_id"), [len(t) for t in raw], pa.array(jpeg.encode_flat(full), pa.binary())]

        return step

    return map_slices(docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text")), start, "doc_id long, n_bytes long, media binary", limit=1 << 20)


def images(media: bytes) -> list[tuple[bytes, jpeg.Frame]]:
    """All images of a stream."""
    out, at = [], 0
    while at < len(media):
        frame, at = jpeg.parse(media, at)
        out.append((media, frame))
    return out


def describe(media: DataFrame, column: str = "media", digest: bool = False) -> DataFrame:
    """The columns of media with width, height, thumb (a byte per block) and thumb_hash.

    All come from the stored bytes: markers, the decoded scan, the DC levels. A stream of
    several images has the first one's width, their heights added and their thumbnails joined.
    A null stream has nulls; bytes that are no baseline JPEG fail. With digest, the payload's
    digests stand in place of the bytes and the thumbnail.
    """
    keep = [c for c in media.columns if c != column]
    kinds = {n: "long" if t == "bigint" else t for n, t in media.dtypes}
    own = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" if digest else "media binary, width int, height int, thumb binary, thumb_hash string"

    def start():
        def step(part):
            streams = part.column(column).to_pylist()
            found = [images(m) if m is not None else [] for m in streams]
            flat = [x for f in found for x in f]
            thumbs = iter(jpeg.thumbnails(flat))
            out: list[list] = [[] for _ in own.split(",")]
            for media_, frames in zip(streams, found):
                if not frames:
                    row = [None] * len(out) if media_ is None or digest else [media_, 0, 0, b"", None]
                else:
                    grids = [next(thumbs) for _ in frames]
                    width, height = frames[0][1].width, sum(f.height for _, f in frames)
                    seen = joint([f"{jpeg.thumb_hash(g):016x}" for g in grids])
                    if digest:
                        payload = b"".join(g.tobytes()[: samples(f)] for g, (_, f) in zip(grids, frames))
                        row = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media_), hashlib.sha256(media_).hexdigest(), f"{width}x{height}:{seen}"]
                    else:
                        row = [media_, width, height, b"".join(g.tobytes() for g in grids), seen]
                for c, v in zip(out, row):
                    c.append(v)
            return [*(part.column(c) for c in keep), *out]

        return step

    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + [own])
    return map_slices(media.select(*keep, F.col(column)), start, schema, column, 1 << 21)


def joint(hashes: list[str]) -> str:
    """The hash of a stream's only image, or one of the hashes of all."""
    return hashes[0] if len(hashes) == 1 else hashlib.sha256("".join(hashes).encode()).hexdigest()[:16]


def samples(frame: jpeg.Frame) -> int | None:
    """How many of the thumbnail's samples an image says it holds; None: all."""
    return next((int(c[8:]) for c in frame.comments if c.startswith(b"samples=")), None)


def op1_media_jpeg(spark, sf_dir: str) -> DataFrame:
    """Every document as a JPEG column, read back: digests of payload and media, and the feature.

    A null or empty text is one unit of bytes 255; a repeated row is stored again; other
    columns play no part; an empty table gives no rows; a long text is as many images as it needs.
    """
    return describe(encode_texts(documents(spark, sf_dir)), digest=True)
