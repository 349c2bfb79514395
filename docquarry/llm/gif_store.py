"""Media columns for GIF: code streams, palettes, disposal, transparency, timed frames.

`write_gif` stores rows of 8-bit samples as an animated GIF with LZW code streams;
`read_frames` parses any GIF87a/89a, decodes its code streams, applies local and global
palettes, interlacing, transparency and disposal, and gives timed frames with the canvas
as shown and a colour histogram. `store_texts` puts whole texts into GIFs; `read_media`
reads a stored GIF column back into payloads and timed frames.

Defined cases: a null text is an empty text; an empty text is 64 zero bytes. Long texts
span several frames. Broken streams raise ValueError. A code stream that ends early
leaves the rest of its frame at index 0. Extra columns are ignored; equal texts give
equal values.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Scratch, map_batches

WIDTH = 64
#: Rows of samples in a frame: 64 KB of payload.
FRAME_ROWS = 1024
_FULL = 4096
_BITS = np.arange(12, dtype=np.uint16)


def _widths(n: int, size: int) -> np.ndarray:
    """Code widths of the n codes behind a clear code, for minimum code size `size`."""
    entry = (1 << size) + 2 + np.arange(n)  # the entry that follows each code
    width = np.full(n, size + 1, np.uint8)
    for bits in range(size + 1, 12):
        width[entry > 1 << bits] = bits + 1
    return width


_WIDTHS = {size: _widths(_FULL, size) for size in range(2, 9)}


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The code stream of samples below 2**size: clear code first and whenever the table
    is full, end code last."""
    clear = 1 << size
    codes: list[int] = []
    cuts = [0]  # where each table begins
    out = codes.append
    table: dict[int, int] = {}
    new, samples = clear + 2, iter(data)  # new: the entry to come
    current = next(samples, -1)
    for sample in samples:
        pair = current << 8 | sample
        if pair in table:
            current = table[pair]
            continue
        out(current)
        current = sample
        if new < _FULL:
            table[pair] = new
            new += 1
        else:
            table.clear()
            cuts.append(len(codes))
            new = clear + 2
    if current >= 0:
        out(current)
    cuts.append(len(codes))
    values, widths = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        schedule = _WIDTHS[size]
        values += [clear], codes[a:b]
        widths += schedule[:1] if not a else schedule[b0 : b0 + 1], schedule[: b - a]
        b0 = b - a
    values.append([clear + 1])
    widths.append(_WIDTHS[size][b0 : b0 + 1])
    return _pack(np.concatenate([np.asarray(v, np.uint16) for v in values]), np.concatenate(widths))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    bits = (codes[:, None] >> _BITS) & 1
    return np.packbits(bits[_BITS < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(stream: bytes, size: int) -> bytes:
    """Samples of a code stream; tables that stay full past 4096 codes are allowed."""
    bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    clear, schedule = 1 << size, _WIDTHS[size]
    first = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at, n_bits = 0, len(bits)
    table, before, met, ended = list(first), b"", 0, False  # met: codes since the last clear code
    while not ended:
        # the width only depends on the codes met since a clear code: take all of one width
        width = int(schedule[met]) if met < _FULL else 12
        run = int(np.count_nonzero(schedule[met:] == width)) if width < 12 else 4096
        run = min(run, (n_bits - at) // width)
        if run <= 0:
            break
        weights = 1 << np.arange(width, dtype=np.uint16)
        codes = bits[at : at + run * width].reshape(run, width).astype(np.uint16) @ weights
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(stops[0]) if len(stops) else -1
        taken = codes[:stop].tolist() if stop >= 0 else codes.tolist()
        rest = iter(taken)
        if taken and not before:  # the first code behind a clear code adds no entry
            code = next(rest)
            if code > clear:
                raise ValueError("code beyond the table")
            before = first[code]
            out.append(before)
        n, add, put = len(table), table.append, out.append
        for code in rest:
            if code < n:
                piece = table[code]
            elif code == n < _FULL:
                piece = before + before[:1]
            else:
                raise ValueError("code beyond the table")
            if n < _FULL:
                add(before + piece[:1])
                n += 1
            put(piece)
            before = piece
        met += len(taken)
        at += len(taken) * width
        if stop >= 0:
            at += width
            ended = int(codes[stop]) == clear + 1
            table, before, met = list(first), b"", 0
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for part in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def payload_palette() -> bytes:
    """256 distinct colours whose red value is the index, so samples survive as colours."""
    i = np.arange(256)
    return np.stack([i, i * 7 % 256, i * 31 % 256], 1).astype(np.uint8).tobytes()


def write_gif(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay: int = 10) -> bytes:
    """Rows of `width` samples as frames of up to `frame_rows` rows, `delay` hundredths of
    a second each."""
    rows = len(samples) // width
    height = min(rows, frame_rows)
    parts = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", payload_palette()]
    for top in range(0, rows, frame_rows):
        n = min(frame_rows, rows - top)
        parts.append(b"\x21\xf9\x04\x04" + delay.to_bytes(2, "little") + b"\0\0")
        parts.append(b"\x2c\0\0\0\0" + width.to_bytes(2, "little") + n.to_bytes(2, "little") + b"\0\x08")
        parts.append(_blocks(lzw_encode(samples[top * width : (top + n) * width])))
    return b"".join(parts) + b"\x3b"


@dataclass
class Frame:
    """indices: samples of the frame's own rectangle; canvas: RGBA as shown."""

    start: int
    delay: int
    indices: np.ndarray
    canvas: np.ndarray

    def histogram(self) -> np.ndarray:
        """Counts of 64 colours, two bits of each of red, green and blue, over the
        canvas's opaque pixels."""
        pixels = self.canvas.reshape(-1, 4)
        shown = pixels[pixels[:, 3] > 0].astype(np.uint8) >> 6
        return np.bincount(shown[:, 0] * 16 + shown[:, 1] * 4 + shown[:, 2], minlength=64)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise ValueError("the file ends early")
        self.at += n
        return part

    def number(self) -> int:
        return int.from_bytes(self.take(2), "little")

    def blocks(self) -> bytes:
        parts = []
        while n := self.take(1)[0]:
            parts.append(self.take(n))
        return b"".join(parts)

    def palette(self, flags: int) -> np.ndarray | None:
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        return np.frombuffer(self.take(3 * n), np.uint8).reshape(n, 3)


def read_frames(data: bytes):
    """Yield the timed frames of a GIF."""
    reader = _Reader(data)
    if reader.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height = reader.number(), reader.number()
    flags, _, _ = reader.take(3)
    common = reader.palette(flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    clock, delay, disposal, clear_index = 0, 0, 0, None
    while (kind := reader.take(1)) != b"\x3b":
        if kind == b"\x21":
            label, body = reader.take(1), reader.blocks()
            if label == b"\xf9" and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                clear_index = body[3] if body[0] & 1 else None
            continue
        if kind != b"\x2c":
            raise ValueError("unknown block")
        left, top, w, h = reader.number(), reader.number(), reader.number(), reader.number()
        flags = reader.take(1)[0]
        palette = reader.palette(flags)
        palette = common if palette is None else palette
        if palette is None:
            raise ValueError("no palette")
        size = reader.take(1)[0]
        if not 2 <= size <= 8:
            raise ValueError("minimum code size")
        samples = np.zeros(w * h, np.uint8)
        raw = np.frombuffer(lzw_decode(reader.blocks(), size), np.uint8)[: w * h]
        samples[: len(raw)] = raw
        indices = samples.reshape(h, w)
        if flags & 0x40:
            order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
            indices = indices[np.argsort(order)]
        saved = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        shown = indices[: part.shape[0], : part.shape[1]]
        seen = shown < len(palette) if clear_index is None else (shown < len(palette)) & (shown != clear_index)
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(palette), :3], colours[:, 3] = palette, 255
        part[seen] = colours[shown[seen]]
        yield Frame(clock, delay, indices, canvas.copy())
        clock += delay
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            canvas = saved
        delay, disposal, clear_index = 0, 0, None


FRAME = "start long, delay int, width int, height int, histogram array<long>"
MEDIA = f"payload_bytes long, payload_sha256 string, tail_crc32 long, frames array<struct<{FRAME}>>"


def frame_row(frame: Frame) -> dict:
    """Columns of a frame: start and delay (hundredths of a second), size and the
    64-colour histogram."""
    return {"start": frame.start, "delay": frame.delay, "width": frame.indices.shape[1], "height": frame.indices.shape[0], "histogram": frame.histogram().tolist()}


def pad(data: bytes, unit: int = 64) -> bytes:
    return data + b"\0" * (-len(data) % unit or unit * (not data))


def text_to_gif(text: str | None) -> bytes:
    return write_gif(pad((text or "").encode("utf-8", "surrogatepass")))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, the text's bytes and the GIF that holds them."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in batch["text"]], "gif": [text_to_gif(t) for t in batch["text"]]})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, gif binary")


def read_gif(data: bytes) -> tuple:
    """Payload digests and frames of a GIF that holds a payload: the red value of each
    sample shown is its byte."""
    parts, frames = [], []
    for frame in read_frames(data):
        parts.append(np.ascontiguousarray(frame.canvas[: frame.indices.shape[0], :, 0]).tobytes())
        frames.append(frame_row(frame))
    payload = b"".join(parts)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), frames


def read_media(media: DataFrame) -> DataFrame:
    """media: (doc_id, n_bytes, gif). The columns read back from each GIF: the payload's
    size and digests, and its timed frames; and the size and digest of the GIF itself."""

    def run(batches):
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "frames"]
        for batch in batches:
            out = pd.DataFrame([read_gif(gif) for gif in batch["gif"]], columns=names)
            yield pd.concat([batch.drop(columns="gif").reset_index(drop=True), out], axis=1)

    sized = media.select("doc_id", "n_bytes", F.octet_length("gif").cast("long").alias("media_bytes"), F.sha2("gif", 256).alias("media_sha256"), "gif")
    return map_batches(sized, run, f"doc_id long, n_bytes long, media_bytes long, media_sha256 string, {MEDIA}")


def frames_of(media: DataFrame, column: str = "gif") -> DataFrame:
    """One row per frame of the GIFs in a binary column, beside its doc_id; a null has
    none."""

    def run(batches):
        for batch in batches:
            rows = [{"doc_id": i, "frame": k, **frame_row(f)} for i, data in zip(batch["doc_id"], batch["gif"], strict=True) if data is not None for k, f in enumerate(read_frames(data))]
            yield pd.DataFrame(rows, columns=["doc_id", "frame", "start", "delay", "width", "height", "histogram"])

    return map_batches(media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("gif")), run, f"doc_id long, frame int, {FRAME}")


def frames_text(frames: Column) -> Column:
    """Frames as text: start+delay:counts, one after the other."""
    return F.array_join(F.transform(frames, lambda f: F.concat(f["start"], F.lit("+"), f["delay"], F.lit(":"), F.array_join(f["histogram"].cast("array<string>"), ","))), ";")


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text as a GIF in the shared folder and reads the stored GIFs back:
    doc_id, n_bytes, media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32
    and frames."""
    return read_media(Scratch(docs.sparkSession, "gif").stored(store_texts(docs), "media"))
