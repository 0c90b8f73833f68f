"""GIF media columns: byte payloads as timed frames, and frames back from GIF files.

The decoder reads any GIF87a/89a stream: sub-blocks, LZW codes of growing width,
global and local palettes, interlacing, transparency, and disposal (leave,
background - painted black - and previous), giving timed RGB frames. Frames of one
size are encoded and decoded in step, a code or a sample of each at a time in
numpy; streams that clear their table on the way go code by code.

Cases: a null text is empty and has one frame of padding. Equal texts have equal
files. A file cut short, without a palette or with bad codes or samples raises
ValueError. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pelagia.llm.common import bounded, map_rows

SIDE = 24
FRAME = SIDE * SIDE
DELAY = 10  # hundredths of a second
#: Frames that are encoded or decoded in step, and most samples of a frame that is: its table can't fill up.
TOGETHER, MOST = 2048, 3800
#: The palette: three bits of red, three of green, two of blue.
INDEX = np.arange(256)
PALETTE = np.stack([(INDEX >> 5) * 255 // 7, (INDEX >> 2 & 7) * 255 // 7, (INDEX & 3) * 85], 1).astype(np.uint8)
BINS = 4  # of each colour in a histogram


@dataclass
class Frame:
    """One image of a file: its place, timing and samples (palette indices)."""

    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    samples: np.ndarray


def code_bits(count: int) -> np.ndarray:
    """First bit of each of ``count`` codes of a stream with one clear: nine bits each, ten from the 257th on, and so on."""
    i = np.arange(count)
    width = 9 + sum((256 + i >= 1 << w).astype(np.int64) for w in range(9, 12))
    return np.cumsum(np.append(0, width))


def lzw_codes(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy LZW of (frames, n) samples, all frames in step: codes with clear and end, and their number by frame.

    Each frame has its own open-addressed table of (code, next sample) pairs.
    """
    frames, n = samples.shape
    slots = 1 << (2 * n).bit_length()
    keys, values = np.full(frames * slots, -1, np.int32), np.zeros(frames * slots, np.int16)
    base, row = np.arange(frames) * slots, np.arange(frames)
    codes, count = np.zeros((frames, n + 2), np.int16), np.ones(frames, np.int64)
    codes[:, 0] = 256
    word = samples[:, 0].astype(np.int32)
    for t in range(1, n):
        s = samples[:, t].astype(np.int32)
        key = word << 8 | s
        at = base + (key * 40503 >> 4 & slots - 1)
        found = keys[at]
        busy = np.flatnonzero((found != key) & (found >= 0))
        while len(busy):  # linear probing
            at[busy] = base[busy] + (at[busy] - base[busy] + 1 & slots - 1)
            found[busy] = keys[at[busy]]
            busy = busy[(found[busy] != key[busy]) & (found[busy] >= 0)]
        new = np.flatnonzero(found < 0)
        codes[new, count[new]] = word[new]
        keys[at[new]], values[at[new]] = key[new], 257 + count[new]
        count[new] += 1
        word = np.where(found < 0, s, values[at])
    codes[row, count] = word
    codes[row, count + 1] = 257
    return codes, count + 2


def lzw_pack(codes: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Code streams as bytes, the lowest bit first."""
    first = code_bits(codes.shape[1])
    bits = np.zeros((len(codes), int(first[-1])), np.uint8)
    for width in np.unique(np.diff(first)).tolist():
        of = np.flatnonzero(np.diff(first) == width)
        part = codes[:, of, None] >> np.arange(width, dtype=np.int16) & 1
        bits[:, first[of[0]] : first[of[-1]] + width] = part.reshape(len(codes), -1)
    data = np.packbits(bits, axis=1, bitorder="little")
    size = -(-first[count] // 8)
    return [r[:k].tobytes() for r, k in zip(data, size.tolist())]


def lzw_unpack(streams: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of code streams with one clear and n < 3,800 samples each, all in step; and which streams are such.

    A code above the samples stands for what began with the code before its own
    entry was made, and one sample more; so each sample of the output points at an
    earlier one, and following the pointers gives the sample.
    """
    frames = len(streams)
    ok = np.ones(frames, bool)
    size = max(map(len, streams))
    first = code_bits(n + 2)
    first = first[first <= 8 * size]
    raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in streams), np.uint8).reshape(frames, size)
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    codes = np.zeros((frames, len(first) - 1), np.int64)
    for width in np.unique(np.diff(first)).tolist():
        of = np.flatnonzero(np.diff(first) == width)
        part = bits[:, first[of[0]] : first[of[-1]] + width].reshape(frames, len(of), width)
        codes[:, of] = (part.astype(np.int32) << np.arange(width, dtype=np.int32)).sum(2)
    ends = codes == 257
    end = np.where(ends.any(1), ends.argmax(1), 0)
    used = np.arange(codes.shape[1]) < end[:, None]
    used[:, 0] = False
    ok &= (end > 1) & (codes[:, 0] == 256) & ~((codes == 256) & used).any(1)
    made = codes - 256  # the code at which an entry was made
    ok &= ~(used & (codes > 257) & (made > np.arange(codes.shape[1]))).any(1)
    ok &= ~(used[:, 1] & (codes[:, 1] > 255)) if codes.shape[1] > 1 else False
    used &= ok[:, None]
    length, row = np.zeros(codes.shape, np.int64), np.arange(frames)
    literal = codes < 256
    for i in range(1, int(end.max(initial=1))):
        length[:, i] = np.where(literal[:, i], 1, length[row, np.clip(made[:, i] - 1, 0, i - 1)] + 1) * used[:, i]
    ok &= length.sum(1) == n
    length[~ok] = 0
    place = np.cumsum(length.reshape(-1)) - length.reshape(-1)  # in the samples of all good streams
    owner = np.repeat(np.arange(codes.size), length.reshape(-1))
    here = np.arange(len(owner))
    back = np.repeat(row, codes.shape[1]) * codes.shape[1] + np.maximum(made.reshape(-1) - 1, 0)
    plain = literal.reshape(-1)[owner]
    source = np.where(plain, here, place[back[owner]] + here - place[owner])
    while not plain[source].all():
        source = source[source]
    out = np.zeros((frames, n), np.uint8)
    out[ok] = codes.reshape(-1)[owner][source].astype(np.uint8).reshape(-1, n)
    return out, ok


def encode_frames(samples: np.ndarray, delay: int = DELAY) -> list[bytes]:
    """A frame record for each row of (frames, FRAME) samples."""
    head = b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
    out = []
    for data in lzw_pack(*lzw_codes(samples)):
        blocks = [data[k : k + 255] for k in range(0, len(data), 255)]
        out.append(head + b"".join(bytes([len(x)]) + x for x in blocks) + b"\0")
    return out


HEAD = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + PALETTE.tobytes()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with 255s up to a positive multiple of FRAME, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((-len(raw)) % FRAME if raw else FRAME), len(raw)


def encode_files(payloads: list[bytes]) -> list[bytes]:
    """A GIF file for each payload, whose length is a multiple of FRAME."""
    all_ = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    out, at = [], 0
    for k in range(0, len(payloads)):
        n = len(payloads[k]) // FRAME
        out.append((at, at + n))
        at += n
    records = [r for k in range(0, len(all_), TOGETHER) for r in encode_frames(all_[k : k + TOGETHER])]
    return [HEAD + b"".join(records[a:b]) + b"\x3b" for a, b in out]


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """LZW of samples of any number, one after another, with a new table when it is full."""
    clear, out, value, filled = 1 << bits, bytearray(), 0, 0
    width, table, size, word = bits + 1, {}, clear + 2, None

    def put(code: int) -> None:
        nonlocal value, filled
        value |= code << filled
        filled += width
        while filled >= 8:
            out.append(value & 255)
            value >>= 8
            filled -= 8

    put(clear)
    for s in samples:
        if word is None:
            word = s
        elif (code := table.get((word, s))) is not None:
            word = code
        else:
            put(word)
            if size < 4096:
                table[word, s] = size
                size += 1
                width += size > 1 << width and width < 12
            else:
                put(clear)
                table, size, width = {}, clear + 2, bits + 1
            word = s
    if word is not None:
        put(word)
        size += 1
        width += size > 1 << width and width < 12
    put(clear + 1)
    if filled:
        out.append(value & 255)
    return bytes(out)


def lzw_decode(data: bytes, bits: int, n: int) -> np.ndarray:
    """Samples of an LZW stream, code by code."""
    clear = 1 << bits
    width, value, filled, last = bits + 1, 0, 0, None
    roots = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, out, at = list(roots), bytearray(), 0
    while len(out) < n:
        while filled < width:
            if at == len(data):
                raise ValueError("the LZW stream ends early")
            value |= data[at] << filled
            at, filled = at + 1, filled + 8
        code = value & (1 << width) - 1
        value, filled = value >> width, filled - width
        if code == clear:
            table, width, last = list(roots), bits + 1, None
            continue
        if code == clear + 1:
            break
        if last is None:
            if code >= clear:
                raise ValueError("an LZW stream must begin with a sample")
            word = table[code]
        else:
            if code < len(table):
                word = table[code]
            elif code == len(table) and len(table) < 4096:
                word = last + last[:1]
            else:
                raise ValueError("an LZW code is out of range")
            if len(table) < 4096:
                table.append(last + word[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
        out += word
        last = word
    if len(out) < n:
        raise ValueError("the LZW stream holds too few samples")
    return np.frombuffer(bytes(out[:n]), np.uint8)


def parse(file: bytes) -> tuple[int, int, int, list[tuple]]:
    """Screen width, height, background index, and (frame without samples, code bits, LZW data) of each image."""
    if file[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    try:
        width, height, flags, background = struct.unpack_from("<HHBB", file, 6)
        at, palette = 13, None
        if flags & 0x80:
            n = 3 * (2 << (flags & 7))
            palette = np.frombuffer(file, np.uint8, n, at).reshape(-1, 3)
            at += n
        images, delay, disposal, transparent = [], 0, 0, None
        while (kind := file[at]) != 0x3B:
            if kind == 0x21:
                label, at = file[at + 1], at + 2
                if label == 0xF9:
                    packed, delay, key = struct.unpack_from("<BHB", file, at + 1)
                    disposal, transparent = packed >> 2 & 7, key if packed & 1 else None
                while file[at]:
                    at += 1 + file[at]
                at += 1
            elif kind == 0x2C:
                left, top, w, h, flags = struct.unpack_from("<HHHHB", file, at + 1)
                at, own = at + 10, palette
                if flags & 0x80:
                    n = 3 * (2 << (flags & 7))
                    own = np.frombuffer(file, np.uint8, n, at).reshape(-1, 3)
                    at += n
                bits, at, parts = file[at], at + 1, []
                while size := file[at]:
                    parts.append(file[at + 1 : at + 1 + size])
                    at += 1 + size
                at += 1
                if own is None:
                    raise ValueError("an image without a palette")
                frame = Frame(left, top, w, h, delay, disposal, transparent, own, np.zeros(0, np.uint8))
                images.append((frame, bits, b"".join(parts), bool(flags & 0x40)))
                delay, disposal, transparent = 0, 0, None
            else:
                raise ValueError("an unknown block")
        return width, height, background, images
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e


def decode_files(files: list[bytes]) -> list[tuple[int, int, int, list[Frame]]]:
    """Frames of each file; streams of the same number of samples are decoded in step, those with several clears one by one."""
    parsed = [parse(f) for f in files]
    alike: dict[int, list] = {}
    for _, _, _, images in parsed:
        for image in images:
            n = image[0].width * image[0].height
            alike.setdefault(n if image[1] == 8 and 0 < n <= MOST else -1, []).append(image)
    for n, images in alike.items():
        step = TOGETHER if n <= FRAME else max(1, TOGETHER * FRAME // n)
        for k in range(0, len(images), step):
            part = images[k : k + step]
            samples, done = lzw_unpack([i[2] for i in part], n) if n > 0 else (None, [False] * len(part))
            for j, (frame, code_size, data, _) in enumerate(part):
                frame.samples = samples[j] if done[j] else lzw_decode(data, code_size, frame.width * frame.height)
    out = []
    for width, height, background, images in parsed:
        for frame, _, _, woven in images:
            if woven:  # four passes over the rows
                rows = frame.samples.reshape(frame.height, frame.width)
                order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, frame.height, step)]
                plain = np.empty_like(rows)
                plain[order] = rows
                frame.samples = plain.reshape(-1)
        out.append((width, height, background, [i[0] for i in images]))
    return out


def compose(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """RGB screens after each frame, by transparency and disposal; black where nothing is drawn."""
    screen = np.zeros((height, width, 3), np.uint8)
    for f in frames:
        before = screen.copy() if f.disposal == 3 else None
        area = screen[f.top : f.top + f.height, f.left : f.left + f.width]
        drawn = f.samples.reshape(f.height, f.width)[: area.shape[0], : area.shape[1]]
        if drawn.size and int(drawn.max()) >= len(f.palette):
            raise ValueError("a sample beyond the palette")
        colours = f.palette[drawn]
        if f.transparent is None:
            area[:] = colours
        else:
            see = drawn != f.transparent
            area[see] = colours[see]
        yield screen.copy()
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            screen = before


def histogram(colours: np.ndarray) -> np.ndarray:
    """Counts of RGB values in BINS ** 3 equal boxes."""
    c = colours.reshape(-1, 3).astype(np.int64) * BINS >> 8
    return np.bincount((c[:, 0] * BINS + c[:, 1]) * BINS + c[:, 2], minlength=BINS**3)


def timed(width: int, height: int, frames: list[Frame]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, delay, RGB screen, its histogram) of each frame of a file."""
    start = 0
    for f, rgb in zip(frames, compose(width, height, frames)):
        yield start, f.delay, rgb, histogram(rgb)
        start += f.delay


def with_media(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's payload stored as a GIF file."""
    bounded(df.sparkSession)

    def make():
        def step(batch):
            got = [payload_of(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "n_bytes": [n for _, n in got], "media": encode_files([p for p, _ in got])}

        return step

    return map_rows(df.select("doc_id", "text"), "doc_id long, n_bytes long, media binary", make)


def frames_of(media: DataFrame) -> DataFrame:
    """General form: a row per timed frame of each file in (doc_id, media), with its colour histogram."""
    bounded(media.sparkSession)

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, (w, h, _, frames) in zip(b.column("doc_id").to_pylist(), decode_files([f or HEAD + b"\x3b" for f in b.column("media").to_pylist()])):
                for k, (start, delay, rgb, boxes) in enumerate(timed(w, h, frames)):
                    for col, v in zip(rows, (doc, k, start, delay, rgb.tobytes(), boxes.tolist())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())))], ["doc_id", "frame", "start_cs", "delay_cs", "rgb", "histogram"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, frame int, start_cs long, delay_cs int, rgb binary, histogram array<long>")


def digest_media(df: DataFrame) -> DataFrame:
    """Store every whole text as GIF and describe what is read back from the stored bytes."""
    return describe(with_media(df))


def describe(stored: DataFrame) -> DataFrame:
    """Digests of each file in (doc_id, n_bytes, media), and the share of each histogram box in its composed frames."""

    def make():
        def step(batch):
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            files = batch.column("media").to_pylist()
            for file, (w, h, _, frames) in zip(files, decode_files(files)):
                payload = np.concatenate([f.samples for f in frames])
                raw = payload.tobytes()
                boxes = sum(counts for _, _, _, counts in timed(w, h, frames))
                for k, v in zip(out, (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(file), hashlib.sha256(file).hexdigest(), (boxes * 65535 // boxes.sum()).astype(">u2").tobytes().hex())):
                    out[k].append(v)
            return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | out

        return step

    return map_rows(stored, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)
