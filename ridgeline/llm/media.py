"""Media columns: AVI motion-JPEG. Bytes are stored without loss in baseline JPEG frames, read back and cut into shots.

Lossless storage: a sample is one 8x8 block whose only coefficient is its DC value. With a quantiser of 8 the block's
pixels are all DC + 128, so every byte comes back exactly from any baseline decoder. The DC Huffman table gives the
code of category c 9 - c bits, so a difference always takes 9 bits, and the end of the block takes one more: fields of
10 bits, which numpy packs and unpacks without a loop over blocks. A frame has 192 blocks, 16 by 12: 192 bytes.

The reader parses the RIFF lists and the index idx1 and decodes intra frames: frames of such tables by lookup, all
other baseline JPEGs (any Huffman tables, sampling factors and restart intervals) by a plain sequential decoder.

Shots: a cut lies before a frame whose grey histogram differs from the one before by more than the mean of the
differences seen around it plus `k` of their deviations. clips() yields timed rows.

Cases: a null or empty text is stored as 192 blanks. Equal texts give equal files. Very long texts give more frames;
memory is bounded by one batch. Repeated rows are stored each. An empty table gives an empty result; extra columns are
left behind, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, text_bytes

BLOCKS_X, BLOCKS_Y, FPS = 16, 12, 25
FRAME = BLOCKS_X * BLOCKS_Y
#: Category of a DC difference -> bits of its code; with the category's own bits always SPAN.
SPAN = 9


def _zigzag() -> np.ndarray:
    """Places of the coefficients in scan order: along anti-diagonals, in turn down and up."""
    by: dict = {}
    for y in range(8):
        for x in range(8):
            by.setdefault(x + y, []).append((y, x))
    out: list = []
    for s in range(15):
        out += sorted(by[s], key=lambda c: c[0] if s % 2 else c[1])
    return np.array([y * 8 + x for y, x in out])


ZIGZAG = _zigzag()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def frame_header() -> bytes:
    dc = bytes([1] * SPAN + [0] * (16 - SPAN)) + bytes(range(SPAN - 1, -1, -1))
    ac = bytes([1] + [0] * 15) + b"\0"
    size = struct.pack(">BHHB", 8, BLOCKS_Y * 8, BLOCKS_X * 8, 1) + b"\1\x11\0"
    return b"\xff\xd8" + _segment(0xDB, b"\0" + b"\x08" * 64) + _segment(0xC0, size) + _segment(0xC4, b"\0" + dc) + _segment(0xC4, b"\x10" + ac) + _segment(0xDA, b"\1\1\0\0\x3f\0")


HEADER = frame_header()


def _fields() -> np.ndarray:
    """Difference + 255 -> its 10-bit field: code, own bits, end of block."""
    d = np.arange(-255, 256)
    c = np.array([int(abs(x)).bit_length() for x in d])
    code = ((1 << (SPAN - 1 - c)) - 1) << 1  # ones, then a zero: SPAN - c bits
    own = np.where(d >= 0, d, d + (1 << c) - 1)
    return ((code << c | own) << 1).astype(np.uint64)


FIELDS = _fields()


def frames_of(payload: bytes) -> list[bytes]:
    """payload: a multiple of FRAME bytes."""
    v = np.frombuffer(payload, np.uint8).reshape(-1, FRAME).astype(np.int64) - 128
    f = FIELDS[np.diff(v, axis=1, prepend=0) + 255].reshape(len(v), -1, 4)
    packed = f[..., 0] << np.uint64(30) | f[..., 1] << np.uint64(20) | f[..., 2] << np.uint64(10) | f[..., 3]
    data = np.ascontiguousarray(packed.astype(">u8").view(np.uint8).reshape(len(v), -1, 8)[..., 3:]).tobytes()
    n = FRAME * 10 // 8
    return [HEADER + data[k : k + n].replace(b"\xff", b"\xff\0") + b"\xff\xd9" for k in range(0, len(data), n)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int = BLOCKS_X * 8, height: int = BLOCKS_Y * 8, fps: int = FPS) -> bytes:
    most = max(map(len, frames))
    avih = struct.pack("<10I16x", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    sizes = np.array([len(f) for f in frames], np.int64)
    at = 4 + np.concatenate([[0], np.cumsum(sizes + sizes % 2 + 8)[:-1]])
    index = np.stack([np.full(len(frames), int.from_bytes(b"00dc", "little")), np.full(len(frames), 0x10), at, sizes], axis=1).astype("<u4")
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    body = b"AVI " + head + movi + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(data: bytes, a: int, b: int):
    """(name, start, end) of the chunks in data[a:b]; a LIST has its type as name and its content as span."""
    while a + 8 <= b:
        name, n = data[a : a + 4], int.from_bytes(data[a + 4 : a + 8], "little")
        end = min(b, a + 8 + n)
        if name in (b"LIST", b"RIFF"):
            yield data[a + 8 : a + 12], a + 12, end
        else:
            yield name, a + 8, end
        a += 8 + n + n % 2


def read_avi(data: bytes) -> dict:
    """fps, width, height and the frames by the index idx1, or by walking the list movi where there is none."""
    top = next(_chunks(data, 0, len(data)))
    if data[:4] != b"RIFF" or top[0] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"fps": 0.0, "frames": []}
    movi, index = None, None
    for name, a, b in _chunks(data, top[1], top[2]):
        if name == b"hdrl":
            for n, x, _ in _chunks(data, a, b):
                if n == b"avih":
                    h = struct.unpack_from("<10I", data, x)
                    out |= {"fps": 1e6 / h[0] if h[0] else 0.0, "width": h[8], "height": h[9]}
        elif name == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", (b - a) // 16 * 4, a).reshape(-1, 4)
    if index is not None and len(index):
        own = index[(index[:, 0] >> 16) == int.from_bytes(b"dc", "little")].astype(np.int64)
        base = movi[0] - 4 if own[0, 2] < movi[0] - 4 else 0  # offsets count from the list's type, or from the file's start
        out["frames"] = [data[p : p + n] for p, n in zip((own[:, 2] + base + 8).tolist(), own[:, 3].tolist())]
    else:
        out["frames"] = [data[a:b] for n, a, b in _chunks(data, *movi) if n[2:] == b"dc"]
    return out


# ------------------------------------------------------------------ JPEG


def _huffman(bits: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    code, out, k = 0, {}, 0
    for n, count in enumerate(bits, 1):
        for _ in range(count):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def parse_jpeg(data: bytes) -> tuple[dict, int]:
    """The tables and the frame's layout up to the scan's data, and where that begins."""
    j: dict = {"q": {}, "huff": {}, "restart": 0}
    a = 2
    while True:
        if data[a] != 255:
            raise ValueError("no JPEG marker where one must be")
        m, n = data[a + 1], int.from_bytes(data[a + 2 : a + 4], "big")
        body = data[a + 4 : a + 2 + n]
        if m == 0xDB:
            while body:
                wide = body[0] >> 4
                j["q"][body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[65 + 64 * bool(wide) :]
        elif m == 0xC0 or m == 0xC1:
            _, j["height"], j["width"], count = struct.unpack_from(">BHHB", body)
            j["parts"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
        elif 0xC2 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif m == 0xC4:
            while body:
                total = sum(body[1:17])
                j["huff"][body[0] >> 4, body[0] & 15] = _huffman(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif m == 0xDD:
            j["restart"] = int.from_bytes(body, "big")
        a += 2 + n
        if m == 0xDA:
            j["scan"] = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            return j, a


def _field_lookup(j: dict) -> tuple[int, np.ndarray] | None:
    """For one component whose blocks are a DC difference of constant length and an end of block: field bits and the
    difference of each field. None for all other tables."""
    if len(j["parts"]) != 1 or j["restart"]:
        return None
    dc, ac = j["huff"].get((0, j["scan"][0][1])), j["huff"].get((1, j["scan"][0][2]))
    if not dc or not ac or [*ac.values()] != [0] or len({n + c for (n, _), c in dc.items()}) != 1:
        return None
    (end_n, end_code), (n0, c0) = next(iter(ac)), next((n, c) for (n, _), c in dc.items())
    bits = n0 + c0 + end_n
    if bits > 16:
        return None
    out = np.full(1 << bits, 1 << 20, np.int64)
    for (n, code), c in dc.items():
        own = np.arange(1 << c)
        d = np.where(own >> max(c - 1, 0) & 1, own, own - (1 << c) + 1) if c else own
        out[(((code << c) | own) << end_n) | end_code] = d
    return bits, out


def decode_blocks(frames: list[bytes]) -> np.ndarray:
    """Grey level of each block of frames that share the field layout, frames x blocks; raises ValueError otherwise."""
    known: dict[bytes, tuple] = {}
    scans, layout = [], None
    for f in frames:
        head = next((h for h in known if f.startswith(h)), None)
        if head is None:
            j, at = parse_jpeg(f)
            look = _field_lookup(j)
            if look is None or known:
                raise ValueError("no common field layout")
            head = f[:at]
            blocks = -(-j["width"] // 8) * -(-j["height"] // 8)
            layout = known[head] = (*look, blocks, int(j["q"][j["parts"][0][3]][0]))
        scans.append(f[len(head) : f.rindex(b"\xff\xd9")].replace(b"\xff\0", b"\xff"))
    bits, look, blocks, q = layout
    n = -(-blocks * bits // 8)
    raw = np.frombuffer(b"".join(scans), np.uint8)
    if len(raw) != n * len(frames) or blocks % 4 or bits != 10:
        raise ValueError("no common field layout")
    b = raw.reshape(len(frames), -1, 5).astype(np.uint64)
    w = b[..., 0] << np.uint64(32) | b[..., 1] << np.uint64(24) | b[..., 2] << np.uint64(16) | b[..., 3] << np.uint64(8) | b[..., 4]
    f = np.stack([w >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=-1).reshape(len(frames), blocks)
    dc = np.cumsum(look[f.astype(np.int64)], axis=1) * q
    return np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8)


_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def decode_jpeg(data: bytes) -> np.ndarray:
    """Any baseline JPEG as an array height x width x components, components as stored (YCbCr), sampled up by repeats."""
    j, at = parse_jpeg(data)
    huff = {k: v for k, v in j["huff"].items()}
    hmax, vmax = max(p[1] for p in j["parts"]), max(p[2] for p in j["parts"])
    mx, my = -(-j["width"] // (8 * hmax)), -(-j["height"] // (8 * vmax))
    planes = [np.zeros((my * v, mx * h, 64)) for _, h, v, _ in j["parts"]]
    pos, acc, left = at, 0, 0

    def bit() -> int:
        nonlocal pos, acc, left
        if not left:
            acc, left = data[pos], 8
            pos += 2 if acc == 255 else 1
        left -= 1
        return acc >> left & 1

    def symbol(table) -> int:
        n, code = 1, bit()
        while (n, code) not in table:
            n, code = n + 1, code << 1 | bit()
            if n > 16:
                raise ValueError("no such Huffman code")
        return table[n, code]

    def number(n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | bit()
        return v if not n or v >> n - 1 else v - (1 << n) + 1

    order = {p[0]: k for k, p in enumerate(j["parts"])}
    pred = [0] * len(planes)
    for mcu in range(mx * my):
        if j["restart"] and mcu and mcu % j["restart"] == 0:
            left, pred = 0, [0] * len(planes)
            pos = data.index(b"\xff", pos) + 2 if data[pos] != 255 else pos + 2
        for c, dc, ac in j["scan"]:
            k = order[c]
            _, h, v, tq = j["parts"][k]
            for y in range(v):
                for x in range(h):
                    block = np.zeros(64)
                    pred[k] += number(symbol(huff[0, dc]))
                    block[0] = pred[k]
                    i = 1
                    while i < 64:
                        s = symbol(huff[1, ac])
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            block[i] = number(s & 15)
                        i += 1
                    coefficients = np.zeros(64)
                    coefficients[ZIGZAG] = block * j["q"][tq]
                    planes[k][mcu // mx * v + y, mcu % mx * h + x] = (_COS @ coefficients.reshape(8, 8) @ _COS.T).ravel()
    out = []
    for p, (_, h, v, _) in zip(planes, j["parts"]):
        by, bx, _ = p.shape
        img = np.clip(np.rint(p.reshape(by, bx, 8, 8).transpose(0, 2, 1, 3).reshape(by * 8, bx * 8)) + 128, 0, 255)
        out.append(img.repeat(vmax // v, 0).repeat(hmax // h, 1)[: j["height"], : j["width"]])
    return np.stack(out, axis=-1).astype(np.uint8)


# ------------------------------------------------------------------ shots


def grey(frames: list[bytes]) -> np.ndarray:
    """Samples of each frame's first component: its blocks where the field layout holds, else its pixels."""
    try:
        return decode_blocks(frames)
    except ValueError:
        return np.stack([decode_jpeg(f)[..., 0].ravel() for f in frames])


def differences(samples: np.ndarray, bins: int = 16) -> np.ndarray:
    """Half the L1 distance of neighbouring frames' normalised grey histograms, 0 to 1."""
    n = len(samples)
    h = np.bincount((samples // (256 // bins) + (np.arange(n) * bins)[:, None]).ravel(), minlength=n * bins).reshape(n, bins) / samples.shape[1]
    return np.abs(np.diff(h, axis=0)).sum(1) / 2


def cuts(diff: np.ndarray, k: float = 2.0, least: float = 0.15, around: int = 24) -> np.ndarray:
    """Frames that begin a shot: differences over the mean plus k deviations of those in the window around them."""
    if not len(diff):
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(diff)])
    squares = np.concatenate([[0], np.cumsum(diff**2)])
    i = np.arange(len(diff))
    a, b = np.maximum(0, i - around), np.minimum(len(diff), i + around + 1)
    mean = (sums[b] - sums[a]) / (b - a)
    deviation = np.sqrt(np.maximum(0, (squares[b] - squares[a]) / (b - a) - mean**2))
    return np.flatnonzero((diff > mean + k * deviation) & (diff > least)) + 1


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = text_bytes(text)
    return len(raw), raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def store_media(docs: DataFrame, most_bytes: int = 4 << 20) -> DataFrame:
    """docs(doc_id, text) as doc_id and the AVI file in the binary column media, with n_bytes before padding. Files leave
    the worker in parts of about most_bytes (more only where one file is larger), and go on in batches of that size."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "n_bytes": [], "media": []}
            size = 0
            for i, text in zip(b["doc_id"], b["text"]):
                n, payload = payload_of(text)
                data = write_avi(frames_of(payload))
                for c, x in zip(out, (i, n, data)):
                    out[c].append(x)
                size += len(data)
                if size >= most_bytes:
                    yield out
                    out, size = {c: [] for c in out}, 0
            yield out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """A row for each shot of media(doc_id, media): shot number, frames [start, end), seconds, mean difference."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for i, data in zip(b["doc_id"], b["media"]):
                if not data:
                    continue
                avi = read_avi(data)
                if not avi["frames"]:
                    continue
                diff = differences(grey(avi["frames"]))
                ends = [0, *cuts(diff).tolist(), len(avi["frames"])]
                for k, (s, e) in enumerate(zip(ends, ends[1:])):
                    rows.append((i, k, s, e, s / avi["fps"], e / avi["fps"], float(diff[s : e - 1].mean()) if e - s > 1 else 0.0))
            names = ("doc_id", "shot", "start_frame", "end_frame", "start_s", "end_s", "mean_difference")
            yield {n: [r[k] for r in rows] for k, n in enumerate(names)}

    return map_batches(media.select("doc_id", "media"), run, "doc_id long, shot int, start_frame long, end_frame long, start_s double, end_s double, mean_difference double")


def media_digest(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: the payload read back, and features of its frames and shots."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for data in b["media"]:
                frames = read_avi(data)["frames"]
                samples = grey(frames)
                payload, diff = samples.tobytes(), differences(samples)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-16:]))
                out["media_bytes"].append(len(data))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
                out["feature"].append(f"frames={len(frames)};shots={len(cuts(diff)) + 1};grey={samples.mean():.4f};difference={diff.mean() if len(diff) else 0:.4f}")
            yield {"doc_id": b["doc_id"], "n_bytes": b["n_bytes"]} | out

    return map_batches(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(store_media(documents(spark, sf_dir, "doc_id", "text")))


#: SQL has no JPEG coder; the tests hold op8 against the payload and the sequential decoder.
ORACLE_SQL = None
