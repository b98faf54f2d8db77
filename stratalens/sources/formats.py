"""Image file formats in plain Python and numpy: PNG, NRRD, DICOM (uncompressed) and NIfTI, read and written.

Each decoder takes a file's bytes and gives {name: array}; each encoder takes an array (and an affine)
and gives bytes. They run inside the tasks of ``read_arrays`` and ``save_arrays``.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable

import numpy as np

from stratalens.sources.readers import register_reader

# PNG: big-endian chunks (length, kind, body, CRC-32); rows deflated, each after one of five predictors.


@register_reader("png")
def read_png(raw: bytes) -> dict:
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, body, head, palette = 8, [], None, None
    while at + 8 <= len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        data = raw[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != int.from_bytes(raw[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    w, h, depth, color, _, _, interlaced = head
    if interlaced or depth not in (8, 16):
        raise ValueError("only 8 and 16 bits a sample, not interlaced, are read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step = channels * depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * step)
    out, above = np.empty((h, w * step), np.uint8), np.zeros(w * step, np.uint8)
    for y in range(h):
        above = out[y] = _unpredict(rows[y, 0], rows[y, 1:], above, step)
    a = out.reshape(h, w, channels) if depth == 8 else out.view(">u2").reshape(h, w, channels)
    if color == 3:
        a = palette[a[:, :, 0]]
    return {"data": a[:, :, 0] if a.shape[2] == 1 else a}


def _unpredict(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    out = row.reshape(-1, step).astype(np.int64)
    up = above.reshape(-1, step).astype(np.int64)
    if kind == 1:
        return (np.cumsum(out, axis=0) & 255).astype(np.uint8).ravel()
    left, corner = np.zeros(step, np.int64), np.zeros(step, np.int64)
    for x in range(len(out)):
        if kind == 3:
            guess = (left + up[x]) >> 1
        else:
            p = left + up[x] - corner
            a, b, c = np.abs(p - left), np.abs(p - up[x]), np.abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[x], corner))
        out[x] = left = (out[x] + guess) & 255
        corner = up[x]
    return out.astype(np.uint8).ravel()


def write_png(a: np.ndarray, affine: np.ndarray | None = None) -> bytes:
    """Grey or colour (last axis 2 to 4) images; values are clipped to 0 to 255 and rounded."""
    a = np.rint(np.clip(a, 0, 255)).astype(np.uint8)
    a = a[:, :, None] if a.ndim == 2 else a
    h, w, channels = a.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, w * channels)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


# NRRD: a text header up to an empty line, then raw or gzipped samples, first axis fastest.

# Names of sample types.
NRRD_TYPES = {"uchar": "u1", "uint8": "u1", "unsigned char": "u1", "signed char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "unsigned short": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "longlong": "i8", "int64": "i8", "float": "f4", "double": "f8"}


@register_reader("nrrd")
def read_nrrd(raw: bytes) -> dict:
    if not raw.startswith(b"NRRD"):
        raise ValueError("no NRRD file")
    end = raw.index(b"\n\n")
    fields = dict(x.split(":", 1) for x in raw[:end].decode("latin-1").splitlines()[1:] if ":" in x and not x.startswith("#"))
    fields = {k.strip().lower(): v.lstrip("=").strip() for k, v in fields.items()}
    body = raw[end + 2 :]
    if fields.get("encoding", "raw") in ("gzip", "gz"):
        body = gzip.decompress(body)
    order = ">" if fields.get("endian") == "big" else "<"
    shape = [int(x) for x in fields["sizes"].split()]
    data = np.frombuffer(body, order + NRRD_TYPES[fields["type"]], int(np.prod(shape))).reshape(shape, order="F")
    out = {"data": data}
    if "space directions" in fields:
        vectors = [[float(x) for x in v.strip("()").split(",")] for v in fields["space directions"].split() if v != "none"]
        n = len(vectors)
        affine = np.eye(n + 1)
        affine[:n, :n] = np.array(vectors).T
        if "space origin" in fields:
            affine[:n, n] = [float(x) for x in fields["space origin"].strip("()").split(",")]
        out["affine"] = affine
    return out


def write_nrrd(a: np.ndarray, affine: np.ndarray | None = None) -> bytes:
    lines = ["NRRD0004", "type: double", f"dimension: {a.ndim}", "sizes: " + " ".join(map(str, a.shape)), "endian: little", "encoding: gzip"]
    if affine is not None:
        n = len(affine) - 1
        vector = lambda v: "(" + ",".join(repr(float(x)) for x in v) + ")"
        lines += [f"space dimension: {n}", "space directions: " + " ".join(vector(affine[:n, k]) for k in range(n)), "space origin: " + vector(affine[:n, n])]
    return "\n".join(lines).encode() + b"\n\n" + gzip.compress(np.asarray(a, "<f8").tobytes(order="F"), 6, mtime=0)


# DICOM: elements (group, element, kind, length, value) after a preamble; little-endian, uncompressed pixels.

LONG_KINDS = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UT", b"UN", b"UC", b"UR", b"SV", b"UV", b"OV"}


def dicom_elements(raw: bytes) -> dict[tuple[int, int], bytes]:
    """Values by tag of the elements at the top level; sequences are passed over."""
    if raw[128:132] != b"DICM":
        raise ValueError("no DICOM file")
    out: dict[tuple[int, int], bytes] = {}
    at, explicit = 132, True
    while at + 8 <= len(raw):
        group, element = struct.unpack_from("<HH", raw, at)
        if group != 2 and out.get((2, 0x10), b"").rstrip(b"\0 ") == b"1.2.840.10008.1.2":
            explicit = False
        if explicit and (group, element) not in ((0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)):
            kind = raw[at + 4 : at + 6]
            size, head = (struct.unpack_from("<I", raw, at + 8)[0], 12) if kind in LONG_KINDS else (struct.unpack_from("<H", raw, at + 6)[0], 8)
        else:
            size, head = struct.unpack_from("<I", raw, at + 4)[0], 8
        if size == 0xFFFFFFFF:  # of open length: its items follow as elements
            at += head
            continue
        out.setdefault((group, element), raw[at + head : at + head + size])
        at += head + size
    return out


@register_reader("dcm", "dicom")
def read_dicom(raw: bytes) -> dict:
    e = dicom_elements(raw)
    number = lambda tag, default=0: int.from_bytes(e[tag][:2], "little") if tag in e else default
    text = lambda tag: e[tag].decode("latin-1").strip("\0 ").split("\\") if tag in e else []
    rows, cols, samples = number((0x28, 0x10)), number((0x28, 0x11)), number((0x28, 2), 1)
    frames = int(text((0x28, 8))[0]) if text((0x28, 8)) else 1
    kind = ("i" if number((0x28, 0x103)) else "u") + str(number((0x28, 0x100), 16) // 8)
    if e.get((2, 0x10), b"").rstrip(b"\0 ") not in (b"", b"1.2.840.10008.1.2", b"1.2.840.10008.1.2.1"):
        raise ValueError("compressed or big-endian pixels aren't read")
    a = np.frombuffer(e[(0x7FE0, 0x10)], "<" + kind, frames * rows * cols * samples).reshape([n for n in (frames, rows, cols, samples) if n > 1 or n in (rows, cols)])
    slope, inter = (float(text(t)[0]) if text(t) else d for t, d in (((0x28, 0x1053), 1.0), ((0x28, 0x1052), 0.0)))
    out = {"data": a * slope + inter if (slope, inter) != (1.0, 0.0) else a}
    if text((0x20, 0x37)) and text((0x20, 0x32)):
        across, down = np.array(list(map(float, text((0x20, 0x37))))).reshape(2, 3)
        sizes = list(map(float, text((0x28, 0x30)))) or [1.0, 1.0]
        thick = float(text((0x18, 0x50))[0]) if text((0x18, 0x50)) else 1.0
        affine = np.eye(4)
        affine[:3, 0], affine[:3, 1], affine[:3, 2] = down * sizes[0], across * sizes[1], np.cross(across, down) * thick
        affine[:3, 3] = list(map(float, text((0x20, 0x32))))
        out["affine"] = affine
    return out


def write_nifti(a: np.ndarray, affine: np.ndarray | None = None) -> bytes:
    """NIfTI-1 of doubles with the s-form."""
    affine = np.eye(4) if affine is None else np.asarray(affine, float)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, a.ndim, *a.shape, *[1] * (7 - a.ndim))
    struct.pack_into("<hh", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, 1, *np.sqrt((affine[:3, :3] ** 2).sum(axis=0)), 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<hh", head, 252, 0, 2)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asarray(a, "<f8").tobytes(order="F")


@register_reader("nii.gz")
def read_nifti_gz(raw: bytes) -> dict:
    from stratalens.sources.readers import DECODERS

    return DECODERS["nii"](gzip.decompress(raw))


def _npy(a: np.ndarray, affine: np.ndarray | None = None) -> bytes:
    import io

    f = io.BytesIO()
    np.save(f, a)
    return f.getvalue()


#: Encoders by suffix. More can be registered where their libraries are installed.
ENCODERS: dict[str, Callable] = {"npy": _npy, "png": write_png, "nrrd": write_nrrd, "nii": write_nifti, "nii.gz": lambda a, affine=None: gzip.compress(write_nifti(a, affine), 6, mtime=0)}


def register_writer(*suffixes: str):
    def add(f):
        for s in suffixes:
            ENCODERS[s.lower().lstrip(".")] = f
        return f

    return add


def writer_of(name: str) -> Callable:
    """The encoder of a file name's longest known suffix."""
    for s in sorted(ENCODERS, key=len, reverse=True):
        if name.lower().endswith("." + s):
            return ENCODERS[s]
    raise ValueError(f"no writer for {name}")


def is_supported(name: str, suffixes: list[str] | None = None) -> bool:
    """Whether a file's name ends with one of some suffixes (of the readers by default)."""
    from stratalens.sources.readers import DECODERS

    return any(name.lower().endswith("." + s.lower().lstrip(".")) for s in suffixes or DECODERS)
