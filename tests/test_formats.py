"""Image formats: round trips, files written by hand, and what can't be read."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from stratalens.sources import formats as FM
from stratalens.sources import sinks
from stratalens.sources.readers import DECODERS, read_arrays
from stratalens.sources.synthetic import ball_images

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("shape", [(5, 7), (4, 6, 2), (9, 3, 3), (2, 2, 4)])
def test_png_round_trip(shape):
    a = RNG.integers(0, 256, shape)
    assert (FM.read_png(FM.write_png(a))["data"] == a).all()


@pytest.mark.parametrize("kind", range(5))
def test_png_predictors(kind):
    """Rows written with each predictor by its definition."""
    h, w, step = 6, 5, 3
    a = RNG.integers(0, 256, (h, w * step)).astype(np.uint8)
    rows = []
    for y in range(h):
        row = []
        for x in range(w * step):
            left = int(a[y, x - step]) if x >= step else 0
            up = int(a[y - 1, x]) if y else 0
            corner = int(a[y - 1, x - step]) if y and x >= step else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            guess = (0, left, up, (left + up) // 2, paeth)[kind]
            row.append((int(a[y, x]) - guess) % 256)
        rows.append(bytes([kind, *row]))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (FM.read_png(raw)["data"] == a.reshape(h, w, 3)).all()
    with pytest.raises(ValueError, match="checksum"):
        FM.read_png(raw[:-20] + b"\0" + raw[-19:])


@pytest.mark.parametrize("suffix", ["nrrd", "nii", "nii.gz", "npy"])
def test_volumes_round_trip(suffix):
    a = RNG.normal(size=(3, 4, 5))
    affine = np.array([[2.0, 0, 0, -1], [0, 1.5, 0, 3], [0, 0, 4, 5], [0, 0, 0, 1]])
    got = DECODERS[suffix](FM.writer_of(f"x.{suffix}")(a, affine))
    assert np.allclose(got["data"], a)
    if suffix != "npy":
        assert np.allclose(got["affine"], affine)


def dicom(explicit: bool, pixels: np.ndarray) -> bytes:
    def element(group, number, kind, value, is_explicit=explicit):
        value += b"\0" * (len(value) % 2)
        if not is_explicit:
            return struct.pack("<HHI", group, number, len(value)) + value
        long = kind in FM.LONG_KINDS
        return struct.pack("<HH2s", group, number, kind) + (struct.pack("<HI", 0, len(value)) if long else struct.pack("<H", len(value))) + value

    syntax = b"1.2.840.10008.1.2.1" if explicit else b"1.2.840.10008.1.2"
    short = lambda n: struct.pack("<H", n)
    body = element(2, 0x10, b"UI", syntax, True)
    body += element(0x20, 0x32, b"DS", b"10\\20\\30") + element(0x20, 0x37, b"DS", b"1\\0\\0\\0\\1\\0")
    body += element(0x28, 0x10, b"US", short(pixels.shape[0])) + element(0x28, 0x11, b"US", short(pixels.shape[1])) + element(0x28, 0x30, b"DS", b"0.5\\0.25")
    body += element(0x28, 0x100, b"US", short(16)) + element(0x28, 0x103, b"US", short(1)) + element(0x28, 0x1052, b"DS", b"-1024") + element(0x28, 0x1053, b"DS", b"2")
    body += element(0x7FE0, 0x10, b"OW", pixels.astype("<i2").tobytes())
    return b"\0" * 128 + b"DICM" + body


@pytest.mark.parametrize("explicit", [True, False])
def test_dicom(explicit):
    a = RNG.integers(-100, 100, (4, 6))
    got = FM.read_dicom(dicom(explicit, a))
    assert (got["data"] == a * 2 - 1024).all()
    assert got["affine"][:3, 3].tolist() == [10, 20, 30] and got["affine"][1, 0] == 0.5 and got["affine"][0, 1] == 0.25


def test_files_that_cannot_be_read_say_why(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(FM.write_png(np.eye(3) * 200))
    (tmp_path / "b.png").write_bytes(b"not a picture")
    (tmp_path / "c.xyz").write_bytes(b"?")
    got = {r.path.rsplit("/", 1)[1]: r for r in read_arrays(spark, str(tmp_path)).collect()}
    assert got["a.png"].shape == [3, 3] and got["a.png"].error is None and got["a.png"].data[0] == 200
    assert got["b.png"].data is None and "PNG" in got["b.png"].error and "no reader" in got["c.xyz"].error
    assert FM.is_supported("x.NII.GZ") and not FM.is_supported("x.xyz") and FM.is_supported("a.b", ["b"])


def test_arrays_are_saved_by_suffix(spark, tmp_path):
    df = ball_images(spark, 2, (8, 9), 3, (1, 3), 0.05)
    out = sinks.save_arrays(df.select(df.image_id.alias("name"), "shape", "data"), str(tmp_path / "t"), suffix="nrrd").collect()
    want = {str(r.image_id): np.array(r.data).reshape(r.shape) for r in df.collect()}
    assert all(np.allclose(FM.read_nrrd(bytes(r.content))["data"], want[r.name]) for r in out) and len(out) == 2
    sinks.write_mapping(df.selectExpr("'in' as a", "image_id as b"), "a", "b", str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_ball_images_repeat_and_hold_balls(spark):
    a, b = (ball_images(spark.newSession() if k else spark, 3, (16, 16), 4, (2, 4), 0.0, 3, seed=5).orderBy("image_id").collect() for k in (0, 1))
    assert [r.data for r in a] == [r.data for r in b] and a[0].data != a[1].data
    for r in a:
        assert all((v > 0) == (l > 0) for v, l in zip(r.data, r.label, strict=True)) and 0 < sum(x > 0 for x in r.label) < 256 and max(r.label) <= 3
