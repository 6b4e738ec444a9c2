"""Small decoders and encoders of image and volume files, on bytes; the readers run them on executors."""

from __future__ import annotations

import gzip
import re
import struct
import zlib

import numpy as np


def encode_png(pixels: np.ndarray) -> bytes:
    """8-bit grey (h, w) or colour (h, w, 3)."""
    h, w = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else 2
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()

    def part(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """8-bit grey or colour, not interlaced: (h, w) or (h, w, channels)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        head = part if name == b"IHDR" else head
        if name == b"IDAT":
            body.append(part)
        at += 12 + n
    w, h, bits, kind, _, _, laced = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind)
    if bits != 8 or laced or channels is None:
        raise ValueError("only plain 8-bit grey and colour PNG files are read")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    for y in range(h):
        line, above = raw[y, 1:], out[y - 1] if y else np.zeros(w * channels, np.uint8)
        f = raw[y, 0]
        if f == 0:
            out[y] = line
        elif f == 1:
            out[y] = np.cumsum(line.reshape(w, channels), axis=0, dtype=np.uint8).ravel()
        elif f == 2:
            out[y] = line + above
        else:
            out[y] = np.frombuffer(_unfilter(f, line.tolist(), above.tolist(), channels), np.uint8)
    return out if channels == 1 else out.reshape(h, w, channels)


def _unfilter(kind: int, line: list[int], above: list[int], step: int) -> bytes:
    """A row of a PNG that goes by the mean (3) or Paeth's choice (4) of its neighbours, each byte from the one a pixel before."""
    row = [0] * step + line
    if kind == 3:
        for i, b in enumerate(above, step):
            row[i] = (row[i] + (row[i - step] + b) // 2) & 255
    else:
        before = [0] * step + above
        for i, b in enumerate(above, step):
            a, c = row[i - step], before[i - step]
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            row[i] = (row[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return bytes(row[step:])


def encode_tiff(pixels: np.ndarray) -> bytes:
    """8-bit grey, uncompressed, one strip."""
    h, w = pixels.shape
    body = np.ascontiguousarray(pixels, np.uint8).tobytes()
    tags = [(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(body))]
    pad = len(body) % 2
    directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, 8 + len(body) + pad) + body + b"\0" * pad + directory


def encode_nifti(volume: np.ndarray, affine: np.ndarray, compress: bool = True) -> bytes:
    """uint8 (x, y, z) with its affine in the header's rows."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *volume.shape, 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, 2, 8)
    spacing = np.sqrt((affine[:3, :3] ** 2).sum(axis=0))
    struct.pack_into("<8f", head, 76, 1.0, *spacing, 1, 1, 1, 1)
    struct.pack_into("<f", head, 108, 352.0)
    struct.pack_into("<f", head, 112, 1.0)
    struct.pack_into("<hh", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    data = bytes(head) + np.asarray(volume, np.uint8).tobytes(order="F")
    return gzip.compress(data, mtime=0) if compress else data


def decode_nifti(data: bytes) -> tuple[np.ndarray, tuple[float, float, float], np.ndarray]:
    """(values (x, y, z), spacing, affine); further axes take their first entry."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dims = struct.unpack(order + "8h", data[40:56])
    kind = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}.get(struct.unpack(order + "h", data[70:72])[0])
    if kind is None:
        raise ValueError("unknown NIfTI type")
    spacing = struct.unpack(order + "8f", data[76:108])[1:4]
    offset, slope, inter = struct.unpack(order + "3f", data[108:120])
    shape = dims[1 : dims[0] + 1]
    values = np.frombuffer(data, np.dtype(kind).newbyteorder(order), int(np.prod(shape)), int(offset)).reshape(shape, order="F")
    while values.ndim > 3:
        values = values[..., 0]
    if slope not in (0.0, 1.0) or inter:
        values = values * (slope or 1.0) + inter
    affine = np.vstack([np.array(struct.unpack(order + "12f", data[280:328])).reshape(3, 4), [0, 0, 0, 1]])
    return values, spacing, affine


def decode_nrrd(data: bytes) -> tuple[np.ndarray, tuple[float, float, float] | None]:
    """(values (z, y, x), spacing (x, y, z) or None): raw and gzip bodies; axes go to z, y, x by their largest direction and negative ones are flipped."""
    head, _, body = data.partition(b"\n\n")
    lines = head.decode("ascii", "replace").splitlines()
    if not lines[0].startswith("NRRD"):
        raise ValueError("not an NRRD file")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x and not x.startswith("#"))}
    kinds = {"uchar": "u1", "unsigned char": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "float": "f4", "double": "f8"}
    kind = np.dtype(kinds[fields["type"]]).newbyteorder(">" if fields.get("endian", "little") == "big" else "<")
    if fields["encoding"] in ("gzip", "gz"):
        body = gzip.decompress(body)
    elif fields["encoding"] != "raw":
        raise ValueError("only raw and gzip NRRD files are read")
    sizes = [int(v) for v in fields["sizes"].split()]
    values = np.frombuffer(body, kind, int(np.prod(sizes))).reshape(sizes, order="F")
    if values.ndim == 4:
        values = values[..., 0]
    if values.ndim != 3:
        raise ValueError("not a volume")
    vectors = [[float(v) for v in m.split(",")] for m in re.findall(r"\(([^)]*)\)", fields.get("space directions", ""))][:3]
    if len(vectors) != 3:
        return values.transpose(2, 1, 0), None
    axis = [int(np.argmax(np.abs(v))) for v in vectors]
    if sorted(axis) != [0, 1, 2]:
        axis = [0, 1, 2]
    for i, a in enumerate(axis):
        if vectors[i][a] < 0:
            values = np.flip(values, i)
    spacing = tuple(float(np.linalg.norm(vectors[axis.index(a)])) for a in range(3))
    return values.transpose([axis.index(2), axis.index(1), axis.index(0)]), spacing


def is_dicom(data: bytes) -> bool:
    return data[128:132] == b"DICM" or data[:2] in (b"\x02\x00", b"\x08\x00", b"\x10\x00")


def decode_dicom(data: bytes) -> tuple[np.ndarray, dict[str, object]]:
    """Pixels (h, w) and the spacing tags of an uncompressed little-endian file; others are refused."""
    at, explicit, tags = (132, True, {}) if data[128:132] == b"DICM" else (0, False, {})
    wanted = {(0x0018, 0x0050): "thickness", (0x0018, 0x0088): "spacing_between", (0x0020, 0x0032): "position", (0x0020, 0x0037): "orientation", (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns", (0x0028, 0x0100): "bits", (0x0028, 0x0103): "signed", (0x0028, 0x0030): "pixel_spacing", (0x0002, 0x0010): "syntax"}
    switched = False
    while at + 8 <= len(data):
        group, element = struct.unpack("<HH", data[at : at + 4])
        if group != 2 and not switched:
            syntax = str(tags.get("syntax", "1.2.840.10008.1.2")).strip("\0 ")
            if syntax not in ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1"):
                raise ValueError(f"transfer syntax {syntax} is not read")
            explicit, switched = syntax.endswith(".2.1"), True
        if explicit or group == 2:
            kind = data[at + 4 : at + 6]
            long = kind in (b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN")
            n, start = (struct.unpack("<I", data[at + 8 : at + 12])[0], at + 12) if long else (struct.unpack("<H", data[at + 6 : at + 8])[0], at + 8)
        else:
            n, start = struct.unpack("<I", data[at + 4 : at + 8])[0], at + 8
        if (group, element) == (0x7FE0, 0x0010):
            size = 1 if int(tags.get("bits", 16)) == 8 else 2
            kind = np.dtype(("i" if tags.get("signed") else "u") + str(size)).newbyteorder("<")
            h, w = int(tags["rows"]), int(tags["columns"])
            return np.frombuffer(data, kind, h * w, start).reshape(h, w), tags
        if n == 0xFFFFFFFF:
            raise ValueError("sequences of unknown length are not read")
        raw = data[start : start + n]
        if name := wanted.get((group, element)):
            if name in ("rows", "columns", "bits", "signed"):
                tags[name] = struct.unpack("<H", raw[:2])[0]
            elif name == "syntax":
                tags[name] = raw.decode("ascii")
            else:
                numbers = [float(v) for v in raw.decode("ascii").strip("\0 ").split("\\") if v.strip()]
                tags[name] = numbers if name in ("position", "orientation", "pixel_spacing") else (numbers or [None])[0]
        at = start + n
    raise ValueError("no pixels")


def stretch(values: np.ndarray) -> np.ndarray:
    """Values of one slice over 0..255, cut to whole numbers; single precision throughout."""
    v = values.astype(np.float32)
    v -= v.min()
    v /= v.max() + np.float32(1e-8)
    return (v * 255).astype(np.uint8)


def encode_stl(triangles: np.ndarray) -> bytes:
    """Binary STL of (n, 3, 3) triangles; a triangle without area has a zero normal."""
    t = np.asarray(triangles, np.float32).reshape(-1, 3, 3)
    n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    size = np.linalg.norm(n, axis=1, keepdims=True)
    n = np.divide(n, size, out=np.zeros_like(n), where=size > 0)
    rows = np.zeros(len(t), np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]))
    rows["n"], rows["v"] = n, t
    return b"\0" * 80 + struct.pack("<I", len(t)) + rows.tobytes()


def decode_stl(data: bytes) -> np.ndarray:
    n = struct.unpack("<I", data[80:84])[0]
    return np.frombuffer(data, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), n, 84)["v"].copy()
