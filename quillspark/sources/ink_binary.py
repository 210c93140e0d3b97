"""Documents of binary note formats, each a function from bytes to the document model as plain values."""

from __future__ import annotations

import io
import json
import math
import struct
import zipfile
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .codecs import Malformed, bson, message_fields
from .ink_json import decoded_documents


def _color(argb: int) -> tuple[dict, float]:
    """Colour without alpha, and the alpha, of a packed number."""
    a, r, g, b = ((argb >> shift & 255) / 255.0 for shift in (24, 16, 8, 0))
    return {"r": r, "g": g, "b": b, "a": 1.0}, a


def _look(mode: str, color: dict, width: float | None, opacity: float, under: bool = False) -> dict:
    return {"mode": mode, "color": color, "width": width, "opacity": opacity, "blend": "darken" if under else "normal", "cap": "round", "join": "round", "underlay": under}


def _archive(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, NotImplementedError) as e:
        raise Malformed(str(e)) from e


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    try:
        return z.read(name)
    except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, KeyError) as e:
        raise Malformed(f"{name}: {e}") from e


# --- Saber ---------------------------------------------------------------------------------------

#: Families by the names of the app's tools; its page size and points for each unit.
SABER_TOOLS = {"fountainpen": "pen", "ballpoint": "ballpoint", "ballpointpen": "ballpoint", "fineliner": "fineliner", "brush": "brush", "pencil": "pencil", "highlighter": "highlighter", "shapepen": "pen"}
SABER_PAGE, SABER_SCALE = (1000.0, 1400.0), 0.595


def _saber_stroke(s: dict) -> dict | None:
    blobs = s.get("p") or []
    raw = [bytes.fromhex(b) if isinstance(b, str) else b"" for b in blobs]
    if not raw or min(map(len, raw)) < 8:
        return None
    floats = [np.frombuffer(b[: len(b) // 4 * 4], "<f4").astype(float) for b in raw]
    x, y = ([f[k] for f in floats] for k in (0, 1))
    pressed = bool(s.get("pe"))
    name, size = str(s.get("ty", "")), float(s.get("s", 2.0))
    family = SABER_TOOLS.get(name.lower(), "unknown")
    color, alpha = _color(int(s.get("c", 0xFF000000)))
    channels = {"width": [size] * len(x)}
    if pressed and all(len(f) > 2 for f in floats):
        channels["pressure"] = [f[2] for f in floats]
    rest = {k: v for k, v in s.items() if k not in ("p", "i")}
    params = {"size": size, "smoothing": s.get("sm"), "pressure_enabled": pressed, "raw": rest}
    return {"x": x, "y": y, "tool": {"family": family, "native": {"format_id": "saber", "tool_id": name, "params": params}}, "color": color, "channels": channels, "appearance": _look("stroked_constant", color, size, alpha, family == "highlighter")}


def saber(data: bytes, title: str) -> dict:
    """Pages ``z`` of a BSON document, bare or the first note of a zip file; strokes ``s`` and texts ``q`` of each."""
    if data[:2] == b"PK":
        z = _archive(data)
        notes = [n for n in z.namelist() if n.endswith((".sbn2", ".sbn"))]
        if not notes:
            raise Malformed("no note in the archive")
        data = _member(z, notes[0])
    doc = bson(data)
    pages = []
    try:
        for page in (p for p in doc.get("z") or [] if isinstance(p, dict)):
            strokes = [_saber_stroke(s) for s in page.get("s") or [] if isinstance(s, dict)]
            texts = [{"x": 0.0, "y": 0.0, "text": q["insert"]} for q in page.get("q") or [] if isinstance(q, dict) and isinstance(q.get("insert"), str)]
            w, h = (float(page.get(k, v)) for k, v in zip("wh", SABER_PAGE))
            layer = {"name": "", "visible": True, "strokes": [s for s in strokes if s], "texts": texts}
            pages.append({"bounds": {"x_min": 0.0, "y_min": 0.0, "x_max": w, "y_max": h}, "point_scale": SABER_SCALE, "layers": [layer]})
    except (TypeError, ValueError, AttributeError) as e:
        raise Malformed(str(e)) from e
    return {"format_id": "saber", "title": title, "metadata": {"sbn_version": doc.get("v")}, "pages": pages}


# --- PencilKit -----------------------------------------------------------------------------------

#: Channels by bit, with their types in a block; families by ink; epoch of dates; padding of the bounds.
PENCIL_CHANNELS = [("x,y", "f4,f4"), ("time", "f4"), ("width", "f4"), ("aspect", "u2"), ("unknown4", "u2"), ("force", "u2"), ("azimuth", "u2"), ("altitude", "u2"), ("opacity", "u2"), ("second", "f4"), ("unknown10", "u2")]
PENCIL_INKS = {"pen": "pen", "pencil": "pencil", "marker": "marker", "monoline": "fineliner", "fountainpen": "calligraphy", "watercolor": "brush", "crayon": "pencil"}
PENCIL_MAGIC, PENCIL_EPOCH, PENCIL_PAD = b"wrd\xf0", 978307200.0, 10.0
_EVERY = (1 << len(PENCIL_CHANNELS)) - 1


def _fields(data: bytes) -> dict[int, list]:
    """Values of a message by field number; fixed-size ones as numbers."""
    found: dict[int, list] = {}
    for f in message_fields(data):
        code = {1: "<d", 5: "<f"}.get(f["wire"])
        value = struct.unpack(code, f["bytes"])[0] if code else f["number"] if f["wire"] == 0 else f["bytes"]
        found.setdefault(f["field"], []).append(value)
    return found


def _record(mask: int) -> np.dtype:
    """A block of the channels that a mask selects: ascending bits, no padding, little endian."""
    parts = [(n, "<" + t) for bit, (names, types) in enumerate(PENCIL_CHANNELS) if mask >> bit & 1 for n, t in zip(names.split(","), types.split(","))]
    return np.dtype(parts)


def _pencil_points(path: dict[int, list]) -> tuple[dict[str, np.ndarray], int]:
    """Arrays of every channel, and the mask of those that vary."""
    if not all(k in path for k in (3, 4, 5)):
        raise Malformed("path lacks a field")
    count, own, shared = (path[k][0] for k in (3, 4, 5))
    if own | shared != _EVERY or own & shared:
        raise Malformed("channel masks")
    blocks = []
    for mask, field, rows in ((own, 7, count), (shared, 6, 1)):
        raw, kind = path.get(field, [b""])[0], _record(mask)
        if kind.itemsize * rows != len(raw):
            raise Malformed("channel block size")
        blocks.append(np.frombuffer(raw, kind, rows) if kind.itemsize else np.empty(rows, kind))
    points = {n: blocks[0][n].astype(float) for n in blocks[0].dtype.names or ()}
    points |= {n: np.full(count, blocks[1][n][0], dtype=float) for n in blocks[1].dtype.names or ()}
    for name, scale in (("aspect", 1000), ("force", 1000), ("opacity", 32767.5)):
        points[name] = points[name] / scale
    points["azimuth"] = np.mod(points["azimuth"] / 32767.5 * math.pi - math.pi, 2 * math.pi)
    points["altitude"] = (1 - points["altitude"] / 65535) * (math.pi / 2)
    return points, own


def _pencil_stroke(data: bytes, inks: list[tuple[str, dict]]) -> tuple[dict, list[float]] | None:
    stroke = _fields(data)
    index = stroke.get(4, [0])[0]
    if not 0 <= index < len(inks) or 5 not in stroke:
        raise Malformed("stroke without ink or path")
    name, color = inks[index]
    path = _fields(stroke[5][0])
    points, varies = _pencil_points(path)
    x, y = points["x"], points["y"]
    if not len(x):
        return None
    bit = {names: k for k, (names, _) in enumerate(PENCIL_CHANNELS)}
    extra: dict = {}
    if 1 in path:
        extra["path_uuid"] = path[1][0].hex()
    if 2 in path:
        extra["created_unix"] = path[2][0] + PENCIL_EPOCH
    box = [f["bytes"] for f in message_fields(stroke[6][0])] if 6 in stroke else []
    bounds = None
    if len(box) == 4 and all(b is not None and len(b) in (4, 8) for b in box):
        bounds = extra["render_bounds"] = [struct.unpack("<f" if len(b) == 4 else "<d", b)[0] for b in box]
    channels = {"width": points["width"], "timestamp": points["time"], "tilt_azimuth": points["azimuth"], "tilt_altitude": points["altitude"], "pressure": np.clip(points["force"], 0, 1)}
    if (channels["pressure"] != points["force"]).any():
        extra["force_raw"] = points["force"].tolist()
    opacity = float(points["opacity"][0])
    if varies >> bit["opacity"] & 1:
        channels["alpha"], opacity = points["opacity"], 1.0
    width = points["width"]
    second = np.divide(points["second"], width, out=np.ones_like(width), where=width != 0)
    params: dict = {}
    for key, channel, values in (("aspect", "aspect", points["aspect"]), ("secondary_scale", "second", second)):
        if varies >> bit[channel] & 1:
            extra[key] = values.tolist()
        else:
            params[key] = float(values[0])
    extra |= {k: points[k].tolist() for k in ("unknown4", "unknown10") if points[k].any()}
    family = PENCIL_INKS.get(name.lower().removeprefix("com.apple.ink."), "unknown") if name.lower().startswith("com.apple.ink.") else "unknown"
    row = {
        "x": x.tolist(), "y": y.tolist(), "tool": {"family": family, "native": {"format_id": "pencilkit", "tool_id": name, "params": params}}, "color": color,
        "channels": {k: v.tolist() for k, v in channels.items()}, "appearance": _look("stroked_variable", color, None, opacity), "extra": {"pencilkit": extra},
    }
    return row, bounds or [float(x.min()), float(y.min()), float(x.max() - x.min()), float(y.max() - y.min())]


def pencilkit(data: bytes, title: str) -> dict:
    """One page whose bounds are those of all strokes, padded; an empty drawing has a letter page."""
    if data[:4] != PENCIL_MAGIC or len(data) < 6:
        raise Malformed("no drawing")
    top = _fields(data[6:])
    inks = []
    try:
        for raw in top.get(4, []):
            ink = _fields(raw)
            parts = [v for vs in (_fields(ink[1][0]) if 1 in ink else {}).values() for v in vs]
            if len(parts) != 4:
                raise Malformed("ink colour")
            inks.append((ink.get(2, [b""])[0].decode(), dict(zip("rgba", map(float, parts)))))
        drawn = [s for s in (_pencil_stroke(raw, inks) for raw in top.get(5, [])) if s]
    except (TypeError, AttributeError, UnicodeDecodeError, struct.error, OverflowError) as e:
        raise Malformed(str(e)) from e
    boxes = np.array([b for _, b in drawn]).reshape(-1, 4)
    low = boxes[:, :2].min(axis=0) - PENCIL_PAD if len(boxes) else np.zeros(2)
    high = (boxes[:, :2] + boxes[:, 2:]).max(axis=0) + PENCIL_PAD if len(boxes) else np.array([612.0, 792.0])
    page = {"bounds": dict(zip(("x_min", "y_min", "x_max", "y_max"), [*map(float, low), *map(float, high)])), "point_scale": 1.0, "layers": [{"name": "", "visible": True, "strokes": [s for s, _ in drawn], "texts": []}]}
    return {"format_id": "pencilkit", "title": title, "metadata": {"pk_container_version": struct.unpack_from("<H", data, 4)[0], "ink_ids": [n for n, _ in inks]}, "pages": [page]}


# --- registry ------------------------------------------------------------------------------------

#: Decoders by format, with the names of their files.
DECODERS: dict[str, tuple[Callable[[bytes, str], dict], str]] = {"saber": (saber, "*.{sba,sbn2,sbn}"), "pencilkit": (pencilkit, "*.pkdrawing")}


def reader(name: str) -> Callable[[SparkSession, str], DataFrame]:
    decode, patterns = DECODERS[name]
    return lambda spark, path: decoded_documents(spark, path, decode, patterns)
