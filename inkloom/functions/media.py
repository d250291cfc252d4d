"""Images, relative paths, link rewriting and the YAML export."""

from __future__ import annotations

import posixpath
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".tif", ".tiff")
INLINE_PIXELS = 52


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG, GIF or JPEG header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 1 if marker == 0xFF else 2 if marker == 1 or 0xD0 <= marker <= 0xD8 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def is_image_target(target: str) -> bool:
    return re.split(r"[#?]", target, maxsplit=1)[0].lower().endswith(IMAGE_SUFFIXES)


def relative_path(target: str, page: str) -> str:
    """The way from a page's file to another file of the mirror."""
    return posixpath.relpath(target, posixpath.dirname(page) or ".")


def render_image(path: str, alt: str, width: int | None, height: int | None, inline_limit: int | None = INLINE_PIXELS, max_width: int | None = None, sizes: bool = True, html: bool = True) -> str:
    """A small icon floats inline, anything else is a centred block; sizes are told if they are known, wide images scaled.

    Without ``html`` it is a Markdown image.
    """
    if not html:
        return f"![{alt}]({path})"
    known = bool(width and height)
    icon = known and bool(inline_limit) and max(width, height) <= inline_limit
    told = ""
    if known and sizes:
        scale = 100
        if max_width and width > max_width:
            height, scale = max(1, round(height * max_width / width)), max(1, round(100 * max_width / width))
            width = max_width
        told = f' crop="0,0,100,100"{"" if icon else f" scale={chr(34)}{scale}{chr(34)}"} width="{width}px" height="{height}px"'
    return f'<image src="{path}"{told} float="left"/>' if icon else f'\n\n<image src="{path}"{told} float="center"/>\n\n'


def humanise(name: str) -> str:
    return name.replace("-", " ").replace("_", " ").title()


def humanise_column(name: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else humanise(v))

    return run(name)


def to_yaml(value: object, depth: int = 0) -> str:
    """Mappings, lists and scalars; strings are quoted, line feeds escaped, anything nested goes on lines of its own."""
    pad = "  " * depth
    if not isinstance(value, (dict, list)) or not value:
        return f"{pad}{_scalar(value)}\n"
    heads = [(f"{pad}{k}:", v) for k, v in value.items()] if isinstance(value, dict) else [(f"{pad}-", v) for v in value]
    return "".join(f"{head}\n{to_yaml(v, depth + 1)}" if isinstance(v, (dict, list)) else f"{head} {_scalar(v)}\n" for head, v in heads)


def _scalar(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (dict, list)):
        return "{}" if isinstance(value, dict) else "[]"
    return '"' + str(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def from_yaml(text: str) -> object:
    """What ``to_yaml`` writes, read back."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]
    value, _ = _block(lines, 0, lines[0][0]) if lines else (None, 0)
    return value


def _value(text: str) -> object:
    if text in ("null", "~", ""):
        return None
    if text in ("true", "false"):
        return text == "true"
    if text in ("[]", "{}"):
        return [] if text == "[]" else {}
    if text[0] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n"}.get(m[1], m[1]), text[1:-1])
    return int(text) if re.fullmatch(r"-?\d+", text) else float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text


def _block(lines: list[tuple[int, str]], at: int, indent: int) -> tuple[object, int]:
    """The value that begins at a line, and the line after it."""
    made: dict | list | None = None
    while at < len(lines) and lines[at][0] == indent:
        text = lines[at][1]
        entry = re.match(r"([^\s\":]+):(?:\s+(.*))?$", text)
        if text == "-" or text.startswith("- "):
            made = [] if made is None else made
            key, rest = None, text[2:].strip()
        elif entry:
            made = {} if made is None else made
            key, rest = entry[1], entry[2] or ""
        else:
            return (_value(text), at + 1) if made is None else (made, at)
        at += 1
        if rest and key is None and re.match(r"[^\s\":]+:(?:\s|$)", rest):  # a mapping that begins on its item's line
            lines[at - 1] = (indent + 2, rest)
            value, at = _block(lines, at - 1, indent + 2)
        elif not rest and at < len(lines) and lines[at][0] > indent:
            value, at = _block(lines, at, lines[at][0])
        else:
            value = _value(rest)
        made.append(value) if key is None else made.__setitem__(key, value)
    return made, at
