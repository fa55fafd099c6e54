"""Plain text of PDF files: the strings that the content streams show, in the order of the streams.

Covers uncompressed and Flate-compressed streams with literal and hexadecimal strings in one-byte encodings. Other
filters and fonts with encodings of their own need an extractor of the caller's.
"""

from __future__ import annotations

import re
import zlib

STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
SHOWN = re.compile(rb"(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]()<>])*\])\s*(?:Tj|TJ|'|\")|\b(?:Td|TD|ET)\b|T\*")
STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>")
ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
#: Escapes of literal strings.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> bytes:
    return ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], m[1]), raw)


def _hexadecimal(raw: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", raw).decode()
    return bytes.fromhex(digits + "0" * (len(digits) % 2))


def extract_text(raw: bytes) -> str:
    """The text of a PDF; '' if none can be read."""
    lines: list[str] = [""]
    for stream in STREAM.finditer(raw):
        body = stream[1]
        try:
            body = zlib.decompressobj().decompress(body)
        except zlib.error:
            pass
        for m in SHOWN.finditer(body):
            if m[1] is None:
                lines.append("")
                continue
            parts = [_literal(s[1]) if s[1] is not None else _hexadecimal(s[2]) for s in STRING.finditer(m[1])]
            lines[-1] += b"".join(parts).decode("latin-1")
    return "\n".join(line for line in lines if line.strip())
