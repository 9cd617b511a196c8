"""Opening documents on executors: the text layer of PDF files, images, and OCR through a command.

The text layer is read with the standard library alone. Pages are rasterised and recognised by commands, if the
machine has them: ``pdftoppm`` and ``tesseract``, or whatever is named instead.
"""

from __future__ import annotations

import csv
import io
import os
import re
import subprocess
import tempfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from findery.config import Extraction
from findery.operators.extract import Recognized, mean_confidence, pixel_scale

#: Seconds that a command may take for one document.
TIMEOUT = 300

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
#: A content stream's strings, arrays' ends, names, numbers and operators.
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|[\[\]]|/[^\s/\[\]()<>]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Shift inside a string array, in thousandths, that stands for a space.
_GAP = -200


class Pdf:
    """Pages and their text, as far as unencrypted files with deflated or plain streams give them."""

    def __init__(self, raw: bytes):
        if not raw.lstrip()[:5] == b"%PDF-" or b"/Encrypt" in raw:
            raise ValueError("not a PDF file that can be read")
        self.objects = {int(n): body for n, body in _OBJECT.findall(raw)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body) and (found := self._stream(body)):
                head = re.search(rb"/First\s+(\d+)", body)
                first = int(head[1]) if head else 0
                places = list(map(int, found[:first].split()))
                for n, at, to in zip(places[::2], places[1::2], [*places[3::2], len(found)], strict=False):
                    self.objects.setdefault(n, found[first + at : first + to])
        self.pages = list(self._pages())
        if not self.pages:
            raise ValueError("no pages")

    def _stream(self, body: bytes) -> bytes:
        found = _STREAM.search(body)
        if not found:
            return b""
        head = body[: found.start()]
        return zlib.decompressobj().decompress(found[1]) if b"/FlateDecode" in head else b"" if b"/Filter" in head else found[1]

    def _value(self, body: bytes, key: bytes) -> bytes:
        """The value of a key: an object that is referred to, a dictionary or array as it stands, or the rest of the line."""
        found = re.search(rb"/" + key + rb"\b\s*", body)
        if not found:
            return b""
        rest = body[found.end() :]
        if ref := _REF.match(rest):
            return self.objects.get(int(ref[1]), b"")
        if rest[:2] == b"<<" or rest[:1] == b"[":
            depth = 0
            for m in re.finditer(rb"<<|>>|\[|\]", rest):
                depth += 1 if m[0] in (b"<<", b"[") else -1
                if not depth:
                    return rest[: m.end()]
        return rest.split(b"\n", 1)[0]

    def _pages(self) -> Iterator[tuple[bytes, bytes]]:
        """Every page with the attributes that it inherits, in reading order."""
        seen = set()

        def below(n: int, inherited: bytes) -> Iterator[tuple[bytes, bytes]]:
            body = self.objects.get(n, b"")
            if n in seen:
                return
            seen.add(n)
            if kids := self._value(body, b"Kids"):
                for k in _REF.findall(kids):
                    yield from below(int(k), body + inherited)
            elif re.search(rb"/Type\s*/Page\b", body):
                yield body, inherited

        for body in self.objects.values():
            if re.search(rb"/Type\s*/Catalog", body) and (root := re.search(rb"/Pages\s+(\d+)", body)):
                yield from below(int(root[1]), b"")

    def size(self, page: int) -> tuple[float, float]:
        """Width and height in points; A4 where the file does not say."""
        box = re.findall(rb"[-+.\d]+", self._value(b"".join(self.pages[page]), b"MediaBox"))
        return (float(box[2]) - float(box[0]), float(box[3]) - float(box[1])) if len(box) >= 4 else (595.0, 842.0)

    def _fonts(self, page: tuple[bytes, bytes]) -> dict[bytes, tuple[int, dict[int, str]]]:
        """Font name to the bytes of a code and the text that codes stand for, where the font says so."""
        out = {}
        listed = self._value(self._value(b"".join(page), b"Resources") or b"".join(page), b"Font")
        for name, n in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", listed):
            font = self.objects.get(int(n), b"")
            out[name] = (2 if b"/Type0" in font else 1, self._codes(self._stream(self._value(font, b"ToUnicode"))))
        return out

    @staticmethod
    def _codes(cmap: bytes) -> dict[int, str]:
        def text(x: bytes) -> str:
            return bytes.fromhex(x.decode()).decode("utf-16-be", "replace")

        out = {}
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            out.update((int(a, 16), text(b)) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block))
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                start = int.from_bytes(text(c).encode("utf-32-be")[-4:])
                out.update((code, text(c)[:-1] + chr(start + code - int(a, 16))) for code in range(int(a, 16), int(b, 16) + 1))
        return out

    def text(self, page: int) -> str:
        body = self.pages[page]
        fonts, own = self._fonts(body), (1, {})
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body[0])
        content = b"\n".join(self._stream(self.objects.get(int(n), b"")) for n in _REF.findall(refs[1])) if refs else b""
        out, operands, inside = [], [], False
        for token in _TOKEN.findall(content):
            first = token[:1]
            if first in b"(<":
                operands.append(_decode(token, *own))
            elif first == b"[":
                inside = True
            elif first == b"]":
                inside = False
            elif first == b"/" or first in b"-+.0123456789":
                if inside and first != b"/" and _number(token) < _GAP:
                    operands.append(" ")
                elif first == b"/":
                    operands = [token[1:]]
            else:
                if token == b"Tf" and operands and isinstance(operands[-1], bytes):
                    own = fonts.get(operands[-1], (1, {}))
                elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                    out.append("\n")
                elif token in (b"Tj", b"TJ", b"'", b'"'):
                    out.append("\n" * (token in (b"'", b'"')) + "".join(x for x in operands if isinstance(x, str)))
                operands = []
        return re.sub(r"\n+", "\n", "".join(out)).strip()


def _number(token: bytes) -> float:
    try:
        return float(token)
    except ValueError:
        return 0.0


def _decode(token: bytes, width: int, codes: dict[int, str]) -> str:
    """The text of a string token under a font."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if not codes:
        return raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    return "".join(codes.get(int.from_bytes(raw[k : k + width]), "") for k in range(0, len(raw), width))


def pdf_text(raw: bytes, max_pages: int | None = None) -> str | None:
    """The text layer of the first pages, stripped; empty if there is none, null if the file cannot be read."""
    try:
        pdf = Pdf(raw)
        return "\n".join(pdf.text(k) for k in range(min(len(pdf.pages), max_pages or len(pdf.pages)))).strip()
    except Exception:
        return None


def image_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, JPEG or TIFF image from its head; null if it is none of them."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return int.from_bytes(raw[16:20]), int.from_bytes(raw[20:24])
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            if raw[at + 1] in range(0xC0, 0xD0) and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(raw[at + 7 : at + 9]), int.from_bytes(raw[at + 5 : at + 7])
            at += 2 + int.from_bytes(raw[at + 2 : at + 4])
    if raw[:4] in (b"II*\0", b"MM\0*"):
        order = "little" if raw[:2] == b"II" else "big"
        at = int.from_bytes(raw[4:8], order)
        found = {}
        for k in range(int.from_bytes(raw[at : at + 2], order)):
            entry = raw[at + 2 + 12 * k : at + 14 + 12 * k]
            kind = int.from_bytes(entry[2:4], order)
            found[int.from_bytes(entry[:2], order)] = int.from_bytes(entry[8:10] if kind == 3 else entry[8:12], order)
        if 256 in found and 257 in found:
            return found[256], found[257]
    return None


@dataclass(frozen=True)
class FolderReader:
    """Documents below a folder that all executors see."""

    root: str
    rasterizer: str = "pdftoppm"

    def _read(self, path: str) -> bytes:
        with open(os.path.join(self.root, path), "rb") as f:
            return f.read()

    def text_layer(self, path: str, max_pages: int) -> str | None:
        try:
            return pdf_text(self._read(path), max_pages)
        except OSError:
            return None

    def images(self, path: str, ext: str, config: Extraction) -> Sequence[bytes] | None:
        """The image itself, or grey pictures of a PDF file's first pages; nothing if it cannot be opened."""
        try:
            raw = self._read(path)
        except OSError:
            return None
        if ext not in config.pdf_extensions:
            return [raw] if image_size(raw) else None
        try:
            pdf = Pdf(raw)
        except Exception:
            return None
        out = []
        with tempfile.TemporaryDirectory() as folder:
            for page in range(min(len(pdf.pages), config.max_pages)):
                dpi = 72 * pixel_scale(*pdf.size(page), config)
                name = f"{folder}/{page}"
                run = subprocess.run([self.rasterizer, "-gray", "-png", "-singlefile", "-r", f"{dpi:.2f}", "-f", str(page + 1), "-l", str(page + 1), "-", name], input=raw, capture_output=True, timeout=TIMEOUT)
                if run.returncode or not os.path.exists(f"{name}.png"):
                    return None
                with open(f"{name}.png", "rb") as f:
                    out.append(f.read())
        return out


@dataclass(frozen=True)
class CommandOcr:
    """Recognition by a command that takes an image and gives a table of words with their confidence."""

    command: tuple[str, ...] = ("tesseract", "stdin", "stdout", "tsv")

    def recognize(self, images: Sequence[bytes]) -> Recognized:
        pages, confidence = [], []
        for image in images:
            run = subprocess.run(self.command, input=image, capture_output=True, timeout=TIMEOUT, check=True)
            rows = list(csv.DictReader(io.StringIO(run.stdout.decode("utf-8", "replace")), delimiter="\t", quoting=csv.QUOTE_NONE))
            pages.append(" ".join(w for r in rows if (w := (r["text"] or "").strip())))
            confidence += [float(r["conf"]) for r in rows]
        return Recognized("\n".join(pages), mean_confidence(confidence))


def ocr_backend(command: str | None = None) -> CommandOcr:
    """The OCR backend, or one that runs another command with the same arguments."""
    return CommandOcr() if command is None else CommandOcr((command, *CommandOcr.command[1:]))
