"""Text layers, images and OCR by commands."""

import os
import stat
import struct
import zlib

import pytest

from findery.config import Config, Extraction
from findery.operators import extract, records
from findery.sources import documents


def pdf(pages, compress=True, packed=False, fonts=b"", kids_inherit=False):
    """A small file with one content stream for each page."""
    out, objects = [b"%PDF-1.5\n"], {}
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages)))
    objects[2] = f"<< /Type /Pages /Count {len(pages)} /MediaBox [0 0 842 1191] /Kids [{kids}] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>".encode()
    objects[5] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    objects[6] = b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>"
    cmap = b"2 beginbfchar <0001> <0048> <0002> <00E9> endbfchar 1 beginbfrange <0010> <0012> <AC00> endbfrange"
    streams = {7: cmap}
    for k, content in enumerate(pages):
        objects[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>".encode()
        streams[11 + 2 * k] = content
    if packed:
        names, body = [], b""
        for n, x in objects.items():
            names.append(f"{n} {len(body)}")
            body += x + b" "
        head = " ".join(names).encode() + b" "
        raw = zlib.compress(head + body)
        out.append(b"90 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n" % (len(objects), len(head), len(raw)) + raw + b"\nendstream endobj\n")
    else:
        out += [b"%d 0 obj " % n + x + b" endobj\n" for n, x in objects.items()]
    for n, x in streams.items():
        raw = zlib.compress(x) if compress else x
        out.append(b"%d 0 obj << %s /Length %d >> stream\n" % (n, b"/Filter /FlateDecode" if compress else b"", len(raw)) + raw + b"\nendstream endobj\n")
    return b"".join(out) + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGES = [
    b"BT /F1 12 Tf 72 700 Td (Riverside Plant \\(unit 3\\)) Tj 0 -14 Td [(P&) -20 (ID) -400 (sheet)] TJ ET",
    b"BT /F2 9 Tf 1 0 0 1 0 0 Tm <00010002> Tj T* <001000110012> Tj ET BT /F1 9 Tf (caf\\351 \\\n2021) ' ET",
    b"q 10 0 0 10 0 0 cm /Im1 Do Q",
]


@pytest.mark.parametrize("how", [{}, {"compress": False}, {"packed": True}])
def test_text_layer(how):
    raw = pdf(PAGES, **how)
    assert documents.pdf_text(raw) == "Riverside Plant (unit 3)\nP&ID sheet\nHé\n가각갂\ncafé 2021"
    assert documents.pdf_text(raw, 1) == "Riverside Plant (unit 3)\nP&ID sheet"
    assert documents.pdf_text(pdf(PAGES[2:])) == ""
    assert documents.Pdf(raw).size(0) == (842.0, 1191.0)


def test_files_that_cannot_be_read():
    for raw in (b"", b"junk", pdf(PAGES)[:60], pdf(PAGES).replace(b"trailer <<", b"trailer << /Encrypt 9 0 R")):
        assert documents.pdf_text(raw) is None


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\0\0\0\0"
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 30, 40) + b"\0" * 10
TIFF = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, 7, 0) + struct.pack("<HHII", 257, 4, 1, 9) + b"\0" * 4


def test_image_heads():
    assert [documents.image_size(x) for x in (PNG, JPEG, TIFF, b"GIF89a", b"", PNG[:10])] == [(640, 480), (40, 30), (7, 9), None, None, None]


def script(path, text):
    path.write_text(f"#!/bin/sh\n{text}\n")
    os.chmod(path, os.stat(path).st_mode | stat.S_IXUSR)
    return str(path)


def test_deep_scan_with_real_readers(spark, tmp_path):
    """PDF text, a PDF without text through pictures, images, and files that are none of them."""
    rows = 'level\\tconf\\ttext\\n1\\t-1\\t\\n5\\t90\\tCompressor\\n5\\t80\\tStation\\n5\\t70\\tMemo\\n'
    ocr = script(tmp_path / "ocr", f"cat > /dev/null; printf '{rows}'")
    made = script(tmp_path / "raster", f'cat > /dev/null; for x; do out="$x"; done; echo "$@" >> {tmp_path}/calls; printf picture > "$out.png"')
    root = tmp_path / "corpus"
    root.mkdir()
    files = {"text.pdf": pdf(PAGES), "scan.pdf": pdf([PAGES[2]] * 3), "photo.png": PNG, "bad.jpg": b"x", "broken.pdf": b"%PDF-", "table.xls": b""}
    for name, raw in files.items():
        (root / name).write_bytes(raw)
    pending = records.to_records(spark.createDataFrame([(n,) for n in [*files, "gone.pdf"]], "file_path string"), Config().rules, "t").where("extraction_status = 'pending_deep_scan'")
    reader = documents.FolderReader(str(root), made)
    found = {r.file_path: r for r in extract.extract(pending, reader, documents.ocr_backend(ocr), Extraction()).collect()}
    assert found["text.pdf"].source == "pdf_text" and found["text.pdf"].text.startswith("Riverside Plant (unit 3)")
    assert (found["scan.pdf"].text, found["scan.pdf"].source, round(found["scan.pdf"].confidence, 3)) == ("Compressor Station Memo\nCompressor Station Memo", "ocr", 0.8)
    assert found["photo.png"].text == "Compressor Station Memo" and found["photo.png"].reason is None
    assert {n: found[n].reason for n in ("bad.jpg", "broken.pdf", "gone.pdf", "table.xls")} == {"bad.jpg": "unreadable_image", "broken.pdf": "unreadable_pdf", "gone.pdf": "unreadable_pdf", "table.xls": "unsupported_extension_for_deep_scan"}
    calls = (tmp_path / "calls").read_text().splitlines()
    assert len(calls) == 2 and "-r 145.09" in calls[0]  # 2400 of 1191 points in 72 dpi
    broken = extract.extract(pending.where("file_path = 'photo.png'"), reader, documents.ocr_backend("/nowhere/ocr"), Extraction()).first()
    assert broken.reason.startswith("extraction_error")
