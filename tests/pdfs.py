"""Tiny PDF files made by hand."""

import zlib


def obj(n: int, body: bytes) -> bytes:
    return b"%d 0 obj\n%s\nendobj\n" % (n, body)


def stream(n: int, data: bytes, packed: bool = False, more: bytes = b"") -> bytes:
    data = zlib.compress(data) if packed else data
    return obj(n, b"<< /Length %d %s%s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if packed else b"", more, data))


def pdf(pages: list[bytes], packed: bool = False, trailer: bytes = b"") -> bytes:
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages)))
    out = [b"%PDF-1.4\n", obj(1, b"<< /Type /Catalog /Pages 2 0 R >>"), obj(2, b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), kids)), obj(3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")]
    for k, data in enumerate(pages):
        out += [obj(10 + 2 * k, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)), stream(11 + 2 * k, data, packed)]
    return b"".join(out) + b"trailer\n<< /Root 1 0 R %s >>\nstartxref\n0\n%%%%EOF" % trailer
