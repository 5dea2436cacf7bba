"""Hand-made PDF files, one planted leak each."""

from __future__ import annotations

import hashlib
import struct
import zlib

from palimpsest.sources.pdf import aes, objects


def build(objects: dict[int, bytes], trailer: bytes = b"", head: bytes = b"%PDF-1.7\n") -> bytes:
    """Numbered objects with a classic cross reference; 1 is the catalog."""
    body, at = head, {}
    for n, x in objects.items():
        at[n] = len(body)
        body += b"%d 0 obj\n" % n + x + b"\nendobj\n"
    start, size = len(body), max(objects) + 1
    body += b"xref\n0 1\n0000000000 65535 f \n"
    for n in sorted(at):
        body += b"%d 1\n%010d 00000 n \n" % (n, at[n])
    return body + b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, trailer, start)


def stream(data: bytes, attrs: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n" % (len(data), attrs) + data + b"\nendstream"


def deflated(data: bytes, attrs: bytes = b"") -> bytes:
    return stream(zlib.compress(data), b"/Filter /FlateDecode " + attrs)


def page(content: bytes, *, catalog: bytes = b"", more: dict[int, bytes] | None = None, attrs: bytes = b"", resources: bytes = b"", trailer: bytes = b"", packed: bool = False) -> bytes:
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R %s >>" % catalog, 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> %s >> %s >>" % (resources, attrs),
        4: (deflated if packed else stream)(content), 5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    }
    return build(objects | (more or {}), trailer)


def line(text: bytes, x: float = 72, y: float = 700, size: float = 14) -> bytes:
    return b"BT /F1 %g Tf %g %g Td (%s) Tj ET\n" % (size, x, y, text)


def updated(base: bytes, number: int, new: bytes) -> bytes:
    """A further revision that replaces an object."""
    before = base.rindex(b"startxref")
    start = int(base[before + 9 :].split()[0])
    at = len(base)
    body = base + b"%d 0 obj\n" % number + new + b"\nendobj\n"
    xref = len(body)
    return body + b"xref\n%d 1\n%010d 00000 n \ntrailer\n<< /Size 20 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (number, at, start, xref)


SECRET = b"SSN 532-11-0947"
_BASE = page(line(b"Settlement 815500 paid to Borealis"))
_XMP = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator><rdf:Seq><rdf:li>Olu Farrow</rdf:li></rdf:Seq></dc:creator></rdf:Description></rdf:RDF></x:xmpmeta>'
_XXE = b'<?xml version="1.0"?><!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><x><creator>&e;</creator></x>'


def _form(content: bytes, attrs: bytes = b"") -> bytes:
    return stream(content, b"/Type /XObject /Subtype /Form /BBox [0 0 612 792] /Resources << /Font << /F1 5 0 R >> >> " + attrs)


FILES: dict[str, bytes] = {
    "box_over_text": page(line(SECRET) + b"0 g 70 694 360 22 re f"),
    "white_box_over_text": page(line(b"Account 7003-1182 5566") + b"1 g 70 694 360 22 re f", packed=True),
    "grey_box": page(line(SECRET) + b"0.6 g 70 694 360 22 re f"),
    "cmyk_box": page(line(SECRET) + b"0 0 0 1 k 70 694 360 22 re f"),
    "outline_only": page(line(SECRET) + b"70 694 360 22 re S"),
    "page_background": page(b"0.9 g 0 0 612 792 re f 0 g " + line(SECRET)),
    "cover_in_form": page(line(b"Code 660071") + b"/X1 Do", resources=b"/XObject << /X1 6 0 R >>", more={6: _form(b"0 g 70 694 360 22 re f")}),
    "image_cover": page(line(b"Under image 9072") + b"q 360 0 0 22 70 694 cm /I1 Do Q", resources=b"/XObject << /I1 6 0 R >>", more={6: stream(b"\0", b"/Type /XObject /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray")}),
    "text_form": page(b"/X1 Do", resources=b"/XObject << /X1 6 0 R >>", more={6: stream(line(b"Figure text"), b"/Type /XObject /Subtype /Form /BBox [60 690 300 720] /Resources << /Font << /F1 5 0 R >> >>")}),
    "invisible_text": page(line(b"visible") + b"BT /F1 14 Tf 3 Tr 72 650 Td (Ilse 9034) Tj ET"),
    "invisible_in_form": page(line(b"visible") + b"/X1 Do", resources=b"/XObject << /X1 6 0 R >>", more={6: _form(b"BT 3 Tr /F1 14 Tf 72 600 Td (formsecret) Tj ET")}),
    "saved_state": page(b"q BT 3 Tr /F1 12 Tf 72 700 Td (hidden) Tj ET Q BT /F1 12 Tf 72 680 Td (shown) Tj ET"),
    "white_on_white": page(line(b"visible") + b"1 g " + line(b"Tomas 5521", y=650)),
    "white_on_dark": page(b"0 g 60 640 400 40 re f 1 g " + line(b"banner", y=650)),
    "tiny_text": page(line(b"visible") + line(b"tinysecret", y=650, size=0.2)),
    "off_page": page(line(b"visible") + line(b"outside", x=700)),
    "incremental_redaction": updated(_BASE, 4, stream(line(b"Settlement [REDACTED] paid to [REDACTED]"))),
    "retained_history": updated(_BASE, 4, stream(line(b"Settlement 815500 paid to Borealis and more"))),
    "literal_eof": page(line(b"a %%EOF in a text")),
    "embedded_file": page(line(b"see file"), catalog=b"/Names << /EmbeddedFiles << /Kids [6 0 R] >> >>", more={6: b"<< /Names [(stipends.csv) 7 0 R] >>", 7: b"<< /Type /Filespec /F (stipends.csv) /EF << /F 8 0 R >> >>", 8: deflated(b"who,sum\nkim,9\n")}),
    "file_annotation": page(line(b"x"), attrs=b"/Annots [<< /Type /Annot /Subtype /FileAttachment /Rect [0 0 9 9] /FS 6 0 R >>]", more={6: b"<< /Type /Filespec /UF (ledger.csv) /EF << /F 7 0 R >> >>", 7: stream(b"1234")}),
    "associated_file": page(line(b"x"), catalog=b"/AF [6 0 R]", more={6: b"<< /Type /Filespec /F (af.bin) >>"}),
    "metadata_leak": page(line(b"x"), catalog=b"/Metadata 7 0 R", trailer=b"/Info 6 0 R", more={6: b"<< /Author (Olu Farrow) /Title (Q3) /DocketNumber (DOCKET-71-B) /Producer (tool) >>", 7: stream(_XMP, b"/Type /Metadata /Subtype /XML")}),
    "xmp_only": page(line(b"x"), catalog=b"/Metadata 7 0 R", more={7: stream(_XMP, b"/Type /Metadata /Subtype /XML")}),
    "xmp_entities": page(line(b"x"), catalog=b"/Metadata 7 0 R", more={7: stream(_XXE)}),
    "page_xmp": page(line(b"x"), attrs=b"/Metadata 7 0 R", more={7: stream(_XMP)}),
    "unapplied_redact": page(line(b"Nadia under"), attrs=b"/Annots [<< /Type /Annot /Subtype /Redact /Rect [300 712 60 690] /OverlayText (REDACTED) /Contents (Nadia Brandt) >>]"),
    "sticky_note": page(line(b"x"), attrs=b"/Annots [<< /Type /Annot /Subtype /Text /Rect [0 0 9 9] /Contents (ring Petra) >>]"),
    "clean": page(line(b"nothing to see")),
}
_IV = bytes(range(16))


def _aes(key: bytes, data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return _IV + aes.Aes(key).encrypt(data + bytes([n]) * n, _IV)


def locked(kind: str, content: bytes, password: bytes = b"") -> bytes:
    """A file whose streams are encrypted; kind: aes128, aes256 (revision 6) or aes256old (revision 5)."""
    if kind == "aes128":
        owner, ids = bytes(range(32)), b"0123456789abcdef"
        pad = (password + objects._PAD)[:32]
        key = hashlib.md5(pad + owner + struct.pack("<i", -4) + ids).digest()
        for _ in range(50):
            key = hashlib.md5(key).digest()
        user = objects._rc4(key, hashlib.md5(objects._PAD + ids).digest())
        for i in range(1, 20):
            user = objects._rc4(bytes(b ^ i for b in key), user)
        entry = b"<< /Filter /Standard /V 4 /R 4 /Length 128 /P -4 /O <%s> /U <%s> /CF << /StdCF << /CFM /AESV2 /Length 16 >> >> /StmF /StdCF /StrF /StdCF >>" % (owner.hex().encode(), (user + bytes(16)).hex().encode())
        own = hashlib.md5(key + struct.pack("<I", 4)[:3] + b"\0\0sAlT").digest()
    else:
        key = own = hashlib.sha256(b"file key").digest()
        digest = aes.hardened if kind == "aes256" else lambda word, salt: hashlib.sha256(word + salt).digest()
        user = digest(password, b"check123") + b"check123unlock45"
        entry = b"<< /Filter /Standard /V 5 /R %d /Length 256 /P -4 /O <00> /OE <00> /U <%s> /UE <%s> /CF << /StdCF << /CFM /AESV3 /Length 32 >> >> /StmF /StdCF /StrF /StdCF >>" % (
            6 if kind == "aes256" else 5, user.hex().encode(), aes.Aes(digest(password, b"unlock45")).encrypt(key, bytes(16)).hex().encode())
    return page(_aes(own, content), more={9: entry}, trailer=b"/Encrypt 9 0 R /ID [<%s> <%s>]" % ((b"0123456789abcdef".hex().encode(),) * 2))


LOCKED = {k: locked(k, line(SECRET) + b"0 g 70 694 360 22 re f") for k in ("aes128", "aes256", "aes256old")}
ROTATED = page(line(SECRET) + b"0 g 70 694 360 22 re f", attrs=b"/Rotate 90")
CORRUPT = {"no_header": b"this is no pdf", "cut": FILES["clean"][:60], "needs_password": locked("aes128", line(SECRET), b"sesame"), "needs_long_password": locked("aes256", line(SECRET), b"sesame")}
