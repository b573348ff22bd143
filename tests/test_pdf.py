import zlib

import pytest
from pdf_writer import COURIER, assemble, encrypted, lines_content, object_stream_file, pages, stream

from spanforge.functions.encodings import macexpert, macroman, named_encoding, pdf_text, pdfdoc, winansi
from spanforge.plans import roundtrip
from spanforge.sources import filters, pdf
from spanforge.sources.fonts import Options, width_matches
from spanforge.sources.interpreter import Interpreter
from spanforge.sources.pdf_objects import Document, PdfError


def glyphs(data, password=None, **options):
    d = Document(data, password)
    it = Interpreter(d, Options(**options))
    for i, p in enumerate(d.pages(), 1):
        it.page(i, p)
    return it.out


def text(data, password=None, **options):
    return "".join(glyphs(data, password, **options).text)


text_in = text


def one(content, fonts=None, **kw):
    return assemble(pages([content], fonts, **kw))


def show(s, font="F1"):
    return b"BT /%s 10 Tf 72 700 Td %s Tj ET" % (font.encode(), s)


def test_places_and_sizes():
    g = glyphs(one(show(b"(ab)")))
    assert [float(v) for v in g.x[0]] == [72.0, 78.0] and float(g.y[0][0]) == 92.0 and float(g.tfs[0][0]) == 10.0 and g.font == ["Courier"] * 2


def test_flate_objstm_and_rebuild():
    c = lines_content(["Grüße", "zwei"])
    assert text(assemble(pages([c], flate=True))) == "Grüßezwei"
    assert text(object_stream_file(c)) == "Grüßezwei"
    broken = assemble(pages([c])).replace(b"startxref", b"startxxxx")
    assert text(broken) == "Grüßezwei"


def test_lzw_ascii85_hex_runlength():
    assert filters.asciihex(b"48 65 6C6c 6F>") == b"Hello" and filters.ascii85(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert filters.runlength(bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128])) == b"abcxxx"
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    raw = b"".join(bytes([t]) + bytes(5) for t in range(5))
    assert len(filters.unpredict(raw, {"Predictor": 15, "Columns": 5})) == 25
    assert filters.flate(zlib.compress(b"x" * 5000)[:-6]).startswith(b"xxxx")


def test_undecodable_filter_falls_back_to_raw_bytes():
    objects = pages([b""])
    objects[200] = stream(show(b"(raw)"), b"/Filter/FlateDecode")
    assert text(assemble(objects)) == "raw"


@pytest.mark.parametrize("ops,want", [
    (b"BT /F1 10 Tf 72 700 Td [(a) -1000 (b)] TJ ET", [72.0, 88.0]),
    (b"BT /F1 10 Tf 2 Tc 72 700 Td (ab) Tj ET", [72.0, 80.0]),
    (b"BT /F1 10 Tf 5 Tw 72 700 Td ( a) Tj ET", [72.0, 83.0]),
    (b"BT /F1 10 Tf 50 Tz 72 700 Td (ab) Tj ET", [72.0, 75.0]),
    (b"q 2 0 0 2 10 10 cm BT /F1 10 Tf 1 0 0 1 30 30 Tm (ab) Tj ET Q", [70.0, 82.0]),
    (b"BT /F1 10 Tf 14 TL 72 700 Td (a) Tj T* (b) Tj ET", [72.0, 72.0]),
    (b"BT /F1 10 Tf 72 700 Td 10 -14 TD (a) Tj T* (b) Tj ET", [82.0, 82.0]),
    (b"0.5 w 0 0 m 10 10 l S /Span BMC EMC BT /F1 10 Tf 72 700 Td (a) Tj ET BI /W 1 ID xx EI BT (b) Tj ET", [72.0, 0.0]),
])
def test_operators(ops, want):
    g = glyphs(one(ops))
    assert [float(v) for part in g.x for v in part] == want


def test_rise_rotation_and_origin():
    g = glyphs(one(b"BT /F1 10 Tf 4 Ts 72 700 Td (a) Tj ET"))
    assert float(g.y[0][0]) == 88.0
    g = glyphs(one(b"BT /F1 10 Tf 0 1 -1 0 72 700 Tm (a) Tj ET"))
    assert g.tfs[0][0] != g.tfs[0][0]
    g = glyphs(one(b"BT /F1 10 Tf -1 0 0 -1 72 700 Tm (ab) Tj ET"))
    assert float(g.tfs[0][0]) == 10.0 and float(g.x[0][1]) == 66.0
    g = glyphs(one(show(b"(a)"), page=b"/MediaBox[10 50 612 850]"))
    assert float(g.y[0][0]) == 100.0 and float(g.x[0][0]) == 72.0


def test_quote_operators_lose_their_text_unless_asked():
    ops = b"BT /F1 10 Tf 12 TL 72 700 Td (a) Tj (b) ' 1 2 (c) \" ET"
    assert text(one(ops)) == "a" and text(one(ops), quote_ops=True) == "abc"


def test_invisible_text_is_kept_and_bad_streams_are_skipped():
    assert text(one(b"BT 3 Tr /F1 10 Tf 72 700 Td (x) Tj ET")) == "x"
    g = glyphs(assemble(pages([b"BT (unclosed Tj ET", show(b"(ok)")])))
    assert "".join(g.text) == "ok" and g.skipped[0][0] == 1


def test_forms_images_and_depth():
    form = stream(b"BT /F1 10 Tf 5 5 Td (in) Tj ET", b"/Type/XObject/Subtype/Form/Matrix[2 0 0 2 9 9]")
    image = stream(b"\x00\x01", b"/Type/XObject/Subtype/Image")
    g = glyphs(one(b"2 0 0 2 0 0 cm /X Do /I Do", extra={50: form, 51: image}, resources=b"/XObject<</X 50 0 R/I 51 0 R>>"))
    assert "".join(g.text) == "in" and float(g.x[0][0]) == 5.0  # neither the matrix nor the caller's state holds
    loop = stream(b"/X Do", b"/Type/XObject/Subtype/Form")
    with pytest.raises(PdfError, match="deep"):
        text(one(b"/X Do", extra={50: loop}, resources=b"/XObject<</X 50 0 R>>"))


def test_encodings_by_name_and_difference():
    font = lambda enc: {"F1": b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding%s>>" % enc}
    assert text(one(show(b"<80>"), font(b"/WinAnsiEncoding"))) == "€" and text(one(show(b"<8A>"), font(b"/MacRomanEncoding"))) == "ä"
    assert text(one(show(b"<57>"), font(b"/MacExpertEncoding"))) == "ﬁ"
    diff = b"<</Type/Encoding/BaseEncoding/WinAnsiEncoding/Differences[65/alpha/C118/unknownname 90/afii10017]>>"
    assert text(one(show(b"(ABCZ)"), font(diff))) == "αvCА"
    assert text(one(show(b"<80>"), font(b"<</Differences[1/a]>>"))) == "•"
    with pytest.raises(ValueError):
        text(one(show(b"(a)"), font(b"/StandardEncoding")))


def test_encoding_tables():
    assert sum(1 for c in winansi() if c) == 224 and sum(1 for c in macroman() if c) == 223 and sum(1 for c in macexpert() if c) == 165
    assert winansi()[127] == winansi()[129] == 0x2022 and winansi()[160] == 32 and winansi()[173] == 45 and winansi()[181] == 0xB5
    assert pdfdoc()[0x18] == 0x2D8 and pdfdoc()[0xA0] == 0x20AC and pdfdoc()[0x9F] == 0
    assert pdf_text(b"\xfe\xff\x20\xac") == "€" and pdf_text(b"\xfe\xff") == "þÿ" and named_encoding("WinAnsiEncoding")[65] == 65


CMAP = b"/CIDInit begincmap 1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfchar <41> <0042> <43> <D800> endbfchar 2 beginbfrange <44> <45> <0061> <46> <47> [<00660069> <0078>] endbfrange endcmap"


def test_to_unicode_comes_first():
    font = {"F1": b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding<</Differences[65/Z/Y]>>/ToUnicode 50 0 R>>"}
    assert text(one(show(b"(ABCDEFG)"), font, extra={50: stream(CMAP)})) == "BYCabfix"


def test_core_fonts_and_missing_widths():
    f = lambda n, more=b"": {"F1": b"<</Type/Font/Subtype/Type1/BaseFont/%s%s>>" % (n, more)}
    w = lambda data: [float(v) for v in glyphs(data).width[0]]
    near = lambda a, b: all(abs(x - y) < 1e-6 for x, y in zip(a, b)) and len(a) == len(b)
    assert near(w(one(show(b"(iW)"), f(b"Helvetica"))), [0.222, 0.944])
    assert near(w(one(show(b"<E9>"), f(b"Times-Roman", b"/Encoding/WinAnsiEncoding"))), [0.444])
    assert near(w(one(show(b"(iW)"), f(b"ABCDEF+Helvetica"))), [0.0, 0.0])
    assert near(w(one(show(b"(i)"), f(b"Other", b"/MissingWidth 250"))), [0.25])
    assert near(w(one(show(b"(AB)"), f(b"Other", b"/FirstChar 65/LastChar 66/Widths[500 700]"))), [0.5, 0.7])
    assert text(one(show(b"(ab)"), f(b"Symbol"))) == "αβ" and text(one(show(b"(!)"), f(b"ZapfDingbats"))) == "✁" and text(one(show(b"(')"), f(b"Helvetica"))) == "’"
    with pytest.raises(PdfError):
        text(one(show(b"(A)"), f(b"Other", b"/FirstChar 65/LastChar 67/Widths[500 700]")))


def test_true_type_and_type1_file_defaults():
    assert text(one(show(b"<80>"), {"F1": b"<</Type/Font/Subtype/TrueType/BaseFont/X>>"})) == "€"
    file = stream(b"%!PS /Encoding 256 array dup 65 /alpha put dup 8#102 /beta put readonly def currentfile eexec")
    f = {"F1": b"<</Type/Font/Subtype/Type1/BaseFont/X/FontDescriptor<</FontFile 50 0 R>>>>"}
    assert text(one(show(b"(AB)"), f, extra={50: file})) == "αβ"


def test_type3():
    f = lambda n: {"F1": b"<</Type/Font/Subtype/Type3%s/Encoding<</Differences[97/A]>>/FirstChar 97/LastChar 97/Widths[600]/FontMatrix[1 0 0 1 0 0]>>" % n}
    g = glyphs(one(show(b"(a)"), f(b"/Name/T3")))
    assert g.text == ["A"] and g.font == ["T3"] and abs(float(g.width[0][0]) - 0.6) < 1e-6
    assert glyphs(one(show(b"(a)"), f(b""))).font == ["Unknown-Type3"]
    with pytest.raises(PdfError, match="missing width"):
        text(one(show(b"(b)"), f(b"")))


def cid_font(more=b"", encoding=b"/Identity-H", top=b""):
    return {"F1": b"<</Type/Font/Subtype/Type0/BaseFont/C/Encoding%s%s/DescendantFonts[<</Type/Font/Subtype/CIDFontType2/BaseFont/C/FontDescriptor<<%s>>%s>>]>>" % (encoding, top, b"/FontFile2 60 0 R" if b"GID" in more else b"", more)}


def test_composite_fonts():
    cm = stream(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <0003> <0041> endbfrange")
    g = glyphs(one(show(b"<000100020009>"), cid_font(b"/DW 500/W[1[250 300] 5 9 700]", top=b"/ToUnicode 50 0 R"), extra={50: cm}))
    assert g.text == ["A", "B", ""] and [round(float(v), 3) for v in g.width[0]] == [0.25, 0.3, 0.5]
    own = stream(b"1 begincodespacerange <00> <7F> endcodespacerange 1 begincidrange <20> <7E> 1 endcidrange")
    g = glyphs(one(show(b"<41>"), cid_font(encoding=b" 51 0 R"), extra={51: own}))
    assert [int(v) for v in g.code[0]] == [0x42]  # the start of the range isn't subtracted
    with pytest.raises(PdfError, match="unsupported encoding"):
        text(one(show(b"<0001>"), cid_font(encoding=b"/UniGB-UCS2-H")))


def true_type(chars):
    """A font file with one Windows cmap of format 4 and nothing else of use."""
    import struct

    segs = [(c, c, (g - c) % 65536) for c, g in sorted(chars.items())] + [(0xFFFF, 0xFFFF, 1)]
    n = len(segs)
    sub = struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + b"".join(struct.pack(">H", s[1]) for s in segs) + b"\0\0" + b"".join(struct.pack(">H", s[0]) for s in segs) + b"".join(struct.pack(">H", s[2]) for s in segs) + b"\0\0" * n
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub
    return b"\0\1\0\0" + struct.pack(">HHHH", 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap


def test_embedded_font_gives_text_through_its_glyphs():
    gid = stream(b"\0\0\0\x07\0\x08")
    g = glyphs(one(show(b"<00010002>"), cid_font(b"/CIDToGIDMap 61 0 R"), extra={60: stream(true_type({0x41: 7, 0x3B1: 8})), 61: gid}))
    assert g.text == ["A", "α"]


def test_width_matching_prefers_near_then_wider_then_plain_signs():
    by = {500: ["q", "7"], 510: ["w"], 490: ["v"], 100: ["x"]}
    assert width_matches({1: 500.0, 2: 505.0, 3: 300.0, 4: 101.0}, by) == {1: "7", 2: "w", 4: "x"}


def test_encryption(spark):
    c = lines_content(["secret text"])
    assert text(encrypted(c, b"")) == "secret text" and text(encrypted(c, b"pw"), "pw") == "secret text" and text(encrypted(c, b"pw"), "owner") == "secret text"
    with pytest.raises(ValueError, match="password"):
        text(encrypted(c, b"pw"), "no")

    def aes(key, data):
        row = spark.createDataFrame([(bytearray(data), bytearray(key))], "d binary, k binary").selectExpr("aes_encrypt(d, k, 'CBC', 'PKCS') AS e").first()
        return bytes(row.e)

    assert text(encrypted(c, b"pw", aes), "pw") == "secret text"


def test_aes_256_blocks():
    from spanforge.sources.crypt import Aes

    key, block = bytes(range(32)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert Aes(key).encrypt(block).hex() == "8ea2b7ca516745bfeafc49904b496089" and Aes(key).decrypt(Aes(key).encrypt(block)) == block


@pytest.mark.parametrize("data,kind", [(b"", "IoError"), (b"hello", "PdfError"), (b"%PDF-1.4\n1 0 obj<<>>endobj", "PdfError")])
def test_broken_files(data, kind):
    with pytest.raises(PdfError) as e:
        Document(data)
    assert e.value.kind == kind


def test_courier_needs_its_name():
    assert COURIER in assemble(pages([b""]))


def full_font(chars, advances):
    """A font file with cmap, head, maxp, hhea and hmtx; 1,000 units to the em."""
    import struct

    whole = true_type(chars)
    cmap = whole[28:]
    head = bytes(18) + struct.pack(">H", 1000) + bytes(34)
    tables = {b"cmap": cmap, b"head": head, b"maxp": struct.pack(">IH", 0x10000, len(advances)), b"hhea": bytes(34) + struct.pack(">H", len(advances)), b"hmtx": b"".join(struct.pack(">Hh", a, 0) for a in advances)}
    out, body, at = b"\0\1\0\0" + struct.pack(">HHHH", len(tables), 0, 0, 0), b"", 12 + 16 * len(tables)
    for tag, data in tables.items():
        out += tag + struct.pack(">III", 0, at + len(body), len(data))
        body += data
    return out + body


def test_fonts_of_the_folders_given_stand_in_by_width(tmp_path):
    (tmp_path / "C-Regular.ttf").write_bytes(full_font({0x41: 1, 0x37: 2, 0x71: 3}, [0, 700, 500, 500]))
    data = one(show(b"<000100020003>"), cid_font(b"/W[1[700 505 300]]"))
    assert glyphs(data).text == ["", "", ""]
    assert glyphs(data, font_folders=(str(tmp_path),)).text == ["A", "7", ""]


def test_font_rows_and_embedded_files(spark):
    from spanforge.sources import pdf

    file = full_font({0x41: 1, 0x3B1: 2}, [0, 600, 250])
    font = cid_font(b"/CIDSystemInfo<</Registry(Adobe)/Ordering(Identity)/Supplement 0>>/CIDToGIDMap/Identity/W[1[600]]/DW 900")
    font["F1"] = font["F1"].replace(b"/FontDescriptor<<>>", b"/FontDescriptor<</FontFile2 60 0 R>>")
    cm = stream(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0041> endbfchar")
    font["F1"] = font["F1"].replace(b"/BaseFont/C/Encoding", b"/ToUnicode 50 0 R/BaseFont/C/Encoding", 1)
    data = one(show(b"<0001>"), font | {"F2": b"<</Type/Font/Subtype/Type3/Encoding/StandardEncoding>>"}, extra={60: stream(file), 50: cm})
    f = spark.createDataFrame([("d", bytearray(data))], "doc string, content binary")
    rows = {r.font_id: r for r in pdf.fonts(f).collect()}
    r = rows["F1"]
    assert (r.subtype, r.encoding, r.widths, r.default_width, r.cid_registry, r.cid_ordering, r.embedded, r.to_unicode) == ("Type0", "Identity-H", {1: 600.0}, 900.0, "Adobe", "Identity", "FontFile2", {1: "A"})
    assert rows["F2"].error and [tuple(x) for x in pdf.cmaps(pdf.fonts(f)).collect()] == [("d", "F1", 1, "A")]
    e = pdf.embedded_fonts(f)
    assert bytes(e.first().data) == file and e.first().size == len(file)
    got = {(g.glyph, g.code_point, g.advance) for g in pdf.font_glyphs(e).collect()}
    assert got == {(0, None, 0.0), (1, 0x41, 600.0), (2, 0x3B1, 250.0)}


def test_names_by_rule_and_the_standard_order():
    from spanforge.functions.core_metrics import CORE_FONTS, core_font
    from spanforge.functions.glyph_names import glyph_names, standard_order

    names = glyph_names()
    want = {
        "Icyrillic": 0x406, "Iicyrillic": 0x418, "Ereversedcyrillic": 0x42D, "Chedescenderabkhasiancyrillic": 0x4BE, "Yuslittleiotifiedcyrillic": 0x468, "Tcommaaccent": 0x162, "tcommaaccent": 0x163, "palochkacyrillic": 0x4C0,
        "alefhamzaabovearabic": 0x623, "ainmedialarabic": 0xFECC, "lamalefmaddaabovefinalarabic": 0xFEF6, "finalkafdagesh": 0xFB3A, "shinshindothebrew": 0xFB2A, "hatafpatahwidehebrew": 0x5B2, "kokaithai": 0xE01, "kiyeoksioskorean": 0x3133,
        "twentycircle": 0x2473, "aparen": 0x249C, "Twelveroman": 0x216B, "asciitildemonospace": 0xFF5E, "aamatragurmukhi": 0xA3E, "rvocalicvowelsigndeva": 0x943, "hookcmb": 0x309, "wbsquare": 0x33DD, "kmsquaredsquare": 0x33A2, "controlUS": 0x1F,
    }
    assert {n: names.get(n) for n in want} == want
    order = standard_order()
    assert len(order) == 258 and order[36] == "A" and order[98] == "Adieresis" and order[225] == "caron" and order[257] == "dcroat" and set(order[3:]) - {"nonbreakingspace"} <= set(names)
    for f in CORE_FONTS:
        glyphs = [g for _, _, g in core_font(f)]
        assert len(glyphs) == len(set(glyphs)) == {"Symbol": 190, "ZapfDingbats": 202}.get(f, 315)
    width = lambda f: {g: w for _, w, g in core_font(f)}
    assert width("Times-BoldItalic")["fi"] == 556 and width("Times-Italic")["Lcaron"] == 611 and "Acaron" not in width("Helvetica")


@pytest.mark.parametrize("feature", roundtrip.FEATURES)
def test_every_way_of_writing_reads_the_same(feature):
    for variant in range(10):
        for text in ("abc def", "Жук und 文字", "a\U0001f600b"):
            assert text_in(roundtrip.write_pdf([(0, text), (3, "x"), (60, text)], variant, feature)) == text + "x" + text


def test_unreadable_font_file_is_a_row(spark):
    df = spark.createDataFrame([("d", "F1", bytearray(b"nonsense"))], "doc string, font_id string, data binary")
    (row,) = pdf.font_glyphs(df).collect()
    assert row.glyph is None and row.error
