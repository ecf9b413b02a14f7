"""Small Office files and images, built from their parts."""

import io
import struct
import zipfile
import zlib

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def rels(*items):
    """(id, kind, target) or (id, kind, target, "External")."""
    rows = "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"{"".join(f" TargetMode=%r" % m for m in more)}/>'.replace("'", '"') for i, k, t, *more in items)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = zlib.compress(b"".join(b"\0" + b"\xff" * width for _ in range(height)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def tiff(*sizes):
    out = b"II*\0" + struct.pack("<I", 8)
    for k, (w, h) in enumerate(sizes):
        after = len(out) + 2 + 24 + 4
        out += struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, w) + struct.pack("<HHIHH", 257, 3, 1, h, 0) + struct.pack("<I", after if k + 1 < len(sizes) else 0)
    return out


def jpeg(width, height):
    return b"\xff\xd8" + b"\xff\xe0\0\x04ab" + b"\xff\xc0\0\x0b\x08" + struct.pack(">HH", height, width) + b"\x01\x01\x11\0" + b"\xff\xd9"


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:v="urn:schemas-microsoft-com:vml"'


def docx(image):
    p = lambda text, style="": f'<w:p><w:pPr>{f"<w:pStyle w:val=%s/>" % repr(style) if style else ""}<w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'.replace("'", '"')
    cell = lambda *texts: f"<w:tc>{''.join(map(p, texts))}</w:tc>"
    body = (
        p("Title", "T") + p("Section", "H2") + p("Plain text") + p("Point", "LB") + f"<w:sdt><w:sdtContent>{p('In a control')}</w:sdtContent></w:sdt>"
        + f'<w:tbl><w:tr>{cell("a", "b|c")}{cell("d")}</w:tr><w:tr>{cell("e")}{cell("")}</w:tr></w:tbl>'
        + f'<w:p><w:r><w:t>before</w:t><w:tab/><w:t>tab</w:t></w:r><w:r><a:blip r:embed="r1" xmlns:r="{REL}"/></w:r><w:r><w:t>after</w:t><w:br/></w:r><mc:AlternateContent><mc:Fallback><w:t>no</w:t></mc:Fallback></mc:AlternateContent></w:p>'
        + f'<w:p><a:blip r:embed="r2" xmlns:r="{REL}"/><a:blip r:embed="r9" xmlns:r="{REL}"/><a:blip r:link="r7" xmlns:r="{REL}"/><w:r><w:t>end</w:t></w:r></w:p>'
    )
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("T", "Title"), ("H2", "heading 2"), ("LB", "List Bullet")))
    return zipped({
        "_rels/.rels": rels(("r1", "officeDocument", "word/document.xml")), "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": rels(("r1", "image", "media/i.png"), ("r2", "image", "media/tiny.png"), ("s", "styles", "styles.xml"), ("r7", "image", "http://x/y.png", "External")),
        "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>", "word/media/i.png": image, "word/media/tiny.png": png(8, 8),
    })


A, P = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"


def pptx(image):
    head = f'xmlns:a="{A}" xmlns:p="{P}" xmlns:r="{REL}"'
    para = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    shape = lambda text, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type=%s/>" % repr(kind) if kind else ""}</p:nvPr></p:nvSpPr><p:txBody>{para(text)}</p:txBody></p:sp>'.replace("'", '"')
    table = f"<p:graphicFrame><a:tbl><a:tr><a:tc>{para('h1')}</a:tc><a:tc>{para('h2')}</a:tc></a:tr><a:tr><a:tc>{para('x')}</a:tc><a:tc/></a:tr></a:tbl></p:graphicFrame>"
    pic = lambda rid: f'<p:pic><p:blipFill><a:blip r:embed="{rid}"/></p:blipFill></p:pic>'
    slide = lambda inner: f"<p:sld {head}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    return zipped({
        "ppt/presentation.xml": f'<p:presentation {head}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/><p:sldId r:id="r8"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "/ppt/slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide(f"<p:grpSp>{shape('grouped')}</p:grpSp>"), "ppt/slides/slide2.xml": slide(shape("Heading", "ctrTitle") + table + pic("i1") + pic("i9") + shape("  ")),
        "ppt/slides/_rels/slide2.xml.rels": rels(("i1", "image", "../media/p.png")), "ppt/media/p.png": image,
    })


S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def xlsx(image):
    c = lambda at, v="", kind="", style="", f=None: f'<c r="{at}"{f" t=%s" % repr(kind) if kind else ""}{f" s=%s" % repr(style) if style else ""}>{"" if f is None else f"<f>{f}</f>"}{f"<v>{v}</v>" if v != "" else ""}</c>'.replace("'", '"')
    rows = (
        f'<row r="1">{c("A1", 0, "s")}{c("B1", 1, "s")}</row><row r="2">{c("A2", 3)}{c("B2", "2.50")}{c("C2", 7, f="A2*2")}{c("D2", f="A2*3")}</row>'
        f'<row r="4">{c("A4", 1, "b")}{c("B4", "45351", style="1")}{c("C4", "45351.5", style="1")}{c("D4", "#DIV/0!", "e")}{c("E4", "0.25", style="2")}</row>'
        '<row r="5"><c r="A5" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c></row>'
    )
    sheet = lambda inner, more="": f'<worksheet xmlns="{S}" xmlns:r="{REL}"><sheetData>{inner}</sheetData>{more}</worksheet>'
    anchor = f'<x:oneCellAnchor xmlns:a="{A}" xmlns:r="{REL}"><x:from><x:col>0</x:col><x:row>2</x:row></x:from><x:pic><x:blipFill><a:blip r:embed="i"/></x:blipFill></x:pic></x:oneCellAnchor>'
    return zipped({
        "_rels/.rels": rels(("r", "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{REL}"><sheets><sheet name="Sales" sheetId="1" r:id="a"/><sheet name="Empty" sheetId="2" state="hidden" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("a", "worksheet", "worksheets/sheet1.xml"), ("b", "worksheet", "worksheets/sheet2.xml"), ("s", "sharedStrings", "sharedStrings.xml"), ("t", "styles", "styles.xml")),
        "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>Item</t></si><si><r><t>Qu</t></r><r><t>antity</t></r><rPh><t>x</t></rPh></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{S}"><numFmts><numFmt numFmtId="164" formatCode="hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet(rows, '<drawing r:id="d"/>'), "xl/worksheets/sheet2.xml": sheet(""),
        "xl/worksheets/_rels/sheet1.xml.rels": rels(("d", "drawing", "../drawings/drawing1.xml")),
        "xl/drawings/drawing1.xml": f'<x:wsDr xmlns:x="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing">{anchor}</x:wsDr>',
        "xl/drawings/_rels/drawing1.xml.rels": rels(("i", "image", "../media/i.png")), "xl/media/i.png": image,
    })
