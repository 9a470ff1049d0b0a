"""The package pipeline end to end on packages made here."""

import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docframe.operators import pipeline
from docframe.sources import docx, registry

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def paragraph(text, props="", run=""):
    return f"<w:p>{props}<w:r>{run}<w:t>{text}</w:t></w:r></w:p>"


DOCUMENT = (
    f"<w:document {W}><w:body>"
    + paragraph("SECTION 09 13 29")
    + paragraph("GYPSUM BOARD")
    + paragraph("PART 1 GENERAL", "<w:pPr/>")
    + paragraph("1.02 Work &amp; terms", '<w:pPr><w:jc w:val="left"/></w:pPr>', '<w:rPr><w:rFonts w:ascii="X"/><w:b/></w:rPr>')
    + paragraph("A. Provide boards.", "", '<w:rPr><w:sz w:val="20"/></w:rPr>')
    + "<w:tbl>" + paragraph("B. In a table.") + "</w:tbl>"
    + paragraph("A free sentence that no rule takes, long enough for the offline classifier to call it so.")
    + paragraph("Page 3 of 9")
    + "<w:p><w:pPr><w:sectPr><w:pgSz w:w=\"1\"/></w:sectPr></w:pPr></w:p>"
    + '<w:sectPr><w:headerReference w:type="default" r:id="rId9"/><w:pgSz w:w="5"/><w:titlePg/></w:sectPr></w:body></w:document>'
)
STYLES = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="Body"><w:name w:val="old"/></w:style></w:styles>'
NUMBERING = f'<w:numbering {W}><w:abstractNum w:abstractNumId="4"><w:nsid w:val="AAAAAAAA"/></w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="4"/></w:num></w:numbering>'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId9" Type="http://x/relationships/header" Target="header1.xml"/><Relationship Id="rId3" Type="http://x/styles" Target="styles.xml"/></Relationships>'
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/word/header1.xml" ContentType="h"/></Types>'


def package(**changes):
    parts = {"[Content_Types].xml": TYPES, "word/document.xml": DOCUMENT, "word/styles.xml": STYLES, "word/numbering.xml": NUMBERING, "word/_rels/document.xml.rels": RELS, "word/header1.xml": f"<w:hdr {W}/>"}
    parts.update(changes)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.comment = b"kept"
        for name, xml in parts.items():
            if xml is not None:
                archive.writestr(name, xml, compress_type=zipfile.ZIP_STORED if name.endswith("styles.xml") else zipfile.ZIP_DEFLATED)
    return out.getvalue()


ROLES = {r: {"style_id": s} for r, s in [("SectionID", "Sec"), ("SectionTitle", "Sec"), ("PART", "Part"), ("ARTICLE", "Art"), ("PARAGRAPH", "Body"), ("SUBPARAGRAPH", "Body")]}
SECTION = f'<w:sectPr {W}><w:pgSz w:w="99"/><w:pgMar w:top="7"/><w:titlePg/></w:sectPr>'


def style(style_id, **more):
    return {"style_id": style_id, "type": "paragraph", "name": style_id, **more}


TEMPLATE = {
    "version": "1",
    "doc_defaults": {"default_run_props": {"rPr": '<w:rPr><w:lang w:val="en"/></w:rPr>'}, "default_paragraph_props": {}},
    "styles": {"style_defs": [
        style("Base", rPr='<w:rPr><w:sz w:val="22"/></w:rPr>', pPr='<w:pPr><w:spacing w:after="5"/></w:pPr>'),
        style("Sec", based_on="Base"), style("Part", based_on="Normal"), style("Body", based_on="Base", next="Body"),
        style("Art", pPr='<w:pPr><w:numPr><w:numId w:val="8"/></w:numPr></w:pPr>'),
    ]},
    "numbering": {"abstract_nums": [{"abstractNumId": 3, "xml": '<w:abstractNum w:abstractNumId="3"><w:nsid w:val="00000000"/></w:abstractNum>'}], "nums": [{"numId": 8, "abstractNumId": 3, "xml": '<w:num w:numId="8"><w:abstractNumId w:val="3"/></w:num>'}]},
    "theme": {"theme1_xml": '<a:theme xmlns:a="a"></a:theme>'},
    "fonts": {"font_table_xml": f'<w:fonts {W}><w:font w:name="F"></w:font></w:fonts>'},
    "settings": {"compat": {"compat_xml": "<w:compat></w:compat>"}},
    "page_layout": {"default_section": {"sectPr": SECTION, "header_refs": {"default": "rIdA"}}, "section_chain": []},
    "headers_footers": {
        "headers": [{"part_name": "word/header7.xml", "xml": f"<w:hdr {W}/>", "rId": "rIdA", "rels_xml": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="i" Target="./media/logo.png"/></Relationships>', "media": [{"path": "word/media/logo.png", "content_base64": base64.b64encode(b"img").decode()}]}],
        "footers": [{"part_name": "word/footer7.xml", "part_xml": f"<w:ftr {W}><w:p><w:r><w:t>Con</w:t></w:r><w:r><w:t>crete - 03 30 00</w:t></w:r></w:p></w:ftr>"}],
    },
}


@pytest.fixture
def contracts(tmp_path):
    folder = tmp_path / "contracts"
    folder.mkdir()
    tokens = {"SectionID": "SECTION 03 30 00", "SectionTitle": "CONCRETE"}
    (folder / registry.STYLE_FILE).write_text(json.dumps({"version": 1, "roles": {**ROLES, "END_OF_SECTION": {"styleId": " "}}, "source_tokens": tokens}))
    (folder / registry.TEMPLATE_FILE).write_text(json.dumps(TEMPLATE))
    return folder


def test_batch(spark, tmp_path, contracts):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "good.docx").write_bytes(package())
    (source / "broken.docx").write_bytes(b"no archive")
    (source / "nonum.docx").write_bytes(package(**{"word/numbering.xml": None}))
    (source / "other.txt").write_bytes(b"")
    (source / "empty.docx").write_bytes(b"")
    (source / "odd.docx").write_bytes(package(**{"word/theme/theme1.xml": "<a/>", "word/footer1x.xml": "<ns0:ftr xmlns:ns0='n'/>"}))
    stages = {}
    results = {r.file_key.split("__")[0]: r for r in pipeline.run_batch(spark, str(source), str(contracts), str(out), progress=stages.__setitem__).collect()}
    assert set(results) == {"good", "broken", "nonum", "empty", "odd"}
    assert list(stages) == ["read", "classify", "apply", "write"] and stages["read"]["unreadable"] == 2 and stages["apply"]["packages"] == 5 and stages["write"]["packages"] == 1
    assert not results["empty"].success and results["empty"].source.endswith("empty.docx") and results["good"].duration_seconds > 0
    assert not results["odd"].success and "footer1x.xml: must not be patched" in results["odd"].error and results["odd"].path is None
    assert results["good"].success, results["good"].error
    assert not results["broken"].success and not results["nonum"].success and "numbering" in results["nonum"].error
    (path,) = out.glob("*.docx")
    with zipfile.ZipFile(path) as archive:
        assert archive.comment == b"kept"
        names = archive.namelist()
        parts = {n: archive.read(n) for n in names}
        assert archive.getinfo("word/styles.xml").compress_type == zipfile.ZIP_STORED
    assert names[:2] == ["[Content_Types].xml", "word/document.xml"]
    assert "word/header1.xml" not in parts and "word/header7.xml" in parts
    xml = parts["word/document.xml"].decode()
    assert [m for m in ("Sec", "Part", "Art", "Body") if f'w:pStyle w:val="{m}"' in xml] == ["Sec", "Part", "Art", "Body"]
    assert xml.count("<w:pStyle") == 6  # the table row, the page number and the section break keep theirs
    assert "w:rFonts" not in xml and "<w:b/>" in xml and 'w:jc w:val="left"' not in xml
    assert '<w:pgSz w:w="99"/>' in xml and xml.count('w:w="1"') == 0
    rels = parts["word/_rels/document.xml.rels"].decode()
    assert 'Id="rId5" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/header" Target="header7.xml"' in rels or "header7.xml" in rels
    assert 'Target="header1.xml"' not in rels
    assert "theme/theme1.xml" in rels and "/word/theme/theme1.xml" in parts["[Content_Types].xml"].decode()
    styles = parts["word/styles.xml"].decode()
    assert styles.count('w:styleId="Body"') == 1 and 'w:name w:val="old"' not in styles
    assert '<w:numId w:val="3"/>' in styles and 'w:numId="3"' in parts["word/numbering.xml"].decode() and 'w:abstractNumId="5"' in parts["word/numbering.xml"].decode()
    footer = parts["word/footer7.xml"].decode()
    assert "Gypsum Board - 09 13 29" in footer.replace("</w:t></w:r><w:r><w:t>", "")
    assert any(n.startswith("word/media/hf_header7_01_") and n.endswith(".png") for n in names)
    assert "media/hf_header7_01_" in parts["word/_rels/header7.xml.rels"].decode()
    after = spark.createDataFrame([("k", xml)], "file_key string, xml string")
    before = spark.createDataFrame([("k", DOCUMENT)], "file_key string, xml string")
    rows = spark.createDataFrame([("k", n, bytearray(c)) for n, c in parts.items()], "file_key string, part_name string, content binary")
    assert pipeline.output_violations(before, after, rows, ["word/header7.xml", "word/footer7.xml"]).collect() == []
    assert pipeline.contract_changes(before, after).where("change <> 'changed' or before not like '%sectPr%'").collect() == []


def test_strict_batch_writes_nothing(spark, tmp_path, contracts):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "good.docx").write_bytes(package())
    (source / "broken.docx").write_bytes(b"x")
    with pytest.raises(ValueError, match="packages failed"):
        pipeline.run_batch(spark, str(source), str(contracts), str(out), strict=True)
    assert not out.exists()


def test_analysis(spark):
    docs = spark.createDataFrame([("k", DOCUMENT), ("none", None), ("empty", "")], "file_key string, xml string")
    got = pipeline.analyse(docs)
    rows = {r.paragraph_index: r for r in got.enriched.collect()}
    assert [(i, rows[i].csi_role) for i in sorted(rows)] == [(0, "SectionID"), (1, "SectionTitle"), (2, "PART"), (3, "ARTICLE"), (4, "PARAGRAPH"), (5, None), (6, None)]
    assert rows[3].text == "1.02 Work & terms" and rows[3].rpr_hints.bold is True and rows[3].ppr_hints.jc == "left"
    assert rows[5].in_table and not rows[4].in_table
    assert rows[0].prev_text == "" and rows[1].prev_text == "SECTION 09 13 29" and rows[6].next_text == ""
    assert [(r.paragraph_index, r.action, r.tags) for r in got.filter_report.collect()] == [(7, "removed", ["page_number"])]
    assert [r.paragraph_index for r in got.unresolved.collect()] == [6]


def test_end_of_section_needs_its_role(spark):
    docs = spark.createDataFrame([("k", paragraph("END OF SECTION") + paragraph("x"))], "file_key string, xml string")
    assert [r.tags for r in pipeline.analyse(docs).filter_report.collect()] == [["end_of_section_no_role"]]
    assert [r.csi_role for r in pipeline.analyse(docs, ["END_OF_SECTION"]).deterministic.collect()] == ["END_OF_SECTION"]


def test_violations_are_all_named(spark, tmp_path, contracts):
    bad = json.loads(json.dumps(TEMPLATE))
    bad["styles"]["style_defs"] += [style("Base"), style(" "), style("Frag", pPr="<w:rPr>")]
    bad["numbering"]["nums"][0]["abstractNumId"] = 77
    bad["page_layout"]["default_section"]["sectPr"] = " "
    (contracts / registry.TEMPLATE_FILE).write_text(json.dumps(bad))
    roles, template = registry.role_styles(spark, str(contracts)), registry.template(spark, str(contracts))
    rules = {r.rule for r in registry.violations(template, roles).collect()}
    assert rules == {"duplicate_style", "style_without_id", "bad_pPr", "num_abstract_unknown", "no_default_section"}
    with pytest.raises(ValueError, match="not sound"):
        pipeline.load_config(spark, str(contracts))


def test_registry_aliases(spark, contracts):
    assert registry.available_roles(spark, str(contracts)) == sorted([*ROLES, "END_OF_SECTION"])
    assert "END_OF_SECTION" not in {r.role for r in registry.role_styles(spark, str(contracts)).collect()}
    entries = registry.header_footer_entries(registry.template(spark, str(contracts)))
    assert [(r.kind, r.part_name, r.rid) for r in entries.collect()] == [("header", "word/header7.xml", "rIdA"), ("footer", "word/footer7.xml", None)]
    assert [(r.item, r.filename, bytes(r.content)) for r in registry.media_items(entries).collect()] == [(1, "logo.png", b"img")]
    with pytest.raises(FileNotFoundError):
        registry.contract_root(str(contracts.parent))


def test_patch_packages(spark, tmp_path):
    files = spark.createDataFrame([("k", "p", bytearray(package()))], "file_key string, path string, content binary")
    base = docx.expand(files)
    new = lambda rows: spark.createDataFrame(rows, "file_key string, part_name string, content binary")
    none = new([]).select("file_key", "part_name")
    patched = docx.patch_packages(base, new([("k", "word/styles.xml", bytearray(b"<a/>")), ("k", "word/media/x.bin", bytearray(b"\0"))]), new([("k", "word/header1.xml", None)]))
    content = docx.build_packages(patched).first().content
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
        assert archive.namelist() == ["[Content_Types].xml", "word/document.xml", "word/styles.xml", "word/numbering.xml", "word/_rels/document.xml.rels", "word/media/x.bin"]
        assert archive.read("word/styles.xml") == b"<a/>" and archive.comment == b"kept"
    with pytest.raises(ValueError, match="docProps/app.xml"):
        docx.patch_packages(base, new([("k", "docProps/app.xml", bytearray(b"<a/>"))]), none)
    with pytest.raises(ValueError, match="XML parse error"):
        docx.patch_packages(base, new([("k", "word/styles.xml", bytearray(b"<a>"))]), none)
    assert docx.part_text(base, "word/styles.xml").select(F.length("xml")).first()[0] == len(STYLES)


def test_only_contract_breaches_fail(spark):
    frame = lambda rows: spark.createDataFrame([("k", "word/document.xml", bytearray(x.encode())) for x in rows], "file_key string, part_name string, content binary")
    before = DOCUMENT
    allowed = before.replace("<w:pPr/>", '<w:pPr><w:pStyle w:val="P"/></w:pPr>')
    assert pipeline.contract_violations(frame([before]), frame([allowed])).collect() == []
    assert pipeline.contract_violations(frame([before]), frame([])).collect() == []
    (row,) = pipeline.contract_violations(frame([before]), frame([allowed.replace("GYPSUM", "PLASTER")])).collect()
    assert row.error.startswith("paragraph 1 changed") and "+" in row.error and "PLASTER" in row.error


def test_namespace_errors(spark):
    rows = [("a", "word/document.xml", b"<ns0:p xmlns:ns0='x'/>"), ("b", "word/document.xml", b"<w:p xmlns:w='x'>ns0:</w:p>"), ("c", "word/media/a.png", b"<ns0:p"), ("d", None, b"<ns0:p"), ("e", "word/document.xml", None)]
    frame = spark.createDataFrame([(k, n, None if c is None else bytearray(c)) for k, n, c in rows], "file_key string, part_name string, content binary")
    assert [r.file_key for r in docx.namespace_errors(frame).collect()] == ["a"]
