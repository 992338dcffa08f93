"""Documents of blocks, JSON, workbooks, layouts, tables, audits and recovery."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import crypto
from palimpsest.operators import audit, documents, images, newlines, recover, resolve, verify
from palimpsest.operators.specs import DEFAULTS, select
from palimpsest.sources import files, html, jsonleaves, layout, workbook
from palimpsest.streaming.sanitize import stream

KEY = bytes(range(32))


def blocks(spark, rows):
    full = [(1, i, t, x, p, lvl) for i, (t, x, p, lvl) in enumerate(rows)]
    return documents.placed(spark.createDataFrame(full, "doc_id int, ord int, type string, text string, page int, level int"))


def test_offsets_and_text(spark):
    b = blocks(spark, [("title", "标题", 1, 1), ("header", "h", 1, None), ("paragraph", "正文\U0001f600", 2, None), ("paragraph", "end", 3, None)])
    got = [(r.char_start, r.char_end) for r in b.orderBy("ord").collect()]
    assert got == [(0, 2), (-1, -1), (4, 7), (9, 12)]
    doc = documents.documents(b).first()
    assert doc.text == "标题\n\n正文\U0001f600\n\nend" and doc.pages == 3 and doc.n_blocks == 4


def test_markdown_places_masks_exactly_and_recovers(spark):
    rows = [("title", "联系 13812345678", 1, 2), ("footer", "13900001111", 1, None), ("paragraph", "*** 张三 与 13812345678 和 13912345678", 1, None), ("paragraph", " ", 2, None), ("image", "图 13812345678", 2, None)]
    b = blocks(spark, rows)
    fields = select(DEFAULTS, ["phone"])
    from palimpsest.operators.detect import rule_spans

    b = b.withColumn("spans", resolve.resolve(rule_spans(F.col("text"), fields), fields))
    parts = documents.markdown_parts(documents.masked_blocks(b, fields=fields), F.when(F.col("type") == "image", "img/a.png"))
    whole, places = documents.markdown(parts)
    text = whole.first().markdown
    assert text == "## 联系 138****5678\n\n*** 张三 与 138****5678 和 139****5678\n\n![图 138****5678](img/a.png)"
    assert all(text[p.md_start : p.md_end] == p.masked for p in places.collect())
    spans = places.select("doc_id", F.col("masked").alias("masked_value"), "md_start", "md_end", crypto.token(F.col("value"), KEY).alias("encrypted_value"))
    back = recover.markdown(whole.withColumnRenamed("markdown", "masked_text"), spans, KEY).first()
    assert back.text == text.replace("138****5678", "13812345678").replace("139****5678", "13912345678") and (back.restored, back.unresolved) == (4, 0)
    wrong = recover.markdown(whole.withColumnRenamed("markdown", "masked_text"), spans, bytes(32)).first()
    assert wrong.text == text and (wrong.restored, wrong.unresolved) == (0, 4)


def test_straddling_span_is_cut_at_block_edges(spark):
    b = blocks(spark, [("paragraph", "联系人张三", 1, None), ("paragraph", "李四王五很忙", 1, None)])
    s = spark.createDataFrame([(1, "person_name", 3, 12)], "doc_id int, field_type string, start int, end int").withColumn("value", F.lit(""))
    got = sorted((r.start, r.end, r.value) for r in documents.split_at_blocks(s, b, documents.documents(b)).collect())
    assert got == [(3, 5, "张三"), (7, 12, "李四王五很")]


def test_chunks_are_slices(spark):
    b = blocks(spark, [("title", "T" * 5, 1, 1), ("paragraph", "a" * 30, 1, None), ("table", "t" * 10, 1, None), ("paragraph", "b" * 20 + "。" + "c" * 40, 2, None), ("title", "U", 2, None), ("title", "V", 2, 3), ("header", "h", 2, None)])
    text = documents.documents(b).first().text
    got = [(r.base, r.chunk) for r in documents.chunks(b, size=40).orderBy("base").collect()]
    assert all(text[a : a + len(c)] == c for a, c in got)
    assert [c[:1] for _, c in got] == ["T", "t", "b", "c", "U"] or [c[0] for _, c in got][:3] == ["T", "t", "b"]
    assert sum(len(c) for _, c in got) >= len(text) - 2 * len(got)


def test_leaves(spark):
    raw = '[{"公司": "甲\\n乙", "n": 5.0, "big": 1e16, "t": true, "x": null, "e": ""}, {}, [1.5, {"0": "k"}]]'
    df = spark.createDataFrame([(1, raw), (2, "not json"), (3, "7"), (4, None)], "doc_id int, json string")
    rows = jsonleaves.leaves(df).withColumn("p", jsonleaves.path_text(F.col("path"))).orderBy("doc_id", "page", "leaf_no").collect()
    got = [(r.page, r.p, r.text, r.kind, r.start) for r in rows if r.doc_id == 1]
    assert got == [(1, "$[0].公司", "甲 乙", "str", 0), (1, "$[0].n", "5", "int", 4), (1, "$[0].big", "1e+16", "float", 6), (1, "$[0].t", "true", "bool", 12), (3, "$[2][0]", "1.5", "float", 0), (3, "$[2][1].0", "k", "str", 4)]
    assert [(r.p, r.text) for r in rows if r.doc_id == 3] == [("$", "7")]
    assert [r.error is not None for r in rows if r.doc_id == 2] == [True]


@pytest.mark.parametrize(
    "raw",
    [
        '{"手机号":"13812345678","x":1}',
        '{\n  "员工": [\n    {"手机号": 13812345678, "备注": "短信 13812345678 已发 13900001111", "说明": "第一行\\n电话 13812345678\\n***"},\n    {}\n  ],\n  "比例": 0.5\n}\n',
        '[["13812345678"], 13812345678, "138****5678 13812345678"]',
        "13812345678",
    ],
)
def test_json_masks_and_comes_back(spark, raw):
    df = spark.createDataFrame([(1, raw)], "doc_id int, json string")
    edits = resolve.sanitize(jsonleaves.leaves(df), fields=select(DEFAULTS, ["phone"])).filter(F.size("spans") > 0)
    red = jsonleaves.redact(df, edits)
    text = red.first().json
    assert "13812345678" not in text and "13900001111" not in text
    assert text.endswith("\n") == raw.endswith("\n")
    back = jsonleaves.recover(red, jsonleaves.edit_spans(edits, KEY), KEY).first()
    assert json.loads(back.json) == json.loads(raw) and back.unresolved == 0
    edited = red.withColumn("json", F.replace("json", F.lit("138****5678"), F.lit("???")))
    assert jsonleaves.recover(edited, jsonleaves.edit_spans(edits, KEY), KEY).first().restored == 0


def book(cells, second=None):
    """A workbook of inline and shared strings, numbers, booleans, dates and formulas."""
    def c(ref, kind, value):
        match kind:
            case "s":
                return f'<c r="{ref}" t="s"><v>{value}</v></c>'
            case "b":
                return f'<c r="{ref}" t="b"><v>{value}</v></c>'
            case "d":
                return f'<c r="{ref}" s="1"><v>{value}</v></c>'
            case "f":
                return f'<c r="{ref}"><f>{value}</f></c>'
            case "i":
                return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
        return f'<c r="{ref}"><v>{value}</v></c>'

    m, r = workbook.MAIN, workbook.RELS
    rows = {}
    for ref, kind, value in cells:
        rows.setdefault(int("".join(x for x in ref if x.isdigit())), []).append(c(ref, kind, value))
    sheet = f'<worksheet xmlns="{m}"><sheetData>' + "".join(f'<row r="{n}">{"".join(x)}</row>' for n, x in sorted(rows.items())) + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="员工 13812345678" sheetId="1" r:id="rId1"/><sheet name="x" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbook.PACKAGE}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1">{c("B1", "i", "hidden 13900001111")}</row></sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>电话 13812345678</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{m}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("docProps/core.xml", '<cp xmlns:dc="d"><dc:creator>13812345678</dc:creator></cp>')
    return out.getvalue()


def test_workbook(spark):
    data = book([("A1", "s", 0), ("B1", "s", 1), ("A2", "n", "13812345678"), ("B2", "n", "2.5"), ("C2", "b", "1"), ("D2", "d", "45000"), ("A3", "f", 'A1&amp;"13812345678"'), ("A300", "n", "1")])
    df = spark.createDataFrame([("a.xlsx", bytearray(data)), ("bad.xlsx", bytearray(b"no zip"))], "path string, content binary")
    cells = workbook.cells(df)
    good = cells.filter("error is null")
    got = [(r.sheet_idx, r.row, r.col, r.text, r.kind) for r in good.orderBy("sheet_idx", "row", "col").collect()]
    assert got == [(0, 1, 1, "电话 13812345678", "str"), (0, 1, 2, "ab", "str"), (0, 2, 1, "13812345678", "int"), (0, 2, 2, "2.5", "float"), (0, 2, 3, "TRUE", "bool"), (0, 2, 4, "2023-03-15", "date"), (0, 3, 1, '=A1&"13812345678"', "formula"), (1, 1, 2, "hidden 13900001111", "str")]
    assert cells.filter("error is not null").count() == 1
    lines = ["| 电话 13812345678 | ab |", "| --- | --- |", "| 13812345678 | 2.5 | TRUE | 2023-03-15 |", '| =A1&"13812345678" |']
    table = "\n".join(lines)
    for r in workbook.table_text(good.filter("sheet_idx = 0")).collect():
        assert table[r.start : r.end] == r.text
    edits = resolve.sanitize(good, fields=select(DEFAULTS, ["phone"])).filter(F.size("spans") > 0)
    values = edits.select("doc_id", F.explode("spans.value").alias("value"))
    out = workbook.redact(df.filter("path = 'a.xlsx'"), edits, values).first()
    red = bytes(out.content)
    with zipfile.ZipFile(io.BytesIO(red)) as z:
        assert not any(b"13812345678" in z.read(n) or b"13900001111" in z.read(n) for n in z.namelist())
    again = {(r[1], r[2], r[3]): r[4] for r in ((None, *c[1:]) for c in workbook.Workbook(red).cells())}
    assert again[0, 1, 1] == "电话 138****5678" and again[0, 2, 1] == "138****5678" and again[0, 2, 2] == "2.5"


def test_workbook_comes_back(spark):
    data = book([("A1", "s", 0), ("B1", "i", "a&#10;13812345678&#10;b"), ("A2", "n", "13812345678"), ("D2", "d", "45000")])
    df = spark.createDataFrame([("a", bytearray(data))], "doc_id string, content binary")
    cells = workbook.cells(df, "doc_id")
    edits = resolve.sanitize(cells, fields=select(DEFAULTS, ["phone"])).filter(F.size("spans") > 0)
    red = workbook.redact(df, edits, edits.select("doc_id", F.explode("spans.value").alias("value")), "doc_id")
    s = edits.select("doc_id", "sheet_idx", "row", "col", "kind", F.explode("spans").alias("s"))
    spans = s.select("doc_id", "sheet_idx", "row", "col", "kind", F.col("s.masked").alias("masked_value"), F.col("s.out_start").alias("masked_start"), F.col("s.out_end").alias("masked_end"), crypto.token(F.col("s.value"), KEY).alias("encrypted_value"))
    back = workbook.recover(red, spans, KEY, df).first()
    assert back.unresolved == 0 and back.restored == 4
    assert [c[1:] for c in workbook.Workbook(bytes(back.content)).cells()] == [c[1:] for c in workbook.Workbook(data).cells()]
    assert "a\n13812345678\nb" in [x[3] for x in workbook.Workbook(bytes(back.content)).raw_texts()]
    assert workbook.recover(red, spans, bytes(32)).first().restored == 0


def test_rectangles(spark):
    from palimpsest.operators import rects

    line = lambda a, b, y: {"text": "x" * (b - a), "box": {"x0": 0.0, "y0": y, "x1": 100.0, "y1": y + 10}, "start": a, "end": b}
    schema = f"doc_id int, {layout.BLOCK}"
    page = {"x0": 0.0, "y0": 50.0, "x1": 300.0, "y1": 90.0}
    rows = [(1, 0, "paragraph", "0123456789\n0123456789", 1, None, None, [line(0, 10, 0.0), line(11, 21, 10.0)], None, None, 100.0, 200.0), (1, 1, "table", "tt", 1, None, page, None, None, None, 100.0, 200.0)]
    b = documents.placed(spark.createDataFrame(rows, schema))
    spans = spark.createDataFrame([(1, 5, 13), (1, 22, 25)], "doc_id int, start int, end int")
    got = sorted((r.start, r.page, *r.box) for r in rects.plan(spans, b).collect())
    assert got == [(5, 0, 0.0, 9.0, 21.0, 21.0), (5, 0, 49.0, 0.0, 100.0, 11.0), (22, 0, 0.0, 50.0, 100.0, 90.0)]
    assert rects.per_page(rects.plan(spans, b)).first().regions == 3 and rects.mosaic_block(16) == 33


def test_model_findings(spark):
    from palimpsest.operators import detect, models

    def make():
        def provider(system, user):
            assert "- phone:" in system
            if "boom" in user:
                raise RuntimeError("no")
            return '```json\n{"items": [{"field_type": "person_name", "value": "Ann"}, {"field_type": "zzz", "value": "met"},]}\n```'

        return provider

    chunks = spark.createDataFrame([(1, 10, "we met Ann $1 \\1"), (2, 0, "boom Ann")], "doc_id int, base int, chunk string")
    asked = models.ask(chunks, make, DEFAULTS, "only adults").persist()
    assert {r.doc_id: r.error is None for r in asked.collect()} == {1: True, 2: False}
    assert [(r.span.start, r.span.value) for r in models.spans(asked, DEFAULTS).collect()] == [(17, "Ann")]
    docs = spark.createDataFrame([(1, "0123456789we met Ann $1"), (2, "x")], "doc_id int, text string")
    out = resolve.resolve(F.col("spans"))
    both = detect.detect(models.hybrid(docs, asked, DEFAULTS), findings=F.col("findings")).select("doc_id", out.alias("s"))
    assert {r.doc_id: [x.value for x in r.s] for r in both.collect()} == {1: ["Ann"], 2: []}
    for text, n in (('{"findings": [{"field_type": "a", "value": "b"}', 1), ("[]", 0), ("", 0), (None, 0), ("words", 0), ('x [{"field_type": "a", "value": "b"}] y', 1)):
        assert len(models.parse(text)) == n


def test_html_tables():
    t = "<table><thead><tr><th>a</th><th>b|c</th></tr></thead><tr><td> x<b>y</b>\nz </td></tr></table>"
    assert html.table_to_markdown(t) == "| a | b\\|c |\n| --- | --- |\n| xy z |  |"
    assert html.table_to_markdown("no table") == "no table" and html.table_to_markdown("") == "" and html.table_to_markdown(None) is None


def test_layout(spark):
    span = lambda t, kind="text": {"type": kind, "content": t}
    middle = {
        "pdf_info": [
            {"page_idx": 0, "page_size": [100, 200], "para_blocks": [
                {"type": "title", "level": 2, "bbox": [0, 0, 10, 10], "lines": [{"bbox": [0, 0, 10, 5], "spans": [span("第一行")]}, {"bbox": [0, 5, 10, 10], "spans": [span("第二行"), span("x", "span_equation_inline")]}]},
                {"type": "index"}, {"type": "table", "bbox": [0, 100, 100, 200], "blocks": [{"type": "table_caption", "lines": [{"spans": [span("表")]}]}]},
                {"type": "image", "bbox": [1, 1, 2, 2], "blocks": [{"image_path": "i/a.jpg", "bbox": [3, 3, 4, 4], "x": [{"type": "span_text", "content": "图"}]}]}, {"type": "odd"}]},
        ]
    }
    content = [[{"type": "table", "bbox": [0, 500, 1000, 1000], "content": {"html": "<table><tr><td>1</td></tr></table>"}}]]
    df = spark.createDataFrame([(1, json.dumps(middle), json.dumps(content)), (2, None, json.dumps([{"type": "text", "text": "t", "page_idx": 1, "text_level": 1}, {"type": "list", "list_items": [{"item_content": "a"}]}]))], "doc_id int, middle string, content string")
    got = {(r.doc_id, r.ord): r for r in layout.blocks(df).collect()}
    assert [(got[1, i].type, got[1, i].text) for i in range(4)] == [("title", "第一行\n第二行 x "), ("index", ""), ("table", "| 1 |\n| --- |"), ("image", "图")]
    assert [(x.start, x.end) for x in got[1, 0].lines] == [(0, 3), (4, 10)] and got[1, 0].level == 2 and got[1, 0].width == 100
    assert got[1, 3].image == "i/a.jpg" and got[1, 3].box.x0 == 3
    assert (got[2, 0].text, got[2, 0].page, got[2, 0].level, got[2, 1].text) == ("t", 2, 1, "- a")
    paired, rest = layout.pair_images(layout.blocks(df), spark.createDataFrame([(1, "/o/a.jpg"), (1, "/o/b.jpg")], "doc_id int, path string"))
    assert paired.filter("type = 'image'").first().image_path == "/o/a.jpg" and [r.path for r in rest.collect()] == ["/o/b.jpg"]


def test_keys_and_tokens(spark, tmp_path, monkeypatch):
    monkeypatch.delenv(crypto.ENVIRONMENT, raising=False)
    kept = crypto.KeyFile(spark, str(tmp_path / "k"))
    with pytest.raises(ValueError):
        crypto.to_open(None, kept)
    secret = crypto.to_seal(None, kept)
    assert len(secret) > 20 and (tmp_path / "k").stat().st_mode & 0o777 == 0o600
    assert crypto.to_open(None, kept) == secret == crypto.to_seal(None, kept) and crypto.to_open("own", kept) == "own"
    monkeypatch.setenv(crypto.ENVIRONMENT, "told")
    assert crypto.to_open(None, kept) == "told" and (tmp_path / "k").read_text().strip() == secret
    assert crypto.to_seal(None, kept) == "told" == (tmp_path / "k").read_text().strip()
    salt = crypto.new_salt()
    key = crypto.derive_key(secret, salt)
    assert crypto.key_of({"recovery": crypto.public_parameters(salt)}, secret) == key
    with pytest.raises(ValueError):
        crypto.key_of({}, secret)
    df = spark.createDataFrame([("",), ("a",), ("张三" * 60,), (None,)], "v string").withColumn("t", crypto.token(F.col("v"), key))
    for r in df.select("v", "t", crypto.opened(F.col("t"), key).alias("back"), crypto.opened(F.col("t"), KEY).alias("wrong"), crypto.opened(F.lit("x"), key).alias("no")).collect():
        assert r.back == r.v and r.wrong is None and r.no is None
    assert df.select("t").distinct().count() == 4


def test_audit_has_no_raw_values(spark):
    clean = resolve.sanitize(spark.createDataFrame([(1, "张三 13812345678"), (2, "x")], "doc_id int, text string"))
    text = json.dumps([r.audit for r in audit.public_json(clean, salt="00" * 16, key=KEY).collect()])
    assert "13812345678" not in text and "138****5678" in text
    assert audit.sensitive(clean).filter("value = '13812345678'").count() == 1
    assert {r.doc_id: r.total for r in audit.by_document(clean).collect()} == {1: 2, 2: 0}


@pytest.mark.parametrize("few", [0, 20_000])
def test_leftover_values(spark, monkeypatch, few):
    monkeypatch.setattr(verify, "FEW", few)
    texts = spark.createDataFrame([(1, "abcabcd \U0001f600张三"), (2, "xyz"), (3, ""), (4, None)], "doc_id int, text string")
    values = spark.createDataFrame([("abcd",), ("张三",), ("z",), ("abcabcd",), ("nope",), ("",), ("xyzz",)], "value string")
    got = sorted(map(tuple, verify.contained(texts, values).collect()))
    assert got == [(1, "abcabcd", 0), (1, "abcd", 3), (1, "张三", 9), (2, "z", 2)]


def test_values_of_all_lengths_by_marks(spark):
    """Every value of every class in every text that has it; a long text has few marks for long values (its grams were nearly as many as its characters)."""
    import random

    rng = random.Random(5)
    docs = ["".join(rng.choices("ab 张\U0001f600", k=rng.choice([0, 1, 3, 40, 300, 900]))) for _ in range(60)]
    cut = lambda n: (lambda d: d[(k := rng.randrange(len(d) - n)) : k + n])(rng.choice([d for d in docs if len(d) > n]))
    known = {cut(n) for n in (1, 2, 3, 4, 7, 8, 15, 16, 31, 32, 63, 64, 65, 200) for _ in range(3)} | {"a" * 64, "zz", cut(100) + "z"}
    texts = spark.createDataFrame([*enumerate([*docs, None])], "doc_id int, text string")
    got = sorted(map(tuple, verify.by_grams(texts, spark.createDataFrame([(v,) for v in known], "value string"), "doc_id", "text").collect()))
    assert got == sorted((i, v, d.index(v)) for i, d in enumerate(docs) for v in known if v in d) and len(got) > 300
    assert len(verify.marks("".join(rng.choices("abcdefgh ", k=100_000)), 64)) < 100_000 / 20


def test_long_values_do_not_go_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(verify, "by_automaton", lambda *_: pytest.fail("collected"))
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("x"), 800), "id", F.lit(".")).alias("text"))
    assert verify.contained(texts, texts.select(F.col("text").alias("value"))).count() == 400


def test_mosaics_of_a_batch_are_those_of_each_image(spark):
    """Images of several sizes and boxes, taken together where these are the same, which single ones were not."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        h, w, c = [(16, 16, 1), (9, 7, 3)][i % 2]
        boxes = [None, [], [(0, 0, 8, 8, "face", 1.0)], [(1, 2, 30, 9, "a", 0.5), (-3, 0, 4, 4, "b", 0.5)]][i // 2 % 4]
        rows.append((str(i), h, w, c, rng.integers(0, 256, h * w * c, np.uint8).tobytes(), boxes))
    df = spark.createDataFrame(rows, f"image string, height int, width int, channels int, pixels binary, boxes array<{images.OBJECT}>").coalesce(1)
    got = {r.image: bytes(r.pixels) for r in images.mosaics(df, 4).collect()}
    for i, h, w, c, data, boxes in rows:
        assert got[i] == images.mosaic(np.frombuffer(data, np.uint8).reshape(h, w, c), [b[:4] for b in boxes or []], 4).tobytes()
    stack = rng.integers(0, 256, (5, 16, 16, 1), np.uint8)
    assert (images.mosaic(stack, [(0, 0, 9, 9)], 4) == [images.mosaic(x, [(0, 0, 9, 9)], 4) for x in stack]).all()


def test_mosaic():
    image = np.arange(64, dtype=np.uint8).reshape(8, 8, 1)
    out = images.mosaic(image, [(0, 0, 4, 4), (6, 6, 20, 20), (30, 30, 40, 40)], factor=2)
    assert len(np.unique(out[:4, :4])) == 4 and (out[4:6] == image[4:6]).all() and (image == np.arange(64).reshape(8, 8, 1)).all()
    assert len(np.unique(images.mosaic(image, [(0, 0, 8, 8)], 99))) == 1


def test_recognised_lines(spark):
    box = (0.0, 0.0, 110.0, 10.0)
    df = spark.createDataFrame([("i", 0, "tel", 0.9, box), ("i", 1, "13812345678", 0.9, box), ("i", 2, "13912345678", 0.1, box)], "image string, line_no int, text string, score double, box struct<x0:double,y0:double,x1:double,y1:double>")
    r = images.text_boxes(df, select(DEFAULTS, ["phone"]), least=0.5).collect()
    assert len(r) == 1 and (r[0].boxes[0].x0, r[0].boxes[0].x1) == (-1.0, 111.0)


@pytest.mark.parametrize(
    "text, want",
    [
        ("a  b c", "a\nb c"),
        ("a\nb  c", "a\nb  c"),
        ("t  | a | b |  | --- | --- |  | 1 |  |  end", "t\n| a | b |\n| --- | --- |\n| 1 |  |\nend"),
        ("| a | b | | --- | --- | | 1 | 2 | | 3 | 4 |", "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"),
        ("plain", "plain"),
    ],
)
def test_guessed_line_breaks(text, want):
    assert newlines.restored(text) == want


def test_files(spark, tmp_path):
    for name in ("a/r.json", "a/r.pdf", "a/.x/h.json", "__p/q.json", "b.txt", "out/a/r/redacted.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    root = f"file:{tmp_path}"
    found = files.documents(files.scan(spark, str(tmp_path)), root, root + "/out")
    assert sorted((r.rel, r.supported) for r in found.collect()) == [("a/r.json", True), ("a/r.pdf", True), ("b.txt", False)]
    jobs = {r.rel: r.job_dir for r in files.job_dirs(found.filter("supported"), "/o").collect()}
    assert jobs == {"a/r.json": "/o/a/r", "a/r.pdf": "/o/a/r-pdf"}
    assert [r.rel for r in files.artifacts(files.scan(spark, str(tmp_path / "out")), root + "/out").collect()] == ["a/r/redacted.json"]
    audits = spark.createDataFrame([("a", "ok", None), ("b", "x", "{"), ("c", None, None)], "artifact string, z string, audit string").drop("z")
    assert {r.artifact: r.reason is None for r in files.recoverable(spark.createDataFrame([("a", '{"recovery": {"enabled": true}}'), ("b", "{"), ("c", None), ("d", "{}")], "artifact string, audit string")).collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert audits.count() == 3
    done = files.finished(spark.createDataFrame([("a", "ja", ["x"]), ("b", "jb", ["y"]), ("c", "jc", [])], "rel string, job_dir string, names array<string>"), spark.createDataFrame([("ja", "x")], "job_dir string, name string"))
    assert sorted(r.rel for r in done.collect()) == ["a", "c"]


def test_stream_writes_each_row_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "tel 13812345678")], "doc_id int, text string").write.parquet(src)
    for _ in range(2):
        stream(spark.readStream.schema("doc_id int, text string").parquet(src), out, str(tmp_path / "cp"), fields=select(DEFAULTS, ["phone"])).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert [(r.doc_id, r.masked_text) for r in rows] == [(1, "tel 138****5678")] and "text" not in rows[0]


@pytest.mark.parametrize("indent, end", [(None, ""), ("  ", "\n"), ("\t", "")])
def test_large_arrays_are_rows_of_elements(spark, indent, end):
    data = [{"p": "call 13812345678\nnow", "q": [1, {"r": 13900001111}], "e": {}, "l": []}, "13812345679", [], None, {"k": "é {[,]}"}, 13812345670]
    raw = json.dumps(data, ensure_ascii=False, indent=indent) + end
    docs = spark.createDataFrame([(1, raw), (2, "[]"), (3, " [ ] "), (4, '{"a": "13812345678"}'), (5, "[1,]"), (6, "[1 2]"), (7, "[1] x"), (8, None), (9, '"13812345678"')], "doc_id int, json string")
    fields = select(DEFAULTS, ["phone"])
    for parts in (None, 3):
        found = jsonleaves.elements(docs, parts=parts).collect()
        assert sorted((r.doc_id, r.page) for r in found if r.error is None) == [*((1, k) for k in range(1, 7)), (2, 1), (3, 1), (4, 1), (9, 1)]
        assert {r.doc_id for r in found if r.error} == {5, 6, 7}
        edits = resolve.masked_only(resolve.sanitize(jsonleaves.leaves(docs, parts=parts).filter("error is null"), fields=fields))
        red = {r.doc_id: r.json for r in jsonleaves.redact(docs, edits, parts=parts).collect()}
        want = json.loads(json.dumps(data).replace("13812345678", "138****5678").replace("13812345679", "138****5679").replace("13900001111", '"139****1111"').replace("13812345670", '"138****5670"'))
        assert red[1] == json.dumps(want, ensure_ascii=False, indent=indent) + end
        assert (red[2], red[4], red[9]) == ("[]", '{"a": "138****5678"}', '"138****5678"') and red[5] is red[6] is red[7] is None
        masked = spark.createDataFrame([(k, v) for k, v in red.items() if v is not None], "doc_id int, json string")
        back = {r.doc_id: r for r in jsonleaves.recover(masked, jsonleaves.edit_spans(edits, KEY), KEY, docs, parts=parts).collect()}
        assert back[1].json == raw and (back[1].restored, back[1].unresolved) == (4, 0)
        assert back[4].json == '{"a": "13812345678"}' and back[9].json == '"13812345678"'


def test_only_texts_with_a_table_leave_the_jvm(spark, monkeypatch):
    """All texts went to Python; its function is now called for those that have a table's rule, and the others come out the same."""
    texts = ["a  b   c", "a\n b  c", "a\rb  c", "", None, "x  | a | b |  | --- | --- |  | 1 | 2 |  y", "| --- |", "***  | a |  | --- |  z"]
    masks = [[], [], [], [], [], [], None, ["***", None, ""]]
    df = spark.createDataFrame([*zip(range(8), texts, masks)], "i int, text string, masks array<string>").coalesce(1)
    want = [None if t is None else t if i == 7 else newlines.restored(t) for i, t in enumerate(texts)]
    assert [r.o for r in df.select("i", newlines.restore(F.col("text"), F.col("masks")).alias("o")).orderBy("i").collect()] == want
    given = spark.sparkContext.accumulator(0)
    real = newlines.restored
    counted = lambda t: (given.add(1), real(t))[1]
    monkeypatch.setattr(newlines, "_made", lambda ts: ts.map(lambda t: t and counted(t)), raising=False)
    assert df.select(newlines.restore(F.col("text"), F.col("masks")).alias("o")).filter("o is not null").count() == 7 and given.value == 2


def test_many_small_json_documents_share_batches(spark):
    """A batch for each document took milliseconds for each: 40,000 of them, minutes."""
    import time

    docs = spark.range(40_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit('{"k": '), "id", F.lit("}")).alias("json"))
    jsonleaves.leaves(docs.limit(10)).count()
    began = time.monotonic()
    got = jsonleaves.leaves(docs).agg(F.count(F.lit(1)), F.countDistinct("doc_id", "text"), F.min(F.expr("text = doc_id"))).first()
    assert tuple(got) == (40_000, 40_000, True)
    assert jsonleaves.elements(docs).filter("page = 1 and not many and error is null").count() == 40_000
    assert time.monotonic() - began < 40


def test_json_batches_keep_order_documents_and_errors(spark):
    """Documents of more leaves than a batch holds, between small ones, broken ones and arrays."""
    many = json.dumps({f"k{i}": i for i in range(9_000)})
    raw = ['{"a": [1, {"b": "x"}]}', many, "{", None, "[1, [2], {}]", "7", "[]", '{"c": null}']
    rows = [*enumerate(raw)]
    df = spark.createDataFrame(rows, "doc_id int, json string").coalesce(1)
    got = jsonleaves.leaves(df).collect()
    assert [r.doc_id for r in got] == [0] * 2 + [1] * 9_000 + [2] + [4] * 2 + [5]
    assert [r.leaf_no for r in got if r.doc_id == 1] == [*range(9_000)] and [r.text for r in got if r.doc_id == 1] == [*map(str, range(9_000))]
    assert [(s.key, s.idx) for r in got if r.doc_id == 0 for s in r.path] == [("a", None), (None, 0), ("a", None), (None, 1), ("b", None)]
    assert [(r.page, [s.idx for s in r.path]) for r in got if r.doc_id == 4] == [(1, [0]), (2, [1, 0])]
    assert [r.error is not None for r in got if r.doc_id in (2, 5)] == [True, False] and got[-1].path == []
    dealt = jsonleaves.leaves(df, parts=3).collect()
    assert sorted(map(str, dealt)) == sorted(map(str, got))


def test_rectangles_read_their_blocks_twice_and_once_dealt(spark, sf):
    """The plan made the blocks a third time for their boxes, dealt them anew for each window and join, and broadcast the spans by the size of the file."""
    from palimpsest.plans.queries import QUERIES

    plan = QUERIES["rect_plan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 2 and plan.count("Exchange") == 4 and "Broadcast" not in plan, plan


def test_small_files_are_work_for_all_cores(spark, sf):
    """Customers are one small file, which was one task however many rows it has."""
    from palimpsest.plans.queries import keyed

    rows = keyed(spark, sf)
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows.select("c_custkey").distinct().count() == rows.count() == 150
