"""Whole runs over a folder, and the driver contract."""

import json

from palimpsest import cli
from palimpsest.plans import pipeline, queries
from palimpsest.sources import workbook
from tests.test_structures import book


def test_run_resume_and_restore(spark, tmp_path, capsys):
    src, out = tmp_path / "in", str(tmp_path / "out")
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("联系人：张三，电话 13812345678\n***", encoding="utf-8")
    (src / "sub" / "b.json").write_text(json.dumps({"p": [13812345678, {"q": "a 13900001111 b"}]}), encoding="utf-8")
    (src / "bad.json").write_text("{", encoding="utf-8")
    (src / "c.xlsx").write_bytes(book([("A1", "s", 0), ("B1", "n", "13812345678")]))
    (src / "d.pdf").write_bytes(b"%PDF")
    assert cli.main([str(src), out, "--recoverable", "--key", "secret"], spark) == 1
    assert "failed: 1 ok: 3 unsupported: 1" in capsys.readouterr().out
    made = {(r.rel, bytes(r.content)) for r in spark.read.parquet(f"{out}/artifacts").collect()}
    assert all(b"13812345678" not in c for _, c in made if not c.startswith(b"PK"))
    spans = spark.read.parquet(f"{out}/audit_spans")
    assert "value" not in spans.columns and spans.count() == 7
    (src / "e.txt").write_text("x", encoding="utf-8")
    (src / "bad.json").write_text("[]", encoding="utf-8")
    status = pipeline.run(spark, str(src), out, pipeline.Options(recoverable=True, passphrase="secret"))
    assert {r.rel for r in status.filter("status = 'ok'").collect()} == {"a.txt", "sub/b.json", "c.xlsx", "e.txt", "bad.json"}
    back = {r.rel: r for r in pipeline.restore(spark, out, "secret").collect()}
    assert bytes(back["a.txt"].content).decode() == (src / "a.txt").read_text(encoding="utf-8")
    assert json.loads(bytes(back["sub/b.json"].content)) == json.loads((src / "sub" / "b.json").read_text())
    assert {r.unresolved for r in back.values()} == {0}
    texts = {c[1:4]: c[4] for c in workbook.Workbook(bytes(back["c.xlsx"].content)).cells()}
    assert texts[0, 1, 1] == "电话 13812345678" and texts[0, 1, 2] == "13812345678"
    assert cli.main([out, "--recover", "--key", "other"], spark) == 1


def test_resumed_and_repeated_runs_restore_every_file(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    texts = {"a.txt": "call 13812345678", "b.txt": "mail x@example.com", "c.json": json.dumps({"p": "13900001111"})}
    for k, name in enumerate(texts):
        (src / name).write_text(texts[name], encoding="utf-8")
        status = pipeline.run(spark, str(src), out, pipeline.Options(recoverable=True, passphrase="secret"))
        assert status.count() == k + 1
    assert spark.read.parquet(f"{out}/audit_spans").select("recovery").distinct().count() == 1

    def back(n):
        rows = {r.rel: r for r in pipeline.restore(spark, out, "secret").collect()}
        assert {k: (r.restored, r.unresolved) for k, r in rows.items()} == dict.fromkeys(texts, (1, 0))
        assert {k: bytes(r.content).decode() for k, r in rows.items()} == texts
        assert spark.read.parquet(f"{out}/artifacts").count() == n

    back(3)
    pipeline.run(spark, str(src), out, pipeline.Options(recoverable=True, passphrase="secret", skip_existing=False))
    back(6)
    # What a run without a status left behind does not count.
    made = pipeline.committed(spark, out, "artifacts").drop("run")
    made.write.parquet(f"{out}/artifacts/run=9-unfinished")
    back(9)
    # Another salt, as runs elsewhere have: each span by its own.
    spans = spark.read.parquet(f"{out}/audit_spans")
    assert {json.loads(r.recovery)["kdf_salt"] for r in spans.select("recovery").distinct().collect()} != set()


def test_runs_with_salts_of_their_own(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    monkeypatch.setattr(pipeline, "_salt", lambda *_: None)
    for name, text in (("a.txt", "call 13812345678"), ("b.txt", "call 13812345679")):
        (src / name).write_text(text)
        pipeline.run(spark, str(src), out, pipeline.Options(recoverable=True, passphrase="secret"))
    assert spark.read.parquet(f"{out}/audit_spans").select("recovery").distinct().count() == 2
    assert {(r.rel, r.restored, r.unresolved) for r in pipeline.restore(spark, out, "secret").collect()} == {("a.txt", 1, 0), ("b.txt", 1, 0)}
    assert {r.unresolved for r in pipeline.restore(spark, out, "other").collect()} == {1}


def test_documents_of_pages_and_results_as_files(spark, tmp_path, capsys):
    src, out, parsed, made = tmp_path / "in", str(tmp_path / "out"), tmp_path / "parsed", tmp_path / "files"
    (src / "sub").mkdir(parents=True)
    (src / "sub" / "d.pdf").write_bytes(b"%PDF")
    (src / "sub" / "d.json").write_text('{"p": "13812345678"}')
    (src / "e.docx").write_bytes(b"PK")
    (parsed / "sub" / "d" / "auto").mkdir(parents=True)
    records = [{"type": "text", "text": "Title", "text_level": 1, "page_idx": 0}, {"type": "text", "text": "call 13812345678 or x@example.com", "page_idx": 1}]
    (parsed / "sub" / "d" / "auto" / "d_content_list.json").write_text(json.dumps(records))
    assert cli.main([str(src), out, "--recoverable", "--key", "secret", "--parsed", str(parsed), "--files", str(made), "--summary"], spark) == 1
    assert json.loads(capsys.readouterr().out)["totals"] == {"failed": 1, "ok": 2}
    text = (made / "sub" / "d-pdf" / "sanitized.md").read_text()
    assert "138****5678" in text and "example" not in text
    assert json.loads((made / "sub" / "d" / "redacted.json").read_text()) == {"p": "138****5678"}
    told = json.loads((made / "sub" / "d-pdf" / "audit.json").read_text())
    assert told["total"] == 2 and told["artifacts"] == ["sanitized.md"] and told["recovery"]["enabled"] and "13812345678" not in json.dumps(told)
    assert cli.main([out, "--recover", "--key", "secret", "--files", str(tmp_path / "back")], spark) == 0
    assert "call 13812345678 or x@example.com" in (tmp_path / "back" / "sub" / "d_recovered.pdf").read_text()
    assert json.loads((tmp_path / "back" / "sub" / "d_recovered.json").read_text()) == {"p": "13812345678"}

    def parser(data, suffix):
        return None, json.dumps([{"type": "text", "text": f"{suffix} 13812345678", "page_idx": 0}])

    status = pipeline.run(spark, str(src), out, pipeline.Options(parser=parser))
    assert {r.rel for r in status.filter("status = 'ok'").collect()} == {"sub/d.pdf", "sub/d.json", "e.docx"}


def test_a_model_beside_the_rules(spark, tmp_path, capsys):
    """Over a service of this test: a busy answer first, findings, and a refusal that fails its document."""
    import http.server
    import threading

    seen = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            told = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            user = told["messages"][1]["content"]
            seen.append((self.path, self.headers["Authorization"], told["model"], user))
            code = 503 if sum(s[3] == user for s in seen) == 1 else 400 if "refuse" in user else 200
            found = [{"field_type": "person_name", "value": "Ann Lee"}] if "Ann" in user else []
            body = json.dumps({"choices": [{"message": {"content": json.dumps({"findings": found})}}]}).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        src, out, made = tmp_path / "in", str(tmp_path / "out"), tmp_path / "files"
        src.mkdir()
        (src / "a.txt").write_text("Ann Lee calls 13812345678")
        (src / "b.txt").write_text("refuse this")
        (tmp_path / "models.yaml").write_text(f"default: m\nmodels:\n  m: {{url: 'http://127.0.0.1:{server.server_port}/v1', model: tiny, key: k}}\n")
        assert cli.main([str(src), out, "--models", str(tmp_path / "models.yaml"), "--files", str(made)], spark) == 1
    finally:
        server.shutdown()
    assert "failed: 1 ok: 1" in capsys.readouterr().out
    assert (made / "a" / "sanitized.md").read_text() == "*** calls 138****5678" and not (made / "b").exists()
    assert {s[:3] for s in seen} == {("/v1/chat/completions", "Bearer k", "tiny")}


def test_an_image_that_the_model_fails_on_is_an_error(spark):
    from palimpsest.operators import images

    def model(data):
        if data == b"bad":
            raise ValueError("no image")
        return [{"x0": 0, "y0": 0, "x1": 1, "y1": 1, "label": x, "confidence": 0.5} for x in ("face", "plate")] if data else []

    df = spark.createDataFrame([(1, b"ok"), (2, b"bad"), (3, b"")], "i int, content binary")
    got = {r.i: r for r in images.detect_objects(df, model, ["face"]).collect()}
    assert [b.label for b in got[1].boxes] == ["face"] and got[1].error is None
    assert got[2].boxes is None and got[2].error == "ValueError: no image"
    assert got[3].boxes == [] and got[3].error is None


def test_contract(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    made, sql = entry.queries(), entry.oracle_sql()
    assert set(queries.QUERIES) <= set(made) and set(sql) <= set(made)


def test_queries_are_their_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    plain = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    for name, sql in queries.SQL.items():
        df, want = queries.QUERIES[name](spark, sf), con.sql(sql)
        cols = sorted(df.columns)
        assert sorted(want.columns) == cols, name
        assert plain(df.select(*(f"`{c}`" for c in cols)).collect()) == plain(want.project(",".join(f'"{c}"' for c in cols)).fetchall()), name
