"""The service from upload to answer, its refusals and its errors."""

import base64
import json
import threading
import urllib.request

import pytest

from docquarry import service


@pytest.fixture(scope="module")
def app(spark, tmp_path_factory):
    events = []
    a = service.App(spark, str(tmp_path_factory.mktemp("store")), fetch=lambda url: b"fetched words about rivers", trace=events.append)
    a.events = events
    return a


def call(app, method, path, **given):
    return app.handle(method, path, json.dumps(given).encode() if given else b"")


def b64(text: str) -> str:
    return base64.b64encode(text.encode()).decode()


def test_corpora(app):
    assert call(app, "POST", "/corpora", corpus_id="law", name="Law")[0] == 201
    assert call(app, "POST", "/corpora", corpus_id="law")[0] == 409 and call(app, "POST", "/corpora", corpus_id="No Id")[0] == 400 and call(app, "POST", "/corpora", corpus_id="x", source="nowhere")[0] == 400
    status, value = call(app, "GET", "/corpora")
    assert status == 200 and [c["corpus_id"] for c in value["corpora"]] == ["default", "law"] and value["corpora"][1]["status"] == "empty"
    assert call(app, "DELETE", "/corpora/default")[0] == 403 and call(app, "DELETE", "/corpora/zz")[0] == 404
    assert call(app, "GET", "/sources")[1]["sources"] == ["local", "managed"]


def test_from_upload_to_answer(app):
    call(app, "POST", "/corpora", corpus_id="wind")
    assert call(app, "POST", "/ingestion", corpus_id="wind")[0] == 404
    assert call(app, "POST", "/query", query="turbines?", corpus_id="wind")[1]["reason"] == "empty_corpus"
    assert call(app, "POST", "/corpora/wind/upload", files=[{"path": "../x.txt", "content": b64("x")}])[0] == 400
    assert call(app, "POST", "/corpora/wind/upload", files=[{"path": "x.txt", "content": "%%"}])[0] == 400
    good = [{"path": "alpha.txt", "content": b64("Turbines turn fast when strong winds blow over hills.")}, {"path": "sub/beta.md", "content": b64("Harbours freeze in winter and ships wait outside.")}]
    assert call(app, "POST", "/corpora/wind/upload", files=good)[1]["files"] == ["alpha.txt", "sub/beta.md"]
    assert call(app, "POST", "/corpora/wind/import-url", url="http://127.0.0.1/a.txt")[0] == 400
    assert call(app, "POST", "/corpora/wind/import-url", url="https://example.org/gamma.txt")[1]["files"] == ["gamma.txt"]
    status, value = call(app, "POST", "/ingestion", corpus_id="wind")
    assert status == 200 and value["counts"] == {"new": 3} and value["n_points"] == 3 and value["status"] == "succeeded"
    assert call(app, "POST", "/ingestion", corpus_id="wind")[1]["counts"] == {"unchanged": 3}
    status, value = call(app, "POST", "/query", query="How fast do turbines turn in strong winds?", corpus_id="wind")
    assert status == 200 and value["status"] == "answered" and "Turbines" in value["answer"] and value["citations"][0] == "S1"
    assert call(app, "POST", "/query", query="Anything on zebras?", corpus_id="wind")[1]["status"] == "refused"
    both = call(app, "POST", "/query", query="Compare alpha.txt and beta.md", corpus_id="wind")[1]
    assert both["status"] == "complete" and both["intent"] == "compare" and len(both["citations"]) == 2
    assert call(app, "DELETE", "/corpora/wind")[0] == 200


def test_profiles(app):
    good = {"name": "law", "fields": {"day": "date", "tags": "list[text]"}, "filterable": ["day"], "categories": ["a", "b"]}
    assert call(app, "POST", "/profiles/validate", **good)[0] == 201 and call(app, "POST", "/profiles/validate", **good)[0] == 409
    assert call(app, "POST", "/profiles/validate", **good, overwrite=True)[0] == 201
    assert call(app, "POST", "/profiles/validate", name="X", fields={"a": "odd"})[0] == 422
    assert [p["name"] for p in call(app, "GET", "/profiles")[1]["profiles"]] == ["law"]
    assert call(app, "POST", "/profiles/propose", domain="law")[0] == 502
    assert call(app, "DELETE", "/profiles/law")[0] == 200 and call(app, "DELETE", "/profiles/law")[0] == 404
    assert service.profile_errors({"name": "a", "fields": {}, "categories": ["A", "a"]}) == ["categories"]


def test_faults_and_traces(app):
    assert call(app, "GET", "/nothing")[0] == 404 and call(app, "DELETE", "/sources")[0] == 405 and app.handle("POST", "/query", b"{")[0] == 400 and call(app, "POST", "/query", query=" ")[0] == 400
    assert call(app, "POST", "/query", query="x", corpus_id="unknown")[0] == 404
    status, value = app.handle("GET", "/sources", request_id="req-7")
    assert value["request_id"] == "req-7" and app.handle("GET", "/sources", request_id="no good")[1]["request_id"] != "no good"
    broken = service.App(app.spark, app.root, fetch=lambda url: 1 / 0, trace=app.trace)
    call(app, "POST", "/corpora", corpus_id="tmp")
    status, value = call(broken, "POST", "/corpora/tmp/import-url", url="https://example.org/a.txt")
    assert status == 500 and value["error"] == "internal error"
    assert app.events[-1]["phase"] == "failed" and app.events[-1]["kind"] == "ZeroDivisionError" and {"seconds", "request_id"} <= app.events[-1].keys()


def test_over_http(app):
    server = service.serve(app, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/sources") as r:
            assert r.status == 200 and json.loads(r.read())["sources"] and r.headers["X-Request-Id"]
    finally:
        server.shutdown()
