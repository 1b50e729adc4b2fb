"""The engine behind a small HTTP surface: corpora, uploads, ingestion, questions, profiles.

``App`` is a plain object: every collaborator can be given, and ``handle`` turns a method, path and body into a status and a JSON value, so it is tested without a socket. ``serve`` puts it behind the standard library's server; ``python -m docquarry.service --root DIR`` starts one. A refusal is an answer (200); what the caller got wrong is 4xx; nothing of an inner error leaves but its request id.
"""

from __future__ import annotations

import argparse
import base64
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import agent, multidoc, perimeter, search, structure
from .operators.filters import Profile
from .sources import commits, corpora, files, registry, snapshot, uploads

POINTS = "point_id string, point long, doc_id long, file_name string, source string, chunk_index long, parent_id string, kind string, section string, text string"
FILES = "path string, hash string, signature string"
KINDS = ("text", "number", "integer", "boolean", "date")


class Problem(Exception):
    """A fault of the request: a status and a message that the caller may see."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def offline(prompts):
    """Stand-in for a model: every passage suffices, answers quote the first ones, nothing is reformulated."""

    def one(p: str):
        if p.startswith("SUFFICIENT?"):
            return '{"sufficient": true}'
        if p.startswith(("REFORMULATE", "REPAIR", "INTENT", "DECIDE")):
            return None
        found = re.findall(r"\[(S\d+)\] (\S[^\n]*)", p)
        return " ".join(f"{' '.join(body.split()[:30])} [{c}]" for c, body in found[:2]) or None

    return prompts.map(one)


def profile_errors(profile: dict) -> list[str]:
    """What is wrong with a profile {name, fields: {name: kind}, filterable: [...], categories: [...]}."""
    out = []
    if not re.fullmatch(r"[a-z0-9][a-z0-9_]{0,63}", str(profile.get("name", ""))):
        out.append("name")
    fields = profile.get("fields")
    if not isinstance(fields, dict) or not all(str(k).removeprefix("list[").removesuffix("]") in KINDS for k in fields.values()):
        out.append("fields")
    elif not set(profile.get("filterable", [])) <= set(fields):
        out.append("filterable")
    if len(set(map(str.casefold, profile.get("categories", [])))) != len(profile.get("categories", [])):
        out.append("categories")
    return out


@dataclass
class App:
    spark: SparkSession
    root: str
    model: Callable = offline
    sources: snapshot.Sources = field(default_factory=snapshot.Sources)
    fetch: Callable[[str], bytes] | None = None
    trace: Callable[[dict], None] = lambda event: None
    settings: dict = field(default_factory=lambda: {"strategy": "structure", "top_k": 6})

    def __post_init__(self):
        self.store = corpora.Store(self.root)
        self.routes = [
            ("POST", r"/query", self.query), ("POST", r"/ingestion", self.ingest), ("GET", r"/corpora", self.list_corpora), ("POST", r"/corpora", self.create_corpus), ("DELETE", r"/corpora/([^/]+)", self.delete_corpus),
            ("GET", r"/sources", self.list_sources), ("POST", r"/corpora/([^/]+)/upload", self.upload), ("POST", r"/corpora/([^/]+)/import-url", self.import_url), ("POST", r"/profiles/propose", self.propose_profile),
            ("POST", r"/profiles/validate", self.save_profile), ("GET", r"/profiles", self.list_profiles), ("DELETE", r"/profiles/([^/]+)", self.delete_profile),
        ]

    # -- requests

    def handle(self, method: str, path: str, body: bytes = b"", request_id: str | None = None) -> tuple[int, dict]:
        """(status, value); the value holds request_id. Started, completed and failed requests go to the trace with their seconds and outcome."""
        rid = request_id if request_id and re.fullmatch(r"[A-Za-z0-9._-]{1,128}", request_id) else str(uuid.uuid4())
        began = time.monotonic()
        self.trace({"request_id": rid, "phase": "started", "operation": f"{method} {path}"})
        try:
            status, value = self._route(method, path, body)
            outcome = "refusal" if value.get("status") == "refused" else "success"
            event = {"phase": "completed", "outcome": outcome}
        except Problem as e:
            status, value, event = e.status, {"error": str(e)}, {"phase": "completed", "outcome": "rejected"}
        except Exception as e:
            status, value, event = 500, {"error": "internal error"}, {"phase": "failed", "outcome": "error", "kind": type(e).__name__}
        self.trace({"request_id": rid, "operation": f"{method} {path}", "seconds": round(time.monotonic() - began, 6), "http_status": status, **event})
        return status, {**value, "request_id": rid}

    def _route(self, method: str, path: str, body: bytes) -> tuple[int, dict]:
        there = False
        for verb, pattern, run in self.routes:
            m = re.fullmatch(pattern, path.split("?")[0].rstrip("/") or "/")
            if m and verb == method:
                try:
                    given = json.loads(body) if body.strip() else {}
                except ValueError:
                    raise Problem(400, "the body is no JSON") from None
                if not isinstance(given, dict):
                    raise Problem(400, "the body is no JSON object")
                return run(*m.groups(), given)
            there = there or bool(m)
        raise Problem(405, "no such method here") if there else Problem(404, "no such path")

    def _corpus(self, corpus_id) -> str:
        try:
            corpora.check_id(corpus_id if isinstance(corpus_id, str) else "")
        except ValueError as e:
            raise Problem(400, str(e)) from None
        if self.store.corpora(self.spark).where(F.col("corpus_id") == corpus_id).isEmpty():
            raise Problem(404, f"no corpus {corpus_id!r}")
        return corpus_id

    # -- corpora

    def list_corpora(self, _: dict) -> tuple[int, dict]:
        rows = []
        for r in self.store.corpora(self.spark).orderBy("corpus_id").collect():  # one row a corpus
            there, n = self.store.info(self.spark, r.corpus_id)
            rows.append({"corpus_id": r.corpus_id, "name": r.name, "source": r.source, "profile": r.profile, "n_points": n, "status": "ready" if there and n else "empty"})
        return 200, {"corpora": rows}

    def create_corpus(self, given: dict) -> tuple[int, dict]:
        corpus_id = given.get("corpus_id")
        try:
            corpora.check_id(corpus_id if isinstance(corpus_id, str) else "")
        except ValueError as e:
            raise Problem(400, str(e)) from None
        if given.get("source", "managed") not in (*self.sources.factories, "managed"):
            raise Problem(400, "no such source")
        try:
            self.store.declare(self.spark, corpus_id, given.get("name"), given.get("source", "managed"), given.get("profile"))
        except ValueError as e:
            raise Problem(409, str(e)) from None
        return 201, {"corpus_id": corpus_id}

    def delete_corpus(self, corpus_id: str, _: dict) -> tuple[int, dict]:
        if corpus_id == corpora.DEFAULT:
            raise Problem(403, "the default corpus is protected")
        self.store.delete(self.spark, self._corpus(corpus_id))
        return 200, {"deleted": corpus_id}

    def list_sources(self, _: dict) -> tuple[int, dict]:
        return 200, {"sources": sorted({*self.sources.factories, "managed"})}

    # -- files

    def _write(self, corpus_id: str, path: str, raw: bytes) -> None:
        store, p = commits.store(self.spark, f"{self.store.folder('managed', corpus_id)}/{path}")
        out = store.create(p, True)
        try:
            out.write(bytearray(raw))
        finally:
            out.close()

    def upload(self, corpus_id: str, given: dict) -> tuple[int, dict]:
        """files: [{path, content (base64)}], all or none."""
        corpus_id = self._corpus(corpus_id)
        listed = given.get("files")
        if not isinstance(listed, list) or not listed:
            raise Problem(400, "no files")
        try:
            raws = [base64.b64decode(f["content"], validate=True) for f in listed]
            rows = [("upload", i, str(f["path"]), len(raw)) for i, (f, raw) in enumerate(zip(listed, raws, strict=True))]
        except (KeyError, TypeError, ValueError):
            raise Problem(400, "a file needs a path and base64 content") from None
        checked = uploads.check_batch(self.spark.createDataFrame(rows, "batch string, pos int, path string, length long")).orderBy("pos").collect()
        errors = {r.path: r.error for r in checked if r.error}
        if errors:
            raise Problem(413 if set(errors.values()) & {"too_large", "too_many_bytes", "too_many_files"} else 400, f"refused: {errors}")
        for r, raw in zip(checked, raws, strict=True):
            self._write(corpus_id, r.path, raw)
        return 201, {"files": [r.path for r in checked]}

    def import_url(self, corpus_id: str, given: dict) -> tuple[int, dict]:
        corpus_id = self._corpus(corpus_id)
        df = self.spark.createDataFrame([(str(given.get("url") or ""),)], "u string")
        r = df.select(uploads.url_error(F.col("u")).alias("error"), uploads.url_file(F.col("u")).alias("f")).first()
        if r.error or r.f.error:
            raise Problem(400, f"refused: {r.error or r.f.error}")
        if self.fetch is None:
            raise Problem(501, "this service does not fetch")
        raw = self.fetch(given["url"])
        if not raw or len(raw) > files.MAX_BYTES:
            raise Problem(413 if raw else 400, "the file is empty or too large")
        self._write(corpus_id, r.f.name, raw)
        return 201, {"files": [r.f.name]}

    # -- ingestion

    def ingest(self, given: dict) -> tuple[int, dict]:
        """One run over a corpus's whole source; an error of one file is a count, not a failure."""
        corpus_id = self._corpus(given.get("corpus_id", corpora.DEFAULT))
        entry = self.store.corpora(self.spark).where(F.col("corpus_id") == corpus_id).first()
        managed = self.store.folder("managed", corpus_id)
        root = given.get("root") if entry.source != "managed" else managed
        try:
            source = self.sources.make("local" if entry.source == "managed" else entry.source, root=root)
            limit = given.get("limit")
            report = ingest(self.spark, self.store, corpus_id, source, self.settings, int(limit) if limit is not None else None)
        except FileNotFoundError:
            raise Problem(404, "the corpus has no files") from None
        return 200, report

    # -- questions

    def query(self, given: dict) -> tuple[int, dict]:
        question, corpus_id = str(given.get("query") or ""), given.get("corpus_id", corpora.DEFAULT)
        if not question.strip():
            raise Problem(400, "the question is empty")
        corpus_id = self._corpus(corpus_id)
        if not self.store.info(self.spark, corpus_id)[1]:
            return 200, {"status": "refused", "reason": "empty_corpus", "answer": None, "citations": []}
        asked = self.spark.createDataFrame([(1, question, corpus_id)], "qid long, text string, corpus_id string")
        points = self.store.points(self.spark, corpus_id)
        cards = points.select("doc_id", "file_name", "source").distinct().withColumn("title", F.lit(None).cast("string"))
        intent = agent.intents(asked).first()
        if intent.intent in ("compare", "synthesize"):
            return 200, self._several(asked, intent, points, cards)
        bounds = perimeter.from_questions(asked, cards)

        def find(open_: DataFrame) -> DataFrame:
            return search.search(open_, points, given.get("filters") or None, Profile({}), bounds, self.settings["top_k"])[0]

        try:
            r = agent.respond(asked, self.store.corpora(self.spark), find, self.model).first()
        except ValueError as e:
            raise Problem(400, str(e)) from None
        return 200, {"status": r.status, "intent": agent_node(intent.intent), "answer": r.answer, "citations": list(r.citations), "attempts": r.attempts}

    def _several(self, asked: DataFrame, intent, points: DataFrame, cards: DataFrame) -> dict:
        from .operators import routing

        refs = asked.select("qid", F.posexplode(routing.references(F.col("text"))).alias("pos", "reference"))
        own = perimeter.many_documents(refs, cards).join(cards.select("doc_id", F.col("file_name").alias("label")), "doc_id").select("qid", F.col("place").alias("index"), "doc_id", "label")
        task = asked.select("qid", "text", F.lit(intent.intent).alias("operation"), F.lit(intent.scope).alias("scope"))
        model = multidoc.Scripted() if self.model is offline else self.model
        passages = search.load_documents(points, own).select("doc_id", F.col("place").alias("n"), "text")
        r = multidoc.run(task, own, passages, model)[0].first()
        return {"status": r.status, "intent": intent.intent, "answer": r.answer, "citations": list(r.citations), "reason": r.reason}

    # -- profiles

    def _profiles(self) -> DataFrame:
        path = snapshot.current(self.spark, self.store.folder("profiles"))
        schema = "name string, profile string"
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def propose_profile(self, given: dict) -> tuple[int, dict]:
        """A profile that the model suggests for a domain; it is checked, not stored."""
        import pandas as pd

        said = self.model(pd.Series([f"PROFILE\n{given.get('domain', '')}"])).iloc[0]
        found = re.search(r"\{.*\}", said or "", re.S)
        try:
            profile = json.loads(found[0]) if found else None
        except ValueError:
            profile = None
        if profile is None:
            raise Problem(502, "the model proposed no profile")
        return 200, {"profile": profile, "errors": profile_errors(profile)}

    def save_profile(self, given: dict) -> tuple[int, dict]:
        errors = profile_errors(given)
        if errors:
            raise Problem(422, f"wrong: {', '.join(errors)}")
        have = self._profiles()
        if not given.get("overwrite") and not have.where(F.col("name") == given["name"]).isEmpty():
            raise Problem(409, f"profile {given['name']!r} is there already")
        new = self.spark.createDataFrame([(given["name"], json.dumps({k: v for k, v in given.items() if k != "overwrite"}, sort_keys=True))], have.schema)
        snapshot.publish(have.where(F.col("name") != given["name"]).unionByName(new), self.store.folder("profiles"))
        return 201, {"name": given["name"]}

    def list_profiles(self, _: dict) -> tuple[int, dict]:
        return 200, {"profiles": [json.loads(r.profile) for r in self._profiles().orderBy("name").collect()]}

    def delete_profile(self, name: str, _: dict) -> tuple[int, dict]:
        have = self._profiles()
        if have.where(F.col("name") == name).isEmpty():
            raise Problem(404, f"no profile {name!r}")
        snapshot.publish(have.where(F.col("name") != name), self.store.folder("profiles"), allow_empty=True)
        return 200, {"deleted": name}


def agent_node(intent: str) -> str:
    return intent if intent in ("summarize", "classify", "extract", "compare", "synthesize") else "search"


def ingest(spark: SparkSession, store: corpora.Store, corpus_id: str, source, settings: dict, limit: int | None = None) -> dict:
    """One incremental run: changed files are read, cut into chunks and written as points, vanished ones leave; the registry of files is published last, so a run that breaks is done again. The counts of the run."""
    place = store.folder("files", corpus_id)
    path = snapshot.current(spark, place)
    old = spark.read.schema(FILES).parquet(path) if path else spark.createDataFrame([], FILES)
    after, pages, status = snapshot.sync(spark, source, old, settings, limit)
    doc = F.xxhash64("path")
    texts = pages.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text")).select(doc.alias("doc_id"), "path", "text")
    chunks = structure.chunks(texts, settings.get("strategy", "structure")).join(texts.select("doc_id", "path"), "doc_id")
    pid = registry.point_id(F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    points = chunks.select(pid.alias("point_id"), F.xxhash64(pid).alias("point"), "doc_id", F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), F.col("path").alias("source"), "chunk_index", "parent_id", "kind", "section", "text")
    gone = status.where(F.col("status").isin("deleted", "changed")).select(doc.alias("doc_id"))
    store.create(spark.createDataFrame([], POINTS), corpus_id)
    store.change(spark, corpus_id, points, gone)
    counts = {r.status: r["count"] for r in status.groupBy("status").count().collect()}
    snapshot.publish(after.select("path", "hash", "signature"), place, allow_empty=True)
    found = sum(n for s, n in counts.items() if s != "deleted")
    failed = counts.get("failed", 0)
    return {"corpus_id": corpus_id, "counts": counts, "n_points": store.info(spark, corpus_id)[1], "status": "failed" if found and failed >= found else "partial" if failed else "succeeded"}


def handler(app: App):
    class Handler(BaseHTTPRequestHandler):
        def _do(self):
            size = int(self.headers.get("Content-Length") or 0)
            if size > 2 * uploads.MOST_BYTES:
                status, value = 413, {"error": "the body is too large"}
            else:
                status, value = app.handle(self.command, self.path, self.rfile.read(size), self.headers.get("X-Request-Id"))
            raw = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.send_header("X-Request-Id", value.get("request_id", ""))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_DELETE = _do

        def log_message(self, *args):
            pass

    return Handler


def serve(app: App, host: str = "127.0.0.1", port: int = 8080) -> HTTPServer:
    return HTTPServer((host, port), handler(app))


def main() -> None:
    from .session import build

    p = argparse.ArgumentParser(description="Serve a store of corpora.")
    p.add_argument("--root", required=True)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8080)
    a = p.parse_args()
    serve(App(build(), a.root), a.host, a.port).serve_forever()


if __name__ == "__main__":
    main()
