"""The verbs over HTTP: GET / and /health, POST /ask."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from lexspark import __version__
from lexspark.operators import qa
from lexspark.operators.loading import Encoder
from lexspark.operators.models import Model
from lexspark.plans import service


def server(
    spark: SparkSession, path: str, encoder: Encoder, cheap: Model | None = None, strong: Model | None = None, prices: DataFrame | None = None, port: int = 0
) -> ThreadingHTTPServer:
    """A server over the table at `path`; `serve_forever` runs it. A refusal is an answer (200); a question
    out of bounds or no JSON is 422, a server without models 503, another path 404."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            known = {"/": {"name": "lexspark", "version": __version__, "disclaimer": qa.DISCLAIMER}, "/health": {"status": "ok", "version": __version__}}
            self._send(200, known[self.path]) if self.path in known else self._send(404, {"detail": "no such path"})

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/ask":
                self._send(404, {"detail": "no such path"})
                return
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if cheap is None or strong is None or prices is None:
                self._send(503, {"detail": "no models are configured"})
                return
            try:
                question = json.loads(body)["question"]
                if not isinstance(question, str):
                    raise ValueError("question must be a text")
                asked = spark.createDataFrame([(0, question)], "qid long, question string")
                answers, usage = service.ask_models(spark, path, asked, encoder, cheap, strong)
                self._send(200, json.loads(service.responses(answers, usage, prices).first().response))
            except (ValueError, KeyError, TypeError) as e:
                self._send(422, {"detail": str(e)})

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
