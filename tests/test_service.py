"""Build, load, search, ask and evaluate over one small corpus."""

import hashlib
import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexspark import __main__ as cli
from lexspark.functions.settings import Settings
from lexspark.operators import evaluation, indexing, loading, qa, validation
from lexspark.operators.models import Reply
from lexspark.operators.validation import ValidationError
from lexspark.plans import service
from lexspark.plans.server import server
from lexspark.sources import files, schemas

TEXT = "DZIAŁ I\nOgólne\nArt. 1. Notice periods depend on the time worked for the employer.\nArt. 2. Holiday pay is due for each year of work done.\nArt. 3. (uchylony)"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table"))
    report, chunks, future = service.build(spark.createDataFrame([("kp", 1, TEXT)], schemas.PAGE_TEXT), {"kp": (1, 5)})
    assert report.first().articles == 3 and future.count() == 0
    loading.load(spark, path, chunks, loading.HashingEncoder(16), "v1")
    return path


def test_health_search_and_ask(spark, path):
    encoder = loading.HashingEncoder(16)
    assert service.health(spark, path) == {"version": "v1", "chunks": 3, "articles": 3, "unembedded": 0, "repealed": 1}
    asked = spark.createDataFrame([(1, "holiday pay for a year"), (2, "zebra quagga")], "qid int, question string")
    found = service.find(spark, path, asked, encoder).where("qid = 1").orderBy("rank").collect()
    assert found[0].article == "2" and all(r.article != "3" for r in found)
    out = {r.qid: r for r in service.ask(spark, path, asked, encoder).collect()}
    assert not out[1].refused and out[1].citations[0].article == "2" and out[1].search_query == "holiday pay for a year"
    assert out[2].refused
    with pytest.raises(service.Invalid):
        service.ask(spark, path, spark.createDataFrame([(1, "ab")], "qid int, question string"), encoder)


def test_evaluate_and_record(spark, path, tmp_path):
    gold = spark.createDataFrame([("g1", "what are the notice periods", "kp", ["1"]), ("g2", "holiday pay", "kp", ["2", "3"])], "id string, question string, act string, ground_truth_articles array<string>")
    scores, missed = service.evaluate(spark, path, gold, loading.HashingEncoder(16))
    s = scores.first()
    assert s.n_questions == 2 and s.hit_rate_5 == 1.0 and s.recall_at_10 == 0.75 and missed.count() == 0
    context = dict.fromkeys(schemas.struct(schemas.CONTEXT).names, "x") | {"api_cost_usd": 0.0, "duration_s": 1.0}
    files.append_run(spark, evaluation.history_row(spark, s, [], context), str(tmp_path / "h"))
    back = files.flat_metrics(files.read_history(spark, str(tmp_path / "h"))).first()
    assert back.metrics["recall@10"] == 0.75
    assert all(r.passed for r in evaluation.gate(evaluation.tracked(files.flat_metrics(files.read_history(spark, str(tmp_path / "h"))))).collect())
    assert isinstance(s, Row)


def test_settings_have_bounds():
    a = Settings()
    assert len(a.retrieval_config_hash()) == 12 and a.retrieval_config_hash() != Settings(bm25_b=0.5).retrieval_config_hash()
    assert a.retrieval_config_hash() == Settings(eval_max_cost_usd=1.0).retrieval_config_hash()
    for bad in ({"bm25_k1": -1}, {"bm25_b": 1.5}, {"hybrid_alpha": -0.1}, {"fusion": "sum"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def scripted(name):
    class Scripted:
        """A model whose replies follow from its prompts; those with `broken` in them do not come out as asked."""

        def __init__(self, name):
            self.name = name

        def reply(self, system, prompts):
            out = []
            for p in prompts:
                if "broken" in p and system == qa.ANSWER:
                    out.append(Reply(None, self.name, 100, 7))
                elif system == qa.REWRITE:
                    out.append(Reply({"query": " " if "zebra" in p else p.split("\n")[-1] + " holiday"}, self.name, 10, 2))
                elif system == qa.GRADE:
                    out.append(Reply({"relevant": "Holiday pay" in p and "zebra" not in p, "reason": "said so"}, self.name, 20, 3))
                else:
                    out.append(Reply({"answer": "It is due.", "citations": [{"act": "kp", "article": "2"}, {"act": "kp", "article": "77"}]}, self.name, 100, 7))
            return out

    return Scripted(name)


@pytest.fixture(scope="module")
def prices(spark):
    return spark.createDataFrame([("cheap", 1.0, 5.0), ("strong", 3.0, 15.0)], "model string, rate_in double, rate_out double")


def test_models_with_usage(spark, path, prices):
    encoder = loading.HashingEncoder(16)
    asked = spark.createDataFrame([(1, "pay for a year"), (2, "zebra quagga"), (3, "broken pay")], "qid long, question string")
    answers, usage = service.ask_models(spark, path, asked, encoder, scripted("cheap"), scripted("strong"))
    out = {r.qid: r for r in answers.collect()}
    assert out[1].answer == "It is due." and out[1].search_query == "pay for a year holiday"
    assert [c.article for c in out[1].citations] == ["2"] and [c.article for c in out[1].unsupported_citations] == ["77"]
    assert out[2].refused and out[2].refusal_reason == "no relevant passage" and out[2].search_query == "zebra quagga"
    assert out[3].refused and out[3].refusal_reason == qa.REFUSAL_REASON
    calls = {(r.qid, r.model): r.n for r in usage.groupBy("qid", "model").count().withColumnRenamed("count", "n").collect()}
    assert calls == {(1, "cheap"): 1 + out[1].considered, (1, "strong"): 1, (2, "cheap"): 1 + out[2].considered, (3, "cheap"): 1 + out[3].considered, (3, "strong"): 1}
    said = {r.qid: json.loads(r.response) for r in service.responses(answers, usage, prices).collect()}
    assert said[2]["answer"] == qa.REFUSAL and said[1]["disclaimer"] == qa.DISCLAIMER and said[1]["grounded_in"] == 1
    n = out[1].considered
    assert said[1]["cost_usd"] == pytest.approx((10 + 20 * n + 5 * (2 + 3 * n) + 300 + 105) / 1e6, abs=2e-6)


def _get(url, body=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, None if body is None else body.encode())) as got:
            return got.status, json.loads(got.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_server(spark, path, prices):
    encoder = loading.HashingEncoder(16)
    for models, status in (((), 503), ((scripted("cheap"), scripted("strong"), prices), 200)):
        running = server(spark, path, encoder, *models)
        threading.Thread(target=running.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{running.server_port}"
        assert _get(at + "/health")[1]["status"] == "ok" and _get(at + "/")[1]["disclaimer"] == qa.DISCLAIMER and _get(at + "/x")[0] == 404
        code, said = _get(at + "/ask", json.dumps({"question": "pay for a year"}))
        assert code == status
        if status == 200:
            assert said["answer"] == "It is due." and not said["refused"] and said["cost_usd"] > 0
            assert _get(at + "/ask", json.dumps({"question": "zebra quagga"}))[1]["refused"]
            assert {_get(at + "/ask", b)[0] for b in ('{"question": "ab"}', "{}", "no json", '{"question": 5}')} == {422}
        running.shutdown()
        running.server_close()


def test_load_checks_every_vector(spark, tmp_path):
    class Odd(loading.HashingEncoder):
        def encode(self, texts):
            return np.zeros((len(texts), self.dim + 1), np.float32)

    _, chunks, _ = service.build(spark.createDataFrame([("kp", 1, TEXT)], schemas.PAGE_TEXT), {"kp": (1, 5)})
    with pytest.raises(ValidationError):
        loading.load(spark, str(tmp_path / "t"), chunks, Odd(8), "v1")
    assert not (tmp_path / "t" / "current").exists()


def test_fetch_all_downloads_and_pins(spark, tmp_path):
    (tmp_path / "there").mkdir()
    (tmp_path / "there" / "a.pdf").write_bytes(b"law")
    empty = dict.fromkeys(schemas.struct(schemas.ACT).names)
    acts = spark.createDataFrame([empty | {"slug": "a", "file_name": "a.pdf", "url": (tmp_path / "there" / "a.pdf").as_uri()}], schemas.ACT)
    (r,) = service.fetch_all(acts, str(tmp_path / "here")).collect()
    assert (r.status, r.bytes, r.sha256) == ("pinned", 3, hashlib.sha256(b"law").hexdigest())
    with pytest.raises(ValueError):
        service.fetch_all(acts.withColumn("sha256", F.lit("00")), str(tmp_path / "here"))
    assert service.fetch_all(acts.withColumn("sha256", F.lit("00")), str(tmp_path / "here"), repin=True).first().status == "repinned"


def test_fetch_asks_again_only_for_what_is_missing(spark, tmp_path):
    asked = []

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            name = self.path[1:]
            if name == "moved.pdf":
                self.send_response(302)
                self.send_header("Location", "/a.pdf")
                self.end_headers()
                return
            fails = name == "gone.pdf" or name == "slow.pdf" and asked.count(self.path) < 3
            self.send_response((404 if name == "gone.pdf" else 503) if fails else 200)
            self.end_headers()
            if not fails:
                self.wfile.write(name.encode() * 3)

        def log_message(self, *_):
            pass

    site = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    try:
        empty = dict.fromkeys(schemas.struct(schemas.ACT).names)
        root, folder = f"http://127.0.0.1:{site.server_port}", str(tmp_path / "fetched")
        make = lambda *names: spark.createDataFrame([empty | {"slug": n, "file_name": n, "url": f"{root}/{n}"} for n in names], schemas.ACT)
        with pytest.raises(OSError, match="HTTP 404"):
            service.fetch_all(make("a.pdf", "slow.pdf", "moved.pdf", "gone.pdf"), folder)
        assert sorted(asked) == ["/a.pdf", "/a.pdf", "/gone.pdf", "/moved.pdf", "/slow.pdf", "/slow.pdf", "/slow.pdf"]
        got = {r.slug: (r.status, r.bytes) for r in service.fetch_all(make("a.pdf", "slow.pdf", "moved.pdf"), folder).collect()}
        assert got == {"a.pdf": ("pinned", 15), "slow.pdf": ("pinned", 24), "moved.pdf": ("pinned", 15)} and len(asked) == 7
        service.fetch_all(make("a.pdf"), folder, repin=True).collect()
        assert len(asked) == 8
        kept = files.read_kept(spark, folder)
        assert sorted((r.file_name, bytes(r.content)) for r in kept.collect()) == [("a.pdf", b"a.pdf" * 3), ("moved.pdf", b"a.pdf" * 3), ("slow.pdf", b"slow.pdf" * 3)]
    finally:
        site.shutdown()


def test_build_is_a_dry_run_unless_told_to_load(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setitem(validation.EXPECTED, "kp", (1, 5))
    spark.createDataFrame([("kp", 1, TEXT)], schemas.PAGE_TEXT).write.parquet(str(tmp_path / "pages"))
    command = ["build", str(tmp_path / "t"), "--pages", str(tmp_path / "pages")]
    cli.main(command)
    assert "dry run" in capsys.readouterr().out and not (tmp_path / "t").exists()
    cli.main([*command, "--load", "v1"])
    assert service.health(spark, str(tmp_path / "t"))["chunks"] == 3


def test_stop_words_and_lemmas_meet_in_index_and_question(spark, tmp_path):
    lemmas = spark.createDataFrame([("notices", "notice"), ("periods", "period"), ("days", "day"), ("days", "daze")], "token string, lemma string")
    analyser = indexing.Analyser(("on", "the"), lemmas)
    _, chunks, _ = service.build(spark.createDataFrame([("kp", 1, TEXT)], schemas.PAGE_TEXT), {"kp": (1, 5)})
    path = str(tmp_path / "t")
    loading.load(spark, path, chunks, loading.HashingEncoder(8), "v1", analyser=analyser)
    index, _ = indexing.read_index(spark, path, "v1")
    found = {r.lexeme for r in index.select("lexeme").distinct().collect()}
    assert "period" in found and not found & {"periods", "the", "on"}
    asked = spark.createDataFrame([(1, "the period"), (2, "the on")], "qid long, question string")
    assert {(r.qid, r.article) for r in service.find(spark, path, asked, loading.HashingEncoder(8), leg="lexical", analyser=analyser).collect()} == {(1, "1")}
    with pytest.raises(ValidationError):
        indexing.Analyser((), lemmas.drop("lemma"))


def test_cells_repeals_and_texts_of_the_caller(spark, tmp_path):
    path, encoder = str(tmp_path), loading.HashingEncoder(16)
    _, chunks, _ = service.build(spark.createDataFrame([("kp", 1, TEXT)], schemas.PAGE_TEXT), {"kp": (1, 5)})
    loading.load(spark, path, chunks, encoder, "v1", cells=2)
    asked = spark.createDataFrame([(1, "holiday pay for a year")], "qid int, question string")
    few = service.find(spark, path, asked, encoder, Settings(vector_probes=2), "dense").orderBy("rank").collect()
    assert few == service.find(spark, path, asked, encoder, leg="dense").orderBy("rank").collect() and len(few) == 2
    every = service.find(spark, path, asked, encoder, leg="dense", include_repealed=True)
    assert every.count() == 3 and every.where("repealed").count() == 1
    assert Settings().retrieval_config_hash() != Settings(vector_probes=2).retrieval_config_hash()
    found = service.ask(spark, path, spark.createDataFrame([(1, "zebra quagga")], "qid int, question string"), encoder)
    none = spark.createDataFrame([], "qid int, model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 1.0, 1.0)], "model string, rate_in double, rate_out double")
    said = json.loads(service.responses(found, none, prices, "no law", "no advice").first().response)
    assert said["answer"] == "no law" and said["disclaimer"] == "no advice"
