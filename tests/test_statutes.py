"""Glyphs, parsing, chunking, checks, loading, sources and answers on small documents."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import chunking, glyphs, loading, parsing, qa, validation
from lexspark.plans import base, catalog
from lexspark.sources import files, render, schemas

PAGES = [
    ("kp", 1, "preamble\nDZIAŁ I\nPrzepisy ogólne\nRozdział I\nUmowa\nArt. 1. § 1. Alpha text that is long enough. § 2. Beta text."),
    ("kp", 2, "goes on here.\nArt. 9^1. (uchylony)^5)\n[Art. 18^[3d]. Bracketed body of enough length.]\n<Art. 20. Future law>\nstill future"),
    ("kp", 3, "DZIAŁ II\nArt. 25. Body under a heading without a title.\nOddział 1\nLast\nArt. 26. (uchylony) but not only that, so it lives."),
]


@pytest.fixture(scope="module")
def parsed(spark):
    now, future = parsing.articles(spark.createDataFrame(PAGES, schemas.PAGE_TEXT))
    return {r.article: r for r in now.collect()}, [r.article for r in future.collect()]


def test_articles_and_future_law(parsed):
    now, future = parsed
    assert list(now) == ["1", "9^1", "18^3d", "25", "26"] and future == ["20"]
    assert now["9^1"].article_display == "Art. 9¹" and now["9^1"].repealed and now["9^1"].repeal_kind == "uchylony"
    assert not now["26"].repealed and now["18^3d"].text == "Bracketed body of enough length."
    assert now["1"].page_start == 1 and now["1"].text.endswith("Beta text. goes on here.")


def test_title_paths(parsed):
    now, _ = parsed
    assert now["1"].title_path == ["DZIAŁ I — Przepisy ogólne", "Rozdział I — Umowa"]
    assert now["25"].title_path == ["DZIAŁ II"] and now["26"].title_path == ["DZIAŁ II", "Oddział 1 — Last"]


def test_paragraphs(parsed):
    now, _ = parsed
    assert [(p.marker, p.text) for p in now["1"].paragraphs] == [("1", "Alpha text that is long enough."), ("2", "Beta text. goes on here.")]
    assert [(p.marker, p.repealed) for p in now["9^1"].paragraphs] == [("", True)]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("151¹", "151^1"), ("Art. 18-3a", "18^3a"), ("151(1)", "151^1"), ("art 9", "9"), ("Art. 67¹⁸", "67^18"), ("Art. 151 ^1", "151^1"), (" 25 ", "25")],
)
def test_normalise(spark, raw, want):
    assert spark.range(1).select(X.normalise_article(F.lit(raw))).first()[0] == want


def test_statutory_order(spark):
    ids = ["10", "9^1", "9", "94^10", "94^9", "151^10", "151^9b"]
    rows = spark.createDataFrame([(i,) for i in ids], "a string").orderBy(X.sort_key(F.col("a")))
    assert [r.a for r in rows.collect()] == ["9", "9^1", "10", "94^9", "94^10", "151^9b", "151^10"]


def article(spark, paragraphs, text="x"):
    rows = [("kp", 1, "7", "Art. 7", ["DZIAŁ I"], [(m, t, False) for m, t in paragraphs], False, "", 1, text)]
    kind = "act string, segment long, article string, article_display string, title_path array<string>, paragraphs array<struct<marker:string,text:string,repealed:boolean>>, repealed boolean, repeal_kind string, page_start int, text string"
    return spark.createDataFrame(rows, kind)


def made(spark, paragraphs, budget, **kw):
    return chunking.chunks(article(spark, paragraphs, **kw), budget=budget).orderBy("part_index").collect()


def test_whole_article_is_one_chunk(spark):
    (one,) = made(spark, [("1", "alpha beta"), ("2", "gamma")], 480)
    assert one.content == "Art. 7. § 1. alpha beta § 2. gamma" and one.paragraph == ""
    (single,) = made(spark, [("1", "alpha beta")], 480)
    assert single.paragraph == "1" and single.content == "Art. 7 § 1. alpha beta"
    (bare,) = made(spark, [], 480, text="(uchylony)")
    assert bare.content == "Art. 7. (uchylony)"


@pytest.mark.parametrize("budget", [80, 150, 200])
def test_packing_keeps_all_words_within_budget(spark, budget):
    paragraphs = [(str(i), " ".join(f"w{i}x{j}" for j in range(60))) for i in range(7)]
    out = made(spark, paragraphs, budget)
    assert [r.part_index for r in out] == list(range(len(out)))
    words = " ".join(r.content for r in out).split()
    assert all(f"w{i}x{j}" in words for i in range(7) for j in range(60))
    assert len(out) > 1


def test_oversized_paragraph_splits_at_sentences(spark):
    text = " ".join(f"s{i} one two three four five six seven eight nine." for i in range(60))
    out = made(spark, [("1", text)], 100)
    assert len(out) > 5 and all(r.paragraph == "1" and r.content.endswith("nine.") for r in out)
    whole = " ".join("w" for _ in range(500))
    assert len(made(spark, [("1", whole)], 100)) == 1


def test_model_limit(spark):
    rows = spark.createDataFrame([("kp", "1", "", 0, ["a"], "w " * 600)], "act string, article string, paragraph string, part_index int, title_path array<string>, content string")
    with pytest.raises(ValueError, match="1 § "):
        chunking.within_limit(rows)


def test_validation_finds_each_problem(spark, parsed):
    good, _ = parsing.articles(spark.createDataFrame(PAGES, schemas.PAGE_TEXT))
    found = {r.problem: r.named for r in validation.problems(good, {"kp": (1, 10)}).collect()}
    assert found == {}
    assert validation.validate(good, {"kp": (1, 10)}).first().articles == 5
    bad = good.unionByName(good.withColumn("segment", F.col("segment") + 10)).withColumn("title_path", F.array().cast("array<string>"))
    bad = bad.withColumn("text", F.concat("text", F.lit(" see Art. 5. lost")))
    problems = {r.problem for r in validation.problems(bad, {"kp": (430, 530)}).collect()}
    assert problems == {"duplicate ids", "out of order", "count outside band", "no structural path", "swallowed heading"}
    with pytest.raises(validation.ValidationError):
        validation.validate(bad)
    with pytest.raises(validation.ValidationError):
        validation.validate(good.where(F.lit(False)))


def glyph_rows(text, line=0, page=1, start=0.0):
    rows, x = [], start
    for i, c in enumerate(text):
        if c == " ":
            x += 6
            continue
        small = c in "¹²"
        rows.append((page, line, i, {"¹": "1", "²": "2"}.get(c, c), 8.0 if small else 12.0, x, x + 6, 94.0 if small else 100.0))
        x += 6
    return rows


def test_glyphs_to_text(spark):
    rows = glyph_rows("Art. 9¹² next") + glyph_rows("© Kancelaria Sejmu s. 1/2", 1) + glyph_rows("2024-01-02", 2) + [(1, 3, 0, "m", 8.0, 900.0, 906.0, 100.0)]
    out = glyphs.extract(spark.createDataFrame(rows, schemas.GLYPH)).collect()
    assert [(r.number, r.text) for r in out] == [(1, "Art. 9^12 next")]
    with pytest.raises(Exception, match="scanned"):
        glyphs.body_size(spark.createDataFrame([], schemas.GLYPH)).collect()


def test_raised_digits_may_be_the_most_of_a_line(spark):
    rows = glyph_rows("Art. 9 and so on") + glyph_rows("a ¹²¹²¹", 1)
    out = glyphs.extract(spark.createDataFrame(rows, schemas.GLYPH)).first()
    assert out.text == "Art. 9 and so on\na ^12121"


def test_documents_of_many_digits_as_glyphs(spark, tmp_path):
    text = "Sh. 4644348398010899\n123 456\n\nmuch the longest line of all of them, up to 77"
    rows = [(5_000_000_000, text, "en", "a", len(text)), (2, "7", "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("glyph_lines", "glyph_pages", "glyph_frames"):
        got, want = catalog.QUERIES[name](spark, str(tmp_path)), duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_glyphs_in_order_are_not_shuffled(spark, tmp_path, monkeypatch):
    texts = ["Art. 9 and 12\n\n7", "", "one line of some length 5 and more, 66", "x\ty \u00a0 z\n1 2 3"]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)] + [(9, None, "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(glyphs, "GLYPHS", 7)  # lines go on in later batches
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for make in (base.glyphs, base.framed_glyphs):
            given = make(spark, str(tmp_path))
            body = glyphs.body_size(given)
            kept = glyphs.without_margin(given, glyphs.right_edge(given, body))
            mixed = kept.repartition(5, "pos").orderBy(F.desc("x0"))
            got = [sorted(map(tuple, glyphs.lines(*x).collect())) for x in ((kept, body, True), (mixed, body))]
            assert got[0] == got[1] and got[0][0] == (0, 0, "Art. ^9 and ^12") and (3, 0, "x y z") in got[0] and len(got[0]) == 5
            plan = glyphs.lines(kept, body, True)._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(page" not in plan and "Window" not in plan
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_baselines_are_medians(spark):
    bottoms = [100.0, 101.0, 97.0, 104.0]
    rows = [(1, 0, i, c, 12.0, i * 6.0, i * 6.0 + 6, b) for i, (c, b) in enumerate(zip("abcd", bottoms, strict=True))]
    rows += [(1, 0, 4 + i, c, 8.0, 24.0 + i * 6, 30.0 + i * 6, 98.4 + i / 5) for i, c in enumerate("12")]  # 2.1 and 1.9 over 100.5
    rows += [(1, 1, i, c, 8.0, i * 6.0, i * 6.0 + 6, 90.0 + i * 3) for i, c in enumerate("xyz")]  # all small: of those with ink
    rows += [(2, 0, 0, None, 12.0, 0.0, 6.0, 100.0), (2, 0, 1, "k", 12.0, 30.0, 36.0, None)]
    out = glyphs.extract(spark.createDataFrame(rows[::-1], schemas.GLYPH)).collect()
    assert sorted((r.number, r.text) for r in out) == [(1, "abcd^12\n^xyz"), (2, "k")]


def chunk_rows(spark, rows):
    full = [(act, art, f"Art. {art}", "", part, ["p"], 1, False, "", content, 2) for act, art, part, content in rows]
    return spark.createDataFrame(full, schemas.CHUNK)


def test_load_upserts_prunes_and_keeps_ids(spark, tmp_path):
    path, encoder = str(tmp_path), loading.HashingEncoder(8)
    loading.load(spark, path, chunk_rows(spark, [("kp", "1", 0, "a"), ("kp", "1", 1, "b"), ("kc", "5", 0, "c")]), encoder, "v1")
    first = {(r.act, r.article, r.part_index): r.id for r in spark.read.parquet(f"{path}/v1/chunks").collect()}
    stats = loading.load(spark, path, chunk_rows(spark, [("kp", "1", 0, "A"), ("kp", "2", 0, "new")]), encoder, "v2", "v1").first()
    rows = {(r.act, r.article, r.part_index): r for r in spark.read.parquet(f"{path}/v2/chunks").collect()}
    assert set(rows) == {("kp", "1", 0), ("kp", "2", 0), ("kc", "5", 0)} and stats.chunks == 3 and stats.unembedded == 0
    assert rows["kp", "1", 0].id == first["kp", "1", 0] and rows["kp", "1", 0].content == "A"
    assert rows["kp", "2", 0].id > max(first.values()) and loading.current_version(spark, path) == "v2"


def test_stream_loads_each_batch(spark, tmp_path):
    from lexspark.streaming.incremental import incremental_load

    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("kp", "1", 0, "a")], [("kp", "2", 0, "b"), ("kp", "1", 0, "A")]):
        chunk_rows(spark, rows).write.mode("append").json(source)
        incremental_load(spark, source, path, loading.HashingEncoder(8), str(tmp_path / "cp")).awaitTermination(120)
    out = spark.read.parquet(f"{path}/{loading.current_version(spark, path)}/chunks")
    assert {(r.article, r.content) for r in out.collect()} == {("1", "A"), ("2", "b")}


def test_manifest_gold_and_history(spark, tmp_path):
    import json

    acts = [{"slug": s, "eli": f"DU/{s}", "variant": "U", "sha256": None, "notes": []} for s in ("kp", "kc")]
    (tmp_path / "m.json").write_text(json.dumps({"$comment": "c", "acts": acts}, indent=2))
    read = files.read_manifest(spark, str(tmp_path / "m.json"))
    import hashlib

    blob = json.dumps([{k: a[k] for k in ("eli", "sha256", "slug", "variant")} for a in sorted(acts, key=lambda a: a["slug"])], separators=(",", ":"))
    assert files.manifest_digest(read).first().digest == hashlib.sha256(blob.encode()).hexdigest()
    assert files.act_by_slug(read, "kp").first().eli == "DU/kp"
    with pytest.raises(KeyError, match="kc, kp"):
        files.act_by_slug(read, "xx")
    assert files.read_gold(spark, str(tmp_path / "none")).count() == 0
    assert files.read_history(spark, str(tmp_path / "h")).count() == 0


def test_verify_or_pin(spark):
    acts = spark.createDataFrame([("a", "a.pdf", None), ("b", "b.pdf", "x"), ("c", "c.pdf", "x"), ("d", "d.pdf", "x")], "slug string, file_name string, sha256 string")
    found = spark.createDataFrame([("a.pdf", "n"), ("b.pdf", "x"), ("c.pdf", "y")], "file_name string, digest string")
    got = {r.slug: (r.status, r.sha256) for r in files.verify_or_pin(acts, found).collect()}
    assert got == {"a": ("pinned", "n"), "b": ("matches", "x"), "c": ("mismatch", "x"), "d": ("missing", "x")}
    assert {r.slug: r.status for r in files.verify_or_pin(acts, found, repin=True).collect()}["c"] == "repinned"
    with pytest.raises(ValueError):
        files.require_verified(files.verify_or_pin(acts, found))


def test_history_and_tables(spark, tmp_path):
    path = str(tmp_path / "h")
    context = dict.fromkeys(schemas.struct(schemas.CONTEXT).names, "x") | {"api_cost_usd": 0.0, "duration_s": 4.8}
    for n in range(2):
        metrics = dict.fromkeys(schemas.struct(schemas.METRICS).names) | {"layer": "retrieval", "n_questions": 97, "recall_at_k": {"3": 0.5 + n / 10}, "mrr": 0.7}
        run = spark.createDataFrame([{"context": context, "metrics": metrics}], schemas.history(with_seq=False))
        files.append_run(spark, run, path)
    rows = files.read_history(spark, path).orderBy("run_seq").collect()
    assert [r.run_seq for r in rows] == [0, 1]
    flat = files.flat_metrics(files.read_history(spark, path)).orderBy("run_seq").collect()
    assert flat[1].metrics == {"recall@3": 0.6}
    document = "a\n<!-- METRICS:LAYER1:START -->\nold\n<!-- METRICS:LAYER1:END -->\n<!-- METRICS:LAYER2:START -->\n\n<!-- METRICS:LAYER2:END -->\n"
    out = render.render(document, rows[1], None)
    assert "| 60.0% | — | — |" in out and render.render(out, rows[1], None) == out and render.is_current(out, rows[1], None)
    with pytest.raises(ValueError):
        render.splice("no markers", "LAYER1", "x")


def test_answers_and_refusals(spark):
    questions = qa.understand(spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "nothing of the sort")], "qid int, question string"))
    hits = [(1, 1, "kp", "1", "Art. 1", "2^1", ["p"], True, "alpha beta gamma"), (1, 2, "kp", "2", "Art. 2", "", [], False, "else"), (2, 1, "kp", "1", "Art. 1", "", [], False, "unrelated")]
    kind = "qid int, rank int, act string, article string, article_display string, paragraph string, title_path array<string>, repealed boolean, content string"
    models = qa.Models(cited=lambda graded: F.array(F.struct(F.lit("kp").alias("act"), F.lit("1").alias("article")), F.struct(F.lit("kp").alias("act"), F.lit("99").alias("article"))))
    out = {r.qid: r for r in qa.ask(questions, spark.createDataFrame(hits, kind), models).collect()}
    assert not out[1].refused and out[1].answer == "Art. 1 § 21 [p] [PRZEPIS UCHYLONY]\nalpha beta gamma" and out[1].considered == 2
    assert [c.article for c in out[1].citations] == ["1"] and [c.article for c in out[1].unsupported_citations] == ["99"]
    assert out[2].refused and out[2].refusal_reason == "no relevant passage" and out[2].citations == []
    graded = qa.grade(spark.createDataFrame(hits, kind).join(questions, "qid"))
    assert {r.qid: r.route for r in qa.route(questions, graded).collect()} == {1: "answer", 2: "refuse"}


def test_gold_checks(spark):
    chunks = spark.createDataFrame([("kp", "1", False), ("kp", "2", True)], "act string, article string, repealed boolean")
    gold = spark.createDataFrame([("q1", "kp", ["1", "3"], ""), ("q1", "kp", ["2"], ""), ("q2", "xx", ["1"], ""), ("q3", "kp", ["2"], "repealed, on purpose")], "qid string, act string, ground_truth_articles array<string>, notes string")
    got = {(r.problem, r.qid, r.article) for r in validation.gold_problems(gold, chunks).collect()}
    assert got == {("duplicate id", "q1", None), ("not in the corpus", "q1", "3"), ("repealed without a note", "q1", "2"), ("act without chunks", "q2", "xx")}
    assert {r.problem for r in validation.gold_problems(gold.where(F.lit(False)), chunks).collect()} == {"empty set"}


def test_white_space_of_any_kind_in_citations(spark):
    cases = [("Art.\u00a09¹", "9^1"), ("\u00a0Art. 9\u2009(1)\u00a0", "9^1"), ("art 18-3a", "18^3a"), (" 151 ", "151")]
    df = spark.createDataFrame([(raw,) for raw, _ in cases], "raw string")
    assert [r[0] for r in df.select(X.normalise_article(F.col("raw"))).collect()] == [want for _, want in cases]


def test_constraints_of_runs(spark):
    context = dict.fromkeys(schemas.struct(schemas.CONTEXT).names, "x") | {"api_cost_usd": 0.0, "duration_s": 1.0}
    none = dict.fromkeys(schemas.struct(schemas.METRICS).names)
    good = [none | {"layer": "retrieval", "n_questions": 1, "recall_at_k": {"3": 0.5}}, none | {"layer": "audit", "n_contracts": 1, "n_planted_violations": 0, "precision": 1.0, "recall": 0.0, "f1": 0.0}]
    bad = [none | {"layer": "other"}, none | {"layer": "retrieval", "n_questions": 0, "mrr": 1.5}, none | {"layer": "audit", "precision": -0.1, "recall": 0.5}]
    runs = [{"context": context | {"timestamp": str(i)}, "metrics": m} for i, m in enumerate(good + bad)]
    runs.append({"context": context | {"timestamp": "c", "api_cost_usd": -1.0}, "metrics": good[0]})
    got = {}
    for r in validation.run_problems(spark.createDataFrame(runs, schemas.history(with_seq=False))).collect():
        got.setdefault(r.run, set()).add(r.problem)
    assert got == {"2": {"layer"}, "3": {"n_questions", "recall_at_k", "mrr"}, "4": {"n_contracts", "n_planted_violations", "precision", "f1"}, "c": {"api_cost_usd"}}


def test_audit_tables_and_markers():
    from pyspark.sql import Row

    run = Row(context=Row(**dict.fromkeys(schemas.struct(schemas.CONTEXT).names, "abcdefghij") | {"api_cost_usd": 0.5, "duration_s": 2.0, "embedding_revision": None}), metrics=Row(**dict.fromkeys(schemas.struct(schemas.METRICS).names) | {"layer": "audit", "n_contracts": 3, "n_planted_violations": 4, "precision": 0.5, "recall": 0.25, "f1": 1 / 3, "per_violation_type": {"b": 0.1, "a": 0.2}}))
    document = "x\n<!-- METRICS:LAYER1:START -->\n<!-- METRICS:LAYER1:END -->\ny <!-- METRICS:LAYER2:START -->old<!-- METRICS:LAYER2:END --> z"
    out = render.render(document, None, run)
    assert "| **Overall** | 0.333 |\n| a | 0.200 |\n| b | 0.100 |" in out and "Precision **50.0%**" in out and "abcdefgh`" in out and "@unpinned" in out
    assert out.startswith("x\n") and out.endswith(" z") and render.NOTHING in out and render.render(out, None, run) == out
    for broken in ("<!-- METRICS:LAYER1:END --><!-- METRICS:LAYER1:START -->", "<!-- METRICS:LAYER1:START -->"):
        with pytest.raises(ValueError):
            render.splice(broken, "LAYER1", "b")


def test_streams_over_one_table(spark, tmp_path):
    from lexspark.streaming.incremental import incremental_load

    source, path, encoder = str(tmp_path / "in"), str(tmp_path / "out"), loading.HashingEncoder(8)
    run = lambda mark: incremental_load(spark, source, path, encoder, str(tmp_path / mark)).awaitTermination(120)
    live = lambda: {(r.article, r.content) for r in spark.read.parquet(f"{path}/{loading.current_version(spark, path)}/chunks").collect()}
    loading.load(spark, path, chunk_rows(spark, [("kp", "9", 0, "old")]), encoder, "v1")
    chunk_rows(spark, [("kp", "1", 0, "a")]).write.json(source)
    run("one")
    assert live() == {("9", "old"), ("1", "a")} and len(loading.versions(spark, path)) == 2
    chunk_rows(spark, []).write.mode("append").json(source)
    run("one")
    assert live() == {("9", "old"), ("1", "a")}
    run("two")  # a new checkpoint takes all files again, on top of what there is
    assert live() == {("9", "old"), ("1", "a")} and loading.versions(spark, path)[0] == "v1"
    # A load that is stopped before its end leaves readers at the version before.
    last = loading.current_version(spark, path)
    with pytest.raises(ValueError):
        loading.load(spark, path, chunk_rows(spark, [("kp", "1", 0, "word " * 600)]), encoder, "bad", last)
    assert loading.current_version(spark, path) == last


def test_broken_constraints_stop_a_load(spark, tmp_path):
    path, encoder = str(tmp_path), loading.HashingEncoder(8)
    loading.load(spark, path, chunk_rows(spark, [("kp", "1", 0, "a")]), encoder, "v1")
    for rows, said in (
        ([("kp", "1", 0, "b"), ("kp", "1", 0, "c")], "key of several rows: 1"),
        ([("kp", "1", -1, "b")], "part_index below 0: 1"),
    ):
        with pytest.raises(validation.ValidationError, match=said):
            loading.load(spark, path, chunk_rows(spark, rows), encoder, "v2", "v1")
        assert loading.current_version(spark, path) == "v1"
    assert validation.table_problems(spark.read.parquet(f"{path}/v1/chunks"), loading.KEY).count() == 0
    broken = chunk_rows(spark, [("kp", None, 0, "b"), (None, "1", 0, None)])
    assert {(r.problem, r.n) for r in validation.table_problems(broken, loading.KEY).collect()} == {("article is null", 1), ("act is null", 1), ("content is null", 1)}
