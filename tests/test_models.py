"""Model calls that are kept: what was asked is not asked again."""

import json

import pytest

from lexspark.operators import models


def counting(folder):
    """A model that echoes prompts, writes down each, and fails on one word until a file says otherwise. Made here, so that it
    goes to the workers by value."""

    class Counting:
        def __init__(self, folder):
            self.folder = str(folder)

        def reply(self, system, prompts):
            import json
            import uuid
            from pathlib import Path

            from lexspark.operators.models import Reply

            folder, out = Path(self.folder), []
            for p in prompts:
                if "poison" in p and not (folder / "cured").exists():
                    raise RuntimeError("the model fell over")
                (folder / f"{uuid.uuid4().hex}.asked").write_text(json.dumps(p))
                times = sum(json.loads(f.read_text()) == p for f in folder.glob("*.asked"))
                good = not ("never" in p or ("late" in p and times < 2))
                out.append(Reply({"said": p.upper()} if good else None, "m", len(p), 1))
            return out

    return Counting(folder)


def asked(folder):
    return sorted(json.loads(f.read_text()) for f in folder.glob("*.asked"))


def ask(spark, prompts, folder, **options):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "qid int, p string")
    return models.resumed(rows, models.F.col("p"), counting(folder), "sys", "said string", "call", str(folder / "store"), slices=4, **options)


def said(df):
    return {r.qid: r.call.parsed.said if r.call.parsed else None for r in df.collect()}


def test_nothing_is_asked_twice(spark, tmp_path):
    assert said(ask(spark, ["a", "b", "a"], tmp_path)) == {0: "A", 1: "B", 2: "A"}
    assert asked(tmp_path) == ["a", "b"]
    assert said(ask(spark, ["b", "c"], tmp_path)) == {0: "B", 1: "C"} and asked(tmp_path) == ["a", "b", "c"]
    (use,) = models.usage_of(spark, str(tmp_path / "store")).collect()
    assert tuple(use) == ("m", 3, 3, 3)


def test_a_failure_keeps_what_was_written(spark, tmp_path):
    prompts = [f"p{i}" for i in range(12)] + ["poison"]
    with pytest.raises(Exception, match="fell over"):
        ask(spark, prompts, tmp_path).collect()
    kept = {r.prompt for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    (tmp_path / "cured").touch()
    before = asked(tmp_path)
    assert said(ask(spark, prompts, tmp_path)) == {i: p.upper() for i, p in enumerate(prompts)}
    after = asked(tmp_path)
    assert all(after.count(p) == before.count(p) for p in kept)


def test_bad_replies_are_asked_again_and_then_kept(spark, tmp_path):
    assert said(ask(spark, ["late", "never", "fine"], tmp_path)) == {0: "LATE", 1: None, 2: "FINE"}
    assert asked(tmp_path) == ["fine", "late", "late", "never", "never", "never"]
    assert said(ask(spark, ["late", "never", "fine"], tmp_path)) == {0: "LATE", 1: None, 2: "FINE"} and len(asked(tmp_path)) == 6
    (use,) = models.usage_of(spark, str(tmp_path / "store")).collect()
    assert use.calls == 6


def test_no_rows(spark, tmp_path):
    assert ask(spark, [], tmp_path).count() == 0 and asked(tmp_path) == []
