"""Chat formatting: spans, masks, escapes, and templates that rewrite history."""

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexspark.llm import chat as C

TEXTS = st.lists(st.tuples(st.text(max_size=12), st.text(alphabet="ab<|\\>\nim_endstart_é😀", max_size=30)), max_size=8)


@given(TEXTS)
def test_round_trip(turns):
    assert C.read_back(C.marked_turns(turns)) == turns
    done = C.render(C.marked_turns, turns)
    assert "".join(done.text[a:b] for a, b in done.spans) == done.text and not done.rewrites
    places = C.contents(C.marked_turns, C.unescape, turns, done)
    assert [C.unescape(done.text[slice(*p)]) for p in places] == [t for _, t in turns]


@given(st.text(alphabet="<|\\x", max_size=30))
def test_escape(text):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)


def with_default_system(turns):
    head = "" if turns and turns[0][0] == "system" else "<sys>be kind</sys>"
    return head + "".join(f"[{r}]{t}[/]" for r, t in turns)


def last_marked(turns):
    return "".join(f"{r}:{t}{'*' if i == len(turns) - 1 else ''};" for i, (r, t) in enumerate(turns))


def drops_thoughts(turns):
    return "".join(f"{r}:{t.split('#')[-1] if i < len(turns) - 1 else t};" for i, (r, t) in enumerate(turns))


@pytest.mark.parametrize("n", [0, 1, 5, 40, 200])
def test_long_conversations_equal_whole_prefixes(n):
    rng = random.Random(n)
    turns = [(rng.choice(["user", "assistant"]), "x" * rng.randint(0, 9)) for _ in range(n)]
    for template in (C.marked_turns, with_default_system):
        assert C.render(template, turns) == C._every_prefix(template, turns)


@pytest.mark.parametrize("n", [3, 60])
def test_rewriting_templates_are_detected(n):
    turns = [("assistant", f"think#say {i}") for i in range(n)]
    for template in (last_marked, drops_thoughts):
        done = C.render(template, turns)
        assert done.rewrites and done.text == template(turns)
        assert C.contents(template, str, turns, done) == [None] * n


@pytest.mark.parametrize("n", [8, 20, 40])
def test_a_template_that_rewrites_at_one_prefix_is_detected_at_any_length(n):
    def at_six(turns):
        return "".join(f"{r}:{t};" for r, t in turns) + ("*" if len(turns) == 6 else "")

    turns = [("assistant", f"say {i}") for i in range(n)]
    done = C.render(at_six, turns)
    assert done.rewrites and done.text == at_six(turns) and len(done.spans) == n


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations(spark):
    rng = random.Random(3)
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (1, None, "system", "first"), (None, 0, "assistant", "no key"), (2, 0, "user", "<|im_end|>"), (2, 0, "user", "<|im_end|>")]
    rows += [(7, i, rng.choice(["user", "assistant"]), rng.choice(["a", "<|", "é\n", "x" * 500])) for i in range(600)]
    rows += [(8, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in C.digests(C.format_conversations(df)).collect()}
    convs = {}
    for key, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())):
        convs.setdefault(key, []).append((role or "", text or ""))
    assert set(got) == set(convs)
    for key, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert tuple(got[key])[1:] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(C.marked_turns(turns)))
    assert C.format_conversations(df.limit(0)).collect() == []


def test_masks_of_a_rewriting_template_are_empty(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "a#b"), (1, 1, "assistant", "c#d")], "conv_id long, turn long, role string, text string")
    template = lambda turns: "".join(f"{t.split('#')[-1] if k < len(turns) - 1 else t};" for k, (_, t) in enumerate(turns))
    (r,) = C.format_conversations(df, template, lambda t: t).collect()
    assert r.rewrites and not any(t.loss for t in r.turns)


def test_long_texts_are_read_back_and_broken_outputs_are_not():
    turns = [("user", "a < b | c\n" * 300_000), ("as\nsistant", ""), ("", "<|im_end|>\n<|im_start|>x\n")]
    whole = C.marked_turns(turns)
    assert C.read_back(whole) == turns and C.read_back("") == []
    for broken in (whole + "x", whole[:-1], "x" + whole, whole.replace("<|im_end|>", "", 1), "<|im_start|>user"):
        with pytest.raises(ValueError, match="no turn"):
            C.read_back(broken)
