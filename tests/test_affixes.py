"""Affix rules against a plain applier, and what an index makes of the table."""

import random
import re

import pytest

from lexspark.operators import affixes, indexing

RULES = """# comment
SET UTF-8
SFX A Y 3
SFX A 0 s [^sy]
SFX A y ies [^aeiou]y
SFX A y ys [aeiou]y   # after a vowel
SFX B N 1
SFX B e ing/X e
PFX P Y 1
PFX P 0 nie .
PFX Q N 1
PFX Q w u w
SFX ż Y 2
SFX ż a ą a
SFX ż 0 mi .
"""
WORDS = """8
city/A
day/AP
make/BP
Praca/żP
was/Q
alone
both/ABPQ
y/A
"""


def parsed(text):
    rules, crossed = [], {}
    for line in text.splitlines():
        f = re.sub(r"^#.*|\s#.*$", "", line).split()
        if f[:1] in (["PFX"], ["SFX"]):
            if len(f) == 4 and f[2] in "YN":
                crossed[f[0], f[1]] = f[2] == "Y"
            else:
                rules.append((f[0], f[1], f[2].replace("0", ""), f[3].split("/")[0], f[4]))
    return [(*r[:2], crossed[r[:2]], *r[2:]) for r in rules]


def put(form, rule):
    kind, _, _, strip, add, condition = rule
    if len(form) <= len(strip):
        return None
    if kind == "SFX":
        fits = form.endswith(strip) and re.search(condition + "$", form)
        return form[: len(form) - len(strip)] + add if fits else None
    fits = form.startswith(strip) and re.search("^" + condition, form)
    return add + form[len(strip) :] if fits else None


def brute(words, rules):
    out = set()
    for word, flags in words:
        own = [r for r in rules if r[1] in flags]
        out.add((word, word))
        for r in own:
            made = put(word, r)
            if made is None:
                continue
            out.add((made, word))
            if r[0] == "SFX" and r[2]:
                out |= {(both, word) for p in own if p[0] == "PFX" and p[2] and (both := put(made, p)) is not None}
    return {(t, w) for t, w in out if t}


@pytest.fixture(scope="module")
def dictionary(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dictionary")
    (folder / "a.aff").write_text(RULES)
    (folder / "a.dic").write_text(WORDS)
    return affixes.read_dictionary(spark, f"{folder}/a.dic", f"{folder}/a.aff")


def test_files_against_a_plain_applier(dictionary):
    words = [(w.split("/")[0].lower(), w.partition("/")[2]) for w in WORDS.split()[1:]]
    got = {(r.token, r.lemma) for r in dictionary.collect()}
    assert got == brute(words, parsed(RULES))
    assert ("pracą", "praca") in got and ("niepracą", "praca") in got and ("uas", "was") in got and ("niemaking", "make") not in got


def test_random_rules_against_a_plain_applier(spark):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(0, n)))
    rules = [(rng.choice(["PFX", "SFX"]), rng.choice("ABCDE"), None, some(2), some(2), rng.choice([".", "[ab]", "[^a]", "b", "[^bc]a"])) for _ in range(40)]
    crossed = {(k, f): rng.random() < 0.6 for k in ("PFX", "SFX") for f in "ABCDE"}
    rules = [(k, f, crossed[k, f], *rest) for k, f, _, *rest in rules]
    words = [(some(5) or "a", "".join(sorted(set(rng.choices("ABCDEF", k=3))))) for _ in range(120)]
    table = affixes.expand(
        spark.createDataFrame([(w, list(f)) for w, f in words], "word string, flags array<string>"),
        spark.createDataFrame(rules, "kind string, flag string, crossed boolean, strip string, put string, condition string"),
    )
    got = [(r.token, r.lemma) for r in table.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(words, rules)


@pytest.mark.parametrize(("way", "line", "flags"), [("char", "ab/XY", ["X", "Y"]), ("long", "ab/XaYb", ["Xa", "Yb"]), ("num", "ab/12,3", ["12", "3"]), ("char", "ab", [])])
def test_ways_of_flags(spark, tmp_path, way, line, flags):
    (tmp_path / "w.dic").write_text(f"1\n{line}\n")
    (row,) = affixes.read_words(spark, f"{tmp_path}/w.dic", flag=way).collect()
    assert (row.word, row.flags) == ("ab", flags)


def test_unknown_way(spark, tmp_path):
    (tmp_path / "w.dic").write_text("ab\n")
    with pytest.raises(ValueError):
        affixes.read_words(spark, f"{tmp_path}/w.dic", flag="other")


def test_the_index_has_lemmas_and_keeps_unknown_tokens(spark, dictionary):
    chunks = spark.createDataFrame([(1, "Cities of praca, pracą 12 Umowa")], "chunk_id long, content string")
    found = {r.lexeme: r.tf for r in indexing.chunk_terms(chunks, lemmas=dictionary).collect()}
    assert found == {"city": 1, "of": 1, "praca": 2, "12": 1, "umowa": 1}


def test_empty(spark):
    none = affixes.expand(spark.createDataFrame([], "word string, flags array<string>"), spark.createDataFrame([], "kind string, flag string, crossed boolean, strip string, put string, condition string"))
    assert none.count() == 0
