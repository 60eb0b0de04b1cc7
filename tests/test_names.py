"""Known names in texts: the walk over runs of words against a pattern a name, one after the other."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from wardline.functions.personal import with_names, word_runs
from wardline.operators import masking


def _plain(text, known):
    found = []
    for name, shown in sorted(known, key=lambda n: (-len(n[0]), n[0])):
        new = regex.sub(rf"(?<![\p{{L}}\[]){regex.escape(name, literal_spaces=True)}(?![\p{{L}}-])", lambda m, s=shown: s, text, flags=regex.IGNORECASE)
        if new != text:
            text = new
            found.append(name)
    return text, found


def test_walk_equals_patterns():
    rng = random.Random(1)
    pool = ["anna schmidt", "schmidt", "klaus weber", "weber", "anna-lena meyer", "meyer", "o'neil", "ben o'neil jr.", "ä ö", "schmidt weber"]
    for _ in range(3000):
        known = [(n, f"[Person-{i}]") for i, n in enumerate(rng.sample(pool, rng.randint(0, 6)))]
        parts = [rng.choice([*pool, "Anna SCHMIDT", "weberin", "[", "-", "x", "9", "Schmidt-", "Jr"]) for _ in range(8)]
        text = "".join(p + rng.choice([" ", " ", "  ", "-", ".", "\n", ", "]) for p in parts)
        got, want = with_names(text, known), _plain(text, known)
        assert got[0] == want[0] and sorted(got[1]) == sorted(want[1]), (text, known)


def test_runs_are_those_that_names_could_be():
    assert {k for _, _, k in word_runs("Der X-Meyer [Ab cd  ef", [1, 2])} == {"der", "x", "meyer", "der x", "x-meyer", "meyer [ab", "cd", "ef", "cd  ef"}
    assert {k for _, _, k in word_runs("", [1])} == set() and not list(word_runs("a b", []))


@pytest.mark.parametrize("mode,want", [("corpus", ["[Person-1]", "[Person-1]"]), ("asof", ["[Person-1]", "[Person-1]"]), ("off", ["[Person-1]", "anna schmidt"])])
def test_names_learnt_before(spark, mode, want):
    rows = [("p", 1, 0, 1, "Herr Anna Schmidt"), ("p", 2, 0, 2, "anna schmidt"), ("q", 3, 0, 0, "anna schmidt"), ("p", 4, 0, 4, None)]
    out, _ = masking.masked(spark.createDataFrame(rows, "partition string, request int, idx int, ord long, text string"), second_pass=mode)
    got = {r.request: r.masked for r in out.collect()}
    assert [got[1].removeprefix("Herr "), got[2]] == want and got[3] == "anna schmidt" and got[4] == ""


def test_names_learnt_later_count_for_the_whole_corpus_only(spark):
    rows = spark.createDataFrame([("p", 1, 0, 1, "anna schmidt"), ("p", 2, 0, 2, "Herr Anna Schmidt")], "partition string, request int, idx int, ord long, text string")
    got = {m: masking.masked(rows, second_pass=m)[0].where("request = 1").first().masked for m in ("corpus", "asof")}
    assert got == {"corpus": "[Person-1]", "asof": "anna schmidt"}


def test_many_spans_and_forms_take_one_walk(spark):
    """100,000 spans in a text, and an answer with 100,000 tokens: by a copy of the text for each these would take minutes."""
    n = 100_000
    mails = " ".join(f"a{i}@b.de" for i in range(n))
    rows = spark.createDataFrame([("p", 1, 0, 1, mails)], "partition string, request int, idx int, ord long, text string")
    began = time.time()
    out, _ = masking.masked(rows, second_pass="off")
    got = out.select("masked", masking.unmask(F.col("masked"), F.col("session")).alias("clear")).first()
    assert got.clear == mails and got.masked.count("[Mail-") == n and f"[Mail-{n}]" in got.masked
    assert time.time() - began < 120


def test_a_name_behind_a_capitalised_word_is_found():
    """That word and the first name are a pair of their own, behind which the name was hidden."""
    from wardline.functions.personal import detect

    names = lambda text, **how: [v for *_, v, c in detect(text, **how) if c == "person"]
    assert names("The The The Sabine Fischer rief an.") == ["Sabine Fischer"]
    assert names("Ende.\nHier Bernd Schmidt und Dann Klaus Weber") == ["Bernd Schmidt", "Klaus Weber"]
    assert names("Gestern Anna Montag", chains=False) == names("Die Anna GmbH") == []
    assert names("Wort Anna Maria Schmidt") == ["Maria Schmidt"]
    assert names("The Sabine Fischer", chains=True) == ["Sabine Fischer"]
