"""No keyword keeps a rule from its own matches."""

from itertools import product
from re import _parser

from wardline.llm import licenses


def _texts(parsed) -> list[str]:
    """Texts that a pattern matches: each alternative, with and without what may be left out."""
    out = [""]
    for op, arg in parsed:
        if op is _parser.LITERAL:
            some = [chr(arg)]
        elif op is _parser.IN:
            some = [chr(a if o is _parser.LITERAL else a[0]) for o, a in arg]
        elif op is _parser.SUBPATTERN:
            some = _texts(arg[-1])
        elif op is _parser.BRANCH:
            some = [t for branch in arg[1] for t in _texts(branch)]
        elif op is _parser.ANY:
            some = ["x"]
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            some = ["", *_texts(arg[2])] if arg[0] == 0 else _texts(arg[2])
        else:
            assert op is _parser.ASSERT_NOT
            some = [""]
        out = [a + b for a, b in product(out, some)]
    return out


def test_each_match_of_each_rule_passes_its_gates():
    table, lost = licenses.rules(), set()
    for r in table:
        for words in _texts(_parser.parse(r.pattern)):
            if not (any(g in words for g in licenses.GATE) and any(k in words for k in r.keyword.split("|"))):
                lost.add((r.label, r.keyword, words))
    assert not lost, sorted(lost)[:20]
    assert len({r.pattern for r in table}) == len(table) >= 240


def test_each_rule_finds_its_own_words(spark):
    table = licenses.rules()
    said = [(i, t[0]) for i, r in enumerate(table) if (t := _texts(_parser.parse(r.pattern)))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    assert all(got[i].labels and got[i].score > 0 for i, _ in said)
    strong = [i for i, _ in said if table[i].priority == 3]
    assert all(table[i].label in got[i].labels for i in strong), [(table[i].label, got[i].labels) for i in strong if table[i].label not in got[i].labels]


def test_short_names_are_found(spark):
    said = ["sous licence MIT", "this code is governed by MIT", "covered by ISC", "subject to the terms of MIT", "in accordance with ISC", "walk with mit and go"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == [["mit"], ["mit"], ["isc"], ["mit"], ["isc"], []]
