"""run() of the pipeline against a version of its stages in one process."""

import re
import zlib

import numpy as np

import corpus_pipeline as p
from wardline.llm import cotraining, pii, tokens, toxicity

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    return sum((2 * int(c) - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _personal(text):
    """(start, end, kind) of all spans."""
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (13 <= len(d) <= 19 and _luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            yield m.start(), m.end(), kind
    for n, countries in pii.IBAN_LENGTHS.items():
        for m in re.finditer(rf"(?<![A-Za-z0-9])(?:{'|'.join(countries.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])", text):
            v = m.group().replace(" ", "")
            if int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1:
                yield m.start(), m.end(), "iban"
    for m in re.finditer(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", text):
        if re.search("ssn|social|security|tax", text[max(0, m.start() - 40) : m.start()], re.I):
            yield m.start(), m.end(), "ssn"


def _redacted(text):
    out, at, reach, kind = [], 0, -1, None
    for a, b, k in sorted(_personal(text), key=lambda s: (s[0], -s[1], s[2])):
        if a >= reach:
            if kind:
                out.append(f"<{kind.upper()}>")
                at = reach
            out.append(text[at:a])
            kind, reach = k, b
        reach = max(reach, b)
    if kind:
        out.append(f"<{kind.upper()}>")
        at = reach
    return "".join(out) + text[at:]


def _near(rows):
    """One row of each group that 5-word Jaccard similarity of 0.8 or more connects: all pairs."""
    sets = []
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode().lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    kept = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is None:
            kept[None, r["text"]] = r
        elif find(i) not in kept or r["doc_id"] < kept[find(i)]["doc_id"]:
            kept[find(i)] = r
    return list(kept.values())


def _plain(spark, d):
    """The rows of each stage in turn; classifiers are fitted as the operators fit them, and applied here."""
    marks = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows, stages = [r.asDict() for r in docs.collect()], []
    model = cotraining.train(docs, marks)
    if model is not None:
        x = [np.array([cotraining.content_view(r["text"] or "") for r in rows]), np.array([cotraining.metadata_view(r["lang"], r["source"], r["n_chars"]) for r in rows])]
        rows = [r for r, s in zip(rows, model.scores(tuple(x))) if s >= 0.25]
    stages.append(rows)
    model = toxicity.train(spark.createDataFrame(rows, docs.schema), marks)
    rows = [r for r, s in zip(rows, model.scores([r["text"] or "" for r in rows], toxicity.Numbers(model))) if s < 0.7]
    stages.append(rows)
    rows = _near(rows)
    stages.append(rows)
    rows = [r | {"text": _redacted(r["text"])} if r["text"] is not None else r for r in rows]
    stages.append(rows)
    return stages


def _pieces(rows):
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(tokens.vocabulary_path()), []
    for r in rows:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        start, length = 0, len(ids) % 1024 or 1024
        for k in range(-(-len(ids) // 1024)):
            out.append((r["doc_id"] if r["doc_id"] is not None else -1, k, start, length, zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())))
            start, length = start + length, 1024
    return sorted(out)


def test_run_equals_plain_stages(spark, sf, odd_dir):
    assert [n for n, _ in p.STAGES] == ["quality", "toxicity", "near_duplicates", "personal_data", "packing"]
    for d in (sf, odd_dir):
        stages = _plain(spark, d)
        got = p.run(spark, d).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == _pieces(stages[-1])
        bins = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == bins.get(r.sequence_id, 0)
            bins[r.sequence_id] = r.offset + r.length
        assert max(bins.values()) <= 1024


def test_each_stage_takes_effect(spark, sf):
    stages = [len(spark.read.parquet(f"{sf}/documents.parquet").collect()), *map(len, _plain(spark, sf))]
    assert stages[0] > stages[1] > stages[2] > stages[3] == stages[4]


def test_empty_table(spark, odd, odd_dir):
    for _, stage in p.STAGES:
        assert stage(spark, odd.limit(0), odd_dir).count() == 0


def test_stages_keep_columns_with_clashing_names(spark, odd, odd_dir):
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, odd, odd_dir).columns == odd.columns


def test_near_duplicates_keep_one_of_repeated_and_nameless_rows(spark, odd):
    kept = [r.doc_id for r in p.near_duplicates(spark, odd, "").collect()]
    assert kept.count(4) <= 1 and kept.count(None) == 1 and 3 in kept and len(kept) == len(set(kept))


def test_overlapping_spans_are_replaced_together(spark):
    said = ["a +49 4111 1111 1111 1111 b 1.2.3.4 c", "x 10.0.0.1@host.example.com y", "", "é😀 mail a@b.cd, 4111 1111 1111 1111"]
    out = pii.redacted(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in out] == [_redacted(t) for t in said] and "4111" not in out[3].text
