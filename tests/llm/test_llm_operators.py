"""Each numbered operator against a brute-force version, an exact round trip or held-out accuracy; and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from wardline.llm import cotraining, licenses, media, pieces, pii, quality_rules, queries, simhash, tokens, toxicity
from wardline.llm.graph import connected_components

COLUMNS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_simhash": "doc_id fingerprint component_id", "op3_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op4_toxicity": "doc_id held_out score predicted", "op5_sentencepiece": "doc_id n_pieces round_trip", "op6_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op8_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_token_counts": "doc_id n_bytes n_tokens over_limit", "op10_quality_classifier": "doc_id score kept",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_runs_on_odd_rows(spark, odd_dir, name):
    rows = queries.QUERIES[name](spark, odd_dir)
    assert set(COLUMNS[name].split()) <= set(rows.columns)
    n = rows.count()
    assert n == 13 if name != "op6_best_fit_packing" else n >= 13


@pytest.mark.parametrize("run", [pii.detect, simhash.near_duplicates, licenses.scan, pieces.encode, tokens.pack, media.encode, quality_rules.cleaned, tokens.token_counts, lambda d: toxicity.score(d, toxicity.fit([])), lambda d: cotraining.score(d, None)])
def test_empty_table(none, run):
    assert run(none).count() == 0


def _texts(spark, d):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


def _by_id(rows):
    return {r.doc_id: r for r in rows}


def test_pii_base_equals_plain_search(spark, sf, odd_dir):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum((2 * int(c) - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    for d in (sf, odd_dir):
        got = _by_id(pii.op1_pii(spark, d).collect())
        for doc, text in _texts(spark, d):
            base = [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, text) if valid(k, m.group())]
            assert got[doc].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), doc
            assert set(base) <= set(got[doc].spans.split(",")) | {""}


def test_pii_checksums_context_and_redaction(spark):
    df = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00 ok", 0), (2, "IBAN DE88 3704 0044 0532 0130 00", 0), (3, "ssn 123-45-6789", 0), (4, "part 123-45-6789", 0), (5, None, 0)], "doc_id long, text string, n_chars long")
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in pii.detect(df).collect()}
    assert kinds == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: []}
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redacted(df).collect()}
    assert out[1] == ("IBAN <IBAN> ok", 14) and out[5] == (None, None)


def _components(fps, distance):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_all_pairs(spark, sf, odd_dir):
    for d in (sf, odd_dir):
        texts = _texts(spark, d)
        fps = []
        for _, t in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
            h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
            fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if len(h) < 3000 else simhash.fingerprint(t))
        roots = _components(fps, 4)
        low = {}
        for (doc, _), r in zip(texts, roots):
            if doc is not None:
                low[r] = min(low.get(r, doc), doc)
        want = Counter((doc, f"{f:016x}", low.get(r)) for (doc, _), f, r in zip(texts, fps, roots))
        assert Counter(tuple(r) for r in simhash.op2_simhash(spark, d).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_dense_group_of_fingerprints_is_split_and_joined(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 32)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4)
    fps = sorted({int(base[i % 4]) ^ int(sum(1 << int(b) for b in rng.integers(0, 60, 3))) for i in range(400)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.node: r.root for r in connected_components(simhash.links(df)).collect()}
    roots = _components(fps, 4)
    assert len({found.get(f, f) for f in fps}) == len(set(roots))
    assert all((found.get(a, a) == found.get(b, b)) == (x == y) for a, x in zip(fps, roots) for b, y in zip(fps[:40], roots[:40]))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in connected_components(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_license_base_equals_plain_search(spark, sf, odd_dir):
    for d in (sf, odd_dir):
        got = _by_id(licenses.op3_licenses(spark, d).collect())
        for doc, text in _texts(spark, d):
            w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
            places = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            r = got[doc]
            assert (r.n_words, r.n_base) == (len(w), len(places)), doc
            assert (r.first_word, r.last_word) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
            assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_license_rules_and_suppression(spark):
    cases = {
        "SPDX-License-Identifier: Apache-2.0": ["apache-2"], "This work is licensed under the GNU General Public License, version 3.": ["gpl-3"], "Licensed under CC BY-NC 4.0": ["cc-by-nc"],
        "Distributed under the terms of the BSD 3-Clause license": ["bsd-3"], "All rights reserved.": ["proprietary"], "dedicated to the public domain": ["public-domain"], "the mitten is under the table": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {list(cases)[r.doc_id]: r.labels for r in licenses.scan(df).collect()} == cases
    assert len(licenses.rules()) >= 200


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op4_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    clean = [r.score for r in got if not r.toxic]
    found = sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got)
    above = np.mean([np.mean(np.array(clean) < r.score) for r in got if r.toxic])
    assert np.mean(np.array(clean) < 0.7) >= 0.975 and found >= 0.6 and above >= 0.95


def test_pieces_equal_the_library(spark, sf, odd_dir):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())
    for d in (sf, odd_dir):
        for r in pieces.decode(pieces.encode(spark.read.parquet(f"{d}/documents.parquet"))).collect():
            assert r.ids == lib.encode(r.text) and r.decoded == lib.decode(r.ids) == r.text.replace("▁", " ")


def test_packing_is_whole_gapless_and_best_fit(spark, sf, odd_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path())
    for d in (sf, odd_dir):
        rows = tokens.op6_best_fit_packing(spark, d).collect()
        want = Counter()
        for doc, text in _texts(spark, d):
            ids = tok.encode(text, add_special_tokens=False).ids + [2]
            start, length = 0, len(ids) % 1024 or 1024
            for k in range(-(-len(ids) // 1024)):
                want[doc, k, start, length, zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())] += 1
                start, length = start + length, 1024
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        bins = {}
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == bins.get(r.sequence_id, 0)
            bins[r.sequence_id] = r.offset + r.length
        caps = []
        for n in sorted((r.length for r in rows), reverse=True):
            fit = min((c for c in caps if c >= n), default=None)
            if fit is None:
                caps.append(1024 - n)
            else:
                caps[caps.index(fit)] = fit - n
        assert max(bins.values()) <= 1024 and len(bins) == len(caps)


def test_token_counts_equal_the_library(spark, sf, odd_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path())
    for d in (sf, odd_dir):
        got = _by_id(tokens.op9_token_counts(spark, d).collect())
        for doc, text in _texts(spark, d):
            n = len(tok.encode(text, add_special_tokens=False).ids)
            assert (got[doc].n_bytes, got[doc].n_tokens, got[doc].over_limit) == (len(text.encode()), n, n > 1024), doc


@pytest.mark.parametrize("n", [0, 1, 63, 64, 156, 157, 158, 169, 170, 171, 182, 183, 184, 185, 400, 16_384, 16_385, 70_000])
def test_transport_stream_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    stream = media.mux(media.padded(data))
    back = media.demux(stream)
    assert back["payload"] == media.padded(data) and back["continuity_errors"] == 0 and back["random_access"][0]
    assert back["pts"] == [k * media.TICKS for k in range(len(back["pts"]))]


def test_transport_stream_faults(spark):
    stream = bytearray(media.mux(b"\x01" * 64 * 100))
    lost = bytes(stream[: 3 * 188] + stream[4 * 188 :])
    assert media.demux(lost)["continuity_errors"] == 1
    stream[0] = 0
    df = spark.createDataFrame([(1, 1, bytes(stream)), (2, 1, None), (3, 1, b"abc")], "doc_id long, n_bytes long, media binary")
    assert {r.doc_id: r.error for r in media.decode(df).collect()} == {1: "a sync byte is missing", 2: "null", 3: "not a whole number of packets"}


def test_quality_base_equals_plain_counts(spark, sf, odd_dir):
    for d in (sf, odd_dir):
        got = _by_id(quality_rules.op8_quality_rules(spark, d).collect())
        for doc, text in _texts(spark, d):
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            n, seen, dup = Counter(zip(w, w[1:], w[2:])), set(), 0
            for line in text.split("\n"):
                if re.search(r"[^\x20\x09-\x0D]", line):
                    dup += line in seen
                    seen.add(line)
            inside = {i + k for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
            r = got[doc]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)), doc
            assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_quality_rules_keep_clean_text_and_drop_junk(spark):
    d = "/root/testdata/sf0.1"
    rows = quality_rules.op8_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality) and not any(r.kept for r in rows if not r.quality)


def test_quality_classifier_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = cotraining.op10_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.kept for r in rows if r.quality) >= 0.99 * sum(r.quality for r in rows)
    assert sum(not r.kept for r in rows if not r.quality) >= 0.95 * sum(not r.quality for r in rows)
