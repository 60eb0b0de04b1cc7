"""Operators without SQL, column by column, against plain versions of their own."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from wardline.llm import cotraining, graph, media, pieces, quality_rules, simhash, toxicity


def _texts(spark, d):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


# --- op4 ----------------------------------------------------------------------------------------------------


def _toxic_score(model, text):
    words = text.lower().split()
    if not words:
        return model.empty

    def number(token):
        word = f"<{token.strip(toxicity._EDGES)}>"
        if word == "<>":
            return 0.0
        grams = [word[i : i + n] for n in (3, 4, 5, 6) for i in range(len(word) - n + 1)] + [f"={word}"]
        return sum(float(model.weight[zlib.crc32(g.encode()) % 2**19]) for g in grams) / len(grams)

    each = [number(w) for w in words]
    lead = max(sum(each[i : i + 3]) / 3 for i in range(len(each) - 2)) if len(each) > 3 else sum(each) / len(each)
    top = sorted((number(w) for w in set(words)), reverse=True)
    x = [lead] + [sum(top[:k]) / k for k in (1, 3, 6, 10)]
    return 1 / (1 + math.exp(-float(np.dot(model.slope, x)) - model.bias))


def test_toxicity_scores_equal_plain_ones(spark, sf, odd_dir):
    for d in (sf, odd_dir):
        docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
        model = toxicity.train(docs, marks)
        got = Counter((r.doc_id, round(r.score, 4), r.predicted, r.held_out) for r in toxicity.op4_toxicity(spark, d).collect())
        want = Counter()
        for doc, text in _texts(spark, d):
            s = _toxic_score(model, text)
            want[doc, round(s, 4), int(s >= 0.7), doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1] += 1
        near = {(k[0], round(k[1], 3)) for k in want}
        assert sum(got.values()) == sum(want.values()) and {(k[0], k[2], k[3]) for k in got} == {(k[0], k[2], k[3]) for k in want}
        assert all((k[0], round(k[1], 3)) in near or any(abs(k[1] - w[1]) < 1e-3 for w in want if w[0] == k[0]) for k in got)


def test_toxicity_learns_labels_only_from_its_rows(spark, sf):
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    some = toxicity.training_rows(docs, marks).collect()
    known = {r.doc_id: r.toxic for r in marks.collect()}
    assert {r.doc_id for r in some} == {i for i in known if zlib.crc32(str(i).encode()) % 3 != 1} and all(known[r.doc_id] == r["class"] for r in some)
    assert toxicity.train(docs.limit(0), marks).scores(["x", ""], toxicity.Numbers(toxicity.fit([]))) == [0.01, 0.01]
    one = toxicity.train(docs, marks.where("toxic = 0"))
    assert toxicity.score(docs, one).where("predicted = 1").count() == 0


def test_toxicity_ties_and_repeats(spark):
    rows = [("you idiot friend", 1), ("a calm kind word", 0)] * 30
    model = toxicity.trained(rows)
    docs = spark.createDataFrame([(1, "YOU IDIOT FRIEND"), (1, "YOU IDIOT FRIEND"), (2, "a calm kind word"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.score) for r in toxicity.score(docs, model).collect())
    assert got[0] == got[1] and got[1][1] > got[2][1]


# --- op10 ---------------------------------------------------------------------------------------------------


def test_quality_scores_equal_those_of_one_process(spark, sf, odd_dir):
    for d in (sf, odd_dir):
        rows = spark.read.parquet(f"{d}/documents.parquet").collect()
        known = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
        a = np.array([cotraining.content_view(r.text or "") for r in rows], dtype=np.float32).astype(float)
        b = np.array([cotraining.metadata_view(r.lang, r.source, r.n_chars) for r in rows], dtype=np.float32).astype(float)
        order = sorted((zlib.crc32(str(r.doc_id).encode()), r.doc_id, i) for i, r in enumerate(rows) if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
        at, free = [i for _, _, i in order], [i for i, r in enumerate(rows) if r.doc_id not in known]
        y = np.array([known[rows[i].doc_id] for i in at])
        model = cotraining.fit((a[at], b[at]), y, lambda v, c: cotraining.sure_parts(v, c, (a[free], b[free]))) if len(at) else None
        s = np.full(len(rows), 0.5) if model is None else model.scores((a, b))
        want = sorted((r.doc_id or -1, float(x)) for r, x in zip(rows, s))
        got = sorted((r.doc_id or -1, r.score) for r in cotraining.op10_quality_classifier(spark, d).collect())
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-3)


def test_quality_views_are_apart():
    long, short = cotraining.metadata_view("en", "a", 5000), cotraining.metadata_view("en", "a", None)
    assert len(long) == len(short) and long[:-1] == short[:-1] and short[-1] == 0
    assert cotraining.content_view("") == [0.0] * (8 + cotraining.WORDS)


def test_quality_without_labels(spark, sf):
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert cotraining.train(docs.limit(0), marks) is None and cotraining.train(docs, marks.limit(0)) is None
    assert cotraining.kept(docs, None).count() == docs.count()


# --- op7 ----------------------------------------------------------------------------------------------------


def _crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = crc >> 31 ^ byte >> bit & 1
            crc = crc << 1 & 0xFFFFFFFF
            if top:
                crc ^= 0x04C11DB7
    return crc


def _read(stream):
    """A transport stream packet by packet: payload, timestamps, random-access flags, continuity errors."""
    program = data_pid = last = None
    errors, pes, units = 0, b"", []
    for k in range(0, len(stream), 188):
        p = stream[k : k + 188]
        assert p[0] == 0x47
        pid, start, control, counter = (p[1] & 31) << 8 | p[2], p[1] & 64, p[3] >> 4 & 3, p[3] & 15
        at, key = 4, False
        if control & 2:
            key = p[4] > 0 and bool(p[5] & 64)
            at = 5 + p[4]
        if pid == 0 or pid == program:
            own = p[at + 1 + p[at] :]
            own = own[: 3 + ((own[1] & 15) << 8 | own[2])]
            assert _crc(own) == 0
            if pid == 0:
                program = (own[10] & 31) << 8 | own[11]
            else:
                data_pid = (own[13] & 31) << 8 | own[14]
        elif pid == data_pid:
            errors += last is not None and counter != (last + 1) % 16
            last = counter
            if start:
                units.append([b"", key])
            units[-1][0] += p[at:]
    payload, stamps = b"", []
    for pes, _ in units:
        assert pes[:3] == b"\0\0\1" and pes[7] & 0x80
        s = pes[9:14]
        stamps.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1)
        payload += pes[9 + pes[8] : 6 + (pes[4] << 8 | pes[5])]
    return payload, stamps, [k for _, k in units], errors


def test_media_columns_equal_a_plain_reader(spark, sf, odd_dir):
    for d in (sf, odd_dir):
        streams = {}
        for r in media.encode(spark.read.parquet(f"{d}/documents.parquet")).collect():
            streams.setdefault(r.doc_id, bytes(r.media))
        got = {r.doc_id: r for r in media.op7_media(spark, d).collect()}
        for doc, text in _texts(spark, d):
            raw, r = text.encode(), got[doc]
            if len(raw) > 40_000 and len(raw) % 7:
                continue  # a few of the longest are read by numpy alone
            payload, stamps, keys, errors = _read(streams[doc])
            assert payload == raw + bytes((-len(raw)) % 64 if raw else 64)
            count = Counter(payload)
            entropy = -sum(n / len(payload) * math.log2(n / len(payload)) for n in count.values())
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert (r.media_bytes, r.media_sha256) == (len(streams[doc]), hashlib.sha256(streams[doc]).hexdigest())
            want = f"units={len(stamps)};packets={len(streams[doc]) // 188};errors={errors};pts={stamps[0]}-{stamps[-1]};access={sum(keys)};bytes={len(count)};entropy="
            assert r.feature.startswith(want) and abs(float(r.feature[len(want) :]) - entropy) < 2e-4 and errors == 0


def _section(table, number, body):
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2) + number.to_bytes(2) + b"\xc1\0\0" + body
    return head + _crc(head).to_bytes(4)


def _packet(pid, counter, body, start=False, field=b""):
    flags = 0x30 if field else 0x10
    head = b"\x47" + (pid | 0x4000 * start).to_bytes(2) + bytes([flags | counter]) + field
    return head + body.ljust(188 - len(head), b"\xff")


def _foreign(jump=False, announced=False):
    """A stream of another make: two programs, video before the private data, and a packet sent twice."""
    pat = _section(0, 1, (1).to_bytes(2) + (0xE000 | 0x30).to_bytes(2) + (2).to_bytes(2) + (0xE000 | 0x31).to_bytes(2))
    video = b"\x1b" + (0xE000 | 0x50).to_bytes(2) + b"\xf0\0"
    own = b"\x06" + (0xE000 | 0x51).to_bytes(2) + b"\xf0\x02zz"
    one, two = _section(2, 1, (0xE000 | 0x50).to_bytes(2) + b"\xf0\0" + video), _section(2, 2, (0xE000 | 0x51).to_bytes(2) + b"\xf0\0" + video + own)
    data = bytes(i % 251 for i in range(184 * 2 - 14 - 2 * announced))
    pes = b"\0\0\1\xbd" + (len(data) + 8).to_bytes(2) + b"\x80\x80\x05" + media._stamp(90_000) + data
    second = 5 if jump else 1
    field = b"\x01\x80" if announced else b""
    parts = [_packet(0, 0, b"\0" + pat, True), _packet(0x30, 0, b"\0" + one, True), _packet(0x31, 0, b"\0" + two, True), _packet(0x50, 3, b"video"), _packet(0x51, 0, pes[:184], True)]
    last = _packet(0x51, second, pes[184:], field=field)
    return b"".join([*parts, parts[-1], last, last]), data


@pytest.mark.parametrize("jump,announced,errors", [(False, False, 0), (True, False, 1), (True, True, 0)])
def test_media_of_another_make(jump, announced, errors):
    stream, data = _foreign(jump, announced)
    got = media.demux(stream)
    assert got["payload"] == data and got["continuity_errors"] == errors and got["pts"] == [90_000]


# --- op5 ----------------------------------------------------------------------------------------------------


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(n, v):
    if isinstance(v, int):
        return _varint(n << 3) + _varint(v)
    return _varint(n << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else _varint(n << 3 | 2) + _varint(len(v)) + v


def test_unigram_words_equal_the_library(tmp_path):
    """A small unigram model written by hand, field by field."""
    import sentencepiece

    rng = random.Random(3)
    named = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    named += [(p, -rng.randrange(4, 80) / 8, 1) for p in "▁ a b c d e ab bc abc ▁a ▁ab cd de cde ▁b ba bab ed ▁cd éa".split(" ")]
    data = b"".join(_field(1, _field(1, t.encode()) + _field(2, s) + _field(3, k)) for t, s, k in named)
    data += _field(2, _field(3, 1) + _field(35, 1) + _field(40, 0) + _field(41, 1) + _field(42, 2) + _field(43, 2**64 - 1))
    data += _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1))
    path = tmp_path / "small.model"
    path.write_bytes(data)
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Pieces(str(path))
    texts = ["".join(rng.choice("abcde  éx") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    assert own.unigram and [x.tolist() for x in own.encode(texts)] == [library.encode(t) for t in texts]
    assert not pieces.Pieces(pieces.vocabulary_path()).unigram


def test_piece_columns_equal_the_library(spark, sf, odd_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())
    for d in (sf, odd_dir):
        want = Counter()
        for doc, text in _texts(spark, d):
            ids = library.encode(text)
            want[doc, len(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True] += 1
        got = Counter((r.doc_id, r.n_pieces, r.decoded_sha256, r.round_trip) for r in pieces.op5_sentencepiece(spark, d).collect())
        assert got == want


# --- op8 ----------------------------------------------------------------------------------------------------


def _line_fails(line, words):
    n = len(words)
    if n >= 4 and sum(bool(re.fullmatch(r"[|»›>•·/\\–—-]+", w)) for w in words) >= 0.2 * n:
        return True
    if len(re.findall(r"[#*$%&|<>]", line)) > 0.1 * sum(map(len, words)):
        return True
    if n <= 25 and re.search(rf"\b(?:{quality_rules.BOILERPLATE})\b", line, re.I):
        return True
    letters = [c for c in line if c.isalpha()]
    if len(letters) >= 12 and sum(c.isupper() for c in line) >= 0.7 * len(letters):
        return True
    return n <= 5 and not re.search(r"""[.!?:;…。！？]["'”’»)\]*]*$""", line.rstrip(" \t\n\v\f\r"))


def test_quality_verdicts_equal_plain_ones(spark, sf, odd_dir):
    for d in (sf, odd_dir):
        got = {r.doc_id: r.kept for r in quality_rules.op8_quality_rules(spark, d).collect()}
        for doc, text in _texts(spark, d):
            words, kept, seen = re.findall(r"[^\x20\x09-\x0D]+", text), 0, set()
            windows = Counter(zip(words, words[1:], words[2:]))
            inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
            for line in text.split("\n"):
                own = re.findall(r"[^\x20\x09-\x0D]+", line)
                if own and line not in seen and not _line_fails(line, own):
                    kept += len(own)
                seen.add(line)
            assert got[doc] == (len(words) >= 50 and 100 * len(inside) <= 50 * len(words) and kept >= 0.5 * len(words)), doc


# --- hot keys -----------------------------------------------------------------------------------------------


def test_large_keys_are_refined_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 3)]
    fps = sorted({base[i % 3] ^ sum(1 << int(b) for b in rng.choice(60, 3, replace=False)) for i in range(600)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole = {(r.node, r.root) for r in graph.connected_components(simhash.links(df)).collect()}
    monkeypatch.setattr(simhash, "PART", 16)
    monkeypatch.setattr(simhash, "REFINE", 32)
    monkeypatch.setattr(graph, "LIGHT", 4)
    assert {(r.node, r.root) for r in graph.connected_components(simhash.links(df)).collect()} == whole
    assert len({r for _, r in whole}) <= 6


def test_spread_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIGHT", 2)
    monkeypatch.setattr(graph, "HEAVY_KEYS", 10)
    rows = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(200)] + [(99, 1)], "k int, x int")
    by = rows.where("k <> 99").groupBy("k").count().withColumnRenamed("count", "n")
    got = sorted(tuple(r) for r in graph.spread_join(rows, by, ["k"], rows.count()).collect())
    assert got == sorted(tuple(r) for r in rows.join(by, "k").collect()) and len(got) == 200
