"""SentencePiece encoding and decoding by a forward pass that words with a common prefix share.

The public model at hand is a byte-fallback BPE, whose pieces come from ranked merges and not from the best sum of
scores; a plain Viterbi search over scores would give other pieces than the library does. What a forward pass keeps
here is therefore not a score but the last piece of the prefix's own encoding. It is unique: a sequence of pieces is
an encoding exactly if each two neighbours encode to themselves, so a piece ends an encoding of a prefix if it may
follow the last piece of the prefix before it. The state depends on the prefix alone. So the different words of a
batch are sorted, which orders them as a depth-first walk of their trie, and each word goes on from the states of
what it shares with the word before it.

A unigram model's words take the same walk with the scores of a Viterbi search as states: of each prefix the best sum
of its pieces' scores, and the piece that ends it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, of_worker, slices, text_rows

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
CACHE_WORDS, CACHE_CHARS = 600_000, 48
_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


UNIGRAM = 1
#: How far below the lowest score of a piece a character without one stands, as in the library.
UNKNOWN = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the wire format of protocol buffers."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        size = varint() if kind in (0, 2) else {1: 8, 5: 4}[kind]
        if kind:
            yield key >> 3, data[at : at + size]
            at += size
        else:
            yield key >> 3, size


def model_type(data: bytes) -> int:
    """The kind of a serialized model: field 3 of its trainer's settings, field 2."""
    return next((v for n, own in _fields(data) if n == 2 for m, v in _fields(own) if m == 3), UNIGRAM)


class Pieces:
    """The pieces of a model file, as text and as bytes, and which two may stand side by side, or their scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model, n = model, model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i] and not model.is_byte(i)}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [b"" if special[i] else names[i].encode() for i in range(n)]
        self.bytes[model.unk_id()] = " ⁇ ".encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self.length = list(map(len, names))
        self.edge = n  # stands for the start of a word and for a character that no piece has
        #: Pieces by their characters from the last to the first: character -> (id or -1, what goes on before it).
        self.backward: dict = {}
        for piece, i in self.ids.items():
            kids = self.backward
            for c in piece[:0:-1]:
                kids = kids.setdefault(c, (-1, {}))[1]
            kids[piece[0]] = (i, kids.get(piece[0], (-1, {}))[1])
        self.names = names
        self.unigram = model_type(model.serialized_model_proto()) == UNIGRAM
        if self.unigram:
            self.scores = [model.get_score(i) for i in range(n)]
            self.unknown = min(self.scores[i] for i in self.ids.values()) - UNKNOWN
            if any(MARK in p[1:].lstrip(MARK) for p in self.ids) or min(self.byte_ids) == model.unk_id():
                raise ValueError("a unigram model is read word by word, with a piece for each byte: its pieces mustn't span words")
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def follows(self, last: int, piece: int) -> bool:
        """Whether piece may come after last: whether the two, with a line feed before them that nothing merges with,
        encode to themselves. At an edge: whether piece does."""
        key = last * (self.edge + 1) + piece
        if key not in self.fits:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            pair = [piece] if last == self.edge else [last, piece]
            self.fits[key] = self.model.encode("\n" + "".join(self.names[i] for i in pair))[2:] == pair
        return self.fits[key]

    def encode_sorted(self, words: list[str]) -> list[bytes]:
        """The ids of each word, packed; words are sorted and differ. states[i] is the last piece of the encoding of the
        first i characters, found once for all words that begin with them; below -1 a character without a piece."""
        edge, many, backward, length, fits, follows = self.edge, self.edge + 1, self.backward, self.length, self.fits, self.follows
        states, before, out = [edge], "", []
        for word in words:
            shared, both = 0, min(len(word), len(before))
            while shared < both and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                at, kids, ending = end, backward, []
                while at and (node := kids.get(word[at - 1])):
                    at -= 1
                    piece, kids = node
                    if piece >= 0:
                        ending.append((at, piece))
                state = -2 - ord(word[end - 1])
                for start, piece in reversed(ending):
                    ahead = states[start]
                    if ahead < 0:
                        ahead = edge
                    fit = fits.get(ahead * many + piece)
                    if follows(ahead, piece) if fit is None else fit:
                        state = piece
                        break
                states.append(state)
            ids, at = [], len(word)
            while at:
                state = states[at]
                if state >= 0:
                    ids.append(state)
                    at -= length[state]
                else:
                    ids.extend(self.byte_ids[b] for b in reversed(chr(-2 - state).encode("utf-8", "surrogatepass")))
                    at -= 1
            ids.reverse()
            out.append(array("i", ids).tobytes())
            before = word
        return out

    def best_sorted(self, words: list[str]) -> list[bytes]:
        """As encode_sorted, by a unigram model: states[i] is the best sum of scores of the first i characters and the length
        of the last piece there, 0 for a character without a piece of its own. Of equal sums the longer last piece."""
        backward, before, out, states = self.backward, "", [], [(0.0, 0)]
        for word in words:
            shared, both = 0, min(len(word), len(before))
            while shared < both and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                at, kids, best = end, backward, None
                while at and (node := kids.get(word[at - 1])):
                    at -= 1
                    piece, kids = node
                    if piece >= 0 and (best is None or states[at][0] + self.scores[piece] >= best[0]):
                        best = states[at][0] + self.scores[piece], end - at
                if word[end - 1] not in self.ids:
                    alone = states[end - 1][0] + self.unknown
                    best = (alone, 0) if best is None or alone > best[0] else best
                states.append(best)
            ids, at = [], len(word)
            while at:
                size = states[at][1]
                if size:
                    ids.append(self.ids[word[at - size : at]])
                else:
                    size = 1
                    ids.extend(self.byte_ids[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass")))
                at -= size
            ids.reverse()
            out.append(array("i", ids).tobytes())
            before = word
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them."""
        split = [_WORDS(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = sorted(set().union(*split).difference(known))
        fresh = dict(zip(new, self.best_sorted(new) if self.unigram else self.encode_sorted(new)))
        known.update((w, v) for w, v in fresh.items() if len(w) <= CACHE_CHARS)
        long = {w: v for w, v in fresh.items() if len(w) > CACHE_CHARS}
        look = known.__getitem__ if not long else lambda w: known[w] if w in known else long[w]
        return [np.frombuffer(b"".join(map(look, ws)), dtype=np.int32) for ws in split]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _pieces(path: str) -> Pieces:
    return of_worker(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, ids: the ids of each text without begin and end. Null and empty texts have none. Repeated rows
    get a row each; other columns are ignored; an empty table gives an empty one. Narrow: words are shared within
    Arrow batches and through each worker's cache, not by a shuffle."""
    path = path or vocabulary_path()

    def make(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "text": texts, "ids": _pieces(path).encode(texts)}

    return map_batches(text_rows(docs), make, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds decoded: the text that the ids stand for, marks as blanks and without the blank put before the text; null
    for null ids."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chain.from_iterable(map(slices, batches)):
            lists = part.column(2)
            ids, ends, null = lists.values.to_numpy(), lists.offsets.to_numpy(), lists.is_null().to_pylist()
            texts = [None if n else _pieces(path).decode(ids[a:b].tolist()) for a, b, n in zip(ends, ends[1:], null)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "text", "ids", "decoded"])

    return encoded.select("doc_id", "text", "ids").mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(documents(spark, sf_dir))).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.replace("text", F.lit(MARK), F.lit(" "))).alias("round_trip"),
    )
