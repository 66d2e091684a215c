"""SentencePiece encoding and decoding with a Viterbi search that words share by prefix.

A text is marked (spaces become U+2581, one more in front) and cut into marked words, each
a run of marks and what follows it up to the next mark; no piece reaches across. A task
sorts the distinct marked words of its batch and walks them as a trie, depth first: the forward
column of a prefix is kept while the words below it are done, so a common prefix is scored once.

Unigram models: the forward column holds the best score of the prefix and its last piece.
BPE models: of the paths to a prefix, the one is alive whose neighbouring pieces merging
leaves as they are (dead paths score minus infinity); the column holds its last piece. Thereby
the ids are those of the model's own merges, which a search for the best sum would not give.

Defined results: a null text is the empty one and has no pieces; characters without a piece
become byte pieces, or the unknown piece in models without those; a U+2581 in a text reads as
a space, so decoding gives a space; decode(encode(x)) is x otherwise for models that neither
normalise nor drop spaces; other normalisers are refused. Texts are read whole, rows that
repeat are encoded alike, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct words that a task remembers.
REMEMBERED = 100_000
#: Characters of a word's start whose prefixes keep their ids; of a longer word the rest is traced back.
KEPT = 48
#: Bytes of text encoded at once (a longer text goes alone): the more, the more prefixes its words share.
BATCH = 2 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: (number, value)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Codec:
    """Encoder and decoder of one model file's content."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy, self.squeeze = UNIGRAM, True, True
        charsmap = b""
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                self.dummy, self.squeeze, charsmap = bool(f.get(3, 1)), bool(f.get(4, 1)), f.get(2, b"")
        if charsmap or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with the identity normaliser are read")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        self.score = {p: self.pieces[i][1] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        self.unknown_score = min(self.score.values(), default=0.0) - 10
        within = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if within:
            raise ValueError(f"pieces with a mark inside: {within[:3]}")
        alone = [c for c in "\n\t\r" if not any(c in p for p in self.ids)]
        cut = "".join(map(re.escape, alone))
        self.cut = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|[{cut}]" if alone else ""))
        self.spell = [bytes([int(p[1:-1], 16)]) if t == BYTE else (b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode()) for p, _, t in self.pieces]
        self.known: dict[str, bytes] = {}

    # -- one word

    @functools.cached_property
    def number(self) -> dict[str, int]:
        """Of every piece that a path may hold; characters without a piece join as they come."""
        return dict(self.ids)

    @functools.cached_property
    def starts(self) -> dict[str, int]:
        """Of what pieces begin with: the number, or -1 where it is no piece itself."""
        return {p[:n]: -1 for p in self.ids for n in range(1, len(p))} | self.number

    @functools.cached_property
    def text(self) -> list[str]:
        """The piece of each number."""
        pieces = {i: p for p, i in self.ids.items()}
        return [pieces.get(i, "") for i in range(max(pieces, default=-1) + 1)]

    @functools.cached_property
    def code(self) -> list[bytes]:
        """The ids of each number, as little-endian int32."""
        return [array("i", [i]).tobytes() for i in range(len(self.text))]

    @functools.cached_property
    def agree(self) -> dict[int, bool]:
        """What _stays found, by both numbers."""
        return {}

    def merged(self, text: str) -> list[str]:
        """Merging by score, leftmost first, as the definition of BPE has it; for short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stranger(self, char: str) -> int:
        """The number of a character that no piece spells."""
        self.number[char] = self.starts[char] = len(self.text)
        self.text.append(char)
        ids = [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown]
        self.code.append(array("i", ids).tobytes())
        return self.number[char]

    def _stays(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b, side by side, as they are (a is -1 where b is the first)."""
        before, piece = self.text[a] if a >= 0 else "", self.text[b]
        got = self.agree[a << 24 | b] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return got

    def _unigram(self, word: str, end: int, best: list[float]) -> tuple[int, float]:
        """The last piece of the best path to word[:end], and its score."""
        top, last = float("-inf"), word[end - 1 : end]
        for begin in range(max(0, end - self.longest), end):
            s = self.score.get(word[begin:end], self.unknown_score if begin == end - 1 else None)
            if s is not None and best[begin] + s > top:
                top, last = best[begin] + s, word[begin:end]
        got = self.number.get(last)
        return self._stranger(last) if got is None else got, top

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known yet, along their trie."""
        # The forward columns of the prefixes of the word before: last piece, best score (unigram), least begin from which a piece
        # may reach this far (BPE), ids so far (of the first KEPT).
        last, best, least, ids = [-1], [0.0], [0], [b""]
        bpe = self.kind == BPE
        starts, agree, text, code = self.starts, self.agree, self.text, self.code
        unknown = b"" if self.bytes else array("i", [self.unknown]).tobytes()
        before = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            shared += 1
            del last[shared:], best[shared:], least[shared:], ids[shared:]
            for end in range(shared, len(word) + 1):
                if bpe:
                    low = least[end - 1]
                    for begin in range(low, end):
                        piece = starts.get(word[begin:end])
                        if piece is None or piece < 0:
                            if begin < end - 1:
                                if piece is None and begin == low:
                                    low += 1  # no piece begins like that, so none reaches further either
                                continue
                            piece = self._stranger(word[begin:end])
                        got = agree.get(last[begin] << 24 | piece)
                        if got if got is not None else self._stays(last[begin], piece):
                            break  # merging leaves one path to each prefix
                    least.append(low)
                else:
                    piece, score = self._unigram(word, end, best)
                    begin = end - len(text[piece])
                    best.append(score)
                last.append(piece)
                if end < KEPT:
                    own, path = code[piece], ids[begin]
                    ids.append(path if unknown and own == unknown and path[-4:] == own else path + own)
            end, rest = len(word), []
            while end >= len(ids):
                rest.append(last[end])
                end -= len(text[last[end]])
            if rest:
                parts = [ids[end]]
                for piece in reversed(rest):
                    if code[piece] != unknown or parts[-1][-4:] != unknown:
                        parts.append(code[piece])
                self.known[word] = b"".join(parts)
            else:
                self.known[word] = ids[end]
            before = word

    # -- texts

    def marked(self, text: str) -> list[str]:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        return self.cut.findall(((MARK if self.dummy else "") + text).replace(" ", MARK))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian int32."""
        cut = [self.marked(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.agree) > 4 * REMEMBERED:
            self.agree.clear()
        self.learn({w for ws in cut for w in ws}.difference(self.known))
        known = self.known
        return [b"".join([known[w] for w in ws]) for ws in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        spell = self.spell
        out = b"".join([spell[i] for i in ids.tolist()])
        return out[1:] if self.dummy and out[:1] == b" " else out


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def _codec(model: bytes) -> Codec:
    """One for all tasks of a worker, which thereby keep the words they know."""
    return Codec(model)


def _coded(docs: DataFrame, columns: list[str], emit, schema: str, model_path: str | None) -> DataFrame:
    with open(model_path or default_model(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: some hundred KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            codec = codec or _codec(shared.value)
            sizes = pc.fill_null(pc.binary_length(b.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            i = 0
            while i < b.num_rows:
                n = max(1, int(np.searchsorted(ends, ends[i] - sizes[i] + BATCH, "right")) - i)
                part = b.slice(i, n)
                i += n
                texts = [t or "" for t in part.column("_text").to_pylist()]
                own = [part.column(c) for c in columns]
                yield emit(own, texts, codec.encode(texts), codec)

    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(tidy(run), schema)


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids (array<int>)."""

    def emit(own, texts, ids, codec):
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), np.int32))
        return pa.RecordBatch.from_arrays([*own, pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "n_pieces", "ids"])

    return _coded(docs, ["doc_id"], emit, "doc_id long, n_pieces long, ids array<int>", model_path)


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give a null text."""
    with open(model_path or default_model(), "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            codec = codec or _codec(shared.value)
            texts = [None if x is None else codec.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian int32), decoded_sha256, round_trip."""

    def emit(own, texts, ids, codec):
        decoded = [codec.decode(np.frombuffer(x, np.int32)) for x in ids]
        return pa.RecordBatch.from_arrays(
            [*own, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
             pa.array([d == t.encode("utf-8", "replace") for d, t in zip(decoded, texts)], pa.bool_())],
            ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"],
        )

    return _coded(docs, ["doc_id"], emit, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean", model_path)
