"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and scores come from a public model file. Where its scores are merge
ranks (whole numbers that fall from piece to piece), as in a BPE file, Zipf's
law turns the place r of a piece into the log probability
-log(r + 1) - log(sum of 1 / (r + 1)). Scores are whole micro-nats, so sums are
exact and ties are real ties.

A space is the white-space marker and one more stands before a text. No piece
has a marker after another character, so the best path of a text is made of the
best paths of its words, each computed once and kept in a bounded cache.
"""

from __future__ import annotations

import array
import functools
import math
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolith.llm.shared import kept, utf8_rows

MARK = "▁"
#: Texts that a model's normaliser must leave as they are but for the marker: what would be joined, folded, trimmed or dropped.
PROBES = ("a", "a  b", " a", "a ", "\t", "\ufb01", "\uff21", "e\u0301", "\u3000", "\u00bd", "\u200bx", "\x01", "\u0130")
CACHE = 300_000
LONGEST_CACHED = 48
UNKNOWN_PENALTY = 10_000_000
_WORDS = re.compile(rb" +[^ ]*")


class DoubleArray:
    """A trie over byte strings: the child of node n by byte b is base[n] + b + 1 where check says n."""

    def __init__(self, entries: dict[bytes, int]):
        tree: dict = {}
        for word, value in entries.items():
            node = tree
            for b in word:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 16
        self.base = array.array("i", [0]) * size
        self.check = array.array("i", [-1]) * size
        self.value = array.array("i", [-1]) * size
        self.check[0] = 0
        first_free = dense = 257  # any byte can reach a slot from here on
        queue = [(0, tree)]
        for at, node in queue:  # grows while it runs: breadth first
            self.value[at] = node.get(-1, -1)
            steps = sorted(b for b in node if b >= 0)
            if not steps:
                continue
            while self.check[first_free] >= 0:
                first_free += 1
                self._grow(first_free + 258)
            # one child fits any gap; several are placed in the emptier part behind `dense`
            base = (first_free if len(steps) == 1 else max(first_free, dense)) - steps[0] - 1
            tries = 0
            while True:
                self._grow(base + 258)
                if all(self.check[base + b + 1] < 0 for b in steps):
                    break
                base += 1
                tries += 1
            if tries > 100:
                dense = base + steps[0] + 1
            self.base[at] = base
            for b in steps:
                self.check[base + b + 1] = at
                queue.append((base + b + 1, node[b]))

    def _grow(self, size: int) -> None:
        while len(self.check) <= size:
            more = len(self.check)
            self.base.extend([0] * more)
            self.check.extend([-1] * more)
            self.value.extend([-1] * more)

    def prefixes(self, text: bytes, at: int) -> list[tuple[int, int]]:
        """(end, value) of every entry that text has at a position, shortest first."""
        found, node, base, check, value = [], 0, self.base, self.check, self.value
        for i in range(at, len(text)):
            child = base[node] + text[i] + 1
            if check[child] != node or child == 0:
                break
            node = child
            if value[node] >= 0:
                found.append((i + 1, value[node]))
        return found


class Vocabulary:
    """Pieces of a model file as bytes (marker as space), their scores, byte pieces and the trie."""

    def __init__(self, path: str, zipf: bool | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in PROBES:
            if model.normalize(probe) != MARK + probe.replace(" ", MARK):
                raise ValueError(f"the model's normaliser changes {probe!r}, which this encoder would not")
        size = model.get_piece_size()
        normal = [
            i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        scores = [model.get_score(i) for i in normal]
        falling = sum(b < a for a, b in zip(scores, scores[1:]))
        ranks = all(s == int(s) for s in scores) and falling >= 0.9 * (len(scores) - 1)
        if ranks if zipf is None else zipf:
            total = math.log(sum(1 / (k + 1) for k in range(len(normal))))
            scores = [-math.log(k + 1) - total for k in range(len(normal))]
        self.score = array.array("q", [0]) * size
        self.text = [b""] * size
        entries = {}
        for i, s in zip(normal, scores, strict=True):
            piece = model.id_to_piece(i).replace(MARK, " ").encode()
            self.score[i] = round(s * 1e6)
            self.text[i] = piece
            entries[piece] = i
            if b" " in piece.lstrip(b" "):
                raise ValueError("a piece with the marker inside words can't be encoded word by word")
        self.byte_id = array.array("i", [-1]) * 256
        for i in range(size):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[b] = i
                self.text[i] = bytes([b])
        if min(self.byte_id) < 0:
            raise ValueError("the vocabulary has no byte pieces to fall back on")
        self.is_byte = frozenset(self.byte_id)
        self.unknown = min(self.score) - UNKNOWN_PENALTY
        self.trie = DoubleArray(entries)

    def best_path(self, word: bytes) -> list[int]:
        """Ids with the largest sum of scores; a character without a piece becomes its bytes.

        Of equal sums, the path whose last piece begins first wins.
        """
        n = len(word)
        best: list[int | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0] = 0
        score, prefixes = self.score, self.trie.prefixes
        for at in range(n):
            here = best[at]
            if here is None:
                continue
            first = word[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            whole = False
            for end, piece in prefixes(word, at):
                whole |= end == at + width
                total = here + score[piece]
                if best[end] is None or total > best[end]:
                    best[end], back[end] = total, (at, piece)
            if not whole:
                end = min(n, at + width)
                total = here + self.unknown
                if best[end] is None or total > best[end]:
                    best[end], back[end] = total, (at, -1)
        ids: list[int] = []
        at = n
        while at > 0:
            start, piece = back[at]
            ids += [piece] if piece >= 0 else [self.byte_id[b] for b in reversed(word[start:at])]
            at = start
        return ids[::-1]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Packed ids of texts by a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, text: bytes) -> bytes:
        """16-bit or 32-bit little-endian ids, as `code` says."""
        if not text:
            return b""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        words = text.split(b" ") if b"  " not in text else None
        if words is None or not words[-1] or not words[0]:
            words = _WORDS.findall(b" " + text)
            lead = b""
        else:
            lead = b" "
        known, out = self.known, []
        for word in words:
            # a word without its space and one with it are kept apart by the space
            name = lead + word
            ids = known.get(name)
            if ids is None:
                ids = self.older.get(name)
                if ids is None:
                    ids = array.array(self.code, self.vocabulary.best_path(name)).tobytes()
                if len(name) <= LONGEST_CACHED:
                    known[name] = ids
            out.append(ids)
        return b"".join(out)

    @property
    def code(self) -> str:
        return "H" if len(self.vocabulary.text) <= 65536 else "I"

    def decode(self, ids: bytes) -> bytes:
        """The text of packed ids: markers become spaces, byte pieces their bytes, and the space in front goes."""
        text = b"".join(map(self.vocabulary.text.__getitem__, memoryview(ids).cast(self.code)))
        return text[1:] if text[:1] == b" " else text


def encoder(path: str) -> Encoder:
    return kept(f"pieces {path}", lambda: Encoder(vocabulary(path)))


def encode(docs: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_bytes, ids (packed), n_pieces, n_fallback, ids_crc32.

    ids are little-endian, of 16 bits if the vocabulary fits; ids_crc32 is over
    them as 32-bit. n_fallback counts byte pieces. A null or empty text has no
    pieces, an empty table gives no rows. Rows are neither joined nor grouped,
    so repeated rows get equal ids; of equally good paths the one whose last
    piece begins first wins. Very long texts are encoded whole, word by word; a
    word without white space takes memory for itself. model is the path of a
    model file that each executor has; one whose normaliser changes texts is
    refused, as this encoder has none.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        one = encoder(model)
        kind = np.dtype("<u2" if one.code == "H" else "<u4")
        byte_piece = np.zeros(len(one.vocabulary.text), bool)
        byte_piece[list(one.vocabulary.is_byte)] = True
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key"))
            rows = []
            for (text,) in utf8_rows(batch, "text"):
                ids = one.encode(text or b"")
                values = np.frombuffer(ids, kind)
                rows.append((len(text or b""), ids, len(values), int(byte_piece[values].sum()), zlib.crc32(values.astype("<u4").tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            long = pa.int64()
            arrays = [pa.array(c, k) for c, k in zip(columns, (long, pa.binary(), long, long, long), strict=True)]
            yield pa.RecordBatch.from_arrays([keys, *arrays], names=["key", "n_bytes", "ids", "n_pieces", "n_fallback", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    light = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    found = light.mapInArrow(run, f"key {kind}, n_bytes long, ids binary, n_pieces long, n_fallback long, ids_crc32 long")
    return found.withColumnRenamed("key", key)


def decode(encoded: DataFrame, model: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """The rows of encoded with the text that their packed ids stand for; null ids give a null text, none an empty one."""

    def run(batches):
        import pyarrow as pa

        one = encoder(model)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = [None if x is None else one.decode(x).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, `{into}` string")
