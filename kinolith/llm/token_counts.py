"""Token counts of whole texts by a vocabulary file of the tokenizers library.

White space never gets into a token of these vocabularies, so a text may be
cut at any ASCII white space without changing its tokens: no normaliser rule,
split rule or special string reaches across it. Encoding goes through that cut:
a text becomes chunks between white space, known chunks come from a bounded
cache, and new ones go to the library in large batches.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolith.llm.shared import by_bytes, kept, utf8_rows

BATCH_BYTES = 1 << 20
SEGMENT_BYTES = 1 << 18
#: Entries of each of two generations; what an older one has moves up when it is met again.
CHUNK_CACHE = 400_000
WORD_CACHE = 300_000
LONGEST_CACHED = 48

# Latin-1 text in which Python and the library agree on letters, digits, white
# space and case; no bracket of a special string.
_PLAIN = re.compile("[\x00-\x1b\x20-\x3b\x3d-\x7f\xa1-\xb4\xb6-\xff]*")
_WORD = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^ \t-\ra-z\xaa\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)
_SPACE = re.compile(rb"[ \t-\r]")


def segments(text: bytes, limit: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """Cut a long text at white space into parts of about limit bytes."""
    at = 0
    while len(text) - at > limit:
        cut = _SPACE.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


class CachedEncoder:
    """Token ids of UTF-8 texts, packed little-endian; equal to the library's."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.code = "H" if max(vocabulary.values()) < 65536 else "I"
        self.width = array.array(self.code).itemsize
        self.word_end = {i for token, i in vocabulary.items() if token.endswith("</w>")}
        self.chunks: dict[bytes, bytes] = {}
        self.old_chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text; call it with about BATCH_BYTES at a time."""
        parts = [[part.split() for part in segments(text)] for text in texts]
        if len(self.chunks) > CHUNK_CACHE:
            self.chunks, self.old_chunks = {}, self.chunks
        known, older = self.chunks, self.old_chunks
        long: dict[bytes, bytes] = {}
        met = set()
        for text in parts:
            for part in text:
                met.update(part)
        fresh = []
        for chunk in met:
            if chunk not in known:
                if chunk in older:
                    known[chunk] = older[chunk]
                else:
                    fresh.append(chunk)
        if fresh:
            for chunk, ids in self._learn(fresh):
                (known if len(chunk) <= LONGEST_CACHED else long)[chunk] = ids
        get = known.__getitem__
        if long:
            get = lambda chunk: known[chunk] if chunk in known else long[chunk]
        return [b"".join([b"".join(map(get, part)) for part in text]) for text in parts]

    def _learn(self, fresh: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        plain, odd, new = [], [], set()
        for chunk in fresh:
            text = chunk.decode("utf-8", "replace")
            if len(chunk) <= LONGEST_CACHED and _PLAIN.fullmatch(text):
                words = _WORD.findall(text.lower())
                plain.append((chunk, words))
                new.update(words)
            else:
                odd.append((chunk, text))
        if len(self.words) > WORD_CACHE:
            self.words, self.old_words = {}, self.words
        known, older = self.words, self.old_words
        unknown = []
        for word in new:
            if word not in known:
                if word in older:
                    known[word] = older[word]
                else:
                    unknown.append(word)
        self._learn_words(unknown)
        get, pack = self.words.__getitem__, array.array
        for chunk, words in plain:
            yield chunk, b"".join(map(get, words))
        if odd:
            found = self.library.encode_batch_fast([t for _, t in odd], add_special_tokens=False)
            for (chunk, _), one in zip(odd, found, strict=True):
                yield chunk, pack(self.code, one.ids).tobytes()

    def _learn_words(self, new: list[str]) -> None:
        """Many words in one text each time; a token with the end mark closes a word."""
        groups = [new[i : i + 256] for i in range(0, len(new), 256)]
        found = self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, one in zip(groups, found, strict=True):
            ids, ends = one.ids, self.word_end
            packed = array.array(self.code, ids).tobytes()
            cuts = [i + 1 for i, token in enumerate(ids) if token in ends]
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                raise ValueError("this vocabulary does not mark the end of words")
            width, at = self.width, 0
            for word, cut in zip(group, cuts, strict=True):
                self.words[word] = packed[at * width : cut * width]
                at = cut


def encoder(path: str) -> CachedEncoder:
    """One encoder a Python worker and vocabulary file; workers are reused by later tasks."""
    return kept(f"tokens {path}", lambda: CachedEncoder(path))


def encoded_rows(rows: Iterable[tuple], path: str) -> Iterator[tuple]:
    """(…, text) rows with the text replaced by its packed ids, batched by bytes."""
    one = encoder(path)
    for group in by_bytes(rows, BATCH_BYTES, lambda r: len(r[-1] or b"") + 64):
        for row, ids in zip(group, one.encode([r[-1] or b"" for r in group]), strict=True):
            yield (*row[:-1], ids)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens, not over the limit). Rows
    are neither joined nor grouped: repeated keys give repeated rows, an empty
    table gives an empty result, other columns are ignored. Texts of any length
    are taken whole; they are cut at white space, where no token can reach
    across. tokenizer is the path of a vocabulary file that each executor has.
    """

    def count(batches):
        import pyarrow as pa

        width = encoder(tokenizer).width
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key"))
            texts = ((text,) for (text,) in utf8_rows(batch, "text"))
            lengths = [len(ids) // width for (ids,) in encoded_rows(texts, tokenizer)]
            bytes_ = batch.column(batch.schema.get_field_index("n_bytes"))
            yield pa.RecordBatch.from_arrays(
                [keys, bytes_, pa.array(lengths, pa.int64())], names=["key", "n_bytes", "n_tokens"]
            )

    kind = docs.schema[key].dataType
    light = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("text").cast("string").alias("text"),
    )
    counted = light.mapInArrow(count, f"key {kind.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
