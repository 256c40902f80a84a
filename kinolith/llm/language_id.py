"""Language identification by prediction by partial matching.

For each language, a tree of byte contexts of up to ORDER bytes holds how often
each byte followed. A byte costs -log2 of its share in the longest context
known; where it was not seen, the escape probability (distinct followers over
followers and distinct followers) is paid and a shorter context is asked, down
to all bytes alike. Statistics are frozen after learning, and contexts begin at
the start of a word, so the code length of a text is the sum over its words:
each distinct word is scored once a worker and the sums stay exact.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolith.llm.shared import add_columns, forget, kept, utf8_rows
from kinolith.llm.token_counts import LONGEST_CACHED, segments

ORDER = 4
#: About so many labelled documents of each language are learned from.
SAMPLE_DOCUMENTS = 2_000
#: Languages a model may have; its costs have a column for each.
MOST_LANGUAGES = 256
#: Bytes of distinct words from which the rate of a text's code means something.
LEAST_LETTERS = 16
CHUNK_CACHE = 500_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = 257


def letters(chunk: bytes) -> list[bytes]:
    """The words of a piece of text: runs of letters, in lower case; signs like \u00b2 or \u2167 are none."""
    found = []
    for word in _WORD.findall(chunk.decode("utf-8", "replace").lower()):
        if word.isalpha():
            found.append(word.encode())
        else:
            found += (w.encode() for w in "".join(c if c.isalpha() else " " for c in word).split())
    return found


def grams_of(words: Counter) -> Counter:
    """How often each byte follows each context of up to ORDER bytes in the words."""
    found: Counter = Counter()
    for word, times in words.items():
        marked = b" " + word + b" "
        for order in range(ORDER + 1):
            for i in range(max(1, order), len(marked)):
                found[marked[i - order : i + 1]] += times
    return found


class Model:
    """Frozen context trees of all languages, as sorted tables of byte strings by length.

    contexts[k] are the known contexts of k bytes with each language's escape
    cost; grams[k] the known (context, byte) with each language's whole cost.
    """

    def __init__(self, languages: list[str], counted: dict[str, dict[bytes, int]]):
        self.languages = languages
        many = len(languages)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        for order in range(ORDER + 1):
            seen = [{g: n for g, n in counted[language].items() if len(g) == order + 1} for language in languages]
            grams = sorted(set().union(*seen))
            contexts = sorted({g[:-1] for g in grams})
            where = {c: i for i, c in enumerate(contexts)}
            own = np.array([where[g[:-1]] for g in grams], np.int64)
            escape = np.zeros((len(contexts), many))
            cost = np.zeros((len(grams), many))
            for at, counts in enumerate(seen):
                count = np.array([counts.get(g, 0) for g in grams], float)
                total = np.bincount(own, count, len(contexts))
                distinct = np.bincount(own, count > 0, len(contexts))
                known = total > 0
                escape[known, at] = -np.log2(distinct[known] / (total[known] + distinct[known]))
                hit = count > 0
                cost[hit, at] = -np.log2(count[hit] / (total + distinct)[own[hit]])
                if order == 0:
                    shorter = np.full(len(grams), np.log2(_SYMBOLS))
                else:
                    shorter = self._look(self.grams[order - 1], np.array([_key(g[1:]) for g in grams], np.uint64))[1][:, at]
                cost[~hit, at] = escape[own[~hit], at] + shorter[~hit]
            self.contexts.append((np.array([_key(c) for c in contexts], np.uint64), escape))
            self.grams.append((np.array([_key(g) for g in grams], np.uint64), cost))
        for tables in (self.contexts, self.grams):
            for k, (keys, values) in enumerate(tables):
                order = np.argsort(keys)
                tables[k] = (keys[order], values[order])

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys a table has, and its rows for them (0 for the others)."""
        names, values = table
        if not len(names):
            return np.zeros(len(keys), bool), np.zeros((len(keys), values.shape[1]))
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        known = names[at] == keys
        return known, np.where(known[:, None], values[at], 0.0)

    def code_lengths(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word in each language."""
        if not words:
            return np.zeros((0, len(self.languages)))
        marked = [b" " + w + b" " for w in words]
        raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
        sizes = np.array([len(m) for m in marked])
        ends = np.cumsum(sizes)
        place = np.arange(len(raw)) - np.repeat(ends - sizes, sizes)  # bytes before this one in its word
        bits = np.zeros((len(raw), len(self.languages)))
        open_ = place > 0
        for order in range(ORDER, -1, -1):
            at = np.flatnonzero(open_ & (place >= order))
            if not len(at):
                continue
            context = np.full(len(at), 1, np.uint64)
            for back in range(order, 0, -1):
                context = (context << np.uint64(8)) | raw[at - back]
            known, cost = self._look(self.grams[order], (context << np.uint64(8)) | raw[at])
            bits[at[known]] += cost[known]
            open_[at[known]] = False
            rest = ~known
            bits[at[rest]] += self._look(self.contexts[order], context[rest])[1]
        bits[open_] += np.log2(_SYMBOLS)
        return np.add.reduceat(bits, ends - sizes, axis=0)


def _key(gram: bytes) -> int:
    return int.from_bytes(b"\x01" + gram, "big")


class Scorer:
    """Code lengths of texts; those of distinct chunks between white space are kept, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.used = 0
        self.bits = np.zeros((1 << 12, len(self.model.languages) + 1))  # last: bytes of letters

    def _learn(self, fresh: list[bytes]) -> None:
        words = [letters(c) for c in fresh]
        flat = [w for ws in words for w in ws]
        bits = self.model.code_lengths(flat)
        owner = np.repeat(np.arange(len(fresh)), [len(ws) for ws in words])
        need = self.used + len(fresh)
        if need > len(self.bits):
            self.bits = np.concatenate([self.bits, np.zeros((max(need, 2 * len(self.bits)) - len(self.bits), self.bits.shape[1]))])
        new = self.bits[self.used : need]
        new[:] = 0
        np.add.at(new, owner, np.column_stack([bits, [len(w) for w in flat]]) if flat else np.zeros((0, new.shape[1])))
        self.rows.update(zip(fresh, range(self.used, need), strict=True))
        self.used = need

    def score(self, text: bytes) -> np.ndarray:
        total = np.zeros(self.bits.shape[1])
        for part in segments(text):
            chunks = part.split()
            fresh = list({c for c in chunks if c not in self.rows})
            if fresh:
                if len(self.rows) + len(fresh) > CHUNK_CACHE or any(len(c) > LONGEST_CACHED for c in fresh):
                    long = [c for c in fresh if len(c) > LONGEST_CACHED]
                    if len(self.rows) + len(fresh) > CHUNK_CACHE:
                        self.clear()
                        fresh = list(set(chunks))
                    self._learn(fresh)
                    total += self.bits[np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))].sum(axis=0)
                    for c in long:
                        self.rows.pop(c, None)
                    continue
                self._learn(fresh)
            if chunks:
                total += self.bits[np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))].sum(axis=0)
        return total


def enough_letters(text: bytes) -> bool:
    """Whether the distinct words of a text have LEAST_LETTERS bytes; looks no further than it must."""
    seen: set[bytes] = set()
    size = 0
    for part in segments(text, 64):  # a few words are enough as a rule
        for word in letters(part):
            if word not in seen:
                seen.add(word)
                size += len(word)
        if size >= LEAST_LETTERS:
            return True
    return False


def held_out(key: str):
    """Documents kept from learning: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", label: str = "lang") -> Model:
    """Context trees from a bounded sample of the labelled documents that are not held out.

    About SAMPLE_DOCUMENTS of each language, drawn by a hash of the key; all of
    what they hold is counted, in Spark, and the driver gets how often each byte
    followed each context. A table may have MOST_LANGUAGES labels.
    """
    labelled = docs.select(
        F.col(key).alias("key"), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label")
    ).where(F.col("label").isNotNull() & ~held_out("key"))
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], {})
    shares = F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, SAMPLE_DOCUMENTS / n))))
    drawn = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) / 1_000_003 < F.element_at(shares, F.col("label")))

    def count(batches):
        import pyarrow as pa

        forget()
        words: dict[str, Counter] = {}
        for batch in batches:
            for text, name in utf8_rows(batch, "text", "label"):
                for part in segments(text):
                    words.setdefault(name, Counter()).update(letters(part))
        for name, own in words.items():
            grams = grams_of(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(grams), pa.string()), pa.array(list(grams), pa.binary()), pa.array(list(grams.values()), pa.int64())],
                names=["label", "gram", "n"],
            )

    counted = drawn.where("text is not null").select("text", "label").mapInArrow(count, "label string, gram binary, n long")
    counted = counted.groupBy("label", "gram").agg(F.sum("n").alias("n"))
    grams: dict[str, dict[bytes, int]] = {language: {} for language in languages}
    for row in counted.toLocalIterator():
        grams[row["label"]][bytes(row["gram"])] = row["n"]
    return Model(languages, grams)


def identify(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, held_out, lang_pred, score.

    The language with the shortest code length wins, equal lengths go to the
    first in alphabetical order; score is its share when every language's
    probability of the text is weighed. A null text or one without a letter is
    `und` with score 0, as is everything if nothing was learned. Only the text
    is looked at, whole and in segments, so that very long texts take no more
    memory than others; rows are neither joined nor grouped, repeated rows get
    equal answers, and an empty table gives an empty result.
    """
    light = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    found = with_language(light, model)
    return found.select(F.col("key").alias(key), held_out("key").alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """The rows of docs with lang_pred and score, as identify() gives them, and bits_per_byte, under the names given.

    bits_per_byte is what the best language's code spends on a byte of the
    text's letters, the same for a text and its repetition. Plain bytes take 8.
    It is 0 if nothing was learned or there is no letter, and where the distinct
    words have fewer than LEAST_LETTERS bytes, which say too little. All other
    columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_DOCUMENTS and MOST_LANGUAGES
    name_of_model = uuid.uuid4().hex

    def predict(batch):
        import pyarrow as pa

        scorer = kept(f"scorer {name_of_model}", lambda: Scorer(shared.value))
        languages = scorer.model.languages
        found, scores, rates = [], [], []
        for (text,) in utf8_rows(batch, "text"):
            bits = scorer.score(text or b"")
            if not languages or bits[-1] == 0:
                found.append(UNKNOWN)
                scores.append(0.0)
                rates.append(0.0)
                continue
            lengths = bits[:-1]
            best = int(lengths.argmin())
            found.append(languages[best])
            scores.append(float(1 / np.exp2(np.maximum(lengths[best] - lengths, -1000)).sum()))
            rates.append(float(lengths[best] / bits[-1]) if enough_letters(text) else 0.0)
        return [pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]

    return add_columns(docs, list(zip(names, ("string", "double", "double"), strict=True)), predict)
