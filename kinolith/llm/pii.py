"""Personal data: fixed patterns, and candidates chosen by boosted trees.

Generators with high recall propose spans that may overlap: written-out mail
addresses, numbers in groups, account and hardware-address-like strings. Each
gets features of its format and of the words around it, boosted trees score
it, and a calibrated threshold decides. The trees are trained here, on a
bounded set of labelled lines made from templates (TRAINING_LINES).
"""

from __future__ import annotations

import bisect
import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinolith.llm.boosting import BoostedTrees
from kinolith.llm.shared import add_columns

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the trees propose.
MODEL_KINDS = ("written_email", "number", "account", "ipv6")
KINDS = BASE_KINDS + MODEL_KINDS
TRAINING_LINES = 6_000
THRESHOLD = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_ANY = re.compile(r"[0-9@]")

_GENERATORS = {
    "written_email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at |\{at\}) ?[A-Za-z0-9-]{1,63}"
        r"(?: ?(?:\(dot\)|\[dot\]| dot |\{dot\}|\.) ?[A-Za-z0-9-]{1,63}){1,6}"
    ),
    "number": re.compile(r"(?<![0-9A-Za-z.@+])\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,18}(?![0-9A-Za-z@])"),
    "account": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "ipv6": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])"),
}
_CONTEXT = (
    re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|tél|téléphone|teléfono|whatsapp|sms)\b"),
    re.compile(r"(?i)\b(?:ssn|social|security|passport|licen[cs]e|insurance|tax|national|patient|born|birth|dob)\b"),
    re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|transfer|pay)\b"),
    re.compile(r"(?i)\b(?:mail|email|e-mail|contact|write|reach|courriel|correo)\b"),
    re.compile(r"(?i)\b(?:order|invoice|version|isbn|page|part|ref|item|serial|build|total|price|sku|ticket|id|no|nr)\b|[$€£#]"),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@label(.label)+`, found from their @ so that long words cost nothing."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four fixed kinds, by kind and then start."""
    found: list[tuple[str, int, int]] = []
    if not _ANY.search(text):
        return found
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that the generators propose; they may overlap."""
    found: list[tuple[str, int, int]] = []
    digits = _ANY.search(text) is not None
    for kind, pattern in _GENERATORS.items():
        if kind == "written_email":
            if not (" at " in text or "at)" in text or "at]" in text or "at}" in text):
                continue
        elif not digits or (kind == "ipv6" and text.count(":") < 3):
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return found


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of a span."""
    hit = text[start:end]
    digits = _NOT_DIGIT.sub("", hit)
    groups = [g for g in re.split(r"[^0-9A-Za-z]+", hit) if g]
    sizes = [len(g) for g in groups] + [0, 0, 0, 0]
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    account = hit.replace(" ", "")
    checked = 0.0
    if kind == "account":
        turned = "".join(str(int(c, 36)) for c in account[4:] + account[:4])
        checked = float(int(turned) % 97 == 1)
    year = float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}", groups[0] if groups else "")) or bool(re.fullmatch(r"(?:19|20)[0-9]{2}", groups[-1] if groups else "")))
    return [
        float(MODEL_KINDS.index(kind)), float(len(hit)), float(len(digits)), float(len(groups)), *map(float, sizes[:4]),
        float(hit.count(" ")), float(hit.count("-")), float(hit.count(".")), float(hit.count("/")), float("(" in hit),
        float(hit[:1] == "0"), year, checked, float(luhn(digits) if digits else False),
        float(re.search(r"[(\[{]at", hit) is not None), float(re.search(r"[.] | [.]", hit) is not None), float(re.search(r"(?i) (?:at|dot) (?:the|an?|this|that|each|every|his|her|its|is|on|of|in|and|to)\b", hit) is not None),
        float(re.search(r"(?:\.| |\)|\]|\})(?:com|org|net|edu|gov|info|biz|io|eu|co|uk|de|fr|es|it|nl|ch|at|us|ca|au)\Z", hit) is not None), float(len(groups[-1]) if groups else 0), float(re.search(r"(?i) dot |[(\[{]dot", hit) is not None),
        *(float(p.search(before) is not None) for p in _CONTEXT),
        float(before[-1:].isalnum()), float(after[:1] in ("%", "€", "$")), float(len(set(digits))),
    ]


def _filled(rng: random.Random, form: str) -> str:
    """A template with d for a digit, A for a capital, a for a letter, x for a hex digit; what stands in <> stays."""
    made = {"d": "0123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz", "x": "0123456789abcdef"}
    parts = re.split(r"<([^>]*)>", form)
    return "".join(p if i % 2 else "".join(rng.choice(made[c]) if c in made else c for c in p) for i, p in enumerate(parts))


def training_lines(count: int = TRAINING_LINES, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates in lines made from templates, half of them personal data."""
    rng = random.Random(seed)
    lead = ("phone ", "call me at ", "tel: ", "mobile ", "my number is ", "Telefon ")
    record = ("ssn ", "social security number ", "patient ", "born ", "passport ")
    bank = ("IBAN ", "account ", "transfer to ", "Konto ")
    mail = ("mail me: ", "contact ", "write to ", "email ", "")
    plain = ("order ", "invoice no ", "version ", "isbn ", "item ", "total $", "ref ", "page ", "serial ", "build ", "", "", "and ", "in the ")
    written = tuple(
        f.replace("~", f"<{end}>")
        for f in (
            "aaaa.aaaa (<at>) aaaaaa (<dot>) ~", "aaaaa [<at>] aaaaaa [<dot>] ~", "aaaa <at> aaaaaa <dot> ~", "aaaadd(<at>)aaaaa(<dot>)~", "aaaa {<at>} aaaaaa {<dot>} ~",
            "aaaa (<at>) aaaaaa.~", "aaaa.aaaaa[<at>]aaaaaaa.~", "aaaaa_aa <at> aaa-aaaa <dot> aa <dot> ~", "aaaaaa (<at>) aaaaaaa <dot> ~",
        )
        for end in ("com", "org", "net", "edu", "de", "fr", "co.uk", "info", "aa", "aaa")
    )
    written = tuple(f.replace("<aa>", "aa").replace("<aaa>", "aaa") for f in written)
    prose = (
        "aaaa <at> aaaa. aaaaaaa", "aaa <at> aaa.aaa", "aaaaa <at> aaaaaa.aaaa", "aaaa <at> aaaa. <The dot is>", "aaaaa <at> aaaaaa. <A dot> aaaa", "aaaa <at> aaaa.<Then dot> aaaaa",
        "aaaa <at the dot on>", "aaaaa <at the> aaaa <dot in>", "aaaa <at a dot of>", "aaaa <at each dot and>", "aaaa <at this dot> aaaaaa", "aaaa <at the dot> aaaaa", "aaaa <at> aaaaa <dot> aaaaaaa",
    )
    yes = (
        ("number", lead, ("ddd-ddd-dddd", "(ddd) ddd-dddd", "ddd.ddd.dddd", "0dd dddddddd", "0d dd dd dd dd", "0ddd/ddddddd")),
        ("number", record, ("ddd-dd-dddd", "dd ddd ddd ddd")),
        ("written_email", mail, written),
        ("ipv6", ("from ", "host ", ""), ("xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx",)),
    )
    no = (
        ("number", plain, ("dddddddd", "dddddddddddd", "dddddddddddddddd", "d.d.d.d.d.d.d", "dddd-dd-dd", "dd/dd/dddd", "ddd-d-dd-dddddd-d", "dd.dd.dddd", "ddd ddd ddd", "dd-dd-dd-dd", "ddd-dd-dddd", "dddddd-dddddd")),
        ("account", plain, ("AAddAAAAdddd", "AAddddddAAAA", "AAdd dddd dddd")),
        ("written_email", ("look ", "was ", ""), prose),
        ("ipv6", ("at ", "time ", "ratio "), ("dd:dd:dd:dd", "d:d:d:d", "dd:dd:dd:dd:dd")),
    )
    x, y = [], []
    fill = ("the of and ", "ther ing was ", "", "den von und ", "que los de ")
    for i in range(count):
        label = i % 2
        if label and rng.random() < 0.2:
            kind, before = "account", rng.choice(bank)
            body = _filled(rng, "dddddddddddddddddd")
            country = rng.choice(("DE", "FR", "ES", "GB"))
            check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
            hit = f"{country}{check:02d}{body}"
        else:
            kind, leads, forms = rng.choice(yes if label else no)
            before = rng.choice(leads)
            hit = _filled(rng, rng.choice(forms))
        text = rng.choice(fill) + before + hit + rng.choice((" and more", ".", ", then", ""))
        start = text.index(hit)
        for k, s, e in candidates(text):
            if k == kind and s <= start + 1 and e >= start + len(hit) - 1:
                x.append(describe(text, k, s, e))
                y.append(label)
                break
    return np.array(x), np.array(y, float)


@functools.cache
def trained() -> BoostedTrees:
    """Trees from half of the training lines, calibrated on the other half."""
    x, y = training_lines()
    half = np.arange(len(y)) // 2 % 2 == 0
    return BoostedTrees().fit(x[half], y[half]).calibrate(x[~half], y[~half])


def _covered(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _free(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    """Whether a span meets none of the disjoint spans."""
    at = bisect.bisect_left(starts, end) - 1
    return at < 0 or ends[at] <= start


def model_spans(text: str, model: BoostedTrees, base: list[tuple[str, int, int]], threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """Candidates outside base spans whose calibrated probability reaches the threshold, best first where they overlap."""
    taken = _covered(base)
    free = [c for c in candidates(text) if _free(*taken, *c[1:])]
    if not free:
        return []
    p = model.probability(np.array([describe(text, *c) for c in free]))
    chosen: list[tuple[str, int, int]] = []
    starts: list[int] = []
    ends: list[int] = []
    for i in sorted(range(len(free)), key=lambda i: (-p[i], free[i][1], free[i][0])):
        if p[i] < threshold:
            break
        if _free(starts, ends, *free[i][1:]):
            at = bisect.bisect_left(starts, free[i][1])
            starts.insert(at, free[i][1])
            ends.insert(at, free[i][2])
            chosen.append(free[i])
    return sorted(chosen, key=lambda s: (KINDS.index(s[0]), s[1]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, or union of spans that overlap, replaced by the kind of its first in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def count_of(spans: str, kind: str) -> Column:
    """How many spans of a column are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: key, base and found (arrays of kind, start, end), redacted (the text without them).

    Positions are code points, ends exclusive. Base kinds are email, ip, card
    and phone; found also has what the trees chose. A null text has no spans
    and stays null, an empty one has none, an empty table gives no rows. Whole
    texts are searched, very long ones too, with memory for themselves; rows are
    neither joined nor grouped, so repeated rows and hot sources cost nothing
    extra. Candidates that overlap a base span are left out; of those that
    overlap each other the likeliest stays, the earlier of equals. Written
    addresses are looked for with up to 64 characters before and six parts
    behind the sign. Other columns are ignored.
    """
    model = trained()  # a few kilobytes

    def search(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            base, found, clean = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                fixed = base_spans(text or "")
                chosen = model_spans(text or "", model, fixed, threshold)
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in fixed])
                found.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in fixed + chosen])
                clean.append(text if text is None or not (fixed or chosen) else redacted(text, fixed + chosen))
            keys = batch.column(batch.schema.get_field_index("key"))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(base, span), pa.array(found, span), pa.array(clean, pa.string())],
                names=["key", "base", "found", "redacted"],
            )

    kind = docs.schema[key].dataType.simpleString()
    spans = "array<struct<kind: string, start: int, end: int>>"
    light = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    found = light.mapInArrow(search, f"key {kind}, base {spans}, found {spans}, redacted string")
    return found.withColumnRenamed("key", key)


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with the text's personal data replaced by its kind in brackets; all columns stay.

    Null and empty texts stay as they are, an empty table is one; very long
    texts are taken whole, repeated rows alike. Overlaps are settled as in find().
    """
    model = trained()

    def clean(batch):
        import pyarrow as pa

        texts = []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            if text:
                fixed = base_spans(text)
                spans = fixed + model_spans(text, model, fixed, threshold)
                text = redacted(text, spans) if spans else text
            texts.append(text)
        return [pa.array(texts, pa.string())]

    return add_columns(docs, [("text", "string")], clean)
