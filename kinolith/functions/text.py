"""String expressions: truncation, residues, mutation codes, tokens, redaction, sentences."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
MUTATION = r"[A-Z]\d+[A-Z]"


def nullish(text: Column) -> Column:
    """True for null, blank and the spellings of a missing value."""
    return text.isNull() | F.lower(F.trim(text)).isin("", "nan", "none", "-")


def head_tail(text: Column, limit: int) -> Column:
    """The first and last limit // 2 characters of longer texts; others unchanged."""
    half = limit // 2
    cut = F.concat(F.substring(text, 1, half), F.right(text, F.lit(half))) if half else F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, cut).otherwise(text)


def head_tail_items(items: Column, limit: int) -> Column:
    """The first and last limit // 2 items of longer arrays."""
    half = limit // 2
    return F.when(F.size(items) > limit, F.concat(F.slice(items, 1, half), F.slice(items, -half, half))).otherwise(items)


def prefix(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def short_digest(text: Column, size: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, size)


def before_underscore(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def rare_residues_to_x(sequence: Column) -> Column:
    return F.translate(sequence, "UZOB", "XXXX")


def spaced(sequence: Column) -> Column:
    return F.array_join(F.split(sequence, ""), " ")


def characters(text: Column) -> Column:
    """Array of characters; empty for an empty text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def offending(sequence: Column, alphabet: str = RESIDUES) -> Column:
    """Sorted distinct characters outside an alphabet of letters."""
    return F.array_sort(F.array_distinct(characters(F.regexp_replace(sequence, f"[{alphabet}]", ""))))


def in_alphabet(sequence: Column, alphabet: str = RESIDUES, fold: bool = False) -> Column:
    return (F.upper(sequence) if fold else sequence).rlike(f"^[{alphabet}]*$")


def mutation_codes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MUTATION), F.lit(0))


def joined_codes(text: Column) -> Column:
    return F.array_join(mutation_codes(text), "/")


def apply_mutations(sequence: Column, codes: Column) -> Column:
    """sequence with codes like A12G applied in order; null where a reference residue differs."""

    def step(text: Column, code: Column) -> Column:
        at = F.regexp_extract(code, r"\d+", 0).cast("int")
        same = F.substring(text, at, F.lit(1)) == F.substring(code, 1, 1)
        return F.when(same, F.overlay(text, F.right(code, F.lit(1)), at)).otherwise(F.lit(None).cast("string"))

    return F.aggregate(codes, sequence, step)


def inferred_mutations(before: Column, after: Column) -> Column:
    """Codes of the positions at which two aligned strings differ."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(before), F.length(after))))
    codes = F.transform(
        at, lambda i: F.concat(F.substring(before, i, F.lit(1)), i.cast("string"), F.substring(after, i, F.lit(1)))
    )
    return F.filter(codes, lambda c: F.left(c, F.lit(1)) != F.right(c, F.lit(1)))


def ngrams(sequence: Column, n: int, begin: str = "-", end: str = "=") -> Column:
    """Character n-grams of a sequence between sentinels."""
    marked = F.concat(F.lit(begin), sequence, F.lit(end))
    count = F.length(marked) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(marked, i, F.lit(n)))
    return F.filter(grams, lambda g: F.length(g) == n)


#: Two-letter atoms that stay whole. Fixed values.
ATOMS = ("Ag", "Al", "As", "Au", "Ba", "Be", "Bi", "Br", "Ca", "Cl", "Cu", "Fe", "He", "Kr", "Li", "Mg", "Mn", "Na", "Ni", "Ra", "Rb", "Se", "Si", "Sr", "Te", "Xe", "Zn", "se", "si", "te")


def smiles_tokens(smiles: Column) -> Column:
    """Tokens of a line notation: ring numbers after %, two-letter atoms, charges above one, else characters."""
    pattern = f"(?s)%.{{0,2}}|{'|'.join(ATOMS)}|[+-][234]|."
    return F.regexp_extract_all(smiles, F.lit(pattern), F.lit(0))


def padded_ids(tokens: Column, ids: Column, size: int = 220, pad: int = 0, unknown: int = 1, end: int = 2, start: int = 3) -> Column:
    """Ids of tokens between start and end marks, cut in the middle and padded to size."""
    kept = head_tail_items(tokens, size - 2)
    known = F.transform(kept, lambda t: F.coalesce(F.try_element_at(ids, t), F.lit(unknown)))
    whole = F.concat(F.array(F.lit(start)), known, F.array(F.lit(end)))
    return F.concat(whole, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), size - F.size(whole))))


#: Rules for log lines, in the order in which they apply. Fixed values.
TEMPORARY = (
    (r"/tmp/tmp[a-zA-Z0-9_]+/queryDB(?:_h)?", "[TMP_QUERY_DB]"),
    (r"/tmp/tmp[a-zA-Z0-9_]+/resultDB(?:_h)?", "[TMP_RESULT_DB]"),
    (r"/tmp/tmp[a-zA-Z0-9_]+/result\.m8", "[TMP_RESULT_M8]"),
    (r"/tmp/tmp[a-zA-Z0-9_]+", "[TMP_DIR]"),
    (r"/tmp/[^\s]+", "[TMP]"),
)
LABELS = (
    (r"\bqueryDB_h\b", "[QUERY_DB_H]"),
    (r"\bresultDB_h\b", "[RESULT_DB_H]"),
    (r"\bqueryDB\b", "[QUERY_DB]"),
    (r"\bresultDB\b", "[RESULT_DB]"),
    (r"\bresult\.m8\b", "[RESULT_M8]"),
    (r"\bpref_\d+\b", "[PREF_DB]"),
)
GENERAL = (
    (r"(?:/home/[^/\s]+/anaconda3/bin/conda|/opt/conda/bin/conda)", "[CONDA]"),
    (r"/home/[^/\s]+", "[HOME]"),
    (r"(?<![\w.-])/(?:[^\s]+)", "[PATH]"),
)


def redacted_line(line: Column, targets: Mapping[str, str] | None = None, folders: Mapping[str, str] | None = None) -> Column:
    """A log line without paths.

    targets are known databases by name: their paths, and then their file
    names as words, become TARGET_DB(name). folders are path prefixes with
    their labels, longest first. Then come the rules above, in order.
    """
    for name, path in (targets or {}).items():
        label = f"TARGET_DB({name})"
        line = F.replace(line, F.lit(path), F.lit(label))
        base = path.rstrip("/").rsplit("/", 1)[-1]
        line = F.regexp_replace(line, rf"\b{re.escape(base)}\b", label)
    for folder in sorted(folders or {}, key=len, reverse=True):
        line = F.replace(line, F.lit(folder), F.lit(folders[folder]))
    for pattern, label in (*TEMPORARY, *LABELS, *GENERAL):
        line = F.regexp_replace(line, pattern, label)
    return line


def first_address(forwarded: Column) -> Column:
    """The first address of a comma-separated forwarding header."""
    return F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))


def provenance(from_a: Column, from_b: Column, from_c: Column, names: Sequence[str]) -> Column:
    """Name of the first flag that is 1."""
    return F.when(from_a == 1, names[0]).when(from_b == 1, names[1]).when(from_c == 1, names[2]).otherwise("Unknown")


def sentence(*parts: Column) -> Column:
    """The parts that are not null, joined by a full stop."""
    return F.concat_ws(". ", *parts)


def multi_hot(positions: Column, size: Column) -> Column:
    """0/1 array with ones at the 0-based positions of a comma list."""
    at = F.transform(F.split(positions, ","), lambda p: F.expr("0") + F.try_to_number(F.trim(p), F.lit("999999")).cast("int"))
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(F.array_contains(at, i), 1).otherwise(0))


def joined_key(*parts: Column, separator: str = "&") -> Column:
    """The parts as one key; a separator or backslash inside a part is escaped, so different parts never give one key."""
    escaped = [F.replace(F.replace(p.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit(separator), F.lit("\\" + separator)) for p in parts]
    return F.concat_ws(separator, *[F.coalesce(e, F.lit("")) for e in escaped])


def nested_parts(text: Column, outer: str = "|", inner: str = ",") -> Column:
    """All parts of a list of lists, in order."""
    return F.flatten(F.transform(F.split(text, f"\\Q{outer}\\E"), lambda x: F.split(x, inner)))


def letter_codes(text: Column, alphabet: str, size: int) -> Column:
    """Places of the characters in an alphabet, from 1, filled up with 0 on the left to size; unknown ones are 0, longer texts keep their end."""
    codes = F.transform(characters(text), lambda c: F.instr(F.lit(alphabet), c))
    whole = F.concat(F.array_repeat(F.lit(0), size), codes)
    return F.slice(whole, -size, size)


def from_letter_codes(codes: Column, alphabet: str) -> Column:
    """The text of letter_codes(), without what it left out."""
    return F.array_join(F.transform(F.filter(codes, lambda i: i > 0), lambda i: F.substring(F.lit(alphabet), i, F.lit(1))), "")


def metabolite_type(text: Column) -> Column:
    """KEGG (C or D and five digits), InChI, SMILES or invalid, by form only.

    A SMILES has letters, digits and its signs alone, and as many opening as closing brackets.
    """
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    signs = text.rlike(r"^[A-Za-z0-9@+\-\[\]()=#$%/\\.:*~]+$") & text.rlike("[A-Za-z]")
    balanced = (count("(") == count(")")) & (count("[") == count("]"))
    return (
        F.when(text.rlike(r"^[CD]\d{5}$"), "KEGG").when(F.startswith(text, F.lit("InChI=")), "InChI").when(signs & balanced, "SMILES").otherwise("invalid")
    )


def reaction(left: Column, right: Column) -> Column:
    """`a.b>>c` of two arrays; null where a side is empty or has an invalid part."""
    fine = lambda side: (F.size(side) > 0) & F.forall(side, lambda x: metabolite_type(x) != "invalid")
    return F.when(fine(left) & fine(right), F.concat(F.array_join(left, "."), F.lit(">>"), F.array_join(right, ".")))
