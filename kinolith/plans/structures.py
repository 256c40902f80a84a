"""Structures in line notation, derived from part names: rings with a side chain, written from either end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolith.functions import arrays
from kinolith.operators import line_notation, score
from kinolith.operators.staging import settled
from kinolith.plans.base import query, spread, table

_LETTERS, _ATOMS = "abcdefghijklmnopqrstuvwxyz", "CNCSCOCCCCCNCOCCCCSCCCCCCO"
_NOTATIONS_SQL = f"""n as (select p_partkey as id, translate(lower(split_part(p_name, ' ', 1)), '{_LETTERS}', '{_ATOMS}') as x, translate(lower(split_part(p_name, ' ', 2)), '{_LETTERS}', '{_ATOMS}') || case when p_partkey % 3 = 0 then 'N' else '' end as y, p_partkey % 7 = 0 as broken from part)"""


def notations(spark, sf_dir) -> DataFrame:
    """id and smiles; every seventh has a bracket too many."""
    word = lambda i: F.translate(F.lower(F.split_part("p_name", F.lit(" "), F.lit(i))), _LETTERS, _ATOMS)
    key = F.col("p_partkey")
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select(key.alias("id"), word(1).alias("x"), F.concat(word(2), F.when(key % 3 == 0, "N").otherwise("")).alias("y"))
    forward = F.concat(F.lit("C1C("), "x", F.lit(")"), "y", F.lit("C1"))
    backward = F.concat(F.lit("C1"), F.reverse("y"), F.lit("C("), "x", F.lit(")C1"))
    return rows.select("id", F.concat(F.when(F.col("id") % 2 == 0, forward).otherwise(backward), F.when(F.col("id") % 7 == 0, ")").otherwise("")).alias("smiles"))


@query(f"""with {_NOTATIONS_SQL}, k as (select id, case when not broken then x || '|' || least(y || 'CC', reverse(y || 'CC')) end as k, case when not broken then length(x) + length(y) + 3 end as atoms from n)
select min(id) as first, count(*) as n, max(atoms)::int as atoms, max(atoms)::int as bonds from k group by k""")
def structure_classes(spark, sf_dir):
    """Rows whose texts are the same structure; those that are none are a class of their own."""
    found = line_notation.with_canonical(line_notation.parsed(notations(spark, sf_dir), "smiles"), "smiles")
    molecule = F.col("molecule")
    return found.groupBy("canonical").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max(F.size(molecule["atoms"])).alias("a"), F.max(F.size(molecule["bonds"])).alias("b")).select(
        "first", "n", F.col("a").alias("atoms"), F.col("b").alias("bonds")
    )


@query(f"""with {_NOTATIONS_SQL} select id, copy, not broken as read, not broken as same, case when not broken then length(x) + length(y) + 3 end::int as letters from n, (select unnest([1, 2, 3])::int as copy)""")
def structures_written_anew(spark, sf_dir):
    """Three other ways of writing each structure, read again."""
    anew = line_notation.enumerated(notations(spark, sf_dir), "smiles", "id", 3)
    both = line_notation.with_canonical(line_notation.with_canonical(anew, "smiles"), "written", "again")
    same = F.coalesce(F.col("canonical") == F.col("again"), F.lit(False))
    letters = F.length(F.regexp_replace("written", "[^A-Z]", ""))
    return both.select("id", "copy", F.col("again").isNotNull().alias("read"), same.alias("same"), letters.alias("letters"))


@query()
def circular_fingerprints(spark, sf_dir):
    """Bits of each structure, and how like the first part's structure it is."""
    bits = score.VECTORISERS.get("circular")(F.col("molecule"))
    # bits and similarity once for each text, however many rows have it; rows only look them up
    texts = notations(spark, sf_dir)
    known = settled(line_notation.parsed(texts.select("smiles").distinct(), "smiles").where("molecule is not null").select("smiles", bits.alias("bits")))
    first = texts.join(known.select("smiles"), "smiles", "left_semi").agg(F.min(F.struct("id", "smiles")).alias("f")).select("f.smiles")
    first = known.join(first, "smiles").select(F.col("bits").alias("first"))
    described = known.crossJoin(F.broadcast(first))  # one row
    described = settled(described.select("smiles", F.array_join("bits", ",").alias("bits"), arrays.tanimoto(F.col("bits"), F.col("first")).alias("similarity")))
    return texts.join(described, "smiles").select("id", "bits", "similarity")


@query(f"""with {_NOTATIONS_SQL} select id, case when broken then 'unreadable' when id % 11 = 0 then 'empty' end as structure_error, case when id % 11 = 0 or broken then 'invalid' when id % 5 = 0 then 'KEGG' else 'SMILES' end as kind, not broken and id % 11 <> 0 and id % 5 <> 0 as has_text from n""")
def structure_checks(spark, sf_dir):
    """Why a text is no structure, and what kind of metabolite it is."""
    key = F.col("id")
    rows = notations(spark, sf_dir).withColumn("smiles", F.when((key % 11 == 0) & (key % 7 != 0), " ").otherwise(F.col("smiles")))
    rows = line_notation.checked(rows, "smiles").withColumn("met", F.when((key % 5 == 0) & (key % 11 != 0) & (key % 7 != 0), F.concat(F.lit("C"), F.right(F.concat(F.lit("0000"), key.cast("string")), F.lit(5)))).otherwise(F.col("smiles")))
    found = line_notation.metabolites(rows, "met")
    return found.select("id", "structure_error", "kind", (F.col("canonical").isNotNull() & (F.col("kind") == "SMILES")).alias("has_text"))


@query(f"""with {_NOTATIONS_SQL}, k as (select id, broken, id // 2 as pair, x || '|' || least(y || 'CC', reverse(y || 'CC')) as k from n),
r as (select a.id, case when not a.broken and not coalesce(b.broken, true) then least(a.k, b.k) || '.' || greatest(a.k, b.k) end as left_side, case when not a.broken then a.k end as k from k a left join k b on b.id = a.id + 1)
select min(id) as first, count(*) as n, bool_or(left_side is not null) as read from r group by left_side""")
def reaction_classes(spark, sf_dir):
    """Two parts that give the first of them: rows with one reaction, in whatever order and way its sides are written."""
    rows = notations(spark, sf_dir)
    other = rows.select((F.col("id") - 1).alias("id"), F.col("smiles").alias("next"))
    both = rows.join(other, "id", "left").select("id", F.when(F.col("id") % 2 == 0, F.array("smiles", "next")).otherwise(F.array("next", "smiles")).alias("a"), F.array(F.lit("O")).alias("b"))
    found = line_notation.reactions(both, "a", "b")
    return found.groupBy("reaction").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.col("reaction").isNotNull().alias("read")).select("first", "n", "read")
