"""Queries on small tables where they once differed from their SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from compare import DATA, TABLES, differences
from kinolith.plans.registry import QUERIES, SQL


def folder(path, **tables) -> str:
    """A folder of the given tables with some replaced by what a SELECT gives."""
    for t in TABLES:
        if t in tables:
            duckdb.connect().execute(f"copy ({tables[t]}) to '{path}/{t}.parquet' (format parquet)")
        else:
            os.symlink(f"{DATA}/{t}.parquet", f"{path}/{t}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["lookup_first_match", "both_lookup", "lookup_guarded"])
def test_equal_positions_go_by_place_in_the_file(spark, tmp_path, name):
    # of two lines with one number the first has the larger value
    lines = f"""select * replace (900 - i * 10.0 as l_extendedprice, 90.0 - i as l_quantity, f as l_returnflag, 1 as l_orderkey, 1 as l_linenumber, k as l_partkey)
    from (select * from '{DATA}/lineitem.parquet' limit 1), range(1, 21) p(k), (values ('R'), ('A')) g(f), range(30) r(i) order by i, k, f"""
    assert not differences(name, QUERIES[name](spark, folder(tmp_path, lineitem=lines)), SQL[name], str(tmp_path))


def test_blocks_are_rounded_in_their_own_precision(spark, tmp_path):
    # 0.0145 as a float is below 14.5 thousandths, but its product with 1000 is 14.5
    vectors = "select i as vec_id, list_transform(range(64), lambda k: ((i * 64 + k) / 1000 + 0.0005)::float) as embedding, 0::int as label from range(50) t(i)"
    assert not differences("block_concat", QUERIES["block_concat"](spark, folder(tmp_path, embeddings=vectors)), SQL["block_concat"], str(tmp_path))


def test_public_ids_of_keys_that_clash(spark, tmp_path):
    # three keys with one head, and keys whose second draw is another's first
    customers = f"""select c.* replace (k as c_custkey) from (select * from '{DATA}/customer.parquet' limit 1) c, (select unnest([430058, 540966, 664527, 157724, 822477, 91099, 296332, 387054, 566186, 1]) as k)"""
    assert not differences("public_ids", QUERIES["public_ids"](spark, folder(tmp_path, customer=customers)), SQL["public_ids"], str(tmp_path))


@pytest.mark.parametrize("name", ["confusion", "positions_by_class", "position_counts"])
def test_floats_at_a_threshold_are_not_above_it(spark, tmp_path, name):
    vectors = "select i as vec_id, list_transform(range(64), lambda k: [0.1, 0.15, 0.2, 0.05, 0.3][1 + (i * 7 + k * 3) % 5]::float) as embedding, (i % 3)::int as label from range(50) t(i)"
    assert not differences(name, QUERIES[name](spark, folder(tmp_path, embeddings=vectors)), SQL[name], str(tmp_path))
