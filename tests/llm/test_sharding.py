import numpy as np
import pytest

from codestrata.llm import queries, sharding


def plain_table(shards, size):
    """Turn by turn over full preference lists."""
    import hashlib

    orders = []
    for name in shards:
        d = hashlib.blake2b(name.encode(), digest_size=16).digest()
        offset, step = int.from_bytes(d[:8], "little") % size, int.from_bytes(d[8:], "little") % (size - 1) + 1
        orders.append(iter([(offset + j * step) % size for j in range(size)]))
    owner = {}
    while len(owner) < size:
        for k, order in enumerate(orders):
            if len(owner) < size:
                owner[next(s for s in order if s not in owner)] = k
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize("count,size", [(1, 2), (3, 7), (7, 101), (5, 5)])
def test_table_equals_turns(count, size):
    names = [f"s{k}" for k in range(count)]
    table = sharding.lookup_table(names, size)
    assert table.tolist() == plain_table(names, size)
    shares = np.bincount(table, minlength=count)
    assert shares.max() - shares.min() <= 1


def test_few_slots_change_when_a_shard_leaves():
    names = [f"s{k}" for k in range(20)]
    before, after = sharding.lookup_table(names, 10007), sharding.lookup_table(names[:-1], 10007)
    moved = (before != after) & (before != 19)
    assert moved.mean() < 0.1


@pytest.mark.parametrize("names,size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_wrong_parameters(names, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, size)


def test_rows_and_files(spark, tmp_path):
    rows = [(1, "a"), (1, "b"), (None, "c"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, shard string")
    placed = sharding.place(docs, ["x", "y"], size=11)
    got = placed.collect()
    assert placed.columns == ["doc_id", "slot", "shard"]
    table = sharding.lookup_table(["x", "y"], 11)
    assert len(got) == 4 and all(r["shard"] == ["x", "y"][table[r["slot"]]] for r in got)
    assert len({r["slot"] for r in got if r["doc_id"] == 1}) == 1
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert sharding.place(docs.limit(0), ["x", "y"], size=11).count() == 0


def test_query_places_all_documents(spark):
    found = queries.QUERIES["op3_permutation_sharding"](spark, "/root/testdata/sf0.001").collect()
    table = sharding.lookup_table(queries.SHARDS)
    assert len(found) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r["shard"] == queries.SHARDS[table[r["slot"]]] for r in found)
