from collections import Counter

import pytest

from echosieve.llm import sharding


def brute(names, slots):
    """The same turns, with every order written out."""
    import xxhash

    orders = []
    for s in names:
        start, step = xxhash.xxh64_intdigest(s, seed=1) % slots, xxhash.xxh64_intdigest(s, seed=2) % (slots - 1) + 1
        orders.append(iter([(start + i * step) % slots for i in range(slots)]))
    table = {}
    while len(table) < slots:
        for i, order in enumerate(orders):
            if len(table) < slots:
                table[next(x for x in order if x not in table)] = i
    return [table[i] for i in range(slots)]


@pytest.mark.parametrize(("n", "slots"), [(1, 7), (3, 101), (7, 7), (10, 1009)])
def test_table_against_brute_force(n, slots):
    names = [f"s{i}" for i in range(n)]
    table = sharding.lookup_table(names, slots).tolist()
    assert table == brute(names, slots)
    loads = Counter(table)
    assert max(loads.values()) - min(loads.values()) <= 1


def test_few_slots_move():
    a, b = sharding.lookup_table([f"s{i}" for i in range(20)], 10007), sharding.lookup_table([f"s{i}" for i in range(19)], 10007)
    moved = sum(1 for x, y in zip(a, b, strict=True) if x != y and x != 19)
    assert moved < 0.1 * 10007


@pytest.mark.parametrize("bad", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_refusals(bad):
    with pytest.raises(ValueError):
        sharding.lookup_table(*bad)


def test_placement(spark):
    rows = [(i % 50, "x" * 9, 1, 2) for i in range(500)] + [(None, None, 1, 2)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int, shard int")
    got = sharding.place(spark, df, "doc_id", [f"s{i}" for i in range(8)], 101).collect()
    table = sharding.lookup_table([f"s{i}" for i in range(8)], 101)
    assert len(got) == 502 and all(r.shard == table[r.slot] for r in got) and len({(r.doc_id, r.shard) for r in got}) == 51
    assert sharding.place(spark, df.limit(0), "doc_id", ["a"], 7).count() == 0
    assert sharding.place(spark, df, "text", ["a", "b"], 7).count() == 502
    assert sharding.place(spark, df, "slot", ["a", "b"], 7).count() == 502
