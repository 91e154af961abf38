"""Sets of common items are compared without meeting item by item; links connect what pairs connect."""

import random

from pyspark.sql import functions as F

from tidewell.operators import portfolio as P

SCHEMA = "key string, node string, items array<string>"


def sets():
    draw = random.Random(5)
    rows = [("dense", f"d{i}", draw.sample([f"x{n}" for n in range(40)], draw.randint(24, 36))) for i in range(90)]
    rows += [("sparse", f"s{i}", [f"{i // 3} {n}" for n in range(5)] + [f"own {i} {n}" for n in range(i % 3)]) for i in range(60)]
    rows += [("copies", f"c{i:02d}", ["a", "b", None, "b"]) for i in range(30)]
    return [*rows, ("dense", "none", []), ("dense", "null", None), ("alone", "one", ["x0"]), (None, "n1", ["x"]), (None, "n2", ["x"])]


def brute(rows, over):
    out = {}
    for k, a, x in rows:
        for h, b, y in rows:
            x_, y_ = set(x or ()) - {None}, set(y or ()) - {None}
            if k == h and k is not None and a < b and x_ | y_ and len(x_ & y_) / len(x_ | y_) > over:
                out[k, a, b] = len(x_ & y_) / len(x_ | y_)
    return out


def groups(links):
    root = {}
    for a, b in links:
        a, b = root.get(a, a), root.get(b, b)
        root = {x: (a if r == b else r) for x, r in {**root, a: a, b: b}.items()}
    whole = {}
    for x, r in root.items():
        whole.setdefault(r, set()).add(x)
    return sorted(map(sorted, whole.values()))


def test_pairs_and_links_of_dense_and_sparse_keys(spark):
    df = spark.createDataFrame(sets(), SCHEMA)
    want = brute(sets(), 0.6)
    got = {(r.key, r.a, r.b): r.jaccard for r in P.similar_pairs(df, "key", "node", "items", 0.6).collect()}
    assert got == want and {k for k, _, _ in want} == {"dense", "sparse", "copies"}
    links = [(r.a, r.b) for r in P.similar_links(df, "key", "node", "items", 0.6).collect()]
    assert groups(links) == groups([(a, b) for _, a, b in want])
    assert sum(a[0] == "c" for a, _ in links) == 29 < sum(k == "copies" for k, _, _ in want)


def test_blocks_give_every_pair_once(spark):
    rows = [r for r in sets() if r[0] == "dense" and r[2]]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.size("items"))
    keys = spark.createDataFrame([("dense", len(rows))], "key string, members long")
    for over in (0.5, 0.7):
        want = brute(rows, over)
        found = P._all_pairs(df, keys, over, False, block=20, columns=7).collect()
        assert len(found) == len(want) and {(r.key, r.a, r.b): r.jaccard for r in found} == want
        links = [(r.a, r.b) for r in P._all_pairs(df, keys, over, True, block=20, columns=7).collect()]
        assert groups(links) == groups([(a, b) for _, a, b in want])
