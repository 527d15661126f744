import math

import duckdb
import numpy as np
import pytest

from nearfield.llm import hyperplanes
from nearfield.llm.hyperplanes import cosine_duplicates, tables_for
from nearfield.llm.oracles import COSINE_DUPLICATES

from .fixtures import SF


def brute(rows, least=0.9):
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1], np.float64) / np.abs(rows[k][1]).max() for k in good}
    unit = {k: x / np.linalg.norm(x) for k, x in unit.items()}
    links = [set() for _ in rows]
    for n, a in enumerate(good):
        for b in good[n + 1 :]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        root = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((i, len(links[k]), root, i is None or i == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def table(spark, rows, kind="double"):
    names = ("rep", "key", "size", "ball", "digest", "root", "links", "component", "node")
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", *[f"'x' as {n}" for n in names])


def copies_of(rng, centre, n, noise):
    return centre + rng.normal(size=(n, len(centre))) * noise * np.linalg.norm(centre) / math.sqrt(len(centre))


def test_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(COSINE_DUPLICATES)
    names = [d[0] for d in want.description]
    got = cosine_duplicates(spark.read.parquet(f"{SF}/embeddings.parquet")).select(*names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_groups_near_the_threshold(spark):
    """Groups of many tightnesses, pairs on either side of the threshold, chains."""
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for size, noise in ((40, 0.05), (30, 0.3), (60, 0.34), (20, 0.5), (2, 0.1), (3, 0.2)):
        for v in copies_of(rng, rng.normal(size=24), size, noise):
            rows.append((n, v.tolist()))
            n += 1
    rows += [(n + i, rng.normal(size=24).tolist()) for i in range(150)]
    a, b = rng.normal(size=24), rng.normal(size=24)
    for k in range(12):  # a chain, each link of which is at about 18 degrees
        rows.append((1000 + k, (a * math.cos(0.3 * k) + b * math.sin(0.3 * k)).tolist()))
    assert result(cosine_duplicates(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("noise", [0.1, 0.33, 0.45])
def test_hot_keys_in_balls_and_blocks(spark, monkeypatch, noise):
    """Keys beyond a block: balls, strays and other groups count every link once."""
    monkeypatch.setattr(hyperplanes, "BLOCK", 16)
    monkeypatch.setattr(hyperplanes, "ROWS", 5)
    rng = np.random.default_rng(9)
    one = rng.normal(size=16)
    vectors = np.vstack([copies_of(rng, one, 120, noise), copies_of(rng, one + rng.normal(size=16) * 0.35, 60, 0.08), rng.normal(size=(80, 16))])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    rows += [(500 + i, rows[i % 7][1]) for i in range(30)]
    assert result(cosine_duplicates(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 0.0]), (8, [1e300, 1e299]), (9, [5e-324, 0.0])]
    rows += [(10, [1.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.1]), (12, [-1.0, 0.0]), (1, [0.0, 1.0]), (1, [2.0, 0.1]), (20, [0.1, 5.0]), (21, [1.0]), (22, [-3.0]), (23, [7.0])]
    assert result(cosine_duplicates(table(spark, rows))) == brute(rows)
    assert cosine_duplicates(table(spark, [])).collect() == []
    assert result(cosine_duplicates(table(spark, [(4, [1.0, 2.0])], "float"))) == [(4, 0, 4, True)]


def test_tables_reach_pairs_at_the_threshold():
    for n in (10, 10**4, 10**6, 10**9):
        tables, planes = tables_for(n, 0.9)
        assert (1 - (1 - math.acos(0.9) / math.pi) ** planes) ** tables <= 1e-6
        assert n / 2**planes <= 512
