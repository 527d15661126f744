from nearfield.llm.chat import maximal, prefix_hashes, rendered

from .fixtures import SF


def brute(rows):
    convs = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        convs.setdefault(c, []).append((role, text))
    proper = {tuple(v[:n]) for v in convs.values() for n in range(1, len(v))}
    kept = {}
    for c, v in convs.items():
        if tuple(v) not in proper:
            kept.setdefault(tuple(v), []).append(c)
    return sorted(
        ((min((c for c in ids if c is not None), default=None), len(v), len(ids), "".join(f"<|im_start|>{'unknown' if r is None else r}\n{t or ''}<|im_end|>\n" for r, t in v)) for v, ids in kept.items()), key=lambda r: (r[0] is None, r[0] or 0)
    )


def result(df):
    return sorted(((r.conv_id, r.n_turns, r.copies, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_as_brute_force(spark):
    t = spark.read.parquet(f"{SF}/conversations.parquet")
    assert result(rendered(t)) == brute([(r.conv_id, r.turn, r.role, r.text) for r in t.collect()])


def test_snapshots_and_odd_rows(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(200)] + [(2, i, "user", f"t{i}") for i in range(150)] + [(3, i * 3, "user", f"t{i}") for i in range(64)]
    rows += [(4, 0, "user", "t0"), (5, 0, "user", "other"), (6, 0, "user", "other"), (7, 0, None, "t0"), (8, 0, "user", None), (8, 1, None, ""), (9, None, "user", "x"), (9, 1, "user", "y"), (10, 0, "user", "x")]
    rows += [(None, 0, "user", "n"), (None, 1, "user", "m"), (11, 0, "user", "n"), (12, 5, "a", "same"), (12, 5, "a", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 as pos", "2 as bucket", "3 as n")
    assert result(rendered(df)) == brute(rows)


def test_empty_table(spark):
    t = spark.read.parquet(f"{SF}/conversations.parquet").limit(0)
    assert rendered(t).collect() == [] and maximal(prefix_hashes(t)).collect() == []
