import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm.language import remainder
from nearfield.llm.queries import op2_suffix_tree_scores
from nearfield.llm.suffix_tree import DIVERGENCE, LEAST_COUNT, SMOOTHING, score

from .fixtures import SPACE, documents, lower, odd_docs

END = object()


def brute(rows, training, depth=4, least=None):
    """The model in plain dictionaries."""
    toks = [[*SPACE.findall(lower(t)), END] for _, t in rows]
    count = Counter(w for t, use in zip(toks, training, strict=True) if use for w in t)
    n, v = sum(count.values()), len(count)
    bottom = n + 0.5 * (v + 1)
    p0 = lambda w: (count[w] + 0.5) / bottom
    least = LEAST_COUNT if least is None else least
    frequent = {w for w, c in count.items() if c >= least and w is not END}
    symbol = lambda w: w if w in frequent or w is END else None
    symbols = [*frequent, END]
    root = {w: p0(w) for w in symbols} | {None: max(1 - sum(p0(w) for w in symbols), 1e-12)}
    dists, kept = {(): root}, {}
    allowed = {(w,) for w in frequent}
    for d in range(1, depth + 1):
        n_next = defaultdict(Counter)
        for t, use in zip(toks, training, strict=True):
            for i in range(d, len(t)) if use else []:
                ctx = tuple(t[i - d : i])
                if ctx in allowed:
                    n_next[ctx][symbol(t[i])] += 1
        longer = set()
        for ctx, c in n_next.items():
            total = sum(c.values())
            if total < least:
                continue
            parent = dists[ctx[1:]]
            dists[ctx] = {s: (c[s] + SMOOTHING * parent[s]) / (total + SMOOTHING) for s in root}
            kl = sum(x / total * math.log(x / total / parent[s]) for s, x in c.items())
            if kl - len(c) / (2 * total) >= DIVERGENCE:
                kept[ctx] = dists[ctx]
            longer |= {(*ctx, s) for s, x in c.items() if x >= least and s in frequent}
        allowed = longer
    out = []
    for (i, _), t in zip(rows, toks, strict=True):
        base = total = 0.0
        for k, w in enumerate(t):
            b = math.log10(p0(w)) if n else 0.0
            ctx = next((c for d in range(depth, 0, -1) if k >= d and (c := tuple(t[k - d : k])) in kept), ())
            base += b
            total += b + (math.log10(kept[ctx][symbol(w)] / root[symbol(w)]) if ctx else 0.0)
        out.append((i, len(t), sum(count[w] > 0 for w in t), n, base, total))
    return out, kept


@pytest.mark.parametrize(
    ("make", "options"),
    [(documents, {}), (odd_docs, {}), (documents, {"depth": 4, "least": 5, "most": 200}), (odd_docs, {"depth": 4, "least": 5, "most": 7})],
)
def test_as_brute_force(spark, make, options):
    docs = make(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id"), 5) != 1, F.lit(False)).alias("use")).collect()]
    use = [r.use for r in docs.select(F.coalesce(remainder(F.col("doc_id"), 5) != 1, F.lit(False)).alias("use")).collect()]
    expected, kept = brute(rows, use, **{k: v for k, v in options.items() if k != "most"})
    got = score(docs, F.coalesce(remainder(F.col("doc_id"), 5) != 1, F.lit(False)), **options).collect()
    order = lambda t: (t[0] is None, t[0] or 0, t[1])
    a, b = sorted(expected, key=order), sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=order)
    assert [x[:4] for x in a] == [x[:4] for x in b]
    assert np.allclose([x[4] for x in a], [x[4] for x in b]) and np.allclose([x[5] for x in a], [x[5] for x in b])
    assert kept and (not options or max(map(len, kept)) > 2)


def test_contexts_help_on_held_out_text(spark):
    rng = np.random.default_rng(5)
    follow = {f"w{i}": [f"w{(i * 7 + k) % 40}" for k in range(3)] for i in range(40)}
    rows = []
    for d in range(120):
        w = ["w0"]
        for _ in range(200):
            w.append(follow[w[-1]][rng.integers(3)])
        rows.append((d, " ".join(w)))
    got = score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 90).where("doc_id >= 90").collect()
    assert all(r.score > 0.75 * r.base_score for r in got)


def test_nothing_to_learn_from(spark):
    docs = documents(spark)
    got = score(docs, F.lit(False)).collect()
    assert all(r.score == r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert score(docs.limit(0), F.lit(True)).collect() == []


def test_query_keeps_rare_contexts_of_a_long_corpus(spark, tmp_path):
    """A phrase that is 1/5000 of the training text is a context of op2, as it would be in a short one."""
    rng = np.random.default_rng(8)
    filler = [(i, " ".join(f"f{x}" for x in rng.integers(0, 20000, 1000))) for i in range(50)]
    rows = [*filler, *((100 + i, "alpha beta gamma") for i in range(15)), *((200 + i, "alpha beta gamma") for i in range(10))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in op2_suffix_tree_scores(spark, str(tmp_path)).collect() if r.held_out and r.doc_id >= 100]
    assert got and all(r.n_known == 4 and r.score > 0.8 * r.base_score for r in got)
