import hashlib
from collections import Counter, defaultdict

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from nearfield.llm.alignment import ByteLevel, alignment, alignment_groups, group_products

from .fixtures import documents, key, odd_docs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows):
    """Every pair of tokens of each text compared, counted over all texts."""
    at, bt = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    at.encode_special_tokens = True
    byte = {}
    n = 0
    for b in range(256):
        shown = 0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or 0xAE <= b < 0x100
        byte[chr(b) if shown else chr(256 + n)] = b
        n += not shown
    docs = []
    for i, text in rows:
        raw, a, b = b"", [], []
        if text:
            raw = (" " + text).encode()
            a = [(t, bytes(byte[c] for c in at.id_to_token(t))) for t in at.encode(" " + text, add_special_tokens=False).ids]
            b = [(t, bytes([int(bt.id_to_piece(t)[3:5], 16)]) if bt.is_byte(t) else bt.id_to_piece(t).replace("▁", " ").encode()) for t in bt.encode(text)]
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a, b = [], []
        spans = []
        for side in (a, b):
            at_, out = 0, []
            for t, x in side:
                out.append((t, at_, at_ + len(x)))
                at_ += len(x)
            spans.append(out)
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = defaultdict(lambda: ([], []))
        for side in (0, 1):
            for t, _, e in spans[side]:
                groups[next(k for k, x in enumerate(ends) if e <= x)][side].append(str(t))
        text_ = ";".join("|".join(",".join(s) for s in groups[k]) for k in range(len(ends)))
        links, low = [], 0
        for t, s, e in spans[0]:
            while low < len(spans[1]) and spans[1][low][2] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((t, spans[1][k][0]))
                k += 1
        docs.append((i, len(a), len(b), len(ends), links, hashlib.sha256(text_.encode()).hexdigest() if text_ else ""))
    count = Counter(p for d in docs for p in set(d[4]))
    best = defaultdict(int)
    for (a, _), c in count.items():
        best[a] = max(best[a], c)
    return [(i, na, nb, ng, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), h) for i, na, nb, ng, links, h in docs]


def test_as_brute_force(spark):
    docs = documents(spark)
    got = alignment(docs, A, B)
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 3000").collect()]
    assert key(alignment(docs.where("length(text) < 3000").repartition(3), A, B).collect(), *NAMES) == sorted(brute(rows))
    assert got.count() == docs.count() and got.where("n_a = 0 and groups_sha256 <> ''").count() == 0


def test_odd_rows(spark):
    texts = ["a▁b", " \n\n  x", "<|endoftext|> is plain, and so are <s> and <0x0A>", "ﬁ Å é \U0001f600\U0001f600", "x\u0000y", "   ", "﻿abc"]
    odd = odd_docs(spark).where("doc_id is null or doc_id not in (6, 7)")
    docs = odd.unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert key(alignment(docs, A, B).collect(), *NAMES) == key([dict(zip(NAMES, r, strict=True)) for r in brute(rows)], *NAMES)
    assert alignment(docs.where("doc_id < 0"), A, B).collect() == []


def test_fast_encoder_is_the_vocabulary(spark):
    enc, whole = ByteLevel(A), Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    texts = [" " + r.text for r in documents(spark).where("text is not null").collect()]
    texts += [" " * 5000 + "x", "a" * 20000, "!" * 20000, " \n" * 3000, "it's we'LL <|endoftext|> ǅ ⅷ ٣ 　 ​ ­", "".join(chr(c) + "'s " for c in range(0x20, 0x3000))]
    assert enc.fast is not None
    assert [enc(t).tolist() for t in texts] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert enc.library is not None  # long runs of white space


def test_groups_links_and_products(spark):
    docs = odd_docs(spark).where("doc_id in (1, 8, 12)")
    groups = alignment_groups(docs, A, B)
    rows = sorted(groups.collect(), key=lambda r: (r.doc_id, r.nth))
    want = {r.doc_id: r for r in alignment(docs, A, B).collect()}
    for i in (1, 8, 12):
        mine = [r for r in rows if r.doc_id == i]
        text = ";".join(",".join(map(str, r.a_ids)) + "|" + ",".join(map(str, r.b_ids)) for r in mine)
        assert hashlib.sha256(text.encode()).hexdigest() == want[i].groups_sha256
        assert sum(len(r.links) for r in mine) == want[i].n_links and [r.nth for r in mine] == list(range(want[i].n_groups))
        assert mine[0].start == 0 and all(x.end == y.start for x, y in zip(mine, mine[1:], strict=False))
        assert all(r.links[0].start == r.start and r.links[-1].end == r.end for r in mine)
    products = group_products(groups)
    assert products.count() == sum(len(r.a_ids) * len(r.b_ids) for r in rows)
    assert products.where("linked").count() == sum(len(r.links) for r in rows)
    assert alignment_groups(docs.where("doc_id < 0"), A, B).collect() == []
