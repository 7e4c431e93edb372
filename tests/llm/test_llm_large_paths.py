"""The ways beyond a size bound give what the ways below it give."""

import random
from collections import Counter

from marketweave.llm import htmltext, neardup, pii, topk
from tests_llm_data import documents, prose


def test_main_text_without_broadcast(spark):
    page = "<html><body><div class=x{0}><p>Some text of page {1}, long enough</p></div><div class=y><p>short</p></div></body></html>"
    table = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", page.format(i % 2, i)) for i in range(12)], "page_id long, url string, html string")
    want = {(r.page_id, r.text) for r in htmltext.main_texts(table).collect()}
    assert {(r.page_id, r.text) for r in htmltext.main_texts(table, broadcast_hosts=0).collect()} == want


def test_near_duplicates_without_broadcast(spark):
    rng = random.Random(1)
    base = [prose(rng, 60) for _ in range(8)]
    docs = documents(spark, [*enumerate(base), *((20 + i, t.replace(t.split()[30], "other", 1)) for i, t in enumerate(base))])
    want = {(r.doc_id, r.cluster_id) for r in neardup.near_duplicates(docs).collect()}
    assert {(r.doc_id, r.cluster_id) for r in neardup.near_duplicates(docs, broadcast_nodes=0).collect()} == want
    assert {c for _, c in want} == set(range(8))


def test_term_frequencies_in_slices(spark):
    rng = random.Random(2)
    texts = [prose(rng, 20) for _ in range(30)] + [None, ""]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter(w for t in texts for w in set((t or "").split()) if len(w) >= 3)
    terms = spark.createDataFrame([(w,) for w in want] + [("absent",)], "term string")
    for slice_terms in (1_000_000, 7):
        assert {r.term: r.n for r in pii.term_frequencies(table, terms, slice_terms).collect()} == want


def test_top_k_where_all_ask_one_shard(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(400)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3, every=2, shard_rows=50, block_rows=16, pivot_sample=100).collect()
    best = {q: sorted((-(64 * 64 + 64 * 64 * (q % 3) * (i % 3)), i) for i in range(400) if i != q)[:3] for q in range(0, 400, 2)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(q, n, i, -s) for q, b in best.items() for n, (s, i) in enumerate(b, 1)}
