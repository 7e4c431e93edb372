"""The corpus pipeline on documents whose fate is known."""

import random
from collections import Counter

import corpus_pipeline
from tests_llm_data import prose


def test_every_stage_takes_effect(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(12)
    rows, labels, fate = [], [], {}

    def add(i, text, kept=None, quality=None):
        rows.append((i, text, "en", "s", len(text or "")))
        if quality is not None:
            labels.append((i, quality, 0))
        if kept is not None:
            fate[i] = kept

    for i in range(150):
        text = prose(rng, rng.randint(60, 200))
        add(i, text, text, 1)
    for i in range(150, 220):
        add(i, " ".join(rng.choice(["BUY!!", "###", "NOW!!", "$$$"]) for _ in range(rng.randint(40, 200))), None, 0)
    for i in range(10):  # copies and near copies of kept documents, with larger ids
        words = rows[i][1].split()
        words[20] = "changed"
        add(300 + i, rows[i][1] if i % 2 else " ".join(words))
    item = prose(rng, 25)
    add(400, f"{prose(rng, 80)} {item} {prose(rng, 40)}")
    secret = prose(rng, 70)
    add(401, f"{secret} password=hunter42x end of it", f"{secret} [ASSIGN] end of it")
    tables = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")

    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "packing"
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert docs.columns == tables["documents"].columns
        left.append({r.doc_id: r.text for r in docs.collect()})
    assert set(left[0]) == {r[0] for r in rows if not 150 <= r[0] < 220}
    assert set(left[1]) == set(fate) | {400}
    assert set(left[2]) == set(fate) and left[3] == fate
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        sizes[r.doc_id] += r.length
    assert sizes == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in fate.items()}


def test_stages_take_empty_and_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "plain words here", "en", "s", 16), (2, "", "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "plain words"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, str(tmp_path)).count() >= 0


def test_columns_named_like_the_stages_own(spark, tmp_path):
    """The names that the joins of the stages add may be columns of the documents."""
    from marketweave.llm import pii

    rng = random.Random(4)
    text = prose(rng, 80)
    item = prose(rng, 25)
    own = ["_k_id", "_k_digest", "_K_id_", "h_id", "h_digest", "_p_id", "_p_digest", "_p_base", "_p_shown"]
    rows = [(1, text, *own), (2, text, *own), (2, text, *own), (3, f"{prose(rng, 40)} {item}", *own), (4, f"{prose(rng, 60)} write to jo@example.org", *own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in own))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage, left in ((corpus_pipeline.near_duplicates, [1, 3, 4]), (corpus_pipeline.decontamination, [1, 2, 2, 4])):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == left
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    assert [r.text[-7:] for r in clean.where("doc_id = 4").collect()] == ["[EMAIL]"]
