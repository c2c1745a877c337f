import random

import pytest

import corpus_pipeline as P
from fairgrid.llm import common, queries
from fairgrid.llm.common import table


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A small corpus with junk, copies, a leak, secrets and clean documents, and a column of its own."""
    rng = random.Random(5)
    root = tmp_path_factory.mktemp("sf")
    text = lambda n=40: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))
    item = text(30)
    docs = [(i, text(), "en", f"src{i % 5}", 0) for i in range(120)]
    docs += [(200 + i, text() + "%%% " * 40, "en", "src1", 0) for i in range(40)]
    docs += [(300 + i, docs[i][1], "en", "src2", 0) for i in range(10)] + [docs[3]]
    docs += [(400, text(5) + " " + item + " " + text(5), "en", "src3", 0), (401, "token = \"0123456789abcdef0123456789abcdef\" " + text(), "en", "src4", 0), (402, "", "en", None, 0), (403, None, None, None, None)]
    spark.createDataFrame([d[:4] + (d[4] if d[1] is None else len(d[1]),) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(20))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return str(root)


def test_each_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, ids = docs.columns, lambda df: sorted((r.doc_id for r in df.collect()))
    kept = P.quality_stage(spark, docs, sf_dir)
    assert kept.columns == columns
    assert set(range(120)) <= set(ids(kept)) and not set(ids(kept)) & set(range(200, 240))
    once = P.dedup_stage(spark, kept, sf_dir)
    assert once.columns == columns and set(range(120)) <= set(ids(once)) and not set(ids(once)) & set(range(300, 310)) and ids(once).count(3) == 1
    clean = P.decontamination_stage(spark, once, sf_dir)
    assert set(ids(once)) - set(ids(clean)) == {400} & set(ids(once))
    masked = P.secrets_stage(spark, clean, sf_dir)
    assert masked.columns == columns and ids(masked) == ids(clean)
    before = {r.doc_id: r.text for r in clean.collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in masked.collect()}
    assert {i for i in before if before[i] != after[i][0]} == {401}
    assert after[401][0].startswith("[secret]\"") and after[401][1] == len(after[401][0])


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir).collect()
    got = {r.doc_id for r in out}
    assert set(range(120)) <= got and not got & {*range(200, 240), *range(300, 310), 400} and all(r.n_tokens == len(r.ids) for r in out)
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_a_row_each(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    n = df.count()
    if name.startswith("op10"):
        assert n == 10
    elif name.startswith("op13"):
        assert df.where("rank not between 1 and 5 or 5 * negative_score < 4 * positive_score or negative_score > positive_score").count() == 0
    elif name.startswith("op3"):
        assert n == df.agg({"slot": "max"}).first()[0] + 1 and df.where("n_docs < 1").count() == 0
    else:
        assert n == table(spark, sf_dir, "documents").count()


def test_rows_are_equal_on_both_sides_of_the_broadcast_bound(spark, sf_dir, monkeypatch):
    """With tables of three rows broadcast at most, all else meets by shuffles; the same rows come out."""
    docs = table(spark, sf_dir, "documents")
    stages = [P.dedup_stage, P.decontamination_stage, P.secrets_stage]
    rows = lambda: [sorted(map(str, stage(spark, docs, sf_dir).collect())) for stage in stages] + [sorted(map(str, queries.QUERIES[q](spark, sf_dir).collect())) for q in ("op4_simhash_dedup", "op5_secrets", "op8_licenses")]
    broadcast = rows()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    assert rows() == broadcast
    assert all(map(len, broadcast))
