"""Each stage against a plain version, on its own input."""

import corpus_pipeline
from test_operators import plain_components, plain_leaks, texts

from ephemera.llm import subword, templates, viterbi


def test_stages(spark, duck, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, previous = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, previous, sf).write.parquet(path)
        out = spark.read.parquet(path)
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        before = {r["doc_id"] for r in previous.select("doc_id").collect()}
        if name == "quality classifier":
            score = {r["doc_id"]: r["score"] for r in subword.classify(spark, docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
            assert ids == {i for i in before if score[i] >= subword.THRESHOLD} and 0.7 * len(before) < len(ids) <= len(before)
        if name == "line dedup":
            duck.register("stage_in", previous.toPandas())
            want = {r[0]: r[1:] for r in duck.sql(templates.SQL.replace("FROM documents", "FROM stage_in")).fetchall()}
            assert ids == {i for i, (n, gone, _) in want.items() if gone < n or not n}
            assert out.where("n_chars <> length(text)").count() == previous.where("n_chars <> length(text)").count()
        if name == "MinHash near-dedup":
            assert ids == {i for i, (_, _, kept) in plain_components(texts(previous)).items() if kept}
        if name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            few = [(i, t) for i, t in texts(previous) if i not in ids or i % 10 == 0]
            assert {k[0] for k in plain_leaks(few, items)} == before - ids
        if name == "SentencePiece encoding":
            own = viterbi.Encoder(viterbi.vocabulary(viterbi_model()))
            assert all(own.text(r["ids"]) == r["text"] and r["lossless"] for r in out.collect())
        else:
            assert out.columns == columns
        previous = out


def test_stages_take_odd_rows(spark, sf, odd, none):
    """Nulls, empty texts, repeated rows and ids, an empty table, and columns with names that the operators use."""
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, none):
            out = stage(spark, table, sf)
            rows = out.collect()
            if name == "SentencePiece encoding":
                assert len(rows) == table.count() and set(out.columns) >= set(table.columns) - {"ids"}
                continue
            assert out.columns == table.columns and len(rows) <= table.count()
            # what the stage does not judge passes as it is, own columns included
            assert all(r["n_lines"] == r["score"] == r["key"] == "z" for r in rows)
            if name != "quality classifier" and table is odd:
                kept = [r["text"] for r in rows]
                assert None in kept and "" in kept and "日本語のテキスト" in kept


def viterbi_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() < 200 and "ids" in out.columns


def test_a_passage_of_two_documents_loses_one_copy(spark, sf):
    passage = " ".join(f"word{'abcdefgh'[i % 8]}{'klmnopqr'[i // 8 % 8]}{'stuv'[i // 64]}" for i in range(120))
    docs = spark.createDataFrame([(1, passage + "\nits own line", "en", "s", 9), (2, "another beginning\n" + passage, "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, sf).collect()}
    assert out == {1: passage + "\nits own line", 2: "another beginning"}
