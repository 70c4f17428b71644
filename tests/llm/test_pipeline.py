import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as pipeline
from reelframe.llm import mixing, simhash, toxicity

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def corpus(n=240):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        toxic = i % 5 == 0
        if toxic:
            words[::7] = ["snarl"] * len(words[::7])
        rows.append((i, " ".join(words), "en", rng.choice(["a", "a", "b", None]), None))
        labels.append((i, 1, int(toxic)))
    copies = [(1000 + i, rows[i][1] + (" end" if i % 2 else ""), "en", "b", None) for i in range(1, 60)]
    return rows + copies + [(2000, None, None, None, None), (2001, "", "en", "a", 0)], labels


def test_stages_and_run(spark, tmp_path):
    rows, labels = corpus()
    folder = write(spark, tmp_path, rows, labels)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, seen[-1], folder).write.parquet(f"{tmp_path}/s{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/s{i}"))
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in seen]
    bad = {i for i, _, t in labels if t}
    copied_bad = {1000 + i for i in bad}
    assert set(ids[1]) == set(ids[0]) - bad - copied_bad
    groups = {}
    for i, text, *_ in rows:
        if i in ids[1]:
            groups.setdefault((text or "").removesuffix(" end"), []).append(i)
    assert sorted(ids[2]) == sorted(min(g) for g in groups.values())
    wanted = {r["doc_id"]: r["copies"] for r in mixing.mix(seen[2]).collect()}
    assert {i: ids[3].count(i) for i in ids[2]} == wanted
    for d in seen[1:4]:
        assert d.columns == docs.columns
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r[0]: r[1] for r in rows}
    last = seen[4].collect()
    assert sorted(r["doc_id"] for r in last) == sorted(ids[3])
    assert all(r["ids"] == library.encode(texts[r["doc_id"]] or "") and r["n_pieces"] == len(r["ids"]) for r in last)
    whole = sorted((r["doc_id"], r["n_pieces"]) for r in pipeline.run(spark, folder).collect())
    assert whole == sorted((r["doc_id"], r["n_pieces"]) for r in last)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3])
def test_nothing(spark, tmp_path, rows):
    folder = write(spark, tmp_path, rows, [])
    assert pipeline.run(spark, folder).count() == min(1, len(rows))


def test_extra_columns(spark, tmp_path):
    rows, labels = corpus(60)
    folder = write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as root", "'x' as score", "2 as node", "3 as row", "4 as size", "array(1) as ids")
    weights = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    for out in (toxicity.keep_clean(docs, weights), simhash.keep_one(docs), mixing.repeat_rows(docs)):
        assert out.columns == docs.columns and out.filter("root = 1 and score = 'x' and size = 4").count() > 0
