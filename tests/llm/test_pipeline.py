import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import toxicity
from barloom.llm.near_dedup import words_of

from .test_line_dedup import brute as cut_lines
from .test_near_dedup import brute as components

LIB = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(n=160):
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(2000)
    bench = [(k, " ".join(word() for _ in range(20))) for k in range(4)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.3:
            w = rng.choice(docs)[1]
            text = w if rng.random() < 0.5 else w.replace("w1", "w2", 1)
        else:
            text = "\n".join(" ".join(word() for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 6)))
        if rng.random() < 0.1:
            text += "\nyou stupid idiot and worthless scum"
        if rng.random() < 0.1:
            text += "\n" + rng.choice(bench)[1] + " " + word()
        docs.append((i, text))
    return docs + [(900, ""), (901, None)], bench


def write(spark, path):
    docs, bench = made()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int("idiot" in (t or ""))) for i, t in docs], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, bench


def test_stages_equal_plain_versions(spark, tmp_path):
    docs, bench = write(spark, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    tools = model.runner()
    z = lambda t: model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], toxicity.features(t, *tools), strict=True))
    rows = [(i, t) for i, t in docs if z(t) < 0]
    assert 0 < len(docs) - len(rows) and all("idiot" not in (t or "") for _, t in rows)
    cut = cut_lines(rows)
    rows = [(i, cut[i]) for i, _ in rows]
    rows = [(i, t) for (i, t), (j, _, c) in zip(sorted(rows), components(rows), strict=True) if i == j == c]
    grams = {tuple(w[k : k + 13]) for _, t in bench for w in [words_of(t)] for k in range(len(w) - 12)}

    def contaminated(t):
        w = words_of(t)
        hit = {k + j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for j in range(13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    before, rows = len(rows), [(i, t) for i, t in rows if not contaminated(t)]
    assert len(rows) < before
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: len(LIB.encode(t or "").ids) for i, t in rows}


def test_stages_keep_the_columns(spark, tmp_path):
    write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        assert (out.dtypes == docs.dtypes) == (name != corpus_pipeline.STAGES[-1][0])
