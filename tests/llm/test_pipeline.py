"""The pipeline, stage by stage, against plain versions on a small corpus."""

import hashlib
import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np

from .test_llm_texts import labelled, plain_set, words


def test_pipeline_matches_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from chronoloom.llm import quality
    from chronoloom.llm.queries import tokenizer_path

    rng = random.Random(12)
    rows = labelled(rng, 500)
    texts = {i: t for i, t, _ in rows}
    base = [words(rng, 60) for _ in range(4)]
    for n, b in enumerate(base):
        for k in range(6):
            w = b.split()
            for _ in range(k // 2):
                w[rng.randrange(len(w))] = "edited"
            texts[1000 + 10 * n + k] = " ".join(w).capitalize() + "."
    texts |= {2000: words(rng, 9000), 2001: "", 2002: None}
    docs = [(i, t, "en", rng.choice(["hot", "hot", "b", None]), len(t or "")) for i, t in texts.items()]
    docs.append(docs[-30])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    frames, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        frames.append(now)
    assert all(f.columns == columns for f in frames[:3])

    model = quality.fit(spark.createDataFrame(docs, schema), spark.read.parquet(f"{tmp_path}/labels.parquet"), held_out=quality.held_out())
    taken = Counter(r.doc_id for r in quality.with_quality(spark.createDataFrame(docs, schema), model).where("predicted = 1").collect())
    assert Counter(r.doc_id for r in frames[0].collect()) == taken
    good = {i: q for i, _, q in rows}
    assert sum((i in taken) == bool(q) for i, q in good.items()) / len(good) > 0.97

    left = sorted(taken)
    sets = {i: plain_set(texts[i], 5) for i in left}
    label = {i: i for i in left}
    for _ in range(10):
        for a, b in itertools.combinations(left, 2):
            if label[a] != label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    assert sorted(r.doc_id for r in frames[1].collect()) == sorted({i for i in left if label[i] == i})
    assert {tuple(r) for r in frames[2].collect()} == {tuple(r) for r in frames[1].collect()}
    assert frames[2].count() == frames[1].count()

    library = Tokenizer.from_file(tokenizer_path())
    final = {r.doc_id: r for r in frames[3].collect()}
    assert sorted(final) == sorted(r.doc_id for r in frames[1].collect())
    for i, r in final.items():
        ids = np.array(library.encode(texts[i] or "", add_special_tokens=False).ids, "<u4")
        assert bytes(r.ids) == ids.tobytes() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(final)


def test_run_keeps_the_mixture_to_the_end(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from chronoloom.llm import mixing

    rng = random.Random(5)
    docs = [(i, words(rng, 9000 if i % 97 == 0 else 20), rng.choice(["hot", "hot", "hot", "b", None])) for i in range(600)] + [(None, "no id", "b")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[2:])
    got = {r.position: r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(docs)))

    # A plain schedule: blocks of 16 by earliest deadline among those released, sources of the root of their size.
    source = {i: s for i, _, s in docs}
    names = sorted(set(source.values()), key=lambda s: (s is not None, s))
    left = Counter(s for _, _, s in docs)
    share = {s: Fraction(left[s] ** 0.5) / sum(Fraction(n**0.5) for n in left.values()) for s in names}
    done, want, t = Counter(), [], 0
    while +left:
        ready = [(math.ceil((done[s] + 1) / share[s]), k, s) for k, s in enumerate(names) if left[s] and math.floor(done[s] / share[s]) <= t]
        if ready:
            s = min(ready)[2]
            n = min(mixing.BLOCK, left[s])
            want += [s] * n
            left[s] -= n
            done[s] += 1
        t += 1
    assert [source[got[k]] for k in range(len(docs))] == want
    placed = {r.position: r.doc_id for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == placed


CLASHES = ["score", "predicted", "slot", "position", "source_block", "ordinal", "digest", "doc", "key", "first", "kept", "part", "_file", "_row", "_source", "_hash", "row", "node", "parts", "pattern"]


def test_stages_return_given_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    rows = labelled(rng, 120)
    texts = [(i, t) for i, t, _ in rows] + [(1, "another text under a known id " + words(rng, 30)), (2, None), (2, ""), (None, "no id " + words(rng, 30)), (None, "no id")]
    docs = [(i, t, rng.choice(["a", None]), *[f"{c} {k}" for c in CLASHES]) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
    now = spark.createDataFrame(docs, schema).repartition(2)
    spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    given = Counter(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/s{k}")
        now = spark.read.parquet(f"{tmp_path}/s{k}")
        assert now.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        kept = Counter(tuple(r) for r in now.collect())
        assert not kept - given
        given = kept
    last = corpus_pipeline.STAGES[3][1](spark, now, str(tmp_path))
    assert sorted(r.position for r in last.collect()) == list(range(sum(given.values())))


def test_rows_that_share_an_id_keep_their_texts(spark):
    import corpus_pipeline

    docs = [(3, "a b c d e f g", "x"), (3, "u v w x y z q", "x"), (5, "A b c d e f g", "x"), (3, "a b c d e f g", "x"), (9, "U V w x y z q", "y"), (3, "A B c d e f g", "x")]
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(docs, "doc_id long, text string, source string"), "")
    texts = sorted(r.text.lower() for r in got.collect())
    assert texts == ["a b c d e f g", "u v w x y z q"] and {r.doc_id for r in got.collect()} == {3}


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
