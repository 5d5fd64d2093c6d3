"""BPE, fingerprints, near-duplicates and the quality classifier against plain versions."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import bpe, fingerprints, near_dedup, quality
from chronoloom.llm.queries import tokenizer_path
from chronoloom.llm.shingles import shingle_sets

WORDS = "the of and tion ing er on re ed in ha sh ou wh th".split()


def words(rng, n):
    return " ".join("".join(rng.choices(WORDS, k=rng.randrange(1, 4))) for _ in range(n))


def plain_set(text, n):
    import re

    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_shingle_sets_count_and_agree_with_plain_sets():
    texts = ["a b c d", "A  b\tc d", "", None, "  ", "x", "x y", "x\x85y z w", "b c d", "a b c d a b c", "é ü ß ñ", "Z z z z z", "x" * 5000]
    made = list(shingle_sets(pa.array(texts), 3))
    assert [len(s) for s in made] == [len(plain_set(t, 3)) for t in texts]
    for (a, x), (b, y) in itertools.combinations(zip(texts, made, strict=True), 2):
        assert len(np.intersect1d(x, y)) == len(plain_set(a, 3) & plain_set(b, 3))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab '!.1\n\té日", "'s", "'re", "<|endoftext|>", "<|end", "oftext|>", "  ", "the", "🙂"]), max_size=120).map("".join), st.integers(2, 30))
def test_joined_parts_are_the_encoding_of_the_whole(text, leaf):
    from tokenizers import Tokenizer

    c = bpe.codec(tokenizer_path())
    ends = bpe.halves(len(text), leaf)
    ids = bpe.join_all(c, [(text[a:b], c.encode(text[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    library = Tokenizer.from_file(tokenizer_path())
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["ab" * 4000, "a" * 9000, "7" * 5000, " " * 6000 + "x", "'" * 3000, "日本" * 1500, "x" * 4000 + "<|endoftext|>" + "y" * 4000, "it's" * 2000])
def test_long_unsplit_text_joins_exactly(text):
    c = bpe.codec(tokenizer_path())
    ends = bpe.halves(len(text), 700)
    ids = bpe.join_all(c, [(text[a:b], c.encode(text[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    assert ids.tolist() == c.encode(text).tolist()


def test_encode_and_decode_rows(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [None, "", "short", words(rng, 4000), "ab" * 20000, words(rng, 4000), "é🙂 <|endoftext|> it's"]
    rows = [(i, t, "kept out") for i, t in enumerate(texts)] + [(4, texts[4], "again"), (2, "short", "again"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, tokenizer_path(), leaf=5000), tokenizer_path()).collect()
    library = Tokenizer.from_file(tokenizer_path())
    want = sorted((str(i), np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for i, t, _ in rows)
    assert sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in got) == want
    at_once = bpe.encode(docs, tokenizer_path(), leaf=5000, decoded=True).collect()
    assert sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in at_once) == want
    assert bpe.encode(docs.limit(0), tokenizer_path()).count() == 0


def test_decoding_bytes_that_are_no_text():
    c = bpe.codec(tokenizer_path())
    half = c.encode("é")[:1] if len(c.encode("é")) > 1 else c.encode("日")[:1]
    from tokenizers import Tokenizer

    assert c.decode_all(half, np.array([0, len(half)]))[0].as_py() == Tokenizer.from_file(tokenizer_path()).decode(half.tolist(), skip_special_tokens=False)


def test_sketches_are_exact_on_small_sets_and_merge():
    rng = random.Random(1)
    a, b = words(rng, 60), words(rng, 40)
    texts = [a, a + " " + b, b, ""]
    sets = [plain_set(t, 5) for t in texts]
    made = [s[: fingerprints.SIZE] for s in shingle_sets(pa.array(texts), 5)]
    for i, j in itertools.product(range(3), repeat=2):
        assert fingerprints.resemblance(made[i], made[j]) == pytest.approx(len(sets[i] & sets[j]) / len(sets[i] | sets[j]))
        assert fingerprints.containment(made[i], made[j]) == pytest.approx(len(sets[i] & sets[j]) / len(sets[i]))
    assert fingerprints.resemblance(made[3], made[3]) == 1 and fingerprints.resemblance(made[3], made[0]) == 0
    long = [np.unique(np.random.default_rng(k).integers(0, 2**64, 20000, dtype=np.uint64)) for k in range(4)]
    whole = fingerprints.sketch(np.concatenate(long))
    assert (fingerprints.merge([fingerprints.sketch(x) for x in long]) == whole).all()
    assert fingerprints.distinct(whole) == pytest.approx(80000, rel=0.3)
    assert fingerprints.resemblance(fingerprints.sketch(np.concatenate(long[:2])), fingerprints.sketch(np.concatenate(long[1:3]))) == pytest.approx(1 / 3, abs=0.15)


def test_merged_sketches_by_group(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 30), "hot" if i % 3 else f"g{i % 4}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    parts = fingerprints.sketches(docs).join(docs.select("doc_id", "source"), "doc_id")
    got = {r.source: fingerprints.unpack(r.sketch) for r in fingerprints.merged(parts, "source").collect()}
    for source in {r[2] for r in rows}:
        sets = list(shingle_sets(pa.array([t for _, t, s in rows if s == source]), 5))
        assert (got[source] == np.unique(np.concatenate(sets))[: fingerprints.SIZE]).all()


def test_edited_fingerprints_follow_ascending_ids(spark):
    rng = random.Random(3)
    texts = {i: words(rng, rng.randrange(0, 80)) for i in range(0, 300, 3)} | {7: None, 1000: "é" * 9, 1001: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    prints = {}
    for here, after in zip(order, order[1:] + order[:1], strict=True):
        a, b = texts[here] or "", texts[after] or ""
        k = len(a) // 4
        edited = a[: len(a) - k] + b[:k]
        assert got[here].n_chars == len(a) and got[here].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sets = [s[: fingerprints.SIZE] for s in shingle_sets(pa.array([a, edited, b]), 5)]
        assert got[here].near_edited == pytest.approx(fingerprints.resemblance(sets[0], sets[1]))
        assert got[here].near_next == pytest.approx(fingerprints.resemblance(sets[0], sets[2]))
        prints.setdefault(a, set()).add(got[here].fingerprint)
    assert all(len(x) == 1 for x in prints.values())


def test_edited_fingerprints_of_one_none_and_repeated_rows(spark):
    one = spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()
    assert fingerprints.edited_fingerprints(one.limit(0)).count() == 0
    many = spark.createDataFrame([(1, "aaaa"), (1, "aaaa"), (2, "bbbb"), (None, "cccc")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(many).count() == 4


def components(texts, n, num, den):
    ids = sorted(i for i, t in texts if i is not None)
    sets = {i: plain_set(t, n) for i, t in texts if i is not None}
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(ids, 2):
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y) and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(4)
    texts, i = [], 0
    for size in (1, 1, 2, 3, 40, 140):
        base = words(rng, rng.choice([4, 30, 120])).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = "".join(rng.choices(WORDS, k=5))
            texts.append((i * 7 % 1009, " ".join(own)))
            i += 1
    texts += [(2000, None), (2001, ""), (2002, "  "), (2003, "one"), (2004, "One"), (2005, "one two"), (2006, "x " * 3000), (2007, "X " * 2999)]
    docs = spark.createDataFrame([(*t, "other") for t in texts], "doc_id long, text string, component_id string")
    want = components(texts, 3, 85, 100)
    got = near_dedup.near_duplicates(docs, n=3, num=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    """Chains, copies and other texts of one cluster, in blocks so small that links lie across them."""
    rng = random.Random(8)
    monkeypatch.setattr(near_dedup, "SLACK", 30.0)
    base = words(rng, 60).split()
    texts = []
    for i in range(90):  # a chain: each a word further from the first
        own = list(base)
        for k in range(i % 45):
            own[k] = f"w{k}"
        texts.append((500 - i, " ".join(own)))
    texts += [(600 + i, " ".join(base[:20] + [f"u{i}x{k}" for k in range(40)])) for i in range(10)]
    texts += [(i, t) for i, t in texts[:30:7]] + [(500, " ".join(base[:58])), (501, words(rng, 30))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = [(k, i, t) for k, (i, t) in enumerate(texts)]
    sets = [plain_set(t, 2) for _, _, t in rows]
    label = [i for _, i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(rows)), 2):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    want = sorted((i, len(sets[k]), label[k]) for k, i, _ in rows)
    for block in (4, 128):
        got = near_dedup.near_duplicates(docs, n=2, num=90, block=block, rows=2, bands=100).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len({c for _, _, c in want}) > 3


def test_rows_that_share_an_id_are_linked_by_similarity_alone(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "u v w x y z"), (7, "U v w x y z"), (2, "k l m n o p")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(2, 2, True), (3, 3, True), (3, 3, True), (7, 3, False)]


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (4, "A b c d e f")], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [("3", 3, True), ("3", 3, True), ("4", 3, False), ("None", None, True)]


def test_intersections_and_registers():
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 2**64, 6000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, k)) for k in (1, 50, 3000, 5000)]
    both = near_dedup.intersections(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in itertools.permutations(range(4), 2))
    size = near_dedup.ROWS * near_dedup.BANDS
    registers = np.stack([near_dedup.signature(s, size, near_dedup._multipliers(size)) for s in sets])
    counts = np.array([len(s) for s in sets])
    guess = near_dedup.estimate(registers, counts)
    for i, j in itertools.combinations(range(1, 4), 2):
        exact = both[i, j] / (counts[i] + counts[j] - both[i, j])
        assert guess[i, j] == pytest.approx(exact, abs=0.15)
    values = np.array([1, 2**20, 2**63, 2**64 - 1], dtype=np.uint64)
    assert len(set(near_dedup.compress(values).tolist())) == 4


def labelled(rng, n):
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        text = words(rng, rng.randrange(20, 200))
        rows.append((i, text.capitalize() + "." if good else " ".join(w.upper() + "!!" for w in text.split()), int(good)))
    return rows


def test_quality_tells_held_out_rows_apart(spark):
    rows = labelled(random.Random(6), 700)
    docs = spark.createDataFrame([(i, t, "extra") for i, t, _ in rows] + [(9001, None, "x"), (9002, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(0, 1), (1, 0), (9005, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, held_out=quality.held_out())
    again = quality.fit(docs.repartition(5), labels.repartition(3), held_out=quality.held_out())
    assert model == again
    got = {r.doc_id: r for r in quality.with_quality(docs, model).withColumn("out", quality.held_out()).collect()}
    import zlib

    truth = {i: q for i, _, q in rows}
    assert all(r.out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    out = [i for i, r in got.items() if r.out and i in truth]
    assert len(out) > 80 and sum(got[i].predicted == truth[i] for i in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9001].score == got[9002].score


def test_scores_match_a_plain_reckoning(spark):
    """Sizes by zstandard itself, and the score by the formula, for empty, repeated and very long texts too."""
    import math
    import zlib

    import zstandard

    rng = random.Random(21)
    rows = labelled(rng, 400)
    docs = [(i, t) for i, t, _ in rows] + [(9000, ""), (9001, None), (9002, rows[0][1] * 800), (9003, "x"), (3, rows[3][1])]
    frame = spark.createDataFrame([(*d, "given", 7) for d in docs], "doc_id long, text string, score string, predicted int").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, None), (2, 5)], "doc_id long, quality int")
    model = quality.fit(frame, labels, held_out=quality.held_out())
    got = [(r.doc_id, r.score, r.predicted) for r in quality.with_quality(frame, model).collect()]
    held = {r.doc_id for r in frame.where(quality.held_out()).collect()}
    assert held == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}

    def size(dictionary, raw):
        made = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(made.compress(raw))

    def plain(text):
        raw = (text or "").encode()
        d = lambda x: (size(model.bad, x) - size(model.good, x)) / (size(model.bad, x) + size(model.good, x))
        worst = min(d(raw[k : k + quality.SEGMENT]) for k in range(0, max(1, len(raw) - quality.SEGMENT // 2), quality.SEGMENT)) if len(raw) > quality.SEGMENT else d(raw)
        each = math.log(size(model.good, raw) / max(1, len(raw)))
        x = [(v - c) / s for v, c, s in zip([d(raw), worst, each, each**2], model.centre, model.spread, strict=True)]
        return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights, strict=False)) + model.weights[-1]))))

    texts = {i: t for i, t in docs}
    assert len(got) == len(docs)
    for i, score, predicted in got:
        assert 0 <= score <= 1 and predicted == (score >= 0.3)
        if i >= 9000 or i % 7 == 0:
            assert score == pytest.approx(plain(texts[i]), abs=2e-3)
    assert quality.with_quality(frame.limit(0), model).count() == 0
    assert quality.fit(frame.limit(0), labels) is None


def test_quality_without_labels_scores_a_half(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    assert quality.with_quality(docs, None).first().score == 0.5
