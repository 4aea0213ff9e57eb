import math

import numpy as np
import pyarrow as pa
import pytest

from cases import prose
from usageloom.llm import context_tree as ct
from usageloom.llm import language_id, lm_scoring, quality_model, quality_rules, queries
from usageloom.llm.arrays import bytes_of

SF = "/root/testdata/sf0.01"


def test_language_is_right_on_held_out_documents(spark):
    rows = queries.QUERIES["op7_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_language_of_odd_texts(spark, make_docs, odd_texts):
    model = language_id.fit([prose(i, 50) for i in range(20)] + ["der die das und nicht ist ein " * 9] * 20, ["fr"] * 20 + ["de"] * 20)
    docs = make_docs(odd_texts, clash=True)
    out = language_id.with_language(docs, model)
    assert set(out.columns) == set(docs.columns) | {"lang_pred", "score"}
    by = {(r.doc_id, r.text): r.lang_pred for r in out.collect()}
    assert {by[k] for k in ((1, None), (2, ""), (10, "!!! ### 123"), (13, "\n\n\n"), (None, None))} == {"und"}
    assert by[7, "日本語 テスト"] in ("fr", "de")
    none = language_id.with_language(docs, language_id.fit([], []))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    one = language_id.with_language(docs, language_id.fit(["ein Text"], ["de"]))
    assert {r.lang_pred for r in one.collect()} == {"und", "de"}
    assert language_id.with_language(make_docs([]), model).count() == 0


def test_quality_is_right_on_held_out_labels(spark):
    rows = queries.QUERIES["op8_quality_model"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    held = rows.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.quality == r.predicted for r in held) >= 0.95 * len(held)


def test_factorisation_machine_equals_the_sum_over_pairs(make_docs, odd_texts):
    texts = [t or "" for _, t in odd_texts] + [prose(i, 30) for i in range(30)]
    model = quality_model.fit(texts, [i % 2 for i in range(len(texts))], epochs=2)
    batch = pa.RecordBatch.from_pydict({"text": texts})
    data, bounds = bytes_of(batch.column(0))
    got = model.score(data, bounds)
    text, bucket, share, stats = quality_model.features(data, bounds)
    for i in (0, 2, 6, len(texts) - 1):
        x = np.zeros(quality_model.BUCKETS + quality_model.STATISTICS)
        x[bucket[text == i]] = share[text == i] * quality_model.WORD_SCALE
        x[quality_model.BUCKETS :] = model.scaled(stats[i])
        pairs = sum(
            (model.factors[a] @ model.factors[b]) * x[a] * x[b]
            for a in np.flatnonzero(x) for b in np.flatnonzero(x) if a < b
        )
        want = 1 / (1 + math.exp(-(model.bias + model.linear @ x + pairs)))
        assert got[i] == pytest.approx(want, abs=1e-4)
    rows = quality_model.with_quality(make_docs(odd_texts, clash=True), model).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_model.with_quality(make_docs(["a"]), quality_model.fit([], [])).collect()} == {0.5}


def plain_tree(texts, depth):
    """Context-tree weighting with dictionaries, straight from the definition."""
    counts = {}
    for text in texts:
        data = b"\n" * depth + b" ".join(text.encode().lower().split()) + b"\n"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                context, node = data[i - d : i], 1
                for bit in range(7, -1, -1):
                    one = data[i] >> bit & 1
                    counts.setdefault((context, node), [0, 0])[one] += 1
                    node = node * 2 + one
    children = {}
    for context, node in counts:
        if len(context) < depth + 1 and context:
            children.setdefault((context[1:], node), []).append((context, node))

    def kt(n):
        return sum(math.lgamma(x + 0.5) for x in n) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    weighted, stop = {}, {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(counts[key])
        if len(key[0]) == depth:
            weighted[key], stop[key] = own, 1.0
            continue
        under = sum(weighted[c] for c in children.get(key, ()))
        top = max(own, under)
        weighted[key] = top + math.log(math.exp(own - top) + math.exp(under - top)) - math.log(2)
        stop[key] = math.exp(own - math.log(2) - weighted[key])

    def score(text):
        data, total = b"\n" * depth + b" ".join(text.encode().lower().split()) + b"\n", 0.0
        for i in range(depth, len(data)):
            node = 1
            for bit in range(7, -1, -1):
                one = data[i] >> bit & 1
                mixed, left, last = 0.0, 1.0, 0.5
                for d in range(depth + 1):
                    key = (data[i - d : i], node)
                    if key not in counts:
                        break
                    n = counts[key]
                    last = (n[one] + 0.5) / (sum(n) + 1)
                    mixed += left * stop[key] * last
                    left *= 1 - stop[key]
                total += math.log10(mixed + left * last)
                node = node * 2 + one
        return total

    return score


@pytest.mark.parametrize("depth", [3, 5])
def test_scores_equal_plain_context_tree_weighting(make_docs, odd_texts, depth):
    texts = [(d, t) for d, t in odd_texts if len(t or "") < 3000] + [(20 + i, prose(i, 40)) for i in range(10)]
    from pyspark.sql import functions as F

    docs = make_docs(texts).withColumn("held_out", F.coalesce(F.col("doc_id") % 4 == 3, F.lit(False)))
    rows = lm_scoring.score_texts(docs, part_bytes=1500, buckets=5, depth=depth).collect()
    learned = [t or "" for d, t in texts if d is None or d % 4 != 3]
    score = plain_tree(learned, depth)
    words = [w for t in learned for w in [*t.encode().lower().split(), None]]
    seen = {w: words.count(w) for w in set(words)}
    assert len(rows) == len(texts)
    got = sorted((str(r.doc_id), round(r.score, 6), round(r.base_score, 6), r.n_tokens, r.n_known) for r in rows)
    want = []
    for d, t in texts:
        own = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((seen.get(w, 0) + 0.5) / (len(words) + 0.5 * (len(seen) + 1))) for w in own)
        want.append((str(d), round(score(t or ""), 6), round(base, 6), len(own), sum(w in seen for w in own)))
    for a, b in zip(got, sorted(want)):
        assert a[0] == b[0] and a[3:] == b[3:]
        assert a[1] == pytest.approx(b[1], rel=1e-6) and a[2] == pytest.approx(b[2], rel=1e-6)
    assert {r.train_tokens for r in rows} == {len(words)}


def test_scoring_without_training_rows_or_rows(make_docs):
    from pyspark.sql import functions as F

    rows = lm_scoring.score_texts(make_docs(["abc", ""]).withColumn("held_out", F.lit(True))).collect()
    assert sorted(round(r.score, 4) for r in rows) == [round(-4 * 8 * math.log10(2), 4), round(-8 * math.log10(2), 4)]
    assert lm_scoring.score_texts(make_docs([]).withColumn("held_out", F.lit(True))).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 100.0, 1e6])
    assert np.allclose(ct.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_rules_never_reject_more_than_allowed_of_good_documents(spark):
    rows = queries.QUERIES["op9_quality_rules"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    good = rows.join(labels, "doc_id").join(docs, "doc_id").where("not base_failed").collect()
    for lang in {r.lang for r in good}:
        own = [r for r in good if r.lang == lang]
        assert sum(not r.kept for r in own) <= quality_rules.RISK * len(own)


def test_exact_binomial_tail_and_cutoffs():
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.2), (40, 50, 0.5), (0, 5000, 0.01)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    counts = np.zeros(len(quality_rules.CUTOFFS) + 1, int)
    counts[-1] = 10_000
    assert quality_rules.cutoff(counts, 0.01, 0.001) == quality_rules.CUTOFFS[-1]
    counts[50] = 10_000
    assert quality_rules.cutoff(counts, 0.01, 0.001) == quality_rules.CUTOFFS[49]
    assert quality_rules.cutoff(counts * 0 + 0, 0.01, 0.001) is None
    few = np.zeros_like(counts)
    few[-1] = 30
    assert quality_rules.cutoff(few, 0.01, 0.001) is None


def test_rules_count_odd_texts(spark, make_docs, odd_texts):
    import re

    from pyspark.sql import functions as F

    docs = make_docs(odd_texts).withColumn("stratum", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(0, 1), (4, None), (None, 1), (0, 1)], "doc_id long, quality int")
    rows = quality_rules.judge(docs, labels).collect()
    assert len(rows) == len(odd_texts)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    for d, t in odd_texts:
        if d is None:
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = {w: windows.count(w) for w in set(windows)} if len(windows) < 2000 else None
        assert by[d].n_words == len(words) and by[d].word_chars == sum(map(len, words))
        assert by[d].base_failed == (len(words) < 50) or times is None or by[d].n_repeat_words * 2 > len(words)
        if times is not None:
            inside = {k for i, w in enumerate(windows) if times[w] > 1 for k in (i, i + 1, i + 2)}
            assert by[d].n_repeat_words == len(inside)
