import numpy as np

from cases import prose
from usageloom.llm import quality_rules


def test_each_stratum_with_enough_labels_rejects_bad_rows(spark):
    need = quality_rules.labels_needed(4)
    docs, labels = [], []
    for s, stratum in enumerate(["de", "en", "es", None]):
        for i in range(need + 5):
            docs.append((1000 * s + i, stratum, prose(1000 * s + i, 60)))
            labels.append((1000 * s + i, 1))
        for i in range(900, 920):
            docs.append((1000 * s + i, stratum, prose(1000 * s + i, 60) + " ## ** %% $$ ||" * 8))
            labels.append((1000 * s + i, 0))
    rows = quality_rules.judge(
        spark.createDataFrame(docs, "doc_id long, stratum string, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    ).collect()
    assert len(rows) == len(docs) and not any(r.base_failed for r in rows)
    for stratum in ("de", "en", "es", None):
        own = [r for r in rows if r.stratum == stratum]
        assert not any(r.kept for r in own if r.doc_id % 1000 >= 900)
        good = [r for r in own if r.doc_id % 1000 < 900]
        assert sum(not r.kept for r in good) <= quality_rules.RISK * len(good)


def test_levels_are_shared_by_strata_that_can_certify():
    assert [quality_rules.labels_needed(k) for k in (1, 4)] == [149, 217]

    def counts(n, bad=0):
        out = np.zeros(len(quality_rules.CUTOFFS) + 1, int)
        out[-1], out[60] = n - bad, bad
        return out

    assert quality_rules.levels([counts(223), counts(47)], 0.02, 0.05) == [0.05, 0.0]
    assert quality_rules.levels([counts(148), counts(47)], 0.02, 0.05) == [0.0, 0.0]
    assert quality_rules.levels([counts(400), counts(400, 100)], 0.02, 0.05) == [0.025, 0.05]
    assert quality_rules.levels([], 0.02, 0.05) == []
