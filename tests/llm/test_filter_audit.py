import re
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from cases import CLASHING, prose
from usageloom.llm import filter_audit


def plain_fails(rows):
    """The letters each row fails, by reading the contract."""
    key = [-(1 << 63) if d is None else d for d, *_ in rows]
    texts = [t or "" for _, t, *_ in rows]
    out = []
    for k, text in zip(key, texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append(
            {
                letter
                for letter, wrong in {
                    "A": len(words) < 200,
                    "B": 100 * len(set(words)) < 50 * len(words),
                    "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                    "D": bool(re.search(r"[#$%&*|]", text)),
                    "E": any(other == text and o < k for o, other in zip(key, texts)),
                }.items()
                if wrong
            }
        )
    return out


def plain_audit(rows, labels):
    fails = plain_fails(rows)
    good = {d for d, quality, _ in labels if quality == 1 and d is not None}
    toxic = {d for d, _, bad in labels if bad == 1 and d is not None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        removed_in = {letter: 0 for letter in "ABCDE"}
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                removed_in[letter] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone),
                    sum(f == {letter} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_in[order[step - 1]])
    return out


def audited(spark, rows, labels, clash=False):
    schema = "doc_id long, text string, source string"
    if clash:
        rows = [(*r, *["x"] * len(CLASHING)) for r in rows]
        schema += "".join(f", `{c}` string" for c in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, marks, F.col("source")).collect()
    assert all(r["filter"] == r.filter_order[r.step - 1] for r in found)
    return {
        (r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
        for r in found
    }


def test_audit_equals_brute_force(spark, odd_texts):
    long = " ".join(prose(i, 12) for i in range(40))
    rows = [(d, t, ["a", None, "", "b"][i % 4]) for i, (d, t) in enumerate(odd_texts)]
    rows += [(100 + i, long if i % 3 else long + " $", "hot") for i in range(30)]
    rows += [(200, "ABC " * 300, "b"), (201, None, "b"), (202, "  x", "b"), (203, "a\x0bb\x1cc", "c")]
    rows += [(204, "A" + "b" * 49, "c"), (205, "A" + "b" * 48, "c"), (206, " ".join(f"w{i % 100}" for i in range(200)), "c")]
    rows += [(207, " ".join(f"w{i % 99}" for i in range(200)), "c"), (208, "\n".join(f"w{i}" for i in range(199)), "c")]
    labels = [(d, i % 2, (i // 2) % 2) for i, (d, *_) in enumerate(rows)] + [(100, 0, 0), (100, 1, None), (None, 1, 1)]
    want = plain_audit(rows, labels)
    assert audited(spark, rows, labels, clash=True) == want
    assert len(want) == 600 * len({r[2] or "" for r in rows})


def test_no_documents_no_rows(spark):
    assert audited(spark, [], []) == {}


def test_shapley_map_is_the_average_over_orders():
    factors = filter_audit.shapley_map()
    for i in range(5):
        want = [0] * 32
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            want[before | 1 << i] += 1
            want[before] -= before > 0  # nothing is removed by no filter
        assert factors[i] == want


def test_rational_solver():
    a = [[Fraction(0), Fraction(2)], [Fraction(3), Fraction(1)]]
    assert filter_audit._solve(a, [[Fraction(4)], [Fraction(5)]]) == [[Fraction(1)], [Fraction(2)]]


def test_efficiency(spark):
    """The five values of a part sum to 120 times the documents that any filter removes."""
    rows = [(i, prose(i % 7, 30 * i), f"s{i % 2}") for i in range(20)]
    found = audited(spark, rows, [])
    for part in ("s0", "s1"):
        first = {o[0]: counts for (p, o, s), counts in found.items() if p == part and s == 1}
        kept = found[part, "ABCDE", 5][0]
        assert sum(c[6] for c in first.values()) == pytest.approx(120 * (10 - kept), abs=0)
