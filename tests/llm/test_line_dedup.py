import pytest

from churnkit.llm import line_dedup
from tests.llm import cases


def plain(docs, size=3):
    places = {}
    texts = {(d, t) for d, t, *_ in docs if t is not None}
    for d, t in texts:
        lines = t.split("\n")
        for i in range(len(lines) - size + 1):
            places.setdefault(tuple(lines[i:i + size]), []).append((d is not None, d or 0, t, i))
    gone = {}
    for at in places.values():
        at.sort()
        for has, d, t, i in at[1:]:
            gone.setdefault((d if has else None, t), set()).update(range(i, i + size))
    out = []
    for d, t, *_ in docs:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        lines, cut = t.split("\n"), gone.get((d, t), set())
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in cut), len(lines), len(cut)))
    return sorted(out, key=str)


@pytest.mark.parametrize("clashing", [False, True])
def test_same_as_plain(spark, clashing):
    docs = cases.frame(spark, clashing=clashing)
    got = line_dedup.dedup_lines(docs)
    assert cases.rows(got.select("doc_id", "text", "n_lines", "n_removed")) == plain(cases.documents())
    assert got.columns == [*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed"]


def test_overlapping_windows_merge(spark):
    docs = [(1, "a\nb\nc\nd\ne", None, None, None), (2, "x\na\nb\nc\nd\ny", None, None, None), (3, "b\nc\nd", None, None, None),
            (4, "a\nb", None, None, None), (5, "q\nq\nq\nq\nq", None, None, None)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(cases.frame(spark, docs)).collect()}
    assert got == {1: "a\nb\nc\nd\ne", 2: "x\ny", 3: "", 4: "a\nb", 5: "q"}


def test_plan_is_native_and_empty_table(spark):
    df = line_dedup.dedup_lines(cases.frame(spark))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert line_dedup.dedup_lines(cases.empty(spark)).collect() == []


def test_long_text_of_equal_lines(spark):
    docs = [(1, "\n".join(["same"] * 20_000), None, None, None), (2, "\n".join(f"line {i}" for i in range(20_000)), None, None, None)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(cases.frame(spark, docs)).collect()}
    assert got[1]["text"] == "same" and got[1]["n_removed"] == 19_999 and got[2]["n_removed"] == 0
