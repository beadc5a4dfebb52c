import hashlib
import random

import pytest
from cases import ROWS, documents, table
from oracle import same

from quarrydf.llm import common, lines


def brute(rows, m, words=None):
    """(id, text) to (kept text, removed line numbers); repeated pairs are one document."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, gone = set(), {r: set() for r in order}
    for r in order:
        cut = (r[1] or "").split("\n")
        for i in range(len(cut)):
            for k in range(1, m + 1):
                window = tuple(cut[i : i + k])
                if len(window) < k or k < m and (words is None or sum(len(s.split()) for s in window) < words):
                    continue
                if window in seen:
                    gone[r] |= set(range(i, i + k))
                seen.add(window)
    return {r: ("\n".join(x for i, x in enumerate((r[1] or "").split("\n")) if i not in gone[r]), sorted(gone[r])) for r in order}


def test_query_matches_sql(spark, sf):
    same(lines.op3_line_dedup(spark, sf), lines.OP3_SQL, sf)


@pytest.mark.parametrize("m,words", [(1, None), (2, 2), (3, 5), (4, None), (5, 6), (7, None), (3, None)])
def test_against_brute_force(spark, monkeypatch, m, words):
    monkeypatch.setattr(lines, "RANGE", 16)  # many ranges of the suffix array
    monkeypatch.setattr(common, "HEAVY", 50)  # both sides of the join by rank
    rng = random.Random(m)
    line = lambda: " ".join(rng.choice("abc") for _ in range(rng.choice([1, 1, 1, 2, 4])))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 14)))) for i in range(60)] + [(100, None), (101, ""), (102, "a\n" * 30), (None, "a\nb\nc\na\nb\nc\na\nb"), (103, "a b c a b c"), (104, "a b c a b c"), (105, "a b c a b c\na")]
    rows += [rows[3], rows[3]] + [(200 + i, rows[i][1]) for i in range(20)]
    want = brute(rows, m, words)
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_lines=m, min_words=words, stats=True).collect()
    assert len(got) == len(rows)
    by_id = {k[0]: v for k, v in want.items()}
    for r in got:
        text, gone = by_id[r["doc_id"]]
        assert r["text"] == text and r["n_removed"] == len(gone)
        assert [i for a, b in r["removed"] for i in range(a, b + 1)] == gone


def test_ranks_are_places_in_the_suffix_array(spark, monkeypatch):
    """By each depth, suffixes that share a prefix are neighbours in the sorted array, and ranks follow one order of the lines."""
    monkeypatch.setattr(lines, "RANGE", 8)
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))) for i in range(40)]
    read = lines._read(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id", 8, None)
    texts = common.materialize(read.selectExpr("id IS NULL AS no_id", "id", "a", "names").dropDuplicates(["a"]), "texts")
    total = texts.selectExpr("sum(size(names))").first()[0]
    name = {r["id"]: [n["x"] for n in r["names"]] for r in texts.collect()}
    for k, level in lines.suffix_ranks(texts, [1, 2, 4, 8], total).items():
        prefixes = sorted(tuple(ns[at : at + k]) for ns in name.values() for at in range(len(ns) - k + 1))
        shared = [p for p in prefixes if prefixes.count(p) > 1]
        got = {(r["id"], r["at"]): (r["r"], r["n"]) for r in level.collect()}
        want = {(i, at): (shared.index(p), shared.count(p)) for i, ns in name.items() for at in range(len(ns) - k + 1) if (p := tuple(ns[at : at + k])) in shared}
        assert got == want


def test_long_lines_count_for_their_words(spark):
    passage = " ".join(f"w{i}" for i in range(51))
    rows = [(1, passage), (2, f"one\n{passage}\ntwo"), (3, f"{passage} more"), (4, " ".join(passage.split()[:50])), (5, " ".join(passage.split()[:50])), (6, f"{passage}\nx"), (7, f"{passage}\nx")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: passage, 2: "one\ntwo", 3: rows[2][1], 4: rows[3][1], 5: rows[4][1], 6: "x", 7: ""}


def test_one_table_stays(spark, tmp_path):
    with common.scratch(spark) as own:
        lines.dedup(documents(spark)).collect()
        assert len(own.paths) == 1
    assert not own.paths


def test_awkward_rows(spark, tmp_path):
    docs = documents(spark, ["row", "body", "id", "digest", "removed", "lines"])
    out = lines.dedup(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    folder = table(spark, tmp_path, documents=docs)
    got = {r["doc_id"]: r for r in lines.op3_line_dedup(spark, folder).filter("doc_id IS NOT NULL").collect()}
    assert got[1]["n_removed"] == 0 and got[5]["removed"] == "0-3" and got[10]["removed"] == "2-5"
    assert got[5]["text_sha256"] == hashlib.sha256(b"").hexdigest() and got[2]["n_lines"] == 1
    assert lines.dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lines.dedup(docs, min_lines=0)


def test_native_plan(spark, sf):
    plan = lines.op3_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
