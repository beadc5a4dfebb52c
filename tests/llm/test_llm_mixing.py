import math
import re
from collections import defaultdict

import pytest
import regex
from cases import ROWS, SCHEMA, documents, table
from hypothesis import given
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from quarrydf.llm import common, mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@given(st.lists(st.tuples(st.integers(0, 1000), st.sampled_from([1.0, 2.0, 3.0])), min_size=1, max_size=9), st.floats(0, 3))
def test_shares(sources, share):
    sizes, weights = [s for s, _ in sources], [w for _, w in sources]
    total = share * sum(sizes)
    targets = mixing.share_out(sizes, weights, total, 2)
    assert all(t <= 2 * s * (1 + 1e-12) for t, s in zip(targets, sizes))
    assert sum(targets) == pytest.approx(min(total, 2 * sum(sizes)))
    free = [t / w for t, w, s in zip(targets, weights, sizes) if t < 2 * s * (1 - 1e-9)]
    assert not free or max(free) == pytest.approx(min(free))


def brute(rows, weights):
    """taken by (key, tie) and source: rows are (source, size, key, tie)."""
    by = defaultdict(list)
    for source, size, key, tie in rows:
        by[source].append((key, tie, size))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(x[2] for x in by[s]) for s in names]
    targets = mixing.share_out(sizes, [weights[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    out = {}
    for s, n, t in zip(names, sizes, targets):
        epochs = int(t // n) if n else 0
        left, chosen, at, fits = t - epochs * n, set(), (-1, -(2**63)), 1 << 62
        if n and left > 0:
            for _ in range(1 + mixing.FILLS):
                total, last, over = 0, None, False
                for key, tie, size in sorted(x for x in by[s] if x[:2] > at and x[2] <= fits):
                    if total + size > left:
                        over = True
                        break
                    total, last = total + size, (key, tie)
                    chosen.add((key, tie))
                    end = (key, tie)
                if not over:
                    left = 0
                    break
                at = (key, tie - 1)
                left -= total
                fits = int(left)
                if left < 1:
                    break
            if left >= 1:
                free = [(abs(size - left), key, tie) for key, tie, size in by[s] if (key, tie) not in chosen and abs(size - left) < left]
                if free:
                    chosen.add(min(free)[1:])
        for key, tie, size in by[s]:
            out[s, key, tie] = size * (epochs + ((key, tie) in chosen))
    return out, dict(zip(names, targets))


def key_of(doc_id, text, source):
    """The key by its formula: -ln(u) / weight, u and the tie-break from chained XXH64 of seed, id and text."""
    tie = xxh64_intdigest((17).to_bytes(4, "little"), 42)
    for part in (str(doc_id) if doc_id is not None else None, text):
        tie = tie if part is None else xxh64_intdigest(part.encode(), tie)
    u = (xxh64_intdigest(tie.to_bytes(8, "little"), xxh64_intdigest(b"unit", 42)) % 2**53 + 0.5) / 2**53
    share = len(regex.findall(r"\p{L}", text or "")) / max(1, len(text or ""))
    return {"source": source, "size": words(text), "key": math.floor(-math.log(u) / max(share, 0.05) * 2**32), "tie": tie - (tie >> 63 << 64)}


def test_keys_follow_the_formula(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = docs.select("doc_id", "text", "source", mixing.mix_key("text", "source", "doc_id", None, 17).alias("m")).collect()
    for r in got:
        want = key_of(r["doc_id"], r["text"], r["source"])
        assert (r["m"]["source"], r["m"]["size"], r["m"]["tie"]) == (want["source"], want["size"], want["tie"])
        assert r["m"]["key"] == pytest.approx(want["key"], rel=1e-14, abs=2)


def test_names_of_its_own_may_be_taken(spark):
    names = ["row", "m", "name", "spans", "epochs", "target", "mix_notes", "__mix"]
    df = documents(spark, [*names, "mix_copies"])
    with common.scratch(spark) as own:
        rows = mixing.mix(df, mixing.WEIGHTS).collect()
        assert not own.paths
    assert len(rows) == len(ROWS) and all(r[c] == "mine" for r in rows for c in names) and all(isinstance(r["mix_copies"], int) for r in rows)


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keys = {r["doc_id"]: key_of(r["doc_id"], r["text"], r["source"]) for r in docs.collect()}
    want, targets = brute([(m["source"], m["size"], m["key"], m["tie"]) for m in keys.values()], mixing.WEIGHTS)
    got = mixing.op2_mixing(spark, sf).collect()
    assert len(got) == docs.count()
    totals, sizes, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        m = keys[r["doc_id"]]
        assert r["taken"] == want[m["source"], m["key"], m["tie"]] and r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(targets[m["source"]])
        totals[m["source"]] += r["taken"]
        sizes[m["source"]] += r["size"]
        largest[m["source"]] = max(largest[m["source"]], r["size"])
    for r in got:
        assert r["source_size"] == sizes[keys[r["doc_id"]]["source"]]
    # whole documents: no source is off by its largest one
    assert all(abs(totals[s] - targets[s]) <= largest[s] for s in totals)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op2_mixing(spark, sf).collect()))


def test_awkward_rows(spark, tmp_path):
    folder = table(spark, tmp_path, documents=documents(spark, ["mix_size", "size", "taken"]))
    got = mixing.op2_mixing(spark, folder).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((r[0], words(r[1])) for r in ROWS), key=str)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    repeated = [tuple(r) for r in got if r["doc_id"] == 5]
    assert len(repeated) == 2 and repeated[0] == repeated[1]


def test_quality_weighs(spark):
    rows = [(i, "w " * 10, "en", "s", 20) for i in range(400)] + [(1000 + i, "0 " * 10, "en", "s", 20) for i in range(400)]
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA), [1.0], share=0.5).collect()
    taken = lambda low, high: sum(r["mix_taken"] for r in mixed if low <= r["doc_id"] < high)
    assert taken(0, 1000) > 4 * taken(1000, 2000) and taken(0, 2000) == 4000


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), [3.0, 1.0]).count() == 0
