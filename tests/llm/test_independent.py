"""Queries against what is known of their input, without a line of the operators' own code."""

import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest

from sonalyt.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, modulus, rest, limit", [("op3_quality", "quality", 5, 0, 0.3), ("op5_toxicity", "toxic", 3, 1, 0.7)])
def test_held_out_rows(spark, name, label, modulus, rest, limit):
    rows = registry.QUERIES[name](spark, SF).collect()
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"])["doc_id"].to_pylist()
    known = {r["doc_id"]: r[label] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
    told = [(known[r.doc_id], r.predicted) for r in rows if r.held_out and known.get(r.doc_id) is not None]
    ones, zeros = [p for y, p in told if y == 1], [p for y, p in told if y == 0]
    found, false = sum(ones) / len(ones), sum(zeros) / len(zeros)
    assert (found, 1 - false) >= (0.95, 0.5) if label == "quality" else found >= 0.7 and false <= 0.02, (found, false)


def test_planted_blocks_of_lines_go(spark, tmp_path):
    """Later documents take blocks of an earlier one, in its order, between lines of their own; exactly those lines go, and earlier documents stay whole."""
    r = random.Random(11)
    count = iter(range(10**6))
    line = lambda: " ".join(f"w{next(count)}" for _ in range(r.randrange(5, 9)))
    sources = [[line() for _ in range(40)] for _ in range(5)]
    docs, want = [(i, lines, []) for i, lines in enumerate(sources)], {i: lines for i, lines in enumerate(sources)}
    for i in range(100, 160):
        source, at, own, whole = r.choice(sources), 0, [], []
        while at < 34:
            mine, length = [line() for _ in range(r.randrange(1, 4))], r.randrange(2, 6)
            own += mine
            whole += mine + source[at : at + length]
            at += length + r.randrange(1, 9)
        docs.append((i, whole, own))
        want[i] = own
    r.shuffle(docs)
    frame = spark.createDataFrame([(i, "\n".join(lines), "en", "s", 0) for i, lines, _ in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: (x.n_lines, x.n_removed, x.kept_sha256) for x in registry.QUERIES["op10_lines"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(lines), len(lines) - len(want[i]), hashlib.sha256("\n".join(want[i]).encode()).hexdigest()) for i, lines, _ in docs}
