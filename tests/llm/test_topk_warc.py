import base64
import hashlib
import io
import math
from pathlib import Path

import numpy as np
import pytest
from edges import rows
from pyspark.sql import functions as F

from tessella.llm.queries import op9_top_k, op10_warc
from tessella.llm.topk import as_long, rotation, scaled, search_block, top_k
from tessella.llm.warc import read_records, read_warc, write_pages
from tessella.storage import shared_dir, shared_path


def brute(vectors, k, every):
    out = []
    for q, x in vectors.items():
        if q % every == 0:
            scored = sorted(((-float(x @ y), c) for c, y in vectors.items() if c != q))
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, query_block", [(16_384, 4_096), (64, 7)])
def test_top_k_equals_brute_force(spark, block, query_block):
    rng = np.random.default_rng(block)
    vectors = {i: np.floor(rng.normal(0, 3, 12) * rng.choice([0.1, 1, 5])) for i in range(500)}
    vectors[7] = vectors[9] = vectors[11]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, x array<double>")
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 20 == 0, k=20, block=block, query_block=query_block).collect()))
    assert got == brute(vectors, 20, 20)


def test_whole_scores_are_exact_beyond_doubles(spark):
    """Products of 2**60 that differ by 2 must keep their order, and components whose products pass every long too."""
    big = 2**30 + 1
    vectors = {0: [big, 3, 1], 1: [big, 2, 1], 2: [big, 2, 3], 3: [big, 1, 0], 4: [-big, 0, 0], 20: [1, 1, 1], 40: [2**45, 2**45, 5], 41: [2**45, 2**45, 7]}
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in vectors.items()], "vec_id long, x array<double>")
    want = []
    for q in (0, 20, 40):
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), c) for c, v in vectors.items() if c != q)
        want += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:4], 1)]
    for block in (16_384, 2):
        got = top_k(df, F.col("vec_id") % 20 == 0, k=4, block=block, whole=True)
        assert sorted((r[0], r[1], r[2], int(r[3])) for r in got.collect()) == want
    most = top_k(df, F.col("vec_id") % 20 == 0, k=1, whole=True).select("query_id", as_long(F.col("score"))).collect()
    assert {r[0]: r[1] for r in most}[40] == 2**63 - 1


def test_scaled_components_of_any_size(spark):
    values = [0.7, -0.7, 3.0e38, -3.0e38, 1e-30, -1e-30, 2.0**50 + 0.5]
    row = spark.createDataFrame([(values,)], "v array<double>").select(scaled(F.col("v"))).first()
    assert row[0] == [float(math.floor(v * 64.0)) for v in values]


def test_only_needed_blocks_are_sent(spark):
    """One long vector a query fills the first block; no later block can reach its score, and none is asked for."""
    vectors = [(i, [1000.0, 0.0] if i < 8 else [0.001 * (i % 7), 0.001]) for i in range(200)]
    df = spark.createDataFrame(vectors, "vec_id long, x array<double>")
    got = top_k(df, F.col("vec_id") == 0, k=3, block=8)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [1, 2, 3]
    folder = Path(shared_dir(spark).removeprefix("file:"))
    met = max(folder.rglob("met-*"), key=lambda p: p.stat().st_mtime)
    assert spark.read.parquet(f"file://{met}").count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, x array<double>")
    more = df
    for name in ("ask", "norm", "tie", "cb", "qb", "floor", "score", "rank", "query_id", "v", "gram"):
        more = more.withColumn(name, F.lit("clash"))
    assert rows(top_k(more, F.col("vec_id") % 20 == 0, k=3)) == rows(top_k(df, F.col("vec_id") % 20 == 0, k=3))
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", "y" * 3_000_000)], "page_id long, url string, html string")
    odd = pages
    for name in ("digest", "size", "first", "n", "value", "path"):
        odd = odd.withColumn(name, F.lit("clash"))
    path = shared_path(spark, "clash")
    write_pages(odd, path)
    got = read_warc(spark, path, "record_type string, payload_length long, payload binary").collect()
    assert sorted((r[0], r[1], len(r[2])) for r in got) == [("response", 8, 8), ("response", 3_000_000, 3_000_000), ("revisit", 8, 0)]


def test_equal_lengths_spread_over_blocks(spark):
    rng = np.random.default_rng(5)
    vectors = {}
    for i in range(300):
        v = np.zeros(8)
        v[rng.permutation(8)[:3]] = rng.choice([-2, 2], 3)
        vectors[i] = v
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, x array<double>")
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 20 == 0, k=5, block=40).collect())) == brute(vectors, 5, 20)


def test_pruning_loses_nothing_and_prunes():
    rng = np.random.default_rng(2)
    basis = rng.normal(size=(3, 16))
    x = rng.normal(size=(5000, 3)) @ basis * rng.lognormal(size=(5000, 1))
    q = rng.normal(size=(20, 3)) @ basis
    turn = rotation(x.T @ x)
    assert np.allclose(turn.T @ turn, np.eye(16))
    a, b, s = search_block(np.arange(20) + 10_000, q, np.full(20, -np.inf), np.arange(5000), x, turn, 5)
    want = np.sort((q @ x.T), axis=1)[:, ::-1][:, :5]
    assert np.allclose(np.reshape(s, (20, 5)), want)


def test_top_k_odd_input(spark):
    inf, nan = float("inf"), float("nan")
    data = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [inf, 0.0]), (80, [1.0, None]), (1, [1.0]), (2, [0.0, 0.0]), (None, [1.0, 1.0]), (3, []), (100, [-1.0, 0.5]), (100, [5.0, 5.0])]
    df = spark.createDataFrame(data, "vec_id long, x array<double>")
    out = top_k(df, F.col("vec_id") % 20 == 0)
    got = [tuple(r) for r in out.orderBy("query_id", "rank").collect()]
    assert got[:5] == [(0, 1, 100, 15.0), (0, 2, 1, 1.0), (0, 3, 2, 0.0), (0, 4, 3, 0.0), (0, 5, 100, 0.0)]
    assert {r[0] for r in got} == {0, 100} and len(got) == 9
    clash = df.withColumns({c: F.lit("clash") for c in ("ask", "floor", "norm", "tie", "cb", "qb", "m", "v")})
    assert rows(top_k(clash, F.col("vec_id") % 20 == 0)) == rows(out)
    assert top_k(df.where("false"), F.lit(True)).count() == 0 and top_k(df, F.lit(False)).columns == out.columns


def test_query_of_embeddings_has_every_query(spark):
    got = op9_top_k(spark, "/root/testdata/sf0.001")
    assert got.count() == 25 * 20 and dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


# WARC


def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string")


def expected(data):
    first = {}
    for p, _, h in data:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in data:
        raw = (h or "").encode()
        lead = first.get(h or "")
        response = lead is None or p == lead
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else lead))
    return sorted(out, key=str)


DATA = [
    (5, "http://a", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (9, "http://c\r\nX: y", "<p>same</p>"), (1, None, None), (2, "http://d", ""), (4, "http://e", "é\r\n\r\nWARC/1.1\r\n\r\nWARC-Type: response\r\n"),
    (None, "http://f", "<p>same</p>"), (None, "http://g", "alone"), (6, "http://h", "x" * 300_000), (7, "http://i", "tail\r\n\r\n"),
]


def test_archives_round_trip(spark, tmp_path):
    pages(spark, DATA).withColumns({"digest": F.lit(1), "first": F.lit(2), "size": F.lit(3), "n": F.lit(4)}).coalesce(2).write.parquet(str(tmp_path / "pages.parquet"))
    assert rows(op10_warc(spark, str(tmp_path))) == expected(DATA)


def test_empty_table_round_trip(spark, tmp_path):
    pages(spark, []).write.parquet(str(tmp_path / "pages.parquet"))
    assert op10_warc(spark, str(tmp_path)).count() == 0


def test_small_payloads_never_revisit_and_shuffled_join_agrees(spark, tmp_path):
    write_pages(pages(spark, DATA), str(tmp_path / "w"), least_bytes=100, broadcast_rows=0)
    assert read_warc(spark, str(tmp_path / "w"), "record_type string").where("record_type = 'revisit'").count() == 0


def test_predicates_are_pushed_and_payloads_kept_whole(spark, tmp_path):
    write_pages(pages(spark, DATA), str(tmp_path / "w"))
    got = read_warc(spark, str(tmp_path / "w"), "record_id string, target_uri string, payload binary").where("target_uri = 'http://e'").collect()
    assert [bytes(r.payload).decode() for r in got] == [DATA[5][2]]
    plan = read_warc(spark, str(tmp_path / "w"), "record_id string, record_type string").where("record_type IN ('revisit', 'x') AND record_id LIKE 'urn:%'")
    assert plan.count() == 4
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan warc" in text and "Filter" not in text.replace("RuntimeFilters", "")


def test_unwanted_blocks_are_not_read():
    class Counting(io.BytesIO):
        bytes_read = 0

        def read(self, n=-1):
            data = super().read(n)
            self.bytes_read += len(data)
            return data

    record = b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: 10000\r\n\r\n" + b"b" * 10_000 + b"\r\n\r\n"
    stream = Counting(b"".join(record % kind for kind in (b"request", b"response", b"request")))
    got = list(read_records(stream, lambda h: h["warc-type"] == "response", ["record_type", "payload"]))
    assert [r[0] for r in got] == ["response"] and len(got[0][1]) == 10_000 and stream.bytes_read == 10_000


def test_broken_archives_raise():
    with pytest.raises(ValueError, match="no WARC record"):
        list(read_records(io.BytesIO(b"nonsense\r\n"), lambda h: True, ["payload"]))
    with pytest.raises(ValueError, match="within its block"):
        list(read_records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"), lambda h: True, ["payload"]))
