"""Bounds of shards: what reaches the driver grows with the shards, whatever the ids; hot payloads stay spread."""

import random

import pytest
from pyspark.sql import functions as F

from brinkline.llm import warc
from brinkline.plans.shared import shared_root

N, SIZE, SHARD = 20_000, 2_000, 1_000_000


@pytest.mark.parametrize("shape", ["outlier", "two outliers", "clusters", "one id", "wide"])
def test_sums_on_the_driver_are_bounded_by_the_shards(spark, monkeypatch, shape):
    rng = random.Random(5)
    ids = {
        "outlier": [*range(N - 1), 100 * N],
        "two outliers": [-(2**63), *range(N - 2), 2**63 - 1],
        "clusters": [c * 2**40 + i for c in range(20) for i in range(N // 20)],
        "one id": [7] * N,
        "wide": [rng.randrange(-(2**63), 2**63) for _ in range(N)],
    }[shape]
    sizes = spark.createDataFrame([(i, SIZE) for i in ids], "page_id long, bytes long")
    seen, collect = [], type(sizes).collect
    monkeypatch.setattr(type(sizes), "collect", lambda self: seen.append(rows := collect(self)) or rows)
    cuts, shards = warc._cuts(sizes, SHARD, 1000)
    assert max(map(len, seen)) <= 32 * (N * SIZE // SHARD) and len(seen) <= 18
    monkeypatch.undo()
    placed = sizes.withColumn("shard", F.lit(None).cast("int"))
    for bits, table in cuts:
        placed = placed.join(F.broadcast(table.toDF("cell", "found")), F.shiftright("page_id", bits) == F.col("cell"), "left").withColumn("shard", F.coalesce("shard", "found")).drop("cell", "found")
    got = placed.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.min("page_id").alias("low"), F.max("page_id").alias("high")).orderBy("shard").collect()
    assert [r.shard for r in got] == list(range(shards)) and sum(r.bytes for r in got) == N * SIZE
    assert all(a.high < b.low for a, b in zip(got, got[1:], strict=False))
    assert shape == "one id" or max(r.bytes for r in got) <= SHARD


def test_a_payload_of_most_pages_and_many_rows_without_an_id(spark):
    rows = [(i, f"u{i}", "hot") for i in range(3000)] + [(5000 + i, f"u{i}", f"page {i // 2}") for i in range(200)] + [(None, f"n{i}", f"none {i % 40}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = f"{shared_root(spark)}/hot"
    manifest = warc.write_archives(pages, folder, shard_bytes=50_000)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.url): r.refers_to for r in got}
    assert all(by[i, f"u{i}"] == (None if i == 0 else 0) for i in range(3000))
    assert all(by[5000 + i, f"u{i}"] == (None if i % 2 == 0 else 5000 + i - 1) for i in range(200))
    assert all(by[None, f"n{i}"] is None for i in range(400))
    assert len({r.path.rsplit("/", 1)[1].split("-")[1] for r in manifest.collect()}) > 3000 * 503 // 50_000 + 4
