import base64
import hashlib

from brinkline.llm import warc
from brinkline.plans.shared import shared_root


def test_rows_of_one_page_id_are_decided_by_their_own_payloads(spark):
    rows = [(1, "a", "old"), (2, "b", "elder"), (5, "c", "old"), (5, "d", "own"), (6, "e", "old"), (6, "f", "elder"), (7, "g", "twice"), (7, "g", "twice"), (8, "h", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    first = {h: min(i for i, _, x in rows if x == h) for _, _, h in rows}
    want = sorted((i, u, digest(h), None if first[h] == i else first[h], h if first[h] == i else None) for i, u, h in rows)
    for most in (1_000_000, 0):
        got = warc.warc_round_trip(pages, shard_bytes=2000, broadcast_rows=most).collect()
        assert sorted((r.page_id, r.url, r.payload_digest, r.refers_to, r.payload and bytes(r.payload).decode()) for r in got) == want


def test_files_follow_from_the_rows_alone(spark):
    rows = [(i * 37 % 1009 - 300, f"http://h{i % 7}/é{i}", f"<p>{i % 90} {'x' * (i % 300)}{hashlib.sha256(str(i % 90).encode()).hexdigest() * 9}</p>") for i in range(1009)]
    rows += [(2**62, "far", "far away"), (-(2**62), "far", "far away"), (None, "n", "far away"), (None, "n", "only here"), (None, None, None), (4, "http://four", "four")] + [(77_777, f"u{i}", f"hot {i}") for i in range(300)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, shard string")
    runs = []
    for k, layout in enumerate((pages.repartition(1), pages.orderBy("html").repartition(9, "url"), pages.repartition(3))):
        folder = f"{shared_root(spark)}/out{k}"
        runs.append(sorted((r.path.rsplit("/", 1)[1], r.records, r.bytes, r.sha256) for r in warc.write_archives(layout, folder, roll_bytes=3000, shard_bytes=40_000, broadcast_rows=(10**6, 0, 10**6)[k]).collect()))
    assert runs[0] == runs[1] == runs[2]
    shards = {n.split("-")[1] for n, *_ in runs[0]}
    assert len(shards) > 5 and len(runs[0]) > 2 * len(shards)  # the roll, not the shard, ends most files
    assert sum(3000 <= size < 6000 for _, _, size, _ in runs[0]) >= len(runs[0]) - len(shards)
    back = warc.read_archives(spark.read.parquet(f"{folder}/manifest")).collect()
    assert len(back) == len(rows) and all(r.refers_to == -(2**62) for r in back if r.url in ("far", "n") and r.payload_digest == digest("far away") and r.page_id != -(2**62))
    assert [r.record_type for r in back if r.page_id is None].count("response") == 2


def digest(html):
    return base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
