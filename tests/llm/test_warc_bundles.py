import hashlib
import random

import pytest
import zstandard

from merchlens.llm import files
from merchlens.llm import warc_bundles as W


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    rows = [(i, f"http://e.x/{i}", "".join(rng.choice("abc <>é\r\n") for _ in range(rng.choice([0, 50, 300, 5000])))) for i in range(200)]
    rows += [(1000 + i, None, rows[i % 7][2]) for i in range(60)] + [(500, "u v\r\nX: y", "z" * 99), (501, "u", "z" * 99), (502, "u", "z" * 100), (503, "u", "z" * 100)]
    rows += [(502, "u", "z" * 100), (None, "n", "z" * 100), (504, "", None), (505, None, None), (506, "w", "WARC/1.1\r\n\r\n" * 40), (507, "big", "q" * 900_000)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int").repartition(3)


def want(pages):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    out = []
    for page, body in rows:
        equal = [p for p, b in rows if b == body and p is not None]
        first = min(equal, default=None)
        revisit = len(body) >= 100 and first is not None and page != first
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("frame, bundle", [(W.FRAME_BYTES, W.BUNDLE_BYTES), (2000, 20_000)])
def test_round_trip(pages, frame, bundle):
    index = W.write_bundles(pages, frame_bytes=frame, bundle_bytes=bundle)
    rows = W.read_bundles(index).collect()
    got = [(None if r["record"] == "null" else int(r["record"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in rows]
    assert sorted(got, key=str) == want(pages)
    bodies = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for r in rows:
        if r["record_type"] == "response" and r["record"] != "null":
            assert bytes(r["payload"]) == bodies[int(r["record"])]


def test_one_record_by_its_place(pages):
    index = W.write_bundles(pages, frame_bytes=2000)
    rows = index.collect()
    r = rows[len(rows) // 2]
    bundle = files.map_file(r["bundle"])
    places = W.frame_places(bundle)
    headers, _, _ = W.parse(W.read_frame(bundle, places[r["frame"]])[r["offset"]:r["offset"] + r["length"]])
    assert headers["WARC-Record-ID"] == f"<urn:page:{r['record']}>"
    # Any Zstandard reader unpacks the whole bundle: the footer is a skippable frame.
    whole = b"".join(zstandard.ZstdDecompressor().decompress(bytes(bundle[a:a + n])) for a, n, _ in places)
    assert len(whole) == sum(p for *_, p in places) and whole.count(b"WARC-Record-ID") >= len([x for x in rows if x["bundle"] == r["bundle"]])
    assert bytes(bundle[sum(n for _, n, _ in places):][:4]) == W.SKIPPABLE.to_bytes(4, "little")


def test_damage_is_noticed(tmp_path):
    with pytest.raises(ValueError):
        W.frame_places(memoryview(b"0123456789abcdef"))


def test_empty(spark, pages):
    assert W.read_bundles(W.write_bundles(pages.limit(0))).collect() == []


def test_a_task_a_bundle(spark):
    rows = [(i, f"u{i}", f"{i} " * 3000) for i in range(400)]
    index = W.write_bundles(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2), frame_bytes=20_000, bundle_bytes=200_000)
    bundles = index.select("bundle").distinct().count()
    read = W.read_bundles(index, with_payload=False)
    tasks = {(r["p"], r["bundle"]) for r in index.select("bundle").repartitionByRange(bundles, "bundle").selectExpr("spark_partition_id() AS p", "bundle").distinct().collect()}
    assert bundles > 4 and len({p for p, _ in tasks}) >= 0.8 * bundles and len(tasks) == bundles
    assert read.rdd.getNumPartitions() >= 0.8 * bundles and read.count() == 400


def test_long_payload_and_other_columns(spark):
    rows = [(1, "u", "x y " * 1_500_000, "a", 1), (2, "u", "x y " * 1_500_000, "b", 2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, record string, bundle int").withColumnRenamed("record", "digest")
    out = {r["record"]: r for r in W.read_bundles(W.write_bundles(df)).collect()}
    assert out["1"]["payload_bytes"] == 6_000_000 and out["2"]["refers_to"] == "1" and out["2"]["record_type"] == "revisit"
