import json
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_sources import _commit, lines

from tidewire.sources import firehose
from tidewire.streaming import ingest


def test_stream_lands_once_and_follows_late_data(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join(lines()))
    ingest.start(spark, str(src), out, mark).awaitTermination()
    count = lambda t: spark.read.parquet(f"{out}/{t}").count()
    posts, inter = count("post"), count("interaction")
    assert inter == 5 and posts == spark.read.parquet(f"{out}/post").select("platform", "post_uid").distinct().count()
    weight = lambda: spark.read.parquet(f"{out}/edge_window").agg({"weight": "sum"}).first()[0]
    assert weight() == 5
    late = _commit("did:E", 99, firehose.REPOST, "1", {"subject": {"uri": f"at://did:C/{firehose.POST}/7"}, "createdAt": "2026-09-14T00:00:01Z"})
    (src / "b.jsonl").write_text(json.dumps(late) + "\n" + lines()[3])
    ingest.start(spark, str(src), out, mark).awaitTermination()
    assert count("interaction") == 6 and count("post") == posts + 1 and weight() == 6
    assert count("tombstone") == 1


def test_events_half_a_year_late_and_deletes(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join(lines()[:-1]))
    ingest.start(spark, str(src), out, mark).awaitTermination()
    table = lambda t: {r["post_uid"]: r for r in spark.read.parquet(f"{out}/{t}").collect()}
    uid = f"did:A/{firehose.POST}/1"
    assert table("post")[uid]["text"] == "t" and table("raw")[uid]["payload"]
    late = _commit("did:F", 50, firehose.REPOST, "1", {"subject": {"uri": f"at://did:C/{firehose.POST}/7"}, "createdAt": "2026-03-02T00:00:01Z"})
    unknown = _commit("did:Z", 51, firehose.POST, "9", op="delete")
    (src / "b.jsonl").write_text("\n".join([json.dumps(late), json.dumps(unknown), lines()[-1], json.dumps(_commit("did:A", 52, firehose.REPOST, "5", op="delete"))]))
    ingest.start(spark, str(src), out, mark).awaitTermination()
    posts, raw = table("post"), table("raw")
    assert f"did:F/{firehose.REPOST}/1" in posts and posts[uid]["text"] is None and posts[uid]["deleted_at"] is not None and raw[uid]["payload"] is None
    assert raw[f"did:B/{firehose.POST}/2"]["payload"] and posts[f"did:B/{firehose.POST}/2"]["text"] == "t"
    assert spark.read.parquet(f"{out}/interaction").where(f"post_uid = 'did:A/{firehose.REPOST}/5'").count() == 1  # edges stay
    weeks = {str(r[0]): r[1] for r in spark.read.parquet(f"{out}/edge_window").groupBy("window_start").agg({"weight": "sum"}).collect()}
    assert weeks == {"2026-03-02": 1.0, "2026-09-14": 5.0}
    runs = spark.read.parquet(f"{out}/run").agg({"unknown_deletes": "sum", "new_posts": "sum"}).first()
    assert sorted(runs) == sorted([1, len(posts)])
