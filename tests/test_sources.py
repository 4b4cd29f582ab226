import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tidewire.sources import archive, files, firehose, web_api


def _commit(did, us, collection, rkey, record=None, op="create"):
    return {"did": did, "time_us": us, "kind": "commit", "commit": {"operation": op, "collection": collection, "rkey": rkey, "record": record}}


def lines():
    P, R = firehose.POST, firehose.REPOST
    at = "2026-09-14T10:00:00.000Z"
    post = lambda **k: {"$type": P, "text": "t", "createdAt": at, "langs": ["pt"], **k}
    ev = [
        {"did": "did:A", "time_us": 1, "kind": "identity", "identity": {"did": "did:A", "handle": "a.bsky.social"}},
        _commit("did:A", 2, P, "1", post()),
        _commit("did:B", 3, P, "2", post(reply={"root": {"uri": f"at://did:C/{P}/9"}, "parent": {"uri": f"at://did:C/{P}/9"}})),
        _commit("did:A", 4, P, "3", post(embed={"$type": "app.bsky.embed.record", "record": {"uri": f"at://did:C/{P}/8"}})),
        _commit("did:B", 5, P, "4", post(facets=[{"features": [{"$type": "app.bsky.richtext.facet#mention", "did": d}]} for d in ("did:D", "did:A", "did:A", "did:B")])),
        _commit("did:A", 6, R, "5", {"subject": {"uri": f"at://did:C/{P}/7"}, "createdAt": at}),
        _commit("did:A", 7, P, "6", post(reply={"root": {"uri": f"at://did:A/{P}/1"}, "parent": {"uri": f"at://did:A/{P}/1"}})),
        _commit("did:A", 8, "app.bsky.feed.like", "7", {"subject": {"uri": f"at://did:C/{P}/7"}}),
        {"time_us": 9, "kind": "commit"},
        _commit("did:A", 10, P, "1", post()),
        _commit("did:A", 11, P, "1", op="delete"),
    ]
    return ["// a comment", ""] + [json.dumps(x) for x in ev]


def test_firehose_edges(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text("\n".join(lines()))
    events, skipped = firehose.scan(spark, str(tmp_path / "f.jsonl"))
    e = events.select("actor_uid", F.explode("targets").alias("t")).select("actor_uid", "t.uid", "t.kind").collect()
    assert sorted(map(tuple, e)) == sorted([("did:B", "did:C", "reply"), ("did:A", "did:C", "quote"), ("did:B", "did:D", "mention"), ("did:B", "did:A", "mention"), ("did:A", "did:C", "repost")])
    assert skipped.first()[0] == 2
    kinds = {r["cursor"]: (r["kind"], r["post_type"]) for r in events.collect()}
    assert kinds["7"] == ("post", "reply") and kinds["11"][0] == "delete" and kinds["1"][0] == "identity"
    assert firehose.scan(spark, str(tmp_path / "f.jsonl"), cursor=9)[0].count() == 2


def test_firehose_url_bounds():
    assert firehose.url("h", ["a", "b"], ["d"], 5) == "wss://h/subscribe?wantedCollections=a&wantedCollections=b&wantedDids=d&cursor=5"
    try:
        firehose.url("h", ["a"] * 101)
        raise AssertionError
    except ValueError:
        pass


def test_archive_rows(spark, tmp_path):
    base = dict(created_at="2023-01-25 02:53:06", tweet_content="x", user="ana", user_info="{'id': 1, 'name': 'Ana'}", has_mention=False, mentions=None, is_reply=False, reply_to=None, is_quote=False, quoted_from=None, is_retweet=False, retweeted_from=None, hashtags=None)
    rows = [
        base | dict(tweet_id=1, is_retweet=True, retweeted_from="{'user': 'bob', 'user_id': 2}", is_quote=True, quoted_from="{'user': 'cy', 'user_id': None}"),
        base | dict(tweet_id=2, mentions="[{'id': 5, 'username': 'd'}, {'id': 5, 'username': 'd'}, {'username': 'e'}]"),
        base | dict(tweet_id=3, is_reply=True, reply_to="{broken"),
        base | dict(tweet_id=4, created_at="yesterday"),
        base | dict(tweet_id=5, user=None, user_info=None),
    ]
    df = spark.createDataFrame(pd.DataFrame(rows)[[c.split()[0] for c in archive.SCHEMA.split(", ")]].astype(object).where(lambda x: x.notna(), None).values.tolist(), archive.SCHEMA)
    got = {r["post_uid"]: r for r in archive.normalize(df).collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"]["post_type"] == "repost" and [(t["kind"], t["uid"]) for t in got["1"]["targets"]] == [("repost", "2"), ("quote", "cy")]
    assert [(t["kind"], t["uid"]) for t in got["2"]["targets"]] == [("mention", "5"), ("mention", "e")] and got["2"]["post_type"] == "original"
    assert got["3"]["targets"] == [] and got["3"]["post_type"] == "original"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b.parquet", "x")
        z.writestr("a.parquet", "x")
        z.writestr("c.txt", "x")
    assert archive.members(str(tmp_path / "z.zip")) == ["a.parquet", "b.parquet"]
    r = spark.range(1).select(archive.file_label(F.lit("p/2023-01-25-lula livre.parquet")).alias("f")).first()["f"]
    assert (str(r["day"]), r["label"]) == ("2023-01-25", "lula livre")


def test_api_normalize(spark):
    who = {"id": "7", "userName": "u", "name": "U", "description": " ", "profile_bio": {"description": "bio"}, "createdAt": "Wed Aug 15 01:22:19 +0000 2012"}
    t = {"id": "1", "text": "x", "createdAt": "Sun Sep 20 16:41:37 +0000 2026", "author": who, "isReply": True, "inReplyToUserId": "9", "quoted_tweet": {"id": "3", "author": {"id": "8"}},
         "entities": {"user_mentions": [{"id_str": "9"}, {"id_str": "10", "screen_name": "z"}, {"id_str": "10"}]}}
    bad = [{"id": "2", "author": who, "createdAt": "never"}, {"id": "3", "createdAt": "2026-01-01"}, {"author": who}]
    pages = spark.createDataFrame([(json.dumps({"data": {"tweets": [t]}}),), (json.dumps({"tweets": bad}),)], "value string")
    r = web_api.normalize(web_api.posts_of(pages)).collect()
    assert len(r) == 1 and r[0]["actor_bio"] == "bio" and str(r[0]["actor_created_at"]) == "2012-08-15 01:22:19"
    assert [(x["kind"], x["uid"]) for x in r[0]["targets"]] == [("reply", "9"), ("quote", "8"), ("mention", "10")] and r[0]["post_type"] == "reply"


def test_budget_and_paging():
    calls = []

    class Fake(web_api.Transport):
        def get(self, path, **q):
            calls.append(path)
            return {"recharge_credits": 1000} if "info" in path else {"tweets": [], "has_next_page": True, "next_cursor": "n"}

    c = web_api.Collection(Fake("b", "k"), accounts=["a", "b", "c"], pages=2, cap_usd=0.007)
    assert len(list(c.payloads())) == 2 and c.frame["stopped_by"] == "budget" and c.frame["left_out"] == ["b", "c"]
    assert web_api.next_cursor({"has_next_page": False, "next_cursor": "x"}) is None
    try:
        web_api.check_body({"status": "error", "msg": "no"})
        raise AssertionError
    except web_api.ProviderError:
        pass


def test_probe_and_seeds(spark, tmp_path):
    df = spark.createDataFrame([(1, "ana", "oi", None)], "tweet_id int, user string, text string, created_at string")
    d = files.diagnose(df)
    assert d["verdict"] == "no edges" and d["no_handle"]
    assert files.diagnose(df.drop("text"))["verdict"] == "blocked" and files.diagnose(df.limit(0))["verdict"] == "empty"
    assert {r["column"]: r["null_share"] for r in files.describe(df).collect()}["created_at"] == 1.0
    (tmp_path / "s.txt").write_text("# x\nana\n? bob # doubtful\n\n")
    assert [tuple(r) for r in files.seeds(spark, str(tmp_path / "s.txt")).collect()] == [("ana", False), ("bob", True)]
