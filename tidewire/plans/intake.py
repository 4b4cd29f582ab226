"""Queries over sources, ingestion and text functions, with their DuckDB twins: events stand in for what providers send."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import times, words
from tidewire.operators import correspondence, ingest, seeds, text
from tidewire.sources import adapters as A
from tidewire.sources import archive, files, firehose, web_api
from tidewire.sources.events import EVENT_COLUMNS, target

from .registry import query

ISO = "'%Y-%m-%dT%H:%M:%SZ'"
EV = """WITH ev AS (SELECT 'x' AS platform, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'identity' ELSE 'post' END AS kind, 'u' || user_id AS actor_uid,
    CASE WHEN event_type = 'signup' THEN 'h' || (event_id % 3) END AS actor_handle, ts AS occurred_at, CAST(event_id AS VARCHAR) AS cursor, 'a' || (user_id % 5) AS cursor_account, 'p' || (event_id // 3) AS post_uid,
    't' || event_id AS text, 'u' || json_extract_string(props, '$.k') AS dst, CASE event_type WHEN 'click' THEN 'repost' WHEN 'view' THEN 'quote' WHEN 'purchase' THEN 'reply' ELSE 'mention' END AS tkind, props AS raw, event_id, user_id, value FROM events),
np AS (SELECT * FROM ev WHERE kind = 'post' QUALIFY row_number() OVER (PARTITION BY platform, post_uid ORDER BY occurred_at, cursor) = 1),
dead AS (SELECT platform, post_uid, min(occurred_at) AS gone_at FROM ev WHERE kind = 'delete' GROUP BY ALL)
"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Normalized events: errors are deletes, sign-ups identities; three events share a post."""
    t, user = F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    to = F.when(t == "click", "repost").when(t == "view", "quote").when(t == "purchase", "reply").otherwise("mention")
    none = F.lit(None).cast("string")
    given = {
        "platform": F.lit("x"), "kind": F.when(t == "error", "delete").when(t == "signup", "identity").otherwise("post"), "actor_uid": user, "actor_handle": F.when(t == "signup", F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string"))),
        "actor_display_name": none, "actor_bio": none, "actor_created_at": none.cast("timestamp"), "occurred_at": F.col("ts"), "cursor": F.col("event_id").cast("string"), "cursor_account": F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string")),
        "post_uid": F.concat(F.lit("p"), F.floor(F.col("event_id") / 3).cast("string")), "post_type": F.lit("original"), "text": F.concat(F.lit("t"), F.col("event_id").cast("string")), "lang": F.lit("en"),
        "targets": F.array(F.struct(to.alias("kind"), target("x", F.concat(F.lit("u"), F.col("k")))["uid"].alias("uid"), *[none.alias(c) for c in ("handle", "post_uid", "display_name", "bio")], none.cast("timestamp").alias("created_at"))), "raw": F.col("props"),
    }
    return _raw(spark, d).select(*[given[c].alias(c) for c in EVENT_COLUMNS])


def _early(spark: SparkSession, d: str) -> DataFrame:
    """Posts that are there already: those of the first third of the events."""
    return ingest.new_posts(_events(spark, d)).where("CAST(cursor AS BIGINT) < 1000").select("platform", "post_uid")


@query("B1_new_posts", EV + "SELECT platform, post_uid, actor_uid, text FROM np WHERE post_uid NOT IN (SELECT post_uid FROM np WHERE event_id < 1000)")
def new_posts(spark, d):
    return ingest.new_posts(_events(spark, d), _early(spark, d)).select("platform", "post_uid", "actor_uid", "text")


@query("B2_new_interactions", EV + "SELECT DISTINCT post_uid, tkind AS kind, dst FROM ev WHERE kind = 'post' AND actor_uid <> dst AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.kind = 'post' AND o.actor_uid <> o.dst AND o.event_id < 1000 AND o.post_uid = ev.post_uid AND o.tkind = ev.tkind AND o.dst = ev.dst)")
def new_interactions(spark, d):
    ev = _events(spark, d)
    return ingest.new_interactions(ev, ingest.new_interactions(ev.where("CAST(cursor AS BIGINT) < 1000"))).select("post_uid", "kind", "dst")


OLD = "old AS (SELECT 'u' || user_id AS uid, 'old' || user_id AS handle, CASE WHEN user_id % 10 = 0 THEN 'A' WHEN user_id % 10 = 1 THEN 'B' ELSE 'C' END AS tier, TIMESTAMP '2024-01-03' AS seen FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0))"
SEEN = "s AS (SELECT actor_uid AS uid, actor_handle AS handle, occurred_at, cursor, CASE WHEN user_id % 4 = 1 THEN 'B' ELSE 'C' END AS tier FROM ev UNION ALL SELECT dst, NULL, occurred_at, cursor, 'C' FROM ev), n AS (SELECT uid, arg_max(handle, (occurred_at, cursor)) FILTER (handle IS NOT NULL) AS handle, min(tier) AS tier, min(occurred_at) AS a, max(occurred_at) AS z FROM s GROUP BY uid)"


@query("B3_J9_actor_upsert", EV + f", {OLD}, {SEEN} SELECT uid, coalesce(n.handle, old.handle) AS handle, least(coalesce(n.tier, 'C'), coalesce(old.tier, 'C')) AS tier, strftime(least(a, coalesce(seen, a), coalesce(a, seen)), {ISO}) AS first_seen, strftime(greatest(coalesce(z, seen), coalesce(seen, z)), {ISO}) AS last_seen FROM n FULL JOIN old USING (uid)")
def actor_upsert(spark, d):
    users = _raw(spark, d).where("user_id % 2 = 0").select("user_id").distinct()
    u, at = F.col("user_id"), F.lit("2024-01-03").cast("timestamp")
    none = F.lit(None).cast("string")
    old = users.select(F.lit("x").alias("platform"), F.concat(F.lit("u"), u.cast("string")).alias("uid"), F.concat(F.lit("old"), u.cast("string")).alias("handle"), none.alias("display_name"), none.alias("bio"), F.when(u % 10 == 0, "A").when(u % 10 == 1, "B").otherwise("C").alias("tier"), at.alias("first_seen"), at.alias("last_seen"))
    ev = _events(spark, d)
    own = F.col("actor_uid").substr(2, 9).cast("long") % 4 == 1
    seen = ingest.sightings(ev.where(own), "B").unionByName(ingest.sightings(ev.where(~own)))
    return seeds.upsert(old, seen).select("uid", "handle", "tier", times.iso(F.col("first_seen")).alias("first_seen"), times.iso(F.col("last_seen")).alias("last_seen"))


@query("B4_raw_archive", EV + "SELECT 7 AS run_id, platform, post_uid, arg_max(raw, cursor) AS payload FROM ev WHERE kind = 'post' AND post_uid NOT IN (SELECT post_uid FROM dead) GROUP BY ALL")
def raw_archive(spark, d):
    ev = _events(spark, d)
    return ingest.raw_archive(ev, 7, ingest.tombstones(ev)).select("run_id", "platform", "post_uid", "payload")


def _deleted(spark, d):
    ev = _events(spark, d)
    return ingest.apply_deletes(ingest.new_posts(ev), ingest.raw_archive(ev, 7), ingest.tombstones(ev))


@query("B5_J7_deletes", EV + f"SELECT post_uid, CASE WHEN gone_at IS NULL THEN text END AS text, strftime(gone_at, {ISO}) AS deleted_at FROM np LEFT JOIN dead USING (platform, post_uid)")
def deletes(spark, d):
    return _deleted(spark, d)[0].select("post_uid", "text", times.iso(F.col("deleted_at")).alias("deleted_at"))


@query("B5_raw_left", EV + "SELECT DISTINCT post_uid FROM ev WHERE kind = 'post' AND post_uid NOT IN (SELECT post_uid FROM dead)")
def raw_left(spark, d):
    return _deleted(spark, d)[1].select("post_uid")


@query("B5_unknown_deletes", EV + "SELECT count(*) AS unknown FROM dead WHERE post_uid NOT IN (SELECT post_uid FROM np)")
def unknown_deletes(spark, d):
    return _deleted(spark, d)[2]


@query("C10_active_posts", EV + "SELECT post_uid, text FROM np WHERE post_uid NOT IN (SELECT post_uid FROM dead)")
def active_posts(spark, d):
    return ingest.active(_deleted(spark, d)[0]).select("post_uid", "text")


@query("B6_J3_cursors", EV + "SELECT 'x_api' AS source, cursor_account AS account, arg_max(cursor, event_id) AS cursor FROM ev GROUP BY cursor_account")
def cursors(spark, d):
    return ingest.cursors(_events(spark, d), "x_api")


@query("B6_cursor_store", EV + "SELECT 'x_api' AS source, cursor_account AS account, CAST(greatest(max(event_id), 9000) AS VARCHAR) AS cursor FROM ev GROUP BY cursor_account UNION ALL SELECT 'other', 'a0', '5'")
def cursor_store(spark, d):
    old = spark.createDataFrame([("x_api", f"a{k}", "9000") for k in range(5)] + [("other", "a0", "5")], "source string, account string, cursor string")
    return ingest.merge_cursors(old, ingest.cursors(_events(spark, d), "x_api"))


@query("B7_runs", "SELECT * FROM (VALUES (1, 'ok', 'first', 10, 0.5::DOUBLE), (2, 'failed', 'new', 3, 0.1), (3, 'open', 'third', 0, 0.0)) t(run_id, status, frame, items, cost_usd)")
def runs(spark, d):
    r = ingest.open_run(ingest.open_run(ingest.open_run(None, spark, 1, "first"), spark, 2, "second"), spark, 3, "third")
    return ingest.close_run(ingest.close_run(r, 1, "ok", 10, 0.5), 2, "failed", 3, 0.1, frame="new")


@query("J8_counters", EV + "SELECT count(*) AS seen, count(*) FILTER (kind = 'post') AS post_events, count(*) FILTER (kind = 'delete') AS deletes, count(*) FILTER (kind = 'identity') AS identities, (SELECT count(*) FROM np) AS new_posts, count(*) FILTER (kind = 'post') - (SELECT count(*) FROM np) AS repeats FROM ev")
def counters(spark, d):
    ev = _events(spark, d)
    return ingest.counters(ev, ingest.new_posts(ev))


@query("B13_snapshots", "SELECT user_id AS actor_id, CAST(ts AS DATE) AS snapshot_date, arg_max(event_id, ts) AS followers, arg_max(event_id % 7, ts) AS following, arg_max(event_id % 11, ts) AS posts FROM events GROUP BY ALL")
def snapshots(spark, d):
    return ingest.snapshots(_raw(spark, d).select(F.col("user_id").alias("actor_id"), F.col("ts").alias("seen_at"), F.col("event_id").alias("followers"), (F.col("event_id") % 7).alias("following"), (F.col("event_id") % 11).alias("posts")))


@query("B10_positions_replaced", "SELECT user_id AS actor_id, CASE WHEN k = 0 THEN 'hand' ELSE 'amp' END AS axis, CASE WHEN k = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS score FROM (SELECT DISTINCT user_id FROM events), (VALUES (0), (1)) v(k)")
def positions_replaced(spark, d):
    u = _raw(spark, d).select(F.col("user_id").alias("actor_id")).distinct()
    old = u.select("actor_id", F.explode(F.array(F.lit("hand"), F.lit("amp"), F.lit("amp2"))).alias("axis"), F.lit(1.0).alias("score"))
    return correspondence.replaced(old, u.select("actor_id", F.lit("amp").alias("axis"), F.lit(2.0).alias("score")))


@query("L5_C4_demote", A.CTE + "SELECT actor_id, CASE WHEN lower(handle) IN ('user10', 'user20', 'user31') THEN 'C' ELSE tier END AS tier FROM actor")
def demote(spark, d):
    return seeds.demote(A.actors(spark, d), spark.createDataFrame([("USER10",), ("user20",), ("User31",)], "name string")).select("actor_id", "tier")


# ---------------------------------------------------------------- sources

KIND = "CASE event_type WHEN 'click' THEN 'repost' WHEN 'view' THEN 'quote' WHEN 'purchase' THEN 'reply' WHEN 'signup' THEN 'mention' END"


def _pairs(events: DataFrame) -> DataFrame:
    return events.select("post_uid", "actor_uid", "post_type", times.iso(F.col("occurred_at")).alias("occurred_at"), F.explode_outer("targets").alias("t")).select("post_uid", "actor_uid", "post_type", "occurred_at", F.col("t.kind").alias("kind"), F.col("t.uid").alias("dst"))


@query("A2_A4_A9_firehose", f"""SELECT 'd' || user_id || '/app.bsky.feed.' || CASE WHEN event_type = 'click' THEN 'repost' ELSE 'post' END || '/' || event_id AS post_uid, 'd' || user_id AS actor_uid,
CASE event_type WHEN 'click' THEN 'repost' WHEN 'view' THEN 'quote' WHEN 'purchase' THEN 'reply' ELSE 'original' END AS post_type, strftime(ts, {ISO}) AS occurred_at, CASE WHEN user_id <> k THEN {KIND} END AS kind, CASE WHEN user_id <> k THEN 'd' || k END AS dst
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type <> 'error' AND NOT (event_type = 'click' AND user_id = k)""")
def firehose_events(spark, d):
    t, e = F.col("event_type"), _raw(spark, d)
    uri = F.concat(F.lit("at://d"), F.col("k"), F.lit("/app.bsky.feed.post/1"))
    ref = F.struct(uri.alias("uri"))
    kind = "app.bsky.embed.record"
    record = F.struct(
        F.lit("t").alias("text"), times.iso(F.col("ts")).alias("createdAt"), F.when(t == "click", ref).alias("subject"), F.when(t == "purchase", F.struct(ref.alias("root"), ref.alias("parent"))).alias("reply"),
        F.when((t == "view") & (F.col("event_id") % 2 == 0), F.struct(F.lit(kind).alias("$type"), F.struct(uri.alias("uri"), F.lit(None).cast("struct<uri:string>").alias("record")).alias("record")))
        .when(t == "view", F.struct(F.lit(kind + "WithMedia").alias("$type"), F.struct(F.lit(None).cast("string").alias("uri"), ref.alias("record")).alias("record"))).alias("embed"),
        F.when(t == "signup", F.array(F.struct(F.array(*[F.struct(F.lit("app.bsky.richtext.facet#mention").alias("$type"), F.concat(F.lit("d"), F.col("k")).alias("did"))] * 2).alias("features")))).alias("facets"),
    )
    where = F.when(t == "error", "app.bsky.feed.like").when(t == "click", firehose.REPOST).otherwise(firehose.POST)
    commit = F.struct(F.lit("create").alias("operation"), where.alias("collection"), F.col("event_id").cast("string").alias("rkey"), record.alias("record"))
    lines = e.select(F.to_json(F.struct(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("did"), F.col("event_id").alias("time_us"), F.lit("commit").alias("kind"), commit.alias("commit"))).alias("value"))
    odd = spark.createDataFrame([("// a comment",), ("  ",), ('{"time_us": 1, "kind": "commit"}',)], "value string")
    return _pairs(firehose.normalize(firehose.parse(lines.union(odd))))


@query("A11_A13_A15_archive", f"""SELECT CAST(event_id AS VARCHAR) AS post_uid, CAST(user_id AS VARCHAR) AS actor_uid, CASE event_type WHEN 'click' THEN 'repost' WHEN 'view' THEN 'quote' WHEN 'purchase' THEN 'reply' ELSE 'original' END AS post_type,
strftime(ts, {ISO}) AS occurred_at, CASE WHEN event_type <> 'error' THEN {KIND} END AS kind, CASE WHEN event_type = 'signup' AND json_extract_string(props, '$.k') = '0' THEN 'm' WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS dst FROM events WHERE event_id % 50 <> 0""")
def archive_events(spark, d):
    t, k = F.col("event_type"), F.col("k")
    who = lambda i: F.concat(F.lit("{'id': "), i, F.lit(", 'name': 'N'}"))
    to = F.concat(F.lit("{'user': 'n"), k, F.lit("', 'user_id': "), k, F.lit("}"))
    rows = _raw(spark, d).select(
        F.when(F.col("event_id") % 50 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("created_at"), F.col("event_id").alias("tweet_id"), F.lit("x").alias("tweet_content"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("user"), who(F.col("user_id").cast("string")).alias("user_info"),
        (t == "signup").alias("has_mention"), F.when(t == "signup", F.concat(F.lit("["), F.concat_ws(", ", *[F.concat(F.lit("{'id': "), k, F.lit(", 'username': 'm'}"))] * 2), F.lit("]"))).alias("mentions"),
        (t == "purchase").alias("is_reply"), F.when(t == "purchase", to).alias("reply_to"), (t == "view").alias("is_quote"), F.when(t == "view", to).alias("quoted_from"), (t == "click").alias("is_retweet"), F.when(t == "click", to).alias("retweeted_from"), F.lit(None).cast("string").alias("hashtags"),
    )
    return _pairs(archive.normalize(rows))


@query("A17_A18_A25_A33_api", f"""SELECT CAST(event_id AS VARCHAR) AS post_uid, CAST(user_id AS VARCHAR) AS actor_uid, CASE event_type WHEN 'click' THEN 'repost' WHEN 'view' THEN 'quote' WHEN 'purchase' THEN 'reply' ELSE 'original' END AS post_type,
strftime(ts, {ISO}) AS occurred_at, {KIND} AS kind, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS dst, CASE WHEN event_id % 2 = 0 THEN 'bio' ELSE 'other' END AS bio FROM events WHERE event_id % 40 <> 0""")
def api_events(spark, d):
    t, k = F.col("event_type"), F.col("k")
    even = F.col("event_id") % 2 == 0
    author = F.struct(F.col("user_id").cast("string").alias("id"), F.lit("u").alias("userName"), F.when(even, "bio").otherwise(" ").alias("description"), F.struct(F.lit("other").alias("description")).alias("profile_bio"))
    inner = F.struct(F.lit("1").alias("id"), F.struct(k.alias("id")).alias("author"))
    tweet = F.struct(
        F.col("event_id").cast("string").alias("id"), F.lit("x").alias("text"), F.when(F.col("event_id") % 40 == 0, "never").when(even, F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy")).otherwise(times.iso(F.col("ts"))).alias("createdAt"), author.alias("author"),
        (t == "purchase").alias("isReply"), F.when(t == "purchase", k).alias("inReplyToUserId"), F.when(t == "view", inner).alias("quoted_tweet"), F.when(t == "click", inner).alias("retweeted_tweet"),
        F.when(t.isin("signup", "click"), F.struct(F.array(*[F.struct(k.alias("id_str"))] * 2).alias("user_mentions"))).alias("entities"),
    )
    plain, boxed = F.to_json(F.struct(F.array(tweet).alias("tweets"))), F.to_json(F.struct(F.struct(F.array(tweet).alias("tweets")).alias("data")))
    e = web_api.normalize(web_api.posts_of(_raw(spark, d).select(F.when(F.col("event_id") % 3 == 0, boxed).otherwise(plain).alias("value"))))
    return _pairs(e).join(e.select("post_uid", F.col("actor_bio").alias("bio")), "post_uid")


@query("A12_C11_archive_days", "SELECT doc_id, CAST(DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) AS DATE) AS day, source AS label FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 28 BETWEEN 4 AND 10")
def archive_days(spark, d):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("string")
    name = F.when(F.col("doc_id") % 6 == 0, F.concat(day, F.lit(".parquet"))).otherwise(F.concat(F.lit("a/"), day, F.lit("-"), F.col("source"), F.lit(".parquet")))
    return archive.between(A.read(spark, d, "documents").select("doc_id", name.alias("name")), "name", "2024-01-05", "2024-01-11").select("doc_id", "day", "label")


@query("A26_null_shares", "SELECT c AS column, s AS null_share FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS s FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")) + ")")
def null_shares(spark, d):
    return files.describe(A.read(spark, d, "documents")).select("column", "null_share")


# ---------------------------------------------------------------- functions


@query("I4_I5_I6_dates", f"SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL ELSE strftime(ts, {ISO}) END AS iso FROM events")
def dates(spark, d):
    ts, n = F.col("ts"), F.col("event_id") % 6
    legacy, offset = F.date_format(ts, "EEE MMM dd HH:mm:ss '+0000' yyyy"), F.concat(F.date_format(ts + F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00"))
    written = F.when(n == 0, times.iso(ts)).when(n == 1, offset).when(n == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(n == 3, legacy).when(n == 5, "next week")
    return _raw(spark, d).select("event_id", times.iso(F.coalesce(times.parse_any_date(written), F.when(n == 4, times.from_micros(F.unix_micros(ts))))).alias("iso"))


_PHRASES = sorted(words.UNOFFICIAL)


@query("I10_unofficial", "SELECT actor_id, coalesce(list_filter([" + ", ".join("'" + p.replace("'", "''") + "'" for p in words.UNOFFICIAL) + "], lambda p: contains(lower(name || ' ' || coalesce(bio, '')), p))[1], CASE WHEN actor_id % 4 = 1 THEN 'negação no nome (''Not'')' END) AS phrase FROM (SELECT actor_id, CASE WHEN actor_id % 4 = 1 THEN 'Not me' ELSE 'Nothing' END AS name, CASE WHEN actor_id % 4 = 2 THEN 'Hi: ' || upper([" + ", ".join("'" + p.replace("'", "''") + "'" for p in _PHRASES) + f"][1 + (actor_id % {len(_PHRASES)})::INTEGER]) WHEN actor_id % 4 = 3 THEN 'not in the name' END AS bio FROM (SELECT DISTINCT user_id AS actor_id FROM events))")
def unofficial(spark, d):
    n = F.col("user_id")
    bio = F.when(n % 4 == 2, F.concat(F.lit("Hi: "), F.upper(F.get(F.array(*map(F.lit, _PHRASES)), (n % len(_PHRASES)).cast("int"))))).when(n % 4 == 3, "not in the name")
    return _raw(spark, d).select("user_id").distinct().select(n.alias("actor_id"), words.unofficial(F.when(n % 4 == 1, "Not me").otherwise("Nothing"), bio).alias("phrase"))


@query("I12_secrets", "SELECT event_id, event_id % 5 = 0 AS secret FROM events")
def secrets(spark, d):
    n, opaque = F.col("event_id") % 5, F.concat(F.lit("Zk9"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 20), F.lit("7q"))
    line = F.when(n == 0, F.concat(F.lit("api_key = '"), opaque, F.lit("'"))).when(n == 1, F.concat(F.lit("api_key = '"), opaque, F.lit("'  # guarda: permitido"))).when(n == 2, "token = os.environ_of_the_service_1").when(n == 3, F.concat(F.lit("size = "), opaque)).otherwise("senha: short1")
    return _raw(spark, d).select("event_id", words.secret_like(line).alias("secret"))


@query("O9_I15_community_themes", A.CTE + ", j AS (SELECT actor_id % 7 AS community_id, label, actor_id FROM post), n AS (SELECT community_id, label, count(*) AS posts, count(DISTINCT actor_id) AS voices FROM j GROUP BY ALL), t AS (SELECT community_id, count(*) AS all_, count(DISTINCT actor_id) AS voices_all FROM j GROUP BY ALL), r AS (SELECT n.*, all_, voices_all, row_number() OVER (PARTITION BY community_id ORDER BY posts DESC, label) AS r FROM n JOIN t USING (community_id)) SELECT community_id, any_value(voices_all) AS voices, any_value(all_) AS posts, string_agg(label || ' ' || CAST(round(100.0 * posts / all_) AS INTEGER) || '%', ' · ' ORDER BY r) AS shares FROM r WHERE r <= 5 GROUP BY community_id")
def community_themes(spark, d):
    posts = A.posts(spark, d)
    return text.community_themes(posts, posts.select("actor_id").distinct().withColumn("community_id", F.col("actor_id") % 7))
