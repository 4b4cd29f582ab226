"""Aggregator API payloads: extraction, normalization, paging, limits, cost."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import parse_any_date

from .events import EVENT_COLUMNS, target

PLATFORM = "x"
_AUTHOR = "struct<id: string, userName: string, name: string, description: string, createdAt: string, followers: bigint, following: bigint, statusesCount: bigint, profile_bio: struct<description: string>>"
_INNER = f"struct<id: string, text: string, createdAt: string, author: {_AUTHOR}>"
TWEET = (
    f"struct<id: string, text: string, createdAt: string, lang: string, isReply: boolean, inReplyToId: string, inReplyToUserId: string, inReplyToUsername: string, conversationId: string, "
    f"retweetCount: bigint, replyCount: bigint, likeCount: bigint, quoteCount: bigint, author: {_AUTHOR}, entities: struct<user_mentions: array<struct<id_str: string, screen_name: string, name: string>>>, quoted_tweet: {_INNER}, retweeted_tweet: {_INNER}>"
)
PAGE = f"tweets array<{TWEET}>, data struct<tweets: array<{TWEET}>>, has_next_page boolean, next_cursor string, status string, msg string, message string, error string"
# The provider's terms.
COST_PER_POST, POSTS_PER_PAGE, CREDITS_PER_USD, INTERVAL, ATTEMPTS = 0.00015, 20, 100_000, 5.5, 3


def bio(author: Column) -> Column:
    """The bio, from either of its places; blank is none."""
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(full(author["description"]), full(author["profile_bio"]["description"]))


def _to(kind: str, post: Column) -> Column:
    a = post["author"]
    return target(kind, F.when(a["id"] != "", a["id"]), a["userName"], post["id"], a["name"], bio(a), parse_any_date(a["createdAt"]))


def posts_of(pages: DataFrame) -> DataFrame:
    """(tweet) rows of page payloads (``value``, JSON), whether enveloped or not."""
    p = pages.select(F.from_json("value", PAGE).alias("p"))
    return p.select(F.explode(F.coalesce("p.tweets", "p.data.tweets")).alias("tweet"))


def normalize(posts: DataFrame, account: str = "") -> DataFrame:
    """Normalized events of (tweet) rows; posts without an id, an author's id or a date have none.

    Targets in order: repost, reply, quote, then mentions of accounts that no other target names. The
    first names the post's type, but a mention doesn't.
    """
    t = F.col("tweet")
    a = t["author"]
    at = parse_any_date(t["createdAt"])
    reply = F.when(t["isReply"] & (t["inReplyToUserId"] != ""), target("reply", t["inReplyToUserId"], t["inReplyToUsername"], t["inReplyToId"]))
    refs = F.array_compact(F.array(_to("repost", t["retweeted_tweet"]), reply, _to("quote", t["quoted_tweet"])))
    all_m = F.filter(F.coalesce(t["entities"]["user_mentions"], F.array()), lambda m: m["id_str"] != "")
    ids = lambda x: F.transform(x, lambda m: m["id_str"])
    once = F.filter(all_m, lambda m, i: (F.array_position(ids(all_m), m["id_str"]) == i + 1) & ~F.array_contains(F.transform(refs, lambda r: r["uid"]), m["id_str"]))
    mentions = F.transform(once, lambda m: target("mention", m["id_str"], m["screen_name"], display_name=m["name"]))
    ok = posts.where((t["id"] != "") & (a["id"] != "") & at.isNotNull())
    return ok.select(
        F.lit(PLATFORM).alias("platform"), F.lit("post").alias("kind"), a["id"].alias("actor_uid"), a["userName"].alias("actor_handle"), a["name"].alias("actor_display_name"), bio(a).alias("actor_bio"),
        parse_any_date(a["createdAt"]).alias("actor_created_at"), at.alias("occurred_at"), t["id"].alias("cursor"), F.lit(account).alias("cursor_account"), t["id"].alias("post_uid"),
        F.coalesce(F.get(refs, F.lit(0))["kind"], F.lit("original")).alias("post_type"), t["text"].alias("text"), t["lang"].alias("lang"), F.concat(refs, mentions).alias("targets"), F.to_json(t).alias("raw"),
    ).select(*EVENT_COLUMNS)


class ProviderError(RuntimeError):
    """The provider refused, whatever the HTTP status said."""


def check_body(body: dict) -> dict:
    """``body``; an error that came with a good status is raised."""
    if str(body.get("status", "")).lower() in ("error", "fail", "failed") or body.get("error"):
        raise ProviderError(str(body.get("msg") or body.get("message") or body.get("error")))
    return body


def next_cursor(body: dict) -> str | None:
    """Paging ends by ``has_next_page``, not by an empty cursor."""
    return body.get("next_cursor") or None if body.get("has_next_page") else None


def estimate_usd(pages: int) -> float:
    return pages * POSTS_PER_PAGE * COST_PER_POST


def effective_cap(configured: float | None, balance: float | None) -> float | None:
    known = [x for x in (configured, balance) if x is not None]
    return min(known) if known else None


def spent_usd(before: float, after: float) -> float:
    return max(0.0, (before - after) / CREDITS_PER_USD)


@dataclass
class Transport:
    """GET with a least interval; only refusals for rate are tried again, with growing waits."""

    base: str
    key: str
    interval: float = INTERVAL
    open_: Callable = urllib.request.urlopen
    sleep: Callable = time.sleep
    clock: Callable = time.monotonic
    _last: float = field(default=float("-inf"))

    def get(self, path: str, **query) -> dict:
        for k in range(ATTEMPTS):
            wait = self._last + self.interval - self.clock()
            if wait > 0:
                self.sleep(wait)
            self._last = self.clock()
            try:
                req = urllib.request.Request(f"{self.base}/{path}?{urllib.parse.urlencode(query)}", headers={"X-API-Key": self.key})
                with self.open_(req) as r:
                    return check_body(json.loads(r.read()))
            except urllib.error.HTTPError as e:
                if e.code != 429 or k == ATTEMPTS - 1:
                    raise
                self.sleep(self.interval * (k + 2))
        raise AssertionError

    def balance(self) -> float:
        b = self.get("oapi/my/info")
        return float(b.get("recharge_credits", 0)) + float(b.get("total_bonus_credits", 0))

    def profile(self, handle: str) -> dict:
        return self.get("twitter/user/info", userName=handle).get("data") or {}


@dataclass
class Collection:
    """Pages of account timelines, or of one search, under a budget; ``frame`` tells what was reached."""

    transport: Transport
    accounts: list[str] | None = None
    query: str | None = None
    pages: int = 1
    cap_usd: float | None = None
    check_every: int = 10

    def __post_init__(self):
        if bool(self.accounts) == bool(self.query):
            raise ValueError("give accounts or a query, one of them")
        self.frame = {"kind": "accounts" if self.accounts else "search", "planned": len(self.accounts or [1]), "reached": 0, "left_out": [], "pages": 0, "budget": self.cap_usd, "stopped_by": None}

    def payloads(self, cursors: dict[str, str] | None = None) -> Iterator[tuple[str, dict]]:
        """(account, page) for DataFrames; stops at the cap."""
        begin = self.transport.balance()
        cap = effective_cap(self.cap_usd, begin / CREDITS_PER_USD)
        for name in self.accounts or [""]:
            cursor = (cursors or {}).get(name, "")
            for _ in range(self.pages):
                seen = self.frame["pages"]
                spent = spent_usd(begin, self.transport.balance()) if seen and seen % self.check_every == 0 else estimate_usd(seen)
                if cap is not None and spent + estimate_usd(1) > cap:
                    self.frame["stopped_by"] = "budget"
                    self.frame["left_out"] = list(self.accounts or [])[self.frame["reached"] :]
                    return
                path = ("twitter/user/last_tweets", {"userName": name}) if name else ("twitter/tweet/advanced_search", {"query": self.query})
                body = self.transport.get(path[0], **path[1], cursor=cursor)
                self.frame["pages"] += 1
                yield name, body
                cursor = next_cursor(body) or ""
                if not cursor:
                    break
            self.frame["reached"] += 1
