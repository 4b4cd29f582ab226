"""The normalized event: what every source yields."""

from __future__ import annotations

from pyspark.sql import functions as F

TARGET = "struct<kind: string, uid: string, handle: string, post_uid: string, display_name: string, bio: string, created_at: timestamp>"
#: Columns of normalized events; ``kind`` is post, identity or delete.
EVENT = (
    "platform string, kind string, actor_uid string, actor_handle string, actor_display_name string, actor_bio string, actor_created_at timestamp, "
    f"occurred_at timestamp, cursor string, cursor_account string, post_uid string, post_type string, text string, lang string, targets array<{TARGET}>, raw string"
)
EVENT_COLUMNS = "platform kind actor_uid actor_handle actor_display_name actor_bio actor_created_at occurred_at cursor cursor_account post_uid post_type text lang targets raw".split()


def target(kind, uid, handle=None, post_uid=None, display_name=None, bio=None, created_at=None):
    """A target struct from columns; null where the uid is."""
    none = lambda t: F.lit(None).cast(t)
    text = lambda c: none("string") if c is None else c.cast("string")
    s = F.struct(
        F.lit(kind).alias("kind"), uid.cast("string").alias("uid"), text(handle).alias("handle"), text(post_uid).alias("post_uid"),
        text(display_name).alias("display_name"), text(bio).alias("bio"), (none("timestamp") if created_at is None else created_at).alias("created_at"),
    )
    return F.when(uid.isNotNull(), s)

