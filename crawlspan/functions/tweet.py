"""Accessors over tweets as JSON text or VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(json: Column | str) -> Column:
    """A tweet as VARIANT; NULL for text that is no JSON."""
    return F.try_parse_json(F.col(json) if isinstance(json, str) else json)


def _get(tweet: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(tweet, path, kind)


def tweet_id(t: Column) -> Column:
    return _get(t, "$.id_str", "string")


def created_at(t: Column) -> Column:
    return _get(t, "$.created_at", "string")


def tweet_text(t: Column) -> Column:
    return _get(t, "$.text", "string")


def lang(t: Column) -> Column:
    return _get(t, "$.lang", "string")


def username(t: Column) -> Column:
    return _get(t, "$.user.screen_name", "string")


def is_verified(t: Column) -> Column:
    return F.coalesce(_get(t, "$.user.verified", "boolean"), F.lit(False))


def follower_count(t: Column) -> Column:
    return F.coalesce(_get(t, "$.user.followers_count", "int"), F.lit(0))


def friend_count(t: Column) -> Column:
    return F.coalesce(_get(t, "$.user.friends_count", "int"), F.lit(0))
