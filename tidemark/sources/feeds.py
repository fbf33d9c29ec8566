"""Shapes of the JSON feeds and how they flatten into raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import joined
from tidemark.functions.timeparts import from_millis
from tidemark.sources.tables import coordinate, first_item, flatten_json

TRADE_MESSAGE = (
    "trade_id bigint, symbol string, price double, quantity double, buyer_maker boolean, "
    "trade_time timestamp, event_time timestamp"
)
PAYMENT_REQUEST = "payment_id string, amount double, requested_at timestamp"
PAYMENT_REJECTION = "payment_id string, rejected_at timestamp"

_PERSON = "array<struct<id: string, name: string>>"
_TRACK = (
    f"id: string, name: string, artists: {_PERSON}, "
    "album: struct<id: string, name: string, release_date: string>, duration_ms: int, "
    "explicit: boolean, popularity: int, external_urls: struct<spotify: string>, "
    "preview_url: string"
)
TOP_ARTISTS = (
    "struct<items: array<struct<id: string, name: string, popularity: int, "
    "followers: struct<total: int>, genres: array<string>, "
    "external_urls: struct<spotify: string>, images: array<struct<url: string>>>>>"
)
TOP_TRACKS = f"struct<items: array<struct<{_TRACK}>>>"
RECENT_PLAYS = (
    f"struct<items: array<struct<played_at: timestamp, track: struct<{_TRACK}>, "
    "context: struct<type: string, uri: string>>>>"
)
MATCH_EVENT = (
    "struct<id: string, match_id: int, index: int, period: int, timestamp: string, minute: int, "
    "second: int, type: string, possession: int, possession_team: string, play_pattern: string, "
    "team: string, player_id: int, player: string, location: array<double>, duration: double>"
)
LINEUP = (
    "struct<match_id: int, team_name: string, players: array<struct<player_id: int, "
    "player_name: string, player_nickname: string, jersey_number: int, "
    "country: struct<id: int, name: string>>>>"
)


def parse_ticks(raw: DataFrame) -> DataFrame:
    """Exchange ticks to trade messages; other message kinds are left out."""
    # The feed's field names differ by case only (t/T, e/E), so they are picked by JSON path.
    def field(path: str) -> Column:
        return F.get_json_object("value", path)

    return raw.filter(field("$.e") == "trade").select(
        field("$.t").cast("bigint").alias("trade_id"),
        field("$.s").alias("symbol"),
        field("$.p").cast("double").alias("price"),
        field("$.q").cast("double").alias("quantity"),
        field("$.m").cast("boolean").alias("buyer_maker"),
        from_millis(field("$.T").cast("bigint")).alias("trade_time"),
        from_millis(field("$.E").cast("bigint")).alias("event_time"),
    )


def top_artists(raw: DataFrame) -> DataFrame:
    """One row per artist of a `(time_range, payload)` response, ranked by position."""
    item = F.col("item")
    return flatten_json(
        raw, "payload", TOP_ARTISTS,
        {
            "id": item["id"],
            "name": item["name"],
            "time_range": F.col("time_range"),
            "popularity": item["popularity"],
            "followers": item["followers"]["total"],
            "genres": joined(item["genres"]),
            "spotify_url": item["external_urls"]["spotify"],
            "image_url": first_item(item["images"], "url"),
            "ingested_at": F.current_timestamp(),
        },
        items="items", rank="rank",
    )


def _track_fields(track):
    return {
        "artist_ids": joined(track["artists"], "id"),
        "artist_names": joined(track["artists"], "name"),
        "album_id": track["album"]["id"],
        "album_name": track["album"]["name"],
        "duration_ms": track["duration_ms"],
        "explicit": track["explicit"],
        "popularity": track["popularity"],
        "spotify_url": track["external_urls"]["spotify"],
    }


def top_tracks(raw: DataFrame) -> DataFrame:
    item = F.col("item")
    return flatten_json(
        raw, "payload", TOP_TRACKS,
        {
            "id": item["id"],
            "name": item["name"],
            "time_range": F.col("time_range"),
            **_track_fields(item),
            "album_release_date": item["album"]["release_date"],
            "preview_url": item["preview_url"],
            "ingested_at": F.current_timestamp(),
        },
        items="items", rank="rank",
    )


def recent_plays(raw: DataFrame) -> DataFrame:
    item = F.col("item")
    return flatten_json(
        raw, "payload", RECENT_PLAYS,
        {
            "played_at": item["played_at"],
            "track_id": item["track"]["id"],
            "track_name": item["track"]["name"],
            **_track_fields(item["track"]),
            "context_type": item["context"]["type"],
            "context_uri": item["context"]["uri"],
            "ingested_at": F.current_timestamp(),
        },
        items="items",
    )


def match_events(raw: DataFrame) -> DataFrame:
    doc = F.col("doc")
    plain = ["period", "timestamp", "minute", "second", "possession", "possession_team",
             "play_pattern", "team", "player_id", "duration"]
    return flatten_json(
        raw, "payload", MATCH_EVENT,
        {
            "event_id": doc["id"],
            "match_id": doc["match_id"],
            "event_index": doc["index"],
            "event_type": doc["type"],
            "player_name": doc["player"],
            **{c: doc[c] for c in plain},
            "location_x": coordinate(doc["location"], 0),
            "location_y": coordinate(doc["location"], 1),
            "ingested_at": F.current_timestamp(),
        },
    )


def lineups(raw: DataFrame) -> DataFrame:
    doc, item = F.col("doc"), F.col("item")
    return flatten_json(
        raw, "payload", LINEUP,
        {
            "match_id": doc["match_id"],
            "team_name": doc["team_name"],
            "player_id": item["player_id"],
            "player_name": item["player_name"],
            "player_nickname": item["player_nickname"],
            "jersey_number": item["jersey_number"],
            "country_name": item["country"]["name"],
            "ingested_at": F.current_timestamp(),
        },
        items="players",
    )
