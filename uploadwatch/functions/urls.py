"""URLs: canonical form, video and profile addresses, and the permanent ids in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from uploadwatch import config
from uploadwatch.functions.text import stripped

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_SITE = "https://www.facebook.com"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def host(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    """The path without parameters of its last segment."""
    return F.regexp_replace(_part(url, 3), r";[^/]*$", "")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def is_number(text: Column) -> Column:
    """ASCII digits only."""
    return F.coalesce(text.rlike(r"\A[0-9]+\z"), F.lit(False))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def quoted(text: Column) -> Column:
    """Form encoding: a tilde stays, an asterisk does not."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def parameters(url: Column) -> Column:
    """Name and value of query parameters that have a value, in order."""
    given = F.filter(F.split(_part(url, 4), "&"), lambda p: p.rlike("(?s)=."))
    return F.transform(given, lambda p: F.struct(_decoded(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("name"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value")))


def parameter(url: Column, name: str) -> Column:
    """The first value of a parameter, or null."""
    return F.get(F.filter(parameters(url), lambda p: p["name"] == name), F.lit(0))["value"]


def canonical_url(url: Column) -> Column:
    """Without tracking parameters, fragment and closing slashes; hosts of one site become one.

    Parameters keep their order; those of one name stand together where the first does.
    """
    url = stripped(url)
    scheme = F.lower(F.when(_part(url, 1) == "", "https").otherwise(_part(url, 1)))
    site = F.lower(host(url))
    hosts = F.create_map(*(F.lit(x) for pair in config.HOSTS.items() for x in pair))
    site = F.coalesce(F.element_at(hosts, site), site)
    way = F.regexp_replace(path(url), "/+$", "")
    way = F.when(way == "", "/").otherwise(way)
    way = F.when((site != "") & ~way.startswith("/"), F.concat(F.lit("/"), way)).otherwise(way)
    front = F.when((site != "") | way.startswith("/"), F.concat(F.lit("//"), site)).otherwise("")
    kept = F.filter(parameters(url), lambda p: ~p["name"].isin(*config.NOISE_PARAMETERS))
    names = F.array_distinct(F.transform(kept, lambda p: p["name"]))
    grouped = F.flatten(F.transform(names, lambda n: F.filter(kept, lambda p: p["name"] == n)))
    query = F.array_join(F.transform(grouped, lambda p: F.concat(quoted(p["name"]), F.lit("="), quoted(p["value"]))), "&")
    return F.concat(scheme, F.lit(":"), front, way, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def search_url(query: Column) -> Column:
    return F.concat(F.lit(f"{_SITE}/search/videos/?q="), quoted(query))


def card_search_url(query: Column, home: str = "https://www.bilibili.tv/en") -> Column:
    return F.concat(F.lit(f"{home}/search?keyword="), quoted(query), F.lit("&type=VIDEO"))


def profile_url(channel_id: Column) -> Column:
    return F.when(is_number(channel_id), F.concat(F.lit(f"{_SITE}/profile.php?id="), channel_id)).otherwise(F.concat(F.lit(f"{_SITE}/"), channel_id))


def _at(parts: Column, i: int) -> Column:
    return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))


def video_url(url: Column) -> Column:
    """The canonical address of a video on the social site, or null."""
    url = F.when(url.startswith("/"), F.concat(F.lit(_SITE), url)).otherwise(url)
    parts, clip = segments(url), F.array(*map(F.lit, ("videos", "video", "live")))
    among = lambda c: F.array_contains(clip, c)
    joined = lambda n: F.concat(F.lit(f"{_SITE}/"), F.array_join(F.slice(parts, 1, n), "/"))
    watched = parameter(url, "v")
    here = (host(url) == "") | host(url).contains("facebook.com")
    found = (
        F.when(F.size(parts) == 0, None)
        .when(_at(parts, 0) == "watch", F.when(is_number(watched), F.concat(F.lit(f"{_SITE}/watch?v="), watched)))
        .when(_at(parts, 0).isin("videos", "reel", "reels") & is_number(_at(parts, 1)), joined(2))
        .when((_at(parts, 0) == "groups") & is_number(_at(parts, 1)) & among(_at(parts, 2)) & is_number(_at(parts, 3)), joined(4))
        .when(among(_at(parts, 1)) & is_number(_at(parts, 2)), joined(3))
        .when(_at(parts, 0).isin(*config.CONTENT_PREFIXES) & is_number(F.element_at(parts, -1)), F.concat(F.lit(f"{_SITE}/"), F.array_join(parts, "/")))
    )
    return F.when((url != "") & here, found)


def video_id(url: Column) -> Column:
    """The number of a video in its canonical address, or null."""
    parts = segments(url)
    clip = lambda c: c.isin("videos", "video", "live")
    watched = parameter(url, "v")
    return (
        F.when(F.regexp_replace(path(url), "/+$", "") == "/watch", F.when(is_number(watched), watched))
        .when(_at(parts, 0).isin("reel", "reels", "videos") & is_number(_at(parts, 1)), _at(parts, 1))
        .when(clip(_at(parts, 1)) & is_number(_at(parts, 2)), _at(parts, 2))
        .when((_at(parts, 0) == "groups") & is_number(_at(parts, 1)) & clip(_at(parts, 2)) & is_number(_at(parts, 3)), _at(parts, 3))
    )


def social_id(url: Column) -> Column:
    """The permanent number in a profile, group or page address, or null."""
    parts, asked = segments(url), parameter(url, "id")
    numbers = F.filter(F.reverse(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))), lambda p: is_number(p) & (F.length(p) >= 6))
    return (
        F.when((F.size(parts) == 1) & (_at(parts, 0) == "profile.php") & is_number(asked), asked)
        .when(_at(parts, 0).isin(*config.CONTENT_PREFIXES), None)
        .when((_at(parts, 0) == "groups") & is_number(_at(parts, 1)), _at(parts, 1))
        .when(_at(parts, 0) == "pages", F.get(numbers, F.lit(0)))
    )


def _found(text: Column, pattern: str) -> Column:
    value = F.regexp_extract(text, pattern, 1)
    return F.when(value != "", value)


def channel_id(url: Column) -> Column:
    """The id in a channel address of the video site, or null."""
    return _found(path(url), r"\A/channel/(UC[a-zA-Z0-9_-]{22})\z")


def messenger_name(url: Column) -> Column:
    name = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.when(host(url).isin(*config.TELEGRAM_HOSTS) & name.rlike(r"\A[a-zA-Z0-9_]{5,32}\z"), name)


def short_video_name(url: Column) -> Column:
    return F.when(host(url).isin(*config.TIKTOK_HOSTS), _found(path(url), r"\A/@([a-zA-Z0-9_.]{2,24})\z"))


def channel_of_page(url: Column) -> Column:
    """The uploader's number, else the first path segment, else 'unknown'."""
    return F.coalesce(social_id(url), F.get(segments(url), F.lit(0)), F.lit("unknown"))
