"""Fixed values that results depend on.  All are defaults of parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# Single-character substitutions that spell words evasively.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
# Words without meaning for a title; quality marks as they read after substitution.
STOPWORDS = ("streaming", "live", "gratis", "free", "nonton", "bisa", "link", "tonton", "full", "hd", "fhd", "ntn", "io8op", "t2op", "a8op")
# Terms added to queries, and the spellings that evade them.
BRAND_TERMS = ("vidio", "vidio.com")
EVASIONS = {"vidio": ("v1dio", "vid1o", "v1d1o", "v1d10", "vidie", "vidi0")}
# Tracking parameters of URLs.
NOISE_PARAMETERS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "_rdc", "_rdr", "igshid", "yclid", "gclid", "mcid", "ncid", "ref", "refid", "fref", "hc_ref", "__tn__", "__cft__",
)
# Hosts that serve one site.
HOSTS = {h: "www.facebook.com" for h in ("m.facebook.com", "fb.com", "web.facebook.com", "l.facebook.com", "mbasic.facebook.com")}
# First path segments of content, and of pages that belong to no uploader.
CONTENT_PREFIXES = ("watch", "video", "videos", "reel", "reels", "live", "stories", "story", "photo", "photos", "permalink")
SYSTEM_PATHS = (
    "watch", "video", "videos", "reel", "reels", "live", "stories", "story", "search", "marketplace", "groups", "pages", "events", "gaming", "photo", "photos", "about", "friends", "timeline", "help", "settings",
)
# Hosts of messenger and short-video profiles.
TELEGRAM_HOSTS = ("t.me", "telegram.me", "www.t.me")
TIKTOK_HOSTS = ("www.tiktok.com", "tiktok.com")
# Patterns of links to an uploader's page (numbered profile, page, group; then a name), of labels and of texts.
OWNER_LINKS = (
    r'href="((?:https://www\.facebook\.com)?/profile\.php\?id=[0-9]+)"', r'href="((?:https://www\.facebook\.com)?/pages/[^"?]{5,})"', r'href="((?:https://www\.facebook\.com)?/groups/[0-9]+/?)"',
)
NAME_LINK = r'href="/([A-Za-z0-9][A-Za-z0-9._-]{2,})/?(?:\?[^"]*)?"'
LABEL, SHOWN = r'(?:aria-label|title)="([^"]{5,200})"', r">([^<]{5,200})<"
# Patterns of view counts, in words of two languages and in data.
VIEWS_ENGLISH, VIEWS_LOCAL = r"([\d,]+(?:\.\d+)?)\s*([KkMm])?\s*(?:views?|penonton|ditonton)", r"([\d]+(?:[,.]\d+)?)\s*(rb|jt)?\s*Tayangan"
VIEWS_DATA = (r'"play_count"\s*:\s*\{"count"\s*:\s*(\d+)', r'"video_view_count"\s*:\s*\{"count"\s*:\s*(\d+)', r'"view_count"\s*:\s*(\d+)')
# Patterns of titles, owners and ids in data of pages.
DATA_TITLES = (r'"title"\s*:\s*"([^"]{5,400})"', r'"save_description"\s*:\s*"([^"]{5,400})"', r'"accessibility_label"\s*:\s*"([^"]{5,400})"')
DATA_OWNER, DATA_NAME = r'"id"\s*:\s*"([0-9]{5,20})"', r'"name"\s*:\s*"([^"]{2,80})"'
SOCIAL_IDS = (r"fb://(?:page|profile|group)/([0-9]+)", r'"pageID"\s*:\s*"([0-9]+)"', r'"entity_id"\s*:\s*"([0-9]+)"')
CHANNEL_IDS = (r'"channelId"\s*:\s*"(UC[a-zA-Z0-9_-]{22})"', r"/channel/(UC[a-zA-Z0-9_-]{22})")
OG_TITLE = r'<meta\s+property="og:title"\s+content="([^"]+)"'
NEXT_DATA = r'(?s)<script\s+id="__NEXT_DATA__"[^>]*>\s*(\{.*?\})\s*</script>'
# The most points of each signal, and the least score of each verdict.
WEIGHTS = {"title_keyword_match": 25, "content_id_watermark": 30, "stream_key_fingerprint": 20, "offender_repeat_history": 15, "engagement_anomaly": 10}
VERDICTS = (("confirmed", 80), ("likely", 60), ("possible", 25))
# Strings that a page carrying licensed media keeps.
BRAND_MARKERS = ("vidio.com", "content.vidio.com", "vidio-player", "player.vidio.com", "vidio premium")
# Fixed values: (at least, points) of the graded signals, best first.
TITLE_GRADES = ((0.95, 25), (0.80, 15), (0.60, 5))
MARKER_GRADES = ((3, 15), (1, 7))
REPEAT_GRADES = ((4, 15), (2, 10), (1, 5))
VIEW_RATE_GRADES = ((10_000, 10), (1_000, 7), (100, 4))
FINGERPRINTS = {"confirmed": 20, "likely": 10}
# Offender tiers by violations, and offender statuses.
TIERS = ((5, "tier1"), (2, "tier2"))
LAST_TIER = "tier3"
STATUSES = ("active", "suspended", "removed", "appealing")
FUZZY_THRESHOLD = 0.85
LEAST_DURATION = 600


@dataclass(frozen=True)
class Health:
    """Bounds of the run checks."""

    dedup_low: float = 0.10
    dedup_high: float = 0.70
    runtime: float = 3600.0


@dataclass(frozen=True)
class Settings:
    """What a run may override."""

    brand_terms: tuple[str, ...] = BRAND_TERMS
    brand_markers: tuple[str, ...] = BRAND_MARKERS
    max_queries: int = 50
    max_results: int = 50
    fuzzy_threshold: float | None = FUZZY_THRESHOLD
    health: Health = field(default_factory=Health)
