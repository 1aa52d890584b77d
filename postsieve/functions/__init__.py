"""Column functions: text, keys, tiers and JSON helpers."""

from postsieve.functions.embedded import embedded_json, json_count
from postsieve.functions.keys import listing_key
from postsieve.functions.text import (
    iso_utc,
    or_default,
    posting_url,
    render_list,
    search_text,
    snippet,
    split_title,
    strip_html,
    strip_space,
    truncate,
)
from postsieve.functions.tiers import tier_colour, tier_label

__all__ = [
    "embedded_json",
    "iso_utc",
    "json_count",
    "listing_key",
    "or_default",
    "posting_url",
    "render_list",
    "search_text",
    "snippet",
    "split_title",
    "strip_html",
    "strip_space",
    "tier_colour",
    "tier_label",
    "truncate",
]
