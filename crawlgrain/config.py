"""Settings of a crawl analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

# Query parameters that only track visitors.
TRACKING_PARAMETERS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic",
    "fbclid", "gclid", "gbraid", "wbraid", "msclkid", "dclid",
    "mc_cid", "mc_eid", "_hsenc", "_hsmi", "hs_email_id", "hs_ctct_key",
    "ref", "referrer", "source",
)


@dataclass(frozen=True)
class CrawlConfig:
    """max_depth < 0 and max_urls 0 mean no limit; allowed_paths () means the whole site.

    reference_robots: `*` groups join specific ones and an empty Disallow blocks all;
    otherwise RFC 9309 holds. bare_references: character references without their
    semicolon are read as browsers read them, else as text.
    """

    max_depth: int = 10
    max_urls: int = 0
    allowed_paths: tuple[str, ...] = ()
    constrain_to_seed_domain: bool = True
    include_subdomains: bool = False
    requests_per_second_per_host: float = 1.0
    obey_robots: bool = True
    user_agent: str = "crawlgrain"
    custom_headers: dict[str, str] = field(default_factory=dict)
    strip_tracking_parameters: bool = True
    normalize_trailing_slash: bool = True
    sort_query_parameters: bool = False
    fold_http: bool = False
    max_response_body_bytes: int = 5_000_000
    import_sitemap_at_start: bool = True
    reference_robots: bool = False
    bare_references: bool = True
