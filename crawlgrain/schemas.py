"""Schemas of the tables, as DDL strings."""

REDIRECT_CHAIN = "array<struct<from_url:string,to_url:string,status_code:int>>"
ERROR = "struct<kind:string,detail:string>"
DIRECTIVES = "struct<noindex:boolean,nofollow:boolean,noarchive:boolean,nosnippet:boolean,noimageindex:boolean,unavailable_after:date,source:string>"

#: What a fetcher observed of a URL.
FETCHES = f"session_id string, url string, normalized_url string, crawl_depth int, source string, discovered_at timestamp, fetched_at timestamp, status_code int, content_type string, final_url string, redirect_chain {REDIRECT_CHAIN}, response_time_ms int, content_size_bytes bigint, headers map<string,string>, body string, fetch_error {ERROR}"
ROBOTS = "host string, http_status int, body string"
SITEMAPS = "url string, body string"
PROJECTS = "id string, name string, seeds array<string>, created_at timestamp"
SESSIONS = "id string, project_id string, status string, started_at timestamp, finished_at timestamp"
LINKS = "session_id string, source_url string, target_url string, anchor_text string, rel struct<nofollow:boolean,ugc:boolean,sponsored:boolean,noopener:boolean,noreferrer:boolean>, tag_name string, is_internal boolean"
ISSUES = "session_id string, url string, issue_key string, severity string, category string, title string, description string, remediation string, data map<string,string>"

#: What the HTML parser returns of a page.
PAGE_FACTS = (
    "struct<title:string,meta_description:string,h1:string,h1_count:int,h2_count:int,canonical:string,robots:string,"
    "hreflang:array<struct<lang:string,url:string,region:string>>,og_title:string,og_description:string,"
    "structured_data_types:array<string>,body_text:string,image_count:int,bare_image_links:int,"
    "links:array<struct<url:string,tag:string,rel:string,anchor:string,nofollow:boolean>>>"
)
PARSED_ROBOTS = "struct<groups:array<struct<user_agents:array<string>,rules:array<struct<allow:boolean,path:string>>>>,sitemaps:array<string>,crawl_delay:double>"
PARSED_SITEMAP = "struct<urls:array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>,children:array<string>,error:string>"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
