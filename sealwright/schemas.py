"""Row types of the evidence tables, as DDL strings (usable before a session exists)."""

from __future__ import annotations


LEDGER_PIPE = (
    "case_id string, id bigint, ts bigint, operator string, action string, path string,"
    " sha256 string, prev_hash string, entry_hash string")

LEDGER_LINE = ("seq bigint, ts string, event string, prev string, hash string")

EVENT_SEALED = (
    "source_sha256 string, vault string, vault_sha256 string, status string, masked_fraction double")
EVENT_DELETED = ("vault string, vault_sha256 string")

MANIFEST = (
    "tool string, version string, case_id string, operator string, created_unix bigint,"
    " source_root string, evidence array<struct<source_path:string,relative_path:string,"
    "size_bytes:bigint,sha256:string,claimed_extension:string,magic_hint:string,vault_relpath:string>>")

_REGIONS = "array<struct<x:int,y:int,w:int,h:int,area:int>>"
PAGE_REPORT = (
    "page_id string, width int, height int, white_page_detected boolean, glare_pixels bigint,"
    f" shadow_pixels bigint, glare_regions {_REGIONS}, shadow_regions {_REGIONS},"
    " masked_fraction double, thresholds struct<hi:int,lo:int>, status string,"
    " repair struct<illumination_flattened:boolean,glare_halo_stretched:boolean,"
    "inpainted_pixels:bigint,inpaint_method:string,shadow_filled:boolean>,"
    " reading_order_nodes int, source_kind string, frames_sampled int, frames_used int,"
    " reference_frame int, composite_replaced_fraction double, video_fallback string,"
    " settings struct<flatten:boolean,fill_shadow:boolean,repair:boolean>")

CHECKOUT_EVENT = (
    "recv_ts timestamp, signature_header string, type string,"
    " data struct<object:struct<id:string,payment_status:string,payment_link:string,mode:string,"
    "quantity:int,customer_email:string,customer_details:struct<email:string,name:string>,"
    "metadata:map<string,string>>>")

LICENCE_PAYLOAD = (
    "v string, product string, id string, plan string, email string, name string, seats int,"
    " issued string, expires string, `order` string")

CATALOGUE_JSON = (
    "products array<struct<id:string,name:string,description:string,metadata:map<string,string>,"
    "prices:array<struct<id:string,unit_amount:bigint,currency:string,type:string>>,"
    "features:array<string>>>")

_STEP = "struct<name:string,status:string,conclusion:string>"
API_DUMPS = {
    "tree": ("type string, path string, size bigint"),
    "runs": (
        "id bigint, name string, status string, conclusion string, head_branch string,"
        " head_sha string, run_started_at string, updated_at string, html_url string"),
    "jobs": (
        "run_id bigint, name string, status string, conclusion string, started_at string,"
        f" completed_at string, steps array<{_STEP}>"),
    "releases": (
        "tag_name string, name string, draft boolean, prerelease boolean, published_at string,"
        " html_url string, assets array<struct<name:string,size:bigint,download_count:bigint,"
        "browser_download_url:string>>"),
    "pulls": (
        "number bigint, title string, state string, user struct<login:string>,"
        " head struct<ref:string,sha:string>, base struct<ref:string>,"
        " labels array<struct<name:string>>, draft boolean, created_at string, updated_at string,"
        " html_url string, mergeable boolean, merged boolean, additions bigint, deletions bigint,"
        " changed_files bigint"),
    "reviews": ("number bigint, user struct<login:string>, state string, submitted_at string"),
    "checks": ("head_sha string, name string, status string, conclusion string"),
    "issues": (
        "number bigint, title string, state string, user struct<login:string>,"
        " labels array<struct<name:string>>, assignees array<struct<login:string>>,"
        " milestone struct<title:string>, pull_request struct<url:string>, created_at string,"
        " html_url string"),
    "repos": (
        "full_name string, description string, private boolean, default_branch string,"
        " stargazers_count bigint, forks_count bigint, open_issues_count bigint, html_url string,"
        " created_at string, pushed_at string, homepage string"),
    "languages": ("full_name string, languages map<string,bigint>"),
    "branches": ("name string, commit struct<sha:string>, protected boolean"),
}
