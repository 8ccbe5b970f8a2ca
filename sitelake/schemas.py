"""Declared schemas of page records and their parts, as DDL."""

from __future__ import annotations

PAGE = """
    `$schema` string, schema_version int, url string, canonical_url string, title string, description string, section string,
    breadcrumb array<struct<title:string,url:string>>, path_titles array<string>, lang string, page_type string,
    has_substantive_content boolean,
    content struct<summary:string,full_text:string,full_text_hash:string,content_hash:string,content_length:int,keywords_extracted:array<string>>,
    mini_summary struct<text:string,generated_at:timestamp,model:string,source_hash:string,skipped:string>,
    dates struct<content_date:string,page_updated_at:timestamp>,
    metadata struct<depth:int,parent_url:string,http_status:int,etag:string,last_modified:string,extracted_at:timestamp,crawler_version:string,redirected_from:string,canonical_of:string,stale_since:timestamp,extraction_warnings:array<string>>,
    links struct<children:array<struct<title:string,url:string,local_path:string>>,internal:array<struct<title:string,url:string>>,external:array<struct<title:string,url:string>>>,
    documents array<struct<title:string,url:string,type:string,size_bytes:bigint,detected_from:string,context_text:string>>,
    tags array<string>
"""
MANIFEST = (
    "partition_path string, row_count int, category string, source_url string, source_hash string, extractor_version string, extracted_at timestamp, valid_until timestamp, is_frozen boolean"
)
